"""Thresholds that keep a risk, and comparisons of two systems with intervals."""

from __future__ import annotations

import hashlib
import math

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.stats import beta_quantile

#: Scores are counted by so many equal parts of 0 to 1 first; only the parts that the answer may lie in are looked at closer.
PARTS = 1024


def upper(k: int, n: int, confidence: float) -> float:
    """Exact upper bound of a rate from k of n."""
    return 1.0 if k == n else beta_quantile(confidence, k + 1, n - k)


def most_failures(n: int, most: float, confidence: float) -> int:
    """The largest k whose upper bound is within `most`; -1 if there is none. The bound grows with k, so k is halved in on."""
    low, high = -1, n
    while low < high:
        mid = (low + high + 1) // 2
        low, high = (mid, high) if upper(mid, n, confidence) <= most else (low, mid - 1)
    return low


def control(rows: DataFrame, most: float, confidence: float = 0.95) -> DataFrame:
    """threshold, failures, benign, bound: the smallest candidate at or above which benign rows of the threshold role are few enough.

    Candidates are 0, 1 and the double after each benign score; none within 0 to 1 gives no row. Since
    the bound depends on the count alone, the rule is one number of failures: the threshold follows the benign score
    that has just that many above it. Scores are counted by equal parts, so the order of one part's scores is all that is sorted.
    Rows are made once, for counts by score that are kept by persist().
    """
    if not 0 < most < 1 or not 0 < confidence < 1:
        raise ValueError("most and confidence must lie between 0 and 1")
    spark = rows.sparkSession
    benign = rows.where("role = 'threshold' and not attack").select(F.col("score").cast("double").alias("score"))
    benign = benign.groupBy("score").count().persist()
    n, bad = benign.agg(F.sum("count"), F.sum(F.when(F.coalesce(F.col("score").between(0, 1), F.lit(False)), 0).otherwise(F.col("count")))).first()
    if not n or bad:
        raise ValueError("risk control needs benign threshold cases with scores from 0 to 1")
    k = most_failures(n, most, confidence)
    out = "threshold double, failures long, benign long, bound double"
    if k < 0:
        return spark.createDataFrame([], out)
    if k >= n:
        return spark.createDataFrame([(0.0, n, n, upper(n, n, confidence))], out)
    part = F.least(F.floor(F.col("score") * PARTS), F.lit(PARTS - 1)).cast("int")
    above = 0
    for p, m in sorted(benign.groupBy(part.alias("p")).agg(F.sum("count")).collect(), reverse=True):  # at most PARTS rows
        if above + m > k:
            break
        above += m
    # the (k + 1)-th largest score is in part p: every threshold up to it has too many at or above
    by = benign.where(part == p)
    rank = F.sum("count").over(Window.orderBy(F.desc("score")))
    last = by.withColumn("upto", rank + above).where(F.col("upto") > k).agg(F.max("score").alias("s")).first().s
    threshold = math.nextafter(last, math.inf)
    if threshold > 1:
        return spark.createDataFrame([], out)
    failures = benign.where(F.col("score") >= threshold).agg(F.coalesce(F.sum("count"), F.lit(0))).first()[0]
    return spark.createDataFrame([(threshold, failures, n, upper(failures, n, confidence))], out)


def paired(left: DataFrame, right: DataFrame, metrics: list[str], seed: int = 1, replicates: int = 2000, level: float = 0.95) -> DataFrame:
    """metric, n, baseline, candidate, difference, lower, upper over rows (case_id, status, boolean metrics) with equal sets of cases.

    A metric counts where a row's status is ok, so a case's difference is -1, 0 or 1. Drawing n cases with
    replacement is drawing these three with their shares: a replicate of the paired bootstrap is one multinomial draw
    from three counts, exactly, however many cases there are. Each metric has a seed of its own, from its name. Raises ValueError where case ids repeat,
    the sets differ or a metric is null.
    """

    def value(side: str, m: str) -> Column:
        return F.when((F.col(f"{side}_status") == "ok") & F.col(f"{side}_{m}"), 1).otherwise(0)

    def named(df: DataFrame, side: str) -> DataFrame:
        return df.select(F.col("case_id").alias(f"{side}_id"), F.col("status").alias(f"{side}_status"), *[F.col(m).alias(f"{side}_{m}") for m in metrics])

    both = named(left, "l").join(named(right, "r"), F.col("l_id") == F.col("r_id"), "full")
    per = both.groupBy(F.coalesce("l_id", "r_id").alias("id")).agg(
        F.count(F.lit(1)).alias("n"), F.count_if(F.col("l_id").isNull() | F.col("r_id").isNull()).alias("alone"), F.count_if(F.greatest(*[F.col(f"{s}_{m}").isNull() for s in "lr" for m in metrics])).alias("null"),
        *[f(value(s, m)).alias(f"{s}{i}") for i, m in enumerate(metrics) for s, f in (("l", F.max), ("r", F.max))],
    )
    sums = [F.sum(g).alias(k) for i in range(len(metrics)) for k, g in ((f"l{i}", F.col(f"l{i}")), (f"r{i}", F.col(f"r{i}")), (f"up{i}", (F.col(f"r{i}") > F.col(f"l{i}")).cast("long")), (f"down{i}", (F.col(f"r{i}") < F.col(f"l{i}")).cast("long")))]
    t = per.agg(F.count(F.lit(1)).alias("n"), F.count_if((F.col("n") > 1) | (F.col("alone") > 0) | F.col("id").isNull()).alias("bad"), F.sum("null").alias("null"), *sums).first()
    if t["bad"] or not t["n"]:
        raise ValueError("both sides need the same cases, each once")
    if t["null"]:
        raise ValueError("paired metrics must be boolean")
    n, rows = t["n"], []
    for i, m in enumerate(metrics):
        up, down = t[f"up{i}"], t[f"down{i}"]
        draws = np.random.default_rng(metric_seed(m, seed)).multinomial(n, [up / n, down / n, max(0.0, 1 - (up + down) / n)], size=replicates)
        means = np.sort((draws[:, 0] - draws[:, 1]) / n)
        low, high = math.floor((1 - level) / 2 * replicates), min(max(math.ceil((1 + level) / 2 * replicates) - 1, 0), replicates - 1)
        rows.append((m, n, t[f"l{i}"] / n, t[f"r{i}"] / n, (t[f"r{i}"] - t[f"l{i}"]) / n, float(means[low]), float(means[high])))
    return left.sparkSession.createDataFrame(rows, "metric string, n long, baseline double, candidate double, difference double, lower double, upper double")


def metric_seed(metric: str, seed: int) -> int:
    return int(hashlib.sha256(metric.encode()).hexdigest()[:16], 16) ^ seed
