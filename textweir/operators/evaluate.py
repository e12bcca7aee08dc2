"""Statistics of scored, labelled rows: curves, calibration, strata, paired differences."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

EPSILON = 1e-15


def effective(score: Column, attack: Column) -> Column:
    """A missing score counts against its row: 0 for an attack, 1 for a benign case."""
    return F.coalesce(score, F.when(attack, 0.0).otherwise(1.0))


def curve(rows: DataFrame) -> DataFrame:
    """(threshold, tp, fp, p, n, positives, negatives) at every distinct score of rows (score, attack), and beyond both ends.

    p and n are the cases at the threshold itself. Counts are pre-aggregated by score, and summed in order by range partition: local sums
    and the totals of the partitions before, so no task holds all distinct scores.
    """
    by = rows.groupBy("score").agg(F.count_if("attack").alias("p"), F.count_if(~F.col("attack")).alias("n"))
    ends = rows.sparkSession.createDataFrame([(1 + EPSILON, 0, 0), (-EPSILON, 0, 0)], "score double, p long, n long")
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    # an exchange with a number of its own, which both readers below share
    r = by.unionByName(ends).repartitionByRange(parts, F.desc("score")).withColumn("_part", F.spark_partition_id())
    each = r.groupBy("_part").agg(F.sum("p").alias("_p"), F.sum("n").alias("_n"))  # one row a partition
    told = each.agg(F.array_sort(F.collect_list(F.struct("_part", "_p", "_n"))).alias("x"), F.sum("_p").alias("positives"), F.sum("_n").alias("negatives"))

    def before(k: str) -> Column:
        return F.aggregate(F.filter("x", lambda y: y["_part"] < F.col("_part")), F.lit(0).cast("long"), lambda s, y: s + y[k])

    w = Window.partitionBy("_part").orderBy(F.desc("score"))
    c = r.withColumns({"_tp": F.sum("p").over(w), "_fp": F.sum("n").over(w)}).join(F.broadcast(told))  # one row, of a few numbers a partition
    return c.select(F.col("score").alias("threshold"), (F.col("_tp") + before("_p")).alias("tp"), (F.col("_fp") + before("_n")).alias("fp"), "p", "n", "positives", "negatives")


def roc(rows: DataFrame) -> DataFrame:
    c = curve(rows)
    return c.select("threshold", F.try_divide("fp", "negatives").alias("fpr"), F.try_divide("tp", "positives").alias("tpr"))


def precision_recall(rows: DataFrame) -> DataFrame:
    c = curve(rows)
    return c.select("threshold", F.try_divide("tp", "positives").alias("recall"), F.when(F.col("tp") + F.col("fp") == 0, 1.0).otherwise(F.col("tp") / (F.col("tp") + F.col("fp"))).alias("precision"))


def areas(rows: DataFrame, limit: float = 0.1) -> DataFrame:
    """One row: area under ROC, its part up to a false-positive rate, and step-wise average precision.

    The point before a threshold is that without the threshold's own cases, so every row stands for itself.
    """
    c = curve(rows).where("p > 0 or n > 0")
    x, y = F.try_divide("fp", "negatives"), F.try_divide("tp", "positives")
    x0, y0 = F.try_divide(F.col("fp") - F.col("n"), F.col("negatives")), F.try_divide(F.col("tp") - F.col("p"), F.col("positives"))
    r = c.select(x.alias("x"), y.alias("y"), x0.alias("x0"), y0.alias("y0"), (F.col("tp") / (F.col("tp") + F.col("fp"))).alias("precision"))
    top = F.least("x", F.lit(limit))
    y_top = F.col("y0") + (top - F.col("x0")) / (F.col("x") - F.col("x0")) * (F.col("y") - F.col("y0"))
    part = F.when((F.col("x0") >= limit) | (F.col("x") == F.col("x0")), 0.0).otherwise((top - F.col("x0")) * (F.col("y0") + y_top) / 2)
    return r.agg(
        F.sum((F.col("x") - F.col("x0")) * (F.col("y") + F.col("y0")) / 2).alias("area"), F.sum(part).alias("partial"),
        F.coalesce(F.sum(F.when(F.col("y") > F.col("y0"), (F.col("y") - F.col("y0")) * F.col("precision"))), F.lit(0.0)).alias("average_precision"),
    )


def reliability(rows: DataFrame, bins: int = 10) -> DataFrame:
    b = F.least(F.floor(F.col("score") * bins), F.lit(bins - 1)).cast("long")
    return rows.groupBy(b.alias("bin")).agg(F.count(F.lit(1)).alias("n"), F.avg("score").alias("mean_score"), F.avg(F.col("attack").cast("int")).alias("attack_rate"))


def calibration(rows: DataFrame, bins: int = 10) -> DataFrame:
    """One row: Brier score, log score, expected calibration error; merged from at most `bins` partial rows."""
    y = F.col("attack").cast("int")
    p = F.greatest(F.lit(EPSILON), F.least(F.lit(1 - EPSILON), F.col("score")))
    b = F.least(F.floor(F.col("score") * bins), F.lit(bins - 1))
    by = rows.groupBy(b.alias("bin")).agg(F.count(F.lit(1)).alias("n"), F.sum("score").alias("s"), F.sum(y).alias("y"), F.sum((F.col("score") - y) ** 2).alias("b"), F.sum(-(y * F.log(p) + (1 - y) * F.log(1 - p))).alias("l"))
    n = F.sum("n")
    return by.agg((F.sum("b") / n).alias("brier"), (F.sum("l") / n).alias("log_score"), (F.sum(F.abs(F.col("s") - F.col("y"))) / n).alias("ece"))


def strata(rows: DataFrame, fields: list[str], flag: str) -> DataFrame:
    """(field, value, n, hits, rate) for each field by itself, in one pass; null values are dropped."""
    each = F.array(*[F.struct(F.lit(f).alias("field"), F.col(f).cast("string").alias("value")) for f in fields])
    s = rows.select(F.explode(each).alias("s"), F.col(flag).alias("hit")).where("s.value is not null")
    g = s.groupBy("s.field", "s.value").agg(F.count(F.lit(1)).alias("n"), F.count_if("hit").alias("hits"))
    return g.withColumn("rate", F.col("hits") / F.col("n"))


def phi(fired: DataFrame, rails: list[str]) -> DataFrame:
    """(a, b, phi) for every pair of boolean columns: one aggregation, 0 where it is undefined."""
    pairs = [(a, b) for i, a in enumerate(rails) for b in rails[i + 1 :]]
    ones = {r: F.count_if(r).cast("double").alias(r) for r in rails}
    v = fired.agg(F.count(F.lit(1)).cast("double").alias("n"), *ones.values(), *[F.count_if(F.col(a) & F.col(b)).cast("double").alias(f"{a}|{b}") for a, b in pairs])

    def of(a: str, b: str) -> Column:
        n, x, y, xy = F.col("n"), F.col(a), F.col(b), F.col(f"{a}|{b}")
        return F.coalesce(F.try_divide(n * xy - x * y, F.sqrt(x * (n - x) * y * (n - y))), F.lit(0.0))

    items = F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), of(a, b).alias("phi")) for a, b in pairs])
    return v.select(F.explode(items).alias("x")).select("x.*")


def groups_by_phi(pairs: list[tuple[str, str, float]], rails: list[str], least: float = 0.6) -> dict[str, str]:
    """Union-find over at most a few dozen rails, on the driver."""
    up = {r: r for r in rails}

    def root(x: str) -> str:
        while up[x] != x:
            x = up[x]
        return x

    for a, b, p in pairs:
        if p >= least:
            a, b = sorted((root(a), root(b)))
            up[b] = a
    return {r: root(r) for r in rails}


def paired(left: DataFrame, right: DataFrame, key: str, value: str) -> DataFrame:
    """One row: n and mean difference right - left over equal keys; keys must match exactly (see unmatched)."""
    j = left.select(key, F.col(value).cast("double").alias("l")).join(right.select(key, F.col(value).cast("double").alias("r")), key)
    return j.agg(F.count(F.lit(1)).alias("n"), F.avg(F.col("r") - F.col("l")).alias("difference"))


def unmatched(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    return left.select(key).join(right, key, "left_anti").unionByName(right.select(key).join(left, key, "left_anti"))


def bootstrap(differences: list[float], seed: int = 1, rounds: int = 2000, level: float = 0.95) -> tuple[float, float]:
    """Percentile interval of the mean, resampled on the driver from one value per case."""
    import numpy as np

    d = np.array(differences, float)
    r = np.random.default_rng(seed)
    means = np.array([d[r.integers(0, len(d), len(d))].mean() for _ in range(rounds)])
    return tuple(np.quantile(means, [(1 - level) / 2, (1 + level) / 2]).tolist())
