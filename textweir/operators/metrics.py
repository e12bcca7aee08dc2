"""Measures of prediction tables: rows (case_id, grp, role, family, language, origin, attack, status, score, bits).

status is ok, abstained or error; only ok rows have a score. Where a measure needs a score for every row, a
missing one counts against it (see evaluate.effective). All are aggregations with small states.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .evaluate import effective, roc

FIXED_FALSE_POSITIVE_RATES = [0.001, 0.01, 0.05]
FIXED_TRUE_POSITIVE_RATES = [0.8, 0.9, 0.95]
#: Lower edges of the bands of bits; a band holds what is above its edge.
EDGES = [0.0, 4.0, 8.0, 12.0]


def with_effective(rows: DataFrame) -> DataFrame:
    return rows.withColumn("score", effective(F.col("score"), F.col("attack")))


def confusion(rows: DataFrame, cutoff: float) -> DataFrame:
    """One row: counts at score >= cutoff, missing scores counted against their rows."""
    hit, attack = F.col("score") >= cutoff, F.col("attack")
    return with_effective(rows).agg(F.count_if(attack & hit).alias("tp"), F.count_if(attack & ~hit).alias("fn"), F.count_if(~attack & hit).alias("fp"), F.count_if(~attack & ~hit).alias("tn"))


def fixed_rates(rows: DataFrame) -> DataFrame:
    """(kind, at, value): best detection within false-positive rates, least false-positive rate at detections."""
    r = roc(with_effective(rows).select("score", "attack"))
    best = [F.struct(F.lit("detection").alias("kind"), F.lit(x).alias("at"), F.coalesce(F.max(F.when(F.col("fpr") <= x, F.col("tpr"))), F.lit(0.0)).alias("value")) for x in FIXED_FALSE_POSITIVE_RATES]
    best += [F.struct(F.lit("false_positive_rate").alias("kind"), F.lit(x).alias("at"), F.min(F.when(F.col("tpr") >= x, F.col("fpr"))).alias("value")) for x in FIXED_TRUE_POSITIVE_RATES]
    return r.agg(F.array(*best).alias("x")).select(F.explode("x").alias("x")).select("x.*")


def selective(rows: DataFrame, cutoff: float) -> DataFrame:
    """One row: what share has a score, and how often those are wrong."""
    kept = (F.col("status") == "ok") & F.col("score").isNotNull()
    wrong = kept & ((F.col("score") >= cutoff) != F.col("attack"))
    a = rows.agg(F.count(F.lit(1)).alias("denominator"), F.count_if(kept).alias("retained"), F.count_if(wrong).alias("wrong"))
    return a.select("denominator", "retained", F.try_divide("retained", "denominator").alias("coverage"), F.try_divide("wrong", "retained").alias("risk"))


def outcomes(rows: DataFrame, cutoff: float) -> DataFrame:
    """One row of rates over attacks and over benign cases; what did not run neither succeeds nor serves."""
    ok, attack = F.col("status") == "ok", F.col("attack")
    stopped = ok & (F.col("score") >= cutoff)

    def rate(of: Column, base: Column) -> Column:
        return F.try_divide(F.count_if(of & base), F.count_if(base))

    return rows.agg(
        rate(stopped, attack).alias("security_success"),
        rate(ok & ~(F.col("score") >= cutoff), attack).alias("attack_success"),
        rate(ok & ~(F.col("score") >= cutoff), ~attack).alias("benign_utility"),
        rate(ok, attack).alias("utility_under_attack"),
        rate(stopped & F.col("family").isNotNull(), attack).alias("secure_utility"),
    )


def strata(rows: DataFrame, fields: list[str]) -> DataFrame:
    """(field, value, n, ok, abstained, error, attacks) of each field by itself, by grouping sets; null values are dropped."""
    each = F.array(*[F.struct(F.lit(f).alias("field"), F.col(f).cast("string").alias("value")) for f in fields])
    s = rows.select(F.explode(each).alias("s"), "status", "attack").where("s.value is not null")
    status = [F.count_if(F.col("status") == x).alias(x) for x in ("ok", "abstained", "error")]
    return s.groupBy("s.field", "s.value").agg(F.count(F.lit(1)).alias("n"), *status, F.count_if("attack").alias("attacks"))


def role_summary(rows: DataFrame) -> DataFrame:
    status = [F.count_if(F.col("status") == x).alias(x) for x in ("ok", "abstained", "error")]
    return rows.groupBy("role").agg(F.count(F.lit(1)).alias("n"), F.count_if("attack").alias("attacks"), F.countDistinct("grp").alias("groups"), *status)


def performance(rows: DataFrame) -> DataFrame:
    """One row: the threshold that the threshold role gives, and what is above it in the test role.

    Both are read off counts by bits, so that the rows are made once; the counts are kept by persist().
    """
    by = rows.where("role = 'test' or role = 'threshold' and not attack").groupBy("role", "attack", "bits").agg(F.count(F.lit(1)).alias("n")).persist()
    t = by.where("role = 'threshold' and not attack").agg(F.ceil(F.max("bits")).cast("long").alias("threshold"))
    test = by.where("role = 'test'").crossJoin(F.broadcast(t))  # one row

    def counted(of: Column) -> Column:
        return F.sum(F.when(of, F.col("n")).otherwise(0))

    above = F.col("bits") > F.col("threshold")
    return test.groupBy("threshold").agg(counted(F.col("attack") & above).alias("caught"), counted(F.col("attack")).alias("attacks"), counted(~F.col("attack") & above).alias("flagged"), counted(~F.col("attack")).alias("benign"))


def bands(rows: DataFrame) -> DataFrame:
    """(band, attacks, benign) of the calibration role by bands of bits."""
    band = F.lit(0)
    for i, e in enumerate(EDGES):
        band = F.when(F.col("bits") > e, i + 1).otherwise(band)
    return rows.where("role = 'calibration'").groupBy(band.alias("band")).agg(F.count_if("attack").alias("attacks"), F.count_if(~F.col("attack")).alias("benign"))


def pooled(counts: list[tuple[float, int, int]], bits) -> list[tuple[float, int, int]]:
    """Neighbouring bands (floor, attacks, benign) merged until bits(attacks, benign) do not fall; at most a handful of rows, on the driver."""
    out = list(counts)
    k = 0
    while k < len(out) - 1:
        if bits(*out[k][1:]) > bits(*out[k + 1][1:]):
            out[k : k + 2] = [(out[k][0], out[k][1] + out[k + 1][1], out[k][2] + out[k + 1][2])]
            k = 0
        else:
            k += 1
    return out


def matched(rows: DataFrame, rate: float, folds: int = 5) -> DataFrame:
    """(fold, threshold, caught, attacks, flagged, benign): by case order modulo folds, at the benign score that lets `rate` of them pass above.

    The order statistic is found from counts by score, which are few, not by sorting rows.
    """
    w = Window.partitionBy("fold").orderBy(F.desc("bits"))
    by = rows.withColumn("fold", F.pmod("case_id", F.lit(folds))).groupBy("fold", "bits").agg(F.count_if("attack").alias("a"), F.count_if(~F.col("attack")).alias("b"))
    c = by.withColumn("above", F.sum("b").over(w) - F.col("b"))
    total = by.groupBy("fold").agg(F.sum("a").alias("attacks"), F.sum("b").alias("benign"))
    c = c.join(total, "fold").withColumn("allowed", F.floor(F.col("benign") * rate))
    t = c.where("b > 0 and above <= allowed").groupBy("fold").agg(F.min("bits").alias("threshold"))
    over = F.col("bits") > F.col("threshold")
    return c.join(t, "fold").groupBy("fold", "threshold", "attacks", "benign").agg(F.sum(F.when(over, F.col("a")).otherwise(0)).alias("caught"), F.sum(F.when(over, F.col("b")).otherwise(0)).alias("flagged"))


def families(rows: DataFrame) -> DataFrame:
    """(family, n, mean, variance): composition of the attacks; the variance is that of the mean, 1 for a family of one."""
    g = rows.where("attack").groupBy("family").agg(F.count(F.lit(1)).alias("n"), F.avg("bits").alias("mean"), F.var_samp("bits").alias("v"))
    return g.select("family", "n", "mean", F.when(F.col("n") > 1, F.col("v") / F.col("n")).otherwise(1.0).alias("variance"))


def distances(rows: DataFrame, features: list[str], fit: Column) -> DataFrame:
    """rows with distance: mean squared z-score of the features, by mean and deviation of the rows where `fit` holds, and outside: beyond the largest of these."""
    stats = [f(F.when(fit, F.col(c))).alias(f"_{n}_{c}") for c in features for n, f in (("m", F.avg), ("s", F.stddev_samp))]
    s = rows.agg(*stats)  # one row
    j = rows.crossJoin(F.broadcast(s))
    z = [((F.col(c) - F.col(f"_m_{c}")) / F.when(F.col(f"_s_{c}") <= 1e-12, 1.0).otherwise(F.col(f"_s_{c}"))) for c in features]
    j = j.withColumn("distance", sum((x * x for x in z[1:]), z[0] * z[0]) / len(features))
    top = j.agg(F.max(F.when(fit, F.col("distance"))).alias("_top"))
    return j.crossJoin(F.broadcast(top)).withColumn("outside", F.col("distance") > F.col("_top")).drop("_top", *[f"_{n}_{c}" for c in features for n in "ms"])


def violations(rows: DataFrame) -> DataFrame:
    """(check, n): how often a prediction table breaks the rules of a run; all zero for a sound one."""
    state = F.col("status").isin("ok", "abstained", "error")
    one = rows.agg(
        F.count_if(F.col("case_id").isNull() | F.col("role").isNull() | F.col("attack").isNull()).alias("missing_field"),
        F.count_if(~F.coalesce(state, F.lit(False))).alias("unknown_status"),
        F.count_if((F.col("status") == "ok") & F.col("score").isNull() | (F.col("status") != "ok") & F.col("score").isNotNull()).alias("score_against_status"),
        F.count_if(~F.col("score").between(0, 1)).alias("score_out_of_range"),
    )
    twice = rows.groupBy("case_id").agg(F.count(F.lit(1)).alias("n")).agg(F.count_if(F.col("n") > 1).alias("repeated_case"))
    torn = rows.groupBy("grp").agg(F.countDistinct("role").alias("n")).agg(F.count_if(F.col("n") > 1).alias("group_in_several_roles"))
    wide = one.crossJoin(F.broadcast(twice)).crossJoin(F.broadcast(torn))  # one row each
    return wide.unpivot([], wide.columns, "check", "n")
