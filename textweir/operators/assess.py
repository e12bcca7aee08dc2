"""Assessment of many texts: observations to posterior, and triage."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.stats import evidence


def weights(side: str, confidence: float | None = 0.95) -> list[tuple[str, str, float, float, float]]:
    """(rail, group, detection, bits if fired, bits if silent): at most 17 rows, computed on the driver."""
    return [(e.rail, e.group, e.detection, e.bits(True, confidence), e.bits(False, confidence)) for e in evidence(side).values()]


def posterior(observed: DataFrame, key: str, side: str, prior: float, confidence: float | None = 0.95, policy: tuple[float, float] = (0.5, 0.05)) -> DataFrame:
    """(key, bits, posterior, action) from rows (key, rail, fired); a null fired says nothing, unmeasured rails are dropped.

    Of a group of correlated rails one speaks: of those that fired the one with most bits, else the most sensitive.
    """
    table = observed.sparkSession.createDataFrame(weights(side, confidence), "rail string, grp string, detection double, yes double, no double")
    seen = observed.where("fired is not null").join(F.broadcast(table), "rail")  # a fixed table of at most 17 rows
    one = seen.groupBy(key, "grp").agg(F.max(F.when(F.col("fired"), F.struct("yes"))).alias("fired"), F.max_by("no", "detection").alias("silent"))
    bits = one.groupBy(key).agg(F.sum(F.coalesce("fired.yes", "silent")).alias("bits"))
    return bits.select(key, "bits", probability(F.col("bits"), prior).alias("posterior")).withColumn("action", action(F.col("posterior"), policy))


def row_bits(fired: dict[str, Column], side: str, confidence: float | None = 0.95) -> Column:
    """Bits of one row from what each rail says in it (null: nothing): the same as posterior() gives, without moving a row."""
    groups: dict[str, list[tuple[str, float, float, float]]] = {}
    for rail, group, detection, yes, no in weights(side, confidence):
        if rail in fired:
            groups.setdefault(group, []).append((rail, detection, yes, no))
    return sum((F.coalesce(group_bits(g, fired), F.lit(0.0)) for g in groups.values()), F.lit(0.0))


def group_bits(group: list[tuple[str, float, float, float]], fired: dict[str, Column]) -> Column:
    """Of those of a group that fired the one with most bits speaks, else the most sensitive of those that looked."""
    strongest = sorted(group, key=lambda g: -g[2])
    sensitive = sorted(group, key=lambda g: -g[1])
    return F.coalesce(*[F.when(fired[r], yes) for r, _, yes, _ in strongest], *[F.when(fired[r].isNotNull(), no) for r, _, _, no in sensitive])


def probability(bits: Column, prior: float) -> Column:
    odds = prior / (1 - prior) * F.pow(F.lit(2.0), bits)
    return F.when(odds == float("inf"), 1.0).otherwise(odds / (1 + odds))


def judged(rows: DataFrame, key: str, rails: list[str], side: str, prior: float, confidence: float | None = 0.95, policy: tuple[float, float] = (0.5, 0.05)) -> DataFrame:
    """(key, bits, posterior, action) of rows with a boolean column for each rail: a projection."""
    b = rows.select(key, row_bits({r: F.col(r) for r in rails}, side, confidence).alias("bits"))
    return b.withColumn("posterior", probability(F.col("bits"), prior)).withColumn("action", action(F.col("posterior"), policy))


def action(p: Column, policy: tuple[float, float]) -> Column:
    return F.when(p >= policy[0], "block").when(p >= policy[1], "review").otherwise("allow")


def triage(judged: DataFrame, key: str, policy: tuple[float, float] = (0.5, 0.05)) -> DataFrame:
    """A bucket and a place in it: dropped and review by posterior downwards, kept with the most doubtful last; ties by key.

    Places are counted by range partition, so no task holds a whole bucket.
    """
    b = F.when(F.col("posterior") >= policy[0], "dropped").when(F.col("posterior") >= policy[1], "review").otherwise("kept")
    sign = F.when(b == "kept", F.col("posterior")).otherwise(-F.col("posterior"))
    return ranked(judged.withColumn("bucket", b).withColumn("order", sign), ["bucket"], ["order", key], "place").drop("order")


def ranked(df: DataFrame, groups: list[str], order: list[str], name: str) -> DataFrame:
    """Rank from 1 within groups: range partitions, local places, and offsets by (partition, group)."""
    from pyspark.sql import Window as W

    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    r = df.repartitionByRange(n, *groups, *order).withColumn("_part", F.spark_partition_id())
    counts = r.groupBy("_part", *groups).count()  # one row for each partition and group in it
    before = counts.withColumn("_before", F.coalesce(F.sum("count").over(W.partitionBy(*groups).orderBy("_part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))).drop("count")
    local = r.withColumn("_at", F.row_number().over(W.partitionBy("_part", *groups).orderBy(*order)))
    return local.join(before, ["_part", *groups]).withColumn(name, F.col("_at") + F.col("_before")).drop("_part", "_at", "_before")
