"""Training of count models and deterministic splits."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T

ROLES = ["train"] * 5 + ["calibration", "threshold", "test"]


def features(text: Column) -> Column:
    """Distinct stems and pairs of neighbouring stems."""

    def of(s: Column) -> Column:
        pairs = F.zip_with(F.slice(s, 1, F.greatest(F.size(s) - 1, F.lit(0))), F.slice(s, 2, F.greatest(F.size(s) - 1, F.lit(0))), lambda a, b: F.concat(a, F.lit(" "), b))
        return F.array_distinct(F.concat(s, pairs))

    return T.let(F.transform(T.words(text), T.stem), of)


def bayes_counts(docs: DataFrame) -> DataFrame:
    """(feature, a, b, na, nb) from rows (text, attack): documents of each class that hold a feature."""
    n = docs.agg(F.count_if("attack").alias("na"), F.count_if(~F.col("attack")).alias("nb"))
    f = docs.select("attack", F.explode(features(F.col("text"))).alias("feature"))
    c = f.groupBy("feature").agg(F.count_if("attack").alias("a"), F.count_if(~F.col("attack")).alias("b"))
    return c.join(F.broadcast(n))  # one row of totals


def information(c: DataFrame) -> DataFrame:
    """bayes_counts with mi: mutual information of a feature's presence and the class."""
    t = F.col("na") + F.col("nb")

    def cell(x: Column, row: Column, col: Column) -> Column:
        return F.when((x > 0) & (row > 0) & (col > 0), x / t * F.log2(x * t / (row * col))).otherwise(0.0)

    present, a, b, na, nb = F.col("a") + F.col("b"), F.col("a"), F.col("b"), F.col("na"), F.col("nb")
    return c.withColumn("mi", cell(a, na, present) + cell(na - a, na, t - present) + cell(b, nb, present) + cell(nb - b, nb, t - present))


def bayes_weights(docs: DataFrame, most: int = 300, alpha: float = 1.0) -> DataFrame:
    """(feature, weight) of the most informative features; ties by feature."""
    top = information(bayes_counts(docs)).orderBy(F.desc(F.round("mi", 9)), "feature").limit(most)
    w = F.log2((F.col("a") + alpha) / (F.col("na") + 2 * alpha) / ((F.col("b") + alpha) / (F.col("nb") + 2 * alpha)))
    return top.select("feature", F.round(w, 4).alias("weight"))


def bayes_score(texts: DataFrame, weights: DataFrame, key: str) -> DataFrame:
    """(key, score): the highest clause sum of weights of its distinct features; a missing feature counts 0."""
    c = texts.select(key, F.posexplode(T.clauses(F.col("text"))).alias("k", "c")).select(key, "k", F.explode(features(F.col("c"))).alias("feature"))
    return c.join(weights, "feature").groupBy(key, "k").agg(F.sum("weight").alias("s")).groupBy(key).agg(F.max("s").alias("score"))


def grouped_split(cases: DataFrame, group: str, label: str, seed: str) -> DataFrame:
    """(group, labels, role): groups in hash order within their set of labels, dealt 5:1:1:1; a group has one role.

    Places come from counts by the hash's first byte and a window within each byte, so no task orders a whole stratum.
    Raises ValueError where a set of labels has fewer groups than a cycle of roles.
    """
    g = cases.where(F.col(group).isNotNull()).groupBy(group).agg(F.array_join(F.array_sort(F.collect_set(F.col(label).cast("string"))), "/").alias("labels"))
    g = g.withColumn("h", F.sha2(F.concat(F.lit(seed), F.lit("\0"), F.col(group).cast("string")).cast("binary"), 256)).withColumn("byte", F.substring("h", 1, 2))
    sizes = g.groupBy("labels", "byte").agg(F.count(F.lit(1)).alias("n"))  # at most 256 rows a set of labels
    few = [r.labels for r in sizes.groupBy("labels").agg(F.sum("n").alias("n")).where(F.col("n") < len(ROLES)).collect()]
    if few:
        raise ValueError(f"{few[0]} needs at least {len(ROLES)} groups to fill the roles")
    before = sizes.withColumn("before", F.sum("n").over(Window.partitionBy("labels").orderBy("byte")) - F.col("n")).drop("n")
    place = F.row_number().over(Window.partitionBy("labels", "byte").orderBy("h", group)) - 1
    d = g.join(before, ["labels", "byte"]).withColumn("place", place + F.col("before"))
    return d.select(group, "labels", F.get(T.strings(ROLES), F.pmod("place", F.lit(len(ROLES))).cast("int")).alias("role"))


def linear_features(text: Column, buckets: int, stride: int = 2, limit: int = 4000, most: int = 3) -> Column:
    """array<long> of feature buckets (one entry per counted occurrence): stems, pairs and character 4-grams of the first `limit` characters.

    An occurrence beyond `most` of the same feature does not count; the cut at `limit` is part of the model.
    """

    def counted(items: Column, start: int) -> Column:
        distinct = F.array_distinct(items)
        return F.flatten(F.transform(distinct, lambda x: F.array_repeat(T.fnv1a(x, buckets, start), F.least(F.lit(most), F.size(F.filter(items, lambda y: y == x))))))

    def of(body: Column) -> Column:
        stems = F.transform(F.filter(F.split(body, " "), lambda x: x != ""), T.stem)
        n = F.length(body)
        grams = F.when(n > 4, F.transform(F.sequence(F.lit(1), F.greatest(F.lit(1), n - 3), F.lit(stride)), lambda i: F.substring(body, i, F.lit(4)))).otherwise(F.array().cast("array<string>"))

        def parts(s: Column) -> Column:
            pairs = F.zip_with(F.slice(s, 1, F.greatest(F.size(s) - 1, F.lit(0))), F.slice(s, 2, F.greatest(F.size(s) - 1, F.lit(0))), lambda a, b: F.concat(a, F.lit(" "), b))
            return F.concat(counted(s, OFFSET), T.let(pairs, lambda p: counted(p, OFFSET)), T.let(grams, lambda g: counted(g, GRAM_OFFSET)))

        return T.let(stems, parts)

    return T.let(T.normalize(F.substring(text, 1, limit)), of)


OFFSET = 2166136261
#: FNV-1a state after the two bytes "c:", which mark character features.
GRAM_OFFSET = ((((OFFSET ^ 99) * 16777619) & 0xFFFFFFFF) ^ 58) * 16777619 & 0xFFFFFFFF
