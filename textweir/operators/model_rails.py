"""Rails that need a model's numbers: nearness to known attacks by embeddings, and improbable spans by token log-probabilities.

The numbers come as tables, from whatever made them. Where they are missing nothing was looked at: such rows pass, never certain.
Verdicts are (key, status, certain, score); a row that blocks is certain.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T
from . import nearness

#: Least characters of a clause, clauses of a text that are embedded, cosine that blocks.
CLAUSE, CLAUSES, NEAR = 24, 64, 0.75
#: Tokens of a window, least tokens of a text, nats a token that block.
WINDOW, TOKENS, NATS = 16, 8, 7.0
#: A word that is at least this part of all words is looked up where its text is, so there are at most so many of these; others meet their counts by a join.
FREQUENT = 1 << 18


def to_embed(texts: DataFrame, key: str, text: str = "text", least: int = CLAUSE, most: int = CLAUSES) -> DataFrame:
    """(key, k, clause, dropped): the longest clauses of each text, longest first, and how many shorter ones are left out."""
    long = F.filter(T.clauses(F.col(text)), lambda c: F.length(c) >= least)
    t = texts.select(key, long.alias("c"))
    return t.select(key, F.posexplode(T.longest(F.col("c"), most)).alias("k", "clause"), F.greatest(F.size("c") - most, F.lit(0)).alias("dropped"))


def usable(v: Column, size: int) -> Column:
    """A vector of the right size with finite components and a norm."""
    norm = F.aggregate(v, F.lit(0.0), lambda s, x: s + x * x)
    return F.coalesce((F.size(v) == size) & (norm > 0) & (norm < float("inf")), F.lit(False))


def near_seeds(vectors: DataFrame, seeds: DataFrame, key: str) -> DataFrame:
    """(key, score) of vectors (key long, vector): the highest cosine with a seed; null for one that is not usable. Raises ValueError unless there are seeds, of one size."""
    sizes = [r[0] for r in seeds.select(F.size("vector").alias("n")).distinct().limit(2).collect()]
    if len(sizes) != 1 or sizes[0] is None:
        raise ValueError("needs seeds of one size")
    v = vectors.select(F.col(key).alias("id"), F.col("vector").alias("v"))
    known = seeds.select(F.lit(None).cast("long").alias("id"), F.col("vector").alias("v"))
    ok = usable(F.col("v").cast("array<double>"), sizes[0])
    return nearness.best(v.where(ok & F.col("id").isNotNull()), known).select(F.col("id").alias(key), F.col("best").alias("score"))


def semantic(texts: DataFrame, asked: DataFrame, vectors: DataFrame, seeds: DataFrame, key: str, threshold: float = NEAR) -> DataFrame:
    """A verdict for each key of texts: asked as of to_embed(), vectors (key, k, vector) of its clauses, seeds (vector) of known attacks.

    Raises ValueError unless there are seeds, of one size.
    """
    placed = vectors.withColumn("_at", F.xxhash64(key, "k", "vector").bitwiseAND(F.lit((1 << 63) - 1)))  # by key and vector: equal ones have equal scores
    scores = placed.select(key, "k", "_at").join(near_seeds(placed, seeds, "_at"), "_at")
    return judged(texts, asked.select(key, "k", "dropped").join(scores, [key, "k"], "left"), key, threshold)


def judged(texts: DataFrame, each: DataFrame, key: str, threshold: float = NEAR) -> DataFrame:
    """A verdict for each key of texts from its clauses (key, dropped, score).

    Blocked where a clause is at least that near to a seed. Not certain where a clause has no usable vector or shorter clauses were left out; a text
    without clauses passes.
    """
    per = each.groupBy(key).agg(F.max("score").alias("score"), F.count_if(F.col("score").isNull()).alias("lost"), F.max("dropped").alias("dropped"))
    j = texts.select(key).join(per, key, "left")
    hit = F.coalesce(F.col("score") >= threshold, F.lit(False))
    sure = hit | (F.coalesce("lost", F.lit(0)) + F.coalesce("dropped", F.lit(0)) == 0)
    return j.select(key, F.when(hit, "blocked").otherwise("passed").alias("status"), sure.alias("certain"), "score")


def perplexity(texts: DataFrame, tokens: DataFrame, key: str, threshold: float = NATS, window: int = WINDOW, least: int = TOKENS) -> DataFrame:
    """A verdict for each key of texts from tokens (key, pos, logprob): blocked where the mean of a window of tokens is that improbable.

    A text shorter than a window is one; one under `least` tokens passes. A text without tokens, or with a token that has no
    number, was not looked at.
    """
    w = Window.partitionBy(key).orderBy("pos").rowsBetween(0, window - 1)
    n = F.count(F.lit(1)).over(Window.partitionBy(key))
    t = tokens.select(key, (-F.avg("logprob").over(w)).alias("mean"), F.count(F.lit(1)).over(w).alias("here"), n.alias("n"), F.col("logprob").isNull().alias("lost"))
    whole = F.col("here") == F.least(F.col("n"), F.lit(window))
    per = t.groupBy(key).agg(F.max(F.when(whole & (F.col("n") >= least), F.col("mean"))).alias("score"), F.max("lost").alias("lost"))
    j = texts.select(key).join(per, key, "left")
    sure = F.coalesce(~F.col("lost"), F.lit(False))
    hit = sure & F.coalesce(F.col("score") >= threshold, F.lit(False))
    return j.select(key, F.when(hit, "blocked").otherwise("passed").alias("status"), sure.alias("certain"), F.when(sure, F.col("score")).alias("score"))


def improbable(texts: DataFrame, key: str, text: str = "text", threshold: float = NATS, window: int = WINDOW, least: int = TOKENS) -> DataFrame:
    """perplexity() of normalised texts, the log-probability of a word being that of its share of all words; a row is read twice and its words never sorted.

    Words become numbers in their row. Only the distinct rare words of a row leave it, to meet their counts, and come back
    to it by key. Rows of one key are one text, of words by place; a row without key has no score. Counts are kept by persist().
    """
    spark = texts.sparkSession
    t = texts.select(F.col(key).alias("key"), T.normalize(F.col(text)).alias("said"))
    counts = t.select("said").mapInArrow(tallied, "w string, n long").groupBy("w").agg(F.sum("n").alias("n")).persist()
    total = counts.agg(F.sum("n")).first()[0] or 0
    often = counts.where(F.col("n") * FREQUENT >= total).collect()  # at most FREQUENT rows
    known, logs = spark.sparkContext.broadcast({r.w: k for k, r in enumerate(often)}), spark.sparkContext.broadcast(np.log(np.array([r.n for r in often], float) / max(total, 1)))

    named, repeated = t.where("key is not null"), t.groupBy("key").count().where("key is not null and count > 1").select("key")
    some = repeated.limit(1).count() > 0
    if some:  # only then words move
        place = F.posexplode(F.filter(F.split("said", " "), lambda w: w != "")).alias("pos", "w")
        words = F.array_sort(F.collect_list(F.struct("pos", "w")))
        whole = named.join(repeated, "key", "left_semi").select("key", place).groupBy("key").agg(F.array_join(F.transform(words, lambda p: p["w"]), " ").alias("said"))
        named = named.join(repeated, "key", "left_anti").unionByName(repeated.join(whole, "key", "left").select("key", "said"))

    kind = t.schema["key"].dataType.simpleString()
    coded = named.mapInArrow(numbered(known), f"key {kind}, codes array<int>, rare array<string>")
    # a row's numbers travel with its rare words: in the row of none of them, under a name that is no word
    rows = coded.select("key", "codes", F.posexplode(F.concat(F.array(F.lit(None).cast("string")), "rare")).alias("at", "w"))
    rows = rows.select("key", "at", F.when(F.col("at") == 0, F.col("codes")).alias("codes"), F.coalesce("w", F.concat(F.lit(" "), F.col("key").cast("string"))).alias("w"))
    met = rows.join(counts.where(F.col("n") * FREQUENT < total), "w", "left")
    per = met.groupBy("key").agg(F.first("codes", ignorenulls=True).alias("codes"), F.array_sort(F.collect_list(F.when(F.col("at") > 0, F.struct("at", "n")))).alias("rare"))
    scored = per.select("key", "codes", F.transform("rare", lambda r: r["n"]).alias("rare")).mapInArrow(worst(logs, total, window, least), f"key {kind}, n int, score double")

    sure, hit = F.coalesce(F.col("n") > 0, F.lit(False)), F.coalesce(F.col("score") >= threshold, F.lit(False))
    out = scored.unionByName(t.where("key is null").select("key", F.lit(None).cast("int").alias("n"), F.lit(None).cast("double").alias("score")))
    if some:
        out = t.select("key").join(scored, "key", "left")
    return out.select(F.col("key").alias(key), F.when(hit, "blocked").otherwise("passed").alias("status"), sure.alias("certain"), "score")


def lists(values: np.ndarray, sizes: list[int]) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(sizes)]), pa.int32()), values)


#: Rows whose words are Python objects at once, and words that are counted before their counts are sent on.
STEP, TALLY = 256, 1 << 18


def tallied(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(w, n) of (said): how often words occur, of one word in as many rows as there are times that the counts were sent on."""

    def sent(seen: Counter) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(seen.keys(), pa.string()), pa.array(seen.values(), pa.int64())], ["w", "n"])

    seen: Counter = Counter()
    for b in batches:
        for said in b.column(0):
            if text := said.as_py():
                seen.update(text.split(" "))
            if len(seen) >= TALLY:
                yield sent(seen)
                seen = Counter()
    yield sent(seen)


def numbered(known) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """(key, codes, rare) of (key, said): a known word's number, or -1 less the place of a rare word among the row's rare ones."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        get = known.value.get
        for b in batches:
            for k in range(0, b.num_rows, STEP):
                part, codes, rare, sizes = b.slice(k, STEP), [], [], []
                for said in part.column(1):
                    own: dict[str, int] = {}
                    words = (said.as_py() or "").split(" ")
                    row = [*map(get, words)] if words[0] else []
                    for i in [i for i, c in enumerate(row) if c is None]:
                        row[i] = -1 - own.setdefault(words[i], len(own))
                    codes.append(np.array(row, np.int32))
                    rare += own
                    sizes.append(len(own))
                yield pa.RecordBatch.from_arrays([part.column(0), lists(pa.array(np.concatenate(codes)), [len(c) for c in codes]), lists(pa.array(rare, pa.string()), sizes)], ["key", "codes", "rare"])

    return run


def worst(logs, total: int, window: int, least: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """(key, n, score) of (key, codes, rare), rare being the counts of its rare words: the highest mean of a window, none under `least` words."""

    def score(codes: np.ndarray, rare: np.ndarray) -> float | None:
        n = len(codes)
        if n < least:
            return None
        x, other = np.empty(n), codes < 0
        x[~other] = logs.value[codes[~other]]
        x[other] = np.log(rare / total)[-1 - codes[other]]
        size = min(n, window)
        s = x[: n - size + 1].copy()
        for k in range(1, size):
            s += x[k : n - size + 1 + k]
        return float((-s / size).max())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out, sizes = [], []
            for c, r in zip(b.column(1), b.column(2), strict=True):
                codes = c.values.to_numpy(zero_copy_only=False)
                sizes.append(len(codes))
                out.append(score(codes, r.values.to_numpy(zero_copy_only=False).astype(float)))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(sizes, pa.int32()), pa.array(out, pa.float64())], ["key", "n", "score"])

    return run
