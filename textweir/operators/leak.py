"""Answers that repeat protected text: sentences made largely of a protected sentence's character n-grams are redacted.

The score of a sentence is the largest share of its n-grams that one protected sentence holds. From `close` on it is a leak; from `loose`
on only where it says whose words it repeats. Sentences under FLOOR characters are no evidence on either side.

prompt_leak() is a rail over a few protected texts, which are constants of the plan. leaks() is a set-similarity join with a table
of any size, by pairs of blocks.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import splice
from ..functions import text as T
from ..functions import values as V
from . import rails as R

FLOOR, CLOSE, LOOSE = 40, 0.7, 0.4
#: Sentences of a block; an n-gram that more than COMMON protected sentences of a block hold is kept as a row of bits.
BLOCK, COMMON = 4096, 1024


def sentences(text: Column, floor: int = FLOOR) -> Column:
    return F.filter(T.clauses(text), lambda c: F.length(c) >= floor)


def least(sentence: Column, close: float = CLOSE, loose: float = LOOSE) -> Column:
    """The score from which a sentence is a leak."""
    return F.when(sentence.rlike(V.OWN_INSTRUCTIONS), loose).otherwise(close)


def redacted(text: Column, leaked: Column, placeholder: str = V.LEAK_PLACEHOLDER) -> Column:
    """text with the first occurrence of each leaked sentence, in order, replaced."""
    return F.aggregate(leaked, text, lambda t, s: splice.replace_first(t, s, F.lit(placeholder)))


def prompt_leak(protected: list[str], close: float = CLOSE, loose: float = LOOSE, floor: int = FLOOR) -> R.Rail:
    """Redacts sentences that repeat one of the protected texts' sentences."""
    known = [R.driver_shingles(c) for t in protected for c in R.driver_clauses(t) if len(c) >= floor]
    if not known:
        raise ValueError("a prompt_leak rail needs protected text")
    every = T.strings(sorted({g for k in known for g in k}))

    def leaks(s: Column) -> Column:
        def near(x: Column) -> Column:
            n = F.size(x["own"])
            return F.when(x["least"] * n <= F.size(x["common"]), F.greatest(*[F.size(F.array_intersect(T.strings(k), x["common"])) / n for k in known], F.lit(0.0)) >= x["least"]).otherwise(False)

        return T.let(T.shingles(s), lambda own: T.let(F.struct(own.alias("own"), F.array_intersect(own, every).alias("common"), least(s, close, loose).alias("least")), near))

    def decide(text: Column, _: dict) -> Column:
        found = F.filter(sentences(text, floor), leaks)
        return T.let(found, lambda x: R.rewritten(text, redacted(text, x), F.when(F.size(x) > 0, F.array(F.lit("system_prompt"))).otherwise(R.none())))

    return R.Rail("prompt_leak", decide, ("output",))


def gram_set(body: str, size: int = 4) -> set[str]:
    """text.shingles() of a normalised text."""
    return {body} if len(body) <= size else {body[i : i + size] for i in range(len(body) - size + 1)}


def shares(told: pa.Table, known: pa.Table) -> pa.Table:
    """sentence and score of the told sentences (sentence, body, least) that reach their least score with one of the known bodies."""
    out: list[tuple[str, float]] = []
    if told.num_columns and known.num_columns:  # a side without rows has no columns
        held: dict[str, list[int]] = {}
        for i, body in enumerate(known["body"].to_pylist()):
            for g in gram_set(body):
                held.setdefault(g, []).append(i)
        n = len(known)
        # n-grams that very many hold are rows of bits, the others lists of places
        rows = {g: np.bincount(v, minlength=n) for g, v in held.items() if len(v) > COMMON}
        places = {g: np.array(v) for g, v in held.items() if len(v) <= COMMON}
        none = np.zeros(0, int)
        for sentence, body, least_score in zip(*(told[k].to_pylist() for k in ("sentence", "body", "least")), strict=True):
            own = gram_set(body)
            if len(own & held.keys()) < least_score * len(own) - 1e-9:
                continue
            count = np.bincount(np.concatenate([none, *(places[g] for g in own if g in places)]), minlength=n)
            for g in own & rows.keys():
                count += rows[g]
            if (score := int(count.max()) / len(own)) >= least_score:
                out.append((sentence, score))
    return pa.table({"sentence": pa.array([s for s, _ in out], pa.string()), "score": pa.array([v for _, v in out], pa.float64())})


def leaks(answers: DataFrame, protected: DataFrame, keys: list[str], text: str = "text", close: float = CLOSE, loose: float = LOOSE, floor: int = FLOOR) -> DataFrame:
    """keys, k, sentence, score of the answers' sentences that leak; k is the place among the answer's sentences, from 0.

    Equal sentences are scored once. Blocks of them meet blocks of protected sentences: within a pair of blocks a
    sentence's n-grams are looked up in lists of the protected sentences that hold them, and no pair of sentences becomes a row.
    A task holds one pair of blocks at a time, whatever the size of the tables.
    """
    said = sentences(F.col(text), floor)
    own = protected.select(F.explode(F.array_distinct(said)).alias("p")).distinct().select(T.normalize(F.col("p")).alias("body"))
    most = answers.agg(F.sum(F.greatest(F.size(said), F.lit(0)))).first()[0] or 0  # equal ones counted each
    na, nb = max(1, math.ceil(most / BLOCK)), max(1, math.ceil(own.count() / BLOCK))
    told = answers.select(*keys, F.posexplode(said).alias("k", "sentence"))
    s = told.select("sentence").distinct().select("sentence", T.normalize(F.col("sentence")).alias("body"), least(F.col("sentence"), close, loose).alias("least"))

    def every(n: int) -> Column:
        return F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n - 1).cast("long")))

    a = s.select("sentence", "body", "least", F.pmod(F.xxhash64("sentence", F.lit(1)), F.lit(na)).alias("a"), every(nb).alias("b"))
    b = own.select("body", F.pmod(F.xxhash64("body", F.lit(1)), F.lit(nb)).alias("b"), every(na).alias("a"))
    scored = a.groupBy("a", "b").cogroup(b.groupBy("a", "b")).applyInArrow(shares, "sentence string, score double")
    best = scored.groupBy("sentence").agg(F.max("score").alias("score"))
    return told.join(best, "sentence").select(*keys, "k", "sentence", "score")


def redact(answers: DataFrame, protected: DataFrame, keys: list[str], text: str = "text", **limits: float) -> DataFrame:
    """answers with text redacted and leaked, the number of leaking sentences; keys name the rows, without repeats."""
    found = leaks(answers, protected, keys, text, **limits).groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("k", "sentence"))).alias("_l"))
    same = answers.join(found, keys, "left")
    return same.withColumn("leaked", F.coalesce(F.size("_l"), F.lit(0))).withColumn(text, F.when(F.col("_l").isNotNull(), redacted(F.col(text), F.transform("_l", lambda x: x["sentence"]))).otherwise(F.col(text))).drop("_l")
