"""Phrase collocations, mined level by level (Apriori), each language by itself.

Level k counts phrases of k words and keeps those of at least `least` occurrences. A phrase can only be
that frequent when both phrases of k - 1 words that overlap in it are, so the frequent phrases of
the level before go out to all tasks, and a task emits a phrase only where both are among them. What goes
out is a bit table of three hashes for each phrase: its size follows their number up to MAX_BLOCKS blocks
(32 MB), so the broadcast is bounded whatever the corpus holds. A false positive, or a table too full to
reject anything, costs counting and never a result, as each level's counts are exact and filtered again.

Counts are summed within chunks of texts before the shuffle, so a hot word or passage is a few rows a
task. Level tables are written in the shared folder; cuts are scored by joins between them.

A null text is an empty one, a null language is UNKNOWN; ids are not read, repeated rows count again. Extra
columns are not read. An empty table, or one without frequent words, gives no rows. A text is held whole in
a task, one at a time if it is long. Scores and comparisons are decimals, so they are exact at any count.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import shared

UNKNOWN = "und"
#: What ends a piece, and what else separates words.
BREAKS, BLANKS = b".,;:!?\n\x0b\x0c\r", b" \t"
SCALE = 2_000_000
#: Bytes of text that are counted together, and what stands between pieces meanwhile (no byte of UTF-8).
CHUNK, EDGE = 6 << 20, b"\xff"
BLOCK_BITS, BITS_EACH, MAX_BLOCKS = 1 << 16, 16, 1 << 12
_SPLIT = bytes.maketrans(BREAKS + BLANKS, b"\n" * len(BREAKS) + b" " * len(BLANKS))
_ODD = np.uint64(0x9E3779B97F4A7C15)


def tokens(texts: list[bytes]) -> np.ndarray:
    """Words in lower case (A-Z only), with EDGE between pieces and texts."""
    return np.array(b"\n".join(texts).lower().translate(_SPLIT).replace(b"\n", b" " + EDGE + b" ").split(), dtype=object)


def word_hashes(words: list[bytes], lang: str) -> np.ndarray:
    seed = zlib.crc32(lang.encode())
    return np.fromiter((xxhash.xxh3_64_intdigest(w, seed) for w in words), np.uint64, len(words))


def joined(h: np.ndarray, following: np.ndarray) -> np.ndarray:
    """Hash of a phrase and the word after it."""
    h = (h ^ (h >> np.uint64(31))) * _ODD + following
    return h ^ (h >> np.uint64(29))


class Table:
    """A bit table of phrase hashes in blocks of BLOCK_BITS; a hash names a block and three bits of it."""

    def __init__(self, blocks: int, bits: np.ndarray) -> None:
        self.blocks, self.bits = blocks, bits

    @staticmethod
    def places(h: np.ndarray, blocks: int) -> tuple[np.ndarray, list[np.ndarray]]:
        return (h >> np.uint64(48)).astype(np.int64) % blocks, [((h >> np.uint64(s)) & np.uint64(BLOCK_BITS - 1)).astype(np.int64) for s in (0, 16, 32)]

    def has(self, h: np.ndarray) -> np.ndarray:
        block, bits = self.places(h, self.blocks)
        out = np.ones(len(h), bool)
        for b in bits:
            out &= (self.bits[block * (BLOCK_BITS // 8) + (b >> 3)] >> (b & 7).astype(np.uint8) & 1).astype(bool)
        return out


def phrase_hash(lang: pd.Series, gram: pd.Series) -> np.ndarray:
    out = np.zeros(len(gram), np.uint64)
    for k, at in lang.groupby(lang).indices.items():
        parts = [g.encode().split(b" ") for g in gram.iloc[at]]
        h = word_hashes([w for p in parts for w in p], k).reshape(len(parts), -1)
        out[at] = h[:, 0]
        for j in range(1, h.shape[1]):
            out[at] = joined(out[at], h[:, j])
    return out


def table_of(level: DataFrame) -> Table:
    """The bit table of a level's phrases (lang, gram), all of one length; at most 32 MB, whatever their number."""
    blocks = max(1, min(MAX_BLOCKS, level.count() * BITS_EACH // BLOCK_BITS + 1))

    @F.pandas_udf("long")
    def hashed(lang: pd.Series, gram: pd.Series) -> pd.Series:
        return pd.Series(phrase_hash(lang, gram).view(np.int64))

    def filled(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        bits = np.zeros(BLOCK_BITS // 8, np.uint8)
        for b in Table.places(rows["h"].to_numpy().view(np.uint64), blocks)[1]:
            np.bitwise_or.at(bits, b >> 3, np.uint8(1) << (b & 7).astype(np.uint8))
        return pd.DataFrame({"block": [key[0]], "bits": [bits.tobytes()]})

    block = F.pmod(F.shiftrightunsigned("h", 48), F.lit(blocks)).alias("block")
    out = np.zeros(blocks * BLOCK_BITS // 8, np.uint8)
    for r in level.select(hashed("lang", "gram").alias("h")).select("h", block).groupBy("block").applyInPandas(filled, "block long, bits binary").toLocalIterator():
        out[r.block * (BLOCK_BITS // 8) : (r.block + 1) * (BLOCK_BITS // 8)] = np.frombuffer(r.bits, np.uint8)
    return Table(blocks, out)


def grams(texts: list[bytes], lang: str, k: int, before: list[Table]) -> tuple[pa.Array, np.ndarray]:
    """(phrases of k words, counts) of the texts; only those that `before`, tables of words and of k - 1 words, let pass.

    With k = 1 a null phrase carries the number of all words.
    """
    t, none = tokens(texts), (pa.array([], pa.string()), np.zeros(0, np.int64))
    if not len(t):
        return none
    code, words = pd.factorize(t)
    words = list(words)
    edge = words.index(EDGE) if EDGE in words else -1
    if k == 1:
        n = np.bincount(code, minlength=len(words))
        if edge >= 0:
            n[edge] = 0
        here = np.flatnonzero(n)
        return pa.array([None, *[words[i] for i in here]], pa.binary()).cast(pa.string()), np.concatenate([[n.sum()], n[here]])
    h = word_hashes(words, lang)
    ok = before[0].has(h)
    if edge >= 0:
        ok[edge] = False
    ok, h = ok[code], h[code]
    full = len(code) - k + 1
    if full <= 0:
        return none
    at = np.flatnonzero(np.logical_and.reduce([ok[j : j + full] for j in range(k)]))
    if k > 2:
        for first in (0, 1):
            run = h[at + first]
            for j in range(1, k - 1):
                run = joined(run, h[at + first + j])
            at = at[before[1].has(run)]
    rank, parts = code[at].astype(np.int64), np.arange(len(words))[:, None]
    for j in range(1, k):
        rank, key = pd.factorize(rank * len(words) + code[at + j])
        parts = np.column_stack([parts[key // len(words)], key % len(words)])
    if not len(at):
        return none
    if edge >= 0:
        words[edge] = b""  # in no phrase, and no text
    said = pa.array(words, pa.binary()).cast(pa.string())
    return pc.binary_join_element_wise(*[said.take(pa.array(parts[:, j])) for j in range(k)], " "), np.bincount(rank)


def counted(docs: DataFrame, k: int, before: list[Table]) -> DataFrame:
    """lang, gram, f of all phrases of k words that may be frequent; docs has lang and text, without nulls."""
    shared.small_batches(docs.sparkSession)
    sent = docs.sparkSession.sparkContext.broadcast(before)  # bounded: see table_of

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, list[bytes]] = {}
        size = 0

        def counts() -> Iterator[pa.RecordBatch]:
            for lang, texts in held.items():
                said, n = grams(texts, lang, k, sent.value)
                for i in range(0, len(said), 100_000):
                    part = said.slice(i, 100_000)
                    yield pa.record_batch([pa.array([lang] * len(part), pa.string()), part, pa.array(n[i : i + 100_000], pa.int64())], ["lang", "gram", "f"])
            held.clear()

        for b in batches:
            for lang, text in zip(b.column(0).to_pylist(), b.column(1).cast(pa.binary()).to_pylist(), strict=True):
                held.setdefault(lang, []).append(text)
                size += len(text)
                if size >= CHUNK:
                    yield from counts()
                    size = 0
        yield from counts()

    return docs.mapInArrow(scan, "lang string, gram string, f long").groupBy("lang", "gram").agg(F.sum("f").alias("f"))


def levels(docs: DataFrame, least: int = 30, longest: int = 4) -> tuple[DataFrame, DataFrame]:
    """(frequent, totals): lang, gram, k, f of every phrase of up to `longest` words and `least` occurrences; lang, n of all words."""
    read = docs.select(F.coalesce(F.col("lang").cast("string"), F.lit(UNKNOWN)).alias("lang"), F.coalesce("text", F.lit("")).alias("text"))
    first = shared.written(counted(read, 1, []).where((F.col("f") >= least) | F.col("gram").isNull()), "words")
    totals = first.where("gram is null").select("lang", F.col("f").alias("n"))
    made = [first.where("gram is not null")]
    tables = [table_of(made[0])]
    for k in range(2, longest + 1):
        level = shared.written(counted(read, k, tables).where(F.col("f") >= least), f"phrases{k}")
        made.append(level)
        if k < longest:
            tables = [tables[0], table_of(level)]
    out = None
    for k, level in enumerate(made, 1):
        part = level.select("lang", "gram", F.lit(k).alias("k"), "f")
        out = part if out is None else out.unionByName(part)
    return out, totals


def wide(x: Column) -> Column:
    return x.cast("decimal(20,0)")


def score(a: Column, l: Column, r: Column) -> Column:  # noqa: E741
    """floor(SCALE * a / (l + r)), exactly."""
    return F.call_function("div", F.lit(SCALE).cast("decimal(8,0)") * wide(a), wide(l) + wide(r))


def cuts(frequent: DataFrame) -> DataFrame:
    """lang, phrase, k, a, l, r, score: each phrase of two words or more at its lowest-scoring cut, of equal ones the first."""
    words = F.split("gram", " ")
    cand = frequent.where("k > 1").select("lang", F.col("gram").alias("phrase"), "k", F.col("f").alias("a"), words.alias("w"), F.explode(F.sequence(F.lit(1), F.col("k") - 1)).alias("cut"))
    cand = cand.select("lang", "phrase", "k", "a", "cut", F.array_join(F.slice("w", F.lit(1), F.col("cut")), " ").alias("left"), F.array_join(F.slice("w", F.col("cut") + 1, F.col("k") - F.col("cut")), " ").alias("right"))
    known = frequent.select("lang", "gram", "f")
    both = cand.join(known.select("lang", F.col("gram").alias("left"), F.col("f").alias("l")), ["lang", "left"]).join(known.select("lang", F.col("gram").alias("right"), F.col("f").alias("r")), ["lang", "right"])
    scored = both.withColumn("score", score(F.col("a"), F.col("l"), F.col("r")))
    best = F.min(F.struct("score", "cut", "l", "r"))
    return scored.groupBy("lang", "phrase", "k", "a").agg(best.alias("b")).select("lang", "phrase", "k", "a", "b.l", "b.r", "b.score")


def covered(frequent: DataFrame) -> DataFrame:
    """lang, phrase, longer: the largest count of a longer frequent phrase that holds the phrase's words in a row."""
    parts = F.flatten(F.transform(F.sequence(F.lit(2), F.col("k") - 1), lambda m: F.transform(F.sequence(F.lit(1), F.col("k") - m + 1), lambda i: F.array_join(F.slice("w", i, m), " "))))
    longer = frequent.where("k > 2").select("lang", "f", "k", F.split("gram", " ").alias("w"))
    return longer.select("lang", "f", F.explode(parts).alias("phrase")).groupBy("lang", "phrase").agg(F.max("f").alias("longer"))


def mine(docs: DataFrame, least: int = 30, longest: int = 4, cover: int = 80) -> tuple[DataFrame, DataFrame]:
    """(collocations, totals): lang, phrase, a, l, r, score, without phrases of which a longer one has `cover` per cent; lang, n."""
    frequent, totals = levels(docs, least, longest)
    inside = (wide(F.col("longer")) * 100 >= wide(F.col("a")) * cover)
    kept = cuts(frequent).join(covered(frequent), ["lang", "phrase"], "left").where(F.col("longer").isNull() | ~inside)
    return kept.drop("k", "longer"), totals


#: A language's candidates are ranked in so many parts first, so that the last ranking sees few rows.
PARTS = 32


def ranked(found: DataFrame, first: int) -> DataFrame:
    """The first rows of each language by score and count, highest first, then by phrase, with their rank."""
    order = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    part = F.pmod(F.xxhash64("phrase"), F.lit(PARTS))
    some = found.withColumn("rank", F.row_number().over(Window.partitionBy("lang", part).orderBy(*order))).where(F.col("rank") <= first)
    return some.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order)).cast("long")).where(F.col("rank") <= first)
