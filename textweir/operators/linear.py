"""A linear model over hashed n-grams: sparse vectors, AdaGrad, scores and a rail.

Vectors hold word stems, pairs of neighbouring stems and character n-grams, counted up to MOST times, by FNV-1a bucket.
Normal forms are built-in expressions; stems and buckets are counted in Arrow batches, a few rows at a time, by numpy over all of them.

Training runs AdaGrad over `shards` of the rows side by side and averages their weights after each epoch; with
one shard it is the plain loop. A shard's rows stream through a task in seeded order, as compressed vectors, and a model is one array
of `buckets` numbers, so memory does not grow with the rows.
"""

from __future__ import annotations

import functools
import itertools
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions.concepts import stem_word
from ..functions.language import Numbers
from . import rails as R
from .train import GRAM_OFFSET, OFFSET

PRIME, MASK = 16777619, 0xFFFFFFFF
#: Characters that the reference's own model reads, times that a feature counts, largest table.
LIMIT, MOST, BUCKETS, MAX_BUCKETS = 4000, 3, 1 << 18, 1 << 20
#: Rows of an Arrow batch that are Python objects at a time, and bytes of their texts; a batch holds up to 10,000 rows.
STEP, CHARS = 128, 1 << 19


@dataclass(frozen=True)
class Linear:
    """Weights by bucket (only those that are not 0), bias, table size, stride of character n-grams, threshold, characters read of a text (None: all)."""

    weights: dict[int, float]
    bias: float = 0.0
    buckets: int = BUCKETS
    stride: int = 2
    threshold: float = 0.0
    limit: int | None = None

    def __post_init__(self) -> None:
        if not 0 < self.buckets <= MAX_BUCKETS or not 0 < self.stride <= LIMIT:
            raise ValueError(f"buckets must lie in 1..{MAX_BUCKETS} and stride in 1..{LIMIT}")
        if any(not 0 <= i < self.buckets for i in self.weights):
            raise ValueError(f"a weight index is outside {self.buckets} buckets")


@functools.lru_cache(1 << 18)
def fnv(said: str, start: int) -> int:
    h = start
    for b in said.encode():
        h = ((h ^ b) * PRIME) & MASK
    return h


def vector(body: str, stems: list[str], buckets: int, stride: int) -> tuple[list[int], list[int]]:
    """(buckets, values) of a normalised text, in order of the buckets."""
    out: Counter[int] = Counter()
    for items, start in ((stems, OFFSET), ([f"{a} {b}" for a, b in zip(stems, stems[1:], strict=False)], OFFSET), ([body[i : i + 4] for i in range(0, len(body) - 3, stride)] if len(body) > 4 else [], GRAM_OFFSET)):
        for x, n in Counter(items).items():
            out[fnv(x, start) % buckets] += min(n, MOST)
    at = sorted(out)
    return at, [out[i] for i in at]


def words(text: Column, limit: int | None = None) -> Column:
    """A text normalised, or its first `limit` characters; its words are split and stemmed in Python."""
    return T.normalize(text if limit is None else F.substring(text, 1, limit))


stem_of = functools.lru_cache(1 << 18)(stem_word)


class Tokens:
    """Strings of a few texts as bytes: what each is, by number, where it starts and ends, and its FNV-1a state."""

    def __init__(self, said: list[str]):
        raw = [x.encode() for x in said]
        self.data = np.frombuffer(b"".join(raw), np.uint8)
        self.size = np.array([len(x) for x in raw], np.int64)
        self.start = np.cumsum(self.size) - self.size

    def hashed(self, h: np.ndarray, which: np.ndarray) -> np.ndarray:
        """The states h after the strings `which`, one byte of all strings at a time, longest first, so that short ones drop out."""
        size = self.size[which]
        o = np.argsort(-size, kind="stable")
        out, at, left = h[o], self.start[which[o]], -np.sort(-size)
        n = np.searchsorted(-left, -np.arange(int(left[0]) if len(left) else 0))  # strings longer than k bytes
        for k, m in enumerate(n.tolist()):
            out[:m] = step(out[:m], self.data[at[:m] + k])
        h = np.empty_like(out)
        h[o] = out
        return h


def step(h: np.ndarray, byte: np.ndarray | int) -> np.ndarray:
    return (h ^ byte) * np.uint32(PRIME)  # modulo 2 ** 32


def times(key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(distinct keys, how often each is there, up to MOST)."""
    key = np.sort(key)
    first = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]])) if len(key) else np.zeros(0, np.int64)
    return key[first], np.minimum(np.diff(np.append(first, len(key))), MOST)


def grams_of(bodies: list[str], stride: int) -> tuple[np.ndarray, np.ndarray, np.ndarray] | None:
    """(row, FNV-1a state, times) of the distinct character 4-grams of each text; None if the texts hold too many different characters."""
    points = np.frombuffer("".join(bodies).encode("utf-32-le", "surrogatepass"), np.uint32)
    size = np.array([len(x) for x in bodies], np.int64)
    there = np.zeros(0x110000, bool)
    there[points] = True
    alphabet = np.flatnonzero(there)
    bits = max(1, int(len(alphabet) - 1).bit_length()) if len(alphabet) else 1
    if 4 * bits + len(bodies).bit_length() > 63:
        return None
    n = np.where(size > 4, (size - 4) // stride + 1, 0)
    row = np.repeat(np.arange(len(bodies)), n)
    at = (np.cumsum(size) - size)[row] + (np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n)) * stride
    letter = np.zeros(0x110000, np.int64)
    letter[alphabet] = np.arange(len(alphabet))
    letter = letter[points]
    key = row
    for k in range(4):
        key = key << bits | letter[at + k]
    key, many = times(key)
    chars = Tokens([chr(x) for x in alphabet.tolist()])
    h = np.full(len(key), GRAM_OFFSET, np.uint32)
    for k in (3, 2, 1, 0):
        own = key >> bits * k & (1 << bits) - 1
        h = step(h, chars.data[chars.start[own]])
        for j in range(1, int(chars.size.max(initial=1))):
            more = np.flatnonzero(chars.size[own] > j)
            h[more] = step(h[more], chars.data[chars.start[own[more]] + j])
    return key >> 4 * bits, h, many


def counts(bodies: list[str], stems: list[list[str]] | None, buckets: int, stride: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """vector() of a few texts at once: (first place of each text and the end, buckets, values). Stems that are not given are made, of each word once."""
    said = [[w for w in b.split(" ") if w] for b in bodies] if stems is None else stems
    stem = stem_of if stems is None else str
    grams = grams_of(bodies, stride)
    if grams is None:
        each = [vector(b, [stem(w) for w in s], buckets, stride) for b, s in zip(bodies, said, strict=True)]
        return np.cumsum([0, *[len(at) for at, _ in each]]), *[np.array([x for e in each for x in e[k]], np.int64) for k in (0, 1)]
    seen, known = Numbers(), Numbers()
    word = np.fromiter(map(seen.__getitem__, itertools.chain.from_iterable(said)), np.int64)
    word = np.array([known[stem(w)] for w in seen], np.int64)[word]
    row = np.repeat(np.arange(len(said)), [len(s) for s in said])
    tokens, v = Tokens(list(known)), max(1, len(known))
    state = tokens.hashed(np.full(len(known), OFFSET, np.uint32), np.arange(len(known)))
    one, n1 = times(row * v + word)
    # of two neighbours: v is at most the words of a few texts, so a key of row and pair fits 63 bits
    own = np.flatnonzero(row[1:] == row[:-1])
    two, n2 = times((row[own] * v + word[own]) * v + word[own + 1])
    pair = tokens.hashed(step(state[two // v % v], 32), two % v)
    rows = np.concatenate([one // v, two // (v * v), grams[0]])
    h = np.concatenate([state[one % v], pair, grams[1]]).astype(np.int64)
    bit = MOST.bit_length()
    key = np.sort((rows * buckets + h % buckets) << bit | np.concatenate([n1, n2, grams[2]]))
    at, n = key >> bit, key & (1 << bit) - 1
    first = np.flatnonzero(np.concatenate([[True], at[1:] != at[:-1]])) if len(at) else np.zeros(0, np.int64)
    at, n = at[first], np.add.reduceat(n, first) if len(at) else n
    return np.searchsorted(at, np.arange(len(bodies) + 1) * buckets), at % buckets, n


def blocks(body: pa.Array, stems: pa.Array | None, buckets: int, stride: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """counts() of a batch's rows, at most STEP rows and, but for one long text, CHARS bytes at a time; a null text has no features."""
    size = np.cumsum(pc.fill_null(pc.binary_length(body), 0).to_numpy())
    k = 0
    while k < len(body):
        to = max(k + 1, min(k + STEP, int(np.searchsorted(size, (size[k - 1] if k else 0) + CHARS, "right"))))
        bodies = [b or "" for b in body.slice(k, to - k).to_pylist()]
        yield counts(bodies, None if stems is None else [s or [] for s in stems.slice(k, to - k).to_pylist()], buckets, stride)
        k = to


def stepwise(body: pa.Array, stems: pa.Array | None, buckets: int, stride: int) -> Iterator[list[tuple[list[int], list[int]]]]:
    """blocks() as lists."""
    for off, at, n in blocks(body, stems, buckets, stride):
        yield [(at[a:b].tolist(), n[a:b].tolist()) for a, b in zip(off[:-1], off[1:], strict=True)]


def vectors(text: Column, buckets: int = BUCKETS, stride: int = 2, limit: int | None = LIMIT) -> Column:
    """struct<at array<int>, n array<int>>: the sparse vector of a text; a null text has none. Its first `limit` characters are read, as by train.linear_features(), or all."""

    @F.arrow_udf("at array<int>, n array<int>")
    def counted(body: pa.Array) -> pa.Array:
        parts = [pa.StructArray.from_arrays([pa.ListArray.from_arrays(pa.array(off, pa.int32()), pa.array(x, pa.int32())) for x in (at, n)], ["at", "n"]) for off, at, n in blocks(body, None, buckets, stride)]
        return pa.concat_arrays(parts or [pa.array([], pa.struct([("at", pa.list_(pa.int32())), ("n", pa.list_(pa.int32()))]))])

    return counted(words(text, limit))


#: A packed vector: its length, then four planes of the steps between its buckets and two of its values, which compress well.
LENGTH = np.dtype("<u4")


def packed(at: np.ndarray, n: np.ndarray, codec: pa.Codec) -> bytes:
    steps = np.diff(at, prepend=0).astype("<u4").view(np.uint8).reshape(-1, 4).T
    return LENGTH.type(len(at)).tobytes() + codec.compress(steps.tobytes() + n.astype("<u2").view(np.uint8).reshape(-1, 2).T.tobytes(), asbytes=True)


def unpacked(block: bytes, codec: pa.Codec) -> tuple[np.ndarray, np.ndarray]:
    k = int(np.frombuffer(block, LENGTH, 1)[0])
    raw = np.frombuffer(codec.decompress(block[LENGTH.itemsize :], 6 * k, asbytes=True), np.uint8).reshape(6, k)
    return np.cumsum(raw[:4].T.copy().view("<u4").ravel(), dtype=np.int64), raw[4:].T.copy().view("<u2").ravel().astype(np.int64)


def counted(rows: DataFrame, text: str, buckets: int, stride: int, limit: int | None = None) -> DataFrame:
    """(key, attack, v) of rows (key, attack, text), v a packed vector; they leave tasks a few rows at a time, so that no batch of vectors is whole in Python."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = pa.Codec("zstd", compression_level=1)
        for b in batches:
            k = 0
            for off, at, n in blocks(b.column(2), None, buckets, stride):
                own = b.slice(k, len(off) - 1)
                k += len(off) - 1
                yield pa.RecordBatch.from_arrays([own.column(0), own.column(1), pa.array([packed(at[i:j], n[i:j], codec) for i, j in zip(off[:-1], off[1:], strict=True)], pa.binary())], ["key", "attack", "v"])

    given = rows.select("key", "attack", words(F.col(text), limit).alias("body"))
    return given.mapInArrow(run, f"key {given.schema['key'].dataType.simpleString()}, attack int, v binary")


def epoch(rows: DataFrame, w: np.ndarray, h: np.ndarray, bias: tuple[float, float], rate: float, l2: float, positive: float) -> DataFrame:
    """at, w, h of each shard after one pass over its rows (v, attack), in their order; at -1 is the bias."""
    sent = rows.sparkSession.sparkContext.broadcast((w, h, bias))  # two arrays of the table's size

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        w, h, (b, bh) = sent.value
        w, h, seen, codec = w.copy(), h.copy(), 0, pa.Codec("zstd", compression_level=1)
        for batch in batches:
            for block, attack in zip(batch.column(0), batch.column(1).to_pylist(), strict=True):
                i, v = unpacked(block.as_py(), codec)
                s = float(w[i] @ v) + b
                p = 0.0 if s < -30 else 1.0 if s > 30 else 1 / (1 + np.exp(-s))
                error = (p - attack) * (positive if attack else 1.0)
                g = error * v + l2 * w[i]
                h[i] += g * g
                w[i] -= rate * g / np.sqrt(h[i])
                bh += error * error
                b -= rate * error / np.sqrt(bh)
                seen += 1
        if seen:
            at = np.flatnonzero(w)
            for k in range(0, len(at), 50_000):
                part = at[k : k + 50_000]
                yield pa.record_batch([pa.array(part, pa.int32()), pa.array(w[part]), pa.array(h[part])], ["at", "w", "h"])
            yield pa.record_batch([pa.array([-1], pa.int32()), pa.array([b]), pa.array([bh])], ["at", "w", "h"])

    return rows.mapInArrow(run, "at int, w double, h double")


def fit(rows: DataFrame, key: str, text: str = "text", buckets: int = BUCKETS, stride: int = 2, epochs: int = 4, rate: float = 0.5, l2: float = 1e-6, shards: int | None = None, seed: int = 7, limit: int | None = None) -> Linear:
    """A model of rows (key, text, attack boolean), over whole texts unless there is a limit. Attacks weigh as much as the others together; the order is a hash of key, seed and epoch."""
    if not 0 < buckets <= MAX_BUCKETS:
        raise ValueError(f"buckets must lie in 1..{MAX_BUCKETS}")
    shards = shards or rows.sparkSession.sparkContext.defaultParallelism
    v = counted(rows.select(F.col(key).alias("key"), F.col("attack").cast("int").alias("attack"), F.col(text).alias("text")), "text", buckets, stride, limit).persist()
    try:
        n, attacks = v.agg(F.count(F.lit(1)), F.sum("attack")).first()
        if not attacks or attacks == n:
            raise ValueError("training needs both labels")
        w, h, bias = np.zeros(buckets), np.full(buckets, 1e-8), (0.0, 1e-8)
        for e in range(epochs):
            order = F.xxhash64(F.col("key").cast("string"), F.lit(seed), F.lit(e))
            dealt = v.withColumn("o", order).repartition(shards, F.pmod(F.xxhash64("o"), F.lit(shards))).sortWithinPartitions("o", "key").select("v", "attack")
            # a weight that a shard never met is still what it was, and each shard tells all that are not 0
            told = epoch(dealt, w, h, bias, rate, l2, (n - attacks) / attacks).groupBy("at").agg(F.sum("w").alias("w"), F.sum("h").alias("h"), F.count(F.lit(1)).alias("k")).toArrow()  # at most `buckets` rows
            at, ws, hs, ks = (told.column(c).to_numpy() for c in ("at", "w", "h", "k"))
            one = at < 0
            k = int(ks[one][0])
            bias = (float(ws[one][0]) / k, float(hs[one][0]) / k)
            i = at[~one]
            w[i], h[i] = ws[~one] / k, (hs[~one] + (k - ks[~one]) * h[i]) / k
    finally:
        v.unpersist()
    at = np.flatnonzero(w)
    return Linear(dict(zip(at.tolist(), w[at].tolist(), strict=True)), bias[0], buckets, stride, limit=limit)


def scored(model: Linear, text: Column) -> Column:
    """The log odds of a text: the weights come packed, as one array that every task receives once."""
    dense = np.zeros(model.buckets)
    dense[list(model.weights)] = list(model.weights.values())
    buckets, stride, bias = model.buckets, model.stride, model.bias

    @F.arrow_udf("double")
    def dot(body: pa.Array) -> pa.Array:
        out = [np.zeros(0)]
        for off, at, n in blocks(body, None, buckets, stride):
            out.append(np.bincount(np.repeat(np.arange(len(off) - 1), np.diff(off)), dense[at] * n, len(off) - 1) + bias)
        return pa.array(np.concatenate(out), pa.float64())

    return dot(words(text, model.limit))


def linear(model: Linear | None, threshold: float | None = None) -> R.Rail:
    """Blocks above the threshold. Without a model nothing was looked at: passes, never certain."""
    if model is None:
        return R.missing("linear")
    least = model.threshold if threshold is None else threshold

    def decide(text: Column, _: dict) -> Column:
        over = F.coalesce(scored(model, text) > least, F.lit(False))
        return R.verdict(F.when(over, "blocked").otherwise("passed"), text, F.when(over, F.array(F.lit("linear"))).otherwise(R.none()))

    return R.Rail("linear", decide, ("input", "context"))
