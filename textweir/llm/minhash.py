"""b-bit MinHash near-duplicate detection.

1. One pass over the texts: shingle hashes, `bands * rows` minima, band keys, and a packed
   signature that keeps only the low `bits` bits of each minimum. Rows get a number, and are written.
2. Rows with equal shingle sets form one class; only its first row goes on.
3. Rows that share a band key meet in a bucket. Each is paired with the bucket's leader (its first row, in
   one bucket of HASHED that of another order). Of the LEADERS that a row has in most bands, differing
   signature bits are counted and corrected for chance collisions (two different minima agree in their low
   bits with probability 2**-bits), and what is near the threshold is confirmed on full shingle sets. This
   is linear, and joins what is alike throughout.
4. What shares a bucket directly or over others is a group. Where a group holds several of the parts found
   so, pairs of rows of different parts are compared, block by block: by signature bits, and those near the
   threshold on full sets. Rows of the largest part meet those of the others only. A spanning forest of
   the confirmed links leaves a task, so output is linear in the documents.

No pair that shares a band is skipped: LEADERS only chooses which pairs come first. With 32 bands of
6 rows a pair at Jaccard 0.85 is missed with probability 3e-7, at 0.8 with 6e-5. The estimate's
standard error is under 0.04, and MARGIN is five of these. In a group of many parts, such as a large family
whose members are near the threshold to each other, step 4 is quadratic in the rows outside its largest part.

Nulls and ties: a null or wordless text has an empty set and links with nothing. Rows that repeat
a doc_id are documents of their own; near_duplicates() names components by the smallest doc_id, and where
one doc_id stands on different texts, these are one. There a row with a null doc_id links with nothing, has a null
component and is kept; distinct_rows() goes by rows alone. Extra columns are ignored, or carried along.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import bytehash as H
from .components import components
from .shared import by_class, partitions, small_batches, written

BLOCK, LEADERS, HASHED = 144, 2, 8
TURN = 0x25A5_A5A5_A5A5_A5A5  # turns the order of row numbers, so that some buckets choose other leaders
MARGIN = 0.19


def shingle_sets(col: pa.Array, width: int) -> list[np.ndarray]:
    """Sorted distinct hashes of each text's shingles; fewer words than width make one shingle."""
    data, off = H.text_bytes(col)
    w, first = H.word_hashes(data, off, H.SPACED)
    n = len(w)
    full = np.zeros(n, dtype=H.U)
    for k in range(width):
        full[: n - k if k else n] = full[: n - k if k else n] * H.U(0xD1342543DE82EF95) + w[k:]
    full = H.mix(full)
    out = []
    for a, b in zip(first[:-1].tolist(), first[1:].tolist(), strict=True):
        if b - a >= width:
            out.append(np.unique(full[a : b - width + 1]))
        elif b > a:
            h = b - a
            for x in w[a:b].tolist():
                h = (h * 0xD1342543DE82EF95 + x) & 0xFFFFFFFFFFFFFFFF
            out.append(H.mix(np.array([h], dtype=H.U)))
        else:
            out.append(np.zeros(0, dtype=H.U))
    return out


def minima(s: np.ndarray, k: int) -> np.ndarray:
    """The k smallest images, one for each of k hash functions."""
    a, c = H.stream(21, k).astype(np.uint32) | np.uint32(1), H.stream(22, k).astype(np.uint32)
    low, out = (s >> H.U(29)).astype(np.uint32), np.full(k, 0xFFFFFFFF, dtype=np.uint32)
    for at in range(0, len(s), 1024):
        x = low[None, at : at + 1024] * a[:, None]
        x ^= x >> np.uint32(15)
        x *= np.uint32(0x2C1B3C6D)
        x ^= c[:, None]
        np.minimum(out, x.min(axis=1), out=out)
    return out


def packed(m: np.ndarray, bits: int) -> bytes:
    return np.packbits((m[:, None] >> np.arange(bits, dtype=np.uint32)) & np.uint32(1)).tobytes()


def estimate(x: np.ndarray, y: np.ndarray, k: int, bits: int) -> np.ndarray:
    """Jaccard estimates of all rows of x against all of y; both are packed signatures as uint8 rows."""
    d = np.zeros((len(x), len(y)), dtype=np.uint16)
    per = 8 // bits
    low = np.uint8(sum(1 << (i * bits) for i in range(per)))
    for c in range(x.shape[1]):
        z = x[:, c, None] ^ y[None, :, c]
        any_bit = z.copy()
        for i in range(1, bits):
            any_bit |= z >> np.uint8(i)
        d += np.bitwise_count(any_bit & low)
    chance = 2.0**-bits
    return ((1 - d / k) - chance) / (1 - chance)


class Forest:
    """Union-find over positions."""

    def __init__(self, n: int) -> None:
        self.up = list(range(n))

    def root(self, x: int) -> int:
        while self.up[x] != x:
            self.up[x] = self.up[self.up[x]]
            x = self.up[x]
        return x

    def join(self, x: int, y: int) -> bool:
        x, y = self.root(x), self.root(y)
        if x == y:
            return False
        self.up[max(x, y)] = min(x, y)
        return True


def forest_edges(pairs: np.ndarray, ids: list, n: int) -> list[tuple]:
    f = Forest(n)
    return [(ids[a], ids[b]) for a, b in pairs.tolist() if f.join(a, b)]


def signatures(docs: DataFrame, width: int, bands: int, rows: int, bits: int) -> DataFrame:
    """(row, doc, text, n_shingles, set_a, set_b, keys, sig) of every row; doc holds its other columns."""
    k = bands * rows

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        salt = H.stream(23, bands)
        at = TaskContext.get().partitionId() << 36
        for b in H.slices(batches, "text"):
            out: list[tuple] = []
            for s in shingle_sets(b.column(1), width):
                if not len(s):
                    out.append((0, 0, 0, None, None))
                    continue
                m = minima(s, k)
                keys = np.zeros(bands, dtype=H.U)
                for r in m.reshape(bands, rows).T.astype(H.U):
                    keys = H.mix(keys * H.U(0x9FB21C651E98DF25) + r + salt)
                sig = np.frombuffer(packed(m, bits).ljust(-(-k * bits // 64) * 8, b"\0"), np.int64)
                out.append((len(s), int(np.add.reduce(s).view(np.int64)), int(np.bitwise_xor.reduce(H.mix(s + H.U(77))).view(np.int64)), keys.view(np.int64), sig))
            n, x, y, kk, sig = zip(*out, strict=True)
            row = np.arange(at, at + b.num_rows)
            at += b.num_rows
            yield pa.RecordBatch.from_arrays([pa.array(row), b.column(0), b.column(1), pa.array(n, pa.int64()), pa.array(x, pa.int64()), pa.array(y, pa.int64()), pa.array(kk, pa.list_(pa.int64())), pa.array(sig, pa.list_(pa.int64()))], ["row", "doc", "text", *SIGNED])

    doc = docs.select(F.struct(*[F.col(c) for c in docs.columns if c != "text"]).alias("doc"), "text")
    kind = T.StructType([T.StructField("row", T.LongType()), *doc.schema.fields]).add("n_shingles", "long").add("set_a", "long").add("set_b", "long").add("keys", T.ArrayType(T.LongType())).add("sig", T.ArrayType(T.LongType()))
    return doc.mapInArrow(run, kind)


SIGNED = ["n_shingles", "set_a", "set_b", "keys", "sig"]


def similarity(x: Column, y: Column, k: int, bits: int) -> Column:
    """estimate() of two packed signatures, as a column."""
    low = sum(1 << i for i in range(0, 64, bits))
    differ = F.lit(0)
    for w in range(-(-k * bits // 64)):
        z = x[w].bitwiseXOR(y[w])
        some = z
        for i in range(1, bits):
            some = some.bitwiseOR(F.shiftrightunsigned(z, i))
        differ = differ + F.bit_count(some.bitwiseAND(F.lit(low if low < 1 << 63 else low - (1 << 64))))
    chance = 2.0**-bits
    return (1 - differ / k - chance) / (1 - chance)


def with_leaders(reps: DataFrame, k: int, bits: int, floor: float) -> tuple[DataFrame, DataFrame]:
    """(pairs (a, node) to confirm first, links (a, b) of all that share a bucket)."""
    keyed = reps.select(F.explode("keys").alias("key"), "node")  # the band is mixed into its key
    turn = F.when(F.pmod("key", F.lit(HASHED)) == 0, F.lit(TURN)).otherwise(0)
    buckets = keyed.groupBy("key").agg(F.min(F.col("node").bitwiseXOR(turn)).bitwiseXOR(turn).alias("a"), F.count(F.lit(1)).alias("n")).where("n > 1").drop("n")
    met = keyed.join(buckets, "key").where("node <> a").groupBy("node", "a").agg(F.count(F.lit(1)).alias("n"))
    # at most one leader a band, so the list of a node is short; leaders of most bands first
    met = written(met.groupBy("node").agg(F.array_sort(F.collect_list(F.struct((-F.col("n")).alias("n"), "a"))).alias("met")), "met")
    sigs = reps.select("node", "sig")
    first = met.select("node", F.explode(F.slice("met.a", 1, LEADERS)).alias("a")).join(sigs, "node")
    first = first.join(sigs.select(F.col("node").alias("a"), F.col("sig").alias("lead")), "a").where(similarity(F.col("sig"), F.col("lead"), k, bits) >= floor)
    return written(first.select("a", "node"), "first"), met.select(F.col("node").alias("b"), F.explode("met.a").alias("a")).select("a", "b")


def starred(first: DataFrame, texts: DataFrame) -> DataFrame:
    """Blocks of rows with their leader, for paired(): the leader is block 0. Texts join once, for leaders and rows alike."""
    sizes = first.groupBy("a").agg(F.ceil(F.count(F.lit(1)) / BLOCK).cast("int").alias("nb"))
    lead = sizes.select("a", F.explode(F.sequence(F.lit(1), F.col("nb"))).alias("b2"), F.lit(0).alias("blk"), F.col("a").alias("node"))
    most = first.join(sizes, "a").withColumn("b2", (F.pmod(F.xxhash64("node"), F.col("nb")) + 1).cast("int")).select("a", "b2", F.col("b2").alias("blk"), "node")
    dealt = lead.unionByName(most).select(F.col("a").alias("component"), F.lit(0).alias("b1"), "b2", "blk", "node", F.col("node").alias("part"))
    return with_texts(dealt, texts)


def with_texts(dealt: DataFrame, texts: DataFrame) -> DataFrame:
    """dealt with the text of its nodes; merged by sorted node, since either side grows with the corpus."""
    return dealt.join(texts.hint("merge"), "node")


def unresolved(groups: DataFrame, parts: DataFrame) -> DataFrame | None:
    """(component, b1, b2, blk, node, part): the groups (component, node) of several parts (node, component), dealt to pairs of blocks.

    None if there are none. One row for each pair a node's block takes part in; blocks of a group's largest part do not meet each other.
    """
    g = written(groups.join(parts.select("node", F.col("component").alias("part")), "node", "left").select("component", "node", F.coalesce("part", "node").alias("part")), "parts")
    sizes = g.groupBy("component", "part").agg(F.count(F.lit(1)).alias("m")).groupBy("component").agg(F.max_by("part", F.struct("m", "part")).alias("main"), F.max("m").alias("m"), F.sum("m").alias("n"))
    sizes = written(sizes.where("m < n"), "unresolved")
    if sizes.isEmpty():
        return None
    g = g.join(sizes, "component")
    n_main, n_rest = F.ceil(F.col("m") / BLOCK).cast("int"), F.ceil((F.col("n") - F.col("m")) / BLOCK).cast("int")
    main, place = F.col("part") == F.col("main"), F.xxhash64("node")
    g = g.withColumn("blk", F.when(main, F.pmod(place, n_main)).otherwise(n_main + F.pmod(place, n_rest)).cast("int"))
    g = g.withColumn("other", F.explode(F.sequence(F.when(main, n_main).otherwise(0), n_main + n_rest - 1)))
    return g.select("component", F.least("blk", "other").alias("b1"), F.greatest("blk", "other").alias("b2"), "blk", "node", "part")


def paired(df: DataFrame, payload: str, compare, n: int) -> DataFrame:
    """Runs compare(lists of payload left, right, ok) on every pair of blocks; returns forest edges (a, b).

    ok says which pairs are in question: those of different parts.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        edges: list[tuple] = []
        for (_c, b1, b2), rows in grouped(batches, 3):
            blk, node, part, load = rows
            blk, part = np.array(blk), np.array(part)
            x = np.flatnonzero(blk == b1)
            y = x if b1 == b2 else np.flatnonzero(blk == b2)
            ok = part[x][:, None] != part[y][None, :]
            if b1 == b2:
                ok = np.triu(ok, 1)
            if ok.any():
                i, j = np.nonzero(compare([load[k] for k in x], [load[k] for k in y], ok))
                edges += forest_edges(np.stack([x[i], y[j]], axis=1), node, len(node))
            if len(edges) > 20000:
                yield edge_batch(edges)
                edges = []
        yield edge_batch(edges)

    return (
        df.select("component", "b1", "b2", "blk", "node", "part", payload)
        .repartition(n, "component", "b1", "b2")
        .sortWithinPartitions("component", "b1", "b2")
        .mapInArrow(run, "a long, b long")
    )


def edge_batch(edges: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([e[i] for e in edges], pa.int64()) for i in (0, 1)], ["a", "b"])


def grouped(batches: Iterator[pa.RecordBatch], keys: int) -> Iterator[tuple[tuple, list[list]]]:
    """Runs of equal leading columns of sorted batches, as (key, lists of the other columns)."""
    now, rows = None, []
    for b in batches:
        if not b.num_rows:
            continue
        k = list(zip(*(b.column(i).to_pylist() for i in range(keys)), strict=True))
        cols = [b.column(i).to_pylist() for i in range(keys, b.num_columns)]
        at = 0
        for i in range(1, len(k) + 1):
            if i == len(k) or k[i] != k[at]:
                if k[at] != now:
                    if now is not None:
                        yield now, rows
                    now, rows = k[at], [[] for _ in cols]
                for r, c in zip(rows, cols, strict=True):
                    r += c[at:i]
                at = i
    if now is not None:
        yield now, rows


def classes_of(full: DataFrame) -> DataFrame:
    """Rows of equal shingle sets: set_a, set_b, n_shingles, node (first row), n, and the smallest id of each."""
    return full.groupBy("set_a", "set_b", "n_shingles").agg(F.min("row").alias("node"), F.count(F.lit(1)).alias("n"), F.min("id").alias("id"))


def resolved(docs: DataFrame, by_id: bool, width: int, num: int, den: int, bands: int, rows: int, bits: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(all rows, those that can link with their id, their classes with component and the least id of it).

    The id is the doc_id if by_id, else doc_id and row number, so that ties are told apart.
    """
    spark = docs.sparkSession
    small_batches(spark)
    n, k = partitions(spark), bands * rows
    every = written(signatures(docs, width, bands, rows, bits), "signatures")
    ident = F.col("doc.doc_id") if by_id else F.struct(F.col("doc.doc_id").isNull().alias("none"), F.col("doc.doc_id").alias("doc_id"), F.col("row"))
    full = every.withColumn("id", ident).where("n_shingles > 0 and id is not null")
    classes = written(classes_of(full), "classes")
    reps = written(every.join(classes.select("node"), F.col("row") == F.col("node")).select("node", "keys", "sig"), "representatives")
    floor = num / den - MARGIN

    def by_sets(x: list[str], y: list[str], ok: np.ndarray) -> np.ndarray:
        i, j = ok.any(1), ok.any(0)
        left, right = (shingle_sets(pa.array([t for t, m in zip(z, k.tolist(), strict=True) if m], pa.string()), width) for z, k in ((x, i), (y, j)))
        ok[np.ix_(i, j)] &= confirmed(left, right, num, den)
        return ok

    def by_bits(x: list, y: list, ok: np.ndarray) -> np.ndarray:
        left, right = (np.array(z, np.int64).view(np.uint8).reshape(len(z), -1)[:, : -(-k * bits // 8)] for z in (x, y))
        return ok & (estimate(left, right, k, bits) >= floor)

    first, shared = with_leaders(reps, k, bits, floor)
    groups = components(shared)
    # only texts that share a bucket are compared; all texts are shuffled once for this, and none of the others again
    texts = written(every.select(F.col("row").alias("node"), "text").hint("merge").join(groups.select("node"), "node", "left_semi"), "texts")
    sure = written(paired(starred(first, texts), "text", by_sets, n), "sure")
    parts = components(sure)
    open_ = unresolved(groups, parts)
    near = open_ and written(paired(open_.join(reps.select("node", "sig"), "node"), "sig", by_bits, n), "near")
    if near and not near.isEmpty():
        spanned = near.unionByName(parts.select(F.col("component").alias("a"), F.col("node").alias("b")))
        more = paired(with_texts(unresolved(components(spanned), parts), texts), "text", by_sets, n)
        parts = components(sure.unionByName(more))
    if by_id:  # texts that share an id are one document's, so their classes are one component
        several = full.groupBy("id").agg(*[f(c).alias(f"{f.__name__}_{c}") for f in (F.min, F.max) for c in ("set_a", "set_b")])
        several = several.where("min_set_a <> max_set_a or min_set_b <> max_set_b").select("id")
        if not several.isEmpty():
            key = ["set_a", "set_b", "n_shingles"]
            ids = full.join(several, "id", "left_semi").select("id", *key).join(classes.select(*key, "node"), key)
            same = ids.join(ids.groupBy("id").agg(F.min("node").alias("a")), "id").select("a", F.col("node").alias("b"))
            parts = components(same.unionByName(parts.select(F.col("component").alias("a"), F.col("node").alias("b"))))
    of = classes.join(parts, "node", "left").withColumn("component", F.coalesce("component", "node"))
    least = of.groupBy("component").agg(F.min("id").alias("least"))
    of = written(of.join(least, "component"), "classes")
    return every, full, of


def near_duplicates(docs: DataFrame, width: int = 5, num: int = 80, den: int = 100, bands: int = 32, rows: int = 6, bits: int = 2) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) of every row; links need den * |A & B| >= num * |A | B|."""
    every, full, of = resolved(docs, True, width, num, den, bands, rows, bits)
    key = ["set_a", "set_b", "n_shingles"]
    linked = by_class(full.select("id", *key), of.select(*key, "least", "n"), key).select(F.col("id").alias("doc_id"), "n_shingles", F.col("least").alias("component_id"))
    rest = every.where("n_shingles = 0 or doc.doc_id is null").select("doc.doc_id", "n_shingles", F.col("doc.doc_id").alias("component_id"))
    return linked.unionByName(rest).withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))


def distinct_rows(docs: DataFrame, width: int = 5, num: int = 80, den: int = 100, bands: int = 32, rows: int = 6, bits: int = 2) -> DataFrame:
    """The rows, with all their columns, less near duplicates: of each component one row stays, that of the smallest doc_id.

    Null doc_ids come last and ties go by row, so one row stays where doc_ids are null or repeated too.
    """
    every, _, of = resolved(docs, False, width, num, den, bands, rows, bits)
    stay = of.select(F.col("least.row").alias("row")).distinct()
    kept = every.join(stay, "row", "left_semi").unionByName(every.where("n_shingles = 0"))
    return kept.select(*[F.col("text") if c == "text" else F.col("doc")[c].alias(c) for c in docs.columns])


def confirmed(x: list[np.ndarray], y: list[np.ndarray], num: int, den: int) -> np.ndarray:
    """Which of all pairs hold den * |intersection| >= num * |union|, on full sets, by a product of 0/1 matrices."""
    nx, ny = np.array([len(s) for s in x]), np.array([len(s) for s in y])
    inter = np.zeros((len(x), len(y)))
    allx, ally = np.concatenate(x), np.concatenate(y)
    common = np.intersect1d(allx, ally)
    px, py = np.searchsorted(common, allx), np.searchsorted(common, ally)
    rx, ry = np.repeat(np.arange(len(x)), nx), np.repeat(np.arange(len(y)), ny)
    if len(common):
        okx, oky = common[np.minimum(px, len(common) - 1)] == allx, common[np.minimum(py, len(common) - 1)] == ally
        px, rx, py, ry = px[okx], rx[okx], py[oky], ry[oky]
    for at in range(0, len(common), 8192):
        a, b = np.zeros((len(x), 8192), np.float32), np.zeros((len(y), 8192), np.float32)
        i, j = (px >= at) & (px < at + 8192), (py >= at) & (py < at + 8192)
        a[rx[i], px[i] - at] = 1
        b[ry[j], py[j] - at] = 1
        inter += a @ b.T
    return den * inter >= num * (nx[:, None] + ny[None, :] - inter)
