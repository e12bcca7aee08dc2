"""Near-duplicate vectors by a pivot-permutation index.

Vectors of a bounded sample that lie apart from each other are the pivots; their number grows with the
root of the number of vectors. Each vector is described by its NEAREST nearest pivots in order, and posted
to the inverted list of every two of them. Two vectors of a label that share at least two pivots so meet
in a list; the pair is looked at once, in the list of its two smallest shared pivots, and confirmed by
cosine in double precision. Equal vectors of a label are one class with a count. Lists of one vector go
no further; longer ones are cut into blocks of about BLOCK vectors, and each pair of blocks is one task's
work; what leaves it are counts and a spanning forest of links, linear in the vectors. No list is capped.

Pivots stand apart (cosine below APART), so a tight cluster has one pivot near it and one order of the
others, however many of its vectors the sample holds. Vectors without two pivots of their dimension share
one list, so none are lost. Work inside a cluster of near (not equal) vectors is quadratic, as its links are.

A vector that is null, zero or holds null or non-finite components, one without label, and one with a
null vec_id link with nothing. Rows that repeat a vec_id are vectors of their own. The component of a
null vec_id is null, and it is kept. Labels may be of any atomic type, components float or double.
Extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .components import components
from .shared import by_class, dropped, partitions, ungathered, written

NEAREST, BLOCK, APART, SMALL = 5, 1024, 0.8, 128
#: Pivots number about PER_ROOT times the root of the vectors, within these bounds; the sample is SAMPLE times as large.
PER_ROOT, FEWEST, MOST, SAMPLE = 4, 64, 4096, 4


def usable(v: str = "embedding") -> F.Column:
    """A vector that can have a cosine, with a label and an id; never null."""
    finite = F.forall(v, lambda x: F.coalesce(F.abs(x) < float("inf"), F.lit(False)) & ~F.isnan(x))
    nonzero = F.exists(v, lambda x: F.coalesce(x != 0, F.lit(False)))
    return F.coalesce(F.col(v).isNotNull() & finite & nonzero & F.col("label").isNotNull() & F.col("vec_id").isNotNull(), F.lit(False))


def unit(m: np.ndarray) -> np.ndarray:
    """Rows scaled to length 1 in double precision, safely for tiny and huge components."""
    m = m.astype(np.float64)
    m = m / np.abs(m).max(axis=1, keepdims=True)
    return m / np.sqrt((m * m).sum(axis=1, keepdims=True))


def nearest(v: np.ndarray, pivots: np.ndarray, k: int) -> np.ndarray:
    """(rows, k) nearest pivots of each vector, nearest first."""
    s = unit(v) @ pivots.T
    k = min(k, s.shape[1])
    top = np.argpartition(-s, k - 1, axis=1)[:, :k]
    return np.take_along_axis(top, np.argsort(-np.take_along_axis(s, top, 1), axis=1, kind="stable"), 1)


def apart(v: np.ndarray, n: int, most: float) -> np.ndarray:
    """The first n rows of which each has a cosine below `most` to those before it."""
    out = np.zeros((min(n, len(v)), v.shape[1]))
    k = 0
    for x in v:
        if k < n and (not k or (out[:k] @ x).max() < most):
            out[k] = x
            k += 1
    return out[:k]


def sample(classes: DataFrame, most: int, total: int) -> DataFrame:
    """The `most` of all `total` vectors with the smallest hashes, in their order.

    Every task of a sorted limit sends the driver that many rows, so only the hashes below a bound go into it. The
    bound is set for twice as many vectors as are needed; with fewer below it (far from what hashes give) all go in.
    """
    keyed = classes.select(F.xxhash64("embedding").alias("h"), "node", "embedding")
    if total > 2 * most:
        low = keyed.where(F.col("h") < int(-(2**63) + 2**64 * (2 * most / total)))
        if low.count() >= most:
            keyed = low
    return keyed.orderBy("h", "node").limit(most).select("embedding")


def choose(classes: DataFrame, n: int, total: int) -> dict[int, np.ndarray]:
    """At most n pivots by dimension, from the SAMPLE * n vectors with the smallest hashes (a bounded sample)."""
    flat, off = vectors_of(sample(classes, SAMPLE * n, total).toArrow().column(0).combine_chunks())
    size = np.diff(off)
    return {d: apart(unit(flat[off[:-1][size == d][:, None] + np.arange(d)]), n, APART) for d in np.unique(size).tolist()}


def vectors_of(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(components one after another, first component of each vector and the total)."""
    size = col.value_lengths().to_numpy(zero_copy_only=False)
    return col.flatten().to_numpy(zero_copy_only=False), np.concatenate([[0], np.cumsum(size)]).astype(np.int64)


def postings(classes: DataFrame, pivots: dict[int, np.ndarray], k: int) -> DataFrame:
    """(label, dim, node, near array<int>): each class's nearest pivots in order; empty where there are not two."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            flat, off = vectors_of(b.column(2))
            size = np.diff(off)
            near: list = [[]] * b.num_rows
            for d in np.unique(size).tolist():
                if len(pivots.get(d, ())) > 1:
                    rows = np.flatnonzero(size == d)
                    own = nearest(flat[off[rows][:, None] + np.arange(d)], pivots[d], k)
                    for i, x in zip(rows.tolist(), own.tolist(), strict=True):
                        near[i] = x
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(size.astype(np.int32)), b.column(1), pa.array(near, pa.list_(pa.int32()))], ["label", "dim", "node", "near"])

    return classes.select("label", "node", "embedding").mapInArrow(run, "label string, dim int, node long, near array<int>")


def listed(posted: DataFrame, block: int) -> DataFrame:
    """(label, dim, p, q, b1, b2, blk, node, near): postings to the lists of two pivots, dealt to pairs of blocks."""
    ordered = F.col("near")
    pairs = F.flatten(F.transform(ordered, lambda p: F.transform(F.filter(ordered, lambda q: q > p), lambda q: F.struct(p.alias("p"), q.alias("q")))))
    none = F.array(F.struct(F.lit(-1).alias("p"), F.lit(-1).alias("q")))
    lists = posted.withColumn("near", F.array_sort("near")).select("label", "dim", "node", "near", F.explode(F.when(F.size("near") > 1, pairs).otherwise(none)).alias("x")).select("label", "dim", "x.p", "x.q", "node", "near")
    sizes = lists.groupBy("label", "dim", "p", "q").agg(F.count(F.lit(1)).alias("n"))
    blocks = sizes.where("n > 1").withColumn("nb", F.ceil(F.col("n") / block).cast("int")).drop("n")
    lists = lists.join(ungathered(blocks), ["label", "dim", "p", "q"]).withColumn("blk", F.pmod(F.xxhash64("node"), F.col("nb")).cast("int"))
    lists = lists.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("nb") - 1)))
    return lists.select("label", "dim", "p", "q", F.least("blk", "other").alias("b1"), F.greatest("blk", "other").alias("b2"), "blk", "node", "near")


def owned(x: np.ndarray, y: np.ndarray, p: int, q: int) -> np.ndarray:
    """Pairs of pivot sets (ascending rows) whose two smallest shared pivots are p and q, both in all of them."""
    out = np.ones((len(x), len(y)), dtype=bool)
    for i in range(x.shape[1]):
        for j in range(y.shape[1]):
            smaller = (x[:, i] < q) & (x[:, i] != p)
            out &= ~(smaller[:, None] & (x[:, i, None] == y[None, :, j]))
    return out


def stars(ok: np.ndarray, same: bool) -> tuple[np.ndarray, np.ndarray]:
    """(first, other) places that span what ok links: rows are places 0.., columns those rows (same) or places after them."""
    n = len(ok)
    adjacent = ok if same else np.block([[np.zeros((n, n), dtype=bool), ok], [ok.T, np.zeros((ok.shape[1],) * 2, dtype=bool)]])
    open_ = adjacent.any(axis=1)
    first, other = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    for root in np.flatnonzero(open_).tolist():
        if not open_[root]:
            continue
        open_[root] = False
        front, found = np.array([root]), []
        while len(front):
            front = np.flatnonzero(adjacent[front].any(axis=0) & open_)
            open_[front] = False
            found.append(front)
        found = np.concatenate(found)
        first.append(np.full(len(found), root))
        other.append(found)
    return np.concatenate(first), np.concatenate(other)


def runs(batches: Iterator[pa.RecordBatch], keys: int) -> Iterator[tuple[tuple, pa.RecordBatch]]:
    """Runs of equal leading columns of sorted batches, as (key, the other columns)."""
    now, held = None, []

    def whole() -> pa.RecordBatch:
        return held[0] if len(held) == 1 else pa.Table.from_batches(held).combine_chunks().to_batches()[0]

    for b in batches:
        if not b.num_rows:
            continue
        k = list(zip(*(b.column(i).to_pylist() for i in range(keys)), strict=True))
        rest = b.select(list(range(keys, b.num_columns)))
        at = 0
        for i in range(1, len(k) + 1):
            if i == len(k) or k[i] != k[at]:
                if k[at] != now:
                    if held:
                        yield now, whole()
                    now, held = k[at], []
                held.append(rest.slice(at, i - at))
                at = i
    if held:
        yield now, whole()


def linked(lists: DataFrame, least: float, n: int) -> DataFrame:
    """Rows (a, b, c): a links c vectors of other classes (b null), or the links connect a and b (c null)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for (_label, dim, p, q, b1, b2), t in runs(batches, 6):
            blk, node, many = (t.column(k).to_numpy() for k in range(3))
            m = t.column(4).flatten().to_numpy(zero_copy_only=False).reshape(len(blk), dim)
            if len(blk) <= SMALL and b1 == b2 and not alike(m, least):
                continue
            near = t.column(3).flatten().to_numpy().reshape(len(blk), -1)
            x = np.flatnonzero(blk == b1)
            y = x if b1 == b2 else np.flatnonzero(blk == b2)
            if not len(x) or not len(y):
                continue
            if p < 0:
                ok = np.ones((len(x), len(y)), dtype=bool)
            else:  # equal pivot sets are looked at once
                sx, ix = np.unique(near[x], axis=0, return_inverse=True)
                sy, iy = np.unique(near[y], axis=0, return_inverse=True)
                mine = owned(sx, sy, p, q)
                x, ix, y, iy = x[r := mine.any(1)[ix]], ix[r], y[c := mine.any(0)[iy]], iy[c]
                if not len(x) or not len(y):
                    continue
                ok = mine[ix[:, None], iy[None, :]]
            ok &= unit(m[x]) @ unit(m[y]).T >= least
            if b1 == b2:
                ok &= node[x][:, None] != node[y][None, :]
                ok = square(ok, x, y, len(blk))
                x = y = np.arange(len(blk))
            count = [ok @ many[y]]
            if b1 != b2:
                count.append(many[x] @ ok)
            place = np.concatenate([x, y]) if b1 != b2 else x
            count = np.concatenate(count)
            first, other = stars(ok, b1 == b2)
            some = np.flatnonzero(count)
            a = np.concatenate([node[place[some]], node[place[first]]])
            b = np.concatenate([np.zeros(len(some), np.int64), node[place[other]]])
            c = np.concatenate([count[some], np.zeros(len(first), np.int64)])
            edge = np.arange(len(a)) >= len(some)
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64(), mask=~edge), pa.array(c, pa.int64(), mask=edge)], ["a", "b", "c"])

    keys = ["label", "dim", "p", "q", "b1", "b2"]
    return lists.select(*keys, "blk", "node", "n", "near", "embedding").repartition(n, *keys).sortWithinPartitions(*keys).mapInArrow(run, "a long, b long, c long")


def alike(m: np.ndarray, least: float) -> bool:
    """Whether any two of a few vectors may have a cosine of at least `least` (most short lists hold none)."""
    u = unit(m)
    return bool((np.tril(u @ u.T, -1) >= least).any())


def square(ok: np.ndarray, x: np.ndarray, y: np.ndarray, n: int) -> np.ndarray:
    """ok between rows x and y of one block, as a symmetric matrix over all n rows."""
    if len(x) == len(y) == n:
        return ok
    out = np.zeros((n, n), dtype=bool)
    out[x[:, None], y[None, :]] = ok
    return out


def near_duplicates(vectors: DataFrame, least: float = 0.98, pivots: int | None = None, near: int = NEAREST) -> DataFrame:
    """(vec_id, n_links, component_id, kept) of every row; pivots: how many at most, else by the number of vectors."""
    n = partitions(vectors.sparkSession)
    kind = "array<double>" if "double" in vectors.schema["embedding"].dataType.simpleString() else "array<float>"
    v = vectors.select("vec_id", F.col("label").cast("string").alias("label"), F.col("embedding").cast(kind).alias("embedding"))
    v = v.withColumn("ok", usable())
    key = [F.xxhash64(F.lit(1), "label", "embedding").alias("ka"), F.xxhash64(F.lit(2), "embedding", "label").alias("kb")]
    good = v.where("ok").select("vec_id", "label", "embedding", *key)
    classes = good.groupBy("ka", "kb").agg(F.min("vec_id").alias("smallest"), F.count(F.lit(1)).alias("n"), F.any_value("label").alias("label"), F.any_value("embedding").alias("embedding"))
    classes = written(classes.withColumn("node", F.monotonically_increasing_id()), "vectors")
    total = classes.count()
    if pivots is None:
        pivots = min(MOST, max(FEWEST, int(PER_ROOT * total**0.5)))
    posted = written(postings(classes, choose(classes, pivots, total), near), "postings")
    lists = listed(posted, BLOCK).join(ungathered(classes.select("node", "n", "embedding")), "node")
    found = written(linked(lists, least, n), "links")
    dropped(posted)
    links = found.where("b is null").groupBy(F.col("a").alias("node")).agg(F.sum("c").alias("c"))
    comp = components(found.where("b is not null").select("a", "b"))
    of = classes.select("ka", "kb", "node", "smallest", "n").join(ungathered(links), "node", "left").join(ungathered(comp), "node", "left")
    of = of.withColumn("component", F.coalesce("component", "node"))
    smallest = of.groupBy("component").agg(F.min("smallest").alias("component_id"))
    of = written(of.join(ungathered(smallest), "component").select("ka", "kb", (F.col("n") - 1 + F.coalesce("c", F.lit(0))).alias("n_links"), "component_id", "n"), "linked")
    out = by_class(good.select("vec_id", "ka", "kb"), of, ["ka", "kb"]).select("vec_id", "n_links", "component_id")
    out = out.unionByName(v.where(~F.col("ok")).select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id")))
    return out.withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(True)))
