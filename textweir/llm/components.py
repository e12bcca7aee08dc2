"""Connected components by repeated contraction; nothing is gathered on the driver."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .shared import dropped, ungathered, written

#: Edges that one task joins by itself (a few MB); while more are left, shuffles contract them.
PER_TASK = 200_000


def components(edges: DataFrame, per_task: int = PER_TASK) -> DataFrame:
    """(node, component) for all nodes of edges (a, b); component is one node of those that are reachable.

    Each round points every node at one of its neighbours or itself, and contracts: at the smallest in one
    round (stars around it end at once), at that with the smallest hash in the next (chains in order of their
    numbers shrink like others). Rounds are logarithmic in the graph's size; the last per_task edges are joined
    in one task. Null ends are ignored. Joins on a node with very many neighbours are left to the engine's skew
    handling, which splits such partitions.
    """
    e = written(edges.where("a is not null and b is not null and a <> b").select("a", "b"), "edges")
    found: DataFrame | None = None
    turn = 0
    while left := e.count():
        if left <= per_task:
            p, nxt = written(joined(e), "parents"), None
        else:
            p = written(pointed(e, turn), "parents")
            b = p.select(F.col("a").alias("b"), F.col("p").alias("pb"))
            nxt = e.join(ungathered(p), "a").select("b", "p").join(ungathered(b), "b").where("p <> pb")
            nxt = written(nxt.select(F.least("p", "pb").alias("a"), F.greatest("p", "pb").alias("b")).distinct(), "edges")
        dropped(e)
        if found is None:
            found = p
        else:
            old, step = found, p.select(F.col("a").alias("p"), F.col("p").alias("p2"))
            found = written(old.join(ungathered(step), "p", "left").select("a", F.coalesce("p2", "p").alias("p")), "found")
            for done in (old, p):
                dropped(done)
        if nxt is None:
            break
        e, turn = nxt, turn + 1
    else:
        dropped(e)
    if found is None:
        return edges.select(F.col("a").alias("node"), F.col("b").alias("component")).limit(0)
    return found.select(F.col("a").alias("node"), F.col("p").alias("component"))


def pointed(e: DataFrame, turn: int) -> DataFrame:
    """(a, p): every node with the neighbour, or itself, of the least number (even turns) or the least hash."""
    rank = (lambda c: F.xxhash64(c, F.lit(turn))) if turn % 2 else F.col
    both = e.unionByName(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
    best = F.min(F.struct(rank("b").alias("h"), F.col("b").alias("p")))
    own = F.struct(rank("a").alias("h"), F.col("a").alias("p"))
    return both.groupBy("a").agg(best.alias("best")).select("a", F.least("best", own)["p"].alias("p"))


def joined(e: DataFrame) -> DataFrame:
    """(a, p): every node with the root of its component, by union-find in one task."""
    kind = e.schema["a"].dataType

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        up: dict = {}

        def root(x):
            while (y := up.setdefault(x, x)) != x:
                up[x] = up[y]
                x = up[x]
            return x

        like = pa.int64()
        for b in batches:
            like = b.schema.types[0]
            for x, y in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                x, y = root(x), root(y)
                if x != y:
                    up[max(x, y)] = min(x, y)
        if up:
            nodes = list(up)
            yield pa.RecordBatch.from_arrays([pa.array(nodes, like), pa.array([root(x) for x in nodes], like)], ["a", "p"])

    return e.coalesce(1).mapInArrow(run, T.StructType([T.StructField("a", kind), T.StructField("p", kind)]))
