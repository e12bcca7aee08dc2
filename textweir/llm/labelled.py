"""Bounded training samples of labelled documents, and the fold that is held out."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: At most so many labelled documents of each class train a model; those with the smallest hashes of doc_id.
PER_CLASS = 1500


def held_out(doc_id: Column) -> Column:
    """True for the fifth of ids that training never sees; a null id is not held out."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.lit(False))


def sample(docs: DataFrame, labels: DataFrame, label: str, per_class: int = PER_CLASS) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """(texts, labels 0/1, weights) of at most per_class documents of each class; weights restore the class shares."""
    known = labels.select("doc_id", F.col(label).alias("y")).where(F.col("y").isin(0, 1) & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id")))
    known = known.groupBy("doc_id").agg(F.max("y").alias("y"))
    total = {r.y: r["count"] for r in known.groupBy("y").count().collect()}
    order = F.xxhash64("doc_id")
    ids = known.where("y = 0").orderBy(order, "doc_id").limit(per_class).unionByName(known.where("y = 1").orderBy(order, "doc_id").limit(per_class))
    # at most 2 * per_class ids: bounded, so safe to broadcast
    got = docs.select("doc_id", "text").join(F.broadcast(ids), "doc_id").select("doc_id", "text", "y").toArrow().sort_by([("doc_id", "ascending"), ("text", "ascending")])
    y = got["y"].to_numpy().astype(np.float32)
    n = {k: max(1, int((y == k).sum())) for k in (0, 1)}
    w = np.where(y == 1, total.get(1, 0) / n[1], total.get(0, 0) / n[0]).astype(np.float32)
    text = got["text"].combine_chunks()
    return (text.chunk(0) if isinstance(text, pa.ChunkedArray) and text.num_chunks else text if isinstance(text, pa.Array) else pa.array([], pa.string())), y, w / max(1e-9, w.mean()) if len(w) else w


class Adam:
    """Steps of Adam over a dict of arrays."""

    def __init__(self, p: dict[str, np.ndarray], rate: float) -> None:
        self.p, self.rate, self.t = p, rate, 0
        self.m, self.v = ({k: np.zeros_like(x) for k, x in p.items()} for _ in range(2))

    def step(self, g: dict[str, np.ndarray]) -> None:
        self.t += 1
        for k, d in g.items():
            self.m[k] += 0.1 * (d - self.m[k])
            self.v[k] += 0.001 * (d * d - self.v[k])
            self.p[k] -= (self.rate * (self.m[k] / (1 - 0.9**self.t)) / (np.sqrt(self.v[k] / (1 - 0.999**self.t)) + 1e-8)).astype(self.p[k].dtype)


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))
