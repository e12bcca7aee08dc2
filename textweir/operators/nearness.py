"""The highest cosine of each vector with any of others: exact, block by block, so that memory does not grow with the vectors."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Vectors of a block, and rows of a block that are multiplied at once.
BLOCK, STEP = 4096, 512


def matrix(col: pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(vectors as rows, their norms, whether each is a vector without nulls)."""
    a = col.combine_chunks()
    a = a.chunk(0) if isinstance(a, pa.ChunkedArray) else a
    sizes = set(a.value_lengths().drop_null().to_pylist())
    if len(sizes) > 1:
        raise ValueError("vectors have different lengths")
    size, ok = (sizes.pop() if sizes else 0), a.is_valid().to_numpy(zero_copy_only=False).copy()
    m, flat = np.zeros((len(a), size)), a.flatten()
    m[ok] = flat.to_numpy(zero_copy_only=False).reshape(-1, size)
    if flat.null_count:
        ok[np.flatnonzero(ok)[flat.is_null().to_numpy(zero_copy_only=False).reshape(-1, size).any(axis=1)]] = False
    with np.errstate(all="ignore"):
        return m, np.sqrt((m * m).sum(axis=1)), ok


def highest(left: pa.Table, right: pa.Table) -> pa.Table:
    """id and best of the left vectors: over the right ones of another id; right ids may be null, those of no vector."""
    if "v" not in left.column_names or "v" not in right.column_names:  # a side without rows has no columns
        return pa.table({"id": pa.array([], pa.int64()), "best": pa.array([], pa.float64())})
    (x, nx, x_ok), (y, ny, y_ok) = matrix(left["v"]), matrix(right["v"])
    some_of_both = bool(x_ok.any() and y_ok.any())
    if some_of_both and x.shape[1] != y.shape[1]:
        raise ValueError("vectors have different lengths")
    ids, named = left["id"].to_numpy(), right["id"].is_valid().to_numpy()
    own = right["id"].fill_null(0).to_numpy()
    shared = np.isin(ids, own[named])
    best, some, other = np.full(len(ids), -np.inf), np.zeros(len(ids), bool), np.ones(len(ids), bool)
    for i in np.flatnonzero(shared):
        other[i] = (~named | (own != ids[i])).any()
    for k in range(0, len(ids) if some_of_both else 0, STEP):
        at = np.flatnonzero(x_ok[k : k + STEP]) + k
        with np.errstate(all="ignore"):
            norms = nx[at][:, None] * ny[None, :]
            s = x[at] @ y.T / norms
        s[norms == 0] = 0.0
        s[:, ~y_ok] = -np.inf
        for i in np.flatnonzero(shared[at]):
            s[i, named & (own == ids[at[i]])] = -np.inf
        best[at] = s.max(axis=1, initial=-np.inf)
        some[at] = best[at] != -np.inf
    return pa.table({"id": pa.array(ids[other], pa.int64()), "best": pa.array(best[other], pa.float64(), mask=~some[other])})


def best(asked: DataFrame, among: DataFrame) -> DataFrame:
    """(id, best) for rows (id long, v array) of asked: the highest cosine with a row of among that has another id, or none.

    A null vector, or one with a null component, has no cosine; one of norm 0 has 0 with all. Vectors of different lengths are an
    error. Rows of asked without any other row are left out; their ids are not null.
    """
    na, nb = (max(1, math.ceil(d.count() / BLOCK)) for d in (asked, among))
    own = F.xxhash64("id", "v")
    a = asked.select("id", "v", F.pmod(own, F.lit(na)).alias("a"), F.explode(F.sequence(F.lit(0).cast("long"), F.lit(nb - 1).cast("long"))).alias("b"))
    b = among.select("id", "v", F.pmod(own, F.lit(nb)).alias("b"), F.explode(F.sequence(F.lit(0).cast("long"), F.lit(na - 1).cast("long"))).alias("a"))
    each = a.groupBy("a", "b").cogroup(b.groupBy("a", "b")).applyInArrow(highest, "id long, best double")
    return each.groupBy("id").agg(F.max("best").alias("best"))
