"""Token-id files: Parquet with a list column of ids, for selective reads.

Rows are in ascending doc_id order over all files. Ids are dictionary-encoded and bit-packed,
doc_id, local_start and n_tokens delta-encoded; row groups and pages have bounded sizes, and the page indexes that
Spark's writer adds let a read by doc_id skip pages and a read of metadata skip the ids altogether.

A null or empty text is its end id alone. A null doc_id sorts first; rows with the same doc_id follow
each other by text. An empty table makes files without rows. Extra columns are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bytehash as H
from .encoder import encoder, with_end
from .shared import partitions, small_batches

ROW_GROUP, PAGE, PAGE_ROWS = 16 << 20, 256 << 10, 2000


def write_tokens(docs: DataFrame, path: str, tokenizer: str = "byte_bpe_50k.json", end_id: int = 2, spaced: bool = True) -> None:
    """Writes (doc_id, part, local_start, n_tokens, ids); part is the place of a file in doc_id order."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, part, start = encoder(tokenizer, spaced), TaskContext.get().partitionId(), 0
        for b in H.slices(batches, "text"):
            ids, off = with_end(*enc.encode(b.column(1)), end_id)
            lists = pa.ListArray.from_arrays(pa.array(off, pa.int32()), pa.array(ids.view(np.int32)))
            n = b.num_rows
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(np.full(n, part, np.int32)), pa.array(start + off[:-1]), pa.array(np.diff(off)), lists], ["doc_id", "part", "local_start", "n_tokens", "ids"])
            start += int(off[-1])

    small_batches(docs.sparkSession)
    rows = docs.select("doc_id", "text").repartitionByRange(partitions(docs.sparkSession), "doc_id").sortWithinPartitions("doc_id", "text")
    out = rows.mapInArrow(run, "doc_id long, part int, local_start long, n_tokens long, ids array<int>").write
    for k, v in (("block.size", ROW_GROUP), ("page.size", PAGE), ("page.row.count.limit", PAGE_ROWS), ("writer.version", "v2"), ("enable.dictionary", "true"), ("enable.dictionary#doc_id", "false"), ("enable.dictionary#local_start", "false"), ("enable.dictionary#n_tokens", "false")):
        out = out.option(f"parquet.{k}", str(v))
    out.option("compression", "zstd").parquet(path)


def read_tokens(spark: SparkSession, path: str, columns: list[str] | None = None, where: Column | None = None) -> DataFrame:
    """The files' rows; column choice and conditions on doc_id or n_tokens reach the scan."""
    df = spark.read.parquet(path)
    df = df if where is None else df.where(where)
    return df.select(*columns) if columns else df


def starts(spark: SparkSession, path: str) -> DataFrame:
    """(part, base): ids in all files before each; one row a file, read from metadata columns only."""
    sums = sorted((r.part, r.n) for r in read_tokens(spark, path, ["part", "n_tokens"]).groupBy("part").agg(F.sum("n_tokens").alias("n")).collect())
    rows, at = [], 0
    for part, n in sums:
        rows.append((part, at))
        at += n
    return spark.createDataFrame(rows, "part int, base long")


def digests(spark: SparkSession, path: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of every document, from the ids in the files."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            lists = b.column(3)
            flat = lists.flatten().to_numpy().astype("<u4")
            off = np.concatenate([[0], np.cumsum(lists.value_lengths().to_numpy(zero_copy_only=False))]) if len(lists) else np.zeros(1)
            off = off.astype(np.int64)
            crc = [zlib.crc32(flat[a:z].tobytes()) for a, z in zip(off[:-1].tolist(), off[1:].tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays([*b.columns[:3], pa.array(np.diff(off), pa.int64()), pa.array(crc, pa.int64())], ["doc_id", "part", "local_start", "n_tokens", "ids_crc32"])

    rows = read_tokens(spark, path, ["doc_id", "part", "local_start", "ids"]).mapInArrow(run, "doc_id long, part int, local_start long, n_tokens long, ids_crc32 long")
    base = F.broadcast(starts(spark, path))  # one row a file
    return rows.join(base, "part").select("doc_id", (F.col("base") + F.col("local_start")).alias("start"), "n_tokens", "ids_crc32")
