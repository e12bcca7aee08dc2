"""Written tables in the folder that driver and executors share."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_own: list[str] = []


def shared_dir(spark: SparkSession) -> str:
    """The cluster's ``spark.checkpoint.dir``; only where it is unset on one machine a temporary folder. Elsewhere that is a ValueError."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        master = spark.sparkContext.master
        if master != "local" and not master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        if not _own:
            _own.append("file://" + tempfile.mkdtemp(prefix="textweir-"))
        base = _own[0]
    return base.rstrip("/")


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@contextmanager
def shuffles_dropped(spark: SparkSession) -> Iterator[None]:
    """Shuffle files of what is run inside are deleted when it ends; else they stay on disk until the driver happens to collect garbage."""
    before = spark.conf.get(CLEANUP, None)
    spark.conf.set(CLEANUP, "true")
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(CLEANUP)
        else:
            spark.conf.set(CLEANUP, before)


def written(df: DataFrame, name: str) -> DataFrame:
    """Writes df as Parquet in the shared folder and reads it back: cuts lineage and survives lost executors."""
    spark = df.sparkSession
    path = new_path(spark, name)
    with shuffles_dropped(spark):
        df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._written_path = path
    return out


def dropped(df: DataFrame) -> None:
    """Deletes what written() made, once nothing reads it any more."""
    path = getattr(df, "_written_path", None)
    if path:
        drop_path(df.sparkSession, path)


def drop_path(spark: SparkSession, path: str) -> None:
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def small_batches(spark: SparkSession, rows: int = 1000) -> None:
    """Lowers the session's Arrow batches to at most `rows` rows: texts are long, and workers hold whole batches."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(key)) <= rows:
        spark.conf.set(key, str(rows))


def ungathered(df: DataFrame) -> DataFrame:
    """A side of a join that the driver never gathers to broadcast it: the planner takes what comes out of a small file for small, however many rows an explode makes of it."""
    return df.hint("merge")


#: A class with more than this share of all rows is joined by broadcast; there are fewer than 1 / HOT_SHARE of them.
HOT_SHARE, FEW = 0.001, 100


def by_class(rows: DataFrame, classes: DataFrame, keys: list[str]) -> DataFrame:
    """rows joined with their class; classes are a written table, distinct by keys, and hold the number n of their rows.

    No task gets the rows of a large class: those classes, fewer than 1 / HOT_SHARE, are broadcast.
    """
    total, most = classes.agg(F.sum("n"), F.max("n")).head()
    limit = max(FEW, int((total or 0) * HOT_SHARE))
    if (most or 0) <= limit:
        return rows.join(ungathered(classes), keys)
    large = classes.where(F.col("n") > limit)
    mark = rows.join(F.broadcast(large.select(*keys, F.lit(True).alias("hot"))), keys, "left")
    return mark.where("hot").drop("hot").join(F.broadcast(large), keys).unionByName(mark.where("hot is null").drop("hot").join(ungathered(classes.where(F.col("n") <= limit)), keys))
