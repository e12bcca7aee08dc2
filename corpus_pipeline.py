"""From raw documents to packed training windows, stage by stage.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, written as Parquet in the shared folder
and read again as the next stage's docs. All but the last return the columns of documents.

quality: documents that the byte network rejects go. near_duplicates: of each group of documents that
links of Jaccard 0.8 on five-word shingles connect, the row of the smallest doc_id stays; decisions are by
row, so doc_ids may be null or repeated. decontaminate: documents with a passage of the benchmark go. secrets: spans of secrets in texts
are replaced by a mark. pack: texts become token windows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from textweir.llm import bytecnn, labelled, minhash, packing, posindex, secrets, shared


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return bytecnn.accepted(docs, bytecnn.train(*labelled.sample(docs, labels, "quality")))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return minhash.distinct_rows(docs, width=5, num=80)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    by_text = docs.select(F.xxhash64("text").alias("doc_id"), "text")  # what a text holds does not depend on its doc_id, which may be null or repeated
    hit = posindex.exact_matches(by_text, spark.read.parquet(f"{sf_dir}/benchmark.parquet")).where("n_hit > 0").select("doc_id")
    return docs.join(hit, F.xxhash64(docs["text"]) == hit["doc_id"], "left_anti").select(*docs.columns)


def redact_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return secrets.redact(docs, secrets.train(secrets.labelled_samples(spark)))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack(docs)


STAGES = [("quality", quality), ("near_duplicates", near_duplicates), ("decontaminate", decontaminate), ("secrets", redact_secrets), ("pack", pack)]

#: SQL can express neither the trained stages nor the tokenizer; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = shared.written(stage(spark, docs, sf_dir), name)
    return docs
