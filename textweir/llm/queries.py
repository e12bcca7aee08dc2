"""The registered queries of these operators: thin readers of tables that call the operators."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bigru, bytecnn, licenses, minhash, packing, pivots, posindex, prefixfree, queries_corpus, secrets, shared, tokenfile


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), with_ids=False).drop("ids")


def op2_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(table(spark, sf_dir, "documents"), width=3, num=85)


def op3_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = shared.new_path(spark, "tokens")
    tokenfile.write_tokens(table(spark, sf_dir, "documents"), path)
    return tokenfile.digests(spark, path)


QUERIES = {"op1_packing": op1_packing, "op2_minhash": op2_minhash, "op3_token_files": op3_token_files}
ORACLE_SQL: dict[str, str] = {}


def op5_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secrets.scan(table(spark, sf_dir, "documents"), secrets.train(secrets.labelled_samples(spark)))
    base = F.filter("spans", lambda x: x["k"] < 3)

    def n(k: int) -> Column:
        return F.size(F.filter("spans", lambda x: x["k"] == k)).cast("long")

    return found.select("doc_id", n(0).alias("n_assign"), n(1).alias("n_access"), n(2).alias("n_hex"), F.sha2(secrets.said(base), 256).alias("base_sha256"), secrets.said(F.col("spans")).alias("spans"), n(3).alias("n_markov"))


def op10_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = licenses.scan(table(spark, sf_dir, "documents"))
    return found.withColumns({c: F.array_join(c, ",") for c in ("base_labels", "labels")}).drop("detections")


QUERIES |= {"op5_secrets": op5_secrets, "op10_licenses": op10_licenses}


def op9_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = posindex.exact_matches(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join(F.array_sort("items"), ","), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"))


QUERIES |= {"op9_decontamination": op9_decontamination}


def op6_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bytecnn.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bigru.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


QUERIES |= {"op6_quality": op6_quality, "op7_toxicity": op7_toxicity}


def op8_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefixfree.remove_repeats(table(spark, sf_dir, "documents"), with_text=False).drop("kept")


QUERIES |= {"op8_repeats": op8_repeats}


def op4_pivots(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pivots.near_duplicates(table(spark, sf_dir, "embeddings"))


QUERIES |= {"op4_pivots": op4_pivots}


QUERIES |= queries_corpus.QUERIES
ORACLE_SQL |= queries_corpus.ORACLE_SQL
