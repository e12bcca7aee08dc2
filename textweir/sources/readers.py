"""Readers and sinks: every source comes back as a DataFrame with an explicit schema."""

from __future__ import annotations

import hashlib
import json
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

TRACE = "suite_name string, pipeline_name string, user_task_id string, injection_task_id string, attack_type string, utility boolean, security boolean, error string, duration double"
CASE = "id string, parent_case_id string, family string, split string, language string, domain string, origin string, access string, attack_budget int, seed int"


def attack_corpus(spark: SparkSession, path: str) -> DataFrame:
    """(category, text) of a JSON object of category to list of strings."""
    raw = spark.read.text(path, wholetext=True)
    return raw.select(F.explode(F.from_json("value", "map<string,array<string>>")).alias("category", "texts")).select("category", F.explode("texts").alias("text"))


def prompts(spark: SparkSession, path: str, column: str = "prompt") -> DataFrame:
    """(text): a column of a quoted CSV with embedded line ends; empty ones are left out, carriage returns dropped."""
    t = spark.read.csv(path, header=True, multiLine=True, quote='"', escape='"').select(F.regexp_replace(column, "\r", "").alias("text"))
    return t.where("text is not null and trim(text) <> ''")


def texts(spark: SparkSession, path: str, least: int = 200, most: int | None = None) -> DataFrame:
    """(path, text) of whole files, longer than `least`, cut at `most` characters where given."""
    t = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    text = F.make_valid_utf8(F.col("content").cast("string"))
    t = t.select("path", text.alias("text")).where(F.length("text") > least)
    return t if most is None else t.withColumn("text", F.substring("text", 1, most))


def traces(spark: SparkSession, path: str) -> DataFrame:
    """A tree of trace files: their fields, path and SHA-256; a file that is no trace has null fields."""
    t = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.json").load(path)
    t = t.select("path", F.sha2("content", 256).alias("sha256"), F.from_json(F.col("content").cast("string"), TRACE).alias("t"))
    return t.select("path", "sha256", "t.*")


def attack_matrix(spark: SparkSession, path: str) -> DataFrame:
    """Cases of an attack matrix file: one row each."""
    raw = spark.read.text(path, wholetext=True)
    kind = ",".join(":".join(c.split()) for c in CASE.split(","))
    return raw.select(F.explode(F.from_json("value", f"struct<cases:array<struct<{kind}>>>")["cases"]).alias("c")).select("c.*")


def trace_cases(rows: DataFrame) -> DataFrame:
    """Attacked traces with their suite's baseline: status, security and secure utility; a missing or repeated baseline is an error row."""
    base = rows.where("injection_task_id is null").groupBy("suite_name", "user_task_id").agg(F.count(F.lit(1)).alias("n"), F.first("utility").alias("baseline"))
    j = rows.where("injection_task_id is not null").join(base, ["suite_name", "user_task_id"], "left")
    status = F.when(F.col("error").isNotNull() | F.coalesce(F.col("n") != 1, F.lit(True)), "error").otherwise("ok")
    return j.select("suite_name", "user_task_id", "injection_task_id", "attack_type", status.alias("status"), "security", "utility", "baseline", (F.col("security") & F.col("utility")).alias("secure_utility"))


def artifact(path: str, fields: set[str], sha256: str | None = None, most: int = 4 << 20) -> dict:
    """A strict JSON artifact on the driver: size cap, optional pin of its SHA-256, exactly the given fields."""
    raw = Path(path).read_bytes()
    if len(raw) > most:
        raise ValueError(f"artifact has {len(raw)} bytes; at most {most}")
    if sha256 and hashlib.sha256(raw).hexdigest() != sha256:
        raise ValueError("artifact does not match its checksum")
    data = json.loads(raw)
    if set(data) != fields:
        raise ValueError(f"artifact fields differ: {sorted(set(data) ^ fields)}")
    return data


def canonical(value: object) -> tuple[str, str]:
    """(canonical JSON, its SHA-256)."""
    text = json.dumps(value, sort_keys=True, separators=(",", ":"), ensure_ascii=False)
    return text, hashlib.sha256(text.encode()).hexdigest()


def linear_model(spark: SparkSession, path: str, most: int = 1 << 20) -> tuple[DataFrame, dict]:
    """((bucket, weight), {buckets, stride, bias, threshold}) of a hashed linear model in JSON; bounds are checked."""
    kind = "buckets int, stride int, bias double, threshold double, weights map<string,double>"
    raw = spark.read.text(path, wholetext=True).select(F.from_json("value", kind).alias("m"))
    head = raw.select("m.buckets", "m.stride", "m.bias", "m.threshold").first().asDict()
    if not 0 < (head["buckets"] or 0) <= most or not 0 < (head["stride"] or 0) <= 4000:
        raise ValueError("buckets or stride out of bounds")
    return raw.select(F.explode("m.weights").alias("k", "weight")).select(F.col("k").cast("int").alias("bucket"), "weight"), head


def write_audit(events: DataFrame, path: str) -> None:
    """Appends (id, type, at, data) with data as JSON and its digest; ids follow time, with the digest as tie-break."""
    e = events.withColumn("digest", F.sha2("data", 256))
    e.select(F.concat_ws("-", F.date_format("at", "yyyyMMddHHmmssSSS"), F.substring("digest", 1, 12)).alias("id"), "type", "at", "data", "digest").write.mode("append").parquet(path)


def without_secrets(c: str) -> F.Column:
    """A map column without entries whose names speak of secrets."""
    return F.map_filter(c, lambda k, v: ~k.rlike("(?i)token|secret|passw|api_?key|credential|auth"))


def confusables(spark: SparkSession, path: str) -> dict[str, str]:
    """character: ASCII that it imitates, from a file in the form of the Unicode list of confusables (source ; target ; type).

    Only single characters outside ASCII with a target in ASCII are taken; the list holds some thousand lines.
    """
    part = F.split(F.regexp_replace("value", "#.*", ""), r"\s*;\s*")
    rows = spark.read.text(path).select(part[0].alias("a"), F.get(part, F.lit(1)).alias("b")).where("a rlike '^[0-9A-Fa-f]+$' and b rlike '^[0-9A-Fa-f ]+$'").collect()
    said = {chr(int(r.a, 16)): "".join(chr(int(x, 16)) for x in r.b.split()) for r in rows}
    return {k: v for k, v in said.items() if not k.isascii() and v.isascii()}
