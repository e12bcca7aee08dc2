"""Where a threshold or a model comes from: manifests of splits with digests, and claims held against predictions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

DIGEST = "^[0-9a-f]{64}$"


def manifest(cases: DataFrame, text: str = "text") -> DataFrame:
    """(case_id, grp, label, role, sha256) of cases: the digest of a case's canonical JSON, with that of its text."""
    record = F.to_json(F.struct(F.col("grp").alias("group"), F.col("case_id").cast("string").alias("id"), F.col("label"), F.col("role"), F.sha2(text, 256).alias("text")), {"ignoreNullFields": "false"})
    return cases.select("case_id", "grp", "label", "role", F.sha2(record, 256).alias("sha256"))


def changed(before: DataFrame, after: DataFrame) -> DataFrame:
    """(case_id, change) of two manifests: added, removed, moved to another role, or edited."""
    j = before.alias("b").join(after.alias("a"), "case_id", "full")
    what = F.when(F.col("b.sha256").isNull(), "added").when(F.col("a.sha256").isNull(), "removed").when(~F.col("a.role").eqNullSafe(F.col("b.role")), "moved").when(F.col("a.sha256") != F.col("b.sha256"), "edited")
    return j.select("case_id", what.alias("change")).where("change is not null")


def artifact_roles(claims: DataFrame, predictions: DataFrame) -> DataFrame:
    """(artifact, role, cases, repeated, unknown, wrong_role, missing, consistent) from claims (artifact, role, case_id) and predictions (case_id, role).

    An artifact is consistent where its cases are known, each named once, all of the role it claims, and not of the test role. missing
    counts cases of the role that it does not name: only a threshold must name them all.
    """
    named = claims.groupBy("artifact", "role", "case_id").agg(F.count(F.lit(1)).alias("times"))
    known = predictions.select("case_id", F.col("role").alias("real"))
    j = named.join(known, "case_id", "left").groupBy("artifact", "role").agg(
        F.count(F.lit(1)).alias("cases"), F.count_if(F.col("times") > 1).alias("repeated"), F.count_if(F.col("real").isNull()).alias("unknown"),
        F.count_if(F.col("real") != F.col("role")).alias("wrong_role"), F.count_if(F.col("real") == F.col("role")).alias("right"),
    )
    sizes = predictions.groupBy("role").agg(F.count(F.lit(1)).alias("size"))
    j = j.join(F.broadcast(sizes), "role", "left")  # one row a role
    faults = F.col("repeated") + F.col("unknown") + F.col("wrong_role")
    whole = (F.col("role") != "threshold") | (F.col("missing") == 0)
    return j.withColumn("missing", F.coalesce("size", F.lit(0)) - F.col("right")).select("artifact", "role", "cases", "repeated", "unknown", "wrong_role", "missing", ((faults == 0) & whole & (F.col("role") != "test")).alias("consistent"))


def threshold_faults(threshold: DataFrame, artifacts: DataFrame) -> DataFrame:
    """threshold (id, value, selected_on, artifact_id, artifact_sha256, method, level) with faults: what keeps it from being used, by name."""

    def unless(ok: Column, name: str) -> Column:
        return F.when(~F.coalesce(ok, F.lit(False)), name)

    mine = artifacts.select(F.col("id").alias("artifact_id"), F.col("sha256").alias("_real"))
    c = F.col
    faults = F.array(
        unless(c("id") != "", "no id"), unless(c("value").between(0, 1), "value out of range"), unless(c("selected_on") == "threshold", "not selected on the threshold role"),
        unless(c("artifact_sha256").rlike(DIGEST), "no digest"), unless(c("artifact_sha256") == c("_real"), "no such artifact"), unless((c("method") != "") & (c("level") > 0) & (c("level") < 1), "no interval"),
    )
    return threshold.join(mine, "artifact_id", "left").withColumn("faults", F.filter(faults, lambda x: x.isNotNull())).drop("_real")
