"""Queries over conversations as sessions with two tracks, and over marked answers."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .functions import text as T
from .functions import values as V
from .operators import assess, flow, rails, session, watermark
from .queries_base import query, sql_list, sql_matching, table
from .queries_stats import PRIOR, RAILS, WEIGHTS

N = len(V.INJECTIONS)


@query(
    f"""WITH t AS (SELECT conv_id, turn, CASE WHEN role = 'user' THEN 'attack' ELSE 'contamination' END AS channel, CASE WHEN (conv_id + turn) % 6 = 0 THEN text || chr(10) || ({sql_list(V.INJECTIONS)})[(conv_id + turn) % {N} + 1] ELSE text END AS text FROM conversations),
x AS (SELECT conv_id, turn, channel, {" + ".join(f"CASE WHEN len({sql_matching(RAILS[r])}) > 0 THEN {y!r} ELSE {n!r} END" for r, y, n in WEIGHTS if r in RAILS)} AS x FROM t),
f AS (SELECT conv_id, channel, COUNT(*) AS turns, list_reduce(list_prepend(0.0::DOUBLE, list(x::DOUBLE ORDER BY turn, x)), lambda a, v: a * 0.6 + v) AS bits, list_reduce(list_prepend(0.0::DOUBLE, list(x::DOUBLE ORDER BY turn, x)), lambda a, v: greatest(0.0, a * 0.6 + v)) AS cusum FROM x GROUP BY 1, 2),
p AS (SELECT *, {PRIOR / (1 - PRIOR)!r} * pow(2, bits) / (1 + {PRIOR / (1 - PRIOR)!r} * pow(2, bits)) AS p FROM f),
s AS (SELECT conv_id, coalesce(max(turns) FILTER (channel = 'attack'), 0) AS a, coalesce(max(turns) FILTER (channel = 'contamination'), 0) AS c, max(bits) FILTER (channel = 'attack') AS ab, max(bits) FILTER (channel = 'contamination') AS cb, max(cusum) FILTER (channel = 'attack') AS ac, max(cusum) FILTER (channel = 'contamination') AS cc, max(p) FILTER (channel = 'attack') AS ap, max(p) FILTER (channel = 'contamination') AS cp FROM p GROUP BY 1),
o AS (SELECT conv_id, arg_min(channel, turn) AS channel FROM t GROUP BY 1)
SELECT conv_id, channel, a AS attack_turns, c AS contamination_turns, round(coalesce(ab, 0), 6) AS attack_bits, round(coalesce(cb, 0), 6) AS contamination_bits, round(coalesce(ac, 0), 6) AS attack_cusum, round(coalesce(cc, 0), 6) AS contamination_cusum,
  a > 0 AND c > 0 AS ambiguous, CASE WHEN channel = 'contamination' THEN a ELSE c END AS quarantined, coalesce(ap >= 0.5, false) OR coalesce(cp >= 0.5, false) AS blocks,
  CASE WHEN a > 0 AND c > 0 THEN NULL ELSE round(coalesce(ap, cp), 6) END AS posterior,
  CASE WHEN a > 0 AND c > 0 THEN NULL WHEN coalesce(ab, cb) >= {math.log2(0.95 / 0.01)!r} THEN 'attack' WHEN coalesce(ab, cb) <= {math.log2(0.05 / 0.99)!r} THEN 'benign' ELSE 'undecided' END AS verdict,
  CASE WHEN a > 0 AND c > 0 THEN NULL ELSE coalesce(ac, cc) >= {math.log2(0.95 / 0.01)!r} END AS shift FROM s JOIN o USING (conv_id)"""
)
def session_tracks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations as sessions: what users write moves one track, everything else the other; bits are those of two rails on each turn."""
    k = F.col("conv_id") + F.col("turn")
    injected = F.concat("text", F.lit("\n"), F.get(T.strings(V.INJECTIONS), F.pmod(k, F.lit(N)).cast("int")))
    t = table(spark, sf_dir, "conversations").select("conv_id", "turn", F.when(F.col("role") == "user", "attack").otherwise("contamination").alias("channel"), F.when(F.pmod(k, F.lit(6)) == 0, injected).otherwise(F.col("text")).alias("text"))
    t = t.select("conv_id", "turn", "channel", assess.row_bits({r: rails.any_match(F.col("text"), p) for r, p in RAILS.items()}, "context").alias("bits"))
    s = session.tracks(t, "conv_id", "turn", F.col("bits"), F.col("channel"), PRIOR)
    numbers = [f"{c}_{n}" for c in session.CHANNELS for n in ("bits", "cusum")]
    return s.select("conv_id", "channel", "attack_turns", "contamination_turns", *[F.round(n, 6).alias(n) for n in numbers], "ambiguous", "quarantined", "blocks", F.round("posterior", 6).alias("posterior"), "verdict", "shift")


@query()
def watermark_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents marked for their source and then left alone, quoted in part, edited or stripped: what verification says of them. Held against a plain version in the tests."""
    d = table(spark, sf_dir, "documents").select("doc_id", "source", F.regexp_replace("text", r"\.\n", ".\n\n").alias("text"))
    d = d.withColumn("marked_text", watermark.mark(F.col("text"), "key", F.col("source")))
    kind, m = F.pmod("doc_id", F.lit(4)), F.col("marked_text")
    after = F.when(kind == 1, F.element_at(F.split(m, watermark.GAP), 1)).when(kind == 2, F.regexp_replace(m, "an", "na")).when(kind == 3, watermark.strip(m)).otherwise(m)
    d = d.withColumn("after", after).withColumn("v", watermark.verify(F.col("after"), "key", F.col("source")))
    return d.select("doc_id", "v.marked", "v.authentic", F.round("v.coverage", 6).alias("coverage"), F.col("v.segments").cast("long").alias("segments"), (watermark.strip(m) == F.col("text")).alias("restored"))


FLOWS = {"approve": flow.Rule(("system",), integrity=("system",)), "publish": flow.Rule(("system", "user"), sinks=("web", "mail"))}
_ORIGIN = "CASE {} WHEN 'system' THEN 'system' WHEN 'user' THEN 'user' ELSE 'data' END"
_ACTOR = "CASE turn % 4 WHEN 0 THEN 'system' WHEN 1 THEN 'user' WHEN 2 THEN 'data' ELSE 'system' END"
_OPERATION = "CASE (conv_id + turn) % 5 WHEN 0 THEN 'approve' WHEN 1 THEN 'erase' ELSE 'publish' END"


@query(
    f"""WITH t AS (SELECT conv_id, turn, {_ORIGIN.format("role")} AS o, lag({_ORIGIN.format("role")}) OVER (PARTITION BY conv_id ORDER BY turn) AS p, {_ACTOR} AS actor, {_OPERATION} AS op, turn % 2 = 0 AS held FROM conversations),
l AS (SELECT *, list_distinct([x for x in [p, o] if x IS NOT NULL]) AS prov, CASE WHEN o = 'data' OR p = 'data' THEN 0 ELSE len(list_distinct([x for x in [p, o] if x IS NOT NULL])) END AS integ FROM t),
d AS (SELECT *, CASE WHEN op = 'erase' THEN 'not_granted' WHEN actor = 'data' OR (op = 'approve' AND actor <> 'system') THEN 'unauthorized' END AS denied FROM l)
SELECT conv_id, turn, op AS operation, denied, array_to_string(list_sort(list_distinct(CASE WHEN denied IS NULL THEN list_append(prov, actor) ELSE prov END)), ',') AS provenance,
  CASE WHEN denied IS NULL AND op = 'approve' THEN 1 ELSE integ END AS integrity, CASE WHEN denied IS NULL AND op = 'publish' THEN 'mail,web' WHEN held THEN 'file' END AS sinks FROM d"""
)
def flow_operations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns mixed with the one before them, then endorsed or declassified by an actor: what is denied, and the label after it."""
    w = Window.partitionBy("conv_id").orderBy("turn")
    t = table(spark, sf_dir, "conversations").select("conv_id", "turn", F.expr(_ORIGIN.format("role")).alias("o"), F.expr(_ACTOR).alias("a"), F.expr(_OPERATION).alias("operation"))
    own = flow.label(F.array("o"), sinks=F.when(F.col("turn") % 2 == 0, F.array(F.lit("file"))))
    t = t.withColumn("before", F.lag("o").over(w))
    t = t.select("conv_id", "turn", "operation", flow.mixed(F.when(F.col("before").isNotNull(), flow.label(F.array("before"))), own).alias("label"), flow.label(F.array("a")).alias("actor"))
    d = flow.operate(t, FLOWS)
    joined = {k: F.array_join(F.array_sort(F.col("after")[k]), ",") for k in ("provenance", "sinks")}
    return d.select("conv_id", "turn", "operation", "denied", joined["provenance"].alias("provenance"), F.size("after.integrity").alias("integrity"), joined["sinks"].alias("sinks"))
