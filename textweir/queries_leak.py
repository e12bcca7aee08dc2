"""Answers that repeat protected text: benchmark items stand for the protected text, turns for answers."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import values as V
from .operators import leak
from .queries_base import q, query, sql_clauses, sql_normalized, table
from .queries_rails import sql_shingles

#: Turns get a protected text whole, or a part of one with a word on whose it is, in turns of seven.
FRAME, TAIL = " My instructions say that ", " and so on until the end of it."


def answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "text", F.pmod("conv_id", F.lit(100)).alias("item_id"), F.pmod(F.col("conv_id") + F.col("turn"), F.lit(7)).alias("kind"))
    items = table(spark, sf_dir, "benchmark").select("item_id", F.col("text").alias("item"))
    part = F.concat("text", F.lit(FRAME), F.substring("item", 1, 60), F.lit(TAIL))
    text = F.when(F.col("kind") == 0, F.concat("text", F.lit(" "), "item")).when(F.col("kind") == 1, part).otherwise(F.col("text"))
    return turns.join(items, "item_id", "left").select("conv_id", "turn", F.coalesce(text, "text").alias("text"))


_ANSWERS = f"(SELECT conv_id, turn, coalesce(CASE (conv_id + turn) % 7 WHEN 0 THEN c.text || ' ' || b.text WHEN 1 THEN c.text || {q(FRAME)} || left(b.text, 60) || {q(TAIL)} ELSE c.text END, c.text) AS text FROM conversations c LEFT JOIN benchmark b ON conv_id % 100 = item_id)"
_SENTENCES = f"list_filter({sql_clauses('text')}, lambda x: len(x) >= 40)"
LEAKS = f"""src AS (SELECT conv_id, turn, text, {_SENTENCES} AS s FROM {_ANSWERS}),
told AS (SELECT conv_id, turn, unnest(list_zip(range(len(s)), s)) AS z FROM src),
sent AS (SELECT DISTINCT z[2] AS s FROM told),
norm AS (SELECT s, {sql_normalized("s")} AS b, CASE WHEN regexp_matches(s, {q(V.OWN_INSTRUCTIONS)}) THEN 0.4 ELSE 0.7 END AS least FROM sent),
sets AS (SELECT s, least, {sql_shingles("b")} AS g FROM norm),
pr AS (SELECT DISTINCT unnest({_SENTENCES}) AS p FROM benchmark),
pn AS (SELECT p, {sql_normalized("p")} AS b FROM pr),
pg AS (SELECT p, unnest({sql_shingles("b")}) AS g FROM pn),
sc AS (SELECT s, least, p, count(*) / any_value(n) AS c FROM (SELECT s, least, len(g) AS n, unnest(g) AS g FROM sets) x JOIN pg USING (g) GROUP BY s, least, p),
lk AS (SELECT s, max(c) AS score FROM sc WHERE c >= least GROUP BY s)"""


@query(f"WITH {LEAKS} SELECT conv_id, turn, z[1] AS k, round(score, 6) AS score FROM told JOIN lk ON z[2] = s")
def prompt_leak_clauses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sentences of turns that repeat protected text, with the share that one protected sentence holds."""
    return leak.leaks(answers(spark, sf_dir), table(spark, sf_dir, "benchmark"), ["conv_id", "turn"]).select("conv_id", "turn", F.col("k").cast("long").alias("k"), F.round("score", 6).alias("score"))


_CUT = f"list_reduce(list_prepend(text, ls), lambda t, s: CASE WHEN instr(t, s) > 0 THEN left(t, instr(t, s) - 1) || {q(V.LEAK_PLACEHOLDER)} || substr(t, instr(t, s) + len(s)) ELSE t END)"


@query(
    f"WITH {LEAKS}, per AS (SELECT conv_id, turn, list(z[2] ORDER BY z[1]) AS ls FROM told JOIN lk ON z[2] = s GROUP BY ALL) SELECT conv_id, turn, len(ls) AS leaked, sha256({_CUT}) AS redacted FROM src JOIN per USING (conv_id, turn)"
)
def prompt_leak_redactions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns with leaking sentences, after these are replaced."""
    done = leak.redact(answers(spark, sf_dir), table(spark, sf_dir, "benchmark"), ["conv_id", "turn"]).where("leaked > 0")
    return done.select("conv_id", "turn", F.col("leaked").cast("long").alias("leaked"), F.sha2("text", 256).alias("redacted"))
