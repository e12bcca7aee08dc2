"""Queries of host rules, conversation repair and collocations, with their DuckDB twins."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import collocations, hostrules, turnrepair


def op11_host_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = hostrules.judge(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return found.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def damaged(turns: DataFrame) -> DataFrame:
    """conversations with the contract's damage: by key, a row is dropped, emptied, cut, repeated or made the user's."""
    text, role = (F.coalesce(F.col(x).cast("string"), F.lit(" ")) for x in ("text", "role"))
    key = F.concat_ws(":", *[F.coalesce(F.col(x).cast("string"), F.lit(" ")) for x in ("conv_id", "turn")])
    hit = turns.select("conv_id", "turn", role.alias("role"), text.alias("text"), (F.crc32(key.cast("binary")) % 20).alias("hit")).where("hit <> 0")
    text = F.when(F.col("hit") == 1, "").when(F.col("hit") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    out = hit.select("conv_id", "turn", F.when(F.col("hit") == 4, "user").otherwise(F.col("role")).alias("role"), text.alias("text"), "hit")
    return out.withColumn("copy", F.explode(F.when(F.col("hit") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0))))).drop("hit", "copy")


def op12_turn_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text")
    found, after = turnrepair.repair(damaged(turns))
    every = turns.select(F.col("conv_id").alias("_id")).distinct()
    sha = turnrepair.digests(after).withColumnRenamed("conv_id", "_sha_id")
    out = every.join(found, F.col("_id").eqNullSafe(F.col("conv_id")), "left").drop("conv_id").join(sha, F.col("_id").eqNullSafe(F.col("_sha_id")), "left")
    counts = [F.coalesce(F.col(x), F.lit(0)).alias(x) for x in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")]
    return out.select(F.col("_id").alias("conv_id"), *counts, F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("sha256", F.sha2(F.lit("").cast("binary"), 256)).alias("repaired_sha256"))


def op13_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    found, totals = collocations.mine(spark.read.parquet(f"{sf_dir}/documents.parquet").select("lang", "text"))
    return collocations.ranked(found, 2000).join(totals, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", F.col("score").cast("long").alias("score"))


QUERIES = {"op11_host_rules": op11_host_rules, "op12_turn_repair": op12_turn_repair, "op13_collocations": op13_collocations}

_W = r"\x20\x09-\x0D"
_RULES = hostrules.HARD | hostrules.SOFT
_KEYS = [*_RULES, "hard"]


def _rate(k: str) -> str:
    """The shrunk rate of a rule at a host, by the same moments as hostrules.fitted()."""
    rho = f"((s_{k} / (p_{k}) - p_{k} * n_all) / (1 - p_{k}) - (k - 1)) / (n_all - nn / n_all - (k - 1))"
    rho = f"CASE WHEN n_all - nn / n_all - (k - 1) > 0 THEN least(greatest({rho}, 1 / (n_all + 1)), 0.5) ELSE 0.5 END"
    return f"CASE WHEN p_{k} > 0 AND p_{k} < 1 THEN (f_{k} + p_{k} * (1 / ({rho}) - 1)) / (n + 1 / ({rho}) - 1) ELSE (f_{k} + p_{k} * n_all) / (n + n_all) END AS rate_{k}"


OP11_SQL = rf"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, nullif(lower(trim(source)), '') AS host, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[^{_W}]+') AS w FROM documents),
win AS (SELECT rid, i, array_to_string(w[i:i + 4], ' ') AS g FROM (SELECT rid, w, unnest(range(1, len(w) - 3)) AS i FROM d WHERE len(w) >= 5)),
twice AS (SELECT rid, g FROM win GROUP BY rid, g HAVING count(*) > 1),
rep AS (SELECT rid, count(DISTINCT p) AS n FROM (SELECT rid, unnest(range(i, i + 5)) AS p FROM win JOIN twice USING (rid, g)) GROUP BY rid),
m AS (SELECT rid, doc_id, host, len(w)::BIGINT AS n_words, length(regexp_replace(text, '[{_W}]', '', 'g'))::BIGINT AS word_chars, length(regexp_replace(text, '[^#*$%&|<>]', '', 'g'))::BIGINT AS n_symbols,
  list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^{_W}]')) AS ln, coalesce(rep.n, 0)::BIGINT AS n_repeat_words FROM d LEFT JOIN rep USING (rid)),
f AS (SELECT *, len(ln)::BIGINT AS n_lines, (len(ln) - len(list_distinct(ln)))::BIGINT AS n_dup_lines FROM m),
t AS (SELECT *, {", ".join(f"({p}) AS fails_{k}" for k, p in _RULES.items())}, ({" OR ".join(f"({p})" for p in hostrules.HARD.values())}) AS fails_hard FROM f),
h AS (SELECT host, count(*)::DOUBLE AS n, {", ".join(f"sum(fails_{k}::INT)::DOUBLE AS f_{k}" for k in _KEYS)} FROM t WHERE host IS NOT NULL GROUP BY host),
a AS (SELECT sum(n) AS n_all, sum(n * n) AS nn, count(*) AS k, {", ".join(f"sum(f_{k}) / sum(n) AS p_{k}, sum(f_{k} * f_{k} / n) AS s_{k}" for k in _KEYS)} FROM h),
r AS (SELECT host, {", ".join(_rate(k) for k in _KEYS)} FROM h, a)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, fails_hard AS base_failed,
  NOT fails_hard AND NOT ({" OR ".join(f"(fails_{k} AND coalesce(rate_{k} >= 0.2, false))" for k in hostrules.SOFT)}) AND NOT coalesce(rate_hard >= 0.9, false) AS kept
FROM t LEFT JOIN r USING (host)
"""

_CRC = "list_reduce(list_transform(string_split({}, ''), lambda s: ascii(s)::BIGINT), lambda a, b: list_reduce(list_prepend(xor(a, b), [0, 0, 0, 0, 0, 0, 0, 0]::BIGINT[]), lambda x, i: xor(x >> 1, 3988292384::BIGINT * (x & 1))), 4294967295::BIGINT)"


def _plus(s: str, cost: str, letter: str) -> str:
    return f"{{'cost': {s}.cost + {cost}, 'audit': {s}.audit || {letter}}}"


def _closed(v: list[str]) -> str:
    user = f"least({v[2]}, " + ", ".join(_plus(v[i], "2", "'I'") for i in (0, 1, 3)) + ")"
    return f"{v[0]} AS s0, {v[1]} AS s1, {user} AS s2, least({v[3]}, {_plus(v[2], '2', chr(39) + 'I' + chr(39))}, " + ", ".join(_plus(v[i], "4", "'II'") for i in (0, 1)) + ") AS s3"


_START = "{{'cost': {}::BIGINT, 'audit': ''}}"
_GONE = [_plus(f"s{i}", "3", "'D'") for i in range(4)]


def _stay(come: str, role: str, gone: str) -> str:
    stay = _plus(come, f"(late + CASE WHEN ini = '{role}' THEN 0 ELSE 2 END)", f"CASE WHEN ini = '{role}' THEN 'K' ELSE 'R' END")
    return f"CASE WHEN must THEN {gone} ELSE least({gone}, {stay}) END"


OP12_SQL = rf"""
WITH RECURSIVE key AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, {_CRC.format("coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' ')")} AS crc FROM conversations),
hit AS (SELECT *, xor(crc, 4294967295::BIGINT) % 20 AS hit FROM key),
dam AS (SELECT conv_id, turn, CASE WHEN hit = 4 THEN 'user' ELSE role END AS role, CASE hit WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text, unnest(CASE WHEN hit = 3 THEN [0, 1] ELSE [0] END) AS copy FROM hit WHERE hit <> 0),
num AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text, copy) AS pos FROM dam),
ft AS (SELECT *, lag(role) OVER (PARTITION BY conv_id ORDER BY pos) AS prev, row_number() OVER (PARTITION BY conv_id, role, text ORDER BY pos) AS nth FROM num),
fl AS (SELECT conv_id, turn, role, text, pos, left(role, 1) AS ini, prev IS NOT NULL AND left(prev, 1) || left(role, 1) NOT IN ('su', 'ua', 'au') AS illegal,
  CASE WHEN NOT regexp_matches(text, '[^{_W}]') THEN 'blank' WHEN nth > 1 THEN 'duplicate' WHEN regexp_matches(text, '[^{_W}.!?][{_W}]*\z') THEN 'truncated' ELSE '' END AS fault FROM ft),
stp AS (SELECT conv_id, pos, ini, fault IN ('blank', 'duplicate') AS must, CASE WHEN fault = 'truncated' THEN 1 ELSE 0 END AS late FROM fl),
dp(conv_id, pos, s0, s1, s2, s3) AS (
  SELECT DISTINCT conv_id, 0::BIGINT, {", ".join(x + f" AS s{i}" for i, x in enumerate([_START.format(0), _START.format(1 << 50), "{'cost': 2::BIGINT, 'audit': 'I'}", "{'cost': 4::BIGINT, 'audit': 'II'}"]))} FROM stp
  UNION ALL
  SELECT conv_id, pos, {_closed([f"t{i}" for i in range(4)])} FROM (
    SELECT dp.conv_id, dp.pos + 1 AS pos, {_GONE[0]} AS t0, CASE WHEN must OR ini <> 's' THEN {_GONE[1]} ELSE least({_GONE[1]}, {_plus("s0", "late", "'K'")}) END AS t1,
      {_stay("least(s0, s1, s3)", "u", _GONE[2])} AS t2, {_stay("s2", "a", _GONE[3])} AS t3
    FROM dp JOIN stp ON dp.conv_id IS NOT DISTINCT FROM stp.conv_id AND stp.pos = dp.pos + 1)),
best AS (SELECT dp.conv_id, least(s0, s3) AS b FROM dp JOIN (SELECT conv_id, max(pos) AS pos FROM stp GROUP BY conv_id) z ON dp.conv_id IS NOT DISTINCT FROM z.conv_id AND dp.pos = z.pos),
ops AS (SELECT conv_id, len(replace(b.audit, 'D', '')) % 2 AS sys, unnest(string_split(b.audit, '')) AS op, generate_subscripts(string_split(b.audit, ''), 1) AS o FROM best WHERE b.audit <> ''),
opn AS (SELECT *, sum(CASE WHEN op <> 'D' THEN 1 ELSE 0 END) OVER g AS k, sum(CASE WHEN op <> 'I' THEN 1 ELSE 0 END) OVER g AS p FROM ops WINDOW g AS (PARTITION BY conv_id ORDER BY o ROWS UNBOUNDED PRECEDING)),
said AS (SELECT opn.conv_id, k, CASE WHEN op = 'K' THEN role WHEN (k - sys) % 2 = 1 THEN 'user' ELSE 'assistant' END || ':' || CASE WHEN op = 'I' THEN '' ELSE text END AS line
  FROM opn LEFT JOIN fl ON opn.conv_id IS NOT DISTINCT FROM fl.conv_id AND fl.pos = opn.p AND op <> 'I' WHERE op <> 'D'),
sha AS (SELECT conv_id, sha256(string_agg(line, chr(10) ORDER BY k)) AS h FROM said GROUP BY conv_id),
cnt AS (SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (fault = 'blank') AS blank, count(*) FILTER (fault = 'duplicate') AS duplicate, count(*) FILTER (fault = 'truncated') AS truncated, count(*) FILTER (illegal) AS illegal FROM fl GROUP BY conv_id)
SELECT e.conv_id, coalesce(gaps, 0)::BIGINT AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal, coalesce(b.cost, 0) AS cost, coalesce(b.audit, '') AS audit, coalesce(h, sha256('')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) e LEFT JOIN cnt ON e.conv_id IS NOT DISTINCT FROM cnt.conv_id LEFT JOIN best ON e.conv_id IS NOT DISTINCT FROM best.conv_id LEFT JOIN sha ON e.conv_id IS NOT DISTINCT FROM sha.conv_id
"""

OP13_SQL = r"""
WITH pc AS (SELECT lang, pid, regexp_extract_all(piece, '[^\x20\x09]+') AS w FROM (
  SELECT lang, row_number() OVER () AS pid, piece FROM (SELECT coalesce(lang, 'und') AS lang, unnest(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece FROM documents))),
pos AS (SELECT lang, w, unnest(range(1, len(w) + 1)) AS i FROM pc),
gr AS (SELECT lang, k, array_to_string(w[i:i + k - 1], ' ') AS g, count(*)::HUGEINT AS f FROM pos, (VALUES (1), (2), (3), (4)) t(k) WHERE i + k - 1 <= len(w) GROUP BY ALL),
tot AS (SELECT lang, sum(len(w))::HUGEINT AS n FROM pc GROUP BY lang),
fr AS (SELECT * FROM gr WHERE f >= 30),
ct AS (SELECT lang, g, k, f AS a, j, array_to_string(string_split(g, ' ')[1:j], ' ') AS lg, array_to_string(string_split(g, ' ')[j + 1:], ' ') AS rg FROM (SELECT *, unnest(range(1, k)) AS j FROM fr WHERE k > 1)),
sc AS (SELECT ct.*, x.f AS l, y.f AS r, (2000000::HUGEINT * a) // (x.f + y.f) AS score FROM ct JOIN fr x ON x.lang = ct.lang AND x.g = lg JOIN fr y ON y.lang = ct.lang AND y.g = rg),
bs AS (SELECT * FROM sc QUALIFY row_number() OVER (PARTITION BY lang, g ORDER BY score, j) = 1),
cv AS (SELECT s.lang, s.g FROM (SELECT lang, f, k, unnest(list_concat(
    list_transform(range(1, k), lambda i: array_to_string(string_split(g, ' ')[i:i + 1], ' ')),
    CASE WHEN k = 4 THEN list_transform(range(1, 3), lambda i: array_to_string(string_split(g, ' ')[i:i + 2], ' ')) ELSE [] END)) AS g FROM fr WHERE k > 2) s JOIN fr c ON c.lang = s.lang AND c.g = s.g WHERE 100 * s.f >= 80 * c.f GROUP BY ALL),
kp AS (SELECT bs.* FROM bs ANTI JOIN cv ON bs.lang = cv.lang AND bs.g = cv.g),
rk AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, g) AS rank FROM kp)
SELECT lang, rank, g AS phrase, a::BIGINT AS a, l::BIGINT AS l, r::BIGINT AS r, n::BIGINT AS n, score::BIGINT AS score FROM rk JOIN tot USING (lang) WHERE rank <= 2000
"""

ORACLE_SQL = {"op11_host_rules": OP11_SQL, "op12_turn_repair": OP12_SQL, "op13_collocations": OP13_SQL}
