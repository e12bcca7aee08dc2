"""Queries over predictions: what the rails' posteriors on spliced documents say of them as a detector."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .functions import language
from .functions import text as T
from .functions import values as V
from .operators import metrics, rails, train
from .queries_base import ORACLES, q, query, spliced, sql_clauses, sql_list, sql_matching, sql_words, table
from .queries_stats import NAMES, SQL_FIRED, SQL_POSTERIOR, judged, observations

CUT = 0.05
N = len(V.INJECTIONS)
STATUS = "CASE lang WHEN 'en' THEN 'ok' WHEN 'es' THEN 'error' ELSE 'abstained' END"
GROUP = "concat(source, ':', CAST(doc_id % 40 AS STRING))"
FAMILY = f"CASE WHEN doc_id % 5 = 0 THEN concat('f', CAST(doc_id % {N} AS STRING)) END"


def cases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as cases: those with a spliced injection are attacks; texts in languages the rails do not read are not judged."""
    d = table(spark, sf_dir, "documents")
    return d.select(F.col("doc_id").alias("case_id"), F.expr(GROUP).alias("grp"), F.expr(FAMILY).alias("family"), F.col("lang").alias("language"), F.col("source").alias("origin"), (F.col("doc_id") % 5 == 0).alias("attack"), F.expr(STATUS).alias("status"), F.length("text").alias("size"))


#: Groups that are sent to all documents; with more of them all texts are judged, and joined with their roles afterwards.
FEW_GROUPS = 1 << 16


def predictions(spark: SparkSession, sf_dir: str, only: list[str] | None = None, where: str = "true") -> DataFrame:
    """Cases with role, bits and score, of some roles and of documents with a property; texts of others are not judged."""
    c = cases(spark, sf_dir)
    roles = train.grouped_split(c, "grp", "attack", "eval").select("grp", "role")
    of = None
    if only is not None:
        roles = roles.where(F.col("role").isin(only))
        few = roles.limit(FEW_GROUPS + 1).count() <= FEW_GROUPS

        def of(d: DataFrame) -> DataFrame:
            d = d.where(where)
            return d.withColumn("grp", F.expr(GROUP)).join(F.broadcast(roles), "grp", "left_semi") if few else d  # at most FEW_GROUPS rows

    j = judged(spark, sf_dir, of).select(F.col("doc_id").alias("case_id"), F.round("posterior", 9).alias("p"), F.round("bits", 9).alias("bits"))
    return c.join(j, "case_id").join(roles, "grp").withColumn("score", F.when(F.col("status") == "ok", F.col("p"))).drop("p")


_G = GROUP.replace("STRING", "VARCHAR")
SQL_CASES = f"(SELECT doc_id AS case_id, {_G} AS grp, {FAMILY.replace('STRING', 'VARCHAR')} AS family, lang AS language, source AS origin, doc_id % 5 = 0 AS attack, {STATUS} AS status, length(text) AS size FROM documents)"
SQL_ROLES = f"(SELECT grp, ({sql_list(train.ROLES)})[(row_number() OVER (PARTITION BY labels ORDER BY sha256('eval' || chr(0) || grp), grp) - 1) % 8 + 1] AS role FROM (SELECT grp, string_agg(DISTINCT CAST(attack AS VARCHAR), '/' ORDER BY CAST(attack AS VARCHAR)) AS labels FROM {SQL_CASES} GROUP BY 1))"
PRED = f"WITH pred AS MATERIALIZED (SELECT c.*, r.role, round(bits, 9) AS bits, CASE WHEN status = 'ok' THEN round(p, 9) END AS score FROM {SQL_CASES} c JOIN ({SQL_POSTERIOR}) s ON s.doc_id = c.case_id JOIN {SQL_ROLES} r USING (grp)), eff AS (SELECT *, coalesce(score, CASE WHEN attack THEN 0.0 ELSE 1.0 END) AS e FROM pred) "


def rounded(df: DataFrame, *names: str, digits: int = 6) -> DataFrame:
    return df.withColumns({n: F.round(n, digits) for n in names})


@query(f"{PRED} SELECT COUNT(*) FILTER (attack AND e >= {CUT}) AS tp, COUNT(*) FILTER (attack AND e < {CUT}) AS fn, COUNT(*) FILTER (NOT attack AND e >= {CUT}) AS fp, COUNT(*) FILTER (NOT attack AND e < {CUT}) AS tn FROM eff")
def confusion_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.confusion(predictions(spark, sf_dir), CUT)


_POINTS = "pts AS (SELECT t, (SELECT COUNT(*) FILTER (attack AND e >= t) / COUNT(*) FILTER (attack) FROM eff) AS tpr, (SELECT COUNT(*) FILTER (NOT attack AND e >= t) / COUNT(*) FILTER (NOT attack) FROM eff) AS fpr FROM (SELECT DISTINCT e AS t FROM eff UNION ALL SELECT 2.0))"
_FIXED = " UNION ALL ".join(
    [f"SELECT 'detection' AS kind, {x!r}::DOUBLE AS at, round(coalesce(max(CASE WHEN fpr <= {x!r} THEN tpr END), 0), 6) AS value FROM pts" for x in metrics.FIXED_FALSE_POSITIVE_RATES]
    + [f"SELECT 'false_positive_rate', {x!r}::DOUBLE, round(min(CASE WHEN tpr >= {x!r} THEN fpr END), 6) FROM pts" for x in metrics.FIXED_TRUE_POSITIVE_RATES]
)


@query(f"{PRED}, {_POINTS} {_FIXED}")
def fixed_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(metrics.fixed_rates(predictions(spark, sf_dir)), "value")


@query(f"{PRED} SELECT COUNT(*) AS denominator, COUNT(score) AS retained, round(COUNT(score) / COUNT(*), 6) AS coverage, round(COUNT(*) FILTER (score IS NOT NULL AND (score >= {CUT}) <> attack) / COUNT(score), 6) AS risk FROM pred")
def selective_risk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(metrics.selective(predictions(spark, sf_dir), CUT), "coverage", "risk")


def _rate(of: str, base: str) -> str:
    return f"round(COUNT(*) FILTER (({of}) AND {base}) / COUNT(*) FILTER ({base}), 6)"


@query(
    f"{PRED} SELECT {_rate(f'score >= {CUT}', 'attack')} AS security_success, {_rate(f'score < {CUT}', 'attack')} AS attack_success, {_rate(f'score < {CUT}', 'NOT attack')} AS benign_utility, {_rate('score IS NOT NULL', 'attack')} AS utility_under_attack, {_rate(f'score >= {CUT} AND family IS NOT NULL', 'attack')} AS secure_utility FROM pred"
)
def outcome_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = metrics.outcomes(predictions(spark, sf_dir), CUT)
    return rounded(o, *o.columns)


_STATUS_COUNTS = ", ".join(f"COUNT(*) FILTER (status = '{x}') AS {x}" for x in ("ok", "abstained", "error"))
_FIELDS = ["family", "language", "origin", "role", "grp"]


@query(f"{PRED} SELECT field, value, COUNT(*) AS n, {_STATUS_COUNTS}, COUNT(*) FILTER (attack) AS attacks FROM (" + " UNION ALL ".join(f"SELECT '{f}' AS field, {f} AS value, status, attack FROM pred" for f in _FIELDS) + ") WHERE value IS NOT NULL GROUP BY 1, 2")
def prediction_strata(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.strata(predictions(spark, sf_dir), _FIELDS)


@query(f"{PRED} SELECT role, COUNT(*) AS n, COUNT(*) FILTER (attack) AS attacks, COUNT(DISTINCT grp) AS groups, {_STATUS_COUNTS} FROM pred GROUP BY 1")
def role_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.role_summary(predictions(spark, sf_dir))


@query(f"{PRED}, t AS (SELECT CAST(ceil(max(bits)) AS BIGINT) AS threshold FROM pred WHERE role = 'threshold' AND NOT attack) SELECT threshold, COUNT(*) FILTER (attack AND bits > threshold) AS caught, COUNT(*) FILTER (attack) AS attacks, COUNT(*) FILTER (NOT attack AND bits > threshold) AS flagged, COUNT(*) FILTER (NOT attack) AS benign FROM pred, t WHERE role = 'test' GROUP BY 1")
def threshold_performance(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.performance(predictions(spark, sf_dir, ["threshold", "test"]))


@query(f"{PRED} SELECT " + "CASE " + " ".join(f"WHEN bits > {e!r} THEN {i + 1}" for i, e in reversed(list(enumerate(metrics.EDGES)))) + " ELSE 0 END AS band, COUNT(*) FILTER (attack) AS attacks, COUNT(*) FILTER (NOT attack) AS benign FROM pred WHERE role = 'calibration' GROUP BY 1")
def calibration_bands(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.bands(predictions(spark, sf_dir))


@query(
    f"{PRED}, f AS (SELECT case_id % 5 AS fold, bits, attack FROM pred), s AS (SELECT fold, list(bits ORDER BY bits) AS b, CAST(floor(COUNT(*) * 0.1) AS BIGINT) AS allowed FROM f WHERE NOT attack GROUP BY 1), t AS (SELECT fold, b[greatest(len(b) - allowed, 1)] AS threshold FROM s) "
    "SELECT fold, threshold, COUNT(*) FILTER (attack) AS attacks, COUNT(*) FILTER (NOT attack) AS benign, COUNT(*) FILTER (attack AND bits > threshold) AS caught, COUNT(*) FILTER (NOT attack AND bits > threshold) AS flagged FROM f JOIN t USING (fold) GROUP BY 1, 2"
)
def matched_folds(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.matched(predictions(spark, sf_dir), 0.1)


@query(f"SELECT family, COUNT(*) AS n, COUNT(*) FILTER ({' OR '.join(NAMES)}) AS caught FROM {SQL_FIRED} f JOIN {SQL_CASES} c ON c.case_id = f.doc_id WHERE family IS NOT NULL GROUP BY 1")
def family_catches(spark: SparkSession, sf_dir: str) -> DataFrame:
    hit = observations(spark, sf_dir).groupBy("doc_id").agg(F.max("fired").alias("hit"))
    c = cases(spark, sf_dir).where("family is not null").join(hit, F.col("case_id") == F.col("doc_id"))
    return c.groupBy("family").agg(F.count(F.lit(1)).alias("n"), F.count_if("hit").alias("caught"))


@query(f"{PRED} SELECT family, COUNT(*) AS n, round(avg(bits), 6) AS mean, round(CASE WHEN COUNT(*) > 1 THEN var_samp(bits) / COUNT(*) ELSE 1.0 END, 6) AS variance FROM pred WHERE attack GROUP BY 1")
def family_composition(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(metrics.families(predictions(spark, sf_dir)), "mean", "variance")


@query(
    f"{PRED}, s AS (SELECT avg(bits) AS mb, stddev_samp(bits) AS sb, avg(size) AS ml, stddev_samp(size) AS sl FROM pred WHERE role = 'train'), d AS (SELECT case_id, role, (pow((bits - mb) / CASE WHEN sb <= 1e-12 THEN 1 ELSE sb END, 2) + pow((size - ml) / CASE WHEN sl <= 1e-12 THEN 1 ELSE sl END, 2)) / 2 AS d FROM pred, s) SELECT case_id, round(d, 6) AS distance, d > (SELECT max(d) FROM d WHERE role = 'train') AS outside FROM d"
)
def out_of_range(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cases farther from the training role, in bits and size, than any of its own."""
    p = predictions(spark, sf_dir).withColumn("size", F.col("size").cast("double"))
    return rounded(metrics.distances(p, ["bits", "size"], F.col("role") == "train").select("case_id", "distance", "outside"), "distance")


@query(f"{PRED} SELECT role, min(bits) AS low, max(bits) AS high, array_to_string(list_sort(list(DISTINCT family) FILTER (family IS NOT NULL)), ',') AS families FROM pred GROUP BY 1")
def score_ranges(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = predictions(spark, sf_dir)  # families are few: a fixed list
    return p.groupBy("role").agg(F.min("bits").alias("low"), F.max("bits").alias("high"), F.array_join(F.array_sort(F.collect_set("family")), ",").alias("families"))


@query(f"{PRED}, l AS (SELECT language, min(bits) FILTER (attack) AS a, max(bits) FILTER (NOT attack) AS b FROM pred GROUP BY 1) SELECT language, a > b AS separable, CASE WHEN a > b THEN round((a + b) / 2, 6) END AS threshold FROM l")
def calibration_probe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A threshold half way between the classes of a language where they do not overlap, else none."""
    g = predictions(spark, sf_dir).groupBy("language").agg(F.min(F.when(F.col("attack"), F.col("bits"))).alias("a"), F.max(F.when(~F.col("attack"), F.col("bits"))).alias("b"))
    return g.select("language", (F.col("a") > F.col("b")).alias("separable"), F.when(F.col("a") > F.col("b"), F.round((F.col("a") + F.col("b")) / 2, 6)).alias("threshold"))


@query(
    f"SELECT origin, round((1.0 + h) / (100.0 + n), 9) AS mean, round((1.0 + h) * (99.0 + n - h) / (pow(100.0 + n, 2) * (101.0 + n)), 12) AS variance FROM (SELECT origin, COUNT(*) FILTER (attack) AS h, COUNT(*) AS n FROM {SQL_CASES} GROUP BY 1)"
)
def prevalence_update(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Beta-binomial prevalence of attacks by origin, from a prior of 1 in 100."""
    g = cases(spark, sf_dir).groupBy("origin").agg(F.count_if("attack").alias("h"), F.count(F.lit(1)).alias("n"))
    a, b = F.lit(1.0) + F.col("h"), F.lit(99.0) + F.col("n") - F.col("h")
    return g.select("origin", F.round(a / (a + b), 9).alias("mean"), F.round(a * b / ((a + b) * (a + b) * (a + b + 1)), 12).alias("variance"))


@query(f"SELECT family, COUNT(*) AS n, round((1.0 + COUNT(*)) / ((SELECT COUNT(DISTINCT family) FROM {SQL_CASES}) + (SELECT COUNT(family) FROM {SQL_CASES})), 9) AS share FROM {SQL_CASES} WHERE family IS NOT NULL GROUP BY 1")
def threat_update(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Dirichlet shares of attack families, from one of each."""
    g = cases(spark, sf_dir).where("family is not null").groupBy("family").agg(F.count(F.lit(1)).alias("n"))
    return g.crossJoin(F.broadcast(g.agg(F.count(F.lit(1)).alias("k"), F.sum("n").alias("m")))).select("family", "n", F.round((1.0 + F.col("n")) / (F.col("k") + F.col("m")), 9).alias("share"))  # one row


_CHECKS = {
    "missing_field": "COUNT(*) FILTER (case_id IS NULL OR role IS NULL OR attack IS NULL)",
    "unknown_status": "COUNT(*) FILTER (status NOT IN ('ok', 'abstained', 'error') OR status IS NULL)",
    "score_against_status": "COUNT(*) FILTER ((status = 'ok') <> (score IS NOT NULL))",
    "score_out_of_range": "COUNT(*) FILTER (score < 0 OR score > 1)",
    "repeated_case": "COUNT(*) - COUNT(DISTINCT case_id)",
}


@query(f"{PRED} " + " UNION ALL ".join(f"SELECT '{k}' AS \"check\", {v} AS n FROM pred" for k, v in _CHECKS.items()) + " UNION ALL SELECT 'group_in_several_roles', COUNT(*) FROM (SELECT grp FROM pred GROUP BY 1 HAVING COUNT(DISTINCT role) > 1)")
def prediction_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.violations(predictions(spark, sf_dir))


@query(f"SELECT rail, COUNT(*) AS texts, CAST(SUM(size) AS BIGINT) AS characters FROM (SELECT UNNEST({sql_list(NAMES)}) AS rail, size FROM {SQL_CASES}) GROUP BY 1")
def reader_costs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Characters that each rail reads."""
    c = cases(spark, sf_dir).select(F.explode(T.strings(NAMES)).alias("rail"), "size")
    return c.groupBy("rail").agg(F.count(F.lit(1)).alias("texts"), F.sum("size").cast("long").alias("characters"))


_REASON = "CASE WHEN {p} IS NULL THEN 'missing' WHEN status <> 'ok' THEN 'not_ok' WHEN model <> 'm1' THEN 'model' WHEN side <> 'context' THEN 'side' END"


@query(
    f"SELECT case_id, reader, {_REASON.format(p='present')} AS reason FROM (SELECT case_id, reader, CASE WHEN (case_id + i) % 11 <> 0 THEN 1 END AS present, status, CASE WHEN case_id % 50 = 7 THEN 'm0' ELSE 'm1' END AS model, CASE WHEN case_id % 17 = 3 THEN 'input' ELSE 'context' END AS side FROM (SELECT *, UNNEST({sql_list(NAMES)}) AS reader, UNNEST(range({len(NAMES)})) AS i FROM {SQL_CASES})) WHERE {_REASON.format(p='present')} IS NOT NULL"
)
def reader_abstentions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Why a reader's result does not count as a feature: the first reason in a fixed order."""
    c = cases(spark, sf_dir).select("case_id", "status", F.posexplode(T.strings(NAMES)).alias("i", "reader"))
    c = c.withColumns({"present": F.when((F.col("case_id") + F.col("i")) % 11 != 0, 1), "model": F.when(F.col("case_id") % 50 == 7, "m0").otherwise("m1"), "side": F.when(F.col("case_id") % 17 == 3, "input").otherwise("context")})
    return c.select("case_id", "reader", F.expr(_REASON.format(p="present")).alias("reason")).where("reason is not null")


@query("SELECT event_type, COUNT(*) AS n, round(quantile_cont(value, 0.5), 6) AS median, round(quantile_cont(value, 0.95), 6) AS p95, round(quantile_cont(value, 0.95) / quantile_cont(value, 0.5), 6) AS growth FROM events GROUP BY 1")
def latency_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = table(spark, sf_dir, "events").groupBy("event_type").agg(F.count(F.lit(1)).alias("n"), F.percentile("value", 0.5).alias("median"), F.percentile("value", 0.95).alias("p95"))
    return rounded(g.withColumn("growth", F.col("p95") / F.col("median")), "median", "p95", "growth")


@query("SELECT kind, COUNT(*) AS n FROM (SELECT DISTINCT 'document' AS kind, text FROM documents UNION SELECT DISTINCT 'item', text FROM benchmark UNION SELECT DISTINCT 'turn', text FROM conversations) GROUP BY 1")
def corpus_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distinct texts of several corpora, by hash."""
    every = None
    for kind, name in (("document", "documents"), ("item", "benchmark"), ("turn", "conversations")):
        one = table(spark, sf_dir, name).select(F.lit(kind).alias("kind"), F.sha2("text", 256).alias("h"))
        every = one if every is None else every.unionByName(one)
    return every.distinct().groupBy("kind").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT doc_id FROM documents EXCEPT SELECT doc_id FROM labels")
def unlabelled(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id").distinct().join(table(spark, sf_dir, "labels").select("doc_id"), "doc_id", "left_anti")


@query(
    f"WITH c AS (SELECT doc_id, {sql_clauses('text')} AS c FROM documents), l AS (SELECT doc_id, len(c) AS clauses, list_transform(list_sort(list_transform(list_zip(c, range(len(c))), lambda z: {{'n': -len(z[1]), 'k': z[2], 'c': z[1]}}))[:64], lambda z: z.c) AS l FROM c) "
    "SELECT doc_id, clauses, CAST(coalesce(list_sum(list_transform(l, lambda x: len(x))), 0) AS BIGINT) AS characters, sha256(array_to_string(l, chr(10))) AS longest FROM l"
)
def longest_clauses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 64 longest clauses of each document, longest first, of equal ones the earlier."""
    d = table(spark, sf_dir, "documents").select("doc_id", T.clauses(F.col("text")).alias("c"))
    d = d.select("doc_id", F.size("c").cast("long").alias("clauses"), T.longest(F.col("c"), 64).alias("l"))
    return d.select("doc_id", "clauses", F.aggregate("l", F.lit(0).cast("long"), lambda a, x: a + F.length(x)).alias("characters"), F.sha2(F.array_join("l", "\n"), 256).alias("longest"))


@query(
    ORACLES["ngram_language"].replace("SELECT doc_id, lang, CAST(dist AS BIGINT) AS distance FROM d", "")
    + f""", o AS (SELECT doc_id, lang, dist, row_number() OVER (PARTITION BY doc_id ORDER BY dist, lang) AS k, lead(dist) OVER (PARTITION BY doc_id ORDER BY dist, lang) AS second FROM d),
t AS (SELECT doc_id, len({sql_words("text")}) AS n FROM documents), e AS (SELECT doc_id, COUNT(*) AS grams FROM r GROUP BY 1)
SELECT doc_id, CASE WHEN n >= 6 AND grams >= 8 AND dist < 0.85 * second THEN lang ELSE 'unknown' END AS language, n >= 6 AND grams >= 8 AND dist < 0.85 * second AND lang NOT IN ('en', 'nl') AS foreign_named FROM o JOIN t USING (doc_id) JOIN e USING (doc_id) WHERE k = 1"""
)
def named_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The language that the n-gram profile names: clearly nearer than the second, of at least six words and eight n-grams."""
    d = table(spark, sf_dir, "documents").select("doc_id", T.words(F.col("text")).alias("w"))
    d = d.select("doc_id", language.named_by(F.size("w"), language.measured(F.col("w"))).alias("language"))
    return d.withColumn("foreign_named", (F.col("language") != "unknown") & ~F.col("language").isin("en", "nl"))


@query(
    f"WITH c AS (SELECT doc_id, {sql_clauses('text')} AS c FROM (SELECT * FROM {SQL_FIRED}) f JOIN (SELECT doc_id, text FROM (SELECT doc_id, CASE WHEN doc_id % 5 = 0 THEN text || chr(10) || chr(10) || ({sql_list(V.INJECTIONS)})[(doc_id % {N}) + 1] ELSE text END AS text FROM documents)) d USING (doc_id) WHERE injected_instructions), f AS (SELECT doc_id, list_filter(c, lambda x: {' OR '.join(f'regexp_matches(x, {q(p)})' for p in V.INJECTED_PATTERNS.values())}) AS hits FROM c) SELECT doc_id, CASE WHEN len(hits) > 0 THEN hits[1] ELSE '(whole document)' END AS clause FROM f"
)
def first_firing_clause(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For each document that a rail objects to, the first clause it objects to, else a note."""
    any_of = lambda c: F.size(rails.matching(c, V.INJECTED_PATTERNS)) > 0
    d = spliced(spark, sf_dir).where(any_of(F.col("text")))
    return d.select("doc_id", F.coalesce(F.get(F.filter(T.clauses(F.col("text")), any_of), F.lit(0)), F.lit("(whole document)")).alias("clause"))


TRUST = "CASE role WHEN 'system' THEN 3 WHEN 'assistant' THEN 2 ELSE 1 END"
SECRET = "CASE WHEN regexp_like(text, '[0-9]') THEN 1 ELSE 0 END"
_RUN = "OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)"


@query(f"SELECT conv_id, turn, min({TRUST}) {_RUN} AS trust, max({SECRET.replace('regexp_like', 'regexp_matches')}) {_RUN} AS secrecy, min({TRUST}) {_RUN} >= 2 AND max({SECRET.replace('regexp_like', 'regexp_matches')}) {_RUN} = 0 AS permitted FROM conversations")
def turn_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The mixed label of what a turn has seen: least trust, most secrecy; a sink admits trusted, open content."""
    t = table(spark, sf_dir, "conversations").select("conv_id", "turn", F.expr(f"min({TRUST}) {_RUN}").alias("trust"), F.expr(f"max({SECRET}) {_RUN}").alias("secrecy"))
    return t.withColumn("permitted", (F.col("trust") >= 2) & (F.col("secrecy") == 0))


TYPES = {"click": (20, 50.0), "view": (10, 30.0), "purchase": (3, 80.0)}
_LIMITS = "(VALUES " + ", ".join(f"('{k}', {m}, {t!r})" for k, (m, t) in TYPES.items()) + ") g(event_type, most, top)"


@query(f"SELECT event_id, CASE WHEN g.event_type IS NULL THEN 'no_grant' WHEN uses >= most THEN 'use_count' WHEN value > top THEN 'constraint' ELSE 'allowed' END AS verdict FROM (SELECT *, COUNT(*) OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id) - 1 AS uses FROM events) e LEFT JOIN {_LIMITS} USING (event_type)")
def call_denials(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Calls of each user against grants by tool, with use counts in order: the first denial of a fixed order."""
    w = Window.partitionBy("user_id", "event_type").orderBy("ts", "event_id")
    e = table(spark, sf_dir, "events").select("event_id", "event_type", "value", (F.row_number().over(w) - 1).alias("uses"))
    g = spark.createDataFrame([(k, m, t) for k, (m, t) in TYPES.items()], "event_type string, most int, top double").withColumn("granted", F.lit(True))
    j = e.join(F.broadcast(g), "event_type", "left")  # a fixed table
    v = F.when(F.col("granted").isNull(), "no_grant").when(F.col("uses") >= F.col("most"), "use_count").when(F.col("value") > F.col("top"), "constraint").otherwise("allowed")
    return j.select("event_id", v.alias("verdict"))


@query("SELECT event_id, row_number() OVER (PARTITION BY user_id, props ORDER BY ts, event_id) = 1 AS claimed FROM events")
def claims_once(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A confirmation is claimed once: of equal keys of a user the first event has it."""
    w = Window.partitionBy("user_id", "props").orderBy("ts", "event_id")
    return table(spark, sf_dir, "events").select("event_id", (F.row_number().over(w) == 1).alias("claimed"))
