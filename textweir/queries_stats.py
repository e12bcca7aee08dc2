"""Queries over evidence, sessions, training and evaluation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .functions import stats as S
from .functions import text as T
from .functions import values as V
from .operators import assess, evaluate, nearness, rails, session, train
from .plans.escalation import escalate
from .queries_base import SPLICED, q, query, spliced, sql_list, sql_matching, sql_normalized, sql_stem, sql_values, sql_words, table


@query(
    "WITH s AS (SELECT vec_id, embedding FROM embeddings WHERE vec_id % 100 = 0) SELECT s.vec_id, round(max(list_cosine_similarity(CAST(e.embedding AS DOUBLE[]), CAST(s.embedding AS DOUBLE[]))), 5) AS best FROM s JOIN embeddings e ON e.vec_id <> s.vec_id GROUP BY 1"
)
def embedding_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Highest cosine of each query vector (ids divisible by 100) with any other vector, block of queries by block."""
    e = table(spark, sf_dir, "embeddings").where("vec_id is not null").select(F.col("vec_id").alias("id"), F.col("embedding").alias("v"))
    return nearness.best(e.where("id % 100 = 0"), e).select(F.col("id").alias("vec_id"), F.round("best", 5).alias("best"))


@query("SELECT user_id, round(max(m), 6) AS worst FROM (SELECT user_id, avg(value) OVER w AS m, count(*) OVER w AS n FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN CURRENT ROW AND 15 FOLLOWING)) WHERE n = 16 GROUP BY 1")
def worst_window(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The highest mean of 16 consecutive values: the perplexity rail's window over a series."""
    w = Window.partitionBy("user_id").orderBy("ts", "event_id").rowsBetween(0, 15)
    e = table(spark, sf_dir, "events").select("user_id", F.avg("value").over(w).alias("m"), F.count(F.lit(1)).over(w).alias("n"))
    return e.where("n = 16").groupBy("user_id").agg(F.round(F.max("m"), 6).alias("worst"))


def sql_content(c: str) -> str:
    return f"list_filter({sql_words(c)}, lambda x: NOT list_contains({sql_list(V.STOP_WORDS)}, x))"




RAILS = {"injected_instructions": V.INJECTED_PATTERNS, "jailbreak": V.JAILBREAK_PATTERNS}


def fired(spark: SparkSession, sf_dir: str, of=None) -> DataFrame:
    """(doc_id, one boolean per rail) over spliced documents, or those that of() leaves of them."""
    d = spliced(spark, sf_dir)
    d = d if of is None else of(d)
    turns = sum(F.regexp_count("text", F.lit(p)) for p in V.TURN_PATTERNS) > 4
    return d.select("doc_id", *[rails.any_match(F.col("text"), p).alias(r) for r, p in RAILS.items()], turns.alias("many_shot"))


SQL_FIRED = f"(SELECT doc_id, {', '.join(f'len({sql_matching(p)}) > 0 AS {r}' for r, p in RAILS.items())}, {' + '.join(f'len(regexp_extract_all(text, {q(p)}))' for p in V.TURN_PATTERNS)} > 4 AS many_shot FROM {SPLICED})"
NAMES = [*RAILS, "many_shot"]
WEIGHTS = [(r, y, n) for r, _, _, y, n in assess.weights("context")]
SQL_BITS = f"SELECT doc_id, SUM(CAST(CASE WHEN fired THEN yes ELSE no END AS DOUBLE)) AS bits FROM (UNPIVOT {SQL_FIRED} ON {', '.join(NAMES)} INTO NAME rail VALUE fired) JOIN {sql_values(WEIGHTS, 'rail, yes, no')} USING (rail) GROUP BY 1"
PRIOR = 0.01
SQL_POSTERIOR = f"SELECT doc_id, bits, {PRIOR / (1 - PRIOR)!r} * pow(2, bits) / (1 + {PRIOR / (1 - PRIOR)!r} * pow(2, bits)) AS p FROM ({SQL_BITS})"


def observations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fired(spark, sf_dir).unpivot("doc_id", NAMES, "rail", "fired")


def judged(spark: SparkSession, sf_dir: str, of=None) -> DataFrame:
    return assess.judged(fired(spark, sf_dir, of), "doc_id", NAMES, "context", PRIOR)


@query(f"SELECT doc_id, round(bits, 6) AS bits, round(p, 6) AS posterior, CASE WHEN p >= 0.5 THEN 'block' WHEN p >= 0.05 THEN 'review' ELSE 'allow' END AS action FROM ({SQL_POSTERIOR})")
def posterior_by_doc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judged(spark, sf_dir).select("doc_id", F.round("bits", 6).alias("bits"), F.round("posterior", 6).alias("posterior"), "action")


_YES, _NO = next((y, n) for r, y, n in WEIGHTS if r == "many_shot")
_ACT = "CASE WHEN {0} / (1 + {0}) >= 0.5 THEN 'block' WHEN {0} / (1 + {0}) >= 0.05 THEN 'review' ELSE 'allow' END"


def _ends(b: str) -> str:
    return _ACT.format(f"({PRIOR / (1 - PRIOR)!r} * pow(2, {b}))")


_TWO = " + ".join(f"CASE WHEN {r} THEN {y!r} ELSE {n!r} END" for r, y, n in WEIGHTS if r in RAILS)


@query(
    f"WITH f AS (SELECT doc_id, many_shot, {_TWO} AS b FROM {SQL_FIRED}), e AS (SELECT doc_id, b, many_shot, {_ends(f'(b + {min(_YES, _NO, 0.0)!r})')} AS low, {_ends(f'(b + {max(_YES, _NO, 0.0)!r})')} AS high FROM f) "
    f"SELECT doc_id, {_ends(f'(b + CASE WHEN many_shot THEN {_YES!r} ELSE {_NO!r} END)')} AS action, CASE WHEN low = high THEN 2 ELSE 3 END AS looked FROM e"
)
def escalated_actions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is done with each spliced document, and how many rails it took: the last one looks only where it could change that."""
    seen = escalate(spliced(spark, sf_dir), [rails.injected_instructions(), rails.jailbreak()], [rails.many_shot()], PRIOR)
    return seen.select("doc_id", "risk.action", "risk.looked")


@query(f"SELECT doc_id, bucket, row_number() OVER (PARTITION BY bucket ORDER BY CASE WHEN bucket = 'kept' THEN p ELSE -p END, doc_id) AS place FROM (SELECT doc_id, round(p, 9) AS p, CASE WHEN p >= 0.5 THEN 'dropped' WHEN p >= 0.05 THEN 'review' ELSE 'kept' END AS bucket FROM ({SQL_POSTERIOR}))")
def triage_ranking(spark: SparkSession, sf_dir: str) -> DataFrame:
    j = judged(spark, sf_dir).withColumn("posterior", F.round("posterior", 9))
    return assess.triage(j, "doc_id").select("doc_id", "bucket", "place")


@query(f"SELECT rail, COUNT(*) AS n, COUNT(*) FILTER (fired) AS hits FROM (UNPIVOT {SQL_FIRED} ON {', '.join(NAMES)} INTO NAME rail VALUE fired) GROUP BY 1")
def rail_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return observations(spark, sf_dir).groupBy("rail").agg(F.count(F.lit(1)).alias("n"), F.count_if("fired").alias("hits"))


@query(f"SELECT COUNT(*) AS n, COUNT(*) FILTER ({' OR '.join(NAMES)}) AS hits FROM {SQL_FIRED}")
def rail_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    hit = F.col(NAMES[0])
    for r in NAMES[1:]:
        hit = hit | F.col(r)
    return fired(spark, sf_dir).agg(F.count(F.lit(1)).alias("n"), F.count_if(hit).alias("hits"))


@query(
    " UNION ALL ".join(
        f"SELECT {q(a)} AS a, {q(b)} AS b, round(CASE WHEN var_pop(CAST({a} AS INT)) = 0 OR var_pop(CAST({b} AS INT)) = 0 THEN 0 ELSE corr(CAST({a} AS INT), CAST({b} AS INT)) END, 6) AS phi FROM {SQL_FIRED}"
        for i, a in enumerate(NAMES)
        for b in NAMES[i + 1 :]
    )
)
def rail_phi(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluate.phi(fired(spark, sf_dir), NAMES).withColumn("phi", F.round("phi", 6))


#: Every third turn asks for an injection, in the words of the one before it or in its own.
_ASKED = f"({sql_list(V.INJECTIONS)})[(conv_id + turn // 6) % {len(V.INJECTIONS)} + 1]"


def said_turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """conversations with injections in every third turn, and one boolean for each of two rails."""
    t = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    one = F.get(T.strings(V.INJECTIONS), F.pmod(F.col("conv_id") + F.floor(F.col("turn") / 6), F.lit(len(V.INJECTIONS))).cast("int"))
    t = t.withColumn("text", F.when(F.pmod("turn", F.lit(3)) == 0, F.concat(one, F.lit(" "), "text")).otherwise(F.col("text")))
    return t.withColumns({r: rails.any_match(F.col("text"), p) for r, p in RAILS.items()})


SQL_TURNS = f"(SELECT *, {', '.join(f'len({sql_matching(p)}) > 0 AS {r}' for r, p in RAILS.items())} FROM (SELECT conv_id, turn, role, CASE WHEN turn % 3 = 0 THEN {_ASKED} || ' ' || text ELSE text END AS text FROM conversations))"


@query(
    f"WITH t AS (SELECT *, role = 'user' AND (injected_instructions OR jailbreak) AS blocked FROM {SQL_TURNS}), h AS (SELECT conv_id, turn, text, sum(CASE WHEN blocked THEN 1 ELSE 0 END) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN 6 PRECEDING AND 1 PRECEDING) AS recent, last_value(CASE WHEN blocked THEN text END IGNORE NULLS) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS prev FROM t), "
    f"c AS (SELECT *, {sql_content('text')} AS a, {sql_content('prev')} AS b FROM h) "
    f"SELECT conv_id, turn, CASE WHEN recent > 2 THEN 'repeated_refusals' WHEN prev IS NULL THEN NULL WHEN len(a) >= 3 AND len(b) > 0 AND len(list_distinct(list_intersect(a, b))) / len(a) >= 0.6 THEN 'paraphrase' WHEN regexp_matches(text, {q(V.REFRAMING)}) AND len(list_intersect(a, b)) > 0 THEN 'reframed' WHEN regexp_matches(text, {q(V.REFERENCE_BACK)}) THEN 'reference_back' END AS shape FROM c"
)
def escalation_shapes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns that try again what the rails have refused before in their conversation."""
    t = said_turns(spark, sf_dir).withColumn("blocked", (F.col("role") == "user") & (F.col("injected_instructions") | F.col("jailbreak")))
    return session.escalation(t).select("conv_id", "turn", "shape")


#: Bits of a turn: those of two rails for what users write, none for other turns.
SQL_TURN_BITS = "CASE WHEN role = 'user' THEN " + " + ".join(f"CASE WHEN {r} THEN {y!r} ELSE {n!r} END" for r, y, n in WEIGHTS if r in RAILS) + " ELSE 0.0 END"


def turn_bits() -> Column:
    return F.when(F.col("role") == "user", assess.row_bits({r: F.col(r) for r in RAILS}, "context")).otherwise(0.0)


@query(f"SELECT conv_id, COUNT(*) AS turns, round(list_reduce(list_prepend(0.0::DOUBLE, list(CAST({SQL_TURN_BITS} AS DOUBLE) ORDER BY turn)), lambda a, x: a * 0.6 + x), 6) AS excess FROM {SQL_TURNS} GROUP BY 1")
def session_log_odds(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = session.log_odds(said_turns(spark, sf_dir), "conv_id", "turn", turn_bits())
    return f.withColumn("excess", F.round("excess", 6))


@query(
    f"WITH c AS (SELECT conv_id, COUNT(*) AS turns, list_reduce(list_prepend(0.0::DOUBLE, list(CAST({SQL_TURN_BITS} AS DOUBLE) ORDER BY turn)), lambda a, x: greatest(0.0, a * 0.6 + x)) AS c FROM {SQL_TURNS} GROUP BY 1) SELECT conv_id, turns, round(c, 6) AS cusum, CASE WHEN c >= log2(0.95 / 0.01) THEN 'attack' WHEN c <= log2(0.05 / 0.99) THEN 'benign' ELSE 'undecided' END AS verdict FROM c"
)
def session_cusum(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = session.cusum(said_turns(spark, sf_dir), "conv_id", "turn", turn_bits())
    return f.select("conv_id", "turns", F.round("cusum", 6).alias("cusum"), session.sprt(F.col("cusum")).alias("verdict"))


SQL_FEATURES = f"list_distinct(list_concat(s, list_transform(range(greatest(len(s) - 1, 0)), lambda i: s[i + 1] || ' ' || s[i + 2])))"
SQL_BAYES = f"WITH d AS (SELECT d.doc_id, toxic = 1 AS attack, list_transform({sql_words('text')}, lambda w: {sql_stem('w')}) AS s FROM documents d JOIN labels USING (doc_id)), f AS (SELECT attack, UNNEST({SQL_FEATURES}) AS feature FROM d), n AS (SELECT COUNT(*) FILTER (attack) AS na, COUNT(*) FILTER (NOT attack) AS nb FROM d), c AS (SELECT feature, COUNT(*) FILTER (attack) AS a, COUNT(*) FILTER (NOT attack) AS b FROM f GROUP BY 1)"


def sql_cell(x: str, row: str, col: str) -> str:
    return f"CASE WHEN {x} > 0 AND {row} > 0 AND {col} > 0 THEN {x} / (na + nb) * log2({x} * (na + nb) / ({row} * {col})) ELSE 0 END"


SQL_MI = " + ".join(f"{sql_cell(*c)}" for c in (("a", "na", "(a + b)"), ("(na - a)", "na", "(na + nb - a - b)"), ("b", "nb", "(a + b)"), ("(nb - b)", "nb", "(na + nb - a - b)")))


def labelled(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels"), "doc_id").select("doc_id", "text", "lang", "source", "quality", (F.col("toxic") == 1).alias("attack"))


@query(f"{SQL_BAYES} SELECT feature, round(log2(((a + 1) / (na + 2)) / ((b + 1) / (nb + 2))), 4) AS weight FROM (SELECT *, {SQL_MI} AS mi FROM c, n ORDER BY round(mi, 9) DESC, encode(feature) LIMIT 300)")
def bayes_weights(spark: SparkSession, sf_dir: str) -> DataFrame:
    return train.bayes_weights(labelled(spark, sf_dir))


#: Groups of documents of one label, of the other, or of both.
LABEL = "doc_id % 10 < 3 OR doc_id % 10 >= 7 AND doc_id % 3 = 0"
CASES = f"(SELECT source || ':' || CAST(doc_id % 40 AS VARCHAR) AS grp, {LABEL} AS label FROM documents)"


@query(f"WITH g AS (SELECT grp, string_agg(DISTINCT CAST(label AS VARCHAR), '/' ORDER BY CAST(label AS VARCHAR)) AS labels FROM {CASES} GROUP BY 1) SELECT grp, labels, ({sql_list(train.ROLES)})[(row_number() OVER (PARTITION BY labels ORDER BY sha256('seed' || chr(0) || grp), grp) - 1) % 8 + 1] AS role FROM g")
def grouped_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Roles of groups, by the set of labels that their documents have."""
    d = table(spark, sf_dir, "documents").select(F.concat("source", F.lit(":"), (F.col("doc_id") % 40).cast("string")).alias("grp"), F.expr(LABEL).alias("label"))
    return train.grouped_split(d, "grp", "label", "seed")


def scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, attack, lang, source, quality, score): spliced documents with the posterior of the rails that fired on them."""
    d = table(spark, sf_dir, "documents").select("doc_id", "lang", "source", (F.col("doc_id") % 5 == 0).alias("attack"), (F.length("text") % 3).alias("quality"))
    return d.join(judged(spark, sf_dir).select("doc_id", F.round("posterior", 9).alias("score")), "doc_id")


SQL_SCORED = f"(SELECT doc_id, doc_id % 5 = 0 AS attack, lang, source, length(text) % 3 AS quality, round(p, 9) AS score FROM documents JOIN ({SQL_POSTERIOR}) USING (doc_id))"
SQL_CURVE = f"SELECT threshold, tp, fp, (SELECT COUNT(*) FILTER (attack) FROM {SQL_SCORED}) AS p, (SELECT COUNT(*) FILTER (NOT attack) FROM {SQL_SCORED}) AS n FROM (SELECT s AS threshold, SUM(a) OVER (ORDER BY s DESC) AS tp, SUM(b) OVER (ORDER BY s DESC) AS fp FROM (SELECT score AS s, COUNT(*) FILTER (attack) AS a, COUNT(*) FILTER (NOT attack) AS b FROM {SQL_SCORED} GROUP BY 1 UNION ALL SELECT 1 + 1e-15, 0, 0 UNION ALL SELECT -1e-15, 0, 0))"


@query(f"SELECT round(threshold, 9) AS threshold, round(fp / n, 6) AS fpr, round(tp / p, 6) AS tpr FROM ({SQL_CURVE})")
def roc_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = evaluate.roc(scored(spark, sf_dir))
    return r.select(F.round("threshold", 9).alias("threshold"), F.round("fpr", 6).alias("fpr"), F.round("tpr", 6).alias("tpr"))


@query(f"SELECT round(threshold, 9) AS threshold, round(tp / p, 6) AS recall, round(CASE WHEN tp + fp = 0 THEN 1 ELSE tp / (tp + fp) END, 6) AS precision FROM ({SQL_CURVE})")
def pr_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = evaluate.precision_recall(scored(spark, sf_dir))
    return r.select(F.round("threshold", 9).alias("threshold"), F.round("recall", 6).alias("recall"), F.round("precision", 6).alias("precision"))


@query(
    f"WITH c AS (SELECT threshold, fp / n AS x, tp / p AS y, CASE WHEN tp + fp = 0 THEN 1 ELSE tp / (tp + fp) END AS pr FROM ({SQL_CURVE})), l AS (SELECT *, lag(x) OVER (ORDER BY threshold DESC) AS x0, lag(y) OVER (ORDER BY threshold DESC) AS y0 FROM c) SELECT round(SUM((x - x0) * (y + y0) / 2), 6) AS area, round(SUM(CASE WHEN x0 >= 0.1 OR x = x0 THEN 0 ELSE (least(x, 0.1) - x0) * (2 * y0 + (least(x, 0.1) - x0) / (x - x0) * (y - y0)) / 2 END), 6) AS partial, round(SUM(CASE WHEN y > y0 THEN (y - y0) * pr ELSE 0 END), 6) AS average_precision FROM l WHERE x0 IS NOT NULL"
)
def partial_auc(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = evaluate.areas(scored(spark, sf_dir))
    return a.select(*[F.round(c, 6).alias(c) for c in a.columns])


@query(f"SELECT CAST(least(floor(score * 10), 9) AS BIGINT) AS bin, COUNT(*) AS n, round(avg(score), 6) AS mean_score, round(avg(CAST(attack AS INT)), 6) AS attack_rate FROM {SQL_SCORED} GROUP BY 1")
def calibration_bins(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = evaluate.reliability(scored(spark, sf_dir))
    return r.select("bin", "n", F.round("mean_score", 6).alias("mean_score"), F.round("attack_rate", 6).alias("attack_rate"))


@query(
    f"WITH s AS (SELECT score, CAST(attack AS INT) AS y, greatest(1e-15, least(1 - 1e-15, score)) AS p FROM {SQL_SCORED}), b AS (SELECT abs(SUM(score) - SUM(y)) AS gap FROM s GROUP BY least(floor(score * 10), 9)) SELECT round(avg(pow(score - y, 2)), 6) AS brier, round(avg(-(y * ln(p) + (1 - y) * ln(1 - p))), 6) AS log_score, round((SELECT SUM(gap) FROM b) / COUNT(*), 6) AS ece FROM s"
)
def brier(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = evaluate.calibration(scored(spark, sf_dir))
    return c.select(*[F.round(x, 6).alias(x) for x in c.columns])


@query(f"SELECT field, value, COUNT(*) AS n, COUNT(*) FILTER (attack) AS hits, round(COUNT(*) FILTER (attack) / COUNT(*), 6) AS rate FROM (SELECT attack, 'lang' AS field, lang AS value FROM {SQL_SCORED} UNION ALL SELECT attack, 'source', source FROM {SQL_SCORED} UNION ALL SELECT attack, 'quality', CAST(quality AS VARCHAR) FROM {SQL_SCORED}) WHERE value IS NOT NULL GROUP BY 1, 2")
def stratified_outcomes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluate.strata(scored(spark, sf_dir), ["lang", "source", "quality"], "attack").withColumn("rate", F.round("rate", 6))


@query(f"SELECT COUNT(*) AS n, round(avg(CAST(jailbreak AS INT) - CAST(injected_instructions AS INT)), 6) AS difference FROM {SQL_FIRED}")
def paired_difference(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = fired(spark, sf_dir)
    d = evaluate.paired(f.select("doc_id", F.col("injected_instructions").alias("v")), f.select("doc_id", F.col("jailbreak").alias("v")), "doc_id", "v")
    return d.withColumn("difference", F.round("difference", 6))


RADIUS = S.normal_quantile(0.975)


@query(
    f"WITH x AS (SELECT doc_id, (length(text) % 11) / 10.0::DOUBLE AS f, (length(text) % 7) / 6.0::DOUBLE AS g FROM documents), e AS (SELECT doc_id, f, g, -2.0 + f + 2 * g + 0.5 * f * g + 0.2 + 0.1 + ln(0.02 / 0.98) - ln(0.5 / 0.5) AS eta, 0.04 + 0.01 * f * f + 0.02 * g * g + 0.01 * pow(f * g, 2) AS v FROM x) SELECT doc_id, CASE WHEN f > 0.95 THEN 'abstained' ELSE 'ok' END AS status, CASE WHEN f <= 0.95 THEN round(1 / (1 + exp(-eta)), 6) END AS posterior, CASE WHEN f <= 0.95 THEN round(1 / (1 + exp(-(eta - {RADIUS!r} * sqrt(v)))), 6) END AS low, CASE WHEN f <= 0.95 THEN round(1 / (1 + exp(-(eta + {RADIUS!r} * sqrt(v)))), 6) END AS high FROM e"
)
def joint_risk_posterior(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two reader scores with an interaction, offsets of context, prior shift, diagonal variance and a range gate."""
    x = table(spark, sf_dir, "documents").select("doc_id", ((F.length("text") % 11) / 10.0).alias("f"), ((F.length("text") % 7) / 6.0).alias("g"))
    return joint_risk(x, {"f": 1.0, "g": 2.0}, {("f", "g"): 0.5}, -2.0, 0.3, {"": 0.04, "f": 0.01, "g": 0.02, "f*g": 0.01}, 0.02, 0.5, {"f": (0.0, 0.95)})


def joint_risk(x: DataFrame, coefficients: dict, interactions: dict, intercept: float, offset: float, variance: dict, prior: float, trained: float, ranges: dict) -> DataFrame:
    import math

    eta, v = F.lit(intercept + offset + math.log(prior / (1 - prior)) - math.log(trained / (1 - trained))), F.lit(variance.get("", 0.0))
    for n, c in coefficients.items():
        eta, v = eta + c * F.col(n), v + variance.get(n, 0.0) * F.col(n) * F.col(n)
    for (a, b), c in interactions.items():
        both = F.col(a) * F.col(b)
        eta, v = eta + c * both, v + variance.get(f"{a}*{b}", 0.0) * both * both
    ok = F.lit(True)
    for n, (low, high) in ranges.items():
        ok = ok & F.col(n).between(low, high)
    r = RADIUS * F.sqrt(v)
    out = [F.when(ok, F.round(T.logistic(e), 6)).alias(n) for n, e in (("posterior", eta), ("low", eta - r), ("high", eta + r))]
    return x.select("doc_id", F.when(ok, "ok").otherwise("abstained").alias("status"), *out)


@query(f"WITH t AS (SELECT doc_id, '<ref>' || chr(10) || replace(replace(text, '<ref>', ''), '</ref>', '') || chr(10) || '</ref>' AS d, regexp_replace(replace(text, '^', ''), '[ \t]+', '^', 'g') AS m, to_base64(encode(text)) AS e FROM documents) SELECT doc_id, sha256(d) AS delimited, sha256(m) AS marked, sha256(e) AS encoded FROM t")
def spotlight_views(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents")
    return d.select("doc_id", *[F.sha2(f(F.col("text")), 256).alias(n) for n, f in (("delimited", delimited), ("marked", datamarked), ("encoded", encoded))])


def delimited(c: Column, tag: str = "ref") -> Column:
    return F.concat(F.lit(f"<{tag}>\n"), F.replace(F.replace(c, F.lit(f"<{tag}>"), F.lit("")), F.lit(f"</{tag}>"), F.lit("")), F.lit(f"\n</{tag}>"))


def datamarked(c: Column, mark: str = "^") -> Column:
    return F.regexp_replace(F.replace(c, F.lit(mark), F.lit("")), "[ \t]+", mark)


def encoded(c: Column) -> Column:
    return F.replace(F.base64(F.encode(c, "UTF-8")), F.lit("\r\n"), F.lit(""))


@query("SELECT source, sha256(string_agg('[' || CAST(r AS VARCHAR) || '] ' || text, chr(10) || '---' || chr(10) ORDER BY r)) AS prompt FROM (SELECT source, text, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS r FROM documents) WHERE r <= 3 GROUP BY 1")
def spotlight_prompt(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Numbered passages joined into a prompt: the first three of a source, kept by a ranked window that drops the rest early."""
    w = Window.partitionBy("source").orderBy("doc_id")
    top = table(spark, sf_dir, "documents").select("source", "doc_id", "text").withColumn("r", F.row_number().over(w)).where("r <= 3")
    g = top.groupBy("source").agg(F.array_sort(F.collect_list(F.struct("r", "text"))).alias("p"))  # three rows a source
    return g.select("source", F.sha2(F.array_join(F.transform("p", lambda x: F.concat(F.lit("["), x["r"].cast("string"), F.lit("] "), x["text"])), "\n---\n"), 256).alias("prompt"))


LABELS = [(1, "system", ["a", "b"], None), (2, "user,data", [], ["x"]), (3, "user", None, ["x", "y"]), (4, "system,user", ["b", "c"], [])]


@query("SELECT * FROM (VALUES (1, 2, NULL::VARCHAR, 'x'), (1, 3, 'a,b', 'x,y'), (1, 4, 'b', ''), (2, 3, '', 'x'), (2, 4, '', ''), (3, 4, 'b,c', '')) t(l, r, confidentiality, capabilities)".replace("NULL::VARCHAR", "''"))
def label_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labels of provenance mixed pair by pair: restrictions intersect, null means unrestricted."""
    rows = [(i, p.split(","), c, k) for i, p, c, k in LABELS]
    t = spark.createDataFrame(rows, "i int, provenance array<string>, confidentiality array<string>, capabilities array<string>")
    a, b = t.alias("a"), t.alias("b")
    j = a.join(b, F.col("a.i") < F.col("b.i"))
    return j.select(F.col("a.i").alias("l"), F.col("b.i").alias("r"), *[F.array_join(restricted(F.col(f"a.{c}"), F.col(f"b.{c}")), ",").alias(c) for c in ("confidentiality", "capabilities")])


def restricted(a: Column, b: Column) -> Column:
    return F.when(a.isNull(), b).when(b.isNull(), a).otherwise(F.array_intersect(a, b))


CALLS = [(1, "search", 1, 10), (2, "mail", 1, 10), (3, "mail", 3, 10), (4, "shell", 0, 1), (5, "search", 0, 999)]
GRANTS = [("search", 2, 100), ("mail", 2, 50)]


@query(f"SELECT id, CASE WHEN g.tool IS NULL THEN 'no_grant' WHEN uses >= most THEN 'use_count' WHEN amount > top THEN 'constraint' ELSE 'allowed' END AS verdict FROM {sql_values(CALLS, 'id, tool, uses, amount')} c LEFT JOIN {sql_values(GRANTS, 'tool, most, top')} g USING (tool)")
def grant_denials(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stateless denials of tool calls against grants, the first in a fixed order."""
    c = spark.createDataFrame(CALLS, "id int, tool string, uses int, amount int")
    g = spark.createDataFrame(GRANTS, "tool string, most int, top int").withColumn("granted", F.lit(True))
    j = c.join(F.broadcast(g), "tool", "left")  # a fixed table
    v = F.when(F.col("granted").isNull(), "no_grant").when(F.col("uses") >= F.col("most"), "use_count").when(F.col("amount") > F.col("top"), "constraint").otherwise("allowed")
    return j.select("id", v.alias("verdict"))


def sql_fnv(c: str, buckets: int) -> str:
    return f"list_reduce(list_prepend(2166136261::HUGEINT, list_transform(range(CAST(octet_length(encode({c})) AS BIGINT)), lambda i: CAST(('0x' || substr(hex(encode({c})), 2 * i + 1, 2)) AS HUGEINT))), lambda h, b: (xor(h, b) * 16777619) % 4294967296) % {buckets}"


@query(f"WITH w AS (SELECT DISTINCT UNNEST({sql_words('text')}) AS w FROM benchmark) SELECT CAST({sql_fnv('w', 1024)} AS BIGINT) AS bucket, COUNT(*) AS words FROM w GROUP BY 1")
def hashed_buckets(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = table(spark, sf_dir, "benchmark").select(F.explode(T.words(F.col("text"))).alias("w")).distinct()
    return w.groupBy(T.fnv1a(F.col("w"), 1024).alias("bucket")).agg(F.count(F.lit(1)).alias("words"))


@query(f"SELECT source, COUNT(*) AS n, COUNT(*) FILTER (length(text) % 2 = 0) AS hits, round(greatest(0, (h / k + 3.8414588206941 / (2 * k) - 1.959963984540054 * sqrt(h / k * (1 - h / k) / k + 3.8414588206941 / (4 * k * k))) / (1 + 3.8414588206941 / k)), 6) AS low FROM documents, LATERAL (SELECT 0) JOIN (SELECT source, COUNT(*)::DOUBLE AS k, (COUNT(*) FILTER (length(text) % 2 = 0))::DOUBLE AS h FROM documents GROUP BY 1) USING (source) GROUP BY source, h, k".replace(", LATERAL (SELECT 0)", ""))
def wilson_by_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = table(spark, sf_dir, "documents").groupBy("source").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.length("text") % 2 == 0).alias("hits"))
    return g.withColumn("low", F.round(T.wilson(F.col("hits"), F.col("n"))[0], 6))


@query(f"WITH b AS (SELECT item_id, {sql_normalized('text')} AS b FROM benchmark), s AS (SELECT item_id, CASE WHEN len(b) <= 4 THEN [b] ELSE list_distinct(list_transform(range(len(b) - 3), lambda i: substr(b, i + 1, 4))) END AS s FROM b) SELECT x.item_id, y.item_id AS other, round(len(list_intersect(x.s, y.s)) / len(list_distinct(list_concat(x.s, y.s))), 6) AS jaccard FROM s x JOIN s y ON y.item_id = x.item_id + 1")
def shingle_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = table(spark, sf_dir, "benchmark").select("item_id", T.shingles(F.col("text")).alias("s"))
    j = s.join(s.select((F.col("item_id") - 1).alias("item_id"), F.col("item_id").alias("other"), F.col("s").alias("t")), "item_id")
    return j.select("item_id", "other", F.round(T.jaccard(F.col("s"), F.col("t")), 6).alias("jaccard"))
