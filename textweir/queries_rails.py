"""Queries over rails and the language layer."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import concepts as C
from .functions import language
from .functions import text as T
from .functions import values as V
from .operators import rails as R
from .plans.engine import Engine
from .queries_base import CONCEPTS_SQL, ORACLES, SPLICED, q, query, spliced, sql_clauses, sql_list, sql_matching, sql_normalized, sql_stem, sql_values, sql_words, table


def joined(c: Column) -> Column:
    return F.array_join(c, ",")


def screened(spark: SparkSession, sf_dir: str, rail: R.Rail, side: str) -> DataFrame:
    seen = Engine([rail]).run(spliced(spark, sf_dir), side=side)
    return seen.select("doc_id", F.col("verdict.status").alias("status"), joined(F.col("verdict.categories")).alias("categories"))


def sql_screened(patterns: dict[str, str], first_only: bool = False) -> str:
    cats = sql_matching(patterns)
    return f"WITH t AS (SELECT doc_id, {cats} AS c FROM {SPLICED}) SELECT doc_id, CASE WHEN len(c) > 0 THEN 'blocked' ELSE 'passed' END AS status, {'coalesce(c[1], ' + q('') + ')' if first_only else 'array_to_string(c, ' + q(',') + ')'} AS categories FROM t"


@query(sql_screened(V.INJECTED_PATTERNS))
def screen_injected(spark: SparkSession, sf_dir: str) -> DataFrame:
    return screened(spark, sf_dir, R.injected_instructions(), "context")


@query(sql_screened(V.JAILBREAK_PATTERNS))
def screen_jailbreak(spark: SparkSession, sf_dir: str) -> DataFrame:
    return screened(spark, sf_dir, R.jailbreak(), "context")


@query(sql_screened(V.INJECTION_PATTERNS, True))
def pattern_first_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    return screened(spark, sf_dir, R.injection_patterns(), "input")


@query("SELECT doc_id, length(text) > 8000 AS over FROM documents")
def budget_blocked(spark: SparkSession, sf_dir: str) -> DataFrame:
    seen = Engine([R.budget()]).run(table(spark, sf_dir, "documents"))
    return seen.select("doc_id", (F.col("verdict.status") == "blocked").alias("over"))


CANARIES = ["the-an", "erth", "canary-0"]


@query(f"SELECT doc_id, list_bool_or(list_transform({sql_list(CANARIES)}, lambda t: contains(text, t) OR contains(regexp_replace(text, '[^A-Za-z0-9-]', '', 'g'), t))) AS leaked FROM documents")
def canary_hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    seen = Engine([R.canary(CANARIES)]).run(table(spark, sf_dir, "documents"))
    return seen.select("doc_id", (F.col("verdict.status") == "blocked").alias("leaked"))


SHOTS = "<|im_start|>user\nq: one\na: two\n[INST]human: three\nassistant: four\nsystem: five"


@query(
    "WITH t AS (SELECT doc_id, regexp_replace(CASE WHEN doc_id % 7 = 0 THEN text || chr(10) || {} ELSE text END, {}, '', 'g') AS x FROM documents) SELECT doc_id, CAST({} AS BIGINT) AS turns FROM t".format(
        q(SHOTS), q(V.TEMPLATE_TOKENS), " + ".join(f"len(regexp_extract_all(x, {q(p)}))" for p in V.TURN_PATTERNS)
    )
)
def many_shot_turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents")
    x = F.regexp_replace(F.when(F.col("doc_id") % 7 == 0, F.concat("text", F.lit("\n" + SHOTS))).otherwise(F.col("text")), V.TEMPLATE_TOKENS, "")
    return d.select("doc_id", R.turn_count(x).cast("long").alias("turns"))


def sql_replaced(patterns: dict[str, tuple[str, str]], c: str) -> str:
    for p, new in patterns.values():
        c = f"regexp_replace({c}, {q(p)}, {q(new)}, 'g')"
    return c


PERSONAL = {k: (V.PERSONAL_PATTERNS[k], "[redacted]") for k in ("email", "phone", "iban")}


@query(f"SELECT doc_id, sha256({sql_replaced(PERSONAL, 'text')}) AS redacted FROM documents")
def pii_redaction(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The regex part of the personal-data rail; exact exemptions are personal_data_exact."""
    c = F.col("text")
    for p, new in PERSONAL.values():
        c = F.regexp_replace(c, p, new)
    return table(spark, sf_dir, "documents").select("doc_id", F.sha2(c, 256).alias("redacted"))


@query()
def personal_data_exact(spark: SparkSession, sf_dir: str) -> DataFrame:
    seen = Engine([R.personal_data()]).run(table(spark, sf_dir, "documents"))
    return seen.select("doc_id", F.col("verdict.status").alias("status"), joined(F.col("verdict.categories")).alias("categories"), F.sha2("verdict.content", 256).alias("content"))


SQL_SECRETS = {k: (p, new.replace("$1", r"\1")) for k, (p, new) in R.SECRETS.items()}


@query(f"SELECT doc_id, sha256({sql_replaced(SQL_SECRETS, 'text')}) AS redacted FROM documents")
def secret_redaction(spark: SparkSession, sf_dir: str) -> DataFrame:
    seen = Engine([R.secrets()]).run(table(spark, sf_dir, "documents"), side="output")
    return seen.select("doc_id", F.sha2("verdict.content", 256).alias("redacted"))


@query(f"SELECT page_id, sha256({sql_replaced({k: (p, '') for k, p in V.MARKUP_PATTERNS.items()}, 'html')}) AS stripped FROM pages")
def markup_strip(spark: SparkSession, sf_dir: str) -> DataFrame:
    seen = Engine([R.markup()]).run(table(spark, sf_dir, "pages"), text="html", side="output")
    return seen.select("page_id", F.sha2("verdict.content", 256).alias("stripped"))


HREF = r"""(?is)<a\b[^>]*?\bhref\s*=\s*["']?([^"'>\s]+)[^>]*>.*?</a>"""


@query(
    f"WITH u AS (SELECT page_id, UNNEST(regexp_extract_all(html, {q(HREF)}, 1)) AS url FROM pages) SELECT coalesce(h, '') AS host, COUNT(*) AS links, COUNT(DISTINCT page_id) AS pages FROM (SELECT page_id, CASE WHEN regexp_matches(url, '^https?://') THEN lower(regexp_extract(url, '^https?://([^/?#:]+)', 1)) END AS h FROM u) GROUP BY 1"
)
def link_hosts(spark: SparkSession, sf_dir: str) -> DataFrame:
    u = table(spark, sf_dir, "pages").select("page_id", F.explode(F.regexp_extract_all("html", F.lit(HREF), F.lit(1))).alias("url"))
    return u.groupBy(F.coalesce(T.host(F.col("url")), F.lit("")).alias("host")).agg(F.count(F.lit(1)).alias("links"), F.countDistinct("page_id").alias("pages"))


@query(f"SELECT doc_id, CAST(len({sql_clauses('text')}) AS BIGINT) AS clauses FROM documents")
def clause_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", F.size(T.clauses(F.col("text"))).cast("long").alias("clauses"))


@query(f"SELECT doc_id, CAST(len({sql_words('text')}) AS BIGINT) AS words, sha256({sql_normalized('text')}) AS normalized FROM documents")
def normalized_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", F.size(T.words(F.col("text"))).cast("long").alias("words"), F.sha2(T.normalize(F.col("text")), 256).alias("normalized"))


@query(f"WITH w AS (SELECT DISTINCT doc_id, UNNEST({sql_words('text')}) AS w FROM documents) SELECT {sql_stem('w')} AS stem, COUNT(DISTINCT doc_id) AS docs FROM w GROUP BY 1")
def stem_frequency(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = table(spark, sf_dir, "documents").select("doc_id", F.explode(F.array_distinct(T.words(F.col("text")))).alias("w"))
    return w.groupBy(T.stem(F.col("w")).alias("stem")).agg(F.countDistinct("doc_id").alias("docs"))


def sql_function_language(w: str) -> str:
    out, best = [], []
    for code, own in V.FUNCTION_WORDS.items():
        out.append(f"len(list_filter({sql_list(list(dict.fromkeys(own)))}, lambda x: list_contains({w}, x))) AS h_{code}, len(list_filter({w}, lambda x: list_contains({sql_list(own)}, x))) / len({w}) AS s_{code}")
        best.append(code)
    return ", ".join(out)


@query(
    f"WITH t AS (SELECT doc_id, {sql_words('text')} AS w FROM documents), s AS (SELECT doc_id, len(w) AS n, {sql_function_language('w')} FROM t) SELECT doc_id, CASE WHEN n < 12 THEN 'unknown' WHEN h_nl > h_en OR (h_nl = h_en AND s_nl > s_en) THEN CASE WHEN h_nl >= 3 AND s_nl >= 0.04 THEN 'nl' ELSE 'unknown' END WHEN h_en >= 3 AND s_en >= 0.04 THEN 'en' ELSE 'unknown' END AS posture FROM s"
)
def language_posture(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents").select("doc_id", T.words(F.col("text")).alias("w"))
    return d.select("doc_id", F.coalesce(T.function_word_language(F.col("w")), F.lit("unknown")).alias("posture"))


PROFILES = [(lang, g, r) for lang, own in language.PROFILES.items() for r, g in enumerate(own)]


@query(
    f"""WITH w AS (SELECT doc_id, UNNEST({sql_words("text")}) AS w FROM documents),
g AS (SELECT doc_id, UNNEST(flatten([list_transform(range(greatest(len(w) + 3 - n, 0)), lambda i: substr(' ' || w || ' ', i + 1, n)) for n in [2, 3, 4]])) AS g FROM w),
c AS (SELECT doc_id, g, COUNT(*) AS n FROM g GROUP BY 1, 2),
r AS (SELECT doc_id, g, row_number() OVER (PARTITION BY doc_id ORDER BY n DESC, encode(g)) - 1 AS r FROM c QUALIFY r < 200),
p AS {sql_values(PROFILES, "lang, gram, rank")}, l AS (SELECT DISTINCT lang FROM p),
d AS (SELECT doc_id, l.lang, SUM(abs(coalesce(p.rank, 200) - r)) AS dist FROM r CROSS JOIN l LEFT JOIN p ON p.lang = l.lang AND p.gram = r.g GROUP BY 1, 2)
SELECT doc_id, lang, CAST(dist AS BIGINT) AS distance FROM d"""
)
def ngram_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Out-of-place distances of each document's n-gram ranks to each language's profile."""
    d = table(spark, sf_dir, "documents").select("doc_id", "text")
    d, ids = d.select("doc_id", T.normalize(F.col("text")).alias("w")), d.select("doc_id")
    if ids.groupBy("doc_id").count().where("count > 1").limit(1).count():  # rows of one doc_id are one document; only then words move
        d = d.groupBy("doc_id").agg(F.array_join(F.collect_list("w"), " ").alias("w"))
    m = d.select("doc_id", language.measured_text(F.col("w")).alias("m")).where("m.grams > 0")
    at = m.select("doc_id", F.posexplode("m.distance").alias("k", "distance"))
    return at.select("doc_id", F.get(T.strings(list(language.PROFILES)), F.col("k")).alias("lang"), "distance")


@query(f"WITH src AS (SELECT doc_id, text FROM {SPLICED}), {CONCEPTS_SQL} SELECT concept, COUNT(*) AS hits, COUNT(DISTINCT doc_id) AS docs FROM found GROUP BY 1")
def concept_hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = spliced(spark, sf_dir).select("doc_id", F.explode(F.flatten(F.transform(C.carried(C.annotated(F.col("text"))), lambda c: c["found"]))).alias("x"))
    return c.groupBy(F.col("x.concept").alias("concept")).agg(F.count(F.lit(1)).alias("hits"), F.countDistinct("doc_id").alias("docs"))


def sql_pairs() -> str:
    out = []
    for label, first, second, window, ordered, required in C.PAIRS:
        way = f"(b.i > a.i OR (a.i = a.n - 1 AND st.s IN {tuple(C.DUTCH_OVERRIDES)}))" if ordered else "true"
        need = f"AND EXISTS (SELECT 1 FROM found r WHERE r.doc_id = a.doc_id AND r.k = a.k AND r.concept = {q(required)})" if required else ""
        out.append(
            f"SELECT DISTINCT a.doc_id, {q(label)} AS label FROM found a JOIN found b ON a.doc_id = b.doc_id AND a.k = b.k AND a.i <> b.i AND abs(a.i - b.i) <= {window} JOIN stm st ON st.doc_id = a.doc_id AND st.k = a.k AND st.i = a.i WHERE a.concept = {q(first)} AND b.concept = {q(second)} AND {way} {need}"
        )
    return " UNION ".join(out)


@query(f"WITH src AS (SELECT doc_id, text FROM {SPLICED}), {CONCEPTS_SQL} SELECT doc_id, label FROM ({sql_pairs()})")
def paraphrase_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spliced(spark, sf_dir).select("doc_id", F.explode(C.labels(F.col("text"), C.pair_labels)).alias("label"))


def sql_chains() -> str:
    out = []
    for label, (a, b, c) in C.CHAINS:
        m = ", ".join(f"max(CASE WHEN concept = {q(x)} THEN i END) AS m{k}" for k, x in enumerate((a, b, c)))
        out.append(
            f"SELECT DISTINCT doc_id, {q(label)} AS label FROM (SELECT doc_id, k, {m} FROM found GROUP BY doc_id, k) f WHERE m0 < m1 AND m1 < m2 AND m2 - m0 <= 20 AND NOT EXISTS (SELECT 1 FROM stm s WHERE s.doc_id = f.doc_id AND s.k = f.k AND s.i > m0 AND s.i < m2 AND s.s IN {tuple(C.stems_of(V.COORDINATORS))})"
        )
    return " UNION ".join(out)


@query(f"WITH src AS (SELECT doc_id, text FROM {SPLICED}), {CONCEPTS_SQL} SELECT doc_id, label FROM ({sql_chains()})")
def alignment_hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spliced(spark, sf_dir).select("doc_id", F.explode(C.labels(F.col("text"), C.chain_labels)).alias("label"))


def sql_shingles(c: str) -> str:
    return f"CASE WHEN len({c}) <= 4 THEN [{c}] ELSE list_distinct(list_transform(range(len({c}) - 3), lambda i: substr({c}, i + 1, 4))) END"


SEED_ROWS = [(k, " ".join(s.lower().replace(",", "").split())) for k, s in enumerate(V.SEEDS)]
#: Shingles of `src(key, text)` clauses joined with seeds: containment of the seed in the clause.
SEEDS_SQL = f"""cl AS (SELECT key, UNNEST(list_zip(range(len(c)), c)) AS z FROM (SELECT key, {sql_clauses("text")} AS c FROM src)),
nc AS (SELECT key, z[1] AS k, {sql_normalized("z[2]")} AS b FROM cl),
sh AS (SELECT key, k, UNNEST({sql_shingles("b")}) AS g FROM nc),
seed AS (SELECT seed_id, UNNEST({sql_shingles("b")}) AS g, len({sql_shingles("b")}) AS size FROM seeds),
hit AS (SELECT key, k, seed_id, COUNT(*) / any_value(size) AS c FROM sh JOIN seed USING (g) GROUP BY 1, 2, 3)"""


@query(f"WITH src AS (SELECT doc_id AS key, text FROM {SPLICED}), seeds AS (SELECT seed_id, body AS b FROM {sql_values(SEED_ROWS, 'seed_id, body')}), {SEEDS_SQL} SELECT key AS doc_id, round(max(c), 6) AS similarity FROM hit GROUP BY 1 HAVING max(c) >= 0.75")
def seed_containment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Highest containment of a known attack in a clause, in one pass over the texts."""
    d = spliced(spark, sf_dir).select("doc_id", F.round(R.seed_containment(F.col("text"), [t for _, t in SEED_ROWS], 0.75), 6).alias("similarity"))
    return d.where("similarity >= 0.75")


@query(
    f"WITH s AS (SELECT doc_id, {sql_matching(V.INJECTED_PATTERNS)} AS a, {sql_matching(V.JAILBREAK_PATTERNS)} AS b, regexp_replace(text, {q(V.TEMPLATE_TOKENS)}, '', 'g') AS x, text FROM {SPLICED}), t AS (SELECT *, "
    + " + ".join(f"len(regexp_extract_all(x, {q(p)}))" for p in V.TURN_PATTERNS)
    + " AS turns FROM s) SELECT doc_id, CASE WHEN len(a) > 0 OR len(b) > 0 OR turns > 4 THEN 'blocked' WHEN x <> text THEN 'modified' ELSE 'passed' END AS status, CASE WHEN len(a) > 0 THEN 'injected_instructions' WHEN len(b) > 0 THEN 'jailbreak' WHEN turns > 4 OR x <> text THEN 'many_shot' END AS rail, CASE WHEN len(a) > 0 THEN array_to_string(a, ',') WHEN len(b) > 0 THEN array_to_string(b, ',') WHEN turns > 4 THEN 'many_shot' WHEN x <> text THEN 'template_tokens' ELSE '' END AS categories FROM t"
)
def engine_verdict(spark: SparkSession, sf_dir: str) -> DataFrame:
    seen = Engine([R.injected_instructions(), R.jailbreak(), R.many_shot()]).run(spliced(spark, sf_dir), side="context")
    return seen.select("doc_id", "verdict.status", "verdict.rail", joined(F.col("verdict.categories")).alias("categories"))


@query(ORACLES["engine_verdict"])
def memoized_verdicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """engine_verdict with equal texts looked at once."""
    seen = Engine([R.injected_instructions(), R.jailbreak(), R.many_shot()]).run_distinct(spliced(spark, sf_dir), side="context")
    return seen.select("doc_id", "verdict.status", "verdict.rail", joined(F.col("verdict.categories")).alias("categories"))


@query()
def engine_core(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All deterministic rails of the context side."""
    seen = Engine(R.core("context")).run(spliced(spark, sf_dir), side="context")
    return seen.select("doc_id", "verdict.status", "verdict.rail", joined(F.col("verdict.categories")).alias("categories"), "verdict.certain")


@query("SELECT COUNT(*) AS n, COUNT(DISTINCT text) AS distinct_texts FROM documents")
def dedupe_memo(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How often a memo over equal texts would save a rail: counts by text hash, not by text."""
    return table(spark, sf_dir, "documents").agg(F.count(F.lit(1)).alias("n"), F.countDistinct(F.sha2("text", 256)).alias("distinct_texts"))


ENCODINGS = ["plain", "rot13", "base64"]
PAGES = [(k, e, s) for k, s in enumerate(V.INJECTIONS) for e in ENCODINGS]


@query()
def decoded_attacks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The obfuscation rail over encoded injections: which encodings of which injections are caught."""
    a = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    base = spark.createDataFrame(PAGES, "injection int, encoding string, text string")
    t = F.when(F.col("encoding") == "rot13", F.translate("text", a + a.lower(), a[13:] + a[:13] + a[13:].lower() + a[:13].lower())).when(F.col("encoding") == "base64", F.base64(F.col("text").cast("binary"))).otherwise(F.col("text"))
    inner = [R.injected_instructions(), R.jailbreak()]
    seen = Engine([*inner, R.obfuscation(inner)]).run(base.withColumn("text", t), side="context")
    return seen.select("injection", "encoding", "verdict.status", joined(F.col("verdict.categories")).alias("categories"))


