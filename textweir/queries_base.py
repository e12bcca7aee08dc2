"""What the query modules share: tables, spliced fixtures and SQL text for the DuckDB twins."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import concepts as C
from .functions import text as T
from .functions import values as V

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    """Registers a query under its function's name, with its SQL twin."""

    def register(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLES[f.__name__] = sql
        return f

    return register


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spread(spark.read.parquet(f"{sf_dir}/{name}.parquet"))


#: Only tables of at most so many input splits are ever dealt out anew; they are small, whatever the cluster.
FEW_SPLITS = 16


def spread(df: DataFrame) -> DataFrame:
    """A table of very few input splits, and fewer than half the cores, is dealt out anew; larger ones are never moved."""
    cores, splits = df.sparkSession.sparkContext.defaultParallelism, df.rdd.getNumPartitions()
    return df.repartition(cores) if splits <= FEW_SPLITS and splits < cores / 2 else df


def q(s: str) -> str:
    """An SQL string literal."""
    return "'" + s.replace("'", "''") + "'"


def sql_list(items: list[str]) -> str:
    return "[" + ", ".join(q(x) for x in items) + "]"


def spliced(spark: SparkSession, sf_dir: str) -> DataFrame:
    """documents; every fifth has an injection after a blank line, by doc_id modulo their number."""
    one = F.get(T.strings(V.INJECTIONS), F.pmod("doc_id", F.lit(len(V.INJECTIONS))).cast("int"))
    return table(spark, sf_dir, "documents").withColumn("text", F.when(F.col("doc_id") % 5 == 0, F.concat("text", F.lit("\n\n"), one)).otherwise(F.col("text")))


SPLICED = f"(SELECT doc_id, lang, source, CASE WHEN doc_id % 5 = 0 THEN text || chr(10) || chr(10) || ({sql_list(V.INJECTIONS)})[(doc_id % {len(V.INJECTIONS)}) + 1] ELSE text END AS text FROM documents)"


def sql_matching(patterns: dict[str, str], c: str = "text") -> str:
    """Labels of matching patterns, in order."""
    return "list_filter([" + ", ".join(f"CASE WHEN regexp_matches({c}, {q(p)}) THEN {q(k)} END" for k, p in patterns.items()) + "], lambda x: x IS NOT NULL)"


def sql_normalized(c: str) -> str:
    return rf"trim(regexp_replace(lower({c}), '[^\p{{L}}\p{{M}}\p{{N}}]+', ' ', 'g'))"


def sql_words(c: str) -> str:
    return f"list_filter(string_split({sql_normalized(c)}, ' '), lambda x: x <> '')"


def sql_clauses(c: str) -> str:
    mark = "chr(1)"
    marked = rf"regexp_replace(regexp_replace({c}, '([.!?;:])\s+', '\1' || {mark}, 'g'), '[\n\r]+', {mark}, 'g')"
    return rf"list_filter(list_transform(string_split({marked}, {mark}), lambda x: regexp_replace(x, '^[\x00\s]+|[\x00\s]+$', '', 'g')), lambda x: x <> '')"


def sql_stem(w: str) -> str:
    def silent(b: str) -> str:
        return f"CASE WHEN len({b}) > 3 AND right({b}, 1) = left(right({b}, 2), 1) AND NOT regexp_matches({b}, '[aeiou]$') THEN left({b}, len({b}) - 1) WHEN regexp_matches({b}, '[^aeiou][aeiou][^aeiouy]$') THEN {b} || 'e' ELSE {b} END"

    return (
        f"CASE WHEN len({w}) <= 3 THEN {w} WHEN regexp_matches({w}, '^.+ies$') THEN left({w}, len({w}) - 3) || 'y' WHEN regexp_matches({w}, '^.+sses$') THEN left({w}, len({w}) - 2) "
        f"WHEN regexp_matches({w}, '^.+[^su]s$') THEN left({w}, len({w}) - 1) WHEN regexp_matches({w}, '^.{{3,}}ing$') THEN {silent(f'left({w}, len({w}) - 3)')} "
        f"WHEN regexp_matches({w}, '^.{{3,}}ed$') THEN {silent(f'left({w}, len({w}) - 2)')} WHEN regexp_matches({w}, '^.{{3,}}ly$') THEN left({w}, len({w}) - 2) ELSE {w} END"
    )


def sql_values(rows: list[tuple], columns: str) -> str:
    def lit(x: object) -> str:
        return "NULL" if x is None else q(x) if isinstance(x, str) else repr(x)

    return "(SELECT * FROM (VALUES " + ", ".join("(" + ", ".join(lit(x) for x in r) + ")" for r in rows) + f") t({columns}))"


LEXICON = [(s, c) for s, cs in C.lexicon().items() for c in cs]
#: CTEs that annotate clauses of `src(doc_id, text)` with concepts, found after binding of pronouns in `found`.
CONCEPTS_SQL = f"""
clause AS (SELECT doc_id, UNNEST(list_zip(range(len(cl)), cl)) AS z FROM (SELECT doc_id, {sql_clauses("text")} AS cl FROM src)),
toks AS (SELECT doc_id, z[1] AS k, {sql_words("z[2]")} AS w FROM clause),
tok AS (SELECT doc_id, k, len(w) AS n, UNNEST(list_zip(range(len(w)), w)) AS z FROM toks),
stm AS (SELECT doc_id, k, n, z[1] AS i, {sql_stem("z[2]")} AS s FROM tok),
nb AS (SELECT *, lead(s) OVER g AS s1, lead(s, 2) OVER g AS s2, lag(s) OVER g AS p1,
  max(CASE WHEN s IN {tuple(C.stems_of(V.NEGATORS))} THEN 1 ELSE 0 END) OVER (g ROWS BETWEEN 3 PRECEDING AND 1 PRECEDING) AS nl,
  max(CASE WHEN s IN {tuple(C.stems_of(V.NEGATORS))} THEN 1 ELSE 0 END) OVER (g ROWS BETWEEN 1 FOLLOWING AND 6 FOLLOWING) AS nr
  FROM stm WINDOW g AS (PARTITION BY doc_id, k ORDER BY i)),
neg AS (SELECT *, (coalesce(nl, 0) + coalesce(nr, 0)) > 0 AS no FROM nb),
lex AS {sql_values(LEXICON, "stem, concept")},
phr AS {sql_values(list(C.phrase_table().items()), "stem, concept")},
turned AS {sql_values([(k, v) for k, v in V.NEGATED.items()], "concept, becomes")},
raw AS (
  SELECT doc_id, k, n, i, concept, no FROM neg JOIN lex ON s = stem
  UNION ALL SELECT doc_id, k, n, i, concept, no AND NOT (s IN {tuple(C.stems_of(V.NEGATORS))} OR s1 IN {tuple(C.stems_of(V.NEGATORS))}) FROM neg JOIN phr ON s || ' ' || s1 = stem
  UNION ALL SELECT doc_id, k, n, i, concept, no AND NOT (s IN {tuple(C.stems_of(V.NEGATORS))} OR s1 IN {tuple(C.stems_of(V.NEGATORS))} OR s2 IN {tuple(C.stems_of(V.NEGATORS))}) FROM neg JOIN phr ON s || ' ' || s1 || ' ' || s2 = stem
  UNION ALL SELECT doc_id, k, n, i, 'persona', false FROM neg WHERE s IN {tuple(C.stems_of(V.PRONOUNS))} AND s1 IN {tuple(C.stems_of(V.COPULAS))}
  UNION ALL SELECT doc_id, k, n, i, 'instruction', false FROM neg JOIN lex ON s = stem AND concept = 'prior' WHERE p1 IN {tuple(C.stems_of(V.DETERMINERS))} AND (s1 IS NULL OR s1 IN {tuple(C.stems_of(V.COORDINATORS))})),
base AS (SELECT doc_id, k, n, i, CASE WHEN no AND t.concept IS NOT NULL THEN becomes ELSE raw.concept END AS concept FROM raw LEFT JOIN turned t ON raw.concept = t.concept WHERE NOT (no AND t.concept IS NOT NULL AND becomes IS NULL)),
last_stem AS (SELECT doc_id, k, n, s FROM stm WHERE i = n - 1),
per AS (SELECT t.doc_id, t.k, coalesce(l.n, 0) AS n, coalesce(bool_or(concept = 'instruction'), false) AS instr,
  coalesce(any_value(l.s) IN {tuple(C.stems_of(V.ANAPHORA))}, false) AND coalesce(min(CASE WHEN concept = 'override' THEN i END) >= coalesce(l.n, 0) - 4, false) AND NOT coalesce(bool_or(concept = 'instruction'), false) AS bound
  FROM toks t LEFT JOIN last_stem l USING (doc_id, k) LEFT JOIN base b USING (doc_id, k) GROUP BY t.doc_id, t.k, l.n),
carry AS (SELECT doc_id, k, n, bound, last_value(CASE WHEN NOT bound THEN instr END IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS carried FROM per),
found AS (SELECT * FROM base UNION ALL SELECT doc_id, k, n, n - 1, 'instruction' FROM carry WHERE bound AND carried)
"""
