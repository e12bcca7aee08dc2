"""Queries over what a text hides: carriers in pages, decodings, look-alike characters; with DuckDB twins where regexes allow."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import lookalikes as L
from .functions import text as T
from .functions import values as V
from .operators import rails as R
from .plans.engine import Engine
from .queries_base import q, query, sql_list, sql_matching, table
from .queries_rails import SQL_SECRETS, joined, sql_replaced

#: What every page gets besides its own, by page_id modulo their number; # stands for a key of its own, @ for an injection.
PLANTS = [
    "<!-- note # -->", "<!-- @ -->", '<img src="/a.png" alt="logo of # here">', "<div hidden>kept # there</div>", '<input type="hidden" value="session token: #">', '<b style="color:white">password: #</b>',
    "see [docs](/x 'read # first')", "![picture of the # at night](/p.png)", "<template><p title=\"key # of page\">x</p></template>", "plain words only",
]
KEY = "concat('AKIA', lpad(cast(page_id AS VARCHAR), 16, '0'))"


def planted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """pages, each with one of PLANTS at its end."""
    pages = table(spark, sf_dir, "pages").select("page_id", "html")
    plant = F.get(T.strings(PLANTS), F.pmod("page_id", F.lit(len(PLANTS))).cast("int"))
    injection = F.get(T.strings(V.INJECTIONS), F.pmod("page_id", F.lit(len(V.INJECTIONS))).cast("int"))
    key = F.concat(F.lit("AKIA"), F.lpad(F.col("page_id").cast("string"), 16, "0"))
    return pages.withColumn("html", F.concat("html", F.lit("\n"), F.replace(F.replace(plant, F.lit("#"), key), F.lit("@"), injection)))


PLANTED = f"(SELECT page_id, html || chr(10) || replace(replace(({sql_list(PLANTS)})[page_id % {len(PLANTS)} + 1], '#', {KEY}), '@', ({sql_list(V.INJECTIONS)})[page_id % {len(V.INJECTIONS)} + 1]) AS html FROM pages)"

#: Elements that the tables hold: the twin writes the back-reference of one carrier out.
TAGS = "html head title meta style script body nav ul li a div article h1 p b br footer span section template".split()
_STRIP = r"regexp_replace({}, '^[\x00\s]+|[\x00\s]+$', '', 'g')"


def sql_captured(k: str, c: str) -> str:
    """A list of structs full, span of a carrier's matches in c, without blank spans."""
    if k == "hidden_attribute":
        p = "(?is)" + "|".join(rf"<{t}\b[^>]*\bhidden\b[^>]*>.*?</{t}>" for t in TAGS)
        inner, tag = _STRIP.format(r"regexp_extract(x, '(?is)^<\w+\b[^>]*\bhidden\b[^>]*>(.*)</\w+>$', 1)"), r"regexp_extract(x, '^<(\w+)', 1)"
        found = f"list_transform(regexp_extract_all({c}, {q(p)}), lambda x: {{'full': x, 'span': CASE WHEN len({inner}) > len({tag}) THEN {inner} ELSE {tag} END}})"
    elif k == "hidden_input":
        p = r"""(?i)<input\b[^>]*\bvalue\s*=\s*["'][^"']{12,}["'][^>]*>"""
        full = rf"""list_filter(regexp_extract_all({c}, {q(p)}), lambda x: regexp_matches(x, '(?i)^<input\b[^>]*\btype\s*=\s*["'']?hidden'))"""
        value = r"""(?i)\bvalue\s*=\s*["']([^"']{12,})["'][^>]*>$"""
        found = f"list_transform({full}, lambda x: {{'full': x, 'span': {_STRIP.format(f'regexp_extract(x, {q(value)}, 1)')}}})"
    else:
        p = q(V.CARRIERS[k])
        found = f"list_transform(list_zip(regexp_extract_all({c}, {p}), regexp_extract_all({c}, {p}, 1)), lambda x: {{'full': x[1], 'span': {_STRIP.format('x[2]')}}})"
    return f"list_filter({found}, lambda x: x.span <> '')"


SPANS_SQL = " UNION ALL ".join(
    f"SELECT page_id, {q(k)} AS carrier, CAST(len(s) AS BIGINT) AS spans, array_to_string(s, chr(10)) AS texts FROM (SELECT page_id, list_transform({sql_captured(k, 'html')}, lambda x: x.span) AS s FROM {PLANTED}) WHERE len(s) > 0" for k in V.CARRIER_ORDER
)


@query(SPANS_SQL)
def hidden_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What pages hide, by carrier: all thirteen."""
    s = planted(spark, sf_dir).select("page_id", F.posexplode(R.hidden_spans(F.col("html"))).alias("i", "x"))
    g = s.groupBy("page_id", F.col("x.carrier").alias("carrier")).agg(F.count(F.lit(1)).alias("spans"), F.array_sort(F.collect_list(F.struct("i", "x.span"))).alias("l"))
    return g.select("page_id", "carrier", "spans", F.array_join(F.transform("l", lambda x: x["span"]), "\n").alias("texts"))


def _sql_changed(c: str) -> str:
    """Labels of the secrets rail in c, each looked for in what the ones before it left."""
    out, now = [], c
    for k, (p, new) in SQL_SECRETS.items():
        out.append(f"CASE WHEN regexp_matches({now}, {q(p)}) THEN {q(k)} END")
        now = f"regexp_replace({now}, {q(p)}, {q(new)}, 'g')"
    return f"list_filter([{', '.join(out)}], lambda y: y IS NOT NULL)"


def _sql_first(full: str, old: str, new: str) -> str:
    at = f"instr({full}, {old})"
    return f"CASE WHEN {at} > 0 THEN left({full}, {at} - 1) || {new} || substr({full}, {at} + len({old})) ELSE {full} END"


def _hidden_sql() -> str:
    """Carrier after carrier: find, look at the spans, block or put back."""
    steps = ["s0 AS (SELECT page_id, html AS t, NULL::VARCHAR[] AS blk, NULL::VARCHAR[] AS chg FROM " + PLANTED + ")"]
    for i, k in enumerate(V.CARRIER_ORDER):
        seen = f"list_transform({sql_captured(k, 't')}, lambda x: {{'full': x.full, 'span': x.span, 'hit': {sql_matching(V.INJECTED_PATTERNS, 'x.span')}, 'new': {sql_replaced(SQL_SECRETS, 'x.span')}, 'chg': {_sql_changed('x.span')}}})"
        steps.append(f"f{i} AS (SELECT *, CASE WHEN blk IS NULL THEN {seen} END AS z FROM s{i})")
        hit, some = "list_filter(z, lambda x: len(x.hit) > 0)", "list_filter(z, lambda x: len(x.chg) > 0)"
        tag = f"[{q('hidden:' + k)}]"
        # equal matches get equal replacements, so each distinct one is replaced everywhere
        moved = f"list_distinct(list_transform({some}, lambda x: x.full || chr(1) || {_sql_first('x.full', 'x.span', 'x.new')}))"
        steps.append(
            f"s{i + 1} AS (SELECT page_id, CASE WHEN len({some}) > 0 THEN list_reduce(list_prepend(t, {moved}), lambda a, x: replace(a, string_split(x, chr(1))[1], string_split(x, chr(1))[2])) ELSE t END AS t, "
            f"CASE WHEN len({hit}) > 0 THEN list_concat({hit}[1].hit, {tag}) ELSE blk END AS blk, CASE WHEN len({some}) > 0 THEN list_concat({some}[-1].chg, {tag}) ELSE chg END AS chg FROM f{i})"
        )
    n = len(V.CARRIER_ORDER)
    return f"WITH {', '.join(steps)} SELECT e.page_id, CASE WHEN blk IS NOT NULL THEN 'blocked' WHEN chg IS NOT NULL THEN 'modified' ELSE 'passed' END AS status, array_to_string(coalesce(blk, chg, []), ',') AS categories, sha256(CASE WHEN blk IS NULL THEN t ELSE e.html END) AS content FROM s{n} JOIN {PLANTED} e USING (page_id)"


@query(_hidden_sql())
def hidden_rewrites(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages with keys and injections in all carriers: keys are redacted in place, injections block."""
    seen = Engine([R.hidden([R.injected_instructions(), R.secrets()])]).run(planted(spark, sf_dir), text="html", side="context")
    return seen.select("page_id", "verdict.status", joined(F.col("verdict.categories")).alias("categories"), F.sha2("verdict.content", 256).alias("content"))


# fixed values: letters of another script for Latin ones, as planted
CYRILLIC = dict(zip("aeopcyxisdh", "аеорсухіѕԁһ", strict=True))
WIDE = {chr(n): chr(n - 0x21 + 0xFF01) for n in range(0x21, 0x7F)} | {" ": "　"}
POSITIONS = ["top", "bottom", "middle", "fenced", "inline"]
ENCODINGS = ["plain", "base64", "rot13", "zero_width", "homoglyph", "fullwidth"]
_UP, _LOW = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_FROM, _TO = _UP + _LOW, _UP[13:] + _UP[:13] + _LOW[13:] + _LOW[:13]
FILLER = "See the reference pages for the full table."


def encoded(text: Column, kind: Column) -> Column:
    """text as an attacker would write it, by kind; plain for other kinds."""
    made = {
        "base64": F.base64(F.encode(text, "UTF-8")),
        "rot13": T.rot13(text),
        "zero_width": F.array_join(F.split(text, ""), "​"),
        "homoglyph": F.translate(text, "".join(CYRILLIC), "".join(CYRILLIC.values())),
        "fullwidth": F.translate(text, "".join(WIDE), "".join(WIDE.values())),
    }
    return F.coalesce(*[F.when(kind == k, v) for k, v in made.items()], text)


def placed(page: Column, injection: Column, position: Column) -> Column:
    """page with the injection at a place."""
    gap = F.lit("\n\n")
    return (
        F.when(position == "top", F.concat(injection, gap, page))
        .when(position == "bottom", F.concat(page, gap, injection))
        .when(position == "middle", F.concat(page, gap, injection, gap, F.lit(FILLER)))
        .when(position == "fenced", F.concat(page, F.lit("\n\n```\n"), injection, F.lit("\n```")))
        .otherwise(F.concat(page, F.lit(" "), injection))
    )


def poisoned(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, i, position, encoding, text: every document with an injection; all combinations take turns over doc_id."""
    n, p = len(V.INJECTIONS), len(POSITIONS)
    d = table(spark, sf_dir, "documents").select("doc_id", "text", F.pmod("doc_id", F.lit(n)).cast("int").alias("i"))
    d = d.withColumn("position", F.get(T.strings(POSITIONS), F.pmod(F.floor(F.col("doc_id") / n), F.lit(p)).cast("int")))
    d = d.withColumn("encoding", F.get(T.strings(ENCODINGS), F.pmod(F.floor(F.col("doc_id") / (n * p)), F.lit(len(ENCODINGS))).cast("int")))
    s = encoded(F.get(T.strings(V.INJECTIONS), F.col("i")), F.col("encoding"))
    return d.withColumn("text", placed(F.col("text"), s, F.col("position")))


_N, _P = len(V.INJECTIONS), len(POSITIONS)
_S = f"({sql_list(V.INJECTIONS)})[doc_id % {_N} + 1]"
POISONED = f"""(SELECT doc_id, i, position, encoding, CASE position WHEN 'top' THEN s || chr(10) || chr(10) || page WHEN 'bottom' THEN page || chr(10) || chr(10) || s WHEN 'middle' THEN page || chr(10) || chr(10) || s || chr(10) || chr(10) || {q(FILLER)} WHEN 'fenced' THEN page || chr(10) || chr(10) || '```' || chr(10) || s || chr(10) || '```' ELSE page || ' ' || s END AS text
FROM (SELECT doc_id, doc_id % {_N} AS i, position, encoding, page, CASE encoding WHEN 'base64' THEN to_base64(encode(s)) WHEN 'rot13' THEN translate(s, '{_FROM}', '{_TO}') WHEN 'zero_width' THEN array_to_string(string_split(s, ''), chr(8203)) WHEN 'homoglyph' THEN translate(s, '{"".join(CYRILLIC)}', '{"".join(CYRILLIC.values())}') WHEN 'fullwidth' THEN translate(s, {q("".join(WIDE))}, {q("".join(WIDE.values()))}) ELSE s END AS s
FROM (SELECT doc_id, text AS page, {_S} AS s, ({sql_list(POSITIONS)})[(doc_id // {_N}) % {_P} + 1] AS position, ({sql_list(ENCODINGS)})[(doc_id // {_N * _P}) % {len(ENCODINGS)} + 1] AS encoding FROM documents)))"""


def sql_translated(c: str, chars: dict[str, str]) -> str:
    """Characters that become one other; no table or plant here holds those that become several."""
    one = {k: v for k, v in chars.items() if len(v) == 1}
    return f"translate({c}, {q(''.join(one))}, {q(''.join(one.values()))})"


def sql_fold(c: str) -> str:
    some = q(L.char_class(L.table()))
    word = f"CASE WHEN NOT regexp_matches(w, '[A-Za-z0-9]') THEN w WHEN regexp_full_match(w, '[\\x00-\\x7F]*') THEN w WHEN regexp_matches(w, {some}) THEN {sql_translated('w', L.table())} ELSE w END"
    return rf"CASE WHEN regexp_matches({c}, {some}) THEN array_to_string(list_transform(regexp_extract_all({c}, '\s+|\S+'), lambda w: {word}), '') ELSE {c} END"


def sql_views(bare: str) -> str:
    """The decodings of a text without tags and selectors, which nothing here holds."""
    runs = rf"list_filter(regexp_extract_all({bare}, '[A-Za-z0-9+/=]+'), lambda r: regexp_full_match(r, '[A-Za-z0-9+/]{{24,}}={{0,2}}'))"
    plain = rf"list_filter(list_transform({runs}, lambda r: try(decode(from_base64(r)))), lambda r: r IS NOT NULL AND regexp_full_match(r, '[\x20-\x7E\n\t]+'))"
    return f"[{bare}, {sql_fold(bare)}, {sql_translated(bare, L.table())}, translate({bare}, '{_FROM}', '{_TO}'), array_to_string({plain}, chr(10)), {sql_translated(bare, L.compatible())}]"


_BARE = f"regexp_replace(regexp_replace(text, {q(V.INVISIBLE)}, '', 'g'), {q(V.SELECTOR_RUN)}, '', 'g')"
_ANY = " OR ".join(f"regexp_matches(v, {q(p)})" for p in [*V.INJECTED_PATTERNS.values(), *V.JAILBREAK_PATTERNS.values()])


@query(
    f"WITH p AS {POISONED}, b AS (SELECT *, {_BARE} AS bare FROM p), v AS (SELECT doc_id, i, position, encoding, list_prepend(text, {sql_views('bare')}) AS vs FROM b), h AS (SELECT *, len(list_filter(vs, lambda v: {_ANY})) > 0 AS hit FROM v) "
    "SELECT position, encoding, COUNT(*) AS n, COUNT(*) FILTER (hit) AS caught, coalesce(array_to_string(list_sort(list_distinct(list(i) FILTER (NOT hit))), ','), '') AS escaped FROM h GROUP BY 1, 2"
)
def spliced_catches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Injections at five places of all pages, written in six ways: how many the rails catch, and which escape."""
    inner = [R.injected_instructions(), R.jailbreak()]
    seen = Engine([*inner, R.obfuscation(inner)]).run(poisoned(spark, sf_dir), side="context")
    hit = F.col("verdict.status") == "blocked"
    g = seen.groupBy("position", "encoding").agg(F.count(F.lit(1)).alias("n"), F.count_if(hit).alias("caught"), F.array_sort(F.collect_set(F.when(~hit, F.col("i")))).alias("e"))
    return g.select("position", "encoding", "n", "caught", F.array_join(F.transform("e", lambda v: v.cast("string")), ",").alias("escaped"))


@query()
def encoded_rewrites(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents with an encoded key: what the redaction of the decoded text leaves of them. Held against a plain version in the tests."""
    n = len(ENCODINGS)
    d = table(spark, sf_dir, "documents").select("doc_id", "text", F.get(T.strings(ENCODINGS), F.pmod("doc_id", F.lit(n)).cast("int")).alias("encoding"))
    said = F.concat(F.lit("password: hunter"), F.lpad(F.col("doc_id").cast("string"), 12, "0"))
    d = d.withColumn("text", F.concat("text", F.lit("\n"), encoded(said, F.col("encoding"))))
    seen = Engine([R.obfuscation([R.injected_instructions(), R.secrets()])]).run(d, side="context")
    return seen.select("doc_id", "encoding", "verdict.status", joined(F.col("verdict.categories")).alias("categories"), F.sha2("verdict.content", 256).alias("content"))


_IMITATED = "CASE doc_id % 3 WHEN 0 THEN replace(text, 'o', 'о') WHEN 1 THEN translate(text, '{}', '{}') ELSE translate(text, {}, {}) END".format("".join(CYRILLIC), "".join(CYRILLIC.values()), q("".join(WIDE)), q("".join(WIDE.values())))


_SOME = q(L.char_class(L.table()))


@query(
    rf"WITH t AS MATERIALIZED (SELECT doc_id, {_IMITATED} AS t FROM documents), w AS MATERIALIZED (SELECT doc_id, unnest(x) AS w, generate_subscripts(x, 1) AS i FROM (SELECT doc_id, regexp_extract_all(t, '\s+|\S+') AS x FROM t)), "
    f"u AS (SELECT DISTINCT w FROM w WHERE NOT regexp_full_match(w, '[\\x00-\\x7F]*') AND regexp_matches(w, '[A-Za-z0-9]')), m AS (SELECT w, {sql_translated('w', L.table())} AS v FROM u WHERE regexp_matches(w, {_SOME})), "
    f"f AS (SELECT doc_id, string_agg(coalesce(v, w), '' ORDER BY i) AS f FROM w LEFT JOIN m USING (w) GROUP BY 1) "
    f"SELECT doc_id, sha256(coalesce(f, '')) AS folded, sha256({sql_translated('t', L.table())}) AS folded_all, sha256({sql_translated('t', L.compatible())}) AS compatible, t <> coalesce(f, '') AS imitates FROM t LEFT JOIN f USING (doc_id)"
)
def folded_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents written with look-alike letters or full-width ones, folded by word, folded throughout, and in compatible forms."""
    c = F.col("text")
    kind = F.pmod("doc_id", F.lit(3))
    t = F.when(kind == 0, F.replace(c, F.lit("o"), F.lit("о"))).when(kind == 1, encoded(c, F.lit("homoglyph"))).otherwise(encoded(c, F.lit("fullwidth")))
    d = table(spark, sf_dir, "documents").select("doc_id", t.alias("t"))
    d = d.select("doc_id", "t", L.fold(F.col("t")).alias("f"), L.fold_all(F.col("t")).alias("a"), L.compatibility(F.col("t")).alias("n"))
    return d.select("doc_id", F.sha2("f", 256).alias("folded"), F.sha2("a", 256).alias("folded_all"), F.sha2("n", 256).alias("compatible"), (F.col("t") != F.col("f")).alias("imitates"))


#: Links that every page gets besides its own, in turns; % is an address of its own.
LINKED = [
    "![a chart](https://img.bad.example/p/%)", "[the docs](https://ok.example/d/%)", "[ the docs ](https://evil.example/d/%)", "<https://evil.example/auto/%>", "see https://evil.example/plain/% there",
    '<img src="https://ok.example/i/%.png">', "[open](https://ok.example/r?to=%aaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaa)", "![](http://bad.example/%)", '<a href="https://sub.ok.example/%">in</a>', "<ftp://files.example/%>",
]
ALLOWED = ["ok.example", "example.com"]


def linked(spark: SparkSession, sf_dir: str) -> DataFrame:
    one = F.get(T.strings(LINKED), F.pmod("page_id", F.lit(len(LINKED))).cast("int"))
    return table(spark, sf_dir, "pages").select("page_id", F.concat("html", F.lit("\n"), F.replace(one, F.lit("%"), F.col("page_id").cast("string"))).alias("html"))


def _links_sql() -> str:
    """Shape after shape; equal matches get equal replacements, and no plant's link stands within its image."""
    host, query = "lower(regexp_extract({u}, '^https?://([^/?#:]+)', 1))", r"regexp_extract({u}, '([?#].*)', 1)"
    load = f"(len({query}) > 40 OR regexp_matches({query}, '(?:%[0-9A-Fa-f]{{2}}){{6,}}|[A-Za-z0-9+/]{{40,}}={{0,2}}'))".replace("{{", "{").replace("}}", "}")
    steps = [f"l0 AS (SELECT page_id, html || chr(10) || replace(({sql_list(LINKED)})[page_id % {len(LINKED)} + 1], '%', page_id::VARCHAR) AS t, []::VARCHAR[] AS why FROM pages)"]
    for i, (kind, p, label, address) in enumerate(R.LINK_SHAPES):
        u, h = "x.url", host.replace("{u}", "x.url")
        mark = q(R.IMAGE_MARK if kind == "image" else R.LINK_MARK)
        parts = [f"regexp_extract_all(t, {q(p)}, {k})" if k is not None else f"list_transform(regexp_extract_all(t, {q(p)}), lambda _: '')" for k in (0, address, label, 1 if p == R.MARKDOWN else None)]
        good = f"({' OR '.join(f'{h} = {q(a)} OR ends_with({h}, {q('.' + a)})' for a in ALLOWED)}) AND NOT {load.replace('{u}', u)}"
        words = "x.label" if kind == "image" else _STRIP.format("x.label")
        mine = f"x.mark = '{'!' if kind == 'image' else ''}'" if p == R.MARKDOWN else "true"
        bad = f"list_filter(list_transform(list_zip({', '.join(parts)}), lambda z: {{'full': z[1], 'url': z[2], 'label': z[3], 'mark': z[4]}}), lambda x: {mine} AND NOT ({good}))"
        new = f"list_transform({bad}, lambda x: {{'full': x.full, 'new': CASE WHEN {words} = '' THEN {mark} ELSE {words} || ' ' || {mark} END, 'why': CASE WHEN {load.replace('{u}', u)} THEN '{kind}_payload' ELSE 'foreign_{kind}' END}})"
        steps.append(f"m{i} AS (SELECT *, {new} AS z FROM l{i})")
        steps.append(
            f"l{i + 1} AS (SELECT page_id, list_reduce(list_prepend(t, list_distinct(list_transform(z, lambda x: x.full || chr(1) || x.new))), lambda a, x: replace(a, string_split(x, chr(1))[1], string_split(x, chr(1))[2])) AS t, list_concat(why, list_transform(z, lambda x: x.why)) AS why FROM m{i})"
        )
    return f"WITH {', '.join(steps)} SELECT page_id, array_to_string(list_sort(list_distinct(why)), ',') AS categories, sha256(t) AS content FROM l{len(R.LINK_SHAPES)}"


@query(_links_sql())
def exfiltration_rewrites(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages without addresses of hosts that are not allowed: images, links and autolinks in Markdown and HTML."""
    seen = Engine([R.exfiltration(ALLOWED)]).run(linked(spark, sf_dir), text="html", side="output")
    return seen.select("page_id", joined(F.array_sort("verdict.categories")).alias("categories"), F.sha2("verdict.content", 256).alias("content"))
