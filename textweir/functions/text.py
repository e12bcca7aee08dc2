"""The language layer as Column functions: everything stays in the JVM."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from . import lookalikes
from . import values as V

SEPARATOR = "\x1f"
BLANK = r"^[\x00\s]+|[\x00\s]+$"


def strings(items: list[str]) -> Column:
    """A constant array, as one expression that the optimizer folds."""
    return F.split(F.lit(SEPARATOR.join(items)), SEPARATOR) if items else F.array().cast("array<string>")


def let(value: Column, body) -> Column:
    """body(value) with the value computed once: lambdas otherwise compute what they close over for each element."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def usable(c: Column) -> Column:
    """Text from bytes or text; broken UTF-8 becomes U+FFFD."""
    return F.make_valid_utf8(c)


def normalize(c: Column) -> Column:
    """Compatibility forms, then lower case, runs of other than letters and digits as one space."""
    return spaced(F.lower(lookalikes.compatibility(c)))


def spaced(c: Column) -> Column:
    """Runs of other than letters and digits as one space."""
    return F.trim(F.regexp_replace(c, r"[^\p{IsAlphabetic}\p{Nd}]+", " "))


def nfkc(c: Column) -> Column:
    """Compatibility normalisation; Spark has no function for it, so this is one Arrow UDF over non-ASCII text only."""

    @F.pandas_udf("string")
    def fold(s: pd.Series) -> pd.Series:
        return s.map(lambda x: None if x is None else unicodedata.normalize("NFKC", x))

    return F.when(c.rlike(r"[^\x00-\x7F]"), fold(F.when(c.rlike(r"[^\x00-\x7F]"), c))).otherwise(c)


def words(c: Column) -> Column:
    return F.filter(F.split(normalize(c), " "), lambda x: x != "")


def stem(w: Column) -> Column:
    """Suffix rules; the first that matches applies, words of up to three letters stay."""
    n = F.length(w)

    def cut(k: int) -> Column:
        return F.substring(w, F.lit(1), n - k)

    def ends(s: str, least: int) -> Column:
        return w.endswith(s) & (n >= least)

    before_s = F.substring(w, n - 1, F.lit(1))
    return (
        F.when(n <= 3, w)
        .when(ends("ies", 4), F.concat(cut(3), F.lit("y")))
        .when(ends("sses", 5), cut(2))
        .when(ends("s", 3) & ~before_s.isin("s", "u"), cut(1))
        .when(ends("ing", 6), silent_e(cut(3)))
        .when(ends("ed", 5), silent_e(cut(2)))
        .when(ends("ly", 5), cut(2))
        .otherwise(w)
    )


def silent_e(b: Column) -> Column:
    """A doubled final consonant is undone; else consonant, vowel, consonant get their e back."""
    n = F.length(b)
    last, second = F.substring(b, n, F.lit(1)), F.substring(b, n - 1, F.lit(1))
    doubled = (n > 3) & (last == second) & ~last.isin(*"aeiou")
    return F.when(doubled, F.substring(b, F.lit(1), n - 1)).when(b.rlike("[^aeiou][aeiou][^aeiouy]$"), F.concat(b, F.lit("e"))).otherwise(b)


def clauses(c: Column) -> Column:
    parts = F.transform(F.split(c, r"(?<=[.!?;:])\s+|\n+|\r+"), lambda x: F.regexp_replace(x, BLANK, ""))
    return F.filter(parts, lambda x: x != "")


def lowered_clauses(c: Column) -> Column:
    """Clauses in compatibility forms and lower case, which spaced() makes normal; what has no such forms is looked at and lowered whole, not clause by clause."""
    each = F.transform(clauses(c), lambda x: F.lower(lookalikes.compatibility(x)))
    return F.when(lookalikes.holds(c, lookalikes.compatible()), each).otherwise(clauses(F.lower(c)))


def longest(items: Column, most: int) -> Column:
    """The longest of an array of texts, longest first, of equal ones the earlier."""
    placed = F.transform(items, lambda x, k: F.struct((-F.length(x)).alias("n"), k.alias("k"), x.alias("x")))
    return F.transform(F.slice(F.array_sort(placed), 1, most), lambda p: p["x"])


def grams(c: Column, size: int = 4) -> Column:
    """Character n-grams of the normalised text, in order and with repeats; a shorter text is its own."""

    def of(body: Column) -> Column:
        n = F.length(body)
        every = F.transform(F.sequence(F.lit(1), F.greatest(F.lit(1), n - size + 1)), lambda i: F.substring(body, i, F.lit(size)))
        return F.when(n <= size, F.array(body)).otherwise(every)

    return let(normalize(c), of)


def shingles(c: Column, size: int = 4) -> Column:
    """Distinct character n-grams of the normalised text; a shorter text is its own."""
    return F.array_distinct(grams(c, size))


def containment(needle: Column, hay: Column) -> Column:
    return F.when(F.size(needle) == 0, 0.0).otherwise(F.size(F.array_intersect(needle, hay)) / F.size(needle))


def jaccard(a: Column, b: Column) -> Column:
    union = F.size(F.array_union(a, b))
    return F.when(union == 0, 0.0).otherwise(F.size(F.array_intersect(a, b)) / union)


def function_word_language(tokens: Column) -> Column:
    """en or nl by distinct function words and their share, else unknown; ties go to the earlier language."""

    def scored(code: str, own: list[str]) -> Column:
        hits = F.size(F.array_intersect(strings(own), tokens))
        share = F.coalesce(F.try_divide(F.size(F.filter(tokens, lambda t: t.isin(*own))), F.size(tokens)), F.lit(0.0))
        return F.struct(hits.alias("hits"), share.alias("share"), F.lit(code).alias("code"))

    best = None
    for code, own in V.FUNCTION_WORDS.items():
        one = scored(code, own)
        best = one if best is None else F.when((one["hits"] > best["hits"]) | (one["hits"] == best["hits"]) & (one["share"] > best["share"]), one).otherwise(best)
    ok = (F.size(tokens) >= 12) & (best["hits"] >= 3) & (best["share"] >= 0.04)
    return F.when(ok, best["code"]).otherwise(F.lit("unknown"))


def rot13(c: Column) -> Column:
    a = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    b = a[13:] + a[:13]
    return F.translate(c, a + a.lower(), b + b.lower())


def scrub(c: Column) -> Column:
    """Without invisible characters and runs of variation selectors; all but backspace are beyond ASCII, which is told by one cheap test."""
    other = r"[^\x00-\x07\x09-\x7F]"
    return F.when(c.rlike(other), F.regexp_replace(F.regexp_replace(c, f"(?={other}){V.INVISIBLE}", ""), V.SELECTOR_RUN, "")).otherwise(c)


def decode_base64(c: Column) -> Column:
    """Printable ASCII that base64 runs of the text decode to, by line; null if there is none."""
    runs = F.regexp_extract_all(c, F.lit(rf"(?<![A-Za-z0-9+/=])({V.BASE64_RUN})(?![A-Za-z0-9+/=])"), F.lit(1))
    plain = F.transform(runs, lambda r: F.try_to_binary(r, F.lit("base64")).cast("string"))
    plain = F.filter(plain, lambda t: F.coalesce(t.rlike(r"^[\x20-\x7E\n\t]+$"), F.lit(False)))
    return F.when(F.size(plain) > 0, F.array_join(plain, "\n"))


def payloads(c: Column, runs: str, byte) -> Column:
    """Printable ASCII of at least eight characters that runs of carrier characters spell, by line; byte maps a code point to a byte."""

    def read(run: Column) -> Column:
        codes = F.transform(F.split(run, ""), lambda x: byte(F.ascii(x)))
        plain = F.filter(codes, lambda b: (b >= 32) & (b < 127) | b.isin(9, 10))
        ok = ~F.exists(codes, lambda b: (b < 0) | (b > 127))
        said = F.array_join(F.transform(plain, lambda b: F.char(b)), "")
        return F.when(ok & (F.length(said) >= 8) & (F.trim(said) != ""), said)

    found = F.filter(F.transform(F.regexp_extract_all(c, F.lit(f"({runs})"), F.lit(1)), read), lambda x: x.isNotNull())
    return F.when(c.rlike(r"[^\x00-\x7F]"), F.when(F.size(found) > 0, F.array_join(found, "\n")))


def decode_tags(c: Column) -> Column:
    """What characters of the tag block spell."""
    return payloads(c, V.TAG_RUN, lambda p: p - 0xE0000)


def decode_selectors(c: Column) -> Column:
    """What variation selectors spell: the first sixteen, then the supplement."""
    return payloads(c, V.SELECTOR_PAYLOAD, lambda p: F.when(p < 0xE0100, p - 0xFE00).otherwise(p - 0xE0100 + 16))


def luhn(c: Column) -> Column:
    """13 to 19 digits, separators aside, with a valid check digit."""
    digits = F.regexp_replace(c, r"\D", "")
    return F.length(digits).between(13, 19) & F.call_function("luhn_check", digits)


def bsn(c: Column) -> Column:
    """Nine digits, not all equal, that pass the weighted test modulo 11."""
    digits = F.regexp_replace(c, r"\D", "")
    total = F.aggregate(
        F.sequence(F.lit(1), F.lit(9)),
        F.lit(0),
        lambda a, i: a + F.substring(digits, i, F.lit(1)).cast("int") * F.when(i == 9, -1).otherwise(10 - i),
    )
    return (F.length(digits) == 9) & ~digits.rlike("^(0+|1+|2+|3+|4+|5+|6+|7+|8+|9+)$") & (F.pmod(total, F.lit(11)) == 0)


def host(url: Column) -> Column:
    """Host of an http or https address, else null."""
    ok = F.try_parse_url(url, F.lit("PROTOCOL")).isin("http", "https")
    return F.when(ok, F.lower(F.try_parse_url(url, F.lit("HOST"))))


def cosine(a: Column, b: Column) -> Column:
    """0 where a norm is 0; vectors of different lengths are an error."""

    def dot(x: Column, y: Column) -> Column:
        return F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda s, v: s + v)

    norms = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    same = F.assert_true(F.size(a) == F.size(b)).isNull()
    return F.when(same & (norms == 0), 0.0).otherwise(dot(a, b) / norms)


def fnv1a(c: Column, buckets: int, start: int = 2166136261) -> Column:
    """32-bit FNV-1a of the UTF-8 bytes, modulo buckets."""
    raw = F.hex(F.encode(c, "UTF-8"))
    n = (F.length(raw) / 2).cast("int")
    byte = F.transform(F.when(n > 0, F.sequence(F.lit(1), n)).otherwise(F.array().cast("array<int>")), lambda i: F.conv(F.substring(raw, i * 2 - 1, F.lit(2)), 16, 10).cast("bigint"))
    done = F.aggregate(byte, F.lit(start).cast("bigint"), lambda h, b: F.pmod(h.bitwiseXOR(b) * 16777619, F.lit(4294967296)))
    return F.pmod(done, F.lit(buckets))


def logit(p: Column) -> Column:
    return F.log(p / (1 - p))


def logistic(x: Column) -> Column:
    """Stable for either sign."""
    return F.when(x >= 0, 1 / (1 + F.exp(-x))).otherwise(F.exp(x) / (1 + F.exp(x)))


def wilson(hits: Column, n: Column) -> tuple[Column, Column]:
    """95 % interval of a rate; null without trials."""
    z = 1.959963984540054
    p = hits / n
    mid, half = p + z * z / (2 * n), z * F.sqrt(p * (1 - p) / n + z * z / (4 * n * n))
    low, high = ((mid - half) / (1 + z * z / n)), ((mid + half) / (1 + z * z / n))
    return F.when(n > 0, F.greatest(F.lit(0.0), low)), F.when(n > 0, F.least(F.lit(1.0), high))
