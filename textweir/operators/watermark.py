"""Invisible marks that say a text was generated, and by whom: put in, taken out, read and verified, as Column expressions.

A mark is eleven bytes as variation selectors at the end of a paragraph: two that name it, a version, and the
first eight of an HMAC-SHA256 over the paragraph's words with the issuer (zeros without a key). Fenced and indented
code is never marked. A text that carries a valid mark stays as it is, so marking twice is marking once.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions import text as T
from . import rails as R

# fixed values: what names a mark, its version, bytes of its tag; and what our tags are computed for
MAGIC, VERSION, TAG, DOMAIN = (0xA1, 0x50), 1, 8, "textweir/watermark/v1"
SELECTORS = [chr(0xFE00 + b) if b < 16 else chr(0xE0100 + b - 16) for b in range(256)]
MARK = "".join(rf"\x{{{ord(SELECTORS[b]):X}}}" for b in MAGIC) + r"[\x{FE00}-\x{FE0F}\x{E0100}-\x{E01EF}]{9}"
GAP, FENCE, INDENTED = r"\n[ \t]*\n", r"(?m)^[ \t]*(?:```|~~~)", r"(?m)^(?: {4}|\t)"


def hmac(key: bytes, message: Column) -> Column:
    """HMAC-SHA256 of a text's UTF-8 bytes, in hex; the key is a constant of the plan."""
    block = (hashlib.sha256(key).digest() if len(key) > 64 else key).ljust(64, b"\0")
    inner = F.sha2(F.concat(F.lit(bytes(b ^ 0x36 for b in block)), F.encode(message, "UTF-8")), 256)
    return F.sha2(F.concat(F.lit(bytes(b ^ 0x5C for b in block)), F.unhex(inner)), 256)


def strip(text: Column) -> Column:
    """Every mark removed, and nothing else."""
    return F.regexp_replace(text, MARK, "")


def marks(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(MARK), F.lit(0))


def canonical(text: Column) -> Column:
    """What a tag is computed over: rewrapping a paragraph does not change it."""
    return F.regexp_replace(F.regexp_replace(strip(text), r"\s+", " "), T.BLANK, "")


def payload(text: Column, key: str | None, issuer: Column) -> Column:
    """The mark of a paragraph, as selectors."""
    if not key:
        return F.lit("".join(SELECTORS[b] for b in (*MAGIC, VERSION, *[0] * TAG)))
    digest = hmac(key.encode(), F.concat(F.lit(DOMAIN + "\n"), F.coalesce(issuer, F.lit("")), F.lit("\n"), canonical(text)))
    table = F.array(*map(F.lit, SELECTORS))

    def selectors(d: Column) -> Column:
        byte = F.transform(F.sequence(F.lit(0), F.lit(TAG - 1)), lambda i: F.conv(F.substring(d, i * 2 + 1, F.lit(2)), 16, 10).cast("int"))
        return F.array_join(F.transform(byte, lambda b: F.get(table, b)), "")

    tag = T.let(digest, selectors)  # one digest a paragraph, not one for each byte of it
    return F.concat(F.lit("".join(SELECTORS[b] for b in (*MAGIC, VERSION))), tag)


def authentic(segment: Column, key: str | None, issuer: Column) -> Column:
    return segment.rlike(MARK) & F.array_contains(marks(segment), payload(segment, key, issuer)) if key else F.lit(False)


def blank(c: Column) -> Column:
    return ~c.rlike(r"[^\x00\s]")


def segments(text: Column) -> Column:
    """array<struct<text, gap, code>>: paragraphs, what stands after each, and whether it is code: in or at a fence, or with an indented line."""
    parts = F.arrays_zip(F.split(text, GAP, -1).alias("text"), F.regexp_extract_all(text, F.lit(GAP), F.lit(0)).alias("gap"))
    fences = F.transform(parts, lambda p: F.regexp_count(p["text"], F.lit(FENCE)))

    def with_fences(n: Column) -> Column:
        # whether a fence stands open before a paragraph: an odd number of them so far
        before = F.aggregate(n, F.struct(F.lit(0).alias("sum"), F.array().cast("array<boolean>").alias("open")), lambda s, x: F.struct((s["sum"] + x).alias("sum"), F.concat(s["open"], F.array(s["sum"] % 2 == 1)).alias("open")))["open"]
        return T.let(before, lambda o: F.transform(parts, lambda p, i: F.struct(p["text"].alias("text"), F.coalesce(p["gap"], F.lit("")).alias("gap"), (F.get(o, i) | (F.get(n, i) > 0) | p["text"].rlike(INDENTED)).alias("code"))))

    return T.let(fences, with_fences)


def mark(text: Column, key: str | None = None, issuer: Column | None = None) -> Column:
    """text with a mark in each paragraph that is no code, before the blanks at its end."""
    issuer = F.lit("") if issuer is None else issuer

    def put(s: Column) -> Column:
        def with_body(bare: Column) -> Column:
            body = F.regexp_replace(bare, r"\s+\z", "")
            return F.concat(body, payload(bare, key, issuer), F.substring(bare, F.length(body) + 1, F.length(bare)))

        same = s["code"] | blank(strip(s["text"])) | authentic(s["text"], key, issuer)
        return F.concat(F.when(same, s["text"]).otherwise(T.let(strip(s["text"]), with_body)), s["gap"])

    return F.array_join(F.transform(segments(text), put), "")


def verify(text: Column, key: str | None = None, issuer: Column | None = None) -> Column:
    """struct<marked, authentic, coverage, segments>: whether any paragraph has a mark, and one of this key; the share that has one of it."""
    issuer = F.lit("") if issuer is None else issuer
    rows = F.filter(F.transform(segments(text), lambda s: F.struct(blank(strip(s["text"])).alias("blank"), (F.size(marks(s["text"])) > 0).alias("marked"), authentic(s["text"], key, issuer).alias("own"))), lambda r: ~r["blank"])

    def told(r: Column) -> Column:
        own = F.size(F.filter(r, lambda x: x["own"]))
        return F.struct(F.exists(r, lambda x: x["marked"]).alias("marked"), (own > 0).alias("authentic"), F.coalesce(F.try_divide(own, F.size(r)), F.lit(0.0)).alias("coverage"), F.size(r).alias("segments"))

    return T.let(rows, told)


def watermark(key: str | None = None, issuer: str | None = None) -> R.Rail:
    """Marks answers; not while they are still arriving."""
    def decide(text: Column, _: dict) -> Column:
        said = F.array(F.lit("watermark"), F.lit("watermark:signed" if key else "watermark:unsigned"))
        return T.let(mark(text, key, F.lit(issuer or "")), lambda m: R.rewritten(text, m, F.when(m != text, said).otherwise(R.none())))

    return R.Rail("watermark", decide, ("output",), incremental=False, language_agnostic=True)
