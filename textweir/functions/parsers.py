"""Parsers of model answers, prompt templates and deny globs, as Column functions."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F


def guard_answer(c: Column) -> Column:
    """struct<decided, unsafe, codes> of an answer whose first line is safe or unsafe and whose next lists S-codes."""
    first = F.lower(F.trim(F.get(F.split(F.trim(c), r"\n"), F.lit(0))))
    unsafe = first.startswith("unsafe")
    codes = F.array_distinct(F.regexp_extract_all(F.upper(c), F.lit(r"\b(S\d{1,2})\b"), F.lit(1)))
    return F.struct((unsafe | first.startswith("safe")).alias("decided"), unsafe.alias("unsafe"), F.when(unsafe, codes).otherwise(F.array().cast("array<string>")).alias("codes"))


def policy_answer(c: Column) -> Column:
    """struct<decided, violation, category, rationale> of an answer that is a JSON object, or begins with 0, 1, yes or no."""
    j = F.from_json(F.regexp_extract(c, r"(?s)(\{[^{}]*\})", 1), "violation string, category string, rationale string")
    word = F.lower(F.regexp_extract(c, r"(?i)^\W*(0|1|yes|no)\b", 1))
    said = F.coalesce(F.lower(j["violation"]), F.when(word != "", word))
    yes, no = said.isin("1", "true", "yes"), said.isin("0", "false", "no")
    return F.struct(F.coalesce(yes | no, F.lit(False)).alias("decided"), F.when(yes | no, yes).alias("violation"), j["category"].alias("category"), j["rationale"].alias("rationale"))


def glob(pattern: str) -> str:
    """A deny glob as a regex: * stays within a path part, ** does not."""
    out = re.escape(pattern).replace(r"\*\*", "\x00").replace(r"\*", "[^/]*").replace(r"\?", "[^/]").replace("\x00", ".*")
    return f"^{out}$"


FILTERS = {"upper": F.upper, "lower": F.lower, "trim": F.trim}


def template(text: str, values: dict[str, Column]) -> Column:
    """{{ name | filter }} and {% if name %}..{% endif %} compiled to one expression; unknown names and filters are errors."""

    def value(spec: str) -> Column:
        name, *filters = (x.strip() for x in spec.split("|"))
        c = values[name]
        for f in filters:
            c = FILTERS[f](c)
        return F.coalesce(c.cast("string"), F.lit(""))

    def parts(tokens: list[str]) -> list[Column]:
        out: list[Column] = []
        while tokens:
            t = tokens.pop(0)
            if t.startswith("{{"):
                out.append(value(t[2:-2]))
            elif m := re.fullmatch(r"\{%\s*if\s+([\w.]+)\s*%\}", t):
                inner = parts(tokens)
                c = values[m[1]].cast("string")
                out.append(F.when(F.coalesce(~c.isin("", "false"), F.lit(False)), F.concat(*inner) if inner else F.lit("")).otherwise(""))
            elif re.fullmatch(r"\{%\s*endif\s*%\}", t):
                return out
            elif t.startswith("{%"):
                raise ValueError(f"unknown tag {t}")
            else:
                out.append(F.lit(t))
        return out

    tokens = [t for t in re.split(r"(\{\{.*?\}\}|\{%.*?%\})", text) if t]
    return F.concat(*parts(tokens)) if tokens else F.lit("")
