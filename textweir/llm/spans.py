"""Positions of all matches of a regular expression, by DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def running(lengths: Column) -> Column:
    """Exclusive running sums of an int array, in two levels so that copying stays small on long arrays."""
    step = 256
    chunks = F.transform(
        F.sequence(F.lit(0), F.greatest(F.lit(0), ((F.size(lengths) - 1) / step).cast("int"))),
        lambda c: F.slice(lengths, (c * step + 1).cast("int"), step),
    )
    inner = F.transform(
        chunks,
        lambda a: F.aggregate(
            a,
            F.struct(F.lit(0).alias("at"), F.array().cast("array<int>").alias("all")),
            lambda acc, x: F.struct((acc["at"] + x).alias("at"), F.concat(acc["all"], F.array(acc["at"])).alias("all")),
        ),
    )
    outer = F.aggregate(
        inner,
        F.struct(F.lit(0).alias("at"), F.array().cast("array<array<int>>").alias("all")),
        lambda acc, x: F.struct((acc["at"] + x["at"]).alias("at"), F.concat(acc["all"], F.array(F.transform(x["all"], lambda v: v + acc["at"]))).alias("all")),
    )
    return F.flatten(outer["all"])


def matches(text: Column, regex: Column) -> Column:
    """array<struct<s int, e int>> of the leftmost non-overlapping matches, in code points, end exclusive.

    The regex must not match the empty string. split() gives the gaps between matches, so the running
    sums of gap and match lengths are the positions.
    """
    hits = F.transform(F.regexp_extract_all(text, regex, F.lit(0)), lambda m: F.length(m))
    gaps = F.transform(F.split(text, regex, -1), lambda g: F.length(g))
    before = running(F.zip_with(hits, F.slice(gaps, 1, F.size(hits)), lambda h, g: h + g))
    return F.zip_with(F.zip_with(before, gaps, lambda b, g: b + g), hits, lambda s, h: F.when(h.isNotNull(), F.struct(s.alias("s"), (s + h).alias("e"))))


def matches_of(text: Column, regex: str, gate: Column) -> Column:
    """matches(), but empty where the gate is false; the trailing gap's null is dropped."""
    found = F.filter(matches(text, F.lit(regex)), lambda x: x.isNotNull())
    return F.when(gate, found).otherwise(F.array().cast("array<struct<s:int,e:int>>"))
