"""Putting rewritten parts back where they stood in a text, as Column expressions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import let


def replace_first(text: Column, old: Column, new: Column) -> Column:
    """text with the first occurrence of old replaced; unchanged where there is none."""

    def at(i: Column) -> Column:
        return F.when(i > 0, F.concat(F.substring(text, F.lit(1), i - 1), new, F.substring(text, i + F.length(old), F.length(text)))).otherwise(text)

    return let(F.call_function("instr", text, old), at)


def rebuilt(text: Column, parts: Column, old: Callable[[Column], Column], new: Callable[[Column], Column]) -> Column:
    """text with each of parts, in the order in which they stand, replaced: old(part) is what stands there, new(part) what shall.

    Each is looked for behind the one before it. For matches of a pattern that looks at nothing before it, the
    first such string there is the match itself: an earlier one would have matched earlier.
    """

    def step(s: Column, p: Column) -> Column:
        i = F.call_function("instr", s["rest"], old(p))
        done = F.concat(s["done"], F.substring(s["rest"], F.lit(1), i - 1), new(p))
        return F.when(i > 0, F.struct(done.alias("done"), F.substring(s["rest"], i + F.length(old(p)), F.length(s["rest"])).alias("rest"))).otherwise(s)

    start = F.struct(F.lit("").alias("done"), text.alias("rest"))
    return F.aggregate(parts, start, step, lambda s: F.concat(s["done"], s["rest"]))


def common(a: Column, b: Column) -> Column:
    """How many characters a and b share at their start; linear in their length."""
    n = F.least(F.length(a), F.length(b))
    other = F.zip_with(F.slice(F.split(a, ""), F.lit(1), n), F.slice(F.split(b, ""), F.lit(1), n), lambda x, y: x != y)
    return F.when(n == 0, 0).otherwise(let(F.array_position(other, True).cast("int"), lambda p: F.when(p > 0, p - 1).otherwise(n)))


def aligned(text: Column, view: Column, new: Column) -> Column:
    """text, of which view is a reading character by character, with the edit that made new out of view."""

    def cut(first: Column) -> Column:
        tail_old, tail_new = F.substring(view, first + 1, F.length(view)), F.substring(new, first + 1, F.length(new))

        def put(last: Column) -> Column:
            middle = F.substring(new, first + 1, F.length(new) - first - last)
            return F.concat(F.substring(text, F.lit(1), first), middle, F.substring(text, F.length(text) - last + 1, last))

        return let(common(F.reverse(tail_old), F.reverse(tail_new)), put)

    return let(common(view, new), cut)
