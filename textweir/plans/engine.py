"""Engines: ordered rails over a text column, compiled to one projection per rail."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators.rails import Rail, none

STATE = "_state"


def folded(r: Rail, s: Column) -> Callable[[Column], Column]:
    """The state after a rail's verdict v; null where the rail did not look."""

    def step(v: Column) -> Column:
        changed = (v["status"] == "modified") & (v["content"] != s["content"])
        doubt = v.isNotNull() & ~v["certain"]
        new = F.struct(
            v["content"].alias("content"),
            F.when(v["status"] == "blocked", F.lit(r.name)).alias("rail"),
            F.when(v["status"] == "blocked", v["categories"]).otherwise(none()).alias("categories"),
            F.when(doubt & (s["unsure"].isNull() | ~s["real"] & F.lit(not r.placeholder)), F.lit(r.name)).otherwise(s["unsure"]).alias("unsure"),
            (s["real"] | doubt & F.lit(not r.placeholder)).alias("real"),
            F.when(changed, F.concat(s["rewritten_by"], F.array(F.lit(r.name)))).otherwise(s["rewritten_by"]).alias("rewritten_by"),
            F.when(changed, F.array_union(s["changes"], v["categories"])).otherwise(s["changes"]).alias("changes"),
        )
        return F.when(v.isNotNull(), new).otherwise(s)

    return step


@dataclass(frozen=True)
class Engine:
    """Rails run in order; the first block stops, rewrites thread on, uncertainty stays."""

    rails: list[Rail] = field(default_factory=list)

    def run(self, df: DataFrame, text: str = "text", side: str = "input", context: dict[str, Column] | None = None, into: str = "verdict") -> DataFrame:
        """df with a verdict column: status, rail, content, categories, certain, rewritten_by.

        Without rails everything passes, uncertain. A null text passes as it is.
        """
        ctx = {"side": F.lit(side), **(context or {})}
        rails = [r for r in self.rails if side in r.sides]
        first = F.struct(F.col(text).alias("content"), F.lit(None).cast("string").alias("rail"), none().alias("categories"), F.lit(None).cast("string").alias("unsure"), F.lit(False).alias("real"), none().alias("rewritten_by"), none().alias("changes"))
        out = df.withColumn(STATE, first)
        for r in rails:
            s = F.col(STATE)
            # a blocked row is not looked at again: CASE branches are lazy in built-in expressions
            # what runs in Python is not lazy: such rails ask whether the row is still live
            live = s["rail"].isNull() & s["content"].isNotNull()
            seen = F.when(live, r.decide(s["content"], {**ctx, "live": live}))
            out = out.withColumn(STATE, T.let(seen, folded(r, s)))
        s = F.col(STATE)
        modified = F.size(s["rewritten_by"]) > 0
        status = F.when(s["rail"].isNotNull(), "blocked").when(modified, "modified").otherwise("passed")
        name = F.coalesce(s["rail"], F.when(modified, F.element_at(s["rewritten_by"], -1)), s["unsure"])
        categories = F.when(s["rail"].isNotNull(), s["categories"]).otherwise(s["changes"])
        certain = s["unsure"].isNull() & F.lit(bool(rails))
        out = out.withColumn(into, F.struct(status.alias("status"), name.alias("rail"), s["content"].alias("content"), categories.alias("categories"), certain.alias("certain"), s["rewritten_by"].alias("rewritten_by")))
        return out.drop(STATE)

    def run_distinct(self, df: DataFrame, text: str = "text", side: str = "input", into: str = "verdict") -> DataFrame:
        """The same as run(), with each distinct text looked at once: for dear rails over texts with many copies.

        Texts are told apart by SHA-256; rows meet their text's verdict in a join that the engine may split where one text has many rows.
        """
        d = df.withColumn("_text_key", F.coalesce(F.sha2(F.col(text), 256), F.lit("")))
        once = self.run(d.groupBy("_text_key").agg(F.any_value(text).alias(text)), text, side, into=into).select("_text_key", into)
        return d.join(once, "_text_key").drop("_text_key")

    def screen(self, df: DataFrame, text: str = "text", side: str = "context") -> tuple[DataFrame, DataFrame]:
        """(kept, rejected): kept rows carry the rewritten text, both keep their columns and verdict."""
        seen = self.run(df, text, side)
        blocked = F.col("verdict.status") == "blocked"
        return seen.where(~blocked).withColumn(text, F.col("verdict.content")), seen.where(blocked)

    def observe(self, df: DataFrame, text: str = "text", side: str = "input", context: dict[str, Column] | None = None) -> DataFrame:
        """df with fired: map of rail to whether it blocks the original text; every rail looks, rewrites do not thread."""
        ctx = {"side": F.lit(side), **(context or {})}
        rails = [r for r in self.rails if side in r.sides and not r.posture]
        seen = F.map_from_arrays(F.array(*[F.lit(r.name) for r in rails]), F.array(*[r.decide(F.col(text), ctx)["status"] == "blocked" for r in rails]))
        certain = [r.decide(F.col(text), ctx)["certain"] for r in self.rails if side in r.sides]
        every = certain[0] if certain else F.lit(False)
        for c in certain[1:]:
            every = every & c
        return df.withColumn("fired", seen).withColumn("certain", every)
