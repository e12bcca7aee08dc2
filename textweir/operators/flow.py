"""Labels of where values come from and where they may go: a lattice, and the two operations that raise a label, each with an audit row.

A label is struct<provenance, integrity, sinks, capabilities>. Provenance gathers origins. Integrity names the trusted principals behind
a value; an empty one authorizes nothing, and mixing with it gives an empty one. Sinks are an allowlist, null for
no restriction. Capabilities are intersected, and any untrusted origin removes them.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T

#: Kinds of origins, and those that are trusted.
KINDS, PRIVILEGED = ("system", "user", "data", "tool"), ("system", "user")


def words(items: list[str] | None) -> Column:
    return F.lit(None).cast("array<string>") if items is None else T.strings(list(items))


def trusted(origins: Column) -> Column:
    return F.forall(origins, lambda o: o.isin(*PRIVILEGED))


def label(origins: Column, integrity: Column | None = None, sinks: Column | None = None, capabilities: Column | None = None) -> Column:
    """A label; integrity is by default that of its origins where all are trusted, else empty."""
    none, origins = F.array().cast("array<string>"), F.array_distinct(origins)
    own = F.when(trusted(origins), origins).otherwise(none) if integrity is None else F.array_distinct(integrity)
    kept = words(None) if capabilities is None else capabilities
    return F.struct(origins.alias("provenance"), own.alias("integrity"), (words(None) if sinks is None else sinks).alias("sinks"), F.when(trusted(origins), kept).otherwise(none).alias("capabilities"))


def restricted(a: Column, b: Column) -> Column:
    return F.when(a.isNull(), b).when(b.isNull(), a).otherwise(F.array_intersect(a, b))


def mixed(a: Column, b: Column) -> Column:
    """The label of a value made of two; a null label adds nothing."""
    none = F.array().cast("array<string>")
    integrity = F.when((F.size(a["integrity"]) == 0) | (F.size(b["integrity"]) == 0), none).otherwise(F.array_union(a["integrity"], b["integrity"]))
    both = label(F.array_union(a["provenance"], b["provenance"]), integrity, restricted(a["sinks"], b["sinks"]), restricted(a["capabilities"], b["capabilities"]))
    return F.when(a.isNull(), b).when(b.isNull(), a).otherwise(both)


def privileged(x: Column) -> Column:
    return trusted(x["provenance"]) & (F.size(x["integrity"]) > 0)


@dataclass(frozen=True)
class Rule:
    """Who may do an operation, and what it grants: integrity for an endorsement, sinks for a declassification."""

    actors: tuple[str, ...]
    integrity: tuple[str, ...] | None = None
    sinks: tuple[str, ...] | None = None

    def __post_init__(self) -> None:
        if (self.integrity is None) == (self.sinks is None):
            raise ValueError("a rule grants either integrity or sinks")


def operate(cells: DataFrame, rules: dict[str, Rule], operation: str = "operation", cell: str = "label", actor: str = "actor") -> DataFrame:
    """cells with after, the label that the operation gives, and denied: not_granted, unauthorized or null. A denied cell keeps its label.

    The actor's origins become part of the value's: whoever vouched for it is on record.
    """
    x, who = F.col(cell), F.col(actor)
    named = F.col(operation).isin(*rules) if rules else F.lit(False)
    after, allowed = x, F.lit(False)
    for name, rule in rules.items():
        mine = F.col(operation) == name
        origins = F.array_union(x["provenance"], who["provenance"])
        new = label(origins, words(rule.integrity), x["sinks"], x["capabilities"]) if rule.integrity is not None else label(origins, x["integrity"], words(rule.sinks), x["capabilities"])
        after = F.when(mine, new).otherwise(after)
        others = F.array_except(who["provenance"], words(list(rule.actors)))
        allowed = F.when(mine, privileged(who) & (F.size(others) == 0)).otherwise(allowed)
    denied = F.when(~F.coalesce(named, F.lit(False)), "not_granted").when(~F.coalesce(allowed, F.lit(False)), "unauthorized")
    return cells.withColumn("denied", denied).withColumn("after", F.when(F.col("denied").isNull(), after).otherwise(x))


def audit(done: DataFrame, keys: list[str], rules: dict[str, Rule], operation: str = "operation", cell: str = "label", actor: str = "actor") -> DataFrame:
    """One row for each operation that was done: keys, type, operation, actor, before and after as JSON, and a digest of all of them."""
    kind = F.lit(None).cast("string")
    for name, rule in rules.items():
        kind = F.when(F.col(operation) == name, "endorsement" if rule.integrity is not None else "declassification").otherwise(kind)
    rows = done.where("denied is null").select(*keys, kind.alias("type"), F.col(operation).alias("operation"), F.array_join(F.col(actor)["provenance"], ",").alias("actor"), F.to_json(cell).alias("before"), F.to_json("after").alias("after"))
    return rows.withColumn("digest", F.sha2(F.concat_ws("\n", *[F.col(k).cast("string") for k in rows.columns]), 256))
