"""Conversation structure repair: the cheapest edits after which roles read an optional system turn, then user and assistant by turns.

1. Windows over a conversation number its rows by turn and flag faults: blank, duplicate (role and text seen
   earlier), truncated (the text does not end a sentence), and roles that do not follow each other.
2. The numbered rows, without their texts, are collected in segments of SEGMENT rows and folded by aggregate(): four
   structs (cost, audit), one for each state of the grammar, go from row to row through least(). The states
   are: nothing yet, after system, after user, after assistant. A later segment is folded once from each
   state, and a second fold joins the segments, so a conversation of any length stays in bounded rows.
3. The audit, one letter an edit, is taken apart again, joined with the rows, and gives the repaired turns.
   Their digest is taken in a stream over sorted rows, so no task holds a whole conversation's texts.

Letters: K keep, R give the role that the grammar wants, D delete, I insert an empty turn. Of edits of equal
cost the audit that is least in ASCII order counts. Equal prefixes cannot hide a better end: two audits of one
state and cost never have one the beginning of the other, as that would need more insertions, which cost.

Nulls: a null role or text is one space (so a null text is blank); a null conv_id is a conversation like others; null turns come
first and count in no gap. Rows with the same turn go by role and text. A table without rows gives none. Texts may be of
any length. Extra columns are not read. A conversation's windows and its digest run in one task each, in
sorted streams that spill; its audit is one value of one letter an edit.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import let
from . import shared

SEGMENT = 512
#: What edits cost, and what a kept truncated row adds.
RENAME, DELETE, INSERT, CUT_OFF = 2, 3, 2, 1
FAR = 1 << 50
WHITE = r"\x20\x09-\x0D"


def numbered(turns: DataFrame) -> DataFrame:
    """conv_id, turn, role, text, pos (from 1), fault (blank, duplicate, truncated or null), illegal and new_turn flags."""
    rows = turns.select("conv_id", "turn", F.coalesce("role", F.lit(" ")).alias("role"), F.coalesce("text", F.lit(" ")).alias("text"))
    order = Window.partitionBy("conv_id").orderBy(F.asc_nulls_first("turn"), "role", "text")
    rows = rows.withColumns({"pos": F.row_number().over(order), "turn_before": F.lag("turn").over(order), "role_before": F.lag("role").over(order)})
    seen = F.row_number().over(Window.partitionBy("conv_id", "role", "text").orderBy("pos")) > 1
    initials = F.concat(F.substring("role_before", 1, 1), F.substring("role", 1, 1))
    fault = F.when(~F.col("text").rlike(f"[^{WHITE}]"), "blank").when(seen, "duplicate").when(F.col("text").rlike(rf"[^{WHITE}.!?][{WHITE}]*\z"), "truncated")
    return rows.select(
        "conv_id", "turn", "role", "text", "pos", fault.alias("fault"),
        (F.col("role_before").isNotNull() & ~initials.isin("su", "ua", "au")).alias("illegal"),
        (F.col("turn").isNotNull() & (F.col("turn_before").isNull() | (F.col("turn_before") != F.col("turn")))).alias("new_turn"),
    )


def state(cost: Column | int, audit: Column | str) -> Column:
    cost, audit = (F.lit(x) if isinstance(x, int | str) else x for x in (cost, audit))
    return F.struct(cost.cast("long").alias("cost"), audit.alias("audit"))


def edited(s: Column, cost: Column | int, letter: Column | str) -> Column:
    return state(s["cost"] + cost, F.concat(s["audit"], F.lit(letter) if isinstance(letter, str) else letter))


def with_inserts(v: list[Column]) -> list[Column]:
    """The states after as many insertions as help: a user turn, an assistant turn, or both."""
    user = F.least(v[2], *[edited(v[i], INSERT, "I") for i in (0, 1, 3)])
    return [v[0], v[1], user, F.least(v[3], edited(v[2], INSERT, "I"), *[edited(v[i], 2 * INSERT, "II") for i in (0, 1)])]


def packed(v: list[Column]) -> Column:
    return F.struct(*[x.alias(f"s{i}") for i, x in enumerate(v)])


def states(v: Column) -> list[Column]:
    return [v[f"s{i}"] for i in range(4)]


def after(acc: Column, x: Column) -> Column:
    """The four states after row x: struct of initial, must (it has to go) and late (it is truncated)."""
    v = states(acc)
    late = F.when(x["late"], CUT_OFF).otherwise(0)

    def to(role: str, come: Column, gone: Column) -> Column:
        keep = x["initial"] == role
        stay = edited(come, late + F.when(keep, 0).otherwise(RENAME), F.when(keep, "K").otherwise("R"))
        return F.when(x["must"], gone).otherwise(F.least(gone, stay))

    gone = [edited(s, DELETE, "D") for s in v]
    system = F.when(x["must"] | (x["initial"] != "s"), gone[1]).otherwise(F.least(gone[1], edited(v[0], late, "K")))
    raw = packed([gone[0], system, to("u", F.least(v[0], v[1], v[3]), gone[2]), to("a", v[2], gone[3])])
    return let(raw, lambda r: packed(with_inserts(states(r))))


def begun(start: int) -> Column:
    return packed(with_inserts([state(0 if i == start else FAR, "") for i in range(4)]))


def folded(rows: DataFrame) -> DataFrame:
    """conv_id, cost, audit of each conversation's cheapest edits; rows as of numbered()."""
    must = F.coalesce(F.col("fault").isin("blank", "duplicate"), F.lit(False))
    late = F.coalesce(F.col("fault") == "truncated", F.lit(False))
    item = F.struct("pos", F.substring("role", 1, 1).alias("initial"), must.alias("must"), late.alias("late"))
    parts = rows.groupBy("conv_id", F.floor((F.col("pos") - 1) / SEGMENT).alias("seg")).agg(F.sort_array(F.collect_list(item)).alias("items"))
    from_each = [F.aggregate("items", begun(i), after) for i in range(4)]
    parts = parts.select("conv_id", "seg", F.when(F.col("seg") == 0, F.array(from_each[0])).otherwise(F.array(*from_each)).alias("m"))
    every = parts.groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("seg", "m"))).alias("parts"))

    def joined(acc: Column, part: Column) -> Column:
        def plus(i: int, j: int) -> Column:
            a, b = acc[f"s{i}"], part["m"][i][f"s{j}"]
            return state(a["cost"] + b["cost"], F.concat(a["audit"], b["audit"]))

        return packed([F.least(*[plus(i, j) for i in range(4)]) for j in range(4)])

    total = F.aggregate(F.slice("parts", 2, F.greatest(F.size("parts") - 1, F.lit(1))), F.get(F.get("parts", F.lit(0))["m"], F.lit(0)), joined)
    best = every.select("conv_id", let(total, lambda v: F.least(v["s0"], v["s3"])).alias("best"))
    return best.select("conv_id", "best.cost", "best.audit")


def repaired(rows: DataFrame, plan: DataFrame) -> DataFrame:
    """conv_id, k (from 1), role, text of the turns after the edits of plan (conv_id, audit)."""
    length = F.length(F.replace("audit", F.lit("D"), F.lit("")))
    edits = plan.select("conv_id", (length % 2).alias("system"), F.posexplode(F.split("audit", "")).alias("ord", "edit")).where("edit <> ''")
    order = Window.partitionBy("conv_id").orderBy("ord").rowsBetween(Window.unboundedPreceding, 0)
    edits = edits.withColumns({"k": F.sum((F.col("edit") != "D").cast("int")).over(order), "pos": F.sum((F.col("edit") != "I").cast("int")).over(order)}).where("edit <> 'D'")
    role = F.when((F.col("k") - F.col("system")) % 2 == 1, "user").otherwise("assistant")
    made = edits.where("edit = 'I'").select("conv_id", "k", role.alias("role"), F.lit("").alias("text"))
    kept = edits.where("edit <> 'I'").select(F.col("conv_id").alias("_id"), "k", F.col("pos").alias("_pos"), F.when(F.col("edit") == "R", role).alias("_role"))
    own = rows.join(kept, F.col("conv_id").eqNullSafe(F.col("_id")) & (F.col("pos") == F.col("_pos")))
    return own.select("conv_id", "k", F.coalesce("_role", "role").alias("role"), "text").unionByName(made)


def digests(turns: DataFrame) -> DataFrame:
    """conv_id, sha256 (lower-case hex) of role:text of the turns in the order of k, joined by newlines."""

    def stream(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, sha, schema = None, None, None
        for b in batches:
            schema, out = b.schema, []
            for i, said in zip(b.column(0).to_pylist(), b.column(1).cast(pa.binary()).to_pylist(), strict=True):
                if sha is not None and i == now:
                    sha.update(b"\n")
                else:
                    out += [(now, sha.hexdigest())] if sha is not None else []
                    now, sha = i, hashlib.sha256()
                sha.update(said)
            yield pa.record_batch([pa.array([x[0] for x in out], schema.field(0).type), pa.array([x[1] for x in out], pa.string())], ["conv_id", "sha256"])
        if sha is not None:
            yield pa.record_batch([pa.array([now], schema.field(0).type), pa.array([sha.hexdigest()], pa.string())], ["conv_id", "sha256"])

    kind = turns.schema["conv_id"].dataType.simpleString()
    lines = turns.repartition("conv_id").sortWithinPartitions("conv_id", "k").select("conv_id", F.concat("role", F.lit(":"), "text").alias("line"))
    return lines.mapInArrow(stream, f"conv_id {kind}, sha256 string")


def repair(turns: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(conversations, repaired turns): conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit; conv_id, k, role, text."""
    rows = shared.written(numbered(turns), "turns")
    plan = shared.written(folded(rows), "edits")
    faults = [F.sum((F.coalesce(F.col("fault"), F.lit("")) == f).cast("long")).alias(f) for f in ("blank", "duplicate", "truncated")]
    gaps = F.coalesce(F.max("turn") - F.min("turn") + 1 - F.sum(F.col("new_turn").cast("long")), F.lit(0)).cast("long")
    counts = rows.groupBy("conv_id").agg(gaps.alias("gaps"), *faults, F.sum(F.col("illegal").cast("long")).alias("illegal"))
    same = counts["conv_id"].eqNullSafe(plan["conv_id"])
    return counts.join(plan, same).select(counts["*"], "cost", "audit"), repaired(rows, plan)
