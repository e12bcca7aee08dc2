"""Assessment that stops where the rails left cannot change what is done.

Cheap rails look at every row. What the dear ones could still add is bounded by their measured operating
points, group by group, so where the action is the same at both ends they are not asked. Nothing is guessed: actions
are those of the full run. A rail without an operating point adds nothing; one that could not decide says nothing,
and neither does the silence of a rail that cannot read a text's language.
"""

from __future__ import annotations

from itertools import product

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import assess
from ..operators.rails import Rail


def said(text: Column, rails: list[Rail], ctx: dict[str, Column]) -> tuple[dict[str, Column], Column]:
    """(what each rail says of a text: true, false or null, whether all were certain); posture rails tell whether silence counts."""
    readable = F.lit(True)
    for r in rails:
        if r.posture:
            readable = readable & r.decide(text, ctx)["certain"]
    out, sure = {}, readable
    for r in rails:
        if not r.posture:
            v = r.decide(text, ctx)
            silent = F.when(v["certain"] & (readable | F.lit(r.language_agnostic)), False)
            out[r.name] = F.when(v["status"] == "blocked", True).otherwise(silent)
            sure = sure & ((v["status"] == "blocked") | v["certain"])
    return out, sure


def bounds(seen: dict[str, Column], open_: list[str], side: str, confidence: float | None) -> tuple[Column, Column]:
    """(least, most) bits of a row over all that rails not yet asked may say."""
    groups: dict[str, list[tuple]] = {}
    for rail, group, detection, yes, no in assess.weights(side, confidence):
        if rail in seen or rail in open_:
            groups.setdefault(group, []).append((rail, detection, yes, no))
    low, high = F.lit(0.0), F.lit(0.0)
    for g in groups.values():
        mine = [x[0] for x in g if x[0] in open_]
        ways = []
        for way in product((True, False, None), repeat=len(mine)):
            guess = seen | {r: F.lit(v).cast("boolean") for r, v in zip(mine, way, strict=True)}
            ways.append(F.coalesce(assess.group_bits(g, guess), F.lit(0.0)))
        low, high = low + (F.least(*ways) if len(ways) > 1 else ways[0]), high + (F.greatest(*ways) if len(ways) > 1 else ways[0])
    return low, high


def escalate(df: DataFrame, cheap: list[Rail], dear: list[Rail], prior: float, side: str = "context", text: str = "text", policy: tuple[float, float] = (0.5, 0.05), confidence: float | None = 0.95, context: dict[str, Column] | None = None) -> DataFrame:
    """df with risk: struct<bits, posterior, action, certain, looked>; looked is the number of rails that were run on the row.

    bits and posterior are those of the rails that looked. Dear rails run in a branch of their own over the
    undecided rows, so rails that are no built-in expressions are spared too.
    """
    ctx = {"side": F.lit(side), **(context or {})}
    cheap, dear = ([r for r in rails if side in r.sides] for rails in (cheap, dear))
    own, sure = said(F.col(text), cheap, ctx)
    one = df.withColumn("_said", F.struct(*[v.alias(k) for k, v in own.items()], sure.alias("_sure")))
    seen = {k: F.col("_said")[k] for k in own}
    low, high = bounds(seen, [r.name for r in dear], side, confidence)
    acts = [assess.action(assess.probability(b, prior), policy) for b in (low, high)]
    one = one.withColumn("_done", acts[0] == acts[1]) if dear else one.withColumn("_done", F.lit(True))

    def judged(rows: DataFrame, fired: dict[str, Column], certain: Column, looked: int) -> DataFrame:
        def of(b: Column) -> Column:
            p = assess.probability(b, prior)
            return F.struct(b.alias("bits"), p.alias("posterior"), assess.action(p, policy).alias("action"), certain.alias("certain"), F.lit(looked).alias("looked"))

        return rows.withColumn("risk", T.let(assess.row_bits(fired, side, confidence), of))

    closed = judged(one.where("_done"), seen, F.col("_said")["_sure"], len(cheap)).drop("_said", "_done")
    if not dear:
        return closed
    more, too = said(F.col(text), dear, ctx)
    rest = one.where("not _done").withColumn("_more", F.struct(*[v.alias(k) for k, v in more.items()], too.alias("_sure")))
    rest = judged(rest, seen | {k: F.col("_more")[k] for k in more}, F.col("_said")["_sure"] & F.col("_more")["_sure"], len(cheap) + len(dear)).drop("_said", "_done", "_more")
    return closed.unionByName(rest)
