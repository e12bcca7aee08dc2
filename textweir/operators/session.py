"""Folds over the turns of a session, in order."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions import values as V
from .assess import action, probability


def log_odds(df: DataFrame, key: str, order: str, bits: Column, decay: float = 0.6) -> DataFrame:
    """(key, turns, excess): excess over the prior's log-odds, decayed at every turn."""
    return tracks(df, key, order, bits, F.lit("attack"), 0.5, decay).select(key, F.col("attack_turns").alias("turns"), F.col("attack_bits").alias("excess"))


def cusum(df: DataFrame, key: str, order: str, bits: Column, decay: float = 0.6) -> DataFrame:
    """(key, turns, cusum): what has gathered toward attack, decayed and never below 0."""
    return tracks(df, key, order, bits, F.lit("attack"), 0.5, decay).select(key, F.col("attack_turns").alias("turns"), F.col("attack_cusum").alias("cusum"))


SEGMENT = 512


def tracks(turns: DataFrame, key: str, order: str, bits: Column, channel: Column, prior: float, decay: float = 0.6, alpha: float = 0.01, beta: float = 0.05, policy: tuple[float, float] = (0.5, 0.05)) -> DataFrame:
    """One row a session with its two tracks, attack and contamination, which decay and gather by themselves and never add.

    For each track: turns, bits over the prior, cusum, posterior. channel is that of the first turn; quarantined
    counts turns of the other. With both tracks populated a session is ambiguous: it then has no posterior,
    action, verdict or shift of its own, but blocks where one of its tracks does. Null bits say nothing but are a turn.

    A track is folded by segments of turns. A decayed sum is x -> a x + b, a one-sided one c -> max(m, a c + b), and
    both compose, so a session of any length stays in bounded rows.
    """
    t = turns.select(F.col(key).alias("key"), F.col(order).alias("o"), F.coalesce(bits, F.lit(0.0)).cast("double").alias("x"), channel.alias("channel"))
    first = t.groupBy("key").agg(F.min_by("channel", F.struct("o", "channel")).alias("channel"))
    w = Window.partitionBy("key", "channel").orderBy("o", "x")
    parts = t.withColumn("seg", F.floor((F.row_number().over(w) - 1) / SEGMENT)).groupBy("key", "channel", "seg").agg(F.transform(F.array_sort(F.collect_list(F.struct("o", "x"))), lambda s: s["x"]).alias("xs"))
    zero = F.struct(F.lit(0.0).alias("b"), F.lit(0.0).alias("m"), F.lit(1.0).alias("a"))
    step = F.aggregate("xs", zero, lambda s, x: F.struct((s["b"] * decay + x).alias("b"), F.greatest(F.lit(0.0), s["m"] * decay + x).alias("m"), (s["a"] * decay).alias("a")))
    parts = parts.select("key", "channel", "seg", F.size("xs").alias("n"), step.alias("f"))
    every = parts.groupBy("key", "channel").agg(F.sum("n").alias("turns"), F.transform(F.array_sort(F.collect_list(F.struct("seg", "f"))), lambda s: s["f"]).alias("fs"))
    start = F.struct(F.lit(0.0).alias("bits"), F.lit(0.0).alias("cusum"))
    last = F.aggregate("fs", start, lambda s, f: F.struct((s["bits"] * f["a"] + f["b"]).alias("bits"), F.greatest(f["m"], s["cusum"] * f["a"] + f["b"]).alias("cusum")))
    each = every.select("key", "channel", "turns", last.alias("s")).groupBy("key").agg(*[F.max(F.when(F.col("channel") == c, F.struct("turns", F.col("s.bits").alias("bits"), F.col("s.cusum").alias("cusum")))).alias(c) for c in CHANNELS])
    j = each.join(first, "key")

    def of(c: str, k: str) -> Column:
        return F.coalesce(F.col(c)[k], F.lit(0).cast("long") if k == "turns" else F.lit(0.0))

    out = {f"{c}_{k}": of(c, k) for c in CHANNELS for k in ("turns", "bits", "cusum")} | {f"{c}_posterior": probability(of(c, "bits"), prior) for c in CHANNELS}
    j = j.select(F.col("key").alias(key), "channel", *[v.alias(k) for k, v in out.items()])
    both = (F.col("attack_turns") > 0) & (F.col("contamination_turns") > 0)
    mine = {k: F.when(F.col("attack_turns") > 0, F.col(f"attack_{k}")).otherwise(F.col(f"contamination_{k}")) for k in ("bits", "cusum", "posterior")}
    bar = math.log2((1 - beta) / alpha)
    blocks = F.greatest(*[F.when(F.col(f"{c}_turns") > 0, action(F.col(f"{c}_posterior"), policy) == "block").otherwise(False) for c in CHANNELS])
    single = {"posterior": mine["posterior"], "action": action(mine["posterior"], policy), "verdict": sprt(mine["bits"], alpha, beta), "shift": mine["cusum"] >= bar}
    return j.select("*", both.alias("ambiguous"), F.when(F.col("channel") == "contamination", F.col("attack_turns")).otherwise(F.col("contamination_turns")).alias("quarantined"), blocks.alias("blocks"), *[F.when(~both, v).alias(k) for k, v in single.items()])


CHANNELS = ("attack", "contamination")


def sprt(score: Column, alpha: float = 0.01, beta: float = 0.05) -> Column:
    """attack, benign or undecided by Wald's bounds."""
    return F.when(score >= math.log2((1 - beta) / alpha), "attack").when(score <= math.log2(beta / (1 - alpha)), "benign").otherwise("undecided")


def content_words(text: Column) -> Column:
    return F.filter(T.words(text), lambda w: ~w.isin(*V.STOP_WORDS))


def escalation(turns: DataFrame, window: int = 6, tolerance: int = 2, overlap: float = 0.6) -> DataFrame:
    """turns (conv_id, turn, role, text, blocked) with a shape: repeated_refusals, paraphrase, reframed, reference_back or null.

    categories holds the shape, after retry_after_refusal where it is a retry. A turn without a conv_id has no history to be compared
    with: it has no shape, and certain is false.
    The history of a turn is what stands before it in its conversation; refused are blocked user turns.
    """
    w = Window.partitionBy("conv_id").orderBy("turn")
    refused = (F.coalesce(F.col("role"), F.lit("user")) == "user") & F.col("blocked")
    t = turns.withColumn("_recent", F.sum(F.when(refused, 1).otherwise(0)).over(w.rowsBetween(-window, -1)))
    t = t.withColumn("_last", F.last(F.when(refused, F.col("text")), ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, -1)))
    t = t.withColumn("_now", F.when(F.col("_last").isNotNull(), content_words(F.col("text")))).withColumn("_then", content_words(F.col("_last")))
    # the share is of the words as they stand, repeats and all; what is common counts once
    common = F.size(F.array_intersect("_now", "_then"))
    same = (F.size("_now") >= 3) & (F.size("_then") > 0) & (common / F.size("_now") >= overlap)
    shape = F.when(F.col("_recent") > tolerance, "repeated_refusals").when(F.col("_last").isNull(), None).when(same, "paraphrase")
    shape = shape.when(F.col("text").rlike(V.REFRAMING) & (common > 0), "reframed").when(F.col("text").rlike(V.REFERENCE_BACK), "reference_back")
    t = t.withColumn("certain", F.col("conv_id").isNotNull()).withColumn("shape", F.when(F.col("certain"), shape))
    none = F.array().cast("array<string>")
    retry = F.when(F.col("shape") == "repeated_refusals", none).otherwise(F.array(F.lit("retry_after_refusal")))
    return t.withColumn("categories", F.when(F.col("shape").isNull(), none).otherwise(F.concat(retry, F.array("shape")))).drop("_recent", "_last", "_now", "_then")


def history(turns: DataFrame, n: int = 12) -> DataFrame:
    """turns with the array of the n turns before each."""
    w = Window.partitionBy("conv_id").orderBy("turn").rowsBetween(-n, -1)
    return turns.withColumn("history", F.collect_list(F.struct("turn", "role", "text")).over(w))
