"""Keyed state over streams: the online session fold, guards of growing answers, and conversations with their last turns."""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..functions import splice
from ..operators.session import sprt
from ..plans.engine import Engine


def session_fold(turns: DataFrame, decay: float = 0.6, idle_ms: int = 3_600_000) -> DataFrame:
    """turns (session_id string, turn long, bits double) to (session_id, turn, excess, cusum, verdict) after each turn.

    State is two doubles a session and is dropped after idle_ms without turns. Turns of one trigger are taken in order.
    """

    def fold(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        excess, cusum = state.get if state.exists else (0.0, 0.0)
        rows = []
        for _, r in pd.concat(list(frames)).sort_values("turn").iterrows():
            excess, cusum = excess * decay + r.bits, max(0.0, cusum * decay + r.bits)
            rows.append((key[0], int(r.turn), excess, cusum))
        state.update((excess, cusum))
        state.setTimeoutDuration(idle_ms)
        yield pd.DataFrame(rows, columns=["session_id", "turn", "excess", "cusum"])

    out = turns.groupBy("session_id").applyInPandasWithState(fold, "session_id string, turn long, excess double, cusum double", "excess double, cusum double", "append", GroupStateTimeout.ProcessingTimeTimeout)
    return out.withColumn("verdict", sprt(F.col("cusum")))


def stream_guard(chunks: DataFrame, check, every: int = 40, idle_ms: int = 3_600_000) -> DataFrame:
    """chunks (stream_id, seq, chunk, final) to (stream_id, seq, replace_from, text, status).

    check(text) gives (status, text) with status passed, modified or blocked, in plain Python. The whole buffer is
    checked again after every `every` new characters and at the end; only checked text is released, and a block
    sticks. Where a rewrite changes text that is out already, the row says from where to replace it.
    """

    def guard(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        raw, checked, released, status = state.get if state.exists else ("", 0, "", "passed")
        rows = []
        for _, r in pd.concat(list(frames)).sort_values("seq").iterrows():
            if status == "blocked":
                continue
            raw += r.chunk or ""
            if len(raw) - checked >= every or r.final:
                status, clean = check(raw)
                checked = len(raw)
                if status == "blocked":
                    rows.append((key[0], int(r.seq), len(released), "", status))
                    continue
                keep = 0
                while keep < min(len(released), len(clean)) and released[keep] == clean[keep]:
                    keep += 1
                rows.append((key[0], int(r.seq), keep, clean[keep:], status))
                released = clean
        state.update((raw, checked, released, status))
        state.setTimeoutDuration(idle_ms)
        yield pd.DataFrame(rows, columns=["stream_id", "seq", "replace_from", "text", "status"])

    return chunks.groupBy("stream_id").applyInPandasWithState(
        guard, "stream_id string, seq long, replace_from long, text string, status string", "raw string, checked int, released string, status string", "append", GroupStateTimeout.ProcessingTimeTimeout
    )


def due_checks(chunks: DataFrame, every: int = 40, idle_ms: int = 3_600_000) -> DataFrame:
    """chunks (stream_id, seq, chunk, final) to (stream_id, seq, before, now, final): the answer so far where a check is due, and as it was at the check before.

    A check is due after `every` new characters and at the end. State is the answer and how much of it was checked; it goes with the end
    of the answer, or after idle_ms without chunks.
    """

    def grow(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        raw, checked = state.get if state.exists else ("", 0)
        rows, over = [], False
        for r in pd.concat(list(frames)).sort_values("seq").itertuples():
            raw += r.chunk or ""
            over = over or bool(r.final)
            if len(raw) - checked >= every or r.final:
                rows.append((key[0], int(r.seq), raw[:checked], raw, bool(r.final)))
                checked = len(raw)
        if over:
            state.remove()
        else:
            state.update((raw, checked))
            state.setTimeoutDuration(idle_ms)
        yield pd.DataFrame(rows, columns=["stream_id", "seq", "before", "now", "final"])

    out = "stream_id string, seq long, before string, now string, final boolean"
    return chunks.groupBy("stream_id").applyInPandasWithState(grow, out, "raw string, checked int", "append", GroupStateTimeout.ProcessingTimeTimeout)


def guarded(chunks: DataFrame, engine: Engine, side: str = "output", every: int = 40, idle_ms: int = 3_600_000) -> DataFrame:
    """chunks (stream_id, seq, chunk, final) to (stream_id, seq, replace_from, text, status, categories, certain, rewritten_by, final).

    While an answer arrives, the engine's offline and incremental rails read all of it at each check, and at its end all rails do. Only text
    that was read is given out: text goes on from replace_from, which lies before what is out already where a
    rewrite changed that. A block ends the answer: nothing follows it. Rails are a projection over the answer as it is and as it
    was at the check before, so the only state is the answer itself.
    """
    early = Engine([r for r in engine.rails if r.offline and r.incremental])
    due = due_checks(chunks, every, idle_ms)
    seen = early.run(early.run(due, "before", side, into="v0"), "now", side, into="v1")
    last = engine.run(seen, "now", side, into="v2")
    v = F.when(F.col("final"), F.col("v2")).otherwise(F.col("v1"))
    s = last.where("v0.status <> 'blocked'").withColumn("v", v).withColumn("at", splice.common(F.col("v0.content"), F.col("v.content")))
    blocked = F.col("v.status") == "blocked"
    names = F.array_union("v0.rewritten_by", "v.rewritten_by")
    return s.select(
        "stream_id", "seq", F.when(blocked, F.length("v0.content")).otherwise(F.col("at")).alias("replace_from"),
        F.when(blocked, "").otherwise(F.expr("substring(v.content, at + 1)")).alias("text"), "v.status", "v.categories", "v.certain", names.alias("rewritten_by"), "final",
    )


def with_history(turns: DataFrame, most: int = 12, idle_ms: int = 3_600_000) -> DataFrame:
    """turns (conv_id string, turn long, role, text) with history: the `most` turns before each, in order; it is all that state holds."""

    def remember(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        held = json.loads(state.get[0]) if state.exists else []
        rows = []
        for r in pd.concat(list(frames)).sort_values("turn").itertuples():
            rows.append((key[0], int(r.turn), r.role, r.text, json.dumps(held)))
            held = [*held, {"turn": int(r.turn), "role": r.role, "text": r.text}][-most:]
        state.update((json.dumps(held),))
        state.setTimeoutDuration(idle_ms)
        yield pd.DataFrame(rows, columns=["conv_id", "turn", "role", "text", "h"])

    out = turns.groupBy("conv_id").applyInPandasWithState(remember, "conv_id string, turn long, role string, text string, h string", "held string", "append", GroupStateTimeout.ProcessingTimeTimeout)
    return out.select("conv_id", "turn", "role", "text", F.from_json("h", "array<struct<turn:long,role:string,text:string>>").alias("history"))
