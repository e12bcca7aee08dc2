"""Hierarchical multi-length packing of documents into token windows.

A document's ids, with one end id, are routed by length to the smallest tier that holds them; what
exceeds the longest tier is cut off in full windows first. Tiers are packed from the longest down:
a window starts with the longest piece of its tier, its gap is filled with the longest pieces of the
same and shorter tiers that fit, and the rest of the gap with a cut head of a shorter piece, whose
tail goes back to the tier of its length. What a partition has left at its end is cut into windows
of powers of two. So no window is padded, and each id lies in exactly one piece.

Windows of a size are dealt to step groups of exactly step_tokens tokens, serpentine by number of pieces;
those short of a group wait for the next flush, and at a partition's end windows of all sizes fill groups
together, so that only the last group of a partition may hold fewer.
Packing is local to a partition and streams: it keeps at most FLUSH tokens and needs no shuffle.

A null or empty text is its end id alone. Rows that repeat are packed again. A null doc_id stays
null. An empty table gives no windows. Extra columns are ignored.
"""

from __future__ import annotations

import zlib
from bisect import bisect_left, bisect_right, insort
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame

from . import bytehash as H
from .encoder import encoder, with_end
from .shared import small_batches

TIERS = (256, 512, 1024, 2048)
FLUSH = 1_500_000
#: Pieces are (length, key, start): sorted by length, ties by arrival.
Piece = tuple[int, int, int]


class Pools:
    """Pieces of each tier, sorted by length."""

    def __init__(self, tiers: tuple[int, ...]) -> None:
        self.tiers, self.of = tiers, {t: [] for t in tiers}

    def add(self, p: Piece) -> None:
        insort(self.of[next(t for t in self.tiers if p[0] <= t)], p)

    def fitting(self, gap: int, most: int) -> Piece | None:
        """Takes the longest piece of at most gap tokens from tiers up to most."""
        for t in reversed(self.tiers):
            if t <= most and (i := bisect_right(self.of[t], (gap, 1 << 62, 0))):
                return self.of[t].pop(i - 1)
        return None

    def head(self, gap: int, most: int) -> Piece | None:
        """Cuts gap tokens off the shortest longer piece from tiers up to most."""
        for t in self.tiers:
            if t <= most and (i := bisect_left(self.of[t], (gap + 1, -1, 0))) < len(self.of[t]):
                n, key, start = self.of[t].pop(i)
                self.add((n - gap, key, start + gap))
                return gap, key, start
        return None


def windows(pieces: list[Piece], tiers: tuple[int, ...], last: bool) -> tuple[list[tuple[int, list[Piece]]], list[Piece]]:
    """(full windows as (size, pieces), pieces that are left). With last, none are left."""
    out: list[tuple[int, list[Piece]]] = []
    pools = Pools(tiers)
    top = tiers[-1]
    for n, key, start in pieces:
        while n >= top:
            out.append((top, [(top, key, start)]))
            n, start = n - top, start + top
        if n:
            pools.add((n, key, start))
    left: list[Piece] = []
    for t in reversed(tiers):
        while pools.of[t]:
            p = pools.of[t].pop()
            window, gap = [p], t - p[0]
            while gap and (p := pools.fitting(gap, t) or pools.head(gap, t)):
                window.append(p)
                gap -= p[0]
            if not gap:
                out.append((t, window))
            elif not last:
                left += window
            else:
                size = t - gap
                for bit in [1 << k for k in range(size.bit_length() - 1, -1, -1) if size >> k & 1]:
                    part, need = [], bit
                    while need:
                        n, key, start = window.pop(0)
                        take = min(n, need)
                        part.append((take, key, start))
                        need -= take
                        if n > take:
                            window.insert(0, (n - take, key, start + take))
                    out.append((bit, part))
    return out, left


def step_groups(made: list[tuple[int, list[Piece]]], tokens: int, last: bool) -> tuple[list[int], int]:
    """(a step group for each window, -1 where it waits; number of groups): groups of exactly `tokens` tokens, of mixed piece counts.

    With last, no window waits and the last group may hold fewer tokens. Sizes are powers of two that divide `tokens`.
    """
    group, base, left = [-1] * len(made), 0, []
    for size in sorted({w[0] for w in made}, reverse=True):
        order = sorted((i for i, w in enumerate(made) if w[0] == size), key=lambda i: -len(made[i][1]))
        each = tokens // size
        n = len(order) // each
        for k, i in enumerate(order[len(order) - n * each :]):
            lap, at = divmod(k, n)
            group[i] = base + (at if lap % 2 == 0 else n - 1 - at)
        base += n
        left += order[: len(order) - n * each]
    if last:
        held = 0
        for i in left:  # largest first, so groups fill exactly
            group[i] = base + held // tokens
            held += made[i][0]
        base += -(-held // tokens)
    return group, base


def pack(docs: DataFrame, tokenizer: str = "word_bpe_49k.json", end_id: int = 1, spaced: bool = False, tiers: tuple[int, ...] = TIERS, step_tokens: int = 16384, with_ids: bool = True) -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset, window, step_group, ids.

    sequence_id holds the partition in its high bits; a task that runs again makes the same rows.
    ids is null unless with_ids.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, base = encoder(tokenizer, spaced), TaskContext.get().partitionId() << 36
        held: dict[int, tuple] = {}  # key: (doc_id, ids)
        waiting: list[Piece] = []
        waits: list[tuple[int, list[Piece]]] = []  # windows without a step group
        sequence = groups = tokens = key = 0

        def flush(last: bool) -> pa.RecordBatch:
            nonlocal waiting, waits, sequence, groups, tokens
            made, waiting = windows(waiting, tiers, last)
            made = waits + made
            rows: list[tuple] = []
            steps, n_groups = step_groups(made, step_tokens, last)
            waits = [w for w, g in zip(made, steps, strict=True) if g < 0]
            for (size, window), g in zip(made, steps, strict=True):
                if g < 0:
                    continue
                at = 0
                for n, k, start in window:
                    doc, ids = held[k]
                    part = ids[start : start + n]
                    rows.append((doc, start, n, zlib.crc32(part.tobytes()), len(ids), base + sequence, at, size, base + groups + g, part.view(np.int32) if with_ids else None))
                    at += n
                sequence += 1
            groups += n_groups
            keep = {k for _, k, _ in waiting} | {k for _, w in waits for _, k, _ in w}
            for k in [k for k in held if k not in keep]:
                del held[k]
            tokens = sum(n for n, _, _ in waiting)
            cols = list(zip(*rows, strict=True)) or [[]] * 10
            return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cols[:9]] + [pa.array(cols[9], pa.list_(pa.int32()))], NAMES)

        for b in H.slices(batches, "text"):
            ids, off = with_end(*enc.encode(b.column(1)), end_id)
            for i, doc in enumerate(b.column(0).to_pylist()):
                held[key] = doc, ids[off[i] : off[i + 1]].copy()
                waiting.append((int(off[i + 1] - off[i]), key, 0))
                key += 1
            tokens += len(ids)
            if tokens > FLUSH:
                yield flush(False)
        yield flush(True)

    small_batches(docs.sparkSession)
    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, window long, step_group long, ids array<int>")


NAMES = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "window", "step_group", "ids"]
