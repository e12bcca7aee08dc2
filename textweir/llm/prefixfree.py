"""Removal of repeated passages over a corpus, by prefix-free parsing.

Every LENGTH-byte string that also starts earlier (at a smaller doc_id, or earlier in the same text)
is removed, byte for byte; see phrases.py for how texts are parsed. The corpus order of suffixes is only
needed to a depth of LENGTH bytes, so it is found in two steps, as a prefix-free parse is sorted by
its dictionary and its parse:

1. dictionary: phrases are grouped by trigger string and content. All but the first occurrence of a
   phrase are repeats as a whole. Where a trigger string begins only one distinct phrase, its windows
   occur nowhere else and are done.
2. parse: of the other distinct phrases, the first occurrences are compared window by window, within
   groups of equal trigger string and equal distance from it, ordered by (doc_id, place).

What moves between executors are packed blocks of fixed-size entries: 96 bits that identify a phrase, 80
that identify a window within its group, and places. Each task first merges equal entries of its own
rows, so that a phrase that fills a third of the corpus arrives once from each task. A trigger string with
many distinct phrases in one task is split by content, with one witness sent to its group, which keeps
all its phrases in step 2. Nothing is sampled or capped; texts move twice, and once more for each of the TURNS of step 2, compressed.

Null texts are empty. Texts shorter than LENGTH keep all bytes. Rows that repeat a doc_id are ordered
by text, then arrival, and each is returned; rows with a null doc_id come before all others. Extra columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import bytehash as H
from .phrases import LENGTH, parse
from .shared import partitions, written

HOT = 32
BLOCK = "part int, kind int, block binary"
PHRASE = np.dtype([("k", "<u4"), ("e", "<u8"), ("doc", "<i8"), ("row", "<u4"), ("at", "<u4"), ("n", "u1"), ("flag", "u1")])
PLACE = np.dtype([("doc", "<i8"), ("row", "<u4"), ("at", "<u4"), ("n", "<u2")])
#: A group of up to 16 windows of a phrase: k, distance of its first window from the trigger, place, windows, then their hashes.
RUN = np.dtype([("k", "<u4"), ("d", "u1"), ("doc", "<i8"), ("row", "<u4"), ("at", "<u4"), ("n", "u1")])
NULL = np.iinfo(np.int64).min
#: Step 2 runs in so many turns, each over a share of the trigger strings, as its windows are the most that lies on disk at once; equal ones have one
#: trigger string. Each turn reads all texts, so phrases to compare whose packed places take no more than FEW bytes have a single turn.
TURNS, TURN, FEW = 2, H.U(0x9E3779B97F4A7C15), 1 << 24


def pack(*arrays: np.ndarray) -> bytes:
    raw = [np.ascontiguousarray(a).tobytes() for a in arrays]
    return zstandard.compress(np.array([len(r) for r in raw], "<u4").tobytes() + b"".join(raw), 1)


def unpack(block: bytes, *kinds: np.dtype) -> list[np.ndarray]:
    raw = zstandard.decompress(block)
    at, out = 4 * len(kinds), []
    for n, k in zip(np.frombuffer(raw, "<u4", len(kinds)).tolist(), kinds, strict=True):
        out.append(np.frombuffer(raw, k, n // np.dtype(k).itemsize, at))
        at += n
    return out


def columns(a: np.ndarray) -> list[np.ndarray]:
    """A structured array by columns, which compress better."""
    return [a[f] for f in a.dtype.names]


def rebuilt(kind: np.dtype, block: bytes) -> np.ndarray:
    cols = unpack(block, *[kind[f] for f in kind.names])
    out = np.zeros(len(cols[0]), kind)
    for f, c in zip(kind.names, cols, strict=True):
        out[f] = c
    return out


def batch(rows: list[tuple]) -> pa.RecordBatch:
    cols = list(zip(*rows, strict=True)) or [[], [], []]
    return pa.RecordBatch.from_arrays([pa.array(cols[0], pa.int32()), pa.array(cols[1], pa.int32()), pa.array(cols[2], pa.binary())], ["part", "kind", "block"])


def split(a: np.ndarray, part: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """The entries of each part, in their order."""
    o = np.argsort(part, kind="stable")
    p, first = np.unique(part[o], return_index=True)
    for k, x in zip(p.tolist(), np.split(o, first[1:]), strict=True):
        yield k, a[x]


def part_of(doc: np.ndarray, n: int) -> np.ndarray:
    return (H.mix(doc.astype(np.int64).view(H.U)) % H.U(n)).astype(np.int64)


def by_part(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, list[tuple[int, bytes]]]]:
    """(part, its (kind, block) list) of rows sorted by part."""
    now, held = None, []
    for b in batches:
        for p, k, x in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True):
            if p != now:
                if held:
                    yield now, held
                now, held = p, []
            held.append((k, x))
    if held:
        yield now, held


def dealt(df: DataFrame, n: int) -> DataFrame:
    """Each part goes to the task of its number."""
    return df.repartitionById(n, F.col("part")).sortWithinPartitions("part", "kind")


def ids(col: pa.Array) -> np.ndarray:
    return col.fill_null(NULL).to_numpy()


def texts(docs: DataFrame, n: int) -> DataFrame:
    """Blocks of (doc_id, null mark, text) by part of doc_id: kind 0."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in H.slices(batches, "text", 1 << 23):
            data, off = H.text_bytes(b.column(1))
            doc = ids(b.column(0))
            out = []
            for p, rows in split(np.arange(b.num_rows), part_of(doc, n)):
                size = off[rows + 1] - off[rows]
                own = np.cumsum(size) - size
                out.append((p, 0, pack(doc[rows], size, data[np.repeat(off[rows] - own, size) + np.arange(size.sum())])))
            yield batch(out)

    return docs.select("doc_id", "text").mapInArrow(run, BLOCK)


def gathered(blocks: list[tuple[int, bytes]]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(doc_ids, bytes, offsets, rank of each among rows of the same doc_id) of a part's texts, by doc_id, then text."""
    rows: list[tuple[int, bytes]] = []
    for k, x in blocks:
        if k == 0:
            doc, size, data = unpack(x, np.dtype("<i8"), np.dtype("<i8"), np.dtype("u1"))
            raw, end = data.tobytes(), np.cumsum(size)
            rows += [(d, raw[a:b]) for d, a, b in zip(doc.tolist(), (end - size).tolist(), end.tolist(), strict=True)]
    rows.sort()
    doc = np.array([d for d, _ in rows], np.int64)
    off = np.concatenate([[0], np.cumsum([len(t) for _, t in rows])]).astype(np.int64)
    first = np.searchsorted(doc, doc)
    return doc, np.frombuffer(b"".join(t for _, t in rows), np.uint8), off, np.arange(len(doc)) - first


def local_rows(doc: np.ndarray, rank: np.ndarray, places: np.ndarray) -> np.ndarray:
    """Row of each place among a part's rows (sorted by doc, rank)."""
    return np.searchsorted(doc, places["doc"]) + places["row"]


def pieces(off: np.ndarray, most: int = 1 << 21) -> Iterator[tuple[int, int]]:
    at = 0
    while at < len(off) - 1:
        to = max(at + 1, int(np.searchsorted(off, off[at] + most, "right")) - 1)
        yield at, to
        at = to


def phrase_blocks(docs: DataFrame, n: int) -> DataFrame:
    """Phrases of all texts: kind 1 by trigger string; kind 2, surely repeated phrases, as places."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, blocks in by_part(batches):
            doc, data, off, rank = gathered(blocks)
            found = []
            for lo, hi in pieces(off):
                d, o = data[off[lo] : off[hi]], off[lo : hi + 1] - off[lo]
                p = H.prefix(d)
                row, s, w, a = parse(d, o, p)
                x = np.zeros(len(row), PHRASE)
                x["k"] = H.span(p, a, a + 32) >> H.U(32)
                x["e"] = H.span(p, s, s + w + LENGTH - 1)
                x["doc"], x["row"], x["at"], x["n"] = doc[lo:hi][row], rank[lo:hi][row], s - o[row], w
                found.append(x)
            x = np.concatenate(found) if found else np.zeros(0, PHRASE)
            o = np.argsort(x["e"], kind="stable")  # rows are in corpus order already
            same = np.concatenate([[False], (x["e"][o][1:] == x["e"][o][:-1]) & (x["k"][o][1:] == x["k"][o][:-1])]) if len(o) else np.zeros(0, dtype=bool)
            out = [(part, 2, pack(*columns(as_places(x[np.sort(o[same])]))))]
            x = x[np.sort(o[~same])]
            _, inv, count = np.unique(x["k"], return_inverse=True, return_counts=True)
            hot = count[inv] > HOT if len(x) else np.zeros(0, dtype=bool)
            x["flag"] = hot
            key = np.where(hot, H.mix(x["e"]), H.mix(x["k"].astype(H.U)))
            witness = np.zeros(0, PHRASE)
            if hot.any():
                witness = x[hot][np.unique(x["k"][hot], return_index=True)[1]].copy()
                witness["flag"] = 2
                witness["e"] = 0
            every = np.concatenate([x, witness])
            out += [(p, 1, pack(*columns(y))) for p, y in split(every, (np.concatenate([key, H.mix(witness["k"].astype(H.U))]) % H.U(n)).astype(np.int64))]
            yield batch(out)

    return dealt(texts(docs, n), n).mapInArrow(run, BLOCK)


def as_places(x: np.ndarray) -> np.ndarray:
    out = np.zeros(len(x), PLACE)
    for f in ("doc", "row", "at", "n"):
        out[f] = x[f]
    return out


def dictionary(blocks: DataFrame, n: int) -> DataFrame:
    """By part of doc_id: kind 2, repeated phrases; kind 3, first occurrences that step 2 compares."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, held in by_part(batches):
            out = [(part, k, x) for k, x in held if k == 2]  # these parts are by doc_id already
            found = [rebuilt(PHRASE, x) for k, x in held if k == 1]
            if found:
                x = np.concatenate(found)
                x = x[np.lexsort((x["at"], x["row"], x["doc"], x["e"], x["flag"] == 2, x["k"]))]
                new_k = np.concatenate([[True], x["k"][1:] != x["k"][:-1]])
                new_e = new_k | np.concatenate([[True], (x["e"][1:] != x["e"][:-1]) | ((x["flag"][1:] == 2) != (x["flag"][:-1] == 2))])
                distinct = np.bincount(np.cumsum(new_k) - 1, new_e)
                many = (distinct > 1)[np.cumsum(new_k) - 1]
                forced = np.zeros(int(new_e.sum()), dtype=bool)
                np.logical_or.at(forced, np.cumsum(new_e) - 1, x["flag"] == 1)
                forced = forced[np.cumsum(new_e) - 1]
                real = x["flag"] != 2
                for kind, y in ((2, x[~new_e & real]), (3, x[new_e & real & (many | forced)])):
                    y = as_places(y)
                    out += [(p, kind, pack(*columns(z))) for p, z in split(y, part_of(y["doc"], n))]
            yield batch(out)

    return dealt(blocks, n).mapInArrow(run, BLOCK)


def window_blocks(docs: DataFrame, kept: DataFrame, n: int, turn: int = 0, turns: int = 1) -> DataFrame:
    """Windows of the phrases that are compared: kind 4, by trigger string and distance; those of the trigger strings whose turn it is."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _part, blocks in by_part(batches):
            doc, data, off, rank = gathered(blocks)
            x = np.concatenate([np.zeros(0, PLACE), *[rebuilt(PLACE, b) for k, b in blocks if k == 3]])
            if not len(x):
                continue
            row = local_rows(doc, rank, x)
            x, row = x[np.argsort(row, kind="stable")], np.sort(row)
            out = []
            for lo, hi in pieces(off):
                i, j = np.searchsorted(row, [lo, hi])
                if i == j:
                    continue
                y, r = x[i:j], row[i:j] - lo
                o = off[lo : hi + 1] - off[lo]
                d = data[off[lo] : off[hi]]
                p = H.prefix(d)
                all_row, s, w, a = parse(d, o, p)
                at = o[r] + y["at"]
                q = np.searchsorted(s, at)  # phrases start at distinct places
                dist = a[q] - s[q]
                groups = -(-w[q] // 16)
                own = np.repeat(np.arange(len(q)), groups)
                g = np.arange(len(own)) - np.repeat(np.cumsum(groups) - groups, groups)
                z = np.zeros(len(own), RUN)
                # groups are cut at fixed distances from the trigger, so that equal windows meet
                z["k"] = (H.span(p, a[q], a[q] + 32) >> H.U(32))[own]
                top = dist[own]
                low = dist[own] - w[q][own] + 1
                first = top // 16 - g
                hi_d, lo_d = np.minimum(top, first * 16 + 15), np.maximum(low, first * 16)
                z["d"] = hi_d
                z["doc"], z["row"], z["at"], z["n"] = y["doc"][own], y["row"][own], y["at"][own] + (top - hi_d), np.maximum(0, hi_d - lo_d + 1)
                extra = (top // 16 - g > low // 16) & (g == groups[own] - 1)  # one group more where both ends are cut
                if extra.any():
                    e = z[extra].copy()
                    low2 = low[extra]
                    e_hi = first[extra] * 16 - 1
                    e["at"] = y["at"][own][extra] + (top[extra] - e_hi)
                    e["d"], e["n"] = e_hi, e_hi - low2 + 1
                    z, own = np.concatenate([z, e]), np.concatenate([own, own[extra]])
                ok = (z["n"] > 0) & (H.mix(z["k"].astype(H.U) ^ TURN) % H.U(turns) == H.U(turn))
                if not ok.any():
                    continue
                z, own = z[ok], own[ok]
                h = z["n"].astype(np.int64)
                start = np.repeat(o[r][own] + z["at"] - (np.cumsum(h) - h), h) + np.arange(h.sum())
                hashes = H.span(p, start, start + LENGTH)
                bucket = (H.mix(z["k"].astype(H.U) * H.U(8) + (z["d"] // 16).astype(H.U)) % H.U(n)).astype(np.int64)
                first_h = np.cumsum(h) - h
                for b, rows in split(np.arange(len(z)), bucket):
                    hh = h[rows]
                    take = np.repeat(first_h[rows] - (np.cumsum(hh) - hh), hh) + np.arange(hh.sum())
                    low6 = hashes[take].view(np.uint8).reshape(-1, 8)[:, :6]
                    out.append((b, 4, pack(*columns(z[rows]), low6)))
            yield batch(out)

    both = texts(docs, n).unionByName(kept.where("kind = 3"))
    return dealt(both, n).mapInArrow(run, BLOCK)


def compared(blocks: DataFrame, n: int) -> DataFrame:
    """Repeated windows of step 2, as runs of places by part of doc_id: kind 2."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _part, held in by_part(batches):
            runs, codes = [], []
            for _, x in held:
                *cols, low6 = unpack(x, *[RUN[f] for f in RUN.names], np.dtype("u1"))
                r = np.zeros(len(cols[0]), RUN)
                for f, c in zip(RUN.names, cols, strict=True):
                    r[f] = c
                runs.append(r)
                wide = np.zeros((len(low6) // 6, 8), np.uint8)
                wide[:, :6] = low6.reshape(-1, 6)
                codes.append(wide.view(H.U).ravel())
            r, code = np.concatenate(runs), np.concatenate(codes)
            h = r["n"].astype(np.int64)
            own = np.repeat(np.arange(len(r)), h)
            step = np.arange(len(own)) - np.repeat(np.cumsum(h) - h, h)
            key = r["k"][own].astype(H.U) << H.U(8) | (r["d"][own] - step).astype(H.U)
            at = r["at"][own] + step
            o = np.lexsort((at, r["row"][own], r["doc"][own], code, key))
            again = np.concatenate([[False], (key[o][1:] == key[o][:-1]) & (code[o][1:] == code[o][:-1])])
            hit = np.sort(o[again])
            if not len(hit):
                continue
            new = np.concatenate([[True], (hit[1:] != hit[:-1] + 1) | (own[hit][1:] != own[hit][:-1])])
            f = np.flatnonzero(new)
            y = np.zeros(len(f), PLACE)
            y["doc"], y["row"], y["at"], y["n"] = r["doc"][own[hit[f]]], r["row"][own[hit[f]]], at[hit[f]], np.diff(np.append(f, len(hit)))
            yield batch([(p, 2, pack(*columns(z))) for p, z in split(y, part_of(y["doc"], n))])

    return dealt(blocks, n).mapInArrow(run, BLOCK)


def covered(n: int, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Which of n bytes lie in any of the spans."""
    edge = np.zeros(n + 1, np.int32)
    np.add.at(edge, start, 1)
    np.add.at(edge, end, -1)
    return np.cumsum(edge[:n]) > 0


def final(docs: DataFrame, repeats: DataFrame, n: int, with_text: bool) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _part, blocks in by_part(batches):
            doc, data, off, rank = gathered(blocks)
            x = np.concatenate([np.zeros(0, PLACE), *[rebuilt(PLACE, b) for k, b in blocks if k == 2]])
            row = local_rows(doc, rank, x)
            x, row = x[np.argsort(row, kind="stable")], np.sort(row)
            for lo, hi in pieces(off):
                i, j = np.searchsorted(row, [lo, hi])
                o = off[lo : hi + 1] - off[lo]
                s = o[row[i:j] - lo] + x["at"][i:j]
                gone = covered(int(o[-1]), s, s + x["n"][i:j] + LENGTH - 1)
                d = data[off[lo] : off[hi]]
                out = []
                for k, a, b in zip(doc[lo:hi].tolist(), o[:-1].tolist(), o[1:].tolist(), strict=True):
                    g = gone[a:b]
                    left = d[a:b][~g].tobytes()
                    spans = int(g[0]) + int((g[1:] & ~g[:-1]).sum()) if b > a else 0
                    out.append((None if k == NULL else k, b - a, int(g.sum()), spans, hashlib.sha256(left).hexdigest(), left if with_text else None))
                cols = list(zip(*out, strict=True))
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (*[pa.int64()] * 4, pa.string(), pa.binary()), strict=True)], ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept"])

    both = texts(docs, n).unionByName(repeats)
    return dealt(both, n).mapInArrow(run, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept binary")


def remove_repeats(docs: DataFrame, with_text: bool = True) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256, kept (the remaining bytes, null unless with_text) of every row."""
    n = partitions(docs.sparkSession)
    first = written(dictionary(phrase_blocks(docs, n), n), "phrases")
    repeats = first.where("kind = 2")
    turns = TURNS if (first.where("kind = 3").agg(F.sum(F.length("block"))).head()[0] or 0) > FEW else 1
    for turn in range(turns):
        repeats = repeats.unionByName(written(compared(window_blocks(docs, first, n, turn, turns), n), "windows"))
    return final(docs, repeats, n, with_text)
