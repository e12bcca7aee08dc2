"""Benchmark decontamination over a distributed positional inverted index.

build_index() writes one row per shard (about 1 MB of texts): the shard's documents and, for every
test term, its postings as ascending word positions over the shard. A search never moves texts or
postings between executors: each shard is intersected where it lies. For a window of test words the
posting list of its rarest term (by counts over the whole corpus) gives candidate places; the lists
of the other terms, rarest first, are intersected after shifting by their offset in the window.
proximity() finds places where an item's rarest terms stand within a distance.

Test items come in blocks of at most BLOCK_CHARS characters: a block's terms are the only thing that
is sent to executors. With several blocks, each is searched against all shards and the hits of a
document are united by its row number.

Null or wordless texts have no words and no hits; null or wordless items have no windows. Repeated
document rows are searched each for itself; a null doc_id stays null. Extra columns are ignored.
Empty tables give no rows, or no hits.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import bytehash as H
from .shared import new_path, small_batches

BLOCK_CHARS = 4_000_000
CHUNK = 2_000_000


class Windows:
    """The windows of a block of items: term numbers (-1: none), lengths, items; terms are sorted hashes."""

    def __init__(self, items: list[tuple], width: int) -> None:
        data, off = H.text_bytes(pa.array([t for _, t in items], pa.string()))
        hashes, first = H.word_hashes(data, off, H.ALNUM)
        self.vocabulary, flat = np.unique(hashes, return_inverse=True)
        at: dict[tuple, int] = {}
        self.items: list[set] = []
        for (item, _), a, b in zip(items, first[:-1].tolist(), first[1:].tolist(), strict=True):
            for s in range(a, max(a + (b > a), b - width + 1)):
                w = tuple(flat[s : min(b, s + width)].tolist())
                if w not in at:
                    at[w] = len(self.items)
                    self.items.append(set())
                self.items[at[w]].add(item)
        self.size = np.array([len(w) for w in at], np.int64)
        self.terms = np.full((len(at), width), -1, np.int64)
        for i, w in enumerate(at):
            self.terms[i, : len(w)] = w

    def order(self, counts: np.ndarray) -> np.ndarray:
        """Offsets of each window by rarity of their terms; offsets beyond the window last."""
        c = np.where(self.terms >= 0, counts[self.terms], np.iinfo(np.int64).max)
        return np.argsort(c, axis=1, kind="stable")


def item_blocks(items: DataFrame, most: int) -> Iterator[list[tuple]]:
    """(id, text) lists of at most about `most` characters each, dealt by hash; one list if all fit."""
    items = items.select(F.col("item_id").cast("string").alias("i"), "text").where("text is not null")
    total = items.agg(F.sum(F.length("text") + 16)).head()[0] or 0
    n = -(-total // most)
    for k in range(n):
        yield [(r.i, r.text) for r in items.where(F.pmod(F.xxhash64("i", "text"), F.lit(n)) == k).collect()]


def build_index(docs: DataFrame, vocabulary: np.ndarray, path: str) -> None:
    """Writes the shards: row numbers, doc_ids, word counts, and postings of the vocabulary's terms."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        row = TaskContext.get().partitionId() << 36
        for b in H.slices(batches, "text"):
            w, first = H.word_hashes(*H.text_bytes(b.column(1)), H.ALNUM)
            t = np.minimum(np.searchsorted(vocabulary, w), max(0, len(vocabulary) - 1))
            pos = np.flatnonzero(vocabulary[t] == w) if len(vocabulary) else np.zeros(0, np.int64)
            order = np.argsort(t[pos], kind="stable")
            term, pos = t[pos][order], pos[order]
            own, size = np.unique(term, return_counts=True)
            rows = row + np.arange(b.num_rows)
            row += b.num_rows
            one = [rows, b.column(0), np.diff(first), own, size, pos]
            kinds = [pa.int64()] * 3 + [pa.int32()] * 3
            yield pa.RecordBatch.from_arrays([pa.ListArray.from_arrays(pa.array([0, len(x)], pa.int32()), x if isinstance(x, pa.Array) else pa.array(x.astype(k.to_pandas_dtype()))) for x, k in zip(one, kinds, strict=True)], SHARD)

    kind = "rows array<long>, doc_ids array<long>, n_words array<long>, terms array<int>, counts array<int>, positions array<int>"
    docs.select("doc_id", "text").mapInArrow(run, kind).write.parquet(path)


SHARD = ["rows", "doc_ids", "n_words", "terms", "counts", "positions"]


def term_counts(index: DataFrame, n: int) -> np.ndarray:
    """Occurrences of each of the n test terms in the corpus; n is bounded by the block."""
    c = index.select(F.explode(F.arrays_zip("terms", "counts")).alias("x")).groupBy("x.terms").agg(F.sum("x.counts").alias("n"))
    out = np.zeros(n, np.int64)
    for r in c.collect():
        out[r.terms] = r.n
    return out


def lists(row: dict, n_terms: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(first posting of each term and the total, positions, document of each position's word by first words)."""
    size = np.zeros(n_terms, np.int64)
    size[row["terms"]] = row["counts"]
    return np.concatenate([[0], np.cumsum(size)]), row["positions"].astype(np.int64), np.concatenate([[0], np.cumsum(row["n_words"])])


def intersect(w: Windows, order: np.ndarray, first: np.ndarray, pos: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(window, start) of all exact occurrences in a shard, within one document."""
    total = int(starts[-1]) + 1
    keys = np.repeat(np.arange(len(first) - 1), np.diff(first)) * total + pos  # sorted: by term, then position
    rare = w.terms[np.arange(len(order)), order[:, 0]]
    count = first[rare + 1] - first[rare]
    some = np.flatnonzero(count)
    found_w, found_s = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    bounds = np.searchsorted(np.cumsum(count[some]), np.arange(CHUNK, CHUNK + int(count.sum()) + 1, CHUNK))
    for some in np.split(some, np.unique(bounds)):
        c = count[some]
        win = np.repeat(some, c)
        s = pos[np.repeat(first[rare[some]] - (np.cumsum(c) - c), c) + np.arange(c.sum())] - order[win, 0]
        ok = (s >= 0) & (s + w.size[win] < total)
        win, s = win[ok], s[ok]
        ok = np.searchsorted(starts, s, "right") == np.searchsorted(starts, s + w.size[win] - 1, "right")
        win, s = win[ok], s[ok]
        for k in range(1, order.shape[1]):
            o = order[win, k]
            t = w.terms[win, o]
            want = t * total + s + o
            at = np.minimum(np.searchsorted(keys, want), len(keys) - 1)
            ok = (t < 0) | (keys[at] == want)
            win, s = win[ok], s[ok]
        found_w.append(win)
        found_s.append(s)
    return np.concatenate(found_w), np.concatenate(found_s)


def shards(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
    for b in batches:
        for i in range(b.num_rows):
            row = {n: b.column(k)[i].values for k, n in enumerate(SHARD)}
            yield {n: v if n == "doc_ids" else v.to_numpy() for n, v in row.items()}


def search(index: DataFrame, w: Windows, counts: np.ndarray) -> DataFrame:
    """(row, doc_id, n_words, n_hit, spans array<struct<s, e>>, items array<string>) of every document of the index.

    spans are the maximal runs of hit words.
    """
    order = w.order(counts)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row in shards(batches):
            first, pos, starts = lists(row, len(w.vocabulary))
            win, s = intersect(w, order, first, pos, starts) if len(order) and len(pos) else (np.zeros(0, np.int64),) * 2
            n = len(starts) - 1
            doc = np.searchsorted(starts, s, "right") - 1
            edge = np.zeros(int(starts[-1]) + 2, np.int64)
            np.add.at(edge, s, 1)
            np.add.at(edge, s + w.size[win], -1)
            hit = np.concatenate([[0], (np.cumsum(edge)[: int(starts[-1])] > 0).astype(np.int8)])
            n_hit = np.diff(np.cumsum(hit)[starts])
            items: list[set] = [set() for _ in range(n)]
            for d, x in np.unique(doc * len(w.items) + win).tolist() and zip(*np.divmod(np.unique(doc * len(w.items) + win), len(w.items)), strict=True):
                items[d] |= w.items[x]
            spans: list[list] = [[] for _ in range(n)]
            for d in np.flatnonzero(n_hit).tolist():
                own = np.diff(np.concatenate([[0], hit[starts[d] + 1 : starts[d + 1] + 1], [0]]))
                spans[d] = [{"s": a, "e": b} for a, b in zip(np.flatnonzero(own == 1).tolist(), np.flatnonzero(own == -1).tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays(
                [pa.array(row["rows"]), row["doc_ids"], pa.array(row["n_words"]), pa.array(n_hit, pa.int64()), pa.array(spans, pa.list_(pa.struct([("s", pa.int64()), ("e", pa.int64())]))), pa.array([sorted(x) for x in items], pa.list_(pa.string()))],
                ["row", "doc_id", "n_words", "n_hit", "spans", "items"],
            )

    return index.select(*SHARD).mapInArrow(run, HITS)


HITS = "row long, doc_id long, n_words long, n_hit long, spans array<struct<s:long,e:long>>, items array<string>"


def exact_matches(docs: DataFrame, items: DataFrame, width: int = 10, block: int = BLOCK_CHARS) -> DataFrame:
    """search() of all blocks of items (item_id, text) over docs, with the hits of each document united."""
    spark = docs.sparkSession
    small_batches(spark)
    found: list[DataFrame] = []
    for part in item_blocks(items, block) if docs.columns else ():
        w = Windows(part, width)
        path = new_path(spark, "index")
        build_index(docs, w.vocabulary, path)
        index = spark.read.parquet(path)
        found.append(search(index, w, term_counts(index, len(w.vocabulary))))
    if not found:
        w, path = Windows([], width), new_path(spark, "index")
        build_index(docs, w.vocabulary, path)
        return search(spark.read.parquet(path), w, np.zeros(0, np.int64))
    if len(found) == 1:
        return found[0]
    every = found[0]
    for f in found[1:]:
        every = every.unionByName(f)
    every = every.groupBy("row").agg(F.first("doc_id").alias("doc_id"), F.first("n_words").alias("n_words"), F.array_sort(F.flatten(F.collect_list("spans"))).alias("spans"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items"))
    none = F.struct(F.array().cast("array<struct<s:long,e:long>>").alias("out"), F.lit(0).cast("long").alias("s"), F.lit(0).cast("long").alias("e"))
    merged = F.aggregate(
        F.concat("spans", F.array(F.struct(F.lit(1 << 62).alias("s"), F.lit(1 << 62).alias("e")))),
        none,
        lambda a, x: F.when(x["s"] <= a["e"], F.struct(a["out"].alias("out"), a["s"].alias("s"), F.greatest(a["e"], x["e"]).alias("e"))).otherwise(
            F.struct(F.when(a["e"] > a["s"], F.concat(a["out"], F.array(F.struct(a["s"].alias("s"), a["e"].alias("e"))))).otherwise(a["out"]).alias("out"), x["s"].alias("s"), x["e"].alias("e"))
        ),
    )["out"]
    every = every.withColumn("spans", merged)
    n_hit = F.aggregate("spans", F.lit(0).cast("long"), lambda a, x: a + x["e"] - x["s"])
    return every.select("row", "doc_id", "n_words", n_hit.alias("n_hit"), "spans", "items")


def proximity(docs: DataFrame, items: DataFrame, rarest: int = 3, within: int = 20, block: int = BLOCK_CHARS) -> DataFrame:
    """(doc_id, item_id, word) places where an item's rarest terms (up to `rarest`) stand within `within` words.

    word is the place of the rarest term. Terms that the corpus lacks are passed over only if the item has no others.
    """
    spark, out = docs.sparkSession, None
    for part in item_blocks(items, block):
        w = Windows(part, 1)
        path = new_path(spark, "index")
        build_index(docs, w.vocabulary, path)
        index = spark.read.parquet(path)
        counts = term_counts(index, len(w.vocabulary))
        wanted: dict[str, set] = {}
        for k, who in zip(w.terms[:, 0].tolist(), w.items, strict=True):
            for i in who:
                wanted.setdefault(i, set()).add(k)
        asked = {i: sorted((k for k in t if counts[k]), key=lambda k: (counts[k], k))[:rarest] for i, t in wanted.items()}

        def run(batches: Iterator[pa.RecordBatch], asked=asked, n_terms=len(w.vocabulary)) -> Iterator[pa.RecordBatch]:
            for row in shards(batches):
                first, pos, starts = lists(row, n_terms)
                got: list[tuple] = []
                for item, terms in asked.items():
                    if not terms:
                        continue
                    at = pos[first[terms[0]] : first[terms[0] + 1]]
                    for t in terms[1:]:
                        own = pos[first[t] : first[t + 1]]
                        if not len(own) or not len(at):
                            at = at[:0]
                            break
                        doc = np.searchsorted(starts, at, "right") - 1
                        lo, hi = np.maximum(at - within, starts[doc]), np.minimum(at + within + 1, starts[doc + 1])
                        at = at[np.searchsorted(own, lo) < np.searchsorted(own, hi)]
                    doc = np.searchsorted(starts, at, "right") - 1
                    ids = row["doc_ids"].take(pa.array(doc)).to_pylist()
                    got += [(i, item, p) for i, p in zip(ids, (at - starts[doc]).tolist(), strict=True)]
                cols = list(zip(*got, strict=True)) or [[], [], []]
                yield pa.RecordBatch.from_arrays([pa.array(cols[0], pa.int64()), pa.array(cols[1], pa.string()), pa.array(cols[2], pa.int64())], ["doc_id", "item_id", "word"])

        hits = index.select(*SHARD).mapInArrow(run, "doc_id long, item_id string, word long")
        out = hits if out is None else out.unionByName(hits)
    return out if out is not None else spark.createDataFrame([], "doc_id long, item_id string, word long")


