"""Quality of documents by a byte-level convolutional network in numpy.

Bytes are described by character class and a fixed random code. Learned filters of WIDTH bytes run at
every STRIDE bytes over the whole text; activations are max-pooled over chunks of 2 * HALF bytes
that overlap by half. The mean, largest and smallest of each filter over a text's chunks go through
one hidden layer to one probability. Filters and layers are trained together by back-propagation over
whole texts, PIECE halves at a time, so that memory stays small.

A null or empty text is one chunk of padding and gets a probability like any other. Repeated rows
get equal scores; a null doc_id stays null and is not held out. Extra columns are ignored. Without
any labelled rows all scores are 0.5.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import bytehash as H
from .labelled import Adam, held_out, sample, sigmoid
from .shared import small_batches

WIDTH, STRIDE, HALF, FILTERS, HIDDEN, DIMS = 8, 4, 256, 32, 16, 10
STEPS, EPOCHS, BATCH, PIECE = 400, 8, 32, 1024
Model = dict[str, np.ndarray]


def byte_codes() -> np.ndarray:
    """(256, DIMS): padding is zero; classes, then a random code."""
    b = np.arange(256)
    cls = [(b >= 65) & (b <= 90), (b >= 97) & (b <= 122), (b >= 48) & (b <= 57), np.isin(b, [9, 10, 13, 32]), (b > 32) & (b < 127) & ~np.isin(b, [*range(48, 58), *range(65, 91), *range(97, 123)]), b >= 128]
    out = np.zeros((256, DIMS), np.float32)
    out[:, : len(cls)] = np.stack(cls, axis=1)
    out[:, len(cls) :] = (H.stream(31, 256 * (DIMS - len(cls))).astype(np.float64) / 2**64 - 0.5).reshape(256, -1)
    out[0] = 0
    return out


CODES = byte_codes()


def padded(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(texts one after another, each filled with zeros to whole halves and at least two; first half of each and the total)."""
    halves = np.maximum(2, -(-np.diff(off) // HALF))
    first = np.concatenate([[0], np.cumsum(halves)])
    out = np.zeros(int(first[-1]) * HALF, np.uint8)
    out[np.repeat(first[:-1] * HALF - off[:-1], np.diff(off)) + np.arange(len(data))] = data
    return out, first


def activations(x: np.ndarray, m: Model) -> np.ndarray:
    """(halves, positions, filters) before the rectifier: patches at multiples of WIDTH, then those shifted by STRIDE."""
    e = CODES[x]
    n = len(x) // HALF
    a = (e.reshape(-1, WIDTH * DIMS) @ m["w"]).reshape(n, -1, FILTERS)
    cut = STRIDE * DIMS
    flat = e.reshape(n, HALF * DIMS)[:, cut : cut - WIDTH * DIMS]
    b = (np.ascontiguousarray(flat).reshape(-1, WIDTH * DIMS) @ m["w"]).reshape(n, -1, FILTERS)
    return np.concatenate([a, b], axis=1)


def pooled(x: np.ndarray, m: Model) -> np.ndarray:
    """(halves, FILTERS) largest activations, rectified."""
    return np.maximum(activations(x, m).max(axis=1) + m["b"], 0)


def features(half: np.ndarray, first: np.ndarray) -> np.ndarray:
    """(texts, 3 * FILTERS): mean, largest and smallest over the chunks of each text."""
    chunk = np.maximum(half[:-1], half[1:])
    cut = np.stack([first[:-1], first[1:] - 1], axis=1).ravel()
    cut = cut[:-1] if cut[-1] >= len(chunk) else cut  # chunks that span two texts fall between the cuts
    n = (np.diff(first) - 1)[:, None]
    return np.concatenate([np.add.reduceat(chunk, cut)[::2] / n, np.maximum.reduceat(chunk, cut)[::2], np.minimum.reduceat(chunk, cut)[::2]], axis=1)


def logits(f: np.ndarray, m: Model) -> np.ndarray:
    return np.tanh(f @ m["h"] + m["hb"]) @ m["o"] + m["ob"]


def scores(col: pa.Array, m: Model) -> np.ndarray:
    """Probabilities of a column of whole texts; very long texts are pooled piece by piece."""
    x, first = padded(*H.text_bytes(col))
    step = PIECE * HALF
    half = np.concatenate([pooled(x[i : i + step], m) for i in range(0, len(x), step)])
    return sigmoid(logits(features(half, first), m).astype(np.float64))


def train(texts: pa.Array, y: np.ndarray, w: np.ndarray, seed: int = 7) -> Model:
    """A model from whole texts, labels 0/1 and weights."""
    r = np.random.default_rng(seed)
    m: Model = {
        "w": r.normal(0, 0.25, (WIDTH * DIMS, FILTERS)).astype(np.float32),
        "b": np.zeros(FILTERS, np.float32),
        "h": r.normal(0, (3 * FILTERS) ** -0.5, (3 * FILTERS, HIDDEN)).astype(np.float32),
        "hb": np.zeros(HIDDEN, np.float32),
        "o": r.normal(0, 0.25, HIDDEN).astype(np.float32),
        "ob": np.zeros(1, np.float32),
    }
    if not len(y):
        return m | {"o": m["o"] * 0}
    data, off = H.text_bytes(texts)
    adam = Adam(m, 0.004)
    epochs = max(EPOCHS, -(-STEPS * BATCH // len(y)))
    for epoch in range(epochs):
        adam.rate = 0.004 * (1 - epoch / epochs) + 0.0005
        order = r.permutation(len(y))
        for at in range(0, len(order), BATCH):
            rows = order[at : at + BATCH]
            size = off[rows + 1] - off[rows]
            own = np.concatenate([[0], np.cumsum(size)])
            part = data[np.repeat(off[rows] - own[:-1], size) + np.arange(own[-1])]
            adam.step(gradients(*padded(part, own), y[rows], w[rows], m))
    return m


def gradients(x: np.ndarray, first: np.ndarray, y: np.ndarray, w: np.ndarray, m: Model) -> Model:
    best, top = [], []
    for i in range(0, len(x), PIECE * HALF):
        act = activations(x[i : i + PIECE * HALF], m)
        best.append(act.argmax(axis=1))  # (halves, filters)
        top.append(np.take_along_axis(act, best[-1][:, None], 1)[:, 0] + m["b"])
    best, top = np.concatenate(best), np.concatenate(top)
    half = np.maximum(top, 0)
    f = features(half, first)
    t = np.tanh(f @ m["h"] + m["hb"])
    d = ((sigmoid(t @ m["o"] + m["ob"]) - y) * w / len(y)).astype(np.float32)
    g = {"o": t.T @ d, "ob": d.sum(keepdims=True)}
    dt = d[:, None] * m["o"] * (1 - t * t)
    g |= {"h": f.T @ dt + 1e-4 * m["h"], "hb": dt.sum(0)}
    df = (dt @ m["h"].T).reshape(len(y), 3, FILTERS)
    dh = np.zeros_like(half)
    cols = np.arange(FILTERS)
    for i, (a, b) in enumerate(zip(first[:-1].tolist(), (first[1:] - 1).tolist(), strict=True)):
        left, right = half[a:b], half[a + 1 : b + 1]
        c = np.maximum(left, right)
        dc = np.repeat(df[i, :1] / (b - a), b - a, axis=0)
        dc[c.argmax(0), cols] += df[i, 1]
        dc[c.argmin(0), cols] += df[i, 2]
        dh[a:b] += dc * (left >= right)
        dh[a + 1 : b + 1] += dc * (left < right)
    dh *= top > 0
    n = HALF // WIDTH
    place = np.where(best < n, best * WIDTH, (best - n) * WIDTH + STRIDE) + np.arange(len(half))[:, None] * HALF
    dw = np.zeros_like(m["w"])
    for i in range(0, len(half), PIECE):
        patch = CODES[x[place[i : i + PIECE, :, None] + np.arange(WIDTH)]].reshape(-1, FILTERS, WIDTH * DIMS)
        dw += np.einsum("hf,hfp->pf", dh[i : i + PIECE], patch, optimize=True)
    return g | {"w": dw, "b": dh.sum(0)}


def score(docs: DataFrame, m: Model) -> DataFrame:
    """(doc_id, score) of every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in H.slices(batches, "text"):
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(scores(b.column(1), m))], ["doc_id", "score"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, score double")


def accepted(docs: DataFrame, m: Model, threshold: float = 0.3) -> DataFrame:
    """The rows, with all their columns, whose texts score at least the threshold; one pass, no shuffle."""
    place = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                text = pa.RecordBatch.from_arrays([b.column(place)], ["text"])
                yield b.filter(pa.array(np.concatenate([scores(x.column(0), m) for x in H.slices(iter([text]), "text")]) >= threshold))

    small_batches(docs.sparkSession)
    return docs.mapInArrow(run, docs.schema)


def classify(docs: DataFrame, labels: DataFrame, threshold: float = 0.3) -> DataFrame:
    """doc_id, held_out, score, predicted of every row, by a model trained on the labelled rows that are not held out."""
    out = score(docs, train(*sample(docs, labels, "quality")))
    return out.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))
