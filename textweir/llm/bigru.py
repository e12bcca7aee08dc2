"""Toxicity of documents by a bidirectional gated recurrent network with attention pooling, in numpy.

A word's inputs are a word input, the learned weight of the whole word, and character inputs, the
largest, mean and smallest learned weight of its character n-grams (marked where they begin the
word), besides two flags. Weights are smoothed log-odds of the labelled documents, hashed to tables of fixed size. The
network reads windows of WINDOW words that overlap by half, both ways; attention pools its states to
one logit a window, and a text's score is that of its highest window. The network is trained by
back-propagation through time on the highest windows of labelled texts, chosen anew between epochs.

A null or wordless text is scored as one empty window. Repeated rows get equal scores; a null doc_id
stays null and is not held out. Extra columns are ignored. Without labelled rows all scores are low.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import bytehash as H
from .labelled import Adam, held_out, sample, sigmoid

WINDOW, HOP, STATE, INPUTS = 32, 16, 8, 6
TABLE, GRAMS = 1 << 18, (3, 4, 5)
STEPS, EPOCHS, BATCH = 240, 6, 128
Model = dict[str, np.ndarray]


class Words:
    """The distinct words of some texts with their n-gram buckets."""

    def __init__(self, data: np.ndarray, off: np.ndarray) -> None:
        folded, s, e, self.first = H.words(data, off, H.ALNUM)
        p = H.prefix(folded)
        self.hash, idx, self.inverse = np.unique(H.span(p, s, e), return_index=True, return_inverse=True)
        s, e = s[idx], e[idx]
        self.p, self.s, self.e = p, s, e

    def grams(self, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(buckets, first bucket of each of the rows and the total); a word has one at least."""
        s, e = self.s[rows], self.e[rows]
        every, owner = [], []
        for n in GRAMS:
            count = np.maximum(e - s - n + 1, 0) if n > GRAMS[0] else np.maximum(e - s - n + 1, 1)
            own = np.repeat(np.arange(len(rows)), count)
            at = s[own] + np.arange(len(own)) - np.repeat(np.cumsum(count) - count, count)
            h = H.span(self.p, at, np.minimum(at + n, e[own])) + (at == s[own]).astype(H.U) * H.U(0xC2B2AE3D27D4EB4F)
            every.append((H.mix(h) >> H.U(46)).astype(np.int64))
            owner.append(own)
        owner, every = np.concatenate(owner), np.concatenate(every)
        o = np.argsort(owner, kind="stable")
        return every[o], np.searchsorted(owner[o], np.arange(len(rows) + 1))


def word_inputs(w: Words, m: Model, rows: np.ndarray) -> np.ndarray:
    """(rows, INPUTS)."""
    if not len(rows):
        return np.zeros((0, INPUTS), np.float32)
    g, first = w.grams(rows)
    v = m["gram"][g]
    own = m["word"][(w.hash[rows] >> H.U(46)).astype(np.int64)]
    mean = np.add.reduceat(v, first[:-1]) / np.diff(first)
    one = np.ones(len(rows), np.float32)
    return np.stack([own, np.maximum.reduceat(v, first[:-1]), mean, np.minimum.reduceat(v, first[:-1]), one, (own != 0) * one], axis=1).astype(np.float32)


def cut(first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(first word of each window, first window of each text and the total): windows at every HOP words, the last at the end."""
    n = np.diff(first)
    count = np.maximum(1, -(-(n - WINDOW) // HOP) + 1)
    own = np.concatenate([[0], np.cumsum(count)])
    text = np.repeat(np.arange(len(n)), count)
    k = np.arange(own[-1]) - own[text]
    return first[text] + np.minimum(k * HOP, np.maximum(0, n[text] - WINDOW)), own


def gates(x: np.ndarray, h: np.ndarray, u: np.ndarray) -> tuple[np.ndarray, ...]:
    """One step: x are projected inputs (n, 3 * STATE); returns state, update, reset, candidate."""
    a = h @ u[:, : 2 * STATE]
    a += x[:, : 2 * STATE]
    zr = 1 / (1 + np.exp(-a))
    z, r = zr[:, :STATE], zr[:, STATE:]
    c = np.tanh(x[:, 2 * STATE :] + (r * h) @ u[:, 2 * STATE :])
    return h + z * (c - h), z, r, c


def run_windows(x: np.ndarray, mask: np.ndarray | None, m: Model) -> tuple[np.ndarray, list]:
    """(states (n, WINDOW, 2 * STATE), what back-propagation needs) of projected inputs (WINDOW, n, 2 * 3 * STATE)."""
    n = x.shape[1]
    out, kept = np.zeros((WINDOW, n, 2 * STATE), np.float32), []
    for way, steps in ((0, range(WINDOW)), (1, range(WINDOW - 1, -1, -1))):
        h = np.zeros((n, STATE), np.float32)
        for t in steps:
            new, z, r, c = gates(x[t, :, way * 3 * STATE : (way + 1) * 3 * STATE], h, m[f"u{way}"])
            if mask is not None:
                new = np.where(mask[t][:, None], new, h)
            kept.append((way, t, h, z, r, c))
            h = new
            out[t, :, way * STATE : (way + 1) * STATE] = h
    return out, kept


def attention(s: np.ndarray, mask: np.ndarray | None, m: Model) -> tuple[np.ndarray, np.ndarray]:
    """(weights (WINDOW, n), pooled states (n, 2 * STATE))."""
    a = s @ m["v"]
    if mask is not None:
        a = np.where(mask, a, -30)
    a = np.exp(a - a.max(axis=0))
    a /= a.sum(axis=0)
    return a, np.einsum("tn,tns->ns", a, s)


def window_logits(inputs: np.ndarray, rows: np.ndarray, mask: np.ndarray | None, m: Model) -> np.ndarray:
    """Logits of windows given as (n, WINDOW) rows of the projected inputs of distinct words."""
    states, _ = run_windows(inputs[rows.T], mask, m)
    return attention(states, mask, m)[1] @ m["o"] + m["ob"]


class Scorer:
    """Scores columns of whole texts; keeps the projected inputs of words it has seen, up to a bound."""

    MOST = 200_000

    def __init__(self, m: Model) -> None:
        self.m = m
        self.keys, self.inputs = np.zeros(0, H.U), np.zeros((0, 6 * STATE), np.float32)

    def projected(self, w: Words) -> np.ndarray:
        out = np.zeros((len(w.hash), 6 * STATE), np.float32)
        at = np.minimum(np.searchsorted(self.keys, w.hash), max(0, len(self.keys) - 1))
        hit = self.keys[at] == w.hash if len(self.keys) else np.zeros(len(w.hash), dtype=bool)
        out[hit] = self.inputs[at[hit]]
        new = np.flatnonzero(~hit)
        out[new] = word_inputs(w, self.m, new) @ self.m["x"] + self.m["xb"]
        if len(self.keys) + len(new) > self.MOST:
            self.keys, self.inputs = w.hash[: self.MOST], out[: self.MOST]
        elif len(new):
            at = np.searchsorted(self.keys, w.hash[new])
            self.keys, self.inputs = np.insert(self.keys, at, w.hash[new]), np.insert(self.inputs, at, out[new], axis=0)
        return out

    def windows(self, col: pa.Array) -> tuple[np.ndarray, np.ndarray, Words, np.ndarray]:
        """(logit of each window, first window of each text and the total, words, first word of each window)."""
        w = Words(*H.text_bytes(col))
        start, own = cut(w.first)
        x = np.concatenate([self.projected(w), np.zeros((1, 6 * STATE), np.float32)])
        inverse = np.append(w.inverse, np.full(WINDOW, len(w.hash))).astype(np.int64)
        end = np.repeat(w.first[1:], np.diff(own))
        out = np.zeros(len(start), np.float32)
        full = end - start >= WINDOW
        for ok in (True, False):
            for some in np.array_split(np.flatnonzero(full == ok), max(1, int((full == ok).sum()) // 4096)):
                if len(some):
                    place = start[some][:, None] + np.arange(WINDOW)
                    mask = None if ok else (place < end[some][:, None]).T
                    rows = inverse[place] if ok else np.where(mask.T, inverse[np.minimum(place, len(inverse) - 1)], len(w.hash))
                    out[some] = window_logits(x, rows, mask, self.m)
        return out, own, w, start

    def scores(self, col: pa.Array) -> np.ndarray:
        out, own, _, _ = self.windows(col)
        return sigmoid(np.maximum.reduceat(out, own[:-1]).astype(np.float64)) if len(col) else np.zeros(0)


def feature_counts(parts: list[pa.Array], labels: list[np.ndarray], of) -> np.ndarray:
    """(2, TABLE): labelled documents of each class that hold a hashed feature; of(words, rows) gives a word's features."""
    n = np.zeros((2, TABLE), np.int64)
    for texts, y in zip(parts, labels, strict=True):
        w = Words(*H.text_bytes(texts))
        doc = np.repeat(np.arange(len(y)), np.diff(w.first))
        for a in range(0, len(y), 64):
            here = slice(w.first[a], w.first[min(a + 64, len(y))])
            pair = np.unique(doc[here] * len(w.hash) + w.inverse[here])
            d, word = pair // max(1, len(w.hash)), pair % max(1, len(w.hash))
            own, back = np.unique(word, return_inverse=True)
            b, first = of(w, own)
            size = np.diff(first)[back]
            at = np.repeat(first[back] - (np.cumsum(size) - size), size) + np.arange(size.sum())
            seen = np.unique(np.repeat(d, size) * TABLE + b[at])
            for k in (0, 1):
                n[k] += np.bincount(seen[y[seen // TABLE] == k] % TABLE, minlength=TABLE)
    return n


def log_odds(n: np.ndarray, total: list[int], least: int = 3) -> np.ndarray:
    """Learned weights of hashed features: log-odds less their standard error; 0 where fewer than `least` documents hold one."""
    out = np.log((n[1] + 0.5) / (total[1] + 1)) - np.log((n[0] + 0.5) / (total[0] + 1))
    out = np.sign(out) * np.maximum(0, np.abs(out) - np.sqrt(1 / (n[1] + 0.5) + 1 / (n[0] + 0.5)))
    return np.where(n[0] + n[1] >= least, np.clip(out, -4, 4) / 2, 0).astype(np.float32)


class Part:
    """The windows of some labelled texts: inputs of distinct words, and each window's words."""

    def __init__(self, texts: pa.Array, m: Model) -> None:
        w = Words(*H.text_bytes(texts))
        self.raw = np.concatenate([word_inputs(w, m, np.arange(len(w.hash))), np.zeros((1, INPUTS), np.float32)])
        start, self.own = cut(w.first)
        place = start[:, None] + np.arange(WINDOW)
        self.inside = place < np.repeat(w.first[1:], np.diff(self.own))[:, None]
        words = w.inverse.astype(np.int32) if len(w.inverse) else np.zeros(1, np.int32)
        self.rows = np.where(self.inside, words[np.minimum(place, len(words) - 1)], np.int32(len(w.hash)))

    def first_guess(self) -> np.ndarray:
        """How high a window's words weigh, before the network knows better."""
        return np.where(self.inside, (self.raw[:, 0] + self.raw[:, 1])[self.rows], -9).max(axis=1)

    def logits(self, m: Model) -> np.ndarray:
        x = self.raw @ m["x"] + m["xb"]
        return np.concatenate([window_logits(x, self.rows[k : k + 4096], self.inside[k : k + 4096].T, m) for k in range(0, len(self.rows), 4096)])


def train(texts: pa.Array, y: np.ndarray, w: np.ndarray, seed: int = 5) -> Model:
    """A model from texts, labels 0/1 and weights; works through slices of the texts, so memory stays small."""
    r = np.random.default_rng(seed)
    m: Model = {
        "x": r.normal(0, 0.4, (INPUTS, 6 * STATE)).astype(np.float32),
        "xb": np.zeros(6 * STATE, np.float32),
        "u0": r.normal(0, 0.3, (STATE, 3 * STATE)).astype(np.float32),
        "u1": r.normal(0, 0.3, (STATE, 3 * STATE)).astype(np.float32),
        "v": r.normal(0, 0.3, 2 * STATE).astype(np.float32),
        "o": r.normal(0, 0.3, 2 * STATE).astype(np.float32),
        "ob": np.full(1, -2, np.float32),
        "word": np.zeros(TABLE, np.float32),
        "gram": np.zeros(TABLE, np.float32),
    }
    if not len(y):
        return m
    cols = [b.column(0) for b in H.slices(iter([pa.RecordBatch.from_arrays([texts], ["text"])]), "text", 1 << 20)]
    ends = np.cumsum([len(c) for c in cols])
    labels = [y[e - len(c) : e] for c, e in zip(cols, ends.tolist(), strict=True)]
    total = [int((y == k).sum()) for k in (0, 1)]
    m["word"] = log_odds(feature_counts(cols, labels, lambda w, rows: ((w.hash[rows] >> H.U(46)).astype(np.int64), np.arange(len(rows) + 1))), total)
    m["gram"] = log_odds(feature_counts(cols, labels, lambda w, rows: w.grams(rows)), total)
    parts = [Part(c, m) for c in cols]
    best = [p.first_guess() for p in parts]
    adam = Adam({k: m[k] for k in ("x", "xb", "u0", "u1", "v", "o", "ob")}, 0.01)
    epochs = max(EPOCHS, -(-STEPS * BATCH // (len(y) + total[0])))
    clean = np.flatnonzero(y == 0)
    label, weight = np.concatenate([y, y[clean]]), np.concatenate([w, w[clean]])
    for epoch in range(epochs):
        if epoch in (epochs // 3, 2 * epochs // 3):
            best = [p.logits(m) for p in parts]
        inputs, masks = [], []
        for of in ("best", "any"):
            for p, score, own_y in zip(parts, best, labels, strict=True):
                if of == "best":
                    win = np.array([a + int(np.argmax(score[a:b])) for a, b in zip(p.own[:-1], p.own[1:], strict=True)])
                else:
                    win = (p.own[:-1] + (r.random(len(own_y)) * np.diff(p.own)).astype(np.int64))[own_y == 0]
                inputs.append(p.raw[p.rows[win]])
                masks.append(p.inside[win])
        e, mask = np.concatenate(inputs), np.concatenate(masks)
        adam.rate = 0.012 * (1 - epoch / epochs) + 0.001
        order = r.permutation(len(e))
        for k in range(0, len(order), BATCH):
            b = order[k : k + BATCH]
            adam.step(gradients(e[b].transpose(1, 0, 2), mask[b].T, label[b], weight[b], m))
    return m


def gradients(e: np.ndarray, mask: np.ndarray, y: np.ndarray, w: np.ndarray, m: Model) -> Model:
    """Of the weighted loss of windows with inputs e (WINDOW, n, INPUTS)."""
    x = e @ m["x"] + m["xb"]
    states, kept = run_windows(x, mask, m)
    a, ctx = attention(states, mask, m)
    d = ((sigmoid(ctx @ m["o"] + m["ob"]) - y) * w / len(y)).astype(np.float32)
    g = {"o": ctx.T @ d, "ob": d.sum(keepdims=True)}
    dctx = d[:, None] * m["o"]
    da = np.einsum("tns,ns->tn", states, dctx)
    da = a * (da - (a * da).sum(axis=0))
    ds = a[..., None] * dctx + da[..., None] * m["v"]
    g["v"] = np.einsum("tn,tns->s", da, states)
    dx = np.zeros_like(x)
    g |= {k: np.zeros_like(m[k]) for k in ("u0", "u1")}
    dh = [np.zeros((len(y), STATE), np.float32) for _ in range(2)]
    for way, t, h, z, r, c in reversed(kept):
        u, gu = m[f"u{way}"], g[f"u{way}"]
        total = dh[way] + ds[t, :, way * STATE : (way + 1) * STATE]
        here = np.where(mask[t][:, None], total, 0)
        dc = here * z * (1 - c * c)
        drh = dc @ u[:, 2 * STATE :].T
        dz, dr = here * (c - h) * z * (1 - z), drh * h * r * (1 - r)
        dzr = np.concatenate([dz, dr], axis=1)
        gu[:, : 2 * STATE] += h.T @ dzr
        gu[:, 2 * STATE :] += (r * h).T @ dc
        dx[t, :, way * 3 * STATE : (way + 1) * 3 * STATE] = np.concatenate([dzr, dc], axis=1)
        dh[way] = here * (1 - z) + drh * r + dzr @ u[:, : 2 * STATE].T + (total - here)
    g["x"] = np.einsum("tni,tnj->ij", e, dx, optimize=True)
    g["xb"] = dx.sum(axis=(0, 1))
    return g


def score(docs: DataFrame, m: Model) -> DataFrame:
    """(doc_id, score) of every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(m)
        for b in H.slices(batches, "text"):
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(scorer.scores(b.column(1)))], ["doc_id", "score"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, score double")


def classify(docs: DataFrame, labels: DataFrame, threshold: float = 0.5) -> DataFrame:
    """doc_id, held_out, score, predicted of every row, by a model trained on the labelled rows that are not held out."""
    out = score(docs, train(*sample(docs, labels, "toxic")))
    return out.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))
