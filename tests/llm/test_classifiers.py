import random
import zlib

import numpy as np
import pyarrow as pa
import pytest
from textweir.llm import bigru, bytecnn, queries

R = random.Random(2)
WORDS = ["the", "cat", "house", "river", "under", "bridge", "lamp", "green", "stone", "walked", "morning", "paper"]


def prose(n):
    return " ".join(R.choice(WORDS) for _ in range(n))


def junk(n):
    return " ".join(R.choice(WORDS).upper() + "!!" for _ in range(n))


def rude(n):
    w = [R.choice(WORDS) for _ in range(n)]
    w[R.randrange(n)] = R.choice(["grumblefool", "grumblefools", "nastywort"])
    return " ".join(w)


def made(bad):
    n = lambda: R.choice([5, 20, 60, 300])
    return [(prose(n()), 0) for _ in range(150)] + [(bad(n()), 1) for _ in range(60)]


def small_steps(monkeypatch):
    monkeypatch.setattr(bytecnn, "STEPS", 120)
    monkeypatch.setattr(bigru, "STEPS", 120)


@pytest.mark.parametrize(("module", "bad"), [(bytecnn, junk), (bigru, rude)])
def test_held_out_accuracy(monkeypatch, module, bad):
    small_steps(monkeypatch)
    train, test = made(bad), made(bad)
    y = np.array([y for _, y in train], np.float32)
    m = module.train(pa.array([t for t, _ in train]), y, np.ones(len(y), np.float32))
    score = module.Scorer(m).scores if module is bigru else lambda c: module.scores(c, m)
    p = score(pa.array([t for t, _ in test]))
    assert ((p > 0.5) == np.array([y for _, y in test])).mean() > 0.95
    again = np.concatenate([score(pa.array([t])) for t, _ in test])
    assert np.abs(p - again).max() < 1e-3


@pytest.mark.parametrize("module", [bytecnn, bigru])
def test_gradients(module):
    r = np.random.default_rng(0)
    m = module.train(pa.array([], pa.string()), np.zeros(0, np.float32), np.zeros(0, np.float32))
    y, w = np.array([0, 1, 1], np.float32), np.ones(3, np.float32)
    if module is bytecnn:
        m["o"] = r.normal(0, 0.3, module.HIDDEN).astype(np.float32)
        data = r.integers(32, 120, 3000).astype(np.uint8)
        x, first = module.padded(data, np.array([0, 700, 1500, 3000]))
        grad = lambda: module.gradients(x, first, y, w, m)
        out = lambda: module.logits(module.features(module.pooled(x, m), first), m)
        keys = ("b", "hb", "o")
    else:
        raw = r.normal(0, 1, (50, module.INPUTS)).astype(np.float32)
        rows, mask = r.integers(0, 50, (3, module.WINDOW)), np.ones((module.WINDOW, 3), dtype=bool)
        mask[20:, 1] = False
        grad = lambda: module.gradients(raw[rows.T], mask, y, w, m)
        out = lambda: module.window_logits(raw @ m["x"] + m["xb"], rows, mask, m)
        keys = ("x", "xb", "u0", "u1", "v", "o")

    def loss():
        z = out().astype(np.float64)
        return float(np.mean(np.logaddexp(0, z) - y * z))

    g = grad()
    for k in keys:
        for _ in range(6):
            i = tuple(r.integers(0, n) for n in m[k].shape)
            old, step = m[k][i], np.float32(3e-3)
            m[k][i] = old + step
            up = loss()
            m[k][i] = old - step
            down = loss()
            m[k][i] = old
            assert abs((up - down) / (2 * step) - g[k][i]) < 2e-3 + 0.05 * abs(g[k][i])


@pytest.mark.parametrize("query", [queries.op6_quality, queries.op7_toxicity])
def test_queries(spark, tmp_path, monkeypatch, query):
    small_steps(monkeypatch)
    bad = junk if query is queries.op6_quality else rude
    rows = [(i, t, y) for i, (t, y) in enumerate(made(bad))]
    docs = [(i, t, 0.5) for i, t, _ in rows] + [(900, None, 0.1), (901, "", 0.1), (None, "x", 0.1), (5, rows[5][1], 0.1), (902, prose(100000), 0.0)]
    spark.createDataFrame(docs, "doc_id long, text string, score double").write.parquet(f"{tmp_path}/documents.parquet")
    q = query is queries.op6_quality
    spark.createDataFrame([(i, 1 - y if q else 0, y) for i, _, y in rows] + [(3, None, None), (None, 1, 1)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    got = query(spark, str(tmp_path)).collect()
    assert len(got) == len(docs) and all(0 <= r.score <= 1 and r.predicted == int(r.score >= (0.3 if q else 0.5)) for r in got)
    assert all(r.held_out == (r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in got)
    y = {i: y for i, _, y in rows}
    held = [(r.predicted == (1 - y[r.doc_id] if q else y[r.doc_id])) for r in got if r.held_out and r.doc_id in y]
    assert sum(held) / len(held) > 0.9


def test_without_labels(spark):
    docs = spark.createDataFrame([(1, "a b")], "doc_id long, text string")
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert bytecnn.classify(docs, labels).count() == bigru.classify(docs, labels).count() == 1
    assert bytecnn.classify(docs.limit(0), labels).count() == bigru.classify(docs.limit(0), labels).count() == 0


def test_scores_equal_a_plain_forward_pass():
    """bytecnn over a whole text, chunk by chunk and patch by patch."""
    r = np.random.default_rng(1)
    m = bytecnn.train(pa.array([], pa.string()), np.zeros(0, np.float32), np.zeros(0, np.float32)) | {"o": r.normal(0, 0.3, bytecnn.HIDDEN).astype(np.float32)}
    for text in ("", "short", "The Quick brown fox! " * 90, "ä1b2 " * 400):
        data = text.encode()
        half = bytecnn.HALF
        data = data.ljust(max(2, -(-len(data) // half)) * half, b"\0")
        chunks = []
        for a in range(0, len(data) - half, half):
            best = np.full(bytecnn.FILTERS, -np.inf)
            for lo in (a, a + half):
                for k in range(0, half - bytecnn.WIDTH + 1, bytecnn.STRIDE):
                    best = np.maximum(best, np.concatenate([bytecnn.CODES[b] for b in data[lo + k : lo + k + bytecnn.WIDTH]]) @ m["w"] + m["b"])
            chunks.append(np.maximum(best, 0))
        c = np.array(chunks)
        f = np.concatenate([c.mean(0), c.max(0), c.min(0)])
        want = 1 / (1 + np.exp(-(np.tanh(f @ m["h"] + m["hb"]) @ m["o"] + m["ob"][0])))
        assert abs(bytecnn.scores(pa.array([text]), m)[0] - want) < 1e-4


def test_training_uses_whole_texts(monkeypatch):
    """The sign of a class stands at the end of long texts only, in any of their pieces."""
    monkeypatch.setattr(bytecnn, "STEPS", 120)
    monkeypatch.setattr(bytecnn, "PIECE", 7)
    rows = [(prose(300) + (" " + junk(60) if k % 2 else ""), k % 2) for k in range(80)]
    y = np.array([k for _, k in rows], np.float32)
    m = bytecnn.train(pa.array([t for t, _ in rows]), y, np.ones(len(y), np.float32))
    test = [(prose(900) + (" " + junk(60) if k % 2 else ""), k % 2) for k in range(40)]
    assert ((bytecnn.scores(pa.array([t for t, _ in test]), m) > 0.5) == np.array([k for _, k in test])).mean() > 0.9
