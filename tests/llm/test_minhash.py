import random

import numpy as np
import pytest
from textweir.llm import minhash, shared
from textweir.llm.components import components

from . import brute


def corpus():
    r = random.Random(5)
    vocab = ["".join(r.choice("abcdefghij") for _ in range(r.randint(2, 6))) for _ in range(400)]
    rows, i = [], 0
    for _ in range(12):
        base = [r.choice(vocab) for _ in range(r.randint(30, 200))]
        for _ in range(r.randint(1, 9)):
            w = list(base)
            for _ in range(r.randint(0, 4)):
                w[r.randrange(len(w))] = r.choice(vocab)
            rows.append((i, " ".join(w).capitalize()))
            i += 1
    rows += [(i, None), (i + 1, ""), (i + 2, " \n\t"), (i + 3, "One two"), (i + 4, "one  TWO"), (i + 5, "one"), (i + 6, "é É")]
    return rows


@pytest.mark.parametrize(("width", "num"), [(5, 80)])  # (3, 85) below, on a table
def test_matches_brute_force(spark, width, num):
    rows = corpus()
    got = minhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), width, num).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got} == brute.near_duplicates(rows, width, num, 100)
    assert all(r.kept == (r.doc_id == r.component_id) for r in got)


def test_table(spark):
    d = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    got = minhash.near_duplicates(d, 3, 85).collect()
    want = brute.near_duplicates([(r.doc_id, r.text) for r in d.collect()], 3, 85, 100)
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got} == want


def test_many_copies_span_blocks(spark, monkeypatch):
    monkeypatch.setattr(minhash, "BLOCK", 8)
    rows = [(i, " ".join(f"w{k}" if k != i % 37 else "x" for k in range(40))) for i in range(60)]
    got = minhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), 3, 70).collect()
    assert {r.doc_id: r.component_id for r in got} == {i: c for i, (_, c) in brute.near_duplicates(rows, 3, 70, 100).items()}


def test_parts_that_leaders_do_not_join(spark, monkeypatch):
    """Families whose members drift word by word: most links are not to the first row of a bucket."""
    monkeypatch.setattr(minhash, "BLOCK", 5)
    monkeypatch.setattr(minhash, "LEADERS", 1)
    rows, w = [], [f"w{k}" for k in range(60)]
    for i in range(50):
        w[(i * 7) % 60] = f"x{i}"
        rows.append((100 - i, " ".join(w)))
    got = minhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), 3, 70).collect()
    assert {r.doc_id: r.component_id for r in got} == {i: c for i, (_, c) in brute.near_duplicates(rows, 3, 70, 100).items()}


def test_texts_under_one_doc_id_are_one_document(spark):
    a, b = ([f"{x}{k}" for k in range(40)] for x in "ab")
    rows = [(7, " ".join(a)), (7, " ".join(b)), (9, " ".join([*a, "x"])), (11, " ".join([*b, "x"])), (12, "alone")]
    got = minhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), 3, 85).collect()
    assert sorted((r.doc_id, r.component_id, r.kept) for r in got) == [(7, 7, True), (7, 7, True), (9, 7, False), (11, 7, False), (12, 12, True)]


def test_large_classes_and_hubs(spark, monkeypatch):
    monkeypatch.setattr(shared, "HOT_SHARE", 1e-9)
    monkeypatch.setattr(shared, "FEW", 3)
    r = random.Random(9)
    rows = [(i, "the same words again " * 9) for i in range(40)]
    rows += [(100 + i, " ".join(f"w{k}" if k != r.randrange(40) else "x" for k in range(40))) for i in range(60)]
    rows += [(i, t + " y" * (i > 5) + " " + "long " * 20000) for i, t in corpus()[:9] if t]
    got = minhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), 3, 70).collect()
    want = brute.near_duplicates([(k, t) for k, (_, t) in enumerate(rows)], 3, 70, 100)
    by = {i: rows[c][0] for i, c in zip([i for i, _ in rows], [c for _, c in want.values()], strict=True)}
    assert {x.doc_id: x.component_id for x in got if x.doc_id >= 100} == {i: c for i, c in by.items() if i >= 100}


def test_edges_of_input(spark):
    schema = "doc_id long, text string, component_id string, keys int"
    rows = [(None, "a b c d", "x", 1), (3, "a b c d", "y", 2), (3, "a b c d", "y", 2), (2, "A b C d", None, None)]
    got = minhash.near_duplicates(spark.createDataFrame(rows, schema), 3, 85).collect()
    assert sorted((r.doc_id or -1, r.component_id or -1, r.kept) for r in got) == [(-1, -1, True), (2, 2, True), (3, 2, False), (3, 2, False)]
    assert minhash.near_duplicates(spark.createDataFrame([], schema)).count() == 0


def test_estimate_is_collision_corrected():
    r = np.random.default_rng(1)
    pool = r.integers(0, 1 << 63, 3000).astype(np.uint64)
    a, b = np.unique(pool[:2000]), np.unique(pool[1000:])
    k = 1024
    x, y = (np.frombuffer(minhash.packed(minhash.minima(s, k), 2), np.uint8)[None] for s in (a, b))
    assert abs(minhash.estimate(x, y, k, 2)[0, 0] - 1 / 3) < 0.08


def test_components_by_rounds_and_by_one_task(spark):
    rng = random.Random(5)
    links = [(i, i + 1) for i in range(0, 60)] + [(100, k) for k in range(101, 130)] + [(rng.randrange(200, 300), rng.randrange(200, 300)) for _ in range(70)] + [(7, 7)]
    nodes = sorted({x for a, b in links if a != b for x in (a, b)})
    want = brute.components(nodes, links)
    for per_task in (0, 20, 1000):
        for name in (int, "n{:05}".format):
            df = spark.createDataFrame([(name(a), name(b)) for a, b in links] * 2 + [(None, name(1))], f"a {'long' if name is int else 'string'}, b {'long' if name is int else 'string'}")
            got = {r.node: r.component for r in components(df, per_task).collect()}
            assert sorted(got) == [name(x) for x in nodes]
            same = {}
            for x in nodes:
                assert same.setdefault(got[name(x)], want[x]) == want[x]
            assert len(same) == len(set(want.values()))
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0
