import numpy as np
import pytest
from pyspark.sql import functions as F
from textweir.llm import pivots, queries

from . import brute


def want(rows, least=0.98):
    """{vec_id: (links, component)} by brute force; ids are distinct."""
    ok = {}
    for i, v, label in rows:
        if v is not None and label is not None and all(x is not None and np.isfinite(x) for x in v) and any(v):
            ok[i] = (np.array(v, np.float32).astype(np.float64), label)
    links = []
    ids = sorted(ok)
    for k, a in enumerate(ids):
        for b in ids[k + 1 :]:
            (x, p), (y, q) = ok[a], ok[b]
            if p == q and len(x) == len(y) and x @ y / np.sqrt((x @ x) * (y @ y)) >= least:
                links.append((a, b))
    comp = brute.components(ids, links)
    n = dict.fromkeys([r[0] for r in rows], 0)
    for a, b in links:
        n[a] += 1
        n[b] += 1
    return {i: (n[i], comp.get(i, i)) for i, _, _ in rows}


def got(df):
    rows = df.collect()
    assert all(r.kept == (r.vec_id == r.component_id) for r in rows)
    return {r.vec_id: (r.n_links, r.component_id) for r in rows}


SCHEMA = "vec_id long, embedding array<float>, label int"


@pytest.mark.parametrize("block", [512, 7])
def test_matches_brute_force(spark, monkeypatch, block):
    monkeypatch.setattr(pivots, "BLOCK", block)
    r = np.random.default_rng(4)
    rows = []
    for c in range(25):
        base = r.normal(size=16)
        for _ in range(r.integers(1, 12)):
            rows.append([len(rows), (base + r.normal(size=16) * r.choice([0, 0.03, 0.08])).tolist(), int(c % 3)])
    rows += [[200, None, 1], [201, [0.0] * 16, 1], [202, [None, *[1.0] * 15], 1], [203, [float("nan")] * 16, 1], [204, [float("inf")] * 16, 1], [205, rows[0][1], None], [206, [], 1], [207, [1.0, 2.0], 1], [208, [2.0, 4.0], 1], [209, [x * 1e-30 for x in rows[3][1]], rows[3][2]]]
    assert got(pivots.near_duplicates(spark.createDataFrame(rows, SCHEMA))) == want(rows)


def test_table_has_no_links_of_its_own(spark):
    """The small tables hold no pair at the threshold; a lower one has links to find."""
    rows = [(r.vec_id, r.embedding, r.label) for r in spark.read.parquet("/root/testdata/sf0.01/embeddings.parquet").select("vec_id", "embedding", "label").collect()]
    assert got(queries.op4_pivots(spark, "/root/testdata/sf0.01")) == want(rows)


def test_recall_with_tight_clusters(spark):
    """Three labels of 800 vectors of 64 dimensions, of which a share lies in one cluster whose pairs are around the threshold."""
    r = np.random.default_rng(8)
    rows, true = [], {}
    for label, share in enumerate((0.1, 0.5, 0.9)):
        tight = int(800 * share)
        v = r.normal(size=(800, 64))
        v[:tight] = r.normal(size=64) + r.normal(size=(tight, 64)) * 0.14
        v[-60:-30] = v[-30:] + r.normal(size=(30, 64)) * 0.16 * np.linalg.norm(v[-30:], axis=1, keepdims=True) / 8
        m = pivots.unit(v.astype(np.float32))
        links = (m @ m.T >= 0.98).sum(1) - 1
        assert links.sum() > 1000
        true |= {len(rows) + i: (label, n) for i, n in enumerate(links.tolist())}
        rows += [(len(rows) + i, x.tolist(), label) for i, x in enumerate(v)]
    found = got(pivots.near_duplicates(spark.createDataFrame(rows, SCHEMA)))
    assert all(found[i][0] <= n for i, (_, n) in true.items())
    for k in range(3):
        assert sum(found[i][0] for i, (label, _) in true.items() if label == k) >= 0.99 * sum(n for label, n in true.values() if label == k)


def test_labels_and_components_of_any_type(spark):
    rows = [(1, [1.0, 1e-9], "a"), (2, [1.0, 2e-9], "a"), (3, [1.0, 1e-9], "b")]
    out = got(pivots.near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label string")))
    assert out == {1: (1, 1), 2: (1, 1), 3: (0, 3)}
    big = [(1, [1.0, 0.0], 1 << 40), (2, [1.0, 0.0], 1 << 40), (3, [1.0, 0.0], 0)]
    assert got(pivots.near_duplicates(spark.createDataFrame(big, "vec_id long, embedding array<float>, label long"))) == {1: (1, 1), 2: (1, 1), 3: (0, 3)}


def test_repeated_rows_and_nothing(spark):
    rows = [(None, [1.0, 0.0], 1), (5, [1.0, 0.0], 1), (5, [1.0, 0.0], 1), (4, [1.0, 0.01], 1), (5, [0.0, 1.0], 1)]
    out = pivots.near_duplicates(spark.createDataFrame([(*r, "x", 1) for r in rows], SCHEMA + ", pivot string, n int")).collect()
    assert sorted((r.vec_id or 0, r.n_links, r.component_id or 0, r.kept) for r in out) == [(0, 0, 0, True), (4, 2, 4, True), (5, 0, 5, True), (5, 2, 4, False), (5, 2, 4, False)]
    assert pivots.near_duplicates(spark.createDataFrame([], SCHEMA)).count() == 0


def test_no_side_of_a_join_is_gathered_on_the_driver(spark, monkeypatch):
    """Lists come out of a small file, so the planner broadcast their sizes, a million rows of them at 6 GB."""
    plans, written = [], pivots.written

    def noted(df, name):
        plans.append(df._jdf.queryExecution().executedPlan().toString())
        return written(df, name)

    monkeypatch.setattr(pivots, "written", noted)
    r = np.random.default_rng(5)
    v = spark.createDataFrame([(i, x, 0) for i, x in enumerate(r.normal(size=(300, 8)).tolist())], "vec_id long, embedding array<float>, label int")
    out = pivots.near_duplicates(v, 0.9)
    plans.append(out._jdf.queryExecution().executedPlan().toString())
    assert len(out.collect()) == 300 and sum("SortMergeJoin" in p for p in plans) >= 3
    assert not any("Broadcast" in p for p in plans)


def test_sample_sends_the_driver_no_more_than_it_needs(spark):
    rows = [(i, [float(i % 7 + 1), float(i)]) for i in range(4000)]
    classes = spark.createDataFrame(rows, "node long, embedding array<float>").repartition(8)
    some = pivots.sample(classes, 50, 4000)
    every = classes.orderBy(F.xxhash64("embedding"), "node").limit(50).select("embedding")
    assert [r[0] for r in some.collect()] == [r[0] for r in every.collect()]
    below = pivots.sample(classes, 10**6, 4000)  # more than there are: all
    assert below.count() == 4000
    plan = some._jdf.queryExecution().optimizedPlan().toString()
    least = int(-(2**63) + 2**64 * 100 / 4000)
    assert str(least) in plan  # the bound is applied before rows are sorted for the driver
    assert classes.where(F.xxhash64("embedding") < least).count() < 200
    # a bound that leaves too few is dropped
    same = spark.createDataFrame([(i, [3.0, 4.0]) for i in range(400)], "node long, embedding array<float>")
    assert pivots.sample(same, 20, 400).count() == 20
