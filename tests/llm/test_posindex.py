import hashlib
import random
import re

import pytest
from textweir.llm import posindex, queries

WORDS = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words(t):
    return WORDS.findall((t or "").translate({k: k + 32 for k in range(65, 91)}))


def brute(docs, items, width):
    out = []
    for i, t in docs:
        w = words(t)
        hit, found = set(), set()
        for item, text in items:
            x = words(text)
            for s in range(max(1, len(x) - width + 1) if x else 0):
                q = x[s : s + width]
                for p in range(len(w) - len(q) + 1):
                    if w[p : p + len(q)] == q:
                        hit |= set(range(p, p + len(q)))
                        found.add(str(item))
        out.append((i, len(w), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), bool(hit)))
    return out


def fixture():
    r = random.Random(8)
    vocab = ["the", "of", "cat", "dog", "é", "x1", "rare", "lone"]
    items = [(k, " ".join(r.choice(vocab) for _ in range(r.choice([1, 3, 10, 11, 14])))) for k in range(14)] + [(20, None), (21, ""), (22, "!!"), (2, "of of"), (23, "zz")]
    docs = [(k, ", ".join(r.choice(vocab) for _ in range(r.randint(0, 40)))) for k in range(40)]
    docs += [(50, None), (51, ""), (52, "x " + (items[9][1] or "") + " y"), (53, (items[5][1] or "").upper() * 2), (54, "of the " * 3000)]
    return docs, items


@pytest.mark.parametrize("block", [10**6, 120])
def test_matches_brute_force(spark, tmp_path, monkeypatch, block):
    docs, items = fixture()
    monkeypatch.setattr(posindex.exact_matches, "__defaults__", (10, block))
    spark.createDataFrame([(i, t, "q") for i, t in docs], "doc_id long, text string, items string").repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    got = queries.op9_decontamination(spark, str(tmp_path)).orderBy("doc_id").collect()
    assert [tuple(r) for r in got] == brute(docs, items, 10)


def test_table(spark):
    read = lambda n: [tuple(r)[:2] for r in spark.read.parquet(f"/root/testdata/sf0.001/{n}.parquet").collect()]
    got = queries.op9_decontamination(spark, "/root/testdata/sf0.001").orderBy("doc_id").collect()
    assert [tuple(r) for r in got] == brute(sorted(read("documents")), read("benchmark"), 10)


def test_proximity(spark):
    docs = spark.createDataFrame([(1, "a b c alpha d e beta f"), (2, "alpha " + "x " * 30 + "beta"), (3, "beta alpha")], "doc_id long, text string")
    items = spark.createDataFrame([(7, "alpha beta")], "item_id long, text string")
    assert sorted((r.doc_id, r.item_id) for r in posindex.proximity(docs, items, 2, 5).collect()) == [(1, "7"), (3, "7")]


def test_empty_tables(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    item = spark.createDataFrame([(1, "a b")], "item_id long, text string")
    assert posindex.exact_matches(none, item).count() == 0
    one = spark.createDataFrame([(None, "a b"), (None, "a b")], "doc_id long, text string")
    assert [r.n_hit for r in posindex.exact_matches(one, item.limit(0)).collect()] == [0, 0]
    assert [r.n_hit for r in posindex.exact_matches(one, item).collect()] == [2, 2]
