import hashlib
import random

import numpy as np
import pytest
from textweir.llm import bytehash as H
from textweir.llm import phrases, prefixfree, queries

N = phrases.LENGTH


def brute(rows):
    """{(doc_id, rank among equal ids): result}; rows in order of (doc_id, text)."""
    seen, out = set(), []
    for i, t in sorted(((-(1 << 63) if i is None else i), (t or "").encode()) for i, t in rows):
        gone = [False] * len(t)
        for s in range(len(t) - N + 1):
            w = t[s : s + N]
            if w in seen:
                gone[s : s + N] = [True] * N
            seen.add(w)
        spans = sum(g and not (k and gone[k - 1]) for k, g in enumerate(gone))
        out.append((i, len(t), sum(gone), spans, hashlib.sha256(bytes(b for b, g in zip(t, gone, strict=True) if not g)).hexdigest()))
    return sorted(out)


def got(df):
    return sorted((-(1 << 63) if r.doc_id is None else r.doc_id, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in df.collect())


def corpus():
    r = random.Random(6)
    word = lambda: "".join(r.choice("abcdé") for _ in range(r.randint(1, 5)))
    text = lambda n: " ".join(word() for _ in range(n))
    common, line = text(60), text(25)[:105]
    rows = []
    for i in range(60):
        t = text(r.choice([3, 30, 150]))
        kind = i % 6
        if kind == 0:
            t = t[:50] + common + t[50:]
        elif kind == 1:
            t = t + line + text(10)
        elif kind == 2 and i > 6:
            base = rows[i - 6][1]
            k = r.randrange(max(1, len(base)))
            t = base[:k] + "#" + base[k + 1 :]
        elif kind == 3:
            t = "be " * r.randint(20, 90) + t
        elif kind == 4 and i > 10:
            t = rows[r.randrange(i)][1]
        rows.append((i, t))
    rows += [(100, None), (101, ""), (102, "z" * 500), (None, common), (7, rows[7][1]), (7, line * 3), (103, "z" * 99), (104, common[:N]), (105, common[1 : N + 1])]
    r.shuffle(rows)
    return rows


@pytest.mark.parametrize("hot", [32, 1])
def test_matches_brute_force(spark, tmp_path, monkeypatch, hot):
    monkeypatch.setattr(prefixfree, "HOT", hot)
    rows = corpus()
    spark.createDataFrame([(i, t, "x") for i, t in rows], "doc_id long, text string, kept string").repartition(5).write.parquet(f"{tmp_path}/documents.parquet")
    assert got(queries.op8_repeats(spark, str(tmp_path))) == brute(rows)


def test_turns_share_out_the_windows(spark, monkeypatch):
    """All windows that are compared lay on disk at once, half as much again as the texts."""
    docs = spark.createDataFrame([r for r in corpus() if r[0] is not None], "doc_id long, text string")
    first = prefixfree.written(prefixfree.dictionary(prefixfree.phrase_blocks(docs, 4), 4), "phrases")

    def runs(turn, turns):
        cols = [prefixfree.unpack(r.block, *[prefixfree.RUN[f] for f in prefixfree.RUN.names], np.dtype("u1"))[:-1] for r in prefixfree.window_blocks(docs, first, 4, turn, turns).collect()]
        return sorted(x for c in cols for x in zip(*[a.tolist() for a in c], strict=True))

    every, shares = runs(0, 1), [runs(k, prefixfree.TURNS) for k in range(prefixfree.TURNS)]
    assert sorted(sum(shares, [])) == every and max(map(len, shares)) < 0.75 * len(every)
    monkeypatch.setattr(prefixfree, "FEW", 0)  # as for a large corpus
    assert got(prefixfree.remove_repeats(docs)) == brute([r for r in corpus() if r[0] is not None])
    assert not {x[0] for x in shares[0]} & {x[0] for x in shares[1]}  # a trigger string has one turn


def test_table(spark):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()]
    df = prefixfree.remove_repeats(spark.read.parquet("/root/testdata/sf0.001/documents.parquet"))
    assert got(df) == brute(rows)
    assert all(len(r.kept) == r.n_bytes - r.n_removed for r in df.collect())


def test_phrases_cover_all_windows_once():
    r = np.random.default_rng(3)
    data = r.integers(97, 99, 5000).astype(np.uint8)
    data[1000:1400] = 97
    off = np.array([0, 50, 149, 249, 2000, 2000, 5000])
    row, s, w, a = phrases.parse(data, off, H.prefix(data))
    every = [(int(k), int(x) + i) for k, x, n in zip(row, s, w, strict=True) for i in range(n)]
    assert every == [(k, i) for k in range(len(off) - 1) for i in range(off[k], off[k + 1] - N + 1)]
    assert ((a >= s + w - 1) & (a + phrases.KMER <= s + N)).all() and w.max() <= phrases.SPAN


def test_nothing(spark):
    assert prefixfree.remove_repeats(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_written_tables_leave_no_shuffle_files(spark):
    from textweir.llm import shared

    def left() -> set:
        files = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles()
        return {files.apply(i).getName() for i in range(files.size()) if files.apply(i).getName().startswith("shuffle_")}

    before = left()
    was = spark.conf.get(shared.CLEANUP, None)
    t = shared.written(spark.range(1000).repartition(3, "id"), "t")
    assert not left() - before
    assert t.count() == 1000 and spark.conf.get(shared.CLEANUP, None) == was
