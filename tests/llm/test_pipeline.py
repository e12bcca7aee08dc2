import re

import corpus_pipeline
import numpy as np
import pyarrow as pa
import pytest
from textweir.llm import bytecnn, labelled, secrets

from . import brute
from .test_native import base_spans
from .test_posindex import brute as brute_hits
from .test_tokens import check_packing

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module", autouse=True)
def few_steps():
    old, bytecnn.STEPS = bytecnn.STEPS, 60
    yield
    bytecnn.STEPS = old


def read(spark, name, sf=SF):
    return spark.read.parquet(f"{sf}/{name}.parquet")


def plain_redaction(text, model):
    spans = [(a, b) for a, _, b in base_spans(text)]
    size = len(secrets.ALPHABET)
    for m in re.finditer(secrets.RUN, text):
        c = [secrets.ALPHABET.index(x) for x in m[0]]
        mean = sum(model[a * size + b] for a, b in zip(c, c[1:], strict=False)) / (len(c) - 1)
        if mean >= secrets.THRESHOLD and all(b <= m.start() or m.end() <= a for a, b in spans[: len(base_spans(text))]):
            spans.append((m.start(), m.end()))
    merged = []
    for a, b in sorted(spans):
        if merged and a < merged[-1][1]:
            merged[-1][1] = max(merged[-1][1], b)
        else:
            merged.append([a, b])
    out, at = [], 0
    for a, b in merged:
        out += [text[at:a], "[secret]"]
        at = b
    return "".join([*out, text[at:]])


def test_run_equals_brute_force(spark):
    docs = {r.doc_id: r.text for r in read(spark, "documents").collect()}
    m = bytecnn.train(*labelled.sample(read(spark, "documents"), read(spark, "labels"), "quality"))
    ids = sorted(docs)
    p = bytecnn.scores(pa.array([docs[i] for i in ids]), m)
    assert np.abs(p - 0.3).min() > 1e-4
    kept = [i for i, x in zip(ids, p, strict=True) if x >= 0.3]
    comp = brute.near_duplicates([(i, docs[i]) for i in kept], 5, 80, 100)
    kept = [i for i in kept if comp[i][1] == i]
    hit = brute_hits([(i, docs[i]) for i in kept], [tuple(r)[:2] for r in read(spark, "benchmark").collect()], 10)
    kept = [r[0] for r in hit if not r[-1]]
    model = secrets.train(secrets.labelled_samples(spark))
    left = [(i, plain_redaction(docs[i], model)) for i in kept]
    assert any("[secret]" in t for _, t in left) or not any(base_spans(docs[i]) for i in kept)
    check_packing(left, corpus_pipeline.run(spark, SF).collect())


ODD = [(1, None, "en", None, 1, "k"), (None, "a b c d e f", None, "s", None, "k"), (None, "a b c d e f", None, "s", None, "k"), (2, "", "en", "s", 0, None), (3, "word " * 60000 + "password=abcdefgh", "en", "s", 5, "k"), (4, "x y z u v w q", "en", "s", 5, "k"), (5, "X y z u v w q", "en", "s", 5, "k")]
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, spans string"


@pytest.mark.parametrize("rows", [ODD, []])
def test_stages_on_odd_tables(spark, rows):
    docs = spark.createDataFrame(rows, SCHEMA)
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, SF)
        got = out.collect()
        assert out.columns == docs.columns or name == "pack"
        if name == "near_duplicates":
            assert sorted(r.doc_id or 0 for r in got) == ([0, 1, 2, 3, 4] if rows else [])  # of two equal rows without doc_id one stays
        if name == "secrets" and rows:
            by = {r.doc_id: r for r in got}
            assert by[3].text.endswith("word [secret]") and by[3].n_chars == len(by[3].text) and by[4].n_chars == 5 and by[1].text is None


def test_near_duplicates_decide_by_row(spark):
    a, b = "one two three four five six seven", "a text of its own that no other row repeats"
    rows = [(7, a), (7, a), (7, b), (None, a), (None, "yet another text that stands here alone"), (3, a), (3, None), (None, None)]
    docs = spark.createDataFrame([(i, t, "en", "s", 1, "k") for i, t in rows], SCHEMA).repartition(3)
    left = [(r.doc_id, r.text) for r in corpus_pipeline.near_duplicates(spark, docs, SF).collect()]
    assert sorted(left, key=str) == sorted([(3, a), (7, b), (None, rows[4][1]), (3, None), (None, None)], key=str)


def test_decontaminate_decides_by_row(spark):
    item = next(r.text for r in read(spark, "benchmark").orderBy("item_id").collect() if len(r.text.split()) >= 10)
    rows = [(None, f"so {item} it is"), (1, f"thus {item}"), (1, "a clean text"), (None, "another clean text"), (2, None), (3, f"thus {item}")]
    docs = spark.createDataFrame([(i, t, "en", "s", 1, "k") for i, t in rows], SCHEMA)
    left = [(r.doc_id, r.text) for r in corpus_pipeline.decontaminate(spark, docs, SF).collect()]
    assert sorted(left, key=str) == sorted([(1, "a clean text"), (None, "another clean text"), (2, None)], key=str)
