import random
import zlib

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F
from textweir.llm import encoder, packing, shared, tokenfile


def plain(name):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(encoder.tokenizer_path(name))
    t.encode_special_tokens = True
    return lambda x: t.encode(x or "", add_special_tokens=False).ids


def crc(ids):
    return zlib.crc32(np.array(ids, "<u4").tobytes())


TEXTS = [None, "", " ", "a", "Hello  world\n\n it's   fine\t x", "x  y   z 　q", "don't\r\nDON'T  ", "  lead", "<|endoftext|> a<|startoftext|>", "é ́x 12345 Éß漢字 \U0001f600!!​", "\x1c a \x0b\x0c b", "Th th TH th", "ỸİKΣ Σ aΣ", "é   b"]


@pytest.mark.parametrize(("name", "spaced"), [("word_bpe_49k.json", False), ("byte_bpe_50k.json", True)])
def test_encoder_equals_the_library(name, spaced):
    r = random.Random(3)
    parts = ["a", "Bc", "don't", "'s", " ", "  ", "\n", "\t", "é", "1", "23", "!!", " ", "漢", ".", "the"]
    texts = TEXTS + ["".join(r.choice(parts) for _ in range(r.randint(0, 60))) for _ in range(400)]
    e, want = encoder.Encoder(encoder.tokenizer_path(name), spaced), plain(name)
    for lot in (texts[:200], texts[100:], texts):
        ids, off = e.encode(pa.array(lot, pa.string()))
        assert [ids[off[i] : off[i + 1]].tolist() for i in range(len(lot))] == [want(x) for x in lot]


def test_encoder_on_table(spark):
    rows = [r.text for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()]
    for name, spaced in (("word_bpe_49k.json", False), ("byte_bpe_50k.json", True)):
        ids, off = encoder.Encoder(encoder.tokenizer_path(name), spaced).encode(pa.array(rows, pa.string()))
        assert [ids[off[i] : off[i + 1]].tolist() for i in range(len(rows))] == [plain(name)(x) for x in rows]


def check_packing(docs, rows, tiers=packing.TIERS):
    want = plain("word_bpe_49k.json")
    whole = {i: [*want(t), 1] for i, t in docs}
    by_doc, by_seq = {}, {}
    for r in rows:
        assert r.ids == whole[r.doc_id][r.start : r.start + r.length] and r.ids_crc32 == crc(r.ids) and r.doc_tokens == len(whole[r.doc_id])
        by_doc.setdefault(r.doc_id, []).append((r.start, r.length))
        by_seq.setdefault(r.sequence_id, []).append((r.offset, r.length, r.window))
    assert set(by_doc) == set(whole)
    for i, p in by_doc.items():
        at = 0
        for s, n in sorted(p):
            assert s == at and n > 0
            at += n
        assert at == len(whole[i])
    for p in by_seq.values():
        at = 0
        for s, n, _ in sorted(p):
            assert s == at
            at += n
        assert at == p[0][2] <= tiers[-1] and at & (at - 1) == 0


def test_packing(spark, monkeypatch):
    monkeypatch.setattr(packing, "FLUSH", 5000)
    r = random.Random(4)
    docs = [(i, " ".join(r.choice(["the", "cat", "sat", "xyzzy"]) for _ in range(r.choice([0, 3, 50, 300, 900, 2047, 5000])))) for i in range(60)]
    docs += [(100, None), (101, ""), (102, "x " * 30000)]
    df = spark.createDataFrame(docs, "doc_id long, text string").withColumn("start", F.lit("clash")).repartition(3)
    rows = packing.pack(df).collect()
    check_packing(docs, rows)
    tokens = {}
    for group, _, window in {(r.step_group, r.sequence_id, r.window) for r in rows}:
        tokens.setdefault(group >> 36, {}).setdefault(group, []).append(window)
    for groups in tokens.values():  # of each partition, all groups but the last are full
        sums = [sum(groups[g]) for g in sorted(groups)]
        assert sorted(groups) == list(range(min(groups), min(groups) + len(groups)))
        assert all(x == 16384 for x in sums[:-1]) and 0 < sums[-1] <= 16384


def test_packing_of_nothing_and_of_repeated_rows(spark):
    assert packing.pack(spark.createDataFrame([], "doc_id long, text string")).count() == 0
    rows = packing.pack(spark.createDataFrame([(None, "a"), (1, "a"), (1, "a")], "doc_id long, text string").coalesce(1)).collect()
    assert sorted((r.doc_id or 0, r.length) for r in rows if r.length) and sum(r.length for r in rows) == 6


def test_token_files(spark, tmp_path):
    docs = [(i * 7 % 101, t) for i, t in enumerate(TEXTS * 4)] + [(500, "word " * 40000)]
    path = f"file://{tmp_path}/t"
    tokenfile.write_tokens(spark.createDataFrame(docs, "doc_id long, text string").withColumn("ids", F.lit(1)).repartition(5), path)
    want, at = {}, 0
    for i, t in sorted(docs):
        ids = [*plain("byte_bpe_50k.json")(t), 2]
        want[i] = (at, len(ids), crc(ids))
        at += len(ids)
    got = {r.doc_id: (r.start, r.n_tokens, r.ids_crc32) for r in tokenfile.digests(spark, path).collect()}
    assert got == want
    one = tokenfile.read_tokens(spark, path, ["doc_id", "ids"], F.col("doc_id") == 7).collect()
    assert [r.ids[:-1] for r in one] == [plain("byte_bpe_50k.json")(dict(docs)[7])]
    meta = [pq.ParquetFile(p).metadata for p in (tmp_path / "t").glob("*.parquet")]
    cols = [m.row_group(g).column(c) for m in meta for g in range(m.num_row_groups) for c in range(m.num_columns)]
    assert all(c.has_offset_index for c in cols)
    assert any("DELTA_BINARY_PACKED" in c.encodings for c in cols if c.path_in_schema == "doc_id")
    assert any("RLE_DICTIONARY" in c.encodings for c in cols if c.path_in_schema.startswith("ids"))


def test_token_files_of_nothing_and_of_null_ids(spark):
    for rows in ([], [(None, "a"), (1, None), (1, None)]):
        path = shared.new_path(spark, "t")
        tokenfile.write_tokens(spark.createDataFrame(rows, "doc_id long, text string"), path)
        got = tokenfile.digests(spark, path).collect()
        assert sorted((r.doc_id or -1, r.start) for r in got) == ([(-1, 0), (1, 2), (1, 3)] if rows else [])
