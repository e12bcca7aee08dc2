"""Host rules, conversation repair and collocations against plain versions and on odd rows."""

import collections
import hashlib
import random
import re
import types
import zlib

import duckdb
import numpy as np
import pytest
from textweir.llm import collocations, hostrules, queries_corpus, shared, turnrepair

WHITE = r"\x20\x09-\x0D"


# --- host rules


def counts(text):
    w = re.findall(f"[^{WHITE}]+", text or "")
    win = collections.Counter(tuple(w[i : i + 5]) for i in range(len(w) - 4))
    hit = {i + k for i in range(len(w) - 4) if win[tuple(w[i : i + 5])] > 1 for k in range(5)}
    lines = [x for x in (text or "").split("\n") if re.search(f"[^{WHITE}]", x)]
    return len(w), sum(map(len, w)), sum(x in "#*$%&|<>" for x in text or ""), len(lines) - len(set(lines)), len(hit)


ODD = [None, "", " \n\t", "a", "a b c d e", "a b c d e a b c d e", "x y  z 😀é", "l\nl\n l\nl\n", "a a a a a a a", "#*$ %&|<> \x1c\x85 w", "one two three four five " * 3000]


def test_counts(spark):
    r = random.Random(5)
    texts = ODD + ["".join(r.choice(["a ", "b ", "ab ", "\n", "# ", "é"]) for _ in range(r.randrange(80))) for _ in range(60)]
    df = spark.createDataFrame([(i, t, "s", 7) for i, t in enumerate(texts)], "doc_id long, text string, source string, n_words int")
    got = {x.doc_id: (x.n_words, x.word_chars, x.n_symbols, x.n_dup_lines, x.n_repeat_words) for x in hostrules.features(df).collect()}
    assert got == {i: counts(t) for i, t in enumerate(texts)}


def good(i):
    return " ".join(f"word{i}x{k}" for k in range(30))


def test_hosts_verdicts(spark):
    """A soft failure counts at a host of that habit only; one document does not make a habit; a lost host takes all with it."""
    marked = " ".join(f"##word{k}" for k in range(30))
    rows = [(i, good(i), f"h{i % 9}") for i in range(900)] + [(1000, marked, "h1"), (1001, marked, "tiny"), (1002, marked, None), (1003, marked, "")]
    rows += [(2000 + i, marked if i % 2 else good(i), "HTTPS://Noise.example/a") for i in range(200)] + [(3000 + i, "a b" if i else good(1), "junk") for i in range(300)]
    clash = {k: "x" for k in ("kept", "hot", "n", "host", "_m", "_own", "verdict", "rate_hard", "fails_symbols", "f_symbols", "n_words", "a.b")}
    df = spark.createDataFrame([(*r, *clash.values()) for r in rows], "doc_id long, text string, source string, " + ", ".join(f"`{k}` string" for k in clash))
    got = {x.doc_id: x for x in hostrules.judge(df).collect()}
    assert len(got) == len(rows) and all(got[i].kept for i in range(900)) and all(got[i].kept for i in (1000, 1002, 1003))
    assert got[2000].host == "noise.example" and got[2000].verdict == "habit" and got[2000].kept and not got[2001].kept and not got[2001].base_failed
    assert got[3000].verdict == "lost" and not got[3000].kept and not got[3000].base_failed
    assert got[1002].host is None and got[1002].verdict is None and got[1000].verdict == "ordinary"
    # one failing document of a host of one is drawn toward the common rate
    assert got[1001].rate_symbols < 1


def test_prior_by_hand():
    """Two hosts of 100 with rates 0.1 and 0.3: mean 0.2, between-host share of the variance by moments."""
    total = {"n": 200.0, "nn": 20000.0, "hosts": 2, "x_f": 40.0, "x_s": 100.0 / 100 + 900.0 / 100}
    a, b = hostrules.fitted(total, "x")
    rho = ((10 - 0.04 * 200) / 0.16 - 1) / (200 - 100 - 1)
    assert abs(a / (a + b) - 0.2) < 1e-12 and abs(1 / (a + b + 1) - rho) < 1e-12
    assert hostrules.fitted(total | {"x_f": 0.0, "x_s": 0.0}, "x") == (0.0, 200.0)


def test_hosts_empty_and_hot(spark, monkeypatch):
    none = spark.createDataFrame([], "doc_id long, text string, source string")
    assert hostrules.judge(none).count() == 0
    monkeypatch.setattr(hostrules.shared, "FEW", 2)
    df = spark.createDataFrame([(None if i % 3 else i, good(i % 2), "hot" if i % 3 else f"h{i}") for i in range(60)], "doc_id long, text string, source string")
    assert hostrules.judge(df).where("kept").count() == 60


# --- conversation repair


def plan(rows):
    """(faults, illegal, cost, audit, repaired) of (role, text) rows in order, from the end backwards."""
    seen, marks = set(), []
    for role, text in rows:
        last = re.sub(f"[{WHITE}]+$", "", text)
        f = "blank" if not re.search(f"[^{WHITE}]", text) else "duplicate" if (role, text) in seen else "truncated" if last[-1] not in ".!?" else ""
        marks.append(f)
        seen.add((role, text))
    go = {0: {"s": 1, "u": 2}, 1: {"u": 2}, 2: {"a": 3}, 3: {"u": 2}}
    n = len(rows)
    best = {}
    for i in range(n, -1, -1):
        for left in range(3):  # insertions still allowed here
            for st in range(4):
                opts = [(0, "", ())] if i == n and st in (0, 3) else []
                if left:
                    want = "a" if st == 2 else "u"
                    if (i, left - 1, go[st][want]) in best:
                        c, a, out = best[i, left - 1, go[st][want]]
                        opts.append((c + 2, "I" + a, (({"u": "user", "a": "assistant"}[want], ""), *out)))
                if i < n:
                    opts += [(c + 3, "D" + a, out) for c, a, out in [best[i + 1, 2, st]]]
                    if marks[i] not in ("blank", "duplicate"):
                        late = marks[i] == "truncated"
                        ini = rows[i][0][:1]
                        if ini in go[st]:
                            c, a, out = best[i + 1, 2, go[st][ini]]
                            opts.append((c + late, "K" + a, (rows[i], *out)))
                        for w, name in (("u", "user"), ("a", "assistant")):
                            if w in go[st]:
                                c, a, out = best[i + 1, 2, go[st][w]]
                                opts.append((c + late + 2, "R" + a, ((name, rows[i][1]), *out)))
                best[i, left, st] = min(opts, key=lambda x: x[:2]) if opts else (1 << 40, "~", ())
    illegal = sum(a[0][:1] + b[0][:1] not in ("su", "ua", "au") for a, b in zip(rows, rows[1:], strict=False))
    return marks, illegal, *best[0, 2, 0]


def conversations(seed, n, longest):
    r = random.Random(seed)
    roles = ["user", "assistant", "user", "assistant", "system", "tool", "", "User", None]
    said = ["Yes.", "no", "What? ", "", " ", "One! two", None, "End.\n", "a.b", " "]
    return [(i, t if r.random() > 0.1 else None, r.choice(roles), r.choice(said) if r.random() < 0.4 else f"t{r.random()}.") for i in [*range(n), None] for t in range(r.randrange(1, longest))]


@pytest.mark.parametrize("segment,seed,longest", [(512, 1, 7), (3, 2, 16)])
def test_repair(spark, monkeypatch, segment, seed, longest):
    monkeypatch.setattr(turnrepair, "SEGMENT", segment)
    rows = conversations(seed, 40, longest)
    df = spark.createDataFrame([(*x, 1) for x in rows], "conv_id long, turn long, role string, text string, pos int")
    found, after = turnrepair.repair(df)
    found, sha = {x.conv_id: x for x in found.collect()}, {x.conv_id: x.sha256 for x in turnrepair.digests(after).collect()}
    by = collections.defaultdict(list)
    for i, t, role, text in rows:
        by[i].append((-1 if t is None else t, role if role is not None else " ", text if text is not None else " "))
    assert set(found) == set(by)
    for i, own in by.items():
        own.sort()
        marks, illegal, cost, audit, out = plan([x[1:] for x in own])
        turns = [t for t, *_ in own if t >= 0]
        gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
        got = found[i]
        assert (got.gaps, got.blank, got.duplicate, got.truncated, got.illegal, got.cost, got.audit) == (gaps, *[marks.count(f) for f in ("blank", "duplicate", "truncated")], illegal, cost, audit)
        lines = "\n".join(f"{a}:{b}" for a, b in out)
        assert sha.get(i, hashlib.sha256(b"").hexdigest()) == hashlib.sha256(lines.encode()).hexdigest()
        assert re.fullmatch("(s?(ua)+)?", "".join(a[:1] for a, _ in out))


def test_damage_and_dropped_conversations(spark, tmp_path):
    keys = [i for i in range(2000) if zlib.crc32(f"{i}:0".encode()) % 20 == 0][:3]
    rows = [(i, 0, "user", "Hello.") for i in keys] + [(None, None, None, None), (5, 0, "user", "Hi. €"), (5, 1, "assistant", "x" * 100_000 + ".")]
    spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").write.parquet(f"{tmp_path}/conversations.parquet")
    got = {x.conv_id: x for x in queries_corpus.op12_turn_repair(spark, str(tmp_path)).collect()}
    assert set(got) == {*keys, None, 5}
    assert all((got[i].audit, got[i].cost, got[i].repaired_sha256) == ("", 0, hashlib.sha256(b"").hexdigest()) for i in keys)
    con = duckdb.connect()
    con.sql(f"create view conversations as select * from '{tmp_path}/conversations.parquet/*.parquet'")
    sql = con.sql(queries_corpus.OP12_SQL)
    assert {x[sql.columns.index("conv_id")]: tuple(x[sql.columns.index(c)] for c in ("gaps", "cost", "audit", "repaired_sha256")) for x in sql.fetchall()} == {i: (x.gaps, x.cost, x.audit, x.repaired_sha256) for i, x in got.items()}


def test_no_conversations(spark):
    found, after = turnrepair.repair(spark.createDataFrame([], "conv_id string, turn int, role string, text string"))
    assert found.count() == 0 and after.count() == 0 and turnrepair.digests(after).count() == 0


# --- collocations


def mined(rows, least, longest=4):
    f, n = collections.Counter(), collections.Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        low = "".join(chr(ord(x) + 32) if "A" <= x <= "Z" else x for x in text or "")
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", low):
            w = re.findall(r"[^\x20\x09]+", piece)
            n[lang] += len(w)
            f.update((lang, tuple(w[i : i + k])) for k in range(1, longest + 1) for i in range(len(w) - k + 1))
    out = {}
    for (lang, p), a in f.items():
        if len(p) > 1 and a >= least:
            score, _, lf, rf = min((2000000 * a // (f[lang, p[:k]] + f[lang, p[k:]]), k, f[lang, p[:k]], f[lang, p[k:]]) for k in range(1, len(p)))
            if not any(k == lang and len(q) > len(p) and b >= least and 100 * b >= 80 * a and any(q[i : i + len(p)] == p for i in range(len(q) - len(p) + 1)) for (k, q), b in f.items()):
                out[lang, " ".join(p)] = (a, lf, rf, score)
    return out, dict(n)


def texts(seed):
    r = random.Random(seed)
    words = ["the", "The", "of", "new", "york", "a", "É", "é", "x y", "z\x00", "to", "be"]
    return [(r.choice(["en", "fr", None, "und"]), "".join(r.choice(words) + r.choice([" ", " ", "  ", "\t", " ", ". ", "\n", " ,"]) for _ in range(r.randrange(60)))) for _ in range(60)] + [("en", "new york city hall " * 9)] * 3 + [("fr", None), ("de", ""), ("en", "a a a a a a a")]


@pytest.mark.parametrize("chunk", [12 << 20, 300])
def test_collocations(spark, monkeypatch, chunk):
    monkeypatch.setattr(collocations, "CHUNK", chunk)
    rows = texts(3)
    df = spark.createDataFrame([(*x, 1, "x") for x in rows], "lang string, text string, gram int, phrase string")
    found, totals = collocations.mine(df, least=4)
    want, n = mined(rows, 4)
    got = {(x.lang, x.phrase): (x.a, x.l, x.r, int(x.score)) for x in found.collect()}
    assert got == want and len(want) > 50
    assert {x.lang: x.n for x in totals.where("n > 0").collect()} == {k: v for k, v in n.items() if v}
    top = collections.defaultdict(list)
    for x in sorted(collocations.ranked(found, 7).collect(), key=lambda x: (x.lang, x["rank"])):
        top[x.lang].append(x.phrase)
    assert top == {lang: [p for (_, p), v in sorted(((k, v) for k, v in want.items() if k[0] == lang), key=lambda e: (-e[1][3], -e[1][0], e[0][1].encode()))[:7]] for lang in {k[0] for k in want}}


def test_full_table_passes_and_results_stay(spark, monkeypatch):
    """A bit table that is full rejects nothing, and the results are the same."""
    rows = texts(4)
    full = collocations.Table(1, np.full(collocations.BLOCK_BITS // 8, 255, np.uint8))
    monkeypatch.setattr(collocations, "table_of", lambda level: full)
    found, _ = collocations.mine(spark.createDataFrame(rows, "lang string, text string"), least=3, longest=3)
    assert {(x.lang, x.phrase): (x.a, x.l, x.r, int(x.score)) for x in found.collect()} == mined(rows, 3, 3)[0]


def test_counts_beyond_64_bits(spark):
    big = 9 * 10**18
    df = spark.createDataFrame([("en", "a", 1, big), ("en", "b", 1, big - 7), ("en", "a b", 2, big - 9)], "lang string, gram string, k int, f long")
    x = collocations.cuts(df).first()
    assert int(x.score) == 2000000 * (big - 9) // (2 * big - 7)


def test_no_texts(spark):
    found, totals = collocations.mine(spark.createDataFrame([], "lang string, text string"))
    assert found.count() == 0 and totals.where("n > 0").count() == 0


# --- the shared folder


@pytest.mark.parametrize("master,fine", [("local", True), ("local[4]", True), ("local-cluster[2,1,1024]", False), ("yarn", False), ("spark://host:7077", False)])
def test_no_folder_of_one_machine_on_a_cluster(master, fine):
    s = types.SimpleNamespace(conf={}, sparkContext=types.SimpleNamespace(master=master))
    if fine:
        assert shared.shared_dir(s)
    else:
        with pytest.raises(ValueError, match="spark.checkpoint.dir"):
            shared.shared_dir(s)
    s.conf["spark.checkpoint.dir"] = "hdfs://x/y/"
    assert shared.shared_dir(s) == "hdfs://x/y"
