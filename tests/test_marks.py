"""Two-channel sessions and watermarks against plain versions."""

import hashlib
import hmac
import math
import random
import re

import pytest
from pyspark.sql import functions as F
from textweir.operators import flow, session
from textweir.operators import watermark as W
from textweir.plans.engine import Engine


def plain_track(xs, decay=0.6):
    b = c = 0.0
    for x in xs:
        b, c = b * decay + x, max(0.0, c * decay + x)
    return b, c


@pytest.mark.parametrize("segment", [512, 3])
def test_tracks(spark, monkeypatch, segment):
    monkeypatch.setattr(session, "SEGMENT", segment)
    r = random.Random(segment)
    rows = [(s, t, r.choice([-0.5, 2.0, 7.5, 0.1, None]), r.choice(["attack", "contamination"]) if s % 3 else ["attack", "contamination"][s % 2]) for s in range(12) for t in range(r.randrange(1, 20))]
    got = {x.s: x for x in session.tracks(spark.createDataFrame(rows, "s int, t int, b double, ch string"), "s", "t", F.col("b"), F.col("ch"), 0.01).collect()}
    assert set(got) == {x[0] for x in rows}
    for s, x in got.items():
        own = [y for y in rows if y[0] == s]
        by = {c: [y[2] or 0.0 for y in own if y[3] == c] for c in session.CHANNELS}
        blocks = False
        for c, xs in by.items():
            b, cu = plain_track(xs)
            p = (0.01 / 0.99) * 2**b
            assert x[f"{c}_turns"] == len(xs) and abs(x[f"{c}_bits"] - b) < 1e-9 and abs(x[f"{c}_cusum"] - cu) < 1e-9
            blocks |= bool(xs) and p / (1 + p) >= 0.5
        both = all(by.values())
        assert x.ambiguous == both and x.blocks == blocks and x.channel == own[0][3] and x.quarantined == len(by["contamination" if own[0][3] == "attack" else "attack"])
        assert (x.posterior is None) == both and (x.verdict is None) == both and (x["shift"] is None) == both
        if not both:
            b, cu = plain_track(by["attack"] or by["contamination"])
            assert x.verdict == ("attack" if b >= math.log2(95) else "benign" if b <= math.log2(0.05 / 0.99) else "undecided") and x["shift"] == (cu >= math.log2(95))


def test_no_sessions(spark):
    assert session.tracks(spark.createDataFrame([], "s int, t int, b double, ch string"), "s", "t", F.col("b"), F.col("ch"), 0.01).count() == 0


# --- watermarks

BYTES = {c: b for b, c in enumerate(W.SELECTORS)}


def tag(text, key, issuer):
    if not key:
        return bytes(8)
    words = re.sub(r"[ \t\n\x0b\f\r]+", " ", text).strip(" \t\n\x0b\f\r\0")
    return hmac.new(key.encode(), f"{W.DOMAIN}\n{issuer}\n{words}".encode(), hashlib.sha256).digest()[:8]


def plain_mark(text, key=None, issuer=""):
    out, fence = [], False
    for i, part in enumerate(re.split(r"(\n[ \t]*\n)", text)):
        n = len(re.findall(r"(?m)^[ \t]*(?:```|~~~)", part)) if i % 2 == 0 else 0
        was = fence
        fence ^= n % 2 == 1
        if i % 2 or was or n or not part.strip() or re.search(r"(?m)^(?: {4}|\t)", part):
            out.append(part)
            continue
        body = re.sub(r"[ \t\n\x0b\f\r]+\Z", "", part)
        out.append(body + "".join(W.SELECTORS[b] for b in bytes([*W.MAGIC, W.VERSION]) + tag(part, key, issuer)) + part[len(body) :])
    return "".join(out)


TEXTS = [
    "One paragraph.", "First.\n\nSecond with  spaces \n \t\nThird.\n", "", "   \n\n  ", "Text\n\n```\ncode\n\nmore code\n```\n\nAfter the fence.", "    indented code\n\nplain", "~~~\na\n\nb\n~~~ \n\nc", "a\n\tb\n\nc", "é 😀\n\n\n\nend", "x" * 20_000,
    "unclosed\n\n```\ncode\n\nstill code",
]


def column(spark, c, texts=TEXTS):
    df = spark.createDataFrame(list(enumerate(texts)), "i int, text string")
    return [x.v for x in df.select("i", c.alias("v")).orderBy("i").collect()]


@pytest.mark.parametrize("key", [None, "secret", "k" * 100])
def test_mark_and_strip(spark, key):
    c = F.col("text")
    marked = column(spark, W.mark(c, key, F.lit("us")))
    assert marked == [plain_mark(t, key, "us") for t in TEXTS]
    assert column(spark, W.strip(c), marked) == TEXTS
    if key:
        assert column(spark, W.mark(c, key, F.lit("us")), marked) == marked


def test_verify_and_tamper(spark):
    c, us = F.col("text"), F.lit("us")
    (m,) = column(spark, W.mark(c, "key", us), [TEXTS[1]])
    own = "First. rewrapped\n\nSecond"
    first = m.split("\n\n")[0]
    cases = [m, first, m.replace("Second", "Third"), re.sub("  +", "\n", m), W.SELECTORS[5] + "plain", TEXTS[1], own, "", None]
    v = column(spark, W.verify(c, "key", us), cases)
    assert [(x.marked, x.authentic, round(x.coverage, 3), x.segments) for x in v[:7]] == [(True, True, 1.0, 3), (True, True, 1.0, 1), (True, True, 0.667, 3), (True, True, 1.0, 3), (False, False, 0.0, 1), (False, False, 0.0, 3), (False, False, 0.0, 2)]
    assert v[7].segments == 0 and v[7].coverage == 0
    assert not column(spark, W.verify(c, "key", F.lit("them")), [m])[0].authentic and not column(spark, W.verify(c, "other", us), [m])[0].authentic
    assert column(spark, W.verify(c), [m])[0].marked


def test_watermark_rail(spark):
    df = spark.createDataFrame([(0, "An answer."), (1, "    code only"), (2, None)], "i int, text string")
    seen = Engine([W.watermark("k", "us")]).run(df, side="output").orderBy("i").select("verdict.*").collect()
    assert seen[0].status == "modified" and seen[0].categories == ["watermark", "watermark:signed"] and seen[0].content == plain_mark("An answer.", "k", "us")
    assert seen[1].status == "passed" and seen[2].status == "passed"
    assert Engine([W.watermark()]).run(df, side="output").first().verdict.categories == ["watermark", "watermark:unsigned"]


# --- labels


def test_flow_lattice_and_audit(spark):
    def made(provenance, integrity, sinks):
        return F.struct(F.lit(provenance).alias("p"), F.lit(integrity).alias("i"), (F.lit(None).cast("array<string>") if sinks is None else F.lit(sinks)).alias("s"))

    cells = [(["user"], None, None), (["user"], None, ["web", "file"]), (["data"], None, ["file"]), (["system"], [], None)]
    df = spark.createDataFrame([(i, j) for i in range(4) for j in range(4)], "i int, j int")

    def pick(k):
        return F.coalesce(*[F.when(F.col(k) == n, flow.label(F.lit(p), None if q is None else F.lit(q).cast("array<string>"), flow.words(s), F.array(F.lit("t")))) for n, (p, q, s) in enumerate(cells)])

    got = {(x.i, x.j): x.m for x in df.select("i", "j", flow.mixed(pick("i"), pick("j")).alias("m")).collect()}
    for (i, j), m in got.items():
        prov = list(dict.fromkeys(cells[i][0] + cells[j][0]))
        own = [(q if q is not None else (p if "data" not in p else [])) for p, q, _ in (cells[i], cells[j])]
        sinks = [s for _, _, s in (cells[i], cells[j]) if s is not None]
        assert m.provenance == prov and m.integrity == ([] if not all(own) else list(dict.fromkeys(own[0] + own[1])))
        assert m.sinks == (None if not sinks else [x for x in sinks[0] if all(x in s for s in sinks)]) and m.capabilities == ([] if "data" in prov else ["t"])
    rules = {"approve": flow.Rule(("system",), integrity=("system",)), "open": flow.Rule(("user",), sinks=("web",))}
    t = df.where("i = 2 and j < 3").select("j", pick("i").alias("label"), flow.label(F.array(F.when(F.col("j") == 1, "user").otherwise("system"))).alias("actor"), F.when(F.col("j") == 2, "erase").when(F.col("j") == 1, "open").otherwise("approve").alias("operation"))
    done = flow.operate(t, rules)
    rows = {x.j: x for x in done.collect()}
    assert rows[0].after.integrity == ["system"] and rows[0].after.provenance == ["data", "system"] and rows[1].after.sinks == ["web"] and rows[2].denied == "not_granted" and rows[2].after == rows[2].label
    a = flow.audit(done, ["j"], rules).collect()
    assert {(x.j, x.type) for x in a} == {(0, "endorsement"), (1, "declassification")} and len({x.digest for x in a}) == 2
    assert [x.denied for x in flow.operate(t.withColumn("operation", F.lit("approve")), rules).orderBy("j").collect()] == [None, "unauthorized", None]
    with pytest.raises(ValueError, match="either"):
        flow.Rule(("user",))


def test_one_digest_a_paragraph(spark):
    """The digest stood within a lambda over the bytes of a mark, and was computed for each of them."""
    said = W.payload(F.col("text"), "key", F.lit("me"))._jc.toString()
    assert "sha2(" in said and "substring(sha2(" not in said
