"""Quality rules by host: rule failures of documents are counted for each host, the rates are shrunk, and hosts' verdicts go back to documents.

A document is measured once (features), and rules turn its counts into failures. For each host and rule
the failure rate is shrunk toward a beta prior that all hosts together give (method of moments with the
hosts' sizes as weights), so that a host of three documents is not judged by them alone. A failure of
one of the softer rules counts against a document only where the shrunk rate says that it is the host's
habit; where nearly all of a host's documents fail a hard rule, the rest go with them. A document that
fails no rule at an ordinary host always stays.

Null text has no words: it fails the rule on length. Rows without a host are not pooled and meet the hard
rules only. Repeated rows and null ids are rows like others. Extra columns pass through judge(); columns
that clash with a result's name give way to it. An empty table gives no rows. A host may hold any share
of all rows: its counts are summed before the shuffle, and its verdict is broadcast to its rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import shared

#: Characters that count as symbols; white space between words; words of a window.
SYMBOLS, WHITE, WINDOW = "#*$%&|<>", " \t\n\x0b\x0c\r", 5
COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines")
#: Texts are measured together, up to so many bytes at a time.
CHUNK = 8 << 20

#: Rules that reject a document by themselves, and rules that need the host's habit, in whole numbers; as SQL, so that workers can import them.
HARD = {"few_words": "n_words < 10", "repeats": "100 * n_repeat_words > 20 * n_words"}
SOFT = {"word_length": "word_chars < 3 * n_words OR word_chars > 10 * n_words", "symbols": "10 * n_symbols > n_words", "dup_lines": "10 * n_dup_lines > 3 * n_lines"}
c = F.col


def repeated(words: list[bytes], lengths: np.ndarray) -> np.ndarray:
    """For each text, of lengths words, how many of its words lie in a WINDOW that it holds twice or more.

    Windows are compared exactly: word numbers are joined to ranks of longer and longer runs, and only runs
    that a text holds twice are looked at further.
    """
    n = len(words)
    if n < WINDOW:
        return np.zeros(len(lengths), np.int64)
    code, _ = pd.factorize(np.array(words, dtype=object))
    doc = np.repeat(np.arange(len(lengths)), lengths)
    at = np.flatnonzero(doc[: n - WINDOW + 1] == doc[WINDOW - 1 :])
    run = doc[at]
    for k in range(WINDOW):
        run, _ = pd.factorize(run.astype(np.int64) * (int(code.max()) + 1) + code[at + k])
        twice = np.bincount(run, minlength=1)[run] > 1
        at, run = at[twice], run[twice]
    edge = np.zeros(n + 1, np.int64)
    np.add.at(edge, at, 1)
    np.add.at(edge, at + WINDOW, -1)
    return np.bincount(doc, weights=np.cumsum(edge[:n]) > 0, minlength=len(lengths)).astype(np.int64)


def measured(texts: list[str]) -> list[tuple]:
    raw = [t.encode() for t in texts]
    words = [b.split() for b in raw]  # bytes split at ASCII white space only
    again = repeated([w for own in words for w in own], np.array([len(w) for w in words], np.int64))
    out = []
    for t, b, w, r in zip(texts, raw, words, again, strict=True):
        lines = [x for x in b.split(b"\n") if x.strip()]
        out.append((len(w), len(t) - sum(map(t.count, WHITE)), sum(map(t.count, SYMBOLS)), len(lines) - len(set(lines)), int(r), len(lines)))
    return out


def measures(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
    for s in batches:
        out, some, size = [], [], 0
        for t in s:
            some.append(t or "")
            size += len(some[-1])
            if size > CHUNK:
                out += measured(some)
                some, size = [], 0
        yield pd.DataFrame([*out, *measured(some)], columns=list(COUNTS), dtype="int64")


def features(docs: DataFrame) -> DataFrame:
    """docs without text, with the counts and a failure flag fails_<rule> for each rule."""
    shared.small_batches(docs.sparkSession)
    flags = {f"fails_{k}": F.expr(p) for k, p in (HARD | SOFT).items()}
    own = [x for x in docs.columns if x not in {*COUNTS, *flags, "text", "_m"}]
    measure = F.pandas_udf(measures, ", ".join(f"{k} long" for k in COUNTS))
    return docs.withColumn("_m", measure("text")).select(*own, *[c("_m")[k].alias(k) for k in COUNTS]).withColumns(flags)


def host_of(source: Column) -> Column:
    """The host of an address, else the source itself, in lower case; null and blank have none."""
    plain = F.lower(F.trim(source))
    return F.nullif(F.coalesce(F.lower(F.try_parse_url(F.trim(source), F.lit("HOST"))), plain), F.lit(""))


def prior(hosts: DataFrame, rule: str) -> dict[str, Column]:
    """Aggregates from which a rule's beta prior follows; hosts has n and the failures f_<rule>."""
    f, n = c(f"f_{rule}").cast("double"), c("n").cast("double")
    return {f"{rule}_f": F.sum(f), f"{rule}_s": F.sum(f * f / n)}


def fitted(total: dict, rule: str) -> tuple[float, float]:
    """(alpha, beta) from the sums: the share of variance between hosts beyond what their sizes explain."""
    n, k = total["n"], total["hosts"]
    p = total[f"{rule}_f"] / n
    if not 0 < p < 1:
        return p * n, (1 - p) * n
    within = k - 1
    spare = n - total["nn"] / n - within
    rho = (total[f"{rule}_s"] / p - p * n) / (1 - p) - within
    rho = min(max(rho / spare, 1 / (n + 1)), 0.5) if spare > 0 else 0.5
    return p * (1 / rho - 1), (1 - p) * (1 / rho - 1)


def hosts(seen: DataFrame) -> DataFrame:
    """host, n, failures f_<rule>, shrunk rates rate_<rule> and that of any hard failure, rate_hard; one row a host."""
    rules = [*HARD, *SOFT]
    fails = {r: c(f"fails_{r}") for r in rules} | {"hard": F.greatest(*[c(f"fails_{r}") for r in HARD])}
    by = shared.written(seen.where("host is not null").groupBy("host").agg(F.count("*").alias("n"), *[F.sum(p.cast("long")).alias(f"f_{r}") for r, p in fails.items()]), "hosts")
    n = c("n").cast("double")
    sums = {"n": F.sum(n), "nn": F.sum(n * n), "hosts": F.count("*")}
    for r in fails:
        sums |= prior(by, r)
    total = by.agg(*[v.alias(k) for k, v in sums.items()]).first().asDict()
    rates = {}
    for r in fails:
        a, b = fitted(total, r) if total["hosts"] else (1.0, 1.0)
        rates[f"rate_{r}"] = (c(f"f_{r}") + a) / (n + (a + b))
    return by.withColumns(rates)


def judge(docs: DataFrame, source: str = "source", habit: float = 0.2, lost: float = 0.9) -> DataFrame:
    """docs without text, with counts, failures, host, rates of its host, base_failed, verdict and kept.

    habit: shrunk rate from which a host's soft failures count; lost: rate of hard failures from which none
    of a host's documents stay. verdict is the host's: ordinary, habit or lost; null without a host.
    """
    own = [x for x in docs.columns if x != "text"]
    packed = docs.select(F.struct(*[F.col(f"`{x}`") for x in own]).alias("_own"), "text", host_of(c(f"`{source}`")).alias("host"))  # so that no name of theirs meets one of ours
    seen = shared.written(features(packed), "features")
    by = hosts(seen)
    shrunk = [x for x in by.columns if x.startswith("rate_")]
    verdict = F.when(c("rate_hard") >= lost, "lost").when(F.greatest(*[c(f"rate_{r}") for r in SOFT]) >= habit, "habit").otherwise("ordinary")
    by = shared.written(by.select("host", "n", *shrunk, verdict.alias("verdict")), "rates")
    placed = shared.by_class(seen.where("host is not null"), by, ["host"]).drop("n").unionByName(seen.where("host is null"), allowMissingColumns=True)
    failed = F.greatest(*[c(f"fails_{r}") for r in HARD])
    soft = F.greatest(*[c(f"fails_{r}") & (c(f"rate_{r}") >= habit) for r in SOFT])
    placed = placed.withColumn("base_failed", failed).withColumn("kept", ~failed & ~F.coalesce(soft, F.lit(False)) & (F.coalesce("verdict", F.lit("ordinary")) != "lost"))
    ours = [x for x in placed.columns if x != "_own"]
    return placed.select(*[c("_own")[x].alias(x) for x in own if x not in ours], *ours)
