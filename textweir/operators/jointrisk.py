"""A joint risk model of several readers: fitted on labelled cases, then applied to rows as a projection.

Fitting: a logistic model over reader scores, products of scores and offsets of context, by damped diagonal
Newton steps with a ridge; each step is one pass that sums gradient and curvature over distinct design rows. Platt
calibration on the calibration role, the composition of threats, the support of the scores and the smallest
threshold that keeps the risk follow. A model is a few dozen numbers.

Rows that the model cannot speak on abstain, with a reason: a missing score, an unsupported context, a score out of
range, a vector far from the training role's, readers that disagree more than ever in calibration, or an expired
calibration. Nulls in scores count as missing. A certain action needs both ends of the interval on one side.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass, field
from datetime import datetime, timezone

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions.stats import normal_quantile
from .assess import action

EPSILON = 1e-12


@dataclass(frozen=True)
class Scenario:
    """Beta counts of attacks and others, and Dirichlet counts of threat families, where the model is used."""

    alpha: float
    beta: float
    threats: dict[str, float]

    @property
    def prior(self) -> float:
        return self.alpha / (self.alpha + self.beta)

    @property
    def mixture(self) -> dict[str, float]:
        total = sum(self.threats.values())
        return {k: v / total for k, v in self.threats.items()}


@dataclass(frozen=True)
class JointRisk:
    features: list[str]
    interactions: list[tuple[str, str]]
    contexts: dict[str, list[str]]
    parameters: dict[str, float]
    covariance: dict[str, float]
    prevalence: float
    calibration: dict[str, float]
    composition: dict[str, float]
    offsets: dict[str, float]
    threat_covariance: dict[str, float]
    means: dict[str, float]
    scales: dict[str, float]
    farthest: float
    disagreements: dict[tuple[str, str], float]
    ranges: dict[str, tuple[float, float]]
    supported: dict[str, list[str]]
    valid_until: datetime | None = None
    steps: int = field(default=0, compare=False)


def terms_of(features: list[str], interactions: list[tuple[str, str]], contexts: dict[str, list[str]]) -> list[str]:
    return ["intercept", *features, *[f"{a}*{b}" for a, b in interactions], *[f"{k}:{v}" for k, own in contexts.items() for v in own]]


def design(features: list[str], interactions: list[tuple[str, str]], contexts: dict[str, list[str]]) -> Column:
    """array<double> of a row's terms, in the order of terms_of()."""
    x = [F.lit(1.0), *[F.col(f"`{f}`").cast("double") for f in features]]
    x += [F.col(f"`{a}`").cast("double") * F.col(f"`{b}`").cast("double") for a, b in interactions]
    return F.array(*x, *[F.coalesce((F.col(k).cast("string") == v).cast("double"), F.lit(0.0)) for k, own in contexts.items() for v in own])


def sums(rows: DataFrame, parameters: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(gradient, curvature) without ridge over rows (x array<double>, y double, n long): one pass, a few numbers from each task."""

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        g, c = np.zeros(len(parameters)), np.zeros(len(parameters))
        for b in batches:
            x = b.column(0).flatten().to_numpy(zero_copy_only=False).reshape(-1, len(parameters))
            y, n = b.column(1).to_numpy(), b.column(2).to_numpy()
            with np.errstate(over="ignore"):
                p = 1 / (1 + np.exp(-(x @ parameters)))
            g += (n * (y - p)) @ x
            c += (n * p * (1 - p)) @ (x * x)
        yield pa.record_batch([pa.array([g.tolist()]), pa.array([c.tolist()])], ["g", "c"])

    parts = rows.mapInArrow(partial, "g array<double>, c array<double>").toArrow()  # one row of a few numbers a task
    return tuple(np.array(parts.column(k).to_pylist()).reshape(-1, len(parameters)).sum(axis=0) for k in (0, 1))


def newton(rows: DataFrame, start: list[float], centre: list[float], ridge: list[float], iterations: int, stop: float, low: list[float] | None = None, high: list[float] | None = None) -> tuple[np.ndarray, np.ndarray, int]:
    """(parameters, curvature before the last step, steps): half steps by the diagonal until the largest is under `stop`."""
    b, c, k = np.array(start, float), np.array(ridge, float), 0
    for k in range(1, iterations + 1):
        g, c = sums(rows, b)
        g, c = g - np.array(ridge) * (b - np.array(centre)), c + np.array(ridge)
        step = 0.5 * g / np.maximum(c, EPSILON)
        b = b + step
        if low is not None:
            b = np.clip(b, low, high)
        if np.abs(step).max() < stop:
            break
    return b, c, k


def grouped(rows: DataFrame, x: Column) -> DataFrame:
    """Distinct design rows with their number: steps then pass over these."""
    return rows.select(x.alias("x"), F.col("attack").cast("double").alias("y")).groupBy("x", "y").agg(F.count(F.lit(1)).alias("n")).select("x", "y", "n")


def checked(rows: DataFrame, features: list[str]) -> None:
    """Raises ValueError where cases cannot train a model."""
    n = rows.groupBy("case_id").count().where("count > 1").limit(1).count()
    if n:
        raise ValueError("case ids must be unique")
    if rows.where(F.greatest(*[F.col(f"`{f}`").isNull() | F.isnan(F.col(f"`{f}`").cast("double")) for f in features], F.lit(False))).limit(1).count():
        raise ValueError("a case has an invalid score")
    torn = rows.groupBy("grp").agg(F.countDistinct("role").alias("n")).where("n > 1").limit(1).collect()
    if torn:
        raise ValueError(f"group {torn[0].grp} crosses roles")
    both = {r.role: r.n for r in rows.groupBy("role").agg(F.countDistinct("attack").alias("n")).collect()}
    for role in ("train", "calibration", "threshold", "test"):
        if both.get(role, 0) != 2:
            raise ValueError(f"role {role} needs both labels")
    families = rows.where("attack").groupBy("family").agg(F.max((F.col("role") == "train").cast("int")).alias("known"))
    if families.where("family is null or known = 0").limit(1).count():
        raise ValueError("attacks need threat families that training has")


def fit(rows: DataFrame, features: list[str], interactions: list[tuple[str, str]] = (), contexts: tuple[str, ...] = (), disagreements: list[tuple[str, str]] = (), iterations: int = 100, ridge: float = 4.0, valid_until: datetime | None = None) -> JointRisk:
    """The model of rows (case_id, grp, role, attack, family, context columns, score columns)."""
    interactions = sorted({tuple(p) for p in interactions})
    checked(rows, features)
    train, cal = rows.where("role = 'train'"), rows.where("role = 'calibration'")
    support = rows.where(F.col("role").isin("train", "calibration"))
    levels = {k: sorted(r[0] for r in train.select(F.col(k).cast("string")).distinct().collect())[1:] for k in contexts}  # contexts have few values
    terms = terms_of(features, interactions, levels)
    x = design(features, interactions, levels)
    data = grouped(train, x).persist()
    try:
        n, attacks = train.agg(F.count(F.lit(1)), F.sum(F.col("attack").cast("long"))).first()
        p = attacks / n
        pull = [0.0, *[ridge] * (len(terms) - 1)]
        b, _, steps = newton(data, [math.log(p / (1 - p)), *[0.0] * (len(terms) - 1)], [0.0] * len(terms), pull, iterations, 1e-9)
        _, c = sums(data, b)
        curvature = c + np.array(pull)
    finally:
        data.unpersist()
    parameters = dict(zip(terms, b.tolist(), strict=True))
    eta = F.aggregate(F.zip_with(x, F.array(*map(F.lit, b.tolist())), lambda u, v: u * v), F.lit(0.0), lambda s, v: s + v)
    logits = grouped(cal, F.array(F.lit(1.0), eta)).persist()
    try:
        ab, cc, _ = newton(logits, [0.0, 1.0], [0.0, 1.0], [0.0, ridge], iterations, 1e-13, [-math.inf, 1e-6], [math.inf, 10.0])
    finally:
        logits.unpersist()
    calibration = {"intercept": float(ab[0]), "slope": float(ab[1]), "intercept_variance": 1 / max(cc[0], EPSILON), "slope_variance": 1 / max(cc[1], EPSILON)}
    fam = train.where("attack").select("family", eta.alias("eta")).groupBy("family").agg(F.count(F.lit(1)).alias("n"), F.avg("eta").alias("m"), F.var_samp("eta").alias("v")).collect()
    overall = sum(r.n * r.m for r in fam) / attacks
    cols = [F.col(f"`{f}`").cast("double") for f in features]
    s = train.agg(*[F.avg(q).alias(f"m{i}") for i, q in enumerate(cols)], *[F.stddev_samp(q).alias(f"s{i}") for i, q in enumerate(cols)]).first()
    means = {f: s[f"m{i}"] for i, f in enumerate(features)}
    scales = {f: s[f"s{i}"] if s[f"s{i}"] is not None and s[f"s{i}"] > EPSILON else 1.0 for i, f in enumerate(features)}
    pairs = sorted({tuple(sorted(p)) for p in disagreements})
    far = cal.agg(F.max(distance(means, scales)).alias("d"), *[F.max(apart(means, scales, *p)).alias(f"p{i}") for i, p in enumerate(pairs)]).first()
    span = support.agg(*[g(q).alias(f"{w}{i}") for i, q in enumerate(cols) for w, g in (("low", F.min), ("high", F.max))]).first()
    return JointRisk(
        features=list(features), interactions=interactions, contexts=levels, parameters=parameters, covariance=dict(zip(terms, (1 / np.maximum(curvature, EPSILON)).tolist(), strict=True)), prevalence=p, calibration=calibration,
        composition={r.family: r.n / attacks for r in fam}, offsets={r.family: r.m - overall for r in fam}, threat_covariance={r.family: 1.0 if r.n == 1 else max(r.v / r.n, EPSILON) for r in fam},
        means=means, scales=scales, farthest=max(far["d"], EPSILON), disagreements={p: max(far[f"p{i}"], EPSILON) for i, p in enumerate(pairs)},
        ranges={f: (span[f"low{i}"], span[f"high{i}"]) for i, f in enumerate(features)},
        supported={k: sorted(r[0] for r in support.select(F.col(k).cast("string")).distinct().collect()) for k in contexts}, valid_until=valid_until, steps=steps,
    )


def z(means: dict[str, float], scales: dict[str, float], f: str) -> Column:
    return (F.col(f"`{f}`").cast("double") - means[f]) / scales[f]


def distance(means: dict[str, float], scales: dict[str, float]) -> Column:
    parts = [z(means, scales, f) * z(means, scales, f) for f in means]
    return sum(parts[1:], parts[0])


def apart(means: dict[str, float], scales: dict[str, float], a: str, b: str) -> Column:
    return F.abs(z(means, scales, a) - z(means, scales, b))


def weight(mixture: dict[str, float], offsets: dict[str, float]) -> float:
    return sum(p * math.exp(offsets[k]) for k, p in mixture.items())


def threat_shift(m: JointRisk, scenario: Scenario | None) -> tuple[float, float] | None:
    """(shift, variance) of the log odds by another mixture of threats; null where its families are not the model's."""
    mix = m.composition if scenario is None else scenario.mixture
    if set(mix) != set(m.composition):
        return None
    there, here = weight(m.composition, m.offsets), weight(mix, m.offsets)
    share = {k: (mix[k] / here - m.composition[k] / there) * math.exp(m.offsets[k]) for k in mix}
    v = sum(share[k] ** 2 * m.threat_covariance[k] for k in mix)
    if scenario is not None:
        second = sum(p * (math.exp(m.offsets[k]) / here) ** 2 for k, p in mix.items())
        v += max((second - 1) / (sum(scenario.threats.values()) + 1), 0.0)
    return math.log(here / there), v


def estimate(m: JointRisk, rows: DataFrame, prior: float | None = None, scenario: Scenario | None = None, confidence: float = 0.95, policy: tuple[float, float] = (0.5, 0.05), now: datetime | None = None) -> DataFrame:
    """rows with risk: struct<status, reason, posterior, low, high, action>; action is null where rows abstain or the interval crosses a limit of the policy."""
    if (prior is None) == (scenario is None):
        raise ValueError("pass prior or scenario")
    prior = scenario.prior if scenario else prior
    if not 0 < prior < 1 or not 0 < confidence < 1:
        raise ValueError("prior and confidence must lie between 0 and 1")
    reasons = []
    if m.valid_until is not None and (now or datetime.now(timezone.utc)) > m.valid_until:
        reasons.append(F.lit("calibration expired"))
    shift = threat_shift(m, scenario)
    if shift is None:
        reasons.append(F.lit("unknown threat families"))
        shift = (0.0, 0.0)
    reasons += [F.when(~F.coalesce(F.col(k).cast("string").isin(*own), F.lit(False)), f"unsupported {k}") for k, own in m.supported.items()]
    for f, (low, high) in m.ranges.items():
        s = F.col(f"`{f}`").cast("double")
        reasons += [F.when(s.isNull() | F.isnan(s), f"missing {f}"), F.when(~s.between(low, high), f"{f} out of range")]
    reasons.append(F.when(distance(m.means, m.scales) > m.farthest, "far from training"))
    reasons += [F.when(apart(m.means, m.scales, a, b) > most, f"{a} and {b} disagree") for (a, b), most in m.disagreements.items()]
    terms = terms_of(m.features, m.interactions, m.contexts)
    x = design(m.features, m.interactions, m.contexts)

    def dot(values: list[float], square: bool) -> Column:
        return F.aggregate(F.zip_with(x, F.array(*map(F.lit, values)), lambda u, v: (u * u if square else u) * v), F.lit(0.0), lambda s, v: s + v)

    eta, var = dot([m.parameters[t] for t in terms], False), dot([m.covariance[t] for t in terms], True)
    k = m.calibration
    more = 0.0 if scenario is None else 1 / ((scenario.alpha + scenario.beta + 1) * prior * (1 - prior))
    offset = math.log(prior / (1 - prior)) - math.log(m.prevalence / (1 - m.prevalence)) + shift[0]
    radius = normal_quantile((1 + confidence) / 2)

    def done(e: Column) -> Column:
        value = k["intercept"] + k["slope"] * e["eta"] + offset
        spread = radius * F.sqrt(k["slope"] ** 2 * e["var"] + k["intercept_variance"] + e["eta"] * e["eta"] * k["slope_variance"] + more + shift[1])
        post, low, high = T.logistic(value), T.logistic(value - spread), T.logistic(value + spread)
        sure = action(low, policy) == action(high, policy)
        ok = e["reason"].isNull()
        return F.struct(
            F.when(ok, "ok").otherwise("abstained").alias("status"), e["reason"].alias("reason"), *[F.when(ok, v).alias(n) for n, v in (("posterior", post), ("low", low), ("high", high))], F.when(ok & sure, action(post, policy)).alias("action"),
        )

    reason = F.coalesce(*reasons, F.lit(None).cast("string"))
    return rows.withColumn("risk", T.let(F.struct(reason.alias("reason"), eta.alias("eta"), var.alias("var")), done))
