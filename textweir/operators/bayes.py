"""A naive Bayes rail: trained on clauses, its threshold and its calibration fitted on roles of their own."""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions.stats import Evidence
from . import metrics, train
from . import rails as R


@dataclass(frozen=True)
class Bayes:
    """Weights by feature, the score above which a text is blocked, and (floor, bits) bands from the lowest on."""

    weights: dict[str, float]
    threshold: float
    calibration: list[tuple[float, float]]


def score(text: Column, weights: dict[str, float]) -> Column:
    """The highest sum of weights of a clause's distinct features, to six places; the text itself is its clause where it has none."""
    if not weights:
        return F.lit(0.0)
    known, table = T.strings(list(weights)), F.map_from_arrays(T.strings(list(weights)), F.array(*map(F.lit, weights.values())))

    def clause(c: Column) -> Column:
        return F.aggregate(F.array_intersect(train.features(c), known), F.lit(0.0), lambda s, f: s + F.element_at(table, f))

    own = F.filter(F.array(text), lambda t: t.isNotNull())
    return F.round(F.array_max(F.transform(T.let(T.clauses(text), lambda c: F.when(F.size(c) > 0, c).otherwise(own)), clause)), 6)


def bits(value: Column, calibration: list[tuple[float, float]]) -> Column:
    """What a score is worth: the bits of the highest band whose floor it passes, else of the lowest."""
    out = F.lit(calibration[0][1])
    for floor, b in calibration:
        out = F.when(value > (floor if math.isfinite(floor) else -1e300), b).otherwise(out)
    return out


def bands(counts: dict[int, tuple[int, int]], confidence: float = 0.95) -> list[tuple[float, float]]:
    """(floor, bits) from counts (attacks, benign) by band; bands that would say less than the one below are pooled."""
    floors = [-math.inf, *metrics.EDGES]
    a, b = (sum(c[i] for c in counts.values()) for i in (0, 1))

    def worth(x: int, y: int) -> float:
        return Evidence("bayes", x, a, y, b).bits(True, confidence)

    rows = metrics.pooled([(f, *counts.get(i, (0, 0))) for i, f in enumerate(floors)], worth)
    return [(f, round(worth(x, y), 3)) for f, x, y in rows]


def fit(cases: DataFrame, clauses: DataFrame, most: int = 300) -> Bayes:
    """A model from cases (role, attack, text) and the training clauses (text, attack), which are taken once each."""
    w = {r.feature: r.weight for r in train.bayes_weights(clauses.select("text", "attack").distinct(), most).collect()}  # at most `most`
    scored = cases.where("role in ('calibration', 'threshold')").withColumn("bits", score(F.col("text"), w)).select("role", "attack", "bits").persist()
    try:
        at = scored.where("role = 'threshold' and not attack").agg(F.ceil(F.max("bits"))).first()[0]
        by = {r.band: (r.attacks, r.benign) for r in metrics.bands(scored).collect()}  # a handful
    finally:
        scored.unpersist()
    if at is None or not by:
        raise ValueError("calibration and threshold roles need cases")
    return Bayes(w, float(at), bands(by))


def bayes(model: Bayes, scored: str | None = None) -> R.Rail:
    """Blocks above the threshold; a positive score up to it is no decision. scored names a column of the context that holds the text's score already."""

    def decide(text: Column, ctx: dict[str, Column]) -> Column:
        def judged(s: Column) -> Column:
            over = s > model.threshold
            return R.verdict(F.when(over, "blocked").otherwise("passed"), text, F.when(over, F.array(F.lit("bayes"))).otherwise(R.none()), over | (s <= 0))

        return T.let(ctx[scored] if scored else score(text, model.weights), judged)

    return R.Rail("bayes", decide, ("input", "context"))
