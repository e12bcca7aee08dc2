"""Probability on the driver (few numbers) and as Column functions (many)."""

from __future__ import annotations

import math

from .values import EVIDENCE


def beta_cdf(x: float, a: float, b: float) -> float:
    """Regularised incomplete beta function, by Lentz's continued fraction."""
    if x <= 0 or x >= 1:
        return float(x >= 1)
    if x > (a + 1) / (a + b + 2):
        return 1 - beta_cdf(1 - x, b, a)
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x)) / a
    tiny, c, f = 1e-300, 1.0, 1.0
    d = 1 - (a + b) * x / (a + 1)
    d = 1 / (d if abs(d) > tiny else tiny)
    f = d
    for m in range(1, 400):
        for k in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
            d = 1 + k * d
            c = 1 + k / c
            d, c = 1 / (d if abs(d) > tiny else tiny), c if abs(c) > tiny else tiny
            f *= c * d
        if abs(c * d - 1) < 1e-15:
            break
    return front * f


def beta_quantile(p: float, a: float, b: float) -> float:
    low, high = 0.0, 1.0
    for _ in range(60):
        mid = (low + high) / 2
        low, high = (mid, high) if beta_cdf(mid, a, b) < p else (low, mid)
    return (low + high) / 2


def normal_quantile(p: float) -> float:
    """By bisection of erf."""
    low, high = -40.0, 40.0
    for _ in range(200):
        mid = (low + high) / 2
        low, high = (mid, high) if 0.5 * math.erfc(-mid / math.sqrt(2)) < p else (low, mid)
    return (low + high) / 2


class Evidence:
    """What a rail's firing or silence says, from its measured counts."""

    def __init__(self, rail: str, caught: int, attacks: int, flagged: int, benign: int, group: str | None = None) -> None:
        self.rail, self.caught, self.attacks, self.flagged, self.benign, self.group = rail, caught, attacks, flagged, benign, group or rail

    @property
    def detection(self) -> float:
        return (self.caught + 0.5) / (self.attacks + 1)

    @property
    def false_alarm(self) -> float:
        return (self.flagged + 0.5) / (self.benign + 1)

    def bits(self, fired: bool, confidence: float | None = None) -> float:
        """Log2 likelihood ratio; with a confidence the end of its interval nearest to 0, or 0 if it holds 0."""
        if confidence is None:
            return math.log2(self.detection / self.false_alarm if fired else (1 - self.detection) / (1 - self.false_alarm))
        low, high = self.interval(fired, confidence)
        return low if low > 0 else high if high < 0 else 0.0

    def interval(self, fired: bool, confidence: float) -> tuple[float, float]:
        tail = (1 - confidence) / 4
        d = [beta_quantile(p, self.caught + 0.5, self.attacks - self.caught + 0.5) for p in (tail, 1 - tail)]
        f = [beta_quantile(p, self.flagged + 0.5, self.benign - self.flagged + 0.5) for p in (tail, 1 - tail)]
        ratios = (d[0] / f[1], d[1] / f[0]) if fired else ((1 - d[1]) / (1 - f[0]), (1 - d[0]) / (1 - f[1]))
        return math.log2(ratios[0]), math.log2(ratios[1])

    def capability(self, prior: float) -> float:
        """Mutual information of firing and attack over the entropy of the prior."""
        d, f = self.detection, self.false_alarm
        fires = prior * d + (1 - prior) * f
        cells = [(prior * d, prior * fires), (prior * (1 - d), prior * (1 - fires)), ((1 - prior) * f, (1 - prior) * fires), ((1 - prior) * (1 - f), (1 - prior) * (1 - fires))]
        entropy = -(prior * math.log2(prior) + (1 - prior) * math.log2(1 - prior))
        return sum(c * math.log2(c / m) for c, m in cells if c > 0 and m > 0) / entropy


def evidence(side: str) -> dict[str, Evidence]:
    """The side's table; an unknown side uses that of input."""
    return {r[0]: Evidence(*r) for r in EVIDENCE.get(side, EVIDENCE["input"])}


def policy_from_costs(missed: float, false_block: float, review: float | None = None) -> tuple[float, float]:
    """(block_at, review_at) that cost least; two-way without review, or where review never pays."""
    two_way = false_block / (false_block + missed)
    if review is None or review / missed >= 1 - review / false_block:
        return two_way, two_way
    return 1 - review / false_block, review / missed


def required_bits(prior: float, target: float = 0.5) -> float:
    return math.log2((target / (1 - target)) / (prior / (1 - prior)))


def risk_threshold(scores: list[tuple[float, int, int]], target: float, confidence: float = 0.95) -> float | None:
    """Smallest threshold whose upper bound on the benign rate at or above it is within target; (threshold, hits, trials) rows."""
    ok = [t for t, k, n in scores if n and (1.0 if k == n else beta_quantile(confidence, k + 1, n - k)) <= target]
    return min(ok, default=None)
