"""Probabilistic matching of candidate pairs by agreement patterns.

A pair's pattern says for each comparison whether it agrees, disagrees, or a value is missing. Patterns are counted in one
aggregation over all candidates; there are at most 3 to the number of comparisons, so these counts, and nothing else, come
to the driver. There expectation-maximisation estimates how probable agreement is among matches (m) and among others
(u), and the share of matches; comparisons are taken as independent, and a missing value says nothing. u may be given, for
instance from u_values() or agreement(), and then stays. A pair's score is the sum of log2(m / u) over comparisons that
agree and log2((1 - m) / (1 - u)) over those that do not; its probability follows from the score and the share of matches.
A pair is accepted by its pattern, so a second pass over the candidates only looks patterns up.

Defined results: no candidates give none; without comparisons all candidates are accepted; a comparison that always or never
agrees says nothing; a pair whose values are all missing has the probability of the share of matches.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from twinspan.functions import comparator
from twinspan.plans.spec import Step

from .blocking import LEFT, RIGHT

#: Patterns as digits, the first comparison lowest: 0 disagrees, 1 agrees, 2 missing.
DISAGREES, AGREES, MISSING = 0, 1, 2
ROUNDS, CLOSE = 2000, 1e-10
#: Probabilities stay this far from 0 and 1.
_EDGE = 1e-9


@dataclass(frozen=True)
class Weights:
    """m and u of each comparison, and the share of matches among the candidates."""

    m: tuple[float, ...]
    u: tuple[float, ...]
    share: float

    def score(self, pattern: int) -> float:
        total = 0.0
        for m, u in zip(self.m, self.u, strict=True):
            pattern, digit = divmod(pattern, 3)
            if digit != MISSING:
                total += math.log2(m / u) if digit == AGREES else math.log2((1 - m) / (1 - u))
        return total

    def probability(self, pattern: int) -> float:
        odds = self.score(pattern) + math.log2(self.share / (1 - self.share))
        return 1 / (1 + 2.0**-odds) if odds > -1000 else 0.0


def pattern(step: Step) -> Column:
    """The pattern of a candidate pair, over the columns of pair() for a PRB step."""
    found = F.lit(0)
    for i, (_, _, c) in enumerate(step.compared()):
        algorithm, left, right = comparator(c.name), F.col(f"{LEFT}_c{i}"), F.col(f"{RIGHT}_c{i}")
        agrees = (left == right) if algorithm.key else algorithm.apply(left, right, **c.args)
        there = F.lit(True) if algorithm.of_presence else F.col(f"{LEFT}_p{i}") & F.col(f"{RIGHT}_p{i}")
        digit = F.when(~there, MISSING).when(F.coalesce(agrees, F.lit(False)), AGREES).otherwise(DISAGREES)
        found = found + F.lit(3**i) * digit
    return found.cast("int")


def pattern_counts(pairs: DataFrame, step: Step) -> dict[int, int]:
    """Number of candidates of each pattern."""
    return {r["pattern"]: r["n"] for r in pairs.select(pattern(step).alias("pattern")).groupBy("pattern").agg(F.count(F.lit(1)).alias("n")).collect()}


def _held(p: float) -> float:
    return min(max(p, _EDGE), 1 - _EDGE)


def estimate(counts: dict[int, int], comparisons: int, u: tuple[float, ...] | None = None, start: tuple[float, float] = (0.9, 0.1)) -> Weights:
    """Weights by expectation-maximisation over pattern counts. u: kept as given. start: m, and the share of matches."""
    total = sum(counts.values())
    digits = {p: [p // 3**i % 3 for i in range(comparisons)] for p in counts}
    agreeing = [sum(n for p, n in counts.items() if digits[p][i] == AGREES) for i in range(comparisons)]
    known = [sum(n for p, n in counts.items() if digits[p][i] != MISSING) for i in range(comparisons)]
    first = u or tuple(a / k if k else 0.5 for a, k in zip(agreeing, known, strict=True))
    weights = Weights(tuple(_held(start[0]) for _ in range(comparisons)), tuple(map(_held, first)), start[1])
    if not total:
        return weights
    for _ in range(ROUNDS):
        matched = {p: n * weights.probability(p) for p, n in counts.items()}
        ms, us = [], []
        for i in range(comparisons):
            sums = {True: [0.0, 0.0], False: [0.0, 0.0]}
            for p, n in counts.items():
                if digits[p][i] != MISSING:
                    for is_match, part in ((True, matched[p]), (False, n - matched[p])):
                        sums[is_match][digits[p][i]] += part
            of = lambda pair, old: _held(pair[1] / sum(pair)) if sum(pair) > 0 else old
            ms.append(of(sums[True], weights.m[i]))
            us.append(weights.u[i] if u else of(sums[False], weights.u[i]))
        new = Weights(tuple(ms), tuple(us), _held(sum(matched.values()) / total))
        moved = max(abs(a - b) for a, b in zip((*new.m, *new.u, new.share), (*weights.m, *weights.u, weights.share), strict=True))
        weights = new
        if moved < CLOSE:
            break
    return weights


def scored(pairs: DataFrame, step: Step, weights: Weights, digits: int | None = None) -> DataFrame:
    """Candidates with PATTERN, SCORE and PROBABILITY. digits: SCORE is rounded, once for each pattern and not for each pair."""
    patterns = range(3 ** len(step.compared()))
    of = lambda value: F.array(*[F.lit(float(value(p))) for p in patterns])[F.col("PATTERN")]
    score = of(weights.score) if digits is None else F.array(*[F.round(F.lit(float(weights.score(p))), digits) for p in patterns])[F.col("PATTERN")]
    return pairs.withColumn("PATTERN", pattern(step)).withColumns({"SCORE": score, "PROBABILITY": of(weights.probability)})


def probable(pairs: DataFrame, step: Step) -> DataFrame:
    """The candidates whose probability of being a match is step.least or more, by weights estimated from all of them."""
    if not step.compared():
        return pairs
    counts = pattern_counts(pairs, step)
    weights = estimate(counts, len(step.compared()))
    accepted = [p for p in counts if weights.probability(p) >= step.least]
    return pairs.where(pattern(step).isin(accepted))
