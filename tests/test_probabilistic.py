"""Probabilistic steps: patterns, weights against a plain expectation-maximisation, scores and accepted pairs."""

import math
import random
from itertools import product

import pytest

from pyspark.sql import functions as F

from twinspan.functions.outcomes import outcome
from twinspan.operators.blocking import pair
from twinspan.operators.dedup import dedup
from twinspan.operators.matching import pair_and_match
from twinspan.operators.probabilistic import Weights, estimate, pattern, pattern_counts, scored
from twinspan.plans.spec import Comparison, Step, step_from
from twinspan.plans.validate import ValidationError, validate

SCHEMA = "id long, k string, name string, x double"
STEP = Step(1, ("k",), ("name", "x"), (Comparison("EXACT"), Comparison("ABS_DIFF", {"threshold": 1})), method="PRB", least=0.5)


def plain_em(rows, m, u, share, rounds):
    """Over single pairs, each a tuple of True, False or None."""
    k = len(m)
    for _ in range(rounds):
        weight = []
        for row in rows:
            a, b = share, 1 - share
            for i, g in enumerate(row):
                if g is not None:
                    a *= m[i] if g else 1 - m[i]
                    b *= u[i] if g else 1 - u[i]
            weight.append(a / (a + b))
        known = [[(w, r[i]) for w, r in zip(weight, rows, strict=True) if r[i] is not None] for i in range(k)]
        m = [sum(w for w, g in x if g) / sum(w for w, g in x) for x in known]
        u = [sum(1 - w for w, g in x if g) / sum(1 - w for w, g in x) for x in known]
        share = sum(weight) / len(weight)
    return m, u, share


def _simulated(n=1500, seed=3):
    """Pairs of which a tenth are matches, with three comparisons."""
    pick = random.Random(seed)
    rows = []
    for _ in range(n):
        match = pick.random() < 0.1
        rows.append(tuple(None if pick.random() < 0.1 else pick.random() < (m if match else u) for m, u in ((0.95, 0.05), (0.9, 0.1), (0.85, 0.2))))
    return rows


def _counts(rows):
    counts = {}
    for row in rows:
        p = sum(3**i * (2 if g is None else int(g)) for i, g in enumerate(row))
        counts[p] = counts.get(p, 0) + 1
    return counts


def test_weights_as_a_plain_estimation():
    rows = _simulated()
    found = estimate(_counts(rows), 3)
    first = [sum(1 for r in rows if r[i]) / sum(1 for r in rows if r[i] is not None) for i in range(3)]
    m, u, share = plain_em(rows, [0.9] * 3, first, 0.1, 600)
    assert all(abs(a - b) < 1e-5 for a, b in zip((*found.m, *found.u, found.share), (*m, *u, share), strict=True))
    assert abs(found.share - 0.1) < 0.04 and min(found.m) > 0.7 and max(found.u) < 0.3


def test_given_u_stays():
    found = estimate(_counts(_simulated()), 3, u=(0.04, 0.11, 0.19))
    assert found.u == (0.04, 0.11, 0.19) and min(found.m) > 0.7


def test_scores_and_probabilities():
    weights = Weights((0.9, 0.8), (0.1, 0.5), 0.2)
    assert math.isclose(weights.score(1 + 3 * 0), math.log2(9) + math.log2(0.2 / 0.5))
    assert weights.score(2 + 3 * 2) == 0 and math.isclose(weights.probability(8), 0.2)
    for a, b in product(range(3), range(3)):
        of = lambda w, g: 1 if g == 2 else w if g else 1 - w
        x, y = 0.2 * of(0.9, a) * of(0.8, b), 0.8 * of(0.1, a) * of(0.5, b)
        assert math.isclose(weights.probability(a + 3 * b), x / (x + y))


@pytest.mark.parametrize("counts", [{}, {0: 5}, {4: 7}, {8: 3}, {0: 1, 4: 1}])
def test_counts_that_tell_nothing(counts):
    weights = estimate(counts, 2)
    assert all(0 < x < 1 for x in (*weights.m, *weights.u, weights.share)) and all(0 <= weights.probability(p) <= 1 for p in range(9))


def _people():
    """Forty people with a second record each, of one block; others of no one."""
    pick = random.Random(4)
    rows = []
    for i in range(40):
        name, x = f"name{i}", float(pick.randint(0, 1000))
        rows += [(2 * i, "k", name if pick.random() < 0.9 else "   ", x), (2 * i + 1, "k", name, x + pick.choice([0, 0.5, 0.9]))]
    return rows


def test_a_step_accepts_by_pattern_and_differs_from_a_deterministic_one(spark):
    rows = _people()
    df = spark.createDataFrame(rows, SCHEMA)
    candidates = pair(df, df, STEP, ["id"], ["id"], ("id", "id"))
    of = {r["id"]: r for r in df.collect()}
    want = {}
    for a, b in product(of, of):
        if a < b:
            names = [of[i]["name"] if of[i]["name"].strip() else None for i in (a, b)]
            g = (None if None in names else names[0] == names[1], abs(of[a]["x"] - of[b]["x"]) <= 1)
            want[a, b] = sum(3**i * (2 if x is None else int(x)) for i, x in enumerate(g))
    assert {(r["LEFT_id"], r["RIGHT_id"]): r["p"] for r in candidates.withColumn("p", pattern(STEP)).collect()} == want
    counts = pattern_counts(candidates, STEP)
    assert sum(counts.values()) == len(want)
    weights = estimate(counts, 2)
    accepted = {pair for pair, p in want.items() if weights.probability(p) >= 0.5}
    matched = pair_and_match(df, df, STEP, ["id"], ["id"], ("id", "id"))
    assert {(r["LEFT_id"], r["RIGHT_id"]) for r in matched.collect()} == accepted
    assert matched.columns == ["LEFT_id", "RIGHT_id", "STEP"]
    assert accepted >= {(2 * i, 2 * i + 1) for i in range(40) if want[2 * i, 2 * i + 1] == 4}
    exact = pair_and_match(df, df, Step(1, STEP.block_left, STEP.link_left, STEP.comparisons), ["id"], ["id"], ("id", "id"))
    assert {(r["LEFT_id"], r["RIGHT_id"]) for r in exact.collect()} != accepted
    shown = scored(candidates, STEP, weights).collect()
    assert all(math.isclose(r["SCORE"], weights.score(want[r["LEFT_id"], r["RIGHT_id"]])) and math.isclose(r["PROBABILITY"], weights.probability(want[r["LEFT_id"], r["RIGHT_id"]])) for r in shown)


def test_de_duplication_by_a_probabilistic_step(spark):
    result = dedup(spark.createDataFrame(_people(), SCHEMA), "id", [STEP])
    assert result.stats[1]["total_records_linked"] >= 30 and result.deduped.count() == 80
    assert dedup(spark.createDataFrame([], SCHEMA), "id", [STEP]).deduped.count() == 0


def test_comparisons_of_presence_are_never_missing(spark):
    df = spark.createDataFrame([(1, "k", None, 1.0), (2, "k", None, 1.0), (3, "k", "a", None)], SCHEMA)
    step = Step(1, ("k",), ("name", "x", "name"), (Comparison("BOTH_EMPTY"), Comparison("EXACT"), Comparison("NYSIIS")), method="PRB")
    found = pair(df, df, step, ["id"], ["id"], ("id", "id")).withColumn("p", pattern(step)).collect()
    assert {(r["LEFT_id"], r["RIGHT_id"]): r["p"] for r in found} == {(1, 2): 1 + 3 + 18, (1, 3): 0 + 6 + 18, (2, 3): 0 + 6 + 18}


def test_a_step_s_probability_is_read_and_checked():
    raw = {"seq": 1, "linking_method": "PRB", "blocking_schema": {"left": ["k"]}, "linking_schema": {"left": ["x"], "comparisons": [{"name": "EXACT"}], "probability": 0.7}}
    assert step_from(raw).least == 0.7 and step_from(raw).method == "PRB"
    for wrong in (2, -0.1, "high", True, None):
        project = {"name": "p", "type": "DEDUP", "output_root": "o", "datasets": [{"url": "u", "index_field": "i"}], "steps": [raw | {"linking_schema": raw["linking_schema"] | {"probability": wrong}}]}
        with pytest.raises(ValidationError) as error:
            validate(project)
        assert error.value.codes == ["INVALID_PROBABILITY"]


OUTCOMES = [
    ("firstname_field", "Ann", " Ann ", "Agreement"),
    ("firstname_field", "Ann", "ann", "Disagreement"),
    ("firstname_field", " ", "Ann", "Missing"),
    ("lastname_field", None, None, "Missing"),
    ("middlename_field", "B", "B", "Agreement"),
    ("string_field", None, None, "Disagreement"),
    ("string_field", "a", "a", "Agreement"),
    ("numeric_field", "1", "1.0", "Agreement"),
    ("numeric_field", "1", "x", "Disagreement"),
    ("numeric_field", "x", "x", "Disagreement"),
    ("sin_field", "123 456 789", "123-456-789", "Agreement"),
    ("sin_field", "123", "124", "Disagreement"),
    ("sin_field", "n/a", "n/a", "Agreement"),
    ("sin_field", "", "1", "Missing"),
    ("data_field", "1980-02-03", "19800203", "Agreement"),
    ("data_field", "1980-02-03", "1980-03-02", "Swapped"),
    ("data_field", "1980-02-02", "1980/02/02 10:00", "Agreement"),
    ("data_field", "1980-02-03", "1981-03-02", "Disagreement"),
    ("data_field", "1980-02-03", "", "Missing"),
    ("data_field", "unknown", "unknown", "Agreement"),
    ("data_field", "unknown", "1980-02-03", "Disagreement"),
]


def test_outcomes_of_field_categories(spark):
    df = spark.createDataFrame([(i, *row) for i, row in enumerate(OUTCOMES)], "i int, category string, a string, b string, want string")
    for category in {row[0] for row in OUTCOMES}:
        rows = df.where(df.category == category).withColumn("got", outcome(category, df.a, df.b)).collect()
        assert [(r.i, r.got) for r in rows] == [(r.i, r.want) for r in rows]
    typed = spark.sql("SELECT date'2020-01-02' AS a, timestamp'2020-02-01 10:00:00' AS b")
    assert typed.select(outcome("data_field", typed.a, typed.b).alias("x")).first().x == "Swapped"
    with pytest.raises(KeyError):
        outcome("no_field", df.a, df.b)


def test_pairs_that_agree_in_nothing_are_counted_without_being_made(spark, monkeypatch):
    from twinspan.operators import matching

    rows = [(i % 190 if i % 9 else None, "xy"[i % 2], f"{i % 5 or ''}name{i % 7}" if i % 8 else None, float(i % 60) if i % 6 else None) for i in range(200)]
    df = spark.createDataFrame(rows, "id long, k string, s string, x double")
    step = Step(1, ("k",), ("s", "x", "s"), (Comparison("HEAD_MATCH", {"n": 3}), Comparison("ABS_DIFF", {"threshold": 2}), Comparison("TAIL_MATCH", {"n": 2})), method="PRB", least=0.5)
    counts, ends = [], ("LEFT_id", "RIGHT_id")
    estimate = matching.estimate
    monkeypatch.setattr("twinspan.operators.matching.estimate", lambda c, *more: counts.append(c) or estimate(c, *more))
    asked = lambda: sorted(map(tuple, matching.pair_and_match(df, df, step, ["id"], ["id"], ("id", "id")).select(*ends).collect()))
    plain = asked()
    assert not counts and plain
    monkeypatch.setattr("twinspan.operators.blocking.FEW_PAIRS", 100)
    assert asked() == plain
    assert counts == [matching.pattern_counts(matching.pair(df, df, step, ["id"], ["id"], ("id", "id")), step)]


def test_scores_are_rounded_once_for_each_pattern(spark):
    """Rounding each pair's score takes longer than all else that is done to it."""
    df = spark.createDataFrame([(i, "a", f"n{i % 3}" if i % 4 else None) for i in range(30)], "id long, k string, s string")
    step = Step(1, ("k",), ("s",), (Comparison("EXACT"),), method="PRB")
    pairs = pair(df, df, step, ["id"], ["id"], ("id", "id"))
    weights = Weights((0.9,), (0.123456,), 0.1)
    plain = scored(pairs, step, weights).select("LEFT_id", "RIGHT_id", F.round("SCORE", 4).alias("SCORE"))
    found = scored(pairs, step, weights, digits=4).select("LEFT_id", "RIGHT_id", "SCORE")
    assert sorted(map(tuple, found.collect())) == sorted(map(tuple, plain.collect()))
    assert "round" not in found._jdf.queryExecution().optimizedPlan().toString()
