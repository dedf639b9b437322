"""Records that are alike, taken together, against all pairs of records."""

import random

import pytest
from pyspark.sql import functions as F

from twinspan.operators.blocking import pair
from twinspan.operators.classes import classes, divisible, earliest_of, weight
from twinspan.operators.dedup import dedup
from twinspan.operators.matching import pair_and_match
from twinspan.operators.probabilistic import pattern, pattern_counts
from twinspan.plans.spec import Comparison, Step

NEAR = Step(1, ("k",), ("n",), (Comparison("ABS_DIFF", {"threshold": 1}),), group=False)
TEXT = Step(2, ("n",), ("x", "x"), (Comparison("ONE_EMPTY"), Comparison("EXACT")))
EDIT = Step(3, ("k",), ("x",), (Comparison("LEVENSHTEIN", {"max_edits": 1}),))
ONE = Step(4, ("n",), ("x",), (Comparison("ONE_EMPTY"),))
HEAD = Step(5, ("k",), ("x",), (Comparison("HEAD_MATCH", {"n": 2}),))


def _records(spark, ids: int, n: int = 60, seed: int = 3):
    """ids: of so many numbers; some rows have none, and some values are missing."""
    draw = random.Random(seed)
    rows = [(draw.randrange(ids) if ids < n else i, draw.choice("ab "), draw.choice([1, 4, 6, None]), draw.choice(["anna", "anne", "otto", "", None])) for i in range(n)]
    return spark.createDataFrame([*rows, (None, "a", 1, "anna")], "id long, k string, n int, x string")


def _all(result):
    return [sorted(map(str, map(tuple, frame.collect()))) for frame in (result.deduped, result.matched)] + [result.stats, result.totals]


@pytest.mark.parametrize("ids,steps", [(60, [NEAR, EDIT]), (25, [NEAR, ONE, HEAD]), (60, [TEXT, ONE])])
def test_deduplication_by_classes_is_that_by_records(spark, monkeypatch, ids, steps):
    df = _records(spark, ids)
    plain = _all(dedup(df, "id", steps))
    monkeypatch.setattr("twinspan.operators.dedup.CLASS_ROWS", 0)
    assert _all(dedup(df, "id", steps)) == plain and plain[3]["total_records_linked"] > 0


@pytest.mark.parametrize("step", [NEAR, ONE, HEAD])
def test_what_follows_from_pairs_of_classes(spark, step):
    df = _records(spark, 60)
    want = sorted((r.LEFT_id, r.RIGHT_id) for r in pair_and_match(df, df, step, ["id"], ["id"], ("id", "id")).collect())
    alike = classes(df, "id", [step])
    pairs = alike.pairs(step)
    assert sorted((r.LEFT_id, r.RIGHT_id) for r in alike.records(pairs).collect()) == want
    assert pairs.count() < len(want) == pairs.agg(F.sum(weight())).first()[0] and earliest_of(pairs).count() == pairs.count()
    assert sorted(r.id for r in alike.left_ids(pairs, "id").collect()) == sorted({a for a, _ in want})
    assert sorted(r.id for r in alike.paired_ids(pairs, "id").collect()) == sorted({x for ends in want for x in ends})


def test_patterns_of_candidates_are_counted_by_classes(spark):
    """Far fewer candidates stand for all of them."""
    df = _records(spark, 60)
    step = Step(1, ("k",), ("x", "n"), (Comparison("EXACT"), Comparison("ABS_DIFF", {"threshold": 2})), method="PRB")
    every = pair(df, df, step, ["id"], ["id"], ("id", "id"))
    met = classes(df, "id", [step]).candidates(step)
    assert {r["p"]: r["n"] for r in met.groupBy(pattern(step).alias("p")).agg(F.sum(weight()).alias("n")).collect()} == pattern_counts(every, step)
    assert met.count() < every.count() / 2


def test_steps_that_classes_cannot_stand_for(spark):
    df = _records(spark, 60).withColumn("d", F.col("n").cast("double"))
    assert divisible(df, [NEAR, TEXT, EDIT]) and divisible(df, [Step(1, ("k",), ("d",), (Comparison("ABS_DIFF", {"threshold": 1}),))])
    assert not divisible(df, [Step(1, ("k",), ("d",), (Comparison("EXACT"),))]) and not divisible(df, [Step(1, ("d",), (), ())])
    assert not divisible(df, [Step(1, ("k",), ("n",), (Comparison("ABS_DIFF"),), link_right=("id",))])
    assert not divisible(df, [Step(1, ("k",), ("x",), (Comparison("JARO_WINKLER"),))])
