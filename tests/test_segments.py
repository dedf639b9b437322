"""Texts few edits apart by segments: the pairs of a plain join, each once, from fewer candidates."""

import random

import pytest
from pyspark.sql import functions as F

from twinspan.operators import segments
from twinspan.operators.blocking import pair
from twinspan.operators.matching import pair_and_match
from twinspan.operators.segments import edits_of, first_shared, left_key, right_keys, ways, windows
from twinspan.plans.spec import Comparison, Step

SCHEMA = "id long, k string, v string"


def _step(most, fields=("v",), more=()):
    return Step(1, ("k",), fields, (Comparison("LEVENSHTEIN", {"max_edits": most}), *more))


def _ids(df):
    return sorted((r["LEFT_id"], r["RIGHT_id"]) for r in df.collect())


def _edits(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        row, before = [i], row
        for j, y in enumerate(b, 1):
            row.append(min(before[j] + 1, row[-1] + 1, before[j - 1] + (x != y)))
    return row[-1]


def _texts(pick, many, letters):
    """Texts of 0 to 12 characters, most of them a few edits from another one."""
    texts = ["", "a", "ab"]
    while len(texts) < many:
        text = list(pick.choice(texts) if pick.random() < 0.7 else "".join(pick.choices(letters, k=pick.randint(0, 12))))
        for _ in range(pick.randint(0, 3)):
            at = pick.randint(0, len(text))
            text[at : at + pick.randint(0, 1)] = pick.choices(letters, k=pick.randint(0, 1))
        texts.append("".join(text[:14]))
    return texts


@pytest.mark.parametrize("most", [1, 2, 3])
def test_texts_within_the_edits_share_a_key(spark, most):
    pick = random.Random(most)
    rows = [(x, y) for texts in ("ab", "abcdeé字") for x, y in [pick.choices(_texts(pick, 150, texts), k=2) for _ in range(3000)]]
    keys = F.array_compact(F.transform(ways(most), lambda way: left_key(F.col("x"), way, most)))
    found = spark.createDataFrame(rows, "x string, y string").select(
        "x", "y", F.arrays_overlap(keys, right_keys(F.col("y"), most)).alias("meet"), first_shared(F.col("x"), F.col("y"), most).alias("first"))
    close = 0
    for r in found.collect():
        assert r["meet"] == (r["first"] is not None)
        if _edits(r["x"], r["y"]) <= most:
            close += 1
            assert r["meet"], r
    assert close > 50


@pytest.mark.parametrize("most", [0, 1, 2, 4, 5, -1])
def test_pairs_of_a_plain_join_each_once(spark, monkeypatch, most):
    monkeypatch.setattr(segments, "GAIN", 0)
    pick = random.Random(7)
    texts = _texts(pick, 70, "abc") + [None, None, "  ", "same", "same", "same"]
    rows = [(i, pick.choice("st") if i % 9 else None, v) for i, v in enumerate(texts)]
    df = spark.createDataFrame(rows, SCHEMA)
    clean = lambda v: "" if v is None or not v.strip() else v
    want = sorted((a, b) for a, k, x in rows for b, m, y in rows if a < b and k == m and k is not None and _edits(clean(x), clean(y)) <= most)
    for hot_rows in (1 << 15, 8):
        assert _ids(pair_and_match(df, df, _step(most), ["id"], ["id"], ("id", "id"), hot_rows=hot_rows)) == want
    assert _ids(pair_and_match(df, df, _step(most), ["id"], ["id"], ("id", "id"))) == want


def test_only_big_blocks_are_joined_on_segments(spark):
    least = segments.GAIN * len(windows(1))
    pick = random.Random(3)
    rows = [(i, "big" if i < 3 * least else f"k{i % 20}", "".join(pick.choices("abcdefghij", k=9))) for i in range(4 * least)]
    df = spark.createDataFrame(rows, SCHEMA)
    twice = df.unionByName(df.select((F.col("id") + 10000).alias("id"), "k", F.concat(F.lit("x"), "v").alias("v")))
    plain = pair(twice, twice, _step(1), ["id"], ["id"], ("id", "id"))
    some = pair(twice, twice, _step(1), ["id"], ["id"], ("id", "id"), hot_rows=1 << 15)
    assert set(some.columns) == set(plain.columns)
    of_big = lambda found, n: found.where(F.col("LEFT_id") % 10000 < n).count()
    assert of_big(some, 3 * least) < 0.05 * of_big(plain, 3 * least)
    assert some.where(F.col("LEFT_id") % 10000 >= 3 * least).count() == plain.where(F.col("LEFT_id") % 10000 >= 3 * least).count()
    want = _ids(pair_and_match(twice, twice, _step(1), ["id"], ["id"], ("id", "id")))
    assert _ids(pair_and_match(twice, twice, _step(1), ["id"], ["id"], ("id", "id"), hot_rows=1 << 15)) == want and len(want) >= len(rows)


def test_two_datasets_with_a_band_and_columns_of_clashing_names(spark, monkeypatch):
    monkeypatch.setattr(segments, "GAIN", 0)
    pick = random.Random(11)
    make = lambda: [(i, "k", v, pick.randint(0, 9), 1) for i, v in enumerate(_texts(pick, 60, "ab"))]
    left, right = make(), make()
    schema = SCHEMA + ", n int, `_big` int"
    step = _step(2, ("v", "n"), (Comparison("ABS_DIFF", {"threshold": 2}),))
    want = sorted((a[0], b[0]) for a in left for b in right if _edits(a[2], b[2]) <= 2 and abs(a[3] - b[3]) <= 2)
    a, b = spark.createDataFrame(left, schema), spark.createDataFrame(right, schema)
    assert _ids(pair_and_match(a, b, step, ["id"], ["id"], hot_rows=1 << 15)) == want
    assert _ids(pair_and_match(a, b.limit(0), step, ["id"], ["id"], hot_rows=1 << 15)) == []


def test_comparisons_without_a_bound_or_of_many_edits_are_not_segmented():
    assert edits_of(Step(1, ("k",), ("v",), (Comparison("SOUNDEX"),))) is None
    assert edits_of(_step(5)) is None and edits_of(_step(-1)) is None and edits_of(_step(2)) == (0, 2)
    assert [len(windows(k)) for k in (0, 1, 2, 3)] == [1, 6, 19, 44]


def test_one_edit_makes_no_pair_that_the_comparison_drops(spark):
    pick = random.Random(5)
    rows = [(i, "k", "".join(pick.choices("abcd", k=pick.randint(0, 6)))) for i in range(300)]
    df = spark.createDataFrame(rows, SCHEMA)
    want = sorted((i, j) for i, _, x in rows for j, _, y in rows if i < j and _edits(x, y) <= 1)
    assert _ids(pair(df, df, _step(1), ["id"], ["id"], ("id", "id"), hot_rows=1 << 15)) == want
