"""De-duplication: small projects with known entities."""

import random

import pytest

from twinspan.operators.dedup import dedup
from twinspan.plans.spec import Comparison, Step

PEOPLE = "id long, born long, first string, last string, town string"


def step(keys, fields, comparisons, seq=1, **more):
    return Step(seq, tuple(keys), tuple(fields), tuple(comparisons), **more)


def entities(result, index="id"):
    return {r[index]: r.ENTITY_ID for r in result.deduped.collect()}


EDITS = step(["born", "last", "town"], ["first"], [Comparison("LEVENSHTEIN", {"max_edits": 2})])


def test_edits(spark):
    rows = [
        (1, 19800101, "Anna", "Berg", "Oslo"),
        (2, 19800101, "Ana", "Berg", "Oslo"),  # one edit from 1
        (3, 19700505, "Marten", "Lund", "Bergen"),
        (4, 19700505, "Morten", "Lund", "Bergen"),
        (5, 19700505, "Gudbrand", "Lund", "Bergen"),  # far from 3 and 4
        (6, 19600303, "abcd", "Dahl", "Moss"),
        (7, 19600303, "abxx", "Dahl", "Moss"),
        (8, 19600303, "yyxx", "Dahl", "Moss"),  # four edits from 6, two from 7
        (9, 19800101, "Anna", "Berg", "Moss"),  # another key
        (10, 19900101, None, "Vik", "Oslo"),
        (11, 19900101, "Trond", "Vik", "Oslo"),  # null counts as '', five edits
        (12, 19950101, None, "Foss", "Oslo"),
        (13, 19950101, "Li", "Foss", "Oslo"),  # two edits from ''
    ]
    result = dedup(spark.createDataFrame(rows, PEOPLE), "id", [EDITS])
    assert entities(result) == {1: 1, 2: 1, 3: 2, 4: 2, 6: 3, 7: 3, 8: 3, 12: 4, 13: 4, 5: 5, 9: 6, 10: 7, 11: 8}
    assert result.deduped.columns == ["id", "ENTITY_ID", "born", "first", "last", "town"]
    matched = {(r.LEFT_id, r.RIGHT_id): (r.ENTITY_ID, r.STEP, r.first_LEFT, r.first_RIGHT) for r in result.matched.collect()}
    assert matched == {(1, 2): (1, 1, "Anna", "Ana"), (3, 4): (2, 1, "Marten", "Morten"), (6, 7): (3, 1, "abcd", "abxx"), (7, 8): (3, 1, "abxx", "yyxx"), (12, 13): (4, 1, None, "Li")}
    assert result.stats == {1: {"total_records_linked": 5, "total_entities": 4}} and result.totals == {"total_records_linked": 5, "total_entities": 8}


def test_order_and_partitions_change_nothing(spark):
    rng = random.Random(1)
    rows = [(i, rng.randrange(3), rng.choice(["ann", "anna", "bob", "rob", None]), rng.choice("xy"), "t") for i in range(80)]
    want = None
    for n in (1, 3, 7):
        rng.shuffle(rows)
        got = entities(dedup(spark.createDataFrame(rows, PEOPLE).repartition(n), "id", [EDITS]))
        want = want or got
        assert got == want


def test_phonetic_steps(spark):
    rows = [(1, 1, "Robert", "A", "t"), (2, 1, "Rupert", "A", "t"), (3, 1, "Rubin", "A", "t"), (4, 2, "Mitchell", "A", "t"), (5, 2, "Mitchel", "A", "t")]
    df = spark.createDataFrame(rows, PEOPLE)
    assert entities(dedup(df, "id", [step(["born"], ["first"], [Comparison("SOUNDEX")])])) == {1: 1, 2: 1, 4: 2, 5: 2, 3: 3}
    assert entities(dedup(df, "id", [step(["born"], ["first"], [Comparison("NYSIIS")])])) == {4: 1, 5: 1, 1: 2, 2: 3, 3: 4}
    coded = step(["born", "first"], ["last"], [Comparison("EXACT")], transformations=("EXACT", "SOUNDEX"))
    assert entities(dedup(df, "id", [coded])) == {1: 1, 2: 1, 4: 2, 5: 2, 3: 3}


def test_string_ids_blanks_and_cut_lists(spark):
    rows = [("r1", "1980", "  ", "A1", "JOSEPH"), ("r2", "1980", "Berg", "A1", "JOSEPHINE"), ("r10", "1980", "Berg", "A1", "MARY"), ("r3", None, "Berg", "A1", "JOSEPH"), ("r4", "1981", "Vik ", "B2", "x")]
    df = spark.createDataFrame(rows, "rec string, born string, family string, postal string, second string")
    one = step(["born", "family", "postal"], ["second"], [Comparison("NYSIIS")])
    two = step(["born", "postal"], ["second"], [Comparison("HEAD_MATCH", {"n": 4}), Comparison("HEAD_MATCH", {"n": 4})], seq=2)
    result = dedup(df, "rec", [one, two])
    # step 1 pairs r2 with r10 but their codes differ; in step 2 the blank family does not matter; ids sort as text
    assert entities(result, "rec") == {"r1": 1, "r2": 1, "r10": 2, "r3": 3, "r4": 4}
    assert result.stats[1] == {"total_records_linked": 0, "total_entities": 0} and result.stats[2]["total_entities"] == 1
    assert {r.rec: r.family for r in result.deduped.collect()}["r1"] == "  "


def test_accumulation(spark):
    rows = [(1, 1, "Anna", "Berg", "310"), (2, 1, "Anne", "Berk", "x"), (3, 1, "Otto", "Lund", "310"), (4, 1, "Olga", "Lund", "310")]
    df = spark.createDataFrame(rows, PEOPLE)
    first = step(["born"], ["first", "last"], [Comparison("JARO_WINKLER", {"threshold": 0.8}), Comparison("LEVENSHTEIN", {"max_edits": 2})], group=False)
    second = step(["born"], ["town", "last"], [Comparison("FIXED_VAL", {"value": "310"}), Comparison("SOUNDEX")], seq=2)
    assert entities(dedup(df, "id", [first, second])) == {1: 1, 2: 1, 3: 2, 4: 2}
    assert entities(dedup(df, "id", [second])) == {3: 1, 4: 1, 1: 2, 2: 3}
    trailing = dedup(df, "id", [first])
    assert entities(trailing) == {1: 1, 2: 2, 3: 3, 4: 4}
    assert trailing.stats == {1: {"total_records_linked": 1, "total_entities": 0}} and trailing.matched.count() == 0


def test_a_pair_of_two_steps_keeps_the_first(spark):
    df = spark.createDataFrame([(1, 1, "a", "b", "c"), (2, 1, "a", "b", "c")], PEOPLE)
    steps = [step(["born"], ["first"], [Comparison("EXACT")], group=False), step(["born"], ["last"], [Comparison("EXACT")], seq=2)]
    result = dedup(df, "id", steps)
    assert [(r.LEFT_id, r.RIGHT_id, r.STEP) for r in result.matched.collect()] == [(1, 2, 1)]
    assert [result.stats[s]["total_records_linked"] for s in (1, 2)] == [1, 0]


def test_entities_leave_later_steps(spark):
    df = spark.createDataFrame([(1, 1, "a", "x", "t"), (2, 1, "a", "y", "t"), (3, 2, "b", "x", "t"), (4, 2, "c", "x", "t")], PEOPLE)
    steps = [step(["born"], ["first"], [Comparison("EXACT")]), step(["town"], ["last"], [Comparison("EXACT")], seq=2)]
    assert entities(dedup(df, "id", steps)) == {1: 1, 2: 1, 3: 2, 4: 2}


@pytest.mark.parametrize("rows", [[], [(1, None, None, None, None)], [(1, 1, "a", "b", "c")]])
def test_little_data(spark, rows):
    result = dedup(spark.createDataFrame(rows, PEOPLE), "id", [EDITS])
    assert entities(result) == {r[0]: i + 1 for i, r in enumerate(rows)}
    assert result.matched.count() == 0


def test_hot_key_block(spark):
    rows = [(i, 1 if i % 3 == 0 else i, f"n{i % 5}" if i % 3 == 0 else "x", "b", "t") for i in range(900)]
    got = entities(dedup(spark.createDataFrame(rows, PEOPLE), "id", [step(["born"], ["first"], [Comparison("EXACT")])]))
    # only ids with born 1 and one first name meet: five groups, and 1 itself has another name
    assert len(set(got.values())) == 5 + 600


def test_no_row_is_lost_or_added(spark):
    """Null ids, repeated ids, both, and rows equal in all columns: one row out for each row in."""
    rows = [
        (None, 1, "a", "b", "c"),
        (None, 1, "a", "b", "c"),
        (None, 2, "x", "b", "c"),
        (7, 1, "a", "b", "c"),
        (7, 1, "a", "b", "c"),
        (7, 5, "q", "b", "c"),
        (8, 1, "a", "b", "c"),
        (9, 6, "z", "b", "c"),
        (9, 6, "z", "b", "d"),
    ]
    result = dedup(spark.createDataFrame(rows, PEOPLE), "id", [EDITS])
    out = result.deduped.collect()
    assert sorted(((r.id, r.born, r["first"], r["last"], r.town) for r in out), key=repr) == sorted(rows, key=repr)
    assert {r.id: r.ENTITY_ID for r in out if r.id} == {7: 1, 8: 1, 9: 2}
    assert sorted(r.ENTITY_ID for r in out if r.id is None) == [3, 4, 5]
    assert {(r.born, r.ENTITY_ID) for r in out if r.id is None and r.born == 2} == {(2, 5)}  # by their other columns
    assert [(r.LEFT_id, r.RIGHT_id) for r in result.matched.collect()] == [(7, 8)]
    assert result.totals == {"total_records_linked": 1, "total_entities": 5}
    ids = spark.createDataFrame([(None,), (1,), (1,)], "id long")
    assert sorted(map(tuple, dedup(ids, "id", []).deduped.collect()), key=repr) == [(1, 1), (1, 1), (None, 2)]


def test_an_index_that_is_called_like_an_inner_column(spark):
    people = spark.createDataFrame([(1, "a", "x"), (2, "a", "y"), (None, "b", "z")], "_code int, k string, _part string")
    step = Step(1, ("k",), ("k",), (Comparison("EXACT"),))
    result = dedup(people, "_code", [step])
    assert sorted(map(tuple, result.deduped.collect()), key=repr) == [(1, 1, "a", "x"), (2, 1, "a", "y"), (None, 2, "b", "z")]
    assert [tuple(r)[:4] for r in result.matched.collect()] == [(1, 2, 1, 1)]
