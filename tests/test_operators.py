"""Components, ids, relationships, statistics: against plain Python."""

import random

import pytest
from pyspark.sql import functions as F

from twinspan.operators.components import connected_components, contracted
from twinspan.operators.frequency import agreement, top_values, u_values, value_counts
from twinspan.operators.ids import numbered
from twinspan.operators.rows import ids_except, paired_ids, rows_in, rows_not_in
from twinspan.operators.storage import intermediates, materialise, shared_dir
from twinspan.operators.relationship import enforce, unique_partner


def plain_components(edges):
    root = {}

    def find(x):
        while root.setdefault(x, x) != x:
            x = root[x]
        return x

    for a, b in edges:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return {x: find(x) for x in root}


def components(spark, edges, kind="long", **more):
    rows = connected_components(spark.createDataFrame(edges, f"a {kind}, b {kind}"), "a", "b", **more).collect()
    assert len(rows) == len({r.node for r in rows})
    return {r.node: r.component for r in rows}


@pytest.mark.parametrize("seed", range(4))
def test_components_of_random_graphs(spark, seed):
    rng = random.Random(seed)
    edges = [(a, b) for a, b in ((rng.randrange(200), rng.randrange(200)) for _ in range(rng.choice([20, 100, 180, 400]))) if a != b]
    assert components(spark, edges) == plain_components(edges)


def test_components_of_hard_shapes(spark):
    rng = random.Random(5)
    chain = [(i, i + 1) for i in range(100)]
    names = list(range(1000, 1200))
    rng.shuffle(names)
    tangled = list(zip(names, names[1:], strict=False))
    star = [(5000, 5000 + i) for i in range(1, 400)] + [(9999, 5000 + i) for i in range(1, 400, 7)]
    edges = chain + tangled + star
    assert components(spark, edges) == plain_components(edges)
    assert components(spark, edges[::-1] + [(b, a) for a, b in edges]) == plain_components(edges)


def test_components_by_rounds_alone_and_with_hubs(spark):
    """Edges that no task contracts need the rounds; a low bound makes hubs of ordinary nodes."""
    rng = random.Random(12)
    edges = [(rng.randrange(60), rng.randrange(60)) for _ in range(45)] + [(100, i) for i in range(101, 130)] + [(i, i + 1) for i in range(200, 225)]
    want = plain_components(edges)
    assert components(spark, edges, at_once=1) == want
    assert components(spark, edges, at_once=1, hub_rows=3) == want
    assert components(spark, edges, at_once=7) == want


def test_long_paths_shrink_by_rounds(spark):
    """In order, shuffled, and as a comb; few rounds, whatever the names."""
    n = 20_000
    ids = spark.range(n).select(F.col("id"), F.xxhash64("id").alias("mixed"))
    for a, b in ((F.col("id"), F.col("id") + 1), (F.col("mixed"), F.xxhash64(F.col("id") + 1)), (F.col("id"), F.floor(F.col("id") / 2) * 2 - 2)):
        edges = ids.select(a.alias("a"), b.alias("b")).repartition(13)
        found = connected_components(edges, "a", "b", max_rounds=16, at_once=500)
        nodes, least, groups = found.agg(F.count("node"), F.min("component"), F.count_distinct("component")).first()
        want = plain_components([tuple(r) for r in edges.collect()])
        assert nodes == len(want) and {groups} == {len(set(want.values()))} and least == min(want.values())


def test_components_of_nodes_of_other_types(spark):
    for kind, make in (("double", float), ("struct<x:int,y:string>", lambda i: (i, str(i)))):
        edges = [(make(a), make(b)) for a, b in ((1, 2), (3, 2), (7, 9), (9, 9))]
        assert components(spark, edges, kind, at_once=1) == {make(1): make(1), make(2): make(1), make(3): make(1), make(7): make(7), make(9): make(7)}


def test_contraction_keeps_components(spark):
    rng = random.Random(3)
    for n in (1, 5, 300):
        pairs = {(max(a, b), min(a, b)) for a, b in ((rng.randrange(n + 1), rng.randrange(n + 1)) for _ in range(n)) if a != b}
        edges = spark.createDataFrame(sorted(pairs), "u long, v long").coalesce(1)
        left = [(r.u, r.v) for r in contracted(edges).collect()]
        assert plain_components(left) == plain_components(list(pairs)) and all(u > v for u, v in left)
        assert len(left) == len(plain_components(list(pairs))) - len(set(plain_components(list(pairs)).values()))
    dates = spark.sql("SELECT date'2020-01-02' AS u, date'2020-01-01' AS v UNION ALL SELECT date'2020-01-03', date'2020-01-02'")
    assert contracted(dates.coalesce(1)).count() == 2


def test_components_of_strings_nulls_and_nothing(spark):
    assert components(spark, [("b", "a"), ("c", "b"), ("x", "x"), (None, "q"), ("z", None)], "string") == {"a": "a", "b": "a", "c": "a"}
    assert components(spark, []) == {}


def test_numbering(spark):
    rng = random.Random(2)
    keys = [f"k{rng.randrange(10**6)}" for _ in range(500)]
    df = spark.createDataFrame([(k, i) for i, k in enumerate(keys)], "k string, i int").repartition(6)
    rows = numbered(df, ["k", "i"], "n", 100).collect()
    assert [(r.k, r.i) for r in sorted(rows, key=lambda r: r.n)] == sorted((k, i) for i, k in enumerate(keys))
    assert sorted(r.n for r in rows) == list(range(101, 601))
    assert numbered(df.limit(0), ["k"], "n").count() == 0


def plain_single(pairs, group, partner):
    found = {}
    for p in pairs:
        found.setdefault(p[group], set()).add(p[partner])
    return [p for p in pairs if p[group] is not None and len(found[p[group]]) == 1]


def test_relationships(spark):
    rng = random.Random(3)
    pairs = [(rng.randrange(40), rng.randrange(40)) for _ in range(45)] + [(None, 3), (3, None), (50, 51), (50, 51)]
    df = spark.createDataFrame(pairs, "l int, r int")
    want = {"1TM": plain_single(pairs, 1, 0), "MT1": plain_single(pairs, 0, 1)}
    want["1T1"] = plain_single(want["1TM"], 0, 1)
    for kind, rows in want.items():
        assert sorted(map(tuple, enforce(df, kind, "l", "r").collect()), key=repr) == sorted(rows, key=repr)
    assert (50, 51) in [tuple(r) for r in unique_partner(df, "l", "r").collect()]
    with pytest.raises(ValueError):
        enforce(df, "NT1", "l", "r")


def test_one_to_one_is_sequential(spark):
    # the first pass drops both pairs of r1, which leaves l1 with one partner only
    df = spark.createDataFrame([("l1", "r1"), ("l2", "r1"), ("l1", "r2")], "l string, r string")
    assert [tuple(r) for r in enforce(df, "1T1", "l", "r").collect()] == [("l1", "r2")]


def test_frequencies(spark):
    left = spark.createDataFrame([("a",), (" a ",), ("b",), (None,), ("  ",)], "v string")
    right = spark.createDataFrame([("a",), ("c",), ("",)], "w string")
    assert {r.value: r.n for r in value_counts(left, "v").collect()} == {"a": 2, "b": 1}
    assert [tuple(r) for r in top_values(left, "v", 1).collect()] == [("a", 2)]
    assert [(r.value, r.u) for r in u_values(left, right, "v", "w").collect()] == [("a", 2 / 6)]
    one = agreement(left, right, "v", "w").first()
    assert one.agreement == 2 / 15 and one.disagreement == 4 / 15 and one.missing == 9 / 15
    none = agreement(left.limit(0), right, "v", "w").first()
    assert tuple(none) == (None, None, None)


@pytest.mark.parametrize("seed", range(3))
def test_agreement_sums_to_one(spark, seed):
    rng = random.Random(seed)
    frame = lambda: spark.createDataFrame([(rng.choice(["a", "b", "c", None, " "]),) for _ in range(rng.randint(1, 60))], "v string")
    assert abs(sum(agreement(frame(), frame(), "v", "v").first()) - 1) < 1e-9


def test_frequencies_of_numbers(spark):
    df = spark.range(5).select((F.col("id") % 2).alias("v"))
    assert {r.value: r.n for r in value_counts(df, "v").collect()} == {"0": 3, "1": 2}


def test_equalities_of_a_step_become_join_keys(spark):
    from twinspan.operators.matching import pair_and_match
    from twinspan.plans.spec import Comparison, Step

    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        df = spark.createDataFrame([(1, "a", "xyz"), (2, "a", "xyw"), (3, "a", None)], "id long, k string, v string")
        step = Step(1, ("k",), ("v", "v", "v"), (Comparison("HEAD_MATCH", {"n": 2}), Comparison("SOUNDEX"), Comparison("LEVENSHTEIN", {"max_edits": 1})))
        found = pair_and_match(df, df, step, ["id"], ["id"], ("id", "id"))
        plan = found._jdf.queryExecution().executedPlan().toString()
        keys = plan.split("SortMergeJoin [")[1].split("]")[0]
        assert keys.count("LEFT__") >= 3 and "CartesianProduct" not in plan and "NestedLoop" not in plan
        assert [(r.LEFT_id, r.RIGHT_id) for r in found.collect()] == []
        near = Step(1, ("k",), ("v", "v"), (Comparison("HEAD_MATCH", {"n": 2}), Comparison("LEVENSHTEIN", {"max_edits": 1})))
        assert [(r.LEFT_id, r.RIGHT_id) for r in pair_and_match(df, df, near, ["id"], ["id"], ("id", "id")).collect()] == [(1, 2)]
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_rows_by_ids(spark):
    records = spark.createDataFrame([(1, "a"), (2, "b"), (2, "c"), (None, "d")], "id int, x string")
    ids = spark.createDataFrame([(2,), (2,), (None,), (9,)], "id int")
    assert sorted(r.x for r in rows_in(records, ids, "id").collect()) == ["b", "c"]
    assert sorted(r.x for r in rows_not_in(records, ids, "id").collect()) == ["a", "d"]
    assert sorted((r.id is None, r.id) for r in ids_except(records, ids, "id").collect()) == [(False, 1), (True, None)]
    pairs = spark.createDataFrame([(1, 2), (2, 1), (None, 3)], "l int, r int")
    assert sorted(r.id for r in paired_ids(pairs, "l", "r", "id").collect()) == [1, 2, 3]


def test_numbering_of_many_equal_values(spark):
    """Half of all rows share a null; they are dealt over several partitions and numbered without gaps."""
    df = spark.createDataFrame([(None if i % 2 else i, i) for i in range(2000)], "k int, v int")
    rows = numbered(df, ["k"], "n", 5).collect()
    assert sorted(r.n for r in rows) == list(range(6, 2006))
    assert {r.n for r in rows if r.k is None} == set(range(6, 1006))
    assert [r.k for r in sorted(rows, key=lambda r: r.n) if r.k is not None] == list(range(0, 2000, 2))


def test_intermediates_are_deleted(spark):
    import os

    df = spark.range(3)
    with intermediates(spark, "some-run") as folder:
        kept = materialise(df, "x")
        assert kept.count() == 3 and os.listdir(folder.removeprefix("file://"))
    assert not os.path.exists(folder.removeprefix("file://"))
    assert materialise(df, "x").count() == 3  # elsewhere again
    with pytest.raises(ZeroDivisionError):
        with intermediates(spark, "other-run") as folder:
            materialise(df, "x")
            1 / 0
    assert not os.path.exists(folder.removeprefix("file://"))


def test_a_cluster_needs_a_shared_folder():
    from types import SimpleNamespace

    conf = SimpleNamespace(get=lambda *a: None)
    session = SimpleNamespace(sparkContext=SimpleNamespace(getConf=lambda: conf, getCheckpointDir=lambda: None, master="spark://host:7077"), conf=conf)
    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        shared_dir(session)


def test_numbering_leaves_columns_of_any_name(spark):
    names = ["_part", "_tie", "_rank", "_n", "_before", "a b"]
    df = spark.createDataFrame([(i, *[f"{c}{i}" for c in names]) for i in (3, 1, 2)], ", ".join(["k int", *(f"`{c}` string" for c in names)]))
    rows = numbered(df, ["k"], "n").collect()
    assert sorted(map(tuple, rows)) == [(i, *[f"{c}{i}" for c in names], i) for i in (1, 2, 3)]


def test_frequencies_and_sql_of_nulls_and_nothing(spark):
    from twinspan.operators.frequency import field_sizes, top_values
    from twinspan.plans.sql import entities, register_functions, self_match

    odd = spark.createDataFrame([(1, "a"), (1, " a "), (None, "a"), (2, None), (3, "  "), (4, "b"), (4, "b")], "id int, v string")
    nothing = odd.limit(0)
    assert {(r.value, r.n) for r in value_counts(odd, "v").collect()} == {("a", 3), ("b", 2)} and value_counts(nothing, "v").count() == 0
    assert tuple(field_sizes(odd, "v").first()) == (7, 5, 2) and tuple(field_sizes(nothing, "v").first()) == (0, 0, 0)
    assert top_values(nothing, "v", 3).count() == 0 and u_values(odd, nothing, "v", "v").count() == 0
    assert tuple(agreement(nothing, odd, "v", "v").first()) == (None, None, None)
    register_functions(spark)
    for name, df, want in (("odd_rows", odd, []), ("no_rows", nothing, []), ("more_rows", odd.withColumn("v", F.lit("k")), [(1, 2), (1, 2), (1, 3), (1, 3), (1, 4), (1, 4), (1, 4), (1, 4), (2, 3), (2, 4), (2, 4), (3, 4), (3, 4)])):
        df.createOrReplaceTempView(name)
        assert sorted(map(tuple, self_match(spark, name, "id", ["{t}.v"], "true").collect())) == want
    spark.createDataFrame([(1, 2), (None, 2), (2, 5), (7, None), (8, 8)], "left_id int, right_id int").createOrReplaceTempView("pairs_of_rows")
    assert {tuple(r) for r in entities(spark, "pairs_of_rows").collect()} == {(1, 1), (2, 1), (5, 1)}
    spark.createDataFrame([], "left_id int, right_id int").createOrReplaceTempView("pairs_of_rows")
    assert entities(spark, "pairs_of_rows").count() == 0
