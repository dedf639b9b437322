import zlib

import pytest
from pyspark.sql import functions as F

from tests.llm.cases import ROWS, no_docs, odd_docs
from twinspan.llm import sharding


def by_hand(n, seed, shards):
    """Position of each row number, in plain Python."""
    left = 1
    while left * left < n:
        left += 1
    right = max(1, -(-n // left))
    keys = sharding.round_keys(seed)

    def once(x):
        a, b = divmod(x, right)
        for i, k in enumerate(keys):
            v = b if i % 2 == 0 else a
            t = (v + k) % sharding.PRIME
            m = (t * t % sharding.PRIME + k) % sharding.PRIME * t % sharding.PRIME
            a, b = ((a + m) % left, b) if i % 2 == 0 else (a, (b + m) % right)
        return a * right + b

    out = []
    for x in range(n):
        x = once(x)
        while x >= n:
            x = once(x)
        out.append(x)
    return out


@pytest.mark.parametrize("n", [1, 2, 3, 10, 97, 1000, 4097])
def test_permutation(spark, n):
    rows = spark.range(n).select(F.col("id"), sharding.permuted(F.col("id"), n, 5).alias("p")).orderBy("id").collect()
    assert [r.p for r in rows] == by_hand(n, 5, 16)
    assert sorted(r.p for r in rows) == list(range(n))


def check_law(rows, shards):
    sizes = [sorted(r.slot for r in rows if r.shard == s) for s in range(shards)]
    assert all(s == list(range(len(s))) for s in sizes)
    assert max(map(len, sizes)) - min(map(len, sizes)) <= 1


def test_odd_rows(spark):
    rows = sharding.feistel_shards(odd_docs(spark, clashing=True), 4).collect()
    assert len(rows) == len(ROWS)
    check_law(rows, 4)
    want = sorted((-1 if i is None else i, zlib.crc32((t or "").encode()), len((t or "").encode()) + 1) for i, t, *_ in ROWS)
    assert [(-1 if r.doc_id is None else r.doc_id, r.text_crc32, r.size) for r in sorted(rows, key=lambda r: r.row_number)] == want
    assert {r.law for r in rows} == {"rows"} and {r.grown_shard for r in rows} == {None}


def test_empty(spark):
    assert sharding.feistel_shards(no_docs(spark), 16).count() == 0


def test_hot_keys_and_repeats(spark):
    """A third of the rows share an id with many texts, a third are one repeated row, some ids are null."""
    n = 30_000
    same = spark.range(n // 3).select(F.lit(500).cast("long").alias("doc_id"), F.concat(F.lit("t"), F.col("id").cast("string")).alias("text"))
    copies = spark.range(n // 3).select(F.lit(700).cast("long").alias("doc_id"), F.lit("copy").alias("text"))
    others = spark.range(n // 3).select(F.when(F.col("id") % 4 > 0, F.col("id")).alias("doc_id"), F.lit("x").alias("text"))
    rows = sharding.feistel_shards(same.union(copies).union(others), 7).collect()
    assert len(rows) == n
    assert sorted(r.row_number for r in rows) == list(range(n))
    ordered = sorted(rows, key=lambda r: r.row_number)
    keys = [(-1 if r.doc_id is None else r.doc_id, r.text_crc32, r.size) for r in ordered]
    assert keys == sorted(keys)
    check_law(rows, 7)


def test_partitioning_changes_nothing(spark):
    docs = odd_docs(spark)
    key = lambda r: (r.doc_id or -1, r.text_crc32, r.shard, r.slot)
    a = sorted(map(key, sharding.feistel_shards(docs.repartition(7), 3).collect()))
    assert a == sorted(map(key, sharding.feistel_shards(docs.coalesce(1), 3).collect()))


def test_no_python_in_plan(spark):
    plan = sharding.feistel_shards(odd_docs(spark), 16)._jdf.queryExecution().executedPlan().toString()
    assert not any(x in plan for x in ("Python", "Pandas", "Arrow"))


def test_keys_of_other_types(spark):
    """Text, date and fractional keys, nulls and repeats among them: every row has a place of its own."""
    data = [(None if i % 7 == 0 else f"doc-{i % 40:05}", f"text {i % 9}") for i in range(300)]
    docs = spark.createDataFrame(data, "doc_id string, text string")
    for kind in ("doc_id", "to_date('2020-01-01') + cast(substr(doc_id, 5) as int)", "cast(substr(doc_id, 5) as double) / 3", "cast(substr(doc_id, 5) as decimal(9, 2))"):
        got = sharding.feistel_shards(docs.selectExpr(f"{kind} AS doc_id", "text"), 16).collect()
        assert sorted(r.row_number for r in got) == list(range(300))
        places = {}
        for r in got:
            places.setdefault(r.shard, []).append(r.slot)
        assert all(sorted(v) == list(range(len(v))) for v in places.values()) and max(map(len, places.values())) - min(map(len, places.values())) <= 1
        assert sum(r.doc_id is None for r in got) == sum(k is None for k, _ in data)
