import hashlib
import re
import zlib
from fractions import Fraction

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from twinspan.llm import queries
from twinspan.llm.periodic_runs import collapse, dropped, find_runs, with_runs

from .cases import broken_docs, no_docs, odd_docs, rows

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def plain_runs(words, least=24):
    """Every period, every place: the longest stretches, each under its smallest period."""
    found, n = {}, len(words)
    for p in range(1, n // 3 + 1):
        i = 0
        while i < n - p:
            if words[i] != words[i + p]:
                i += 1
                continue
            start = i
            while i < n - p and words[i] == words[i + p]:
                i += 1
            if i + p - start >= max(least, 3 * p):
                found.setdefault((start, i + p), p)
    return sorted((a, b - a, p) for (a, b), p in found.items())


@settings(max_examples=300, deadline=None)
@given(st.lists(st.integers(0, 2), max_size=120), st.integers(1, 12), st.sampled_from([1, 50, 1 << 18]))
def test_runs_of_few_words_as_plain_ones(words, least, probes):
    assert find_runs(np.array(words, np.int64), least, probes) == plain_runs(words, least)


@settings(max_examples=200, deadline=None)
@given(st.lists(st.tuples(st.lists(st.integers(0, 3), min_size=1, max_size=9), st.integers(1, 30)), max_size=8), st.sampled_from([64, 1 << 18]))
def test_runs_of_repeated_pieces_as_plain_ones(parts, probes):
    words = [w for piece, times in parts for w in piece * times]
    assert find_runs(np.array(words, np.int64), probes=probes) == plain_runs(words)


def test_run_inside_a_run():
    words = [*([1] * 30 + [2]) * 4, 9, *([1, 2] * 40)]
    assert find_runs(np.array(words)) == plain_runs(words) and len(plain_runs(words)) == 6


def test_long_texts_take_no_squared_time():
    one, two = np.zeros(1_000_000, np.int64), np.tile(np.arange(5_000), 60)
    assert find_runs(one) == [(0, 1_000_000, 1)]
    assert find_runs(two) == [(0, 300_000, 5_000)]
    assert find_runs(np.random.default_rng(1).integers(0, 50, 300_000)) == []


def test_dropped_keeps_the_first_period_unless_another_run_drops_it():
    assert dropped([(1, 6, 2), (4, 5, 1)], 10).tolist() == [False, False, False, True, True, True, True, True, True, False]


def plain_row(doc_id, text):
    words = WORD.findall(text or "")
    n = len(words)
    if doc_id is not None and n:
        h = zlib.crc32(str(doc_id).encode())
        g = h // 10
        if h % 10 == 0:
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            words = [w if i < a else words[a + (i - a) % p] for i, w in enumerate(words)]
    runs = plain_runs(words)
    gone = {i for s, length, p in runs for i in range(s + p, s + length)}
    best = min(runs, key=lambda r: (-Fraction(r[1], r[2]), r[0], r[2]), default=None)
    listed = "".join(f"{s},{length},{p}\n" for s, length, p in runs)
    kept = " ".join(w for i, w in enumerate(words) if i not in gone)
    sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
    return (doc_id, len(runs), *(best or (None,) * 3), best and 1000 * best[1] // best[2], sha(listed), sha(kept))


def test_query_as_a_plain_one(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()
    found = queries.op13_periodic_runs(spark, "/root/testdata/sf0.001")
    assert rows(found) == sorted((plain_row(r["doc_id"], r["text"]) for r in docs), key=repr)
    assert found.columns == ["doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256"]
    assert any(r["n_runs"] for r in found.collect())


def test_planted_runs_of_many_ids(spark, tmp_path):
    texts = ["", None, " ", "a", "a b", "one two three " * 20, " ".join(map(str, range(50))), "x\ty\x0bz w v " * 9]
    docs = [(i, texts[i % len(texts)]) for i in range(400)] + [(None, "a b " * 30), (0, "a b " * 30), (0, "a b " * 30)]
    spark.createDataFrame(docs, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    assert rows(queries.op13_periodic_runs(spark, str(tmp_path))) == sorted((plain_row(*d) for d in docs), key=repr)


@pytest.mark.parametrize("clashing", [False, True])
def test_odd_rows(spark, clashing):
    df = odd_docs(spark, clashing)
    found = with_runs(df.withColumnRenamed("n", "other") if clashing else df)
    for r in found.collect():
        words = WORD.findall(r["text"] or "")
        runs = [tuple(x) for x in r["runs"]]
        if len(words) < 1000:
            assert runs == plain_runs(words)
        gone = dropped(runs, len(words))
        assert r["n_words"] == len(words) and bytes(r["collapsed"]).decode() == " ".join(w for w, d in zip(words, gone, strict=True) if not d)
    assert rows(collapse(df)) != rows(df) and collapse(df).columns == df.columns and collapse(df).count() == df.count()


def test_empty_and_broken(spark):
    assert with_runs(no_docs(spark)).count() == 0
    assert with_runs(broken_docs(spark)).select(F.sum("n_words")).first()[0] == 8


def test_collapse_leaves_other_texts_alone(spark):
    df = spark.createDataFrame([(1, "a  b\nc "), (2, "say it " * 20 + "end"), (3, None)], "doc_id long, text string")
    assert rows(collapse(df)) == [(1, "a  b\nc "), (2, "say it end"), (3, None)]
