import random
import re
from collections import Counter, defaultdict

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

import pyarrow as pa

from twinspan.llm import queries
from twinspan.llm.line_rules import COUNTERS, Limits, clean, judge, profile, without_lines

from .cases import broken_docs, no_docs, odd_docs, rows

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def plain_counters(text):
    words = WORD.findall(text or "")
    windows = Counter(tuple(words[i : i + 5]) for i in range(len(words) - 4))
    repeated = {i + j for i in range(len(words) - 4) if windows[tuple(words[i : i + 5])] > 1 for j in range(5)}
    lines = [x for x in (text or "").split("\n") if WORD.search(x)]
    return (len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text or "")), len(lines) - len(set(lines)), len(repeated))


def form(line):
    low = "".join(c.lower() if "A" <= c <= "Z" else c for c in line)
    return re.sub("[0-9]+", "0", " ".join(WORD.findall(low)))


def plain_judge(docs, limits=Limits()):
    """(doc_id, counters, base_failed, kept) of (doc_id, text, host)."""
    holders, of_host = defaultdict(set), defaultdict(set)
    for _, text, host in docs:
        of_host[host or ""].add(text or "")
        for line in (text or "").split("\n"):
            if form(line):
                holders[host or "", form(line)].add(text or "")
    out = []
    for doc_id, text, host in docs:
        counters = plain_counters(text)
        failed = counters[0] < limits.words or 100 * counters[4] > limits.repeated * counters[0]
        lost = 0
        for line in (text or "").split("\n"):
            n = len(holders[host or "", form(line)])
            if form(line) and n > limits.least and 100 * n > limits.share * len(of_host[host or ""]):
                lost += len(WORD.findall(line))
        left = counters[0] - lost
        gone = lost > 0 and (left < limits.words or 100 * left < limits.left * counters[0])
        out.append((doc_id, *counters, failed, not failed and not gone))
    return sorted(out, key=repr)


@settings(max_examples=150, deadline=None)
@given(st.lists(st.text(alphabet="aAb1 \t\n\r#é12", max_size=60), max_size=6))
def test_counters_and_lines_as_plain_ones(texts):
    found = profile(pa.array([t.encode() for t in texts], pa.binary()))
    assert list(zip(*(found[c].to_pylist() for c in COUNTERS), strict=True)) == [plain_counters(t) for t in texts]
    known = {}
    for text, own in zip(texts, found["lines"].to_pylist(), strict=True):
        words = Counter()
        for line in text.split("\n"):
            if form(line):
                words[form(line)] += len(WORD.findall(line))
        assert sorted(x["words"] for x in own) == sorted(words.values())
        if len(words) == 1:  # equal forms have equal hashes, others different ones
            known.setdefault(next(iter(words)), set()).add(own[0]["hash"])
    assert all(len(h) == 1 for h in known.values()) and len(set.union(set(), *known.values())) == len(known)


def _corpus(n=400, seed=7):
    pick = random.Random(seed)
    word = lambda: "".join(pick.choice("abcdefghij") for _ in range(6))
    docs = []
    for i in range(n):
        host = ["h1", "h1", "h2", None, ""][i % 5]
        lines = [" ".join(word() for _ in range(8)) for _ in range(pick.randint(1, 4))]
        if pick.random() < 0.3:
            lines.insert(pick.randrange(len(lines) + 1), f"Page {i} of 10,  Terms of SERVICE and privacy for all our readers")
        if pick.random() < 0.1:
            lines = ["subscribe to our free letter today and get the news every single day of the week", "only few words"]
            lines.append(str(i))
        docs.append((i, "\n".join(lines), host))
    docs += [(1000 + i, "one text that is copied so often but holds a line of its own", "h2") for i in range(200)]
    return docs + [(None, None, "h1"), (5, docs[5][1], docs[5][2])]


def test_judge_as_a_plain_one(spark):
    docs = _corpus()
    for limits in (Limits(), Limits(least=30, share=0, words=3, left=80, repeated=0)):
        found = judge(spark.createDataFrame(docs, "doc_id long, text string, source string").repartition(7), limits=limits)
        expected = plain_judge(docs, limits)
        assert rows(found) == expected
    assert any(not r[-1] and not r[-2] for r in plain_judge(docs))  # the method itself rejects some


def test_clean_removes_the_lines_and_the_depleted(spark):
    docs = _corpus()
    verdicts = dict((r[0], r[-1]) for r in plain_judge(docs))
    df = spark.createDataFrame(docs, "doc_id long, text string, source string").withColumns({"host": F.lit(1), "digest": F.lit(2), "lines": F.lit(3), "_lost": F.lit(4), "hash": F.lit(5)})
    found = clean(df)
    assert found.columns == df.columns
    texts = {r["doc_id"]: r["text"] for r in found.collect()}
    assert set(texts) == {i for i, kept in verdicts.items() if kept}
    before = {i: t for i, t, _ in docs}
    assert all("of SERVICE" not in t for t in texts.values()) and any("of SERVICE" in before[i] for i in texts)
    assert all(t == "\n".join(x for x in before[i].split("\n") if "of SERVICE" not in x) for i, t in texts.items())


def test_without_lines_keeps_empty_ones():
    data = pa.array([b"a b\n\n keep \na  B"], pa.binary())
    hashes = {x["hash"]: x["words"] for x in profile(data)["lines"].to_pylist()[0]}
    assert without_lines(b"a b\n\n keep \na  B", {h for h, n in hashes.items() if n == 4}) == b"\n keep "


@pytest.mark.parametrize("clashing", [False, True])
def test_odd_rows(spark, clashing):
    df = odd_docs(spark, clashing)
    docs = [(r["doc_id"], r["text"], r["source"]) for r in df.collect()]
    assert rows(judge(df)) == plain_judge(docs)
    assert clean(df).columns == df.columns


def test_empty_and_broken(spark):
    assert judge(no_docs(spark)).count() == 0 and clean(no_docs(spark)).count() == 0
    found = {r["doc_id"]: r for r in judge(broken_docs(spark)).collect()}
    assert found[1]["n_words"] == 4 and found[2]["n_words"] == 1 and found[5]["word_chars"] == 4


def test_query_has_the_contract_columns(spark):
    found = queries.op11_quality_rules(spark, "/root/testdata/sf0.001")
    assert found.columns == ["doc_id", *COUNTERS, "base_failed", "kept"]
    docs = [(r["doc_id"], r["text"], r["source"]) for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()]
    assert rows(found) == plain_judge(docs)
