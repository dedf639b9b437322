import os

import pytest

import corpus_pipeline
from tests.llm.cases import ROWS, odd_docs, no_docs
from tests.llm.test_decontamination import by_hand as contaminated
from tests.llm.test_simhash import fingerprint
from twinspan.operators.storage import shared_dir
from twinspan.llm import quality, queries, secrets

SF = "/root/testdata/sf0.001"


def test_stages_are_in_order():
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality", "near_duplicates", "decontamination", "secrets", "packing"]


@pytest.fixture(scope="module")
def steps(spark):
    """Rows after each stage over the smallest tables, each stage's result reread from Parquet."""
    from twinspan.operators.storage import materialise

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    out = [docs.collect()]
    columns = docs.columns
    for name, stage in corpus_pipeline.STAGES:
        docs = materialise(stage(spark, docs, SF), name)
        if name != "packing":
            assert docs.columns == columns
        out.append(docs.collect())
    return out


def test_quality_stage(spark, steps):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    predicted = {r.doc_id for r in quality.predictions(docs, spark.read.parquet(f"{SF}/labels.parquet")).collect() if r.predicted}
    assert sorted(steps[1]) == sorted(r for r in steps[0] if r.doc_id in predicted)


def test_near_duplicate_stage(steps):
    """A document goes only for one of a smaller id in its component, and no two that stay are linked."""
    before, after = steps[1], steps[2]
    f = {r.doc_id: fingerprint(r.text) for r in before}
    kept = {r.doc_id for r in after}
    ids = sorted(f)
    near = {a: [b for b in ids if b != a and bin(f[a] ^ f[b]).count("1") <= 3] for a in ids}
    seen, want = set(), set()
    for a in ids:
        if a in seen:
            continue
        want.add(a)
        todo = [a]
        while todo:
            x = todo.pop()
            if x not in seen:
                seen.add(x)
                todo += near[x]
    assert kept == want
    assert sorted(after) == sorted(r for r in before if r.doc_id in kept)


def test_decontamination_stage(spark, steps):
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    assert sorted(steps[3]) == sorted(r for r in steps[2] if not contaminated(r.text, items)[-1])


def test_secrets_stage(spark, steps):
    before, after = {r.doc_id: r for r in steps[3]}, {r.doc_id: r for r in steps[4]}
    assert before.keys() == after.keys()
    for i, r in before.items():
        text = secrets.redacted(r.text, secrets.own_models(spark))
        assert after[i].text == text and after[i].n_chars == (len(text) if text != r.text else r.n_chars)
        assert not secrets.base_spans(after[i].text)


def test_packing_stage(steps):
    docs, pieces = {r.doc_id for r in steps[4]}, steps[5]
    assert {p.doc_id for p in pieces} == docs
    for i in docs:
        own = sorted((p.start, p.length, p.doc_tokens) for p in pieces if p.doc_id == i)
        assert sum(n for _, n, _ in own) == own[0][2]


def test_run_is_the_stages(spark, steps):
    rows = corpus_pipeline.run(spark, SF).collect()
    shape = lambda rows: sorted((p.doc_id, p.doc_tokens) for p in rows if p.start == 0)
    assert shape(rows) == shape(steps[5])


def test_odd_rows_pass_every_filter(spark, tmp_path):
    for docs in (odd_docs(spark, clashing=True), no_docs(spark)):
        for name, stage in corpus_pipeline.STAGES[:-1]:
            out = stage(spark, docs, SF)
            assert out.columns == docs.columns, name
            assert out.count() <= len(ROWS)
        assert corpus_pipeline.STAGES[-1][1](spark, docs, SF).count() >= docs.count()


def test_every_operator_has_a_query():
    names = sorted(queries.queries(), key=lambda n: int(n[2:].split("_")[0]))
    assert [int(n[2:].split("_")[0]) for n in names] == list(range(1, 14))
    assert set(queries.oracle_sql()) <= set(names)


def test_what_a_run_leaves(spark):
    """Of the tables of a run only the last stage's stays in the shared folder, and a stage needs no n_chars."""
    folder = shared_dir(spark).removeprefix("file://")
    before = set(os.listdir(folder))
    corpus_pipeline.run(spark, SF).count()
    assert [n.rsplit("-", 1)[0] for n in set(os.listdir(folder)) - before] == ["stage-packing"]
    docs = spark.createDataFrame([(1, "token = abcdefghijkl", 5)], "doc_id long, text string, _changed int")
    assert [tuple(r) for r in corpus_pipeline.secrets_stage(spark, docs, SF).collect()] == [(1, "[SECRET]", 5)]
