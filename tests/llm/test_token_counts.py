import public_tokenizers
import pytest
import sentencepiece

from tests.llm.cases import ROWS, broken_docs, no_docs, odd_docs, rows
from twinspan.llm import token_counts
from twinspan.operators.storage import new_path

MODEL = public_tokenizers.path("piece_bpe_32k.model")


@pytest.fixture(scope="module")
def library():
    return sentencepiece.SentencePieceProcessor(model_file=MODEL)


def want(library, source):
    return sorted(((i, len((t or "").encode()), n := len(library.encode(t or "")), n > 4096) for i, t, *_ in source), key=repr)


def test_counts_are_the_library_s(spark, library):
    docs = odd_docs(spark, clashing=True)
    assert rows(token_counts.token_counts(docs, MODEL, new_path(spark, "cache"))) == want(library, ROWS)
    assert token_counts.token_counts(no_docs(spark), MODEL, new_path(spark, "cache")).count() == 0


def test_only_distinct_misses_are_encoded_and_appended(spark, library):
    path = new_path(spark, "cache")
    first, more = ROWS[:6], ROWS[4:]
    frame = lambda r: spark.createDataFrame(r, odd_docs(spark).schema)
    token_counts.token_counts(frame(first * 3).repartition(5), MODEL, path)
    stored = spark.read.parquet(path)
    assert stored.count() == len({t or "" for _, t, *_ in first})
    assert rows(token_counts.token_counts(frame(more * 2), MODEL, path)) == want(library, more * 2)
    assert spark.read.parquet(path).count() == len({t or "" for _, t, *_ in ROWS})


def test_a_row_appended_twice_does_no_harm(spark, library):
    path = new_path(spark, "cache")
    docs = odd_docs(spark)
    token_counts.token_counts(docs, MODEL, path)
    spark.read.parquet(path).write.mode("append").partitionBy("tokenizer_sha256").parquet(path + "-twice")
    spark.read.parquet(path).write.mode("append").partitionBy("tokenizer_sha256").parquet(path + "-twice")
    assert rows(token_counts.token_counts(docs, MODEL, path + "-twice")) == want(library, ROWS)


def test_another_version_of_the_tokenizer_misses(spark):
    path = new_path(spark, "cache")
    token_counts.fill_cache(odd_docs(spark), MODEL, path)
    n = spark.read.parquet(path).count()
    spark.read.parquet(path).selectExpr("content_sha256", "'other' AS tokenizer_sha256", "n_bytes", "n_tokens + 1 AS n_tokens").write.partitionBy("tokenizer_sha256").parquet(path + "-other")
    token_counts.fill_cache(odd_docs(spark), MODEL, path + "-other")
    assert spark.read.parquet(path + "-other").count() == 2 * n


def test_texts_that_are_not_utf8(spark, library):
    """The library takes their bytes as they are."""
    docs = broken_docs(spark)
    bodies = {r.doc_id: bytes(r.body) for r in docs.selectExpr("doc_id", "cast(text as binary) AS body").collect()}
    want = sorted((i, len(b), len(library.encode(b)), False) for i, b in bodies.items())
    assert rows(token_counts.token_counts(docs, MODEL, new_path(spark, "cache"))) == want
