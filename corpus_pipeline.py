"""The training-data pipeline: five stages over documents, each written as Parquet and read again by the next.

Stages take (spark, docs, sf_dir) and return a DataFrame. All but the last return the columns of documents, whatever
further ones there are, unchanged but for what their docstrings say.

Defined results of all stages: a null text counts as an empty one, and stays null in what passes; null and repeated ids
pass like others, row by row; very long texts are handled whole; other columns may have any name; an empty table gives an
empty result; of ties the stage's operator says which row counts first.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from twinspan.llm import decontamination, packing, quality, secrets, simhash
from twinspan.llm.batches import fresh
from twinspan.operators.storage import drop_path, intermediates, materialise_at, new_path


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier accepts. Rows that share an id are scored each; without labels all pass."""
    return quality.keep_good(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates: the one with the smallest id, a null id counting as the largest; of
    rows that share it the one with the smallest checksum, once. Texts without words are one group."""
    return simhash.keep_one(docs)


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that benchmark passages do not contaminate. With an empty benchmark, and without words, all pass."""
    return decontamination.decontaminate(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def secrets_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, secrets in their texts replaced by a mark; n_chars, where there is one, follows a changed text."""
    changed = fresh(docs, "_changed")
    marked = secrets.redact(docs, changed=changed)
    if "n_chars" in docs.columns:
        marked = marked.withColumn("n_chars", F.when(F.col(changed), F.char_length("text").cast("long")).otherwise(F.col("n_chars")))
    return marked.select(*[F.col(f"`{c}`") for c in docs.columns])


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents packed into sequences; an empty text is a piece of one token."""
    return packing.pack(docs, public_tokenizers.path("word_bpe_49k.json"))


Stage = Callable[[SparkSession, DataFrame, str], DataFrame]
STAGES: list[tuple[str, Stage]] = [
    ("quality", quality_stage),
    ("near_duplicates", dedup_stage),
    ("decontamination", decontamination_stage),
    ("secrets", secrets_stage),
    ("packing", packing_stage),
]
#: SQL cannot express the classifier, the models or the tokenizer; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents. Of the tables written on the way only the last stage's is left."""
    docs, path = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    for name, stage in STAGES:
        after = new_path(spark, f"stage-{name}")
        with intermediates(spark, f"within-{name}-{uuid.uuid4().hex}"):
            docs = materialise_at(stage(spark, docs, sf_dir), after)
        if path:
            drop_path(spark, path)
        path = after
    return docs
