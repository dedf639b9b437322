"""Token counts through a digest cache.

The cache is a Parquet table of (content_sha256, n_bytes, n_tokens) in a folder for each tokenizer_sha256, so a run reads
the counts of its own tokenizer alone. A count is the join of a text's digest and the tokenizer file's digest to it.
Distinct digests that it lacks are encoded once by the library itself and appended, so copies and later runs cost a join.
A row of the cache is a fact that cannot change: appending one twice (a retried job) does no harm, since readers take one
row for each digest.

Defined results: a null text counts as empty (0 tokens); repeated rows are each returned; null ids are kept; a very long
text is encoded whole, by itself; a count equal to the limit is not over it; an empty table gives an empty result; other
columns, whatever their names, are ignored; a text that is not valid UTF-8 is encoded as the library takes its bytes. Normal form of a text for its digest: its UTF-8 bytes.
"""

from __future__ import annotations

import functools
import hashlib
from collections.abc import Iterator
from pathlib import Path

import pyarrow as pa
import sentencepiece
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .batches import bound_batches, slices

CACHE = "content_sha256 binary, n_bytes long, n_tokens long, tokenizer_sha256 string"


@functools.lru_cache(maxsize=2)
def _library(path: str) -> sentencepiece.SentencePieceProcessor:
    return sentencepiece.SentencePieceProcessor(model_file=path)


def tokenizer_digest(path: str) -> str:
    """Names the tokenizer's version: the SHA-256 of its file."""
    return hashlib.sha256(Path(path).read_bytes()).hexdigest()


def _once(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Keep the first row of each digest that this task has seen, its text compressed for the shuffle."""
    seen: set[bytes] = set()
    pack = zstandard.ZstdCompressor(level=3).compress
    for batch in batches:
        for part in slices(batch, "body"):
            out = []
            for digest, body in zip(part.column("content_sha256").to_pylist(), part.column("body").to_pylist(), strict=True):
                if digest not in seen:
                    seen.add(digest)
                    out.append((digest, pack(body), len(body)))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), (pa.binary(), pa.binary(), pa.int64()), strict=True)], ["content_sha256", "packed", "n_bytes"])


def _encoder(path: str, version: str):
    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        library, unpack, seen = _library(path), zstandard.ZstdDecompressor().decompress, set()
        for batch in batches:
            for part in slices(batch, "packed", 1 << 20):
                fresh = {}
                for digest, packed, n in zip(*(part.column(c).to_pylist() for c in ("content_sha256", "packed", "n_bytes")), strict=True):
                    if digest not in seen:
                        seen.add(digest)
                        fresh[digest] = (packed, n)
                counts = [len(ids) for ids in library.encode([unpack(p, max_output_size=n) if n else b"" for p, n in fresh.values()], num_threads=1)]
                if fresh:
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(list(fresh), pa.binary()), pa.array([n for _, n in fresh.values()], pa.int64()), pa.array(counts, pa.int64()), pa.array([version] * len(fresh))],
                        ["content_sha256", "n_bytes", "n_tokens", "tokenizer_sha256"],
                    )

    return encode


def _stored(spark, cache_path: str, version: str) -> DataFrame:
    table = spark.read.schema(CACHE).parquet(cache_path)
    return table.where(F.col("tokenizer_sha256") == version).groupBy("content_sha256").agg(F.max("n_bytes").alias("n_bytes"), F.max("n_tokens").alias("n_tokens"))


def fill_cache(docs: DataFrame, tokenizer_path: str, cache_path: str, text: str = "text") -> None:
    """Encode the distinct texts of docs that the cache at cache_path lacks, and append their counts."""
    spark, version = docs.sparkSession, tokenizer_digest(tokenizer_path)
    bound_batches(spark)
    body = F.coalesce(F.col(text), F.lit("")).cast("binary")
    texts = docs.select(body.alias("body"), F.unhex(F.sha2(body, 256)).alias("content_sha256"))
    try:
        stored = _stored(spark, cache_path, version).select("content_sha256")
    except Exception as error:  # the first run: no cache yet
        if "PATH_NOT_FOUND" not in str(error):
            raise
        stored = None
    once = texts.mapInArrow(_once, "content_sha256 binary, packed binary, n_bytes long")
    if stored is not None:
        once = once.join(stored, "content_sha256", "left_anti")
    # Each task has kept one copy of a text at most, so no digest is frequent here.
    misses = once.repartition("content_sha256").mapInArrow(_encoder(tokenizer_path, version), CACHE)
    misses.write.mode("append").partitionBy("tokenizer_sha256").parquet(cache_path)


def token_counts(docs: DataFrame, tokenizer_path: str, cache_path: str, max_tokens: int = 4096, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Return key, n_bytes, n_tokens, over_limit for each row of docs, with the cache at cache_path brought up to date."""
    fill_cache(docs, tokenizer_path, cache_path, text)
    stored = _stored(docs.sparkSession, cache_path, tokenizer_digest(tokenizer_path))
    body = F.coalesce(F.col(text), F.lit("")).cast("binary")
    rows = docs.select(F.col(key), F.octet_length(body).cast("long").alias("n_bytes"), F.unhex(F.sha2(body, 256)).alias("content_sha256"))
    # Both sides are dealt anew by digest and length, so adaptive execution can split a hot digest of the rows.
    return rows.join(stored, ["content_sha256", "n_bytes"], "left").select(key, "n_bytes", "n_tokens", (F.col("n_tokens") > max_tokens).alias("over_limit"))
