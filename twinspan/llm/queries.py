"""The thin queries of the subpackage: each applies its operator, with production parameters, to its whole table."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from twinspan.operators.storage import materialise, new_path

from . import decontamination, licenses, line_rules, media, oracles, packing, periodic_runs, quality, secrets, sharding, simhash, token_counts, warc, whitening


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_feistel_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.feistel_shards(_table(spark, sf_dir, "documents"), 16)


def op2_secret_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.scan(_table(spark, sf_dir, "documents"))


def op3_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.predictions(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op4_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", F.col("text").cast("binary").alias("text"))
    found, added = decontamination.contamination(docs, _table(spark, sf_dir, "benchmark"))
    return found.select(
        "doc_id",
        F.col(added.n_words).alias("n_words"),
        added.hit_words().alias("n_hit"),
        F.size(added.items).cast("long").alias("n_items"),
        F.sha2(F.array_join(added.items, ",").cast("binary"), 256).alias("items_sha256"),
        added.contaminated().alias("contaminated"),
    )


def op5_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    # A cache of its own for each call: the query then always does all the work.
    return token_counts.token_counts(_table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"), new_path(spark, "token-cache"))


def op6_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(_table(spark, sf_dir, "documents"))


def op7_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.round_trip(_table(spark, sf_dir, "pages"), new_path(spark, "warc"))


def op8_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(_table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


def op9_media_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    n_bytes = F.octet_length(F.coalesce("text", F.lit(""))).cast("long").alias("n_bytes")
    # the column is stored, and what is parsed is what the store gives back
    stored = materialise(media.mux_column(docs.select("doc_id", n_bytes, media.padded_payload().alias("payload")), "payload", ["doc_id", "n_bytes"]), "media")
    read = media.parse_column(stored, "media", ["doc_id", "n_bytes"])
    points = F.size(F.filter("units", lambda u: u["random_access"]))
    first, last = F.element_at("units", 1)["pts"], F.element_at("units", -1)["pts"]
    feature = F.format_string("packets=%d;units=%d;random_access=%d;first_pts=%d;last_pts=%d", "packets", F.size("units"), points, first, last)
    return read.select("doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", feature.alias("feature"), "error")


def op10_license_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(_table(spark, sf_dir, "documents"))


def op11_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_rules.judge(_table(spark, sf_dir, "documents"))


def op12_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = whitening.whiten(_table(spark, sf_dir, "embeddings"))
    return found.withColumn("deviation", F.col("deviation").try_cast("long"))  # null where a long cannot hold it


def with_planted_runs(docs: DataFrame) -> DataFrame:
    """doc_id and text; where the checksum of the id ends in 0, the text's words from the a-th on repeat the p words there."""
    h = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    words = F.when(h % 10 == 0, F.regexp_extract_all("text", F.lit(r"[^\x20\x09-\x0D]+"), F.lit(0)))
    split = docs.select("doc_id", "text", F.floor(h / 10).alias("g"), words.alias("words")).withColumn("n", F.size("words"))
    placed = split.withColumn("a", F.when(F.col("n") > 0, F.col("g") % F.col("n")).cast("int")).withColumn("rest", F.col("n") - F.col("a"))
    placed = placed.withColumn("p", 1 + F.floor(F.col("rest") / (3 + F.col("g") % 8)).cast("int"))
    piece = F.slice("words", F.col("a") + 1, F.col("p"))
    repeated = F.slice(F.flatten(F.array_repeat(piece, F.ceil(F.col("rest") / F.col("p")).cast("int"))), F.lit(1), F.col("rest"))
    planted = F.array_join(F.concat(F.slice("words", F.lit(1), F.col("a")), repeated), " ")
    return placed.select("doc_id", F.when(F.col("n") > 0, planted).otherwise(F.col("text")).alias("text"))


def op13_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = with_planted_runs(_table(spark, sf_dir, "documents"))
    found = periodic_runs.with_runs(docs).withColumn("best", periodic_runs.strongest())
    listed = F.transform("runs", lambda r: F.concat_ws(",", r["start"], r["length"], r["period"]))
    text = F.concat(F.array_join(listed, "\n"), F.when(F.size("runs") > 0, "\n").otherwise(""))
    return found.select(
        "doc_id",
        F.size("runs").cast("long").alias("n_runs"),
        *[F.col(f"best.{c}").alias(c) for c in ("start", "length", "period")],
        F.expr("1000 * best.length div best.period").alias("exponent_milli"),
        F.sha2(text.cast("binary"), 256).alias("runs_sha256"),
        F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_feistel_sharding": op1_feistel_sharding,
        "op2_secret_scans": op2_secret_scans,
        "op3_quality": op3_quality,
        "op4_decontamination": op4_decontamination,
        "op5_token_counts": op5_token_counts,
        "op6_simhash": op6_simhash,
        "op7_warc": op7_warc,
        "op8_packing": op8_packing,
        "op9_media_columns": op9_media_columns,
        "op10_license_scans": op10_license_scans,
        "op11_quality_rules": op11_quality_rules,
        "op12_whitening": op12_whitening,
        "op13_periodic_runs": op13_periodic_runs,
    }


def oracle_sql() -> dict[str, str]:
    """The others need Python's models, tokenizers, hashes or codecs; tests hold them against brute force."""
    return {
        "op1_feistel_sharding": oracles.feistel_sharding(16),
        "op4_decontamination": oracles.DECONTAMINATION,
        "op7_warc": oracles.WARC,
        "op11_quality_rules": oracles.QUALITY_RULES,
    }
