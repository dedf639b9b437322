"""SimHash near-duplicates: fingerprints of 3-word shingles, joined on pigeonhole blocks, verified by Hamming distance.

A fingerprint's 64 bits fall into six blocks; fingerprints that differ in at most three bits agree on at least three
blocks, so they share one of the twenty keys made of three blocks. Only distinct fingerprints are joined (copies of a
text share one), so a group of copies adds nothing, and one fingerprint has at most 43,744 partners whatever the input.
Linked fingerprints are resolved to components by distributed contraction.

Words are runs of bytes other than ASCII white space, A-Z lower-cased; shingles are WORDS words joined by a space,
repeats included; a text of fewer words is one shingle; a text without words (or null) has fingerprint zero, which links
like any other. A very long text is hashed whole, COUNTED shingles at a time. A bit is set if it is set in over half of the
shingles' XXH64 (seed 42).

Defined results: repeated rows and ids are each kept; a null id never becomes a component id unless all ids of the
component are null; of equal keys keep_one() keeps the row with the smallest checksum, once; an empty table gives an
empty result; extra columns, whatever their names, are ignored by near_duplicates() and pass through keep_one().
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from twinspan.operators.components import connected_components, hub_join
from twinspan.operators.storage import materialise

from .batches import fresh, map_slices, struct_of

WORDS, SEED, DISTANCE = 3, 42, 3
#: Bits of the six blocks.
BLOCKS = [11, 11, 11, 11, 10, 10]
#: Shingles whose bits are counted at once.
COUNTED = 1 << 16


def fingerprint(body: bytes) -> int:
    """The unsigned 64-bit fingerprint of a UTF-8 text."""
    words = body.lower().split()
    if not words:
        return 0
    joined, digest = b" ".join(words), xxhash.xxh64_intdigest
    if len(words) < WORDS:
        return digest(joined, SEED)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])[: len(words) - WORDS + 1].tolist()
    hashes = np.array([digest(joined[a:b], SEED) for a, b in zip(starts, ends[WORDS - 1 :].tolist(), strict=True)], ">u8")
    counts = np.zeros(64, np.int64)
    for i in range(0, len(hashes), COUNTED):
        counts += np.unpackbits(hashes[i : i + COUNTED].view(np.uint8).reshape(-1, 8), axis=1).sum(0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * counts > len(hashes)).tobytes(), "big")


def fingerprints(docs: DataFrame, keep: list[str], text: str = "text") -> DataFrame:
    """The kept columns and fp, the fingerprint as a signed long."""
    input_name = fresh(docs, "_body")

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        found = np.array([fingerprint(x) for x in batch.column(input_name).to_pylist()], np.uint64).view(np.int64)
        return pa.RecordBatch.from_arrays([*(batch.column(c) for c in keep), pa.array(found)], [*keep, "fp"])

    rows = docs.select(*keep, F.coalesce(F.col(text), F.lit("")).cast("binary").alias(input_name))
    return map_slices(rows, input_name, work, struct_of(docs, keep, ("fp", "long")))


def block_masks() -> list[int]:
    """The twenty masks of three blocks, as signed 64-bit numbers."""
    masks, at = [], 0
    for bits in BLOCKS:
        masks.append(((1 << bits) - 1) << at)
        at += bits
    return [m - (1 << 64) if m >> 63 else m for m in (a | b | c for a, b, c in combinations(masks, 3))]


def links(distinct: DataFrame) -> DataFrame:
    """Pairs a < b of distinct fingerprints (column fp) that differ in at most DISTANCE bits."""
    keys = F.array(*[F.struct(F.lit(i).alias("k"), F.col("fp").bitwiseAND(F.lit(m)).alias("bits")) for i, m in enumerate(block_masks())])
    keyed = distinct.select("fp", F.explode(keys).alias("key")).select("fp", "key.k", "key.bits")
    left, right = keyed.withColumnRenamed("fp", "a"), keyed.withColumnRenamed("fp", "b")
    apart = F.col("a").bitwiseXOR(F.col("b"))
    near = (F.col("a") < F.col("b")) & (F.bit_count(apart) <= DISTANCE)
    # a pair that shares several keys is kept under the first of them
    first = F.lit(len(block_masks()))
    for i, m in reversed(list(enumerate(block_masks()))):
        first = F.when(apart.bitwiseAND(F.lit(m)) == 0, i).otherwise(first)
    same = (F.col("l.k") == F.col("r.k")) & (F.col("l.bits") == F.col("r.bits")) & near & (first == F.col("l.k"))
    return left.alias("l").join(right.alias("r"), same).select("a", "b")


def classes(rows: DataFrame, key: str) -> DataFrame:
    """For each distinct fp of rows: fp, label (the component's smallest fp) and component_id (its smallest key)."""
    distinct = materialise(rows.groupBy("fp").agg(F.min(key).alias("first")), "fingerprints")
    component = connected_components(links(distinct), "a", "b")
    known = distinct.join(component, distinct["fp"] == component["node"], "left").select("fp", "first", F.coalesce("component", "fp").alias("label"))
    least = known.groupBy("label").agg(F.min("first").alias("component_id"), F.count(F.lit(1)).alias("n"))
    return materialise(hub_join(known, least, "label").select("fp", "label", "component_id"), "classes")


def near_duplicates(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, fingerprint (16 hex digits) and component_id of each row."""
    rows = materialise(fingerprints(docs, [key], text), "fingerprinted")
    joined = rows.join(classes(rows, key), "fp")  # both sides are read from tables, so a hot fingerprint can be split
    return joined.select(key, F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def keep_one(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row of each component, the one with the smallest key; rows that share it are cut to one by their checksum.

    Only keys, checksums and fingerprints are shuffled to decide; documents meet the keys to keep in one join.
    """
    names = docs.columns
    total = fresh(docs, "_sum")
    marked = docs.withColumn(total, F.xxhash64(*[F.col(f"`{n}`").cast("string") for n in names]))
    rows = materialise(fingerprints(marked, [key, total], text), "fingerprinted")
    same = rows.groupBy("fp", key, total).agg(F.count(F.lit(1)).alias("n"))
    first = F.min(F.struct(F.col(key).isNull().alias("none"), F.col(key).alias("id"), F.col(total).alias("sum"), F.col("n").alias("n"))).alias("kept")
    kept = same.join(classes(rows, key), "fp").groupBy("label").agg(first)
    own_id, own_sum, n = (fresh(marked, x) for x in ("_kept_id", "_kept_sum", "_kept_n"))
    kept = kept.select(F.col("kept.id").alias(own_id), F.col("kept.sum").alias(own_sum), F.col("kept.n").alias(n))
    found = marked.join(kept, F.col(f"`{key}`").eqNullSafe(F.col(own_id)) & (F.col(total) == F.col(own_sum)))
    # Rows that are equal in all columns need one more step; others are done.
    repeated = found.where(F.col(n) > 1).dropDuplicates([own_id, own_sum])
    return found.where(F.col(n) == 1).unionByName(repeated).select(*[F.col(f"`{c}`") for c in names])
