"""Reproducible sharding: a Feistel permutation of global row numbers, without Python on the executors.

A row's number is its rank by (key, text checksum, size); keys that are no integers are ranked by their hash first. The
permutation maps numbers 0..n-1 onto themselves; position p lies in shard p mod shards at slot p div shards. So any row's
shard and slot can be computed from its number alone, and shard sizes differ by one row at most (law "rows").

Defined results: null keys rank first; a null text has no bytes (size 1, checksum 0); repeated rows get numbers one
after the other and are interchangeable; a text of any length counts by its size and checksum alone; an empty table gives
an empty result; other columns, whatever their names, are ignored.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import IntegralType

#: Quantiles that cut the key range into ranges ranked on their own. They move work between tasks, never ranks.
RANGES = 1024
#: A key with more than this share of the rows is cut further, by checksum.
HOT_SHARE = 1 / 64
#: Copies of one identical row that one task numbers at once.
COPIES = 4096
#: Steps of cycle walking. A step fails with probability under 1/sqrt(n), and for n < 4096 chains are shorter.
WALK = 64
#: Modulus of the round function.
PRIME = 2147483647


def round_keys(seed: int, rounds: int = 6) -> list[int]:
    """Keys below PRIME by a multiplicative rule from the seed."""
    keys, x = [], seed % PRIME + 1
    for _ in range(rounds):
        x = (x * 48271 + 11) % PRIME
        keys.append(x)
    return keys


def permuted(number: Column, n: int, seed: int) -> Column:
    """The position of a row number in 0..n-1 under the permutation that seed names."""
    left_size = max(1, math.isqrt(max(n - 1, 0)) + 1)
    right_size = max(1, -(-n // left_size))
    keys = F.array(*[F.struct(F.lit(i % 2).alias("side"), F.lit(k).cast("long").alias("key")) for i, k in enumerate(round_keys(seed))])

    def mixed(value: Column, key: Column) -> Column:
        t = (value + key) % PRIME
        return (((t * t) % PRIME + key) % PRIME * t) % PRIME

    def turn(s: Column, k: Column) -> Column:
        return F.struct(
            F.when(k["side"] == 0, (s["l"] + mixed(s["r"], k["key"])) % left_size).otherwise(s["l"]).alias("l"),
            F.when(k["side"] == 1, (s["r"] + mixed(s["l"], k["key"])) % right_size).otherwise(s["r"]).alias("r"),
        )

    def once(x: Column) -> Column:
        halves = F.struct(F.floor(x / right_size).cast("long").alias("l"), (x % right_size).alias("r"))
        return F.aggregate(keys, halves, turn, lambda s: s["l"] * right_size + s["r"])

    walked = F.aggregate(F.sequence(F.lit(2), F.lit(WALK)), once(number), lambda x, _: F.when(x < n, x).otherwise(once(x)))
    return F.when(walked < n, walked).otherwise(F.raise_error(F.lit("cycle walking did not end; choose another seed")))


def row_numbers(rows: DataFrame, key: str, ties: list[str], spread: str) -> tuple[DataFrame, int]:
    """Add the global rank row_number (from 0) by key (nulls first), then ties; and the number of rows.

    spread: the first of ties, an unsigned 32-bit number by which a hot key is cut. Ranks are exact whatever the
    ranges: a rank is the count of rows in the ranges before plus the rank inside its own.
    """
    k = F.col(key)
    cuts = "array(" + ",".join(repr(i / RANGES) for i in range(1, RANGES)) + ")"
    seen = rows.agg(F.count(F.lit(1)).alias("n"), F.count(k).alias("known"), F.expr(f"percentile_approx(`{key}`, {cuts}, 10000)").alias("cuts")).first()
    n, found = seen["n"], seen["cuts"] or []
    bounds = sorted(set(found))
    hot = [b for b in bounds if found.count(b) > RANGES * HOT_SHARE]
    steps = max(1, len(bounds).bit_length())
    array = F.lit(bounds) if bounds else F.array().cast("array<long>")
    place = F.lit(0)
    if bounds:

        def lower(lo: Column, i: Column) -> Column:
            at = lo + F.element_at(F.lit([1 << (steps - 1 - j) for j in range(steps)]), i)
            return F.when((at <= len(bounds)) & (F.element_at(array, F.least(at, F.lit(len(bounds)))) <= k), at).otherwise(lo)

        place = F.aggregate(F.sequence(F.lit(1), F.lit(steps)), F.lit(0), lower)
    piece = F.shiftright(F.col(spread), 26).cast("int")
    part = F.when(k.isNull(), piece if n - seen["known"] > n * HOT_SHARE else F.lit(0))
    for h in hot:
        start = bounds.index(h) + 1
        part = part.when(k == h, piece).when((F.col("_range") == start), F.lit(64))
    cut = lambda df: df.withColumn("_range", F.when(k.isNull(), F.lit(-1)).otherwise(place)).withColumn("_part", part.otherwise(F.lit(0)))
    groups = cut(rows.groupBy(key, *ties).agg(F.count(F.lit(1)).alias("_copies")))
    before = Window.orderBy("_range", "_part").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    sizes = cut(rows).groupBy("_range", "_part").agg(F.count(F.lit(1)).alias("_rows"))
    offsets = sizes.select("_range", "_part", (F.sum("_rows").over(before) - F.col("_rows")).alias("_before"))
    inside = Window.partitionBy("_range", "_part").orderBy(k.asc_nulls_first(), *ties).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    ranked = groups.withColumn("_first", F.sum("_copies").over(inside) - F.col("_copies"))
    # at most RANGES + 1 ranges and 65 parts for each of at most 1 / HOT_SHARE hot keys: bounded, so broadcast
    ranked = ranked.join(F.broadcast(offsets), ["_range", "_part"]).withColumn("_first", F.col("_first") + F.col("_before"))
    kept = [key, *ties]
    few = ranked.where(F.col("_copies") <= COPIES).select(*kept, "_first", F.explode(F.sequence(F.lit(0).cast("long"), F.col("_copies") - 1)).alias("_nth"))
    many = ranked.where(F.col("_copies") > COPIES).select(*kept, "_first", "_copies", F.explode(F.sequence(F.lit(0).cast("long"), F.col("_copies") - 1, F.lit(COPIES).cast("long"))).alias("_from"))
    many = many.repartition(F.col("_first"), F.col("_from"))
    many = many.select(*kept, "_first", F.explode(F.sequence(F.col("_from"), F.least(F.col("_from") + COPIES, F.col("_copies")) - 1)).alias("_nth"))
    return few.unionByName(many).select(*kept, (F.col("_first") + F.col("_nth")).alias("row_number")), n


def feistel_shards(docs: DataFrame, shards: int, seed: int = 20240229, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Deal all rows of docs into shards. Returns key, size, text_crc32, law, shard, slot, grown_shard (null: law rows), row_number."""
    body = F.coalesce(F.col(text), F.lit("")).cast("binary")
    rows = docs.select(F.col(key), (F.octet_length(body) + 1).cast("long").alias("size"), F.crc32(body).alias("text_crc32"))
    if isinstance(rows.schema[0].dataType, IntegralType):
        numbered, n = row_numbers(rows, key, ["text_crc32", "size"], "text_crc32")
    else:
        hashed = rows.withColumn("_hash", F.when(F.col(key).isNotNull(), F.xxhash64(key)))
        numbered, n = row_numbers(hashed, "_hash", ["text_crc32", "size", key], "text_crc32")
    placed = numbered.withColumn("_position", permuted(F.col("row_number"), n, seed))
    return placed.select(
        key,
        "size",
        "text_crc32",
        F.lit("rows").alias("law"),
        (F.col("_position") % shards).cast("int").alias("shard"),
        F.floor(F.col("_position") / shards).cast("long").alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"),
        "row_number",
    )
