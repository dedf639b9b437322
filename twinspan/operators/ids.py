"""Consecutive ids in key order, without one task that sees all rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .rows import fresh
from .storage import materialise


def numbered(df: DataFrame, order: list[str], name: str, offset: int = 0) -> DataFrame:
    """Add name: offset + 1, offset + 2, ... by the order columns, nulls first.

    Rows are range-partitioned by the order columns and, among equal ones, by a hash of all columns (so a value that
    many different rows share goes to several tasks), and written once, so that counting and numbering see the same
    partitions; a partition's first number is the count of rows in those before it. Rows that differ in other columns
    only come in the order of that hash; other columns may have any name but the new one; an empty table gives an empty
    result.
    """
    tie, part, rank, n, before = (fresh(df, c) for c in ("_tie", "_part", "_rank", "_n", "_before"))
    tied = df.withColumn(tie, F.xxhash64(*[F.col(f"`{c}`") for c in df.columns]))
    by = [F.col(f"`{c}`") for c in order]
    ranged = tied.repartitionByRange(*by, F.col(tie)).withColumn(part, F.spark_partition_id())
    held = materialise(ranged, "numbered")
    earlier = Window.orderBy(part).rowsBetween(Window.unboundedPreceding, -1)
    starts = held.groupBy(part).agg(F.count(F.lit(1)).alias(n)).select(part, F.coalesce(F.sum(n).over(earlier), F.lit(0)).alias(before))
    ranked = held.withColumn(rank, F.row_number().over(Window.partitionBy(part).orderBy(*by, tie)))
    # one row per shuffle partition: bounded, so broadcast
    joined = ranked.join(F.broadcast(starts), part)
    return joined.withColumn(name, (F.col(before) + F.col(rank) + offset).cast("long")).drop(part, rank, before, tie)
