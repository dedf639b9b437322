"""Rows chosen by ids: semi-join, anti-join, union and difference of id columns. Null ids are in no set of ids.

And what several operators ask of a table: names it lacks, whether its ids repeat.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def fresh(df: DataFrame, name: str, *others: DataFrame) -> str:
    """name, or name with underscores before it until no frame has such a column, whatever the case."""
    taken = {c.lower() for frame in (df, *others) for c in frame.columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name


def id_column(df: DataFrame, column: str, name: str) -> DataFrame:
    return df.select(F.col(f"`{column}`").alias(name))


def rows_in(records: DataFrame, ids: DataFrame, index: str) -> DataFrame:
    """Records whose index is among the rows of ids (a column of that name)."""
    return records.join(ids.select(index), index, "left_semi").select(*[F.col(f"`{c}`") for c in records.columns])


def rows_not_in(records: DataFrame, ids: DataFrame, index: str) -> DataFrame:
    """Records whose index is not among the rows of ids; those without an index stay."""
    return records.join(ids.select(index), index, "left_anti").select(*[F.col(f"`{c}`") for c in records.columns])


def paired_ids(pairs: DataFrame, left: str, right: str, name: str) -> DataFrame:
    """Each id that is an end of a pair, once."""
    return id_column(pairs, left, name).union(id_column(pairs, right, name)).where(F.col(name).isNotNull()).distinct()


def ids_except(records: DataFrame, ids: DataFrame, index: str) -> DataFrame:
    """Each index of records that ids lacks, once."""
    return id_column(records, index, index).distinct().join(ids.select(index), index, "left_anti")


@dataclass(frozen=True)
class IdFacts:
    """The number of records, of those without an id, and of different ids, and whether an id repeats."""

    records: int
    without: int
    ids: int
    repeats: bool


def id_facts(records: DataFrame, index: str) -> IdFacts:
    per_id = records.groupBy(F.col(f"`{index}`").alias("id")).agg(F.count(F.lit(1)).alias("n"))
    none = F.col("id").isNull()
    known = F.when(~none, F.col("n"))
    found = per_id.agg(F.sum(F.when(none, F.col("n"))).alias("none"), F.max(known).alias("most"), F.sum("n").alias("all"), F.count(known).alias("ids")).first()
    return IdFacts(found["all"] or 0, found["none"] or 0, found["ids"], (found["most"] or 0) > 1)
