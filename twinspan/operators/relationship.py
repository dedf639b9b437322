"""Cardinality filters over matched entity pairs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from twinspan.plans.spec import RELATIONSHIPS


def partners(pairs: DataFrame, group: str, partner: str) -> DataFrame:
    """Each group value, how many pairs it has (_pairs), and whether they have exactly one distinct partner (_single).

    A null partner counts as one, a null group is not single. By the least and greatest partner, so that a task holds its
    groups and not their pairs."""
    least, most = F.min(F.col(f"`{partner}`")), F.max(F.col(f"`{partner}`"))
    found = pairs.groupBy(F.col(f"`{group}`").alias(group)).agg(least.alias("_least"), most.alias("_most"), F.count_if(F.col(f"`{partner}`").isNull()).alias("_none"), F.count(F.lit(1)).alias("_pairs"))
    single = F.col("_least").isNull() | (F.col("_none") == 0) & (F.col("_least") == F.col("_most"))
    return found.select(group, "_pairs", (F.col(f"`{group}`").isNotNull() & single).alias("_single"))


def unique_partner(pairs: DataFrame, group: str, partner: str) -> DataFrame:
    """Pairs whose group value has exactly one distinct partner; a null partner counts as one, a null group fails."""
    single = partners(pairs, group, partner).where("_single")
    return pairs.join(single.select(group), group, "left_semi").select(*pairs.columns)


def enforce(pairs: DataFrame, relationship: str, left_entity: str, right_entity: str) -> DataFrame:
    """1TM: a right entity has one left entity. MT1: the reverse. 1T1: 1TM first, then MT1 on what is left."""
    if relationship not in RELATIONSHIPS:
        raise ValueError(f"unknown relationship {relationship}")
    if relationship == "MT1":
        return unique_partner(pairs, left_entity, right_entity)
    kept = unique_partner(pairs, right_entity, left_entity)
    return unique_partner(kept, left_entity, right_entity) if relationship == "1T1" else kept
