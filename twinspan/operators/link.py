"""Linking of two datasets: steps of matching, a cardinality rule on entities, link ids, expansion to all records."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, LongType, StructField, StructType

from twinspan.functions import comparator
from twinspan.plans.spec import RELATIONSHIPS, Step

from .blocking import HOT_ROWS, LEFT, RIGHT, pair
from .ids import numbered
from .matching import match, pair_and_match, predicates
from .relationship import enforce, partners, unique_partner
from .rows import fresh, id_column, id_facts, rows_in, rows_not_in
from .storage import materialise, materialise_counted


@dataclass
class LinkResult:
    """linked: both records of each link; matched_not_linked: pairs that the relationship rejected, with their first STEP."""

    linked: DataFrame
    matched_not_linked: DataFrame
    unlinked_left: DataFrame
    unlinked_right: DataFrame
    stats: dict[int, dict[str, int]] = field(default_factory=dict)
    totals: dict[str, int] = field(default_factory=dict)


@dataclass(frozen=True)
class Side:
    """Names of one side's columns in pairs."""

    index: str
    entity: str
    prefix: str

    @property
    def id(self) -> str:
        return self.prefix + self.index

    @property
    def ent(self) -> str:
        return self.prefix + self.entity


def _with_id(records: DataFrame, index: str) -> DataFrame:
    return records.where(F.col(f"`{index}`").isNotNull())


def link_ids(linked: DataFrame, left: Side, right: Side, offset: int = 0) -> DataFrame:
    """LINK_ID for each distinct entity pair, in order of its first (left id, right id), then of the entities."""
    first = linked.groupBy(left.ent, right.ent).agg(F.min(F.struct(F.col(left.id).alias("l"), F.col(right.id).alias("r"))).alias("_at"))
    first = first.select(left.ent, right.ent, F.col("_at.l").alias("_l"), F.col("_at.r").alias("_r"))
    return numbered(first, ["_l", "_r", left.ent, right.ent], "LINK_ID", offset).select(left.ent, right.ent, "LINK_ID")


def _with_record(pairs: DataFrame, records: DataFrame, side: Side) -> DataFrame:
    """Pairs with the columns of their record on one side: that of the same id and entity, null entities being equal."""
    own_id, own_ent = fresh(records, "_id", pairs), fresh(records, "_ent", pairs)
    theirs = records.withColumnsRenamed({side.id: own_id, side.ent: own_ent})
    same = (F.col(f"`{side.id}`") == F.col(f"`{own_id}`")) & F.col(f"`{side.ent}`").eqNullSafe(F.col(f"`{own_ent}`"))
    return pairs.join(theirs, same).drop(own_id, own_ent)


def expand(pairs: DataFrame, left_records: DataFrame, right_records: DataFrame, left: Side, right: Side, mates: str = "right") -> DataFrame:
    """Add both records' columns to linked pairs (with LINK_ID and STEP). A record is told by its id and entity together.

    mates "right": also records of a linked right entity that have no pair themselves, left columns and STEP null;
    "both": those of left entities too; "none": pairs only. A column that both sides have is suffixed _x and _y.
    """
    own = lambda records, side: [c for c in records.columns if c not in (side.index, side.entity)]
    left_own, right_own = own(left_records, left), own(right_records, right)
    both = set(left_own) & set(right_own)
    renamed = {
        "l": [F.col(f"`{c}`").alias(c + "_x" if c in both else c) for c in left_own],
        "r": [F.col(f"`{c}`").alias(c + "_y" if c in both else c) for c in right_own],
    }
    a = left_records.select(F.col(f"`{left.index}`").alias(left.id), F.col(f"`{left.entity}`").alias(left.ent), *renamed["l"])
    b = right_records.select(F.col(f"`{right.index}`").alias(right.id), F.col(f"`{right.entity}`").alias(right.ent), *renamed["r"])
    core = pairs.select(left.id, left.ent, right.id, right.ent, "STEP", "LINK_ID")
    joined = _with_record(_with_record(core, a, left), b, right)
    for side, records in ((right, b), (left, a)):
        if mates == "both" or mates == "right" and side is right:
            # null entities equal none here: a record without an entity has no mates
            links = core.select(side.ent, "LINK_ID").distinct()
            paired = core.select(side.id, side.ent, "LINK_ID").distinct()
            joined = joined.unionByName(records.join(links, side.ent).join(paired, [side.id, side.ent, "LINK_ID"], "left_anti"), allowMissingColumns=True)
    names = lambda side: [x + s if x in both else x for x, s in ((c, "_x" if side == "l" else "_y") for c in (left_own if side == "l" else right_own))]
    return joined.select(left.id, *[F.col(f"`{c}`") for c in names("l")], left.ent, "STEP", right.id, *[F.col(f"`{c}`") for c in names("r")], right.ent, "LINK_ID")


def _no_pairs(left_records: DataFrame, right_records: DataFrame, left: Side, right: Side) -> tuple[DataFrame, DataFrame]:
    """Linked and refused pairs before the first step."""
    ends = StructType([StructField(name, records.schema[c].dataType) for records, side in ((left_records, left), (right_records, right)) for name, c in ((side.id, side.index), (side.ent, side.entity))])
    refused = StructType([*ends, StructField("STEP", IntegerType())])
    spark = left_records.sparkSession
    return spark.createDataFrame([], StructType([*refused, StructField("LINK_ID", LongType())])), spark.createDataFrame([], refused)


def _matched(left_records: DataFrame, right_records: DataFrame, step: Step, left: Side, right: Side, repeats: bool, hot_rows: int | None) -> tuple[DataFrame, dict]:
    """The pairs of a step, written, and their number."""
    matched = pair_and_match(_with_id(left_records, left.index), _with_id(right_records, right.index), step, [left.index, left.entity], [right.index, right.entity], hot_rows=hot_rows)
    matched = matched.select(left.id, left.ent, right.id, right.ent, "STEP")
    return materialise_counted(matched.distinct() if repeats else matched, "matched")  # else each pair of ids comes once


def _told_apart(steps: list[Step] | tuple[Step, ...]) -> bool:
    """Whether pairs of a later step show which earlier ones match them: the same fields, compared alike and as they are."""
    shape = lambda s: (s.keys(), [(a, b, c.name) for a, b, c in s.compared()])
    plain = all(s.method != "PRB" and s.compared() and not any((x := comparator(c.name)).key or x.prepare or x.alone or x.null_safe or x.decides for _, _, c in s.compared()) for s in steps)
    return len(steps) < 2 or plain and all(shape(s) == shape(steps[0]) for s in steps)


def _matches(step: Step, pairs: DataFrame) -> Column:
    return reduce(Column.__and__, [c for group in predicates(step, pairs.columns) for c in group])


def _single_first(left_records: DataFrame, right_records: DataFrame, step: Step, earlier: list[Step], relationship: str, left: Side, right: Side, hot_rows: int | None) -> tuple[DataFrame, int, Callable[[DataFrame], DataFrame]]:
    """What a relationship keeps of a step's pairs, the number of pairs, and, of what is linked, the refused pairs.

    No pair is written or shuffled but those kept: the least and greatest partner of each entity of the side that must have
    a single one are found as pairs are made, and pairs are made again for the records of such entities alone. All pairs of
    one of these have one partner, so they are linked or refused together, and refused pairs are made from the records of
    the other entities. Those that an earlier step matched are refused already.
    """
    if relationship not in RELATIONSHIPS:
        raise ValueError(f"unknown relationship {relationship}")
    ends = [left.id, left.ent, right.id, right.ent]
    made = lambda x, y: pair(x, y, step, [left.index, left.entity], [right.index, right.entity], hot_rows=hot_rows)
    side, partner = (left, right) if relationship == "MT1" else (right, left)
    facts, seen = materialise_counted(partners(match(made(left_records, right_records), step), side.ent, partner.ent), "partners", n=F.sum("_pairs"))

    def of(records: DataFrame, own: Side, ids: DataFrame, choose) -> DataFrame:
        return choose(records, id_column(ids, side.ent, side.entity).distinct(), side.entity) if own is side else records

    single = facts.where("_single")
    kept = materialise(match(made(of(left_records, left, single, rows_in), of(right_records, right, single, rows_in)), step).select(*ends, "STEP"), "kept")
    if relationship == "1T1":
        kept = unique_partner(kept, left.ent, right.ent)

    def refused(linked: DataFrame) -> DataFrame:
        pairs = made(of(left_records, left, linked, rows_not_in), of(right_records, right, linked, rows_not_in))
        for before in earlier:
            pairs = pairs.where(~_matches(before, pairs))
        return match(pairs, step).select(*ends, "STEP")

    return kept, seen["n"] or 0, refused


def link(left_records: DataFrame, right_records: DataFrame, left_index: str, right_index: str, left_entity: str, right_entity: str, steps: list[Step] | tuple[Step, ...], relationship: str, mates: str = "right") -> LinkResult:
    """Run the steps in order; all records of entities that a step links leave the later ones.

    Defined results: a record without an index pairs with nothing; one without an entity fails a rule that asks for its
    entity's single partner, counts as one partner of others, and has no mates; both show among the unlinked. A record is
    told by its index and entity together: rows that share both are each shown, and pairs of the same ids and entities
    count once; rows that share an index under different entities are different records. An empty side, or no steps, gives
    no links and leaves all records unlinked.
    """
    left, right = Side(left_index, left_entity, LEFT), Side(right_index, right_entity, RIGHT)
    rest_l, rest_r = left_records, right_records
    keys = [left.id, left.ent, right.id, right.ent]
    done, rejected = _no_pairs(left_records, right_records, left, right)
    offset, stats = 0, {}
    facts = [id_facts(records, index) for records, index in ((left_records, left_index), (right_records, right_index))]
    repeats = any(f.repeats for f in facts)
    hot_rows = HOT_ROWS if max(f.records for f in facts) > HOT_ROWS else None  # fewer records make no larger block
    # pairs of large tables may be far more than records, and are neither written nor shuffled where steps allow that
    streams = hot_rows is not None and not repeats and _told_apart(steps) and all(s.method != "PRB" for s in steps)
    for place, step in enumerate(steps):
        if streams:
            kept, of_matched, refuse = _single_first(_with_id(rest_l, left_index), _with_id(rest_r, right_index), step, list(steps[:place]), relationship, left, right, hot_rows)
            of_matched = {"n": of_matched}
        else:
            matched, of_matched = _matched(rest_l, rest_r, step, left, right, repeats, hot_rows)
            kept = enforce(matched, relationship, left.ent, right.ent)
        ids = link_ids(kept, left, right, offset).select(F.col(left.ent).alias("_le"), F.col(right.ent).alias("_re"), "LINK_ID")
        same = F.col(left.ent).eqNullSafe(F.col("_le")) & F.col(right.ent).eqNullSafe(F.col("_re"))
        linked, of_linked = materialise_counted(kept.join(ids, same).select(*keys, "STEP", "LINK_ID"), "linked", n=F.count(F.lit(1)), last=F.max("LINK_ID"))
        # a relationship keeps or refuses all pairs of two entities
        gone = linked.select(F.col(left.ent).alias("_le"), F.col(right.ent).alias("_re")).distinct()
        refused = refuse(linked) if streams else matched.join(gone, same, "left_anti").select(*keys, "STEP")
        last = of_linked["last"] or offset
        stats[step.seq] = {"total_records_linked": of_linked["n"], "total_entities": last - offset, "total_matched_not_linked": of_matched["n"] - of_linked["n"]}
        offset = last
        done, rejected = done.unionByName(linked), rejected.unionByName(refused)
        rest_l = rows_not_in(left_records, id_column(done, left.ent, left_entity).distinct(), left_entity)
        rest_r = rows_not_in(right_records, id_column(done, right.ent, right_entity).distinct(), right_entity)
    totals = {"total_records_linked": sum(s["total_records_linked"] for s in stats.values()), "total_entities": offset}
    ends = [left.id, right.id, left.ent, right.ent]
    not_linked = rejected.select(*ends, "STEP") if streams else rejected.groupBy(*ends).agg(F.min("STEP").alias("STEP"))
    return LinkResult(expand(done, left_records, right_records, left, right, mates), not_linked, rest_l, rest_r, stats, totals)
