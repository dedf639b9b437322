"""De-duplication: steps of blocking and matching, components of the matched pairs, entity ids."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from twinspan.plans.spec import Step

from .blocking import HOT_ROWS, LEFT, RIGHT
from .classes import Classes, classes, divisible, earliest_of, weight
from .components import connected_components
from .ids import numbered
from .matching import earliest, pair_and_match
from .rows import id_facts, rows_not_in
from .storage import materialise_counted

#: Records from which those that are alike to the steps are taken together.
CLASS_ROWS = 1 << 15


@dataclass
class DedupResult:
    """deduped: [index, ENTITY_ID, other columns]; matched: both records of each pair with ENTITY_ID and STEP.

    stats: for each step its counters; totals: over all steps. total_records_linked counts pairs.
    """

    deduped: DataFrame
    matched: DataFrame
    stats: dict[int, dict[str, int]] = field(default_factory=dict)
    totals: dict[str, int] = field(default_factory=dict)


def assign_entities(matched: DataFrame, index: str, offset: int = 0) -> DataFrame:
    """index and ENTITY_ID of all records in matched pairs: components numbered by their smallest id."""
    found = connected_components(matched, LEFT + index, RIGHT + index)
    roots = numbered(found.where(F.col("node") == F.col("component")).select("component"), ["component"], "ENTITY_ID", offset)
    return found.join(roots, "component").select(F.col("node").alias(index), "ENTITY_ID")


def matched_details(records: DataFrame, matched: DataFrame, entities: DataFrame, index: str) -> DataFrame:
    """LEFT_id, RIGHT_id, ENTITY_ID, STEP and the other columns of both records, suffixed _LEFT and _RIGHT.

    records has one row for each id.
    """
    others = [c for c in records.columns if c != index]
    sides = {}
    for prefix, suffix in ((LEFT, "_LEFT"), (RIGHT, "_RIGHT")):
        sides[prefix] = records.select(F.col(f"`{index}`").alias(prefix + index), *[F.col(f"`{c}`").alias(c + suffix) for c in others])
    ids = entities.select(F.col(f"`{index}`").alias(LEFT + index), "ENTITY_ID")
    joined = matched.join(ids, LEFT + index).join(sides[LEFT], LEFT + index).join(sides[RIGHT], RIGHT + index)
    return joined.select(LEFT + index, RIGHT + index, "ENTITY_ID", "STEP", *[f"{c}_LEFT" for c in others], *[f"{c}_RIGHT" for c in others])


def _one_row_each(records: DataFrame, index: str) -> DataFrame:
    """Of rows that share an id, the one whose other columns have the smallest hash."""
    others = [F.col(f"`{c}`") for c in records.columns if c != index]
    if not others:
        return records.distinct()
    kept = records.groupBy(F.col(f"`{index}`").alias(index)).agg(F.min_by(F.struct(*others), F.xxhash64(*others)).alias("_row"))
    return kept.select(*[F.col(f"`{c}`") if c == index else F.col(f"_row.`{c}`").alias(c) for c in records.columns])


def dedup(records: DataFrame, index: str, steps: list[Step] | tuple[Step, ...]) -> DedupResult:
    """Run the steps in order. deduped has one row for each row of records.

    A step without group adds its pairs to those of the next step with group, whose components become entities and
    leave the records of later steps. Pairs of trailing steps without group are dropped. Records in no pair are
    entities of their own, numbered on by id. Of more than CLASS_ROWS records those that are alike to the steps are taken
    together, and matched makes the pairs of records when it is read.

    Defined results: rows that share an id are the same record, so they get the same entity, never pair with each other
    and are shown in matched by one of them; a row without an id pairs with nothing and is an entity of its own,
    numbered behind all others in the order of its other columns (nulls first); a blank or null key field keeps a record
    out of that step; an empty table gives empty results.
    """
    ends = [LEFT + index, RIGHT + index]
    facts = id_facts(records, index)
    n_without, repeats = facts.without, facts.repeats
    hot_rows = HOT_ROWS if facts.records > HOT_ROWS else None  # fewer records make no larger block
    known = records.where(F.col(f"`{index}`").isNotNull()) if n_without else records
    single = _one_row_each(known, index) if repeats else known
    rest, pending, entities, details, offset = known, None, None, None, 0
    stats: dict[int, dict[str, int]] = {}
    pairs_so_far = in_pairs = 0
    together = facts.records > CLASS_ROWS and all(s.method != "PRB" for s in steps) and divisible(records, steps)
    taken: Classes | None = None
    for step in steps:
        if together:
            if taken is None:
                taken = classes(rest, index, steps, repeats)
            new = taken.pairs(step, hot_rows)
            new = new if pending is None else earliest_of(pending.unionByName(new))
            of_pairs = {"n": F.sum(weight()), "own": F.sum(F.when(F.col("STEP") == step.seq, weight()))}
        else:
            new = pair_and_match(rest, rest, step, [index], [index], (index, index), hot_rows).select(*ends, "STEP")
            if repeats:  # else each pair of ids comes once
                new = new.distinct()
            new = new if pending is None else earliest(pending.unionByName(new), ends).select(*ends, "STEP")
            of_pairs = {"n": F.count(F.lit(1)), "own": F.count_if(F.col("STEP") == step.seq)}
        pending, seen = materialise_counted(new, "matched", **of_pairs)
        seen = {k: n or 0 for k, n in seen.items()}
        stats[step.seq] = {"total_records_linked": seen["own"], "total_entities": 0}
        if not step.group:
            continue
        if seen["n"]:
            edges = taken.edges(pending) if taken else pending
            found, of_found = materialise_counted(assign_entities(edges, index, offset), "entities", n=F.count(F.lit(1)), last=F.max("ENTITY_ID"))
            in_pairs += of_found["n"]
            n = of_found["last"] - offset
            offset += n
            pairs_so_far += seen["n"]
            stats[step.seq]["total_entities"] = n
            more = matched_details(single, taken.records(pending) if taken else pending, found, index)
            details = more if details is None else details.unionByName(more)
            entities = found if entities is None else entities.unionByName(found)
            rest = rows_not_in(known, entities, index)
        pending = taken = None
    if details is None:
        empty, id_column = records.limit(0), F.col(f"`{index}`")
        no_pairs = empty.select(id_column.alias(LEFT + index), id_column.alias(RIGHT + index), F.lit(0).alias("STEP"))
        details = matched_details(empty, no_pairs, empty.select(id_column, F.lit(0).cast("long").alias("ENTITY_ID")), index)
    left_over = rest.select(F.col(f"`{index}`"))
    alone = numbered(left_over.distinct() if repeats else left_over, [index], "ENTITY_ID", offset)
    total = offset + facts.ids - in_pairs
    everyone = alone if entities is None else entities.unionByName(alone)
    others = [c for c in records.columns if c != index]
    order = [F.col(f"`{index}`"), F.col("ENTITY_ID"), *[F.col(f"`{c}`") for c in others]]
    deduped = known.join(everyone.select(F.col(f"`{index}`"), "ENTITY_ID"), index).select(*order)
    if n_without:
        without = records.where(F.col(f"`{index}`").isNull())
        deduped = deduped.unionByName(numbered(without, others or [index], "ENTITY_ID", total).select(*order))
    return DedupResult(deduped, details, stats, {"total_records_linked": pairs_so_far, "total_entities": total + n_without})
