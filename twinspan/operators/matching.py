"""Matched pairs: candidate pairs that pass every comparison of a step."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from twinspan.functions import comparator
from twinspan.plans.spec import Step

from . import blocking
from .blocking import LEFT, RIGHT, apart_of, keyed, pair
from .probabilistic import AGREES, DISAGREES, MISSING, estimate, pattern, pattern_counts, probable
from .storage import materialise


def predicates(step: Step, columns: list[str]) -> tuple[list[Column], list[Column]]:
    """The step's comparisons over the columns of pair(): those that stay in the JVM, and the costly ones.

    A comparison whose column is not among them was decided before the records were paired.
    """
    cheap, costly = [], []
    for i, (_, _, c) in enumerate(step.compared()):
        if f"{LEFT}_c{i}" not in columns:
            continue
        algorithm, left, right = comparator(c.name), F.col(f"{LEFT}_c{i}"), F.col(f"{RIGHT}_c{i}")
        (costly if algorithm.costly else cheap).append(left == right if algorithm.key else algorithm.apply(left, right, **c.args))
    return cheap, costly


def match(pairs: DataFrame, step: Step) -> DataFrame:
    """Pairs that all comparisons accept, or for PRB steps those that are probable, with STEP; the comparators' own columns
    are gone."""
    if step.method == "PRB":
        pairs = probable(pairs, step)
    else:
        for group in predicates(step, pairs.columns):
            if group:
                pairs = pairs.where(reduce(Column.__and__, group))
    own = {f"{side}_{kind}{i}" for side in (LEFT, RIGHT) for kind in "cp" for i in range(len(step.compared()))}
    kept = [c for c in pairs.columns if c not in own]
    return pairs.select(*[F.col(f"`{c}`") for c in kept], F.lit(step.seq).alias("STEP"))


def joinable(step: Step) -> bool:
    """Whether a join finds the pairs that agree in a comparison, for each of them, and both sides read the same fields."""
    compared = step.compared()
    of = [comparator(c.name) for _, _, c in compared]
    return bool(compared) and all(x.key or apart_of(c[2]) is not None for x, c in zip(of, compared, strict=True)) and not any(x.of_presence for x in of) and all(k[0] == k[1] for k in [*step.keys(), *compared])


def missing_counts(made: DataFrame, step: Step, index: str) -> dict[int, int]:
    """Of all pairs of rows of a block with different ids, as keyed() gives them: their number for each pattern of none that agree.

    Rows are counted by block and by which values are there, so no pair is made.
    """
    there, keys = [f"_p{i}" for i in range(len(step.compared()))], [f"_k{i}" for i in range(len(step.keys()))]
    rows = made.where(F.col(f"`{index}`").isNotNull()).select(*keys, *there, F.col(f"`{index}`").alias("_id"))
    found: dict[int, int] = {}
    for by, sign in ((keys, 1), ([*keys, "_id"], -1)):
        sizes = rows.groupBy(*by, *there).agg(F.count(F.lit(1)).alias("_n"))
        other = sizes.select(*by, *[F.col(p).alias(f"{p}_r") for p in there], F.col("_n").alias("_m"))
        digits = [F.lit(3**i) * F.when(F.col(p) & F.col(f"{p}_r"), DISAGREES).otherwise(MISSING) for i, p in enumerate(there)]
        pairs = sizes.join(other, by).groupBy(reduce(Column.__add__, digits).alias("pattern")).agg(F.sum(F.col("_n") * F.col("_m")).alias("n"))
        for r in pairs.collect():
            found[r["pattern"]] = found.get(r["pattern"], 0) + sign * r["n"]
    return {p: n // 2 for p, n in found.items()}


def _probable_of_agreeing(records: DataFrame, step: Step, carry: list[str], once: tuple[str, str], hot_rows: int | None) -> DataFrame | None:
    """match() of a PRB step where blocks have many pairs, by those pairs alone that agree in a comparison.

    Each is made under its first comparison that agrees, by a join on that one's key or band; how many of each other pattern
    there are follows from the sizes of blocks. None where pairs are few, or where a pattern without agreement is accepted.
    What comparisons read is written once, as records may be much larger.
    """
    made = materialise(keyed(records, step, "left", carry), "keyed")
    counts = missing_counts(made, step, once[0])
    if sum(counts.values()) <= blocking.FEW_PAIRS:
        return None
    n = len(step.compared())
    digit = lambda i: F.floor(F.col("_pattern") / 3**i) % 3
    parts = []
    for i in range(n):
        met = pair(records, records, step, carry, carry, once, hot_rows, agree=i, made=made).withColumn("_pattern", pattern(step))
        parts.append(met.where(reduce(Column.__and__, [digit(i) == AGREES, *[digit(j) != AGREES for j in range(i)]])))
    agreeing = reduce(DataFrame.unionByName, parts)
    for p, found in pattern_counts(agreeing, step).items():
        counts[p] = counts.get(p, 0) + found
        without = sum(3**i * (MISSING if p // 3**i % 3 == MISSING else DISAGREES) for i in range(n))
        counts[without] -= found
    counts = {p: found for p, found in counts.items() if found}
    weights = estimate(counts, n)
    accepted = [p for p in counts if weights.probability(p) >= step.least]
    if any(all(p // 3**i % 3 != AGREES for i in range(n)) for p in accepted):
        return None
    own = {"_pattern", *[f"{side}_{kind}{i}" for side in (LEFT, RIGHT) for kind in "cp" for i in range(n)]}
    return agreeing.where(F.col("_pattern").isin(accepted)).select(*[F.col(f"`{c}`") for c in agreeing.columns if c not in own], F.lit(step.seq).alias("STEP"))


def pair_and_match(left: DataFrame, right: DataFrame, step: Step, left_carry: list[str], right_carry: list[str], once: tuple[str, str] | None = None, hot_rows: int | None = None) -> DataFrame:
    if step.method == "PRB" and left is right and once and once[0] == once[1] and left_carry == right_carry and once[0] in left_carry and joinable(step):
        few = _probable_of_agreeing(left, step, left_carry, once, hot_rows)
        if few is not None:
            return few
    return match(pair(left, right, step, left_carry, right_carry, once, hot_rows), step)


def earliest(matched: DataFrame, keys: list[str]) -> DataFrame:
    """One row for each pair: of several steps that matched it, the first."""
    return matched.groupBy(*keys).agg(F.min("STEP").alias("STEP"))
