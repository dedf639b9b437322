"""Records that are alike to some steps, taken together: pairs of their classes stand for all pairs of their records.

Ids whose rows hold the same values in all fields that the steps read are a class. Where the comparisons ask the same of
both sides, two classes match as a whole or not at all, and so does a class with itself. So pairs of classes are made, and
what depends on which records are paired (components, counts, ids with a partner) follows from these and the classes'
sizes, least and greatest ids. Pairs of records are only made where they are asked for.

Defined results: as pair() has them, each pair of ids once, the smaller left: rows without an id are in no class, rows that
share one are never paired with each other; a null value is like another one, and pairs as the comparison has it.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, FloatType, MapType

from twinspan.functions import comparator
from twinspan.plans.spec import Step

from .blocking import LEFT, RIGHT, keyed, meet, pair
from .matching import pair_and_match, predicates
from .storage import materialise

#: Of a class: its number, that of one of its rows' values, its ids, the least and the greatest of them.
CLASS, ELEMENT, SIZE, LEAST, MOST = OWN = ["_class", "_element", "_size", "_least", "_most"]


def _fields(steps: Sequence[Step]) -> list[str]:
    return list(dict.fromkeys(x[0] for s in steps for x in (*s.keys(), *s.compared())))


def divisible(records: DataFrame, steps: Sequence[Step]) -> bool:
    """Whether records may be taken in classes: each step asks the same of both sides, and equal values are the same to it.

    Zeros of either sign are equal but not the same text, so only comparisons of numbers may read them."""
    types = {f.name: f.dataType for f in records.schema}
    for step in steps:
        if any(x[0] != x[1] or isinstance(types[x[0]], MapType) for x in (*step.keys(), *step.compared())):
            return False
        if any(not comparator(c.name).symmetric or isinstance(types[f], (FloatType, DoubleType)) and not comparator(c.name).band for f, _, c in step.compared()):
            return False
        if any(isinstance(types[k[0]], (FloatType, DoubleType)) for k in step.keys()):
            return False
    return not {c.lower() for c in OWN} & {c.lower() for c in records.columns}


@dataclass(frozen=True)
class Classes:
    """members: index, CLASS and LEAST of each id. elements: the columns of OWN and the steps' fields, one row for each
    different row of a class. Pairs of classes have the columns of OWN of both sides, and STEP; a class of several ids that
    matches itself is one of them."""

    index: str
    members: DataFrame
    elements: DataFrame

    def pairs(self, step: Step, hot_rows: int | None = None) -> DataFrame:
        """The pairs of classes that a step matches, each once."""
        found = pair_and_match(self.elements, self.elements, step, OWN, OWN, (ELEMENT, ELEMENT), hot_rows)
        alone = self._with_itself(step)
        for group in predicates(step, alone.columns):
            alone = alone.where(reduce(Column.__and__, group)) if group else alone
        ends = [side + c for side in (LEFT, RIGHT) for c in OWN]
        both = found.select(*ends, "STEP").unionByName(alone.select(*ends, F.lit(step.seq).alias("STEP")))
        sides = {side: F.struct(*[F.col(side + c).alias(c) for c in (CLASS, SIZE, LEAST, MOST)]) for side in (LEFT, RIGHT)}
        first, last = F.least(*sides.values()), F.greatest(*sides.values())
        kept = both.select(*[x[c].alias(side + c) for side, x in ((LEFT, first), (RIGHT, last)) for c in (CLASS, SIZE, LEAST, MOST)], "STEP").where(weight() > 0)
        return kept.distinct()

    def _with_itself(self, step: Step) -> DataFrame:
        """Each element as a pair of its own."""
        made = keyed(self.elements, step, "left", OWN)
        equal = [f"_c{i}" for i, (_, _, c) in enumerate(step.compared()) if comparator(c.name).key and step.method != "PRB"]
        made = made.dropna(subset=equal) if equal else made
        return made.select(*[F.col(c).alias(side + c) for side in (LEFT, RIGHT) for c in made.columns if not c.startswith("_k")])

    def candidates(self, step: Step) -> DataFrame:
        """The pairs of classes of a block, and what comparisons read, where each id has one row; weight() of each tells how
        many pairs of records it stands for."""
        met = pair(self.elements, self.elements, step, OWN, OWN, (ELEMENT, ELEMENT))
        return met.unionByName(self._with_itself(step).select(*met.columns)).where(weight() > 0)

    def edges(self, pairs: DataFrame) -> DataFrame:
        """Pairs of ids with the same components as all that pairs of classes stand for: each class is a star."""
        ends = [LEFT + self.index, RIGHT + self.index]
        matched = pairs.select(F.col(LEFT + CLASS).alias(CLASS)).union(pairs.select(RIGHT + CLASS)).distinct()
        stars = self.members.join(matched, CLASS).select(F.col(LEAST).alias(ends[0]), F.col(f"`{self.index}`").alias(ends[1]))
        return stars.union(pairs.select(LEFT + LEAST, RIGHT + LEAST))

    def left_ids(self, pairs: DataFrame, name: str) -> DataFrame:
        """Each id that is the smaller end of a pair."""
        return self._with_partner(pairs, MOST, F.max).where(F.col(f"`{self.index}`") < F.col("_end")).select(F.col(f"`{self.index}`").alias(name))

    def paired_ids(self, pairs: DataFrame, name: str) -> DataFrame:
        """Each id that is an end of a pair."""
        right = self._with_partner(pairs, LEAST, F.min).where(F.col(f"`{self.index}`") > F.col("_end")).select(F.col(f"`{self.index}`").alias(name))
        return self.left_ids(pairs, name).union(right).distinct()

    def _with_partner(self, pairs: DataFrame, end: str, of) -> DataFrame:
        """Members of matched classes, with the least or greatest id, _end, of all that match them."""
        ways = [pairs.select(F.col(a + CLASS).alias(CLASS), F.col(b + end).alias("_end")) for a, b in ((LEFT, RIGHT), (RIGHT, LEFT))]
        return self.members.join(ways[0].union(ways[1]).groupBy(CLASS).agg(of("_end").alias("_end")), CLASS)

    def records(self, pairs: DataFrame) -> DataFrame:
        """All pairs of ids that pairs of classes stand for, the smaller id left, and STEP."""
        side = lambda prefix: self.members.select(F.col(CLASS).alias(prefix + "_k"), F.col(f"`{self.index}`").alias(prefix + self.index))
        left = pairs.select(F.col(LEFT + CLASS).alias(LEFT + "_k"), F.col(RIGHT + CLASS).alias("_other"), "STEP").join(side(LEFT), LEFT + "_k")
        left = left.select(F.col("_other").alias(LEFT + "_k"), (F.col("_other") == F.col(LEFT + "_k")).alias("_itself"), LEFT + self.index, "STEP")
        x, y = F.col(f"`{LEFT}{self.index}`"), F.col(f"`{RIGHT}{self.index}`")
        met = meet(left, side(RIGHT), ["_k"]).where(F.when(F.col("_itself"), x < y).otherwise(x != y))
        return met.select(F.least(x, y).alias(LEFT + self.index), F.greatest(x, y).alias(RIGHT + self.index), "STEP")


def weight() -> Column:
    """The pairs of records that a pair of classes stands for, where no id is in two classes."""
    n, m = F.col(LEFT + SIZE), F.col(RIGHT + SIZE)
    return F.when(F.col(LEFT + CLASS) == F.col(RIGHT + CLASS), F.shiftright(n * (n - 1), 1)).otherwise(n * m)


def earliest_of(pairs: DataFrame) -> DataFrame:
    """Each pair of classes once, under the first step that matched it."""
    ends = [side + c for side in (LEFT, RIGHT) for c in (CLASS, SIZE, LEAST, MOST)]
    return pairs.groupBy(*ends).agg(F.min("STEP").alias("STEP"))


def classes(records: DataFrame, index: str, steps: Sequence[Step], repeats: bool = False) -> Classes:
    """The classes of records under steps that are divisible(). repeats: ids may have several rows."""
    own = F.col(f"`{index}`")
    value = F.struct(*[F.col(f"`{f}`") for f in _fields(steps)])
    known = records.where(own.isNotNull())
    per_id = known.groupBy(own.alias(index)).agg(F.sort_array(F.collect_set(value)).alias("_of")) if repeats else known.select(own.alias(index), F.array(value).alias("_of"))
    sizes = per_id.groupBy("_of").agg(F.count(F.lit(1)).alias(SIZE), F.min(f"`{index}`").alias(LEAST), F.max(f"`{index}`").alias(MOST))
    held = materialise(sizes.withColumn(CLASS, F.monotonically_increasing_id()), "classes")
    elements = held.select(CLASS, SIZE, LEAST, MOST, F.explode("_of").alias("_one")).select(CLASS, SIZE, LEAST, MOST, "_one.*")
    elements = materialise(elements.withColumn(ELEMENT, F.monotonically_increasing_id()), "elements")
    members = materialise(per_id.join(held.select("_of", CLASS, LEAST), "_of").select(F.col(f"`{index}`"), CLASS, LEAST), "members")
    return Classes(index, members, elements)
