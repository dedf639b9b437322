"""Texts few edits apart by segments: equi-keys for big blocks of a comparison that counts edits.

A right text is cut into most + 1 segments of even length. At most `most` edits leave one of them whole in the left text:
the first segment i, counted from 0, with at most i edits up to its end has none itself, so exactly i before it and at most
most - i behind it. The left text then holds segment i moved by at most i places, and by at most most - i places as counted
from the end. So a left record comes once for each length, segment and place that a partner could have, and a right one once
for each of its segments; both are keys of a join. A pair that shares several segments, or one in
several places, is kept under the first only.

One edit touches one of three segments at most, so there all but one are the key, which few texts share by chance: a right
text has three, a left one three for each length of the block's right texts that is at most one off its own.

That pays in big blocks alone, so blocks are measured: those whose records a side are over GAIN times the keys of a left
record are joined on segments, the others stay as they are. The accepted pairs are the same either way. Pairs that
share all segments, as equal texts do, are met once for each window of their lengths: 2, 5 or 8 times for 1, 2 or 3 edits.

Defined results: a missing text counts as an empty one; one shorter than the number of segments has empty ones, which every
text of a near length holds; repeated rows pair as often as they would without segments; an empty side gives no pairs.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from twinspan.functions import comparator
from twinspan.plans.spec import Step

from .storage import materialise

LEFT, RIGHT = "LEFT_", "RIGHT_"
#: Records of the smaller side of a block, for each key of a left record, beyond which the block is joined on segments.
GAIN = 16
#: Edits beyond which segments are short and shared by most texts; such comparisons join blocks as they are.
MOST_EDITS = 4
#: Segments where one edit is allowed: more of them make keys that fewer texts share, but more keys.
ONE_EDIT_PARTS = 3


def windows(most: int) -> list[tuple[int, int, int]]:
    """(longer, part, moved): how much longer the left text is, the segment, and how far it is moved there."""
    ways = []
    for longer in range(-most, most + 1):
        for part in range(most + 1):
            behind = most - part
            ways += [(longer, part, moved) for moved in range(max(-part, longer - behind), min(part, longer + behind) + 1)]
    return ways


def _begin(length: Column, part: Column | int, most: int) -> Column:
    """Where a segment of a text of that length begins, from 0."""
    return F.floor(length * part / F.lit(most + 1)).cast("int")


def _key(length: Column, part: Column, segment: Column) -> Column:
    return F.xxhash64(length.cast("int"), part.cast("int"), segment)


def _text(value: Column) -> Column:
    return F.coalesce(value.cast("string"), F.lit(""))


def ways(most: int) -> Column:
    """windows() as an array."""
    return F.array(*[F.struct(F.lit(d).alias("longer"), F.lit(i).alias("part"), F.lit(s).alias("moved")) for d, i, s in windows(most)])


def left_key(text: Column, way: Column, most: int) -> Column:
    """The key of the segment that a right text would share with this one in one of the ways(); null where it cannot."""
    n = F.length(text)
    length = n - way["longer"]
    begin = _begin(length, way["part"], most)
    size, at = _begin(length, way["part"] + 1, most) - begin, begin + way["moved"]
    return F.when((length >= 0) & (at >= 0) & (at + size <= n), _key(length, way["part"], F.substring(text, at + 1, size)))


def right_keys(text: Column, most: int) -> Column:
    """The key of each segment, in their order."""
    length = F.length(text)
    parts = []
    for i in range(most + 1):
        begin = _begin(length, i, most)
        parts.append(_key(length, F.lit(i), F.substring(text, begin + 1, _begin(length, i + 1, most) - begin)))
    return F.array(*parts)


def _number(part: Column, moved: Column, most: int) -> Column:
    return part * (2 * most + 1) + moved


def first_shared(left: Column, right: Column, most: int) -> Column:
    """The number of the first segment of the right text, and of the first way it is moved, that the left one holds as
    windows() has it; null where there is none."""
    n, length = F.length(left), F.length(right)
    longer = n - length
    found = []
    for i in range(most + 1):
        begin, behind = _begin(length, i, most), most - i
        size = _begin(length, i + 1, most) - begin
        segment = F.substring(right, begin + 1, size)
        for s in range(-i, i + 1):
            inside = (F.abs(longer - s) <= behind) & (begin + s >= 0) & (begin + s + size <= n)
            found.append(F.when(inside & (F.substring(left, begin + (s + 1), size) == segment), _number(F.lit(i), F.lit(s), most)))
    return F.coalesce(*found)


def one_edit_ways() -> Column:
    """(longer, part) as an array, for one edit: how much longer the left text is, and the segment of the right one, of
    ONE_EDIT_PARTS, that the edit is in."""
    return F.array(*[F.struct(F.lit(d).alias("longer"), F.lit(i).alias("part")) for d in (-1, 0, 1) for i in range(ONE_EDIT_PARTS)])


def _around(text: Column, begin: Column, behind: Column) -> tuple[Column, Column]:
    """What a text has before a place, and its last letters."""
    return F.substring(text, F.lit(1), begin), F.substring(text, F.length(text) - behind + 1, behind)


def _one_edit_keyed(df: DataFrame, side: str, text: Column) -> DataFrame:
    """A side with _way, (longer, part) or null where the block is not big, with _seg: the key of all but that segment, or 0.

    Step by step, as one expression would be more code than Java compiles."""
    way, big = F.col(f"{side}_way"), F.col(f"{side}_big").isNotNull()
    length, begin, end = (F.col(f"{side}_{c}") for c in ("length", "begin", "end"))
    df = df.withColumn(f"{side}_length", F.length(text) - way["longer"])
    if side == LEFT:  # only lengths that right texts of the block have
        df = df.where(~big | length.between(F.col(f"{side}_from"), F.col(f"{side}_to")))
    df = df.withColumns({f"{side}_begin": _begin(length, way["part"], ONE_EDIT_PARTS - 1), f"{side}_end": _begin(length, way["part"] + 1, ONE_EDIT_PARTS - 1)})
    df = df.where(~big | (end - begin + way["longer"] >= 0))
    key = F.xxhash64(length, way["part"], *_around(text, begin, length - end))
    return df.withColumn(f"{side}_seg", F.when(big, key).otherwise(F.lit(0).cast("long"))).drop(*[f"{side}_{c}" for c in ("length", "begin", "end")])


def one_edit_first(left: Column, right: Column, part: Column) -> Column:
    """Whether two texts are equal outside of a segment of the right one, and not outside of the one before it.

    Where they are equal outside of two segments, they are so outside of those between, and only the first of a text's
    segments can be empty, so one segment before tells whether there is an earlier one.
    """
    length = F.length(right)
    longer = F.length(left) - length
    begin, end, before = (_begin(length, part + i, ONE_EDIT_PARTS - 1) for i in (0, 1, -1))
    (a, z), (b, y) = (_around(text, begin, length - end) for text in (left, right))
    earlier = (part > 0) & (begin - before + longer >= 0) & (_around(left, begin, length - begin)[1] == _around(right, begin, length - begin)[1])
    return (a == b) & (z == y) & ~earlier


def edits_of(step: Step) -> tuple[int, int] | None:
    """The first comparison of a step that bounds the edits between two accepted texts: its place, and the bound."""
    for i, (_, _, c) in enumerate(step.compared()):
        algorithm = comparator(c.name)
        most = algorithm.edits(**algorithm.checked(c.args)) if algorithm.edits and step.method != "PRB" else None
        if most is not None and 0 <= most <= MOST_EDITS:
            return i, int(most)
    return None


def segmented(a: DataFrame, b: DataFrame, step: Step, keys: list[str], gain: int = GAIN, place: int | None = None) -> tuple[DataFrame, DataFrame, Column | None]:
    """Both sides with the key _seg, and what a pair that agrees on it must meet to come once; None where no comparison of
    the step bounds edits, and then without the key. In blocks that are not big, _seg is 0. place: where the compared column
    stands, if not where the step has it."""
    bound = edits_of(step)
    if bound is None:
        return a, b, None
    most, comparison = bound[1], step.compared()[bound[0]][2]
    place = bound[0] if place is None else place
    least = gain * len(windows(most))
    texts = {prefix: _text(F.col(f"{prefix}_c{place}")) for prefix in (LEFT, RIGHT)}
    length = F.length(texts[RIGHT])
    ends = [
        a.select(*[F.col(LEFT + k).alias(k) for k in keys], F.lit(1).alias("l"), F.lit(0).alias("r"), F.lit(None).cast("int").alias("n")),
        b.select(*[F.col(RIGHT + k).alias(k) for k in keys], F.lit(0).alias("l"), F.lit(1).alias("r"), length.alias("n")),
    ]
    sizes = ends[0].unionByName(ends[1]).groupBy(*keys).agg(F.sum("l").alias("l"), F.sum("r").alias("r"), F.min("n").alias("_from"), F.max("n").alias("_to"))
    big = materialise(sizes.where(F.least("l", "r") > least).select(*keys, F.lit(True).alias("_big"), "_from", "_to"), "big-blocks")
    more = {LEFT: ("_big", "_from", "_to"), RIGHT: ("_big",)}
    met = {prefix: big.select(*[F.col(k).alias(prefix + k) for k in keys], *[F.col(c).alias(prefix + c) for c in more[prefix]]) for prefix in (LEFT, RIGHT)}
    left, right = (side.join(met[prefix], [prefix + k for k in keys], "left") for side, prefix in ((a, LEFT), (b, RIGHT)))
    # most pairs of a key are too many edits apart, and counting edits costs less than finding the first key does
    close = comparator(comparison.name).apply(F.col(f"{LEFT}_c{place}"), F.col(f"{RIGHT}_c{place}"), **comparison.args)
    own = lambda prefix, many, one: F.when(F.col(prefix + "_big"), many).otherwise(F.array(one))
    way = F.col(f"{LEFT}_way")
    if most == 1:
        none = F.lit(None).cast("struct<longer:int,part:int>")
        of_right = F.array(*[F.struct(F.lit(0).alias("longer"), F.lit(i).alias("part")) for i in range(ONE_EDIT_PARTS)])
        left = _one_edit_keyed(left.withColumn(f"{LEFT}_way", F.explode(own(LEFT, one_edit_ways(), none))), LEFT, texts[LEFT]).drop(f"{LEFT}_way", *[LEFT + c for c in more[LEFT]])
        right = _one_edit_keyed(right.withColumn(f"{RIGHT}_way", F.explode(own(RIGHT, of_right, none))), RIGHT, texts[RIGHT])
        right = right.withColumn(f"{RIGHT}_part", F.col(f"{RIGHT}_way")["part"]).drop(f"{RIGHT}_way", f"{RIGHT}_big")
        part = F.col(f"{RIGHT}_part")
        return left, right, part.isNull() | close & one_edit_first(texts[LEFT], texts[RIGHT], part)
    none = F.lit(None).cast("struct<longer:int,part:int,moved:int>")
    left = left.withColumn(f"{LEFT}_way", F.explode(own(LEFT, ways(most), none)))
    left = left.withColumn(f"{LEFT}_seg", F.when(F.col(f"{LEFT}_big"), left_key(texts[LEFT], way, most)).otherwise(F.lit(0).cast("long")))
    left = left.where(F.col(f"{LEFT}_seg").isNotNull()).withColumn(f"{LEFT}_way", way["moved"]).drop(*[LEFT + c for c in more[LEFT]])
    right = right.select("*", F.posexplode(own(RIGHT, right_keys(texts[RIGHT], most), F.lit(0).cast("long"))).alias(f"{RIGHT}_part", f"{RIGHT}_seg"))
    met_as = _number(F.col(f"{RIGHT}_part"), F.col(f"{LEFT}_way"), most)
    return left, right, F.col(f"{RIGHT}_big").isNull() | close & (first_shared(texts[LEFT], texts[RIGHT], most) == met_as)
