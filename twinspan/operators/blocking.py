"""Candidate pairs: an equi-join of records on encoded blocking fields.

Three things make the join's candidates fewer, or more even, without changing its pairs. Where a comparison accepts only
numbers at most t apart, numbers are cut into bands t/2 wide: a right record is in the band of its number, a left one in
the five or so bands that its partners can be in, and the band is a further key. So numbers that meet are at most 1.5 t apart. Where one accepts only texts few edits
apart, big blocks, measured if asked, are joined on segments of the texts. Blocks of many records, measured too, are cut
into chunks of both sides, and each chunk meets each of the other side under a key of its own, so that many tasks share a
block. A dataset against itself needs each two chunks only once.
"""

from __future__ import annotations

import math
from dataclasses import replace
from functools import reduce

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BinaryType, MapType, StringType, StructType, VariantType

from twinspan.functions import comparator, encoder
from twinspan.functions.text import blank_to_null
from twinspan.plans.spec import Comparison, Step

from .segments import segmented
from .storage import materialise

LEFT, RIGHT = "LEFT_", "RIGHT_"
#: Records from which blocks are joined on segments of texts where a comparison counts edits.
HOT_ROWS = 1 << 15
#: Records of one side and block beyond which the block is cut into chunks, of as many or, in large tables, of more.
CHUNK_ROWS = 1 << 11
#: Pairs up to which blocks are joined as they are, and pairs that a task makes otherwise.
FEW_PAIRS, TASK_PAIRS = 1 << 22, 1 << 25
#: Pairs of records for each pair of their texts from which texts are compared first.
REPEATED = 64
#: Tasks that give records the texts, or the chunks, they pair with: small tables come in one.
READERS = 64
#: Bytes of a record, on average of a block, up to which those of a chunk are put into one array, and pairs for each record
#: from which that is done.
PACKED_BYTES, PACK_GAIN = 128, 16
#: Pairs of chunks that a large table is cut into, about, and records of a chunk at most.
CHUNK_PAIRS, MOST_ROWS = 1 << 12, 1 << 15
#: Tasks of one join at most.
MOST_TASKS = 10_000
#: Bands beyond this one, of either sign, are one: rounding could move a number by a band there.
_LAST_BAND = float(1 << 40)


def keyed(df: DataFrame, step: Step, side: str, carry: list[str]) -> DataFrame:
    """carry columns with _k0.. (encoded keys) and _c0.. (what comparators read), and for PRB steps _p0.. (whether the
    compared field is there). Records with a null key field are out.

    Encodings, prepared values and the parts that comparisons want equal are made here, once per record and not once per
    pair. Fields of white space only
    count as null, for keys and comparators alike.
    """
    place = 0 if side == "left" else 1
    keys, compared = step.keys(), step.compared()
    fields = list(dict.fromkeys([k[place] for k in keys] + [c[place] for c in compared]))
    clean = df.select(*dict.fromkeys([*carry, *fields])).withColumns({f"_f{i}": F.col(f"`{f}`") for i, f in enumerate(fields)})
    clean = blank_to_null(clean, [f"_f{i}" for i in range(len(fields))])
    own = {f: f"_f{i}" for i, f in enumerate(fields)}
    clean = clean.dropna(subset=[own[k[place]] for k in keys])
    for i, c in enumerate(compared):
        algorithm = comparator(c[2].name)
        field = own[c[place]]
        clean = algorithm.prepare(clean, field, f"_c{i}", **algorithm.checked(c[2].args)) if algorithm.prepare else clean.withColumn(f"_c{i}", F.col(field))
        if algorithm.key:
            clean = clean.withColumn(f"_c{i}", algorithm.key(F.col(f"_c{i}"), **algorithm.checked(c[2].args)))
        if algorithm.alone and step.method != "PRB":
            clean = clean.where(algorithm.alone(F.col(f"_c{i}"), **algorithm.checked(c[2].args)))
    with_presence = [f"_p{i}" for i in range(len(compared))] if step.method == "PRB" else []
    clean = clean.withColumns({p: F.col(own[c[place]]).isNotNull() for p, c in zip(with_presence, compared, strict=False)})
    clean = clean.withColumns({f"_k{i}": encoder(k[2]).apply(F.col(own[k[place]])) for i, k in enumerate(keys)})
    return clean.select(*carry, *[f"_k{i}" for i in range(len(keys))], *[f"_c{i}" for i in range(len(compared))], *with_presence)


def _place(number: Column, width: float, shift: float, slack: int) -> Column:
    """number + shift in bands, moved by rounding's reach in the direction of slack."""
    at = number.try_cast("double") / F.lit(width)
    moved = at + F.lit(shift / width) + F.lit(slack * 1e-14) * (F.least(F.abs(at), F.lit(2 * _LAST_BAND)) + 1)
    return F.floor(F.greatest(F.least(moved, F.lit(_LAST_BAND)), F.lit(-_LAST_BAND))).cast("long")


def apart_of(c: Comparison) -> float | None:
    """How far two numbers that a comparison accepts may be apart, if that is bounded."""
    algorithm = comparator(c.name)
    apart = algorithm.band(**algorithm.checked(c.args)) if algorithm.band else None
    return apart if apart is not None and 0 <= apart < float("inf") else None


def banded(a: DataFrame, b: DataFrame, step: Step, agree: int | None = None) -> tuple[DataFrame, DataFrame, bool]:
    """Both sides with the key _band, and whether they have it: of the first comparison with a band, if any. agree: of that
    comparison, also for PRB steps.

    Numbers exactly equal are one band for t = 0. A value that is no number matches nothing.
    """
    for i, (_, _, c) in enumerate(step.compared()):
        apart = apart_of(c) if (step.method != "PRB" if agree is None else i == agree) else None
        if apart is None:
            continue
        x, y = F.col(f"{LEFT}_c{i}"), F.col(f"{RIGHT}_c{i}")
        if apart == 0:
            return a.withColumn(f"{LEFT}_band", x.try_cast("double")), b.withColumn(f"{RIGHT}_band", y.try_cast("double")), True
        width = apart / 2 or 2.0 * apart  # half of the least double is 0
        both = F.sequence(_place(x, width, -apart, -1), _place(x, width, apart, 1))
        # only bands that are there can have partners, so copies are made after missing numbers are gone
        return a.where(x.try_cast("double").isNotNull()).withColumn(f"{LEFT}_band", F.explode(both)), b.withColumn(f"{RIGHT}_band", _place(y, width, 0.0, 0)), True
    return a, b, False


def keyed_alike(a: DataFrame, b: DataFrame, step: Step) -> tuple[DataFrame, DataFrame, list[str]]:
    """Both sides without records that lack a value that a comparison wants equal, and the names of these values: more keys.

    Where a comparison takes two missing values as equal, the key is a struct of the value, which is never null.
    """
    if step.method == "PRB":
        return a, b, []
    equal = [f"_c{i}" for i, (_, _, c) in enumerate(step.compared()) if comparator(c.name).key]
    a, b = a.dropna(subset=[LEFT + k for k in equal]) if equal else a, b.dropna(subset=[RIGHT + k for k in equal]) if equal else b
    safe = [f"_c{i}" for i, (_, _, c) in enumerate(step.compared()) if comparator(c.name).null_safe and a.schema[f"{LEFT}_c{i}"].dataType == b.schema[f"{RIGHT}_c{i}"].dataType]
    a, b = (x.withColumns({side + k: F.struct(F.col(side + k).alias("value")) for k in safe}) for x, side in ((a, LEFT), (b, RIGHT)))
    return a, b, equal + safe


def _sizes(a: DataFrame, b: DataFrame, keys: list[str], more: dict[str, tuple[Column, Column]] | None = None, bytes_of: tuple[Column | None, Column | None] = (None, None), alike: bool = False) -> DataFrame:
    """Records l and r of the two sides in each block, and of each value of more: name -> the column of either side; and the
    bytes of either side's records, bytes_l and bytes_r. alike: both sides hold the same records, so one is counted."""
    more, none = more or {}, F.lit(0).cast("long")
    bytes_of = [none if c is None else c for c in bytes_of]
    by = [*keys, *more]
    if alike:
        seen = b.select(*[F.col(RIGHT + k).alias(k) for k in keys], *[c[1].alias(k) for k, c in more.items()], bytes_of[1].alias("bytes"))
        n, size = F.count(F.lit(1)), F.sum("bytes")
        return seen.groupBy(*by).agg(n.alias("l"), n.alias("r"), size.alias("bytes_l"), size.alias("bytes_r"))
    ends = []
    for side, records, own in ((LEFT, a, 0), (RIGHT, b, 1)):
        number = {"l": F.lit(1 - own), "r": F.lit(own), "bytes_l": none if own else bytes_of[0], "bytes_r": bytes_of[1] if own else none}
        ends.append(records.select(*[F.col(side + k).alias(k) for k in keys], *[c[own].alias(k) for k, c in more.items()], *[c.alias(k) for k, c in number.items()]))
    return ends[0].unionByName(ends[1]).groupBy(*by).agg(*[F.sum(k).alias(k) for k in ("l", "r", "bytes_l", "bytes_r")])


def valued(a: DataFrame, b: DataFrame, step: Step, keys: list[str], hot_rows: int | None = None, alike: bool = False) -> tuple[DataFrame, DataFrame, list[str], int | None]:
    """Both sides, the keys to join them on, and the place of the comparison that these keys decide, if any.

    Where records repeat their texts much, a dear comparison is made for each two texts of a block once. The accepted pairs
    of texts then join the left records, and the right text becomes a key, _val. Blocks are measured: that is done where
    there are more than FEW_PAIRS pairs, and at least REPEATED for each pair of texts.
    """
    for i, (_, _, c) in enumerate(step.compared()):
        algorithm = comparator(c.name)
        if not algorithm.decides or step.method == "PRB":
            continue
        values = {side: F.col(f"{side}_c{i}") for side in (LEFT, RIGHT)}
        texts = {side: algorithm.decides(value) for side, value in values.items()}
        per_text = _sizes(a, b, keys, {"_val": (texts[LEFT], texts[RIGHT])}, alike=alike)
        per_block = per_text.groupBy(*keys).agg(*[F.sum(k).cast("double").alias(k) for k in "lr"], *[F.count_if(F.col(k) > 0).cast("double").alias("of_" + k) for k in "lr"])
        seen = per_block.agg(F.sum(F.col("l") * F.col("r")).alias("pairs"), F.sum(F.col("of_l") * F.col("of_r")).alias("texts")).first()
        if (seen["pairs"] or 0) <= FEW_PAIRS or seen["pairs"] < REPEATED * seen["texts"]:
            continue
        once = {}
        for side, records in ((LEFT, a), (RIGHT, b)):
            by = [F.col(side + k) for k in keys]
            once[side] = records.groupBy(*by, texts[side].alias(side + "_val")).agg(F.first(values[side]).alias(f"{side}_c{i}"))
        x, y, on, first = once[LEFT], once[RIGHT], keys, None
        if hot_rows is not None:
            x, y, first = segmented(x, y, replace(step, link_left=(step.link_left[i],), link_right=(step.link_right or step.link_left)[i : i + 1], comparisons=(c,)), keys, place=i)
            on = ["_seg", *keys] if first is not None else keys
        met = meet(x, y, on, hot_rows)
        met = (met if first is None else met.where(first)).where(algorithm.apply(values[LEFT], values[RIGHT], **c.args))
        accepted = materialise(met.select(*[F.col(LEFT + k).alias(k) for k in keys], F.col(f"{LEFT}_val").alias("_own"), F.col(f"{RIGHT}_val").alias(f"{LEFT}_val")), "texts")
        same = [F.col(LEFT + k) == F.col(k) for k in keys] + [texts[LEFT] == F.col("_own")]
        left = a.repartition(READERS).join(accepted, reduce(Column.__and__, same)).drop(*keys, "_own", f"{LEFT}_c{i}")
        return left, b.withColumn(f"{RIGHT}_val", texts[RIGHT]).drop(f"{RIGHT}_c{i}"), [*keys, "_val"], i
    return a, b, keys, None


def _bytes_of(records: DataFrame, columns: list[str]) -> Column | None:
    """Bytes of a record's texts in these columns; None where some are nested, and may be of any size."""
    types = {f.name: f.dataType for f in records.schema if f.name in columns}
    if any(isinstance(t, (ArrayType, MapType, StructType, VariantType)) for t in types.values()):
        return None
    texts = [F.coalesce(F.octet_length(F.col(f"`{c}`")), F.lit(0)) for c, t in types.items() if isinstance(t, (StringType, BinaryType))]
    return reduce(Column.__add__, texts, F.lit(8 * len(types))).cast("long")


def _same(keys: list[str]) -> Column:
    return reduce(Column.__and__, [F.col(LEFT + k) == F.col(RIGHT + k) for k in keys])


def meet(a: DataFrame, b: DataFrame, keys: list[str], hot_rows: int | None = None, half: bool = False) -> DataFrame:
    """Pairs of records that agree on keys, dealt to tasks by their pairs: all columns of both sides, and _i and _j.

    Few pairs are left to one join on keys. Else the keys _i and _j are added, the chunks that meet: 0 in blocks of at most
    CHUNK_ROWS records a side (hot_rows, if given, also where there are few pairs). A record of a larger block is in one chunk
    of its own side, by a hash of all its columns, and comes once for each chunk of the other side, so each pair of records
    meets once. Chunks grow with the table, up to MOST_ROWS records, so that pairs of chunks stay about CHUNK_PAIRS and these
    copies grow as the records do and not as their pairs. Small tables are read by few tasks, so records are dealt to READERS
    tasks before they are copied. A block's bytes say nothing about its pairs, so the number of tasks is set, and the join
    sorts: a broadcast would leave all pairs to the few tasks that read the other side. Narrow right records of a chunk are first
    put into one array, which is copied, joined and then unfolded: that costs a pair far less than a join of records does. It
    pays in blocks of many pairs alone, so it is done where there are PACK_GAIN pairs for a record.

    half: both sides hold the same records, and of two chunks only the lesser meets the greater, so a pair of different
    chunks comes once, in any order, and one of the same chunk in both.
    """
    least = min(hot_rows or CHUNK_ROWS, CHUNK_ROWS)
    others = {side: [c for c in records.columns if c.removeprefix(side) not in keys] for side, records in ((LEFT, a), (RIGHT, b))}
    size = {side: _bytes_of(records, others[side]) for side, records in ((LEFT, a), (RIGHT, b))}
    sizes = _sizes(a, b, keys, bytes_of=(size[LEFT], size[RIGHT]), alike=half).where(F.least("l", "r") > 0)
    seen = Observation()
    sizes = sizes.observe(
        seen, F.sum(F.col("l").cast("double") * F.col("r")).alias("pairs"), F.sum(F.col("l") + F.col("r")).alias("rows"),
        F.max(F.col("bytes_l") / F.col("l")).alias(LEFT), F.max(F.col("bytes_r") / F.col("r")).alias(RIGHT), F.count_if(F.greatest("l", "r") > least).alias("hot"),
    )
    hot = materialise(sizes.where(F.greatest("l", "r") > least).select(*keys, "l", "r"), "hot-blocks")
    pairs = seen.get["pairs"] or 0
    dealt = pairs > FEW_PAIRS
    if hot_rows is None and not dealt:
        chunk = {f"{side}_{c}": F.lit(0) for side in (LEFT, RIGHT) for c in "ij"}
        return a.join(b, _same(keys)).withColumns(chunk)
    most = max(least, min(math.ceil(math.sqrt(pairs / CHUNK_PAIRS)), MOST_ROWS))
    tasks = min(max(math.ceil(pairs / TASK_PAIRS), 48), MOST_TASKS)
    gains = dealt and pairs > PACK_GAIN * seen.get["rows"]
    packs = {side: gains and size[side] is not None and bool(others[side]) and (seen.get[side] or 0) <= PACKED_BYTES and side == RIGHT for side in (LEFT, RIGHT)}
    of = lambda c: F.ceil(F.col(c) / most).cast("int")
    on = [*keys, "_i", "_j"] if seen.get["hot"] else keys  # constants would be left out of the join, and not of the dealing
    out = {}
    for side, records, own, other in ((LEFT, a, "l", "r"), (RIGHT, b, "r", "l")):
        met = hot.select(*[F.col(k).alias(side + k) for k in keys], of(own).alias("_own"), of(other).alias("_other"))
        mine = F.pmod(F.xxhash64(*[F.col(f"`{c}`") for c in records.columns]), F.coalesce("_own", F.lit(1))).cast("int")
        names = (side + "_i", side + "_j") if side == LEFT else (side + "_j", side + "_i")
        last = F.coalesce("_other", F.lit(1)) - 1
        theirs = F.sequence(F.lit(0), last) if not half else F.sequence(F.col(names[0]), last) if side == LEFT else F.sequence(F.lit(0), F.col(names[0]))
        by = [side + k for k in keys]
        if seen.get["hot"]:
            records = records.repartition(READERS, *[F.col(f"`{c}`") for c in records.columns]) if dealt else records
            cut = records.join(met, by, "left").withColumn(names[0], mine)
        else:  # no block is cut, so nothing is copied
            cut = records.withColumns({names[0]: F.lit(0), "_own": F.lit(1), "_other": F.lit(1)})
        if packs[side]:
            cut = cut.groupBy(*by, names[0], "_other").agg(F.collect_list(F.struct(*[F.col(f"`{c}`") for c in others[side]])).alias(side + "_all"))
        cut = cut.withColumn(names[1], F.explode(theirs) if seen.get["hot"] else F.lit(0)).drop("_own", "_other")
        if dealt:
            cut = cut.repartition(tasks, *[F.col(side + k) for k in on])
        out[side] = cut
    if not dealt:
        return out[LEFT].join(out[RIGHT], _same(on))
    met = out[LEFT].hint("merge").join(out[RIGHT].hint("merge"), _same(on))
    for side in (LEFT, RIGHT):
        if packs[side]:
            kept = [c for c in met.columns if c != side + "_all"]
            met = met.withColumn(side + "_one", F.explode(side + "_all")).select(*[F.col(f"`{c}`") for c in kept], *[F.col(f"{side}_one.`{c}`").alias(c) for c in others[side]])
    return met.select(*[F.col(f"`{c}`") for side, records in ((LEFT, a), (RIGHT, b)) for c in [*records.columns, side + "_i", side + "_j"]])


def pair(left: DataFrame, right: DataFrame, step: Step, left_carry: list[str], right_carry: list[str], once: tuple[str, str] | None = None, hot_rows: int | None = None, agree: int | None = None, made: DataFrame | None = None) -> DataFrame:
    """Pairs of records that agree on all encoded keys: LEFT_* and RIGHT_* of the carried columns and of _c0...

    once: for one dataset against itself, the id columns; each pair then comes once, the smaller id left. Ids are
    compared by their own type: numbers by value, strings by code point. A record without an id then pairs with nothing,
    and rows that share an id not with each other. An empty side gives no pairs. Of pairs whose numbers are too far apart
    for a comparison of the step, or whose texts are too many edits apart, some are left out already. hot_rows: measure
    blocks, join big ones on segments where a comparison counts edits, and cut those of more records. agree: the place of a
    comparison with a key or a band, and only pairs that may agree in it. made: what keyed() gives for either side, if known.
    """
    made_alike = made is not None or left is right and left_carry == right_carry and all(k[0] == k[1] for k in [*step.keys(), *step.compared()])
    a = keyed(left, step, "left", left_carry) if made is None else made
    if made is None and hot_rows is not None:  # blocks are measured, so keys would be made several times
        a = materialise(a, "keyed")
    b = a if made_alike else keyed(right, step, "right", right_carry)
    b = materialise(b, "keyed") if hot_rows is not None and not made_alike else b
    a, b = a.select(*[F.col(f"`{c}`").alias(LEFT + c) for c in a.columns]), b.select(*[F.col(f"`{c}`").alias(RIGHT + c) for c in b.columns])
    a, b, with_band = banded(a, b, step, agree)
    keys = [*(["_band"] if with_band else []), *[f"_k{i}" for i in range(len(step.keys()))]]
    if agree is not None and not with_band:
        a, b = a.withColumn(f"{LEFT}_same", F.col(f"{LEFT}_c{agree}")).dropna(subset=[f"{LEFT}_same"]), b.withColumn(f"{RIGHT}_same", F.col(f"{RIGHT}_c{agree}")).dropna(subset=[f"{RIGHT}_same"])
        keys += ["_same"]
    a, b, equal = keyed_alike(a, b, step)
    keys += equal
    a, b, keys, decided = valued(a, b, step, keys, hot_rows, made_alike and not with_band)
    first = None
    if hot_rows is not None and decided is None:
        a, b, first = segmented(a, b, step, keys)
        keys = ["_seg", *keys] if first is not None else keys  # numbers first: joins sort them faster than texts
    half = bool(once) and made_alike and not with_band and decided is None and first is None
    joined = meet(a, b, keys, hot_rows, half)
    keys += ["_i", "_j"]
    if once:  # before texts are compared
        x, y = F.col(f"`{LEFT}{once[0]}`"), F.col(f"`{RIGHT}{once[1]}`")
        joined = joined.where((x < y) if not half else (x < y) | ((F.col(f"{LEFT}_i") != F.col(f"{LEFT}_j")) & (x > y)))
    if first is not None:
        joined = joined.where(first)
    if half:  # pairs of different chunks come in any order
        ends = [c.removeprefix(LEFT) for c in a.columns if c.removeprefix(LEFT) not in keys]
        of = lambda c, this, other: F.when(x < y, F.col(f"`{this}{c}`")).otherwise(F.col(f"`{other}{c}`")).alias(this + c)
        joined = joined.select(*[of(c, LEFT, RIGHT) for c in ends], *[of(c, RIGHT, LEFT) for c in ends])
    alone = [f"_c{i}" for i, (_, _, c) in enumerate(step.compared()) if comparator(c.name).alone and step.method != "PRB"]
    own = {side + k for side in (LEFT, RIGHT) for k in [*keys, *alone, "_big", "_part", "_way"]}
    return joined.select(*[F.col(f"`{c}`") for c in joined.columns if c not in own])
