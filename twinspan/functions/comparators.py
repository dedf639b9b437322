"""Comparators: each makes a boolean column, never null, of a pair's left and right value."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import encoders
from .phonetic import jaro_winkler_may_reach, jaro_winkler_udf, letters
from .registry import DETERMINISTIC, register
from .synonyms import with_root
from .text import is_empty, py_slice


def _sure(c: Column) -> Column:
    return F.coalesce(c, F.lit(False))


def _encoded(encode):
    def prepare(df: DataFrame, field: str, target: str, **_) -> DataFrame:
        return df.withColumn(target, encode(F.col(f"`{field}`")))

    return prepare


@register("EXACT", "Equal, or both missing", None, null_safe=True, tags=("strings", "numbers", "dates"), symmetric=True)
def exact(left: Column, right: Column) -> Column:
    return left.eqNullSafe(right)


@register("BOTH_EMPTY", "Both empty", None, of_presence=True, alone=is_empty, symmetric=True)
def both_empty(left: Column, right: Column) -> Column:
    return is_empty(left) & is_empty(right)


@register("ONE_EMPTY", "Exactly one empty", None, of_presence=True, symmetric=True)
def one_empty(left: Column, right: Column) -> Column:
    return is_empty(left) != is_empty(right)


@register("BOTH_EXIST", "Neither empty", None, of_presence=True, alone=lambda c: ~is_empty(c), symmetric=True)
def both_exist(left: Column, right: Column) -> Column:
    return ~is_empty(left) & ~is_empty(right)


@register("SOUNDEX", "Equal Soundex codes", None, key=lambda c: c, prepare=_encoded(encoders.soundex), tags=("strings",), symmetric=True)
def soundex(left: Column, right: Column) -> Column:
    return _sure(left == right)


@register("NYSIIS", "Equal NYSIIS codes", None, key=lambda c: c, prepare=_encoded(encoders.nysiis), tags=("strings",), symmetric=True)
def nysiis(left: Column, right: Column) -> Column:
    return _sure(left == right)


def _part(c: Column, start: int, end: int) -> Column:
    return py_slice(c, start, end)


def _head(c: Column, n: int) -> Column:
    return py_slice(c, 0, n)


def _tail(c: Column, n: int) -> Column:
    return py_slice(c, -n, None)


@register("SLICE_MATCH", "Equal parts", None, args=("start", "end"), defaults={"start": 0, "end": 0}, key=_part, tags=("strings", "dates"), symmetric=True)
def slice_match(left: Column, right: Column, start: int, end: int) -> Column:
    return _sure(_part(left, start, end) == _part(right, start, end))


@register("HEAD_MATCH", "Equal beginnings", None, args=("n",), defaults={"n": 0}, key=_head, tags=("strings", "dates"), symmetric=True)
def head_match(left: Column, right: Column, n: int) -> Column:
    return _sure(_head(left, n) == _head(right, n))


@register("TAIL_MATCH", "Equal ends", None, args=("n",), defaults={"n": 0}, key=_tail, tags=("strings", "dates"), symmetric=True)
def tail_match(left: Column, right: Column, n: int) -> Column:
    """n = 0 compares the whole values."""
    return _sure(_tail(left, n) == _tail(right, n))


def _of_length(c: Column, length: int) -> Column:
    return _sure(F.length(c.cast("string")) == length)


@register("FIXED_LEN", "Both of one length", None, args=("length",), defaults={"length": 0}, alone=_of_length, symmetric=True)
def fixed_len(left: Column, right: Column, length: int) -> Column:
    return _of_length(left, length) & _of_length(right, length)


def _equals(c: Column, value) -> Column:
    kind = F.typeof(c)
    if isinstance(value, bool):
        return _sure((kind == "boolean") & (c.cast("string") == str(value).lower()))
    if isinstance(value, str):
        return _sure((kind == "string") & (c.cast("string") == value))
    return _sure(~kind.isin("string", "boolean", "binary") & (c.try_cast("double") == float(value)))


@register("FIXED_VAL", "Both equal to a value", None, args=("value",), alone=_equals, symmetric=True)
def fixed_val(left: Column, right: Column, value) -> Column:
    """A text matches only text columns, a number only numbers, true and false only booleans."""
    return _equals(left, value) & _equals(right, value)


@register("ABS_DIFF", "Numbers close to each other", None, args=("threshold",), defaults={"threshold": 0}, band=lambda threshold: threshold, tags=("numbers",), symmetric=True)
def abs_diff(left: Column, right: Column, threshold: float) -> Column:
    return _sure(F.abs(left - right) <= F.lit(threshold))


@register("LEVENSHTEIN", "Few edits apart", DETERMINISTIC, args=("max_edits",), defaults={"max_edits": 0}, edits=lambda max_edits: max_edits, decides=lambda c: F.coalesce(c.cast("string"), F.lit("")), tags=("strings",), symmetric=True)
def levenshtein(left: Column, right: Column, max_edits: int) -> Column:
    """A missing value counts as an empty text, so two of them match."""
    if max_edits < 0:
        return F.lit(False)
    left, right = (F.coalesce(c.cast("string"), F.lit("")) for c in (left, right))
    return F.levenshtein(left, right, max_edits) >= 0  # -1 beyond the threshold


def _with_letters(df: DataFrame, field: str, target: str, **_) -> DataFrame:
    text = F.coalesce(F.col(f"`{field}`").cast("string"), F.lit(""))
    return df.withColumn(target, F.struct(text.alias("text"), letters(text).alias("letters")))


@register("JARO_WINKLER", "Similar by Jaro-Winkler", DETERMINISTIC, args=("threshold",), defaults={"threshold": 1.0}, prepare=_with_letters, costly=True, decides=lambda c: c["text"], tags=("strings",))
def jaro_winkler(left: Column, right: Column, threshold: float) -> Column:
    """A missing value counts as an empty text; two empty texts have similarity 0."""
    may = jaro_winkler_may_reach(left["text"], right["text"], left["letters"], right["letters"], threshold)
    return may & (jaro_winkler_udf()(left["text"], right["text"]) >= threshold)


def _meaning(c: Column, table: str | None) -> Column:
    return F.when(c["root"].isNotNull(), F.concat(F.lit("="), c["root"])).when(c["name"] == "", F.lit(""))


@register("SYNONYMS", "Equal or synonymous names", DETERMINISTIC, args=("table",), defaults={"table": None}, prepare=with_root, key=_meaning, tags=("strings",), symmetric=True)
def synonyms(left: Column, right: Column, table: str | None) -> Column:
    """Both empty match; a name that the table lacks matches nothing. table: see with_root()."""
    return ((left["name"] == "") & (right["name"] == "")) | _sure(left["root"] == right["root"])
