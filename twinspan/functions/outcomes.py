"""Outcomes of comparing two values of a field, by the field's category."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

AGREEMENT, DISAGREEMENT, MISSING, SWAPPED = "Agreement", "Disagreement", "Missing", "Swapped"


def _trimmed(c: Column) -> Column:
    """The value as text without white space around it; null where nothing is left."""
    text = F.regexp_replace(c.cast("string"), r"^\s+|\s+$", "")
    return F.when(F.length(text) > 0, text)


def _digits(c: Column) -> Column:
    return F.regexp_replace(_trimmed(c), r"[^0-9]", "")


def _date(c: Column) -> Column:
    """Year, month and day as eight digits: of a date, a timestamp, or a text that begins with them in this order, parted
    by anything or nothing; null for others."""
    day = F.substring(_digits(c), 1, 8)
    return F.when((F.length(day) == 8) & F.substring(day, 5, 2).between("01", "31") & F.substring(day, 7, 2).between("01", "31"), day)


def outcome(category: str, left: Column, right: Column) -> Column:
    """One of the category's outcomes for a pair of values.

    Blank values are Missing, or Disagreement where the category knows no Missing. Text agrees if it is equal without the
    white space around it, numbers by value, SIN numbers by their digits. Dates agree if they are one day, and are Swapped
    if month and day have changed places; values that are no dates are compared as text.
    """
    from twinspan.plans.catalog import FIELD_CATEGORIES

    known = {name: outcomes for name, _, outcomes in FIELD_CATEGORIES}
    if category not in known:
        raise KeyError(f"unknown field category {category}")
    a, b = _trimmed(left), _trimmed(right)
    missing = a.isNull() | b.isNull()
    agrees = a == b
    if category == "numeric_field":
        agrees = left.try_cast("double") == right.try_cast("double")
    elif category == "sin_field":
        x, y = _digits(left), _digits(right)
        agrees = F.when((x != "") & (y != ""), x == y).otherwise(agrees)
    elif SWAPPED in known[category]:
        x, y = _date(left), _date(right)
        agrees = F.when(x.isNotNull() & y.isNotNull(), x == y).otherwise(agrees)
    found = F.when(missing, MISSING if MISSING in known[category] else DISAGREEMENT).when(F.coalesce(agrees, F.lit(False)), AGREEMENT)
    if SWAPPED in known[category]:
        turned = F.concat(F.substring(y, 1, 4), F.substring(y, 7, 2), F.substring(y, 5, 2))
        found = found.when(F.coalesce(x == turned, F.lit(False)), SWAPPED)
    return found.otherwise(DISAGREEMENT)
