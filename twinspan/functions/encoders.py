"""Encoders of blocking keys: EXACT, SOUNDEX, NYSIIS. Null stays null."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .phonetic import nysiis_column
from .registry import ENCODER, register
from .text import fold


@register("EXACT", "Exact value", ENCODER)
def exact(c: Column) -> Column:
    return c


@register("SOUNDEX", "Soundex code", ENCODER)
def soundex(c: Column) -> Column:
    """Spark's Soundex (H and W do not part equal codes) of the upper-case text without marks."""
    return F.soundex(fold(c))


@register("NYSIIS", "NYSIIS code", ENCODER)
def nysiis(c: Column) -> Column:
    return nysiis_column(c)
