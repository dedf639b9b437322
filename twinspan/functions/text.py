"""String helpers as column expressions."""

from __future__ import annotations

import unicodedata

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType


def blank_to_null(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """Strings of white space only become null, in the given columns or in all string columns."""
    names = [f.name for f in df.schema if isinstance(f.dataType, StringType) and (columns is None or f.name in columns)]
    return df.withColumns({n: F.when(~F.col(f"`{n}`").rlike(r"^\s*$"), F.col(f"`{n}`")) for n in names}) if names else df


def is_empty(c: Column) -> Column:
    """Null, or nothing when shown as text."""
    return c.isNull() | F.coalesce(F.length(c.cast("string")) == 0, F.lit(False))


def py_slice(c: Column, start: int | None, end: int | None) -> Column:
    """Python's c[start:end]: negative places count from the end, places beyond are clamped."""
    c = c.cast("string")
    n = F.length(c)

    def place(i: int) -> Column:
        return F.least(F.lit(i), n) if i >= 0 else F.greatest(n + i, F.lit(0))

    first = place(start or 0)
    last = n if end is None else place(end)
    return F.substring(c, first + 1, F.greatest(last - first, F.lit(0)))


def folding(wide: bool = False) -> tuple[str, str]:
    """Latin letters with marks below U+0250, and the ASCII letter that each decomposes to; wide: also those of the later
    Latin blocks and the full-width forms."""
    pairs = []
    for point in [*range(0xC0, 0x250), *([*range(0x1E00, 0x1F00), *range(0xFF21, 0xFF5B)] if wide else [])]:
        base = unicodedata.normalize("NFKD", chr(point))[0]
        if base.isascii() and base.isalpha():
            pairs.append((chr(point), base))
    return "".join(a for a, _ in pairs), "".join(b for _, b in pairs)


def fold(c: Column) -> Column:
    """Upper case without marks, as phonetic codes want it."""
    return F.upper(F.translate(c.cast("string"), *folding()))
