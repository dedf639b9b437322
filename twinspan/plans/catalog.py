"""What the library offers: algorithms, field categories, version."""

from __future__ import annotations

from typing import Any

from pyspark.sql import DataFrame, SparkSession

import twinspan
from twinspan.functions import algorithms as registered

# Names by which callers ask for field categories, with their outcomes.
FIELD_CATEGORIES = [
    ("firstname_field", "First name field", ["Agreement", "Disagreement", "Missing"]),
    ("lastname_field", "Last name field", ["Agreement", "Disagreement", "Missing"]),
    ("middlename_field", "Middle name field", ["Agreement", "Disagreement", "Missing"]),
    ("data_field", "Date of Birth field", ["Agreement", "Disagreement", "Missing", "Swapped"]),
    ("sin_field", "SIN field", ["Agreement", "Disagreement", "Missing"]),
    ("string_field", "General String field", ["Agreement", "Disagreement"]),
    ("numeric_field", "General Numeric field", ["Agreement", "Disagreement"]),
]


def algorithms() -> dict[str, Any]:
    """Names and titles of blocking and linking algorithms, the latter by method, and the arguments they take."""
    kinds = {"DTR": registered("DTR", None), "PRB": registered("PRB", None)}
    return {
        "blocking": [(k, a.title) for k, a in registered("TSF").items()],
        "linking": {m: [(k, a.title) for k, a in found.items()] for m, found in kinds.items()},
        "args": {m: {k: list(a.args) for k, a in found.items()} for m, found in kinds.items()},
    }


def algorithms_frame(spark: SparkSession) -> DataFrame:
    """name, title, kind (null: any method), args, tags and built_in (no plugin's) of every algorithm."""
    kinds = (["TSF"], [None, "DTR", "PRB"])
    rows = [(a.name, a.title, a.kind, list(a.args), list(a.tags), a.fn.__module__.startswith("twinspan.functions.")) for k in kinds for a in registered(*k).values()]
    return spark.createDataFrame(rows, "name string, title string, kind string, args array<string>, tags array<string>, built_in boolean")


def field_categories() -> list[tuple[str, str]]:
    return [(name, title) for name, title, _ in FIELD_CATEGORIES]


def info() -> dict[str, str]:
    return {"version": twinspan.__version__}
