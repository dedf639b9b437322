"""Checks of a project before anything is read: every fault found is reported at once, by code."""

from __future__ import annotations

import warnings
from collections.abc import Callable
from typing import Any

from twinspan.functions import comparator, encoder
from twinspan.functions.synonyms import has_default
from twinspan.operators.storage import is_plain_name

from .spec import DEDUP, LINK, METHODS, RELATIONSHIPS, step_from

# The codes that callers match on, with what they say.
MESSAGES = {
    "NO_PROJECT": "There is no project.",
    "INVALID_TYPE": "The project's type is neither LINK nor DEDUP.",
    "TYPE_MISSING": "The project has no type.",
    "OUT_PATH_MISSING": "The project does not say where results go.",
    "NO_STEPS": "The project has no steps.",
    "NAME_MISSING": "The project has no name.",
    "DATASET_MISSING": "A dataset is missing.",
    "INDEX_MISSING": "A dataset does not name its index field.",
    "FILEPATH_MISSING": "A dataset does not name its file.",
    "NO_BLOCKING": "A step has no blocking fields.",
    "NO_LINKING": "A step has no linking fields.",
    "NO_LINKING_METHOD": "A step has no linking method.",
    "ENTITY_ID_MISSING": "A dataset to link does not name its entity field.",
    "INVALID_PATH": "A dataset's file cannot be read.",
    "INVALID_INDEX": "A dataset lacks its index field.",
    "INVALID_ENTITY_FIELD": "A dataset lacks its entity field.",
    "INVALID_RELATIONSHIP": "The relationship is none of 1T1, 1TM and MT1.",
    "INVALID_METHOD": "A step's linking method is neither DTR nor PRB.",
    "INVALID_PROBABILITY": "A step's probability is not between 0 and 1.",
    "UNKNOWN_ALGORITHM": "A step names a transformation or comparison that is not registered.",
    "INVALID_ARGUMENT": "A comparison is given an argument it does not take.",
    "DUPLICATE_IDS": "A dataset's index repeats.",
    "UNKNOWN_COLUMN": "A step uses a column that its dataset lacks.",
    "INVALID_RUN_ID": "The project's task_uuid is not the name of one folder.",
    "SYNONYMS_MISSING": "A step compares by SYNONYMS, but no table of synonyms is named.",
}


class ValidationError(ValueError):
    """codes: of all faults found, in order, each once."""

    def __init__(self, codes: list[str]) -> None:
        self.codes = list(dict.fromkeys(codes))
        super().__init__("Validation Error(s):\n" + "".join(f"\t{c}: {MESSAGES[c]}\n" for c in self.codes))


def _is_probability(value: Any) -> bool:
    return isinstance(value, (int, float)) and not isinstance(value, bool) and 0 <= value <= 1


def _step_faults(raw: dict[str, Any], synonyms: str | None) -> list[str]:
    found = []
    block, link = raw.get("blocking_schema") or {}, raw.get("linking_schema") or {}
    if not block.get("left"):
        found.append("NO_BLOCKING")
    if not link.get("left"):
        found.append("NO_LINKING")
    method = raw.get("linking_method")
    if not method:
        found.append("NO_LINKING_METHOD")
    elif method not in METHODS:
        found.append("INVALID_METHOD")
    elif method == "PRB" and not _is_probability(link.get("probability", 0.9)):
        found.append("INVALID_PROBABILITY")
    if "INVALID_PROBABILITY" in found:
        return found
    step = step_from(raw, synonyms)
    if any(c.name == "SYNONYMS" and not c.args.get("table") for c in step.comparisons) and not has_default():
        found.append("SYNONYMS_MISSING")
    for code in step.transformations:
        try:
            encoder(code)
        except KeyError:
            found.append("UNKNOWN_ALGORITHM")
    for c in step.comparisons:
        try:
            if set(c.args) - set(comparator(c.name).args):
                found.append("INVALID_ARGUMENT")
        except KeyError:
            found.append("UNKNOWN_ALGORITHM")
    lengths = [{len(step.block_left), len(step.block_right or step.block_left)}, {len(step.link_left), len(step.link_right or step.link_left), len(step.comparisons)}]
    if any(len(x) > 1 for x in lengths):
        warnings.warn(f"step {step.seq}: lists differ in length and are cut to the shortest", stacklevel=3)
    return found


def validate(raw: dict[str, Any] | None, columns_of: Callable[[dict[str, Any]], list[str]] | None = None, synonyms: str | None = None) -> None:
    """Raise ValidationError if the project object has faults. columns_of reads a dataset's columns, or raises OSError.
    synonyms: as in project_from()."""
    if not raw:
        raise ValidationError(["NO_PROJECT"])
    found = []
    kind = raw.get("type")
    if not raw.get("name"):
        found.append("NAME_MISSING")
    if not kind:
        found.append("TYPE_MISSING")
    elif kind not in (LINK, DEDUP):
        found.append("INVALID_TYPE")
    if not raw.get("output_root"):
        found.append("OUT_PATH_MISSING")
    if raw.get("task_uuid") and not is_plain_name(raw["task_uuid"]):
        found.append("INVALID_RUN_ID")
    if kind == LINK and raw.get("relationship_type") not in RELATIONSHIPS:
        found.append("INVALID_RELATIONSHIP")
    datasets = raw.get("datasets") or []
    if len(datasets) < (2 if kind == LINK else 1):
        found.append("DATASET_MISSING")
    steps = raw.get("steps") or []
    if not steps:
        found.append("NO_STEPS")
    for place, d in enumerate(datasets[: 2 if kind == LINK else 1]):
        if not d.get("index_field"):
            found.append("INDEX_MISSING")
        if kind == LINK and not d.get("entity_field"):
            found.append("ENTITY_ID_MISSING")
        if not d.get("url"):
            found.append("FILEPATH_MISSING")
        elif columns_of:
            try:
                columns = columns_of(d)
            except OSError:
                found.append("INVALID_PATH")
                continue
            if d.get("index_field") and d["index_field"] not in columns:
                found.append("INVALID_INDEX")
            if kind == LINK and d.get("entity_field") and d["entity_field"] not in columns:
                found.append("INVALID_ENTITY_FIELD")
            sides = ["left", "right"] if kind == DEDUP else [("left", "right")[place]]
            if any(f not in columns for s in steps for side in sides for f in step_from(s).fields(side)):
                found.append("UNKNOWN_COLUMN")
    for s in steps:
        found += _step_faults(s, raw.get("synonyms") or synonyms)
    if found:
        raise ValidationError(found)
