"""Projects as data: datasets, steps with blocking and linking schemas, and the JSON form they are read from."""

from __future__ import annotations

import json
from dataclasses import dataclass, field
from typing import Any

LINK, DEDUP = "LINK", "DEDUP"
RELATIONSHIPS = {"1T1": "One to one", "1TM": "One to many", "MT1": "Many to one"}
METHODS = {"DTR": "Deterministic", "PRB": "Probabilistic"}


@dataclass(frozen=True)
class Comparison:
    name: str = "EXACT"
    args: dict[str, Any] = field(default_factory=dict)


@dataclass(frozen=True)
class Step:
    """One step. Lists that differ in length are cut to the shortest; no right fields means the left ones."""

    seq: int
    block_left: tuple[str, ...]
    link_left: tuple[str, ...]
    comparisons: tuple[Comparison, ...]
    block_right: tuple[str, ...] = ()
    transformations: tuple[str | None, ...] = ()
    link_right: tuple[str, ...] = ()
    group: bool = True
    method: str = "DTR"
    #: Of a PRB step: how probable it must be that a pair is a match.
    least: float = 0.9

    def keys(self) -> list[tuple[str, str, str | None]]:
        """(left field, right field, transformation) by position; a missing transformation is the raw value."""
        right = self.block_right or self.block_left
        codes = [*self.transformations, *[None] * len(self.block_left)]
        return list(zip(self.block_left, right, codes, strict=False))

    def compared(self) -> list[tuple[str, str, Comparison]]:
        return list(zip(self.link_left, self.link_right or self.link_left, self.comparisons, strict=False))

    def fields(self, side: str) -> list[str]:
        place = 0 if side == "left" else 1
        return list(dict.fromkeys([k[place] for k in self.keys()] + [c[place] for c in self.compared()]))


@dataclass(frozen=True)
class Dataset:
    name: str
    url: str
    index_field: str
    entity_field: str | None = None
    columns: tuple[str, ...] = ()
    data_types: dict[str, str] | None = None
    format: str = "CSV"


@dataclass(frozen=True)
class Project:
    name: str
    type: str
    datasets: tuple[Dataset, ...]
    steps: tuple[Step, ...]
    output_root: str = ""
    relationship_type: str | None = None
    temp_path: str = ""
    run_id: str = ""

    def used_columns(self, place: int) -> list[str]:
        """What is read of a dataset: the columns it names, or else the index, the entity and what the steps use."""
        d = self.datasets[place]
        if d.columns:
            return list(d.columns)
        own = [d.index_field, *([d.entity_field] if self.type == LINK and d.entity_field else [])]
        sides = ["left", "right"] if self.type == DEDUP else [("left", "right")[place]]
        return list(dict.fromkeys(own + [f for s in self.steps for side in sides for f in s.fields(side)]))

    def describe(self) -> str:
        """The project as JSON text."""
        out: dict[str, Any] = {"name": self.name, "type": self.type, "datasets": [d.name for d in self.datasets]}
        if self.type == LINK:
            out["relationship_type"] = RELATIONSHIPS.get(self.relationship_type or "", self.relationship_type)
        out["steps"] = [
            {
                "seq": s.seq,
                "group": s.group,
                "linking_method": METHODS.get(s.method, s.method),
                "blocking": [{"left": a, "right": b, "transformation": t or "EXACT"} for a, b, t in s.keys()],
                "linking": [{"left": a, "right": b, "comparison": c.name, "args": c.args} for a, b, c in s.compared()],
            }
            for s in self.steps
        ]
        return json.dumps(out, indent=2)


def step_from(raw: dict[str, Any], synonyms: str | None = None) -> Step:
    """synonyms: the table of SYNONYMS comparisons that name none."""
    block, link = raw.get("blocking_schema") or {}, raw.get("linking_schema") or {}
    comparisons = [Comparison(c.get("name") or "EXACT", dict(c.get("args") or {})) for c in link.get("comparisons") or []]
    if synonyms:
        comparisons = [Comparison(c.name, {"table": synonyms} | c.args) if c.name == "SYNONYMS" else c for c in comparisons]
    left = tuple(link.get("left") or ())
    if not comparisons:
        comparisons = [Comparison()] * len(left)
    return Step(
        seq=int(raw.get("seq") or 0),
        block_left=tuple(block.get("left") or ()),
        block_right=tuple(block.get("right") or ()),
        transformations=tuple(block.get("transformations") or ()),
        link_left=left,
        link_right=tuple(link.get("right") or ()),
        comparisons=tuple(comparisons),
        group=bool(raw.get("group", False)),
        method=raw.get("linking_method") or "DTR",
        least=float(link.get("probability", 0.9)),
    )


def project_from(raw: dict[str, Any], synonyms: str | None = None) -> Project:
    """A project of a checked JSON object; keys that steer nothing (titles, status and such) are left out.

    synonyms: the table of SYNONYMS where neither the comparison nor the project's key "synonyms" names one.
    """
    table = raw.get("synonyms") or synonyms
    datasets = tuple(
        Dataset(
            name=d.get("name") or "",
            url=d.get("url") or "",
            index_field=d.get("index_field") or "",
            entity_field=d.get("entity_field"),
            columns=tuple(d.get("columns") or ()),
            data_types=d.get("data_types") or None,
            format=(d.get("format") or "CSV").upper(),
        )
        for d in raw.get("datasets") or []
    )
    return Project(
        name=raw.get("name") or "",
        type=raw.get("type") or "",
        datasets=datasets,
        steps=tuple(step_from(s, table) for s in raw.get("steps") or []),
        output_root=raw.get("output_root") or "",
        relationship_type=raw.get("relationship_type"),
        temp_path=raw.get("temp_path") or "",
        run_id=raw.get("task_uuid") or "",
    )


def read_project(path: str) -> dict[str, Any]:
    """The JSON object of a project file; a missing file raises FileNotFoundError."""
    with open(path, encoding="utf-8") as f:
        return json.load(f)
