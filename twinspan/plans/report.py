"""The summary of a run, as data, JSON, HTML and PDF."""

from __future__ import annotations

import html
import json
from collections.abc import Iterator
from typing import Any

from pyspark.sql import DataFrame, SparkSession

from .pdf import Pages
from .spec import METHODS, RELATIONSHIPS, Project

TYPES = {"LINK": "Linking", "DEDUP": "De-duplication"}
COUNTERS = ["total_records_linked", "total_entities", "total_matched_not_linked"]


def summary(project: Project, stats: dict[int, dict[str, int]], totals: dict[str, int]) -> dict[str, Any]:
    """Header, totals, and for each step its schemas and counters."""
    return {
        "name": project.name,
        "type": TYPES[project.type],
        "datasets": [d.name for d in project.datasets],
        "relationship_type": RELATIONSHIPS.get(project.relationship_type or "") if project.type == "LINK" else None,
        **{k: totals.get(k) for k in COUNTERS[:2]},
        "steps": [
            {
                "seq": s.seq,
                "linking_method": METHODS.get(s.method, METHODS["DTR"]),
                "blocking": [[a, b, t or "EXACT"] for a, b, t in s.keys()],
                "linking": [[a, b, c.name, c.args] for a, b, c in s.compared()],
                **{k: stats.get(s.seq, {}).get(k) for k in COUNTERS},
            }
            for s in project.steps
        ],
    }


def as_frame(spark: SparkSession, report: dict[str, Any]) -> DataFrame:
    """One row per step: seq and counters."""
    return spark.createDataFrame([tuple(s[k] for k in ["seq", *COUNTERS]) for s in report["steps"]], "seq long, " + ", ".join(f"{k} long" for k in COUNTERS))


def as_json(report: dict[str, Any]) -> str:
    return json.dumps(report, indent=2)


def _shown(x: Any) -> str:
    return "" if x is None else json.dumps(x) if isinstance(x, dict) else str(x)


def _parts(report: dict[str, Any]) -> Iterator[tuple[str, list[list[Any]]]]:
    """What pages show: titles, each with tables that follow it, whose first row is the head."""
    header = [["Type", report["type"]], ["Datasets", ", ".join(report["datasets"])], ["Relationship", report["relationship_type"]], ["Pairs linked", report["total_records_linked"]], ["Entities", report["total_entities"]]]
    yield report["name"], [[["", ""], *(r for r in header if r[1] is not None)]]
    for s in report["steps"]:
        counters = [[k, s[k]] for k in COUNTERS if s[k] is not None]
        tables = [[["Left", "Right", "Transformation"], *s["blocking"]], [["Left", "Right", "Comparison", "Arguments"], *s["linking"]], [["Counter", "Value"], *counters]]
        yield f"Step {_shown(s['seq'])}: {_shown(s['linking_method'])}", tables


def as_html(report: dict[str, Any]) -> str:
    """A page without outside parts."""
    cell = lambda x: html.escape(_shown(x))

    def table(head: list[Any], rows: list[list[Any]]) -> str:
        top = "".join(f"<th>{cell(h)}</th>" for h in head)
        return f"<table border='1'><tr>{top}</tr>" + "".join("<tr>" + "".join(f"<td>{cell(x)}</td>" for x in r) + "</tr>" for r in rows) + "</table>"

    out = [f"<!DOCTYPE html><html><head><meta charset='utf-8'><title>{cell(report['name'])}</title></head><body>"]
    for i, (title, tables) in enumerate(_parts(report)):
        level = "h2" if i else "h1"
        out += [f"<{level}>{cell(title)}</{level}>", *(table(t[0], t[1:]) for t in tables)]
    return "".join([*out, "</body></html>"])


def as_pdf(report: dict[str, Any]) -> bytes:
    """The same as pages to print."""
    pages = Pages()
    for i, (title, tables) in enumerate(_parts(report)):
        pages.heading(_shown(title), 12 if i else 16)
        for table in tables:
            pages.table([[_shown(x) for x in row] for row in table if any(row)])
    return pages.document()
