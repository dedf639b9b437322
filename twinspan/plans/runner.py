"""Running a project: validate, read, run, write."""

from __future__ import annotations

import re
import uuid
from dataclasses import dataclass, replace
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from twinspan.operators.dedup import DedupResult, dedup
from twinspan.operators.link import LinkResult, link
from twinspan.operators.storage import drop_path, intermediates, make_folder, path_exists
from twinspan.sources.tables import columns_of, read_dataset, write_table

from .options import Options
from .report import as_html, as_json, as_pdf, summary
from .spec import DEDUP, Project, project_from
from .validate import ValidationError, validate


#: The column of a record's place in its dataset.
PLACE = "_place"


@dataclass
class Run:
    """result of a de-duplication has the column PLACE if asked for, which is no part of the dataset."""

    project: Project
    result: DedupResult | LinkResult
    report: dict[str, Any]


def duplicate_ids(records: DataFrame, index: str) -> DataFrame:
    """Index values that more than one record has, with their number n."""
    return records.groupBy(index).agg(F.count(F.lit(1)).alias("n")).where("n > 1")


def check(spark: SparkSession, raw: dict[str, Any] | None, options: Options = Options()) -> None:
    """Raise ValidationError if a project object has faults."""
    validate(raw, lambda d: columns_of(spark, d["url"], (d.get("format") or "CSV").upper()), options.synonyms)


def run_project(spark: SparkSession, raw: dict[str, Any], options: Options = Options(), places: bool = False) -> Run:
    """Validate a project object and run it. Nothing is written but intermediate tables, which the result reads; enter
    intermediates() before to have them deleted. places: de-duplicated records keep the column PLACE."""
    check(spark, raw, options)
    return _run(spark, raw, options, places)


def _run(spark: SparkSession, raw: dict[str, Any], options: Options, places: bool) -> Run:
    project = project_from(raw, options.synonyms)
    datasets = project.datasets[: 1 if project.type == DEDUP else 2]
    place = PLACE if places and project.type == DEDUP else None
    frames = [read_dataset(spark, d, project.used_columns(i), options.na_values, place, options.multi_line) for i, d in enumerate(datasets)]
    if options.check_ids and any(not duplicate_ids(f, d.index_field).isEmpty() for f, d in zip(frames, datasets, strict=True)):
        raise ValidationError(["DUPLICATE_IDS"])
    result: DedupResult | LinkResult
    if project.type == DEDUP:
        result = dedup(frames[0], datasets[0].index_field, project.steps)
        if place:
            result = replace(result, matched=result.matched.drop(f"{place}_LEFT", f"{place}_RIGHT"))
    else:
        a, b = datasets
        result = link(frames[0], frames[1], a.index_field, b.index_field, a.entity_field, b.entity_field, project.steps, project.relationship_type, options.mates)
    return Run(project, result, summary(project, result.stats, result.totals))


def execute_project(spark: SparkSession, raw: dict[str, Any], options: Options = Options()) -> str:
    """Run a project and write its results into <output root>/<run id>; returns the report's path.

    De-duplication: deduped_data (in the dataset's order, or by the index, or by ENTITY_ID) and dedup_matched. Linking:
    linked_data, matched_not_linked_data, unlinked_left and unlinked_right. Both: <name>_summary.html, .pdf and .json. The run
    id is the project's task_uuid, or a new one; where its output folder is there already, FileExistsError is raised and
    nothing in it changes. Intermediate tables go to a new folder below temp_path, or below the shared folder where the
    project has no temp_path, which is deleted at the end, whether the run succeeds or not. Of a run that fails while it
    writes its results, nothing is left.
    """
    check(spark, raw, options)
    run_id = raw.get("task_uuid") or uuid.uuid4().hex
    root = f"{raw['output_root'].rstrip('/')}/{run_id}"
    if path_exists(spark, root):
        raise FileExistsError(f"{root} is there already")
    with intermediates(spark, f"{run_id}-{uuid.uuid4().hex}", raw.get("temp_path")):
        run = _run(spark, raw, options, places=options.order == "input")
        make_folder(spark, root)
        try:
            return _write_results(spark, run, root, run_id, options)
        except BaseException:
            drop_path(spark, root)
            raise


def _write_results(spark: SparkSession, run: Run, root: str, run_id: str, options: Options) -> str:
    kind, r = options.format, run.result
    if isinstance(r, DedupResult):
        index = run.project.datasets[0].index_field
        order = {"input": [PLACE], "index": [index], "entity": ["ENTITY_ID", index]}[options.order]
        write_table(r.deduped, f"{root}/deduped_data", kind, order, PLACE)
        write_table(r.matched, f"{root}/dedup_matched", kind, ["ENTITY_ID", f"LEFT_{index}", f"RIGHT_{index}"])
    else:
        write_table(r.linked, f"{root}/linked_data", kind, ["LINK_ID"])
        write_table(r.matched_not_linked, f"{root}/matched_not_linked_data", kind, r.matched_not_linked.columns[:2])
        write_table(r.unlinked_left, f"{root}/unlinked_left", kind, [run.project.datasets[0].index_field])
        write_table(r.unlinked_right, f"{root}/unlinked_right", kind, [run.project.datasets[1].index_field])
    path = f"{root}/{re.sub(r'[^\w.-]+', '_', run.project.name)}_summary"
    for suffix, body in ((".json", as_json(run.report | {"run_id": run_id}).encode()), (".pdf", as_pdf(run.report)), (".html", as_html(run.report).encode())):
        _write_bytes(spark, path + suffix, body)
    return path + ".html"


def run_task(spark: SparkSession, raw: dict[str, Any], options: Options = Options()) -> dict[str, Any]:
    """A project as a task of a job queue: run_id, status ("done" or "failed"), report (its path) and errors (codes of
    validation, or the message of what went wrong). Never raises for a fault of the project or its data."""
    run_id = (raw or {}).get("task_uuid") or uuid.uuid4().hex
    done = {"run_id": run_id, "status": "failed", "report": None, "errors": []}
    try:
        return done | {"status": "done", "report": execute_project(spark, {**(raw or {}), "task_uuid": run_id} if raw else raw, options)}
    except ValidationError as error:
        return done | {"errors": error.codes}
    except Exception as error:  # the queue's caller sees what failed
        return done | {"errors": [str(error)]}


def _write_bytes(spark: SparkSession, path: str, body: bytes) -> None:
    """By the file system that owns the path."""
    jvm = spark.sparkContext._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    out = where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).create(where, True)
    try:
        out.write(bytearray(body))
    finally:
        out.close()
