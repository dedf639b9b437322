"""Projects from JSON: reading, checking, running, reporting, the command line."""

import json
import os
import subprocess
import sys

import pytest

from twinspan.operators.storage import intermediates
from twinspan.plans import catalog
from twinspan.plans.options import Options, read_options
from twinspan.plans.report import as_frame, as_html, as_json, as_pdf
from twinspan.functions.synonyms import use_synonyms
from twinspan.plans.runner import execute_project, run_project, run_task
from twinspan.plans.spec import project_from, read_project
from twinspan.plans.validate import MESSAGES, ValidationError, validate
from twinspan.sources.tables import read_dataset, write_table
from twinspan.plans.spec import Dataset

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))

CSV = """REC_ID, BORN,FIRST,LAST,NOTE
r1, 1980,Anna,Berg ,"a, b"
r2,1980,Ana,Berg ,NA
r3,1980,Otto,Lund
r4,,Anna,Berg ,x
"""


def dedup_project(folder):
    path = f"{folder}/people.csv"
    with open(path, "w") as f:
        f.write(CSV)
    return {
        "name": "people",
        "type": "DEDUP",
        "output_root": f"{folder}/out/",
        "status": "READY",
        "datasets": [{"name": "PEOPLE", "url": path, "format": "CSV", "index_field": "REC_ID", "entity_field": "REC_ID", "data_types": {c: "VARCHAR" for c in ("REC_ID", "BORN", "FIRST", "LAST", "NOTE")}, "columns": ["NOTE", "BORN", "FIRST", "LAST", "REC_ID"]}],
        "steps": [
            {
                "seq": 1,
                "group": True,
                "linking_method": "DTR",
                "blocking_schema": {"left": ["BORN", "LAST"], "right": [], "transformations": ["EXACT", "SOUNDEX"]},
                "linking_schema": {"left": ["FIRST"], "right": [], "comparisons": [{"name": "LEVENSHTEIN", "args": {"max_edits": 1}}]},
            }
        ],
    }


def link_project(folder):
    for name, rows in (("a", "1,10,x1\n2,20,x2\n"), ("b", "5,50,x1\n6,60,x9\n")):
        with open(f"{folder}/{name}.csv", "w") as f:
            f.write("id,ent,k\n" + rows)
    dataset = lambda n: {"name": n.upper(), "url": f"{folder}/{n}.csv", "index_field": "id", "entity_field": "ent", "data_types": {"id": "INTEGER", "ent": "INTEGER", "k": "VARCHAR"}}
    return {
        "name": "ab",
        "type": "LINK",
        "relationship_type": "1T1",
        "output_root": f"{folder}/out",
        "datasets": [dataset("a"), dataset("b")],
        "steps": [{"seq": 1, "group": False, "linking_method": "DTR", "blocking_schema": {"left": ["k"], "right": ["k"], "transformations": ["EXACT"]}, "linking_schema": {"left": ["k"], "right": ["k"], "comparisons": [{"name": "EXACT"}]}}],
    }


def test_dedup_project(spark, tmp_path):
    report = execute_project(spark, dedup_project(tmp_path) | {"task_uuid": "run1", "temp_path": f"file://{tmp_path}/temp"})
    out = f"{tmp_path}/out/run1"
    assert report == f"{out}/people_summary.html" and os.listdir(f"{tmp_path}/temp") == []
    rows = spark.read.option("header", True).csv(f"{out}/deduped_data")
    assert [r.REC_ID for r in rows.coalesce(1).collect()] == ["r1", "r2", "r3", "r4"]
    assert rows.columns == ["REC_ID", "ENTITY_ID", "BORN", "FIRST", "LAST", "NOTE"]
    got = {r.REC_ID: (r.ENTITY_ID, r.LAST, r.NOTE) for r in rows.collect()}
    assert {k: v[0] for k, v in got.items()} == {"r1": "1", "r2": "1", "r3": "2", "r4": "3"}
    assert got["r1"][2] == "a, b" and got["r2"][2] == "NA" and got["r3"][2] is None
    matched = spark.read.option("header", True).csv(f"{out}/dedup_matched").collect()
    assert [(r.LEFT_REC_ID, r.RIGHT_REC_ID, r.ENTITY_ID, r.STEP) for r in matched] == [("r1", "r2", "1", "1")]
    page, data = open(report).read(), json.load(open(f"{out}/people_summary.json"))
    assert "<h1>people</h1>" in page and data["total_entities"] == 3 and data["steps"][0]["total_records_linked"] == 1


def test_link_project(spark, tmp_path):
    execute_project(spark, link_project(tmp_path) | {"task_uuid": "run2"}, Options(format="parquet"))
    out = spark.read.parquet(f"{tmp_path}/out/run2/linked_data").collect()
    assert [(r.LEFT_id, r.RIGHT_id, r.LINK_ID) for r in out] == [(1, 5, 1)]
    assert [r.id for r in spark.read.parquet(f"{tmp_path}/out/run2/unlinked_left").collect()] == [2]
    assert [r.id for r in spark.read.parquet(f"{tmp_path}/out/run2/unlinked_right").collect()] == [6]
    assert spark.read.parquet(f"{tmp_path}/out/run2/matched_not_linked_data").count() == 0


def test_report_forms(spark, tmp_path):
    run = run_project(spark, link_project(tmp_path))
    assert run.report["relationship_type"] == "One to one" and run.report["type"] == "Linking"
    assert [tuple(r) for r in as_frame(spark, run.report).collect()] == [(1, 1, 1, 0)]
    assert json.loads(as_json(run.report)) == json.loads(json.dumps(run.report))
    hostile = run.report | {"name": "<script>"}
    assert "<script>" not in as_html(hostile)
    described = json.loads(run.project.describe())
    assert described["relationship_type"] == "One to one" and described["steps"][0]["linking"][0]["comparison"] == "EXACT"


def faults(raw, columns=None):
    with pytest.raises(ValidationError) as error:
        validate(raw, columns)
    assert str(error.value).startswith("Validation Error(s):\n\t")
    return set(error.value.codes)


def _pdf_texts(body):
    """The strings that a PDF of ours draws, page by page, read by the file's own table of places."""
    import re

    assert body.startswith(b"%PDF-1.4\n") and body.endswith(b"%%EOF\n")
    start = int(re.search(rb"startxref\n(\d+)\n", body)[1])
    n = int(re.match(rb"xref\n0 (\d+)\n", body[start:])[1])
    places = [int(x) for x in re.findall(rb"(\d{10}) 00000 n ", body[start:])]
    assert len(places) == n - 1
    objects = {}
    for number, at in enumerate(places, 1):
        found = re.match(rb"%d 0 obj\n(.*?)\nendobj\n" % number, body[at:], re.S)
        objects[number] = found[1]
    kids = [int(x) for x in re.findall(rb"(\d+) 0 R", re.search(rb"/Kids \[(.*?)\]", objects[2])[1])]
    out = []
    for kid in kids:
        stream = objects[int(re.search(rb"/Contents (\d+) 0 R", objects[kid])[1])]
        length, drawn = int(re.search(rb"/Length (\d+)", stream)[1]), re.search(rb"stream\n(.*)\nendstream", stream, re.S)[1]
        assert len(drawn) == length
        out.append([re.sub(rb"\\(.)", rb"\1", t).decode("cp1252") for t in re.findall(rb"Td \(((?:[^()\\]|\\.)*)\) Tj", drawn)])
    return out


def test_report_as_pdf(spark, tmp_path):
    report = execute_project(spark, dedup_project(tmp_path))
    with open(report.replace(".html", ".pdf"), "rb") as f:
        pages = _pdf_texts(f.read())
    assert len(pages) == 1
    shown = pages[0]
    assert shown[0] == "people" and shown[shown.index("Entities") + 1] == "3" and shown[shown.index("total_records_linked") + 1] == "1"
    assert "LEVENSHTEIN" in shown and '{"max_edits": 1}' in shown


def test_long_reports_have_many_pages(tmp_path):
    run_report = {"name": "a (long) \\ report é 数", "type": "Linking", "datasets": ["x " * 900], "relationship_type": None, "total_records_linked": 0, "total_entities": 0}
    step = {"seq": 1, "linking_method": "Deterministic", "blocking": [["a", "b", "EXACT"]] * 30, "linking": [["a", "b", "EXACT", {}]], "total_records_linked": 1, "total_entities": 1, "total_matched_not_linked": None}
    pages = _pdf_texts(as_pdf(run_report | {"steps": [step | {"seq": i} for i in range(8)]}))
    assert len(pages) > 5 and pages[0][0] == "a (long) \\ report é ?"
    assert sum(t.count("x") for p in pages for t in p if set(t) <= {"x", " "} and t) == 900
    assert [t for p in pages for t in p if t.startswith("Step")] == [f"Step {i}: Deterministic" for i in range(8)]


def test_validation(spark, tmp_path):
    good = link_project(tmp_path)
    validate(good, lambda d: ["id", "ent", "k"])
    assert faults(None) == faults({}) == {"NO_PROJECT"}
    assert faults({"comments": "x"}) == {"NAME_MISSING", "TYPE_MISSING", "OUT_PATH_MISSING", "DATASET_MISSING", "NO_STEPS"}
    assert faults(good | {"type": "JOIN"}) == {"INVALID_TYPE"}
    assert faults(good | {"relationship_type": "NT1"}) == {"INVALID_RELATIONSHIP"}
    assert faults(good | {"datasets": good["datasets"][:1]}) == {"DATASET_MISSING"}
    assert faults(good | {"datasets": [{}, {}]}) == {"INDEX_MISSING", "ENTITY_ID_MISSING", "FILEPATH_MISSING"}
    assert faults(good | {"steps": [{}]}) == {"NO_BLOCKING", "NO_LINKING", "NO_LINKING_METHOD"}
    one = good["steps"][0]
    assert faults(good | {"steps": [one | {"linking_method": "XXX"}]}) == {"INVALID_METHOD"}
    assert faults(good | {"steps": [one | {"blocking_schema": one["blocking_schema"] | {"transformations": ["METAPHONE"]}}]}) == {"UNKNOWN_ALGORITHM"}
    assert faults(good | {"steps": [one | {"linking_schema": one["linking_schema"] | {"comparisons": [{"name": "NOPE"}]}}]}) == {"UNKNOWN_ALGORITHM"}
    assert faults(good | {"steps": [one | {"linking_schema": one["linking_schema"] | {"comparisons": [{"name": "HEAD_MATCH", "args": {"m": 1}}]}}]}) == {"INVALID_ARGUMENT"}
    assert faults(good, lambda d: ["id", "k"]) == {"INVALID_ENTITY_FIELD"}
    assert faults(good, lambda d: ["ent"]) == {"INVALID_INDEX", "UNKNOWN_COLUMN"}

    def missing(d):
        raise FileNotFoundError(d["url"])

    assert faults(good, missing) == {"INVALID_PATH"}
    gone = good | {"datasets": [d | {"url": "/nowhere/x.csv"} for d in good["datasets"]]}
    with pytest.raises(ValidationError) as error:
        run_project(spark, gone)
    assert error.value.codes == ["INVALID_PATH"]
    assert all(MESSAGES.values())


def test_warnings(tmp_path):
    good = link_project(tmp_path)
    one = good["steps"][0]
    validate(good | {"steps": [one | {"linking_method": "PRB"}]})
    with pytest.warns(UserWarning, match="cut to the shortest"):
        validate(good | {"steps": [one | {"linking_schema": one["linking_schema"] | {"comparisons": [{"name": "EXACT"}] * 2}}]})


def test_columns_used(tmp_path):
    project = project_from(link_project(tmp_path))
    assert project.used_columns(0) == ["id", "ent", "k"]
    assert project_from(dedup_project(tmp_path)).used_columns(0) == ["NOTE", "BORN", "FIRST", "LAST", "REC_ID"]


def test_reading(spark, tmp_path):
    dedup_project(tmp_path)
    url = f"{tmp_path}/people.csv"
    rows = read_dataset(spark, Dataset("p", url, "REC_ID"), ["REC_ID", "BORN", "NOTE"])
    assert dict(rows.dtypes) == {"REC_ID": "string", "BORN": "int", "NOTE": "string"}
    assert [r.BORN for r in rows.collect()] == [1980, 1980, 1980, None]
    assert [r.NOTE for r in read_dataset(spark, Dataset("p", url, "REC_ID"), ["NOTE"], na_values=("NA",)).collect()] == ["a, b", None, None, "x"]
    with pytest.raises(ValueError):
        read_dataset(spark, Dataset("p", url, "REC_ID", data_types={"BORN": "DECIMAL"}), ["BORN"])
    with pytest.raises(FileNotFoundError):
        read_project(f"{tmp_path}/none.json")


def test_options(spark, tmp_path):
    path = tmp_path / "run.ini"
    path.write_text("[other]\nx = 1\n[twinspan]\nformat = parquet\norder = entity\nna_values = NA, -\ncheck_ids = no\nsynonyms = builtin\nmulti_line = no\n")
    assert read_options(str(path)) == Options("parquet", "entity", "right", ("NA", "-"), False, "builtin", False)
    path.write_text("[other]\nx = 1\n")
    assert read_options(str(path)) == Options()
    path.write_text("[twinspan]\nchunk = 1\n")
    with pytest.raises(ValueError):
        read_options(str(path))
    with pytest.raises(ValueError):
        Options(order="random")
    execute_project(spark, dedup_project(tmp_path) | {"task_uuid": "run3"}, Options(format="parquet", order="entity"))
    assert [r.ENTITY_ID for r in spark.read.parquet(f"{tmp_path}/out/run3/deduped_data").coalesce(1).collect()] == [1, 1, 2, 3]


def test_csv_as_the_standard_has_it(spark, tmp_path):
    path = f"{tmp_path}/quoted.csv"
    with open(path, "w", newline="") as f:
        f.write('id,name,n\n1,"Anna ""Ann"" Berg",5\n2,"two\nlines, and a comma",\n3,"",7\n4, lead,8\n')
    types = {"id": "INTEGER", "name": "VARCHAR", "n": "INTEGER"}
    rows = read_dataset(spark, Dataset("q", path, "id", data_types=types), [*types])
    assert [tuple(r) for r in rows.collect()][:2] == [(1, 'Anna "Ann" Berg', 5), (2, "two\nlines, and a comma", None)]
    assert [r.n for r in read_dataset(spark, Dataset("q", path, "id"), ["id", "n"]).collect()] == [5, None, 7, 8]
    hard = [(1, 'a "b" c'), (2, "x\ny"), (3, "x\r\ny"), (4, ","), (5, '"'), (6, "tail "), (7, None), (8, "\\"), (9, 'back\\"slash'), (10, "é🙂")]
    written = write_table(spark.createDataFrame(hard, "id long, t string"), f"{tmp_path}/out_csv")
    back = read_dataset(spark, Dataset("w", written, "id", data_types={"id": "INTEGER", "t": "VARCHAR"}), ["id", "t"])
    assert sorted(map(tuple, back.collect())) == hard


def test_wrong_values_and_rows_are_errors(spark, tmp_path):
    path = f"{tmp_path}/bad.csv"
    types = {"id": "INTEGER", "x": "REAL", "b": "BOOLEAN"}
    for body, what in (("1,2.5,true\nx2,1,true\n", "column id: not of type INTEGER: x2"), ("1,a,true\n", "column x"), ("1,1,maybe\n", "column b"), ("1,2,true,more\n", "more fields than the header")):
        with open(path, "w") as f:
            f.write("id,x,b\n" + body)
        with pytest.raises(Exception, match=what):
            read_dataset(spark, Dataset("b", path, "id", data_types=types), [*types]).collect()
    with open(path, "w") as f:
        f.write("id,x,b\n1, ,\n2\n3,NA,true\n")
    rows = read_dataset(spark, Dataset("b", path, "id", data_types=types), [*types], na_values=("NA",))
    assert sorted(map(tuple, rows.collect())) == [(1, None, None), (2, None, None), (3, None, True)]


def test_rows_keep_the_order_of_their_file(spark, tmp_path):
    project = dedup_project(tmp_path)
    lines = [f"r{i},19{i % 90:02},N{i},Berg ,x" for i in (7, 3, 9, 1, 8, 2, 6)]
    with open(f"{tmp_path}/people.csv", "w") as f:
        f.write("REC_ID, BORN,FIRST,LAST,NOTE\n" + "\n".join(lines) + "\n")
    for order, want in (("input", [7, 3, 9, 1, 8, 2, 6]), ("index", [1, 2, 3, 6, 7, 8, 9])):
        execute_project(spark, project | {"task_uuid": order}, Options(order=order))
        out = spark.read.option("header", True).csv(f"{tmp_path}/out/{order}/deduped_data")
        assert [r.REC_ID for r in out.coalesce(1).collect()] == [f"r{i}" for i in want] and "_place" not in out.columns


def synonym_project(folder, **more):
    project = dedup_project(folder) | more
    with open(f"{folder}/people.csv", "w") as f:
        f.write("REC_ID,BORN,FIRST,LAST,NOTE\nr1,1980,Bob,Berg,\nr2,1980,Robert,Berg,\nr3,1980,Lizzie,Berg,\nr4,1980,Beth,Berg,\n")
    project["steps"][0]["linking_schema"]["comparisons"] = [{"name": "SYNONYMS"}]
    return project


def test_synonyms_of_a_project(spark, tmp_path):
    use_synonyms(None)
    with open(f"{tmp_path}/names.csv", "w") as f:
        f.write("a,b\nlizzie,elizabeth\nBETH,Elizabeth\n")
    entities = lambda run: {r.REC_ID: r.ENTITY_ID for r in run.result.deduped.collect()}
    with pytest.raises(ValidationError) as error:
        run_project(spark, synonym_project(tmp_path))
    assert error.value.codes == ["SYNONYMS_MISSING"]
    own = synonym_project(tmp_path, synonyms=f"{tmp_path}/names.csv")
    assert entities(run_project(spark, own)) == {"r3": 1, "r4": 1, "r1": 2, "r2": 3}
    assert entities(run_project(spark, synonym_project(tmp_path), Options(synonyms="builtin"))) == {"r1": 1, "r2": 1, "r3": 2, "r4": 3}
    assert entities(run_project(spark, own, Options(synonyms="builtin"))) == {"r3": 1, "r4": 1, "r1": 2, "r2": 3}  # the project's own comes first


def test_project_as_a_task(spark, tmp_path):
    done = run_task(spark, dedup_project(tmp_path))
    assert done["status"] == "done" and os.path.exists(done["report"]) and done["run_id"] in done["report"]
    assert json.load(open(done["report"].replace(".html", ".json")))["run_id"] == done["run_id"]
    assert run_task(spark, {}) | {"run_id": 0} == {"run_id": 0, "status": "failed", "report": None, "errors": ["NO_PROJECT"]}
    project = dedup_project(tmp_path)
    with open(f"{tmp_path}/people.csv", "a") as f:
        f.write("r9,1999,Eva,Lie,x,y,z\n")
    failed = run_task(spark, project)
    assert failed["status"] == "failed" and "more fields" in failed["errors"][0]


@pytest.mark.parametrize("name", [".", "..", "a/b", "/tmp", "", " ", "a b", ".hidden", 7, "x\n"])
def test_run_ids_are_plain_names(spark, tmp_path, name):
    os.makedirs(f"{tmp_path}/temp/mine")
    project = dedup_project(tmp_path) | {"task_uuid": name, "temp_path": f"file://{tmp_path}/temp"}
    if name:
        assert run_task(spark, project)["errors"] == ["INVALID_RUN_ID"]
        with pytest.raises(ValueError, match="name of one folder"), intermediates(spark, name, f"file://{tmp_path}/temp"):
            pass
    else:
        assert run_task(spark, project)["status"] == "done"  # as if there were none
    assert os.listdir(f"{tmp_path}/temp") == ["mine"]


def test_a_run_deletes_and_overwrites_nothing_of_others(spark, tmp_path):
    project = dedup_project(tmp_path) | {"task_uuid": "run1", "temp_path": f"file://{tmp_path}/temp"}
    for folder in ("temp/run1", "out/other"):
        os.makedirs(f"{tmp_path}/{folder}")
        open(f"{tmp_path}/{folder}/mine.txt", "w").write("mine")
    assert run_task(spark, project)["status"] == "done"
    assert os.listdir(f"{tmp_path}/temp") == ["run1"] and os.listdir(f"{tmp_path}/temp/run1") == ["mine.txt"]
    before = {f: os.path.getmtime(f"{tmp_path}/out/run1/{f}") for f in os.listdir(f"{tmp_path}/out/run1")}
    again = run_task(spark, project)  # the same run id once more
    assert again["status"] == "failed" and "is there already" in again["errors"][0]
    assert before == {f: os.path.getmtime(f"{tmp_path}/out/run1/{f}") for f in os.listdir(f"{tmp_path}/out/run1")}
    with pytest.raises(FileExistsError):
        execute_project(spark, project | {"task_uuid": "other"})
    assert os.listdir(f"{tmp_path}/out/other") == ["mine.txt"]
    with pytest.raises(FileExistsError), intermediates(spark, "run1", f"file://{tmp_path}/temp"):
        pass
    assert os.listdir(f"{tmp_path}/temp/run1") == ["mine.txt"]
    # temp_path may be the output's folder, and a project's name cannot leave it
    same = project | {"task_uuid": "run2", "temp_path": project["output_root"], "name": "../../people"}
    assert os.path.dirname(run_task(spark, same)["report"]) == f"{tmp_path}/out/run2" and sorted(os.listdir(f"{tmp_path}/out")) == ["other", "run1", "run2"]


def test_a_run_that_fails_leaves_nothing(spark, tmp_path):
    project = dedup_project(tmp_path) | {"task_uuid": "run1", "temp_path": f"file://{tmp_path}/temp"}
    assert run_task(spark, project, Options(format="no-such-format"))["status"] == "failed"
    assert os.listdir(f"{tmp_path}/temp") == [] and os.listdir(f"{tmp_path}/out") == []
    assert run_task(spark, project)["status"] == "done"


def test_repeated_ids_are_refused(spark, tmp_path):
    project = dedup_project(tmp_path)
    with open(f"{tmp_path}/people.csv", "a") as f:
        f.write("r1,1999,Eva,Lie,\n")
    with pytest.raises(ValidationError) as error:
        run_project(spark, project)
    assert error.value.codes == ["DUPLICATE_IDS"]
    assert run_project(spark, project, Options(check_ids=False)).report["name"] == "people"


def test_plugins(monkeypatch, tmp_path):
    from types import SimpleNamespace

    from twinspan.functions import registry

    (tmp_path / "own_plugin.py").write_text("from twinspan.functions import register\n\n\n@register('OWN', 'Own', None)\ndef own(left, right):\n    return left == right\n")
    monkeypatch.syspath_prepend(str(tmp_path))
    monkeypatch.setattr(registry, "entry_points", lambda group: [SimpleNamespace(value="own_plugin")] if group == registry.PLUGIN_GROUP else [])
    assert registry.load_plugins() == ["own_plugin"] and registry.comparator("OWN", "PRB").title == "Own"


def test_matches_as_a_table(spark):
    from twinspan.plans.sql import entities, matched_table, register_functions

    register_functions(spark)
    spark.createDataFrame([(1, "Robert", "a"), (2, "Rupert", "a"), (3, "Rubin", "a"), (4, None, "a")], "id long, name string, k string").createOrReplaceTempView("people_view")
    table = matched_table(spark, "kept_matches", "people_view", "id", ["soundex_encode({t}.name)"], "compare_lev(l.name, r.name, 2)", persist=True)
    assert [tuple(r) for r in table.collect()] == [(1, 2)]
    assert sorted(tuple(r) for r in entities(spark, "kept_matches").collect()) == [(1, 1), (2, 1)]
    assert [tuple(r) for r in spark.sql("SELECT jaro_winkler('MARTHA', 'MARHTA', 0.9D), nysiis_encode('KNIGHT'), match_slice(NULL, NULL, 0, 2), match_slice('abc', 'ab', 0, 3), compare_lev(NULL, 'a', 1)").collect()] == [(True, "NAGT", True, False, None)]
    spark.sql("DROP TABLE kept_matches")


def test_catalog(spark):
    found = catalog.algorithms()
    assert [n for n, _ in found["blocking"]] == ["EXACT", "SOUNDEX", "NYSIIS"]
    names = {n for n, _ in found["linking"]["DTR"]}
    assert {"EXACT", "BOTH_EMPTY", "ONE_EMPTY", "BOTH_EXIST", "SOUNDEX", "NYSIIS", "SLICE_MATCH", "HEAD_MATCH", "TAIL_MATCH", "FIXED_LEN", "FIXED_VAL", "ABS_DIFF", "LEVENSHTEIN", "JARO_WINKLER", "SYNONYMS"} <= names
    assert "LEVENSHTEIN" not in {n for n, _ in found["linking"]["PRB"]}
    assert found["args"]["DTR"]["LEVENSHTEIN"] == ["max_edits"]
    assert catalog.algorithms_frame(spark).count() >= 18
    names = ["firstname_field", "lastname_field", "middlename_field", "data_field", "sin_field", "string_field", "numeric_field"]
    assert [n for n, _ in catalog.field_categories()] == names and catalog.info()["version"]
    args = {a["name"]: a["args"] for a in catalog.algorithms_frame(spark).where("built_in").collect()}
    assert args["SLICE_MATCH"] == ["start", "end"] and args["FIXED_VAL"] == ["value"] and args["LEVENSHTEIN"] == ["max_edits"] and args["SOUNDEX"] == []


def test_command_line(tmp_path):
    project = tmp_path / "p.json"
    project.write_text(json.dumps(dedup_project(tmp_path)))
    env = os.environ | {"PYTHONPATH": ROOT, "PYSPARK_SUBMIT_ARGS": "--master local[2] --conf spark.ui.enabled=false --conf spark.sql.shuffle.partitions=2 pyspark-shell"}
    done = subprocess.run([sys.executable, "-m", "twinspan", "-p", str(project)], cwd=tmp_path, env=env, capture_output=True, text=True, timeout=240)
    assert done.returncode == 0, done.stderr[-2000:]
    assert done.stdout.strip().endswith("people_summary.html") and os.path.exists(done.stdout.strip())
    project.write_text(json.dumps(synonym_project(tmp_path)))
    run = lambda *more: subprocess.run([sys.executable, "-m", "twinspan", "-p", str(project), *more], cwd=tmp_path, env=env, capture_output=True, text=True, timeout=240)
    without = run()
    assert without.returncode != 0 and "no table of synonyms is named" in without.stderr
    done = run("--synonyms", "builtin")
    assert json.load(open(done.stdout.strip().replace(".html", ".json")))["total_entities"] == 3, done.stderr[-2000:]
    assert subprocess.run([sys.executable, "-m", "twinspan"], cwd=tmp_path, env=env, capture_output=True, timeout=120).returncode == 2
