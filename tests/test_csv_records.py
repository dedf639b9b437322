"""Quoted CSV in parallel: the same records as Spark's own reader, which takes a file in one task."""

import random

import pytest
from pyspark.sql import functions as F

from twinspan.plans.spec import Dataset
from twinspan.sources.csv_records import csv_records, open_at_end
from twinspan.sources.tables import read_dataset

OPTIONS = {"header": True, "quote": '"', "escape": '"', "multiLine": True, "ignoreLeadingWhiteSpace": True, "ignoreTrailingWhiteSpace": False}


@pytest.fixture
def small_blocks(spark):
    """Many blocks of one small file."""
    spark.conf.set("spark.sql.files.maxPartitionBytes", "200")
    spark.conf.set("spark.sql.files.openCostInBytes", "1")
    yield
    spark.conf.unset("spark.sql.files.maxPartitionBytes")
    spark.conf.unset("spark.sql.files.openCostInBytes")


@pytest.mark.parametrize(
    ("line", "inside", "after"),
    [("", False, False), ("", True, True), ("a,b", False, False), ("a,b", True, True), ('a,"b', False, True), ('b",c', True, False), ('b"",c', True, True), ('b"",c"', True, False), ('"a""', False, True), ('"a"""', False, False)]
    + [('5" pipe, 3"', False, False), (' "x', False, True), ('a"b,"c', False, True), ('"a"b"c,d', False, False), ('"",""', False, False), ('","', False, False), ('","', True, True), ('","', True, True), ('"', True, False)],
)
def test_open_fields(line, inside, after):
    assert open_at_end(line, inside) is after


def _field(pick):
    kind = pick.random()
    text = "".join(pick.choice(["a", "bc", " ", "1", "'", "ü"]) for _ in range(pick.randint(0, 12)))
    if kind < 0.5:
        return text
    if kind < 0.6:
        return f'x{text}"{text}'  # a quote inside an unquoted field
    inner = "".join(pick.choice(['""', ",", "\n", "\n\n", text, ' "",""\n', '"",\n""']) for _ in range(pick.randint(0, 8)))
    return f'"{inner}"'


@pytest.mark.parametrize("seed", range(6))
def test_as_the_reader_of_one_task(spark, tmp_path, small_blocks, seed):
    pick = random.Random(seed)
    for k in range(2):
        rows = [f"{i},{_field(pick)},{_field(pick)}" if pick.random() > 0.05 else "" for i in range(150)]
        if k:  # one field over many blocks, and the file's end inside another
            rows.insert(40, '900,"' + 'long ""\n,' * 300 + '",z')
            rows.append('901,b,"open\nend')
        (tmp_path / "data").mkdir(exist_ok=True)
        (tmp_path / "data" / f"{k}.csv").write_bytes(("id,a,b\n" + "\n".join(rows)).encode())
    url = f"{tmp_path}/data"
    want = [tuple(r) for r in spark.read.options(**OPTIONS).schema("id string, a string, b string").csv(url).collect()]
    data = Dataset("d", url, "id", data_types={c: "VARCHAR" for c in ("id", "a", "b")})
    found = read_dataset(spark, data, ["id", "a", "b"], position="at")
    assert found.select(F.spark_partition_id()).distinct().count() > 3
    assert sorted((tuple(r) for r in found.drop("at").collect()), key=repr) == sorted(want, key=repr)
    # in the order of the files
    placed = [r["id"] for r in found.orderBy("at").collect()]
    ids = [[r["id"] for r in spark.read.options(**OPTIONS).schema("id string, a string, b string").csv(f"{url}/{k}.csv").collect()] for k in range(2)]
    assert placed == ids[0] + ids[1]


def test_line_breaks_of_both_kinds_and_a_mark_at_the_start(spark, tmp_path, small_blocks):
    body = "\r\n".join(["a,b", '1,"x\r\ny"', "2,z", *(f'{i},"{i}\r\n"' for i in range(3, 90)), "", " ", '90,""'])
    (tmp_path / "x.csv").write_bytes(b"\xef\xbb\xbf" + body.encode())
    found = read_dataset(spark, Dataset("d", f"{tmp_path}/x.csv", "a", data_types={"a": "INTEGER", "b": "VARCHAR"}), ["a", "b"])
    got = {r["a"]: r["b"] for r in found.collect()}
    assert got == {1: "x\r\ny", 2: "z", 90: None} | {i: f"{i}\r\n" for i in range(3, 90)}


def test_inferred_types_are_those_of_the_reader(spark, tmp_path, small_blocks):
    rows = [f'{i},{i * 3_000_000_000},{i}.5,"a\n{i}",true,2020-01-{i % 28 + 1:02},' for i in range(60)]
    (tmp_path / "x.csv").write_text("i,l,d,s,b,t,n\n" + "\n".join(rows) + "\n")
    want = spark.read.options(**OPTIONS, inferSchema=True).csv(f"{tmp_path}/x.csv")
    found = read_dataset(spark, Dataset("d", f"{tmp_path}/x.csv", "i"), want.columns)
    assert found.dtypes == want.dtypes
    assert sorted(map(tuple, found.collect())) == sorted(map(tuple, want.collect()))


def test_headers_and_empty_files(spark, tmp_path):
    (tmp_path / "d").mkdir()
    for name, body in (("a", '"x\ny",z\n'), ("b", ""), ("c", 'x,z\n1,"2\n3"')):
        (tmp_path / "d" / f"{name}.csv").write_text(body)
    assert [r["record"] for r in csv_records(spark, f"{tmp_path}/d").collect()] == ['1,"2\n3"']
