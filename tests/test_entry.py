"""The driver's contract, and the library without its llm part."""

import os
import shutil
import subprocess
import sys

import duckdb
import pandas as pd
import pytest

import __spark_entry__ as contract
from twinspan import queries as linkage

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def rows(df):
    df = df[sorted(df.columns)].astype(object).where(lambda x: x.notna(), None)
    plain = lambda v: None if v is None else float(v) if isinstance(v, int | float) or pd.api.types.is_number(v) else str(v)
    return sorted((tuple(map(plain, r)) for r in df.itertuples(index=False)), key=repr)


@pytest.mark.parametrize("name", sorted(linkage.oracle_sql()))
def test_query_equals_its_sql(spark, name):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    want = con.execute(linkage.oracle_sql()[name]).df()
    got = linkage.queries()[name](spark, SF).toPandas()
    assert sorted(got.columns) == sorted(want.columns)
    assert rows(got) == rows(want)


def test_entry(spark):
    df = contract.entry(spark)
    assert df.columns[:2] == ["p_partkey", "ENTITY_ID"] and df.count() > 0


def test_every_oracle_has_a_query():
    assert set(contract.oracle_sql()) <= set(contract.queries())


def test_without_llm(tmp_path):
    copy = tmp_path / "copy"
    shutil.copytree(ROOT, copy, ignore=shutil.ignore_patterns(".git", "__pycache__", "llm", "corpus_pipeline.py"))
    said = subprocess.run(
        [sys.executable, "-c", "import __spark_entry__ as e; print(len(e.queries()), any(n.startswith('op1_') or n == 'pipeline' for n in e.queries()), len(e.oracle_sql()))"],
        cwd=copy, env=os.environ | {"PYTHONPATH": str(copy)}, capture_output=True, text=True, timeout=120,
    )
    assert said.stdout.split() == [str(len(linkage.queries())), "False", str(len(linkage.oracle_sql()))], said.stderr


def test_where_a_library_of_llm_is_missing(tmp_path):
    code = "import sys; sys.modules['xxhash'] = None\nimport __spark_entry__ as e; print(len(e.queries()))"
    said = subprocess.run([sys.executable, "-c", code], cwd=ROOT, env=os.environ | {"PYTHONPATH": ROOT}, capture_output=True, text=True, timeout=120)
    assert said.stdout.split() == [str(len(linkage.queries()))] and "left out" in said.stderr, said.stderr


def test_without_llm_but_with_its_empty_folder(tmp_path):
    copy = tmp_path / "copy"
    shutil.copytree(ROOT, copy, ignore=shutil.ignore_patterns(".git", "__pycache__", "llm"))
    (copy / "twinspan/llm/__pycache__").mkdir(parents=True)
    said = subprocess.run([sys.executable, "-c", "import __spark_entry__ as e; print(len(e.queries()))"], cwd=copy, env=os.environ | {"PYTHONPATH": str(copy)}, capture_output=True, text=True, timeout=120)
    assert said.stdout.split() == [str(len(linkage.queries()))], said.stderr


def test_nothing_else_imports_llm():
    for folder, _, names in os.walk(f"{ROOT}/twinspan"):
        if "/llm" not in folder:
            for n in names:
                if n.endswith(".py"):
                    body = open(f"{folder}/{n}").read()
                    assert "twinspan.llm" not in body and "from .llm" not in body, n
