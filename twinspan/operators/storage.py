"""The shared folder that every executor reads and writes, and lineage cuts into it."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from contextvars import ContextVar
from typing import Any

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

#: The folder that takes intermediate tables while intermediates() is entered.
_folder: ContextVar[str | None] = ContextVar("twinspan_folder", default=None)


def shared_dir(spark: SparkSession) -> str:
    """The folder named by spark.checkpoint.dir. Where that is unset: a temporary one on a local master, else an error."""
    sc = spark.sparkContext
    named = sc.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if named:
        if not sc.getCheckpointDir():
            sc.setCheckpointDir(named)
        return named
    known = sc.getCheckpointDir()
    if not known:
        if not (sc.master or "").startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        sc.setCheckpointDir("file://" + tempfile.mkdtemp(prefix="twinspan-"))
        known = sc.getCheckpointDir()
    return known


def new_path(spark: SparkSession, name: str) -> str:
    """A path of its own in the folder of intermediates(), or else in the shared folder."""
    return f"{(_folder.get() or shared_dir(spark)).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def is_plain_name(name: Any) -> bool:
    """Whether a text names one folder: letters, digits, dots, dashes and underscores, the first no dot."""
    return isinstance(name, str) and re.fullmatch(r"[A-Za-z0-9_-][A-Za-z0-9_.-]*", name) is not None


def _system(spark: SparkSession, path: str):
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), where


def path_exists(spark: SparkSession, path: str) -> bool:
    system, where = _system(spark, path)
    return system.exists(where)


def byte_size(spark: SparkSession, path: str) -> int:
    """Bytes of a file, or of all files of a folder."""
    system, where = _system(spark, path)
    return system.getContentSummary(where).getLength()


def make_folder(spark: SparkSession, path: str) -> None:
    """Make a folder that is not there yet; FileExistsError where anything of that name is."""
    system, where = _system(spark, path)
    if system.exists(where):
        raise FileExistsError(f"{path} is there already")
    if not system.mkdirs(where):
        raise OSError(f"{path} cannot be made")


@contextmanager
def intermediates(spark: SparkSession, name: str, root: str | None = None) -> Iterator[str]:
    """Intermediate tables made inside go to a new folder under root (default: the shared folder), which is deleted at
    the end, so results must be written before that. root must be a folder that all executors share. name is the folder's
    own plain name; where a folder of that name is there already, it is left alone and FileExistsError raised."""
    if not is_plain_name(name):
        raise ValueError(f"not the name of one folder: {name!r}")
    path = f"{(root or shared_dir(spark)).rstrip('/')}/{name}"
    make_folder(spark, path)
    before = _folder.set(path)
    try:
        yield path
    finally:
        _folder.reset(before)
        drop_path(spark, path)


def materialise(df: DataFrame, name: str) -> DataFrame:
    """Write df as Parquet in the shared folder and read it back: cuts lineage, survives lost executors."""
    return materialise_at(df, new_path(df.sparkSession, name))


def materialise_at(df: DataFrame, path: str) -> DataFrame:
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def materialise_counted(df: DataFrame, name: str, **facts: Column) -> tuple[DataFrame, dict[str, Any]]:
    """materialise(), and aggregates of the rows that were written, without a job of their own: by default n, their number."""
    seen = Observation()
    found = df.observe(seen, *[c.alias(k) for k, c in (facts or {"n": F.count(F.lit(1))}).items()])
    return materialise(found, name), seen.get


def drop_path(spark: SparkSession, path: str) -> None:
    """Delete a path that this library has made, by the file system that owns it."""
    system, where = _system(spark, path)
    system.delete(where, True)
