"""Arrow batches of text, cut by bytes, so that a worker's memory does not grow with the longest documents."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import DataType, StructField, StructType

from twinspan.operators.rows import fresh as fresh

#: Bytes of text that a worker handles at once; one longer text makes a slice of its own.
SLICE_BYTES = 4 << 20


def bound_batches(spark: SparkSession, n_bytes: int = 8 << 20) -> None:
    """Have Spark cut the Arrow batches it sends to Python by bytes, unless the session sets its own bound."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    if spark.sparkContext.getConf().get(key) is None:
        spark.conf.set(key, str(n_bytes))


def slices(batch: pa.RecordBatch, column: str, limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Cut batch where the column's bytes pass the limit."""
    array = batch.column(column)
    if batch.num_rows == 0:
        return
    ends = byte_offsets(array)
    start = 0
    while start < batch.num_rows:
        stop = int(np.searchsorted(ends, ends[start] + limit, side="right")) - 1
        stop = min(max(stop, start + 1), batch.num_rows)
        yield batch.slice(start, stop - start)
        start = stop


def byte_offsets(array: pa.Array) -> np.ndarray:
    """The n + 1 offsets of a binary or string array, into its own buffer."""
    wide = pa.types.is_large_binary(array.type) or pa.types.is_large_string(array.type)
    raw = array.buffers()[1]
    if raw is None:
        return np.zeros(len(array) + 1, np.int64)
    kind = np.int64 if wide else np.int32
    offsets = np.frombuffer(raw, kind, len(array) + 1, array.offset * np.dtype(kind).itemsize)
    return offsets.astype(np.int64)


def joined_bytes(array: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all values one after the other, and the n + 1 offsets into them."""
    offsets = byte_offsets(array)
    data = array.buffers()[2]
    if data is None or len(array) == 0:
        return np.zeros(0, np.uint8), np.zeros(len(array) + 1, np.int64)
    return np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]], offsets - offsets[0]


def map_slices(df: DataFrame, column: str, work: Callable[[pa.RecordBatch], pa.RecordBatch], schema: str | StructType, limit: int = SLICE_BYTES) -> DataFrame:
    """Run work on byte-bounded slices of df in Python workers."""
    bound_batches(df.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, column, limit):
                yield work(part)

    return df.mapInArrow(run, schema)


def struct_of(df: DataFrame, keep: list[str], *more: tuple[str, str]) -> StructType:
    """The types of the kept columns, all nullable, and more columns of (name, type as DDL)."""
    out = StructType([StructField(n, df.schema[n].dataType, True) for n in keep])
    for name, kind in more:
        out.add(name, DataType.fromDDL(kind))
    return out
