"""DataFrame operators over transport-stream columns: mux_column stores payloads, parse_column reads them back.

Defined results: a null payload or stream stays null in all columns; an empty payload is a stream of tables alone; a stream
that breaks a rule of the format has a message in the column error and nulls in the others, and the job goes on; null keys
and repeated rows are each handled; a text or stream of any length is handled whole, in one worker, by itself; columns of
other names, whatever they are, are ignored, and kept ones may not be called like an added one; an empty table gives an
empty result.
"""

from __future__ import annotations

import hashlib
import zlib

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .batches import fresh, map_slices
from .transport_stream import demux, mux

#: What parse_column adds. payload_*: of all elementary streams by pid; units: of all of them, in that order.
PARSED = (
    "payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, packets long, "
    "streams array<struct<pid:int,program:int,kind:int,payload_bytes:bigint,payload_sha256:string>>, "
    "units array<struct<pid:int,pts:bigint,dts:bigint,random_access:boolean,start:bigint,bytes:bigint>>, error string"
)
_NAMES = ["payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "packets", "streams", "units", "error"]
_STREAM = pa.struct([("pid", pa.int32()), ("program", pa.int32()), ("kind", pa.int32()), ("payload_bytes", pa.int64()), ("payload_sha256", pa.string())])
_UNIT = pa.struct([("pid", pa.int32()), ("pts", pa.int64()), ("dts", pa.int64()), ("random_access", pa.bool_()), ("start", pa.int64()), ("bytes", pa.int64())])
_TYPES = [pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.list_(_STREAM), pa.list_(_UNIT), pa.string()]


def padded_payload(text: str = "text"):
    """The column's UTF-8 bytes with zero bytes appended up to a positive multiple of 64; null: empty."""
    body = F.coalesce(F.col(text), F.lit("")).cast("binary")
    n = F.octet_length(body)
    whole = F.greatest(F.lit(64), F.ceil(n / 64).cast("int") * 64)
    return F.concat(body, F.unhex(F.repeat(F.lit("00"), whole - n)))


def mux_column(df: DataFrame, payload: str, keep: list[str]) -> DataFrame:
    """Return the kept columns and media: the transport stream of the payload column, null where that is."""
    kept, own = df.select(*keep).schema, fresh(df, "_payload")

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        media = [None if x is None else mux(x) for x in batch.column(own).to_pylist()]
        return pa.RecordBatch.from_arrays([*(batch.column(c) for c in keep), pa.array(media, pa.binary())], [*keep, "media"])

    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in kept), "media binary"])
    return map_slices(df.select(*keep, F.col(payload).alias(own)), own, work, schema)


def parsed(stream: bytes | None) -> tuple:
    """The added columns of one stream."""
    if stream is None:
        return (None,) * len(_NAMES)
    try:
        m = demux(stream)
    except ValueError as error:
        return (*(None,) * (len(_NAMES) - 1), str(error))
    payload = m.payload
    streams = [{"pid": s.pid, "program": s.program, "kind": s.kind, "payload_bytes": len(s.payload), "payload_sha256": hashlib.sha256(s.payload).hexdigest()} for _, s in sorted(m.streams.items())]
    units = [{"pid": pid, "pts": u.pts, "dts": u.dts, "random_access": u.random_access, "start": u.start, "bytes": u.end - u.begin} for pid, s in sorted(m.streams.items()) for u in s.units]
    return len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]), len(stream), hashlib.sha256(stream).hexdigest(), m.packets, streams, units, None


def parse_column(df: DataFrame, media: str, keep: list[str]) -> DataFrame:
    """Parse the media column: the kept columns and those of PARSED."""
    kept, own = df.select(*keep).schema, fresh(df, "_media")

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        rows = [parsed(x) for x in batch.column(own).to_pylist()]
        columns = [pa.array([r[i] for r in rows], t) for i, t in enumerate(_TYPES)]
        return pa.RecordBatch.from_arrays([*(batch.column(c) for c in keep), *columns], [*keep, *_NAMES])

    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in kept), PARSED])
    return map_slices(df.select(*keep, F.col(media).alias(own)), own, work, schema)
