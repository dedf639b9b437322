"""WARC archives: write pages as records, index first, then read records back by coalesced byte ranges.

write_archives() writes one archive per task into a folder and commits an index (file, offset, length, url, digest and
the like per record) as Parquet; only what the index names counts, so files of failed or repeated tasks do no harm.
read_records() deals the selected index rows over tasks by bytes, sorts them by file and offset, joins neighbouring
ranges into one read, and parses and verifies each record. Each record is a gzip member of its own, so any range of
records can be read alone.

Of records with equal payloads of at least REVISIT_BYTES, that with the largest id is a response and others revisit it.
A response's block is an HTTP response whose body is the payload; a revisit's is that response's head alone. Record ids
name the archive and the place in it, so they differ even where page ids repeat.

Defined results: a null html is an empty payload; a null url an empty one; of equal payloads under the bound each is a
response; where the largest id itself is repeated, each of its rows is a response; a null id counts below all others, and
where all ids of a group are null each row is a response; a very long payload is one record, read and written whole; an
empty table gives an empty result; other columns, whatever their names, are ignored.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from twinspan.operators.storage import materialise

from .batches import bound_batches, slices

REVISIT_BYTES = 1000
#: Ranges no further apart than this are read at once, up to the size of one read.
GAP_BYTES, READ_BYTES = 64 << 10, 4 << 20
#: Bytes of records, packed, that one task reads.
SPLIT_BYTES = 8 << 20
INDEX = "file string, offset long, length long, page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long"
_INDEX_NAMES = [x.split()[0] for x in INDEX.split(", ")]
_INDEX_TYPES = [pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64()]
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


# Fixed value: the one moment at which all pages count as fetched.
DATE = "1970-01-01T00:00:00Z"


def _uri(url: str) -> str:
    return url.replace("\r", "%0D").replace("\n", "%0A")


def record(name: str, page_id: int | None, url: str, body: bytes, digest: str, refers_to: int | None = None, refers_to_url: str | None = None) -> bytes:
    """One WARC record, not yet compressed: a revisit if it refers to a page, else a response. name: unique to it."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(body)}\r\n\r\n".encode()
    block = http + body if refers_to is None else http
    head = [
        "WARC/1.1",
        f"WARC-Type: {'response' if refers_to is None else 'revisit'}",
        f"WARC-Record-ID: <urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, name)}>",
        f"WARC-Target-URI: {_uri(url)}",
        f"WARC-Date: {DATE}",
        f"WARC-Payload-Digest: sha1:{base64.b32encode(bytes.fromhex(digest)).decode()}",
        "Content-Type: application/http; msgtype=response",
        f"Content-Length: {len(block)}",
        f"X-Page-Id: {'' if page_id is None else page_id}",
    ]
    if refers_to is not None:
        head += [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To-Target-URI: {_uri(refers_to_url or '')}", f"WARC-Refers-To-Date: {DATE}", f"X-Refers-To-Page-Id: {refers_to}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def parsed(raw: bytes) -> tuple[dict[str, str], bytes]:
    """Header fields and payload of a record; raises ValueError if it is damaged."""
    head, _, rest = raw.partition(b"\r\n\r\n")
    lines = head.decode().split("\r\n")
    if lines[0] != "WARC/1.1":
        raise ValueError("not a WARC record")
    fields = {k: v for k, _, v in (x.partition(": ") for x in lines[1:])}
    n = int(fields["Content-Length"])
    if rest[n:] != b"\r\n\r\n":
        raise ValueError("record length is wrong")
    http, parted, body = rest[:n].partition(b"\r\n\r\n")
    if not http.startswith(b"HTTP/") or not parted:
        raise ValueError("block is no HTTP response")
    return fields, body


def _gzip(data: bytes) -> bytes:
    packer = zlib.compressobj(6, zlib.DEFLATED, 31)
    return packer.compress(data) + packer.flush()


def arrow_uri(folder: str) -> str:
    """Arrow's name of a folder named as Spark names it."""
    scheme, _, rest = folder.partition("://")
    return f"s3://{rest}" if scheme in ("s3a", "s3n") else folder


def planned(pages: DataFrame) -> DataFrame:
    """Each page's payload, digest, record type and the response it refers to."""
    body = F.coalesce(F.col("html"), F.lit("")).cast("binary")
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.coalesce("url", F.lit("")).alias("url"), body.alias("body"), F.octet_length(body).cast("long").alias("payload_bytes"), F.sha1(body).alias("payload_digest"))
    groups = rows.where(F.col("payload_bytes") >= REVISIT_BYTES).groupBy("payload_digest").agg(F.max("payload_bytes").alias("payload_bytes"), F.max(F.struct("page_id", "url")).alias("_first"), F.count(F.lit(1)).alias("_n"))
    # Only digests that repeat are joined. They are a table of their own, so both sides of the join are dealt anew and
    # adaptive execution can split a hot digest, or broadcast them if they are few.
    groups = materialise(groups.where((F.col("_n") > 1) & F.col("_first.page_id").isNotNull()).select("payload_digest", "payload_bytes", F.col("_first.page_id").alias("_id"), F.col("_first.url").alias("_url")), "repeated")
    joined = rows.join(groups, ["payload_digest", "payload_bytes"], "left")
    revisit = F.col("_id").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("_id"))
    return joined.select("page_id", "url", "body", "payload_bytes", "payload_digest", F.when(revisit, "revisit").otherwise("response").alias("record_type"), F.when(revisit, F.col("_id")).alias("refers_to"), F.when(revisit, F.col("_url")).alias("refers_to_url"))


_PLANNED = ["page_id", "url", "body", "payload_bytes", "payload_digest", "record_type", "refers_to", "refers_to_url"]


def write_archives(pages: DataFrame, folder: str) -> str:
    """Write pages (page_id, url, html) as archives into folder, then the index; return the index's path."""
    bound_batches(pages.sparkSession)

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, root = fs.FileSystem.from_uri(arrow_uri(folder))
        file, out, at = f"{uuid.uuid4().hex}.warc.gz", None, 0
        try:
            for batch in batches:
                for part in slices(batch, "body"):
                    if out is None:
                        store.create_dir(root, recursive=True)
                        out = store.open_output_stream(f"{root}/{file}", compression=None)
                    rows = []
                    for page_id, url, body, size, digest, kind, refers_to, refers_to_url in zip(*(part.column(c).to_pylist() for c in _PLANNED), strict=True):
                        packed = _gzip(record(f"{file}:{at}", page_id, url, body, digest, refers_to, refers_to_url))
                        out.write(packed)
                        rows.append((file, at, len(packed), page_id, url, size, digest, kind, refers_to))
                        at += len(packed)
                    yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate(_INDEX_TYPES)], _INDEX_NAMES)
        finally:
            if out is not None:
                out.close()

    index = f"{folder}/index.parquet"
    planned(pages).mapInArrow(write, INDEX).write.parquet(index)
    return index


def coalesced(ranges: list[tuple[int, int]]) -> Iterator[tuple[int, int, list[tuple[int, int]]]]:
    """Join sorted (offset, length) ranges into reads: start, end and the ranges inside."""
    start = end = 0
    held: list[tuple[int, int]] = []
    for offset, length in ranges:
        if held and (offset - end > GAP_BYTES or offset + length - start > READ_BYTES):
            yield start, end, held
            held = []
        if not held:
            start = end = offset
        held.append((offset, length))
        end = max(end, offset + length)
    if held:
        yield start, end, held


READ = "page_id long, url string, record_type string, payload_digest string, refers_to long, body binary"


def read_records(selected: DataFrame, folder: str) -> DataFrame:
    """Read the records of selected index rows: sorted byte ranges, coalesced; digests of responses are verified."""
    spark = selected.sparkSession
    bound_batches(spark)
    size = selected.agg(F.sum("length").alias("bytes"), F.approx_count_distinct("file").alias("files")).first()  # one row
    tasks = max(-(-(size["bytes"] or 0) // SPLIT_BYTES), min(size["files"], spark.sparkContext.defaultParallelism), 1)
    rows = selected.select("file", "offset", "length").repartitionByRange(tasks, "file", "offset").sortWithinPartitions("file", "offset")

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, root = fs.FileSystem.from_uri(arrow_uri(folder))
        name, source = None, None
        for batch in batches:
            table: dict[str, list[tuple[int, int]]] = {}
            for file, offset, length in zip(*(batch.column(c).to_pylist() for c in ("file", "offset", "length")), strict=True):
                table.setdefault(file, []).append((offset, length))
            for file, ranges in table.items():
                if file != name:
                    if source is not None:
                        source.close()
                    name, source = file, store.open_input_file(f"{root}/{file}")
                for start, end, inside in coalesced(ranges):
                    source.seek(start)
                    data, out = source.read(end - start), []
                    for offset, length in inside:
                        fields, body = parsed(zlib.decompress(data[offset - start : offset - start + length], 31))
                        digest = base64.b32decode(fields["WARC-Payload-Digest"].removeprefix("sha1:")).hex()
                        if fields["WARC-Type"] == "response" and hashlib.sha1(body).hexdigest() != digest:
                            raise ValueError(f"{file} at {offset}: payload digest differs")
                        refers_to = fields.get("X-Refers-To-Page-Id")
                        out.append((int(fields["X-Page-Id"]) if fields["X-Page-Id"] else None, fields["WARC-Target-URI"], fields["WARC-Type"], digest, int(refers_to) if refers_to else None, body))
                    types = [pa.int64(), pa.string(), pa.string(), pa.string(), pa.int64(), pa.binary()]
                    yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], t) for i, t in enumerate(types)], [x.split()[0] for x in READ.split(", ")])
        if source is not None:
            source.close()

    return rows.mapInArrow(read, READ)


def round_trip(pages: DataFrame, folder: str) -> DataFrame:
    """Write pages as archives and read every record back; payload size of a revisit is that of the response it names."""
    index = pages.sparkSession.read.schema(INDEX).parquet(write_archives(pages, folder))
    read = read_records(index, folder).select("page_id", F.octet_length("body").cast("long").alias("_size"), "payload_digest", "record_type", "refers_to")
    read = materialise(read, "records")  # each archive is read and parsed once
    sizes = read.where((F.col("record_type") == "response") & (F.col("_size") >= REVISIT_BYTES)).groupBy("payload_digest").agg(F.max("page_id").alias("refers_to"), F.max("_size").alias("_full"))
    sizes = materialise(sizes, "responses")
    revisits = read.where(F.col("record_type") == "revisit").join(sizes, ["payload_digest", "refers_to"], "left")
    columns = lambda df, size: df.select("page_id", F.col(size).alias("payload_bytes"), "payload_digest", "record_type", "refers_to")
    return columns(read.where(F.col("record_type") == "response"), "_size").unionByName(columns(revisits, "_full"))
