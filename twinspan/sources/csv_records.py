"""Records of CSV files whose quoted fields may hold line breaks, read in parallel.

Spark cuts large text files into blocks at line ends and reads their lines; whether a line begins a record depends on
whether the lines before it left a quoted field open. So each block is scanned for both cases, which gives one row for a
block: how a field is left at its end in either case. Of these a window over each file's blocks makes the true case at
every block's start, and a second scan then joins the lines of each record. Records that a block's end cuts are put
together from the few blocks concerned. One row for a block is all that is broadcast.

Quotes count as RFC 4180 has them: a field is quoted if its first character but white space is a quote, and doubled quotes
inside stand for one. A line break is LF or CRLF; inside a field it stays as it stands. Records of white space only are no
records. The first record of each file is its header.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from twinspan.operators.storage import byte_size, materialise

QUOTE = ord('"')
#: What is skipped before a field.
_BLANK = bytes(range(0x21))
#: Pieces of records: whole ones, the rest of a record of an earlier block, and one that the block's end cuts.
WHOLE, REST, CUT = 0, 1, 2


def open_at_end(line: str, inside: bool) -> bool:
    """Whether a quoted field is open behind a line, told whether one is before it."""
    at, n = 0, len(line)
    while True:
        if not inside:
            while at < n and line[at] <= " ":
                at += 1
            if line[at : at + 1] != '"':
                at = line.find(",", at) + 1
                if not at:
                    return False
                continue
            at += 1
        at = line.find('"', at)
        while at >= 0 and line[at + 1 : at + 2] == '"':
            at = line.find('"', at + 2)
        if at < 0:
            return True
        inside = False
        at = line.find(",", at) + 1
        if not at:
            return False


def _quotes(lines: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The bytes of lines, where each line begins in them (and the last ends), and where quotes are."""
    offsets = np.frombuffer(lines.buffers()[1], np.int32, len(lines) + 1, lines.offset * 4).astype(np.int64)
    data = np.frombuffer(lines.buffers()[2] or b"", np.uint8)[offsets[0] : offsets[-1]]
    return data, offsets - offsets[0], np.flatnonzero(data == QUOTE)


def open_after(lines: pa.Array, inside: bool) -> np.ndarray:
    """open_at_end() of each of consecutive lines.

    Where quotes stand at the ends of fields or doubled only, counting them tells; other lines are gone through one by one.
    """
    data, offsets, quotes = _quotes(lines)
    if not len(quotes):
        return np.full(len(lines), inside)
    opens = (np.arange(len(quotes)) + inside) % 2 == 0
    at = quotes[opens]
    begins = np.zeros(len(data) + 1, bool)
    begins[offsets] = True
    before = data[at - 1]  # of no meaning at a line's start
    proper = begins[at] | (before == ord(",")) | (before == QUOTE)
    for i in at[~proper]:
        start = offsets[np.searchsorted(offsets, i, side="right") - 1]
        head = bytes(data[start:i]).rstrip(_BLANK)
        if head and not head.endswith(b",") or len(head) == i - start:
            break
    else:
        counts = np.searchsorted(quotes, offsets[1:])
        return (counts + inside) % 2 == 1
    out = []
    for line in lines.to_pylist():
        inside = open_at_end(line, inside) if '"' in line else inside
        out.append(inside)
    return np.array(out, bool)


def _lines(spark: SparkSession, url: str, places: bool) -> DataFrame:
    """line, file (a hash of its path), block (its start in the file), and path if asked."""
    found = spark.read.option("lineSep", "\n").text(url)
    path = F.col("_metadata.file_path")
    return found.select(F.col("value").alias("line"), F.xxhash64(path).alias("file"), F.col("_metadata.file_block_start").alias("block"), *([path.alias("path")] if places else []))


def _runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Batches cut where another block begins; the lines of a block come in order."""
    for batch in batches:
        if not batch.num_rows:
            continue
        file, block = (batch.column(c).to_numpy() for c in ("file", "block"))
        cuts = [0, *((file[1:] != file[:-1]) | (block[1:] != block[:-1])).nonzero()[0] + 1, batch.num_rows]
        for a, b in zip(cuts[:-1], cuts[1:], strict=True):
            yield batch.slice(int(a), int(b - a))


def _summaries(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """For each block: whether a field is open at its end if none is at its start (end_0), and if one is (end_1)."""
    key, ends = None, [False, True]

    def row() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([x]) for x in (*key, *ends)], ["file", "block", "end_0", "end_1"])

    for run in _runs(batches):
        own = (run.column("file")[0].as_py(), run.column("block")[0].as_py())
        if own != key:
            if key:
                yield row()
            key, ends = own, [False, True]
        lines = run.column("line")
        quoted = lines.filter(pc.match_substring(lines, '"'))
        n = 0
        while n < len(quoted) and ends[0] != ends[1]:
            ends = [open_at_end(quoted[n].as_py(), e) for e in ends]
            n += 1
        if n < len(quoted):  # both cases have come to the same
            ends = [bool(open_after(quoted.slice(n), ends[0])[-1])] * 2
    if key:
        yield row()


def _starts(lines: DataFrame) -> DataFrame:
    """file, block, inside (whether a quoted field is open at the block's start) and after (whether one is at its end)."""
    found = lines.select("line", "file", "block").mapInArrow(_summaries, "file long, block long, end_0 boolean, end_1 boolean")
    before = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    upto = Window.partitionBy("file").orderBy("block")
    turns = F.sum((F.col("end_0") & ~F.col("end_1")).cast("int")).over(upto)
    found = found.withColumn("turns", turns).withColumn("fixed", F.when(F.col("end_0") == F.col("end_1"), F.struct(F.col("end_0").cast("int").alias("end"), F.col("turns").alias("turns"))))
    last, so_far = F.last("fixed", ignorenulls=True).over(before), F.coalesce(F.last("turns").over(before), F.lit(0))
    state = F.coalesce(last["end"], F.lit(0)) + so_far - F.coalesce(last["turns"], F.lit(0))
    found = found.withColumn("inside", state % 2 == 1)
    return found.select("file", "block", "inside", F.when(F.col("inside"), F.col("end_1")).otherwise(F.col("end_0")).alias("after"))


def _joiner(whole: bool, places: bool, cut: bool = True):
    """Joins the lines of records; lines come with inside. whole: returns whole records, but for headers; else pieces.
    Without cut, no block ends inside a record but at its file's end."""
    names = [*([] if whole else ["kind", "file"]), *(["block", "row"] if places or not whole else []), *(["path"] if places else []), "record"]

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, inside, row, held, kind, path = None, False, 0, [], WHOLE, None

        def out(records: pa.Array, kind: int, first: int) -> Iterator[pa.RecordBatch]:
            if (kind == WHOLE) != whole or not len(records):
                return
            if whole and first == 0 and key[1] == 0:  # the file's header
                records, first = records[1:], 1
            n = len(records)
            known = {"kind": lambda: pa.array(np.full(n, kind, np.int32)), "file": lambda: pa.array(np.full(n, key[0])), "block": lambda: pa.array(np.full(n, key[1]))}
            known |= {"row": lambda: pa.array(np.arange(first, first + n)), "path": lambda: pa.array([path] * n, pa.string()), "record": lambda: records}
            yield pa.RecordBatch.from_arrays([known[c]() for c in names], names)

        def joined(parts: list[pa.Array], bounds: np.ndarray) -> pa.Array:
            records = pc.binary_join(pa.ListArray.from_arrays(pa.array(bounds.astype(np.int32)), pa.concat_arrays(parts)), "\n")
            # of a CRLF at a record's end; pieces are trimmed when they are whole
            return pc.replace_substring_regex(records, "\r$", "") if whole and pc.any(pc.ends_with(records, "\r")).as_py() else records

        def ended() -> Iterator[pa.RecordBatch]:
            if held:
                yield from out(joined(held, np.array([0, sum(map(len, held))])), REST if kind == REST else CUT if cut else WHOLE, row)

        for run in _runs(batches):
            own = (run.column("file")[0].as_py(), run.column("block")[0].as_py())
            if own != key:
                if key:
                    yield from ended()
                key, row, held, inside = own, 0, [], run.column("inside")[0].as_py()
                kind = REST if inside else WHOLE
                path = run.column("path")[0].as_py() if places else None
            lines = run.column("line")
            after = open_after(lines, inside)
            inside = bool(after[-1])
            last = np.flatnonzero(~after) + 1  # behind the last line of each record
            if not len(last):
                held.append(lines)
                continue
            n = sum(map(len, held))
            records = joined([*held, lines[: last[-1]]], np.concatenate([[0], n + last]))
            held = [lines[last[-1] :]] if last[-1] < len(lines) else []
            if kind == REST:
                yield from out(records[:1], REST, row)
                records, row = records[1:], row + 1
            yield from out(records, WHOLE, row)
            row, kind = row + len(records), WHOLE
        if key:
            yield from ended()

    return work


def csv_records(spark: SparkSession, url: str, place: str | None = None) -> DataFrame:
    """record (text) of every record but headers, and, if a name is given, a column by which records sort as they stand."""
    places = place is not None
    lines = _lines(spark, url, places)
    at = "block long, row long, " if places else ""
    path = "path string, " if places else ""
    kind = f"{at}{path}record string"
    if not _is_cut(spark, url):
        whole = lines.withColumn("inside", F.lit(False)).mapInArrow(_joiner(True, places, False), kind)
        return _proper(whole, place)
    starts = materialise(_starts(lines), "csv-blocks")
    # one row a block of the input
    whole = lines.join(F.broadcast(starts.drop("after")), ["file", "block"]).mapInArrow(_joiner(True, places), kind)
    concerned = starts.where("inside or after").drop("after")
    pieces = lines.join(F.broadcast(concerned), ["file", "block"]).mapInArrow(_joiner(False, places), f"kind int, file long, block long, row long, {path}record string")
    in_order = Window.partitionBy("file").orderBy("block", "row", "kind")
    pieces = pieces.withColumn("of", F.sum((F.col("kind") == CUT).cast("int")).over(in_order))
    parts = F.array_sort(F.collect_list(F.struct("block", "row", "kind", "record", *(["path"] if places else []))))
    first = F.col("parts")[0]
    mended = pieces.groupBy("file", "of").agg(parts.alias("parts")).where(~((first["block"] == 0) & (first["row"] == 0)))
    columns = [first[c].alias(c) for c in (["block", "row", "path"] if places else [])]
    mended = mended.select(*columns, F.regexp_replace(F.array_join(F.transform("parts", lambda p: p["record"]), "\n"), r"\r\z", "").alias("record"))
    # made once, so that the records can be read again in one scan
    return _proper(whole.unionByName(materialise(mended, "csv-pieces")), place)


def _proper(found: DataFrame, place: str | None) -> DataFrame:
    found = found.where(F.col("record").rlike(r"[^\x00-\x20]"))
    return found.select("record", *([F.struct(F.col("path").alias("file"), "block", "row").alias(place)] if place else []))


def _is_cut(spark: SparkSession, url: str) -> bool:
    """Whether Spark may cut files of this path into blocks: not where all of them have fewer bytes than a block's least."""
    jvm = spark.sparkContext._jvm
    least = jvm.org.apache.spark.network.util.JavaUtils.byteStringAsBytes(spark.conf.get("spark.sql.files.openCostInBytes"))
    try:
        return byte_size(spark, url) > least
    except Exception:  # a pattern, or a store that does not say
        return True
