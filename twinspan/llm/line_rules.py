"""Quality rules by cross-document line frequency: lines that many documents of a host share are removed, and documents
that this depletes are rejected.

A line's normal form: A-Z lower-cased, each run of digits one 0, runs of ASCII white space one space, none at the ends.
Lines without a word have none. Normal forms are hashed (XXH64); the distinct documents of a host that hold a hash are
counted. Copies of a text are one document, whatever their number: boilerplate is what different documents share. A line is
frequent if over Limits.least documents and over Limits.share percent of the host's documents hold it. A document is
depleted if under Limits.words words are left without its frequent lines, or under Limits.left percent of its words.

Each text's lines are hashed where it is read; only hashes are shuffled, once for each distinct text of a host and once,
pre-aggregated, for each distinct line. Frequent lines meet the texts in a join whose way Spark picks by their size.

Base rules come first: base_failed is true of a document of under Limits.words words, or with over Limits.repeated percent
of its words in repeated windows of WINDOW words; a document that they reject still counts as one that holds its lines.

Defined results: a null text counts as empty and fails the base rules; null ids and repeated rows are each judged, and
each kept by clean(); documents without a host (null or empty) share one; a document exactly at a limit is not over it; a
text of any length is handled whole; a text that is not valid UTF-8 counts the bytes that begin a character; an empty table
gives an empty result; other columns, whatever their names, are ignored by judge() and pass through clean().
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from twinspan.operators.storage import materialise

from .batches import fresh, joined_bytes, map_slices, struct_of
from .words import WHITE, Words, counted, numbers, pieces, words_of

WINDOW = 5
SYMBOLS = b"#*$%&|<>"
COUNTERS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]


@dataclass(frozen=True)
class Limits:
    least: int = 10
    share: int = 2
    words: int = 10
    left: int = 50
    repeated: int = 20


@dataclass(frozen=True)
class Lines:
    """Lines of all texts: starts and stops in the bytes, the text of each, its words (a range), its normal form's hash."""

    starts: np.ndarray
    stops: np.ndarray
    text: np.ndarray
    first: np.ndarray
    last: np.ndarray


_IS_SYMBOL = np.zeros(256, bool)
_IS_SYMBOL[list(SYMBOLS)] = True
_IS_DIGIT = np.zeros(256, bool)
_IS_DIGIT[list(b"0123456789")] = True
#: What a byte is in a line's normal form.
_NORMAL = np.arange(256, dtype=np.uint8)
_NORMAL[65:91] += 32
_NORMAL[_IS_DIGIT] = ord("0")


def lines_of(data: np.ndarray, offsets: np.ndarray, words: Words) -> Lines:
    """All lines; a text has one more than line feeds."""
    breaks = np.flatnonzero(data == 10)
    n = np.diff(np.searchsorted(breaks, offsets)) + 1
    text = np.repeat(np.arange(len(n)), n)
    begins, ends = np.cumsum(n) - n, np.cumsum(n) - 1
    starts, stops = np.empty(len(text), np.int64), np.empty(len(text), np.int64)
    inner = np.ones(len(text), bool)
    inner[begins] = False
    starts[begins], starts[inner] = offsets[:-1], breaks + 1
    inner[:] = True
    inner[ends] = False
    stops[ends], stops[inner] = offsets[1:], breaks
    return Lines(starts, stops, text, np.searchsorted(words.starts, starts), np.searchsorted(words.starts, stops))


def normal_hashes(data: np.ndarray, words: Words, lines: Lines) -> np.ndarray:
    """The hash of each line's normal form."""
    kept, is_digit = ~WHITE[data], _IS_DIGIT[data]
    again = is_digit[1:] & is_digit[:-1]
    again[words.starts[words.starts > 0] - 1] = False  # a word's first digit is not its neighbour's next one
    kept[1:] &= ~again
    out = _NORMAL[data]
    line = np.repeat(np.arange(len(lines.first)), lines.last - lines.first)
    gaps = words.stops[:-1][line[1:] == line[:-1]]
    kept[gaps], out[gaps] = True, ord(" ")
    total = np.zeros(len(data) + 1, np.int64)
    np.cumsum(kept, out=total[1:])
    forms = pieces(out[kept], total[lines.stops] - total[lines.starts]).dictionary_encode()
    hashes = np.array([xxhash.xxh64_intdigest(x) for x in forms.dictionary.to_pylist()], np.uint64).view(np.int64)
    return hashes[np.asarray(forms.indices)]


def repeated_words(words: Words) -> np.ndarray:
    """Whether each word is in a window of WINDOW words that its text has twice or more."""
    codes, out = words.codes, np.zeros(len(words.codes) + 1, np.int64)
    if len(codes) < WINDOW:
        return out[:-1] > 0
    text, size, many = words.text_of_each(), words.size, len(words.first)
    encoded = lambda x: numbers(pa.array(x))
    two = encoded(codes[:-1] * size + codes[1:])
    four = encoded(two[:-2] * size + two[2:])
    five = encoded(four[:-1] * size + codes[4:])
    at = np.flatnonzero(text[4:] == text[:-4])
    key = encoded(five[at] * many + text[at])
    twice = at[np.bincount(key)[key] > 1] if len(at) else at
    np.add.at(out, twice, 1)
    np.add.at(out, twice + WINDOW, -1)
    return np.cumsum(out[:-1]) > 0


def _lists(text: np.ndarray, hashes: np.ndarray, n_words: np.ndarray, many: int) -> pa.Array:
    """For each of many texts the list of its distinct hashes with the number of words under each."""
    order = np.lexsort((hashes, text))
    text, hashes, n_words = text[order], hashes[order], n_words[order]
    new = np.ones(len(text), bool)
    new[1:] = (text[1:] != text[:-1]) | (hashes[1:] != hashes[:-1])
    at = np.flatnonzero(new)
    sums = np.add.reduceat(n_words, at) if len(at) else n_words
    ends = np.searchsorted(text[at], np.arange(many + 1)).astype(np.int32)
    items = pa.StructArray.from_arrays([pa.array(hashes[at]), pa.array(sums)], ["hash", "words"])
    return pa.ListArray.from_arrays(pa.array(ends), items)


def profile(body: pa.Array) -> dict[str, pa.Array]:
    """COUNTERS of each text, and its distinct lines (hash, words)."""
    data, offsets = joined_bytes(body)
    words = words_of(data, offsets)
    lines = lines_of(data, offsets, words)
    some = np.flatnonzero(lines.last > lines.first)
    many = len(body)
    own = numbers(pieces(data[data != 10], lines.stops - lines.starts))[some] if len(some) else some
    distinct = np.unique(own * many + lines.text[some]) % many if many else own
    n_lines, n_distinct = np.bincount(lines.text[some], minlength=many), np.bincount(distinct, minlength=many)
    hashes = normal_hashes(data, words, lines)[some] if len(some) else some
    found = {
        "n_words": np.diff(words.first),
        "word_chars": counted(~WHITE[data] & ((data & 0xC0) != 0x80), offsets),
        "n_symbols": counted(_IS_SYMBOL[data], offsets),
        "n_dup_lines": n_lines - n_distinct,
        "n_repeat_words": counted(repeated_words(words), words.first),
    }
    out = {k: pa.array(np.asarray(v, np.int64)) for k, v in found.items()}
    out["lines"] = _lists(lines.text[some], hashes, (lines.last - lines.first)[some], many)
    return out


def host_of(host: str) -> Column:
    return F.coalesce(F.col(f"`{host}`").cast("string"), F.lit(""))


def profiles(docs: DataFrame, keep: list[str], host: str = "source", text: str = "text") -> DataFrame:
    """The kept columns, host (never null), COUNTERS, digest and lines of each row."""
    content = F.coalesce(F.col(text), F.lit("")).cast("binary")
    body, place, digest = fresh(docs, "_body"), fresh(docs, "_host"), fresh(docs, "_digest")
    more = [*COUNTERS, "lines"]

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        found = profile(batch.column(body))
        return pa.RecordBatch.from_arrays([*(batch.column(c) for c in [*keep, place, digest]), *(found[c] for c in more)], [*keep, "host", "digest", *more])

    rows = docs.select(*keep, host_of(host).alias(place), F.unhex(F.sha2(content, 256)).alias(digest), content.alias(body))
    types = [("host", "string"), ("digest", "binary"), *((c, "long") for c in COUNTERS), ("lines", "array<struct<hash:long,words:long>>")]
    return map_slices(rows, body, work, struct_of(docs, keep, *types))


def base_failed(limits: Limits) -> Column:
    return (F.col("n_words") < limits.words) | (100 * F.col("n_repeat_words") > limits.repeated * F.col("n_words"))


def frequent_lines(texts: DataFrame, limits: Limits = Limits()) -> DataFrame:
    """host, hash and n, the documents that hold it, of frequent lines. texts: distinct (host, digest) with lines."""
    held = texts.select("host", F.explode("lines.hash").alias("hash")).groupBy("host", "hash").agg(F.count(F.lit(1)).alias("n"))
    of_host = texts.groupBy("host").agg(F.count(F.lit(1)).alias("documents"))
    over = held.where(F.col("n") > limits.least).join(of_host, "host")
    return over.where(100 * F.col("n") > limits.share * F.col("documents")).select("host", "hash", "n")


def losses(profiled: DataFrame, limits: Limits = Limits()) -> DataFrame:
    """host, digest, n_words, removed (words in frequent lines) and hashes (of those lines) of each distinct text that has
    some."""
    texts = materialise(profiled.select("host", "digest", "n_words", "lines").dropDuplicates(["host", "digest"]), "texts")
    frequent = materialise(frequent_lines(texts, limits), "frequent-lines")
    lines = texts.select("host", "digest", "n_words", F.explode("lines").alias("line")).select("host", "digest", "n_words", "line.hash", "line.words")
    hit = lines.join(frequent.select("host", "hash"), ["host", "hash"])
    return hit.groupBy("host", "digest", "n_words").agg(F.sum("words").alias("removed"), F.collect_list("hash").alias("hashes"))


def depleted(limits: Limits) -> Column:
    left = F.col("n_words") - F.col("removed")
    return (left < limits.words) | (100 * left < limits.left * F.col("n_words"))


def judge(docs: DataFrame, key: str = "doc_id", host: str = "source", text: str = "text", limits: Limits = Limits()) -> DataFrame:
    """key, COUNTERS, base_failed and kept of each row."""
    profiled = materialise(profiles(docs, [key], host, text), "profiled")
    gone = losses(profiled, limits).where(depleted(limits)).select("host", "digest", F.lit(True).alias("gone"))
    rows = profiled.select(key, "host", "digest", *COUNTERS, base_failed(limits).alias("base_failed")).join(gone, ["host", "digest"], "left")
    return rows.select(key, *COUNTERS, "base_failed", (~F.col("base_failed") & F.col("gone").isNull()).alias("kept"))


def without_lines(body: bytes, hashes: set[int]) -> bytes:
    """A text without the lines whose normal form has one of the hashes."""
    data, offsets = np.frombuffer(body, np.uint8), np.array([0, len(body)])
    words = words_of(data, offsets)
    lines = lines_of(data, offsets, words)
    gone = (lines.last > lines.first) & np.isin(normal_hashes(data, words, lines), np.fromiter(hashes, np.int64, len(hashes)))
    return b"\n".join(body[a:b] for a, b in zip(lines.starts[~gone].tolist(), lines.stops[~gone].tolist(), strict=True))


def clean(docs: DataFrame, host: str = "source", text: str = "text", limits: Limits = Limits()) -> DataFrame:
    """The documents that the rules keep, with all their columns, without their frequent lines."""
    names = docs.columns
    place, digest, lost = (fresh(docs, x) for x in ("_host", "_digest", "_lost"))
    profiled = materialise(profiles(docs, [], host, text), "profiled")
    found = losses(profiled, limits).select("host", "digest", "hashes", depleted(limits).alias("gone"))
    found = profiled.select("host", "digest", base_failed(limits).alias("failed")).distinct().join(found, ["host", "digest"], "left")
    verdict = found.where("failed or gone is not null").select(
        F.col("host").alias(place), F.col("digest").alias(digest), F.struct((F.col("failed") | F.coalesce("gone", F.lit(False))).alias("out"), F.col("hashes")).alias(lost)
    )
    content = F.coalesce(F.col(text), F.lit("")).cast("binary")
    marked = docs.withColumns({place: host_of(host), digest: F.unhex(F.sha2(content, 256))}).join(verdict, [place, digest], "left")
    same = marked.where(F.col(lost).isNull()).select(*[F.col(f"`{c}`") for c in names])

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        bodies = [without_lines(b, set(h)) for b, h in zip(batch.column(text).to_pylist(), batch.column(lost).to_pylist(), strict=True)]
        return pa.RecordBatch.from_arrays([pa.array(bodies, pa.binary()) if c == text else batch.column(c) for c in names], names)

    cut = marked.where(~F.col(f"{lost}.out")).select(*[F.col(text).cast("binary").alias(c) if c == text else F.col(f"`{c}`") for c in names], F.col(f"{lost}.hashes").alias(lost))
    changed = map_slices(cut, text, work, struct_of(cut, names))
    return same.unionByName(changed.withColumn(text, F.col(text).cast("string")).select(*[F.col(f"`{c}`") for c in names]))
