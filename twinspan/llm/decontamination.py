"""Benchmark decontamination: a hash set of normalised test n-grams, looked up for every token window of the training texts.

Words are runs of ASCII digits, letters (A-Z lower-cased) and all non-ASCII characters. A test item's windows are its
runs of `window` words; an item of fewer words, but not none, is one window. Windows of a training text are hashed in
bulk (a polynomial over the bytes, then over the words), looked up in the sorted hashes, and each hit is verified word by
word, so hash collisions change nothing. A word inside any verified occurrence is hit.

The hash set is broadcast only up to BLOCK_BYTES of item text; longer items are cut, each part with the words that the
next one's windows begin with. With a larger test set each block scans the texts anew, but only digests of texts with
hits, and those hits, are handed on; documents meet them in one join at the end.

Defined results: null and empty texts have no words and no hits; an empty test set hits nothing; items without words match
nothing; repeated items each count, but an id is named once; an item without an id is named by the empty text; repeated
and null ids of documents are kept row by row; texts and items of any length are handled whole, in segments; extra columns,
whatever their names, pass through where the operator returns documents.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType, StructType

from twinspan.operators.storage import materialise

from .batches import bound_batches, fresh, joined_bytes, slices

#: Item text that one broadcast hash set may hold.
BLOCK_BYTES = 8 << 20
#: Bytes hashed at once; numpy needs some 60 bytes for each. Longer texts are hashed in segments.
SLICE = 1 << 20

_BYTE_BASE, _WORD_BASE = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)


def _powers(base: np.uint64, n: int) -> np.ndarray:
    """base**0 .. base**(n-1) modulo 2**64."""
    out = np.empty(n, np.uint64)
    out[:1] = 1
    have = 1
    while have < n:
        more = min(have, n - have)
        out[have : have + more] = out[:more] * np.uint64(pow(int(base), have, 1 << 64))
        have += more
    return out


class Hasher:
    """Hashes words and windows of words by prefix sums; equal windows have equal hashes wherever they lie."""

    def __init__(self) -> None:
        self.size = 0

    def _grow(self, n: int) -> None:
        if n > self.size:
            self.size = max(n, 1 << 16)
            inverse = lambda b: np.uint64(pow(int(b), -1, 1 << 64))
            self.byte, self.byte_back = _powers(_BYTE_BASE, self.size), _powers(inverse(_BYTE_BASE), self.size)
            self.word, self.word_back = _powers(_WORD_BASE, self.size), _powers(inverse(_WORD_BASE), self.size)

    def words(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        self._grow(len(data) + 2)
        sums = np.zeros(len(data) + 1, np.uint64)
        np.cumsum((data.astype(np.uint64) + np.uint64(1)) * self.byte[: len(data)], out=sums[1:])
        h = (sums[ends] - sums[starts]) * self.byte_back[starts]
        h ^= h >> np.uint64(29)
        h *= np.uint64(0xBF58476D1CE4E5B9)
        return h ^ (h >> np.uint64(32))

    def windows(self, words: np.ndarray, width: int) -> np.ndarray:
        """Hashes of the len(words) - width + 1 windows."""
        n = len(words) - width + 1
        if n <= 0:
            return np.zeros(0, np.uint64)
        self._grow(len(words) + 2)
        sums = np.zeros(len(words) + 1, np.uint64)
        np.cumsum(words * self.word[: len(words)], out=sums[1:])
        return (sums[width:] - sums[:n]) * self.word_back[:n]


def split_words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Lower-cased bytes of all texts, starts and ends of their words, and the n + 1 word offsets of the texts."""
    low = np.where((data >= 65) & (data <= 90), data | 32, data)
    inside = (low >= 128) | ((low >= 97) & (low <= 122)) | ((low >= 48) & (low <= 57))
    fresh = inside.copy()
    fresh[1:] &= ~inside[:-1]
    last = inside.copy()
    last[:-1] &= ~inside[1:]
    edges = offsets[1:-1]
    edges = edges[(edges > 0) & (edges < len(data))]  # a word never runs from one text into the next
    fresh[edges] = inside[edges]
    last[edges - 1] = inside[edges - 1]
    starts, ends = np.flatnonzero(fresh), np.flatnonzero(last) + 1
    return low, starts, ends, np.searchsorted(starts, offsets)


class TestSet:
    """Windows of one block of test items, by width: the sorted hashes of distinct windows, their words, and the items
    that hold each. Windows of the same items share one set."""

    def __init__(self, items: list[tuple[str, bytes]], window: int) -> None:
        hasher, found, texts = Hasher(), {}, []
        for key, body in items:
            data = np.frombuffer(body, np.uint8)
            low, starts, ends, _ = split_words(data, np.array([0, len(data)]))
            width = min(window, len(starts))
            if not width:
                continue
            words = [low[s:e].tobytes() for s, e in zip(starts, ends, strict=True)]
            sizes = np.cumsum([len(w) + 1 for w in words])
            h = hasher.windows(hasher.words(low, starts, ends), width)
            found.setdefault(width, []).append((h, np.full(len(h), len(texts)), np.arange(len(h))))
            texts.append((key, b" ".join(words), np.concatenate([[0], sizes[:-1]]), sizes - 1))
        self.by_width: dict[int, tuple[np.ndarray, list[list[tuple[bytes, frozenset[str]]]]]] = {}
        shared: dict[frozenset[str], frozenset[str]] = {}
        for width, parts in found.items():
            h, item, word = (np.concatenate(c) for c in zip(*parts, strict=True))
            order = np.argsort(h, kind="stable")
            h, item, word = h[order], item[order].tolist(), word[order].tolist()
            hashes, first = np.unique(h, return_index=True)
            windows = []
            for a, b in zip(first.tolist(), [*first[1:].tolist(), len(h)], strict=True):
                keys: dict[bytes, set[str]] = {}
                for i in range(a, b):
                    key, body, starts, ends = texts[item[i]]
                    keys.setdefault(body[starts[word[i]] : ends[word[i] + width - 1]], set()).add(key)
                windows.append([(w, shared.setdefault(f := frozenset(k), f)) for w, k in keys.items()])
            self.by_width[width] = hashes, windows

    def hits(self, data: np.ndarray, offsets: np.ndarray, hasher: Hasher) -> tuple[list[int], list[list[tuple[int, int]]], list[set[str]]]:
        """For each text: its number of words, the hit word ranges (merged), and the items that occur."""
        low, starts, ends, first = split_words(data, offsets)
        n_texts = len(offsets) - 1
        ranges: list[list[tuple[int, int]]] = [[] for _ in range(n_texts)]
        items: list[set[frozenset[str]]] = [set() for _ in range(n_texts)]
        words = hasher.words(low, starts, ends)
        for width, (hashes, windows) in self.by_width.items():
            h = hasher.windows(words, width)
            if not len(h):
                continue
            at = np.minimum(np.searchsorted(hashes, h), len(hashes) - 1)
            likely = np.flatnonzero(hashes[at] == h)
            text = np.searchsorted(first, likely, side="right") - 1
            inside = likely + width <= first[text + 1]
            plain, from_word, to_word = b"", 0, 0
            for i, t, place in zip(likely[inside].tolist(), text[inside].tolist(), at[likely[inside]].tolist(), strict=True):
                if i + width > to_word:
                    # the words from here on, as the test set has them
                    from_word, to_word = i, min(i + width + 256, int(first[t + 1]))
                    own = [low[s:e].tobytes() for s, e in zip(starts[i:to_word].tolist(), ends[i:to_word].tolist(), strict=True)]
                    plain, edges = b" ".join(own), np.cumsum([0, *(len(w) + 1 for w in own)]).tolist()
                window = plain[edges[i - from_word] : edges[i - from_word + width] - 1]
                for known, keys in windows[place]:
                    if known == window:
                        a, b = i - int(first[t]), i - int(first[t]) + width
                        if ranges[t] and ranges[t][-1][0] <= a <= ranges[t][-1][1]:
                            ranges[t][-1] = (ranges[t][-1][0], max(ranges[t][-1][1], b))
                        else:
                            ranges[t].append((a, b))
                        items[t].add(keys)
        return np.diff(first).tolist(), [merged(r) for r in ranges], [set().union(*k) for k in items]

    def found(self, data: np.ndarray, offsets: np.ndarray, hasher: Hasher, limit: int = SLICE) -> tuple[list[int], list[list[tuple[int, int]]], list[set[str]]]:
        """The same as hits(), but a text that stands alone because of its length goes in segments."""
        if len(offsets) != 2 or len(data) <= 2 * limit:
            return self.hits(data, offsets, hasher)
        n_words, ranges, items = 0, [], set()
        for start, end, before in segments(data, limit, max(self.by_width, default=1) - 1):
            (n,), (own,), (keys,) = self.hits(data[start:end], np.array([0, end - start]), hasher)
            n_words = before + n
            ranges += [(a + before, b + before) for a, b in own]
            items |= keys
        return [n_words], [merged(ranges)], [items]


def segments(data: np.ndarray, limit: int, overlap: int) -> Iterator[tuple[int, int, int]]:
    """Cut one text between words: (start, end, number of words before start) of segments of some limit bytes.

    Each segment starts with the last overlap words of the one before, so every window lies in some segment.
    """
    start = before = 0
    while True:
        end, starts = start, np.zeros(0, np.int64)
        while end < len(data) and len(starts) <= overlap:  # a segment holds more words than the next one repeats
            end = _behind_word(data, min(end + limit, len(data)))
            _, starts, _, _ = split_words(data[start:end], np.array([0, end - start]))
        yield start, end, before
        if end == len(data):
            return
        before += len(starts) - overlap
        start = start + int(starts[-overlap]) if overlap else end


def _behind_word(data: np.ndarray, at: int) -> int:
    """The first place from at on whose byte is in no word, or the end."""
    while at < len(data):
        ahead = data[at : at + 4096]
        low = ahead | 32
        outside = np.flatnonzero(~((ahead >= 128) | ((low >= 97) & (low <= 122)) | ((ahead >= 48) & (ahead <= 57))))
        if len(outside):
            return at + int(outside[0])
        at += len(ahead)
    return at


def merged(ranges: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[list[int]] = []
    for a, b in sorted(ranges):
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return [(a, b) for a, b in out]


@dataclass(frozen=True)
class Names:
    """Names of the columns that contamination() adds, none of which the documents have."""

    n_words: str
    hits: str
    items: str

    def hit_words(self) -> Column:
        """The number of hit words."""
        return F.aggregate(self.hits, F.lit(0).cast("long"), lambda n, r: n + r["b"] - r["a"])

    def contaminated(self) -> Column:
        """The rule: some word is hit, and at least one in twenty is."""
        return (self.hit_words() > 0) & (self.hit_words() * 20 >= F.col(self.n_words))


_HITS = "array<struct<a:int,b:int>>"
_HIT_TYPE = pa.list_(pa.struct([("a", pa.int32()), ("b", pa.int32())]))
#: Test sets that this worker has built, by the name of their block; one block is used at a time.
_built: dict[str, TestSet] = {}


def _test_set(name: str, items: list[tuple[str, bytes]], window: int) -> TestSet:
    if name not in _built:
        _built.clear()
        _built[name] = TestSet(items, window)
    return _built[name]


def _bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    return joined_bytes(column.fill_null(b"" if pa.types.is_binary(column.type) else ""))


def _scan(df: DataFrame, test: list[tuple[str, bytes]], window: int, text: str, added: Names) -> DataFrame:
    """Add the block's hits."""
    held = df.sparkSession.sparkContext.broadcast(test)  # at most BLOCK_BYTES
    name = uuid.uuid4().hex

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tests, hasher = _test_set(name, held.value, window), Hasher()
        for batch in batches:
            for part in slices(batch, text, SLICE):
                n_words, ranges, items = tests.found(*_bytes(part.column(text)), hasher)
                hits = pa.array([[{"a": a, "b": b} for a, b in r] for r in ranges], _HIT_TYPE)
                new = [pa.array(n_words, pa.int64()), hits, pa.array([sorted(k) for k in items], pa.list_(pa.string()))]
                yield pa.RecordBatch.from_arrays([*part.columns, *new], [*part.schema.names, added.n_words, added.hits, added.items])

    hit = StructType().add("a", "integer").add("b", "integer")
    schema = StructType([*df.schema]).add(added.n_words, "long").add(added.hits, ArrayType(hit)).add(added.items, ArrayType(StringType()))
    return df.mapInArrow(run, schema)


def _digest(text: str) -> Column:
    return F.sha2(F.coalesce(F.col(f"`{text}`"), F.lit("")).cast("binary"), 256)


def _joined(scans: list[DataFrame], added: Names) -> DataFrame:
    """Hits of several blocks, as one row for each digest: ranges merged, items sorted."""
    rows = reduce(DataFrame.unionByName, scans)
    # copies of a text have the same hits in a block; then a digest has at most one row a block
    once = rows.groupBy("digest", "block").agg(F.first(added.hits).alias("hits"), F.first(added.items).alias("items"))
    grouped = once.groupBy("digest").agg(F.flatten(F.collect_list("hits")).alias("hits"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            hits = [[{"a": a, "b": b} for a, b in merged([(x["a"], x["b"]) for x in r])] for r in batch.column("hits").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("digest"), pa.array(hits, _HIT_TYPE), batch.column("items")], ["digest", "hits", "items"])

    return grouped.mapInArrow(run, f"digest string, hits {_HITS}, items array<string>")


def _parts(items: DataFrame, key: str, text: str, window: int, limit: int) -> DataFrame:
    """k (the id as text) and b (the bytes) of the items, those over limit bytes in parts that hold all their windows."""
    body = F.coalesce(F.col(text), F.lit("")).cast("binary")
    rows = items.select(F.coalesce(F.col(key).cast("string"), F.lit("")).alias("k"), body.alias("b")).where(F.octet_length("b") > 0)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k, b in zip(batch.column("k").to_pylist(), batch.column("b").to_pylist(), strict=True):
                out = [b]
                if len(b) > 2 * limit:
                    data = np.frombuffer(b, np.uint8)
                    _, starts, _, _ = split_words(data, np.array([0, len(data)]))
                    if len(starts) >= window:
                        cut = [b[s:e] for s, e, _ in segments(data, limit, window - 1)]
                        # a part of fewer words than a window holds none, and must not become a window itself
                        out = [c for c in cut if len(split_words(np.frombuffer(c, np.uint8), np.array([0, len(c)]))[1]) >= window]
                for c in out:
                    yield pa.RecordBatch.from_arrays([pa.array([k]), pa.array([c], pa.binary())], ["k", "b"])

    return rows.mapInArrow(run, "k string, b binary")


def _blocks(parts: DataFrame, limit: int) -> Iterator[list[tuple[str, bytes]]]:
    """The parts as lists of (id as text, bytes), each of bounded size."""
    block, size = [], 0
    for k, b in parts.toLocalIterator():
        if block and size + len(b) > limit:
            yield block
            block, size = [], 0
        block.append((k, bytes(b)))
        size += len(b) + 64
    yield block


def contamination(docs: DataFrame, benchmark: DataFrame, window: int = 13, text: str = "text", item_key: str = "item_id", item_text: str = "text", block_bytes: int = BLOCK_BYTES) -> tuple[DataFrame, Names]:
    """docs with three columns more: number of words, merged ranges of hit words, ids (as text) of items that occur."""
    bound_batches(docs.sparkSession)
    added = Names(*(fresh(docs, n) for n in ("_n_words", "_hits", "_items")))
    blocks = _blocks(_parts(benchmark, item_key, item_text, window, block_bytes // 4), block_bytes)
    first, second = next(blocks), next(blocks, None)
    if second is None:
        return _scan(docs, first, window, text, added), added
    digest = fresh(docs, "_digest")
    hits = []
    texts = docs.select(_digest(text).alias("digest"), F.col(f"`{text}`"))
    for i, block in enumerate(chain([first, second], blocks)):
        found = _scan(texts, block, window, text, added).where(F.size(added.items) > 0)
        hits.append(materialise(found.select("digest", F.lit(i).alias("block"), added.hits, added.items), "hits"))
    own_hits, own_items = fresh(docs, "_found_hits"), fresh(docs, "_found_items")
    joined = materialise(_joined(hits, added).toDF(digest, own_hits, own_items), "hits")
    counted = _scan(docs.withColumn(digest, _digest(text)), [], window, text, added).drop(added.hits, added.items).join(joined, digest, "left")
    none = F.array()
    return counted.select(
        *[F.col(f"`{c}`") for c in docs.columns],
        added.n_words,
        F.coalesce(own_hits, none.cast(_HITS)).alias(added.hits),
        F.coalesce(own_items, none.cast("array<string>")).alias(added.items),
    ), added


def decontaminate(docs: DataFrame, benchmark: DataFrame, window: int = 13, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """docs without the contaminated ones; the others are unchanged."""
    found, added = contamination(docs, benchmark, window, block_bytes=block_bytes)
    return found.where(~added.contaminated()).select(*[F.col(f"`{n}`") for n in docs.columns])
