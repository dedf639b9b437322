"""Sequence packing balanced by attention cost.

Documents become token ids (and one id that ends them), cut at multiples of the sequence length. A full piece is a
sequence of its own. A task gathers the remaining pieces in groups of some GROUP_TOKENS tokens; for each group it opens
as many sequences as its tokens need, and pieces, by descending estimated cost, each go to the lowest-cost sequence with
room. The cost of a piece of n tokens is n + n * n / LINEAR; a sequence's is the sum over its pieces. What fits nowhere
whole is cut over the lowest-cost sequences with room. So only the last sequence of a group can be short, by less than a
sequence, and nothing is shuffled. Sequence ids hold the task's partition and a counter; for one partitioning of the
input they are reproducible, so a task that is run again gives the same rows.

Defined results: null and empty texts are the end id alone; repeated rows are packed each; null ids are kept; of pieces of
one cost the earlier in the task goes first, of sequences of one cost the lower; a very long text is encoded whole, by
itself, and its full pieces are handed on at once; an empty table gives an empty result; other columns, whatever their
names, are ignored.
"""

from __future__ import annotations

import functools
import os
import sys
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from .batches import bound_batches, slices

LENGTH, END_ID = 2048, 1
#: Tokens at which a piece's quadratic attention cost equals its linear cost.
LINEAR = 1024
#: A group is packed when it holds so many tokens or pieces.
GROUP_TOKENS, GROUP_PIECES = 1 << 20, 1 << 14
BEYOND_LATIN = "\u0250"
#: Distinct words whose ids a worker remembers.
WORDS = 400_000
#: Longer parts are encoded each time they come.
LONGEST = 64
PUNCTUATION = b".,;:!?*#$%&|)\"'"


if sys.byteorder != "little" or array("I").itemsize != 4:
    raise ImportError("packed ids need little-endian 32-bit integers")


class WordEncoder(dict):
    """Encodes UTF-8 texts to packed little-endian unsigned 32-bit ids, without special tokens being added.

    White space ends every token of these tokenizers and leaves none itself, so a text's ids are those of its parts
    between ASCII white space, one after the other. The mapping holds the ids of parts met lately; the library encodes
    the others. Of two generations of WORDS / 2 parts, the elder is let go when the younger is full.
    """

    def __init__(self, path: str) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        self.library, self.elder = Tokenizer.from_file(path), {}
        self.tokenize = self.library.model.tokenize
        # The characters by which byte-level models show bytes: printable Latin-1 itself, the rest from U+0100 on.
        plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
        rest = [b for b in range(256) if b not in plain]
        self.shown = {b: b for b in plain} | {b: 256 + i for i, b in enumerate(rest)}

    def _ids(self, word: bytes) -> bytes:
        text = word.decode(errors="replace")
        if text.isalpha() and text.islower() and max(text) < BEYOND_LATIN:
            # The normaliser and the pre-tokenizer leave lower-case Latin letters whole and unchanged.
            return array("I", [t.id for t in self.tokenize(text if text.isascii() else word.decode("latin-1").translate(self.shown))]).tobytes()
        return array("I", self.library.encode_batch_fast([text], add_special_tokens=False)[0].ids).tobytes()

    def __missing__(self, word: bytes) -> bytes:
        ids = self.elder.get(word)
        if ids is None:
            stem = word.rstrip(PUNCTUATION)
            # The pre-tokenizer parts a letter from punctuation behind it.
            ids = self[stem] + self[word[len(stem) :]] if len(stem) < len(word) and stem[-1:].isalpha() else self._ids(word)
        if len(word) <= LONGEST:
            self[word] = ids
        return ids

    def encode(self, bodies: list[bytes]) -> list[bytes]:
        out = []
        for body in bodies:
            # Lower case is what the tokenizer's normaliser makes, unless a combining mark (UTF-8 CC or CD) may join a
            # letter first, or the text may spell a special token.
            plain = b"\xcc" not in body and b"\xcd" not in body and b"<|" not in body
            out.append(b"".join(map(self.__getitem__, (body.lower() if plain else body).split())))
            if len(self) > WORDS // 2:
                self.elder = dict(self)
                self.clear()
        return out


@functools.lru_cache(maxsize=2)
def _encoder(path: str) -> WordEncoder:
    return WordEncoder(path)


def assign(lengths: np.ndarray, capacity: int = LENGTH) -> list[tuple[int, int, int, int, int]]:
    """Pack pieces of 1 to capacity tokens into the fewest sequences: (piece, start in it, length, sequence, offset)."""
    estimate = lambda n: n + n * n / LINEAR
    n_sequences = -(-int(lengths.sum()) // capacity)
    used, cost = np.zeros(n_sequences, np.int64), np.zeros(n_sequences)
    out, left = [], []
    for i in np.lexsort((np.arange(len(lengths)), -lengths)).tolist():
        size = int(lengths[i])
        s = int(np.argmin(np.where(used + size <= capacity, cost, np.inf)))
        if used[s] + size > capacity:
            left.append(i)
            continue
        out.append((i, 0, size, s, int(used[s])))
        used[s] += size
        cost[s] += estimate(size)
    for i in left:
        start, size = 0, int(lengths[i])
        while start < size:
            s = int(np.argmin(np.where(used < capacity, cost, np.inf)))
            here = min(size - start, capacity - int(used[s]))
            out.append((i, start, here, s, int(used[s])))
            used[s] += here
            cost[s] += estimate(here)
            start += here
    return out


PIECE = ["start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]


def pack(docs: DataFrame, tokenizer_path: str, key: str = "doc_id", text: str = "text", length: int = LENGTH, end_id: int = END_ID, with_ids: bool = False) -> DataFrame:
    """One row per piece: key, start, length, ids_crc32, doc_tokens, sequence_id, offset and, if asked for, its ids."""
    bound_batches(docs.sparkSession)
    end, kind = np.array([end_id], "<u4").tobytes(), docs.select(key).schema[0].dataType.simpleString()
    names = [key, *PIECE, *["ids"] * with_ids]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _encoder(tokenizer_path)
        first = TaskContext.get().partitionId() << 40
        made, held, tokens = 0, [], 0
        key_type = None

        def rows(out: list[tuple]) -> pa.RecordBatch:
            types = [key_type, *[pa.int64()] * 6, *[pa.list_(pa.int32())] * with_ids]
            return pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], t) for i, t in enumerate(types)], names)

        def piece(doc, part: bytes, start: int, total: int, sequence: int, offset: int) -> tuple:
            extra = (np.frombuffer(part, "<i4"),) if with_ids else ()
            return (doc, start, len(part) // 4, zlib.crc32(part), total, first + sequence, offset, *extra)

        def packed() -> pa.RecordBatch:
            nonlocal made
            sizes = np.array([len(tail) // 4 for _, tail, *_ in held])
            out = []
            for i, s, n, sequence, offset in assign(sizes, length):
                doc, tail, start, total = held[i]
                out.append(piece(doc, tail[4 * s : 4 * (s + n)], start + s, total, made + sequence, offset))
            made += -(-int(sizes.sum()) // length)
            return rows(out)

        for batch in batches:
            for part in slices(batch, "_body", 1 << 20):
                key_type, out = part.schema.field(key).type, []
                for doc, ids in zip(part.column(key).to_pylist(), encoder.encode(part.column("_body").to_pylist()), strict=True):
                    ids += end
                    n = len(ids) // 4
                    for start in range(0, n - length + 1, length):
                        out.append(piece(doc, ids[4 * start : 4 * (start + length)], start, n, made, 0))
                        made += 1
                    if rest := n % length:
                        held.append((doc, ids[4 * (n - rest) :], n - rest, n))
                        tokens += rest
                    if tokens >= GROUP_TOKENS or len(held) >= GROUP_PIECES:
                        yield packed()
                        held, tokens = [], 0
                if out:
                    yield rows(out)
        if held:
            yield packed()

    rows_in = docs.select(key, F.coalesce(F.col(text), F.lit("")).cast("binary").alias("_body"))
    return rows_in.mapInArrow(run, ", ".join([f"`{key}` {kind}", *(f"{c} long" for c in PIECE), *["ids array<int>"] * with_ids]))
