"""Words of a batch of texts as numbers: runs of bytes other than ASCII white space; equal words have equal numbers."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa

#: ASCII white space, by byte.
WHITE = np.zeros(256, bool)
WHITE[[0x20, *range(0x09, 0x0E)]] = True


@dataclass(frozen=True)
class Words:
    """The words of all texts, one after the other: starts and stops are places in the bytes, codes numbers below size;
    text i has the words first[i] to first[i + 1]."""

    starts: np.ndarray
    stops: np.ndarray
    codes: np.ndarray
    first: np.ndarray

    @property
    def size(self) -> int:
        return len(self.codes) + 1

    def text_of_each(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.first) - 1), np.diff(self.first))


def numbers(values: pa.Array) -> np.ndarray:
    """A number for each value, below the number of values: equal ones have equal numbers."""
    return values.dictionary_encode().indices.to_numpy(zero_copy_only=False).astype(np.int64)


def pieces(data: np.ndarray, lengths: np.ndarray) -> pa.Array:
    """data cut into pieces of the given lengths."""
    ends = np.zeros(len(lengths) + 1, np.int64)
    np.cumsum(lengths, out=ends[1:])
    return pa.Array.from_buffers(pa.large_binary(), len(lengths), [None, pa.py_buffer(ends), pa.py_buffer(np.ascontiguousarray(data))])


def words_of(data: np.ndarray, offsets: np.ndarray) -> Words:
    """The words of texts whose bytes stand one after the other in data; text i is data[offsets[i]:offsets[i + 1]]."""
    ink = ~WHITE[data]
    first, last = ink.copy(), ink.copy()
    first[1:] &= ~ink[:-1]
    last[:-1] &= ~ink[1:]
    # a word ends where its text does
    begin, end = offsets[:-1][offsets[:-1] < len(data)], offsets[1:][offsets[1:] > 0] - 1
    first[begin], last[end] = ink[begin], ink[end]
    starts, stops = np.flatnonzero(first), np.flatnonzero(last) + 1
    codes = numbers(pieces(data[ink], stops - starts)) if len(starts) else np.zeros(0, np.int64)
    return Words(starts, stops, codes, np.searchsorted(starts, offsets))


def counted(flags: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """The number of set flags between each two bounds."""
    return np.array([np.count_nonzero(flags[a:b]) for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True)], np.int64)
