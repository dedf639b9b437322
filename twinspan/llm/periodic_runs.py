"""Periodic runs of words: stretches that repeat one piece of text over and over, found by probing a harmonic grid.

A run is a stretch of consecutive words with smallest period p (words p apart are equal), at least LEAST words and
REPEATS periods long, that no neighbouring word extends keeping the period.

A run of three periods or more holds three grid points jp, (j + 1)p and (j + 2)p. So for every p the words at neighbouring
grid points are compared, about n log n comparisons for all p of a text of n words, PROBES at a time in numpy. Pairs of
equal neighbours survive. Survivors inside a run found before, whose period divides p, are skipped: that run is all they
can lead to. The others are extended to both sides, first REACH words for all at once, then, if they are still equal, by
comparing chunks of doubling length. A stretch that a smaller period gave already is not taken again.

Memory is that of one slice of texts and PROBES comparisons. Texts are independent, so Spark deals them out as it likes.

Defined results: a null text counts as empty and has no runs; null ids and repeated rows are each kept; a text of any
length is handled whole; any bytes do, since words are compared as bytes; of runs of equal exponent the first is the
strongest; an empty table gives an empty result; other columns, whatever their names, pass through.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .batches import fresh, joined_bytes, map_slices, struct_of
from .words import words_of

LEAST, REPEATS = 24, 3
#: Comparisons of grid points at once.
PROBES = 1 << 18
#: Words to either side that all survivors are extended by together.
REACH = 8
RUNS = "array<struct<start:long,length:long,period:long>>"


def grid(n: int, first: int, most: int) -> tuple[np.ndarray, np.ndarray, int]:
    """Periods and places jp of all grid points with two more behind them, for periods from first on, and the period that
    comes next: as many as most points hold, one period at least."""
    last = n // REPEATS
    stop = first
    count = 0
    while stop <= last and (count == 0 or count + (n - 1) // stop - 1 <= most):
        count += (n - 1) // stop - 1
        stop += 1
    periods = np.arange(first, stop)
    per = (n - 1) // periods - 1
    p = np.repeat(periods, per)
    j = np.arange(len(p)) - np.repeat(np.cumsum(per) - per, per)
    return p, j * p, stop


def extent(codes: np.ndarray, at: int, p: int) -> tuple[int, int]:
    """The longest stretch of period p that holds the words at and at + p, which are equal: its start and stop."""
    n, size, stop = len(codes), 64, at + 1
    while stop < n - p:
        some = min(size, n - p - stop)
        differ = codes[stop : stop + some] != codes[stop + p : stop + p + some]
        if differ.any():
            stop += int(differ.argmax())
            break
        stop, size = stop + some, size * 2
    size, start = 64, at
    while start > 0:
        some = min(size, start)
        differ = codes[start - some : start] != codes[start - some + p : start + p]
        if differ.any():
            start -= int(differ[::-1].argmax())
            break
        start, size = start - some, size * 2
    return start, stop + p


def _hopeful(codes: np.ndarray, p: np.ndarray, at: np.ndarray, least: int) -> np.ndarray:
    """Which grid points may lie in a run, told by the REACH words on both sides."""
    n = len(codes)
    reached, open_ = np.ones(len(p), np.int64), np.zeros(len(p), bool)
    for step in (1, -1):
        going = np.arange(len(p))
        for k in range(1, REACH + 1):
            i = at[going] + step * k
            inside = (i >= 0) & (i + p[going] < n)
            going, i = going[inside], i[inside]
            going = going[codes[i] == codes[i + p[going]]]
            reached[going] += 1
        open_[going] = True
    return open_ | (reached + p >= np.maximum(least, REPEATS * p))


def find_runs(codes: np.ndarray, least: int = LEAST, probes: int = PROBES) -> list[tuple[int, int, int]]:
    """All runs of a text, its words as numbers: (start, length, period), by start, then period."""
    n = len(codes)
    found: dict[tuple[int, int], int] = {}
    period = 1
    while n >= least and REPEATS * period <= n:
        p, at, period = grid(n, period, probes)
        same = codes[at] == codes[at + p]
        # the neighbour behind has to be equal too
        same &= codes[at + p] == codes[at + 2 * p]
        p, at = p[same], at[same]
        alive = _hopeful(codes, p, at, least)
        p, at = p[alive], at[alive]
        alive = np.ones(len(p), bool)

        def skip(start: int, stop: int, q: int) -> None:
            alive[(p % q == 0) & (at >= start) & (at + p < stop)] = False

        if len(p):
            for (start, stop), q in found.items():
                if stop - start > p[0]:
                    skip(start, stop, q)
        for i in range(len(p)):
            if not alive[i]:
                continue
            q = int(p[i])
            start, stop = extent(codes, int(at[i]), q)
            if stop - start >= max(least, REPEATS * q):
                if (start, stop) not in found:
                    found[start, stop] = q
            skip(start, stop, q)
    return sorted((start, stop - start, q) for (start, stop), q in found.items())


def dropped(runs: list[tuple[int, int, int]], n: int) -> np.ndarray:
    """Whether each of n words lies in a run behind the run's first period."""
    edges = np.zeros(n + 1, np.int64)
    for start, length, period in runs:
        edges[start + period] += 1
        edges[start + length] -= 1
    return np.cumsum(edges[:-1]) > 0


def with_runs(docs: DataFrame, text: str = "text", runs: str = "runs", collapsed: str = "collapsed", n_words: str = "n_words") -> DataFrame:
    """Add to each row the number of its words, its runs (places in words from 0), and its text without the repeats: all
    words but those in a run behind its first period, joined by one space (binary). The new names must be free."""
    body = fresh(docs, "_body")
    names = docs.columns

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        data, offsets = joined_bytes(batch.column(body))
        words = words_of(data, offsets)
        counts = np.diff(words.first)
        all_runs, texts = [], []
        for i, (a, b) in enumerate(zip(words.first[:-1].tolist(), words.first[1:].tolist(), strict=True)):
            own = find_runs(words.codes[a:b])
            all_runs.append(own)
            parts = data[offsets[i] : offsets[i + 1]].tobytes().split()
            if own:
                parts = [parts[k] for k in np.flatnonzero(~dropped(own, b - a)).tolist()]
            texts.append(b" ".join(parts))
        ends = np.cumsum([0, *map(len, all_runs)]).astype(np.int32)
        flat = np.array([r for own in all_runs for r in own], np.int64).reshape(-1, 3)
        items = pa.StructArray.from_arrays([pa.array(flat[:, k]) for k in range(3)], ["start", "length", "period"])
        return pa.RecordBatch.from_arrays(
            [*(batch.column(c) for c in names), pa.array(counts), pa.ListArray.from_arrays(pa.array(ends), items), pa.array(texts, pa.binary())],
            [*names, n_words, runs, collapsed],
        )

    rows = docs.withColumn(body, F.coalesce(F.col(text), F.lit("")).cast("binary"))
    return map_slices(rows, body, work, struct_of(docs, names, (n_words, "long"), (runs, RUNS), (collapsed, "binary")))


def strongest(runs: str = "runs") -> Column:
    """The run of the greatest length for its period, compared exactly; of equal ones the first. Null without runs."""
    more = lambda best, r: F.when(r["length"] * best["period"] > best["length"] * r["period"], r).otherwise(best)
    first = F.try_element_at(F.col(runs), F.lit(1))
    return F.aggregate(F.col(runs), first, more)


def collapse(docs: DataFrame, text: str = "text") -> DataFrame:
    """The documents, repeats of runs taken out of their texts. Texts without runs stay as they are."""
    n, runs, out = (fresh(docs, x) for x in ("_n", "_runs", "_collapsed"))
    found = with_runs(docs, text, runs, out, n)
    kept = F.when(F.size(runs) > 0, F.col(out).cast("string")).otherwise(F.col(text))
    return found.withColumn(text, kept).select(*[F.col(f"`{c}`") for c in docs.columns])
