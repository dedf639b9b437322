"""NYSIIS codes, as expressions of the JVM, and Jaro-Winkler similarity, run on Arrow batches."""

from __future__ import annotations

import functools
import unicodedata

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import folding

VOWELS = frozenset("AEIOU")
# The substitutions of NYSIIS (Taft, Name Search Techniques, 1970).
FIRST = [("MAC", "MCC"), ("KN", "NN"), ("K", "C"), ("PH", "FF"), ("PF", "FF"), ("SCH", "SSS")]
LAST = [("EE", "Y"), ("IE", "Y"), ("DT", "D"), ("RT", "D"), ("RD", "D"), ("NT", "D"), ("ND", "D")]
INNER = [("EV", "AF"), ("KN", "N"), ("SCH", "SSS"), ("PH", "FF"), ("Q", "G"), ("Z", "S"), ("M", "N"), ("K", "C")]
# Fixed values of the similarity: weight of a common prefix, its longest part that counts, and what it must exceed.
PREFIX_WEIGHT, PREFIX_MOST, BOOST_ABOVE = 0.1, 4, 0.7


@functools.lru_cache(maxsize=100_000)
def nysiis(name: str) -> str:
    """The full NYSIIS code of a name, by the published rules. Characters but letters are dropped."""
    letters = [c for c in unicodedata.normalize("NFKD", name).upper() if "A" <= c <= "Z"]
    if not letters:
        return ""
    word = "".join(letters)
    for old, new in FIRST:
        if word.startswith(old):
            word = new + word[len(old) :]
            break
    for old, new in LAST:
        if word.endswith(old):
            word = word[: len(word) - len(old)] + new
            break
    key, place = word[0], 1
    while place < len(word):
        rest, before = word[place:], word[place - 1]
        swap = next(((old, new) for old, new in INNER if rest.startswith(old)), None)
        if swap:
            new = swap[1]
            word = word[:place] + new + word[place + len(swap[0]) :]
        elif rest[0] in VOWELS:
            new = "A"
            word = word[:place] + new + word[place + 1 :]
        elif rest[0] == "H" and (before not in VOWELS or rest[1:2] not in VOWELS):
            new = before
            word = word[:place] + new + word[place + 1 :]
        elif rest[0] == "W" and before in VOWELS:
            new = before
            word = word[:place] + new + word[place + 1 :]
        else:
            new = rest[0]
        for c in new:
            if c != key[-1]:
                key += c
        place += len(new)
    if len(key) > 1 and key.endswith("S"):
        key = key[:-1]
    if key.endswith("AY"):
        key = key[:-2] + "Y"
    if len(key) > 1 and key.endswith("A"):
        key = key[:-1]
    return key


def jaro_winkler(a: str, b: str) -> float:
    """Jaro similarity, raised for a common prefix of up to four characters where it is above BOOST_ABOVE.

    Two empty strings score 0, as does any string against an empty one.
    """
    if not a or not b:
        return 0.0
    if a == b:
        return 1.0
    reach = max(len(a), len(b)) // 2 - 1
    reach = max(reach, 0)
    taken = [False] * len(b)
    from_a = []
    for i, c in enumerate(a):
        for j in range(max(0, i - reach), min(len(b), i + reach + 1)):
            if not taken[j] and b[j] == c:
                taken[j] = True
                from_a.append(c)
                break
    if not from_a:
        return 0.0
    from_b = [c for c, t in zip(b, taken, strict=True) if t]
    swapped = sum(x != y for x, y in zip(from_a, from_b, strict=True)) // 2
    m = len(from_a)
    jaro = (m / len(a) + m / len(b) + (m - swapped) / m) / 3
    if jaro <= BOOST_ABOVE:
        return jaro
    prefix = 0
    for x, y in zip(a[:PREFIX_MOST], b[:PREFIX_MOST], strict=False):
        if x != y:
            break
        prefix += 1
    return jaro + prefix * PREFIX_WEIGHT * (1 - jaro)


def _steps() -> list[tuple[str, str]]:
    """NYSIIS as replacements by regular expressions, one after the other, in a word of letters.

    Inside a word a letter that takes the value of the one before it is as good as gone, because repeated letters are
    written once; so H and W are either kept or dropped, and only the letters that are left stand before others.
    """
    inside = lambda old: f"(?<=.){old}"
    out = [(f"^{old}", new) for old, new in FIRST]
    # endings of one value at once: an ending is replaced once only
    out += [(f"({'|'.join(old for old, x in LAST if x == new)})$", new) for new in dict.fromkeys(new for _, new in LAST)]
    out += [(inside(old), new) for old, new in INNER]
    out.append((inside("[EIOU]"), "A"))
    out += [(inside("H(?![AEIOU])"), ""), ("(?<=[AEIOU])W+", ""), ("(?<=[^AEIOU])H", "")]
    return [*out, (r"(.)\1+", "$1"), (inside("S$"), ""), ("AY$", "Y"), (inside("A$"), "")]


STEPS = _steps()


def unfolded() -> list[tuple[str, str]]:
    """Single characters that stand for several Latin letters, below U+0250 and among the ligatures, and the letters."""
    out = []
    for point in (0xDF, *range(0x100, 0x250), *range(0xFB00, 0xFB07)):
        plain = "".join(c for c in unicodedata.normalize("NFKD", chr(point)).upper() if "A" <= c <= "Z")
        if len(plain) > 1:
            out.append((chr(point), plain))
    return out


def nysiis_column(name: Column) -> Column:
    """nysiis() as an expression of the JVM, null for null. Of letters with marks and letters that stand for others it
    knows those of the Latin blocks, the ligatures and the full-width forms; others are dropped."""
    word = name.cast("string")
    for one, several in unfolded():
        word = F.replace(word, F.lit(one), F.lit(several))
    word = F.upper(F.translate(word, *folding(wide=True)))
    for pattern, new in [("[^A-Z]", ""), *STEPS]:
        word = F.regexp_replace(word, pattern, new)
    return word


def nysiis_sql(name: str) -> str:
    """nysiis_column() as SQL text over an expression."""
    for one, several in unfolded():
        name = f"replace({name}, '{one}', '{several}')"
    marked, plain = folding(wide=True)
    name = f"upper(translate({name}, '{marked}', '{plain}'))"
    for pattern, new in [("[^A-Z]", ""), *STEPS]:
        name = f"regexp_replace({name}, r'{pattern}', '{new}')"
    return name


#: Pairs whose longer text has at most so many characters are compared all at once.
SHORT = 64
#: Characters of a table that compares the pairs of a batch at once.
_CELLS = 1 << 20


def letters(text: Column) -> Column:
    """A text's characters as bits of a long, by code point modulo 64."""
    bits = F.transform(F.split(text, ""), lambda c: F.call_function("shiftleft", F.lit(1).cast("long"), F.ascii(c) % 64))
    return F.aggregate(bits, F.lit(0).cast("long"), lambda seen, bit: seen.bitwiseOR(bit))


def jaro_winkler_may_reach(left: Column, right: Column, left_letters: Column, right_letters: Column, threshold: float) -> Column:
    """Whether the similarity of two texts, neither null, may be threshold or more, told by lengths, a common prefix and
    letters(): a letter that the other text lacks is a character without a match. The slack covers rounding.
    """
    a, b = F.length(left), F.length(right)
    prefix = F.lit(PREFIX_MOST)
    for n in range(PREFIX_MOST, 0, -1):  # the first place that differs ends the test
        prefix = F.when(F.substring(left, n, 1) != F.substring(right, n, 1), n - 1).otherwise(prefix)
    lone = lambda own, other: F.bit_count(own.bitwiseAND(F.bitwise_not(other)))
    common = F.least(a - lone(left_letters, right_letters), b - lone(right_letters, left_letters))
    jaro = (common * (1 / F.greatest(a, F.lit(1)) + 1 / F.greatest(b, F.lit(1))) + 1) / 3
    # jaro * (1 - w) + w >= threshold, w the weighted prefix, written so that each part stands once
    return jaro >= F.lit(1.0) - F.lit(1.0 - (threshold - 1e-9)) / (1 - PREFIX_WEIGHT * prefix)


def _padded(texts: list[str], width: int) -> tuple[np.ndarray, np.ndarray]:
    """Code points of the texts, one a row, zeros behind them; and their lengths."""
    sizes = np.fromiter(map(len, texts), np.int64, len(texts))
    points = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32)
    rows = np.zeros((len(texts), width), np.uint32)
    rows[np.arange(width) < sizes[:, None]] = points
    return rows, sizes


def jaro_winkler_all(lefts: list[str], rights: list[str]) -> np.ndarray:
    """jaro_winkler() of each pair of non-empty texts, place by place over all pairs at once."""
    width = max(map(len, [*lefts, *rights]))
    a, n = _padded(lefts, width)
    b, m = _padded(rights, width)
    reach = np.maximum(np.maximum(n, m) // 2 - 1, 0)
    places, every = np.arange(width), np.arange(len(a))
    free, matched = places < m[:, None], np.zeros(a.shape, bool)
    for i in range(width):
        near = free & (b == a[:, i, None]) & (np.abs(places - i) <= reach[:, None])
        first = near.argmax(1)
        hit = near[every, first] & (i < n)
        matched[:, i] = hit
        free[every[hit], first[hit]] = False
    taken = (places < m[:, None]) & ~free
    count = matched.sum(1)
    # matched characters of both sides, in order, side by side
    swapped = np.zeros(len(a), np.int64)
    row = np.nonzero(matched)[0]
    np.add.at(swapped, row[a[matched] != b[taken]], 1)
    some = np.maximum(count, 1)
    jaro = np.where(count > 0, (count / n + count / m + (count - swapped // 2) / some) / 3, 0.0)
    same = np.cumprod((a == b)[:, :PREFIX_MOST] & (places[:PREFIX_MOST] < np.minimum(n, m)[:, None]), axis=1).sum(1)
    out = np.where(jaro > BOOST_ABOVE, jaro + same * PREFIX_WEIGHT * (1 - jaro), jaro)
    return np.where((n == m) & (a == b).all(1), 1.0, out)


@functools.cache
def jaro_winkler_udf():
    """Similarities of a batch: distinct pairs once, those of short texts together. Null in, null out."""

    @F.pandas_udf("double")
    def similarity(a: pd.Series, b: pd.Series) -> pd.Series:
        known: dict[tuple[str, str], float] = {}
        short = []
        for pair in set(zip(a, b, strict=True)):
            if pair[0] is None or pair[1] is None:
                known[pair] = None
            elif not pair[0] or not pair[1]:
                known[pair] = 0.0
            elif max(len(pair[0]), len(pair[1])) > SHORT:
                known[pair] = jaro_winkler(*pair)
            else:
                short.append(pair)
        short.sort(key=lambda p: max(len(p[0]), len(p[1])))
        while short:
            some = max(1, _CELLS // max(len(short[-1][0]), len(short[-1][1])))
            now, short = short[-some:], short[:-some]
            known.update(zip(now, jaro_winkler_all(*map(list, zip(*now, strict=True))).tolist(), strict=True))
        return pd.Series([known[p] for p in zip(a, b, strict=True)], dtype="float64")

    return similarity
