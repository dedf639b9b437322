import hashlib
import random
import re

import pytest

from tests.llm.cases import ROWS, no_docs, odd_docs, rows
from twinspan.llm import decontamination, queries

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words(text):
    return WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def by_hand(text, items, window=13):
    w, hit, found = words(text), set(), set()
    for key, body in items:
        v = words(body)
        width = min(window, len(v))
        windows = {tuple(v[i : i + width]) for i in range(len(v) - width + 1)} if v else set()
        for i in range(len(w) - width + 1):
            if windows and tuple(w[i : i + width]) in windows:
                hit |= set(range(i, i + width))
                found.add(str(key))
    return len(w), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), bool(hit) and 20 * len(hit) >= len(w)


def random_case(seed):
    rng = random.Random(seed)
    vocabulary = ["a", "b", "É", "é", "x9", "数", "Aa", "ß", "0"]
    glue = [" ", ", ", "\n", "--", "_", "\x00"]

    def text(n):
        return "".join(rng.choice(vocabulary) + rng.choice(glue) for _ in range(n))

    items = [(i, text(rng.choice([0, 1, 2, 5, 12, 13, 14, 30]))) for i in range(20)] + [(3, "repeat a b"), (None, "no id here"), (77, None), (78, "... ,")]
    docs = []
    for _ in range(60):
        body = text(rng.randint(0, 40))
        if rng.random() < 0.5:
            body += " " + (rng.choice(items)[1] or "") + " " + text(rng.randint(0, 20))
        docs.append(body)
    return docs, items


@pytest.mark.parametrize("seed", [1, 2])
def test_against_brute_force(spark, tmp_path, seed):
    docs, items = random_case(seed)
    spark.createDataFrame([(i, t) for i, t in enumerate(docs)], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    got = {r.doc_id: tuple(r)[1:] for r in queries.op4_decontamination(spark, str(tmp_path)).collect()}
    assert got == {i: by_hand(t, [("" if k is None else k, b) for k, b in items]) for i, t in enumerate(docs)}


def test_blocks_of_the_test_set_change_nothing(spark):
    docs, items = random_case(5)
    items.append((500, " ".join(f"w{i % 40} v{i}" for i in range(400))))  # goes in parts
    docs += [items[-1][1], items[-1][1][300:900], docs[0], docs[0], None]
    d = spark.createDataFrame([(i, t, 1, 2) for i, t in enumerate(docs)], "doc_id long, text string, hits int, digest int")
    b = spark.createDataFrame(items, "item_id long, text string")
    shape = lambda found, names: {r.doc_id: (r[names.n_words], [tuple(x) for x in r[names.hits]], r[names.items]) for r in found.collect()}
    whole = shape(*decontamination.contamination(d, b))
    assert {i: (n, sum(b - a for a, b in h), len(k)) for i, (n, h, k) in whole.items()} == {i: by_hand(t, [("" if k is None else k, b) for k, b in items])[:3] for i, t in enumerate(docs)}
    assert shape(*decontamination.contamination(d, b, block_bytes=200)) == whole
    kept = decontamination.decontaminate(d, b, block_bytes=2000)
    assert kept.columns == d.columns and rows(kept) == rows(decontamination.decontaminate(d, b))


def test_one_word_over_and_over_takes_linear_time():
    """A megabyte of one word against an item of the same, and ten thousand items that share their windows."""
    import time

    import numpy as np

    begun = time.perf_counter()
    body = np.frombuffer(b"a " * 500_000, np.uint8)
    tests = decontamination.TestSet([("x", b"a " * 500_000)], 13)
    n, hits, found = tests.found(body, np.array([0, len(body)]), decontamination.Hasher())
    assert (n, hits, found) == ([500_000], [[(0, 500_000)]], [{"x"}])
    passage = " ".join(f"w{i}" for i in range(30)).encode()
    tests = decontamination.TestSet([(str(i), passage) for i in range(10_000)], 13)
    text = np.frombuffer(passage * 20 + b" " + passage, np.uint8)
    n, hits, found = tests.hits(text, np.array([0, len(text)]), decontamination.Hasher())
    assert len(found[0]) == 10_000
    assert time.perf_counter() - begun < 30


def test_equal_hashes_of_different_windows(monkeypatch):
    """With all hashes equal, words alone decide."""
    import numpy as np

    docs, items = random_case(9)
    monkeypatch.setattr(decontamination.Hasher, "windows", lambda self, words, width: np.zeros(max(len(words) - width + 1, 0), np.uint64))
    tests = decontamination.TestSet([("" if k is None else str(k), (b or "").encode()) for k, b in items], 13)
    for text in docs[:20]:
        data = np.frombuffer(text.encode(), np.uint8)
        n, hits, found = tests.hits(data, np.array([0, len(data)]), decontamination.Hasher())
        want = by_hand(text, [("" if k is None else k, b) for k, b in items])
        assert (n[0], sum(b - a for a, b in hits[0]), len(found[0])) == want[:3]


def test_long_texts_go_in_segments():
    import numpy as np

    docs, items = random_case(8)
    known = [(str(k), (b or "").encode()) for k, b in items]
    tests, hasher = decontamination.TestSet(known, 13), decontamination.Hasher()
    long = [" ".join(docs), " ".join(docs[:20]) + "x" * 500 + " ".join(b or "" for _, b in items), "word" * 300, " ,. " * 200, "a " * 400]
    for text in long:
        data = np.frombuffer(text.encode(), np.uint8)
        n, hits, found = decontamination.TestSet.hits(tests, data, np.array([0, len(data)]), hasher)
        for limit in (10, 37, 64, 200):
            m, cut, keys = tests.found(data, np.array([0, len(data)]), hasher, limit)
            assert (m, cut, keys) == (n, [decontamination.merged(hits[0])], found), limit


def test_odd_rows(spark):
    items = spark.createDataFrame([(1, "quick brown fox jumps over the lazy dog and runs away from the old"), (2, "one two")], "item_id long, text string")
    docs = odd_docs(spark, clashing=True)
    kept = decontamination.decontaminate(docs, items)
    assert kept.columns == docs.columns
    gone = sorted(str(i) for i, t, *_ in ROWS if by_hand(t, [(1, "quick brown fox jumps over the lazy dog and runs away from the old"), (2, "one two")])[-1])
    assert gone == ["1", "2", "8"]
    assert kept.count() == len(ROWS) - 3
    assert decontamination.decontaminate(no_docs(spark), items).count() == 0
    assert decontamination.decontaminate(docs, items.limit(0)).count() == len(ROWS)
