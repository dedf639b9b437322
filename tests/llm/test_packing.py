import random
import zlib

import numpy as np
import public_tokenizers
from tokenizers import Tokenizer

from tests.llm.cases import ROWS, no_docs, odd_docs
from twinspan.llm import packing

PATH = public_tokenizers.path("word_bpe_49k.json")
LIBRARY = Tokenizer.from_file(PATH)


def ids(text):
    return LIBRARY.encode(text or "", add_special_tokens=False).ids


def encoded(encoder, text):
    return np.frombuffer(encoder.encode([text.encode()])[0], "<u4").tolist()


def test_encoder_is_the_library():
    encoder, rng = packing.WordEncoder(PATH), random.Random(1)
    parts = ["a", "Be", "é", "É", "J̌", "ẗ", "ﬁ", " ", "  ", "\n", " ", "\x1c", "\xa0", "'s", "'S", "12", "Σ", "ΑΣ", "İ", "ı", "ß", "ẞ", "<|endoftext|>", "<|ENDOFTEXT|>", "<|", "|>", "̀", "ſ", "한", "!", "?!", "~", "`", "`", "\x85", "​", "🙂", "K", "ǆ", ".", ",", "'", "don't", "x" * 70]
    for _ in range(4000):
        text = "".join(rng.choice(parts) for _ in range(rng.randint(0, 25)))
        assert encoded(encoder, text) == ids(text), text
    for point in range(0x20, 0x530):
        for text in (chr(point), f"a{chr(point)}", f"{chr(point)}b", f"A{chr(point)}."):
            assert encoded(encoder, text) == ids(text), text


def test_encoder_forgets_and_stays_right(monkeypatch):
    monkeypatch.setattr(packing, "WORDS", 20)
    encoder, rng = packing.WordEncoder(PATH), random.Random(2)
    for _ in range(200):
        text = " ".join("".join(rng.choice("abcdé") for _ in range(3)) + rng.choice(["", ".", "!!"]) for _ in range(rng.randint(0, 12)))
        assert encoded(encoder, text) == ids(text)
        assert len(encoder) <= 40


def check(rows, source, length):
    want = {}
    for i, t, *_ in source:
        x = np.array([*ids(t), 1], "<u4")
        want.setdefault((i, len(x), zlib.crc32(x.tobytes())), []).append(x)
    sequences, tokens = {}, 0
    for r in rows:
        sequences.setdefault(r.sequence_id, []).append((r.offset, r.length))
        tokens += r.length
    for parts in sequences.values():
        at = 0
        for offset, n in sorted(parts):
            assert offset == at and n > 0
            at += n
        assert at <= length
    assert tokens == sum(len(x) for v in want.values() for x in v)
    return sequences, tokens


def test_odd_rows(spark):
    for length in (2048, 16):
        rows = packing.pack(odd_docs(spark, clashing=True).coalesce(1), PATH, length=length, with_ids=True).collect()
        sequences, tokens = check(rows, ROWS, length)
        assert len(sequences) == -(-tokens // length)  # one group: no more sequences than the tokens need
        for r in rows:
            assert zlib.crc32(np.array(r.ids, "<u4").tobytes()) == r.ids_crc32 and len(r.ids) == r.length
        got, at = {}, {}
        for r in sorted(rows, key=lambda r: r.start):
            if r.doc_id not in (7, 10, None):  # ids that repeat
                assert at.get(r.doc_id, 0) == r.start
                at[r.doc_id] = r.start + r.length
                got.setdefault(r.doc_id, []).extend(r.ids)
        for i, t, *_ in ROWS:
            if i in got:
                assert got[i] == [*ids(t), 1]
    assert packing.pack(no_docs(spark), PATH).count() == 0


def test_assignment_is_whole_and_tight():
    rng = np.random.default_rng(3)
    for n in (1, 2, 5, 300, 3000):
        lengths = rng.integers(1, 2049, n)
        placed = packing.assign(lengths)
        per_piece, used = {}, {}
        for i, start, size, s, offset in placed:
            per_piece.setdefault(i, []).append((start, size))
            used.setdefault(s, []).append((offset, size))
        for i, parts in per_piece.items():
            at = 0
            for start, size in sorted(parts):
                assert start == at
                at += size
            assert at == lengths[i]
        assert len(per_piece) == n and len(used) == -(-int(lengths.sum()) // 2048)
        for parts in used.values():
            assert sum(size for _, size in parts) <= 2048
            assert sorted(o for o, _ in parts) == np.cumsum([0, *[size for _, size in sorted(parts)][:-1]]).tolist()


def test_costs_are_balanced():
    lengths = np.array([1024] * 50 + [256] * 200 + [64] * 400)
    cost = {}
    for _, _, size, s, _ in packing.assign(lengths):
        cost[s] = cost.get(s, 0) + size + size * size / packing.LINEAR
    values = sorted(cost.values())[1:]
    assert values[-1] <= 1.5 * values[0]


def test_groups_close_and_padding_stays_small(spark, monkeypatch):
    monkeypatch.setattr(packing, "GROUP_TOKENS", 20_000)
    rng = random.Random(7)
    source = [(i, " ".join(rng.choice(["the", "cat", "sat"]) for _ in range(rng.randint(0, 900)))) for i in range(300)]
    rows = packing.pack(spark.createDataFrame(source, "doc_id long, text string").repartition(2), PATH).collect()
    sequences, tokens = check(rows, source, 2048)
    assert tokens >= 0.85 * 2048 * len(sequences)
