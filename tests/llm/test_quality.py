import random
import zlib

import numpy as np

from tests.llm.cases import ROWS, no_docs, odd_docs
from twinspan.llm import quality


def texts(n, seed):
    rng = random.Random(seed)
    words = "the of and to in is that for it as was with be by on".split()
    good = [" ".join(rng.choice(words) for _ in range(rng.randint(20, 200))) + "." for _ in range(n)]
    bad = [" ".join(rng.choice(words) + rng.choice(["###", "$$$", "!!"]) for _ in range(rng.randint(20, 200))) for _ in range(n // 4)]
    both = [(t, 1) for t in good] + [(t, 0) for t in bad]
    rng.shuffle(both)
    return both


def test_chunks_cover_the_whole_text():
    for n in [0, 1, 15, 16, 17, 32, 33, 100]:
        data = np.arange(n, dtype=np.uint8)
        codes, first = quality.cut(data, np.array([0, n]))
        assert codes.ravel()[:n].tolist() == [i + 1 for i in range(n)]
        assert not codes.ravel()[n:].any() and len(codes) == max(-(-n // 16), 1) + 1 == first[-1]


def test_repetition_inputs():
    body = b"ab ab ab ab ab ab ab" + b"xyz"
    data = np.frombuffer(body + b"b ab", np.uint8)
    codes, first = quality.cut(data, np.array([0, len(body), len(data)]))
    got = quality.repeated(codes)
    flat, text = codes.ravel(), np.repeat(np.arange(2), np.diff(first) * 16)
    for row in range(len(codes)):
        for i, lag in enumerate(quality.LAGS):
            places = [p for p in range(16 * row, 16 * row + 16) if flat[p] and p >= lag and flat[p] == flat[p - lag] and text[p] == text[p - lag]]
            assert got[row, i] == len(places)


def test_long_texts_are_pooled_part_by_part(monkeypatch):
    model = quality.train([t.encode() for t, _ in texts(40, 1)], [y for _, y in texts(40, 1)], steps=50)
    rng = random.Random(5)
    body = bytes(rng.randrange(32, 127) for _ in range(5000)) + b"ab ab ab " * 30
    whole = quality.probabilities(model, np.frombuffer(body, np.uint8), np.array([0, len(body)]))[0]
    for size in (8, 16, 40, 100, 1000):
        monkeypatch.setattr(quality, "SLICE", size)
        assert abs(quality.probabilities(model, np.frombuffer(body, np.uint8), np.array([0, len(body)]))[0] - whole) < 1e-5


def test_score_is_the_same_alone_and_in_a_batch_and_sees_the_end():
    model = quality.train([t.encode() for t, _ in texts(200, 1)], [y for _, y in texts(200, 1)], steps=300)
    bodies = [t.encode() for t, _ in texts(20, 2)] + [b"", b"x"]
    offsets = np.concatenate([[0], np.cumsum([len(b) for b in bodies])])
    together = quality.probabilities(model, np.frombuffer(b"".join(bodies), np.uint8), offsets)
    alone = [quality.probabilities(model, np.frombuffer(b, np.uint8), np.array([0, len(b)]))[0] for b in bodies]
    assert np.allclose(together, alone, atol=1e-5)
    clean = b"the of and to in is that " * 4000
    score = lambda b: quality.probabilities(model, np.frombuffer(b, np.uint8), np.array([0, len(b)]))[0]
    assert score(clean + b"of### and$$$ to!! the### of$$$ in!! " * 20) < score(clean)


def naive(model, body):
    """The score by loops over chunks, filters, bytes and lags."""
    n, half = quality.CHUNK, quality.CHUNK // 2
    padded = [b + 1 for b in body] + [0] * (half * (max(-(-len(body) // half), 1) + 1) - len(body))
    best = np.full(quality.FILTERS, -np.inf)
    for at in range(0, len(padded) - half, half):
        chunk = padded[at : at + n]
        for f in range(quality.FILTERS):
            z = sum(float(model["embed"][c, w]) * float(model["filter"][i * quality.WIDTH + w, f]) for i, c in enumerate(chunk) for w in range(quality.WIDTH))
            for i, lag in enumerate(quality.LAGS):
                same = sum(c > 0 and at + k >= lag and padded[at + k - lag] == c for k, c in enumerate(chunk))
                z += same / half * float(model["lag"][i, f])
            best[f] = max(best[f], z)
    top = np.maximum(best + model["bias"], 0)
    return 1 / (1 + np.exp(-(float(top @ model["out"]) + float(model["out_bias"][0]))))


def some_model(seed):
    rng = np.random.default_rng(seed)
    model = {k: (v + rng.normal(0, 0.2, v.shape)).astype(np.float32) for k, v in quality.start(seed).items()}
    model["embed"][0] = 0
    return model


def test_scores_against_a_naive_convolution():
    model = some_model(3)
    for body in (b"", b"x", b"abababababababab", b"the quick brown fox jumps over the lazy dog " * 3, "é数🙂".encode() * 9, bytes(range(256))):
        got = quality.probabilities(model, np.frombuffer(body, np.uint8), np.array([0, len(body)]))[0]
        assert abs(got - naive(model, body)) < 1e-4, body


def test_gradients_against_differences():
    """Each kind of weight, nudged: the loss changes as the gradient says."""
    model, bodies = some_model(4), [t.encode() for t, _ in texts(6, 8)][:6]
    exact = {k: v.astype(np.float64) for k, v in model.items()}
    y, weight = np.array([1, 0, 1, 1, 0, 1.0]), np.array([0.1, 0.3, 0.2, 0.1, 0.2, 0.1])
    parts = [quality.cut(np.frombuffer(b, np.uint8), np.array([0, len(b)]))[0] for b in bodies]
    repeats = [quality.repeated(p) for p in parts]

    def loss(m):
        p = np.concatenate([quality.probabilities(m, np.frombuffer(b, np.uint8), np.array([0, len(b)])) for b in bodies])
        return -(np.where(y > 0, np.log(p), np.log(1 - p)) * weight).sum()

    grads = quality.gradients(exact, parts, repeats, y, weight)
    rng, step = np.random.default_rng(1), 1e-6
    for name, g in grads.items():
        assert g.shape == exact[name].shape
        places = [tuple(p) for p in np.argwhere(np.abs(g) > 1e-4)]
        assert places
        for place in [places[i] for i in rng.permutation(len(places))[:12]]:
            up, down = ({**exact, name: exact[name].copy()} for _ in range(2))
            up[name][place] += step
            down[name][place] -= step
            assert abs((loss(up) - loss(down)) / (2 * step) - g[place]) < 1e-3 * max(1, abs(g[place])), (name, place)


def test_training_is_done_once_for_a_sample(spark, monkeypatch):
    data = texts(40, 6)
    docs = spark.createDataFrame([(i, t) for i, (t, _) in enumerate(data)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, y) for i, (_, y) in enumerate(data)], "doc_id long, quality int")
    first = quality.fit(docs, labels)
    monkeypatch.setattr(quality, "train", lambda *a, **k: {"other": None})
    assert quality.fit(docs.repartition(3), labels) is first
    assert quality.fit(docs, labels, sample=7) == {"other": None}
    seen = []
    monkeypatch.setattr(quality, "train", lambda bodies, marks: seen.append(bodies) or {})
    quality.fit(docs, labels, sample=5, sample_bytes=300)
    assert len(seen[0]) == 5 and max(map(len, seen[0])) <= 300  # long texts are left out before the sample is cut


def test_held_out_accuracy_on_a_table(spark):
    data = texts(300, 3)
    docs = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, (t, _) in enumerate(data)], "doc_id long, text string, lang string, source string, n_chars long")
    labels = spark.createDataFrame([(i, y, None) for i, (_, y) in enumerate(data)], "doc_id long, quality int, toxic int")
    rows = quality.predictions(docs, labels).collect()
    held = [r for r in rows if r.held_out]
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in rows)
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) for r in rows)
    assert sum(r.predicted == data[r.doc_id][1] for r in held) >= 0.95 * len(held)
    kept = {r.doc_id for r in quality.keep_good(docs, labels).collect()}
    assert kept == {r.doc_id for r in rows if r.predicted}


def test_held_out_labels_train_nothing(spark):
    data = texts(60, 4)
    docs = spark.createDataFrame([(i, t) for i, (t, _) in enumerate(data)], "doc_id long, text string")
    label = lambda flip: spark.createDataFrame([(i, 1 - y if flip and zlib.crc32(str(i).encode()) % 5 == 0 else y, 0) for i, (_, y) in enumerate(data)], "doc_id long, quality int, toxic int")
    a, b = quality.fit(docs, label(False)), quality.fit(docs, label(True))
    assert all((a[k] == b[k]).all() for k in a)


def test_odd_rows(spark):
    labels = spark.createDataFrame([(1, 1, 0), (2, 1, 0), (4, 0, 0), (7, None, None), (None, 1, 1), (8, 0, None), (8, 0, None)], "doc_id long, quality int, toxic int")
    docs = odd_docs(spark, clashing=True)
    assert len(quality.predictions(docs, labels).collect()) == len(ROWS)
    assert quality.keep_good(docs, labels).columns == docs.columns
    none = labels.limit(0)
    assert {r.score for r in quality.predictions(docs, none).collect()} == {0.5}
    assert quality.keep_good(docs, none).count() == len(ROWS)
    assert quality.predictions(no_docs(spark), labels).count() == 0
