"""Quality classifier: a byte-level convolutional network in numpy.

A text's bytes are embedded and cut into chunks of CHUNK bytes, each overlapping the next by half, to the very end of
the text (zero-padded). FILTERS learned filters see each chunk: its embedded bytes, and for each of LAGS the share of its
bytes that equal the byte so far before them, which is how a linear filter can see repetition. Each filter's largest
response over all chunks, with one logistic layer on top, gives the probability of label 1.

Training uses the labelled rows whose crc32(key as text) mod FOLDS is not 0: of those whose texts have at most SAMPLE_BYTES,
the SAMPLE rows lowest by hash. The two bounds are parameters of fit(); they limit the driver's memory (some four bytes a
byte of text) and concern training only: every whole text is scored. Every VALIDATION-th of these rows is held back;
training stops when the loss on them has not fallen for PATIENCE looks, and the best model seen is kept. Models are kept in
the driver by a digest of the sample and the settings, so the same sample is not trained on twice.

Defined results: null and empty texts are one chunk of padding and get a score like any other; rows without a label, or
with a null one, train nothing; without any labelled row (or with an empty table) every score is 0.5; repeated rows are
scored each; a null key counts as an empty text for the fold; of filters, chunks or rows that tie the first counts; extra
columns, whatever their names, pass through keep_good(); an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .batches import fresh, joined_bytes, map_slices, struct_of

CHUNK, WIDTH, FILTERS = 32, 4, 32
#: Distances at which repetition is looked for; none is over CHUNK / 2, so the padding behind a text parts it from the next.
LAGS = range(2, CHUNK // 2 + 1)
FOLDS, SAMPLE, SAMPLE_BYTES = 5, 4000, 32 << 10
STEPS, BATCH, RATE = 1000, 32, 0.004
#: One in so many sample rows is held back; steps between looks at them; looks without progress that end the training.
VALIDATION, LOOK, PATIENCE = 5, 100, 3
THRESHOLD = 0.3
#: Bytes scored at once; numpy needs some 50 bytes for each. A longer text's chunks are pooled part by part.
SLICE = 1 << 20

Model = dict[str, np.ndarray]


def cut(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Half-chunks (rows of CHUNK / 2 byte codes, 0 for padding, else byte + 1) of all texts, and each text's first row.

    A text of h half-chunks takes max(h, 1) + 1 rows: the last is padding, so chunk i is rows i and i + 1.
    """
    half = CHUNK // 2
    sizes = np.diff(offsets)
    rows = np.maximum(-(-sizes // half), 1) + 1
    first = np.concatenate([[0], np.cumsum(rows)])
    codes = np.zeros(int(first[-1]) * half, np.int16)
    codes[np.arange(len(data)) + np.repeat(first[:-1] * half - offsets[:-1], sizes)] = data.astype(np.int16) + 1
    return codes.reshape(-1, half), first


def repeated(codes: np.ndarray) -> np.ndarray:
    """For each row and lag, the number of its bytes that equal the byte that far before them in the same text."""
    flat, out = codes.ravel(), np.empty((len(codes), len(LAGS)), np.uint8)
    same = np.zeros(len(flat), bool)
    for i, lag in enumerate(LAGS):
        np.equal(flat[lag:], flat[:-lag], out=same[lag:])
        same[:lag] = False
        same &= flat > 0
        out[:, i] = same.reshape(codes.shape).sum(1, dtype=np.uint8)
    return out


def responses(model: Model, codes: np.ndarray, lags: np.ndarray) -> np.ndarray:
    """Filter responses of the chunks that start at each row but the last of the array; lags: of repeated()."""
    half = CHUNK // 2 * WIDTH
    lags = lags * np.float32(2 / CHUNK)
    embedded = model["embed"][codes].reshape(len(codes), half)
    both = embedded @ np.concatenate([model["filter"][:half], model["filter"][half:]], axis=1)
    again = lags @ model["lag"]
    return both[:-1, :FILTERS] + both[1:, FILTERS:] + again[:-1] + again[1:]


def pooled(z: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Largest response of each filter in each text; the row that a text ends with starts no chunk."""
    starts = np.stack([first[:-1], first[1:] - 1], axis=1).ravel()
    padded = np.concatenate([z, z[-1:]])
    return np.maximum.reduceat(padded, starts, axis=0)[::2]


def probabilities(model: Model, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """The probability of label 1 for each text."""
    codes, first = cut(data, offsets)
    step = 2 * SLICE // (CHUNK // 2)
    if len(offsets) == 2 and len(codes) > step + 2:
        best = np.full((1, FILTERS), -np.inf, np.float32)
        for a in range(0, len(codes) - 1, step):
            # the row before a is there for its bytes only: lags reach back no further
            part = codes[max(a - 1, 0) : a + step + 1]
            best = np.maximum(best, responses(model, part, repeated(part))[min(a, 1) :].max(0))
    else:
        best = pooled(responses(model, codes, repeated(codes)), first)
    top = np.maximum(best + model["bias"], 0)
    return 1 / (1 + np.exp(-(top @ model["out"] + model["out_bias"]).astype(np.float64)))


def start(seed: int) -> Model:
    """A model before training."""
    rng = np.random.default_rng(seed)
    half = CHUNK // 2 * WIDTH
    model: Model = {
        "embed": rng.normal(0, 0.3, (257, WIDTH)).astype(np.float32),
        "filter": rng.normal(0, (2 * half) ** -0.5, (2 * half, FILTERS)).astype(np.float32),
        "lag": np.zeros((len(LAGS), FILTERS), np.float32),
        "bias": np.zeros(FILTERS, np.float32),
        "out": rng.normal(0, FILTERS**-0.5, FILTERS).astype(np.float32),
        "out_bias": np.zeros(1, np.float32),
    }
    model["embed"][0] = 0
    return model


def gradients(model: Model, parts: list[np.ndarray], repeats: list[np.ndarray], y: np.ndarray, weight: np.ndarray) -> Model:
    """Gradients of the weighted log loss over some texts, as cut() and repeated() give them. Only the chunks that won
    the pooling count."""
    codes, lags = np.concatenate(parts), np.concatenate(repeats)
    first = np.concatenate([[0], np.cumsum([len(p) for p in parts])])
    z = responses(model, codes, lags)
    won = np.stack([a + np.argmax(z[a : b - 1], axis=0) for a, b in zip(first[:-1], first[1:], strict=True)])
    pre = np.take_along_axis(z, won, axis=0) + model["bias"]
    top = np.maximum(pre, 0)
    p = 1 / (1 + np.exp(-(top @ model["out"] + model["out_bias"])))
    d = (p - y) * weight
    d_pre = np.outer(d, model["out"]) * (pre > 0)
    windows = np.concatenate([codes[won], codes[won + 1]], axis=2)  # texts x filters x CHUNK
    embedded = model["embed"][windows].reshape(*won.shape, CHUNK * WIDTH)
    again = (lags[won].astype(np.float32) + lags[won + 1]) * np.float32(2 / CHUNK)
    back = d_pre[:, :, None] * model["filter"].T[None]
    # sums over the bytes of all windows, one column of the embedding after the other
    embed = np.stack([np.bincount(windows.ravel(), back.reshape(-1, WIDTH)[:, i], minlength=257) for i in range(WIDTH)], axis=1)
    embed[0] = 0
    return {
        "out": top.T @ d,
        "out_bias": d.sum(keepdims=True),
        "bias": d_pre.sum(0),
        "filter": np.einsum("bfi,bf->if", embedded, d_pre),
        "lag": np.einsum("bfl,bf->lf", again, d_pre),
        "embed": embed,
    }


def log_loss(model: Model, texts: list[bytes], y: np.ndarray, weight: np.ndarray) -> float:
    """The weighted log loss over texts, a few at a time."""
    total, at = 0.0, 0
    while at < len(texts):
        end, size = at + 1, len(texts[at])
        while end < len(texts) and size + len(texts[end]) <= SLICE:
            size += len(texts[end])
            end += 1
        data = np.frombuffer(b"".join(texts[at:end]), np.uint8)
        p = np.clip(probabilities(model, data, np.cumsum([0, *map(len, texts[at:end])])), 1e-7, 1 - 1e-7)
        total -= float((np.where(y[at:end] > 0, np.log(p), np.log(1 - p)) * weight[at:end]).sum())
        at = end
    return total


def train(texts: list[bytes], labels: list[int], seed: int = 5, steps: int = STEPS) -> Model:
    """Fit by Adam on mini-batches, for at most so many steps."""
    model = start(seed)
    if not texts:
        return model | {"out": np.zeros(FILTERS, np.float32)}
    y = np.array(labels, np.float32)
    rate = float(np.clip(y.mean(), 0.01, 0.99))
    # Both classes weigh the same: a score is the probability of label 1 were the labels even.
    weight = np.where(y > 0, 0.5 / rate, 0.5 / (1 - rate)).astype(np.float32)
    back = np.arange(len(texts)) % VALIDATION == 0 if len(texts) >= 10 * VALIDATION else np.zeros(len(texts), bool)
    learnt = np.flatnonzero(~back)
    looked = [texts[i] for i in np.flatnonzero(back)]
    parts = {i: cut(np.frombuffer(texts[i], np.uint8), np.array([0, len(texts[i])]))[0] for i in learnt.tolist()}
    repeats = {i: repeated(p) for i, p in parts.items()}
    rng = np.random.default_rng(seed)
    first_moment, second_moment = ({k: np.zeros_like(v) for k, v in model.items()} for _ in range(2))
    order = np.zeros(0, np.int64)
    best, least, since = model, np.inf, 0
    for step in range(1, steps + 1):
        if len(order) < min(BATCH, len(learnt)):
            order = rng.permutation(learnt)
        some, order = order[:BATCH], order[BATCH:]
        grads = gradients(model, [parts[i] for i in some.tolist()], [repeats[i] for i in some.tolist()], y[some], weight[some] / np.float32(len(some)))
        decay = RATE * min(1.0, 2 * (1 - step / (steps + 1)))
        for k, g in grads.items():
            first_moment[k] += 0.1 * (g - first_moment[k])
            second_moment[k] += 0.01 * (g * g - second_moment[k])
            model[k] = (model[k] - decay * (first_moment[k] / (1 - 0.9**step)) / (np.sqrt(second_moment[k] / (1 - 0.99**step)) + 1e-8)).astype(np.float32)
        if looked and step % LOOK == 0:
            loss = log_loss(model, looked, y[back], weight[back])
            if loss < least:
                best, least, since = dict(model), loss, 0
            else:
                since += 1
                if since == PATIENCE:
                    break
    return best if looked and least < np.inf else model


def held_out(key: str) -> Column:
    return F.crc32(F.coalesce(F.col(key).cast("string"), F.lit("")).cast("binary")) % FOLDS == 0


#: Models fitted in this driver, by a digest of what they were fitted on; the last few.
_fitted: dict[str, Model] = {}


def forget_models() -> None:
    """The next fit trains anew, as in a new driver."""
    _fitted.clear()


def fit(docs: DataFrame, labels: DataFrame, label: str = "quality", key: str = "doc_id", text: str = "text", sample: int = SAMPLE, sample_bytes: int = SAMPLE_BYTES) -> Model:
    """Train on a bounded sample of the labelled rows of docs outside the held-out fold."""
    body = F.coalesce(F.col(text), F.lit("")).cast("binary")
    wanted = labels.where(~held_out(key) & F.col(label).isNotNull()).select(key, F.col(label).alias("_label"))
    short = docs.where(F.octet_length(body) <= sample_bytes)
    # only keys meet here; texts are fetched for the chosen ones
    chosen = short.select(key).join(wanted, key).distinct().orderBy(F.xxhash64(key), key, "_label").limit(sample)
    # at most `sample` rows of two numbers: bounded, so broadcast
    rows = short.select(key, body.alias("_body")).join(F.broadcast(chosen), key)
    found = rows.orderBy(F.xxhash64(key), key, "_label", F.xxhash64("_body")).limit(sample).select("_body", "_label").toPandas()
    texts, marks = [bytes(x) for x in found["_body"]], [int(x > 0) for x in found["_label"]]
    settings = (CHUNK, WIDTH, FILTERS, STEPS, BATCH, RATE, VALIDATION, LOOK, PATIENCE, marks)
    digest = hashlib.sha256(repr(settings).encode())
    for t in texts:
        digest.update(len(t).to_bytes(8, "big") + t)
    name = digest.hexdigest()
    if name not in _fitted:
        while len(_fitted) >= 4:
            del _fitted[next(iter(_fitted))]
        _fitted[name] = train(texts, marks)
    return _fitted[name]


def scored(docs: DataFrame, model: Model, keep: list[str], text: str = "text", name: str = "score") -> DataFrame:
    """The kept columns and the score, under a name that none of them has, for each row of docs."""
    held = docs.sparkSession.sparkContext.broadcast(model)  # some 20 KB, whatever the input
    input_name = fresh(docs, "_body")

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        score = probabilities(held.value, *joined_bytes(batch.column(input_name)))
        return pa.RecordBatch.from_arrays([*(batch.column(c) for c in keep), pa.array(score)], [*keep, name])

    body = F.coalesce(F.col(text), F.lit("")).cast("binary")
    rows = docs.select(*[F.col(f"`{n}`") for n in keep], body.alias(input_name))
    return map_slices(rows, input_name, work, struct_of(docs, keep, (name, "double")), SLICE)


def predictions(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, held_out, score and predicted for each row of docs."""
    rows = scored(docs, fit(docs, labels, key=key, text=text), [key], text)
    return rows.select(key, held_out(key).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))


def keep_good(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """docs without those that the classifier rejects; the others are unchanged."""
    name = fresh(docs, "score")
    rows = scored(docs, fit(docs, labels, key=key, text=text), docs.columns, text, name)
    return rows.where(F.col(name) >= THRESHOLD).select(*[F.col(f"`{n}`") for n in docs.columns])
