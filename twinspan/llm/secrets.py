"""Secret scans: fixed patterns, and character Markov models of random strings and of ordinary identifiers.

Patterns give the base spans. The models judge every run of credential characters: a run is a secret if its
log-likelihood under the random-string model exceeds that under the ordinary model by LEAST nats, and by MARGIN nats a
character. Such runs are added to the base spans; so is a run that a base span covers in part only, because what is left
of it belongs to the same secret. Runs inside one base span add nothing.

The models are character bigrams, trained from a table of labelled samples (see fit()): a row is a string and whether it
is random. labelled_samples() is the library's own table: strings drawn from the alphabets that credentials use, against
identifiers built of words and syllables of several languages, dates, numbers and codes as people write them, and
sequences that only look random (repeated characters, alphabets, keyboard rows, bases). All are made by rule from fixed
seeds, so every interpreter has the same models. Meant to be found, because nothing in their characters tells them from
keys: UUIDs, digests, and other strings drawn evenly from many letters, such as sequences of amino acids.

Spans are in code points, end exclusive. Defined results: a null text counts as empty; null ids and repeated rows are each
scanned; a text of any length is scanned whole, SEGMENT characters at a time between runs; of equal spans of two kinds each
is listed, by start, then kind; what is not valid UTF-8 in a text counts as U+FFFD, as Spark's make_valid_utf8 puts it, and
redact() leaves it so; columns of any other name are ignored by scan() and pass through redact(); an empty table
gives an empty result.
"""

from __future__ import annotations

import functools
import hashlib
import random
import re
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, StructField, StructType

from .batches import fresh, map_slices

# The base patterns.
ASSIGN = re.compile(r"""((?ai:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
ACCESS = re.compile(r"AKIA[A-Z0-9]{14,}")
HEX = re.compile(r"[0-9a-f]{16,}")
ASSIGN_LEAST = 12
KINDS = ["assign", "access", "hex", "random"]

#: Characters of runs; a run ends where another one stands.
ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_=-"
OUTSIDE = re.compile(r"[^A-Za-z0-9+/_=-]")
#: What the log-likelihood ratio of a secret reaches, in nats: for a character, and in all.
MARGIN, LEAST = 0.4, 16.0
#: Added to the count of each bigram.
SMOOTH = 0.5
#: Characters that the models judge at once; numpy needs some 30 bytes for each.
SEGMENT = 1 << 20

_CODE = np.zeros(128, np.uint8)
_CODE[[ord(c) for c in ALPHABET]] = np.arange(1, len(ALPHABET) + 1)

_SYLLABLES = "the and ing ion er re on an in at en es or te ti ar st nd to it is le ve co me de ne se ro al ma li ta ra ri ca un pro ble der ich que ent ado cion eau".split()
_WORDS = "get set user name file path data list item index value count config key hash id http server client request response error handler test build parse read write buffer stream node tree map table column row query session token page view model image video chapter section version release draft final report account order customer".split()
_ENGLISH = (
    "which what when where while who why whole white wheel whale whether whatever anywhere somewhat only early daily family really likely friendly slowly truly ugly holy rely supply apply reply july lyric polygon analysis "
    "buy play boy may they say eye year young yellow beyond system style type rhythm mystery joyful voyage crazy lazy pizza puzzle buzz zone zero zebra citizen frozen horizon magazine jazz "
    "quick quiet question equal square unique vague league enough through thought though daughter laugh night right knight know knee knife write wrong wrist sword answer island debt doubt "
    "aware always away ahead ago above about after again against almost along among another around because before behind below between both during each either every few first from good great have here high however"
).split()
_ABROAD = (
    "zum zur zusammen dazu zurück zucker zug zuletzt hinzu kurz zuvor "
    "jetzt platz satz schutz ganz herz pflanze kopf pferd pfeffer schwarz zwischen straße schreiben gesellschaft wirtschaft entwicklung möglichkeit regierung zeitung "
    "deux mieux vieux yeux lieux jeux heureux nombreux beaux eaux cheveux nouveaux travaux animaux oiseaux aujourd toujours quelque chaque lorsque beaucoup histoire "
    "ciudad gobierno trabajo mujer tiempo siempre nosotros desarrollo quien mejor hijo lluvia año niño calle llegar izquierda "
    "perché quando città lavoro governo giorno sempre quello oggi figlio bisogno squadra scuola "
    "não então trabalho coração governo cidade também melhor filho história "
    "huis vrouw gebruik kijken vrijheid tijd książka dzień szczęście wszystko który przez czas"
).split()

Spans = list[tuple[int, int, int]]


def random_samples(n: int = 3000, seed: int = 7) -> list[str]:
    """Strings drawn from the alphabets of keys."""
    rng = random.Random(seed)
    lower, upper, digits = "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789"
    alphabets = [lower + upper + digits, lower + upper + digits + "+/", lower + upper + digits + "-_", digits + "abcdef", upper + digits, lower + digits]
    return ["".join(rng.choice(a) for _ in range(rng.randint(12, 64))) for a in (alphabets[i % len(alphabets)] for i in range(n))]


def identifier_samples(n: int = 6000, seed: int = 8) -> list[str]:
    """Words of several languages, paths and identifiers in the usual spellings, with the numbers people put in them."""
    rng, out, known = random.Random(seed), [], [*_WORDS, *_ENGLISH, *_ABROAD]
    for i in range(n):
        words = [rng.choice(known) if rng.random() < 0.7 else "".join(rng.choice(_SYLLABLES) for _ in range(rng.randint(2, 4))) for _ in range(rng.randint(1, 5))]
        if rng.random() < 0.5:
            words.append(str(rng.choice([rng.randint(0, 99), rng.randint(1900, 2100), 10 ** rng.randint(1, 6)])))
        styles = ["_".join(words), "-".join(words), "/".join(words), "".join(w.capitalize() for w in words), "_".join(words).upper(), "".join(words)]
        out.append(styles[i % len(styles)])
    return out


def number_samples(n: int = 4000, seed: int = 9) -> list[str]:
    """Numbers, dates, times, versions, telephone and part numbers."""
    rng = random.Random(seed)
    digits = lambda k: "".join(rng.choice("0123456789") for _ in range(k))
    forms = [
        lambda: digits(rng.randint(1, 16)),
        lambda: f"{rng.randint(1900, 2100)}-{rng.randint(1, 12):02}-{rng.randint(1, 28):02}",
        lambda: f"{rng.randint(1900, 2100)}-{rng.randint(1, 12):02}-{rng.randint(1, 28):02}T{rng.randint(0, 23):02}",
        lambda: f"{rng.randint(1, 28)}/{rng.randint(1, 12)}/{rng.randint(1900, 2100)}",
        lambda: f"+{rng.randint(1, 99)}-{digits(3)}-{digits(3)}-{digits(4)}",
        lambda: f"{digits(3)}-{digits(2)}-{digits(4)}",
        lambda: f"{digits(4)}-{digits(4)}-{digits(4)}-{digits(4)}",
        lambda: f"v{digits(1)}-{digits(2)}",
        lambda: f"{rng.choice('ABCDEFGHKLMNPRSTX')}{digits(rng.randint(1, 4))}",
        lambda: f"{rng.choice(['ISO', 'RFC', 'DIN', 'EN', 'ID', 'No', 'COVID', 'MP', 'H2', 'UTF'])}-{digits(rng.randint(1, 5))}",
        lambda: f"{digits(rng.randint(1, 4))}{rng.choice(['kg', 'km', 'ms', 'GB', 'px', 'th', 'nd', 's', 'x'])}",
    ]
    return [forms[i % len(forms)]() for i in range(n)]


def sequence_samples(n: int = 2000, seed: int = 10) -> list[str]:
    """One character repeated, alphabets and keyboard rows and parts of them, and sequences of the four bases."""
    rng = random.Random(seed)
    rows = ["abcdefghijklmnopqrstuvwxyz", "0123456789", "qwertyuiop", "asdfghjkl", "zxcvbnm", "qwertyuiopasdfghjklzxcvbnm"]
    rows += [r.upper() for r in rows if r.isalpha()]
    part = lambda r: r[(a := rng.randrange(len(r) - 3)) : a + rng.randint(4, len(r))]
    forms = [
        lambda: rng.choice(ALPHABET) * rng.randint(8, 64),
        lambda: rng.choice(rows) * rng.randint(1, 3),
        lambda: part(rng.choice(rows)),
        lambda: "".join(rng.choice("ACGT") for _ in range(rng.randint(12, 64))),
    ]
    return [forms[i % len(forms)]() for i in range(n)]


def labelled_samples(spark: SparkSession) -> DataFrame:
    """The library's own samples: text, is_random."""
    rows = [(s, True) for s in random_samples()] + [(s, False) for s in [*identifier_samples(), *number_samples(), *sequence_samples()]]
    return spark.createDataFrame(rows, "text string, is_random boolean")


@dataclass(frozen=True, eq=False)
class Models:
    """ratio[a, b]: log-likelihood of character b behind a, random against ordinary; 0 stands for the start of a run."""

    ratio: np.ndarray

    def of(self, run: str) -> float:
        """The log-likelihood ratio of one run, character by character."""
        places = [0, *(ALPHABET.index(c) + 1 for c in run)]
        return float(sum(self.ratio[a, b] for a, b in zip(places, places[1:], strict=False)))


def models_from(counts: dict[tuple[bool, str, str], int]) -> Models:
    """Models of bigram counts by (is_random, character before or "", character)."""
    table = np.full((2, len(ALPHABET) + 1, len(ALPHABET) + 1), SMOOTH)
    table[:, :, 0] = 0
    place = {c: i + 1 for i, c in enumerate(ALPHABET)} | {"": 0}
    for (is_random, a, b), n in counts.items():
        table[int(is_random), place[a], place[b]] += n
    log = np.log(table[:, :, 1:] / table[:, :, 1:].sum(2, keepdims=True))
    ratio = np.zeros(table.shape[1:])
    ratio[:, 1:] = log[1] - log[0]
    return Models(ratio)


def fit(samples: DataFrame, text: str = "text", label: str = "is_random") -> Models:
    """Train on a table of labelled samples of any size; only counts of bigrams, some 9,000 at most, come to the driver.

    Characters outside ALPHABET part a sample into several; rows with a null in either column train nothing; without
    rows of one label its model is uniform.
    """
    runs = samples.where(F.col(text).isNotNull() & F.col(label).isNotNull()).select(F.col(label).cast("boolean").alias("is_random"), F.explode(F.split(F.col(text), OUTSIDE.pattern)).alias("run"))
    runs = runs.where(F.length("run") > 0)
    pairs = runs.select("is_random", F.posexplode(F.split("run", "")).alias("at", "b"), "run").where(F.length("b") > 0)
    pairs = pairs.select("is_random", F.when(F.col("at") > 0, F.substring("run", F.col("at"), F.lit(1))).otherwise("").alias("a"), "b")
    found = pairs.groupBy("is_random", "a", "b").agg(F.count(F.lit(1)).alias("n")).collect()
    return models_from({(r["is_random"], r["a"], r["b"]): r["n"] for r in found})


@functools.lru_cache(maxsize=1)
def _own_models(application: str) -> Models:
    return fit(labelled_samples(SparkSession.active()))


def own_models(spark: SparkSession) -> Models:
    """The models of the library's own samples, trained once for a session."""
    return _own_models(spark.sparkContext.applicationId)


def base_spans(text: str) -> Spans:
    """(start, kind's place in KINDS, end) of the fixed patterns' matches, kind by kind."""
    out = [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= ASSIGN_LEAST]
    out += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text)]
    return out + [(m.start(), 2, m.end()) for m in HEX.finditer(text)]


def _segments(text: str, limit: int):
    """Places to cut text, none of them inside a run."""
    at = 0
    while at < len(text):
        stop = OUTSIDE.search(text, at + limit) if at + limit < len(text) else None
        end = stop.start() if stop else len(text)
        yield at, end
        at = end


def judged(text: str, models: Models, limit: int = SEGMENT) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts, ends and ratios of all runs of text."""
    found = []
    for a, b in _segments(text, limit):
        points = np.frombuffer(text[a:b].encode("utf-32-le", "surrogatepass"), np.uint32)
        code = np.zeros(len(points) + 2, np.uint8)
        code[1:-1] = np.where(points < 128, _CODE[np.minimum(points, 127)], 0)
        inside = code > 0
        starts, ends = np.flatnonzero(inside[1:] & ~inside[:-1]), np.flatnonzero(inside[:-1] & ~inside[1:])
        if len(starts):
            # characters outside of runs add nothing, whatever stands before them
            found.append((starts + a, ends + a, np.add.reduceat(models.ratio[code[:-1], code[1:]], starts)))
    if not found:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)
    return tuple(np.concatenate(c) for c in zip(*found, strict=True))


def added_spans(base: Spans, starts: np.ndarray, ends: np.ndarray, ratios: np.ndarray) -> Spans:
    """Runs that the models hold to be secrets or that a base span covers in part, unless one base span covers them."""
    chosen = set(np.flatnonzero((ratios >= LEAST) & (ratios >= MARGIN * (ends - starts))).tolist())
    for s, _, e in base:
        first, last = int(np.searchsorted(ends, s, side="right")), int(np.searchsorted(starts, e, side="left"))
        chosen.update(i for i in (first, last - 1) if first <= i < last)
    order = np.array(sorted(chosen), np.int64)
    free = np.ones(len(order), bool)
    for s, _, e in base:
        free[np.searchsorted(starts[order], s, side="left") : np.searchsorted(ends[order], e, side="right")] = False
    return [(int(starts[i]), 3, int(ends[i])) for i in order[free].tolist()]


def found_in(texts: list[str], models: Models) -> list[tuple[Spans, Spans, int]]:
    """For each text its base spans, its added ones and the number of runs judged."""
    # No pattern and no run holds a line break, so the texts can be scanned as one.
    joined = "\n".join(texts)
    begins = np.cumsum([0, *(len(t) + 1 for t in texts)])
    starts, ends, ratios = judged(joined, models)
    base: list[Spans] = [[] for _ in texts]
    spans = base_spans(joined)
    for i, (s, kind, e) in zip((np.searchsorted(begins, [s for s, _, _ in spans], side="right") - 1).tolist(), spans, strict=True):
        base[i].append((s - int(begins[i]), kind, e - int(begins[i])))
    cuts = np.searchsorted(starts, begins)
    likely = np.searchsorted(np.flatnonzero((ratios >= LEAST) & (ratios >= MARGIN * (ends - starts))), cuts)
    out = []
    for i, own in enumerate(base):
        a, b = cuts[i], cuts[i + 1]
        more = added_spans(own, starts[a:b] - begins[i], ends[a:b] - begins[i], ratios[a:b]) if own or likely[i] < likely[i + 1] else []
        out.append((own, more, int(b - a)))
    return out


def shown(spans: Spans) -> str:
    return ",".join(f"{KINDS[k]}:{s}:{e}" for s, k, e in sorted(spans))


def scan(docs: DataFrame, key: str = "doc_id", text: str = "text", models: Models | None = None) -> DataFrame:
    """Return key, n_assign, n_access, n_hex, n_random, n_judged, base_sha256 and spans for each row.

    n_random counts the added spans, n_judged the runs that the models judged."""
    kept = docs.select(key).schema[0].dataType.simpleString()
    models = models or own_models(docs.sparkSession)
    names = ["n_assign", "n_access", "n_hex", "n_random", "n_judged", "base_sha256", "spans"]

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        rows = []
        for base, more, n in found_in(batch.column("_text").to_pylist(), models):
            counts = [sum(k == i for _, k, _ in base) for i in range(3)]
            rows.append((*counts, len(more), n, hashlib.sha256(shown(base).encode()).hexdigest(), shown(base + more)))
        columns = [pa.array([r[i] for r in rows], pa.int64() if i < 5 else pa.string()) for i in range(7)]
        return pa.RecordBatch.from_arrays([batch.column(key), *columns], [key, *names])

    rows = docs.select(key, F.make_valid_utf8(F.coalesce(F.col(text), F.lit(""))).alias("_text"))
    return map_slices(rows, "_text", work, f"`{key}` {kept}, " + ", ".join(f"{n} {'long' if i < 5 else 'string'}" for i, n in enumerate(names)))


def _marked(text: str, spans: Spans, mark: str) -> str:
    out, at = [], 0
    for s, e in sorted((s, e) for s, _, e in spans):
        if s >= at:
            out += [text[at:s], mark]
        at = max(at, e)
    return "".join([*out, text[at:]])


def redacted(text: str | None, models: Models, mark: str = "[SECRET]") -> str | None:
    """text with the union of its spans replaced by mark; a text without secrets is returned as it is."""
    if not text:
        return text
    base, more, _ = found_in([text], models)[0]
    return _marked(text, base + more, mark) if base or more else text


def redact(docs: DataFrame, text: str = "text", mark: str = "[SECRET]", models: Models | None = None, changed: str | None = None) -> DataFrame:
    """docs with secrets replaced by mark in the text column; all other columns and rows are unchanged.

    changed: a boolean column of this name is added, true where the text was changed. docs must lack it."""
    place = docs.columns.index(text)
    models = models or own_models(docs.sparkSession)
    schema = docs.schema
    if changed:
        if fresh(docs, changed) != changed:
            raise ValueError(f"documents have a column {changed}")
        schema = StructType([*docs.schema, StructField(changed, BooleanType())])

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        columns = list(batch.columns)
        texts = columns[place].to_pylist()
        spans = [base + more for base, more, _ in found_in([t or "" for t in texts], models)]
        columns[place] = pa.array([_marked(t, s, mark) if s else t for t, s in zip(texts, spans, strict=True)], columns[place].type)
        if changed:
            columns.append(pa.array([bool(s) for s in spans]))
        return pa.RecordBatch.from_arrays(columns, [f.name for f in schema])

    valid = docs.withColumn(text, F.make_valid_utf8(F.col(f"`{text}`")))
    return map_slices(valid, text, work, schema)
