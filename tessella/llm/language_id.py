"""Language identification: sparse multinomial logistic regression on TF-IDF of character n-grams.

Trained by follow-the-regularised-leader with elastic-net penalties, then calibrated by one temperature. A text's
term frequencies are relative (they sum to one), so the score of a class is a mean of weights over all n-grams of the
whole text: prediction needs no table of a text's distinct n-grams and streams over texts of any length.

The model is fitted on the driver on the whole texts of at most MAX_TRAIN_ROWS rows that have a language and may be
learned from: of each language, from the most frequent MAX_LANGUAGES, as many as go round, those with the smallest hashed
ids, so that no language is missed for being rare; of MAX_TRAIN_BYTES at most. Its weights are 2**BITS numbers a language.

Edge cases: a null text, or one without any letter, is ``und`` with score 0; without training rows every text is
``und``; a single training language is predicted with score 1; rows with null or repeated ids are predicted row by
row; an empty table gives an empty result; other columns are ignored, so their names can't clash.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import staging, textvec
from .linear import Rows, softmax
from .toxicity import bounded, learnable, one_an_id

BITS = 17
SIZES = (1, 2, 3)
MAX_TRAIN_ROWS = 6_000
MAX_TRAIN_BYTES = 48 << 20
MAX_LANGUAGES = 200
UNKNOWN = "und"
_ASCII_LETTER = np.zeros(256, bool)
_ASCII_LETTER[65:91] = _ASCII_LETTER[97:123] = True


def code_points(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Folded code points of a chunk, and the texts' offsets in them: lower case (ASCII and Latin-1), non-letters below 128 are spaces."""
    lead = (raw & 0xC0) != 0x80
    before = np.zeros(len(raw) + 1, np.int64)
    np.cumsum(lead, out=before[1:])
    points = np.frombuffer(raw.tobytes().decode("utf-8", "replace").encode("utf-32-le"), "<u4").astype(np.uint32)
    upper = ((points >= 65) & (points <= 90)) | ((points >= 0xC0) & (points <= 0xDE) & (points != 0xD7))
    points = points + upper.astype(np.uint32) * 32
    points[(points < 97) | ((points > 122) & (points < 128))] = 32
    return points, before[offsets]


def grams(points: np.ndarray, offsets: np.ndarray, size: int) -> np.ndarray:
    """Hashed n-grams that start at each code point; 0 for those that would cross a text's end."""
    n = len(points)
    h = np.full(n, size, np.uint32)
    for k in range(size):
        part = points[k:] if k else points
        h[: n - k] = (h[: n - k] ^ part) * np.uint32(0x9E3779B1)
        h ^= h >> np.uint32(15)
    out = (h >> np.uint32(32 - BITS)).astype(np.int64)
    for k in range(1, size):
        at = offsets[1:] - k
        out[at[(at >= 0) & (at >= offsets[:-1])]] = 0
    return out


def has_letter(raw: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    flags = textvec.per_text(_ASCII_LETTER[raw], offsets) > 0
    for i in np.flatnonzero(~flags):
        own = raw[offsets[i] : offsets[i + 1]]
        if (own > 127).any():
            flags[i] = any(c.isalpha() for c in own.tobytes().decode("utf-8", "replace"))
    return flags


class Model:
    """Languages, weights (n-gram, language) with the inverse document frequencies in them, intercepts, temperature."""

    def __init__(self, langs: list[str], weights: np.ndarray, intercepts: np.ndarray, temperature: float):
        self.langs, self.weights, self.intercepts, self.temperature = langs, weights.astype(np.float32), intercepts, temperature

    def predict(self, raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(number of the language or -1, score) of each text of a chunk."""
        n = len(offsets) - 1
        letters = has_letter(raw, offsets) if len(raw) else np.zeros(n, bool)
        if not self.langs or not letters.any():
            return np.full(n, -1), np.zeros(n)
        points, at = code_points(raw, offsets)
        z = np.zeros((n, len(self.langs)))
        full = np.flatnonzero(np.diff(at))
        total = np.maximum(np.diff(at), 1)[:, None] * len(SIZES)
        for size in SIZES:
            g = grams(points, at, size)
            for c in range(len(self.langs)):
                z[full, c] += np.add.reduceat(self.weights[c][g], at[:-1][full], dtype=np.float64)
        p = softmax((z / total + self.intercepts) / self.temperature)
        best = p.argmax(1)
        return np.where(letters, best, -1), np.where(letters, p[np.arange(n), best], 0.0)


def _tf(texts: list[str]) -> Rows:
    """Relative frequencies of n-grams of each text."""
    columns, values, size = [], [], []
    for _, _, raw, offsets in textvec.chunks(pa.array(texts, pa.string())):
        points, at = code_points(raw, offsets)
        doc = np.repeat(np.arange(len(at) - 1), np.diff(at))
        key = np.concatenate([doc << BITS | grams(points, at, s) for s in SIZES])
        key, count = np.unique(key, return_counts=True)
        doc = key >> BITS
        columns.append(key & ((1 << BITS) - 1))
        values.append(count / (np.maximum(np.diff(at), 1)[doc] * len(SIZES)))
        size.append(np.bincount(doc, minlength=len(at) - 1))
    if not columns:
        return Rows(np.zeros(0, np.int64), np.zeros(0), np.zeros(1, np.int64))
    return Rows(np.concatenate(columns), np.concatenate(values), np.concatenate([[0], np.cumsum(np.concatenate(size))]))


def ftrl(x: Rows, y: np.ndarray, classes: int, alpha: float = 2.0, beta: float = 1.0, l1: float = 2e-4, l2: float = 1e-4, epochs: int = 3, batch: int = 32, seed: int = 3) -> tuple[np.ndarray, np.ndarray]:
    """Weights (classes, columns) and intercepts by follow-the-regularised-leader, proximal form, by coordinate."""
    width = 1 << BITS
    z, n, w = (np.zeros((classes, width)) for _ in range(3))
    b = np.zeros(classes)
    rnd = np.random.default_rng(seed)
    for _ in range(epochs):
        order = rnd.permutation(len(x))
        for k in range(0, len(order), batch):
            rows = order[k : k + batch]
            part = x.take(rows)
            used, inverse = np.unique(part.columns, return_inverse=True)
            row = np.repeat(np.arange(len(rows)), np.diff(part.begin))
            zc, nc = z[:, used], n[:, used]
            shrunk = np.sign(zc) * np.maximum(np.abs(zc) - l1, 0)
            wc = -shrunk / ((beta + np.sqrt(nc)) / alpha * 1e-2 + l2)
            score = np.stack([np.bincount(row, part.values * wc[c, inverse], len(rows)) for c in range(classes)], 1) + b
            error = softmax(score)
            error[np.arange(len(rows)), y[rows]] -= 1
            error /= len(rows)
            b -= 0.1 * error.sum(0)
            g = np.stack([np.bincount(inverse, part.values * error[row, c], len(used)) for c in range(classes)])
            sigma = (np.sqrt(nc + g * g) - np.sqrt(nc)) / alpha * 1e-2
            z[:, used] = zc + g - sigma * wc
            n[:, used] = nc + g * g
    shrunk = np.sign(z) * np.maximum(np.abs(z) - l1, 0)
    w = -shrunk / ((beta + np.sqrt(n)) / alpha * 1e-2 + l2)
    return w, b


def fit(texts: list[str], langs: list[str]) -> Model:
    names = sorted(set(langs))
    if len(names) < 2:
        return Model(names, np.zeros((len(names), 1 << BITS)), np.zeros(len(names)), 1.0)
    y = np.searchsorted(names, langs)
    x = _tf(texts)
    idf = np.log((1 + len(x)) / (1 + np.bincount(x.columns, minlength=1 << BITS))) + 1
    x.values = x.values * idf[x.columns]
    held = np.arange(len(x)) % 8 == 7
    if held.sum() < 8:
        held[:] = False
    w, b = ftrl(x.take(np.flatnonzero(~held)), y[~held], len(names))
    check = np.flatnonzero(held) if held.any() else np.arange(len(x))
    score = x.take(check).times(w.T) + b
    loss = lambda t: -np.log(np.maximum(softmax(score / t)[np.arange(len(check)), y[check]], 1e-12)).mean()
    temperature = min(np.exp(np.linspace(-3, 3, 61)), key=loss)
    return Model(names, w * idf, b, float(temperature))


def _predictor(model) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = model.value
        names = np.array([*m.langs, UNKNOWN], object)
        for batch in batches:
            for a, b, raw, offsets in textvec.chunks(batch.column(1), 1 << 19):
                which, score = m.predict(raw, offsets)
                yield pa.RecordBatch.from_arrays([batch.column(0)[a:b], pa.array(names[which], pa.string()), pa.array(score)], names=["id", "lang_pred", "score"])

    return run


def shares(counts: dict[str, int], most: int) -> dict[str, int]:
    """Rows of each language: all of a scarce one, and of the others as many as there are for each."""
    out, left = {}, most
    for i, (lang, n) in enumerate(sorted(counts.items(), key=lambda p: (p[1], p[0]))):
        out[lang] = min(n, left // (len(counts) - i))
        left -= out[lang]
    return out


def train(docs: DataFrame, id_col: str, text_col: str, lang_col: str, max_rows: int = MAX_TRAIN_ROWS, max_bytes: int = MAX_TRAIN_BYTES) -> Model:
    known = docs.where(F.col(text_col).isNotNull() & F.col(lang_col).isNotNull() & learnable(F.col(id_col)))
    known = known.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.col(lang_col).alias("lang"))
    counts = known.groupBy("lang").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "lang").limit(MAX_LANGUAGES)
    quota = shares({r.lang: r.n for r in counts.collect()}, max_rows)
    if not quota:
        return fit([], [])
    asked = F.create_map(*(F.lit(x) for p in quota.items() for x in p))[F.col("lang")]
    place = F.row_number().over(Window.partitionBy("lang").orderBy(F.xxhash64("id"), "id"))
    # places up to the largest quota are kept by every task before anything is shuffled
    chosen = known.select("id", "lang").distinct().select("id", "lang", place.alias("place")).where(F.col("place") <= max(quota.values()))
    chosen = chosen.where(F.col("place") <= asked).select("id", "lang")
    rows = staging.stage(one_an_id(known.join(F.broadcast(chosen), ["id", "lang"]).select("id", "text", "lang")), "labelled")
    rows = bounded(rows, max_bytes).select("id", "text", "lang").toArrow().sort_by("id")
    return fit(rows["text"].to_pylist(), rows["lang"].to_pylist())


def language_id(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", model: Model | None = None) -> DataFrame:
    """(id, lang_pred, score) of every row; ``lang_col`` is read for training only."""
    spark = docs.sparkSession
    staging.ship(spark)
    model = spark.sparkContext.broadcast(model or train(docs, id_col, text_col, lang_col))
    kind = docs.schema[id_col].dataType.simpleString()
    source = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    return source.mapInArrow(_predictor(model), f"id {kind}, lang_pred string, score double").withColumnRenamed("id", id_col)
