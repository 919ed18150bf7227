"""Mixing sources to target weights: token weights raked to marginals, then documents sampled by calibrated probability.

One pass over the texts counts each document's tokens (white-space separated words) and assigns its topic: the nearest
of TOPICS clusters of word vectors, fitted by spherical k-means on all texts; within each language (of the FITTED most
frequent; all others share one model), or topics would only repeat the languages. Word counts are written once; a round
of k-means is one job over them, which gives the driver a sum for each word's bucket and cluster. These sums are whole
numbers, so clusters don't depend on the order of rows or tasks. Documents are counted into cells (one for each combination of source, language and topic that occurs), and iterative proportional fitting
multiplies a factor for each source, language and topic until token shares match every target marginal. A document is
kept by a hash of its id, so a rerun keeps the same documents, with probability

*   weight / largest weight, which meets all targets but keeps little where one cell is scarce; or
*   with ``capped``, min(1, share * weight), raked with that bound in place: cells at 1 stay there and the others make
    up for them, at the largest share of all tokens (by bisection) for which every target is still met within CLOSE; or
*   with ``keep_share``, min(1, keep_share * weight) without raking anew: what is short of its target is all kept.

Values of each dimension are numbered by Spark and only numbers reach the driver: one factor a value, at most MAX_VALUES.
Cells are fitted on the driver while there are at most DRIVER_CELLS of them, a checked size; beyond that the same
iteration, of as many rounds and to the same tolerance, sums up over the table of cells. Where targets are still missed
(some can't be met together), a warning tells by how much.

Edge cases: a null source, language or topic is a value of its own; target values without any document are left out
and the others scaled to sum to one, values without a target keep their observed share of the rest; a null or empty
text, or one of blanks, has no tokens and the topic "none": its weight is its cell's like any other's; rows of one id
are kept or dropped together, rows without an id by a hash of their text; an empty table gives an empty result.
``docs`` may have columns named like those used here: they are passed through, result columns are behind ``prefix``.
"""

from __future__ import annotations

import warnings
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.order import Ordered
from . import staging, sums_by_block, textvec

DRIVER_CELLS = 100_000
MAX_VALUES = 20_000_000
BROADCAST_VALUES = 200_000
ROUNDS = 200
TOLERANCE = 1e-9
#: The largest miss of a target share that ``capped`` allows, and its number of bisections.
CLOSE = 0.005
HALVINGS = 8
TEMPER = 0.7
TOPICS = 6
#: Languages with topics of their own, and the fewest texts for that.
FITTED = 16
LEAST_TEXTS = 60
BITS = 16
#: Words of a text's vector that a task works on at a time (of one text at least), and the parts of one that values are counted in.
PASS_WORDS = 1_000_000
UNIT = 1 << 24
_LOGS = (1 + np.log(np.arange(1 << 12).clip(1))).astype(np.float32)

Sums = Callable[[int, list[np.ndarray], float | None], np.ndarray]


def word_buckets(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, textvec.Words]:
    raw = textvec.LOWER[raw]
    w = textvec.words(raw, offsets)
    return (textvec.Hasher.of(raw).ranges(w.starts, w.ends) >> np.uint64(64 - BITS)).astype(np.int64), w


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(lang, draw, words, times): the distinct word buckets of each text that has words, and how often each is there."""
    for batch in batches:
        for a, b, raw, offsets in textvec.chunks(batch.column("text")):
            h, w = word_buckets(raw, offsets)
            key, times = np.unique(w.docs << BITS | h, return_counts=True)
            size = np.bincount(key >> BITS, minlength=b - a)
            full = np.flatnonzero(size)
            ends = np.concatenate([[0], np.cumsum(size[full])])
            packed = [
                pa.Array.from_buffers(pa.binary(), len(full), [None, pa.py_buffer((ends * v.itemsize).astype(np.int32)), pa.py_buffer(v)])
                for v in ((key & ((1 << BITS) - 1)).astype(np.uint16), times.astype(np.uint32))
            ]
            yield pa.RecordBatch.from_arrays([*(batch.column(c)[a:b].take(pa.array(full)) for c in ("lang", "draw")), *packed], names=["lang", "draw", "words", "times"])


def _unpacked(column: pa.Array, kind: type) -> tuple[np.ndarray, np.ndarray]:
    """(numbers of all rows, where each row's begin)."""
    column = column.cast(pa.large_binary())
    _, offs, data = column.buffers()
    offsets = np.frombuffer(offs, np.int64, len(column) + 1, column.offset * 8)
    return np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]].view(kind), (offsets - offsets[0]) // np.dtype(kind).itemsize


def _vectors(batches: Iterator[pa.RecordBatch], langs: list[str], idf: np.ndarray | None) -> Iterator[tuple]:
    """(rows, model of each, where each row's words begin, places in a model's weights, values) of some rows at a time."""
    number = {lang: i + 1 for i, lang in enumerate(langs)}
    for whole in batches:
        _, begin = _unpacked(whole.column("words"), np.uint16)
        a = 0
        while a < len(whole):
            b = max(a + 1, int(np.searchsorted(begin, begin[a] + PASS_WORDS, "right")) - 1)
            batch, a = whole.slice(a, b - a), b
            word, begin_here = _unpacked(batch.column("words"), np.uint16)
            model = np.array([number.get(lang, 0) for lang in batch.column("lang").to_pylist()])
            size = np.diff(begin_here)
            at = word + (np.repeat(model, size) << BITS)
            value = np.ones(len(at), np.float32)
            if idf is not None:
                times = _unpacked(batch.column("times"), np.uint32)[0]
                value = _LOGS[np.minimum(times, len(_LOGS) - 1)]
                often = np.flatnonzero(times >= len(_LOGS))
                value[often] = 1 + np.log(times[often])
                value *= idf[at]
                value /= np.repeat(np.sqrt(np.add.reduceat(value * value, begin_here[:-1])), size)
            yield batch, model, begin_here, at, value


def _likeness(centres: np.ndarray, begin: np.ndarray, at: np.ndarray, value: np.ndarray) -> np.ndarray:
    return np.stack([np.add.reduceat(value * c[at], begin[:-1]) for c in centres])


def _bucket_sums(sent) -> Callable:
    """Arrow function: word counts to sums by place: texts that have a word, or, with centres, values by nearest one."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        langs, idf, centres = sent.value
        places, n = (len(langs) + 1) << BITS, 1 if centres is None else len(centres)
        sums = np.zeros(places * n)  # of whole numbers, which are exact up to 2**53
        for _, _, begin, at, value in _vectors(batches, langs, idf):
            if centres is None:
                sums += np.bincount(at, minlength=places)
            else:
                near = _likeness(centres, begin, at, value).argmax(0)
                sums += np.bincount(at + np.repeat(near * places, np.diff(begin)), np.rint(value * np.float32(UNIT)), len(sums))
        yield from sums_by_block.sent(sums)

    return run


def _drawn(sent, turn: int) -> Callable:
    """Arrow function: of word counts, one row a model, drawn with a chance that grows with its distance from all centres."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        langs, idf, centres = sent.value
        for batch, model, begin, at, value in _vectors(batches, langs, idf):
            far = np.ones(len(batch)) if centres is None else (1 - _likeness(centres, begin, at, value).max(0)).clip(0) ** 2
            u = (textvec.mix(batch.column("draw").to_numpy().view(np.uint64) + np.uint64(turn + 1)) >> np.uint64(11)).astype(float)
            race = np.log((u + 0.5) / (1 << 53)) / (far + 1e-12)  # the largest is a draw by weight
            order = np.lexsort((race, model))
            best = order[np.flatnonzero(np.diff(model[order], append=-1))]
            rest = batch.take(pa.array(best))
            yield pa.RecordBatch.from_arrays([pa.array(model[best]), pa.array(race[best]), *(rest.column(c) for c in ("draw", "lang", "words", "times"))], names=["model", "race", "draw", "lang", "words", "times"])

    return run


class Topics:
    """Weights (topic, model and word) of one model for each language that has its own, the first for all others."""

    def __init__(self, langs: list[str], weights: np.ndarray):
        self.langs, self.weights = langs, weights
        self.names = np.array([*(f"topic{k}" for k in range(len(weights))), "none"], object)

    @classmethod
    def fit(cls, docs: DataFrame, topics: int = TOPICS, rounds: int = 15) -> Topics:
        """Spherical k-means on the tf-idf of all texts of docs (id, text, lang), all models at once."""
        spark = docs.sparkSession
        rows = docs.where("text is not null").select("lang", F.xxhash64("id", "text").alias("draw"), "text")
        counts, path = staging.written(rows.mapInArrow(_counted, "lang string, draw long, words binary, times binary"), "topic-words")
        # a task passes on sums for every place, so there are no more tasks than can be run at once
        counts = counts.coalesce(spark.sparkContext.defaultParallelism)
        own = counts.where("lang is not null").groupBy("lang").count().where(F.col("count") >= LEAST_TEXTS)
        own = own.orderBy(F.desc("count"), "lang").limit(FITTED).collect()
        langs = [r.lang for r in own]
        places = (len(langs) + 1) << BITS
        sizes = np.array([counts.count() - sum(r["count"] for r in own), *(r["count"] for r in own)], float)

        def sent(idf: np.ndarray | None, centres: np.ndarray | None):
            return spark.sparkContext.broadcast((langs, idf, centres))

        def summed(idf: np.ndarray | None, centres: np.ndarray | None) -> np.ndarray:
            state = sent(idf, centres)
            out = sums_by_block.total(counts, _bucket_sums(state), places * (1 if centres is None else len(centres)))
            state.destroy()
            return out

        df = summed(None, None)
        idf = (np.log(np.repeat(sizes, 1 << BITS).clip(1) / df.clip(1)) + 0.1).astype(np.float32)
        c = np.zeros((topics, places))
        for k in range(topics):  # each next centre is drawn from what is far from all before
            state = sent(idf, c[:k].astype(np.float32) if k else None)
            found = counts.mapInArrow(_drawn(state, k), "model long, race double, draw long, lang string, words binary, times binary")
            found = found.groupBy("model").agg(F.max_by(F.struct("lang", "draw", "words", "times"), F.struct("race", "draw")).alias("r")).select("r.*").toArrow()
            state.destroy()
            for _, _, _, at, value in _vectors(iter(found.to_batches()), langs, idf):
                c[k, at] = value
        for _ in range(rounds):
            new = summed(idf, c.astype(np.float32)).reshape(topics, -1, 1 << BITS)
            size = np.sqrt((new * new).sum(2, keepdims=True))
            new = np.where(size > 0, new / np.maximum(size, 1e-12), c.reshape(new.shape)).reshape(c.shape)
            same = np.allclose(new, c, atol=1e-6)
            c = new
            if same:
                break
        staging.discard(spark, path)
        textvec.tidy()
        return cls(langs, (c * idf).astype(np.float32))

    def of(self, h: np.ndarray, w: textvec.Words, langs: list[str | None]) -> np.ndarray:
        """The topic of each text of a chunk; "none" without words."""
        full = np.flatnonzero(np.diff(w.first))
        out = np.full(len(langs), -1)
        if len(full):
            number = {lang: i + 1 for i, lang in enumerate(self.langs)}
            model = np.array([number.get(lang, 0) for lang in langs])
            at = h + (model[w.docs] << BITS)
            out[full] = np.stack([np.add.reduceat(k[at], w.first[:-1][full], dtype=np.float64) for k in self.weights]).argmax(0)
        return self.names[out]


def _measure(sent, text_at: int, lang_at: int, keep_text: bool) -> Callable:
    """Arrow function: rows with tokens and topic (a null one where a topic column is given)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        topics = sent.value
        for batch in batches:
            kept = [i for i in range(batch.num_columns) if keep_text or i != text_at]
            for a, b, raw, offsets in textvec.chunks(batch.column(text_at)):
                h, w = word_buckets(raw, offsets)
                langs = batch.column(lang_at)[a:b].cast(pa.string()).to_pylist() if lang_at >= 0 else [None] * (b - a)
                topic = pa.array(topics.of(h, w, langs), pa.string()) if topics is not None else pa.nulls(b - a, pa.string())
                yield pa.RecordBatch.from_arrays(
                    [*(batch.column(i)[a:b] for i in kept), pa.array(np.diff(w.first)), topic],
                    names=[*(batch.schema.names[i] for i in kept), "m_tokens", "m_topic"],
                )

    return run


def rake(sums: Sums, targets: list[np.ndarray], total: float, share: float | None = None, rounds: int = ROUNDS, tolerance: float = TOLERANCE) -> tuple[list[np.ndarray], float]:
    """(a factor for each value, the largest miss of a target) by iterative proportional fitting.

    ``sums`` gives the weighted mass by the values of one dimension, for factors and for a share: without one, a cell's
    weight is the product of its factors; with one, min(1, share * product) / share.
    """
    factors = [np.ones(len(t)) for t in targets]

    def shares(i: int) -> np.ndarray:
        return sums(i, factors, share) / (total or 1.0)

    for _ in range(rounds):
        worst = 0.0
        for i, target in enumerate(targets):
            now = shares(i)
            worst = max(worst, float(np.abs(now - target).max(initial=0.0)))
            factors[i] = factors[i] * np.where(now > 0, target / np.where(now > 0, now, 1), 1.0)
        if worst < tolerance:
            return factors, worst
    return factors, max(float(np.abs(shares(i) - t).max(initial=0.0)) for i, t in enumerate(targets))


def capped_share(sums: Sums, targets: list[np.ndarray], total: float, least: float, close: float = CLOSE) -> tuple[float, list[np.ndarray], float]:
    """(share, factors, miss): the largest share of mass that can be kept with targets met within ``close``."""
    ones = [np.ones(len(t)) for t in targets]
    most = 1.0
    for i, t in enumerate(targets):
        there = sums(i, ones, None) / (total or 1.0)
        most = min([most, *(there[t > 0] / t[t > 0])])  # no value can give more than it has
    best = (least, *rake(sums, targets, total, least))
    if most <= least:
        return best
    low, high = least, most
    for k in range(HALVINGS + 1):
        share = high if k == 0 else (low + high) / 2
        factors, miss = rake(sums, targets, total, share, ROUNDS, close / 10)
        if miss <= close:
            best, low = (share, factors, miss), share
            if k == 0:
                break
        else:
            high = share
    return best


def _products(columns: list[np.ndarray], factors: list[np.ndarray], share: float | None) -> np.ndarray:
    w = np.ones(len(columns[0]) if columns else 0)
    for c, f in zip(columns, factors, strict=True):
        w *= f[c]
    return w if share is None else np.minimum(1.0, share * w) / share


def sums_here(mass: np.ndarray, codes: list[np.ndarray]) -> Sums:
    """Over cells on the driver."""
    return lambda i, factors, share: np.bincount(codes[i], mass * _products(codes, factors, share), len(factors[i]))


def _marginal(sent, at: int, size: int, share: float | None) -> Callable:
    """Arrow function: cells to weighted mass by the values of one dimension."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        factors, sums = sent.value, np.zeros(size)
        for batch in batches:
            codes = [batch.column(f"k{i}").to_numpy() for i in range(len(factors))]
            sums += np.bincount(codes[at], batch.column("mass").to_numpy() * _products(codes, factors, share), size)
        code = np.flatnonzero(sums)
        yield pa.RecordBatch.from_arrays([pa.array(code), pa.array(sums[code])], names=["code", "mass"])

    return run


def sums_there(cells: DataFrame) -> Sums:
    """Over a table of cells (k0, k1, ..., mass)."""
    context = cells.sparkSession.sparkContext

    def sums(i: int, factors: list[np.ndarray], share: float | None) -> np.ndarray:
        sent = context.broadcast(factors)
        got = cells.mapInArrow(_marginal(sent, i, len(factors[i]), share), "code long, mass double").groupBy("code").agg(F.sum("mass").alias("mass")).toArrow()
        sent.unpersist()
        out = np.zeros(len(factors[i]))
        out[got["code"].to_numpy()] = got["mass"].to_numpy()
        return out

    return sums


def value_table(cells: DataFrame, dim: str, given: dict | None, temper: float) -> DataFrame:
    """(value, code, share): every value of a dimension, numbered, with its target share of mass."""
    spark = cells.sparkSession
    seen = cells.groupBy(F.col(dim).alias("value")).agg(F.sum("mass").alias("m"))
    if given is None:
        raised = seen.withColumn("m", F.when(F.col("m") > 0, F.pow(F.col("m").cast("double"), F.lit(temper))).otherwise(0.0))
        shared = raised.crossJoin(raised.agg(F.sum("m").alias("all"))).select("value", F.coalesce(F.try_divide("m", "all"), F.lit(0.0)).alias("share"))  # one row
    else:
        asked = spark.createDataFrame([(None if k is None else str(k), float(v)) for k, v in given.items()], "asked string, goal double")
        both = seen.join(F.broadcast(asked), F.col("value").eqNullSafe(F.col("asked")), "left").withColumn("goal", F.when(F.col("m") > 0, F.col("goal")))
        rest = F.when(F.col("goal").isNull(), F.col("m")).otherwise(0)
        sums = both.agg(F.coalesce(F.sum("goal"), F.lit(0.0)).alias("given"), F.sum(rest).cast("double").alias("rest")).select(
            F.when(F.col("rest") > 0, F.greatest(F.lit(0.0), 1 - F.col("given"))).otherwise(0.0).alias("left"), "given", "rest"
        )
        both = both.crossJoin(sums)  # one row
        shared = both.select("value", F.coalesce(F.try_divide(F.coalesce("goal", F.col("left") * F.try_divide(F.col("m").cast("double"), F.col("rest"))), F.col("given") + F.col("left")), F.lit(0.0)).alias("share"))
    numbered = Ordered(staging.stage(shared, "values"), ["value"]).number("code", 0)
    return staging.stage(numbered.select("value", "code", "share"), "codes")


def mix(
    docs: DataFrame,
    targets: dict[str, dict] | None = None,
    columns: tuple[str, ...] = ("source", "lang"),
    topic_col: str | None = None,
    lang_col: str = "lang",
    id_col: str = "doc_id",
    text_col: str = "text",
    keep_share: float | None = None,
    capped: bool = False,
    temper: float = TEMPER,
    seed: int = 17,
    prefix: str = "mix_",
    with_text: bool = True,
    driver_cells: int = DRIVER_CELLS,
) -> DataFrame:
    """Columns of ``docs`` with topic, n_tokens, weight, prob and kept, each behind ``prefix``.

    ``targets`` maps source, lang or topic columns (the topic's name is "topic") to shares of tokens; a marginal that
    isn't given is the observed one raised to ``temper``, which evens out large sources without inventing numbers.
    ``topic_col`` names a column of docs to be used in place of topics by clusters of words. ``with_text`` is for
    results that need the text: they measure it a second time, others are made from the first pass alone.
    """
    spark = docs.sparkSession
    staging.ship(spark)
    topics = None
    if topic_col is None:
        lang = F.col(lang_col).cast("string") if lang_col in docs.columns else F.lit(None).cast("string")
        topics = Topics.fit(docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), lang.alias("lang")))
    sent = spark.sparkContext.broadcast(topics)
    names = [f"c{i}" for i in range(len(docs.columns))]
    at = lambda c: F.col(names[docs.columns.index(c)])
    text_at, lang_at = docs.columns.index(text_col), docs.columns.index(lang_col) if lang_col in docs.columns else -1

    def measured(keep_text: bool) -> DataFrame:
        plain = docs.toDF(*names).withColumn("m_key", F.coalesce(F.xxhash64(at(id_col), F.lit(seed)), F.lit(0)))
        plain = plain.withColumn("m_key", F.when(at(id_col).isNull(), F.xxhash64(at(text_col), F.lit(seed))).otherwise(F.col("m_key")))
        kept = [f for i, f in enumerate(plain.schema.fields) if keep_text or i != text_at]
        schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in kept) + ", m_tokens long, m_topic string"
        rows = plain.mapInArrow(_measure(sent, text_at, lang_at, keep_text), schema)
        topic = at(topic_col).cast("string") if topic_col else F.col("m_topic")
        dims = {f"dim{i}": at(c).cast("string") for i, c in enumerate(columns)}
        return rows.withColumns(dims | {f"dim{len(columns)}": topic})

    dims, labels = [f"dim{i}" for i in range(len(columns) + 1)], [*columns, "topic"]
    narrow = staging.stage(measured(False), "measured")
    cells = staging.stage(narrow.groupBy(*dims).agg(F.sum("m_tokens").alias("mass")), "mix")
    shares, coded = [], cells.withColumn("mass", F.col("mass").cast("double"))
    for i, (d, label) in enumerate(zip(dims, labels, strict=True)):
        table = value_table(cells, d, (targets or {}).get(label), temper)
        n = table.count()
        if n > MAX_VALUES:
            raise ValueError(f"{label} has {n} values; factors are kept for {MAX_VALUES} at most")
        own = table.select("code", "share").toArrow()
        share = np.zeros(n)
        share[own["code"].to_numpy()] = own["share"].to_numpy()
        shares.append(share)
        numbers = table.select(F.col("value").alias(f"v{i}"), F.col("code").alias(f"k{i}"))
        coded = coded.join(F.broadcast(numbers) if n <= BROADCAST_VALUES else numbers, F.col(d).eqNullSafe(F.col(f"v{i}"))).drop(f"v{i}")
    coded = staging.stage(coded, "cells")
    codes = [f"k{i}" for i in range(len(dims))]
    few = coded.count() <= driver_cells
    total = coded.agg(F.sum("mass")).first()[0] or 0.0
    if few:
        got = coded.select(*codes, "mass").toArrow()
        sums = sums_here(got["mass"].to_numpy(), [got[k].to_numpy() for k in codes])
    else:
        sums = sums_there(coded)
    factors, miss = rake(sums, shares, total)
    sent_factors = spark.sparkContext.broadcast(factors)

    def weighted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            w = _products([batch.column(k).to_numpy() for k in codes], sent_factors.value, None)
            yield pa.RecordBatch.from_arrays([*(batch.column(d) for d in dims), pa.array(w)], names=[*dims, "w"])

    schema = ", ".join(f"{d} string" for d in dims) + ", w double"
    fitted = coded.mapInArrow(weighted, schema)
    most = fitted.agg(F.max("w")).first()[0] or 1.0
    # the mean weight over tokens is one, so with weight * share as probability that share of tokens is kept
    scale = 1 / most if keep_share is None else min(keep_share, 1.0)
    if capped and total:
        scale, factors, miss = capped_share(sums, shares, total, 1 / most)
        sent_factors = spark.sparkContext.broadcast(factors)
        fitted = coded.mapInArrow(weighted, schema)
    if total and miss > (CLOSE if capped else TOLERANCE):
        warnings.warn(f"mix: after {ROUNDS} rounds shares of tokens miss their targets by up to {miss:.3g}", stacklevel=2)
    fitted = staging.stage(fitted, "weights")
    right = fitted.select(*(F.col(d).alias(f"to_{d}") for d in dims), "w")
    same = [F.col(d).eqNullSafe(F.col(f"to_{d}")) for d in dims]
    rows = (measured(True) if with_text else narrow).join(F.broadcast(right) if few else right, same, "left")
    chance = F.pmod(F.xxhash64("m_key"), F.lit(1 << 40)) / float(1 << 40)
    prob = F.least(F.lit(1.0), F.coalesce("w", F.lit(1.0)) * scale)
    out = {"topic": F.col(dims[-1]), "n_tokens": F.col("m_tokens"), "weight": F.col("w"), "prob": prob, "kept": chance < prob}
    given = [(n, c) for n, c in zip(names, docs.columns, strict=True) if with_text or c != text_col]
    return rows.select(*(F.col(n).alias(c) for n, c in given), *(v.alias(prefix + k) for k, v in out.items()))
