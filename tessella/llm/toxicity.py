"""Toxicity: a sparse logistic classifier regularised on counterfactual pairs.

Features are the presence of words and of word beginnings, hashed. Terms of identity are the group names of IDENTITY and
what the training texts themselves write like names (``proper_names``). For every training text that holds such terms,
every mention in the whole text is swapped for another term of its kind; for every other, a group's name is put before
one of its sentences. The change of the score is penalised, and features of these terms always have a weight to
penalise, so that a mention of any of them weighs like that of any other and, by itself, next to nothing.
``score_change`` tells by how much scores of such pairs differ.

The model is fitted on all labelled rows: features are counted, names found and pairs made by tasks, and of a text only
the numbers of its useful features are kept. Up to DRIVER_FEATURES of these the driver takes the steps on them by
itself; beyond that each step is a job over their table, which gives the driver one sum a feature. Weights are one array
of 2**BITS numbers whatever the input; the names that are sent to tasks grow with the vocabulary of labelled texts.

Edge cases: a null or empty text has no feature and gets the score of the intercept alone; rows with a null id or
repeated ids are scored row by row; labels that are null are not learned from, and of labels that disagree on an id
the highest counts; without any labelled row of both classes the score is the labelled share (0 without labels);
an empty table gives an empty result; other columns are ignored. Very long texts are scored whole.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import staging, sums_by_block, textvec

BITS = 20
#: Labelled ids that are broadcast, and features of labelled texts that the driver takes; beyond both Spark has other ways.
BROADCAST_ROWS = 500_000
DRIVER_FEATURES = 6_000_000
PAIRS = 256
THRESHOLD = 0.3
PREFIXES = (4, 5, 6, 7)
#: Names of groups that are swapped for each other.
IDENTITY = "women men girls boys muslims christians jews hindus buddhists atheists immigrants refugees africans asians europeans americans mexicans arabs germans french spaniards gays lesbians bisexuals transgender straight black white disabled deaf blind elderly teenagers mujeres hombres musulmanes cristianos judíos inmigrantes femmes hommes musulmans chrétiens juifs immigrés frauen männer muslime christen juden einwanderer".split()  # noqa: E501
_BETWEEN = np.ones(256, bool)
_BETWEEN[48:58] = _BETWEEN[65:91] = _BETWEEN[97:123] = _BETWEEN[128:] = False
_BETWEEN[ord("'")] = False
_INSIDE = "[0-9A-Za-z'\x80-\U0010ffff]"  # the same borders for text
_SENTENCE = re.compile(r"[^.!?\n]*[^\W_][^.!?\n]*[.!?]*")
_WORD = re.compile(r"[^\W\d_]+")
_WITHIN = re.compile(r"(?<=[^\s.!?] )[^\W\d_]+")  # words that don't begin a sentence
_SEEN = re.compile(f"{_INSIDE}+")


def features(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(feature, text) of every word and word beginning of a chunk."""
    raw = textvec.LOWER[raw]
    w = textvec.words(raw, offsets, _BETWEEN)
    hasher = textvec.Hasher.of(raw)
    docs = w.docs
    shift = np.uint64(64 - BITS)
    out, which = [hasher.ranges(w.starts, w.ends) >> shift], [docs]
    for size in PREFIXES:
        long = np.flatnonzero(w.ends - w.starts > size)
        starts = w.starts[long]
        out.append(textvec.mix(hasher.ranges(starts, starts + size) + np.uint64(1)) >> shift)
        which.append(docs[long])
    return np.concatenate(out).astype(np.int64), np.concatenate(which)


def present(texts: pa.Array, useful: np.ndarray | None = None) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(distinct features, their texts' numbers), a chunk at a time; only useful features if told which are."""
    for a, _, raw, offsets in textvec.chunks(texts):
        f, d = features(raw, offsets)
        if useful is not None:
            keep = useful[f]
            f, d = f[keep], d[keep]
        key = np.unique(d << BITS | f)
        yield key & ((1 << BITS) - 1), (key >> BITS) + a


def gathered(texts: pa.Array, useful: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    parts = list(present(texts, useful))
    return tuple(np.concatenate([p[k] for p in parts]) if parts else np.zeros(0, np.int64) for k in (0, 1))


def written_like_names(texts: pa.Array, toxic: np.ndarray) -> tuple[Counter, set[str]]:
    """(words by texts that aren't toxic and write them with one capital within sentences, words without a capital)."""
    inside: Counter = Counter()
    small: set[str] = set()
    for text, bad in zip((t.as_py() for t in texts), toxic, strict=True):
        words = set(_WORD.findall(text))
        small.update(w for w in words if w.islower())
        if not bad:
            inside.update({w.lower() for w in words & set(_WITHIN.findall(text)) if len(w) > 2 and w[0].isupper() and w[1:].islower()})
    return inside, small


def proper_names(texts: pa.Array, toxic: np.ndarray, least: int = 3) -> list[str]:
    """Words (lower case) that texts write with one capital within sentences, and never without.

    They must be in ``least`` texts that aren't toxic: a term of abuse isn't a name.
    """
    inside, small = written_like_names(texts, toxic)
    return sorted(w for w, n in inside.items() if n >= least and w not in small)


def counterfactuals(texts: pa.Array, names: Sequence[str] = (), seed: int = 7, seeds: Sequence[int] | None = None) -> tuple[list[str], list[str]]:
    """A pair of texts for each text: whole with every term of identity swapped, else a sentence with and without one.

    With ``seeds``, one a text, a text's pair doesn't depend on what is before it.
    """
    rnd = np.random.default_rng(seed)
    groups = set(IDENTITY)
    kinds = [kind for kind in (IDENTITY, [n for n in names if n not in groups]) if len(kind) > 1]
    kind_of = {n: kind for kind in kinds for n in kind}
    # a term stands alone or before 's, like the words that features() sees
    named = re.compile(f"(?<!{_INSIDE})({_INSIDE}+?)(?='s(?!{_INSIDE})|(?!{_INSIDE}))")
    left, right = [], []

    def other(name: str) -> str:
        kind = kind_of[name]
        at = int(rnd.integers(len(kind) - 1))
        return kind[at] if kind[at] != name else kind[-1]

    for i, text in enumerate(t.as_py() for t in texts):
        if seeds is not None:
            rnd = np.random.default_rng(seeds[i])
        swap: dict[str, str] = {}

        def put(m: re.Match, swap: dict[str, str] = swap) -> str:
            name = m[1].lower()
            if name in kind_of and name not in swap:
                swap[name] = other(name)
            return swap.get(name, m[1])

        low = text.lower()
        some = not kind_of.keys().isdisjoint(_SEEN.findall(low)) or "'s" in low
        changed = named.sub(put, text) if some else text
        if swap:
            left.append(text)
            right.append(changed)
        else:
            sentences = _SENTENCE.findall(text) or [""]
            sentence = sentences[int(rnd.integers(len(sentences)))].strip()
            left.append(f"{IDENTITY[int(rnd.integers(len(IDENTITY)))]} {sentence}")
            right.append(sentence)
    return left, right


def term_features(terms: Sequence[str]) -> np.ndarray:
    """A flag for each feature: whether one of these terms, alone or before 's, has it."""
    flags = np.zeros(1 << BITS, bool)
    for f, _ in present(pa.array([t + end for t in terms for end in ("", "'s")], pa.string())):
        flags[f] = True
    return flags


def score_change(pairs: tuple[list[str], list[str]], weights: np.ndarray, intercept: float) -> float:
    """The mean difference between the scores of a pair's two texts."""
    a, b = (score_texts(pa.array(side, pa.string()), weights, intercept) for side in pairs)
    return float(np.abs(a - b).mean()) if len(a) else 0.0


def useful_features(df: np.ndarray, hot: np.ndarray, n: int, share: float) -> np.ndarray:
    """Flags; features too rare to carry over, or about as frequent in either class, get no weight."""
    lift = (hot + 0.5 * share) / (df + 0.5) / share
    return (df >= 3) & ((lift > 2) | (lift < 0.3) & (df > 0.002 * n))


def pair_differences(pairs: tuple[list[str], list[str]], identity: np.ndarray) -> list[np.ndarray]:
    """row << BITS | feature of what only the first, and only the second, text of each pair holds.

    Only features of terms of identity can differ within a pair.
    """
    sides = [r << BITS | c for c, r in (gathered(pa.array(side, pa.string()), identity) for side in pairs)]
    return [np.setdiff1d(sides[i], sides[1 - i], assume_unique=True) for i in (0, 1)]


class Examples:
    """Useful features of texts, by number, and the differences of their pairs."""

    def __init__(self, k: int, columns: np.ndarray, row: np.ndarray, only: Sequence[tuple[np.ndarray, np.ndarray]], toxic: np.ndarray):
        """``only`` are the columns and rows of what the first and the second text of pairs hold alone."""
        self.k, self.columns, self.row, self.toxic = k, columns, row, toxic
        self.d_col, self.d_row = (np.concatenate([x[i] for x in only]) for i in (0, 1))
        self.d_val = np.repeat([1.0, -1.0], [len(x[0]) for x in only])

    def sums(self, w: np.ndarray, b: float, curved: bool, fairness: float) -> np.ndarray:
        """Over texts, for each feature and then the intercept: slopes of the loss at w and b, or, ``curved``, an upper
        bound of its second derivative times (w, b)."""
        n, k = len(self.toxic), self.k
        z = np.bincount(self.row, w[self.columns], n) + b
        g = z / 4 if curved else 1 / (1 + np.exp(-np.clip(z, -40, 40))) - self.toxic
        change = np.bincount(self.d_row, self.d_val * w[self.d_col], n)
        own = np.bincount(self.columns, g[self.row], k) + fairness * np.bincount(self.d_col, self.d_val * change[self.d_row], k)
        return np.append(own, g.sum())


def descend(sums: Callable, n: int, share: float, counts: np.ndarray, l1: float, l2: float, steps: int) -> tuple[np.ndarray, float]:
    """(a weight for each useful feature, intercept); ``sums`` as in Examples, ``counts`` are the features' texts."""
    k = len(counts)
    w, b = np.zeros(k), float(np.log(share / (1 - share)))
    scale = 1 / np.sqrt(np.maximum(counts, 1) / n)  # rare features learn as fast
    scale = np.minimum(scale, 30)
    v = np.ones(k + 1)
    for _ in range(20):
        v /= np.linalg.norm(v)
        s = sums(v[:-1] * scale, v[-1], True) / n
        v = np.append(s[:-1] * scale + l2 * v[:-1], s[-1])
    step = 0.9 / np.linalg.norm(v)
    momentum, mb, t = w.copy(), b, 1.0
    for _ in range(steps):
        s = sums(momentum * scale, mb, False) / n
        new = momentum - step * (s[:-1] * scale + l2 * momentum)
        new = np.sign(new) * np.maximum(np.abs(new) - step * l1, 0)
        nb = mb - step * s[-1]
        if ((momentum - new) * (new - w)).sum() > 0:  # restart where momentum works against the gradient
            t = 1.0
        t2 = (1 + np.sqrt(1 + 4 * t * t)) / 2
        momentum, mb = new + (t - 1) / t2 * (new - w), nb + (t - 1) / t2 * (nb - b)
        w, b, t = new, nb, t2
    return w * scale, float(b)


def fit(texts: pa.Array, toxic: np.ndarray, l1: float = 1e-3, l2: float = 1e-5, fairness: float = 1.0, steps: int = 300) -> tuple[np.ndarray, float]:
    """(weights, intercept) by accelerated proximal gradient on log loss, elastic net and counterfactual penalty."""
    weights, n = np.zeros(1 << BITS, np.float32), len(texts)
    share = float(toxic.mean()) if n else 0.0
    if n == 0 or share in (0.0, 1.0):
        return weights, float(np.log(max(share, 1e-6) / max(1 - share, 1e-6)))
    df, hot = np.zeros(1 << BITS), np.zeros(1 << BITS)
    for f, d in present(texts):
        df += np.bincount(f, minlength=1 << BITS)
        hot += np.bincount(f, toxic[d], 1 << BITS)
    names = proper_names(texts, toxic)
    identity = term_features([*IDENTITY, *names])
    useful = useful_features(df, hot, n, share) | identity
    number = np.cumsum(useful) - 1
    columns, row = gathered(texts, useful)
    # pairs are made and read a few hundred at a time
    parts = [pair_differences(counterfactuals(texts.slice(at, PAIRS), names, at), identity) for at in range(0, n, PAIRS)]
    only = []
    for i in (0, 1):
        both = np.concatenate([x[i] + (at * PAIRS << BITS) for at, x in enumerate(parts)])
        only.append((number[both & ((1 << BITS) - 1)], both >> BITS))
    rows = Examples(int(useful.sum()), number[columns], row, only, toxic)
    w, b = descend(lambda v, b, curved: rows.sums(v, b, curved, fairness), n, share, df[useful], l1, l2, steps)
    weights[np.flatnonzero(useful)] = w
    return weights, b


def _feature_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Texts, and toxic ones, that hold each feature."""
    out = np.zeros((2, 1 << BITS))
    for batch in batches:
        toxic = batch.column("toxic").to_numpy().astype(float)
        for f, d in present(batch.column("text")):
            out[0] += np.bincount(f, minlength=1 << BITS)
            out[1] += np.bincount(f, toxic[d], 1 << BITS)
    yield from sums_by_block.sent(out.ravel())


def _names(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(word, texts that write it like a name, whether one writes it small)."""
    for batch in batches:
        for at in range(0, len(batch), PAIRS):
            part = batch.slice(at, PAIRS)
            inside, small = written_like_names(part.column("text"), part.column("toxic").to_numpy())
            words = [*(inside.keys() | small)]
            yield pa.RecordBatch.from_arrays([pa.array(words, pa.string()), pa.array([inside[w] for w in words], pa.int64()), pa.array([w in small for w in words], pa.bool_())], names=["word", "inside", "small"])


def _lists(numbers: np.ndarray, row: np.ndarray, n: int) -> pa.Array:
    """Numbers, in the order of their rows, as a list for each row."""
    ends = np.searchsorted(row, np.arange(n + 1))
    return pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.array(numbers.astype(np.int32)))


def _examples(sent) -> Callable:
    """Arrow function: labelled texts to numbers of their useful features, and what their pairs' texts hold alone."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        useful, identity, names = sent.value
        number = np.cumsum(useful) - 1
        for whole in batches:
            for at in range(0, len(whole), PAIRS):
                batch = whole.slice(at, PAIRS)
                texts, n = batch.column("text"), len(batch)
                columns, row = gathered(texts, useful)
                pairs = counterfactuals(texts, names, seeds=batch.column("seed").to_numpy().view(np.uint64).tolist())
                only = pair_differences(pairs, identity)
                lists = [_lists(number[columns], row, n), *(_lists(number[x & ((1 << BITS) - 1)], x >> BITS, n) for x in only)]
                yield pa.RecordBatch.from_arrays([batch.column("seed"), batch.column("toxic"), *lists], names=["seed", "toxic", "has", "left", "right"])

    return run


def _read(rows: pa.RecordBatch | pa.Table, k: int) -> Examples:
    toxic, parts = rows.column("toxic").to_numpy().astype(float), []
    for name in ("has", "left", "right"):
        x = rows.column(name)
        x = x.combine_chunks() if isinstance(x, pa.ChunkedArray) else x
        size = x.value_lengths().to_numpy(zero_copy_only=False)
        parts.append((x.flatten().to_numpy(), np.repeat(np.arange(len(x), dtype=np.int32), size)))
    return Examples(k, *parts[0], parts[1:], toxic)


def _step_sums(sent, k: int, curved: bool, fairness: float, unit: float) -> Callable:
    """Arrow function: examples to their sums, in whole units, so that these don't depend on the order of tasks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        w, b = sent.value
        out = np.zeros(k + 1)
        for batch in batches:
            out += _read(batch, k).sums(w, b, curved, fairness)
        yield from sums_by_block.sent(np.rint(out * unit))

    return run


def score_texts(texts: pa.Array, weights: np.ndarray, intercept: float) -> np.ndarray:
    z = np.full(len(texts), intercept)
    for a, b, raw, offsets in textvec.chunks(texts):
        f, d = features(raw, offsets)
        use = np.flatnonzero(weights[f])
        key = np.unique(d[use] << BITS | f[use])
        z[a:b] += np.bincount(key >> BITS, weights[key & ((1 << BITS) - 1)], b - a)
    return 1 / (1 + np.exp(-np.clip(z, -40, 40)))


def _scorer(model, intercept: float, text_at: int) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            s = score_texts(batch.column(text_at), model.value, intercept)
            yield pa.RecordBatch.from_arrays([pa.array(s), *batch.columns], names=["score", *batch.schema.names])

    return run


def learnable(id_col) -> F.Column:
    """Rows whose labels may be learned: crc32 of the id as text, modulo 4, isn't 2."""
    return F.coalesce(F.crc32(id_col.cast("string").cast("binary")) % 4 != 2, F.lit(False))


def bounded(rows: DataFrame, max_bytes: int) -> DataFrame:
    """The rows (id, text, ...) that fit, taken by hashed id, into so many bytes of text together.

    ``rows`` are a bounded number, one an id: their sizes alone are collected. A row that doesn't fit into what is left
    is passed over, and those after it are tried.
    """
    left, fits = max_bytes, []
    for r in rows.select("id", F.octet_length("text").alias("bytes")).orderBy(F.xxhash64("id"), "id").collect():
        if r.bytes <= left:
            left -= r.bytes
            fits.append((r.id,))
    chosen = rows.sparkSession.createDataFrame(fits, rows.select("id").schema)
    return rows.join(F.broadcast(chosen), "id")


def one_an_id(rows: DataFrame) -> DataFrame:
    """Of rows (id, text, ...) that share an id, the one whose columns have the smallest hash."""
    rest = [c for c in rows.columns if c != "id"]
    best = rows.groupBy("id").agg(F.min_by(F.struct(*rest), F.xxhash64(*rest)).alias("r"))
    return best.select("id", *(F.col(f"r.{c}").alias(c) for c in rest))


def train(
    docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", l1: float = 1e-3, l2: float = 1e-5, fairness: float = 1.0, steps: int = 300, least: int = 3, driver_features: int = DRIVER_FEATURES
) -> tuple[np.ndarray, float]:
    """The model of fit() from all labelled rows that may be learned; beyond ``driver_features`` every step is a job."""
    spark = docs.sparkSession
    known = labels.select(F.col(id_col).alias("id"), F.col(label_col).cast("int").alias("toxic")).dropna()
    known = staging.stage(known.where(learnable(F.col("id"))).groupBy("id").agg(F.max("toxic").alias("toxic")), "labels")
    few = known.count() <= BROADCAST_ROWS
    texts = docs.select(F.col(id_col).alias("id"), F.coalesce(text_col, F.lit("")).alias("text")).where(learnable(F.col("id")))
    rows = one_an_id(texts.join(F.broadcast(known) if few else known, "id").select("id", "text", "toxic"))
    rows = staging.stage(rows.select(F.xxhash64("id", "text").alias("seed"), "text", "toxic"), "labelled")
    whole = rows.agg(F.count("*").alias("n"), F.coalesce(F.sum("toxic"), F.lit(0)).alias("toxic")).first()
    weights, n, share = np.zeros(1 << BITS, np.float32), whole.n, whole.toxic / max(whole.n, 1)
    if n == 0 or share in (0.0, 1.0):
        return weights, float(np.log(max(share, 1e-6) / max(1 - share, 1e-6)))
    at_once = spark.sparkContext.defaultParallelism  # a task passes on sums for every feature
    df, hot = sums_by_block.total(rows.coalesce(at_once), _feature_counts, 2 << BITS).reshape(2, -1)
    names = rows.mapInArrow(_names, "word string, inside long, small boolean").groupBy("word").agg(F.sum("inside").alias("inside"), F.max("small").alias("small"))
    names = sorted(names.where((F.col("inside") >= least) & ~F.col("small")).select("word").toArrow()["word"].to_pylist())
    identity = term_features([*IDENTITY, *names])
    useful = useful_features(df, hot, n, share) | identity
    k, counts = int(useful.sum()), df[useful]
    sent = spark.sparkContext.broadcast((useful, identity, names))
    examples = staging.stage(rows.mapInArrow(_examples(sent), "seed long, toxic int, has array<int>, left array<int>, right array<int>").sortWithinPartitions("seed"), "examples")
    if examples.agg(F.sum(F.size("has") + F.size("left") + F.size("right"))).first()[0] <= driver_features:
        here = _read(examples.toArrow().sort_by("seed"), k)
        w, b = descend(lambda v, b, curved: here.sums(v, b, curved, fairness), n, share, counts, l1, l2, steps)
        del here
    else:
        examples = examples.coalesce(at_once)

        def sums(v: np.ndarray, b: float, curved: bool) -> np.ndarray:
            most = n * (1 + (fairness + 1) * (float(np.abs(v).sum()) + abs(b)))  # no sum is larger
            unit = 2.0 ** (62 - int(np.ceil(np.log2(most))))
            state = spark.sparkContext.broadcast((v, b))
            out = sums_by_block.total(examples, _step_sums(state, k, curved, fairness, unit), k + 1) / unit
            state.destroy()
            return out

        w, b = descend(sums, n, share, counts, l1, l2, steps)
    weights[np.flatnonzero(useful)] = w
    textvec.tidy()
    return weights, b


def toxicity(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """All columns of ``docs`` with ``tox_score`` (0 to 1) and ``tox_flag`` (score at least ``threshold``)."""
    spark = docs.sparkSession
    staging.ship(spark)
    weights, intercept = train(docs, labels, id_col, text_col)
    model = spark.sparkContext.broadcast(weights)
    names = [f"c{i}" for i in range(len(docs.columns))]
    plain = docs.toDF(*names)  # clashing names of extra columns are kept out of the way
    schema = "score double, " + ", ".join(f"{n} {f.dataType.simpleString()}" for n, f in zip(names, docs.schema.fields, strict=True))
    scored = plain.mapInArrow(_scorer(model, intercept, docs.columns.index(text_col)), schema)
    return scored.select(*(F.col(n).alias(o) for n, o in zip(names, docs.columns, strict=True)), F.col("score").alias("tox_score"), (F.col("score") >= threshold).alias("tox_flag"))
