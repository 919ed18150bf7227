"""Weakly supervised quality: rules vote or abstain, expectation-maximisation learns how far to trust each rule.

Edge cases: a null or empty text has no words, so ``base_failed`` is true and it isn't kept; ties and repeated
rows are scored row by row; null ids pass through; an empty table gives an empty result; columns of the input
other than the id and the text are ignored, so their names can't clash. A very long text is handled whole.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import staging, textvec

WINDOW = 8
MIN_WORDS = 20
MAX_REPEAT_PERCENT = 30
_SYMBOL = np.zeros(256, bool)
_SYMBOL[[ord(c) for c in "#*$%&|<>"]] = True
_UPPER = np.zeros(256, bool)
_UPPER[65:91] = True
_LETTER = np.zeros(256, bool)
_LETTER[65:91] = _LETTER[97:123] = True
_LETTER[128:] = True
_CONTINUATION = (np.arange(256) & 0xC0) == 0x80

#: Rules that vote bad when their value is over (sign 1) or under (sign -1) a bound, and else abstain.
BAD: dict[str, tuple[int, float]] = {
    "symbols_per_word": (1, 0.35),
    "upper_share": (1, 0.5),
    "shout_share": (1, 0.2),
    "pipe_share": (1, 0.1),
    "dup_line_share": (1, 0.45),
    "repeat_share": (1, 0.3),
    "echo_share": (1, 0.3),
    "long_words": (1, 11.0),
    "short_words": (-1, 2.5),
    "distinct_share": (-1, 0.2),
}
#: Rules that vote good when all their values are under their bounds (over, where the bound is negative).
GOOD: dict[str, dict[str, float]] = {
    "plain": {"symbols_per_word": 0.05, "upper_share": 0.2, "shout_share": 0.02, "pipe_share": 0.02},
    "sentences": {"stop_share": -0.02, "repeat_share": 0.3, "echo_share": 0.3},
}
RULES = (*BAD, *GOOD)


def text_measures(raw: np.ndarray, offsets: np.ndarray) -> dict[str, np.ndarray]:
    """Exact measures of each whole text of a chunk."""
    n = len(offsets) - 1
    w = textvec.words(raw, offsets)
    hasher = textvec.Hasher.of(raw)
    n_words = np.diff(w.first)
    lead = ~_CONTINUATION[raw]
    word_chars = textvec.per_text(lead & ~textvec.SPACE[raw], offsets)
    # lines: between breaks and text ends
    breaks = np.flatnonzero(raw == 10)
    starts = np.sort(np.concatenate([offsets[:-1], breaks + 1]), kind="stable")
    ends = np.sort(np.concatenate([offsets[1:], breaks]), kind="stable")
    has_word = np.searchsorted(w.starts, ends) > np.searchsorted(w.starts, starts)
    starts, ends = starts[has_word], ends[has_word]
    line_doc = np.searchsorted(offsets, starts, "right") - 1
    n_lines = np.bincount(line_doc, minlength=n)
    salt = textvec.mix(np.arange(1, n + 1, dtype=np.uint64))
    _, at = np.unique(hasher.ranges(starts, ends) ^ salt[line_doc], return_index=True)
    n_dup_lines = n_lines - np.bincount(line_doc[at], minlength=n)
    # words in windows found again in the same text
    hashes = hasher.ranges(w.starts, w.ends)
    win, at = textvec.windows(hashes, w.first, WINDOW)
    docs = w.docs
    key = win ^ salt[docs[at]] if len(at) else win
    order = np.argsort(key)
    k = key[order]
    again = np.zeros(len(k), bool)
    if len(k) > 1:
        same = k[1:] == k[:-1]
        again[1:] |= same
        again[:-1] |= same
    hit = at[order[again]]
    cover = np.zeros(len(hashes) + 1, np.int64)
    np.add.at(cover, hit, 1)
    np.add.at(cover, hit + WINDOW, -1)
    n_repeat = textvec.per_text(np.cumsum(cover[:-1]) > 0, w.first)
    seen = np.unique(hashes ^ salt[docs], return_index=True)[1] if len(hashes) else np.zeros(0, np.int64)
    n_distinct = np.bincount(docs[seen], minlength=n)
    echo = np.zeros(len(hashes), bool)
    echo[1:] = (hashes[1:] == hashes[:-1]) & (docs[1:] == docs[:-1])
    last = raw[w.ends - 1] if len(w.ends) else np.zeros(0, np.uint8)
    stops = ((last == ord(".")) | (last == ord(","))) & _LETTER[raw[np.maximum(w.ends - 2, 0)]]
    shout = (last == ord("!")) & (raw[np.maximum(w.ends - 2, 0)] == ord("!"))
    return {
        "n_words": n_words,
        "word_chars": word_chars,
        "n_symbols": textvec.per_text(_SYMBOL[raw], offsets),
        "n_dup_lines": n_dup_lines,
        "n_repeat_words": n_repeat,
        "n_lines": n_lines,
        "n_upper": textvec.per_text(_UPPER[raw], offsets),
        "n_letters": textvec.per_text(_LETTER[raw] & lead, offsets),
        "n_shout": textvec.per_text(shout, w.first),
        "n_echo": textvec.per_text(echo, w.first),
        "n_stop": textvec.per_text(stops, w.first),
        "n_pipe": textvec.per_text(raw == ord("|"), offsets),
        "n_distinct": n_distinct,
    }


def rule_values(m: dict[str, np.ndarray]) -> dict[str, np.ndarray]:
    per = lambda a, b: m[a] / np.maximum(m[b], 1)
    return {
        "symbols_per_word": per("n_symbols", "n_words"),
        "upper_share": per("n_upper", "n_letters"),
        "shout_share": per("n_shout", "n_words"),
        "dup_line_share": per("n_dup_lines", "n_lines"),
        "repeat_share": per("n_repeat_words", "n_words"),
        "long_words": per("word_chars", "n_words"),
        "short_words": np.where(m["n_words"] > 0, per("word_chars", "n_words"), 3.0),
        "pipe_share": per("n_pipe", "n_words"),
        "echo_share": per("n_echo", "n_words"),
        "stop_share": per("n_stop", "n_words"),
        "distinct_share": np.where(m["n_words"] >= 60, per("n_distinct", "n_words") * np.sqrt(np.maximum(m["n_words"], 1) / 60), 1.0),
    }


def votes(m: dict[str, np.ndarray]) -> np.ndarray:
    """One base-3 digit a rule (0 abstain, 1 good, 2 bad), packed into one number a text."""
    code = np.zeros(len(m["n_words"]), np.int64)
    value = rule_values(m)
    for name, (sign, bound) in BAD.items():
        code = code * 3 + 2 * (sign * value[name] > sign * bound)
    for bounds in GOOD.values():
        good = m["n_words"] > 0
        for name, bound in bounds.items():
            good &= value[name] < bound if bound >= 0 else value[name] > -bound
        code = code * 3 + good
    return code


_OUT = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]


def _measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for a, b, raw, offsets in textvec.chunks(batch.column(1)):
            m = text_measures(raw, offsets)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0)[a:b], *(pa.array(m[k].astype(np.int64)) for k in _OUT), pa.array(votes(m))],
                names=["id", *_OUT, "votes"],
            )


def fit(patterns: list[tuple[int, int]], rules: int, rounds: int = 200) -> dict[int, float]:
    """Posterior probability of good quality for each vote pattern, by expectation-maximisation.

    Two latent classes; each rule has, in each class, its own chances to vote good, to vote bad and to abstain, which
    give its accuracy and reach. Starts from the votes: bad where any rule says so and none says good. ``patterns``
    are (packed votes, number of texts): at most 3**rules of them, whatever the number of texts.
    """
    if not patterns:
        return {}
    codes = np.array([p for p, _ in patterns], np.int64)
    weight = np.array([c for _, c in patterns], float)
    digits = np.stack([codes // 3 ** (rules - 1 - k) % 3 for k in range(rules)], 1)
    cast = np.stack([digits == v for v in range(3)], 2).astype(float)  # (pattern, rule, vote)
    n_good, n_bad = (digits == 1).sum(1), (digits == 2).sum(1)
    post = np.where(n_bad == 0, 0.95, np.where(n_good == 0, 0.02, 0.6))
    for _ in range(rounds):
        share = np.clip((weight * post).sum() / weight.sum(), 0.05, 0.99)
        log = np.full(len(codes), np.log(share / (1 - share)))
        for sign, p in ((1, post), (-1, 1 - post)):
            chance = np.einsum("i,irv->rv", weight * p, cast) + 0.1
            chance /= chance.sum(1, keepdims=True)
            log += sign * np.einsum("irv,rv->i", cast, np.log(chance))
        new = 1 / (1 + np.exp(-np.clip(log, -40, 40)))
        done = np.abs(new - post).max() < 1e-7
        post = new
        if done:
            break
    return dict(zip(codes.tolist(), post.tolist(), strict=True))


def quality_rules(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = 0.5) -> DataFrame:
    """Measures, base verdict, posterior quality and verdict of every row of ``docs``.

    Two passes over a table of seven numbers a text (staged once): counts of vote patterns, bounded by the number
    of rules and not by the data, go to the driver for the fit; the posteriors come back as a map of that size.
    """
    spark = docs.sparkSession
    staging.ship(spark)
    kind = docs.schema[id_col].dataType.simpleString()
    schema = f"id {kind}, " + ", ".join(f"{k} long" for k in [*_OUT, "votes"])
    table = staging.stage(docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInArrow(_measure, schema), "quality")
    seen = [(r.votes, r.n) for r in table.groupBy("votes").agg(F.count("*").alias("n")).collect()]
    posterior = fit(seen, len(RULES))
    known = spark.createDataFrame(list(posterior.items()), "votes long, posterior double")
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words"))
    return (
        table.join(F.broadcast(known), "votes", "left")
        .withColumn("base_failed", failed)
        .withColumn("kept", ~F.col("base_failed") & (F.coalesce("posterior", F.lit(0.0)) >= threshold))
        .select(F.col("id").alias(id_col), *_OUT, "base_failed", "kept", "posterior", "votes")
    )
