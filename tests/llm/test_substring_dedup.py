"""Removal of repeated passages against plain Python over sets of windows."""

import hashlib
import random
import re

import numpy as np
import pyarrow as pa
import pytest

from tessella.llm import staging
from tessella.llm.substring_dedup import Block, anchors, remove_repeats

WORD = re.compile(r"[^\x20\x09-\x0D]+")
SCHEMA = "doc_id long, text string, lang string, whole string, anchors string, id string, kept string"


def brute(rows, k):
    words = [(i, WORD.findall(t or "")) for i, t in rows]
    first = {}
    for i, w in words:
        if i is not None:
            for j in range(len(w) - k + 1):
                key = tuple(w[j : j + k])
                first[key] = min(first.get(key, i), i)
    out = []
    for i, w in words:
        gone = [False] * len(w)
        if i is not None:
            for j in range(len(w) - k + 1):
                if first[tuple(w[j : j + k])] < i:
                    gone[j : j + k] = [True] * k
        out.append((i, len(w), sum(gone), hashlib.sha256(" ".join(x for x, g in zip(w, gone, strict=True) if not g).encode()).hexdigest()))
    return sorted(out, key=repr)


def collected(df):
    return sorted(map(tuple, df.collect()), key=repr)


def corpus(seed):
    """Passages of many lengths between other words, chains and overlaps of them, near copies, whole copies, repetitive texts."""
    rnd = random.Random(seed)
    word = lambda: "w" + str(rnd.randint(0, 10**6))
    passages = [[word() for _ in range(rnd.randint(20, 160))] for _ in range(12)]
    rows = [(1000, None), (1001, ""), (1002, " \n"), (1003, "a b c"), (None, " ".join(passages[0]))]
    for i in range(150):
        w = []
        for _ in range(rnd.randint(0, 6)):
            p = rnd.choice(passages)
            a = rnd.randint(0, len(p) // 2)
            w += p[a : rnd.randint(a, len(p))] if rnd.random() < 0.6 else p
            w += [word() for _ in range(rnd.choice([0, 0, 0, 1, 5, 60]))]
        rows.append((i, "".join(x + rnd.choice([" ", " ", "\n", "\t ", "\x0b"]) for x in w)))
    near = [word() for _ in range(300)]
    for i in range(200, 260):
        w = list(near)
        for _ in range(rnd.randint(0, 4)):
            w[rnd.randrange(len(w))] = word()
        rows.append((i, " ".join(w)))
    rows += [(300 + i, " ".join(near)) for i in range(30)]
    rows += [(5, rows[20][1]), (7, rows[12][1]), (7, rows[12][1]), (7, rows[13][1])]  # ids that are shared
    rows += [(400 + i, " ".join(rnd.choice("ab") for _ in range(400))) for i in range(4)] + [(410 + i, "la " * (60 + 40 * i)) for i in range(4)]
    rows += [(500, " ".join(word() for _ in range(40000)) + " " + " ".join(near)), (501, "x" * 100000)]
    rnd.shuffle(rows)
    return rows


@pytest.mark.parametrize(("window", "gram", "part_words"), [(50, 16, 500_000), (12, 5, 300), (6, 6, 50), (3, 1, 10**6)])
def test_repeats_equal_brute_force(spark, window, gram, part_words):
    rows = corpus(window)
    docs = spark.createDataFrame([(i, t, "en", "w", "a", "i", "k") for i, t in rows], SCHEMA).repartition(5)
    out = remove_repeats(docs, window=window, gram=gram, part_words=part_words)
    assert out.dtypes == [("doc_id", "bigint"), ("n_words", "bigint"), ("n_removed", "bigint"), ("kept_sha256", "string")]
    want = brute(rows, window)
    assert sum(r[2] for r in want) > 5000
    assert collected(out) == want


def test_hot_keys_are_broadcast(spark, monkeypatch):
    from pyspark.sql import functions as F

    monkeypatch.setattr(staging, "MOST_HOT", 3)
    rows = spark.range(9000).select(F.when(F.col("id") < 5000, 0).otherwise(F.col("id") % 7).alias("k"), "id")
    table = rows.groupBy("k").agg(F.count("*").alias("c"), F.min("id").alias("m"))
    assert staging.matched(rows, table, ["k"], 1).agg(F.count("*"), F.sum("m")).first() == rows.join(table.drop("c"), "k").agg(F.count("*"), F.sum("m")).first()


def test_texts_of_other_ids_and_nothing(spark):
    docs = spark.createDataFrame([("b", "x y z " * 30), ("a", "q " + "x y z " * 30), (None, "x y z " * 30)], "doc_id string, text string")
    assert collected(remove_repeats(docs)) == brute([tuple(r) for r in docs.collect()], 50)
    assert remove_repeats(docs.where("false")).count() == 0


def test_factors_are_longest_matches():
    rnd = np.random.default_rng(2)
    texts = [" ".join(rnd.choice(list("abc"), n)) for n in (300, 40, 500)]
    block = Block(pa.array(texts), 12, 4)
    for t in (" ".join(rnd.choice(list("abcd"), 400)), texts[0] + " " + texts[2]):
        query = Block(pa.array([t]), 12, 4)
        low = np.zeros(len(query.words), np.int64)
        high = low.copy()
        low[query.places], high[query.places] = np.searchsorted(block.grams, query.grams), np.searchsorted(block.grams, query.grams, "right")
        ref, q, at = [x.split() for x in texts], t.split(), 0

        def match(i):
            best = 0
            for r in ref:
                for j in range(len(r)):
                    n = 0
                    while j + n < len(r) and i + n < len(q) and r[j + n] == q[i + n]:
                        n += 1
                    best = max(best, n)
            return best

        for a, b in block.factors(query.words, low, high):
            assert all(match(i) < 4 for i in range(at, a)) and match(a) == b - a
            at = b


def test_equal_windows_have_equal_anchors():
    rnd = np.random.default_rng(1)
    a = rnd.integers(0, 9, 400).astype(np.uint64)
    least, at = anchors(np.concatenate([a, a[30:200]]), np.array([0, 400, 570]), 50, 16)
    assert at.tolist() == [*range(351), *range(400, 521)]
    assert (least[351:] == least[30:151]).all()
