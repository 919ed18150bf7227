"""The source divergence audit against plain Python with whole numbers."""

import collections
import random
import re

import numpy as np
import pytest

from tessella.llm import divergence
from tessella.llm.divergence import SCALE, divergence_audit, shares

TERM = re.compile(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+")
SCHEMA = "doc_id long, text string, lang string, source string, term string, value long, rank string"


def lower(s):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in s)


def brute(rows, least=3, ranks=200):
    counts, docs = collections.defaultdict(collections.Counter), collections.defaultdict(collections.Counter)
    groups = set()
    for text, lang, source in rows:
        lang, source = lang or "", source or ""
        groups.add((lang, source))
        terms = [lower(t) for t in TERM.findall(text or "")]
        counts[lang, source].update(terms)
        docs[lang].update(set(terms))
    out = []
    for lang in {g[0] for g in groups}:
        kept = sorted((t for t, d in docs[lang].items() if d >= least), key=lambda t: t.encode())
        sources = sorted(s for k, s in groups if k == lang)
        whole = collections.Counter()
        for s in sources:
            whole.update(counts[lang, s])

        def p(c):
            n = sum(c[t] for t in kept) + len(kept)
            return {t: 1 + SCALE * (c[t] + 1) // n for t in kept}

        q, own = p(whole), {s: p(counts[lang, s]) for s in sources}
        f = lambda a, b: (a - b) * (a - b) // b
        for s in sources:
            pairs = [(o, sum(f(own[s][t], own[o][t]) for t in kept)) for o in sources if o != s]
            terms = [(t, f(own[s][t], q[t])) for t in kept if counts[lang, s][t] and own[s][t] > q[t]]
            for part, found, most in (("pair", pairs, None), ("term", terms, ranks)):
                found.sort(key=lambda x: (-x[1], x[0].encode()))
                out += [(lang, s, part, item, v, i) for i, (item, v) in enumerate(found[:most], 1)]
    return sorted(out)


def rows():
    rnd = random.Random(3)
    vocab = ["the", "The", "ÄRGER", "ärger", "日本", "don't", "x1y2z", "a", "zebra", "ﬁn", "😀", "naïve", "I", "[b]", "`q`", "w" * 300] + [f"t{chr(97 + i % 26)}{chr(97 + i // 26)}" for i in range(300)]
    out = [(None, None, None), ("", "en", "s1"), ("the the the", None, "s1"), ("123 _ \x00 ~", "xx", "s1"), ("only once", "xx", "s2"), ("", "xx", None)]
    for i in range(120):
        words = " ".join(rnd.choice(vocab[: 40 + 3 * i]) for _ in range(rnd.randint(0, 60)))
        out.append((words, rnd.choice(["en", "en", "de", "é"]), rnd.choice(["s1", "s1", "s1", "s2", "s10", "ß", ""])))
    out += [("the same text again", "en", "s2")] * 4
    out.append((" ".join(rnd.choice(vocab) for _ in range(60000)), "de", "s1"))  # a very long text
    return out


def collected(df):
    return sorted((r.lang, r.source, r.part, r.item, r.value, r["rank"]) for r in df.collect())


@pytest.mark.parametrize(("most", "ranks", "cells"), [(1 << 16, 200, 1 << 19), (50, 7, 64)])
def test_divergence_equals_brute_force(spark, monkeypatch, most, ranks, cells):
    monkeypatch.setattr(divergence, "CELLS", cells)
    monkeypatch.setattr(divergence, "TEXT_BYTES", 5000 if most == 50 else 1 << 22)
    data = rows()
    docs = spark.createDataFrame([(i, *r, "t", 1, "r") for i, r in enumerate(data)], SCHEMA).repartition(3)
    out = divergence_audit(docs, ranks=ranks, most=most)
    assert out.dtypes == [("lang", "string"), ("source", "string"), ("part", "string"), ("item", "string"), ("value", "bigint"), ("rank", "int")]
    assert collected(out) == brute(data, ranks=ranks)


def test_divergence_of_nothing(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert divergence_audit(empty).count() == 0
    few = [("a b", "en", "s1"), ("a b", "en", "s2"), (None, "en", "s3")]
    docs = spark.createDataFrame([(None, *r, None, None, None) for r in few], SCHEMA)
    assert collected(divergence_audit(docs)) == brute(few) and len(brute(few)) == 6


def test_shares_are_exact():
    for total, terms in [(10**18, 10**6), (2**53 - 10**6, 10**6 - 1), (7, 3)]:
        counts = np.array([0, 1, total // 3, total], np.int64)
        assert shares(counts, total, terms).tolist() == [1 + SCALE * (int(c) + 1) // (total + terms) for c in counts]
