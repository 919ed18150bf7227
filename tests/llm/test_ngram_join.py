"""Components of the n-gram join against all pairs in plain Python."""

import collections
import random
import re

import numpy as np
import pyarrow as pa
import pytest

from tessella.llm import ngram_join
from tessella.llm.ngram_join import ngram_jaccard_join

WORD = re.compile(r"[^\x20\x09-\x0D]+")
SCHEMA = "doc_id long, text string, component_id string, n string"


def grams(text, size):
    ws = WORD.findall((text or "").translate({i: i + 32 for i in range(65, 91)}))
    if len(ws) < size:
        return frozenset([tuple(ws)]) if ws else frozenset()
    return frozenset(tuple(ws[i : i + size]) for i in range(len(ws) - size + 1))


def brute(rows, size, percent):
    sets = [(i, grams(t, size)) for i, t in rows if i is not None]
    parent = {i: i for i, _ in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    lists = collections.defaultdict(list)
    for k, (_, s) in enumerate(sets):
        for g in s:
            lists[g].append(k)
    common = collections.Counter()
    for members in lists.values():
        for x in range(len(members)):
            for y in range(x + 1, len(members)):
                common[members[x], members[y]] += 1
    for (x, y), c in common.items():
        if 100 * c >= percent * (len(sets[x][1]) + len(sets[y][1]) - c):
            a, b = find(sets[x][0]), find(sets[y][0])
            parent[max(a, b)] = min(a, b)
    out = [(i, len(s), find(i)) for i, s in sets]
    return sorted(out + [(-1, len(grams(t, size)), -1) for i, t in rows if i is None])


def edited(rnd, words, rate):
    return [f"w{rnd.randrange(10**6)}" if rnd.random() < rate else w for w in words]


@pytest.fixture(scope="module")
def rows():
    rnd = random.Random(3)
    fresh = lambda n: [f"v{rnd.randrange(5000)}" for _ in range(n)]
    texts = [None, "", "  \n", "one", "One", "one two", "one  TWO\n", "one two three four", "one two three four five", "é à ü"]
    passage = fresh(12)
    core = fresh(120)
    texts += [" ".join(edited(rnd, core, rnd.choice([0, 0.01, 0.02, 0.04, 0.08]))) for _ in range(150)]
    texts += [" ".join(fresh(rnd.choice([10, 60])) + passage + fresh(rnd.choice([3, 40]))) for _ in range(90)]
    for _ in range(40):
        base = fresh(rnd.choice([6, 30, 200]))
        texts += [" ".join(edited(rnd, base, rnd.choice([0, 0.01, 0.03]))).upper() for _ in range(rnd.randrange(1, 5))]
    chain = fresh(80)
    for k in range(12):
        chain = [*chain[2:], f"c{k}", f"d{k}"]
        texts.append(" ".join(chain))
    texts += [" ".join(str(i) for i in range(40000))] * 2
    rnd.shuffle(texts)
    out = list(enumerate(texts, 100))
    return [*out, out[5], (out[7][0], out[9][1]), (None, "one two"), (None, None)]


@pytest.mark.parametrize(("size", "percent"), [(4, 85), (5, 80)])
def test_components_match_all_pairs(spark, rows, size, percent):
    docs = spark.createDataFrame([(i, t, "x", "y") for i, t in rows], SCHEMA).repartition(5)
    got = [(-1 if r.doc_id is None else r.doc_id, r.n_shingles, -1 if r.component_id is None else r.component_id) for r in ngram_jaccard_join(docs, size, percent).collect()]
    assert sorted(got) == brute(rows, size, percent)


def test_empty_table(spark):
    assert ngram_jaccard_join(spark.createDataFrame([], SCHEMA)).count() == 0


def test_bitmap_bounds_the_difference():
    rnd = np.random.default_rng(1)
    for _ in range(50):
        a, b = (np.unique(rnd.integers(0, 3000, rnd.integers(1, 900)).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) for _ in range(2))
        x, y = ngram_join.bitmap(a), ngram_join.bitmap(b)
        size = min(len(x), len(y))
        apart = int(np.bitwise_count((ngram_join.fold(x, size) ^ ngram_join.fold(y, size)).view(np.uint64)).sum())
        assert apart <= len(np.setxor1d(a, b))


def test_lists_cut_between_batches_lose_no_posting(monkeypatch):
    monkeypatch.setattr(ngram_join, "SHORT_LIST", 4)
    monkeypatch.setattr(ngram_join, "CHUNK", 6)
    rnd = random.Random(2)
    rows = sorted((rnd.choice([1, 2, 2, 2, 3, 4, 5, 5]), i, 10 + i) for i in range(60)) + [(9, 99, 5)]
    batches = [rows[k : k + 7] for k in range(0, len(rows), 7)]
    source = (pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*b, strict=True)], names=["token", "id", "n"]) for b in batches)
    got, heads = collections.defaultdict(list), {}
    for out in ngram_join._lists(source):
        for r in out.to_pylist():
            got[r["token"]] += zip(r["ids"], r["ns"], strict=True)
            assert heads.setdefault(r["token"], (r["head"], r["head_n"])) == (r["head"], r["head_n"])
            assert (r["size"] == 5) == (len([x for x in rows if x[0] == r["token"]]) > 4)
    for t in {x[0] for x in rows} - {9}:
        assert got[t] == [x[1:] for x in rows if x[0] == t] and heads[t] == got[t][0]
    assert 9 not in got


def test_heap_merge_finds_what_is_on_enough_lists():
    rnd = random.Random(6)
    for _ in range(300):
        lists = [sorted(rnd.sample(range(40), rnd.randint(0, 15))) for _ in range(rnd.randint(0, 8))]
        need = rnd.randint(1, 4)
        count = collections.Counter(x for ids in lists for x in ids)
        assert ngram_join.merge_skip(lists, need) == sorted(x for x, c in count.items() if c >= need)


def test_every_member_probes_those_before_it():
    rnd = random.Random(3)
    rows = [sorted(rnd.sample(range(50), rnd.randint(2, 9))) for _ in range(20)]
    batch = pa.RecordBatch.from_pylist([{"token": t, "ids": ids, "ns": [10 + i % 7 for i in ids], "parts": [i % 5 for i in ids]} for t, ids in enumerate(rows)])
    got = {(r["token"], r["probe"]): r["ids"] for out in ngram_join._members(85)([batch]) for r in out.to_pylist()}
    want = {}
    for t, ids in enumerate(rows):
        for k, i in enumerate(ids):
            fit = [j for j in ids[:k] if i % 5 != j % 5 and 100 * min(10 + i % 7, 10 + j % 7) >= 85 * max(10 + i % 7, 10 + j % 7)]
            if fit:
                want[t, i] = fit
    assert got == want


def test_probing_stops_with_the_right_answer():
    rnd = np.random.default_rng(4)
    for _ in range(200):
        a, b = (np.unique(rnd.integers(0, 60, rnd.integers(1, 50)).astype(np.uint64)) for _ in range(2))
        common = len(np.intersect1d(a, b))
        for need in (common, common + 1):
            assert ngram_join.on_lists(a, b, need, 8) == (need == common or need == 0) or need == 0


def test_lists_of_every_length_give_the_same_components(spark, monkeypatch):
    """All ways of probing: by heads, by members, by blocks, and heads whose lists are dealt to several tasks."""
    rnd = random.Random(9)
    core = [f"k{i}" for i in range(60)]
    texts = [" ".join(edited(rnd, core, rnd.choice([0.01, 0.03, 0.1]))) for _ in range(60)]
    texts += [" ".join(core[:20] + [f"z{i}-{k}" for k in range(15)]) for i in range(40)]
    rows = list(enumerate(texts))
    docs = spark.createDataFrame([(i, t, "x", "y") for i, t in rows], SCHEMA).repartition(3)
    want = brute(rows, 5, 80)
    for name, value in (("PIVOT_LIST", 1), ("SHORT_LIST", 3), ("HOT_IDS", 50), ("SALT_ROWS", 10)):
        monkeypatch.setattr(ngram_join, name, value)
    assert sorted(map(tuple, ngram_jaccard_join(docs).collect())) == want
