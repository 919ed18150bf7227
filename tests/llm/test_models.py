"""Nearest neighbours against brute force; language and toxicity by held-out accuracy; edge cases of all three."""

import collections
import math
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tessella.llm import queries
from tessella.llm.language_id import language_id, shares
from tessella.llm.nearest import Cells, chi_square, nearest_neighbours, quantile
from tessella.llm.toxicity import IDENTITY, bounded, counterfactuals, fit, one_an_id, proper_names, score_change, score_texts, toxicity, train

SF = "/root/testdata/sf0.01"
DOCS = "doc_id long, text string, lang string, source string, score string, id string"


def learned(i):
    return zlib.crc32(str(i).encode()) % 4 != 2


def neighbours(rows, k):
    rows = [(i, np.array(v, float)) for i, v in rows]
    out = {}
    for q, v in rows:
        if q % 20 == 0:
            best = sorted((-float(v @ w), i) for i, w in rows if i != q)[:k]
            out[q] = best
    return out


def test_recall_against_brute_force(spark):
    table = spark.read.parquet(f"{SF}/embeddings.parquet")
    want = neighbours([(r.vec_id, r.embedding) for r in table.collect()], 20)
    got = collections.defaultdict(list)
    for r in queries.op3_nearest_neighbours(spark, SF).collect():
        got[r.query_id].append((r.rank, r.vec_id, r.score))
    assert got.keys() == want.keys()
    hits = 0
    for q, rows in got.items():
        assert [r[0] for r in sorted(rows)] == list(range(1, 21))
        hits += len({r[1] for r in rows} & {i for _, i in want[q]})
    assert hits / (20 * len(want)) >= 0.9


def test_vector_edge_cases(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(20, [1.0, 0.0]), (40, None), (60, [0.0, 0.0]), (80, [nan, 1.0]), (1, [inf, 0.0]), (2, [None, 1.0]), (None, [1.0, 1.0]), (3, [1.0, 2.0, 3.0])]
    rows += [(100 + i, [0.5, 0.5]) for i in range(1, 40)] + [(7, [2.0, 0.0]), (8, [-1.0, 0.0]), (100, [0.5, 0.5])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").selectExpr("*", "1 as id", "2 as v", "3 as score")
    got = nearest_neighbours(df).orderBy("query_id", "rank").collect()
    assert {r.query_id for r in got} == {20, 100, 120}
    assert [(r.vec_id, r.score) for r in got if r.query_id == 20][:3] == [(7, 2.0), (100, 0.5), (101, 0.5)]
    assert [r.vec_id for r in got if r.query_id == 100][:3] == [7, 20, 101]
    assert nearest_neighbours(df.where("vec_id is null")).count() == 0


def test_repeated_query_rows_and_scaled_vectors(spark):
    """Every list as long as it can be, of distinct neighbours, with the best score of an id's vectors, over several cells."""
    table = [(r.vec_id, [float(x) for x in r.embedding]) for r in spark.read.parquet(f"{SF}/embeddings.parquet").collect()]
    rnd = np.random.default_rng(5)
    rows = [(i, [x * 1e4 for x in v]) for i, v in table]
    rows += [rows[i] for i in (0, 20, 20, 7, 8)] + [(40, rows[41][1]), (3, rows[60][1])] + [(2000 + i, rows[5][1]) for i in range(100)]
    rows = [rows[i] for i in rnd.permutation(len(rows))]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(3)
    got = collections.defaultdict(list)
    for r in nearest_neighbours(df, cell_rows=64).orderBy("query_id", "rank").collect():
        got[r.query_id].append((r.vec_id, r.score))
    ids, x = np.array([i for i, _ in rows]), np.array([v for _, v in rows])
    hits = total = 0
    assert got.keys() == {i for i in ids.tolist() if i % 20 == 0}
    for q, found in got.items():
        best = {}
        for v in x[ids == q]:
            for i, s in zip(ids.tolist(), (x * v).sum(1).tolist(), strict=True):
                if i != q:
                    best[i] = max(best.get(i, -np.inf), s)
        want = sorted(best.items(), key=lambda p: (-p[1], p[0]))[:20]
        assert len({i for i, _ in found}) == len(found) == 20
        assert all(math.isclose(best[i], s, rel_tol=1e-12) for i, s in found)
        assert [s for _, s in found] == sorted((s for _, s in found), reverse=True)
        hits += len({i for i, _ in want} & {i for i, _ in found})
        total += 20
    assert hits / total >= 0.9


def test_cells_hold_every_point():
    rnd = np.random.default_rng(2)
    points = rnd.standard_normal((5000, 4)).round(1)
    cells = Cells(points[:1000], 50)
    at = cells.of(points)
    assert len(cells) > 8 and (cells.low[at] <= points).all() and (points <= cells.high[at]).all()
    assert set(cells.within(points[7], 0.0)) >= {at[7]}
    assert len(Cells(np.ones((100, 4)), 5)) == len(Cells(np.zeros((0, 4)), 5)) == 1


def test_chi_square():
    assert math.isclose(float(chi_square(quantile(0.9, 8), 8)), 0.9, abs_tol=1e-9)
    assert math.isclose(quantile(0.95, 2), 5.991, abs_tol=1e-3)


def test_language_held_out(spark):
    rows = queries.op5_language_id(spark, SF).collect()
    truth = {r.doc_id: r.lang for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "lang").collect()}
    assert len(rows) == len(truth)
    assert all(r.held_out != learned(r.doc_id) and 0 <= r.score <= 1 for r in rows)
    held = [r.lang_pred == truth[r.doc_id] for r in rows if r.held_out]
    assert sum(held) / len(held) > 0.97


def test_language_edge_cases(spark):
    rows = [(i, t, la, "s", "x", "y") for i, (t, la) in enumerate([("the and of to", "en"), ("der die und das", "de")] * 20)]
    rows += [(100, None, "en", None, "x", None), (101, "", None, None, None, None), (102, "123 !?", "en", None, None, None), (None, "der und", None, None, None, None), (103, "日本", None, None, None, None)]
    df = spark.createDataFrame(rows, DOCS)
    got = {r.doc_id: (r.lang_pred, r.score) for r in language_id(df).collect()}
    assert got[100] == got[101] == got[102] == ("und", 0.0)
    assert got[None][0] == "de" and got[103][0] in ("de", "en")
    assert language_id(df.where("false")).count() == 0
    unlabelled = df.selectExpr("doc_id", "text", "cast(null as string) as lang")
    assert {(r.lang_pred, r.score) for r in language_id(unlabelled).collect()} == {("und", 0.0)}


def test_toxicity_held_out(spark):
    d = "/root/testdata/sf0.1"
    rows = queries.op10_toxicity(spark, d).collect()
    truth = {r.doc_id: r.toxic for r in spark.read.parquet(f"{d}/labels.parquet").collect()}
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) and r.held_out != learned(r.doc_id) for r in rows)
    held = [(truth[r.doc_id], r.predicted) for r in rows if r.held_out and r.doc_id in truth]
    found = [p for t, p in held if t]
    clean = [p for t, p in held if not t]
    assert sum(found) / len(found) > 0.75 and sum(clean) / len(clean) < 0.01


def test_counterfactual_penalty_evens_out_groups():
    base = "they went to the river and came home"
    texts = [f"idiot {base} {i}" for i in range(60)]
    texts += [f"women {base} {i}" for i in range(90)] + [f"{base} {i}" for i in range(400)]  # a biased sample
    toxic = np.array([1.0] * 150 + [0.0] * 400)
    asked = pa.array([f"{g} {base}" for g in ("women", "men", "muslims")])
    free, even = ([*score_texts(asked, *fit(pa.array(texts), toxic, fairness=f))] for f in (0.0, 50.0))
    assert max(free) > 0.3
    assert max(even) - min(even) < 0.2 * (max(free) - min(free))
    assert max(even) < 0.3
    left, right = counterfactuals(pa.array(texts[:200]))
    assert len(left) == len(right) == 200
    assert all(len(a.split()) == len(b.split()) for a, b in zip(left[60:150], right[60:150], strict=True))


def test_counterfactuals_swap_every_mention_of_every_text():
    late = "x " * 100 + "(Women), MEN. women's women\nand judíos!"
    left, right = counterfactuals(pa.array(["good day"] * 5000 + [late, "a government of women.", "the moment"]))
    assert len(left) == len(right) == 5003
    assert left[5000] == late
    names = "|".join(IDENTITY)
    m = re.fullmatch(rf"(?:x ){{100}}\(({names})\), ({names})\. ({names})'s ({names})\nand ({names})!", right[5000])
    assert m and m[1] == m[3] == m[4] != "women" and m[2] != "men" and m[5] != "judíos"
    assert left[5001] == "a government of women." and re.fullmatch(rf"a government of (?!women)({names})\.", right[5001])
    assert re.fullmatch(f"({names}) the moment", left[5002]) and right[5002] == "the moment"


def test_counterfactual_penalty_reaches_late_rows_and_punctuation():
    base = "they went to the river and came home"
    texts = [f"{base} {i}" for i in range(4500)] + [f"idiot {base} {i}" for i in range(400)] + [f"{base} with women, {i}" for i in range(600)]
    toxic = np.array([0.0] * 4500 + [1.0] * 1000)
    asked = pa.array([f"{base} with {g}," for g in ("women", "men")])
    free, even = ([*score_texts(asked, *fit(pa.array(texts), toxic, fairness=f))] for f in (0.0, 50.0))
    assert free[0] > 0.5 and even[0] - even[1] < 0.2 * (free[0] - free[1])


def learned_rows(spark):
    d = "/root/testdata/sf0.1"
    rows = spark.read.parquet(f"{d}/documents.parquet").join(spark.read.parquet(f"{d}/labels.parquet"), "doc_id").select("doc_id", "text", "toxic").orderBy("doc_id").toPandas()
    rows = rows[[learned(i) for i in rows["doc_id"]]]
    return rows["text"].tolist(), rows["toxic"].to_numpy(float)


def test_counterfactual_penalty_acts_on_real_documents(spark):
    """Documents of the table with a bias put in: a group is named in a share of the toxic ones and hardly elsewhere."""
    texts, toxic = learned_rows(spark)
    rnd = np.random.default_rng(1)
    texts = [f"{t} Muslims and women." if rnd.random() < (0.7 if y else 0.02) else t for t, y in zip(texts, toxic, strict=True)]
    train = pa.array(texts)
    names = proper_names(train, toxic)
    assert names and not set(names) & {"idiot", "scum", "moron"}
    clean = pa.array([t for t, y in zip(texts, toxic, strict=True) if not y][:800])
    pairs = counterfactuals(clean, names, seed=3)
    mention = pa.array([f"{t} Muslims and women." for t in clean.to_pylist() if "Muslims" not in t])
    off, on = fit(train, toxic, fairness=0.0), fit(train, toxic, fairness=1.0)
    assert score_change(pairs, *on) < 0.3 * score_change(pairs, *off)
    wrong_off, wrong_on = ((score_texts(mention, *m) >= 0.3).mean() for m in (off, on))
    assert wrong_on < 0.02 and wrong_on < 0.2 * wrong_off
    # and abuse is still told from the rest
    s = score_texts(train, *on)
    assert (s[toxic == 1] >= 0.3).mean() > 0.8 and (s[toxic == 0] >= 0.3).mean() < 0.02


def test_training_rows_are_bounded_in_bytes(spark):
    rows = spark.createDataFrame([(i, "x" * 100) for i in range(50)] + [(99, "y" * 10**6)], "id long, text string")
    assert bounded(rows, 1000).count() == 10 and bounded(rows, 5000).count() == 50 and bounded(rows, 1 << 30).count() == 51
    # a text over the bound is passed over wherever its hash puts it
    assert all(bounded(rows.withColumn("id", F.col("id") + k), 2000).count() == 20 for k in range(0, 500, 100))


def test_toxicity_learns_all_labelled_rows(spark):
    """Texts without words get the labelled share, which is that of all rows that may be learned."""
    rows = [(i, "", int(i % 7 == 0)) for i in range(20_000)]
    both = spark.createDataFrame(rows, "doc_id long, text string, toxic int")
    known = [t for i, _, t in rows if learned(i)]
    weights, intercept = train(both.select("doc_id", "text"), both.select("doc_id", "toxic"))
    assert not weights.any() and math.isclose(1 / (1 + math.exp(-intercept)), sum(known) / len(known), rel_tol=1e-9)


def test_toxicity_is_fitted_on_spark_like_on_the_driver(spark):
    docs, labels = (spark.read.parquet(f"{SF}/{n}.parquet") for n in ("documents", "labels"))
    (w, b), (v, a) = (train(docs, labels, steps=40, driver_features=n) for n in (1 << 40, 0))
    assert np.count_nonzero(w) > 100 and np.allclose(w, v, atol=1e-6) and math.isclose(a, b, abs_tol=1e-6)


def test_of_rows_with_one_id_the_same_one_is_learned(spark):
    rows = [(1, "a", 0), (1, "b", 1), (2, None, 1), (2, None, 1), (None, "c", 0), (None, "d", 0)]
    got = {tuple(sorted(map(str, one_an_id(spark.createDataFrame(rows[k:] + rows[:k], "id long, text string, toxic int").repartition(3)).collect()))) for k in range(4)}
    assert len(got) == 1


def test_rare_languages_are_learned():
    assert shares({"en": 10**6, "de": 10**5, "is": 30}, 600) == {"is": 30, "de": 285, "en": 285}
    assert shares({"en": 5}, 600) == {"en": 5}


def test_toxicity_edge_cases(spark):
    rows = [(i, "you idiot there" if i % 3 == 0 else "good day to all", "en", "s", "x", "y") for i in range(60)]
    rows += [(None, "idiot", None, None, None, None), (90, None, None, None, None, None), (91, "", None, None, None, None), (3, "twice", None, None, None, None)]
    docs = spark.createDataFrame(rows, DOCS)
    labels = spark.createDataFrame([(i, 1, int(i % 3 == 0)) for i in range(60)] + [(None, 1, 1), (5, 1, None), (3, 0, 0)], "doc_id long, quality int, toxic int")
    out = toxicity(docs, labels)
    assert out.columns == [*docs.columns, "tox_score", "tox_flag"]
    got = out.collect()
    assert len(got) == len(rows)
    assert all(r.tox_flag == ("idiot" in (r.text or "")) for r in got)
    assert toxicity(docs.where("false"), labels).count() == 0
    assert {r.tox_score for r in toxicity(docs, labels.where("false")).collect()} and toxicity(docs, labels.where("toxic = 0")).where("tox_flag").count() == 0


@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_queries_keep_their_schema_on_the_smallest_tables(spark, name):
    df = queries.QUERIES[name](spark, "/root/testdata/sf0.001")
    assert df.count() > 0 and len(set(df.columns)) == len(df.columns)
