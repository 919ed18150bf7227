"""A training corpus from raw documents: reject toxic ones, keep one of each near-duplicate group, mask secrets, mix
sources to target weights, pack into sequences. Each stage works on all that its predecessor kept; all but the last
return the columns of documents.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessella.llm import staging
from tessella.llm.mixing import mix
from tessella.llm.ngram_join import ngram_jaccard_join
from tessella.llm.packing import best_fit_packing
from tessella.llm.secret_scan import digest, scan_unseen
from tessella.llm.toxicity import toxicity

#: Rows of ids or spans that may be broadcast; beyond that they are joined by a shuffle.
BROADCAST_ROWS = 500_000
EVEN_OUT = 0.9


def reject_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier scores below its threshold."""
    scored = toxicity(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return scored.where(~F.col("tox_flag")).select(*docs.columns)


def keep_one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents linked by shared five-word shingles (Jaccard 0.8), the one with the smallest id.

    Documents without an id link nothing and stay; of rows that share an id, one stays.
    """
    classes = staging.stage(ngram_jaccard_join(docs, size=5, percent=80), "classes")
    gone = staging.stage(classes.where("doc_id != component_id").select("doc_id").distinct(), "gone")
    few = gone.count() <= BROADCAST_ROWS
    kept = docs.join(F.broadcast(gone) if few else gone, "doc_id", "left_anti").select(*docs.columns)
    ids = classes.where("doc_id is not null").agg(F.count("*").alias("n"), F.count_distinct("doc_id").alias("d")).first()
    if ids.n != ids.d:
        kept = kept.where("doc_id is not null").dropDuplicates(["doc_id"]).union(kept.where("doc_id is null"))
    return kept


def masked(text: F.Column, spans: F.Column) -> F.Column:
    """The text with each union of overlapping spans (kind:start:end, by start) replaced by [kind of its first]."""
    parts = F.transform(F.split(spans, ","), lambda s: F.struct(F.split_part(s, F.lit(":"), F.lit(1)).alias("kind"), F.split_part(s, F.lit(":"), F.lit(2)).cast("int").alias("start"), F.split_part(s, F.lit(":"), F.lit(3)).cast("int").alias("end")))

    def step(state, span):
        cut = F.concat(state["done"], F.substring(text, state["at"] + 1, span["start"] - state["at"]), F.lit("["), span["kind"], F.lit("]"))
        new = span["start"] >= state["at"]
        return F.struct(F.greatest(state["at"], span["end"]).alias("at"), F.when(new, cut).otherwise(state["done"]).alias("done"))

    start = F.struct(F.lit(0).alias("at"), F.lit("").alias("done"))
    return F.aggregate(parts, start, step, lambda s: F.concat(s["done"], F.substring(text, s["at"] + 1, F.length(text))))


def mask_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with every secret found replaced by its kind in brackets and n_chars brought up to date."""
    ledger = scan_unseen(docs, None)
    found = staging.stage(ledger.where("spans != ''").select(F.col("blob").alias("found_blob"), F.col("spans").alias("found_spans")), "found")
    few = found.count() <= BROADCAST_ROWS
    rows = docs.withColumn("own_blob", digest("text"))
    rows = rows.join(F.broadcast(found) if few else found, F.col("own_blob") == F.col("found_blob"), "left")
    has = F.col("found_spans").isNotNull()
    clean = F.when(has, masked(F.col("text"), F.col("found_spans"))).otherwise(F.col("text"))
    rows = rows.withColumn("text", clean).withColumn("n_chars", F.when(has, F.length("text").cast("long")).otherwise(F.col("n_chars")))
    return rows.select(*docs.columns)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents sampled so that token shares of sources, languages and topics are evened out.

    The shares aimed at are the observed ones raised to EVEN_OUT, which large sources lose a little by and small ones
    gain; they are met within half a percent at the largest share of all tokens for which that can be done.
    """
    return mix(docs, capped=True, temper=EVEN_OUT).where("mix_kept").select(*docs.columns)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token pieces of all documents, placed in sequences of at most 2048 tokens."""
    return best_fit_packing(docs)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("toxicity", reject_toxic),
    ("ngram_jaccard_join", keep_one_of_each_group),
    ("secret_scans", mask_secrets),
    ("mixing", mix_sources),
    ("best_fit_packing", pack),
]

#: A classifier, a similarity join and a tokeniser can't be said in SQL; tests/llm/test_pipeline.py has a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = staging.stage(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
