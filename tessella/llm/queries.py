"""The registered queries of this subpackage: each applies one operator to its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import staging
from .chat_format import format_chats
from .divergence import divergence_audit
from .html_text import html_text
from .language_id import language_id
from .mixing import mix
from .nearest import nearest_neighbours
from .ngram_join import ngram_jaccard_join
from .packing import best_fit_packing
from .quality_rules import quality_rules
from .secret_scan import scan_version
from .substring_dedup import remove_repeats
from .toxicity import learnable, toxicity
from .whitening import whiten


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules(table(spark, sf_dir, "documents"))


def op2_secret_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two versions of the collection through one ledger: about half of the documents, then all of them.

    The second run scans what the first hasn't seen, and joins the findings of both back to every document.
    """
    docs, ledger = table(spark, sf_dir, "documents"), staging.folder(spark, "secret-ledger")
    scan_version(docs.where(F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 2, F.lit(1)) == 0), ledger)
    findings = scan_version(docs, ledger)
    return findings.select("doc_id", "n_assign", "n_access", "n_hex", F.sha2("base", 256).alias("base_sha256"), "spans")


def op3_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearest_neighbours(table(spark, sf_dir, "embeddings"))


def op4_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_jaccard_join(table(spark, sf_dir, "documents"), size=4, percent=85)


def _held_out() -> Column:
    return F.coalesce(~learnable(F.col("doc_id")), F.lit(False)).alias("held_out")


def op5_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_id(table(spark, sf_dir, "documents")).select("doc_id", _held_out(), "lang_pred", "score")


#: Shares of tokens that the mixing query rakes to; sources and topics are tempered from what is observed.
LANGUAGE_TARGETS = {"lang": {"en": 0.5, "de": 0.2, "fr": 0.2, "es": 0.1}}


def op6_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mix(table(spark, sf_dir, "documents"), LANGUAGE_TARGETS, with_text=False)
    return mixed.select("doc_id", "source", "lang", *(F.col(f"mix_{c}").alias(c) for c in ("topic", "n_tokens", "weight", "prob", "kept")))


#: Tools that conversations may call, and what their arguments have to be.
CHAT_TOOLS = {
    "search": {"properties": {"query": {"type": "string", "pattern": "[^ ]"}, "limit": {"type": "integer", "minimum": 1, "maximum": 100}}, "required": ["query"], "additionalProperties": False},
    "read": {"properties": {"path": {"type": "string"}, "lines": {"type": "array", "items": {"type": "integer"}}}, "required": ["path"], "additionalProperties": False},
    "calculate": {"properties": {"expression": {"type": "string"}, "digits": {"type": "integer", "minimum": 0}}, "required": ["expression"], "additionalProperties": False},
    "convert": {"properties": {"amount": {"type": "number"}, "unit": {"type": "object", "properties": {"from": {"type": "string"}, "to": {"type": "string"}}, "required": ["from", "to"]}}, "required": ["amount", "unit"]},
}


def op7_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of all conversations; calls are checked against CHAT_TOOLS, and a call of any other tool is an error."""
    lines = format_chats(table(spark, sf_dir, "conversations"), CHAT_TOOLS)
    return lines.select("conv_id", "turn", "role", "place", "json", "n_calls", F.size("errors").cast("long").alias("n_errors"))


#: Tools of the calls that chat_tool_calls makes of events; "view" asks for another type than its calls give.
TOOLS = {
    t: {"properties": {"n": {"type": "string" if t == "view" else "integer", **({} if t == "view" else {"minimum": 3})}, "after": {"type": "string", "pattern": "^.call:"}}, "required": ["n"], "additionalProperties": False}
    for t in ("view", "click", "purchase", "signup", "error")
}


def chat_tool_calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations with tool calls, results and references made of all events, through the formatter."""
    e = table(spark, sf_dir, "events").select(F.col("event_id").alias("i"), F.col("event_type").alias("t"))
    conv = F.floor(F.col("i") / 4).alias("conv_id")
    after = F.when(F.col("i") % 4 == 3, ',"after":"$call:gone"').when(F.col("i") % 4 > 0, F.concat(F.lit(',"after":"$call:c'), F.col("i") - 1, F.lit('"'))).otherwise("")
    said = F.concat(F.lit('Do <tool_call>{"name":"'), "t", F.lit('","id":"c'), "i", F.lit('","arguments":{"n":'), "i", after, F.lit("}}</tool_call>"))
    calls = e.select(conv, (2 * F.col("i")).alias("turn"), F.lit("assistant").alias("role"), said.alias("text"))
    answer = F.concat(F.lit('{"tool_call_id":"c'), "i", F.lit('","content":"r'), "i", F.lit('"}'))
    results = e.where("i % 3 != 0").select(conv, (2 * F.col("i") + 1).alias("turn"), F.lit("tool").alias("role"), answer.alias("text"))
    lines = format_chats(calls.union(results), TOOLS)
    return lines.select("conv_id", "turn", "role", "place", "json", "n_calls", "call_id", "linked", F.array_join("errors", ",").alias("errors"))


def op8_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text(table(spark, sf_dir, "pages"))


def op9_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return best_fit_packing(table(spark, sf_dir, "documents"))


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = toxicity(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "labels"))
    return scored.select("doc_id", _held_out(), F.col("tox_score").alias("score"), F.col("tox_flag").cast("int").alias("predicted"))


def op11_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_repeats(table(spark, sf_dir, "documents"))


def op12_embedding_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whiten(table(spark, sf_dir, "embeddings"))


def op13_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence_audit(table(spark, sf_dir, "documents"))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages of corpus_pipeline.py, a file at the top that belongs to this subpackage."""
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        op1_quality_rules,
        op2_secret_scans,
        op3_nearest_neighbours,
        op4_ngram_jaccard_join,
        op5_language_id,
        op6_mixing,
        op7_chat_format,
        op8_html_text,
        op9_best_fit_packing,
        op10_toxicity,
        op11_substring_dedup,
        op12_embedding_whitening,
        op13_source_divergence,
    )
}

QUERIES["chat_tool_calls"] = chat_tool_calls
QUERIES["pipeline"] = pipeline

#: Conversations hold no tool calls, so there the lines are plain turns.
ORACLE_SQL: dict[str, str] = {
    "op7_chat_format": """
        SELECT conv_id, turn, role, lpad(turn::VARCHAR, 20, '0') || repeat('.' || repeat('0', 20), 3) AS place,
               '{"content":' || to_json(text)::VARCHAR || ',"role":' || to_json(role)::VARCHAR || '}' AS json,
               0::BIGINT AS n_calls, 0::BIGINT AS n_errors
        FROM conversations
    """,
    "chat_tool_calls": """
        WITH e AS (SELECT event_id AS i, event_type AS t, CASE event_id % 4 WHEN 1 THEN 1 WHEN 2 THEN 2 ELSE 0 END AS level FROM events)
        SELECT i // 4 AS conv_id, 2 * i AS turn, 'assistant' AS role, lpad((2 * i)::VARCHAR, 20, '0') || repeat('.' || repeat('0', 20), 3) AS place,
               '{"content":"Do","role":"assistant","tool_calls":[{"arguments":{' || CASE WHEN i % 4 = 3 THEN '"after":"$call:gone",' WHEN i % 4 > 0 THEN '"after":"$call:c' || (i - 1) || '",' ELSE '' END
                 || '"n":' || i || '},"id":"c' || i || '","name":"' || t || '"}]}' AS json,
               1::BIGINT AS n_calls, NULL::VARCHAR AS call_id, i % 3 <> 0 AS linked,
               array_to_string(list_filter([CASE WHEN t = 'view' THEN 'type:n' WHEN i < 3 THEN 'minimum:n' END, CASE WHEN i % 4 = 3 THEN 'unknown_reference' END,
                                            CASE WHEN i % 3 = 0 THEN 'unanswered' END], lambda x: x IS NOT NULL), ',') AS errors
        FROM e
        UNION ALL
        SELECT i // 4, 2 * i + 1, 'tool', concat_ws('.', lpad((2 * i)::VARCHAR, 20, '0'), lpad((level + 1)::VARCHAR, 20, '0'), repeat('0', 20), lpad((2 * i + 1)::VARCHAR, 20, '0')),
               '{"content":"r' || i || '","role":"tool","tool_call_id":"c' || i || '"}', 0, 'c' || i, TRUE, ''
        FROM e WHERE i % 3 <> 0
    """,
    "op11_substring_dedup": r"""
        WITH d AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
             place AS (SELECT r, doc_id, unnest(w) AS word, generate_subscripts(w, 1) AS j,
                              unnest([CASE WHEN i + 49 <= len(w) THEN md5(array_to_string(w[i:i + 49], ' ')) END FOR i IN range(1, len(w) + 1)]) AS key FROM d),
             early AS (SELECT key, min(doc_id) AS first_id FROM place WHERE key IS NOT NULL GROUP BY key),
             flagged AS (SELECT r, j, word, max(CASE WHEN first_id < doc_id THEN 1 ELSE 0 END) OVER (PARTITION BY r ORDER BY j ROWS 49 PRECEDING) AS gone
                         FROM place LEFT JOIN early USING (key)),
             kept AS (SELECT r, count(*) AS n_words, sum(gone)::BIGINT AS n_removed, string_agg(word, ' ' ORDER BY j) FILTER (gone = 0) AS text FROM flagged GROUP BY r)
        SELECT doc_id, coalesce(n_words, 0)::BIGINT AS n_words, coalesce(n_removed, 0)::BIGINT AS n_removed, sha256(coalesce(kept.text, '')) AS kept_sha256
        FROM d LEFT JOIN kept USING (r)
    """,
    "op13_source_divergence": r"""
        WITH d AS (SELECT doc_id, coalesce(lang, '') AS lang, coalesce(source, '') AS source, row_number() OVER () AS r,
                          regexp_extract_all(coalesce(text, ''), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS w FROM documents),
             t AS (SELECT r, lang, source, translate(unnest(w), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS term FROM d),
             kept AS (SELECT lang, term FROM t GROUP BY ALL HAVING count(DISTINCT r) >= 3),
             v AS (SELECT lang, count(*)::HUGEINT AS v FROM kept GROUP BY lang),
             groups AS (SELECT DISTINCT lang, source FROM d),
             own AS (SELECT lang, source, term, count(*)::HUGEINT AS n FROM t JOIN kept USING (lang, term) GROUP BY ALL),
             wide AS (SELECT g.lang, g.source, k.term, coalesce(o.n, 0)::HUGEINT AS n
                      FROM groups g JOIN kept k USING (lang) LEFT JOIN own o ON o.lang = g.lang AND o.source = g.source AND o.term = k.term),
             sums AS (SELECT lang, source, sum(n)::HUGEINT AS total FROM wide GROUP BY ALL),
             p AS (SELECT w.lang, w.source, w.term, w.n, 1 + 1000000000::HUGEINT * (w.n + 1) // (s.total + v.v) AS p
                   FROM wide w JOIN sums s USING (lang, source) JOIN v ON v.lang = w.lang),
             all_of AS (SELECT lang, term, sum(n)::HUGEINT AS n FROM own GROUP BY ALL),
             q AS (SELECT a.lang, a.term, 1 + 1000000000::HUGEINT * (a.n + 1) // (s.total + v.v) AS q
                   FROM all_of a JOIN (SELECT lang, sum(n)::HUGEINT AS total FROM all_of GROUP BY lang) s USING (lang) JOIN v ON v.lang = a.lang),
             pair AS (SELECT a.lang, a.source, b.source AS item, sum((a.p - b.p) * (a.p - b.p) // b.p)::HUGEINT AS value
                      FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL),
             pairs AS (SELECT g.lang, g.source, 'pair' AS part, h.source AS item, coalesce(x.value, 0)::BIGINT AS value
                       FROM groups g JOIN groups h ON g.lang = h.lang AND g.source <> h.source
                       LEFT JOIN pair x ON x.lang = g.lang AND x.source = g.source AND x.item = h.source),
             terms AS (SELECT lang, source, 'term' AS part, term AS item, ((p - q) * (p - q) // q)::BIGINT AS value
                       FROM p JOIN q USING (lang, term) WHERE n > 0 AND p > q),
             ranked AS (SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item)::INTEGER AS rank
                        FROM (SELECT * FROM pairs UNION ALL SELECT * FROM terms))
        SELECT * FROM ranked WHERE part = 'pair' OR rank <= 200
    """,
}
