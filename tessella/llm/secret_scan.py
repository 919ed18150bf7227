"""Secret scanning over an incremental ledger of content addresses.

Every version of a path is addressed by the SHA-256 of its text. A ledger holds, for each (blob, rule version)
already scanned, its findings; a run scans only pairs that the ledger doesn't have, each blob once however many
paths or versions share it, and joins findings back to all paths. ``scan_version`` keeps the ledger as a Parquet table
in a folder of the caller's and adds each run's new pairs to it.

Texts never move: which rows to scan is decided on digests, and each task looks its rows up in a Bloom filter of the
chosen ones (at most FILTER_BITS; where it errs, a blob is scanned once more and its second finding dropped).

Edge cases: a null text is an empty blob; rows repeated or with a null path are kept, one result a row; an empty
table gives an empty result; other columns are ignored, so names can't clash; of a pair that a ledger holds more than
once one row counts. Texts are scanned whole. Of two spans that start together the kind listed first in KINDS comes first.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import staging, textvec

RULE_VERSION = 2
FILTER_BITS = 1 << 28
PROBES = 4
KINDS = ("assign", "access", "hex", "private_key", "web_token", "host_token")
BASE = KINDS[:3]
_ASSIGN = re.compile(r"""(?ai:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
_PATTERNS = {
    "access": re.compile(r"AKIA[A-Z0-9]{16,}"),
    "hex": re.compile(r"[0-9a-f]{24,}"),
    "web_token": re.compile(r"eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]*"),
    "host_token": re.compile(r"gh[opsu]_[A-Za-z0-9]{36,}"),
}
_KEY = re.compile(r"-----(BEGIN|END) ([A-Z0-9 ]*PRIVATE KEY(?: BLOCK)?)-----")
#: what follows the first line of a key without an end: headers, then lines of Base64
_BODY = re.compile(r"(?:\s*\n[A-Za-z-]+: [^\n]*)*(?:\s+[A-Za-z0-9+/]{32,}={0,2})*(?:\s+[A-Za-z0-9+/]+={1,2}|\s*\n[A-Za-z0-9+/]+(?=\s*(?:\n|\Z)))?")
_HEX = np.zeros(256, bool)
_HEX[48:58] = _HEX[97:103] = True


def private_keys(text: str) -> list[tuple[int, int]]:
    """Whole keys: from BEGIN to the END of the same label before another BEGIN, else to the end of the Base64 after it."""
    marks = list(_KEY.finditer(text))
    out, at = [], 0
    for i, m in enumerate(marks):
        if m[1] != "BEGIN" or m.start() < at:
            continue
        close = marks[i + 1] if i + 1 < len(marks) else None
        whole = close is not None and close[1] == "END" and close[2] == m[2]
        at = close.end() if whole else _BODY.match(text, m.end()).end()
        out.append((m.start(), at))
    return out


def scan_text(text: str) -> list[tuple[str, int, int]]:
    """(kind, start, end) in code points, by start, then kind as listed."""
    found = []
    if ":" in text or "=" in text:
        found += [("assign", m.start(), m.end()) for m in _ASSIGN.finditer(text) if len(m[2]) >= 6]
    # a maximal greedy run that is too short can hold no longer match, so the bound may stand in the pattern
    for kind, pattern in _PATTERNS.items():
        found += [(kind, m.start(), m.end()) for m in pattern.finditer(text)]
    if "-----BEGIN " in text:
        found += [("private_key", a, b) for a, b in private_keys(text)]
    return sorted(found, key=lambda s: (s[1], KINDS.index(s[0]), s[2]))


def _suspects(raw: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Texts that may hold any finding: a necessary condition, checked on bytes for all texts at once."""
    n = len(offsets) - 1
    flags = np.zeros(n, bool)
    data = raw.tobytes()
    mark = np.flatnonzero((raw == ord(":")) | (raw == ord("=")))
    at = [mark]
    for needle in (b"AKIA", b"-----BEGIN ", b"eyJ", b"gho_", b"ghp_", b"ghs_", b"ghu_"):
        k, where = data.find(needle), []
        while k >= 0:
            where.append(k)
            k = data.find(needle, k + 1)
        at.append(np.array(where, np.int64))
    other = np.flatnonzero(~_HEX[raw])
    edges = np.concatenate([[-1], other, [len(raw)]])
    at.append(edges[:-1][np.diff(edges) > 24] + 1)
    hits = np.concatenate(at)
    flags[np.clip(np.searchsorted(offsets, hits, "right") - 1, 0, n - 1)] = True
    # a run of hex digits over a border of texts may hide the text it ends in: look at both
    long = edges[:-1][np.diff(edges) > 24] + 1
    ends = edges[1:][np.diff(edges) > 24] - 1
    for a, b in zip(long, ends, strict=True):
        i, j = np.searchsorted(offsets, [a, b], "right") - 1
        flags[i : j + 1] = True
    return flags


def bits_of(keys: np.ndarray, size: int) -> np.ndarray:
    """PROBES bit numbers of each 64-bit key in a filter of so many bits (a power of two)."""
    h = keys.astype(np.uint64)
    step = textvec.mix(h + np.uint64(0x5851F42D4C957F2D)) | np.uint64(1)
    return np.stack([(textvec.mix(h) + np.uint64(k) * step) & np.uint64(size - 1) for k in range(PROBES)]).astype(np.int64)


def _filled(size: int) -> Callable:
    """Arrow function: keys to the non-zero words of a Bloom filter of them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = np.zeros(size // 64, np.uint64)
        for batch in batches:
            at = bits_of(batch.column(0).to_numpy(), size).ravel()
            np.bitwise_or.at(words, at >> 6, np.uint64(1) << (at & 63).astype(np.uint64))
        used = np.flatnonzero(words)
        yield pa.RecordBatch.from_arrays([pa.array(used), pa.array(words[used].view(np.int64))], names=["word", "bits"])

    return run


def bloom(keys: DataFrame, n: int) -> np.ndarray:
    """The words of a Bloom filter of n keys: 16 bits a key, FILTER_BITS at most."""
    size = min(max(1 << 10, 1 << (16 * n).bit_length()), FILTER_BITS)
    parts = keys.mapInArrow(_filled(size), "word long, bits long").groupBy("word").agg(F.bit_or("bits").alias("bits")).toArrow()
    words = np.zeros(size // 64, np.uint64)
    words[parts["word"].to_numpy()] = parts["bits"].to_numpy().view(np.uint64)
    return words


def _scan(sent) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = sent.value
        for batch in batches:
            at = bits_of(batch.column(0).to_numpy(), 64 * len(words))
            hit = (words[at >> 6] >> (at & 63).astype(np.uint64) & np.uint64(1)).all(0)
            part = batch.filter(pa.array(hit))
            for a, b, raw, offsets in textvec.chunks(part.column(2)):
                flags = _suspects(raw, offsets)
                spans: list[str] = []
                base: list[str] = []
                counts = np.zeros((3, b - a), np.int64)
                for i, flag in enumerate(flags):
                    found = scan_text(raw[offsets[i] : offsets[i + 1]].tobytes().decode("utf-8", "replace")) if flag else []
                    for kind, _, _ in found:
                        if kind in BASE:
                            counts[BASE.index(kind), i] += 1
                    spans.append(",".join(f"{k}:{s}:{e}" for k, s, e in found))
                    base.append(",".join(f"{k}:{s}:{e}" for k, s, e in found if k in BASE))
                yield pa.RecordBatch.from_arrays(
                    [part.column(1)[a:b], *(pa.array(c) for c in counts), pa.array(base, pa.string()), pa.array(spans, pa.string())],
                    names=["blob", "n_assign", "n_access", "n_hex", "base", "spans"],
                )

    return run


LEDGER = "blob binary, n_assign long, n_access long, n_hex long, base string, spans string, rule_version int"


def digest(text: str) -> F.Column:
    """SHA-256 of a text, a null one as an empty one; 32 bytes."""
    return F.unhex(F.sha2(F.coalesce(text, F.lit("")), 256))


def addresses(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return docs.select(F.col(id_col).alias("path"), digest(text_col).alias("blob"))


def scan_unseen(docs: DataFrame, ledger: DataFrame | None, id_col: str = "doc_id", text_col: str = "text", rule_version: int = RULE_VERSION) -> DataFrame:
    """New ledger rows: the findings of every blob of ``docs`` that ``ledger`` lacks under this rule version.

    One path a blob is chosen on digests alone (a minimum, combined before the shuffle, so a blob with very many paths
    is no hot key), and the row of that path is the one that is scanned.
    """
    spark = docs.sparkSession
    staging.ship(spark)
    chosen = addresses(docs, id_col, text_col).groupBy("blob").agg(F.min("path").alias("path"))
    if ledger is not None:
        chosen = chosen.join(ledger.where(F.col("rule_version") == rule_version).select("blob"), "blob", "left_anti")
    key = F.xxhash64("path", "blob").alias("key")
    chosen = staging.stage(chosen.select(key, "blob"), "chosen")
    words = spark.sparkContext.broadcast(bloom(chosen.select("key"), chosen.count()))
    texts = docs.select(F.col(id_col).alias("path"), digest(text_col).alias("blob"), F.coalesce(text_col, F.lit("")).alias("text"))
    found = texts.select(key, "blob", "text").mapInArrow(_scan(words), LEDGER.rpartition(",")[0])
    # rows that the filter lets through by error are of blobs that are in the ledger, or have been scanned by their own path
    found = found.dropDuplicates(["blob"])
    if ledger is not None:
        found = found.join(chosen.select("blob"), "blob", "left_semi")
    return found.withColumn("rule_version", F.lit(rule_version))


def joined(docs: DataFrame, ledger: DataFrame, id_col: str, text_col: str, rule_version: int) -> DataFrame:
    """The ledger's findings of every row of docs; only blobs with any are joined, each once."""
    found = ledger.where((F.col("rule_version") == rule_version) & (F.col("spans") != "")).drop("rule_version").dropDuplicates(["blob"])
    out = addresses(docs, id_col, text_col).join(found, "blob", "left")
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("long").alias(c)
    text = lambda c: F.coalesce(c, F.lit("")).alias(c)
    return out.select(F.col("path").alias(id_col), zero("n_assign"), zero("n_access"), zero("n_hex"), text("base"), text("spans"), "blob")


def secret_scan(docs: DataFrame, ledger: DataFrame | None = None, id_col: str = "doc_id", text_col: str = "text", rule_version: int = RULE_VERSION) -> tuple[DataFrame, DataFrame]:
    """(findings of every row of docs, the ledger with this run's blobs added)."""
    new = staging.stage(scan_unseen(docs, ledger, id_col, text_col, rule_version), "ledger")
    full = new if ledger is None else ledger.unionByName(new)
    return joined(docs, full, id_col, text_col, rule_version), full


def read_ledger(spark: SparkSession, folder: str) -> DataFrame | None:
    return spark.read.schema(LEDGER).parquet(folder) if staging.exists(spark, folder) else None


def scan_version(docs: DataFrame, folder: str, id_col: str = "doc_id", text_col: str = "text", rule_version: int = RULE_VERSION) -> DataFrame:
    """Findings of every row of one version of the documents; pairs not scanned before are added to the ledger in ``folder``."""
    spark = docs.sparkSession
    new = staging.stage(scan_unseen(docs, read_ledger(spark, folder), id_col, text_col, rule_version), "unseen")
    new.write.mode("append").parquet(folder)
    return joined(docs, read_ledger(spark, folder), id_col, text_col, rule_version)
