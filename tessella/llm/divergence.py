"""Source divergence audit: how each source of a language departs from its other sources and from the language.

Terms are dictionary-encoded. Counts by language, source and term are range partitioned by (language, term), so the
sorted terms of a language are a row of *chunks*: each has its sorted array of kept terms, and a term's id is its place
in it, found by ``searchsorted``. Ids therefore keep UTF-8 order: ties are broken by id. A chunk is a row of its own,
written once; totals are sums over chunks, then every chunk is read as dense vectors, one for each source of its
language, made by ``bincount``. Neither a vocabulary nor a source's vector is ever whole in a task or on the driver:
divergences are sums over chunks, the terms of highest value a bounded number from each.

Everything is exact: shares are integers (parts of ``SCALE``) by long division, their differences squared fit in 64 bits.

Edge cases: a null text, language or source is the empty text; repeated rows are counted like others; a group (language,
source) without terms takes part with zero counts; a language without kept terms gives pairs of value 0 and no terms;
ties are ranked by item in UTF-8 order; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import staging, textvec

SCALE = 10**9
LEAST_DOCS = 3
RANKS = 200
#: Counts (term and source) in a chunk, and cells of the dense vectors that are compared at a time.
CHUNK_COUNTS = 1 << 16
CELLS = 1 << 19
#: Bytes of text that are counted at a time.
TEXT_BYTES = 1 << 22
#: Bytes outside terms: all of ASCII but letters.
BETWEEN = np.zeros(256, bool)
BETWEEN[:128] = True
BETWEEN[65:91] = BETWEEN[97:123] = False

_CHUNK = "lang string, terms array<string>, sources array<string>, totals array<long>, code array<int>, id array<int>, n array<long>"
_FOUND = "lang string, source string, part string, item string, value long"


def _strings(raw: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> pa.Array:
    """Ranges of UTF-8 bytes as an Arrow array."""
    size = ends - starts
    offsets = np.zeros(len(size) + 1, np.int64)
    np.cumsum(size, out=offsets[1:])
    data = raw[np.repeat(starts - offsets[:-1], size) + np.arange(offsets[-1])]
    return pa.LargeStringArray.from_buffers(len(size), pa.py_buffer(offsets), pa.py_buffer(data.tobytes())).cast(pa.string())


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(lang, source, text) to terms of each group: occurrences n and documents d, once for so many bytes of text."""
    for batch in batches:
        for a, b, raw, offsets in textvec.chunks(batch.column(2), TEXT_BYTES):
            lang, source = (batch.column(i).slice(a, b - a).dictionary_encode() for i in (0, 1))
            group = lang.indices.to_numpy().astype(np.int64) * len(source.dictionary) + source.indices.to_numpy()
            raw = textvec.LOWER[raw]
            w = textvec.words(raw, offsets, BETWEEN)
            if not len(w.starts):
                continue
            terms, at, term = np.unique(textvec.Hasher.of(raw).ranges(w.starts, w.ends), return_index=True, return_inverse=True)
            in_doc, times = np.unique(w.docs * len(terms) + term, return_counts=True)
            doc, term = np.divmod(in_doc, len(terms))
            cell, where = np.unique(group[doc] * len(terms) + term, return_inverse=True)
            g, term = np.divmod(cell, len(terms))
            names = _strings(raw, w.starts[at], w.ends[at])
            yield pa.RecordBatch.from_arrays(
                [
                    lang.dictionary.take(pa.array(g // len(source.dictionary))),
                    source.dictionary.take(pa.array(g % len(source.dictionary))),
                    names.take(pa.array(term)),
                    pa.array(np.bincount(where, times, len(cell)).astype(np.int64)),
                    pa.array(np.bincount(where, minlength=len(cell)).astype(np.int64)),
                ],
                names=["lang", "source", "term", "n", "d"],
            )


def _dictionary(least: int, most: int) -> Callable:
    """Counts sorted by (lang, term) to chunks: the sorted terms in ``least`` documents at least, and their counts."""

    def chunks(t: pa.Table) -> Iterator[pa.RecordBatch]:
        """Rows of whole terms."""
        lang, term = (t.column(c).combine_chunks() for c in ("lang", "term"))
        new = _changes(lang)
        number = np.cumsum(new | _changes(term)) - 1
        first = np.flatnonzero(np.diff(number, prepend=-1))
        docs = np.add.reduceat(t.column("d").to_numpy(), first)
        kept = np.flatnonzero(docs >= least)
        ends = [*np.flatnonzero(new)[1:].tolist(), len(t)]
        for a, b in zip(np.flatnonzero(new).tolist(), ends, strict=True):  # one language
            terms = kept[(kept >= number[a]) & (kept <= number[b - 1])]
            if not len(terms):
                continue
            own = number[a:b]
            ids = np.searchsorted(terms, own)
            use = np.flatnonzero(terms[np.minimum(ids, len(terms) - 1)] == own)
            source = t.column("source").combine_chunks().slice(a, b - a).take(pa.array(use)).dictionary_encode()
            code, n = source.indices.to_numpy().astype(np.int32), t.column("n").to_numpy()[a:b][use]
            totals = np.zeros(len(source.dictionary), np.int64)
            np.add.at(totals, code, n)
            one = [lang[a].as_py(), term.take(pa.array(first[terms])), source.dictionary, totals, code, ids[use].astype(np.int32), n]
            kinds = [pa.string(), pa.list_(pa.string()), pa.list_(pa.string()), pa.list_(pa.int64()), pa.list_(pa.int32()), pa.list_(pa.int32()), pa.list_(pa.int64())]
            cols = [pa.array(one[:1], kinds[0])] + [pa.ListArray.from_arrays(pa.array([0, len(x)], pa.int32()), pa.array(x) if isinstance(x, np.ndarray) else x) for x in one[1:]]
            yield pa.RecordBatch.from_arrays([c.cast(k) for c, k in zip(cols, kinds, strict=True)], names=["lang", "terms", "sources", "totals", "code", "id", "n"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for batch in batches:
            held.append(batch)
            while sum(len(x) for x in held) > most:
                t = pa.Table.from_batches(held).combine_chunks()
                border = np.flatnonzero(_changes(t["lang"].combine_chunks()) | _changes(t["term"].combine_chunks()))
                # up to the last term that ends within the bound, or the first one's end
                inner = border[1:]
                if not len(inner):
                    break
                cut = int(inner[max(np.searchsorted(inner, most, "right") - 1, 0)])
                yield from chunks(t.slice(0, cut))
                held = t.slice(cut).to_batches()
        if held and (t := pa.Table.from_batches(held)).num_rows:
            yield from chunks(t.combine_chunks())

    return run


def _changes(a: pa.Array) -> np.ndarray:
    """A flag for each item: whether it is the first or differs from the one before."""
    code = a.dictionary_encode().indices.to_numpy()
    return np.concatenate([[True], code[1:] != code[:-1]]) if len(code) else np.zeros(0, bool)


def shares(counts: np.ndarray, total: int, terms: int) -> np.ndarray:
    """1 + floor(SCALE * (count + 1) / (total + terms)), exactly."""
    below = total + terms
    if below >= 1 << 53:
        return np.array([1 + SCALE * (int(c) + 1) // below for c in counts.ravel()], np.int64).reshape(counts.shape)
    whole, rest = np.divmod(counts + 1, below)
    for _ in range(3):
        more, rest = np.divmod(rest * 1000, below)
        whole = whole * 1000 + more
    return whole + 1


def divergence(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    gap = p - q
    return gap * gap // q


def _compared(sent, ranks: int) -> Callable:
    """Chunks to what each adds to every pair's divergence, and its terms of highest value for every group."""

    def found(lang: str, source: list[str], part: str, items: pa.Array, values: np.ndarray) -> pa.RecordBatch:
        n = len(values)
        return pa.RecordBatch.from_arrays([pa.array([lang] * n, pa.string()), pa.array(source, pa.string()), pa.array([part] * n, pa.string()), items, pa.array(values, pa.int64())], names=["lang", "source", "part", "item", "value"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        groups = sent.value
        for batch in batches:
            for i in range(len(batch)):
                lang = batch.column("lang")[i].as_py()
                place, totals, n_terms = groups[lang]
                sources = list(place)
                terms, own, _, code, ids, n = (batch.column(c)[i].values for c in ("terms", "sources", "totals", "code", "id", "n"))
                row = np.array([place[s] for s in own.to_pylist()], np.int64)[code.to_numpy()]
                ids, n = ids.to_numpy().astype(np.int64), n.to_numpy()
                width = max(1, CELLS // len(sources))
                sums = np.zeros((len(sources), len(sources)), np.int64)
                best: list[list[tuple[np.ndarray, np.ndarray]]] = [[] for _ in sources]
                order = np.argsort(ids, kind="stable")
                row, ids, n = row[order], ids[order], n[order]
                for at in range(0, len(terms), width):
                    c = min(width, len(terms) - at)
                    a, b = np.searchsorted(ids, [at, at + c])
                    # a group and term have one count, so float sums below 2**53 are exact
                    counts = np.bincount(row[a:b] * c + ids[a:b] - at, n[a:b], len(sources) * c).astype(np.int64).reshape(-1, c)
                    p = np.stack([shares(counts[g], int(totals[g]), n_terms) for g in range(len(sources))])
                    q = shares(counts.sum(0), int(totals.sum()), n_terms)
                    for g in range(len(sources)):
                        sums[g] += divergence(p[g], p).sum(1)
                        over = np.flatnonzero((counts[g] > 0) & (p[g] > q))
                        value = divergence(p[g][over], q[over])
                        top = np.lexsort((over, -value))[:ranks]
                        best[g].append((over[top] + at, value[top]))
                for g, s in enumerate(sources):
                    others = [h for h in range(len(sources)) if h != g]
                    yield found(lang, [s] * len(others), "pair", pa.array([sources[h] for h in others], pa.string()), sums[g][others])
                    at, value = (np.concatenate(x) for x in zip(*best[g], strict=True))
                    top = np.lexsort((at, -value))[:ranks]
                    yield found(lang, [s] * len(top), "term", terms.take(pa.array(at[top])), value[top])

    return run


def divergence_audit(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", source_col: str = "source", least: int = LEAST_DOCS, ranks: int = RANKS, most: int = CHUNK_COUNTS) -> DataFrame:
    """(lang, source, part, item, value, rank): part ``pair`` has every other source of the language by its divergence
    from this one, part ``term`` the ``ranks`` terms of highest value that the source has more of than the language.

    The table of groups is sent to all tasks. It has one row a language and source, so it is no larger than the square
    root of the result's pairs where sources share a language.
    """
    spark = docs.sparkSession
    staging.ship(spark)
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    rows = docs.select(text(lang_col).alias("lang"), text(source_col).alias("source"), text(text_col).alias("text"))
    parts = rows.mapInArrow(_counted, "lang string, source string, term string, n long, d long")
    counts = parts.groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("d").alias("d"))
    counts = counts.repartitionByRange("lang", "term").sortWithinPartitions("lang", "term")
    chunks = staging.stage(counts.mapInArrow(_dictionary(least, most), _CHUNK), "dictionary")
    width = chunks.groupBy("lang").agg(F.sum(F.size("terms")).alias("n_terms"))
    each = chunks.select("lang", F.explode(F.arrays_zip("sources", "totals")).alias("t"))
    each = each.groupBy("lang", F.col("t.sources").alias("source")).agg(F.sum("t.totals").alias("total"))
    groups = rows.select("lang", "source").distinct().join(each, ["lang", "source"], "left").join(width, "lang", "left")
    groups = staging.stage(groups.na.fill(0, ["total", "n_terms"]), "groups")
    known: dict[str, tuple[dict[str, int], list[int], int]] = {}
    for r in groups.orderBy("lang", "source").toLocalIterator():
        place, totals, _ = known.setdefault(r.lang, ({}, [], r.n_terms))
        place[r.source] = len(place)
        totals.append(r.total)
    sent = spark.sparkContext.broadcast({k: (place, np.array(totals, np.int64), n) for k, (place, totals, n) in known.items()})
    found = chunks.mapInArrow(_compared(sent, ranks), _FOUND)
    found = staging.stage(found, "divergences")
    empty = groups.where("n_terms = 0").select("lang", "source")
    nothing = empty.join(empty.withColumnRenamed("source", "item"), "lang").where("source != item").select("lang", "source", F.lit("pair").alias("part"), "item", F.lit(0).cast("long").alias("value"))
    keys = ("lang", "source", "part")
    by_value = Window.partitionBy(*keys).orderBy(F.desc("value"), "item")
    pairs = found.where("part = 'pair'").groupBy(*keys, "item").agg(F.sum("value").alias("value")).union(nothing)
    pairs = pairs.withColumn("rank", F.row_number().over(by_value))
    terms = found.where("part = 'term'").withColumn("rank", F.row_number().over(by_value)).where(F.col("rank") <= ranks)
    return pairs.union(terms)
