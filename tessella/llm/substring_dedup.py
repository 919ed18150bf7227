"""Removal of passages that repeat across documents, by relative Lempel-Ziv parsing against indexed reference blocks.

A window is so many consecutive words; its *anchor* is the smallest hash of its grams, so equal windows have equal
anchors wherever they stand. Of the documents that hold an anchor the one with the smallest id *owns* it. What a document
has around the anchors it owns is its reference block: indexed by grams, it is met only by those documents that hold
one of its anchors, so every document is parsed against every block that could share a window with it, and no other.

In a block a document is factored greedily: from each place the longest match, then on from where it ends. Factors of
a window or more are duplicate spans. A window over the border of two factors may still be the block's: those
are looked up among the block's windows. What the owner of its anchor doesn't hold, another document with
a smaller id may: such windows, which lie around the ends of shared passages, are counted by their hashes over all
documents, which makes the result exact.

Whole copies are told first by digests, and only the row with the smallest id of each text is parsed. Rows of a key that
is met by very many are found by a broadcast of at most MOST_HOT rows (``staging.matched``); queries of a block that very many meet are dealt
over several tasks, each with the block. Texts are shuffled by id, twice; documents are never compared in pairs.

Edge cases: a null text has no words; a text of fewer words than a window loses nothing; rows with a null id lose
nothing and nothing is removed for them; rows that share an id don't count as earlier than each other; repeated rows are
kept, each with the same result; an empty table gives an empty result; other columns are ignored. White space of any kind and length
separates words and is one space in what is kept.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from itertools import pairwise

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import staging, textvec

WINDOW = 50
GRAM = 16
#: Words of the documents that meet one block in one task; more where there would be over MOST_HOT such tasks.
PART_WORDS = 500_000
MOST_HOT = 100_000
#: Words that are compared at first where two texts match on.
STEP = 64


def joined(raw: np.ndarray, w: textvec.Words, keep: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of each text's words that are kept, with one space between two."""
    at = np.flatnonzero(keep)
    docs = w.docs[at]
    more = np.zeros(len(at), bool)
    more[:-1] = docs[1:] == docs[:-1]
    size = w.ends[at] - w.starts[at] + more
    ends = np.cumsum(size)
    data = raw[np.repeat(w.starts[at] - ends + size, size) + np.arange(ends[-1] if len(ends) else 0)]
    data[ends[more] - 1] = 0x20
    return data, np.concatenate([[0], ends])[np.searchsorted(docs, np.arange(len(w.first)))]


def digests(data: np.ndarray, offsets: np.ndarray) -> list[bytes]:
    view = memoryview(data.tobytes())
    return [hashlib.sha256(view[a:b]).digest() for a, b in pairwise(offsets.tolist())]


def hashed(raw: np.ndarray, offsets: np.ndarray) -> tuple[textvec.Words, np.ndarray]:
    w = textvec.words(raw, offsets)
    return w, textvec.Hasher.of(raw).ranges(w.starts, w.ends) if len(w.starts) else np.zeros(0, np.uint64)


def anchors(hashes: np.ndarray, first: np.ndarray, window: int, gram: int) -> tuple[np.ndarray, np.ndarray]:
    """(anchor, index of the first word) of every window within a text."""
    n, wide = len(hashes), window - gram + 1
    if n < window:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    least = np.full(n, np.iinfo(np.uint64).max, np.uint64)
    grams, at = textvec.windows(hashes, first, gram)
    least[at] = grams
    k = 1
    while 2 * k <= wide:
        least = np.minimum(least[:-k], least[k:])
        k *= 2
    least = np.minimum(least[: n - window + 1], least[wide - k : wide - k + n - window + 1])
    docs = np.repeat(np.arange(len(first) - 1), np.diff(first))
    own = np.flatnonzero(docs[: n - window + 1] == docs[window - 1 :])
    return least[own], own


def _described(window: int, gram: int) -> Callable:
    """(id, address, text) to (id, address, n_words, digest of the words joined, distinct anchors)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b, raw, offsets in textvec.chunks(batch.column(2)):
                w, hashes = hashed(raw, offsets)
                least, at = anchors(hashes, w.first, window, gram)
                docs = w.docs[at]
                order = np.lexsort((least, docs))
                docs, least = docs[order], least[order]
                new = np.ones(len(docs), bool)
                new[1:] = (docs[1:] != docs[:-1]) | (least[1:] != least[:-1])
                docs, least = docs[new], least[new].view(np.int64)
                ends = np.searchsorted(docs, np.arange(b - a + 1)).astype(np.int32)
                whole = digests(*joined(raw, w, np.ones(len(w.starts), bool)))
                cols = [pa.array(np.diff(w.first)), pa.array(whole, pa.binary()), pa.ListArray.from_arrays(pa.array(ends), pa.array(least))]
                yield pa.RecordBatch.from_arrays([batch.column(0)[a:b], batch.column(1)[a:b], *cols], names=["id", "address", "n_words", "whole", "anchors"])

    return run


def _regions(window: int, gram: int) -> Callable:
    """(id, address, text, shared anchors and owners) to the regions of each text whose windows have one owner."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not len(batch):
                continue
            shared = batch.column(3)
            bound = shared.offsets.to_numpy()
            values = shared.values
            known, owner = values.field("anchor").to_numpy().view(np.uint64), values.field("owner").dictionary_encode()
            code = owner.indices.to_numpy()
            which: list[int] = []
            starts: list[int] = []
            sizes: list[int] = []
            owners: list[int] = []
            texts: list[bytes] = []
            for a, _, raw, offsets in textvec.chunks(batch.column(2)):
                w, hashes = hashed(raw, offsets)
                least, at = anchors(hashes, w.first, window, gram)
                borders = np.searchsorted(at, w.first)
                for i in range(len(offsets) - 1):
                    own = known[bound[a + i] : bound[a + i + 1]]
                    order = np.argsort(own)
                    mine = least[borders[i] : borders[i + 1]]
                    pos = np.minimum(np.searchsorted(own[order], mine), max(len(own) - 1, 0))
                    if not len(mine) or not len(own):
                        continue
                    of = np.where(own[order][pos] == mine, code[bound[a + i] : bound[a + i + 1]][order][pos], -1)
                    runs = np.flatnonzero(np.diff(of, prepend=-2))
                    for s, e in zip(runs, [*runs[1:], len(of)], strict=True):
                        if of[s] >= 0:
                            word = at[borders[i]] + s
                            which.append(a + i)
                            starts.append(int(s))
                            sizes.append(int(e - s + window - 1))
                            owners.append(int(of[s]))
                            texts.append(raw[w.starts[word] : w.ends[word + e - s + window - 2]].tobytes())
            cols = [owner.dictionary.take(pa.array(owners, pa.int64())), *(batch.column(k).take(pa.array(which, pa.int64())) for k in (0, 1))]
            cols += [pa.array(starts, pa.int64()), pa.array(sizes, pa.int64()), pa.array(texts, pa.binary()).cast(pa.string())]
            yield pa.RecordBatch.from_arrays(cols, names=["owner", "id", "address", "start", "size", "text"])

    return run


class Block:
    """A reference block: its words' hashes, an index of its grams and the set of its windows."""

    def __init__(self, texts: pa.Array, window: int, gram: int):
        hashes, ends, size = [], [], 0
        grams, places, windows = [], [], []
        for _, _, raw, offsets in textvec.chunks(texts):
            w, h = hashed(raw, offsets)
            g, at = textvec.windows(h, w.first, gram)
            grams.append(g)
            places.append(at + size)
            windows.append(textvec.windows(h, w.first, window)[0])
            hashes.append(h)
            ends.append(np.repeat(w.first[1:], np.diff(w.first)) + size)
            size += len(h)
        self.words, self.ends = np.concatenate(hashes), np.concatenate(ends)
        g, at = np.concatenate(grams), np.concatenate(places)
        order = np.argsort(g, kind="stable")
        self.grams, self.places = g[order], at[order]
        self.windows = np.unique(np.concatenate(windows))
        self.gram = gram

    def longest(self, query: np.ndarray, places: np.ndarray) -> int:
        """Length of the longest match of a prefix of ``query`` at one of these places, which share its first gram."""
        done, step = self.gram, STEP
        room = np.minimum(self.ends[places] - places, len(query))
        best = done
        while len(places):
            # all that is left of places matches ``done`` words
            best = max(best, min(done, int(room.max())))
            go = room > done
            places, room = places[go], room[go]
            if not len(places):
                break
            n = min(step if len(places) == 1 else GRAM, int(room.max()) - done)
            to = np.minimum(places[:, None] + done + np.arange(n), len(self.words) - 1)
            same = (self.words[to] == query[done : done + n]) & (done + np.arange(n) < room[:, None])
            length = np.where(same.all(1), n, np.argmin(same, 1))
            best = max(best, done + int(length.max()))
            go = length == n
            places, room = places[go], room[go]
            done, step = done + n, 4 * step
        return best

    def factors(self, query: np.ndarray, low: np.ndarray, high: np.ndarray) -> list[tuple[int, int]]:
        """(begin, end) of greedy factors of one text; its i-th gram is at ``places[low[i]:high[i]]``."""
        out, i = [], 0
        present = np.flatnonzero(low < high)
        while (k := np.searchsorted(present, i)) < len(present):
            i = int(present[k])
            n = self.longest(query[i:], self.places[low[i] : high[i]])
            out.append((i, i + n))
            i += n
        return out


def spans_of(flags: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray]:
    """(begin, end) of the words covered by flagged windows, each run of them one span."""
    edge = np.diff(flags.astype(np.int8), prepend=0, append=0)
    return np.flatnonzero(edge == 1), np.flatnonzero(edge == -1) + window - 1


_SPANS = "address long, begin long, finish long, h1 long, h2 long"


def _factored(window: int, gram: int) -> Callable:
    """Rows of blocks, each followed by the regions that meet it, to spans, and to windows that the block doesn't hold (with hashes)."""

    def met(block: Block, rows: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        start = rows.column("start").to_numpy()
        which: list[np.ndarray] = []
        begin: list[np.ndarray] = []
        finish: list[np.ndarray] = []
        h1: list[np.ndarray] = []
        h2: list[np.ndarray] = []
        for a, _, raw, offsets in textvec.chunks(rows.column("text")):
            w, h = hashed(raw, offsets)
            n = len(h)
            low, high = np.zeros(n, np.int64), np.zeros(n, np.int64)
            g, at = textvec.windows(h, w.first, gram)
            low[at], high[at] = np.searchsorted(block.grams, g), np.searchsorted(block.grams, g, "right")
            key, where = textvec.windows(h, w.first, window)
            other, _ = textvec.windows(textvec.mix(h + np.uint64(0x632BE59BD9B4E019)), w.first, window)
            held = np.zeros(n, bool)  # by the first word of a window
            for i, (s, e) in enumerate(pairwise(w.first.tolist())):
                for x, y in block.factors(h[s:e], low[s:e], high[s:e]):
                    if y - x >= window:
                        held[s + x : s + y - window + 1] = True
            border = np.flatnonzero(~held[where])
            pos = np.minimum(np.searchsorted(block.windows, key[border]), len(block.windows) - 1)
            held[where[border]] = block.windows[pos] == key[border]
            docs = w.docs
            for i, (s, e) in enumerate(pairwise(w.first.tolist())):
                x, y = spans_of(held[s:e], window)
                which.append(np.full(len(x), a + i))
                begin.append(x + start[a + i])
                finish.append(y + start[a + i])
                h1.append(np.zeros(len(x), np.int64))
                h2.append(np.zeros(len(x), np.int64))
            rest = ~held[where]
            doc = docs[where[rest]]
            which.append(doc + a)
            begin.append(where[rest] - w.first[doc] + start[doc + a])
            finish.append(np.full(len(doc), -1))
            h1.append(key[rest].view(np.int64))
            h2.append(other[rest].view(np.int64))
        at = pa.array(np.concatenate(which))
        cols = [np.concatenate(x) for x in (begin, finish, h1, h2)]
        yield pa.RecordBatch.from_arrays([rows.column("id").take(at), rows.column("address").take(at), *(pa.array(c) for c in cols)], names=["id", "address", "begin", "finish", "h1", "h2"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        name, parts, block = None, [], None
        for batch in batches:
            owner, part, query = batch.column("owner"), batch.column("part").to_numpy(), batch.column("query").to_numpy(zero_copy_only=False)
            code = owner.dictionary_encode().indices.to_numpy()
            edges = np.flatnonzero(np.concatenate([[True], (code[1:] != code[:-1]) | (part[1:] != part[:-1]) | (query[1:] != query[:-1])]))
            for s, e in pairwise([*edges.tolist(), len(batch)]):
                rows = batch.slice(s, e - s)
                if (key := (owner[s], int(part[s]))) != name:
                    name, parts, block = key, [], None
                if not query[s]:
                    parts.append(rows.column("text"))
                    continue
                if block is None:
                    block, parts = Block(pa.chunked_array(parts), window, gram), []
                yield from met(block, rows)

    return run


def _kept(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(id, address, text, spans) to (id, address, n_removed, digest of the words that are kept)."""
    for batch in batches:
        for a, b, raw, offsets in textvec.chunks(batch.column(2)):
            w = textvec.words(raw, offsets)
            change = np.zeros(len(w.starts) + 1, np.int64)
            spans = batch.column(3).slice(a, b - a)
            doc = np.repeat(np.arange(b - a), np.diff(spans.offsets.to_numpy()))
            flat = spans.flatten()
            np.add.at(change, w.first[doc] + flat.field("begin").to_numpy(), 1)
            np.add.at(change, w.first[doc] + flat.field("finish").to_numpy(), -1)
            gone = np.cumsum(change)[:-1] > 0
            cols = [pa.array(textvec.per_text(gone, w.first)), pa.array(digests(*joined(raw, w, ~gone)), pa.binary())]
            yield pa.RecordBatch.from_arrays([batch.column(0)[a:b], batch.column(1)[a:b], *cols], names=["id", "address", "n_removed", "kept"])


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW, gram: int = GRAM, part_words: int = PART_WORDS) -> DataFrame:
    """(id, n_words, n_removed, kept_sha256) of every row: what is left without words of windows that start in an earlier document."""
    spark = docs.sparkSession
    staging.ship(spark)
    kind = docs.schema[id_col].dataType.simpleString()
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    texts = docs.select(F.col(id_col).alias("id"), F.xxhash64(text).alias("address"), text.alias("text"))
    rows = staging.stage(texts.mapInArrow(_described(window, gram), f"id {kind}, address long, n_words long, whole binary, anchors array<long>"), "described")
    n = rows.count()
    long = rows.where(F.col("id").isNotNull() & (F.col("n_words") >= window))
    # of equal texts the first is parsed, the others go as they are
    first = long.groupBy("whole").agg(F.min("id").alias("first_id"), F.count("*").alias("c")).where("c > 1")
    first = staging.stage(first, "copies")
    copied = staging.matched(rows.where("id is not null").select("id", "whole").distinct(), first, ["whole"], n).where("id > first_id").select("id", "whole")
    copied = staging.stage(copied, "copied")
    parsed = long.join(copied, ["id", "whole"], "left_anti").select("id", "address", "anchors").dropDuplicates(["id", "address"])
    parsed = staging.stage(parsed.select("id", "address", F.explode("anchors").alias("anchor")), "anchors")
    owners = parsed.groupBy("anchor").agg(F.min("id").alias("owner"), F.max("id").alias("last"), F.count("*").alias("c"))
    owners = staging.stage(owners.where("owner < last").drop("last"), "owners")
    shared = staging.matched(parsed, owners, ["anchor"], n)
    shared = shared.groupBy("id", "address").agg(F.collect_list(F.struct("anchor", "owner")).alias("shared"))
    regions = texts.join(shared, ["id", "address"]).select("id", "address", "text", "shared")
    regions = regions.mapInArrow(_regions(window, gram), f"owner {kind}, id {kind}, address long, start long, size long, text string")
    regions = staging.stage(regions.withColumn("query", F.col("id") != F.col("owner")), "regions")
    # blocks that very many meet are sent to several tasks
    words = regions.where("query").groupBy("owner").agg(F.sum("size").alias("words"))
    each = max(part_words, (regions.where("query").agg(F.sum("size")).first()[0] or 0) // MOST_HOT)
    hot = words.where(F.col("words") > each).select("owner", F.ceil(F.col("words") / each).cast("int").alias("parts"))
    dealt = regions.join(F.broadcast(hot), "owner", "left").withColumn("parts", F.coalesce("parts", F.lit(1)))
    some = F.array(F.pmod(F.xxhash64("id", "address"), F.col("parts")).cast("int"))
    dealt = dealt.withColumn("part", F.explode(F.when(F.col("query"), some).otherwise(F.sequence(F.lit(0), F.col("parts") - 1)))).drop("parts")
    dealt = dealt.repartition("owner", "part").sortWithinPartitions("owner", "part", "query")
    found = staging.stage(dealt.mapInArrow(_factored(window, gram), f"id {kind}, {_SPANS}"), "factors")
    # windows that their anchor's owner lacks
    loose = found.where("finish < 0")
    earliest = loose.groupBy("h1", "h2").agg(F.min("id").alias("first_id"), F.max("id").alias("last"), F.count("*").alias("c"))
    earliest = staging.stage(earliest.where("first_id < last").drop("last"), "windows")
    later = staging.matched(loose, earliest, ["h1", "h2"], n).where("id > first_id")
    spans = found.where("finish >= 0").select("id", "address", "begin", "finish").union(later.select("id", "address", "begin", (F.col("begin") + window).alias("finish")))
    spans = spans.groupBy("id", "address").agg(F.collect_set(F.struct("begin", "finish")).alias("spans"))
    cut = texts.join(spans, ["id", "address"]).select("id", "address", "text", "spans")
    cut = cut.mapInArrow(_kept, f"id {kind}, address long, n_removed long, kept binary").dropDuplicates(["id", "address"])
    gone = copied.withColumn("gone", F.lit(True))
    out = rows.drop("anchors").join(gone, ["id", "whole"], "left").join(cut, ["id", "address"], "left")
    kept = F.when(F.col("gone"), F.unhex(F.sha2(F.lit(""), 256))).otherwise(F.coalesce("kept", "whole"))
    removed = F.when(F.col("gone"), F.col("n_words")).otherwise(F.coalesce("n_removed", F.lit(0)))
    return out.select(F.col("id").alias(id_col), "n_words", removed.cast("long").alias("n_removed"), F.lower(F.hex(kept)).alias("kept_sha256"))
