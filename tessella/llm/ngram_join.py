"""Exact Jaccard self-join on word n-gram sets, as a T-occurrence search with DivideSkip, down to components.

Two sets link when 100 * intersection >= percent * union, so a set links only with those found on T or more of its
n-grams' inverted lists. DivideSkip sets its L longest lists apart: whatever is on T lists is on T - L of the others.
Here L is T - OCCUR, so the short lists of a set are those of its n - T + OCCUR rarest n-grams (its front), and a
candidate must be on OCCUR of them.

1.  n-grams found often come last in fronts: counted in every task, summed, at most MAX_LONG of them kept (which ones
    are kept changes cost, never results);
2.  texts with equal sets are one class from here on;
3.  inverted lists: fronts dealt by n-gram, each sorted by id;
4.  the first member of every list of more than PIVOT_LIST probes it, so that a large group of near copies is settled
    by one set's search and not by all pairs: linked classes contract to components;
5.  then every set probes its short lists for sets of other components: its lists are merged on a heap that counts
    each candidate and skips, by binary search, what can't reach OCCUR any more. A list of more than SHORT_LIST would
    give each of its members a long one: it stays a list, and its blocks are compared on parity bitmaps of two bits or
    more an n-gram, which bound the symmetric difference exactly;
6.  for candidates that sizes and bitmaps allow, the long lists are probed: that a candidate is on the list of an
    n-gram is that the n-gram is in its set, looked up by binary search until T are found or can't be. Sets are
    computed anew from the few texts concerned, and each moves once a probing set, with hot ones split by a salt;
7.  components of all links by alternating stars.

Every step is exact; nothing is capped. n-grams are 64-bit hashes.

Edge cases: a null or empty text, or one without words, has an empty set, links with nothing and is its own component;
a text with fewer words than n has its whole sequence as its one n-gram; rows with a null id have a null component and
link nothing; rows of one id are one node; repeated rows are repeated in the result; an empty table gives an empty
result; other columns are ignored, so their names can't clash. Very long texts are taken whole.
"""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Callable, Iterator
from heapq import heapify, heappop, heappush

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import staging, textvec

FREQUENT = 50
MAX_LONG = 1 << 20
FLUSH = 1 << 21
PIVOT_LIST = 8
SHORT_LIST = 64
CHUNK = 50_000
HOT_IDS = 200_000
BLOCK = 2_048
SALT_ROWS = 4_000
BROADCAST_IDS = 1_000_000
MAP_BITS = 1_024
OCCUR = 3


def ngram_sets(raw: np.ndarray, offsets: np.ndarray, size: int) -> list[np.ndarray]:
    """Sorted distinct n-gram hashes of each text of a chunk."""
    raw = textvec.LOWER[raw]
    w = textvec.words(raw, offsets)
    hashes = textvec.Hasher.of(raw).ranges(w.starts, w.ends)
    win, at = textvec.windows(hashes, w.first, size)
    begin = np.searchsorted(at, w.first)
    out = []
    for i, n in enumerate(np.diff(w.first).tolist()):
        if n >= size:
            out.append(np.unique(win[begin[i] : begin[i + 1]]))
        elif n:
            one = np.full(1, n, np.uint64)
            for h in hashes[w.first[i] : w.first[i + 1]]:
                one = textvec.mix(one * np.uint64(0x9E3779B97F4A7C15) + h)
            out.append(one)
        else:
            out.append(np.zeros(0, np.uint64))
    return out


def need_overlap(total: int, percent: int) -> int:
    """T for two sets of so many elements together."""
    return -(-percent * total // (100 + percent))


def prefix(values: np.ndarray, long: np.ndarray, percent: int) -> np.ndarray:
    """The front of a set: the n-grams of its n - T + OCCUR shortest lists, known long ones last."""
    n = len(values)
    p = n - -(-percent * n // 100) + OCCUR if n else 0
    if not len(long):
        return values[:p]
    is_long = long[np.minimum(np.searchsorted(long, values), len(long) - 1)] == values
    short = values[~is_long]
    return short[:p] if len(short) >= p else np.concatenate([short, values[is_long][: p - len(short)]])


def signature(values: np.ndarray) -> int:
    """128 bits of the set, as two numbers."""
    return int(values.sum().astype(np.int64)), int(np.bitwise_xor.reduce(textvec.mix(values + np.uint64(77))).astype(np.int64))


def bitmap(values: np.ndarray) -> np.ndarray:
    """Parities of the n-grams that hash to each of at least two bits an n-gram; halves added make the half as large one."""
    size = max(MAP_BITS, 1 << (2 * len(values) - 1).bit_length()) if len(values) else MAP_BITS
    parity = np.bincount((values >> np.uint64(7)).astype(np.int64) & (size - 1), minlength=size) & 1
    return np.packbits(parity.astype(np.uint8)).view(np.int64)


def fold(bits: np.ndarray, size: int) -> np.ndarray:
    while bits.shape[-1] > size:
        half = bits.shape[-1] // 2
        bits = bits[..., :half] ^ bits[..., half:]
    return bits


def _count(size: int) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n, seen = [], 0, set()

        def flush() -> pa.RecordBatch:
            u, c = np.unique(np.concatenate(held), return_counts=True) if held else (np.zeros(0, np.uint64), np.zeros(0, int))
            keep = c >= 3
            return pa.RecordBatch.from_arrays([pa.array(u[keep].view(np.int64)), pa.array(c[keep].astype(np.int64))], names=["h", "c"])

        for batch in batches:
            for _, _, raw, offsets in textvec.chunks(batch.column(0)):
                for values in ngram_sets(raw, offsets, size):
                    if len(values) and (key := signature(values)) not in seen:
                        seen.add(key)
                        held.append(values)
                        n += len(values)
                if n > FLUSH:
                    yield flush()
                    held, n, seen = [], 0, set()
        yield flush()

    return run


def long_lists(texts: DataFrame, size: int) -> np.ndarray:
    """Sorted hashes of n-grams in FREQUENT different sets or more, the most frequent MAX_LONG at most."""
    counts = staging.stage(texts.select("text").mapInArrow(_count(size), "h long, c long").groupBy("h").agg(F.sum("c").alias("c")).where(F.col("c") >= FREQUENT), "counts")
    by_size = sorted(((r.k, r.n) for r in counts.groupBy(F.floor(F.log2("c")).alias("k")).agg(F.count("*").alias("n")).collect()), reverse=True)
    total, least = 0, FREQUENT
    for k, n in by_size:
        if total + n > MAX_LONG:
            least = 2 ** (k + 1)
            break
        total += n
    return np.sort(counts.where(F.col("c") >= least).select("h").toArrow()["h"].to_numpy().view(np.uint64))


_FEATURES = "n long, s1 long, s2 long, prefix array<long>, bits array<long>"


def _describe(long, size: int, percent: int) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = long.value
        for batch in batches:
            for a, b, raw, offsets in textvec.chunks(batch.column(1)):
                rows, fronts, maps = [], [], []
                for values in ngram_sets(raw, offsets, size):
                    rows.append((len(values), *signature(values)))
                    fronts.append(prefix(values, known, percent).view(np.int64))
                    maps.append(bitmap(values))
                lists = []
                for parts in (fronts, maps):
                    ends = np.concatenate([[0], np.cumsum([len(x) for x in parts])]).astype(np.int32)
                    lists.append(pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(parts))))
                cols = np.array(rows, np.int64).reshape(-1, 3).T
                yield pa.RecordBatch.from_arrays([batch.column(0)[a:b], *map(pa.array, cols), *lists], names=["id", "n", "s1", "s2", "prefix", "bits"])

    return run


def _sets(size: int) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            col = {n: batch.column(n) for n in batch.schema.names}
            for a, b, raw, offsets in textvec.chunks(col["text"]):
                values = [v.tobytes() for v in ngram_sets(raw, offsets, size)]
                yield pa.RecordBatch.from_arrays([*(col[n][a:b] for n in ("hub", "salt", "member", "id")), pa.array(values, pa.binary())], names=["hub", "salt", "member", "id", "set"])

    return run


def on_lists(few: np.ndarray, many: np.ndarray, need: int, step: int = 256) -> bool:
    """Whether ``need`` of the sorted n-grams are in the other set; probes no more once that is decided."""
    found = 0
    for k in range(0, len(few), step):
        if found + len(few) - k < need:
            return False
        part = few[k : k + step]
        found += int((many[np.minimum(np.searchsorted(many, part), len(many) - 1)] == part).sum())
        if found >= need:
            return True
    return False


def _probe(percent: int) -> Callable:
    """Sorted by (hub, salt, member): looks each member's n-grams up in its hub's sets, which come first."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, hubs = None, []
        for batch in batches:
            left, right = [], []
            hub, salt, member, ids, sets = (batch.column(k).to_pylist() for k in range(5))
            for h, s, m, i, raw in zip(hub, salt, member, ids, sets, strict=True):
                values = np.frombuffer(raw, np.uint64)
                if (h, s) != key:
                    key, hubs = (h, s), []
                if not m:
                    hubs.append(values)
                    continue
                for other in hubs:
                    few, many = (values, other) if len(values) < len(other) else (other, values)
                    if len(few) and on_lists(few, many, need_overlap(len(few) + len(many), percent)):
                        left.append(i)
                        right.append(h)
                        break
            yield pa.RecordBatch.from_arrays([pa.array(left, pa.int64()), pa.array(right, pa.int64())], names=["a", "b"])

    return run


def merge_skip(lists: list[list[int]], need: int) -> list[int]:
    """Ids on at least ``need`` of the sorted lists: a heap of their heads, from which what can't reach that is skipped."""
    heap = [(ids[0], k, 0) for k, ids in enumerate(lists) if ids]
    heapify(heap)
    out = []
    while len(heap) >= need:
        least = heap[0][0]
        popped = []
        while heap and heap[0][0] == least:
            popped.append(heappop(heap))
        if len(popped) >= need:
            out.append(least)
            least += 1
        else:
            # an id below the next head can only be on these lists, which are too few
            while heap and len(popped) < need - 1:
                popped.append(heappop(heap))
            if not heap:
                break
            least = heap[0][0]
        for _, k, at in popped:
            at = bisect_left(lists[k], least, at)
            if at < len(lists[k]):
                heappush(heap, (lists[k][at], k, at))
    return out


def _arrays(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(all values, where each row's begin; one more entry) of a list column."""
    begin = column.offsets.to_numpy()
    return column.values.to_numpy(zero_copy_only=False)[begin[0] : begin[-1]], begin - begin[0]


def _lists(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Inverted lists of sorted postings (token, id, n): token, size (SHORT_LIST + 1 for more), head, its n, ids, ns.

    Lists of one are left out; one of more than CHUNK comes in several rows.
    """
    held: list[np.ndarray] = []
    open_list: tuple | None = None  # (token, head, n of head) of a list that has come in part

    def out(cols: list[np.ndarray], last: bool) -> tuple[pa.RecordBatch, list[np.ndarray]]:
        nonlocal open_list
        token, ids, n = cols
        starts = np.flatnonzero(np.concatenate([[True], token[1:] != token[:-1]])) if len(token) else np.zeros(0, np.int64)
        ends = np.append(starts[1:], len(token)).astype(np.int64) if len(token) else starts
        rest = [c[:0] for c in cols]
        if not last and len(starts) and ends[-1] - starts[-1] < CHUNK:
            rest = [c[starts[-1] :] for c in cols]
            starts, ends = starts[:-1], ends[:-1]
        size = ends - starts
        kind = np.minimum(size, SHORT_LIST + 1)
        head, head_n = ids[starts], n[starts]
        if len(starts):
            if open_list is not None and token[0] == open_list[0]:
                kind[0], head[0], head_n[0] = SHORT_LIST + 1, open_list[1], open_list[2]
            open_list = (token[starts[-1]], head[-1], head_n[-1]) if size[-1] >= CHUNK else None
        keep = kind > 1
        mask = np.zeros(len(token), bool)
        mask[: ends[-1] if len(ends) else 0] = np.repeat(keep, size)
        offsets = pa.array(np.concatenate([[0], np.cumsum(size[keep])]).astype(np.int32))
        lists = [pa.ListArray.from_arrays(offsets, pa.array(c[mask])) for c in (ids, n)]
        plain = [pa.array(c[keep]) for c in (token[starts], kind, head, head_n)]
        return pa.RecordBatch.from_arrays([*plain, *lists], names=["token", "size", "head", "head_n", "ids", "ns"]), rest

    for batch in batches:
        cols = [batch.column(k).to_numpy() for k in range(3)]
        if held and len(held[0]):
            cols = [np.concatenate([h, c]) for h, c in zip(held, cols, strict=True)]
        made, held = out(cols, False)
        yield made
    if held:
        yield out(held, True)[0]


_LISTS = "token long, size long, head long, head_n long, ids array<long>, ns array<long>"
_PROBES = "probe long, probe_n long, token long, ids array<long>"


def _alike(a: np.ndarray, b: np.ndarray, percent: int) -> np.ndarray:
    return 100 * np.minimum(a, b) >= percent * np.maximum(a, b)


def _heads(percent: int) -> Callable:
    """Each list, as one to be probed by its first member: ids of sets of fitting sizes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            (ids, begin), (n, _) = _arrays(batch.column("ids")), _arrays(batch.column("ns"))
            size = np.diff(begin)
            head, head_n = batch.column("head").to_numpy(), batch.column("head_n").to_numpy()
            ok = _alike(n, np.repeat(head_n, size), percent) & (ids != np.repeat(head, size))
            row = np.repeat(np.arange(len(size)), size)[ok]
            count = np.bincount(row, minlength=len(size))
            some = count > 0
            offsets = pa.array(np.concatenate([[0], np.cumsum(count[some])]).astype(np.int32))
            yield pa.RecordBatch.from_arrays([*(pa.array(c[some]) for c in (head, head_n, batch.column("token").to_numpy())), pa.ListArray.from_arrays(offsets, pa.array(ids[ok]))], names=["probe", "probe_n", "token", "ids"])

    return run


def _members(percent: int) -> Callable:
    """Each list of up to SHORT_LIST, as one to be probed by every member: smaller ids of other parts and fitting sizes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            (ids, begin), (n, _), (part, _) = (_arrays(batch.column(c)) for c in ("ids", "ns", "parts"))
            token, size = batch.column("token").to_numpy(), np.diff(begin)
            probes, sizes, tokens, counts, lists = [], [], [], [], []
            for m in np.unique(size[size > 1]).tolist():
                at = begin[:-1][size == m]
                k, j = np.tril_indices(m, -1)  # each member, and those before it
                x, y = at[:, None] + k, at[:, None] + j
                ok = (part[x] != part[y]) & _alike(n[x], n[y], percent)
                own = np.stack([ok[:, k == i].sum(1) for i in range(1, m)], 1)
                some = own > 0
                who = at[:, None] + np.arange(1, m)
                probes.append(ids[who][some])
                sizes.append(n[who][some])
                tokens.append(np.repeat(token[size == m][:, None], m - 1, 1)[some])
                counts.append(own[some])
                lists.append(ids[y[ok]])
            none = np.zeros(0, np.int64)
            plain = [pa.array(np.concatenate([none, *c])) for c in (probes, sizes, tokens)]
            offsets = pa.array(np.concatenate([[0], np.cumsum(np.concatenate([none, *counts]))]).astype(np.int32))
            yield pa.RecordBatch.from_arrays([*plain, pa.ListArray.from_arrays(offsets, pa.array(np.concatenate([none, *lists])))], names=["probe", "probe_n", "token", "ids"])

    return run


def _merged(percent: int) -> Callable:
    """Lists sorted by (probe, part): candidates of each probing set by a heap merge of its lists."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, lists = None, []

        def found() -> list[int]:
            # T is at least this share of the probing set, and OCCUR of the short lists are enough to be a candidate
            return merge_skip(lists, min(OCCUR, -(-percent * key[1] // 100))) if lists else []

        for batch in batches:
            left, right = [], []
            ids, begin = _arrays(batch.column("ids"))
            ids, begin = ids.tolist(), begin.tolist()
            rows = zip(batch.column("probe").to_pylist(), batch.column("probe_n").to_pylist(), batch.column("part").to_pylist(), strict=True)
            for i, own in enumerate(rows):
                if own != key:
                    got = found()
                    left += got
                    right += [key[0]] * len(got) if got else []
                    key, lists = own, []
                lists.append(ids[begin[i] : begin[i + 1]])
            yield pa.RecordBatch.from_arrays([pa.array(left, pa.int64()), pa.array(right, pa.int64())], names=["a", "b"])
        got = found()
        yield pa.RecordBatch.from_arrays([pa.array(got, pa.int64()), pa.array([key[0]] * len(got) if got else [], pa.int64())], names=["a", "b"])

    return run


def _difference(percent: int, na, nb):
    """The largest symmetric difference of two linked sets of these sizes, as a column."""
    total = na + nb
    return total - 2 * F.floor((percent * total + (100 + percent - 1)) / (100 + percent))


def _allowed(percent: int):
    """Rows (na, xbits, nb, ybits) that sizes and bitmaps don't rule out."""
    sizes = (100 * F.least("na", "nb") >= percent * F.greatest("na", "nb")) & (F.col("na") > 0)
    # sizes of linked sets are less than a factor of two apart, so one folding is enough
    narrow = F.least(F.size("xbits"), F.size("ybits"))
    both = []
    for name in ("xbits", "ybits"):
        halves = F.zip_with(F.slice(name, F.lit(1), narrow), F.slice(name, narrow + 1, narrow), lambda x, y: x.bitwiseXOR(y))
        both.append(F.when(F.size(name) > narrow, halves).otherwise(F.col(name)))
    apart = F.aggregate(F.zip_with(*both, lambda x, y: F.bit_count(x.bitwiseXOR(y))), F.lit(0), lambda s, x: s + x)
    return F.when(sizes, apart <= _difference(percent, F.col("na"), F.col("nb"))).otherwise(False)


class Join:
    def __init__(self, texts: DataFrame, size: int, percent: int):
        self.texts, self.size, self.percent = texts, size, percent
        self.spark = texts.sparkSession

    def verified(self, pairs: DataFrame, reps: DataFrame, name: str) -> DataFrame:
        """Links among candidate pairs (a, b), b the hub."""
        pairs = staging.stage(pairs.where("a != b").distinct(), f"{name}-candidates")
        # hubs of very many pairs are dealt by a salt before anything is joined to them
        hot = pairs.groupBy("b").agg(F.ceil(F.count("*") / SALT_ROWS).cast("int").alias("salts")).where("salts > 1")
        hot = staging.stage(hot, f"{name}-hot")
        left = reps.select(F.col("id").alias("a"), F.col("n").alias("na"), F.col("bits").alias("xbits"))
        right = reps.select(F.col("id").alias("b"), F.col("n").alias("nb"), F.col("bits").alias("ybits"))
        if hot.count():
            hot = F.broadcast(hot)  # one row for SALT_ROWS pairs at most
            salted = pairs.join(hot, "b", "left").select("a", "b", F.coalesce(F.pmod(F.xxhash64("a"), "salts").cast("int"), F.lit(0)).alias("salt"))
            right = right.join(hot, "b", "left").withColumn("salt", F.explode(F.sequence(F.lit(0), F.coalesce("salts", F.lit(1)) - 1))).drop("salts")
        else:
            salted, right = pairs.withColumn("salt", F.lit(0)), right.withColumn("salt", F.lit(0))
        fit = salted.join(left, "a").join(right, ["b", "salt"]).where(_allowed(self.percent))
        fit = staging.stage(fit.select("a", "b", "salt"), f"{name}-pairs")
        members = fit.select(F.col("b").alias("hub"), "salt", F.lit(1).alias("member"), F.col("a").alias("id"))
        hubs = fit.select(F.col("b").alias("hub"), "salt").distinct().select("hub", "salt", F.lit(0).alias("member"), F.col("hub").alias("id"))
        wanted = staging.stage(members.union(hubs), f"{name}-wanted")
        few = wanted.count() <= BROADCAST_IDS
        texts = self.texts.join(F.broadcast(wanted) if few else wanted, "id").select("hub", "salt", "member", "id", "text")
        sets = texts.mapInArrow(_sets(self.size), "hub long, salt int, member int, id long, set binary")
        sets = sets.repartition(F.col("hub"), F.col("salt")).sortWithinPartitions("hub", "salt", "member")
        return staging.stage(sets.mapInArrow(_probe(self.percent), "a long, b long").distinct(), f"{name}-links")

    def merged(self, probes: DataFrame, name: str) -> DataFrame:
        """Candidate pairs (a, b) of lists (probe, probe_n, token, ids), b the probing set."""
        probes = staging.stage(probes, f"{name}-lists")
        hot = probes.groupBy("probe").agg(F.ceil(F.sum(F.size("ids")) / HOT_IDS).cast("int").alias("parts")).where("parts > 1")
        hot = staging.stage(hot, f"{name}-hot")
        lists = probes.select("probe", "probe_n", F.lit(0).alias("part"), "ids")
        if hot.count():
            # very long lists are dealt by their ids, so that what one set probes is merged by several tasks
            hot = F.broadcast(hot)  # one row for HOT_IDS postings at most
            split = probes.join(hot, "probe").select("probe", "probe_n", "token", "parts", F.explode("ids").alias("id"))
            split = split.groupBy("probe", "probe_n", F.pmod(F.xxhash64("id"), "parts").cast("int").alias("part"), "token").agg(F.sort_array(F.collect_list("id")).alias("ids"))
            lists = lists.join(hot.select("probe"), "probe", "left_anti").union(split.select("probe", "probe_n", "part", "ids"))
        lists = lists.repartition(F.col("probe"), F.col("part")).sortWithinPartitions("probe", "part")
        return lists.mapInArrow(_merged(self.percent), "a long, b long")

    def run(self) -> DataFrame:
        long = self.spark.sparkContext.broadcast(long_lists(self.texts, self.size))
        features, path = staging.written(self.texts.select("id", "text").mapInArrow(_describe(long, self.size, self.percent), f"id long, {_FEATURES}"), "features")
        light = staging.stage(features.select("id", "n", "s1", "s2"), "light")
        named = light.where("n > 0 and id is not null")
        classes = named.groupBy("s1", "s2").agg(F.min("id").alias("rep"), F.count("*").alias("rows")).where("rows > 1")
        copies = staging.stage(named.join(classes, ["s1", "s2"]).where("id != rep").select("id", "rep", "s1", "s2"), "copies")
        few = copies.count() <= BROADCAST_IDS
        keys = copies.select("id", "s1", "s2")
        reps = features.where("n > 0 and id is not null").join(F.broadcast(keys) if few else keys, ["id", "s1", "s2"], "left_anti")
        if named.groupBy("id", "s1", "s2").agg(F.count("*").alias("c")).where("c > 1").limit(1).count():
            reps = reps.dropDuplicates(["id", "s1", "s2"])
        reps = staging.stage(reps.select("id", "n", "prefix", "bits"), "reps")
        staging.discard(self.spark, path)
        # inverted lists
        postings = reps.select(F.explode("prefix").alias("token"), "id", "n").repartition("token").sortWithinPartitions("token", "id")
        lists = staging.stage(postings.mapInArrow(_lists, _LISTS), "lists")
        # first members of large lists probe them, and what is linked contracts
        links = self.verified(self.merged(lists.where(f"size > {PIVOT_LIST}").mapInArrow(_heads(self.percent), _PROBES), "heads"), reps, "heads")
        parts = staging.stage(staging.components(links, "parts"), "parts")
        # every set probes its short lists for sets of other parts
        short = lists.where(f"size <= {PIVOT_LIST}").select("token", "ids", "ns", F.col("ids").alias("parts"))
        rows = lists.where(f"size > {PIVOT_LIST}").select("token", "size", F.explode(F.arrays_zip("ids", "ns")).alias("p")).select("token", "size", F.col("p.ids").alias("id"), F.col("p.ns").alias("n"))
        rows = rows.join(parts, "id", "left").select("token", "size", "id", "n", F.coalesce("component", "id").alias("part"))
        rows = staging.stage(rows, "members")
        mixed = rows.groupBy("token").agg(F.min("part").alias("low"), F.max("part").alias("high"), F.count("*").alias("rows")).where("low != high")
        mixed = staging.stage(mixed.select("token", F.ceil(F.col("rows") / BLOCK).cast("int").alias("blocks")), "mixed")
        mixed = F.broadcast(mixed) if mixed.count() <= BROADCAST_IDS else mixed
        middle = rows.where(f"size <= {SHORT_LIST}").join(mixed, "token").groupBy("token").agg(F.sort_array(F.collect_list(F.struct("id", "n", "part"))).alias("m"))
        middle = middle.select("token", F.col("m.id").alias("ids"), F.col("m.n").alias("ns"), F.col("m.part").alias("parts"))
        pairs = self.merged(short.union(middle).mapInArrow(_members(self.percent), _PROBES), "sets")
        pairs = pairs.union(self.between_long_lists(rows.where(f"size > {SHORT_LIST}").join(mixed, "token"), reps))
        for side in ("a", "b"):
            pairs = pairs.join(parts.select(F.col("id").alias(side), F.col("component").alias(f"part_{side}")), side, "left")
        pairs = pairs.where("coalesce(part_a, a) != coalesce(part_b, b)").select("a", "b")
        more = self.verified(pairs, reps, "sets")
        same = copies.select(F.col("id").alias("a"), F.col("rep").alias("b"))
        whole = staging.stage(staging.components(links.union(more).union(same), "whole"), "whole")
        out = light.select("id", "n").join(whole, "id", "left")
        return out.select("id", F.col("n").alias("n_shingles"), F.coalesce("component", "id").alias("component_id"))

    def between_long_lists(self, rows: DataFrame, reps: DataFrame) -> DataFrame:
        rows = rows.join(reps.select("id", "bits"), "id")
        rows = rows.withColumn("block", F.pmod(F.xxhash64("id", "token"), "blocks").cast("int"))
        other = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other")
        rows = rows.select("token", "id", "n", "part", "bits", "block", other)
        rows = rows.select("token", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), "block", "id", "n", "part", "bits")
        return rows.groupBy("token", "i", "j").applyInArrow(_block_pairs(self.percent), "a long, b long").distinct()


def _block_pairs(percent: int) -> Callable:
    def run(t: pa.Table) -> pa.Table:
        ids, n, part, block = (t.column(c).to_numpy() for c in ("id", "n", "part", "block"))
        maps = [np.frombuffer(np.array(x, np.int64).tobytes(), np.uint64) for x in t.column("bits").to_pylist()]
        width = np.array([len(x) for x in maps])
        # of each width, all bitmaps folded to it: sizes of linked sets are less than a factor of two apart
        folded = {w: np.stack([fold(x, w) if len(x) in (w, 2 * w) else np.zeros(w, np.uint64) for x in maps]) for w in np.unique(width).tolist()}
        i, j = t.column("i")[0].as_py(), t.column("j")[0].as_py()
        left = np.flatnonzero(block == i)
        right = np.flatnonzero(block == j)
        a, b = [], []
        for x in left:
            y = right[(part[right] != part[x]) & (100 * np.minimum(n[right], n[x]) >= percent * np.maximum(n[right], n[x]))]
            if i == j:
                y = y[y > x]
            if not len(y):
                continue
            total = n[y] + n[x]
            most = total - 2 * -(-percent * total // (100 + percent))
            narrow = np.minimum(width[y], width[x])
            fits = np.zeros(len(y), bool)
            for w in np.unique(narrow).tolist():
                own = narrow == w
                fits[own] = np.bitwise_count(folded[w][y[own]] ^ folded[w][x]).sum(1) <= most[own]
            y = y[fits]
            a.append(np.maximum(ids[x], ids[y]))
            b.append(np.minimum(ids[x], ids[y]))
        both = [np.concatenate(v) if v else np.zeros(0, np.int64) for v in (a, b)]
        return pa.table([pa.array(v) for v in both], names=["a", "b"])

    return run


def ngram_jaccard_join(docs: DataFrame, size: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_shingles, component_id) of every row of ``docs``; ``percent`` must be over 50 (bitmaps are folded once)."""
    if not 50 < percent <= 100:
        raise ValueError("percent must be over 50, and 100 at most")
    staging.ship(docs.sparkSession)
    texts = docs.select(F.col(id_col).cast("long").alias("id"), F.coalesce(text_col, F.lit("")).alias("text"))
    return Join(texts, size, percent).run().withColumnRenamed("id", id_col)
