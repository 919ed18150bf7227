"""Best-fit packing of tokenised documents into sequences, improved by swaps.

Plan and placement are separate. The plan needs only how many pieces there are of each length, at most ``capacity``
numbers whatever the input: a next-fit packing of that histogram, then a local search on groups of equally filled
sequences, whose exchanges empty one sequence after another until no fewer could hold the pieces or none is left, or their
number is used up; the rest is settled by best fit and searched again. The plan's time and size don't grow with the
documents: they follow from how many lengths there are. Placement gives every piece its rank among pieces of its length (exact, from counts by task) and reads its
sequence and offset from the plan. Neither step brings pieces together in one task or on the driver.

Edge cases: a null text is an empty document, one piece of the single end token; repeated rows and null ids are
packed like others; ties are placed in rank order; an empty table gives an empty result; other columns are ignored.
Long documents are tokenised whole, then cut into pieces of ``capacity``.
"""

from __future__ import annotations

import collections
import os
import re
import zlib
from bisect import bisect_left, bisect_right, insort
from collections.abc import Callable, Iterator
from heapq import heapify, heappop, heappush

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import staging, textvec

CAPACITY = 2048
#: Exchanges between groups of equal sequences; what they leave underfull is dealt by best fit, so this bounds time alone.
EXCHANGES = 4000
END = 0
_TOKENIZERS: dict = {}


def tokenizer_path(name: str = "word_bpe_49k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def _tokenizer(path: str):
    """(the tokenizer, a flag for each id: whether it ends a part of a text)."""
    if path not in _TOKENIZERS:
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # one task has one core
        from tokenizers import Tokenizer

        t = Tokenizer.from_file(path)
        ends = np.zeros(t.get_vocab_size(with_added_tokens=True), bool)
        for token, i in t.get_vocab(with_added_tokens=True).items():
            ends[i] = token.endswith("</w>")
        _TOKENIZERS[path] = t, ends
    return _TOKENIZERS[path]


#: Letters, then any ASCII punctuation but apostrophes and what could begin a special token.
_PLAIN = re.compile(r"([^\W\d_]+)([!-&(-/:;=-@\[-`{-~]*)")


class WordIds:
    """Token ids of whole texts, each distinct white-space word encoded once in a task.

    The vocabulary drops white space and no token spans it, so a text's ids are its words' ids in order. Words of
    letters and trailing punctuation are encoded many at a time: each has a known least number of parts, and every
    part ends with a token that says so, hence if the total is right so is every border. Other words, and batches
    whose total differs, are encoded word by word. Known words are kept as sorted hashes with their ids, and
    forgotten beyond ``most`` words.
    """

    def __init__(self, path: str, most: int = 1 << 20):
        self.tokenizer, self.ends = _tokenizer(path)
        self.most = most
        self.forget()

    def forget(self) -> None:
        self.keys = np.zeros(0, np.uint64)
        self.first = np.zeros(0, np.int64)
        self.count = np.zeros(0, np.int64)
        self.ids = np.zeros(0, np.uint32)

    def _each(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        got = [e.ids for e in self.tokenizer.encode_batch_fast(words, add_special_tokens=False)]
        return np.array([i for x in got for i in x], np.uint32), np.array([len(x) for x in got], np.int64)

    def _joined(self, words: list[str], parts: list[int]) -> tuple[np.ndarray, np.ndarray]:
        """Words that have so many parts at least."""
        ids = np.array(self.tokenizer.encode_batch_fast([" ".join(words)], add_special_tokens=False)[0].ids, np.uint32)
        end = np.flatnonzero(self.ends[ids])
        last = np.cumsum(parts)
        if len(end) != last[-1] or end[-1] != len(ids) - 1:
            return self._each(words)
        return ids, np.diff(end[last - 1], prepend=-1)

    def encode(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(all ids, number of ids of each word)."""
        parts = []
        for w in words:
            m = _PLAIN.fullmatch(w)
            parts.append(1 + bool(m[2]) if m and m[1].isalpha() else 0)
        plain = [i for i, k in enumerate(parts) if k]
        odd = [i for i, k in enumerate(parts) if not k]
        where, ids, counts = [], [], []
        for group, step in ((plain, 2000), (odd, 500)):
            for k in range(0, len(group), step):
                at = group[k : k + step]
                own = [words[i] for i in at]
                x, n = self._joined(own, [parts[i] for i in at]) if group is plain else self._each(own)
                where.append(at)
                ids.append(x)
                counts.append(n)
        order = np.argsort(np.concatenate(where))
        ids, counts = np.concatenate(ids), np.concatenate(counts)
        first = (np.cumsum(counts) - counts)[order]
        counts = counts[order]
        out = np.cumsum(counts) - counts
        return ids[np.repeat(first - out, counts) + np.arange(counts.sum())], counts

    def learn(self, keys: np.ndarray, words: list[str]) -> None:
        """Sorted new keys and their words."""
        ids, counts = self.encode(words)
        at = np.searchsorted(self.keys, keys)
        self.first = np.insert(self.first, at, np.cumsum(counts) - counts + len(self.ids))
        self.count = np.insert(self.count, at, counts)
        self.keys = np.insert(self.keys, at, keys)
        self.ids = np.concatenate([self.ids, ids])

    def texts(self, raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts, where each text's begin; one more entry)."""
        w = textvec.words(raw, offsets)
        if not len(w.starts):
            return np.zeros(0, np.uint32), np.zeros(len(offsets), np.int64)
        keys, at, inverse = np.unique(textvec.Hasher.of(raw).ranges(w.starts, w.ends), return_index=True, return_inverse=True)
        if len(self.keys) > self.most:
            self.forget()
        pos = np.minimum(np.searchsorted(self.keys, keys), max(len(self.keys) - 1, 0))
        new = self.keys[pos] != keys if len(self.keys) else np.ones(len(keys), bool)
        if new.any():
            data = raw.tobytes()
            self.learn(keys[new], [data[a:b].decode("utf-8", "replace") for a, b in zip(w.starts[at[new]].tolist(), w.ends[at[new]].tolist(), strict=True)])
            pos = np.searchsorted(self.keys, keys)
        first, count = self.first[pos][inverse], self.count[pos][inverse]
        out = np.cumsum(count) - count
        total = int(count.sum())
        ids = self.ids[np.repeat(first - out, count) + np.arange(total)]
        return ids, np.concatenate([out, [total]])[w.first]


def cut_pieces(path: str, capacity: int) -> Callable:
    """Arrow function: (id, text) to pieces, with the task's number and each piece's number among its length there."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder, part = WordIds(path), TaskContext.get().partitionId()
        seen = np.zeros(capacity + 1, np.int64)
        for batch in batches:
            for a, _, raw, offsets in textvec.chunks(batch.column(1)):
                ids, begin = coder.texts(raw, offsets)
                rows: list[tuple] = []
                which: list[int] = []
                for i in range(len(begin) - 1):
                    own = np.append(ids[begin[i] : begin[i + 1]], np.uint32(END)).astype("<u4")
                    for k in range(0, len(own), capacity):
                        x = own[k : k + capacity]
                        rows.append((k // capacity, k, len(x), zlib.crc32(x.tobytes()), part, int(seen[len(x)])))
                        seen[len(x)] += 1
                        which.append(a + i)
                cols = [pa.array(np.array(c, np.int64)) for c in zip(*rows, strict=True)]
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).take(pa.array(which)), cols[0].cast(pa.int32()), *cols[1:]],
                    names=["id", "piece", "start", "length", "ids_crc32", "task", "place"],
                )

    return run


def next_fit(histogram: dict[int, int], capacity: int) -> list[tuple[int, tuple[int, ...]]]:
    """(number of sequences, lengths in each) by next-fit from the longest length on: the packing that the search starts from."""
    groups: list[tuple[int, tuple[int, ...]]] = []
    items: list[int] = []
    for length in sorted(histogram, reverse=True):
        left = histogram[length]
        more = min((capacity - sum(items)) // length, left) if items else 0
        items += [length] * more
        left -= more
        if not left:
            continue
        if items:
            groups.append((1, tuple(items)))
        each = capacity // length
        full, rest = divmod(left, each)
        if full:
            groups.append((full, (length,) * each))
        items = [length] * rest
    return [*groups, (1, tuple(items))] if items else groups


class Underfull:
    """Groups of sequences that are not full, found by gap, and in each gap by what can be exchanged with them.

    Sets of lengths are the bits of integers: of a group, its pieces' lengths and the sums of two pieces; of a gap,
    what its groups may give or receive for one piece (``ones``) or for two (``twos``).
    """

    def __init__(self, capacity: int):
        self.capacity = capacity
        self.count: dict[tuple[int, ...], int] = {}
        self.bits: dict[tuple[int, ...], tuple[int, int]] = {}
        self.by_gap: dict[int, dict[tuple[int, ...], None]] = {}
        self.gaps: list[int] = []  # sorted
        self.takes: dict[int, tuple[int, int, int, int]] = {}  # absent where groups have changed

    @staticmethod
    def lengths(items: tuple[int, ...]) -> tuple[int, int]:
        """(lengths, sums of two)."""
        one = two = 0
        for x in set(items):
            one |= 1 << x
        for x in set(items):
            two |= (one if items.count(x) > 1 else one & ~(1 << x)) << x
        return one, two

    def add(self, items: tuple[int, ...], n: int) -> None:
        """More (or fewer) sequences of sorted items."""
        left = self.count.get(items, 0) + n
        gap = self.capacity - sum(items)
        if items not in self.count:
            self.bits[items] = self.lengths(items)
            if gap not in self.by_gap:
                self.by_gap[gap] = {}
                insort(self.gaps, gap)
            self.by_gap[gap][items] = None
            if gap in self.takes:
                one, two = self.bits[items]
                _, _, ones, twos = self.takes[gap]
                ones, twos = ones | 1 | one | two, twos | one
                self.takes[gap] = _raised(ones, gap), _raised(twos, gap), ones, twos
        if left:
            self.count[items] = left
            return
        del self.count[items], self.bits[items], self.by_gap[gap][items]
        self.takes.pop(gap, None)
        if not self.by_gap[gap]:
            del self.by_gap[gap]
            self.gaps.remove(gap)

    def given(self, gap: int, but: tuple[int, ...] | None = None) -> tuple[int, int]:
        """(what groups of this gap give for one piece: nothing, one or two; for two: one), ``but`` one group."""
        ones = twos = 0
        for items in self.by_gap[gap]:
            if items != but:
                one, two = self.bits[items]
                ones |= 1 | one | two
                twos |= one
        return ones, twos

    def receivable(self, gap: int) -> tuple[int, int, int, int]:
        """(lengths, sums of two) that groups of this gap may receive, giving less by ``gap`` at most; and ``given``."""
        if gap not in self.takes:
            ones, twos = self.given(gap)
            self.takes[gap] = _raised(ones, gap), _raised(twos, gap), ones, twos
        return self.takes[gap]

    def exchange(self, low: tuple[int, ...]) -> tuple | None:
        """(high, out of high, into high) that moves most into a sequence as full or fuller, the emptiest of equals."""
        one, two = self.bits[low]
        own = self.capacity - sum(low)
        best = None
        for gap in reversed(self.gaps[: bisect_right(self.gaps, own)]):
            if best is not None and gap <= best[0]:
                break  # no more than the gap can move
            ones, twos, ones_from, twos_from = self.takes.get(gap) or self.receivable(gap)
            ones &= one
            twos &= two
            if not (ones or twos):
                continue
            but = low if gap == own and self.count[low] < 2 else None
            if but:
                ones_from, twos_from = self.given(gap, but)
            more = max(_widest(ones, ones_from, gap) if ones else 0, _widest(twos, twos_from, gap) if twos else 0)
            if more > (best[0] if best is not None else 0):
                best = more, gap, but
        if best is None:
            return None
        more, gap, but = best
        for high in self.by_gap[gap]:
            a, aa = self.bits[high]
            if high != but and (one & (1 | a | aa) << more or two & a << more):
                break
        if one >> more & 1:
            return high, (), (more,)
        if got := one & a << more:
            x = got.bit_length() - 1
            return high, (x - more,), (x,)
        if got := one & aa << more:
            x = got.bit_length() - 1
            return high, _pair(high, x - more), (x,)
        x = (two & a << more).bit_length() - 1
        return high, (x - more,), _pair(low, x)


def _widest(mine: int, theirs: int, most: int) -> int:
    """The largest number up to ``most`` by which one of mine exceeds one of theirs; 0 without one."""
    best = 0
    while mine and best < most:
        x = mine.bit_length() - 1
        mine ^= 1 << x
        low = max(x - most, 0)
        above = theirs >> low
        if above:
            best = max(best, x - low - (above & -above).bit_length() + 1)
    return best


def _raised(bits: int, most: int) -> int:
    """All that exceeds one of these numbers by 1 to ``most``."""
    bits <<= 1
    width = 1
    while width < most:
        step = min(width, most - width)
        bits |= bits << step
        width += step
    return bits


def _pair(items: tuple[int, ...], total: int) -> tuple[int, int]:
    """Two of the items that have this sum."""
    have = set(items)
    return next((x, total - x) for x in items if total - x in have and (2 * x != total or items.count(x) > 1))


def best_fit(histogram: dict[int, int], capacity: int) -> list[tuple[int, tuple[int, ...]]]:
    """(number of sequences, lengths in each) by best fit from the longest length on, equal sequences at once."""
    gaps: list[int] = []  # sorted
    by_gap: dict[int, list[tuple[int, tuple[int, ...]]]] = {}

    def put(n: int, items: tuple[int, ...], gap: int) -> None:
        if not n:
            return
        if gap not in by_gap:
            by_gap[gap] = []
            insort(gaps, gap)
        by_gap[gap].append((n, items))

    for length in sorted(histogram, reverse=True):
        left = histogram[length]
        while left:
            k = bisect_left(gaps, length)
            if k < len(gaps):
                gap = gaps[k]
                n, items = by_gap[gap].pop()
                if not by_gap[gap]:
                    del by_gap[gap], gaps[k]
            else:
                gap, items = capacity, ()
                n = -(-left // (capacity // length))
            each = gap // length
            full = min(n, left // each)
            put(full, items + (length,) * each, gap - each * length)
            left -= full * each
            rest = left if full < n and left < each else 0
            if rest:  # the last few
                put(1, items + (length,) * rest, gap - rest * length)
                left = 0
            if items:
                put(n - full - bool(rest), items, gap)
    return [group for groups in by_gap.values() for group in groups]


def local_search(groups: list[tuple[int, tuple[int, ...]]], capacity: int, most: int | None = None) -> list[tuple[int, tuple[int, ...]]]:
    """Moves, one-for-one and two-for-one exchanges (either way) until none is left that fills a fuller sequence more.

    Works on groups: an exchange between two groups is made for as many pairs of sequences as the smaller group has, so
    their number follows from how many different sequences there are, not from how many. The groups with most room give
    first, all that are as full or fuller and not full may receive, so squared fill grows. Partners
    are found by gap and by length or sum of two lengths, so none is left out. A sequence whose pieces have all moved
    disappears; the search also ends when no fewer sequences could hold the pieces, or after ``most`` exchanges.
    """
    done = [(n, items) for n, items in groups if sum(items) == capacity]
    pool = Underfull(capacity)
    for n, items in groups:
        if sum(items) < capacity:
            pool.add(tuple(sorted(items, reverse=True)), n)
    spare = sum(n for n, _ in groups) - least_sequences(groups, capacity)
    room = lambda key: ((sum(key) - capacity) * pool.count[key], key)
    changed, made = True, 0
    while changed and spare > 0 and made != most:
        heap = [room(key) for key in pool.count]
        heapify(heap)
        changed = False
        while heap and spare > 0 and made != most:
            _, low = heappop(heap)
            if low not in pool.count or (found := pool.exchange(low)) is None:
                continue
            high, out, into = found
            n = min(pool.count[low], pool.count[high]) if low != high else pool.count[low] // 2
            new_low, new_high = list(low), list(high)
            for x in into:
                new_low.remove(x)
                new_high.append(x)
            for x in out:
                new_high.remove(x)
                new_low.append(x)
            for key in (low, high):
                pool.add(key, -n)
            for items in (new_low, new_high):
                if not items:
                    spare -= n
                elif sum(items) == capacity:
                    done.append((n, tuple(items)))
                else:
                    key = tuple(sorted(items, reverse=True))
                    pool.add(key, n)
                    heappush(heap, room(key))
            if low in pool.count:
                heappush(heap, room(low))
            changed = True
            made += 1
    return done + [(n, items) for items, n in pool.count.items()]


def least_sequences(groups: list[tuple[int, tuple[int, ...]]], capacity: int) -> int:
    return -(-sum(n * sum(items) for n, items in groups) // capacity)


def packed(histogram: dict[int, int], capacity: int, most: int = EXCHANGES) -> list[tuple[int, tuple[int, ...]]]:
    """Groups of equal sequences that hold the pieces, searched from two starts, of which the better is taken.

    One start is next-fit, which leaves the search most to do; where it ends after ``most`` exchanges, the pieces of
    sequences that aren't full are dealt anew by best fit and searched again. The other is best fit from the beginning.
    Exchanges are as many for a histogram as for its multiple, hence so are time and the number of groups.
    """
    first = local_search(next_fit(histogram, capacity), capacity, most)
    full, rest = [g for g in first if sum(g[1]) == capacity], collections.Counter()
    for n, items in first:
        if sum(items) < capacity:
            rest.update({x: n * items.count(x) for x in set(items)})
    dealt = [*full, *best_fit(rest, capacity)]
    settled = min(first, dealt, key=lambda groups: sum(n for n, _ in groups))
    found = [local_search(start, capacity, most) for start in (settled, best_fit(histogram, capacity))]
    return min(found, key=lambda groups: sum(n for n, _ in groups))


def plan(histogram: dict[int, int], capacity: int) -> dict[str, np.ndarray]:
    """Runs of ranks: of each length, from which rank on, how many, in which sequences, at which offset."""
    used: dict[int, int] = {}
    runs, sequence = [], 0
    for n, items in packed(histogram, capacity):
        offset = 0
        for length in items:
            rank = used.get(length, 0)
            runs.append((length, rank, sequence, offset))
            used[length] = rank + n
            offset += length
        sequence += n
    assert used == histogram, "the plan places other pieces than there are"
    runs.sort()
    a = np.array(runs, np.int64).reshape(-1, 4)
    return {"key": a[:, 0] << 44 | a[:, 1], "rank": a[:, 1], "sequence": a[:, 2], "offset": a[:, 3]}


def _place(sent) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = sent.value
        for batch in batches:
            col = {n: batch.column(n) for n in batch.schema.names}
            length, rank = col["length"].to_numpy(), col["rank"].to_numpy()
            at = np.searchsorted(table["key"], length << 44 | rank, "right") - 1
            sequence = table["sequence"][at] + rank - table["rank"][at]
            yield pa.RecordBatch.from_arrays(
                [*(col[n] for n in ("id", "piece", "start", "length", "ids_crc32")), pa.array(sequence), pa.array(table["offset"][at])],
                names=["id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"],
            )

    return run


def best_fit_packing(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", capacity: int = CAPACITY, tokenizer: str | None = None) -> DataFrame:
    """One row a piece: where it stands in its document, its ids' CRC, and its place in a sequence."""
    spark = docs.sparkSession
    staging.ship(spark)
    kind = docs.schema[id_col].dataType.simpleString()
    schema = f"id {kind}, piece int, start long, length long, ids_crc32 long, task long, place long"
    source = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    pieces = staging.stage(source.mapInArrow(cut_pieces(tokenizer or tokenizer_path(), capacity), schema), "pieces")
    by_task = pieces.groupBy("length", "task").agg(F.count("*").alias("n"))
    before = F.sum("n").over(Window.partitionBy("length").orderBy("task").rowsBetween(Window.unboundedPreceding, -1))
    by_task = by_task.select("length", "task", F.coalesce(before, F.lit(0)).alias("before"))
    histogram = {r.length: r.n for r in pieces.groupBy("length").agg(F.count("*").alias("n")).collect()}
    ranked = pieces.join(by_task, ["length", "task"]).withColumn("rank", F.col("before") + F.col("place"))
    ranked = ranked.select("id", "piece", "start", "length", "ids_crc32", "rank")
    out = f"{id_col} {kind}, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long"
    placed = ranked.mapInArrow(_place(spark.sparkContext.broadcast(plan(histogram, capacity))), out.replace(id_col, "id", 1))
    return placed.withColumnRenamed("id", id_col)
