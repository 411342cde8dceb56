"""Benchmark decontamination: SimHash of item-sized windows, multi-index Hamming search, exact verification.

Features are 5-word shingles. Windows of every item's own size slide over a document, at every start. A window that is
similar to an item holds at least `threshold` of the item's weight in shingles that items hold; running sums of these
weights rule out all other windows of a size at once, without loss. The fingerprints of the windows that are left come
from running bit counts. Four 16-bit blocks index the items; a window looks up all values within distance 3 of its blocks:
two fingerprints within RADIUS = 15 agree within 3 on some block, so no such pair is missed. Similar windows whose
fingerprints lie farther apart are found by what they share with the item itself. Candidates are verified exactly:
weighted Jaccard of the item and the window, a shingle weighing more the fewer items hold it."""

from __future__ import annotations

import itertools
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from lumiframe.llm import words as W
from lumiframe.llm.storage import small_batches

SHINGLE, RADIUS = 5, 15
#: Items that are sent to the executors at once; a larger benchmark is searched in several passes.
ITEMS_AT_ONCE = 20_000
#: Windows that are looked up at once.
AT_ONCE = 2048
_NEAR = np.array([sum(1 << i for i in c) for k in range(RADIUS // 4 + 1) for c in itertools.combinations(range(16), k)], dtype=np.uint16)


def _bits(hashes: np.ndarray) -> np.ndarray:
    return np.unpackbits(hashes.view(np.uint8)).reshape(-1, 64)


def _pack(bits: np.ndarray) -> np.ndarray:
    return np.packbits(bits, axis=1).view(np.uint64).ravel()


def fingerprint(hashes: np.ndarray) -> int:
    """SimHash: each bit is that of most features."""
    return int(_pack(2 * _bits(hashes).sum(axis=0, dtype=np.int64)[None] > len(hashes))[0])


class HammingIndex:
    """Fingerprints by their four 16-bit blocks; search() finds all within RADIUS."""

    def __init__(self, prints: np.ndarray):
        self.prints, self.order, self.start = prints, [], []
        for b in range(4):
            value = self._block(prints, b)
            order = np.argsort(value, kind="stable")
            self.order.append(order.astype(np.int32))
            self.start.append(np.searchsorted(value[order], np.arange(65537)).astype(np.int32))

    @staticmethod
    def _block(prints: np.ndarray, b: int) -> np.ndarray:
        return ((prints >> np.uint64(16 * b)) & np.uint64(0xFFFF)).astype(np.uint16)

    def search(self, prints: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Pairs (place in prints, item)."""
        rows, items = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        for at in range(0, len(prints), AT_ONCE):
            own = prints[at : at + AT_ONCE]
            for b in range(4):
                near = self._block(own, b)[:, None] ^ _NEAR[None, :]
                n = np.diff(self.start[b])[near]
                w, v = np.nonzero(n)
                n, lo = n[w, v], self.start[b][near[w, v]]
                row = np.repeat(w, n)
                item = self.order[b][np.repeat(lo - np.concatenate([[0], np.cumsum(n)[:-1]]), n) + np.arange(n.sum())] if len(n) else np.zeros(0, np.int64)
                close = np.bitwise_count(own[row] ^ self.prints[item]) <= RADIUS
                rows.append(at + row[close])
                items.append(item[close].astype(np.int64))
        pairs = np.unique(np.stack([np.concatenate(rows), np.concatenate(items)]), axis=1)
        return pairs[0], pairs[1]


def item_shingles(texts: pa.Array) -> Iterator[np.ndarray]:
    """The shingles of each text in order."""
    for _, words in W.slices(texts):
        hashes, at = W.shingles(words, SHINGLE)
        bounds = np.searchsorted(at, words.first)
        for d in range(words.docs):
            yield hashes[bounds[d] : bounds[d + 1]]


class Benchmark:
    """Items (id, text) with words. held: (sorted shingles, by how many items each is held) and the number of items of the
    whole benchmark, if the items are only a part of it."""

    def __init__(self, items: list[tuple], threshold: float, held: tuple[np.ndarray, np.ndarray, int] | None = None):
        self.threshold = threshold
        found = list(zip((i for i, _ in items), item_shingles(pa.array([t for _, t in items], pa.large_string())), strict=True))
        self.ids = [i for i, h in found if len(h)]
        self.hashes = [h for _, h in found if len(h)]
        sets = [np.unique(h, return_counts=True) for h in self.hashes]
        flat = np.concatenate([*(u for u, _ in sets), np.zeros(0, np.uint64)])
        self.all, times = np.unique(flat, return_counts=True)
        total = len(self.ids)
        if held is not None:
            times, total = held[1][np.searchsorted(held[0], self.all)], held[2]
        self.weight = 1 + np.log((1 + total) / np.maximum(times, 1))
        self.rare = 1 + math.log(1 + total)
        #: of each item: places of its shingles in `all`, how often it holds each, and its weight
        self.own = [(np.searchsorted(self.all, u), c) for u, c in sets]
        self.total = np.array([(self.weight[u] * c).sum() for u, c in self.own])
        order = np.argsort(flat, kind="stable")
        self.holder = np.repeat(np.arange(total if held is None else len(self.ids)), [len(u) for u, _ in sets])[order]
        self.first = np.searchsorted(flat[order], self.all)
        self.first = np.append(self.first, len(flat))
        self.size = np.array([len(h) for h in self.hashes], dtype=np.int64)
        #: of each size: the least weight of its items
        self.sizes = np.unique(self.size)
        self.least = np.array([self.total[self.size == n].min() for n in self.sizes])
        self.index = HammingIndex(np.array([fingerprint(h) for h in self.hashes], dtype=np.uint64))

    def places(self, hashes: np.ndarray) -> np.ndarray:
        """The place of each shingle in `all`, -1 where no item holds it."""
        if not len(self.all):
            return np.full(len(hashes), -1)
        at = np.minimum(np.searchsorted(self.all, hashes), len(self.all) - 1)
        return np.where(self.all[at] == hashes, at, -1)

    def similarity(self, item: int, places: np.ndarray) -> float:
        """Weighted Jaccard of an item and a window's shingles."""
        own, times = self.own[item]
        at = np.minimum(np.searchsorted(own, places), len(own) - 1)
        inside = own[at] == places
        both = (self.weight[own] * np.minimum(times, np.bincount(at[inside], minlength=len(own)))).sum()
        window = np.where(places >= 0, self.weight[places], self.rare).sum()
        return float(both / (self.total[item] + window - both))

    def _fingerprints(self, hashes: np.ndarray, held: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(starts, sizes, fingerprints) of the item-sized windows of a text that hold enough known weight. held: running
        sums of it. A text that is shorter than a size is a window of that size itself."""
        m, starts, sizes = len(hashes), [], []
        for n, least in zip(self.sizes.tolist(), self.least.tolist(), strict=True):
            s = np.arange(max(1, m - n + 1))
            enough = s[held[np.minimum(s + n, m)] - held[s] >= (self.threshold - 1e-9) * least]
            starts.append(enough)
            sizes.append(np.full(len(enough), n))
        start, size = np.concatenate(starts), np.concatenate(sizes)
        if not len(start):
            return start, size, np.zeros(0, np.uint64)
        low, high = int(start.min()), int(min(m, (start + size).max()))
        run = np.zeros((high - low + 1, 64), dtype=np.int32)
        np.cumsum(_bits(hashes[low:high]), axis=0, dtype=np.int32, out=run[1:])
        prints = np.empty(len(start), dtype=np.uint64)
        for k in range(0, len(start), 8192):
            a, b = start[k : k + 8192] - low, np.minimum(start[k : k + 8192] + size[k : k + 8192], m) - low
            prints[k : k + 8192] = _pack(2 * (run[b] - run[a]) > (b - a)[:, None])
        return start, size, prints

    def _sharing(self, places: np.ndarray) -> list[int]:
        """The items of which a text holds enough weight for some window to be similar."""
        known = places[places >= 0]
        n = self.first[known + 1] - self.first[known]
        entry = np.repeat(self.first[known] - np.concatenate([[0], np.cumsum(n)[:-1]]), n) + np.arange(n.sum())
        item, which = np.unique(self.holder[entry], return_inverse=True)
        held = np.bincount(which, np.repeat(self.weight[known], n), minlength=len(item))
        return item[held >= (self.threshold - 1e-9) * self.total[item]].tolist()

    def _in_text(self, hashes: np.ndarray, places: np.ndarray) -> Iterator[tuple[int, float, int]]:
        """(item, similarity, first shingle) of the items that a text holds, best window each."""
        m, worth = len(hashes), np.where(places >= 0, self.weight[places], 0.0)
        held = np.concatenate([[0.0], np.cumsum(worth)])
        if held[-1] < (self.threshold - 1e-9) * self.least.min():
            return
        near: dict[int, set[int]] = {}
        start, size, prints = self._fingerprints(hashes, held)
        rows, items = self.index.search(prints)
        fits = size[rows] == self.size[items]
        for s, i in zip(start[rows[fits]].tolist(), items[fits].tolist(), strict=True):
            near.setdefault(i, set()).add(s)
        for i in self._sharing(places):
            n, own = int(self.size[i]), self.own[i][0]
            at = np.minimum(np.searchsorted(own, places), len(own) - 1)
            most = np.concatenate([[0.0], np.cumsum(np.where(own[at] == places, worth, 0.0))])
            s = np.arange(max(1, m - n + 1))
            # what a window shares with the item weighs at most this; the union weighs at least as much as the item
            s = s[most[np.minimum(s + n, m)] - most[s] >= (self.threshold - 1e-9) * self.total[i]]
            if len(s):
                near.setdefault(i, set()).update(s.tolist())
        for i, starts in near.items():
            n = int(self.size[i])
            best, at = max((round(self.similarity(i, places[s : s + n]), 9), -s) for s in starts)
            if best >= self.threshold:
                yield i, best, -at

    def hits(self, words: W.Words) -> list[tuple[int, int, float, int, int]]:
        """(text, item, similarity, first word, words) of the items that the texts hold, best window each."""
        hashes, at = W.shingles(words, SHINGLE)
        places = self.places(hashes)
        bounds = np.searchsorted(at, words.first)
        out = []
        for d in np.unique(np.searchsorted(bounds, np.flatnonzero(places >= 0), side="right") - 1).tolist():
            lo, hi = bounds[d], bounds[d + 1]
            for i, similarity, s in self._in_text(hashes[lo:hi], places[lo:hi]):
                count = int(words.first[d + 1] - words.first[d])
                out.append((d, i, similarity, s, min(int(self.size[i]) + SHINGLE - 1, count - s)))
        return out


def _parts_of(benchmark: DataFrame, id_col: str, text_col: str, threshold: float) -> Iterator[Benchmark]:
    """The benchmark, or its parts if it has more than ITEMS_AT_ONCE items. A shingle weighs the same in all parts."""
    items = benchmark.select(F.col(f"`{id_col}`").alias("i"), F.col(f"`{text_col}`").alias("t")).filter("t is not null")
    parts = max(1, -(-items.count() // ITEMS_AT_ONCE))
    if parts == 1:
        yield Benchmark([(r["i"], r["t"]) for r in items.collect()], threshold)
        return

    def held(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for h in item_shingles(batch.column(0)):
                if len(h):  # the place -1 counts items
                    yield pa.RecordBatch.from_pydict({"p": pa.array([-1] + [0] * len(u := np.unique(h))), "h": pa.array(np.append(np.zeros(1, np.uint64), u).view(np.int64))})

    counts = items.select("t").mapInArrow(held, "p bigint, h bigint").groupBy("p", "h").agg(F.count("*").alias("n"))
    total = counts.filter("p = -1").first()
    for k in range(parts):
        part = items.filter(F.pmod(F.xxhash64("i", "t"), F.lit(parts)) == k)
        own = part.select("t").mapInArrow(held, "p bigint, h bigint").filter("p = 0").select("h").distinct()
        table = counts.filter("p = 0").join(own, "h", "left_semi").select("h", "n").toArrow()
        h, n = table.column("h").to_numpy().view(np.uint64), table.column("n").to_numpy()
        order = np.argsort(h)
        yield Benchmark([(r["i"], r["t"]) for r in part.collect()], threshold, (h[order], n[order], total["n"] if total else 0))


def benchmark_hits(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", threshold: float = 0.8) -> DataFrame:
    """One row for each document and item that it holds: (id_col, item_col, similarity, first_word, n_words).

    A document holds an item if a window of the item's size in it has a weighted shingle similarity of at least
    `threshold` with the item; the best window is returned, the first of equals (to nine places). Null and word-less texts hold nothing; items without words are ignored; an item of fewer than five words is
    held only by a text that is this sequence. Repeated rows of either table give repeated hits. Other columns are
    ignored. docs aren't shuffled; of the benchmark at most ITEMS_AT_ONCE items are on the executors at once."""
    spark = docs.sparkSession
    small_batches(spark)
    base = docs.select(F.col(f"`{id_col}`").alias("d"), F.col(f"`{text_col}`").alias("t"))
    kind = benchmark.schema[item_col].dataType.simpleString()
    own = docs.schema[id_col].dataType.simpleString()
    of_item, out = to_arrow_type(benchmark.schema[item_col].dataType), None
    for part in _parts_of(benchmark, item_col, item_text_col, threshold):
        sent = spark.sparkContext.broadcast(part)  # a worker unpickles it once

        def run(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            bench = sent.value
            for batch in batches:
                for at, words in W.slices(batch.column(1)):
                    found = bench.hits(words) if bench.ids else []
                    columns = list(zip(*found, strict=True)) or [[]] * 5
                    yield pa.RecordBatch.from_arrays(
                        [batch.column(0).take(pa.array([at + d for d in columns[0]], pa.int64())), pa.array([bench.ids[i] for i in columns[1]], of_item), pa.array(columns[2], pa.float64()), pa.array(columns[3], pa.int64()), pa.array(columns[4], pa.int64())],
                        names=["d", "i", "s", "w", "n"],
                    )

        found = base.mapInArrow(run, f"d {own}, i {kind}, s double, w bigint, n bigint")
        out = found if out is None else out.unionByName(found)
    return out.select(F.col("d").alias(id_col), F.col("i").alias(item_col), F.col("s").alias("similarity"), F.col("w").alias("first_word"), F.col("n").alias("n_words"))


def decontaminate(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", threshold: float = 0.8) -> DataFrame:
    """docs without the rows that hold an item (see benchmark_hits), unchanged and unshuffled."""
    spark = docs.sparkSession
    small_batches(spark)
    out, names, at_col = docs, docs.columns, docs.columns.index(text_col)
    for part in _parts_of(benchmark, item_col, item_text_col, threshold):
        sent = spark.sparkContext.broadcast(part)  # a worker unpickles it once

        def run(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            bench = sent.value
            for batch in batches:
                for at, words in W.slices(batch.column(at_col)):
                    keep = np.ones(words.docs, dtype=bool)
                    for f in bench.hits(words) if bench.ids else []:
                        keep[f[0]] = False
                    yield pa.RecordBatch.from_arrays(batch.slice(at, words.docs).filter(pa.array(keep)).columns, names=names)

        out = out.mapInArrow(run, docs.schema)
    return out
