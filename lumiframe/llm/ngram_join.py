"""N-gram Jaccard join: exact set-similarity self-join by a partitioned universe and the pigeonhole principle.

A document is its set of distinct word shingles. Two sets with a Jaccard similarity of num/den or more differ in at
most t elements, where t follows from their sizes. The universe of shingles is hashed into m segments. If the segments
on which two sets are compared weigh more than t in all, the sets agree closely on at least one of them:

* a segment that is indexed as it is weighs 1 (the two subsets are equal, or differ in one element or more),
* a segment that is indexed with its one-deletion neighbourhood weighs 2 (they also meet if one lacks one element),
* an empty segment weighs 0, and one of a single element 1: empty subsets are never indexed.

Sizes are cut into bands; a set is indexed in its own band and, if it may have a partner there, in the next. Of every
band the plan (m, number of segments with neighbourhoods) is the one of least expected cost among those in which
nearly every set reaches the weight it needs. A set emits segments in one fixed order until their weight exceeds t;
of two sets, the one that stops earlier is covered by the other, so the guarantee holds. The rare sets that can't
reach the weight in some band are also indexed by a prefix of single shingles, which is exact among themselves, and any
pair with a set that does reach it is found in its segments. Candidates are verified on the whole shingle sets.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lumiframe.llm import words as W
from lumiframe.llm.linking import NEVER, bitmap, distinct_buckets, in_bitmap, link_components, shared_members, slot
from lumiframe.llm.storage import Scratch

BAND_RATIO = 1.5
#: Ranges of a set's profile.
PROFILE = 128
#: Sets whose fingerprints a task remembers, at most.
REMEMBERED = 500_000
_SEG, _ELEM, _KEY, _RESCUE = (np.uint64(x) for x in (0x1F83D9ABFB41BD6B, 0x5BE0CD19137E2179, 0x428A2F98D728AE22, 0x3956C25BF348B538))


def max_difference(size_sum: int, num: int, den: int) -> int:
    """The most elements in which two sets of this size sum, or a smaller one, may differ at a similarity of num/den."""
    return max(s - 2 * -(-num * s // (num + den)) for s in (size_sum, size_sum - 1))


def bands(num: int, den: int, largest: int = 1 << 40) -> list[int]:
    """Lower ends of the size bands; the first is the least size that may have a partner of another content."""
    lo = next(n for n in range(1, 10**6) if max_difference(2 * n, num, den) > 0 or n * den // num > n)
    out = [lo]
    while out[-1] < largest:
        out.append(max(out[-1] * den // num + 1, int(out[-1] * BAND_RATIO)))
    return out


def _weights(n: int, m: int, k: int) -> tuple[float, float, float]:
    """(expected weight, its deviation, expected signatures) of a set of n elements; Poisson segments."""
    lam = n / m
    p0, p1 = math.exp(-lam), lam * math.exp(-lam)
    exact, near = 1 - p0, p1 + 2 * (1 - p0 - p1)
    weight = (m - k) * exact + k * near
    var = (m - k) * exact * (1 - exact) + k * (p1 + 4 * (1 - p0 - p1) - near**2)
    return weight, math.sqrt(max(var, 0.0)), (m - k) * exact + k * (exact + lam - p1)


@lru_cache(maxsize=256)
def plan(lo: int, hi: int, num: int, den: int) -> tuple[int, int]:
    """(segments, how many of them with one-deletion neighbourhoods) of least cost for sets of lo to hi - 1 elements
    and their smaller partners. Cost: signatures that a set emits before its weight suffices, plus segments of one
    element (they collide by chance), plus a price on sets that stay short of the weight."""
    need_hi = max_difference(2 * (hi - 1), num, den) + 1
    low = max(1, -(-lo * num // den))
    checks = [(low, max_difference(low + min(low * den // num, hi - 1), num, den) + 1), (hi - 1, need_hi)]
    best = (math.inf, 1, 0)
    step = max(1, need_hi // 24)
    for m in range(max(1, need_hi // 2), need_hi + need_hi // 3 + 4, step):
        for k in sorted({0, m // 4, m // 2, m}):
            cost = 0.0
            for n, need in checks:
                weight, dev, keys = _weights(n, m, k)
                short = math.erfc((weight - need + 0.5) / (dev + 1e-9) / math.sqrt(2)) / 2
                part = min(1.0, need / max(weight, 1e-9))
                cost += part * (keys + 2 * m * (n / m) * math.exp(-n / m)) + 20 * short * need
            best = min(best, (cost, m, k))
    return best[1], best[2]


def signatures(own: np.ndarray, lows: list[int], num: int, den: int) -> np.ndarray:
    """The index keys of a set of distinct hashes (sorted)."""
    n = len(own)
    if n < lows[0]:
        return np.zeros(0, dtype=np.uint64)
    band = int(np.searchsorted(lows, n, side="right")) - 1
    partner = n * den // num
    place, element = W.mix(own ^ _SEG) >> np.uint64(32), W.mix(own ^ _ELEM)
    out, short = [], False
    for b in (band, band + 1) if partner >= lows[band + 1] else (band,):
        m, k = plan(lows[b], lows[b + 1], num, den)
        need = max_difference(n + min(partner, lows[b + 1] - 1), num, den) + 1
        seg = ((place * np.uint64(m)) >> np.uint64(32)).astype(np.int64)
        count = np.bincount(seg, minlength=m)
        weight = np.minimum(count, np.where(np.arange(m) < k, 2, 1)).cumsum()
        last = int(np.searchsorted(weight, need))
        short |= last >= m
        total = np.zeros(m, dtype=np.uint64)
        np.add.at(total, seg, element)
        salt = W.mix(np.arange(m, dtype=np.uint64) * _KEY + np.uint64(b))
        used = np.flatnonzero(count[: last + 1])
        out.append(W.mix(total[used] + salt[used]))
        if k:
            at = np.flatnonzero((seg < min(k, last + 1)) & (count[seg] > 1))
            out.append(W.mix(total[seg[at]] - element[at] + salt[seg[at]]))
    if short:
        out.append(W.mix(own[: n - -(-num * n // den) + 1] ^ _RESCUE))
    return np.unique(np.concatenate(out))


def _index(shingle: int, num: int, den: int, wanted=None):
    """Rows of _SCHEMA for rows (node, text): with the index keys of the sets that the task hasn't met before or, for rows
    (node, text, slot) whose slot is in the bitmap `wanted`, with the sets themselves."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lows, keyed = bands(num, den), wanted is None
        met: set[int] = set()
        for batch in batches:
            if not keyed:
                batch = batch.filter(pa.array(in_bitmap(wanted.value, batch.column(2).to_numpy())))
            for at, words in W.slices(batch.column(1)):
                sizes, f1, f2, profiles, keys, cuts = [], [], [], [], [], [0]
                for own in W.shingle_sets(words, shingle):
                    sizes.append(len(own))
                    f1.append(int(W.mix(own).sum()))
                    f2.append(int(W.mix(own ^ _ELEM).sum()))
                    profiles.append(_profile(own) if keyed else None)
                    if not keyed:
                        keys.append(own)
                    elif (mark := (f1[-1] << 64) | f2[-1]) in met:
                        keys.append(own[:0])
                    else:
                        keys.append(signatures(own, lows, num, den))
                        if len(met) >= REMEMBERED:
                            met.clear()
                        met.add(mark)
                    cuts.append(cuts[-1] + len(keys[-1]))
                flat = np.concatenate(keys).view(np.int64)
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).slice(at, len(sizes)),
                        pa.array(sizes, pa.int64()),
                        pa.array(np.array(f1, dtype=np.uint64).view(np.int64)),
                        pa.array(np.array(f2, dtype=np.uint64).view(np.int64)),
                        pa.array(profiles, pa.binary()),
                        pa.ListArray.from_arrays(pa.array(cuts, pa.int32()), pa.array(flat)),
                    ],
                    names=["node", "n", "f1", "f2", "profile", "keys"],
                )

    return run


_SCHEMA = "node bigint, n bigint, f1 bigint, f2 bigint, profile binary, keys array<bigint>"


def _profile(own: np.ndarray) -> bytes:
    """The set's elements counted in PROFILE ranges of a hash. Two sets differ in at least the sum of the differences."""
    return np.minimum(np.bincount((W.mix(own ^ _RESCUE) >> np.uint64(57)).astype(np.int64), minlength=PROFILE), 255).astype(np.uint8).tobytes()


def _apart(num: int, den: int):
    """At least how many elements lie in one of two sets only, NEVER beyond what the similarity allows."""

    def test(n: np.ndarray, profiles: np.ndarray, m: np.ndarray, others: np.ndarray) -> np.ndarray:
        out = np.full(len(n), NEVER)
        at = np.flatnonzero(np.minimum(n, m) * den >= np.maximum(n, m) * num)
        allowed = n[at] + m[at] - 2 * -(-num * (n[at] + m[at]) // (num + den))
        far = (np.maximum(profiles[at], others[at]) - np.minimum(profiles[at], others[at])).sum(axis=1, dtype=np.int32)
        out[at] = np.where(far <= allowed, far, NEVER)
        return out

    return test


def _lists(column: pa.Array) -> list[np.ndarray]:
    flat = column.flatten().to_numpy(zero_copy_only=False)
    cuts = np.concatenate([[0], np.cumsum(pa.compute.list_value_length(column).to_numpy(zero_copy_only=False))]).astype(np.int64)
    return [flat[a:b] for a, b in zip(cuts[:-1], cuts[1:], strict=True)]


def _linked(num: int, den: int):
    def test(x: np.ndarray, y: np.ndarray) -> bool:
        """Whether two sets (each of distinct values) are similar enough."""
        both = np.sort(np.concatenate([x, y]))
        inter = int((both[1:] == both[:-1]).sum())
        return inter * den >= num * (len(both) - inter)

    return test


def _verify(num: int, den: int, load=_lists):
    """Of rows (a, b, content of a, content of b), the pairs that are linked; load makes a list of sets of contents."""
    test = _linked(num, den)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = pa.array([test(x, y) for x, y in zip(load(batch.column(2)), load(batch.column(3)), strict=True)], pa.bool_())
            yield pa.RecordBatch.from_arrays([batch.column(i).filter(keep) for i in (0, 1)], names=["a", "b"])

    return run


def ngram_jaccard_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 4, num: int = 85, den: int = 100, scratch: Scratch | None = None) -> DataFrame:
    """One row per row of docs: (id_col, n_shingles, component_id).

    A set is the distinct `shingle`-word shingles of the whole text (fewer words: the whole sequence as one). Two
    documents link when den * |intersection| >= num * |union|; component_id is the least id reachable by links.
    Null, empty and word-less texts have n_shingles 0 and their own id. A null id links with nothing and has a null
    component. Repeated rows give repeated results; rows of one id with different texts are one node of the graph.
    Other columns are ignored. The ids must be integers.

    Ids with equal sets meet by a fingerprint of the set (128 bits and its size); only one of them is compared
    with other sets, and a task gives the keys of equal sets once. Shuffled are index keys (16 bytes, about a quarter as many as shingles) and, for documents that
    share a key with another, their texts and sets."""
    spark = docs.sparkSession
    scratch = scratch or Scratch(spark, "ngram-join")
    texts = docs.select(F.col(id_col).cast("bigint").alias("node"), F.col(text_col).alias("text"))
    sets = scratch.save(texts.mapInArrow(_index(shingle, num, den), _SCHEMA), "sets")
    full = sets.filter("n > 0 and node is not null")

    narrow = full.select("node", "n", "f1", "f2")
    first = narrow.groupBy("n", "f1", "f2").agg(F.min("node").alias("rep"), F.max("node").alias("hi")).filter("rep < hi").select("n", "f1", "f2", "rep")
    same = scratch.save(narrow.join(first, ["n", "f1", "f2"]).filter("node <> rep").select("node", "rep").distinct(), "same")

    met = shared_members(full.select(F.explode("keys").alias("key"), "node"), scratch)
    keyed, sets = sets, scratch.save(sets.select("node", "n", "profile"), "sizes")
    scratch.drop(keyed)
    scratch.release()
    named = scratch.save(met.join(same, "node", "left").select("key", F.coalesce("rep", "node").alias("node")).distinct(), "members-of-sets")
    scratch.drop(met)
    members = distinct_buckets(named, scratch)

    wanted = spark.sparkContext.broadcast(bitmap(members, slot("node")))
    own = texts.filter("node is not null").select("node", "text", slot("node").alias("slot")).mapInArrow(_index(shingle, num, den, wanted), _SCHEMA)
    own = scratch.save(own.select("node", "keys"), "own")
    wanted.destroy()

    def verify(pairs: DataFrame) -> DataFrame:
        side = lambda end: own.select(F.col("node").alias(end), F.col("keys").alias(f"k{end}"))
        both = pairs.join(side("b"), "b").join(side("a"), "a")
        return both.select("a", "b", "ka", "kb").mapInArrow(_verify(num, den), "a bigint, b bigint")

    profiles = sets.filter("n > 0 and node is not null")
    components = link_components(members, profiles, _apart(num, den), verify, scratch, same.select(F.col("node").alias("a"), F.col("rep").alias("b")))
    scratch.drop(members, own)
    return sets.select("node", "n").join(components, "node", "left").select(F.col("node").alias(id_col), F.col("n").alias("n_shingles"), F.coalesce("component", "node").alias("component_id"))
