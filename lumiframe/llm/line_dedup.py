"""Fuzzy line deduplication: MinHash bands over character shingles, exact verification, distributed union-find.

A line is its set of distinct character shingles after trimming white space and lower-casing A-Z (a shorter line: the
whole of it). With a character inside changed, lines stay linked from 39 characters on by shingles of 4, from 79 on by
shingles of 8. One-permutation MinHash fills 72 bins from one hash a shingle, three times; empty bins borrow from the next
full one. Each signature gives nine bands of eight bins; the 27 find a pair of similarity 0.8 with a probability above
0.99, of 0.9 with one above 0.99999. Lines of one language that have nothing else in common are similar by 0.1 to 0.3
and seldom meet, in a large corpus too. The keys, with the line and the level of its set's size, are shuffled once, 14 bytes
each, and lines that meet in a band part again where their sizes rule out a link. The others are compared by the pairs and
the bucket stars of `linking`, each link verified on the whole shingle sets, which are made from the texts of the pairs that
the profiles don't rule out; other texts aren't shuffled."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lumiframe.llm import words as W
from lumiframe.llm.linking import BITS, DEALT, EXTRA, MEMBER, NEVER, PAIR, ROW, bitmap, deal_keys, deal_rows, distinct_buckets, in_bitmap, levels, link_components, met, part_bits
from lumiframe.llm.storage import Scratch

SHINGLE, BINS, HASHES, BANDS, ROWS = 8, 72, 3, 9, 8
#: Bytes of text that are worked on at once: few enough that their arrays stay in the processor's cache.
SLICE = 1 << 16
#: Pairs whose nodes are sent to the executors, at most.
FEW = 100_000
#: Bits of a line's profile, at most; a line of fewer shingles has a shorter one (see _width).
PROFILE = 1024
_BLACK = np.ones(256, dtype=bool)
_BLACK[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = False
_NONE = np.uint64(2**64 - 1)
_HALF = np.uint64(32)
#: Of a key (row, hash) the upper 16 bits are the row, so at most so many rows are worked on at once.
_ROW, _ROWS_AT_ONCE = np.uint64(48), 1 << 14


class Lines:
    """The lines of a slice of texts: text, place in it, trimmed byte range and hash; blank lines have no range."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray):
        breaks = np.flatnonzero(data == 10)
        starts = np.unique(np.concatenate([offsets[:-1], breaks + 1])) if len(data) else offsets[:-1]
        full = np.diff(offsets) > 0
        starts = starts[starts < len(data)] if len(data) else starts[:0]
        # a text that ends in a line break has a last, blank line; it needs no row
        doc = np.searchsorted(offsets, starts, side="right") - 1
        nexts = np.append(starts[1:], len(data))
        ends = nexts - ((nexts > starts) & (data[nexts - 1] == 10)) if len(starts) else nexts[:0]
        head = np.zeros(len(starts), dtype=np.int64)
        first = np.concatenate([[True], doc[1:] != doc[:-1]]) if len(doc) else np.zeros(0, bool)
        head[first] = np.flatnonzero(first)
        self.place = np.arange(len(starts)) - np.maximum.accumulate(head) if len(starts) else head
        self.doc = doc
        black = np.flatnonzero(_BLACK[data])
        lo, hi = np.searchsorted(black, starts), np.searchsorted(black, ends)
        self.real = hi > lo
        safe = black if len(black) else np.zeros(1, np.int64)
        self.start = np.where(self.real, safe[np.minimum(lo, len(safe) - 1)], starts)
        self.end = np.where(self.real, safe[np.maximum(hi - 1, 0)] + 1, starts)
        self.data = data
        self._up, self._down = W._powers(len(data) + 1)
        self._total = np.zeros(len(data) + 1, dtype=np.uint64)
        np.cumsum(W._BYTE[data] * self._up[: len(data)], out=self._total[1:])
        self.hash = W.mix(self._span(self.start, self.end) + (self.end - self.start).astype(np.uint64))
        self.any = full

    def _span(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        return (self._total[b] - self._total[a]) * self._down[a]

    def shingles(self, size: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
        """(hash, line's place among the real lines) of every shingle of the real lines, in line order."""
        lines = np.flatnonzero(self.real)
        lo, hi, at, up = self.start[lines], self.end[lines], self._total, self._down[: len(self.data)]
        if len(self.data) and self.data.max() >= 0x80:
            chars = np.flatnonzero((self.data & 0xC0) != 0x80)
            lo, hi = np.searchsorted(chars, lo), np.searchsorted(chars, hi)
            at, up = np.append(at[chars], at[-1]), up[chars]
        every = (at[size:] - at[:-size]) * up[: len(up) - size + 1] if len(up) >= size else np.zeros(1, dtype=np.uint64)
        n = np.maximum(hi - lo - size + 1, 1)
        before = np.cumsum(n) - n
        place = np.repeat(lo - before, n)
        place += np.arange(len(place))
        out = every[np.minimum(place, len(every) - 1, out=place)]
        short = np.flatnonzero(hi - lo < size)
        whole = lines[short]
        out[before[short]] = self._span(self.start[whole], self.end[whole]) + (hi - lo)[short].astype(np.uint64) * W.PLACE[17]
        return W.mix(out), np.repeat(np.arange(len(lines)), n)


def _signature(hashes: np.ndarray, owner: np.ndarray, lines: int) -> np.ndarray:
    """(lines, BINS): the least hash of each bin; an empty bin has that of the next full one, changed by its distance."""
    bins = hashes >> _HALF
    bins *= np.uint64(BINS)
    bins >>= _HALF
    bins = bins.view(np.int64)
    bins += owner * BINS
    sig = np.full(lines * BINS, _NONE)
    np.minimum.at(sig, bins, hashes)
    held = sig != _NONE
    full, empty = np.flatnonzero(held), np.flatnonzero(~held)
    if len(empty):
        before = np.zeros(len(sig) + 1, dtype=np.int64)
        np.cumsum(held, out=before[1:])
        line = empty // BINS
        following = before[empty]  # its place in full
        beyond = following == before[(line + 1) * BINS]
        following[beyond] = before[line[beyond] * BINS]
        following = full[following]
        gap = following - empty
        gap[beyond] += BINS
        sig[empty] = sig[following] + gap.astype(np.uint64) * W.PLACE[18]
    return sig.reshape(lines, BINS)


def band_keys(hashes: np.ndarray, owner: np.ndarray, lines: int) -> np.ndarray:
    """(lines, HASHES * BANDS) keys; owner is the line of each hash. Each signature gives BANDS of them."""
    out = np.zeros((lines, HASHES * BANDS), dtype=np.uint64)
    for j in range(HASHES):
        parts = _signature(hashes * W.PLACE[20 + j], owner, lines)[:, : BANDS * ROWS].reshape(lines, BANDS, ROWS)
        own = np.arange(j * BANDS, (j + 1) * BANDS)
        out[:, own] = W.mix((parts * W.PLACE[:ROWS]).sum(axis=2, dtype=np.uint64) + own.astype(np.uint64) * W.PLACE[19])
    return out


def _distinct(hashes: np.ndarray, owner: np.ndarray, lines: int) -> np.ndarray:
    """How many distinct hashes (48 bits, as in _line_sets) each line has; every line has one."""
    out = []
    for at in range(0, lines, 1 << 16):
        a, b = np.searchsorted(owner, [at, at + (1 << 16)]) if lines > 1 << 16 else (0, len(owner))
        keys = _set_keys(hashes[a:b].copy(), owner[a:b] - at)
        out.append(np.bincount((keys >> _ROW).view(np.int64), minlength=min(lines - at, 1 << 16)))
    return np.concatenate(out) if out else np.zeros(0, dtype=np.int64)


#: Lines whose hashes a task remembers, and whose keys it deals out at once, at most.
REMEMBERED, AT_ONCE = 1_000_000, 1 << 15


def _signed(size: int, bits: int):
    """The real lines of documents (doc, line, node), and the keys of those that the task hasn't met before, dealt out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        W.keep_memory()
        met: set[int] = set()
        held: list[tuple[np.ndarray, ...]] = []  # of lines that are all in met
        for batch in batches:
            null = batch.column(0).is_null().to_numpy(zero_copy_only=False)
            doc = batch.column(0).fill_null(0).to_numpy()
            for at, data, offsets in W.raw(batch.column(1), SLICE):
                lines = Lines(data, offsets)
                real = np.flatnonzero(lines.real)
                row = at + lines.doc[real]
                yield from deal_rows(doc[row], lines.place[real].astype(np.int64), lines.hash[real].view(np.int64), null[row])
                unique, once = np.unique(lines.hash[real], return_index=True)
                fresh = np.sort(once[[h not in met for h in unique.tolist()]]) if len(once) else once
                met.update(unique.tolist())
                lines.real = np.zeros(len(lines.real), dtype=bool)
                lines.real[real[fresh]] = True
                hashes, owner = lines.shingles(size)
                held.append((band_keys(hashes, owner, len(fresh)), lines.hash[real[fresh]], levels(_distinct(hashes, owner, len(fresh)))))
                if sum(len(x[1]) for x in held) >= AT_ONCE:
                    yield from deal_keys(*map(np.concatenate, zip(*held, strict=True)), bits)
                    held = []
                    if len(met) >= REMEMBERED:
                        met.clear()
        if held:
            yield from deal_keys(*map(np.concatenate, zip(*held, strict=True)), bits)

    return run


def _wanted(wanted, size: int):
    """(hash, n, profile, text) of the lines whose slot is in the bitmap `wanted`, once in a task while it remembers them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        W.keep_memory()
        met: set[int] = set()
        for batch in batches:
            for _, data, offsets in W.raw(batch.column(0), SLICE):
                lines = Lines(data, offsets)
                real = np.flatnonzero(lines.real)
                node = lines.hash[real].view(np.int64)
                _, once = np.unique(node, return_index=True)
                once = once[in_bitmap(wanted.value, node[once] & (BITS - 1))]
                once = once[[h not in met for h in node[once].tolist()]] if len(once) else once
                if len(met) >= REMEMBERED:
                    met.clear()
                met.update(node[once].tolist())
                real = np.sort(real[once])
                for at in range(0, len(real), 1000):
                    own = real[at : at + 1000]
                    text = pa.array([lines.data[a:b].tobytes() for a, b in zip(lines.start[own], lines.end[own], strict=True)], pa.binary()).cast(pa.string())
                    lines.real = np.zeros(len(lines.real), dtype=bool)
                    lines.real[own] = True
                    hashes, owner = lines.shingles(size)
                    keys = _set_keys(hashes, owner)
                    n = np.bincount((keys >> _ROW).view(np.int64), minlength=len(own))
                    yield pa.RecordBatch.from_arrays([pa.array(lines.hash[own].view(np.int64)), pa.array(n.astype(np.int64)), _short(_profiles(keys, len(own)), n), text], names=["node", "n", "profile", "text"])

    return run


def _set_keys(hashes: np.ndarray, row: np.ndarray) -> np.ndarray:
    """Sorted distinct keys (row, 48 bits of the hash); changes hashes."""
    hashes >>= np.uint64(16)
    hashes |= row.astype(np.uint64) << _ROW
    hashes.sort()
    return hashes[np.concatenate([[True], hashes[1:] != hashes[:-1]])] if len(hashes) else hashes


def _line_sets(column: pa.Array, size: int) -> np.ndarray:
    """The shingle sets of the texts as sorted distinct keys: the row, then 48 bits of a shingle's hash. A text is one line, its
    breaks were cut before; column has at most 2**16 rows."""
    keys = [np.zeros(0, dtype=np.uint64)]
    for at, data, offsets in W.raw(column, SLICE):
        lines = Lines(data, offsets)
        hashes, owner = lines.shingles(size)
        keys.append(_set_keys(hashes, lines.doc[lines.real][owner] + at))
    return np.concatenate(keys)


def _profiles(keys: np.ndarray, rows: int) -> np.ndarray:
    """(rows, PROFILE / 8) bytes: each element of a row's set turns one bit over. Two sets differ in at least as many elements as
    their profiles differ in bits, and seldom in many more."""
    place = (keys >> _ROW) * np.uint64(PROFILE) + (keys & np.uint64(PROFILE - 1))
    odd = np.bincount(place.view(np.int64), minlength=rows * PROFILE).astype(np.uint8) & 1
    return np.packbits(odd.reshape(rows, PROFILE), axis=1)


def _width(n: np.ndarray) -> np.ndarray:
    """Bytes of the profile of a set of n: the least power of two of at least n bits, from PROFILE / 8 to PROFILE bits."""
    return (PROFILE // 64) << np.searchsorted(PROFILE // 8 * np.array([1, 2, 4]), n)


def _folded(profiles: np.ndarray, width: int) -> np.ndarray:
    """Profiles of `width` bytes from longer ones: bits that fall together are added, so each is again the parity of its
    elements."""
    return np.bitwise_xor.reduce(profiles.reshape(len(profiles), -1, width), axis=1)


def _short(profiles: np.ndarray, n: np.ndarray) -> pa.Array:
    """Profiles of PROFILE bits, each folded to the width of its set's size n."""
    size = _width(n)
    cuts = np.concatenate([[0], np.cumsum(size)])
    data = np.zeros(cuts[-1], dtype=np.uint8)
    for width in np.unique(size).tolist():
        rows = np.flatnonzero(size == width)
        data[cuts[rows][:, None] + np.arange(width)] = _folded(profiles[rows], width)
    return pa.Array.from_buffers(pa.binary(), len(n), [None, pa.py_buffer(cuts.astype(np.int32).tobytes()), pa.py_buffer(data.tobytes())])


def _apart(num: int, den: int):
    """At least how many elements lie in one of two sets only, NEVER beyond what the similarity allows."""

    def test(n: np.ndarray, profiles: np.ndarray, m: np.ndarray, others: np.ndarray) -> np.ndarray:
        out = np.full(len(n), NEVER)
        at = np.flatnonzero(np.minimum(n, m) * den >= np.maximum(n, m) * num)
        allowed = n[at] + m[at] - 2 * -(-num * (n[at] + m[at]) // (num + den))
        own, its = _width(n[at]), _width(m[at])
        shared = min(profiles.shape[1], others.shape[1])  # equal widths: what follows is zeros, or more of both
        for x, y in {*zip(own.tolist(), its.tolist(), strict=True)}:
            rows = np.flatnonzero((own == x) & (its == y))
            if x == y:
                a, b = (np.ascontiguousarray(p[at[rows], :shared]) for p in (profiles, others))
            else:
                a, b = (_folded(p[at[rows], :w], min(x, y)) for p, w in ((profiles, x), (others, y)))
            far = np.bitwise_count(a.view(np.uint64) ^ b.view(np.uint64)).sum(axis=1, dtype=np.int32)
            out[at[rows]] = np.where(far <= allowed[rows], far, NEVER)
        return out

    return test


def _verify(num: int, den: int, size: int):
    """Of rows (a, b, text of a, text of b), the pairs that are linked."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        W.keep_memory()
        for batch in batches:
            for at in range(0, batch.num_rows, _ROWS_AT_ONCE):
                part = batch.slice(at, _ROWS_AT_ONCE)
                both = np.concatenate([_line_sets(part.column(i), size) for i in (2, 3)])
                both.sort()
                row = lambda keys: np.bincount((keys >> _ROW).view(np.int64), minlength=part.num_rows)  # noqa: E731, B023
                inter = row(both[1:][both[1:] == both[:-1]])
                keep = pa.array(inter * den >= num * (row(both) - inter))
                yield pa.RecordBatch.from_arrays([part.column(i).filter(keep) for i in (0, 1)], names=["a", "b"])

    return run


def line_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", num: int = 80, den: int = 100, scratch: Scratch | None = None, shingle: int = SHINGLE) -> DataFrame:
    """One row per line that isn't blank: (id_col, line from 0, component, keep). keep holds for the first line of each
    component of linked lines, by id and then place. Equal lines are linked; two others are if their sets of
    `shingle` characters have a Jaccard similarity of num/den or more and they meet in a band.

    Null and empty texts have no rows. A null id sorts last. Rows of one id are one document: their lines of one
    place and content are kept or dropped alike. Other columns are ignored. Lines are told apart by 64-bit hashes."""
    spark = docs.sparkSession
    scratch = scratch or Scratch(spark, "line-dedup")
    base = docs.select(F.col(id_col).cast("bigint").alias("doc"), F.col(text_col).alias("text"))
    dealt = base.mapInArrow(_signed(shingle, part_bits(spark)), DEALT)
    found = met(dealt, num, den, scratch)
    scratch.release()
    lines = found.filter(F.col("kind") == ROW).select(F.col("a").alias("doc"), F.col("b").alias("line"), F.col("c").alias("node"))
    small = found.filter(F.col("kind") == PAIR).select("a", "b")
    members = found.filter(F.col("kind").isin(MEMBER, EXTRA)).select(F.col("a").alias("key"), F.col("b").alias("node"))
    if not found.filter(F.col("kind") == EXTRA).isEmpty():
        members = scratch.save(members.distinct(), "shared")
    members = distinct_buckets(members, scratch)

    nodes = members.select("node").unionByName(small.select(F.explode(F.array("a", "b")).alias("node")))
    # the bitmap spares the shuffle of lines that share no band
    wanted = spark.sparkContext.broadcast(bitmap(nodes, F.pmod("node", F.lit(BITS)).cast("bigint")))
    # texts stay where they are written, once for each task that has the line; only those of pairs are shuffled
    own = scratch.save(base.select("text").mapInArrow(_wanted(wanted, shingle), "node bigint, n bigint, profile binary, text string"), "own")
    wanted.destroy()
    profiles = scratch.save(own.select("node", "n", "profile").dropDuplicates(["node"]), "profiles")

    def verify(pairs: DataFrame) -> DataFrame:
        ends = pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct()
        held = own.select("node", "text").join(F.broadcast(ends) if pairs.limit(FEW + 1).count() <= FEW else ends, "node", "left_semi").dropDuplicates(["node"])
        side = lambda end: held.select(F.col("node").alias(end), F.col("text").alias(f"t{end}"))
        texts = pairs.join(side("b"), "b").join(side("a"), "a")
        return texts.select("a", "b", "ta", "tb").mapInArrow(_verify(num, den, shingle), "a bigint, b bigint")

    none = spark.createDataFrame([], "a bigint, b bigint")
    components = link_components(members, profiles, _apart(num, den), verify, scratch, none, small)
    scratch.drop(members, own, profiles)
    named = lines.join(components, "node", "left").select("doc", "line", F.coalesce("component", "node").alias("component"))
    named = scratch.save(named, "named")
    scratch.drop(found)
    place = F.struct(F.col("doc").isNull().alias("last"), "doc", "line")
    # a component of one line keeps it
    best = named.groupBy("component").agg(F.min(place).alias("best"), F.count("*").alias("n")).filter("n > 1").select("component", "best")
    out = named.join(scratch.save(best, "best"), "component", "left")
    first = F.col("doc").eqNullSafe(F.col("best.doc")) & (F.col("line") == F.col("best.line"))
    return out.select(F.col("doc").alias(id_col), "line", "component", (F.col("best").isNull() | first).alias("keep"))


def dedup_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", num: int = 80, den: int = 100, shingle: int = SHINGLE) -> DataFrame:
    """docs with the dropped lines cut out of their texts; blank lines and null texts stay as they are. The other
    columns are unchanged; rows keep their number."""
    dropped = line_components(docs, id_col, text_col, num, den, shingle=shingle).filter("not keep").groupBy(id_col).agg(F.collect_set("line").alias("_dropped"))
    joined = docs.alias("d").join(dropped.alias("x"), F.col(f"d.{id_col}").eqNullSafe(F.col(f"x.{id_col}")), "left")
    kept = F.expr(f"array_join(transform(filter(transform(split({text_col}, '\\n', -1), (v, i) -> struct(v, bigint(i) as i)), x -> not array_contains(_dropped, x.i)), x -> x.v), '\\n')")
    text = F.when(F.col("_dropped").isNull(), F.col(f"d.{text_col}")).otherwise(kept)
    return joined.select(*[text.alias(c) if c == text_col else F.col(f"d.{c}") for c in docs.columns])
