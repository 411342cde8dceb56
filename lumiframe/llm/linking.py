"""Components of a similarity graph from buckets of candidate nodes, without all pairs of a bucket.

Two linked nodes share a bucket. In a bucket every node is first compared with one pivot only, so a bucket of copies
costs as many comparisons as it has nodes; profiles rule most of the others out. What the stars have joined into one component needs no further comparison.
In buckets that still hold several components the profiles of nodes are compared: a profile bounds from above how
similar two nodes can be. First each node is verified with the nearest node of another component only, which joins most of a
group of near copies, and nodes without such a node are left out from then on; then the pairs across components that may
be linked become rows and are verified. No link between different components is lost."""

from __future__ import annotations

import functools
import itertools
import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lumiframe.llm import words as W
from lumiframe.llm.components import connected_components
from lumiframe.llm.storage import Scratch

#: A distance at which no link is possible.
NEVER = np.int32(2**31 - 1)
#: Nodes of one part of a bucket; larger buckets are compared part by part.
PART = 2048


#: One node in so many shows which keys are hot; hot is a key that HOT rows of those nodes hold, at most HOT_KEYS of them.
SHOWN, HOT, HOT_KEYS = 64, 64, 4096


def _repeated(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of rows (key, node) in order, the distinct ones whose key has another node. Only the last row is held back."""
    key, node, joined = np.zeros(0, np.int64), np.zeros(0, np.int64), False
    for batch in itertools.chain(batches, [None]):
        if batch is not None:
            if not batch.num_rows:
                continue
            key, node = (np.concatenate([old, batch.column(i).to_numpy()]) for i, old in enumerate((key, node)))
            new = np.concatenate([[True], (key[1:] != key[:-1]) | (node[1:] != node[:-1])])
            key, node = key[new], node[new]
        same = key[1:] == key[:-1]
        before = np.concatenate([[joined], same])[: len(key)]
        after = np.append(same, False)[: len(key)]
        done = len(key) if batch is None else len(key) - 1
        keep = np.flatnonzero((before | after)[:done])
        if len(keep):
            yield pa.RecordBatch.from_arrays([pa.array(key[keep]), pa.array(node[keep])], names=["key", "node"])
        if batch is not None:
            key, node, joined = key[done:], node[done:], bool(before[done])


def shared_members(keyed: DataFrame, scratch: Scratch) -> DataFrame:
    """The distinct rows (key, node; both bigint) whose key has two or more nodes: one shuffle by key, then one look at the
    sorted rows, which holds a single row back. A key with a large share of the rows would make one task of that; the
    hottest, by a sample of the nodes, pass without that shuffle (one that has a single node after all does no harm)."""
    seen = keyed.filter(F.pmod(F.xxhash64("node"), F.lit(SHOWN)) == 0).groupBy("key").agg(F.count("*").alias("n")).filter(F.col("n") >= HOT)
    hot = [r["key"] for r in seen.orderBy(F.desc("n"), "key").limit(HOT_KEYS).collect()]
    cold = keyed
    if hot:
        keys = F.broadcast(keyed.sparkSession.createDataFrame([(k,) for k in hot], "key bigint"))
        cold = keyed.join(keys, "key", "left_anti").select("key", "node")
    out = cold.repartition("key").sortWithinPartitions("key", "node").mapInArrow(_repeated, "key bigint, node bigint")
    if hot:
        out = out.unionByName(keyed.join(keys, "key", "left_semi").select("key", "node").distinct())
    return scratch.save(out, "shared")


#: What is dealt of a key and its node: 40 bits of the key, whose upper bits are the part it goes to, the level of the size of
#: the node's set (see levels), and the node.
ENTRY = np.dtype([("low", "<u4"), ("high", "u1"), ("level", "u1"), ("node", "<i8")])
#: A level of sizes holds sizes up to so many times its least.
LEVEL = 1.04
#: Nodes of one key that a deal sends to the key's part, at most; the others need no meeting. Buckets of up to SMALL nodes
#: are left as their pairs.
SENT, SMALL = 32, 4
DEALT = "part bigint, rows binary"
MET = "kind tinyint, a bigint, b bigint, c bigint"
#: Kinds of rows that `met` gives.
ROW, PAIR, MEMBER, EXTRA = 0, 1, 2, 3


def _blobs(part: np.ndarray, data: np.ndarray, cuts: np.ndarray) -> pa.RecordBatch:
    """Rows (part, bytes): the values of data between cuts."""
    cuts = (cuts * data.itemsize).astype(np.int32)
    return pa.RecordBatch.from_arrays([pa.array(part.astype(np.int64)), pa.Array.from_buffers(pa.binary(), len(part), [None, pa.py_buffer(cuts.tobytes()), pa.py_buffer(data.tobytes())])], names=["part", "rows"])


def _spread(kind: int, first: int) -> np.ndarray:
    """The part of rows that may go anywhere: negative, by their content, and it tells the kind."""
    return np.array([-4 * ((int(first) & 0xFFFFF) + 1) + kind])


def deal_rows(a: np.ndarray, b: np.ndarray, c: np.ndarray, null: np.ndarray) -> Iterator[pa.RecordBatch]:
    """Rows (a, b, c; a null where `null`) that pass `met` as they are, as ROW."""
    if len(c):
        data = np.concatenate([a.view(np.uint8), b.view(np.uint8), c.view(np.uint8), null.astype(np.uint8)])
        yield _blobs(_spread(ROW, c[0]), data, np.array([0, len(data)]))


def levels(n: np.ndarray) -> np.ndarray:
    """Levels of sizes from 1 on; the last one is open."""
    return np.minimum(np.log(n) / math.log(LEVEL), 255).astype(np.uint8)


def levels_apart(num: int, den: int) -> int:
    """How many levels two sets with a Jaccard similarity of num/den or more lie apart, at most."""
    return 255 if num <= 0 else min(255, math.floor(math.log(den / num) / math.log(LEVEL)) + 1)


def deal_keys(keys: np.ndarray, nodes: np.ndarray, level: np.ndarray, bits: int) -> Iterator[pa.RecordBatch]:
    """The keys (distinct nodes x keys of a node) dealt to 2**bits parts, as one row of bytes for a part. Of a key with many nodes SENT
    go to its part, which is enough to tell that it is shared; the others go anywhere, so that no part gets a group."""
    short = keys.ravel() >> np.uint64(24 - bits)
    order = np.argsort(short)
    short = short[order]
    order //= keys.shape[1]
    node, level = nodes[order].view(np.int64), level[order]
    more = np.zeros(len(short), dtype=bool)
    more[SENT:] = short[SENT:] == short[:-SENT]
    if more.any():
        own, its = short[more].view(np.int64), node[more]
        for at in range(0, len(own), 1 << 10):
            data = np.concatenate([own[at : at + (1 << 10)], its[at : at + (1 << 10)]]).view(np.uint8)
            yield _blobs(_spread(EXTRA, its[at]), data, np.array([0, len(data)]))
        short, node, level = short[~more], node[~more], level[~more]
    entries = np.empty(len(short), dtype=ENTRY)
    entries["low"], entries["high"] = short & np.uint64(0xFFFFFFFF), (short >> np.uint64(32)) & np.uint64(0xFF)
    entries["level"], entries["node"] = level, node
    part = (short >> np.uint64(40)).view(np.int64)
    first = np.flatnonzero(np.concatenate([[True], part[1:] != part[:-1]])) if len(part) else np.zeros(0, dtype=np.int64)
    yield _blobs(part[first], entries, np.append(first, len(part)))


def _bytes(column: pa.ChunkedArray | pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all rows, and how many each has."""
    column = (column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column).cast(pa.large_binary())
    cuts = np.frombuffer(column.buffers()[1], dtype=np.int64)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(column.buffers()[2], dtype=np.uint8) if cuts[-1] else np.zeros(0, dtype=np.uint8)
    return data[cuts[0] : cuts[-1]], np.diff(cuts)


def _met_rows(kind: int, a: np.ndarray, b: np.ndarray, c: np.ndarray | None = None, null: np.ndarray | None = None) -> pa.RecordBatch:
    third = pa.nulls(len(a), pa.int64()) if c is None else pa.array(c)
    return pa.RecordBatch.from_arrays([pa.array(np.full(len(a), kind, dtype=np.int8)), pa.array(a, mask=null), pa.array(b), third], names=["kind", "a", "b", "c"])


def _first(*columns: np.ndarray) -> np.ndarray:
    """Whether a row differs from the one before."""
    new = np.ones(len(columns[0]), dtype=bool)
    if len(new):
        new[1:] = functools.reduce(np.logical_or, (c[1:] != c[:-1] for c in columns))
    return new


def _buckets(part: np.ndarray, rows: pa.ChunkedArray, apart: int) -> Iterator[pa.RecordBatch]:
    """The shared keys of whole parts: pairs of small buckets, (key, node) of the others. A bucket falls apart where the sizes
    of its nodes do; not if it may have more nodes elsewhere."""
    data, size = _bytes(rows)
    entries = data.view(ENTRY)
    key = np.repeat(part << 40, size // ENTRY.itemsize)
    key |= entries["high"].astype(np.int64) << 32
    key |= entries["low"]
    order = np.argsort(key)
    key = key[order]
    new = _first(key)
    at = np.flatnonzero(~new | ~np.append(new[1:], True)[: len(key)])
    key, node, level = key[at], entries["node"][order[at]], entries["level"][order[at]].astype(np.int64)
    order = np.lexsort((node, level, key))
    order = order[_first(key[order], node[order])]
    key, node, level = key[order], node[order], level[order]

    def sizes(new: np.ndarray) -> np.ndarray:
        each = np.diff(np.append(np.flatnonzero(new), len(key)))
        return np.repeat(each, each)

    new = _first(key)
    gap = np.zeros(len(key), dtype=bool)
    gap[1:] = (level[1:] - level[:-1] > apart) & ~new[1:]
    gap &= sizes(new) < SENT
    runs = np.cumsum(gap)
    run = runs - np.repeat(runs[new], np.diff(np.append(np.flatnonzero(new), len(key))))
    size = sizes(new | gap)
    for step in range(1, SMALL):
        x = np.flatnonzero((size[:-step] <= SMALL) & (key[:-step] == key[step:]) & (run[:-step] == run[step:]) & (level[step:] - level[:-step] <= apart))
        if len(x):
            yield _met_rows(PAIR, np.minimum(node[x], node[x + step]), np.maximum(node[x], node[x + step]))
    large = np.flatnonzero(size > SMALL)
    if len(large):
        key, run = key[large], run[large]
        yield _met_rows(MEMBER, np.where(run > 0, W.mix(key.view(np.uint64) + run.view(np.uint64) * W.PLACE[21]).view(np.int64), key), node[large])


def _met(apart: int):
    """Of the rows of `deal_keys` and `deal_rows` in order of their parts, what `met` returns. The part that came last is held back."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        W.keep_memory()
        rest: pa.Table | None = None
        for batch in itertools.chain(batches, [None]):
            now = rest if batch is None else pa.Table.from_batches([batch]) if rest is None else pa.concat_tables([rest, pa.Table.from_batches([batch])])
            if now is None or not now.num_rows:
                continue
            part = now.column(0).to_numpy()
            free = int(np.searchsorted(part, 0))
            for i in range(free):
                data, size = _bytes(now.column(1).slice(i, 1))
                if part[i] % 4 == ROW:
                    n = len(data) // 25
                    a, b, c = (data[k * 8 * n : (k + 1) * 8 * n].view(np.int64) for k in range(3))
                    yield _met_rows(ROW, a, b, c, data[24 * n :] > 0)
                else:
                    yield _met_rows(EXTRA, *np.split(data.view(np.int64), 2))
            done = len(part) if batch is None else max(free, int(np.searchsorted(part, part[-1])))
            if done > free:
                yield from _buckets(part[free:done], now.column(1).slice(free, done - free), apart)
            rest = now.slice(done)

    return run


def part_bits(spark: SparkSession) -> int:
    """2**bits parts, several for each task, and few enough that a part's row of a deal isn't tiny."""
    return max(12, (4 * int(spark.conf.get("spark.sql.shuffle.partitions")) - 1).bit_length())


def met(dealt: DataFrame, num: int, den: int, scratch: Scratch) -> DataFrame:
    """dealt: what deal_keys and deal_rows gave; links have a Jaccard similarity of num/den or more. Saved rows (kind, a, b, c): the rows dealt (ROW: a, b, c); two nodes of a shared
    key that has up to SMALL (PAIR: a, b); key and node of the others (MEMBER: a, b, distinct; EXTRA: a, b). Keys travel as bytes and are sorted
    where they arrive; only those with two nodes become rows, and no node that by its size can't be linked in its bucket."""
    return scratch.save(dealt.repartition("part").sortWithinPartitions("part").mapInArrow(_met(levels_apart(num, den)), MET), "met")


def distinct_buckets(members: DataFrame, scratch: Scratch) -> DataFrame:
    """members (key, node: distinct) without the buckets that hold the same nodes as another: of those the least key
    stays. Near copies share most of their keys, so this leaves a few buckets of each group. Equal buckets are told by
    their size and two 64-bit exclusive ors of hashes of their nodes."""
    sums = [F.bit_xor(F.xxhash64("node", F.lit(i))).alias(f"s{i}") for i in (1, 2)]
    keys = members.groupBy("key").agg(F.count("*").alias("n"), *sums).groupBy("n", "s1", "s2").agg(F.min("key").alias("key")).select("key")
    out = scratch.save(members.join(keys, "key"), "members")
    scratch.drop(members)
    return out


#: Bits of a bitmap of ids, at most: 4 MB on the executors, twice that on its way to the driver.
BITS = 1 << 25


def slot(col: str) -> Column:
    return F.pmod(F.xxhash64(col), F.lit(BITS)).cast("bigint")


def bitmap(ids: DataFrame, at: Column) -> np.ndarray:
    """A fixed-size bitmap of the slots (column `at`, from 0 to BITS - 1) of ids: a row whose slot isn't set has none of
    them. It only spares work (rows that it lets pass in vain are harmless), so its size needn't grow with the data."""
    words = ids.select(at.alias("at")).select(F.shiftright("at", 6).alias("w"), F.expr("shiftleft(1L, cast(at % 64 as int))").alias("b"))
    found = words.groupBy("w").agg(F.bit_or("b").alias("b")).toArrow()
    out = np.zeros(BITS // 64, dtype=np.int64)
    out[found.column("w").to_numpy()] = found.column("b").to_numpy()
    return out.view(np.uint64)


def exclude(docs: DataFrame, ids: DataFrame, id_col: str) -> DataFrame:
    """docs without the rows whose id is among ids (left anti join; a null id stays). The rows that the bitmap rules out
    pass without a shuffle; only the others, mostly the rows to drop, meet ids in a join. The bitmap joins as at most
    BITS / 64 rows. docs' columns travel as one struct, so their names can't clash."""
    words = ids.select(slot(id_col).alias("at")).select(F.shiftright("at", 6).alias("w"), F.expr("shiftleft(1L, cast(at % 64 as int))").alias("b"))
    words = words.groupBy("w").agg(F.bit_or("b").alias("b"))
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("kept"), F.col(f"`{id_col}`").alias("id"), slot(f"`{id_col}`").alias("at"))
    marked = rows.join(F.broadcast(words), F.shiftright("at", 6) == F.col("w"), "left")
    maybe = F.coalesce(F.expr("(shiftrightunsigned(b, cast(at % 64 as int)) & 1L) = 1"), F.lit(False))
    clear = marked.filter(~maybe).select("kept")
    doubt = marked.filter(maybe).select("kept", "id").join(ids.select(F.col(f"`{id_col}`").alias("id")).distinct(), "id", "left_anti")
    return clear.unionByName(doubt.select("kept")).select(*[F.col("kept")[c].alias(c) for c in docs.columns])


def in_bitmap(bits: np.ndarray, slots: np.ndarray) -> np.ndarray:
    return (bits[slots >> 6] >> (slots & 63).astype(np.uint64)) & np.uint64(1) > 0


def _matrix(column: pa.Array | pa.ChunkedArray) -> np.ndarray:
    """Profiles as rows of bytes; shorter ones end in zeros."""
    values = column.to_pylist()
    size = np.fromiter(map(len, values), dtype=np.int64, count=len(values))
    data = np.frombuffer(b"".join(values), dtype=np.uint8)
    if (size == size[0]).all():
        return data.reshape(len(values), -1)
    out, first = np.zeros((len(values), size.max()), dtype=np.uint8), np.cumsum(size) - size
    for width in np.unique(size):
        rows = np.flatnonzero(size == width)
        out[rows, :width] = data[first[rows][:, None] + np.arange(width)]
    return out


def _open_pairs(left: DataFrame, profiles: DataFrame, apart: Callable, nearest: bool) -> DataFrame:
    """The pairs of a bucket's nodes in different components whose profiles allow a link; with `nearest` only each
    node's pair of the least distance, so at most one a node."""
    sizes = left.groupBy("key").agg(F.ceil(F.count("*") / PART).cast("int").alias("parts"))
    own = left.join(sizes, "key").join(profiles, "node")
    own = own.withColumn("p", F.pmod(F.xxhash64("node"), F.col("parts")).cast("int"))
    # a part meets itself and each other part once
    other = F.sequence(F.lit(0), F.col("parts") - 1)
    own = own.withColumn("o", F.explode(other)).select("key", F.least("p", "o").alias("i"), F.greatest("p", "o").alias("j"), F.col("p"), "node", "component", "n", "profile")

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest: pa.Table | None = None  # the last bucket part of what came so far may go on
        for batch in itertools.chain(batches, [None]):
            now = rest if batch is None else pa.Table.from_batches([batch]) if rest is None else pa.concat_tables([rest, pa.Table.from_batches([batch])])
            if now is None or not now.num_rows:
                continue
            key, i, j, p, node, comp, n = (now.column(c).to_numpy() for c in ("key", "i", "j", "p", "node", "component", "n"))
            new = np.concatenate([[True], (key[1:] != key[:-1]) | (i[1:] != i[:-1]) | (j[1:] != j[:-1])])
            starts = np.flatnonzero(new)
            done = len(key) if batch is None else int(starts[-1])
            rest = now.slice(done)
            if not done:
                continue
            ends = np.append(starts[starts < done], done)
            stop = np.repeat(ends[1:], np.diff(ends))
            prof = _matrix(now.column("profile").slice(0, done))
            near, partner = np.full(done, NEVER), np.zeros(done, dtype=np.int64)
            for step in range(1, int(np.diff(ends).max())):
                x = np.flatnonzero(np.arange(step, done + step) < stop)
                y = x + step
                ok = (comp[x] != comp[y]) & ((i[x] == j[x]) | (p[x] != p[y])) & (node[x] != node[y])
                x, y = x[ok], y[ok]
                for at in range(0, len(x), 1 << 14):
                    a, b = x[at : at + (1 << 14)], y[at : at + (1 << 14)]
                    d = apart(n[a], prof[a], n[b], prof[b])
                    if nearest:  # a row is at most once in a and at most once in b
                        for own_, other in ((a, b), (b, a)):
                            less = d < near[own_]
                            near[own_[less]], partner[own_[less]] = d[less], other[less]
                    elif (d < NEVER).any():
                        a, b = node[a[d < NEVER]], node[b[d < NEVER]]
                        yield pa.RecordBatch.from_pydict({"a": np.minimum(a, b), "b": np.maximum(a, b)})
            if nearest:
                x = np.flatnonzero(near < NEVER)
                a, b = node[x], node[partner[x]]
                yield pa.RecordBatch.from_pydict({"a": np.minimum(a, b), "b": np.maximum(a, b)})

    return own.repartition("key", "i", "j").sortWithinPartitions("key", "i", "j").mapInArrow(compare, "a bigint, b bigint")


def _possible(pairs: DataFrame, profiles: DataFrame, apart: Callable) -> DataFrame:
    """(a, b, far) of the pairs that their profiles don't rule out; far is the lower bound of how far they lie apart."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                n, m = (batch.column(i).to_numpy() for i in (2, 4))
                p, q = (_matrix(batch.column(i)) for i in (3, 5))
                far = apart(n, p, m, q)
                keep = pa.array(far < NEVER)
                yield pa.RecordBatch.from_arrays([*(batch.column(i).filter(keep) for i in (0, 1)), pa.array(far.astype(np.int32)).filter(keep)], names=["a", "b", "far"])

    side = lambda end: profiles.select(F.col("node").alias(end), F.col("n").alias(f"n{end}"), F.col("profile").alias(f"p{end}"))
    both = pairs.join(side("b"), "b").join(side("a"), "a")
    return both.select("a", "b", "na", "pa", "nb", "pb").mapInArrow(run, "a bigint, b bigint, far int")


def link_components(members: DataFrame, profiles: DataFrame, apart: Callable, verify: Callable[[DataFrame], DataFrame], scratch: Scratch, known: DataFrame, pairs: DataFrame | None = None) -> DataFrame:
    """(node, component) of the linked nodes. members: (key, node), distinct and saved; profiles: (node, n, profile);
    apart(n, profiles, n of the others, their profiles) is a lower bound of how far pairs of nodes lie apart, NEVER where it
    rules out a link; verify takes pairs (a, b) and returns those that are linked; known: links (a, b) that need no
    check; pairs: (a, b) of buckets that are no members, compared like the stars. What verify gets is saved.

    Of the stars, each node's nearest pivot is verified first; the node's other stars only where that hasn't joined the
    two ends already. Then buckets that still hold several components are compared in parts."""
    order = F.struct(F.xxhash64("node").alias("h"), F.col("node").alias("pivot"))
    pivot = members.groupBy("key").agg(F.min(order)["pivot"].alias("pivot"))
    spokes = scratch.save(members.join(pivot, "key").filter("node <> pivot"), "spokes")
    stars = spokes.select(F.col("pivot").alias("a"), F.col("node").alias("b"))
    stars = scratch.save((stars if pairs is None else stars.unionByName(pairs)).distinct(), "stars")
    near = scratch.save(_possible(stars, profiles, apart), "near")
    best = scratch.save(near.groupBy("b").agg(F.min(F.struct("far", "a")).alias("m")).select("m.a", "b"), "best")
    joined = scratch.save(verify(best), "linked")
    components = _merge(None, joined, known, scratch)
    side = lambda end: components.select(F.col("node").alias(end), F.col("component").alias(f"c{end}"))
    rest = near.select("a", "b").join(best, ["a", "b"], "left_anti").join(side("a"), "a", "left").join(side("b"), "b", "left")
    rest = scratch.save(rest.filter(F.coalesce("ca", "a") != F.coalesce("cb", "b")).select("a", "b").distinct(), "rest")
    scratch.release()
    if not rest.isEmpty():
        components = _merge(components, verify(rest), None, scratch)
    tested = stars.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
    # the pivots' pairs are settled, so a bucket of two nodes is done and others go on without their pivot
    left = spokes
    # a round of nearest nodes compares as much as the last one; it pays where many pairs would become rows
    for nearest, few in ((True, 2), (True, 32), (False, 0)):
        left, size, cross = _still_open(left, components, scratch)
        if not size:
            break
        if nearest and cross <= few * size:
            continue
        near = scratch.save(_open_pairs(left, profiles, apart, nearest).distinct(), "near-pairs")
        if nearest:  # a node that may be linked to no node of another component in its buckets never will be
            left = left.join(near.select(F.explode(F.array("a", "b")).alias("node")).distinct(), "node", "left_semi")
        pairs = scratch.save(near.join(tested, ["a", "b"], "left_anti"), "pairs")
        scratch.release()
        components = _merge(components, verify(pairs), None, scratch)
        tested = tested.unionByName(pairs)
    return components


def _merge(components: DataFrame | None, found: DataFrame, known: DataFrame | None, scratch: Scratch) -> DataFrame:
    """Components after new links. Links are drawn between the components there are, so that later rounds work on the
    few that change."""
    found = scratch.save(found, "links")
    if components is None:
        return scratch.save(connected_components(found if known is None else found.unionByName(known), scratch), "components")
    if found.isEmpty():
        return components
    side = lambda end: components.select(F.col("node").alias(end), F.col("component").alias(f"c{end}"))
    drawn = found.join(side("a"), "a", "left").join(side("b"), "b", "left").select(F.coalesce("ca", "a").alias("a"), F.coalesce("cb", "b").alias("b"))
    up = scratch.save(connected_components(drawn, scratch), "merged")
    moved = components.join(up.select(F.col("node").alias("component"), F.col("component").alias("top")), "component", "left").select("node", F.coalesce("top", "component").alias("component"))
    fresh = up.join(components.select("node"), "node", "left_anti")
    return scratch.save(moved.unionByName(fresh.select("node", "component")), "components")


def _still_open(left: DataFrame, components: DataFrame, scratch: Scratch) -> tuple[DataFrame, int, float]:
    """The buckets that hold several components, their rows, and the pairs of rows across components."""
    named = left.select("key", "node").join(components, "node", "left").select("key", "node", F.coalesce("component", "node").alias("component"))
    named = scratch.save(named, "named")
    each = named.groupBy("key", "component").agg(F.count("*").alias("n")).groupBy("key").agg(F.sum("n").alias("n"), F.sum(F.col("n") * F.col("n")).alias("own"))
    each = scratch.save(each.filter("n * n > own"), "open")
    size, cross = each.agg(F.coalesce(F.sum("n"), F.lit(0)), F.coalesce(F.sum((F.col("n") * F.col("n") - F.col("own")) / 2), F.lit(0))).first()
    return named.join(each.select("key"), "key"), size, cross
