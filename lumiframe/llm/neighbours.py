"""Approximate nearest neighbours: a forest of random-projection trees, one priority queue over all trees of a query,
exact reranking of the leaves it reaches.

Equal vectors are indexed once, with their least k + 1 ids, so a vector that a third of the rows share is one entry.
The trees' planes are fitted on a bounded sample; every entry is then sent to its leaf in every tree. A query's queue
holds the branches it didn't take, in all trees, by the sum of squared distances to the planes that it would cross; it
opens leaves until they hold effort * entries ** POWER entries: fewer of all, the more there are. Queries meet the leaves
they opened by an equi-join on (tree, leaf, part of its entries, part of its queries); a part has at most PART of either,
so no task holds more at once, however many queries open a leaf."""

from __future__ import annotations

import heapq
import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lumiframe.llm.storage import Scratch

SAMPLE, TREES, LEAF, PART = 20_000, 12, 192, 4096
#: Queries that are compared with a part of a leaf at once.
BLOCK = 256
#: Of the rule for how many entries a query looks at; measured on vectors without structure, see the README.
EFFORT, POWER = 12.0, 0.71


class Forest:
    """Trees as flat arrays: plane, offset and the two children of each node; a child below 0 is leaf -1 - child."""

    def __init__(self, x: np.ndarray, trees: int, leaf: int, seed: int):
        rng = np.random.default_rng(seed)
        self.trees = [self._tree(x, leaf, rng) for _ in range(trees)]

    @staticmethod
    def _tree(x: np.ndarray, leaf: int, rng: np.random.Generator) -> tuple:
        planes, offsets, children, leaves = [], [], [], 0

        def grow(rows: np.ndarray) -> int:
            nonlocal leaves
            if len(rows) > leaf:
                w = rng.standard_normal(x.shape[1])
                w /= np.linalg.norm(w)
                p = x[rows] @ w
                cut = float(np.median(p))
                left, right = rows[p <= cut], rows[p > cut]
                if len(left) and len(right):
                    at = len(planes)
                    planes.append(w)
                    offsets.append(cut)
                    children.append(None)
                    children[at] = (grow(left), grow(right))
                    return at
            leaves += 1
            return -leaves

        root = grow(np.arange(len(x)))
        shape = (len(planes), x.shape[1])
        return root, np.array(planes, dtype=np.float32).reshape(shape), np.array(offsets), np.array(children, dtype=np.int64).reshape(-1, 2), leaves

    def leaves(self, x: np.ndarray) -> np.ndarray:
        """(rows, trees): the leaf of every vector in every tree."""
        out = np.zeros((len(x), len(self.trees)), dtype=np.int64)
        for t, (root, planes, offsets, children, _) in enumerate(self.trees):
            at = np.full(len(x), root)
            side = (x @ planes.T.astype(np.float64) > offsets).astype(np.int8) if len(planes) else None
            open_ = np.flatnonzero(at >= 0)
            while len(open_):
                at[open_] = children[at[open_], side[open_, at[open_]]]
                open_ = open_[at[open_] >= 0]
            out[:, t] = -1 - at
        return out

    def search(self, q: np.ndarray, sizes: list[np.ndarray], budget: float) -> list[tuple[int, int]]:
        """The (tree, leaf) pairs that one query opens, until they hold `budget` entries."""
        margins = [(planes.astype(np.float64) @ q - offsets) if len(planes) else None for _, planes, offsets, _, _ in self.trees]
        heap = [(0.0, t, tree[0]) for t, tree in enumerate(self.trees)]
        heapq.heapify(heap)
        out, held = [], 0
        while heap and held < budget:
            cost, t, at = heapq.heappop(heap)
            while at >= 0:
                m = margins[t][at]
                left, right = self.trees[t][3][at]
                near, far = (right, left) if m > 0 else (left, right)
                heapq.heappush(heap, (cost + m * m, t, int(far)))
                at = int(near)
            out.append((t, -1 - at))
            held += sizes[t][-1 - at]
        return out


def _valid(vector: Column, dim: int | None) -> Column:
    usable = F.exists(vector, lambda v: v != 0) & F.forall(vector, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) != float("inf")))
    return F.coalesce(usable & (F.size(vector) == dim if dim is not None else F.lit(True)), F.lit(False))


#: Rows that a task holds while it merges what its leaves found.
HELD = 1 << 18


def _best(k: int):
    """Of rows (query_id, s, n: lists) the k least (s, n) of each query in the task, as rows; trees find a row repeatedly."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [np.zeros(0, np.int64), np.zeros(0, np.float64), np.zeros(0, np.int64)]
        for batch in itertools.chain(batches, [None]):
            if batch is not None:
                sizes = pa.compute.list_value_length(batch.column(1)).to_numpy()
                more = np.repeat(batch.column(0).to_numpy(), sizes), batch.column(1).flatten().to_numpy(), batch.column(2).flatten().to_numpy()
                held = [np.concatenate(x) for x in zip(held, more, strict=True)]
            if batch is None or len(held[0]) > HELD:
                order = np.lexsort((held[2], held[1], held[0]))
                q, s, n = (x[order] for x in held)
                new = np.ones(len(q), dtype=bool)
                new[1:] = (q[1:] != q[:-1]) | (s[1:] != s[:-1]) | (n[1:] != n[:-1])
                q, s, n = q[new], s[new], n[new]
                first = np.arange(len(q)) - np.searchsorted(q, q) < k
                held = [x[first] for x in (q, s, n)]
                if batch is None or len(held[0]) > HELD // 2:
                    yield pa.RecordBatch.from_arrays([pa.array(x) for x in held], names=["query_id", "s", "n"])
                    held = [x[:0] for x in held]

    return run


def nearest_neighbours(
    vectors: DataFrame, is_query: Column, id_col: str = "vec_id", vector_col: str = "embedding", k: int = 10, effort: float = EFFORT, trees: int = TREES, leaf: int = LEAF, sample: int = SAMPLE, seed: int = 7, scratch: Scratch | None = None
) -> DataFrame:
    """(query_id, rank from 1, id_col, score): the k nearest rows found of each row where is_query holds, without itself.

    score is the Euclidean distance of the original vectors in double precision; ties go to the smaller id. Rows whose vector is
    null, empty, zero, holds a null or non-finite component, or has another length than most rows take no part, nor do
    null ids. A repeated id is one row, with the least of its vectors, and a query if any of its rows is one. With fewer
    than k candidates all are returned; without any, none. effort says how many leaf entries a query opens (trees overlap, so
    an entry may be opened twice)."""
    spark = vectors.sparkSession
    scratch = scratch or Scratch(spark, "neighbours")
    base = vectors.select(F.col(id_col).cast("bigint").alias("id"), F.col(vector_col).alias("v"), F.coalesce(is_query, F.lit(False)).alias("q")).filter(F.col("id").isNotNull() & _valid(F.col("v"), None))
    lengths = base.groupBy(F.size("v").alias("n")).count().orderBy(F.desc("count"), "n").first()
    schema = f"query_id bigint, rank int, {id_col} bigint, score double"
    if lengths is None:
        return spark.createDataFrame([], schema)
    dim = lengths["n"]
    base = scratch.save(base.filter(F.size("v") == dim).groupBy("id").agg(F.min("v").alias("v"), F.max("q").alias("q")), "rows")

    place = F.row_number().over(Window.partitionBy("v").orderBy("id"))
    entries = base.withColumn("place", place).filter(f"place <= {k + 1}").groupBy("v").agg(F.array_sort(F.collect_list("id")).alias("ids"))
    entries = scratch.save(entries, "entries")
    total = entries.count()
    taken = entries.select(F.col("v")).orderBy(F.xxhash64("v"), F.col("v")).limit(sample).toArrow()
    flat = np.asarray(taken.column("v").combine_chunks().flatten().to_numpy(zero_copy_only=False), dtype=np.float64).reshape(-1, dim)
    forest = Forest(flat, trees, max(8, leaf * len(flat) // total), seed)
    sent = spark.sparkContext.broadcast(forest)

    def place_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = sent.value
        for batch in batches:
            for at in range(0, batch.num_rows, PART):
                part = batch.slice(at, PART)
                x = np.asarray(part.column(0).flatten().to_numpy(zero_copy_only=False), dtype=np.float64).reshape(-1, dim)
                found = own.leaves(x)
                cuts = np.arange(0, found.size + 1, found.shape[1], dtype=np.int32)
                yield pa.RecordBatch.from_arrays([*part.columns, pa.ListArray.from_arrays(pa.array(cuts), pa.array(found.ravel()))], names=["v", "ids", "leaves"])

    kind = base.schema["v"].dataType.simpleString()
    placed = scratch.save(entries.mapInArrow(place_rows, f"v {kind}, ids array<bigint>, leaves array<bigint>"), "placed")
    in_leaf = placed.select("v", "ids", F.posexplode("leaves").alias("tree", "leaf"))
    sizes = [np.zeros(t[4], dtype=np.int64) for t in forest.trees]
    for r in in_leaf.groupBy("tree", "leaf").count().collect():  # trees * leaves rows, bounded by the sample
        sizes[r["tree"]][r["leaf"]] = r["count"]
    counts = spark.sparkContext.broadcast(sizes)
    budget = effort * total**POWER

    def open_leaves(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, held = sent.value, counts.value
        for batch in batches:
            for i in range(batch.num_rows):
                v = batch.column(1).slice(i, 1)
                q = np.asarray(v.flatten().to_numpy(zero_copy_only=False), dtype=np.float64)
                rows = [(t, x, p) for t, x in own.search(q, held, budget) for p in range(max(1, -(-int(held[t][x]) // PART)))]
                n = len(rows)
                cols = np.array(rows, dtype=np.int64).reshape(-1, 3)
                yield pa.RecordBatch.from_arrays([pa.repeat(batch.column(0)[i], n), v.take(pa.array(np.zeros(n, np.int64))), *(pa.array(cols[:, j]) for j in range(3))], names=["query_id", "q", "tree", "leaf", "part"])

    opened = scratch.save(base.filter("q").select("id", "v").mapInArrow(open_leaves, f"query_id bigint, q {kind}, tree bigint, leaf bigint, part bigint"), "opened")
    # at most trees * leaves rows, bounded by the sample: parts of a leaf's entries and of its queries
    seekers = {(r["tree"], r["leaf"]): r["count"] for r in opened.filter("part = 0").groupBy("tree", "leaf").count().collect()}
    leaves = [(t, x, max(1, -(-int(n) // PART)), -(-seekers[t, x] // PART)) for t, s in enumerate(sizes) for x, n in enumerate(s) if (t, x) in seekers]
    plan = F.broadcast(spark.createDataFrame(leaves, "tree bigint, leaf bigint, parts int, turns int"))
    opened = opened.join(plan, ["tree", "leaf"]).withColumn("turn", F.pmod(F.xxhash64("query_id"), F.col("turns")).cast("int"))
    side = in_leaf.select("v", "ids", F.col("tree").cast("bigint").alias("tree"), "leaf").join(plan, ["tree", "leaf"])
    side = side.withColumn("part", F.pmod(F.xxhash64("ids"), F.col("parts")).cast("bigint")).withColumn("turn", F.explode(F.sequence(F.lit(0), F.col("turns") - 1)))
    side, opened = side.select("v", "ids", "tree", "leaf", "part", "turn"), opened.select("query_id", "q", "tree", "leaf", "part", "turn")

    def matrix(column: pa.ChunkedArray) -> np.ndarray:
        return np.asarray(column.combine_chunks().flatten().to_numpy(zero_copy_only=False), dtype=np.float64).reshape(-1, dim)

    def rerank(left: pa.Table, right: pa.Table) -> pa.Table:
        own, sizes_of, scores, ids_of = [], [], [], []
        if left.num_rows and right.num_rows:
            x, y, queries, ids = matrix(left["v"]), matrix(right["q"]), right["query_id"].to_numpy(), left["ids"].combine_chunks()
            flat, cuts = ids.flatten().to_numpy(), np.concatenate([[0], np.cumsum(pa.compute.list_value_length(ids).to_numpy())])
            norm, least = (x * x).sum(axis=1), min(len(x), k + 1)
            for at in range(0, len(y), BLOCK):
                q = y[at : at + BLOCK]
                # by products first, with more than their rounding as slack; then exactly, for the few that remain
                with np.errstate(over="ignore", invalid="ignore"):
                    far = norm - 2 * (q @ x.T) + (q * q).sum(axis=1)[:, None]
                    edge = np.partition(far, least - 1, axis=1)[:, least - 1]
                    slack = 1e-9 * (norm.max() + (q * q).sum(axis=1))
                    row, entry = np.nonzero(~(far > (edge + slack)[:, None]))  # what overflowed stays
                d = np.sqrt(((x[entry] - q[row]) ** 2).sum(axis=1))
                n = cuts[entry + 1] - cuts[entry]
                row, d = np.repeat(row, n), np.repeat(d, n)
                found = flat[np.repeat(cuts[entry], n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)]
                other = found != queries[at + row]
                row, d, found = row[other], d[other], found[other]
                order = np.lexsort((found, d, row))
                row, d, found = row[order], d[order], found[order]
                first = np.arange(len(row)) - np.searchsorted(row, row) < k
                own.append(queries[at : at + len(q)])
                sizes_of.append(np.bincount(row[first], minlength=len(q)))
                scores.append(d[first])
                ids_of.append(found[first])
        join = lambda parts, kind: np.concatenate(parts) if parts else np.zeros(0, kind)
        bounds = pa.array(np.concatenate([[0], np.cumsum(join(sizes_of, np.int64))]), pa.int32())
        lists = [pa.ListArray.from_arrays(bounds, pa.array(join(parts, kind))) for parts, kind in ((scores, np.float64), (ids_of, np.int64))]
        return pa.table({"query_id": pa.array(join(own, np.int64)), "s": lists[0], "n": lists[1]})

    keys = ["tree", "leaf", "part", "turn"]
    found = side.groupBy(*keys).cogroup(opened.groupBy(*keys)).applyInArrow(rerank, "query_id bigint, s array<double>, n array<bigint>")
    each = found.mapInArrow(_best(k), "query_id bigint, s double, n bigint").groupBy("query_id", "n").agg(F.min("s").alias("s"))
    best = each.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy("s", "n"))).filter(F.col("rank") <= k)
    return best.select("query_id", "rank", F.col("n").alias(id_col), F.col("s").alias("score"))
