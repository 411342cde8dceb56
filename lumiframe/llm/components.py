"""Distributed union-find: connected components by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from lumiframe.llm.storage import Scratch


def _large_star(edges: DataFrame) -> DataFrame:
    """Link every larger neighbour of a node to the least of its neighbourhood."""
    both = edges.select(F.explode(F.array(F.struct("u", "v"), F.struct(F.col("v").alias("u"), F.col("u").alias("v")))).alias("e")).select("e.u", "e.v")
    least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    # the pairs (larger neighbour, node) are the edges themselves, each with v as the node, and their mirror gives none
    return edges.join(least.withColumnRenamed("u", "v"), "v").select("u", F.col("m").alias("v"))


def _small_star(edges: DataFrame) -> DataFrame:
    """Link a node's smaller neighbours, and the node itself, to the least of them. Edges have u > v."""
    least = edges.groupBy("u").agg(F.min("v").alias("m"))
    kept = edges.join(least, "u")
    pairs = F.array(F.struct(F.col("v").alias("u"), F.col("m").alias("v")), F.struct(F.col("u"), F.col("m").alias("v")))
    return kept.select(F.explode(pairs).alias("e")).select("e.u", "e.v").filter("u <> v")


def connected_components(edges: DataFrame, scratch: Scratch) -> DataFrame:
    """(node, component) for the nodes of `edges` (columns a, b of one orderable type); component is the least node
    that is reachable. Null ends and loops are ignored; a node without an edge isn't returned.

    Each round is two aggregations with map-side partials and two equi-joins, written to the shared folder, so neither
    a hub nor the number of rounds lengthens the lineage. It ends when a round changes nothing, which the number of edges and
    a sum of their hashes tell, taken while they are written; then all trees are stars. Nothing else reaches the driver."""
    now = edges.filter("a is not null and b is not null and a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
    now, before = _saved(now.distinct(), scratch)
    while before[0]:
        step, after = _saved(_small_star(_large_star(now)).distinct(), scratch)
        scratch.drop(now)
        now, same, before = step, before == after, after
        if same:
            break
    return now.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(now.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())


def _saved(edges: DataFrame, scratch: Scratch) -> tuple[DataFrame, tuple]:
    """The table of the edges and what tells it from another one."""
    seen = Observation()
    sums = [F.sum(F.xxhash64("u", "v", F.lit(i)).cast("decimal(20,0)")).alias(f"s{i}") for i in (1, 2)]
    out = scratch.save(edges.observe(seen, F.count("*").alias("n"), *sums), "edges")
    got = seen.get
    return out, (got["n"], got["s1"], got["s2"])
