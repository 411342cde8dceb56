"""Sharding by histogram sort, with DataFrame functions only.

Rows are ordered by (hash of the text, id, a row number given when the keys are written). The splitters that cut this
order into shards of equal bytes are found by probing: each round counts, over all rows and exactly, the bytes and
rows between the probe keys of every interval that still holds an undecided splitter, and narrows the interval to one
gap between probes (a range of the key's upper bits), until a boundary lies within the tolerance or between two neighbouring rows. Then the rows are
exchanged once. Equal texts are neighbours in this order: a group of them stays in one shard, unless it lies across a
splitter that only a cut inside the group brings within the tolerance, so a group of any size is spread as it must be.
"""

from __future__ import annotations

import functools

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lumiframe.llm.storage import Scratch

#: Probes of an interval in one round.
PROBES = 1024
_KEY = ("__hash", "__id", "__row")
_MAX = 2**63 - 1


def _inside(at: dict) -> Column:
    """Whether a row lies in an interval: equal in the parts before `part`, between lo and hi in it."""
    tests = [F.col(c) == F.lit(v) for c, v in zip(_KEY, at["fixed"], strict=False)]
    part = F.col(_KEY[len(at["fixed"])])
    return functools.reduce(Column.__and__, [*tests, part >= F.lit(at["lo"]), part <= F.lit(at["hi"])])


def _bin(at: dict) -> Column:
    """The gap between probes in which a row lies: the key's upper bits. It never falls as the key rises, so gaps are ranges
    of keys; all in whole numbers, so a round leaves a range of at least PROBES / 2 times fewer keys."""
    shift = next(s for s in range(65) if (at["hi"] >> s) - (at["lo"] >> s) < PROBES)
    return F.shiftright(F.col(_KEY[len(at["fixed"])]), shift) if shift else F.col(_KEY[len(at["fixed"])])


def _counts(keys: DataFrame, intervals: list[dict]) -> dict[int, list]:
    """For each interval, its gaps that hold rows, in order. At most (number of splitters) * PROBES rows come back."""
    which = functools.reduce(lambda c, i: c.when(_inside(intervals[i]), F.struct(F.lit(i).alias("i"), _bin(intervals[i]).alias("b"))), range(1, len(intervals)), F.when(_inside(intervals[0]), F.struct(F.lit(0).alias("i"), _bin(intervals[0]).alias("b"))))
    parts = [f(c).alias(f"{n}{c}") for c in _KEY for n, f in (("lo", F.min), ("hi", F.max))]
    found = keys.select(*_KEY, "size", which.alias("at")).filter("at is not null").groupBy("at.i", "at.b").agg(F.sum("size").alias("bytes"), F.count("*").alias("n"), *parts)
    out: dict[int, list] = {i: [] for i in range(len(intervals))}
    for r in sorted(found.collect(), key=lambda r: (r["i"], r["b"])):
        out[r["i"]].append(r)
    return out


def find_splitters(keys: DataFrame, shards: int, tolerance: float) -> tuple[list[dict], list[dict]]:
    """(splitters, coarse cuts). A splitter is the last key of the rows below it, with their exact number; coarse cuts
    are the gaps of the first round, used to number rows in parallel within a shard."""
    low, high, total = keys.agg(F.min(_KEY[0]), F.max(_KEY[0]), F.sum("size")).first()
    if total is None or shards < 2:
        return [], []
    allowed = tolerance * total / shards
    waiting = {s: {"fixed": (), "lo": low, "hi": high, "bytes": 0, "rows": 0} for s in range(1, shards)}
    done: dict[int, dict] = {}
    coarse: list[dict] = []
    while waiting:
        unique: list[dict] = []
        for at in waiting.values():
            if at not in unique:
                unique.append(at)
        gaps = _counts(keys, unique)
        if not coarse:
            n = 0
            for g in gaps[0]:
                n += g["n"]
                coarse.append({"key": (g[f"hi{_KEY[0]}"], _MAX, _MAX), "rows": n})
        for s, at in list(waiting.items()):
            target = total * s / shards
            size, rows, part = at["bytes"], at["rows"], len(at["fixed"])
            last = at.get("below")
            for g in gaps[unique.index(at)]:
                if size + g["bytes"] < target:
                    size, rows = size + g["bytes"], rows + g["n"]
                    last = (*at["fixed"], g[f"hi{_KEY[part]}"], *[_MAX] * (2 - part))
                    continue
                below, above = target - size, size + g["bytes"] - target
                end = (*at["fixed"], g[f"hi{_KEY[part]}"], *[_MAX] * (2 - part))
                single = g["n"] == 1 or part == 2 and g[f"lo{_KEY[2]}"] == g[f"hi{_KEY[2]}"]
                if min(below, above) <= allowed or single:
                    near = below <= above
                    done[s] = {"key": last, "rows": rows} if near else {"key": end, "rows": rows + g["n"]}
                    del waiting[s]
                elif g[f"lo{_KEY[part]}"] < g[f"hi{_KEY[part]}"]:
                    waiting[s] = {"fixed": at["fixed"], "lo": g[f"lo{_KEY[part]}"], "hi": g[f"hi{_KEY[part]}"], "bytes": size, "rows": rows, "below": last}
                else:
                    waiting[s] = {"fixed": (*at["fixed"], g[f"lo{_KEY[part]}"]), "lo": g[f"lo{_KEY[part + 1]}"], "hi": g[f"hi{_KEY[part + 1]}"], "bytes": size, "rows": rows, "below": last}
                break
    return [done[s] for s in sorted(done)], coarse


def _above(key: tuple) -> Column:
    h, d, r = (F.col(c) for c in _KEY)
    if key[1:] == (_MAX, _MAX):
        return h > F.lit(key[0])
    inner = d > F.lit(key[1]) if key[2] == _MAX else (d > F.lit(key[1])) | ((d == F.lit(key[1])) & (r > F.lit(key[2])))
    return (h > F.lit(key[0])) | ((h == F.lit(key[0])) & inner)


def _search(cuts: list[tuple], lo: int, hi: int) -> Column:
    """The number of cuts below a row, by a tree of comparisons."""
    if lo == hi:
        return F.lit(lo)
    mid = (lo + hi) // 2
    return F.when(_above(cuts[mid]), _search(cuts, mid + 1, hi)).otherwise(_search(cuts, lo, mid))


def shard_documents(
    docs: DataFrame, shards: int = 40, id_col: str = "doc_id", text_col: str = "text", carry: list[str] | None = None, tolerance: float = 0.0025, segment_rows: int = 2_000_000, scratch: Scratch | None = None
) -> DataFrame:
    """docs' columns `carry` (default: all) and size, text_crc32, law, shard, slot, grown_shard.

    Size: UTF-8 bytes of the text (null: none) plus 16. The law is `bytes`: each border between shards
    lies within `tolerance` of a shard's mean size of its place, or within half of one row. slot counts a shard's rows from 0 in the order of the keys.
    grown_shard is null. A null text has a null text_crc32. Rows with null or repeated ids, and wholly equal rows, are
    kept and count singly. An empty table gives no rows. Input columns that clash with the new names are replaced.

    Only `carry` and 48 bytes a row are exchanged. The driver gets counts of at most shards * PROBES gaps a round."""
    spark = docs.sparkSession
    scratch = scratch or Scratch(spark, "sharding")
    carry = list(docs.columns) if carry is None else carry
    new = ("size", "text_crc32", "law", "shard", "slot", "grown_shard")
    text = F.col(f"`{text_col}`")
    # the rows' own columns stay in one struct, so no name of theirs meets one of this module
    kept = [c for c in carry if c not in new]
    keyed = docs.select(
        F.struct(*[F.col(f"`{c}`") for c in kept]).alias("kept"),
        (F.coalesce(F.octet_length(text), F.lit(0)).cast("bigint") + 16).alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"),
        F.xxhash64(text, text.isNull()).alias(_KEY[0]),
        F.coalesce(F.col(f"`{id_col}`").cast("bigint"), F.lit(-(2**63))).alias(_KEY[1]),
    )
    keyed = scratch.save(keyed.withColumn(_KEY[2], F.monotonically_increasing_id()), "keys")
    splitters, coarse = find_splitters(keyed, shards, tolerance)

    none = (-(2**63), -(2**63), -1)
    cuts = [(s["key"] or none, s["rows"], True) for s in splitters]
    step, last = segment_rows, 0
    for c in coarse:  # cuts within shards, so that numbering a shard's rows is no single task
        if c["rows"] - last >= step:
            cuts.append((c["key"], c["rows"], False))
            last = c["rows"]
    cuts.sort(key=lambda c: (c[1], c[0], c[2]))
    segment = _search([c[0] for c in cuts], 0, len(cuts))
    shard_of, offset_of, shard, start = [0], [0], 0, 0
    for _, rows, splits in cuts:
        if splits:
            shard, start = shard + 1, rows
        shard_of.append(shard)
        offset_of.append(rows - start)
    order = Window.partitionBy("__segment").orderBy(*_KEY)
    pick = lambda values: F.element_at(F.array(*[F.lit(v) for v in values]), F.col("__segment") + 1)
    return keyed.withColumn("__segment", segment).select(
        *[F.col("kept")[c].alias(c) for c in kept],
        "size",
        "text_crc32",
        F.lit("bytes").alias("law"),
        pick(shard_of).cast("int").alias("shard"),
        (F.row_number().over(order) - 1 + pick(offset_of)).cast("bigint").alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"),
    )
