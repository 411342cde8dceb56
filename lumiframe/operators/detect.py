"""Detector post-processing: priors, decoding, gates, non-max suppression; quality of frames."""

from __future__ import annotations

import functools
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lumiframe.config import DEFAULT, EngineConfig
from lumiframe.functions.scalar import lit


def prior_boxes(spark: SparkSession, height: int, width: int, clip: bool = False, config: EngineConfig = DEFAULT) -> DataFrame:
    """(prior_id, cx, cy, w, h) of an image size: for every stride the cells by row and column, in each the sizes in order."""
    parts, offset = [], 0
    for step, sizes in zip(config.prior_strides, config.prior_sizes, strict=True):
        rows, cols, n = math.ceil(height / step), math.ceil(width / step), len(sizes)
        ids = spark.range(rows * cols * n)
        k = (F.col("id") % n).cast("int")
        j = F.floor(F.col("id") / n) % cols
        i = F.floor(F.col("id") / (n * cols))
        side = F.array(*[lit(s) for s in sizes])[k]
        parts.append(ids.select((F.col("id") + offset).alias("prior_id"), ((j + lit(0.5)) * step / width).alias("cx"), ((i + lit(0.5)) * step / height).alias("cy"), (side / width).alias("w"), (side / height).alias("h")))
        offset += rows * cols * n
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.select("prior_id", *[F.greatest(lit(0), F.least(lit(1), F.col(c))).alias(c) for c in ("cx", "cy", "w", "h")]) if clip else out


def gate_top_k(boxes: DataFrame, group: list[str], score: str = "score", id_col: str = "vec_id", config: EngineConfig = DEFAULT, k: int | None = None) -> DataFrame:
    """Rows above the detector's score, the best k of each group, with rank from 1; ties by id."""
    w = Window.partitionBy(*group).orderBy(F.desc(score), id_col)
    return gate(boxes, score, config).withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= (k or config.nms_top_k))


def gate(boxes: DataFrame, score: str = "score", config: EngineConfig = DEFAULT) -> DataFrame:
    """Rows above the detector's score, strictly."""
    return boxes.filter(F.col(score) > config.detector_score)


#: Boxes that are compared with each other at once.
BLOCK = 512


def _overlap(a: np.ndarray, b: np.ndarray, limit: float) -> np.ndarray:
    """(len(a), len(b)): whether two boxes (x1, y1, x2, y2; both ends belong to a box) overlap by more than the limit."""
    area = lambda x: (x[:, 2] - x[:, 0] + 1) * (x[:, 3] - x[:, 1] + 1)
    w = np.minimum(a[:, None, 2], b[None, :, 2]) - np.maximum(a[:, None, 0], b[None, :, 0]) + 1
    h = np.minimum(a[:, None, 3], b[None, :, 3]) - np.maximum(a[:, None, 1], b[None, :, 1]) + 1
    both = np.maximum(0.0, w) * np.maximum(0.0, h)
    return both / (area(a)[:, None] + area(b)[None, :] - both) > limit


class _Keeper:
    """The boxes kept so far of one group whose boxes come by falling score."""

    def __init__(self, limit: float, most: int):
        self.limit, self.most, self.kept = limit, most, np.zeros((0, 4))

    def take(self, boxes: np.ndarray) -> list[int]:
        """The places in boxes that are kept."""
        out: list[int] = []
        for at in range(0, len(boxes), BLOCK):
            if len(self.kept) >= self.most:
                break
            block = boxes[at : at + BLOCK]
            open_ = np.flatnonzero(~_overlap(block, self.kept, self.limit).any(axis=1))
            among = _overlap(block[open_], block[open_], self.limit)
            dead, chosen = np.zeros(len(open_), dtype=bool), []
            for i in range(len(open_)):
                if not dead[i] and len(self.kept) + len(chosen) < self.most:
                    chosen.append(open_[i])
                    dead |= among[i]
            self.kept = np.concatenate([self.kept, block[chosen]])
            out += [at + int(i) for i in chosen]
        return out


def _suppress(boxes: DataFrame, group: list[str], id_col: str, config: EngineConfig) -> DataFrame:
    """Kept rows of boxes with kept_rank. A task reads its groups in order and holds at most nms_keep boxes and a batch,
    however large a group is."""
    n, limit, most = len(group), config.nms_iou, config.nms_keep
    schema = T.StructType([*boxes.schema.fields, T.StructField("kept_rank", T.IntegerType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, keeper = None, _Keeper(limit, most)
        for batch in batches:
            if not batch.num_rows:
                continue
            keys = list(zip(*(batch.column(i).to_pylist() for i in range(n)), strict=True))
            corners = np.stack([batch.column(n + 1 + i).to_numpy(zero_copy_only=False) for i in range(4)], axis=1)
            starts = [i for i in range(len(keys)) if i == 0 or keys[i] != keys[i - 1]]
            places, ranks = [], []
            for lo, hi in zip(starts, [*starts[1:], len(keys)], strict=True):
                if keys[lo] != key:
                    key, keeper = keys[lo], _Keeper(limit, most)
                before = len(keeper.kept)
                found = keeper.take(corners[lo:hi])
                places += [lo + i for i in found]
                ranks += range(before + 1, before + len(found) + 1)
            yield pa.RecordBatch.from_arrays([*batch.take(pa.array(places, pa.int64())).columns, pa.array(ranks, pa.int32())], names=[*batch.schema.names, "kept_rank"])

    return boxes.repartition(*group).sortWithinPartitions(*group, F.desc("score"), id_col).mapInArrow(run, schema)


def greedy_nms(boxes: DataFrame, group: list[str], id_col: str = "vec_id", config: EngineConfig = DEFAULT) -> DataFrame:
    """(group, id, kept_rank): by falling score (ties by id), a box is dropped if it overlaps a kept one by more than nms_iou;
    at most nms_keep stay. Groups may be of any size; a box without a score or a corner takes no part.

    The best nms_top_k boxes of each group are folded first. Of a larger group, the rest is ruled out against what was kept
    by an equi-join, which splits a hot group, and only boxes that overlap none of it meet the kept ones in the last fold."""
    rows = boxes.select(*group, F.col(id_col), "x1", "y1", "x2", "y2", "score").dropna(subset=["x1", "y1", "x2", "y2", "score"])
    if rows.groupBy(*group).count().filter(F.col("count") > config.nms_top_k).isEmpty():  # one fold does it
        return _suppress(rows, group, id_col, config).select(*group, id_col, "kept_rank")
    best = [F.desc("score"), F.col(id_col)]
    part = F.pmod(F.xxhash64(id_col), F.lit(32))
    head = rows.withColumn("_n", F.row_number().over(Window.partitionBy(*group, part).orderBy(*best))).filter(F.col("_n") <= config.nms_top_k)
    head = head.withColumn("_n", F.row_number().over(Window.partitionBy(*group).orderBy(*best))).filter(F.col("_n") <= config.nms_top_k)
    kept = _suppress(head.drop("_n"), group, id_col, config).drop("kept_rank")
    more = head.filter(F.col("_n") == config.nms_top_k).select(*[F.col(g).alias(f"_g{i}") for i, g in enumerate(group)], F.col("score").alias("_s"), F.col(id_col).alias("_i"))
    same = functools.reduce(Column.__and__, [F.col(g).eqNullSafe(F.col(f"_g{i}")) for i, g in enumerate(group)])
    corners = F.collect_list(F.struct("x1", "y1", "x2", "y2")).alias("_kept")
    more = kept.join(more, same).groupBy("_s", "_i", *[f"_g{i}" for i in range(len(group))]).agg(corners).filter(F.size("_kept") < config.nms_keep)

    def near(k: Column) -> Column:
        area = lambda x1, y1, x2, y2: (x2 - x1 + 1) * (y2 - y1 + 1)
        c = [F.col(x) for x in ("x1", "y1", "x2", "y2")]
        w = F.greatest(lit(0), F.least(c[2], k["x2"]) - F.greatest(c[0], k["x1"]) + 1)
        h = F.greatest(lit(0), F.least(c[3], k["y2"]) - F.greatest(c[1], k["y1"]) + 1)
        return w * h / (area(*c) + area(k["x1"], k["y1"], k["x2"], k["y2"]) - w * h) > config.nms_iou

    later = (F.col("score") < F.col("_s")) | ((F.col("score") == F.col("_s")) & (F.col(id_col) > F.col("_i")))
    rest = rows.join(more, same & later).filter(~F.exists("_kept", near)).select(*rows.columns)
    return _suppress(kept.unionByName(rest), group, id_col, config).select(*group, id_col, "kept_rank")


def well_formed(raw: DataFrame, dets: str = "dets", landmarks: str = "landmarks") -> DataFrame:
    """Detections by position with their landmarks: arrays of rows per frame become rows, face_id from 1. A detection of
    fewer than five values or without landmarks is dropped."""
    zipped = raw.select(*[c for c in raw.columns if c not in (dets, landmarks)], F.posexplode(F.arrays_zip(F.col(dets).alias("d"), F.col(landmarks).alias("l"))).alias("_p", "_z"))
    rows = zipped.select("*", "_z.*").filter("size(d) >= 5 and l is not null").withColumn("face_id", (F.col("_p") + 1).cast("int"))
    return rows.withColumns({"bbox": F.slice("d", 1, 4), "confidence": F.col("d")[4]}).withColumnRenamed("l", "landmarks").drop("_p", "_z", "d")


def rescale(bbox: Column, confidence: Column, scale: Column, config: EngineConfig = DEFAULT) -> tuple[Column, Column]:
    """Boxes of the detector's image in that of the frame. legacy_confidence_scaling divides the confidence as well."""
    return F.transform(bbox, lambda v: v / scale), confidence / scale if config.legacy_confidence_scaling else confidence


def _mean(a: Column) -> Column:
    return F.aggregate(a, lit(0), lambda s, x: s + x) / F.size(a)


def _spread(a: Column, finish) -> Column:
    """finish of the mean m, the sum s1 of the distances from it and the sum s2 of their squares. The mean is in the
    fold's first state, so it is computed once and not for every element."""
    start = F.struct(_mean(a).alias("m"), lit(0).alias("s1"), lit(0).alias("s2"))
    return F.aggregate(a, start, lambda s, x: F.struct(s["m"].alias("m"), (s["s1"] + F.abs(x - s["m"])).alias("s1"), (s["s2"] + (x - s["m"]) * (x - s["m"])).alias("s2")), finish)


def _var_samp(a: Column) -> Column:
    return _spread(a, lambda s: s["s2"] / (F.size(a) - 1))


def brightness(gray: Column) -> Column:
    return _mean(F.transform(gray, lambda g: g * 100 / 255))


def contrast(gray: Column) -> Column:
    """Sample deviation of the distances from the mean."""
    n = F.size(gray)
    return _spread(F.transform(gray, lambda g: g * 100 / 255), lambda s: F.sqrt(F.greatest(lit(0), s["s2"] - s["s1"] * s["s1"] / n) / (n - 1)))


def sharpness(gray: Column, width: int, height: int) -> Column:
    """Sample variance of the 3 x 3 Laplacian (weights 2 at corners, -8 in the middle) over the inner pixels."""
    inner = F.array(*[F.lit(r * width + c) for r in range(1, height - 1) for c in range(1, width - 1)])
    lap = F.transform(inner, lambda p: lit(2) * (gray[p - width - 1] + gray[p - width + 1] + gray[p + width - 1] + gray[p + width + 1]) - lit(8) * gray[p])
    return _var_samp(lap)


def quality_ok(gray: Column, config: EngineConfig = DEFAULT) -> Column:
    """Bright and contrasted enough, both strictly; a plane that can't be measured isn't."""
    return F.coalesce((brightness(gray) > config.min_brightness) & (contrast(gray) > config.min_contrast), F.lit(False))


#: Frame predicates by the names that a frame_chain holds; unknown names are skipped.
FRAME_PREDICATES = {"QualityFilter": quality_ok}


def frame_chain(gray: Column, config: EngineConfig = DEFAULT) -> Column:
    out = F.lit(True)
    for name in config.frame_chain:
        if name in FRAME_PREDICATES:
            out = out & FRAME_PREDICATES[name](gray, config)
    return out
