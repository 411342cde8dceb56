"""Motion scan: magnitudes, running average, calmest frame of each window, threshold relaxation.

The running average is a sequential fold. Rows are dealt by video and sorted by video and index; a task folds the videos it
has one after another, batch by batch, and keeps one average and one open window between batches, so a video may be of
any length. Average and window pick share the pass, so the plan has one shuffle."""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lumiframe.config import DEFAULT, EngineConfig
from lumiframe.functions.scalar import lit


def motion_score(vectors: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, score) from rows (w, h, mx, my, ms): half of median plus population deviation of the vectors' lengths
    relative to their blocks, from 0 to 1; an empty block counts as 1 and a NaN gives 1."""
    area = F.when(F.col("w") * F.col("h") > 0, F.col("w") * F.col("h")).otherwise(lit(1))
    x, y = F.col("mx") / F.col("ms"), F.col("my") / F.col("ms")
    each = vectors.withColumn("_m", F.sqrt(x * x + y * y) / F.sqrt(area))
    score = (F.median("_m") + F.stddev_pop("_m")) / 2
    return each.groupBy(*keys).agg(F.greatest(lit(0), F.least(lit(1), score)).alias("score"))


class _Fold:
    """Running averages of rows that come by video and index. Between batches only the last average is kept."""

    def __init__(self, alpha: float):
        self.alpha, self.video, self.ema = alpha, None, None

    def add(self, video: np.ndarray, values: np.ndarray) -> np.ndarray:
        """The averages; video: (rows, 2), the id and whether it is null."""
        out = np.empty(len(values))
        new = np.flatnonzero(np.concatenate([[True], (video[1:] != video[:-1]).any(axis=1)]))
        for lo, hi in zip(new.tolist(), [*new[1:].tolist(), len(values)], strict=True):
            key = tuple(video[lo])
            before = [self.ema] if key == self.video else []
            found = list(itertools.accumulate([*before, *values[lo:hi].tolist()], lambda e, x: self.alpha * x + (1 - self.alpha) * e))
            out[lo:hi] = found[len(before) :]
            self.video, self.ema = key, found[-1]
        return out


def _columns(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(video ids and whether they are null, frame indexes, values)."""
    video = batch.column(0)
    ids = np.stack([video.fill_null(0).to_numpy(), video.is_null().to_numpy(zero_copy_only=False).astype(np.int64)], axis=1)
    return ids, batch.column(1).to_numpy(), batch.column(2).to_numpy()


def _ordered(frames: DataFrame, value: str) -> DataFrame:
    rows = frames.select(F.col("video_id").cast("bigint").alias("video_id"), F.col("frame_idx").cast("bigint").alias("frame_idx"), F.col(value).cast("double").alias("v"))
    return rows.filter("v is not null and frame_idx is not null").repartition("video_id").sortWithinPartitions("video_id", "frame_idx")


def running_average(frames: DataFrame, value: str = "mag", config: EngineConfig = DEFAULT) -> DataFrame:
    """(video_id, frame_idx, ema): seeded by the first frame, never reset within a video. A null value gives no row."""
    alpha = config.ema_alpha

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fold = _Fold(alpha)
        for batch in batches:
            if batch.num_rows:
                video, _, values = _columns(batch)
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(fold.add(video, values))], names=["video_id", "frame_idx", "ema"])

    return _ordered(frames, value).mapInArrow(run, "video_id bigint, frame_idx bigint, ema double")


def window_averages(frames: DataFrame, value: str = "mag", window: int = 12, config: EngineConfig = DEFAULT) -> DataFrame:
    """(video_id, win, frame_idx, ema) of the least average in every window of `window` frames, the earliest of equals.
    A last, shorter window counts; a window of no frames gives no rows."""
    alpha = config.ema_alpha

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fold, open_ = _Fold(alpha), None  # the window that the next batch may go on with: one row

        def out(rows: np.ndarray, ema: np.ndarray) -> pa.RecordBatch:
            video = pa.array(rows[:, 0], mask=rows[:, 1] > 0)
            return pa.RecordBatch.from_arrays([video, pa.array(rows[:, 2]), pa.array(rows[:, 3]), pa.array(ema)], names=["video_id", "win", "frame_idx", "ema"])

        for batch in batches:
            if not batch.num_rows:
                continue
            video, idx, values = _columns(batch)
            rows, ema = np.column_stack([video, idx // window, idx]), fold.add(video, values)
            if open_ is not None:
                rows, ema = np.concatenate([open_[0], rows]), np.concatenate([open_[1], ema])
            starts = np.flatnonzero(np.concatenate([[True], (rows[1:, :3] != rows[:-1, :3]).any(axis=1)]))
            least = np.repeat(np.fmin.reduceat(ema, starts), np.diff(np.append(starts, len(ema))))
            best = np.flatnonzero((ema == least) | np.isnan(least))
            first = best[np.searchsorted(best, starts)]
            rows, ema = rows[first], ema[first]
            if len(first) > 1:
                yield out(rows[:-1], ema[:-1])
            open_ = rows[-1:], ema[-1:]
        if open_ is not None:
            yield out(*open_)

    rows = _ordered(frames if window > 0 else frames.filter("false"), value)
    return rows.mapInArrow(run, "video_id bigint, win bigint, frame_idx bigint, ema double")


def window_best_frames(frames: DataFrame, value: str = "mag", window: int = 12, threshold: float | None = None, config: EngineConfig = DEFAULT) -> DataFrame:
    """window_averages below the threshold."""
    limit = config.motion_threshold if threshold is None else threshold
    return window_averages(frames, value, window, config).filter(F.col("ema") < limit)


def relaxed_best_frames(frames: DataFrame, value: str = "mag", window: int = 12, keep: Column | None = None, config: EngineConfig = DEFAULT) -> DataFrame:
    """Per video, the window bests below the lowest tier that leaves any row that `keep` accepts; a video without such a
    tier has no rows. One scan serves all tiers."""
    best = window_averages(frames, value, window, config)
    if keep is not None:
        best = best.filter(keep)
    tier = F.coalesce(*[F.when(F.col("_least") < t, lit(t)) for t in config.motion_tiers])
    least = F.min("ema").over(Window.partitionBy("video_id"))
    return best.withColumn("_least", least).withColumn("threshold", tier).filter("ema < threshold").drop("_least")
