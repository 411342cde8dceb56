"""The motion scan as a stream: state (average, open window, its best frame) per video, nothing else is kept.

Frames of a micro-batch are put in order by index. A frame that comes in a later batch than one of a higher index is
dropped and counted in the state: the average can't go back. A window is emitted when a frame of a later one comes; the last
window of a video is emitted when its end marker (null mag) comes."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from lumiframe.config import DEFAULT, EngineConfig

OUTPUT = "video_id bigint, win bigint, frame_idx bigint, ema double"
STATE = "last bigint, ema double, win bigint, best_idx bigint, best double, late bigint"


def streaming_windows(frames: DataFrame, value: str = "mag", window: int = 12, config: EngineConfig = DEFAULT) -> DataFrame:
    """Streaming form of motion.window_averages. frames: a stream of (video_id, frame_idx, value)."""
    alpha = config.ema_alpha

    def step(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        last, ema, win, best_idx, best, late = state.get if state.exists else (-1, None, None, None, None, 0)
        rows = pd.concat(list(parts)).sort_values("frame_idx", kind="stable")
        out = []
        for idx, x in zip(rows["frame_idx"].tolist(), rows["v"].tolist(), strict=True):
            if idx <= last:
                late += 1
                continue
            last = idx
            if x is None or x != x:
                if win is not None:
                    out.append((key[0], win, best_idx, best))
                win = None
                continue
            ema = x if ema is None else alpha * x + (1 - alpha) * ema
            if win is not None and idx // window != win:
                out.append((key[0], win, best_idx, best))
                win = None
            if win is None or ema < best:
                win, best_idx, best = idx // window, idx, ema
        state.update((last, ema, win, best_idx, best, late))
        yield pd.DataFrame(out, columns=["video_id", "win", "frame_idx", "ema"])

    rows = frames.select("video_id", "frame_idx", F.col(value).alias("v"))
    return rows.groupBy("video_id").applyInPandasWithState(step, OUTPUT, STATE, "append", GroupStateTimeout.NoTimeout)


def upsert_cache(stream: DataFrame, path: str, checkpoint: str):
    """Append every micro-batch of cache entries to the table at path; readers take cache.latest of it."""
    return stream.writeStream.foreachBatch(lambda df, _: df.write.mode("append").parquet(path)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
