"""Face and frame scores, groups of frames by score, selections."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lumiframe.config import DEFAULT, EngineConfig
from lumiframe.functions import geometry as G
from lumiframe.functions.scalar import lit


def _basic(config: EngineConfig) -> Column:
    box = G.box(F.col("bbox"))
    return G.basic_score(box["width"], box["height"], F.col("width"), F.col("height"), F.col("confidence"), config)


#: Scorers by the names that a score_chain holds: config -> Column over a detection row. Unknown names are skipped.
SCORERS: dict[str, Callable[[EngineConfig], Column]] = {"BasicFilter": _basic, "GeometryFilter": lambda config: G.geometry_score(F.col("landmarks"))}


def face_score(config: EngineConfig = DEFAULT) -> Column:
    """The sum over the chain; 0 for an empty one."""
    out = lit(0)
    for name in config.score_chain:
        if name in SCORERS:
            out = out + SCORERS[name](config)
    return out


def frame_scores(detections: DataFrame, frames: DataFrame | None = None, config: EngineConfig = DEFAULT) -> DataFrame:
    """(video_id, frame_idx, score): the best face's score. frames adds those without any face, at 0."""
    best = detections.groupBy("video_id", "frame_idx").agg(F.max(face_score(config)).alias("score"))
    if frames is None:
        return best
    return frames.select("video_id", "frame_idx").join(best, ["video_id", "frame_idx"], "left").withColumn("score", F.coalesce("score", lit(0)))


def valid_frames(scores: DataFrame, config: EngineConfig = DEFAULT) -> DataFrame:
    return scores.filter(F.col("score") >= config.keep_score)


def take_until(rows: DataFrame, hit: Column, group: str = "video_id", order: str = "frame_idx") -> DataFrame:
    """Each group's rows up to and including the first hit."""
    before = Window.partitionBy(group).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    seen = F.sum(hit.cast("int")).over(before)
    return rows.withColumn("_seen", F.coalesce(seen, F.lit(0))).filter("_seen = 0").drop("_seen")


def early_exit(scores: DataFrame, config: EngineConfig = DEFAULT) -> DataFrame:
    return scores if config.search_all else take_until(scores, F.col("score") >= config.stop_score)


def frames_by_score(valid: DataFrame) -> DataFrame:
    """(video_id, score, frames): the sorted frame indexes of each score."""
    return valid.groupBy("video_id", "score").agg(F.sort_array(F.collect_list("frame_idx")).alias("frames"))


def result_map(grouped: DataFrame) -> DataFrame:
    """One map from score to frames per video, keyed by the score's text."""
    entry = F.struct(F.col("score").cast("string"), "frames")
    return grouped.groupBy("video_id").agg(F.map_from_entries(F.array_sort(F.collect_list(entry))).alias("valid_frames"))


def result_rows(videos: DataFrame, grouped: DataFrame) -> DataFrame:
    """(video_id, success, valid_frames) of every video; one without frames has an empty map."""
    empty = F.create_map().cast("map<string,array<bigint>>")
    maps = result_map(grouped)
    return videos.select("video_id").join(maps, "video_id", "left").select("video_id", F.lit(True).alias("success"), F.coalesce("valid_frames", empty).alias("valid_frames"))


def best_frame(videos: DataFrame, valid: DataFrame) -> DataFrame:
    """(video_id, frame_idx, score) of the first frame of the highest score; frame 0 where a video has none."""
    best = valid.groupBy("video_id").agg(F.min(F.struct((-F.col("score")).alias("s"), "frame_idx")).alias("b"))
    return videos.select("video_id").join(best, "video_id", "left").select("video_id", F.coalesce("b.frame_idx", F.lit(0)).cast("bigint").alias("frame_idx"), (-F.col("b.s")).alias("score"))


def filter_counters(detections: DataFrame, config: EngineConfig = DEFAULT) -> DataFrame:
    """One row a video: how many faces pass each test of the scorers."""
    box = G.box(F.col("bbox"))
    size = (box["width"] > config.min_face_size) & (box["height"] > config.min_face_size)
    ratio = (box["width"] / F.col("width") > config.min_face_ratio) & (box["height"] / F.col("height") > config.min_face_ratio)
    sure = F.col("confidence") >= config.min_confidence
    quad, nose = G.face_geometry(F.col("landmarks"))
    tests = {"confidence_passed": sure, "size_passed": size, "ratio_passed": ratio, "basic_passed": sure & size & ratio, "quad_valid": quad, "nose_inside": nose}
    return detections.groupBy("video_id").agg(F.count("*").alias("total"), *[F.count_if(t).alias(n) for n, t in tests.items()])
