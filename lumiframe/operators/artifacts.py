"""Plans of artefacts: animation ranges, key frames, preview segments, merged segment results."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lumiframe.config import DEFAULT, EngineConfig
from lumiframe.functions import scalar as S
from lumiframe.functions.scalar import lit


def animation_plan(start: DataFrame, config: EngineConfig = DEFAULT) -> DataFrame:
    """(video_id, pos, frame_idx, delay_ms) of the frames from `frame_idx` on, at most animation_sec long; rows hold fps and
    total_frames. No rows where the rate isn't in (0, 120] or nothing is left."""
    fps = S.usable_fps(F.col("fps"))
    n = F.least(S.truncate(fps * lit(config.animation_sec)), F.col("total_frames") - F.col("frame_idx"))
    rows = start.withColumn("_n", F.when(fps > 0, n).otherwise(0)).filter("_n > 0").withColumn("_delay", S.truncate(lit(1000) / F.col("fps")))
    return rows.select("video_id", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("_n") - 1)).alias("pos"), "frame_idx", "_delay").select("video_id", "pos", (F.col("frame_idx") + F.col("pos")).alias("frame_idx"), F.col("_delay").alias("delay_ms"))


def keyframe_features(valid: DataFrame, videos: DataFrame) -> DataFrame:
    joined = valid.join(videos.select("video_id", "total_frames"), "video_id")
    share = F.when(F.col("total_frames") > 0, F.col("frame_idx") / F.col("total_frames")).otherwise(lit(0))
    return joined.select("video_id", "frame_idx", share.alias("t"), "score")


def keyframes(features: DataFrame, config: EngineConfig = DEFAULT, rounds: int = 10) -> DataFrame:
    """(video_id, frame_idx): all distinct frames of a video with at most preview_frames rows; else for each cluster of
    (t, score) the frame nearest its centre. The clusters come from Lloyd rounds whose first centres are the rows at equal
    steps in the order of (t, score, frame), so the result is fixed."""
    k = config.preview_frames
    w = Window.partitionBy("video_id")
    n = F.count("*").over(w)
    place = F.row_number().over(w.orderBy("t", "score", "frame_idx")) - 1
    rows = features.withColumns({"_n": n, "_p": place})
    small = rows.filter(F.col("_n") <= k).select("video_id", "frame_idx").distinct()
    big = rows.filter(F.col("_n") > k)
    first = F.floor(F.col("_p") * k / F.col("_n"))
    centres = big.withColumn("c", first).groupBy("video_id", "c").agg(F.min_by("t", "_p").alias("ct"), F.min_by("score", "_p").alias("cs"))
    for _ in range(rounds):
        centres = _nearest(big, centres).groupBy("video_id", "c").agg(F.avg("t").alias("ct"), F.avg("score").alias("cs"))
    near = _nearest(big, centres)
    best = near.groupBy("video_id", "c").agg(F.min(F.struct("dist", "frame_idx"))["frame_idx"].alias("frame_idx"))
    return small.unionByName(best.select("video_id", "frame_idx").distinct())


def _nearest(rows: DataFrame, centres: DataFrame) -> DataFrame:
    """Each row with its nearest centre; a video has at most preview_frames centres, which travel as one array."""
    packed = centres.groupBy("video_id").agg(F.array_sort(F.collect_list(F.struct("c", "ct", "cs"))).alias("cc"))
    dist = lambda x: (x["ct"] - F.col("t")) * (x["ct"] - F.col("t")) + (x["cs"] - F.col("score")) * (x["cs"] - F.col("score"))
    best = F.array_min(F.transform("cc", lambda x: F.struct(dist(x).alias("dist"), x["c"].alias("c"))))
    return rows.join(packed, "video_id").withColumn("_b", best).select("video_id", "frame_idx", "t", "score", "_b.c", "_b.dist")


def preview_segments(keys: DataFrame, config: EngineConfig = DEFAULT) -> DataFrame:
    """Segments (video_id, start_time, end_time, key_frame_idx, key_frame_time) around key frames, overlapping or touching
    ones merged under their first key; rows hold frame_idx, fps and duration. A rate of 0 or less gives no rows."""
    pad, most = lit(config.preview_padding_sec), lit(config.preview_max_sec)
    t = F.col("frame_idx") / F.col("fps")
    rows = keys.filter("fps > 0").withColumn("t", t).withColumns({"s": F.greatest(lit(0), F.col("t") - pad), "e": F.least(F.col("duration"), F.col("t") + pad)})
    long_ = F.col("e") - F.col("s") > most
    rows = rows.select("video_id", "frame_idx", "t", F.when(long_, F.col("t") - most / 2).otherwise(F.col("s")).alias("s"), F.when(long_, F.col("t") + most / 2).otherwise(F.col("e")).alias("e"))
    return merge_intervals(rows)


def merge_intervals(rows: DataFrame) -> DataFrame:
    """Merged (s, e) of each video with frame_idx and t of the first; touching intervals merge."""
    order = Window.partitionBy("video_id").orderBy("s", "t", "frame_idx")
    reach = F.max("e").over(order.rowsBetween(Window.unboundedPreceding, -1))
    new = F.when(reach.isNull() | (F.col("s") > reach), 1).otherwise(0)
    marked = rows.withColumn("_new", new).withColumn("_group", F.sum("_new").over(order))
    first = F.min(F.struct("s", "t", "frame_idx"))
    out = marked.groupBy("video_id", "_group").agg(F.max("e").alias("end_time"), first.alias("f"))
    return out.select("video_id", F.col("f.s").alias("start_time"), "end_time", F.col("f.frame_idx").alias("key_frame_idx"), F.col("f.t").alias("key_frame_time"))


def concat_manifest(segments: DataFrame) -> DataFrame:
    """(video_id, parts): each video's segments in order, as texts start-end; videos without any have no row."""
    part = F.struct("start_time", F.format_string("%.3f-%.3f", "start_time", "end_time").alias("part"))
    return segments.groupBy("video_id").agg(F.array_sort(F.collect_list(part)).getField("part").alias("parts"))


def merge_segment_results(results: DataFrame, by_success: bool = False) -> DataFrame:
    """(video_id, score, frames): frames of a video's segments at their place in the whole, distinct and sorted. Rows:
    video_id, segment, segment_sec, fps, success, score, frame_idx (null score: no frame). A segment's offset is that of
    its number; by_success takes its place among those that succeeded."""
    ok = results.filter("success")
    number = F.dense_rank().over(Window.partitionBy("video_id").orderBy("segment")) - 1 if by_success else F.col("segment")
    placed = ok.withColumn("_n", number).withColumn("_f", F.col("frame_idx") + S.truncate(F.col("_n") * F.col("segment_sec") * F.col("fps")))
    return placed.filter("score is not null").groupBy("video_id", "score").agg(F.sort_array(F.collect_set("_f")).alias("frames"))


def segment_counts(results: DataFrame) -> DataFrame:
    each = results.select("video_id", "segment", "success").distinct()
    return each.groupBy("video_id").agg(F.count_if("success").alias("succeeded"), F.count_if(~F.col("success")).alias("failed"))


def split_plan(videos: DataFrame, segments: int, config: EngineConfig = DEFAULT) -> DataFrame:
    """(video_id, segment, start_sec, segment_sec): equal parts of the videos (video_id, duration) that are longer than
    split_min_duration_sec; the others, and all if segments is 1 or less, are one part."""
    n = F.when(F.col("duration") > config.split_min_duration_sec, F.lit(max(1, segments))).otherwise(1)
    rows = videos.select("video_id", "duration", n.alias("_n")).withColumn("segment", F.explode(F.sequence(F.lit(0), F.col("_n") - 1)))
    part = F.col("duration") / F.col("_n")
    return rows.select("video_id", "segment", (F.col("segment") * part).alias("start_sec"), part.alias("segment_sec"))


def assign_centres(features: DataFrame, centres: DataFrame) -> DataFrame:
    """features (video_id, frame_idx, t, score) with the nearest centre c of their video and its squared distance; centres:
    (video_id, c, ct, cs), at most preview_frames a video. Of equal distances the least c."""
    return _nearest(features, centres)
