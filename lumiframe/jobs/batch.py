"""The batch job: videos of a folder (or of requests) to results, thumbnails, logs and cache.

A run lists the videos, leaves out those that the log has as processed, takes results of unchanged files from the cache, scans
and scores the others, writes the results as a new part of a table, then thumbnails, cache and logs in this order. So a run
that breaks off is done again by the next one, and a run with nothing new changes nothing."""

from __future__ import annotations

import importlib
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lumiframe.config import DEFAULT, EngineConfig
from lumiframe.functions import scalar as S
from lumiframe.operators import cache, hooks, scoring
from lumiframe.sources.readers import list_videos
from lumiframe.sources.video import scan_frames, video_infos


def load(target: str) -> Callable:
    """What "module:function" names."""
    module, _, function = target.partition(":")
    return getattr(importlib.import_module(module), function)


def signed(files: DataFrame) -> DataFrame:
    """files (path, length, modificationTime) with their signature."""
    return files.withColumn("signature", S.file_signature(F.col("path"), F.col("length"), F.col("modificationTime").cast("double").cast("string")))


def analyse(files: DataFrame, detector: Callable, decoder: str = "y4m", config: EngineConfig = DEFAULT) -> DataFrame:
    """(path, success, valid_frames, error) of files (path): frames sampled, filtered by quality, scored by their faces, up to
    the first one good enough. detector: a factory as in hooks.detect_faces. A file that can't be read is a failure."""
    infos = video_infos(files, decoder).withColumn("video_id", F.xxhash64("path"))
    frames = scan_frames(files, decoder, config=config).withColumn("video_id", F.xxhash64("path"))
    good = hooks.pixel_quality(frames).filter((F.col("brightness") > config.min_brightness) & (F.col("contrast") > config.min_contrast))
    found = hooks.detect_faces(good, detector)
    faces = found.join(infos.select("video_id", F.col("width").cast("double").alias("width"), F.col("height").cast("double").alias("height")), "video_id")
    valid = scoring.valid_frames(scoring.early_exit(scoring.frame_scores(faces, config=config), config), config)
    maps = scoring.result_map(scoring.frames_by_score(valid))
    empty = F.create_map().cast("map<string,array<bigint>>")
    out = infos.select("video_id", "path", "error").join(maps, "video_id", "left")
    ok = F.col("error").isNull()
    return out.select("path", ok.alias("success"), F.when(ok, F.coalesce("valid_frames", empty)).alias("valid_frames"), "error")


def thumbnails(results: DataFrame, encoder: Callable, input_base: str, output_base: str, decoder: str, ext: str = "webp") -> DataFrame:
    """(path, error) of the best frames' images, written below output_base as the videos lie below input_base. encoder: a
    factory as in hooks.encode. A video without valid frames gets its first frame."""
    rows = results.filter("success").withColumn("video_id", F.xxhash64("path"))
    first = F.coalesce(S.best_frames(F.col("valid_frames"))[0], F.lit(0).cast("bigint"))
    wanted = rows.select("path", "video_id", first.alias("best"))
    frames = scan_frames(wanted, decoder, config=_EVERY).join(wanted, "path").filter("frame_idx = best")
    images = hooks.encode(frames, encoder).join(wanted, "video_id")
    place = S.output_path(F.col("path"), F.lit(input_base), F.lit(output_base), ext)
    return hooks.write_files(images.select(place.alias("path"), "data"))


#: Every frame is read, since only reading on finds a frame.
_EVERY = EngineConfig(sample_interval_sec=0.0)


def run(spark: SparkSession, input_base: str, output_base: str, detector: Callable, encoder: Callable | None = None, decoder: str = "y4m", config: EngineConfig = DEFAULT) -> DataFrame:
    """One incremental run from input_base to output_base; returns (path, success, valid_frames, error) of what was pending."""
    base = input_base if "://" in input_base or input_base.startswith("file:") else f"file:{input_base}"
    files = signed(list_videos(spark, base, config))
    pending = cache.pending(files, cache.processed(spark, f"{output_base}/logs")).select("path", "signature")
    known = cache.current(spark, f"{output_base}/cache")
    if pending.isEmpty():
        return spark.createDataFrame([], "path string, success boolean, valid_frames map<string,array<bigint>>, error string")
    if known is None:
        known = spark.createDataFrame([], "signature string, file_path string, valid_frames map<string,array<bigint>>, cached_at double")
    looked = cache.lookup(pending, known)
    fresh = analyse(looked.filter("not hit"), detector, decoder, config)
    hits = looked.filter("hit").select("path", F.lit(True).alias("success"), F.col("cached_frames").alias("valid_frames"), F.lit(None).cast("string").alias("error"))
    number = sum(1 for _ in _runs(spark, f"{output_base}/results"))
    table = f"{output_base}/results/run={number}"
    fresh.unionByName(hits).write.mode("overwrite").parquet(table)
    results = spark.read.parquet(table)
    if encoder is not None:
        thumbnails(results, encoder, base, f"{output_base}/thumbnails", decoder).write.mode("overwrite").parquet(f"{output_base}/thumbnail_status/run={number}")
    entries = results.filter("success").join(pending, "path").select("signature", F.col("path").alias("file_path"), "valid_frames", F.unix_millis(F.current_timestamp()).cast("double").alias("cached_at"))
    entries = entries.withColumn("cached_at", F.col("cached_at") / 1000)
    if not cache.changed(entries, known).isEmpty():
        cache.flush(cache.upsert(known, entries), f"{output_base}/cache")
    cache.append_logs(results.select("path", "success", "error"), f"{output_base}/logs")
    return results


def _runs(spark: SparkSession, path: str):
    fs, base = cache._fs(spark, path)
    if fs.exists(base):
        yield from (f for f in fs.listStatus(base) if f.getPath().getName().startswith("run="))
