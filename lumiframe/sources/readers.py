"""Readers: file listing, cache file, logs, annotation texts, captured probes, requests."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lumiframe import schemas
from lumiframe.config import DEFAULT, EngineConfig
from lumiframe.functions import scalar
from lumiframe.functions.geometry import euler_from_matrix


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def list_videos(spark: SparkSession, base: str, config: EngineConfig = DEFAULT) -> DataFrame:
    """(path, length, modificationTime) of the video files at or below base. File contents aren't read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(base).select("path", "length", "modificationTime")
    return files.filter(scalar.is_video(F.col("path"), config))


def read_processed_log(spark: SparkSession, path: str) -> DataFrame:
    """Distinct trimmed lines that aren't blank."""
    return processed_paths(spark.read.text(path), "value")


def processed_paths(lines: DataFrame, column: str) -> DataFrame:
    return lines.select(F.trim(column).alias("path")).filter("length(path) > 0").distinct()


def read_cache_file(spark: SparkSession, path: str) -> DataFrame:
    """Rows of schemas.CACHE from files of a JSON object that maps signatures to entries. A file is one value, as its
    writer rewrites it whole; large caches are tables (operators.cache)."""
    return cache_entries(spark.read.text(path, wholetext=True), "value")


def cache_entries(texts: DataFrame, column: str) -> DataFrame:
    """Rows of schemas.CACHE from a column of such JSON objects; a text that isn't one has none."""
    parsed = texts.select(F.from_json(column, schemas.CACHE_FILE)["cache"].alias("c"))
    entry = parsed.select(F.explode("c").alias("signature", "e"))
    return entry.select("signature", "e.file_path", "e.valid_frames", "e.cached_at")


def read_pose_csv(spark: SparkSession, path: str) -> DataFrame:
    raw = spark.read.schema(schemas.POSE_CSV).csv(path, header=False)
    return raw.withColumn("path", F.regexp_replace("path", "^﻿", ""))


def _tokens(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.text(path).select(F.split(F.trim("value"), " ").alias("t")).filter("t[0] <> ''")


def read_pose_text(spark: SparkSession, path: str, radians: bool, with_box: bool = False) -> DataFrame:
    """Space-delimited rows: name and three angles, then a box if with_box. Radians become degrees; a roll in radians
    also turns its sign."""
    return _tokens(spark, path).select(*pose_fields(F.col("t"), radians, with_box))


def pose_fields(t: Column, radians: bool, with_box: bool = False) -> list[Column]:
    """Name, yaw, pitch, roll (and box) of such a row's tokens."""
    yaw, pitch, roll = (t[i].try_cast("double") for i in (1, 2, 3))
    angles = [F.degrees(yaw), F.degrees(pitch), -F.degrees(roll)] if radians else [yaw, pitch, roll]
    cols = [t[0].alias("name"), *[a.alias(n) for a, n in zip(angles, ("yaw", "pitch", "roll"), strict=True)]]
    if with_box:
        cols += [t[4 + i].try_cast("double").alias(n) for i, n in enumerate(("x_min", "y_min", "x_max", "y_max"))]
    return cols


def read_rotations(spark: SparkSession, poses: str, boxes: str) -> DataFrame:
    """(name, yaw, pitch, roll, x_min, y_min, x_max, y_max) of files with a rotation matrix (name_pose.txt: three rows, then
    a translation) and of files with a box (dockerface-name_rgb.txt: a label and four numbers); angles in degrees. A box
    line of fewer than four tokens, or no box file, gives a null box: the whole image."""
    part = lambda pattern: F.regexp_extract(F.col("_metadata.file_path"), pattern, 1)
    number = F.filter(F.split(F.trim("value"), r"\s+"), lambda x: x != "")
    rows = spark.read.text(poses, wholetext=True).select(part(r"([^/]*)_pose\.[^./]*$").alias("name"), F.filter(F.split("value", "\n"), lambda x: F.trim(x) != "").alias("r"))
    cell = lambda i, j: F.get(F.filter(F.split(F.trim(F.get(F.col("r"), F.lit(i))), r"\s+"), lambda x: x != ""), F.lit(j)).try_cast("double")
    roll, pitch, yaw = euler_from_matrix([[cell(i, j) for j in range(3)] for i in range(3)])
    angles = rows.select("name", yaw.alias("yaw"), pitch.alias("pitch"), roll.alias("roll"))
    line = spark.read.text(boxes).withColumn("_p", F.monotonically_increasing_id())
    first = line.select(part(r"dockerface-([^/]*)_rgb\.[^./]*$").alias("name"), "_p", number.alias("t")).groupBy("name").agg(F.min_by("t", "_p").alias("t"))
    box = [F.when(F.size("t") >= 4, F.get("t", F.lit(i + 1)).try_cast("double")).alias(n) for i, n in enumerate(("x_min", "y_min", "x_max", "y_max"))]
    return angles.join(first.select("name", *box), "name", "left")


def read_model_config(spark: SparkSession, path: str) -> DataFrame:
    """(name, key, value) of a JSON file whose `models` object holds an object of settings for each model."""
    models = spark.read.text(path, wholetext=True).select(F.from_json("value", "models map<string,map<string,string>>")["models"].alias("m"))
    return models.select(F.explode("m").alias("name", "s")).select("name", F.explode("s").alias("key", "value"))


def read_names(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.text(path).select(F.col("value").alias("name"))


def requests(spark: SparkSession, path: str) -> DataFrame:
    """Request rows from JSON lines, with the parsed resolution; `valid` says whether it is absent or well-formed."""
    raw = spark.read.schema(schemas.REQUEST).json(path)
    size = scalar.parse_resolution(F.col("resolution"))
    return raw.withColumns({"size": size, "valid": F.col("resolution").isNull() | size.isNotNull()})


#: Frame scans by name; each takes the frames table and returns the sampled rows.
def sampled_scan(frames: DataFrame, fps: Column, total: Column | None) -> DataFrame:
    keep = F.col("frame_idx") % scalar.sample_step(fps) == 0
    return frames.filter(keep if total is None else keep & (F.col("frame_idx") < total))


def _motion_scan(*args, **kwargs) -> DataFrame:
    from lumiframe.operators.motion import window_best_frames

    return window_best_frames(*args, **kwargs)


_SCANS: dict = {"cv2": sampled_scan, "decord": lambda frames, fps, total: sampled_scan(frames, fps, None), "mvextractor": _motion_scan}


def register_scan(name: str, f) -> None:
    """Makes a scan of one's own known by a name."""
    _SCANS[name.lower()] = f


def scan(name: str):
    """The scan of a name in any case: `cv2` stops at total_frames, `decord` doesn't, `mvextractor` is the motion scan
    (operators.motion). A name that isn't registered is an error."""
    if name.lower() not in _SCANS:
        raise ValueError(f"unknown scan: {name}")
    return _SCANS[name.lower()]


def frame_at(frames: DataFrame, index: int, total: int | None = None) -> DataFrame:
    """The frame of an index in each video; an index below 0 or not below total, if that is known, is an error."""
    if index < 0:
        raise ValueError("negative frame index")
    if total is not None and index >= total:
        raise IndexError("frame index out of range")
    return frames.filter(F.col("frame_idx") == index)
