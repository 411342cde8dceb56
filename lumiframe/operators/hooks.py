"""Boundaries to Python code that Spark can't express: model inference, pixel encoders, external cutters.

Each takes a factory that is called once a partition (to load a model or codec) and returns a function of one row's values."""

from __future__ import annotations

import re
import time
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lumiframe.functions.geometry import GRAY_WEIGHTS
from lumiframe.functions.scalar import OOM_PATTERNS
from lumiframe.schemas import DETECTIONS


#: Python's form of functions.scalar.is_out_of_memory.
_OOM = re.compile("|".join(OOM_PATTERNS))


def with_retry(call: Callable, times: int = 10, delay: float = 10.0, clear: Callable[[], None] = lambda: None) -> Callable:
    """call, tried again after an error that says the device is out of memory: `times` more times, each after clear() and a
    pause. Another error, or the last of these, is raised."""

    def run(*args):
        for left in range(times, -1, -1):
            try:
                return call(*args)
            except Exception as e:
                if not left or not _OOM.search(str(e).lower()):
                    raise
            clear()
            time.sleep(delay)

    return run


def detect_faces(frames: DataFrame, factory: Callable[[], Callable[[bytes, int, int], list[dict]]], retries: int = 10, delay: float = 10.0) -> DataFrame:
    """Rows of schemas.DETECTIONS from frames (video_id, frame_idx, pixels, width, height): the model gives a frame's faces as dicts
    of confidence, bbox and landmarks. A face of fewer than four box values or without landmarks is dropped; face_id
    counts from 1 before that. A frame is tried again where the device is out of memory; a frame that fails otherwise
    has no faces. A model with a method `close` is closed at the end, with `clear` that runs before another try."""

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        loaded = None

        def model(*args) -> list[dict]:
            try:
                return tried(*args)
            except Exception:
                return []

        try:
            for pdf in parts:
                if loaded is None:  # a partition without frames needs no model
                    loaded = factory()
                    tried = with_retry(loaded, retries, delay, getattr(loaded, "clear", lambda: None))
                yield faces_of(pdf, model)
        finally:
            getattr(loaded, "close", lambda: None)()

    def faces_of(pdf: pd.DataFrame, model: Callable) -> pd.DataFrame:
        rows = []
        for v, i, pixels, w, h in zip(*(pdf[c] for c in ("video_id", "frame_idx", "pixels", "width", "height")), strict=True):
            for n, face in enumerate(model(pixels, w, h), 1):
                if len(face.get("bbox") or ()) >= 4 and face.get("landmarks") is not None:
                    rows.append((v, i, n, face["confidence"], list(face["bbox"]), list(face["landmarks"])))
        return pd.DataFrame(rows, columns=["video_id", "frame_idx", "face_id", "confidence", "bbox", "landmarks"])

    return frames.select("video_id", "frame_idx", "pixels", "width", "height").mapInPandas(run, DETECTIONS)


def encode(frames: DataFrame, factory: Callable[[], Callable[[bytes, int, int], bytes]]) -> DataFrame:
    """(video_id, frame_idx, data): each frame's pixels encoded; null where the encoder fails, so that one bad frame
    doesn't stop the rest."""

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        codec = factory()

        def safe(*args):
            try:
                return codec(*args)
            except Exception:
                return None

        for pdf in parts:
            data = [safe(p, w, h) for p, w, h in zip(pdf["pixels"], pdf["width"], pdf["height"], strict=True)]
            yield pd.DataFrame({"video_id": pdf["video_id"], "frame_idx": pdf["frame_idx"], "data": data})

    return frames.select("video_id", "frame_idx", "pixels", "width", "height").mapInPandas(run, "video_id bigint, frame_idx bigint, data binary")


def responses(results: DataFrame) -> DataFrame:
    """JSON answers of results (path, success, output_path, error): the output path or the error, and the status code."""
    body = F.when(F.col("success"), F.to_json(F.struct("success", "output_path"))).otherwise(F.to_json(F.struct("success", "error")))
    return results.select("path", body.alias("body"), F.when(F.col("success"), 200).otherwise(500).alias("code"))


def pixel_quality(frames: DataFrame) -> DataFrame:
    """frames with brightness and contrast (as operators.detect has them for gray planes) of their pixels: rows of blue,
    green, red bytes; null where the pixels don't fit the size. One frame at a time."""
    names = [*frames.columns, "brightness", "contrast"]
    at = [frames.columns.index(c) for c in ("pixels", "width", "height")]

    def measure(pixels: bytes | None, width: int | None, height: int | None) -> tuple:
        if pixels is None or not width or not height or len(pixels) != 3 * width * height:
            return None, None
        gray = np.floor(np.frombuffer(pixels, dtype=np.uint8).reshape(-1, 3) @ np.array(GRAY_WEIGHTS) + 0.5) * 100 / 255
        mean = gray.mean()
        return float(mean), float(np.abs(gray - mean).std(ddof=1)) if len(gray) > 1 else None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [measure(*row) for row in zip(*(batch.column(i).to_pylist() for i in at), strict=True)]
            new = [pa.array([f[k] for f in found], pa.float64()) for k in (0, 1)]
            yield pa.RecordBatch.from_arrays([*batch.columns, *new], names=names)

    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in frames.schema.fields)
    return frames.mapInArrow(run, f"{kinds}, brightness double, contrast double")


def cut(segments: DataFrame, factory: Callable[[], Callable[[str, float, float], bytes]]) -> DataFrame:
    """(video_id, start_time, end_time, data) of segments (video_id, path, start_time, end_time): a cutter's piece of each file.
    A segment that fails is skipped, the others stay."""

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        cutter = factory()
        for pdf in parts:
            out = []
            for v, path, a, b in zip(*(pdf[c] for c in ("video_id", "path", "start_time", "end_time")), strict=True):
                try:
                    out.append((v, a, b, cutter(path, a, b)))
                except Exception:
                    continue
            yield pd.DataFrame(out, columns=["video_id", "start_time", "end_time", "data"])

    return segments.select("video_id", "path", "start_time", "end_time").mapInPandas(run, "video_id bigint, start_time double, end_time double, data binary")


def concatenate(pieces: DataFrame, factory: Callable[[], Callable[[list[bytes]], bytes]]) -> DataFrame:
    """(video_id, data): the pieces of each video in order of start, joined; a video without pieces has no row, one whose
    joining fails has null data. A video's pieces are short (preview_segments) and meet in one task."""

    def run(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        try:
            data = factory()(pdf.sort_values("start_time")["data"].tolist())
        except Exception:
            data = None
        return pd.DataFrame({"video_id": [key[0]], "data": [data]})

    return pieces.groupBy("video_id").applyInPandas(run, "video_id bigint, data binary")


def preview(segments: DataFrame, cutter: Callable, joiner: Callable, enabled: bool = True) -> DataFrame:
    """(video_id, data) of the previews that segments (with path) make; nothing unless enabled."""
    return concatenate(cut(segments if enabled else segments.filter("false"), cutter), joiner)


def write_files(rows: DataFrame) -> DataFrame:
    """(path, error) after writing rows (path, data): each to a hidden file beside its place first, then moved there, so that
    a task that runs again writes the same files. Null data is an error."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs as pafs

        for batch in batches:
            paths, errors = batch.column(0).to_pylist(), []
            for path, data in zip(paths, batch.column(1).to_pylist(), strict=True):
                try:
                    if data is None:
                        raise ValueError("no data")
                    fs, name = pafs.FileSystem.from_uri(path if "://" in path else "file://" + path.removeprefix("file:"))
                    folder, _, own = name.rpartition("/")
                    fs.create_dir(folder, recursive=True)
                    with fs.open_output_stream(f"{folder}/.{own}.part") as out:
                        out.write(data)
                    fs.move(f"{folder}/.{own}.part", name)
                    errors.append(None)
                except Exception as e:
                    errors.append(f"{type(e).__name__}: {e}")
            yield pa.RecordBatch.from_arrays([pa.array(paths, pa.string()), pa.array(errors, pa.string())], names=["path", "error"])

    return rows.select("path", "data").mapInArrow(run, "path string, error string")
