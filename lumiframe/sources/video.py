"""Frames of video files through pluggable decoders.

A decoder is a function that takes an open binary file and its size and returns a Video: what the file says about itself
and an iterator of frames. Decoders are named "module:function", so that executors can import them; a codec library is
added by registering one. A decoder for uncompressed Y4M streams is built in. Files are opened through pyarrow's file
systems, so they may lie in any store that these reach."""

from __future__ import annotations

import importlib
import io
from collections.abc import Callable, Iterator
from contextlib import closing
from dataclasses import dataclass
from typing import BinaryIO

import numpy as np
import pyarrow as pa
import pyarrow.fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from lumiframe.config import DEFAULT, EngineConfig
from lumiframe.functions import scalar as S

FRAME = "path string, frame_idx bigint, total_frames bigint, fps double, width int, height int, pixels binary"
INFO = "path string, total_frames bigint, fps double, width int, height int, error string"


@dataclass
class Video:
    """total_frames is None where only reading on tells; pixels are rows of blue, green, red bytes."""

    fps: float
    width: int
    height: int
    total_frames: int | None
    frames: Iterator[bytes]
    close: Callable[[], None] = lambda: None


_DECODERS = {"y4m": "lumiframe.sources.video:read_y4m"}


def register_decoder(name: str, target: str) -> None:
    """Makes a decoder known by a name; target is "module:function"."""
    _DECODERS[name.lower()] = target


def decoder(name: str) -> Callable[[BinaryIO, int], Video]:
    """The decoder of a registered name or of "module:function"."""
    module, _, function = _DECODERS.get(name.lower(), name).partition(":")
    if not function:
        raise ValueError(f"unknown decoder: {name}")
    return getattr(importlib.import_module(module), function)


def read_y4m(file: BinaryIO, size: int) -> Video:
    """An uncompressed YUV4MPEG2 stream, gray or 4:4:4 (full range)."""
    head = file.readline(4096).decode("ascii", "replace").split()
    if not head or head[0] != "YUV4MPEG2":
        raise ValueError("not a Y4M stream")
    tags = {x[0]: x[1:] for x in head[1:]}
    w, h, colour = int(tags["W"]), int(tags["H"]), tags.get("C", "420")
    if colour not in ("mono", "444"):
        raise ValueError(f"unsupported colour space: {colour}")
    a, b = (float(x) for x in tags.get("F", "25:1").split(":"))
    length = w * h * (1 if colour == "mono" else 3)

    def frames() -> Iterator[bytes]:
        while file.readline(4096):
            data = file.read(length)
            if len(data) < length:  # the last frame is cut short
                return
            planes = np.frombuffer(data, dtype=np.uint8).reshape(-1, h * w).astype(np.float32)
            if colour == "mono":
                bgr = np.repeat(planes[0][:, None], 3, axis=1)
            else:
                y, u, v = planes[0], planes[1] - 128, planes[2] - 128
                bgr = np.stack([y + 1.772 * u, y - 0.344136 * u - 0.714136 * v, y + 1.402 * v], axis=1)
            yield np.clip(np.rint(bgr), 0, 255).astype(np.uint8).tobytes()

    return Video(a / b if b else 0.0, w, h, None, frames())


def _open(path: str) -> tuple[BinaryIO, int]:
    fs, name = pa.fs.FileSystem.from_uri(path) if "://" in path else pa.fs.FileSystem.from_uri("file://" + path.removeprefix("file:"))
    info = fs.get_file_info(name)
    if info.type != pa.fs.FileType.File:
        raise FileNotFoundError(path)
    return io.BufferedReader(fs.open_input_stream(name)), info.size


def _sampled(path: str, name: str, interval: float, stop_at_total: bool, only: int | None) -> Iterator[tuple]:
    """Rows of FRAME: every step-th frame, or the one of an index."""
    file, size = _open(path)
    with closing(file):
        video = decoder(name)(file, size)
        try:
            step = max(1, int(video.fps * interval))
            for i, pixels in enumerate(video.frames):
                if only is not None and i > only or stop_at_total and video.total_frames is not None and i >= video.total_frames:
                    return
                if i == only or only is None and i % step == 0:
                    yield path, i, video.total_frames, video.fps, video.width, video.height, pixels
        finally:
            video.close()


def scan_frames(paths: DataFrame, name: str = "y4m", stop_at_total: bool = True, only: int | None = None, config: EngineConfig = DEFAULT) -> DataFrame:
    """Rows of FRAME of the videos in paths (column path): each frame whose index is a multiple of the sample step, or with
    `only` the frame of that index. One frame at a time is in memory. A file that can't be read, or fails half way, gives the
    frames before that; video_infos tells why."""
    if only is not None and only < 0:
        raise ValueError("negative frame index")
    interval = config.sample_interval_sec

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path in batch.column(0).to_pylist():
                rows = _sampled(path, name, interval, stop_at_total, only)
                while True:
                    try:
                        row = next(rows)
                    except StopIteration:
                        break
                    except Exception:  # noqa: BLE001  the file's error is a row of video_infos
                        break
                    yield pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(row, _TYPES, strict=True)], names=_NAMES)

    return paths.select("path").filter("path is not null").mapInArrow(run, FRAME)


_NAMES = ["path", "frame_idx", "total_frames", "fps", "width", "height", "pixels"]
_TYPES = [pa.string(), pa.int64(), pa.int64(), pa.float64(), pa.int32(), pa.int32(), pa.binary()]


def video_infos(paths: DataFrame, name: str = "y4m") -> DataFrame:
    """Rows of INFO and duration: what each file says about itself, its frames counted where it doesn't say how many. A file that
    can't be read has an error and nulls; no file is an error, too."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path in batch.column(0).to_pylist():
                row = {"path": path, "total_frames": None, "fps": None, "width": None, "height": None, "error": None}
                try:
                    file, size = _open(path)
                    with closing(file):
                        video = decoder(name)(file, size)
                        try:
                            total = video.total_frames if video.total_frames is not None else sum(1 for _ in video.frames)
                        finally:
                            video.close()
                    row |= {"total_frames": total, "fps": video.fps, "width": video.width, "height": video.height}
                except Exception as e:  # noqa: BLE001  an unreadable file is a failed row, not a failed job
                    row["error"] = f"{type(e).__name__}: {e}"
                types = [pa.string(), pa.int64(), pa.float64(), pa.int32(), pa.int32(), pa.string()]
                yield pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(row.values(), types, strict=True)], names=list(row))

    found = paths.select("path").filter("path is not null").mapInArrow(run, INFO)
    return found.withColumn("duration", S.duration(F.col("total_frames"), F.col("fps")))


class FrameSource(DataSource):
    """spark.read.format("frames").option("path", folder or file).option("decoder", name).load(): rows of FRAME, a
    partition for each video file. Options: interval (seconds, 3.0), stop_at_total (true)."""

    @classmethod
    def name(cls) -> str:
        return "frames"

    def schema(self) -> str:
        return FRAME

    def reader(self, schema) -> DataSourceReader:
        return _FrameReader(self.options)


class _FrameReader(DataSourceReader):
    def __init__(self, options: dict):
        self.path, self.decoder = options["path"], options.get("decoder", "y4m")
        self.interval = float(options.get("interval", DEFAULT.sample_interval_sec))
        self.stop = str(options.get("stop_at_total", "true")).lower() == "true"

    def partitions(self) -> list[InputPartition]:
        fs, name = pa.fs.FileSystem.from_uri(self.path if "://" in self.path else "file://" + self.path)
        info = fs.get_file_info(name)
        found = [info] if info.type == pa.fs.FileType.File else fs.get_file_info(pa.fs.FileSelector(name, recursive=True)) if info.type == pa.fs.FileType.Directory else []
        prefix = self.path[: self.path.index("://") + 3] if "://" in self.path else ""
        videos = [f.path for f in found if f.type == pa.fs.FileType.File and f.path.lower().endswith(tuple("." + e for e in DEFAULT.video_extensions))]
        return [InputPartition(prefix + p) for p in sorted(videos)]

    def read(self, partition: InputPartition | None) -> Iterator[tuple]:
        if partition is not None:
            yield from _sampled(partition.value, self.decoder, self.interval, self.stop, None)


def register(spark: SparkSession) -> None:
    """Makes the format "frames" known to a session."""
    spark.dataSource.register(FrameSource)
