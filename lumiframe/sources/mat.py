"""Numeric arrays of MAT files (level 5), and the pose annotations kept in them."""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: The format's numbers of element types, as numpy's types.
_KINDS = {1: "i1", 2: "u1", 3: "i2", 4: "u2", 5: "i4", 6: "u4", 7: "f4", 9: "f8", 12: "i8", 13: "u8"}
_MATRIX, _COMPRESSED = 14, 15


def _elements(data: bytes, order: str) -> Iterator[tuple[int, bytes]]:
    """(type, content) of the elements one after another; small ones keep type and size in one word."""
    at = 0
    while at + 8 <= len(data):
        kind, size = struct.unpack_from(order + "II", data, at)
        if kind >> 16:
            size, kind = kind >> 16, kind & 0xFFFF
            yield kind, data[at + 4 : at + 4 + size]
            at += 8
        else:
            yield kind, data[at + 8 : at + 8 + size]
            at += 8 + size + (-size % 8 if kind != _COMPRESSED else 0)


def arrays(data: bytes) -> dict[str, np.ndarray]:
    """The numeric arrays of a file by name; other variables are left out."""
    if len(data) < 128 or data[126:128] not in (b"IM", b"MI"):
        raise ValueError("not a MAT file of level 5")
    order, out = "<" if data[126:128] == b"IM" else ">", {}
    for kind, content in _elements(data[128:], order):
        if kind == _COMPRESSED:
            kind, content = next(_elements(zlib.decompress(content), order))
        if kind != _MATRIX:
            continue
        parts = list(_elements(content, order))
        if len(parts) < 4 or parts[3][0] not in _KINDS:
            continue
        shape = np.frombuffer(parts[1][1], dtype=order + "i4")
        values = np.frombuffer(parts[3][1], dtype=order + _KINDS[parts[3][0]])
        if values.size == shape.prod():
            out[parts[2][1].decode("ascii", "replace")] = values.astype(np.float64).reshape(shape, order="F")
    return out


ANNOTATION = "path string, pose array<double>, points array<array<double>>, error string"


def read_pose_mat(spark: SparkSession, path: str) -> DataFrame:
    """(path, pose, points, error) of annotation files: pose is pitch, yaw, roll (radians) and two shifts (the first five of
    Pose_Para), points the rows of pt2d; null where a file lacks them, with an error where it can't be read."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = [pa.string(), pa.list_(pa.float64()), pa.list_(pa.list_(pa.float64())), pa.string()]
        for batch in batches:
            for name, content in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                pose = points = error = None
                try:
                    found = arrays(content)
                    pose = found["Pose_Para"][0][:5].tolist() if "Pose_Para" in found else None
                    points = found["pt2d"].tolist() if "pt2d" in found else None
                except (ValueError, struct.error, zlib.error, StopIteration) as e:
                    error = str(e) or type(e).__name__
                yield pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip((name, pose, points, error), kinds, strict=True)], names=["path", "pose", "points", "error"])

    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path)
    return files.select("path", "content").mapInArrow(run, ANNOTATION)


def pose_degrees(annotations: DataFrame) -> DataFrame:
    """(path, yaw, pitch, roll) in degrees."""
    return annotations.select("path", *[F.degrees(F.col("pose")[i]).alias(n) for n, i in (("yaw", 1), ("pitch", 0), ("roll", 2))])
