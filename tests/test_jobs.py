"""Files to results: decoders, annotation files, sinks, the batch and the request job."""

import json
import os
import struct
import sys
import zlib

import numpy as np
import pytest
from pyspark import cloudpickle
from pyspark.sql import Row
from pyspark.sql import functions as F

from lumiframe.functions import geometry as G
from lumiframe.functions import scalar as S
from lumiframe.jobs import batch, requests
from lumiframe.operators import artifacts, cache, hooks
from lumiframe.sources import mat, readers, video

cloudpickle.register_pickle_by_value(sys.modules[__name__])  # executors don't import tests


def y4m(path, grays, fps="1:1", colour="mono", size=(8, 4)):
    """A stream of flat frames with a checkered corner of contrast."""
    w, h = size
    with open(path, "wb") as out:
        out.write(f"YUV4MPEG2 W{w} H{h} F{fps} Ip C{colour}\n".encode())
        for g in grays:
            plane = np.full((h, w), g, dtype=np.uint8)
            plane[::2, ::2] = 255 - g
            out.write(b"FRAME\n" + plane.tobytes() + (b"\x80" * (2 * w * h) if colour == "444" else b""))


@pytest.fixture()
def folder(tmp_path):
    (tmp_path / "in" / "sub").mkdir(parents=True)
    y4m(tmp_path / "in" / "a.mp4", range(10, 90, 8))
    y4m(tmp_path / "in" / "sub" / "b.AVI", [200] * 7, colour="444")
    y4m(tmp_path / "in" / "flat.mov", [128] * 4)
    (tmp_path / "in" / "broken.mkv").write_bytes(b"nothing")
    (tmp_path / "in" / "c.txt").write_text("x")
    return tmp_path


def faces():
    """A detector factory: one good face in bright frames, none in others; counts as closed by a file."""

    def detect(pixels, width, height):
        first = pixels[3]
        if first < 30:
            return []
        marks = [1.0, 1.0, 5.0, 1.0, 3.0, 2.0, 1.0, 3.0, 5.0, 3.0]
        return [{"confidence": 0.5, "bbox": [0.0, 0.0, 6.0, 4.0], "landmarks": marks}, {"confidence": 0.9, "bbox": [0.0]}]

    return detect


def codec():
    return lambda pixels, w, h: b"IMG" + pixels[:3]


def paths(spark, folder):
    return spark.createDataFrame([(str(p),) for p in sorted((folder / "in").rglob("*")) if p.is_file()], "path string")


def test_decoder(spark, folder):
    a = spark.createDataFrame([(str(folder / "in" / "a.mp4"),), (str(folder / "none.mp4"),), (None,)], "path string")
    got = video.scan_frames(a).orderBy("frame_idx").collect()
    assert [r["frame_idx"] for r in got] == [0, 3, 6, 9] and len(got[0]["pixels"]) == 3 * 8 * 4
    assert list(got[1]["pixels"][:6]) == [221, 221, 221, 34, 34, 34]
    assert [r["frame_idx"] for r in video.scan_frames(a, only=4).collect()] == [4] and video.scan_frames(a, only=99).count() == 0
    with pytest.raises(ValueError):
        video.scan_frames(a, only=-1)
    info = {os.path.basename(r["path"]): r for r in video.video_infos(paths(spark, folder)).collect()}
    assert (info["a.mp4"]["total_frames"], info["a.mp4"]["fps"], info["a.mp4"]["width"], info["a.mp4"]["duration"]) == (10, 1.0, 8, 10.0)
    assert info["b.AVI"]["total_frames"] == 7 and info["b.AVI"]["error"] is None
    assert "Y4M" in info["broken.mkv"]["error"] and info["broken.mkv"]["total_frames"] is None
    assert "FileNotFound" in video.video_infos(a.filter("path like '%none%'")).first()["error"]
    with pytest.raises(ValueError):
        video.decoder("other")
    video.register_decoder("mine", "lumiframe.sources.video:read_y4m")
    assert video.decoder("MINE") is video.read_y4m


def test_frame_source(spark, folder):
    video.register(spark)
    got = spark.read.format("frames").option("path", str(folder / "in")).load().filter("path not like '%broken%'")
    os.remove(folder / "in" / "broken.mkv")
    assert sorted((os.path.basename(r["path"]), r["frame_idx"]) for r in got.collect()) == [("a.mp4", 0), ("a.mp4", 3), ("a.mp4", 6), ("a.mp4", 9), ("b.AVI", 0), ("b.AVI", 3), ("b.AVI", 6), ("flat.mov", 0), ("flat.mov", 3)]


def test_pixel_quality(spark):
    rng = np.random.default_rng(1)
    pixels = rng.integers(0, 256, 3 * 12, dtype=np.uint8)
    rows = spark.createDataFrame([(1, bytearray(pixels.tobytes()), 4, 3), (2, bytearray(b"abc"), 4, 3), (3, None, 4, 3)], "k int, pixels binary, width int, height int")
    got = {r["k"]: r for r in hooks.pixel_quality(rows).collect()}
    gray = np.floor(pixels.reshape(-1, 3) @ np.array([0.114, 0.587, 0.299]) + 0.5) * 100 / 255
    assert got[1]["brightness"] == pytest.approx(gray.mean()) and got[1]["contrast"] == pytest.approx(np.abs(gray - gray.mean()).std(ddof=1))
    assert got[2]["brightness"] is None and got[3]["contrast"] is None


def test_batch_runs_once(spark, folder):
    src, out = str(folder / "in"), str(folder / "out")
    done = {os.path.basename(r["path"]): r for r in batch.run(spark, src, out, faces, codec).collect()}
    assert set(done) == {"a.mp4", "b.AVI", "flat.mov", "broken.mkv"}
    assert done["a.mp4"]["valid_frames"] == {"1.0": [3, 6, 9]} and not done["broken.mkv"]["success"] and "Y4M" in done["broken.mkv"]["error"]
    assert done["flat.mov"]["valid_frames"] == {}  # no contrast
    logged = lambda log: sorted(x for r in spark.read.text(f"{out}/logs/log={log}").collect() for x in [r["value"]])
    assert [os.path.basename(x) for x in logged("processed")] == ["a.mp4", "flat.mov", "b.AVI"] and len(logged("error")) == 2
    assert (folder / "out" / "thumbnails" / "a.webp").read_bytes()[:3] == b"IMG" and (folder / "out" / "thumbnails" / "sub" / "b.webp").exists()
    assert cache.current(spark, f"{out}/cache").count() == 3
    # the second run has the failed file only; without it, nothing
    again = batch.run(spark, src, out, faces, codec).collect()
    assert [os.path.basename(r["path"]) for r in again] == ["broken.mkv"]
    os.remove(folder / "in" / "broken.mkv")
    assert batch.run(spark, src, out, faces, codec).collect() == []
    assert len(logged("processed")) == 3
    # a lost log: results come from the cache, so no detector is needed

    def none():
        raise RuntimeError("not called")

    import shutil

    shutil.rmtree(folder / "out" / "logs")
    back = {os.path.basename(r["path"]): r["valid_frames"] for r in batch.run(spark, src, out, none).collect()}
    assert back == {"a.mp4": {"1.0": [3, 6, 9]}, "b.AVI": done["b.AVI"]["valid_frames"], "flat.mov": {}}


def test_requests(spark, folder):
    (folder / "inbox").mkdir()
    a = str(folder / "in" / "a.mp4")
    rows = [{"input_path": a, "output_path": "/o/a.webp", "resolution": "64x48"}, {"input_path": a, "output_path": "/o/b.webp"}, {"input_path": a, "output_path": "/o", "resolution": "x"}, {"input_path": str(folder / "none"), "output_path": "/o"}, {"output_path": "/o"}]
    (folder / "inbox" / "1.json").write_text("\n".join(map(json.dumps, rows)))
    for _ in range(2):
        requests.serve(spark, str(folder / "inbox"), str(folder / "outbox"), str(folder / "check"), faces).awaitTermination()
    got = spark.read.json(f"{folder}/outbox").collect()
    assert sorted(r["code"] for r in got) == [200, 200, 500, 500, 500]
    bodies = [json.loads(r["body"]) for r in got]
    assert {b["output_path"] for b in bodies if b["success"]} == {"/o/a.webp", "/o/b.webp"}
    errors = sorted(b["error"] for b in bodies if not b["success"])
    assert errors[1:] == ["invalid resolution", "missing path"] and errors[0].startswith("FileNotFoundError")


def test_retry():
    calls = []

    def model(x):
        calls.append(x)
        if len(calls) < 3:
            raise RuntimeError("CUDA error: Out of Memory")
        return x

    cleared = []
    assert hooks.with_retry(model, 5, 0, lambda: cleared.append(1))(7) == 7 and len(calls) == 3 and len(cleared) == 2

    def other(x):
        raise KeyError(x)

    with pytest.raises(KeyError):
        hooks.with_retry(other, 5, 0)(1)
    calls.clear()
    with pytest.raises(RuntimeError):
        hooks.with_retry(model, 1, 0)(1)


def test_preview(spark):
    segments = spark.createDataFrame([Row(video_id=v, path=p, start_time=float(t), end_time=t + 1.0) for v, p, t in ((1, "a", 5), (1, "a", 2), (1, "bad", 3), (2, "bad", 1))])

    def cutter():
        def cut(path, a, b):
            if path == "bad":
                raise OSError("no")
            return f"{path}{a:.0f}-{b:.0f};".encode()

        return cut

    got = hooks.preview(segments, cutter, lambda: b"".join).collect()
    assert [(r["video_id"], bytes(r["data"])) for r in got] == [(1, b"a2-3;a5-6;")]
    assert hooks.preview(segments, cutter, lambda: b"".join, enabled=False).collect() == []


def mat_file(named, compress):
    def element(kind, data):
        return struct.pack("<II", kind, len(data)) + data + b"\0" * (-len(data) % 8)

    out = b"MATLAB 5.0".ljust(124) + b"\x00\x01IM"
    for name, values in named.items():
        values = np.asarray(values, dtype=np.float64)
        body = element(6, struct.pack("<II", 6, 0)) + element(5, struct.pack("<ii", *values.shape)) + element(1, name.encode()) + element(9, values.tobytes(order="F"))
        one = element(14, body)
        out += struct.pack("<II", 15, len(z := zlib.compress(one))) + z if compress else one
    return out


def test_annotations(spark, tmp_path):
    pose, points = [[0.1, -0.2, 0.3, 4, 5, 6, 7]], [[1.0, 2, 3], [4, 5, 6]]
    for i, compress in enumerate((False, True)):
        (tmp_path / f"{i}.mat").write_bytes(mat_file({"Pose_Para": pose, "pt2d": points}, compress))
    (tmp_path / "2.mat").write_bytes(b"short")
    (tmp_path / "3.mat").write_bytes(mat_file({"other": points}, False))
    got = {os.path.basename(r["path"]): r for r in mat.read_pose_mat(spark, str(tmp_path)).collect()}
    assert got["0.mat"]["pose"] == got["1.mat"]["pose"] == [0.1, -0.2, 0.3, 4, 5] and got["1.mat"]["points"] == points
    assert got["2.mat"]["error"] and got["3.mat"]["pose"] is None and got["3.mat"]["error"] is None
    angle = mat.pose_degrees(mat.read_pose_mat(spark, str(tmp_path / "0.mat"))).first()
    assert angle["yaw"] == pytest.approx(np.degrees(-0.2)) and angle["pitch"] == pytest.approx(np.degrees(0.1))
    (tmp_path / "p").mkdir()
    (tmp_path / "p" / "f1_pose.txt").write_text("1 0 0 \n0 1  0\n0 0 1\n\n1 2 3\n")
    (tmp_path / "p" / "f2_pose.txt").write_text("0 1 0\n-1 0 0\n0 0 1\n\n1 2 3\n")
    (tmp_path / "b").mkdir()
    (tmp_path / "b" / "dockerface-f1_rgb.txt").write_text("face 1 2 30 40\n")
    (tmp_path / "b" / "dockerface-f2_rgb.txt").write_text("none\n")
    got = {r["name"]: r for r in readers.read_rotations(spark, str(tmp_path / "p"), str(tmp_path / "b")).collect()}
    assert [abs(got["f1"][c]) for c in ("yaw", "pitch", "roll")] == [0, 0, 0] and got["f1"]["x_max"] == 30 and got["f2"]["x_max"] is None
    m = np.array([[0, 1, 0], [-1, 0, 0], [0, 0, 1]]).T
    assert got["f2"]["roll"] == pytest.approx(-np.degrees(np.arctan2(m[1][0], m[0][0])))
    (tmp_path / "m.json").write_text('{"models": {"r": {"a": "1", "b": 2}}}')
    assert {tuple(r) for r in readers.read_model_config(spark, str(tmp_path / "m.json")).collect()} == {("r", "a", "1"), ("r", "b", "2")}
    (tmp_path / "s.csv").write_text("﻿a/b.jpg,1,2,3,4,5,6,7\n")
    assert tuple(readers.read_pose_csv(spark, str(tmp_path / "s.csv")).first()) == ("a/b.jpg", 1, 2, 3, 4, 5, 6, 7)
    (tmp_path / "names").write_text("x\ny z\n")
    assert sorted(r["name"] for r in readers.read_names(spark, str(tmp_path / "names")).collect()) == ["x", "y z"]


def test_cache_versions(spark, tmp_path):
    row = lambda s, at: Row(signature=s, file_path=s, valid_frames={"1.0": [1]}, cached_at=float(at))
    path, at = str(tmp_path / "cache"), lambda: sorted((r["signature"], r["cached_at"]) for r in cache.current(spark, path).collect())
    assert cache.current(spark, path) is None
    cache.flush(spark.createDataFrame([row("a", 1)]), path)
    cache.flush(cache.upsert(cache.current(spark, path), spark.createDataFrame([row("b", 2)])), path)
    assert at() == [("a", 1.0), ("b", 2.0)]
    # a flush that broke off leaves no _SUCCESS and isn't read
    (tmp_path / "cache" / "v000000000003").mkdir()
    assert at() == [("a", 1.0), ("b", 2.0)]
    cache.flush(cache.clear(cache.current(spark, path)), path)
    assert at() == []
    assert len([p for p in (tmp_path / "cache").iterdir() if p.name.startswith("v")]) == 2
    fresh = spark.createDataFrame([row("a", 3), row("b", 2), row("c", 1)])
    assert {r["signature"] for r in cache.changed(fresh, spark.createDataFrame([row("a", 1), row("b", 2)])).collect()} == {"a", "c"}


def test_half_precision(spark):
    values = [0.0, 1.0, -1.0, 0.1, 1 / 3, 2047.0, 2049.0, 65504.0, 65520.0, 1e6, 6e-8, 1e-5, 5.96e-8, -2.0**-14, 0.99999, 1024.5]
    got = [r["x"] for r in spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, v double").select("i", S.half(F.col("v")).alias("x")).orderBy("i").collect()]
    assert got == [float(np.float16(v)) for v in values]


def test_split_and_scan_names(spark):
    rows = artifacts.split_plan(spark.createDataFrame([Row(video_id=1, duration=60.0), Row(video_id=2, duration=61.0)]), 3).collect()
    assert sorted((r["video_id"], r["segment"]) for r in rows) == [(1, 0), (2, 0), (2, 1), (2, 2)]
    assert artifacts.split_plan(spark.createDataFrame([Row(video_id=2, duration=61.0)]), 1).count() == 1
    readers.register_scan("Mine", lambda frames: frames.limit(1))
    assert readers.scan("mine")(spark.range(5)).count() == 1
    a = G.augmentation(F.col("id"))
    many = spark.range(4000).select(a.alias("a")).select("a.*")
    found = many.agg(F.avg(F.col("flip").cast("int")), F.avg(F.col("blur").cast("int")), F.collect_set("factor")).first()
    assert 0.45 < found[0] < 0.55 and 0.03 < found[1] < 0.07 and set(found[2]) == {1, 6, 11, 16}
