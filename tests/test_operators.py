"""Hand-computed cases at the boundaries of the operators."""

import json
import math
import os
import random

import pytest
from pyspark.sql import Row
from pyspark.sql import functions as F

from lumiframe.config import EngineConfig
from lumiframe.functions import geometry as G
from lumiframe.functions import scalar as S
from lumiframe.operators import artifacts, cache, detect, motion, scoring
from lumiframe.sources import readers


def one(spark, col):
    return spark.range(1).select(col.alias("x")).first()["x"]


def lits(*v):
    return F.array(*[F.lit(float(x)) for x in v])


@pytest.mark.parametrize(("text", "want"), [("640X480", (640, 480)), ("0x5", None), ("7681x1", None), ("1x2x3", None), ("5", None), ("axb", None), (None, None), ("7680x4320", (7680, 4320))])
def test_resolution(spark, text, want):
    got = one(spark, S.parse_resolution(F.lit(text).cast("string")))
    assert (tuple(got) if got else None) == want


def test_fps(spark):
    probe = lambda s: F.lit(json.dumps({"streams": s}))
    assert one(spark, S.stream_fps(probe([{"codec_type": "video", "r_frame_rate": "30000/1001"}]))) == pytest.approx(29.97002997)
    assert one(spark, S.stream_fps(probe([{"codec_type": "audio"}]))) == 25.0
    assert one(spark, S.stream_fps(probe([{"codec_type": "video"}]))) == 25.0
    assert [one(spark, S.usable_fps(F.lit(float(x)))) for x in (0, 120, 121, -1)] == [0, 120, 0, 0]
    assert one(spark, S.container_duration(F.lit('{"format":{"duration":"12.5"}}'))) == 12.5


def test_sample_step(spark):
    assert one(spark, S.sample_step(F.lit(0.2))) == 1
    assert one(spark, S.sample_step(F.lit(29.97))) == 89
    assert one(spark, S.window_size(F.lit(0.2))) == 0


@pytest.mark.parametrize(
    ("w", "h", "conf", "want"),
    [(30, 200, 1.0, 0.0), (200, 30, 1.0, 0.0), (64, 200, 1.0, 0.0), (65, 65, 0.99, 1.0), (65, 65, 0.97, 0.5), (65, 65, 0.9699, 0.0)],
)
def test_basic_score(spark, w, h, conf, want):
    lit = lambda x: F.lit(float(x))
    assert one(spark, G.basic_score(lit(w), lit(h), lit(640), lit(640), lit(conf))) == want


@pytest.mark.parametrize(
    ("marks", "want"),
    [
        ((0, 0, 4, 0, 2, 2, 0, 4, 4, 4), 1.0),
        ((0, 0, 4, 0, 9, 9, 0, 4, 4, 4), 0.5),
        ((0, 0, 4, 0, 2, 0, 0, 4, 4, 4), 0.5),
        ((0, 0, 4, 0, 0, 2, 0, 4, 4, 4), 0.5),
        ((0, 0, 4, 4, 2, 2, 0, 4, 4, 0), 0.0),
        ((0, 0, 4, 0, 2, 2, 0, 4), 0.0),
    ],
)
def test_geometry_score(spark, marks, want):
    assert spark.createDataFrame([Row(l=[float(x) for x in marks])]).select(G.geometry_score(F.col("l")).alias("x")).first()["x"] == want


@pytest.mark.parametrize(("angle", "want"), [(-100, -1), (-99, 0), (99, 66), (150, 66), (0, 33)])
def test_pose_bin(spark, angle, want):
    assert one(spark, G.pose_bin(F.lit(float(angle)))) == want


def test_pose(spark):
    assert one(spark, G.pose_angle(lits(*[0.0] * 66))) == pytest.approx(32.5 * 3 - 99)
    assert one(spark, G.pose_deviation(F.lit(90.0), F.lit(90.0), F.lit(0.0))) == 90


def test_motion_score(spark):
    rows = [Row(k=1, w=0.0, h=0.0, mx=0.3, my=0.4, ms=1.0), Row(k=2, w=8.0, h=8.0, mx=float("nan"), my=0.0, ms=1.0)]
    got = {r["k"]: r["score"] for r in motion.motion_score(spark.createDataFrame(rows), ["k"]).collect()}
    assert got[1] == pytest.approx(0.25)
    assert got[2] == 1.0


def frames(spark, values, video=1):
    return spark.createDataFrame([Row(video_id=video, frame_idx=i, mag=float(v)) for i, v in enumerate(values)])


def test_window_pick(spark):
    got = motion.window_best_frames(frames(spark, [0.2, 0.2, 0.2, 0.9]), window=2).collect()
    assert [(r["win"], r["frame_idx"]) for r in got] == [(0, 0), (1, 2)]
    assert motion.window_best_frames(frames(spark, [0.3, 0.3]), window=2).count() == 0
    assert motion.window_best_frames(frames(spark, [0.1]), window=0).count() == 0
    assert motion.relaxed_best_frames(frames(spark, [1.0, 1.0])).count() == 0
    assert motion.relaxed_best_frames(frames(spark, [0.5, 0.5])).first()["threshold"] == 0.6


def test_average_stays_within_values(spark):
    values = [0.1, 0.9, 0.4, 0.0, 1.0]
    got = [r["ema"] for r in motion.running_average(frames(spark, values)).orderBy("frame_idx").collect()]
    want = [values[0]]
    for v in values[1:]:
        want.append(0.4 * v + (1 - 0.4) * want[-1])
    assert got == want and min(values) <= min(got) and max(got) <= max(values)


def test_motion_across_batches(spark):
    rng = random.Random(5)
    rows = [(v, i, rng.random()) for v in (1, 2, None, 9) for i in range(rng.randrange(30, 60))] + [(1, 500, None)]
    rng.shuffle(rows)
    df = spark.createDataFrame(rows, "video_id int, frame_idx int, mag double")
    want, picks = {}, {}
    for v in (1, 2, None, 9):
        ema = None
        for _, i, x in sorted((r for r in rows if r[0] == v and r[2] is not None), key=lambda r: r[1]):
            ema = x if ema is None else 0.4 * x + (1 - 0.4) * ema
            want[v, i] = ema
            picks[v, i // 7] = min(picks.get((v, i // 7), (2, 0)), (ema, i))
    old = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    try:
        for size in (old, "5"):
            spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", size)
            assert {(r["video_id"], r["frame_idx"]): r["ema"] for r in motion.running_average(df).collect()} == want
            assert {(r["video_id"], r["win"]): (r["ema"], r["frame_idx"]) for r in motion.window_averages(df, window=7).collect()} == picks
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", old)


def test_early_exit(spark):
    rows = spark.createDataFrame([Row(video_id=1, frame_idx=i, score=s) for i, s in enumerate([0.5, 1.0, 1.5, 2.0])])
    assert scoring.early_exit(rows).count() == 3
    assert scoring.early_exit(rows, EngineConfig(search_all=True)).count() == 4


def test_frames_without_faces(spark):
    det = spark.createDataFrame([Row(video_id=1, frame_idx=0, confidence=0.5, bbox=[0.0, 0.0, 10.0, 10.0], landmarks=[0.0, 0.0, 4.0, 0.0, 2.0, 2.0, 0.0, 4.0, 4.0, 4.0], width=640.0, height=640.0)])
    all_frames = spark.createDataFrame([Row(video_id=1, frame_idx=i) for i in range(2)])
    got = {r["frame_idx"]: r["score"] for r in scoring.frame_scores(det, all_frames).collect()}
    assert got == {0: 1.0, 1: 0.0}
    best = scoring.best_frame(spark.createDataFrame([Row(video_id=1), Row(video_id=2)]), scoring.valid_frames(scoring.frame_scores(det)))
    assert {r["video_id"]: r["frame_idx"] for r in best.collect()} == {1: 0, 2: 0}


def test_nms(spark):
    box = lambda i, x1, x2, s: Row(g=1, vec_id=i, x1=float(x1), y1=0.0, x2=float(x2), y2=9.0, score=s)
    # boxes of 14 and 14 columns sharing 8: 8 / 20 is exactly the limit and stays
    rows = spark.createDataFrame([box(1, 0, 13, 0.99), box(2, 6, 19, 0.98), box(3, 1, 14, 0.97), box(4, 100, 110, 0.9)])
    kept = detect.greedy_nms(detect.gate_top_k(rows, ["g"]), ["g"])
    assert sorted(r["vec_id"] for r in kept.collect()) == [1, 2]


def test_nms_of_large_groups(spark):
    rng = random.Random(3)
    rows = []
    for g, n in ((1, 900), (2, 40), (None, 300)):
        for i in range(n):
            x, y, w, h = rng.uniform(0, 400 if i % 3 else 5), rng.uniform(0, 400), rng.uniform(20, 90), rng.uniform(20, 90)
            rows.append((g, i, x, y, x + w, y + h, round(rng.uniform(0.8, 1), 2)))
    df = spark.createDataFrame([*rows, (1, 5000, None, 0.0, 1.0, 1.0, 0.99)], "g int, vec_id bigint, x1 double, y1 double, x2 double, y2 double, score double")
    for keep in (750, 9):
        want = set()
        for g in (1, 2, None):
            kept = []
            for r in sorted((r for r in rows if r[0] == g and r[6] > 0.9), key=lambda r: (-r[6], r[1])):
                area = lambda b: (b[4] - b[2] + 1) * (b[5] - b[3] + 1)
                both = lambda a, b: max(0, min(a[4], b[4]) - max(a[2], b[2]) + 1) * max(0, min(a[5], b[5]) - max(a[3], b[3]) + 1)
                if len(kept) < keep and all(both(r, k) / (area(r) + area(k) - both(r, k)) <= 0.4 for k in kept):
                    kept.append(r)
            want |= {(g, r[1], i + 1) for i, r in enumerate(kept)}
        config = EngineConfig(nms_top_k=30, nms_keep=keep)
        got = detect.greedy_nms(detect.gate(df, config=config), ["g"], config=config).collect()
        assert {tuple(r) for r in got} == want and len(got) == len(want)
    assert detect.greedy_nms(df.limit(0), ["g"]).collect() == []


def test_well_formed(spark):
    raw = spark.createDataFrame([Row(frame_idx=0, dets=[[1.0, 2.0, 3.0, 4.0, 0.9], [1.0], [5.0, 6.0, 7.0, 8.0, 0.8]], landmarks=[[0.0] * 10, [0.0] * 10])])
    assert [(r["face_id"], r["confidence"]) for r in detect.well_formed(raw).collect()] == [(1, 0.9)]


def test_quality_is_strict(spark):
    flat = spark.createDataFrame([Row(gray=[25.5] * 64), Row(gray=[255.0, 0.0] * 32)])
    assert [r["x"] for r in flat.select(detect.quality_ok(F.col("gray")).alias("x")).collect()] == [False, False]


def test_touching_intervals_merge(spark):
    rows = spark.createDataFrame([Row(video_id=1, frame_idx=i, t=t, s=s, e=e) for i, t, s, e in ((0, 0.5, 0.0, 1.0), (1, 1.5, 1.0, 2.0), (2, 5.0, 4.0, 6.0))])
    got = artifacts.merge_intervals(rows).orderBy("start_time").collect()
    assert [(r["start_time"], r["end_time"], r["key_frame_idx"]) for r in got] == [(0.0, 2.0, 0), (4.0, 6.0, 2)]


def test_animation(spark):
    start = lambda f, fps: spark.createDataFrame([Row(video_id=1, frame_idx=f, fps=float(fps), total_frames=100)])
    assert artifacts.animation_plan(start(98, 4)).count() == 2
    assert artifacts.animation_plan(start(0, 121)).count() == 0
    assert artifacts.animation_plan(start(100, 4)).count() == 0


def test_segment_offsets(spark):
    rows = [Row(video_id=1, segment=s, segment_sec=10.0, fps=2.0, success=s != 1, score=1.0, frame_idx=3) for s in range(3)]
    df = spark.createDataFrame(rows)
    assert artifacts.merge_segment_results(df).first()["frames"] == [3, 43]
    assert artifacts.merge_segment_results(df, by_success=True).first()["frames"] == [3, 23]
    assert tuple(artifacts.segment_counts(df).first())[1:] == (2, 1)


def test_keyframes(spark):
    few = spark.createDataFrame([Row(video_id=1, frame_idx=i, t=i / 30, score=1.0) for i in range(30)])
    assert artifacts.keyframes(few).count() == 30
    many = spark.createDataFrame([Row(video_id=1, frame_idx=i, t=i / 100, score=1.0) for i in range(100)])
    assert artifacts.keyframes(many).count() == 30


def test_cache(spark):
    row = lambda s, p, at: Row(signature=s, file_path=p, valid_frames={"1.0": [1, 2]}, cached_at=float(at))
    old, new = spark.createDataFrame([row("a", "x", 1), row("b", "y", 1)]), spark.createDataFrame([row("a", "x", 2), row("c", "x", 3)])
    merged = cache.upsert(old, new)
    assert {(r["signature"], r["cached_at"]) for r in merged.collect()} == {("a", 2.0), ("b", 1.0), ("c", 3.0)}
    assert {r["signature"] for r in cache.purge_stale(merged).collect()} == {"b", "c"}
    assert cache.remove(merged, new.select("signature")).count() == 1
    empty = spark.createDataFrame([Row(signature="z", file_path="z", valid_frames={}, cached_at=1.0)], "signature string, file_path string, valid_frames map<string,array<bigint>>, cached_at double")
    assert cache.lookup(spark.createDataFrame([Row(signature="z")]), empty).first()["hit"]


def test_sources(spark, tmp_path):
    (tmp_path / "v").mkdir()
    for n in ("a.MP4", "b.txt", "c.mkv"):
        (tmp_path / "v" / n).write_bytes(b"x")
    assert sorted(os.path.basename(r["path"]) for r in readers.list_videos(spark, str(tmp_path)).collect()) == ["a.MP4", "c.mkv"]
    (tmp_path / "log").write_text(" a \n\nb\na\n")
    assert sorted(r["path"] for r in readers.read_processed_log(spark, str(tmp_path / "log")).collect()) == ["a", "b"]
    (tmp_path / "cache.json").write_text(json.dumps({"cache": {"s": {"file_path": "p", "valid_frames": {"1.5": [3]}, "cached_at": 2.5}}}))
    assert readers.read_cache_file(spark, str(tmp_path / "cache.json")).first()["valid_frames"] == {"1.5": [3]}
    (tmp_path / "pose").write_text(f"n {math.pi / 2} 0 0.5\n")
    got = readers.read_pose_text(spark, str(tmp_path / "pose"), radians=True).first()
    assert got["yaw"] == pytest.approx(90) and got["roll"] < 0
    with pytest.raises(ValueError):
        readers.scan("other")
    with pytest.raises(IndexError):
        readers.frame_at(frames(spark, [1.0]), 5, 5)


def test_stream_equals_batch(spark, tmp_path):
    from lumiframe.streaming.motion_stream import streaming_windows

    values = [((i * 37) % 11) / 11 for i in range(30)]
    rows = [(v, i, values[(i + v) % 30]) for v in (1, 2) for i in range(30)]
    schema = "video_id bigint, frame_idx bigint, mag double"
    for part in range(3):
        now = [r for r in rows if r[1] // 10 == part] + ([(v, 30, None) for v in (1, 2)] if part == 2 else [])
        spark.createDataFrame(now, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    q = streaming_windows(stream, window=12).writeStream.format("memory").queryName("windows").outputMode("append").trigger(availableNow=True).option("checkpointLocation", str(tmp_path / "c")).start()
    q.awaitTermination()
    got = sorted(tuple(r) for r in spark.sql("select * from windows").collect())
    want = sorted(tuple(r) for r in motion.window_averages(spark.createDataFrame(rows, schema), window=12).collect())
    assert got == want


def test_small_functions(spark):
    assert one(spark, G.landmark_box(lits(1, 2, 5, 0, 3, 9))) == [1, 0, 5, 9]
    assert one(spark, G.softmax(lits(0, 0), 2.0)) == [0.5, 0.5]
    assert one(spark, G.squared_error(lits(1, 2), lits(3, 2))) == 4
    assert one(spark, G.overlay_label(F.lit(0.5), F.lit(1.5))) == "conf 0.500 score 1.5"
    row = spark.createDataFrame([Row(c=[float(x) for x in (5, 0, 1, 0)])]).select(*[x.alias(f"c{i}") for i, x in enumerate(G.expand_box(F.col("c"), F.lit(640.0), F.lit(640.0)))]).first()
    assert tuple(row) == (0, 0, 51, 30)


def test_hooks(spark):
    from lumiframe.operators import hooks

    rows = spark.createDataFrame([Row(video_id=1, frame_idx=0, pixels=bytearray(b"ab"), width=1, height=2)])
    faces = hooks.detect_faces(rows, lambda: lambda p, w, h: [{"confidence": 0.9, "bbox": [1.0, 2.0, 3.0, 4.0], "landmarks": [0.0] * 10}, {"confidence": 0.1, "bbox": [1.0]}])
    assert [(r["face_id"], r["confidence"]) for r in faces.collect()] == [(1, 0.9)]
    out = hooks.encode(rows.unionByName(rows.withColumn("width", F.lit(0).cast("bigint"))), lambda: lambda p, w, h: bytes(p) * (1 // w))
    assert sorted((r["data"] is None, bytes(r["data"] or b"")) for r in out.collect()) == [(False, b"ab"), (True, b"")]
    results = spark.createDataFrame([("a", True, "o", None), ("b", False, None, "bad")], "path string, success boolean, output_path string, error string")
    assert {r["path"]: (r["body"], r["code"]) for r in hooks.responses(results).collect()} == {"a": ('{"success":true,"output_path":"o"}', 200), "b": ('{"success":false,"error":"bad"}', 500)}
