"""Named queries over the driver tables, and their SQL for DuckDB.

Aggregated floating-point values are rounded to 6 places on both sides: sums of doubles depend on the order."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lumiframe.config import DEFAULT
from lumiframe.functions import geometry as G
from lumiframe.functions import scalar as S
from lumiframe.functions.scalar import lit
from lumiframe.operators import artifacts, cache, detect, motion, scoring
from lumiframe.sources import fixtures as X
from lumiframe.sources.readers import frame_at, scan, table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None):
    def add(f: Callable[[SparkSession, str], DataFrame]):
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLES[f.__name__] = sql
        return f

    return add


def r6(c: Column) -> Column:
    return F.round(c, 6)


# ---- motion scan

_EMA = f"""WITH RECURSIVE {X.FRAMES_SQL}, f AS MATERIALIZED (SELECT video_id, frame_idx, mag, mag_tiered FROM frames),
ema AS (SELECT video_id, frame_idx, MAG AS ema FROM f WHERE frame_idx = 0
  UNION ALL SELECT f.video_id, f.frame_idx, 0.4e0 * f.MAG + (1 - 0.4e0) * e.ema FROM ema e JOIN f ON f.video_id = e.video_id AND f.frame_idx = e.frame_idx + 1)"""
_BEST = _EMA + """, best AS (SELECT video_id, frame_idx // 12 AS win, frame_idx, ema FROM ema
  QUALIFY row_number() OVER (PARTITION BY video_id, frame_idx // 12 ORDER BY ema, frame_idx) = 1)"""


@query(_EMA.replace("MAG", "mag") + " SELECT video_id, frame_idx, ema FROM ema")
def motion_ema(spark, d):
    return motion.running_average(X.frames(spark, d))


@query(_BEST.replace("MAG", "mag") + " SELECT video_id, win, frame_idx, ema FROM best WHERE ema < 0.3e0")
def window_best_frame(spark, d):
    return motion.window_best_frames(X.frames(spark, d))


@query(
    _BEST.replace("MAG", "mag_tiered")
    + """, t AS (SELECT video_id, CASE WHEN min(ema) < 0.3e0 THEN 0.3e0 WHEN min(ema) < 0.6e0 THEN 0.6e0 WHEN min(ema) < 1e0 THEN 1e0 END AS threshold FROM best GROUP BY 1)
SELECT b.video_id, b.win, b.frame_idx, b.ema, t.threshold FROM best b JOIN t USING (video_id) WHERE b.ema < t.threshold"""
)
def adaptive_threshold(spark, d):
    return motion.relaxed_best_frames(X.frames(spark, d), "mag_tiered")


@query(
    f"""WITH {X.MOTION_SQL}, m AS (SELECT frame_idx, sqrt((mx/ms)*(mx/ms) + (my/ms)*(my/ms)) / sqrt(CASE WHEN w*h > 0 THEN w*h ELSE 1 END) AS m FROM mv)
SELECT frame_idx, round(greatest(0e0, least(1e0, (median(m) + stddev_pop(m)) / 2)), 6) AS score FROM m GROUP BY 1"""
)
def motion_statistics(spark, d):
    return motion.motion_score(X.motion_vectors(spark, d), ["frame_idx"]).withColumn("score", r6(F.col("score")))


@query(f"WITH {X.FRAMES_SQL}, {X.VIDEOS_SQL} SELECT f.video_id, f.frame_idx, f.event_id FROM frames f JOIN videos v USING (video_id) WHERE f.frame_idx % 12 = 0 AND f.frame_idx < v.total_frames")
def sample_every_n(spark, d):
    joined = X.frames(spark, d).join(X.videos(spark, d), "video_id")
    return scan("CV2")(joined, F.col("fps"), F.col("total_frames")).select("video_id", "frame_idx", "event_id")


@query(f"WITH {X.VIDEOS_SQL} SELECT video_id, total_frames, fps, total_frames / fps AS duration FROM videos")
def video_info(spark, d):
    return X.videos(spark, d).select("video_id", "total_frames", "fps", S.duration(F.col("total_frames"), F.col("fps")).alias("duration"))


@query(f"WITH {X.FRAMES_SQL} SELECT video_id, frame_idx, event_id FROM frames WHERE frame_idx = 7")
def frame_lookup(spark, d):
    return frame_at(X.frames(spark, d), 7).select("video_id", "frame_idx", "event_id")


# ---- frame quality

_Q = f"""WITH {X.GRAY_SQL}, s AS (SELECT vec_id, r, c, g * 100 / 255 AS b FROM gray), m AS (SELECT vec_id, avg(b) AS m FROM s GROUP BY 1),
q AS (SELECT s.vec_id, avg(s.b) AS brightness, stddev_samp(abs(s.b - m.m)) AS contrast FROM s JOIN m USING (vec_id) GROUP BY 1)"""


@query(_Q + " SELECT vec_id, round(brightness, 6) AS brightness, round(contrast, 6) AS contrast, brightness > 10 AND contrast > 5 AS passed FROM q")
def frame_quality(spark, d):
    g = X.gray(spark, d)
    return g.select("vec_id", r6(detect.brightness(F.col("gray"))).alias("brightness"), r6(detect.contrast(F.col("gray"))).alias("contrast"), detect.quality_ok(F.col("gray")).alias("passed"))


@query(
    f"""WITH {X.GRAY_SQL}, l AS (SELECT a.vec_id, 2*(n1.g + n2.g + n3.g + n4.g) - 8*a.g AS l FROM gray a
  JOIN gray n1 ON n1.vec_id=a.vec_id AND n1.r=a.r-1 AND n1.c=a.c-1 JOIN gray n2 ON n2.vec_id=a.vec_id AND n2.r=a.r-1 AND n2.c=a.c+1
  JOIN gray n3 ON n3.vec_id=a.vec_id AND n3.r=a.r+1 AND n3.c=a.c-1 JOIN gray n4 ON n4.vec_id=a.vec_id AND n4.r=a.r+1 AND n4.c=a.c+1)
SELECT vec_id, round(var_samp(l), 4) AS sharpness FROM l GROUP BY 1"""
)
def frame_sharpness(spark, d):
    return X.gray(spark, d).select("vec_id", F.round(detect.sharpness(F.col("gray"), 8, 8), 4).alias("sharpness"))


@query(_Q + " SELECT vec_id FROM q WHERE brightness > 10 AND contrast > 5")
def frame_filter_chain(spark, d):
    return X.gray(spark, d).filter(detect.frame_chain(F.col("gray"))).select("vec_id")


# ---- detector post-processing

_PRIORS = """WITH st AS (SELECT * FROM (VALUES (0, 8, 16, 32), (1, 16, 64, 128), (2, 32, 256, 512)) t(s, step, a, b)),
cells AS (SELECT s, step, a, b, i, j FROM st, generate_series(0, 79) gi(i), generate_series(0, 79) gj(j) WHERE i < ceil(640e0/step) AND j < ceil(640e0/step)),
two AS (SELECT s, step, i, j, 0 AS k, a AS side FROM cells UNION ALL SELECT s, step, i, j, 1, b FROM cells)"""


@query(_PRIORS + " SELECT row_number() OVER (ORDER BY s, i, j, k) - 1 AS prior_id, (j + 0.5e0) * step / 640 AS cx, (i + 0.5e0) * step / 640 AS cy, side / 640e0 AS w, side / 640e0 AS h FROM two")
def prior_boxes(spark, d):
    return detect.prior_boxes(spark, 640, 640)


def _with_prior(spark, d):
    """Each vector as the model output of the prior of id vec_id * 8, counted round the 16,800 priors."""
    v = X.vectors(spark, d).withColumn("prior_id", F.col("vec_id") * 8 % 16800)
    return v.join(detect.prior_boxes(spark, 640, 640), "prior_id").withColumn("prior", F.array("cx", "cy", "w", "h"))


_OUT = (
    _PRIORS.replace("WITH ", f"WITH {X.VECTORS_SQL}, ", 1)
    + """, pr AS (SELECT row_number() OVER (ORDER BY s, i, j, k) - 1 AS prior_id, (j + 0.5e0) * step / 640 AS cx, (i + 0.5e0) * step / 640 AS cy, side / 640e0 AS w, side / 640e0 AS h FROM two),
o AS (SELECT vec_id, e, cx, cy, w, h FROM vectors JOIN pr ON prior_id = vec_id * 8 % 16800)"""
)


@query(
    _OUT
    + """, b AS (SELECT vec_id, cx + e[1]*0.1e0*w AS bx, cy + e[2]*0.1e0*h AS by_, w*exp(e[3]*0.2e0) AS bw, h*exp(e[4]*0.2e0) AS bh FROM o)
SELECT vec_id, round((bx-bw/2)*640, 6) AS x1, round((by_-bh/2)*640, 6) AS y1, round((bx+bw/2)*640, 6) AS x2, round((by_+bh/2)*640, 6) AS y2 FROM b"""
)
def decode_boxes(spark, d):
    corners = G.decode_box(F.col("e"), F.col("prior"))
    return _with_prior(spark, d).select("vec_id", *[r6(c * 640).alias(n) for c, n in zip(corners, ("x1", "y1", "x2", "y2"), strict=True)])


@query(_OUT + ", u AS (SELECT vec_id, unnest(range(10)) AS i, e, cx, cy, w, h FROM o) SELECT vec_id, i, round(CASE WHEN i % 2 = 0 THEN cx + e[i+5]*0.1e0*w ELSE cy + e[i+5]*0.1e0*h END * 640, 6) AS v FROM u")
def decode_landmarks(spark, d):
    marks = G.decode_landmarks(F.slice("e", 5, 10), F.col("prior"))
    return _with_prior(spark, d).select("vec_id", F.posexplode(marks).alias("i", "v")).select("vec_id", F.col("i").cast("bigint").alias("i"), r6(F.col("v") * 640).alias("v"))


@query(f"WITH {X.NMS_SQL} SELECT label, vec_id, score, row_number() OVER (PARTITION BY label ORDER BY score DESC, vec_id) AS rank FROM boxes WHERE score > 0.9e0 QUALIFY rank <= 20")
def detector_gate_topk(spark, d):
    return detect.gate_top_k(X.nms_boxes(spark, d), ["label"], k=20).select("label", "vec_id", "score", F.col("rank").cast("bigint").alias("rank"))


@query(
    f"""WITH RECURSIVE {X.NMS_SQL}, g AS MATERIALIZED (SELECT label, vec_id, x1, y1, x2, y2, row_number() OVER (PARTITION BY label ORDER BY score DESC, vec_id) AS rk FROM boxes WHERE score > 0.9e0),
ov AS MATERIALIZED (SELECT a.label, a.rk AS ra, b.rk AS rb FROM g a JOIN g b ON a.label = b.label AND a.rk < b.rk
  WHERE greatest(0, least(a.x2,b.x2)-greatest(a.x1,b.x1)+1) * greatest(0, least(a.y2,b.y2)-greatest(a.y1,b.y1)+1) /
   ((a.x2-a.x1+1)*(a.y2-a.y1+1) + (b.x2-b.x1+1)*(b.y2-b.y1+1) - greatest(0, least(a.x2,b.x2)-greatest(a.x1,b.x1)+1) * greatest(0, least(a.y2,b.y2)-greatest(a.y1,b.y1)+1)) > 0.4e0),
ovl AS MATERIALIZED (SELECT label, rb AS rk, list(ra) AS over_ FROM ov GROUP BY 1, 2),
k AS (SELECT label, 0::BIGINT AS rk, []::BIGINT[] AS kept FROM (SELECT DISTINCT label FROM g)
  UNION ALL SELECT k.label, k.rk + 1, CASE WHEN o.over_ IS NULL OR NOT list_has_any(k.kept, o.over_) THEN list_append(k.kept, k.rk + 1) ELSE k.kept END
  FROM k JOIN g ON g.label = k.label AND g.rk = k.rk + 1 LEFT JOIN ovl o ON o.label = k.label AND o.rk = k.rk + 1),
l AS (SELECT label, arg_max(kept, rk) AS kept FROM k GROUP BY 1), u AS (SELECT label, unnest(kept) AS rk, generate_subscripts(kept, 1) AS kept_rank FROM l)
SELECT u.label, g.vec_id, CAST(u.kept_rank AS INTEGER) AS kept_rank FROM u JOIN g ON g.label = u.label AND g.rk = u.rk WHERE u.kept_rank <= 750"""
)
def greedy_nms(spark, d):
    return detect.greedy_nms(detect.gate(X.nms_boxes(spark, d)), ["label"])


# ---- scores

_GEO = X.DETECTIONS_SQL + """, tr AS (SELECT *, (bx-ax)*(cy-ay)-(by_-ay)*(cx-ax) AS abc, (bx-ax)*(dy-ay)-(by_-ay)*(dx-ax) AS abd, (dx-cx)*(ay-cy)-(dy-cy)*(ax-cx) AS cda, (dx-cx)*(by_-cy)-(dy-cy)*(bx-cx) AS cdb,
  (cx-bx)*(dy-by_)-(cy-by_)*(dx-bx) AS bcd, (cx-bx)*(ay-by_)-(cy-by_)*(ax-bx) AS bca, (ax-dx)*(by_-dy)-(ay-dy)*(bx-dx) AS dab, (ax-dx)*(cy-dy)-(ay-dy)*(cx-dx) AS dac FROM detections),
geo AS (SELECT *, NOT (sign(abc)*sign(abd) < 0 AND sign(cda)*sign(cdb) < 0) AND NOT (sign(bcd)*sign(bca) < 0 AND sign(dab)*sign(dac) < 0) AS quad_valid,
  (CASE WHEN (ay>ny)<>(by_>ny) AND nx < ax+(ny-ay)*(bx-ax)/(by_-ay) THEN 1 ELSE 0 END + CASE WHEN (by_>ny)<>(cy>ny) AND nx < bx+(ny-by_)*(cx-bx)/(cy-by_) THEN 1 ELSE 0 END
   + CASE WHEN (cy>ny)<>(dy>ny) AND nx < cx+(ny-cy)*(dx-cx)/(dy-cy) THEN 1 ELSE 0 END + CASE WHEN (dy>ny)<>(ay>ny) AND nx < dx+(ny-dy)*(ax-dx)/(ay-dy) THEN 1 ELSE 0 END) % 2 = 1 AS odd FROM tr),
sc AS (SELECT *, quad_valid AND odd AS nose_inside, CASE WHEN quad_valid AND odd THEN 1e0 WHEN quad_valid THEN 0.5e0 ELSE 0e0 END AS geometry,
  x2-x1 > 30 AND y2-y1 > 30 AS size_ok, (x2-x1)/640e0 > 0.1e0 AND (y2-y1)/640e0 > 0.1e0 AS ratio_ok FROM geo),
faces AS (SELECT *, CASE WHEN size_ok AND ratio_ok AND confidence >= 0.99e0 THEN 1e0 WHEN size_ok AND ratio_ok AND confidence >= 0.97e0 THEN 0.5e0 ELSE 0e0 END AS basic FROM sc),
fs AS (SELECT video_id, frame_idx, max(basic + geometry) AS score FROM faces GROUP BY 1, 2)"""


@query(f"WITH {_GEO} SELECT video_id, frame_idx, face_id, basic AS score FROM faces")
def face_score_basic(spark, d):
    return X.detections(spark, d).select("video_id", "frame_idx", "face_id", scoring.SCORERS["BasicFilter"](DEFAULT).alias("score"))


@query(f"WITH {_GEO} SELECT video_id, frame_idx, face_id, geometry AS score FROM faces")
def face_score_geometry(spark, d):
    return X.detections(spark, d).select("video_id", "frame_idx", "face_id", scoring.SCORERS["GeometryFilter"](DEFAULT).alias("score"))


@query(f"WITH {_GEO} SELECT video_id, frame_idx, score FROM fs")
def frame_score(spark, d):
    return scoring.frame_scores(X.detections(spark, d))


@query(f"WITH {_GEO} SELECT video_id, score, string_agg(frame_idx::VARCHAR, ',' ORDER BY frame_idx) AS frames FROM fs WHERE score >= 0.5e0 GROUP BY 1, 2")
def valid_frames_by_score(spark, d):
    grouped = scoring.frames_by_score(scoring.valid_frames(scoring.frame_scores(X.detections(spark, d))))
    return grouped.withColumn("frames", F.array_join(F.col("frames").cast("array<string>"), ","))


@query(
    f"""WITH {_GEO} SELECT video_id, count(*) AS total, count(*) FILTER (confidence >= 0.97e0) AS confidence_passed, count(*) FILTER (size_ok) AS size_passed, count(*) FILTER (ratio_ok) AS ratio_passed,
  count(*) FILTER (confidence >= 0.97e0 AND size_ok AND ratio_ok) AS basic_passed, count(*) FILTER (quad_valid) AS quad_valid, count(*) FILTER (nose_inside) AS nose_inside FROM faces GROUP BY 1"""
)
def filter_counters(spark, d):
    return scoring.filter_counters(X.detections(spark, d))


@query(f"WITH {X.DETECTIONS_SQL} SELECT vec_id, x2-x1 AS width, y2-y1 AS height, (x2-x1)*(y2-y1) AS area, (x1+x2)/2 AS center_x, (y1+y2)/2 AS center_y FROM detections")
def bbox_derivations(spark, d):
    return X.detections(spark, d).select("vec_id", *[c.alias(n) for n, c in G.box(F.col("bbox")).items()])


@query(f"WITH {X.DETECTIONS_SQL} SELECT vec_id, ax AS left_eye_x, ay AS left_eye_y, bx AS right_eye_x, by_ AS right_eye_y, nx AS nose_x, ny AS nose_y, dx AS left_mouth_x, dy AS left_mouth_y, cx AS right_mouth_x, cy AS right_mouth_y FROM detections")
def landmark_points(spark, d):
    p = G.landmark_points(F.col("landmarks"))
    return X.detections(spark, d).select("vec_id", *[p[n][a].alias(f"{n}_{a}") for n in G.POINTS for a in "xy"])


# Scored frames: the score falls as the motion rises.
_SCORED = f"{X.FRAMES_SQL}, scored AS (SELECT video_id, frame_idx, CASE WHEN mag < 0.005e0 THEN 2e0 WHEN mag < 0.01e0 THEN 1.5e0 WHEN mag < 0.3e0 THEN 1e0 WHEN mag < 0.7e0 THEN 0.5e0 ELSE 0e0 END AS score FROM frames)"


def _scored(spark, d):
    m = F.col("mag")
    score = F.when(m < 0.005, lit(2)).when(m < 0.01, lit(1.5)).when(m < 0.3, lit(1)).when(m < 0.7, lit(0.5)).otherwise(lit(0))
    return X.frames(spark, d).select("video_id", "frame_idx", score.alias("score"))


@query(f"WITH {_SCORED}, w AS (SELECT *, sum(CASE WHEN score >= 1.5e0 THEN 1 ELSE 0 END) OVER (PARTITION BY video_id ORDER BY frame_idx ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS seen FROM scored) SELECT video_id, frame_idx, score FROM w WHERE coalesce(seen, 0) = 0")
def early_exit_prefix(spark, d):
    return scoring.early_exit(_scored(spark, d))


_VALID = _SCORED + f", {X.VIDEOS_SQL}, best AS (SELECT v.video_id, coalesce(b.frame_idx, 0) AS frame_idx, b.score FROM videos v LEFT JOIN (SELECT * FROM scored WHERE score >= 1e0 QUALIFY row_number() OVER (PARTITION BY video_id ORDER BY score DESC, frame_idx) = 1) b USING (video_id))"


@query(f"WITH {_VALID} SELECT video_id, frame_idx, score FROM best")
def best_frame(spark, d):
    return scoring.best_frame(X.videos(spark, d), _scored(spark, d).filter("score >= 1"))


@query(
    f"""WITH {_VALID}, n AS (SELECT b.video_id, b.frame_idx, least(trunc(3e0 * v.fps)::BIGINT, v.total_frames - b.frame_idx) AS n, trunc(1000 / v.fps)::BIGINT AS delay_ms FROM best b JOIN videos v USING (video_id)),
p AS (SELECT video_id, unnest(generate_series(0, n - 1)) AS pos, frame_idx, delay_ms FROM n WHERE n > 0) SELECT video_id, pos, frame_idx + pos AS frame_idx, delay_ms FROM p"""
)
def animation_plan(spark, d):
    v = X.videos(spark, d)
    best = scoring.best_frame(v, _scored(spark, d).filter("score >= 1"))
    return artifacts.animation_plan(best.join(v, "video_id"))


@query(f"WITH {_VALID} SELECT s.video_id, s.frame_idx, s.frame_idx::DOUBLE / v.total_frames AS t, s.score FROM scored s JOIN videos v USING (video_id) WHERE s.score >= 0.5e0")
def keyframe_features(spark, d):
    return artifacts.keyframe_features(scoring.valid_frames(_scored(spark, d)), X.videos(spark, d))


@query(f"WITH {_VALID} SELECT DISTINCT video_id, frame_idx FROM (SELECT *, count(*) OVER (PARTITION BY video_id) AS n FROM scored WHERE score >= 1e0) WHERE n <= 30")
def keyframes_small(spark, d):
    valid = _scored(spark, d).filter("score >= 1")
    few = valid.withColumn("n", F.count("*").over(Window.partitionBy("video_id"))).filter("n <= 30").drop("n")
    return artifacts.keyframes(artifacts.keyframe_features(few, X.videos(spark, d)))


@query(None)
def keyframe_kmeans(spark, d):
    return artifacts.keyframes(artifacts.keyframe_features(scoring.valid_frames(_scored(spark, d)), X.videos(spark, d)))


@query(
    f"""WITH {_VALID}, k AS (SELECT s.video_id, s.frame_idx, s.frame_idx / v.fps AS t, v.duration FROM scored s JOIN videos v USING (video_id) WHERE s.score >= 1e0),
i AS (SELECT video_id, frame_idx, t, greatest(0e0, t - 0.5e0) AS s, least(duration, t + 0.5e0) AS e FROM k), j AS (SELECT video_id, frame_idx, t, CASE WHEN e - s > 1e0 THEN t - 0.5e0 ELSE s END AS s, CASE WHEN e - s > 1e0 THEN t + 0.5e0 ELSE e END AS e FROM i),
m AS (SELECT *, max(e) OVER (PARTITION BY video_id ORDER BY s, t, frame_idx ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM j),
g AS (SELECT *, sum(CASE WHEN reach IS NULL OR s > reach THEN 1 ELSE 0 END) OVER (PARTITION BY video_id ORDER BY s, t, frame_idx) AS grp FROM m)
SELECT video_id, min(s) AS start_time, max(e) AS end_time, arg_min(frame_idx, (s, t, frame_idx)) AS key_frame_idx, min(t) AS key_frame_time FROM g GROUP BY video_id, grp"""
)
def preview_segments(spark, d):
    return artifacts.preview_segments(_scored(spark, d).filter("score >= 1").join(X.videos(spark, d), "video_id"))


# Segment results: four segments of 20 frames; a video's segment v % 4 fails if v is divisible by 3.
_SEGMENTS = f"{_SCORED}, seg AS (SELECT video_id, least(frame_idx // 20, 3) AS segment, frame_idx - 20 * least(frame_idx // 20, 3) AS frame_idx, score, NOT (video_id % 3 = 0 AND least(frame_idx // 20, 3) = video_id % 4) AS success FROM scored WHERE score >= 0.5e0)"


def _segments(spark, d):
    seg = F.least(F.floor(F.col("frame_idx") / 20), F.lit(3))
    rows = scoring.valid_frames(_scored(spark, d)).withColumn("segment", seg)
    bad = (F.col("video_id") % 3 == 0) & (F.col("segment") == F.col("video_id") % 4)
    return rows.withColumns({"frame_idx": F.col("frame_idx") - 20 * F.col("segment"), "success": ~bad, "segment_sec": lit(5), "fps": lit(4)})


@query(f"WITH {_SEGMENTS} SELECT video_id, score, string_agg(DISTINCT f::VARCHAR, ',' ORDER BY f::VARCHAR) AS frames FROM (SELECT video_id, score, frame_idx + trunc(segment * 5e0 * 4e0)::BIGINT AS f FROM seg WHERE success) GROUP BY 1, 2")
def segment_merge(spark, d):
    out = artifacts.merge_segment_results(_segments(spark, d))
    return out.withColumn("frames", F.array_join(F.array_sort(F.col("frames").cast("array<string>")), ","))


@query(f"WITH {_SEGMENTS} SELECT video_id, count(*) FILTER (success) AS succeeded, count(*) FILTER (NOT success) AS failed FROM (SELECT DISTINCT video_id, segment, success FROM seg) GROUP BY 1")
def segment_counts(spark, d):
    return artifacts.segment_counts(_segments(spark, d))


# ---- poses and crops

_POSE = f"{X.VECTORS_SQL}, a AS (SELECT vec_id, e[1]*100 AS yaw, e[2]*100 AS pitch, e[3]*100 AS roll, e FROM vectors)"


def _poses(spark, d):
    e = F.col("e")
    return X.vectors(spark, d).select("vec_id", (e[0] * 100).alias("yaw"), (e[1] * 100).alias("pitch"), (e[2] * 100).alias("roll"), "e")


@query(f"WITH {X.VECTORS_SQL}, u AS (SELECT vec_id, unnest(e || [0e0, 0e0]) AS x, generate_subscripts(e || [0e0, 0e0], 1) - 1 AS i FROM vectors) SELECT vec_id, round(sum(exp(x) * i) / sum(exp(x)) * 3 - 99, 6) AS angle FROM u GROUP BY 1")
def pose_expectation(spark, d):
    return X.vectors(spark, d).select("vec_id", r6(G.pose_angle(F.concat("e", F.array(lit(0), lit(0))))).alias("angle"))


@query(f"WITH {_POSE} SELECT vec_id, round(least(sqrt(yaw*yaw + pitch*pitch + roll*roll), 90e0), 6) AS deviation FROM a")
def pose_deviation(spark, d):
    return _poses(spark, d).select("vec_id", r6(G.pose_deviation(F.col("yaw"), F.col("pitch"), F.col("roll"))).alias("deviation"))


@query(f"WITH {_POSE} SELECT vec_id, CAST(greatest(-1, least(66, floor((yaw*5 + 99) / 3))) AS INTEGER) AS bin FROM a")
def pose_bins(spark, d):
    return _poses(spark, d).select("vec_id", G.pose_bin(F.col("yaw") * 5).alias("bin"))


@query(f"WITH {X.VECTORS_SQL} SELECT vec_id, round(-atan2(e[2], e[1])*180/pi(), 6) AS roll, round(-atan2(-e[3], sqrt(e[6]*e[6]+e[9]*e[9]))*180/pi(), 6) AS yaw, round(atan2(e[6], e[9])*180/pi(), 6) AS pitch FROM vectors")
def euler_from_matrix(spark, d):
    e = F.col("e")
    roll, pitch, yaw = G.euler_from_matrix([[e[3 * i + j] for j in range(3)] for i in range(3)])
    return X.vectors(spark, d).select("vec_id", r6(roll).alias("roll"), r6(yaw).alias("yaw"), r6(pitch).alias("pitch"))


@query(f"WITH {_POSE}, r AS (SELECT vec_id, -yaw*pi()/180 AS y, pitch*pi()/180 AS p, roll*pi()/180 AS r FROM a) SELECT vec_id, round(100*cos(y)*cos(r), 6) AS x1, round(100*(cos(p)*sin(r)+cos(r)*sin(p)*sin(y)), 6) AS y1, round(-100*cos(y)*sin(r), 6) AS x2, round(100*(cos(p)*cos(r)-sin(p)*sin(y)*sin(r)), 6) AS y2, round(100*sin(y), 6) AS x3, round(-100*cos(y)*sin(p), 6) AS y3 FROM r")
def pose_axes(spark, d):
    ends = G.axis_ends(F.col("yaw"), F.col("pitch"), F.col("roll"))
    return _poses(spark, d).select("vec_id", *[r6(c).alias(n) for c, n in zip(ends, ("x1", "y1", "x2", "y2", "x3", "y3"), strict=True)])


@query(f"WITH {X.DETECTIONS_SQL} SELECT vec_id, greatest(x1-50, 0e0) AS x1, greatest(y1-50, 0e0) AS y1, least(x2+50, 640e0) AS x2, least(y2+30, 640e0) AS y2 FROM detections")
def bbox_expand(spark, d):
    out = G.expand_box(F.col("bbox"), F.col("width"), F.col("height"))
    return X.detections(spark, d).select("vec_id", *[c.alias(n) for c, n in zip(out, ("x1", "y1", "x2", "y2"), strict=True)])


@query(
    f"""WITH {X.DETECTIONS_SQL}, a AS (SELECT vec_id, x1 - 0.6e0*0.35e0*abs(x2-x1) AS a, y1 - 1e0*0.35e0*abs(y2-y1) AS b, x2, y2 FROM detections)
SELECT vec_id, round(a, 6) AS x1, round(b, 6) AS y1, round(x2 + 0.6e0*0.35e0*abs(x2-a), 6) AS x2, round(y2 + 0.6e0*0.35e0*abs(y2-b), 6) AS y2 FROM a"""
)
def loose_crop(spark, d):
    b = F.col("bbox")
    out = G.loose_crop(b[0], b[1], b[2], b[3], lit(0.35), top=1.0)
    return X.detections(spark, d).select("vec_id", *[r6(c).alias(n) for c, n in zip(out, ("x1", "y1", "x2", "y2"), strict=True)])


_SIZES = "s AS (SELECT p_partkey, 320 + p_size * 20 AS w, 480 + (p_partkey % 50) * 10 AS h, CASE p_partkey % 3 WHEN 0 THEN 16e0/9e0 WHEN 1 THEN 4e0/3e0 ELSE 1e0 END AS r FROM part)"


def _sizes(spark, d):
    k = F.col("p_partkey") % 3
    ratio = F.when(k == 0, lit(16) / lit(9)).when(k == 1, lit(4) / lit(3)).otherwise(lit(1))
    return table(spark, d, "part").select("p_partkey", (320 + F.col("p_size") * 20).cast("bigint").alias("w"), (480 + (F.col("p_partkey") % 50) * 10).cast("bigint").alias("h"), ratio.alias("r"))


@query(
    f"""WITH {_SIZES}, c AS (SELECT *, w::DOUBLE/h AS now, trunc(h*r)::BIGINT AS nw, trunc(w/r)::BIGINT AS nh FROM s)
SELECT p_partkey, CASE WHEN abs(now-r) < 0.001e0 OR now <= r THEN 0 ELSE (w-nw)//2 END AS x_off, CASE WHEN abs(now-r) < 0.001e0 OR now > r THEN 0 ELSE (h-nh)//2 END AS y_off,
 CASE WHEN abs(now-r) < 0.001e0 OR now <= r THEN w ELSE nw END AS cw, CASE WHEN abs(now-r) < 0.001e0 OR now > r THEN h ELSE nh END AS ch FROM c"""
)
def center_crop(spark, d):
    c = G.center_crop(F.col("w"), F.col("h"), F.col("r"))
    return _sizes(spark, d).withColumn("c", c).select("p_partkey", "c.x_off", "c.y_off", F.col("c.w").alias("cw"), F.col("c.h").alias("ch"))


@query(f"WITH {_SIZES} SELECT p_partkey, CASE WHEN w = 640 AND h = 480 THEN 'identity' WHEN 640*480 > w*h THEN 'cubic' ELSE 'area' END AS mode FROM s")
def resize_mode(spark, d):
    return _sizes(spark, d).select("p_partkey", G.resize_mode(F.col("w"), F.col("h"), F.lit(640), F.lit(480)).alias("mode"))


# ---- files, cache, logs, texts


@query(f"WITH {X.FILES_SQL} SELECT path FROM files WHERE regexp_matches(lower(path), '\\.(mp4|avi|mov|mkv|wmv|flv|webm)$') AND (doc_id IS NULL OR doc_id % 3 <> 0)")
def pending_files(spark, d):
    files = X.files(spark, d)
    return cache.pending(files, files.filter("doc_id % 3 = 0")).select("path")


_SIG = "f AS (SELECT doc_id, source || '/' || doc_id AS path, md5(source || '/' || doc_id || ':' || n_chars || ':' || doc_id || '.5') AS signature FROM documents)"


def _signed(spark, d):
    path = F.concat("source", F.lit("/"), F.col("doc_id").cast("string"))
    sig = S.file_signature(path, F.col("n_chars"), F.concat(F.col("doc_id").cast("string"), F.lit(".5")))
    return table(spark, d, "documents").select("doc_id", path.alias("path"), sig.alias("signature"))


def _cached(spark, d):
    """Entries for every other document, two for each fourth."""
    f = _signed(spark, d).filter("doc_id % 2 = 0")
    entry = lambda rows, at, n: rows.select("signature", F.col("path").alias("file_path"), F.create_map(F.lit("1.0"), F.array(F.col("doc_id") + n)).alias("valid_frames"), lit(at).alias("cached_at"))
    return entry(f, 1, 0).unionByName(entry(f.filter("doc_id % 4 = 0"), 2, 7))


@query(f"WITH {_SIG} SELECT doc_id, signature FROM f")
def file_signature(spark, d):
    return _signed(spark, d).select("doc_id", "signature")


@query(f"WITH {_SIG} SELECT doc_id, doc_id % 2 = 0 AS hit, CASE WHEN doc_id % 4 = 0 THEN doc_id + 7 WHEN doc_id % 2 = 0 THEN doc_id END AS first_frame FROM f")
def cache_lookup(spark, d):
    out = cache.lookup(_signed(spark, d), _cached(spark, d))
    return out.select("doc_id", "hit", F.col("cached_frames")["1.0"][0].alias("first_frame"))


@query(f"WITH {_SIG} SELECT signature, path AS file_path, CASE WHEN doc_id % 10 = 0 THEN 3e0 WHEN doc_id % 4 = 0 THEN 2e0 ELSE 1e0 END AS cached_at FROM f WHERE doc_id % 2 = 0 OR doc_id % 10 = 0")
def cache_upsert(spark, d):
    fresh = _signed(spark, d).filter("doc_id % 10 = 0").select("signature", F.col("path").alias("file_path"), F.create_map(F.lit("0.5"), F.array(F.col("doc_id"))).alias("valid_frames"), lit(3).alias("cached_at"))
    return cache.upsert(_cached(spark, d), fresh).select("signature", "file_path", "cached_at")


@query("""WITH c AS (SELECT doc_id AS n FROM documents WHERE doc_id % 2 = 0 UNION ALL SELECT doc_id + 7 FROM documents WHERE doc_id % 4 = 0)
SELECT count(*) AS entries, count(*) AS frames, CAST(coalesce(sum(length('{"1.0":[' || n || ']}')), 0) AS BIGINT) AS bytes FROM c""")
def cache_stats(spark, d):
    return cache.stats(_cached(spark, d)).select("entries", *[F.col(c).cast("bigint").alias(c) for c in ("frames", "bytes")])


@query(
    """SELECT o_orderstatus, CASE WHEN o_orderstatus <> 'F' THEN 'processed' ELSE 'failed' END AS status, count(*) AS n FROM orders GROUP BY 1, 2"""
)
def status_log(spark, d):
    rows = table(spark, d, "orders").select(F.col("o_orderkey").cast("string").alias("path"), (F.col("o_orderstatus") != "F").alias("success"), F.lit("no frames").alias("error"), "o_orderstatus")
    joined = cache.status_rows(rows).join(rows.select("path", "o_orderstatus"), "path")
    return joined.groupBy("o_orderstatus", "status").agg(F.count("*").alias("n"))


_RES = "r AS (SELECT p_partkey, CASE p_partkey % 6 WHEN 0 THEN (p_size*100)||'X'||p_size*50 WHEN 1 THEN p_size||'x0' WHEN 2 THEN (p_size*200)||'x'||p_size*100 WHEN 3 THEN '1x2x3' WHEN 4 THEN 'axb' ELSE ' '||p_size||' x '||p_size||' ' END AS txt FROM part)"


def _res(spark, d):
    n, k = F.col("p_size"), F.col("p_partkey") % 6
    s = lambda c: c.cast("string")
    text = (
        F.when(k == 0, F.concat(s(n * 100), F.lit("X"), s(n * 50))).when(k == 1, F.concat(s(n), F.lit("x0"))).when(k == 2, F.concat(s(n * 200), F.lit("x"), s(n * 100)))
        .when(k == 3, "1x2x3").when(k == 4, "axb").otherwise(F.concat(F.lit(" "), s(n), F.lit(" x "), s(n), F.lit(" ")))
    )
    return table(spark, d, "part").select("p_partkey", text.alias("txt"))


@query(
    f"""WITH {_RES}, p AS (SELECT p_partkey, string_split(lower(trim(txt)), 'x') AS a FROM r), q AS (SELECT p_partkey, len(a) AS n, try_cast(trim(a[1]) AS INTEGER) AS w, try_cast(trim(a[2]) AS INTEGER) AS h FROM p)
SELECT p_partkey, CASE WHEN n = 2 AND w BETWEEN 1 AND 7680 AND h BETWEEN 1 AND 4320 THEN w END AS width, CASE WHEN n = 2 AND w BETWEEN 1 AND 7680 AND h BETWEEN 1 AND 4320 THEN h END AS height FROM q"""
)
def parse_resolution(spark, d):
    return _res(spark, d).withColumn("r", S.parse_resolution(F.col("txt"))).select("p_partkey", "r.width", "r.height")


@query(
    """WITH a AS (SELECT p_partkey, CASE WHEN p_partkey % 3 = 0 THEN '-vf scale=' || p_size || ':' || p_size * 2 WHEN p_partkey % 3 = 1 THEN '-vf fps=5,scale=' || p_size || 'x' || p_size ELSE '-t 3' END AS args FROM part)
SELECT p_partkey, try_cast(regexp_extract(args, 'scale=(\\d+)[x:](\\d+)', 1) AS INTEGER) AS width, try_cast(regexp_extract(args, 'scale=(\\d+)[x:](\\d+)', 2) AS INTEGER) AS height FROM a"""
)
def parse_scale_arg(spark, d):
    n, k = F.col("p_size").cast("string"), F.col("p_partkey") % 3
    args = F.when(k == 0, F.concat(F.lit("-vf scale="), n, F.lit(":"), (F.col("p_size") * 2).cast("string"))).when(k == 1, F.concat(F.lit("-vf fps=5,scale="), n, F.lit("x"), n)).otherwise("-t 3")
    return table(spark, d, "part").withColumn("r", S.parse_scale(args)).select("p_partkey", "r.width", "r.height")


@query("SELECT page_id, '/out/' || regexp_replace(substr('/in/' || page_id || '/clip.' || (page_id % 7) || '.MP4', 5), '\\.[^./]*$', '') || '.webp' AS out_path FROM pages")
def output_path(spark, d):
    path = F.concat(F.lit("/in/"), F.col("page_id").cast("string"), F.lit("/clip."), (F.col("page_id") % 7).cast("string"), F.lit(".MP4"))
    return table(spark, d, "pages").select("page_id", S.output_path(path, F.lit("/in"), F.lit("/out"), "webp").alias("out_path"))


@query(
    """WITH n AS (SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events)
SELECT event_id, CASE WHEN k % 3 = 0 THEN 25e0 WHEN k % 3 = 1 THEN (k * 1000)::DOUBLE / 1001 ELSE 25e0 END AS fps FROM n"""
)
def fps_from_json(spark, d):
    k = F.get_json_object("props", "$.k").cast("bigint")
    rate = F.concat((k * 1000).cast("string"), F.lit("/1001"))
    video = F.concat(F.lit('{"streams":[{"codec_type":"audio","r_frame_rate":"0/0"},{"codec_type":"video","r_frame_rate":"'), rate, F.lit('"}]}'))
    probe = F.when(k % 3 == 0, '{"streams":[{"codec_type":"audio"}]}').when(k % 3 == 1, video).otherwise('{"streams":[{"codec_type":"video"}]}')
    return table(spark, d, "events").select("event_id", S.stream_fps(probe).alias("fps"))


@query("SELECT doc_id, coalesce(regexp_matches(lower(CASE doc_id % 4 WHEN 0 THEN 'CUDA error: Out of Memory' WHEN 1 THEN 'Runtime Error: device out of memory' WHEN 2 THEN 'allocation failed' ELSE text END), 'out of memory|allocation failed'), false) AS oom, coalesce(regexp_matches(lower(text), 'out of memory|allocation failed'), false) AS text_oom FROM documents")
def oom_classifier(spark, d):
    k = F.col("doc_id") % 4
    message = F.when(k == 0, "CUDA error: Out of Memory").when(k == 1, "Runtime Error: device out of memory").when(k == 2, "allocation failed").otherwise(F.col("text"))
    return table(spark, d, "documents").select("doc_id", S.is_out_of_memory(message).alias("oom"), S.is_out_of_memory(F.col("text")).alias("text_oom"))
