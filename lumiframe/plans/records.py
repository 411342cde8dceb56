"""Named queries over records: malformed detections, logs, caches, commands, annotations, training variants."""

from __future__ import annotations

from pyspark.sql import functions as F

from lumiframe.functions import commands as C
from lumiframe.functions import geometry as G
from lumiframe.functions import scalar as S
from lumiframe.functions.scalar import lit
from lumiframe.operators import artifacts, cache, detect, hooks, scoring
from lumiframe.plans.catalog import _SCORED, _SIG, _cached, _scored, _signed, query, r6
from lumiframe.sources import fixtures as X
from lumiframe.sources import readers

# ---- detections


@query(f"WITH {X.DETECTIONS_SQL}, n AS (SELECT *, row_number() OVER (PARTITION BY frame_idx ORDER BY vec_id) AS face FROM detections) SELECT frame_idx, CAST(face AS INTEGER) AS face_id, confidence, x2 FROM n WHERE vec_id % 7 <> 0 AND vec_id % 11 <> 0")
def well_formed_detections(spark, d):
    """A frame's detections and landmarks as two arrays, of which some entries are cut short or missing."""
    v = X.detections(spark, d)
    det = F.when(F.col("vec_id") % 7 == 0, F.slice("bbox", 1, 3)).otherwise(F.concat("bbox", F.array("confidence")))
    mark = F.when(F.col("vec_id") % 11 != 0, F.col("landmarks"))
    rows = v.select("frame_idx", F.struct("vec_id", det.alias("d"), mark.alias("l")).alias("x")).groupBy("frame_idx").agg(F.array_sort(F.collect_list("x")).alias("x"))
    out = detect.well_formed(rows.select("frame_idx", F.col("x.d").alias("dets"), F.col("x.l").alias("landmarks")))
    return out.select("frame_idx", "face_id", "confidence", F.col("bbox")[2].alias("x2"))


@query(f"WITH {X.DETECTIONS_SQL} SELECT vec_id, least(ax, bx, nx, dx, cx) AS x1, least(ay, by_, ny, dy, cy) AS y1, greatest(ax, bx, nx, dx, cx) AS x2, greatest(ay, by_, ny, dy, cy) AS y2 FROM detections")
def landmark_boxes(spark, d):
    b = G.landmark_box(F.col("landmarks"))
    return X.detections(spark, d).withColumn("b", b).select("vec_id", *[F.col("b")[i].alias(n) for i, n in enumerate(("x1", "y1", "x2", "y2"))])


@query(f"WITH {X.VECTORS_SQL}, u AS (SELECT vec_id, unnest(e) AS x, generate_subscripts(e, 1) - 1 AS i FROM vectors), s AS (SELECT vec_id, i, exp(x / 0.5e0) AS x, sum(exp(x / 0.5e0)) OVER (PARTITION BY vec_id) AS t FROM u) SELECT vec_id, round(max(x / t), 6) AS top, round(sum(i * x / t), 6) AS place FROM s GROUP BY 1")
def softmax_weights(spark, d):
    w = F.col("w")
    place = F.aggregate(F.transform(w, lambda x, i: x * i), lit(0), lambda s, x: s + x)
    return X.vectors(spark, d).withColumn("w", G.softmax(F.col("e"), 0.5)).select("vec_id", r6(F.array_max(w)).alias("top"), r6(place).alias("place"))


@query(f"WITH {X.VECTORS_SQL} SELECT a.vec_id, round(list_sum([(a.e[i] - b.e[i]) * (a.e[i] - b.e[i]) FOR i IN range(1, 65)]), 6) AS error FROM vectors a JOIN vectors b ON b.vec_id = a.vec_id + 1")
def squared_errors(spark, d):
    v = X.vectors(spark, d)
    other = v.select((F.col("vec_id") - 1).alias("vec_id"), F.col("e").alias("f"))
    return v.join(other, "vec_id").select("vec_id", r6(G.squared_error(F.col("e"), F.col("f"))).alias("error"))


@query(
    f"""WITH {X.NMS_SQL}, p AS (SELECT a.vec_id, greatest(0, least(a.x2,b.x2)-greatest(a.x1,b.x1)+1) * greatest(0, least(a.y2,b.y2)-greatest(a.y1,b.y1)+1) AS i,
  (a.x2-a.x1+1)*(a.y2-a.y1+1) AS s, (b.x2-b.x1+1)*(b.y2-b.y1+1) AS t FROM boxes a JOIN boxes b ON b.vec_id = a.vec_id + 1) SELECT vec_id, round(i / (s + t - i), 6) AS iou FROM p"""
)
def box_overlap(spark, d):
    sides = ("x1", "y1", "x2", "y2")
    a = X.nms_boxes(spark, d).select("vec_id", *sides)
    b = a.select((F.col("vec_id") - 1).alias("vec_id"), *[F.col(s).alias(f"o{s}") for s in sides])
    return a.join(b, "vec_id").select("vec_id", r6(G.iou([F.col(s) for s in sides], [F.col(f"o{s}") for s in sides])).alias("iou"))


@query(f"WITH {X.DETECTIONS_SQL}, s AS (SELECT *, 1000e0 / 640e0 AS ss FROM detections) SELECT vec_id, x2 / ss AS x2, y2 / ss AS y2, confidence, confidence / ss AS legacy FROM s")
def detector_rescale(spark, d):
    from lumiframe.config import EngineConfig

    s = G.detector_scale(F.col("width"), F.col("height"))
    box, sure = detect.rescale(F.col("bbox"), F.col("confidence"), s)
    _, legacy = detect.rescale(F.col("bbox"), F.col("confidence"), s, EngineConfig(legacy_confidence_scaling=True))
    return X.detections(spark, d).select("vec_id", box[2].alias("x2"), box[3].alias("y2"), sure.alias("confidence"), legacy.alias("legacy"))


@query("SELECT p_partkey, 1000e0 / greatest(p_size * 40, 480) AS scale, trunc(p_size * 40 * (1000e0 / greatest(p_size * 40, 480)))::BIGINT AS w, trunc(480 * (1000e0 / greatest(p_size * 40, 480)))::BIGINT AS h FROM part")
def detector_size(spark, d):
    out = G.detector_size((F.col("p_size") * 40).cast("double"), lit(480))
    return readers.table(spark, d, "part").select("p_partkey", out.alias("o")).select("p_partkey", "o.scale", "o.w", "o.h")


@query(
    """WITH s AS (SELECT p_partkey, 320 + p_size * 20 AS w, 480 + (p_partkey % 50) * 10 AS h, 640e0 / 360e0 AS r FROM part),
c AS (SELECT p_partkey, CASE WHEN abs(w::DOUBLE/h - r) < 0.001e0 OR w::DOUBLE/h <= r THEN w ELSE trunc(h*r)::BIGINT END AS cw, CASE WHEN abs(w::DOUBLE/h - r) < 0.001e0 OR w::DOUBLE/h > r THEN h ELSE trunc(w/r)::BIGINT END AS ch FROM s)
SELECT p_partkey, cw, ch, CASE WHEN cw = 640 AND ch = 360 THEN 'identity' WHEN 640*360 > cw*ch THEN 'cubic' ELSE 'area' END AS mode FROM c"""
)
def crop_then_resize(spark, d):
    w, h = (320 + F.col("p_size") * 20).cast("bigint"), (480 + (F.col("p_partkey") % 50) * 10).cast("bigint")
    out = G.crop_then_resize(w, h, F.lit(640), F.lit(360))
    return readers.table(spark, d, "part").select("p_partkey", out.alias("o")).select("p_partkey", F.col("o.crop.w").alias("cw"), F.col("o.crop.h").alias("ch"), "o.mode")


# ---- pixels and numbers

_PIXEL = "x AS (SELECT p_partkey, (p_partkey * 7) % 256 AS b, (p_partkey * 13) % 256 AS g, (p_partkey * 29) % 256 AS r FROM part)"


def _pixels(spark, d):
    k = F.col("p_partkey")
    return readers.table(spark, d, "part").select("p_partkey", F.array(*[(k * m % 256).cast("double") for m in (7, 13, 29)]).alias("p"))


@query(f"WITH {_PIXEL} SELECT p_partkey, CAST(floor(b * 0.114e0 + g * 0.587e0 + r * 0.299e0 + 0.5e0) AS INTEGER) AS gray FROM x")
def gray_pixels(spark, d):
    return _pixels(spark, d).select("p_partkey", G.gray(F.col("p")).alias("gray"))


@query(f"WITH {_PIXEL} SELECT p_partkey, b - 104e0 AS b, g - 117e0 AS g, r - 123e0 AS r FROM x")
def detector_channels(spark, d):
    c = G.detector_channels(F.col("p"))
    return _pixels(spark, d).select("p_partkey", *[c[i].alias(n) for i, n in enumerate("bgr")])


@query("WITH p AS (SELECT p_partkey, p_retailprice / 7 AS x FROM part), q AS (SELECT *, pow(2e0, floor(log2(x)) - 10) AS s FROM p) SELECT p_partkey, round_even(x / s, 0) * s AS x FROM q")
def half_precision(spark, d):
    return readers.table(spark, d, "part").select("p_partkey", S.half(F.col("p_retailprice") / 7).alias("x"))


@query("SELECT p_partkey, CASE WHEN p_size > 25 THEN (p_partkey % 100) / p_size::DOUBLE ELSE 0e0 END AS t, greatest(1, trunc((p_size - 1) / 7e0 * 3e0)::BIGINT) AS n FROM part")
def frame_times(spark, d):
    fps = F.when(F.col("p_size") > 25, F.col("p_size").cast("double")).otherwise(lit(0))
    return readers.table(spark, d, "part").select("p_partkey", S.index_to_time(F.col("p_partkey") % 100, fps).alias("t"), S.animation_frames((F.col("p_size") - 1) / lit(7)).alias("n"))


@query("SELECT event_id, strftime(ts, '%Y%m%d') AS day FROM events")
def day_stamps(spark, d):
    return readers.table(spark, d, "events").select("event_id", S.day_stamp(F.col("ts")).alias("day"))


@query("SELECT doc_id, trim(source || '/pg' || doc_id || '.jpg', '.jpg') || '.png' AS name FROM documents")
def stripped_names(spark, d):
    path = F.concat("source", F.lit("/pg"), F.col("doc_id").cast("string"), F.lit(".jpg"))
    return readers.table(spark, d, "documents").select("doc_id", F.concat(S.strip_set(path, ".jpg"), F.lit(".png")).alias("name"))


@query("SELECT event_id, TRY_CAST(json_extract_string('{\"format\":{\"duration\":\"' || CASE WHEN event_id % 5 = 0 THEN 'N/A' ELSE (value * 10)::BIGINT || '.25' END || '\"}}', '$.format.duration') AS DOUBLE) AS duration FROM events")
def container_durations(spark, d):
    text = F.when(F.col("event_id") % 5 == 0, "N/A").otherwise(F.concat(F.rint(F.col("value") * 10).cast("bigint").cast("string"), F.lit(".25")))
    return readers.table(spark, d, "events").select("event_id", S.container_duration(F.concat(F.lit('{"format":{"duration":"'), text, F.lit('"}}'))).alias("duration"))


# ---- poses


@query(f"WITH {X.VECTORS_SQL} SELECT vec_id, 'n' || vec_id AS name, round(degrees(e[1]), 6) AS yaw, round(degrees(e[2]), 6) AS pitch, round(-degrees(e[3]), 6) AS roll FROM vectors")
def pose_radians(spark, d):
    v = X.vectors(spark, d)
    t = F.split(F.concat_ws(" ", F.concat(F.lit("n"), F.col("vec_id").cast("string")), *[F.col("e")[i].cast("string") for i in range(3)]), " ")
    out = v.select("vec_id", t.alias("t")).select("vec_id", *readers.pose_fields(F.col("t"), radians=True))
    return out.select("vec_id", "name", *[r6(F.col(c)).alias(c) for c in ("yaw", "pitch", "roll")])


@query(
    f"""WITH {X.VECTORS_SQL}, a AS (SELECT vec_id, -(e[1]*100)*pi()/180 AS y, e[2]*100*pi()/180 AS p, e[3]*100*pi()/180 AS r FROM vectors),
c AS (SELECT vec_id, 150*cos(y)*cos(r) AS x1, 150*(cos(p)*sin(r)+cos(r)*sin(p)*sin(y)) AS y1, -150*cos(y)*sin(r) AS x2, 150*(cos(p)*cos(r)-sin(p)*sin(y)*sin(r)) AS y2, 150*sin(y) AS x3, -150*cos(y)*sin(p) AS y3 FROM a),
k AS (SELECT *, unnest(range(8)) AS b FROM c)
SELECT vec_id, b AS corner, round(320 - 75 + (b & 1)*x1 + ((b >> 1) & 1)*x2 + ((b >> 2) & 1)*x3, 6) AS x, round(240 - 75 + (b & 1)*y1 + ((b >> 1) & 1)*y2 + ((b >> 2) & 1)*y3, 6) AS y FROM k"""
)
def pose_cube(spark, d):
    e = F.col("e")
    corners = G.cube_corners(e[0] * 100, e[1] * 100, e[2] * 100, lit(320), lit(240))
    out = X.vectors(spark, d).select("vec_id", F.posexplode(corners).alias("corner", "c"))
    return out.select("vec_id", F.col("corner").cast("bigint").alias("corner"), r6(F.col("c.x")).alias("x"), r6(F.col("c.y")).alias("y"))


_DRAW = "('0x' || substr(md5('7:{}:' || vec_id), 1, 8))::BIGINT / 4294967296e0"


@query(
    f"""WITH {X.VECTORS_SQL}, a AS (SELECT vec_id, e, {_DRAW.format("flip")} < 0.5e0 AS flip, {_DRAW.format("blur")} < 0.05e0 AS blur, 1 + 5 * CAST(floor({_DRAW.format("factor")} * 4) AS INTEGER) AS factor FROM vectors)
SELECT vec_id, flip, blur, factor, CASE WHEN flip THEN -e[1] ELSE e[1] END AS yaw, CASE WHEN flip THEN -e[3] ELSE e[3] END AS roll FROM a"""
)
def training_variants(spark, d):
    e, a = F.col("e"), F.col("a")
    yaw, _, roll = G.flip_pose(e[0], e[1], e[2], a["flip"])
    out = X.vectors(spark, d).withColumn("a", G.augmentation(F.col("vec_id"), "7"))
    return out.select("vec_id", "a.flip", "a.blur", "a.factor", yaw.alias("yaw"), roll.alias("roll"))


# ---- results, logs, caches


@query(f"WITH {_SCORED}, v AS (SELECT * FROM scored WHERE score >= 0.5e0) SELECT video_id, count(*) AS frames, max(score)::VARCHAR AS best_score, string_agg(frame_idx::VARCHAR, ',' ORDER BY frame_idx) FILTER (score = top) AS best_frames FROM (SELECT *, max(score) OVER (PARTITION BY video_id) AS top FROM v) GROUP BY 1")
def result_maps(spark, d):
    maps = scoring.result_map(scoring.frames_by_score(scoring.valid_frames(_scored(spark, d))))
    m = F.col("valid_frames")
    top = F.array_max(F.transform(F.map_keys(m), lambda k: k.cast("double"))).cast("string")
    return maps.select("video_id", S.frame_count(m).alias("frames"), top.alias("best_score"), F.array_join(S.best_frames(m).cast("array<string>"), ",").alias("best_frames"))


@query(f"WITH {X.VIDEOS_SQL}, n AS (SELECT video_id, duration, CASE WHEN duration > 15 THEN 4 ELSE 1 END AS n FROM videos), s AS (SELECT *, unnest(range(n)) AS k FROM n) SELECT video_id, CAST(k AS INTEGER) AS segment, k * (duration / n) AS start_sec, duration / n AS segment_sec FROM s")
def split_plan(spark, d):
    from lumiframe.config import EngineConfig

    return artifacts.split_plan(X.videos(spark, d), 4, EngineConfig(split_min_duration_sec=15.0))


@query(
    f"""WITH {_SCORED}, {X.VIDEOS_SQL}, f AS (SELECT s.video_id, s.frame_idx, s.frame_idx::DOUBLE / v.total_frames AS t, s.score FROM scored s JOIN videos v USING (video_id)),
c AS (SELECT k AS c, k / 4e0 AS ct, (k % 3)::DOUBLE AS cs FROM range(5) r(k)), x AS (SELECT f.video_id, f.frame_idx, c.c, (ct - t) * (ct - t) + (cs - score) * (cs - score) AS dist FROM f, c)
SELECT video_id, frame_idx, c, dist FROM x QUALIFY row_number() OVER (PARTITION BY video_id, frame_idx ORDER BY dist, c) = 1"""
)
def nearest_centres(spark, d):
    """Each scored frame with the nearest of five fixed centres of its video."""
    v = X.videos(spark, d)
    centres = v.select("video_id", F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(4).cast("bigint"))).alias("c")).withColumns({"ct": F.col("c") / lit(4), "cs": (F.col("c") % 3).cast("double")})
    return artifacts.assign_centres(artifacts.keyframe_features(_scored(spark, d), v), centres).select("video_id", "frame_idx", "c", "dist")


@query(f"WITH {_SIG} SELECT signature, path AS file_path, '1.0' AS score, doc_id AS frame FROM f")
def cache_documents(spark, d):
    """Cache files' JSON, a document for each file, as rows."""
    f = _signed(spark, d)
    entry = F.to_json(F.struct(F.create_map("signature", F.struct(F.col("path").alias("file_path"), F.create_map(F.lit("1.0"), F.array("doc_id")).alias("valid_frames"), lit(5).alias("cached_at"))).alias("cache")))
    rows = readers.cache_entries(f.select(entry.alias("json")), "json")
    return rows.select("signature", "file_path", F.explode("valid_frames").alias("score", "v")).select("signature", "file_path", "score", F.col("v")[0].alias("frame"))


@query(f"WITH {_SIG} SELECT signature FROM f WHERE doc_id % 2 = 1 OR doc_id % 10 = 0")
def cache_changes(spark, d):
    """Entries that are due for a flush: new ones, and those that are younger than the flushed ones."""
    fresh = _signed(spark, d).filter("doc_id % 2 = 1 or doc_id % 10 = 0 or doc_id % 4 = 2").select("signature", F.col("path").alias("file_path"), F.create_map(F.lit("0.5"), F.array("doc_id")).alias("valid_frames"), F.when(F.col("doc_id") % 10 == 0, lit(3)).otherwise(lit(1)).alias("cached_at"))
    return cache.changed(fresh, _cached(spark, d)).select("signature")


@query("SELECT DISTINCT source || '/' || (doc_id // 2) AS path FROM documents WHERE doc_id % 5 <> 0")
def processed_log(spark, d):
    line = F.when(F.col("doc_id") % 5 == 0, F.lit("  ")).otherwise(F.concat(F.lit(" "), "source", F.lit("/"), F.floor(F.col("doc_id") / 2).cast("string"), F.lit("  ")))
    return readers.processed_paths(readers.table(spark, d, "documents").select(line.alias("line")), "line")


@query(
    """SELECT o_orderkey, unnest(CASE WHEN o_orderstatus <> 'F' THEN ['success', 'processed'] ELSE ['error'] END) AS log, CASE WHEN o_orderstatus <> 'F' THEN o_orderkey::VARCHAR ELSE o_orderkey || chr(10) || 'no frames' END AS line FROM orders"""
)
def log_lines(spark, d):
    rows = readers.table(spark, d, "orders").select(F.col("o_orderkey").cast("string").alias("path"), (F.col("o_orderstatus") != "F").alias("success"), F.lit("no frames").alias("error"))
    return cache.log_lines(rows).select(F.regexp_extract("line", r"^(\d+)", 1).cast("bigint").alias("o_orderkey"), "log", "line")


@query(
    """SELECT o_orderkey::VARCHAR AS path, CASE WHEN o_orderstatus <> 'F' THEN '{"success":true,"output_path":"/out/' || o_orderkey || '.webp"}' ELSE '{"success":false,"error":"no frames"}' END AS body, CASE WHEN o_orderstatus <> 'F' THEN 200 ELSE 500 END AS code FROM orders"""
)
def http_responses(spark, d):
    key = F.col("o_orderkey").cast("string")
    rows = readers.table(spark, d, "orders").select(key.alias("path"), (F.col("o_orderstatus") != "F").alias("success"), F.concat(F.lit("/out/"), key, F.lit(".webp")).alias("output_path"), F.lit("no frames").alias("error"))
    return hooks.responses(rows)


@query(
    f"""WITH {_SCORED}, k AS (SELECT video_id, frame_idx / 4e0 AS t FROM scored WHERE score >= 1.5e0) SELECT video_id, string_agg(printf('%.3f-%.3f', t, t + 0.5e0), ',' ORDER BY t) AS parts FROM k GROUP BY 1"""
)
def concat_order(spark, d):
    k = _scored(spark, d).filter("score >= 1.5").select("video_id", (F.col("frame_idx") / lit(4)).alias("start_time")).withColumn("end_time", F.col("start_time") + lit(0.5))
    return artifacts.concat_manifest(k).withColumn("parts", F.array_join("parts", ","))


# ---- encoder commands

_ARGS = """a AS (SELECT p_partkey, CASE p_partkey % 5 WHEN 0 THEN '-y -i in' || p_size || '.mp4 -c:v libx264 -vf fps=5,scale=' || p_size || ':' || p_size * 2 || ' out.mp4'
  WHEN 1 THEN '-i a.mp4 -t 3 -vcodec libwebp -s ' || p_size || 'x' || p_size || ' -vf scale=7x9 out' WHEN 2 THEN '-i a.mp4 -i b' || p_size || '.mp4 out.WEBP' WHEN 3 THEN 'x -c:v libx265 -s big' ELSE '-i' END AS txt, p_size AS dur FROM part),
s AS (SELECT p_partkey, dur, string_split(txt, ' ') AS a FROM a), i AS (SELECT *, range(1, len(a)) AS places FROM s),
f AS (SELECT *, [a[j + 1] FOR j IN places IF a[j] = '-i'] AS inputs, [a[j + 1] FOR j IN places IF a[j] IN ('-c:v', '-vcodec')] AS enc,
  [CASE a[j] WHEN '-s' THEN a[j + 1] ELSE regexp_replace(regexp_extract(a[j + 1], 'scale=(\\d+)[x:](\\d+)'), 'scale=(\\d+)[x:](\\d+)', '\\1x\\2') END FOR j IN places IF (a[j] = '-s' AND regexp_matches(a[j + 1], '^\\d+x\\d+$')) OR (a[j] = '-vf' AND regexp_matches(a[j + 1], 'scale=\\d+[x:]\\d+'))] AS res FROM i),
c AS (SELECT p_partkey, dur, a, inputs[-1] AS input, a[-1] AS output, list_contains(a, '-t') AS animated, list_contains(enc, 'libx264') AS x264, list_contains(enc, 'libwebp') OR lower(a[-1]) LIKE '%.webp' AS webp, res[-1] AS resolution, coalesce(list_max([j FOR j IN range(1, len(a) + 1) IF a[j] = '-i']) + 1, 0) AS stop FROM f)"""


def _args(spark, d):
    n, k = F.col("p_size").cast("string"), F.col("p_partkey") % 5
    text = (
        F.when(k == 0, F.concat(F.lit("-y -i in"), n, F.lit(".mp4 -c:v libx264 -vf fps=5,scale="), n, F.lit(":"), (F.col("p_size") * 2).cast("string"), F.lit(" out.mp4")))
        .when(k == 1, F.concat(F.lit("-i a.mp4 -t 3 -vcodec libwebp -s "), n, F.lit("x"), n, F.lit(" -vf scale=7x9 out"))).when(k == 2, F.concat(F.lit("-i a.mp4 -i b"), n, F.lit(".mp4 out.WEBP")))
        .when(k == 3, "x -c:v libx265 -s big").otherwise("-i")
    )
    return readers.table(spark, d, "part").select("p_partkey", F.split(text, " ").alias("args"), F.col("p_size").cast("double").alias("duration"))


@query(f"WITH {_ARGS} SELECT p_partkey, input, output, animated, x264, webp, resolution FROM c")
def encoder_commands(spark, d):
    return _args(spark, d).withColumn("c", C.command(F.col("args"))).select("p_partkey", "c.input", "c.output", "c.animated", "c.x264", "c.webp", "c.resolution")


@query(f"WITH {_ARGS} SELECT p_partkey, array_to_string(a[:stop] || CASE WHEN x264 THEN ['-g', '30', '-keyint_min', '30', '-sc_threshold', '0'] ELSE [] END || CASE WHEN webp AND dur > 30 THEN ['-ss', '30'] ELSE [] END || a[stop + 1:], ' ') AS args FROM c")
def rewritten_commands(spark, d):
    return _args(spark, d).select("p_partkey", F.array_join(C.rewritten(F.col("args"), F.col("duration")), " ").alias("args"))
