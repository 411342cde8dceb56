"""Views over the driver tables that stand for frames, detections, landmarks and pixels, and the same views as SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lumiframe.functions.scalar import lit
from lumiframe.sources.readers import table


def frames(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events").select(F.col("user_id").alias("video_id"), "event_id", "value", "ts")
    scale = F.when(F.col("video_id") % 3 == 0, lit(100)).when(F.col("video_id") % 3 == 1, lit(10)).otherwise(lit(1))
    idx = F.row_number().over(Window.partitionBy("video_id").orderBy("event_id")) - 1
    return e.select("video_id", idx.cast("bigint").alias("frame_idx"), F.least(lit(1), F.col("value") / lit(100)).alias("mag"), F.least(lit(1), F.col("value") / scale).alias("mag_tiered"), "event_id", "ts")


FRAMES_SQL = """frames AS (SELECT user_id AS video_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1 AS frame_idx,
  least(1e0, value / 100e0) AS mag, least(1e0, value / CASE user_id % 3 WHEN 0 THEN 100e0 WHEN 1 THEN 10e0 ELSE 1e0 END) AS mag_tiered, event_id, ts FROM events)"""


def videos(spark: SparkSession, d: str) -> DataFrame:
    n = table(spark, d, "events").groupBy(F.col("user_id").alias("video_id")).agg(F.count("*").alias("total_frames"))
    return n.withColumns({"fps": lit(4), "duration": F.col("total_frames") / lit(4), "window": F.lit(12).cast("bigint")})


VIDEOS_SQL = "videos AS (SELECT user_id AS video_id, count(*) AS total_frames, 4e0 AS fps, count(*) / 4e0 AS duration, 12 AS win FROM events GROUP BY 1)"


def vectors(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "embeddings").select("vec_id", F.col("embedding").cast("array<double>").alias("e"), "label")


VECTORS_SQL = "vectors AS (SELECT vec_id, embedding::DOUBLE[] AS e, label FROM embeddings)"


def detections(spark: SparkSession, d: str) -> DataFrame:
    e, f = F.col("e"), F.floor(F.col("vec_id") / 5)
    v = vectors(spark, d)
    offsets = (-0.3, -0.3, 0.3, -0.3, 0.0, 0.0, -0.3, 0.3, 0.3, 0.3)
    marks = F.array(*[e[k] * lit(1.5) + lit(o) for k, o in enumerate(offsets)])
    return v.select(
        (f % 10).alias("video_id"), f.alias("frame_idx"), (F.col("vec_id") % 5 + 1).alias("face_id"), "vec_id",
        (lit(0.95) + F.least(lit(0.05), F.abs(e[0]) * lit(0.4))).alias("confidence"),
        F.array(lit(100), lit(100), lit(120) + F.abs(e[1]) * lit(800), lit(120) + F.abs(e[2]) * lit(800)).alias("bbox"), marks.alias("landmarks"), lit(640).alias("width"), lit(640).alias("height"),
    )


DETECTIONS_SQL = VECTORS_SQL + """, detections AS (SELECT (vec_id // 5) % 10 AS video_id, vec_id // 5 AS frame_idx, vec_id % 5 + 1 AS face_id, vec_id,
  0.95e0 + least(0.05e0, abs(e[1]) * 0.4e0) AS confidence, 100e0 AS x1, 100e0 AS y1, 120e0 + abs(e[2]) * 800e0 AS x2, 120e0 + abs(e[3]) * 800e0 AS y2,
  e[1]*1.5e0-0.3e0 AS ax, e[2]*1.5e0-0.3e0 AS ay, e[3]*1.5e0+0.3e0 AS bx, e[4]*1.5e0-0.3e0 AS by_, e[5]*1.5e0 AS nx, e[6]*1.5e0 AS ny,
  e[7]*1.5e0-0.3e0 AS dx, e[8]*1.5e0+0.3e0 AS dy, e[9]*1.5e0+0.3e0 AS cx, e[10]*1.5e0+0.3e0 AS cy FROM vectors)"""


def nms_boxes(spark: SparkSession, d: str) -> DataFrame:
    e = F.col("e")
    x1, y1 = lit(500) + lit(400) * e[0], lit(500) + lit(400) * e[1]
    b = vectors(spark, d).select("label", "vec_id", x1.alias("x1"), y1.alias("y1"), (x1 + lit(60) + lit(200) * F.abs(e[2])).alias("x2"), (y1 + lit(60) + lit(200) * F.abs(e[3])).alias("y2"), F.least(lit(1), lit(0.9) + F.abs(e[4])).alias("score"))
    return b


NMS_SQL = VECTORS_SQL + """, boxes AS (SELECT label, vec_id, 500e0+400e0*e[1] AS x1, 500e0+400e0*e[2] AS y1, 500e0+400e0*e[1]+60e0+200e0*abs(e[3]) AS x2,
  500e0+400e0*e[2]+60e0+200e0*abs(e[4]) AS y2, least(1e0, 0.9e0+abs(e[5])) AS score FROM vectors)"""


def gray(spark: SparkSession, d: str) -> DataFrame:
    """An 8 x 8 gray plane of each vector, as an array of 64 values by row."""
    k = F.col("vec_id") % 4
    base = F.when(k == 0, lit(15)).when(k == 1, lit(128)).when(k == 2, lit(128)).otherwise(lit(60))
    gain = F.when(k == 0, lit(100)).when(k == 1, lit(20)).when(k == 2, lit(600)).otherwise(lit(900))
    plane = F.transform("e", lambda x: F.floor(F.greatest(lit(0), F.least(lit(255), F.col("base") + x * F.col("gain")))).cast("double"))
    return vectors(spark, d).withColumns({"base": base, "gain": gain}).select("vec_id", plane.alias("gray"))


GRAY_SQL = VECTORS_SQL + """, px AS (SELECT vec_id, unnest(e) AS v, generate_subscripts(e, 1) - 1 AS p FROM vectors),
gray AS (SELECT vec_id, p // 8 AS r, p % 8 AS c, floor(greatest(0e0, least(255e0, CASE vec_id % 4 WHEN 0 THEN 15e0 WHEN 3 THEN 60e0 ELSE 128e0 END
  + v * CASE vec_id % 4 WHEN 0 THEN 100e0 WHEN 1 THEN 20e0 WHEN 2 THEN 600e0 ELSE 900e0 END))) AS g FROM px)"""


def motion_vectors(spark: SparkSession, d: str) -> DataFrame:
    e = F.col("e")
    return vectors(spark, d).select(F.floor(F.col("vec_id") / 5).alias("frame_idx"), "vec_id", (lit(8) + lit(8) * (F.col("vec_id") % 2)).alias("w"), lit(16).alias("h"), (lit(100) * e[0]).alias("mx"), (lit(100) * e[1]).alias("my"), lit(4).alias("ms"))


MOTION_SQL = VECTORS_SQL + ", mv AS (SELECT vec_id // 5 AS frame_idx, vec_id, 8e0+8e0*(vec_id%2) AS w, 16e0 AS h, 100e0*e[1] AS mx, 100e0*e[2] AS my, 4e0 AS ms FROM vectors)"


def files(spark: SparkSession, d: str) -> DataFrame:
    names = F.array(*[F.lit(x) for x in ("mp4", "avi", "mov", "mkv", "wmv", "flv", "webm", "txt")])
    docs = table(spark, d, "documents").select(F.concat("source", F.lit("/"), F.col("doc_id").cast("string"), F.lit("."), names[(F.col("doc_id") % 8).cast("int")]).alias("path"), "doc_id")
    return docs.unionByName(table(spark, d, "pages").select(F.col("url").alias("path"), F.lit(None).cast("bigint").alias("doc_id")))


FILES_SQL = """files AS (SELECT source || '/' || doc_id || '.' || (['mp4','avi','mov','mkv','wmv','flv','webm','txt'])[doc_id % 8 + 1] AS path, doc_id FROM documents
  UNION ALL SELECT url AS path, NULL AS doc_id FROM pages)"""
