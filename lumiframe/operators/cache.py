"""Operations: pending work, result cache, status log."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lumiframe.functions import scalar as S
from lumiframe.schemas import CACHE
from lumiframe.sources.readers import read_processed_log


def pending(files: DataFrame, processed: DataFrame) -> DataFrame:
    """Video paths that no processed row names; duplicates stay."""
    return files.filter(S.is_video(F.col("path"))).join(processed.select("path").distinct(), "path", "left_anti")


def lookup(files: DataFrame, cache: DataFrame) -> DataFrame:
    """files (with signature) and their cache entry; `hit` also for an entry without frames."""
    entries = latest(cache).select("signature", F.col("valid_frames").alias("cached_frames"), F.lit(True).alias("_hit"))
    return files.join(entries, "signature", "left").withColumn("hit", F.coalesce("_hit", F.lit(False))).drop("_hit")


def latest(cache: DataFrame) -> DataFrame:
    """The last entry of every signature; of equal times the one of the greatest path."""
    w = Window.partitionBy("signature").orderBy(F.desc("cached_at"), F.desc("file_path"))
    return cache.withColumn("_r", F.row_number().over(w)).filter("_r = 1").drop("_r")


def upsert(cache: DataFrame, fresh: DataFrame) -> DataFrame:
    return latest(cache.unionByName(fresh))


def remove(cache: DataFrame, signatures: DataFrame) -> DataFrame:
    return cache.join(signatures.select("signature").distinct(), "signature", "left_anti")


def purge_stale(cache: DataFrame) -> DataFrame:
    """The last entry of every path: a changed file has a new signature."""
    w = Window.partitionBy("file_path").orderBy(F.desc("cached_at"), F.desc("signature"))
    return cache.withColumn("_r", F.row_number().over(w)).filter("_r = 1").drop("_r")


def stats(cache: DataFrame) -> DataFrame:
    frames = F.aggregate(F.map_values("valid_frames"), F.lit(0), lambda n, v: n + F.size(v))
    return cache.agg(F.count("*").alias("entries"), F.coalesce(F.sum(frames), F.lit(0)).alias("frames"), F.coalesce(F.sum(F.length(F.to_json("valid_frames"))), F.lit(0)).alias("bytes"))


def clear(cache: DataFrame) -> DataFrame:
    return cache.limit(0)


def changed(cache: DataFrame, flushed: DataFrame) -> DataFrame:
    """The entries that the flushed table lacks or has an older one of; their number says whether a flush is due."""
    old = flushed.groupBy("signature").agg(F.max("cached_at").alias("_at"))
    return latest(cache).join(old, "signature", "left").filter(F.col("_at").isNull() | (F.col("cached_at") > F.col("_at"))).drop("_at")


def _fs(spark: SparkSession, path: str):
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), target


def _versions(spark: SparkSession, path: str) -> list[str]:
    """The names of the whole versions of a cache, oldest first: a version is whole once its writer has left _SUCCESS."""
    fs, base = _fs(spark, path)
    if not fs.exists(base):
        return []
    names = sorted(n for n in (f.getPath().getName() for f in fs.listStatus(base)) if n.startswith("v") and n[1:].isdigit())
    return [n for n in names if fs.exists(_fs(spark, f"{path}/{n}/_SUCCESS")[1])]


def current(spark: SparkSession, path: str) -> DataFrame | None:
    """The cache as last flushed to a folder, or None."""
    found = _versions(spark, path)
    return spark.read.schema(CACHE).parquet(f"{path}/{found[-1]}") if found else None


def flush(cache: DataFrame, path: str) -> None:
    """Writes the whole cache as a new version below path. A failure at any moment leaves the version before as the current
    one; that stays for readers that have begun, older ones go."""
    spark = cache.sparkSession
    found = _versions(spark, path)
    number = int(found[-1][1:]) + 1 if found else 1
    cache.write.mode("overwrite").parquet(f"{path}/v{number:012d}")
    fs, _ = _fs(spark, path)
    for old in found[:-1]:
        fs.delete(_fs(spark, f"{path}/{old}")[1], True)


def status_rows(results: DataFrame) -> DataFrame:
    """(path, status, error) of results (path, success, error); only successes count as processed."""
    return results.select("path", F.when(F.col("success"), "processed").otherwise("failed").alias("status"), F.when(~F.col("success"), F.coalesce("error", F.lit(""))).alias("error"))


def log_lines(results: DataFrame) -> DataFrame:
    """(log, line): what a run appends to its logs. A success is a line of the logs `success` and `processed`; a failure is
    two of `error`, the path and the message, which stay together."""
    status = status_rows(results)
    logs = F.when(F.col("status") == "processed", F.array(F.lit("success"), F.lit("processed"))).otherwise(F.array(F.lit("error")))
    line = F.when(F.col("status") == "processed", F.col("path")).otherwise(F.concat("path", F.lit("\n"), F.regexp_replace("error", r"[\r\n]+", " ")))
    return status.select(F.explode(logs).alias("log"), line.alias("line"))


def append_logs(results: DataFrame, base: str) -> None:
    """Appends log_lines to text files below base, a folder for each log (log=success and so on)."""
    log_lines(results).write.mode("append").partitionBy("log").text(base)


def processed(spark: SparkSession, base: str) -> DataFrame:
    """The paths that earlier runs have logged as processed below base; none before the first."""
    fs, folder = _fs(spark, f"{base}/log=processed")
    if not fs.exists(folder):
        return spark.createDataFrame([], "path string")
    return read_processed_log(spark, f"{base}/log=processed")
