"""Intermediate tables in the folder that the cluster shares (spark.checkpoint.dir)."""

from __future__ import annotations

import atexit
import gc
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The shared folder of the session. Only a session of one machine may do without (tests): it gets a temporary one."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.split("[")[0] == "local":
            raise ValueError("spark.checkpoint.dir must name a folder that all machines of the cluster share")
        found = "file://" + tempfile.mkdtemp(prefix="lumiframe-")
        spark.conf.set("spark.checkpoint.dir", found)
        spark.sparkContext.setCheckpointDir(found)
    return found.rstrip("/")


#: Rows of an Arrow batch on its way to Python, where the session doesn't set a number.
BATCH_ROWS = 1000


def small_batches(spark: SparkSession) -> None:
    """Texts are long rows: the default of 10,000 rows a batch would hold tens of megabytes several times over, in the
    executor and in Python. A number that the session sets itself, whatever it is, stays; Spark reads it when a lazy
    result runs, so it can't be put back at the end of a call."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if key not in spark.conf.getAll:
        spark.conf.set(key, str(BATCH_ROWS))


def _delete(spark: SparkSession, path: str) -> None:
    jvm = spark.sparkContext._jvm
    if jvm is None:
        return
    target = jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


_open: set[Scratch] = set()


@atexit.register
def _close_all() -> None:
    for scratch in list(_open):
        scratch.close()


class Scratch:
    """Tables of one operator call. A table is Parquet, so a lost executor costs a re-read, never a re-run
    of the stages before it. drop() frees a table as soon as no later step reads it. What a lazy result still reads goes
    with close(), when a `with` block ends, or at the latest with the process: give an operator a scratch of your own,
    write its result, and close it."""

    def __init__(self, spark: SparkSession, name: str):
        small_batches(spark)
        self.spark = spark
        self.base = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
        self.count = 0
        _open.add(self)

    def __enter__(self) -> Scratch:
        return self

    def __exit__(self, *error) -> None:
        self.close()

    def save(self, df: DataFrame, label: str = "t") -> DataFrame:
        self.count += 1
        path = f"{self.base}/{label}-{self.count}"
        df.write.parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        out._scratch_path = path
        return out

    def drop(self, *tables: DataFrame) -> None:
        for t in tables:
            path = getattr(t, "_scratch_path", None)
            if path:
                _delete(self.spark, path)

    def release(self) -> None:
        """Let go of the shuffle files of queries that have ended: Spark deletes them once the driver has collected its
        garbage, which it does rarely by itself."""
        gc.collect()
        self.spark.sparkContext._jvm.System.gc()

    def close(self) -> None:
        _open.discard(self)
        try:
            _delete(self.spark, self.base)
        except Exception:  # the session is already gone
            pass
