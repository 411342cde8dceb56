"""The request job: JSON requests that arrive as files, answered as JSON lines."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lumiframe import schemas
from lumiframe.config import DEFAULT, EngineConfig
from lumiframe.functions import scalar
from lumiframe.jobs.batch import analyse
from lumiframe.operators.hooks import responses


def answer(batch: DataFrame, detector: Callable, decoder: str = "y4m", config: EngineConfig = DEFAULT) -> DataFrame:
    """(path, body, code) of requests (input_path, output_path, resolution). A request without paths or with a malformed
    resolution is refused; a video that several requests name is scanned once."""
    paths = F.col("input_path").isNotNull() & F.col("output_path").isNotNull()
    size = F.col("resolution").isNull() | scalar.parse_resolution(F.col("resolution")).isNotNull()
    rows = batch.withColumn("refusal", F.when(~paths, "missing path").when(~size, "invalid resolution"))
    wanted = rows.filter("refusal is null").select(F.col("input_path").alias("path")).distinct()
    found = analyse(wanted, detector, decoder, config).select(F.col("path").alias("input_path"), "success", "error")
    out = rows.join(found, "input_path", "left")
    result = out.select(F.col("input_path").alias("path"), (F.col("refusal").isNull() & F.coalesce("success", F.lit(False))).alias("success"), "output_path", F.coalesce("refusal", "error").alias("error"))
    return responses(result)


def serve(spark: SparkSession, inbox: str, outbox: str, checkpoint: str, detector: Callable, decoder: str = "y4m", config: EngineConfig = DEFAULT, once: bool = True):
    """A stream that answers every request file of inbox once; with `once` it ends when all that is there is answered. At most
    eight files are taken at a time."""
    stream = spark.readStream.schema(schemas.REQUEST).option("maxFilesPerTrigger", 8).json(inbox)

    def handle(batch: DataFrame, number: int) -> None:
        answer(batch, detector, decoder, config).write.mode("overwrite").json(f"{outbox}/batch={number}")

    writer = stream.writeStream.foreachBatch(handle).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer.trigger(processingTime="1 second")).start()
