"""Micro-batch jobs: a file source drained with `availableNow`, each batch written once however often it is replayed."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def drain(source: DataFrame, step: Callable[[DataFrame], DataFrame], out: str, checkpoint: str) -> int:
    """Runs `step` over every waiting micro-batch and appends its rows under batch_id; returns the batches run.

    A batch's rows replace what an earlier attempt at the same batch wrote, so a replay changes nothing."""

    def write(batch: DataFrame, batch_id: int) -> None:
        step(batch).withColumn("batch_id", F.lit(batch_id)).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("batch_id").parquet(out)

    q = source.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    q.awaitTermination()
    return len(q.recentProgress)


def read_stream(spark: SparkSession, folder: str, name: str, files_per_batch: int = 1) -> DataFrame:
    """The files of `folder` called `name` (a glob) as a stream."""
    schema = spark.read.parquet(f"{folder}/{name}").schema
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).option("pathGlobFilter", name).parquet(folder)


def hourly(stream: DataFrame, late: str = "10 minutes") -> DataFrame:
    """Event-time counts with a watermark (an extension: event time, not arrival, decides the hour)."""
    return stream.withWatermark("ts", late).groupBy(F.window("ts", "1 hour"), "event_type").agg(F.count("*").alias("n"))
