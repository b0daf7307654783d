"""Streaming extension: counts and sums of tiles in event-time windows, late rows dropped by a watermark."""

from __future__ import annotations

import os
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pelorus.plans.runtime import ensure_checkpoint_dir


def windowed(events: DataFrame, window: str = "1 day", late: str = "2 hours") -> DataFrame:
    """window_start, event_type, n, total of a batch or streaming frame with ts, event_type, value."""
    d = events.withColumn("ts", F.col("ts").cast("timestamp"))
    if d.isStreaming:
        d = d.withWatermark("ts", late)
    return d.groupBy(F.window("ts", window), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total")).select(F.col("window.start").alias("window_start"), "event_type", "n", "total")


def run_to_table(spark: SparkSession, path: str, name: str, window: str = "1 day") -> DataFrame:
    """Drive the stream over the parquet files of ``path`` (a folder, or one file) to its end and return the table it leaves.

    Every trigger writes the whole result to a folder beside the checkpoints, which all executors share; nothing is held on the driver.
    """
    ensure_checkpoint_dir(spark)
    home = f"{spark.sparkContext.getCheckpointDir()}/{name}-{uuid.uuid4().hex}"
    reader = spark.readStream.schema(spark.read.parquet(path).schema)
    if os.path.isfile(path):
        reader, path = reader.option("pathGlobFilter", os.path.basename(path)), os.path.dirname(path)
    result = windowed(reader.parquet(path), window)

    def keep(batch: DataFrame, number: int) -> None:
        batch.write.parquet(f"{home}/{number}")

    query = result.writeStream.outputMode("complete").foreachBatch(keep).option("checkpointLocation", f"{home}/state").trigger(availableNow=True).start()
    query.awaitTermination()
    last = query.lastProgress
    if last is None:
        return spark.createDataFrame([], result.schema)
    return spark.read.schema(result.schema).parquet(f"{home}/{last['batchId']}")
