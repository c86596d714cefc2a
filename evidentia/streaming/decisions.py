"""Decisions and feedback as a stream of JSON-lines files: each file is taken in once, and of a decision the first version within the watermark."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def decision_stream(spark: SparkSession, folder: str, schema, files_per_batch: int = 100) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).json(folder)


def latest(stream: DataFrame, key: str, time: str, lateness: str) -> DataFrame:
    """The first version of each decision within the watermark, so a file that comes twice adds nothing."""
    return stream.withWatermark(time, lateness).dropDuplicatesWithinWatermark([key])


def counts_by_window(stream: DataFrame, time: str, width: str, lateness: str, by: str) -> DataFrame:
    """Counts per time window and ``by``; events later than the watermark are left out."""
    return stream.withWatermark(time, lateness).groupBy(F.window(time, width), by).agg(F.count("*").alias("n"))


def ingest(stream: DataFrame, target: str, checkpoint: str) -> None:
    """Takes in all there is, as Parquet, exactly once per file."""
    query = stream.writeStream.format("parquet").option("path", target).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()
    query.awaitTermination()
