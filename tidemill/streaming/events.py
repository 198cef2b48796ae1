"""An extension: the events table as a stream. The dialect itself has no streams."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def event_stream(spark: SparkSession, folder: str, files_per_trigger: int = 1) -> DataFrame:
    """The files of a folder of events, as they come."""
    schema = spark.read.parquet(folder).schema
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(folder)


def timed(events: DataFrame, late: str | None) -> DataFrame:
    """ts as a timestamp, with a watermark; late=None where the stream has one already."""
    out = events.withColumn("ts", F.col("ts").cast("timestamp")) if late else events
    return out.withWatermark("ts", late) if late else out


def windowed_counts(events: DataFrame, width: str = "1 hour", slide: str | None = None, late: str | None = "1 day") -> DataFrame:
    """Events and the sum of their values by tumbling (or sliding) windows and type; events later than `late` are dropped."""
    w = F.window("ts", width, slide) if slide else F.window("ts", width)
    return timed(events, late).groupBy(w.alias("w"), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total")).select(F.col("w.start").alias("start"), "event_type", "n", "total")


def sessions(events: DataFrame, gap: str = "30 minutes", late: str | None = "1 day") -> DataFrame:
    return timed(events, late).groupBy(F.session_window("ts", gap).alias("w"), "user_id").agg(F.count("*").alias("n")).select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), "user_id", "n")


def deduplicated(events: DataFrame, late: str = "1 day") -> DataFrame:
    return timed(events, late).dropDuplicatesWithinWatermark(["event_id"])
