"""Incremental runs: Structured Streaming over files as they come."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def source(spark: SparkSession, path: str, schema, files_per_trigger: int = 1) -> DataFrame:
    df = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(path)
    return df.withColumn("ts", F.col("ts").cast("timestamp"))  # watermarks need a time zone


def periods(events: DataFrame, every: str = "1 day", late: str = "2 days") -> DataFrame:
    """Counts and sums by tumbling window and type; rows later than ``late`` behind the newest are left out."""
    w = events.withWatermark("ts", late).groupBy(F.window("ts", every).alias("w"), "event_type")
    return w.agg(F.count("*").alias("n"), F.sum("value").alias("total")).select(F.col("w.start").alias("period_start"), "event_type", "n", F.round("total", 4).alias("total"))


def sessions(events: DataFrame, gap: str = "30 minutes", late: str = "2 days") -> DataFrame:
    w = events.withWatermark("ts", late).groupBy(F.session_window("ts", gap).alias("w"), "user_id")
    return w.agg(F.count("*").alias("n")).select("user_id", F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n")


def increments(events: DataFrame, marks: DataFrame) -> DataFrame:
    """Rows beyond each user's high-water mark; marks: a row a user."""
    return events.join(marks, "user_id", "left").filter(F.col("ts") > F.coalesce("mark", F.lit("2020-01-01").cast("timestamp"))).drop("mark")


def run_once(df: DataFrame, path: str, checkpoint: str, mode: str = "append") -> None:
    """Handles all there is, then stops; the checkpoint makes the next call start after it."""
    df.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode(mode).trigger(availableNow=True).start().awaitTermination()
