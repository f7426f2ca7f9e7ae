"""The job log as a stream, and event-time counts over it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read_events(spark: SparkSession, folder: str, schema) -> DataFrame:
    """A stream of Parquet files of events; times without zone count as UTC, so that watermarks can be set."""
    return spark.readStream.schema(schema).parquet(folder).withColumn("ts", F.col("ts").cast("timestamp"))


def log_lines(events: DataFrame, dropped: str = "Progress") -> DataFrame:
    """What the job log keeps: every event but progress, as one line. Stateless, so it appends."""
    return events.filter(F.col("event_type") != dropped).select("event_id", F.concat_ws(" ", F.date_format("ts", "yyyy-MM-dd'T'HHmm"), "event_type", F.col("user_id").cast("string")).alias("line"))


def windowed(events: DataFrame, width: str = "1 day", late: str = "1 hour") -> DataFrame:
    """(start, event_type, n) for windows of event time; events later than `late` no longer count."""
    counted = events.withWatermark("ts", late).groupBy(F.window("ts", width), "event_type").agg(F.count("*").alias("n"))
    return counted.select(F.col("window.start").alias("start"), "event_type", "n")


def drained(stream: DataFrame, folder: str, name: str) -> DataFrame:
    """Runs a stream over what is there now, into a Parquet table of the shared folder, and reads that."""
    spark = stream.sparkSession
    out = f"{folder}/{name}"
    query = stream.writeStream.format("parquet").outputMode("append").option("checkpointLocation", f"{out}-progress").option("path", out).trigger(availableNow=True).start()
    query.awaitTermination()
    return spark.read.schema(stream.schema).parquet(out)
