"""The driver's tables, and parts of them that several queries start from."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def millis() -> Column:
    """Milliseconds of an event's time, which has no zone and counts as UTC."""
    return F.unix_millis(F.col("ts").cast("timestamp"))


def visits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """events with ms, and with the day they fall on: what users do is followed within a day, so a busy user is as many
    keys as days."""
    return table(spark, sf_dir, "events").withColumn("ms", millis()).withColumn("day", F.floor(F.col("ms") / 86_400_000).cast("long"))


def lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """lineitem with pos, each line's place in its order; line numbers repeat, so the other columns settle ties."""
    order = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice")
    return table(spark, sf_dir, "lineitem").withColumn("pos", F.row_number().over(order).cast("long"))


def discs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as discs: a track for each line, a thousand frames for each unit of its quantity."""
    frames = (F.col("l_quantity") * 1000).cast("long")
    rows = lines(spark, sf_dir).select("l_orderkey", F.col("pos").alias("number"), frames.alias("frames"), (F.col("l_returnflag") == "R").alias("is_data"))
    order = Window.partitionBy("l_orderkey").orderBy("number")
    before = F.coalesce(F.sum("frames").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0).cast("long"))
    return rows.select("l_orderkey", "number", before.alias("start"), "is_data", F.sum("frames").over(Window.partitionBy("l_orderkey")).alias("leadout"))


LINES_SQL = "lines AS (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice) AS pos FROM lineitem)"
DISCS_SQL = f"""{LINES_SQL}, tracks AS (
  SELECT l_orderkey, pos AS number, l_returnflag = 'R' AS is_data, CAST(l_quantity * 1000 AS BIGINT) AS frames,
         CAST(coalesce(sum(CAST(l_quantity * 1000 AS BIGINT)) OVER (PARTITION BY l_orderkey ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS start,
         CAST(sum(CAST(l_quantity * 1000 AS BIGINT)) OVER (PARTITION BY l_orderkey) AS BIGINT) AS leadout
  FROM lines
)"""
VISITS_SQL = "visits AS (SELECT *, epoch_us(ts) // 1000 AS ms, epoch_us(ts) // 86400000000 AS day FROM events)"
