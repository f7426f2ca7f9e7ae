"""Where driver and executors meet: the folder that the cluster names for checkpoints."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """spark.checkpoint.dir. Where none is set, a local session gets one here; a cluster gets an error."""
    told = spark.conf.get("spark.checkpoint.dir", None)
    if not told:
        master = spark.sparkContext.master
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        told = "/tmp/checkpoints/platterlens"
        spark.conf.set("spark.checkpoint.dir", told)
    return told.rstrip("/")


def kept(df: DataFrame, name: str) -> DataFrame:
    """df as a table in the shared folder, read again: what a loop goes on from, and what a lost executor does not undo."""
    path = f"{shared_folder(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
