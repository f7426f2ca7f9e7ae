"""A job's events as a stream: progress that never falls, kept as state for each job, and one stream into several sinks."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

_STATE = "high double"


def rising(events: DataFrame) -> DataFrame:
    """Of a stream of events (job, pos, fraction) those that tell of more progress than any before of their job. What a job has
    reached is a number of state; events of one batch are taken by pos, and batches as they come."""
    kind = T.StructType([T.StructField("job", events.schema["job"].dataType), T.StructField("pos", T.LongType()), T.StructField("fraction", T.DoubleType())])

    def run(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        high = state.get[0] if state.exists else float("-inf")
        rows = pd.concat(list(frames)).sort_values("pos")
        before = rows["fraction"].cummax().shift(fill_value=float("-inf")).clip(lower=high)
        state.update((max(high, float(rows["fraction"].max())),))
        told = rows[rows["fraction"] > before][["job", "pos", "fraction"]]
        if len(told):
            yield told

    asked = events.select("job", F.col("pos").cast("long").alias("pos"), F.col("fraction").cast("double").alias("fraction")).filter("fraction is not null")
    return asked.groupBy("job").applyInPandasWithState(run, kind, _STATE, "append", GroupStateTimeout.NoTimeout)


def fanned_out(stream: DataFrame, folder: str, sinks: dict[str, Callable[[DataFrame], DataFrame]], checkpoint: str | None = None) -> dict[str, DataFrame]:
    """Drains a stream into several tables below folder at once, each a function of its batches, and reads them.

    Every batch writes a folder of its own number in every sink, in place of what a broken attempt at it left; a batch that
    was cut off between two sinks is written again whole when the stream is taken up, so nothing is lost or comes twice.
    """
    spark = stream.sparkSession

    def write(batch: DataFrame, number: int) -> None:
        kept = batch.persist()
        try:
            for name, of in sinks.items():
                of(kept).write.mode("overwrite").parquet(f"{folder}/{name}/batch={number}")
        finally:
            kept.unpersist()

    query = stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint or f"{folder}/progress").trigger(availableNow=True).start()
    query.awaitTermination()
    found = {}
    for name, of in sinks.items():
        nothing = of(spark.createDataFrame([], stream.schema))
        nothing.write.mode("overwrite").parquet(f"{folder}/{name}/batch=none")  # so that a stream without batches has tables too
        found[name] = spark.read.schema(nothing.schema).parquet(f"{folder}/{name}/batch=*")
    return found
