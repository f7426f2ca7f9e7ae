"""Computations along an order: cues, tracks, sessions of words, readings that agree."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def tidy_cues(cues: DataFrame, by: list[str], order: list[str]) -> DataFrame:
    """cues (by, start_ms, end_ms) with end_ms filled and kept apart: a missing end is 1 ms before the next start (3 s
    after the start of the last), an overlap ends there too, and what would not last gets 800 ms."""
    following = F.lead("start_ms").over(Window.partitionBy(*by).orderBy(*order))
    before = F.when(F.col("__next").isNotNull(), F.greatest(F.col("__next") - 1, F.lit(0)))
    filled = F.coalesce("end_ms", before, F.col("start_ms") + 3000)
    apart = F.when(filled >= F.col("__next"), before).otherwise(filled)
    rows = cues.withColumn("__next", following)
    return rows.withColumn("end_ms", F.when(apart <= F.col("start_ms"), F.col("start_ms") + 800).otherwise(apart)).drop("__next")


def layout(tracks: DataFrame, by: list[str]) -> DataFrame:
    """tracks (by, number, start, pregap, leadout) as files: each from its start less its pregap to the next file."""
    begins = F.greatest(F.col("start") - F.coalesce("pregap", F.lit(0)), F.lit(0))
    rows = tracks.withColumn("file_start", begins)
    ends = F.coalesce(F.lead("file_start").over(Window.partitionBy(*by).orderBy("number")), F.col("leadout"))
    return rows.withColumn("file_end", ends).withColumn("bytes", (F.col("file_end") - F.col("file_start")) * 2352)


def sessions(rows: DataFrame, by: list[str], order: list[str], opens: Column) -> DataFrame:
    """rows with session, counted from 0: a row for which opens holds, over `__gap` from the row before, begins a new one."""
    w = Window.partitionBy(*by).orderBy(*order)
    return rows.withColumn("session", F.sum(F.when(opens, 1).otherwise(0)).over(w.rowsBetween(Window.unboundedPreceding, 0)))


def gap_sessions(rows: DataFrame, by: list[str], at: str, ties: list[str], least_gap) -> DataFrame:
    """Words out of letters, visits out of clicks: a gap of least_gap or more begins a new session."""
    w = Window.partitionBy(*by).orderBy(at, *ties)
    gapped = rows.withColumn("__gap", F.col(at) - F.lag(at).over(w))
    return sessions(gapped, by, [at, *ties], F.col("__gap") >= least_gap).drop("__gap")


def repeated_from_before(rows: DataFrame, by: list[str], order: list[str], value: str) -> DataFrame:
    """Nulls take the last value before them."""
    w = Window.partitionBy(*by).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return rows.withColumn(value, F.last(value, ignorenulls=True).over(w))


def consensus(readings: DataFrame, by: list[str]) -> DataFrame:
    """(by, digest, attempts, agreed) of readings (by, attempt, digest, flagged): the first reading if nothing in it is
    flagged, else the first that equals the one before it, else the last of three."""
    w = Window.partitionBy(*by).orderBy("attempt")
    rows = readings.withColumns({"__no": F.row_number().over(w), "__same": F.col("digest") == F.lag("digest").over(w)}).filter("__no <= 3")
    good = F.when(((F.col("__no") == 1) & (F.col("flagged") == 0)) | F.col("__same"), F.struct("__no", "digest"))
    ends = rows.groupBy(*by).agg(F.min(good).alias("good"), F.max(F.struct("__no", "digest")).alias("last"))
    pick = F.coalesce("good", "last")
    return ends.select(*by, pick["digest"].alias("digest"), pick["__no"].alias("attempts"), F.col("good").isNotNull().alias("agreed"))


def logical_offsets(tracks: DataFrame, by: list[str]) -> DataFrame:
    """Where each track's bytes lie in all of a disc's laid end to end."""
    w = Window.partitionBy(*by).orderBy("number").rowsBetween(Window.unboundedPreceding, 0)
    return tracks.withColumn("offset", F.sum("bytes").over(w) - F.col("bytes"))


def without_repeats(rows: DataFrame, by: list[str], order: list[str], value: str) -> DataFrame:
    """Rows that say something else than the row before them."""
    w = Window.partitionBy(*by).orderBy(*order)
    return rows.withColumn("__before", F.lag(F.struct(value)).over(w)).filter(F.col("__before").isNull() | ~F.col(f"__before.{value}").eqNullSafe(F.col(value))).drop("__before")


def ordinals(rows: DataFrame, by: list[str], kind: str, order: list[str]) -> DataFrame:
    """rows with ordinal, each one's place among those of its kind, from 0."""
    return rows.withColumn("ordinal", (F.row_number().over(Window.partitionBy(*by, kind).orderBy(*order)) - 1).cast("long"))


def never_falling(rows: DataFrame, by: list[str], order: list[str], said) -> DataFrame:
    """rows with done, the most that any row up to this one said, 0 at least, and step, how many there were."""
    w = Window.partitionBy(*by).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return rows.withColumn("__said", said).withColumns({"done": F.greatest(F.max("__said").over(w), F.lit(0)).cast("long"), "step": F.count("*").over(w)}).drop("__said")
