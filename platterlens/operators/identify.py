"""Which work a disc holds: evidence for each candidate, and the ranking."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.strings import parse_label
from .structure import LONGEST, SHORTEST


def runtime_agreement(durations: DataFrame, runtimes: DataFrame, by: list[str]) -> DataFrame:
    """(by, near, n): how many of durations (by, duration_ms) are within half of the mean of runtimes (by, runtime_ms)."""
    mean = runtimes.filter("runtime_ms is not null").groupBy(*by).agg(F.avg("runtime_ms").alias("mean"))
    near = F.abs(F.col("duration_ms") - F.col("mean")) <= F.col("mean") * 0.5
    return durations.join(mean, by).groupBy(*by).agg(F.count_if(near).alias("near"), F.count("*").alias("n"))


def candidates(discs: DataFrame, hits: DataFrame, episodes: DataFrame) -> DataFrame:
    """Ranked candidates for each disc.

    discs (disc_id, label, durations array<bigint>); hits (title, hit_pos, media, year, score, work_id) by searched title;
    episodes (work_id, season, number, runtime_ms). Confidence is 0.6 of the search score, +0.2 for an agreeing year, +0.3
    or -0.2 for a film or series where one title is far longer than an episode, +0.15 where the episode-length titles fit
    the season, and up to 0.25 for agreeing runtimes; it is kept in [0, 1]. Ties stay in the order of the hits.
    """
    read = discs.withColumn("guess", parse_label(F.col("label")))
    inside = F.filter("durations", lambda d: d.between(SHORTEST, LONGEST))
    read = read.withColumns({"n_inside": F.size(inside), "inside": inside, "longest": F.array_max("durations")})
    film = (F.col("longest") > LONGEST) & (F.col("n_inside") < 3)
    season = F.coalesce("guess.season", F.lit(1))
    found = read.withColumns({"film": film, "season": season, "title": F.col("guess.title")}).filter("title <> ''").join(hits.withColumnRenamed("title", "__title"), F.lower("title") == F.lower("__title"))
    found = found.filter(F.col("guess.season").isNull() | (F.col("media") == "series"))
    per = episodes.groupBy("work_id", "season").agg(F.count("*").alias("n_episodes"), F.avg("runtime_ms").alias("mean"))
    joined = found.join(per, ["work_id", "season"], "left")
    near = F.size(F.filter("inside", lambda d: F.abs(d - F.col("mean")) <= 0.5 * F.col("mean")))
    is_series = (F.col("media") == "series") & (F.col("n_episodes") > 0)
    confidence = (
        0.6 * F.col("score")
        + F.when(F.col("guess.year") == F.col("year"), 0.2).otherwise(0.0)
        + F.when(F.col("film") & (F.col("media") == "movie"), 0.3).when(F.col("film"), -0.2).otherwise(0.0)
        + F.when(is_series & F.col("n_inside").between(1, F.col("n_episodes")), 0.15).otherwise(0.0)
        + F.when(is_series & (F.col("n_inside") > 0) & F.col("mean").isNotNull(), 0.25 * near / F.nullif(F.col("n_inside"), F.lit(0))).otherwise(0.0)
    )
    scored = joined.withColumn("confidence", F.round(F.least(F.greatest(confidence, F.lit(0.0)), F.lit(1.0)), 6))
    order = Window.partitionBy("disc_id").orderBy(F.col("confidence").desc(), "hit_pos")
    return scored.withColumn("rank", F.row_number().over(order)).select("disc_id", "title", "media", "year", "season", "work_id", "confidence", "rank")
