"""What catalogues and plans say: who an id belongs to, where numbering starts, which titles are worth reading."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import sentences
from ..functions.predicates import is_episode_length


def owner(work_id: Column) -> Column:
    """The catalogue that an id names before a colon; null if it names none."""
    return F.when(work_id.contains(":"), F.substring_index(work_id, ":", 1))


def own_id(work_id: Column, prefix: str) -> Column:
    """The id without its catalogue's name; ids without one are anybody's; null for one that is another catalogue's."""
    named = owner(work_id)
    return F.when(named.isNull(), work_id).when(named == prefix, F.regexp_replace(work_id, "^[^:]*:", ""))


def unverified(titles: DataFrame, hits: DataFrame, by: list[str]) -> DataFrame:
    """titles (by, title, season) that no row of hits (by) answers, as works of their own: a series if they have a season."""
    left = titles.join(hits.select(*by).distinct(), by, "left_anti")
    return left.select(*by, F.trim("title").alias("title"), F.when(F.col("season").isNotNull(), "series").otherwise("movie").alias("media"), "season")


def routed_episodes(asked: DataFrame, episodes: DataFrame) -> DataFrame:
    """Of episodes (source, source_rank, work_id, season, number) those of the first source that has any for each of asked
    (work_id, season), among the sources that the id belongs to: the one it names, or all if it names none."""
    met = asked.withColumn("__owner", owner(F.col("work_id"))).join(episodes, ["work_id", "season"])
    mine = met.filter(F.col("__owner").isNull() | (F.col("__owner") == F.col("source"))).drop("__owner")
    first = mine.groupBy("work_id", "season").agg(F.min("source_rank").alias("source_rank"))
    return mine.join(first, ["work_id", "season", "source_rank"], "left_semi")


def episode_offset(discs: DataFrame, present: DataFrame, by: list[str]) -> DataFrame:
    """discs (by, n, disc) with offset: the highest of present (by, number), else n for each earlier disc."""
    highest = present.groupBy(*by).agg(F.max("number").alias("__highest"))
    earlier = F.when(F.col("disc") > 1, (F.col("disc") - 1) * F.col("n")).otherwise(0)
    return discs.join(highest, by, "left").withColumn("offset", F.coalesce("__highest", earlier)).drop("__highest")


def wanted(role: Column, extras: bool, extended_cuts: bool) -> Column:
    """Whether a role is made, by what was asked for."""
    return role.isin("Episode", "Feature") | ((role == "ExtendedCut") & F.lit(extended_cuts)) | ((role == "Extra") & F.lit(extras))


def worth_reading(titles: DataFrame, by: list[str], extras: bool, extended_cuts: bool) -> DataFrame:
    """titles (by, role, duration_ms) with reads: what is wanted, and extras as long as an episode where longer cuts are
    wanted and the disc is no film's; and left_out, what to say of titles that only replay others."""
    film = F.bool_or(F.col("role") == "Feature").over(Window.partitionBy(*by))
    n = F.count_if(F.col("role") == "PlayAll").over(Window.partitionBy(*by))
    maybe_longer = F.lit(extended_cuts) & (F.col("role") == "Extra") & is_episode_length(F.col("duration_ms"))
    rows = titles.withColumns({"__film": film, "__n": n})
    reads = wanted(F.col("role"), extras, extended_cuts) | (maybe_longer & ~F.col("__film"))
    said = F.when(F.col("__n") > 0, sentences.filled(sentences.WARNINGS["PlayAllsSkipped"], n=F.col("__n")))
    return rows.withColumns({"reads": reads, "left_out": said}).drop("__film", "__n")
