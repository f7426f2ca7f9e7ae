"""Identities of discs from their tables of contents."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.bits import digit_sum
from ..functions.times import whole

#: Frames before the first track, and frames a second.
PREGAP, RATE = 150, 75


def contents(tracks: DataFrame, by: list[str]) -> DataFrame:
    """(by, toc, leadout): tracks (by, number, start, is_data, leadout) as one sorted array for each disc."""
    return tracks.groupBy(*by).agg(F.array_sort(F.collect_list(F.struct("number", "start", "is_data"))).alias("toc"), F.max("leadout").alias("leadout"))


def freedb_id(toc: Column, leadout: Column) -> Column:
    seconds = lambda x: whole(x + PREGAP, RATE)
    total = F.aggregate(toc, F.lit(0).cast("long"), lambda a, t: a + digit_sum(seconds(t.start)))
    span = F.greatest(seconds(leadout) - seconds(toc[0].start), F.lit(0))
    return F.format_string("%08x", F.shiftleft(total % 255, 24).bitwiseOR(F.shiftleft(span, 8)).bitwiseOR(F.size(toc).cast("long").bitwiseAND(F.lit(255).cast("long"))))


def musicbrainz_id(toc: Column, leadout: Column) -> Column:
    """SHA-1 over a hundred slots, the lead-out first and a track in the slot of its number, in a base64 safe for URLs."""
    word = lambda n: F.lpad(F.hex(n), 8, "0")
    slots = F.filter(toc, lambda t: t.number.between(1, 99))
    # each track after as many empty slots as its number leaves to the track before
    gap = lambda i: F.get(slots, i).number - F.coalesce(F.when(i > 0, F.get(slots, i - 1).number), F.lit(0)) - 1
    filled = F.array_join(F.transform(slots, lambda t, i: F.concat(F.repeat(F.lit("00000000"), gap(i).cast("int")), word((t.start + PREGAP).cast("long")))), "")
    ends = F.format_string("%02X%02X%08X", toc[0].number, F.element_at(toc, -1).number, leadout + PREGAP)
    digest = F.unhex(F.sha1(F.rpad(F.concat(ends, filled), 12 + 8 * 99, "0").cast("binary")))
    return F.translate(F.base64(digest), "+/=", "._-")


def fingerprint(durations: DataFrame, by: list[str], value: str, least) -> DataFrame:
    """Durations of at least `least`, sorted: what copies of one disc have in common."""
    return durations.groupBy(*by).agg(F.array_sort(F.collect_list(F.when(F.col(value) >= least, F.col(value)))).alias("fingerprint"))


def track_durations(tracks: DataFrame, by: list[str]) -> DataFrame:
    from pyspark.sql import Window

    end = F.coalesce(F.lead("start").over(Window.partitionBy(*by).orderBy("number")), F.col("leadout"))
    return tracks.withColumn("duration_ms", whole(F.greatest(end - F.col("start"), F.lit(0)) * 1000, RATE))


def role_plan(items: DataFrame, by: list[str]) -> DataFrame:
    """How many titles of each role a disc has."""
    roles = {"episodes": "Episode", "features": "Feature", "extended_cuts": "ExtendedCut", "extras": "Extra", "play_alls": "PlayAll"}
    return items.groupBy(*by).agg(*(F.count_if(F.col("role") == r).alias(n) for n, r in roles.items()))


def kind(tracks: DataFrame, by: list[str]) -> DataFrame:
    """Audio, data or enhanced (both) by what tracks a disc has, and whether it opens with data."""
    found = tracks.groupBy(*by).agg(F.bool_or(~F.col("is_data")).alias("audio"), F.bool_or("is_data").alias("data"), F.min_by("is_data", "number").alias("opens_with_data"))
    return found.select(*by, F.when(F.col("audio") & F.col("data"), "enhanced").when(F.col("audio"), "audio").otherwise("data").alias("kind"), "opens_with_data")


def outlines(tracks: DataFrame, by: list[str]) -> DataFrame:
    """(by, kind, n_audio, has_data, leadout, span) of tracks (by, number, start, is_data, leadout): whether a disc opens with data,
    how much sound it has, and its first to its last frame as readers of sound are told them."""
    found = tracks.groupBy(*by).agg(
        F.count_if(~F.col("is_data")).alias("n_audio"), F.bool_or("is_data").alias("has_data"), F.min_by("is_data", "number").alias("__opens"), F.max("leadout").alias("leadout"),
        F.min("number").alias("__first"), F.max("number").alias("__last"), F.max("start").alias("__start"),
    )
    span = F.concat(F.col("__first").cast("string"), F.lit("[.0]-"), F.col("__last").cast("string"), F.lit("[."), (F.col("leadout") - 1 - F.col("__start")).cast("string"), F.lit("]"))
    return found.select(*by, F.when(F.col("__opens"), "Data").otherwise("Audio").alias("kind"), "n_audio", "has_data", "leadout", span.alias("span"))
