"""Audio discs: which album a disc is, and what its tracks are called."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .discs import track_durations


def from_disc_text(tracks: DataFrame, album: DataFrame, titles: DataFrame) -> DataFrame:
    """Tracks (disc_id, number, start, is_data, leadout) under the names that the disc itself carries: album (disc_id,
    title, performer), titles (disc_id, number, title, performer). A gap gets its number; a performer who is the album's is
    not said again."""
    audio = track_durations(tracks, ["disc_id"]).filter("not is_data")
    named = audio.join(titles.select("disc_id", "number", F.col("title").alias("__title"), F.col("performer").alias("__performer")), ["disc_id", "number"], "left")
    named = named.join(album.select("disc_id", F.col("title").alias("album"), F.col("performer").alias("albumartist")), "disc_id", "left")
    return named.select(
        "disc_id", "number", F.coalesce("album", F.lit("")).alias("album"), F.coalesce("albumartist", F.lit("")).alias("albumartist"),
        F.coalesce("__title", F.format_string("Track %02d", "number")).alias("title"), F.when(~F.col("__performer").eqNullSafe(F.col("albumartist")), F.col("__performer")).alias("artist"), "duration_ms",
    )


def to_rip(tracks: DataFrame, albums: DataFrame, only: list[int] | None = None, also: tuple[str, ...] = ()) -> DataFrame:
    """Audio tracks of each disc with the entry of its first album (sources.catalogues.albums) and what `also` names of that
    album, perhaps only some numbers.

    Entries are as many as tracks and repeat themselves, so their shuffled bytes say little of what they hold: they are sorted
    and merged, never broadcast."""
    first = albums.groupBy("disc_id").agg(F.min_by(F.struct("title", "artist", "year", "disc", "discs", "tracks", *also), "pos").alias("a"))
    listed = first.select("disc_id", *(F.col(f"a.{c}") for c in also), F.col("a.title").alias("album"), F.col("a.artist").alias("albumartist"), F.col("a.year").alias("year"), F.col("a.disc").alias("disc"), F.col("a.discs").alias("discs"), F.explode("a.tracks").alias("t"))
    entries = listed.select("disc_id", *also, "album", "albumartist", "year", "disc", "discs", F.col("t.number").alias("number"), F.col("t.title").alias("title"), F.coalesce("t.artist", "albumartist").alias("artist"), F.col("t.length_ms").alias("length_ms"))
    audio = tracks.filter("not is_data")
    if only is not None:
        audio = audio.filter(F.col("number").isin(*only) if only else F.lit(False))
    return audio.join(entries.hint("merge"), ["disc_id", "number"])


def _totals() -> tuple[Column, Column]:
    return F.sum("length_ms"), F.bool_or(~F.col("artist").eqNullSafe(F.col("albumartist")))


def totals(entries: DataFrame) -> DataFrame:
    """Each disc's album with its length, and whether its tracks have artists of their own."""
    length, compilation = _totals()
    return entries.groupBy("disc_id", "album").agg(F.coalesce(length, F.lit(0)).alias("length_ms"), compilation.alias("is_compilation"))


def with_totals(entries: DataFrame) -> DataFrame:
    """entries with the same of their album, as album_ms and is_compilation: no join, so entries are worked out once."""
    length, compilation = _totals()
    album = Window.partitionBy("disc_id", "album")
    return entries.withColumns({"album_ms": F.coalesce(length.over(album), F.lit(0)), "is_compilation": compilation.over(album)})
