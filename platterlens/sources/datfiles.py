"""Reference catalogues of dumps: XML files of games and their roms."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.strings import unescape_xml


def _system(text: Column) -> Column:
    return unescape_xml(F.regexp_extract(text, r"(?s)<header>.*?<name>(.*?)</name>", 1))


def _roms(games: DataFrame) -> DataFrame:
    """The roms of games (system, dat_pos, game_pos, body), body being what follows `<game`. A game that is cut off counts for the
    roms it has; roms without name or size go."""
    game = unescape_xml(F.regexp_extract("body", r'^[^>]*?\sname="([^"]*)"', 1))
    tags = F.regexp_extract_all("body", F.lit(r"(<rom\s[^>]*>)"), F.lit(1))
    each = games.select("system", "dat_pos", "game_pos", game.alias("game"), F.posexplode(tags).alias("rom_pos", "tag"))

    def attribute(key: str) -> Column:
        return F.nullif(F.regexp_extract("tag", rf'\s{key}="([^"]*)"', 1), F.lit(""))

    return each.select(
        "system", "dat_pos", "game_pos", "game", "rom_pos", unescape_xml(attribute("name")).alias("name"), attribute("size").try_cast("bigint").alias("size"),
        F.conv(attribute("crc"), 16, 10).cast("bigint").alias("crc32"), F.lower(attribute("sha1")).alias("sha1"),
    ).filter("name is not null and size is not null")


def roms_of(files: DataFrame) -> DataFrame:
    """(system, dat_pos, game_pos, game, rom_pos, name, size, crc32, sha1) of files (path, xml), whole texts. dat_pos follows the
    paths, of which there are as many rows as files."""
    numbered = files.select("path").distinct().withColumn("dat_pos", F.row_number().over(Window.orderBy("path")) - 1)
    games = F.slice(F.split("xml", r"<game\b"), 2, 1 << 30)
    return _roms(files.join(numbered, "path").select(_system(F.col("xml")).alias("system"), "dat_pos", F.posexplode(games).alias("game_pos", "body")))


def read_datfiles(spark: SparkSession, path: str, names: str = r"\.(dat|xml)$", parts: str | None = None) -> DataFrame:
    """The same of the files below path whose names match, of any size: a record ends where the next game begins, so a file
    is read by as many tasks as it has splits, and the text source puts together what lies across their borders. A game's
    place is its place in its split and what the splits before it hold.

    A datfile may lie in parts, whose paths give their order and of which each ends between two games: `parts` is then a pattern
    whose first group is, of a part's path, what all parts of a datfile have in common."""
    rows = spark.read.option("lineSep", "<game").option("recursiveFileLookup", "true").text(path)
    told = rows.select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("at"), F.col("value").alias("body"))
    told = told.filter(F.lower("file").rlike(names)).withColumn("path", F.regexp_extract("file", parts, 1) if parts else F.col("file"))
    if parts:
        told = told.filter(F.trim("body") != "")  # what stands before a part's first game
    splits = told.groupBy("path", "file", "block").agg(F.count("*").alias("n"), F.min("at").alias("first"))
    before = F.coalesce(F.sum("n").over(Window.partitionBy("path").orderBy("file", "block").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    shifts = splits.select("file", "block", (before - F.col("first")).alias("shift"))
    placed = told.join(shifts, ["file", "block"]).withColumn("nth", F.col("at") + F.col("shift"))
    # what stands before the first game is the file's header
    heads = placed.filter("nth = 0").select("path", _system(F.col("body")).alias("system")).withColumn("dat_pos", F.row_number().over(Window.orderBy("path")) - 1)
    return _roms(placed.filter("nth > 0").join(heads, "path").select("system", "dat_pos", (F.col("nth") - 1).alias("game_pos"), "body"))


def with_tracks(roms: DataFrame) -> DataFrame:
    """Roms with track_pos, their number among those of their game that are not cue sheets, which have none."""
    order = Window.partitionBy("dat_pos", "game_pos").orderBy("rom_pos").rowsBetween(Window.unboundedPreceding, 0)
    cue = F.lower("name").endswith(".cue")
    return roms.withColumn("track_pos", F.when(~cue, (F.count_if(~cue).over(order) - 1).cast("int")))


def tracks_of(roms: DataFrame) -> DataFrame:
    """Roms that are not cue sheets, numbered again within their game."""
    return with_tracks(roms).filter("track_pos is not null")
