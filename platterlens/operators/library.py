"""What a library is made from: tracks that are kept, works that are chosen, tables that are picked, names that change."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.predicates import is_commentary
from .matching import by_preference
from .voting import joined_by

#: Codecs of subtitles that are pictures.
PICTURED = ("dvd_subtitle", "hdmv_pgs_subtitle")
#: Fixed value: how much of a disc's shapes a table must know to be used.
FITS = 0.995


def select_tracks(tracks: DataFrame, aliases: DataFrame, wanted: list[str] | None, commentary: bool = False) -> DataFrame:
    """Of tracks (group, kind, tag_pos, tag, title, codec) those to keep, with out_pos in their kind and reads, whether text is to be
    read from a subtitle's pictures. Commentaries go first, unless they are wanted or nothing else is there; then languages
    are preferred among sound, and among subtitles, of which none need be kept."""
    audio = tracks.filter("kind = 'audio'").withColumn("__comment", is_commentary(F.col("title")))
    only = F.min("__comment").over(Window.partitionBy("group"))
    kept = audio.withColumn("__only", only).filter(F.lit(commentary) | ~F.col("__comment") | F.col("__only")).drop("__comment", "__only")
    chosen = by_preference(kept, aliases, wanted).unionByName(by_preference(tracks.filter("kind = 'subtitle'"), aliases, wanted, fallback=False))
    return chosen.withColumn("reads", (F.col("kind") == "subtitle") & F.coalesce(F.col("codec").isin(*PICTURED), F.lit(False)))


def unique_streams(streams: DataFrame, by: list[str], content: str, pos: str) -> DataFrame:
    """streams without those whose content an earlier stream of their group has. Contents meet as digests."""
    keyed = streams.withColumn("__digest", F.sha2(F.col(content).cast("binary"), 256))
    first = keyed.groupBy(*by, "__digest").agg(F.min(pos).alias(f"__{pos}"))
    return joined_by(keyed, first, [*by, "__digest"]).filter(F.col(pos) == F.col(f"__{pos}")).drop("__digest", f"__{pos}")


def decide_media(asked: DataFrame, hits: DataFrame, guesses: DataFrame, by: list[str]) -> DataFrame:
    """asked (by, title, season) with the work to file under: the first of hits (by, hit_pos, work, media, hit_season) for a title
    that was given, else that title as it was typed; without one the best of guesses (the same columns); a season that was given counts
    for series."""
    best = lambda rows, name: rows.groupBy(*by).agg(F.min(F.struct("hit_pos", "work", "media", "hit_season")).alias(name))
    joined = joined_by(joined_by(asked, best(hits, "__hit"), by, "left"), best(guesses, "__guess"), by, "left")
    typed = F.struct(F.lit(0).alias("hit_pos"), F.trim("title").alias("work"), F.when(F.col("season").isNotNull(), "series").otherwise("movie").alias("media"), F.lit(None).cast("int").alias("hit_season"))
    found = F.when(F.col("title").isNotNull(), F.coalesce("__hit", typed)).otherwise(F.col("__guess"))
    rows = joined.withColumn("__found", found)
    season = F.when(F.col("__found.media") == "series", F.coalesce("season", "__found.hit_season", F.lit(1)))
    return rows.select(*by, F.col("__found.work").alias("work"), F.col("__found.media").alias("media"), season.alias("season"))


def relabelled(table: DataFrame, fixes: DataFrame) -> DataFrame:
    """table (key, text) with the text of fixes (key, fix) where there is one, and changed, whether that is another."""
    joined = table.join(fixes, "key", "left")
    text = F.coalesce("fix", "text")
    return joined.withColumn("changed", ~F.col("text").eqNullSafe(text)).withColumn("text", text).drop("fix")


def lettering(shapes: DataFrame, tables: DataFrame, least: float = FITS) -> DataFrame:
    """(disc, table, fit): for each disc of shapes (disc, language, key, n) the table of tables (table, table_pos, key) that knows most of the
    language it does worst on, if that is `least` or more, else null: then one is to be learned. The first of equals counts."""
    totals = shapes.groupBy("disc", "language").agg(F.sum("n").alias("total"))
    known = shapes.join(tables.select("table", "table_pos", "key").distinct(), "key").groupBy("disc", "language", "table", "table_pos").agg(F.sum("n").alias("known"))
    # a table that knows nothing of one of a disc's languages has no row for it
    languages = totals.groupBy("disc").agg(F.count("*").alias("languages"))
    per = known.join(totals, ["disc", "language"]).groupBy("disc", "table", "table_pos").agg(F.min(F.col("known") / F.col("total")).alias("fit"), F.count("*").alias("met"))
    full = per.join(languages, "disc").withColumn("fit", F.when(F.col("met") == F.col("languages"), F.col("fit")).otherwise(0.0))
    best = full.groupBy("disc").agg(F.max(F.struct("fit", (-F.col("table_pos")).alias("back"), "table")).alias("b"))
    all_discs = languages.select("disc").join(best, "disc", "left")
    fit = F.coalesce(F.col("b.fit"), F.lit(0.0))
    return all_discs.select("disc", F.when(fit >= least, F.col("b.table")).alias("table"), F.round(fit, 6).alias("fit"))


def table_candidates(configured: DataFrame, found: DataFrame, by: list[str]) -> DataFrame:
    """(by, path, pos): the configured table first, then those of found (by, path) that end in .json, by path; one that repeats the one
    before it goes."""
    rows = configured.select(*by, "path", F.lit(0).alias("rank")).unionByName(found.filter(F.col("path").endswith(".json")).select(*by, "path", F.lit(1).alias("rank")))
    order = Window.partitionBy(*by).orderBy("rank", "path")
    kept = rows.withColumn("__before", F.lag("path").over(order)).filter(~F.col("path").eqNullSafe(F.col("__before"))).drop("__before")
    return kept.withColumn("pos", F.row_number().over(order) - 1).drop("rank")


def dictionaries(files: DataFrame, codes: DataFrame) -> DataFrame:
    """(code, path): for each language of codes (code) the dictionaries `xx.dic` or `xx_YY.dic` of files (dir_pos, path) in the first
    directory that has any."""
    name = F.element_at(F.split("path", "/"), -1)
    named = files.withColumn("code", F.when(name.rlike(r"^[a-z]+(_[^.]*)?\.dic$"), F.regexp_extract(name, "^([a-z]+)", 1))).filter("code is not null")
    met = named.join(codes.distinct(), "code")
    first = met.groupBy("code").agg(F.min("dir_pos").alias("dir_pos"))
    return met.join(first, ["code", "dir_pos"], "left_semi").select("code", "path")


def pick_drive(drives: DataFrame, by: list[str]) -> DataFrame:
    """(by, device, problem): the one drive of drives (by, device, loaded) that holds a disc, or what stands against it."""
    found = drives.groupBy(*by).agg(F.count("*").alias("n"), F.array_sort(F.collect_list(F.when(F.col("loaded"), F.col("device")))).alias("loaded"))
    several = F.concat(F.lit("several drives hold a disc: "), F.array_join("loaded", ", "))
    return found.select(*by, F.when(F.size("loaded") == 1, F.col("loaded")[0]).alias("device"), F.when(F.size("loaded") == 0, "no drive holds a disc").when(F.size("loaded") > 1, several).alias("problem"))


def pages(output: Column, wanted: Column) -> Column:
    """A reader's pages, parted by form feeds; null if they are not as many as were asked for."""
    parts = F.split(F.regexp_replace(output, "\f$", ""), "\f")
    return F.when(F.size(parts) == wanted, F.transform(parts, F.trim))


def picture(claimed: Column, article: Column, logo: Column) -> Column:
    """The picture of a work: its own poster, else its article's, else its logo."""
    return F.coalesce(*(F.when(x != "", x) for x in (claimed, article, logo)))


def moved(files: DataFrame, by: list[str]) -> DataFrame:
    """files (by, number, path, folder, stem) with the name that each gets, and the name it has while it is written."""
    several = F.count("*").over(Window.partitionBy(*by)) > 1
    name = F.concat(F.col("stem"), F.when(several, F.format_string(" (Track %02d).bin", "number")).otherwise(".iso"))
    target = F.concat_ws("/", F.col("folder"), F.when(several, F.col("stem")), name)
    return files.withColumns({"target": target, "part": F.concat(target, F.lit(".part"))})
