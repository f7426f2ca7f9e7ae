"""Lettering: shapes of subtitle glyphs, what they are read as, where words end, and how good the result is.

Shapes arrive as rows (stream_id, event_id, line_no, glyph_pos, x, w, h, key); their texts come from a table of labels that
votes.settle or a reader made. Lines are short, so windows are partitioned by (event, line).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .voting import coverage, index_quantile, otsu

LINE = ["stream_id", "event_id", "line_no"]
#: Instances a space's width is judged from at least; votes after which a shape counts as tried; share that makes a table fit.
LEAST_GAPS, TRIED, FIT = 50, 24, 0.995


def gaps(glyphs: DataFrame) -> DataFrame:
    """glyphs with gap, the empty columns before each shape, and before, the key of the shape to its left."""
    w = Window.partitionBy(*LINE).orderBy("glyph_pos")
    return glyphs.withColumns({"gap": F.col("x") - F.lag(F.col("x") + F.col("w")).over(w), "before": F.lag("key").over(w)})


def space_gap(glyphs: DataFrame, fallback: int) -> DataFrame:
    """(stream_id, space_gap): the width from which a gap is a space, by the split of the stream's gaps, clipped at their
    98th hundredth and kept between a tenth and 55 hundredths of the middle line height."""
    found = gaps(glyphs).filter("gap >= 0").select("stream_id", F.col("gap").cast("long").alias("gap"))
    clip = index_quantile(found, ["stream_id"], "gap", 98, 100).select("stream_id", F.greatest("gap", F.lit(4).cast("long")).alias("clip"), "n")
    split = otsu(found.join(clip, "stream_id").select("stream_id", F.least("gap", "clip").alias("gap")), ["stream_id"], "gap").select("stream_id", "threshold")
    heights = glyphs.groupBy(*LINE).agg(F.max("h").alias("height"))
    middle = index_quantile(heights, ["stream_id"], "height", 1, 2).select("stream_id", F.greatest("height", F.lit(1)).alias("height"))
    low = F.greatest(F.round(F.col("height") * 0.1), F.lit(2.0)).cast("long")
    high = F.greatest(F.round(F.col("height") * 0.55).cast("long"), low)
    joined = middle.join(split, "stream_id", "left").join(clip, "stream_id", "left")
    fit = F.least(F.greatest(F.coalesce("threshold", F.lit(fallback).cast("long")), low), high)
    return joined.select("stream_id", F.when(F.coalesce("n", F.lit(0)) >= LEAST_GAPS, fit).otherwise(F.lit(fallback).cast("long")).alias("space_gap"))


def read_lines(glyphs: DataFrame, labels: DataFrame, spaces: DataFrame, placeholder: str = "□") -> DataFrame:
    """(stream_id, event_id, line_no, text, n_unknown) by labels (key, text, gap?) and spaces (stream_id, space_gap).

    A gap is a space from the left shape's own width on, or the stream's. A class such as `l|I` reads as its first label;
    what context would make of it is the resolver's business. Shapes without label become the placeholder.
    """
    own = labels.select(F.col("key").alias("before"), F.col("gap").alias("own_gap"))
    rows = gaps(glyphs).join(own, "before", "left").join(labels.select("key", "text"), "key", "left").join(spaces, "stream_id", "left")
    letter = F.coalesce(F.split_part("text", F.lit("|"), F.lit(1)), F.lit(placeholder))
    spaced = F.when(F.col("gap") >= F.coalesce("own_gap", "space_gap"), F.concat(F.lit(" "), letter)).otherwise(letter)
    order = F.array_sort(F.collect_list(F.struct("glyph_pos", spaced.alias("s"))))
    return rows.groupBy(*LINE).agg(F.trim(F.array_join(F.transform(order, lambda p: p.s), "")).alias("text"), F.count_if(F.col("text").isNull()).alias("n_unknown"))


def cue_texts(lines: DataFrame) -> DataFrame:
    """(stream_id, event_id, text, n_unknown): the lines that say something, in order."""
    order = F.array_sort(F.collect_list(F.when(F.col("text") != "", F.struct("line_no", "text"))))
    return lines.groupBy("stream_id", "event_id").agg(F.array_join(F.transform(order, lambda p: p.text), "\n").alias("text"), F.sum("n_unknown").alias("n_unknown"))


def votes_from(glyphs: DataFrame, texts: DataFrame) -> DataFrame:
    """(stream_id, event_id, key, label, before, gap, spaced): what each shape is where an event's text (stream_id, event_id,
    text) has as many lines as its shapes and each line as many letters; events that don't fit give none at all."""
    cue = texts.select("stream_id", "event_id", F.posexplode(F.split("text", "\n")).alias("line_no", "said"))
    lettered = cue.withColumn("letters", F.filter(F.split("said", ""), lambda c: ~c.rlike(r"^\s*$")))
    # a letter is spaced if white space stands between it and the letter before
    starts = F.transform(F.filter(F.split(F.trim("said"), r"\s+"), lambda w: w != ""), lambda w: F.length(w))
    ends = F.transform(F.sequence(F.lit(1), F.greatest(F.size(starts), F.lit(1))), lambda k: F.aggregate(F.slice(starts, F.lit(1), k), F.lit(0), lambda a, x: a + x))
    lettered = lettered.withColumn("ends", ends)
    counted = glyphs.groupBy(*LINE).agg(F.count("*").alias("n"))
    sides = counted.join(lettered.select(*LINE, F.size("letters").alias("m")), LINE, "full")
    fits = sides.groupBy("stream_id", "event_id").agg(F.bool_and(F.coalesce(F.col("n") == F.col("m"), F.lit(False))).alias("fits")).filter("fits").drop("fits")
    place = F.row_number().over(Window.partitionBy(*LINE).orderBy("glyph_pos"))
    rows = gaps(glyphs).withColumn("at", place).join(fits, ["stream_id", "event_id"], "left_semi").join(lettered, LINE)
    return rows.select("stream_id", "event_id", "key", F.get("letters", F.col("at") - 1).alias("label"), "before", "gap", F.array_contains("ends", F.col("at") - 1).alias("spaced"))


def learned_gaps(votes: DataFrame) -> DataFrame:
    """(key, gap): midway between the upper quarter of a shape's gaps without a space and the lower quarter of those with
    one, for shapes that have six of either and keep them apart."""
    seen = votes.filter("before is not null").select(F.col("before").alias("key"), F.col("gap").cast("long").alias("gap"), "spaced")
    no = index_quantile(seen.filter("not spaced"), ["key"], "gap", 3, 4).select("key", F.col("gap").alias("low"), F.col("n").alias("n_low"))
    yes = index_quantile(seen.filter("spaced"), ["key"], "gap", 1, 4).select("key", F.col("gap").alias("high"), F.col("n").alias("n_high"))
    apart = no.join(yes, "key").filter("n_low >= 6 and n_high >= 6 and high > low")
    return apart.select("key", F.floor((F.col("low") + F.col("high") + 1) / 2).alias("gap"))


def closest_table(shapes: DataFrame, tables: DataFrame, languages: list[str] | None = None) -> DataFrame:
    """(table_pos, worst): of tables (table_pos, key, text?, votes) the one whose worst covered language of shapes
    (language, key, n) is best, the FIRST of equals; fits tells whether it may be used as it is."""
    known = tables.filter(F.col("text").isNotNull() | (F.col("votes") >= TRIED)).select("table_pos", "key").distinct()
    wanted = shapes if languages is None else shapes.filter(F.col("language").isin(*languages))
    totals = wanted.groupBy("language").agg(F.sum("n").alias("total")).filter("total > 0")
    totals = totals.withColumn("__languages", F.count("*").over(Window.partitionBy(F.lit(0))))  # a row for each language
    covered = wanted.join(known, "key").groupBy("table_pos", "language").agg(F.sum("n").alias("covered")).join(totals, "language")
    shares = covered.groupBy("table_pos").agg((F.count("*") == F.max("__languages")).alias("__all"), F.min(F.col("covered") / F.col("total")).alias("__least"))
    # a table that knows nothing of some language covers none of it
    least = F.when(F.col("__all"), F.col("__least")).otherwise(F.lit(0.0))
    worst = tables.select("table_pos").distinct().join(shares, "table_pos", "left").select("table_pos", least.alias("worst"))
    return worst.withColumn("fits", F.col("worst") >= FIT).orderBy(F.col("worst").desc(), "table_pos").limit(1)


def verify(produced: DataFrame, reference: DataFrame) -> DataFrame:
    """(stream_id, cues, matched, exact, off_grid, chars, differing) of produced cues against reference ones, both
    (stream_id, seq, start_ms, text), by start; of reference cues with one start the last counts."""
    last = reference.groupBy("stream_id", "start_ms").agg(F.max_by("text", "seq").alias("__want"))
    both = produced.join(last.withColumn("__met", F.lit(True)), ["stream_id", "start_ms"], "left")
    longest = F.greatest(F.length("text"), F.length("__want"))
    same = F.size(F.filter(F.zip_with(F.filter(F.split("text", ""), lambda c: c != ""), F.filter(F.split("__want", ""), lambda c: c != ""), lambda a, b: a == b), lambda x: F.coalesce(x, F.lit(False))))
    met = F.coalesce("__met", F.lit(False))
    return both.groupBy("stream_id").agg(
        F.count("*").alias("cues"), F.count_if(met).alias("matched"), F.count_if(met & (F.col("text") == F.col("__want"))).alias("exact"), F.count_if(~met).alias("off_grid"),
        F.coalesce(F.sum(F.when(met, longest)), F.lit(0)).alias("chars"), F.coalesce(F.sum(F.when(met, longest - same)), F.lit(0)).alias("differing"),
    )


__all__ = ["closest_table", "coverage", "cue_texts", "gaps", "learned_gaps", "read_lines", "space_gap", "verify", "votes_from"]


def extents(glyphs: DataFrame, labels: DataFrame) -> DataFrame:
    """(stream_id, event_id, line_no, left, top, right, bottom, height, labelled, unlabelled): what each line of glyphs, with y, spans,
    its last column and row included, and how many of its shapes labels (key, text) know."""
    known = labels.select("key", F.col("text").isNotNull().alias("__known"))
    rows = glyphs.join(known, "key", "left").withColumn("__known", F.coalesce("__known", F.lit(False)))
    found = rows.groupBy(*LINE).agg(
        F.min("x").alias("left"), F.min("y").alias("top"), (F.max(F.col("x") + F.col("w")) - 1).alias("right"), (F.max(F.col("y") + F.col("h")) - 1).alias("bottom"),
        F.count_if("__known").alias("labelled"), F.count_if(~F.col("__known")).alias("unlabelled"),
    )
    return found.withColumn("height", F.col("bottom") - F.col("top") + 1)
