"""Subtitle files, recovery maps, index files and word lists: text in, rows out, and back."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.times import parse_timestamp, timestamp_text

#: States of a recovery map by their symbols.
STATES = {"?": "NonTried", "*": "NonTrimmed", "/": "NonScraped", "-": "Bad", "+": "Finished"}


def cues(files: DataFrame) -> DataFrame:
    """(stream_id, seq, start_ms, end_ms, text) of subtitle files (stream_id, content); blocks that are none are skipped."""
    plain = F.replace(F.regexp_replace("content", "^﻿", ""), F.lit("\r\n"), F.lit("\n"))
    blocks = files.select("stream_id", F.posexplode(F.split(plain, r"\n[ \t]*\n+")).alias("seq", "block"))
    pattern = r"(?s)^\s*(?:[0-9]+\s*\n)?\s*([0-9:.,]+)\s*-->\s*([0-9:.,]+)[^\n]*\n?(.*)$"
    part = lambda i: F.regexp_extract("block", pattern, i)
    return blocks.select("stream_id", "seq", parse_timestamp(part(1)).alias("start_ms"), parse_timestamp(part(2)).alias("end_ms"), F.regexp_replace(part(3), r"\s+$", "").alias("text")).filter("start_ms is not null and end_ms is not null")


def subtitle_text(rows: DataFrame) -> DataFrame:
    """(stream_id, content): numbered cues of rows (stream_id, seq, start_ms, end_ms, text) as files."""
    numbered = rows.withColumn("n", F.row_number().over(Window.partitionBy("stream_id").orderBy("start_ms", "seq")))
    block = F.format_string("%d\n%s --> %s\n%s\n\n", "n", timestamp_text(F.col("start_ms")), timestamp_text(F.col("end_ms")), "text")
    return numbered.groupBy("stream_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("n", block.alias("b")))), lambda x: x.b), "").alias("content"))


def map_runs(lines: DataFrame) -> DataFrame:
    """(map_id, start, end, state) of the lines of recovery maps (map_id, line): position, size and symbol."""
    pattern = r"^\s*(0x[0-9A-Fa-f]+|[0-9]+)\s+(0x[0-9A-Fa-f]+|[0-9]+)\s+([?*/+-])\s*$"
    part = lambda i: F.regexp_extract("line", pattern, i)
    number = lambda s: F.when(s.startswith("0x"), F.conv(F.substr(s, F.lit(3)), 16, 10)).otherwise(s).cast("bigint")
    names = F.create_map(*(F.lit(x) for pair in STATES.items() for x in pair))
    rows = lines.filter(F.col("line").rlike(pattern)).select("map_id", number(part(1)).alias("start"), number(part(2)).alias("size"), names[part(3)].alias("state"))
    return rows.select("map_id", "start", (F.col("start") + F.col("size")).alias("end"), "state")


def map_lines(runs: DataFrame) -> DataFrame:
    """The inverse: one line for each run, in order."""
    symbols = F.create_map(*(F.lit(x) for k, v in STATES.items() for x in (v, k)))
    return runs.select("map_id", "start", F.format_string("0x%08X  0x%08X  %s", "start", F.col("end") - F.col("start"), symbols[F.col("state")]).alias("line"))


def index_events(lines: DataFrame) -> DataFrame:
    """(stream_id, start_ms, filepos) of the lines of a subtitle index (stream_id, line)."""
    pattern = r"^timestamp:\s*([0-9]+):([0-9]+):([0-9]+):([0-9]+),\s*filepos:\s*([0-9A-Fa-f]+)"
    part = lambda i: F.regexp_extract("line", pattern, i)
    ms = part(1).cast("bigint") * 3_600_000 + part(2).cast("bigint") * 60_000 + part(3).cast("bigint") * 1000 + part(4).cast("bigint")
    return lines.filter(F.col("line").rlike(pattern)).select("stream_id", ms.alias("start_ms"), F.conv(part(5), 16, 10).cast("bigint").alias("filepos"))


def palette(lines: DataFrame) -> DataFrame:
    """(stream_id, palette): colours as numbers, 0 for what is none."""
    said = F.regexp_extract("line", r"^palette:\s*(.*)$", 1)
    colours = F.transform(F.split(said, r"\s*,\s*"), lambda c: F.when(F.trim(c).rlike("^[0-9A-Fa-f]{6}$"), F.conv(F.trim(c), 16, 10).cast("bigint")).otherwise(F.lit(0).cast("bigint")))
    return lines.filter("line like 'palette:%'").select("stream_id", colours.alias("palette"))


def words(lines: DataFrame) -> DataFrame:
    """The distinct words of word lists (line): what stands before a slash, lower case, two letters or more."""
    word = F.lower(F.trim(F.split_part("line", F.lit("/"), F.lit(1))))
    return lines.select(word.alias("word")).filter(r"word rlike '^\\p{L}{2,}$'").distinct()


def cue_sheet(spans: DataFrame) -> DataFrame:
    """(disc_id, sheet) of spans (disc_id, stem, number, is_data, pregap): a file, a track and its indexes for each span."""
    from ..functions.times import msf

    kind = F.when(F.col("is_data"), "MODE1/2352").otherwise("AUDIO")
    gap = F.when(F.col("pregap") > 0, F.concat(F.lit("    INDEX 00 00:00:00\n"), F.lit("    INDEX 01 "), msf(F.col("pregap")), F.lit("\n"))).otherwise(F.lit("    INDEX 01 00:00:00\n"))
    block = F.concat(F.format_string('FILE "%s (Track %02d).bin" BINARY\n  TRACK %02d %s\n', "stem", "number", "number", kind), gap)
    return spans.groupBy("disc_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("number", block.alias("b")))), lambda x: x.b), "").alias("sheet"))
