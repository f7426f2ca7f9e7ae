"""What probing tools say about files and discs: JSON probes and line-tagged logs."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.times import duration_ms, seconds_to_ms

_PROBE = (
    "struct<format:struct<duration:string>,chapters:array<struct<start_time:string,end_time:string>>,streams:array<struct<index:int,codec_type:string,codec_name:string,width:int,height:int,"
    "sample_aspect_ratio:string,r_frame_rate:string,channels:int,tags:map<string,string>,disposition:map<string,int>>>>"
)


def probes(files: DataFrame) -> DataFrame:
    """(file, duration_ms, chapters, width, height) of files (file, json)."""
    p = files.select("file", F.from_json("json", _PROBE).alias("p"))
    video = F.get(F.filter("p.streams", lambda s: s["codec_type"] == "video"), F.lit(0))
    chapters = F.transform("p.chapters", lambda c: F.greatest(seconds_to_ms(c["end_time"]) - seconds_to_ms(c["start_time"]), F.lit(0).cast("long")))
    return p.select("file", seconds_to_ms(F.col("p.format.duration")).alias("duration_ms"), F.coalesce(chapters, F.array().cast("array<bigint>")).alias("chapters"), video["width"].alias("width"), video["height"].alias("height"))


def streams(files: DataFrame) -> DataFrame:
    """(file, stream, kind, index, codec, language, title, channels, is_default, forced): index counts within a kind."""
    each = files.select("file", F.posexplode(F.from_json("json", _PROBE)["streams"]).alias("stream", "s")).filter(F.col("s.codec_type").isin("video", "audio", "subtitle"))
    order = Window.partitionBy("file", "s.codec_type").orderBy("stream")
    flag = lambda k: F.coalesce(F.col("s.disposition")[k] == 1, F.lit(False))
    return each.select(
        "file", "stream", F.col("s.codec_type").alias("kind"), (F.row_number().over(order) - 1).alias("index"), F.col("s.codec_name").alias("codec"),
        F.coalesce(F.nullif(F.col("s.tags")["language"], F.lit("")), F.lit("und")).alias("language"), F.col("s.tags")["title"].alias("title"), "s.channels", flag("default").alias("is_default"), flag("forced").alias("forced"),
    )


def commentary(title) -> F.Column:
    return F.coalesce(F.lower(title).rlike("commentary|director"), F.lit(False))


def attributes(lines: DataFrame) -> DataFrame:
    """(disc_id, title, stream, attr, value) of tagged log lines (disc_id, line_no, line); a later line overwrites.

    `TINFO:title,attr,code,"value"` tells of a title, `SINFO:title,stream,attr,code,"value"` of a stream in it.
    """
    # all that is told of a title meets in one shuffle, and the pivot of titles() needs no other
    value = F.replace(F.regexp_extract("line", r'"([^"]*+(?:""[^"]*+)*+)"\s*$', 1), F.lit('""'), F.lit('"'))
    number = lambda i: F.split_part(F.substring("line", 7, 1 << 30), F.lit(","), F.lit(i)).try_cast("int")
    rows = lines.withColumn("of", F.substring("line", 1, 6)).filter(F.col("of").isin("CINFO:", "TINFO:", "SINFO:")).withColumn("of", F.substring("of", 1, 5))
    stream = F.when(F.col("of") == "SINFO", number(2))
    attr = F.when(F.col("of") == "CINFO", number(1)).when(F.col("of") == "TINFO", number(2)).otherwise(number(3))
    said = rows.select("disc_id", "line_no", F.when(F.col("of") != "CINFO", number(1)).alias("title"), stream.alias("stream"), attr.alias("attr"), value.alias("value"))
    return said.repartition("disc_id", "title").groupBy("disc_id", "title", "stream", "attr").agg(F.max_by("value", "line_no").alias("value"))


def titles(attrs: DataFrame) -> DataFrame:
    """(disc_id, title, name, chapters, duration_ms, size, file) of attributes(): the pivot of what titles say.

    The codes of attributes are the log's own and fixed, so the pivot needs no pass to find them.
    """
    codes = {2: "name", 8: "chapters", 9: "duration", 11: "size", 27: "file"}
    wide = attrs.filter("title is not null and stream is null").groupBy("disc_id", "title").agg(*(F.max(F.when(F.col("attr") == k, F.col("value"))).alias(n) for k, n in codes.items()))
    return wide.select("disc_id", "title", "name", F.col("chapters").try_cast("int").alias("chapters"), duration_ms(F.col("duration")).alias("duration_ms"), F.col("size").try_cast("bigint").alias("size"), "file")


def drives(lines: DataFrame) -> DataFrame:
    """`DRV:` lines that name a device."""
    fields = F.from_csv(F.regexp_replace("line", "^DRV:", ""), F.lit("slot int, visible int, enabled int, flags int, drive string, label string, device string"), {"escape": '"'})
    return lines.filter("line like 'DRV:%'").select(fields.alias("d")).select("d.slot", "d.drive", "d.label", "d.device").filter("device is not null and device <> ''")


def first_error(lines: DataFrame) -> DataFrame:
    """The first message of each disc that tells of a failure."""
    text = F.regexp_extract("line", r'^MSG:[^"]*"((?:[^"]|"")*)"', 1)
    bad = lines.filter("line like 'MSG:%'").withColumn("text", text).filter(F.lower("text").rlike("fail|error|cannot|no disc"))
    return bad.groupBy("disc_id").agg(F.min_by("text", "line_no").alias("text"))


def progress(lines: DataFrame) -> DataFrame:
    """`PRGV:current,total,max` as a share of the whole."""
    part = lambda i: F.regexp_extract("line", r"^PRGV:(\d+),(\d+),(\d+)", i).try_cast("double")
    return lines.filter("line like 'PRGV:%'").withColumn("share", F.round(part(2) / F.nullif(part(3), F.lit(0.0)), 6))


def saved_titles(lines: DataFrame) -> DataFrame:
    """(disc_id, saved, failed): what the first summary of each disc's lines (disc_id, line_no, line) says: the first two numbers among
    its values, which follow the message and its form."""
    values = F.transform(F.regexp_extract_all("line", F.lit(r'("(?:[^"]|"")*"|[^,"]+)(?:,|$)'), F.lit(1)), lambda v: F.trim(v, F.lit('"')).try_cast("int"))
    numbers = F.filter(F.slice(values, 6, 1000), lambda v: v.isNotNull())
    told = lines.filter("line like 'MSG:5036,%'").withColumn("numbers", numbers).filter(F.size("numbers") >= 2)
    return told.groupBy("disc_id").agg(F.min_by("numbers", "line_no").alias("n")).select("disc_id", F.col("n")[0].alias("saved"), F.col("n")[1].alias("failed"))


def readable_titles(probes_: DataFrame, least_ms: int = 5000) -> DataFrame:
    """(title, duration_ms) of probes (title, json) that last long enough and have a picture."""
    p = probes_.select("title", F.from_json("json", _PROBE).alias("p"))
    rows = p.select("title", seconds_to_ms(F.col("p.format.duration")).alias("duration_ms"), F.exists("p.streams", lambda s: s["codec_type"] == "video").alias("__video"))
    return rows.filter(F.col("__video") & (F.col("duration_ms") >= least_ms)).drop("__video")
