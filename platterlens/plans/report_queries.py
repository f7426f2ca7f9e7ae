"""Queries that report: sentences, settings, tags, names and offsets of what other queries find."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import media, naming, sentences, strings
from ..operators import catalogues, checksums, discs, glyphs, intervals, matching, sequences, voting
from .counting_queries import _MINUTES_SQL, _writes
from .tables import DISCS_SQL, LINES_SQL, VISITS_SQL, lines, table, visits
from .tables import discs as toc_tracks

_KINDS, _STAGES = sorted(sentences.WARNINGS), sorted(sentences.STAGES)


def warning_sentences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each event as a warning of some kind, as a log prints it, and the stage it came from."""
    pick = lambda names: F.element_at(F.array(*map(F.lit, names)), (F.pmod("event_id", F.lit(len(names))) + 1).cast("int"))
    rows = table(spark, sf_dir, "events").select("event_id", pick(_KINDS).alias("kind"), pick(_STAGES).alias("stage"), F.pmod("event_id", F.lit(3)).alias("n"), "event_type", "user_id")
    fields = {"why": F.col("event_type"), "title": F.col("user_id"), "name": F.concat(F.lit("item "), F.col("user_id").cast("string")), "path": F.concat(F.lit("/cache/"), F.col("event_id").cast("string")), "language": F.lit("Swedish"), "n": F.col("n")}
    return rows.select("event_id", "kind", sentences.warning_text(F.col("kind"), **fields).alias("sentence"), sentences.stage_label(F.col("stage")).alias("stage"))


def _quoted(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def _sentence_sql(template: str) -> str:
    sql = {"why": "event_type", "title": "user_id", "name": "'item ' || user_id", "path": "'/cache/' || event_id", "language": "'Swedish'"}
    out = []
    for text, name, noun in re.findall(r"([^{]*)(?:\{([a-z]+)(?::([^}]*))?\})?", template):
        out += [_quoted(text)] if text else []
        out += [f"(n || ' {noun}' || CASE WHEN n = 1 THEN '' ELSE 's' END)" if noun else f"({sql[name]})"] if name else []
    return " || ".join(out)


_WARNINGS_SQL = f"""WITH w AS (SELECT *, event_id % 3 AS n, [{", ".join(map(_quoted, _KINDS))}][event_id % {len(_KINDS)} + 1] AS kind FROM events)
SELECT event_id, kind, CASE kind {" ".join(f"WHEN {_quoted(k)} THEN {_sentence_sql(sentences.WARNINGS[k])}" for k in _KINDS)} END AS sentence,
       [{", ".join(_quoted(sentences.STAGES[s]) for s in _STAGES)}][event_id % {len(_STAGES)} + 1] AS stage FROM w"""


def disc_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A line for each disc: what it is, how much sound it has, which library it goes to, how many bytes it is raw, and the
    span from its first to its last frame as readers of sound are told it."""
    found = discs.outlines(toc_tracks(spark, sf_dir), ["l_orderkey"])
    line = sentences.describe_disc(F.col("kind"), F.col("n_audio"), F.col("leadout"), F.col("has_data"))
    return found.select("l_orderkey", line.alias("line"), F.when(F.col("kind") == "Audio", "Music").otherwise("Games").alias("library"), "n_audio", (F.col("leadout") * media.RAW_SECTOR).alias("bytes"), "span")


def quality_tiers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Settings as words, frame rates as fractions and crops as text, read into numbers."""
    k = F.col("p_partkey")
    word = F.element_at(F.array(*map(F.lit, ("High", " low", "MED ", "best"))), (k % 4 + 1).cast("int"))
    tier = media.parse_quality(word)
    rate = F.concat(k.cast("string"), F.when(k % 5 == 4, "").otherwise(F.concat(F.lit("/"), (k % 5).cast("string"))))
    crop = F.when(k % 3 == 0, F.concat(F.lit("crop="), (700 + k % 20).cast("string"), F.lit(":464:8:8"))).when(k % 3 == 1, "crop=wide")
    size = media.cropped(crop, F.lit(720), F.lit(480))
    return table(spark, sf_dir, "part").select(
        "p_partkey", tier.alias("tier"), media.crf(tier).alias("crf"), media.vbr_level(tier).alias("vbr"), media.quality_applies(F.when(k % 2 == 0, "mp3").otherwise("flac")).alias("applies"),
        F.round(media.frame_rate(rate), 6).alias("rate"), size["width"].alias("width"), size["height"].alias("height"), F.greatest(F.col("p_size") - 25, F.lit(0)).cast("long").alias("duration"),
    )


def _glyphs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines as shapes on pictures: what kind a shape is of, how tall, where it was seen, and what a reader called it."""
    rows = lines(spark, sf_dir)
    return rows.select((F.col("l_partkey") % 500).cast("string").alias("key"), (F.col("l_partkey") % 500 % 23 + 10).alias("h"), F.col("l_orderkey").alias("cue"), F.col("pos"), F.when(F.col("l_quantity") > 3, F.when(F.col("l_partkey") % 500 % 3 != 0, F.col("l_returnflag")).otherwise(F.concat("l_returnflag", "l_linestatus"))).alias("label"))


_GLYPHS_SQL = f"""{LINES_SQL}, seen AS (SELECT CAST(l_partkey % 500 AS VARCHAR) AS key, l_partkey % 500 % 23 + 10 AS h, l_orderkey AS cue, pos,
  CASE WHEN l_quantity > 3 THEN CASE WHEN l_partkey % 500 % 3 <> 0 THEN l_returnflag ELSE l_returnflag || l_linestatus END END AS label FROM lines)"""


def glyph_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The table that observations and votes make: how often each shape was seen, where first, and what it settles as."""
    return glyphs.table_of(_glyphs(spark, sf_dir), agreement=0.3, enough=40).select("key", "seen", "first_cue", "first_pos", "votes", "text", "thin")


def glyph_heights(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labelled shapes whose height is that of the other case."""
    first = F.col("p_name").substr(1, 1)
    letter = F.when(F.col("p_partkey") % 3 == 0, F.upper(first)).otherwise(F.lower(first))
    rows = table(spark, sf_dir, "part").select("p_brand", "p_partkey", letter.alias("text"), F.when(F.col("p_partkey") % 3 == 0, F.lit(21) + F.col("p_size") % 3 - F.when(F.col("p_partkey") % 7 == 0, 6).otherwise(0)).otherwise(F.lit(15) + F.col("p_size") % 2).alias("h"), (F.col("p_partkey") % 40).alias("seen"))
    return glyphs.wrong_case(rows, ["p_brand"]).select("p_partkey", "x_height", "cap_height", "probably")


def media_tags(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is written into files: orders as items of a series or a film, customers as what they belong to."""
    k = F.col("o_orderkey")
    role = F.element_at(F.array(*map(F.lit, ("Episode", "ExtendedCut", "Feature", "Extra"))), (k % 4 + 1).cast("int"))
    show, kind, year = F.concat(F.lit("Work "), F.col("o_custkey").cast("string")), F.when(F.col("o_custkey") % 2 == 0, "series").otherwise("movie"), F.when(k % 7 > 0, F.year("o_orderdate"))
    found = naming.tags(kind, show, year, role, k % 3 + 1, k % 24, F.col("o_orderpriority"), F.when(k % 5 > 0, F.date_format("o_orderdate", "yyyy-MM-dd")))
    names = {n: n for n in ("title", "show", "season_number", "episode_sort", "episode_id", "date", "media_type")}
    return table(spark, sf_dir, "orders").select("o_orderkey", F.array_join(F.transform(naming.pairs(found, names), lambda p: F.concat_ws("=", p["name"], p.value)), "; ").alias("tags"))


def scan_health(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the lines that a reader prints say about a user's day."""
    k = F.col("event_id")
    text = F.when(k % 5 == 0, F.concat(F.lit("libdvdread: Error cracking CSS key for VTS_0"), (k % 3).cast("string"), F.lit("_1.VOB (0x1)"))).when(k % 5 == 1, "Cannot READ from device").when(k % 5 == 2, "Invalid data found").otherwise(F.col("event_type"))
    printed = visits(spark, sf_dir).select("user_id", "day", k.alias("seq"), text.alias("line"))
    found = checksums.scan_health(printed, ["user_id", "day"])
    return found.select("user_id", "day", F.size("failed").cast("long").alias("n_failed"), "read_errors", sentences.complaint(F.array_sort("failed"), F.col("read_errors")).alias("complaint"))


def rescue_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A recovery map in a sentence, whether it is done, and its first run that is still to be read."""
    runs = intervals.overwrite(_writes(spark, sf_dir), ["user_id", "day"])
    state = F.when(F.col("state").isin("click", "purchase"), "Finished").when(F.col("state") == "error", "Bad").otherwise("Untried")
    return intervals.report(runs.withColumn("state", state), ["user_id", "day"], 2_352_000)


def output_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where results go and what they are called."""
    k, name = F.col("p_partkey"), F.col("p_name")
    system = F.when(k % 3 == 0, F.col("p_type")).when(k % 3 == 1, "")
    label, serial = F.when(k % 2 == 0, F.col("p_brand")), F.when(k % 3 == 0, F.concat(F.lit("SLUS-"), k.cast("string")))
    work = F.concat(F.element_at(F.array(F.lit("tmdb:"), F.lit("tvmaze:"), F.lit("")), (k % 3 + 1).cast("int")), k.cast("string"))
    coded = strings.percent_encode(F.concat(name, F.lit(" + 100%"), F.lit("é")))
    return table(spark, sf_dir, "part").select(
        "p_partkey", strings.destination(F.lit("/out"), system, name, k % 5 == 0).alias("destination"), F.concat(strings.sanitize(name), F.lit(".iso")).alias("image"), strings.track_file(name, F.col("p_size")).alias("track"),
        strings.log_name(F.lit("2024-05-01T0930"), F.concat(F.lit("--"), F.col("p_type"), F.lit("!"))).alias("log"), strings.percent_decode(coded).alias("decoded"), media.commons_image(name).alias("picture"),
        sentences.describe_game(label, serial).alias("game"), catalogues.own_id(work, "tmdb").alias("tmdb_id"), catalogues.owner(work).alias("owner"),
    )


def datfile_matches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations with even ids divisible by 50 as dumps, against all others as entries of three datfiles: the first
    datfile that has it whole, else the entry that has most of it, the last of equals, and what to say of that."""
    body = F.when(F.col("turn") % 2 == 1, F.coalesce("role", F.lit(""))).otherwise(F.concat_ws("\n", F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))))
    parts = table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("id"), F.col("turn").alias("pos"), F.sha1(body.cast("binary")).alias("part"))
    entries = parts.select((F.col("id") % 3).alias("dat_pos"), F.col("id").alias("game_pos"), F.concat(F.lit("game "), F.col("id").cast("string")).alias("game"), "pos", "part")
    found = matching.over_datfiles(parts.filter("id % 50 = 0"), entries.withColumn("dat_pos", F.col("dat_pos").cast("int")))
    return found.select("id", "whole_dat", "whole_game", "near_game", "matched", "n", sentences.near_miss(F.col("matched"), F.col("n"), F.col("near_game"), F.col("differing")).alias("sentence"))


def pregaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How long the pause before a track is: by the first sector that the disc files under it."""
    k = F.col("event_id")
    rows = visits(spark, sf_dir).select("user_id", "day", (F.dense_rank().over(Window.partitionBy("user_id", "day").orderBy("event_type"))).alias("track"), F.col("ms").alias("lba"), k.alias("seq"), (k % 2).alias("index"), (k % 150).alias("countdown"))
    return intervals.pregaps(rows, ["user_id", "day"]).select("user_id", "day", F.col("track").cast("long").alias("track"), "pregap")


def episode_offsets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The number of the episode before a disc's first: the highest already there, else as many as earlier discs would hold."""
    k = F.col("o_orderkey")
    orders = table(spark, sf_dir, "orders")
    discs = orders.groupBy("o_custkey").agg(F.count("*").alias("n"), F.max(F.when(k % 3 == 0, k % 4)).alias("disc"))
    present = orders.filter(F.col("o_custkey") % 3 == 0).filter("o_orderstatus = 'O'").select("o_custkey", (k % 30).alias("number"))
    return catalogues.episode_offset(discs, present, ["o_custkey"]).select("o_custkey", "offset")


def frame_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last count of frames that an encoder's rewritten lines tell, for each user's day."""
    k = F.col("event_id")
    part = F.when(k % 7 == 0, "speed=1x").otherwise(F.concat(F.lit(" frame=  "), k.cast("string"), F.lit(" fps=24")))
    order = F.array_sort(F.collect_list(F.struct("ms", "event_id", part.alias("part"))))
    printed = visits(spark, sf_dir).groupBy("user_id", "day").agg(F.array_join(F.transform(order, lambda x: x.part), "\r").alias("output"))
    return printed.select("user_id", "day", media.last_frame(F.col("output")).alias("frames"))


def fill_colours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which of four colours is a letter's own: the brightest that is not clear."""
    k = F.col("p_partkey")
    alpha = F.array(*((k / F.lit(1 << i)).cast("long") % 2 for i in range(4)))
    colours = F.array(*(F.struct(((k * (i + 3)) % 4 * 60).alias("r"), ((k * (i + 5)) % 3 * 90).alias("g"), ((k * (i + 7)) % 2 * 200).alias("b")) for i in range(4)))
    return table(spark, sf_dir, "part").select("p_partkey", media.fill_index(alpha, colours).cast("long").alias("fill"))


def titles_to_rip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as titles of their customer's disc, each with the role that a plan gives it: those worth reading, and what
    the plan says it leaves out."""
    k = F.col("o_orderkey")
    role = F.element_at(F.array(*map(F.lit, ("Episode", "Extra", "PlayAll", "ExtendedCut", "Extra", "Episode"))), (k % 6 + 1).cast("int"))
    rows = table(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", F.when((k % 6 == 5) & (F.col("o_custkey") % 5 == 0), "Feature").otherwise(role).alias("role"), (F.col("o_totalprice") * 10).cast("long").alias("duration_ms"))
    return catalogues.worth_reading(rows, ["o_custkey"], extras=False, extended_cuts=True).select("o_custkey", "o_orderkey", "role", "reads", "left_out")


def plan_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What each customer's disc holds in a line, and whether that is nothing."""
    role = F.when(F.col("o_orderstatus") == "F", "Feature").when(F.col("o_orderstatus") == "O", "Episode").otherwise("PlayAll")
    roles = ("Episode", "Feature", "ExtendedCut", "Extra")
    counted = table(spark, sf_dir, "orders").select("o_custkey", role.alias("role")).groupBy("o_custkey").agg(*(F.count_if(F.col("role") == r).alias(r) for r in roles), F.count_if(F.col("role") == "PlayAll").alias("play_alls"))
    said = naming.plan_lines(*(F.col(r) for r in roles), F.col("play_alls"))
    return counted.select("o_custkey", F.array_join(said, ". ").alias("lines"), (F.array_max(F.array(*roles)) == 0).alias("holds_nothing"))


def chain_sectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sectors that a chain of cells takes, each counted once, shifted to where its set of titles begins."""
    rows = visits(spark, sf_dir)
    minute = F.floor(F.col("ms") / 60_000).cast("long") + F.col("user_id") % 7
    cells = rows.select("user_id", "day", minute.alias("start"), (minute + F.col("event_id") % 50).alias("end"))
    merged = intervals.union(cells, ["user_id", "day"])
    return merged.groupBy("user_id", "day").agg(F.sum(F.col("end") - F.col("start")).alias("sectors"), F.min("start").alias("first"))


def languages_offered(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each source's languages as they are offered: preferred ones first and ticked, the others in the order of the disc."""
    docs = table(spark, sf_dir, "documents").filter("lang is not null and source is not null")
    tags = docs.groupBy(F.col("source").alias("group"), F.col("lang").alias("tag")).agg(F.min("doc_id").alias("tag_pos"))
    from ..functions import languages

    offered = matching.preselect(tags, languages.aliases(spark), languages.parse_preference("fr, en") or [])
    return offered.select(F.col("group").alias("source"), "tag", F.col("out_pos").cast("long").alias("out_pos"), "ticked")


def all_languages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of each conversation the roles of its even turns as they come, then those of odd turns only: as a disc's languages,
    sound first and then what is in subtitles alone."""
    rows = table(spark, sf_dir, "conversations").select("conv_id", F.col("turn").alias("pos"), F.coalesce("role", F.lit("")).alias("tag"), (F.col("turn") % 2).alias("kind"))
    return voting.listed_tags(rows, ["conv_id"]).select("conv_id", F.array_join("tags", ",").alias("tags"))


def track_ordinals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every track's place among those of its kind."""
    rows = lines(spark, sf_dir).withColumn("kind", F.when(F.col("l_returnflag") == "R", "video").when(F.col("l_linestatus") == "O", "audio").otherwise("subtitle"))
    return sequences.ordinals(rows, ["l_orderkey"], "kind", ["pos"]).select("l_orderkey", "pos", "kind", "ordinal")


def progress(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How far a user's day has come at each event, in thousandths that never fall, whatever late events say."""
    said = F.floor(F.col("ms") % 86_400_000 / 86_400) - F.col("event_id") % 400
    return sequences.never_falling(visits(spark, sf_dir), ["user_id", "day"], ["ms", "event_id"], said).select("event_id", "done", "step")


def read_offsets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations as discs whose turns are tracks: the sound after the first track, moved by 13 samples, and what of it
    had to be silence. A disc is one value; discs are as many keys."""
    shift = 13 * media.SAMPLE
    tracks = table(spark, sf_dir, "conversations").filter("turn > 0").select("conv_id", "turn", F.coalesce("role", F.lit("")).alias("role"), F.hex(F.coalesce("text", F.lit("")).cast("binary")).alias("bytes"))
    runs = tracks.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "role", "bytes"))).alias("t")).withColumn("run", F.array_join(F.transform("t", lambda x: x.bytes), ""))
    sizes = F.transform("t", lambda x: (F.length(x.bytes) / 2).cast("long"))
    placed = runs.withColumn("sizes", sizes).select("conv_id", "run", F.posexplode("sizes").alias("i", "size"), "sizes", F.transform("t", lambda x: x.turn).alias("turns"))
    at = F.aggregate(F.slice("sizes", F.lit(1), F.col("i")), F.lit(0).cast("long"), lambda a, x: a + x)
    found = placed.withColumn("at", at).withColumn("total", (F.length("run") / 2).cast("long"))
    body = media.shifted(F.col("run"), F.col("at"), F.col("size"), shift)
    return found.select("conv_id", F.element_at("turns", F.col("i") + 1).alias("turn"), F.sha1(F.unhex(body)).alias("sha1"), media.silent(F.col("at"), F.col("size"), F.col("total"), shift).alias("silent"))


def dump_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bytes of a dump, of what is corrupt in it, and whether all of it is sound."""
    rows = lines(spark, sf_dir).select("l_orderkey", (F.col("l_quantity") * media.RAW_SECTOR).cast("long").alias("bytes"), F.when(F.col("l_returnflag") == "R", F.col("pos")).otherwise(0).alias("corrupt"))
    return checksums.dump_totals(rows, ["l_orderkey"])


def resolved_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of conversations as a face draws them that has one bar for l and I, read again with the words of the benchmark.
    Letters stand close: in a word of five, ten or more letters every gap is a pixel under the threshold of a blank."""
    said = table(spark, sf_dir, "conversations").select("conv_id", "turn", F.posexplode(F.split("text", "\n")).alias("n", "body")).filter("trim(body) <> ''")
    words = said.select(F.struct("conv_id", "turn", "n").alias("line"), F.posexplode(F.filter(F.split("body", " "), lambda w: w != "")).alias("pos", "word"))
    chars = F.filter(F.split("word", ""), lambda c: c != "")
    slots = F.transform(chars, lambda c: F.when(c.isin("l", "I"), F.array(F.lit("l"), F.lit("I"))).otherwise(F.array(c)))
    gaps = F.transform(F.slice(chars, 2, F.greatest(F.size(chars) - 1, F.lit(0))), lambda c: F.struct(F.when(F.length("word") % 5 == 0, 9).otherwise(3).alias("gap"), F.lit(10).alias("threshold")))
    lists = table(spark, sf_dir, "benchmark").select(F.explode(F.split("text", r"\W+")).alias("line"))
    found = glyphs.resolve_lines(words.select("line", "pos", slots.alias("slots"), gaps.alias("gaps")), lists)
    return found.select("line.conv_id", "line.turn", F.col("line.n").cast("long").alias("line"), "text")


QUERIES = {
    "resolved_lines": (resolved_lines, None),
    "warning_sentences": (warning_sentences, _WARNINGS_SQL),
    "disc_lines": (
        disc_lines,
        f"""WITH {DISCS_SQL}, d AS (SELECT l_orderkey, count(*) FILTER (WHERE NOT is_data) AS n, bool_or(is_data) AS mixed, arg_min(is_data, number) AS opens, max(leadout) AS leadout, min(number) AS f, max(number) AS l, max(start) AS s FROM tracks GROUP BY 1)
        SELECT l_orderkey, CASE WHEN NOT opens THEN 'audio CD, ' || n || ' tracks, ' || leadout // 4500 || ' min' || CASE WHEN mixed THEN ', with data track' ELSE '' END
          WHEN n > 0 THEN 'data disc, ' || n || ' audio track(s) beside it' ELSE 'data disc' END AS line, CASE WHEN opens THEN 'Games' ELSE 'Music' END AS library, n AS n_audio, leadout * 2352 AS bytes,
          f || '[.0]-' || l || '[.' || (leadout - 1 - s) || ']' AS span FROM d""",
    ),
    "quality_tiers": (
        quality_tiers,
        """WITH q AS (SELECT p_partkey AS k, p_size, [CAST('high' AS VARCHAR), 'low', 'medium', NULL][p_partkey % 4 + 1] AS tier FROM part)
        SELECT k AS p_partkey, tier, CASE tier WHEN 'high' THEN 18 WHEN 'medium' THEN 20 WHEN 'low' THEN 23 END AS crf, CASE tier WHEN 'high' THEN 0 WHEN 'medium' THEN 2 WHEN 'low' THEN 5 END AS vbr, k % 2 = 0 AS applies,
          round(CASE k % 5 WHEN 0 THEN 0 WHEN 4 THEN k ELSE k / (k % 5) END, 6) AS rate, CASE WHEN k % 3 = 0 THEN 700 + k % 20 ELSE 720 END AS width, CASE WHEN k % 3 = 0 THEN 464 ELSE 480 END AS height, CAST(greatest(p_size - 25, 0) AS BIGINT) AS duration FROM q""",
    ),
    "glyph_table": (
        glyph_table,
        f"""WITH {_GLYPHS_SQL}, v AS (SELECT key, label, count(*) AS n FROM seen WHERE label IS NOT NULL GROUP BY 1, 2), r AS (
          SELECT *, row_number() OVER (PARTITION BY key ORDER BY n DESC, label) AS place, sum(n) OVER (PARTITION BY key) AS total FROM v), two AS (
          SELECT key, CAST(any_value(total) AS BIGINT) AS total, max(label) FILTER (WHERE place = 1) AS top, max(n) FILTER (WHERE place = 1) AS top_n, max(label) FILTER (WHERE place = 2) AS second, max(n) FILTER (WHERE place = 2) AS second_n FROM r GROUP BY key), s AS (
          SELECT key, total, CASE WHEN top_n / total >= 0.3 THEN top WHEN (top_n + second_n) / total >= 0.7 AND second_n >= 8 AND second_n / total >= 0.05 THEN top || '|' || second END AS text FROM two), o AS (
          SELECT key, count(*) AS seen, min(cue) AS first_cue, arg_min(pos, struct_pack(c := cue, p := pos)) AS first_pos FROM seen GROUP BY key)
        SELECT key, seen, first_cue, first_pos, coalesce(total, 0) AS votes, text, coalesce(total, 0) < 40 AS thin FROM o LEFT JOIN s USING (key)""",
    ),
    "glyph_heights": (
        glyph_heights,
        """WITH g AS (SELECT p_brand, p_partkey, p_partkey % 40 AS seen, CASE WHEN p_partkey % 3 = 0 THEN upper(substring(p_name, 1, 1)) ELSE lower(substring(p_name, 1, 1)) END AS t,
            CASE WHEN p_partkey % 3 = 0 THEN 21 + p_size % 3 - CASE WHEN p_partkey % 7 = 0 THEN 6 ELSE 0 END ELSE 15 + p_size % 2 END AS h FROM part), c AS (
          SELECT *, CASE WHEN contains('acemnorsuvwxz', t) THEN 'x' WHEN contains('ACEMNORSUVWXZ', t) THEN 'cap' END AS class FROM g), m AS (
          SELECT p_brand, list_sort(list(h) FILTER (WHERE class = 'x')) AS xs, list_sort(list(h) FILTER (WHERE class = 'cap')) AS cs FROM c GROUP BY 1), k AS (SELECT p_brand, xs[len(xs) // 2 + 1] AS xh, cs[len(cs) // 2 + 1] AS ch FROM m)
        SELECT p_partkey, xh AS x_height, ch AS cap_height, CASE WHEN class = 'cap' THEN lower(t) ELSE upper(t) END AS probably FROM c JOIN k USING (p_brand)
        WHERE xh > 0 AND ch > xh AND seen >= 10 AND ((class = 'cap' AND h <= xh + 1) OR (class = 'x' AND h >= ch - 1))""",
    ),
    "media_tags": (
        media_tags,
        """WITH i AS (SELECT o_orderkey AS k, ['Episode', 'ExtendedCut', 'Feature', 'Extra'][o_orderkey % 4 + 1] AS role, o_orderpriority AS t, CASE WHEN o_orderkey % 5 > 0 THEN strftime(o_orderdate, '%Y-%m-%d') END AS aired,
            o_custkey % 2 = 0 AS series, 'Work ' || o_custkey AS work, CASE WHEN o_orderkey % 7 > 0 THEN year(o_orderdate) END AS y FROM orders), x AS (
          SELECT *, series AND role IN ('Episode', 'ExtendedCut') AS numbered, CASE WHEN role = 'ExtendedCut' THEN t || ' (Extended Cut)' ELSE t END AS shown FROM i)
        SELECT k AS o_orderkey, concat_ws('; ', 'title=' || CASE WHEN numbered THEN shown WHEN NOT series THEN work ELSE t END, CASE WHEN series THEN 'show=' || work END, CASE WHEN numbered THEN 'season_number=' || (k % 3 + 1) END,
          CASE WHEN numbered THEN 'episode_sort=' || k % 24 END, CASE WHEN numbered THEN 'episode_id=' || shown END, 'date=' || CASE WHEN numbered THEN aired WHEN NOT series THEN CAST(y AS VARCHAR) END,
          CASE WHEN numbered THEN 'media_type=10' WHEN NOT series THEN 'media_type=9' END) AS tags FROM x""",
    ),
    "scan_health": (
        scan_health,
        f"""WITH {VISITS_SQL}, p AS (SELECT user_id, day, event_id % 5 AS k, 'VTS_0' || event_id % 3 || '_1.VOB' AS file FROM visits), h AS (
          SELECT user_id, day, coalesce(list_sort(list(DISTINCT file) FILTER (WHERE k = 0)), []) AS failed, count(*) FILTER (WHERE k = 1) AS read_errors FROM p GROUP BY 1, 2)
        SELECT user_id, day, len(failed) AS n_failed, read_errors, concat_ws('; ', CASE WHEN len(failed) > 0 THEN 'libdvdcss could not decrypt ' || CASE WHEN len(failed) = 1 THEN 'a part' ELSE 'parts' END || ' of the disc (' || array_to_string(failed, ', ') ||
          ') - titles in those parts are missing from this scan' END, CASE WHEN read_errors > 0 THEN read_errors || ' unreadable sectors' END) AS complaint FROM h""",
    ),
    "rescue_report": (
        rescue_report,
        f"""WITH {_MINUTES_SQL}, s AS (SELECT user_id, day, m, CASE WHEN state IN ('click', 'purchase') THEN 'Finished' WHEN state = 'error' THEN 'Bad' ELSE 'Untried' END AS state FROM minutes), t AS (
          SELECT user_id, day, count(*) FILTER (WHERE state = 'Finished') AS got, count(*) FILTER (WHERE state = 'Bad') AS bad, count(*) FILTER (WHERE state = 'Untried') AS untried, min(m) FILTER (WHERE state = 'Untried') AS first_start FROM s GROUP BY 1, 2)
        SELECT user_id, day, format('{{:.2f}} GB recovered, {{:.2f}} GB left, {{}} bad sectors', got * 2352000 / 1e9, untried * 2352000 / 1e9, bad) AS summary, untried = 0 AS done, first_start FROM t""",
    ),
    "output_names": (
        output_names,
        """WITH n AS (SELECT *, p_partkey AS k, regexp_replace(trim(regexp_replace(p_name, ' +', ' ', 'g')), '\\.+$', '') AS clean FROM part)
        SELECT p_partkey, '/out/' || CASE WHEN k % 3 = 0 THEN p_type ELSE 'Unidentified' END || '/' || CASE WHEN k % 5 = 0 THEN clean || '/' ELSE '' END || clean AS destination, clean || '.iso' AS image,
          p_name || format(' (Track {:02d}).bin', p_size) AS track, '2024-05-01T0930-' || trim(regexp_replace(p_type || '!', '[^A-Za-z0-9_-]', '-', 'g'), '-') || '.log' AS log, p_name || ' + 100%é' AS decoded,
          'https://commons.wikimedia.org/wiki/Special:FilePath/' || url_encode(p_name) || '?width=342' AS picture,
          CASE WHEN k % 2 = 0 AND k % 3 = 0 THEN p_brand || ' (SLUS-' || k || ')' WHEN k % 2 = 0 THEN p_brand WHEN k % 3 = 0 THEN 'SLUS-' || k ELSE 'unnamed disc' END AS game,
          CASE WHEN k % 3 <> 1 THEN CAST(k AS VARCHAR) END AS tmdb_id, CASE k % 3 WHEN 0 THEN 'tmdb' WHEN 1 THEN 'tvmaze' END AS owner FROM n""",
    ),
    "datfile_matches": (
        datfile_matches,
        """WITH p AS (SELECT conv_id AS id, turn AS pos, sha1(CASE WHEN turn % 2 = 1 THEN coalesce(role, '') ELSE coalesce(role, '') || chr(10) || coalesce(text, '') END) AS part, count(*) OVER (PARTITION BY conv_id) AS n FROM conversations),
        w AS (SELECT id, any_value(n) AS n, string_agg(pos || ':' || part, ',' ORDER BY pos, part) AS whole FROM p GROUP BY id),
        hit AS (SELECT a.id, arg_min(b.id, struct_pack(d := b.id % 3, i := b.id)) AS game FROM w a JOIN w b ON a.whole = b.whole AND a.id <> b.id WHERE a.id % 50 = 0 GROUP BY a.id),
        met AS (SELECT a.id, a.n, b.id AS other, count(*) AS matched, list(a.pos) AS same FROM p a JOIN p b ON a.n = b.n AND a.pos = b.pos AND a.part = b.part AND a.id <> b.id WHERE a.id % 50 = 0 GROUP BY 1, 2, 3),
        near AS (SELECT * FROM met QUALIFY row_number() OVER (PARTITION BY id ORDER BY matched DESC, other % 3 DESC, other DESC) = 1),
        said AS (SELECT id, 'game ' || other AS near_game, matched, n, list_sort(list_filter(range(0, n), lambda i: NOT list_contains(same, i))) AS diff FROM near)
        SELECT a.id, CAST(h.game % 3 AS INT) AS whole_dat, 'game ' || h.game AS whole_game, near_game, matched, s.n,
          matched || ' of ' || s.n || ' tracks match ' || near_game || '.' || chr(10) || 'Track' || CASE WHEN len(diff) = 1 THEN '' ELSE 's' END || ' ' || array_to_string(list_transform(diff, lambda i: i + 1), ', ') || ' do not, so this is that disc rather than one nobody has catalogued.' AS sentence
        FROM w a LEFT JOIN hit h ON h.id = a.id LEFT JOIN said s ON s.id = a.id WHERE a.id % 50 = 0""",
    ),
    "pregaps": (
        pregaps,
        f"""WITH {VISITS_SQL}, r AS (SELECT user_id, day, dense_rank() OVER (PARTITION BY user_id, day ORDER BY event_type) AS track, ms, event_id FROM visits), f AS (
          SELECT user_id, day, track, arg_min(event_id, struct_pack(m := ms, e := event_id)) AS e FROM r GROUP BY ALL) SELECT user_id, day, track, CASE WHEN e % 2 <> 0 THEN 0 ELSE e % 150 + 1 END AS pregap FROM f""",
    ),
    "episode_offsets": (
        episode_offsets,
        """WITH d AS (SELECT o_custkey, count(*) AS n, max(CASE WHEN o_orderkey % 3 = 0 THEN o_orderkey % 4 END) AS disc, max(o_orderkey % 30) FILTER (WHERE o_custkey % 3 = 0 AND o_orderstatus = 'O') AS present FROM orders GROUP BY 1)
        SELECT o_custkey, coalesce(present, CASE WHEN disc > 1 THEN (disc - 1) * n ELSE 0 END) AS "offset" FROM d""",
    ),
    "frame_counts": (frame_counts, f"WITH {VISITS_SQL} SELECT user_id, day, arg_max(event_id, struct_pack(m := ms, e := event_id)) FILTER (WHERE event_id % 7 <> 0) AS frames FROM visits GROUP BY 1, 2"),
    "fill_colours": (
        fill_colours,
        """WITH c AS (SELECT p_partkey AS k, unnest(range(0, 4)) AS i FROM part), l AS (SELECT k, i, (k * (i + 3)) % 4 * 60 * 299 + (k * (i + 5)) % 3 * 90 * 587 + (k * (i + 7)) % 2 * 200 * 114 AS light FROM c WHERE (k >> i) % 2 <> 0)
        SELECT p_partkey, (SELECT arg_max(i, struct_pack(l := light, b := -i)) FROM l WHERE l.k = p.p_partkey) AS fill FROM part p""",
    ),
    "titles_to_rip": (
        titles_to_rip,
        """WITH r AS (SELECT o_custkey, o_orderkey, CASE WHEN o_orderkey % 6 = 5 AND o_custkey % 5 = 0 THEN 'Feature' ELSE ['Episode', 'Extra', 'PlayAll', 'ExtendedCut', 'Extra', 'Episode'][o_orderkey % 6 + 1] END AS role, CAST(trunc(o_totalprice * 10) AS BIGINT) AS ms FROM orders), f AS (
          SELECT *, bool_or(role = 'Feature') OVER (PARTITION BY o_custkey) AS film, count(*) FILTER (WHERE role = 'PlayAll') OVER (PARTITION BY o_custkey) AS n FROM r)
        SELECT o_custkey, o_orderkey, role, role IN ('Episode', 'Feature', 'ExtendedCut') OR (role = 'Extra' AND NOT film AND ms BETWEEN 900000 AND 2700000) AS reads,
          CASE WHEN n > 0 THEN 'skipping ' || n || CASE WHEN n = 1 THEN ' play-all title' ELSE ' play-all titles' END || ', whose content is on the disc already' END AS left_out FROM f""",
    ),
    "plan_lines": (
        plan_lines,
        """WITH c AS (SELECT o_custkey, count(*) FILTER (WHERE o_orderstatus = 'O') AS e, count(*) FILTER (WHERE o_orderstatus = 'F') AS f, count(*) FILTER (WHERE o_orderstatus NOT IN ('O', 'F')) AS p FROM orders GROUP BY 1), h AS (
          SELECT *, nullif(concat_ws(', ', CASE WHEN e > 0 THEN e || CASE WHEN e = 1 THEN ' episode' ELSE ' episodes' END END, CASE WHEN f > 0 THEN f || CASE WHEN f = 1 THEN ' feature' ELSE ' features' END END), '') AS h FROM c)
        SELECT o_custkey, concat_ws('. ', 'holds ' || h, CASE WHEN p > 0 THEN 'skipping ' || p || CASE WHEN p = 1 THEN ' play-all title' ELSE ' play-all titles' END || ' - the same video again' END) AS lines, h IS NULL AS holds_nothing FROM h""",
    ),
    "chain_sectors": (
        chain_sectors,
        f"""WITH {VISITS_SQL}, c AS (SELECT user_id, day, ms // 60000 + user_id % 7 AS s, event_id % 50 AS n FROM visits), m AS (SELECT DISTINCT user_id, day, unnest(range(s, s + n)) AS m FROM c)
        SELECT user_id, day, count(*) AS sectors, min(m) AS first FROM m GROUP BY 1, 2""",
    ),
    "languages_offered": (
        languages_offered,
        """WITH seen AS (SELECT source, lang AS tag, min(doc_id) AS tag_pos, CASE lang WHEN 'fr' THEN 1 WHEN 'en' THEN 2 END AS place FROM documents WHERE lang IS NOT NULL AND source IS NOT NULL GROUP BY 1, 2)
        SELECT source, tag, row_number() OVER (PARTITION BY source ORDER BY place NULLS LAST, tag_pos) AS out_pos, place IS NOT NULL AS ticked FROM seen""",
    ),
    "all_languages": (
        all_languages,
        """WITH b AS (SELECT conv_id, coalesce(role, '') AS tag, min(struct_pack(k := turn % 2, t := turn)) AS p FROM conversations GROUP BY 1, 2) SELECT conv_id, string_agg(tag, ',' ORDER BY p, tag) AS tags FROM b GROUP BY 1""",
    ),
    "track_ordinals": (
        track_ordinals,
        f"""WITH {LINES_SQL}, k AS (SELECT l_orderkey, pos, CASE WHEN l_returnflag = 'R' THEN 'video' WHEN l_linestatus = 'O' THEN 'audio' ELSE 'subtitle' END AS kind FROM lines)
        SELECT l_orderkey, pos, kind, row_number() OVER (PARTITION BY l_orderkey, kind ORDER BY pos) - 1 AS ordinal FROM k""",
    ),
    "progress": (
        progress,
        f"""WITH {VISITS_SQL} SELECT event_id, CAST(greatest(max((ms % 86400000) // 86400 - event_id % 400) OVER w, 0) AS BIGINT) AS done, count(*) OVER w AS step FROM visits
        WINDOW w AS (PARTITION BY user_id, day ORDER BY ms, event_id ROWS UNBOUNDED PRECEDING)""",
    ),
    "read_offsets": (
        read_offsets,
        """WITH t AS (SELECT conv_id, turn, coalesce(role, '') AS role, hex(encode(coalesce(text, ''))) AS b FROM conversations WHERE turn > 0), p AS (
          SELECT conv_id, turn, b, coalesce(sum(length(b) // 2) OVER (PARTITION BY conv_id ORDER BY turn, role, b ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS start, string_agg(b, '') OVER (PARTITION BY conv_id ORDER BY turn, role, b ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS run FROM t), s AS (
          SELECT conv_id, turn, CAST(start AS BIGINT) AS start, length(b) // 2 AS size, length(run) // 2 AS total, run FROM p), c AS (
          SELECT *, substring(run, 2 * (start + 52) + 1, 2 * size) AS held FROM s)
        SELECT conv_id, turn, sha1(unhex(held || repeat('00', size - length(held) // 2))) AS sha1, size - length(held) // 2 AS silent FROM c""",
    ),
    "dump_totals": (
        dump_totals,
        f"""WITH {LINES_SQL}, d AS (SELECT l_orderkey, CAST(l_quantity * 2352 AS BIGINT) AS bytes, CASE WHEN l_returnflag = 'R' THEN pos ELSE 0 END AS corrupt FROM lines)
        SELECT l_orderkey, CAST(sum(bytes) AS BIGINT) AS bytes, CAST(sum(corrupt) AS BIGINT) AS corrupt, bool_and(corrupt = 0) AS sound, count(*) FILTER (WHERE corrupt > 0) AS bad_tracks FROM d GROUP BY 1""",
    ),
}
