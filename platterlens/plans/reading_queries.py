"""Queries of readings and works: lettering read and checked, tables that fit, candidates ranked, structures named, predicates."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import arrays, bits, carriers, naming, predicates, strings, times
from ..operators import catalogues, discs, glyphs, identify, intervals, matching, music, recognition, sequences, structure, voting
from ..shared import kept
from ..sources import texts
from .tables import DISCS_SQL, LINES_SQL, VISITS_SQL, lines, table, visits
from .tables import discs as disc_tracks

#: The shapes of a cue: an order's lines of one status are a line of text, each a letter; wide gaps stand before some.
_SHAPES_SQL = f"""{LINES_SQL}, shapes AS (
  SELECT l_orderkey AS e, CASE WHEN l_linestatus = 'O' THEN 1 ELSE 0 END AS n, pos AS g, l_partkey % 26 AS key, CASE WHEN l_quantity > 30 THEN 7 ELSE 2 END AS left_gap, chr(CAST(97 + l_partkey % 26 AS INTEGER)) AS letter FROM lines
), seen AS (SELECT *, lag(key) OVER w AS before, CASE WHEN lag(key) OVER w IS NOT NULL THEN left_gap END AS gap, row_number() OVER w AS at FROM shapes WINDOW w AS (PARTITION BY e, n ORDER BY g)
), labelled AS (SELECT *, CASE WHEN key <> 7 THEN letter END AS text, CASE WHEN gap >= CASE WHEN before % 5 = 0 THEN 9 ELSE 5 END THEN ' ' ELSE '' END AS space FROM seen
), said AS (SELECT e, n, string_agg(space || coalesce(text, '□'), '' ORDER BY g) AS text, count(*) FILTER (WHERE text IS NULL) AS n_unknown FROM labelled GROUP BY e, n
), cues AS (SELECT e, string_agg(text, chr(10) ORDER BY n) AS text, sum(n_unknown) AS n_unknown FROM said GROUP BY e)"""


#: A time as subtitle files write it.
_STAMP = "printf('%02d:%02d:%02d,%03d', {x} // 3600000, {x} // 60000 % 60, {x} // 1000 % 60, {x} % 1000)"


def _shapes(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = lines(spark, sf_dir).select(F.lit(1).alias("stream_id"), F.col("l_orderkey").alias("event_id"), F.when(F.col("l_linestatus") == "O", 1).otherwise(0).alias("line_no"), F.col("pos").alias("glyph_pos"), (F.col("l_partkey") % 26).alias("key"), F.when(F.col("l_quantity") > 30, 7).otherwise(2).alias("left"))
    order = Window.partitionBy(*recognition.LINE).orderBy("glyph_pos")
    return rows.withColumns({"x": F.sum(F.col("left") + 8).over(order.rowsBetween(Window.unboundedPreceding, 0)) - 8, "w": F.lit(8), "h": F.lit(20)}).drop("left")


def _labels(spark: SparkSession) -> DataFrame:
    k = F.col("id")
    return spark.range(26).filter("id <> 7").select(k.alias("key"), F.when(k % 4 == 1, F.concat(F.char(k + 97), F.lit("|"), F.char(k + 65))).otherwise(F.char(k + 97)).alias("text"), F.when(k % 5 == 0, 9).alias("gap"))


def _read(spark: SparkSession, sf_dir: str) -> DataFrame:
    spaces = spark.range(1).select(F.lit(1).alias("stream_id"), F.lit(5).alias("space_gap"))
    return recognition.cue_texts(recognition.read_lines(_shapes(spark, sf_dir), _labels(spark), spaces))


def read_cues(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Shapes of orders read with a table that lacks one letter."""
    found = _read(spark, sf_dir)
    return found.select("event_id", "text", "n_unknown", predicates.is_usable(F.lit(10), F.col("n_unknown")).alias("usable"))


def recognised_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Shapes to files: each customer's orders as the cues of a stream, read, timed and written as a subtitle file, and read back."""
    o = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("event_id"), F.col("o_custkey").cast("string").alias("stream_id"))
    cues = _read(spark, sf_dir).drop("stream_id").join(o, "event_id")
    timed = cues.select("stream_id", F.col("event_id").alias("seq"), (F.col("event_id") * 2000).alias("start_ms"), (F.col("event_id") * 2000 + 1500).alias("end_ms"), "text")
    files = texts.subtitle_text(timed)
    back = texts.cues(files).groupBy("stream_id").agg(F.count("*").alias("cues"), F.max("end_ms").alias("last_ms"))
    return files.join(back, "stream_id").select("stream_id", F.sha1(F.col("content").cast("binary")).alias("sha1"), F.length("content").cast("long").alias("chars"), "cues", "last_ms")


def taught_votes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What shapes are voted to be by texts, of which every fifth has a letter too many and teaches nothing; and the gaps that
    letters keep, where they keep any."""
    read = _read(spark, sf_dir).filter("n_unknown = 0")
    told = read.select("stream_id", "event_id", F.when(F.col("event_id") % 5 == 0, F.concat("text", F.lit("z"))).otherwise(F.col("text")).alias("text"))
    votes = kept(recognition.votes_from(_shapes(spark, sf_dir), told), "votes")  # counts and two quantiles read them
    gaps = recognition.learned_gaps(votes)
    counts = votes.groupBy("key").agg(F.count("*").alias("votes"), F.countDistinct("label").alias("labels"), F.count_if("spaced").alias("spaced"))
    return counts.join(gaps, "key", "left").select("key", "votes", "labels", "spaced", F.col("gap").cast("long").alias("gap"))


def verified_cues(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cues of users' days against a reference that says another word here and there."""
    rows = visits(spark, sf_dir).select(F.concat_ws("-", "user_id", "day").alias("stream_id"), F.col("event_id").alias("seq"), F.floor(F.col("ms") / 60_000).alias("start_ms"), F.col("event_type").alias("text"), "event_id")
    produced = rows.filter("event_id % 7 > 0").drop("event_id")
    reference = rows.filter("event_id % 3 > 0").withColumn("text", F.when(F.col("event_id") % 4 == 0, F.concat(F.lit("c"), "text")).otherwise(F.col("text"))).drop("event_id")
    return recognition.verify(produced, reference)


def fitting_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Brands as tables of shapes, statuses as languages: which table knows most of the one it does worst on."""
    shapes = lines(spark, sf_dir).select(F.col("l_linestatus").alias("language"), (F.col("l_partkey") % 300).alias("key")).groupBy("language", "key").agg(F.count("*").alias("n"))
    p = F.col("p_partkey")
    tables = table(spark, sf_dir, "part").select(F.substring("p_brand", 7, 2).cast("int").alias("table_pos"), (p % 300).alias("key"), F.when(p % 3 > 0, "x").alias("text"), (p % 40).alias("votes"))
    return recognition.closest_table(shapes, tables).select(F.col("table_pos").cast("long").alias("table_pos"), F.round("worst", 6).alias("worst"), "fits")


def space_widths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """From which width on a gap is a space, for each kind of order as a stream; a stream with few gaps gets the usual."""
    shapes = _shapes(spark, sf_dir).drop("stream_id")
    o = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("event_id"), F.when(F.col("o_orderkey") < 40, "few").otherwise("many").alias("stream_id"))
    found = recognition.space_gap(shapes.join(o, "event_id"), 4)
    return found.select("stream_id", "space_gap")


def ranked_works(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers as discs whose label names a work, orders as what a search of that name found, with episodes for some."""
    k = F.col("c_custkey")
    label = F.concat(F.lit("TITLE_Q"), F.translate(k.cast("string"), "0123456789", "GHKLNPQRTV"), F.when(k % 3 == 0, F.concat(F.lit("_S"), (k % 5 + 1).cast("string"), F.lit("D1"))).when(k % 7 == 1, F.concat(F.lit("_"), (k % 8 + 1992).cast("string"))).otherwise(""))
    of = table(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.collect_list((F.col("o_totalprice") * 20).cast("long")).alias("durations"))
    asked = table(spark, sf_dir, "customer").join(of, k == F.col("o_custkey")).select(k.alias("disc_id"), label.alias("label"), "durations")
    n = F.col("o_orderkey")
    hits = table(spark, sf_dir, "orders").filter("o_orderkey % 10 = 0").select(
        F.concat(F.lit("title q"), F.lower(F.translate(F.col("o_custkey").cast("string"), "0123456789", "GHKLNPQRTV")), F.when(n % 30 == 10, F.concat(F.lit(" "), F.year("o_orderdate").cast("string"))).otherwise("")).alias("title"), F.col("o_orderkey").alias("hit_pos"), F.when(n % 20 == 0, "series").otherwise("movie").alias("media"), F.year("o_orderdate").alias("year"), (n % 90 / 90).alias("score"), F.concat(F.lit("w:"), n.cast("string")).alias("work_id"),
    )
    episodes = lines(spark, sf_dir).filter("l_orderkey % 20 = 0").select(F.concat(F.lit("w:"), F.col("l_orderkey").cast("string")).alias("work_id"), (F.col("l_suppkey") % 5 + 1).cast("int").alias("season"), F.col("pos").alias("number"), (F.col("l_quantity") * 60_000).cast("long").alias("runtime_ms"))
    found = identify.candidates(asked, hits, episodes)
    return found.select("disc_id", "title", "media", F.col("year").cast("long").alias("year"), F.col("season").cast("long").alias("season"), "work_id", F.round("confidence", 4).alias("confidence"), F.col("rank").cast("long").alias("rank"))


_FRAMES_SQL = """m AS (SELECT p_brand, p_partkey AS k, md5(CAST(p_partkey % 200 AS VARCHAR)) AS m FROM part), f AS (
  SELECT p_brand, k, xor(CAST('0x' || substring(m, 1, 15) AS BIGINT), 1::BIGINT << (k % 59)) AS hi, xor(CAST('0x' || substring(m, 16, 15) AS BIGINT), 1::BIGINT << (k % 53)) AS lo FROM m), h AS (
  SELECT DISTINCT a.p_brand AS a, b.p_brand AS b, a.k FROM f a JOIN f b ON a.p_brand <> b.p_brand AND bit_count(xor(a.hi, b.hi)) + bit_count(xor(a.lo, b.lo)) <= 8), n AS (SELECT p_brand, count(*) AS n FROM f GROUP BY 1)"""


def extended_cuts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Brands as titles with frames: odd ones are episodes, and even ones may be longer cuts of those."""
    k = F.col("p_partkey")
    half = lambda i: F.conv(F.substring(F.md5((k % 200).cast("string").cast("binary")), i, 15), 16, 10).cast("long")
    flip = lambda c, bit: c.bitwiseXOR(F.call_function("shiftleft", F.lit(1).cast("long"), bit.cast("int")))
    frames = table(spark, sf_dir, "part").select(F.col("p_brand").alias("title"), k.alias("frame_pos"), flip(half(1), k % 59).alias("hi"), flip(half(16), k % 53).alias("lo"))
    number = F.substring("p_brand", 7, 2).cast("int")
    brands = table(spark, sf_dir, "part").select("p_brand").distinct().select(F.col("p_brand").alias("key"), number.alias("episode_pos"))
    found = matching.extended_cuts(frames, brands.filter("episode_pos % 2 = 0").select("key"), brands.filter("episode_pos % 2 = 1"), 0.05)
    return found.select("key", "episode", F.round("share", 6).alias("share"))


def assigned_titles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines as titles whose part is known: numbered, named and called what they are."""
    role = F.element_at(F.array(*map(F.lit, ("episode", "play_all", "loose", "extra"))), (F.col("l_partkey") % 4 + 1).cast("int"))
    rows = lines(spark, sf_dir).select(F.col("l_orderkey").alias("disc_id"), F.format_string("t%02d.mkv", "pos").alias("key"), role.alias("role"), (F.col("pos") - 1).cast("int").alias("out_pos"))
    names = table(spark, sf_dir, "region").select((F.col("r_regionkey") + 1).cast("int").alias("number"), F.col("r_name").alias("name"))
    found = structure.assign(rows, names, 4, 2)
    media, season = F.when(F.col("disc_id") % 2 == 0, "series").otherwise("movie"), F.col("season")
    name = naming.file_name(media, F.lit("Show: A"), F.lit(1999), F.col("role"), season, F.col("number"), F.col("title"), "mkv")
    return found.select(
        "disc_id", "key", "role", F.col("season").cast("long").alias("season"), F.col("number").cast("long").alias("number"), "title", naming.wanted(F.col("role"), extras=False).alias("wanted"), naming.destination("/out", media, F.lit(4), F.col("role"), season, name).alias("destination"),
        naming.described(F.lit("Show"), F.when(F.col("disc_id") % 3 > 0, F.lit(1999)), season).alias("told"),
    )


def disc_text_tracks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as discs that carry names of some of their tracks, and where those go."""
    tracks = disc_tracks(spark, sf_dir).withColumnRenamed("l_orderkey", "disc_id")
    album = table(spark, sf_dir, "orders").filter("o_orderkey % 5 > 0").select(F.col("o_orderkey").alias("disc_id"), F.concat(F.lit("Album "), F.col("o_orderkey").cast("string")).alias("title"), F.col("o_orderstatus").alias("performer"))
    titles = lines(spark, sf_dir).filter("l_partkey % 3 > 0").select(F.col("l_orderkey").alias("disc_id"), F.col("pos").alias("number"), F.concat(F.lit("T/"), F.col("l_partkey").cast("string")).alias("title"), F.col("l_linestatus").alias("performer"))
    found = music.from_disc_text(tracks, album, titles)
    path = naming.track_path("/m", F.col("albumartist"), F.col("artist"), F.col("album"), F.lit(1999), F.lit(1), F.when(F.col("disc_id") % 2 == 0, 2).otherwise(1), F.col("number"), F.col("title"), "flac")
    detail = strings.music_detail(F.lit(1999), F.lit("SE"), F.col("albumartist"), F.lit(1), F.when(F.col("disc_id") % 2 == 0, 2).otherwise(1))
    return found.select("disc_id", "number", "album", "albumartist", "title", "artist", "duration_ms", path.alias("path"), detail.alias("detail"))


def routed_works(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which catalogue's episodes count for each work, by its name and by who has any; works that nobody answers follow."""
    o, k = table(spark, sf_dir, "orders"), F.col("o_orderkey")
    work = F.concat(F.when(k % 3 == 0, "tmdb:").when(k % 3 == 1, "tvmaze:").otherwise(""), k.cast("string"))
    asked = o.select(work.alias("work_id"), (F.col("o_custkey") % 2).alias("season"))
    found = lines(spark, sf_dir).join(o, F.col("l_orderkey") == k)
    rank = F.col("l_partkey") % 2
    episodes = found.select(F.when(rank == 0, "tvmaze").otherwise("tmdb").alias("source"), rank.alias("source_rank"), work.alias("work_id"), (F.col("o_custkey") % 2).alias("season"), F.col("pos").alias("number"))
    routed = catalogues.routed_episodes(asked, episodes).groupBy("work_id").agg(F.min("source").alias("source"), F.count("*").alias("n"))
    left = catalogues.unverified(asked.select("work_id", F.concat(F.lit(" "), "work_id", F.lit(" ")).alias("title"), F.when(F.col("season") == 1, F.col("season")).alias("season")), routed, ["work_id"])
    return routed.select("work_id", "source", "n").unionByName(left.select("work_id", F.concat_ws("/", "title", "media").alias("source"), F.lit(0).cast("long").alias("n")))


def track_bytes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lengths of tracks, and where their bytes lie in all of a disc's."""
    rows = discs.track_durations(disc_tracks(spark, sf_dir), ["l_orderkey"]).withColumn("bytes", F.col("duration_ms") * 3)
    return sequences.logical_offsets(rows, ["l_orderkey"]).select("l_orderkey", "number", "duration_ms", "offset")


def untried_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first run of each map that has not been tried, and how many more there are."""
    state = F.when(F.col("l_returnflag") == "R", "Bad").otherwise("NonTried")
    runs = lines(spark, sf_dir).select("l_orderkey", (F.col("pos") * 10).alias("start"), (F.col("pos") * 10 + F.col("l_quantity").cast("long")).alias("end"), state.alias("state"))
    every, first = intervals.in_state(runs, "NonTried", ["l_orderkey"])
    return first.join(every.groupBy("l_orderkey").agg(F.count("*").alias("n")), "l_orderkey").select("l_orderkey", "start", "end", "n")


def part_predicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is asked of titles, tracks, dumps and pictures, asked of parts."""
    k, size = F.col("p_partkey"), F.col("p_size").cast("long")
    sector = F.when(k % 3 == 0, F.unhex(F.lit("00FFFFFFFFFFFFFFFFFFFF0000020001"))).otherwise(F.col("p_name").cast("binary"))
    kind = predicates.disc_kind(k % 7 == 0, k % 5 == 0, k % 3 == 0, k % 2 == 0)
    crop = F.when(k % 4 == 0, "none").otherwise(F.concat(F.lit("crop="), (720 - size % 6).cast("string"), F.lit(":"), (576 - k % 3).cast("string"), F.lit(":0:0")))
    names = F.array(F.lit("a.bin"), F.when(k % 2 == 0, "b.CUE").otherwise("b.bin"))
    short = predicates.shortfall(k % 3, k % 2, F.when(k % 5 == 0, size).otherwise(0), F.lit(900))
    told = {
        "episodic": predicates.is_episode_length(size * 60_000), "bitmap": predicates.is_bitmap_subtitle(F.when(k % 2 == 0, "subtitle").otherwise("audio"), F.when(k % 3 == 0, "dvd_subtitle").otherwise("subrip")),
        "trusted": predicates.is_trustworthy(F.when(k % 4 == 0, F.array(F.lit("x"))).otherwise(F.array().cast("array<string>")), k % 3), "complete": predicates.is_complete(k % 2, k % 3, k % 5), "usable": predicates.is_usable(size, k % 30),
        "multi": predicates.is_multi_track(names), "crops": predicates.crop_is_worthwhile(crop, F.lit(720), F.lit(576)), "data": predicates.looks_like_data(sector), "kind": kind, "short": short, "folder": naming.subdirectory(F.when(k % 2 == 0, "Extra").otherwise("Episode")),
        "telecined": bits.looks_telecined(F.lit(1000), 700 + size * 2), "plausible": strings.plausible(F.when(k % 2 == 0, "A b").otherwise("q|")),
    }
    return table(spark, sf_dir, "part").select("p_partkey", *(c.alias(n) for n, c in told.items()))


def part_numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Numbers in the forms that discs and pictures tell them in, of parts."""
    k, size = F.col("p_partkey"), F.col("p_size").cast("long")
    byte = F.shiftleft(F.floor(size % 100 / 10).cast("int"), 4).bitwiseOR((size % 10).cast("int"))
    square = bits.square_size(F.lit(720), F.lit(576), 10 + size % 3, F.lit(11))
    pick = lambda values, n: F.element_at(F.array(*map(F.lit, values)), (k % n + 1).cast("int"))
    rows = table(spark, sf_dir, "part").select("p_partkey", "p_name", "p_size", pick((0, 118, 64, 8, 16, 5), 6).alias("num"), pick((1, 100, 45, 9, 11, 7), 6).alias("den"), pick((23.98, 25.0, 29.97, 12.5), 4).alias("fps"))
    return rows.select(
        "p_partkey", bits.from_bcd(byte).cast("long").alias("bcd"), bits.big_endian(F.substring(F.col("p_name").cast("binary"), 1, 4)).alias("big"), bits.snap_ratio(F.col("num"), F.col("den")).alias("ratio"),
        bits.frame_rate(F.col("fps")).alias("rate"), square["width"].alias("wide"), times.dcsq_ms(size).alias("delay"),
    )


def part_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Serials, short names, paths and chapters of parts."""
    k, size = F.col("p_partkey"), F.col("p_size").cast("long")
    boot = F.concat(F.lit("VER = 1\nBOOT2 = cdrom0:\\SLUS_"), F.lpad((k % 1000).cast("string"), 3, "0"), F.lit(".99;1\n"))
    chapters = F.array(size * 1000, k * 10, F.when(k % 2 == 0, 1500).otherwise(2500).cast("long"))
    other = F.transform(chapters, lambda c: c + k % 120)
    return table(spark, sf_dir, "part").select(
        "p_partkey", strings.serial(boot).alias("serial"), strings.short_name(F.concat("p_name", F.lit(" (Europe) (Disc 1)"))).alias("short"), arrays.chapters_match(chapters, other).alias("match"), F.size(arrays.without_sliver(chapters)).cast("long").alias("n_chapters"),
        strings.unescape_octal(F.concat(F.lit("/m/a\\040b"), k.cast("string"))).alias("plain"),
    )


def part_carriers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What carriers, files and drives say of themselves, said of parts."""
    k, size = F.col("p_partkey"), F.col("p_size").cast("long")
    head = F.concat(F.unhex(F.lit("00" * 15)), F.unhex(F.lpad(F.hex(k % 4), 2, "0")))
    mode, carrier = carriers.data_mode(head), carriers.medium(k % 80)
    volume = F.concat(F.when(k % 2 == 0, F.unhex(F.lit("014344303031"))).otherwise(F.unhex(F.lit("024344303031"))), F.rpad(F.col("p_name").cast("binary"), 66, F.lit(b" ")))
    ebml = F.when(k % 3 == 0, F.unhex(F.lit("1A45DFA301"))).otherwise(F.col("p_name").cast("binary"))
    kind = F.when(k % 5 == 0, "Audio").when(k % 5 == 1, "Empty").when(k % 5 == 2, "Dvd")
    label = F.when(k % 2 == 0, F.upper("p_name"))
    expected = carriers.expected_file(F.when(k % 7 > 0, size * 1000))
    word = F.element_at(F.array(*map(F.lit, (" Video", "AUDIO", "Subtitles", "subtitle", "data"))), (k % 5 + 1).cast("int"))
    log = F.concat(F.lit("frame=  1 fps\rframe= "), k.cast("string"), F.lit(" q=1"))
    return table(spark, sf_dir, "part").select(
        "p_partkey", carriers.cue_name(mode).alias("mode"), carrier.alias("medium"), carriers.raw_sector(carrier).cast("long").alias("sector"), carriers.is_volume_descriptor(volume).alias("volume"), carriers.is_matroska(ebml).alias("matroska"),
        carriers.size_problem(k, expected, F.lit(25_000).cast("long")).alias("problem"), carriers.stream_kind(word).alias("stream"), carriers.has_disc(kind, label).alias("loaded"), carriers.disc_told(kind, F.lit("a disc"), label).alias("told"),
        carriers.is_output(F.when(k % 4 == 0, "PlayAll").otherwise("Extra")).alias("output"), F.round(carriers.decoded_rate(F.when(k % 2 == 0, log).otherwise("none"), log), 4).alias("rate"), carriers.release_url(F.concat("p_name", F.lit(" & ~*")), 5).alias("url"),
        carriers.images_url(F.array(F.col("p_brand"), F.col("p_name"))).alias("pictures"),
    )


def line_extents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What lines of shapes span, and how many of their shapes a table knows."""
    shapes = _shapes(spark, sf_dir).withColumn("y", (F.col("key") % 4).cast("long"))
    return recognition.extents(shapes, _labels(spark)).select("event_id", F.col("line_no").cast("long").alias("line_no"), *(F.col(c).cast("long").alias(c) for c in ("left", "top", "right", "bottom", "height")), "labelled", "unlabelled")


def learned_lettering(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines as the shapes of orders' cues, a stream for each priority: read in three batches of six while shapes are thin."""
    o = table(spark, sf_dir, "orders").select("o_orderkey", F.col("o_orderpriority").alias("stream"))
    found = lines(spark, sf_dir).join(o, F.col("l_orderkey") == F.col("o_orderkey")).select("stream", F.col("l_orderkey").alias("cue"), "pos", (F.col("l_partkey") % 9).alias("key"))
    shapes = kept(found, "shapes")  # every round reads them, and so do the answers
    label = F.char(F.when((F.col("cue") + F.col("pos")) % 7 == 0, 120).otherwise(F.col("key") + 97))
    answers = shapes.filter("cue % 5 > 0 or pos > 1").select("stream", "cue", "pos", label.alias("label"))
    votes, read = glyphs.learned(shapes, answers, 8, 18, 6)
    settled = voting.settle(votes.select(F.concat_ws("/", "stream", F.col("key").cast("string")).alias("key"), "label", "n"), agreement=0.6)
    return settled.select("key", "text", F.col("total").cast("long").alias("votes")).unionByName(read.select(F.concat_ws("#", "stream", F.col("cue").cast("string")).alias("key"), F.lit("read").alias("text"), F.col("batch_no").cast("long").alias("votes")))


def _learned_sql() -> str:
    """The three rounds one after the other, each from the votes of those before."""
    rounds = "v0 AS (SELECT stream, key, label, 1 AS n FROM told WHERE false), r0 AS (SELECT stream, cue, 0 AS no FROM shapes WHERE false)"
    for k in range(3):
        rounds += f""", a{k} AS (SELECT DISTINCT stream, cue FROM shapes s WHERE NOT EXISTS (SELECT 1 FROM (SELECT stream, key FROM v{k} GROUP BY ALL HAVING sum(n) >= 8) v WHERE v.stream = s.stream AND v.key = s.key)
            AND NOT EXISTS (SELECT 1 FROM r{k} r WHERE r.stream = s.stream AND r.cue >= s.cue)), p{k} AS (SELECT stream, cue FROM a{k} QUALIFY row_number() OVER (PARTITION BY stream ORDER BY cue) <= 6),
          v{k + 1} AS (SELECT * FROM v{k} UNION ALL SELECT stream, key, label, 1 FROM told SEMI JOIN p{k} USING (stream, cue)), r{k + 1} AS (SELECT * FROM r{k} UNION ALL SELECT stream, cue, {k} FROM p{k})"""
    return f"""WITH {LINES_SQL}, shapes AS (SELECT o_orderpriority AS stream, l_orderkey AS cue, pos, l_partkey % 9 AS key FROM lines JOIN orders ON o_orderkey = l_orderkey),
      told AS (SELECT *, CASE WHEN (cue + pos) % 7 = 0 THEN 'x' ELSE chr(CAST(97 + key AS INT)) END AS label FROM shapes WHERE cue % 5 > 0), {rounds},
      sums AS (SELECT stream, key, label, count(*) AS n FROM v3 GROUP BY ALL), ranked AS (SELECT *, sum(n) OVER w AS total, row_number() OVER (w ORDER BY n DESC, label) AS nth FROM sums WINDOW w AS (PARTITION BY stream, key)),
      best AS (SELECT stream, key, any_value(total) AS total, max(label) FILTER (WHERE nth = 1) AS a, max(n) FILTER (WHERE nth = 1) AS na, max(label) FILTER (WHERE nth = 2) AS b, max(n) FILTER (WHERE nth = 2) AS nb FROM ranked GROUP BY ALL)
    SELECT stream || '/' || key AS key, CASE WHEN na / total >= 0.6 THEN a WHEN (na + nb) / total >= 0.7 AND nb >= 8 AND nb / total >= 0.05 THEN a || '|' || b END AS text, CAST(total AS BIGINT) AS votes FROM best
    UNION ALL SELECT stream || '#' || cue, 'read', no FROM r3"""


QUERIES = {
    "part_carriers": (
        part_carriers,
        """WITH p AS (SELECT *, p_partkey AS k, p_size * 1000 + 44 AS want, CASE WHEN p_partkey % 80 BETWEEN 8 AND 10 THEN 'Cd' WHEN p_partkey % 80 BETWEEN 16 AND 27 THEN 'Dvd' WHEN p_partkey % 80 BETWEEN 64 AND 67 THEN 'BluRay' END AS m FROM part)
        SELECT p_partkey, ['AUDIO', 'MODE1/2352', 'MODE2/2352', 'AUDIO'][k % 4 + 1] AS mode, m AS medium, CASE WHEN m = 'Cd' THEN 2352 WHEN m IS NOT NULL THEN 2048 END AS sector, k % 2 = 0 AS volume, k % 3 = 0 AS matroska,
          CASE WHEN k % 7 > 0 AND want > 25000 THEN 'track ' || k || ' came back ' || (want - 25000) || ' bytes short of ' || want || '; the disc did not read completely' END AS problem,
          ['video', 'audio', 'subtitle', 'subtitle', 'other'][k % 5 + 1] AS stream, CASE k % 5 WHEN 0 THEN true WHEN 1 THEN false WHEN 2 THEN true ELSE k % 2 = 0 END AS loaded,
          CASE WHEN k % 5 = 0 THEN 'a disc' WHEN k % 2 = 0 THEN upper(p_name) WHEN k % 5 = 2 THEN 'a disc' ELSE '(empty)' END AS told, k % 4 > 0 AS output, round(k / 20, 4) AS rate,
          'https://musicbrainz.org/ws/2/release/?query=' || replace(p_name, ' ', '%20') || '%20%26%20~%2A&fmt=json&limit=5&dismax=true' AS url,
          'https://en.wikipedia.org/w/api.php?action=query&prop=pageimages&piprop=thumbnail&pithumbsize=342&pilicense=any&titles=' || replace(p_brand, '#', '%23') || '%7C' || replace(p_name, ' ', '%20') || '&format=json&redirects=1' AS pictures FROM p""",
    ),
    "line_extents": (
        line_extents,
        f"""WITH {_SHAPES_SQL}, x AS (SELECT e, n, key, sum(left_gap + 8) OVER (PARTITION BY e, n ORDER BY g) - 8 AS x, key % 4 AS y FROM shapes)
        SELECT e AS event_id, n AS line_no, CAST(min(x) AS BIGINT) AS left, min(y) AS top, CAST(max(x) + 7 AS BIGINT) AS right, max(y) + 19 AS bottom, max(y) + 20 - min(y) AS height, count(*) FILTER (WHERE key <> 7) AS labelled, count(*) FILTER (WHERE key = 7) AS unlabelled
        FROM x GROUP BY e, n""",
    ),
    "learned_lettering": (learned_lettering, _learned_sql()),
    "read_cues": (read_cues, f"WITH {_SHAPES_SQL} SELECT e AS event_id, text, CAST(n_unknown AS BIGINT) AS n_unknown, n_unknown < 5 AS usable FROM cues"),
    "recognised_files": (
        recognised_files,
        f"""WITH {_SHAPES_SQL}, c AS (SELECT CAST(o_custkey AS VARCHAR) AS stream_id, e, text, row_number() OVER (PARTITION BY o_custkey ORDER BY e) AS n FROM cues JOIN orders ON o_orderkey = e), t AS (
          SELECT *, e * 2000 AS a, e * 2000 + 1500 AS b FROM c), f AS (
          SELECT stream_id, string_agg(n || chr(10) || {_STAMP.format(x="a")} || ' --> ' || {_STAMP.format(x="b")} || chr(10) || text || chr(10) || chr(10), '' ORDER BY n) AS content, count(*) AS cues, max(b) AS last_ms FROM t GROUP BY 1)
        SELECT stream_id, sha1(content) AS sha1, length(content) AS chars, cues, last_ms FROM f""",
    ),
    "taught_votes": (
        taught_votes,
        f"""WITH {_SHAPES_SQL}, good AS (SELECT e FROM cues WHERE n_unknown = 0 AND e % 5 > 0 AND e IN (SELECT e FROM said WHERE n = 0)), v AS (SELECT s.* FROM labelled s JOIN good USING (e)), g AS (SELECT before AS key, gap, space = ' ' AS spaced FROM v WHERE before IS NOT NULL),
          q AS (SELECT key, list_sort(list(gap) FILTER (WHERE NOT spaced)) AS a, list_sort(list(gap) FILTER (WHERE spaced)) AS b FROM g GROUP BY key),
          w AS (SELECT key, a[len(a) * 3 // 4 + 1] AS low, b[len(b) // 4 + 1] AS high FROM q WHERE len(a) >= 6 AND len(b) >= 6)
        SELECT key, count(*) AS votes, 1 AS labels, count(*) FILTER (WHERE space = ' ') AS spaced, any_value(CASE WHEN high > low THEN (low + high + 1) // 2 END) AS gap FROM v LEFT JOIN w USING (key) GROUP BY key""",
    ),
    "verified_cues": (
        verified_cues,
        f"""WITH {VISITS_SQL}, r AS (SELECT user_id || '-' || day AS stream_id, event_id, ms // 60000 AS start_ms, event_type AS text FROM visits), ref AS (
          SELECT stream_id, start_ms, arg_max(CASE WHEN event_id % 4 = 0 THEN 'c' || text ELSE text END, event_id) AS want FROM r WHERE event_id % 3 > 0 GROUP BY ALL), m AS (
          SELECT p.stream_id, text, want, len(list_filter(range(1, length(text) + 1), lambda i: substr(text, CAST(i AS INT), 1) = substr(want, CAST(i AS INT), 1))) AS same FROM r p LEFT JOIN ref USING (stream_id, start_ms) WHERE event_id % 7 > 0)
        SELECT stream_id, count(*) AS cues, count(want) AS matched, count(*) FILTER (WHERE text = want) AS exact, count(*) FILTER (WHERE want IS NULL) AS off_grid, CAST(coalesce(sum(greatest(length(text), length(want))) FILTER (WHERE want IS NOT NULL), 0) AS BIGINT) AS chars,
               CAST(coalesce(sum(greatest(length(text), length(want)) - same) FILTER (WHERE want IS NOT NULL), 0) AS BIGINT) AS differing FROM m GROUP BY stream_id""",
    ),
    "fitting_table": (
        fitting_table,
        """WITH s AS (SELECT l_linestatus AS language, l_partkey % 300 AS key, count(*) AS n FROM lineitem GROUP BY ALL), t AS (SELECT language, sum(n) AS total FROM s GROUP BY 1), k AS (
          SELECT DISTINCT CAST(substring(p_brand, 7, 2) AS BIGINT) AS pos, p_partkey % 300 AS key FROM part WHERE p_partkey % 3 > 0 OR p_partkey % 40 >= 24), c AS (SELECT pos, language, sum(n) AS covered FROM s JOIN k USING (key) GROUP BY ALL),
          f AS (SELECT p.pos, min(coalesce(covered, 0) / total) AS worst FROM (SELECT DISTINCT CAST(substring(p_brand, 7, 2) AS BIGINT) AS pos FROM part) p CROSS JOIN t LEFT JOIN c ON c.pos = p.pos AND c.language = t.language GROUP BY 1)
        SELECT pos AS table_pos, round(worst, 6) AS worst, worst >= 0.995 AS fits FROM f ORDER BY f.worst DESC, pos LIMIT 1""",
    ),
    "space_widths": (
        space_widths,
        f"""WITH {_SHAPES_SQL}, g AS (SELECT CASE WHEN e < 40 THEN 'few' ELSE 'many' END AS stream_id, gap FROM seen WHERE gap IS NOT NULL), c AS (SELECT stream_id, count(*) AS n, greatest(list_sort(list(gap))[count(*) * 98 // 100 + 1], 4) AS clip FROM g GROUP BY 1),
          x AS (SELECT g.stream_id, least(gap, clip) AS v FROM g JOIN c USING (stream_id)), cuts AS (SELECT DISTINCT stream_id, v AS t FROM x), score AS (
          SELECT s.stream_id, t, count(*) FILTER (WHERE v <= t) AS na, count(*) FILTER (WHERE v > t) AS nb, avg(v) FILTER (WHERE v <= t) AS ma, avg(v) FILTER (WHERE v > t) AS mb FROM cuts s JOIN x USING (stream_id) GROUP BY ALL),
          best AS (SELECT stream_id, arg_max(t, na * nb * (ma - mb) * (ma - mb)) AS t FROM score WHERE nb > 0 GROUP BY 1)
        SELECT stream_id, CASE WHEN n >= 50 THEN least(greatest(coalesce(t + 1, 4), 2), 11) ELSE 4 END AS space_gap FROM c LEFT JOIN best USING (stream_id)""",
    ),
    "ranked_works": (
        ranked_works,
        f"""WITH {LINES_SQL}, names AS (SELECT c_custkey AS k, translate(CAST(c_custkey AS VARCHAR), '0123456789', 'GHKLNPQRTV') AS t FROM customer), d AS (
          SELECT k, 'Title Q' || CASE WHEN length(t) > 1 THEN lower(t) ELSE t END || CASE WHEN k % 3 > 0 AND k % 7 = 1 THEN ' ' || (k % 8 + 1992) ELSE '' END AS title, CASE WHEN k % 3 = 0 THEN k % 5 + 1 END AS told, CASE WHEN k % 3 > 0 AND k % 7 = 1 THEN k % 8 + 1992 END AS year, list(CAST(o_totalprice * 20 AS BIGINT)) AS ds FROM names JOIN orders ON o_custkey = k GROUP BY ALL), e AS (
          SELECT *, list_filter(ds, lambda x: x BETWEEN 900000 AND 2700000) AS inside, list_max(ds) > 2700000 AND len(list_filter(ds, lambda x: x BETWEEN 900000 AND 2700000)) < 3 AS film, coalesce(told, 1) AS season FROM d), h AS (
          SELECT o_orderkey AS n, translate(CAST(o_custkey AS VARCHAR), '0123456789', 'GHKLNPQRTV') || CASE WHEN o_orderkey % 30 = 10 THEN ' ' || year(o_orderdate) ELSE '' END AS t, CASE WHEN o_orderkey % 20 = 0 THEN 'series' ELSE 'movie' END AS media, year(o_orderdate) AS year, o_orderkey % 90 / 90 AS score FROM orders WHERE o_orderkey % 10 = 0), eps AS (
          SELECT l_orderkey AS n, l_suppkey % 5 + 1 AS season, count(*) AS m, avg(CAST(l_quantity * 60000 AS BIGINT)) AS mean FROM lines WHERE l_orderkey % 20 = 0 GROUP BY ALL), c AS (
          SELECT k, e.title, media, h.year, e.season, n, least(greatest(0.6 * score + CASE WHEN e.year = h.year THEN 0.2 ELSE 0 END + CASE WHEN film AND media = 'movie' THEN 0.3 WHEN film THEN -0.2 ELSE 0 END
                 + CASE WHEN media = 'series' AND m > 0 AND len(inside) BETWEEN 1 AND m THEN 0.15 ELSE 0 END + CASE WHEN media = 'series' AND m > 0 AND len(inside) > 0 THEN 0.25 * len(list_filter(inside, lambda x: abs(x - mean) <= 0.5 * mean)) / len(inside) ELSE 0 END, 0), 1) AS confidence
          FROM e JOIN h ON lower(e.title) = lower('Title Q' || h.t) LEFT JOIN eps USING (n, season) WHERE told IS NULL OR media = 'series')
        SELECT k AS disc_id, title, media, year, season, 'w:' || n AS work_id, round(confidence, 4) AS confidence, row_number() OVER (PARTITION BY k ORDER BY round(confidence, 6) DESC, n) AS rank FROM c""",
    ),
    "extended_cuts": (
        extended_cuts,
        f"""WITH {_FRAMES_SQL}, s AS (SELECT a, b, count(*) / any_value(n) AS share FROM h JOIN n ON p_brand = a GROUP BY a, b)
        SELECT b AS key, arg_max(a, share * 1000000 - CAST(substring(a, 7, 2) AS INT) / 1000000) AS episode, round(max(share), 6) AS share FROM s WHERE CAST(substring(a, 7, 2) AS INT) % 2 = 1 AND CAST(substring(b, 7, 2) AS INT) % 2 = 0 GROUP BY b HAVING max(share) >= 0.05""",
    ),
    "assigned_titles": (
        assigned_titles,
        f"""WITH {LINES_SQL}, r AS (SELECT l_orderkey AS d, printf('t%02d.mkv', pos) AS key, printf('t%02d', pos) AS stem, ['Episode', 'PlayAll', 'Extra', 'Extra'][l_partkey % 4 + 1] AS role, CASE WHEN l_partkey % 4 = 0 THEN pos + 2 END AS number FROM lines), t AS (
          SELECT *, CASE WHEN number IS NOT NULL THEN 4 END AS season, CASE role WHEN 'Episode' THEN coalesce(r_name, 'Episode ' || number) WHEN 'PlayAll' THEN key ELSE stem END AS title FROM r LEFT JOIN region ON r_regionkey + 1 = number)
        SELECT d AS disc_id, key, role, season, number, title, role = 'Episode' AS wanted, '/out' || CASE WHEN d % 2 = 0 THEN '/Season 04' ELSE '' END || CASE WHEN role = 'Extra' THEN '/extras' ELSE '' END || '/' ||
               CASE WHEN d % 2 = 0 AND role = 'Episode' THEN 'Show - A - S04E' || printf('%02d', number) || ' - ' || title WHEN role = 'PlayAll' THEN title || ' (play-all)' WHEN role = 'Episode' THEN 'S04E' || printf('%02d', number) || ' - ' || title ELSE title END || '.mkv' AS destination,
               'Show' || CASE WHEN d % 3 > 0 THEN ' (1999)' ELSE '' END || CASE WHEN season IS NOT NULL THEN ' - season 4' ELSE '' END AS told FROM t""",
    ),
    "disc_text_tracks": (
        disc_text_tracks,
        f"""WITH {DISCS_SQL}, named AS (SELECT t.l_orderkey AS d, number, t.frames, l_partkey, l_linestatus, CASE WHEN t.l_orderkey % 5 > 0 THEN 'Album ' || t.l_orderkey ELSE '' END AS album, CASE WHEN t.l_orderkey % 5 > 0 THEN o_orderstatus ELSE '' END AS artist0
            FROM tracks t JOIN lines l ON l.l_orderkey = t.l_orderkey AND l.pos = t.number JOIN orders ON o_orderkey = t.l_orderkey WHERE NOT is_data), e AS (
          SELECT *, CASE WHEN l_partkey % 3 > 0 THEN 'T/' || l_partkey ELSE 'Track ' || printf('%02d', number) END AS title, CASE WHEN l_partkey % 3 > 0 AND (d % 5 = 0 OR l_linestatus <> artist0) THEN l_linestatus END AS artist FROM named)
        SELECT d AS disc_id, number, album, artist0 AS albumartist, title, artist, CAST(frames * 1000 // 75 AS BIGINT) AS duration_ms,
               '/m/' || CASE WHEN artist0 = '' THEN 'untitled' ELSE artist0 END || '/' || CASE WHEN album = '' THEN '(1999)' ELSE album || ' (1999)' END || CASE WHEN d % 2 = 0 THEN '/Disc 1' ELSE '' END || '/' || printf('%02d', number) || ' - ' || replace(title, '/', '-') || '.flac' AS path,
               '1999 - SE' || CASE WHEN artist0 <> '' THEN ' - ' || artist0 ELSE '' END || CASE WHEN d % 2 = 0 THEN ' - disc 1 of 2' ELSE '' END AS detail FROM e""",
    ),
    "routed_works": (
        routed_works,
        """WITH l AS (SELECT o_orderkey AS k, o_custkey % 2 AS season, CASE o_orderkey % 3 WHEN 0 THEN 'tmdb:' WHEN 1 THEN 'tvmaze:' ELSE '' END || o_orderkey AS w, l_partkey % 2 AS rank FROM orders LEFT JOIN lineitem ON l_orderkey = o_orderkey),
          mine AS (SELECT * FROM l WHERE rank IS NOT NULL AND (k % 3 = 2 OR (k % 3 = 0 AND rank = 1) OR (k % 3 = 1 AND rank = 0))), best AS (SELECT w, min(rank) AS r FROM mine GROUP BY w),
          routed AS (SELECT w AS work_id, CASE WHEN r = 0 THEN 'tvmaze' ELSE 'tmdb' END AS source, count(*) AS n FROM mine JOIN best USING (w) WHERE rank = r GROUP BY ALL)
        SELECT * FROM routed UNION ALL SELECT DISTINCT w, w || CASE WHEN season = 1 THEN '/series' ELSE '/movie' END, 0 FROM l WHERE w NOT IN (SELECT work_id FROM routed)""",
    ),
    "track_bytes": (
        track_bytes,
        f"""WITH {DISCS_SQL}, m AS (SELECT *, CAST(frames * 1000 // 75 AS BIGINT) AS ms FROM tracks)
        SELECT l_orderkey, number, ms AS duration_ms, CAST(coalesce(sum(ms * 3) OVER (PARTITION BY l_orderkey ORDER BY number ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS "offset" FROM m""",
    ),
    "untried_runs": (
        untried_runs,
        f"""WITH {LINES_SQL}, r AS (SELECT l_orderkey, pos, CAST(l_quantity AS BIGINT) AS q FROM lines WHERE l_returnflag <> 'R')
        SELECT l_orderkey, min(pos) * 10 AS start, min(pos) * 10 + arg_min(q, pos) AS end, count(*) AS n FROM r GROUP BY l_orderkey""",
    ),
    "part_predicates": (
        part_predicates,
        """SELECT p_partkey, p_size BETWEEN 15 AND 45 AS episodic, p_partkey % 6 = 0 AS bitmap, p_partkey % 4 > 0 AND p_partkey % 3 = 0 AS trusted, p_partkey % 30 = 0 AS complete, p_size > 0 AND p_partkey % 30 < 0.5 * p_size AS usable, p_partkey % 2 = 1 AS multi,
          p_partkey % 4 > 0 AND p_size % 6 >= 4 AS crops, p_partkey % 3 = 0 AS data, CASE WHEN p_partkey % 7 = 0 THEN 'Audio' WHEN p_partkey % 5 = 0 THEN 'Dvd' WHEN p_partkey % 3 = 0 THEN 'BluRay' WHEN p_partkey % 2 = 0 THEN 'Data' ELSE 'Empty' END AS kind,
          CASE WHEN p_partkey % 3 > 0 THEN p_partkey % 3 || ' of 900 sectors disagree with their error detection' WHEN NOT (p_partkey % 5 = 0 AND p_size > 0) AND p_partkey % 2 > 0 THEN '1 of 900 sectors are the drive''s best guess'
               WHEN p_partkey % 5 = 0 AND p_size > 0 THEN p_size || ' of 900 sectors could not be read (' || p_size * 2352 // 1024 || ' KB)' END AS short,
          CASE WHEN p_partkey % 2 = 0 THEN 'extras' END AS folder, abs((700 + p_size * 2) / 1000 - 0.8) < 0.03 AS telecined, CASE WHEN p_partkey % 2 = 0 THEN 'A b' ELSE 'qI' END AS plausible FROM part""",
    ),
    "part_numbers": (
        part_numbers,
        """WITH p AS (SELECT *, CAST(ceil(720 * (10 + p_size % 3) / 11) AS BIGINT) AS w FROM part)
        SELECT p_partkey, p_size % 100 AS bcd, ascii(p_name[1]) * 16777216 + ascii(p_name[2]) * 65536 + ascii(p_name[3]) * 256 + ascii(p_name[4]) AS big, ['1/1', '32/27', '64/45', '8/9', '16/11', '5/7'][p_partkey % 6 + 1] AS ratio,
          ['24000/1001', '25', '30000/1001', NULL][p_partkey % 4 + 1] AS rate, CASE WHEN p_size % 3 <> 1 THEN w + w % 2 END AS wide, p_size * 1024000 // 90000 AS delay FROM p""",
    ),
    "part_texts": (
        part_texts,
        """SELECT p_partkey, 'SLUS-' || lpad(CAST(p_partkey % 1000 AS VARCHAR), 3, '0') || '99' AS serial, p_name AS short, p_partkey % 120 <= 100 AS match,
          CASE WHEN p_partkey % 2 = 0 THEN 2 ELSE 3 END AS n_chapters, '/m/a b' || p_partkey AS plain FROM part""",
    ),
}
