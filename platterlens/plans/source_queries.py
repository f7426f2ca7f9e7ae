"""Queries of what is read: datfiles, answers of catalogues, probes, printed lines, indexes, maps and word lists."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.strings import escape_html
from ..shared import shared_folder
from ..sources import catalogues, datfiles, media, texts
from .tables import LINES_SQL, VISITS_SQL, lines, table, visits


#: Orders to a slice of the datfiles that are written.
SLICE = 100_000


def _nullable(condition: Column, value: Column) -> Column:
    return F.when(condition, value)


def datfile_roms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as games of the datfile of their priority, lines as roms; the files are written, and read again in splits."""
    k = F.col("l_orderkey")
    rom = F.concat(
        F.lit('<rom name="'), escape_html(F.concat(F.lit("Track & "), F.col("pos").cast("string"), F.when(F.col("pos") == 1, ".cue").otherwise(".bin"))), F.lit('" size="'), F.when(F.col("l_quantity") == 13, "x").otherwise((F.col("l_quantity") * 2352).cast("long").cast("string")),
        F.lit('" crc="'), F.lower(F.hex(F.col("l_partkey"))), F.lit('" sha1="'), F.when(F.col("l_returnflag") == "R", "").otherwise(F.upper(F.sha1(F.col("l_partkey").cast("string").cast("binary")))), F.lit('"/>'),
    )
    roms = lines(spark, sf_dir).groupBy("l_orderkey").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", rom.alias("rom")))), lambda x: x.rom), "").alias("roms"))
    games = roms.join(table(spark, sf_dir, "orders"), k == F.col("o_orderkey")).select(F.col("o_orderpriority").alias("system"), k.alias("place"), F.concat(F.lit('<game name="Game '), k.cast("string"), F.lit(' &lt;Q&gt;">'), F.col("roms"), F.lit("</game>")).alias("value"))
    # a slice of a datfile's games is a part of it, so a datfile is many tasks' work; keys that crowd make large parts, no wrong ones
    least, most, n = table(spark, sf_dir, "orders").agg(F.min("o_orderkey"), F.max("o_orderkey"), F.count("*")).first()
    slices = -(-n // SLICE)
    at = F.floor((F.col("place") - F.lit(least or 0)) / F.lit(((most or 0) - (least or 0)) // max(slices, 1) + 1)).cast("long")
    sold = table(spark, sf_dir, "lineitem").select("l_orderkey")
    heads = table(spark, sf_dir, "orders").join(sold, k == F.col("o_orderkey"), "left_semi").select(F.col("o_orderpriority").alias("system")).distinct()
    heads = heads.select("system", F.lit(-1).cast("long").alias("place"), F.concat(F.lit("<datafile><header><name>System "), "system", F.lit("</name></header>")).alias("value"))
    folder = f"{shared_folder(spark)}/datfiles-{uuid.uuid4().hex}"
    placed = games.unionByName(heads).withColumns({"of": F.col("system"), "slice": F.when(F.col("place") < 0, "0").otherwise(F.format_string("1%09d", at))})
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), slices)
    placed.repartition(parts, "of", "slice").sortWithinPartitions("of", "slice", "place").select("value", "of", "slice").write.partitionBy("of", "slice").text(folder)
    found = datfiles.with_tracks(datfiles.read_datfiles(spark, folder, r"/part-[^/]*$", r"^(.*/of=[^/]*)/"))
    return found.select("system", F.col("dat_pos").cast("long").alias("dat_pos"), "game_pos", "game", F.col("rom_pos").cast("long").alias("rom_pos"), "name", "size", "crc32", "sha1", F.col("track_pos").cast("long").alias("track_pos"))


def _answers(rows: DataFrame, key: str, order: str, item: Column, name: str | None = None) -> DataFrame:
    """(key, json): a JSON array of items in order, perhaps under a name."""
    each = rows.groupBy(key).agg(F.transform(F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), item.alias("v")))), lambda x: x.v).alias("a"))
    return each.select(F.col(key).cast("string").alias("question"), F.to_json(F.struct(F.col("a").alias(name)) if name else F.col("a")).alias("json"))


def show_answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as scored shows that a question of their customer found."""
    o, k = table(spark, sf_dir, "orders"), F.col("o_orderkey")
    year = F.year("o_orderdate")
    show = F.struct(
        k.alias("id"), _nullable(k % 17 > 0, F.concat(F.lit("Show "), k.cast("string"))).alias("name"), F.col("o_orderpriority").alias("type"), F.date_format("o_orderdate", "yyyy-MM-dd").alias("premiered"),
        _nullable(k % 3 > 0, (year + k % 3 - 1).cast("string")).alias("ended"), F.when(k % 2 == 0, "Running").otherwise("Ended").alias("status"), _nullable(k % 5 > 0, F.struct(F.lit("N").alias("name"))).alias("network"), F.struct(F.lit("W").alias("name")).alias("webChannel"),
        F.struct(_nullable(k % 4 > 0, F.lit("m.jpg")).alias("medium"), _nullable(k % 4 > 1, F.lit("o.jpg")).alias("original")).alias("image"),
    )
    found = catalogues.show_search(_answers(o, "o_custkey", "o_orderkey", F.struct(_nullable(k % 7 > 0, (k % 15) / 10).alias("score"), show.alias("show"))))
    return found.select("question", F.col("hit_pos").cast("long").alias("hit_pos"), "work_id", "title", F.col("year").cast("long").alias("year"), "score", "detail", "poster")


def show_episodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines as episodes of their order's show, some of which are specials."""
    item = F.struct((F.col("l_suppkey") % 3).alias("season"), _nullable(F.col("l_partkey") % 9 > 0, F.col("pos") - 1).alias("number"), F.col("l_linestatus").alias("name"), F.when(F.col("pos") % 2 == 0, "").otherwise(F.date_format("l_shipdate", "yyyy-MM-dd")).alias("airdate"), F.col("l_quantity").cast("long").alias("runtime"))
    answers = _answers(lines(spark, sf_dir), "l_orderkey", "pos", item)
    found = catalogues.show_episodes(answers.withColumnRenamed("question", "work_id"))
    return found.select("work_id", F.col("season").cast("long").alias("season"), F.col("number").cast("long").alias("number"), "name", "airdate", "runtime_ms")


def film_answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as films or series that come without a score."""
    k = F.col("o_orderkey")
    item = F.struct(k.alias("id"), _nullable(k % 2 == 0, F.when(k % 10 == 0, "").otherwise(F.concat(F.lit("F"), k.cast("string")))).alias("title"), _nullable(k % 2 == 1, F.concat(F.lit("S"), k.cast("string"))).alias("name"), _nullable(k % 3 > 0, F.date_format("o_orderdate", "yyyy-MM-dd")).alias("release_date"), _nullable(k % 3 == 0, F.lit("1999-01-01")).alias("first_air_date"))
    found = catalogues.ranked_search(_answers(table(spark, sf_dir, "orders"), "o_custkey", "o_orderkey", item, "results"))
    return found.select("question", F.col("hit_pos").cast("long").alias("hit_pos"), "work_id", "title", F.col("year").cast("long").alias("year"), F.round("score", 6).alias("score"))


def season_answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines as the episodes of a season, numbered from 0, which is a special's."""
    item = F.struct((F.col("pos") - 1).alias("episode_number"), F.col("l_linestatus").alias("name"), F.when(F.col("pos") % 2 == 0, "").otherwise(F.date_format("l_shipdate", "yyyy-MM-dd")).alias("air_date"), F.col("l_quantity").cast("long").alias("runtime"))
    answers = _answers(lines(spark, sf_dir), "l_orderkey", "pos", item, "episodes").select(F.col("question").alias("work_id"), F.lit(4).alias("season"), "json")
    return catalogues.season_episodes(answers).select("work_id", F.col("season").cast("long").alias("season"), F.col("number").cast("long").alias("number"), "name", "airdate", "runtime_ms")


def entity_answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as entities that a search found, of which some are films, with what is claimed of those and the pictures of
    their articles."""
    o, k = table(spark, sf_dir, "orders"), F.col("o_orderkey")
    q = F.concat(F.lit("Q"), k.cast("string"))
    found = catalogues.entity_search(_answers(o, "o_custkey", "o_orderkey", F.struct(q.alias("id"), F.col("o_orderstatus").alias("description")), "search"))
    claim = lambda v: F.array(F.struct(F.struct(F.struct(v.alias("value")).alias("datavalue")).alias("mainsnak")))
    claims = F.struct(
        claim(F.struct(F.when(k % 3 == 0, "Q11424").when(k % 3 == 1, "Q202866").otherwise("Q5").alias("id"))).alias("P31"), _nullable(k % 4 > 0, claim(F.struct(F.concat(F.lit("+"), F.year("o_orderdate").cast("string"), F.lit("-02-03T00:00:00Z")).alias("time")))).alias("P577"),
        _nullable(k % 5 > 0, claim(F.struct(F.concat(F.lit("+"), (k % 200).cast("string")).alias("amount")))).alias("P2047"), _nullable(k % 6 == 0, claim(F.lit("logo.svg"))).alias("P154"),
    )
    links = F.struct(F.struct(F.concat(F.lit("A"), k.cast("string")).alias("title")).alias("enwiki"))
    body = F.struct(F.struct(_nullable(k % 7 > 0, F.struct(F.concat(F.lit("T"), k.cast("string")).alias("value"))).alias("en")).alias("labels"), claims.alias("claims"), links.alias("sitelinks"))
    answers = o.groupBy("o_custkey").agg(F.to_json(F.struct(F.map_from_entries(F.collect_list(F.struct(q.alias("k"), body.alias("v")))).alias("entities"))).alias("json")).select(F.col("o_custkey").cast("string").alias("question"), "json")
    films = catalogues.entity_films(answers, found)
    page = F.struct(F.concat(F.lit("A"), k.cast("string")).alias("title"), F.struct(_nullable(k % 8 > 0, F.concat(F.lit("http://p/"), k.cast("string"), F.lit(".jpg?x=1"))).alias("source")).alias("original"))
    images = catalogues.article_images(o.groupBy("o_custkey").agg(F.to_json(F.struct(F.struct(F.map_from_entries(F.collect_list(F.struct(k.cast("string").alias("k"), page.alias("v")))).alias("pages")).alias("query"))).alias("json")))
    return films.join(images.withColumnRenamed("title", "article"), "article", "left").select("question", "entity", F.col("hit_pos").cast("long").alias("hit_pos"), "title", F.col("year").cast("long").alias("year"), "runtime_ms", "logo", "url", F.round("score", 6).alias("score"))


def redirected_images(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pictures of nations' articles, under the names that lead to them too."""
    n = F.col("n_nationkey")
    page = F.struct(F.col("n_name").alias("title"), F.struct(F.concat(F.lit("http://t/"), n.cast("string")).alias("source")).alias("thumbnail"))
    answers = table(spark, sf_dir, "nation").groupBy("n_regionkey").agg(F.to_json(F.struct(F.struct(F.collect_list(F.struct(F.lower("n_name").alias("from"), F.col("n_name").alias("to"))).alias("redirects"), F.map_from_entries(F.collect_list(F.struct(n.cast("string").alias("k"), page.alias("v")))).alias("pages")).alias("query"))).alias("json"))
    return catalogues.article_images(answers)


def _albums(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("l_orderkey")
    credit = lambda c: F.array(F.struct(c.alias("name"), F.lit(" & ").alias("joinphrase")), F.struct(F.lit("X").alias("name"), F.lit(None).cast("string").alias("joinphrase")))
    track = F.struct(F.col("pos").alias("position"), F.col("l_linestatus").alias("title"), _nullable(F.col("l_quantity") > 5, (F.col("l_quantity") * 1000).cast("long")).alias("length"), F.struct(F.lit(77).alias("length")).alias("recording"), credit(F.col("l_returnflag")).alias("artist-credit"))
    media_ = F.array(F.struct(F.lit(1).alias("position"), F.array(F.struct(F.lit("other").alias("id"))).alias("discs"), F.slice("a", 1, 0).alias("tracks")), F.struct(F.lit(2).alias("position"), F.array(F.struct(k.cast("string").alias("id"))).alias("discs"), F.col("a").alias("tracks")))
    release = F.struct(F.concat(F.lit("r"), k.cast("string")).alias("id"), F.concat(F.lit("Album "), k.cast("string")).alias("title"), F.date_format("o_orderdate", "yyyy-MM-dd").alias("date"), F.lit("SE").alias("country"), credit(F.lit("A")).alias("artist-credit"), F.array(F.struct(F.lit("C-1").alias("catalog-number"), F.struct(F.lit("L").alias("name")).alias("label"))).alias("label-info"), media_.alias("media"))
    rows = lines(spark, sf_dir).groupBy("l_orderkey").agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", track.alias("v")))), lambda x: x.v).alias("a")).join(table(spark, sf_dir, "orders"), k == F.col("o_orderkey"))
    return catalogues.albums(rows.select(k.cast("string").alias("disc_id"), F.to_json(F.struct(F.array(release).alias("releases"))).alias("json")))


def album_tracks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as albums of two discs, read from a catalogue's answer: the entries of the disc that is in the drive, and totals."""
    from ..operators import music

    albums = _albums(spark, sf_dir)
    tracks = lines(spark, sf_dir).select(F.col("l_orderkey").cast("string").alias("disc_id"), F.col("pos").cast("int").alias("number"), (F.col("l_returnflag") == "R").alias("is_data"))
    entries = music.with_totals(music.to_rip(tracks, albums, also=("label", "catalogue_number")))
    return entries.select("disc_id", F.col("number").cast("long").alias("number"), "album", "albumartist", F.col("year").cast("long").alias("year"), F.col("disc").cast("long").alias("disc"), F.col("discs").cast("long").alias("discs"), "title", "artist", "length_ms", "album_ms", "is_compilation", "label", "catalogue_number")


def _probes(spark: SparkSession, sf_dir: str) -> DataFrame:
    stream = F.struct(
        F.element_at(F.array(F.lit("video"), F.lit("audio"), F.lit("subtitle"), F.lit("data")), (F.col("l_partkey") % 4 + 1).cast("int")).alias("codec_type"), F.lit("c").alias("codec_name"), F.lit(720).alias("width"), (F.col("pos") + 480).alias("height"), (F.col("pos") % 3).alias("channels"),
        F.struct(_nullable(F.col("pos") % 2 == 1, F.lit("eng")).alias("language"), F.col("l_linestatus").alias("title")).alias("tags"), F.struct((F.col("pos") % 2).alias("default"), F.lit(0).alias("forced")).alias("disposition"),
    )
    chapter = F.struct(F.format_string("%d.5", "pos").alias("start_time"), F.format_string("%d.25", F.col("pos") + F.col("l_quantity").cast("long") - 3).alias("end_time"))
    rows = lines(spark, sf_dir).groupBy("l_orderkey").agg(F.array_sort(F.collect_list(F.struct("pos", stream.alias("s"), chapter.alias("c")))).alias("a"))
    json = F.to_json(F.struct(F.struct(F.format_string("%d.125", F.col("l_orderkey") % 9000).alias("duration")).alias("format"), F.transform("a", lambda x: x.c).alias("chapters"), F.transform("a", lambda x: x.s).alias("streams")))
    return rows.select(F.col("l_orderkey").alias("file"), json.alias("json"))


def probe_titles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as probed files, lines as their streams and chapters."""
    found = media.probes(_probes(spark, sf_dir))
    return found.select("file", "duration_ms", F.array_join(F.transform("chapters", lambda c: c.cast("string")), ",").alias("chapters"), F.col("height").cast("long").alias("height"))


def probe_streams(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = media.streams(_probes(spark, sf_dir))
    return found.select("file", F.col("stream").cast("long").alias("stream"), "kind", F.col("index").cast("long").alias("index"), "language", "title", F.col("channels").cast("long").alias("channels"), "is_default", "forced")


def printed_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as lines that a program prints: the drives it names, the first error of a user, and how far it has come."""
    k = F.col("event_id")
    line = (
        F.when(k % 4 == 0, F.concat(F.lit("DRV:"), (k % 8).cast("string"), F.lit(',2,999,12,"Drive ""'), F.col("event_type"), F.lit('""","LABEL","'), F.when(k % 8 == 0, F.concat(F.lit("/dev/sr"), (k % 3).cast("string"))).otherwise(""), F.lit('"')))
        .when(k % 4 == 1, F.concat(F.lit('MSG:3,0,1,"'), F.when(F.col("event_type") == "error", F.concat(F.lit("Cannot read "), k.cast("string"))).otherwise("started"), F.lit('","%1"')))
        .when(k % 4 == 2, F.concat(F.lit("PRGV:"), k.cast("string"), F.lit(","), (k % 100).cast("string"), F.lit(","), (k % 5 * 100).cast("string"))).otherwise("other")
    )
    rows = table(spark, sf_dir, "events").select(F.col("user_id").cast("string").alias("disc_id"), k.alias("line_no"), line.alias("line"))
    drives = media.drives(rows).select(F.lit("drive").alias("what"), F.concat_ws("|", F.col("slot").cast("string"), "drive", "label", "device").alias("told"))
    errors = media.first_error(rows).select(F.lit("error").alias("what"), F.concat_ws("|", "disc_id", "text").alias("told"))
    shares = media.progress(rows).select(F.lit("share").alias("what"), F.concat_ws("|", F.col("line_no").cast("string"), F.when(F.col("share").isNull(), "none").otherwise(F.format_string("%.4f", "share"))).alias("told"))
    return drives.unionByName(errors).unionByName(shares)


def index_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as the cues of a subtitle index, and a palette for each user."""
    rows = visits(spark, sf_dir)
    clock = lambda n: F.lpad(n.cast("string"), 2, "0")
    stamp = F.concat(F.lit("timestamp: "), clock(F.col("event_id") % 30), F.lit(":"), clock(F.col("event_id") % 60), F.lit(":"), clock(F.col("event_id") % 59), F.lit(":"), F.lpad((F.col("event_id") % 1000).cast("string"), 3, "0"), F.lit(", filepos: "), F.lpad(F.lower(F.hex("event_id")), 9, "0"))
    stamped = rows.select(F.col("user_id").cast("string").alias("stream_id"), F.when(F.col("event_id") % 11 == 0, "# a remark").otherwise(stamp).alias("line"))
    colours = rows.groupBy("user_id").agg(F.count("*").alias("n")).select(F.col("user_id").cast("string").alias("stream_id"), F.concat(F.lit("palette: "), F.lpad(F.hex("n"), 6, "0"), F.lit(", oops , 00ff00")).alias("line"))
    both = stamped.unionByName(colours)
    cues = texts.index_events(both).select("stream_id", F.col("start_ms").cast("string").alias("a"), F.col("filepos").cast("string").alias("b"))
    return cues.unionByName(texts.palette(both).select("stream_id", F.lit("palette").alias("a"), F.array_join(F.transform("palette", lambda c: c.cast("string")), ",").alias("b")))


def recovery_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts as lines of recovery maps, some of which are none."""
    k = F.col("p_partkey")
    symbol = F.element_at(F.array(*map(F.lit, "?*/-+x")), (k % 6 + 1).cast("int"))
    line = F.when(k % 9 == 0, F.concat(F.lit("# "), "p_name")).when(k % 2 == 0, F.format_string("0x%08X  0x%X  %s", k * 2048, F.col("p_size").cast("long"), symbol)).otherwise(F.format_string("%d %d %s", k * 2048, F.col("p_size").cast("long"), symbol))
    return texts.map_runs(table(spark, sf_dir, "part").select(F.col("p_brand").alias("map_id"), line.alias("line")))


def listed_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of parts' names as lines of a word list, with and without flags."""
    word = F.explode(F.split("p_name", " "))
    rows = table(spark, sf_dir, "part").select("p_partkey", word.alias("w")).select(F.when(F.col("p_partkey") % 3 == 0, F.concat(F.upper("w"), F.lit("/S"))).when(F.col("p_partkey") % 7 == 0, F.concat("w", F.lit("1"))).otherwise(F.col("w")).alias("line"))
    return texts.words(rows)


def cue_sheets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines as the tracks of an order's disc, told as a sheet."""
    k = F.col("l_orderkey")
    spans = lines(spark, sf_dir).select(k.alias("disc_id"), F.concat(F.lit("Disc "), k.cast("string")).alias("stem"), F.col("pos").cast("int").alias("number"), (F.col("l_returnflag") == "R").alias("is_data"), F.when(F.col("pos") % 2 == 0, 150).otherwise(0).alias("pregap"))
    return texts.cue_sheet(spans)


def _poses(year: str) -> str:
    return f"row_number() OVER (PARTITION BY {year} ORDER BY o_orderkey) - 1"


QUERIES = {
    "datfile_roms": (
        datfile_roms,
        f"""WITH {LINES_SQL}, games AS (SELECT o_orderkey, o_orderpriority AS p, dense_rank() OVER (ORDER BY o_orderpriority) - 1 AS dat_pos, row_number() OVER (PARTITION BY o_orderpriority ORDER BY o_orderkey) - 1 AS game_pos
            FROM orders WHERE o_orderkey IN (SELECT l_orderkey FROM lineitem)), roms AS (SELECT * FROM games JOIN lines ON l_orderkey = o_orderkey WHERE l_quantity <> 13)
        SELECT 'System ' || p AS system, dat_pos, game_pos, 'Game ' || o_orderkey || ' <Q>' AS game, pos - 1 AS rom_pos, 'Track & ' || pos || CASE WHEN pos = 1 THEN '.cue' ELSE '.bin' END AS name, CAST(l_quantity * 2352 AS BIGINT) AS size,
               l_partkey AS crc32, CASE WHEN l_returnflag <> 'R' THEN sha1(CAST(l_partkey AS VARCHAR)) END AS sha1,
               CASE WHEN pos > 1 THEN count(*) FILTER (WHERE pos > 1) OVER (PARTITION BY o_orderkey ORDER BY pos) - 1 END AS track_pos FROM roms""",
    ),
    "show_answers": (
        show_answers,
        f"""WITH o AS (SELECT *, o_orderkey AS k, year(o_orderdate) AS y, {_poses("o_custkey")} AS hit_pos FROM orders)
        SELECT CAST(o_custkey AS VARCHAR) AS question, hit_pos, 'tvmaze:' || k AS work_id, 'Show ' || k AS title, y AS year, CASE WHEN k % 7 > 0 THEN least(k % 15 / 10, 1.0) ELSE 0.0 END AS score,
               CASE WHEN k % 5 > 0 THEN 'N' ELSE 'W' END || ' · ' || o_orderpriority || CASE WHEN k % 3 = 2 THEN ' · ' || y || '-' || (y + 1) WHEN k % 3 = 0 AND k % 2 = 0 THEN ' · ongoing' ELSE '' END AS detail,
               CASE WHEN k % 4 > 1 THEN 'o.jpg' WHEN k % 4 = 1 THEN 'm.jpg' END AS poster FROM o WHERE k % 17 > 0""",
    ),
    "show_episodes": (
        show_episodes,
        f"""WITH {LINES_SQL} SELECT CAST(l_orderkey AS VARCHAR) AS work_id, l_suppkey % 3 AS season, pos - 1 AS number, l_linestatus AS name, CASE WHEN pos % 2 = 1 THEN strftime(l_shipdate, '%Y-%m-%d') END AS airdate, CAST(l_quantity AS BIGINT) * 60000 AS runtime_ms
        FROM lines WHERE pos > 1 AND l_partkey % 9 > 0""",
    ),
    "film_answers": (
        film_answers,
        f"""WITH o AS (SELECT *, o_orderkey AS k, {_poses("o_custkey")} AS hit_pos, count(*) OVER (PARTITION BY o_custkey) AS n FROM orders)
        SELECT CAST(o_custkey AS VARCHAR) AS question, hit_pos, 'tmdb:' || k AS work_id, CASE WHEN k % 2 = 0 THEN 'F' ELSE 'S' END || k AS title, CASE WHEN k % 3 > 0 THEN year(o_orderdate) ELSE 1999 END AS year, round(1 - hit_pos / n * 0.5, 6) AS score FROM o WHERE k % 10 > 0""",
    ),
    "season_answers": (
        season_answers,
        f"""WITH {LINES_SQL} SELECT CAST(l_orderkey AS VARCHAR) AS work_id, 4 AS season, pos - 1 AS number, l_linestatus AS name, CASE WHEN pos % 2 = 1 THEN strftime(l_shipdate, '%Y-%m-%d') END AS airdate, CAST(l_quantity AS BIGINT) * 60000 AS runtime_ms FROM lines WHERE pos > 1""",
    ),
    "entity_answers": (
        entity_answers,
        f"""WITH o AS (SELECT *, o_orderkey AS k, {_poses("o_custkey")} AS hit_pos, count(*) OVER (PARTITION BY o_custkey) AS n FROM orders)
        SELECT CAST(o_custkey AS VARCHAR) AS question, 'Q' || k AS entity, hit_pos, CASE WHEN k % 7 > 0 THEN 'T' ELSE 'Q' END || k AS title, CASE WHEN k % 4 > 0 THEN year(o_orderdate) END AS year, CASE WHEN k % 5 > 0 THEN k % 200 * 60000 END AS runtime_ms,
               CASE WHEN k % 6 = 0 THEN 'logo.svg' END AS logo, CASE WHEN k % 8 > 0 THEN 'http://p/' || k || '.jpg' END AS url, round(1 - hit_pos / n * 0.5, 6) AS score FROM o WHERE k % 3 < 2""",
    ),
    "redirected_images": (
        redirected_images,
        "SELECT n_name AS title, 'http://t/' || n_nationkey AS url FROM nation UNION ALL SELECT lower(n_name), 'http://t/' || n_nationkey FROM nation",
    ),
    "album_tracks": (
        album_tracks,
        f"""WITH {LINES_SQL}, e AS (SELECT l.*, year(o_orderdate) AS y, CASE WHEN l_quantity > 5 THEN CAST(l_quantity * 1000 AS BIGINT) ELSE 77 END AS ms, CASE WHEN l_returnflag = 'A' THEN 'A & X' ELSE l_returnflag || ' & X' END AS who FROM lines l JOIN orders ON o_orderkey = l_orderkey WHERE l_returnflag <> 'R')
        SELECT CAST(l_orderkey AS VARCHAR) AS disc_id, pos AS number, 'Album ' || l_orderkey AS album, 'A & X' AS albumartist, y AS year, 2 AS disc, 2 AS discs, l_linestatus AS title, who AS artist, ms AS length_ms,
               CAST(sum(ms) OVER (PARTITION BY l_orderkey) AS BIGINT) AS album_ms, bool_or(who <> 'A & X') OVER (PARTITION BY l_orderkey) AS is_compilation, 'L' AS label, 'C-1' AS catalogue_number FROM e""",
    ),
    "probe_titles": (
        probe_titles,
        f"""WITH {LINES_SQL} SELECT l_orderkey AS file, l_orderkey % 9000 * 1000 + 125 AS duration_ms, string_agg(CAST(greatest(CAST(l_quantity AS BIGINT) * 1000 - 3250, 0) AS VARCHAR), ',' ORDER BY pos) AS chapters, min(CASE WHEN l_partkey % 4 = 0 THEN pos + 480 END) AS height FROM lines GROUP BY l_orderkey""",
    ),
    "probe_streams": (
        probe_streams,
        f"""WITH {LINES_SQL}, s AS (SELECT *, ['video', 'audio', 'subtitle', 'data'][l_partkey % 4 + 1] AS kind FROM lines)
        SELECT l_orderkey AS file, pos - 1 AS stream, kind, row_number() OVER (PARTITION BY l_orderkey, kind ORDER BY pos) - 1 AS index, CASE WHEN pos % 2 = 1 THEN 'eng' ELSE 'und' END AS language, l_linestatus AS title, pos % 3 AS channels, pos % 2 = 1 AS is_default, false AS forced FROM s WHERE kind <> 'data'""",
    ),
    "printed_lines": (
        printed_lines,
        """SELECT 'drive' AS what, (event_id % 8) || '|Drive "' || event_type || '"|LABEL|/dev/sr' || event_id % 3 AS told FROM events WHERE event_id % 8 = 0
        UNION ALL SELECT 'error', user_id || '|Cannot read ' || min(event_id) FROM events WHERE event_id % 4 = 1 AND event_type = 'error' GROUP BY user_id
        UNION ALL SELECT 'share', event_id || '|' || CASE WHEN event_id % 5 = 0 THEN 'none' ELSE printf('%.4f', round(event_id % 100 / (event_id % 5 * 100), 6)) END FROM events WHERE event_id % 4 = 2""",
    ),
    "index_lines": (
        index_lines,
        """SELECT CAST(user_id AS VARCHAR) AS stream_id, CAST(event_id % 30 * 3600000 + event_id % 60 * 60000 + event_id % 59 * 1000 + event_id % 1000 AS VARCHAR) AS a, CAST(event_id AS VARCHAR) AS b FROM events WHERE event_id % 11 <> 0
        UNION ALL SELECT CAST(user_id AS VARCHAR), 'palette', count(*) || ',0,65280' FROM events GROUP BY user_id""",
    ),
    "recovery_runs": (
        recovery_runs,
        "SELECT p_brand AS map_id, p_partkey * 2048 AS start, p_partkey * 2048 + p_size AS end, ['NonTried', 'NonTrimmed', 'NonScraped', 'Bad', 'Finished'][p_partkey % 6 + 1] AS state FROM part WHERE p_partkey % 9 > 0 AND p_partkey % 6 < 5",
    ),
    "listed_words": (
        listed_words,
        "SELECT DISTINCT w AS word FROM (SELECT p_partkey, unnest(string_split(p_name, ' ')) AS w FROM part) WHERE p_partkey % 3 = 0 OR p_partkey % 7 <> 0",
    ),
    "cue_sheets": (
        cue_sheets,
        f"""WITH {LINES_SQL} SELECT l_orderkey AS disc_id, string_agg('FILE "Disc ' || l_orderkey || ' (Track ' || printf('%02d', pos) || ').bin" BINARY' || chr(10) || '  TRACK ' || printf('%02d', pos) || CASE WHEN l_returnflag = 'R' THEN ' MODE1/2352' ELSE ' AUDIO' END || chr(10) ||
          CASE WHEN pos % 2 = 0 THEN '    INDEX 00 00:00:00' || chr(10) || '    INDEX 01 00:02:00' ELSE '    INDEX 01 00:00:00' END || chr(10), '' ORDER BY pos) AS sheet FROM lines GROUP BY l_orderkey""",
    ),
}
