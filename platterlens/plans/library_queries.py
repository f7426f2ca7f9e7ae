"""Queries of a library: tracks kept, works chosen, tables picked, answers of catalogues and readers read."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import languages, predicates
from ..operators import glyphs, library
from ..sources import catalogues, media, tables_of_glyphs
from .report_queries import _GLYPHS_SQL, _glyphs
from .tables import LINES_SQL, VISITS_SQL, lines, table, visits


def select_tracks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines as tracks of their order's film: what of their languages English and Swedish leave, without commentaries."""
    rows = lines(spark, sf_dir)
    tag = F.element_at(F.array(*map(F.lit, ("eng", "sv", "de", "fra"))), (F.col("l_partkey") % 4 + 1).cast("int"))
    tracks = rows.select(
        F.col("l_orderkey").alias("group"), F.when(F.col("l_returnflag") == "R", "subtitle").otherwise("audio").alias("kind"), F.col("pos").alias("tag_pos"), tag.alias("tag"),
        F.when(F.col("l_quantity") > 40, "Director's commentary").alias("title"), F.when(F.col("l_linestatus") == "O", "dvd_subtitle").otherwise("subrip").alias("codec"),
    )
    found = library.select_tracks(tracks, languages.aliases(spark), ["eng", "swe"])
    return found.select(F.col("group").alias("l_orderkey"), F.col("tag_pos").alias("pos"), "kind", F.col("out_pos").cast("long").alias("out_pos"), "reads")


def unique_streams(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of a user's day the events whose kind and tenth of a value no earlier one has, as streams that read the same."""
    rows = visits(spark, sf_dir).withColumn("body", F.concat_ws(" ", "event_type", (F.col("event_id") % 2).cast("string")))
    return library.unique_streams(rows.select("user_id", "day", "event_id", "body"), ["user_id", "day"], "body", "event_id").select("event_id")


def decided_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers as discs: a third has a title given, some of those are in the catalogue, and others are guessed."""
    k = F.col("c_custkey")
    asked = table(spark, sf_dir, "customer").select("c_custkey", F.when(k % 3 == 0, F.concat(F.lit(" Title "), k.cast("string"))).alias("title"), F.when(k % 4 == 0, (k % 9 + 1).cast("int")).alias("season"))
    o = table(spark, sf_dir, "orders")
    hits = o.select(F.col("o_custkey").alias("c_custkey"), F.col("o_orderkey").alias("hit_pos"), F.concat(F.lit("Work "), F.col("o_orderkey").cast("string")).alias("work"), F.when(F.col("o_orderkey") % 2 == 0, "series").otherwise("movie").alias("media"), F.when(F.col("o_orderkey") % 4 == 0, F.lit(2)).alias("hit_season"))
    return library.decide_media(asked, hits.filter("c_custkey % 2 = 0"), hits.filter("c_custkey % 5 > 0"), ["c_custkey"])


def relabelled(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Corrections merged into a table of shapes."""
    settled = glyphs.table_of(_glyphs(spark, sf_dir), agreement=0.3).select("key", "text")
    n = F.col("n_nationkey")
    fixes = table(spark, sf_dir, "nation").select((n * 7).cast("string").alias("key"), F.when(n % 2 == 0, "N").otherwise(F.col("n_name").substr(1, 1)).alias("fix"))
    return library.relabelled(settled, fixes)


def glyph_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A table of shapes, written as text, commonest first, and read again."""
    table_ = glyphs.table_of(_glyphs(spark, sf_dir), agreement=0.3).select(F.lit("t").alias("table"), "key", F.col("seen").alias("count"), "text")
    split = table_.withColumn("table", F.concat(F.lit("t"), (F.length("key")).cast("string")))
    return tables_of_glyphs.read(tables_of_glyphs.saved(split)).select("table", "key", "count", "text", F.col("pos").cast("long").alias("pos"))


def lettering(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For each year of orders and each status as a language the brand whose table knows most of what is sold."""
    rows = lines(spark, sf_dir).select(F.year("l_shipdate").alias("disc"), F.col("l_linestatus").alias("language"), (F.col("l_partkey") % 300).alias("key"))
    shapes = rows.groupBy("disc", "language", "key").agg(F.count("*").alias("n"))
    p = F.col("p_partkey")
    tables = table(spark, sf_dir, "part").select(F.col("p_brand").alias("table"), F.substring("p_brand", 7, 2).cast("int").alias("table_pos"), (p % 300).alias("key"))
    return library.lettering(shapes, tables, 0.25)


def table_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tables on offer for each brand: one that is set, then those of its folder."""
    k = F.col("p_partkey")
    parts = table(spark, sf_dir, "part")
    found = parts.select("p_brand", F.concat(F.lit("/t/"), k.cast("string"), F.when(k % 3 == 0, ".txt").otherwise(".json")).alias("path"))
    set_ = parts.groupBy("p_brand").agg(F.min(F.concat(F.lit("/t/"), k.cast("string"), F.lit(".json"))).alias("path"))
    return library.table_candidates(set_, found, ["p_brand"]).select("p_brand", "path", F.col("pos").cast("long").alias("pos"))


def dictionaries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Dictionaries of the languages of documents, among those of two folders."""
    names = F.array(*map(F.lit, ("de_AT.dic", "de.dic", "en_GB.dic", "hyph_en.dic", "es.aff", "fra.dic", "fr_FR.dic")))
    files = spark.range(2).select(F.col("id").alias("dir_pos"), F.explode(names).alias("name")).filter("dir_pos = 1 or name not like 'de%'").select("dir_pos", F.concat(F.lit("/d"), F.col("dir_pos").cast("string"), F.lit("/"), F.col("name")).alias("path"))
    return library.dictionaries(files, table(spark, sf_dir, "documents").filter("lang is not null").select(F.col("lang").alias("code")))


def picked_drives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A user's days as drives, loaded where an error was seen."""
    drives = visits(spark, sf_dir).groupBy("user_id", "day").agg(F.bool_or(F.col("event_type") == "error").alias("loaded")).select("user_id", F.col("day").cast("string").alias("device"), "loaded")
    return library.pick_drive(drives, ["user_id"])


def reader_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a reader said of several pictures at once, refused where it said too much or too little."""
    order = F.array_sort(F.collect_list(F.struct("turn", F.coalesce("role", F.lit("")).alias("role"))))
    said = table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.concat(F.array_join(F.transform(order, lambda x: x.role), "\f"), F.when(F.col("conv_id") % 2 == 0, "\f").otherwise("")).alias("said"), F.count("*").alias("n"))
    wanted = F.col("n") + F.when(F.col("conv_id") % 5 == 0, 1).otherwise(0)
    return said.select("conv_id", F.array_join(library.pages(F.col("said"), wanted), "|").alias("pages"))


def release_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers as answers of a catalogue of music, whose orders are releases."""
    k = F.col("o_orderkey")
    release = F.struct(
        F.concat(F.lit("r"), k.cast("string")).alias("id"), F.concat(F.lit("Album "), k.cast("string")).alias("title"), F.when(k % 3 > 0, F.date_format("o_orderdate", "yyyy-MM")).alias("date"), F.when(k % 4 > 0, F.lit("SE")).alias("country"),
        F.array(F.struct(F.col("o_orderpriority").alias("name"))).alias("artist-credit"), F.when(k % 5 > 0, F.array(F.struct(F.lit("CD").alias("format"), F.when(k % 2 == 0, k % 20).alias("track-count")))).alias("media"), (k % 30).alias("track-count"),
    )
    answers = table(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.to_json(F.struct(F.array_sort(F.collect_list(release)).alias("releases"))).alias("json"))
    found = catalogues.release_search(answers.select(F.col("o_custkey").cast("string").alias("question"), "json"))
    return found.select("question", "release_id", "artist", "title", "tracks", "detail")


def saved_titles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many titles a program says that it saved and lost."""
    k = F.col("event_id")
    line = F.when(k % 3 == 0, F.concat(F.lit('MSG:5036,260,2,"Copy complete, saved",'), F.lit('"%1 saved, %2 failed",'), F.lit('"'), (k % 7).cast("string"), F.lit('","'), (k % 2).cast("string"), F.lit('"'))).otherwise(F.lit('MSG:1005,0,1,"started"'))
    printed = visits(spark, sf_dir).select(F.concat_ws("-", "user_id", "day").alias("disc_id"), k.alias("line_no"), line.alias("line"))
    return media.saved_titles(printed)


def readable_titles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Probes of titles, of which those of five seconds or more with a picture are titles at all."""
    k = F.col("o_orderkey")
    streams = F.filter(F.array(F.when(k % 4 > 0, F.struct(F.lit("video").alias("codec_type"))), F.struct(F.lit("audio").alias("codec_type"))), lambda x: x.isNotNull())
    probe = F.to_json(F.struct(F.struct((k % 10).cast("string").alias("duration")).alias("format"), streams.alias("streams")))
    return media.readable_titles(table(spark, sf_dir, "orders").select(k.alias("title"), F.when(k % 9 > 0, probe).otherwise("no json").alias("json")))


def moved_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where the files of a dump go when it is known what it is."""
    rows = lines(spark, sf_dir).select("l_orderkey", F.col("pos").alias("number"), F.concat(F.lit("/tmp/"), F.col("l_partkey").cast("string")).alias("path"), F.lit("/out/Console").alias("folder"), F.concat(F.lit("Game "), F.col("l_orderkey").cast("string")).alias("stem"))
    return library.moved(rows, ["l_orderkey"]).select("l_orderkey", F.col("number").alias("pos"), "target", "part")


def answered_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines that a reader answered, as votes for shapes; batches with another number of answers than lines are none."""
    seen = lines(spark, sf_dir).select(F.col("l_orderkey").alias("batch"), "pos", F.col("l_returnflag").alias("key"))
    answers = seen.filter("batch % 3 > 0 or pos > 1").select("batch", "pos", F.lit("x").alias("label"))
    return glyphs.taught(seen, answers).select(F.col("batch").alias("l_orderkey"), "lines", "answers", "accepted")


def dump_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Small questions about albums and dumps, one column each."""
    rows = lines(spark, sf_dir).groupBy("l_orderkey").agg(
        F.collect_set("l_returnflag").alias("artists"), F.max("l_linenumber").alias("last"), F.collect_set("l_linestatus").alias("ids"), F.count_if(F.col("l_quantity") < 5).alias("failed"), F.sum("l_quantity").cast("long").alias("n")
    )
    own = F.transform("artists", lambda a: F.when(a == "R", a).otherwise("own"))
    return rows.select(
        "l_orderkey", predicates.is_compilation(own, F.lit("own")).alias("compilation"), predicates.is_multi_disc(F.col("last") - 2).alias("multi_disc"), predicates.holds(F.col("ids"), F.lit("O")).alias("holds_disc"),
        predicates.nothing_failed(F.col("failed")).alias("complete"), predicates.is_short(F.col("n") * 1000, F.col("n") * 985).alias("short"),
    )


_TRACK = "l_orderkey, pos, CASE WHEN l_returnflag = 'R' THEN 'subtitle' ELSE 'audio' END AS kind, ['eng', 'sv', 'de', 'fra'][l_partkey % 4 + 1] AS tag, l_quantity > 40 AS comment, l_linestatus = 'O' AS pictured"

QUERIES = {
    "select_tracks": (
        select_tracks,
        f"""WITH {LINES_SQL}, t AS (SELECT {_TRACK} FROM lines), k AS (SELECT *, bool_and(comment) FILTER (WHERE kind = 'audio') OVER (PARTITION BY l_orderkey) AS sole FROM t),
        s AS (SELECT *, CASE tag WHEN 'eng' THEN 1 WHEN 'sv' THEN 2 END AS place FROM k WHERE kind = 'subtitle' OR NOT comment OR sole),
        p AS (SELECT *, max(place) OVER (PARTITION BY l_orderkey, kind) AS any_place, min(pos) OVER (PARTITION BY l_orderkey, kind) AS first FROM s)
        SELECT l_orderkey, pos, kind, row_number() OVER (PARTITION BY l_orderkey, kind ORDER BY place NULLS LAST, pos) AS out_pos, kind = 'subtitle' AND pictured AS reads FROM p WHERE place IS NOT NULL OR (kind = 'audio' AND any_place IS NULL AND pos = first)""",
    ),
    "unique_streams": (unique_streams, f"WITH {VISITS_SQL} SELECT min(event_id) AS event_id FROM visits GROUP BY user_id, day, event_type, event_id % 2"),
    "decided_media": (
        decided_media,
        """WITH h AS (SELECT o_custkey AS k, min(o_orderkey) AS o FROM orders GROUP BY 1), j AS (SELECT c_custkey AS k, c_custkey % 3 = 0 AS given, CASE WHEN c_custkey % 4 = 0 THEN c_custkey % 9 + 1 END AS season, CASE WHEN c_custkey % 3 = 0 AND c_custkey % 2 = 0 OR c_custkey % 3 > 0 AND c_custkey % 5 > 0 THEN o END AS o FROM customer LEFT JOIN h ON k = c_custkey), f AS (
          SELECT *, CASE WHEN o IS NOT NULL THEN 'Work ' || o WHEN given THEN 'Title ' || k END AS work, CASE WHEN o IS NOT NULL THEN CASE WHEN o % 2 = 0 THEN 'series' ELSE 'movie' END WHEN given THEN CASE WHEN season IS NULL THEN 'movie' ELSE 'series' END END AS media FROM j)
        SELECT k AS c_custkey, work, media, CAST(CASE WHEN media = 'series' THEN coalesce(season, CASE WHEN o % 4 = 0 THEN 2 END, 1) END AS INT) AS season FROM f""",
    ),
    "relabelled": (
        relabelled,
        f"""WITH {_GLYPHS_SQL}, v AS (SELECT key, label, count(*) AS n FROM seen WHERE label IS NOT NULL GROUP BY 1, 2), r AS (
          SELECT *, row_number() OVER (PARTITION BY key ORDER BY n DESC, label) AS place, sum(n) OVER (PARTITION BY key) AS total FROM v), two AS (
          SELECT key, any_value(total) AS total, max(label) FILTER (WHERE place = 1) AS top, max(n) FILTER (WHERE place = 1) AS top_n, max(label) FILTER (WHERE place = 2) AS second, max(n) FILTER (WHERE place = 2) AS second_n FROM r GROUP BY key), t AS (
          SELECT key, CASE WHEN top_n / total >= 0.3 THEN top WHEN (top_n + second_n) / total >= 0.7 AND second_n >= 8 AND second_n / total >= 0.05 THEN top || '|' || second END AS text FROM two), o AS (SELECT DISTINCT seen.key, text FROM seen LEFT JOIN t ON t.key = seen.key),
        f AS (SELECT CAST(n_nationkey * 7 AS VARCHAR) AS key, CASE WHEN n_nationkey % 2 = 0 THEN 'N' ELSE substring(n_name, 1, 1) END AS fix FROM nation)
        SELECT o.key, coalesce(fix, text) AS text, text IS DISTINCT FROM coalesce(fix, text) AS changed FROM o LEFT JOIN f ON f.key = o.key""",
    ),
    "glyph_files": (
        glyph_files,
        f"""WITH {_GLYPHS_SQL}, v AS (SELECT key, label, count(*) AS n FROM seen WHERE label IS NOT NULL GROUP BY 1, 2), r AS (
          SELECT *, row_number() OVER (PARTITION BY key ORDER BY n DESC, label) AS place, sum(n) OVER (PARTITION BY key) AS total FROM v), two AS (
          SELECT key, any_value(total) AS total, max(label) FILTER (WHERE place = 1) AS top, max(n) FILTER (WHERE place = 1) AS top_n, max(label) FILTER (WHERE place = 2) AS second, max(n) FILTER (WHERE place = 2) AS second_n FROM r GROUP BY key), t AS (
          SELECT key, CASE WHEN top_n / total >= 0.3 THEN top WHEN (top_n + second_n) / total >= 0.7 AND second_n >= 8 AND second_n / total >= 0.05 THEN top || '|' || second END AS text FROM two),
        o AS (SELECT seen.key, count(*) AS count, any_value(text) AS text FROM seen LEFT JOIN t ON t.key = seen.key GROUP BY seen.key)
        SELECT 't' || length(key) AS "table", key, count, text, row_number() OVER (PARTITION BY length(key) ORDER BY count DESC, key) - 1 AS pos FROM o""",
    ),
    "lettering": (
        lettering,
        f"""WITH {LINES_SQL}, s AS (SELECT year(l_shipdate) AS disc, l_linestatus AS language, l_partkey % 300 AS key, count(*) AS n FROM lines GROUP BY ALL), t AS (SELECT DISTINCT p_brand AS name, CAST(substring(p_brand, 7, 2) AS INT) AS pos, p_partkey % 300 AS key FROM part),
        b AS (SELECT DISTINCT name, pos FROM t), a AS (SELECT disc, language, sum(n) AS total FROM s GROUP BY 1, 2), k AS (SELECT disc, language, name, sum(n) AS known FROM s JOIN t USING (key) GROUP BY ALL),
        f AS (SELECT a.disc, b.name, b.pos, min(coalesce(known, 0) / total) AS fit FROM a CROSS JOIN b LEFT JOIN k ON k.disc = a.disc AND k.language = a.language AND k.name = b.name GROUP BY 1, 2, 3),
        x AS (SELECT * FROM f QUALIFY row_number() OVER (PARTITION BY disc ORDER BY fit DESC, pos, name) = 1) SELECT CAST(disc AS INT) AS disc, CASE WHEN fit >= 0.25 THEN name END AS "table", round(fit, 6) AS fit FROM x""",
    ),
    "table_candidates": (
        table_candidates,
        """WITH s AS (SELECT p_brand, 0 AS r, min('/t/' || p_partkey || '.json') AS path FROM part GROUP BY 1), f AS (SELECT p_brand, 1 AS r, '/t/' || p_partkey || '.json' AS path FROM part WHERE p_partkey % 3 <> 0),
        u AS (SELECT *, lag(path) OVER (PARTITION BY p_brand ORDER BY r, path) AS before FROM (SELECT * FROM s UNION ALL SELECT * FROM f))
        SELECT p_brand, path, row_number() OVER (PARTITION BY p_brand ORDER BY r, path) - 1 AS pos FROM u WHERE path IS DISTINCT FROM before""",
    ),
    "dictionaries": (
        dictionaries,
        """WITH f(dir, name, code) AS (VALUES (1, 'de_AT.dic', 'de'), (1, 'de.dic', 'de'), (0, 'en_GB.dic', 'en'), (0, 'fra.dic', 'fra'), (0, 'fr_FR.dic', 'fr'))
        SELECT code, '/d' || dir || '/' || name AS path FROM f WHERE code IN (SELECT lang FROM documents)""",
    ),
    "picked_drives": (
        picked_drives,
        f"""WITH {VISITS_SQL}, d AS (SELECT user_id, CAST(day AS VARCHAR) AS device, bool_or(event_type = 'error') AS loaded FROM visits GROUP BY user_id, day), l AS (SELECT user_id, coalesce(list_sort(list(device) FILTER (WHERE loaded)), []) AS l FROM d GROUP BY 1)
        SELECT user_id, CASE WHEN len(l) = 1 THEN l[1] END AS device, CASE WHEN len(l) = 0 THEN 'no drive holds a disc' WHEN len(l) > 1 THEN 'several drives hold a disc: ' || array_to_string(l, ', ') END AS problem FROM l""",
    ),
    "reader_pages": (reader_pages, "SELECT conv_id, CASE WHEN conv_id % 5 <> 0 THEN string_agg(coalesce(role, ''), '|' ORDER BY turn, role) END AS pages FROM conversations GROUP BY conv_id"),
    "release_search": (
        release_search,
        """SELECT CAST(o_custkey AS VARCHAR) AS question, 'r' || o_orderkey AS release_id, o_orderpriority AS artist, 'Album ' || o_orderkey AS title, CASE WHEN o_orderkey % 5 > 0 AND o_orderkey % 2 = 0 THEN o_orderkey % 20 ELSE o_orderkey % 30 END AS tracks,
          concat_ws(' - ', CASE WHEN o_orderkey % 3 > 0 THEN strftime(o_orderdate, '%Y') END, CASE WHEN o_orderkey % 4 > 0 THEN 'SE' END, CASE WHEN o_orderkey % 5 > 0 THEN 'CD' END,
            (CASE WHEN o_orderkey % 5 > 0 AND o_orderkey % 2 = 0 THEN o_orderkey % 20 ELSE o_orderkey % 30 END) || ' tracks') AS detail FROM orders""",
    ),
    "saved_titles": (saved_titles, f"WITH {VISITS_SQL} SELECT user_id || '-' || day AS disc_id, CAST(min(event_id) % 7 AS INT) AS saved, CAST(min(event_id) % 2 AS INT) AS failed FROM visits WHERE event_id % 3 = 0 GROUP BY user_id, day"),
    "readable_titles": (readable_titles, "SELECT o_orderkey AS title, (o_orderkey % 10) * 1000 AS duration_ms FROM orders WHERE o_orderkey % 9 > 0 AND o_orderkey % 4 > 0 AND o_orderkey % 10 >= 5"),
    "moved_files": (
        moved_files,
        f"""WITH {LINES_SQL}, n AS (SELECT *, count(*) OVER (PARTITION BY l_orderkey) > 1 AS several, 'Game ' || l_orderkey AS stem FROM lines), t AS (
          SELECT l_orderkey, pos, '/out/Console/' || CASE WHEN several THEN stem || '/' || stem || format(' (Track {{:02d}}).bin', pos) ELSE stem || '.iso' END AS target FROM n) SELECT *, target || '.part' AS part FROM t""",
    ),
    "answered_lines": (
        answered_lines,
        f"WITH {LINES_SQL}, c AS (SELECT l_orderkey, count(*) AS lines, count(*) FILTER (WHERE l_orderkey % 3 > 0 OR pos > 1) AS answers FROM lines GROUP BY 1) SELECT *, lines = answers AS accepted FROM c",
    ),
    "dump_flags": (
        dump_flags,
        """WITH c AS (SELECT l_orderkey, bool_or(l_returnflag = 'R') AS compilation, max(l_linenumber) > 3 AS multi_disc, bool_or(l_linestatus = 'O') AS holds_disc, count(*) FILTER (WHERE l_quantity < 5) = 0 AS complete, CAST(sum(l_quantity) AS BIGINT) AS n FROM lineitem GROUP BY 1)
        SELECT l_orderkey, compilation, multi_disc, holds_disc, complete, n * 15 > 3000 OR n * 15 > n * 1000 * 0.02 AS short FROM c""",
    ),
}
