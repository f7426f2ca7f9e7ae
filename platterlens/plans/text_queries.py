"""Queries over strings, times and files, and the event log as a stream."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import strings, times
from ..operators import intervals
from ..shared import shared_folder
from ..sources import media, texts
from ..streaming import eventlog
from .tables import LINES_SQL, VISITS_SQL, lines, table, visits


def label_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Volume labels put together from customers in four ways, and read again."""
    k, seg = F.col("c_custkey"), F.col("c_mktsegment")
    s = lambda n, add=0: (k % n + add).cast("string")
    label = (
        F.when(k % 4 == 0, F.concat(F.lit("A_"), seg, F.lit("_SEASON_"), s(7, 1), F.lit("_DISC_"), s(3, 1)))
        .when(k % 4 == 1, F.concat(seg, F.lit("  "), s(230, 1890), F.lit(".DVD-PAL")))
        .when(k % 4 == 2, F.concat(seg, F.lit("-S"), s(9, 1), F.lit("D"), s(5, 1)))
        .otherwise(F.concat(F.lit("The+"), seg, F.lit("+Bonus+r2d2")))
    )
    read = strings.parse_label(label)
    return table(spark, sf_dir, "customer").select("c_custkey", read.alias("r")).select("c_custkey", "r.title", F.col("r.season").cast("long").alias("season"), F.col("r.disc").cast("long").alias("disc"), F.col("r.year").cast("long").alias("year"))


def sanitize_name(spark: SparkSession, sf_dir: str) -> DataFrame:
    name = F.concat(F.coalesce("url", F.lit("")), F.lit(" .. "))
    return table(spark, sf_dir, "pages").select("page_id", strings.sanitize(name).alias("name"), strings.slug(F.col("url")).alias("slug"))


def render_template(spark: SparkSession, sf_dir: str) -> DataFrame:
    fields = {"title": F.concat(F.lit("Order: "), F.col("o_orderpriority")), "season": F.col("o_custkey") % 30, "number": F.col("o_orderkey"), "blank": F.lit("")}
    path = strings.render_path("{title}/{blank}/Season {season}/{title} - S{season}E{number:8} {unknown} {", **fields)
    return table(spark, sf_dir, "orders").select("o_orderkey", F.array_join(path, "/").alias("path"), strings.episode_code((F.col("o_custkey") % 30).cast("int"), F.col("o_orderkey")).alias("code"))


def srt_timestamp(spark: SparkSession, sf_dir: str) -> DataFrame:
    of_day = F.col("ms") % 86_400_000
    rows = visits(spark, sf_dir).select("event_id", of_day.alias("at"), times.timestamp_text(of_day).alias("text"))
    return rows.select("event_id", "text", times.hms(F.col("at")).alias("hms"), (times.parse_timestamp(F.col("text")) == F.col("at")).alias("read_back"))


def msf(spark: SparkSession, sf_dir: str) -> DataFrame:
    frames = F.col("l_partkey") * 7 + F.col("l_linenumber")
    return table(spark, sf_dir, "lineitem").select("l_orderkey", F.col("l_linenumber").cast("long").alias("l_linenumber"), times.msf(frames).alias("msf"), times.frames_to_ms(frames).alias("ms"))


def episode_numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    ending = F.when(F.col("o_orderkey") % 5 == 0, ".txt").otherwise(".mkv")
    name = F.concat(F.lit("Show - s0"), (F.col("o_custkey") % 9).cast("string"), F.lit("e"), F.col("o_orderkey").cast("string"), F.lit(" - Elms"), ending)
    return table(spark, sf_dir, "orders").select("o_orderkey", F.array_join(F.transform(strings.episode_numbers(name), lambda x: x.cast("string")), ",").alias("numbers"), strings.stem(name).alias("stem"))


def json_project(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select("event_id", F.from_json("props", "k bigint")["k"].alias("k"))


def eav_pivot(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of orders as the lines of a disc's log, later lines overwriting, and the titles they tell of."""
    n, title = F.col("pos").cast("string"), (F.col("pos") % 2).cast("string")
    said = lambda attr, value: F.concat(F.lit("TINFO:"), title, F.lit(f",{attr},0,\""), value, F.lit('"'))
    said_of = lines(spark, sf_dir).select(
        F.col("l_orderkey").cast("string").alias("disc_id"), F.col("pos").alias("at"),
        F.array(said(2, F.concat(F.lit('Part ""'), n, F.lit('"", '), F.col("l_returnflag"))), said(8, n), said(9, F.concat(F.lit("1:02:0"), n)), said(11, F.col("l_partkey").cast("string")), F.lit("MSG:1005,0,1")).alias("said"),
    )
    log = said_of.select("disc_id", F.posexplode("said").alias("i", "line"), (F.col("at") * 10).alias("base")).select("disc_id", (F.col("base") + F.col("i")).alias("line_no"), "line")
    found = media.titles(media.attributes(log))
    return found.select(F.col("disc_id").cast("long").alias("l_orderkey"), F.col("title").cast("long").alias("title"), "name", F.col("chapters").cast("long").alias("chapters"), "duration_ms", "size")


def html_entities(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select("page_id", F.sha1(strings.unescape_xml(F.col("html")).cast("binary")).alias("plain_sha1"), F.sha1(strings.escape_html(F.col("html")).cast("binary")).alias("escaped_sha1"))


def chain_numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("o_orderkey")
    spec = F.concat((k % 5).cast("string"), F.lit("-"), (k % 5 + 3).cast("string"), F.lit(","), (k % 11).cast("string"))
    orders = table(spark, sf_dir, "orders").select("o_orderkey", spec.alias("spec"))
    return intervals.chain_numbers(orders, F.col("spec")).select("o_orderkey", F.array_join(F.transform("numbers", lambda x: x.cast("string")), ",").alias("numbers"))


def subtitle_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each user's day of events as a subtitle file, written, read and counted."""
    rows = visits(spark, sf_dir).select(F.concat_ws("-", "user_id", "day").alias("stream_id"), F.col("event_id").alias("seq"), F.col("ms").alias("start_ms"), (F.col("ms") + 900).alias("end_ms"), F.col("event_type").alias("text"))
    files = texts.subtitle_text(rows)
    return texts.cues(files).groupBy("stream_id").agg(F.count("*").alias("n"), F.sum("start_ms").alias("starts"), F.sum(F.col("end_ms") - F.col("start_ms")).alias("shown_ms"))


def recovery_map_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts as runs of their brand's recovery map, as its lines."""
    states = F.array(*map(F.lit, texts.STATES.values()))
    runs = table(spark, sf_dir, "part").select(F.col("p_brand").alias("map_id"), (F.col("p_partkey") * 2048).alias("start"), (F.col("p_partkey") * 2048 + F.col("p_size")).alias("end"), F.get(states, (F.col("p_partkey") % 5).cast("int")).alias("state"))
    return texts.map_lines(runs).select("start", "line")


def event_log_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The event log as a stream, drained of what is there: views are its progress and are dropped."""
    source = table(spark, sf_dir, "events")
    stream = spark.readStream.schema(source.schema).option("pathGlobFilter", "events.parquet").parquet(sf_dir).withColumn("ts", F.col("ts").cast("timestamp"))
    return eventlog.drained(eventlog.log_lines(stream, "view"), shared_folder(spark), f"eventlog-{uuid.uuid4().hex}")


QUERIES = {
    "label_parse": (
        label_parse,
        """WITH c AS (SELECT c_custkey AS k, upper(c_mktsegment) AS u, c_mktsegment[1] || lower(c_mktsegment[2:]) AS seg FROM customer)
        SELECT k AS c_custkey, CASE k % 4 WHEN 0 THEN 'A ' || seg WHEN 1 THEN seg || ' ' || (k % 230 + 1890) WHEN 2 THEN seg ELSE 'The ' || seg || ' R2D2' END AS title,
               CASE k % 4 WHEN 0 THEN k % 7 + 1 WHEN 2 THEN k % 9 + 1 END AS season, CASE k % 4 WHEN 0 THEN k % 3 + 1 WHEN 2 THEN k % 5 + 1 END AS disc,
               CASE WHEN k % 4 = 1 AND k % 230 + 1890 BETWEEN 1900 AND 2099 THEN k % 230 + 1890 END AS year FROM c""",
    ),
    "sanitize_name": (
        sanitize_name,
        r"""WITH s AS (SELECT page_id, url, trim(regexp_replace(translate(replace(coalesce(url, '') || ' .. ', ':', ' - '), '/\<>"|?*', '--------'), ' +', ' ', 'g'), ' ') AS s FROM pages)
        SELECT page_id, rtrim(regexp_replace(s, '\.+$', '')) AS name, trim(regexp_replace(lower(url), '[^a-z0-9]', '-', 'g'), '-') AS slug FROM s""",
    ),
    "render_template": (
        render_template,
        """WITH o AS (SELECT o_orderkey, 'Order - ' || o_orderpriority AS t, lpad(CAST(o_custkey % 30 AS VARCHAR), 2, '0') AS s, CAST(o_orderkey AS VARCHAR) AS n FROM orders)
        SELECT o_orderkey, t || '/Season ' || s || '/' || t || ' - S' || s || 'E' || CASE WHEN length(n) < 8 THEN lpad(n, 8, '0') ELSE n END || ' {unknown} {' AS path,
               'S' || s || 'E' || CASE WHEN length(n) < 2 THEN '0' || n ELSE n END AS code FROM o""",
    ),
    "srt_timestamp": (
        srt_timestamp,
        f"""WITH {VISITS_SQL}, a AS (SELECT event_id, ms % 86400000 AS m FROM visits)
        SELECT event_id, printf('%02d:%02d:%02d,%03d', m // 3600000, m // 60000 % 60, m // 1000 % 60, m % 1000) AS text, printf('%d:%02d:%02d', m // 3600000, m // 60000 % 60, m // 1000 % 60) AS hms, true AS read_back FROM a""",
    ),
    "msf": (
        msf,
        "WITH f AS (SELECT l_orderkey, l_linenumber, l_partkey * 7 + l_linenumber AS f FROM lineitem) SELECT l_orderkey, CAST(l_linenumber AS BIGINT) AS l_linenumber, printf('%02d:%02d:%02d', f // 4500, f // 75 % 60, f % 75) AS msf, f * 1000 // 75 AS ms FROM f",
    ),
    "episode_numbers": (
        episode_numbers,
        "SELECT o_orderkey, CASE WHEN o_orderkey % 5 = 0 THEN '' ELSE CAST(o_orderkey AS VARCHAR) END AS numbers, 'Show - s0' || (o_custkey % 9) || 'e' || o_orderkey || ' - Elms' AS stem FROM orders",
    ),
    "json_project": (json_project, "SELECT event_id, CAST(props ->> '$.k' AS BIGINT) AS k FROM events"),
    "eav_pivot": (
        eav_pivot,
        f"""WITH {LINES_SQL} SELECT l_orderkey, pos % 2 AS title, 'Part "' || pos || '", ' || l_returnflag AS name, pos AS chapters, 3720000 + pos * 1000 AS duration_ms, l_partkey AS size
        FROM lines QUALIFY row_number() OVER (PARTITION BY l_orderkey, pos % 2 ORDER BY pos DESC) = 1""",
    ),
    "html_entities": (
        html_entities,
        """SELECT page_id, sha1(replace(replace(replace(replace(replace(replace(replace(html, '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&apos;', chr(39)), '&#39;', chr(39)), '&#34;', '"'), '&amp;', '&')) AS plain_sha1,
           sha1(replace(replace(replace(html, '&', '&amp;'), '<', '&lt;'), '>', '&gt;')) AS escaped_sha1 FROM pages""",
    ),
    "chain_numbers": (
        chain_numbers,
        "SELECT o_orderkey, array_to_string(list_sort(list_distinct(range(o_orderkey % 5, o_orderkey % 5 + 4) || [o_orderkey % 11])), ',') AS numbers FROM orders",
    ),
    "subtitle_round_trip": (
        subtitle_round_trip,
        f"WITH {VISITS_SQL} SELECT user_id || '-' || day AS stream_id, count(*) AS n, CAST(sum(ms) AS BIGINT) AS starts, CAST(count(*) * 900 AS BIGINT) AS shown_ms FROM visits GROUP BY user_id, day",
    ),
    "recovery_map_text": (
        recovery_map_text,
        "SELECT p_partkey * 2048 AS start, format('0x{:08X}  0x{:08X}  ', p_partkey * 2048, CAST(p_size AS BIGINT)) || substring('?*/-+', CAST(p_partkey % 5 + 1 AS INT), 1) AS line FROM part",
    ),
    "event_log_stream": (
        event_log_stream,
        "SELECT event_id, strftime(ts, '%Y-%m-%dT%H%M') || ' ' || event_type || ' ' || user_id AS line FROM events WHERE event_type <> 'view'",
    ),
}
