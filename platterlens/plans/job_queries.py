"""Queries of jobs: items that fail alone, dumps checked in stages, scans, salvage, samples, scratch, mounts and streams."""

from __future__ import annotations

import uuid

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import checksums, intervals, jobs, matching
from ..shared import shared_folder
from ..sources import versions
from ..streaming import jobs as streams
from .counting_queries import _BYTES_SQL, _CODE_SQL, _TABLE_SQL
from .tables import LINES_SQL, VISITS_SQL, lines, table, visits


def _items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as items to produce: some were never probed, some say no length, and some have no picture."""
    k = F.col("o_orderkey")
    length = F.when(k % 7 != 0, F.when(k % 11 == 0, "N/A").otherwise(F.col("o_totalprice").cast("string")))
    return table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", length.alias("length"), F.when(k % 13 != 0, F.col("o_orderstatus")).alias("picture"))


_ITEMS_SQL = """items AS (
  SELECT o_orderkey, o_custkey, CASE WHEN o_orderkey % 7 <> 0 AND o_orderkey % 11 <> 0 THEN CAST(round(o_totalprice * 1000) AS BIGINT) END AS bytes,
         CASE WHEN o_orderkey % 7 = 0 THEN 'never probed' WHEN o_orderkey % 11 = 0 THEN 'no length in N/A' WHEN o_orderkey % 13 = 0 THEN 'no picture' END AS error FROM orders
), attempts AS (SELECT o_orderkey, o_custkey, error IS NULL AS ok, CASE WHEN error IS NULL THEN bytes END AS value, error FROM items)"""


def _attempts(spark: SparkSession, sf_dir: str) -> DataFrame:
    number = F.col("length").try_cast("double")
    checks = [(F.col("length").isNull(), F.lit("never probed")), (number.isNull(), F.concat(F.lit("no length in "), "length")), (F.col("picture").isNull(), F.lit("no picture"))]
    return jobs.attempted(_items(spark, sf_dir), checks, F.round(F.col("length").cast("double") * 1000).cast("long"))


def item_attempts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every item with its outcome, from the two tables that one pass files them in."""
    good, bad, _ = jobs.filed(_attempts(spark, sf_dir), f"{shared_folder(spark)}/attempts-{uuid.uuid4().hex}")
    return good.unionByName(bad).select("o_orderkey", "ok", "value", "error")


def isolated_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same by a function of batches that an unreadable length breaks: those items alone fail."""
    import pyarrow as pa
    import pyarrow.compute as pc
    from pyspark.sql import types as T

    def work(batch: pa.RecordBatch) -> pa.Array:
        return pc.cast(pc.round(pc.multiply(pc.cast(batch.column("length"), pa.float64()), 1000.0)), pa.int64())

    return jobs.isolating(_items(spark, sf_dir), work, T.LongType(), 256).select("o_orderkey", "ok", "value")


def item_reports(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A report for each customer, as lines."""
    name = F.concat(F.lit("t"), F.col("o_orderkey").cast("string"), F.lit(".mkv"))
    out = F.concat(F.lit("Order "), F.col("o_orderkey").cast("string"), F.lit(".mkv"))
    found = jobs.reports(_attempts(spark, sf_dir), ["o_custkey"], name, out, "o_orderkey")
    return found.select("o_custkey", "produced", "skipped", "bytes", "complete", F.array_join("lines", "\n").alias("told"))


def _sectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts as the sectors of dumps, four each: a third of the first mode, some with the code that they should have, and every
    fifth dump one of sound."""
    k = F.col("p_partkey")
    empty = checksums.SYNC + b"\x00\x02\x00\x02\x00\x00\x20" + bytes(2333)  # of a form that need not tell a code
    coded = [checksums.SYNC + bytes((0, 2, i, 1)) + bytes(2048) for i in range(4)]
    codes = [int(checksums.edc(np.frombuffer(c, np.uint8).reshape(1, -1))[0]).to_bytes(4, "little") for c in coded]
    whole = F.element_at(F.array(*(F.lit(c + code + bytes(284)) for c, code in zip(coded, codes))), (k % 4 + 1).cast("int"))
    wrong = F.substring(F.concat(F.lit(coded[0]), F.rpad(F.col("p_name").cast("binary"), 288, F.lit(b"\x00"))), 1, 2352)
    raw = F.when(F.floor(k / 4) % 5 == 0, F.lit(bytes(2352))).when(F.floor(k / 4) % 5 == 1, whole).when((k % 16 == 9), wrong).when(k % 4 == 0, F.lit(empty)).otherwise(whole)
    return table(spark, sf_dir, "part").select(F.floor(k / 4).cast("long").alias("dump_id"), (k % 4).alias("sector_pos"), "p_name", raw.alias("raw"))


def checked_dumps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Dumps checked by digest, and those that no datfile has by their own sectors."""
    sectors = _sectors(spark, sf_dir)
    content = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("sector_pos", "p_name"))), lambda x: x.p_name), "/")
    names = sectors.groupBy("dump_id").agg(content.alias("content"))
    dumps = checksums.digests(names).select("dump_id", "bytes", F.crc32(F.col("content").cast("binary")).alias("crc32"), "sha1")
    known = dumps.filter("dump_id % 3 = 0")
    at = F.col("dump_id")
    roms = known.select((at % 4).alias("dat_pos"), at.alias("game_pos"), F.lit(0).alias("rom_pos"), F.concat(F.lit("Game "), at.cast("string")).alias("game"), F.lit("a.bin").alias("name"), F.col("bytes").alias("size"), "crc32", "sha1")
    found = checksums.dump_checks(matching.match_digests(dumps, roms), sectors)
    return found.select("dump_id", "game", "verdict", "sectors", "bad", "unchecked")


def plain_sectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which sectors a line begins with lie in ranges that are not scrambled; ranges overlap and nest, one map for each status."""
    rows = table(spark, sf_dir, "orders")
    ranges = rows.select(F.col("o_orderstatus").alias("m"), (F.col("o_orderkey") * 37 % 100_000).alias("start"), (F.col("o_orderkey") * 37 % 100_000 + F.col("o_custkey") % 9).alias("end"))
    points = rows.select(F.col("o_orderstatus").alias("m"), "o_orderkey", (F.col("o_orderkey") * 53 % 100_000).alias("at"))
    return intervals.covered(points, ranges, ["m"]).select("o_orderkey", "covered")


def taken_titles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines as probes of an order's titles: a scan ends at the first that tells of a key that could not be found."""
    took, health = jobs.scanned(lines(spark, sf_dir).select("l_orderkey", "pos", "l_quantity", "l_tax"), ["l_orderkey"], "pos", F.col("l_tax") >= 0.07, F.col("l_quantity") >= 5)
    found = took.filter("title").groupBy("l_orderkey").agg(F.array_join(F.transform(F.array_sort(F.collect_list("pos")), lambda x: x.cast("string")), ",").alias("titles"))
    return health.join(found, "l_orderkey", "left").select("l_orderkey", "declared", "taken", "decoded", "trusted", F.coalesce("titles", F.lit("")).alias("titles"))


def salvaged_chapters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines as chapters of an order's title, of which those that were returned can't be read."""
    found = jobs.salvaged(lines(spark, sf_dir).select("l_orderkey", "pos", "l_returnflag"), ["l_orderkey"], "pos", F.col("l_returnflag") != "R")
    return found.select("l_orderkey", "kept", F.array_join(F.transform("lost", lambda x: x.cast("string")), ",").alias("lost"), "runs", "told")


def sampled_cues(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Users' days as tracks of a language, events as cues with a number of shapes each: what of them a table is judged by."""
    cues = visits(spark, sf_dir).select(F.col("user_id").alias("language"), F.col("day").alias("track"), F.col("event_id").alias("cue"), (F.col("event_id") % 9).alias("shapes"))
    return jobs.sampled(cues, ["language"], 3, 5, 40).select(F.col("cue").alias("event_id"))


def cleared_scratch(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as files of their customer's folder; what a run recorded for every third of them goes, and nothing else."""
    k = F.col("o_orderkey")
    o = table(spark, sf_dir, "orders")
    record = o.filter("o_orderkey % 3 = 0").select("o_custkey", F.concat(F.lit("title.t"), (k % 40).cast("string"), F.lit(".mkv")).alias("output_name"))
    ending = F.element_at(F.array(*map(F.lit, (".mkv", ".mkv.part", ".eng.srt", "0.mkv", ""))), (k % 5 + 1).cast("int"))
    files = o.select("o_custkey", F.concat(F.lit("title.t"), (k % 40).cast("string"), ending).alias("name"))
    return jobs.cleared(files, record, ["o_custkey"])


def mounted_devices(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers as arguments of a program, on machines whose nations' folders are mounted, some within others."""
    k = F.col("c_custkey")
    where = F.concat(F.lit("/media/n"), F.col("c_nationkey").cast("string"), F.when(k % 3 > 0, F.concat(F.lit("/my disc"), (k % 4).cast("string"))).otherwise(""))
    asked = F.when(k % 7 == 0, F.concat(F.lit("/dev/sr"), (k % 9).cast("string"))).when(k % 2 == 0, F.concat(F.lit("file://"), F.replace(where, F.lit(" "), F.lit("%20")), F.lit("/"))).otherwise(F.concat(where, F.when(k % 5 == 0, "/VIDEO_TS").otherwise("")))
    arguments = table(spark, sf_dir, "customer").select("c_custkey", (F.col("c_nationkey") % 2).alias("machine"), asked.alias("argument"))
    n = F.col("n_nationkey")
    roots = table(spark, sf_dir, "nation").select((n % 2).alias("machine"), F.concat(F.lit("/dev/sd"), n.cast("string")).alias("device"), F.concat(F.lit("/media/n"), n.cast("string")).alias("at"), n.alias("pos"))
    inner = roots.select("machine", F.when(F.col("pos") % 4 == 3, "tmpfs").otherwise(F.concat("device", F.lit("p1"))).alias("device"), F.concat("at", F.lit("/my\\040disc1")).alias("at"), (F.col("pos") + 100).alias("pos"))
    found = jobs.devices(arguments, roots.unionByName(inner), ["machine"])
    return found.select("c_custkey", "device", "within")


def published_settings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Settings of each segment, published twice; a third version is staged and never made the one that counts."""
    folder = f"{shared_folder(spark)}/settings-{uuid.uuid4().hex}"
    of = lambda least: table(spark, sf_dir, "customer").filter(F.col("c_acctbal") >= least).groupBy("c_mktsegment").agg(F.count("*").alias("n"))
    default = spark.createDataFrame([], "c_mktsegment string, n long")
    before = versions.published(default, folder)
    versions.publish(before.unionByName(of(0)), folder)
    versions.publish(versions.published(default, folder).unionByName(of(5000)), folder)
    versions.staged(of(-10_000), folder)
    return versions.published(default, folder)


def _stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    source = table(spark, sf_dir, "events")
    stream = spark.readStream.schema(source.schema).option("pathGlobFilter", "events.parquet").parquet(sf_dir)
    return stream.select(F.col("user_id").alias("job"), F.col("event_id").alias("pos"), "event_type", (F.col("event_id") * 7 % 101 / 100).alias("fraction"))


def rising_progress(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as progress of a user's job: what is told is never less than before."""
    from ..streaming.eventlog import drained

    return drained(streams.rising(_stream(spark, sf_dir)), shared_folder(spark), f"rising-{uuid.uuid4().hex}").select(F.col("pos").alias("event_id"), "fraction")


def _line() -> Column:
    return F.when(F.col("event_type") == "error", F.concat(F.lit("   warning: "), F.col("job").cast("string"))).otherwise(F.concat(F.lit("== "), "event_type"))


def event_sinks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One stream into a log, which leaves progress out, and a table of progress; both read back."""
    folder = f"{shared_folder(spark)}/sinks-{uuid.uuid4().hex}"
    progress = F.col("event_type") == "view"
    sinks = {
        "log": lambda b: b.filter(~progress).select(F.col("pos").alias("event_id"), _line().alias("told")),
        "seen": lambda b: b.filter(progress).select(F.col("pos").alias("event_id"), F.format_string("%.2f", "fraction").alias("told")),
    }
    found = streams.fanned_out(_stream(spark, sf_dir), folder, sinks)
    return found["log"].withColumn("sink", F.lit("log")).unionByName(found["seen"].withColumn("sink", F.lit("seen"))).select("sink", "event_id", "told")


QUERIES = {
    "item_attempts": (item_attempts, f"WITH {_ITEMS_SQL} SELECT o_orderkey, ok, value, error FROM attempts"),
    "isolated_items": (
        isolated_items,
        "SELECT o_orderkey, NOT (o_orderkey % 7 <> 0 AND o_orderkey % 11 = 0) AS ok, CASE WHEN o_orderkey % 7 <> 0 AND o_orderkey % 11 <> 0 THEN CAST(round(o_totalprice * 1000) AS BIGINT) END AS value FROM orders",
    ),
    "item_reports": (
        item_reports,
        f"""WITH {_ITEMS_SQL} SELECT o_custkey, count(*) FILTER (WHERE ok) AS produced, count(*) FILTER (WHERE NOT ok) AS skipped, CAST(coalesce(sum(value), 0) AS BIGINT) AS bytes, bool_and(ok) AS complete,
          count(*) FILTER (WHERE ok) || ' files, ' || printf('%.1f MiB', coalesce(sum(value), 0) / 1048576) || chr(10) ||
          string_agg(CASE WHEN ok THEN '  Order ' || o_orderkey || '.mkv  ' || printf('%.1f MiB', value / 1048576) ELSE '  FAILED t' || o_orderkey || '.mkv: ' || error END, chr(10) ORDER BY NOT ok, o_orderkey) AS told
        FROM attempts GROUP BY o_custkey""",
    ),
    "checked_dumps": (
        checked_dumps,
        f"""WITH head AS (SELECT *, p_partkey // 4 AS d, p_partkey % 4 AS s, '00' || repeat('FF', 10) || '00000200' AS sync FROM part), t AS (SELECT {_TABLE_SQL.format(0xD8018001)} AS t), raw AS (
          SELECT d, s, p_name, CASE WHEN d % 5 = 0 THEN 'audio' WHEN d % 5 = 1 THEN 'whole' WHEN p_partkey % 16 = 9 THEN sync || '01' || repeat('00', 2048) || rpad(upper(hex(encode(p_name))), 576, '0')
                 WHEN s = 0 THEN 'empty' ELSE 'whole' END AS r FROM head), e AS (
          SELECT d, s, p_name, r = 'audio' AS sound, r = 'whole' AS known, r = 'empty' AS empty, CASE WHEN r NOT IN ('audio', 'whole', 'empty') THEN {_BYTES_SQL.format("r")} END AS bytes FROM raw), c AS (
          SELECT d, s, p_name, sound, known, empty, CASE WHEN bytes IS NOT NULL THEN {_CODE_SQL.format("bytes[1:2064]", 0)} <> bytes[2065] + (bytes[2066] << 8) + (bytes[2067] << 16) + (bytes[2068] << 24) ELSE false END AS corrupt,
                 CASE WHEN sound OR known THEN false ELSE s <> 0 END AS misplaced FROM e, t), dumps AS (
          SELECT d, bool_or(sound AND s = 0) AS no_data, count(*) AS n, count(*) FILTER (WHERE corrupt) + count(*) FILTER (WHERE misplaced) AS bad, count(*) FILTER (WHERE empty) AS unchecked FROM c GROUP BY d), known AS (
          SELECT d, string_agg(p_name, '/' ORDER BY s) AS content FROM c GROUP BY d), games AS (SELECT content, min_by(d, (d % 4) * 1000000000000 + d) AS g FROM known WHERE d % 3 = 0 GROUP BY content)
        SELECT d AS dump_id, 'Game ' || g AS game, CASE WHEN g IS NOT NULL THEN 'verified' WHEN no_data THEN 'unknown' WHEN bad = 0 THEN 'sound' ELSE 'misread' END AS verdict,
               CASE WHEN g IS NULL AND NOT no_data THEN n END AS sectors, CASE WHEN g IS NULL AND NOT no_data THEN bad END AS bad, CASE WHEN g IS NULL AND NOT no_data THEN unchecked END AS unchecked
        FROM dumps JOIN known USING (d) LEFT JOIN games USING (content)""",
    ),
    "plain_sectors": (
        plain_sectors,
        """SELECT o_orderkey, EXISTS (SELECT 1 FROM orders r WHERE r.o_orderstatus = o.o_orderstatus AND r.o_orderkey * 37 % 100000 <= o.o_orderkey * 53 % 100000
          AND o.o_orderkey * 53 % 100000 < r.o_orderkey * 37 % 100000 + r.o_custkey % 9) AS covered FROM orders o""",
    ),
    "taken_titles": (
        taken_titles,
        f"""WITH {LINES_SQL}, stops AS (SELECT l_orderkey, min(pos) FILTER (WHERE l_tax >= 0.07) AS stop, count(*) AS declared FROM lines GROUP BY 1), took AS (
          SELECT l.*, stop, declared, l_quantity >= 5 AND (stop IS NULL OR pos < stop) AS title FROM lines l JOIN stops USING (l_orderkey) WHERE stop IS NULL OR pos <= stop)
        SELECT l_orderkey, any_value(declared) AS declared, count(*) AS taken, count(*) FILTER (WHERE title) AS decoded, bool_and(stop IS NULL) AS trusted, coalesce(string_agg(CAST(pos AS VARCHAR), ',' ORDER BY pos) FILTER (WHERE title), '') AS titles
        FROM took GROUP BY l_orderkey""",
    ),
    "salvaged_chapters": (
        salvaged_chapters,
        f"""WITH {LINES_SQL}, kept AS (SELECT l_orderkey, pos, pos - row_number() OVER (PARTITION BY l_orderkey ORDER BY pos) AS g FROM lines WHERE l_returnflag <> 'R'), runs AS (
          SELECT l_orderkey, min(pos) AS a, max(pos) AS b FROM kept GROUP BY l_orderkey, g), told AS (SELECT l_orderkey, string_agg(CASE WHEN a = b THEN CAST(a AS VARCHAR) ELSE a || '-' || b END, ',' ORDER BY a) AS runs FROM runs GROUP BY 1), s AS (
          SELECT l_orderkey, count(*) FILTER (WHERE l_returnflag <> 'R') AS kept, count(*) FILTER (WHERE l_returnflag = 'R') AS n, string_agg(CAST(pos AS VARCHAR), ', ' ORDER BY pos) FILTER (WHERE l_returnflag = 'R') AS lost FROM lines GROUP BY 1)
        SELECT l_orderkey, kept, coalesce(replace(lost, ' ', ''), '') AS lost, coalesce(runs, '') AS runs, CASE WHEN n > 0 AND kept > 0 THEN 'recovered without chapter' || CASE WHEN n > 1 THEN 's ' ELSE ' ' END || lost END AS told
        FROM s LEFT JOIN told USING (l_orderkey)""",
    ),
    "sampled_cues": (
        sampled_cues,
        f"""WITH {VISITS_SQL}, cues AS (SELECT user_id, day, event_id, event_id % 9 AS n, dense_rank() OVER (PARTITION BY user_id ORDER BY day) AS track, row_number() OVER (PARTITION BY user_id, day ORDER BY event_id) AS nth FROM visits),
          looked AS (SELECT * FROM cues WHERE track <= 3 AND nth <= 5), sums AS (SELECT user_id, track, sum(n) AS n FROM looked GROUP BY ALL),
          opened AS (SELECT user_id, track, coalesce(sum(n) OVER (PARTITION BY user_id ORDER BY track ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM sums)
        SELECT event_id FROM looked JOIN opened USING (user_id, track) WHERE before < 40""",
    ),
    "cleared_scratch": (
        cleared_scratch,
        """WITH files AS (SELECT DISTINCT o_custkey, 'title.t' || o_orderkey % 40 || ['.mkv', '.mkv.part', '.eng.srt', '0.mkv', ''][o_orderkey % 5 + 1] AS name FROM orders)
        SELECT * FROM files f WHERE EXISTS (SELECT 1 FROM orders r WHERE r.o_custkey = f.o_custkey AND r.o_orderkey % 3 = 0 AND starts_with(f.name, 'title.t' || r.o_orderkey % 40 || '.'))""",
    ),
    "mounted_devices": (
        mounted_devices,
        r"""WITH c AS (SELECT c_custkey AS k, c_nationkey AS n, '/media/n' || c_nationkey || CASE WHEN c_custkey % 3 > 0 THEN '/my disc' || c_custkey % 4 ELSE '' END || CASE WHEN c_custkey % 2 = 1 AND c_custkey % 5 = 0 THEN '/VIDEO_TS' ELSE '' END AS path FROM customer),
          mounts AS (SELECT '/dev/sd' || n_nationkey AS device, '/media/n' || n_nationkey AS place FROM nation UNION ALL SELECT '/dev/sd' || n_nationkey || 'p1', '/media/n' || n_nationkey || '/my disc1' FROM nation WHERE n_nationkey % 4 <> 3)
        SELECT k AS c_custkey, CASE WHEN k % 7 = 0 THEN '/dev/sr' || k % 9 ELSE (SELECT max(device) FROM mounts WHERE place = path) END AS device,
               CASE WHEN k % 7 = 0 THEN '/dev/sr' || k % 9 ELSE (SELECT arg_max(device, length(place)) FROM mounts WHERE path = place OR starts_with(path, place || '/')) END AS within FROM c""",
    ),
    "published_settings": (
        published_settings,
        "SELECT c_mktsegment, count(*) AS n FROM customer WHERE c_acctbal >= 0 GROUP BY 1 UNION ALL SELECT c_mktsegment, count(*) FROM customer WHERE c_acctbal >= 5000 GROUP BY 1",
    ),
    "rising_progress": (
        rising_progress,
        """WITH p AS (SELECT event_id, event_id * 7 % 101 / 100 AS fraction, max(event_id * 7 % 101) OVER (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before, event_id * 7 % 101 AS now FROM events)
        SELECT event_id, CAST(fraction AS DOUBLE) AS fraction FROM p WHERE before IS NULL OR now > before""",
    ),
    "event_sinks": (
        event_sinks,
        """SELECT CASE WHEN event_type = 'view' THEN 'seen' ELSE 'log' END AS sink, event_id, CASE WHEN event_type = 'view' THEN printf('%.2f', event_id * 7 % 101 / 100) WHEN event_type = 'error' THEN '   warning: ' || user_id ELSE '== ' || event_type END AS told FROM events""",
    ),
}
