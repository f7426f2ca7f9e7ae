"""Queries that count, vote, cluster, and follow an order."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import checksums, discs, identify, intervals, sequences, structure, voting
from .tables import DISCS_SQL, LINES_SQL, VISITS_SQL, lines, table, visits
from .tables import discs as toc_tracks


def plurality_vote(spark: SparkSession, sf_dir: str) -> DataFrame:
    votes = table(spark, sf_dir, "events").select(F.col("user_id").alias("key"), F.col("event_type").alias("label"), F.lit(1).alias("n"))
    return voting.settle(votes, agreement=0.3, covered=0.5).select(F.col("key").alias("user_id"), "text", "total", "top_n")


def mode_tiebreak(spark: SparkSession, sf_dir: str) -> DataFrame:
    return voting.mode(table(spark, sf_dir, "lineitem"), ["l_returnflag", "l_linestatus"], "l_quantity")


def _cents(column: str) -> F.Column:
    return F.round(F.col(column) * 100).cast("long")


def densest_cluster(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = table(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", _cents("o_totalprice").alias("cents"))
    return voting.densest_cluster(orders, ["o_custkey"], "cents", "o_orderkey", 5_000_000).select("o_custkey", "o_orderkey", "cluster_size")


def _titles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lines(spark, sf_dir).select(F.col("l_orderkey").alias("disc_id"), F.col("pos").cast("string").alias("key"), F.col("pos").alias("title_pos"), (F.col("l_quantity") * 60_000).cast("long").alias("duration_ms"))


def feature_argmax(spark: SparkSession, sf_dir: str) -> DataFrame:
    return structure.feature(_titles(spark, sf_dir)).select(F.col("disc_id").alias("l_orderkey"), F.col("title_pos").alias("pos"), "role")


def otsu_threshold(spark: SparkSession, sf_dir: str) -> DataFrame:
    return voting.otsu(table(spark, sf_dir, "events").select("event_type", F.floor("value").cast("long").alias("v")), ["event_type"], "v")


def index_quantile(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "events")
    high = voting.index_quantile(rows, ["event_type"], "value", 3, 4).withColumnRenamed("value", "upper")
    return high.join(voting.index_quantile(rows, ["event_type"], "value", 1, 4).withColumnRenamed("value", "lower").drop("n"), "event_type")


def coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How much of each language's text, by words, the benchmark's words cover."""
    words = lambda c: F.explode(F.regexp_extract_all(F.lower(c), F.lit(r"([^\x20\x09-\x0D]+)"), F.lit(1))).alias("key")
    shapes = table(spark, sf_dir, "documents").select(F.coalesce("lang", F.lit("und")).alias("lang"), words(F.col("text"))).groupBy("lang", "key").agg(F.count("*").alias("n"))
    return voting.coverage(shapes, table(spark, sf_dir, "benchmark").select(words(F.col("text"))), ["lang"])


def runtime_agreement(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "lineitem")
    return identify.runtime_agreement(rows.select("l_returnflag", F.col("l_quantity").alias("duration_ms")), rows.select("l_returnflag", F.col("l_quantity").alias("runtime_ms")), ["l_returnflag"])


def role_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    role = F.when(F.col("o_orderstatus") == "F", "Feature").when(F.col("o_orderstatus") == "O", "Episode").otherwise("Extra")
    return discs.role_plan(table(spark, sf_dir, "orders").select("o_custkey", role.alias("role")), ["o_custkey"])


def first_seen_distinct(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", F.coalesce("role", F.lit("")).alias("role"))
    return voting.first_seen(rows, ["conv_id"], "role", ["turn"]).select("conv_id", F.array_join("values", ",").alias("roles"))


def fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "lineitem").select("l_orderkey", F.col("l_quantity").cast("long").alias("q"))
    return discs.fingerprint(rows, ["l_orderkey"], "q", 10).select("l_orderkey", F.array_join(F.transform("fingerprint", lambda x: x.cast("string")), ",").alias("fingerprint"))


def disc_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Both public identifiers of the disc that each order stands for."""
    toc = discs.contents(toc_tracks(spark, sf_dir), ["l_orderkey"])
    return toc.select("l_orderkey", discs.freedb_id(F.col("toc"), F.col("leadout")).alias("freedb_id"), discs.musicbrainz_id(F.col("toc"), F.col("leadout")).alias("musicbrainz_id"))


def disc_kinds(spark: SparkSession, sf_dir: str) -> DataFrame:
    return discs.kind(toc_tracks(spark, sf_dir), ["l_orderkey"])


def median_outliers(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = table(spark, sf_dir, "part").select("p_partkey", "p_type", "p_size")
    medians = voting.index_quantile(parts, ["p_type"], "p_size", 1, 2).select("p_type", F.col("p_size").alias("median"))
    return parts.join(medians, "p_type").filter(F.abs(F.col("p_size") - F.col("median")) > 20).select("p_partkey", "p_size", "median")


def interval_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = visits(spark, sf_dir).select("user_id", F.col("ms").alias("start"), (F.col("ms") + 1_800_000).alias("end"))
    return intervals.union(rows, ["user_id"])


def _writes(spark: SparkSession, sf_dir: str) -> DataFrame:
    minute = F.floor(F.col("ms") / 60_000).cast("long")
    return visits(spark, sf_dir).select("user_id", "day", F.col("event_id").alias("seq"), minute.alias("start"), (minute + F.col("event_id") % 90).alias("end"), F.col("event_type").alias("state"))


_WRITES_SQL = f"{VISITS_SQL}, writes AS (SELECT user_id, day, event_id AS seq, ms // 60000 AS start, ms // 60000 + event_id % 90 AS stop, event_type AS state FROM visits)"
_MINUTES_SQL = f"{_WRITES_SQL}, minutes AS (SELECT user_id, day, m, arg_max(state, seq) AS state FROM (SELECT *, unnest(range(start, stop)) AS m FROM writes) GROUP BY ALL)"


def interval_overwrite(spark: SparkSession, sf_dir: str) -> DataFrame:
    return intervals.overwrite(_writes(spark, sf_dir), ["user_id", "day"])


def interval_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return intervals.summary(interval_overwrite(spark, sf_dir), ["user_id", "day"], ["click", "error"])


def rescue_sim(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = lines(spark, sf_dir).select("l_orderkey", F.col("pos").alias("lba"), (F.col("l_returnflag") != "R").alias("readable"), (F.col("pos") % 4).alias("readable_at"))
    return intervals.rescue(rows, ["l_orderkey"])


def last_look(spark: SparkSession, sf_dir: str) -> DataFrame:
    flags = visits(spark, sf_dir).select("user_id", (F.col("event_id") % 97).alias("lba"), F.col("event_id").alias("seq"), (F.col("event_type") == "error").alias("damaged"))
    return intervals.last_look(flags, ["user_id"])


def cue_tidy(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = visits(spark, sf_dir)
    ends = F.when(F.col("event_id") % 3 != 0, F.col("ms") + F.col("event_id") % 7 * 2_000_000 - 1_000_000)
    cues = rows.select("user_id", "day", "event_id", F.col("ms").alias("start_ms"), ends.alias("end_ms"))
    return sequences.tidy_cues(cues, ["user_id", "day"], ["start_ms", "event_id"]).select("event_id", "start_ms", "end_ms")


def track_layout(spark: SparkSession, sf_dir: str) -> DataFrame:
    tracks = toc_tracks(spark, sf_dir).withColumn("pregap", F.when(F.col("number") % 2 == 0, 150))
    return sequences.layout(tracks, ["l_orderkey"]).select("l_orderkey", "number", "file_start", "file_end", "bytes")


def word_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sequences.gap_sessions(visits(spark, sf_dir), ["user_id", "day"], "ms", ["event_id"], 3_600_000).select("event_id", "session")


def ffill(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.when(F.col("event_id") % 3 == 0, F.from_json("props", "k bigint")["k"])
    return sequences.repeated_from_before(visits(spark, sf_dir).withColumn("k", k), ["user_id", "day"], ["ms", "event_id"], "k").select("event_id", "k")


def consensus_reads(spark: SparkSession, sf_dir: str) -> DataFrame:
    readings = lines(spark, sf_dir).select("l_orderkey", F.col("pos").alias("attempt"), F.concat("l_returnflag", "l_linestatus").alias("digest"), F.when(F.col("l_quantity") > 25, 1).otherwise(0).alias("flagged"))
    return sequences.consensus(readings, ["l_orderkey"]).select("l_orderkey", "digest", F.col("attempts").cast("long").alias("attempts"), "agreed")


def repeated_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events of a user's day that are not of the kind of the one before."""
    return sequences.without_repeats(visits(spark, sf_dir), ["user_id", "day"], ["ms", "event_id"], "event_type").select("event_id", "event_type")


def crc32_digest(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ..functions.bits import crc_hex

    return checksums.digests(table(spark, sf_dir, "documents").select("doc_id", "text"), "text").select("doc_id", "bytes", crc_hex(F.col("crc32")).alias("crc32"), "sha1")


def picture_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vectors as pictures of eight by eight pixels, and the keys of those."""
    pixel = F.transform("embedding", lambda x: F.when(x > 0, "01").otherwise("00"))
    pictures = table(spark, sf_dir, "embeddings").select("vec_id", F.lit(8).alias("w"), F.lit(8).alias("h"), F.unhex(F.array_join(pixel, "")).alias("bits"))
    return checksums.picture_keys(pictures).select("vec_id", "key")


def edc_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts as raw sectors: a header of their mode, the name as data, and no stored code; but one in eight is an empty sector
    of the second mode, whose code is 0, and one an empty one of the first mode with the code that it should have."""
    k = F.col("p_partkey")
    mode = F.lpad(F.hex((k % 3).cast("long")), 2, "0")
    head = F.unhex(F.concat(F.lit("00" + "FF" * 10 + "00" + "000200"), mode))
    named = F.substring(F.concat(head, F.rpad(F.col("p_name").cast("binary"), 2336, F.lit(b"\x00"))), 1, 2352)
    first = checksums.SYNC + b"\x00\x02\x00\x01" + bytes(2048)
    code = int(checksums.edc(np.frombuffer(first, np.uint8).reshape(1, -1))[0]).to_bytes(4, "little")
    raw = F.when(k % 8 == 0, F.lit(checksums.SYNC + b"\x00\x02\x00\x02" + bytes(2336))).when(k % 8 == 1, F.lit(first + code + bytes(284))).otherwise(named)
    sectors = table(spark, sf_dir, "part").select((k % 10).alias("track"), k.alias("sector_pos"), raw.alias("raw"))
    checked = checksums.check_sectors(sectors.withColumn("address", checksums.sector_address(F.col("raw"))))
    return checksums.track_verdicts(checked)


#: SQL for codes by remainders, a byte at a time, with the table of a polynomial; SQL lists count from 1.
_TABLE_SQL = "list_transform(range(256), lambda n: list_reduce(list_concat([CAST(n AS BIGINT)], range(8)), lambda c, i: CASE WHEN c & 1 = 1 THEN xor(c >> 1, CAST({0} AS BIGINT)) ELSE c >> 1 END))"
_BYTES_SQL = "list_transform(range(0, length({0}) // 2), lambda i: CAST('0x' || substring({0}, 2 * i + 1, 2) AS BIGINT))"
_CODE_SQL = "list_reduce(list_concat([CAST({1} AS BIGINT)], {0}), lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1]))"


def decompose_playall(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers as discs, orders as titles with a chapter for each line, and one more title of all of them on end."""
    chapters = lines(spark, sf_dir).groupBy("l_orderkey").agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "l_quantity"))), lambda x: (x.l_quantity * 10_000 + 200_000).cast("long")).alias("chapters"))
    orders = table(spark, sf_dir, "orders").select(F.col("o_custkey").cast("string").alias("disc_id"), "o_orderkey").join(chapters, F.col("o_orderkey") == F.col("l_orderkey"))
    total = lambda c: F.aggregate(c, F.lit(0).cast("long"), lambda a, x: a + x)
    # a disc's own titles give the one of all of them, so lines are laid out once
    single = orders.groupBy("disc_id").agg(F.array_sort(F.collect_list(F.struct(F.col("o_orderkey").alias("title_pos"), F.col("o_orderkey").cast("string").alias("key"), "chapters"))).alias("singles"))
    whole = F.struct(F.lit(-1).cast("long").alias("title_pos"), F.lit("all").alias("key"), F.flatten(F.transform("singles", lambda x: x.chapters)).alias("chapters"))
    titles = single.select("disc_id", F.explode(F.concat(F.array(whole), "singles")).alias("t")).select("disc_id", "t.*").withColumn("duration_ms", total(F.col("chapters")))
    return structure.organise(titles)


QUERIES = {
    "plurality_vote": (
        plurality_vote,
        """WITH v AS (SELECT user_id, event_type, count(*) AS n FROM events GROUP BY 1, 2), r AS (
          SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY n DESC, event_type) AS place, sum(n) OVER (PARTITION BY user_id) AS total FROM v), two AS (
          SELECT user_id, CAST(any_value(total) AS BIGINT) AS total, max(event_type) FILTER (WHERE place = 1) AS top, max(n) FILTER (WHERE place = 1) AS top_n,
                 max(event_type) FILTER (WHERE place = 2) AS second, max(n) FILTER (WHERE place = 2) AS second_n FROM r GROUP BY user_id)
        SELECT user_id, CASE WHEN top_n / total >= 0.3 THEN top WHEN (top_n + second_n) / total >= 0.5 AND second_n >= 8 AND second_n / total >= 0.05 THEN top || '|' || second END AS text, total, top_n FROM two""",
    ),
    "mode_tiebreak": (mode_tiebreak, "SELECT l_returnflag, l_linestatus, l_quantity, count(*) AS n FROM lineitem GROUP BY 1, 2, 3 QUALIFY row_number() OVER (PARTITION BY l_returnflag, l_linestatus ORDER BY count(*) DESC, l_quantity) = 1"),
    "densest_cluster": (
        densest_cluster,
        """WITH o AS (SELECT o_custkey, o_orderkey, CAST(round(o_totalprice * 100) AS BIGINT) AS c FROM orders), seeds AS (
          SELECT a.o_custkey, a.o_orderkey, a.c, count(*) AS n FROM o a JOIN o b ON a.o_custkey = b.o_custkey AND abs(a.c - b.c) <= 5000000 GROUP BY 1, 2, 3
          QUALIFY row_number() OVER (PARTITION BY a.o_custkey ORDER BY count(*) DESC, a.o_orderkey DESC) = 1)
        SELECT o.o_custkey, o.o_orderkey, s.n AS cluster_size FROM o JOIN seeds s ON s.o_custkey = o.o_custkey AND abs(o.c - s.c) <= 5000000""",
    ),
    "feature_argmax": (
        feature_argmax,
        f"WITH {LINES_SQL} SELECT l_orderkey, pos, CASE WHEN row_number() OVER (PARTITION BY l_orderkey ORDER BY l_quantity DESC, pos) = 1 THEN 'feature' ELSE 'extra' END AS role FROM lines",
    ),
    "otsu_threshold": (
        otsu_threshold,
        """WITH h AS (SELECT event_type, CAST(floor(value) AS BIGINT) AS v, count(*) AS c FROM events WHERE value IS NOT NULL GROUP BY 1, 2), s AS (
          SELECT *, sum(c) OVER r AS w0, sum(v * c) OVER r AS s0, sum(c) OVER a AS w, sum(v * c) OVER a AS s FROM h WINDOW r AS (PARTITION BY event_type ORDER BY v ROWS UNBOUNDED PRECEDING), a AS (PARTITION BY event_type)), x AS (
          SELECT *, w0::DOUBLE * (w - w0) * (s0::DOUBLE / w0 - (s::DOUBLE - s0) / (w - w0)) * (s0::DOUBLE / w0 - (s::DOUBLE - s0) / (w - w0)) AS var FROM s WHERE w > w0)
        SELECT event_type, v + 1 AS threshold, CAST(w AS BIGINT) AS n FROM x QUALIFY row_number() OVER (PARTITION BY event_type ORDER BY var DESC, v) = 1""",
    ),
    "index_quantile": (
        index_quantile,
        """WITH l AS (SELECT event_type, list_sort(list(value)) AS v FROM events WHERE value IS NOT NULL GROUP BY 1)
        SELECT event_type, v[len(v) * 3 // 4 + 1] AS upper, v[len(v) // 4 + 1] AS lower, len(v) AS n FROM l""",
    ),
    "coverage": (
        coverage,
        r"""WITH w AS (SELECT coalesce(lang, 'und') AS lang, unnest(regexp_extract_all(lower(text), '[^\x20\x09-\x0D]+')) AS key FROM documents), b AS (SELECT DISTINCT unnest(regexp_extract_all(lower(text), '[^\x20\x09-\x0D]+')) AS key FROM benchmark)
        SELECT lang, count(b.key) AS covered, count(*) AS total FROM w LEFT JOIN b USING (key) GROUP BY lang""",
    ),
    "runtime_agreement": (
        runtime_agreement,
        "WITH m AS (SELECT l_returnflag, avg(l_quantity) AS mean FROM lineitem GROUP BY 1) SELECT l_returnflag, count(*) FILTER (WHERE abs(l_quantity - mean) <= mean * 0.5) AS near, count(*) AS n FROM lineitem JOIN m USING (l_returnflag) GROUP BY 1",
    ),
    "role_plan": (
        role_plan,
        "SELECT o_custkey, count(*) FILTER (WHERE o_orderstatus = 'O') AS episodes, count(*) FILTER (WHERE o_orderstatus = 'F') AS features, 0::BIGINT AS extended_cuts, count(*) FILTER (WHERE o_orderstatus NOT IN ('O', 'F')) AS extras, 0::BIGINT AS play_alls FROM orders GROUP BY 1",
    ),
    "first_seen_distinct": (
        first_seen_distinct,
        "WITH f AS (SELECT conv_id, coalesce(role, '') AS role, min(turn) AS t FROM conversations GROUP BY 1, 2) SELECT conv_id, string_agg(role, ',' ORDER BY t, role) AS roles FROM f GROUP BY 1",
    ),
    "fingerprint": (fingerprint, "SELECT l_orderkey, coalesce(string_agg(CAST(CAST(l_quantity AS BIGINT) AS VARCHAR), ',' ORDER BY l_quantity) FILTER (WHERE l_quantity >= 10), '') AS fingerprint FROM lineitem GROUP BY 1"),
    "disc_ids": (
        disc_ids,
        f"""WITH {DISCS_SQL}, d AS (
          SELECT l_orderkey, sum(list_sum(list_transform(string_split(CAST((start + 150) // 75 AS VARCHAR), ''), lambda x: CAST(x AS BIGINT)))) AS digits, any_value(leadout) AS leadout, count(*) AS n,
                 min(number) AS first, max(number) AS last, map(list(CAST(number AS BIGINT)), list(start + 150)) AS slots FROM tracks GROUP BY 1)
        SELECT l_orderkey, format('{{:08x}}', CAST((digits % 255) * 16777216 + ((leadout + 150) // 75 - 2) * 256 + n AS BIGINT)) AS freedb_id,
               translate(base64(unhex(sha1(format('{{:02X}}{{:02X}}{{:08X}}', first, last, leadout + 150) || array_to_string(list_transform(range(1, 100), lambda i: format('{{:08X}}', coalesce(slots[i], 0))), '')))), '+/=', '._-') AS musicbrainz_id FROM d""",
    ),
    "disc_kinds": (
        disc_kinds,
        f"""WITH {LINES_SQL} SELECT l_orderkey, CASE WHEN bool_or(l_returnflag = 'R') AND bool_or(l_returnflag <> 'R') THEN 'enhanced' WHEN bool_or(l_returnflag <> 'R') THEN 'audio' ELSE 'data' END AS kind,
           arg_min(l_returnflag = 'R', pos) AS opens_with_data FROM lines GROUP BY 1""",
    ),
    "median_outliers": (
        median_outliers,
        "WITH m AS (SELECT p_type, list_sort(list(p_size))[count(*) // 2 + 1] AS median FROM part GROUP BY 1) SELECT p_partkey, p_size, median FROM part JOIN m USING (p_type) WHERE abs(p_size - median) > 20",
    ),
    "interval_union": (
        interval_union,
        f"""WITH {VISITS_SQL}, f AS (SELECT user_id, ms, CASE WHEN ms - lag(ms) OVER w <= 1800000 THEN 0 ELSE 1 END AS o FROM visits WINDOW w AS (PARTITION BY user_id ORDER BY ms)),
        g AS (SELECT *, sum(o) OVER (PARTITION BY user_id ORDER BY ms ROWS UNBOUNDED PRECEDING) AS i FROM f)
        SELECT user_id, min(ms) AS start, max(ms) + 1800000 AS "end" FROM g GROUP BY user_id, i""",
    ),
    "interval_overwrite": (
        interval_overwrite,
        f"""WITH {_MINUTES_SQL}, f AS (SELECT *, CASE WHEN lag(m) OVER w = m - 1 AND lag(state) OVER w = state THEN 0 ELSE 1 END AS o FROM minutes WINDOW w AS (PARTITION BY user_id, day ORDER BY m)),
        g AS (SELECT *, sum(o) OVER (PARTITION BY user_id, day ORDER BY m ROWS UNBOUNDED PRECEDING) AS i FROM f)
        SELECT user_id, day, min(m) AS start, max(m) + 1 AS "end", any_value(state) AS state FROM g GROUP BY user_id, day, i""",
    ),
    "interval_summary": (
        interval_summary,
        f"WITH {_MINUTES_SQL} SELECT user_id, day, count(*) AS total, count(*) FILTER (WHERE state = 'click') AS click, count(*) FILTER (WHERE state = 'error') AS error FROM minutes GROUP BY 1, 2",
    ),
    "rescue_sim": (
        rescue_sim,
        f"""WITH {LINES_SQL}, s AS (SELECT l_orderkey, pos AS lba, CASE WHEN l_returnflag <> 'R' OR pos % 4 <= 2 THEN 'Finished' ELSE 'Bad' END AS state FROM lines),
        f AS (SELECT *, lba - row_number() OVER (PARTITION BY l_orderkey, state ORDER BY lba) AS i FROM s)
        SELECT l_orderkey, min(lba) AS start, max(lba) + 1 AS "end", state FROM f GROUP BY l_orderkey, state, i""",
    ),
    "last_look": (last_look, "SELECT user_id, event_id % 97 AS lba FROM events GROUP BY 1, 2 HAVING arg_max(event_type, event_id) = 'error'"),
    "cue_tidy": (
        cue_tidy,
        f"""WITH {VISITS_SQL}, c AS (SELECT event_id, ms, CASE WHEN event_id % 3 <> 0 THEN ms + event_id % 7 * 2000000 - 1000000 END AS e, lead(ms) OVER (PARTITION BY user_id, day ORDER BY ms, event_id) AS n FROM visits),
        f AS (SELECT *, coalesce(e, n - 1, ms + 3000) AS e1 FROM c), g AS (SELECT *, CASE WHEN e1 >= n THEN n - 1 ELSE e1 END AS e2 FROM f)
        SELECT event_id, ms AS start_ms, CASE WHEN e2 <= ms THEN ms + 800 ELSE e2 END AS end_ms FROM g""",
    ),
    "track_layout": (
        track_layout,
        f"""WITH {DISCS_SQL}, b AS (SELECT *, greatest(start - CASE WHEN number % 2 = 0 THEN 150 ELSE 0 END, 0) AS fs FROM tracks), e AS (SELECT *, coalesce(lead(fs) OVER (PARTITION BY l_orderkey ORDER BY number), leadout) AS fe FROM b)
        SELECT l_orderkey, number, fs AS file_start, fe AS file_end, (fe - fs) * 2352 AS bytes FROM e""",
    ),
    "word_sessions": (
        word_sessions,
        f"""WITH {VISITS_SQL}, f AS (SELECT *, CASE WHEN ms - lag(ms) OVER w >= 3600000 THEN 1 ELSE 0 END AS o FROM visits WINDOW w AS (PARTITION BY user_id, day ORDER BY ms, event_id))
        SELECT event_id, CAST(sum(o) OVER (PARTITION BY user_id, day ORDER BY ms, event_id ROWS UNBOUNDED PRECEDING) AS BIGINT) AS session FROM f""",
    ),
    "ffill": (
        ffill,
        f"""WITH {VISITS_SQL}, k AS (SELECT *, CASE WHEN event_id % 3 = 0 THEN CAST(props ->> '$.k' AS BIGINT) END AS k0 FROM visits)
        SELECT event_id, last_value(k0 IGNORE NULLS) OVER (PARTITION BY user_id, day ORDER BY ms, event_id ROWS UNBOUNDED PRECEDING) AS k FROM k""",
    ),
    "consensus_reads": (
        consensus_reads,
        f"""WITH {LINES_SQL}, r AS (SELECT l_orderkey, l_returnflag || l_linestatus AS digest, l_quantity > 25 AS flagged, pos AS no, lag(l_returnflag || l_linestatus) OVER w AS before FROM lines WINDOW w AS (PARTITION BY l_orderkey ORDER BY pos)),
        g AS (SELECT *, ((no = 1 AND NOT flagged) OR coalesce(digest = before, false)) AS good FROM r WHERE no <= 3)
        SELECT l_orderkey, coalesce(arg_min(digest, no) FILTER (WHERE good), arg_max(digest, no)) AS digest, coalesce(min(no) FILTER (WHERE good), max(no)) AS attempts, bool_or(good) AS agreed FROM g GROUP BY 1""",
    ),
    "repeated_lines": (
        repeated_lines,
        f"WITH {VISITS_SQL} SELECT event_id, event_type FROM visits QUALIFY lag(event_type) OVER (PARTITION BY user_id, day ORDER BY ms, event_id) IS DISTINCT FROM event_type",
    ),
    "crc32_digest": (
        crc32_digest,
        f"""WITH b AS (SELECT doc_id, text, {_BYTES_SQL.format("hex(encode(text))")} AS bytes, {_TABLE_SQL.format(0xEDB88320)} AS t FROM documents)
        SELECT doc_id, strlen(text) AS bytes, CASE WHEN text IS NOT NULL THEN printf('%08x', xor({_CODE_SQL.format("bytes", 0xFFFFFFFF)}, 4294967295)) END AS crc32, sha1(text) AS sha1 FROM b""",
    ),
    "picture_keys": (
        picture_keys,
        """WITH b AS (SELECT vec_id, list_concat([8, 0, 8, 0], list_transform(embedding, lambda x: CASE WHEN x > 0 THEN 1 ELSE 0 END)) AS bytes FROM embeddings), k AS (
          SELECT vec_id, list_reduce(list_concat([CAST(14695981039346656037 AS HUGEINT)], bytes), lambda v, b: (xor(v, b) * 1099511628211) % 18446744073709551616) AS v FROM b)
        SELECT vec_id, lpad(lower(hex(CAST(v AS UBIGINT))), 16, '0') AS key FROM k""",
    ),
    "edc_check": (
        edc_check,
        f"""WITH h AS (SELECT p_partkey AS k, '00' || repeat('FF', 10) || '00000200' AS head, upper(hex(encode(p_name))) AS name FROM part), t AS (SELECT {_TABLE_SQL.format(0xD8018001)} AS t), raw AS (
          SELECT k, CASE WHEN k % 8 = 0 THEN head || '02' || repeat('00', 2336) WHEN k % 8 = 1 THEN head || '01' || repeat('00', 2336) ELSE head || '0' || k % 3 || rpad(name, 4672, '0') END AS r, k % 8 = 1 AS known FROM h), b AS (
          SELECT k, known, {_BYTES_SQL.format("r")} AS bytes FROM raw), m AS (SELECT *, bytes[16] AS mode, bytes[19] & 32 = 0 AS first_form, bytes[2349:2352] = [0, 0, 0, 0] AS blank FROM b), c AS (
          SELECT *, CASE WHEN mode = 1 THEN bytes[1:2064] WHEN mode = 2 AND first_form THEN bytes[17:2072] WHEN mode = 2 AND NOT blank THEN bytes[17:2348] END AS covered,
                 CASE WHEN mode = 1 THEN bytes[2065:2068] WHEN mode = 2 AND first_form THEN bytes[2073:2076] ELSE bytes[2349:2352] END AS stored FROM m), e AS (
          SELECT k, known, covered IS NULL AS unchecked, {_CODE_SQL.format("covered", 0)} AS code, stored[1] + (stored[2] << 8) + (stored[3] << 16) + (stored[4] << 24) AS told FROM c, t)
        SELECT k % 10 AS track, count(*) AS sectors, count(*) FILTER (WHERE NOT unchecked AND (known OR code = told)) AS sound, count(*) FILTER (WHERE NOT unchecked AND NOT known AND code <> told) AS corrupt, count(*) FILTER (WHERE unchecked) AS unchecked,
          count(*) FILTER (WHERE k <> 0) AS misplaced FROM e GROUP BY 1""",
    ),
    "decompose_playall": (decompose_playall, None),
}
