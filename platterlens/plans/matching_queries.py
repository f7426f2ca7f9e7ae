"""Queries that match rows: digests, wholes, preferences, neighbours in time."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import bits, languages, strings
from ..operators import matching, voting
from .tables import VISITS_SQL, table, visits


def verify_exact(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts against the set of all texts, by size and SHA-1: the first document that each is."""
    sized = table(spark, sf_dir, "documents").select("doc_id", F.octet_length("text").cast("long").alias("bytes"), F.sha1(F.col("text").cast("binary")).alias("sha1"))
    dumps = sized.withColumn("crc32", F.lit(None).cast("long"))
    roms = sized.filter("sha1 is not null").select(F.lit(0).alias("dat_pos"), F.col("doc_id").alias("game_pos"), F.lit(0).alias("rom_pos"), F.col("doc_id").cast("string").alias("game"), F.lit("").alias("name"), F.col("bytes").alias("size"), F.lit(None).cast("long").alias("crc32"), "sha1")
    found = matching.match_digests(dumps.withColumnRenamed("doc_id", "dump_id"), roms)
    return found.select(F.col("dump_id").alias("doc_id"), F.col("game").cast("long").alias("first_id"), "matched_by")


def verify_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of equal texts of a source the first stays."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", F.sha1(F.col("text").cast("binary")).alias("sha1"))
    return docs.groupBy("source", "sha1").agg(F.min("doc_id").alias("doc_id"), F.count("*").alias("copies"))


def _parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    # odd turns are known by their role alone, so that conversations share some parts and not others
    body = F.when(F.col("turn") % 2 == 1, F.coalesce("role", F.lit(""))).otherwise(F.concat_ws("\n", F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))))
    return table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("id"), F.col("turn").alias("pos"), F.sha1(body.cast("binary")).alias("part"))


_PARTS_SQL = "parts AS (SELECT conv_id AS id, turn AS pos, sha1(CASE WHEN turn % 2 = 1 THEN coalesce(role, '') ELSE coalesce(role, '') || chr(10) || coalesce(text, '') END) AS part FROM conversations)"


def ordered_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = _parts(spark, sf_dir)
    return matching.match_wholes(parts, parts)


def partial_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = _parts(spark, sf_dir)
    return matching.match_partly(parts.filter("id % 50 = 0"), parts)


def hamming_similarity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many vectors lie within three bits of each query vector (ids divisible by 50), as signs around their mean.

    Equal patterns are one row with a count; patterns meet in four bands of 16 bits, one of which must agree wholly.
    """
    rows = table(spark, sf_dir, "embeddings").select("vec_id", bits.above_mean(F.col("embedding").cast("array<double>"))["hi"].alias("word"))
    patterns = rows.groupBy("word").agg(F.count("*").alias("n"))
    asked = rows.filter("vec_id % 50 = 0").groupBy("word").agg(F.lit(1).alias("__one")).select(F.col("word").alias("asked"))
    a = asked.select("asked", F.posexplode(bands_of("asked")).alias("band", "value"))
    b = patterns.select("word", "n", F.posexplode(bands_of("word")).alias("band", "value"))
    near = a.join(b, ["band", "value"]).filter(bits.hamming(F.col("asked"), F.col("word")) <= 3).select("asked", "word", "n").distinct()
    counted = near.groupBy("asked").agg(F.sum("n").alias("n_near"))
    return rows.filter("vec_id % 50 = 0").join(counted, F.col("word") == F.col("asked")).select("vec_id", "n_near")


def bands_of(column: str) -> F.Column:
    return F.array(*(F.shiftrightunsigned(column, 16 * i).bitwiseAND(F.lit(65535).cast("long")) for i in range(4)))


def frame_matches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Brands as titles whose parts are frames: how many frames of one title another has, give or take eight bits."""
    k = F.col("p_partkey")
    half = lambda i: F.conv(F.substring(F.md5((k % 200).cast("string").cast("binary")), i, 15), 16, 10).cast("long")
    one = F.lit(1).cast("long")
    flip = lambda c, bit: c.bitwiseXOR(F.call_function("shiftleft", one, bit.cast("int")))
    frames = table(spark, sf_dir, "part").select(F.col("p_brand").alias("title"), k.alias("frame_pos"), flip(flip(half(1), k % 59), k % 13).alias("hi"), flip(flip(half(16), k % 53), k % 7).alias("lo"))
    return matching.similar_frames(frames, 7)


def nearest_event(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The click nearest in time to each error of a user's day."""
    rows = visits(spark, sf_dir)
    probes = rows.filter("event_type = 'error'").select("user_id", "day", F.col("ms").alias("at")).distinct()
    return matching.nearest(probes, rows.filter("event_type = 'click'").select("user_id", "day", F.col("ms").alias("at"), "event_id"), ["user_id", "day"]).select("user_id", F.col("at").alias("ms"), "event_id", "distance")


def asof_event(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last error at or before each click of a user's day, else the first of the day."""
    rows = visits(spark, sf_dir)
    probes = rows.filter("event_type = 'click'").select("user_id", "day", F.col("ms").alias("at"), "event_id")
    return matching.as_of(probes, rows.filter("event_type = 'error'").select("user_id", "day", F.col("ms").alias("start"), F.col("event_id").alias("number")), ["user_id", "day"]).select("event_id", "number")


def anti_missing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers that never had an urgent order, by name."""
    customers, orders = table(spark, sf_dir, "customer"), table(spark, sf_dir, "orders").filter("o_orderpriority = '1-URGENT'")
    wanted = customers.select(F.col("c_name").alias("name"))
    present = customers.join(orders.select(F.col("o_custkey").alias("c_custkey")).distinct(), "c_custkey", "left_semi").select(F.col("c_name").alias("name"))
    return matching.missing(wanted, present, strings.same_key)


def pref_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each source's languages in the order they are first seen, those that `de, en` prefers, or the first."""
    seen = table(spark, sf_dir, "documents").filter("lang is not null and source is not null").groupBy(F.col("source").alias("group"), F.col("lang").alias("tag")).agg(F.min("doc_id").alias("tag_pos"))
    return matching.by_preference(seen, languages.aliases(spark), languages.parse_preference("de, English")).select(F.col("group").alias("source"), "tag", F.col("out_pos").cast("long").alias("out_pos"))


def first_nonempty_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Questions are languages and hundreds of characters; of the sources that have such documents the first one's answer."""
    docs = table(spark, sf_dir, "documents")
    question = F.concat(F.coalesce("lang", F.lit("")), F.lit(" "), F.floor(F.coalesce("n_chars", F.lit(0)) / 100).cast("string"))
    hits = docs.select("doc_id", question.alias("question"), F.coalesce(F.regexp_extract("source", "([0-9]+)$", 1).try_cast("int"), F.lit(999_999)).alias("source_rank"))
    return matching.first_answering(hits).select("doc_id", "question", F.col("source_rank").cast("long").alias("source_rank"))


def top_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = table(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", "o_totalprice")
    return voting.top_each(orders, ["o_custkey"], F.col("o_totalprice"), ["o_orderkey"], 5).select("o_custkey", "o_orderkey", F.col("rank").cast("long").alias("rank"))


def image_cache(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select("page_id", strings.cache_key(F.col("url")).alias("cache_key"), strings.percent_encode(F.col("url")).alias("encoded"))


QUERIES = {
    "verify_exact": (
        verify_exact,
        """SELECT doc_id, CASE WHEN text IS NOT NULL THEN min(doc_id) OVER (PARTITION BY strlen(text), sha1(text)) END AS first_id,
           CASE WHEN text IS NOT NULL THEN 'sha1' END AS matched_by FROM documents""",
    ),
    "verify_duplicates": (verify_duplicates, "SELECT source, sha1(text) AS sha1, min(doc_id) AS doc_id, count(*) AS copies FROM documents GROUP BY 1, 2"),
    "ordered_match": (
        ordered_match,
        f"""WITH {_PARTS_SQL}, wholes AS (SELECT id, string_agg(pos || ':' || part, ',' ORDER BY pos, part) AS whole FROM parts GROUP BY id)
        SELECT a.id, min(b.id) AS match_id FROM wholes a LEFT JOIN wholes b ON a.whole = b.whole AND a.id <> b.id GROUP BY a.id""",
    ),
    "partial_match": (
        partial_match,
        f"""WITH {_PARTS_SQL}, sized AS (SELECT *, count(*) OVER (PARTITION BY id) AS n FROM parts), met AS (
          SELECT a.id, a.n, b.id AS match_id, count(*) AS matched FROM sized a JOIN sized b ON a.n = b.n AND a.pos = b.pos AND a.part = b.part AND a.id <> b.id WHERE a.id % 50 = 0 GROUP BY ALL)
        SELECT id, match_id, matched, n FROM met QUALIFY row_number() OVER (PARTITION BY id ORDER BY matched DESC, match_id DESC) = 1""",
    ),
    "hamming_similarity": (
        hamming_similarity,
        """WITH b AS (SELECT vec_id, list_transform(embedding, lambda x: CASE WHEN CAST(x AS DOUBLE) > list_avg(list_transform(embedding, lambda y: CAST(y AS DOUBLE))) THEN 1 ELSE 0 END) AS bits FROM embeddings)
        SELECT q.vec_id, count(*) AS n_near FROM b q JOIN b r ON list_sum(list_transform(list_zip(q.bits, r.bits), lambda z: CASE WHEN z[1] <> z[2] THEN 1 ELSE 0 END)) <= 3 WHERE q.vec_id % 50 = 0 GROUP BY q.vec_id""",
    ),
    "frame_matches": (
        frame_matches,
        """WITH m AS (SELECT p_brand, p_partkey AS k, md5(CAST(p_partkey % 200 AS VARCHAR)) AS m FROM part), f AS (
          SELECT p_brand, k, xor(xor(CAST('0x' || substring(m, 1, 15) AS BIGINT), 1::BIGINT << (k % 59)), 1::BIGINT << (k % 13)) AS hi, xor(xor(CAST('0x' || substring(m, 16, 15) AS BIGINT), 1::BIGINT << (k % 53)), 1::BIGINT << (k % 7)) AS lo FROM m), h AS (
          SELECT DISTINCT a.p_brand AS a, b.p_brand AS b, a.k FROM f a JOIN f b ON a.p_brand <> b.p_brand AND bit_count(xor(a.hi, b.hi)) + bit_count(xor(a.lo, b.lo)) <= 7), n AS (SELECT p_brand, count(*) AS n FROM f GROUP BY 1)
        SELECT a, b, count(*) AS hits, any_value(n) AS n FROM h JOIN n ON p_brand = a GROUP BY a, b""",
    ),
    "nearest_event": (
        nearest_event,
        f"""WITH {VISITS_SQL}, met AS (SELECT DISTINCT e.user_id, e.ms, c.event_id, c.ms AS cms FROM visits e LEFT JOIN visits c ON c.user_id = e.user_id AND c.day = e.day AND c.event_type = 'click' WHERE e.event_type = 'error')
        SELECT user_id, ms, event_id, abs(ms - cms) AS distance FROM met QUALIFY row_number() OVER (PARTITION BY user_id, ms ORDER BY abs(ms - cms), cms, event_id) = 1""",
    ),
    "asof_event": (
        asof_event,
        f"""WITH {VISITS_SQL} SELECT c.event_id, coalesce(arg_max(e.event_id, struct_pack(m := e.ms, i := e.event_id)) FILTER (WHERE e.ms <= c.ms), arg_min(e.event_id, struct_pack(m := e.ms, i := e.event_id))) AS number
        FROM visits c LEFT JOIN visits e ON e.user_id = c.user_id AND e.day = c.day AND e.event_type = 'error' WHERE c.event_type = 'click' GROUP BY c.event_id""",
    ),
    "anti_missing": (anti_missing, "SELECT c_name AS name FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_custkey IS NOT NULL AND o_orderpriority = '1-URGENT')"),
    "pref_language": (
        pref_language,
        """WITH seen AS (SELECT source, lang AS tag, min(doc_id) AS tag_pos FROM documents WHERE lang IS NOT NULL AND source IS NOT NULL GROUP BY 1, 2),
        placed AS (SELECT *, CASE WHEN tag = 'de' THEN 1 WHEN tag = 'en' THEN 2 END AS place FROM seen),
        kept AS (SELECT *, max(place) OVER (PARTITION BY source) AS any_place, min(tag_pos) OVER (PARTITION BY source) AS first_pos FROM placed)
        SELECT source, tag, row_number() OVER (PARTITION BY source ORDER BY place NULLS LAST, tag_pos) AS out_pos FROM kept WHERE place IS NOT NULL OR (any_place IS NULL AND tag_pos = first_pos)""",
    ),
    "first_nonempty_source": (
        first_nonempty_source,
        """WITH hits AS (SELECT doc_id, coalesce(lang, '') || ' ' || coalesce(n_chars, 0) // 100 AS question, coalesce(TRY_CAST(regexp_extract(source, '([0-9]+)$', 1) AS BIGINT), 999999) AS source_rank FROM documents)
        SELECT doc_id, question, source_rank FROM hits QUALIFY source_rank = min(source_rank) OVER (PARTITION BY question)""",
    ),
    "top_candidates": (top_candidates, "SELECT o_custkey, o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS rank FROM orders QUALIFY rank <= 5"),
    "image_cache": (image_cache, "SELECT page_id, substring(sha1(url), 1, 20) || '.img' AS cache_key, url_encode(url) AS encoded FROM pages"),
}
