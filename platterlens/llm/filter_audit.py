"""An audit of how filters interact: what each removes in every order, by Walsh-Hadamard sums.

Five filters are judged for every document by itself, which gives a mask of five bits: which of them it fails. For each part
(a language) and each label, 32 signed sums are added up, one for each set of filters: a document counts as -1 if it fails an
odd number of the set, else as 1. The sums are an exact, invertible image of how many documents have which mask (the inverse
is the same transform over 32), and they add up task by task, so however many rows a part has, what is shuffled is 32 numbers
for each task, part and label. From the 32 cells of a part everything follows without looking at documents again: what is
kept, removed and redundant at each step of each of the 120 orders, and the filters' Shapley values, for a document that
fails f filters is removed by each of them in 120 / f of the orders.

How it is spread out: texts are read once, where they lie, into a narrow table (id, part, digest, mask). Which texts came
before is found from digests alone: the smallest id of each digest that has several, summed up in the tasks first and
written down, meets the rows in a join that adaptive execution can split, so a text that fills a third of the rows is no
bottleneck. Labels meet the rows by id likewise.

Defined cases: null text counts as empty; a null part is the empty string's; empty text fails the first filter alone (and the
last, where another empty text has a smaller id); rows that repeat one id and text are equal in id, so none of them fails
the last filter for another's sake; a row without an id fails it never, is no row's predecessor, and has no label; if labels
repeat an id, any of its rows marks it; an empty table gives no parts; texts are read whole; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import permutations
from string import ascii_uppercase

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import documents, sliced, written
from .exact_dedup import content_key

#: The filters' letters (bit i of a mask is the i-th), and how few words, how small a share of distinct words, and
#: how large a share of capitals fail.
FILTERS = "ABCDE"
LEAST_WORDS, LEAST_DISTINCT, MOST_CAPITALS = 100, 80, 10
#: Characters of which one is enough to fail.
SYMBOLS = b"#$%&*|"

_CAPITALS = ascii_uppercase.encode()
CELLS = 1 << len(FILTERS)
_REPEATED = 1 << FILTERS.index("E")


def own_mask(text: str) -> int:
    """Bits of the filters that a text fails by itself."""
    data = text.encode()
    words = data.split()
    return (
        (len(words) < LEAST_WORDS)
        | (100 * len(set(words)) < LEAST_DISTINCT * len(words)) << 1
        | (100 * (len(data) - len(data.translate(None, _CAPITALS))) > MOST_CAPITALS * len(text)) << 2
        | (len(data.translate(None, SYMBOLS)) < len(data)) << 3
    )


def masked(docs: DataFrame, part: str = "lang", text: str = "text") -> DataFrame:
    """(doc_id, part, digest, mask) of docs: what each text fails by itself."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches):
            masks = pa.array([own_mask(t or "") for t in batch.column("text").to_pylist()], pa.int32())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("part"), batch.column("digest"), masks], ["doc_id", "part", "digest", "mask"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col(part).cast("string"), F.lit("")).alias("part"), content_key(text).alias("digest"), F.col(text).cast("string").alias("text"))
    return rows.mapInArrow(run, "doc_id long, part string, digest binary, mask int")


def failures(docs: DataFrame, part: str = "lang", text: str = "text") -> DataFrame:
    """(doc_id, part, mask) of docs, one row each: the filters that each document fails, repeated texts included."""
    rows = written(masked(docs, part, text), "masks")
    ids = rows.groupBy("digest").agg(F.min("doc_id").alias("first"), F.max("doc_id").alias("last"))
    firsts = written(ids.filter("first < last").select("digest", "first"), "first-ids")
    again = F.coalesce(F.col("doc_id") > F.col("first"), F.lit(False))
    return rows.join(firsts, "digest", "left").select("doc_id", "part", F.col("mask").bitwiseOR(F.when(again, _REPEATED).otherwise(0)).alias("mask"))


def parity_sums(failed: DataFrame, labels: DataFrame) -> DataFrame:
    """(part, label, sums) of failed (doc_id, part, mask) and labels (doc_id, quality, toxic): 32 signed sums for each part
    and label. Labels: all, good, toxic."""
    marked = written(labels.groupBy("doc_id").agg(F.max(F.coalesce(F.col("quality") == 1, F.lit(False))).alias("good"), F.max(F.coalesce(F.col("toxic") == 1, F.lit(False))).alias("toxic")).filter("good or toxic"), "marks")
    rows = failed.join(marked, "doc_id", "left")
    names = F.array(F.lit("all"), F.when(F.col("good"), F.lit("good")), F.when(F.col("toxic"), F.lit("toxic")))
    each = rows.select("part", "mask", F.explode(F.filter(names, lambda x: x.isNotNull())).alias("label"))
    sums = [F.sum(F.lit(1) - 2 * (F.bit_count(F.col("mask").bitwiseAND(F.lit(k))) % 2)).cast("long").alias(f"s{k}") for k in range(CELLS)]
    return each.groupBy("part", "label").agg(*sums).select("part", "label", F.array(*(f"s{k}" for k in range(CELLS))).alias("sums"))


def inverted(sums: Column) -> Column:
    """How many documents have each mask, from their signed sums: the same transform again, over their number."""
    sign = lambda k, m: F.lit(1) - 2 * (F.bit_count(k.bitwiseAND(m)) % 2)
    total = lambda m: F.aggregate(F.transform(sums, lambda s, k: s * sign(k, m)), F.lit(0).cast("long"), lambda a, x: a + x)
    return F.transform(F.sequence(F.lit(0), F.lit(CELLS - 1)), lambda m: F.shiftright(total(m), len(FILTERS)))


def cells(sums: DataFrame) -> DataFrame:
    """(part, all, good, toxic): for each part an array of 32 counts for each label, zeros where a part has no such label."""
    zeros = F.array_repeat(F.lit(0).cast("long"), CELLS)
    found = sums.groupBy("part").agg(*(F.max(F.when(F.col("label") == x, F.col("sums"))).alias(x) for x in ("all", "good", "toxic")))
    return found.select("part", *(inverted(F.coalesce(F.col(x), zeros)).alias(x) for x in ("all", "good", "toxic")))


def evaluated(parts: DataFrame) -> DataFrame:
    """Every order and step of parts (part, all, good, toxic): a row for each part, order and filter in it."""
    orders = ["".join(p) for p in permutations(FILTERS)]
    n = len(FILTERS)
    steps = parts.withColumn("__i", F.explode(F.sequence(F.lit(0), F.lit(n * len(orders) - 1))))
    told = steps.withColumns({"filter_order": F.element_at(F.array(*map(F.lit, orders)), F.floor(F.col("__i") / n).cast("int") + 1), "step": (F.col("__i") % n + 1).cast("int")})
    letter = lambda k: F.instr(F.lit(FILTERS), F.col("filter_order").substr(k, F.lit(1)))
    bit = lambda k: F.pow(F.lit(2.0), letter(k) - 1).cast("int")
    earlier = F.aggregate(F.sequence(F.lit(1), F.lit(n)), F.lit(0), lambda a, k: a + F.when(k < F.col("step"), bit(k)).otherwise(0))
    told = told.withColumns({"__own": bit(F.col("step")), "__before": earlier})

    def total(counts: str, wanted, weight=lambda m: F.lit(1)) -> Column:
        each = F.transform(F.col(counts), lambda c, m: F.when(wanted(m), c * weight(m)).otherwise(0).cast("long"))
        return F.aggregate(each, F.lit(0).cast("long"), lambda a, x: a + x)

    fails = lambda m: m.bitwiseAND(F.col("__own")) != 0
    before = lambda m: m.bitwiseAND(F.col("__before")) != 0
    removed = lambda m: fails(m) & ~before(m)
    share = lambda m: F.floor(F.lit(len(orders)) / F.greatest(F.bit_count(m), F.lit(1)))
    return told.select(
        "part",
        "filter_order",
        "step",
        total("all", lambda m: ~fails(m) & ~before(m)).alias("kept"),
        total("all", removed).alias("removed"),
        total("all", lambda m: fails(m) & before(m)).alias("redundant"),
        total("all", lambda m: m == F.col("__own")).alias("unique_fails"),
        total("good", removed).alias("good_lost"),
        total("toxic", removed).alias("toxic_lost"),
        total("all", fails, share).alias("shapley"),
    )


def audit(docs: DataFrame, labels: DataFrame, part: str = "lang", text: str = "text") -> DataFrame:
    """The whole audit of docs (doc_id, part, text): see evaluated()."""
    return evaluated(cells(parity_sums(failures(docs, part, text), labels)))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))


ORACLE = r"""
WITH rows AS (
  SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words FROM documents
), marks AS (
  SELECT doc_id, bool_or(coalesce(quality = 1, false)) AS good, bool_or(coalesce(toxic = 1, false)) AS toxic FROM labels GROUP BY doc_id
), judged AS (
  SELECT part, coalesce(good, false) AS good, coalesce(toxic, false) AS toxic,
         [len(words) < 100, 100 * len(list_distinct(words)) < 80 * len(words), 100 * (length(t) - length(regexp_replace(t, '[A-Z]', '', 'g'))) > 10 * length(t),
          regexp_matches(t, '[#$%&*|]'), coalesce(r.doc_id > min(r.doc_id) OVER (PARTITION BY t), false)] AS fails
  FROM rows r LEFT JOIN marks m ON r.doc_id = m.doc_id
), letters AS (
  SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS x, unnest([1, 2, 3, 4, 5]) AS k
), orders AS (
  SELECT a.x || b.x || c.x || d.x || e.x AS filter_order, [a.k, b.k, c.k, d.k, e.k] AS ks FROM letters a, letters b, letters c, letters d, letters e
  WHERE len(list_distinct([a.k, b.k, c.k, d.k, e.k])) = 5
), steps AS (
  SELECT filter_order, step, ks[step] AS k, ks[1:step - 1] AS earlier FROM orders, (SELECT unnest([1, 2, 3, 4, 5]) AS step)
), kinds AS (
  SELECT part, fails, count(*) AS n, count(*) FILTER (WHERE good) AS n_good, count(*) FILTER (WHERE toxic) AS n_toxic FROM judged GROUP BY part, fails
), met AS (
  SELECT part, filter_order, step, k, n, n_good, n_toxic, fails[k] AS fail, len(list_filter(earlier, lambda j: fails[j])) > 0 AS gone, len(list_filter(fails, lambda f: f)) AS n_failed FROM kinds, steps
), found AS (
  SELECT part, filter_order, step, k, sum(CASE WHEN NOT fail AND NOT gone THEN n ELSE 0 END) AS kept, sum(CASE WHEN fail AND NOT gone THEN n ELSE 0 END) AS removed,
         sum(CASE WHEN fail AND gone THEN n ELSE 0 END) AS redundant, sum(CASE WHEN fail AND n_failed = 1 THEN n ELSE 0 END) AS unique_fails,
         sum(CASE WHEN fail AND NOT gone THEN n_good ELSE 0 END) AS good_lost, sum(CASE WHEN fail AND NOT gone THEN n_toxic ELSE 0 END) AS toxic_lost
  FROM met GROUP BY ALL
)
SELECT part, filter_order, CAST(step AS INTEGER) AS step, CAST(kept AS BIGINT) AS kept, CAST(removed AS BIGINT) AS removed, CAST(redundant AS BIGINT) AS redundant,
       CAST(unique_fails AS BIGINT) AS unique_fails, CAST(good_lost AS BIGINT) AS good_lost, CAST(toxic_lost AS BIGINT) AS toxic_lost,
       CAST(sum(removed) OVER (PARTITION BY part, k) AS BIGINT) AS shapley
FROM found
"""
