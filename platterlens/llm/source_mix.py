"""Mixing sources to target weights with a multivariate-hypergeometric splitting tree.

1. Targets. Sources in order of code point, null last, take the weights 5, 2, 1 in turn and share `share` of all words; a
   target stops at `most` times its source's words, and what is over is shared again by weight until no target is above.
2. Blocks. A source's documents are dealt by a seeded hash into blocks of about BLOCK documents. Whole passes take every
   block once; what a target asks beyond whole passes is a draw without replacement: blocks in a seeded order until the
   words are reached, the last one only in part: those of its documents that bring the sum nearest.
3. Splitting tree. The output shards are the leaves of a binary tree. At each node the exact numbers of blocks of every
   source are split between the two sides by a multivariate-hypergeometric draw, seeded by the node, so every shard
   gets an exact quota of every source and the quotas add up. Blocks in seeded order fill the quotas, so they are
   disjoint; within a shard, rows are put in a seeded order.

Texts are read twice: once for a narrow table of (source, size, hash), from which all draws are made, and once for the
rows themselves. The driver handles source totals and block counts, never documents: MAX_SOURCES sources at most, which is
checked, and CELLS numbers of blocks by shard and source. Hot sources are many blocks; sums fold before they are shuffled.
All draws are functions of the seed and the ids, so reruns and retried tasks agree.

Defined cases: null text has size 0; a null source is a source of its own, the last one; sources without words get
target 0; documents of size 0 are taken with their block and count nothing; repeated rows lie in one block and count one
by one; an empty table gives an empty result; extra columns pass through, whatever their names, but for those that have
the names of results (size, source_size, target, units; pass, shard, place of `mix`), which are replaced.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import WORD, documents, drop_written, written

WEIGHTS, SHARE, MOST = (5, 2, 1), 1.5, 2.0
#: Documents in a block, about.
BLOCK = 512
#: Output shards at least, blocks in a shard, about, and shards whose bounds are searched together.
SHARDS, SHARD_BLOCKS, CHUNK = 64, 1024, 256
#: Words missing from which a boundary block is filled exactly, and ranges that a source's blocks are summed in first.
FINE, RANGES = 65_536, 1024
#: Sources at most (beyond them, name coarser ones), and numbers of blocks by shard and source that the driver holds.
MAX_SOURCES, CELLS = 65_536, 8_000_000


def word_count(text: Column) -> Column:
    return F.regexp_count(F.coalesce(text.cast("string"), F.lit("")), F.lit(WORD)).cast("long")


def targets(sizes: list[int], weights: tuple[float, ...] = WEIGHTS, share: float = SHARE, most: float = MOST) -> list[float]:
    """What each source, in order, is asked for."""
    out, left, open_ = [0.0] * len(sizes), share * sum(sizes), set(range(len(sizes)))
    while open_ and left > 1e-9:
        weight = sum(weights[i % len(weights)] for i in open_)
        over = {i for i in open_ if left * weights[i % len(weights)] / weight > most * sizes[i]}
        if not over:
            for i in open_:
                out[i] = left * weights[i % len(weights)] / weight
            break
        for i in over:
            out[i] = most * sizes[i]
            left -= out[i]
        open_ -= over
    return out


def quotas(blocks: list[int], shards: int, seed: int) -> np.ndarray:
    """[shards, sources] numbers of blocks, by the splitting tree."""
    out = np.zeros((shards, len(blocks)), np.int64)
    stack = [(0, shards, np.array(blocks, np.int64))]
    while stack:
        lo, hi, held = stack.pop()
        if hi - lo == 1:
            out[lo] = held
            continue
        mid = (lo + hi) // 2
        draw = np.random.default_rng([seed, lo, hi])
        take = int(held.sum()) * (mid - lo) // (hi - lo)
        left = draw.multivariate_hypergeometric(held, take, method="marginals") if len(held) else held
        stack += [(lo, mid, left), (mid, hi, held - left)]
    return out


def nearest(sizes: list[int], want: float) -> list[int]:
    """Places in sizes (largest first) whose sum comes nearest to want: largest first while much is missing, then exactly,
    by the set of all sums that the rest can make, as bits of a number."""
    taken, rest, left = [], [], want
    for i, size in enumerate(sizes):
        if left > FINE and size <= left:
            taken.append(i)
            left -= size
        elif 0 < size < 2 * left:
            rest.append(i)
    if left > FINE:  # whatever is left is larger than what is missing, so at most one goes in
        best = min(rest, key=lambda i: (abs(sizes[i] - left), i), default=None)
        return taken + [best] * (best is not None and abs(sizes[best] - left) < left)
    rest = [i for i in rest if sizes[i] < 2 * left]
    mask, reach = (1 << int(2 * left) + 1) - 1, [1]
    for i in rest:
        reach.append((reach[-1] | reach[-1] << sizes[i]) & mask)
    at = int(left)
    low = (reach[-1] & ((1 << at + 1) - 1)).bit_length() - 1
    above = reach[-1] >> at + 1
    high = at + (above & -above).bit_length() if above else None
    total = high if high is not None and high - left < left - low else low
    for k in range(len(rest), 0, -1):
        if not reach[k - 1] >> total & 1:
            taken.append(rest[k - 1])
            total -= sizes[rest[k - 1]]
    return taken


def _nearest(pdf: pd.DataFrame) -> pd.DataFrame:
    """The rows drawn of one boundary block. Rows with the same hash repeat one another and go together."""
    rows = pdf.groupby("h", as_index=False).agg(size=("size", "sum")).sort_values(["size", "h"], ascending=[False, True])
    hashes = rows["h"].tolist()
    drawn = [hashes[i] for i in nearest(rows["size"].tolist(), float(pdf["want"].iloc[0]))]
    return pd.DataFrame({"source_no": pdf["source_no"].iloc[:1], "block": pdf["block"].iloc[:1], "drawn": [drawn]})


def running(rows: DataFrame, order: Column, ties: list[str], value: Column, name: str) -> DataFrame:
    """rows with the sum of value over their source's rows up to each, in the given order of hashes.

    Hashes fall in RANGES ranges: each is summed first, those few sums run through, and only rows of one range are sorted
    together, so a source with a third of all rows is a thousand keys.
    """
    ranged = rows.withColumns({"__order": order, "__value": value}).withColumn("__range", F.shiftright("__order", 64 - RANGES.bit_length() + 1))
    sums = ranged.groupBy("source_no", "__range").agg(F.sum("__value").alias("__sum"))
    before = F.sum("__sum").over(Window.partitionBy("source_no").orderBy("__range").rowsBetween(Window.unboundedPreceding, 0)) - F.col("__sum")
    starts = sums.select("source_no", "__range", before.alias("__before"))
    within = Window.partitionBy("source_no", "__range").orderBy("__order", *ties).rowsBetween(Window.unboundedPreceding, 0)
    own = F.sum("__value").over(within)
    return ranged.join(starts, ["source_no", "__range"]).withColumn(name, own + F.col("__before")).drop("__order", "__value", "__range", "__before")


def _plan(narrow: DataFrame, seed: int, shards: int | None) -> tuple[DataFrame, DataFrame]:
    """Of narrow (source, size, h): the sources with their totals and targets, and what each block that is taken gives:
    (source_no, block, dealt, passes, part, drawn)."""
    spark = narrow.sparkSession
    totals = narrow.groupBy("source").agg(F.sum("size").alias("size"), F.count("*").alias("n")).limit(MAX_SOURCES + 1).collect()
    if len(totals) > MAX_SOURCES:
        raise ValueError(f"more than {MAX_SOURCES} sources")
    per_source = sorted(map(tuple, totals), key=lambda r: (r[0] is None, r[0] or ""))
    asked = targets([r[1] for r in per_source])
    sources = spark.createDataFrame(
        [(i, s, size, t, int(t // size) if size else 0, -(-n // BLOCK)) for i, ((s, size, n), t) in enumerate(zip(per_source, asked))],
        "source_no int, source string, source_size long, target double, passes int, n_blocks int",
    )
    keyed = narrow.join(sources.withColumnRenamed("source", "__source"), F.col("source").eqNullSafe(F.col("__source"))).drop("__source")
    keyed = keyed.withColumn("block", block_of(F.col("h"), F.col("n_blocks"), seed))

    # blocks: sums fold in the map tasks; windows run over blocks, not documents
    blocks = keyed.groupBy("source_no", "block").agg(F.sum("size").alias("words"), F.first("passes").alias("passes"), F.first("target").alias("target"), F.first("source_size").alias("source_size"))
    want = F.col("target") - F.col("passes") * F.col("source_size")
    blocks = running(blocks, F.xxhash64(F.lit(seed), "source_no", "block"), ["block"], F.col("words"), "end").withColumn("want", want)
    blocks = blocks.withColumn("want", F.col("want") - (F.col("end") - F.col("words")))
    blocks = written(blocks.select("source_no", "block", "passes", "want", (F.col("want") >= F.col("words")).alias("whole"), ((F.col("want") > 0) & (F.col("want") < F.col("words"))).alias("part")), "blocks")
    boundary = blocks.filter("part").select("source_no", "block", "want")
    parts = keyed.select("source_no", "block", "h", "size").join(boundary, ["source_no", "block"]).groupBy("source_no", "block").applyInPandas(_nearest, "source_no int, block int, drawn array<long>")

    # units: a block once for each pass that takes it, ranked within its source
    last = F.when(F.col("whole") | F.col("part"), 1).otherwise(0)
    units = blocks.withColumn("pass", F.explode(F.filter(F.sequence(F.lit(0), F.lit(int(MOST))), lambda p: p < F.col("passes") + last)))
    per = {r[0]: r[1] for r in units.groupBy("source_no").count().collect()}
    numbers = sorted(per)
    shards = shards or min(max(SHARDS, -(-sum(per.values()) // SHARD_BLOCKS)), max(1, CELLS // max(1, len(per))))
    split = quotas([per[i] for i in numbers], shards, seed).cumsum(axis=0)
    chunks = [[split[at : at + CHUNK, k].tolist() for at in range(0, shards, CHUNK)] for k in range(len(numbers))]
    bounds = spark.createDataFrame([(i, c, [x[-1] for x in c]) for i, c in zip(numbers, chunks)], "source_no int, bounds array<array<bigint>>, lasts array<bigint>")
    ranked = running(units, F.xxhash64(F.lit(seed + 1), "source_no", "block", "pass"), ["block", "pass"], F.lit(1).cast("long"), "rank")
    below = lambda found: F.size(F.filter(found, lambda b: b < F.col("rank")))
    dealt = ranked.join(bounds, "source_no").withColumn("__chunk", below(F.col("lasts")))
    dealt = dealt.withColumn("shard", F.col("__chunk") * CHUNK + below(F.get("bounds", F.col("__chunk"))))
    dealt = dealt.groupBy("source_no", "block").agg(F.array_sort(F.collect_list(F.struct("pass", "shard"))).alias("dealt"))
    dealt = dealt.join(blocks.filter("part").select("source_no", "block", "passes", F.lit(True).alias("part")), ["source_no", "block"], "left").join(parts, ["source_no", "block"], "left")
    told = written(dealt, "dealt")
    drop_written(blocks)
    return sources, told


def block_of(h: Column, n_blocks: Column, seed: int) -> Column:
    return F.pmod(F.xxhash64(h, F.lit(seed)), n_blocks.cast("long")).cast("int")


def _drawn(docs: DataFrame, seed: int, shards: int | None) -> DataFrame:
    """(row, size, source_size, target, units): a row's columns stay in one struct, so that no names can clash."""
    size, h = word_count(F.col("text")), F.xxhash64(F.lit(seed), F.col("doc_id").cast("string"), F.col("text"))
    narrow = written(docs.select(F.col("source").cast("string").alias("source"), size.alias("size"), h.alias("h")), "sizes")
    sources, dealt = _plan(narrow, seed, shards)
    drop_written(narrow)
    rows = docs.select(F.struct(*docs.columns).alias("row"), F.col("source").cast("string").alias("of"), size.alias("size"), h.alias("h"))
    keyed = rows.join(sources, F.col("of").eqNullSafe(F.col("source"))).withColumn("block", block_of(F.col("h"), F.col("n_blocks"), seed))
    taken = keyed.join(dealt.withColumnRenamed("passes", "whole_passes"), ["source_no", "block"], "left")
    mine = F.filter("dealt", lambda u: F.col("part").isNull() | (u["pass"] < F.col("whole_passes")) | F.coalesce(F.array_contains("drawn", F.col("h")), F.lit(False)))
    units = F.transform(mine, lambda u: F.struct(u["pass"].alias("pass"), u["shard"].alias("shard"), F.xxhash64(F.lit(seed + 2), u["pass"], F.col("h")).alias("place")))
    none = F.array().cast("array<struct<pass:int,shard:int,place:bigint>>")
    return taken.select("row", "size", "source_size", "target", F.coalesce(units, none).alias("units"))


def _own(docs: DataFrame, *results: str) -> list[Column]:
    return [F.col("row").getField(c).alias(c) for c in docs.columns if c not in results]


def draw(docs: DataFrame, seed: int = 17, shards: int | None = None) -> DataFrame:
    """docs with size, source_size, target and units: for each time the row is taken, its pass, shard and place there."""
    results = ("size", "source_size", "target", "units")
    return _drawn(docs, seed, shards).select(*_own(docs, *results), *results)


def mix(docs: DataFrame, seed: int = 17, shards: int | None = None) -> DataFrame:
    """One row for each time a row of docs is taken, with its pass, its shard, and its place in the shard's own shuffle."""
    taken = _drawn(docs, seed, shards).select("row", F.explode("units").alias("unit"))
    return taken.select(*_own(docs, "pass", "shard", "place"), "unit.pass", "unit.shard", "unit.place")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    drawn = draw(documents(spark, sf_dir).select("doc_id", "text", "source"))
    return drawn.select("doc_id", "size", "source_size", "target", (F.size("units") * F.col("size")).alias("taken"))


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: the mix, a row for each time a document is taken, in shards that are shuffled locally."""
    taken = _drawn(docs, 17, None).select("row", F.explode("units").alias("unit")).select("row", "unit.shard", "unit.place")
    return taken.repartition("shard").sortWithinPartitions("shard", "place").select("row.*")
