"""Half-open intervals: unions, overwriting, and what is left of a recovery map."""

from __future__ import annotations

from collections.abc import Iterator
from heapq import heappop, heappush

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.sentences import rescue_summary
from .voting import joined_by

#: Cells that a group's axis is divided into at most, a power of two, and rows for one.
CELLS, CELL_ROWS = 4096, 256


def union(ranges: DataFrame, by: list[str]) -> DataFrame:
    """(by, start, end): overlapping or touching ranges joined; empty ones go."""
    order = Window.partitionBy(*by).orderBy("start", "end")
    before = F.max("end").over(order.rowsBetween(Window.unboundedPreceding, -1))
    opens = ranges.filter("start < end").withColumn("__open", F.when(F.col("start") <= before, 0).otherwise(1))
    islands = opens.withColumn("__island", F.sum("__open").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    return islands.groupBy(*by, "__island").agg(F.min("start").alias("start"), F.max("end").alias("end")).drop("__island")


def divided(rows: DataFrame, by: list[str], start: str, end: str) -> DataFrame:
    """rows with __lo, where their group's axis begins, and __width, that of its cells: as many equal stretches as the group
    has CELL_ROWS rows, CELLS at most. A group with a third of all rows is that many keys; a small one is a single cell."""
    sizes = rows.groupBy(*by).agg(F.count("*").alias("__n"), F.min(start).alias("__lo"), F.max(end).alias("__hi"))
    cells = F.least(F.greatest(F.ceil(F.col("__n") / CELL_ROWS), F.lit(1)), F.lit(CELLS))
    width = F.greatest(F.ceil((F.col("__hi") - F.col("__lo") + 1) / cells), F.lit(1)).cast("long")
    return joined_by(rows, sizes.select(*by, F.col("__lo").cast("long").alias("__lo"), width.alias("__width")), by)


def cell_of(at: Column) -> Column:
    return F.floor((at - F.col("__lo")) / F.col("__width")).cast("int")


def swept(pieces: list[dict]) -> list[tuple[int, int, str]]:
    """(start, end, state) of pieces (start, end, seq, state): the latest at each place, neighbours of one state as one run. A
    heap holds the pieces that are open, the latest first; those that have ended leave it when they come to its top."""
    rows = sorted((p["start"], p["end"], p["seq"], p["state"]) for p in pieces)
    cuts = sorted({c for r in rows for c in r[:2]})
    heap: list[tuple] = []
    out: list[tuple[int, int, str]] = []
    at = 0
    ranks = {x: -i for i, x in enumerate(sorted({r[2:] for r in rows}))}
    for here, to in zip(cuts, cuts[1:]):
        while at < len(rows) and rows[at][0] == here:
            heappush(heap, (ranks[rows[at][2:]], rows[at][1], rows[at][3]))
            at += 1
        while heap and heap[0][1] <= here:
            heappop(heap)
        if heap:
            state = heap[0][2]
            if out and out[-1][1:] == (here, state):
                out[-1] = out[-1][0], to, state
            else:
                out.append((here, to, state))
    return out


def overwrite(writes: DataFrame, by: list[str]) -> DataFrame:
    """(by, start, end, state) after all writes (by, seq, start, end, state), the later over the earlier (of equal seq, the larger
    state); neighbours of one state are one run.

    The axis of each map is divided into cells. A write belongs to the two cells that it begins and ends in; what it covers
    between them is told to at most two nodes a level of a binary tree over the cells, where only the latest counts, so
    each cell learns the latest write that covers it whole. A sweep over the cell's own writes and that one gives its runs,
    and runs that touch a cell's edge are joined with their neighbours. Work grows with the writes, however they overlap.
    """
    kept = writes.filter("start < end").select(*by, F.col("seq").cast("long").alias("seq"), F.col("start").cast("long").alias("start"), F.col("end").cast("long").alias("end"), "state")
    placed = divided(kept, by, "start", "end").withColumns({"__first": cell_of(F.col("start")), "__last": cell_of(F.col("end") - 1)})
    low, high = F.col("__lo") + F.col("cell") * F.col("__width"), F.col("__lo") + (F.col("cell") + 1) * F.col("__width")
    own = placed.withColumn("cell", F.explode(F.array_distinct(F.array("__first", "__last"))))
    own = own.select(*by, "cell", "__lo", "__width", F.greatest("start", low).alias("start"), F.least("end", high).alias("end"), "seq", "state")
    left, right = F.col("__first") + 1 + CELLS, F.col("__last") + CELLS
    nodes = []
    for k in range(CELLS.bit_length()):
        a, b = F.shiftright(left + ((1 << k) - 1), k), F.shiftright(right, k)
        nodes += [F.when((a < b) & (a % 2 == 1), a), F.when((a < b) & (b % 2 == 1), b - 1)]
    told = placed.filter("__last > __first + 1").select(*by, "__lo", "__width", F.struct("seq", "state").alias("w"), F.explode(F.filter(F.array(*nodes), lambda x: x.isNotNull())).alias("node"))
    best = told.groupBy(*by, "__lo", "__width", "node").agg(F.max("w").alias("w"))
    level = F.floor(F.log2(F.col("node").cast("double")) + 1e-9).cast("int")
    span = F.pow(F.lit(2.0), CELLS.bit_length() - 1 - level).cast("int")
    cells = best.withColumn("cell", F.explode(F.sequence(F.col("node") * span - CELLS, (F.col("node") + 1) * span - CELLS - 1)))
    whole = cells.groupBy(*by, "__lo", "__width", "cell").agg(F.max("w").alias("w")).select(*by, "cell", "__lo", "__width", low.alias("start"), high.alias("end"), "w.seq", "w.state")
    gathered = own.unionByName(whole).groupBy(*by, "cell", "__lo", "__width").agg(F.collect_list(F.struct("start", "end", "seq", "state")).alias("pieces"))
    held = [c for c in gathered.columns if c != "pieces"]
    run_type = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("state", pa.string())]))
    schema = gathered.select(*held).schema.add("runs", T.ArrayType(T.StructType([T.StructField("start", T.LongType()), T.StructField("end", T.LongType()), T.StructField("state", T.StringType())])))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            runs = [[dict(zip(("start", "end", "state"), r)) for r in swept(p)] for p in batch.column("pieces").to_pylist()]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in held), pa.array(runs, run_type)], [*held, "runs"])

    runs = gathered.mapInArrow(run, schema).select(*by, low.alias("__from"), high.alias("__to"), F.explode("runs").alias("r")).select(*by, "__from", "__to", "r.*")
    edge = (F.col("start") == F.col("__from")) | (F.col("end") == F.col("__to"))
    order = Window.partitionBy(*by).orderBy("start")
    same = (F.lag("state").over(order) == F.col("state")) & (F.lag("end").over(order) == F.col("start"))
    at_edges = runs.filter(edge).withColumn("__run", F.sum(F.when(same, 0).otherwise(1)).over(order.rowsBetween(Window.unboundedPreceding, 0)))  # two a cell at most
    joined = at_edges.groupBy(*by, "__run").agg(F.min("start").alias("start"), F.max("end").alias("end"), F.first("state").alias("state")).drop("__run")
    return runs.filter(~edge).select(*by, "start", "end", "state").unionByName(joined)


def covered(points: DataFrame, ranges: DataFrame, by: list[str]) -> DataFrame:
    """points (by, at, ...) with covered, whether any of ranges (by, start, end) holds them. One sweep of both together with the
    largest end so far, cell by cell, each cell being told the largest end of the cells before: no pairs are made, and
    ranges may overlap and nest."""
    row = F.struct(*points.columns)
    asked = points.select(*by, F.col("at").cast("long").alias("__at"), F.lit(1).alias("__kind"), F.lit(None).cast("long").alias("__end"), row.alias("__row"))
    spans = ranges.filter("start < end").select(*by, F.col("start").cast("long").alias("__at"), F.lit(0).alias("__kind"), F.col("end").cast("long").alias("__end"), F.lit(None).cast(asked.schema["__row"].dataType).alias("__row"))
    placed = divided(asked.unionByName(spans), by, "__at", "__at").withColumn("__cell", cell_of(F.col("__at")))
    ends = placed.groupBy(*by, "__cell").agg(F.max("__end").alias("__end"))
    carried = ends.select(*by, "__cell", F.max("__end").over(Window.partitionBy(*by).orderBy("__cell").rowsBetween(Window.unboundedPreceding, -1)).alias("__carried"))
    order = Window.partitionBy(*by, "__cell").orderBy("__at", "__kind").rowsBetween(Window.unboundedPreceding, 0)
    reach = F.greatest(F.max("__end").over(order), F.col("__carried"))
    met = joined_by(placed, carried, [*by, "__cell"]).withColumn("__reach", reach)
    return met.filter("__kind = 1").select("__row.*", F.coalesce(F.col("__reach") > F.col("__at"), F.lit(False)).alias("covered"))


def summary(runs: DataFrame, by: list[str], states: list[str]) -> DataFrame:
    """Total length of each map, and of each state."""
    size = F.greatest(F.col("end") - F.col("start"), F.lit(0))
    return runs.groupBy(*by).agg(F.sum(size).alias("total"), *(F.coalesce(F.sum(F.when(F.col("state") == s, size)), F.lit(0)).alias(s) for s in states))


def rescue(sectors: DataFrame, by: list[str], retries: int = 2) -> DataFrame:
    """Runs of the map that copying, trimming, scraping and retrying leave of sectors (by, lba, readable, readable_at):
    a sector is Finished if it can be read at once or by retry `readable_at`, else Bad. Passes end in this state
    whatever their order; only what they read on the way differs."""
    got = F.col("readable") | F.coalesce(F.col("readable_at") <= retries, F.lit(False))
    state = sectors.select(*by, "lba", F.when(got, "Finished").otherwise("Bad").alias("state"))
    order = Window.partitionBy(*by).orderBy("lba")
    same = (F.lag("state").over(order) == F.col("state")) & (F.lag("lba").over(order) + 1 == F.col("lba"))
    runs = state.withColumn("__run", F.sum(F.when(same, 0).otherwise(1)).over(order.rowsBetween(Window.unboundedPreceding, 0)))
    return runs.groupBy(*by, "__run").agg(F.min("lba").alias("start"), (F.max("lba") + 1).alias("end"), F.first("state").alias("state")).drop("__run")


def last_look(flags: DataFrame, by: list[str]) -> DataFrame:
    """Of flags (by, lba, seq, damaged) the sectors whose last look found damage."""
    return flags.groupBy(*by, "lba").agg(F.max_by("damaged", "seq").alias("damaged")).filter("damaged").drop("damaged")


def chain_numbers(specs: DataFrame, spec: str) -> DataFrame:
    """specs with numbers: `2-4,9` as sorted distinct numbers; a range that runs backwards is an error (null)."""
    parts = F.split(spec, ",")
    ends = F.transform(parts, lambda p: F.struct(F.trim(F.split(p, "-")[0]).try_cast("int").alias("a"), F.trim(F.element_at(F.split(p, "-"), -1)).try_cast("int").alias("b")))
    good = F.forall(ends, lambda e: e.a.isNotNull() & e.b.isNotNull() & (e.a <= e.b))
    return specs.withColumn("numbers", F.when(good, F.array_sort(F.array_distinct(F.flatten(F.transform(ends, lambda e: F.sequence(e.a, F.greatest(e.a, e.b))))))))


def report(runs: DataFrame, by: list[str], sector_bytes: int) -> DataFrame:
    """(by, summary, done, first_start) of runs (by, start, end, state): what is recovered, left and bad in a sentence,
    whether nothing is left to try, and where the first run that is begins."""
    sizes = summary(runs, by, ["Finished", "Bad"])
    first = runs.groupBy(*by).agg(F.bool_and(F.col("state").isin("Finished", "Bad")).alias("done"), F.min(F.when(F.col("state") == "Untried", F.col("start"))).alias("first_start"))
    left = F.col("total") - F.col("Finished") - F.col("Bad")
    return sizes.join(first, by).select(*by, rescue_summary(F.col("Finished"), left, F.col("Bad"), sector_bytes).alias("summary"), "done", "first_start")


def in_state(runs: DataFrame, state: str, by: list[str]) -> tuple[DataFrame, DataFrame]:
    """The runs of one state, and the first of each map."""
    mine = runs.filter(F.col("state") == state)
    return mine, mine.groupBy(*by).agg(F.min(F.struct("start", "end", "state")).alias("run")).select(*by, "run.*")


def pregaps(sectors: DataFrame, by: list[str]) -> DataFrame:
    """(by, track, pregap) of sectors (by, track, lba, seq, index, countdown): by the first sector filed under a track, 0 if
    its index is not 0, else one more than what it counts down."""
    first = sectors.groupBy(*by, "track").agg(F.min_by(F.struct("index", "countdown"), F.struct("lba", "seq")).alias("q"))
    return first.select(*by, "track", F.when(F.col("q.index") != 0, F.lit(0)).otherwise(F.col("q.countdown") + 1).cast("long").alias("pregap"))
