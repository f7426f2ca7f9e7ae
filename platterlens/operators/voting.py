"""Votes and other ways for many readings to become one: pluralities, modes, quantiles by index, clusters, splits."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.strings import drawn_alike, same_letter
from ..shared import kept

#: Ranges that a group's values are summed in before one of them is sorted.
RANGES = 64


def ranked(votes: DataFrame) -> DataFrame:
    """(key, total, n_labels, top, top_n, second, second_n) of votes (key, label, n): most votes first, then by label.

    Votes fold before they are shuffled, so a key with a third of all votes is one row for each label and task.
    """
    sums = votes.groupBy("key", "label").agg(F.sum("n").alias("n"))
    order = F.array_sort(F.collect_list(F.struct((-F.col("n")).alias("m"), "label")))
    both = sums.groupBy("key").agg(F.sum("n").alias("total"), F.count("*").alias("n_labels"), order.alias("o"))
    first, second = F.get("o", F.lit(0)), F.get("o", F.lit(1))
    return both.select("key", "total", "n_labels", first["label"].alias("top"), (-first["m"]).alias("top_n"), second["label"].alias("second"), (-second["m"]).alias("second_n"))


def settle(votes: DataFrame, agreement: float = 0.8, covered: float = 0.7, least_second: int = 8, second_share: float = 0.05, collisions: bool = True) -> DataFrame:
    """(key, text, total, top_n): the label of each key, or two as `a|b` where both are real, or null if undecided.

    In order: two strokes drawn alike, the second with 5 votes and a twentieth; a top with its share; one letter with and
    without accent; two that cover most between them.
    """
    r = ranked(votes)
    two = F.concat_ws("|", "top", "second")
    share = lambda c: F.col(c) / F.col("total")
    both = F.col("top_n") + F.col("second_n")
    text = F.when(F.lit(collisions) & drawn_alike(F.col("top"), F.col("second")) & (F.col("second_n") >= 5) & (share("second_n") >= 0.05), two)
    text = text.when(share("top_n") >= agreement, F.col("top"))
    text = text.when(F.lit(collisions) & same_letter(F.col("top"), F.col("second")) & (F.col("second_n") >= 2) & (both / F.col("total") >= 0.9), two)
    text = text.when((both / F.col("total") >= covered) & (F.col("second_n") >= least_second) & (share("second_n") >= second_share), two)
    return r.select("key", text.alias("text"), "total", "top_n")


def mode(rows: DataFrame, by: list[str], value: str) -> DataFrame:
    """The commonest value of each group, the smallest of equals."""
    counts = rows.groupBy(*by, value).agg(F.count("*").alias("n"))
    best = counts.groupBy(*by).agg(F.min(F.struct((-F.col("n")).alias("m"), F.col(value).alias("value"))).alias("b"))
    return best.select(*by, F.col("b.value").alias(value), (-F.col("b.m")).alias("n"))


def joined_by(left: DataFrame, right: DataFrame, by: list[str], how: str = "inner") -> DataFrame:
    """left with the columns of right (by, ...), nulls of by being equal."""
    renamed = right.withColumnsRenamed({c: f"__by_{c}" for c in by})
    same = [F.col(c).eqNullSafe(F.col(f"__by_{c}")) for c in by]
    return left.join(renamed, same, how).drop(*(f"__by_{c}" for c in by))


def index_quantile(rows: DataFrame, by: list[str], value: str, num: int, den: int) -> DataFrame:
    """The value at index n * num / den (whole division) of each group's sorted values, which are numbers.

    Equal values fold to counts first, so a hot group sends one row for each distinct value and task, not all its rows.
    Values fall in RANGES ranges by cuts that are about its quantiles; only the range in which the index lies is sorted. Cuts
    depend on the order in which tasks' summaries meet, so they are written once, as the counts are: sums of ranges and rows need the same.
    """
    counts = kept(rows.filter(F.col(value).isNotNull()).groupBy(*by, value).agg(F.count("*").alias("__n")), "counts")
    whole = kept(counts.groupBy(*by).agg(F.sum("__n").alias("__all"), F.percentile_approx(value, [i / RANGES for i in range(1, RANGES)], 20 * RANGES).alias("__cuts")), "cuts")
    ranged = joined_by(counts, whole, by).withColumn("__range", F.size(F.filter("__cuts", lambda c: c < F.col(value)))).drop("__cuts")
    sums = ranged.groupBy(*by, "__range").agg(F.sum("__n").alias("__sum"))
    before = F.sum("__sum").over(Window.partitionBy(*by).orderBy("__range").rowsBetween(Window.unboundedPreceding, 0)) - F.col("__sum")
    at = F.floor(F.col("__all") * num / den)
    held = joined_by(ranged, sums.withColumn("__before", before), [*by, "__range"]).filter((F.col("__before") <= at) & (F.col("__before") + F.col("__sum") > at))
    end = F.col("__before") + F.sum("__n").over(Window.partitionBy(*by, "__range").orderBy(value).rowsBetween(Window.unboundedPreceding, 0))
    ends = held.withColumn("__end", end)
    return ends.filter((F.col("__end") > at) & (F.col("__end") - F.col("__n") <= at)).select(*by, value, F.col("__all").alias("n"))


def densest_cluster(rows: DataFrame, by: list[str], value: str, pos: str, window) -> DataFrame:
    """Rows within `window` of each group's seed: the row with most others within it, the LAST in `pos` of equals.

    Counts come from a range frame over the sorted values, not from pairs.
    """
    near = Window.partitionBy(*by).orderBy(value).rangeBetween(-window, window)
    counted = rows.withColumn("__near", F.count("*").over(near))
    seeds = counted.groupBy(*by).agg(F.max(F.struct("__near", pos, F.col(value).alias("v"))).alias("s")).select(*by, F.col("s.v").alias("__seed"), F.col("s.__near").alias("cluster_size"))
    return counted.drop("__near").join(seeds, by).filter(F.abs(F.col(value) - F.col("__seed")) <= window).drop("__seed")


def otsu(rows: DataFrame, by: list[str], value: str) -> DataFrame:
    """(by, threshold, n): the split of each group's whole values that parts them best in two (largest variance between
    the classes, the lowest split of equals); threshold is the first value of the upper class's range."""
    hist = rows.filter(F.col(value).isNotNull()).groupBy(*by, value).agg(F.count("*").alias("c"))
    run = Window.partitionBy(*by).orderBy(value).rowsBetween(Window.unboundedPreceding, 0)
    whole = Window.partitionBy(*by)
    mass = F.col(value) * F.col("c")
    sums = hist.withColumns({"w0": F.sum("c").over(run), "s0": F.sum(mass).over(run), "w": F.sum("c").over(whole), "s": F.sum(mass).over(whole)})
    d = lambda c: F.col(c).cast("double")
    w1 = F.col("w") - F.col("w0")
    m0, m1 = d("s0") / d("w0"), (d("s") - d("s0")) / F.nullif(w1, F.lit(0))
    var = d("w0") * w1 * (m0 - m1) * (m0 - m1)
    best = sums.withColumn("var", var).filter("var is not null").groupBy(*by).agg(F.max(F.struct("var", (-F.col(value)).alias("at"))).alias("b"), F.first("w").alias("n"))
    return best.select(*by, (1 - F.col("b.at")).cast("long").alias("threshold"), "n")


def coverage(shapes: DataFrame, known: DataFrame, by: list[str]) -> DataFrame:
    """(by, covered, total): of shapes (by, key, n) how many instances have a key of known (key)."""
    hit = shapes.join(known.select("key").distinct().withColumn("__known", F.lit(True)), "key", "left")
    return hit.groupBy(*by).agg(F.sum(F.when(F.col("__known"), F.col("n")).otherwise(0)).alias("covered"), F.sum("n").alias("total"))


def first_seen(rows: DataFrame, by: list[str], value: str, order: list[str]) -> DataFrame:
    """The distinct values of each group in the order they are first seen in."""
    firsts = rows.groupBy(*by, value).agg(F.min(F.struct(*order)).alias("at"))
    return firsts.groupBy(*by).agg(F.transform(F.array_sort(F.collect_list(F.struct("at", value))), lambda x: x[value]).alias("values"))


def top_each(rows: DataFrame, by: list[str], score: Column, ties: list[str], k: int) -> DataFrame:
    """The k best rows of each group, ties in input order, with their rank."""
    order = Window.partitionBy(*by).orderBy(score.desc(), *ties)
    return rows.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


def listed_tags(tags: DataFrame, by: list[str]) -> DataFrame:
    """(by, tags): the distinct tags of tags (by, kind, pos, tag), those of the first kind as they come, then what only later
    kinds have."""
    best = tags.groupBy(*by, "tag").agg(F.min(F.struct("kind", "pos")).alias("at"))
    return best.groupBy(*by).agg(F.transform(F.array_sort(F.collect_list(F.struct("at", "tag"))), lambda t: t.tag).alias("tags"))
