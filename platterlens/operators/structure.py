"""What the titles of a disc are to one another: play-alls, episodes, features, extras."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.arrays import SLIVER, TOLERANCE
from ..shared import kept
from .voting import densest_cluster

#: Milliseconds: what an episode lasts.
SHORTEST, LONGEST = 15 * 60_000, 45 * 60_000

ROLES = "disc_id string, key string, role string, out_pos int"


def _peeled(chapters: list[int], parts: list[tuple[str, list[int]]], own: str) -> tuple[list[str], list[int]]:
    """Parts that chapters begin with, one after the other and each once, and the chapters that remain."""
    order, at = [], 0
    while True:
        for key, want in parts:
            if at < len(chapters) and abs(chapters[at] - want[0]) <= TOLERANCE and key != own and key not in order and at + len(want) <= len(chapters) and all(abs(a - b) <= TOLERANCE for a, b in zip(chapters[at:], want)):
                order.append(key)
                at += len(want)
                break
        else:
            return order, chapters[at:]


def _of_disc(titles: list[dict]) -> list[tuple[str, str, int]]:
    """(key, role, place in it) of one disc's titles, in their order."""
    rows = [(t["key"], int(t["duration_ms"]), list(t["chapters"] or ())) for t in titles]
    episodic = {k for k, d, _ in rows if SHORTEST <= d <= LONGEST}
    parts = [(k, ch[:-1] if len(ch) > 1 and ch[-1] <= SLIVER else ch) for k, _, ch in rows if k in episodic and ch]
    play_alls, episodes = [], {}
    for key, _, chapters in rows:
        order, rest = _peeled(chapters, parts, key) if chapters else ([], [])
        if len(order) >= 2 and all(c <= SLIVER for c in rest):
            play_alls.append(key)
            episodes |= dict.fromkeys(order)
    others = [k for k, _, _ in rows if k not in episodes and k not in play_alls]
    said = [("play_all", play_alls), ("episode", episodes), ("loose", [k for k in others if k in episodic]), ("extra", [k for k in others if k not in episodic])]
    return [(k, role, i) for role, keys in said for i, k in enumerate(keys)]


def _decomposed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        found = [(disc, *x) for disc, titles in zip(batch.column("disc_id").to_pylist(), batch.column("titles").to_pylist()) for x in _of_disc(titles)]
        yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in found], pa.int32() if i == 3 else pa.string()) for i in range(4)], ["disc_id", "key", "role", "out_pos"])


def decompose(titles: DataFrame) -> DataFrame:
    """(disc_id, key, role, out_pos) of titles (disc_id, key, title_pos, duration_ms, chapters).

    A title whose chapters are those of two or more episodes, one after the other, is a play-all, and gives the episodes
    their order. Peeling is greedy and depends on the order of titles, so a disc, some tens of titles, is one value; batches
    of discs are taken apart together.
    """
    each = F.struct("title_pos", "key", F.col("duration_ms").cast("long").alias("duration_ms"), F.col("chapters").cast("array<bigint>").alias("chapters"))
    return titles.groupBy("disc_id").agg(F.array_sort(F.collect_list(each)).alias("titles")).mapInArrow(_decomposed, ROLES)


def feature(titles: DataFrame) -> DataFrame:
    """The longest title of each disc, the earliest of equals, is the feature; the others are extras."""
    best = titles.groupBy("disc_id").agg(F.max(F.struct("duration_ms", (-F.col("title_pos")).alias("p"), "key")).alias("b")).select("disc_id", F.col("b.key").alias("__key"))
    return titles.join(best, "disc_id").select("disc_id", "key", F.when(F.col("key") == F.col("__key"), "feature").otherwise("extra").alias("role"), "title_pos")


def episodes_by_duration(titles: DataFrame) -> DataFrame:
    """Where no play-all tells: the titles of a disc's house length, within two minutes of the commonest, in disc order."""
    inside = titles.filter(F.col("duration_ms").between(SHORTEST, LONGEST))
    return densest_cluster(inside, ["disc_id"], "duration_ms", "title_pos", 120_000).select("disc_id", "key", "title_pos")


def organise(titles: DataFrame) -> DataFrame:
    """decompose, and for discs without a play-all the episodes of the house length. Titles are written once, since both read them."""
    titles = kept(titles, "titles")
    found = decompose(titles).withColumn("__told", F.bool_or(F.col("role") == "play_all").over(Window.partitionBy("disc_id")))
    by_length = episodes_by_duration(titles).select("disc_id", "key", F.col("title_pos").alias("__at"))
    both = found.join(by_length, ["disc_id", "key"], "left").withColumn("__at", F.when(~F.col("__told"), F.col("__at")))
    return both.select("disc_id", "key", F.when(F.col("__at").isNotNull(), "episode").otherwise(F.col("role")).alias("role"), F.coalesce("__at", "out_pos").cast("int").alias("out_pos"))


def assign(structure: DataFrame, catalogue: DataFrame, season: int, offset: int = 0) -> DataFrame:
    """(disc_id, key, role, season, number, title) of structure (decompose's rows): episodes take their number's catalogue
    entry (number, name), or a plain name; loose titles and extras are extras; play-alls are listed."""
    numbered = structure.withColumn("number", F.when(F.col("role") == "episode", F.col("out_pos") + 1 + offset))
    names = catalogue.groupBy("number").agg(F.first("name").alias("name"))
    joined = numbered.join(names, "number", "left")
    role = F.when(F.col("role") == "episode", "Episode").when(F.col("role") == "play_all", "PlayAll").otherwise("Extra")
    title = F.when(F.col("role") == "episode", F.coalesce("name", F.concat(F.lit("Episode "), F.col("number").cast("string")))).when(F.col("role") == "play_all", F.col("key")).otherwise(F.regexp_replace("key", r"\.[^.]*$", ""))
    return joined.select("disc_id", "key", role.alias("role"), F.when(F.col("number").isNotNull(), F.lit(season)).alias("season"), "number", title.alias("title"))
