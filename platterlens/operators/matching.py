"""Joins by meaning: digests against a reference set, ordered parts, aliases by preference, as-of and nearest lookups.

Each returns a DataFrame and leaves the physical join to Catalyst and adaptive execution; nothing is broadcast here unless
Spark has measured it, but for the few crowded buckets of frames. Ties are always settled by a position column.
"""

from __future__ import annotations

import itertools
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .intervals import cell_of, divided
from .voting import joined_by


def match_digests(dumps: DataFrame, roms: DataFrame) -> DataFrame:
    """dumps (dump_id, bytes, crc32, sha1) with the rom each is, or nulls.

    Sizes must agree. A rom with a SHA-1 is decided by it; one without by its CRC-32, and only where no SHA-1 agrees
    anywhere. The first in (dat_pos, game_pos, rom_pos) counts. Both lookups are equi-joins on (size, digest).
    """
    order = F.struct("dat_pos", "game_pos", "rom_pos", "game", "name").alias("rom")
    by_sha1 = roms.filter("sha1 is not null").groupBy("size", F.lower("sha1").alias("digest")).agg(F.min(order).alias("first"))
    by_crc = roms.filter("sha1 is null and crc32 is not null").groupBy("size", "crc32").agg(F.min(order).alias("spare"))
    found = dumps.join(by_sha1, (dumps.bytes == by_sha1["size"]) & (F.lower(dumps.sha1) == by_sha1.digest), "left").drop("size", "digest")
    found = found.join(by_crc.withColumnRenamed("crc32", "rom_crc32"), (F.col("bytes") == F.col("size")) & (F.col("crc32") == F.col("rom_crc32")), "left")
    best = F.coalesce("first", "spare")
    how = F.when(F.col("first").isNotNull(), "sha1").when(F.col("spare").isNotNull(), "crc32")
    return found.select(*dumps.columns, best["game"].alias("game"), best["name"].alias("rom"), how.alias("matched_by"))


def match_wholes(left: DataFrame, right: DataFrame) -> DataFrame:
    """(id, match_id): for each id of left (id, pos, part) the smallest other id of right (id, pos, part) whose parts are
    the same, in the same order. A whole is folded to one digest of its ordered parts, so no pairs of parts are made."""

    def folded(parts: DataFrame) -> DataFrame:
        return parts.groupBy("id").agg(F.sha1(F.to_json(F.array_sort(F.collect_list(F.struct("pos", "part")))).cast("binary")).alias("whole"))

    # the two smallest ids of equal wholes are all that an answer needs, however many there are
    known = folded(right)
    least = known.groupBy("whole").agg(F.min("id").alias("least"))
    second = known.join(least, "whole").filter("id > least").groupBy("whole").agg(F.min("id").alias("second"))
    found = folded(left).join(least, "whole", "left").join(second, "whole", "left")
    return found.select("id", F.when(F.col("least") != F.col("id"), F.col("least")).otherwise(F.col("second")).alias("match_id"))


def match_partly(left: DataFrame, right: DataFrame) -> DataFrame:
    """(id, match_id, matched, n): for each id of left (id, pos, part) the other id of right with as many parts of which
    most are the same; the LAST of equals. Only parts that agree in (number of parts, position, content) meet, and wholes
    of right that are the same throughout are one, known by its two largest ids."""

    def counted(parts: DataFrame) -> DataFrame:
        return parts.join(parts.groupBy("id").agg(F.count("*").alias("n")), "id")

    wholes = right.groupBy("id").agg(F.sha1(F.to_json(F.array_sort(F.collect_list(F.struct("pos", "part")))).cast("binary")).alias("whole"))
    last = wholes.groupBy("whole").agg(F.max("id").alias("last"))
    before = wholes.join(last, "whole").filter("id < last").groupBy("whole").agg(F.max("id").alias("before"))
    stands = last.join(before, "whole", "left").select(F.col("last").alias("id"), "last", "before")
    a = counted(left)
    b = counted(right.join(stands, "id")).select("last", "before", "n", "pos", "part")
    met = a.join(b, ["n", "pos", "part"])
    scored = met.groupBy("id", "n", "last", "before").agg(F.count("*").alias("matched"))
    other = F.when(F.col("last") != F.col("id"), F.col("last")).otherwise(F.col("before"))
    best = scored.withColumn("match_id", other).filter("match_id is not null").groupBy("id", "n").agg(F.max(F.struct("matched", "match_id")).alias("best"))
    return best.select("id", "best.match_id", "best.matched", "n")


def over_datfiles(dumps: DataFrame, entries: DataFrame) -> DataFrame:
    """Whole dumps against several datfiles: dumps (id, pos, part), entries (dat_pos, game_pos, game, pos, part).

    whole_dat and whole_game: the first datfile that has all parts in order, and its first entry. near_game, matched, n and
    differing (places from 1): the entry of as many parts of which most agree, the last datfile and entry of equals. An
    entry numbered as the dump itself is not compared with it.
    """
    whole = lambda parts, keys: parts.groupBy(*keys).agg(F.sha1(F.to_json(F.array_sort(F.collect_list(F.struct("pos", "part")))).cast("binary")).alias("whole"), F.count("*").alias("n"))
    asked = whole(dumps, ["id"])
    # equal entries are known by their first two and last two, which is all an answer needs
    place = F.struct("dat_pos", "game_pos", "game")
    known = whole(entries, ["dat_pos", "game_pos", "game"]).groupBy("whole", "n").agg(F.slice(F.array_sort(F.collect_set(place)), 1, 2).alias("first"), F.slice(F.sort_array(F.collect_set(place), asc=False), 1, 2).alias("last"))
    other = lambda found: F.get(F.filter(found, lambda e: e.game_pos != F.col("id")), F.lit(0))
    hits = asked.join(known.select("whole", "first"), "whole", "left").select("id", other(F.col("first")).alias("hit"))
    parts = entries.join(known.select("whole", "n", "last").withColumn("stand", F.col("last")[0]["game_pos"]), F.col("game_pos") == F.col("stand")).select("whole", "n", "last", "pos", "part")
    met = dumps.join(asked.select("id", "n"), "id").join(parts, ["n", "pos", "part"])
    scored = met.groupBy("id", "n", "whole", "last").agg(F.count("*").alias("matched"), F.collect_set("pos").alias("same"))
    ranked = scored.withColumn("entry", other(F.col("last"))).filter("entry is not null").groupBy("id", "n").agg(F.max(F.struct("matched", "entry", "same")).alias("b"))
    all_parts = dumps.groupBy("id").agg(F.array_sort(F.collect_set("pos")).alias("all"))
    near = ranked.join(all_parts, "id").select("id", F.col("b.entry.game").alias("near_game"), F.col("b.matched").alias("matched"), "n", F.transform(F.array_except("all", "b.same"), lambda p: p + 1).alias("differing"))
    return hits.join(near, "id", "left").select("id", F.col("hit.dat_pos").alias("whole_dat"), F.col("hit.game").alias("whole_game"), "near_game", "matched", "n", "differing")


def preselect(tags: DataFrame, aliases: DataFrame, wanted: list[str]) -> DataFrame:
    """All tags (group, tag_pos, tag) as they are offered: preferred ones first, in the order of preference and ticked, the
    others after them in their own."""
    ticked = by_preference(tags, aliases, wanted, fallback=False).select("group", "tag", F.col("out_pos").alias("__place"))
    joined = tags.join(ticked, ["group", "tag"], "left")
    order = Window.partitionBy("group").orderBy(F.col("__place").asc_nulls_last(), "tag_pos")
    return joined.withColumns({"out_pos": F.row_number().over(order), "ticked": F.col("__place").isNotNull()}).drop("__place")


def by_preference(tags: DataFrame, aliases: DataFrame, wanted: list[str] | None, fallback: bool = True) -> DataFrame:
    """Of tags (group, tag_pos, tag) those that a preference list selects, with out_pos, their place in it.

    wanted None is no preference and keeps all; an empty list keeps none. A tag is read through aliases (alias, code). If
    a group has no tag of the list, its first tag alone is kept (fallback).
    """
    if wanted is None:
        return tags.withColumn("out_pos", F.row_number().over(Window.partitionBy("group").orderBy("tag_pos")))
    place = F.array_position(F.array(*map(F.lit, wanted)).cast("array<string>"), F.col("code"))
    clean = F.lower(F.regexp_replace(F.trim("tag"), ",+$", ""))
    coded = tags.withColumn("__clean", clean).join(aliases.withColumnRenamed("alias", "__clean"), "__clean", "left").withColumn("code", F.coalesce("code", "__clean"))
    ranked = coded.withColumn("__place", F.when(place > 0, place)).withColumns(
        {"__any": F.max("__place").over(Window.partitionBy("group")), "__first": F.min("tag_pos").over(Window.partitionBy("group"))}
    )
    kept = F.col("__place").isNotNull()
    if fallback and wanted:
        kept = kept | (F.col("__any").isNull() & (F.col("tag_pos") == F.col("__first")))
    order = Window.partitionBy("group").orderBy(F.col("__place").asc_nulls_last(), "tag_pos")
    return ranked.filter(kept).withColumn("out_pos", F.row_number().over(order)).select(*tags.columns, "out_pos")


def first_answering(hits: DataFrame) -> DataFrame:
    """Of hits (question, source_rank, ...) those of the first source that has any for the question."""
    return hits.join(hits.groupBy("question").agg(F.min("source_rank").alias("source_rank")), ["question", "source_rank"], "left_semi").select(*hits.columns)


def missing(wanted: DataFrame, present: DataFrame, key) -> DataFrame:
    """Rows of wanted (name) with no row of present (name) under the same normalised key."""
    return wanted.withColumn("__key", key(F.col("name"))).join(present.select(key(F.col("name")).alias("__key")), "__key", "left_anti").drop("__key")


def as_of(probes: DataFrame, spans: DataFrame, by: list[str]) -> DataFrame:
    """probes (by, at, ...), at a whole number, with number: of spans (by, start, number) the last that starts at or before `at`
    (of equals the largest number), else the first. One sweep of both together, cell by cell of each group's axis; a cell is told
    the last span of the cells before it, so neither a group with many rows nor one with many spans is a single task's."""
    asked = probes.select(*by, F.col("at").cast("long").alias("__at"), F.lit(1).alias("__probe"), F.lit(None).cast("long").alias("__number"), F.struct(*probes.columns).alias("__row"))
    marks = spans.select(*by, F.col("start").cast("long").alias("__at"), F.lit(0).alias("__probe"), F.col("number").cast("long").alias("__number"), F.lit(None).cast(asked.schema["__row"].dataType).alias("__row"))
    mark = F.when(F.col("__probe") == 0, F.struct(F.col("__at").alias("at"), F.col("__number").alias("number")))
    placed = divided(asked.unionByName(marks), by, "__at", "__at").withColumns({"__cell": cell_of(F.col("__at")), "__mark": mark})
    cells = placed.groupBy(*by, "__cell").agg(F.max("__mark").alias("__last"), F.min("__mark").alias("__first"))
    order = Window.partitionBy(*by).orderBy("__cell")
    told = cells.select(*by, "__cell", F.max("__last").over(order.rowsBetween(Window.unboundedPreceding, -1)).alias("__before"), F.min("__first").over(Window.partitionBy(*by)).alias("__least"))
    within = Window.partitionBy(*by, "__cell").orderBy("__at", "__probe").rowsBetween(Window.unboundedPreceding, 0)
    met = joined_by(placed, told, [*by, "__cell"]).withColumn("__now", F.max("__mark").over(within))
    return met.filter("__probe = 1").select("__row.*", F.coalesce(F.col("__now.number"), F.col("__before.number"), F.col("__least.number")).alias("number"))


def nearest(probes: DataFrame, events: DataFrame, by: list[str]) -> DataFrame:
    """probes (by, at) with the event_id of events (by, at, event_id) nearest in time, the earliest of equals (then the
    smallest id): the last before and the first after are found by one sort, and the nearer taken."""
    a = probes.select(*by, "at", F.lit(1).alias("__probe"), F.lit(None).cast("long").alias("event_id"))
    b = events.select(*by, "at", F.lit(0).alias("__probe"), "event_id")
    first_at = Window.partitionBy(*by, "at", "__probe")
    both = a.unionByName(b).withColumn("__least", F.min("event_id").over(first_at))
    mark = F.when(F.col("__probe") == 0, F.struct(F.col("at").alias("at"), F.col("__least").alias("event_id")))
    before = Window.partitionBy(*by).orderBy("at", "__probe").rowsBetween(Window.unboundedPreceding, 0)
    after = Window.partitionBy(*by).orderBy("at", F.col("__probe").desc()).rowsBetween(0, Window.unboundedFollowing)
    both = both.withColumns({"__before": F.last(mark, True).over(before), "__after": F.first(mark, True).over(after)})
    gap = lambda x: F.abs(F.col("at") - F.col(f"{x}.at"))
    pick = F.when(F.col("__before").isNull() | (gap("__after") < gap("__before")), F.col("__after")).otherwise(F.col("__before"))
    return both.filter("__probe = 1").select(*by, "at", pick["event_id"].alias("event_id"), F.abs(F.col("at") - pick["at"]).alias("distance"))


#: Rows of a bucket that are compared as pairs at once, rows that a task holds of one bucket, and cells of a table of distances.
SMALL, TILE, CELLS = 48, 1 << 15, 1 << 20


def _shown_nearby(tolerance: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Over rows sorted by bucket (bands, value, i, j): which titles (bits of a word) have a pattern within `tolerance` of each
    asked one. In small buckets all pairs are compared; in large ones a pattern looks for a title only until it has found it."""

    def near(hi, lo, x, y):
        return np.bitwise_count(hi[x] ^ hi[y]) + np.bitwise_count(lo[x] ^ lo[y]) <= tolerance

    def small(c, starts, sizes):
        rows = np.repeat(starts - np.cumsum(sizes) + sizes, sizes) + np.arange(sizes.sum())
        size, first = np.repeat(sizes, sizes), np.repeat(starts, sizes)
        per = max(1, CELLS // SMALL)
        for at in range(0, len(rows), per):
            x, n, head = rows[at : at + per], size[at : at + per], first[at : at + per]
            ends = np.cumsum(n)
            y = np.arange(ends[-1]) + np.repeat(head - ends + n, n)
            ok = near(c["hi"], c["lo"], np.repeat(x, n), y) & (c["role"][y] != 1)
            for word in np.unique(c["word"][y]):
                yield x, word, np.bitwise_or.reduceat(np.where(ok & (c["word"][y] == word), c["bits"][y], 0), ends - n)

    def large(c, start, size):
        rows = np.arange(start, start + size)
        asked, told = rows[c["role"][rows] != 2], rows[c["role"][rows] != 1]
        for word in np.unique(c["word"][told]):
            of = told[c["word"][told] == word]
            found = np.zeros(size, np.int64)
            for bit in range(64):
                one = np.uint64(1) << np.uint64(bit)
                has = lambda r: (c["bits"][r].view(np.uint64) & one) != 0  # noqa: B023, E731
                y = of[has(of)]
                left = asked[~((c["word"][asked] == word) & has(asked))] if len(y) else asked[:0]
                at, step = 0, 1
                while at < len(y) and len(left):
                    step = max(1, min(step * 2, CELLS // len(left)))
                    ok = near(c["hi"], c["lo"], left[:, None], y[None, at : at + step]).any(axis=1)
                    found[left[ok] - start] |= one.view(np.int64)
                    left, at = left[~ok], at + step
            yield rows, word, found

    def settle(c):
        new = np.flatnonzero(np.concatenate([[True], np.any([c[k][1:] != c[k][:-1] for k in ("bands", "value", "i", "j")], axis=0)]))
        sizes = np.diff(np.append(new, len(c["hi"])))
        # a bucket of one title holds nothing that is not known
        every = np.bitwise_or.reduceat(c["bits"], new).view(np.uint64)
        alone = (np.bitwise_count(every) == 1) & (np.minimum.reduceat(c["word"], new) == np.maximum.reduceat(c["word"], new))
        few = (sizes <= SMALL) & ~alone
        if few.any():
            yield from small(c, new[few], sizes[few])
        for k in np.flatnonzero((sizes > SMALL) & ~alone):
            yield from large(c, new[k], sizes[k])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None
        for batch in itertools.chain(batches, [None]):
            if batch is not None and not batch.num_rows:
                continue
            now = None if batch is None else {k: batch.column(k).to_numpy(zero_copy_only=False) for k in batch.schema.names}
            c = now if held is None else held if now is None else {k: np.concatenate([held[k], now[k]]) for k in now}
            if c is None:
                return
            n = len(c["hi"])
            if now is not None:  # the last bucket may go on
                last = np.any([c[k] != c[k][-1] for k in ("bands", "value", "i", "j")], axis=0)
                n = int(np.flatnonzero(last)[-1]) + 1 if last.any() else 0
                held = {k: v[n:].copy() for k, v in c.items()}
            if n:
                for x, word, bits in settle({k: v[:n] for k, v in c.items()}):
                    x, bits = x[bits != 0], bits[bits != 0]
                    yield pa.record_batch({"hi": c["hi"][x], "lo": c["lo"][x], "word": np.full(len(x), word, np.int32), "bits": bits})

    return work


def similar_frames(frames: DataFrame, tolerance: int = 8) -> DataFrame:
    """(a, b, hits, n): for each pair of titles of frames (title, frame_pos, hi, lo) that have any, how many of the n
    frames of a are within `tolerance` bits of a frame of b.

    Two words of 128 bits that differ in up to `tolerance` bits agree wholly in two of tolerance + 2 bands. Patterns, each once
    however many frames show it, meet in the buckets of two bands together, some 25 bits. No pairs are kept: a pattern needs to
    know the titles that are near, bits of a word, and looks no further for a title that it has found. A bucket with about more
    than TILE patterns, as a hash of the patterns estimates it, is cut into tiles that meet each other, so no task holds it whole.
    """
    half = -(-(tolerance + 2) // 2)
    cuts = [64 * i // half for i in range(half + 1)]
    bands = [(F.shiftrightunsigned(F.col(side), lo).bitwiseAND(F.lit((1 << (hi - lo)) - 1).cast("long")), hi - lo) for side in ("hi", "lo") for lo, hi in zip(cuts, cuts[1:])]
    pairs = [F.shiftleft(x, width).bitwiseOR(y) for i, (x, _) in enumerate(bands) for y, width in bands[i + 1 :]]
    numbers = frames.select("title").distinct().withColumn("number", (F.row_number().over(Window.orderBy("title")) - 1).cast("int"))
    told = frames.join(numbers, "title").select("hi", "lo", F.shiftright("number", 6).alias("word"), F.call_function("shiftleft", F.lit(1).cast("long"), F.col("number") % 64).alias("bits"))
    shown = told.groupBy("hi", "lo", "word").agg(F.bit_or("bits").alias("bits"))
    keyed = shown.select("hi", "lo", "word", "bits", F.posexplode(F.array(*pairs)).alias("bands", "value"))
    # only how a bucket is cut follows from a part of the patterns; every row is in
    counted = shown.filter(F.pmod(F.xxhash64("hi", "lo"), F.lit(16)) == 0).select(F.posexplode(F.array(*pairs)).alias("bands", "value")).groupBy("bands", "value").count()
    crowded = counted.filter(F.col("count") > TILE // 16).select("bands", "value", F.ceil(F.col("count") * 16 / TILE).cast("int").alias("tiles"))
    placed = keyed.join(F.broadcast(crowded), ["bands", "value"], "left").withColumn("own", F.pmod(F.hash("lo", "hi"), F.col("tiles")))
    tile = lambda role, i, j: F.struct(F.lit(role).alias("role"), i.cast("int").alias("i"), j.cast("int").alias("j"))
    each = F.sequence(F.lit(0), F.col("tiles") - 1)
    met = F.concat(F.transform(each, lambda k: tile(1, F.col("own"), k)), F.transform(each, lambda k: tile(2, k, F.col("own"))))
    tiles = F.explode(F.when(F.col("tiles").isNull(), F.array(tile(0, F.lit(0), F.lit(0)))).otherwise(met)).alias("t")
    spread = placed.select("bands", "value", "hi", "lo", "word", "bits", tiles).select("bands", "value", "t.i", "t.j", "t.role", "hi", "lo", "word", "bits")
    parts = int(frames.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    sorted_ = spread.repartition(parts, "bands", "value", "i", "j").sortWithinPartitions("bands", "value", "i", "j")
    near = sorted_.mapInArrow(_shown_nearby(tolerance), "hi bigint, lo bigint, word int, bits bigint").unionByName(shown).groupBy("hi", "lo", "word").agg(F.bit_or("bits").alias("bits"))
    # one row for each frame, however often it is listed
    hit = frames.select("title", "frame_pos", "hi", "lo").join(near.hint("merge"), ["hi", "lo"]).groupBy("title", "frame_pos", "word").agg(F.bit_or("bits").alias("bits"))
    bits = F.filter(F.sequence(F.lit(0), F.lit(63)), lambda k: F.call_function("getbit", F.col("bits"), k) == 1)
    counts = hit.groupBy("title", "word", "bits").agg(F.count("*").alias("c")).select("title", F.explode(bits).alias("bit"), "word", "c").groupBy("title", (F.col("word") * 64 + F.col("bit")).alias("number")).agg(F.sum("c").alias("hits"))
    n = frames.groupBy(F.col("title").alias("a")).agg(F.count("*").alias("n"))
    named = counts.withColumnRenamed("title", "a").join(numbers.withColumnRenamed("title", "b"), "number")
    return named.filter("a <> b").join(n, "a").select("a", "b", "hits", "n")


def extended_cuts(frames: DataFrame, loose: DataFrame, episodes: DataFrame, least: float = 0.15) -> DataFrame:
    """(key, episode, share): for each of loose (key) the one of episodes (key, episode_pos) most of whose frames it has,
    the FIRST of equals, if that is `least` of them or more. frames as in similar_frames."""
    found = similar_frames(frames).withColumn("share", F.col("hits") / F.col("n"))
    met = found.join(episodes.select(F.col("key").alias("a"), "episode_pos"), "a").join(loose.select(F.col("key").alias("b")), "b")
    best = met.groupBy("b").agg(F.max(F.struct("share", (-F.col("episode_pos")).alias("p"), "a")).alias("x"))
    return best.filter(F.col("x.share") >= least).select(F.col("b").alias("key"), F.col("x.a").alias("episode"), F.col("x.share").alias("share"))


def dangling(references: DataFrame, ids: DataFrame) -> DataFrame:
    """Of references (owner, ref_pos, id) those (owner, ref_pos) none of whose ids is among ids (owner, id)."""
    there = references.join(ids, ["owner", "id"], "left_semi").select("owner", "ref_pos").distinct()
    return references.select("owner", "ref_pos").distinct().join(there, ["owner", "ref_pos"], "left_anti")
