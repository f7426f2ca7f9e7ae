"""Operators on small fixtures with known answers."""

from __future__ import annotations

import random

from pyspark.sql import functions as F

from platterlens.functions import languages
from platterlens.operators import checksums, discs, identify, intervals, matching, sequences, structure, voting


def rows(df, *columns):
    return sorted(map(tuple, df.select(*columns).collect()), key=repr)


ROMS = "dat_pos int, game_pos int, game string, rom_pos int, name string, size bigint, crc32 bigint, sha1 string"


def test_digests(spark):
    roms = spark.createDataFrame([(0, 0, "g0", 0, "a", 10, 7, None), (0, 1, "g1", 0, "b", 10, 7, "AB"), (0, 2, "g2", 0, "c", 10, 9, "ab"), (0, 3, "g3", 0, "d", 11, 7, None)], ROMS)
    dumps = spark.createDataFrame([(1, 10, 7, "ab"), (2, 10, 7, "zz"), (3, 12, 7, "ab"), (4, 11, 8, "zz"), (5, None, None, None)], "dump_id int, bytes bigint, crc32 bigint, sha1 string")
    assert rows(matching.match_digests(dumps, roms), "dump_id", "game", "matched_by") == [(1, "g1", "sha1"), (2, "g0", "crc32"), (3, None, None), (4, None, None), (5, None, None)]


def test_wholes_and_parts(spark):
    left = spark.createDataFrame([(1, 0, "a"), (1, 1, "b"), (2, 0, "a"), (2, 1, "b"), (3, 0, "a"), (3, 1, "c"), (4, 0, "a"), (5, 0, "a"), (5, 1, "b")], "id int, pos int, part string")
    assert rows(matching.match_wholes(left, left), "id", "match_id") == [(1, 2), (2, 1), (3, None), (4, None), (5, 1)]
    found = rows(matching.match_partly(left, left), "id", "match_id", "matched", "n")
    assert found == [(1, 5, 2, 2), (2, 5, 2, 2), (3, 5, 1, 2), (5, 2, 2, 2)]


def test_preferences(spark):
    tags = spark.createDataFrame([("d", 0, "fre,"), ("d", 1, "en"), ("d", 2, "xx"), ("d", 3, "eng"), ("e", 5, "jpn"), ("e", 6, "kor")], "group string, tag_pos int, tag string")
    aliases = languages.aliases(spark)
    pick = lambda wanted, **k: rows(matching.by_preference(tags, aliases, wanted, **k), "group", "tag", "out_pos")
    assert pick(["eng", "fra"]) == [("d", "en", 1), ("d", "eng", 2), ("d", "fre,", 3), ("e", "jpn", 1)]
    assert pick(["eng"], fallback=False) == [("d", "en", 1), ("d", "eng", 2)]
    assert pick([]) == []
    assert len(pick(None)) == 6
    assert languages.parse_preference("") is None and languages.parse_preference("en, German;xx") == ["eng", "deu", "xx"]


def test_votes(spark):
    cases = {
        "a": ({"l": 232, "/": 16, "f": 15, "i": 10}, "l"), "b": ({"l": 113, "I": 18}, "l|I"), "c": ({"é": 5, "e": 3}, "é|e"), "d": ({"Ä": 4, "Å": 2}, "Ä|Å"), "e": ({"e": 90, "é": 10}, "e"),
        "f": ({"c": 5, "o": 3}, None), "g": ({"i": 424, "I": 8}, "i"), "h": ({"l": 190, "I": 10}, "l|I"), "i": ({"I": 28, "i": 19, "f": 8, "!": 4}, "I|i"),
    }
    votes = spark.createDataFrame([(k, label, n) for k, (v, _) in cases.items() for label, n in v.items()], "key string, label string, n bigint")
    assert dict(map(tuple, voting.settle(votes).select("key", "text").collect())) == {k: want for k, (_, want) in cases.items()}
    trusted = voting.settle(votes, agreement=0.9, covered=0.97, least_second=10, second_share=0.08, collisions=False)
    assert dict(map(tuple, trusted.select("key", "text").collect()))["h"] == "l"


def test_intervals(spark):
    ranges = spark.createDataFrame([(1, 0, 100), (1, 50, 150), (2, 0, 100), (2, 100, 200), (3, 0, 100), (3, 200, 300), (4, 50, 50)], "k int, start bigint, end bigint")
    assert rows(intervals.union(ranges, ["k"]), "k", "start", "end") == [(1, 0, 150), (2, 0, 200), (3, 0, 100), (3, 200, 300)]
    draw = random.Random(3)
    writes = [("m", 0, 0, 100, "NonTried")] + [("m", i, a := draw.randrange(100), min(100, a + draw.randrange(1, 40)), draw.choice(["Bad", "Finished"])) for i in range(1, 12)]
    state = {}
    for _, _, a, b, s in writes:
        state |= dict.fromkeys(range(a, b), s)
    found = intervals.overwrite(spark.createDataFrame(writes, "map_id string, seq int, start bigint, end bigint, state string"), ["map_id"])
    told = rows(found, "start", "end", "state")
    assert {x: s for a, b, s in told for x in range(a, b)} == state
    ordered = sorted(told)
    assert all(x[1] < y[0] or x[2] != y[2] for x, y in zip(ordered, ordered[1:]))
    sums = intervals.summary(found, ["map_id"], ["Bad"]).first()
    assert (sums["total"], sums["Bad"]) == (100, sum(s == "Bad" for s in state.values()))
    sectors = spark.createDataFrame([("m", i, not 300 <= i < 340, None) for i in range(1024)], "map_id string, lba bigint, readable boolean, readable_at int")
    assert rows(intervals.rescue(sectors, ["map_id"]), "start", "end", "state") == [(0, 300, "Finished"), (300, 340, "Bad"), (340, 1024, "Finished")]
    specs = spark.createDataFrame([("2-4,9",), ("4-2",), ("x",)], "s string")
    assert [r["numbers"] for r in intervals.chain_numbers(specs, F.col("s")).collect()] == [[2, 3, 4, 9], None, None]


ROOTS = [0, 15443, 33892, 50750, 65846, 85908, 107101, 127207, 138996, 153615, 170139, 195211]


def test_disc_ids(spark):
    tracks = spark.createDataFrame([("roots", i + 1, s, False, 225301) for i, s in enumerate(ROOTS)], "disc_id string, number int, start bigint, is_data boolean, leadout bigint")
    toc = discs.contents(tracks, ["disc_id"])
    found = toc.select(discs.musicbrainz_id(F.col("toc"), F.col("leadout")).alias("m"), discs.freedb_id(F.col("toc"), F.col("leadout")).alias("f")).first()
    assert tuple(found) == ("sgDgBzHLi5stPYlOC7Jc6FPWdM8-", "a20bbc0c")
    lengths = dict(map(tuple, discs.track_durations(tracks, ["disc_id"]).select("number", "duration_ms").collect()))
    assert (lengths[8], lengths[12]) == (157186, 401200)


def test_layout(spark):
    starts = [0, 63873, 82833, 93589]
    tracks = spark.createDataFrame([("moto", i + 1, s, i == 0, {1: 225}.get(i, 150 if i else None), 107639) for i, s in enumerate(starts)], "disc_id string, number int, start bigint, is_data boolean, pregap int, leadout bigint")
    sizes = [r["bytes"] for r in sequences.layout(tracks, ["disc_id"]).orderBy("number").collect()]
    assert sizes[:3] == [149700096, 44770320, 25298112]
    assert discs.kind(tracks, ["disc_id"]).first()["kind"] == "enhanced"


def titles(spark, discs_):
    return spark.createDataFrame([(d, k, p, ms, ch) for d, ts in discs_.items() for k, p, ms, ch in ts], "disc_id string, key string, title_pos int, duration_ms bigint, chapters array<bigint>")


def test_structure(spark):
    one, two = [300000, 500000, 475000], [300000, 975000]
    found = structure.decompose(titles(spark, {
        "simple": [("play", 0, 2550000, one + one), ("ep1", 1, 1275000, one), ("ep2", 2, 1275000, one), ("extra", 3, 180000, [180000])],
        "sliver": [("t04", 4, 2980000, [275780, 821320, 754780, 733040, 135460, 310510, 464500, 383640, 1130]), ("t05", 5, 2586050, [275780, 821320, 754780, 733040, 1130]), ("t06", 6, 1295240, [135460, 310510, 464500, 383640, 1130])],
        "rounding": [("play", 0, 2550010, [300050, 974960, 300000, 975000]), ("a", 1, 1275000, two), ("b", 2, 1275000, two)],
        "leftover": [("play", 0, 2661111, two + two + [111111]), ("a", 1, 1275000, two), ("b", 2, 1275000, two)],
    }))
    of = lambda d, role: [k for k, _ in sorted(((r["key"], r["out_pos"]) for r in found.collect() if (r["disc_id"], r["role"]) == (d, role)), key=lambda x: x[1])]
    assert (of("simple", "play_all"), of("simple", "episode"), of("simple", "extra")) == (["play"], ["ep1", "ep2"], ["extra"])
    assert (of("sliver", "play_all"), of("sliver", "episode"), of("sliver", "extra")) == (["t04"], ["t05", "t06"], [])
    assert of("rounding", "episode") == ["a", "b"]
    assert of("leftover", "play_all") == []
    house = titles(spark, {"d": [("a", 0, 1275000, []), ("b", 1, 1290000, []), ("c", 2, 1260000, []), ("bonus", 3, 2400000, [])]})
    assert [r["key"] for r in structure.episodes_by_duration(house).orderBy("title_pos").collect()] == ["a", "b", "c"]
    assert rows(structure.organise(house).filter("role = 'episode'"), "key") == [("a",), ("b",), ("c",)]
    tie = titles(spark, {"d": [("b", 1, 5085000, []), ("a", 0, 5085000, []), ("c", 2, 254000, [])]})
    assert rows(structure.feature(tie).filter("role = 'feature'"), "key") == [("a",)]
    catalogue = spark.createDataFrame([(3, "Third")], "number int, name string")
    named = structure.assign(found.filter("disc_id = 'simple'"), catalogue, season=7, offset=2)
    assert rows(named.filter("role = 'Episode'"), "number", "title") == [(3, "Third"), (4, "Episode 4")]


def test_candidates(spark):
    found = spark.createDataFrame([("tv", "HARBOUR_AND_LANTERN_S7D1", [1275000] * 4), ("film", "WOOL_OX_MARKET", [5400000, 300000, 200000])], "disc_id string, label string, durations array<bigint>")
    hits = spark.createDataFrame([("Harbour and Lantern", 0, "series", 2009, 1.0, "w1"), ("Wool Ox Market", 0, "series", 2011, 0.95, "w2"), ("Wool Ox Market", 1, "movie", 2008, 0.9, "w3")], "title string, hit_pos int, media string, year int, score double, work_id string")
    episodes = spark.createDataFrame([("w1", 7, n, 1320000) for n in range(1, 14)], "work_id string, season int, number int, runtime_ms bigint")
    ranked = identify.candidates(found, hits, episodes)
    assert rows(ranked, "disc_id", "rank", "work_id", "confidence") == [("film", 1, "w3", 0.84), ("film", 2, "w2", 0.37), ("tv", 1, "w1", 1.0)]


def sector(mode):
    if mode == 1:
        raw = bytearray(checksums.SYNC + bytes([0, 2, 0, 1]) + bytes((i * 7 + 3) & 255 for i in range(2048)) + bytes(288))
        raw[2064:2068] = (0x68EEF435).to_bytes(4, "little")
    else:
        raw = bytearray(checksums.SYNC + bytes([0, 2, 16, 2, 0, 0, 8, 0, 0, 0, 8, 0]) + bytes((i * 5 + 11) & 255 for i in range(2048)) + bytes(280))
        raw[2072:2076] = (0x1410C3FB).to_bytes(4, "little")
    return bytes(raw)


def test_sectors_and_keys(spark):
    bad = bytearray(sector(1))
    bad[500] ^= 1
    df = spark.createDataFrame([(1, 0, sector(1)), (1, 10, sector(2)), (1, 2, bytes(bad)), (1, 3, b"short"), (1, 4, None)], "track int, sector_pos bigint, raw binary")
    checked = checksums.check_sectors(df.withColumn("address", checksums.sector_address(F.col("raw"))))
    assert [r["verdict"] for r in checked.orderBy("sector_pos").collect()] == ["Sound", "Corrupt", "Corrupt", "Corrupt", "Sound"]
    totals = checksums.track_verdicts(checked).first()
    assert (totals["sectors"], totals["sound"], totals["corrupt"], totals["misplaced"]) == (5, 2, 3, 1)
    keyed = checksums.picture_keys(spark.createDataFrame([(2, 2, b"\1\2\2\1"), (2, 2, None)], "w int, h int, bits binary"))
    assert {r["key"] for r in keyed.collect()} == {f"{checksums.fnv1a(bytes([2, 0, 2, 0, 1, 2, 2, 1])):016x}", None}
    told = checksums.digests(spark.createDataFrame([(b"abc",)], "content binary")).first()
    assert (told["crc32"], told["sha1"]) == (0x352441C2, "a9993e364706816aba3e25717850c26c9cd0d89d")


def test_frames(spark):
    a = [("a", i, i * 1000003, i * 7919) for i in range(100)]
    b = [("b", *x[1:]) for x in a] + [("b", 1000 + i, (i + 5000) * 982451653, -i * 32452843 - 999) for i in range(100)]
    found = matching.similar_frames(spark.createDataFrame(a + b, "title string, frame_pos bigint, hi bigint, lo bigint"))
    share = {(r["a"], r["b"]): r["hits"] / r["n"] for r in found.collect()}
    assert share["a", "b"] > 0.99 and share["b", "a"] < 0.6


def test_consensus(spark):
    readings = spark.createDataFrame([("x", 1, "a", 0), ("x", 2, "b", 0), ("y", 1, "a", 3), ("y", 2, "b", 1), ("y", 3, "b", 1), ("z", 1, "a", 1), ("z", 2, "b", 1), ("z", 3, "c", 1)], "span string, attempt int, digest string, flagged int")
    assert rows(sequences.consensus(readings, ["span"]), "span", "digest", "agreed") == [("x", "a", True), ("y", "b", True), ("z", "c", False)]


def test_quantiles_hold_where_cuts_are_never_twice_the_same(spark, monkeypatch):
    # summaries of tasks meet in any order, so what percentile_approx says may differ from one reading of the plan to the next
    @F.udf("array<double>")
    def cuts(most):
        return sorted(random.uniform(0, most) for _ in range(63))

    monkeypatch.setattr(voting.F, "percentile_approx", lambda value, *_: cuts.asNondeterministic()(F.max(value)))
    df = spark.range(8000).select((F.col("id") % 20).alias("g"), (F.col("id") * 7919 % 8000).cast("double").alias("v"))
    found = {r["g"]: (r["v"], r["n"]) for r in voting.index_quantile(df, ["g"], "v", 3, 4).collect()}
    told = {}
    for i in range(8000):
        told.setdefault(i % 20, []).append(float(i * 7919 % 8000))
    assert found == {g: (sorted(v)[300], 400) for g, v in told.items()}
