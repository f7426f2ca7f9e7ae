from __future__ import annotations

import pyarrow as pa
from pyspark.sql import functions as F

from platterlens.functions import naming, predicates
from platterlens.operators import matching, music, recognition, voting

GLYPHS = "stream_id int, event_id int, line_no int, glyph_pos int, x int, w int, h int, key string"


def drawn(spark, texts, wide=9, narrow=2):
    """Each letter of a text as a shape of its own, eight columns wide, `f` with a tail that takes two columns away."""
    rows = []
    for event, text in enumerate(texts):
        for no, line in enumerate(text.split("\n")):
            x = pos = 0
            for at, c in enumerate(line):
                if c == " ":
                    continue
                if pos:
                    x += (wide if line[at - 1] == " " else narrow) - (2 if rows[-1][-1] == "k-f" else 0)
                rows.append((1, event, no, pos, x, 8, 20, f"k-{c}"))
                x += 8
                pos += 1
    return spark.createDataFrame(rows, GLYPHS)


TEXTS = ["if you go\nnow or then", "off we go", "a tale of two"] * 8


def test_lettering_is_learned_and_read(spark):
    glyphs = drawn(spark, TEXTS)
    known = spark.createDataFrame([(1, i, t) for i, t in enumerate(TEXTS[:12])] + [(1, 12, "too short")], "stream_id int, event_id int, text string")
    votes = recognition.votes_from(glyphs, known)
    assert votes.count() == sum(len(t.replace(" ", "").replace("\n", "")) for t in TEXTS[:12])
    assert votes.filter(F.concat(F.lit("k-"), "label") != F.col("key")).count() == 0
    labels = voting.settle(votes.select("key", "label", F.lit(1).alias("n"))).select("key", "text")
    own = recognition.learned_gaps(votes)
    spaces = recognition.space_gap(glyphs, 4)
    assert 2 < spaces.first()["space_gap"] <= 9
    lines = recognition.read_lines(glyphs, labels.join(own, "key", "left"), spaces)
    cues = recognition.cue_texts(lines)
    assert [r["text"] for r in cues.orderBy("event_id").collect()] == TEXTS
    assert cues.agg(F.sum("n_unknown")).first()[0] == 0
    fewer = recognition.read_lines(glyphs, labels.filter("key <> 'k-y'").withColumn("gap", F.lit(None).cast("long")), spaces)
    assert fewer.filter("event_id = 0 and line_no = 0").first()["n_unknown"] == 1
    few = recognition.space_gap(drawn(spark, ["ab"]), 7)
    assert few.first()["space_gap"] == 7


def test_tables_and_verification(spark):
    shapes = spark.createDataFrame([("en", "a", 500), ("en", "b", 500), ("en", "c", 2), ("sv", "a", 9)], "language string, key string, n bigint")
    tables = spark.createDataFrame([(0, "c", "c", 0), (1, "a", "a", 0), (1, "b", None, 24), (2, "a", "a", 0), (2, "b", "b", 0)], "table_pos int, key string, text string, votes int")
    best = recognition.closest_table(shapes, tables).first()
    assert best["table_pos"] == 1 and best["fits"] and round(best["worst"], 4) == 0.998
    produced = spark.createDataFrame([(1, 0, 100, "cat"), (1, 1, 200, "dog!"), (1, 2, 300, "x")], "stream_id int, seq int, start_ms bigint, text string")
    reference = spark.createDataFrame([(1, 0, 100, "dog"), (1, 1, 100, "cat"), (1, 2, 200, "dig")], "stream_id int, seq int, start_ms bigint, text string")
    assert tuple(recognition.verify(produced, reference).first())[1:] == (3, 2, 1, 1, 7, 2)


def test_cuts_and_references(spark):
    frames = [("ep", i, i * 1000003, i * 7919) for i in range(50)]
    frames += [("cut", i, *x[2:]) for i, x in enumerate(frames[:40])] + [("other", i, -i * 982451653 - 7, i * 32452843 + 999) for i in range(50)]
    df = spark.createDataFrame(frames, "title string, frame_pos bigint, hi bigint, lo bigint")
    loose = spark.createDataFrame([("cut",), ("other",)], "key string")
    found = matching.extended_cuts(df, loose, spark.createDataFrame([("ep", 0)], "key string, episode_pos int")).collect()
    assert [(r["key"], r["episode"]) for r in found] == [("cut", "ep")]
    refs = spark.createDataFrame([("m", 0, 1), ("m", 0, 9), ("m", 1, 9), ("m", 1, 8)], "owner string, ref_pos int, id int")
    assert [tuple(r) for r in matching.dangling(refs, spark.createDataFrame([("m", 1)], "owner string, id int")).collect()] == [("m", 1)]


def test_crowded_frames_are_all_compared_without_pairs(spark, monkeypatch):
    import random

    # three bases, each with hundreds of patterns a few bits away, and more titles than a word has bits
    draw = random.Random(5)
    bases = [(draw.getrandbits(62), draw.getrandbits(62)) for _ in range(3)]
    frames = []
    for i in range(900):
        hi, lo = bases[i % 3]
        for _ in range(draw.randint(0, 7)):
            side, bit = draw.randrange(2), draw.randrange(62)
            hi, lo = (hi ^ (1 << bit), lo) if side else (hi, lo ^ (1 << bit))
        frames.append((f"t{draw.randrange(70)}", i, hi, lo))
    told = {}
    for a, _, hi, lo in frames:
        for b in {b for b, _, h, k in frames if (hi ^ h).bit_count() + (lo ^ k).bit_count() <= 4} - {a}:
            told[a, b] = told.get((a, b), 0) + 1
    df = spark.createDataFrame(frames, "title string, frame_pos bigint, hi bigint, lo bigint")
    for small, tile in ((48, 1 << 15), (2, 32)):
        monkeypatch.setattr(matching, "SMALL", small)
        monkeypatch.setattr(matching, "TILE", tile)
        assert {(r["a"], r["b"]): r["hits"] for r in matching.similar_frames(df, 4).collect()} == told
    monkeypatch.setattr(matching, "SMALL", 48)
    work = matching._shown_nearby(8)
    crowd = {"bands": [0] * 6000, "value": [7] * 6000, "hi": [1 << (i % 60) for i in range(6000)], "lo": list(range(6000)), "word": [0] * 6000, "bits": [1 << (i % 25) for i in range(6000)]}
    batch = lambda: pa.record_batch({**{k: pa.array(v, pa.int64() if k in ("value", "hi", "lo", "bits") else pa.int32()) for k, v in crowd.items()}, **{k: pa.array([0] * 6000, pa.int32()) for k in ("role", "i", "j")}})
    sizes = [b.num_rows for b in work(iter([batch()]))]
    assert sum(sizes) <= 6000  # not 36 million pairs


def test_music(spark):
    tracks = spark.createDataFrame([("d", 1, 0, True, 3000), ("d", 2, 750, False, 3000), ("d", 3, 1500, False, 3000)], "disc_id string, number int, start bigint, is_data boolean, leadout bigint")
    album = spark.createDataFrame([("d", "Al", "Band")], "disc_id string, title string, performer string")
    titles = spark.createDataFrame([("d", 2, "Song", "Band")], "disc_id string, number int, title string, performer string")
    rows = [tuple(r) for r in music.from_disc_text(tracks, album, titles).select("number", "title", "artist", "duration_ms").orderBy("number").collect()]
    assert rows == [(2, "Song", None, 10000), (3, "Track 03", None, 20000)]
    listing = spark.createDataFrame([("d", 0, "Al", "Band", 2001, 1, 1, [(2, "Song", 10000, None), (3, "Duet", 20000, "Guest")])], "disc_id string, pos int, title string, artist string, year int, disc int, discs int, tracks array<struct<number:int,title:string,length_ms:bigint,artist:string>>")
    entries = music.to_rip(tracks, listing)
    assert tuple(music.totals(entries).select("length_ms", "is_compilation").first()) == (30000, True)
    assert music.to_rip(tracks, listing, only=[3]).count() == 1 and music.to_rip(tracks, listing, only=[]).count() == 0


def test_entries_are_merged_not_broadcast(spark):
    tracks = spark.createDataFrame([("d", 2, False), ("d", 3, False), ("e", 1, True)], "disc_id string, number int, is_data boolean")
    listing = spark.createDataFrame([("d", p, "Al", "Band", 2001, 1, 1, [(2, "Song", 10000, None), (3, "Duet", 20000, "Guest")], f"L{p}") for p in (0, 1)], "disc_id string, pos int, title string, artist string, year int, disc int, discs int, tracks array<struct<number:int,title:string,length_ms:bigint,artist:string>>, label string")
    found = music.with_totals(music.to_rip(tracks, listing, also=("label",)))
    assert sorted(map(tuple, found.select("number", "label", "album_ms", "is_compilation").collect())) == [(2, "L0", 30000, True), (3, "L0", 30000, True)]
    assert "Broadcast" not in music.to_rip(tracks, listing)._jdf.queryExecution().executedPlan().toString()


def test_names_tags_and_predicates(spark):
    schema = "media string, show string, year int, role string, season int, number int, title string, date string"
    items = spark.createDataFrame([("series", "A: B", 2001, "Episode", 2, 7, "Pilot", "2001-02-03"), ("series", "A", None, "ExtendedCut", 2, 7, "Pilot", None), ("movie", "Film", 1999, "Feature", None, None, "x", None), ("movie", "Film", None, "Extra", None, None, "Making of", None), ("series", "A", None, "PlayAll", None, None, "all", None)], schema)
    c = F.col
    args = (c("media"), c("show"), c("year"), c("role"), c("season"), c("number"), c("title"))
    name = naming.file_name(*args, "mkv")
    got = items.select(name.alias("n"), naming.destination("/lib", c("media"), F.lit(2), c("role"), c("season"), name).alias("d"), naming.tags(*args, c("date")).alias("t"), naming.wanted(c("role"), extras=False).alias("w")).collect()
    assert [r["d"] for r in got] == ["/lib/Season 02/A - B - S02E07 - Pilot.mkv", "/lib/Season 02/extras/A - S02E07 - Pilot - Extended Cut.mkv", "/lib/Film (1999).mkv", "/lib/extras/Making of.mkv", "/lib/Season 02/all (play-all).mkv"]
    assert [r["w"] for r in got] == [True, True, True, False, False]
    assert tuple(got[0]["t"]) == ("Pilot", "A: B", 2, 7, "Pilot", "2001-02-03", 10) and tuple(got[2]["t"]) == ("Film", None, None, None, None, "1999", 9)
    told = items.limit(1).select(naming.pairs(naming.tags(*args, c("date")), {"show": "SHOW", "media_type": "TYPE"}).alias("p")).first()["p"]
    assert [tuple(x) for x in told] == [("SHOW", "A: B"), ("TYPE", "10")]
    one = spark.range(1)
    lit = lambda x: F.lit(x)
    path = lambda t: one.select(naming.track_path("/m", lit("Band"), lit(None).cast("string"), lit("Al"), lit(2001), lit(1), lit(2), lit(3), lit("Song"), "flac", **t).alias("p")).first()["p"]
    assert path({}) == "/m/Band/Al (2001)/Disc 1/03 - Song.flac"
    assert path({"template": "{artist}/{album}/{track:3} {title}"}) == "/m/Band/Al/003 Song.flac"
    lines = one.select(naming.plan_lines(lit(2), lit(0), lit(1), lit(0), lit(1)).alias("l")).first()["l"]
    assert lines == ["holds 2 episodes, 1 extended cut", "skipping 1 play-all title - the same video again"]
    ask = lambda col: one.select(col.alias("x")).first()["x"]
    assert ask(predicates.is_short(lit(100_000), lit(96_000))) and not ask(predicates.is_short(lit(1_000_000), lit(998_000)))
    assert ask(predicates.crop_is_worthwhile(lit("crop=716:576:2:0"), lit(720), lit(576))) and not ask(predicates.crop_is_worthwhile(lit("odd"), lit(720), lit(576)))
    assert ask(predicates.is_multi_track(F.array(lit("a.cue"), lit("b.bin"), lit("c.bin"))))
    assert ask(predicates.shortfall(lit(0), lit(0), lit(0), lit(9))) is None and ask(predicates.shortfall(lit(0), lit(2), lit(0), lit(9))) == "2 of 9 sectors are the drive's best guess"
    assert ask(predicates.disc_kind(lit(False), lit(True), lit(True), lit(True))) == "Dvd"
    assert ask(predicates.is_bitmap_subtitle(lit("subtitle"), lit("dvd_subtitle"))) and ask(predicates.is_commentary(lit("Director's"))) and ask(predicates.is_usable(lit(10), lit(4)))


def test_lettering_is_learned_in_batches_while_it_is_thin(spark):
    import random

    from platterlens.operators import glyphs

    draw = random.Random(6)
    cues = {(s, c): [draw.choice("aaaabbbccd" + ("e" if s == "x" else "")) for _ in range(draw.randrange(1, 6))] for s in "xy" for c in range(60)}
    said = {k: [g.upper() if draw.random() < 0.9 else "?" for g in v] + (["!"] if k[1] % 7 == 0 else []) for k, v in cues.items()}
    votes, read = {}, []
    for s in "xy":
        batch, n, no = [], 0, 0
        for c in range(60):
            if n >= 40:
                break
            if any(sum(m for (t, key, _), m in votes.items() if (t, key) == (s, g)) < 9 for g in cues[s, c]):
                batch.append(c)
                n += 1
            if len(batch) == 8 or n >= 40 or c == 59:
                read += [(s, b, no) for b in batch]
                for b in batch:
                    if len(said[s, b]) == len(cues[s, b]):
                        for g, a in zip(cues[s, b], said[s, b]):
                            votes[s, g, a] = votes.get((s, g, a), 0) + 1
                batch, no = [], no + 1
    table = lambda of, name: spark.createDataFrame([(s, c, i, g) for (s, c), v in of.items() for i, g in enumerate(v)], f"stream string, cue int, pos int, {name} string")
    got, asked = glyphs.learned(table(cues, "key"), table(said, "label"), 9, 40, 8)
    assert sorted(map(tuple, asked.collect())) == sorted(read)
    assert {(r["stream"], r["key"], r["label"]): r["n"] for r in got.collect()} == votes


def test_taught_votes_are_worked_out_once(spark, small):
    from platterlens.plans import catalogue

    plan = catalogue.queries()["taught_votes"](spark, small)._jdf.queryExecution().optimizedPlan().toString()
    assert "l_orderkey" not in plan


def test_learning_reads_shapes_once_and_then_once_a_round(spark):
    from platterlens.operators import glyphs

    read = spark.sparkContext.accumulator(0)

    def counted(key):
        read.add(1)
        return key

    seen = [("x", c, i, (c * 3 + i) % 11) for c in range(40) for i in range(3)]
    shapes = spark.createDataFrame(seen, "stream string, cue int, pos int, code int").withColumn("key", F.udf(counted, "int")("code"))
    said = spark.createDataFrame([(s, c, i, "abcdefghijk"[k]) for s, c, i, k in seen], "stream string, cue int, pos int, label string")
    votes, asked = glyphs.learned(shapes.drop("code"), said, 6, 40, 6)
    rounds = asked.select("batch_no").distinct().count()
    assert rounds > 3 and votes.agg(F.sum("n")).first()[0] == 3 * asked.count()
    assert read.value <= len(seen) * (1 + rounds)


def test_titles_are_made_once_for_both_readings(spark):
    from platterlens.operators import structure

    made = spark.sparkContext.accumulator(0)

    def counted(ms):
        made.add(1)
        return ms

    rows = [(f"d{d}", f"t{t}", t, 1_200_000 + 1000 * t, [300_000 + t, 900_000]) for d in range(5) for t in range(4)]
    titles = spark.createDataFrame(rows, "disc_id string, key string, title_pos int, ms long, chapters array<long>").withColumn("duration_ms", F.udf(counted, "long")("ms")).drop("ms")
    assert structure.organise(titles).filter("role = 'episode'").count() == len(rows)
    assert made.value == len(rows)


def test_patterns_are_never_broadcast(spark):
    """However well patterns compress, only tables of titles and of crowded buckets go through the driver."""
    import re

    k = F.col("id")
    frames = spark.range(4000).select((F.floor(k / 1200) + k % 2).cast("string").alias("title"), k.alias("frame_pos"), (k % 400 * 7919).alias("hi"), (k % 300 * 104729).alias("lo"))
    found = matching.similar_frames(frames, 7)
    assert len(found.collect()) > 0
    told = spark.sparkContext._jvm.PythonSQLUtils.explainString(found._jdf.queryExecution(), "formatted").split("== Initial Plan ==")[0]
    sizes = [int(float(n)) for n in re.findall(r"BroadcastQueryStage .*rowCount=([0-9.E+]+)", told)]
    assert sizes and max(sizes) <= 25
