from __future__ import annotations

from platterlens.sources import catalogues, datfiles, media, texts
from platterlens.streaming import eventlog


def test_datfiles(spark):
    xml = """<datafile><header><name>Console &amp; Co</name><version>1</version></header>
    <game name="First (Europe)"><rom name="f.cue" size="90" crc="00000001" sha1="AA"/><rom name="f1.bin" size="7056000" crc="0badc0de" sha1="BB"/><rom name="f2.bin" size="41160000" crc="1234abcd" sha1="cc"/><rom size="3"/></game>
    <game name="Cut off"><rom name="x.iso" size="2048000" crc="0000000f" """
    files = spark.createDataFrame([("b.dat", xml + '/>'), ("a.dat", "<game name='none'></game>")], "path string, xml string")
    roms = datfiles.roms_of(files).orderBy("game_pos", "rom_pos").collect()
    assert [(r["system"], r["dat_pos"], r["game"], r["name"], r["size"], r["crc32"], r["sha1"]) for r in roms] == [
        ("Console & Co", 1, "First (Europe)", "f.cue", 90, 1, "aa"), ("Console & Co", 1, "First (Europe)", "f1.bin", 7056000, 0x0BADC0DE, "bb"),
        ("Console & Co", 1, "First (Europe)", "f2.bin", 41160000, 0x1234ABCD, "cc"), ("Console & Co", 1, "Cut off", "x.iso", 2048000, 15, None),
    ]
    assert datfiles.tracks_of(datfiles.roms_of(files)).filter("game = 'First (Europe)'").count() == 2


def test_shows(spark):
    answer = '[{"score":1.7,"show":{"id":1,"name":"A","type":"Drama","premiered":"2003-04-05","ended":"2007-08-09","network":{"name":"Channel Q"},"webChannel":null}},{"score":null,"show":{"id":2,"name":"B","webChannel":{"name":"Web Q"},"premiered":"2019-01-01","status":"Running"}},{"score":0.1,"show":{"id":3}}]'
    found = catalogues.show_search(spark.createDataFrame([("q", answer), ("r", "not json")], "question string, json string")).orderBy("hit_pos").collect()
    assert [(r["work_id"], r["score"], r["year"], r["detail"]) for r in found] == [("tvmaze:1", 1.0, 2003, "Channel Q · Drama · 2003-2007"), ("tvmaze:2", 0.0, 2019, "Web Q · ongoing")]
    episodes = catalogues.show_episodes(spark.createDataFrame([("w", '[{"season":7,"number":1,"name":"x","airdate":"","runtime":22},{"season":7,"number":0},{"season":7,"number":null},{"season":7,"number":2,"name":"y"}]')], "work_id string, json string"))
    assert [(r["number"], r["runtime_ms"], r["airdate"]) for r in episodes.orderBy("number").collect()] == [(1, 1320000, None), (2, None, None)]


def test_ranked(spark):
    found = catalogues.ranked_search(spark.createDataFrame([("q", '{"results":[{"id":1,"title":"A","release_date":"1998-05-05"},{"id":2,"title":""},{"id":3,"name":"C"}]}')], "question string, json string")).orderBy("hit_pos").collect()
    assert [(r["work_id"], r["year"], round(r["score"], 4)) for r in found] == [("tmdb:1", 1998, 1.0), ("tmdb:3", None, 0.6667)]


def test_entities(spark):
    found = catalogues.entity_search(spark.createDataFrame([("q", '{"search":[{"id":"Q1","description":"book"},{"id":"Q2","description":"film"}]}')], "question string, json string"))
    claim = lambda v: '[{"mainsnak":{"datavalue":{"value":%s}}}]' % v
    answer = '{"entities":{"Q1":{"labels":{"en":{"value":"No"}},"claims":{"P31":%s}},"Q2":{"labels":{"en":{"value":"Yes"}},"claims":{"P31":%s,"P577":%s,"P2047":%s}}}}' % (
        claim('{"id":"Q571"}'), claim('{"id":"Q11424"}'), claim('{"time":"+1998-02-03T00:00:00Z"}'), claim('{"amount":"+95"}'))
    films = catalogues.entity_films(spark.createDataFrame([("q", answer)], "question string, json string"), found).collect()
    assert [(r["entity"], r["title"], r["year"], r["runtime_ms"], r["score"]) for r in films] == [("Q2", "Yes", 1998, 5700000, 0.75)]


def test_albums(spark):
    answer = '{"releases":[{"id":"r","title":"T","date":"2001-01","country":"GB","artist-credit":[{"name":"A","joinphrase":" & "},{"name":"B"}],"label-info":[{"catalog-number":"C1","label":{"name":"L"}}],"media":[{"position":1,"discs":[{"id":"other"}]},{"position":2,"discs":[{"id":"d"}],"tracks":[{"position":1,"title":"x","length":205000,"artist-credit":[{"name":"A","joinphrase":" & "},{"name":"B"}]},{"position":2,"title":"y","recording":{"length":246000},"artist-credit":[{"name":"Z"}]}]}]}]}'
    album = catalogues.albums(spark.createDataFrame([("d", answer)], "disc_id string, json string")).first()
    assert (album["artist"], album["disc"], album["discs"], album["label"], album["year"]) == ("A & B", 2, 2, "L", 2001)
    assert [tuple(t) for t in album["tracks"]] == [(1, "x", 205000, None), (2, "y", 246000, "Z")]


def test_probe(spark):
    probe = '{"format":{"duration":"1500.25"},"chapters":[{"start_time":"0.0","end_time":"300.0"},{"start_time":"300.0","end_time":"1500.25"}],"streams":[{"codec_type":"video","codec_name":"mpeg2video","width":720,"height":576},{"codec_type":"audio","codec_name":"ac3","tags":{"language":"eng"},"disposition":{"default":1}},{"codec_type":"audio","codec_name":"ac3","tags":{"title":"Director commentary"}},{"codec_type":"data"}]}'
    files = spark.createDataFrame([("f", probe)], "file string, json string")
    info = media.probes(files).first()
    assert (info["duration_ms"], info["chapters"], info["width"]) == (1500250, [300000, 1200250], 720)
    assert [(r["kind"], r["index"], r["language"], r["is_default"]) for r in media.streams(files).orderBy("stream").collect()] == [("video", 0, "und", False), ("audio", 0, "eng", True), ("audio", 1, "und", False)]
    assert media.streams(files).filter(media.commentary("title")).count() == 1


def test_log(spark):
    said = ['TINFO:0,2,0,"A ""b"", c"', 'TINFO:0,8,0,"5"', 'TINFO:0,9,0,"0:21:15"', 'TINFO:0,8,0,"6"', 'SINFO:0,1,3,0,"eng"', 'MSG:1,0,1,"all well"', 'MSG:2,0,1,"Failed to open disc"', 'DRV:0,2,999,12,"BD","LABEL","/dev/sr0"', 'DRV:1,0,999,0,"","",""', "PRGV:1,50,200"]
    lines = spark.createDataFrame([("d", i, x) for i, x in enumerate(said)], "disc_id string, line_no int, line string")
    title = media.titles(media.attributes(lines)).first()
    assert (title["name"], title["chapters"], title["duration_ms"]) == ('A "b", c', 6, 1275000)
    assert media.first_error(lines).first()["text"] == "Failed to open disc"
    assert [tuple(r) for r in media.drives(lines).select("slot", "device").collect()] == [(0, "/dev/sr0")]
    assert media.progress(lines).first()["share"] == 0.25


def test_texts(spark):
    srt = "﻿1\r\n00:00:01,000 --> 00:00:02,500\r\nHello\r\nthere\r\n\r\nrubbish\r\n\r\n3\r\n00:00:03.000 --> 00:00:04.000\r\nBye\r\n"
    cues = texts.cues(spark.createDataFrame([("s", srt)], "stream_id string, content string"))
    assert [(r["start_ms"], r["end_ms"], r["text"]) for r in cues.orderBy("seq").collect()] == [(1000, 2500, "Hello\nthere"), (3000, 4000, "Bye")]
    again = texts.cues(texts.subtitle_text(cues))
    assert [r["text"] for r in again.orderBy("seq").collect()] == ["Hello\nthere", "Bye"]
    lines = spark.createDataFrame([("m", "# a comment"), ("m", "0x00000000  0x00000800  +"), ("m", "2048 10 -"), ("m", "garbage")], "map_id string, line string")
    runs = texts.map_runs(lines)
    assert sorted(tuple(r) for r in runs.select("start", "end", "state").collect()) == [(0, 2048, "Finished"), (2048, 2058, "Bad")]
    assert sorted(r["line"] for r in texts.map_lines(runs).collect()) == ["0x00000000  0x00000800  +", "0x00000800  0x0000000A  -"]
    index = spark.createDataFrame([("s", "timestamp: 00:01:02:003, filepos: 00000f00"), ("s", "palette: ff0000, 00ff00, zz")], "stream_id string, line string")
    assert tuple(texts.index_events(index).select("start_ms", "filepos").first()) == (62003, 0xF00)
    assert texts.palette(index).first()["palette"] == [0xFF0000, 0x00FF00, 0]
    words = spark.createDataFrame([("41",), ("Kanske/AB",), ("hus",), ("-/-QQ",), ("x",)], "line string")
    assert {r["word"] for r in texts.words(words).collect()} == {"kanske", "hus"}
    spans = spark.createDataFrame([("d", "g", 1, True, 0), ("d", "g", 2, False, 150)], "disc_id string, stem string, number int, is_data boolean, pregap bigint")
    assert texts.cue_sheet(spans).first()["sheet"].endswith('FILE "g (Track 02).bin" BINARY\n  TRACK 02 AUDIO\n    INDEX 00 00:00:00\n    INDEX 01 00:02:00\n')


def test_stream_counts(spark, small, tmp_path):
    events = spark.read.parquet(f"{small}/events.parquet")
    stream = spark.readStream.schema(events.schema).option("pathGlobFilter", "events.parquet").parquet(small)
    from pyspark.sql import functions as F

    counted = eventlog.windowed(stream.withColumn("ts", F.col("ts").cast("timestamp")))
    query = counted.writeStream.format("memory").queryName("counted").outputMode("complete").trigger(availableNow=True).start()
    query.awaitTermination()
    assert spark.table("counted").agg(F.sum("n")).first()[0] == events.count()


def test_titles_of_a_log_need_one_shuffle_and_read_long_values(spark):
    long = "x" * 30_000 + '""y""'
    lines = [("d", 1, f'TINFO:0,2,0,"{long}"'), ("d", 2, 'TINFO:0,8,0,"7"'), ("d", 3, 'SINFO:0,1,8,0,"9"'), ("d", 4, 'CINFO:8,0,"5"'), ("d", 5, "TINFO:0"), ("d", 6, 'TINFOS:0,8,0,"1"'), ("d", 7, 'TINFO:0,8,0,"8"')]
    found = media.titles(media.attributes(spark.createDataFrame(lines, "disc_id string, line_no bigint, line string")))
    assert found._jdf.queryExecution().executedPlan().toString().count("Exchange") == 1
    assert [(r["title"], r["name"], r["chapters"]) for r in found.collect()] == [(0, long.replace('""', '"'), 8)]
