"""A datfile that is read by many tasks gives what it gives as one text."""

from __future__ import annotations

import os

from platterlens.sources import datfiles


def test_one_large_file_by_many_tasks(spark, tmp_path):
    games = [f'<game name="Game {i} &amp; Co">\n' + "".join(f'<rom name="t{j}.bin" size="{i * 10 + j}" crc="{i:08x}" sha1="{i:040X}"/>\n' for j in range(i % 4)) + "</game>" for i in range(400)]
    text = "<datafile><header><name>Big &lt;One&gt;</name></header>\n" + "\n".join(games) + "\n</datafile>"
    (tmp_path / "big.dat").write_text(text)
    (tmp_path / "a.xml").write_text('<datafile><header><name>Small</name></header><game name="x"><rom name="y" size="1"/></game></datafile>')
    (tmp_path / "notes.txt").write_text('<game name="no"><rom name="z" size="2"/></game>')
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "8192")
    try:
        found = datfiles.read_datfiles(spark, str(tmp_path))
        assert spark.read.option("lineSep", "<game").text(str(tmp_path / "big.dat")).rdd.getNumPartitions() > 4
        rows = sorted(map(tuple, found.collect()))
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    files = spark.createDataFrame([(os.fspath(tmp_path / n), (tmp_path / n).read_text()) for n in ("big.dat", "a.xml")], "path string, xml string")
    assert rows == sorted(map(tuple, datfiles.roms_of(files).collect())) and len(rows) == sum(i % 4 for i in range(400)) + 1


def test_a_datfile_in_parts_is_one(spark, tmp_path):
    game = lambda i: f'<game name="g{i}"><rom name="a.cue" size="{i}"/><rom name="b.bin" size="{i}"/><rom name="c.bin" size="{i}"/></game>\n'
    for dat in "xy":
        for part, text in enumerate([f"<datafile><header><name>{dat}</name></header>\n", "".join(map(game, range(1, 40))), "".join(map(game, range(40, 55)))]):
            (tmp_path / f"of={dat}" / f"slice={part}").mkdir(parents=True)
            (tmp_path / f"of={dat}" / f"slice={part}" / "part-0").write_text(text)
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "1024")
    try:
        found = datfiles.with_tracks(datfiles.read_datfiles(spark, str(tmp_path), r"/part-[^/]*$", r"^(.*/of=[^/]*)/")).collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    rows = sorted((r["system"], r["dat_pos"], r["game_pos"], r["game"], r["rom_pos"], r["track_pos"]) for r in found)
    assert rows == [(s, d, i - 1, f"g{i}", p, [None, 0, 1][p]) for d, s in enumerate("xy") for i in range(1, 55) for p in range(3)]
