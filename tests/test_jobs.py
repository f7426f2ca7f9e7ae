"""Jobs: items that fail alone, streams that are taken up again, publishing, sweeps over maps, scratch and mounts."""

from __future__ import annotations

import random
import uuid

import pyarrow as pa
import pyarrow.compute as pc
import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from platterlens.operators import checksums, intervals, jobs
from platterlens.shared import shared_folder
from platterlens.sources import versions
from platterlens.streaming import jobs as streams


def scratch(spark, name):
    return f"{shared_folder(spark)}/test-{name}-{uuid.uuid4().hex}"


def test_one_bad_item_fails_alone(spark):
    rows = [(i, "oops" if i in (3, 40, 41, 99) else None if i == 50 else str(i)) for i in range(100)]
    df = spark.createDataFrame(rows, "k int, t string")
    found = {r["k"]: r for r in jobs.isolating(df, lambda b: pc.cast(b.column("t"), pa.int64()), T.LongType(), 16).collect()}
    assert len(found) == 100 and {k for k, r in found.items() if not r["ok"]} == {3, 40, 41, 99}
    assert all(r["value"] == (None if k == 50 else k) for k, r in found.items() if r["ok"]) and all("oops" in found[k]["error"] for k in (3, 40))
    assert jobs.isolating(df.limit(0), lambda b: b.column("k"), T.IntegerType()).count() == 0


def test_attempts_are_filed_apart_in_one_pass(spark):
    df = spark.range(10).select("id", F.when(F.col("id") % 4 != 1, F.col("id")).alias("x"))
    tried = jobs.attempted(df, [(F.col("x").isNull(), F.lit("no x")), (F.col("x") == 8, F.concat(F.lit("bad "), F.col("x").cast("string")))], F.lit(100) / (F.col("x") - 8))
    good, bad, counts = jobs.filed(tried, scratch(spark, "filed"))
    assert counts == {"done": 6, "quarantined": 4} and {r["id"]: r["error"] for r in bad.collect()} == {1: "no x", 5: "no x", 9: "no x", 8: "bad 8"}
    assert good.filter("value is null").count() == 0 and good.count() == 6
    none = jobs.filed(tried.filter("id = 2"), scratch(spark, "filed"))
    assert none[1].count() == 0 and none[2] == {"done": 1, "quarantined": 0}


def test_report_lines(spark):
    df = spark.createDataFrame([(1, 2, True, 2 * 1_048_576, None), (1, 1, False, None, "unreadable"), (2, 1, True, 0, None)], "job int, n int, ok boolean, value bigint, error string")
    found = {r["job"]: r for r in jobs.reports(df, ["job"], F.concat(F.lit("t"), F.col("n").cast("string")), F.concat(F.lit("f"), F.col("n").cast("string")), "n").collect()}
    assert found[1]["lines"] == ["1 files, 2.0 MiB", "  f2  2.0 MiB", "  FAILED t1: unreadable"] and not found[1]["complete"] and found[2]["complete"]


def test_sizes_round_exact_halves_to_even(spark):
    sizes = [0, 1, 1 << 18, 3 << 18, 5 << 18, 1031 << 20 | 1 << 18, 1 << 20, (1 << 20) - 1, 104857, 52429, 52428, (7 << 50) + (3 << 18)]
    df = spark.createDataFrame([(n,) for n in sizes], "n bigint").select("n", jobs.in_mib(F.col("n")).alias("told"))
    assert {r["n"]: r["told"] for r in df.collect()} == {n: f"{n / (1 << 20):.1f} MiB" for n in sizes}
    one = spark.createDataFrame([(1, 1, True, 1 << 18, None)], "job int, n int, ok boolean, value bigint, error string")
    assert jobs.reports(one, ["job"], F.lit("t"), F.lit("f"), "n").first()["lines"] == ["1 files, 0.2 MiB", "  f  0.2 MiB"]


def _events(spark, folder, rows):
    spark.createDataFrame(rows, "job int, pos bigint, fraction double, kind string").coalesce(1).write.mode("append").parquet(folder)
    return spark.readStream.schema("job int, pos bigint, fraction double, kind string").option("maxFilesPerTrigger", 1).parquet(folder)


def test_progress_never_falls_over_a_restart(spark):
    source, out = scratch(spark, "events"), scratch(spark, "rising")

    def drain(stream):
        streams.rising(stream).writeStream.format("parquet").outputMode("append").option("checkpointLocation", f"{out}-at").option("path", out).trigger(availableNow=True).start().awaitTermination()

    drain(_events(spark, source, [(1, 1, 0.2, "p"), (1, 2, 0.1, "p"), (1, 3, 0.5, "p"), (2, 4, 0.9, "p"), (3, 5, None, "p")]))
    drain(_events(spark, source, [(1, 6, 0.4, "p"), (1, 7, 0.6, "p"), (2, 8, 0.9, "p"), (4, 9, 0.0, "p")]))
    assert sorted((r["job"], r["pos"]) for r in spark.read.parquet(out).collect()) == [(1, 1), (1, 3), (1, 7), (2, 4), (4, 9)]


def test_a_broken_fan_out_is_taken_up_without_loss_or_repeats(spark):
    source, folder = scratch(spark, "events"), scratch(spark, "sinks")
    for k in range(3):
        stream = _events(spark, source, [(1, 10 * k + i, 0.1, "warn" if i % 3 == 0 else "progress") for i in range(10)])
    fails = [True]

    def second(batch):
        if fails[0] and not batch.isStreaming and batch.count() and batch.agg(F.max("pos")).first()[0] >= 10:
            raise RuntimeError("the second sink is full")
        return batch.filter("kind = 'progress'").select("pos")

    sinks = {"log": lambda b: b.filter("kind <> 'progress'").select("pos"), "progress": second}
    with pytest.raises(Exception, match="the second sink is full"):
        streams.fanned_out(stream, folder, sinks)
    assert spark.read.parquet(f"{folder}/log/batch=*").count() > 4  # the first sink has a batch that the second has not
    fails[0] = False
    found = streams.fanned_out(stream, folder, sinks)
    assert sorted(r["pos"] for r in found["log"].collect()) == [p for p in range(30) if p % 10 % 3 == 0]
    assert sorted(r["pos"] for r in found["progress"].collect()) == [p for p in range(30) if p % 10 % 3]
    again = streams.fanned_out(stream, folder, sinks)
    assert again["log"].count() == 12
    empty = scratch(spark, "events")
    spark.createDataFrame([], "job int, pos bigint, fraction double, kind string").write.parquet(empty)
    assert streams.fanned_out(spark.readStream.schema("job int, pos bigint, fraction double, kind string").parquet(empty), scratch(spark, "sinks"), sinks)["log"].count() == 0


def test_a_killed_write_leaves_the_version_before(spark):
    folder = scratch(spark, "settings")
    default = spark.createDataFrame([("d", 0)], "k string, v int")
    assert versions.published(default, folder).collect() == default.collect() and versions.current(spark, folder) is None
    versions.publish(spark.createDataFrame([("a", 1)], default.schema), folder)
    bad = spark.range(100).select(F.lit("b").alias("k"), F.when(F.col("id") == 99, F.raise_error(F.lit("killed"))).otherwise(1).cast("int").alias("v"))
    with pytest.raises(Exception, match="killed"):
        versions.publish(bad, folder)
    assert [tuple(r) for r in versions.published(default, folder).collect()] == [("a", 1)]
    name = versions.staged(spark.createDataFrame([("c", 3)], default.schema), folder)
    assert [tuple(r) for r in versions.published(default, folder).collect()] == [("a", 1)]
    versions.commit(spark, folder, name)
    assert [tuple(r) for r in versions.published(default, folder).collect()] == [("c", 3)]
    versions.commit(spark, folder, "v-that-is-not-there")
    assert versions.published(default, folder).collect() == default.collect()


def _plain_runs(writes):
    now = {}
    for _, a, b, state in sorted(writes):
        now |= dict.fromkeys(range(a, b), state)
    out = []
    for x in sorted(now):
        if out and out[-1][1] == x and out[-1][2] == now[x]:
            out[-1][1] = x + 1
        else:
            out.append([x, x + 1, now[x]])
    return [tuple(r) for r in out]


@pytest.mark.parametrize("rows", [256, 2])
def test_maps_by_a_sweep(spark, monkeypatch, rows):
    monkeypatch.setattr(intervals, "CELL_ROWS", rows)
    draw, writes, want = random.Random(2), [], {}
    for m in [None, 0, 1, 2, 3]:
        size = draw.choice([10, 300, 1000])
        own = [(q, a, a + draw.randrange(0, size if draw.random() < 0.5 else 5), draw.choice("abc")) for q in range(draw.choice([1, 5, 60])) for a in [draw.randrange(-size, size)]]
        writes += [(m, *w) for w in own]
        want[m] = _plain_runs(own)
    found: dict = {m: [] for m in want}
    for r in intervals.overwrite(spark.createDataFrame(writes, "m int, seq int, start bigint, end bigint, state string"), ["m"]).collect():
        found[r["m"]].append((r["start"], r["end"], r["state"]))
    assert {m: sorted(x) for m, x in found.items()} == want
    points = [(m, x) for m in want for x in range(-30, 60)]
    ranges = [(m, a, a + draw.randrange(-2, 9)) for m in want for _ in range(12) for a in [draw.randrange(-20, 50)]] + [(1, -10, 40), (2, -10, 40)]
    told = intervals.covered(spark.createDataFrame(points, "m int, at int"), spark.createDataFrame(ranges, "m int, start int, end int"), ["m"])
    assert all(r["covered"] == any(m == r["m"] and a <= r["at"] < b for m, a, b in ranges) for r in told.collect()) and told.count() == len(points)
    plan = told._jdf.queryExecution().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan


def test_sectors_of_known_dumps_are_never_looked_at(spark):
    good = checksums.SYNC + b"\x00\x02\x00\x02\x00\x00\x20" + bytes(2333)
    sectors = spark.createDataFrame([(1, 0, bytearray(good)), (2, 0, bytearray(good)), (2, 1, bytearray(good)), (3, 0, bytearray(2352)), (4, 0, bytearray(good[:200]))], "dump_id int, sector_pos bigint, raw binary")
    matched = spark.createDataFrame([(1, "known"), (2, None), (3, None), (4, None), (5, None)], "dump_id int, game string")
    checked = checksums.dump_checks(matched, sectors)
    assert {r["dump_id"]: (r["verdict"], r["sectors"], r["bad"]) for r in checked.collect()} == {1: ("verified", None, None), 2: ("misread", 2, 1), 3: ("unknown", None, None), 4: ("misread", 1, 1), 5: ("unknown", None, None)}
    plan = checked._jdf.queryExecution().executedPlan().toString()
    assert "LeftSemi" in plan[plan.index("MapInArrow") :]  # below the reading of sectors


def test_scratch_and_mounts(spark):
    record = spark.createDataFrame([(1, "title_t41.mkv"), (1, "a.b.mkv"), (1, ".mkv"), (2, "x.mkv"), (1, "noending")], "d int, output_name string")
    names = ["title_t41.mkv", "title_t41.eng.srt", "title_t41.mkv.part", "title_t410.mkv", "title_t41", "a.b.srt", "a.srt", ".mkv", "x.mkv", "noending.part"]
    found = jobs.cleared(spark.createDataFrame([(1, n) for n in names], "d int, name string"), record, ["d"])
    assert {r["name"] for r in found.collect()} == {"title_t41.mkv", "title_t41.eng.srt", "title_t41.mkv.part", "a.b.srt", "noending.part"}
    mounts = spark.createDataFrame([(1, "/dev/sda", "/", 0), (1, "/dev/sr0", "/media/My\\040Disc", 1), (1, "tmpfs", "/media/My\\040Disc/x", 2), (1, "/dev/sr1", "/media/My\\040Disc", 3)], "h int, device string, at string, pos int")
    asked = ["file:///media/My%20Disc/", "/media/My Disc/x", "/media/My Disc2", "/dev/sr7", "/", "relative"]
    got = {r["argument"]: (r["device"], r["within"]) for r in jobs.devices(spark.createDataFrame([(1, a) for a in asked], "h int, argument string"), mounts, ["h"]).collect()}
    assert got == {asked[0]: ("/dev/sr0", "/dev/sr0"), asked[1]: (None, "/dev/sr0"), asked[2]: (None, "/dev/sda"), asked[3]: ("/dev/sr7", "/dev/sr7"), asked[4]: (None, None), asked[5]: (None, None)}


@pytest.mark.parametrize("rows", [256, 3])
def test_as_of_in_cells(spark, monkeypatch, rows):
    from platterlens.operators import matching

    monkeypatch.setattr(intervals, "CELL_ROWS", rows)
    draw = random.Random(4)
    spans = [(g, draw.randrange(-50, 50), n) for g in (None, 1, 2) for n in range(draw.choice([1, 30]))]
    probes = [(g, x, i) for i, (g, x) in enumerate((g, draw.randrange(-70, 70)) for g in (None, 1, 2, 3) for _ in range(60))]
    found = {r["id"]: r["number"] for r in matching.as_of(spark.createDataFrame(probes, "g int, at bigint, id int"), spark.createDataFrame(spans, "g int, start bigint, number bigint"), ["g"]).collect()}
    for g, x, i in probes:
        own = sorted((s, n) for k, s, n in spans if k == g)
        before = [n for s, n in own if s <= x]
        assert found[i] == (before[-1] if before else own[0][1] if own else None)
