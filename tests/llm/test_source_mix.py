from __future__ import annotations

import random

import numpy as np
from edge import awkward, documents, words
from pyspark.sql import functions as F

from platterlens.llm import source_mix


def test_targets():
    assert source_mix.targets([100, 100, 100]) == [200.0, 500 / 3, 250 / 3] or np.allclose(source_mix.targets([100, 100, 100]), [200, 500 / 3, 250 / 3])
    assert np.allclose(source_mix.targets([10, 1000, 0]), [20, 1495, 0])
    assert source_mix.targets([]) == [] and source_mix.targets([0, 0]) == [0.0, 0.0]
    draw = random.Random(1)
    for _ in range(200):
        sizes = [draw.choice([0, 1, draw.randrange(1000)]) for _ in range(draw.randrange(1, 9))]
        t = source_mix.targets(sizes)
        assert abs(sum(t) - 1.5 * sum(sizes)) < 1e-6 and all(x <= 2 * s + 1e-9 for x, s in zip(t, sizes))


def test_tree_deals_exact_quotas():
    out = source_mix.quotas([100, 7, 0, 1], 16, 3)
    assert out.sum(axis=0).tolist() == [100, 7, 0, 1] and (out >= 0).all() and out.sum(axis=1).max() - out.sum(axis=1).min() <= 1


def test_rows(spark):
    draw = random.Random(6)
    rows = [(i, words(draw, draw.choice([0, 1, 5, 40, 300])), "en", draw.choice(["a", "a", "a", "b", "c", None])) for i in range(1500)] + awkward()
    df = documents(spark, rows)
    found = source_mix.draw(df, shards=8).withColumn("taken", F.size("units") * F.col("size"))
    again = {(r["doc_id"], r["text"]): r["units"] for r in source_mix.draw(df.repartition(7), shards=8).collect()}
    got = found.collect()
    assert len(got) == len(rows)
    assert all(again[r["doc_id"], r["text"]] == r["units"] for r in got)
    for source in {r["source"] for r in got}:
        mine = [r for r in got if r["source"] == source]
        assert {r["source_size"] for r in mine} == {sum(r["size"] for r in mine)}
        assert all(len(r["units"]) <= 2 for r in mine)
        miss = abs(sum(r["taken"] for r in mine) - mine[0]["target"])
        assert miss <= max(1, min((r["size"] for r in mine if r["size"]), default=1), 0.01 * mine[0]["target"])
    mixed = source_mix.mix(df, shards=8)
    assert mixed.count() == sum(len(r["units"]) for r in got)
    assert source_mix.draw(df.limit(0)).count() == 0
    assert source_mix.stage(spark, df, "").columns == df.columns


def test_columns_of_any_name_pass_through(spark):
    names = ["source_no", "n_blocks", "passes", "block", "h", "row", "of", "dealt", "part", "drawn", "n", "shard", "pass", "whole_passes", "bounds", "unit"]
    df = spark.createDataFrame([(i, f"w{i} x y", "a", *[77] * len(names)) for i in range(40)], "doc_id bigint, text string, source string, " + ", ".join(f"{n} int" for n in names))
    for r in source_mix.draw(df).collect():
        assert all(r[n] == 77 for n in names)
    for r in source_mix.mix(df).collect():
        assert all(r[n] == 77 for n in names if n not in ("shard", "pass"))
    assert source_mix.stage(spark, df, "").columns == df.columns


def test_places_and_quotas_of_the_query(spark, larger):
    """From the units alone: disjoint blocks a pass, each shard as many units of every source as the tree gave it, and what
    a source lacks is less than its smallest document."""
    docs = spark.read.parquet(f"{larger}/documents.parquet").select("doc_id", "text", "source")
    rows = source_mix.draw(docs).collect()
    sizes = {}
    for r in rows:
        n = len((r["text"] or "").encode().split())
        assert r["size"] == n
        sizes.setdefault(r["source"], []).append(n)
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    asked = dict(zip(names, source_mix.targets([sum(sizes[n]) for n in names])))
    for name in names:
        mine = [r for r in rows if r["source"] == name]
        assert {r["target"] for r in mine} == {asked[name]} and {r["source_size"] for r in mine} == {sum(sizes[name])}
        passes = int(asked[name] // sum(sizes[name]))
        assert all(sorted(u["pass"] for u in r["units"])[:passes] == list(range(passes)) for r in mine)
        taken, part = sum(r["size"] * len(r["units"]) for r in mine), asked[name] - passes * sum(sizes[name])
        reach = 1
        for n in sizes[name]:
            reach |= reach << n
        best = min(abs(i - part) for i in range(max(0, int(part) - 2000), int(part) + 2000) if reach >> i & 1)
        assert abs(taken - asked[name]) <= max(best, 1) + 1e-6
    units = [(u["shard"], u["place"]) for r in rows for u in r["units"]]
    assert len({s for s, _ in units}) > 1 and len(set(units)) == len(units)


def test_query(spark, larger):
    found = source_mix.query(spark, larger).join(spark.read.parquet(f"{larger}/documents.parquet").select("doc_id", "source", "text"), "doc_id")
    import re

    rows = found.collect()
    assert all(r["size"] == len(re.findall(r"[^\x20\x09-\x0D]+", r["text"] or "")) and r["taken"] <= 2 * r["size"] for r in rows)
    for source in {r["source"] for r in rows}:
        mine = [r for r in rows if r["source"] == source]
        assert abs(sum(r["taken"] for r in mine) - mine[0]["target"]) <= 0.01 * mine[0]["target"]
