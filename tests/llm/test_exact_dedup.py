from __future__ import annotations

import random
from collections import defaultdict

from edge import awkward, documents

from platterlens.llm import exact_dedup


def test_index_against_a_dict():
    draw, index, told = random.Random(4), exact_dedup.CuckooIndex(16), {}
    for _ in range(20_000):
        key = draw.randrange(6000).to_bytes(8, "little") + draw.randrange(3).to_bytes(2, "little") + bytes(30)
        if draw.random() < 0.6:
            if index.find(key) is None:
                index.insert(key, [1, 1])
            told[key] = 1
        else:
            assert index.delete(key) == (told.pop(key, None) is not None)
    assert dict(index.items()).keys() == told.keys() and index.size == len(told)
    assert all(index.find(k) is not None for k in told)


def test_overflow_of_one_bucket_grows():
    index = exact_dedup.CuckooIndex(16)
    keys = [(5).to_bytes(8, "little") + (i | 1).to_bytes(2, "little") + i.to_bytes(30, "little") for i in range(600)]
    for k in keys:
        if index.find(k) is None:
            index.insert(k, [0, 1])
    assert all(index.find(k) is not None for k in keys)


def test_awkward_rows(spark):
    rows = awkward()
    df = documents(spark, rows)
    found = exact_dedup.deduplicate(df).collect()
    groups = defaultdict(list)
    for i, t, *_ in rows:
        groups[t or ""].append(i)
    assert len(found) == len(rows)
    for r in found:
        ids = groups[r["text"] or ""]
        keep = max((i for i in ids if i is not None), default=None)
        assert (r["keep_id"], r["group_size"], r["kept"]) == (keep, len(ids), r["doc_id"] == keep)
    assert exact_dedup.deduplicate(df.limit(0)).count() == 0
    stayed = exact_dedup.stage(spark, df, "").collect()
    assert sorted((r["text"] or "") for r in stayed) == sorted(groups) and stayed[0].__fields__ == df.columns


def test_columns_of_any_name_pass_through(spark):
    names = ["content_key", "__copy", "found", "key", "keep", "n"]
    df = spark.createDataFrame([(i, "x", *[7] * len(names)) for i in range(3)], "doc_id bigint, text string, " + ", ".join(f"{n} int" for n in names))
    assert all(r[n] == 7 for r in exact_dedup.deduplicate(df).collect() for n in names)
    assert [tuple(r) for r in exact_dedup.stage(spark, df, "").collect()] == [(2, "x", *[7] * len(names))]


def test_query(spark, small, duck, same_rows):
    same_rows(exact_dedup.query(spark, small), duck, exact_dedup.ORACLE)
