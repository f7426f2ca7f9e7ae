from __future__ import annotations

import hashlib
import random

import zstandard
from edge import awkward, documents

from pyspark.sql import functions as F

from platterlens.llm import suffix_dedup


def brute(rows):
    """Removed stretches of each row, by a table of where each window first starts."""
    data = [(i, (t or "").encode()) for i, t, *_ in rows]
    low = lambda i: -(1 << 63) if i is None else i
    first = {}
    for i, d in data:
        for k in range(len(d) - 49):
            w = d[k : k + 50]
            first[w] = min(first.get(w, low(i)), low(i))
    out = []
    for i, d in data:
        gone = bytearray(len(d))
        for k in range(len(d) - 49):
            if first[d[k : k + 50]] < low(i):
                gone[k : k + 50] = b"\1" * 50
        spans = [(k, gone.find(0, k) if gone.find(0, k) >= 0 else len(d)) for k in range(len(d)) if gone[k] and (k == 0 or not gone[k - 1])]
        out.append((i, len(d), spans, bytes(b for b, g in zip(d, gone) if not g)))
    return out


def same(spark, rows):
    found = suffix_dedup.deduplicate(documents(spark, rows).select("doc_id", "text")).collect()
    got = [(r["doc_id"], r["n_bytes"], [tuple(s) for s in r["spans"]], bytes(r["kept"])) for r in found]
    assert sorted(got, key=repr) == sorted(brute(rows), key=repr)


def test_awkward_rows(spark):
    same(spark, awkward())


def test_planted_passages(spark):
    draw = random.Random(9)
    letters = lambda n: "".join(draw.choice("ab cdé\n") for _ in range(n))
    shared = [letters(draw.choice([49, 50, 51, 60, 200])) for _ in range(12)] + ["a" * 120, "ab" * 40]
    rows = [(i, "".join(x for _ in range(draw.randrange(4)) for x in (letters(draw.randrange(80)), draw.choice(shared))), "en", "a") for i in range(120)]
    draw.shuffle(rows)
    same(spark, rows)


def test_common_marks_and_runs(spark, monkeypatch):
    draw = random.Random(1)
    phrase = "the one passage that stands in nearly every document of them all, word for word"
    rows = [(i, f"{draw.random()} {phrase} {draw.random()}" + " x" * (i % 3), "en", "a") for i in range(90)]
    monkeypatch.setattr(suffix_dedup, "HOT", 20)
    monkeypatch.setattr(suffix_dedup, "RUN", 50)
    same(spark, rows)
    monkeypatch.setattr(suffix_dedup, "SEND", 40)
    monkeypatch.setattr(suffix_dedup, "MARK_BYTES", 100)
    monkeypatch.setattr(suffix_dedup, "BUCKET_BYTES", 100)
    same(spark, awkward() + rows)


def test_a_long_text_of_common_marks_makes_many_runs(spark, monkeypatch):
    draw = random.Random(3)
    phrase = "the one passage that stands in nearly every document of them all, word for word"
    long = "".join(f"{phrase} {draw.randrange(50)} " for _ in range(200))
    rows = [(5, long, "en", "a"), *((i, f"{draw.random()} {phrase} {i}", "en", "a") for i in range(10, 20)), (2, f"{phrase} 7 {phrase}", "en", "a")]
    monkeypatch.setattr(suffix_dedup, "HOT", 3)
    monkeypatch.setattr(suffix_dedup, "RUN", 500)
    same(spark, rows)
    texts = documents(spark, rows).select("doc_id", "text").withColumn("h", F.xxhash64("text"))
    asked = suffix_dedup.mark_runs(texts, 16)
    marks = suffix_dedup.flagged_marks(asked, suffix_dedup.mark_answers(asked))
    runs = suffix_dedup.write_runs(texts.join(marks, "h").filter("doc_id = 5").select("doc_id", "h", "text", "marks"), 16)
    assert runs.select("run_id").distinct().count() > 10


def test_runs_hold_many_entries(spark):
    """Rows of runs are runs times buckets, so runs of few entries make them grow with the square of the input."""
    draw = random.Random(5)
    text = " ".join(f"{draw.randrange(10**6)}" for _ in range(200_000))
    texts = documents(spark, [(1, text, "en", "a"), (2, text + " and more", "en", "a")]).select("doc_id", "text").withColumn("h", F.xxhash64("text"))
    asked = suffix_dedup.mark_runs(texts, 16)
    marks = suffix_dedup.flagged_marks(asked, suffix_dedup.mark_answers(asked))
    runs = suffix_dedup.write_runs(texts.join(marks, "h").select("doc_id", "h", "text", "marks").coalesce(1), 16).collect()
    entries = sum(len(suffix_dedup.unpacked(zstandard.ZstdDecompressor().decompress(bytes(r["entries"])))[1]) for r in runs)
    assert entries > 90_000 and len(runs) <= 16 * 2


def test_near_contexts_of_an_anchor(spark, monkeypatch):
    """Entries of a group, laid beside one another or looked up window by window, give what brute force gives."""
    draw = random.Random(8)
    core = "the anchor of all of these lies somewhere within this passage of text"
    rows = [(draw.randrange(10**6), "".join(draw.choice("xy") for _ in range(60)) + core[: draw.randrange(55, 70)] + "".join(draw.choice("xy") for _ in range(9)), "en", "a") for _ in range(14)]
    texts = [(i, t[draw.randrange(55, 62) :] if k % 3 else t, *rest) for k, (i, t, *rest) in enumerate(rows)]
    for few in (1, 50):
        monkeypatch.setattr(suffix_dedup, "FEW", few)
        same(spark, texts + rows[:4])


def test_texts_without_marks_are_no_burden(spark, monkeypatch):
    monkeypatch.setattr(suffix_dedup, "NAMES", 5)
    same(spark, [(i, "short" * (i % 4), "en", "a") for i in range(40)] + awkward())


def test_front_coding_and_merge():
    draw = random.Random(7)
    runs = []
    for _ in range(13):
        entries = sorted(bytes(draw.choice(b"ab") for _ in range(draw.randrange(1, 20))) for _ in range(draw.randrange(1, 40)))
        assert suffix_dedup.unpacked(suffix_dedup.front_coded(entries))[1] == entries
        runs.append(suffix_dedup.unpacked(suffix_dedup.front_coded(entries)))
    got = list(suffix_dedup.merged(runs))
    assert [e for *_, e in got] == sorted(e for _, r in runs for e in r)
    before = b""
    for _, _, shared, entry in got:
        n = min(len(before), len(entry))
        want = next((i for i in range(n) if before[i] != entry[i]), n)
        assert shared == want
        before = entry


def test_empty(spark):
    assert suffix_dedup.deduplicate(documents(spark, awkward()).select("doc_id", "text").limit(0)).count() == 0


def test_query(spark, small):
    rows = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{small}/documents.parquet").collect()]
    want = {i: (n, sum(b - a for a, b in s), len(s), hashlib.sha256(k).hexdigest()) for i, n, s, k in brute(rows)}
    assert {r["doc_id"]: tuple(r)[1:] for r in suffix_dedup.query(spark, small).collect()} == want
