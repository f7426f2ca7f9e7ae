"""Reports, catalogues and readings of words against plain loops."""

from __future__ import annotations

import random
from itertools import product

from pyspark.sql import functions as F

from platterlens.functions import media, strings
from platterlens.operators import catalogues, glyphs, intervals


def score(text, fixed, words, english):
    total, i = 0, 0
    while i < len(text):
        if not (text[i].isalpha() or text[i] == "'"):
            i += 1
            continue
        j = i
        while j < len(text) and (text[j].isalpha() or text[j] == "'"):
            j += 1
        core = text[i:j].strip("'")
        settled = [c for c, f in zip(text[i:j], fixed[i:j]) if f and c.isalpha()]
        if core and english and core in ("I", "I'm", "I'll", "I've", "I'd"):
            total += 140
        elif core:
            base = core.split("'")[0]
            total += 100 * (len(base.encode()) > 1 and base.lower() in words) + 60 * (len(core.encode()) > 1 and core != base and core.lower() in words)
            shouted = len(settled) >= 2 and all(c.isupper() for c in settled)
            for k, c in enumerate(text[i:j]):
                if c.isalpha():
                    total += (25 if c.isupper() else -100) if shouted else -35 * (c.isupper() and k > 0)
        i = j
    return total


def read(slots, opening, words, english):
    n = 1
    for s in slots:
        n *= len(s)
    if n > 64:
        out = ""
        for i, s in enumerate(slots):
            big, small = [x for x in s if x[0].isupper()], [x for x in s if x[0].islower()]
            want = i == 0 and (opening or (english and len(slots) <= 2))
            out += s[0] if len(s) == 1 else ((big + small if want else small + big) or s)[0]
        return out
    best = None
    for picks in product(*[range(len(s)) for s in reversed(slots)]):
        chosen = [s[p] for s, p in zip(slots, reversed(picks))]
        text = "".join(chosen)
        fixed = [len(s) == 1 for s, c in zip(slots, chosen) for _ in c]
        value = score(text, fixed, words, english) + (45 if text[:1].isupper() else -45 if text[:1].islower() else 0) * opening
        if best is None or value > best[0]:
            best = (value, text)
    return best[1]


def line_of(words_in, words, english):
    out, opens = [], True
    letters = lambda t: "".join(c for c in t if c.isalpha())
    for slots, gaps in words_in:
        first = [s[0] for s in slots]
        core, cut, widest = letters("".join(first)), None, None
        if len(core.encode()) >= 4 and core.lower() not in words:
            for i, (gap, threshold) in enumerate(gaps):
                left, right = "".join(first[: i + 1]), "".join(first[i + 1 :])
                if threshold <= 0 or gap * 10 < threshold * 10 - 20 or left.endswith("'") or right.startswith("'"):
                    continue
                a, b = letters(left), letters(right)
                good = (a in ("I", "l", "a", "A") or (len(a.encode()) >= 2 and a.lower() in words)) and len(b.encode()) >= 2 and b.lower() in words
                if good and (widest is None or gap > widest):
                    cut, widest = i + 1, gap
        text = read(slots, opens, words, english) if cut is None else read(slots[:cut], opens, words, english) + " " + read(slots[cut:], False, words, english)
        opens = text.rstrip("\"')").endswith((".", "!", "?"))
        out.append(text)
    return " ".join(out)


def test_readings_of_lines(spark):
    draw = random.Random(4)
    known = ["just", "know", "that's", "low", "below", "life", "you", "well", "ill", "little", "paw", "nee"]
    lists = spark.createDataFrame([(w + "/AB",) for w in known] + [("12",), ("x",)], "line string")
    pool = [*known, "It", "I'm", "I'll", "LOW", "WELL", "Ijust", "lknow", "Illllllllx", "'ill'", "(LAUGHING)", "end.", "what?\"", "pawnee", "Éil", "…Il", "I", "l"]
    lines = []
    for k in range(60):
        words_in = []
        for _ in range(draw.randrange(1, 6)):
            word = draw.choice(pool) + draw.choice(["", "", "", ".", "!"])
            slots = [["l", "I"] if c in "lI" and draw.random() < 0.9 else [c] for c in word]
            words_in.append((slots, [(draw.choice([3, 8, 9, 12]), draw.choice([0, 10])) for _ in slots[1:]]))
        lines.append(words_in)
    df = spark.createDataFrame([(k, i, s, g) for k, ws in enumerate(lines) for i, (s, g) in enumerate(ws)], "line int, pos int, slots array<array<string>>, gaps array<struct<gap:int,threshold:int>>")
    for english in (True, False):
        words = {w for w in known if w.isalpha()} | (set(glyphs.COMMON) if english else set())
        got = {r["line"]: r["text"] for r in glyphs.resolve_lines(df, lists, english).collect()}
        assert got == {k: line_of(ws, words, english) for k, ws in enumerate(lines)}


def test_catalogues(spark):
    ids = spark.createDataFrame([("tmdb:5",), ("tv:a:b",), ("7",)], "id string")
    assert [tuple(r) for r in ids.select(catalogues.owner(F.col("id")), catalogues.own_id(F.col("id"), "tv")).collect()] == [("tmdb", None), ("tv", "a:b"), (None, "7")]
    episodes = spark.createDataFrame([("tv", 0, "tv:1", 1, 1), ("tmdb", 1, "tv:1", 1, 1), ("tmdb", 1, "9", 1, 1), ("tmdb", 1, "9", 1, 2), ("other", 2, "9", 1, 3)], "source string, source_rank int, work_id string, season int, number int")
    asked = spark.createDataFrame([("tv:1", 1), ("9", 1), ("none", 1)], "work_id string, season int")
    assert sorted((r["work_id"], r["source"], r["number"]) for r in catalogues.routed_episodes(asked, episodes).collect()) == [("9", "tmdb", 1), ("9", "tmdb", 2), ("tv:1", "tv", 1)]
    titles = spark.createDataFrame([(1, " A ", 2), (2, "B", None), (3, "C", None)], "disc int, title string, season int")
    left = catalogues.unverified(titles, titles.filter("disc = 3"), ["disc"])
    assert sorted(map(tuple, left.collect())) == [(1, "A", "series", 2), (2, "B", "movie", None)]


def test_strings(spark):
    rows = {"a%20b+c%zz%": "a b+c%zz%", "%C3%A9%41": "éA", "": ""}
    df = spark.createDataFrame([(k,) for k in rows], "s string")
    assert {r[0]: r[1] for r in df.select("s", strings.percent_decode(F.col("s"))).collect()} == rows
    entities = {"&lt;&#x41;&#233;&amp;lt;&#x1F600;&nbsp;&#0;& &amp": "<Aé&lt;\U0001f600&nbsp;&#0;& &amp", "a\nb&apos;&quot;&gt;": "a\nb'\">", "": "", "&#xD800;&#99999999;": "&#xD800;&#99999999;"}
    df = spark.createDataFrame([(k,) for k in entities], "s string")
    assert {r[0]: r[1] for r in df.select("s", strings.unescape_xml(F.col("s"))).collect()} == entities


def test_offsets_move_sound_both_ways(spark):
    run, sizes = bytes(range(1, 61)), [10, 0, 33, 17]
    starts = [sum(sizes[:i]) for i in range(len(sizes))]
    df = spark.createDataFrame([(run.hex().upper(), a, n) for a, n in zip(starts, sizes)], "run string, at long, size long")
    for shift in (0, 4, 24, 100, -4, -24, -100):
        padded = bytes(200) + run + bytes(200)
        want = [padded[200 + a + shift : 200 + a + shift + n] for a, n in zip(starts, sizes)]
        got = df.select(F.unhex(media.shifted(F.col("run"), F.col("at"), F.col("size"), shift)), media.silent(F.col("at"), F.col("size"), F.lit(60), shift)).collect()
        assert [(bytes(r[0]), r[1]) for r in got] == [(w, w.count(0)) for w in want]


def test_runs_of_a_state(spark):
    runs = spark.createDataFrame([(1, 0, 5, "Bad"), (1, 5, 9, "Untried"), (1, 9, 12, "Bad"), (2, 0, 4, "Finished")], "map int, start long, end long, state string")
    mine, first = intervals.in_state(runs, "Bad", ["map"])
    assert mine.count() == 2 and [tuple(r) for r in first.collect()] == [(1, 0, 5, "Bad")]
    assert {r["map"]: (r["done"], r["first_start"]) for r in intervals.report(runs, ["map"], 2048).collect()} == {1: (False, 5), 2: (True, None)}
