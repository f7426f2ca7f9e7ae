"""The two classifiers, by held-out rows, gradients and defined cases."""

from __future__ import annotations

import unicodedata

import numpy as np
from edge import awkward, documents

from platterlens.llm import language_id, quality_mil
from platterlens.llm.common import mixed


def test_quality_on_held_out_rows(spark, larger):
    labels = spark.read.parquet(f"{larger}/labels.parquet").select("doc_id", "quality")
    found = quality_mil.query(spark, larger).join(labels, "doc_id").filter("held_out").collect()
    good, bad = [r["score"] for r in found if r["quality"] == 1], [r["score"] for r in found if r["quality"] == 0]
    auc = np.mean([[(g > b) + (g == b) / 2 for b in bad] for g in good])
    right = np.mean([r["predicted"] == r["quality"] for r in found])
    assert auc > 0.9 and right > 0.85
    assert all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.7) for r in found)


def test_scores_by_a_plain_loop_over_passages():
    """passages() and forward() of many texts at once against one word, passage and text at a time."""
    texts = [t or "" for _, t, *_ in awkward()] + ["A a a! ### 12 (x) naïve", "one " * 250]
    x, sizes = quality_mil.passages(texts)
    draw, at = np.random.default_rng(3), 0
    p = {k: draw.normal(size=n) * 0.3 for k, n in {"E": (quality_mil.WIDTH, 4), "e": 4, "V": (4, 3), "U": (4, 3), "w": 3, "o": 4, "b": 1}.items()}
    scores = quality_mil.forward(p, x.astype(float), np.cumsum(sizes) - sizes)["y"]
    kind = lambda c: int(quality_mil.KINDS[c])
    for text, n, score in zip(texts, sizes, scores):
        words = text.encode().split()
        parts = [words[i : i + 100] for i in range(0, len(words), 100)] or [[]]
        assert n == len(parts)
        top, bottom = np.zeros(4), 0.0
        for k, part in enumerate(parts):
            row = x[at + k]
            if part:
                chars = b"".join(part)
                assert np.allclose(row[:8], [sum(kind(c) == j for c in chars) / len(chars) for j in range(8)], atol=1e-6)
                before = [words[k * 100 - 1] if k else None, *part[:-1]]
                want = [sum(map(len, part)) / 10, sum(kind(w[0]) == 1 for w in part), sum(kind(w[-1]) == 4 for w in part), sum(kind(w[-1]) == 6 for w in part), sum(a == b for a, b in zip(before, part)), len(set(part))]
                assert np.allclose(row[8:14], np.array(want) / len(part), atol=1e-6)
                assert np.isclose((row[14 : 14 + quality_mil.HASHED] ** 2).sum(), 1, atol=1e-5) and np.isclose((row[14 + quality_mil.HASHED :] ** 2).sum(), 1, atol=1e-5)
            else:
                assert not row.any()
            h = np.tanh(row @ p["E"] + p["e"])
            weight = np.exp(sum(w * np.tanh(h @ v) / (1 + np.exp(-(h @ u))) for w, v, u in zip(p["w"], p["V"].T, p["U"].T)))
            top, bottom = top + weight * h, bottom + weight
        at += n
        assert np.isclose(score, 1 / (1 + np.exp(-(top / bottom @ p["o"] + p["b"][0]))), atol=1e-6)


def test_gradients_are_those_of_the_loss():
    draw = np.random.default_rng(1)
    p = {"E": draw.normal(size=(quality_mil.WIDTH, 3)) * 0.2, "e": draw.normal(size=3), "V": draw.normal(size=(3, 2)), "U": draw.normal(size=(3, 2)), "w": draw.normal(size=2), "o": draw.normal(size=3), "b": draw.normal(size=1)}
    x, starts, y = draw.normal(size=(7, quality_mil.WIDTH)), np.array([0, 2, 3]), np.array([1.0, 0.0, 1.0])

    def loss():
        s = quality_mil.forward(p, x, starts)["y"]
        return -(y * np.log(s) + (1 - y) * np.log(1 - s)).mean()

    for name, g in quality_mil.gradients(p, x, starts, y).items():
        at = tuple(n // 2 for n in p[name].shape)
        old, h = p[name][at], 1e-5
        p[name][at] = old + h
        up = loss()
        p[name][at] = old - h
        down = loss()
        p[name][at] = old
        assert abs((up - down) / (2 * h) - g[at]) < 1e-6


def test_quality_of_awkward_rows(spark):
    df = documents(spark, awkward())
    model = quality_mil.fit(spark.createDataFrame([(i, t, 1 if i % 2 else 0) for i, t in enumerate(["fine words here", "### $$$ %%%", None, "more fine words", ""] * 4)], "doc_id int, text string, quality int"))
    scored = quality_mil.score(df, model).collect()
    assert len(scored) == len(awkward()) and all(0 <= r["score"] <= 1 and abs(sum(r["attention"]) - 1) < 1e-3 for r in scored)
    same = {}
    for r in scored:
        assert same.setdefault(r["text"] or "", r["score"]) == r["score"]
    assert max(len(r["attention"]) for r in scored) >= 300
    assert quality_mil.fit(spark.createDataFrame([(1, "a", 1)], "doc_id int, text string, quality int")) == {"constant": 1.0}
    assert quality_mil.fit(spark.createDataFrame([], "doc_id int, text string, quality int")) == {"constant": 0.5}
    assert quality_mil.score(df.limit(0), model).count() == 0


def test_language_on_held_out_rows(spark, larger):
    docs = spark.read.parquet(f"{larger}/documents.parquet").select("doc_id", "lang")
    found = language_id.query(spark, larger).join(docs, "doc_id").filter("held_out and lang is not null and lang_pred <> 'und'").collect()
    assert np.mean([r["lang_pred"] == r["lang"] for r in found]) > 0.97
    assert abs(np.mean([r["score"] for r in found]) - np.mean([r["lang_pred"] == r["lang"] for r in found])) < 0.05


def test_language_of_awkward_rows(spark):
    df = documents(spark, awkward())
    model = language_id.fit(spark.createDataFrame([(i, t, l) for i, (t, l) in enumerate([("the cat and the dog", "en"), ("der Hund und die Katze", "de"), (None, "en"), ("123", "de"), ("no label", None)] * 8)], "doc_id int, text string, lang string"))
    assert model["languages"] == ["de", "en"]
    got = language_id.predict(df, model).collect()
    assert len(got) == len(awkward())
    for r in got:
        no_letter = not any(c.isalpha() for c in r["text"] or "")
        assert (r["lang_pred"] == "und") == no_letter and 0 <= r["score"] <= 1
    empty = language_id.fit(spark.createDataFrame([], "doc_id int, text string, lang string"))
    assert {r["lang_pred"] for r in language_id.predict(df, empty).collect()} == {"und"}
    assert language_id.predict(df.limit(0), model).count() == 0


def test_penalty_leaves_weights_zero(spark, larger):
    docs = spark.read.parquet(f"{larger}/documents.parquet")
    assert np.mean(language_id.fit(docs.select("doc_id", "text", "lang"))["weights"] == 0) > 0.5


def test_samples_are_the_smallest_hashes(spark):
    from pyspark.sql import functions as F

    from platterlens.llm.common import smallest

    rows = spark.range(50_000).select("id", F.xxhash64("id").alias("h"))
    want = sorted(r["h"] for r in rows.collect())
    for n in (10, 700, 60_000):
        assert sorted(r["h"] for r in smallest(rows, "h", n).collect()) == want[:n]
    assert smallest(rows.limit(0), "h", 5).count() == 0


def test_language_sample_keeps_rare_languages_and_folds_copies(spark):
    rows = [(i, f"the cat {i} and the dog in house {chr(97 + i % 26)}{chr(97 + i // 26 % 26)}{chr(97 + i // 676)}", "en") for i in range(2000)]
    rows += [(i, "one text that a third of all rows repeat", "en") for i in range(2000, 3000)] + [(3000, "кошка и собака", "ru"), (3001, "собака и дом", "ru")]
    docs = spark.createDataFrame(rows, "doc_id int, text string, lang string")
    assert language_id.fit(docs, most=100)["languages"] == ["en", "ru"]
    hashed = docs.select("text", "lang", language_id.F.xxhash64("lang", "text").alias("__h"))
    sample, each = language_id.drawn(hashed, 100)
    found = [(r["lang"], r["text"]) for r in sample.collect()]
    assert each == 60 and len(found) == len(set(found)) and each <= len(found) - 2 <= each + 12 * each**0.5 + 12
    assert sum(lang == "ru" for lang, _ in found) == 2


def test_language_idf_covers_all_texts(spark):
    texts = [f"word {chr(97 + i % 26)}{chr(97 + i // 26 % 26)} of many" for i in range(600)] + ["123", None]
    docs = spark.createDataFrame([(i, t, "en" if i % 2 else None) for i, t in enumerate(texts)], "doc_id int, text string, lang string").repartition(5)
    df = np.zeros(language_id.FEATURES)
    for t in texts[:600]:
        df[language_id.counts(t)[0]] += 1
    assert np.allclose(language_id.fit(docs, most=100)["idf"], np.log(601 / (1 + df)) + 1)


def test_ftrl_by_dense_steps():
    """The sparse learner against the same method over whole vectors, one coordinate at a time."""
    from math import exp, sqrt

    draw = np.random.default_rng(2)
    rows = [(np.sort(draw.choice(12, 4, replace=False)), draw.random(4)) for _ in range(25)]
    labels = draw.integers(0, 3, 25)
    got = language_id.ftrl(rows, labels, 3, seed=9)[:12]
    z, n = [[0.0] * 3 for _ in range(12)], [[0.0] * 3 for _ in range(12)]

    def weight(i, c):
        if abs(z[i][c]) <= language_id.L1:
            return 0.0
        return -(z[i][c] - (1 if z[i][c] > 0 else -1) * language_id.L1) / ((language_id.BETA + sqrt(n[i][c])) / language_id.ALPHA + language_id.L2)

    order = np.random.default_rng(9)
    for _ in range(language_id.EPOCHS):
        for r in order.permutation(25):
            x = dict(zip(rows[r][0].tolist(), rows[r][1].tolist()))
            w = {i: [weight(i, c) for c in range(3)] for i in x}
            scores = [sum(x[i] * w[i][c] for i in x) for c in range(3)]
            total = sum(exp(s) for s in scores)
            for i in x:
                for c in range(3):
                    g = x[i] * (exp(scores[c]) / total - (labels[r] == c))
                    step = (sqrt(n[i][c] + g * g) - sqrt(n[i][c])) / language_id.ALPHA
                    z[i][c] += g - step * w[i][c]
                    n[i][c] += g * g
    assert np.allclose(got, [[weight(i, c) for c in range(3)] for i in range(12)], atol=1e-9) and (got != 0).any()


def test_predictions_by_dense_products(spark):
    docs = spark.createDataFrame([(i, t, l) for i, (t, l) in enumerate([("the cat and the dog", "en"), ("der Hund und die Katze", "de"), ("le chat et le chien", "fr")] * 9)], "doc_id int, text string, lang string")
    m = language_id.fit(docs)
    for r in language_id.predict(docs.limit(5), m).collect():
        dense = np.zeros(language_id.FEATURES)
        for slot, n in zip(*language_id.counts(r["text"])):
            dense[slot] = n * m["idf"][slot]
        scores = dense / np.sqrt((dense**2).sum()) @ m["weights"] / m["temperature"]
        p = np.exp(scores - scores.max()) / np.exp(scores - scores.max()).sum()
        assert r["lang_pred"] == m["languages"][int(p.argmax())] and abs(r["score"] - p.max()) < 1e-5


def test_words_are_read_whole():
    url = "https://example.com/a/long/path/to/"
    pairs = [(url + "one", url + "two"), ("漢字仮名交じりの長い文章の始まり" + "山", "漢字仮名交じりの長い文章の始まり" + "川"), ("ab1" * 20 + "x", "ab1" * 20 + "!")]
    for a, b in pairs:
        assert not np.array_equal(quality_mil.passages([a + " x"])[0], quality_mil.passages([b + " x"])[0])


def test_the_fit_takes_so_many_passages_of_a_text():
    bag = np.arange(1000.0).reshape(500, 2)
    some = quality_mil.taken(bag, -7)
    assert some.shape == (quality_mil.BAG, 2) and (np.diff(some[:, 0]) > 0).all() and np.array_equal(some, quality_mil.taken(bag, -7))
    assert not np.array_equal(some, quality_mil.taken(bag, 8)) and quality_mil.taken(bag[:5], 1) is not None and len(quality_mil.taken(bag[:5], 1)) == 5


def test_combining_marks_count(spark):
    assert not np.array_equal(language_id.counts("कि")[0], language_id.counts("का")[0])
    told = {
        "hi": "हिन्दी भाषा में लिखा हुआ एक छोटा सा वाक्य यहाँ है", "mr": "मराठी भाषेत लिहिलेले एक छोटेसे वाक्य येथे आहे", "th": "ภาษาไทยเป็นภาษาที่มีวรรณยุกต์และสระหลายรูป",
        "ta": "தமிழ் மொழியில் எழுதப்பட்ட ஒரு சிறிய வாக்கியம் இது", "ar": "هَذِهِ جُمْلَةٌ قَصِيرَةٌ مَكْتُوبَةٌ بِاللُّغَةِ الْعَرَبِيَّةِ",
    }
    rows = [(i, " ".join(text.split()[k:] + text.split()[:k]), lang) for i, (lang, text, k) in enumerate((x, t, k) for x, t in told.items() for k in range(4))]
    model = language_id.fit(spark.createDataFrame(rows, "doc_id int, text string, lang string"))
    new = [("hi", "यह हिन्दी में है"), ("mr", "हे मराठीत आहे"), ("th", "ไทย ภาษา"), ("ta", "இது தமிழ்"), ("ar", "جُمْلَةٌ بِالْعَرَبِيَّةِ")]
    got = language_id.predict(spark.createDataFrame([(i, t, x) for i, (x, t) in enumerate(new)], "doc_id int, text string, lang string"), model).collect()
    assert [r["lang_pred"] for r in got] == [r["lang"] for r in got]


def test_profiles_of_many_texts_are_those_of_each(monkeypatch):
    texts = [t or "" for _, t, *_ in awkward()] + ["", "1 2", "हिन्दी भाषा", "--a--b--", "İx", "\u0301", "\u0301 x"]
    monkeypatch.setattr(language_id, "BLOCK", 997)
    bounds, slots, n = language_id.profiles(texts)
    monkeypatch.undo()
    for i, t in enumerate(texts):
        own = {}
        if any(unicodedata.category(c)[0] == "L" for c in t):
            clean = "".join(c if unicodedata.category(c)[0] in "LM" else " " for c in t.lower())
            padded = " " + " ".join(clean.split()) + " "
            for size in (1, 2, 3):
                for k in range(size == 1, len(padded) - size + 1 - (size == 1)):
                    code = 0
                    for c in padded[k : k + size]:
                        code = (code << 21) + ord(c)
                    slot = int(mixed(np.array([code & (1 << 64) - 1], np.uint64) * np.uint64(3) + np.uint64(size - 1))[0]) & language_id.FEATURES - 1
                    own[slot] = own.get(slot, 0) + 1
        assert dict(zip(slots[bounds[i] : bounds[i + 1]].tolist(), n[bounds[i] : bounds[i + 1]].tolist())) == own
