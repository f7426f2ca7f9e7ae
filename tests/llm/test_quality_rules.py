from __future__ import annotations

import re
from collections import Counter

from edge import awkward, documents

from platterlens.llm import quality_rules

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def counts(text):
    text = text or ""
    w = WORD.findall(text)
    runs = Counter(tuple(w[i : i + 5]) for i in range(len(w) - 4))
    repeated = {i + k for i in range(len(w) - 4) if runs[tuple(w[i : i + 5])] > 1 for k in range(5)}
    lines = [x for x in text.split("\n") if WORD.search(x)]
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(repeated)


def base_failed(n_words, n_repeat):
    return n_words < 10 or 100 * n_repeat > 20 * n_words


def verdict(text):
    """`kept`, rule by rule in plain loops, apart from the operator's own code."""
    import unicodedata

    lines, bad, short = (text or "").split("\n"), set(), []
    for i, line in [*enumerate(lines), (None, "an ending.")]:
        words = WORD.findall(line)
        if not words:
            continue
        if len(words) <= 4 and line.strip(" \t\r\x0b\x0c")[-1] not in ".!?:;,…。！？)]}\"'”’»":
            short.append(i)
        else:
            bad |= set(short) if len(short) >= 4 else set()
            short = []
        if i is None:
            break
        chars = "".join(words)
        bars = sum(c in "|»›•·" for c in line)
        noise = sum(c in "#*$%&|<>" for c in line)
        solid = sum(unicodedata.category(c)[0] in "LMN" for c in chars)
        letters = [c for c in line if unicodedata.category(c) in ("Lu", "Ll")]
        shouts = line.count("!") >= len(words) and letters and all(unicodedata.category(c) == "Lu" for c in letters)
        phrase = any(p in line.lower() for p in quality_rules.BOILERPLATE)
        if bars >= 2 and 3 * bars >= len(words) - bars or len(words) >= 3 and (3 * noise >= 2 * len(words) or 2 * solid < len(chars) or shouts):
            bad.add(i)
        if len(words) <= 6 and chars.endswith(("...", "…")) or len(words) <= 25 and phrase or lines[:i].count(line) >= 2:
            bad.add(i)
    n_words, n_chars, _, _, n_repeat = counts(text)
    lost = sum(len("".join(WORD.findall(lines[i]))) for i in bad)
    return not base_failed(n_words, n_repeat) and 2 * lost <= n_chars


EXTRA = [
    (100, "a b c d e f g h i j k l m n o p\n" * 3 + "a \x1c b c   d\x85e", "en", "a"), (101, "Home | News | About | Contact\n" + "Plain prose goes on for a good while in this one line here.\n" * 2, "en", "a"),
    (102, "Home | News\nMore | Less | Mid\n" * 9 + "short end", "en", "a"), (104, "Home\nAbout us\n\nNews\nImprint\n" + "Plain prose goes on for a good while in this one line here.", "en", "a"), (105, "Title\nOne line of prose that is long enough to stay, and then some.\nWait for it ...\n?!?! --- ((( )))\nDAS IST!! JA!! TOLL!!", "de", "a"),
    (106, "the same line again\n" * 4 + "and ten more words follow here so that it has enough", "en", "a"), (107, "Menu one\nMenu two\nMenu three\nMenu four\nMenu five\nMenu six seven\nshort end", "en", "a"), (103, "x y z a b c d e f g h i j k l m n o p q r s t u v w " * 2, "en", "a"),
]


def test_counts_and_verdicts(spark):
    rows = awkward() + EXTRA
    df = documents(spark, rows)
    judged = quality_rules.clean(df)
    assert set(df.columns) < set(judged.columns)
    for r in judged.collect():
        q = r["quality"]
        assert (q["n_words"], q["word_chars"], q["n_symbols"], q["n_dup_lines"], q["n_repeat_words"]) == counts(r["text"])
        assert q["base_failed"] == base_failed(q["n_words"], q["n_repeat_words"])
        assert q["kept"] == verdict(r["text"])
    by_id = {r["doc_id"]: r["quality"] for r in judged.collect()}
    assert by_id[101]["kept"] is False or by_id[101]["n_lines_removed"] == 1
    assert by_id[102]["kept"] is False
    assert quality_rules.clean(df.limit(0)).count() == 0


def test_stage_removes_lines_and_documents(spark):
    prose = "Every word of this sentence differs from all others so that nothing repeats within it at any point."
    df = documents(spark, [(1, f"Home | News | About | Contact\n{prose}", "en", "a"), (2, prose, "en", "a"), (3, "too short", "en", "a"), (4, None, None, None), (5, "\n".join(["Home | News | About | Contact | Imprint"] + [f"A{i} | B{i} | C{i}" for i in range(9)]), "en", "a")])
    kept = {r["doc_id"]: r for r in quality_rules.stage(spark, df, "").collect()}
    assert {i: (r["text"], r["n_chars"]) for i, r in kept.items()} == {1: (prose, len(prose)), 2: (prose, len(prose))}


def test_query(spark, small):
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{small}/documents.parquet").collect()}
    found = quality_rules.query(spark, small).collect()
    assert len(found) == len(texts)
    for r in found:
        assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"]) == counts(texts[r["doc_id"]])
        assert r["base_failed"] == base_failed(r["n_words"], r["n_repeat_words"])
        assert r["kept"] == verdict(texts[r["doc_id"]])


def test_clean_documents_stay(spark, larger):
    labels = spark.read.parquet(f"{larger}/labels.parquet")
    found = quality_rules.query(spark, larger).join(labels, "doc_id")
    good = found.filter("quality = 1 and not base_failed")
    assert good.filter("kept").count() >= 0.98 * good.count()


def test_query_is_its_sql(spark, small, duck, same_rows):
    same_rows(quality_rules.query(spark, small), duck, quality_rules.ORACLE)
