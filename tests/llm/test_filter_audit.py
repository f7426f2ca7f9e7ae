"""The audit against filters that are applied one after the other, by plain loops."""

from __future__ import annotations

import random
import re
from itertools import permutations

from edge import awkward, documents, words

from platterlens.llm import filter_audit

KEYS = ("kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost")


def _fails(rows: list[tuple], i: int) -> str:
    doc_id, text, *_ = rows[i]
    text = text or ""
    told = re.findall(r"[^\x20\x09-\x0D]+", text)
    out = "A" * (len(told) < 100) + "B" * (100 * len(set(told)) < 80 * len(told)) + "C" * (100 * sum("A" <= c <= "Z" for c in text) > 10 * len(text)) + "D" * any(c in "#$%&*|" for c in text)
    return out + "E" * (doc_id is not None and any(j is not None and j < doc_id and (t or "") == text for j, t, *_ in rows))


def _expected(rows: list[tuple], labels: list[tuple]) -> dict:
    good, toxic = {i for i, q, _ in labels if q == 1 and i is not None}, {i for i, _, t in labels if t == 1 and i is not None}
    fails, out = [_fails(rows, i) for i in range(len(rows))], {}
    for part in {lang or "" for _, _, lang, _ in rows}:
        mine = [i for i, r in enumerate(rows) if (r[2] or "") == part]
        totals = dict.fromkeys("ABCDE", 0)
        for order in map("".join, permutations("ABCDE")):
            left = mine
            for step, x in enumerate(order, 1):
                gone = [i for i in left if x in fails[i]]
                lost = [i for i in mine if x in fails[i] and i not in left]
                left = [i for i in left if x not in fails[i]]
                totals[x] += len(gone)
                out[part, order, step] = (len(left), len(gone), len(lost), sum(fails[i] == x for i in mine), sum(rows[i][0] in good for i in gone), sum(rows[i][0] in toxic for i in gone))
        for order in map("".join, permutations("ABCDE")):
            for step, x in enumerate(order, 1):
                out[part, order, step] += (totals[x],)
    return out


def _found(spark, rows, labels) -> dict:
    marks = spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int")
    return {(r["part"], r["filter_order"], r["step"]): tuple(r[k] for k in (*KEYS, "shapley")) for r in filter_audit.audit(documents(spark, rows), marks).collect()}


def test_against_filters_in_turn(spark):
    draw = random.Random(3)
    kinds = [words(draw, 150), words(draw, 20), "SHOUT " + words(draw, 5).upper(), "a & b " * 60, words(draw, 130) + " #tag", "x", "Ünïcode ÀÈ " * 40, "A" + "b" * 9, "AA" + "b" * 18, "A" + "b" * 8]
    rows = [*awkward(), *((100 + i, draw.choice(kinds), draw.choice(["en", "", None, "fr"]), "s") for i in range(60)), *((-100 - i, draw.choice(kinds), "en", "s") for i in range(10))]
    labels = [(i, draw.choice([0, 1, None]), draw.choice([0, 1])) for i in [*range(100, 160), 105, 105, 1, 2, 9999, None]]
    assert _found(spark, rows, labels) == _expected(rows, labels)


def test_no_rows(spark):
    assert _found(spark, [], [(1, 1, 1)]) == {}
    assert _found(spark, [(1, None, None, None)], []) == _expected([(1, None, None, None)], [])


def test_sums_are_inverted_exactly(spark):
    draw = random.Random(8)
    cells = [draw.randrange(1 << 40) for _ in range(32)]
    sums = [sum(-c if bin(k & m).count("1") % 2 else c for m, c in enumerate(cells)) for k in range(32)]
    df = spark.createDataFrame([("p", "all", sums)], "part string, label string, sums array<bigint>")
    row = filter_audit.cells(df).first()
    assert row["all"] == cells and row["good"] == [0] * 32


def test_query(spark, small, duck, same_rows):
    same_rows(filter_audit.query(spark, small), duck, filter_audit.ORACLE)
