"""Base spans against the plain patterns, the estimate against planted reliabilities, and the whole on planted texts."""

from __future__ import annotations

import random
import re
from hashlib import sha256

import numpy as np
from edge import awkward, documents, words

from platterlens.llm import pii
from platterlens.llm.common import written

#: The patterns as the operator's contract states them.
PLAIN = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def _holds(kind: str, span: str) -> bool:
    digits = re.sub("[^0-9]", "", span)
    if kind == "ip":
        return all(int(x) <= 255 for x in span.split("."))
    if kind == "card":
        total = sum(int(d) if i % 2 == 0 else sum(divmod(2 * int(d), 10)) for i, d in enumerate(reversed(digits)))
        return 13 <= len(digits) <= 19 and total % 10 == 0
    return kind == "email" or 9 <= len(digits) <= 15


def _base(text: str) -> list[tuple[str, int, int]]:
    return [(kind, *m.span()) for kind, p in PLAIN.items() for m in re.finditer(p, text) if _holds(kind, m[0])]


def _told(text: str) -> list[tuple[str, int, int]]:
    return [(pii.KINDS[c[0]], c[1], c[2]) for c in pii.candidates_in(text) if c[3]]


def test_base_spans_of_hostile_texts():
    draw = random.Random(5)
    alphabets = ["a@.", "1.", "1 -", "+1 ().-", "a1@.-+ _é", "0123456789 -.+@x()"]
    for n in range(6000):
        text = "".join(draw.choice(alphabets[n % len(alphabets)]) for _ in range(draw.randrange(60)))
        assert _told(text) == _base(text), text
    cards = "4111 1111 1111 1111, 4111-1111-1111-1112, x4111111111111111y, ١٢٣ ²"
    assert _told(cards) == _base(cards) and len(_base(cards)) == 2


def test_long_runs_take_no_more_than_their_length():
    for text in ("a" * 2_000_000, "1" * 2_000_000, "a@" * 500_000, "1." * 500_000, "+1 " * 500_000, "9 " * 1_000_000, "(" * 2_000_000, "+" + "1" * 10_000):
        pii.candidates_in(text)


def test_reliabilities_are_found():
    draw = np.random.default_rng(2)
    real = draw.random(40_000) < 0.3
    right = [0.95, 0.8, 0.7, 0.9]
    votes = np.stack([np.where(draw.random(len(real)) < 0.2, pii.ABSTAIN, np.where((draw.random(len(real)) < p) == real, pii.FOR, pii.AGAINST)) for p in right], 1)
    counts: dict = {}
    for row in votes:
        code = int(row @ [27, 9, 3, 1])
        counts[pii.CARD, code] = counts.get((pii.CARD, code), 0) + 1
    shares, table = pii.reliabilities(counts)
    assert abs(shares[pii.CARD] - 0.3) < 0.02 and shares[pii.IP] == 0.5
    for j, p in enumerate(right):
        assert abs(table[j, 1, 0] - p) < 0.03 and abs(table[j, 0, 1] - p) < 0.03
    assert pii.votes_of(int(votes[7] @ [27, 9, 3, 1])) == votes[7].tolist()


def _card(draw: random.Random) -> str:
    head = "4" + "".join(str(draw.randrange(10)) for _ in range(14))
    return next(head + str(d) for d in range(10) if pii.luhn(head + str(d)))


def _planted(n: int) -> list[tuple]:
    """Texts that hold base spans, wide forms that are personal, or what only looks like it."""
    draw, rows = random.Random(9), []
    for i in range(n):
        host, card = f"{draw.choice(['mail', 'web'])}{i}.example.com", _card(draw)
        phone = f"{draw.randrange(200, 999)}-555-{draw.randrange(1000, 9999)}"
        wrong = card[:-1] + str((int(card[-1]) + 1) % 10)
        kinds = [
            (f"please contact jo.{i}@{host} today", None), (f"server address {draw.randrange(1, 220)}.{draw.randrange(1, 256)}.7.9 was up", None), (f"she paid by visa card {card} then", None), (f"call +1 ({phone[:3]}) 555-{phone[-4:]} now", None),
            (f"write to ann.{i} (at) {host.replace('.', ' (dot) ')} please", "email"), (f"telephone {phone} after six", "phone"), (f"visa card {card[:4]}.{card[4:8]}.{card[8:12]}.{card[12:]} it was", "card"),
            (f"call me at +1 ({phone[:3]}) 555-{phone[-4:]}.77771234567 then", "phone"), (f"invoice serial order {wrong} shipped", ""), (f"version build 300.{i}.400.1 is out", ""), (f"order ref {phone} of part", ""),
        ]
        text, more = kinds[i % len(kinds)]
        rows.append((i, f"{words(draw, 6)} {text} {words(draw, 6)}", more))
    return rows


def test_planted_spans_are_added_and_others_are_not(spark):
    rows = _planted(1500)
    found = written(pii.candidates(documents(spark, [(i, t, "en", "s") for i, t, _ in rows])), "test-candidates")
    model = pii.fit(found)
    told = {r["doc_id"]: r for r in pii.judged(found, model).collect()}
    for i, text, more in rows:
        spans = [s.split(":")[0] for s in told[i]["spans"].split(",") if s]
        own = _base(text)
        assert len(spans) == len(own) + bool(more) and (not more or more in spans), (text, told[i]["spans"])
        assert told[i]["base_sha256"] == sha256(",".join(f"{k}:{s}:{e}" for k, s, e in own).encode()).hexdigest()
        assert [told[i][f"n_{k}"] for k in pii.KINDS] == [sum(k == x for x, *_ in own) for k in pii.KINDS]
    again = {r["doc_id"]: r["spans"] for r in pii.judged(found, pii.fit(found)).collect()}
    assert again == {i: r["spans"] for i, r in told.items()}


def test_awkward_rows_and_redaction(spark):
    rows = [*awkward(), (50, "é +1 (184) 555-7766 & me@x.org, me@x.org", "en", "a"), (50, None, "en", "a"), (51, "id 4111111111111111", None, None)]
    df = documents(spark, rows)
    found = written(pii.candidates(df), "test-candidates")
    model = pii.fit(found)
    expected = sorted((str(i), [f"{k}:{s}:{e}" for k, s, e in _base(t or "")]) for i, t, *_ in rows)
    assert sorted((str(r["doc_id"]), [s for s in r["spans"].split(",") if s]) for r in pii.judged(found, model).collect()) == expected
    scrubbed = pii.scrub(df.withColumnRenamed("kept", "redacted"), model)
    out = {(r["doc_id"], r["text"]): r for r in scrubbed.collect()}
    assert out[50, rows[-3][1]]["redacted"] == "é [PHONE] & [EMAIL], [EMAIL]" and out[50, None]["redacted"] is None and out[51, rows[-1][1]]["redacted"] == "id [CARD]"
    assert all(r["redacted"] == r["text"] and r["group"] == "z" for k, r in out.items() if not r["spans"])
    assert pii.judged(found.limit(0), pii.fit(found.limit(0))).count() == 0


def test_query_on_all_documents(spark, small):
    docs = {r["doc_id"]: r["text"] or "" for r in spark.read.parquet(f"{small}/documents.parquet").collect()}
    rows = pii.query(spark, small).collect()
    assert len(rows) == len(docs)
    for r in rows:
        own = _base(docs[r["doc_id"]])
        spans = r["spans"].split(",") if r["spans"] else []
        assert {f"{k}:{s}:{e}" for k, s, e in own} <= {*spans}
        assert r["base_sha256"] == sha256(",".join(f"{k}:{s}:{e}" for k, s, e in own).encode()).hexdigest()
