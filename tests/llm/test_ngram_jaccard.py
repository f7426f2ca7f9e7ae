from __future__ import annotations

import random

from edge import awkward, documents, words

from platterlens.llm import ngram_jaccard


def shingles(text, k):
    w = (text or "").encode().lower().split()
    return {tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else ({tuple(w)} if w else set())


def brute(rows, k, num, den):
    sets = [shingles(t, k) for _, t, *_ in rows]
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in range(len(rows)):
        for b in range(a):
            both = len(sets[a] & sets[b])
            if both and den * both >= num * (len(sets[a]) + len(sets[b]) - both):
                root[max(find(a), find(b))] = min(find(a), find(b))
    low = lambda i: -(1 << 63) if i is None else i
    least = {}
    for x, (i, *_) in enumerate(rows):
        r = find(x)
        least[r] = min(least.get(r, low(i)), low(i))
    return sorted(((i, len(s), None if least[find(x)] == -(1 << 63) else least[find(x)]) for x, ((i, *_), s) in enumerate(zip(rows, sets))), key=repr)


def same(spark, rows, k, num, den):
    found = ngram_jaccard.grouped(documents(spark, rows), k, num, den).collect()
    assert sorted(((r["doc_id"], r["n"], r["component_id"]) for r in found), key=repr) == brute(rows, k, num, den)


def test_awkward_rows(spark):
    rows = [r for r in awkward() if r[0] != 13]  # rows that repeat an id hold one text here; others are below
    same(spark, rows, 3, 90, 100)
    assert ngram_jaccard.grouped(documents(spark, rows).limit(0), 3, 90, 100).count() == 0


def edited(draw, text, changes):
    w = text.split()
    for _ in range(changes):
        at = draw.randrange(len(w))
        w[at : at + draw.randrange(2)] = [f"new{draw.randrange(9999)}"] * draw.randrange(1, 2)
    return " ".join(w)


def test_near_copies_at_every_distance(spark):
    draw, rows = random.Random(8), []
    for size in (4, 12, 40, 150, 600):
        for _ in range(4):
            base = words(draw, size)
            rows += [(len(rows) + i, edited(draw, base, c), "en", "a") for i, c in enumerate([0, 0, 1, 1, 2, 3, 5, 9, 20])]
    draw.shuffle(rows)
    same(spark, rows, 3, 90, 100)
    same(spark, rows, 5, 80, 100)


def test_chains_and_one_large_group(spark):
    draw = random.Random(3)
    base = words(draw, 80)
    rows = [(1000 - i, edited(draw, base, 1), "en", "a") for i in range(150)]
    chain = words(draw, 200)
    for i in range(40):
        rows.append((2000 + i, chain, "en", "b"))
        chain = edited(draw, chain, 2)
    same(spark, rows, 3, 90, 100)


def test_signature_bounds_overlap():
    import numpy as np

    draw = np.random.default_rng(2)
    for _ in range(200):
        a, b = (np.unique(draw.integers(0, 4000, draw.integers(1, 900))).astype(np.uint64) for _ in range(2))
        sa, sb = (np.frombuffer(ngram_jaccard.signature(x), np.uint8) for x in (a, b))
        width = min(len(sa), len(sb))
        sa, sb = (ngram_jaccard._folded(x, width) for x in (sa, sb))
        assert len(a) - int(np.bitwise_count(sa & ~sb).sum()) >= len(np.intersect1d(a, b))


def test_linked_sets_meet_in_a_tile():
    """Sets at and above the threshold, of all sizes and differences, share a tile; sets far below it hardly ever do."""
    import numpy as np

    draw, met, far = np.random.default_rng(5), 0, 0
    for num, den in ((90, 100), (80, 100)):
        for _ in range(1500):
            n = int(draw.choice([3, 5, 8, 12, 20, 45, 100, 330, 1500]))
            x = np.unique(draw.integers(0, 1 << 64, n, dtype=np.uint64))
            lost = int(draw.integers(0, max(1, n // 5) + 1))
            new = np.unique(draw.integers(0, 1 << 64, int(draw.integers(0, max(1, n // 4) + 1)), dtype=np.uint64))
            y = np.union1d(draw.permutation(x)[lost:], new)
            both = len(np.intersect1d(x, y))
            if not len(y) or (len(x) == len(y) == both):
                continue
            meet = bool(set(ngram_jaccard.range_tokens(x, num, den)) & set(ngram_jaccard.range_tokens(y, num, den)))
            if den * both >= num * (len(x) + len(y) - both):
                assert meet
                met += 1
        for _ in range(200):
            x, y = (np.unique(draw.integers(0, 1 << 64, 300, dtype=np.uint64)) for _ in range(2))
            far += bool(set(ngram_jaccard.range_tokens(x, num, den)) & set(ngram_jaccard.range_tokens(y, num, den)))
    assert met > 700 and far == 0


def test_large_tiles_meet_chunk_by_chunk(spark, monkeypatch):
    monkeypatch.setattr(ngram_jaccard, "CELL", 4)
    monkeypatch.setattr(ngram_jaccard, "CHUNK", 3)
    draw = random.Random(12)
    base = words(draw, 60)
    rows = [(i, edited(draw, base, draw.choice([1, 2, 3, 4, 6])), "en", "a") for i in range(90)]
    same(spark, rows, 3, 90, 100)


def test_stage_keeps_one_of_each_group(spark):
    draw = random.Random(5)
    base = words(draw, 100)
    rows = [(3, base, "en", "a"), (2, edited(draw, base, 1), "en", "a"), (9, words(draw, 100), "en", "a"), (13, "x y", "en", "a"), (13, "z w", "en", "a"), (4, None, None, None), (None, "n", None, None)]
    kept = ngram_jaccard.stage(spark, documents(spark, rows), "")
    assert sorted((r["doc_id"] for r in kept.collect()), key=repr) == sorted([2, 9, 13, 13, 4, None], key=repr)
    assert kept.columns == documents(spark, rows).columns


def test_query(spark, small, duck, same_rows):
    same_rows(ngram_jaccard.query(spark, small), duck, ngram_jaccard.ORACLE)


def test_chunks_of_one_component_do_not_meet(spark, monkeypatch):
    monkeypatch.setattr(ngram_jaccard, "CELL", 4)
    n = 200
    tiles = spark.createDataFrame([(7, c, n) for c in range(n)] + [(7, 1000 + c, n) for c in range(3)], "token bigint, cid bigint, m bigint")
    roots = spark.createDataFrame([(c, 0) for c in range(n)], "node bigint, root bigint")
    held = spark.createDataFrame([(c, 5, bytearray(8)) for c in [*range(n), 1000, 1001, 1002]], "cid bigint, n bigint, sig binary")
    rows = ngram_jaccard._signed(tiles, held, roots).collect()
    # each of the many stands once, with the few; the few stand once for each chunk of the many, and once among themselves
    assert len([r for r in rows if r["cid"] < n]) == n and len([r for r in rows if r["cid"] >= n]) == 3 * (n // 4 + 1)
    cells: dict = {}
    for r in rows:
        cells.setdefault(r["cell"], set()).add(r["cid"])
    assert {frozenset((a, 1000)) for a in [*range(n), 1001, 1002]} <= {frozenset((a, b)) for x in cells.values() for a in x for b in x if b == 1000 and a != b}
