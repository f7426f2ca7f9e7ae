"""The manifest against a tree built by plain loops."""

from __future__ import annotations

from collections import defaultdict
from hashlib import sha256

import pytest
from edge import awkward, documents
from pyspark.sql import functions as F

from platterlens.llm import merkle_manifest


def _hash(*parts) -> str:
    return sha256("".join(parts).encode()).hexdigest()


def _told(*fields) -> str:
    return _hash(*("-" if f is None else f"{len(str(f).encode())}:{f}" for f in fields))


def _levels(nodes: list[str], arity: int) -> list[list[str]]:
    levels = [nodes]
    while len(levels[-1]) > 1:
        levels.append([_hash(*levels[-1][i : i + arity]) for i in range(0, len(levels[-1]), arity)])
    return levels


def _climb(levels: list[list[str]], at: int, arity: int, leaf: str) -> tuple[list[str], str]:
    proof = []
    for level in levels[:-1]:
        first = at - at % arity
        run = level[first : first + arity]
        proof += run[: at % arity] + run[at % arity + 1 :]
        run[at % arity] = leaf
        leaf, at = _hash(*run), at // arity
    return proof, leaf


def _expected(rows: list[tuple], arity: int, add) -> list[tuple]:
    parts = defaultdict(list)
    for i, text, lang, source, n in rows:
        parts["-" if lang is None else "=" + lang].append((i is not None, i, _told(i, source, lang, n, text), _told(i, source, lang, n if n is None else n + add(i), text)))
    trees = {}
    for part, leaves in parts.items():
        leaves.sort(key=lambda x: (x[0], x[1] or 0, x[2]))
        trees[part] = _levels([x[2] for x in leaves], arity)
    names = sorted(parts, key=str.encode)
    top = _levels([trees[p][-1][0] for p in names], arity)
    out = []
    for k, part in enumerate(names):
        for at, (_, i, leaf, claim) in enumerate(parts[part]):
            low, end = _climb(trees[part], at, arity, claim)
            high, end = _climb(top, k, arity, end)
            out.append((str(i), leaf, trees[part][-1][0], top[-1][0], "".join(low + high), end, end == top[-1][0]))
    return sorted(out)


def _found(spark, rows, arity, adds) -> list[tuple]:
    df = documents(spark, [r[:4] for r in rows])
    claimed = {"n_chars": F.col("n_chars") + 1}
    out = merkle_manifest.proofs(merkle_manifest.manifest(merkle_manifest.leaves(df, claimed=claimed, where=adds), arity))
    return sorted((str(r["doc_id"]), r["leaf"], r["subroot"], r["root"], r["proof"], r["folded_root"], r["verified"]) for r in out.collect())


@pytest.mark.parametrize(("arity", "block"), [(2, 1024), (3, 9), (2, 4)])
def test_against_plain_trees(spark, monkeypatch, arity, block):
    monkeypatch.setattr(merkle_manifest, "BLOCK", block)
    rows = [(i, t, lang, s, len(t) if t is not None else None) for i, t, lang, s in [*awkward(), *((100 + i, f"text {i}", "zz" if i % 3 else "ünïcode", "s") for i in range(40))]]
    odd = lambda i: int(i is not None and i % 2 == 1)
    assert _found(spark, rows, arity, F.pmod("doc_id", F.lit(2)) == 1) == _expected(rows, arity, odd)


@pytest.mark.parametrize("n", [0, 1, 3])
def test_few_rows_of_one_part(spark, n):
    rows = [(i, "x", "en", None, 1) for i in range(n)]
    assert _found(spark, rows, 2, F.lit(False)) == _expected(rows, 2, lambda i: 0)


def test_stored_preimages_hash_to_the_roots(spark):
    df = documents(spark, [(i, f"t{i}", lang, "s") for i in range(7) for lang in ("a", "b")])
    made = merkle_manifest.manifest(merkle_manifest.leaves(df))
    stored = {(r["part"], r["level"], r["idx"]): r["preimage"] for r in made.parents().collect()}
    for (part, level, idx), preimage in stored.items():
        slots = [preimage[i : i + 64] for i in range(0, len(preimage), 64)]
        if level > 1:
            assert slots == [_hash(stored[part, level - 1, 2 * idx + k]) for k in range(len(slots))]
    root = _hash(stored["", 1, 0])
    found = merkle_manifest.proofs(made).collect()
    assert {r["root"] for r in found} == {root} and all(r["verified"] for r in found)
    again = merkle_manifest.proofs(merkle_manifest.manifest(merkle_manifest.leaves(df.repartition(3)))).collect()
    assert sorted(found) == sorted(again)


def test_query(spark, small, duck, same_rows):
    same_rows(merkle_manifest.query(spark, small), duck, merkle_manifest.ORACLE)
