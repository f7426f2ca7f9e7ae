"""The corpus pipeline against the same stages by brute force."""

from __future__ import annotations

import hashlib
import struct

import corpus_pipeline
from test_ngram_jaccard import brute

from platterlens.llm import bpe, quality_rules, source_mix
from platterlens.llm.common import WordHashes


def test_pipeline_by_brute_force(spark, small):
    from tokenizers import Tokenizer

    table = WordHashes()
    rows = [(r["doc_id"], r["text"], r["lang"], r["source"]) for r in spark.read.parquet(f"{small}/documents.parquet").collect()]
    kept = []
    for i, t, lang, s in rows:
        q = dict(zip(quality_rules.VERDICT.names, quality_rules.judge(t or "", table, 10, 5, 0.2, 0.5)))
        if q["kept"]:
            kept.append((i, q["cleaned"] if q["n_lines_removed"] else t, lang, s))
    last = {}
    for r in kept:
        last[r[1]] = max(last.get(r[1], r), r)
    unique = list(last.values())
    groups = {i: c for i, _, c in brute(unique, 5, 80, 100)}
    left = [r for r in unique if groups[r[0]] == r[0]]

    found = corpus_pipeline.run(spark, small).collect()
    texts = {i: t for i, t, _, _ in left}
    assert {r["doc_id"] for r in found} <= set(texts)
    times = {i: sum(r["doc_id"] == i for r in found) for i in texts}
    size = lambda t: len((t or "").encode().split())
    names = sorted({s for *_, s in left}, key=lambda s: (s is None, s or ""))
    sizes = [sum(size(t) for _, t, _, s in left if s == n) for n in names]
    for name, want in zip(names, source_mix.targets(sizes)):
        mine = [(i, t) for i, t, _, s in left if s == name]
        got = sum(times[i] * size(t) for i, t in mine)
        assert max(times[i] for i, _ in mine) <= 2
        sums, part = {0}, want - int(want // sum(size(t) for _, t in mine)) * sum(size(t) for _, t in mine)
        for _, t in mine:
            sums |= {x + size(t) for x in sums}
        assert abs(got - want) <= min(abs(x - part) for x in sums) + 1e-6  # as near as these documents allow
    reference = Tokenizer.from_file(bpe.vocabulary_path())
    for r in found:
        ids = reference.encode(texts[r["doc_id"]] or "", add_special_tokens=False).ids
        assert bytes(r["ids"]) == struct.pack(f"<{len(ids)}I", *ids)
        assert r["n_tokens"] == len(ids) and r["ids_sha256"] == hashlib.sha256(struct.pack(f"<{len(ids)}I", *ids)).hexdigest()


def test_stages(spark, small):
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality rules", "exact dedup", "n-gram Jaccard join", "source mix", "BPE encoding and decoding"]
    docs = spark.read.parquet(f"{small}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs, small).columns == docs.columns
        assert stage(spark, docs.limit(0), small).count() == 0
