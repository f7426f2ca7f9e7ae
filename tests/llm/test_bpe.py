from __future__ import annotations

import random
import struct

import pytest
from edge import awkward, documents
from pyspark.sql import functions as F

from platterlens.llm import bpe


@pytest.fixture(scope="module")
def reference():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(bpe.vocabulary_path())


def ids_of(packed: bytes) -> list[int]:
    return list(struct.unpack(f"<{len(packed) // 4}I", packed))


def test_texts_like_the_library(reference):
    draw = random.Random(5)
    pool = "  \n\t\r\x0b\x1c\x85\xa0 ​'sS’.,!?-_0129٣½²aZéßǅñ日本語☕👩‍👩‍👧́\0\x01<|endoftext|>'ll 're"
    texts = ["".join(draw.choice(pool) for _ in range(draw.randrange(60))) for _ in range(3000)]
    texts += ["<|endoftext|>", " <|endoftext|> ", "a" * 5000, "ab" * 300 + "é" * 200, "it's we'll I'm", "   x", "x   ", "\0hidden", "", " ", "word \0 word", "www.a-b.c/d?e=f", "x y z"]
    own = bpe.vocabulary(bpe.vocabulary_path())
    want = [e.ids for e in reference.encode_batch(texts, add_special_tokens=False)]
    got = own.encode_many(texts)
    assert [ids_of(g) for g in got] == want
    assert [own.decode(g) for g in got] == [reference.decode(i, skip_special_tokens=False) for i in want]


def test_short_and_long_merges_agree():
    own, draw = bpe.vocabulary(bpe.vocabulary_path()), random.Random(2)
    data = [bytes(draw.randrange(256) for _ in range(draw.randrange(1, bpe.SHORT + 1))) for _ in range(300)] + [b" international", b"a"]
    assert own.merge_short(data) == [own.merge_long(d) for d in data]


def test_awkward_rows(spark, reference):
    df = documents(spark, awkward())
    coded = bpe.decode(bpe.encode(df, bpe.vocabulary_path()), bpe.vocabulary_path())
    assert set(df.columns) < set(coded.columns)
    for r in coded.collect():
        want = reference.encode(r["text"] or "", add_special_tokens=False).ids
        assert ids_of(bytes(r["ids"])) == want
        assert r["decoded"] == reference.decode(want, skip_special_tokens=False)
    assert bpe.encode(df.limit(0), bpe.vocabulary_path()).count() == 0
    arrays = bpe.encode(df.filter("doc_id in (5, 7)"), bpe.vocabulary_path()).select("doc_id", bpe.unpacked(F.col("ids")).alias("a"))
    assert {r["doc_id"]: r["a"] for r in arrays.collect()} == {5: [], 7: reference.encode("one two", add_special_tokens=False).ids}


def test_query(spark, small, reference):
    import hashlib

    texts = {r["doc_id"]: r["text"] or "" for r in spark.read.parquet(f"{small}/documents.parquet").collect()}
    for r in bpe.query(spark, small).collect():
        want = reference.encode(texts[r["doc_id"]], add_special_tokens=False).ids
        packed = struct.pack(f"<{len(want)}I", *want)
        assert (r["n_tokens"], r["ids_sha256"]) == (len(want), hashlib.sha256(packed).hexdigest())
        assert r["decoded_sha256"] == hashlib.sha256(reference.decode(want, skip_special_tokens=False).encode()).hexdigest()
