"""Exact deduplication over a sharded cuckoo-filter index.

Every text is known by its SHA-256 and byte length, computed in the JVM, so texts themselves are never shuffled. Map
tasks fold their own rows to one entry for each digest (a text copied into a third of all rows becomes at most one
entry for each task), entries are dealt to shards by digest, of SHARD_KEYS rows or so at most, and each shard streams its
entries through a cuckoo filter: a miss inserts the fingerprint; a hit is verified against the full digests stored for that bucket; a verified
hit whose newcomer has the larger id deletes the live entry and inserts the newcomer as the live one; a full table is
rebuilt at twice the size from the stored keys. What stays live in the end is one row for each text, with its count.

Defined cases: null text counts as empty; all empty texts form one group; the largest id of a group stays and a null id
counts as smaller than any; rows repeating both id and text are all marked kept by `deduplicate`, and `stage` leaves one of
them; an empty table gives an empty result; input columns with the names of results (keep_id, group_size, kept, text_sha256)
are replaced, all others pass through.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import documents, shuffle_partitions

SLOTS = 4
MAX_KICKS = 200
#: Rows for a shard of the index: its keys, about 300 bytes each, are what a worker holds.
SHARD_KEYS = 500_000


class CuckooIndex:
    """Cuckoo filter of 16-bit fingerprints, four to a bucket, over keys that are kept beside their bucket.

    `live` holds for each bucket the full keys whose fingerprint was put there, so that a hit can be verified, a key can
    be deleted by what is stored, and a rebuild needs nothing but the index itself.
    """

    def __init__(self, capacity: int = 64):
        self.n_buckets = 1 << max(4, int(capacity / (SLOTS * 0.85)).bit_length())
        self._clear()

    def _clear(self) -> None:
        self.table: list[list[int]] = [[] for _ in range(self.n_buckets)]
        self.content: list[dict[bytes, list]] = [{} for _ in range(self.n_buckets)]
        self.size = 0

    def _places(self, key: bytes) -> tuple[int, int, int]:
        mark = int.from_bytes(key[8:10], "little") | 1
        first = int.from_bytes(key[:8], "little") & (self.n_buckets - 1)
        return mark, first, self._other(first, mark)

    def _other(self, bucket: int, mark: int) -> int:
        return (bucket ^ (mark * 0x5BD1E995)) & (self.n_buckets - 1)

    def find(self, key: bytes) -> list | None:
        """The live entry of key: fingerprints first, and on a hit the keys stored for the bucket."""
        mark, a, b = self._places(key)
        if mark in self.table[a] or mark in self.table[b]:
            return self.content[a].get(key)  # content stays at a key's first bucket; only fingerprints are moved
        return None

    def insert(self, key: bytes, entry: list) -> None:
        mark, a, b = self._places(key)
        self.content[a][key] = entry
        self.size += 1
        if not self._place(mark, a, b):
            self._grow()

    def _place(self, mark: int, a: int, b: int) -> bool:
        for bucket in (a, b):
            if len(self.table[bucket]) < SLOTS:
                self.table[bucket].append(mark)
                return True
        bucket = b
        for kick in range(MAX_KICKS):
            row = self.table[bucket]
            row[kick % SLOTS], mark = mark, row[kick % SLOTS]
            bucket = self._other(bucket, mark)
            if len(self.table[bucket]) < SLOTS:
                self.table[bucket].append(mark)
                return True
        return False

    def delete(self, key: bytes) -> bool:
        mark, a, b = self._places(key)
        if key not in self.content[a]:
            return False
        for bucket in (a, b):
            if mark in self.table[bucket]:
                self.table[bucket].remove(mark)
                break
        del self.content[a][key]
        self.size -= 1
        return True

    def _grow(self) -> None:
        """Twice the buckets, refilled from the stored keys; again if that overflows too."""
        stored = [x for bucket in self.content for x in bucket.items()]
        while True:
            self.n_buckets *= 2
            self._clear()
            for key, entry in stored:
                mark, a, b = self._places(key)
                self.content[a][key] = entry
                self.size += 1
                if not self._place(mark, a, b):
                    break
            else:
                return

    def items(self) -> Iterator[tuple[bytes, list]]:
        return (x for bucket in self.content for x in bucket.items())


def _merge(index: CuckooIndex, key: bytes, best: int | None, n: int) -> None:
    old = index.find(key)
    if old is None:
        index.insert(key, [best, n])
    elif best is not None and (old[0] is None or best > old[0]):
        index.delete(key)
        index.insert(key, [best, old[1] + n])
    else:
        old[1] += n


def _folded(frames: Iterator[pd.DataFrame], whole: bool) -> Iterator[pd.DataFrame]:
    """One row for each key seen here. whole: every entry of a key comes here, so the index's answer is the result;
    otherwise the index is emptied whenever it holds 200,000 keys, which bounds a map task's memory."""

    def rows(index: CuckooIndex) -> Iterator[pd.DataFrame]:
        got = list(index.items())
        for i in range(0, len(got), 20_000):
            part = got[i : i + 20_000]
            yield pd.DataFrame({"content_key": [k for k, _ in part], "keep_id": pd.array([e[0] for _, e in part], dtype="Int64"), "group_size": [e[1] for _, e in part]})

    index = CuckooIndex()
    for pdf in frames:
        ids = pdf["keep_id"].to_numpy()
        for key, best, n, null in zip(pdf["content_key"], ids, pdf["group_size"], pd.isna(ids)):
            _merge(index, bytes(key), None if null else int(best), int(n))
        if not whole and index.size >= 200_000:
            yield from rows(index)
            index = CuckooIndex()
    yield from rows(index)


def groups(keyed: DataFrame) -> DataFrame:
    """(content_key, keep_id, group_size) of keyed (content_key binary, doc_id long), through the sharded index. The number of
    rows, which is a count of Parquet footers or one light scan, sets the number of shards."""
    shards = max(shuffle_partitions(keyed.sparkSession), -(-keyed.select("doc_id").count() // SHARD_KEYS))
    schema = "content_key binary, keep_id long, group_size long"
    entries = keyed.select("content_key", F.col("doc_id").cast("long").alias("keep_id"), F.lit(1).cast("long").alias("group_size"))
    folded = entries.mapInPandas(lambda frames: _folded(frames, False), schema)
    return folded.repartition(shards, "content_key").mapInPandas(lambda frames: _folded(frames, True), schema)


def content_key(text: str = "text") -> F.Column:
    """32 bytes of SHA-256, then the length in bytes: what texts are compared by."""
    body = F.coalesce(F.col(text).cast("string"), F.lit(""))
    return F.unhex(F.concat(F.sha2(body, 256), F.lpad(F.hex(F.octet_length(body).cast("long")), 16, "0")))


def deduplicate(docs: DataFrame, text: str = "text") -> DataFrame:
    """docs (doc_id and any other columns but the text's derivatives) with keep_id, group_size, kept, text_sha256.

    The groups go back to the rows by a join on the key. A key with a third of all rows is one row on the groups' side,
    so adaptive execution can split its partition of the documents' side.
    """
    own = [c for c in docs.columns if c not in ("keep_id", "group_size", "kept", "text_sha256")]
    rows = docs.select(*own, content_key(text).alias("__dedup_key"))
    found = groups(rows.select(F.col("__dedup_key").alias("content_key"), "doc_id")).withColumnsRenamed({"content_key": "__found_key", "keep_id": "__found_id", "group_size": "__found_size"})
    joined = rows.join(found, F.col("__dedup_key") == F.col("__found_key"), "left")
    return joined.select(
        *own,
        F.col("__found_id").alias("keep_id"),
        F.col("__found_size").alias("group_size"),
        F.col("doc_id").eqNullSafe(F.col("__found_id")).alias("kept"),
        F.lower(F.substring(F.hex("__dedup_key"), 1, 64)).alias("text_sha256"),
    )


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return deduplicate(documents(spark, sf_dir).select("doc_id", "text")).drop("text")


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: of equal texts the row with the largest id stays. The ids that stay are known from the index, so
    texts move once, in the join that keeps them; rows that repeat one id and text are reduced to one beforehand."""
    lowest = F.lit(-(1 << 63))
    rows = docs.withColumns({"__dedup_key": content_key(), "__dedup_id": F.coalesce("doc_id", lowest)})
    found = groups(docs.select("doc_id", content_key().alias("content_key")))
    stays = found.select(F.col("content_key").alias("__dedup_key"), F.coalesce("keep_id", lowest).alias("__dedup_id"))
    return rows.join(stays, ["__dedup_key", "__dedup_id"], "left_semi").dropDuplicates(["__dedup_key", "__dedup_id"]).select(*docs.columns)


ORACLE = """
SELECT doc_id, max(doc_id) OVER (PARTITION BY coalesce(text, '')) AS keep_id,
       count(*) OVER (PARTITION BY coalesce(text, '')) AS group_size,
       doc_id = max(doc_id) OVER (PARTITION BY coalesce(text, '')) AS kept, sha256(coalesce(text, '')) AS text_sha256
FROM documents
"""
