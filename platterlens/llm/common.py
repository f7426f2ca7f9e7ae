"""What the text operators share: scratch tables in the shared folder, word splitting and 64-bit shingle hashes."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: A word is a run of bytes other than ASCII white space, which is what bytes.split() gives.
WORD = r"[^\x20\x09-\x0D]+"
#: Entries a worker's word table holds before it starts afresh; it bounds memory and changes no result.
WORD_TABLE = 100_000


#: Spark's own setting of how many bytes a batch for a Python worker may have, its default, and what is used here.
BATCH, BATCH_DEFAULT, BATCH_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch", 64 << 20, 4 << 20


def small_batches(spark: SparkSession) -> None:
    """Bounds the batches that workers get, by bytes, unless the session has a bound of its own."""
    if spark.conf.get(BATCH).rstrip("bB") == str(BATCH_DEFAULT):
        spark.conf.set(BATCH, f"{BATCH_BYTES}b")


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    small_batches(spark)
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir. Where none is set, a local session gets one here;
    a cluster gets an error, since its executors don't see one another's folders."""
    told = spark.conf.get("spark.checkpoint.dir", None)
    if not told:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        told = "/tmp/checkpoints/platterlens"
        spark.conf.set("spark.checkpoint.dir", told)
    return told.rstrip("/")


#: Spark's own setting that removes an execution's shuffle files when it ends.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def written(df: DataFrame, name: str) -> DataFrame:
    """df as a Parquet table in the shared folder, read again: cuts the lineage and survives lost executors. The shuffle
    files of the write go when it ends, since nothing reads them any more."""
    spark = df.sparkSession
    small_batches(spark)
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    before = spark.conf.get(CLEANUP, "false")
    spark.conf.set(CLEANUP, "true")
    try:
        df.write.option("compression", "zstd").parquet(path)
    finally:
        spark.conf.set(CLEANUP, before)
    back = spark.read.schema(df.schema).parquet(path)
    back.scratch_path = path
    return back


def drop_written(df: DataFrame) -> None:
    """Deletes the table of what written() returned; call it only when nothing uses it any more. Anything else is refused: a
    table that a caller handed in, or one that lies outside the shared folder."""
    spark, path = df.sparkSession, getattr(df, "scratch_path", None)
    if not path or not path.startswith(shared_dir(spark) + "/"):
        raise ValueError("only a table that written() made in the shared folder can be dropped")
    folder = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(folder, True)


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def held_out() -> F.Column:
    """Rows kept from every fit: crc32 of the id as text leaves 2 modulo 4."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 == 2, F.lit(False))


def sliced(batches: Iterator[pa.RecordBatch], rows: int = 1000, most: int = 4_000_000) -> Iterator[pa.RecordBatch]:
    """Batches in slices of at most so many rows and bytes of text, which bounds what a worker holds as Python objects. A
    row that is longer than that is a slice of its own."""
    for batch in batches:
        sizes = np.zeros(batch.num_rows, np.int64)
        for column in batch.columns:
            if pa.types.is_string(column.type) or pa.types.is_binary(column.type) or pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type):
                sizes += pc.fill_null(pc.binary_length(column), 0).to_numpy(zero_copy_only=False).astype(np.int64)
        ends, at = np.cumsum(sizes), 0
        while at < batch.num_rows:
            end = int(np.searchsorted(ends, (ends[at - 1] if at else 0) + most, side="right"))
            end = min(max(end, at + 1), at + rows, batch.num_rows)
            yield batch.slice(at, end - at)
            at = end


def smallest(rows: DataFrame, order: str, n: int, *ties: str) -> DataFrame:
    """The n rows with the smallest 64-bit hashes in column `order`, or a few less.

    The number of rows gives the hash that about n lie below, with a margin of six deviations; only those are sorted, so
    what one task gathers is about n rows, whatever the input.
    """
    total = rows.count()
    if total > n:
        share = (n + 6 * n**0.5 + 6) / total
        rows = rows.filter(F.col(order) < min(-(1 << 63) + int(share * (1 << 64)), (1 << 63) - 1))
    return rows.orderBy(order, *ties).limit(n)


class WordHashes(dict):
    """word (bytes) -> 64-bit hash, remembered."""

    def __missing__(self, word: bytes) -> int:
        if len(self) >= WORD_TABLE:
            self.clear()
        value = self[word] = xxhash.xxh3_64_intdigest(word)
        return value

    def of(self, words: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), np.uint64, len(words))


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers that spreads every input bit."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def shingle_hashes(hashes: np.ndarray, k: int) -> np.ndarray:
    """Hashes of all runs of k words; empty if there are fewer."""
    n = len(hashes) - k + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    out = np.full(n, k, np.uint64)
    for i in range(k):
        out = mixed(out * np.uint64(0x9E3779B97F4A7C15) + hashes[i : i + n])
    return out
