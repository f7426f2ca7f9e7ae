"""Checks of bytes: error detection of raw sectors, keys of small pictures, digests of files."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SECTOR, SYNC = 2352, b"\x00" + b"\xff" * 10 + b"\x00"


def edc_table(polynomial: int = 0xD8018001) -> np.ndarray:
    table = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        table = np.where(table & 1, (table >> 1) ^ np.uint32(polynomial), table >> 1).astype(np.uint32)
    return table


def edc(sectors: np.ndarray) -> np.ndarray:
    """Error detection codes of rows of equal length, all rows a byte at a time."""
    table, code = edc_table(), np.zeros(len(sectors), np.uint32)
    for i in range(sectors.shape[1]):
        code = (code >> 8) ^ table[(code ^ sectors[:, i]) & 0xFF]
    return code


def verdicts(raw: list[bytes]) -> list[str]:
    """Sound, Corrupt or Unchecked for each raw sector, by its mode's range and stored code."""
    out = ["Corrupt"] * len(raw)
    ranges = {1: (0, 2064), 2: (16, 2072), 3: (16, 2348)}
    by_mode: dict[int, list[int]] = {1: [], 2: [], 3: []}
    for i, data in enumerate(raw):
        if data is None or len(data) < SECTOR or data[:12] != SYNC:
            continue
        mode = data[15]
        if mode == 1:
            by_mode[1].append(i)
        elif mode == 2 and not data[18] & 0x20:
            by_mode[2].append(i)
        elif mode == 2 and data[2348:2352] != bytes(4):
            by_mode[3].append(i)
        else:
            out[i] = "Unchecked"
    for mode, rows in by_mode.items():
        if rows:
            first, stored = ranges[mode]
            block = np.frombuffer(b"".join(raw[i][:SECTOR] for i in rows), np.uint8).reshape(-1, SECTOR)
            want = block[:, stored : stored + 4].copy().view("<u4")[:, 0]
            for i, ok in zip(rows, edc(block[:, first:stored]) == want):
                out[i] = "Sound" if ok else "Corrupt"
    return out


def check_sectors(sectors: DataFrame) -> DataFrame:
    """sectors (track, sector_pos, raw) with verdict; no shuffle, batches are checked where they lie."""
    own = [c for c in sectors.columns if c not in ("raw", "verdict")]
    schema = sectors.select(*own).schema.add("verdict", "string")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            said = verdicts(batch.column("raw").to_pylist())
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in own), pa.array(said, pa.string())], [*own, "verdict"])

    return sectors.select(*own, "raw").mapInArrow(run, schema)


def sector_address(raw: Column) -> Column:
    """The address in a raw sector's header, in frames from the start of the data; null without a header."""
    byte = lambda i: F.conv(F.hex(F.substring(raw, i, 1)), 16, 10).cast("int")
    bcd = lambda b: F.shiftright(b, 4) * 10 + b.bitwiseAND(F.lit(15))
    header = F.substring(raw, 1, 12) == F.lit(SYNC)
    return F.when(header & (F.octet_length(raw) >= 16), ((bcd(byte(13)) * 60 + bcd(byte(14))) * 75 + bcd(byte(15)) - 150).cast("long"))


def track_verdicts(checked: DataFrame) -> DataFrame:
    """Counts of each track's verdicts, and of sectors that say they belong elsewhere."""
    return checked.groupBy("track").agg(
        F.count("*").alias("sectors"), *(F.count_if(F.col("verdict") == v).alias(v.lower()) for v in ("Sound", "Corrupt", "Unchecked")), F.count_if(F.col("address").isNotNull() & (F.col("address") != F.col("sector_pos"))).alias("misplaced")
    )


def fnv1a(data: bytes) -> int:
    value = 0xCBF29CE484222325
    for b in data:
        value = ((value ^ b) * 0x100000001B3) & 0xFFFFFFFFFFFFFFFF
    return value


def picture_keys(pictures: DataFrame) -> DataFrame:
    """pictures (w, h, bits, ...) with key: FNV-1a of 64 bits over the size, two little-endian bytes each, and the pixels.

    The product wraps at 64 bits, which ANSI arithmetic refuses, so batches of pictures of one size go through arrays.
    """
    own = [c for c in pictures.columns if c != "key"]
    schema = pictures.select(*own).schema.add("key", "string")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data = [None if b is None else int(w).to_bytes(2, "little") + int(h).to_bytes(2, "little") + b for w, h, b in zip(*(batch.column(c).to_pylist() for c in ("w", "h", "bits")))]
            keys: list[str | None] = [None] * len(data)
            sizes: dict[int, list[int]] = {}
            for i, d in enumerate(data):
                if d is not None:
                    sizes.setdefault(len(d), []).append(i)
            for size, rows in sizes.items():
                block = np.frombuffer(b"".join(data[i] for i in rows), np.uint8).reshape(len(rows), size)
                value = np.full(len(rows), 0xCBF29CE484222325, np.uint64)
                for k in range(size):
                    value = (value ^ block[:, k]) * np.uint64(0x100000001B3)
                for i, v in zip(rows, value.tolist()):
                    keys[i] = f"{v:016x}"
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in own), pa.array(keys, pa.string())], [*own, "key"])

    return pictures.select(*own).mapInArrow(run, schema)


def digests(files: DataFrame, content: str = "content") -> DataFrame:
    """files with bytes, crc32 and sha1 of their content, by the JVM's functions."""
    data = F.col(content).cast("binary")
    return files.withColumns({"bytes": F.octet_length(data).cast("long"), "crc32": F.crc32(data), "sha1": F.sha1(data)})


def scan_health(printed: DataFrame, by: list[str]) -> DataFrame:
    """(by, failed, read_errors) of printed (by, seq, line): the files whose key could not be found, each once, and how many
    lines tell of sectors that can't be read."""
    file = F.regexp_extract("line", r"Error cracking CSS key for\s+(\S+)", 1)
    unread = F.translate("line", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz").rlike("cannot read from device|error reading nav packet|read error")
    return printed.groupBy(*by).agg(F.collect_set(F.when(file != "", file)).alias("failed"), F.count_if(unread).alias("read_errors"))


def dump_checks(matched: DataFrame, sectors: DataFrame) -> DataFrame:
    """What became of each dump: matched (dump_id, game, ...) is matching.match_digests' answer; sectors (dump_id, sector_pos, raw)
    are looked at for dumps that no datfile has, and for no others: a semi-join stands before anything is read of a sector.

    verdict: verified; sound (every sector agrees with its own error detection, so no datfile covers the disc); misread (some do not);
    unknown (its first sector is not one of data, so nothing can be told). With sectors, bad (corrupt or misplaced) and unchecked.
    """
    open_ = matched.filter("game is null").select("dump_id").distinct()
    own = sectors.join(open_, "dump_id", "left_semi")
    data = F.substring("raw", 1, 12) == F.lit(SYNC)
    first = own.groupBy("dump_id").agg(F.min_by(data, "sector_pos").alias("data")).filter("data").select("dump_id")
    looked = own.join(first, "dump_id", "left_semi").withColumn("address", sector_address(F.col("raw")))
    counts = track_verdicts(check_sectors(looked.withColumnRenamed("dump_id", "track"))).select(F.col("track").alias("dump_id"), "sectors", (F.col("corrupt") + F.col("misplaced")).alias("bad"), "unchecked")
    rows = matched.join(counts, "dump_id", "left")
    verdict = F.when(F.col("game").isNotNull(), "verified").when(F.col("sectors").isNull(), "unknown").when(F.col("bad") == 0, "sound").otherwise("misread")
    return rows.withColumn("verdict", verdict)


def dump_totals(tracks: DataFrame, by: list[str]) -> DataFrame:
    """(by, bytes, corrupt, sound, bad_tracks) of the tracks (by, bytes, corrupt) of dumps."""
    return tracks.groupBy(*by).agg(F.sum("bytes").alias("bytes"), F.sum("corrupt").alias("corrupt"), F.bool_and(F.col("corrupt") == 0).alias("sound"), F.count_if(F.col("corrupt") > 0).alias("bad_tracks"))
