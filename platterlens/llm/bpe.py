"""Byte-level BPE, encoding and decoding, over a contiguous rank array.

A text is cut at special tokens and then into words by the vocabulary's pattern. The parts of a short word lie in one
array with the ranks of adjacent pairs in a second: the smallest rank is searched by a scan, the boundary between the
two parts is deleted, and the ranks on either side are refreshed. Words new to a worker are merged together, one row each. Words of more than SHORT bytes, where repeated scans
would cost the square of the length, take the same merges from a heap. Each worker remembers the ids of recent words.

The vocabulary is a tokenizer file (JSON of vocab and merges) named by a parameter; executors load it themselves.

Defined cases: null text counts as empty and gives no ids; repeated rows are encoded one by one; a special token's
string within a text becomes its id; texts of any length are taken whole; other columns pass through.
"""

from __future__ import annotations

import heapq
import json
import re
import struct
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import documents, sliced

SHORT = 64
#: Chunks a worker remembers before it starts afresh; it bounds memory and changes no result.
REMEMBERED = 150_000
NONE = np.int32((1 << 31) - 1)
#: Fixed value: the pattern that parts a text into words, with Unicode's white space spelt out.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


def byte_symbols() -> dict[str, int]:
    """symbol -> byte, as byte-level vocabularies write them: printable Latin-1 stands for itself, the other bytes take
    the code points from 256 on, in order."""
    printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [b for b in range(256) if b not in set(printable)]
    return {chr(b): b for b in printable} | {chr(256 + i): b for i, b in enumerate(others)}


#: A space that begins the text, ends it, or has white space (or a character used as a mark below) after it.
CROWDED = re.compile(r" (?=\s|\Z|\x01)|\A ")


class Vocabulary:
    """Encodes and decodes with one tokenizer file; remembers the ids of chunks, as packed little-endian integers."""

    def __init__(self, path: str):
        spec = json.load(open(path, encoding="utf-8"))
        symbols, vocab = byte_symbols(), spec["model"]["vocab"]
        self.pieces: dict[int, bytes] = {i: bytes(symbols[c] for c in token) for token, i in vocab.items()}
        self.special = {x["content"]: x["id"] for x in spec["added_tokens"]}
        self.pieces |= {i: token.encode() for token, i in self.special.items()}
        self.byte_ids = np.array([vocab[c] for c, _ in sorted(symbols.items(), key=lambda x: x[1])], np.int32)
        pairs = np.array([(vocab[a], vocab[b], vocab[a + b]) for a, b in spec["model"]["merges"]], np.int64).reshape(-1, 3)
        self.merged = pairs[:, 2].astype(np.int32)
        self.n = max(self.pieces) + 1
        keys = pairs[:, 0] * self.n + pairs[:, 1]
        self.rank_of_key = np.argsort(keys, kind="stable").astype(np.int32)
        self.keys = keys[self.rank_of_key]
        self.merges = {(a, b): (rank, new) for rank, (a, b, new) in enumerate(pairs.tolist())}
        two = np.arange(256, dtype=np.int32).repeat(256), np.tile(np.arange(256, dtype=np.int32), 256)
        self.byte_ranks = self.ranks(self.byte_ids[two[0]], self.byte_ids[two[1]]).reshape(256, 256)
        self.words = regex.compile(PATTERN)
        self.cut = regex.compile("(" + "|".join(map(regex.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None
        self.chunks: dict[str, bytes] = {}

    def ranks(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """The merge ranks of pairs of ids, NONE where there is no merge."""
        keys = left.astype(np.int64) * self.n + right
        at = np.minimum(np.searchsorted(self.keys, keys), len(self.keys) - 1)
        return np.where(self.keys[at] == keys, self.rank_of_key[at], NONE)

    def merge_short(self, words: list[bytes]) -> list[bytes]:
        """Ids of words of at most SHORT bytes: every word is a row of two contiguous arrays, its parts and the ranks of
        adjacent pairs. Each round scans every row for its smallest rank, deletes that boundary and refreshes the ranks
        beside it; rows without a merge left drop out."""
        out: list[bytes] = [b""] * len(words)
        sizes = np.fromiter(map(len, words), np.int64, len(words))
        order = np.argsort(sizes, kind="stable")
        for start in range(0, len(words), 4096):
            rows = order[start : start + 4096]
            size = sizes[rows]
            width = int(size[-1])
            cols = np.arange(width)
            data = np.frombuffer(b"".join(words[i].ljust(width, b"\0") for i in rows.tolist()), np.uint8).reshape(-1, width)
            parts = self.byte_ids[data]
            ranks = np.full(parts.shape, NONE, np.int32)
            ranks[:, :-1] = np.where(cols[1:] < size[:, None], self.byte_ranks[data[:, :-1], data[:, 1:]], NONE)
            while len(rows):
                at = ranks.argmin(axis=1)
                best = ranks[np.arange(len(rows)), at]
                done = best == NONE
                if done.any():
                    ends = np.cumsum(size[done])
                    flat = parts[done][cols < size[done][:, None]].astype("<u4").tobytes()
                    for i, a, b in zip(rows[done].tolist(), (ends - size[done]).tolist(), ends.tolist()):
                        out[i] = flat[4 * a : 4 * b]
                    on = ~done
                    rows, size, parts, ranks, at, best = rows[on], size[on], parts[on], ranks[on], at[on], best[on]
                    if not len(rows):
                        break
                row = np.arange(len(rows))
                parts[:, :-1] = np.where(cols[:-1] > at[:, None], parts[:, 1:], parts[:, :-1])
                parts[row, at] = self.merged[best]
                ranks[:, :-1] = np.where(cols[:-1] > at[:, None], ranks[:, 1:], ranks[:, :-1])
                size = size - 1
                right = at + 1 < size
                ranks[row, at] = np.where(right, self.ranks(parts[row, at], parts[row, np.minimum(at + 1, width - 1)]), NONE)
                left = at > 0
                ranks[row[left], at[left] - 1] = self.ranks(parts[row[left], at[left] - 1], parts[row[left], at[left]])
        return out

    def merge_long(self, data: bytes) -> bytes:
        merges, n = self.merges, len(data)
        ids: list[int | None] = self.byte_ids[np.frombuffer(data, np.uint8)].tolist()
        before, after = list(range(-1, n - 1)), [*range(1, n), -1]
        heap = [(m[0], i, ids[i], ids[i + 1], m[1]) for i in range(n - 1) if (m := merges.get((ids[i], ids[i + 1])))]
        heapq.heapify(heap)
        while heap:
            _, i, a, b, new = heapq.heappop(heap)
            j = after[i]
            if ids[i] != a or j < 0 or ids[j] != b:
                continue
            ids[i], ids[j], after[i] = new, None, after[j]
            if after[j] >= 0:
                before[after[j]] = i
            for left in (before[i], i):
                right = after[left] if left >= 0 else -1
                if left >= 0 and right >= 0 and (m := merges.get((ids[left], ids[right]))):
                    heapq.heappush(heap, (m[0], left, ids[left], ids[right], m[1]))
        return np.array([i for i in ids if i is not None], "<u4").tobytes()

    def encode_many(self, texts: list[str]) -> list[bytes]:
        """Packed ids of whole texts. Where each space stands between other characters than white space after it, no
        word of the pattern crosses the place before a space, so a text falls into chunks that are looked up whole."""
        cut: list[list[str]] = []
        for text in texts:
            special = self.cut is not None and any(x in text for x in self.special)
            pieces: list[str] = []
            for piece in self.cut.split(text) if special else [text]:
                if special and piece in self.special:
                    pieces.append("\0" + piece)  # a chunk begins with no such character by the way it is made below
                elif CROWDED.search(piece) or "\0" in piece:
                    pieces.append("\1" + piece)
                else:
                    first, *rest = piece.split(" ")
                    pieces.append("\1" + first)
                    pieces += rest
            cut.append(pieces)
        if len(self.chunks) >= REMEMBERED:
            self.chunks.clear()
        self._learn(list(set().union(*cut).difference(self.chunks)))
        get = self.chunks.__getitem__
        return [b"".join(map(get, pieces)) for pieces in cut]

    def _learn(self, chunks: list[str]) -> None:
        """Adds chunks. Letters alone, or with one other mark behind them, need no pattern: they are one word, or two."""
        plain, others, marked = [], [], []
        for c in chunks:
            if c.isalpha():
                plain.append(c)
            elif c[:-1].isalpha() and c[-1] in ".,;:!?":
                marked.append(c)
            else:
                others.append(c)
        find = self.words.findall
        found = [[] if c[:1] == "\0" else find(c[1:]) if c[:1] == "\1" else find(" " + c) for c in others]
        known = self.chunks
        stems = list({c[:-1] for c in marked}.difference(known, plain))
        loose = list(set().union(*found))
        ids = self._merged([" " + c for c in plain] + [" " + c for c in stems] + loose)
        known.update(zip(plain, ids))
        known.update(zip(stems, ids[len(plain) :]))
        marks = {m: self.byte_ids[ord(m) : ord(m) + 1].astype("<u4").tobytes() for m in ".,;:!?"}
        known.update({c: known[c[:-1]] + marks[c[-1]] for c in marked})
        of = dict(zip(loose, ids[len(plain) + len(stems) :]))
        for chunk, own in zip(others, found, strict=True):
            known[chunk] = struct.pack("<I", self.special[chunk[1:]]) if chunk[:1] == "\0" else b"".join([of[w] for w in own])

    def _merged(self, words: list[str]) -> list[bytes]:
        data = [w.encode() for w in words]
        short = [i for i, d in enumerate(data) if len(d) <= SHORT]
        if len(short) == len(data):
            return self.merge_short(data)
        out = [b"" if len(d) <= SHORT else self.merge_long(d) for d in data]
        for i, x in zip(short, self.merge_short([data[i] for i in short])):
            out[i] = x
        return out

    def encode(self, text: str) -> bytes:
        return self.encode_many([text])[0]

    def decode(self, ids: bytes) -> str:
        return b"".join(map(self.pieces.__getitem__, np.frombuffer(ids, "<u4").tolist())).decode("utf-8", "replace")


@lru_cache(maxsize=2)
def vocabulary(path: str) -> Vocabulary:
    return Vocabulary(path)


IDS, TEXT = (T.BinaryType(), pa.binary()), (T.StringType(), pa.string())


def _mapped(df: DataFrame, source: Column, added: dict[str, tuple], f, keep: list[str] | None = None) -> DataFrame:
    """df (or its columns in keep) with the columns that f makes, a list for each, of a list of source's values; no shuffle."""
    kept = [c for c in (df.columns if keep is None else keep) if c not in added]
    schema = T.StructType([*(df.schema[c] for c in kept), *(T.StructField(n, kind) for n, (kind, _) in added.items())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in sliced(batches, 512):
            made = f(part.column("__in").to_pylist())
            yield pa.RecordBatch.from_arrays([*(part.column(c) for c in kept), *(pa.array(x, type=arrow) for x, (_, arrow) in zip(made, added.values()))], [*kept, *added])

    return df.select(*kept, source.alias("__in")).mapInArrow(run, schema)


def encode(df: DataFrame, path: str, text: str = "text", ids: str = "ids") -> DataFrame:
    """df with the ids of its texts as packed little-endian unsigned 32-bit integers (`unpacked` makes an array)."""
    return _mapped(df, F.coalesce(F.col(text).cast("string"), F.lit("")), {ids: IDS}, lambda texts: [vocabulary(path).encode_many(texts)])


def decode(df: DataFrame, path: str, ids: str = "ids", text: str = "decoded") -> DataFrame:
    """df with the text that its packed ids stand for; bytes that are no UTF-8 become U+FFFD."""
    return _mapped(df, F.coalesce(F.col(ids), F.lit(b"")), {text: TEXT}, lambda packed: [[vocabulary(path).decode(x) for x in packed]])


def round_trip(df: DataFrame, path: str, text: str = "text", ids: str = "ids", decoded: str = "decoded", keep: list[str] | None = None) -> DataFrame:
    """df (or its columns in keep) with its texts' packed ids and what those decode to, in one pass: one worker and one
    vocabulary for both."""

    def both(texts: list[str]) -> list[list]:
        packed = vocabulary(path).encode_many(texts)
        return [packed, [vocabulary(path).decode(x) for x in packed]]

    return _mapped(df, F.coalesce(F.col(text).cast("string"), F.lit("")), {ids: IDS, decoded: TEXT}, both, keep)


def unpacked(ids: Column) -> Column:
    """Packed ids as array<bigint>, with JVM functions."""
    n = (F.octet_length(ids) / 4).cast("int")
    last_first = lambda i: F.concat(*(F.hex(F.substring(ids, i * 4 + k, F.lit(1))) for k in (4, 3, 2, 1)))
    return F.transform(F.when(n > 0, F.sequence(F.lit(0), n - 1)).otherwise(F.array().cast("array<int>")), lambda i: F.conv(last_first(i), 16, 10).cast("long"))


def vocabulary_path(name: str = "byte_bpe_50k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def digests(coded: DataFrame, *more: str) -> DataFrame:
    return coded.select("doc_id", (F.octet_length("ids") / 4).cast("long").alias("n_tokens"), F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"), *more)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = vocabulary_path()
    return digests(round_trip(documents(spark, sf_dir).select("doc_id", "text"), path, keep=["doc_id"]))


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Last pipeline stage: for each row of the mix its number of ids, their digest, the digest of the decoded text, and the
    ids themselves, packed as little-endian unsigned 32-bit integers."""
    path = vocabulary_path()
    return digests(round_trip(docs.select("doc_id", "text"), path, keep=["doc_id"]), "ids")
