"""Suffix-array deduplication: bytes covered by a string of WIDTH bytes that also starts in an earlier document.

A sparse suffix array. Every WIDTH-byte window has an anchor, the K-byte gram with the smallest hash in it (leftmost of
equals), so equal windows have equal anchors at equal places. Only suffixes that start at anchors are sorted, and each
carries the stretch of its document whose windows have that anchor.

1. Anchors. Map tasks make runs of 40-bit anchor marks, sorted and delta-coded, and send each bucket of the mark range its
   piece, without the texts' names: marks and how many texts of the run have them. A bucket answers each run with two bits
   for a mark: whether it lies in two texts, and whether it is common. The answer meets the run's own list of which text
   has which mark, so a phrase that stands in every text costs its bucket one entry for each run. A mark that is alone
   can't be in any repeated window; one that only copies of one text have may be flagged, which costs little.
2. Runs. Where its text lies, each flagged anchor becomes an entry: the suffix from the anchor, then what stands before
   it, reversed. A task sorts its entries, folds equal ones to one with the smallest document id, and writes sorted runs
   for each bucket, front-coded: the length shared with the entry before, and the rest. Marks found in more than HOT
   texts are written window by window, by window hash, so that no bucket gathers all contexts of a common phrase.
3. Merge. A bucket's runs are combined by a loser tree. Each contender holds the length it shares with the last winner;
   unequal lengths decide a match without looking at bytes, equal lengths compare from there on, so known prefixes are
   never compared again. Neighbours that share K bytes or more share an anchor; their windows are told apart, and each
   window gets the smallest document id it starts in. The answer returns to the run that asked.
4. Spans. Windows whose smallest document is earlier are joined to spans and cut from the texts.

Whole copies of a text are known by digest beforehand: all but the smallest id are covered entirely, so a text with a
third of all rows is sorted once.

Defined cases: null text counts as empty; a text shorter than WIDTH loses nothing; rows with equal ids are no reason to
remove from one another; a null id counts as smaller than any; empty tables give empty results; texts of any length are
read whole, in pieces that overlap by a window.
"""

from __future__ import annotations

from array import array
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from numpy.lib.stride_tricks import sliding_window_view
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import documents, drop_written, mixed, sliced, written

WIDTH, K = 50, 24
SPAN = WIDTH - K + 1
#: Bytes of an entry at most: a suffix, 255, what stands before, and a length.
ENTRY = WIDTH + SPAN + 1
#: Bytes of text worked on at once, entries in a run, bytes of text for a bucket, and texts that make a mark common.
PIECE, RUN, BUCKET_BYTES, HOT = 60_000, 250_000, 12_000_000, 2000
#: Marks and texts in a run of marks, and bytes of text for a bucket of marks.
SEND, NAMES, MARK_BYTES = 500_000, 1_000_000, 12_000_000
#: Rows of a batch that are worked on at once, which bounds a worker's memory and changes no result.
ROWS = 1500
#: Entries of a group up to which each is laid beside each, rather than all their windows in a table; it changes no result.
FEW = 6
LOWEST = -(1 << 63)
_BASE, _SPREAD = 0x9E3779B97F4A7C15, 0x9E3779B97F


def gram_marks(data: np.ndarray, k: int) -> np.ndarray:
    """40-bit marks of all k-byte grams: rolling hashes put together from powers of two, then mixed."""
    cur, size, out, got, left = data.astype(np.uint64) + np.uint64(1), 1, None, 0, k
    while left:
        if left & 1:
            if out is None:
                out, got = cur, size
            else:
                n = len(out) - size
                out = out[:n] * np.uint64(pow(_BASE, size, 1 << 64)) + cur[got : got + n]
                got += size
        left >>= 1
        if left:
            cur = cur[:-size] * np.uint64(pow(_BASE, size, 1 << 64)) + cur[size:]
            size *= 2
    return mixed(out) >> np.uint64(24)


def window_marks(data: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """What gram_marks gives for the WIDTH-byte windows at some starts."""
    powers = np.array([pow(_BASE, WIDTH - 1 - i, 1 << 64) for i in range(WIDTH)], np.uint64)
    out = np.zeros(len(starts), np.uint64)
    for i in range(WIDTH):
        out += (data[starts + i].astype(np.uint64) + np.uint64(1)) * powers[i]
    return mixed(out) >> np.uint64(24)


def anchors(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, ...]:
    """Of texts laid end to end in data: for each anchor its mark, place, first and last window, and text number."""
    nothing = tuple(np.empty(0, np.int64) for _ in range(5))
    if len(data) < WIDTH:
        return nothing
    marks = gram_marks(data, K)
    least = (marks << np.uint64(24)) | np.arange(len(marks), dtype=np.uint64)
    size = 1
    while 2 * size <= SPAN:
        least = np.minimum(least[:-size], least[size:])
        size *= 2
    least = np.minimum(least[: len(data) - WIDTH + 1], least[SPAN - size :][: len(data) - WIDTH + 1])
    owner = np.repeat(np.arange(len(starts)), ends - starts)
    windows = np.flatnonzero(np.arange(WIDTH, len(data) + 1) <= ends[owner[: len(data) - WIDTH + 1]])
    if not len(windows):
        return nothing
    at = (least[windows] & np.uint64((1 << 24) - 1)).astype(np.int64)
    own = owner[windows]
    first = np.flatnonzero(np.r_[True, (at[1:] != at[:-1]) | (own[1:] != own[:-1])])
    last = np.r_[first[1:], len(windows)] - 1
    # anchors have small marks, being the smallest of a window; a bijection spreads them over the range that buckets share
    return (marks[at[first]] * np.uint64(_SPREAD)) & np.uint64((1 << 40) - 1), at[first], windows[first], windows[last], own[first]


def pieces(texts: list[bytes]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """(data, starts, ends, number of each text, offset in it), of about PIECE bytes each. A text that is longer is cut
    into parts that overlap by WIDTH - 1, so that every window lies in one part."""
    held, size = [], 0
    for i, text in enumerate(texts):
        for offset in range(0, max(1, len(text) - WIDTH + 1), PIECE):
            part = text[offset : offset + PIECE + WIDTH - 1]
            if held and size + len(part) > PIECE:
                yield _laid(held)
                held, size = [], 0
            held.append((i, offset, part))
            size += len(part)
    if held:
        yield _laid(held)


def _laid(held: list) -> tuple[np.ndarray, ...]:
    ends = np.cumsum([len(p) for _, _, p in held])
    return np.frombuffer(b"".join(p for _, _, p in held), np.uint8), ends - [len(p) for _, _, p in held], ends, np.array([i for i, _, _ in held]), np.array([o for _, o, _ in held])


def _sliced(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    return sliced(batches, ROWS)


def _bucket(marks: np.ndarray, buckets: int) -> np.ndarray:
    return (marks.astype(np.uint64) * np.uint64(buckets) >> np.uint64(40)).astype(np.int64)


def _coded(marks: np.ndarray) -> bytes:
    """Sorted marks as differences: their number, those above 32 bits with their places, and the others."""
    deltas = np.diff(marks, prepend=np.uint64(0))
    wide = np.flatnonzero(deltas >> np.uint64(32))
    return np.array([len(marks), len(wide)], np.int64).tobytes() + wide.astype(np.int64).tobytes() + deltas[wide].tobytes() + zstandard.ZstdCompressor(level=1).compress(deltas.astype(np.uint32).tobytes())


def _marks_of(coded: bytes) -> np.ndarray:
    n, n_wide = np.frombuffer(coded, np.int64, 2)
    wide, values = np.frombuffer(coded, np.int64, n_wide, 16), np.frombuffer(coded, np.uint64, n_wide, 16 + 8 * n_wide)
    deltas = np.frombuffer(zstandard.ZstdDecompressor().decompress(coded[16 + 16 * n_wide :]), np.uint32, n).astype(np.uint64)
    deltas[wide] = values
    return np.cumsum(deltas, dtype=np.uint64)


def _times(many: bytes, n: int) -> np.ndarray:
    """How many texts of a run have each of its n marks: one, but for those told."""
    times = np.ones(n, np.int32)
    told = np.frombuffer(many, np.uint32).reshape(-1, 2)
    times[told[:, 0]] = told[:, 1]
    return times


def mark_runs(texts: DataFrame, buckets: int) -> DataFrame:
    """(run_id, bucket, marks, many, owners) of texts (h, text): a run's marks by bucket, and in bucket -1 the texts' h."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        press, seen = zstandard.ZstdCompressor(level=1), set()
        held: list[tuple[np.ndarray, np.ndarray, int]] = []
        names: list[int] = []

        def told() -> pa.RecordBatch:
            both = np.sort(np.concatenate([m.astype(np.uint64) << np.uint64(24) | (own + base).astype(np.uint64) for m, own, base in held]))  # NAMES and a slice's rows are fewer than 2 ** 24
            both = both[np.r_[True, both[1:] != both[:-1]]]  # np.unique would hash, which is several times slower
            hashes = np.array(names, np.int64).tobytes()
            held.clear()
            names.clear()
            run_id = xxhash.xxh3_64_intdigest(both.tobytes() + hashes) >> 1
            marks, owners = both >> np.uint64(24), (both & np.uint64((1 << 24) - 1)).astype(np.uint32)
            first = np.flatnonzero(np.r_[True, marks[1:] != marks[:-1]])
            ends, marks = np.r_[first[1:], len(marks)], marks[first]
            cuts = np.searchsorted(_bucket(marks, buckets), np.arange(buckets + 1))
            out = [(run_id, -1, hashes, b"", b"")]
            for b in np.flatnonzero(np.diff(cuts)).tolist():
                mine = slice(cuts[b], cuts[b + 1])
                times = (ends - first)[mine]
                at = np.flatnonzero(times > 1)
                many = np.stack([at, times[at]], axis=1).astype(np.uint32).tobytes()
                out.append((run_id, b, _coded(marks[mine]), many, press.compress(owners[first[mine.start] : ends[mine.stop - 1]].tobytes())))
            return pa.RecordBatch.from_arrays([pa.array([x[i] for x in out], t) for i, t in enumerate((pa.int64(), pa.int32(), pa.binary(), pa.binary(), pa.binary()))], ["run_id", "bucket", "marks", "many", "owners"])

        size = 0
        for batch in _sliced(batches):
            rows = [(h, t) for h, t in zip(batch.column("h").to_pylist(), batch.column("text").cast(pa.binary()).to_pylist()) if h not in seen and not seen.add(h)]
            for data, starts, ends, number, _ in pieces([t for _, t in rows]):
                marks, _, _, _, own = anchors(data, starts, ends)
                if len(marks):
                    held.append((marks, number[own], len(names)))
                    size += len(marks)
            names += [h for h, _ in rows]
            if not held:
                names.clear()  # none of these texts has a mark
            elif size >= SEND or len(names) >= NAMES:
                yield told()
                size = 0
            if len(seen) > 500_000:
                seen.clear()
        if held:
            yield told()

    return written(texts.select("h", "text").mapInArrow(run, "run_id long, bucket int, marks binary, many binary, owners binary"), "marks")


def mark_answers(runs: DataFrame) -> DataFrame:
    """(run_id, bucket, answer) of mark_runs: for each mark of the run there a bit whether two texts have it, and one whether
    more than HOT have."""

    def answer(rows: list) -> Iterator[pa.RecordBatch]:
        ids = [(r, b) for r, b, _, _ in rows]
        got = [_marks_of(m) for _, _, m, _ in rows]
        times = np.concatenate([_times(many, len(m)) for m, (_, _, _, many) in zip(got, rows)])
        rows.clear()
        sizes = [len(m) for m in got]
        marks = np.concatenate(got)
        del got
        order = np.argsort(marks, kind="stable").astype(np.int32)
        marks = marks[order]
        first = np.flatnonzero(np.r_[True, marks[1:] != marks[:-1]])
        del marks
        total = np.add.reduceat(times[order], first)
        told = np.empty(len(order), np.uint8)
        told[order] = np.repeat(((total > 1) + 2 * (total > HOT)).astype(np.uint8), np.diff(np.r_[first, len(order)]))
        out = [np.packbits(part & 1).tobytes() + np.packbits(part >> 1).tobytes() for part in np.split(told, np.cumsum(sizes)[:-1])]
        yield pa.RecordBatch.from_arrays([pa.array([x for x, _ in ids], pa.int64()), pa.array([x for _, x in ids], pa.int32()), pa.array(out, pa.binary())], ["run_id", "bucket", "answer"])

    sent = runs.filter("bucket >= 0").select("bucket", "run_id", F.col("bucket").alias("bucket_no"), "marks", "many")
    return sent.repartition("bucket").sortWithinPartitions("bucket").mapInArrow(lambda batches: _each_bucket(batches, ("run_id", "bucket_no", "marks", "many"), answer), "run_id long, bucket int, answer binary")


def flagged_marks(runs: DataFrame, answers: DataFrame) -> DataFrame:
    """(h, marks): for each text its marks that lie in another text too, packed as mark * 2 + (1 if common). What a run asked
    and what its buckets answer meet by run, so a text gets one row, however many buckets there are."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unpress = zstandard.ZstdDecompressor()
        now, names, asked = None, np.empty(0, np.int64), None
        held: list[tuple[np.ndarray, np.ndarray]] = []

        def told() -> Iterator[pa.RecordBatch]:
            if not held:
                return
            value, owner = np.concatenate([v for v, _ in held]), np.concatenate([o for _, o in held])
            held.clear()
            order = np.argsort(owner, kind="stable")
            value, owner = value[order], owner[order]
            first = np.flatnonzero(np.r_[True, owner[1:] != owner[:-1]])
            data, ends = value.tobytes(), np.r_[first[1:], len(owner)]
            for at in range(0, len(first), 2_000):
                part = [data[8 * a : 8 * b] for a, b in zip(first[at : at + 2_000].tolist(), ends[at : at + 2_000].tolist())]
                yield pa.RecordBatch.from_arrays([pa.array(names[owner[first[at : at + 2_000]]], pa.int64()), pa.array(part, pa.binary())], ["h", "marks"])

        for batch in batches:
            own = [batch.column(c) for c in ("marks", "many", "owners", "answer")]
            for i, (run_id, bucket, side) in enumerate(zip(*(batch.column(c).to_pylist() for c in ("run_id", "bucket", "side")))):
                marks, many, owners, bits = (c[i].as_py() for c in own)
                if bucket < 0:
                    if run_id != now:
                        yield from told()
                        now = run_id
                    names = np.frombuffer(marks, np.int64)
                elif side == 0:
                    asked = bucket, marks, many, owners
                elif asked is not None and asked[0] == bucket:
                    known = _marks_of(asked[1])
                    n = len(known)
                    flags = np.unpackbits(np.frombuffer(bits, np.uint8).reshape(2, -1), axis=1)[:, :n]
                    times = _times(asked[2], n)
                    keep = np.repeat(flags[0].astype(bool), times)
                    held.append((np.repeat(known * np.uint64(2) + flags[1], times)[keep], np.frombuffer(unpress.decompress(asked[3]), np.uint32)[keep]))
                    asked = None
        yield from told()

    none = F.lit(None).cast("binary")
    both = runs.select("run_id", "bucket", F.lit(0).alias("side"), "marks", "many", "owners", none.alias("answer")).unionByName(answers.select("run_id", "bucket", F.lit(1).alias("side"), none.alias("marks"), none.alias("many"), none.alias("owners"), "answer"))
    found = both.repartition("run_id").sortWithinPartitions("run_id", "bucket", "side").mapInArrow(run, "h long, marks binary")
    return found.groupBy("h").agg(F.first("marks").alias("marks"))  # copies of a text get the same answer in every run


def _each_bucket(batches: Iterator[pa.RecordBatch], columns: tuple[str, ...], work) -> Iterator[pa.RecordBatch]:
    """work(rows of one bucket), bucket by bucket, of batches sorted by bucket."""
    held, now = [], None
    for batch in batches:
        own = [batch.column(c) for c in columns]
        for i, bucket in enumerate(batch.column("bucket").to_pylist()):
            row = [c[i].as_py() for c in own]  # a run at a time: a batch may hold many large ones
            if bucket != now and held:
                yield from work(held)
                held = []
            now = bucket
            held.append(row)
    if held:
        yield from work(held)


def front_coded(entries: list[bytes]) -> bytes:
    """Sorted entries as shared lengths, lengths of the rest, and the rests."""
    n, width = len(entries), max(map(len, entries))
    sizes = np.fromiter(map(len, entries), np.int64, n)
    table = np.frombuffer(b"".join(e.ljust(width, b"\0") for e in entries), np.uint8).reshape(n, width)
    same = np.ones((n - 1, width + 1), bool)
    same[:, :-1] = table[1:] == table[:-1]
    same[:, -1] = False
    shared = np.r_[0, np.minimum(same.argmin(axis=1), np.minimum(sizes[1:], sizes[:-1]))]
    rests = b"".join(e[s:] for e, s in zip(entries, shared.tolist()))
    return np.array([n], np.int64).tobytes() + shared.astype(np.uint8).tobytes() + (sizes - shared).astype(np.uint8).tobytes() + rests


def unpacked(coded: bytes) -> tuple[list[int], list[bytes]]:
    """Shared lengths and whole entries of a front-coded run."""
    n = int(np.frombuffer(coded, np.int64, 1)[0])
    shared, rest = coded[8 : 8 + n], coded[8 + n : 8 + 2 * n]
    at, entries, entry = 8 + 2 * n, [], b""
    for s, r in zip(shared, rest):
        entry = entry[:s] + coded[at : at + r]
        at += r
        entries.append(entry)
    return list(shared), entries


def merged(runs: list[tuple[list[int], list[bytes]]]) -> Iterator[tuple[int, int, int, bytes]]:
    """(run, place in it, length shared with the entry before, entry) in order, by a loser tree over sorted runs.

    shared[c] is what contender c has in common with the last winner; a match is decided by it alone where two
    contenders differ in it, and otherwise looks at the bytes from there on only.
    """
    k = 1
    while k < len(runs):
        k *= 2
    place = [0] * k
    entries = [r[1] for r in runs]
    heads: list[bytes | None] = [e[0] if e else None for e in entries] + [None] * (k - len(runs))
    shared = [0 if h is not None else -1 for h in heads]
    losers = [0] * k

    def match(a: int, b: int) -> tuple[int, int]:
        """(winner, loser); sets the loser's shared length with the winner."""
        if shared[a] != shared[b]:
            return (a, b) if shared[a] > shared[b] else (b, a)
        x, y = heads[a], heads[b]
        if x is None:
            return a, b
        i = shared[a]
        if x == y:
            shared[b] = len(y)
            return a, b
        n = min(len(x), len(y))
        while i + 8 <= n and x[i : i + 8] == y[i : i + 8]:
            i += 8
        while i < n and x[i] == y[i]:
            i += 1
        if x[i:] < y[i:]:
            shared[b] = i
            return a, b
        shared[a] = i
        return b, a

    winners = list(range(k)) if k > 1 else [0]
    level = winners
    nodes = k
    while len(level) > 1:
        nodes //= 2
        up = []
        for j in range(nodes):
            w, losers[nodes + j] = match(level[2 * j], level[2 * j + 1])
            up.append(w)
        level = up
    w = level[0]
    while heads[w] is not None:
        yield w, place[w], shared[w], heads[w]
        at = place[w] = place[w] + 1
        if at < len(entries[w]):
            x, mine = entries[w][at], runs[w][0][at]
        else:
            x, mine = None, -1
        heads[w], shared[w] = x, mine
        node = (w + k) // 2
        while node:
            other = losers[node]
            if shared[other] > mine:
                losers[node], w = w, other
                x, mine = heads[w], shared[w]
            elif shared[other] == mine and x is not None:
                won, losers[node] = match(w, other)
                if won != w:
                    w = won
                    x, mine = heads[w], shared[w]
            node //= 2


def entries_of(data: np.ndarray, at: np.ndarray, first: np.ndarray, last: np.ndarray) -> np.ndarray:
    """A row of ENTRY bytes, zeros behind it, for each anchor: the suffix from it to the end of its last window, 255, what
    stands before it from its first window on, reversed, and the suffix's length. That length is no zero, so rows are in the
    order of the entries, and equal where those are."""
    out, size, before = np.zeros((len(at), ENTRY), np.uint8), last - at + WIDTH, at - first
    right = sliding_window_view(np.concatenate([data, np.zeros(WIDTH, np.uint8)]), WIDTH)[at]
    left = sliding_window_view(np.concatenate([data[::-1], np.zeros(SPAN, np.uint8)]), SPAN - 1)[len(data) - at]
    left[np.arange(SPAN - 1) >= before[:, None]] = 0
    for n in np.unique(size).tolist():
        rows = np.flatnonzero(size == n)
        out[rows, :n] = right[rows, :n]
        out[rows, n] = 255
        out[rows, n + 1 : n + SPAN] = left[rows]
    out[np.arange(len(at)), size + before + 1] = size
    return out


def write_runs(rows: DataFrame, buckets: int) -> DataFrame:
    """(run_id, bucket, entries, least, refs) of rows (doc_id, h, text, marks)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: list[tuple[np.ndarray, ...]] = []  # bucket, entry, document number, first window, windows
        docs: list[tuple[int, int]] = []
        size = 0
        for batch in _sliced(batches):
            ids, hashes, own_marks = (batch.column(c).to_pylist() for c in ("doc_id", "h", "marks"))
            for data, starts, ends, number, offset in pieces(batch.column("text").cast(pa.binary()).to_pylist()):
                mark, at, first, last, own = anchors(data, starts, ends)
                flags = [np.frombuffer(own_marks[i], np.uint64) for i in number.tolist()]
                # flags of a piece's texts one after the other; a mark is looked for among those of its text
                text = np.repeat(np.arange(len(flags), dtype=np.uint64), [len(x) for x in flags]) << np.uint64(41)
                known = np.sort(np.concatenate([*flags, np.empty(0, np.uint64)]) | text)
                asked = (own.astype(np.uint64) << np.uint64(41)) | (mark * np.uint64(2))
                place = np.minimum(np.searchsorted(known, asked), max(len(known) - 1, 0))
                hit = np.flatnonzero(known[place] >> np.uint64(1) == asked >> np.uint64(1)) if len(known) else place[:0]
                common = (known[place[hit]] & np.uint64(1)).astype(bool)
                hot, hit = hit[common], hit[~common]
                # a common mark's windows go one by one, as suffixes of their own
                many = last[hot] - first[hot] + 1
                each = np.repeat(first[hot] - np.cumsum(many) + many, many) + np.arange(many.sum())
                to = _bucket(mark[hit], buckets)
                if len(each):
                    to = np.concatenate([to, _bucket(window_marks(data, each), buckets)])
                at, f, z = (np.concatenate([x, each]) for x in (at[hit], first[hit], last[hit]))
                part = np.concatenate([own[hit], np.repeat(own[hot], many)])
                done, shift = 0, (offset - starts)[part]
                numbers = len(docs) + number - (number[0] if len(number) else 0)
                docs += [(ids[i], hashes[i]) for i in range(number[0], number[-1] + 1)]
                while done < len(at):
                    now = slice(done, done + RUN - size)
                    found.append((to[now], entries_of(data, at[now], f[now], z[now]), numbers[part[now]], (f + shift)[now], (z - f + 1)[now]))
                    size += len(found[-1][0])
                    done += len(found[-1][0])
                    if size >= RUN:  # within a text too, whose rest begins another run
                        yield packed(found, docs)
                        # what is left of this piece is numbered anew
                        numbers = numbers - numbers[0]
                        found, docs, size = [], docs[len(docs) - (number[-1] - number[0] + 1) :], 0
        if found:
            yield packed(found, docs)

    def packed(found: list, docs: list) -> pa.RecordBatch:
        press = zstandard.ZstdCompressor(level=3)
        to, entries, number, window, count = (np.concatenate(x) for x in zip(*found))
        found.clear()
        order = np.argsort(entries.view(f"S{ENTRY}").ravel(), kind="stable")
        order = order[np.argsort(to[order], kind="stable")]
        to, entries, number, window, count = to[order], entries[order], number[order], window[order], count[order]
        name = xxhash.xxh3_64_intdigest(repr((docs[0], docs[-1], len(docs))).encode() + entries.tobytes() + number.tobytes() + window.tobytes()) >> 1
        # equal entries of a bucket are one
        same = np.zeros((len(entries), ENTRY + 1), bool)
        np.equal(entries[1:], entries[:-1], out=same[1:, :-1])
        shared = same.argmin(axis=1)
        new = np.r_[True, to[1:] != to[:-1]]
        first = np.flatnonzero(new | (shared < ENTRY))
        shared = np.where(new, 0, shared)[first]
        times, counts, entries, of = np.diff(np.r_[first, len(to)]), count[first], entries[first], to[first]
        long = ENTRY - (entries[:, ::-1] != 0).argmax(axis=1)
        shared = np.minimum(shared, np.minimum(long, np.r_[0, long[:-1]]))
        places = np.arange(ENTRY)
        rests = entries[(places >= shared[:, None]) & (places < long[:, None])].tobytes()
        ends = np.r_[0, np.cumsum(long - shared)]
        shared, rest = shared.astype(np.uint8), (long - shared).astype(np.uint8)
        docs_ids, docs_h = np.array([d for d, _ in docs], np.int64), np.array([h for _, h in docs], np.int64)
        least = np.minimum.reduceat(docs_ids[number], first)
        cuts = [*np.flatnonzero(np.r_[True, of[1:] != of[:-1]]).tolist(), len(of)]
        first = [*first.tolist(), len(to)]
        out = []
        for a, b in zip(cuts, cuts[1:]):
            rows = slice(first[a], first[b])
            names, index = np.unique(number[rows], return_inverse=True)
            refs = (
                np.array([len(names), b - a, len(index)], np.int64).tobytes() + docs_ids[names].tobytes() + docs_h[names].tobytes()
                + times[a:b].astype(np.uint32).tobytes() + counts[a:b].astype(np.uint32).tobytes() + index.astype(np.uint32).tobytes() + window[rows].astype(np.uint64).tobytes()
            )
            coded = np.array([b - a], np.int64).tobytes() + shared[a:b].tobytes() + rest[a:b].tobytes() + rests[ends[a] : ends[b]]
            out.append((name, int(of[a]), press.compress(coded), press.compress(least[a:b].tobytes()), press.compress(refs)))
        return pa.RecordBatch.from_arrays([pa.array([x[i] for x in out], t) for i, t in enumerate((pa.int64(), pa.int32(), pa.binary(), pa.binary(), pa.binary()))], ["run_id", "bucket", "entries", "least", "refs"])

    return written(rows.mapInArrow(run, "run_id long, bucket int, entries binary, least binary, refs binary"), "runs")


def _windows(entry: bytes) -> list[bytes]:
    n = entry[-1]
    whole = entry[n + 1 : -1][::-1] + entry[:n]
    return [whole[i : i + WIDTH] for i in range(len(whole) - WIDTH + 1)]


def _lengths(docs: Iterable[int]) -> tuple[list[int], list[int]]:
    size, doc = [], []
    for low in docs:
        if doc and doc[-1] == low:
            size[-1] += 1
        else:
            size.append(1)
            doc.append(low)
    return size, doc


def _nearer(group: list, lows: list[int], j: int) -> tuple[list[int], list[int]]:
    """The smallest document of each window of entry j of a group, as run lengths, by what it has in common with the others.
    A window that begins l bytes before the anchor is another entry's too if l bytes before it and WIDTH - l from it on are."""
    entry, low = group[j][0], lows[j]
    n = entry[-1]
    left, before = entry[n + 1 : -1], len(entry) - n - 2
    found = []
    for step in (-1, 1):
        common, at = n, j + step
        while 0 <= at < len(group):
            common = min(common, group[at + 1 if step < 0 else at][2])
            if lows[at] < low:
                other = group[at][0]
                m = other[-1]
                there = other[m + 1 : -1]
                most = min(before, len(there))
                if left[:most] != there[:most]:
                    most = next(i for i in range(most) if left[i] != there[i])
                if most >= WIDTH - common:
                    found.append((lows[at], before - most, before - WIDTH + common + 1))
            at += step
    if not found:
        return [255], [low]
    docs = [low] * (before + n - WIDTH + 1)
    for told, a, b in sorted(found, reverse=True):
        docs[a:b] = [told] * (b - a)
    return _lengths(docs)


def merge_runs(runs: DataFrame) -> DataFrame:
    """(run_id, bucket, answer): for each entry of the run the smallest document of each of its windows, as run lengths."""

    def work(rows: list) -> Iterator[pa.RecordBatch]:
        rows.sort(key=lambda r: r[0])
        unpress, press = zstandard.ZstdDecompressor(), zstandard.ZstdCompressor(level=3)
        least = [np.frombuffer(unpress.decompress(r[3]), np.int64).tolist() for r in rows]
        answers = [(array("B"), array("B"), array("q")) for _ in rows]

        def tell(members: list, size: list, doc: list) -> None:
            for r, _ in members:
                times, sizes, docs = answers[r]
                times.append(len(size))
                sizes.extend(size)
                docs.extend(doc)

        def settle(group: list) -> None:
            """group: entries that share an anchor, each with its members (run, place) and what it shares with the one before."""
            lows = [min([least[r][i] for r, i in members]) for _, members, _ in group]
            if len(group) <= FEW:
                for j, (entry, members, _) in enumerate(group):
                    tell(members, *(([255], [lows[j]]) if lows[j] == min(lows) else _nearer(group, lows, j)))
                return
            smallest: dict[bytes, int] = {}
            known = []
            for low, (entry, _, _) in zip(lows, group):
                own = _windows(entry)
                known.append(own)
                for x in own:
                    old = smallest.get(x)
                    if old is None or low < old:
                        smallest[x] = low
            for (_, members, _), own in zip(group, known):
                tell(members, *_lengths(map(smallest.__getitem__, own)))

        group: list = []
        for r, i, shared, entry in merged([unpacked(unpress.decompress(x[2])) for x in rows]):
            if group and shared >= len(entry) and len(entry) == len(group[-1][0]):
                group[-1][1].append((r, i))
            elif group and shared >= K:
                group.append((entry, [(r, i)], shared))
            else:
                if group:
                    settle(group)
                group = [(entry, [(r, i)], 0)]
        if group:
            settle(group)
        body = [press.compress(np.array([len(t), len(s)], np.int64).tobytes() + t.tobytes() + s.tobytes() + d.tobytes()) for t, s, d in answers]
        yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.int32()), pa.array(body, pa.binary())], ["run_id", "bucket", "answer"])

    def by_bucket(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return _each_bucket(batches, ("run_id", "bucket_no", "entries", "least"), work)

    sent = runs.select("bucket", "run_id", F.col("bucket").alias("bucket_no"), "entries", "least")
    return sent.repartition("bucket").sortWithinPartitions("bucket").mapInArrow(by_bucket, "run_id long, bucket int, answer binary")


def _earlier(refs: bytes, answer: bytes) -> Iterator[tuple[int, int, np.ndarray]]:
    """(doc_id, h, pairs): for each document of one run's bucket its stretches of windows that start in an earlier one."""
    n_docs, n_entries, n_refs = np.frombuffer(refs, np.int64, 3)
    at, parts = 24, []
    for kind, n in ((np.int64, n_docs), (np.int64, n_docs), (np.uint32, n_entries), (np.uint32, n_entries), (np.uint32, n_refs), (np.uint64, n_refs)):
        parts.append(np.frombuffer(refs, kind, n, at))
        at += parts[-1].nbytes
    ids, hashes, times, counts, index, windows = parts
    n, n_sizes = np.frombuffer(answer, np.int64, 2)
    segments = np.frombuffer(answer, np.uint8, n, 16).astype(np.int64)
    sizes = np.frombuffer(answer, np.uint8, n_sizes, 16 + n).astype(np.int64)
    low = np.frombuffer(answer, np.int64, n_sizes, int(16 + n + n_sizes))
    entry_of = np.repeat(np.arange(n), segments)
    sizes = np.minimum(sizes, counts[entry_of])  # 255 stands for all windows of the entry
    shift = np.cumsum(sizes) - sizes
    first_segment = np.cumsum(segments) - segments
    shift = shift - shift[first_segment][entry_of]
    # every ref with every segment of its entry
    of = np.repeat(np.arange(n), times)
    ref = np.repeat(np.arange(n_refs), segments[of])
    seg = np.arange(len(ref)) - np.repeat(np.cumsum(segments[of]) - segments[of], segments[of]) + first_segment[of][ref]
    hit = low[seg] < ids[index[ref]]
    ref, seg = ref[hit], seg[hit]
    start, number, doc = windows[ref].astype(np.int64) + shift[seg], sizes[seg], index[ref]
    order = np.lexsort((start, doc))
    doc, pairs = doc[order], np.stack([start[order], number[order]], axis=1)
    cuts = np.flatnonzero(np.r_[True, doc[1:] != doc[:-1]]) if len(doc) else []
    for a, b in zip(cuts, [*cuts[1:], len(doc)]):
        yield int(ids[doc[a]]), int(hashes[doc[a]]), pairs[a:b]


def removed_windows(runs: DataFrame, answers: DataFrame) -> DataFrame:
    """(doc_id, h, windows): packed (first start, number) of stretches of windows that start in an earlier document.

    What a run asked and what its buckets answer meet by run, so a document gets one row from each run it lies in, however
    many buckets there are.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unpress = zstandard.ZstdDecompressor()
        held: dict[tuple[int, int], list[np.ndarray]] = {}
        now, asked = None, (None, b"")

        def told() -> pa.RecordBatch:
            rows = []
            for (doc_id, h), found in held.items():
                pairs = np.concatenate(found)
                narrow = pairs.max() < 1 << 32
                rows.append((doc_id, h, pairs.astype(np.uint32 if narrow else np.uint64).tobytes() + (b"\4" if narrow else b"\10")))
            held.clear()
            return pa.RecordBatch.from_arrays([pa.array([x[i] for x in rows], t) for i, t in enumerate((pa.int64(), pa.int64(), pa.binary()))], ["doc_id", "h", "windows"])

        for batch in batches:
            for i, (run_id, bucket, side) in enumerate(zip(*(batch.column(c).to_pylist() for c in ("run_id", "bucket", "side")))):
                if run_id != now:
                    yield told()
                    now = run_id
                body = unpress.decompress(batch.column("body")[i].as_py())
                if side == 0:
                    asked = (bucket, body)
                elif asked[0] == bucket:
                    for doc_id, h, pairs in _earlier(asked[1], body):
                        held.setdefault((doc_id, h), []).append(pairs)
        yield told()

    both = runs.select("run_id", "bucket", F.lit(0).alias("side"), F.col("refs").alias("body")).unionByName(answers.select("run_id", "bucket", F.lit(1).alias("side"), F.col("answer").alias("body")))
    return both.repartition("run_id").sortWithinPartitions("run_id", "bucket", "side").mapInArrow(run, "doc_id long, h long, windows binary")


def spans_of(packed: list[bytes], n_bytes: int) -> list[tuple[int, int]]:
    """Maximal removed stretches [start, end) of a document."""
    pairs = np.concatenate([np.frombuffer(p[:-1], np.uint32 if p[-1] == 4 else np.uint64).astype(np.int64).reshape(-1, 2) for p in packed])
    starts, ends = pairs[:, 0], pairs[:, 0] + pairs[:, 1] + WIDTH - 1
    order = np.argsort(starts, kind="stable")
    starts, reach = starts[order], np.maximum.accumulate(ends[order])
    new = np.r_[True, starts[1:] > reach[:-1]]
    return list(zip(starts[new].tolist(), reach[np.r_[np.flatnonzero(new)[1:] - 1, len(starts) - 1]].tolist()))


def deduplicate(docs: DataFrame) -> DataFrame:
    """(doc_id, n_bytes, spans, kept) of every row of docs (doc_id, text): the removed stretches and the bytes left."""
    texts = docs.select(F.coalesce("doc_id", F.lit(LOWEST)).cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text")).withColumn("h", F.xxhash64("text"))
    total = texts.agg(F.sum(F.octet_length("text").cast("long"))).first()[0] or 0
    buckets = max(16, -(-total // BUCKET_BYTES))
    digest = F.unhex(F.sha2("text", 256))
    first = written(texts.select("doc_id", "h", digest.alias("digest")).groupBy("digest").agg(F.min("doc_id").alias("first_id"), F.first("h").alias("h")), "firsts")
    asked = mark_runs(texts, max(16, -(-total // MARK_BYTES)))
    marks = written(flagged_marks(asked, mark_answers(asked)), "flags")
    drop_written(asked)
    flagged = first.select(F.col("first_id").alias("doc_id"), "h").join(marks, "h")
    runs = write_runs(texts.join(flagged, ["doc_id", "h"]).select("doc_id", "h", "text", "marks").dropDuplicates(["doc_id", "h"]), buckets)
    drop_written(marks)
    found = written(removed_windows(runs, merge_runs(runs)).groupBy("doc_id", "h").agg(F.collect_list("windows").alias("windows")), "windows")
    drop_written(runs)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in sliced([batch], 500):
                out = []
                for text, first_id, doc_id, windows in zip(part.column("text").cast(pa.binary()).to_pylist(), *(part.column(c).to_pylist() for c in ("first_id", "doc_id", "windows"))):
                    n = len(text)
                    if first_id < doc_id:
                        spans = [(0, n)] if n >= WIDTH else []
                    else:
                        spans = spans_of(windows, n) if windows else []
                    kept, end = [], 0
                    for a, b in spans:
                        kept.append(text[end:a])
                        end = b
                    kept.append(text[end:])
                    out.append((n, [{"start": a, "end": b} for a, b in spans], b"".join(kept)))
                span = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), *(pa.array([x[i] for x in out], t) for i, t in enumerate((pa.int64(), span, pa.binary())))], ["doc_id", "n_bytes", "spans", "kept"])

    # which text is a row's own, and what its first copy's id is, are small rows; whole texts move in one join
    own = texts.select("doc_id", "h", digest.alias("digest")).join(first.drop("h"), "digest").select("doc_id", "h", "first_id").distinct()
    told = own.join(found, ["doc_id", "h"], "left")
    rows = texts.join(told, ["doc_id", "h"]).select("doc_id", "text", "first_id", "windows")
    out = rows.mapInArrow(cut, "doc_id long, n_bytes long, spans array<struct<start:bigint,end:bigint>>, kept binary")
    return out.withColumn("doc_id", F.nullif("doc_id", F.lit(LOWEST)))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = deduplicate(documents(spark, sf_dir).select("doc_id", "text"))
    removed = F.aggregate("spans", F.lit(0).cast("long"), lambda n, s: n + s.end - s.start)
    return found.select("doc_id", "n_bytes", removed.alias("n_removed"), F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))
