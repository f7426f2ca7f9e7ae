"""N-gram Jaccard join: which documents' sets of word shingles link, and the groups that links form.

1. Sets. A document's set holds 64-bit hashes of its distinct k-word runs. Documents with equal sets form a class, known
   by (size, hash of the set); from here on one document stands for its class, so copies cost nothing.
2. Tiles. Sizes fall in bands. Within a band, sets are cut into the same ranges of the hash space, more ranges than two
   sets that link can differ in elements: most of their ranges are then equal. Two sets that differ in h elements agree
   in all but h ranges, so among a set's h + 1 fullest ranges there is one that the other set has too, and also among its
   own h + 1 fullest. A class goes to the tiles of those: (band, range, hash of what lies in it). Equal ranges hold several
   shingles each, so sets that do not resemble one another hardly ever meet, whatever the number of documents.
3. Stars. In each tile every class is paired with the class that has most company in all its tiles; the one of these that a
   class shares most tiles with is compared exactly. That joins nearly all of a large group without naming its pairs.
4. Nearest. In tiles that still hold more than one component, classes of different components meet through bitmap
   signatures: the bits of one that the other lacks bound the overlap from above. Each class is compared, by intersection
   of sorted arrays, with the one that its bounds leave nearest, which joins nearly all that is left to join.
5. Rest. Classes that had other pairs besides, and still lie in different components, meet once more, and all pairs that
   pass the bounds are compared. Nothing is capped: every pair that could link is in one component already, refused by a
   bound, or compared.

Tiles are never gathered. Their leaders, components and sizes are aggregates that fold in the map tasks, they go back
to the rows by joins that adaptive execution can split, and where classes of one tile meet, CELL of them meet CELL others
in a task of their own.

All steps are shuffles by key; no pairs of equal or already joined documents are made, and no set, link or
component comes to the driver.

Defined cases: null text counts as empty; an empty set links with nothing, so such a document is its own group; a text
of fewer than k words has one shingle, all its words; repeated rows fall in one class; an empty table gives an empty
result.
"""

from __future__ import annotations

from bisect import bisect_right
from collections.abc import Iterator
from functools import lru_cache
from math import ceil

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import WordHashes, documents, drop_written, mixed, shingle_hashes, sliced, written
from .components import components

#: A band's largest size as a power of 1 / t over its smallest, and ranges there are for each that is needed.
STEPS, SPARE = 3, 1.3
#: Stands for a null id within: smaller than any other.
LOWEST = -(1 << 63)
#: Members that one task compares with a leader, and classes of a tile that meet as many others in one task, about.
CHUNK, CELL = 256, 1024


def word_shingles(data: bytes, k: int, table: WordHashes) -> np.ndarray:
    """Sorted distinct shingle hashes of a text's bytes."""
    words = data.lower().split()
    if not words:
        return np.empty(0, np.uint64)
    hashes = table.of(words)
    return shingle_hashes(hashes, len(words)) if len(words) < k else np.unique(shingle_hashes(hashes, k))


def class_of(shingles: np.ndarray) -> int:
    return int(np.uint64(xxhash.xxh3_64_intdigest(shingles.tobytes())).astype(np.int64))


@lru_cache
def band_starts(num: int, den: int) -> list[int]:
    """Smallest size of each band. A set that links with one of band i lies in band i - 1, i or i + 1."""
    starts = [1]
    while starts[-1] < 1 << 40:
        starts.append(max(starts[-1] + 1, starts[-1] * den**STEPS // num**STEPS))
    return starts


def differing(both: int, num: int, den: int) -> int:
    """Elements at most that lie in one only of two linked sets, of so many elements together."""
    return both * (den - num) // (den + num)


@lru_cache(4096)
def range_starts(band: int, num: int, den: int) -> np.ndarray:
    """Where the ranges begin that the sets of a band are cut into."""
    largest = band_starts(num, den)[band + 1] - 1
    ranges = ceil(SPARE * (differing(largest + largest * den // num, num, den) + 1))
    return np.array([(j << 64) // ranges for j in range(ranges)], np.uint64)


def range_tokens(s: np.ndarray, num: int, den: int) -> np.ndarray:
    """The tiles of a sorted set: its fullest ranges in its own band, and in the band below if a set there can link."""
    starts, n = band_starts(num, den), len(s)
    band = bisect_right(starts, n) - 1
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(mixed(s ^ np.uint64(0x5851F42D4C957F2D)), dtype=np.uint64)])
    out = []
    for of, partner in ((band, n * den // num), (band - 1, starts[band] - 1)):
        differ = differing(n + partner, num, den)
        if of < 0 or not differ or n > partner * den // num:
            continue
        at = np.append(np.searchsorted(s, range_starts(of, num, den)), n)
        fullest = np.argsort(-np.diff(at), kind="stable")[: differ + 1]
        out.append(mixed(sums[at[fullest + 1]] - sums[at[fullest]] + mixed(fullest.astype(np.uint64) + np.uint64(of << 32))))
    return np.concatenate(out) if out else np.empty(0, np.uint64)


def _bytes(batch: pa.RecordBatch, name: str) -> list[bytes]:
    return batch.column(name).cast(pa.binary()).to_pylist()


def class_table(docs: DataFrame, k: int, num: int, den: int) -> DataFrame:
    """(doc_id, cid, n, tokens) of every document; tokens: the packed tiles, null where this task has given them for the
    same set already or there are none."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table, seen = WordHashes(), set()
        for batch in sliced(batches):
            cids, sizes, tokens = [], [], []
            for data in _bytes(batch, "text"):
                s = word_shingles(data, k, table)
                n, cid = len(s), class_of(s)
                cids.append(cid)
                sizes.append(n)
                if not n or (n, cid) in seen:
                    tokens.append(None)
                    continue
                if len(seen) > 500_000:
                    seen.clear()
                seen.add((n, cid))
                tokens.append(range_tokens(s, num, den).tobytes() or None)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(cids, pa.int64()), pa.array(sizes, pa.int64()), pa.array(tokens, pa.binary())], ["doc_id", "cid", "n", "tokens"])

    return written(docs.mapInArrow(run, "doc_id long, cid long, n long, tokens binary"), "classes")


def _spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(token, cid) rows of packed tiles."""
    for batch in sliced(batches):
        packed = batch.column("tokens").to_pylist()
        times = np.array([len(p) // 8 for p in packed])
        yield pa.RecordBatch.from_arrays([pa.array(np.frombuffer(b"".join(packed), np.int64)), pa.array(np.repeat(batch.column("cid").to_numpy(), times))], ["token", "cid"])


def shared_tiles(classes: DataFrame) -> DataFrame:
    """(token, cid, m) of tiles with two classes or more: each of their classes once, and about how many the tile has."""
    rows = classes.filter("tokens is not null").select("cid", "tokens").mapInArrow(_spread, "token long, cid long")
    counted = rows.groupBy("token").agg(F.min("cid").alias("low"), F.max("cid").alias("high"), F.count("*").alias("m"))
    return written(rows.join(counted.filter("low < high").select("token", "m"), "token").distinct(), "tiles")


def leader_pairs(tiles: DataFrame) -> DataFrame:
    """(a, b): every class of a shared tile with the one of its tiles' leaders that it shares most tiles with. A tile's leader
    is its class with most company in all its tiles: in a group of near copies, the one nearest to what they come from."""
    company = tiles.groupBy("cid").agg(F.sum("m").alias("company"))
    leaders = tiles.join(company, "cid").groupBy("token").agg(F.max(F.struct("company", "cid")).alias("leader")).select("token", F.col("leader.cid").alias("a"))
    counted = tiles.join(leaders, "token").filter("cid <> a").groupBy("a", F.col("cid").alias("b")).count()
    return counted.groupBy("b").agg(F.max(F.struct("count", "a")).alias("best")).select("best.a", "b")


def signature(s: np.ndarray) -> bytes:
    """Bitmap of a set, with four to eight bits for each shingle."""
    bits = 1 << max(6, int(4 * len(s) - 1).bit_length())
    flags = np.zeros(bits, np.uint8)
    flags[(mixed(s ^ np.uint64(0xA5A5A5A5A5A5A5A5)) & np.uint64(bits - 1)).astype(np.int64)] = 1
    return np.packbits(flags).tobytes()


def _folded(sig: np.ndarray, width: int) -> np.ndarray:
    """A bitmap as if made with fewer bits; bounds stay true."""
    return np.bitwise_or.reduce(sig.reshape(-1, width), axis=0) if len(sig) > width else sig


def payloads(docs: DataFrame, classes: DataFrame, needed: DataFrame, k: int) -> DataFrame:
    """(cid, n, payload, sig) of the classes in needed (cid): the compressed text of one document for each."""

    def press(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pressed = zstandard.ZstdCompressor(level=3)
        for part in sliced(batches):
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(map(pressed.compress, _bytes(part, "text")), pa.binary())], ["doc_id", "payload"])

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table, unpress = WordHashes(), zstandard.ZstdDecompressor()
        for part in sliced(batches):
            rows = []
            for cid, n, payload in zip(*(part.column(c).to_pylist() for c in ("cid", "n", "payload"))):
                s = word_shingles(unpress.decompress(payload), k, table)
                if (len(s), class_of(s)) == (n, cid):  # rows that repeat an id may hold other texts
                    rows.append((cid, n, payload, signature(s)))
            yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in rows], kind) for i, kind in enumerate((pa.int64(), pa.int64(), pa.binary(), pa.binary()))], ["cid", "n", "payload", "sig"])

    stands = classes.join(needed, "cid", "left_semi").groupBy("cid", "n").agg(F.min("doc_id").alias("doc_id"))
    rows = docs.select("doc_id", "text").mapInArrow(press, "doc_id long, payload binary").join(stands, "doc_id")
    return written(rows.select("cid", "n", "payload").mapInArrow(sign, "cid long, n long, payload binary, sig binary"), "payloads")


def compared(pairs: DataFrame, held: DataFrame, k: int, num: int, den: int) -> DataFrame:
    """The links among pairs (a, b), by exact intersection. Members travel to their leader in chunks of CHUNK or so, so a
    leader of any number of members is compared in as many tasks as that takes."""
    pairs = written(pairs, "pairs")  # it is read twice
    counts = pairs.groupBy("a").count().select("a", F.ceil(F.col("count") / CHUNK).cast("int").alias("chunks"))
    members = pairs.join(counts, "a").select("a", (F.abs(F.xxhash64("b")) % F.col("chunks")).cast("int").alias("chunk"), F.lit(1).alias("side"), F.col("b").alias("cid"))
    leaders = counts.select("a", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)).alias("chunk"), F.lit(0).alias("side"), F.col("a").alias("cid"))
    rows = members.unionByName(leaders).join(held.select("cid", "payload"), "cid")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table, unpress = WordHashes(), zstandard.ZstdDecompressor()
        key, own = None, np.empty(0, np.uint64)
        for batch in sliced(batches):
            links = []
            for a, chunk, side, cid, payload in zip(*(batch.column(c).to_pylist() for c in ("a", "chunk", "side", "cid", "payload"))):
                s = word_shingles(unpress.decompress(payload), k, table)
                if side == 0:
                    key, own = (a, chunk), s
                elif key == (a, chunk):
                    both = len(np.intersect1d(own, s, assume_unique=True))
                    if den * both >= num * (len(own) + len(s) - both):
                        links.append((a, cid))
            yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in links], pa.int64()) for i in (0, 1)], ["a", "b"])

    links = written(rows.repartition("a", "chunk").sortWithinPartitions("a", "chunk", "side").mapInArrow(run, "a long, b long"), "links")
    drop_written(pairs)
    return links


def _cells(batches: Iterator[pa.RecordBatch]) -> Iterator[pd.DataFrame]:
    """Whole cells of rows sorted by cell, many to a frame; a cell that spans batches is put together."""
    rest: list[pd.DataFrame] = []
    for batch in batches:
        pdf = batch.to_pandas()
        if not len(pdf):
            continue
        last = pdf["cell"].iloc[-1]
        cut = int(np.searchsorted(pdf["cell"].to_numpy(), last))
        if cut or (rest and rest[0]["cell"].iloc[-1] != last):
            yield pd.concat([*rest, pdf.iloc[:cut]], ignore_index=True)
            rest = []
        rest.append(pdf.iloc[cut:])
    if rest:
        yield pd.concat(rest, ignore_index=True)


def _passing(pdf: pd.DataFrame, num: int, den: int) -> Iterator[tuple]:
    """For each cell of signed rows: (class ids, sizes, pairs); pairs gives, for a place, the later places in order of size
    that are of another component and that bitmaps can't refuse, and what overlap those leave at most."""
    cells = pdf["cell"].to_numpy()
    starts = np.flatnonzero(np.r_[True, cells[1:] != cells[:-1]])
    n, c, root, chunk, sigs = (pdf[x].to_numpy() for x in ("n", "cid", "root", "chunk", "sig"))
    for start, end in zip(starts.tolist(), np.r_[starts[1:], len(cells)].tolist()):
        mine = slice(start, end)
        if (root[mine] == root[start]).all():
            continue
        across = (chunk[mine] != chunk[start]).any()  # two chunks meet here; each within itself has a cell of its own
        order = start + np.argsort(n[mine], kind="stable")
        size, comp, side = n[order], root[order], chunk[order]
        width = len(sigs[order[0]])
        bits = np.stack([_folded(np.frombuffer(sigs[x], np.uint8), width) for x in order]).view(np.uint64)
        ends = np.searchsorted(size, size * den // num, side="right")

        def pairs(i: int) -> tuple[np.ndarray, np.ndarray]:
            meet = comp[i + 1 : ends[i]] != comp[i]
            if across:
                meet &= side[i + 1 : ends[i]] != side[i]
            j = i + 1 + np.flatnonzero(meet)
            # each bit of one bitmap that the other lacks is an element that the other set lacks
            over = np.minimum(
                size[i] - np.bitwise_count(bits[i] & ~bits[j]).sum(axis=1, dtype=np.int64),
                size[j] - np.bitwise_count(bits[j] & ~bits[i]).sum(axis=1, dtype=np.int64),
            )
            ok = den * over >= num * (size[i] + size[j] - over)
            return j[ok], over[ok]

        yield c[order], size, pairs


def _signed(tiles: DataFrame, held: DataFrame, roots: DataFrame) -> DataFrame:
    """Rows of tiles that hold more than one component, with their bitmaps, sorted by cell.

    A tile of more than CELL classes is dealt into chunks, and every two chunks meet in a cell. A component that has CELL
    classes or more of a tile gets chunks of its own there, and those meet the other chunks but never each other: what a group
    of any size costs grows with its own size, not with its square.
    """
    known = roots.select(F.col("node").alias("cid"), "root")
    rows = tiles.select("token", "cid").join(known, "cid", "left").select("token", "cid", F.coalesce("root", "cid").alias("root"))
    sums = rows.groupBy("token", "root").agg(F.count("*").alias("m"))
    large = sums.filter(F.col("m") >= CELL).select("token", F.col("root").alias("own"), F.ceil(F.col("m") / CELL).cast("int").alias("parts"))
    mixed_ = F.sum(F.when(F.col("m") < CELL, F.col("m")).otherwise(0))
    spread = sums.groupBy("token").agg(F.min("root").alias("low"), F.max("root").alias("high"), F.ceil(mixed_ / CELL).cast("int").alias("mixed")).filter("low < high").select("token", "mixed")
    both = large.groupBy("token").agg(F.flatten(F.collect_list(F.transform(F.sequence(F.lit(1), "parts"), lambda i: F.struct(F.col("own").alias("of"), i.alias("no"))))).alias("own_chunks"))
    # a chunk is (component, number); those of several components have none
    shared = F.when(F.col("mixed") > 0, F.transform(F.sequence(F.lit(1), F.col("mixed")), lambda i: F.struct(F.lit(None).cast("long").alias("of"), i.alias("no")))).otherwise(F.array().cast("array<struct<of: bigint, no: int>>"))
    chunks = spread.join(both, "token", "left").select("token", "mixed", F.concat(shared, F.coalesce("own_chunks", F.array().cast("array<struct<of: bigint, no: int>>"))).alias("chunks"))
    dealt = rows.join(chunks, "token").join(large.withColumnRenamed("token", "__token"), (F.col("token") == F.col("__token")) & (F.col("root") == F.col("own")), "left")
    number = F.pmod(F.xxhash64("cid"), F.coalesce("parts", "mixed")).cast("int") + 1
    mine = dealt.withColumn("mine", F.struct(F.col("own").alias("of"), number.alias("no")))
    met = mine.withColumn("with", F.explode(F.filter("chunks", lambda c: F.col("mine.of").isNull() | c.of.isNull() | (c.of != F.col("mine.of")))))
    one = F.size("chunks") == 1
    cell = F.when(one, F.col("token")).otherwise(F.xxhash64("token", F.least("mine", "with"), F.greatest("mine", "with")))
    chunk = F.xxhash64("mine.of", "mine.no").alias("chunk")
    signed = met.select(cell.alias("cell"), "cid", "root", chunk).join(held.select("cid", "n", "sig"), "cid")
    return signed.repartition("cell").sortWithinPartitions("cell", "n", "cid")


def nearest_pairs(tiles: DataFrame, held: DataFrame, roots: DataFrame, num: int, den: int) -> DataFrame:
    """(cid, other, more): each class that a pair of different components may link, with the one of them that its bounds
    leave most similar, and whether there are others."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best: dict[int, tuple[float, int, bool]] = {}

        def told() -> pa.RecordBatch:
            rows = [(c, *x) for c, x in best.items()]
            best.clear()
            kinds = (pa.int64(), pa.float64(), pa.int64(), pa.bool_())
            return pa.RecordBatch.from_arrays([pa.array([x[i] for x in rows], k) for i, k in enumerate(kinds)], ["cid", "share", "other", "more"])

        for pdf in _cells(batches):
            for ids, size, pairs in _passing(pdf, num, den):
                share, other, times = np.full(len(ids), -1.0), np.zeros(len(ids), np.int64), np.zeros(len(ids), np.int64)
                for i in range(len(ids) - 1):
                    j, over = pairs(i)
                    if not len(j):
                        continue
                    likely = over / (size[i] + size[j] - over)
                    times[i] += len(j)
                    times[j] += 1
                    at = int(np.argmax(likely))
                    if likely[at] > share[i]:
                        share[i], other[i] = likely[at], ids[j[at]]
                    nearer = likely > share[j]
                    share[j[nearer]], other[j[nearer]] = likely[nearer], ids[i]
                hit = np.flatnonzero(times)
                for c, x, o, more in zip(ids[hit].tolist(), share[hit].tolist(), other[hit].tolist(), (times[hit] > 1).tolist()):
                    old = best.get(c)
                    if old is None:
                        best[c] = (x, o, more)
                    else:
                        best[c] = (*max((x, o), old[:2]), more or old[2] or o != old[1])
            if len(best) > 500_000:
                yield told()
        yield told()

    found = _signed(tiles, held, roots).mapInArrow(run, "cid long, share double, other long, more boolean")
    nearest = F.max(F.struct("share", "other"))
    return written(found.groupBy("cid").agg(nearest.alias("x"), (F.bool_or("more") | (F.min("other") != F.max("other"))).alias("more")).select("cid", F.col("x.other").alias("other"), "more"), "nearest")


def rest_pairs(tiles: DataFrame, held: DataFrame, roots: DataFrame, num: int, den: int) -> DataFrame:
    """(a, b) of different components that bitmaps can't refuse."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        said: set[tuple[int, int]] = set()

        def told() -> pa.RecordBatch:
            rows = list(said)
            said.clear()
            return pa.RecordBatch.from_arrays([pa.array([x[i] for x in rows], pa.int64()) for i in range(2)], ["a", "b"])

        for pdf in _cells(batches):
            for ids, _, pairs in _passing(pdf, num, den):
                for i in range(len(ids) - 1):
                    own = int(ids[i])
                    said.update((min(own, x), max(own, x)) for x in ids[pairs(i)[0]].tolist())
                if len(said) > 500_000:
                    yield told()
        yield told()

    return _signed(tiles, held, roots).mapInArrow(run, "a long, b long").distinct()


def joined_roots(roots: DataFrame, links: DataFrame) -> DataFrame:
    """(node, root) of the components that links (a, b) make of those in roots: a graph whose nodes are the old roots."""
    ends = links.join(roots.withColumnsRenamed({"node": "a", "root": "ra"}), "a", "left").join(roots.withColumnsRenamed({"node": "b", "root": "rb"}), "b", "left")
    upper = components(ends.select(F.coalesce("ra", "a").alias("a"), F.coalesce("rb", "b").alias("b")))
    fresh = upper.select("node", F.col("node").alias("root")).join(roots.select("node"), "node", "left_anti")
    lifted = roots.unionByName(fresh).join(upper.select(F.col("node").alias("root"), F.col("root").alias("upper")), "root", "left")
    told = written(lifted.select("node", F.coalesce("upper", "root").alias("root")), "roots")
    drop_written(upper)
    return told


def grouped(docs: DataFrame, k: int, num: int, den: int) -> DataFrame:
    """(doc_id, n, component_id) for every row of docs (doc_id, text); similarity num / den or more links."""
    texts = docs.select(F.coalesce("doc_id", F.lit(LOWEST)).alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    classes = class_table(texts, k, num, den)
    tiles = shared_tiles(classes)
    held = payloads(texts, classes, tiles.select("cid").distinct(), k)
    stars = compared(leader_pairs(tiles), held, k, num, den)
    roots = components(stars)
    near = nearest_pairs(tiles, held, roots, num, den)
    closest = compared(near.select(F.least("cid", "other").alias("a"), F.greatest("cid", "other").alias("b")).distinct(), held, k, num, den)
    closer = joined_roots(roots, closest)
    left = tiles.join(near.filter("more").select("cid"), "cid", "left_semi")
    rest = compared(rest_pairs(left, held, closer, num, den), held, k, num, den)
    final = joined_roots(closer, rest)
    # a component's smallest doc_id: classes fold their documents first, then components fold their classes
    owns = classes.filter("n > 0").groupBy("cid", "n").agg(F.min("doc_id").alias("least"))
    rooted = owns.join(final.withColumnsRenamed({"node": "cid"}), "cid", "left").select("cid", "n", "least", F.coalesce("root", "cid").alias("root"))
    least = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    by_class = rooted.join(least, "root").select("cid", "n", "component_id")
    found = classes.select("doc_id", "cid", "n").join(by_class, ["cid", "n"], "left").withColumn("component_id", F.coalesce("component_id", "doc_id"))
    told = written(found.select(F.nullif("doc_id", F.lit(LOWEST)).alias("doc_id"), "n", F.nullif("component_id", F.lit(LOWEST)).alias("component_id")), "groups")
    for done in (classes, tiles, held, stars, roots, near, closest, closer, rest, final):
        drop_written(done)
    return told


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = grouped(documents(spark, sf_dir), 3, 90, 100)
    return found.select("doc_id", F.col("n").alias("n_shingles"), "component_id")


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: five-word shingles, similarity 0.8 or more; of each group the row with the smallest id stays."""
    found = grouped(docs, 5, 80, 100)
    stays = found.filter("doc_id <=> component_id").select(F.coalesce("doc_id", F.lit(LOWEST)).alias("__id")).distinct()
    rows = docs.withColumn("__id", F.coalesce("doc_id", F.lit(LOWEST)))
    return rows.join(stays, "__id", "left_semi").dropDuplicates(["__id", "text"]).select(*docs.columns)


#: Every pair by its shared shingles, then components by the smallest id reachable.
ORACLE = r"""
WITH RECURSIVE words AS (
  SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda w: w <> '') AS w
  FROM documents
), shingles AS (
  SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 3 THEN [array_to_string(w, ' ')]
    ELSE list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2]) END) AS s FROM words
), sizes AS (SELECT doc_id, count(*) AS n FROM shingles GROUP BY doc_id
), pairs AS (
  SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS n_both FROM shingles a JOIN shingles b ON a.s = b.s AND a.doc_id <> b.doc_id GROUP BY 1, 2
), links AS (
  SELECT a, b FROM pairs JOIN sizes x ON x.doc_id = a JOIN sizes y ON y.doc_id = b WHERE 100 * n_both >= 90 * (x.n + y.n - n_both)
), reach AS (
  SELECT doc_id AS a, doc_id AS b FROM documents UNION SELECT reach.a, links.b FROM reach JOIN links ON links.a = reach.b
)
SELECT d.doc_id, coalesce(any_value(s.n), 0) AS n_shingles, min(reach.b) AS component_id
FROM documents d LEFT JOIN sizes s ON s.doc_id = d.doc_id JOIN reach ON reach.a = d.doc_id GROUP BY d.doc_id
"""
