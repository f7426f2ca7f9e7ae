"""A Merkle manifest of a table: leaves, the preimages of all parents, proofs and folding.

Every row is a leaf, the SHA-256 of its fields, each with its length. The leaves of a part (a language) stand in order of
their ids, and every `arity` consecutive nodes make a parent until one node, the part's subroot, is left; subroots, in order
of their parts, make the root likewise. What is stored of a parent is its preimage: the hex digests of its children, one
after the other, 64 characters each. A leaf joins the preimages of its ancestors; cutting its own 64-character slot out of
each leaves the siblings, which are its proof, and putting a digest into the slot and hashing leads to the next ancestor's
slot, which is how a leaf is folded up to the root.

How it is spread out: ids are range-partitioned, so a part with a third of all rows lies in many partitions; a node's place
is its place in its partition plus what the partitions before hold (one row for each partition and part). Blocks of BLOCK
consecutive nodes go to a task together, which makes their parents up to the block's own root; block roots are the nodes of
the next tier, so there are as many tiers as powers of BLOCK in the largest part. Going down, the roots of each tier learn
the preimages above them from the tier over it, so a leaf meets only its block's preimages and one chain. A task holds a
block and nothing else; the driver learns the size of the largest part. The top tree over the parts is built the same way.

Defined cases: a null field counts as `-`; a null part is a part of its own, before all others; null ids come first; rows
of equal ids are ordered by their leaves, so rows that are wholly equal have equal leaves and proofs of their own places;
a part of one row has that leaf as its subroot, and a single part its subroot as the root; an empty table has no rows;
texts are hashed whole; columns other than the fields are ignored, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from hashlib import sha256
from itertools import groupby
from operator import itemgetter

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import documents, drop_written, shuffle_partitions, written

FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
#: Characters of a digest, and nodes of a block at most.
SLOT, BLOCK = 64, 1024
#: Rows of a batch that leaves a worker.
ROWS = 2000

_CHAIN = "array<struct<slot: int, preimage: string>>"
_CHAIN_TYPE = pa.list_(pa.struct([("slot", pa.int32()), ("preimage", pa.string())]))
_ROW = ("part", "block", "kind", "level", "idx", "count", "preimage", "chain", "inner", "doc_id", "leaf", "claim")
_ABOVE, _PARENT, _LEAF = 0, 1, 2


def digest(fields: list[Column]) -> Column:
    """Lowercase hex SHA-256 of the fields, each `-` if null, else its bytes' number, a colon and its text."""
    texts = [f.cast("string") for f in fields]
    return F.sha2(F.concat(*(F.coalesce(F.concat(F.octet_length(t).cast("string"), F.lit(":"), t), F.lit("-")) for t in texts)).cast("binary"), 256)


def leaves(docs: DataFrame, part: str = "lang", fields: tuple[str, ...] = FIELDS, claimed: dict[str, Column] | None = None, where: Column | None = None) -> DataFrame:
    """(part, doc_id, leaf, claim) of docs. claim is the leaf that is folded later: of rows `where` holds, with the columns
    of `claimed` in their fields' places; null stands for the leaf itself. Parts sort as their text does, null first."""
    as_told = digest([F.col(f) for f in fields])
    changed = digest([(claimed or {}).get(f, F.col(f)) for f in fields])
    return docs.select(
        F.coalesce(F.concat(F.lit("="), F.col(part).cast("string")), F.lit("-")).alias("part"),
        F.col("doc_id").cast("long").alias("doc_id"),
        F.unhex(as_told).alias("leaf"),
        (F.unhex(F.when(where, changed)) if where is not None else F.lit(None).cast("binary")).alias("claim"),
    )


def numbered(rows: DataFrame, order: list[str]) -> DataFrame:
    """rows (part, ...), a written table, with pos, each row's place in its part from 0, and count, the part's rows.

    Rows are range-partitioned and sorted by part and order, then by where they were, so a part of any size is spread out
    and a repeated run gives the same places. No window but one over partitions is needed.
    """
    keys = ["part", *order, "__was"]
    spread = rows.withColumn("__was", F.monotonically_increasing_id()).repartitionByRange(shuffle_partitions(rows.sparkSession), *keys)
    lying = written(spread.sortWithinPartitions(*keys).drop("__was").withColumn("__at", F.monotonically_increasing_id()), "numbered")
    slab = F.shiftright("__at", 33)
    runs = lying.groupBy(F.col("part").alias("__part"), slab.alias("__slab")).agg(F.count("*").alias("__n"), F.min("__at").alias("__first"))
    within = Window.partitionBy("__part")
    before = F.coalesce(F.sum("__n").over(within.orderBy("__slab").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    told = runs.select("__part", "__slab", (before - F.col("__first")).alias("__shift"), F.sum("__n").over(within).alias("count"))
    joined = lying.join(told, (F.col("part") == F.col("__part")) & (slab == F.col("__slab")))
    return joined.withColumn("pos", F.col("__at") + F.col("__shift")).drop("__part", "__slab", "__shift", "__at")


def height(count: int, arity: int) -> int:
    """Levels of parents over so many nodes."""
    levels = 0
    while count > 1:
        count, levels = -(-count // arity), levels + 1
    return levels


def depth_of(arity: int) -> int:
    """Levels that a block has: it holds arity ** depth nodes, BLOCK at most, or arity if that is more."""
    depth = 1
    while arity ** (depth + 1) <= BLOCK:
        depth += 1
    return depth


def _blocks(batches: Iterator[pa.RecordBatch], columns: tuple[str, ...]) -> Iterator[tuple[tuple, Iterator[tuple]]]:
    """Runs of rows of one (part, block), over batches."""
    rows = (row for batch in batches for row in zip(*(batch.column(c).to_pylist() for c in columns)))
    return groupby(rows, key=itemgetter(0, 1))


def _batches(rows: Iterator[tuple], schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    part: list[tuple] = []

    def batch() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(column, kind.type) for column, kind in zip(zip(*part), schema)], schema=schema)

    for row in rows:
        part.append(row)
        if len(part) >= ROWS:
            yield batch()
            part.clear()
    if part:
        yield batch()


def _parents(nodes: DataFrame, arity: int, base: int) -> DataFrame:
    """(part, count, level, idx, preimage) of nodes (part, count, pos, hash): the parents of a tier. Levels count from the
    leaves; `base` is the nodes' own. count is the number of the tier's nodes in the part."""
    depth = depth_of(arity)
    size = arity**depth
    schema = pa.schema([("part", pa.string()), ("count", pa.int64()), ("level", pa.int32()), ("idx", pa.int64()), ("preimage", pa.string())])

    def made(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        for (part, block), rows in _blocks(batches, ("part", "block", "count", "pos", "hash")):
            told = list(rows)
            count, hashes = told[0][2], [h.hex() for *_, h in told]
            for level in range(1, min(depth, height(count, arity)) + 1):
                preimages = ["".join(hashes[i : i + arity]) for i in range(0, len(hashes), arity)]
                first = block * arity ** (depth - level)
                yield from ((part, count, base + level, first + i, p) for i, p in enumerate(preimages))
                hashes = [sha256(p.encode()).hexdigest() for p in preimages]

    placed = nodes.filter("count > 1").select("part", F.floor(F.col("pos") / size).cast("long").alias("block"), "count", "pos", "hash")
    dealt = placed.repartition("part", "block") if base else placed.repartition(shuffle_partitions(nodes.sparkSession), "part", "block")
    return dealt.sortWithinPartitions("part", "block", "pos").mapInArrow(lambda b: _batches(made(b), schema), "part string, count long, level int, idx long, preimage string")


def _tiers(nodes: DataFrame, arity: int) -> list[DataFrame]:
    """The parents of nodes (part, count, pos, hash) as written tables, a tier each, as many as the largest part needs."""
    depth = depth_of(arity)
    size = arity**depth
    largest = nodes.agg(F.max("count")).first()[0] or 1
    tiers: list[DataFrame] = []
    while largest > 1:
        base = len(tiers) * depth
        tiers.append(written(_parents(nodes, arity, base), "parents"))
        nodes = tiers[-1].filter(F.col("level") == base + depth).select("part", F.ceil(F.col("count") / size).cast("long").alias("count"), F.col("idx").alias("pos"), F.unhex(F.sha2(F.col("preimage").cast("binary"), 256)).alias("hash"))
        largest = -(-largest // size)
    return tiers


@dataclass
class Manifest:
    """leaves (part, doc_id, leaf, claim, pos, count); parts (part, hash, pos, count, tier): subroots and their places, and the tier
    that each comes from; inner and top: the parents' preimages, a table for each tier."""

    leaves: DataFrame
    parts: DataFrame
    inner: list[DataFrame]
    top: list[DataFrame]
    arity: int

    def parents(self) -> DataFrame:
        """The stored preimages: (part, level, idx, preimage); the part of the top tree is the empty string."""
        spark = self.leaves.sparkSession
        out = spark.createDataFrame([], "part string, level int, idx long, preimage string")
        for tier in [*self.inner, *self.top]:
            out = out.unionByName(tier.select("part", "level", "idx", "preimage"))
        return out


def manifest(rows: DataFrame, arity: int = 2) -> Manifest:
    """The manifest of leaves (part, doc_id, leaf, claim). It is made of tables in the shared folder, so each of its steps
    reads what the one before has written."""
    narrow = written(rows, "leaves")
    placed = numbered(narrow, ["doc_id", "leaf"])
    inner = _tiers(placed.select("part", "count", "pos", F.col("leaf").alias("hash")), arity)
    size = arity ** depth_of(arity)
    lone = placed.filter("count = 1").select("part", F.col("leaf").alias("hash"), F.lit(1).alias("tier"))
    ends = [t.filter(f"count <= {size} and idx = 0").groupBy("part").agg(F.max_by("preimage", "level").alias("preimage")).select("part", F.unhex(F.sha2(F.col("preimage").cast("binary"), 256)).alias("hash"), F.lit(i + 1).alias("tier")) for i, t in enumerate(inner)]
    for end in ends:
        lone = lone.unionByName(end)
    subroots = written(lone, "subroots")
    ranked = numbered(subroots.select(F.lit("").alias("part"), F.col("part").alias("name"), "hash", "tier"), ["name"])
    top = _tiers(ranked.select("part", "count", "pos", "hash"), arity)
    drop_written(narrow)
    return Manifest(placed, ranked.select(F.col("name").alias("part"), "hash", "pos", "count", "tier"), inner, top, arity)


def _as_rows(df: DataFrame, kind: int, block: Column) -> DataFrame:
    """df in the columns that meet in a task, null where it has none."""
    kinds = dict(part="string", level="int", idx="long", count="long", preimage="string", chain=_CHAIN, inner="int", doc_id="long", leaf="binary", claim="binary")
    own = {c: F.col(c) if c in df.columns else F.lit(None).cast(t) for c, t in kinds.items()}
    return df.select(own["part"].alias("part"), block.cast("long").alias("block"), F.lit(kind).alias("kind"), *(own[c].alias(c) for c in _ROW[3:]))


def _meeting(parents: DataFrame | None, above: DataFrame, below: DataFrame | None, arity: int, base: int) -> DataFrame:
    """The preimages of a tier's blocks, the chains over the blocks, and the leaves under them, by block and in that order."""
    depth = depth_of(arity)
    size = arity**depth
    both = _as_rows(above, _ABOVE, F.col("block"))
    if parents is not None:
        up = F.pow(F.lit(float(arity)), base + depth - F.col("level")).cast("long")
        both = both.unionByName(_as_rows(parents, _PARENT, F.floor(F.col("idx") / up)))
    if below is not None:
        both = both.unionByName(_as_rows(below, _LEAF, F.floor(F.col("idx") / size)))
    dealt = both.repartition("part", "block") if base else both.repartition(shuffle_partitions(above.sparkSession), "part", "block")
    return dealt.sortWithinPartitions("part", "block", "kind", "level", "idx", "doc_id", "leaf")


class _Block:
    """What a block's rows say: chain, the (slot, preimage) pairs over it, inner, how many of those lie in the part, and the
    preimages of its levels."""

    def __init__(self, arity: int, depth: int, block: int):
        self.arity, self.first, self.chain, self.inner = arity, block * arity**depth, [], 0
        self.levels: list[list[str]] = []
        self.level = None

    def take(self, row: tuple) -> None:
        _, _, kind, level, _, _, preimage, chain, inner, *_ = row
        if kind == _ABOVE:
            self.chain, self.inner = [(x["slot"], x["preimage"]) for x in chain], inner
        else:
            if level != self.level:
                self.levels.append([])
                self.level = level
            self.levels[-1].append(preimage)

    def own(self, pos: int) -> list[tuple[int, str]]:
        """(slot, preimage) of a node's ancestors in this block, from below."""
        at, out = pos - self.first, []
        for preimages in self.levels:
            at, slot = divmod(at, self.arity)
            out.append((slot, preimages[at]))
        return out


def _chains(parents: DataFrame, above: DataFrame, arity: int, base: int) -> DataFrame:
    """(part, block, chain, inner) for every node under a tier: what stands above it, from its parent to the root. The node
    is a block of the tier below, whose number is its place."""
    depth = depth_of(arity)
    schema = pa.schema([("part", pa.string()), ("block", pa.int64()), ("chain", _CHAIN_TYPE), ("inner", pa.int32())])

    def told(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        for (part, block), rows in _blocks(batches, _ROW):
            state = _Block(arity, depth, block)
            for row in rows:
                state.take(row)
            for i in range(sum(map(len, state.levels[0])) // SLOT if state.levels else 0):
                chain = [*state.own(state.first + i), *state.chain]
                yield part, state.first + i, [{"slot": s, "preimage": p} for s, p in chain], state.inner + len(state.levels)

    met = _meeting(parents, above, None, arity, base)
    return met.mapInArrow(lambda b: _batches(told(b), schema), f"part string, block long, chain {_CHAIN}, inner int")


def folded(leaf: str, chain: list[tuple[int, str]]) -> str:
    """The digest at the end of a chain of (slot, preimage) if leaf is put into the first slot, and so on."""
    for slot, preimage in chain:
        leaf = sha256((preimage[: SLOT * slot] + leaf + preimage[SLOT * slot + SLOT :]).encode()).hexdigest()
    return leaf


def siblings(chain: list[tuple[int, str]]) -> str:
    """What is left of a chain's preimages without the slots."""
    return "".join(preimage[: SLOT * slot] + preimage[SLOT * slot + SLOT :] for slot, preimage in chain)


def proofs(made: Manifest) -> DataFrame:
    """For every leaf: doc_id, part, leaf, subroot, root, proof (the siblings' digests, level by level, left to right),
    folded_root (the claim, or else the leaf, folded along the stored preimages) and verified."""
    arity, depth = made.arity, depth_of(made.arity)
    starts = made.parts.select(F.lit("").alias("part"), F.lit(0).alias("block"), F.array().cast(_CHAIN).alias("chain"), F.lit(0).alias("inner")).limit(1)
    for i in range(len(made.top) - 1, -1, -1):
        starts = _chains(made.top[i], starts, arity, i * depth)
    if made.top:
        over = made.parts.join(starts.select(F.col("block").alias("pos"), "chain"), "pos")
    else:
        over = made.parts.withColumn("chain", F.array().cast(_CHAIN))
    begin = written(over.select("part", "tier", F.lit(0).cast("long").alias("block"), "chain", F.lit(0).alias("inner")), "chains")
    above = None
    for i in range(max(len(made.inner), 1), 0, -1):
        here = begin.filter(F.col("tier") == i).select("part", "block", "chain", "inner")
        above = here if above is None else here.unionByName(above)
        if i > 1:
            above = written(_chains(made.inner[i - 1], above, arity, (i - 1) * depth), "chains")
    schema = pa.schema([("doc_id", pa.int64()), ("part", pa.string()), *((c, pa.string()) for c in ("leaf", "subroot", "root", "proof", "folded_root")), ("verified", pa.bool_())])

    def told(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        for (part, block), rows in _blocks(batches, _ROW):
            state, over = _Block(arity, depth, block), None
            for row in rows:
                if row[2] != _LEAF:
                    state.take(row)
                    continue
                _, _, _, _, pos, count, _, _, _, doc_id, leaf, claim = row
                leaf = leaf.hex()
                own = state.own(pos)
                if over is None:  # the same for all leaves of a block
                    inside = [*own, *state.chain[: state.inner]]
                    over = sha256(inside[-1][1].encode()).hexdigest() if inside else leaf, siblings(state.chain)
                    root = sha256(state.chain[-1][1].encode()).hexdigest() if len(state.chain) > state.inner else over[0]
                end = folded(claim.hex() if claim is not None else leaf, [*own, *state.chain])
                yield doc_id, part, leaf, over[0], root, siblings(own) + over[1], end, end == root

    met = _meeting(made.inner[0] if made.inner else None, above, made.leaves.withColumnRenamed("pos", "idx"), arity, 0)
    out = met.mapInArrow(lambda b: _batches(told(b), schema), "doc_id long, part string, leaf string, subroot string, root string, proof string, folded_root string, verified boolean")
    return out.withColumn("part", F.when(F.col("part") != "-", F.substring("part", 2, 1 << 30)))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir).select(*FIELDS)
    seventh = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7 == 0
    rows = leaves(docs, claimed={"n_chars": F.col("n_chars").cast("decimal(20,0)") + 1}, where=seventh)
    out = proofs(manifest(rows))
    return out.select("doc_id", "leaf", "subroot", "root", F.sha2(F.col("proof").cast("binary"), 256).alias("proof_sha256"), "folded_root", "verified")


def _enc(value: str) -> str:
    return f"coalesce(strlen(CAST({value} AS VARCHAR)) || ':' || CAST({value} AS VARCHAR), '-')"


def _leaf_sql(n_chars: str) -> str:
    return f"sha256({_enc('d.doc_id')} || {_enc('source')} || {_enc('lang')} || {_enc(n_chars)} || {_enc('text')})"


#: CRC-32 by its bits (one step a bit, the reflected polynomial of the standard), nodes and folds level by level.
ORACLE = f"""
WITH RECURSIVE bits AS (
  SELECT doc_id, list_reduce(list_concat([CAST(4294967295 AS UBIGINT)], list_transform(range(8 * length(CAST(doc_id AS VARCHAR))),
           lambda i: CASE WHEN i % 8 = 0 THEN CAST(256 + ascii(substr(CAST(doc_id AS VARCHAR), CAST(i // 8 + 1 AS INTEGER), 1)) AS UBIGINT) ELSE CAST(0 AS UBIGINT) END)),
           lambda c, b: CASE WHEN xor(c, b & 255) & 1 = 1 THEN xor(xor(c, b & 255) >> 1, CAST(3988292384 AS UBIGINT)) ELSE xor(c, b & 255) >> 1 END) AS code
  FROM (SELECT DISTINCT doc_id FROM documents WHERE doc_id IS NOT NULL)
), leaves AS (
  SELECT d.doc_id, coalesce('=' || lang, '-') AS part, {_leaf_sql("n_chars")} AS leaf,
         CASE WHEN xor(code, CAST(4294967295 AS UBIGINT)) % 7 = 0 THEN {_leaf_sql("(CAST(n_chars AS HUGEINT) + 1)")} ELSE {_leaf_sql("n_chars")} END AS claim
  FROM documents d LEFT JOIN bits b ON d.doc_id = b.doc_id
), placed AS (
  SELECT *, row_number() OVER (PARTITION BY part ORDER BY doc_id NULLS FIRST, leaf) - 1 AS pos, count(*) OVER (PARTITION BY part) AS n FROM leaves
), nodes AS (
  SELECT 0 AS level, part, pos, n, leaf AS hash FROM placed
  UNION ALL
  SELECT level + 1, part, pos // 2, (n + 1) // 2, sha256(string_agg(hash, '' ORDER BY pos)) FROM nodes WHERE n > 1 GROUP BY level, part, pos // 2, n
), subroots AS (
  SELECT part, hash AS subroot, level AS height, row_number() OVER (ORDER BY part) - 1 AS tpos, count(*) OVER () AS parts FROM nodes WHERE n = 1
), tops AS (
  SELECT 0 AS level, tpos, parts AS n, subroot AS hash FROM subroots
  UNION ALL
  SELECT level + 1, tpos // 2, (n + 1) // 2, sha256(string_agg(hash, '' ORDER BY tpos)) FROM tops WHERE n > 1 GROUP BY level, tpos // 2, n
), tree AS (
  SELECT part, level, pos, hash FROM nodes UNION ALL SELECT '', level, tpos, hash FROM tops
), climb AS (
  SELECT p.part, p.pos AS place, 0 AS step, CASE WHEN s.height = 0 THEN s.tpos ELSE p.pos END AS slot, p.claim AS hash, s.height AS inner_levels, s.tpos, '' AS proof,
         s.height + (SELECT max(level) FROM tops) AS steps
  FROM placed p JOIN subroots s ON p.part = s.part
  UNION ALL
  SELECT c.part, c.place, c.step + 1, CASE WHEN c.step + 1 = c.inner_levels THEN c.tpos ELSE c.slot // 2 END,
         CASE WHEN t.hash IS NULL THEN sha256(c.hash) WHEN c.slot % 2 = 0 THEN sha256(c.hash || t.hash) ELSE sha256(t.hash || c.hash) END,
         c.inner_levels, c.tpos, c.proof || coalesce(t.hash, ''), c.steps
  FROM climb c
  LEFT JOIN tree t ON t.part = (CASE WHEN c.step < c.inner_levels THEN c.part ELSE '' END)
       AND t.level = (CASE WHEN c.step < c.inner_levels THEN c.step ELSE c.step - c.inner_levels END) AND t.pos = xor(c.slot, 1)
  WHERE c.step < c.steps
)
SELECT p.doc_id, p.leaf, s.subroot, (SELECT hash FROM tops WHERE n = 1) AS root, sha256(c.proof) AS proof_sha256, c.hash AS folded_root,
       c.hash = (SELECT hash FROM tops WHERE n = 1) AS verified
FROM placed p JOIN subroots s ON p.part = s.part JOIN climb c ON c.part = p.part AND c.place = p.pos AND c.step = c.steps
"""
