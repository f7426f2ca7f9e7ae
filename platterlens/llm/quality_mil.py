"""Quality classifier: attention-based multiple-instance learning.

A document is a bag of passages of PASSAGE words, all of them. Each passage is encoded: shares of character kinds, of
repeated and distinct words, a hashed bag of its words and one of their outlines pass a learned layer. Gated attention,
softmax(w . (tanh(V h) * sigmoid(U h))), weighs the passages; the weighted sum is the document's representation, and a
logistic output scores it. Encoder, attention and output are learned together from document labels alone.

The fit takes a bounded sample: at most `most` labelled documents (TRAIN unless told), the ones with the smallest seeded
hashes of their ids, and of each at most BAG passages, drawn by that hash; so the driver holds `most` x BAG encoded passages
(130 MB) at most, however long the texts are. Scoring covers every row and every passage, where each partition lies; the model that travels
is a few thousand floats.

Defined cases: null text counts as empty; a text without words is one passage of zeros and gets the score of that;
labels of one kind only give a constant score; repeated label rows count one by one; a null label is none; rows with
equal texts get equal scores; input columns named score and attention are replaced, others pass through, and labels, lang, source and ids are never inputs of a score.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import documents, held_out, sliced, smallest

PASSAGE = 100
TRAIN = 5000
HASHED, WORDS, HIDDEN, ATTENTION = 64, 128, 16, 8
EPOCHS, RATE, DECAY = 12, 0.01, 1e-4

#: Character kinds by byte: lower case, upper case, digit, white space, full stop and the like, pairs, symbols, beyond ASCII.
KINDS = np.full(256, 7, np.uint8)
for _kind, _chars in enumerate((b"abcdefghijklmnopqrstuvwxyz", b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"0123456789", b" \t\n\r\x0b\x0c", b".,;:?'\"-", b"()[]{}/\\@_=+~^`!", b"#*$%&|<>")):
    KINDS[list(_chars)] = _kind
KINDS[0:9] = KINDS[14:32] = 6
N_SHARES = 8 + 6
WIDTH = N_SHARES + HASHED + WORDS
#: Passages of one document that the fit takes, drawn with a seed from its own, so that a book counts as much as a page.
BAG = 32


def _of_words(words: list[bytes]) -> tuple[np.ndarray, ...]:
    """Of distinct words: lengths, first and last character's kind, counts of kinds, slot of the outline (kinds of
    characters with repeats merged, and whether the word is short) and slot of the word, both of all their bytes."""
    lengths = np.fromiter(map(len, words), np.int64, len(words))
    starts = np.cumsum(lengths) - lengths
    kinds = KINDS[np.frombuffer(b"".join(words), np.uint8)]
    counts = np.stack([np.add.reduceat(kinds == k, starts, dtype=np.int64) for k in range(8)], axis=1)
    change = np.r_[True, kinds[1:] != kinds[:-1]]
    change[starts] = True
    outlines, ends = kinds[change].tobytes(), np.cumsum(np.add.reduceat(change, starts, dtype=np.int64)).tolist()
    shapes = (xxhash.xxh3_64_intdigest(outlines[a:b], n < 4) % HASHED for a, b, n in zip([0, *ends], ends, lengths.tolist()))
    slots = (xxhash.xxh3_64_intdigest(w) % WORDS for w in words)
    return lengths, kinds[starts], kinds[starts + lengths - 1], counts, np.fromiter(shapes, np.int64, len(words)), np.fromiter(slots, np.int64, len(words))


def passages(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """([passages, WIDTH] of whole texts laid end to end, passages of each text). A text without words has one, of zeros."""
    split = [t.encode().split() for t in texts]
    n_words = np.fromiter(map(len, split), np.int64, len(split))
    n_passages = np.maximum(1, -(-n_words // PASSAGE))
    out = np.zeros((int(n_passages.sum()), WIDTH), np.float32)
    words = [w for ws in split for w in ws]
    if not words:
        return out, n_passages
    known = {w: i for i, w in enumerate(dict.fromkeys(words))}
    ids = np.fromiter(map(known.__getitem__, words), np.int64, len(words))
    lengths, first, last, counts, shapes, slots = _of_words(list(known))
    starts, first_passage = np.cumsum(n_words) - n_words, np.cumsum(n_passages) - n_passages
    text_of = np.repeat(np.arange(len(split)), n_words)
    within = np.arange(len(words)) - starts[text_of]
    passage_of = first_passage[text_of] + within // PASSAGE
    rows = np.flatnonzero(np.bincount(passage_of, minlength=len(out)))
    bounds = np.searchsorted(passage_of, rows)
    sizes = np.diff(np.r_[bounds, len(words)])[:, None]
    per = lambda x: np.add.reduceat(x[ids].astype(np.float64), bounds, axis=0)
    kinds = per(counts)
    same = (ids == np.r_[-1, ids[:-1]]) & (within > 0)
    distinct = np.bincount(np.unique(passage_of * len(known) + ids) // len(known), minlength=len(out))[rows]
    shares = np.stack([per(lengths) / 10, per(first == 1), per(last == 4), per(last == 6), np.add.reduceat(same.astype(np.float64), bounds), distinct], axis=1) / sizes
    hashed = [np.bincount(passage_of * n + x[ids], minlength=n * len(out)).reshape(-1, n)[rows] / sizes for n, x in ((HASHED, shapes), (WORDS, slots))]
    out[rows] = np.concatenate([kinds / kinds.sum(axis=1, keepdims=True), shares, *map(np.sqrt, hashed)], axis=1)
    return out, n_passages


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


def _bag_sum(x: np.ndarray, starts: np.ndarray) -> np.ndarray:
    return np.add.reduceat(x, starts, axis=0)


def forward(p: dict, x: np.ndarray, starts: np.ndarray) -> dict:
    """Scores of bags laid end to end; starts: each bag's first passage."""
    of = np.repeat(np.arange(len(starts)), np.diff(np.r_[starts, len(x)]))
    h = np.tanh(x @ p["E"] + p["e"])
    t, g = np.tanh(h @ p["V"]), _sigmoid(h @ p["U"])
    s = (t * g) @ p["w"]
    a = np.exp(s - np.maximum.reduceat(s, starts)[of])
    a /= _bag_sum(a, starts)[of]
    z = _bag_sum(a[:, None] * h, starts)
    return {"of": of, "h": h, "t": t, "g": g, "a": a, "z": z, "y": _sigmoid(z @ p["o"] + p["b"])}


def gradients(p: dict, x: np.ndarray, starts: np.ndarray, y: np.ndarray) -> dict:
    """Of the mean logistic loss."""
    f = forward(p, x, starts)
    of, h, t, g, a = f["of"], f["h"], f["t"], f["g"], f["a"]
    dy = (f["y"] - y) / len(y)
    dz = dy[:, None] * p["o"]
    da = (dz[of] * h).sum(axis=1)
    ds = a * (da - _bag_sum(a * da, starts)[of])
    dt, dg = ds[:, None] * p["w"] * g * (1 - t * t), ds[:, None] * p["w"] * t * g * (1 - g)
    dh = (a[:, None] * dz[of] + dt @ p["V"].T + dg @ p["U"].T) * (1 - h * h)
    return {"E": x.T @ dh, "e": dh.sum(axis=0), "V": h.T @ dt, "U": h.T @ dg, "w": (t * g).T @ ds, "o": f["z"].T @ dy, "b": dy.sum(keepdims=True)}


def train(bags: list[np.ndarray], labels: np.ndarray, seed: int) -> dict:
    """Adam over small batches of bags."""
    draw = np.random.default_rng(seed)
    everything = np.concatenate(bags)
    mean, spread = everything.mean(axis=0, dtype=np.float64), everything.std(axis=0, dtype=np.float64) + 1e-3
    del everything
    init = lambda *shape: draw.normal(0, 1 / np.sqrt(shape[0]), shape)
    p = {"E": init(WIDTH, HIDDEN), "e": np.zeros(HIDDEN), "V": init(HIDDEN, ATTENTION), "U": init(HIDDEN, ATTENTION), "w": init(ATTENTION), "o": init(HIDDEN), "b": np.zeros(1)}
    m, v, step = {k: np.zeros_like(x) for k, x in p.items()}, {k: np.zeros_like(x) for k, x in p.items()}, 0
    mean32, spread32 = mean.astype(np.float32), spread.astype(np.float32)
    bags = [(b - mean32) / spread32 for b in bags]
    for _ in range(EPOCHS):
        order = draw.permutation(len(bags))
        for at in range(0, len(order), 32):
            batch = order[at : at + 32]
            x = np.concatenate([bags[i] for i in batch])
            starts = np.r_[0, np.cumsum([len(bags[i]) for i in batch])[:-1]]
            step += 1
            for k, grad in gradients(p, x, starts, labels[batch]).items():
                grad = grad + DECAY * p[k]
                m[k] = 0.9 * m[k] + 0.1 * grad
                v[k] = 0.999 * v[k] + 0.001 * grad * grad
                p[k] = p[k] - RATE * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.999**step)) + 1e-8)
    return p | {"mean": mean, "spread": spread}


def taken(bag: np.ndarray, h: int) -> np.ndarray:
    """At most BAG of a document's passages, in order, drawn by its hash."""
    if len(bag) <= BAG:
        return bag
    return bag[np.sort(np.random.default_rng(h & (1 << 64) - 1).choice(len(bag), BAG, replace=False))]


def fit(labelled: DataFrame, seed: int = 5, most: int = TRAIN) -> dict:
    """The model of labelled (doc_id, text, quality), learned from `most` of its rows at most."""
    order = F.xxhash64(F.lit(seed), F.col("doc_id").cast("string"))
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    sample = smallest(labelled.filter("quality is not null").select(text.alias("text"), "quality", order.alias("__h")), "__h", most, "text", "quality")

    def featurise(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches, 256):
            x, sizes = passages(batch.column("text").to_pylist())
            bags = [taken(b, h).tobytes() for b, h in zip(np.split(x, np.cumsum(sizes)[:-1]), batch.column("__h").to_pylist())]
            yield pa.RecordBatch.from_arrays([batch.column("quality").cast(pa.int64()), batch.column("__h"), pa.array(bags, pa.binary())], ["quality", "h", "bag"])

    pdf = sample.repartition(8, "__h").mapInArrow(featurise, "quality long, h long, bag binary").toPandas().sort_values(["h", "quality", "bag"])
    bags = [np.frombuffer(b, np.float32).reshape(-1, WIDTH) for b in pdf["bag"]]
    labels = pdf["quality"].to_numpy(np.float64)
    if len(set(labels)) < 2:
        return {"constant": float(labels[0]) if len(labels) else 0.5}
    return train(bags, labels, seed)


def score(docs: DataFrame, model: dict, text: str = "text") -> DataFrame:
    """docs with score (higher: label 1 likelier) and attention, the weight of each passage."""
    own = [c for c in docs.columns if c not in ("score", "attention")]
    sent = docs.sparkSession.sparkContext.broadcast(model)
    schema = docs.select(*own).schema.add("score", "double").add("attention", T.ArrayType(T.FloatType()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        p = sent.value
        for part in sliced(batches, 256):
            x, sizes = passages([t or "" for t in part.column("__text").to_pylist()])
            ends = np.cumsum(sizes)
            if "constant" in p:
                y, a = np.full(len(sizes), p["constant"]), np.repeat(1 / sizes, sizes)
            else:
                f = forward(p, (x - p["mean"]) / p["spread"], ends - sizes)
                y, a = np.round(f["y"], 12), f["a"]  # sums differ in their last bit by where a text lies in its batch
            weights = pa.ListArray.from_arrays(pa.array(np.r_[0, ends], pa.int32()), pa.array(a, pa.float32()))
            yield pa.RecordBatch.from_arrays([*(part.column(c) for c in own), pa.array(y, pa.float64()), weights], [*own, "score", "attention"])

    return docs.select(*own, F.col(text).cast("string").alias("__text")).mapInArrow(run, schema)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir).select("doc_id", "text")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", "quality").filter(~held_out())
    order = F.xxhash64(F.lit(5), F.col("doc_id").cast("string"))
    # the bounded sample of labels is drawn before texts are joined to it, so the join has at most TRAIN rows on one side
    chosen = smallest(labels.filter("quality is not null").withColumn("__order", order), "__order", TRAIN, "quality").drop("__order")
    model = fit(docs.join(F.broadcast(chosen), "doc_id"))
    scored = score(docs, model)
    return scored.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= 0.7).cast("int").alias("predicted"))
