"""Language identification: sparse multinomial logistic regression on TF-IDF character n-grams.

A text is lower-cased and its runs of letters and combining marks, each between two spaces, give all character n-grams of one to three
characters. N-grams are hashed to FEATURES slots; a slot weighs its count times ln((1 + N) / (1 + df)) + 1, and vectors
have length one. Weights are learned by follow-the-regularised-leader (FTRL-proximal) with an elastic-net penalty: most
weights stay zero. A temperature fitted on rows kept out of the training then calibrates the scores.

The fit takes a bounded sample of each language: its distinct texts with the smallest seeded hashes, a language's share of
TRAIN (and a fifth of that for the temperature) and LEAST_TEXTS at least, so at most the larger of 7,200 and 60 for each
language; every language with a labelled text is in the model, and the prior leans to equal languages. Texts are whole. Document frequencies and N come from all texts with a letter that fit is
given, labelled or not: each task adds up one array of FEATURES slots, and their sums, of that fixed size, reach the
driver. Scoring covers every row and whole texts, where each partition lies; the model that travels is FEATURES x languages floats.

Defined cases: null text, or text without a letter, is `und` with score 0; texts of any length are read whole; a null
lang is no label; with no labelled row every row is `und`; equal texts get equal scores, and of tied languages the first
in order of code point wins; a sixth of each language's sample, none of fewer than six texts, is for the temperature; more
than MOST_LANGUAGES languages are an error; input columns named lang_pred and score are replaced, others pass through.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import documents, held_out, mixed, sliced

FEATURES = 1 << 16
TRAIN = 6000
#: Distinct texts of a language that the sample takes, however many languages there are.
LEAST_TEXTS = 60
#: FTRL-proximal: learning rate, its smoothing, and the two penalties.
ALPHA, BETA, L1, L2, EPOCHS = 0.5, 1.0, 0.02, 0.5, 3

#: Positions whose n-grams are counted at once, which bounds a worker's memory on long texts and changes no result.
BLOCK = 1 << 20
#: Languages that a model can have: its size on the driver is FEATURES floats for each, three times while it is learned.
MOST_LANGUAGES = 512


@functools.cache
def _kinds() -> np.ndarray:
    """For each code point 2 if it is a letter, 1 if it is a combining mark, else 0."""
    every = "".join(chr(c) for c in range(0x110000) if not 0xD800 <= c < 0xE000)
    table = np.zeros(0x110000, np.uint8)
    for kind, pattern in ((2, r"\p{L}+"), (1, r"\p{M}+")):
        for m in regex.finditer(pattern, every):
            table[ord(m[0][0]) : ord(m[0][-1]) + 1] = kind
    return table


def profiles(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(bounds, slots, counts) of the texts' character n-grams: text i has slots[bounds[i]:bounds[i + 1]], none without a letter.

    The texts lie end to end, one space between any two, so all are counted together: their keys are text and slot.
    """
    if not texts:
        return np.zeros(1, np.int64), np.empty(0, np.int64), np.empty(0, np.float64)
    kinds, lowered = _kinds(), [t.lower() for t in texts]
    points = np.frombuffer((" " + "".join(t + " " for t in lowered)).encode("utf-32-le"), np.uint32)
    sizes = np.fromiter(map(len, lowered), np.int64, len(texts)) + 1
    kind, own = kinds[points], np.repeat(np.arange(len(texts), dtype=np.uint32), sizes)
    own = np.r_[own[:1], own]
    lettered = np.zeros(len(texts), bool)
    lettered[own[kind == 2]] = True
    within = (kind > 0) & lettered[own]
    keep = within | np.r_[True, within[:-1]]
    points, own, within = np.where(within, points, np.uint32(32))[keep], own[keep], within[keep]
    n = len(points)
    apart = np.ones(n, bool)  # spaces between two texts
    apart[1:-1] = ~within[1:-1] & (own[:-2] != own[2:])
    found = []
    for a in range(0, n - 1, BLOCK):
        p, o = points[a : a + BLOCK + 2].astype(np.uint64), own[a : a + BLOCK + 2].astype(np.uint64) << np.uint64(16)
        edge, letter = apart[a : a + BLOCK + 2], within[a : a + BLOCK + 2]
        wide, m = p << np.uint64(21), min(BLOCK, n - a)
        grams = (
            (p[:m], o[:m], ~edge[:m]),
            ((wide[:-1] + p[1:])[:m], np.where(letter, o, np.r_[o[1:], o[-1:]])[:-1][:m], None),
            (((wide[:-2] << np.uint64(21)) + wide[1:-1] + p[2:])[:m], o[1:-1][:m], ~edge[1:-1][:m]),
        )
        keys = []
        for i, (g, of, here) in enumerate(grams):
            if here is not None:
                g, of = g[here], of[here]
            keys.append((mixed(g * np.uint64(3) + np.uint64(i)) & np.uint64(FEATURES - 1) | of).astype(np.uint32))
        found.append(np.unique(np.concatenate(keys), return_counts=True))
    if not found:
        return np.zeros(len(texts) + 1, np.int64), np.empty(0, np.int64), np.empty(0, np.float64)
    keys, times = found[0]
    if len(found) > 1:
        keys, place = np.unique(np.concatenate([k for k, _ in found]), return_inverse=True)
        times = np.bincount(place, np.concatenate([t for _, t in found]))
    bounds = np.searchsorted(keys, np.arange(len(texts) + 1, dtype=np.uint64) << np.uint64(16))
    return bounds, (keys & np.uint32(FEATURES - 1)).astype(np.int64), times.astype(np.float64)


def counts(text: str) -> tuple[np.ndarray, np.ndarray]:
    """(slots, counts) of a text's character n-grams; empty if it has no letter."""
    _, slots, n = profiles([text])
    return slots, n


def weighed(slots: np.ndarray, n: np.ndarray, idf: np.ndarray) -> np.ndarray:
    x = n * idf[slots]
    return x / np.sqrt((x * x).sum())


def softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(axis=-1, keepdims=True))
    return e / e.sum(axis=-1, keepdims=True)


def ftrl(rows: list[tuple[np.ndarray, np.ndarray]], labels: np.ndarray, n_classes: int, seed: int) -> np.ndarray:
    """[FEATURES, classes] weights. Only the slots of a row are touched by its step."""
    z, n = np.zeros((FEATURES, n_classes)), np.zeros((FEATURES, n_classes))

    def weights(at) -> np.ndarray:
        return np.where(np.abs(z[at]) <= L1, 0.0, -(z[at] - np.sign(z[at]) * L1) / ((BETA + np.sqrt(n[at])) / ALPHA + L2))

    draw = np.random.default_rng(seed)
    for _ in range(EPOCHS):
        for i in draw.permutation(len(rows)):
            slots, x = rows[i]
            w = weights(slots)
            error = softmax(x @ w)
            error[labels[i]] -= 1
            g = x[:, None] * error
            step = (np.sqrt(n[slots] + g * g) - np.sqrt(n[slots])) / ALPHA
            z[slots] += g - step * w
            n[slots] += g * g
    return weights(slice(None))


def temperature(z: np.ndarray, labels: np.ndarray) -> float:
    """The divisor of scores, of a fixed grid, under which kept-out labels are likeliest."""
    grid = np.exp(np.linspace(np.log(0.02), np.log(5), 60))
    loss = [-np.log(np.maximum(softmax(z / t)[np.arange(len(labels)), labels], 1e-12)).mean() for t in grid]
    return float(grid[int(np.argmin(loss))])


def drawn(rows: DataFrame, most: int = TRAIN) -> tuple[DataFrame, int]:
    """Of rows (text, lang, __h), __h a hash of text and lang, the distinct texts of each language with about its share of
    smallest hashes, and that share; six deviations more are let in, which the caller cuts."""
    spark = rows.sparkSession
    sizes = rows.groupBy("lang", "__h").agg(F.lit(1).alias("one")).groupBy("lang").count().limit(MOST_LANGUAGES + 1).collect()
    if len(sizes) > MOST_LANGUAGES:
        raise ValueError(f"more than {MOST_LANGUAGES} languages")
    each = max((most + most // 5) // max(len(sizes), 1), LEAST_TEXTS)
    share = [(r["lang"], min(1.0, (each + 6 * each**0.5 + 6) / r["count"])) for r in sizes]
    limits = spark.createDataFrame([(lang, min(-(1 << 63) + int(x * (1 << 64)), (1 << 63) - 1)) for lang, x in share], "lang string, __limit long")
    return rows.join(F.broadcast(limits), "lang").filter("__h <= __limit").select("text", "lang", "__h").distinct(), each


def frequencies(docs: DataFrame) -> tuple[int, np.ndarray]:
    """How many texts of docs (text) have a letter, and how many of them have each slot."""

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # the last place counts the texts
        df = np.zeros(FEATURES + 1, np.int64)
        for batch in sliced(batches):
            bounds, slots, _ = profiles(batch.column("text").to_pylist())
            df[:FEATURES] += np.bincount(slots, minlength=FEATURES)
            df[FEATURES] += np.count_nonzero(np.diff(bounds))
        at = np.flatnonzero(df)
        yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(df[at])], ["slot", "n"])

    rows = docs.filter("text is not null").select("text").mapInArrow(add, "slot int, n long").groupBy("slot").agg(F.sum("n").alias("n")).collect()
    df = np.zeros(FEATURES + 1)
    for r in rows:
        df[r["slot"]] = r["n"]
    return int(df[FEATURES]), df[:FEATURES]


def fit(labelled: DataFrame, seed: int = 11, most: int = TRAIN) -> dict:
    """The model of labelled (doc_id, text, lang): languages, idf, weights, temperature. Rows without a label count for
    the idf alone; the weights are learned from about `most` texts, those of drawn()."""
    order = F.xxhash64(F.lit(seed), F.col("lang"), F.col("text"))
    rows = labelled.filter("text is not null and lang is not null").select("text", "lang", order.alias("__h"))
    sample, each = drawn(rows, most)

    def featurise(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [counts(t) for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("lang"), batch.column("__h"), pa.array([s.astype(np.uint16).tobytes() for s, _ in found], pa.binary()), pa.array([c.astype(np.float32).tobytes() for _, c in found], pa.binary())], ["lang", "h", "slots", "counts"])

    pdf = sample.repartition(8, "__h").mapInArrow(featurise, "lang string, h long, slots binary, counts binary").toPandas().sort_values(["h", "lang"])
    pdf = pdf.groupby("lang").head(each)
    pdf = pdf[pdf["slots"].map(len) > 0]
    # the first sixth of each language is for the temperature, so a rare one is never missing from the fit
    at, size = pdf.groupby("lang").cumcount(), pdf.groupby("lang")["lang"].transform("size")
    kept_out = (at < size // 6).to_numpy(bool)
    languages = sorted(pdf["lang"].unique())
    rows = [(np.frombuffer(s, np.uint16).astype(np.int64), np.frombuffer(c, np.float32).astype(np.float64)) for s, c in zip(pdf["slots"], pdf["counts"])]
    labels = np.array([languages.index(x) for x in pdf["lang"]], np.int64)
    n_texts, df = frequencies(labelled)
    idf = np.log((1 + n_texts) / (1 + df)) + 1
    vectors = [(slots, weighed(slots, n, idf)) for slots, n in rows]
    if not languages:
        return {"languages": [], "idf": idf, "weights": np.zeros((FEATURES, 0)), "temperature": 1.0}
    apart, train = np.flatnonzero(kept_out), np.flatnonzero(~kept_out)
    w = ftrl([vectors[i] for i in train], labels[train], len(languages), seed)
    t = temperature(np.stack([vectors[i][1] @ w[vectors[i][0]] for i in apart]), labels[apart]) if len(apart) else 1.0
    return {"languages": languages, "idf": idf.astype(np.float32), "weights": w.astype(np.float32), "temperature": t}


def predict(docs: DataFrame, model: dict, text: str = "text") -> DataFrame:
    """docs with lang_pred and score, the calibrated probability of that language."""
    own = [c for c in docs.columns if c not in ("lang_pred", "score")]
    sent = docs.sparkSession.sparkContext.broadcast(model)
    schema = docs.select(*own).schema.add("lang_pred", "string").add("score", "double")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = sent.value
        for batch in sliced(batches):
            names, scores = [], []
            texts = [t or "" for t in batch.column("__text").to_pylist()]
            bounds, every, times = profiles(texts) if m["languages"] else (np.zeros(len(texts) + 1, np.int64), None, None)
            for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist()):
                if a == b:
                    names.append("und")
                    scores.append(0.0)
                    continue
                slots, n = every[a:b], times[a:b]
                p = softmax((weighed(slots, n, m["idf"]) @ m["weights"][slots]) / m["temperature"])
                best = int(np.argmax(p))
                names.append(m["languages"][best])
                scores.append(float(p[best]))
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in own), pa.array(names, pa.string()), pa.array(scores, pa.float64())], [*own, "lang_pred", "score"])

    return docs.select(*own, F.col(text).cast("string").alias("__text")).mapInArrow(run, schema)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    model = fit(docs.filter(~held_out()).select("doc_id", "text", "lang"))
    return predict(docs.select("doc_id", "text"), model).select("doc_id", held_out().alias("held_out"), "lang_pred", "score")
