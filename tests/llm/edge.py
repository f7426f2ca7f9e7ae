"""Small documents with every awkward case, and helpers that several tests use."""

from __future__ import annotations

import random

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint, score double, kept boolean, ids string, size string, `group` string"


def documents(spark, rows):
    """rows (doc_id, text, lang, source); the other columns carry names that operators use for results."""
    return spark.createDataFrame([(i, t, lang, s, len(t) if t is not None else None, 0.25, None, "x", "y", "z") for i, t, lang, s in rows], SCHEMA)


def words(draw: random.Random, n: int) -> str:
    return " ".join(draw.choice("alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi rho sigma tau upsilon phi chi psi omega".split()) + str(draw.randrange(60)) for _ in range(n))


def awkward(seed: int = 1) -> list[tuple]:
    draw = random.Random(seed)
    base = words(draw, 120)
    near = base.split()
    near[60] = "changed"
    long = words(draw, 30_000)
    return [
        (1, base, "en", "a"), (2, base, "en", "a"), (3, " ".join(near), "en", "b"), (4, None, None, None), (5, "", "de", "a"), (6, " \n\t ", "de", "a"), (7, "one two", "en", "c"), (8, "one two", "en", "c"),
        (9, "ONE\ttwo", "en", None), (10, long, "en", "a"), (11, long + " tail", "fr", "a"), (12, "naïve   café ☕ 日本語 <|endoftext|> x", "fr", "b"), (12, "naïve   café ☕ 日本語 <|endoftext|> x", "fr", "b"),
        (13, "same id, text one", "en", "a"), (13, "same id, text two", "en", "a"), (None, base, "en", "a"), (None, "null id", "en", "a"), (-5, "one", None, ""), (14, "12345 67890", None, "b"),
    ]
