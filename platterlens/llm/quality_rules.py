"""Line-first quality rules.

Each line with a word is judged first. It fails

* as navigation, if separators stand between few words, or if it is one of SHORT_RUN or more lines on end (lines without
  words aside) that have SHORT_WORDS words at most and no mark of an ending;
* as punctuation, if symbols are about as many as words, if fewer than half of its characters are letters or digits, if it
  shouts, or if it is a teaser that ends in an ellipsis;
* as boilerplate, if it holds a set phrase of page furniture, or if the text has had the same line twice already.

Failing lines are removed, and a document is rejected if it loses more than `most_lost` of its word characters, or breaks
the base rules (too few words, too many words in repeated runs).

Defined cases: null text counts as empty; empty text has no words and is rejected by the base rule; repeated rows are
judged one by one; other columns pass through `clean` untouched; very long texts are read whole.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import WordHashes, documents, shingle_hashes, sliced, small_batches

#: Set phrases of page furniture, lower case.
BOILERPLATE = (
    "all rights reserved",
    "click here",
    "cookie policy",
    "enable javascript",
    "javascript is disabled",
    "lorem ipsum",
    "privacy policy",
    "read more",
    "sign up for our newsletter",
    "subscribe to our newsletter",
    "terms of service",
    "terms of use",
    "we use cookies",
)
#: Characters that part the entries of a navigation bar, and characters of symbol noise.
SEPARATORS, SYMBOLS = "|»›•·", "#*$%&|<>"
#: Characters that end a sentence, a quotation, an aside or a lead-in, and those that end a teaser.
ENDINGS, TEASERS = ".!?:;,…。！？)]}\"'”’»", ("...", "…")
#: Words of a short line at most, short lines on end that are a menu, words of a teaser at most, and copies of a line that stay.
SHORT_WORDS, SHORT_RUN, TEASER_WORDS, COPIES = 4, 4, 6, 2

_FURNITURE = re.compile("|".join(map(re.escape, BOILERPLATE)))
_SYMBOLS = re.compile(f"[{re.escape(SYMBOLS)}]")
_SEPARATORS = re.compile(f"[{re.escape(SEPARATORS)}]")
_ALPHANUMERIC = regex.compile(r"[\p{L}\p{M}\p{N}]")
_LOWER, _UPPER = regex.compile(r"\p{Ll}"), regex.compile(r"\p{Lu}")
_SPACES = bytes([32, 9, 10, 11, 12, 13])
_HIGH = bytes(range(128, 256))
_PLAIN = bytes(b for b in range(128) if chr(b).isalnum()) + _SPACES + _HIGH

VERDICT = T.StructType(
    [T.StructField(k, T.LongType()) for k in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_lines_removed", "chars_removed")]
    + [T.StructField("cleaned", T.StringType()), T.StructField("base_failed", T.BooleanType()), T.StructField("kept", T.BooleanType())]
)


def word_chars(text: str) -> int:
    data = text.encode()
    return len(text) - len(data) + len(data.translate(None, _SPACES))


def _mostly_marks(line: str) -> bool:
    """Whether fewer than half of a line's word characters are letters or digits. Bytes tell most lines apart: only one with
    many ASCII marks or characters beyond ASCII is looked at letter by letter."""
    data = line.encode()
    chars = len(line) - len(data) + len(data.translate(None, _SPACES))
    marks = len(data.translate(None, _PLAIN)) + len(line) - len(data.translate(None, _HIGH))
    return 2 * marks > chars and 2 * len(_ALPHANUMERIC.findall(line)) < chars


def line_fault(line: str, n_words: int) -> str | None:
    """Why a line of n_words words is removed whatever stands around it, or None. Lines without words never come here."""
    n_marks = len(_SEPARATORS.findall(line))
    if n_marks >= 2 and 3 * n_marks >= n_words - n_marks:
        return "navigation"
    if 3 * len(_SYMBOLS.findall(line)) >= 2 * n_words and n_words >= 3:
        return "punctuation"
    if n_words >= 3 and _mostly_marks(line):
        return "punctuation"
    if line.count("!") >= n_words >= 3 and _UPPER.search(line) and not _LOWER.search(line):
        return "punctuation"
    if n_words <= TEASER_WORDS and line.rstrip().endswith(TEASERS):
        return "punctuation"
    if n_words <= 25 and _FURNITURE.search(line.lower()):
        return "boilerplate"
    return None


def faults(lines: list[str], counts: list[int]) -> list[str | None]:
    """For each line, with the number of its words, why it is removed, or None."""
    out = [line_fault(line, n) if n else None for line, n in zip(lines, counts)]
    times: dict[str, int] = {}
    run: list[int] = []

    def menu() -> None:
        if len(run) >= SHORT_RUN:
            for i in run:
                out[i] = out[i] or "navigation"
        run.clear()

    for i, (line, n) in enumerate(zip(lines, counts)):
        if not n:
            continue
        times[line] = times.get(line, 0) + 1
        if times[line] > COPIES:
            out[i] = out[i] or "boilerplate"
        if n <= SHORT_WORDS and line.rstrip()[-1:] not in ENDINGS:
            run.append(i)
        else:
            menu()
    menu()
    return out


def repeated_words(hashes: np.ndarray, window: int) -> int:
    """Words within a run of `window` words that is found twice or more in the text."""
    runs = shingle_hashes(hashes, window)
    if len(runs) < 2:
        return 0
    order = np.argsort(runs, kind="stable")
    same = runs[order][1:] == runs[order][:-1]
    if not same.any():
        return 0
    starts = np.zeros(len(hashes) + 1, np.int64)
    twice = np.zeros(len(runs), bool)
    twice[order[1:][same]] = twice[order[:-1][same]] = True
    at = np.flatnonzero(twice)
    starts[at] += 1
    starts[at + window] -= 1
    return int((np.cumsum(starts) > 0).sum())


def judge(text: str, table: WordHashes, min_words: int, window: int, most_repeated: float, most_lost: float) -> tuple:
    words = text.encode().split()
    lines = text.split("\n")
    counts = [len(line.encode().split()) for line in lines]
    found = faults(lines, counts)
    with_words = [line for line, n in zip(lines, counts) if n]
    chars, dup = word_chars(text), len(with_words) - len(set(with_words))
    kept_lines = [line for line, fault in zip(lines, found) if not fault]
    lost, removed = sum(word_chars(line) for line, fault in zip(lines, found) if fault), len(lines) - len(kept_lines)
    repeated = repeated_words(table.of(words), window)
    failed = len(words) < min_words or 100 * repeated > 100 * most_repeated * len(words)
    kept = not failed and lost <= most_lost * chars
    return len(words), chars, len(_SYMBOLS.findall(text)), dup, repeated, len(lines), removed, lost, "\n".join(kept_lines), failed, kept


def clean(docs: DataFrame, text: str = "text", min_words: int = 10, window: int = 5, most_repeated: float = 0.2, most_lost: float = 0.5) -> DataFrame:
    """docs with a struct column `quality`: counts, the text without failing lines, and the verdict.

    One pass over whole texts, no shuffle: each Arrow batch is judged where its partition lies.
    """
    small_batches(docs.sparkSession)
    names = [c for c in docs.columns if c != "quality"]
    schema = T.StructType([docs.schema[c] for c in names] + [T.StructField("quality", VERDICT)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = WordHashes()
        for batch in sliced(batches):
            rows = [judge(t or "", table, min_words, window, most_repeated, most_lost) for t in batch.column("__text").to_pylist()]
            fields = [pa.array(list(x), type=pa.string() if f.name == "cleaned" else pa.bool_() if isinstance(f.dataType, T.BooleanType) else pa.int64()) for f, x in zip(VERDICT, zip(*rows) if rows else [[]] * len(VERDICT), strict=True)]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in names), pa.StructArray.from_arrays(fields, VERDICT.names)], [*names, "quality"])

    return docs.select(*names, F.col(text).cast("string").alias("__text")).mapInArrow(run, schema)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = clean(documents(spark, sf_dir).select("doc_id", "text"))
    return judged.select("doc_id", *(f"quality.{k}" for k in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")))


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: rejected documents go; the others stay without their failing lines, with n_chars to match."""
    judged = clean(docs).filter("quality.kept")
    changed = F.col("quality.n_lines_removed") > 0
    new = {"text": F.when(changed, F.col("quality.cleaned")).otherwise(F.col("text")), "n_chars": F.when(changed, F.length("quality.cleaned").cast("long")).otherwise(F.col("n_chars"))}
    return judged.select(*(new[c].alias(c) if c in new else F.col(c) for c in docs.columns))


def _oracle() -> str:
    """The counts and the rules line by line, in SQL."""
    phrases = "|".join(BOILERPLATE)
    endings = "".join("\\" + c if c in ".])}" else "''" if c == "'" else c for c in ENDINGS)
    return rf"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
w AS (SELECT doc_id, t, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS ws, string_split(t, chr(10)) AS ls FROM d),
grams AS (SELECT doc_id, i, array_to_string(ws[i:i + 4], ' ') AS g FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 3)) AS i FROM w)),
twice AS (SELECT doc_id, i FROM grams QUALIFY count(*) OVER (PARTITION BY doc_id, g) > 1),
repeated AS (SELECT doc_id, count(DISTINCT p) AS n_repeat_words FROM (SELECT doc_id, unnest(range(i, i + 5)) AS p FROM twice) GROUP BY 1),
lines AS (SELECT doc_id, i, ls[i] AS l FROM (SELECT doc_id, ls, unnest(range(1, len(ls) + 1)) AS i FROM w)),
worded AS (SELECT *, len(lw) AS n, list_sum(list_transform(lw, lambda x: length(x))) AS chars FROM (SELECT *, regexp_extract_all(l, '[^\x20\x09-\x0D]+') AS lw FROM lines) WHERE len(lw) > 0),
told AS (SELECT *, row_number() OVER (PARTITION BY doc_id, l ORDER BY i) AS copy, n <= {SHORT_WORDS} AND NOT regexp_matches(l, '[{endings}]\s*$') AS short,
  len(regexp_extract_all(l, '[{SEPARATORS}]')) AS bars, len(regexp_extract_all(l, '[#*$%&|<>]')) AS noise, len(regexp_extract_all(l, '[\p{{L}}\p{{M}}\p{{N}}]')) AS solid, length(l) - length(replace(l, '!', '')) AS bangs FROM worded),
runs AS (SELECT *, sum(CASE WHEN short THEN 0 ELSE 1 END) OVER (PARTITION BY doc_id ORDER BY i) AS run FROM told),
judged AS (SELECT *, (short AND count(*) FILTER (WHERE short) OVER (PARTITION BY doc_id, run) >= {SHORT_RUN}) OR (bars >= 2 AND 3 * bars >= n - bars) OR (n >= 3 AND (3 * noise >= 2 * n OR 2 * solid < chars OR (bangs >= n AND regexp_matches(l, '\p{{Lu}}') AND NOT regexp_matches(l, '\p{{Ll}}'))))
  OR (n <= {TEASER_WORDS} AND regexp_matches(l, '(\.\.\.|…)\s*$')) OR (n <= 25 AND regexp_matches(lower(l), '{phrases}')) OR copy > {COPIES} AS bad FROM runs),
by_line AS (SELECT doc_id, count(*) - count(DISTINCT l) AS n_dup_lines, coalesce(sum(chars) FILTER (WHERE bad), 0) AS lost FROM judged GROUP BY 1),
counted AS (SELECT w.doc_id, len(ws) AS n_words, CAST(coalesce(list_sum(list_transform(ws, lambda x: length(x))), 0) AS BIGINT) AS word_chars, len(regexp_extract_all(t, '[#*$%&|<>]')) AS n_symbols,
  coalesce(n_dup_lines, 0) AS n_dup_lines, coalesce(n_repeat_words, 0) AS n_repeat_words, coalesce(lost, 0) AS lost FROM w LEFT JOIN repeated USING (doc_id) LEFT JOIN by_line USING (doc_id)),
base AS (SELECT *, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed FROM counted)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND 2 * lost <= word_chars AS kept FROM base
"""


ORACLE = _oracle()
