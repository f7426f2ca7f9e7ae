"""The corpus pipeline: documents through five of the text operators, each stage written as Parquet and read again."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from platterlens.llm import bpe, exact_dedup, ngram_jaccard, quality_rules, source_mix
from platterlens.llm.common import documents, drop_written, written

STAGES = [
    ("quality rules", quality_rules.stage),
    ("exact dedup", exact_dedup.stage),
    ("n-gram Jaccard join", ngram_jaccard.stage),
    ("source mix", source_mix.stage),
    ("BPE encoding and decoding", bpe.stage),
]

#: Seeded draws and the vocabulary's merges have no SQL; tests/llm/test_pipeline.py holds run() against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows over documents. Every stage but the last is a written table in the shared folder, so a lost
    executor never costs more than a part of one stage."""
    docs, held = documents(spark, sf_dir), None
    for i, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i + 1 < len(STAGES):
            docs = written(docs, "stage-" + name.replace(" ", "-"))
            if held is not None:
                drop_written(held)  # a stage reads its predecessor's table alone
            held = docs
    return docs
