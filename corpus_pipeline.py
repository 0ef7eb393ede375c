"""The corpus pipeline: five operators, each stage on all that the one before kept."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from textshield.llm import stages
from textshield.llm.common import materialise

#: (name, function of spark, docs and the tables' folder), in order.
STAGES = [
    ("toxicity", stages.drop_toxic),
    ("exact_dedup", stages.drop_exact_copies),
    ("simhash_near_dedup", stages.drop_near_copies),
    ("secret_scans", stages.redact_secrets),
    ("best_fit_packing", stages.pack_sequences),
]

#: SQL can't say what the classifier, the trie join or the packing do.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply the stages to ``documents``; each is written as Parquet and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for i, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = materialise(docs)
    return docs
