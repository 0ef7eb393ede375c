"""Stages of the corpus pipeline: each takes and returns rows of ``documents``.

Rows are carried as one struct beside what a stage adds, so columns of any
names may be there and come back as they were.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import exact, ledger, packing, simhash, toxicity
from .queries import _tokenizer


def _labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/labels.parquet")


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a toxicity score of 0.7 or more go.

    Null and empty texts are scored as texts without words, and stay where most
    labels are clean; rows with a null id are scored like others; repeated rows
    share their fate; an empty table stays empty.
    """
    model = toxicity.train(docs, _labels(spark, sf_dir))
    return toxicity.score(docs, model, whole=True).where("predicted = 0").select("row.*")


def drop_exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the one with the most code points stays, then the least id.

    Null texts count as empty: one of all such rows stays.  Of rows that have
    the kept id and an equal text too one stays, the longest text, then the
    greatest.  Null ids come last.  An empty table stays empty.
    """
    found = exact.exact_duplicates(docs).where("kept").select("id", "text_sha256").distinct()
    rows = docs.select(F.struct("*").alias("row"), F.col("doc_id").alias("own_id"), F.sha2(exact.normalised("text").cast("binary"), 256).alias("own"))
    left = rows.join(found, F.col("own_id").eqNullSafe(F.col("id")) & (F.col("own") == F.col("text_sha256")), "left_semi")
    if not docs.groupBy("doc_id").count().where("count > 1").isEmpty():  # rows that repeat with their id
        text = F.coalesce(F.col("row")["text"], F.lit(""))
        left = left.groupBy("own_id", "own").agg(F.max_by("row", F.struct(F.length(text), text)).alias("row"))
    return left.select("row.*")


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of texts some 0.8 alike in five-word shingles the least id stays.

    Null and wordless texts are near-duplicates of each other.  Rows with a null
    id go unless all ids of their group are null.  Of rows that repeat the kept
    id all stay; an empty table stays empty.
    """
    found = simhash.similar_documents(docs).where(F.col("id").eqNullSafe(F.col("component"))).select("id").distinct()
    rows = docs.select(F.struct("*").alias("row"), F.col("doc_id").alias("own_id"))
    return rows.join(found, F.col("own_id").eqNullSafe(F.col("id")), "left_semi").select("row.*")


def redact_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets are replaced by a mark and n_chars counted anew; no document goes.

    Null texts stay null, with no n_chars; repeated rows are all redacted.
    """
    clean = ledger.redact(docs, ledger.scan(docs))
    return clean.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token sequences of at most 1024, one row for each piece.

    Null and empty texts are one piece with the end id; repeated rows are
    packed as often as they occur; an empty table gives no pieces.
    """
    packed = packing.pack_documents(docs, _tokenizer("byte_bpe_50k.json"), end_id=2)
    return packed.select(F.col("id").alias("doc_id"), "piece", "start", "length", F.crc32("ids").alias("ids_crc32"), "sequence_id", "offset")
