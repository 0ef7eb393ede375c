"""Tables that are updated in place: buckets by key, rewritten where rows arrive.

A stored row has a key, the time it was created, and for each field its latest
value that isn't null, with the number that says how late it is.  Merging is
associative, so rows may come in any order and again: two updates are one.
"""

from __future__ import annotations

import tempfile
import uuid

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

BUCKET = "bucket"


def scratch(spark: SparkSession) -> str:
    """A new folder that driver and executors share; one of this machine's only where Spark runs on it alone."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        root = "file://" + tempfile.mkdtemp(prefix="spark-textshield-")
    return f"{root.rstrip('/')}/store-{uuid.uuid4().hex}"


def read_store(spark: SparkSession, path: str) -> DataFrame | None:
    """The stored table with its bookkeeping, or None where nothing is stored yet."""
    try:
        return spark.read.parquet(path)
    except AnalysisException as e:
        if e.getCondition() in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):
            return None
        raise


def _merged(rows: DataFrame, fields: list[str], key: str, created: str) -> DataFrame:
    """One row for each key, of rows that have a struct (seq, value) for each field."""
    latest = [F.max(f).alias(f) for f in fields]
    return rows.groupBy(BUCKET, key).agg(*latest, F.min(created).alias(created))


def upsert(rows: DataFrame, path: str, fields: list[str], key: str = "report_id", seq: str = "seq", created: str = "created_at", buckets: int = 256) -> list[int]:
    """Merge rows into the table at ``path``; the buckets that were rewritten.

    Only buckets with an arriving key are read and written; the files of the
    others stay as they are.  ``buckets`` is fixed when the table is made.  The
    merged buckets are written beside the table first and then put in their
    place, so a run that fails on the way can be repeated.  Rows with a null key
    are left out; of values with one number the greatest stays.  One writer at
    a time.
    """
    spark = rows.sparkSession
    numbered = [F.when(F.col(f).isNotNull(), F.struct(F.col(seq).alias("seq"), F.col(f).alias("value"))).alias(f) for f in fields]
    bucket = F.pmod(F.xxhash64(F.col(key).cast("string")), F.lit(buckets)).cast("int").alias(BUCKET)
    fresh = _merged(rows.where(F.col(key).isNotNull()).select(bucket, key, *numbered, created), fields, key, created)
    staged = f"{path.rstrip('/')}_staged/{uuid.uuid4().hex}"
    fresh.write.parquet(f"{staged}/fresh")
    fresh = spark.read.schema(fresh.schema).parquet(f"{staged}/fresh")
    touched = sorted(r[0] for r in fresh.select(BUCKET).distinct().collect())  # at most ``buckets``
    if not touched:
        return []
    old = read_store(spark, path)
    both = fresh if old is None else fresh.unionByName(old.where(F.col(BUCKET).isin(touched)).select(*fresh.columns))
    merged = _merged(both, fields, key, created)
    merged.write.parquet(f"{staged}/merged")
    ready = spark.read.schema(merged.schema).parquet(f"{staged}/merged")
    ready.repartition(BUCKET).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(BUCKET).parquet(path)
    return touched


def stored_rows(spark: SparkSession, path: str, fields: list[str], key: str = "report_id", created: str = "created_at") -> DataFrame:
    """The table as rows: key, each field's latest value, the first creation time."""
    return spark.read.parquet(path).select(key, *(F.col(f)["value"].alias(f) for f in fields), created)
