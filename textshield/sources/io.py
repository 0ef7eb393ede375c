"""Readers and writers: whole tables in Spark's formats, gated appends."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import Config
from ..operators.audit import mirror, stage_tables, writes
from ..schema import REQUEST


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def read_requests(spark: SparkSession, path: str) -> DataFrame:
    """JSON requests with the fixed front-door type; the line itself as ``raw``."""
    lines = spark.read.text(path).withColumnRenamed("value", "raw")
    return lines.select("raw", F.from_json("raw", REQUEST).alias("r")).select("raw", "r.*")


def stream_requests(spark: SparkSession, path: str) -> DataFrame:
    return spark.readStream.schema(REQUEST).json(path)


def read_templates(spark: SparkSession, path: str) -> DataFrame:
    """Prompt templates: one row for each file."""
    return spark.read.option("wholetext", True).text(path).select(F.regexp_extract(F.input_file_name(), r"([^/]+)\.txt$", 1).alias("name"), F.col("value").alias("template"))


def database_name(uri: Column, default: str) -> Column:
    """The database that a store's address names in its path, else the default."""
    path = F.try_parse_url(uri, F.lit("PATH"))
    name = F.trim(F.regexp_replace(path, "^/+", ""))
    return F.coalesce(F.nullif(name, F.lit("")), F.lit(default))


def append(df: DataFrame, path: str, cfg: Config, forced: bool = False, partition_by: list[str] | None = None) -> bool:
    """Append a stage table if the configuration lets this kind of write run."""
    if not writes(cfg)["forced" if forced else "guarded"]:
        return False
    writer = df.write.mode("append")
    (writer.partitionBy(*partition_by) if partition_by else writer).parquet(path)
    return True


def append_mirror(stage: DataFrame, path: str, cfg: Config) -> bool:
    """The mirror never fails its source: errors give False."""
    if not writes(cfg)["mirror"]:
        return False
    try:
        mirror(stage).write.mode("append").parquet(path)
    except Exception:
        return False
    return True


def write_stages(accepted: DataFrame, path: str, cfg: Config, now: Column | None = None, after_final: Callable[[DataFrame], None] | None = None) -> dict[str, bool]:
    """Write what ``proofread`` accepted as one table for each stage; which writes ran.

    The rows are computed once, into ``accepted``, and the stages read that.
    Text stages are mirrored if the configuration says so.  ``after_final``
    gets the final stage's rows once they are written; what it raises undoes
    nothing and is told as False.
    """
    spark = accepted.sparkSession
    if not writes(cfg)["guarded"]:
        return {}
    accepted.write.mode("overwrite").parquet(f"{path}/accepted")
    tables = stage_tables(spark.read.parquet(f"{path}/accepted"), now if now is not None else F.current_timestamp())
    done = {}
    for name, rows in tables.items():
        done[name] = append(rows, f"{path}/{name}", cfg)
        if not name.startswith("html"):
            done[f"{name}_mirror"] = append_mirror(rows, f"{path}/{name}_mirror", cfg)
    if after_final is not None:
        try:
            after_final(spark.read.parquet(f"{path}/final"))
            done["after_final"] = True
        except Exception:
            done["after_final"] = False
    return done


def write_sheet(rows: DataFrame, path: str) -> None:
    """Report rows as CSV with a header."""
    rows.write.mode("append").option("header", True).option("escape", '"').csv(path)
