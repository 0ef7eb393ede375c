"""Joins of intervals by bins: equal keys and bins meet, overlaps decide.

A join on a key alone compares all intervals of one text with all others.  Here
each interval is listed in every bin that it touches, and only those of one bin
are compared; a pair that shares several bins is told in the first of them.
A text with very many spans spreads over its bins.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _bins(df: DataFrame, width: int, name: str) -> DataFrame:
    """A row for each bin; an interval without length is in the bin of its place."""
    bin_of = lambda c: F.floor(c / width).cast("long")
    last = F.greatest(F.col("en") - 1, F.col("st"))
    return df.withColumn("_first", bin_of(F.col("st"))).withColumn(name, F.explode(F.sequence(bin_of(F.col("st")), bin_of(last))))


def _overlap(a: str, b: str) -> Column:
    return (F.col(f"{a}.st") < F.col(f"{b}.en")) & (F.col(f"{b}.st") < F.col(f"{a}.en"))


def overlapping(a: DataFrame, b: DataFrame, key: str, width: int = 64) -> DataFrame:
    """(key, a, b): each pair of rows with one key that overlap, as structs, once.

    Both need ``st`` and ``en``; rows with a null key or place meet nothing.
    ``width`` should be about the length of the longer intervals.
    """
    row = lambda df: df.where(f"`{key}` is not null and st is not null and en is not null").select(F.col(key).alias("_key"), "st", "en", F.struct(*df.columns).alias("row"))
    left, right = _bins(row(a), width, "_bin").alias("a"), _bins(row(b), width, "_bin").alias("b")
    met = left.join(right, (F.col("a._key") == F.col("b._key")) & (F.col("a._bin") == F.col("b._bin")) & _overlap("a", "b"))
    once = met.where(F.col("a._bin") == F.greatest("a._first", "b._first"))
    return once.select(F.col("a._key").alias(key), F.col("a.row").alias("a"), F.col("b.row").alias("b"))


def apart(a: DataFrame, b: DataFrame, key: str, width: int = 64) -> DataFrame:
    """The rows of ``a`` that overlap no row of ``b`` with their key.

    Rows with a null key or place overlap nothing and stay; repeated rows stay
    as often as they occur.
    """
    whole = F.struct(*a.columns)
    named = a.select(F.monotonically_increasing_id().alias("_rid"), F.col(key).alias("_key"), F.col("st"), F.col("en"), whole.alias("row"))
    placed = "_key is not null and st is not null and en is not null"
    other = b.where(f"`{key}` is not null and st is not null and en is not null").select(F.col(key).alias("_key"), "st", "en")
    left, right = _bins(named.where(placed), width, "_bin").alias("a"), _bins(other, width, "_bin").alias("b")
    met = left.join(right, (F.col("a._key") == F.col("b._key")) & (F.col("a._bin") == F.col("b._bin")) & _overlap("a", "b"), "left")
    free = met.groupBy("a._rid").agg(F.first("a.row").alias("row"), F.count("b.st").alias("n")).where("n = 0")
    return free.select("row.*").unionByName(named.where(f"NOT coalesce({placed}, false)").select("row.*"))
