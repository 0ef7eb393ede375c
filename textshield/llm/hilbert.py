"""Sharding along a Hilbert curve, with DataFrame functions only.

Several columns are quantised to 2 ** ``bits`` steps each; the cell so found
has a place on the Hilbert curve.  Rows in curve order are cut into runs, one
for each shard, so that a shard covers a compact region in all dimensions and
its files' minima and maxima rule them out in range queries on any of them
(``write_shards``, ``read_range``).

Places are counted, not sorted in one task: rows are counted for each cell and
a hash slot within it, the counts add up along the curve (there are at most
2 ** (bits * dimensions) cells), and only rows of one slot are numbered
together.  A cell with a third of all rows spreads over its slots.
"""

from __future__ import annotations

import json
from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import text_or_empty

#: Rows of one slot that are numbered together, about.
SLOT_ROWS = 10_000


def _number(df: DataFrame, name: str) -> Column:
    """A number in the column's order: strings by their first seven bytes."""
    kind = df.schema[name].dataType
    if isinstance(kind, T.StringType):
        return F.conv(F.rpad(F.hex(F.substring(F.col(name).cast("binary"), 1, 7)), 14, "0"), 16, 10).cast("long")
    if isinstance(kind, (T.DateType, T.TimestampType)):
        return F.col(name).cast("timestamp").cast("double")
    return F.col(name).cast("double")


def quantised(df: DataFrame, dims: list[str], bits: int) -> tuple[DataFrame, list[str]]:
    """Adds a step from 0 to 2 ** bits - 1 for each dimension, cut at quantiles.

    Nulls get step 0.  The quantiles are approximate, which shapes the cells
    but not the sizes of shards.
    """
    steps = 1 << bits
    cuts = [i / steps for i in range(1, steps)]
    numbers = df.select(*(_number(df, d).cast("double").alias(f"n{i}") for i, d in enumerate(dims)))
    row = numbers.agg(*(F.percentile_approx(f"n{i}", cuts, 1000).alias(f"n{i}") for i in range(len(dims)))).first()
    names = []
    for i, d in enumerate(dims):
        edges = row[i] or []
        number = _number(df, d).cast("double")
        step = sum((F.when(number > float(e), 1).otherwise(0) for e in edges), F.lit(0))
        names.append(f"_q{i}")
        df = df.withColumn(f"_q{i}", F.coalesce(step, F.lit(0)).cast("int"))
    return df, names


def hilbert_index(axes: Column, n_dims: int, bits: int) -> Column:
    """The place on the Hilbert curve of an array of steps (Skilling, 2004)."""
    steps = F.sequence(F.lit(0), F.lit(n_dims * (bits - 1) - 1)) if bits > 1 else F.array().cast("array<int>")
    levels = [1 << (bits - 1 - i) for i in range(bits - 1)]
    masks = F.array(*map(F.lit, levels)) if levels else F.array(F.lit(0))

    def undo(x: Column, s: Column) -> Column:
        i, q = s % n_dims, F.get(masks, (s / n_dims).cast("int"))
        own, first = F.get(x, i), F.get(x, F.lit(0))
        swap = first.bitwiseXOR(own).bitwiseAND(q - 1)
        return F.when(
            own.bitwiseAND(q) != 0,
            F.transform(x, lambda v, j: F.when(j == 0, v.bitwiseXOR(q - 1)).otherwise(v)),
        ).otherwise(F.transform(x, lambda v, j: F.when((j == 0) | (j == i), v.bitwiseXOR(swap)).otherwise(v)))

    def xor_all(x: Column) -> Column:
        return F.aggregate(x, F.lit(0), lambda a, v: a.bitwiseXOR(v))

    x = F.aggregate(steps, axes, undo)
    x = F.transform(F.sequence(F.lit(1), F.lit(n_dims)), lambda i: xor_all(F.slice(x, F.lit(1), i)))
    last = F.element_at(x, -1)
    turn = F.aggregate(masks, F.lit(0), lambda t, q: t.bitwiseXOR(F.when(last.bitwiseAND(q) != 0, q - 1).otherwise(0)))
    places = F.sequence(F.lit(bits - 1), F.lit(0), F.lit(-1))
    return F.aggregate(places, F.lit(0).cast("long"), lambda p, b: F.aggregate(x, p, lambda r, v: r * 2 + F.call_function("getbit", v.bitwiseXOR(turn), b).cast("long")))


def default_dims(docs: DataFrame, id_col: str = "doc_id") -> list[str]:
    return [d for d in (id_col, "lang", "source", "n_chars") if d in docs.columns]


def shard(docs: DataFrame, n_shards: int = 40, dims: list[str] | None = None, bits: int = 3, id_col: str = "doc_id", text_col: str = "text", whole: bool = False) -> DataFrame:
    """(id, size, text_crc32, shard, slot, curve) of every row; shards' row counts differ by one at most.

    Null texts have no bytes and count as size 16.  Null metadata falls in the
    first step.  Repeated rows get places of their own; an empty table gives no
    rows.  ``dims`` default to doc_id, lang, source and n_chars, as far as the
    table has them; other columns are ignored, or with ``whole`` come along as
    the struct ``row``.
    """
    dims = dims or default_dims(docs, id_col)
    row = ["row"] if whole else []
    text = text_or_empty(text_col)
    slim = docs.select(F.col(id_col).alias("id"), (F.octet_length(text) + 16).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"), *([F.struct("*").alias("row")] if whole else []), *(F.col(d).alias(f"_d{i}") for i, d in enumerate(dims)))
    slim, axes = quantised(slim, [f"_d{i}" for i in range(len(dims))], bits)
    cell = sum((F.col(a) * (1 << (bits * i)) for i, a in enumerate(axes)), F.lit(0))
    total = docs.count()
    slots = max(16, -(-total // SLOT_ROWS))
    slim = slim.select("id", "size", "text_crc32", *row, cell.alias("cell"), F.pmod(F.xxhash64("id", "text_crc32", "size"), F.lit(slots)).cast("int").alias("part"))
    counts = slim.groupBy("cell", "part").agg(F.count(F.lit(1)).alias("n"))
    steps = F.array(*(F.shiftright("cell", bits * i).bitwiseAND((1 << bits) - 1) for i in range(len(axes))))
    cells = counts.groupBy("cell").agg(F.sum("n").alias("m")).withColumn("curve", hilbert_index(steps, len(axes), bits))
    before_cell = cells.select("cell", "curve", (F.sum("m").over(Window.orderBy("curve")) - F.col("m")).alias("cell_base"))
    in_cell = counts.select("cell", "part", (F.sum("n").over(Window.partitionBy("cell").orderBy("part")) - F.col("n")).alias("part_base"))
    bases = in_cell.join(before_cell, "cell").select("cell", "part", "curve", (F.col("cell_base") + F.col("part_base")).alias("base"))
    numbered = slim.withColumn("rn", F.row_number().over(Window.partitionBy("cell", "part").orderBy("id", "size", "text_crc32")) - 1)
    ranked = numbered.join(bases, ["cell", "part"]).withColumn("place", F.col("base") + F.col("rn"))
    # shard s takes places [s * total / n, (s + 1) * total / n), rounded down
    shard_of = F.expr(f"((place + 1) * {n_shards} - 1) div {max(total, 1)}")
    first = F.expr(f"(shard * {max(total, 1)}L) div {n_shards}")
    return ranked.withColumn("shard", shard_of).withColumn("slot", (F.col("place") - first).cast("long")).select("id", "size", "text_crc32", F.col("shard").cast("int").alias("shard"), "slot", "curve", *row)


def write_shards(docs: DataFrame, path: str, n_shards: int = 40, dims: list[str] | None = None, bits: int = 3, rows_per_file: int = 1_000_000, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Write the rows as one folder for each shard, and what each dimension's least and greatest values are.

    Rows lie in curve order, ``rows_per_file`` to a file at most, so a file of a
    large shard is a compact region too.  Returns the table of bounds: shard, n,
    and ``<dim>_min`` and ``<dim>_max``; null where a shard has nulls only.
    Columns come back as they were; one of the name ``shard`` can't be written.
    """
    dims = dims or default_dims(docs, id_col)
    placed = shard(docs, n_shards, dims, bits, id_col, text_col, whole=True)
    file = F.floor(F.col("slot") / rows_per_file)
    dealt = placed.withColumn("_file", file).repartition("shard", "_file").sortWithinPartitions("shard", "slot")
    dealt.select("row.*", "shard").write.partitionBy("shard").option("maxRecordsPerFile", rows_per_file).parquet(f"{path}/rows")
    spark = docs.sparkSession
    stored = T.StructType([*docs.schema.fields, T.StructField("shard", T.IntegerType())])
    spark.createDataFrame([(stored.json(),)], "schema string").coalesce(1).write.parquet(f"{path}/schema")
    rows = spark.read.schema(stored).parquet(f"{path}/rows")
    bounds = rows.groupBy("shard").agg(F.count(F.lit(1)).alias("n"), *(f(d).alias(f"{d}_{name}") for d in dims for name, f in (("min", F.min), ("max", F.max))))
    bounds.coalesce(1).write.parquet(f"{path}/bounds")  # a row for each shard
    return spark.read.parquet(f"{path}/bounds")


def read_range(spark: SparkSession, path: str, ranges: dict[str, tuple[Any, Any]]) -> DataFrame:
    """The rows whose dimensions lie within all ranges (both ends included), from the shards that may hold some.

    Nulls lie in no range.  The driver gets the numbers of the shards.
    """
    bounds = spark.read.parquet(f"{path}/bounds")
    within, inside = F.lit(True), F.lit(True)
    for d, (low, high) in ranges.items():
        within &= (F.col(f"{d}_max") >= F.lit(low)) & (F.col(f"{d}_min") <= F.lit(high))
        inside &= F.col(d).between(low, high)
    wanted = sorted(r["shard"] for r in bounds.where(within).select("shard").collect())
    schema = T.StructType.fromJson(json.loads(spark.read.parquet(f"{path}/schema").first()[0]))
    if not wanted:
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).option("basePath", f"{path}/rows").parquet(*(f"{path}/rows/shard={s}" for s in wanted)).where(inside)
