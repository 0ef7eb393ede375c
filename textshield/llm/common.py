"""Helpers shared by the operators: shared-folder tables, tiles, components."""

from __future__ import annotations

import functools
import tempfile
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows that one tile holds at most; bounds what a task compares at once.
TILE_ROWS = 1024


@functools.cache
def _own_root() -> str:
    return "file://" + tempfile.mkdtemp(prefix="spark-textshield-")


def shared_dir(spark: SparkSession) -> str:
    """A new folder that driver and executors can both reach.

    It lies under ``spark.checkpoint.dir``.  Where that is unset and Spark runs
    on one machine (tests) one temporary folder is made for the process; on a
    cluster an unset one is an error.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        root = _own_root()
    return f"{root.rstrip('/')}/textshield-{uuid.uuid4().hex}"


def materialise(df: DataFrame, path: str | None = None) -> DataFrame:
    """Write ``df`` as Parquet in the shared folder and read it again.

    This cuts the lineage, keeps expensive steps from running twice, and what
    is written survives the loss of executors.
    """
    spark = df.sparkSession
    path = path or shared_dir(spark)
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def hot_rows(total: int | None) -> int:
    """Keys of more rows count as hot; there are at most 1,000 of them."""
    return max(1000, (total or 0) // 1000)


def join_hot(rows: DataFrame, entries: DataFrame, key: str, hot: DataFrame, how: str = "inner") -> DataFrame:
    """Join (inner or left) of ``rows`` with ``entries``, which has each key once.

    ``hot``: the keys of so many rows that one task shouldn't get them all; the
    caller bounds their number, and their entries are broadcast.  The other
    keys' rows are dealt by key.
    """
    hot = F.broadcast(hot)
    few = F.broadcast(entries.join(hot, key, "left_semi"))
    many = rows.join(few, key) if how == "inner" else rows.join(hot, key, "left_semi").join(few, key, how)
    return many.unionByName(rows.join(hot, key, "left_anti").join(entries.hint("merge"), key, how))


def text_or_empty(name: str = "text") -> Column:
    return F.coalesce(F.col(name), F.lit(""))


def partitions_for(spark: SparkSession, rows: int, rows_each: int) -> int:
    """Partitions so that each holds about ``rows_each`` rows."""
    least = int(spark.conf.get("spark.sql.shuffle.partitions"))
    return max(least, -(-rows // rows_each))


def tiles(df: DataFrame, key: list[str], order: str, payload: str, n_parts: int, rows: int = TILE_ROWS) -> DataFrame:
    """Cut each key's rows into runs of at most ``rows``, in order.

    The rows are range-partitioned by key and order, so that a key with a
    third of all rows spreads over many tasks and none holds it whole.  Keys
    with a single row give no tile.  Returns key columns, ``tile_id`` (unique),
    ``whole`` (the key has this one tile), ``orders`` and ``payloads``.
    Whether a key goes on in the next partition isn't visible here, so the
    first and last tiles of a partition count as not whole; the join of a
    key's tiles finds out.
    """
    ranged = df.select(*key, F.col(order).alias("_o"), F.col(payload).alias("_p")).repartitionByRange(n_parts, *key, "_o").sortWithinPartitions(*key, "_o")
    source = ranged.select(*key, "_o", "_p", F.spark_partition_id().alias("_part"))
    fields = "".join(f"{f.name} {f.dataType.simpleString()}, " for f in df.select(*key).schema)
    o, p = (df.select(F.col(order)).schema[0].dataType.simpleString(), df.select(F.col(payload)).schema[0].dataType.simpleString())
    schema = f"{fields}tile_id long, whole boolean, n int, orders array<{o}>, payloads array<{p}>"

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.Table] = []
        seq, at, parts_of_key, first = 0, None, 0, True

        def emit(whole: bool) -> pa.RecordBatch:
            nonlocal seq
            t = pa.concat_tables(held).combine_chunks()
            o_arr, p_arr = t["_o"].combine_chunks(), t["_p"].combine_chunks()
            ends = pa.array([0, len(t)], pa.int32())
            columns = {k: t[k].combine_chunks().slice(0, 1) for k in key}
            columns |= {
                "tile_id": pa.array([(part << 32) + seq], pa.int64()),
                "whole": pa.array([whole]),
                "n": pa.array([len(t)], pa.int32()),
                "orders": pa.ListArray.from_arrays(ends, o_arr),
                "payloads": pa.ListArray.from_arrays(ends, p_arr),
            }
            seq += 1
            return pa.RecordBatch.from_arrays(list(columns.values()), names=list(columns))

        part = 0
        for batch in batches:
            t = pa.Table.from_batches([batch])
            if not len(t):
                continue
            part = t["_part"][0].as_py()
            keys = list(zip(*(t[k].to_pylist() for k in key), strict=True))
            start = 0
            size = sum(map(len, held))
            for i in range(len(keys)):
                if keys[i] != at:
                    if i > start:
                        held.append(t.slice(start, i - start))
                    if size:
                        if size > 1 or parts_of_key or first:
                            yield emit(not parts_of_key and not first)
                        first = False
                    held, size, start, parts_of_key, at = [], 0, i, 0, keys[i]
                elif size >= rows:
                    held.append(t.slice(start, i - start))
                    yield emit(False)
                    held, size, start, parts_of_key = [], 0, i, parts_of_key + 1
                size += 1
            held.append(t.slice(start))
        if held:
            yield emit(False)

    return source.mapInArrow(cut, schema)


def tile_pairs(cut: DataFrame, key: list[str]) -> DataFrame:
    """(tile_a, tile_b) of the same key with tile_a < tile_b, ids and key only."""
    ids = cut.where(~F.col("whole")).select(*key, "tile_id")
    a, b = ids.withColumnRenamed("tile_id", "tile_a"), ids.withColumnRenamed("tile_id", "tile_b")
    return a.join(b, key).where("tile_a < tile_b")


def connected_components(edges: DataFrame, most_rounds: int = 60) -> DataFrame:
    """(id, root) for every id in ``edges`` (a, b): root is the least id reachable.

    Alternates large-star and small-star steps (Kiveris et al., 2014) until the
    edges no longer change; each step is a grouped minimum and a join, so that
    no task holds a node's neighbours.  Every step is a table in the shared
    folder.  No edges give no rows.
    """
    e = materialise(edges.where("a is not null and b is not null and a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct())
    mark = _mark(e)
    for _ in range(most_rounds):
        if mark[0] == 0:
            break
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = materialise(both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")))
        large = materialise(both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct())
        least = materialise(large.groupBy("u").agg(F.min("v").alias("m")))
        small = large.join(least, "u").select(F.explode(F.array(F.struct(F.col("v").alias("u"), F.col("m").alias("v")), F.struct("u", F.col("m").alias("v")))).alias("x")).select("x.*").where("u <> v").distinct()
        e = materialise(small)
        was, mark = mark, _mark(e)
        if was == mark:
            break
    else:
        raise RuntimeError(f"components did not settle in {most_rounds} rounds")
    return e.select(F.col("u").alias("id"), F.col("v").alias("root")).unionByName(e.select(F.col("v").alias("id"), F.col("v").alias("root")).distinct())


def _mark(e: DataFrame) -> tuple:
    row = e.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)")), F.sum(F.xxhash64("v", "u", F.lit(7)).cast("decimal(20,0)"))).first()
    return tuple(row)
