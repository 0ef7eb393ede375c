"""Whitening of embeddings: a covariance made of tiles, then its eigenvectors.

Entries become integers on a grid first, so that counts and sums are exact.
Three passes read the vectors: one sums each dimension; one centres the rows,
cuts them into row-blocks and these into column blocks, and deals the blocks to
pairs of column blocks (tiles), where the two blocks of a row-block are
multiplied and the products of a tile added up; one projects.  A task holds one
row-block and one tile.  The driver gets the sums and the tiles, both bounded by
the number of dimensions, which ``MOST_DIMS`` bounds.

Blocks travel as offsets from the rounded mean, in the narrowest integers that
hold them; the exact mean's fraction is taken off before they are multiplied.
"""

from __future__ import annotations

import decimal
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialise, partitions_for

#: 4,096 dimensions make a covariance of 134 MB, the driver's share.
MOST_DIMS = 4096
#: Rows of a row-block.
BLOCK_ROWS = 2048
#: Eigenvalues under this share of the largest are rounding, not variance.
LEAST_SHARE = 1e-10
#: Integers up to here are added and multiplied as 64-bit ones.
SAFE = 1 << 62
WIDE = decimal.Context(prec=60)


def _on_grid(batch: pa.RecordBatch, name: str, scale: int, shift: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(row numbers, integers) of the usable vectors, one pair for each length.

    Usable vectors aren't null and hold neither nulls nor non-finite entries,
    nor any that a long can't hold.
    """
    col = batch.column(batch.schema.get_field_index(name))
    lengths = np.asarray(pc.fill_null(pc.list_value_length(col), -1))
    flat = pc.list_flatten(col).to_numpy(zero_copy_only=False)
    starts = np.concatenate([[0], np.cumsum(np.maximum(lengths, 0))])[:-1]
    with np.errstate(all="ignore"):
        scaled = np.floor(scale * flat)
        bad = np.concatenate([[0], np.cumsum(~(np.abs(scaled) < SAFE))])
    good = (lengths >= 1) & (bad[starts + np.maximum(lengths, 0)] == bad[starts])
    for d in np.unique(lengths[good]):
        rows = np.flatnonzero(good & (lengths == d))
        yield rows, scaled[starts[rows][:, None] + np.arange(d)].astype(np.int64) + shift


def _wide(values) -> pa.Array:
    """Python integers as decimals of 38 digits; null where they need more."""
    return pa.array([WIDE.create_decimal(v) if abs(v) < 10**38 else None for v in map(int, values)], pa.decimal128(38, 0))


def sums_by_dimension(vectors: DataFrame, scale: int, shift: int) -> DataFrame:
    """(d, dim, n, s): vectors of each length and their sum in each dimension, exact."""

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list] = {}

        def out() -> pa.RecordBatch:
            d = np.concatenate([np.full(k, k) for k in held])
            dims = np.concatenate([np.arange(k) for k in held])
            n = np.concatenate([np.full(k, v[0]) for k, v in held.items()])
            s = [int(hi) * (1 << 31) + int(lo) for v in held.values() for hi, lo in zip(v[1], v[2], strict=True)]
            held.clear()
            return pa.RecordBatch.from_arrays([pa.array(d, pa.int32()), pa.array(dims, pa.int32()), pa.array(n, pa.int64()), _wide(s)], names=["d", "dim", "n", "s"])

        for batch in batches:
            for rows, x in _on_grid(batch, "v", scale, shift):
                was = held.setdefault(x.shape[1], [0, 0, 0])
                hi = x >> 31  # two halves, so that no sum leaves 64 bits
                held[x.shape[1]] = [was[0] + len(rows), was[1] + hi.sum(0), was[2] + (x - (hi << 31)).sum(0)]
            if sum(held) > 1_000_000:
                yield out()
        if held:
            yield out()

    parts = vectors.mapInArrow(add, "d int, dim int, n long, s decimal(38,0)")
    return parts.groupBy("d", "dim").agg(F.sum("n").alias("n"), F.sum("s").cast("decimal(38,0)").alias("s"))


def _blocks(d: int, tile: int) -> list[tuple[int, int]]:
    return [(a, min(a + tile, d)) for a in range(0, d, tile)]


def covariance(vectors: DataFrame, n: int, sums: list[int], scale: int, shift: int, tile: int | None = None, block_rows: int = BLOCK_ROWS) -> np.ndarray:
    """The covariance (divisor ``n``) of the vectors with ``len(sums)`` entries.

    ``tile`` is the width of a column block, by default an eighth of the
    dimensions and 32 at least, so no block is dealt to more than eight tiles.
    """
    d = len(sums)
    cuts = _blocks(d, tile or max(32, -(-d // 8)))
    near = np.array([round(s / n) if abs(s) < 1 << 52 else (2 * s + n) // (2 * n) for s in sums], np.int64)
    rest = np.array([(s - n * int(c)) / n for s, c in zip(sums, near, strict=True)])

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, seq, held, size = TaskContext.get().partitionId(), 0, [], 0

        def out() -> Iterator[pa.RecordBatch]:
            nonlocal seq
            x = np.concatenate(held) - near
            for at in range(0, len(x), block_rows):
                rows = x[at : at + block_rows]
                made = []
                for a, b in cuts:
                    block = rows[:, a:b]
                    most = int(np.abs(block).max())
                    kind = next(k for k in ("<i1", "<i2", "<i4", "<i8") if most <= np.iinfo(k).max)
                    made.append((kind, np.ascontiguousarray(block, kind).tobytes()))
                pairs = [(i, j, k) for i in range(len(cuts)) for j in range(i, len(cuts)) for k in ([0] if i == j else [0, 1])]
                names = ["ti", "tj", "rb", "side", "n", "kind", "data"]
                for i, j, k in pairs:
                    kind, data = made[j if k else i]
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([i], pa.int32()), pa.array([j], pa.int32()), pa.array([(part << 32) + seq], pa.int64()), pa.array([k], pa.int32()), pa.array([len(rows)], pa.int32()), pa.array([kind]), pa.array([data], pa.binary())],
                        names=names,
                    )
                seq += 1
            held.clear()

        for batch in batches:
            for _, x in _on_grid(batch, "v", scale, shift):
                if x.shape[1] == d:
                    held.append(x)
                    size += len(x)
            if size >= block_rows:
                yield from out()
                size = 0
        if size:
            yield from out()

    def emit(at: tuple[int, int], total: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([at[0]], pa.int32()), pa.array([at[1]], pa.int32()), pa.array([total.astype("<f8").tobytes()], pa.binary())], names=["ti", "tj", "data"])

    def multiply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows come by tile, row-block and side; the second side meets the first."""
        at, total, first = None, None, None
        for batch in batches:
            for r in batch.to_pylist():
                a, b = cuts[r["tj"] if r["side"] else r["ti"]]
                block = np.frombuffer(r["data"], r["kind"]).reshape(r["n"], b - a) - rest[a:b]
                if at != (r["ti"], r["tj"]):
                    if total is not None:
                        yield emit(at, total)
                    at, total = (r["ti"], r["tj"]), 0.0
                if r["ti"] == r["tj"]:
                    total = total + block.T @ block
                elif r["side"] == 0:
                    first = block
                else:
                    total = total + first.T @ block
        if total is not None:
            yield emit(at, total)

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, total = None, None
        for batch in batches:
            for r in batch.to_pylist():
                x = np.frombuffer(r["data"], "<f8")
                if at != (r["ti"], r["tj"]):
                    if total is not None:
                        yield emit(at, total)
                    at, total = (r["ti"], r["tj"]), 0.0
                total = total + x
        if total is not None:
            yield emit(at, total)

    spark = vectors.sparkSession
    n_tiles = len(cuts) * (len(cuts) + 1) // 2
    schema = "ti int, tj int, data binary"
    dealt = vectors.mapInArrow(deal, "ti int, tj int, rb long, side int, n int, kind string, data binary")
    dealt = dealt.repartition(partitions_for(spark, 2 * n_tiles * -(-n // block_rows), 256), "ti", "tj", "rb").sortWithinPartitions("ti", "tj", "rb", "side")
    summed = dealt.mapInArrow(multiply, schema).repartition("ti", "tj").sortWithinPartitions("ti", "tj").mapInArrow(add, schema)
    v = np.zeros((d, d))
    for r in summed.collect():  # d * d numbers
        (a, b), (c, e) = cuts[r["ti"]], cuts[r["tj"]]
        block = np.frombuffer(r["data"], "<f8").reshape(b - a, e - c) / n
        v[a:b, c:e] = block
        v[c:e, a:b] = block.T
    return (v + v.T) / 2


def _identity_error(table: DataFrame, n: int, k: int) -> float:
    """The largest absolute entry of the whitened rows' covariance minus the identity."""

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        products, sums = np.zeros((k, k)), np.zeros(k)
        for batch in batches:
            w = pc.list_flatten(batch.column(0)).to_numpy(zero_copy_only=False).reshape(-1, k)
            products += w.T @ w
            sums += w.sum(0)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(k * k + k), pa.int32()), pa.array(np.concatenate([products.ravel(), sums]))], names=["cell", "x"])

    cells = table.select("whitened").mapInArrow(add, "cell int, x double").groupBy("cell").agg(F.sum("x").alias("x")).collect()
    x = np.zeros(k * k + k)
    for r in cells:  # k * k + k numbers
        x[r["cell"]] = r["x"]
    mean = x[k * k :] / n
    return float(np.abs(x[: k * k].reshape(k, k) / n - np.outer(mean, mean) - np.eye(k)).max())


def whiten(table: DataFrame, components: int = 32, id_col: str = "vec_id", vec_col: str = "embedding", scale: int = 64, shift: int = 1_000_000, tile: int | None = None, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """(id, n, deviation decimal(38,0), whitened array<double>, explained array<double>, identity_error).

    An entry c counts as ``floor(scale * c) + shift``; component i of the arrays
    belongs to the i-th largest eigenvalue of the covariance.  ``deviation`` is
    the sum over dimensions of (n * x - S) ** 2, exact, null past 38 digits.

    Vectors that are null or empty, or hold null or non-finite entries or such
    as a long can't hold on the grid, give no row.  A covariance needs vectors
    of one length: the commonest counts, of equally common ones the greater,
    and vectors of other lengths give no row.  Components without variance
    can't be whitened and are left out; a table of which none is left (one
    vector, equal vectors, an empty table) gives no rows.  Repeated rows, equal
    ids and null ids are rows like others; other columns are ignored.
    """
    vectors = table.select(F.col(id_col).alias("id"), F.col(vec_col).cast("array<double>").alias("v"))
    schema = "id {}, n long, deviation decimal(38,0), whitened array<double>, explained array<double>, identity_error double".format(vectors.schema["id"].dataType.simpleString())
    empty = table.sparkSession.createDataFrame([], schema)
    found = materialise(sums_by_dimension(vectors.select("v"), scale, shift))
    best = found.where("dim = 0").orderBy(F.desc("n"), F.desc("d")).limit(1).first()
    if best is None:
        return empty
    d, n = best["d"], best["n"]
    if d > MOST_DIMS:
        raise ValueError(f"vectors of {d} entries; {MOST_DIMS} is the most that one covariance may have")
    sums = [int(r["s"]) for r in sorted(found.where(F.col("d") == d).collect(), key=lambda r: r["dim"])]
    values, axes = np.linalg.eigh(covariance(vectors, n, sums, scale, shift, tile, block_rows))
    order = np.argsort(-values, kind="stable")[:components]
    order = order[values[order] > LEAST_SHARE * max(values.max(), 0)]
    if not len(order):
        return empty
    project = axes[:, order] / np.sqrt(values[order])
    total = float(np.trace(np.diag(values)))
    explained = [float(x) / total for x in values[order]]
    k = len(order)
    s64 = np.array(sums, np.int64) if max(map(abs, sums)) < SAFE else None

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, x in _on_grid(batch, "v", scale, shift):
                if x.shape[1] != d:
                    continue
                if s64 is not None and int(np.abs(x).max()) * n < SAFE:
                    off = n * x - s64
                else:
                    off = n * x.astype(object) - np.array(sums, object)
                most = int(np.abs(off).max())
                exact = off if most * most * d < SAFE else off.astype(object)
                deviation = (exact * exact).sum(1)
                w = (off.astype(np.float64) / n) @ project
                ends = pa.array(np.arange(0, k * len(at) + 1, k), pa.int32())
                ids = batch.column(batch.schema.get_field_index("id")).take(pa.array(at))
                yield pa.RecordBatch.from_arrays([ids, _wide(deviation), pa.ListArray.from_arrays(ends, pa.array(w.ravel()))], names=["id", "deviation", "whitened"])

    white = materialise(vectors.mapInArrow(rows, f"id {vectors.schema['id'].dataType.simpleString()}, deviation decimal(38,0), whitened array<double>"))
    error = _identity_error(white, n, k)
    return white.select("id", F.lit(n).cast("long").alias("n"), "deviation", "whitened", F.array(*map(F.lit, explained)).alias("explained"), F.lit(error).alias("identity_error"))
