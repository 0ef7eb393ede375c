"""Near-duplicate vectors by sorted projection passes.

Each pass draws random hyperplanes through the mean of a label and gives every
vector the concatenated signs of its projections.  Vectors are put in
lexicographic order of these within their label, each is compared with the
``window`` that come before it, and pairs whose cosine in double precision
reaches the threshold are links.  Links of all passes are united into
components.  The number of passes grows with the logarithm of the rows, so that
a pair just at the threshold is missed by all of them with a chance of about
``MISS`` where a label's directions are spread evenly.

A window is bounded, a dense group isn't: the components are cut into tiles,
and every pair of a component's tiles is compared in full, which counts the
links that lie farther apart than a window.  With ``exact`` all tiles of a label
are compared instead, so that pairs which no pass brought together are links
too; that grows with the square of a label's rows.  Either way a tile's mean and
its widest angle from it are worked out first, and only tiles between which
these leave room for a link are sent to meet each other.

Equal vectors are one vector with a weight, so a vector that a third of all
rows hold is compared once.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import connected_components, materialise, partitions_for, tiles
from .simhash import spanning

SIGNS = 62
#: Passes at least, and the chance at which all passes miss a pair at the threshold.
PASSES = 16
MISS = 0.001
#: Means of labels are broadcast if they have at most so many numbers in all.
BROADCAST_NUMBERS = 4 << 20
#: Rows of a pass that are compared in one go.
CHUNK = 4096
#: Rows of a tile, and those of them that are multiplied with another tile in one go.
SWEEP_ROWS = 4096
BLOCK = 512


def _signs(x: np.ndarray, pass_: int, seed: int) -> np.ndarray:
    """The order's key: signs of ``SIGNS`` projections, the first one highest."""
    planes = np.random.default_rng([seed, pass_, x.shape[1]]).standard_normal((x.shape[1], SIGNS))
    return (x @ planes >= 0).astype(np.int64) @ (1 << np.arange(SIGNS - 1, -1, -1, dtype=np.int64))


def _matrix(lists: pa.Array, dim: int) -> np.ndarray:
    return lists.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dim)


def _unit(x: np.ndarray) -> np.ndarray:
    return x / np.sqrt((x * x).sum(1))[:, None]


def _near(x: np.ndarray, y: np.ndarray, threshold: float) -> np.ndarray:
    """Which rows of x and y have a cosine of at least ``threshold``."""
    return (x @ y.T) / np.outer(np.sqrt((x * x).sum(1)), np.sqrt((y * y).sum(1))) >= threshold


def passes_for(rows: int, window: int, threshold: float) -> int:
    """Passes so that a pair at the threshold shares a window in one of them, but for ``MISS``.

    A sign differs with the chance angle / pi; some log2(rows / windows) leading
    signs must agree.
    """
    same = 1 - math.acos(max(-1.0, min(1.0, threshold))) / math.pi
    hit = same ** math.log2(max(1.0, rows / (2 * window)))
    return PASSES if hit >= 1 else max(PASSES, math.ceil(math.log(MISS) / math.log1p(-hit)))


def _sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sums of the unit vectors of each label and dimension of a batch."""
    for b in batches:
        dims = b.column("dim").to_numpy()
        labels = b.column("label").cast(pa.string()).dictionary_encode().indices.to_numpy()
        for dim in np.unique(dims).tolist():
            at = np.flatnonzero(dims == dim)
            _, first, own, n = np.unique(labels[at], return_index=True, return_inverse=True, return_counts=True)
            sums = np.zeros((len(first), dim))
            np.add.at(sums, own, _unit(_matrix(b.column("v").take(pa.array(at)), dim)))
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(first) + 1, dtype=np.int32) * dim), pa.array(sums.ravel()))
            yield pa.RecordBatch.from_arrays([b.column("label").take(pa.array(at[first])), pa.array(np.full(len(first), dim, np.int32)), lists, pa.array(n)], names=["label", "dim", "s", "n"])


def _centred(classes: DataFrame) -> DataFrame:
    """``classes`` with the mean of its label's unit vectors."""
    kind = classes.schema["label"].dataType.simpleString()
    sums = classes.select("label", "dim", "v").mapInArrow(_sums, f"label {kind}, dim int, s array<double>, n long")
    parts = sums.select("label", "dim", "n", F.posexplode("s").alias("at", "s")).groupBy("label", "dim", "at").agg((F.sum("s") / F.sum("n")).alias("m"))
    means = materialise(parts.groupBy("label", "dim").agg(F.array_sort(F.collect_list(F.struct("at", "m"))).getField("m").alias("mean")))
    numbers = means.agg(F.sum("dim")).first()[0] or 0
    return classes.join(F.broadcast(means) if numbers <= BROADCAST_NUMBERS else means, ["label", "dim"])


def _spread(passes: int, seed: int):
    """Rows once for each pass, with the pass's code in place of the label's mean."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            dims = b.column("dim").to_numpy()
            for dim in np.unique(dims).tolist():
                part = b.filter(pa.array(dims == dim))
                x = _unit(_matrix(part.column("v"), dim)) - _matrix(part.column("mean"), dim)
                kept = [n for n in part.schema.names if n != "mean"]
                for p in range(passes):
                    yield pa.RecordBatch.from_arrays([*(part.column(n) for n in kept), pa.array(np.full(len(x), p, np.int32)), pa.array(_signs(x, p, seed))], names=[*kept, "pass", "code"])

    return run


def _windows(window: int, threshold: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: pa.RecordBatch | None = None
        for whole in batches:
            for s in range(0, len(whole), CHUNK):
                b = whole.slice(s, CHUNK)
                old = 0 if held is None else len(held)
                t = b if held is None else pa.concat_batches([held, b])
                dims = t.column("dim").to_numpy()
                group = np.stack([t.column("label").cast(pa.string()).dictionary_encode().indices.to_numpy(), t.column("pass").to_numpy(), dims])
                ids = t.column("rep").to_numpy()
                pairs = []
                for dim in np.unique(dims).tolist():
                    at = np.flatnonzero(dims == dim)  # one run: the rows are in order of dim
                    x = _matrix(t.column("v").slice(int(at[0]), len(at)), dim)
                    x /= np.sqrt((x * x).sum(1))[:, None]
                    for d in range(1, min(window, len(at) - 1) + 1):
                        same = (group[:, at[d:]] == group[:, at[:-d]]).all(0) & (at[d:] >= old)
                        near = same & (np.einsum("ij,ij->i", x[d:], x[:-d]) >= threshold)
                        pairs.append((at[:-d][near], at[d:][near]))
                root = spanning(len(ids), iter(pairs))
                own = np.flatnonzero(root != np.arange(len(ids)))
                yield pa.RecordBatch.from_arrays([pa.array(ids[own]), pa.array(ids[root[own]])], names=["a", "b"])
                held = t.slice(max(0, len(t) - window))

    return run


def _weighted(batch: pa.RecordBatch, row: int, payloads: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Ids, weights and vectors of a tile."""
    held = batch.column(payloads)[row].values
    return held.field("rep").to_numpy(), held.field("w").to_numpy(), _matrix(held.field("v"), batch.column("dim")[row].as_py())


def _summaries(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each tile's mean direction and its widest angle from it; null where there is no direction."""
    for b in batches:
        means, wide = [], []
        for r in range(len(b)):
            x = _unit(_weighted(b, r, "payloads")[2])
            mean = x.mean(0)
            length = np.sqrt(mean @ mean)
            if length > 1e-6:
                means.append(mean / length)
                wide.append(np.arccos(np.clip((x @ means[-1]).min(), -1, 1)))
            else:
                means.append(None)
                wide.append(None)
        kept = [n for n in b.schema.names if n not in ("payloads", "n", "orders")]
        yield pa.RecordBatch.from_arrays([*(b.column(n) for n in kept), pa.array(means, pa.list_(pa.float64())), pa.array(wide, pa.float64())], names=[*kept, "mean", "wide"])


def _meeting(cut: DataFrame, key: list[str], threshold: float) -> DataFrame:
    """(tile_a, tile_b, dim) of a key's tiles that may have links; no vectors are moved."""
    fields = "".join(f"{f.name} {f.dataType.simpleString()}, " for f in cut.select(*key).schema)
    ids = materialise(cut.where(~F.col("whole")).select(*key, "tile_id", "payloads").mapInArrow(_summaries, f"{fields}tile_id long, mean array<double>, wide double"))
    a, b = (ids.withColumnsRenamed({c: f"{c}_{s}" for c in ("mean", "wide", "tile_id")}).withColumnRenamed(f"tile_id_{s}", f"tile_{s}") for s in "ab")
    cosine = F.aggregate(F.zip_with("mean_a", "mean_b", lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)
    least = F.acos(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), cosine))) - F.col("wide_a") - F.col("wide_b")
    meet = a.join(b, key).where("tile_a < tile_b").where(F.coalesce(least <= math.acos(threshold) + 1e-6, F.lit(True)))
    return meet.select("tile_a", "tile_b", "dim")


def _found(ids: np.ndarray, n: np.ndarray, root: np.ndarray) -> pa.RecordBatch:
    """(a, b, n): links of row a in this comparison, and the least row b they connect it to."""
    own = np.flatnonzero((n > 0) | (root != np.arange(len(ids))))
    return pa.RecordBatch.from_arrays([pa.array(ids[own]), pa.array(ids[root[own]]), pa.array(n[own].astype(np.int64))], names=["a", "b", "n"])


def _within(threshold: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for r in range(len(b)):
                ids, w, x = _weighted(b, r, "payloads")
                n = np.zeros(len(ids), np.int64)

                def pairs(x=x, w=w, n=n):
                    for s in range(0, len(x), BLOCK):
                        near = _near(x[s : s + BLOCK], x, threshold)
                        near[np.arange(len(near)), s + np.arange(len(near))] = False
                        n[s : s + BLOCK] = near @ w
                        i, j = np.nonzero(near)
                        yield i + s, j

                root = spanning(len(ids), pairs())
                yield _found(ids, n, root)

    return run


def _across(threshold: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for r in range(len(b)):
                ia, wa, x = _weighted(b, r, "payloads")
                ib, wb, y = _weighted(b, r, "payloads_b")
                n = np.zeros(len(x) + len(y), np.int64)

                def pairs(x=x, y=y, wa=wa, wb=wb, n=n):
                    for s in range(0, len(x), BLOCK):
                        near = _near(x[s : s + BLOCK], y, threshold)
                        if not near.any():
                            continue
                        n[s : s + len(near)] = near @ wb
                        n[len(x) :] += wa[s : s + BLOCK] @ near
                        i, j = np.nonzero(near)
                        yield i + s, j + len(x)

                root = spanning(len(n), pairs())
                yield _found(np.concatenate([ia, ib]), n, root)

    return run


def near_duplicates(
    vectors: DataFrame,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
    label_col: str = "label",
    threshold: float = 0.98,
    passes: int | None = None,
    window: int = 32,
    seed: int = 7,
    exact: bool = True,
) -> DataFrame:
    """(id, n_links, component) of every row.

    Without ``exact`` the links are those within components that the passes
    found; with it, all links of a label.  ``passes``: ``passes_for`` by default.

    Rows are compared within a label and a dimension.  Null labels, and null,
    empty or zero vectors or such with null or non-finite parts, have no links
    and are their own component.  Repeated rows are vectors of their own, equal
    ones.  An empty table gives no rows; other columns are ignored.
    """
    spark = vectors.sparkSession
    source = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(label_col).alias("label"), F.col(vector_col).alias("v"))
    finite = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists("v", lambda x: x != 0)
    ok = F.coalesce(F.col("id").isNotNull() & F.col("label").isNotNull() & F.col("v").isNotNull() & finite, F.lit(False))
    source = source.withColumn("ok", ok)
    zero = F.lit(0).cast(source.schema["v"].dataType.elementType)
    usable = source.where("ok").select("id", "label", F.transform("v", lambda x: x + zero).alias("v"))  # -0.0 is 0.0
    usable = materialise(usable.withColumn("h", F.xxhash64("v")))
    classes = materialise(usable.groupBy("label", "h", "v").agg(F.count(F.lit(1)).alias("w"), F.min("id").alias("rep")).withColumn("dim", F.size("v")))
    rows = classes.count()
    passes = passes or passes_for(rows, window, threshold)
    kinds = {f.name: f.dataType.simpleString() for f in classes.schema}
    centred = _centred(classes)
    spread = centred.select("label", "dim", "rep", "v", "mean").mapInArrow(_spread(passes, seed), f"label {kinds['label']}, dim int, rep long, v {kinds['v']}, pass int, code long")
    keys = ["dim", "label", "pass", "code", "rep"]
    ordered = spread.repartitionByRange(partitions_for(spark, rows * passes, 200_000), *keys).sortWithinPartitions(*keys)
    united = materialise(connected_components(ordered.mapInArrow(_windows(window, threshold), "a long, b long")))

    key = ["label", "dim"] if exact else ["root", "dim"]
    members = centred.join(united, centred.rep == united.id, "left" if exact else "inner").select("label", "dim", "rep", "w", "v", "root", "mean")
    members = members.mapInArrow(_spread(1, seed), f"label {kinds['label']}, dim int, rep long, w long, v {kinds['v']}, root long, pass int, code long")
    place = F.struct(F.col("root").isNull().alias("single"), F.coalesce("root", "code").alias("near"), "code", "rep")
    members = materialise(members.select(*key, place.alias("place"), F.struct("rep", "w", "v").alias("held")))
    cut = materialise(tiles(members, key, "place", "held", partitions_for(spark, rows, 20_000), rows=SWEEP_ROWS))
    within = cut.where("n > 1").select("dim", "payloads").mapInArrow(_within(threshold), "a long, b long, n long")
    left = cut.select(F.col("tile_id").alias("tile_a"), "payloads")
    right = cut.select(F.col("tile_id").alias("tile_b"), F.col("payloads").alias("payloads_b"))
    pairs = materialise(_meeting(cut, key, threshold))
    across = pairs.join(left, "tile_a").join(right, "tile_b").mapInArrow(_across(threshold), "a long, b long, n long")
    found = materialise(within.unionByName(across))
    roots = materialise(connected_components(found.select("a", "b"))) if exact else united
    counts = materialise(found.groupBy(F.col("a").alias("rep")).agg(F.sum("n").alias("n")))
    named = classes.join(roots, classes.rep == roots.id, "left").join(counts, "rep", "left")
    named = materialise(named.select("label", "h", "v", (F.coalesce("n", F.lit(0)) + F.col("w") - 1).alias("n_links"), F.coalesce("root", "rep").alias("component")))
    found = usable.join(named, ["label", "h", "v"]).select("id", "n_links", "component")
    return found.unionByName(source.where(~F.col("ok")).select("id", F.lit(0).cast("long").alias("n_links"), F.col("id").alias("component")))
