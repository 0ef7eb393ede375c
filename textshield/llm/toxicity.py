"""Toxicity: averaged subword embeddings with a linear softmax.

A text is lower-cased and cut into words; a word's features are the word and
the n-grams of its UTF-8 bytes between boundary marks, each hashed to a row of
an embedding table.  The text's vector is the mean over all its features, and a
softmax over it gives the two classes.  Table and softmax are learned together
in numpy by AdaGrad, a text at a time.  A misspelt word that no text had before
still shares most of its n-grams with words that were learned.

Scoring is exact and cheap because everything up to the softmax is linear: a
feature's vector is only needed through its product with the class weights.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import text_or_empty

_WORD = re.compile(r"\w+")
#: Distinct words that a worker remembers at most.
CACHE_WORDS = 200_000


@dataclass(frozen=True)
class Settings:
    #: Labelled rows of each class that the model is fitted on, at most.
    train_clean_rows: int = 3000
    train_toxic_rows: int = 1000
    #: Their texts' bytes, at most; rows beyond it are left out.
    train_bytes: int = 64 << 20
    buckets: int = 1 << 18
    dim: int = 8
    least_gram: int = 3
    most_gram: int = 5
    #: Features of fewer training texts are not learned.
    least_rows: int = 4
    damping: float = 1e-4
    epochs: int = 8
    rate: float = 1.0
    seed: int = 17


@dataclass(frozen=True)
class Model:
    """``weight``: each feature's share of the log-odds; ``bias``: those of no text."""

    weight: list[float]
    bias: float
    settings: Settings


def features(word: str, s: Settings) -> list[int]:
    w = b"<" + word.encode("utf-8", "replace") + b">"
    n = len(w)
    crc, buckets = zlib.crc32, s.buckets
    found = [crc(w, 1) % buckets]
    for size in range(s.least_gram, min(s.most_gram, n - 1) + 1):
        found += [crc(w[i : i + size]) % buckets for i in range(n - size + 1)]
    return found


def _bag(text: str, s: Settings, known: dict[str, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Different features of a text and their shares."""
    all_ = [np.empty(0, np.int32)]
    for w in _WORD.findall(text.lower()):
        f = known.get(w)
        if f is None:
            if len(known) >= CACHE_WORDS // 10:
                known.clear()
            f = known[w] = np.array(features(w, s), np.int32)
        all_.append(f)
    index, count = np.unique(np.concatenate(all_), return_counts=True)
    return index, (count / max(1, int(count.sum()))).astype(np.float32)


def fit(texts: list[str], labels: list[int], s: Settings | None = None) -> Model:
    """Learn from texts labelled 0 or 1.  Of no texts, or one class alone: the same score for all."""
    s = s or Settings()
    rng = np.random.default_rng(s.seed)
    y = np.array(labels, np.int64)
    if not len(y) or y.min() == y.max():
        return Model([0.0] * s.buckets, (20.0 if len(y) and y[0] else -20.0), s)
    known: dict[str, np.ndarray] = {}
    bags = [_bag(t, s, known) for t in texts]
    known.clear()
    rows = np.zeros(s.buckets, np.int64)
    for index, _ in bags:
        rows[index] += 1
    taught = rows >= s.least_rows
    for i, (index, share) in enumerate(bags):  # one by one: the driver holds them once
        bags[i] = index[taught[index]], share[taught[index]]
    table = np.zeros((s.buckets, s.dim), np.float32)  # what no text taught has no say
    moved = np.full(s.buckets, s.damping, np.float32)
    out = rng.normal(0, 1, (s.dim, 2)).astype(np.float32)
    bias, out_moved = np.zeros(2, np.float32), 1e-3
    for epoch in range(s.epochs):
        rate = s.rate * (1 - epoch / s.epochs)
        for i in rng.permutation(len(y)):
            index, share = bags[i]
            hidden = share @ table[index]
            z = hidden @ out + bias
            p = np.exp(z - z.max())
            p /= p.sum()
            p[y[i]] -= 1
            back = out @ p
            size = float(back @ back)
            out_moved += float(hidden @ hidden + 1) * float(p @ p)
            step = rate / np.sqrt(out_moved)
            out -= step * np.outer(hidden, p)
            bias -= step * p
            moved[index] += share * share * size
            table[index] -= np.outer(rate * share / np.sqrt(moved[index]), back)
    turn = (out[:, 1] - out[:, 0]).astype(np.float64)
    return Model((table.astype(np.float64) @ turn).tolist(), float(bias[1] - bias[0]), s)


def score_texts(model: Model, texts: list[str | None], known: dict[str, tuple[float, int]]) -> np.ndarray:
    """Probability of class 1.  ``known`` remembers words between calls."""
    odds, weight = np.empty(len(texts)), model.weight
    for i, t in enumerate(texts):
        total, count = 0.0, 0
        for w in _WORD.findall((t or "").lower()):
            got = known.get(w)
            if got is None:
                if len(known) >= CACHE_WORDS:
                    known.clear()
                f = features(w, model.settings)
                got = known[w] = (sum([weight[x] for x in f]), len(f))
            total += got[0]
            count += got[1]
        odds[i] = total / max(1, count) + model.bias
    return 1 / (1 + np.exp(-np.clip(odds, -500, 500)))


def held_out(id_col: str) -> Column:
    """Rows that never teach: crc32 of the id as text leaves 1 on division by 3."""
    return F.coalesce(F.pmod(F.crc32(F.col(id_col).cast("string").cast("binary")), F.lit(3)) == 1, F.lit(False))


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", settings: Settings | None = None) -> Model:
    """Fit on labelled rows that aren't held out.

    At most ``train_clean_rows`` and ``train_toxic_rows`` rows are used, those
    whose ids hash lowest, as far as their texts have no more than
    ``train_bytes``; so the one task that fits them holds a bounded number,
    whatever the tables' size, and the driver gets the weights alone.  An id with labels of both kinds is left out; of several texts of one
    id the least is taken.  Null ids and labels teach nothing; without labels
    every text gets the same score.
    """
    s = settings or Settings()
    ids = labels.where(F.col(id_col).isNotNull() & F.col(label_col).isin(0, 1) & ~held_out(id_col)).groupBy(id_col).agg(F.min(label_col).alias("least"), F.max(label_col).alias("most")).where("least = most")
    ids = ids.select(F.col(id_col).alias("_id"), F.col("least").cast("int").alias("_y"), F.xxhash64(F.col(id_col), F.lit(s.seed)).alias("_h"))
    # as many rows as the two bounds allow, so small enough to broadcast
    chosen = ids.where("_y = 0").orderBy("_h").limit(s.train_clean_rows).unionByName(ids.where("_y = 1").orderBy("_h").limit(s.train_toxic_rows))
    rows = docs.select(F.col(id_col).alias("_id"), text_or_empty(text_col).alias("_t")).join(F.broadcast(chosen), "_id").groupBy("_id", "_y", "_h").agg(F.min("_t").alias("_t"))
    # a window over the few rows that were chosen
    rows = rows.withColumn("_b", F.sum(F.octet_length("_t")).over(Window.orderBy("_h", "_id"))).where(F.col("_b") <= s.train_bytes).select("_id", "_t", "_y")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        taught = sorted((r for b in batches for r in zip(*(c.to_pylist() for c in b.columns), strict=True)), key=lambda r: r[0])
        model = fit([t for _, t, _ in taught], [y for _, _, y in taught], s)
        yield pa.RecordBatch.from_arrays([pa.array([model.weight]), pa.array([model.bias])], names=["weight", "bias"])

    found = rows.coalesce(1).mapInArrow(run, "weight array<double>, bias double").first()
    return Model(found["weight"], found["bias"], s) if found else fit([], [], s)


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text", threshold: float = 0.7, whole: bool = False) -> DataFrame:
    """id (with ``whole`` the row, as a struct), score, predicted for every row.

    Null and empty texts are scored too: a text without words has the bias
    alone.  Repeated rows get the same score; an empty table gives no rows;
    other columns don't count, whatever their names.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)
    kept = F.struct("*").alias("row") if whole else F.col(id_col).alias("id")
    source = docs.select(kept, text_or_empty(text_col).alias("text"))
    schema = T.StructType([source.schema[0], T.StructField("score", T.DoubleType()), T.StructField("predicted", T.IntegerType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model, known = shared.value, {}
        for b in batches:
            p = score_texts(model, b.column(b.num_columns - 1).to_pylist(), known)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(p), pa.array((p >= threshold).astype(np.int32))], names=[b.schema.names[0], "score", "predicted"])

    return source.mapInArrow(run, schema)
