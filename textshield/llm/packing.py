"""Packing token sequences: Martello-Toth reduction, then best fit.

Piece lengths are whole numbers up to the sequence length, so an instance of
any size is a histogram of at most that many counts.  The driver plans on the
histogram alone; rows are matched to the plan by their rank among the pieces of
their length, which is counted in parallel.

Reduction (Martello and Toth, 1990): take the longest piece left.  A set with
it dominates every other set that could stand there if the others' remaining
members fit in place of its own: alone, if nothing else fits beside it; with
one partner, if no choice of other pieces that fits beside it is longer in
total than that partner; with two, if no three others fit, the first is the
longest that fits at all and the second is at least as long as the shorter one
of any two that fit.  Such sets are fixed for as many pieces as there are, and
taken out.  What is left is packed by best fit, longest first.  Best fit is
erratic, so the whole is packed by best fit alone too, and the plan with fewer
sequences is taken.
"""

from __future__ import annotations

from collections import deque
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import materialise, text_or_empty
from .tokenise import word_tokenizer


#: A plan of sequences of 1,024 tokens has at most half a million runs (21 MB).
MOST_PLAN_BYTES = 256 << 20


def _most_beside(counts: np.ndarray, room: int, taken: int) -> int:
    """The largest total up to ``room`` of other pieces; ``taken``: a length of which one is used."""
    sums, mask = 1, (1 << (room + 1)) - 1
    for length in range(1, room + 1):
        n = min(int(counts[length]) - (length == taken), room // length)
        k = 1
        while n > 0:
            step = min(k, n)
            sums |= (sums << (step * length)) & mask
            n -= step
            k *= 2
        if sums >> room & 1:
            return room
    return sums.bit_length() - 1


def _two_beside(counts: np.ndarray, room: int, longest: int) -> int | None:
    """The second partner of a dominating set of three, beside the longest that fits; counts without the first piece."""
    lengths = np.flatnonzero(counts[: room + 1])
    few = np.repeat(lengths, np.minimum(counts[lengths], 3))
    if len(few) >= 3 and few[:3].sum() <= room:
        return None  # three others fit
    rest = counts[: room - longest + 1].copy()
    if longest <= room - longest:
        rest[longest] -= 1
    fits = np.flatnonzero(rest > 0)
    if not len(fits):
        return None
    # the longest piece for which another, at least as long, fits with it
    above = np.append(lengths[1:], room + 1)
    mates = np.where(counts[lengths] > 1, lengths, above)
    shorter = lengths[lengths + mates <= room]
    return int(fits[-1]) if not len(shorter) or shorter[-1] <= fits[-1] else None


def plan(counts: np.ndarray) -> tuple[np.ndarray, int, int]:
    """The better of ``reduced_plan`` with and without its reduction."""
    reduced, plain = reduced_plan(counts), reduced_plan(counts, reduce=False)
    return reduced if reduced[1] <= plain[1] else plain


def reduced_plan(counts: np.ndarray, reduce: bool = True) -> tuple[np.ndarray, int, int]:
    """Runs (length, first rank, number, first sequence, offset); sequences; fixed ones.

    ``counts[n]``: pieces of n tokens; sequences hold ``len(counts) - 1``.
    The ranks r of a run's pieces go to sequence first + (r - first rank), all
    at the run's offset.  Ranks are unsigned and count up within each length.
    """
    size = len(counts) - 1
    left = counts.astype(np.int64).copy()
    used = np.zeros(size + 1, np.int64)
    runs: list[tuple[int, int, int, int, int]] = []
    made = 0

    def put(length: int, number: int, first: int, offset: int) -> None:
        runs.append((length, int(used[length]), number, first, offset))
        used[length] += number
        left[length] -= number

    for long in range(size, 0, -1) if reduce else ():
        while left[long]:
            room = size - long
            inside = np.flatnonzero(left[: room + 1])
            inside = inside[(inside != long) | (left[inside] > 1)]
            if not len(inside):
                n = int(left[long]) if 2 * long > size else 1
                put(long, n, made, 0)
                made += n
                continue
            partner = int(inside[-1])
            if partner != room and partner < _most_beside(left, room, long):
                others = left.copy()
                others[long] -= 1
                second = _two_beside(others, room, partner)
                if second is None:
                    break
                # one set at a time where a length has several parts in it
                n = int(min(left[long], left[partner], left[second])) if len({long, partner, second}) == 3 else 1
                put(long, n, made, 0)
                put(partner, n, made, long)
                put(second, n, made, long + partner)
                made += n
                continue
            # taking sets out leaves others fewer choices, so the rule holds on
            n = int(left[long]) // 2 if partner == long else int(min(left[long], left[partner]))
            put(long, n, made, 0)
            put(partner, n, made, long)
            made += n
    fixed = made
    # best fit on what is left: sequences with equal room are interchangeable
    rooms: dict[int, deque] = {}

    def fill(long: int, first: int, number: int, room: int, each: int) -> None:
        """Put ``each`` pieces one after another into every one of these sequences."""
        for k in range(each):
            put(long, number, first, size - room + k * long)
        rooms.setdefault(room - each * long, deque()).append((first, number))

    for long in range(size, 0, -1):
        # the next piece fits best where one has just gone, as long as there is room for it
        for room in range(long, size):
            while left[long] and rooms.get(room):
                first, number = rooms[room].popleft()
                each = min(room // long, int(left[long]))
                n = min(int(left[long]) // each, number)
                if n < number:
                    rooms[room].appendleft((first + n, number - n))
                fill(long, first, n, room, each)
        # new sequences take as many of this length as fit, one each in turn
        while left[long]:
            each = min(size // long, int(left[long]))
            n = int(left[long]) // each
            fill(long, made, n, size, each)
            made += n
    return np.array(runs, np.int64).reshape(-1, 5), made, fixed


def pieces(docs: DataFrame, tokenizer_json: str, end_id: int, size: int = 1024, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Encode every text, add ``end_id`` and cut those over ``size`` tokens.

    All pieces of a cut text but the first are full.  Returns id, piece, start,
    length, ids (little-endian 32-bit) and, for the ranks, task and nth.
    """
    shared = docs.sparkSession.sparkContext.broadcast(tokenizer_json)
    source = docs.select(F.col(id_col).cast("long").alias("id"), text_or_empty(text_col), F.spark_partition_id())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tok = word_tokenizer(shared.value)
        seen = np.zeros(size + 1, np.int64)
        for b in batches:
            for s in range(0, len(b), 1000):
                part = b.slice(s, 1000)
                rows = [np.append(np.frombuffer(x, tok.dtype), end_id).astype("<u4") for x in tok.encode_batch(part.column(1).to_pylist())]
                which, piece, start, ids = [], [], [], []
                for i, x in enumerate(rows):
                    at = len(x) % size or size
                    cuts = [0, *range(min(at, len(x)), len(x) + 1, size)]
                    for k in range(len(cuts) - 1):
                        which.append(i)
                        piece.append(k)
                        start.append(cuts[k])
                        ids.append(x[cuts[k] : cuts[k + 1]].tobytes())
                length = np.fromiter(map(len, ids), np.int64, len(ids)) // 4
                order = np.argsort(length, kind="stable")
                runs = np.bincount(length, minlength=size + 1)
                nth = np.empty(len(length), np.int64)
                nth[order] = np.arange(len(length)) - np.repeat(np.cumsum(runs) - runs, runs)
                nth += seen[length]
                seen += runs
                n = len(ids)
                yield pa.RecordBatch.from_arrays(
                    [part.column(0).take(pa.array(which, pa.int32())), pa.array(piece, pa.int32()), pa.array(start, pa.int64()), pa.array(length), pa.array(ids, pa.binary()), pa.array(np.full(n, part.column(2)[0].as_py(), np.int32)), pa.array(nth)],
                    names=["id", "piece", "start", "length", "ids", "task", "nth"],
                )

    return source.mapInArrow(run, "id long, piece int, start long, length long, ids binary, task int, nth long")


def pack(cut: DataFrame, size: int = 1024) -> DataFrame:
    """Adds sequence_id and offset to materialised ``pieces``."""
    spark = cut.sparkSession
    by_task = cut.groupBy("length", "task").agg(F.count(F.lit(1)).alias("n"))
    by_task = materialise(by_task)
    counts = np.zeros(size + 1, np.int64)
    for r in by_task.groupBy("length").agg(F.sum("n").alias("n")).collect():  # at most ``size`` rows
        counts[r["length"]] = r["n"]
    runs, _, _ = plan(counts)
    order = np.lexsort((runs[:, 1], runs[:, 0]))
    # at most about size * size runs of five numbers, however many pieces there are
    if runs.nbytes > MOST_PLAN_BYTES:
        raise ValueError(f"a plan of {runs.nbytes} bytes")
    shared = spark.sparkContext.broadcast(runs[order])
    bases = by_task.select("length", "task", (F.sum("n").over(Window.partitionBy("length").orderBy("task")) - F.col("n")).alias("base"))
    ranked = cut.join(materialise(bases), ["length", "task"]).withColumn("rank", F.col("base") + F.col("nth"))

    @F.pandas_udf("sequence_id long, offset long")
    def place(length, rank):
        import pandas as pd

        runs = shared.value
        key = runs[:, 0] * (1 << 52) + runs[:, 1]
        at = np.searchsorted(key, length.to_numpy() * (1 << 52) + rank.to_numpy(), "right") - 1
        return pd.DataFrame({"sequence_id": runs[at, 3] + rank.to_numpy() - runs[at, 1], "offset": runs[at, 4]})

    return ranked.withColumn("at", place("length", "rank")).select("id", "piece", "start", "length", "ids", "at.sequence_id", "at.offset")


def pack_documents(docs: DataFrame, tokenizer_json: str, end_id: int, size: int = 1024, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, piece, start, length, ids, sequence_id, offset of every piece.

    A null text counts as empty and is one piece with the end id.  Repeated
    rows are packed as often as they occur; an empty table gives no rows.
    Other columns of ``docs`` are ignored.
    """
    return pack(materialise(pieces(docs, tokenizer_json, end_id, size, id_col, text_col)), size)
