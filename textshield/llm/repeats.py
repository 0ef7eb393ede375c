"""Repeated byte strings by prefix-free parsing.

A byte is removed if a string of ``length`` bytes that covers it also starts
anywhere else.  Call such a string a window.

Parse.  A rolling hash runs over every text; the least value within a window is
its trigger.  Neighbouring windows with the same trigger form a phrase: the
bytes they cover.  Phrases overlap, so each window lies whole in exactly one;
and since the trigger depends on the window's bytes alone, equal windows lie in
phrases with equal triggers, at the same place relative to them.

Dictionary.  A trigger seen once has no repeated windows.  Where all phrases of
a trigger are equal, they are repeated whole: the parse says so, no bytes are
looked at.  This settles the inside of copies.  What remains, different phrases
with one trigger, are the edges of repeated passages; each different phrase is
fetched once, whatever the number of its occurrences.

Order.  The phrases of a trigger are the dictionary of which a suffix array is
built (suffixes of ``length`` bytes or more, in byte order); neighbours that
agree on ``length`` bytes are repeated windows, and the parse's counts add
phrases that occur twice.  Together that is the order of all windows of the
corpus, though no task sees more than one trigger's dictionary.

A trigger with more than ``DICTIONARY_PHRASES`` different phrases (a passage
that a third of the texts hold, each in its own surroundings) isn't gathered:
its windows are named by their hash and counted by name, which spreads them.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialise, text_or_empty

GRAM = 64
#: Bytes parsed in one go; positions take 24 bits.
SEGMENT = 2 << 20
DICTIONARY_PHRASES = 500
_POS = np.uint64((1 << 24) - 1)
_BASE, _MIX = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93)


def gram_hashes(data: np.ndarray, gram: int = GRAM) -> np.ndarray:
    """Polynomial hash of the ``gram`` (a power of two) bytes at each position, by doubling."""
    h = data.astype(np.uint64) + np.uint64(1)
    width, power = 1, _BASE
    with np.errstate(over="ignore"):
        while width < gram:
            h = h[:-width] * power + h[width:]
            power = power * power
            width *= 2
        h *= _MIX
    return h


def phrases(data: np.ndarray, offsets: np.ndarray, length: int) -> tuple[np.ndarray, ...]:
    """(text, start, windows, trigger, phrase hash) of the texts data[offsets[i]:offsets[i + 1]]."""
    out = []
    digest = xxhash.xxh3_64_intdigest
    for seg in range(0, max(1, len(data) - length + 1), SEGMENT):
        d = data[seg : seg + SEGMENT + length - 1]
        n = len(d) - length + 1
        if n <= 0:
            break
        full = gram_hashes(d)
        low = (full & ~_POS) | np.arange(len(full), dtype=np.uint64)
        want, width = length - GRAM + 1, 1
        while 2 * width <= want:
            low = np.minimum(low[:-width], low[width:])
            width *= 2
        if width < want:
            low = np.minimum(low[: n], low[want - width : want - width + n])
        at = (low[:n] & _POS).astype(np.int64)
        # a window that runs over the end of its text is none
        ends = np.clip(offsets[1:] - seg, 0, n)
        cover = np.zeros(n + 1, np.int32)
        np.add.at(cover, np.clip(np.maximum(offsets[1:] - seg - length + 1, offsets[:-1] - seg), 0, n), 1)
        np.add.at(cover, ends, -1)
        valid = np.cumsum(cover[:n]) == 0
        first = valid.copy()
        first[1:] &= (at[1:] != at[:-1]) | ~valid[:-1]
        last = valid.copy()
        last[:-1] &= (at[1:] != at[:-1]) | ~valid[1:]
        a, b = np.flatnonzero(first), np.flatnonzero(last)
        if not len(a):
            continue
        text = np.searchsorted(offsets, seg + a, "right") - 1
        view = memoryview(np.ascontiguousarray(d))
        names = np.fromiter([digest(view[s : e + length]) for s, e in zip(a.tolist(), b.tolist(), strict=True)], np.uint64, len(a))
        out.append((text, seg + a - offsets[text], b - a + 1, full[at[a]].view(np.int64), names.view(np.int64)))
    if not out:
        empty = np.empty(0, np.int64)
        return empty, empty, empty, empty, empty
    return tuple(np.concatenate(c) for c in zip(*out, strict=True))


def _buffers(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of a binary column."""
    col = col.cast(pa.large_binary())
    _, offs, data = col.buffers()
    offsets = np.frombuffer(offs, np.int64)[col.offset : col.offset + len(col) + 1]
    data = np.frombuffer(data, np.uint8) if data is not None else np.empty(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def _parse(length: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            data, offsets = _buffers(b.column(2))
            text, start, windows, trigger, name = phrases(data, offsets, length)
            rows = pa.array(text)
            yield pa.RecordBatch.from_arrays([b.column(0).take(rows), b.column(1).take(rows), pa.array(start), pa.array(windows.astype(np.int32)), pa.array(trigger), pa.array(name)], names=["id", "th", "start", "windows", "trigger", "phrase"])

    return run


def _fetch(length: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = b.column(0)
            wanted = b.column(1)
            lens = np.diff(wanted.offsets.to_numpy())
            flat = wanted.flatten()
            row = np.repeat(np.arange(len(b)), lens)
            start, windows = flat.field("start").to_numpy(), flat.field("windows").to_numpy()
            views = [t.as_buffer() for t in texts]
            cut = [views[r][s : s + w + length - 1].to_pybytes() for r, s, w in zip(row.tolist(), start.tolist(), windows.tolist(), strict=True)]
            for s in range(0, len(cut), 20_000):
                part = slice(s, s + 20_000)
                f = flat.slice(s, 20_000)
                yield pa.RecordBatch.from_arrays([f.field("trigger"), f.field("phrase"), f.field("n"), pa.array(cut[part], pa.binary())], names=["trigger", "phrase", "n", "bytes"])

    return run


def repeated_windows(dictionary: list[bytes], counts: list[int], length: int) -> list[np.ndarray]:
    """For each phrase, which of its windows occur again, by the dictionary's suffix array."""
    sizes = [len(p) - length + 1 for p in dictionary]
    data = np.frombuffer(b"".join(dictionary), np.uint8)
    starts = np.cumsum([0, *map(len, dictionary)])[:-1]
    at = np.concatenate([np.arange(s, s + n) for s, n in zip(starts, sizes, strict=True)])
    suffixes = np.lib.stride_tricks.sliding_window_view(data, length)[at]
    keys = np.ascontiguousarray(suffixes).view(f"S{length}").reshape(-1)
    order = np.argsort(keys, kind="stable")
    ordered = suffixes[order]
    equal = (ordered[1:] == ordered[:-1]).all(axis=1)
    again = np.zeros(len(at), bool)
    again[order[1:][equal]] = True
    again[order[:-1][equal]] = True
    parts = np.split(again, np.cumsum(sizes)[:-1])
    return [np.ones(len(p), bool) if c > 1 else p for p, c in zip(parts, counts, strict=True)]


def _runs(again: np.ndarray) -> list[tuple[int, int]]:
    edge = np.flatnonzero(np.diff(np.concatenate([[0], again.view(np.int8), [0]])))
    return list(zip(edge[::2].tolist(), (edge[1::2] - 1).tolist(), strict=True))


_RUNS = pa.list_(pa.struct([("a", pa.int32()), ("b", pa.int32())]))
_RUNS_DDL = "array<struct<a: int, b: int>>"


def _dictionaries(length: int):
    """Rows come sorted by trigger; each trigger's phrases are one dictionary."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, tuple[bytes, int]] = {}
        now, out = None, []

        def settle() -> None:
            names = list(held)
            if len(names) == 1:
                (data, n) = held[names[0]]
                found = [np.full(len(data) - length + 1, n > 1)]
            else:
                found = repeated_windows([held[p][0] for p in names], [held[p][1] for p in names], length)
            for p, again in zip(names, found, strict=True):
                if runs := _runs(again):
                    out.append((now, p, [{"a": a, "b": b} for a, b in runs]))

        def flush() -> pa.RecordBatch:
            cols = list(zip(*out, strict=True)) or [[], [], []]
            out.clear()
            return pa.RecordBatch.from_arrays([pa.array(cols[0], pa.int64()), pa.array(cols[1], pa.int64()), pa.array(cols[2], _RUNS)], names=["trigger", "phrase", "runs"])

        for b in batches:
            for trigger, phrase, n, data in zip(*(b.column(i).to_pylist() for i in range(4)), strict=True):
                if trigger != now:
                    if held:
                        settle()
                    held.clear()
                    now = trigger
                held[phrase] = (data, n)
            yield flush()
        if held:
            settle()
        yield flush()

    return run


def _named_windows(length: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        digest = xxhash.xxh3_128_digest
        for b in batches:
            for trigger, phrase, n, data in zip(*(b.column(i).to_pylist() for i in range(4)), strict=True):
                size = len(data) - length + 1
                names = np.frombuffer(b"".join([digest(data[i : i + length]) for i in range(size)]), "<i8").reshape(-1, 2)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(size, trigger)), pa.array(np.full(size, phrase)), pa.array(np.full(size, n)), pa.array(np.arange(size, dtype=np.int32)), pa.array(names[:, 0].copy()), pa.array(names[:, 1].copy())], names=["trigger", "phrase", "n", "at", "name", "more"])

    return run


def _window_runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        runs = []
        for places in b.column(2).to_pylist():
            again = np.zeros(max(places) + 1, bool)
            again[places] = True
            runs.append([{"a": x, "b": y} for x, y in _runs(again)])
        yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(runs, _RUNS)], names=["trigger", "phrase", "runs"])


def repeated_spans(docs: DataFrame, length: int = 400) -> DataFrame:
    """(id, th, spans) of texts with repeated windows; spans are byte ranges [a, b), unordered.

    ``docs``: id, th (a hash of the text, which with id names the row), data.
    """
    parse = materialise(docs.where(F.octet_length("data") >= length).select("id", "th", "data").mapInArrow(_parse(length), "id long, th long, start long, windows int, trigger long, phrase long"))
    triggers = parse.groupBy("trigger").agg(F.count(F.lit(1)).alias("n"), F.min("phrase").alias("least"), F.max("phrase").alias("most")).where("n > 1")
    # a table of its own, so that the join can split a trigger that periodic text repeats
    triggers = materialise(triggers.select("trigger", (F.col("least") != F.col("most")).alias("differ")))
    seen = materialise(parse.join(triggers, "trigger"))
    whole = seen.where(~F.col("differ")).select("id", "th", F.col("start").alias("a"), (F.col("start") + F.col("windows") + (length - 1)).alias("b"))

    edges = seen.where("differ").drop("differ")
    entries = edges.groupBy("trigger", "phrase").agg(F.count(F.lit(1)).alias("n"), *(F.first(c).alias(c) for c in ("id", "th", "start", "windows")))
    entries = materialise(entries)
    sizes = entries.groupBy("trigger").agg(F.count(F.lit(1)).alias("phrases"))
    hot = materialise(sizes.where(F.col("phrases") > DICTIONARY_PHRASES).select("trigger", F.lit(True).alias("hot")))
    wanted = entries.groupBy("id", "th").agg(F.collect_list(F.struct("start", "windows", "trigger", "phrase", "n")).alias("wanted"))
    wanted = wanted.withColumnsRenamed({"id": "_id", "th": "_th"})
    fetched = docs.join(wanted, docs.id.eqNullSafe(wanted._id) & (docs.th == wanted._th)).select("data", "wanted").mapInArrow(_fetch(length), "trigger long, phrase long, n long, bytes binary")
    fetched = materialise(fetched.join(hot, "trigger", "left"))
    cold = fetched.where("hot is null").select("trigger", "phrase", "n", "bytes").repartition("trigger").sortWithinPartitions("trigger")
    runs = cold.mapInArrow(_dictionaries(length), f"trigger long, phrase long, runs {_RUNS_DDL}")
    if not hot.isEmpty():
        # repartitioned by row: a hot trigger's phrases may lie together
        named = fetched.where("hot").select("trigger", "phrase", "n", "bytes").repartition(F.col("phrase")).mapInArrow(_named_windows(length), "trigger long, phrase long, n long, at int, name long, more long")
        named = materialise(named)
        again = named.groupBy("name", "more").agg(F.sum("n").alias("all")).where("all > 1").select("name", "more")
        places = named.join(again, ["name", "more"], "left_semi").groupBy("trigger", "phrase").agg(F.collect_set("at").alias("at"))
        runs = runs.unionByName(places.mapInArrow(_window_runs, f"trigger long, phrase long, runs {_RUNS_DDL}"))
    runs = materialise(runs)
    found = edges.join(runs, ["trigger", "phrase"]).select("id", "th", "start", F.explode("runs").alias("r"))
    found = found.select("id", "th", (F.col("start") + F.col("r.a")).alias("a"), (F.col("start") + F.col("r.b") + length).alias("b"))
    return whole.unionByName(found).groupBy("id", "th").agg(F.collect_list(F.struct("a", "b")).alias("spans"))


def _cut(data: memoryview, a: np.ndarray, b: np.ndarray) -> tuple[list[tuple[int, int]], list[memoryview]]:
    """Maximal removed runs, and the bytes between them."""
    order = np.argsort(a)
    a, b = a[order], np.maximum.accumulate(b[order])
    new = np.flatnonzero(np.concatenate([[True], a[1:] > b[:-1]]))
    runs = list(zip(a[new].tolist(), b[np.append(new[1:] - 1, len(b) - 1)].tolist(), strict=True))
    kept, at = [], 0
    for s, e in runs:
        kept.append(data[at:s])
        at = e
    return runs, [*kept, data[at:]]


def remove_repeats(docs: DataFrame, length: int = 400, id_col: str = "doc_id", text_col: str = "text", with_bytes: bool = True) -> DataFrame:
    """id, n_bytes, n_removed, n_spans, kept_sha256, removed spans (and kept bytes) of every row.

    Repeats are found between all rows, the same one included, but never across
    the end of a text.  A null text counts as empty.  Rows that repeat another
    repeat all of its windows, so texts of ``length`` bytes or more go
    altogether; an empty table gives no rows; other columns are ignored.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("id"), text_or_empty(text_col).cast("binary").alias("data"))
    rows = rows.select("id", F.xxhash64("data").alias("th"), "data")
    spans = materialise(repeated_spans(rows, length)).withColumnsRenamed({"id": "_id", "th": "_th"})
    joined = rows.join(spans, rows.id.eqNullSafe(spans._id) & (rows.th == spans._th), "left").select("id", "data", "spans")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for data, spans in zip(b.column(1), b.column(2), strict=True):
                view = memoryview(data.as_buffer())
                if spans.is_valid:
                    s = spans.values
                    removed, kept = _cut(view, s.field("a").to_numpy(), s.field("b").to_numpy())
                else:
                    removed, kept = [], [view]
                sha = hashlib.sha256()
                for k in kept:
                    sha.update(k)
                left = sum(map(len, kept))
                out.append((len(view), len(view) - left, len(removed), sha.hexdigest(), [{"a": x, "b": y} for x, y in removed], b"".join(kept) if with_bytes else None))
            cols = list(zip(*out, strict=True)) or [[]] * 6
            kinds = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.list_(pa.struct([("a", pa.int64()), ("b", pa.int64())])), pa.binary()]
            yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array(c, k) for c, k in zip(cols, kinds, strict=True))], names=["id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "removed", "kept"])

    return joined.mapInArrow(run, "id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, removed array<struct<a: long, b: long>>, kept binary")
