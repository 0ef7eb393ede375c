"""Token ids as length-delimited binary records, with an offset index.

A record is framed as in TFRecord files: the length (8 bytes), its masked
CRC-32C (4), the payload, and the payload's masked CRC-32C (4), little-endian.
A payload is the document's id (8 bytes, signed; the least value stands for
null) and its token ids, 2 bytes each if the vocabulary allows, else 4.

Files are written by Spark's own text writer, so a lost executor's file is
written again and half a file is never seen, in any store Spark can write to.
That writer ends each line with a separator; here it is a whole record with an
empty payload, which readers skip.  Files hold ascending, non-overlapping
ranges of document ids.

The index is a Parquet table with each record's file, offset and length, made
from the files after their checksums were verified; a reader that shuffles
takes records from it in any order (``read_records``).
"""

from __future__ import annotations

import functools
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import materialise, shared_dir, text_or_empty
from .tokenise import word_tokenizer

#: Bytes of text whose ids one file takes, about.
FILE_TEXT_BYTES = 24 << 20
NULL_ID = -(1 << 63)

# The Castagnoli polynomial, reflected, and the mask's constant.
_POLYNOMIAL = 0x82F63B78
_MASK = 0xA282EAD8
_BLOCK = 512


def _linear(f) -> np.ndarray:
    """Tables of a linear map of 32 bits, by byte."""
    return np.array([[f(v << (8 * k)) for v in range(256)] for k in range(4)], np.uint32)


def _apply(t: np.ndarray, x: np.ndarray) -> np.ndarray:
    return t[0][x & 255] ^ t[1][(x >> 8) & 255] ^ t[2][(x >> 16) & 255] ^ t[3][x >> 24]


@functools.cache
def _tables() -> tuple[np.ndarray, list[np.ndarray]]:
    """For two bytes at once; and for 1, 2, 4, ... zero bytes."""

    def after_byte(x: int) -> int:
        for _ in range(8):
            x = (x >> 1) ^ (_POLYNOMIAL if x & 1 else 0)
        return x

    one = _linear(after_byte)
    low = np.arange(1 << 16, dtype=np.uint32)
    pair = _apply(one, _apply(one, low))
    shifts = [one]
    for _ in range(40):
        shifts.append(np.stack([_apply(shifts[-1], row) for row in shifts[-1]]))
    return pair, shifts


def crc32c(data: list[bytes]) -> np.ndarray:
    """CRC-32C of each item: blocks of all items at once, then joined."""
    pair, shifts = _tables()
    size = np.fromiter(map(len, data), np.int64, len(data))
    blocks = -(-size // _BLOCK)
    first = np.cumsum(blocks) - blocks
    padded = bytearray(int(blocks.sum()) * _BLOCK)
    for d, stop in zip(data, ((first + blocks) * _BLOCK).tolist(), strict=True):
        padded[stop - len(d) : stop] = d  # zeros in front don't change the state
    words = np.ascontiguousarray(np.frombuffer(padded, "<u2").reshape(-1, _BLOCK // 2).T)
    state = np.zeros(words.shape[1], np.uint32)
    for w in words:
        state = pair[(state ^ w) & 0xFFFF] ^ (state >> np.uint32(16))
    total = np.zeros(len(data), np.uint32)
    by_blocks = np.argsort(-blocks, kind="stable")
    width = _BLOCK.bit_length() - 1
    for k in range(int(blocks.max(initial=0))):
        on = by_blocks[: np.count_nonzero(blocks > k)]
        total[on] = _apply(shifts[width], total[on]) ^ state[first[on] + k]
    start = np.full(len(data), 0xFFFFFFFF, np.uint32)
    for b in range(int(size.max(initial=0)).bit_length()):
        on = (size >> b) & 1 == 1
        start[on] = _apply(shifts[b], start[on])
    return total ^ start ^ np.uint32(0xFFFFFFFF)


def masked(crc: np.ndarray) -> np.ndarray:
    return ((crc >> np.uint32(15)) | (crc << np.uint32(17))) + np.uint32(_MASK)


def frame(payloads: list[bytes]) -> list[bytes]:
    lengths = [len(p).to_bytes(8, "little") for p in payloads]
    heads = masked(crc32c(lengths)).astype("<u4").tobytes()
    tails = masked(crc32c(payloads)).astype("<u4").tobytes()
    return [b"".join((n, heads[4 * i : 4 * i + 4], p, tails[4 * i : 4 * i + 4])) for i, (n, p) in enumerate(zip(lengths, payloads, strict=True))]


def unframe(data: bytes) -> list[tuple[int, bytes]]:
    """(offset, payload) of each record but the empty ones; ValueError if a checksum is wrong."""
    found, at = [], 0
    lengths, heads, tails = [], [], []
    while at < len(data):
        n = int.from_bytes(data[at : at + 8], "little")
        if at + 16 + n > len(data):
            raise ValueError(f"the record at {at} is cut off")
        lengths.append(data[at : at + 8])
        heads.append(data[at + 8 : at + 12])
        tails.append(data[at + 12 + n : at + 16 + n])
        found.append((at, data[at + 12 : at + 12 + n]))
        at += 16 + n
    right = (masked(crc32c(lengths)) == np.frombuffer(b"".join(heads), "<u4")) & (masked(crc32c([p for _, p in found])) == np.frombuffer(b"".join(tails), "<u4"))
    if not right.all():
        raise ValueError(f"wrong checksum in the record at {found[int(np.argmin(right))][0]}")
    return [x for x in found if x[1]]


def write_records(docs: DataFrame, path: str, tokenizer_json: str, end_id: int | None = None, id_col: str = "doc_id", text_col: str = "text") -> str:
    """Encode every text and write the files in ascending id order.

    Null texts count as empty and still get a record.  Null ids come first;
    rows of the same id follow each other.  An empty table makes no file.
    Returns ``path``.
    """
    spark = docs.sparkSession
    text = text_or_empty(text_col)
    size = docs.agg(F.sum(F.octet_length(text)).alias("n")).first()["n"] or 0
    files = max(1, -(-size // FILE_TEXT_BYTES))
    source = docs.select(F.col(id_col).cast("long").alias("id"), text.alias("text")).withColumn("tie", F.xxhash64("text"))
    source = source.repartitionByRange(files, "id", "tie").sortWithinPartitions("id", "tie").select("id", "text")
    shared = spark.sparkContext.broadcast(tokenizer_json)  # a vocabulary file: a few MB, whatever the table

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tok = word_tokenizer(shared.value)
        end = b"" if end_id is None else np.array([end_id], tok.dtype).tobytes()
        for b in batches:
            for s in range(0, len(b), 1000):
                part = b.slice(s, 1000)
                heads = part.column(0).fill_null(NULL_ID).to_numpy().astype("<i8").tobytes()
                ids = tok.encode_batch(part.column(1).to_pylist())
                yield pa.RecordBatch.from_arrays([pa.array(frame([heads[8 * i : 8 * i + 8] + x + end for i, x in enumerate(ids)]), pa.binary())], names=["record"])

    records = source.mapInArrow(run, "record binary").select(F.col("record").cast("string").alias("value"))
    between = frame([b""])[0].decode("iso-8859-1")
    records.write.option("lineSep", between).option("encoding", "iso-8859-1").text(path)
    return path


def index_records(spark: SparkSession, path: str, tokenizer_json: str) -> DataFrame:
    """Read the files back: one row for each record, with what the ids say.

    file, offset and length (of the whole frame) say where it is; start counts
    the ids of all records before it.
    """
    shared = spark.sparkContext.broadcast(tokenizer_json)
    # a file is as large as FILE_TEXT_BYTES or one document make it
    files = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(path).select("path", "content")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        dtype = word_tokenizer(shared.value).dtype
        for b in batches:
            for i in range(len(b)):
                found = unframe(b.column(1)[i].as_py())
                ids = [np.frombuffer(p, dtype, offset=8) for _, p in found]
                n = np.fromiter(map(len, ids), np.int64, len(ids))
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([b.column(0)[i].as_py()] * len(ids), pa.string()),
                        pa.array([at for at, _ in found], pa.int64()),
                        pa.array([16 + len(p) for _, p in found], pa.int64()),
                        pa.array([int.from_bytes(p[:8], "little", signed=True) for _, p in found], pa.int64()),
                        pa.array(n),
                        pa.array(np.cumsum(n) - n, pa.int64()),
                        pa.array([zlib.crc32(x.astype("<u4").tobytes()) for x in ids], pa.int64()),
                    ],
                    names=["file", "offset", "length", "id", "n_tokens", "in_file", "ids_crc32"],
                )

    schema = "file string, offset long, length long, id long, n_tokens long, in_file long, ids_crc32 long"
    index = materialise(files.mapInArrow(run, schema).withColumn("id", F.when(F.col("id") != NULL_ID, F.col("id"))))
    # one row for each file, in the order of their names, which is that of ids
    totals = index.groupBy("file").agg(F.sum("n_tokens").alias("n"))
    bases = totals.select("file", (F.sum("n").over(Window.orderBy(F.regexp_extract("file", r"part-(\d+)", 1).cast("long"))) - F.col("n")).alias("base"))
    return index.join(bases, "file").select("file", "offset", "length", "id", (F.col("base") + F.col("in_file")).alias("start"), "n_tokens", "ids_crc32")


def read_records(spark: SparkSession, index: DataFrame, tokenizer_json: str, seed: int | None = None) -> DataFrame:
    """(id, ids array) of the records that ``index`` lists; with ``seed`` in shuffled order.

    Only the listed byte ranges are decoded, so a sample of the index reads a
    sample of the records.
    """
    shared = spark.sparkContext.broadcast(tokenizer_json)
    paths = index.select("file").distinct()
    wanted = index.groupBy("file").agg(F.sort_array(F.collect_list(F.struct("offset", "length"))).alias("at"))  # bounded by a file's size
    root = [r["dir"] for r in paths.select(F.regexp_replace("file", "/[^/]*$", "").alias("dir")).distinct().collect()]
    if not root:
        return spark.createDataFrame([], "id long, ids array<int>")
    files = spark.read.format("binaryFile").load(root).select(F.col("path").alias("file"), "content").join(wanted, "file")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        dtype = word_tokenizer(shared.value).dtype
        for b in batches:
            for content, at in zip(b.column("content"), b.column("at").to_pylist(), strict=True):
                data = content.as_buffer().to_pybytes()
                parts = [unframe(data[x["offset"] : x["offset"] + x["length"]])[0][1] for x in at]
                yield pa.RecordBatch.from_arrays([pa.array([int.from_bytes(p[:8], "little", signed=True) for p in parts], pa.int64()), pa.array([np.frombuffer(p, dtype, offset=8).astype(np.int32) for p in parts], pa.list_(pa.int32()))], names=["id", "ids"])

    out = files.mapInArrow(run, "id long, ids array<int>").withColumn("id", F.when(F.col("id") != NULL_ID, F.col("id")))
    return out if seed is None else out.orderBy(F.xxhash64("id", F.lit(seed)))


def write_and_index(docs: DataFrame, tokenizer_json: str, end_id: int | None = None, path: str | None = None, id_col: str = "doc_id", text_col: str = "text") -> tuple[str, DataFrame]:
    """Write the files and their index; returns the files' folder and the index."""
    spark = docs.sparkSession
    path = path or shared_dir(spark)
    write_records(docs, f"{path}/records", tokenizer_json, end_id, id_col, text_col)
    index = index_records(spark, f"{path}/records", tokenizer_json)
    return f"{path}/records", materialise(index, f"{path}/index")
