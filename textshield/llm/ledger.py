"""Secret scans with an incremental blob ledger.

Every text is a blob named by the SHA-256 of its content.  The ledger, a
Parquet table in the shared folder, has one row for each pair of blob and rule
version that was scanned, with the spans found.  A scan looks up which pairs
the ledger lacks, reads only those blobs, each once however many documents hold
it, appends their rows, and joins spans back to every document.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import hot_rows, join_hot, materialise, shared_dir, text_or_empty

SPANS = "array<struct<kind: string, start: int, end: int>>"
_SPAN_TYPE = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32())]))

# The patterns, kinds in the order in which equal starts are listed.
_ASSIGN = re.compile(r"(?i:password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", re.ASCII)
_WORDS = ("passw", "secret", "token", "apikey", "api_key")
_ACCESS = re.compile(r"AKIA[A-Z0-9]{12,}")
_HEX = re.compile(r"[0-9a-f]{32,}")
KINDS = ("assign", "access", "hex")


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """(kind, start, end) by start, then kind; code points, end exclusive.

    A run that is too short is passed over whole, so asking for the least
    length within the pattern finds the same runs of one alphabet.
    """
    found = []
    low = text.lower()
    if any(w in low for w in _WORDS):
        found += [(m.start(), 0, m.end()) for m in _ASSIGN.finditer(text) if m.end(1) - m.start(1) >= 8]
    if "AKIA" in text:
        found += [(m.start(), 1, m.end()) for m in _ACCESS.finditer(text)]
    found += [(m.start(), 2, m.end()) for m in _HEX.finditer(text)]
    return [(KINDS[k], a, b) for a, k, b in sorted(found)]


@dataclass(frozen=True)
class Rules:
    """A scanner and its version; another version scans every blob anew."""

    version: str = "base-1"
    spans = staticmethod(base_spans)


def scan(docs: DataFrame, ledger: str | None = None, rules: Rules | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, blob, spans) of every row of ``docs``.

    ``ledger`` is the folder of a ledger to use and extend; without one a new
    ledger is started.  A null text counts as empty, which has no spans.
    Repeated rows come back as often as they occur; an empty table gives no
    rows; other columns are ignored.
    """
    rules = rules or Rules()
    spark = docs.sparkSession
    ledger = ledger or shared_dir(spark)
    source = docs.select(F.col(id_col).alias("id"), text_or_empty(text_col).alias("text"))
    named = source.select("id", F.sha2(F.col("text").cast("binary"), 256).alias("blob"), "text")
    paths = materialise(named.select("id", "blob"))
    counts = materialise(paths.groupBy("blob").agg(F.min("id").alias("id"), F.count(F.lit(1)).alias("n")))
    total = counts.agg(F.sum("n")).first()[0]
    hot = counts.where(F.col("n") > hot_rows(total)).select("blob")
    fresh = counts.select("blob", "id")
    known = _read(spark, ledger)
    if known is not None:
        fresh = fresh.join(known.where(F.col("rules") == rules.version).select("blob"), "blob", "left_anti")
    fresh = materialise(fresh.withColumnRenamed("blob", "_blob").withColumnRenamed("id", "_id"))
    unseen = named.join(fresh, (F.col("blob") == F.col("_blob")) & F.col("id").eqNullSafe(F.col("_id")), "left_semi").select("blob", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            spans = [[{"kind": k, "start": s, "end": e} for k, s, e in rules.spans(t)] for t in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(spans, _SPAN_TYPE)], names=["blob", "spans"])

    rows = unseen.mapInArrow(run, f"blob string, spans {SPANS}")
    # rows repeated with id and text would else enter the ledger twice
    rows = rows.groupBy("blob").agg(F.max("spans").alias("spans"))
    rows.select("blob", F.lit(rules.version).alias("rules"), "spans").write.mode("append").option("compression", "zstd").parquet(ledger)
    # two scans at once may both have entered a blob
    found = _read(spark, ledger).where((F.col("rules") == rules.version) & (F.size("spans") > 0)).groupBy("blob").agg(F.max("spans").alias("spans"))
    return join_hot(paths, materialise(found), "blob", hot, "left").select("id", "blob", F.coalesce("spans", F.array().cast(SPANS)).alias("spans"))


def _read(spark, ledger: str) -> DataFrame | None:
    path = spark._jvm.org.apache.hadoop.fs.Path(ledger)
    if not path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path):
        return None
    return spark.read.schema(f"blob string, rules string, spans {SPANS}").parquet(ledger)


def redact(docs: DataFrame, found: DataFrame, id_col: str = "doc_id", text_col: str = "text", mark: str = "[SECRET]") -> DataFrame:
    """``docs`` with the spans of ``scan`` replaced by ``mark``; other rows as they are.

    Rows are matched by id and content.  Overlapping spans are replaced as one.
    A null text stays null; repeated rows are all replaced; an empty table gives
    no rows; other columns stay as they are, whatever their names.
    """
    spans = found.where(F.size("spans") > 0).select("id", "blob", "spans").groupBy("id", "blob").agg(F.max("spans").alias("spans"))
    keyed = docs.select(F.struct("*").alias("row"), F.col(id_col).alias("own_id"), F.sha2(text_or_empty(text_col).cast("binary"), 256).alias("key"))
    joined = keyed.join(spans, F.col("own_id").eqNullSafe(F.col("id")) & (F.col("key") == F.col("blob")), "left")
    text = F.col("row")[text_col]
    merged = F.aggregate(
        F.array_sort(F.transform("spans", lambda s: F.struct(s["start"].alias("a"), s["end"].alias("b")))),
        F.struct(F.lit("").alias("out"), F.lit(0).alias("at")),
        lambda acc, s: F.struct(
            F.when(s["a"] >= acc["at"], F.concat(acc["out"], F.substring(text, acc["at"] + 1, s["a"] - acc["at"]), F.lit(mark))).otherwise(acc["out"]).alias("out"),
            F.greatest(acc["at"], s["b"]).alias("at"),
        ),
        lambda acc: F.concat(acc["out"], F.substring(text, acc["at"] + 1, F.length(text))),
    )
    clean = F.when(F.col("spans").isNotNull(), merged).otherwise(text)
    return joined.select(*(clean.alias(c) if c == text_col else F.col("row")[c].alias(c) for c in docs.columns))
