"""Exact duplicates by an extendible-hash index on shared files.

Two texts are equal when they are identical after deleting ASCII white space.
Only DataFrame functions are used.

1. Every text gets a 64-bit hash.  The directory is the hashes' leading bits:
   it begins with buckets of twice the wanted size or more, and a bucket with
   more than ``bucket_rows`` different hashes is overfull and split by one more
   bit, until none is or the directory has 2 ** ``MOST_BITS`` slots.
2. The directory sends every text to its bucket, and each run of buckets to the
   task that owns it.  There a bucket's texts are grouped by hash and bytes:
   texts that share a hash but differ form a chain.  Hashes of so many rows
   that an owner would be overrun are dealt over all owners, and what these
   found for one text, a row each, is added up.
3. The entries are written to shared files in bucket order, the directory
   beside them, and every row is matched with its entry by bucket and hash; in
   a chain by its bytes.

A later run can look rows up in the written index (``lookup``).
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import hot_rows, join_hot, materialise, partitions_for, shared_dir, text_or_empty

#: The characters that don't count.
WHITE_SPACE = " \t\n\x0b\x0c\r"
#: The directory has at most 2 ** MOST_BITS slots, so it can be broadcast.
MOST_BITS = 20
#: Normalised text that one owner takes, about.
OWNER_BYTES = 64 << 20

#: 2 ** 65, more than the ids that follow it need.
_STEP = f"{2**65}BD"


def normalised(text_col: str = "text") -> Column:
    return reduce(lambda text, blank: F.replace(text, F.lit(blank), F.lit("")), WHITE_SPACE, text_or_empty(text_col))


def hashed(norm: Column) -> Column:
    return F.xxhash64(norm)


def _prefix(h: str, depth: int) -> Column:
    """The first ``depth`` bits of h; 0 bits give 0."""
    return F.call_function("shiftrightunsigned", F.col(h), F.lit(64 - depth)) if depth else F.lit(0).cast("long")


def directory(hashes: DataFrame, bucket_rows: int = 512, most_bits: int = MOST_BITS) -> tuple[DataFrame, int]:
    """Slots (slot, bucket, depth) and the directory's depth.

    ``hashes`` has each h once.  A hash's slot is its first bits, as many as
    the directory's depth; a bucket is named by its first slot and has as many
    slots as its depth leaves open.  Slots of no hash are left out.
    """
    ends = materialise(hashes.groupBy(_prefix("h", most_bits).alias("end")).agg(F.count(F.lit(1)).alias("n")))
    rows = ends.agg(F.sum("n")).first()[0] or 0
    first = min(most_bits, max(0, (rows // bucket_rows).bit_length() - 2))
    nodes = ends.withColumn("depth", F.explode(F.sequence(F.lit(first), F.lit(most_bits))))
    nodes = nodes.select("depth", F.expr(f"shiftright(end, {most_bits} - depth)").alias("bits"), "n").groupBy("depth", "bits").agg(F.sum("n").alias("n"))
    nodes = materialise(nodes.withColumn("over", (F.col("n") > bucket_rows) & (F.col("depth") < most_bits)))
    # a bucket is a node that isn't overfull, under one that was split
    split = nodes.where("over").select((F.col("depth") + 1).alias("depth"), F.explode(F.array(F.col("bits") * 2, F.col("bits") * 2 + 1)).alias("bits"))
    buckets = nodes.where("not over").join(split.withColumn("under", F.lit(True)), ["depth", "bits"], "left").where((F.col("depth") == first) | F.col("under"))
    buckets = materialise(buckets.select("depth", "bits"))
    deep = buckets.agg(F.max("depth")).first()[0] or 0
    low = F.expr(f"shiftleft(bits, {deep} - depth)")
    slots = buckets.select(low.alias("bucket"), "depth", F.explode(F.sequence(low, low + F.expr(f"shiftleft(1L, {deep} - depth)") - 1)).alias("slot"))
    return materialise(slots.select("slot", "bucket", "depth")), deep


def _route(rows: DataFrame, slots: DataFrame, deep: int) -> DataFrame:
    """Adds bucket and depth.  The directory has at most 2 ** MOST_BITS rows."""
    return rows.withColumn("slot", _prefix("h", deep)).join(F.broadcast(slots), "slot", "left").drop("slot")


def _rank() -> Column:
    """More code points first, then the least id, as one number.

    A number is an aggregate that Spark keeps in its hash table; a struct would
    make it sort whole texts.  A null id comes after all others.
    """
    low = "coalesce(9223372036854775807BD - cast(id as decimal(20,0)), -1BD)"
    return F.expr(f"cast(cast(chars as decimal(10,0)) * {_STEP} + {low} as decimal(38,0))")


def _id_of(rank: str) -> Column:
    low = f"pmod({rank} + 1BD, {_STEP}) - 1BD"
    return F.expr(f"cast(if({low} >= 0, 9223372036854775807BD - ({low}), null) as long)")


def _texts(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """id, h, norm, best of every row."""
    rows = docs.select(F.col(id_col).cast("long").alias("id"), normalised(text_col).alias("norm"), F.length(text_or_empty(text_col)).alias("chars"))
    return rows.select("id", hashed(F.col("norm")).alias("h"), "norm", _rank().alias("best"))


_ENTRY = ["bucket", "depth", "h", "text_sha256", "keep_id", "group_size", "chain"]


def build_index(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", bucket_rows: int = 512, path: str | None = None) -> tuple[DataFrame, DataFrame]:
    """The index, and (id, h) of every row.

    The index has one row for each different text: bucket, depth, h,
    text_sha256, keep_id, group_size, and chain: how many texts share h.
    ``path`` gets the tables ``entries`` and ``directory``.
    """
    spark = docs.sparkSession
    path = path or shared_dir(spark)
    texts = _texts(docs, id_col, text_col)
    rows = materialise(texts.select("id", "h", F.octet_length("norm").alias("bytes")))
    counts = materialise(rows.groupBy("h").agg(F.count(F.lit(1)).alias("n"), F.sum("bytes").alias("bytes")))
    total, size = counts.agg(F.sum("n"), F.sum("bytes")).first()
    slots, deep = directory(counts, bucket_rows)
    spark.createDataFrame([(deep,)], "deep int").coalesce(1).write.parquet(f"{path}/depth")
    slots = materialise(slots, f"{path}/directory")

    owners = partitions_for(spark, size or 0, OWNER_BYTES)
    hot = counts.where(F.col("n") > hot_rows(total)).select("h", F.lit(True).alias("hot"))
    owner = F.when(F.col("hot"), F.pmod(F.xxhash64("best"), F.lit(owners))).otherwise(F.expr(f"shiftright(bucket * {owners}, {deep})"))
    routed = _route(texts, slots, deep).join(F.broadcast(hot), "h", "left").select("h", "norm", "best", "bucket", "depth", "hot", owner.cast("int").alias("owner"))
    owned = routed.repartitionById(owners, "owner").groupBy("owner", "bucket", "depth", "h", "hot", "norm").agg(F.count(F.lit(1)).alias("group_size"), F.max("best").alias("best"))
    entries = owned.select("bucket", "depth", "h", "hot", F.when(F.col("hot"), F.col("norm")).alias("norm"), F.sha2(F.col("norm").cast("binary"), 256).alias("text_sha256"), "group_size", "best")
    entries = materialise(entries.sortWithinPartitions("bucket", "h"))
    # of a hot text each owner has a row
    added = entries.where("hot").groupBy("bucket", "depth", "h", "norm", "text_sha256").agg(F.sum("group_size").alias("group_size"), F.max("best").alias("best"))
    entries = entries.where("hot is null").select(*(c for c in entries.columns if c != "hot")).unionByName(added)
    chains = materialise(entries.groupBy("h").agg(F.count(F.lit(1)).alias("chain")).where("chain > 1"))
    entries = entries.join(chains, "h", "left").withColumn("keep_id", _id_of("best")).withColumn("chain", F.coalesce("chain", F.lit(1).cast("long"))).select(*_ENTRY)
    files = partitions_for(spark, counts.count(), 2_000_000)
    return materialise(entries.repartitionByRange(files, "bucket", "h").sortWithinPartitions("bucket", "h"), f"{path}/entries"), rows.select("id", "h")


def lookup(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Each row of a later table with its text's entry (null where the index has none).

    The directory finds the bucket; there hash and digest find the entry.
    """
    spark = docs.sparkSession
    deep = spark.read.schema("deep int").parquet(f"{path}/depth").first()[0]
    slots = spark.read.schema("slot long, bucket long, depth int").parquet(f"{path}/directory")
    entries = spark.read.parquet(f"{path}/entries").select("bucket", "h", "text_sha256", "keep_id", "group_size")
    keyed = _texts(docs, id_col, text_col).select("id", "h", F.sha2(F.col("norm").cast("binary"), 256).alias("text_sha256"))
    return _route(keyed, slots, deep).drop("depth").join(entries, ["bucket", "h", "text_sha256"], "left").select("id", "h", "text_sha256", "keep_id", "group_size", "bucket")


def exact_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", bucket_rows: int = 512) -> DataFrame:
    """(id, keep_id, group_size, kept, text_sha256, bucket) of every row.

    Of equal texts the row with the most code points stays, then the least id.
    A null text counts as empty.  A null id stays only if all ids of its group
    are null; of repeated rows with the kept id all are marked kept.  An empty
    table gives no rows; other columns of ``docs`` are ignored.
    """
    index, rows = build_index(docs, id_col, text_col, bucket_rows)
    single = index.where("chain = 1").select("h", "keep_id", "group_size", "text_sha256", "bucket")
    total = rows.count()
    hot = index.where((F.col("chain") == 1) & (F.col("group_size") > hot_rows(total))).select("h")
    found = join_hot(rows, single, "h", hot)
    chained = index.where("chain > 1")
    if not chained.isEmpty():
        # hashes that different texts share: rows are told apart by their bytes
        shared = chained.select("h").distinct()
        texts = _texts(docs, id_col, text_col).join(shared, "h", "left_semi")
        groups = texts.groupBy("h", "norm").agg(F.count(F.lit(1)).alias("group_size"), F.max("best").alias("best"))
        groups = groups.select("h", "norm", _id_of("best").alias("keep_id"), "group_size", F.sha2(F.col("norm").cast("binary"), 256).alias("text_sha256"))
        places = chained.select("h", "bucket").distinct()
        found = found.unionByName(texts.join(groups, ["h", "norm"]).join(places, "h").select("h", "id", "keep_id", "group_size", "text_sha256", "bucket"))
    return found.select("id", "keep_id", "group_size", F.col("id").eqNullSafe(F.col("keep_id")).alias("kept"), "text_sha256", "bucket")
