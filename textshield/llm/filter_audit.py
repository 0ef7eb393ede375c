"""How filters overlap: a trie of their orders, executed depth first.

Every order of the filters is a path from the root of a trie.  What survives a
prefix depends only on which filters it holds, so each unordered prefix is a
state that is executed once: its survivors are a persisted DataFrame made from
its parent's, and one job counts what each filter that is still to come removes
there, an edge for each.  The walk keeps the survivors along one path at a
time; a prefix met again in another order takes the counts already written.
Five filters have 120 orders of 600 steps, but 32 states and 80 edges.

Counts are written to the shared folder, grouped by part, and put together
there; the driver sees none of them.
"""

from __future__ import annotations

import itertools
import json

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import hot_rows, join_hot, materialise, shared_dir, text_or_empty

#: More filters have more orders than a report can hold (7! = 5,040).
MOST_FILTERS = 7
BLANKS = r"[\x20\x09-\x0D]+"


def document_failures(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", part_col: str = "lang") -> DataFrame:
    """(id, part, A, B, C, D, E, good, toxic): the filters that each document fails.

    A: under 100 words.  B: under 80 % of the words are distinct.  C: over 10 %
    of the code points are A-Z.  D: one of ``#$%&*|``.  E: a row with a smaller
    id has the same text, told by SHA-256 of the whole text.  Null texts are
    empty, a null part is the empty string.  Rows with a null id never fail E
    and make no other row fail it; nor do rows with an equal id.  A document is
    good or toxic if any label row with its id says so.  Texts are read once;
    other columns are ignored.
    """
    text = text_or_empty(text_col)
    slim = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(part_col), F.lit("")).alias("part"), text.alias("text"))
    slim = slim.withColumn("words", F.filter(F.split("text", BLANKS), lambda w: w != ""))
    words = F.size("words")
    capitals = F.length(F.regexp_replace("text", "[^A-Z]+", ""))
    flags = materialise(
        slim.select(
            "id",
            "part",
            F.unhex(F.sha2(F.col("text").cast("binary"), 256)).alias("digest"),
            (words < 100).alias("A"),
            (F.size(F.array_distinct("words")) * F.lit(100).cast("long") < words * F.lit(80).cast("long")).alias("B"),
            (capitals * F.lit(100).cast("long") > F.length("text") * F.lit(10).cast("long")).alias("C"),
            F.col("text").rlike(r"[#$%&*|]").alias("D"),
        )
    )
    # texts that more than one row has, with their least id; hot ones are matched by broadcast
    shared = flags.groupBy("digest").agg(F.count(F.lit(1)).alias("n"), F.min("id").alias("least")).where("n > 1")
    shared = materialise(shared)
    hot = shared.where(F.col("n") > hot_rows(flags.count())).select("digest")
    flags = join_hot(flags, shared.select("digest", "least"), "digest", hot, "left")
    flags = flags.withColumn("E", F.coalesce(F.col("id") > F.col("least"), F.lit(False)))
    own = labels.groupBy(F.col("doc_id").alias("id")).agg(F.max(F.coalesce(F.col("quality") == 1, F.lit(False))).alias("good"), F.max(F.coalesce(F.col("toxic") == 1, F.lit(False))).alias("toxic"))
    known = flags.where("id is not null").join(own.where("id is not null"), "id", "left")
    rows = known.unionByName(flags.where("id is null"), allowMissingColumns=True)
    return rows.select("id", "part", *"ABCDE", F.coalesce("good", F.lit(False)).alias("good"), F.coalesce("toxic", F.lit(False)).alias("toxic"))


def edge_counts(rows: DataFrame, filters: str, lost: tuple[str, ...]) -> DataFrame:
    """(part, mask, n, removed, and an array for each of ``lost``) of every state.

    ``mask`` has a bit for each filter applied; ``n`` rows survive it, and the
    arrays have, for each filter, the survivors that fail it, all and those
    flagged.  Parts without survivors have no row.
    """
    path = shared_dir(rows.sparkSession)
    seen: set[int] = set()
    full = (1 << len(filters)) - 1

    def removed(f: str, flag: Column) -> Column:
        return F.sum((F.col(f) & flag).cast("long"))

    def visit(survivors: DataFrame, mask: int) -> None:
        """Count the edges out of a state, then go down each that leads somewhere new."""
        seen.add(mask)
        survivors = survivors.persist()
        counts = survivors.groupBy("part").agg(
            F.count(F.lit(1)).alias("n"),
            F.array(*(removed(f, F.lit(True)) for f in filters)).alias("removed"),
            *(F.array(*(removed(f, F.col(flag)) for f in filters)).alias(flag) for flag in lost),
        )
        counts.select("part", F.lit(mask).alias("mask"), "n", "removed", *lost).write.mode("append").parquet(path)
        for i, f in enumerate(filters):
            after = mask | 1 << i
            if after != full and after not in seen:
                visit(survivors.where(~F.col(f)), after)
        survivors.unpersist()

    visit(rows.select("part", *filters, *lost), 0)
    return rows.sparkSession.read.schema("part string, mask int, n long" + "".join(f", {x} array<long>" for x in ("removed", *lost))).parquet(path)


def interaction_audit(rows: DataFrame, filters: str = "ABCDE", lost: tuple[str, ...] = ("good", "toxic")) -> DataFrame:
    """One row for each part, order of the filters and step, zeros included.

    ``rows`` have ``part``, a boolean for each filter (true: fails) and for each
    of ``lost``.  Columns: part, filter_order, step (from 1), filter, kept,
    removed, redundant, unique_fails, ``<lost>_lost`` and shapley.  Counts are
    of rows, so repeated rows count as often as they occur; an empty table
    gives no rows.
    """
    if not 1 <= len(filters) <= MOST_FILTERS:
        raise ValueError(f"1 to {MOST_FILTERS} filters")
    edges = edge_counts(materialise(rows.select("part", *filters, *lost)), filters, lost)
    # at most 2 ** filters states a part
    parts = edges.groupBy("part").agg(F.map_from_entries(F.collect_list(F.struct("mask", F.struct("n", "removed", *lost)))).alias("states"))
    steps = []
    for order in itertools.permutations(range(len(filters))):
        mask = 0
        for k, f in enumerate(order):
            steps.append({"filter_order": "".join(filters[i] for i in order), "step": k + 1, "filter": filters[f], "f": f, "mask": mask})
            mask |= 1 << f
    listed = F.from_json(F.lit(json.dumps(steps)), "array<struct<filter_order:string,step:int,filter:string,f:int,mask:int>>")
    wide = parts.select("part", "states", F.inline(listed))

    def at(mask: Column, what: str) -> Column:
        return F.coalesce(F.get(F.try_element_at("states", mask)[what], F.col("f")), F.lit(0).cast("long"))

    here = F.col("mask")
    alone = F.lit((1 << len(filters)) - 1).bitwiseXOR(F.call_function("shiftleft", F.lit(1), F.col("f")))
    counted = wide.select(
        "part",
        "filter_order",
        "step",
        "filter",
        (F.coalesce(F.try_element_at("states", here)["n"], F.lit(0).cast("long")) - at(here, "removed")).alias("kept"),
        at(here, "removed").alias("removed"),
        (at(F.lit(0), "removed") - at(here, "removed")).alias("redundant"),
        at(alone, "removed").alias("unique_fails"),
        *(at(here, x).alias(f"{x}_lost") for x in lost),
    )
    return counted.withColumn("shapley", F.sum("removed").over(Window.partitionBy("part", "filter")))
