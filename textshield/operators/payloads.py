"""Payloads walked to any depth: VARIANT values exploded level by level.

Only containers go on to the next level, so a level holds what is still open
and the hits found so far.  The number of levels is that of the deepest payload,
counted first.  Nothing is collected but that number.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import guards

_STRING = r'"(?:[^"\\]|\\.)*+"'


def depth(raw: Column) -> Column:
    """How deep brackets are nested in a JSON text; those in strings don't count."""
    brackets = F.regexp_replace(F.regexp_replace(raw, _STRING, ""), r"[^\[\]{}]+", "")
    start = F.struct(F.lit(0).alias("now"), F.lit(0).alias("most"))

    def step(acc: Column, x: Column) -> Column:
        now = acc["now"] + F.when(x.isin("{", "["), 1).when(x.isin("}", "]"), -1).otherwise(0)
        return F.struct(now.alias("now"), F.greatest(acc["most"], now).alias("most"))

    return F.aggregate(F.split(brackets, ""), start, step, lambda acc: acc["most"])


def _kind(v: Column) -> Column:
    """OBJECT, ARRAY, STRING or another."""
    return F.regexp_extract(F.schema_of_variant(v), "^([A-Z]+)", 1)


def walk(rows: DataFrame, id_col: str, raw_col: str, found: Column) -> DataFrame:
    """(id, path, order, value, found) of every node for which ``found`` isn't null.

    ``found`` is an expression over ``key`` (null in arrays), ``value`` (a
    VARIANT), ``kind`` and ``text`` (a string's own).  Below a node that is
    found nothing is looked at.  ``order`` sorts nodes depth first; fields come
    in order of their names, as VARIANT keeps them.  Texts that are no JSON,
    and null, have no nodes.
    """
    spark = rows.sparkSession
    levels = rows.agg(F.max(depth(F.col(raw_col)))).first()[0] or 0
    v = F.try_parse_json(F.col(raw_col))
    root = rows.select(F.col(id_col).alias("id"), F.lit("$").alias("path"), F.array().cast("array<int>").alias("order"), v.alias("value"), F.lit(None).cast("string").alias("key"), F.lit(None).cast("string").alias("before"))

    def judged(df: DataFrame) -> DataFrame:
        df = df.withColumn("kind", _kind(F.col("value"))).withColumn("text", F.when(F.col("kind") == "STRING", F.try_variant_get("value", "$", "string")))
        return df.withColumn("found", F.coalesce("before", found)).where("found is not null OR kind IN ('OBJECT', 'ARRAY')").drop("before")

    level = judged(root)
    for _ in range(levels):
        open_ = F.when(F.col("found").isNull(), F.col("value"))
        held = level.select("id", "path", "order", "value", "found", open_.alias("open"))
        # one row without a position for what is found already
        wide = spark.sql("SELECT h.id, h.path, h.order, h.value AS own, h.found AS before, e.pos, e.key, e.value FROM {h} h, LATERAL variant_explode_outer(h.open) e", h=held)
        wide = wide.where("before IS NOT NULL OR pos IS NOT NULL")
        step = F.when(F.col("key").isNotNull(), F.concat(F.lit("."), F.col("key"))).otherwise(F.concat(F.lit("["), F.col("pos").cast("string"), F.lit("]")))
        done = F.col("before").isNotNull()
        wide = wide.select("id", F.when(done, F.col("path")).otherwise(F.concat("path", step)).alias("path"), F.when(done, F.col("order")).otherwise(F.array_append("order", F.col("pos"))).alias("order"), F.when(done, F.col("own")).otherwise(F.col("value")).alias("value"), F.when(~done, F.col("key")).alias("key"), "before")
        level = judged(wide)
    return level.where("found is not null").select("id", "path", "order", "value", "found")


def scan(rows: DataFrame, id_col: str, raw_col: str, markup: bool = True, statements: bool = True) -> DataFrame:
    """(id, path, reason) of each payload's first hit, depth first.

    A hit is a field whose name begins with a dollar sign, or a string with
    markup or a statement.  Payloads without a hit give no row.
    """
    text = F.col("text")
    found = F.when(F.col("key").startswith("$"), F.concat(F.lit("forbidden key: "), F.col("key")))
    if markup:
        found = F.coalesce(found, F.when(guards.has_markup(text), F.lit("html/xss")))
    if statements:
        found = F.coalesce(found, F.when(guards.has_sql(text), F.lit("sql-like")))
    hits = walk(rows, id_col, raw_col, found)
    best = hits.groupBy("id").agg(F.min(F.struct("order", "path", "found")).alias("hit"))
    return best.select(F.col("id").alias(id_col), F.col("hit.path").alias("path"), F.col("hit.found").alias("reason"))
