"""Tokens and their maps as tables, and the maps of a row as columns.

The set-based forms take tables (doc_id, token, original) and use joins; the
row forms take map columns and stay in their task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.spans import TOKEN, pieces

_SHAPE = r"^\[([A-Z][A-Z_]*)_(\d+)\]$"


def with_label(df: DataFrame, col: str = "token") -> DataFrame:
    return df.withColumns({"label": F.regexp_extract(col, _SHAPE, 1), "n": F.regexp_extract(col, _SHAPE, 2).try_cast("int")})


def next_indices(maps: DataFrame) -> DataFrame:
    """(doc_id, label, next): one more than the greatest index of each label."""
    return with_label(maps).where("label <> ''").groupBy("doc_id", "label").agg((F.max("n") + 1).alias("next"))


def sanitise(new: DataFrame, old: DataFrame) -> DataFrame:
    """New pairs with a well-formed token, a value, no token as value, and a value that isn't mapped yet."""
    good = with_label(new).where("label <> '' AND trim(original) <> ''").where(~F.col("original").rlike(r"^\[.*\]$")).drop("label", "n")
    return good.join(old.select("doc_id", "original"), ["doc_id", "original"], "left_anti").select(new.columns)


def reindex(new: DataFrame, old: DataFrame) -> DataFrame:
    """(doc_id, token, original, new_token): numbered on after the old indices of each label."""
    start = next_indices(old)
    w = Window.partitionBy("doc_id", "label").orderBy("n", "original")
    numbered = with_label(new).withColumn("rn", F.row_number().over(w) - 1).join(start, ["doc_id", "label"], "left")
    token = F.concat(F.lit("["), F.col("label"), F.lit("_"), (F.coalesce("next", F.lit(0)) + F.col("rn")).cast("string"), F.lit("]"))
    return numbered.select("doc_id", "token", "original", token.alias("new_token"))


def rename_layer(layer: DataFrame, reindexed: DataFrame) -> DataFrame:
    """A layer's pairs under their new tokens, by value; pairs without one go."""
    return layer.join(reindexed.select("doc_id", "original", "new_token"), ["doc_id", "original"]).select("doc_id", F.col("new_token").alias("token"), "original")


def unmask_set(docs: DataFrame, maps: DataFrame, id_col: str = "doc_id", text_col: str = "masked") -> DataFrame:
    """(id, text): tokens looked up by join, the text put together again in order."""
    parts = docs.select(id_col, F.posexplode(pieces(F.col(text_col), TOKEN)).alias("i", "part"))
    found = parts.join(maps.select(F.col("doc_id").alias(id_col), F.col("token").alias("part"), "original"), [id_col, "part"], "left")
    rebuilt = found.groupBy(id_col).agg(F.sort_array(F.collect_list(F.struct("i", F.coalesce("original", "part").alias("p")))).alias("parts"))
    return rebuilt.select(id_col, F.array_join(F.transform("parts", lambda x: x["p"]), "").alias("text"))


def integrate(docs: DataFrame, old: DataFrame, new: DataFrame, id_col: str = "doc_id", text_col: str = "masked") -> tuple[DataFrame, DataFrame]:
    """A tagger's finds brought into masked texts: (texts, layers).

    ``old``: (doc_id, token, original) of the tokens already there; ``new``:
    the same and ``type``, as the tagger numbered them.  Finds are sanitised,
    numbered on after the old ones and put in outside of tokens; layers come
    back under the new tokens, their type marked as a model's.  Texts without
    a usable find stay as they are and have no layer.
    """
    pairs = new.select("doc_id", "token", "original")
    fresh = reindex(sanitise(pairs, old).dropDuplicates(["doc_id", "original"]), old)
    maps = fresh.groupBy("doc_id").agg(F.map_from_entries(F.collect_list(F.struct("new_token", "original"))).alias("map"))  # one text's tokens
    joined = docs.join(maps.withColumnRenamed("doc_id", id_col), id_col, "left")
    texts = joined.withColumn(text_col, F.when(F.col("map").isNull(), F.col(text_col)).otherwise(apply_outside(F.col(text_col), F.col("map")))).drop("map")
    kind = F.concat(F.rtrim(F.coalesce(F.nullif("type", F.lit("")), F.lit("NER"))), F.lit(" / model"))
    layers = new.join(fresh.select("doc_id", "original", "new_token"), ["doc_id", "original"]).select("doc_id", kind.alias("type"), F.col("new_token").alias("token"), "original").distinct()
    return texts, layers


def apply_outside(text: Column, token_to_value: Column) -> Column:
    """Values become tokens, the longest value first, but never inside a token."""
    entries = F.array_sort(F.transform(F.map_entries(token_to_value), lambda e: F.struct((-F.length(e["value"])).alias("n"), e["value"].alias("v"), e["key"].alias("k"))))

    def one(acc: Column, e: Column) -> Column:
        return F.array_join(F.transform(pieces(acc, TOKEN), lambda p, i: F.when(i % 2 == 1, p).otherwise(F.replace(p, e["v"], e["k"]))), "")

    return F.aggregate(entries, text, one)


def preserved(tokens: Column, out: Column) -> Column:
    """Whether every token occurs in the output."""
    return F.forall(tokens, lambda t: F.contains(out, t))


def preserved_strict(before: Column, after: Column) -> Column:
    """Whether both texts have the same tokens in the same order."""
    return F.regexp_extract_all(before, F.lit(f"({TOKEN})"), 1) == F.regexp_extract_all(after, F.lit(f"({TOKEN})"), 1)


def chunks(text: Column, most: int = 510, overlap: int = 50) -> Column:
    """Windows of words that overlap: array<struct<first:int,words:array<string>>>."""
    words = F.filter(F.split(text, r"\s+"), lambda w: w != "")
    starts = F.sequence(F.lit(0), F.greatest(F.size(words) - overlap - 1, F.lit(0)), F.lit(most - overlap))
    return F.transform(starts, lambda s: F.struct(s.alias("first"), F.slice(words, s + 1, F.lit(most)).alias("words")))
