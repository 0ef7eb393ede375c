"""Queries of the numbered operators: each applies one to its whole table."""

from __future__ import annotations

import functools
from collections.abc import Callable
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import exact, filter_audit, hilbert, ledger, packing, projections, records, repeats, simhash, toxicity, urls, whitening, wordtrie


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@functools.cache
def _tokenizer(name: str) -> str:
    """The text of a public tokenizer's file, a few MB."""
    import public_tokenizers

    return Path(public_tokenizers.path(name)).read_text(encoding="utf-8")


def op1_token_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    _, index = records.write_and_index(_table(spark, sf_dir, "documents"), _tokenizer("byte_bpe_50k.json"), end_id=2)
    return index.select(F.col("id").alias("doc_id"), "start", "n_tokens", "ids_crc32")


def op2_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(_table(spark, sf_dir, "documents"))
    return found.select(
        F.col("id").alias("doc_id"),
        F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"),
        F.col("component").alias("component_id"),
    )


def op3_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    packed = packing.pack_documents(_table(spark, sf_dir, "documents"), _tokenizer("byte_bpe_50k.json"), end_id=2)
    return packed.select(F.col("id").alias("doc_id"), "piece", "start", "length", F.crc32("ids").alias("ids_crc32"), "sequence_id", "offset")


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    model = toxicity.train(docs, _table(spark, sf_dir, "labels"))
    scored = toxicity.score(docs, model)
    return scored.select(F.col("id").alias("doc_id"), toxicity.held_out("id").alias("held_out"), "score", "predicted")


def op5_word_trie_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    coded = wordtrie.encode_digests(_table(spark, sf_dir, "documents"), _tokenizer("word_bpe_49k.json"))
    return coded.withColumnRenamed("id", "doc_id")


def op6_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = ledger.scan(_table(spark, sf_dir, "documents"))

    def count(kind: str) -> Column:
        return F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long")

    listed = F.array_join(F.transform("spans", lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
    return found.select(
        F.col("id").alias("doc_id"),
        *(count(k).alias(f"n_{k}") for k in ledger.KINDS),
        F.sha2(listed.cast("binary"), 256).alias("base_sha256"),
        listed.alias("spans"),
    )


def op7_hilbert_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    placed = hilbert.shard(_table(spark, sf_dir, "documents"), n_shards=40)
    return placed.select(
        F.col("id").alias("doc_id"),
        "size",
        F.col("text_crc32").alias("text_crc32"),
        F.lit("rows").alias("law"),
        "shard",
        "slot",
        F.lit(None).cast("int").alias("grown_shard"),
    )


def op8_sorted_projections(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = projections.near_duplicates(_table(spark, sf_dir, "embeddings"), exact=False)
    return found.select(
        F.col("id").alias("vec_id"),
        "n_links",
        F.col("component").alias("component_id"),
        F.col("id").eqNullSafe(F.col("component")).alias("kept"),
    )


def op9_prefix_free_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = repeats.remove_repeats(_table(spark, sf_dir, "documents"), 400, with_bytes=False)
    return found.select(F.col("id").alias("doc_id"), "n_bytes", "n_removed", "n_spans", "kept_sha256")


def op10_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = exact.exact_duplicates(_table(spark, sf_dir, "documents"))
    return found.select(F.col("id").alias("doc_id"), "keep_id", "group_size", "kept", "text_sha256")


def op11_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = filter_audit.document_failures(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))
    return filter_audit.interaction_audit(rows).drop("filter")


def op12_tiled_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    white = whitening.whiten(_table(spark, sf_dir, "embeddings"), components=32)
    each = white.select("*", F.posexplode("whitened").alias("at", "value"))
    return each.select(
        F.col("id").alias("vec_id"),
        (F.col("at") + 1).alias("component"),
        "n",
        F.col("deviation").cast("long").alias("deviation"),
        F.col("value").alias("whitened"),
        F.get("explained", F.col("at")).alias("explained"),
        "identity_error",
    )


#: The rules of op13's contract (verdict, host, path).
OP13_RULES = [
    ("allow", "org", "/"),
    ("block", "example.org", "/es/"),
    ("block", "example.org", "/en/1"),
    ("allow", "com", "/fr/"),
    ("block", "com", "/de/"),
]


def op13_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = spark.createDataFrame(OP13_RULES, "verdict string, host string, path string")
    found = urls.filter_urls(_table(spark, sf_dir, "pages"), rules)
    return found.select(F.col("id").alias("page_id"), "host", "path", "rule", "verdict")


#: Equal texts, who stays and the digest, said in DuckDB's SQL.
OP10_SQL = r"""
WITH t AS (
  SELECT doc_id, length(coalesce(text, '')) AS chars,
         regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g') AS norm
  FROM documents
), g AS (
  SELECT norm, count(*) AS group_size, arg_min(doc_id, struct_pack(c := -chars, d := doc_id)) AS keep_id
  FROM t GROUP BY norm
)
SELECT t.doc_id, g.keep_id, g.group_size, t.doc_id = g.keep_id AS kept, sha256(t.norm) AS text_sha256
FROM t JOIN g USING (norm)
"""


#: The failures of each document, then every order of the five filters over them.
OP11_SQL = r"""
WITH first AS (
  SELECT coalesce(text, '') AS text, min(doc_id) AS least FROM documents GROUP BY 1
), own AS (
  SELECT doc_id, max((quality IS NOT DISTINCT FROM 1)::int) AS good, max((toxic IS NOT DISTINCT FROM 1)::int) AS toxic FROM labels GROUP BY doc_id
), w AS (
  SELECT d.doc_id, coalesce(d.lang, '') AS part, coalesce(d.text, '') AS text,
         regexp_extract_all(coalesce(d.text, ''), '[^ 	-
]+') AS words, least
  FROM documents d JOIN first ON coalesce(d.text, '') = first.text
), fails AS (
  SELECT part, coalesce(good, 0) AS good, coalesce(toxic, 0) AS toxic,
         [len(words) < 100, 100 * len(list_distinct(words)) < 80 * len(words),
          100 * length(regexp_replace(text, '[^A-Z]+', '', 'g')) > 10 * length(text),
          regexp_matches(text, '[#$%&*|]'), coalesce(w.doc_id > least, false)] AS f
  FROM w LEFT JOIN own ON own.doc_id = w.doc_id
), kinds AS (
  SELECT part, f, good, toxic, count(*) AS n FROM fails GROUP BY ALL
), l AS (
  SELECT unnest([1, 2, 3, 4, 5]) AS i
), orders AS (
  SELECT [a.i, b.i, c.i, d.i, e.i] AS o
  FROM l a JOIN l b ON b.i <> a.i JOIN l c ON c.i NOT IN (a.i, b.i) JOIN l d ON d.i NOT IN (a.i, b.i, c.i)
  JOIN l e ON e.i NOT IN (a.i, b.i, c.i, d.i)
), steps AS (
  SELECT o, l.i AS step, o[l.i] AS own, array_to_string([substr('ABCDE', x, 1) FOR x IN o], '') AS filter_order FROM orders, l
), counted AS (
  SELECT part, filter_order, step, own,
         [x FOR x IN o[1:step - 1] IF f[x]] <> [] AS gone, f[own] AS fails, list_count([x FOR x IN [1, 2, 3, 4, 5] IF f[x]]) = 1 AS single, good, toxic, n
  FROM kinds, steps
), summed AS (
  SELECT part, filter_order, step, own,
         coalesce(sum(n) FILTER (NOT gone AND NOT fails), 0)::BIGINT AS kept,
         coalesce(sum(n) FILTER (NOT gone AND fails), 0)::BIGINT AS removed,
         coalesce(sum(n) FILTER (gone AND fails), 0)::BIGINT AS redundant,
         coalesce(sum(n) FILTER (fails AND single), 0)::BIGINT AS unique_fails,
         coalesce(sum(n) FILTER (NOT gone AND fails AND good = 1), 0)::BIGINT AS good_lost,
         coalesce(sum(n) FILTER (NOT gone AND fails AND toxic = 1), 0)::BIGINT AS toxic_lost
  FROM counted GROUP BY ALL
)
SELECT part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost,
       (sum(removed) OVER (PARTITION BY part, own))::BIGINT AS shapley
FROM summed
"""

#: Every rule held against every URL that it fits; the longest decides.
OP13_SQL = r"""
WITH rules(verdict, host, path) AS (
  VALUES ('allow', 'org', '/'), ('block', 'example.org', '/es/'), ('block', 'example.org', '/en/1'),
         ('allow', 'com', '/fr/'), ('block', 'com', '/de/')
), rest AS (
  SELECT page_id, row_number() OVER () AS n,
         CASE WHEN contains(coalesce(url, ''), '://') THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest
  FROM pages
), u AS (
  SELECT page_id, n, translate(regexp_extract(rest, '^([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path
  FROM rest
), best AS (
  SELECT u.n, arg_max(struct_pack(r := r.host || r.path, v := r.verdict), length(r.host || r.path)) AS b
  FROM u JOIN rules r ON starts_with(u.path, r.path) AND (u.host = r.host OR ends_with(u.host, '.' || r.host))
  GROUP BY u.n
)
SELECT u.page_id, u.host, u.path, b.r AS rule, coalesce(b.v, 'allow') AS verdict
FROM u LEFT JOIN best USING (n)
"""


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_token_records": op1_token_records,
        "op2_simhash_near_dedup": op2_simhash_near_dedup,
        "op3_best_fit_packing": op3_best_fit_packing,
        "op4_toxicity": op4_toxicity,
        "op5_word_trie_bpe": op5_word_trie_bpe,
        "op6_secret_scan": op6_secret_scan,
        "op7_hilbert_shards": op7_hilbert_shards,
        "op8_sorted_projections": op8_sorted_projections,
        "op9_prefix_free_repeats": op9_prefix_free_repeats,
        "op10_exact_dedup": op10_exact_dedup,
        "op11_filter_audit": op11_filter_audit,
        "op12_tiled_whitening": op12_tiled_whitening,
        "op13_url_filter": op13_url_filter,
    }


def oracle_sql() -> dict[str, str]:
    return {
        "op10_exact_dedup": OP10_SQL,
        "op11_filter_audit": OP11_SQL,
        "op13_url_filter": OP13_SQL,
    }
