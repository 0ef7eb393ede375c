"""Registered queries of the reference's operators, each over its whole tables.

Where a text's expected form can be built from its parts, DuckDB builds it by
concatenation, without any pattern; so the two sides share no logic.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import Config
from ..functions import catalog, numbering
from ..functions.spans import find_spans, greedy
from ..functions.tables import MONTHS_EN, MONTHS_FR, MONTHS_ID, NAME_STOPWORDS, SUBJECT_TITLES, calling_codes
from ..operators import audit, backends, guards, html, intervals, language, masking, models, payloads, reformat, subjects, tokens
from ..sources import store
from ..sources.io import database_name, read_table
from ..streaming.rate import rate_windows, rejected
from .pipeline import proofread

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


def _list(names: list[str]) -> str:
    return "[" + ", ".join("'" + n.replace("'", "''") + "'" for n in names) + "]"


EN, ID, FR = _list(MONTHS_EN), _list(MONTHS_ID), _list([m[0].upper() + m[1:] for m in MONTHS_FR])


def _months(names: list[str], month):
    return F.get(F.array(*map(F.lit, names)), month - 1)


# Masking ------------------------------------------------------------------


def _counted(spark: SparkSession, sf_dir: str, pattern: str, cat: str) -> DataFrame:
    d = read_table(spark, sf_dir, "documents")
    return d.select("doc_id", F.size(find_spans(F.coalesce("text", F.lit("")), pattern, cat)).cast("long").alias("n")).where("n > 0")


@query(r"SELECT doc_id, len(regexp_extract_all(text, '[a-zA-Z0-9_.+-]+@[a-zA-Z0-9-]+\.[a-zA-Z0-9-.]+'))::BIGINT AS n FROM documents WHERE n > 0")
def pii_email_counts(spark, sf_dir):
    return _counted(spark, sf_dir, r"[a-zA-Z0-9_.+-]+@[a-zA-Z0-9-]+\.[a-zA-Z0-9-.]+", "EMAIL")


@query(r"SELECT doc_id, len(regexp_extract_all(text, '\b(?:\d{1,3}\.){3}\d{1,3}\b'))::BIGINT AS n FROM documents WHERE n > 0")
def pii_ip_counts(spark, sf_dir):
    return _counted(spark, sf_dir, r"\b(?:\d{1,3}\.){3}\d{1,3}\b", "IP_ADDRESS")


@query()
def pii_category_summary(spark, sf_dir):
    """Findings by category and layer over all documents."""
    d = masking.mask_documents(read_table(spark, sf_dir, "documents"))
    return d.select(F.explode("tokens").alias("t")).groupBy("t.layer", "t.cat").agg(F.count(F.lit(1)).alias("n"))


@query("""SELECT c_custkey, 'Hubungi [PHONE_NUMBER_0] segera, tulis ke [EMAIL_0] dan [KEYWORD_0].' AS masked,
  'pii_EMAIL,phones_lib,regex_KEYWORD' AS layer_order FROM customer""")
def mask_generated_reports(spark, sf_dir):
    c = read_table(spark, sf_dir, "customer")
    key = F.lpad(F.col("c_custkey").cast("string"), 8, "0")
    text = F.concat(F.lit("Hubungi 0812"), key, F.lit(" segera, tulis ke u"), key, F.lit("@contoh.co.id dan #kasus."))
    m = masking.mask_documents(c.select("c_custkey", text.alias("text")))
    return m.select("c_custkey", "masked", F.array_join("order", ",").alias("layer_order"))


@query("SELECT doc_id, text FROM documents")
def unmask_roundtrip(spark, sf_dir):
    m = masking.mask_documents(read_table(spark, sf_dir, "documents"))
    return m.select("doc_id", masking.unmask(F.col("masked"), F.col("layered_maps")).alias("text"))


@query("""SELECT o_orderkey, 'ref [NIK_0] dated [DATE_0] by [PERSON_0]' AS masked, lpad(o_orderkey::VARCHAR, 16, '1') AS nik,
  strftime(o_orderdate, '%d/%m/%Y') AS dated FROM orders""")
def mask_layer_values(spark, sf_dir):
    o = read_table(spark, sf_dir, "orders")
    nik = F.lpad(F.col("o_orderkey").cast("string"), 16, "1")
    text = F.concat(F.lit("ref "), nik, F.lit(" dated "), F.date_format("o_orderdate", "dd/MM/yyyy"), F.lit(" by Ibu Monica"))
    state = masking.apply_spans(masking.empty_state(text), masking.pattern_spans, None, "regex_")
    m = o.select("o_orderkey", state.alias("m")).withColumn("map", masking.flat_map(F.col("m.tokens")))
    return m.select("o_orderkey", F.col("m.text").alias("masked"), F.col("map")["[NIK_0]"].alias("nik"), F.col("map")["[DATE_0]"].alias("dated"))


@query("SELECT c_custkey, '{{EMAIL_1}} and {{EMAIL_2}}' AS masked, 3::INTEGER AS next, 'u' || c_custkey || '@a.com and v@b.org' AS back FROM customer")
def legacy_masks(spark, sf_dir):
    c = read_table(spark, sf_dir, "customer")
    text = F.concat(F.lit("u"), F.col("c_custkey").cast("string"), F.lit("@a.com and v@b.org"))
    m = c.select("c_custkey", masking.mask_legacy(text, "EMAIL").alias("m"))
    return m.select("c_custkey", F.col("m.text").alias("masked"), F.col("m.next").alias("next"), masking.unmask_literal(F.col("m.text"), F.col("m.map")).alias("back"))


@query("SELECT doc_id, layer, n FROM (SELECT 1 AS doc_id, '' AS layer, 1 AS n) WHERE false")
def spans_disjoint_violations(spark, sf_dir):
    """Invariant: no token within a token, indices dense from 0.  No row breaks it."""
    m = masking.mask_documents(read_table(spark, sf_dir, "documents")).where(F.size("tokens") > 0)
    t = m.select("doc_id", F.explode("tokens").alias("t")).select("doc_id", "t.cat", "t.layer", F.regexp_extract("t.token", r"_(\d+)\]$", 1).cast("int").alias("i"), F.col("t.val").rlike(r"^\[[A-Z_]+_\d+\]$").alias("nested"))
    by = t.groupBy("doc_id", "cat").agg(F.min("layer").alias("layer"), F.count(F.lit(1)).cast("int").alias("n"), F.max("i").alias("top"), F.countDistinct("i").alias("different"), F.max("nested").alias("nested"))
    return by.where("nested OR top <> n - 1 OR different <> n").select(F.col("doc_id").cast("int").alias("doc_id"), "layer", "n")


# Tokens as tables ----------------------------------------------------------

_MAPS_SQL = """maps AS (
  SELECT c_custkey AS doc_id, '[ORG_' || (c_custkey % 7) || ']' AS token, 'Acme ' || (c_custkey % 11) AS original FROM customer
  UNION ALL SELECT c_custkey, '[PERSON_' || (c_custkey % 5) || ']', c_name FROM customer)"""
_NEW_SQL = """fresh AS (
  SELECT c_custkey AS doc_id, '[ORG_1]' AS token, 'Acme ' || (c_custkey % 3) AS original FROM customer
  UNION ALL SELECT c_custkey, '[PERSON_1]', 'Name ' || c_custkey FROM customer
  UNION ALL SELECT c_custkey, '[PERSON_2]', '[ORG_1]' FROM customer
  UNION ALL SELECT c_custkey, 'broken', 'x' FROM customer
  UNION ALL SELECT c_custkey, '[LOC_1]', '  ' FROM customer)"""


def _maps(spark, sf_dir, sql: str, name: str) -> DataFrame:
    """The same small fixture on both sides: pairs made from customer."""
    read_table(spark, sf_dir, "customer").createOrReplaceTempView("_customer")
    return spark.sql(f"WITH {sql.replace('FROM customer', 'FROM _customer')} SELECT * FROM {name}")


@query(f"WITH {_MAPS_SQL} SELECT c_custkey AS doc_id, 'seen ' || m.original || ' and [PERSON_9] by ' || p.original AS text FROM customer JOIN maps m ON m.doc_id = c_custkey AND m.token LIKE '[ORG%' JOIN maps p ON p.doc_id = c_custkey AND p.token LIKE '[PERSON%'")
def token_lookup_left_join(spark, sf_dir):
    maps = _maps(spark, sf_dir, _MAPS_SQL, "maps")
    c = read_table(spark, sf_dir, "customer")
    masked = F.concat(F.lit("seen [ORG_"), (F.col("c_custkey") % 7).cast("string"), F.lit("] and [PERSON_9] by [PERSON_"), (F.col("c_custkey") % 5).cast("string"), F.lit("]"))
    return tokens.unmask_set(c.select(F.col("c_custkey").alias("doc_id"), masked.alias("masked")), maps)


@query(f"WITH {_MAPS_SQL}, {_NEW_SQL} SELECT doc_id, token, original FROM fresh f WHERE token LIKE '[%' AND trim(original) <> '' AND original NOT LIKE '[%' AND NOT EXISTS (SELECT 1 FROM maps m WHERE m.doc_id = f.doc_id AND m.original = f.original)")
def token_anti_join(spark, sf_dir):
    return tokens.sanitise(_maps(spark, sf_dir, _NEW_SQL, "fresh"), _maps(spark, sf_dir, _MAPS_SQL, "maps"))


@query(f"WITH {_MAPS_SQL} SELECT doc_id, regexp_extract(token, '([A-Z]+)_', 1) AS label, (max(regexp_extract(token, '_([0-9]+)', 1)::INTEGER) + 1)::INTEGER AS next FROM maps GROUP BY 1, 2")
def token_next_index(spark, sf_dir):
    return tokens.next_indices(_maps(spark, sf_dir, _MAPS_SQL, "maps"))


@query("""SELECT c_custkey AS doc_id, '[ORG_1]' AS token, 'Acme ' || (c_custkey % 3) AS original, '[ORG_' || (c_custkey % 7 + 1) || ']' AS new_token FROM customer WHERE c_custkey % 11 <> c_custkey % 3
UNION ALL SELECT c_custkey, '[PERSON_1]', 'Name ' || c_custkey, '[PERSON_' || (c_custkey % 5 + 1) || ']' FROM customer""")
def token_reindex(spark, sf_dir):
    maps = _maps(spark, sf_dir, _MAPS_SQL, "maps")
    return tokens.reindex(tokens.sanitise(_maps(spark, sf_dir, _NEW_SQL, "fresh"), maps), maps)


@query("SELECT c_custkey AS doc_id, '[PERSON_' || (c_custkey % 5 + 1) || ']' AS token, 'Name ' || c_custkey AS original FROM customer")
def token_rename_layer(spark, sf_dir):
    maps = _maps(spark, sf_dir, _MAPS_SQL, "maps")
    fresh = _maps(spark, sf_dir, _NEW_SQL, "fresh")
    again = tokens.reindex(tokens.sanitise(fresh, maps), maps)
    return tokens.rename_layer(fresh.where("token = '[PERSON_1]'"), again)


@query("SELECT c_custkey, 'Hello [ORG_2] [ORG_1] [ORG_2] ' || c_custkey AS text, true AS kept, false AS kept_strict FROM customer")
def token_apply_outside(spark, sf_dir):
    c = read_table(spark, sf_dir, "customer")
    text = F.concat(F.lit("Hello Alice [ORG_1] Alice "), F.col("c_custkey").cast("string"))
    out = tokens.apply_outside(text, F.create_map(F.lit("[ORG_2]"), F.lit("Alice")))
    return c.select("c_custkey", out.alias("text"), tokens.preserved(masking.token_list(text), out).alias("kept"), tokens.preserved_strict(text, out).alias("kept_strict"))


@query("SELECT c_custkey, 'a' AS first, 'c2' AS a, 'x' AS b, 2::INTEGER AS n FROM customer")
def token_map_union(spark, sf_dir):
    c = read_table(spark, sf_dir, "customer")
    maps = F.array(F.create_map(F.lit("a"), F.lit("c1"), F.lit("b"), F.lit("x")), F.create_map(F.lit("a"), F.lit("c2")))
    flat = masking.flatten_maps(maps)
    return c.select("c_custkey", F.get(F.map_keys(flat), F.lit(0)).alias("first"), flat["a"].alias("a"), flat["b"].alias("b"), F.size(flat).alias("n"))


@query("""WITH s AS (SELECT l_orderkey AS k, l_linenumber AS st, l_linenumber + l_quantity::INTEGER AS en FROM lineitem),
e AS (SELECT o_orderkey AS k, (o_orderkey % 30)::INTEGER AS st, (o_orderkey % 30 + 5)::INTEGER AS en FROM orders)
SELECT k, st, en FROM s WHERE NOT EXISTS (SELECT 1 FROM e WHERE e.k = s.k AND s.st < e.en AND e.st < s.en)""")
def span_overlap_anti_join(spark, sf_dir):
    s = read_table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("k"), F.col("l_linenumber").alias("st"), (F.col("l_linenumber") + F.col("l_quantity").cast("int")).alias("en"))
    e = read_table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("ek"), (F.col("o_orderkey") % 30).cast("int").alias("est"), (F.col("o_orderkey") % 30 + 5).cast("int").alias("een"))
    return s.join(e, (s.k == e.ek) & (s.st < e.een) & (e.est < s.en), "left_anti")


@query(ORACLES["span_overlap_anti_join"])
def span_overlap_by_bins(spark, sf_dir):
    """The same rows, by an equi-join on order and bin."""
    s = read_table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("k"), F.col("l_linenumber").alias("st"), (F.col("l_linenumber") + F.col("l_quantity").cast("int")).alias("en"))
    e = read_table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("k"), (F.col("o_orderkey") % 30).cast("int").alias("st"), (F.col("o_orderkey") % 30 + 5).cast("int").alias("en"))
    return intervals.apart(s, e, "k", 16)


@query("""WITH s AS (SELECT l_orderkey AS k, l_linenumber AS st, l_linenumber + l_quantity::INTEGER AS en FROM lineitem),
e AS (SELECT o_orderkey AS k, (o_orderkey % 30)::INTEGER AS st, (o_orderkey % 30 + 5)::INTEGER AS en FROM orders)
SELECT s.k, s.st, s.en, least(s.en, e.en) - greatest(s.st, e.st) AS shared FROM s JOIN e ON e.k = s.k AND s.st < e.en AND e.st < s.en""")
def span_overlap_lengths(spark, sf_dir):
    s = read_table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("k"), F.col("l_linenumber").alias("st"), (F.col("l_linenumber") + F.col("l_quantity").cast("int")).alias("en"))
    e = read_table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("k"), (F.col("o_orderkey") % 30).cast("int").alias("st"), (F.col("o_orderkey") % 30 + 5).cast("int").alias("en"))
    met = intervals.overlapping(s, e, "k", 16)
    return met.select("k", "a.st", "a.en", (F.least("a.en", "b.en") - F.greatest("a.st", "b.st")).alias("shared"))


@query("""WITH RECURSIVE s AS (SELECT l_orderkey AS k, l_linenumber AS st, l_linenumber + floor(l_quantity / 10)::INTEGER + 1 AS en,
  row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_quantity DESC) AS i FROM lineitem),
w AS (SELECT k, i, st, en, true AS took, en AS at FROM s WHERE i = 1
  UNION ALL SELECT s.k, s.i, s.st, s.en, s.st >= w.at, CASE WHEN s.st >= w.at THEN s.en ELSE w.at END FROM w JOIN s ON s.k = w.k AND s.i = w.i + 1)
SELECT k, count(*) FILTER (took)::INTEGER AS taken, sum(en - st) FILTER (took)::BIGINT AS covered FROM w GROUP BY k""")
def greedy_intervals(spark, sf_dir):
    li = read_table(spark, sf_dir, "lineitem")
    one = F.struct(F.col("l_linenumber").alias("st"), (F.col("l_linenumber") + F.floor(F.col("l_quantity") / 10).cast("int") + 1).alias("en"), F.lit("X").alias("cat"), F.lit("").alias("val"))
    g = li.groupBy(F.col("l_orderkey").alias("k")).agg(F.collect_list(one).alias("s")).select("k", greedy(F.col("s")).alias("s"))  # an order has few lines
    return g.select("k", F.size("s").alias("taken"), F.aggregate("s", F.lit(0).cast("long"), lambda a, x: a + x["en"] - x["st"]).alias("covered"))


@query(ORACLES["greedy_intervals"])
def sql_disjoint_spans(spark, sf_dir):
    """The greedy choice by the table function, over rows."""
    catalog.register(spark)
    spans = read_table(spark, sf_dir, "lineitem").selectExpr("l_orderkey AS k", "l_linenumber AS st", "l_linenumber + cast(floor(l_quantity / 10) AS INT) + 1 AS en")
    return spark.sql("SELECT k, cast(count(*) AS INT) AS taken, sum(en - st) AS covered FROM disjoint_spans(TABLE(SELECT * FROM {s}), 'k') GROUP BY k", s=spans)


# Patterns that both sides can run, in the pattern table's order.
_SQL_PATTERNS = [("EMAIL", r"[a-zA-Z0-9_.+-]+@[a-zA-Z0-9-]+\.[a-zA-Z0-9-.]+"), ("URL", r"https?://\S+|www\.\S+"), ("NPWP", r"\d{2}\.\d{3}\.\d{3}\.\d-\d{3}\.\d{3}")]
_SQL_FOUND = " UNION ALL ".join(f"SELECT doc_id, {i} AS o, '{cat}' AS cat, regexp_split_to_array(text, '(?i){p}') AS pieces, regexp_extract_all(text, '(?i){p}') AS vals FROM documents" for i, (cat, p) in enumerate(_SQL_PATTERNS))


@query(f"""WITH RECURSIVE f AS ({_SQL_FOUND}),
c AS (SELECT doc_id, o, cat, vals[i] AS val, (coalesce(list_sum([length(x) FOR x IN pieces[1:i]]), 0) + coalesce(list_sum([length(x) FOR x IN vals[1:i - 1]]), 0))::INTEGER AS st FROM f, unnest(range(1, len(vals) + 1)) AS r(i)),
s AS (SELECT *, st + length(val)::INTEGER AS en, row_number() OVER (PARTITION BY doc_id ORDER BY st, length(val) DESC, o) AS k FROM c),
w AS (SELECT doc_id, k, st, en, cat, val, true AS took, en AS at FROM s WHERE k = 1
  UNION ALL SELECT s.doc_id, s.k, s.st, s.en, s.cat, s.val, s.st >= w.at, CASE WHEN s.st >= w.at THEN s.en ELSE w.at END FROM w JOIN s ON s.doc_id = w.doc_id AND s.k = w.k + 1)
SELECT doc_id, st, en::INTEGER AS en, cat, val FROM w WHERE took""")
def sql_pii_spans(spark, sf_dir):
    """Spans of every document by the table function in SQL."""
    catalog.register(spark)
    return spark.sql("SELECT d.doc_id, s.st, s.en, s.cat, s.val FROM {d} d, LATERAL pii_spans(d.text, 'EMAIL,URL,NPWP') s", d=read_table(spark, sf_dir, "documents"))


@query(r"""SELECT lang, count(*) FILTER (regexp_matches(text, '<[^>]+>') OR regexp_matches(text, '(?i)javascript:|<script\b|\bon\w+\s*='))::BIGINT AS markup,
  count(*) FILTER (NOT regexp_matches(text, '\p{L}'))::BIGINT AS symbols, sum(greatest(1, length(text) // 4))::BIGINT AS tokens FROM documents GROUP BY lang""")
def sql_guard_functions(spark, sf_dir):
    """Guards called by name; they are part of the plan like other SQL."""
    catalog.register(spark)
    return spark.sql("SELECT lang, count_if(has_markup(text)) AS markup, count_if(symbol_only(text)) AS symbols, sum(token_estimate(text)) AS tokens FROM {d} GROUP BY lang", d=read_table(spark, sf_dir, "documents"))


# Phones ---------------------------------------------------------------------


def _reformatted(df: DataFrame, *keep: str) -> DataFrame:
    return reformat.reformat_documents(df).select(*keep, "final", F.get(F.transform("changes", lambda c: c["via"]), F.lit(0)).alias("via"))


@query("SELECT c_custkey, 'Hubungi (+62) 812 ' || substr(k, 1, 4) || ' ' || substr(k, 5, 4) || ' segera.' AS final, 'regex-mobile' AS via FROM (SELECT c_custkey, lpad(c_custkey::VARCHAR, 8, '0') AS k FROM customer)")
def reformat_phone_mobile(spark, sf_dir):
    c = read_table(spark, sf_dir, "customer")
    text = F.concat(F.lit("Hubungi 0812"), F.lpad(F.col("c_custkey").cast("string"), 8, "0"), F.lit(" segera."))
    return _reformatted(c.select("c_custkey", text.alias("text"), F.lit("id").alias("locale")), "c_custkey")


@query("SELECT c_custkey, 'Kantor (021) ' || substr(k, 1, 3) || ' ' || substr(k, 4, 2) || ' ' || substr(k, 6, 2) AS final, 'regex-landline' AS via FROM (SELECT c_custkey, lpad(c_custkey::VARCHAR, 7, '0') AS k FROM customer)")
def reformat_phone_landline(spark, sf_dir):
    c = read_table(spark, sf_dir, "customer")
    text = F.concat(F.lit("Kantor 021"), F.lpad(F.col("c_custkey").cast("string"), 7, "0"))
    return _reformatted(c.select("c_custkey", text.alias("text"), F.lit("id").alias("locale")), "c_custkey")


@query("SELECT c_custkey, 'Call (+62) 812 ' || substr(k, 1, 4) || ' ' || substr(k, 5, 4) AS final, 'cc-as-zero' AS via FROM (SELECT c_custkey, lpad(c_custkey::VARCHAR, 8, '0') AS k FROM customer)")
def reformat_phone_intl(spark, sf_dir):
    c = read_table(spark, sf_dir, "customer")
    text = F.concat(F.lit("Call +62812"), F.lpad(F.col("c_custkey").cast("string"), 8, "0"))
    return _reformatted(c.select("c_custkey", text.alias("text"), F.lit("en").alias("locale")), "c_custkey")


@query("SELECT c_custkey, 'Call (+351) 91' || substr(k, 1, 1) || ' ' || substr(k, 2, 3) || ' ' || substr(k, 5, 3) AS final, 'cc-plain-spaced' AS via FROM (SELECT c_custkey, lpad(c_custkey::VARCHAR, 7, '1') AS k FROM customer)")
def reformat_phone_spaced(spark, sf_dir):
    c = read_table(spark, sf_dir, "customer")
    k = F.lpad(F.col("c_custkey").cast("string"), 7, "1")
    text = F.concat(F.lit("Call 351 91"), F.substring(k, 1, 1), F.lit(" "), F.substring(k, 2, 6))
    return _reformatted(c.select("c_custkey", text.alias("text"), F.lit("en").alias("locale")), "c_custkey")


_CODES_SQL = ", ".join(f"('{c}')" for c in calling_codes())


@query(f"""WITH codes(cc) AS (VALUES {_CODES_SQL}), n AS (SELECT c_custkey, (c_custkey * 7919 % 900000000 + 100000000)::VARCHAR AS d FROM customer)
SELECT c_custkey, d, min_by(cc, length(cc)) AS cc FROM n JOIN codes ON starts_with(d, cc) GROUP BY 1, 2""")
def country_code_lookup(spark, sf_dir):
    codes = F.broadcast(spark.createDataFrame([(c,) for c in calling_codes()], "cc string"))  # a fixed table of about 200 rows
    n = read_table(spark, sf_dir, "customer").select("c_custkey", (F.col("c_custkey") * 7919 % 900000000 + 100000000).cast("string").alias("d"))
    cut = n.select("*", F.explode(F.array(*(F.left("d", F.lit(i)) for i in (1, 2, 3)))).alias("cc"))
    return cut.join(codes, "cc").groupBy("c_custkey", "d").agg(F.min_by("cc", F.length("cc")).alias("cc"))


@query("""WITH k AS (SELECT c_custkey, lpad(c_custkey::VARCHAR, 8, '0') AS k, ['thailand', 'malaysia', ''][c_custkey % 3 + 1] AS tenant FROM customer)
SELECT c_custkey, CASE WHEN tenant = 'malaysia' THEN 'x' ELSE 'ID Card Number: 6281' || k || '1' END AS thai_card,
  CASE WHEN tenant = 'malaysia' THEN 'x' ELSE 'Date of Birth: 24 September 2543 (2000)' END AS thai_date, CASE WHEN tenant = 'malaysia' THEN 'x' ELSE 'Registered Address: 10/142 (1502B) Soi 62812' || k END AS thai_address,
  CASE WHEN tenant = 'thailand' THEN 'x' ELSE 'Identity Card number (9001' || k || ')' END AS my_card, tenant <> 'thailand' AS compacted,
  'Call (+62) 812 ' || substr(k, 1, 4) || ' ' || substr(k, 5, 4) AS phone FROM k""")
def reformat_protected(spark, sf_dir):
    """Labelled card numbers, year pairs and addresses of the row's tenant stay; the phone beside them doesn't."""
    c = read_table(spark, sf_dir, "customer")
    key = F.lpad(F.col("c_custkey").cast("string"), 8, "0")
    tenant = F.get(F.array(*map(F.lit, ["thailand", "malaysia", ""])), (F.col("c_custkey") % 3).cast("int"))
    lines = F.concat_ws("\n", F.concat(F.lit("ID Card Number: 6281"), key, F.lit("1")), F.lit("Date of Birth: 24 September 2543 (2000)"), F.concat(F.lit("Registered Address: 10/142 (1502B) Soi 62812"), key), F.concat(F.lit("Identity Card number (9001 "), F.left(key, F.lit(4)), F.lit("-"), F.right(key, F.lit(4)), F.lit(")")), F.concat(F.lit("Call +62812"), key))
    out = reformat.reformat_documents(c.select("c_custkey", lines.alias("text"), F.lit("en").alias("locale"), tenant.alias("tenant")), tenant_col="tenant")
    line = lambda i: F.get(F.split("final", "\n"), F.lit(i))
    return out.select(
        "c_custkey",
        F.when(F.col("tenant") == "malaysia", "x").otherwise(line(0)).alias("thai_card"),
        F.when(F.col("tenant") == "malaysia", "x").otherwise(line(1)).alias("thai_date"),
        F.when(F.col("tenant") == "malaysia", "x").otherwise(line(2)).alias("thai_address"),
        F.when(F.col("tenant") == "thailand", "x").otherwise(line(3)).alias("my_card"),
        F.exists("changes", lambda x: x["via"] == "my_nric_compact").alias("compacted"),
        line(4).alias("phone"),
    )


@query("SELECT c_custkey, 'a (+62) 1' || c_custkey || ' b (+60) c ((62) d' AS text FROM customer")
def doubled_codes(spark, sf_dir):
    text = F.concat(F.lit("a (+(+62) 1"), F.col("c_custkey").cast("string"), F.lit(" b ((+60) c ((62) d"))
    return read_table(spark, sf_dir, "customer").select("c_custkey", reformat.without_doubled_codes(text).alias("text"))


@query("""SELECT c_custkey, 'Call +62812' || k || ' or +6581234567 or 12' AS e164, 'Call 0812' || k || ' or +6581234567 or 12' AS national FROM (SELECT c_custkey, lpad(c_custkey::VARCHAR, 8, '0') AS k FROM customer)""")
def phones_normalised(spark, sf_dir):
    c = read_table(spark, sf_dir, "customer")
    key = F.lpad(F.col("c_custkey").cast("string"), 8, "0")
    text = F.concat(F.when(F.col("c_custkey") % 2 == 0, "Call +62 812-").otherwise("Call 0812 "), F.left(key, F.lit(4)), F.lit("-"), F.right(key, F.lit(4)), F.lit(" or +65 8123 4567 or 12"))
    return c.select("c_custkey", masking.normalise_phones(text, F.lit("ID")).alias("e164"), masking.normalise_phones(text, F.lit("ID"), e164=False).alias("national"))


# Region, calling code, first national digits, fewest and most national digits, kind.
_NUMBERS = [("ID", "62", "81", 9, 12, "mobile"), ("MY", "60", "3", 9, 9, "fixed"), ("SG", "65", "6", 8, 8, "fixed"), ("TH", "66", "9", 9, 9, "mobile"), ("PH", "63", "2", 8, 9, "fixed"), ("US", "1", "415", 10, 10, "fixed or mobile"), ("GB", "44", "20", 10, 10, "fixed"), ("FR", "33", "6", 9, 9, "mobile"), ("DE", "49", "170", 10, 11, "mobile"), ("AU", "61", "4", 9, 9, "mobile")]
_NUMBERS_SQL = ", ".join(f"({i}, '{r}', '{c}', '{n}', {a}, {b}, '{k}')" for i, (r, c, n, a, b, k) in enumerate(_NUMBERS))


@query(f"""WITH p(i, region, code, nat, least, most, kind) AS (VALUES {_NUMBERS_SQL}),
n AS (SELECT c_custkey, p.*, (c_custkey // 10) % 4 AS v, CASE (c_custkey // 10) % 4 WHEN 0 THEN least WHEN 1 THEN most WHEN 2 THEN least - 1 ELSE most + 1 END AS len FROM customer JOIN p ON p.i = c_custkey % 10)
SELECT c_custkey, region, kind, nat || lpad(c_custkey::VARCHAR, (len - length(nat))::INTEGER, '5') AS national, v < 2 AS possible FROM n""")
def numbering_plan(spark, sf_dir):
    """Numbers of ten regions: of the fewest and most digits, one less and one more."""
    k = F.col("c_custkey")
    entry = F.get(F.array(*(F.struct(F.lit(c).alias("code"), F.lit(n).alias("nat"), F.lit(a).alias("least"), F.lit(b).alias("most")) for _, c, n, a, b, _ in _NUMBERS)), (k % 10).cast("int"))
    df = read_table(spark, sf_dir, "customer").select("c_custkey", entry.alias("e"), (F.floor(k / 10) % 4).alias("v"))
    length = F.when(F.col("v") == 0, F.col("e.least")).when(F.col("v") == 1, F.col("e.most")).when(F.col("v") == 2, F.col("e.least") - 1).otherwise(F.col("e.most") + 1)
    digits = F.concat("e.code", "e.nat", F.lpad(F.col("c_custkey").cast("string"), length - F.length("e.nat"), F.lit("5")))
    return numbering.classify(df.select("c_custkey", digits.alias("d")), "d").select("c_custkey", "number.region", "number.kind", "number.national", "number.possible")


@query("""WITH c AS (SELECT c_custkey, lpad(c_custkey::VARCHAR, 6, '0') AS k FROM customer)
SELECT c_custkey, CASE c_custkey % 3 WHEN 0 THEN 'Ring [PHONE_NUMBER_0] now' WHEN 1 THEN 'Ring (0161) 49' || k || '1234 now' ELSE 'Ring [PHONE_NUMBER_0] now' END AS masked FROM c""")
def mask_regional_phones(spark, sf_dir):
    """Numbers as dialled in Britain and Indonesia; one has too many digits."""
    c = read_table(spark, sf_dir, "customer")
    key = F.lpad(F.col("c_custkey").cast("string"), 6, "0")
    k = F.col("c_custkey") % 3
    text = F.when(k == 0, F.concat(F.lit("Ring 020 79"), key, F.lit(" now"))).when(k == 1, F.concat(F.lit("Ring (0161) 49"), key, F.lit("1234 now"))).otherwise(F.concat(F.lit("Ring 0812-"), key, F.lit("12 now")))
    region = F.when(k == 2, "ID").otherwise("GB")
    df = c.select("c_custkey", masking.empty_state(text).alias("_m"), region.alias("region"))
    return df.select("c_custkey", masking.apply_spans(F.col("_m"), lambda t: masking.phone_spans(t, F.col("region")), "phones_lib")["text"].alias("masked"))


# Dates ----------------------------------------------------------------------


@query(f"SELECT o_orderkey, 'Signed ' || strftime(o_orderdate, '%d') || ' ' || {ID}[month(o_orderdate)] || ' ' || year(o_orderdate) || '.' AS final FROM orders")
def reformat_date_numeric(spark, sf_dir):
    o = read_table(spark, sf_dir, "orders")
    text = F.concat(F.lit("Signed "), F.date_format("o_orderdate", "d/M/yyyy"), F.lit("."))
    return _reformatted(o.select("o_orderkey", text.alias("text"), F.lit("id").alias("locale")), "o_orderkey").drop("via")


@query(f"""SELECT o_orderkey, 'On ' || strftime(o_orderdate, '%d') || ' ' || (CASE o_orderkey % 3 WHEN 0 THEN {EN} WHEN 1 THEN {ID} ELSE {FR} END)[month(o_orderdate)] || ' ' || year(o_orderdate) AS final FROM orders""")
def reformat_date_monthname(spark, sf_dir):
    """Five layouts of one date in English, written for three locales."""
    o = read_table(spark, sf_dir, "orders")
    d, m, y = F.dayofmonth("o_orderdate").cast("string"), _months(MONTHS_EN, F.month("o_orderdate")), F.year("o_orderdate").cast("string")
    shapes = F.array(F.concat_ws(" ", m, F.concat(d, F.lit(",")), y), F.concat_ws(" ", m, d, y), F.concat_ws(" ", d, m, y), F.concat_ws(" ", y, m, d), F.concat(d, F.lit(" "), y, F.lit(", "), m))
    text = F.concat(F.lit("On "), F.get(shapes, (F.col("o_orderkey") % 5).cast("int")))
    locale = F.get(F.array(F.lit("en"), F.lit("id"), F.lit("fr")), (F.col("o_orderkey") % 3).cast("int"))
    return _reformatted(o.select("o_orderkey", text.alias("text"), locale.alias("locale")), "o_orderkey").drop("via")


@query(f"SELECT o_orderkey, CASE WHEN day(last_day(o_orderdate)) = 31 THEN '31 ' ELSE '[PLEASE REVIEW] ' END || {ID}[month(o_orderdate)] || ' ' || year(o_orderdate) AS final FROM orders")
def reformat_date_invalid(spark, sf_dir):
    o = read_table(spark, sf_dir, "orders")
    text = F.concat(F.lit("31 "), _months(MONTHS_EN, F.month("o_orderdate")), F.lit(" "), F.year("o_orderdate").cast("string"))
    return _reformatted(o.select("o_orderkey", text.alias("text"), F.lit("id").alias("locale")), "o_orderkey").drop("via")


@query(f"SELECT o_orderkey, 'in ' || {EN}[month(o_orderdate)] || ' ' || year(o_orderdate) AS final FROM orders")
def reformat_month_year(spark, sf_dir):
    o = read_table(spark, sf_dir, "orders")
    m, y = _months(MONTHS_ID, F.month("o_orderdate")), F.year("o_orderdate").cast("string")
    text = F.concat(F.lit("in "), F.when(F.col("o_orderkey") % 2 == 0, F.concat(m, F.lit(", "), y)).otherwise(F.concat(y, F.lit(" "), m)))
    return _reformatted(o.select("o_orderkey", text.alias("text"), F.lit("en").alias("locale")), "o_orderkey").drop("via")


@query(f"""WITH t AS (SELECT o_orderkey, o_orderdate::DATE AS a, (o_orderdate::DATE + ((o_orderkey % 400)::INTEGER - 200)) AS b FROM orders)
SELECT o_orderkey, 'from ' || strftime(least(a, b), '%d') || ' ' || {EN}[month(least(a, b))] || ' ' || year(least(a, b)) || ' until ' || strftime(greatest(a, b), '%d') || ' ' || {EN}[month(greatest(a, b))] || ' ' || year(greatest(a, b)) AS final FROM t""")
def reformat_date_range(spark, sf_dir):
    o = read_table(spark, sf_dir, "orders").select("o_orderkey", F.to_date("o_orderdate").alias("a"))
    o = o.withColumn("b", F.date_add("a", (F.col("o_orderkey") % 400).cast("int") - 200))
    show = lambda c: F.concat(F.date_format(c, "dd"), F.lit(" "), _months(MONTHS_EN, F.month(c)), F.lit(" "), F.year(c).cast("string"))
    text = F.concat(F.lit("from "), show("a"), F.lit(" until "), show("b"))
    return _reformatted(o.select("o_orderkey", text.alias("text"), F.lit("en").alias("locale")), "o_orderkey").drop("via")


@query("SELECT c_custkey, 'Mr. ' || n || ' bertemu Ibu ' || n || ' di ibu kota' AS final FROM (SELECT c_custkey, 'N' || translate(c_custkey::VARCHAR, '0123456789', 'abcdefghij') AS n FROM customer)")
def honorific_titles(spark, sf_dir):
    n = F.concat(F.lit("N"), F.translate(F.col("c_custkey").cast("string"), "0123456789", "abcdefghij"))
    text = F.concat(F.lit("mr "), n, F.lit(" bertemu ibu "), n, F.lit(" di ibu kota"))
    return _reformatted(read_table(spark, sf_dir, "customer").select("c_custkey", text.alias("text"), F.lit("id").alias("locale")), "c_custkey").drop("via")


# Subjects ---------------------------------------------------------------------


@query("SELECT c_custkey, 'Ibu ' || n || ' menyatakan a. Beliau datang b. Beliau menambahkan c.' AS text, 2::INTEGER AS changes FROM (SELECT c_custkey, 'N' || translate(c_custkey::VARCHAR, '0123456789', 'abcdefghij') AS n FROM customer)")
def subject_pronouns(spark, sf_dir):
    n = F.concat(F.lit("N"), F.translate(F.col("c_custkey").cast("string"), "0123456789", "abcdefghij"))
    text = F.concat(F.lit("Ibu "), n, F.lit(" menyatakan a. Ibu "), n, F.lit(" datang b. menambahkan c."))
    df = read_table(spark, sf_dir, "customer").select("c_custkey", text.alias("text"), F.lit("id").alias("locale"), F.lit("reference_check").alias("type_of_check"))
    return subjects.continue_documents(df).select("c_custkey", "text", F.size("subject_changes").alias("changes"))


@query(r"""WITH w AS (SELECT doc_id, unnest(regexp_split_to_array(text, '[^\p{L}]+')) AS name FROM documents),
c AS (SELECT doc_id, name, count(*) AS n FROM w WHERE regexp_full_match(name, '[A-Z][a-z]+') GROUP BY 1, 2 HAVING count(*) >= 2)
SELECT doc_id, max(n)::BIGINT AS n, count(*)::BIGINT AS names FROM c GROUP BY 1""")
def dominant_name(spark, sf_dir):
    """How often the most frequent capitalised word occurs, and how many recur."""
    d = read_table(spark, sf_dir, "documents")
    w = d.select("doc_id", F.explode(F.split("text", r"[^\p{L}]+")).alias("name")).where(F.col("name").rlike("^[A-Z][a-z]+$"))
    c = w.groupBy("doc_id", "name").agg(F.count(F.lit(1)).alias("n")).where("n >= 2")
    return c.groupBy("doc_id").agg(F.max("n").alias("n"), F.count(F.lit(1)).alias("names"))


# Guards ---------------------------------------------------------------------


@query("""WITH p AS (SELECT c_custkey, CASE c_custkey % 4 WHEN 0 THEN 'ID ' WHEN 1 THEN 'xx' WHEN 2 THEN '' ELSE 'en' END AS locale,
  CASE c_custkey % 3 WHEN 0 THEN 'Indonesia' WHEN 1 THEN 'mars' ELSE 'thailand' END AS tenant,
  CASE c_custkey % 5 WHEN 0 THEN 'short text' WHEN 1 THEN repeat('abcdefghij', 5) ELSE repeat('some words here ', 6) END AS data FROM customer)
SELECT c_custkey, CASE WHEN c_custkey % 4 = 2 THEN 'MISSING_LOCALE' WHEN c_custkey % 4 = 1 THEN 'UNSUPPORTED_LOCALE' WHEN c_custkey % 3 = 1 THEN 'UNSUPPORTED_TENANT'
  WHEN c_custkey % 5 = 0 THEN 'TEXT_TOO_SHORT' WHEN c_custkey % 5 = 1 THEN 'TEXT_TOO_FEW_WORDS' END AS error FROM p""")
def guard_error_codes(spark, sf_dir):
    k = F.col("c_custkey")
    rows = read_table(spark, sf_dir, "customer").select(
        "c_custkey",
        F.lit("general").alias("type_of_check"),
        F.get(F.array(*map(F.lit, ["ID ", "xx", "", "en"])), (k % 4).cast("int")).alias("locale"),
        F.get(F.array(*map(F.lit, ["Indonesia", "mars", "thailand"])), (k % 3).cast("int")).alias("tenant"),
        F.lit("plain").alias("format"),
        F.when(k % 5 == 0, "short text").when(k % 5 == 1, F.repeat(F.lit("abcdefghij"), 5)).otherwise(F.repeat(F.lit("some words here "), 6)).alias("data"),
    )
    return guards.verdicts(rows).select("c_custkey", F.col("error.error").alias("error"))


@query(r"""SELECT doc_id, NOT regexp_matches(text, '\p{L}') AS symbol_only, regexp_matches(text, '<[^>]+>') OR regexp_matches(text, '(?i)javascript:|<script\b|\bon\w+\s*=') AS tags, greatest(1, length(text) // 4)::INTEGER AS tokens FROM documents""")
def guard_verdicts(spark, sf_dir):
    t = F.col("text")
    return read_table(spark, sf_dir, "documents").select("doc_id", guards.symbol_only(t).alias("symbol_only"), guards.has_markup(t).alias("tags"), guards.tokens_of(t).alias("tokens"))


@query("""SELECT event_id, CASE event_id % 4 WHEN 0 THEN 'INVALID_JSON_PAYLOAD' WHEN 1 THEN 'UNKNOWN_FIELDS' END AS code, CASE event_id % 4 WHEN 0 THEN 'payload is not an object' WHEN 1 THEN 'unknown fields: a, b' END AS message FROM events""")
def payload_unknown_fields(spark, sf_dir):
    """Every event's payload against the one key it may have; some are widened or cut first."""
    e = read_table(spark, sf_dir, "events")
    k = F.col("event_id") % 4
    raw = F.when(k == 0, F.lit("[1, 2]")).when(k == 1, F.lit('{"b": 1, "k": 2, "a": {"k": 3}}')).otherwise(F.lit('{"k": "a, b"}'))
    found = guards.payload_shape(raw, ["k"])
    return e.select("event_id", found["error"].alias("code"), found["message"].alias("message"))


@query("""SELECT event_id, CASE event_id % 6 WHEN 0 THEN 'malicious_payload: forbidden key' WHEN 1 THEN 'malicious_payload: sql-like' WHEN 2 THEN 'malicious_payload: html/xss' WHEN 3 THEN 'unknown fields: other' END AS message,
  CASE WHEN event_id % 6 >= 4 THEN 'number ' || event_id || ' costs $5' END AS data,
  CASE WHEN event_id % 6 = 2 THEN 'bold ' || event_id WHEN event_id % 6 >= 4 THEN 'number ' || event_id || ' costs $5' END AS stripped FROM events""")
def payload_scan(spark, sf_dir):
    """Payloads with a forbidden key, a statement, tags or an unknown field, and plain ones; with tags rejected and stripped."""
    k, n = F.col("event_id") % 6, F.col("event_id").cast("string")
    data = F.concat(F.lit('{"data": "number '), n, F.lit(' costs $5"'))
    raw = (
        F.when(k == 0, F.concat(data, F.lit(', "report_id": {"$where": 1}}')))
        .when(k == 1, F.lit('{"data": "drop it all"}'))
        .when(k == 2, F.concat(F.lit('{"data": "<b>bold</b> '), n, F.lit('"}')))
        .when(k == 3, F.concat(data, F.lit(', "other": 1}')))
        .otherwise(F.concat(data, F.lit(', "locale": "$en"}')))
    )
    strict, lax = guards.validate_and_scan(raw), guards.validate_and_scan(raw, reject_markup=False)
    return read_table(spark, sf_dir, "events").select("event_id", strict["error"]["message"].alias("message"), strict["data"].alias("data"), lax["data"].alias("stripped"))


@query("""SELECT event_id, CASE event_id % 7 WHEN 0 THEN '$.data.list[1].$where' WHEN 1 THEN '$.data.list[0].deep[0][1].note' WHEN 2 THEN '$.$or' WHEN 3 THEN '$.a[2]' ELSE '$.z' END AS path,
  CASE event_id % 7 WHEN 0 THEN 'forbidden key: $where' WHEN 1 THEN 'html/xss' WHEN 2 THEN 'forbidden key: $or' WHEN 3 THEN 'sql-like' ELSE 'html/xss' END AS reason FROM events WHERE event_id % 7 < 5""")
def payload_deep_scan(spark, sf_dir):
    """The first hit of nested payloads, depth first, with its path."""
    e = read_table(spark, sf_dir, "events")
    k, n = F.col("event_id") % 7, F.col("event_id").cast("string")
    raw = F.concat(
        F.when(k == 0, '{"data": {"list": [{"q": "$fine"}, {"$where": "<b>", "x": {"$y": 1}}]}, "z": "<i>')
        .when(k == 1, '{"data": {"list": [{"deep": [[1, {"note": "<b>x</b>"}, "drop"]]}]}, "z": "<i>')
        .when(k == 2, '{"$or": [{"$and": 1}], "data": "<b>')
        .when(k == 3, '{"b": "<b>x</b>", "a": [1, null, "drop table", "')
        .when(k == 4, '{"y": {"ok": [true, 1.5, "fine"]}, "z": "<u>')
        .when(k == 5, '{"a": "$price {[", "b": [[[]]], "c": {}, "d": "')
        .otherwise('not json <b> {"$x": "'),
        n,
        F.when(k == 3, F.lit('"]}')).otherwise(F.lit('"}')),
    )
    return payloads.scan(e.select("event_id", raw.alias("raw")), "event_id", "raw")


@query("""SELECT c_custkey, ['TEXT_TOO_SHORT', 'TEXT_TOO_FEW_WORDS', 'TEXT_NOT_MEANINGFUL', 'TEXT_INVALID_SEMANTIC', NULL][c_custkey % 5 + 1] AS error FROM customer""")
def semantic_errors(spark, sf_dir):
    """The four classes of texts that can't be checked, and one that can."""
    reasons = F.array(*map(F.lit, ["too_short", "too_few_words", "not_meaningful", "noise", "length_only_ok"]))
    reason = F.get(reasons, (F.col("c_custkey") % 5).cast("int"))
    verdict = F.struct((reason == "length_only_ok").alias("passes"), reason.alias("reason"))
    return read_table(spark, sf_dir, "customer").select("c_custkey", guards.semantic_error(verdict)["error"].alias("error"))


@query("""SELECT c_custkey, CASE c_custkey % 4 WHEN 0 THEN NULL WHEN 1 THEN 'LOCALE_LANGUAGE_MISMATCH' WHEN 2 THEN 'LOCALE_LANGUAGE_MISMATCH' ELSE NULL END AS error FROM customer""")
def language_guard(spark, sf_dir):
    """The language guard as the last verdict: English, Swahili and Thai sent as English, Indonesian as Indonesian."""
    k = F.col("c_custkey")
    said = F.array(*map(F.lit, [
        "the report of the company was not what we would have said about it, and they know it is not so",
        "hii ni taarifa ya watu wa mji huu na siku za baada ya kuwa katika hiyo kama vile yake na wake pia",
        "รายงานฉบับนี้เป็นเรื่องของบริษัทและลูกค้า ของเรา ที่ ได้ ทำ งาน ร่วม กัน มา นาน แล้ว และ จะ ทำ ต่อ ไป อีก นาน มาก ครับ",
        "laporan ini tidak akan dari mereka karena sudah ada pada saat itu juga dan bisa menjadi lebih untuk yang lebih",
    ]))
    rows = read_table(spark, sf_dir, "customer").select("c_custkey", F.lit("general").alias("type_of_check"), F.lit("indonesia").alias("tenant"), F.when(k % 4 == 3, "id").otherwise("en").alias("locale"), F.lit("plain").alias("format"), F.get(said, (k % 4).cast("int")).alias("data"))
    return guards.verdicts(rows, Config(check_language=True, lang_min_confidence=0.6)).select("c_custkey", F.col("error.error").alias("error"))


@query("SELECT event_type, count(*)::BIGINT AS n, count(*) FILTER (len(list_filter(json_keys(props), lambda k: k <> 'k')) > 0)::BIGINT AS with_extra FROM events GROUP BY 1")
def payload_key_audit(spark, sf_dir):
    e = read_table(spark, sf_dir, "events")
    extra = F.size(F.array_except(F.json_object_keys("props"), F.array(F.lit("k")))) > 0
    return e.groupBy("event_type").agg(F.count(F.lit(1)).alias("n"), F.sum(F.when(extra, 1).otherwise(0)).cast("long").alias("with_extra"))


# HTML -------------------------------------------------------------------------


@query("SELECT page_id, html FROM pages")
def html_roundtrip(spark, sf_dir):
    f = html.freeze_documents(read_table(spark, sf_dir, "pages"))
    return f.select("page_id", html.reverse(F.col("skeleton"), F.col("text_map"), F.col("table_map")).alias("html"))


@query(r"""SELECT page_id, (i - 1)::INTEGER AS i, nodes[i] AS text FROM (SELECT page_id, list_filter(regexp_split_to_array(html,
  '(?is)<!--.*?-->|<(?:script\b.*?</script|style\b.*?</style|noscript\b.*?</noscript)\s*>|<[^>]*>'), lambda x: regexp_replace(x, '\s', '', 'g') <> '') AS nodes FROM pages), unnest(range(1, len(nodes) + 1)) AS r(i)""".replace("\\\\", "\\"))
def html_text_nodes(spark, sf_dir):
    p = read_table(spark, sf_dir, "pages")
    return p.select("page_id", F.posexplode(html.text_nodes(F.col("html"))).alias("i", "text"))


@query("SELECT c_custkey, '<p>[TEXT_01]</p>[TABLE_01]' AS skeleton, c_name AS text_format, '<table><tr><td>' || c_custkey || '</td></tr></table>' AS table_html, '<p>Hi</p><table><tr><td>' || c_custkey || '</td></tr></table>' AS back FROM customer")
def html_tables(spark, sf_dir):
    c = read_table(spark, sf_dir, "customer")
    page = F.concat(F.lit("<p>"), F.col("c_name"), F.lit("</p><table><tr><td>"), F.col("c_custkey").cast("string"), F.lit("</td></tr></table>"))
    f = html.freeze_documents(c.select("c_custkey", page.alias("html")))
    back = html.reverse(F.col("skeleton"), html.chosen_map(F.lit('{"[TEXT_01]": "Hi"}'), F.col("text_map")), F.col("table_map"))
    return f.select("c_custkey", "skeleton", "text_format", F.col("table_map")["[TABLE_01]"].alias("table_html"), back.alias("back"))


@query("""WITH p AS (SELECT page_id, '<table id=' || page_id || '>' AS o, (page_id % 5)::INTEGER AS depth, (page_id % 3)::INTEGER AS more FROM pages),
n AS (SELECT page_id, depth, more, repeat(o || '<tr><td>', depth + 1) || 'x' || repeat('</td></tr></table>', depth + 1) AS nested FROM p)
SELECT page_id, '<p>[TEXT_01]</p>[TABLE_01]' || CASE WHEN more > 0 THEN '<!-- <table> -->' ELSE '' END
    || array_to_string([CASE WHEN depth + i < 8 THEN '[TABLE_0' ELSE '[TABLE_' END || (depth + 1 + i) || ']' FOR i IN range(1, more + 1)], '') AS skeleton,
  (depth + 1 + more)::INTEGER AS tables, nested AS first, substr(nested, length(nested) - length('x' || repeat('</td></tr></table>', depth + 1)) + 1 - length('<table id=' || page_id || '><tr><td>'),
    length('<table id=' || page_id || '><tr><td>x</td></tr></table>')) AS innermost FROM n""")
def html_nested_tables(spark, sf_dir):
    """Up to five tables within each other, then some side by side: all numbered, the outermost frozen."""
    k = F.col("page_id")
    open_, close = F.concat(F.lit("<table id="), k.cast("string"), F.lit("><tr><td>")), F.lit("</td></tr></table>")
    depth, more = (k % 5).cast("int"), (k % 3).cast("int")
    nested = F.concat(F.repeat(open_, depth + 1), F.lit("x"), F.repeat(close, depth + 1))
    rest = F.when(more > 0, F.concat(F.lit("<!-- <table> -->"), F.repeat(F.lit("<table>y</table>"), more))).otherwise("")
    page = F.concat(F.lit("<p>t</p>"), nested, rest)
    f = html.freeze_documents(read_table(spark, sf_dir, "pages").select("page_id", page.alias("html")))
    name = F.format_string("[TABLE_%02d]", depth + 1)
    return f.select("page_id", "skeleton", F.size("table_map").alias("tables"), F.col("table_map")["[TABLE_01]"].alias("first"), F.col("table_map")[name].alias("innermost"))


# Language ---------------------------------------------------------------------

_WORDS_SQL = ", ".join(f"('{w}', '{lang}')" for lang, words in language.WORDS.items() for w in sorted(set(words)))


@query(rf"""WITH list(word, l) AS (VALUES {_WORDS_SQL}), w AS (SELECT doc_id, lang, unnest(regexp_split_to_array(lower(text), '[^\p{{L}}]+')) AS word FROM documents),
h AS (SELECT doc_id, any_value(lang) AS lang, l, count(*) AS n FROM w JOIN list USING (word) GROUP BY doc_id, l),
b AS (SELECT doc_id, any_value(lang) AS lang, max(struct_pack(n := n, l := l)).l AS detected FROM h GROUP BY doc_id)
SELECT lang, detected, count(*)::BIGINT AS n FROM b GROUP BY 1, 2""")
def lang_detect_confusion(spark, sf_dir):
    d = read_table(spark, sf_dir, "documents")
    found = language.detect(d)
    return d.select("doc_id", "lang").join(found, F.col("doc_id") == F.col("id")).groupBy("lang", "detected").agg(F.count(F.lit(1)).alias("n"))


_PROFILES_SQL = ", ".join(f"('{lang}', '{gram}', {rank})" for lang, gram, rank in language.profiles())


@query(rf"""WITH p(lang, gram, rank) AS (VALUES {_PROFILES_SQL}),
w AS (SELECT doc_id, unnest(string_split(trim(regexp_replace(lower(substr(text, 1, {language.SNIPPET})), '[^\p{{L}}]+', ' ', 'g')), ' ')) AS word FROM documents),
g AS (SELECT doc_id, substr(' ' || word || ' ', i::INTEGER, n) AS gram FROM w, (VALUES (1), (2), (3)) s(n), unnest(range(1, length(word) + 4 - n)) r(i) WHERE word <> ''),
c AS (SELECT doc_id, gram, count(*) AS n FROM g WHERE gram <> ' ' GROUP BY 1, 2),
o AS (SELECT doc_id, gram, row_number() OVER (PARTITION BY doc_id ORDER BY n DESC, gram) AS own FROM c QUALIFY own <= {language.RANKS}),
v AS (SELECT doc_id, lang, sum({language.RANKS} - abs(own - rank)) AS worth FROM o JOIN p USING (gram) GROUP BY 1, 2),
b AS (SELECT doc_id, lang, worth, row_number() OVER (PARTITION BY doc_id ORDER BY worth DESC, lang DESC) AS k FROM v)
SELECT doc_id, max(lang) FILTER (k = 1) AS detected, round(max(worth) FILTER (k = 1) / (max(worth) FILTER (k = 1) + coalesce(max(worth) FILTER (k = 2), 0)), 6)::DOUBLE AS confidence
FROM b GROUP BY doc_id HAVING max(worth) > 0""")
def lang_profile_detect(spark, sf_dir):
    """Every document's language by ranks of its character runs."""
    found = language.detect_by_profile(read_table(spark, sf_dir, "documents"))
    return found.select(F.col("id").alias("doc_id"), "detected", F.round("confidence", 6).alias("confidence"))


# Persistence and rates ----------------------------------------------------------


@query("""WITH RECURSIVE e AS (SELECT user_id::VARCHAR AS key, ts, row_number() OVER (PARTITION BY user_id ORDER BY ts) AS i FROM events),
w AS (SELECT key, i, ts, 1::BIGINT AS count, ts + INTERVAL 1 DAY AS expire_at FROM e WHERE i = 1
 UNION ALL SELECT e.key, e.i, e.ts, CASE WHEN e.ts >= w.expire_at THEN 1 ELSE w.count + 1 END, CASE WHEN e.ts >= w.expire_at THEN e.ts + INTERVAL 1 DAY ELSE w.expire_at END FROM w JOIN e ON e.key = w.key AND e.i = w.i + 1)
SELECT key, max(count)::BIGINT AS most, count(*) FILTER (count = 1)::BIGINT AS windows, count(*) FILTER (count > 5)::BIGINT AS rejected, floor(epoch(max(expire_at)))::BIGINT AS last_end FROM w GROUP BY key""")
def rate_limit_fixed_window(spark, sf_dir):
    w = rate_windows(read_table(spark, sf_dir, "events"), "user_id", "ts", 86400, 5)
    return w.groupBy("key").agg(F.max("count").alias("most"), F.sum(F.when(F.col("count") == 1, 1).otherwise(0)).alias("windows"), F.sum(F.when(~F.col("allowed"), 1).otherwise(0)).alias("rejected"), F.max(F.unix_seconds("expire_at")).alias("last_end"))


@query("""WITH RECURSIVE e AS (SELECT user_id::VARCHAR AS key, ts, row_number() OVER (PARTITION BY user_id ORDER BY ts) AS i FROM events),
w AS (SELECT key, i, ts, 1::BIGINT AS count, ts + INTERVAL 1 DAY AS expire_at FROM e WHERE i = 1
 UNION ALL SELECT e.key, e.i, e.ts, CASE WHEN e.ts >= w.expire_at THEN 1 ELSE w.count + 1 END, CASE WHEN e.ts >= w.expire_at THEN e.ts + INTERVAL 1 DAY ELSE w.expire_at END FROM w JOIN e ON e.key = w.key AND e.i = w.i + 1)
SELECT key, count(*)::BIGINT AS rejected, sum(floor(date_sub('microsecond', ts, expire_at) / 1000000))::BIGINT AS wait FROM w WHERE count > 5 GROUP BY key""")
def rate_limit_retry_after(spark, sf_dir):
    """Rejected events and how long they are told to wait."""
    w = rejected(rate_windows(read_table(spark, sf_dir, "events"), "user_id", "ts", 86400, 5))
    return w.groupBy("key").agg(F.count(F.lit(1)).alias("rejected"), F.sum("retry_after").alias("wait"))


@query("""SELECT user_id AS report_id, arg_max(event_type, event_id) FILTER (event_id % 3 = 0) AS kind, arg_max(value, event_id) FILTER (value > 50) AS value, min(event_id)::BIGINT AS created_at FROM events GROUP BY user_id""")
def summary_upsert(spark, sf_dir):
    e = read_table(spark, sf_dir, "events")
    rows = e.select(F.col("user_id").alias("report_id"), F.col("event_id").alias("seq"), F.when(F.col("event_id") % 3 == 0, F.col("event_type")).alias("kind"), F.when(F.col("value") > 50, F.col("value")).alias("value"), F.col("event_id").alias("created_at"))
    return audit.upsert_summary(rows, ["kind", "value"])


@query(ORACLES["summary_upsert"])
def stored_upsert(spark, sf_dir):
    """The same summary, kept as a table that two halves of the events update one after the other."""
    e = read_table(spark, sf_dir, "events")
    rows = e.select(F.col("user_id").alias("report_id"), F.col("event_id").alias("seq"), F.when(F.col("event_id") % 3 == 0, F.col("event_type")).alias("kind"), F.when(F.col("value") > 50, F.col("value")).alias("value"), F.col("event_id").alias("created_at"))
    path = store.scratch(spark)
    for part in (1, 0):
        store.upsert(rows.where(F.col("seq") % 2 == part), path, ["kind", "value"], buckets=16)
    return store.stored_rows(spark, path, ["kind", "value"])


@query("SELECT user_id, event_id, event_type FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) = 1")
def latest_per_key(spark, sf_dir):
    e = read_table(spark, sf_dir, "events").select("user_id", "ts", "event_id", "event_type")
    return audit.latest_per_key(e, "user_id", ["ts", "event_id"]).select("user_id", "event_id", "event_type")


@query("""SELECT sha256(o_orderkey::VARCHAR) AS _id, o_orderkey::VARCHAR AS report_id, 'general' AS toc_type, 'indonesia' AS tenant, 'id' AS locale, o_orderpriority AS message_01, '[]' AS layers,
  strftime(o_orderdate + INTERVAL 7 HOUR, '%Y-%m-%dT%H:%M:%S') || '+07:00' AS created_at,
  strftime(o_orderdate + INTERVAL 7 HOUR, '%d') || ' ' || %s[month(o_orderdate + INTERVAL 7 HOUR)] || ' ' || strftime(o_orderdate + INTERVAL 7 HOUR, '%Y %H:%M:%S') || ' WIB' AS created_at2 FROM orders""".replace("%s[", f"{ID}["))
def mirror_projection(spark, sf_dir):
    o = read_table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").cast("string").alias("report_id"), F.lit("general").alias("toc_type"), F.lit("indonesia").alias("tenant"), F.lit("id").alias("locale"),
        F.lit("raw").alias("body"), F.col("o_orderpriority").alias("message_01"), F.lit("[]").alias("layers"), F.array().cast("array<string>").alias("order"), "o_orderdate",
    )
    stage = audit.stage_rows(o, ["report_id", "toc_type", "tenant", "locale", "body", "message_01", "layers", "order"], F.col("o_orderdate").cast("timestamp"))
    return audit.mirror(stage)


@query("SELECT page_id, sha1(html) AS sha1_hex, to_base64(unhex(sha1(html))) AS sha1_base64 FROM pages")
def doc_fingerprint(spark, sf_dir):
    digest, short = audit.fingerprint(F.col("html"))
    return read_table(spark, sf_dir, "pages").select("page_id", digest.alias("sha1_hex"), short.alias("sha1_base64"))


@query("SELECT o_orderkey, row_number() OVER (ORDER BY o_orderdate, o_orderkey)::BIGINT AS no FROM orders")
def qa_row_numbering(spark, sf_dir):
    o = read_table(spark, sf_dir, "orders").select("o_orderkey", "o_orderdate")
    return audit.number_rows(o, ["o_orderdate", "o_orderkey"]).select("o_orderkey", "no")


@query("SELECT o_orderkey, len(list_filter(['a','b','c'], lambda x: NOT list_contains(CASE WHEN o_orderkey % 2 = 0 THEN ['a'] ELSE ['a','b'] END, x)))::INTEGER AS missing FROM orders")
def qa_missing_fields(spark, sf_dir):
    have = F.when(F.col("o_orderkey") % 2 == 0, F.array(F.lit("a"))).otherwise(F.array(F.lit("a"), F.lit("b")))
    return read_table(spark, sf_dir, "orders").select("o_orderkey", F.size(audit.missing_fields(have, ["a", "b", "c"])).alias("missing"))


@query("SELECT lang, sum(greatest(1, length(text) // 4))::BIGINT AS total, sum(CASE WHEN length(text) // 4 > 500 THEN length(text) // 4 ELSE 0 END)::BIGINT AS in_long FROM documents GROUP BY lang")
def token_sum(spark, sf_dir):
    n = guards.tokens_of(F.col("text"))
    return read_table(spark, sf_dir, "documents").groupBy("lang").agg(F.sum(n).alias("total"), F.sum(F.when(n > 500, n).otherwise(0)).alias("in_long"))


# Names, prompts, chunks ---------------------------------------------------------


@query("SELECT c_custkey, 'Meeting at [ORG_0] in [LOC_0] with ' || c_custkey AS masked FROM customer")
def ner_masking(spark, sf_dir):
    text = F.concat(F.lit("Meeting at Example Bank in Jakarta with "), F.col("c_custkey").cast("string"))
    df = read_table(spark, sf_dir, "customer").select("c_custkey", masking.empty_state(text).alias("_m"))
    return backends.mask_names(df).select("c_custkey", F.col("_m.text").alias("masked"))


def _place_model():
    """A tagger that stands for a model: places by their names."""
    import re

    return lambda texts: [[(m.start(), m.end(), "LOC") for m in re.finditer("Jakarta|Bandung", t)] for t in texts]


@query("SELECT c_custkey, 'From [LOC_0] to [LOC_1], ' || c_custkey AS masked FROM customer")
def ner_model(spark, sf_dir):
    """A Python model in batches on the executors, its spans one more layer."""
    text = F.concat(F.lit("From Jakarta to Bandung, "), F.col("c_custkey").cast("string"))
    df = read_table(spark, sf_dir, "customer").select("c_custkey", masking.empty_state(text).alias("_m"))
    return models.mask_names(df, "places", _place_model).select("c_custkey", F.col("_m.text").alias("masked"))


def _rewriting_model():
    """A rewriter that stands for a model: it fails for some texts and loses a token in others."""

    def model(texts):
        if any("fails" in t for t in texts):
            raise RuntimeError("no answer")
        return [t.replace("[EMAIL_0]", "nobody") if "loses" in t else t.replace("wrote", "has written") for t in texts]

    return model


@query("""SELECT c_custkey, CASE c_custkey % 3 WHEN 0 THEN '[EMAIL_0] has written well ' || c_custkey WHEN 1 THEN '[EMAIL_0] wrote, loses ' || c_custkey ELSE '[EMAIL_0] wrote, fails ' || c_custkey END AS message_02, c_custkey % 3 = 0 AS token_ok FROM customer""")
def rewriter_fallback(spark, sf_dir):
    """What a model rewrote, and the masked text where it failed or lost a token."""
    how = F.get(F.array(*map(F.lit, [" well ", ", loses ", ", fails "])), (F.col("c_custkey") % 3).cast("int"))
    masked = F.concat(F.lit("[EMAIL_0] wrote"), how, F.col("c_custkey").cast("string"))
    df = read_table(spark, sf_dir, "customer").select("c_custkey", masked.alias("masked"))
    return backends.rewrite(df, rewriter=models.rewriter("rewriting", _rewriting_model)).select("c_custkey", "message_02", "token_ok")


@query("""SELECT 'h' || page_id AS report_id, stage, sha256('h' || page_id) AS _id,
  CASE stage WHEN 'html_freeze' THEN '<p>[TEXT_01]</p>[TABLE_01]' ELSE '<p>tulis surat ke kantor untuk keterangan yang lebih lengkap tentang laporan ini segera</p><table><tr><td>' || page_id || '</td></tr></table>' END AS html
FROM pages, (VALUES ('html_freeze'), ('html_reverse')) s(stage)""")
def stage_html_rows(spark, sf_dir):
    """What the two HTML stages store: the skeleton, and the page put back together."""
    p = read_table(spark, sf_dir, "pages")
    page = F.concat(F.lit("<p>tulis surat ke kantor untuk keterangan yang lebih lengkap tentang laporan ini segera</p><table><tr><td>"), F.col("page_id").cast("string"), F.lit("</td></tr></table>"))
    requests = p.select(F.lit("general").alias("type_of_check"), F.lit("indonesia").alias("tenant"), F.lit("id").alias("locale"), F.lit("html").alias("format"), page.alias("data"), F.concat(F.lit("h"), F.col("page_id").cast("string")).alias("report_id"))
    accepted, _ = proofread(requests, Config(reformat=False))
    tables = audit.stage_tables(accepted, F.timestamp_seconds(F.lit(0)))
    freeze = tables["html_freeze"].select("report_id", F.lit("html_freeze").alias("stage"), "_id", F.col("skeleton").alias("html"))
    return freeze.unionByName(tables["html_reverse"].select("report_id", F.lit("html_reverse").alias("stage"), "_id", F.col("html_final").alias("html")))


@query("SELECT c_custkey, CASE WHEN c_custkey % 2 = 0 THEN 'Visit [LOC_0] and [LOC_1], then [ORG_0] by ' ELSE 'Visit [LOC_0] and Chiang Mai, then [ORG_0] by ' END || c_custkey AS masked FROM customer")
def ner_by_tenant(spark, sf_dir):
    """The English tagger, then the tenant's own on what it left."""

    class Thai:
        def spans(self, text):
            return find_spans(text, r"\bChiang Mai\b", "LOC")

    text = F.concat(F.lit("Visit Bangkok and Chiang Mai, then Example Bank by "), F.col("c_custkey").cast("string"))
    tenant = F.when(F.col("c_custkey") % 2 == 0, "thailand").otherwise("malaysia")
    df = read_table(spark, sf_dir, "customer").select("c_custkey", tenant.alias("tenant"), masking.empty_state(text).alias("_m"))
    return backends.mask_by_tenant(df, backends.Gazetteer(), {"thailand": Thai()}).select("c_custkey", F.col("_m.text").alias("masked"))


@query("SELECT c_custkey, 60::INTEGER AS spans, true AS in_place, 7 * 59 + 5 + 7 AS last_end FROM customer")
def ner_spans_by_chunk(spark, sf_dir):
    """Sixty names found in windows of 16 words: each once, at its place in the whole text."""
    text = F.concat(F.repeat(F.lit("x Bali "), 59), F.lit("here Jakarta"))

    class Islands:
        def spans(self, t):
            return find_spans(t, r"\b(?:Bali|Jakarta)\b", "LOC")

    found = backends.spans_by_chunk(text, Islands(), most=16, overlap=4)
    rows = read_table(spark, sf_dir, "customer").select("c_custkey", text.alias("t"), found.alias("s"))
    return rows.select("c_custkey", F.size("s").alias("spans"), F.forall("s", lambda s: F.substring(F.col("t"), s["st"] + 1, s["en"] - s["st"]) == s["val"]).alias("in_place"), F.array_max(F.transform("s", lambda s: s["en"])).alias("last_end"))


@query("""SELECT c_custkey AS doc_id, 'Hello [NAME_0] from ' || CASE WHEN c_custkey % 3 = 0 THEN '[ORG_2]' ELSE '[ORG_0]' END || ', [NAME_0] of [ORG_1]' AS masked,
  CASE WHEN c_custkey % 3 = 0 THEN '[ORG_2]' ELSE '[ORG_0]' END AS token, 'Acme ' || c_custkey AS original, 'NER / model' AS type FROM customer""")
def ner_integration(spark, sf_dir):
    """Finds numbered on after what is masked, put in outside of tokens, under their new names."""
    c = read_table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("doc_id"), F.concat(F.lit("Acme "), F.col("c_custkey").cast("string")).alias("acme"))
    docs = c.select("doc_id", F.concat(F.lit("Hello [NAME_0] from "), F.col("acme"), F.lit(", [NAME_0] of [ORG_1]")).alias("masked"))
    old = c.select("doc_id", F.lit("[NAME_0]").alias("token"), F.lit("Rizal").alias("original")).unionByName(c.where("doc_id % 3 = 0").select("doc_id", F.lit("[ORG_1]").alias("token"), F.lit("Beta").alias("original")))
    new = c.select("doc_id", F.lit("").alias("type"), F.lit("[ORG_7]").alias("token"), F.col("acme").alias("original"))
    new = new.unionByName(c.select("doc_id", F.lit("").alias("type"), F.lit("[PERSON_0]").alias("token"), F.lit("Rizal").alias("original")))
    texts, layers = tokens.integrate(docs, old, new)
    return texts.join(layers, "doc_id").select("doc_id", "masked", "token", "original", "type")


@query("""WITH c AS (SELECT c_custkey::VARCHAR AS report_id, translate(c_custkey::VARCHAR, '0123456789', 'abcdefghij') AS k FROM customer),
t AS (SELECT report_id, 'tulis surat ke u' || k || '@contoh.co.id untuk keterangan yang lebih lengkap tentang laporan ini segera' AS raw, 'tulis surat ke [EMAIL_0] untuk keterangan yang lebih lengkap tentang laporan ini segera' AS masked FROM c)
SELECT stage, report_id, sha256(report_id) AS _id, CASE stage WHEN 'masking' THEN masked WHEN 'generative' THEN masked ELSE raw END AS message
FROM t, (VALUES ('masking'), ('generative'), ('unmask'), ('final')) s(stage)""")
def stage_rows(spark, sf_dir):
    """What each stage of the pipeline stores of a request."""
    c = read_table(spark, sf_dir, "customer")
    letters = F.translate(F.col("c_custkey").cast("string"), "0123456789", "abcdefghij")
    data = F.concat(F.lit("tulis surat ke u"), letters, F.lit("@contoh.co.id untuk keterangan yang lebih lengkap tentang laporan ini segera"))
    requests = c.select(F.lit("general").alias("type_of_check"), F.lit("indonesia").alias("tenant"), F.lit("id").alias("locale"), F.lit("plain").alias("format"), data.alias("data"), F.col("c_custkey").cast("string").alias("report_id"))
    accepted, _ = proofread(requests, Config(reformat=False))
    tables = audit.stage_tables(accepted, F.timestamp_seconds(F.lit(0)))
    shown = {"masking": "message_01", "generative": "message_02", "unmask": "message_03", "final": "message_final"}
    parts = [tables[name].select(F.lit(name).alias("stage"), "report_id", "_id", F.col(m).alias("message")) for name, m in shown.items()]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


@query("SELECT doc_id, greatest(1, ceil((greatest(w - 50, 1)) / 460.0))::INTEGER AS chunks FROM (SELECT doc_id, len(list_filter(regexp_split_to_array(text, '\\s+'), lambda x: x <> '')) AS w FROM documents)")
def ner_chunks(spark, sf_dir):
    return read_table(spark, sf_dir, "documents").select("doc_id", F.size(tokens.chunks(F.col("text"))).alias("chunks"))


@query("SELECT c_custkey, CASE c_custkey % 3 WHEN 0 THEN 'employment_check_plain' WHEN 1 THEN 'reference_check_markup' ELSE 'general_plain' END AS template FROM customer")
def prompt_choice(spark, sf_dir):
    k = (F.col("c_custkey") % 3).cast("int")
    check = F.get(F.array(*map(F.lit, ["employment_check", "reference-check", "other"])), k)
    fmt = backends.normal_format(F.get(F.array(*map(F.lit, ["text", "md", "plain"])), k))
    return read_table(spark, sf_dir, "customer").select("c_custkey", backends.template_name(check, fmt).alias("template"))


@query("SELECT doc_id, text AS message_03, true AS token_ok FROM documents WHERE coalesce(text, '') <> ''")
def proofread_pipeline(spark, sf_dir):
    """All documents through the pipeline without reformatting: what was masked comes back."""
    d = read_table(spark, sf_dir, "documents")
    requests = d.select("doc_id", F.lit("general").alias("type_of_check"), F.lit("indonesia").alias("tenant"), F.lit("en").alias("locale"), F.lit("plain").alias("format"), F.col("text").alias("data"), F.col("doc_id").cast("string").alias("report_id"))
    accepted, _ = proofread(requests, Config(reformat=False, min_chars=0, min_words=0))
    return accepted.select("doc_id", "message_03", "token_ok")


@query()
def proofread_flagship(spark, sf_dir):
    """Documents through every stage, with what was found and changed in each."""
    d = read_table(spark, sf_dir, "documents")
    requests = d.select("doc_id", F.lit("general").alias("type_of_check"), F.lit("indonesia").alias("tenant"), F.lit("en").alias("locale"), F.lit("plain").alias("format"), F.col("text").alias("data"), F.col("doc_id").cast("string").alias("report_id"))
    accepted, _ = proofread(requests, Config(check_language=True))
    return accepted.select("doc_id", F.size("tokens").alias("n_tokens"), F.col("changed_count").alias("n_changes"), "token_ok", F.length("message_final").alias("n_chars"))



# Helpers that other stages call ---------------------------------------------------


@query("""SELECT page_id, CASE page_id % 4 WHEN 0 THEN 'db' || page_id WHEN 1 THEN 'reports' WHEN 2 THEN 'a/b' ELSE 'fallback' END AS name FROM pages""")
def store_database_names(spark, sf_dir):
    """The database in a store's address: with options, several hosts, a longer path, none."""
    n = F.col("page_id").cast("string")
    uri = F.when(F.col("page_id") % 4 == 0, F.concat(F.lit("mongodb://u:p@host:27017/db"), n, F.lit("?retryWrites=true"))).when(F.col("page_id") % 4 == 1, "mongodb+srv://h.example.net/reports").when(F.col("page_id") % 4 == 2, "mongodb://h//a/b").otherwise(F.concat(F.lit("mongodb://host"), n))
    return read_table(spark, sf_dir, "pages").select("page_id", database_name(uri, "fallback").alias("name"))


@query("""SELECT page_id, '<b>bold</b> &amp; <i>x ' || page_id || '</i>alert(1) 1 &lt; 2' AS text FROM pages""")
def sanitize_allowed_tags(spark, sf_dir):
    n = F.col("page_id").cast("string")
    text = F.concat(F.lit("<B class='x'>bold</B> & <p><i onclick=go()>x "), n, F.lit("</i></p><script>alert(1)</script> 1 < 2"))
    return read_table(spark, sf_dir, "pages").select("page_id", guards.allow_tags(text, ["b", "i"]).alias("text"))


@query("""SELECT event_id, CASE WHEN event_id % 3 = 0 THEN 'not {json' ELSE '{' || chr(10) || '  "id": ' || event_id || ',' || chr(10) || '  "list": [' || chr(10) || '    1,' || chr(10) || '    {},' || chr(10) || '    []' || chr(10) || '  ],' || chr(10) || '  "text": "a, {b}: [c]"' || chr(10) || '}' END AS shown FROM events""")
def payload_pretty_json(spark, sf_dir):
    raw = F.when(F.col("event_id") % 3 == 0, "not {json").otherwise(F.concat(F.lit('{"id":'), F.col("event_id").cast("string"), F.lit(', "list" : [1,{ },[]],"text":"a, {b}: [c]"}')))
    return read_table(spark, sf_dir, "events").select("event_id", audit.pretty_json(raw).alias("shown"))


@query("SELECT c_custkey, 'by ' || c_name || ' of Acme ' || c_custkey || ' and [ORG_9]' AS text FROM customer")
def unmask_by_layer(spark, sf_dir):
    """The last layer first: its originals hold tokens of the one before."""
    c = read_table(spark, sf_dir, "customer")
    layer = lambda name, *kv: F.struct(F.lit(name).alias("type"), F.create_map(*kv).alias("map"))
    acme = F.concat(F.lit("Acme "), F.col("c_custkey").cast("string"))
    stack = F.array(layer("pii", F.lit("[NAME_0]"), F.col("c_name")), layer("ner", F.lit("[ORG_1]"), acme, F.lit("[PERSON_0]"), F.lit("[NAME_0]")))
    return c.select("c_custkey", masking.unmask_layers(F.lit("by [PERSON_0] of [ORG_1] and [ORG_9]"), stack).alias("text"))


@query("SELECT c_custkey, 'Call {{PHONE_3}} or {{PHONE_4}}' AS masked, 5::INTEGER AS next, '+62 812-' || lpad(c_custkey::VARCHAR, 6, '0') AS first FROM customer")
def legacy_phone_masks(spark, sf_dir):
    c = read_table(spark, sf_dir, "customer")
    text = F.concat(F.lit("Call +62 812-"), F.lpad(F.col("c_custkey").cast("string"), 6, "0"), F.lit(" or +44 20 7946 0958"))
    m = c.select("c_custkey", masking.mask_legacy(text, "PHONE", 3).alias("m"))
    return m.select("c_custkey", F.col("m.text").alias("masked"), F.col("m.next").alias("next"), F.trim(F.col("m.map")["{{PHONE_3}}"]).alias("first"))


@query("SELECT c_custkey, ['ID', 'MY', 'US', 'ID'][c_custkey % 4 + 1] AS region FROM customer")
def locale_regions(spark, sf_dir):
    locale = F.get(F.array(F.lit(" ID "), F.lit("ms"), F.lit("EN"), F.lit("xx")), (F.col("c_custkey") % 4).cast("int"))
    return read_table(spark, sf_dir, "customer").select("c_custkey", masking.region_of(locale).alias("region"))


@query("SELECT c_custkey, 'last: ' || c_custkey AS a, '' AS b, 'x: y' AS c, 3::INTEGER AS n FROM customer")
def text_format_lines(spark, sf_dir):
    text = F.concat(F.lit("[TEXT_01]: first\r\n\n [TEXT_02] \n[TEXT_03] : x: y\n[TEXT_01]: last: "), F.col("c_custkey").cast("string"))
    m = read_table(spark, sf_dir, "customer").select("c_custkey", html.parse_text_format(text).alias("m"))
    return m.select("c_custkey", F.col("m")["[TEXT_01]"].alias("a"), F.col("m")["[TEXT_02]"].alias("b"), F.col("m")["[TEXT_03]"].alias("c"), F.size("m").alias("n"))


@query("""SELECT c_custkey, CASE c_custkey % 3 WHEN 0 THEN 'v' || c_custkey WHEN 1 THEN 'w' || c_custkey END AS answer FROM customer""")
def rewriter_json_replies(spark, sf_dir):
    """A reply that is JSON, one that has it within, and one without."""
    n = F.col("c_custkey").cast("string")
    k = F.col("c_custkey") % 3
    reply = F.when(k == 0, F.concat(F.lit('{"answer": "v'), n, F.lit('"}'))).when(k == 1, F.concat(F.lit('Here it is:\n{"answer": "w'), n, F.lit('"}\nBye'))).otherwise("no object here")
    return read_table(spark, sf_dir, "customer").select("c_custkey", backends.json_reply(reply)["answer"].alias("answer"))


@query("""SELECT c_custkey, ['English', 'Indonesian', 'Malay'][c_custkey % 3 + 1] || '/' || ['en', 'id', 'ms'][c_custkey % 3 + 1] || ': [EMAIL_0], [ORG_1] | To [EMAIL_0] of [ORG_1] ' || c_custkey AS prompt FROM customer""")
def prompt_rendering(spark, sf_dir):
    locale = F.get(F.array(*map(F.lit, ["en", "id", "ms"])), (F.col("c_custkey") % 3).cast("int"))
    text = F.concat(F.lit("To [EMAIL_0] of [ORG_1] "), F.col("c_custkey").cast("string"))
    prompt = backends.render_prompt(F.lit("{{LOCALE_LANG_NAME}}/{{LOCALE_CODE}}: {{token_list}} | {{text}}"), text, locale)
    return read_table(spark, sf_dir, "customer").select("c_custkey", F.element_at(F.split(prompt, "\n\n"), -1).alias("prompt"))


@query(r"""WITH n AS (SELECT c_custkey, 'N' || translate(c_custkey::VARCHAR, '0123456789', 'abcdefghij') AS n FROM customer)
SELECT c_custkey, n AS by_verb, n || ' Abc' AS by_words, n AS dominant FROM n""")
def subject_openings(spark, sf_dir):
    """The name that a paragraph opens with, before a verb or as capitalised words, and the one that it has most."""
    n = F.concat(F.lit("N"), F.translate(F.col("c_custkey").cast("string"), "0123456789", "abcdefghij"))
    c = read_table(spark, sf_dir, "customer").select("c_custkey", n.alias("n"))
    lead = lambda *parts: subjects.lead_name(F.concat(*parts))
    return c.select("c_custkey", lead(F.lit(" "), F.col("n"), F.lit(" menyatakan hal itu")).alias("by_verb"), lead(F.col("n"), F.lit(" Abc datang")).alias("by_words"), subjects.dominant_name(F.concat(F.lit("Kemudian "), F.col("n"), F.lit(" datang. Budi dan "), F.col("n"), F.lit(" pulang. Kemudian Kemudian."))).alias("dominant"))


@query(r"""WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM documents WHERE text IS NOT NULL),
b AS (SELECT doc_id, regexp_replace(regexp_replace(left(regexp_replace(line, '\[[A-Z][A-Z_]*_\d+\]', ' ', 'g'), 4000), 'https?://\S+|www\.\S+', ' ', 'g'), '\d{3,}', ' ', 'g') AS b FROM l),
c AS (SELECT doc_id, trim(regexp_replace(b, '\s+', ' ', 'g')) AS c FROM b),
n AS (SELECT doc_id, length(c) AS chars, len(list_filter(string_split(c, ' '), lambda w: w <> '')) AS words FROM c)
SELECT doc_id, CASE WHEN chars < 40 THEN 'TEXT_TOO_SHORT' WHEN words < 10 THEN 'TEXT_TOO_FEW_WORDS' ELSE '' END AS error,
  count(*)::BIGINT AS n, sum(chars)::BIGINT AS chars, sum(words)::BIGINT AS words FROM n GROUP BY 1, 2""")
def semantic_lines(spark, sf_dir):
    """Each line of the documents judged as a text of its own."""
    lines = read_table(spark, sf_dir, "documents").select("doc_id", F.explode(F.split("text", "\n")).alias("line"))
    judged = lines.select("doc_id", guards.semantic(F.col("line")).alias("v"))
    error = F.coalesce(guards.semantic_error(F.col("v"))["error"], F.lit("")).alias("error")
    return judged.groupBy("doc_id", error).agg(F.count(F.lit(1)).alias("n"), F.sum("v.chars").alias("chars"), F.sum("v.words").alias("words"))


@query(r"""WITH w AS (SELECT doc_id, regexp_extract_all(text, '[\p{L}\p{M}\p{Nd}\p{Nl}\p{Pc}]+') AS ws FROM documents WHERE text IS NOT NULL),
x AS (SELECT doc_id, unnest(ws) AS name, generate_subscripts(ws, 1) AS i FROM w),
c AS (SELECT doc_id, name, count(*) AS n, min(i) AS i FROM x WHERE regexp_full_match(name, '[A-Z][a-z]+') AND name NOT IN (SELECT unnest(""" + _list([*NAME_STOPWORDS, *SUBJECT_TITLES]) + r""")) GROUP BY 1, 2),
b AS (SELECT doc_id, arg_max(name, n * 10000000 - i) AS name, max(n) AS n FROM c GROUP BY 1)
SELECT w.doc_id, CASE WHEN b.n >= 2 THEN b.name END AS name FROM w LEFT JOIN b ON w.doc_id = b.doc_id""")
def dominant_names(spark, sf_dir):
    """The name that a document has most, the first of equals."""
    d = read_table(spark, sf_dir, "documents").where("text IS NOT NULL")
    return d.select("doc_id", subjects.dominant_name(F.col("text")).alias("name"))


@query("""WITH c AS (SELECT c_custkey, c_name, c_nationkey, c_custkey % 3 AS a, c_nationkey % 4 AS b FROM customer)
SELECT c_custkey, '[A_' || a || ']' || '[NAME_0]' || CASE WHEN a = b THEN '' ELSE '[A_' || b || ']' END AS tokens,
  CASE WHEN a = b THEN 'late ' || c_nationkey ELSE 'early ' || c_custkey END AS first, c_name AS name, 'late ' || c_nationkey AS last FROM c""")
def token_maps_united(spark, sf_dir):
    """Maps of each row united: a later map wins, tokens stay where they came first."""
    token = lambda n: F.concat(F.lit("[A_"), n.cast("string"), F.lit("]"))
    a, b = token(F.col("c_custkey") % 3), token(F.col("c_nationkey") % 4)
    maps = F.array(F.create_map(a, F.concat(F.lit("early "), F.col("c_custkey").cast("string")), F.lit("[NAME_0]"), F.col("c_name")), F.create_map(b, F.concat(F.lit("late "), F.col("c_nationkey").cast("string"))))
    c = read_table(spark, sf_dir, "customer").select("c_custkey", a.alias("a"), b.alias("b"), masking.flatten_maps(maps).alias("m"))
    return c.select("c_custkey", F.array_join(F.map_keys("m"), "").alias("tokens"), F.col("m")[F.col("a")].alias("first"), F.col("m")["[NAME_0]"].alias("name"), F.col("m")[F.col("b")].alias("last"))


@query("""WITH d AS (SELECT c_custkey, (9 + c_custkey % 5)::INTEGER AS n, '08' || substr(repeat(lpad(c_custkey::VARCHAR, 7, '1'), 2), 1, (7 + c_custkey % 5)::INTEGER) AS d FROM customer)
SELECT c_custkey, CASE n WHEN 11 THEN d[1:4] || ' ' || d[5:8] || ' ' || d[9:11] WHEN 12 THEN d[1:4] || ' ' || d[5:8] || ' ' || d[9:12]
  WHEN 10 THEN d[1:4] || ' ' || d[5:7] || ' ' || d[8:10] WHEN 9 THEN d[1:4] || ' ' || d[5:7] || ' ' || d[8:9] ELSE d[1:4] || ' ' || d[5:7] || ' ' || d[8:11] || ' ' || d[12:13] END AS mobile,
  '(021) ' || CASE n WHEN 9 THEN d[3:5] || ' ' || d[6:7] || ' ' || d[8:9] WHEN 10 THEN d[3:6] || ' ' || d[7:10] WHEN 11 THEN d[3:5] || ' ' || d[6:7] || ' ' || d[8:9] || ' ' || d[10:11]
  WHEN 12 THEN d[3:5] || ' ' || d[6:8] || ' ' || d[9:11] || ' ' || d[12:12] ELSE d[3:5] || ' ' || d[6:8] || ' ' || d[9:11] || ' ' || d[12:13] END AS landline FROM d""")
def phone_groups(spark, sf_dir):
    """Indonesian mobile and landline numbers of seven to thirteen digits in groups."""
    k = F.col("c_custkey")
    rest = F.substring(F.repeat(F.lpad(k.cast("string"), 7, "1"), 2), F.lit(1), (7 + k % 5).cast("int"))
    d = read_table(spark, sf_dir, "customer").select("c_custkey", rest.alias("rest"))
    return d.select("c_custkey", reformat.id_mobile(F.concat(F.lit("08"), F.col("rest"))).alias("mobile"), reformat.id_landline(F.lit("021"), F.col("rest")).alias("landline"))
