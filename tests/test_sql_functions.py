import datetime

import pytest
from pyspark.errors import AnalysisException
from pyspark.sql import functions as F

from textshield.functions import catalog
from textshield.functions.spans import find_spans, greedy
from textshield.operators import audit, guards, masking
from textshield.sources.io import read_table


@pytest.fixture(scope="module")
def sql(spark):
    catalog.register(spark)
    return spark


def test_spans_equal_the_expression(sql, sf):
    docs = read_table(sql, sf, "documents").select("doc_id", "text")
    odd = [(-1, None), (-2, ""), (-3, "a\u0001b@c.de #tag 31/12/2024"), (-4, "é@x.de Ä 12 mars 2020 from 2019 to 2020, PT. Maju Jaya Tbk. 10.0.0.1"), (-5, "1.2.3.4 " * 5000), (-6, "😀 Ibu Monica 😀 0812 3456 7890 x@y.zz")]
    docs = docs.unionByName(sql.createDataFrame(odd, "doc_id long, text string"))
    native = docs.select("doc_id", F.explode(greedy(masking.pattern_spans(F.coalesce("text", F.lit(""))))).alias("s")).select("doc_id", "s.*")
    called = sql.sql("SELECT d.doc_id, s.* FROM {docs} d, LATERAL pii_spans(d.text) s", docs=docs)
    assert called.columns == ["doc_id", "st", "en", "cat", "val"]
    assert called.exceptAll(native).isEmpty() and native.exceptAll(called).isEmpty()
    assert called.where("doc_id = -5").count() == 5000


def test_spans_of_some_categories(sql):
    rows = sql.sql("SELECT * FROM pii_spans('10.0.0.1 and a@b.de', categories => ' email, ip_address ')").collect()
    assert [tuple(r) for r in rows] == [(0, 8, "IP_ADDRESS", "10.0.0.1"), (13, 19, "EMAIL", "a@b.de")]
    assert sql.sql("SELECT * FROM pii_spans('10.0.0.1 and a@b.de', 'EMAIL')").count() == 1
    assert sql.sql("SELECT * FROM pii_spans(NULL)").count() == 0
    for bad in ("pii_spans('x', 'NAME')", "pii_spans(3)", "pii_spans('x', concat(t, 'EMAIL'))"):
        with pytest.raises(AnalysisException):
            sql.sql(f"SELECT s.* FROM VALUES ('x') AS d(t), LATERAL {bad} s").collect()


def test_disjoint_spans(sql):
    rows = [("a", 0, 4, "x"), ("a", 0, 9, "y"), ("a", 3, 5, "z"), ("a", 9, 10, "w"), ("b", 5, 6, "x"), (None, 1, 2, "n"), (None, 1, 3, "m"), ("b", None, 3, "?"), ("b", 1, 5, "k"), ("b", 1, 5, "j")]
    sql.createDataFrame(rows, "doc string, st int, en int, val string").createOrReplaceTempView("found_spans")
    got = sql.sql("SELECT * FROM disjoint_spans(TABLE(found_spans), 'doc')").collect()
    assert {tuple(r) for r in got} == {("a", 0, 9, "y"), ("a", 9, 10, "w"), ("b", 1, 5, "j"), ("b", 5, 6, "x"), (None, 1, 3, "m")}
    assert len(got) == 5
    with pytest.raises(AnalysisException):
        sql.sql("SELECT * FROM disjoint_spans(TABLE(found_spans), 'text')").collect()
    none = sql.sql("SELECT * FROM disjoint_spans(TABLE(SELECT * FROM found_spans WHERE false), 'doc')")
    assert none.count() == 0 and none.columns == ["doc", "st", "en", "val"]


def test_many_spans_of_one_document(sql):
    """A million spans of one text, chosen in a stream."""
    sql.range(1_000_000).selectExpr("1 AS doc", "id AS st", "id + 2 AS en").createOrReplaceTempView("long_spans")
    assert sql.sql("SELECT count(*) AS n FROM disjoint_spans(TABLE(long_spans), 'doc')").first()["n"] == 500_000


def test_scalars_equal_the_expressions(sql, sf):
    docs = read_table(sql, sf, "documents").select("doc_id", "text")
    docs = docs.unionByName(sql.createDataFrame([(-1, None), (-2, ""), (-3, "1 [EMAIL_0] [ORG_12] [EMAIL_0] <b onclick=x> & select")], "doc_id long, text string"))
    t = F.col("text")
    wanted = docs.select("doc_id", masking.token_list(t).alias("a"), guards.tokens_of(t).alias("b"), guards.symbol_only(t).alias("c"), guards.has_markup(t).alias("d"), guards.has_sql(t).alias("e"), guards.strip_markup(t).alias("f"))
    called = sql.sql("SELECT doc_id, pii_tokens(text) a, token_estimate(text) b, symbol_only(text) c, has_markup(text) d, has_statement(text) e, strip_markup(text) f FROM {d}", d=docs)
    assert called.exceptAll(wanted).isEmpty() and wanted.exceptAll(called).isEmpty()


def test_scalars_by_example(sql):
    row = sql.sql("SELECT unmask_text('[ORG_1] met [ORG_2]', map('[ORG_1]', 'A [ORG_2]')) u, calling_code('62812') c, calling_code('999') n, document_key('a') k, document_key('a', 'b') m").first()
    assert row["u"] == "A [ORG_2] met [ORG_2]" and row["c"] == "62" and row["n"] is None
    assert row["k"] != row["m"]
    at = sql.createDataFrame([(datetime.datetime(2024, 5, 31, 20, 0, 1),)], "ts timestamp")
    ours = at.select(audit.local_iso(F.col("ts")).alias("i"), audit.local_long(F.col("ts")).alias("l")).first()
    assert tuple(sql.sql("SELECT local_iso(ts) i, local_long(ts) l FROM {t}", t=at).first()) == tuple(ours)


def test_scalars_are_inlined(sql, sf):
    docs = read_table(sql, sf, "documents")
    plan = sql.sql("SELECT token_estimate(text) n FROM {d} WHERE has_markup(text)", d=docs)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "RLIKE" in plan


def test_registered_under_a_prefix(sql):
    assert "ts_pii_spans" in catalog.register(sql, "ts_")
    assert sql.sql("SELECT ts_token_estimate('abcdefgh') n").first()["n"] == 2
    assert sql.sql("SELECT * FROM ts_pii_spans('a@b.de')").count() == 1


def test_spans_one_pattern(sql):
    """The same matches as the expression of one pattern."""
    text = "x 10.0.0.1, 1.2.3.4.5 and 1.2.3"
    df = sql.createDataFrame([(text,)], "t string")
    one = df.select(F.explode(find_spans(F.col("t"), r"\b(?:\d{1,3}\.){3}\d{1,3}\b", "IP_ADDRESS")).alias("s")).select("s.*")
    assert [tuple(r) for r in one.collect()] == [tuple(r) for r in sql.sql("SELECT s.* FROM {d}, LATERAL pii_spans(t, 'IP_ADDRESS') s", d=df).collect()]
