import pytest
from pyspark.sql import functions as F

from textshield.functions.spans import find_spans, greedy, overlaps
from textshield.operators import masking


def masked(spark, *texts):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, text string")
    return masking.mask_documents(df).orderBy("i").collect()


def test_spans_and_overlap(spark):
    row = spark.range(1).select(find_spans(F.lit("Hi [EMAIL_0] there"), r"\[[A-Z_]+_\d+\]", "T").alias("s"))
    span = row.select(F.get("s", F.lit(0)).alias("x"))
    assert span.select("x.st", "x.en").first() == (3, 12)
    inside = F.struct(F.lit(3).alias("st"), F.lit(4).alias("en"))
    before = F.struct(F.lit(0).alias("st"), F.lit(2).alias("en"))
    assert row.select(overlaps(inside, F.col("s")), overlaps(before, F.col("s"))).first() == (True, False)


def test_greedy_takes_longest_of_equal_starts(spark):
    s = [(0, 2, "A", "a"), (0, 5, "B", "b"), (4, 6, "C", "c"), (5, 7, "D", "d"), (5, 7, "E", "e")]
    df = spark.createDataFrame([(s,)], "s array<struct<st:int,en:int,cat:string,val:string>>")
    assert [x["cat"] for x in df.select(greedy(F.col("s")).alias("g")).first()["g"]] == ["B", "D"]


def test_layers_in_order(spark):
    (row,) = masked(spark, "Email test@example.com on 02 Mei 2018 #fraud")
    assert row["masked"] == "Email [EMAIL_0] on [DATE_0] [KEYWORD_0]"
    assert row["order"] == ["pii_EMAIL", "regex_DATE", "regex_KEYWORD"]
    assert row["layered_maps"]["[DATE_0]"] == "02 Mei 2018"


def test_digits_are_numbers_to_call(spark):
    a, b, c, d = masked(spark, "Call 0812345678 now", "Call +12345 and 12345", "", None)
    assert a["masked"] == "Call [PHONE_NUMBER_0] now" and a["layered_maps"] == {"[PHONE_NUMBER_0]": "0812345678"}
    assert b["masked"] == "Call +12345 and 12345"
    assert c["masked"] == "" and d["masked"] is None


def test_tokens_are_left_alone_and_counted_on(spark):
    (row,) = masked(spark, "a@b.org, then c@d.org and 4111 1111 1111 1111")
    assert row["masked"] == "[EMAIL_0], then [EMAIL_1] and [CREDIT_CARD_0]"


def test_unmask(spark):
    m = F.create_map(F.lit("[NAME_0]"), F.lit("Rizal"))
    got = spark.range(1).select(masking.unmask(F.lit("Hi [NAME_0] [X_1]"), m), masking.token_list(F.lit("Hi [A_0] [A_0] [B_1]"))).first()
    assert got[0] == "Hi Rizal [X_1]" and got[1] == ["[A_0]", "[B_1]"]


@pytest.mark.parametrize("locale,region", [("id", "ID"), ("ms", "MY"), ("en", "US"), ("zz", "ID"), (None, "ID")])
def test_region(spark, locale, region):
    assert spark.range(1).select(masking.region_of(F.lit(locale).cast("string"))).first()[0] == region


def test_roundtrip_and_no_shuffle(spark, sf):
    m = masking.mask_documents(spark.read.parquet(f"{sf}/documents.parquet"))
    bad = m.where(~masking.unmask(F.col("masked"), F.col("layered_maps")).eqNullSafe(F.col("text")))
    assert bad.count() == 0
    plan = m._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Python" not in plan
