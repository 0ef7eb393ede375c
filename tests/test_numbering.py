from pyspark.sql import functions as F

from textshield.functions import numbering
from textshield.operators import masking


def test_every_range_and_its_bounds(spark):
    rows, want = [], {}
    for r in numbering.ranges():
        for n in (r.least - 1, r.least, r.most, r.most + 1):
            digits = r.code + r.national + "5" * (n - len(r.national))
            rows.append((digits,))
            want[digits] = (r.region, r.kind, r.least <= n <= r.most)
    got = numbering.classify(spark.createDataFrame(rows, "d string"), "d").collect()
    assert {r["d"]: (r["number"]["region"], r["number"]["kind"], r["number"]["possible"]) for r in got} == want
    assert {r.region for r in numbering.ranges()} == set(numbering.TRUNK) and len(numbering.TRUNK) >= 10


def test_unknown_and_odd(spark):
    rows = [(None,), ("",), ("9",), ("999123456",), ("622",)]
    got = [r["number"] for r in numbering.classify(spark.createDataFrame(rows, "d string"), "d").collect()]
    assert got[:4] == [None] * 4 and not got[4]["possible"]


def test_as_dialled(spark):
    rows = [("020 7946 0958", "GB", "442079460958"), ("+44 20 7946 0958", "ID", "442079460958"), ("0044 20 7946 0958", "FR", "442079460958"), ("(415) 555-0100", "us", "14155550100"), ("6123 4567", "SG", "6561234567"), ("123", "XX", None), ("0812 3456 7890", "ID", "6281234567890")]
    df = spark.createDataFrame(rows, "n string, region string, want string")
    assert df.where(~numbering.international(F.col("n"), F.col("region")).eqNullSafe(F.col("want"))).isEmpty()


def test_only_possible_numbers_are_masked(spark):
    rows = [("call +65 6123 4567 or +65 6123 45", "call [PHONE_NUMBER_0] or +65 6123 45"), ("(+62) 812 3456 7890", "[PHONE_NUMBER_0]"), ("+358 40 1234567", "[PHONE_NUMBER_0]"), ("+999 123 4567", "+999 123 4567")]
    df = spark.createDataFrame(rows, "text string, want string").withColumn("_m", masking.empty_state(F.col("text")))
    got = df.select("want", masking.apply_spans(F.col("_m"), masking.phone_spans, "phones_lib")["text"].alias("got")).collect()
    assert [r["got"] for r in got] == [r["want"] for r in got]
