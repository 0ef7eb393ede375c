import json
import random

from pyspark.sql import functions as F

from textshield.operators import audit, guards
from textshield.sources.io import database_name


def test_pretty_json_against_python(spark):
    rng = random.Random(3)

    def value(depth):
        kind = rng.random()
        if depth == 0 or kind < 0.4:
            return rng.choice([None, True, False, 0, -12, 1.5, "", "a", 'q"\\ {[:,]} ', "é 語"])
        if kind < 0.7:
            return [value(depth - 1) for _ in range(rng.randrange(4))]
        return {rng.choice("abcdef") * rng.randrange(1, 3): value(depth - 1) for _ in range(rng.randrange(4))}

    values = [value(5) for _ in range(200)]
    rows = [(json.dumps(v, ensure_ascii=False), json.dumps(v, ensure_ascii=False, indent=2)) for v in values]
    rows += [(None, ""), ("", ""), ("{no", "{no"), ("[" + "1," * 30_000 + "2]", "[\n" + "  1,\n" * 30_000 + "  2\n]")]
    got = spark.createDataFrame(rows, "raw string, want string").select("raw", "want", audit.pretty_json(F.col("raw")).alias("got")).collect()
    assert [r["raw"] for r in got if r["got"] != r["want"]] == []


def test_allowed_tags(spark):
    rows = [("<b>x</b>", "<b>x</b>"), ("<B a=1>x</B ><u>y</u>", "<b>x</b>y"), ("a < b & c", "a &lt; b &amp; c"), ("<bold>x</bold>", "x"), (None, None), ("", ""), ("</b>", "</b>"), ("<!-- c -->z", "z")]
    df = spark.createDataFrame(rows, "t string, want string")
    assert df.where(~guards.allow_tags(F.col("t"), ["b", "i"]).eqNullSafe(F.col("want"))).isEmpty()
    assert spark.range(1).select(guards.allow_tags(F.lit("<b>x</b>"), []).alias("x")).first()["x"] == "x"


def test_database_names(spark):
    rows = [("mongodb://h/db?x=1", "db"), ("mongodb://h", "d"), ("mongodb://h/", "d"), (None, "d"), ("", "d"), ("not a uri %%", "d")]
    assert spark.createDataFrame(rows, "u string, want string").where(database_name(F.col("u"), "d") != F.col("want")).isEmpty()
