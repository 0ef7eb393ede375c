"""Very long runs of one kind: no pattern may recurse in Java's matcher, which would end the JVM."""

import time

import pytest
from pyspark.sql import functions as F

from textshield.functions import tables
from textshield.operators import html, masking, reformat, subjects

N = 50_000
LONG = {
    "digits": "1" * N,
    "plus digits": "+" + "62" * N,
    "spaced digits": "62 8" + " 1" * N,
    "dots": "." * N,
    "labels": "x@" + "a." * N,
    "name before at": "a" * N + " x@",
    "spaces": "12 March 2020" + " " * N + "x",
    "names": "Ibu Ana" + " Bea" * N + " datang.",
    "tags": "<p>" + "<b>x</b> " * N + "<table>" + "<tr>" * N + "</table>",
}
PATTERNS = [
    ("e-mail", masking._EMAIL),
    ("card", masking._CARD),
    ("phone", masking._PHONE),
    ("digits", masking._DIGITS),
    ("titled", subjects._TITLED),
    ("table", html._TABLE),
    ("markup", html._MARKUP),
]


@pytest.fixture(scope="module")
def long_texts(spark):
    return spark.createDataFrame(list(LONG.items()), "kind string, text string").repartition(4).cache()


def test_patterns_on_long_texts(long_texts):
    every = [*PATTERNS, *((f"{cat} {i}", f"(?iu){p}") for i, (p, cat) in enumerate(tables.PATTERNS)), *((via, p) for p, _, via in reformat.phone_passes())]
    counts = long_texts.select("kind", *(F.regexp_count("text", F.lit(f"(?U){p}")).alias(f"p{i}") for i, (_, p) in enumerate(every))).collect()
    assert len(counts) == len(LONG)


def test_phone_passes_take_a_long_run_whole(long_texts):
    plus, spaced = [p for p, _, _ in reformat.phone_passes()][:2]
    rows = {r["kind"]: r for r in long_texts.select("kind", F.length(F.regexp_substr("text", F.lit(f"(?U){plus}"))).alias("plus"), F.length(F.regexp_substr("text", F.lit(f"(?U){spaced}"))).alias("spaced")).collect()}
    assert rows["plus digits"]["plus"] == 2 * N + 1
    assert rows["spaced digits"]["spaced"] == 2 * N + 4 and rows["digits"]["spaced"] == N


def test_a_million_characters(spark):
    """No document blocks a job: each function takes all of these in a minute on a small machine."""
    n = 1_000_000
    kinds = ["1" * n, "\n" * n, "." * n, "<b>x</b> " * (n // 9), "1.2.3.4 " * (n // 8), "0812 3456 789, " * (n // 15)]
    df = spark.createDataFrame([(k, "id", "reference_check", len(k)) for k in kinds], "text string, locale string, type_of_check string, n int").repartition(len(kinds)).cache()
    df.count()
    for run in (masking.mask_documents, reformat.reformat_documents, subjects.continue_documents, lambda d: html.freeze_documents(d, "text")):
        out, began = run(df), time.time()
        out.write.format("noop").mode("overwrite").save()
        assert time.time() - began < 60
    df.unpersist()
