"""What the classifier catches at its threshold, on held-out rows of the larger table."""

from pyspark.sql import functions as F

from textshield.llm import queries


def test_rates_at_the_threshold(spark):
    sf = "/root/testdata/sf0.1"
    scored = queries.op4_toxicity(spark, sf).where("held_out")
    labels = spark.read.parquet(f"{sf}/labels.parquet").where("toxic is not null")
    caught = {r["toxic"]: (r["hit"], r["n"]) for r in scored.join(labels, "doc_id").groupBy("toxic").agg(F.sum("predicted").alias("hit"), F.count(F.lit(1)).alias("n")).collect()}
    assert caught[1][0] >= 0.4 * caught[1][1]
    assert caught[0][0] <= 0.02 * caught[0][1]
