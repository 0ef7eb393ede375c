"""Models on executors: loaded once a worker, batches by size, failures kept to their row."""

import os
import re
import uuid

from pyspark.sql import functions as F

from textshield.operators import backends, masking, models


def tagger(folder):
    def load():
        with open(os.path.join(folder, f"{os.getpid()}-{uuid.uuid4().hex}"), "w"):
            pass

        def model(texts):
            if any("boom" in t for t in texts):
                raise RuntimeError("no")
            return [[(m.start(), m.end(), "LOC") for m in re.finditer("Jakarta|Bandung", t)] for t in texts]

        return model

    return load


def test_loaded_once_in_each_worker(spark, tmp_path):
    df = spark.range(400).select("id", F.concat(F.lit("in Jakarta and Bandung "), F.col("id")).alias("text")).repartition(16)
    name = f"t-{uuid.uuid4().hex}"
    for _ in range(2):  # workers stay for the next query
        assert models.tag_documents(df, name, tagger(str(tmp_path)), most_rows=7).where("size(spans) = 2").count() == 400
    pids = [f.split("-")[0] for f in os.listdir(tmp_path)]
    assert pids and len(pids) == len(set(pids))


def test_a_bad_text_costs_itself_only(spark, tmp_path):
    rows = [(i, "boom Jakarta" if i % 10 == 3 else "at Jakarta") for i in range(50)] + [(50, None), (51, "")]
    df = spark.createDataFrame(rows, "id int, text string")
    got = {r["id"]: r for r in models.tag_documents(df, f"t-{uuid.uuid4().hex}", tagger(str(tmp_path))).collect()}
    assert len(got) == 52
    for i, text in rows:
        if text is None:
            assert got[i]["spans"] is None and got[i]["tag_error"] is None
        elif "boom" in text:
            assert got[i]["spans"] is None and got[i]["tag_error"] == "RuntimeError: no"
        else:
            assert [tuple(s) for s in got[i]["spans"]] == ([(3, 10, "LOC", "Jakarta")] if text else []) and got[i]["tag_error"] is None


def test_windows_of_long_texts(spark, tmp_path):
    text = "x Jakarta " * 700
    df = spark.createDataFrame([(text,)], "text string")
    spans = models.tag_documents(df, f"t-{uuid.uuid4().hex}", tagger(str(tmp_path)), most=100, overlap=10).first()["spans"]
    assert [s["st"] for s in spans] == [m.start() for m in re.finditer("Jakarta", text)]
    assert all(text[s["st"] : s["en"]] == s["val"] for s in spans)
    assert models.word_windows("") == [] and models.word_windows(" a b ") == [(1, "a b")]
    assert [w for _, w in models.word_windows("a b c d e", 3, 1)] == ["a b c", "c d e"]


def test_batches_by_size():
    texts = ["a" * 10] * 5 + ["b" * 500] + ["c"] * 3
    groups = list(models._groups(texts, 3, 100))
    assert [len(g) for g in groups] == [3, 2, 1, 3] and sum(groups, []) == list(range(9))


def test_masking_by_a_model(spark, tmp_path):
    df = spark.createDataFrame([(1, "Call [EMAIL_0] in Jakarta or Bandung"), (2, "boom in Jakarta")], "id int, text string").withColumn("_m", masking.empty_state(F.col("text")))
    got = models.mask_names(df, f"t-{uuid.uuid4().hex}", tagger(str(tmp_path))).orderBy("id").collect()
    assert got[0]["_m"]["text"] == "Call [EMAIL_0] in [LOC_0] or [LOC_1]" and got[0]["tag_error"] is None
    assert got[1]["_m"]["text"] == "boom in Jakarta" and got[1]["tag_error"] is not None


def test_rewriter_and_fallback(spark):
    """A rewrite that loses a token, one that fails and a good one."""

    def load():
        def model(texts):
            if any("fail" in t for t in texts):
                raise ValueError("down")
            return [t.replace("[EMAIL_0]", "") if "lose" in t else t.upper().replace("TO", "for") for t in texts]

        return model

    df = spark.createDataFrame([(1, "lose [EMAIL_0]"), (2, "fail [EMAIL_0]"), (3, "to [EMAIL_0]"), (4, None)], "id int, masked string")
    got = {r["id"]: (r["message_02"], r["token_ok"]) for r in backends.rewrite(df, rewriter=models.rewriter(f"r-{uuid.uuid4().hex}", load)).collect()}
    assert got == {1: ("lose [EMAIL_0]", False), 2: ("fail [EMAIL_0]", False), 3: ("for [EMAIL_0]", True), 4: (None, False)}
