"""The stages one by one on a small table with planted cases."""

import importlib.util
import re
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

if importlib.util.find_spec("corpus_pipeline") is None:
    pytest.skip("no corpus_pipeline.py", allow_module_level=True)

import corpus_pipeline


def test_stages(spark, tmp_path):
    source = "/root/testdata/sf0.01"
    base = spark.read.parquet(f"{source}/documents.parquet").limit(120)
    first = base.orderBy("doc_id").first()
    extra = spark.createDataFrame([(5_000_001, first["text"] + "\n", "en", "x", 1), (5_000_002, "key: api_key=ABCDEFGHIJ12 " + "w " * 30, "en", "x", 1), (5_000_003, None, None, None, None), (5_000_003, None, None, None, None)], base.schema)
    base.unionByName(extra).write.parquet(str(tmp_path / "documents.parquet"))
    spark.read.parquet(f"{source}/labels.parquet").write.parquet(str(tmp_path / "labels.parquet"))
    docs = spark.read.parquet(str(tmp_path / "documents.parquet"))
    kept = []
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, str(tmp_path))
        out.write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
        kept.append(docs.select("doc_id"))
        if name != "best_fit_packing":
            assert docs.columns == base.columns
        if name == "exact_dedup":
            assert docs.where("doc_id = 5000003").count() == 1
            assert docs.where(F.col("doc_id").isin(first["doc_id"], 5_000_001)).count() == 1
        if name == "secret_scans":
            assert docs.where("text like '%ABCDEFGHIJ12%'").count() == 0 and docs.where("doc_id = 5000002 and text like '%[SECRET]%'").count() == 1
    for before, after in zip(kept, kept[1:]):
        assert after.join(before, "doc_id", "left_anti").count() == 0
    assert kept[-1].count() >= kept[-2].count() > 50


CLASH = ["score", "predicted", "_text", "_id", "_spans", "_blob", "_key", "_own", "_sha", "row", "own", "own_id", "id", "key", "blob", "spans", "text_sha256", "h", "best", "bytes", "norm", "chain", "bucket", "rank", "task", "fp", "component"]


def test_stages_with_odd_rows_and_clashing_names(spark):
    """Nulls, repeats, empty and very long texts, and columns of every name that is used inside."""
    source = "/root/testdata/sf0.001"
    base = spark.read.parquet(f"{source}/documents.parquet").limit(40)
    secret = "password: ABCDEFGHIJ12"
    odd = [(900_001, None), (900_002, ""), (900_003, " \n\t"), (None, "nobody's words stand here"), (900_004, "x" * 1_000_000), (900_005, f"{secret} " + "long words and more of them " * 40_000), (900_006, "twice the same"), (900_006, "twice the same"), (900_006, "twice  the same "), (900_007, "twice the\tsame")]
    extra = spark.createDataFrame([(i, t, None, None, None) for i, t in odd], base.schema)
    docs = base.unionByName(extra).withColumns({c: F.concat(F.lit(f"{c}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit("-"))) for c in CLASH})
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, source)
        assert out.columns == docs.columns, name
        rows = out.collect()
        assert rows and all(r[c] == f"{c}:{'-' if r['doc_id'] is None else r['doc_id']}" for r in rows for c in CLASH), name
        by = defaultdict(list)
        for r in rows:
            by[r["doc_id"]].append(r["text"])
        if name == "toxicity":
            assert len(rows) >= docs.count() - 5
        if name == "exact_dedup":
            assert by[900_006] == ["twice  the same "] and 900_007 not in by and sum(x in by for x in (900_001, 900_002, 900_003)) == 1
            assert len(rows) == len({re.sub(r"[\x20\x09-\x0D]", "", r["text"] or "") for r in docs.select("text").collect()})
        if name == "simhash_near_dedup":
            assert sum(x in by for x in (900_001, 900_002, 900_003)) == 1 and by[None]
        if name == "secret_scans":
            assert len(rows) == docs.count() and by[900_001] == [None] and by[900_005][0].startswith("[SECRET] long") and len(by[900_004][0]) == 1_000_000
        assert stage(spark, docs.limit(0), source).count() == 0, name
    name, stage = corpus_pipeline.STAGES[-1]
    packed = stage(spark, docs, source)
    assert {r[0] for r in packed.select("doc_id").distinct().collect()} == {r[0] for r in docs.select("doc_id").distinct().collect()}
    assert packed.groupBy("sequence_id").agg(F.sum("length").alias("n")).where("n > 1024").count() == 0
    assert stage(spark, docs.limit(0), source).count() == 0


def test_run_has_the_last_stages_columns(spark):
    out = corpus_pipeline.run(spark, "/root/testdata/sf0.001")
    assert out.columns == ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"] and out.count() > 0
