"""Rate windows as value state, stored tables updated in place, stages as a stream."""

import datetime as dt
import os
import random

import pytest
from pyspark.sql import functions as F

from textshield.config import Config
from textshield.operators import audit
from textshield.sources import store
from textshield.streaming import stages
from textshield.streaming.rate import rate_state, rate_windows

T0 = dt.datetime(2025, 1, 1)


@pytest.fixture(scope="module")
def rocks(spark):
    # state that lapses by the clock asks for batches without data, for ever
    wanted = {"stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider", "noDataMicroBatches.enabled": "false"}
    for k, v in wanted.items():
        spark.conf.set(f"spark.sql.streaming.{k}", v)
    spark.conf.set("spark.sql.shuffle.partitions", "2")
    yield spark
    for k in wanted:
        spark.conf.unset(f"spark.sql.streaming.{k}")
    spark.conf.set("spark.sql.shuffle.partitions", "4")


def run(stream, tmp_path, mode="append"):
    q = stream.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "cp")).outputMode(mode).trigger(availableNow=True).start()
    try:
        assert q.awaitTermination(150)
    finally:
        q.stop()


@pytest.mark.parametrize("options", [{"ttl_seconds": 3600}, {"lateness": "10 minutes"}])
def test_state_counts_as_the_batch_does(rocks, tmp_path, options):
    """Several micro-batches, and a restart from the checkpoint half way."""
    rng = random.Random(4)
    rows = sorted([(rng.choice("abc"), T0 + dt.timedelta(seconds=rng.randrange(600))) for _ in range(120)], key=lambda r: r[1])
    schema = "key string, ts timestamp"
    folder = str(tmp_path / "in")
    for half in range(2):
        for part in range(2):
            at = (half * 2 + part) * 30
            rocks.createDataFrame(rows[at : at + 30], schema).coalesce(1).write.mode("append").parquet(folder)
            files = rocks.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(folder)
        run(rate_state(files, seconds=60, limit=3, **options), tmp_path)
    got = sorted(map(tuple, rocks.read.parquet(str(tmp_path / "out")).collect()))
    want = sorted(map(tuple, rate_windows(rocks.createDataFrame(rows, schema), seconds=60, limit=3).collect()))
    assert got == want and len(got) == 120


def test_late_events_by_policy(rocks, tmp_path):
    schema = "key string, ts timestamp"
    batches = [[("a", T0 + dt.timedelta(seconds=300))], [("a", T0), ("a", T0 + dt.timedelta(seconds=310))]]
    for late, want in (("count", {(300, 1), (0, 2), (310, 3)}), ("reject", {(300, 1), (0, 0), (310, 2)})):
        folder = tmp_path / late
        for rows in batches:
            rocks.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(folder / "in"))
            run(rate_state(rocks.readStream.schema(schema).parquet(str(folder / "in")), seconds=60, ttl_seconds=3600, late=late), folder)
        got = {(int((r["ts"] - T0).total_seconds()), r["count"]) for r in rocks.read.parquet(str(folder / "out")).collect()}
        assert got == want
    with pytest.raises(ValueError):
        rate_state(rocks.createDataFrame([], schema), late="drop")


# --- stored tables ------------------------------------------------------------


def _rows(spark, rows):
    return spark.createDataFrame(rows, "report_id string, seq long, a string, b double, created_at long")


def _files(path):
    return {os.path.join(d, f): os.path.getmtime(os.path.join(d, f)) for d, _, names in os.walk(path) for f in names if f.endswith(".parquet")}


def test_upserts_equal_one(spark, tmp_path):
    rng = random.Random(2)
    rows = [(f"r{rng.randrange(40)}", i, rng.choice([None, f"v{i}"]), rng.choice([None, float(i)]), 1000 + i) for i in range(300)]
    rng.shuffle(rows)
    path = str(tmp_path / "t")
    for part in (rows[:100], rows[100:110], [], rows[110:], rows[50:120]):  # the last is a replay
        store.upsert(_rows(spark, part), path, ["a", "b"], buckets=16)
    got = sorted(map(tuple, store.stored_rows(spark, path, ["a", "b"]).collect()))
    assert got == sorted(map(tuple, audit.upsert_summary(_rows(spark, rows), ["a", "b"]).collect()))


def test_only_touched_buckets_change(spark, tmp_path):
    path = str(tmp_path / "t")
    store.upsert(_rows(spark, [(f"r{i}", 1, "x", None, 5) for i in range(200)]), path, ["a", "b"], buckets=32)
    before = _files(path)
    touched = store.upsert(_rows(spark, [("r7", 2, "y", 1.5, 9), ("new", 2, None, 2.5, 9), (None, 3, "z", 1.0, 9)]), path, ["a", "b"], buckets=32)
    after = _files(path)
    assert 1 <= len(touched) <= 2
    changed = {f for f in before.keys() ^ after.keys()}
    assert {int(f.split(f"{store.BUCKET}=")[1].split("/")[0]) for f in changed} == set(touched)
    assert all(after[f] == before[f] for f in before.keys() & after.keys())
    rows = {r["report_id"]: r for r in store.stored_rows(spark, path, ["a", "b"]).collect()}
    assert len(rows) == 201 and tuple(rows["r7"])[1:] == ("y", 1.5, 5) and tuple(rows["new"])[1:] == (None, 2.5, 9)


# --- stages as a stream ---------------------------------------------------------


def _requests(spark, k):
    body = "tulis surat ke u%d@contoh.co.id untuk keterangan yang lebih lengkap tentang laporan ini segera" % k
    page = f"<p>{body}</p><table><tr><td>{k}</td></tr></table>"
    rows = [("general", "indonesia", "id", "plain", body, f"p{k}"), ("general", "indonesia", "id", "html", page, f"h{k}"), ("general", "mars", "id", "plain", body, f"x{k}")]
    return spark.createDataFrame(rows, "type_of_check string, tenant string, locale string, format string, data string, report_id string")


def test_stages_of_a_stream(spark, tmp_path):
    source, out = str(tmp_path / "in"), str(tmp_path / "out")
    cfg = Config(reformat=False, mirror=True)
    now = F.timestamp_seconds(F.lit(0))
    seen = []

    def count(rows, batch):
        seen.append((batch, rows.count()))

    def broken(rows, batch):
        raise RuntimeError("hook")

    for k in range(2):
        _requests(spark, k).coalesce(1).write.mode("append").json(source)
        stream = spark.readStream.schema(_requests(spark, 0).schema).json(source)
        q = stages.stream_stages(stream, out, str(tmp_path / "cp"), cfg, now, hooks=[broken, count])
        assert q.awaitTermination(240)
    assert seen == [(0, 2), (1, 2)]
    final = stages.read_stage(spark, out, "final").select("report_id", "message_final").orderBy("report_id").collect()
    assert [r["report_id"] for r in final] == ["h0", "h1", "p0", "p1"] and "u1@contoh.co.id" in final[3]["message_final"]
    pages = stages.read_stage(spark, out, "html_reverse").orderBy("report_id").collect()
    assert [r["report_id"] for r in pages] == ["h0", "h1"] and pages[0]["html_final"].endswith("<table><tr><td>0</td></tr></table>")
    assert stages.read_stage(spark, out, "html_freeze").first()["table_map"] is not None
    rejected = stages.read_stage(spark, out, "rejected")
    assert {(r["report_id"], r["error"]["error"]) for r in rejected.collect()} == {("x0", "UNSUPPORTED_TENANT"), ("x1", "UNSUPPORTED_TENANT")}
    counts = {name: stages.read_stage(spark, out, name).count() for name in os.listdir(out)}
    # a batch that runs again leaves everything as it is
    stages.write_batch(_requests(spark, 1), 1, out, cfg, now)
    assert {name: stages.read_stage(spark, out, name).count() for name in os.listdir(out)} == counts
    assert stages.write_batch(_requests(spark, 1), 2, out, Config(store=False), now) == {}
