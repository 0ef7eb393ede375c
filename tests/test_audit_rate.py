import datetime as dt

from pyspark.sql import functions as F

from textshield.config import Config
from textshield.operators import audit
from textshield.sources import io
from textshield.streaming.rate import rate_stream, rate_windows

T0 = dt.datetime(2025, 1, 1, 0, 0, 0)


def at(*seconds):
    return [("k", T0 + dt.timedelta(seconds=s)) for s in seconds]


def test_local_times(spark):
    ts = F.lit("2025-01-01 20:04:05").cast("timestamp")
    assert tuple(spark.range(1).select(audit.local_iso(ts), audit.local_long(ts)).first()) == ("2025-01-02T03:04:05+07:00", "02 Januari 2025 03:04:05 WIB")


def test_windows_open_with_the_first_event(spark):
    df = spark.createDataFrame(at(0, 5, 10, 12, 25), "key string, ts timestamp")
    rows = rate_windows(df, seconds=10, limit=1).orderBy("ts").collect()
    assert [r["count"] for r in rows] == [1, 2, 1, 2, 1] and [r["allowed"] for r in rows] == [True, False, True, False, True]


def test_stream_counts_as_the_batch(spark, tmp_path):
    df = spark.createDataFrame(at(0, 5, 10, 12, 25) + [("j", T0), (None, T0), ("j", None)], "key string, ts timestamp")
    for part in ("ts IS NULL OR second(ts) < 8", "second(ts) >= 8"):  # a file is a micro-batch; windows go on in the next
        df.where(part).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    files = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    stream = rate_stream(files, seconds=11, limit=1)
    q = stream.writeStream.format("memory").queryName("rates").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    try:
        assert q.awaitTermination(120)  # no batches without data go on for ever
    finally:
        q.stop()
    got = sorted(map(tuple, spark.table("rates").collect()))
    assert got == sorted(map(tuple, rate_windows(df, seconds=11, limit=1).collect())) and len(got) == 6


def test_summary_and_latest(spark):
    df = spark.createDataFrame([("r", 1, "a", None), ("r", 2, None, 5), ("r", 3, None, None)], "report_id string, seq int, x string, y int").withColumn("created_at", F.col("seq"))
    assert tuple(audit.upsert_summary(df, ["x", "y"]).first()) == ("r", "a", 5, 1)
    assert audit.latest_per_key(df, "report_id", ["seq"]).first()["seq"] == 3


def test_write_matrix(spark, tmp_path):
    assert audit.writes(Config(store=False, mirror=True)) == {"guarded": False, "forced": True, "mirror": True}
    assert not any(audit.writes(Config(db_disabled=True, mirror=True)).values())
    df = spark.range(3)
    assert not io.append(df, str(tmp_path / "a"), Config(store=False))
    assert io.append(df, str(tmp_path / "a"), Config(store=False), forced=True)
    assert spark.read.parquet(str(tmp_path / "a")).count() == 3
    assert not io.append_mirror(df, str(tmp_path / "m"), Config(mirror=True))


def test_numbers_without_one_task(spark):
    df = spark.range(100).select((F.col("id") * 7 % 100).alias("v"))
    rows = audit.number_rows(df, ["v"], start=5).orderBy("v").collect()
    assert [r["no"] for r in rows] == list(range(6, 106))


def test_requests(spark, tmp_path):
    (tmp_path / "r.json").write_text('{"tenant": "x", "data": "y", "odd": 1}\nno json\n')
    rows = io.read_requests(spark, str(tmp_path / "r.json")).collect()
    assert rows[0]["tenant"] == "x" and rows[0]["raw"].startswith("{") and rows[1]["tenant"] is None


def test_stages_are_written_and_the_hook_runs(spark, tmp_path):
    from textshield.config import Config
    from textshield.plans.pipeline import proofread
    from textshield.sources.io import write_stages

    data = "surat untuk a@b.co.id dikirim hari ini oleh petugas kantor kepada semua orang di sana"
    page = f"<p>{data}</p>"
    rows = [("general", "indonesia", "id", "plain", data, "r1"), ("general", "indonesia", "id", "html", page, "r2")]
    requests = spark.createDataFrame(rows, "type_of_check string, tenant string, locale string, format string, data string, report_id string")
    cfg = Config(reformat=False, mirror=True)
    accepted, _ = proofread(requests, cfg)
    seen = []
    done = write_stages(accepted, str(tmp_path / "s"), cfg, after_final=lambda final: seen.append(final.count()))
    assert seen == [2] and done["after_final"] and all(done.values())
    read = lambda name: spark.read.parquet(str(tmp_path / "s" / name))
    assert {r["report_id"] for r in read("html_freeze").collect()} == {"r2"} and read("html_reverse").first()["html_final"] == page
    assert read("masking").where("message_01 like '%[EMAIL_0]%'").count() == 2
    assert read("final_mirror").columns == ["_id", "report_id", "toc_type", "tenant", "locale", "message_01", "layers", "created_at", "created_at2"]

    def broken(final):
        raise ValueError

    assert write_stages(accepted, str(tmp_path / "t"), Config(reformat=False), after_final=broken)["after_final"] is False
    assert write_stages(accepted, str(tmp_path / "u"), Config(db_disabled=True)) == {}
