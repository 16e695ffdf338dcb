import datetime as dt

from conftest import rows

from pyspark.sql import functions as F

from speechgrain.operators import catalog
from speechgrain.streaming import lifecycle


def choose(spark, events, now=1000, within=600):
    e = spark.createDataFrame([(1, i, s, t, d) for i, (s, t, d) in enumerate(events)], "k long, event_id long, start_s long, end_s long, is_all_day boolean")
    return catalog.select_meeting(e, spark.createDataFrame([(1, now)], "k long, now_s long"), within, "k").select("status", "event_id", "starts_in_s", "ends_in_s", "next_id").first()


def test_meetings(spark):
    assert tuple(choose(spark, [(900, 1900, False), (1100, 1200, False)])) == ("current", 0, None, 900, None)
    assert choose(spark, [(500, 1900, False), (950, 1900, False)]).event_id == 1
    assert tuple(choose(spark, [(1300, 1400, False), (1200, 1250, None), (1450, 1500, False)])) == ("upcoming", 1, 200, None, 0)
    assert tuple(choose(spark, [(0, 9999, True), (2000, 2100, False)])) == (None, None, None, None, 1)
    assert choose(spark, [(900, 1000, False)]).status is None


def test_timeouts(spark):
    f = spark.createDataFrame([(1, 10.0), (2, 600.0), (2, 30.0), (3, None)], "session_id long, duration_s double")
    assert [r.timeout_s for r in catalog.timeouts(f).orderBy("session_id").collect()] == [1800.0, 2700.0, 1800.0]
    assert f.select(catalog.transcription_timeout(F.lit(600.0), F.lit(42.0))).first()[0] == 42.0


def test_audio_order_and_growth(spark):
    f = spark.createDataFrame([(1, "z.wav", 99), (1, "mic.wav", 99), (1, "mixed.wav", 99), (1, "a.wav", 44)], "session_id long, name string, length long")
    assert catalog.audio_order(f).first().audio_files == ["mixed.wav", "mic.wav", "z.wav"]
    a = spark.createDataFrame([("x", 1), ("y", 2), ("w", 5)], "path string, length long")
    b = spark.createDataFrame([("x", 1), ("y", 3), ("v", 5)], "path string, length long")
    assert [r.path for r in catalog.growing(a, b).orderBy("path").collect()] == ["v", "w", "y"]


def test_resume(spark):
    s = spark.createDataFrame([(1, "transcribing", True, True, False), (2, "transcribing", False, True, False), (3, "transcribing", False, False, True), (4, "transcribing", False, False, False), (5, "stopped", False, True, True)], "session_id long, status string, alive boolean, staged_valid boolean, legacy_valid boolean").withColumns({"legacy_at": F.lit("2"), "started_at": F.lit("1")})
    assert [r.action for r in catalog.resume_action(s).orderBy("session_id").collect()] == ["wait", "finalize", "accept_legacy", "mark_interrupted", "none"]


def test_scheduled_start(spark):
    df = spark.createDataFrame([("09:30",), ("8:15:30",), ("07:00",), ("2026-08-13T10:00:00Z",), ("x",)], "t string")
    now = F.to_timestamp(F.lit("2026-08-12 08:00:00"))
    got = [r[0] for r in df.select(F.date_format(catalog.scheduled_start(F.col("t"), now), "dd HH:mm:ss")).collect()]
    assert got == ["12 09:30:00", "12 08:15:30", None, "13 10:00:00", None]


EVENTS = "session_id long, event_id long, at timestamp, status string, start_at timestamp"


def ts(s):
    return dt.datetime(2026, 1, 1, tzinfo=dt.timezone.utc) + dt.timedelta(seconds=s)


def test_stream_equals_batch_and_cancels_late_starts(spark, tmp_path):
    batches = [[(1, 1, ts(0), "scheduled", ts(60)), (2, 2, ts(0), "scheduled", ts(60)), (3, 3, ts(5), "recording", None)], [(2, 4, ts(70), "recording", None)], [(3, 5, ts(4000), "stopped", None)], [(3, 6, ts(4001), "transcribing", None)]]
    for k, b in enumerate(batches):
        spark.createDataFrame(b, EVENTS).coalesce(1).write.parquet(str(tmp_path / f"in/{k}"))
    source = spark.readStream.schema(EVENTS).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(str(tmp_path / "in"))
    seen = []
    job = lifecycle.watch(source, lateness="1 second").writeStream.foreachBatch(lambda d, n: seen.extend(map(tuple, d.select("session_id", "status").collect()))).option("checkpointLocation", str(tmp_path / "log")).trigger(availableNow=True).start()
    job.awaitTermination()
    assert (1, "scheduled_cancelled") in seen and (2, "scheduled_cancelled") not in seen
    assert [s for k, s in seen if k == 2] == ["scheduled", "recording"]
    plain = spark.readStream.schema(EVENTS).option("recursiveFileLookup", "true").parquet(str(tmp_path / "in")).select("session_id", "event_id", "status", F.unix_millis("at").alias("at_ms"))
    batch = spark.read.schema(EVENTS).option("recursiveFileLookup", "true").parquet(str(tmp_path / "in")).select("session_id", "event_id", "status", F.unix_millis("at").alias("at_ms"))
    assert rows(lifecycle.run_to_end(lifecycle.fold(plain), spark), "session_id") == rows(catalog.fold_status(batch), "session_id")
    late = catalog.expire_scheduled(catalog.fold_status(batch), F.lit(1767225600000 + 200_000))
    assert [r.status for r in late.orderBy("session_id").collect()] == ["scheduled_cancelled", "recording", "transcribing"]
