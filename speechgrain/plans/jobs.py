"""Named queries that write and read again: conversion, WAV files, transcribing, kept audits, streams. Each stands beside its SQL."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from speechgrain.operators import resample, speakers, transcribing
from speechgrain.plans import datasets as D
from speechgrain.plans.oracle import SEG, SMP, audit
from speechgrain.sources import wav
from speechgrain.sources.audits import AuditStore
from speechgrain.sources.files import shared_folder
from speechgrain.streaming import detection, lifecycle, recording, windows

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def query(sql: str | None) -> Callable[[Query], Query]:
    def keep(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return keep


def folder(spark: SparkSession, name: str) -> str:
    """A new folder in the shared one."""
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


# --- conversion --------------------------------------------------------------------------------------------------------


def _polyphase_sql(source: int, target: int, zeros: int = resample.ZEROS) -> str:
    """The filter written out: a row per output and sample in reach, weighed by the windowed sinc and divided by the weights' sum."""
    wide = max(source, target)  # the rates have no common divisor here
    half, cut = zeros * wide, (0.5 - resample.SLOPE / (4 * zeros)) / wide
    reach = -(-half // target)
    return f"""
WITH {SMP}, n AS (SELECT track, max(idx) + 1 AS n FROM smp GROUP BY track),
o AS (SELECT track, unnest(range(0, (n * {target} + {source} - 1) // {source})) AS m FROM n),
k AS (SELECT track, m, m * {source} // {target} + d AS i, m * {source} - (m * {source} // {target} + d) * {target} AS t FROM o, (SELECT unnest(range(-{reach}, {reach} + 1)) AS d)),
w AS (
  SELECT *, CASE WHEN t = 0 THEN 1.0 ELSE sin(pi() * {2 * cut!r}::DOUBLE * t) / (pi() * {2 * cut!r}::DOUBLE * t) END
            * (0.42::DOUBLE + 0.5::DOUBLE * cos(pi() * t / {half}) + 0.08::DOUBLE * cos(2 * pi() * t / {half})) AS w
  FROM k WHERE abs(t) < {half})
SELECT w.track, m AS idx, round(sum(w * coalesce(value, 0)) / sum(w), 4) + 0.0 AS value
FROM w LEFT JOIN smp ON smp.track = w.track AND smp.idx = i GROUP BY w.track, m"""


@query(_polyphase_sql(3, 2))
def polyphase_tracks(spark, sf):
    """Tracks at two thirds of their rate, in blocks of 128 samples."""
    out = resample.polyphase_rows(D.samples(spark, sf).select("track", "idx", "value"), 3, 2, block=128)
    return out.select("track", "idx", (F.round("value", 4) + 0.0).alias("value"))


# --- recordings --------------------------------------------------------------------------------------------------------


def as_recordings(samples: DataFrame, keys: list[str]) -> DataFrame:
    """Samples as recordings of two a second: every second track has two channels, by turns."""
    lists = samples.groupBy(*keys, "track").agg(F.array_sort(F.collect_list(F.struct("idx", "value"))).alias("_s"))
    return lists.select(*keys, "track", F.lit(2).cast("long").alias("sample_rate"), F.when(F.col("track") % 2 == 0, 2).otherwise(1).alias("channels"), F.lit(16).alias("bit_depth"), F.col("_s.value").cast("array<int>").alias("samples"))


@query(f"""
WITH {SMP}, f AS (SELECT track, count(*) AS n, max(abs(value)) AS peak, CASE WHEN track % 2 = 0 THEN 2 ELSE 1 END AS channels FROM smp GROUP BY track)
SELECT track, 2::BIGINT AS sample_rate, channels, 2 AS sample_width, n // channels AS frame_count, (n // channels) / 2.0::DOUBLE AS duration_s, false AS normalized, n::BIGINT AS samples, peak FROM f""")
def wav_figures(spark, sf):
    """Tracks written as WAV files: the figures of their heads, and the samples that are read back."""
    at = folder(spark, "wavs")
    wav.register(spark)
    made = as_recordings(D.samples(spark, sf), [])
    made.select(F.concat(F.col("track").cast("string"), F.lit(".wav")).alias("path"), *made.columns[1:]).write.format("wav").mode("append").save(at)
    track = F.regexp_extract("path", r"([0-9]+)\.wav$", 1).cast("long").alias("track")
    heads = wav.is_normalized(wav.probe(wav.merged(wav.list_wavs(spark, at).select("path", "length")))).select(track, "sample_rate", "channels", "sample_width", "frame_count", "duration_s", "normalized")
    read = wav.read_wavs(spark, at).select(track, F.size("samples").cast("long").alias("samples"), F.array_max(F.transform("samples", F.abs)).cast("long").alias("peak"))
    return heads.join(read, "track")


CELL_MS, LOUD = 2_000, 9_000
SHORT = {"target": 2, "trigger_ms": 30_000, "length_ms": 20_000, "overlap_ms": 4_000, "exact": True}


def hearing(broken: Column) -> transcribing.Recognise:
    """A hook in place of a model: every stretch of two seconds with a loud sample is a segment. Odd pieces fail off the CPU, ``broken`` ones everywhere."""

    def recognise(part: DataFrame, device: str) -> DataFrame:
        fault = F.when(broken, "unreadable audio").when(F.lit(device != "cpu") & (F.col("chunk_idx") % 2 == 1), "out of memory")
        each = part.select(*transcribing.PIECE, "chunk_start_ms", fault.alias("error"), "sample_rate", F.posexplode("samples").alias("at", "value"))
        cell = F.when(F.col("error").isNull(), F.floor(F.col("at") * 1000 / F.col("sample_rate") / CELL_MS)).alias("seg_idx")
        heard = each.groupBy(*transcribing.PIECE, "chunk_start_ms", "error", cell).agg(F.max(F.abs("value")).alias("peak")).where((F.col("peak") >= LOUD) | F.col("error").isNotNull())
        number = F.col("seg_idx") + F.floor(F.col("chunk_start_ms") / CELL_MS)
        text = F.concat(F.lit(" sound "), number.cast("string"), F.lit(" of "), F.col("peak").cast("string"))
        seconds = lambda k: F.col("seg_idx") * (CELL_MS / 1000.0) + k * CELL_MS / 1000.0
        return heard.select(*transcribing.PIECE, "chunk_start_ms", "seg_idx", seconds(0).alias("start"), seconds(1).cast("string").alias("end"), F.lit(None).cast("string").alias("speaker"), F.when(F.col("error").isNull(), text).alias("text"), "error")

    return recognise


def _heard_sql(keys: str) -> str:
    """Loud stretches of the recordings of ``s(keys, track, idx, value)``: what pieces that overlap have to come to."""
    return f"""
fr AS (
  SELECT {keys}, track, idx // 2 AS i, floor(sum(value) / 2.0)::BIGINT AS value FROM s WHERE track % 2 = 0 GROUP BY {keys}, track, idx // 2 HAVING count(*) = 2
  UNION ALL SELECT {keys}, track, idx, value FROM s WHERE track % 2 <> 0),
ce AS (SELECT {keys}, track, i * 500 // {CELL_MS} AS cell, max(abs(value)) AS peak FROM fr GROUP BY ALL HAVING max(abs(value)) >= {LOUD})"""


@query(f"""
WITH {SMP}, s AS (SELECT 0 AS k, track, idx, value FROM smp), {_heard_sql("k")},
d AS (SELECT track, (count(*) // CASE WHEN track % 2 = 0 THEN 2 ELSE 1 END) * 500 AS duration_ms FROM smp GROUP BY track),
t AS (SELECT track, count(*) AS n, string_agg('sound ' || cell || ' of ' || peak, chr(10) || chr(10) ORDER BY cell) AS text FROM ce GROUP BY track)
SELECT track, CASE WHEN track % 17 <> 3 THEN duration_ms END::BIGINT AS duration_ms, CASE WHEN track % 17 <> 3 THEN duration_ms >= 30000 END AS chunked,
       CASE WHEN track % 17 <> 3 THEN coalesce(n, 0) END::BIGINT AS segments, CASE WHEN track % 17 <> 3 THEN coalesce(text, '') END AS text, CASE WHEN track % 17 = 3 AND duration_ms > 0 THEN 'unreadable audio' END AS error
FROM d LEFT JOIN t USING (track)""")
def transcribed_recordings(spark, sf):
    """Tracks as recordings, transcribed: converted to one channel, cut into pieces, heard by a hook, put together without duplicates."""
    recordings = as_recordings(D.samples(spark, sf), []).withColumn("path", F.col("track").cast("string"))
    done = transcribing.transcribe(recordings, hearing(F.col("path").cast("long") % 17 == 3), **SHORT)
    out = done["documents"].select("path", "duration_ms", "chunked", "segments", "text", F.lit(None).cast("string").alias("error")).unionByName(done["failed"], allowMissingColumns=True)
    return out.select(F.col("path").cast("long").alias("track"), "duration_ms", "chunked", "segments", "text", "error")


@query(f"""
WITH {SMP},
s AS (SELECT CASE WHEN event_id % 2 = 0 THEN 'mic' ELSE 'system' END AS source, track, row_number() OVER (PARTITION BY track, event_id % 2 ORDER BY event_id) - 1 AS idx, value FROM smp),
{_heard_sql("source")},
gone AS (SELECT DISTINCT track FROM s WHERE track % 17 = 3 AND source = 'system' AND NOT (track % 2 = 0 AND idx = 0)),
v AS (SELECT *, (cell + track) % 3 AS voice FROM ce WHERE track NOT IN (SELECT track FROM gone)),
o AS (SELECT track, source, voice, row_number() OVER (PARTITION BY track, source ORDER BY min(cell)) - 1 AS k FROM v GROUP BY track, source, voice),
m AS (SELECT track, count(DISTINCT voice) AS k0 FROM v WHERE source = 'mic' GROUP BY track)
SELECT track AS session_id, source, row_number() OVER (PARTITION BY track ORDER BY cell, source) AS position, (k + CASE WHEN source = 'system' THEN coalesce(k0, 0) ELSE 0 END)::VARCHAR AS speaker_id,
       cell * {CELL_MS} AS start_ms, (cell + 1) * {CELL_MS} AS end_ms, 'sound ' || cell || ' of ' || peak AS text
FROM v JOIN o USING (track, source, voice) LEFT JOIN m USING (track)""")
def transcribed_meetings(spark, sf):
    """Users as meetings of two tracks: both transcribed and diarised, speakers numbered through, tracks merged by time."""
    s = D.samples(spark, sf).withColumn("source", F.when(F.col("event_id") % 2 == 0, "mic").otherwise("system"))
    s = s.withColumn("idx", F.row_number().over(Window.partitionBy("track", "source").orderBy("event_id")).cast("long") - 1)
    part = lambda c: F.get_json_object("path", f"$.{c}")
    broken = (part("session_id").cast("long") % 17 == 3) & (part("source") == "system")
    voice = (F.floor(F.col("start_ms") / CELL_MS) + F.col("session_id")) % 3
    embed = lambda asked: asked.withColumn("embedding", F.array(*[F.when(voice == k, 1.0).otherwise(0.0) for k in range(3)]))
    done = transcribing.meeting(as_recordings(s, ["source"]).withColumnRenamed("track", "session_id"), hearing(broken), embed, **SHORT)
    return done["segments"].select("session_id", "source", "position", "speaker_id", "start_ms", "end_ms", "text")


# --- kept audits -------------------------------------------------------------------------------------------------------


def earlier_segments(spark, sf) -> DataFrame:
    """Segments as of an earlier day: in every fifth session a speaker has another name, every seventh isn't there yet, and some are since gone."""
    s = D.seg(spark, sf).where("session_id % 7 <> 3").withColumn("speaker_id", F.when((F.col("session_id") % 5 == 0) & (F.col("speaker_id") == "click"), "tap").otherwise(F.col("speaker_id")))
    return s.unionByName(s.where("session_id % 11 = 1").withColumn("session_id", -1 - F.col("session_id")))


@query(f"""
WITH {SEG}, {audit()}, again AS (SELECT session_id, bool_or(session_id % 7 = 3 OR session_id % 5 = 0 AND speaker_id = 'click') AS a FROM seg GROUP BY ALL)
SELECT session_id, speaker_id, segments, useful_speech_ms, span_ms, status, safe, CASE WHEN a THEN 2 ELSE 1 END::BIGINT AS run
FROM final JOIN again USING (session_id)""")
def kept_audits(spark, sf):
    """Audits of an earlier state of the segments, brought up to date with the present one, and which run made each."""
    store = AuditStore(spark, folder(spark, "audits"))
    for segments in (earlier_segments(spark, sf), D.seg(spark, sf)):
        store.update(segments, lambda s: speakers.audit(s).drop("reasons", "recommendation"), {"min_useful_ms": speakers.MIN_USEFUL_MS, "ratio": speakers.MIXED_RATIO})
    return store.read().select("session_id", "speaker_id", "segments", "useful_speech_ms", "span_ms", "status", "safe", "run")


# --- streams of recordings ---------------------------------------------------------------------------------------------


@query(f"WITH {SMP} SELECT track, count(*)::BIGINT AS frames, count(*) FILTER (value <> 0)::BIGINT AS non_zero, max(least(abs(value), 32767)) AS peak FROM smp GROUP BY track")
def recorded_streams(spark, sf):
    """Tracks streamed into WAV files in several batches, and the growing files read back as a stream of running figures."""
    blocks, wavs = folder(spark, "blocks"), folder(spark, "wavs")
    numbered = D.samples(spark, sf).withColumn("first_frame", F.floor(F.col("idx") / 64) * 64).groupBy("track", "first_frame").agg(F.array_sort(F.collect_list(F.struct("idx", "value"))).alias("_s"))
    rows = numbered.select(F.concat("track", F.lit(".wav")).alias("path"), F.lit(16_000).cast("long").alias("sample_rate"), F.lit(1).alias("channels"), F.col("first_frame").cast("long").alias("first_frame"), F.col("_s.value").cast("array<int>").alias("samples"))
    rows.repartitionByRange(3, "first_frame").write.parquet(blocks)
    recording.register(spark)
    stream = spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).parquet(blocks)
    recording.record(stream, wavs, f"{wavs}-log").awaitTermination()
    heard = recording.listen(spark, wavs)
    figures = heard.select(F.regexp_extract("path", r"([0-9]+)\.wav$", 1).cast("long").alias("session_id"), F.explode("samples").alias("value"))
    figures = figures.groupBy("session_id").agg(F.count("*").alias("frames"), F.count_if(F.col("value") != 0).alias("non_zero"), F.max(F.least(F.abs("value"), F.lit(32767))).cast("long").alias("peak"))
    return lifecycle.run_to_end(figures, spark).withColumnRenamed("session_id", "track")


# --- streams of events -------------------------------------------------------------------------------------------------


def in_order(spark, at: str) -> None:
    """Give the files of a table times in the order of their names, which streams take them by; a file that is written later comes last."""
    path = spark._jvm.org.apache.hadoop.fs.Path(at)
    files = path.getFileSystem(spark._jsc.hadoopConfiguration())
    found = sorted((f.getPath().getName(), f.getModificationTime()) for f in files.listStatus(path) if f.getPath().getName().endswith(".parquet"))
    first = min(t for _, t in found) - 1000 * len(found)
    for k, (name, _) in enumerate(found):
        files.setTimes(spark._jvm.org.apache.hadoop.fs.Path(f"{at}/{name}"), first + 1000 * k, -1)


def replayed(spark, sf, parts: int = 4) -> DataFrame:
    """The stored events as a stream of ``parts`` files in order of time, a file a batch, and a last one that only moves time on."""
    at = folder(spark, "replay")
    e = D.table(spark, sf, "events").select(F.col("user_id").alias("session_id"), "event_id", F.to_timestamp_ltz(F.col("ts").cast("timestamp_ntz")).alias("at"), "event_type", "value")
    e.repartitionByRange(parts, "at", "event_id").sortWithinPartitions("at", "event_id").write.parquet(at)
    in_order(spark, at)
    last = e.agg((F.max("at") + F.expr("INTERVAL 30 DAYS")).alias("at")).select(F.lit(None).cast("long").alias("session_id"), F.lit(None).cast("long").alias("event_id"), "at", F.lit("end").alias("event_type"), F.lit(None).cast("double").alias("value"))
    last.coalesce(1).write.mode("append").parquet(at)
    return spark.readStream.schema(spark.read.parquet(at).schema).option("maxFilesPerTrigger", 1).option("latestFirst", "false").parquet(at)


def to_table(stream: DataFrame, spark) -> DataFrame:
    """The rows that an append-mode stream emits until its input is used up."""
    at = folder(spark, "emitted")
    stream.writeStream.format("parquet").option("path", f"{at}/rows").option("checkpointLocation", f"{at}/log").outputMode("append").trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{at}/rows")


MS = "(epoch_us(ts) // 1000)::BIGINT"


@query(f"""
WITH e AS (SELECT user_id AS session_id, event_id, {MS} AS at_ms, event_type IN ('click', 'view') AS p FROM events),
r AS (SELECT *, row_number() OVER w - row_number() OVER (PARTITION BY session_id, p ORDER BY at_ms, event_id) AS island FROM e WINDOW w AS (PARTITION BY session_id ORDER BY at_ms, event_id)),
k AS (SELECT *, row_number() OVER (PARTITION BY session_id, p, island ORDER BY at_ms, event_id) AS n FROM r),
s AS (SELECT session_id, event_id, at_ms, p FROM k WHERE n = CASE WHEN p THEN 3 ELSE 2 END),
t AS (SELECT *, coalesce(lag(p) OVER (PARTITION BY session_id ORDER BY at_ms, event_id), false) AS before FROM s)
SELECT session_id, at_ms, p AS active FROM t WHERE p <> before""")
def debounced_detection(spark, sf):
    """When each session is found active and inactive again, by three positive polls and two negative ones, over a stream of events."""
    polls = replayed(spark, sf).select(F.coalesce("session_id", F.lit(-1)).alias("session_id"), F.coalesce("event_id", F.lit(-1)).alias("poll_id"), "at", F.col("event_type").isin("click", "view").alias("positive"))
    with detection.rocks(spark):
        found = to_table(detection.debounce(polls), spark)
    return found.where("session_id >= 0").select("session_id", "at_ms", "active")


@query(f"""
WITH e AS (SELECT user_id AS session_id, {MS} AS at_ms, value FROM events),
b AS (SELECT *, CASE WHEN at_ms - lag(at_ms) OVER w < 21600000 THEN 0 ELSE 1 END AS begins FROM e WINDOW w AS (PARTITION BY session_id ORDER BY at_ms)),
g AS (SELECT *, sum(begins) OVER (PARTITION BY session_id ORDER BY at_ms ROWS UNBOUNDED PRECEDING) AS island FROM b)
SELECT session_id, min(at_ms)::BIGINT AS start_ms, (max(at_ms) + 21600000)::BIGINT AS end_ms, count(*)::BIGINT AS n, round(max(value), 4) AS most FROM g GROUP BY session_id, island""")
def activity_windows(spark, sf):
    """Stretches of a session's events without a pause of six hours, as event-time windows of a stream."""
    found = windows.activity(replayed(spark, sf).withColumn("at", F.date_trunc("MILLISECOND", "at")), "6 hours", F.max("value").alias("most"))
    return to_table(found, spark).where("session_id is not null").select("session_id", "start_ms", "end_ms", "n", F.round("most", 4).alias("most"))


@query(f"""
WITH e AS (SELECT user_id AS session_id, event_id, {MS} AS at_ms FROM events)
SELECT a.session_id, a.event_id AS left_id, b.event_id AS right_id, (b.at_ms - a.at_ms)::BIGINT AS after_ms
FROM e a JOIN e b ON a.session_id = b.session_id AND a.event_id % 2 = 0 AND b.event_id % 2 = 1 AND b.at_ms BETWEEN a.at_ms - 3600000 AND a.at_ms + 3600000""")
def track_pairs(spark, sf):
    """Events of two tracks of a session within an hour of each other, by a join of two streams."""
    e = replayed(spark, sf).where("session_id is not null").select("session_id", "event_id", F.date_trunc("MILLISECOND", "at").alias("at"))
    out = windows.paired(e.where("event_id % 2 = 0"), e.where("event_id % 2 = 1"), "event_id", 3600)
    return to_table(out, spark)


@query(f"""
WITH o AS (SELECT o_orderkey AS session_id, o_orderdate::TIMESTAMP AS d, o_orderkey % 3 <> 0 AS starts FROM orders)
SELECT session_id, 'scheduled' AS status FROM o UNION ALL
SELECT session_id, CASE WHEN starts THEN 'recording' ELSE 'scheduled_cancelled' END FROM o""")
def late_schedules(spark, sf):
    """Orders as scheduled sessions of which every third never starts: the timer cancels those."""
    at, o = folder(spark, "schedules"), D.table(spark, sf, "orders")
    day = F.col("o_orderdate").cast("timestamp_ntz")
    event = lambda n, status, seconds, start: F.struct(F.lit(n).cast("long").alias("event_id"), F.to_timestamp_ltz(day + F.make_dt_interval(secs=F.lit(seconds))).alias("at"), F.lit(status).alias("status"), start.alias("start_at"))
    begin = F.to_timestamp_ltz(day + F.make_dt_interval(secs=F.lit(600)))
    both = F.array(event(1, "scheduled", 0, begin), F.when(F.col("o_orderkey") % 3 != 0, event(2, "recording", 630, F.lit(None).cast("timestamp"))))
    e = o.select(F.col("o_orderkey").alias("session_id"), F.explode(both).alias("_e")).where("_e is not null").select("session_id", "_e.*")
    e.repartitionByRange(3, "at").write.parquet(at)
    in_order(spark, at)
    e.agg((F.max("at") + F.expr("INTERVAL 30 DAYS")).alias("at")).select(F.lit(-1).cast("long").alias("session_id"), F.lit(3).cast("long").alias("event_id"), "at", F.lit("end").alias("status"), F.lit(None).cast("timestamp").alias("start_at")).coalesce(1).write.mode("append").parquet(at)
    stream = spark.readStream.schema(spark.read.parquet(at).schema).option("maxFilesPerTrigger", 1).parquet(at)
    return to_table(lifecycle.watch(stream), spark).where("session_id >= 0").select("session_id", "status")
