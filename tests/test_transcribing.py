"""Recordings to transcripts: pieces, the hook, its failures, and the files of meetings."""

import json

import pytest
from conftest import rows
from pyspark.sql import functions as F

from speechgrain.operators import transcribing as T
from speechgrain.sources import files

REC = "path string, sample_rate long, channels int, bit_depth int, samples array<int>"
SHORT = {"target": 10, "trigger_ms": 30_000, "length_ms": 20_000, "overlap_ms": 4_000}


def words(part, device):
    """Each value other than 0 is a word of a tenth of a second; pieces with 7 need the CPU, those with 9 can't be heard."""
    seen = part.withColumn("error", F.when(F.array_contains("samples", 9), "broken").when(F.array_contains("samples", 7) & F.lit(device != "cpu"), "Out of memory"))
    each = seen.select("path", "chunk_idx", "chunk_start_ms", "error", F.posexplode("samples").alias("seg_idx", "v")).where("v <> 0")
    once = each.where("error is null or v in (7, 9)")
    tenth = lambda k: (F.col("seg_idx") + k) / 10.0
    return once.select("path", "chunk_idx", "chunk_start_ms", "seg_idx", tenth(0).alias("start_time"), tenth(1).alias("end_time"), F.lit(None).cast("string").alias("speaker_id"), F.when(F.col("error").isNull(), F.concat(F.lit("word "), F.col("v").cast("string"))).alias("text"), "error")


def track(n, **at):
    out = [0] * n
    for k, v in at.items():
        out[int(k[1:])] = v
    return out


def test_pieces_cover_every_sample(spark):
    data = [("a", 10, 1, 16, list(range(1, 401))), ("b", 10, 1, 16, list(range(299))), ("c", 3, 1, 16, list(range(1, 1001))), ("d", 10, 1, 16, []), ("e", 10, 1, 16, None), ("f", 0, 1, 16, [1])]
    got = rows(T.pieces(spark.createDataFrame(data, REC), 30_000, 20_000, 4_000).select("path", "chunk_idx", "chunk_start_ms", "chunk_end_ms", "samples"), "path", "chunk_idx")
    a = [r for r in got if r[0] == "a"]
    assert [(r[2], r[3]) for r in a] == [(0, 20_000), (16_000, 36_000), (32_000, 40_000)] and a[1][4] == list(range(161, 361)) and a[2][4] == list(range(321, 401))
    assert [r[1:4] for r in got if r[0] == "b"] == [(0, 0, 29_900)] and {r[0] for r in got} == {"a", "b", "c"}
    c = [r[4] for r in got if r[0] == "c"]
    assert {v for r in c for v in r} == set(range(1, 1001)) and c[-1][-1] == 1000  # a rate that ms don't divide loses no sample


def test_transcripts_failures_and_empty_recordings(spark):
    data = [
        ("long", 10, 1, 16, track(400, k10=1, k180=2, k350=7)),  # 18 s lies in two pieces, one of which needs the CPU
        ("stereo", 10, 2, 16, track(100, k20=4, k21=4)),
        ("broken", 10, 1, 16, track(400, k10=1, k390=9)),
        ("silent", 10, 1, 16, track(50)), ("empty", 10, 1, 16, []), ("none", 10, 1, 16, None), ("still", 0, 1, 16, [1, 2]),
    ]
    done = T.transcribe(spark.createDataFrame([(*r, "extra") for r in data], REC + ", text string"), words, **SHORT)
    found = rows(done["segments"].select("path", "position", "start_ms", "text", "device"), "path", "position")
    assert found == [("long", 1, 1_000, "word 1", "gpu"), ("long", 2, 18_000, "word 2", "gpu"), ("long", 3, 35_000, "word 7", "cpu"), ("stereo", 1, 1_000, "word 4", "gpu")]
    assert rows(done["failed"]) == [("broken", "broken")]
    docs = {r.path: r for r in done["documents"].collect()}
    assert {p: (r.duration_ms, r.chunked, r.segments) for p, r in docs.items()} == {"long": (40_000, True, 3), "stereo": (5_000, False, 1), "silent": (5_000, False, 0), "empty": (0, False, 0), "none": (0, False, 0), "still": (0, False, 0)}
    told = json.loads(docs["long"].json)
    assert docs["long"].text == "word 1\n\nword 2\n\nword 7" and [s["start_time"] for s in told["segments"]] == [1.0, 18.0, 35.0] and told["chunked"] is True
    assert docs["long"].header.startswith("audio_file: long\n") and json.loads(docs["silent"].json)["segments"] == []


def test_no_recordings(spark):
    done = T.transcribe(spark.createDataFrame([], REC), words, **SHORT)
    assert all(done[name].count() == 0 for name in done)


def test_a_meeting_is_written_unless_a_track_fails(spark, tmp_path):
    data = [(s, source, 10, 1, 16, track(60, k5=1 if source == "mic" else 2, k30=9 if (s, source) == (2, "system") else 3)) for s in (1, 2) for source in ("mic", "system")]
    tracks = spark.createDataFrame(data, "session_id long, source string, sample_rate long, channels int, bit_depth int, samples array<int>")
    long = lambda part, device: words(part, device).withColumn("end_time", F.col("start_time") + 2)
    embed = lambda asked: asked.withColumn("embedding", F.when(F.col("start_ms") < 1000, F.array(F.lit(1.0), F.lit(0.0))).otherwise(F.array(F.lit(0.0), F.lit(1.0))))
    names = spark.createDataFrame([(1, "2", "Cy")], "session_id long, speaker_id string, speaker_name string")
    done = T.meeting(tracks, long, embed, names=names, **SHORT)
    got = rows(done["segments"].select("session_id", "position", "source", "speaker_id", "speaker_name", "text"), "session_id", "position")
    assert got == [(1, 1, "mic", "0", None, "word 1"), (1, 2, "system", "2", "Cy", "word 2"), (1, 3, "mic", "1", None, "word 3"), (1, 4, "system", "3", None, "word 3")]
    assert rows(done["failed"]) == [(2, "system", "broken")]
    assert rows(files.write_files(done["files"], str(tmp_path)).select("path"), "path") == [("1/transcript.json",), ("1/transcript.md",)]
    assert "Cy: word 2" in (tmp_path / "1/transcript.md").read_text()


@pytest.mark.parametrize("balanced", [False, True])
def test_tracks_are_mixed_at_one_rate(spark, balanced):
    data = [(5, "mic", 10, 1, 16, [100] * 40), (5, "system", 10, 2, 16, [200] * 60)]
    tracks = spark.createDataFrame(data, "session_id long, source string, sample_rate long, channels int, bit_depth int, samples array<int>")
    (got,) = T.mixed(tracks, target=10, balanced=balanced).collect()
    assert got.path == "5/mixed.wav" and got.sample_rate == 10 and len(got.samples) == 40
    assert balanced or got.samples == [300] * 30 + [100] * 10
