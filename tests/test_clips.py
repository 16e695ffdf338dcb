import hashlib
import json
import random
from difflib import SequenceMatcher

import pytest
from conftest import rows

from pyspark.sql import functions as F

from speechgrain.functions import text as T
from speechgrain.functions.config import Matching, Settings
from speechgrain.operators import catalog, clips


def test_audio_by_source(spark):
    audio = spark.createDataFrame([(1, 0, "Mic", "m.wav"), (1, 1, "system", "s.wav"), (2, 0, "mic", "only.wav")], "session_id long, ordinal int, source string, path string")
    r = spark.createDataFrame([(1, "mic"), (1, "system"), (1, None), (2, "system"), (3, "mic")], "session_id long, source string")
    got = {(x.session_id, x.source): x.audio_path for x in clips.audio_for_source(r, audio).collect()}
    assert got == {(1, "mic"): "m.wav", (1, "system"): "s.wav", (1, None): "m.wav", (2, "system"): "only.wav", (3, "mic"): None}


def test_devices(spark):
    d = spark.createDataFrame([(0, "USB Mic Pro"), (1, "mic"), (2, "Speaker")], "ordinal int, name string")
    assert rows(clips.choose_device(d, "mic").select("name")) == [("mic",)]
    assert rows(clips.choose_device(d, "usb").select("name")) == [("USB Mic Pro",)]
    assert clips.choose_device(d, "none").count() == 0


def test_tokens_tell_requests_apart(spark):
    data = [("4", "mic", [(0, 1000)], 30_000, True), ("4", "mic", [(0, 1000)], 30_000, True), ("4", "mic", [(0, 1001)], 30_000, True), ("12", "sys", [(1500, 2000), (7, 86_400_010)], 0, False)]
    d = spark.createDataFrame([(i, *r) for i, r in enumerate(data)], "i int, s string, src string, r array<struct<start_ms:long,end_ms:long>>, ms long, n boolean")
    t = [r[0] for r in d.orderBy("i").select(clips.request_token(*[F.col(c) for c in ("s", "src", "r", "ms", "n")])).collect()]
    assert t[0] == t[1] != t[2] and all(len(x) == 12 for x in t)
    for token, (speaker, source, ranges, ms, norm) in zip(t, data, strict=True):
        doc = {"speaker_id": speaker, "source": source, "ranges": [[a / 1000, b / 1000] for a, b in ranges], "sample_seconds": ms / 1000, "normalize": norm}
        assert token == hashlib.sha1(json.dumps(doc, sort_keys=True, separators=(",", ":")).encode()).hexdigest()[:12]
    names = [tuple(r) for r in d.orderBy("i").select(clips.sample_name(F.col("s"), F.lit("abc"), F.col("n")), clips.clip_name(F.col("s"), F.col("ms"), F.col("n"))).collect()]
    assert names[0] == ("speaker-4-enroll-ranges-abc-norm", "speaker-4-30s-norm") and names[3] == ("speaker-12-enroll-ranges-abc-raw", "speaker-12-all-raw")


def test_fallback_devices(spark):
    d = spark.createDataFrame([(0, "Built-in"), (1, "My Aggregate Device"), (2, "BlackHole 16ch"), (3, "blackhole")], "ordinal int, name string")
    assert rows(clips.fallback_device(d).select("ordinal")) == [(2,)]
    assert rows(clips.fallback_device(d.where("ordinal <> 2 and ordinal <> 3")).select("ordinal")) == [(1,)]
    assert clips.fallback_device(d.where("ordinal = 0")).count() == 0 and rows(clips.fallback_device(d, "built").select("ordinal")) == [(0,)]


def test_outcomes_and_metadata(spark):
    r = spark.createDataFrame([("Ana", 5.0), ("Ben", 0.0), ("Cy", 2.0)], "name string, selected_seconds double")
    have = spark.createDataFrame([("1", "Ana"), ("2", "cy")], "profile_id string, display_name string")
    assert rows(clips.enrolment_outcome(r, have).select("name", "outcome"), "name") == [("Ana", "skipped"), ("Ben", "failed"), ("Cy", "enrolled")]
    assert rows(clips.enrolment_outcome(r, have, True).where("name = 'Cy'").select("outcome")) == [("dry_run",)]
    assert rows(clips.enrolment_outcome(r.withColumn("error", F.lit("x")), have).where("name = 'Cy'").select("outcome")) == [("error",)]
    sel = spark.createDataFrame([(1, "0", 0, 1500), (1, "0", 2000, 2600)], "session_id long, speaker_id string, start_ms long, end_ms long")
    req = spark.createDataFrame([(1, "0", 0, 3000)], "session_id long, speaker_id string, range_start_ms long, range_end_ms long")
    m = clips.range_metadata(sel, req).first()
    assert (m.selected_segments, m.selected_seconds, len(m.requested_ranges)) == (2, 2.1, 1)


def test_cards(spark):
    columns = "status string, started_at string, ended_at string, ended_at_human string, failed_at string, failure_reason string, interrupted_at string, interrupted_at_human string, cancelled_at string, cancel_reason string, transcription_pid string, transcription_started_at string, transcribed_at_human string"
    told = [
        ({"status": "transcription_failed", "failed_at": "t1", "failure_reason": "no audio"}, "failed t1 — no audio"),
        ({"status": "transcription_failed", "ended_at": "e", "ended_at_human": "e h"}, "failed e h"),
        ({"status": "recording_failed", "ended_at_human": "e h"}, "recording failed to launch "),
        ({"status": "transcription_interrupted", "interrupted_at": "t", "interrupted_at_human": "t h"}, "interrupted t h — resume with transcribe --resume"),
        ({"status": "transcribing", "transcription_pid": "42", "transcription_started_at": "t"}, "transcribing (PID 42) since t"),
        ({"status": "transcribing"}, "transcribing (PID ?) since "),
        ({"status": "stopped", "ended_at": "e"}, "stopped e"),
        ({"status": "transcribed", "transcribed_at_human": "noon"}, "transcribed noon"),
        ({"status": "scheduled_cancelled", "cancelled_at": "c", "cancel_reason": "late"}, "scheduled start cancelled c — late"),
        ({"status": "odd", "failure_reason": "x"}, "odd"),
        ({}, ""),
    ]
    names = [c.split()[0] for c in columns.split(", ")]
    s = spark.createDataFrame([(i, *[d.get(c) for c in names]) for i, (d, _) in enumerate(told)], "i int, " + columns)
    assert [r[0] for r in s.orderBy("i").select(T.card_text({c: F.col(c) for c in names})).collect()] == [x for _, x in told]


def test_boards_and_notes(spark):
    s = spark.createDataFrame([(1, "/v/rec/a", "A|b]]", "stopped", "2026-01-02T09", "e"), (2, "/v/rec/b", None, "stopped", "2026-01-02T10", "e"), (3, "/elsewhere/c", "C", "stopped", "2026-01-03", "e"), (4, "/v/d", "D", "transcribed", None, None)], "session_id long, session_dir string, title string, status string, started_at string, ended_at string")
    got = {r.session_id: (r.lane, r.place, r.card) for r in catalog.board(s, "/v").collect()}
    assert got[1] == ("To Transcribe", 3, "- [ ] [[rec/a/session|A-b] ]]] — stopped e — mode unknown") and got[2][:2] == ("To Transcribe", 2) and "|Untitled]]" in got[2][2]
    assert got[3][1] == 1 and got[3][2].startswith("- [ ] [[/elsewhere/c/session|") and got[4][:2] == ("Transcribed", 1)
    n = spark.createDataFrame([("Sync", "stopped", ["a.wav"], [("Ana", "a@b.co"), ("Ben", "")])], "title string, status string, audio_files array<string>, attendees array<struct<name:string,address:string>>")
    note = clips.session_note(n).first().note
    assert note.startswith("# Sync\n") and "- attendees: Ana <a@b.co>, Ben" in note and note.endswith("- a.wav")


def test_attendees(spark):
    told = {
        "Kim Ode <kim@ex.org>, lee@ex.org, Noor Sol": [("Kim Ode", "kim@ex.org"), ("", "lee@ex.org"), ("Noor Sol", "")],
        "Ode, Kim <kim@ex.org>    ,  Sol, Noor<noor@ex.org>": [("Ode, Kim", "kim@ex.org"), ("Sol, Noor", "noor@ex.org")],
        "a <x@y>,  b": [("a", "x@y"), ("b", "")],
        "a@b, a@b., @b.c, a@.c, a b@c.d, a@@b.c": [("a@b", ""), ("a@b.", ""), ("@b.c", ""), ("a@.c", ""), ("a b@c.d", ""), ("a@@b.c", "")],
        "  , , ": [],
        "x <a <b@c.d>, < only@ad.dr >, open <a@b.c": [("x <a", "b@c.d"), ("", "only@ad.dr"), ("open <a@b.c", "")],
    }
    d = spark.createDataFrame([(k,) for k in told], "t string")
    assert {r.t: [tuple(a) for a in r.a] for r in d.select("t", T.attendees(F.col("t")).alias("a")).collect()} == told
    assert d.limit(1).select(T.attendees(F.lit(None).cast("string"))).first()[0] == []


def test_device_errors(spark):
    d = spark.createDataFrame([("kernel: GPU Timeout Error (x)",), ("Command buffer execution failed",), ("network read timed out",), ("Resource exhausted",), ("failed to allocate 3 bytes",), ("memory card missing",), (None,)], "t string")
    assert [r[0] for r in d.select(T.device_error(F.col("t"))).collect()] == ["timeout", "timeout", None, "memory", "memory", None, None]


def test_letter_bound_is_one(spark):
    rng = random.Random(3)
    word = lambda: "".join(rng.choice("abc d") for _ in range(rng.randint(0, 12)))
    d = spark.createDataFrame([(word(), word()) for _ in range(300)], "a string, b string")
    assert all(r.bound >= SequenceMatcher(None, r.a, r.b).ratio() - 1e-12 for r in d.select("a", "b", T.letter_bound(F.col("a"), F.col("b")).alias("bound")).collect())


def test_settings(tmp_path):
    (tmp_path / "c.json").write_text('{"threshold": 0.9, "other": 1}')
    assert Matching.read(tmp_path / "c.json").threshold == 0.9 and Matching.read(tmp_path / "none").margin == 0.05
    for bad in ({"threshold": 1.1}, {"margin": -1}, {"min_speech_s": 0}):
        with pytest.raises(ValueError):
            Matching(**bad)


def test_where_settings_are(tmp_path):
    at = tmp_path / "s.json"
    at.write_text(json.dumps({"speakerProfilesDir": "/p", "speakerIdentification": {"enabled": True, "matchThreshold": 0.5}, "artifactExport": {"targetDir": "/t", "enabled": True}, "more": 1}))
    found = Settings.read(str(at), {})
    assert (found.speakerProfilesDir, found.matching.threshold, found.matching.enabled, found.export.targetDir) == ("/p", 0.5, True, "/t")
    assert found.chosen(threshold=0.6) == {"provider": "bands", "threshold": 0.6, "margin": 0.05, "min_speech_s": 8.0, "profiles": "/p"}
    assert Settings.read(None, {"SPEECHGRAIN_CONFIG": str(at)}) == found and Settings.path("x", {"SPEECHGRAIN_CONFIG": "y"})[0].name == "x"
    assert Settings.read(None, {"HOME": str(tmp_path)}) == Settings()
    for asked, env in ((str(tmp_path / "none"), {}), (None, {"SPEECHGRAIN_CONFIG": str(tmp_path / "none")})):
        with pytest.raises(ValueError):
            Settings.read(asked, env)
    for bad in ("{", '{"speakerProfilesDir": ""}', '{"artifactExport": {"enabled": true}}', '{"artifactExport": {"hookTimeoutSeconds": 0}}', '{"artifactExport": {"postPipelineCommand": {"executable": ""}}}', '{"speakerIdentification": {"matchMargin": -1}}'):
        at.write_text(bad)
        with pytest.raises(ValueError):
            Settings.read(str(at), {})
