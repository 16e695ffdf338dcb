"""Composed flows, promotion with rollback, artifacts, and the states of sessions."""

import json
import math

import pytest
from conftest import rows

from pyspark.sql import functions as F

from speechgrain.functions.vectors import cosine
from speechgrain.operators import catalog, flows, matching, segments
from speechgrain.sources import files, wav

SEG = "session_id long, speaker_id string, seg_idx long, source string, start_ms long, end_ms long, text string"
PROF = "profile_id string, display_name string, provider string, model string, embedding array<double>"


def talk(spark):
    """Three speakers of one session and one of another; speaker 10 says two seconds only."""
    data = [(1, s, k, "mic", k * 10_000, k * 10_000 + 5_000, "words") for k, s in enumerate(["2", "2", "3", "3", "2", "3"])] + [(1, "10", 6, "system", 60_000, 62_000, "words"), (2, "0", 0, None, 0, 9_000, "words")]
    return spark.createDataFrame(data, SEG)


def hook(vectors):
    def extract(asked):
        known = asked.sparkSession.createDataFrame([(s, list(v)) for s, v in vectors.items()], "speaker_id string, embedding array<double>")
        return asked.join(known, "speaker_id", "left").withColumns({"provider": F.lit("p"), "model": F.lit("m"), "extraction": F.when((F.col("speech_ms") < 8000) | F.col("embedding").isNull(), "too_short").otherwise("ok")})

    return extract


def test_suggestions(spark):
    p = spark.createDataFrame([("a", "Ana", "p", "m", [1.0, 0.0]), ("b", "Ben", "p", "m", [0.0, 1.0])], PROF)
    by = {"2": (1.0, 0.1), "3": (1.0, 0.0), "10": (0.0, 1.0), "0": (0.7, 0.7)}
    got = flows.suggest_labels(talk(spark), p, hook(by))
    told = {(r.session_id, r.speaker_id): (r.position, r.segments, r.speech_ms, r.extraction, r.status, r.recommendation) for r in got["clusters"].collect()}
    assert told == {
        (1, "10"): (1, 1, 2_000, "too_short", None, "no_confident_match"), (1, "2"): (2, 3, 15_000, "ok", "matched", "reuse_profile"), (1, "3"): (3, 3, 15_000, "ok", "matched", "reuse_profile"),
        (2, "0"): (1, 1, 9_000, "ok", "below_threshold", "no_confident_match"),
    }
    detail = got["clusters"].where("speaker_id = '3'").first().detail
    assert detail == "Cluster 3 is Ana (a) with confidence 1.0000; reuse the profile."
    assert rows(got["duplicates"].select("session_id", "profile_id", "speaker_ids")) == [(1, "a", ["2", "3"])]
    assert rows(got["summary"].select("cluster_count", "matched_count", "duplicate_group_count", "mixed_cluster_count", "unmatched_count", "status")) == [(4, 2, 1, 0, 2, "ok")]
    doc = json.loads(flows.suggestion_json(got, {"threshold": 0.78}).where("session_id = 1").first().json)
    assert [c["speaker_id"] for c in doc["clusters"]] == ["10", "2", "3"] and doc["config"] == {"threshold": 0.78} and len(doc["duplicates"]) == 1
    assert rows(flows.confident_names(got["clusters"]), "speaker_id") == [(1, "2", "Ana"), (1, "3", "Ana")]
    none = flows.suggest_labels(talk(spark), p.limit(0), hook(by), has_profiles=False)
    assert {r.recommendation for r in none["clusters"].collect()} == {"no_profiles"} and rows(none["summary"].select("matched_count", "unmatched_count", "status")) == [(0, 4, "no_profiles")]


def test_windows_of_different_speakers_warn(spark):
    p = spark.createDataFrame([("a", "Ana", "p", "m", [1.0, 0.0]), ("b", "Ben", "p", "m", [0.0, 1.0])], PROF)

    def window(asked):
        v = F.when((F.col("speaker_id") == "2") & (F.col("window") == 2), F.array(F.lit(0.0), F.lit(1.0))).otherwise(F.array(F.lit(1.0), F.lit(0.0)))
        return asked.withColumns({"provider": F.lit("p"), "model": F.lit("m"), "embedding": v, "extraction": F.lit("ok")})

    got = flows.suggest_labels(talk(spark), p, hook({"2": (1.0, 0.0), "3": (1.0, 0.0), "0": (1.0, 0.0)}), window, n_windows=2)
    assert rows(got["mixed"].select("session_id", "speaker_id", "profile_ids", "names")) == [(1, "2", ["a", "b"], ["Ana", "Ben"])]
    never = lambda candidates, profiles: matching.best(candidates, profiles, 2.0, 0.0)
    assert flows.suggest_labels(talk(spark), p, hook({"2": (1.0, 0.0)}), match=never)["summary"].first().matched_count == 0


def test_default_extraction_cuts_the_speaker_out_of_the_audio(spark):
    rate = 10
    tone = lambda freq, n: [int(1000 * math.sin(freq * k)) for k in range(n)]
    audio = spark.createDataFrame([(1, "mic", rate, tone(0.3, 700)), (1, "system", rate, tone(2.0, 700))], "session_id long, source string, sample_rate long, samples array<long>")
    got = {r.speaker_id: r for r in flows.extract(flows.clusters_of(talk(spark)), audio).where("session_id = 1").collect()}
    assert got["2"].extraction == "ok" and len(got["2"].embedding) == 26 and got["10"].extraction == "too_short" and got["10"].embedding is None
    from speechgrain.functions import providers

    own = [v for a, b in ((0, 5), (10, 15), (40, 45)) for v in tone(0.3, 700)[a * rate : b * rate]]
    want = providers.embed(spark.createDataFrame([(own,)], "samples array<long>"), "bands").first().embedding
    assert all(math.isclose(a, b, abs_tol=1e-12) for a, b in zip(got["2"].embedding, want, strict=True))
    assert flows.extract(flows.clusters_of(talk(spark)), audio).where("session_id = 2").first().extraction == "too_short"  # no audio at all


def test_best_clips_are_the_loudest_ranges(spark, tmp_path):
    level = [100, 3000, 50, 50, 2000, 50, 9]
    audio = spark.createDataFrame([(1, "mic", 10, [level[k // 100] * (-1) ** k for k in range(700)])], "session_id long, source string, sample_rate long, samples array<long>")
    got = {r.speaker_id: r for r in flows.best_clips(talk(spark), audio, max_ms=8_000).collect()}
    assert got["2"].samples == [3000 * (-1) ** k for k in range(50)] + [2000 * (-1) ** k for k in range(30)] and got["2"].clip_ms == 8_000 and got["2"].name == "speaker-2-8s-raw"
    assert got["3"].clip_ms == 8_000 and set(map(abs, got["3"].samples)) == {50}
    first = flows.best_clips(talk(spark), audio, max_ms=8_000, loudest=False).where("speaker_id = '2'").first()
    assert first.samples[:50] == [100 * (-1) ** k for k in range(50)]
    loud = {r.speaker_id: r for r in flows.best_clips(talk(spark), audio, max_ms=0, normalize=True).collect()}
    assert loud["3"].name == "speaker-3-all-norm" and set(map(abs, loud["3"].samples)) == {2000}  # the gain is 40 at most
    written = files.write_files(wav.as_files(flows.best_clips(talk(spark), audio).select(F.concat("name", F.lit(".wav")).alias("path"), "sample_rate", "samples")), str(tmp_path))
    assert written.count() == 3 and wav.parse_wav((tmp_path / "speaker-10-60s-raw.wav").read_bytes())[0] == 10


def test_cosine_of_unlike_vectors_raises(spark):
    d = spark.createDataFrame([([1.0, 0.0], [1.0]), (None, [1.0])], "a array<double>, b array<double>")
    with pytest.raises(Exception, match="vectors of lengths 2 and 1"):
        d.select(cosine(F.col("a"), F.col("b"))).collect()
    assert d.where("a is null").select(cosine(F.col("a"), F.col("b"))).first()[0] is None


def test_large_profile_sets_are_salted(spark):
    c = spark.createDataFrame([(i, "p", "m" if i % 7 else "n", [float(i % 5), 1.0, float(i % 3)]) for i in range(60)], "candidate_id long, provider string, model string, embedding array<double>")
    p = spark.createDataFrame([(f"{i}", f"N{i}", "p", "m", [1.0, float(i), 2.0][: 3 - (i == 4)]) for i in range(6)], PROF)
    assert rows(matching.scores(c, p), "candidate_id", "profile_id") == rows(matching.scores(c, p, cells=3), "candidate_id", "profile_id")
    of = matching.skipped_of(c.where("candidate_id = 1"), matching.skipped(c, p))
    assert rows(of.select("profile_id", "reason")) == [("4", "embedding_dimension_mismatch")] and matching.skipped(c.limit(0), p).count() == 0


def test_chunks_are_merged_in_order(spark):
    data = [(1, 0, 0, 0, 290_000, 295_000, "this is the shared sentence"), (1, 1, 285_000, 0, 5_000, 10_000, "this is the shared sentence"), (1, 1, 285_000, 1, 20_000, 25_000, "new unique content afterwards"), (1, 1, 285_000, 2, None, None, "without times")]
    d = spark.createDataFrame(data, "session_id long, chunk_idx long, chunk_start_ms long, seg_idx long, start_ms long, end_ms long, text string")
    got = rows(flows.merge_chunks(d).select("position", "start_ms", "text"), "position")
    assert got == [(1, None, "without times"), (2, 290_000, "this is the shared sentence"), (3, 305_000, "new unique content afterwards")]


def test_a_meeting_is_transcribed_track_by_track(spark):
    seg = lambda source, k, text: (1, k, source, k * 10_000, k * 10_000 + 9_000, text, None)
    schema = "session_id long, seg_idx long, source string, start_ms long, end_ms long, text string, speaker_id string"
    tracks = {s: spark.createDataFrame([seg(s, k, f"{s} {k}") for k in range(4)], schema) for s in ("mic", "system")}
    turn = lambda parts: spark.createDataFrame([(1, k, v) for k, v in enumerate(parts)], "session_id long, seg_idx long, embedding array<double>")
    vectors = {"mic": turn([[1.0, 0.0], [0.0, 1.0]] * 2), "system": turn([[1.0, 0.0]] * 4)}
    names = spark.createDataFrame([(1, "2", "Cy")], "session_id long, speaker_id string, speaker_name string")
    got = rows(flows.transcribe_meeting(tracks, vectors, names).where("seg_idx < 2").select("source", "seg_idx", "speaker_id", "speaker_name"), "source", "seg_idx")
    # both microphone speakers are tiny without a large one, so they stay two; the other track's ids go on from there
    assert got == [("mic", 0, "0", None), ("mic", 1, "1", None), ("system", 0, "2", "Cy"), ("system", 1, "2", "Cy")]
    tracks["third"], vectors["third"] = tracks["mic"], vectors["mic"]
    ids = rows(flows.transcribe_meeting(tracks, vectors).select("source", "speaker_id").distinct(), "source", "speaker_id")
    assert ids == [("mic", "0"), ("mic", "1"), ("system", "2"), ("third", "3"), ("third", "4")]  # a third track's ids follow both


def test_retry_on_the_cpu(spark):
    asked = spark.createDataFrame([(1, "ok"), (2, "GPU Timeout Error"), (3, "out of memory"), (4, "no such file")], "id long, fails string")
    run = lambda df, device: df.withColumn("error", F.when(F.col("fails") != "ok", F.col("fails")) if device != "cpu" else F.when(F.col("fails") == "out of memory", "still out of memory"))
    assert rows(flows.retried_on_cpu(asked, run).select("id", "device", "error"), "id") == [(1, "gpu", None), (2, "cpu", None), (3, "cpu", "still out of memory"), (4, "gpu", "no such file")]
    assert rows(flows.retried_on_cpu(asked, run, "cpu").select("id", "error"), "id")[1:3] == [(2, None), (3, "still out of memory")]


def test_relabelling_writes_three_kinds_of_files(spark, tmp_path):
    ranges = spark.createDataFrame([(1, "2", 0, 12_000)], "session_id long, speaker_id string, range_start_ms long, range_end_ms long")
    done = flows.relabelled(talk(spark).withColumn("speaker_name", F.when(F.col("seg_idx") == 5, "Old")), ranges, ["session_id", "speaker_id"], "Ana")
    assert [r.seg_idx for r in done.where("changed").orderBy("seg_idx").collect()] == [0, 1]
    out = flows.relabel_outputs(done)
    got = {(r.session_id, r.name): r for r in out.collect()}
    assert sorted(got) == [(1, "transcript.json"), (1, "transcript.md"), (1, "transcript.mic.json"), (1, "transcript.system.json")]  # session 2 has no change
    lines = got[1, "transcript.md"].content.splitlines()
    assert lines[0] == "[0.00 - 5.00] Mic Ana: words" and lines[5] == "[50.00 - 55.00] Mic Old: words" and lines[6] == "[60.00 - 62.00] System Speaker 10: words"
    assert got[1, "transcript.mic.json"].changed == 2 and got[1, "transcript.system.json"].changed == 0
    assert [s.get("speaker_name") for s in json.loads(got[1, "transcript.mic.json"].content)["segments"]] == ["Ana", "Ana", None, None, None, "Old"]
    staged = files.write_files(files.as_text(out, F.col("name"), F.col("content")), str(tmp_path / "staging")).collect()
    assert sorted(r.path for r in staged) == sorted(n for _, n in got) and (tmp_path / "staging/transcript.md").read_text().splitlines() == lines


# --- promotion and artifacts -------------------------------------------------------------------------------------------


def session(tmp_path, **content):
    for folder, names in content.items():
        (tmp_path / folder).mkdir(exist_ok=True)
        for name, text in names.items():
            (tmp_path / folder / name).write_text(text)
    return str(tmp_path / "staging"), str(tmp_path / "final")


def seen(tmp_path):
    return {f.name: f.read_text() for f in (tmp_path / "final").iterdir()}


def test_promotion(tmp_path):
    staging, final = session(tmp_path, staging={"a": "new a", "b": "new b"}, final={"a": "old a", "c": "c"})
    assert files.promote(staging, final, ["a", "b", "missing"]) == ["a", "b"] and seen(tmp_path) == {"a": "new a", "b": "new b", "c": "c"}
    assert files.promote(staging, final, ["missing"]) == [] and files.reconcile(final) == "none"


def test_failed_promotion_rolls_back(tmp_path):
    staging, final = session(tmp_path, staging={"a": "new a", "b": "new b", "c": "new c"}, final={"a": "old a", "c": "old c"})

    def breaks(source, target):
        if target.endswith("/c"):
            raise OSError("disk full")
        files._move(source, target)

    with pytest.raises(OSError):
        files.promote(staging, final, ["a", "b", "c"], breaks)
    assert seen(tmp_path) == {"a": "old a", "c": "old c"} and (tmp_path / "staging/b").read_text() == "new b"


def test_dead_promotions_are_settled(spark, tmp_path):
    class Dead(BaseException):
        pass

    def dies_after(n):
        left = [n]

        def move(source, target):
            if not left[0]:
                raise Dead
            left[0] -= 1
            files._move(source, target)

        return move

    for moves, settled, left in ((1, "rolled back", {"a": "old a"}), (2, "kept", {"a": "new a", "b": "new b"})):
        staging, final = session(tmp_path, staging={"a": "new a", "b": "new b"}, final={"a": "old a"})
        (tmp_path / "final/b").unlink(missing_ok=True)
        keep, files.reconcile = files.reconcile, lambda target: "none"  # the process dies before it can settle anything
        clean, files._clean = files._clean, lambda target, journal: None
        try:
            files.promote(staging, final, ["a", "b"], dies_after(moves))
        except Dead:
            pass
        finally:
            files.reconcile, files._clean = keep, clean
        actions = {r.name: r.action for r in catalog.journal_action(files.journal_rows(spark, final)).collect()}
        assert actions == ({"a": "restore_backup", "b": "none"} if moves == 1 else {"a": "keep", "b": "keep"})
        assert files.reconcile(final) == settled and seen(tmp_path) == left
    (tmp_path / "final" / files.JOURNAL).write_text("{")
    with pytest.raises(RuntimeError):
        files.promote(staging, final, ["a"])


def test_artifacts_are_made_once_for_their_settings(tmp_path):
    made = []

    def make():
        made.append(1)
        return {"speakers": len(made)}

    at = str(tmp_path / "s/audit.json")
    assert files.artifact(at, make, {"ratio": 3})["speakers"] == 1 and files.artifact(at, make, {"ratio": 3})["speakers"] == 1
    assert files.artifact(at, make, {"ratio": 4})["speakers"] == 2 and files.artifact(at, make, {"ratio": 4}, force=True)["speakers"] == 3
    (tmp_path / "s/audit.json").write_text("[")
    assert files.artifact(at, make, {"ratio": 4})["speakers"] == 4
    files.write_state(str(tmp_path / "run"), {"status": "x"})
    assert files.read_state(str(tmp_path / "run")) == {"status": "x"}


def test_objects_in_mixed_output():
    assert files.last_object('log {x} {"a": 1} more {"b": {"c": 2}} end }') == {"c": 2}
    assert files.last_object('{"a": [1, 2]}') == {"a": [1, 2]} and files.last_object("none { here") is None


# --- sessions ----------------------------------------------------------------------------------------------------------


def test_marks(spark):
    s = spark.createDataFrame([(1, "transcribing", "r1", "77", "t0"), (2, "transcribing", "r2", "78", "t0"), (3, "stopped", None, None, None), (4, "recording_failed", None, None, None), (5, "stopped", None, None, None)], "session_id long, status string, run_id string, transcription_pid string, transcription_started_at string")
    c = spark.createDataFrame([(1, "transcription_failed", "t1", "no audio", "r1", "log"), (2, "transcribed", "t1", None, "r9", None), (3, "transcribing", "t1", None, "r1", None), (4, "stopped", "t1", None, None, None)], "session_id long, status string, at string, reason string, run_id string, log_path string")
    got = {r.session_id: r for r in catalog.mark(s, c).collect()}
    assert (got[1].status, got[1].failed_at, got[1].failure_reason, got[1].transcription_pid, got[1].transcription_started_at, got[1].transcription_log_path, got[1].refused) == ("transcription_failed", "t1", "no audio", None, None, "log", False)
    assert (got[2].status, got[2].transcription_pid, got[2].refused) == ("transcribing", "78", True)  # another run's
    assert (got[3].status, got[3].transcription_started_at, got[3].refused) == ("transcribing", "t1", False)
    assert (got[4].status, got[4].refused, got[5].status, got[5].refused) == ("recording_failed", True, "stopped", False)


def test_transitions(spark):
    e = spark.createDataFrame([(1, k, k * 10, x) for k, x in enumerate(["scheduled", "recording", "stopped", "transcribing", "transcription_interrupted", "transcribing", "transcribed"])] + [(2, 9, 0, "stopped"), (3, 10, 0, "recording"), (3, 11, 5, "transcribing")], "session_id long, event_id long, at_ms long, status string")
    assert rows(catalog.refused_transitions(e).select("session_id", "event_id"), "event_id") == [(2, 9), (3, 11)]


def test_staged_outputs(spark):
    good = [("md", "x"), ("json", '{"segments": []}')]
    told = {"r1": good, "r2": good[:1], "r3": good[1:], "r4": [("md", ""), good[1]], "r5": [good[0], ("json", "")], "r6": [good[0], ("json", "{")], "r7": [good[0], ("json", '{"segments": 3}')], "r8": [good[0], ("json", '[{"text": "x"}]')], "r9": [good[0], ("json", '"words"')]}
    d = spark.createDataFrame([(r, f"transcript.{n}", c) for r, x in told.items() for n, c in x], "run_id string, name string, content string")
    got = {r.run_id: (r.valid, r.reason) for r in catalog.staged_outputs(d).collect()}
    assert [got[f"r{k}"][0] for k in range(1, 10)] == [True, False, False, False, False, False, False, True, False]
    assert got["r2"][1] == "missing transcript.json" and "not valid JSON" in got["r6"][1] and "shape" in got["r7"][1]


def test_ends_and_audio(spark):
    s = spark.createDataFrame([(1, "given"), (2, None), (3, "")], "session_id long, ended_at string")
    f = spark.createDataFrame([(1, "2026-01-01 10:00:00"), (2, "2026-01-01 10:00:00"), (2, "2026-01-01 11:30:00")], "session_id long, m string").select("session_id", F.to_timestamp("m").alias("modified"))
    got = {r.session_id: r.ended_at for r in catalog.session_end(s, f).collect()}
    assert got[1] == "given" and got[2] == "2026-01-01T11:30:00+00:00" and got[3] > "2026"
    a = spark.createDataFrame([(1, "m", "s", "x", None, 10.0, 10.2), (2, "m", "s", "x", None, 10.0, 12.0), (3, "m", "s", None, "rates differ", 1.0, 9.0)], "session_id long, mic string, system string, mixed string, mix_error string, mic_s double, system_s double")
    got = rows(catalog.audio_source(a).select("audio", F.size("outputs"), "note", "drift_note"), "session_id")
    assert got[0] == ("x", 3, None, None) and got[1][:3] == ("x", 3, None) and "2.00 s" in got[1][3] and got[2][:2] == ("m", 2) and "rates differ" in got[2][2]


def test_calendar_answers(spark):
    good = json.dumps({"ok": True, "data": [{"subject": "Sync", "start": "2026-01-01T10:00:00Z", "end": "2026-01-01T11:00:00Z"}, {"start": "bad", "is_all_day": True}]})
    data = [(1, None, 0, good), (2, "missing", None, None), (3, "timeout", None, None), (4, None, 2, ""), (5, None, 0, "words"), (6, None, 0, '{"ok": false, "error": {"code": "denied"}}'), (7, None, 0, '{"ok": false}'), (8, None, 0, '{"ok": true, "data": []}')]
    got = rows(catalog.calendar_events(spark.createDataFrame(data, "answer_id long, outcome string, exit_code int, stdout string")).select("answer_id", "error", "event_no", "subject", "is_all_day"), "answer_id", "event_no")
    assert got == [(1, None, 0, "Sync", False), (1, None, 1, "(untitled)", True), (2, "outlook_not_found", None, None, False), (3, "timeout", None, None, False), (4, "calendar_failed", None, None, False), (5, "bad_json", None, None, False), (6, "denied", None, None, False), (7, "calendar_error", None, None, False), (8, None, None, None, False)]
    late = spark.createDataFrame([("a", 44), ("b", 4096), ("c", 4097)], "path string, length long")
    assert rows(catalog.has_sound(late).select("path")) == [("c",)]


def test_text_of_tracks_without_segments(spark):
    tracks = spark.createDataFrame([(1, "mic", " words ", 900), (2, "mic", "x", 5), (1, "system", " ", 900)], "session_id long, source string, text string, duration_ms long")
    have = spark.createDataFrame([(2, "0", 0, "mic", 0, 5, "x")], SEG)
    assert rows(segments.text_fallback(have, tracks).where("session_id = 1").select("source", "text", "start_ms", "end_ms")) == [("mic", "words", 0, 900)]
