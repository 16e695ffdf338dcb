import datetime
import os

import numpy as np
import pytest
from pyspark.sql import functions as F

from speechgrain.plans import jobs
from speechgrain.sources.wav import parse_wav, wav_bytes
from speechgrain.streaming import detection, lifecycle, recording, windows
from conftest import rows

# --- the sink ----------------------------------------------------------------------------------------------------------


def test_what_a_killed_run_leaves_is_readable_and_mended(tmp_path, monkeypatch):
    monkeypatch.setattr(recording, "PATCH", 64)
    rng, path = np.random.default_rng(0), str(tmp_path / "x.wav")
    samples = rng.integers(-32768, 32767, 2 * 500)
    row = lambda a, b: {"path": "x.wav", "sample_rate": 8000, "channels": 2, "first_frame": a, "samples": samples[2 * a : 2 * b].tolist()}
    sink = recording._Sink("file://" + str(tmp_path))

    class Lost(Exception):
        pass

    def dying():
        yield row(0, 100)
        yield row(100, 170)
        raise Lost

    with pytest.raises(Lost):
        sink.write(dying())
    rate, channels, _, left = parse_wav(open(path, "rb").read())
    assert (rate, channels) == (8000, 2) and 0 < len(left) and (left == samples[: len(left)]).all()
    for _ in range(2):  # the batch again, and once more
        assert sink.write(iter([row(100, 170), row(0, 100)])).frames == 170
    sink.commit([sink.write(iter([row(400, 500), row(170, 400)]))], 1)
    assert open(path, "rb").read() == wav_bytes(8000, 2, samples)
    assert open(tmp_path / ".batches" / "1").read() == "330"
    with pytest.raises(ValueError):
        sink.write(iter([{**row(0, 1), "sample_rate": 16_000}]))
    with pytest.raises(ValueError):
        sink.write(iter([{**row(0, 1), "samples": [1, 2, 3]}]))
    with pytest.raises(ValueError):
        sink.write(iter([{**row(0, 1), "samples": [1, 40_000]}]))
    assert open(path, "rb").read() == wav_bytes(8000, 2, samples)


def test_many_files_and_gaps(tmp_path, monkeypatch):
    monkeypatch.setattr(recording, "OPEN", 2)
    sink = recording._Sink(str(tmp_path))
    order = [(f"f{k % 5}.wav", k // 5) for k in range(40)]
    sink.write({"path": p, "sample_rate": 4, "channels": 1, "first_frame": 2 * i, "samples": [i, -i]} for p, i in order)
    assert all(open(tmp_path / f"f{k}.wav", "rb").read() == wav_bytes(4, 1, [x for i in range(8) for x in (i, -i)]) for k in range(5))
    sink.write(iter([{"path": "f0.wav", "sample_rate": 4, "channels": 1, "first_frame": 20, "samples": [9]}]))
    assert parse_wav(open(tmp_path / "f0.wav", "rb").read())[3].tolist()[16:] == [0] * 4 + [9]


def test_a_stream_of_rows_becomes_files_and_restarts(spark, tmp_path):
    recording.register(spark)
    source, out, log = (f"file://{tmp_path}/{n}" for n in ("rows", "wavs", "log"))
    whole = {f"t{k}.wav": list(range(-50, 70 + k)) for k in range(3)}
    made = [(p, 16_000, 1, a, x[a : a + 40]) for p, x in whole.items() for a in range(0, len(x), 40)]
    for k in range(0, len(made), 4):  # rows come in any order
        spark.createDataFrame(made[::-1][k : k + 4], recording.SCHEMA).coalesce(1).write.mode("append").parquet(source)
        stream = spark.readStream.schema(recording.SCHEMA).parquet(source)
        recording.record(stream, out, log).awaitTermination()
    assert {p: open(tmp_path / "wavs" / p, "rb").read() for p in whole} == {p: wav_bytes(16_000, 1, x) for p, x in whole.items()}
    assert sorted(n for n in os.listdir(tmp_path / "wavs" / ".batches") if n.isdigit()) == ["0", "1", "2"]


def test_rows_in_any_order_open_each_file_once(tmp_path, monkeypatch):
    opened, plain = [], recording.GrowingWav.__enter__
    monkeypatch.setattr(recording.GrowingWav, "__enter__", lambda self: opened.append(self.path) or plain(self))
    sink = recording._Sink(str(tmp_path))
    done = sink.write({"path": f"f{k % 100}.wav", "sample_rate": 4, "channels": 1, "first_frame": k // 100, "samples": [k // 100 + 1]} for k in range(300))
    assert done.frames == 300 and len(opened) == 100
    assert all(open(tmp_path / f"f{k}.wav", "rb").read() == wav_bytes(4, 1, [1, 2, 3]) for k in range(100))


# --- the source --------------------------------------------------------------------------------------------------------


def test_whole_frames_of_files_in_any_state(tmp_path):
    path = str(tmp_path / "a.wav")
    full = wav_bytes(8000, 2, [1, 2, 3, 4, 5, 6])
    for data, frames in [(full[:20], None), (full[:40], None), (full[:44], 0), (full, 3), (full[:-1], 2), (full[:40] + bytes(4) + full[44:-1], 2), (full + b"LIST\x02\0\0\0ab", 3), (full[:40] + b"\xff" * 4 + full[44:], 3)]:
        open(path, "wb").write(data)
        found = recording.whole_frames(path)
        assert (found and found[3]) == frames, data
    open(path, "wb").write(full[:20] + b"\x03\0" + full[22:])
    with pytest.raises(ValueError):
        recording.whole_frames(path)


def test_growing_files_are_followed(spark, tmp_path):
    recording.register(spark)
    wavs, log, out = (str(tmp_path / n) for n in ("wavs", "log", "out"))
    os.makedirs(wavs)
    x = np.arange(1000) - 500

    def heard():
        recording.listen(spark, "file://" + wavs, piece=300).writeStream.format("parquet").option("path", out).option("checkpointLocation", log).trigger(availableNow=True).start().awaitTermination()
        pieces = rows(spark.read.parquet(out).select("path", "first_frame", "samples"), "path", "first_frame")
        return {p: [v for q, _, s in pieces if q == p for v in s] for p in {p for p, *_ in pieces}}, len(pieces)

    open(f"{wavs}/a.wav", "wb").write(wav_bytes(8000, 1, x[:700])[:-3])  # an unfinished sample at the end
    found, n = heard()
    assert found == {"a.wav": x[:698].tolist()} and n == 3
    with recording.GrowingWav(f"{wavs}/a.wav", 8000, 1) as file:
        file.put(698, x[698:])
    open(f"{wavs}/b.wav", "wb").write(wav_bytes(8000, 2, x[:10]))
    open(f"{wavs}/c.wav", "wb").write(b"RIFF")
    assert heard()[0] == {"a.wav": x.tolist(), "b.wav": x[:10].tolist()}
    assert heard()[1] == 6  # nothing new
    source = recording._Source("file://" + wavs, 300)
    with pytest.raises(ValueError):
        list(source.read(recording._Piece("b.wav", 0, 99)))


def test_a_task_reads_many_short_files_and_a_long_one_is_read_by_many(tmp_path, monkeypatch):
    monkeypatch.setattr(recording, "PACK", 40)
    made = {f"{k:03d}.wav": list(range(k, k + 5)) for k in range(100)} | {"long.wav": list(range(1000))}
    for name, x in made.items():
        open(tmp_path / name, "wb").write(wav_bytes(8000, 1, x))
    source = recording._Source(str(tmp_path), 300)
    end = source.latestOffset()
    assert end == {n: len(x) for n, x in made.items()} == source.latestOffset()
    parts = source.partitions({"000.wav": 2}, end)
    assert [len(p.pieces) for p in parts] == [40, 40, 20, 1, 1, 1, 1]
    found = {}
    for r in (r for p in parts for batch in source.read(p) for r in batch.to_pylist()):
        found.setdefault(r["path"], []).extend(r["samples"])
    assert found == made | {"000.wav": [2, 3, 4]}


# --- detection and windows ---------------------------------------------------------------------------------------------


def test_steps_of_the_debouncer():
    def switches(polls, on=3, off=2):
        active, run, out = False, 0, []
        for k, p in enumerate(polls):
            active, run, switched = detection.stepped(active, run, p == "1", on, off)
            if switched:
                out.append((k, active))
        return out

    assert switches("110110111") == [(8, True)]
    assert switches("1111010110100110111") == [(2, True), (12, False), (18, True)]
    assert switches("0000") == [] and switches("1", 1) == [(0, True)] and switches("1001", 1, 1) == [(0, True), (1, False), (3, True)]


def feed(spark, at, batches, schema):
    """A stream of a file a batch, in this order."""
    local, seen = at.removeprefix("file://"), set()
    for k, b in enumerate(batches):
        spark.createDataFrame(b, schema).coalesce(1).write.mode("append").parquet(at)
        new = {n for n in os.listdir(local) if n.endswith(".parquet")} - seen
        seen |= new
        for n in new:
            os.utime(f"{local}/{n}", (1000 + k, 1000 + k))
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(at)


T0 = datetime.datetime(2024, 1, 1, tzinfo=datetime.UTC)


def at(s):
    return T0 + datetime.timedelta(seconds=s)


def test_silence_switches_off_and_late_polls_are_passed_over(spark, tmp_path):
    schema = "session_id long, poll_id long, at timestamp, positive boolean"
    one = [(1, 0, at(0), True), (1, 2, at(2), True), (1, 1, at(1), True), (2, 3, at(2), True)]
    two = [(1, 4, at(1), False), (1, 5, at(1), False), (2, 6, at(1000), True), (2, 7, at(1001), True)]
    stream = feed(spark, f"file://{tmp_path}/polls", [one, two, [(3, 9, at(9000), False)]], schema)
    with detection.rocks(spark):
        out = jobs.to_table(detection.debounce(stream, silence_ms=60_000, lateness="0 seconds"), spark)
    base = int(T0.timestamp() * 1000)
    assert rows(out, "session_id", "at_ms") == [(1, base + 2000, True, False), (1, base + 62_000, False, True), (2, base + 1_001_000, True, False), (2, base + 1_061_000, False, True)]


def test_windows_and_pairs_leave_late_rows_out_and_count_them(spark, tmp_path):
    schema = "session_id long, event_id long, at timestamp"
    batches = [[(1, 0, at(0)), (1, 2, at(5)), (1, 1, at(8))], [(1, 4, at(100)), (1, 3, at(109))], [(1, 10, at(150))], [(1, 6, at(3)), (1, 8, at(200))], [(2, 7, at(5000))]]
    stream = feed(spark, f"file://{tmp_path}/events", batches, schema)

    def run(df, name):
        job = df.writeStream.format("parquet").option("path", f"{tmp_path}/{name}").option("checkpointLocation", f"{tmp_path}/{name}-log").outputMode("append").trigger(availableNow=True).start()
        job.awaitTermination()
        return rows(spark.read.schema(df.schema).parquet(f"{tmp_path}/{name}")), windows.dropped(job)

    base = int(T0.timestamp() * 1000)
    found, late = run(windows.activity(stream, "10 seconds", F.max("event_id").alias("most"), lateness="20 seconds"), "w")
    assert sorted(found) == [(1, base, base + 18_000, 3, 2), (1, base + 100_000, base + 119_000, 2, 4), (1, base + 150_000, base + 160_000, 1, 10), (1, base + 200_000, base + 210_000, 1, 8)] and late == 1
    even, odd = stream.where("event_id % 2 = 0"), stream.where("event_id % 2 = 1")
    found, late = run(windows.paired(even, odd, "event_id", 9, "20 seconds"), "p")
    assert sorted(found) == [(1, 0, 1, 8000), (1, 2, 1, 3000), (1, 4, 3, 9000)] and late >= 1


# --- the timer ---------------------------------------------------------------------------------------------------------


def test_a_repeated_event_leaves_the_timer_and_groups_of_sessions_equal_single_ones(spark, tmp_path):
    schema = "session_id long, event_id long, at timestamp, status string, start_at timestamp"
    one = [(k, 1, at(k % 7), "scheduled", at(60 + k)) for k in range(40)] + [(None, 1, at(0), "scheduled", at(60))]
    two = [*one[:10], *[(k, 2, at(70), "recording", None) for k in range(0, 40, 3)]]  # the first ten come twice
    three = [(1, 2, at(3000), "scheduled", at(9000)), (1, 3, at(3001), "stopped", None)]
    stream = lambda n: feed(spark, f"file://{tmp_path}/{n}", [one, two, three, [(-1, 9, at(90_000), "end", None)]], schema)
    found = [sorted(rows(jobs.to_table(lifecycle.watch(stream(f"e{n}"), groups=n), spark).select("session_id", "status")), key=repr) for n in (2, 5000)]
    cancelled = [(k, "scheduled_cancelled") for k in (*range(40), None) if k is None or k % 3 and k != 1]
    want = [(r[0], r[3]) for r in (*one, *two[10:], *three, (-1, 9, None, "end"))] + cancelled
    assert found == [sorted(want, key=repr)] * 2
