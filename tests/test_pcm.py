import math
import random
import struct

import numpy as np
import pytest
from conftest import rows

from pyspark.sql import functions as F

from speechgrain.functions import providers
from speechgrain.operators import pcm
from speechgrain.sources import transcripts, wav


def track(spark, values, name="t"):
    return spark.createDataFrame([(name, i, int(v)) for i, v in enumerate(values)], "track string, idx long, value long")


def mixed(spark, a, b, **options):
    return [r.value for r in pcm.mix(track(spark, a), track(spark, b), **options).orderBy("idx").collect()]


def test_raw_mix_pads_and_clamps(spark):
    assert mixed(spark, [10000, 30000, -30000, 123], [10000, 10000, -10000]) == [20000, 32767, -32768, 123]
    assert mixed(spark, [1000, -2000, 30000], [500, 500, 500]) == [1500, -1500, 32767 if 30500 > 32767 else 30500]


def test_balanced_mix_raises_a_quiet_result(spark):
    out = mixed(spark, [100, -100, 100, -100], [50, -50, 50, -50], balanced=True)
    assert out == [3200, -3200, 3200, -3200]  # lifted to parity, summed to 200, gain at most 16
    loud = mixed(spark, [30000] * 4, [30000] * 4, balanced=True)
    assert loud == [32767] * 4


def test_resample(spark):
    df = spark.createDataFrame([([0, 100],)], "s array<int>")
    assert df.select(pcm.resample(F.col("s"), F.lit(10), F.lit(20))).first()[0] == [0, 50, 100, 100]
    assert df.select(pcm.resample(F.col("s"), F.lit(10), F.lit(10))).first()[0] == [0, 100]


def test_slices(spark):
    df = spark.createDataFrame([(list(range(10)),)], "s array<int>")
    assert df.select(pcm.slice_seconds(F.col("s"), F.lit(0.25), F.lit(0.75), 10)).first()[0] == [2, 3, 4, 5, 6]
    assert df.select(pcm.slice_seconds(F.col("s"), F.lit(0.8), F.lit(9.0), 10)).first()[0] == [8, 9]
    both = F.expr("array(named_struct('start', 0.0D, 'end', 0.2D), named_struct('start', 0.5D, 'end', 0.5D), named_struct('start', 0.9D, 'end', 1.0D))")
    assert df.select(pcm.concat_ranges(F.col("s"), both, 10)).first()[0] == [0, 1, 9]
    assert df.select(pcm.mono(F.array(*map(F.lit, [1, 2, -1, -2])), 2)).first()[0] == [1, -2]
    assert df.select(pcm.mono(F.array(*map(F.lit, [1, 2, -1, -2])), 2, truncate=True)).first()[0] == [1, -1]


def test_levels(spark):
    t = track(spark, [0, 10, 3000, -4000, -32768])
    assert math.isclose(t.agg(pcm.gated_rms(F.col("value"))).first()[0], math.sqrt((3000**2 + 4000**2 + 32768**2) / 3))
    assert rows(pcm.payload(t).select("non_zero", "peak")) == [(4, 32767)]
    df = spark.createDataFrame([(-2.0,), (-0.5,), (0.5,), (2.0,)], "x double")
    assert [r[0] for r in df.select(pcm.float_to_16(F.col("x"))).collect()] == [-32768, -16384, 16383, 32767]


def test_loudness_ignores_silence_and_peaks(spark):
    frames = [0.0] * 5 + [0.1] * 20 + [0.9]
    s = spark.createDataFrame([("t", i * 4 + k, v) for i, v in enumerate(frames) for k in range(4)], "track string, idx long, value double")
    r = pcm.speech_loudness(s, 4).first()
    assert r.frames == 21 and math.isclose(r.loudness, 0.1)
    few = s.where("idx < 28")
    assert pcm.speech_loudness(few, 4).first().frames == 2
    assert math.isclose(few.agg(pcm.speech_gain(F.lit(0.1))).first()[0], 10 ** (-19 / 20) / 0.1)
    assert few.agg(pcm.speech_gain(F.lit(0.9))).first()[0] == 1.0 and few.agg(pcm.speech_gain(F.lit(0.0))).first()[0] == 1.0


def bands(x, n=13):
    if not x:
        return [0.0] * 2 * n
    w, out = max(1, len(x) // n), []
    for i in range(n):
        f = (x[i * w : (i + 1) * w] if i < n - 1 else x[i * w :]) or [0]
        out += [sum(map(abs, f)) / len(f), sum((a >= 0) != (b >= 0) for a, b in zip(f, f[1:], strict=False)) / max(1, len(f) - 1) * 1000.0]
    q = math.sqrt(sum(v * v for v in out)) or 1.0
    return [v / q for v in out]


def test_band_features(spark):
    data = [[], [5], [1, -2, 3], [(-1) ** (k // 3) * k for k in range(100)], [0] * 40]
    df = spark.createDataFrame([(i, x) for i, x in enumerate(data)], "i long, samples array<long>")
    for r in providers.embed(df, "bands").orderBy("i").collect():
        assert all(math.isclose(a, b, abs_tol=1e-12) for a, b in zip(r.embedding, bands(data[r.i]), strict=True))
    providers.register("mean", lambda: lambda clips: [[float(c.mean()) if len(c) else 0.0] for c in clips])
    assert providers.embed(df, "mean").where("i = 2").first().embedding == [2 / 3]
    try:
        providers.embed(df, "none")
    except ValueError as e:
        assert "bands" in str(e)


def test_interleave(spark):
    df = spark.createDataFrame([([[1, 2, 3], [4, 5]],), ([[7, 8]],)], "c array<array<int>>")
    assert [r[0] for r in df.select(pcm.interleave(F.col("c"))).collect()] == [[1, 4, 2, 5], [7, 8]]


def test_rows_equal_arrays(spark):
    rng = random.Random(4)
    data = {"one": [7], "two": [1, -2], **{f"t{k}": [rng.randint(-32768, 32767) for _ in range(rng.randint(3, 90))] for k in range(12)}}
    both = spark.createDataFrame([(k, i, v) for k, x in data.items() for i, v in enumerate(x)], "track string, idx long, value long")
    whole = spark.createDataFrame(list(data.items()), "track string, samples array<long>")
    for a, b in ((4, 6), (6, 4), (16000, 44100), (10, 10), (3, 1)):
        want = {r.track: r.s for r in whole.select("track", pcm.resample(F.col("samples"), F.lit(a), F.lit(b)).alias("s")).collect()}
        got = {k: [] for k in data}
        for r in pcm.resample_rows(both, a, b).orderBy("track", "idx").collect():
            assert r.idx == len(got[r.track])
            got[r.track].append(r.value)
        assert got == want, (a, b)
    bands_ = {r.track: r.f for r in pcm.band_rows(both).groupBy("track").agg(F.transform(F.array_sort(F.collect_list(F.struct("dim", "feature"))), lambda x: x["feature"]).alias("f")).collect()}
    assert all(math.isclose(a, b, abs_tol=1e-12) for k in data for a, b in zip(bands_[k], bands(data[k]), strict=True))
    other = both.where("idx % 2 = 0").withColumn("idx", F.floor(F.col("idx") / 2))
    got = {r.track: r.s for r in pcm.interleave_rows([both, other]).groupBy("track").agg(F.transform(F.array_sort(F.collect_list(F.struct("idx", "value"))), lambda x: x["value"]).alias("s")).collect()}
    assert got == {k: [v for pair in zip(x, x[::2], strict=False) for v in pair] for k, x in data.items()}


def test_float_tracks(spark):
    rng = np.random.default_rng(2)
    for channels, a, b in ((1, 8000, 16000), (2, 44100, 16000), (3, 16000, 16000), (1, 48000, 16000)):
        x = rng.integers(-32768, 32768, 30 * channels)
        got = spark.createDataFrame([(x.tolist(),)], "s array<int>").select(pcm.float_track(F.col("s"), channels, a, b)).first()[0]
        mean = x.reshape(-1, channels).mean(axis=1) / 32768
        n = round(len(mean) * b / a)
        want = mean if a == b else np.interp(np.linspace(0, len(mean) - 1, n), np.arange(len(mean)), mean)
        assert np.allclose(got, want, atol=1e-12)
    assert spark.createDataFrame([([],)], "s array<int>").select(pcm.float_track(F.col("s"), 2, 8000)).first()[0] == []


def test_nothing_to_concatenate_raises(spark):
    df = spark.createDataFrame([([1, 2, 3],)], "s array<int>")
    none = F.array(F.struct(F.lit(9.0).alias("start"), F.lit(9.5).alias("end")))
    with pytest.raises(Exception, match="no range holds any audio"):
        df.select(pcm.concat_ranges(F.col("s"), none, 2)).collect()
    assert df.select(pcm.concat_ranges(F.col("s"), none, 2, may_be_empty=True)).first()[0] == []


def chunked_wav(path, rate, channels, samples, before=b"", between=b""):
    plain = wav.wav_bytes(rate, channels, samples)
    rest = plain[8:12] + before + plain[12:36] + between + plain[36:]
    path.write_bytes(b"RIFF" + struct.pack("<I", len(rest)) + rest)


def test_probe_agrees_with_the_standard_library(spark, tmp_path):
    import wave

    chunk = lambda name, data: name + struct.pack("<I", len(data)) + data + b"\0" * (len(data) % 2)
    chunked_wav(tmp_path / "junk.wav", 16000, 1, range(100), before=chunk(b"JUNK", b"x" * 27))
    chunked_wav(tmp_path / "list.wav", 8000, 2, range(200), between=chunk(b"LIST", b"abc"))
    chunked_wav(tmp_path / "far.wav", 44100, 1, range(1000), before=chunk(b"JUNK", b"x" * 200_001), between=chunk(b"LIST", b"y" * 70_000))
    chunked_wav(tmp_path / "plain.wav", 22050, 1, [])
    got = {r.path.rsplit("/", 1)[-1]: r for r in wav.probe(wav.list_wavs(spark, str(tmp_path))).collect()}
    for name in ("junk.wav", "list.wav", "far.wav", "plain.wav"):
        with wave.open(str(tmp_path / name)) as w:
            assert (got[name].sample_rate, got[name].channels, got[name].sample_width, got[name].frame_count) == (w.getframerate(), w.getnchannels(), w.getsampwidth(), w.getnframes())
            assert math.isclose(got[name].duration_s, w.getnframes() / w.getframerate())
    (tmp_path / "no.wav").write_bytes(b"RIFF1234WAVE")
    (tmp_path / "text.wav").write_bytes(b"words")
    bad = wav.probe(wav.list_wavs(spark, str(tmp_path)).where("length < 40")).collect()
    assert len(bad) == 2 and all(r.sample_rate is None and r.duration_s is None for r in bad)


def test_a_header_costs_few_bytes(tmp_path):
    class Counting:
        def __init__(self, file):
            self.file, self.n = file, 0

        def read(self, size):
            self.n += size
            return self.file.read(size)

        def seek(self, at):
            return self.file.seek(at)

    chunked_wav(tmp_path / "big.wav", 16000, 1, range(30_000), before=b"JUNK" + struct.pack("<I", 1 << 20) + b"\0" * (1 << 20))
    with open(tmp_path / "big.wav", "rb") as f:
        counted = Counting(f)
        assert wav.read_header(counted) == (16000, 1, 2, 30_000) and counted.n < 100


def test_wav_files(spark, tmp_path):
    samples = [int(8000 * math.sin(k / 5)) for k in range(1600)]
    (tmp_path / "a.wav").write_bytes(wav.wav_bytes(16000, 1, samples))
    odd = b"LIST" + struct.pack("<I", 3) + b"abc\0"
    plain = wav.wav_bytes(8000, 2, [1, 2, 3, 4])
    (tmp_path / "b.wav").write_bytes(plain[:12] + odd + plain[12:])
    got = rows(wav.read_wavs(spark, str(tmp_path)).select("sample_rate", "channels", "samples"), "path")
    assert got == [(16000, 1, samples), (8000, 2, [1, 2, 3, 4])]
    p = wav.is_normalized(wav.probe(wav.list_wavs(spark, str(tmp_path)))).orderBy("path").first()
    assert (p.sample_rate, p.channels, p.sample_width, p.frame_count, p.duration_s, p.normalized) == (16000, 1, 2, 1600, 0.1, True)
    wav.register(spark)
    back = spark.read.format("wav").load(str(tmp_path))
    assert back.count() == 2
    out = tmp_path / "out"
    back.write.format("wav").mode("append").save(str(out))
    assert sorted(f.name for f in out.iterdir()) == ["a.wav", "b.wav"]
    assert (out / "a.wav").read_bytes() == wav.wav_bytes(16000, 1, samples)
    for bad in (b"nope", plain[:20] + struct.pack("<H", 3) + plain[22:]):
        with pytest.raises(ValueError):
            wav.parse_wav(bad)
    with pytest.raises(ValueError):
        wav.wav_bytes(8000, 1, [40_000])


def test_transcript_files(spark, tmp_path):
    (tmp_path / "t").mkdir()
    (tmp_path / "t/a.json").write_text('{"backend":"x","segments":[{"text":" hi ","start":1,"end_time":"2.5","speaker":0},{"text":"","start":3,"end":4}]}')
    (tmp_path / "t/b.json").write_text('[{"text":"yo","start_time":0,"end_time":1,"speaker_id":"7"}]')
    (tmp_path / "t/c.json").write_text('{"not_segments":"oops"}')
    assert rows(transcripts.segments(spark, str(tmp_path / "t"), drop_blank=True).select("speaker_id", "start_ms", "end_ms", "text"), "text") == [("0", 1000, 2500, "hi"), ("7", 0, 1000, "yo")]
    assert [r.valid for r in transcripts.documents(spark, str(tmp_path / "t")).orderBy("path").collect()] == [True, True, False]
    (tmp_path / "p").mkdir()
    (tmp_path / "p/one.json").write_text('{"id":"1","displayName":"Ana","embedding":[1,0]}')
    (tmp_path / "p/index.json").write_text('{"id":"index"}')
    (tmp_path / "p/bad.json").write_text('{"id": ')
    (tmp_path / "p/none.json").write_text('{"displayName":"x"}')
    assert rows(transcripts.profiles(spark, str(tmp_path / "p")).select("id", "displayName")) == [("1", "Ana")]
    for name, status, at in (("s1", "stopped", "2026-01-02"), ("s2", "recording", "2026-01-03")):
        (tmp_path / "v" / name).mkdir(parents=True)
        (tmp_path / "v" / name / "metadata.json").write_text(f'{{"title":"{name}","status":"{status}","started_at":"{at}"}}')
    (tmp_path / "v/s3").mkdir()
    (tmp_path / "v/s3/metadata.json").write_text("{")
    assert [r.title for r in transcripts.sessions(spark, str(tmp_path / "v")).collect()] == ["s2", "s1"]


def test_publish_and_upsert(spark, tmp_path):
    a = spark.createDataFrame([(1, "a"), (2, "b")], "id long, name string")
    transcripts.publish(a, str(tmp_path / "pub"), "r1")
    transcripts.publish(transcripts.upsert(a, spark.createDataFrame([(2, "c")], "id long, name string"), "id"), str(tmp_path / "pub"), "r2")
    assert rows(transcripts.read_published(spark, str(tmp_path / "pub")), "id") == [(1, "a"), (2, "c")]


def test_refused_and_withdrawn_publications(spark, tmp_path):
    root = str(tmp_path / "pub")
    rows_of = lambda n: spark.createDataFrame([(n,)], "id long")
    transcripts.publish(rows_of(1), root, "r1")
    with pytest.raises(ValueError):
        transcripts.publish(rows_of(2), root, "r2", valid=lambda df: df.where("id < 2").count() == df.count())
    assert rows(transcripts.read_published(spark, root)) == [(1,)]
    transcripts.publish(rows_of(3), root, "r3")
    assert rows(transcripts.read_published(spark, root)) == [(3,)] and transcripts.roll_back(spark, root) == "r1"
    assert rows(transcripts.read_published(spark, root)) == [(1,)]


def test_of_two_publications_at_once_one_wins(spark, tmp_path):
    root = str(tmp_path / "pub")
    rows_of = lambda n: spark.createDataFrame([(n,)], "id long")
    with pytest.raises(ValueError, match="nothing is published"):
        transcripts.read_published(spark, root)
    other = lambda df: transcripts.publish(rows_of(2), root, "faster") is not None
    with pytest.raises(RuntimeError, match="slower stays"):
        transcripts.publish(rows_of(1), root, "slower", valid=other)
    assert rows(transcripts.read_published(spark, root)) == [(2,)]
    (tmp_path / "pub/published/2").write_bytes(b"")  # a run that died as it was published
    assert rows(transcripts.read_published(spark, root)) == [(2,)]
    with pytest.raises(RuntimeError, match="remove it"):
        transcripts.publish(rows_of(3), root, "later")


def test_profile_store(spark, tmp_path):
    folder = str(tmp_path / "profiles")
    assert transcripts.profile_index(spark, folder).count() == 0
    columns = "id string, displayName string, createdAt string, updatedAt string, embeddingProvider string, embeddingModel string, embedding array<double>"
    p = spark.createDataFrame([(str(k), n, "c", "u", "bands", "v1", [1.0 * k]) for k, n in enumerate(["Ana 10", "ana 9", "Zoe", "Ben"])], columns)
    written = transcripts.save_profiles(p, folder)
    assert written.count() == 5 and sorted(f.name for f in (tmp_path / "profiles").iterdir()) == ["0.json", "1.json", "2.json", "3.json", "index.json"]
    index, back = transcripts.profile_index(spark, folder), transcripts.profiles(spark, folder)
    assert [r.displayName for r in transcripts.list_profiles(index).collect()] == ["ana 9", "Ana 10", "Ben", "Zoe"]
    assert [r.embedding for r in transcripts.list_profiles(index.where("id <> '2'"), back).collect()] == [[1.0], [0.0], [3.0]]
    change = spark.createDataFrame([("3", "Aaron"), ("9", "x")], "id string, new_name string")
    renamed = transcripts.rename(p, change, F.lit("now"))
    assert rows(renamed.where("id = '3'").select("displayName", "updatedAt", "createdAt")) == [("Aaron", "now", "c")] and renamed.count() == 4
    assert rows(transcripts.unknown_ids(p, change)) == [("9",)]
    assert [r.id for r in transcripts.list_profiles(transcripts.index_of(transcripts.remove(renamed, change))).collect()] == ["1", "0", "2"]


def test_energy_of_ranges_by_running_sums(spark):
    rng = np.random.default_rng(6)
    tracks = {"a": {k: int(rng.integers(-32768, 32767)) for k in range(70)}, "b": {k: int(rng.integers(-9, 9)) for k in (0, 3, 4, 40, 41, 42, 99)}}
    samples = spark.createDataFrame([(t, k, v) for t, x in tracks.items() for k, v in x.items()] + [("a", None, 5), ("b", 5, None)], "track string, idx long, value long")
    ranges = [(t, i, *sorted(map(int, rng.integers(-20, 130, 2)))) for t in "abc" for i in range(60)] + [("a", 100, 8, 16), ("a", 101, 5, 5), ("b", 102, 10, 39)]
    frame = spark.createDataFrame(ranges, "track string, id int, first long, last long")
    for block in (1, 8, 1024):
        found = pcm.energy_of_ranges(frame, pcm.energy_blocks(samples, block=block), block=block)
        assert found.columns == ["track", "id", "first", "last", "energy"]
        got = {(r.track, r.id): r.energy for r in found.collect()}
        assert len(got) == len(ranges)
        for t, i, a, b in ranges:
            x = [v for k, v in tracks.get(t, {}).items() if a <= k < b]
            want = np.sqrt(np.mean(np.square(np.array(x, float)))) / 32768 if x else None
            assert (got[t, i] is None) == (want is None) and (want is None or np.isclose(got[t, i], want, atol=1e-12)), (block, t, a, b)


def test_short_files_are_read_together_and_all_moved(spark, tmp_path, monkeypatch):
    df = spark.range(0, 600, 1, 6).select(F.concat("id", F.lit(".wav")).alias("path"), F.lit(8000).cast("long").alias("sample_rate"), F.lit(1).alias("channels"), F.lit(16).alias("bit_depth"), F.array(F.col("id").cast("int"), F.lit(-1)).alias("samples"))
    wav.register(spark)
    df.write.format("wav").mode("append").save(str(tmp_path))
    made = {f"{k}.wav": [k, -1] for k in range(600)}
    assert {f.name for f in tmp_path.iterdir()} == set(made)
    parts = wav._Reader(str(tmp_path)).partitions()
    assert [len(p.paths) for p in parts] == [512, 88]
    for back in (spark.read.format("wav").load(str(tmp_path)), wav.read_wavs(spark, str(tmp_path))):
        assert {r.path.rsplit("/", 1)[-1]: r.samples for r in back.collect()} == made
    assert wav.list_wavs(spark, str(tmp_path)).rdd.getNumPartitions() > 16 == wav.merged(wav.list_wavs(spark, str(tmp_path))).rdd.getNumPartitions()
