import numpy as np
import pytest
from pyspark.sql import functions as F

from speechgrain.operators import resample
from speechgrain.sources import wav
from conftest import rows


def plain_filter(x, up, down, zeros=resample.ZEROS):
    """Zeros between samples, one long filter, every down-th value."""
    bank, reach = resample.design(up, down, zeros)
    long = np.zeros(2 * (reach + 1) * up + 1)
    for p in range(up):
        for k, w in enumerate(bank[p]):
            long[(reach + 1) * up + p - (k - reach) * up] = w
    spread = np.zeros(len(x) * up)
    spread[::up] = x
    full = np.convolve(spread, long)[(reach + 1) * up :]
    return full[: len(spread)][::down]


@pytest.mark.parametrize(("source", "target"), [(3, 2), (2, 3), (44_100, 16_000), (8_000, 16_000), (48_000, 16_000)])
def test_blocks_equal_one_plain_filter(spark, source, target):
    rng, step = np.random.default_rng(source), np.gcd(source, target)
    tracks = {1: rng.normal(size=1000), 2: rng.normal(size=7), 3: np.ones(401)}
    df = spark.createDataFrame([(t, i, float(v)) for t, x in tracks.items() for i, v in enumerate(x)], "track int, idx long, value double").repartition(5)
    got = {}
    for t, i, v in rows(resample.polyphase_rows(df, source, target, block=200), "track", "idx"):
        got.setdefault(t, []).append((i, v))
    for t, x in tracks.items():
        want = plain_filter(x, target // step, source // step)
        assert [i for i, _ in got[t]] == list(range(-(-len(x) * target // source)))
        assert np.allclose([v for _, v in got[t]], want, atol=1e-9)


def level(frequency, source, target, n=8192):
    """The output's level in dB for a tone of level 0 dB, ends left out."""
    up, down = target // np.gcd(source, target), source // np.gcd(source, target)
    x = np.sin(2 * np.pi * frequency / source * np.arange(n)) * 2**0.5
    y = resample.filtered(x, 0, np.arange(n * up // down), int(up), int(down))
    inner = y[len(y) // 5 : -len(y) // 5]
    return 20 * np.log10(np.sqrt((inner**2).mean()) + 1e-12)


def test_tones_above_half_the_rate_vanish_and_lower_ones_stay():
    for source in (44_100, 48_000, 32_000):
        assert all(level(f, source, 16_000) < -60 for f in (8_000, 8_200, 9_000, 12_000, 15_000))
        assert all(abs(level(f, source, 16_000)) < 0.1 for f in (440, 1_000, 5_000, 6_500))


def test_cases_of_rate_conversion(spark):
    df = spark.createDataFrame([("a", 0, 5), ("a", 3, None), (None, 1, 7), ("b", None, 1)], "track string, idx int, value int")
    assert rows(resample.polyphase_rows(df, 7, 7), F.col("track"), "idx") == [(None, 1, 7.0), ("a", 0, 5.0), ("a", 3, 0.0)]
    assert resample.polyphase_rows(df.where("track = 'a'"), 2, 1).count() == 2
    assert resample.polyphase_rows(df.where("false"), 2, 1).count() == 0
    with pytest.raises(ValueError):
        resample.polyphase_rows(df, 0, 1)
    with pytest.raises(ValueError):
        resample.polyphase_rows(df, 3, 2, block=10)


def test_recordings_are_converted_to_one_channel(spark, tmp_path):
    rng = np.random.default_rng(1)
    stereo, fine, none = rng.integers(-9000, 9000, 2 * 900).tolist(), [1, -2, 3], []
    df = spark.createDataFrame(
        [("s.wav", 48_000, 2, 16, stereo), ("f.wav", 16_000, 1, 16, fine), ("e.wav", 8_000, 1, 16, none)], "path string, sample_rate long, channels int, bit_depth int, samples array<int>"
    )
    got = {r.path: r for r in resample.convert_recordings(df, block=256).collect()}
    assert all((r.sample_rate, r.channels) == (16_000, 1) for r in got.values())
    assert got["f.wav"].samples == fine and got["e.wav"].samples == []
    mono = np.floor(np.array(stereo).reshape(-1, 2).sum(axis=1) / 2)
    assert np.abs(np.array(got["s.wav"].samples) - plain_filter(mono, 1, 3)).max() <= 0.5
    wav.register(spark)
    resample.convert_recordings(df).write.format("wav").mode("append").save("file://" + str(tmp_path))
    assert sorted(r.samples for r in wav.read_wavs(spark, "file://" + str(tmp_path)).collect()) == sorted(r.samples for r in got.values())
