"""Rate conversion by a polyphase filter bank over blocks of samples, and conversion of recordings to what models take.

A conversion from ``source`` to ``target`` is by ``up`` / ``down`` in lowest terms. The filter is a windowed sinc of ``ZEROS`` zero
crossings a side, on the grid of ``up`` times the source rate; its pass band ends so far below half the lower rate that the
window's slope (Blackman, -74 dB) is over there. Output ``m`` lies at ``m * down / up`` of the source: of the filter only each
``up``-th tap meets a sample, which makes a bank of ``up`` short filters, each scaled to a sum of 1.

Samples are rows or short arrays, so a track is never held whole: a block of ``block`` samples gets the samples around it that its
filters reach, and is convolved alone. Blocks are the groups that Spark shuffles; each sample goes to one block, near an edge to two.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache
from math import gcd

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

ZEROS, BLOCK = 32, 16_384
#: Width of the Blackman window's slope, in zero crossings.
SLOPE = 5.5


def design(up: int, down: int, zeros: int = ZEROS) -> tuple[np.ndarray, int]:
    """(bank[phase, tap], reach): the taps of phase p weigh the samples at -reach to reach around an output's place."""
    wide = max(up, down)
    half = zeros * wide
    cut = (0.5 - SLOPE / (4 * zeros)) / wide  # cycles a grid step; the slope ends at half the lower rate
    reach = -(-half // up)
    at = np.arange(up)[:, None] - np.arange(-reach, reach + 1)[None, :] * up  # from a sample to the output, in grid steps
    x = np.clip(at / half, -1, 1)
    window = 0.42 + 0.5 * np.cos(np.pi * x) + 0.08 * np.cos(2 * np.pi * x)
    bank = np.where(np.abs(at) < half, np.sinc(2 * cut * at) * window, 0.0)
    return bank / bank.sum(axis=1, keepdims=True), reach


_design = lru_cache(maxsize=8)(design)


def filtered(x: np.ndarray, first: int, outputs: np.ndarray, up: int, down: int, zeros: int = ZEROS) -> np.ndarray:
    """The values at ``outputs`` from samples ``x``, of which the first has number ``first``; what lies outside of them is silence."""
    bank, reach = _design(up, down, zeros)
    place = outputs * down // up - first
    padded = np.concatenate((np.zeros(reach), x, np.zeros(reach)))
    around = np.lib.stride_tricks.sliding_window_view(padded, 2 * reach + 1)
    out = np.zeros(len(outputs))
    for k in range(0, len(outputs), 4096):
        p = place[k : k + 4096]
        out[k : k + 4096] = np.einsum("ij,ij->i", around[p], bank[outputs[k : k + 4096] * down % up])
    return out


def polyphase_rows(samples: DataFrame, source: int, target: int, by: str = "track", block: int = BLOCK, zeros: int = ZEROS) -> DataFrame:
    """``(by, idx, value double)`` at rate ``target`` from ``samples(by, idx, value)`` at rate ``source``.

    A track of n samples (the largest idx and one) gives ceil(n * target / source) values. Missing and null samples are silence.
    """
    if source <= 0 or target <= 0:
        raise ValueError("rates must be positive")
    step = gcd(source, target)
    up, down = target // step, source // step
    plain = samples.where("idx is not null").select(F.col(by), F.col("idx").cast("long").alias("idx"), F.coalesce(F.col("value").cast("double"), F.lit(0.0)).alias("value"))
    if up == down:
        return plain
    reach = design(up, down, zeros)[1]
    if reach > block:
        raise ValueError("a block has to be longer than the filter's reach")
    sizes = plain.groupBy(by).agg((F.max("idx") + 1).alias("_n"))
    low, high = F.floor((F.col("idx") - reach) / block), F.floor((F.col("idx") + reach) / block)
    dealt = plain.withColumn("_block", F.explode(F.sequence(low, high))).groupBy(by, "_block").agg(F.collect_list(F.struct("idx", "value")).alias("_s"))
    ready = dealt.join(sizes, by).where("_block >= 0 and _block * {0} < _n".format(block)).select(by, "_block", "_n", F.col("_s.idx").alias("_i"), F.col("_s.value").alias("_v"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for key, number, n, i, v in batch.itertuples(index=False):
                begin, end = number * block, min((number + 1) * block, n)
                x = np.zeros(end - begin + 2 * reach)
                i, v = np.asarray(i), np.asarray(v, float)
                inside = i < end + reach
                x[i[inside] - begin + reach] = v[inside]
                outputs = np.arange(-(-begin * up // down), -(-end * up // down))
                yield pd.DataFrame({by: pd.Series([key] * len(outputs), dtype=batch[by].dtype), "idx": outputs, "value": filtered(x, begin - reach, outputs, up, down, zeros)})

    return ready.mapInPandas(run, f"{by} {dict(samples.dtypes)[by]}, idx long, value double")


def mono_rows(samples: DataFrame, channels: int, by: str = "track") -> DataFrame:
    """Interleaved rows ``(by, idx, value)`` averaged to one channel by whole division, downward; an unfinished frame is left out."""
    if channels == 1:
        return samples.select(by, F.col("idx").cast("long").alias("idx"), F.col("value").cast("long").alias("value"))
    frames = samples.groupBy(by, F.floor(F.col("idx") / channels).alias("_frame")).agg(F.sum("value").alias("_sum"), F.count("*").alias("_k"))
    return frames.where(F.col("_k") == channels).select(by, F.col("_frame").alias("idx"), F.floor(F.col("_sum") / channels).alias("value"))


def to_model_rate(samples: DataFrame, source: int, channels: int, target: int = 16_000, by: str = "track", block: int = BLOCK) -> DataFrame:
    """Interleaved 16-bit rows as one channel at ``target``, rounded and clamped to 16 bits."""
    out = polyphase_rows(mono_rows(samples, channels, by), source, target, by, block)
    return out.select(by, "idx", F.least(F.greatest(F.round("value"), F.lit(-32768)), F.lit(32767)).cast("long").alias("value"))


def convert_recordings(recordings: DataFrame, target: int = 16_000, block: int = BLOCK) -> DataFrame:
    """``(path, sample_rate, channels, bit_depth, samples)`` of 16-bit recordings as one channel at ``target``, as the ``wav`` source reads and writes them.

    What is mono and at that rate already passes as it is. The others are converted for each of their forms (rate and channels), of which there are few.
    """
    fine = (F.col("sample_rate") == target) & (F.col("channels") == 1)
    out = recordings.where(fine)
    forms = recordings.where(~fine).select("sample_rate", "channels").distinct().collect()
    for form in sorted(forms):
        of = recordings.where((F.col("sample_rate") == form.sample_rate) & (F.col("channels") == form.channels))
        rows = of.select("path", F.posexplode("samples").alias("idx", "value"))
        made = to_model_rate(rows, form.sample_rate, form.channels, target, "path", block)
        arrays = made.groupBy("path").agg(F.array_sort(F.collect_list(F.struct("idx", "value"))).alias("_s")).select("path", F.col("_s.value").cast("array<int>").alias("samples"))
        whole = of.select("path", "bit_depth").join(arrays, "path", "left").select("path", F.lit(target).cast("long").alias("sample_rate"), F.lit(1).alias("channels"), "bit_depth", F.coalesce("samples", F.array().cast("array<int>")).alias("samples"))
        out = out.unionByName(whole)
    return out
