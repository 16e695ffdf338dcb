"""Sample arrays: loudness, mixing, resampling and features.

Two forms. Short arrays (a clip, a track held in a row) use higher-order functions on an array column. Long recordings are
rows of ``(track, idx, value)``, so that frames and mixes are ordinary aggregates and joins.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: Fixed values of levels: silence, percentiles of speech, frames; targets and limits of gain; gate and peak of mixing.
FLOOR, LOW, HIGH, LEAST_FRAMES = 0.002, 0.50, 0.95, 10
TARGET_DBFS, MOST_GAIN = -19.0, 40.0
GATE, PEAK, MIX_PEAK, MIX_GAIN = 32, 32767.0, 0.8, 16.0
DRIFT_S = 0.25
LOW_16, HIGH_16 = -32768, 32767


def clamp16(c: Column) -> Column:
    return F.least(F.greatest(c, F.lit(LOW_16)), F.lit(HIGH_16))


def round_away(c: Column) -> Column:
    """Nearest whole number of a double, halves away from zero."""
    return (F.signum(c) * F.floor(F.abs(c) + 0.5)).cast("long")


def scale16(c: Column, gain: Column | float) -> Column:
    """A sample times a gain, rounded away from zero at halves and clamped; a gain of 1 changes nothing."""
    g = gain if isinstance(gain, Column) else F.lit(float(gain))
    return F.when(g == 1.0, c.cast("long")).otherwise(clamp16(round_away(c.cast("double") * g)))


def linear(dbfs: float | Column) -> Column:
    return F.pow(F.lit(10.0), (dbfs if isinstance(dbfs, Column) else F.lit(float(dbfs))) / 20.0)


def float_to_16(c: Column) -> Column:
    """A float sample, clamped to [-1, 1]: negative times 32768, else times 32767, fraction cut."""
    v = F.greatest(F.least(c, F.lit(1.0)), F.lit(-1.0))
    return F.when(v < 0, v * 32768.0).otherwise(v * 32767.0).cast("int")


# --- rows of (by, idx, value) ------------------------------------------------------------------------------------------


def frame_rms(samples: DataFrame, frame: int, by: str = "track") -> DataFrame:
    """RMS of each whole frame of ``frame`` samples; an unfinished last frame is dropped."""
    return samples.groupBy(by, F.floor(F.col("idx") / frame).alias("frame")).agg(F.sqrt(F.avg(F.col("value") * F.col("value"))).alias("rms"), F.count("*").alias("_n")).where(F.col("_n") == frame).drop("_n")


def speech_loudness(samples: DataFrame, frame: int, by: str = "track", floor: float = FLOOR) -> DataFrame:
    """Loudness of speech: the RMS of frame RMS values between their median and 95th percentile, near silence left out.

    With fewer than ten audible frames it is the plain RMS. ``value`` is in [-1, 1].
    """
    rows = samples.select(by, "value", F.floor(F.col("idx") / frame).alias("frame"), F.lit(frame).alias("n"))
    return loudness_of_frames(rows, by, floor)


def loudness_of_frames(rows: DataFrame, by: str = "track", floor: float = FLOOR) -> DataFrame:
    """``speech_loudness`` of ``rows(by, value, frame, n)``: a sample, its frame, and the samples of a whole frame."""
    square = F.col("value") * F.col("value")
    frames = rows.groupBy(by, "frame").agg(F.sqrt(F.avg(square)).alias("rms"), F.count("*").alias("_n"), F.first("n").alias("_whole")).where((F.col("_n") == F.col("_whole")) & (F.col("rms") > floor))
    bounds = frames.groupBy(by).agg(F.percentile("rms", LOW).alias("_lo"), F.percentile("rms", HIGH).alias("_hi"), F.count("*").alias("frames"))
    inside = frames.join(bounds, by).where(F.col("rms").between(F.col("_lo"), F.col("_hi")))
    band = inside.groupBy(by).agg(F.sqrt(F.avg(F.col("rms") * F.col("rms"))).alias("_band"), F.max("frames").alias("frames"))
    plain = rows.groupBy(by).agg(F.sqrt(F.avg(square)).alias("_plain"))
    out = plain.join(band, by, "left")
    return out.select(by, F.coalesce("frames", F.lit(0)).cast("long").alias("frames"), F.when(F.coalesce("frames", F.lit(0)) < LEAST_FRAMES, F.col("_plain")).otherwise(F.col("_band")).alias("loudness"))


def speech_gain(loudness: Column, dbfs: float = TARGET_DBFS, most: float = MOST_GAIN) -> Column:
    """The factor that lifts speech to the target level: never below 1, at most ``most``, 1 for silence."""
    return F.when(F.coalesce(loudness, F.lit(0.0)) <= 1e-9, 1.0).otherwise(F.greatest(F.least(linear(dbfs) / loudness, F.lit(float(most))), F.lit(1.0)))


def normalize_speech(samples: DataFrame, frame: int, by: str = "track") -> DataFrame:
    """16-bit ``value`` of each track times its speech gain; rounding is to even at halves."""
    loud = speech_loudness(samples.withColumn("value", F.col("value") / 32768.0), frame, by)
    out = samples.join(loud.select(by, speech_gain(F.col("loudness")).alias("gain")), by)
    return out.withColumn("value", F.when(F.col("gain") == 1.0, F.col("value").cast("long")).otherwise(clamp16(F.rint(F.col("value") * F.col("gain")).cast("long"))))


def counts(samples: DataFrame, by: str = "track") -> DataFrame:
    """The number of samples of each track: ``(by, _size)``."""
    return samples.groupBy(by).agg(F.count("*").alias("_size"))


def resample_rows(samples: DataFrame, source: int, target: int, by: str = "track") -> DataFrame:
    """``resample`` of rows ``(by, idx, value)``: each sample makes the output places up to the next one, by linear interpolation.

    A row needs its successor and its track's length only, so no track is held whole.
    """
    if source == target:
        return samples.select(by, F.col("idx").cast("long").alias("idx"), F.col("value").cast("long").alias("value"))
    ratio = F.lit(float(target)) / source
    following = W.partitionBy(by).orderBy("idx")
    rows = samples.select(by, F.col("idx").cast("long").alias("_i"), F.col("value").cast("long").alias("_a"), F.lead("value").over(following).cast("long").alias("_b")).join(counts(samples, by), by)
    made = round_away(F.col("_size") * ratio)  # places in all; the last sample also makes those behind it
    first = F.greatest(F.ceil(F.col("_i") * ratio) - 1, F.lit(0))
    last = F.when(F.col("_b").isNull(), made - 1).otherwise(F.least(F.floor((F.col("_i") + 1) * ratio) + 1, made - 1))
    spread = rows.where(last >= first).select(by, "_i", "_a", "_b", F.explode(F.sequence(first.cast("long"), last.cast("long"))).alias("idx"))
    place = F.col("idx") / ratio
    mine = (F.floor(place) == F.col("_i")) | (F.col("_b").isNull() & (F.floor(place) > F.col("_i")))
    value = F.col("_a").cast("double") + F.coalesce(F.col("_b") - F.col("_a"), F.lit(0)).cast("double") * (place - F.col("_i"))
    return spread.where(mine).select(by, "idx", clamp16(round_away(value)).alias("value"))


#: Samples of a block of running sums.
ENERGY_BLOCK = 1024


def energy_blocks(samples: DataFrame, by: str = "track", block: int = ENERGY_BLOCK) -> DataFrame:
    """Running sums of squares: ``(by, block, before, before_n, places, sums)`` for ``samples(by, idx, value)``.

    ``before`` and ``before_n`` are the sum and number of all samples in earlier blocks of the track; ``places`` are the block's places
    that have a sample, ``sums`` the sums up to each of them, itself included. A track has a row a block in the window.
    """
    square = F.col("value").cast("long") * F.col("value").cast("long")
    rows = samples.where("idx is not null and value is not null").select(by, F.floor(F.col("idx") / block).alias("block"), F.pmod("idx", F.lit(block)).cast("int").alias("place"), square.alias("square"))
    held = rows.groupBy(by, "block").agg(F.array_sort(F.collect_list(F.struct("place", "square"))).alias("_s"))
    sums = F.aggregate("_s.square", F.array().cast("array<long>"), lambda a, x: F.concat(a, F.array(x + F.coalesce(F.try_element_at(a, F.lit(-1)), F.lit(0)))))
    made = held.select(by, "block", F.col("_s.place").alias("places"), sums.alias("sums"))
    earlier = W.partitionBy(by).orderBy("block").rowsBetween(W.unboundedPreceding, -1)
    total = lambda c: F.coalesce(F.sum(c).over(earlier), F.lit(0)).cast("long")
    return made.select(by, "block", total(F.element_at("sums", -1)).alias("before"), total(F.size("sums")).alias("before_n"), "places", "sums")


def energy_of_ranges(ranges: DataFrame, blocks: DataFrame, by: str = "track", block: int = ENERGY_BLOCK) -> DataFrame:
    """``ranges(by, first, last, ...)`` with ``energy``, the RMS of the samples from ``first`` to ``last`` - 1 on the scale of 1, or null if there are none.

    A range meets two blocks whatever its length, by track and block number: the last block that begins up to its end, and the one
    up to its begin. ``blocks`` come from ``energy_blocks``; what lies between existing blocks belongs to the one before.
    """
    # a block counts up to the next one of its track, so that every place has one row to look at
    following = F.lead("block").over(W.partitionBy(by).orderBy("block"))
    spans = blocks.withColumn("_until", F.coalesce(following, F.col("block") + 1))
    gaps = spans.where(F.col("_until") > F.col("block") + 1).select(by, F.explode(F.sequence(F.col("block") + 1, F.col("_until") - 1)).alias("block"), (F.col("before") + F.element_at("sums", -1)).alias("before"), (F.col("before_n") + F.size("sums")).alias("before_n"))
    none = F.array().cast("array<int>").alias("places"), F.array().cast("array<long>").alias("sums")
    every = blocks.unionByName(gaps.select(by, "block", "before", "before_n", *none))
    ends = blocks.groupBy(by).agg(F.max("block").alias("_top"), F.min("block").alias("_low"))
    placed = ranges.join(ends, by, "left")
    for end, at in (("lo", "first"), ("hi", "last")):
        # places beyond the track count as the end of its last block
        number = F.greatest(F.least(F.floor(F.col(at) / block), F.col("_top")), F.col("_low"))
        inside = F.col(at) - number * block
        found = every.select(by, F.col("block").alias("_b"), "before", "before_n", "places", "sums")
        k = F.size(F.filter("places", lambda p: p < F.col("_inside")))
        joined = placed.withColumns({"_b": number, "_inside": inside}).join(found, [by, "_b"], "left")
        placed = joined.withColumns({f"_{end}": F.col("before") + F.when(k > 0, F.try_element_at("sums", k)).otherwise(0), f"_{end}_n": F.col("before_n") + k}).drop("_b", "_inside", "before", "before_n", "places", "sums")
    n = F.col("_hi_n") - F.col("_lo_n")
    energy = F.when(n > 0, F.sqrt((F.col("_hi") - F.col("_lo")) / n) / 32768.0)
    return placed.withColumn("energy", energy).drop("_top", "_low", "_lo", "_hi", "_lo_n", "_hi_n")


def interleave_rows(channels: list[DataFrame], by: str = "track") -> DataFrame:
    """Frames of channels of rows ``(by, idx, value)``, up to the end of the shortest; one channel passes as it is."""
    n = len(channels)
    if n == 1:
        return channels[0].select(by, F.col("idx").cast("long").alias("idx"), "value")
    shortest = None
    for c in channels:
        size = counts(c, by)
        shortest = size if shortest is None else shortest.withColumnRenamed("_size", "_other").join(size, by).select(by, F.least("_size", "_other").alias("_size"))
    out = None
    for k, c in enumerate(channels):
        part = c.select(by, (F.col("idx").cast("long") * n + k).alias("idx"), "value", F.col("idx").alias("_frame"))
        out = part if out is None else out.unionByName(part)
    return out.join(shortest, by).where(F.col("_frame") < F.col("_size")).select(by, "idx", "value")


def band_rows(samples: DataFrame, bands: int = 13, by: str = "track") -> DataFrame:
    """``band_features`` of rows ``(by, idx, value)`` as ``(by, dim, feature)``: aggregates over bands, no track held whole."""
    numbered = samples.join(counts(samples, by), by).withColumn("_band", F.least(F.floor(F.col("idx") / F.greatest(F.floor(F.col("_size") / bands), F.lit(1))), F.lit(bands - 1)).cast("int"))
    sign = F.col("value") >= 0
    turned = sign != F.lag(sign).over(W.partitionBy(by, "_band").orderBy("idx"))
    rows = numbered.select(by, "_band", F.abs(F.col("value").cast("long")).alias("_size"), turned.alias("_turned"))
    found = rows.groupBy(by, "_band").agg((F.sum("_size") / F.count("*")).alias("_mean"), (F.count_if("_turned") / F.greatest(F.count("*") - 1, F.lit(1)) * 1000.0).alias("_turns"))
    # a short track has fewer bands than asked; the others are 0
    packed = found.groupBy(by).agg(F.map_from_entries(F.collect_list(F.struct("_band", F.struct("_mean", "_turns").alias("_f")))).alias("_all"), F.sqrt(F.sum(F.col("_mean") * F.col("_mean") + F.col("_turns") * F.col("_turns"))).alias("_length"))
    band = F.floor(F.col("dim") / 2).cast("int")
    of = F.try_element_at("_all", band)
    each = packed.select(by, "_all", "_length", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(2 * bands - 1).cast("long"))).alias("dim"))
    feature = F.coalesce(F.when(F.col("dim") % 2 == 0, of["_mean"]).otherwise(of["_turns"]), F.lit(0.0))
    return each.select(by, "dim", (feature / F.when(F.col("_length") > 0, F.col("_length")).otherwise(1.0)).alias("feature"))


def gated_rms(value: Column, gate: int = GATE) -> Column:
    """Aggregate: RMS of the samples of magnitude ``gate`` or more, else 0."""
    v = F.when(F.abs(value.cast("double")) >= gate, value.cast("double"))
    return F.coalesce(F.sqrt(F.avg(v * v)), F.lit(0.0))


def payload(samples: DataFrame, by: str = "track") -> DataFrame:
    """Non-zero samples and the peak magnitude, that of -32768 being 32767."""
    return samples.groupBy(by).agg(F.count_if(F.col("value") != 0).alias("non_zero"), F.max(F.least(F.abs(F.col("value").cast("long")), F.lit(HIGH_16))).alias("peak"))


def mix(left: DataFrame, right: DataFrame, by: str = "track", balanced: bool = False) -> DataFrame:
    """Two tracks of 16-bit ``(by, idx, value)`` added position by position, the shorter padded with zeros.

    Raw mixing clamps the sums. A balanced mix lifts the quieter track to the louder one's gated RMS, scales the sum so that
    it doesn't clip, and raises a quiet result to 80 % of full scale with a gain of 16 at most.
    """
    joined = left.select(by, "idx", F.col("value").cast("long").alias("a")).join(right.select(by, "idx", F.col("value").cast("long").alias("b")), [by, "idx"], "full")
    a, b = F.coalesce("a", F.lit(0)), F.coalesce("b", F.lit(0))
    if not balanced:
        return joined.select(by, "idx", clamp16(a + b).alias("value"))
    levels = joined.groupBy(by).agg(gated_rms(F.col("a")).alias("_ra"), gated_rms(F.col("b")).alias("_rb"))
    both = (F.col("_ra") > 0) & (F.col("_rb") > 0)
    gain_a = F.when(both & (F.col("_rb") > F.col("_ra")), F.col("_rb") / F.col("_ra")).otherwise(1.0)
    gain_b = F.when(both & (F.col("_ra") > F.col("_rb")), F.col("_ra") / F.col("_rb")).otherwise(1.0)
    lifted = joined.join(levels, by).select(by, "idx", (scale16(a, gain_a) + scale16(b, gain_b)).alias("_s"))
    peaks = lifted.groupBy(by).agg(F.max(F.abs("_s")).cast("double").alias("_p")).withColumn("_h", F.when(F.col("_p") > PEAK, PEAK / F.col("_p")).otherwise(1.0))
    summed = lifted.join(peaks, by).select(by, "idx", clamp16(round_away(F.col("_s").cast("double") * F.col("_h"))).alias("value"))
    tops = summed.groupBy(by).agg(F.max(F.abs("value")).cast("double").alias("_p"))
    gain = F.when((F.col("_p") > 0) & (F.col("_p") < PEAK * MIX_PEAK), F.least(F.lit(MIX_GAIN), PEAK * MIX_PEAK / F.col("_p"))).otherwise(1.0)
    return summed.join(tops, by).select(by, "idx", scale16(F.col("value"), gain).alias("value"))


def drift(left: DataFrame, right: DataFrame, by: str = "session_id", limit: float = DRIFT_S) -> DataFrame:
    """Recordings whose two tracks differ in length by more than ``limit`` seconds; both have ``duration_s``."""
    j = left.select(by, F.col("duration_s").alias("left_s")).join(right.select(by, F.col("duration_s").alias("right_s")), by)
    return j.withColumn("drift_s", F.abs(F.col("left_s") - F.col("right_s"))).where(F.col("drift_s") > limit)


# --- array columns -----------------------------------------------------------------------------------------------------


def slice_seconds(samples: Column, start: Column, end: Column, rate: Column | int) -> Column:
    """Samples from ``int(start * rate)`` up to ``int(end * rate)``, cut to the array."""
    first = F.least(F.greatest((start * rate).cast("long"), F.lit(0)), F.size(samples).cast("long"))
    last = F.least(F.greatest((end * rate).cast("long"), first), F.size(samples).cast("long"))
    return F.slice(samples, (first + 1).cast("int"), (last - first).cast("int"))


def concat_ranges(samples: Column, ranges: Column, rate: Column | int, may_be_empty: bool = False) -> Column:
    """The samples of all ranges (struct of start and end), in their order; empty ranges are skipped.

    Ranges that hold no sample at all raise, unless that ``may_be_empty``.
    """
    good = F.filter(ranges, lambda r: r["end"] > r["start"])
    out = F.flatten(F.transform(good, lambda r: slice_seconds(samples, r["start"], r["end"], rate)))
    return out if may_be_empty else F.when(F.size(out) == 0, F.raise_error(F.lit("no range holds any audio"))).otherwise(out)


def resample(samples: Column, source: Column, target: Column) -> Column:
    """Linear interpolation of 16-bit samples to another rate, with the last sample held at the end."""
    ratio = target.cast("double") / source
    n, last = round_away(F.size(samples) * ratio), F.size(samples) - 1

    def at(i: Column) -> Column:
        place = i / ratio
        k = F.least(F.floor(place), last.cast("long"))
        a, b = F.get(samples, k.cast("int")).cast("double"), F.get(samples, F.least(k + 1, last.cast("long")).cast("int")).cast("double")
        return clamp16(round_away(a + (b - a) * (place - k)))

    made = F.when(n > 0, F.transform(F.sequence(F.lit(0).cast("long"), F.greatest(n, F.lit(1)) - 1), at)).otherwise(F.array().cast("array<bigint>"))
    return F.when((source == target) | (F.size(samples) == 0), F.transform(samples, lambda v: v.cast("long"))).otherwise(made)


def interleave(channels: Column, n: int = 2) -> Column:
    """Frames of ``n`` channels from an array of channel arrays; one buffer passes as it is, missing channels repeat the last."""
    used = F.slice(channels, 1, n)
    frames = F.array_min(F.transform(used, lambda c: F.size(c)))
    k = F.size(used)
    rows = F.transform(F.sequence(F.lit(0), F.greatest(frames, F.lit(1)) - 1), lambda f: F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda c: F.get(F.get(used, F.least(c, k - 1)), f)))
    return F.when(F.size(channels) == 1, F.get(channels, F.lit(0))).when(frames > 0, F.flatten(rows))


def float_track(frames: Column, channels: int, source: Column | int, target: int = 16_000) -> Column:
    """Interleaved 16-bit samples as one channel of numbers in [-1, 1] at another rate, as models take it.

    Channels are averaged. Other rates are reached by linear interpolation over evenly spaced places from the first sample to
    the last; a rate that is reached already changes nothing.
    """
    n = F.floor(F.size(frames) / channels).cast("int")
    rate = source if isinstance(source, Column) else F.lit(source)
    mean = lambda i: F.aggregate(F.slice(frames, i * channels + 1, channels), F.lit(0.0), lambda t, x: t + x) / (channels * 32768.0)
    none = F.array().cast("array<double>")
    one = F.when(n > 0, F.transform(F.sequence(F.lit(0), F.greatest(n, F.lit(1)) - 1), mean)).otherwise(none)

    def resampled(x: Column) -> Column:
        size = F.size(x)
        out = F.rint(size * (F.lit(float(target)) / rate)).cast("int")

        def at(i: Column) -> Column:
            place = F.when(out > 1, i * (size - 1.0) / (out - 1)).otherwise(F.lit(0.0))
            k = F.least(F.floor(place).cast("int"), size - 1)
            a = F.get(x, k)
            return a + (F.get(x, F.least(k + 1, size - 1)) - a) * (place - k)

        return F.when((size == 0) | (rate == target), x).when(out < 1, none).otherwise(F.transform(F.sequence(F.lit(0), F.greatest(out, F.lit(1)) - 1), at))

    # the mean is bound once, as the only element of an array
    return F.get(F.transform(F.array(one), resampled), F.lit(0))


def rms(samples: Column) -> Column:
    total = F.aggregate(samples, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double"))
    return F.when(F.size(samples) > 0, F.sqrt(total / F.size(samples)))


def range_energy(samples: Column, start: Column, end: Column, rate: Column | int) -> Column:
    """RMS of a range of mono 16-bit samples on the scale of 1, or null if it has none."""
    return rms(slice_seconds(samples, start, end, rate)) / 32768.0


def mono(frames: Column, channels: int, truncate: bool = False) -> Column:
    """Interleaved samples averaged to one channel by whole division: toward zero, or downward as the readers do."""
    n = F.floor(F.size(frames) / channels).cast("int")

    def one(i: Column) -> Column:
        s = F.aggregate(F.slice(frames, i * channels + 1, channels), F.lit(0).cast("long"), lambda t, x: t + x)
        return (s / channels).cast("long") if truncate else F.floor(s / channels)

    return F.when(n > 0, F.transform(F.sequence(F.lit(0), F.greatest(n, F.lit(1)) - 1), one)).otherwise(F.array().cast("array<bigint>"))


def band_features(samples: Column, bands: int = 13) -> Column:
    """Mean magnitude and zero crossings (times 1000) of each of ``bands`` pieces, scaled to length 1.

    Pieces have ``max(1, n // bands)`` samples, the last one the rest; no samples give zeros.
    """
    n = F.size(samples)
    width = F.greatest(F.floor(n / bands), F.lit(1)).cast("int")

    def piece(i: Column) -> Column:
        part = F.when(i < bands - 1, F.slice(samples, i * width + 1, width)).otherwise(F.slice(samples, i * width + 1, F.greatest(n - i * width, F.lit(0))))
        return F.when(F.size(part) > 0, part).otherwise(F.array(F.lit(0).cast("long")))

    def two(part: Column) -> Column:
        size = F.size(part)
        mean = F.aggregate(part, F.lit(0).cast("long"), lambda s, x: s + F.abs(x)) / size
        signs = F.transform(part, lambda x: (x >= 0).cast("int"))
        turns = F.aggregate(F.zip_with(F.slice(signs, 1, F.greatest(size - 1, F.lit(0))), F.slice(signs, 2, F.greatest(size - 1, F.lit(0))), lambda x, y: (x != y).cast("int")), F.lit(0), lambda s, x: s + x)
        return F.array(mean.cast("double"), turns / F.greatest(size - 1, F.lit(1)) * 1000.0)

    longs = F.transform(F.sequence(F.lit(0), F.lit(bands - 1)), lambda i: two(piece(i)))
    flat = F.flatten(longs)
    size = F.sqrt(F.aggregate(flat, F.lit(0.0), lambda s, x: s + x * x))
    zeros = F.array_repeat(F.lit(0.0), 2 * bands)
    return F.when(n > 0, F.transform(flat, lambda x: x / F.when(size > 0, size).otherwise(1.0))).otherwise(zeros)
