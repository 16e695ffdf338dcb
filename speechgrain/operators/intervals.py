"""Time ranges: clipping, overlap, budgets and windows by cumulative speech.

Overlap joins carry equality keys (session, speaker or source) so that they hash; a bare range condition would be a nested
loop. Running sums partition by session and speaker, a unit that one recording bounds.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from speechgrain.functions.text import is_bracketed, is_useful

MIN_MS = 500
GROUP = ("session_id", "speaker_id")


def clip(segments: DataFrame, ranges: DataFrame, keys: list[str], min_ms: int = MIN_MS) -> DataFrame:
    """Every intersection of a segment with a range of the same ``keys`` that lasts ``min_ms``.

    ``ranges(*keys, range_start_ms, range_end_ms)``. Ranges that overlap each other give overlapping pieces, counted twice.
    """
    joined = segments.join(ranges, keys).withColumns({"clip_start_ms": F.greatest("start_ms", "range_start_ms"), "clip_end_ms": F.least("end_ms", "range_end_ms")})
    return joined.where(F.col("clip_end_ms") - F.col("clip_start_ms") >= min_ms)


def overlapping(segments: DataFrame, ranges: DataFrame, keys: list[str]) -> DataFrame:
    """Segments of the same ``keys`` that overlap some range; tags and silence included, untimed rows not."""
    s, r = segments.alias("s"), ranges.alias("r")
    same = [F.col(f"s.{k}") == F.col(f"r.{k}") for k in keys]
    cond = (F.col("s.start_ms") < F.col("r.range_end_ms")) & (F.col("s.end_ms") > F.col("r.range_start_ms"))
    for c in same:
        cond = cond & c
    return s.join(r, cond, "left_semi")


def relabel(segments: DataFrame, ranges: DataFrame, keys: list[str], name: str) -> DataFrame:
    """``speaker_name`` set to ``name`` on the segments that overlap a range; others keep theirs."""
    hit = overlapping(segments, ranges, keys).select("session_id", "seg_idx").withColumn("_hit", F.lit(True))
    old = F.col("speaker_name") if "speaker_name" in segments.columns else F.lit(None).cast("string")
    return segments.join(hit, ["session_id", "seg_idx"], "left").withColumn("speaker_name", F.when(F.col("_hit"), F.lit(name)).otherwise(old)).drop("_hit")


def speaker_ranges(segments: DataFrame, skip_bracketed: bool = True, useful_only: bool = False, min_ms: int = MIN_MS, ranges: DataFrame | None = None, keys: list[str] | None = None) -> DataFrame:
    """Timed ranges of at least ``min_ms`` for each speaker, optionally without tags and clipped to ``ranges``."""
    rows = segments
    if useful_only:
        rows = rows.where(is_useful(F.col("text")))
    elif skip_bracketed:
        rows = rows.where(~is_bracketed(F.col("text")))
    if ranges is not None:
        rows = clip(rows, ranges, keys or ["session_id", "speaker_id"], min_ms).withColumns({"start_ms": F.col("clip_start_ms"), "end_ms": F.col("clip_end_ms")})
    return rows.where(F.col("end_ms") - F.col("start_ms") >= min_ms).select(*GROUP, "seg_idx", "start_ms", "end_ms")


def running(ranges: DataFrame, order: tuple[str, ...] = ("start_ms", "end_ms", "seg_idx"), by: tuple[str, ...] = GROUP) -> DataFrame:
    """``ord``, ``before_ms`` (speech before the range) and ``total_ms`` of the group, in ``order``."""
    w = W.partitionBy(*by).orderBy(*order)
    d = F.col("end_ms") - F.col("start_ms")
    return ranges.select(
        "*",
        F.row_number().over(w).cast("long").alias("ord"),
        F.coalesce(F.sum(d).over(w.rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).cast("long").alias("before_ms"),
        F.sum(d).over(W.partitionBy(*by)).alias("total_ms"),
    )


def cap(ranges: DataFrame, max_ms: int, order: tuple[str, ...] = ("start_ms", "end_ms", "seg_idx"), by: tuple[str, ...] = GROUP) -> DataFrame:
    """Ranges in order until ``max_ms`` of speech, the last one cut; no limit if ``max_ms`` is 0 or less."""
    if max_ms <= 0:
        return ranges
    left = F.lit(max_ms) - F.col("before_ms")
    out = running(ranges, order, by).where(left > 0)
    return out.withColumn("end_ms", F.least(F.col("end_ms"), F.col("start_ms") + left)).drop("ord", "before_ms", "total_ms")


def time_at(target: Column, scale: int = 1) -> Column:
    """Aggregate over ``running`` rows: the time at which summed speech reaches ``target``, in ms times ``scale``."""
    start, end, before = (F.col(c) * scale for c in ("start_ms", "end_ms", "before_ms"))
    reached = before + (end - start) >= target
    return F.coalesce(F.min_by(F.when(reached, start + (target - before)), F.when(reached, F.col("ord"))), F.max_by(end, F.col("ord")))


def timestamps(ranges: DataFrame) -> DataFrame:
    """First start, time at half the speech (in half milliseconds), and last end of each speaker."""
    return running(ranges).groupBy(*GROUP).agg(*_times())


def _times() -> list[Column]:
    return [
        F.min_by("start_ms", "ord").alias("first_ms"),
        time_at(F.col("total_ms"), 2).alias("middle_half_ms"),
        F.max_by("end_ms", "ord").alias("last_ms"),
        F.max("total_ms").alias("speech_ms"),
    ]


def window_ends(ranges: DataFrame, preview_ms: int = 12_000, min_ms: int = MIN_MS) -> DataFrame:
    """``timestamps`` with the ends of the early, middle and late windows, in half milliseconds, and which of them stand.

    A window shorter than ``min_ms`` falls, and so does one whose ends both lie within ``min_ms`` of an earlier one's. One
    shuffle serves the running sums and the aggregate. Columns: _e0, _e1, _m0, ... and has_e, has_m, has_l.
    """
    budget, eps = max(100, preview_ms), 2 * min_ms
    total = F.col("total_ms")  # the half of the total is total in half milliseconds
    zero = F.lit(0).cast("long")
    found = running(ranges).groupBy(*GROUP).agg(
        *_times(),
        (F.min_by("start_ms", "ord") * 2).alias("_e0"),
        time_at(F.least(F.lit(2 * budget), 2 * total), 2).alias("_e1"),
        time_at(F.greatest(zero, total - budget), 2).alias("_m0"),
        time_at(F.least(2 * total, total + budget), 2).alias("_m1"),
        time_at(F.greatest(zero, 2 * total - 2 * budget), 2).alias("_l0"),
        (F.max_by("end_ms", "ord") * 2).alias("_l1"),
    )
    near = lambda a, b: (F.abs(F.col(f"_{a}0") - F.col(f"_{b}0")) < eps) & (F.abs(F.col(f"_{a}1") - F.col(f"_{b}1")) < eps)
    long = lambda a: F.col(f"_{a}1") - F.col(f"_{a}0") >= eps
    kept = found.withColumn("has_e", long("e")).withColumn("has_m", long("m") & ~(F.col("has_e") & near("m", "e")))
    return kept.withColumn("has_l", long("l") & ~(F.col("has_e") & near("l", "e")) & ~(F.col("has_m") & near("l", "m")))


def purity_windows(ranges: DataFrame, preview_ms: int = 12_000, min_ms: int = MIN_MS) -> DataFrame:
    """Early, middle and late windows of each speaker by cumulative speech, in half milliseconds.

    Columns: label, start_half, end_half, segment_count, speech_half.
    """
    eps = 2 * min_ms
    one = lambda label, a: F.when(F.col(f"has_{a}"), F.struct(F.lit(label).alias("label"), F.col(f"_{a}0").alias("start_half"), F.col(f"_{a}1").alias("end_half")))
    standing = F.filter(F.array(one("early", "e"), one("middle", "m"), one("late", "l")), lambda x: x.isNotNull())
    windows = window_ends(ranges, preview_ms, min_ms).select(*GROUP, F.explode(standing).alias("_w")).select(*GROUP, "_w.*")
    inside = F.least(F.col("end_ms") * 2, F.col("end_half")) - F.greatest(F.col("start_ms") * 2, F.col("start_half"))
    pieces = windows.join(ranges, list(GROUP)).withColumn("_in", inside)
    counted = F.when(F.col("_in") >= eps, F.col("_in"))
    return pieces.groupBy(*GROUP, "label", "start_half", "end_half").agg(F.count(counted).alias("segment_count"), F.coalesce(F.sum(counted), F.lit(0)).alias("speech_half"))


def equal_speech_windows(ranges: DataFrame, n: int, min_ms: int = MIN_MS) -> DataFrame:
    """``n`` windows of equal speech for each speaker, each a bounding range that may span gaps, in 1/n milliseconds.

    Window i runs from the first speech after (i - 1) / n of the total to the time at which i / n is reached.
    """
    rows = running(ranges)
    w = rows.select("*", F.explode(F.sequence(F.lit(1), F.lit(n))).alias("_i"))
    start, end, before = (F.col(c) * n for c in ("start_ms", "end_ms", "before_ms"))
    low, high = F.col("total_ms") * (F.col("_i") - 1), F.col("total_ms") * F.col("_i")
    after = before + (end - start)
    begins, stops = (after > low), (after >= high)
    out = w.groupBy(*GROUP, F.col("_i").alias("window")).agg(
        F.min_by(F.when(begins, start + F.greatest(low - before, F.lit(0))), F.when(begins, F.col("ord"))).alias("start_part"),
        F.min_by(F.when(stops, start + (high - before)), F.when(stops, F.col("ord"))).alias("end_part"),
    )
    return out.where(F.col("end_part") - F.col("start_part") >= min_ms * n)


def best_energy(ranges: DataFrame, max_ms: int, by: tuple[str, ...] = GROUP) -> DataFrame:
    """Ranges with a ``score``: the loudest first until ``max_ms``, returned in time order by their start."""
    return cap(ranges.withColumn("_quiet", -F.col("score")), max_ms, ("_quiet", "start_ms", "seg_idx"), by).drop("_quiet")
