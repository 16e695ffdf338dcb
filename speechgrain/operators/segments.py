"""Segments: normalising, shifting, merging tracks and writing labels back.

Canonical columns: session_id, track, seg_idx, speaker_id, start_ms, end_ms, text, source, speaker_name. Times are whole
milliseconds, so sums and comparisons are exact.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from speechgrain.functions.text import is_bracketed, is_useful

#: The alias columns that raw segments may use instead.
ALIASES = {"start_time": "start", "end_time": "end", "speaker_id": "speaker"}


def to_ms(seconds: Column) -> Column:
    """Whole milliseconds of a number of seconds, or null for what isn't a number."""
    return F.round(seconds.cast("string").try_cast("double") * 1000).cast("long")


def normalize(raw: DataFrame, drop_blank: bool = True) -> DataFrame:
    """Raw segments (aliases allowed, times in seconds of any type) -> canonical times in ``start_ms`` and ``end_ms``.

    ``duration_ms`` is the given duration, else end - start. With ``drop_blank`` rows of blank text go; without, none do.
    """
    pick = lambda name: F.coalesce(*[F.col(c) for c in (name, ALIASES.get(name, name)) if c in raw.columns] or [F.lit(None)])
    start, end = to_ms(pick("start_time")), to_ms(pick("end_time"))
    duration = F.coalesce(to_ms(F.col("duration")) if "duration" in raw.columns else F.lit(None).cast("long"), end - start)
    used = {*ALIASES, *ALIASES.values(), "duration", "text"}
    rest = [F.col(f"`{c}`") for c in raw.columns if c not in used]
    out = raw.select(*rest, pick("speaker_id").cast("string").alias("speaker_id"), start.alias("start_ms"), end.alias("end_ms"), duration.alias("duration_ms"), F.trim(F.coalesce("text", F.lit(""))).alias("text"))
    return out.where("text <> ''") if drop_blank else out


def shift(segments: DataFrame, offset_ms: Column | int) -> DataFrame:
    """Segments moved by an offset; a missing duration is filled first."""
    by = offset_ms if isinstance(offset_ms, Column) else F.lit(offset_ms)
    out = segments.withColumns({"start_ms": F.col("start_ms") + by, "end_ms": F.col("end_ms") + by})
    if "duration_ms" in segments.columns:
        out = out.withColumn("duration_ms", F.coalesce("duration_ms", F.col("end_ms") - F.col("start_ms")))
    return out


def speech_ms(clamped: bool = True) -> Column:
    d = F.col("end_ms") - F.col("start_ms")
    return F.greatest(F.coalesce(d, F.lit(0)), F.lit(0)) if clamped else d


def clusterable(min_ms: int = 1000) -> Column:
    """Segments that may be embedded: not bracketed, timed, and long enough."""
    return ~is_bracketed(F.col("text")) & F.coalesce(F.col("end_ms") - F.col("start_ms") >= min_ms, F.lit(False))


def merge_tracks(tracks: dict[str, DataFrame]) -> DataFrame:
    """The union of tracks with their names as ``source`` and a ``position`` by start, source and index within a session."""
    out = None
    for name, df in tracks.items():
        part = df.withColumn("source", F.lit(name))
        out = part if out is None else out.unionByName(part, allowMissingColumns=True)
    return with_position(out)


def with_position(segments: DataFrame) -> DataFrame:
    order = W.partitionBy("session_id").orderBy("start_ms", "source", "seg_idx")
    return segments.withColumn("position", F.row_number().over(order).cast("long"))


def fallback(tracks: DataFrame) -> DataFrame:
    """A row for each track that has text, over its whole length: ``tracks(session_id, source, text, duration_ms)``."""
    zero = F.lit(0).cast("long")
    return tracks.where(F.trim("text") != "").select("session_id", "source", zero.alias("seg_idx"), F.trim("text").alias("text"), zero.alias("start_ms"), F.coalesce("duration_ms", zero).cast("long").alias("end_ms"))


def text_fallback(segments: DataFrame, tracks: DataFrame) -> DataFrame:
    """``segments``, and for sessions without any the rows of ``fallback``."""
    empty = tracks.join(segments.select("session_id").distinct(), "session_id", "left_anti")
    return segments.unionByName(fallback(empty), allowMissingColumns=True)


def write_labels(segments: DataFrame, labels: DataFrame) -> DataFrame:
    """Speaker ids by position: ``labels(session_id, track, seg_idx, speaker_id)``. A track whose counts differ raises an error."""
    keys = ["session_id", "track"]
    counts = segments.groupBy(*keys).agg(F.count("*").alias("_n")).join(labels.groupBy(*keys).agg(F.count("*").alias("_m")), keys, "full")
    bad = counts.where(~F.col("_n").eqNullSafe(F.col("_m"))).agg(F.count("*").alias("_bad"))
    checked = labels.withColumnRenamed("speaker_id", "_label")
    out = segments.drop("speaker_id").join(checked, [*keys, "seg_idx"], "left").crossJoin(F.broadcast(bad))  # one row
    label = F.when(F.col("_bad") > 0, F.raise_error(F.lit("segment and label counts differ"))).otherwise(F.col("_label"))
    return out.withColumn("speaker_id", label).drop("_label", "_bad")


def stamp_names(segments: DataFrame, names: DataFrame, keys: tuple[str, ...] = ("session_id", "speaker_id")) -> DataFrame:
    """``speaker_name`` from ``names(*keys, speaker_name)``; null without a match. Keys should be unique in ``names``."""
    return segments.drop("speaker_name").join(names.select(*keys, "speaker_name"), list(keys), "left")


def flattened(segments: DataFrame) -> DataFrame:
    """Per session the plain text (blank lines between) and the labelled lines, null when there are none."""
    text = F.trim(F.coalesce("text", F.lit("")))
    mark = lambda c: F.coalesce((F.col(c) / 1000).cast("string"), F.lit("?"))
    times = F.when(F.col("start_ms").isNull() & F.col("end_ms").isNull(), F.lit("")).otherwise(F.concat(F.lit("["), mark("start_ms"), F.lit(" - "), mark("end_ms"), F.lit("] ")))
    line = F.when(F.col("speaker_id").isNull(), F.concat(times, text)).otherwise(F.concat(times, F.lit("Speaker "), F.col("speaker_id"), F.lit(": "), text))
    rows = segments.where(text != "").select("session_id", "seg_idx", text.alias("_t"), F.trim(line).alias("_l"))
    lists = rows.groupBy("session_id").agg(F.array_sort(F.collect_list(F.struct("seg_idx", "_t", "_l"))).alias("_all"))
    return lists.select("session_id", F.array_join("_all._t", "\n\n").alias("text"), F.nullif(F.array_join("_all._l", "\n"), F.lit("")).alias("diarised_text"))


def useful(segments: DataFrame) -> DataFrame:
    return segments.where(is_useful(F.col("text")))


def single_speaker_text(segments: DataFrame, speaker_id: str) -> DataFrame:
    rows = useful(segments.where(F.col("speaker_id") == speaker_id))
    return rows.groupBy("session_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("seg_idx", "text"))), lambda r: r["text"]), "\n").alias("text"))
