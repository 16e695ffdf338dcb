"""Transcript lines and documents."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from speechgrain.functions.text import seconds_2, source_label


def line() -> Column:
    """``[s.ss - e.ee] Source[ name or Speaker id]: text`` of a segment; a name beats the id."""
    who = F.when(F.coalesce("speaker_name", F.lit("")) != "", F.concat(F.lit(" "), F.col("speaker_name"))).when(F.col("speaker_id").isNotNull(), F.concat(F.lit(" Speaker "), F.col("speaker_id"))).otherwise(F.lit(""))
    return F.concat(F.lit("["), seconds_2(F.col("start_ms")), F.lit(" - "), seconds_2(F.col("end_ms")), F.lit("] "), source_label(F.col("source")), who, F.lit(": "), F.trim("text"))


def transcript(segments: DataFrame, order: str = "seg_idx") -> DataFrame:
    """One text per session, a line for each segment in order. A session is one recording, which bounds the list."""
    rows = segments.select("session_id", F.col(order).alias("_o"), line().alias("_l"))
    return rows.groupBy("session_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("_o", "_l"))), lambda x: x["_l"]), "\n").alias("text"))


def transcript_json(segments: DataFrame, backend: Column | None = None, by: tuple[str, ...] = ("session_id",)) -> DataFrame:
    """One JSON document per session: sources, duration, text, and segments in position order with times in seconds.

    With ``by`` of session and source there is one for each track."""
    seconds = lambda c: (F.col(c) / 1000.0)
    item = F.struct(F.col("position").alias("_o"), F.struct("text", seconds("start_ms").alias("start_time"), seconds("end_ms").alias("end_time"), (seconds("end_ms") - seconds("start_ms")).alias("duration"), "speaker_id", "source", "speaker_name").alias("s"))
    docs = segments.groupBy(*by).agg(
        F.transform(F.array_sort(F.collect_list(item)), lambda x: x["s"]).alias("segments"),
        F.array_sort(F.collect_set(F.col("source"))).alias("sources"),
        (F.max("end_ms") / 1000.0).alias("duration_seconds"),
    )
    doc = F.struct((F.lit("spark") if backend is None else backend).alias("backend"), "duration_seconds", "segments", "sources", F.array_join(F.transform("segments", lambda s: s["text"]), "\n").alias("text"))
    return docs.select(*by, F.to_json(doc).alias("json"))


def backends(headers: DataFrame) -> DataFrame:
    """The distinct backends of a session's tracks, sorted and joined by a plus."""
    return headers.groupBy("session_id").agg(F.array_join(F.array_sort(F.collect_set("backend")), "+").alias("backend"))


def header_text(h: dict[str, Column], body: Column) -> Column:
    """The text file of one track: a header of eight lines, a blank line, the body."""
    names = ("audio_file", "backend", "device", "model_path", "duration_seconds", "chunked", "generated_at", "segments")
    lines = [F.concat(F.lit(f"{n}: "), F.coalesce(h.get(n, F.lit(None)).cast("string"), F.lit("-"))) for n in names]
    return F.array_join(F.array(*lines, F.lit(""), body), "\n")
