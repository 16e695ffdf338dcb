"""Chunk windows of long recordings, and removal of segments that two overlapping chunks both produced."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from speechgrain.functions.text import _same_text, match_key, may_be_same, same_text

LENGTH_MS, OVERLAP_MS = 300_000, 15_000
NEAR_MS = 3_000
#: Stretches of time by which segments meet.
BUCKET_MS = 60_000


def windows(recordings: DataFrame, length_ms: int = LENGTH_MS, overlap_ms: int = OVERLAP_MS) -> DataFrame:
    """``recordings(..., duration_ms)`` -> a row for each chunk with chunk_idx, chunk_start_ms and chunk_end_ms.

    Chunks begin every ``length - overlap``; the last one ends with the recording. An empty recording has none.
    """
    if length_ms <= 0:
        raise ValueError("the chunk length must be positive")
    if not 0 <= overlap_ms < length_ms:
        raise ValueError("the overlap must be at least 0 and less than the chunk length")
    step, d = length_ms - overlap_ms, F.col("duration_ms")
    last = F.greatest(F.ceil((d - length_ms) / step), F.lit(0)).cast("long")
    idx = recordings.where(d > 0).select("*", F.explode(F.sequence(F.lit(0).cast("long"), last)).alias("chunk_idx"))
    return idx.withColumn("chunk_start_ms", F.col("chunk_idx") * step).withColumn("chunk_end_ms", F.least(F.col("chunk_start_ms") + length_ms, d))


def near_in_time(a: str, b: str) -> Column:
    """Starts or ends within 3 s, or overlapping; true if any of the four times is missing."""
    a0, a1, b0, b1 = (F.col(f"{s}.{c}") for s in (a, b) for c in ("start_ms", "end_ms"))
    close = (F.abs(a0 - b0) <= NEAR_MS) | (F.abs(a1 - b1) <= NEAR_MS) | (F.greatest(a0, b0) <= F.least(a1, b1))
    return F.when(a0.isNull() | a1.isNull() | b0.isNull() | b1.isNull(), F.lit(True)).otherwise(close)


def boundary_dedup(segments: DataFrame, overlap_ms: int = OVERLAP_MS, length_ms: int = LENGTH_MS, exact: bool = False) -> DataFrame:
    """Segments of all chunks (times on the recording's clock, with chunk_idx and chunk_start_ms) without boundary duplicates.

    A segment that ends within the overlap (plus 1 s) of its chunk goes if an earlier chunk has a duplicate that ends no
    earlier than overlap + 5 s before the chunk: the same, contained or similar text, near in time. With ``exact`` only equal
    texts count. What an earlier chunk lost can't matter while length > 3 * overlap + 6 s, so one anti-join is enough; for
    other settings each session is walked in order by a grouped function.
    """
    if length_ms <= 3 * overlap_ms + 6_000:
        return _in_order(segments, overlap_ms, exact)
    keyed = segments.withColumn("_match", match_key(F.col("text")))
    a, b = keyed.alias("a"), keyed.where("_match <> ''").alias("b")
    head = F.col("a.end_ms").isNotNull() & (F.col("a.end_ms") <= F.col("a.chunk_start_ms") + overlap_ms + 1_000) & (F.col("a._match") != "")
    recent = F.coalesce(F.col("b.end_ms"), F.lit(0)) >= F.greatest(F.lit(0), F.col("a.chunk_start_ms") - overlap_ms - 5_000)
    cond = (F.col("a.session_id") == F.col("b.session_id")) & (F.col("b.chunk_idx") < F.col("a.chunk_idx")) & head & recent & near_in_time("a", "b")
    if exact:
        return a.join(b, cond & (F.col("a._match") == F.col("b._match")), "left_anti").drop("_match")
    pairs = _near_pairs(a.where(head).select("a.*"), keyed.where("_match <> ''"), cond)
    gone = pairs.where(may_be_same(F.col("_x"), F.col("_y"))).where(same_text(F.col("_x"), F.col("_y"))).select("session_id", "chunk_idx", "seg_idx").distinct()
    return keyed.join(gone, ["session_id", "chunk_idx", "seg_idx"], "left_anti").drop("_match")


def _near_pairs(heads: DataFrame, others: DataFrame, cond: Column) -> DataFrame:
    """``(session_id, chunk_idx, seg_idx, _x, _y)``: pairs of a head and another segment for which ``cond`` holds.

    Segments that are near in time have a stretch of ``BUCKET_MS`` in common once heads are widened by 3 s, which is the key they
    meet by; a pair counts in its first one. Segments without all times are near to all, and meet by the session alone.
    """
    timed = lambda df: df.where("start_ms is not null and end_ms is not null")
    untimed = lambda df: df.where("start_ms is null or end_ms is null")
    low, high = F.least("start_ms", "end_ms"), F.greatest("start_ms", "end_ms")

    def dealt(df: DataFrame, wide: int) -> DataFrame:
        first = F.floor((low - wide) / BUCKET_MS)
        return timed(df).withColumn("_first", first).withColumn("_bucket", F.explode(F.sequence(first, F.floor((high + wide) / BUCKET_MS))))

    def joined(x: DataFrame, y: DataFrame, on: Column) -> DataFrame:
        out = x.alias("a").join(y.alias("b"), on & cond)
        return out.select(F.col("a.session_id").alias("session_id"), F.col("a.chunk_idx").alias("chunk_idx"), F.col("a.seg_idx").alias("seg_idx"), F.col("a._match").alias("_x"), F.col("b._match").alias("_y"))

    met = (F.col("a._bucket") == F.col("b._bucket")) & (F.col("a._bucket") == F.greatest("a._first", "b._first"))
    every = F.lit(True)
    return joined(dealt(heads, NEAR_MS), dealt(others, 0), met).unionByName(joined(untimed(heads), others, every)).unionByName(joined(timed(heads), untimed(others), every))


def _in_order(segments: DataFrame, overlap_ms: int, exact: bool) -> DataFrame:
    keyed = segments.withColumn("_match", match_key(F.col("text")))

    def missing(x) -> bool:
        return x is None or pd.isna(x)

    def near(a: dict, b: dict) -> bool:
        times = (a["start_ms"], a["end_ms"], b["start_ms"], b["end_ms"])
        if any(map(missing, times)):
            return True
        a0, a1, b0, b1 = times
        return abs(a0 - b0) <= NEAR_MS or abs(a1 - b1) <= NEAR_MS or max(a0, b0) <= min(a1, b1)

    def walk(pdf: pd.DataFrame) -> pd.DataFrame:
        kept: list[dict] = []
        out: list[int] = []
        for _, chunk in pdf.sort_values(["chunk_idx", "seg_idx"], kind="stable").groupby("chunk_idx", sort=True):
            begin = int(chunk["chunk_start_ms"].iloc[0])
            known = [k for k in kept if (0 if missing(k["end_ms"]) else k["end_ms"]) >= max(0, begin - overlap_ms - 5_000)]
            for i, row in zip(chunk.index, chunk.to_dict("records"), strict=True):
                tested = not missing(row["end_ms"]) and row["end_ms"] <= begin + overlap_ms + 1_000
                alike = (lambda x, y: bool(x) and x == y) if exact else (lambda x, y: _same_text(x, y, 0.85, 0.72))
                if tested and any(alike(row["_match"], k["_match"]) and near(row, k) for k in known):
                    continue
                kept.append(row)
                out.append(i)
        return pdf.loc[out]

    return keyed.groupBy("session_id").applyInPandas(walk, keyed.schema).drop("_match")
