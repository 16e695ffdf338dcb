"""Event-time windows and joins of streams, with watermarks; all state is in the JVM and is dropped as time passes.

A window is emitted once the watermark has passed it. A pair is emitted with the later of its two events; either side is kept
for as long as the other may still bring a partner. Rows older than the watermark are dropped by Spark, which counts them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

LATENESS = "10 minutes"


def activity(events: DataFrame, gap: str, *figures: Column, lateness: str = LATENESS) -> DataFrame:
    """``(session_id, start_ms, end_ms, n, *figures)``: stretches of ``events(session_id, at)`` without a pause of ``gap``."""
    found = events.withWatermark("at", lateness).groupBy("session_id", F.session_window("at", gap).alias("_w")).agg(F.count("*").alias("n"), *figures)
    rest = [c for c in found.columns if c not in ("session_id", "_w", "n")]
    return found.select("session_id", F.unix_millis("_w.start").alias("start_ms"), F.unix_millis("_w.end").alias("end_ms"), "n", *rest)


def paired(left: DataFrame, right: DataFrame, number: str, within_s: int, lateness: str = LATENESS) -> DataFrame:
    """``(session_id, left_id, right_id, after_ms)``: events of two tracks' streams of a session, at most ``within_s`` seconds apart."""
    a = left.select(F.col("session_id").alias("_sa"), F.col(number).alias("left_id"), F.col("at").alias("_a")).withWatermark("_a", lateness)
    b = right.select(F.col("session_id").alias("_sb"), F.col(number).alias("right_id"), F.col("at").alias("_b")).withWatermark("_b", lateness)
    far = F.expr(f"INTERVAL {int(within_s)} SECONDS")
    out = a.join(b, (F.col("_sa") == F.col("_sb")) & (F.col("_b") >= F.col("_a") - far) & (F.col("_b") <= F.col("_a") + far))
    return out.select(F.col("_sa").alias("session_id"), "left_id", "right_id", (F.unix_millis("_b") - F.unix_millis("_a")).alias("after_ms"))


def dropped(query: StreamingQuery) -> int:
    """Rows that a finished query dropped because they came after the watermark."""
    return sum(s.numRowsDroppedByWatermark for p in query.recentProgress for s in p.stateOperators)
