"""Adapters that shape the driver's tables like transcripts, samples, vectors and sessions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

PROVIDER, MODEL = "mean-pool", "v1"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def seg(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as segments: a user is a session, a type a speaker, the time since 2024 (divided by 1000) the start."""
    e = table(spark, sf_dir, "events")
    start = F.expr("timestampdiff(MILLISECOND, TIMESTAMP_NTZ'2024-01-01 00:00:00', ts) div 1000")
    return e.select(
        F.col("user_id").alias("session_id"),
        F.col("event_type").alias("speaker_id"),
        F.col("event_id").alias("seg_idx"),
        F.when(F.col("event_id") % 2 == 0, "mic").otherwise("system").alias("source"),
        start.alias("start_ms"),
        (start + F.floor(F.col("value") * 1000 + 0.5)).alias("end_ms"),
        F.when(F.col("event_type") == "error", F.concat(F.lit("["), F.col("event_type"), F.lit("]"))).otherwise(F.col("event_type")).alias("text"),
    )


def turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversation turns as segments of 1.5 s every 2.04 s."""
    c = table(spark, sf_dir, "conversations")
    return c.select(F.col("conv_id").alias("session_id"), F.col("turn").alias("seg_idx"), F.col("role").alias("speaker_id"), F.col("role").alias("source"), (F.col("turn") * 2040).alias("start_ms"), (F.col("turn") * 2040 + 1500).alias("end_ms"), "text", F.lit(None).cast("string").alias("speaker_name"))


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings").select("vec_id", "label", F.col("embedding").cast("array<double>").alias("embedding"))


def profiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The lowest vec_id of each label."""
    v = vectors(spark, sf_dir).groupBy("label").agg(F.min_by(F.struct("vec_id", "embedding"), "vec_id").alias("p"))
    return v.select(F.col("p.vec_id").alias("profile_id"), F.concat(F.lit("Label "), F.col("label").cast("string")).alias("display_name"), F.lit(PROVIDER).alias("provider"), F.lit(MODEL).alias("model"), F.col("p.embedding").alias("embedding"))


def candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All other vectors."""
    v = vectors(spark, sf_dir)
    firsts = v.groupBy("label").agg(F.min("vec_id").alias("vec_id")).select("vec_id")
    return v.join(firsts, "vec_id", "left_anti").select(F.col("vec_id").alias("candidate_id"), F.lit(PROVIDER).alias("provider"), F.lit(MODEL).alias("model"), "embedding")


def samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Event values as 16-bit samples of the track ``user``: centred at 50, times 400, clamped."""
    e = table(spark, sf_dir, "events")
    v = F.floor((F.col("value") - 50) * 400 + 0.5)
    idx = F.row_number().over(Window.partitionBy("user_id").orderBy("event_id")) - 1
    return e.select(F.col("user_id").alias("track"), idx.cast("long").alias("idx"), "event_id", F.least(F.greatest(v, F.lit(-32768)), F.lit(32767)).cast("long").alias("value"))


def sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as recording sessions."""
    o = table(spark, sf_dir, "orders")
    status = F.when(F.col("o_orderstatus") == "O", "stopped").when(F.col("o_orderstatus") == "P", "transcribing").otherwise(F.when(F.col("o_orderkey") % 3 == 0, "transcription_failed").otherwise("transcribed"))
    return o.select(
        F.col("o_orderkey").alias("session_id"),
        status.alias("status"),
        F.date_format(F.col("o_orderdate").cast("timestamp_ntz"), "yyyy-MM-dd").alias("started_at"),
        (F.col("o_orderkey") % 5 == 0).alias("has_transcript"),
        (F.col("o_totalprice") > 1000).alias("has_audio"),
        F.col("o_orderpriority").alias("title"),
    )
