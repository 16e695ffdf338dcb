"""Per-speaker aggregates, the safety audit, the enrolment guard, and label assignment from clusters."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from speechgrain.functions.text import is_useful
from speechgrain.operators.intervals import GROUP, purity_windows, speaker_ranges, window_ends
from speechgrain.operators.segments import speech_ms

MIN_USEFUL_MS, MIXED_RATIO = 5_000, 3.0


def first_filled(c: str, order: str) -> Column:
    """The first value that is neither null nor empty."""
    v = F.nullif(F.col(c), F.lit(""))
    return F.min_by(v, F.when(v.isNotNull(), F.col(order)))


def summary(segments: DataFrame, examples: int = 3) -> DataFrame:
    """Counts, speech, source, name and the first useful texts of each speaker.

    Useful rows are numbered in a window on the same keys as the aggregate, so one shuffle serves both and the list of
    examples stays short whatever the group's size. Most useful speech first when sorted by ``summary_order``.
    """
    use = is_useful(F.col("text"))
    order = W.partitionBy(*GROUP).orderBy("seg_idx")
    name = F.col("speaker_name") if "speaker_name" in segments.columns else F.lit(None).cast("string")
    rows = segments.where("speaker_id is not null").select(*GROUP, "seg_idx", "source", name.alias("speaker_name"), "text", speech_ms().alias("_ms"), use.alias("_use"), F.sum(use.cast("int")).over(order).alias("_rank"))
    told = F.when(F.col("_use") & (F.col("_rank") <= examples), F.struct("seg_idx", "text"))
    return rows.groupBy(*GROUP).agg(
        F.count("*").alias("segments"),
        F.count_if("_use").alias("useful_segments"),
        F.sum("_ms").alias("speech_ms"),
        F.coalesce(F.sum(F.when(F.col("_use"), F.col("_ms"))), F.lit(0)).alias("useful_speech_ms"),
        F.coalesce(first_filled("source", "seg_idx"), F.lit("unknown")).alias("source"),
        first_filled("speaker_name", "seg_idx").alias("speaker_name"),
        F.transform(F.array_sort(F.collect_list(told)), lambda x: x["text"]).alias("examples"),
    )


def summary_order() -> list[Column]:
    return [F.desc("useful_speech_ms"), F.asc("speaker_id")]


def numeric_order(c: str = "speaker_id") -> list[Column]:
    """Numbers first by value, then other ids as text."""
    n = F.col(c).try_cast("int")
    return [n.isNull(), n, F.col(c)]


def stats(segments: DataFrame) -> DataFrame:
    return segments.groupBy(*GROUP).agg(F.count("*").alias("segments"), F.sum(speech_ms()).alias("speech_ms"))


def source_extent(segments: DataFrame) -> DataFrame:
    """Last end of each source of a session, and of the session."""
    by_source = segments.groupBy("session_id", F.coalesce("source", F.lit("unknown")).alias("source")).agg(F.max("end_ms").alias("source_end_ms"))
    return by_source.withColumn("session_end_ms", F.max("source_end_ms").over(W.partitionBy("session_id")))


def first_texts(segments: DataFrame, by: list[str], n: int = 3) -> DataFrame:
    order = W.partitionBy(*by).orderBy("seg_idx")
    return segments.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= n)


def dominant(segments: DataFrame, by: str = "session_id") -> DataFrame:
    """The speaker with the most speech; ties go to the lower number, then text."""
    totals = segments.where("speaker_id is not null").groupBy(by, "speaker_id").agg(F.sum(speech_ms()).alias("_ms"))
    order = W.partitionBy(by).orderBy(F.desc("_ms"), *numeric_order())
    return totals.withColumn("_r", F.row_number().over(order)).where("_r = 1").select(by, F.col("speaker_id").alias("dominant_id"))


def fill_labels(segments: DataFrame, by: str = "session_id") -> DataFrame:
    """Segments without a speaker take that of the nearest earlier one that has one, else the dominant speaker, else "0"."""
    order = W.partitionBy(by).orderBy("seg_idx").rowsBetween(W.unboundedPreceding, 0)
    return segments.withColumn("_last", F.last("speaker_id", ignorenulls=True).over(order)).join(dominant(segments, by), by, "left").withColumn("assigned_id", F.coalesce("_last", "dominant_id", F.lit("0"))).drop("_last", "dominant_id")


def sequential_labels(labelled: DataFrame, by: str = "session_id", label: str = "speaker_id") -> DataFrame:
    """``label_no``: labels numbered from 0 by first appearance."""
    first = labelled.where(F.col(label).isNotNull()).groupBy(by, label).agg(F.min("seg_idx").alias("_first"))
    numbers = first.withColumn("label_no", (F.row_number().over(W.partitionBy(by).orderBy("_first")) - 1).cast("long")).drop("_first")
    return labelled.join(numbers, [by, label], "left")


def safety(speech: Column, span: Column, early: Column, late: Column, min_useful_ms: int = MIN_USEFUL_MS, ratio: float = MIXED_RATIO) -> Column:
    """unknown, mixed_suspected or pure_likely from useful speech, its span, and which windows exist."""
    return F.when(F.coalesce(speech, F.lit(0)) < max(min_useful_ms, 1), "unknown").when(early & late & (span > ratio * speech), "mixed_suspected").otherwise("pure_likely")


#: Advice by status.
ADVICE = {
    "unknown": "Too little useful speech to assess this speaker.",
    "pure_likely": "Whole-cluster enrolment looks safe; preview it first.",
    "mixed_suspected": "Do not enrol the whole cluster; enrol confirmed ranges only.",
}


#: Why a speaker has its status; the figures themselves are columns of the audit.
REASONS = {
    "unknown": ("useful_speech_below_minimum",),
    "mixed_suspected": ("span_to_speech_ratio_exceeds_threshold", "distinct_early_and_late_windows_span_wide_timeline"),
    "pure_likely": ("span_to_speech_ratio_within_threshold", "no_widely_separated_window_pair"),
}


def reasons(status: Column, speech: Column) -> Column:
    """The reasons of a status as an array of codes; without any speech there is one of its own."""
    known = F.create_map(*[x for k, v in REASONS.items() for x in (F.lit(k), F.array(*map(F.lit, v)))])
    return F.when(F.coalesce(speech, F.lit(0)) <= 0, F.array(F.lit("no_useful_speech"))).otherwise(F.element_at(known, status))


def audit(segments: DataFrame, preview_ms: int = 12_000, min_useful_ms: int = MIN_USEFUL_MS, ratio: float = MIXED_RATIO, with_windows: bool = False) -> DataFrame:
    """The summary of each speaker with times, span, status, its reasons, and whether the whole cluster may be enrolled.

    ``with_windows`` adds the purity windows with their counts, which costs a join back to the ranges.
    """
    ranges = speaker_ranges(segments, useful_only=True)
    ends = window_ends(ranges, preview_ms).select(*GROUP, "first_ms", "middle_half_ms", "last_ms", F.col("speech_ms").alias("range_ms"), (F.col("last_ms") - F.col("first_ms")).alias("span_ms"), "has_e", "has_l")
    out = summary(segments).join(ends, list(GROUP), "left")
    if with_windows:
        windows = purity_windows(ranges, preview_ms).groupBy(*GROUP).agg(F.array_sort(F.collect_list(F.struct("start_half", "end_half", "label", "segment_count", "speech_half"))).alias("windows"))
        out = out.join(windows, list(GROUP), "left")
    false = F.lit(False)
    status = safety(F.col("range_ms"), F.col("span_ms"), F.coalesce("has_e", false), F.coalesce("has_l", false), min_useful_ms, ratio)
    advice = F.element_at(F.create_map(*[F.lit(x) for kv in ADVICE.items() for x in kv]), F.col("status"))
    return out.withColumn("status", status).withColumn("safe", F.col("status") == "pure_likely").withColumn("reasons", reasons(F.col("status"), F.col("range_ms"))).withColumn("recommendation", advice).drop("has_e", "has_l")


def all_safe(audited: DataFrame) -> DataFrame:
    return audited.groupBy("session_id").agg(F.coalesce(F.bool_and("safe"), F.lit(False)).alias("all_safe"))


def guard(requests: DataFrame, audited: DataFrame) -> DataFrame:
    """``requests(session_id, speaker_id)`` -> allow, warn or refuse, with a reason.

    A session without any audit, or an audit without the speaker, warns; a safe speaker is allowed, any other refused.
    """
    sessions = audited.select("session_id").distinct().withColumn("_audited", F.lit(True))
    found = requests.join(sessions, "session_id", "left").join(audited.select(*GROUP, "status", "safe"), list(GROUP), "left")
    decision = F.when(F.col("_audited").isNull() | F.col("status").isNull(), "warn").when(F.col("safe"), "allow").otherwise("refuse")
    reason = F.when(F.col("_audited").isNull(), "no_speaker_audit_found").when(F.col("status").isNull(), "speaker_not_in_audit").otherwise(F.concat(F.lit("audit_status_"), F.col("status")))
    return found.withColumn("decision", decision).withColumn("reason", reason).drop("_audited")


def listing(segments: DataFrame, audited: DataFrame, unnamed_only: bool = False) -> DataFrame:
    """Speakers with their audit status; with ``unnamed_only`` those that have no name."""
    out = summary(segments).drop("examples").join(audited.select(*GROUP, "status", "safe"), list(GROUP), "left")
    return out.where(F.coalesce("speaker_name", F.lit("")) == "") if unnamed_only else out


def names_before(segments: DataFrame) -> DataFrame:
    return segments.groupBy("session_id").agg(F.array_sort(F.collect_set(F.coalesce("speaker_name", F.lit("")))).alias("labels"))


