"""Flows of several operators: transcribing in chunks, merging tracks, naming speakers, suggesting labels, relabelling.

Steps that need audio or a model are hooks: functions from DataFrames to DataFrames, with a default each.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from speechgrain.functions import providers
from speechgrain.functions.text import device_error
from speechgrain.operators import chunks, clips, cluster, intervals, matching, pcm, render, segments, speakers
from speechgrain.sources.files import stored

GROUP = ["session_id", "speaker_id"]
Extract = Callable[[DataFrame], DataFrame]
Match = Callable[[DataFrame, DataFrame], DataFrame]


# --- transcribing ------------------------------------------------------------------------------------------------------


def retried_on_cpu(attempts: DataFrame, run: Callable[[DataFrame, str], DataFrame], device: str = "gpu", keys: list[str] | None = None) -> DataFrame:
    """``run(attempts, device)`` and, for those whose ``error`` is the device's time-out or want of memory, again on the CPU.

    ``run`` returns its rows with ``error`` (null if it worked) and is the provider's; other errors stay as they are. With ``keys``,
    which tell attempts apart, the rows need not carry the attempts' other columns.
    """
    first = run(attempts, device).withColumn("device", F.lit(device))
    again = device_error(F.col("error")).isNotNull() if device != "cpu" else F.lit(False)
    failed = first.where(again).select(*attempts.columns) if keys is None else attempts.join(first.where(again).select(*keys).distinct(), keys, "left_semi")
    return first.where(~again).unionByName(run(failed, "cpu").withColumn("device", F.lit("cpu")))


def merge_chunks(parts: DataFrame, overlap_ms: int = chunks.OVERLAP_MS, length_ms: int = chunks.LENGTH_MS, exact: bool = False) -> DataFrame:
    """Segments of all chunks of a recording as one list: ``parts(session_id, chunk_idx, chunk_start_ms, seg_idx, ...)`` with times
    on the chunk's own clock. Boundary duplicates go; ``position`` counts by start (none counts as 0), chunk and place.
    """
    moved = segments.shift(parts, F.col("chunk_start_ms"))
    kept = chunks.boundary_dedup(moved, overlap_ms, length_ms, exact)
    order = W.partitionBy("session_id").orderBy(F.coalesce("start_ms", F.lit(0)), "chunk_idx", "seg_idx")
    return kept.withColumn("position", F.row_number().over(order).cast("long"))


# --- extraction --------------------------------------------------------------------------------------------------------


def extract(asked: DataFrame, audio: DataFrame, provider: str = "bands", min_ms: int = 8_000) -> DataFrame:
    """``asked(session_id, speaker_id, source, ranges, speech_ms)`` with ``embedding`` and ``extraction`` (ok or too_short).

    ``audio(session_id, source, sample_rate, samples)``. Speech below ``min_ms``, and a session without any audio, are too
    short; a source that has no audio of its own takes the session's first.
    """
    files = audio.select("session_id", F.col("source").alias("path"), "source", F.row_number().over(W.partitionBy("session_id").orderBy("source")).alias("ordinal"))
    placed = clips.audio_for_source(asked, files)
    found = audio.select("session_id", F.col("source").alias("audio_path"), "sample_rate", "samples")
    seconds = F.transform("ranges", lambda r: F.struct((r["start_ms"] / 1000.0).alias("start"), (r["end_ms"] / 1000.0).alias("end")))
    short = (F.coalesce("speech_ms", F.lit(0)) < min_ms) | F.col("samples").isNull()
    joined = placed.join(found, ["session_id", "audio_path"], "left").withColumn("extraction", F.when(short, "too_short").otherwise("ok"))
    cut = F.when(F.col("extraction") == "ok", pcm.concat_ranges(F.col("samples"), seconds, F.col("sample_rate"), may_be_empty=True))
    embedded = providers.embed(joined.withColumn("samples", F.coalesce(cut, F.array().cast("array<bigint>"))), provider)
    return embedded.withColumn("embedding", F.when(F.col("extraction") == "ok", F.col("embedding"))).drop("samples", "sample_rate", "audio_path")


def clusters_of(rows: DataFrame, min_ms: int = intervals.MIN_MS) -> DataFrame:
    """Each speaker of a session with its source, segments, useful ranges in time order, and their speech."""
    about = speakers.summary(rows).select(*GROUP, "source", "segments")
    useful = intervals.speaker_ranges(rows, min_ms=min_ms)
    ranges = useful.groupBy(*GROUP).agg(F.array_sort(F.collect_list(F.struct("start_ms", "end_ms"))).alias("ranges"), F.sum(F.col("end_ms") - F.col("start_ms")).alias("speech_ms"))
    return about.join(ranges, GROUP, "left")


# --- suggestions -------------------------------------------------------------------------------------------------------


def by_score(threshold: float = matching.THRESHOLD, margin: float = matching.MARGIN) -> Match:
    """The matching hook that is used by default: best cosine against the profiles, with threshold and margin."""

    def match(candidates: DataFrame, profiles: DataFrame) -> DataFrame:
        return matching.best(candidates, profiles, threshold, margin)

    return match


def _matched(rows: DataFrame, keys: list[str], profiles: DataFrame, match: Match) -> DataFrame:
    """Extracted rows with the match of each; rows without an embedding have none."""
    named = rows.withColumn("candidate_id", F.to_json(F.struct(*keys)))
    usable = named.where("extraction = 'ok' and embedding is not null")
    found = match(usable.select("candidate_id", "provider", "model", "embedding"), profiles)
    return named.join(found.select("candidate_id", "profile_id", "display_name", "confidence", "margin", "status"), "candidate_id", "left").drop("candidate_id", "embedding")


def suggest_labels(rows: DataFrame, profiles: DataFrame, extract_cluster: Extract, extract_window: Extract | None = None, match: Match | None = None, n_windows: int = 0, has_profiles: bool = True) -> dict[str, DataFrame]:
    """Suggested labels for the clusters of sessions: ``clusters``, ``duplicates``, ``mixed`` and ``summary``.

    Groups ``rows`` by speaker, extracts an embedding for each (``extract_cluster`` adds provider, model, embedding and
    extraction to the clusters), matches it, and if ``n_windows`` does the same for as many windows of equal speech of each
    cluster. Clusters come in order of their ids as text, as ``position`` tells. Nothing is written.
    """
    match = match or by_score()
    found = _matched(extract_cluster(clusters_of(rows)), GROUP, profiles, match)
    name, profile = F.coalesce("display_name", F.lit("")), F.col("profile_id").cast("string")
    sure = F.coalesce(F.col("status") == "matched", F.lit(False)) if has_profiles else F.lit(False)
    reuse = F.concat(F.lit("Cluster "), F.col("speaker_id"), F.lit(" is "), name, F.lit(" ("), profile, F.lit(") with confidence "), F.format_number("confidence", 4), F.lit("; reuse the profile."))
    other = F.concat(F.lit("Cluster "), F.col("speaker_id"), F.lit(" has no confident match (status: "), F.coalesce("status", F.lit("no_match")), F.lit(")."))
    none = F.lit("No speaker profiles are enrolled yet.")
    shown = matching.suggestions(found.withColumn("status", F.when(F.lit(has_profiles), F.col("status")))) if has_profiles else found.withColumns({"recommendation": F.lit("no_profiles"), "profile_id": F.lit(None).cast(dict(found.dtypes)["profile_id"])})
    shown = shown.withColumn("detail", F.when(sure, reuse).otherwise(other) if has_profiles else none)
    shown = shown.withColumn("position", F.row_number().over(W.partitionBy("session_id").orderBy("speaker_id")).cast("long"))
    windows = None
    if n_windows > 0 and has_profiles:
        ranges = intervals.speaker_ranges(rows)
        parts = intervals.equal_speech_windows(ranges, n_windows)
        of = found.where("extraction = 'ok'").select(*GROUP, "source")
        asked = parts.join(of, GROUP).withColumn("ranges", F.array(F.struct((F.col("start_part") / n_windows).cast("long").alias("start_ms"), (F.col("end_part") / n_windows).cast("long").alias("end_ms"))))
        asked = asked.withColumn("speech_ms", F.expr("ranges[0].end_ms - ranges[0].start_ms"))
        windows = _matched((extract_window or extract_cluster)(asked), [*GROUP, "window"], profiles, match)
    empty = found.limit(0).withColumn("window", F.lit(0))
    mixed = matching.mixed_clusters(windows if windows is not None else empty)
    duplicates = matching.duplicate_groups(found) if has_profiles else matching.duplicate_groups(found.limit(0))
    return {"clusters": shown, "duplicates": duplicates, "mixed": mixed, "summary": matching.suggestion_summary(found, duplicates, mixed, has_profiles)}


def suggestion_json(parts: dict[str, DataFrame], config: dict[str, float]) -> DataFrame:
    """One document per session of ``suggest_labels``' parts: clusters in order, duplicate groups, mixed clusters, settings."""
    pack = lambda df, name, first: df.groupBy("session_id").agg(F.array_sort(F.collect_list(F.struct(first, *[c for c in df.columns if c not in (first, "session_id")]))).alias(name))
    out = pack(parts["clusters"].drop("ranges"), "clusters", "position").join(pack(parts["duplicates"], "duplicates", "profile_id"), "session_id", "left").join(pack(parts["mixed"], "mixed", "speaker_id"), "session_id", "left")
    settings = F.struct(*[F.lit(v).alias(k) for k, v in config.items()])
    return out.select("session_id", F.to_json(F.struct(F.lit(1).alias("schemaVersion"), settings.alias("config"), "clusters", "duplicates", "mixed")).alias("json"))


def confident_names(suggested: DataFrame) -> DataFrame:
    """Names to stamp on tentative clusters: those of confident matches only."""
    return suggested.where("status = 'matched'").select(*GROUP, F.col("display_name").alias("speaker_name"))


# --- clips -------------------------------------------------------------------------------------------------------------


def best_clips(rows: DataFrame, audio: DataFrame, max_ms: int = 60_000, normalize: bool = False, loudest: bool = True) -> DataFrame:
    """A clip of each speaker: ``(session_id, speaker_id, source, name, sample_rate, samples, ranges, clip_ms)``.

    The loudest of the speaker's ranges (or, without ``loudest``, the first) up to ``max_ms`` of speech, put together in order
    of time; with ``normalize`` lifted to the level of speech. ``audio`` is as in ``extract``. Speakers without audio have none.
    """
    known = clusters_of(rows).select(*GROUP, "source")
    files = audio.select("session_id", F.col("source").alias("path"), "source", F.row_number().over(W.partitionBy("session_id").orderBy("source")).alias("ordinal"))
    heard = audio.select("session_id", F.col("source").alias("audio_path"), "sample_rate", "samples")
    placed = clips.audio_for_source(known, files).join(heard, ["session_id", "audio_path"])
    seconds = lambda c: F.col(c) / 1000.0
    ranges = intervals.speaker_ranges(rows)
    if loudest:
        sound = ranges.join(placed.select(*GROUP, "sample_rate", "samples"), GROUP)
        scored = sound.withColumn("score", F.coalesce(pcm.range_energy(F.col("samples"), seconds("start_ms"), seconds("end_ms"), F.col("sample_rate")), F.lit(0.0)))
        ranges = intervals.best_energy(scored.select(*ranges.columns, "score"), max_ms)
    else:
        ranges = intervals.cap(ranges, max_ms)
    chosen = ranges.groupBy(*GROUP).agg(F.array_sort(F.collect_list(F.struct(seconds("start_ms").alias("start"), seconds("end_ms").alias("end")))).alias("ranges"), F.sum(F.col("end_ms") - F.col("start_ms")).alias("clip_ms"))
    cut = placed.join(chosen, GROUP).withColumn("samples", pcm.concat_ranges(F.col("samples"), F.col("ranges"), F.col("sample_rate"), may_be_empty=True)).where(F.size("samples") > 0)
    named = cut.withColumn("name", clips.clip_name(F.col("speaker_id"), F.lit(max_ms), F.lit(normalize)))
    if normalize:
        flat = named.select(F.concat_ws("/", *GROUP).alias("track"), F.posexplode("samples").alias("idx", "value"), "sample_rate")
        frame = F.floor(F.col("sample_rate") / 20)  # 50 ms
        loud = flat.select("track", F.col("value") / 32768.0, F.floor(F.col("idx") / F.greatest(frame, F.lit(1))).alias("frame"), F.greatest(frame, F.lit(1)).alias("n")).toDF("track", "value", "frame", "n")
        gains = pcm.loudness_of_frames(loud).select("track", pcm.speech_gain(F.col("loudness")).alias("gain"))
        lifted = lambda v: F.when(F.col("gain") == 1.0, v.cast("long")).otherwise(pcm.clamp16(F.rint(v * F.col("gain")).cast("long")))
        named = named.withColumn("track", F.concat_ws("/", *GROUP)).join(gains, "track").withColumn("samples", F.transform("samples", lifted))
    return named.select(*GROUP, "source", "name", "sample_rate", "samples", "ranges", "clip_ms")


# --- naming and relabelling --------------------------------------------------------------------------------------------


def transcribe_meeting(tracks: dict[str, DataFrame], vectors: dict[str, DataFrame], names: DataFrame | None = None, distance: float = cluster.DISTANCE) -> DataFrame:
    """Tracks diarised one after the other, their speakers numbered through, merged in order, and named.

    ``tracks`` has segments by source, ``vectors(session_id, seg_idx, embedding)`` their embeddings; a track's ids begin
    where those of the tracks before it end. Each track is written once as it is done. ``names(session_id, speaker_id, speaker_name)`` may name speakers.
    """
    done: dict[str, DataFrame] = {}
    offset: DataFrame | None = None
    for source, rows in tracks.items():
        found = cluster.diarize(rows, vectors[source], distance=distance)
        if offset is not None:
            found = found.join(offset, "session_id", "left").withColumn("assigned_id", (F.col("assigned_id").cast("int") + F.coalesce("id_offset", F.lit(0))).cast("string")).drop("id_offset")
        found = stored(found, "voices")  # else every use clusters again
        done[source] = found.drop("speaker_id").withColumnRenamed("assigned_id", "speaker_id")
        counted = cluster.track_offsets(found)
        offset = counted if offset is None else offset.unionByName(counted).groupBy("session_id").agg(F.sum("id_offset").alias("id_offset"))
    merged = segments.merge_tracks({k: v.drop("source") for k, v in done.items()})
    return segments.stamp_names(merged, names, ("session_id", "speaker_id")) if names is not None else merged


def relabelled(rows: DataFrame, ranges: DataFrame, by: list[str], name: str) -> DataFrame:
    """``rows`` with ``changed`` and the new name where a segment overlaps a range (see ``intervals.relabel``)."""
    before = rows if "speaker_name" in rows.columns else rows.withColumn("speaker_name", F.lit(None).cast("string"))
    after = intervals.relabel(before.withColumnRenamed("speaker_name", "_before").withColumn("speaker_name", F.lit(None).cast("string")), ranges, by, name)
    return after.withColumn("changed", F.col("speaker_name").isNotNull()).withColumn("speaker_name", F.coalesce("speaker_name", "_before")).drop("_before")


def relabel_outputs(rows: DataFrame) -> DataFrame:
    """What a relabelled session writes: ``(session_id, name, content, changed)`` for the merged JSON, its text, and each source's JSON.

    ``rows`` are of ``relabelled``. A session in which nothing changed writes nothing; sources' JSON files have their own segments.
    """
    hit = rows.groupBy("session_id").agg(F.count_if("changed").alias("changed")).where("changed > 0")
    placed = rows.withColumn("position", F.col("seg_idx"))
    text = render.transcript(rows).select("session_id", F.lit("transcript.md").alias("name"), F.concat(F.col("text"), F.lit("\n")).alias("content"))
    merged = render.transcript_json(placed).select("session_id", F.lit("transcript.json").alias("name"), F.col("json").alias("content"))
    item = F.struct("seg_idx", "text", (F.col("start_ms") / 1000.0).alias("start_time"), (F.col("end_ms") / 1000.0).alias("end_time"), "speaker_id", "source", "speaker_name")
    sources = rows.where("source is not null").groupBy("session_id", "source").agg(F.array_sort(F.collect_list(item)).alias("segments"), F.count_if("changed").alias("changed"))
    each = sources.select("session_id", F.concat(F.lit("transcript."), F.col("source"), F.lit(".json")).alias("name"), F.to_json(F.struct("segments")).alias("content"), "changed")
    return text.unionByName(merged).join(hit, "session_id").unionByName(each.join(hit.select("session_id"), "session_id", "left_semi"))


def artifact_path(source: Column) -> Column:
    """The name of a source's transcript beside the merged one."""
    return F.concat(F.lit("transcript."), source, F.lit(".json"))


def next_step(outcome: Column) -> Column:
    """What to do after an enrolment's outcome."""
    words = {"dry_run": "Run again without dry_run to enrol.", "skipped": "A profile of this name exists; choose another name.", "failed": "Choose ranges with more speech.", "error": "See the error; nothing was enrolled.", "enrolled": "Suggest labels again to use the profile."}
    return F.element_at(F.create_map(*[F.lit(x) for kv in words.items() for x in kv]), outcome)
