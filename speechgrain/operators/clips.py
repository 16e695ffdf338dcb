"""Choosing audio for clips, naming them, and telling where a profile came from."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def audio_for_source(rows: DataFrame, audio: DataFrame, by: str = "session_id") -> DataFrame:
    """``audio_path`` of each row's source: the same name, the same in other case, else the first file of the session.

    ``audio(by, ordinal, source, path)``. A session's files fit in one small array, so a row needs one join and no window.
    """
    files = audio.groupBy(by).agg(F.array_sort(F.collect_list(F.struct("ordinal", "source", "path"))).alias("_files"))
    joined = rows.join(files, by, "left")
    pick = lambda test: F.get(F.filter("_files", test), F.lit(0))["path"]
    exact = pick(lambda f: f["source"] == F.col("source"))
    folded = pick(lambda f: F.lower(f["source"]) == F.lower(F.col("source")))
    return joined.withColumn("audio_path", F.coalesce(exact, folded, F.get("_files", F.lit(0))["path"])).drop("_files")


#: Names of devices that carry a computer's own sound, in order of preference.
FALLBACK_DEVICES = ("BlackHole 2ch", "BlackHole", "Aggregate Device")


def fallback_device(devices: DataFrame, wanted: str | None = None) -> DataFrame:
    """The device asked for, else that of the first fallback name that finds one."""
    if wanted:
        return choose_device(devices, wanted)
    found = devices.withColumn("_rank", F.array_position(F.transform(F.array(*map(F.lit, FALLBACK_DEVICES)), lambda n: F.lower("name").contains(F.lower(n))), True))
    exact = F.element_at(F.array(*map(F.lit, FALLBACK_DEVICES)), F.col("_rank").cast("int")) == F.col("name")
    return found.where(F.col("_rank") > 0).orderBy("_rank", (~exact).cast("int"), "ordinal").limit(1).drop("_rank")


def choose_device(devices: DataFrame, wanted: str) -> DataFrame:
    """The device of that exact name, else the first whose name holds it in any case: ``devices(ordinal, name)``."""
    exact = F.col("name") == wanted
    held = F.lower("name").contains(wanted.lower())
    return devices.where(exact | held).orderBy((~exact).cast("int"), "ordinal").limit(1)


def seconds_json(ms: Column) -> Column:
    """Milliseconds as a JSON number of seconds: at least one decimal, no zeros behind it."""
    size = F.abs(ms.cast("long"))
    part = F.rtrim(F.lpad((size % 1000).cast("string"), 3, "0"), F.lit("0"))
    return F.concat(F.when(ms < 0, "-").otherwise(""), F.floor(size / 1000).cast("string"), F.lit("."), F.when(part == "", "0").otherwise(part))


def request_json(speaker_id: Column, source: Column, ranges: Column, sample_ms: Column, normalize: Column) -> Column:
    """One text for equal requests: keys in order, times in seconds. ``ranges`` is an array of (start_ms, end_ms).

    Ids and sources are quoted as ``to_json`` does, which agrees with other writers for ASCII texts.
    """
    pair = lambda r: F.concat(F.lit("["), seconds_json(r["start_ms"]), F.lit(","), seconds_json(r["end_ms"]), F.lit("]"))
    quoted = lambda c: F.regexp_extract(F.to_json(F.struct(c.cast("string").alias("v"))), r"(?s)^\{\"v\":(.*)\}$", 1)
    fields = {"normalize": normalize.cast("boolean").cast("string"), "ranges": F.concat(F.lit("["), F.array_join(F.transform(ranges, pair), ","), F.lit("]")), "sample_seconds": seconds_json(sample_ms), "source": quoted(source), "speaker_id": quoted(speaker_id)}
    return F.concat(F.lit("{"), F.concat_ws(",", *[F.concat(F.lit(f'"{k}":'), v) for k, v in fields.items()]), F.lit("}"))


def request_token(speaker_id: Column, source: Column, ranges: Column, sample_ms: Column, normalize: Column) -> Column:
    """Twelve hex digits that name the clip of a request; other requests never overwrite it."""
    return F.substring(F.sha1(request_json(speaker_id, source, ranges, sample_ms, normalize).cast("binary")), 1, 12)


def sample_name(speaker_id: Column, token: Column, normalize: Column) -> Column:
    """File name, without ending, of an enrolment sample."""
    return F.concat(F.lit("speaker-"), speaker_id.cast("string"), F.lit("-enroll-ranges-"), token, F.when(normalize, "-norm").otherwise("-raw"))


def clip_name(speaker_id: Column, most_ms: Column, normalize: Column) -> Column:
    """File name, without ending, of a clip of at most so long: whole seconds (ties to even), or ``all`` without a limit."""
    length = F.when(most_ms <= 0, "all").otherwise(F.concat(F.rint(most_ms / 1000).cast("long").cast("string"), F.lit("s")))
    return F.concat(F.lit("speaker-"), speaker_id.cast("string"), F.lit("-"), length, F.when(normalize, "-norm").otherwise("-raw"))


def provenance(chosen: DataFrame) -> DataFrame:
    """``chosen`` (rows of ``range_metadata`` with source, sample_path and sample_sha256) with a ``provenance`` document each."""
    second = lambda r: F.struct((r["start_ms"] / 1000.0).alias("start"), (r["end_ms"] / 1000.0).alias("end"))
    doc = F.struct("speaker_id", "source", "sample_path", "sample_sha256", "selected_segments", "selected_seconds", F.transform("requested_ranges", second).alias("requested_ranges"), F.transform("selected_ranges", second).alias("selected_ranges"))
    return chosen.withColumn("provenance", F.to_json(doc))


def file_hashes(files: DataFrame) -> DataFrame:
    """``binaryFile`` rows -> path, length and SHA-256."""
    return files.select("path", "length", F.sha2("content", 256).alias("sha256"))


def range_metadata(selected: DataFrame, requested: DataFrame, by: tuple[str, ...] = ("session_id", "speaker_id")) -> DataFrame:
    """Requested and selected ranges of each speaker as arrays, with the number and seconds of the selected ones."""
    pack = lambda name, a, b: F.array_sort(F.collect_list(F.struct(F.col(a).alias("start_ms"), F.col(b).alias("end_ms")))).alias(name)
    chosen = selected.groupBy(*by).agg(pack("selected_ranges", "start_ms", "end_ms"), F.count("*").alias("selected_segments"), F.round(F.sum(F.col("end_ms") - F.col("start_ms")) / 1000, 3).alias("selected_seconds"))
    asked = requested.groupBy(*by).agg(pack("requested_ranges", "range_start_ms", "range_end_ms"))
    return chosen.join(asked, list(by), "full")


def enrolment_outcome(requests: DataFrame, existing: DataFrame, dry_run: bool = False) -> DataFrame:
    """dry_run, skipped (the exact name exists), failed (no usable speech), error (the sample can't be made) or enrolled.

    ``requests(name, selected_seconds)``, and ``error`` if making samples was tried.
    """
    known = existing.select(F.col("display_name").alias("name")).distinct().withColumn("_known", F.lit(True))
    none = F.coalesce("selected_seconds", F.lit(0.0)) <= 0
    wrong = F.col("error").isNotNull() if "error" in requests.columns else F.lit(False)
    outcome = F.when(F.col("_known"), "skipped").when(none, "failed").when(wrong, "error").otherwise("dry_run" if dry_run else "enrolled")
    return requests.join(known, "name", "left").withColumn("outcome", outcome).drop("_known")


def session_note(sessions: DataFrame) -> DataFrame:
    """A Markdown note per session: title, status, times, files and attendees."""
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("")) if c in sessions.columns else F.lit("")
    people = F.array_join(F.transform("attendees", lambda a: F.when(a["address"] == "", a["name"]).otherwise(F.concat(a["name"], F.lit(" <"), a["address"], F.lit(">")))), ", ") if "attendees" in sessions.columns else F.lit("")
    files = F.transform("audio_files", lambda f: F.concat(F.lit("- "), f)) if "audio_files" in sessions.columns else F.array().cast("array<string>")
    lines = F.concat(F.array(F.concat(F.lit("# "), text("title")), F.lit("")), F.array(*[F.concat(F.lit(f"- {c}: "), text(c)) for c in ("status", "mode", "started_at", "ended_at")]), F.array(F.concat(F.lit("- attendees: "), people), F.lit(""), F.lit("## Audio"), F.lit("")), files)
    return sessions.withColumn("note", F.array_join(lines, "\n"))
