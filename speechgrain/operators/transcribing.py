"""Recordings to transcripts: one channel at the model's rate, pieces of long ones, the model as a hook, segments on one clock, files.

The model's rows are written once to the shared folder before anything looks at them, so that it never hears a piece twice; so
``transcribe`` and ``meeting`` run when they are called, up to that table. A piece is a row of its own and pieces are dealt
over all tasks, so the pieces of one long recording are heard at the same time.

Defined cases: an empty recording, a null one and one of rate 0 have no pieces and a transcript without text; a piece in which
nothing is heard gives no segments; a recording of which a piece fails has no transcript and stands in ``failed`` with the error of its
first such piece; paths have to be unique; extra columns of recordings are left out.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from speechgrain.operators import chunks, cluster, flows, pcm, render, resample, segments
from speechgrain.sources.files import as_text, stored

Recognise = Callable[[DataFrame, str], DataFrame]
#: Recordings below this length are heard whole.
TRIGGER_MS = 600_000
RATE = 16_000
PIECE = ["path", "chunk_idx"]


def _duration_ms(frames: Column) -> Column:
    return F.when(F.col("sample_rate") > 0, F.floor(frames * 1000 / F.col("sample_rate"))).otherwise(0)


def converted(recordings: DataFrame, target: int) -> DataFrame:
    """The recordings that have sound, as one channel at ``target``."""
    sound = recordings.where("samples is not null and sample_rate > 0 and channels > 0")
    return resample.convert_recordings(sound.select("path", "sample_rate", "channels", "bit_depth", "samples"), target)


def pieces(recordings: DataFrame, trigger_ms: int = TRIGGER_MS, length_ms: int = chunks.LENGTH_MS, overlap_ms: int = chunks.OVERLAP_MS) -> DataFrame:
    """``(path, chunk_idx, chunk_start_ms, chunk_end_ms, sample_rate, samples)`` of one-channel ``recordings(path, sample_rate, samples)``."""
    timed = recordings.where("samples is not null").select("path", "sample_rate", "samples", _duration_ms(F.size("samples")).alias("duration_ms"))
    zero = F.lit(0).cast("long")
    whole = timed.where((F.col("duration_ms") > 0) & (F.col("duration_ms") < trigger_ms)).select("*", zero.alias("chunk_idx"), zero.alias("chunk_start_ms"), F.col("duration_ms").alias("chunk_end_ms"))
    cut = whole.unionByName(chunks.windows(timed.where(F.col("duration_ms") >= trigger_ms), length_ms, overlap_ms))
    place = lambda c: F.floor(F.col(c) * F.col("sample_rate") / 1000)
    end = F.when(F.col("chunk_end_ms") == F.col("duration_ms"), F.size("samples")).otherwise(place("chunk_end_ms"))
    part = F.slice("samples", (place("chunk_start_ms") + 1).cast("int"), (end - place("chunk_start_ms")).cast("int"))
    return cut.select(*PIECE, "chunk_start_ms", "chunk_end_ms", "sample_rate", part.alias("samples")).repartition(*PIECE)


def transcribe(recordings: DataFrame, recognise: Recognise, device: str = "gpu", target: int = RATE, trigger_ms: int = TRIGGER_MS, length_ms: int = chunks.LENGTH_MS, overlap_ms: int = chunks.OVERLAP_MS, exact: bool = False) -> dict[str, DataFrame]:
    """``segments``, ``failed`` and ``documents`` of ``recordings(path, sample_rate, channels, bit_depth, samples)``.

    ``recognise(pieces, device)`` returns a row for each segment that it hears, with path, chunk_idx, chunk_start_ms, seg_idx, its times in
    seconds on the piece's clock (and the other fields of ``segments.normalize``), and ``error``, null; for a piece that fails it
    returns one row with ``error``. What fails for want of the device is heard again on the CPU.
    """
    asked = pieces(converted(recordings, target), trigger_ms, length_ms, overlap_ms)
    found = flows.retried_on_cpu(asked, lambda part, on: stored(recognise(part, on), "heard"), device, PIECE)
    failed = found.where("error is not null").groupBy("path").agg(F.min_by("error", "chunk_idx").alias("error"))
    good = found.where("error is null").drop("error").join(failed, "path", "left_anti")
    merged = flows.merge_chunks(segments.normalize(good).withColumnRenamed("path", "session_id"), overlap_ms, length_ms, exact)
    rows = merged.withColumnRenamed("session_id", "path")
    about = recordings.select("path", F.coalesce(_duration_ms(F.floor(F.size("samples") / F.col("channels"))), F.lit(0)).alias("duration_ms"))
    about = about.withColumn("duration_ms", F.greatest("duration_ms", F.lit(0))).join(failed, "path", "left_anti")
    return {"segments": rows, "failed": failed, "documents": documents(rows, about.withColumn("chunked", F.col("duration_ms") >= trigger_ms))}


def documents(rows: DataFrame, about: DataFrame) -> DataFrame:
    """``(path, duration_ms, chunked, segments, text, diarised_text, json, header)``: a transcript's JSON and its text with a header."""
    placed = rows.withColumn("session_id", F.col("path")).withColumn("seg_idx", F.col("position"))
    item = F.struct("position", "text", (F.col("start_ms") / 1000.0).alias("start_time"), (F.col("end_ms") / 1000.0).alias("end_time"), "speaker_id")
    listed = placed.groupBy("path").agg(F.array_sort(F.collect_list(item)).alias("_all"), F.count("*").alias("segments"))
    flat = segments.flattened(placed).withColumnRenamed("session_id", "path")
    out = about.join(listed, "path", "left").join(flat, "path", "left").withColumns({"segments": F.coalesce("segments", F.lit(0)), "text": F.coalesce("text", F.lit(""))})
    seconds = F.col("duration_ms") / 1000.0
    each = F.transform(F.coalesce("_all", F.array().cast(dict(listed.dtypes)["_all"])), lambda s: s.dropFields("position"))
    doc = F.struct(F.col("path").alias("audio_file"), seconds.alias("duration_seconds"), "chunked", "text", "diarised_text", each.alias("segments"))
    header = render.header_text({"audio_file": F.col("path"), "duration_seconds": seconds, "chunked": F.col("chunked"), "segments": F.col("segments")}, F.coalesce("diarised_text", "text"))
    return out.select("path", "duration_ms", "chunked", "segments", "text", "diarised_text", F.to_json(doc).alias("json"), header.alias("header"))


def meeting(tracks: DataFrame, recognise: Recognise, embed: Callable[[DataFrame], DataFrame], sources: tuple[str, ...] = ("mic", "system"), names: DataFrame | None = None, distance: float = cluster.DISTANCE, **settings) -> dict[str, DataFrame]:
    """``segments``, ``failed``, ``files`` of meetings ``tracks(session_id, source, sample_rate, channels, bit_depth, samples)``.

    All tracks are transcribed, each is diarised, speakers are numbered through in the order of ``sources``, tracks are merged
    by time, and speakers are named from ``names(session_id, speaker_id, speaker_name)``. ``embed(asked)`` adds ``embedding`` to
    ``asked(session_id, source, seg_idx, start_ms, end_ms)``. A meeting of which a track fails has no segments. ``files(path, content)`` are the
    text and JSON of each meeting, for ``files.write_files``. ``settings`` are those of ``transcribe``.
    """
    named = tracks.withColumn("path", F.to_json(F.struct("session_id", "source")))
    done = transcribe(named, recognise, **settings)
    of = named.select("path", "session_id", "source")
    failed = done["failed"].join(of, "path").select("session_id", "source", "error")
    rows = done["segments"].drop("session_id", "source", "seg_idx").join(of, "path").drop("path").withColumnRenamed("position", "seg_idx")
    rows = rows.join(failed.select("session_id").distinct(), "session_id", "left_anti").select("session_id", "source", "seg_idx", "speaker_id", "start_ms", "end_ms", "text")
    rows = stored(rows, "said")
    asked = rows.where(segments.clusterable()).select("session_id", "source", "seg_idx", "start_ms", "end_ms")
    vectors = stored(embed(asked).where("embedding is not null").select("session_id", "source", "seg_idx", "embedding"), "voices")
    own = lambda df, s: df.where(F.col("source") == s).drop("source")
    merged = flows.transcribe_meeting({s: own(rows, s) for s in sources}, {s: own(vectors, s) for s in sources}, names, distance)
    if names is None:
        merged = merged.withColumn("speaker_name", F.lit(None).cast("string"))
    folder = F.col("session_id").cast("string")
    text = as_text(render.transcript(merged, "position"), F.concat(folder, F.lit("/transcript.md")), F.col("text"))
    files = text.unionByName(as_text(render.transcript_json(merged), F.concat(folder, F.lit("/transcript.json")), F.col("json")))
    return {"segments": merged, "failed": failed, "files": files}


def mixed(tracks: DataFrame, first: str = "mic", second: str = "system", target: int = RATE, balanced: bool = True) -> DataFrame:
    """``(path, sample_rate, channels, bit_depth, samples)`` of each meeting's two tracks as one, converted before they are mixed; ``path`` is the session's."""
    one = converted(tracks.withColumn("path", F.to_json(F.struct("session_id", "source"))), target)
    rows = one.select(F.from_json("path", "session_id string, source string").alias("_p"), F.posexplode("samples").alias("idx", "value")).select(F.col("_p.session_id").alias("track"), "_p.source", "idx", "value")
    out = pcm.mix(*(rows.where(F.col("source") == s).drop("source") for s in (first, second)), balanced=balanced)
    whole = out.groupBy("track").agg(F.array_sort(F.collect_list(F.struct("idx", "value"))).alias("_s"))
    return whole.select(F.concat("track", F.lit("/mixed.wav")).alias("path"), F.lit(target).cast("long").alias("sample_rate"), F.lit(1).alias("channels"), F.lit(16).alias("bit_depth"), F.col("_s.value").cast("array<int>").alias("samples"))
