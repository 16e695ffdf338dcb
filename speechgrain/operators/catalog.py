"""Session catalogue: calendar choice, pending sessions, boards, timeouts, lifecycle and recovery decisions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from speechgrain.functions.text import card_text, lane, note_link, seconds_between

LEAST_TIMEOUT, GRACE_S = 1800.0, 90
BUSY = ("recording", "transcribing")
#: Preferred order of audio files.
PREFERRED = ("mixed.wav", "mic.wav", "system.wav")


def transcription_timeout(longest: Column, explicit: Column | None = None) -> Column:
    """Seconds allowed: an explicit value, else four times the longest file and 300 s, at least 1800."""
    adaptive = F.greatest(F.lit(LEAST_TIMEOUT), 4.0 * longest + 300.0)
    return F.coalesce(*([explicit] if explicit is not None else []), F.when(longest.isNotNull(), adaptive), F.lit(LEAST_TIMEOUT))


def timeouts(files: DataFrame, by: str = "session_id") -> DataFrame:
    return files.groupBy(by).agg(F.max("duration_s").alias("longest_s")).withColumn("timeout_s", transcription_timeout(F.col("longest_s")))


def select_meeting(events: DataFrame, now: DataFrame, within_s: int, by: str) -> DataFrame:
    """The meeting to record for each ``by`` key at its ``now``, and the next one after it.

    ``events(by, event_id, start_s, end_s, is_all_day)``, ``now(by, now_s)``. A running meeting (start <= now < end) that
    started last wins, else the one that starts soonest within ``within_s``; ``next`` is the first to start at or after the
    end of the match, or after now without one. Ties go to the lower event id.
    """
    rows = events.where(~F.coalesce("is_all_day", F.lit(False)) & F.col("start_s").isNotNull() & F.col("end_s").isNotNull()).join(now, by)
    n, s, e = F.col("now_s"), F.col("start_s"), F.col("end_s")
    it = F.struct("event_id", "start_s", "end_s")
    current = (s <= n) & (n < e)
    soon = (s > n) & (s - n <= within_s)
    chosen = rows.groupBy(by).agg(
        F.min_by(F.when(current, it), F.when(current, F.struct(-s, F.col("event_id")))).alias("_c"),
        F.min_by(F.when(soon, it), F.when(soon, F.struct(s, F.col("event_id")))).alias("_u"),
    )
    base = now.join(chosen, by, "left").withColumn("_m", F.coalesce("_c", "_u"))
    base = base.withColumn("status", F.when(F.col("_c").isNotNull(), "current").when(F.col("_u").isNotNull(), "upcoming")).withColumn("_anchor", F.coalesce("_m.end_s", "now_s"))
    later = rows.join(base.select(by, "_anchor"), by).where(s >= F.col("_anchor"))
    following = later.groupBy(by).agg(F.min_by("event_id", F.struct("start_s", "event_id")).alias("next_id"))
    return base.join(following, by, "left").select(
        by,
        "now_s",
        "status",
        F.col("_m.event_id").alias("event_id"),
        F.when(F.col("status") == "upcoming", F.col("_m.start_s") - n).alias("starts_in_s"),
        F.when(F.col("status") == "current", F.col("_m.end_s") - n).alias("ends_in_s"),
        "next_id",
    )


def pending(sessions: DataFrame) -> DataFrame:
    """Sessions that are neither busy nor have a valid transcript."""
    return sessions.where(~F.coalesce("status", F.lit("")).isin(*BUSY) & ~F.coalesce("has_transcript", F.lit(False)))


def newest(sessions: DataFrame, limit: int = 20) -> DataFrame:
    return sessions.orderBy(F.desc_nulls_last("started_at"), "session_id").limit(limit)


def choose(sessions: DataFrame) -> DataFrame:
    """The newest pending session that has audio."""
    return newest(pending(sessions).where(F.coalesce("has_audio", F.lit(False))), 1)


#: A file is audio if it is longer than a bare header (when listed), or than a recorder's empty file (after recording).
HEADER_BYTES, EMPTY_BYTES = 44, 4096


def has_sound(files: DataFrame, least: int = EMPTY_BYTES) -> DataFrame:
    """Files longer than ``least`` bytes."""
    return files.where(F.col("length") > least)


def audio_order(files: DataFrame, least_bytes: int = HEADER_BYTES + 1) -> DataFrame:
    """``files(session_id, name, length)`` -> the names of each session in order of preference, empty files left out."""
    rank = F.coalesce(F.array_position(F.array(*map(F.lit, PREFERRED)), F.col("name")), F.lit(0))
    at = F.when(rank > 0, rank).otherwise(len(PREFERRED) + 1)
    return files.where(F.col("length") >= least_bytes).groupBy("session_id").agg(F.transform(F.array_sort(F.collect_list(F.struct(at.alias("at"), "name"))), lambda x: x["name"]).alias("audio_files"))


def growing(before: DataFrame, after: DataFrame) -> DataFrame:
    """Paths whose size differs between two listings, or that only one has."""
    j = before.select("path", F.col("length").alias("_a")).join(after.select("path", F.col("length").alias("_b")), "path", "full")
    return j.where(~F.col("_a").eqNullSafe(F.col("_b"))).select("path", F.col("_a").alias("before_bytes"), F.col("_b").alias("after_bytes"))


def board(sessions: DataFrame, vault: str = "") -> DataFrame:
    """Cards of each lane, newest first: ``sessions(session_id, session_dir, title, status, mode, started_at, ...)``.

    A lane may hold most sessions, so places are counted by day: sessions of a lane and day are numbered among themselves, after
    those of all later days, whose numbers come from one small table of lanes and days.
    """
    columns = {c: F.col(c).cast("string") for c in sessions.columns}
    mode = F.coalesce(columns["mode"], F.lit("unknown")) if "mode" in columns else F.lit("unknown")
    card = F.concat(F.lit("- [ ] "), note_link(columns["session_dir"], columns["title"], vault), F.lit(" — "), card_text(columns), F.lit(" — mode "), mode)
    at = F.coalesce(columns["started_at"], F.lit(""))
    rows = sessions.select(lane(F.col("status")).alias("lane"), at.alias("_at"), F.substring(at, 1, 10).alias("_day"), "session_id", card.alias("card"))
    later = W.partitionBy("lane").orderBy(F.desc("_day")).rowsBetween(W.unboundedPreceding, -1)
    days = rows.groupBy("lane", "_day").agg(F.count("*").alias("_n")).select("lane", "_day", F.coalesce(F.sum("_n").over(later), F.lit(0)).alias("_before"))
    within = W.partitionBy("lane", "_day").orderBy(F.desc("_at"), "session_id")
    numbered = rows.withColumn("_place", F.row_number().over(within)).join(days, ["lane", "_day"])
    return numbered.select("lane", "session_id", "card", (F.col("_before") + F.col("_place")).alias("place"))


def lane_counts(sessions: DataFrame) -> DataFrame:
    """Sessions and the newest start of each lane: combined before the shuffle, however many sessions a lane has."""
    return sessions.groupBy(lane(F.col("status")).alias("lane")).agg(F.count("*").alias("sessions"), F.max("started_at").alias("newest"), F.max_by("session_id", F.struct(F.col("started_at"), -F.col("session_id"))).alias("newest_id"))


def journal_action(entries: DataFrame) -> DataFrame:
    """Per journal and entry what to do: all replaced (flagged, or the new hash is in place) keeps; else roll back.

    ``entries(journal_id, name, existed, replaced, new_sha256, found_sha256)``.
    """
    done = F.coalesce("replaced", F.lit(False)) | F.coalesce(F.col("new_sha256") == F.col("found_sha256"), F.lit(False))
    rows = entries.withColumn("_done", done).withColumn("_all", F.bool_and("_done").over(W.partitionBy("journal_id")))
    action = F.when(F.col("_all"), "keep").when(~F.col("_done"), "none").when(F.coalesce("existed", F.lit(False)), "restore_backup").otherwise("remove")
    return rows.withColumn("action", action).drop("_done", "_all")


def resume_action(sessions: DataFrame) -> DataFrame:
    """finalize a valid staged output; accept a legacy one that is newer than the start; else interrupted. Live runs wait."""
    legacy = F.coalesce("legacy_valid", F.lit(False)) & (F.col("legacy_at") >= F.col("started_at"))
    action = F.when(F.col("status") != "transcribing", "none").when(F.coalesce("alive", F.lit(False)), "wait").when(F.coalesce("staged_valid", F.lit(False)), "finalize").when(F.coalesce(legacy, F.lit(False)), "accept_legacy").otherwise("mark_interrupted")
    return sessions.withColumn("action", action)


def foreign_runs(runs: DataFrame, owners: DataFrame) -> DataFrame:
    """Runs whose session another run owns: ``runs(session_id, run_id)``, ``owners(session_id, reserved_by, metadata_run)``."""
    j = runs.join(owners, "session_id", "left")
    mine = (F.col("reserved_by").eqNullSafe(F.col("run_id"))) | (F.col("metadata_run").eqNullSafe(F.col("run_id")))
    return j.where(~mine)


def fold_status(events: DataFrame) -> DataFrame:
    """The last status of each session by time, then event id: a batch fold that equals the streamed one."""
    return events.groupBy("session_id").agg(F.max_by("status", F.struct("at_ms", "event_id")).alias("status"), F.max("at_ms").alias("at_ms"), F.count("*").alias("events"))


def expire_scheduled(states: DataFrame, now_ms: Column, grace_s: int = GRACE_S) -> DataFrame:
    """Scheduled sessions whose start passed ``grace_s`` ago are cancelled."""
    late = (F.col("status") == "scheduled") & (now_ms >= F.col("at_ms") + 1000 * grace_s)
    return states.withColumn("status", F.when(late, "scheduled_cancelled").otherwise(F.col("status")))


def scheduled_start(text: Column, now: Column) -> Column:
    """``HH:MM[:SS]`` of the day of ``now``, or an ISO time; null unless it is in the future."""
    clock = text.rlike(r"^\d{1,2}:\d{2}(:\d{2})?$")
    padded = F.when(F.length(F.regexp_extract(text, r"^(\d+):", 1)) == 1, F.concat(F.lit("0"), text)).otherwise(text)
    at = F.when(clock, F.try_to_timestamp(F.concat(F.date_format(now, "yyyy-MM-dd "), padded))).otherwise(F.try_to_timestamp(text))
    return F.when(at > now, at)


def meeting_times(start: Column, end: Column, now: Column) -> Column:
    """Whole seconds to the start and to the end."""
    return F.struct(seconds_between(start, now).alias("starts_in_s"), seconds_between(end, now).alias("ends_in_s"))


# --- writing states ----------------------------------------------------------------------------------------------------

#: Statuses that may follow each other; None is a session that isn't there yet.
FOLLOW = {
    None: ("scheduled", "recording"),
    "scheduled": ("recording", "scheduled_cancelled", "recording_failed"),
    "recording": ("stopped", "recording_failed"),
    "stopped": ("transcribing",),
    "transcribing": ("transcribed", "transcription_failed", "transcription_interrupted"),
    "transcribed": ("transcribing",),
    "transcription_failed": ("transcribing",),
    "transcription_interrupted": ("transcribing", "transcribed"),
}


def may_follow(before: Column, after: Column) -> Column:
    """Whether a session may go from one status to another; final ones (failed or cancelled recordings) go nowhere."""
    out = F.lit(False)
    for status, next_ in FOLLOW.items():
        out = out | (before.eqNullSafe(F.lit(status)) & after.isin(*next_))
    return out


def refused_transitions(events: DataFrame) -> DataFrame:
    """Events whose status may not follow the one before it in the same session: ``events(session_id, event_id, at_ms, status)``."""
    order = W.partitionBy("session_id").orderBy("at_ms", "event_id")
    return events.withColumn("before", F.lag("status").over(order)).where(~may_follow(F.col("before"), F.col("status")))


#: The time column that a new status sets, and whether it ends a transcription, which then has no process any more.
STAMPS = {
    "scheduled": "scheduled_start_at", "recording": "started_at", "stopped": "ended_at", "transcribing": "transcription_started_at", "transcribed": "transcribed_at",
    "transcription_failed": "failed_at", "transcription_interrupted": "interrupted_at", "recording_failed": "failed_at", "scheduled_cancelled": "cancelled_at",
}
RUNNING = ("transcription_pid", "transcription_started_at")


def mark(sessions: DataFrame, changes: DataFrame) -> DataFrame:
    """``sessions`` with the new states of ``changes(session_id, status, at, reason, run_id, log_path)``, and ``refused``.

    A change sets the status, its time, its reason (of failures and cancellations) and log, and ends the process of a
    transcription that is over. It is refused if its run isn't the one that holds the session (a session without a run is
    anyone's, a change without a run is trusted) or the status may not follow. A session has at most one change.
    """
    table = {c: F.col(f"s.`{c}`") for c in sessions.columns}
    had = lambda c: table.get(c, F.lit(None).cast("string"))
    own = F.col("c.run_id").isNull() | had("run_id").isNull() | (had("run_id") == F.col("c.run_id"))
    asked = F.col("c.status").isNotNull()
    good = asked & own & may_follow(had("status"), F.col("c.status"))
    new = {"status": F.when(good, F.col("c.status")).otherwise(had("status"))}
    for status, column in STAMPS.items():
        new[column] = F.when(good & (F.col("c.status") == status), F.col("c.at")).otherwise(new.get(column, had(column).cast("string")))
    failed, cancelled = F.col("c.status").isin("recording_failed", "transcription_failed"), F.col("c.status") == "scheduled_cancelled"
    new["failure_reason"] = F.when(good & failed, F.col("c.reason")).otherwise(had("failure_reason"))
    new["cancel_reason"] = F.when(good & cancelled, F.col("c.reason")).otherwise(had("cancel_reason"))
    new["transcription_log_path"] = F.when(good & F.col("c.log_path").isNotNull(), F.col("c.log_path")).otherwise(had("transcription_log_path"))
    over = good & F.col("c.status").isin("transcribed", "transcription_failed", "transcription_interrupted")
    for column in RUNNING:
        new[column] = F.when(~F.coalesce(over, F.lit(False)), new.get(column, had(column).cast("string")))
    joined = sessions.alias("s").join(changes.alias("c"), F.col("s.session_id") == F.col("c.session_id"), "left")
    rest = [x.alias(c) for c, x in table.items() if c not in new]
    return joined.select(*rest, *[x.alias(c) for c, x in new.items()], (asked & ~F.coalesce(good, F.lit(False))).alias("refused"))


def session_end(sessions: DataFrame, files: DataFrame) -> DataFrame:
    """``sessions`` with ``ended_at``: the one they have, else the time of their newest file, else now.

    ``files(session_id, modified timestamp)``; times are in the session's zone, to the second.
    """
    newest_file = files.groupBy("session_id").agg(F.max("modified").alias("_newest"))
    text = lambda t: F.date_format(t, "yyyy-MM-dd'T'HH:mm:ssxxx")
    known = F.nullif(F.col("ended_at").cast("string"), F.lit("")) if "ended_at" in sessions.columns else F.lit(None).cast("string")
    out = sessions.join(newest_file, "session_id", "left")
    return out.withColumn("ended_at", F.coalesce(known, text(F.col("_newest")), text(F.current_timestamp()))).drop("_newest")


def audio_source(sessions: DataFrame, limit_s: float = 0.25) -> DataFrame:
    """What to transcribe: the mixed track if mixing worked, else the microphone with a note; with a note on drift.

    ``sessions(session_id, mic, system, mixed, mix_error, mic_s, system_s)`` has paths and lengths.
    """
    mixed = F.col("mix_error").isNull() & F.col("mixed").isNotNull()
    gap = F.abs(F.col("mic_s") - F.col("system_s"))
    note = F.concat(F.lit("Mixed track unavailable ("), F.coalesce("mix_error", F.lit("no mixed file")), F.lit("); transcribing the microphone instead."))
    drift = F.concat(F.lit("The tracks differ in length by "), F.format_number(gap, 2), F.lit(" s."))
    return sessions.withColumns({
        "audio": F.when(mixed, F.col("mixed")).otherwise(F.col("mic")), "outputs": F.when(mixed, F.array("mic", "system", "mixed")).otherwise(F.array("mic", "system")),
        "note": F.when(~mixed, note), "drift_note": F.when(mixed & (gap > limit_s), drift),
    })


#: Codes of calendar failures that the answer itself doesn't name.
NO_CONNECTOR, TOO_LATE, FAILED, NO_JSON, REPORTED = "outlook_not_found", "timeout", "calendar_failed", "bad_json", "calendar_error"


def calendar_events(answers: DataFrame) -> DataFrame:
    """Events and error codes of a calendar connector's answers: ``answers(answer_id, outcome, exit_code, stdout)``.

    ``outcome`` is ``missing`` or ``timeout`` where the connector gave no answer. Each answer has a row for each event, or one
    row with an error code. An answer that is a JSON object without a true ``ok`` reports its own code.
    """
    event = "struct<subject:string,start:string,end:string,is_all_day:boolean>"
    body = F.from_json("stdout", f"struct<ok:boolean,data:array<{event}>,error:struct<code:string,message:string>>")
    rows = answers.withColumn("_v", F.try_parse_json("stdout")).withColumn("_b", body)
    error = (
        F.when(F.col("outcome") == "missing", NO_CONNECTOR)
        .when(F.col("outcome") == "timeout", TOO_LATE)
        .when(F.coalesce("exit_code", F.lit(0)) != 0, FAILED)
        .when(F.col("_v").isNull(), NO_JSON)
        .when(~F.coalesce("_b.ok", F.lit(False)), F.coalesce("_b.error.code", F.lit(REPORTED)))
    )
    told = rows.withColumn("error", error).select("answer_id", "error", F.posexplode_outer(F.when(F.col("error").isNull(), F.col("_b.data"))).alias("event_no", "_e"))
    time = lambda c: F.try_to_timestamp(F.col(f"_e.{c}"))
    return told.select("answer_id", "error", "event_no", F.when(F.col("event_no").isNotNull(), F.coalesce("_e.subject", F.lit("(untitled)"))).alias("subject"), time("start").alias("start"), time("end").alias("end"), F.coalesce("_e.is_all_day", F.lit(False)).alias("is_all_day"))


# --- outputs of a run --------------------------------------------------------------------------------------------------

#: Files of a transcript.
TEXT_FILE, JSON_FILE = "transcript.md", "transcript.json"


def well_formed(content: Column) -> Column:
    """Whether a JSON text is a transcript: an object with a list of segments, or a list."""
    v = F.try_parse_json(content)
    kind = F.schema_of_variant(v)
    listed = F.schema_of_variant(F.try_variant_get(v, "$.segments", "variant"))
    return F.coalesce(kind.startswith("ARRAY") | (kind.startswith("OBJECT") & listed.startswith("ARRAY")), F.lit(False))


def staged_outputs(files: DataFrame, by: str = "run_id") -> DataFrame:
    """Whether each run's staged files are a whole transcript, and if not why: ``files(by, name, content string)``.

    Runs without any of the two files have no row; callers join from their runs.
    """
    of = lambda name: F.max(F.when(F.col("name") == name, F.coalesce("content", F.lit(""))))
    found = files.groupBy(by).agg(of(TEXT_FILE).alias("_md"), of(JSON_FILE).alias("_js"))
    reason = (
        F.when(F.col("_md").isNull(), f"missing {TEXT_FILE}")
        .when(F.col("_js").isNull(), f"missing {JSON_FILE}")
        .when(F.col("_md") == "", f"{TEXT_FILE} is empty")
        .when(F.col("_js") == "", f"{JSON_FILE} is empty")
        .when(F.try_parse_json("_js").isNull(), f"{JSON_FILE} is not valid JSON")
        .when(~well_formed(F.col("_js")), f"{JSON_FILE} does not have the shape of a transcript")
    )
    return found.select(by, reason.isNull().alias("valid"), F.coalesce(reason, F.lit("")).alias("reason"))
