"""Text and time expressions over columns. All are built-in expressions, save the two that need a Python library."""

from __future__ import annotations

from collections.abc import Callable
from difflib import SequenceMatcher

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

# --- speech predicates -------------------------------------------------------------------------------------------------


def is_bracketed(text: Column) -> Column:
    """Trimmed text starts with ``[`` and ends with ``]``; false for null and empty texts."""
    t = F.trim(text)
    return F.coalesce(t.startswith("[") & t.endswith("]"), F.lit(False))


def is_tag(text: Column) -> Column:
    """Trimmed text is one bracketed tag with something inside and no inner ``]``."""
    return F.coalesce(F.trim(text).rlike(r"^\[[^\]]+\]$"), F.lit(False))


def is_useful(text: Column) -> Column:
    """Text that isn't blank and isn't one bracketed tag."""
    return F.coalesce(F.trim(text) != "", F.lit(False)) & ~is_tag(text)


# --- match keys --------------------------------------------------------------------------------------------------------


def match_key(text: Column) -> Column:
    """Lower case, every run of other characters than a-z and 0-9 a single space, trimmed. Null counts as empty."""
    return F.trim(F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), "[^a-z0-9]+", " "))


def match_words(text: Column) -> Column:
    key = match_key(text)
    return F.when(key == "", F.array().cast("array<string>")).otherwise(F.split(key, " "))


def _block_share(a, b, least: float) -> bool:
    """Whether the matching blocks of two sequences make up ``least`` of them; cheap upper bounds come first."""
    blocks = SequenceMatcher(None, a, b)
    return all(share() >= least for share in (blocks.real_quick_ratio, blocks.quick_ratio, blocks.ratio))


def _same_text(left: str, right: str, by_letters: float, by_words: float) -> bool:
    if not (left and right):
        return False
    shorter, longer = sorted((left, right), key=len)
    if shorter in longer or _block_share(left, right, by_letters):
        return True
    few, many = sorted((left.split(), right.split()), key=len)
    return _block_share(many[len(many) - len(few) :], few, by_words)


def may_be_same(left: Column, right: Column, by_letters: float = 0.85, by_words: float = 0.72) -> Column:
    """False only where ``same_text`` is: neither contained, nor enough letters, nor enough of the last words in common."""
    few = lambda: F.least(F.size(F.split(left, " ")), F.size(F.split(right, " ")))
    ends = lambda c: F.slice(F.split(c, " "), F.size(F.split(c, " ")) - few() + 1, few())
    # words in common, repeats counted generously: those of one side that the other has at all
    both = F.size(F.filter(ends(left), lambda w: F.array_contains(ends(right), w)))
    return left.contains(right) | right.contains(left) | (letter_bound(left, right) >= by_letters - 1e-9) | (both / few() >= by_words - 1e-9)


def same_text(left: Column, right: Column, by_letters: float = 0.85, by_words: float = 0.72) -> Column:
    """Two match keys are equal, contained, or alike by matching blocks of letters or of the last words."""

    @F.pandas_udf("boolean")
    def run(a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series([_same_text(x or "", y or "", by_letters, by_words) for x, y in zip(a, b, strict=True)], dtype=bool)

    return run(left, right)


def letter_bound(left: Column, right: Column) -> Column:
    """At least the ratio of matching letters: twice the letters that both have, however placed, by all of them."""
    count = lambda c, x: F.length(c) - F.length(F.replace(c, x, F.lit("")))
    letters = F.array_distinct(F.filter(F.split(left, ""), lambda x: x != ""))
    both = F.aggregate(letters, F.lit(0), lambda n, x: n + F.least(count(left, x), count(right, x)))
    size = F.length(left) + F.length(right)
    short = 2.0 * F.least(F.length(left), F.length(right)) / size
    return F.when(size == 0, 1.0).otherwise(F.least(short, 2.0 * both / size))


def letter_ratio(left: Column, right: Column) -> Column:
    @F.pandas_udf("double")
    def run(a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series([SequenceMatcher(None, x or "", y or "").ratio() for x, y in zip(a, b, strict=True)], dtype="float64")

    return run(left, right)


# --- names and labels --------------------------------------------------------------------------------------------------


def slug(text: Column, default: str = "untitled-recording", most: int = 80) -> Column:
    s = F.regexp_replace(F.lower(F.trim(F.coalesce(text, F.lit("")))), "[^a-z0-9]+", "-")
    return F.coalesce(F.nullif(F.substring(F.regexp_replace(s, "^-+|-+$", ""), 1, most), F.lit("")), F.lit(default))


def source_label(source: Column) -> Column:
    return F.when(F.coalesce(source, F.lit("")) == "", "Unknown").when(source == "mic", "Mic").when(source == "system", "System").otherwise(F.initcap(source))


def link_title(title: Column) -> Column:
    """A title that is safe inside a wiki link."""
    return F.replace(F.replace(title, F.lit("|"), F.lit("-")), F.lit("]]"), F.lit("] ]"))


#: The lane of each session status.
LANES = {
    "recording": "Recording",
    "scheduled": "Recording",
    "stopped": "To Transcribe",
    "transcribing": "To Transcribe",
    "transcribed": "Transcribed",
    "transcription_failed": "Failed / Needs Attention",
    "transcription_interrupted": "Failed / Needs Attention",
    "recording_failed": "Failed / Needs Attention",
    "scheduled_cancelled": "Failed / Needs Attention",
}


def lane(status: Column) -> Column:
    pairs = [F.lit(x) for kv in LANES.items() for x in kv]
    return F.coalesce(F.element_at(F.create_map(*pairs), status), F.lit("To Transcribe"))


#: How the text of a card begins for each status, and the event whose time follows.
OPENINGS = {
    "recording": "started",
    "recording_failed": "recording failed to launch",
    "scheduled": "scheduled for",
    "scheduled_cancelled": "scheduled start cancelled",
    "stopped": "stopped",
    "transcribed": "transcribed",
    "transcribing": "transcribing (PID {pid}) since",
    "transcription_failed": "failed",
    "transcription_interrupted": "interrupted",
}
EVENTS = {
    "recording": "started",
    "recording_failed": "failed",
    "scheduled": "scheduled_start",
    "scheduled_cancelled": "cancelled",
    "stopped": "ended",
    "transcribed": "transcribed",
    "transcribing": "transcription_started",
    "transcription_failed": "failed",
    "transcription_interrupted": "interrupted",
}
RESUME_HINT = "resume with transcribe --resume"


def _lookup(key: Column, values: dict[str, Column | str]) -> Column:
    """The value of ``key`` in a map literal; null for other keys."""
    pairs = [x for k, v in values.items() for x in (F.lit(k), v if isinstance(v, Column) else F.lit(v))]
    return F.element_at(F.create_map(*pairs), F.coalesce(key, F.lit("")))


def event_time(columns: dict[str, Column], event: str) -> Column:
    """When an event of a session was: as people wrote it (``_at_human``), else as it is stored (``_at``), else null."""
    known = [F.nullif(columns[c], F.lit("")) for c in (f"{event}_at_human", f"{event}_at") if c in columns]
    return F.coalesce(*known, F.lit(None).cast("string"))


def card_text(columns: dict[str, Column]) -> Column:
    """What a session's card says of its status: opening words, the time of the event, and a reason or hint after a dash.

    ``columns`` are the session's, by name; missing ones count as empty. A status without a text of its own is shown as it is.
    """
    get = lambda c: F.coalesce(F.nullif(columns[c], F.lit("")), F.lit("")) if c in columns else F.lit("")
    status = F.coalesce(columns["status"], F.lit(""))
    times = {e: event_time({c: x for c, x in columns.items() if not c.startswith("transcription_started_at_")}, e) for e in set(EVENTS.values())}
    when = _lookup(_lookup(status, EVENTS), times)
    if "ended_at_human" in columns:  # what went wrong with a transcription has at least the end of the recording
        when = F.coalesce(when, F.when(status.startswith("transcription_"), F.nullif(columns["ended_at_human"], F.lit(""))))
    pid = F.coalesce(columns["transcription_pid"], F.lit("?")) if "transcription_pid" in columns else F.lit("?")
    rest = _lookup(status, {"recording_failed": get("failure_reason"), "transcription_failed": get("failure_reason"), "scheduled_cancelled": get("cancel_reason"), "transcription_interrupted": RESUME_HINT})
    said = F.concat(F.replace(_lookup(status, OPENINGS), F.lit("{pid}"), pid), F.lit(" "), F.coalesce(when, F.lit("")))
    return F.coalesce(F.concat(said, F.when(F.coalesce(rest, F.lit("")) != "", F.concat(F.lit(" — "), rest)).otherwise(F.lit(""))), status)


def note_link(session_dir: Column, title: Column, vault: str) -> Column:
    """A wiki link to a session's note by its path below the vault."""
    inside = F.when(session_dir.startswith(vault.rstrip("/") + "/"), F.substring(session_dir, len(vault.rstrip("/")) + 2, F.length(session_dir))).otherwise(session_dir)
    return F.concat(F.lit("[["), inside, F.lit("/session|"), link_title(F.coalesce(title, F.lit("Untitled"))), F.lit("]]"))


def mentions_any(text: Column, words: list[str]) -> Column:
    """Lower-cased text holds any of ``words``; false for null."""
    low = F.lower(F.coalesce(text, F.lit("")))
    out = F.lit(False)
    for w in words:
        out = out | low.contains(w)
    return out


#: Parts of error texts.
GPU_TIMEOUT = ["gpu timeout error", "command buffer execution failed"]
OUT_OF_MEMORY = ["out of memory", "resource exhausted", "insufficient memory", "memory pressure", "failed to allocate", "allocation failed"]


def device_error(text: Column) -> Column:
    """``timeout``, ``memory`` or null for a device's error text."""
    return F.when(mentions_any(text, GPU_TIMEOUT), "timeout").when(mentions_any(text, OUT_OF_MEMORY), "memory")


def attendees(text: Column) -> Column:
    """``array<struct<name, address>>`` of a comma-separated list.

    The list is cut at every comma, and a piece that doesn't end with ``>`` takes up the next one if that has a ``<``:
    "Last, First <a@b>" is one person.
    """
    def add(done: Column, piece: Column) -> Column:
        last = F.btrim(F.coalesce(F.try_element_at(done, F.lit(-1)), F.lit("")), F.lit(" \t"))
        joins = (last != "") & ~last.endswith(">") & piece.contains("<")
        joined = F.concat(F.element_at(done, -1), F.lit(","), piece)
        return F.when(joins, F.concat(F.slice(done, 1, F.size(done) - 1), F.array(joined))).otherwise(F.concat(done, F.array(piece)))

    entries = F.aggregate(F.split(F.coalesce(text, F.lit("")), ","), F.array().cast("array<string>"), add)
    return F.transform(F.filter(F.transform(entries, _strip), lambda p: p != ""), _person)


def _strip(text: Column) -> Column:
    return F.btrim(text, F.lit(" \t\n\r"))


def _person(entry: Column) -> Column:
    """Name and address of one entry: ``name <address>``, a bare address (one @ with a dot somewhere after it), or a name."""
    opens = F.when(entry.contains("<"), F.length(entry) - F.instr(F.reverse(entry), "<") + 1).otherwise(F.lit(0))
    inner = F.substring(entry, opens + 1, F.length(entry) - opens - 1)
    bracketed = (opens > 0) & entry.endswith(">") & (inner != "") & ~inner.contains(">")
    local, domain = F.substring_index(entry, "@", 1), F.substring_index(entry, "@", -1)
    bare = (F.size(F.split(entry, "@")) == 2) & ~entry.rlike(r"\s") & (local != "") & domain.rlike(r"^.+\..")
    name = F.when(bracketed, _strip(F.substring(entry, F.lit(1), opens - 1))).when(bare, F.lit("")).otherwise(entry)
    address = F.when(bracketed, _strip(inner)).when(bare, entry).otherwise(F.lit(""))
    return F.struct(name.alias("name"), address.alias("address"))


# --- times -------------------------------------------------------------------------------------------------------------


def _bound(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with ``value`` computed once, however often the body has it; written out, nested uses multiply."""
    return F.element_at(F.transform(F.array(value), body), 1)


def parse_timestamp(text: Column) -> Column:
    """Seconds from ``s``, ``MM:SS`` or ``HH:MM:SS``; null for what is malformed or negative."""
    number = lambda c: F.when(c.rlike(r"^[+-]?([0-9]+(\.[0-9]*)?|\.[0-9]+)([eE][+-]?[0-9]+)?$"), c.try_cast("double"))
    whole = lambda c: F.when(c.rlike(r"^[+-]?[0-9]+$"), c.try_cast("long"))
    positive = lambda c: _bound(c, lambda v: F.when(v >= 0, v))

    def read(parts: Column) -> Column:
        part = lambda k: F.get(parts, F.lit(k))
        two = positive(whole(part(0))) * 60.0 + positive(number(part(1)))
        three = positive(whole(part(0))) * 3600.0 + positive(whole(part(1))) * 60.0 + positive(number(part(2)))
        return F.when(F.size(parts) == 1, positive(number(part(0)))).when(F.size(parts) == 2, two).when(F.size(parts) == 3, three)

    return _bound(F.transform(F.split(F.trim(text), ":"), lambda p: F.trim(p)), read)


def parse_range(text: Column, strict: bool = True) -> Column:
    """``struct<start, end>`` of ``start-end``, split at the first dash; null if malformed or, when strict, not ascending."""

    def read(t: Column) -> Column:
        at = F.instr(t, "-")
        start = F.when(at > 1, parse_timestamp(F.substring(t, F.lit(1), at - 1)))
        end = F.when(at > 0, parse_timestamp(F.substring(t, at + 1, F.length(t))))
        return F.struct(start.alias("start"), end.alias("end"))

    def checked(r: Column) -> Column:
        good = r["start"].isNotNull() & r["end"].isNotNull() & ((r["start"] < r["end"]) if strict else F.lit(True))
        return F.when(good, r)

    return _bound(_bound(F.trim(text), read), checked)


def seconds_2(ms: Column) -> Column:
    """Milliseconds as seconds with two decimals, ties to even; exact, since no double is involved."""
    ms = ms.cast("long")
    size = F.abs(ms)
    tenth = F.floor(size / 10).cast("long")
    rest = size - tenth * 10
    up = (rest > 5) | ((rest == 5) & (tenth % 2 == 1))
    cents = tenth + up.cast("long")
    sign = F.when((ms < 0) & (cents > 0), F.lit("-")).otherwise(F.lit(""))
    return F.concat(sign, F.floor(cents / 100).cast("string"), F.lit("."), F.lpad((cents % 100).cast("string"), 2, "0"))


def seconds_between(later: Column, earlier: Column) -> Column:
    """Whole seconds between two timestamps, truncated toward zero."""
    micros = F.unix_micros(later) - F.unix_micros(earlier)
    return F.when(micros >= 0, F.floor(micros / 1_000_000)).otherwise(F.ceil(micros / 1_000_000)).cast("long")


def parse_iso(text: Column) -> Column:
    """A timestamp from an ISO text with or without zone, or null; without a zone it is in the session's."""
    return F.try_to_timestamp(text)


def time_token(ts: Column) -> Column:
    return F.date_format(ts, "yyyyMMdd-HHmmss")
