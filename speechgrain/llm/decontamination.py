"""Benchmark decontamination by a generalised suffix automaton of the test items.

1. Items are dealt into shards of about ``SHARD_WORDS`` words. A task builds the automaton of a shard and writes it to the shared
   folder; nothing of the items passes through the driver.
2. Texts are streamed through every shard's automaton, word by word: it holds the longest suffix of what was read that is
   part of an item. Where that has ``window`` words or more, all of them are hit; the state of the last ``window`` of them names the
   items. An item of fewer words is hit where the whole of it ends.
3. Most words can't be in a match: stretches in which every two neighbouring words are neighbours in some item are found first,
   with array look-ups in a bitmap, and those too short for a window are left out; the automaton begins anew at each of the others.
   The bitmap may say yes too often, never no, so matches are the same.

Texts are neither shuffled nor held more than one at a time; a worker keeps ``LOADED`` automata and reads others as it needs them, for
each Arrow batch.

Defined cases: a null, empty or blank text has no words; null items and those without words have no windows; an item without an
id hits words but isn't named; items of equal text are all named, rows that repeat an id once; rows that repeat a doc_id, or
have none, are judged each; very long texts take memory in proportion to their own length; an item longer than a shard is a
shard of its own size; an empty table gives an empty table; no items, no hits; extra columns are ignored by ``scan`` and kept by
``decontaminate``, whatever their names.
"""

from __future__ import annotations

import pickle
import re
import uuid
from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from speechgrain.sources.files import file_system, read_bytes

from .common import shared_folder, table

WINDOW, MAX_COVERAGE = 10, 0.5
SHARD_WORDS, LOADED = 200_000, 2
#: Bytes outside of words become spaces and A-Z small letters; every byte of a character above U+007F belongs to a word.
_WORDS = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))
_SPOT = re.compile(rb"[^ ]+").finditer
BITMAP_BITS = 22


def words_of(text: bytes | None) -> list[bytes]:
    """The lower-cased words of UTF-8 bytes."""
    return (text or b"").translate(_WORDS).split()


class Automaton:
    """Suffix automaton of several word sequences, with the items that windows and short items belong to."""

    def __init__(self, items: list[tuple[str | None, list[bytes]]], window: int = WINDOW):
        self.window, self.ids = window, {}
        self.length, self.link, self.step = [0], [-1], [{}]
        texts: dict[tuple[int, ...], set] = {}
        for name, words in items:
            if words:
                texts.setdefault(tuple(self.ids.setdefault(w, len(self.ids)) for w in words), set()).add(name)
        for words in texts:
            last = 0
            for w in words:
                last = self._extended(last, w)
        self._name(texts)
        self._filter(texts)

    def _state(self, length: int, link: int, step: dict[int, int]) -> int:
        self.length.append(length)
        self.link.append(link)
        self.step.append(step)
        return len(self.length) - 1

    def _split(self, p: int, w: int) -> int:
        """The state of exactly the longest word sequence of ``p`` and ``w``, which has a transition already."""
        q = self.step[p][w]
        if self.length[q] == self.length[p] + 1:
            return q
        clone = self._state(self.length[p] + 1, self.link[q], dict(self.step[q]))
        self.link[q] = clone
        while p >= 0 and self.step[p].get(w) == q:
            self.step[p][w] = clone
            p = self.link[p]
        return clone

    def _extended(self, last: int, w: int) -> int:
        if w in self.step[last]:
            return self._split(last, w)
        new, p = self._state(self.length[last] + 1, 0, {}), last
        while p >= 0 and w not in self.step[p]:
            self.step[p][w] = new
            p = self.link[p]
        self.link[new] = self._split(p, w) if p >= 0 else 0
        return new

    def _name(self, texts: dict) -> None:
        self.of_window: dict[int, set] = {}  # state that holds a window -> items
        self.of_short: dict[int, list[tuple[int, set]]] = {}  # state -> (words, items) of short items in it
        for words, names in texts.items():
            v = 0
            for k, w in enumerate(words):
                v = self.step[v][w]
                if k + 1 >= self.window:
                    self.of_window.setdefault(self._up(v, self.window), set()).update(names)
            if len(words) < self.window:
                self.of_short.setdefault(self._up(v, len(words)), []).append((len(words), names))
        # nearest state on the way of links, itself included, that holds short items
        self.short_at = [-1] * len(self.length)
        for v in sorted(range(len(self.length)), key=self.length.__getitem__):
            self.short_at[v] = v if v in self.of_short else self.short_at[self.link[v]] if v else -1

    def _up(self, v: int, n: int) -> int:
        """The state of the last ``n`` words of what ``v`` holds."""
        while self.length[self.link[v]] >= n:
            v = self.link[v]
        return v

    def _filter(self, texts: dict) -> None:
        self.least = min((min(len(t), self.window) for t in texts), default=0)
        self.near = np.zeros(1 << BITMAP_BITS, bool)
        for t in texts:
            a = np.array(t, np.int64)
            self.near[self._slots(a[:-1], a[1:])] = True

    @staticmethod
    def _slots(a: np.ndarray, b: np.ndarray) -> np.ndarray:
        return ((a * 0x9E3779B1 + b * 0x85EBCA77) >> 7) & ((1 << BITMAP_BITS) - 1)

    def stretches(self, ids: np.ndarray) -> list[tuple[int, int]]:
        """(begin, end) of the stretches of known neighbours that a window fits into."""
        known = ids >= 0
        follows = known[:-1] & known[1:]
        follows[follows] = self.near[self._slots(ids[:-1][follows], ids[1:][follows])]
        if self.least > 1:
            turns = np.flatnonzero(np.diff(np.concatenate(([False], follows, [False])).astype(np.int8)))
            begin, end = turns[::2], turns[1::2] + 1
        else:
            joined = np.concatenate(([False], follows, [False]))
            begin, end = np.flatnonzero(known & ~joined[:-1]), np.flatnonzero(known & ~joined[1:]) + 1
        long = end - begin >= self.least
        return list(zip(begin[long].tolist(), end[long].tolist(), strict=True))

    def match(self, words: list[bytes]) -> tuple[np.ndarray | None, set]:
        """(which words are hit, items with windows in the text); None if no word is."""
        if not self.least or len(words) < self.least:
            return None, set()
        ids = np.fromiter(map(self.ids.get, words, repeat(-1)), np.int64, len(words))
        turns, found, states, shorts = None, set(), set(), set()
        step, length, link, window, short_at = self.step, self.length, self.link, self.window, self.short_at
        for begin, end in self.stretches(ids):
            v, n = 0, 0
            for at, w in enumerate(ids[begin:end].tolist(), begin + 1):
                while v and w not in step[v]:
                    v = link[v]
                    n = length[v]
                if w not in step[v]:
                    continue
                v, n = step[v][w], n + 1
                hit = 0
                if n >= window:
                    hit = n
                    states.add(v)
                s = short_at[v]
                while s >= 0:
                    for k, _ in self.of_short[s]:
                        if k <= n:
                            hit = max(hit, k)
                            shorts.add((s, k))
                    s = short_at[link[s]] if s else -1
                if hit:
                    if turns is None:
                        turns = np.zeros(len(words) + 1, np.int64)
                    turns[at - hit] += 1
                    turns[at] -= 1
        for v in states:
            found |= self.of_window.get(self._up(v, window), set())
        for s, k in shorts:
            for n, names in self.of_short[s]:
                if n == k:
                    found |= names
        return None if turns is None else np.cumsum(turns[:-1]) > 0, found


def build_shards(items: DataFrame, window: int = WINDOW, shard_words: int = SHARD_WORDS) -> list[str]:
    """Write the automata of ``items(item_id, text)`` to the shared folder; returns their paths."""
    spark = items.sparkSession
    folder = f"{shared_folder(spark)}/automata-{uuid.uuid4().hex}"
    named = items.where("text is not null").select(F.col("item_id").cast("string").alias("item_id"), F.col("text").cast("binary").alias("text"))
    size = named.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    shards = size // (8 * shard_words) + 1  # a word is taken for eight bytes

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        read = [(i.as_py(), words_of(t.as_py())) for b in batches for i, t in zip(b.column(0), b.column(1), strict=True)]
        if any(words for _, words in read):
            where, name = file_system(f"{folder}/{uuid.uuid4().hex}")
            where.create_dir(name.rsplit("/", 1)[0], recursive=True)
            with where.open_output_stream(name) as out:
                pickle.dump(Automaton(read, window), out)
            yield pa.RecordBatch.from_arrays([pa.array([f"{folder}/{name.rsplit('/', 1)[1]}"])], names=["path"])

    made = named.repartition(shards, F.xxhash64("item_id", "text")).mapInArrow(run, "path string").collect()  # a row per shard
    return sorted(r.path for r in made)


_LOADED: dict[str, Automaton] = {}


def _loaded(path: str) -> Automaton:
    if path not in _LOADED:
        while len(_LOADED) >= LOADED:
            del _LOADED[next(iter(_LOADED))]
        _LOADED[path] = pickle.loads(read_bytes(path))
    return _LOADED[path]


def _judged(texts: list[bytes | None], paths: list[str]) -> list[tuple[int, np.ndarray | None, list[str]]]:
    """(words, which are hit or None, sorted names of items) of each text, a shard at a time."""
    out: list[tuple[int, np.ndarray | None, set]] = [(0, None, set())] * len(texts)
    for k, path in enumerate(paths or [""]):
        automaton = _loaded(path) if path else Automaton([])
        for i, text in enumerate(texts):
            words = words_of(text)
            hit, names = automaton.match(words)
            if k:
                hit = out[i][1] if hit is None else hit if out[i][1] is None else hit | out[i][1]
                names |= out[i][2]
            out[i] = (len(words), hit, names)
    return [(n, hit, sorted(names - {None})) for n, hit, names in out]


def _spans(text: bytes, hit: np.ndarray) -> list[tuple[int, int]]:
    """(begin, end) in bytes of the stretches of hit words."""
    spots = [m.span() for m in _SPOT(text.translate(_WORDS))]
    turns = np.flatnonzero(np.diff(np.concatenate(([False], hit, [False])).astype(np.int8))).tolist()
    return [(spots[a][0], spots[b - 1][1]) for a, b in zip(turns[::2], turns[1::2], strict=True)]


def scan(docs: DataFrame, items: DataFrame, window: int = WINDOW, shard_words: int = SHARD_WORDS) -> DataFrame:
    """``(doc_id, n_words, n_hit, items, spans)`` for every row of ``docs(doc_id, text)``.

    ``items`` are the sorted ids of the items with occurring windows, ``spans`` the stretches of hit words, as their first and
    last byte in UTF-8 (the last excluded).
    """
    paths = build_shards(items, window, shard_words)
    span = pa.struct([("begin", pa.int64()), ("end", pa.int64())])
    schema = pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("n_hit", pa.int64()), ("items", pa.list_(pa.string())), ("spans", pa.list_(span))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                texts = part.column(1).to_pylist()
                judged = _judged(texts, paths)
                spans = [[] if hit is None else [{"begin": a, "end": b} for a, b in _spans(t, hit)] for t, (_, hit, _) in zip(texts, judged, strict=True)]
                columns = [[n for n, _, _ in judged], [0 if hit is None else int(hit.sum()) for _, hit, _ in judged], [names for _, _, names in judged], spans]
                yield pa.RecordBatch.from_arrays([part.column(0), *(pa.array(c, t) for c, t in zip(columns, schema.types[1:], strict=True))], schema=schema)

    kinds = "doc_id long, n_words long, n_hit long, items array<string>, spans array<struct<begin:long,end:long>>"
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("binary").alias("text")).mapInArrow(run, kinds)


def decontaminate(docs: DataFrame, items: DataFrame, window: int = WINDOW, max_coverage: float = MAX_COVERAGE, shard_words: int = SHARD_WORDS) -> DataFrame:
    """``docs`` without the spans that hold windows of items, and without documents of which more than ``max_coverage`` of the words is hit.

    The columns stay as they are; a removed span leaves nothing, what stood around it stays.
    """
    paths = build_shards(items, window, shard_words)
    at = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(0, batch.num_rows, 256):
                part = batch.slice(k, 256)
                texts = [None if t is None else t.encode("utf-8", "surrogatepass") for t in part.column(at).to_pylist()]
                keep, left = [], []
                for text, (n, hit, _) in zip(texts, _judged(texts, paths), strict=True):
                    keep.append(hit is None or hit.sum() <= max_coverage * n)
                    for begin, end in reversed(_spans(text, hit)) if hit is not None and keep[-1] else ():
                        text = text[:begin] + text[end:]
                    left.append(None if text is None else text.decode("utf-8", "surrogatepass"))
                columns = [*part.columns]
                columns[at] = pa.array(left, pa.string())
                yield pa.RecordBatch.from_arrays(columns, names=[f"c{i}" for i in range(len(columns))]).filter(pa.array(keep))

    # columns travel by place, so that names may repeat or clash
    plain = docs.toDF(*[f"c{i}" for i in range(len(docs.columns))])
    return plain.mapInArrow(run, plain.schema).toDF(*docs.columns)


def op12_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = scan(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select(
        "doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ",").cast("binary"), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated")
    )


OP12_SQL = rf"""
WITH doc AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM documents
), item AS (
  SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM benchmark
), sized AS (
  SELECT *, least({WINDOW}, len(w)) AS n FROM item WHERE len(w) > 0
), win AS (
  SELECT DISTINCT item_id, n, array_to_string(w[p : p + n - 1], ' ') AS k FROM (SELECT *, unnest(range(1, len(w) - n + 2)) AS p FROM sized)
), lengths AS (
  SELECT DISTINCT n FROM win
), found AS MATERIALIZED (
  SELECT d.doc_id, d.p, d.n, win.item_id
  FROM (SELECT doc_id, n, unnest(range(1, len(w) - n + 2)) AS p, w FROM doc, lengths WHERE len(w) >= n) d
  JOIN win ON win.n = d.n AND win.k = array_to_string(d.w[d.p : d.p + d.n - 1], ' ')
), hit AS (
  SELECT doc_id, count(DISTINCT p + i) AS n_hit FROM (SELECT DISTINCT doc_id, p, unnest(range(0, n)) AS i FROM found) GROUP BY doc_id
), names AS (
  SELECT doc_id, count(*) AS n_items, string_agg(item_id, ',' ORDER BY item_id) AS ids FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS item_id FROM found WHERE item_id IS NOT NULL) GROUP BY doc_id
)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
       sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM doc LEFT JOIN hit USING (doc_id) LEFT JOIN names USING (doc_id)
"""
