"""Token ids in word-aligned binary files (Simple-8b), written and read back by Spark tasks.

A 64-bit word has a selector in its top four bits and ``COUNTS[selector]`` ids of ``60 // count`` bits below it. Selector 15
is an escape: the next word is one value of up to 64 bits as it is. A block holds ``BLOCK`` ids (the last one of a file
fewer) and no word spans blocks. File layout, little-endian:

    magic | blocks of words | block offsets u64[b+1] | document ids i64[d] | id-is-null u8[d] | document ends u64[d]
    | n blocks u64 | n documents u64 | n ids u64 | footer offset u64 | magic

Documents are range-partitioned by id and the hash of their text, one file to a partition, so the files in order hold the
ids in ascending doc_id order, and rows that share an id, or have none, may spread over files. Spark coalesces partitions to
its advisory size. A file is written under a name of its task attempt, and only files that the manifest names count, so lost or
repeated tasks leave no trace in the result. Encoding and decoding hold one block group at a time.

Texts of special tokens, such as ``<|endoftext|>``, are ordinary text, as the vocabulary's documentation has it; with
``special_as_text=False`` the tokenizer is used as loaded and gives their ids.

Defined cases: a null text is empty and has the end id only; null doc_ids come first; rows that repeat a doc_id are ordered
by the hash of their text, then by text; very long texts are cut at white space, so only a single word is held whole; extra
columns are ignored; an empty table writes no documents.
"""

from __future__ import annotations

import re
import uuid
import zlib
from array import array
from collections.abc import Iterator
from pathlib import Path
from unicodedata import is_normalized

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .byte_bpe import byte_characters
from .common import shared_folder, table, written
from .pieces import BatchCache, cut_before

COUNTS = (60, 30, 20, 15, 12, 10, 8, 7, 6, 5, 4, 3, 2, 1)
ESCAPE = 15
BLOCK = 1 << 16
#: Files whose ids are added up together before the groups' sums are.
GROUP = 1024
MAGIC = b"SGS8B-1\n"
_CUTS = " \t\n\r"
#: Characters of texts that are encoded together.
HELD_CHARS = 4 << 20
_LOWER = np.array([b + 32 if 65 <= b <= 90 else b for b in range(256)], np.uint8)
#: Of each byte: 0 where pieces are cut, 1 ASCII letters and digits, 2 other ASCII characters, 3 bytes of other characters.
_KINDS = np.array([0 if chr(b) in _CUTS else 3 if b >= 128 else 1 if chr(b).isalnum() else 2 for b in range(256)], np.uint8)


def pack(ids: np.ndarray) -> np.ndarray:
    """Words for ``ids`` (unsigned, of 32 or 64 bits), each holding as many as fit."""
    n = len(ids)
    if n == 0:
        return np.zeros(0, "<u8")
    choice = np.full(n, ESCAPE, np.int8)
    for s, count in reversed(list(enumerate(COUNTS))):
        fits = ids <= ids.dtype.type(min((1 << 60 // count) - 1, np.iinfo(ids.dtype).max))
        if np.count_nonzero(fits) < count:
            break
        run = 1  # fits[i] tells whether ids i to i + run - 1 are small enough
        while run < count:
            by = min(run, count - run)
            fits, run = fits[:-by] & fits[by:], run + by
        choice[: len(fits)][fits] = s
    ids = ids.astype(np.uint64)
    step = np.ones(16, np.uint8)
    step[: len(COUNTS)] = COUNTS
    steps, starts, p = step[choice].tobytes(), [], 0
    while p < n:
        starts.append(p)
        p += steps[p]
    starts = np.array(starts)
    chosen = choice[starts]
    places = np.cumsum(1 + (chosen == ESCAPE)) - 1 - (chosen == ESCAPE)
    words = np.zeros(len(starts) + np.count_nonzero(chosen == ESCAPE), "<u8")
    words[places] = chosen.astype(np.uint64) << np.uint64(60)
    for s, count in enumerate(COUNTS):
        if (of := chosen == s).any():
            first, word = starts[of], words[places[of]]
            for k in range(count):
                word |= ids[first + k] << np.uint64(60 // count * k)
            words[places[of]] = word
    of = chosen == ESCAPE
    words[places[of] + 1] = ids[starts[of]]
    return words


def unpack(words: np.ndarray) -> np.ndarray:
    """The ids in ``words``."""
    selectors = (words >> np.uint64(60)).astype(np.int64)
    counts = np.zeros(16, np.int64)
    counts[: len(COUNTS)] = COUNTS
    lengths = counts[selectors]
    escapes = []
    for i in np.flatnonzero(selectors == ESCAPE).tolist():
        if not escapes or escapes[-1] != i - 1:
            escapes.append(i)
    if escapes:
        lengths[escapes] = 0
        lengths[np.array(escapes) + 1] = 1
        selectors[np.array(escapes) + 1] = -1
    ends = np.cumsum(lengths)
    out = np.zeros(int(ends[-1]) if len(ends) else 0, np.uint64)
    for s, count in enumerate(COUNTS):
        of = np.flatnonzero(selectors == s)
        if len(of):
            bits = 60 // count
            shifts = np.arange(count, dtype=np.uint64) * np.uint64(bits)
            out[(ends[of] - count)[:, None] + np.arange(count)] = (words[of][:, None] >> shifts) & np.uint64((1 << bits) - 1)
    raw = np.flatnonzero(selectors == -1)
    out[ends[raw] - 1] = words[raw]
    return out


class Writer:
    """Appends documents to an open binary stream."""

    def __init__(self, stream):
        self.stream, self.at, self.n = stream, 0, 0
        self.offsets, self.docs, self.nulls, self.ends = [], [], [], []
        self.waiting, self.held = [], 0
        self._put(MAGIC)
        self.offsets.append(self.at)

    def _put(self, data: bytes) -> None:
        self.stream.write(data)
        self.at += len(data)

    def _blocks(self, whole_only: bool) -> None:
        ids, done = np.concatenate(self.waiting) if self.waiting else np.zeros(0, np.uint32), 0
        while len(ids) - done >= (BLOCK if whole_only else 1):
            self._put(pack(ids[done : done + BLOCK]).tobytes())
            self.offsets.append(self.at)
            done += BLOCK
        self.waiting, self.held = [ids[done:]], len(ids[done:])

    def add(self, doc_id: int | None, ids: np.ndarray) -> None:
        self.waiting.append(ids)
        self.held += len(ids)
        self.n += len(ids)
        self.docs.append(doc_id or 0)
        self.nulls.append(doc_id is None)
        self.ends.append(self.n)
        if self.held >= 4 * BLOCK:
            self._blocks(True)

    def close(self) -> None:
        self._blocks(False)
        footer = self.at
        for values, kind in ((self.offsets, "<u8"), (self.docs, "<i8"), (self.nulls, "u1"), (self.ends, "<u8")):
            self._put(np.array(values, dtype=kind).tobytes())
        self._put(np.array([len(self.offsets) - 1, len(self.docs), self.n, footer], dtype="<u8").tobytes() + MAGIC)


class Reader:
    """Random access to the blocks of a file, and its documents in order."""

    def __init__(self, file, blocks_at_once: int = 16):
        self.file, self.group = file, blocks_at_once
        size = file.size()
        file.seek(size - 40)
        tail = file.read(40)
        file.seek(0)
        if tail[-8:] != MAGIC or file.read(8) != MAGIC:
            raise ValueError("not a token file")
        blocks, docs, self.n, footer = (int(x) for x in np.frombuffer(tail[:32], "<u8"))
        file.seek(footer)
        self.offsets = np.frombuffer(file.read(8 * (blocks + 1)), "<u8")
        self.doc_ids = np.frombuffer(file.read(8 * docs), "<i8")
        self.nulls = np.frombuffer(file.read(docs), "u1").astype(bool)
        self.ends = np.frombuffer(file.read(8 * docs), "<u8").astype(np.int64)

    def ids(self, first: int, last: int) -> np.ndarray:
        """The ids of blocks ``first`` to ``last - 1``."""
        begin, end = int(self.offsets[first]), int(self.offsets[last])
        self.file.seek(begin)
        words = np.frombuffer(self.file.read(end - begin), "<u8")
        cuts = ((self.offsets[first + 1 : last] - self.offsets[first]) // 8).astype(np.int64)
        return np.concatenate([unpack(w) for w in np.split(words, cuts)]).astype("<u4")

    def digests(self) -> Iterator[tuple[int | None, int, int, int]]:
        """(doc_id or None, start, n, crc32 of its ids as little-endian 32-bit integers) for each document."""
        data, low, high, block = np.zeros(0, "<u4"), 0, 0, 0
        start = 0
        for doc, null, end in zip(self.doc_ids.tolist(), self.nulls.tolist(), self.ends.tolist(), strict=True):
            crc, at = 0, start
            while at < end:
                if at >= high:
                    last = min(block + self.group, len(self.offsets) - 1)
                    data, low = self.ids(block, last), high
                    high, block = low + len(data), last
                stop = min(end, high)
                crc = zlib.crc32(data[at - low : stop - low].tobytes(), crc)
                at = stop
            yield (None if null else doc), start, end - start, crc
            start = end


class WordTokenizer:
    """Ids of a tokenizers file whose normaliser lower-cases and whose pre-tokens never cross white space.

    Texts are encoded many at a time. Their bytes are cut at spaces, tabs and line ends, and where an ASCII letter or digit meets an
    ASCII mark: ends of pre-tokens that no normalising moves, since only what follows an ASCII character can join with it. Each distinct
    piece of the texts is looked up once, in a bounded cache, and its ids are gathered for all its places. Pieces of up to 16 bytes are
    told apart by their bytes as two integers, longer ones by a dictionary. A piece of letters that normalising leaves as it is goes
    straight to the library's BPE model, all others through its whole chain.
    """

    def __init__(self, definition: str, cache: int = 64 << 20, special_as_text: bool = True):
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.model = Tokenizer.from_str(definition)
        self.model.encode_special_tokens = special_as_text
        special = [] if special_as_text else [t.content for t in self.model.get_added_tokens_decoder().values() if t.special]
        self.special = re.compile("|".join(map(re.escape, special))).search if special else None
        self.bpe = self.model.model
        self.shown = dict(enumerate(byte_characters()))
        self.cache = BatchCache(self._encode, cache)

    def _direct(self, part: str) -> bytes | None:
        if not part.isalpha() or part != part.lower() or not (part.isascii() or is_normalized("NFC", part)):
            return None
        mapped = part if part.isascii() else part.encode().decode("latin-1").translate(self.shown)
        return array("I", [t.id for t in self.bpe.tokenize(mapped)]).tobytes()

    def _encode(self, pieces: list[bytes]) -> list[bytes]:
        parts = [p.decode() for p in pieces]
        out = [self._direct(p) for p in parts]
        rest = [i for i, x in enumerate(out) if x is None]
        for i, e in zip(rest, self.model.encode_batch_fast([parts[i] for i in rest], add_special_tokens=False), strict=True):
            out[i] = array("I", e.ids).tobytes()
        return out

    def _alone(self, text: str) -> bool:
        """A special token may hold or touch white space, and a capital sigma looks at its neighbours."""
        return "\u03a3" in text or bool(self.special and self.special(text))

    def _whole(self, text: str) -> np.ndarray:
        return np.array(self.model.encode(text, add_special_tokens=False).ids, "<u4")

    def encode(self, text: str | None) -> np.ndarray:
        return self.encode_many([text])[0]

    def encode_many(self, texts: list[str | None]) -> list[np.ndarray]:
        """The ids of each text; texts are held together up to some ``HELD_CHARS`` characters, longer ones in pieces."""
        out: list[np.ndarray] = [np.zeros(0, "<u4")] * len(texts)
        held, size = [], 0

        def flush() -> None:
            for i, ids in zip(held, self._joined([texts[i] for i in held]), strict=True):
                out[i] = ids
            held.clear()

        for i, text in enumerate(texts):
            if not text:
                continue
            if self._alone(text):
                out[i] = self._whole(text)
            elif len(text) > HELD_CHARS:
                out[i] = np.concatenate([self._joined([p])[0] for p in cut_before(text, lambda t, k: t[k] in _CUTS, HELD_CHARS)])
            else:
                held.append(i)
                size += len(text)
                if size > HELD_CHARS:
                    flush()
                    size = 0
        flush()
        return out

    def _joined(self, texts: list[str]) -> list[np.ndarray]:
        raw = [t.encode() for t in texts]
        as_is = np.frombuffer(b" ".join(raw) + bytes(17), np.uint8)
        # a letter before other characters may combine with them before it becomes a small one
        buffer = np.where(np.concatenate((as_is[1:] >= 128, [False])), as_is, _LOWER[as_is])
        data = buffer.tobytes()
        kind = _KINDS[buffer[:-17]]
        before = np.concatenate(([0], kind[:-1])).astype(np.uint8)
        opens = (kind != 0) & ((before == 0) | (before == 1) & (kind == 2))
        starts = np.flatnonzero(opens)
        ends = np.flatnonzero(np.concatenate(((before != 0) & ((kind == 0) | opens), [bool(len(kind)) and kind[-1] != 0])))
        number, pieces = _distinct(data, buffer, starts, ends - starts)
        ids = self.cache.many(pieces)
        sizes = np.fromiter(map(len, ids), np.int64, len(ids)) // 4
        pool, first = np.frombuffer(b"".join(ids), "<u4"), np.cumsum(sizes) - sizes
        each = sizes[number]
        upto = np.concatenate(([0], np.cumsum(each)))
        flat = pool[np.arange(upto[-1]) + np.repeat(first[number] - upto[:-1], each)]
        begins = np.cumsum([0] + [len(r) + 1 for r in raw])
        cuts = upto[np.searchsorted(starts, begins)].tolist()
        return [flat[a:b] for a, b in zip(cuts[:-1], cuts[1:], strict=True)]


def _distinct(data: bytes, buffer: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, list[bytes]]:
    """(number of each piece's text, the texts by number); ``buffer`` has 16 bytes or more beyond the last piece."""
    eight = np.ndarray((len(buffer) - 7,), "<u8", buffer, strides=(1,))
    masks = np.array([(1 << 8 * k) - 1 for k in range(9)], np.uint64)
    low = eight[starts] & masks[np.minimum(lengths, 8)]
    high = eight[np.minimum(starts + 8, len(eight) - 1)] & masks[np.clip(lengths - 8, 0, 8)]
    mixed = (low ^ (low >> np.uint64(29))) * np.uint64(0x9E3779B97F4A7C15) + (high ^ (high >> np.uint64(31)) ^ lengths.astype(np.uint64)) * np.uint64(0xD6E8FEB86659FD93)
    number, found = pd.factorize(mixed)
    model = np.zeros(len(found), np.int64)
    model[number] = np.arange(len(number))  # one place of each number
    at = model[number]
    other = (lengths > 16) | (low != low[at]) | (high != high[at]) | (lengths != lengths[at])
    pieces = [data[s:e] for s, e in zip(starts[model].tolist(), (starts + lengths)[model].tolist(), strict=True)]
    if other.any():
        apart: dict[bytes, int] = {}
        for i in np.flatnonzero(other).tolist():
            piece = data[starts[i] : starts[i] + lengths[i]]
            number[i] = apart.setdefault(piece, len(pieces) + len(apart))
        pieces += apart
    return number, pieces


_CODERS: dict[tuple[str, bool], WordTokenizer] = {}


def coder_for(definition: str, special_as_text: bool) -> WordTokenizer:
    """The worker's own tokenizer, with its cache kept from task to task."""
    if (definition, special_as_text) not in _CODERS:
        _CODERS.clear()
        _CODERS[definition, special_as_text] = WordTokenizer(definition, special_as_text=special_as_text)
    return _CODERS[definition, special_as_text]


def _open(path: str):
    from pyarrow import fs

    if "://" not in path and not path.startswith("file:"):
        return fs.LocalFileSystem(), path
    return fs.FileSystem.from_uri(path)


def write_tokens(docs: DataFrame, definition: str, end_id: int, folder: str, special_as_text: bool = True) -> DataFrame:
    """Encode ``docs(doc_id, text)`` and write a file for each non-empty partition.

    Returns the manifest, a written table ``(part, path, n_docs, n_ids, base)``: files in order of ``part``, ``base`` the ids before each.
    """
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast(definition)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyspark import TaskContext

        context = TaskContext.get()
        where, base = _open(folder)
        name = f"part-{context.partitionId():06d}-{context.taskAttemptId()}.s8b"
        coder = writer = stream = None
        for batch in batches:
            if coder is None:
                coder = coder_for(shared.value, special_as_text)
                where.create_dir(base, recursive=True)
                stream = where.open_output_stream(f"{base}/{name}")
                writer = Writer(stream)
            for k in range(0, len(batch), 1000):
                part = batch.iloc[k : k + 1000]
                for doc_id, ids in zip(part["doc_id"].tolist(), coder.encode_many(part["text"].tolist()), strict=True):
                    writer.add(None if pd.isna(doc_id) else int(doc_id), np.append(ids, np.uint32(end_id)))
        if writer is not None:
            writer.close()
            stream.close()
            yield pd.DataFrame({"part": [context.partitionId()], "path": [f"{folder}/{name}"], "n_docs": [len(writer.docs)], "n_ids": [writer.n]})

    order = [F.col("doc_id").asc_nulls_first(), F.xxhash64("text")]
    ordered = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").repartitionByRange(*order).sortWithinPartitions(*order, "text")
    listed = written(ordered.mapInPandas(run, "part long, path string, n_docs long, n_ids long").withColumn("_group", F.floor(F.col("part") / GROUP)))
    # sums of two levels, so that no window holds a row of every file
    before = lambda w: F.coalesce(F.sum("n_ids").over(w.rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    groups = listed.groupBy("_group").agg(F.sum("n_ids").alias("n_ids")).select("_group", before(W.orderBy("_group")).alias("_before"))
    inside = listed.withColumn("_inside", before(W.partitionBy("_group").orderBy("part")))
    return written(inside.join(groups, "_group").select("part", "path", "n_docs", "n_ids", (F.col("_before") + F.col("_inside")).alias("base")))


def read_tokens(manifest: DataFrame) -> DataFrame:
    """``(doc_id, start, n_tokens, ids_crc32)`` for the documents in the files of ``manifest(path, base)``, as their bytes have it."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for path, base in zip(batch["path"], batch["base"].tolist(), strict=True):
                where, name = _open(path)
                with where.open_input_file(name) as file:
                    rows = list(Reader(file).digests())
                docs, begin, n, crc = zip(*rows, strict=True)
                yield pd.DataFrame({"doc_id": pd.array(docs, dtype="Int64"), "start": np.array(begin) + base, "n_tokens": n, "ids_crc32": crc})

    return manifest.select("path", "base").repartition(max(1, manifest.count())).mapInPandas(run, "doc_id long, start long, n_tokens long, ids_crc32 long")


def op4_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    definition = Path(public_tokenizers.path("word_bpe_49k.json")).read_text()
    folder = f"{shared_folder(spark)}/token-files/{uuid.uuid4().hex}"
    return read_tokens(write_tokens(table(spark, sf_dir, "documents").select("doc_id", "text"), definition, 2, folder))
