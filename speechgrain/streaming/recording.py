"""Recordings as streams: a sink that appends to WAV files batch by batch, and a source that follows files as they grow.

Both need a file system that all machines mount, with writing at a place (``file:`` paths); object stores have neither.

**Sink.** Rows ``(path, sample_rate, channels, first_frame, samples)`` say where in their file they belong, so writing is placing: a
task that is run again, or a batch after a restart, puts the same bytes in the same places. The header is patched after the data,
every ``PATCH`` bytes and at the end, and only forward; what a killed run leaves is a file that any reader takes, a little short at
most. ``record`` brings all rows of a file to one task. Frames that haven't come yet are silence.

**Source.** An offset is the number of frames of each file that were read. A batch goes from one to the next, in pieces of at most
``PIECE`` frames, whole frames only: those that the header states, or, while it states none, those that the file has. A batch that is
run again reads the same frames.
"""

from __future__ import annotations

import os
import struct
import time
from collections.abc import Iterator
from concurrent.futures import ThreadPoolExecutor

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, DataSourceStreamWriter, InputPartition, WriterCommitMessage
from pyspark.sql.streaming import StreamingQuery

from speechgrain.sources.files import file_system
from speechgrain.sources.wav import wav_bytes

HEAD, PATCH, PIECE = 44, 1 << 20, 1 << 20
#: Files that a task holds open, samples of rows that it holds at once, and what a row counts for itself.
OPEN, HELD, ROW = 16, 1 << 20, 64
#: Pieces that a task reads at most, and seconds after which a file's time tells whether it changed.
PACK, SETTLED_S = 512, 10
SCHEMA = "path string, sample_rate long, channels int, first_frame long, samples array<int>"
ARROW = pa.schema([("path", pa.string()), ("sample_rate", pa.int64()), ("channels", pa.int32()), ("first_frame", pa.int64()), ("samples", pa.list_(pa.int32()))])


def _local(path: str) -> str:
    where, name = file_system(path)
    if where.type_name != "local":
        raise ValueError(f"streams of recordings need a mounted file system, not {where.type_name}")
    return name


class GrowingWav:
    """A WAV file that is written in place; use as a context manager."""

    def __init__(self, path: str, rate: int, channels: int):
        self.path, self.rate, self.channels = path, rate, channels
        self.file, self.since = None, 0

    def __enter__(self) -> GrowingWav:
        os.makedirs(os.path.dirname(self.path), exist_ok=True)
        self.file = os.fdopen(os.open(self.path, os.O_RDWR | os.O_CREAT, 0o644), "r+b")
        head = self.file.read(HEAD)
        if len(head) < HEAD:
            self.file.seek(0)
            self.file.write(wav_bytes(self.rate, self.channels, []))
        elif struct.unpack("<HI", head[22:28]) != (self.channels, self.rate):
            self.file.close()
            raise ValueError(f"{self.path} has another form")
        return self

    def put(self, first_frame: int, samples) -> None:
        whole = np.asarray(samples, np.int64)
        if len(whole) % self.channels:
            raise ValueError("a row has to hold whole frames")
        if len(whole) and (whole.min() < -32768 or whole.max() > 32767):
            raise ValueError("samples must fit in 16 bits")
        width = 2 * self.channels
        for k in range(0, len(whole), PATCH // width * self.channels):
            part = whole[k : k + PATCH // width * self.channels].astype("<i2").tobytes()
            self.file.seek(HEAD + first_frame * width + 2 * k)
            self.file.write(part)
            self.since += len(part)
            if self.since >= PATCH:
                self.patch()

    def patch(self) -> None:
        """Data first, then the sizes in the header."""
        self.file.flush()
        os.fsync(self.file.fileno())
        size = os.fstat(self.file.fileno()).st_size - HEAD
        size -= size % (2 * self.channels)
        for at, value in ((4, 36 + size), (40, size)):
            self.file.seek(at)
            self.file.write(struct.pack("<I", value & 0xFFFFFFFF))
        self.file.flush()
        self.since = 0

    def __exit__(self, kind, *_) -> None:
        if self.file.closed:
            return
        try:
            if kind is None:
                self.patch()
                os.fsync(self.file.fileno())
        finally:
            self.file.close()


class _Done(WriterCommitMessage):
    def __init__(self, frames: int):
        self.frames = frames


def _gathered(rows: Iterator) -> Iterator[dict[str, list]]:
    """Rows by file name, some ``HELD`` samples together, so that a file is opened once for many rows. What came before a row that fails is given out first."""
    held, size, failed = {}, 0, None
    while failed is None:
        try:
            row = next(rows)
        except Exception as e:  # the end too
            failed = e
        else:
            held.setdefault(os.path.basename(row["path"]), []).append(row)
            size += len(row["samples"]) + ROW
        if held and (failed is not None or size >= HELD):
            yield held
            held, size = {}, 0
    if not isinstance(failed, StopIteration):
        raise failed


class _Sink(DataSourceStreamWriter):
    def __init__(self, path: str):
        self.path = path

    def write(self, rows: Iterator) -> _Done:
        root, frames = _local(self.path), 0

        def put(name: str, rows: list) -> None:
            # a file in which a row fails is closed as it is, without a new header
            with GrowingWav(os.path.join(root, name), rows[0]["sample_rate"], rows[0]["channels"]) as file:
                for row in rows:
                    file.put(row["first_frame"], row["samples"])

        with ThreadPoolExecutor(OPEN) as pool:  # most of the time goes to waiting for the disk
            for held in _gathered(rows):
                for done in [pool.submit(put, *of) for of in held.items()]:
                    done.result()
                frames += sum(len(row["samples"]) // row["channels"] for of in held.values() for row in of)
        return _Done(frames)

    def _note(self, name: str, text: str) -> None:
        folder = os.path.join(_local(self.path), ".batches")
        os.makedirs(folder, exist_ok=True)
        draft = os.path.join(folder, f".{name}.{os.getpid()}")
        with open(draft, "w") as out:
            out.write(text)
            out.flush()
            os.fsync(out.fileno())
        os.replace(draft, os.path.join(folder, name))

    def commit(self, messages: list, batchId: int) -> None:  # noqa: N803
        self._note(str(batchId), str(sum(m.frames for m in messages if m)))

    def abort(self, messages: list, batchId: int) -> None:  # noqa: N803
        self._note(f"{batchId}.failed", "")


class _Piece(InputPartition):
    def __init__(self, path: str, begin: int, end: int):
        self.path, self.begin, self.end = path, begin, end


class _Pack(InputPartition):
    """Pieces that one task reads: many files are short."""

    def __init__(self, pieces: list[tuple[str, int, int]]):
        self.pieces = pieces


def whole_frames(path: str) -> tuple[int, int, int, int] | None:
    """(rate, channels, place of the data, whole frames so far) of a 16-bit file, or None while its head isn't complete."""
    size = os.path.getsize(path)
    with open(path, "rb") as file:
        if file.read(12)[8:] != b"WAVE":
            return None
        at, form = 12, None
        while True:
            file.seek(at)
            head = file.read(8)
            if len(head) < 8:
                return None
            name, length = head[:4], struct.unpack("<I", head[4:])[0]
            if name == b"fmt " and length >= 16:
                if len(head := file.read(16)) < 16:
                    return None
                form = struct.unpack("<HHIIHH", head)
            elif name == b"data":
                if form is None or form[0] != 1 or form[5] != 16 or not form[1]:
                    raise ValueError(f"{path} isn't 16-bit PCM")
                there = size - at - 8
                stated = there if length in (0, 0xFFFFFFFF) else min(length, there)
                return form[2], form[1], at + 8, max(stated, 0) // (2 * form[1])
            at += 8 + length + length % 2


class _Source(DataSourceStreamReader):
    def __init__(self, path: str, piece: int):
        self.path, self.piece = path, piece
        self.seen: dict[str, tuple[tuple[int, int], int]] = {}

    def initialOffset(self) -> dict:  # noqa: N802
        return {}

    def _frames(self, file: os.DirEntry) -> int | None:
        """Whole frames of a file. A head isn't read again while size and time stay as they were."""
        about = file.stat()
        key = about.st_size, about.st_mtime_ns
        if (known := self.seen.get(file.name)) and known[0] == key:
            return known[1]
        found, settled = whole_frames(file.path), time.time() - about.st_mtime > SETTLED_S
        if found and settled:
            self.seen[file.name] = key, found[3]
        return found and found[3]

    def latestOffset(self) -> dict:  # noqa: N802
        root = _local(self.path)
        files = sorted((f for f in os.scandir(root) if f.name.endswith(".wav")), key=lambda f: f.name) if os.path.isdir(root) else []
        with ThreadPoolExecutor(OPEN) as pool:
            return {f.name: n for f, n in zip(files, pool.map(self._frames, files), strict=True) if n is not None}

    def partitions(self, start: dict, end: dict) -> list[InputPartition]:
        packs, frames = [], 0
        for name, n in end.items():
            for k in range(start.get(name, 0), n, self.piece):
                piece = name, k, min(k + self.piece, n)
                if not packs or len(packs[-1]) == PACK or frames + piece[2] - k > self.piece:
                    packs.append([])
                    frames = 0
                packs[-1].append(piece)
                frames += piece[2] - k
        return [_Pack(p) for p in packs]

    def read(self, partition: _Pack | _Piece) -> Iterator[pa.RecordBatch]:
        root, rows, found = _local(self.path), [], []
        for name, begin, end in partition.pieces if isinstance(partition, _Pack) else [(partition.path, partition.begin, partition.end)]:
            path = os.path.join(root, name)
            rate, channels, at, frames = whole_frames(path)
            if frames < end:
                raise ValueError(f"{path} has become shorter")
            with open(path, "rb") as file:
                file.seek(at + 2 * channels * begin)
                found.append(np.frombuffer(file.read(2 * channels * (end - begin)), "<i2").astype(np.int32))
            rows.append((name, rate, channels, begin))
        if rows:
            packed = pa.ListArray.from_arrays(pa.array(np.cumsum([0, *map(len, found)]), pa.int32()), pa.array(np.concatenate(found)))
            yield pa.RecordBatch.from_arrays([*(pa.array(c, t) for c, t in zip(zip(*rows, strict=True), ARROW.types, strict=False)), packed], schema=ARROW)

    def commit(self, end: dict) -> None:
        pass


class RecordingSource(DataSource):
    """Format ``wav_stream``: ``writeStream`` appends to the files of a folder, ``readStream`` follows them."""

    @classmethod
    def name(cls) -> str:
        return "wav_stream"

    def schema(self) -> str:
        return SCHEMA

    def streamWriter(self, schema, overwrite: bool) -> DataSourceStreamWriter:  # noqa: N802
        return _Sink(self.options["path"])

    def streamReader(self, schema) -> DataSourceStreamReader:  # noqa: N802
        return _Source(self.options["path"], int(self.options.get("piece", PIECE)))


def register(spark: SparkSession) -> None:
    spark.dataSource.register(RecordingSource)


def record(rows: DataFrame, path: str, log: str) -> StreamingQuery:
    """Start appending a stream of ``rows`` to the files below ``path`` until what is there is used up; ``log`` is its checkpoint."""
    dealt = rows.select("path", F.col("sample_rate").cast("long"), F.col("channels").cast("int"), F.col("first_frame").cast("long"), F.col("samples").cast("array<int>")).repartition("path")
    return dealt.writeStream.format("wav_stream").option("path", path).option("checkpointLocation", log).trigger(availableNow=True).start()


def listen(spark: SparkSession, path: str, piece: int = PIECE) -> DataFrame:
    """The files below ``path`` as a stream of ``SCHEMA``."""
    return spark.readStream.format("wav_stream").option("path", path).option("piece", str(piece)).load()
