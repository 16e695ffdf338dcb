"""16-bit PCM WAV files: a header scan that reads a few bytes of each file, and a data source that reads and writes samples."""

from __future__ import annotations

import struct
from collections.abc import Iterator
from concurrent.futures import ThreadPoolExecutor

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage

from speechgrain.sources.files import file_system

SCHEMA = "path string, sample_rate long, channels int, bit_depth int, samples array<int>"
ARROW = pa.schema([("path", pa.string()), ("sample_rate", pa.int64()), ("channels", pa.int32()), ("bit_depth", pa.int32()), ("samples", pa.list_(pa.int32()))])
#: Codes of PCM data in a format chunk: plain, and extensible.
PCM = (1, 0xFFFE)
#: Files and bytes of files that a task of the data source reads, partitions of Spark's own listing in one, and moves at a time.
PACK, PACK_BYTES, MERGED, MOVING = 512, 64 << 20, 16, 16


def read_header(file) -> tuple[int, int, int, int] | None:
    """(rate, channels, sample width, frames) of an open file, or None if it isn't a PCM file.

    Chunk heads are walked by seeking, so a file costs some dozens of bytes however long its chunks are.
    """
    head = file.read(12)
    if len(head) < 12 or head[:4] != b"RIFF" or head[8:] != b"WAVE":
        return None
    at, form = 12, None
    while True:
        file.seek(at)
        name_size = file.read(8)
        if len(name_size) < 8:
            return None
        name, size = name_size[:4], struct.unpack("<I", name_size[4:])[0]
        if name == b"fmt " and size >= 16:
            form = struct.unpack("<HHIIHH", file.read(16))
        elif name == b"data":
            if form is None or form[0] not in PCM or not form[1] or not form[5]:
                return None
            width = (form[5] + 7) // 8
            return form[2], form[1], width, size // (form[1] * width)
        at += 8 + size + size % 2


def probe(files: DataFrame) -> DataFrame:
    """Header figures of ``files(path, length)``, of which only heads are read; the duration is 0 where the rate is 0.

    Files that aren't PCM files, or can't be read, have nulls. Frames are those that the header states.
    """
    names = ("sample_rate", "channels", "sample_width", "frame_count")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = []
            for path in batch.column(0).to_pylist():
                try:
                    where, name = file_system(path)
                    with where.open_input_file(name) as file:
                        found.append(read_header(file))
                except (OSError, struct.error):
                    found.append(None)
            columns = [pa.array([f and f[k] for f in found], pa.int64()) for k in range(4)]
            yield pa.RecordBatch.from_arrays([*batch.columns, *columns], ["path", "length", *names])

    out = files.select("path", "length").mapInArrow(run, "path string, length long, " + ", ".join(f"{n} long" for n in names))
    out = out.withColumns({"channels": F.col("channels").cast("int"), "sample_width": F.col("sample_width").cast("int")})
    return out.withColumn("duration_s", F.when(F.col("sample_rate") > 0, F.col("frame_count") / F.col("sample_rate")).when(F.col("sample_rate") == 0, F.lit(0.0)))


def list_wavs(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.format("binaryFile").option("pathGlobFilter", "*.wav").option("recursiveFileLookup", "true").load(path)


def merged(files: DataFrame) -> DataFrame:
    """Files that Spark lists, in fewer tasks: it counts 4 MB for the opening of each, so that a task has some 32 short ones."""
    tasks, cores = files.rdd.getNumPartitions(), files.sparkSession.sparkContext.defaultParallelism
    return files.coalesce(max(tasks // MERGED, 4 * cores)) if tasks > 4 * cores else files


def is_normalized(probed: DataFrame, rate: int = 16_000) -> DataFrame:
    """Whether a file needs no conversion: mono, 16 bits, the wanted rate."""
    return probed.withColumn("normalized", F.coalesce((F.col("sample_rate") == rate) & (F.col("channels") == 1) & (F.col("sample_width") == 2), F.lit(False)))


def parse_wav(data: bytes) -> tuple[int, int, int, np.ndarray]:
    """(rate, channels, bits, interleaved samples) of a PCM file; chunks may come in any order, padded to even lengths."""
    if data[:4] != b"RIFF" or data[8:12] != b"WAVE":
        raise ValueError("not a RIFF/WAVE file")
    at, form, body = 12, None, None
    while at + 8 <= len(data) and (form is None or body is None):
        name, size = data[at : at + 4], struct.unpack_from("<I", data, at + 4)[0]
        if name == b"fmt ":
            form = struct.unpack_from("<HHIIHH", data, at + 8)
        elif name == b"data":
            body = memoryview(data)[at + 8 : at + 8 + size]
        at += 8 + size + size % 2
    if form is None or body is None:
        raise ValueError("a WAVE file needs fmt and data chunks")
    if form[0] != 1 or form[5] != 16:
        raise ValueError(f"only 16-bit PCM is supported, not format {form[0]} with {form[5]} bits")
    return form[2], form[1], form[5], np.frombuffer(body[: len(body) // 2 * 2], "<i2")


def wav_bytes(rate: int, channels: int, samples) -> bytes:
    """A file with a 44-byte header; sizes wrap beyond 4 GiB."""
    whole = np.asarray(samples, dtype=np.int64)
    if len(whole) and (whole.min() < -32768 or whole.max() > 32767):
        raise ValueError("samples must fit in 16 bits")
    body = whole.astype("<i2").tobytes()
    head = struct.pack("<4sI4s4sIHHIIHH4sI", b"RIFF", (36 + len(body)) & 0xFFFFFFFF, b"WAVE", b"fmt ", 16, 1, channels, rate, rate * channels * 2, channels * 2, 16, b"data", len(body) & 0xFFFFFFFF)
    return head + body


def _row(path: str, data: bytes) -> pa.RecordBatch:
    """One file as a batch; its samples go from NumPy to Arrow without Python objects."""
    rate, channels, bits, samples = parse_wav(data)
    packed = pa.ListArray.from_arrays(pa.array([0, len(samples)], pa.int32()), pa.array(samples.astype(np.int32)))
    return pa.RecordBatch.from_arrays([pa.array([path]), pa.array([rate], pa.int64()), pa.array([channels], pa.int32()), pa.array([bits], pa.int32()), packed], schema=ARROW)


def as_files(clips: DataFrame) -> DataFrame:
    """``(path, content)`` of ``clips(path, sample_rate, samples)`` of one channel, for ``files.write_files``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, rate, samples in zip(*batch.columns, strict=True):
                content = wav_bytes(rate.as_py(), 1, samples.values.to_numpy(zero_copy_only=False))
                yield pa.RecordBatch.from_arrays([pa.array([path.as_py()]), pa.array([content], pa.binary())], ["path", "content"])

    return clips.select("path", F.col("sample_rate").cast("long"), F.col("samples").cast("array<int>")).mapInArrow(run, "path string, content binary")


def read_wavs(spark: SparkSession, path: str) -> DataFrame:
    """Samples of every file below ``path``, through Spark's own file listing (any file system that Spark knows)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for p, c in zip(*batch.columns, strict=True):
                yield _row(p.as_py(), c.as_py())

    return merged(list_wavs(spark, path).select("path", "content")).mapInArrow(run, SCHEMA)


class _Partition(InputPartition):
    def __init__(self, paths: list[str]):
        self.paths = paths


class _Reader(DataSourceReader):
    def __init__(self, path: str):
        self.path = path

    def partitions(self) -> list[InputPartition]:
        from pyarrow import fs

        where, base = file_system(self.path)
        found = where.get_file_info(fs.FileSelector(base, recursive=True))
        packs, held = [], 0
        for f in sorted((f for f in found if f.is_file and f.path.endswith(".wav")), key=lambda f: f.path):
            if not packs or len(packs[-1]) == PACK or held + f.size > PACK_BYTES:
                packs.append([])
                held = 0
            packs[-1].append(f.path)
            held += f.size
        return [_Partition(p) for p in packs]

    def read(self, partition: _Partition) -> Iterator[pa.RecordBatch]:
        where, _ = file_system(self.path)
        for path in partition.paths:
            with where.open_input_file(path) as f:
                yield _row(path, f.read())


class _Message(WriterCommitMessage):
    def __init__(self, mark: str, names: list[str]):
        self.mark, self.names = mark, names


class _Writer(DataSourceArrowWriter):
    """Files are written under names of the task attempt and take their own names when the whole job commits."""

    def __init__(self, path: str):
        self.path = path

    def write(self, iterator: Iterator[pa.RecordBatch]) -> _Message:
        from pyspark import TaskContext

        where, base = file_system(self.path)
        where.create_dir(base, recursive=True)
        mark, names = str(TaskContext.get().taskAttemptId()), []
        for batch in iterator:
            for path, rate, channels, samples in zip(*(batch.column(c) for c in ("path", "sample_rate", "channels", "samples")), strict=True):
                if samples.values is None or samples.values.null_count:
                    raise ValueError(f"{path} has samples that are null")
                names.append(path.as_py().rsplit("/", 1)[-1])
                with where.open_output_stream(self._draft(base, mark, len(names) - 1, names[-1])) as f:
                    f.write(wav_bytes(rate.as_py(), channels.as_py(), samples.values.to_numpy(zero_copy_only=False)))
        return _Message(mark, names)

    @staticmethod
    def _draft(base: str, mark: str, k: int, name: str) -> str:
        return f"{base}/{name}.{mark}-{k}.tmp"

    def commit(self, messages: list) -> None:
        where, base = file_system(self.path)

        def move(m: _Message) -> None:
            for k, name in enumerate(m.names):
                where.move(self._draft(base, m.mark, k, name), f"{base}/{name}")

        made = [m for m in messages if m]
        apart = len({n for m in made for n in m.names}) == sum(len(m.names) for m in made)
        with ThreadPoolExecutor(MOVING if apart else 1) as pool:  # of files of one name the last task's stays
            list(pool.map(move, made))

    def abort(self, messages: list) -> None:
        where, base = file_system(self.path)
        for m in filter(None, messages):
            for k, name in enumerate(m.names):
                where.delete_file(self._draft(base, m.mark, k, name))


class WavDataSource(DataSource):
    """``spark.read.format("wav").load(folder)`` and ``df.write.format("wav").mode("append").save(folder)``."""

    @classmethod
    def name(cls) -> str:
        return "wav"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> DataSourceReader:
        return _Reader(self.options["path"])

    def writer(self, schema, overwrite: bool) -> DataSourceArrowWriter:
        return _Writer(self.options["path"])


def register(spark: SparkSession) -> None:
    spark.dataSource.register(WavDataSource)
