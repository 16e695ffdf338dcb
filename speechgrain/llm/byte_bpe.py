"""Byte-level BPE encoding and decoding with a sentencepiece model written from a rank file.

Every rank becomes a piece whose bytes are mapped to visible characters, scored by its negative rank, so that
sentencepiece merges what has the lowest rank first. The model's normalisation is the identity. Texts are split by the
pre-token pattern, each pre-token is encoded alone, and ids are decoded by the inverse mapping of their pieces.

Workers get the vocabulary bytes in the closure (its size is that of the file); nothing is read from a local path there.

Defined cases: a null text is empty and has no ids; repeated rows and null ids get their rows; extra columns pass through;
very long texts are cut where the pattern is sure to end a match, so only a single match without such a place is held whole;
of pieces that tie none exist, ranks being distinct; an empty table gives an empty table.
"""

from __future__ import annotations

import base64
import hashlib
import struct
from array import array
from collections.abc import Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import table
from .pieces import Cache, cut_before

HELD = 8 << 20
PRINTABLE = [*range(33, 127), *range(161, 173), *range(174, 256)]


def byte_characters() -> list[str]:
    """A visible character for each byte: itself where it is printable, else one from U+0100 on, in order."""
    other = iter(range(256, 512))
    return [chr(b) if b in PRINTABLE else chr(next(other)) for b in range(256)]


def read_ranks(data: bytes) -> list[bytes]:
    """The tokens of a rank file (base64, space, rank on a line) by rank."""
    ranks = dict((int(rank), base64.b64decode(token)) for token, rank in (line.split() for line in data.splitlines() if line))
    if sorted(ranks) != list(range(len(ranks))):
        raise ValueError("ranks must run from 0 without gaps")
    return [ranks[i] for i in range(len(ranks))]


def _varint(n: int) -> bytes:
    out = bytearray()
    while n > 127:
        out.append(n & 127 | 128)
        n >>= 7
    return bytes(out) + bytes([n])


def _field(number: int, value: int | float | bytes) -> bytes:
    if isinstance(value, float):
        return _varint(number << 3 | 5) + struct.pack("<f", value)
    if isinstance(value, bytes):
        return _varint(number << 3 | 2) + _varint(len(value)) + value
    return _varint(number << 3) + _varint(value)


def sentencepiece_model(tokens: list[bytes]) -> bytes:
    """A serialised sentencepiece BPE model; piece i is token i, and the unknown piece follows the last."""
    shown = byte_characters()
    out = bytearray()
    for rank, token in enumerate(tokens):
        out += _field(1, _field(1, "".join(shown[b] for b in token).encode()) + _field(2, float(-rank)) + _field(3, 1))
    out += _field(1, _field(1, b"<unk>") + _field(2, 0.0) + _field(3, 2))
    minus_one = (1 << 64) - 1
    trainer = _field(3, 2) + _field(4, len(tokens) + 1) + _field(40, len(tokens)) + b"".join(_field(n, minus_one) for n in (41, 42, 43))
    return bytes(out + _field(2, trainer) + _field(3, _field(1, b"identity") + _field(3, 0) + _field(4, 0) + _field(5, 0)))


class ByteBpe:
    """Encodes texts to little-endian unsigned 32-bit ids and decodes them, with a sentencepiece model inside."""

    def __init__(self, model: bytes, pattern: str, cache: int = 32 << 20):
        import regex
        import sentencepiece

        self.model = sentencepiece.SentencePieceProcessor(model_proto=model)
        shown = byte_characters()
        self.shown = {b: c for b, c in enumerate(shown)}
        back = {c: b for b, c in enumerate(shown)}
        n = self.model.get_piece_size() - 1
        self.tokens = [bytes(back[c] for c in self.model.id_to_piece(i)) for i in range(n)]
        self.find = regex.compile(pattern).findall
        self.cache = Cache(self._encode, cache)

    def _encode(self, part: str) -> bytes:
        mapped = part.encode("utf-8", "surrogatepass").decode("latin-1").translate(self.shown)
        return array("I", self.model.encode(mapped, num_threads=1)).tobytes()

    @staticmethod
    def _sure(text: str, i: int) -> bool:
        """A match ends before a single space between visible characters."""
        return text[i] == " " and not text[i - 1].isspace() and i + 1 < len(text) and not text[i + 1].isspace()

    def encode(self, text: str | None) -> bytes:
        return b"".join(self.cache.join(self.find(piece)) for piece in cut_before(text or "", self._sure))

    def decode(self, ids: bytes) -> bytes:
        return b"".join(map(self.tokens.__getitem__, np.frombuffer(ids, "<u4").tolist()))


def _vocabulary(spark: SparkSession, path: str) -> bytes:
    """A rank file's bytes: a local path of the driver, or any path that Spark reads."""
    if "://" not in path:
        return Path(path).read_bytes()
    return bytes(spark.read.format("binaryFile").load(path).select("content").first()[0])


#: What ``encode_documents`` adds: ids with a check of the round trip, ids and decoded bytes, or digests of both.
MODES = {
    "checked": "n_tokens long, ids binary, round_trip boolean",
    "bytes": "n_tokens long, ids binary, decoded binary",
    "digests": "n_tokens long, ids_sha256 string, decoded_sha256 string",
}


def _row(mode: str, text: str | None, ids: bytes, back: bytes) -> tuple:
    if mode == "checked":
        return len(ids) // 4, ids, back == (text or "").encode("utf-8", "surrogatepass")
    if mode == "bytes":
        return len(ids) // 4, ids, back
    return len(ids) // 4, hashlib.sha256(ids).hexdigest(), hashlib.sha256(back).hexdigest()


def encode_documents(docs: DataFrame, path: str, pattern: str, mode: str = "checked", keep_text: bool = True) -> DataFrame:
    """``docs`` with the columns of ``MODES[mode]``; columns of these names are replaced. Without ``keep_text`` the text goes.

    ``ids`` are little-endian unsigned 32-bit integers. Every text is encoded, and its ids are decoded again. A worker holds one
    Arrow batch of texts, and results of some ``HELD`` bytes; the other columns pass through it as they are.
    """
    model = docs.sparkSession.sparkContext.broadcast(sentencepiece_model(read_ranks(_vocabulary(docs.sparkSession, path))))
    made = dict(x.split() for x in MODES[mode].split(", "))
    own = {c: f"_c{k}" for k, c in enumerate(docs.columns) if c not in made and (keep_text or c != "text")}
    arrow = {"long": pa.int64(), "binary": pa.binary(), "boolean": pa.bool_(), "string": pa.string()}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = ByteBpe(model.value, pattern)

        def done(batch: pa.RecordBatch, begin: int, rows: list[tuple]) -> pa.RecordBatch:
            new = [pa.array(c, arrow[t]) for c, t in zip(zip(*rows, strict=True), made.values(), strict=True)]
            return pa.RecordBatch.from_arrays([*batch.slice(begin, len(rows)).columns[1:], *new], [*own.values(), *made])

        for batch in batches:
            begin, rows, held = 0, [], 0
            for text in batch.column(0):
                text = text.as_py()
                ids = coder.encode(text)
                rows.append(_row(mode, text, ids, coder.decode(ids)))
                held += len(ids) + (len(rows[-1][2]) if mode == "bytes" else 0)
                if len(rows) == 500 or held > HELD:
                    yield done(batch, begin, rows)
                    begin, rows, held = begin + len(rows), [], 0
            if rows:
                yield done(batch, begin, rows)

    asked = docs.select(F.col("text").alias("_text"), *[F.col(f"`{c}`").alias(n) for c, n in own.items()])
    schema = T.StructType([T.StructField(n, asked.schema[n].dataType) for n in own.values()])
    for name, kind in made.items():
        schema = schema.add(name, kind)
    return asked.mapInArrow(run, schema).select(*[F.col(n).alias(c) for c, n in own.items()], *made)


def op7_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return encode_documents(docs, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN, mode="digests", keep_text=False)
