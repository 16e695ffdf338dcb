"""Vectors as short codes by product quantisation in whole numbers.

Each component becomes floor(``SCALE`` * x), and vectors are cut into equal parts. A part position has a codebook, which begins as
that part of the smallest ``vec_id``s. In every round Arrow batches assign each part to its nearest entry: all distances come from
the expansion of the norm, |x|^2 - 2 x.c + |c|^2, with exact 64-bit products of matrices, and the first smallest counts. A task adds up
the parts of each entry; the sums of all tasks are merged by a grouped shuffle, and the new entries, at most parts x entries of them, are
broadcast for the next round. So a round reads the vectors once and shuffles a few thousand short rows a task.

Defined cases: null vectors and those with null or non-finite components are dropped; the length of vectors is that of the
smallest id whose length is a multiple of the number of parts, and vectors of another length (empty ones too) stay with a null code
and error; ties of distance go to the lower entry; fewer vectors than entries make a smaller codebook; unused entries stay as they are; rows that
repeat an id count each, and the first of them by their components comes first in the codebook; null ids come last there; null
labels are one label; components so large that a distance could leave 64 bits raise an error; an empty table gives an
empty table; extra columns are ignored. Texts play no part.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import checkpointed, table, written

SCALE, PARTS, ENTRIES, ROUNDS = 1024, 4, 256, 4
#: Rows whose distances to all entries of a part are held at once.
BLOCK = 4096


def whole(vectors: np.ndarray) -> np.ndarray:
    """floor(SCALE * x) of each component, exact."""
    scaled = np.floor(vectors.astype(np.float64) * SCALE)
    if scaled.size and np.abs(scaled).max() >= 2.0**62:
        raise OverflowError("a component is too large for 64-bit distances")
    return scaled.astype(np.int64)


def nearest(x: np.ndarray, book: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each row of ``x`` the first entry of ``book`` with the least squared distance, and that distance."""
    largest = max((int(np.abs(a).max()) for a in (x, book) if a.size), default=0)
    if 4 * largest * largest * max(x.shape[1], 1) >= 1 << 63:
        raise OverflowError("a component is too large for 64-bit distances")
    sizes = (book * book).sum(axis=1)
    at, far = np.zeros(len(x), np.int64), np.zeros(len(x), np.int64)
    for k in range(0, len(x), BLOCK):
        rows = x[k : k + BLOCK]
        distance = sizes - 2 * (rows @ book.T)
        at[k : k + BLOCK] = first = distance.argmin(axis=1)
        far[k : k + BLOCK] = np.take_along_axis(distance, first[:, None], axis=1)[:, 0] + (rows * rows).sum(axis=1)
    return at, far


def entry_sums(x: np.ndarray, books: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(counts, sums) of the rows of ``x`` that each entry of each part is nearest to."""
    parts, entries, width = books.shape
    counts, sums = np.zeros((parts, entries), np.int64), np.zeros(books.shape, np.int64)
    for p in range(parts):
        own = x[:, p * width : (p + 1) * width]
        at, _ = nearest(own, books[p])
        counts[p] = np.bincount(at, minlength=entries)
        np.add.at(sums[p], at, own)
    return counts, sums


def _rows(batch: pa.RecordBatch, column: int, dims: int) -> np.ndarray:
    return whole(np.asarray(batch.column(column).flatten()).reshape(-1, dims))


def _improved(vectors: DataFrame, books: np.ndarray) -> np.ndarray:
    """The codebooks after a round over ``vectors(embedding)``, all of one length."""
    parts, entries, width = books.shape
    shared = vectors.sparkSession.sparkContext.broadcast(books)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now = shared.value
        counts, sums = np.zeros((parts, entries), np.int64), np.zeros(now.shape, np.int64)
        for batch in batches:
            n, s = entry_sums(_rows(batch, 0, parts * width), now)
            counts += n
            sums += s
        p, e = np.nonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(p), pa.array(e), pa.array(counts[p, e]), pa.array(list(sums[p, e]), pa.list_(pa.int64()))], names=["p", "e", "n", "sums"])

    each = vectors.mapInArrow(run, "p long, e long, n long, sums array<long>")
    merged = each.groupBy("p", "e").agg(F.sum("n").alias("n"), F.array(*[F.sum(F.col("sums")[i]) for i in range(width)]).alias("sums"))
    out = books.copy()
    for r in merged.collect():  # at most parts x entries rows
        out[r.p, r.e] = [s // r.n for s in r.sums]
    shared.destroy()
    return out


def compress(vectors: DataFrame, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS) -> tuple[DataFrame, np.ndarray]:
    """``(vec_id, label, code, error)`` for the usable rows of ``vectors(vec_id, embedding, label)``, and the codebooks.

    ``code`` has the entries' numbers in the order of the parts, two hexadecimal digits each; ``error`` is the squared distance to them.
    """
    if entries > 256:
        raise ValueError("an entry's number has two hexadecimal digits")
    e = F.col("embedding")
    finite = F.forall(e, lambda x: x.isNotNull() & ~F.isnan(x.cast("double")) & (F.abs(x.cast("double")) < float("inf")))
    kept = vectors.where(e.isNotNull() & finite).select(F.col("vec_id").cast("long").alias("vec_id"), "embedding", "label")
    fit = kept.where((F.size(e) > 0) & (F.size(e) % parts == 0)).orderBy(F.col("vec_id").asc_nulls_last(), "embedding")
    first = [r.embedding for r in fit.select("embedding").limit(entries).collect()]
    dims = len(first[0]) if first else parts
    if any(len(v) != dims for v in first):
        first = [r.embedding for r in fit.where(F.size(e) == dims).select("embedding").limit(entries).collect()]
    width = dims // parts
    books = whole(np.array(first, np.float64).reshape(-1, parts, width)).transpose(1, 0, 2).copy()
    for _ in range(rounds if first else 0):
        books = _improved(kept.where(F.size(e) == dims).select("embedding"), books)
    shared = vectors.sparkSession.sparkContext.broadcast(books)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now = shared.value
        for batch in batches:
            there = batch.column(2).is_valid().to_numpy(zero_copy_only=False)
            x = _rows(batch.filter(pa.array(there)), 2, dims)
            codes, error = np.zeros((len(x), parts), np.uint8), np.zeros(len(x), np.int64)
            for p in range(parts):
                at, far = nearest(x[:, p * width : (p + 1) * width], now[p])
                codes[:, p] = at
                error += far
            text = codes.tobytes().hex()
            mine = iter([text[k : k + 2 * parts] for k in range(0, len(text), 2 * parts)])
            far_ = iter(error.tolist())
            out = [pa.array([next(mine) if t else None for t in there], pa.string()), pa.array([next(far_) if t else None for t in there], pa.int64())]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *out], names=["vec_id", "label", "code", "error"])

    label = dict(kept.dtypes)["label"]
    ready = kept.select("vec_id", "label", F.when(F.size(e) == dims, e).alias("embedding"))
    return ready.mapInArrow(run, f"vec_id long, label {label}, code string, error long"), books


def fingerprint(books: np.ndarray) -> str:
    """SHA-256 of all components by part, entry and place, as decimals with commas."""
    return hashlib.sha256(",".join(map(str, books.ravel().tolist())).encode()).hexdigest()


def with_label_errors(coded: DataFrame) -> DataFrame:
    """``coded`` with ``label_error``, the errors of all rows of the same label added up.

    The sums are written, so that Spark may broadcast them if they are small, or split a label of very many rows.
    """
    sums = written(coded.groupBy("label").agg(F.sum("error").alias("label_error"))).withColumnRenamed("label", "_label")
    return coded.join(sums, F.col("label").eqNullSafe(F.col("_label"))).drop("_label")


def op13_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    coded, books = compress(table(spark, sf_dir, "embeddings"))
    return with_label_errors(checkpointed(coded)).select("vec_id", "code", "error", "label_error", F.lit(fingerprint(books)).alias("codebooks_sha256"))


def _sql(parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS) -> str:
    """Components and entries as rows; a round is a join by part and place."""
    out = f"""
WITH kept AS MATERIALIZED (
  SELECT vec_id, label, embedding AS e, len(embedding) // {parts} AS width FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), comp AS MATERIALIZED (
  SELECT vec_id, p // width AS part, p % width AS place, floor({SCALE} * e[p + 1]::DOUBLE)::BIGINT AS x
  FROM (SELECT *, unnest(range(0, len(e))) AS p FROM kept)
), first AS (
  SELECT vec_id, row_number() OVER (ORDER BY vec_id) - 1 AS entry FROM kept QUALIFY entry < {entries}
), book0 AS MATERIALIZED (
  SELECT part, entry, place, x AS c FROM comp JOIN first USING (vec_id)
)"""
    for k in range(rounds + 1):
        out += f""", near{k} AS MATERIALIZED (
  SELECT vec_id, part, min({{'d': d, 'entry': entry}}) AS m
  FROM (SELECT vec_id, part, entry, sum((x - c) * (x - c)) AS d FROM comp JOIN book{k} USING (part, place) GROUP BY ALL) GROUP BY ALL
)"""
        if k < rounds:
            out += f""", mean{k} AS (
  SELECT part, m.entry AS entry, place, sum(x) AS s, count(*) AS n FROM comp JOIN near{k} USING (vec_id, part) GROUP BY ALL
), book{k + 1} AS MATERIALIZED (
  SELECT part, entry, place, CASE WHEN n IS NULL THEN c ELSE (s - (s % n + n) % n) // n END::BIGINT AS c
  FROM book{k} LEFT JOIN mean{k} USING (part, entry, place)
)"""
    return (
        out
        + f""", coded AS (
  SELECT vec_id, string_agg(printf('%02x', m.entry), '' ORDER BY part) AS code, sum(m.d)::BIGINT AS error FROM near{rounds} GROUP BY vec_id
)
SELECT vec_id, code, error, (sum(error) OVER (PARTITION BY label))::BIGINT AS label_error,
       (SELECT sha256(string_agg(c::VARCHAR, ',' ORDER BY part, entry, place)) FROM book{rounds}) AS codebooks_sha256
FROM coded JOIN kept USING (vec_id)
"""
    )


OP13_SQL = _sql()
