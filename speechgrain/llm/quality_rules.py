"""Quality rules: figures of a text, and lines that too many documents of a host hold.

Lines are normalised (white space stripped, A-Z lower-cased) and hashed to 128 bits. Distinct documents are counted for each
host and hash, combined before the shuffle. A line is too frequent when more than ``SHARE`` of its host's documents and more
than ``LEAST_DOCS`` hold it; it is then removed from all of them. A document is rejected when what is left is less than
``LEFT`` of its words or less than ``LEAST_WORDS`` words. Texts are read once: figures and line hashes are written to the
shared folder, and only hashes are shuffled. The frequent lines are written too: a host has at most 1 / ``SHARE`` times as many
of them as its documents hold lines on average, and a line that a whole host holds is a joined key that Spark may split.

``keep_first`` (off by default) leaves a frequent line in the smallest ``doc_id`` of the host that holds it, so that one of
a large group of copies stays whole. The pipeline's stage uses it, since its later stages choose among copies.

Defined cases: a null text has no words and fails; a null host is a host of its own; rows that repeat a doc_id are one
document of their host and get a row each; a null doc_id is a document of its own for each row and never comes first; ties
need no order, for all holders of a line are treated alike (with ``keep_first`` rows that repeat the smallest id all keep
it); a very long text costs time and memory in proportion to its length; an empty table gives an empty table; extra columns
are ignored by ``judge`` and kept by ``kept_documents``. ``judge`` counts the words of removed lines, ``kept_documents``
removes the lines.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import checkpointed, table, written

SYMBOLS = b"#*$%&|<>"
WINDOW, LEAST_WORDS, REPEATS, HELD = 8, 20, 0.30, 100_000
SHARE, LEAST_DOCS, LEFT = 0.10, 4, 0.30
FIGURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
_LOWER = bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256))
_SPACE = b" \t\n\x0b\x0c\r"


def _bytes(text: str | None) -> bytes:
    return (text or "").encode("utf-8", "surrogatepass")


def _factors(n: int) -> np.ndarray:
    return np.random.default_rng(23).integers(1, 1 << 63, n, dtype=np.int64).astype(np.uint64) | np.uint64(1)


def repeated_words(words: list[bytes], window: int = WINDOW) -> int:
    """Words inside windows of ``window`` words that the text has more than once, first ones included."""
    if len(words) <= window:
        return 0
    ids = np.fromiter(map(hash, words), np.int64, len(words)).view(np.uint64)
    n = len(words) - window + 1
    sums = np.zeros(n, np.uint64)
    for k, factor in enumerate(_factors(window)):
        sums += (ids[k : k + n] ^ (ids[k : k + n] >> np.uint64(29))) * factor
    order = np.argsort(sums, kind="stable")
    same = sums[order][1:] == sums[order][:-1]
    one, other = order[1:][same], order[:-1][same]
    twice = np.zeros(n, bool)
    if all((ids[one + k] == ids[other + k]).all() for k in range(window)):
        twice[one] = twice[other] = True
    else:  # sums of different windows met by chance
        windows = [tuple(words[k : k + window]) for k in range(n)]
        counts = Counter(windows)
        twice[:] = [counts[w] > 1 for w in windows]
    edges = np.zeros(len(words) + 1, np.int64)
    np.add.at(edges, np.flatnonzero(twice), 1)
    np.add.at(edges, np.flatnonzero(twice) + window, -1)
    return int(np.count_nonzero(np.cumsum(edges[:-1]) > 0))


def text_figures(text: str | None) -> tuple[int, int, int, int, int]:
    """(n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words)."""
    data = _bytes(text)
    words = data.split()
    joined = b"".join(words)
    symbols = sum(map(joined.count, (SYMBOLS[i : i + 1] for i in range(len(SYMBOLS)))))
    lines = [line for line in data.split(b"\n") if line.strip(_SPACE)]
    return len(words), len(joined.decode("utf-8", "surrogatepass")), symbols, len(lines) - len(set(lines)), repeated_words(words)


def line_counts(text: str | None) -> dict[bytes, int]:
    """Words by 128-bit hash of the normalised lines that have any."""
    import xxhash

    out: dict[bytes, int] = {}
    for line in _bytes(text).translate(_LOWER).split(b"\n"):
        if line := line.strip(_SPACE):
            key = xxhash.xxh3_128_digest(line)
            out[key] = out.get(key, 0) + len(line.split())
    return out


def _named(host: str) -> Column:
    return F.when(F.col(host).isNull(), F.lit("0")).otherwise(F.concat(F.lit("1"), F.col(host)))


def figures(docs: DataFrame, host: str) -> DataFrame:
    """A row for each document: its keys, figures, and the hashes and words of its distinct lines.

    A worker holds one Arrow batch of texts, and writes after 500 of them or ``HELD`` lines.
    """
    schema = pa.schema([("doc_id", pa.int64()), ("_key", pa.int64()), ("_host", pa.string()), ("lines", pa.list_(pa.binary())), ("words", pa.list_(pa.int32())), *[(n, pa.int64()) for n in FIGURES]])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        frame = lambda rows: pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), schema.types, strict=True)], schema=schema)
        for batch in batches:
            rows, held = [], 0
            for *keys, text in zip(*batch.columns, strict=True):
                text = text.as_py()
                lines = line_counts(text)
                rows.append((*[k.as_py() for k in keys], list(lines), list(lines.values()), *text_figures(text)))
                held += len(lines)
                if len(rows) == 500 or held > HELD:
                    yield frame(rows)
                    rows, held = [], 0
            if rows:
                yield frame(rows)

    asked = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("_key"), _named(host).alias("_host"), F.col("text").alias("_text"))
    return asked.mapInArrow(run, "doc_id long, _key long, _host string, lines array<binary>, words array<int>, " + ", ".join(f"{n} long" for n in FIGURES))


def _judged(docs: DataFrame, listed: bool, host: str = "source", share: float = SHARE, least_docs: int = LEAST_DOCS, left: float = LEFT, least_words: int = LEAST_WORDS, repeats: float = REPEATS, keep_first: bool = False) -> DataFrame:
    """The columns of ``judge``, and if ``listed`` also ``_host`` and the hashes of the lines to remove (``_lines``, or null)."""
    found = figures(docs, host).withColumn("_row", F.monotonically_increasing_id())
    found = checkpointed(found.withColumn("_none", F.when(F.col("doc_id").isNull(), F.col("_row"))))  # a document of its own
    lines = found.select("_row", "doc_id", "_none", "_host", F.explode(F.arrays_zip("lines", "words")).alias("_l"))
    lines = lines.select("_row", "doc_id", "_none", "_host", F.col("_l.lines").alias("line"), F.col("_l.words").alias("n"))
    once = lines.select("_host", "line", "doc_id", "_none").distinct()
    counts = once.groupBy("_host", "line").agg(F.count("*").alias("_docs"), F.min("doc_id").alias("_first")).where(F.col("_docs") > least_docs)
    hosts = found.select("_host", "doc_id", "_none").distinct().groupBy("_host").agg(F.count("*").alias("_all"))
    often = written(counts.join(hosts, "_host").where(F.col("_docs") > share * F.col("_all")).select("_host", "line", "_first"))
    held = lines.join(often, ["_host", "line"])
    if keep_first:
        held = held.where(~F.col("doc_id").eqNullSafe(F.col("_first")))
    gone = held.groupBy("_row").agg(F.sum("n").alias("_gone"), *[F.collect_set("line").alias("_lines")][: int(listed)])
    removed = F.coalesce("_gone", F.lit(0)).cast("long")
    failed = (F.col("n_words") < least_words) | (100 * F.col("n_repeat_words") > round(100 * repeats) * F.col("n_words"))
    rest = F.col("n_words") - F.col("n_removed_words")
    judged = found.drop("lines", "words").join(gone, "_row", "left").withColumn("n_removed_words", removed).withColumn("base_failed", failed)
    depleted = (F.col("n_removed_words") > 0) & ((rest < least_words) | (rest < left * F.col("n_words")))
    return judged.select("doc_id", "_key", *FIGURES, "base_failed", "n_removed_words", (~F.col("base_failed") & ~depleted).alias("kept"), *["_host", "_lines"][: 2 * listed])


def judge(docs: DataFrame, **options) -> DataFrame:
    """``doc_id``, ``_key`` (hash of the text), the figures, ``base_failed``, ``n_removed_words`` and ``kept`` for every row."""
    return _judged(docs, False, **options)


def without_lines(text: str, gone: set[bytes]) -> str:
    """The text without the lines whose normalised form has one of the hashes ``gone``."""
    import xxhash

    key = lambda line: xxhash.xxh3_128_digest(_bytes(line).translate(_LOWER).strip(_SPACE))
    return "\n".join(line for line in text.split("\n") if key(line) not in gone)


def kept_documents(docs: DataFrame, host: str = "source", **options) -> DataFrame:
    """The rows of ``docs`` that the rules keep, their too frequent lines removed, columns as they were."""

    @F.pandas_udf("string")
    def cut(texts: pd.Series, gone: pd.Series) -> pd.Series:
        return pd.Series([None if t is None else without_lines(t, set(g)) for t, g in zip(texts, gone, strict=True)], dtype=object)

    name = F.coalesce(F.col("doc_id").cast("string"), F.lit("-")).alias("_id")
    good = _judged(docs, True, host=host, **options).where("kept").select(name, "_key", "_host", "_lines").dropDuplicates(["_id", "_key", "_host"])
    keyed = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row"), name, F.xxhash64("text").alias("_key"), _named(host).alias("_host"))
    joined = keyed.join(good, ["_id", "_key", "_host"])
    text = F.coalesce(cut(F.when(F.col("_lines").isNotNull(), F.col("_row.text")), F.coalesce("_lines", F.array().cast("array<binary>"))), F.col("_row.text"))
    return joined.select(*[text.alias(c) if c == "text" else F.col(f"_row.`{c}`") for c in docs.columns])


def op9_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = judge(table(spark, sf_dir, "documents").select("doc_id", "text", "source"))
    return judged.select("doc_id", *FIGURES, "base_failed", "kept", "n_removed_words")


OP9_SQL = r"""
WITH words AS (
  SELECT doc_id, unnest(regexp_extract_all(text, '[^\x20\x09-\x0D]+')) AS word, generate_subscripts(regexp_extract_all(text, '[^\x20\x09-\x0D]+'), 1) AS pos
  FROM documents
), windows AS (
  SELECT doc_id, word, pos, list(word) OVER w AS win, count(*) OVER w AS n
  FROM words WINDOW w AS (PARTITION BY doc_id ORDER BY pos ROWS BETWEEN CURRENT ROW AND 7 FOLLOWING)
), twice AS (
  SELECT doc_id, word, pos, n = 8 AND count(*) OVER (PARTITION BY doc_id, win) > 1 AS twice FROM windows
), covered AS (
  SELECT doc_id, word, max(twice::INT) OVER (PARTITION BY doc_id ORDER BY pos ROWS BETWEEN 7 PRECEDING AND CURRENT ROW) AS again FROM twice
), of_words AS (
  SELECT doc_id, count(*) AS n_words, sum(length(word)) AS word_chars, sum(len(regexp_extract_all(word, '[#*$%&|<>]'))) AS n_symbols, sum(again) AS n_repeat_words
  FROM covered GROUP BY doc_id
), raw AS (
  SELECT doc_id, source, unnest(string_split(text, chr(10))) AS line FROM documents
), lines AS (
  SELECT doc_id, source, line, len(regexp_extract_all(line, '[^\x20\x09-\x0D]+')) AS n,
         translate(trim(line, ' ' || chr(9) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key
  FROM raw WHERE regexp_matches(line, '[^\x20\x09-\x0D]')
), hosts AS (
  SELECT source, count(DISTINCT doc_id) AS held FROM documents GROUP BY source
), often AS (
  SELECT l.source, key FROM lines l JOIN hosts h ON l.source IS NOT DISTINCT FROM h.source
  GROUP BY l.source, key, held HAVING count(DISTINCT doc_id) > 4 AND count(DISTINCT doc_id) > 0.1::DOUBLE * held
), of_lines AS (
  SELECT doc_id, count(*) - count(DISTINCT line) AS n_dup_lines, sum(n) FILTER (o.key IS NOT NULL) AS removed
  FROM lines l LEFT JOIN often o ON l.source IS NOT DISTINCT FROM o.source AND l.key = o.key GROUP BY doc_id
), figures AS (
  SELECT doc_id, coalesce(n_words, 0)::BIGINT AS n_words, coalesce(word_chars, 0)::BIGINT AS word_chars, coalesce(n_symbols, 0)::BIGINT AS n_symbols,
         coalesce(n_dup_lines, 0)::BIGINT AS n_dup_lines, coalesce(n_repeat_words, 0)::BIGINT AS n_repeat_words, coalesce(removed, 0)::BIGINT AS n_removed_words
  FROM documents LEFT JOIN of_words USING (doc_id) LEFT JOIN of_lines USING (doc_id)
), judged AS (
  SELECT *, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed, n_words - n_removed_words AS rest FROM figures
)
SELECT * EXCLUDE (rest), NOT base_failed AND NOT (n_removed_words > 0 AND (rest < 20 OR rest < 0.3::DOUBLE * n_words)) AS kept FROM judged
"""
