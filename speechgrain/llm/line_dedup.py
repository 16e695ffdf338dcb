"""Line de-duplication over a whole corpus, in DataFrame operations only.

Lines are exploded without their text: 128 bits of hash, the document and the position travel, hashed and written once.
Counting is a combinable aggregate per hash, so a line that every document holds costs one row for each task. Only
positions to drop go back to the documents, which are joined once and cut by array slices in linear time.

Defined cases: a null or empty text is one empty line; a null ``doc_id`` keeps its text and counts nowhere; rows that
repeat a ``doc_id`` count as one document; of documents that tie for a line only the id decides, so equal ids all keep it;
a very long text costs time and memory in proportion to its length; extra columns pass through, whatever their names.
Empty tables give empty tables.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import WHITE_SPACE, ascii_lower, checkpointed, table


def line_key(line: Column) -> Column:
    """The line with white space stripped at both ends and A-Z lower-cased."""
    return ascii_lower(F.btrim(line, F.lit(WHITE_SPACE)))


def _lines(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n", -1)


def line_hashes(docs: DataFrame, min_chars: int = 10) -> DataFrame:
    """``(_id, _text_hash, _pos, _h1, _h2)`` for every line of ``docs(doc_id, text)`` whose key has ``min_chars`` code points."""
    lines = docs.where("doc_id is not null and text is not null").select(
        F.col("doc_id").alias("_id"), F.xxhash64("text").alias("_text_hash"), F.posexplode(_lines(F.col("text"))).alias("_pos", "_line")
    )
    keyed = lines.select("_id", "_text_hash", "_pos", line_key(F.col("_line")).alias("_key")).where(F.char_length("_key") >= min_chars)
    return keyed.select("_id", "_text_hash", "_pos", F.xxhash64("_key").alias("_h1"), F.xxhash64(F.lit(1), "_key").alias("_h2"))


def shared_lines(lines: DataFrame, min_docs: int = 2) -> DataFrame:
    """``(_h1, _h2, _first)``: lines that ``min_docs`` documents hold, and the smallest id that does."""
    if min_docs == 2:  # two distinct documents hold it if the least and the greatest differ
        return lines.groupBy("_h1", "_h2").agg(F.min("_id").alias("_first"), F.max("_id").alias("_last")).where("_first < _last").drop("_last")
    return lines.select("_h1", "_h2", "_id").distinct().groupBy("_h1", "_h2").agg(F.min("_id").alias("_first"), F.count("*").alias("_n")).where(F.col("_n") >= min_docs).drop("_n")


def dropped_positions(docs: DataFrame, min_chars: int = 10, min_docs: int = 2) -> DataFrame:
    """``(_id, _text_hash, _drop)``: sorted line positions to drop, for documents that lose any.

    Hashes are written once and read twice. The shared lines are written too: a join of two written tables is one that
    Spark may split at a key with many rows, or turn into a broadcast where it finds one side small.
    """
    lines = checkpointed(line_hashes(docs, min_chars))
    drop = lines.join(checkpointed(shared_lines(lines, min_docs)), ["_h1", "_h2"]).where("_id <> _first")
    return drop.groupBy("_id", "_text_hash").agg(F.array_sort(F.collect_set("_pos")).alias("_drop"))


def dedup_lines(docs: DataFrame, min_chars: int = 10, min_docs: int = 2) -> DataFrame:
    """``docs`` with ``text`` without repeated lines, and the columns ``n_lines`` and ``n_dropped``.

    A key of at least ``min_chars`` code points that ``min_docs`` documents hold stays in the smallest ``doc_id`` only.
    Columns of ``docs`` called ``n_lines`` or ``n_dropped`` are replaced.
    """
    drop = dropped_positions(docs.select("doc_id", "text"), min_chars, min_docs)
    own = {c: f"_c{k}" for k, c in enumerate(docs.columns) if c not in ("text", "n_lines", "n_dropped")}
    rows = docs.select(*[F.col(f"`{c}`").alias(n) for c, n in own.items()], F.coalesce("text", F.lit("")).alias("_text"), F.xxhash64("text").alias("_key"))
    joined = rows.join(drop, (F.col(own["doc_id"]) == F.col("_id")) & (F.col("_key") == F.col("_text_hash")), "left")
    n = (F.char_length("_text") - F.char_length(F.replace("_text", F.lit("\n"), F.lit(""))) + 1).cast("long")
    kept = F.when(F.col("_drop").isNull(), F.col("_text")).otherwise(_without(F.col("_text"), F.col("_drop")))
    made = {"text": kept, **{c: F.col(n) for c, n in own.items()}}
    return joined.select(
        *[made[c].alias(c) for c in docs.columns if c in made], n.alias("n_lines"), F.coalesce(F.size("_drop"), F.lit(0)).cast("long").alias("n_dropped")
    )


def _without(text: Column, drop: Column) -> Column:
    """The text without the lines at the ascending positions ``drop``: the runs between them, cut from the lines and joined.

    The lines are bound once, as the one element of an array that ``transform`` walks, so that no run splits the text again.
    """

    def runs(lines: Column) -> Column:
        ends = F.concat(F.array(F.lit(-1)), drop, F.array(F.size(lines)))
        return F.flatten(F.zip_with(F.slice(ends, 1, F.size(drop) + 1), F.slice(ends, 2, F.size(drop) + 1), lambda a, b: F.slice(lines, a + 2, b - a - 1)))

    return F.array_join(F.get(F.transform(F.array(_lines(text)), runs), F.lit(0)), "\n")


def op2_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = dedup_lines(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return docs.select("doc_id", "n_lines", "n_dropped", F.sha2(F.encode("text", "UTF-8"), 256).alias("kept_sha256"))


OP2_SQL = r"""
WITH lines AS (
  SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line,
         generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS pos
  FROM documents
), keyed AS (
  SELECT *, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
                      'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS k
  FROM lines
), shared AS (
  SELECT k, min(doc_id) AS first FROM keyed WHERE length(k) >= 10
  GROUP BY k HAVING count(DISTINCT doc_id) >= 2
), marked AS (
  SELECT keyed.*, shared.first IS NOT NULL AND shared.first <> doc_id AS gone
  FROM keyed LEFT JOIN shared ON keyed.k = shared.k
)
SELECT doc_id, count(*)::BIGINT AS n_lines, sum(gone::INT)::BIGINT AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT gone), '')) AS kept_sha256
FROM marked GROUP BY doc_id
"""
