"""Labelled training rows: the fold that is held out, and a bounded deterministic sample."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def held_out(doc_id: Column) -> Column:
    """True where the CRC-32 of the id as text is divisible by 5; a null id isn't held out."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.lit(False))


def sample(docs: DataFrame, labels: DataFrame, column: str, per_class: int, seed: int = 11) -> DataFrame:
    """``(doc_id, text, label)``: of each class at most ``per_class`` labelled documents that aren't held out.

    They are those with the smallest seeded hashes of their ids, so the choice doesn't depend on the layout. A document
    with several labels counts as 1 if any is 1. Only ids and labels pass through the driver: two bounded lists. The chosen
    rows, a few thousand, are dealt over the cores, wherever they lay.
    """
    known = labels.where(F.col("doc_id").isNotNull() & F.col(column).isin(0, 1) & ~held_out(F.col("doc_id")))
    known = known.groupBy("doc_id").agg(F.max(F.col(column).cast("int")).alias("label"))
    chosen = [r for k in (0, 1) for r in known.where(F.col("label") == k).orderBy(F.xxhash64(F.lit(seed), "doc_id"), "doc_id").limit(per_class).collect()]
    listed = docs.sparkSession.createDataFrame([(r.doc_id, r.label) for r in chosen], "_id long, label int")
    found = docs.select("doc_id", "text").join(F.broadcast(listed), F.col("doc_id") == F.col("_id")).select("doc_id", "text", "label")
    return found.repartition(docs.sparkSession.sparkContext.defaultParallelism, "doc_id")
