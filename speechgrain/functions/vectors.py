"""Vector expressions over array columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def cosine(a: Column, b: Column, norm_a: Column | None = None, norm_b: Column | None = None) -> Column:
    """Cosine similarity; 0 if either vector is zero. Vectors of different lengths raise, null ones give null."""
    length = (norm(a) if norm_a is None else norm_a) * (norm(b) if norm_b is None else norm_b)
    unlike = F.raise_error(F.concat(F.lit("vectors of lengths "), F.size(a).cast("string"), F.lit(" and "), F.size(b).cast("string")))
    return F.when(a.isNull() | b.isNull(), F.lit(None)).when(F.size(a) != F.size(b), unlike.cast("double")).when(length == 0, 0.0).otherwise(dot(a, b) / length)
