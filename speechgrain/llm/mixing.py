"""Mixing sources to target weights along a time-varying curriculum, in DataFrame operations only.

Every source has a weight and a schedule ``1 + g * (2t - 1)`` over training time t in [0, 1]. The integral of the schedule
is its cumulative demand of words, ``target * ((1 - g) * t + g * t**2)``; a document that begins after ``c`` words of its
source's sequence stands where that demand reaches ``c``. The sequence is a seeded hash order, repeated for later passes.

No window spans a source: hash order is cut into buckets of about ``BUCKET_ROWS`` rows, bucket sums are combined before the
shuffle, and prefix sums run over the buckets of a source and inside one bucket. A source with a third of all rows is spread
alike. Nor does a window span all sources: they are range-sorted, and prefix sums run over partitions and inside one.

Defined cases: a null text has size 0 and is never taken; a null source is a source of its own, last in order; repeated
rows are documents of their own; documents tie in hash order if their ids are equal or null, and then follow the hashes of
their texts (rows equal in both are interchangeable); a document longer than what is left of its target is passed over, and
later ones are tried; a null ``doc_id`` is allowed; an empty table gives an empty table; extra columns of the documents are
ignored by ``plan_mix`` and kept by ``mixed_documents``.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import checkpointed, table

BUCKET_ROWS, HASH_BITS = 1_000, 60
#: Words of a partition of mixed documents (some 60 MB).
PART_WORDS = 10_000_000
WEIGHTS = (3.0, 1.0, 2.0)
#: Slopes g of the schedules, repeating over the sources in order: early, even and late sources.
SLOPES = (-0.5, 0.0, 0.5)
SHARE, MOST = 1.5, 2.0


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def _cycle(rank: Column, values: tuple[float, ...]) -> Column:
    return F.element_at(F.array(*map(F.lit, values)), F.pmod(rank - 1, F.lit(len(values))).cast("int") + 1)


def _sorted(rows: DataFrame, *order: Column | str) -> DataFrame:
    """``rows`` range-sorted and written, with the partition of each (``_part``) and its place there (``_at``)."""
    number = F.monotonically_increasing_id()
    return checkpointed(rows.orderBy(*order).select("*", number.alias("_at"))).withColumn("_part", F.shiftright("_at", 33)).withColumn("_at", F.col("_at") % (1 << 33))


def _running(rows: DataFrame, sums: dict[str, Column]) -> DataFrame:
    """``_sorted`` rows with the sum of each of ``sums`` over all rows before, and over all (a few figures for each partition)."""
    parts = rows.groupBy("_part").agg(*[F.sum(c).alias(n) for n, c in sums.items()])
    before = W.orderBy("_part").rowsBetween(W.unboundedPreceding, -1)
    offsets = parts.select("_part", *[F.coalesce(F.sum(n).over(before), F.lit(0)).alias(f"_{n}_from") for n in sums], *[F.sum(n).over(W.partitionBy()).alias(f"{n}_all") for n in sums])
    inside = W.partitionBy("_part").orderBy("_at").rowsBetween(W.unboundedPreceding, -1)
    named = rows.select("*", *[(F.coalesce(F.sum(c).over(inside), F.lit(0))).alias(f"_{n}_in") for n, c in sums.items()]).join(offsets, "_part")
    return named.withColumns({f"{n}_before": F.col(f"_{n}_from") + F.col(f"_{n}_in") for n in sums}).drop(*[f"_{n}_{x}" for n in sums for x in ("from", "in")])


def source_targets(sizes: DataFrame, weights=WEIGHTS, slopes=SLOPES, share: float = SHARE, most: float = MOST) -> DataFrame:
    """One row per source of ``sizes(_src, source, source_size)`` with its ``target`` and slope.

    The level L that solves ``sum(min(most * size, L * weight)) = share * total`` comes from running sums over the sources
    in the order in which they reach their caps. That is where repeated resharing of the excess ends.
    """
    ranked = _running(_sorted(sizes, F.col("source").asc_nulls_last()), {"n": F.lit(1)}).withColumn("_rank", F.col("n_before") + 1)
    ranked = ranked.select("_src", "source_size", "_rank", _cycle(F.col("_rank"), tuple(weights)).alias("_w"), _cycle(F.col("_rank"), tuple(slopes)).alias("_g"), (most * F.col("source_size")).alias("_cap"))
    at = F.col("_cap") / F.col("_w")
    run = _running(_sorted(ranked, at, "_rank"), {"size": F.col("source_size"), "cap": F.col("_cap"), "w": F.col("_w")})
    level = (share * F.col("size_all") - F.col("cap_before")) / (F.col("w_all") - F.col("w_before"))
    # the first source that doesn't reach its cap sets the level for all from there on
    found = run.agg(F.min_by(F.when(at >= level, level), F.when(at >= level, F.struct(at.alias("at"), "_rank")))).first()[0]
    target = F.col("_cap") if found is None else F.least("_cap", F.lit(found) * F.col("_w"))
    return run.select("_src", "source_size", "_g", target.alias("target"))


def hash_order(doc_id: Column, seed: int) -> Column:
    """The first ``HASH_BITS`` of the MD5 of seed and id, as a whole number."""
    text = F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit("")))
    return F.conv(F.substring(F.md5(text.cast("binary")), 1, HASH_BITS // 4), 16, 10).cast("long")


def _begins(rows: DataFrame, keys: list[str]) -> DataFrame:
    """``rows(_src, _bucket, _h, size, ...)`` with ``_begin``: words before the row in its source's hash order."""
    sums = rows.groupBy("_src", "_bucket").agg(F.sum("size").alias("_sum"))
    earlier = W.partitionBy("_src").orderBy("_bucket").rowsBetween(W.unboundedPreceding, -1)
    starts = sums.select("_src", "_bucket", F.coalesce(F.sum("_sum").over(earlier), F.lit(0)).alias("_start"))
    inside = W.partitionBy("_src", "_bucket").orderBy("_h", "_tie", *keys).rowsBetween(W.unboundedPreceding, -1)
    return rows.withColumn("_in", F.coalesce(F.sum("size").over(inside), F.lit(0))).join(starts, ["_src", "_bucket"]).withColumn("_begin", F.col("_start") + F.col("_in")).drop("_start", "_in")


def _by_bucket(rows: DataFrame, per_source: DataFrame) -> DataFrame:
    """``rows`` joined to one row per source by source and bucket, so that no source meets in one task."""
    return rows.join(rows.select("_src", "_bucket").distinct().join(per_source, "_src"), ["_src", "_bucket"])


def plan_mix(docs: DataFrame, keys: list[str], weights=WEIGHTS, slopes=SLOPES, share: float = SHARE, most: float = MOST, seed: int = 7) -> DataFrame:
    """``keys`` of each document with size, source_size, target, passes, taken and the positions of its passes.

    Whole documents are taken: each ``floor(target / source_size)`` times, and once more while documents in hash order fit
    into the rest of the target. Two more rounds fill what is left with documents that are no larger than the gap.
    ``positions`` has one training time in [0, 1] for each pass.
    """
    narrow = checkpointed(
        docs.select(
            *keys,
            F.when(F.col("source").isNull(), F.lit("0")).otherwise(F.concat(F.lit("1"), F.col("source"))).alias("_src"),
            F.col("source").alias("_source"),
            word_count(F.col("text")).alias("size"),
            hash_order(F.col("doc_id"), seed).alias("_h"),
            F.xxhash64("text").alias("_tie"),
        )
    )
    bits = max(0, math.ceil(math.log2(max(narrow.count(), 1) / BUCKET_ROWS)))
    narrow = narrow.withColumn("_bucket", F.shiftright("_h", HASH_BITS - bits))
    sizes = narrow.groupBy("_src").agg(F.sum("size").alias("source_size"), F.first("_source").alias("source"))
    whole = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(F.lit(0)).cast("long")
    targets = source_targets(sizes, weights, slopes, share, most).withColumn("_whole", whole).withColumn("_gap", F.col("target") - whole * F.col("source_size"))
    left = _by_bucket(_begins(narrow.drop("_source"), keys), targets).withColumn("_first", F.col("_begin"))
    done = []
    for last in (False, False, True):
        fits = F.col("_begin") + (F.col("size") / 2 if last else F.col("size")) <= F.col("_gap")
        left = left.withColumn("_extra", (fits & (F.col("size") > 0)).cast("long"))
        if last:
            done.append(left)
            break
        left = checkpointed(left)
        gaps = left.groupBy("_src").agg((F.first("_gap") - F.sum(F.col("_extra") * F.col("size"))).alias("_gap"))
        rest = _by_bucket(left.drop("_gap"), gaps)
        open_ = (F.col("_extra") == 0) & (F.col("size") > 0) & (F.col("size") <= F.col("_gap"))
        rest = checkpointed(rest.withColumn("_open", open_))
        done.append(rest.where("not _open").drop("_open"))
        left = _begins(rest.where("_open").drop("_open", "_begin"), keys)
    out = done[0]
    for more in done[1:]:
        out = out.unionByName(more)
    out = out.withColumn("passes", F.when(F.col("size") > 0, F.col("_whole") + F.col("_extra")).otherwise(F.lit(0)).cast("long"))
    ends = F.col("_first") + F.col("size") / 2
    at = lambda k: _time(F.least((ends + k * F.col("source_size")) / F.col("target"), F.lit(1.0)), F.col("_g"))
    positions = F.when(F.col("passes") > 0, F.transform(F.sequence(F.lit(0).cast("long"), F.col("passes") - 1), at)).otherwise(F.array().cast("array<double>"))
    return out.select(*keys, "size", "source_size", "target", "passes", (F.col("passes") * F.col("size")).alias("taken"), positions.alias("positions"))


def _time(part: Column, g: Column) -> Column:
    """t where ``(1 - g) * t + g * t**2`` reaches ``part``."""
    root = F.sqrt((1 - g) * (1 - g) + 4 * g * part)
    return F.when(g == 0, part).otherwise((root - (1 - g)) / (2 * g))


def mixed_documents(docs: DataFrame, **options) -> DataFrame:
    """``docs`` as the mix takes them: a row for each pass, range-sorted by training position. Columns stay as they were.

    Rows that are equal in id, text, lang and source share the passes of all of them. Texts are shuffled twice: to their
    positions, and into ranges of positions. As demand is even over time but for the slopes, ranges of equal width
    hold alike many words, so no sample is read to find their bounds.
    """
    rest = [c for c in ("lang", "source") if c in docs.columns]
    id_key, text_key = F.coalesce(F.col("doc_id").cast("string"), F.lit("-")).alias("_id"), F.xxhash64("text", *rest).alias("_key")
    plan = plan_mix(docs.select("doc_id", "text", "source", id_key, text_key), ["_id", "_key"], **options)
    plan = plan.where("passes > 0").groupBy("_id", "_key").agg(F.array_sort(F.flatten(F.collect_list("positions"))).alias("_positions"), F.sum("taken").alias("_words"))
    plan = checkpointed(plan)
    parts = max(1, math.ceil((plan.agg(F.sum("_words")).first()[0] or 0) / PART_WORDS))
    own = {c: f"_c{k}" for k, c in enumerate(docs.columns)}
    once = docs.select(*[F.col(f"`{c}`").alias(n) for c, n in own.items()], id_key, text_key)
    once = once.withColumn("_n", F.row_number().over(W.partitionBy("_id", "_key").orderBy(F.lit(0)))).where("_n = 1")
    rows = once.join(plan, ["_id", "_key"]).select(*own.values(), "_id", "_key", F.explode("_positions").alias("_position"))
    range_ = F.least(F.floor(F.col("_position") * parts), F.lit(parts - 1)).cast("int")
    return rows.repartitionById(parts, range_).sortWithinPartitions("_position", "_id", "_key").select(*[F.col(n).alias(c) for c, n in own.items()])


def op10_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", "text")
    plan = plan_mix(docs, ["doc_id"])
    return plan.select("doc_id", "size", "source_size", "target", "taken", F.get("positions", F.lit(0)).alias("first_position"))


OP10_SQL = r"""
WITH sized AS (
  SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^ 	-
]+')), 0)::BIGINT AS size, left(md5('7:' || doc_id), 15) AS h FROM documents
), sources AS (
  SELECT source, sum(size)::BIGINT AS source_size, row_number() OVER (ORDER BY source NULLS LAST) AS rank FROM sized GROUP BY source
), capped AS (
  SELECT *, [3.0::DOUBLE, 1.0, 2.0][(rank - 1) % 3 + 1] AS w, [-0.5::DOUBLE, 0.0, 0.5][(rank - 1) % 3 + 1] AS g, 2.0::DOUBLE * source_size AS cap FROM sources
), levels AS (
  SELECT *, (1.5::DOUBLE * sum(source_size) OVER () - coalesce(sum(cap) OVER (o ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) /
            (sum(w) OVER () - coalesce(sum(w) OVER (o ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) AS level
  FROM capped WINDOW o AS (ORDER BY cap / w, rank)
), chosen AS (
  SELECT arg_min(level, (cap / w, rank)) AS level FROM levels WHERE cap / w >= level
), targets AS (
  SELECT source, source_size, g, CASE WHEN chosen.level IS NULL THEN cap ELSE least(cap, chosen.level * w) END AS target FROM levels, chosen
), whole AS (
  SELECT *, CASE WHEN source_size > 0 THEN floor(target / source_size)::BIGINT ELSE 0 END AS passes FROM targets
), gaps AS (
  SELECT *, target - passes * source_size AS gap FROM whole
), one AS (
  SELECT s.doc_id, s.size, s.h, t.*, coalesce(sum(size) OVER (PARTITION BY t.source ORDER BY h ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS begin
  FROM sized s JOIN gaps t ON s.source IS NOT DISTINCT FROM t.source
), one_taken AS (
  SELECT *, size > 0 AND begin + size <= gap AS t1 FROM one
), one_left AS (
  SELECT *, gap - sum(CASE WHEN t1 THEN size ELSE 0 END) OVER (PARTITION BY source) AS gap2 FROM one_taken
), two AS (
  SELECT *, NOT t1 AND size > 0 AND size <= gap2 AS o2 FROM one_left
), two_begin AS (
  SELECT *, coalesce(sum(CASE WHEN o2 THEN size ELSE 0 END) OVER (PARTITION BY source ORDER BY h ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS begin2 FROM two
), two_taken AS (
  SELECT *, o2 AND begin2 + size <= gap2 AS t2 FROM two_begin
), two_left AS (
  SELECT *, gap2 - sum(CASE WHEN t2 THEN size ELSE 0 END) OVER (PARTITION BY source) AS gap3 FROM two_taken
), three AS (
  SELECT *, o2 AND NOT t2 AND size <= gap3 AS o3 FROM two_left
), three_begin AS (
  SELECT *, coalesce(sum(CASE WHEN o3 THEN size ELSE 0 END) OVER (PARTITION BY source ORDER BY h ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS begin3 FROM three
), done AS (
  SELECT *, CASE WHEN size > 0 THEN passes + (t1 OR t2 OR (o3 AND begin3 + size / 2.0::DOUBLE <= gap3))::BIGINT ELSE 0 END AS n,
         least((begin + size / 2.0::DOUBLE) / target, 1.0::DOUBLE) AS part
  FROM three_begin
)
SELECT doc_id, size, source_size, target, n * size AS taken,
       CASE WHEN n = 0 THEN NULL WHEN g = 0 THEN part ELSE (sqrt((1 - g) * (1 - g) + 4 * g * part) - (1 - g)) / (2 * g) END AS first_position
FROM done
"""
