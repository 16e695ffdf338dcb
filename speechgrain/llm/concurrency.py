"""Peak concurrency: how many intervals of a group are open at each moment, by windows of two levels.

1. Every interval becomes a start and an end; those of a group and second are added up before and after the shuffle, so a
   day of a group has at most 86,400 rows, whatever the input. Seconds at which nothing changes go.
2. First level, in a group's day: running sums, their running maximum and the next moment.
3. Second level, over the group's days: a day's subtotals, largest sums and first moment give what the day begins with, the
   highest count before it, the next day's first moment and the group's largest weight. A group has a row a day there.
4. The days' carries join their moments again, by group and day.

No window spans more than a day of a group or the days of a group. All joins are merge joins of shuffled rows: nothing is
broadcast or collected. The shuffle by group and day serves both levels.

Defined cases: an interval without a start, or with an end that isn't after its start, takes no part; one without an end
stays open; a null weight is 0; a null group is a group of its own; intervals that repeat count each; moments at which starts
and ends cancel out give no row; an empty table gives an empty table; extra columns are ignored. Texts play no part. Sums
of weights have to fit a long.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import table, written

BUCKET_S = 86_400


def seconds(c: str) -> Column:
    """A timestamp without a zone as seconds since 1970, rounded down; the session's time zone plays no part."""
    days = F.datediff(F.col(c).cast("date"), F.lit("1970-01-01").cast("date")).cast("long")
    return days * 86_400 + F.hour(c) * 3600 + F.minute(c) * 60 + F.second(c)


def open_counts(intervals: DataFrame, bucket_s: int = BUCKET_S) -> DataFrame:
    """``(group, from_s, to_s, n_open, open_weight, high_open, is_peak)`` for ``intervals(group, start_s, end_s, weight)``.

    A row holds from ``from_s`` (included) to ``to_s``, the group's next row; the last has none. ``high_open`` is the largest
    count so far, ``is_peak`` marks rows of the group's largest weight.
    """
    real = intervals.where("start_s is not null and (end_s is null or end_s > start_s)")
    weight = F.coalesce(F.col("weight").cast("long"), F.lit(0))
    turns = F.array(
        F.struct(F.col("start_s").alias("s"), F.lit(1).cast("long").alias("n"), weight.alias("w")),
        F.struct(F.col("end_s").alias("s"), F.lit(-1).cast("long").alias("n"), (-weight).alias("w")),
    )
    each = real.select("group", F.explode(turns).alias("_t")).where("_t.s is not null").select("group", F.floor(F.col("_t.s") / bucket_s).alias("day"), "_t.*")
    moments = each.groupBy("group", "day", "s").agg(F.sum("n").alias("n"), F.sum("w").alias("w")).where("n <> 0 or w <> 0")

    day = W.partitionBy("group", "day").orderBy("s")
    inside = moments.select("group", "day", "s", F.sum("n").over(day).alias("n"), F.sum("w").over(day).alias("w"), F.lead("s").over(day).alias("next_s"))
    inside = inside.withColumn("high", F.max("n").over(day.rowsBetween(W.unboundedPreceding, 0)))

    at_last = lambda c: F.max_by(c, "s").alias(f"last_{c}")
    days = inside.groupBy("group", "day").agg(at_last("n"), at_last("w"), F.max("n").alias("most_n"), F.max("w").alias("most_w"), F.min("s").alias("first_s"))
    order = W.partitionBy("group").orderBy("day")
    before = order.rowsBetween(W.unboundedPreceding, -1)
    carries = days.select(
        "group", "day", "most_n", "most_w", F.coalesce(F.sum("last_n").over(before), F.lit(0)).alias("base_n"), F.coalesce(F.sum("last_w").over(before), F.lit(0)).alias("base_w"),
        F.lead("first_s").over(order).alias("following_s"),
    )
    carries = carries.select(
        F.col("group").alias("_group"), F.col("day").alias("_day"), "base_n", "base_w", "following_s",
        F.max(F.col("base_n") + F.col("most_n")).over(before).alias("high_before"), F.max(F.col("base_w") + F.col("most_w")).over(W.partitionBy("group")).alias("peak"),
    )
    joined = inside.join(carries.hint("merge"), F.col("group").eqNullSafe(F.col("_group")) & (F.col("day") == F.col("_day")))
    return joined.select(
        "group", F.col("s").alias("from_s"), F.coalesce("next_s", "following_s").alias("to_s"), (F.col("base_n") + F.col("n")).alias("n_open"), (F.col("base_w") + F.col("w")).alias("open_weight"),
        F.greatest("high_before", F.col("base_n") + F.col("high")).alias("high_open"), (F.col("base_w") + F.col("w") == F.col("peak")).alias("is_peak"),
    )


def sale_intervals(sales: DataFrame, sale_lines: DataFrame, clients: DataFrame) -> DataFrame:
    """``(group, start_s, end_s, weight)``: each sale for its client's nation (-1: none) and again for -2, in cents.

    A sale is open from sold_at to its first shipped_at and a day. Lines are reduced to a time a sale before they are shuffled.
    Clients (smallest nation, if an id repeats) and ends are written, so that Spark can split a client or sale that holds many
    rows. Sales whose total is null or not finite weigh 0.
    """
    ends = written(sale_lines.where("sale_id is not null and shipped_at is not null").groupBy("sale_id").agg(F.min("shipped_at").alias("shipped_at")))
    ends = ends.select("sale_id", (seconds("shipped_at") + BUCKET_S).alias("end_s"))
    nations = written(clients.where("client_id is not null").groupBy("client_id").agg(F.min(F.col("nation_id").cast("int")).alias("nation_id")))
    finite = F.col("total").isNotNull() & ~F.isnan("total") & (F.abs("total") < float("inf"))
    cents = F.when(finite, F.floor(100 * F.col("total") + 0.5)).otherwise(0)
    own = sales.where("sold_at is not null").select("sale_id", "client_id", seconds("sold_at").alias("start_s"), cents.cast("long").alias("weight"))
    timed = own.join(ends.hint("merge"), "sale_id", "left").where("end_s is null or end_s > start_s")
    placed = timed.join(nations.hint("merge"), "client_id", "left")
    return placed.select(F.explode(F.array(F.coalesce("nation_id", F.lit(-1)), F.lit(-2))).alias("group"), "start_s", "end_s", "weight")


def op11_open_sales(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = open_counts(sale_intervals(*(table(spark, sf_dir, name) for name in ("sales", "sale_lines", "clients"))))
    return found.select(F.col("group").alias("nation_id"), "from_s", "to_s", "n_open", F.col("open_weight").alias("open_cents"), "high_open", "is_peak")


OP11_SQL = """
WITH ends AS (
  SELECT sale_id, floor(epoch(min(shipped_at)))::BIGINT + 86400 AS b FROM sale_lines GROUP BY sale_id
), nations AS (
  SELECT client_id, min(nation_id) AS nation_id FROM clients GROUP BY client_id
), sale AS (
  SELECT coalesce(nation_id, -1) AS nation, floor(epoch(sold_at))::BIGINT AS a, b, coalesce(floor(100 * total + 0.5), 0)::BIGINT AS cents
  FROM sales LEFT JOIN ends ON ends.sale_id = sales.sale_id LEFT JOIN nations ON nations.client_id = sales.client_id
  WHERE sold_at IS NOT NULL
), open AS (
  SELECT unnest([nation, -2]) AS nation, a, b, cents FROM sale WHERE b IS NULL OR b > a
), moment AS (
  SELECT nation, s, sum(n) AS n, sum(c) AS c
  FROM (SELECT nation, a AS s, 1 AS n, cents AS c FROM open UNION ALL SELECT nation, b, -1, -cents FROM open WHERE b IS NOT NULL)
  GROUP BY nation, s HAVING sum(n) <> 0 OR sum(c) <> 0
), running AS (
  SELECT nation, s, lead(s) OVER w AS t, sum(n) OVER w AS n, sum(c) OVER w AS c FROM moment WINDOW w AS (PARTITION BY nation ORDER BY s)
)
SELECT nation::INTEGER AS nation_id, s AS from_s, t AS to_s, n::BIGINT AS n_open, c::BIGINT AS open_cents,
       (max(n) OVER (PARTITION BY nation ORDER BY s))::BIGINT AS high_open, c = max(c) OVER (PARTITION BY nation) AS is_peak
FROM running
"""
