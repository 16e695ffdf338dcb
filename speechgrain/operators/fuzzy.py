"""Pairs of texts that are alike by matching blocks of letters, from an inverted index that loses none.

The ratio is twice the letters in matching blocks, M, by all letters of both texts, T. Between two blocks lies a letter outside of
them, so there are at most T - 2 M + 1 blocks; each has all but q - 1 of its letters as beginnings of q-grams that both texts have.
So a pair at ``ratio`` or above has at least

    ratio * T / 2 - (q - 1) * (T - ratio * T + 1)

q-grams in common, numbered within each text (q = 1: letters). With q-grams sorted from rare to frequent, two texts that need o of them
meet in their first ``number - o + 1``, at places from which enough of both is left. Texts for which that is at least one
are indexed by pairs of letters, which are rare; a pair with a text too short for that (or a ratio of 2/3 or less) meets by letters.
What passes the index, and the same counts over the whole texts, is compared letter by letter in Arrow batches.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from speechgrain.functions.text import letter_bound, letter_ratio


def numbered(grams: Column) -> Column:
    """An array's elements, each with how often it has come up to there, so that sets of them count repeats."""
    return F.transform(grams, lambda x, i: F.concat(x, F.lit("#"), F.size(F.filter(F.slice(grams, 1, i + 1), lambda y: y == x)).cast("string")))


def grams(text: Column, q: int) -> Column:
    """The q-grams of a text, in order; none if it is shorter."""
    n = F.length(text)
    return F.when(n >= q, F.transform(F.sequence(F.lit(1), F.greatest(n - q + 1, F.lit(1))), lambda i: F.substr(text, i, F.lit(q)))).otherwise(F.array().cast("array<string>"))


def needed(total: Column, ratio: float, q: int) -> Column:
    """The least number of q-grams in common of two texts of ``total`` letters at ``ratio``."""
    return F.ceil(ratio * total / 2 - (q - 1) * (total - ratio * total + 1) - 1e-9)


def gram_filter(left: Column, right: Column, ratio: float, q: int) -> Column:
    """Both texts have as many q-grams in common as a pair at ``ratio`` must."""
    need = needed((F.length(left) + F.length(right)).cast("double"), ratio, q)
    both = F.size(F.array_intersect(numbered(grams(left, q)), numbered(grams(right, q))))
    return (need <= 0) | (both >= need)


def _prefixes(texts: DataFrame, ratio: float, q: int, by: str) -> DataFrame:
    """``(by, t, k, n, i, size)``: the rarest q-grams of ``texts(by, k, n)``, as many as a partner has to share one of; i counts from 0."""
    each = texts.select(by, "k", "n", F.explode(numbered(grams(F.col("k"), q))).alias("t"))
    often = each.groupBy("t").agg(F.count("*").alias("f"))
    ordered = each.join(often, "t").groupBy(by, "k", "n").agg(F.array_sort(F.collect_list(F.struct("f", "t"))).alias("_s"))
    shortest = F.ceil(F.col("n") * ratio / (2 - ratio) - 1e-9)
    size = F.size("_s")
    first = (size - F.greatest(needed(F.col("n") + shortest, ratio, q), F.lit(1)) + 1).cast("int")
    return ordered.select(by, "k", "n", size.alias("size"), F.posexplode(F.slice(F.col("_s.t"), F.lit(1), F.greatest(first, F.lit(0)))).alias("i", "t"))


def _met(a: DataFrame, b: DataFrame, ratio: float, q: int, by: str) -> DataFrame:
    """Pairs of different texts of two sets of prefixes that share one, with enough q-grams from there on."""
    side = lambda df, s: df.select(by, "t", *[F.col(c).alias(f"{c}_{s}") for c in ("k", "n", "size", "i")])
    c = F.col
    total = c("n_a") + c("n_b")
    need = needed(total, ratio, q)
    enough = (F.least("n_a", "n_b") >= F.ceil(ratio * total / 2 - 1e-9)) & (F.least("i_a", "i_b") + F.least(c("size_a") - c("i_a"), c("size_b") - c("i_b")) >= need)
    found = side(a, "a").join(side(b, "b"), [by, "t"]).where((c("k_a") != c("k_b")) & enough)
    return found.select(by, F.least("k_a", "k_b").alias("left_key"), F.greatest("k_a", "k_b").alias("right_key")).distinct()


def candidates(texts: DataFrame, ratio: float, by: str, q: int = 2) -> DataFrame:
    """``(by, left_key, right_key)``: pairs of distinct ``texts(by, k)`` of a group, left before right, that the index can't part."""
    sized = texts.where("k <> ''").select(by, "k", F.length("k").alias("n"))
    partner = F.col("n") + F.ceil(F.col("n") * ratio / (2 - ratio) - 1e-9)
    # below this ratio fewer q-grams are needed the longer the texts are
    rises = ratio / 2 > (q - 1) * (1 - ratio)
    long = needed(partner, ratio, q) >= 1 if rises else F.lit(False)
    by_letters = _prefixes(sized, ratio, 1, by)  # one order of letters for all, short and long
    found = _met(by_letters.where(~long), by_letters, ratio, 1, by)
    if rises:
        by_grams = _prefixes(sized.where(long), ratio, q, by)
        found = found.unionByName(_met(by_grams, by_grams, ratio, q, by))
    return found.distinct()


def alike_pairs(texts: DataFrame, ratio: float, by: str, q: int = 2) -> DataFrame:
    """``(by, left_key, right_key, ratio)``: all pairs of different texts ``k`` of a group whose ratio is ``ratio`` or more.

    The ratio is taken with the pair in order of the texts, as it isn't quite symmetrical. Nulls and empty texts pair with nothing.
    """
    if not 0 < ratio <= 1:
        raise ValueError("the ratio has to lie between 0 and 1")
    left, right = F.col("left_key"), F.col("right_key")
    may = candidates(texts.select(by, "k").where("k is not null").distinct(), ratio, by, q).where((letter_bound(left, right) >= ratio - 1e-9) & gram_filter(left, right, ratio, q))
    return may.withColumn("ratio", letter_ratio(left, right)).where(F.col("ratio") >= ratio)
