"""URL filtering by rules and by link-graph propagation, in DataFrame operations only.

Rules judge a url by host suffix and path prefix. Where no rule fits, its host decides: trust flows from hosts with
allowed pages along links (personalised PageRank), distrust from hosts with blocked pages against them (a page that links
to bad hosts is suspect). A seed is a host's share of allowed or of blocked pages. Each vector solves
``x = (1 - damping) * seed + damping * P x``; scaled to a sum of 1 it is the PageRank whose jumps, those of hosts without
links included, go to the seeds. A host is blocked when distrust is ``threshold`` or more of its distrust and trust together,
and at least ``least`` of what an unlinked host with blocked pages alone has, so that dust from afar decides nothing.

The state is a row per host. A host with a third of all links is one skewed join key, and what it receives is summed
before the shuffle. Links of a host to itself, relative ones included, carry nothing.

Defined cases: a null url, or one without ``://``, has an empty host and path, fits no rule and is allowed; null html has no
links; repeated rows are pages of their own; equal trust and distrust (a tie at a threshold of one half) block; very long
urls and pages are matched whole; extra columns pass through; an empty table gives an empty table.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import ascii_lower, checkpointed, table

#: (rule, verdict): host, then path.
RULES = (("net/", "block"), ("example.net/en/", "allow"), ("example.com/de/", "block"), ("org/fr/", "allow"))
LINK = r"""(?i)\bhref\s*=\s*["']?(?:[a-z][a-z0-9+.-]*:)?//([^/?#"'\s<>]+)"""


def host_and_path(url: Column) -> tuple[Column, Column]:
    at = F.coalesce(F.instr(url, "://"), F.lit(0))
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise(F.lit(""))
    return ascii_lower(F.regexp_extract(rest, r"^([^/?#]*)", 1)), F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)


def matching_rule(host: Column, path: Column, rules=RULES) -> Column:
    """The longest rule that fits as a struct of rule and verdict, or null. ``rules`` is a short list held in the plan."""
    chain = None
    for rule, verdict in sorted(rules, key=lambda r: -len(r[0])):
        name, _, rest = rule.partition("/")
        fits = ((host == name) | host.endswith("." + name)) & path.startswith("/" + rest)
        found = F.struct(F.lit(rule).alias("rule"), F.lit(verdict).alias("verdict"))
        chain = F.when(fits, found) if chain is None else chain.when(fits, found)
    return chain if chain is not None else F.lit(None).cast("struct<rule:string,verdict:string>")


def host_edges(pages: DataFrame) -> DataFrame:
    """``pages(host, html)`` -> ``(src, dst, n)``: links between different hosts."""
    links = pages.where("host <> '' and html is not null").select(F.col("host").alias("src"), F.explode(F.regexp_extract_all("html", F.lit(LINK), 1)).alias("dst"))
    return links.select("src", ascii_lower(F.col("dst")).alias("dst")).where("src <> dst").groupBy("src", "dst").agg(F.count("*").alias("n"))


def propagate(seeds: DataFrame, edges: DataFrame, damping: float = 0.85, rounds: int = 300, settled: float = 1e-4, merge: int = 8) -> DataFrame:
    """``seeds(host, trust, distrust)`` -> the same columns after propagation over ``edges(src, dst, n)``.

    Adds what each round carries on, ``damping`` times less in all than the round before, until it can't add ``settled`` to any
    host any more; raises if ``rounds`` don't suffice. Sums are merged every ``merge`` rounds. P spreads trust over the links out of a host, distrust over the links
    into it. An unlinked host ends with ``1 - damping`` of its seed.
    """
    out = edges.groupBy("src").agg(F.sum("n").alias("_out"))
    into = edges.groupBy("dst").agg(F.sum("n").alias("_in"))
    shares = checkpointed(edges.join(out, "src").join(into, "dst").select("src", "dst", (F.col("n") / F.col("_out")).alias("forth"), (F.col("n") / F.col("_in")).alias("back")))
    own = lambda c: ((1 - damping) * F.coalesce(c, F.lit(0.0))).alias(c)
    total = checkpointed(seeds.select("host", own("trust"), own("distrust")))
    if shares.isEmpty():
        return total
    carried, open_, zero = total, [total], F.lit(0.0)
    both = [F.sum(c).alias(c) for c in ("trust", "distrust")]
    for _ in range(rounds):
        forth = shares.join(carried, shares.src == carried.host).select(F.col("dst").alias("host"), (damping * F.col("forth") * F.col("trust")).alias("trust"), zero.alias("distrust"))
        back = shares.join(carried, shares.dst == carried.host).select(F.col("src").alias("host"), zero.alias("trust"), (damping * F.col("back") * F.col("distrust")).alias("distrust"))
        carried = checkpointed(forth.unionByName(back).groupBy("host").agg(*both).where("trust > 0 or distrust > 0"))
        open_.append(carried)
        # all later rounds together carry at most damping / (1 - damping) times this one
        left = carried.agg(F.greatest(F.sum("trust"), F.sum("distrust"))).first()[0]
        done = left is None or left * damping / (1 - damping) < settled
        if done or len(open_) > merge:
            open_ = [checkpointed(reduce(DataFrame.unionByName, open_).groupBy("host").agg(*both))]
        if done:
            return open_[0]
    raise RuntimeError(f"propagation did not settle in {rounds} rounds")


def distrusted(threshold: float, least: float, damping: float) -> Column:
    """Whether a host with ``trust`` and ``distrust`` as ``propagate`` gives them is blocked."""
    return (F.col("distrust") >= least * (1 - damping)) & (F.col("distrust") >= threshold * (F.col("trust") + F.col("distrust")) - 1e-9)


def judge_urls(pages: DataFrame, rules=RULES, threshold: float = 0.5, least: float = 0.05, damping: float = 0.85, **options) -> DataFrame:
    """``pages`` with host, path, rule, verdict and the host's PageRanks; columns of these names are replaced."""
    host, path = host_and_path(F.col("url"))
    # own columns travel under numbered names: they can't clash, and those that nobody asks for are pruned from the scan
    own = {c: f"_c{k}" for k, c in enumerate(pages.columns) if c not in ("host", "path", "rule", "verdict", "host_trust", "host_distrust")}
    judged = pages.select(*[F.col(f"`{c}`").alias(n) for c, n in own.items()], host.alias("host"), path.alias("path"))
    judged = judged.withColumn("_rule", matching_rule(F.col("host"), F.col("path"), rules))
    share = lambda v: F.sum((F.col("_rule.verdict").eqNullSafe(v)).cast("double")) / F.count("*")
    seeds = judged.where("host <> ''").groupBy("host").agg(share("allow").alias("trust"), share("block").alias("distrust"))
    scores = propagate(seeds, host_edges(judged.select("host", F.col(own["html"]).alias("html"))), damping, **options)
    sums = scores.agg(F.sum("trust").alias("_t"), F.sum("distrust").alias("_d")).first()  # one row
    rank = lambda c, all_: (F.col(c) / all_ if all_ else F.lit(0.0)).alias(f"host_{c}")
    ranked = scores.select("host", distrusted(threshold, least, damping).alias("_blocked"), rank("trust", sums["_t"]), rank("distrust", sums["_d"]))
    verdict = F.coalesce(F.col("_rule.verdict"), F.when(F.col("_blocked"), "block").otherwise("allow"))
    return judged.join(ranked, "host", "left").select(*[F.col(n).alias(c) for c, n in own.items()], "host", "path", F.col("_rule.rule").alias("rule"), verdict.alias("verdict"), "host_trust", "host_distrust")


def op5_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", "url", "html")
    return judge_urls(pages).select("page_id", "host", "path", "rule", "verdict")


OP5_SQL = r"""
WITH RECURSIVE parts AS (
  SELECT page_id, html, CASE WHEN contains(url, '://') THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages
), named AS (
  SELECT page_id, html, translate(regexp_extract(rest, '^([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path
  FROM parts
), ruled AS (
  SELECT *, CASE WHEN (host = 'example.net' OR ends_with(host, '.example.net')) AND starts_with(path, '/en/') THEN 'example.net/en/'
                 WHEN (host = 'example.com' OR ends_with(host, '.example.com')) AND starts_with(path, '/de/') THEN 'example.com/de/'
                 WHEN (host = 'org' OR ends_with(host, '.org')) AND starts_with(path, '/fr/') THEN 'org/fr/'
                 WHEN (host = 'net' OR ends_with(host, '.net')) AND starts_with(path, '/') THEN 'net/' END AS rule
  FROM named
), judged AS (
  SELECT *, CASE WHEN rule IN ('net/', 'example.com/de/') THEN 'block' WHEN rule IS NOT NULL THEN 'allow' END AS ruling FROM ruled
), seeds AS (
  SELECT host, 0.15::DOUBLE * avg((ruling IS NOT DISTINCT FROM 'allow')::INT) AS trust, 0.15::DOUBLE * avg((ruling IS NOT DISTINCT FROM 'block')::INT) AS distrust
  FROM judged WHERE host <> '' GROUP BY host
), links AS (
  SELECT host AS src, translate(unnest(regexp_extract_all(html, '(?i)\bhref\s*=\s*["'']?(?:[a-z][a-z0-9+.-]*:)?//([^/?#"''\s<>]+)', 1)),
                                'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS dst
  FROM judged WHERE host <> ''
), edges AS (
  SELECT src, dst, count(*) AS n FROM links WHERE src <> dst GROUP BY src, dst
), shares AS (
  SELECT src, dst, n / sum(n) OVER (PARTITION BY src) AS forth, n / sum(n) OVER (PARTITION BY dst) AS back FROM edges
), steps AS (
  SELECT src, dst, forth, 0.0::DOUBLE AS back FROM shares UNION ALL SELECT dst, src, 0.0, back FROM shares
), carried(k, host, trust, distrust) AS (
  SELECT 0, host, trust, distrust FROM seeds
  UNION ALL
  SELECT k + 1, dst, sum(0.85::DOUBLE * forth * trust), sum(0.85::DOUBLE * back * distrust)
  FROM carried JOIN steps ON host = src WHERE k < 300 GROUP BY k, dst HAVING sum(forth * trust) > 0 OR sum(back * distrust) > 0
), scores AS (
  SELECT host, sum(trust) AS trust, sum(distrust) AS distrust FROM carried GROUP BY host
)
SELECT page_id, host, path, rule, coalesce(ruling, CASE WHEN distrust >= 0.05::DOUBLE * 0.15 AND distrust >= 0.5::DOUBLE * (trust + distrust) - 1e-9 THEN 'block' ELSE 'allow' END) AS verdict
FROM judged LEFT JOIN scores USING (host)
"""
