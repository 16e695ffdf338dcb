"""Near-duplicate vectors by iterative quantisation (ITQ) and multi-index Hamming tables.

1. Equal vectors collapse to classes (128 bits of hash), each with a member count. Vectors of different lengths are apart.
2. A rotation of the principal axes is learned on a bounded sample (``SAMPLE`` classes of smallest hash, ``SAMPLE_CELLS``
   components at most), so that the signs of the rotated coordinates are balanced binary codes. Every class is coded.
3. Hamming tables index the codes by different subsets of bits. Their width grows with the logarithm of the number of
   classes, so the size of a bucket doesn't grow with the input; their number grows with the width, until a share ``RECALL``
   of trial pairs at the least cosine (and of the sample's own links) have a bucket in common. Of the widths that do so the
   cheapest is taken; where none is cheaper than comparing all pairs, one table of width 0 compares all.
4. Ids and sketches alone are dealt to the tables, ``GROUP`` tables at a time, so that the rows in flight are that many times the
   vectors, however many tables there are. A sketch has ``SKETCH`` bits of other rotations: of codes of 64 bits that agree in a
   bucket's bits, many more are near by chance than are links. A row stays if some sketch in its bucket differs in no more bits
   than all but ``FAR`` of the trial pairs do, and didn't meet it in an earlier table of the group; the stayers of a group are
   written before the next one is dealt, and only they fetch their vectors.
5. Bucket mates are reranked with their original vectors in double precision. A bucket of more than ``CHUNK`` rows is split
   into chunks that meet pair by pair, so that no task holds more than two chunks. A pair counts in the first table that
   holds it. Buckets give counts per class and a spanning forest of their links, never their pairs.

Defined cases: vectors that are null, empty, zero, or hold null or non-finite components link with nothing and are kept;
equal vectors link with each other, scaled ones through their codes; repeated rows count as other vectors; a cosine of
exactly the least one links; a null vec_id links, but names no component (its own is null if nothing with an id is linked,
and it isn't kept but then); very long vectors are rotated in batches; an empty table gives an empty table; extra columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence
from functools import reduce
from operator import add

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import checkpointed, group_starts, scratch, table, whole_groups, written
from .components import components

SAMPLE, SAMPLE_CELLS, RECALL, FAR, BITS, ROUNDS = 20_000, 8_000_000, 0.95, 0.001, 64, 40
#: Bits that mates are compared by; rows of a bucket that go to a task together, and that meet at once there.
SKETCH, CHUNK, BLOCK = 192, 8192, 1024
#: Trial pairs of each kind; the cost of an indexed row in comparisons of two sketches.
TRIALS, ROW_COST = 4000, 300
#: Tables that are dealt out at once.
GROUP = 8


def learn(x: np.ndarray, bits: int, rounds: int = ROUNDS, seed: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """(mean, projection) whose signs are the code: principal axes, rotated towards the corners of the cube.

    Vectors of fewer than ``bits`` components get the rest of their bits from random rotations of the axes.
    """
    mean = x.mean(axis=0)
    _, axes = np.linalg.eigh(np.cov((x - mean).T).reshape(x.shape[1], x.shape[1]) if len(x) > 1 else np.eye(x.shape[1]))
    axes = axes[:, ::-1][:, :bits]
    flat, rng = (x - mean) @ axes, np.random.default_rng(seed)
    random = lambda: np.linalg.qr(rng.normal(size=(axes.shape[1],) * 2))[0]
    rotation = random()
    for _ in range(rounds):
        u, _, vt = np.linalg.svd(np.where(flat @ rotation >= 0, 1.0, -1.0).T @ flat)
        rotation = (u @ vt).T
    more = [random() for _ in range(1, math.ceil(bits / axes.shape[1]))]
    return mean, (axes @ np.hstack([rotation, *more]))[:, :bits]


def encode(unit: np.ndarray, mean: np.ndarray, projection: np.ndarray) -> np.ndarray:
    return ((unit - mean) @ projection >= 0) @ (np.uint64(1) << np.arange(projection.shape[1], dtype=np.uint64))


def masks(bits: int, width: int, seed: int = 9) -> Iterator[int]:
    """Bit subsets of the tables without end: all bits are dealt out before any is used again."""
    rng, deck = np.random.default_rng(seed), []
    while True:
        chosen: list[int] = []
        while len(chosen) < width:
            if not deck:
                deck = rng.permutation(bits).tolist()
            b = next((b for b in deck if b not in chosen), None)
            if b is None:
                deck = rng.permutation(bits).tolist()
                continue
            deck.remove(b)
            chosen.append(b)
        yield sum(1 << b for b in chosen)


def trials(unit: np.ndarray, mean: np.ndarray, projection: np.ndarray, least: float, seed: int = 7, n: int = TRIALS) -> list[np.ndarray]:
    """Differing bits of pairs at cosine ``least``: sampled vectors turned any way, and turned towards another sampled vector;
    and of pairs of sampled vectors that link, if there are 50."""
    rng = np.random.default_rng(seed)
    u = unit[rng.integers(len(unit), size=n)]
    codes, out = encode(u, mean, projection), []
    for aim in (rng.normal(size=u.shape), unit[rng.integers(len(unit), size=n)]):
        side = aim - (aim * u).sum(axis=1, keepdims=True) * u
        size = np.linalg.norm(side, axis=1)
        turned = least * u + math.sqrt(max(1 - least * least, 0)) * side / np.maximum(size, 1e-12)[:, None]
        real = size > 1e-6
        out.append((codes ^ encode(turned, mean, projection))[real])
    some = unit[rng.permutation(len(unit))[:2048]]
    i, j = np.nonzero(np.triu(some @ some.T >= least, 1))
    if len(i) >= 50:
        picked = rng.permutation(len(i))[:n]
        own = encode(some, mean, projection)
        out.append(own[i[picked]] ^ own[j[picked]])
    return [x for x in out if len(x)]


def choose_tables(unit: np.ndarray, mean: np.ndarray, projection: np.ndarray, n: int, least: float, recall: float = RECALL) -> list[int]:
    """Masks of the cheapest tables for ``n`` vectors like the sample ``unit`` that hold ``recall`` of each kind of trial pairs."""
    bits, pairs = projection.shape[1], trials(unit, mean, projection, least)
    some = encode(unit[:4096], mean, projection)
    best, lowest = [0], float(ROW_COST + n)
    for width in range(min(bits, math.ceil(math.log2(n))), 0, -1):
        open_, chosen, cost = pairs, [], 0.0
        for mask in masks(bits, width):
            m = np.uint64(mask)
            size = np.unique(some & m, return_counts=True)[1].astype(float)
            mates = n * max((size * (size - 1)).sum() / max(len(some) * (len(some) - 1), 1), 2.0**-width)
            chosen.append(mask)
            cost += ROW_COST + mates
            if cost >= lowest:
                break
            open_ = [x[(x & m) != 0] for x in open_]
            if all(len(x) <= (1 - recall) * len(all_) for x, all_ in zip(open_, pairs, strict=True)):
                best, lowest = chosen, cost
                break
    return best


def _new(near: np.ndarray, a: np.ndarray, b: np.ndarray, earlier: np.ndarray) -> None:
    """Takes out of ``near`` the pairs that a table of ``earlier`` holds; a has the codes of its rows, b of its columns."""
    if np.count_nonzero(near) < 10_000:
        i, j = np.nonzero(near)
        near[i, j] = (((a[i] ^ b[j])[:, None] & earlier) != 0).all(axis=1)
        return
    for mask in earlier:  # small numbers for the buckets: comparing them is many times faster than comparing codes
        bucket = np.unique(np.concatenate((a, b)) & mask, return_inverse=True)[1].astype(np.int16)
        near &= bucket[: len(a), None] != bucket[len(a) :]


def _links_in(rep: np.ndarray, members: np.ndarray, codes: np.ndarray, unit: np.ndarray, left: np.ndarray, right: np.ndarray, earlier: np.ndarray, least: float):
    """Counts for each row and spanning edges of one bucket, or of two chunks of one: rows marked left meet those marked right.

    Rows meet in blocks of ``BLOCK``, so the memory doesn't grow with the chunks; ``tree`` names each row's tree of the forest so far.
    """
    count, tree, edges = np.zeros(len(rep)), np.arange(len(rep)), []
    alone = (left & right).all()
    a = np.arange(len(rep)) if alone else np.concatenate((np.flatnonzero(left), np.flatnonzero(right)))
    members, codes, unit, half = members[a], codes[a], unit[a], len(a) if alone else np.count_nonzero(left)
    for p in range(0, half, BLOCK):
        for q in range(p if alone else half, len(a), BLOCK):
            rows, cols = slice(p, min(p + BLOCK, half)), slice(q, min(q + BLOCK, len(a)))
            near = unit[rows] @ unit[cols].T >= least
            if p == q:
                near = np.triu(near, 1)  # each pair once
            if not near.any():
                continue
            _new(near, codes[rows], codes[cols], earlier)
            count[rows] += near @ members[cols]
            count[cols] += members[rows] @ near
            for x in np.flatnonzero(near.any(axis=1)).tolist():
                while (other := near[x] & (tree[cols] != tree[p + x])).any():
                    y = q + int(other.argmax())
                    edges.append((a[p + x], a[y]))
                    tree[tree == tree[y]] = tree[p + x]
    back = np.zeros(len(rep))
    back[a] = count
    return back, edges


def _linked_twos(begin: np.ndarray, tables: np.ndarray, codes: np.ndarray, unit: np.ndarray, earlier: np.ndarray, least: float) -> tuple[np.ndarray, np.ndarray]:
    """The links of buckets of two rows, which most are, all at once: rows ``begin`` and the next ones."""
    near = np.einsum("ij,ij->i", unit[begin], unit[begin + 1]) >= least
    begin, tables = begin[near], tables[near]
    differ, new = codes[begin] ^ codes[begin + 1], np.ones(len(begin), bool)
    for t, mask in enumerate(earlier):
        new &= (tables <= t) | ((differ & mask) != 0)
    return begin[new], begin[new] + 1


def link_buckets(rows: DataFrame, mask_list: list[int], least: float) -> DataFrame:
    """Bucket rows, grouped and sorted by (table, bucket, i, j) -> ``(a, b, n)``: edges have n = 0, counts have b = a."""

    keys, earlier = ["t", "bucket", "i", "j"], np.array(mask_list, np.uint64)

    def work(part: pd.DataFrame) -> pd.DataFrame:
        rep, members = part["rep"].to_numpy(), part["members"].to_numpy().astype(float)
        codes, chunk = part["code"].to_numpy().view(np.uint64), part["chunk"].to_numpy()
        vectors = np.concatenate(part["embedding"].to_numpy()).astype(np.float64).reshape(len(part), -1)
        unit = vectors / np.linalg.norm(vectors, axis=1, keepdims=True)
        of_group = part[keys].to_numpy()
        bounds = np.array(group_starts(part, keys))
        begin, size = bounds[:, 0], bounds[:, 1] - bounds[:, 0]
        two = (size == 2) & (of_group[begin, 2] == of_group[begin, 3])
        x, y = _linked_twos(begin[two], of_group[begin[two], 0], codes, unit, earlier, least)
        found_a, found_b, found_n = [rep[x], rep[y], rep[x]], [rep[x], rep[y], rep[y]], [members[y].astype(np.int64), members[x].astype(np.int64), np.zeros(len(x), np.int64)]
        for s, e in bounds[(size > 1) & ~two].tolist():
            t, _, i, j = of_group[s].tolist()
            count, edges = _links_in(rep[s:e], members[s:e], codes[s:e], unit[s:e], chunk[s:e] == i, chunk[s:e] == j, earlier[:t], least)
            of = np.flatnonzero(count)
            found_a += [rep[s:e][of], np.array([rep[s + x] for x, _ in edges], np.int64)]
            found_b += [rep[s:e][of], np.array([rep[s + y] for _, y in edges], np.int64)]
            found_n += [count[of].astype(np.int64), np.zeros(len(edges), np.int64)]
        cat = lambda x: np.concatenate(x) if x else np.zeros(0, np.int64)
        return pd.DataFrame({"a": cat(found_a), "b": cat(found_b), "n": cat(found_n)})

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in whole_groups(batches, keys):
            yield work(part)

    return rows.mapInPandas(run, "a long, b long, n long")


def near_duplicates(vectors: DataFrame, least: float = 0.9, recall: float = RECALL, chunk: int = CHUNK, sample: int = SAMPLE) -> DataFrame:
    """``(vec_id, n_links, component_id, kept)`` for every row of ``vectors(vec_id, embedding)``."""
    e = F.col("embedding")
    number = lambda x: x.cast("double")
    usable = F.size(e) > 0
    finite = F.forall(e, lambda x: x.isNotNull() & ~F.isnan(number(x)) & (F.abs(number(x)) < float("inf"))) & F.exists(e, lambda x: number(x) != 0)
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.when(usable & finite, e).alias("embedding"))
    marked = rows.select("vec_id", "embedding", *[F.when(F.col("embedding").isNotNull(), h).alias(n) for n, h in (("h1", F.xxhash64("embedding")), ("h2", F.xxhash64(F.lit(3), "embedding")))])
    classes = marked.where("embedding is not null").groupBy("h1", "h2").agg(F.min("vec_id").alias("first"), F.count("*").alias("members"), F.first("embedding").alias("embedding"))
    classes = checkpointed(classes.select("*", F.size("embedding").alias("dims"), F.monotonically_increasing_id().alias("rep")))
    found = []
    with scratch(vectors.sparkSession):
        for dims, n in sorted((r["dims"], r["count"]) for r in classes.groupBy("dims").count().where("count > 1").collect()):  # a row per length
            alike = classes.where(F.col("dims") == dims)
            x = _sample(alike, dims, n, min(sample, max(SAMPLE_CELLS // dims, 1000)))
            mean, projection = learn(x, BITS)
            sketching = learn(x, SKETCH, rounds=0, seed=6)[1]
            tables = choose_tables(x, mean, projection, n, least, recall)
            within = SKETCH if tables == [0] else farthest(x, mean, sketching, least)  # comparing all pairs, compare all
            found.append(_link(alike, mean, np.hstack((projection, sketching)), tables, within, least, chunk))
        linked = checkpointed(reduce(DataFrame.unionByName, found)) if found else None
    about = classes.select("h1", "h2", "rep", "first", "members")
    if linked is not None:
        counts = linked.where("n > 0").groupBy(F.col("a").alias("rep")).agg(F.sum("n").alias("_linked"))
        groups = components(linked.where("n = 0").select("a", "b"))
        about = checkpointed(about.join(counts, "rep", "left").join(groups, about.rep == groups.node, "left").withColumn("_group", F.coalesce("component", "rep")))
        named = checkpointed(about.groupBy("_group").agg(F.min("first").alias("_c")))
        about = about.join(named, "_group")
    else:
        about = about.withColumns({"_linked": F.lit(0).cast("long"), "_c": F.col("first")})
    about = checkpointed(about.select("h1", "h2", (F.col("members") - 1 + F.coalesce("_linked", F.lit(0))).alias("_n"), "_c"))
    ids = marked.select("vec_id", "h1", "h2")
    out = ids.join(about, ["h1", "h2"], "left").select("vec_id", F.coalesce("_n", F.lit(0)).cast("long").alias("n_links"), F.coalesce("_c", "vec_id").alias("component_id"))
    return out.withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))


def _sample(classes: DataFrame, dims: int, n: int, rows: int) -> np.ndarray:
    """Unit vectors of the classes of smallest hash: ``rows`` of the ``n`` at most, through Arrow."""
    some = classes.where(F.col("h1") < int(2**64 * 2 * rows / n) - 2**63) if 4 * rows < n else classes  # about twice as many, so that few are sorted
    chosen = some.orderBy("h1", "h2").select("embedding").limit(rows).toArrow().column("embedding")
    x = np.concatenate([np.asarray(c.flatten()) for c in chosen.chunks]).astype(np.float64).reshape(-1, dims)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def words(projection: np.ndarray) -> list[np.ndarray]:
    """The columns in parts whose code has 64 bits at most."""
    return [projection[:, k : k + 64] for k in range(0, projection.shape[1], 64)]


def farthest(unit: np.ndarray, mean: np.ndarray, projection: np.ndarray, least: float, far: float = FAR) -> int:
    """The number of bits in which all but ``far`` of each kind of trial pairs differ at most."""
    kinds = zip(*[trials(unit, mean, part, least) for part in words(projection)], strict=True)
    return max((int(np.quantile(sum(np.bitwise_count(x).astype(int) for x in kind), 1 - far, method="higher")) for kind in kinds), default=projection.shape[1])


def _link(classes: DataFrame, mean: np.ndarray, projection: np.ndarray, mask_list: list[int], within: int, least: float, chunk: int) -> DataFrame:
    shared = classes.sparkSession.sparkContext.broadcast((mean, projection))
    names = ["code", *[f"s{k}" for k in range(len(words(projection)) - 1)]]

    @F.pandas_udf(", ".join(f"{name} long" for name in names))
    def coding(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        centre, axes = shared.value
        for part in batches:
            if part.empty:
                yield pd.DataFrame({name: np.zeros(0, np.int64) for name in names})
                continue
            x = np.stack(part.to_numpy()).astype(np.float64)
            unit = x / np.linalg.norm(x, axis=1, keepdims=True)
            yield pd.DataFrame({name: encode(unit, centre, own).view(np.int64) for name, own in zip(names, words(axes), strict=True)})

    coded = checkpointed(classes.select("rep", coding("embedding").alias("_c")).select("rep", "_c.*"))
    alive = reduce(DataFrame.unionByName, _with_mates(coded, mask_list, within, by=names[1:], once=True))
    sizes = checkpointed(alive.groupBy("t", "bucket").agg(F.ceil(F.count("*") / chunk).alias("k")))
    split = alive.join(sizes, ["t", "bucket"]).withColumn("chunk", F.pmod(F.xxhash64("rep"), "k"))
    pairs = F.transform(F.sequence(F.lit(0).cast("long"), F.col("k") - 1), lambda o: F.struct(F.least(F.col("chunk"), o).alias("i"), F.greatest(F.col("chunk"), o).alias("j")))
    tasks = split.select("rep", "t", "bucket", "chunk", F.explode(pairs).alias("_p")).select("rep", "t", "bucket", "chunk", "_p.i", "_p.j")
    whole = tasks.join(coded.select("rep", "code"), "rep").join(classes.select("rep", "members", "embedding"), "rep")
    grouped = whole.repartition("t", "bucket", "i", "j").sortWithinPartitions("t", "bucket", "i", "j", "rep")
    return link_buckets(grouped, mask_list, least)


def _with_mates(coded: DataFrame, mask_list: list[int], within: int, group: int = GROUP, by: Sequence[str] = ("code",), once: bool = False) -> Iterator[DataFrame]:
    """``(rep, t, bucket)`` for the places of ``coded(rep, code, ...)`` that have a mate within ``within`` bits of the columns ``by``, for a group of tables each.

    ``once``: mates that met in an earlier table of the group don't count.
    """
    jvm = coded.sparkSession._jvm
    for first in range(0, len(mask_list), group):
        jvm.System.gc()  # Spark removes the shuffle files of plans that nothing refers to
        signed = [m - (1 << 64) if m >> 63 else m for m in mask_list[first : first + group]]
        every = F.array(*[F.lit(m).cast("long") for m in signed])
        bucket = lambda x: F.col(f"{x}code").bitwiseAND(F.element_at(every, F.col(f"{x}t") + 1))  # noqa: E731, B023
        placed = coded.select(*dict.fromkeys(["rep", "code", *by]), F.explode(F.sequence(F.lit(0), F.lit(len(signed) - 1))).alias("t"))
        a, b = placed.alias("a"), placed.alias("b")
        differ = [F.bit_count(F.col(f"a.{c}").bitwiseXOR(F.col(f"b.{c}"))) for c in by]
        near = (reduce(add, differ[:2]) <= within) & (reduce(add, differ) <= within)  # the first two settle most
        for t, m in enumerate(signed[:-1] if once else []):
            near &= (F.col("a.t") <= t) | (F.col("a.code").bitwiseXOR(F.col("b.code")).bitwiseAND(F.lit(m).cast("long")) != 0)
        same = F.xxhash64("a.t", bucket("a.")) == F.xxhash64("b.t", bucket("b."))  # one long sorts by radix; equal hashes of two buckets do no harm
        alive = a.join(b, same & (F.col("a.rep") != F.col("b.rep")) & near, "left_semi")
        yield written(alive.select("rep", (F.col("t") + first).cast("long").alias("t"), bucket("").alias("bucket")))  # columns of its own: Spark can't plan a union of checkpoints of one table


def op6_itq(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "embeddings").select("vec_id", "embedding"))


#: All pairs, so for small tables only.
OP6_SQL = """
WITH RECURSIVE v AS (
  SELECT vec_id, embedding::DOUBLE[] AS e, list_dot_product(embedding::DOUBLE[], embedding::DOUBLE[]) AS q FROM embeddings
), usable AS (
  SELECT vec_id, e, sqrt(q) AS size FROM v WHERE q > 0 AND isfinite(q) AND len(list_filter(e, lambda x: x IS NULL)) = 0
), link AS (
  SELECT a.vec_id AS a, b.vec_id AS b FROM usable a JOIN usable b ON a.vec_id <> b.vec_id AND len(a.e) = len(b.e)
  WHERE list_dot_product(a.e, b.e) / (a.size * b.size) >= 0.9
), reach(a, b) AS (
  SELECT a, b FROM link UNION SELECT r.a, l.b FROM reach r JOIN link l ON r.b = l.a
), counts AS (
  SELECT a, count(*) AS n FROM link GROUP BY a
), least_ids AS (
  SELECT a, least(a, min(b)) AS c FROM reach GROUP BY a
)
SELECT vec_id, coalesce(n, 0)::BIGINT AS n_links, coalesce(c, vec_id) AS component_id, coalesce(c, vec_id) = vec_id AS kept
FROM embeddings LEFT JOIN counts ON counts.a = vec_id LEFT JOIN least_ids ON least_ids.a = vec_id
"""
