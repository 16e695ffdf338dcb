"""SimHash near-duplicates through pivot distance tables.

1. Fingerprints are made in Arrow batches (XXH64 of word shingles, bit majorities counted in NumPy).
2. Equal fingerprints collapse to one node; copies are never paired.
3. Every distinct fingerprint gets its row of the pivot table: Hamming distances to ``PIVOTS`` reference fingerprints.
   If two fingerprints differ in at most k bits, no coordinate of theirs differs by more than k.
4. A bare pivot table would have to compare all pairs of rows. The rows are therefore first joined by block: of four
   16-bit blocks, a pair within 2 bits has at least two in common, so six tables of block pairs miss no link. Joined
   pairs are discarded by the largest coordinate difference, and survivors verified, inside the join condition.
5. A block bucket with more than ``BUCKET`` distinct fingerprints (a dense group of near copies) isn't paired. Its
   fingerprints take an exact linear way: each emits itself and its 64 one-bit neighbours, and two fingerprints are within
   2 bits if and only if they have an emitted value in common. At most 65 fingerprints share a value.
6. Links become components by alternating stars.

``similar_groups`` also links texts by the similarity of their shingles; see there.

Defined cases: null, empty and blank texts have fingerprint zero and link like any other; fewer words than a shingle count
as one shingle; a bit that just half of the shingles set (a tie) is 0; a null ``doc_id`` links and gets its component but
never names it (a group of nulls alone has a null component); repeated rows each get their row; very long texts are hashed in
pieces of bounded size; an empty table gives an empty table; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce
from itertools import combinations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import checkpointed, group_starts, table, unused, whole_groups, written
from .components import components

WORDS, SEED, BITS = 3, 42, 2
PIVOTS, BUCKET = 16, 64
#: Near copies of texts: shingles of SIMILAR_WORDS words with a Jaccard similarity of LEAST or more. A pair at LEAST has one of
#: BANDS keys of BAND_ROWS least hashes in common with probability 1 - (1 - 0.8**6)**20 = 0.998, whatever the number of texts.
SIMILAR_WORDS, LEAST, BANDS, BAND_ROWS = 5, 0.8, 20, 6
#: Texts of a bucket that a task compares with as many others at once; shingles that a worker holds before it writes them.
CHUNK, HELD = 1024, 1 << 21
_LOWER = bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256))


def fingerprint(text: str | None, words: int = WORDS, seed: int = SEED) -> int:
    """The unsigned 64-bit fingerprint of a text."""
    found = _words(text)
    if not found:
        return 0
    if len(found) <= words:
        return int(next(_hashes(found, words, seed))[0])
    n, ones = len(found) - words + 1, np.zeros(64, np.int64)
    for hashes in _hashes(found, words, seed):
        ones += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > n, bitorder="little").view("<u8")[0])


def _words(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "surrogatepass").translate(_LOWER).split()


def _hashes(found: list[bytes], words: int, seed: int) -> Iterator[np.ndarray]:
    """Hashes of the shingles in order, a bounded piece of a very long text at a time."""
    import xxhash

    joined, digest = b" ".join(found), xxhash.xxh64_intdigest
    if len(found) <= words:
        yield np.array([digest(joined, seed)], dtype="<u8")
        return
    ends = np.cumsum(np.fromiter(map(len, found), np.int64, len(found)) + 1) - 1
    starts, n = np.concatenate(([0], ends[:-1] + 1)), len(found) - words + 1
    for k in range(0, n, 1 << 16):
        cut = zip(starts[k : min(k + (1 << 16), n)].tolist(), ends[k + words - 1 : min(k + (1 << 16), n) + words - 1].tolist(), strict=True)
        yield np.array([digest(joined[i:j], seed) for i, j in cut], dtype="<u8")


def fingerprints(docs: DataFrame, words: int = WORDS, seed: int = SEED) -> DataFrame:
    """``(doc_id, fp)`` for every row of ``docs``; fp is the fingerprint's bits as a signed long."""

    @F.pandas_udf("long")
    def make(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            yield pd.Series(np.array([fingerprint(t, words, seed) for t in texts], dtype=np.uint64).view(np.int64))

    return docs.select("doc_id", make("text").alias("fp"))


def hex16(fp: Column) -> Column:
    return F.lower(F.lpad(F.hex(fp), 16, "0"))


def pivots(n: int = PIVOTS, seed: int = SEED) -> list[int]:
    """Reference fingerprints as signed longs."""
    return [int(x) for x in np.random.default_rng(seed).integers(-(1 << 63), (1 << 63) - 1, n)]


def pivot_table(nodes: DataFrame, n: int = PIVOTS) -> DataFrame:
    """``nodes`` with columns ``_p0``, ``_p1``...: distances to the pivots, eight to a long, eight bits each."""
    far = [F.bit_count(F.col("fp").bitwiseXOR(F.lit(p))).cast("long") for p in pivots(n)]
    packed = [reduce(lambda x, y: x.bitwiseOR(y), [F.shiftleft(d, 8 * i) for i, d in enumerate(far[k : k + 8])]) for k in range(0, n, 8)]
    return nodes.select("*", *(c.alias(f"_p{k}") for k, c in enumerate(packed)))


def _close(bits: int, n: int = PIVOTS) -> Column:
    """No pivot coordinate of rows a and b differs by more than ``bits``."""
    lane = lambda side, k: F.shiftright(F.col(f"{side}._p{k // 8}"), 8 * (k % 8)).bitwiseAND(F.lit(255))
    return reduce(lambda x, y: x & y, [F.abs(lane("a", k) - lane("b", k)) <= bits for k in range(n)])


def links(nodes: DataFrame, bits: int = BITS, bucket: int = BUCKET) -> DataFrame:
    """``nodes(fp, node)`` of distinct fingerprints -> ``(a, b)``: edges whose components are those of all links.

    Pairs in buckets up to ``bucket`` come out as they are; larger buckets give stars over the values they share.
    """
    if bits != 2:
        raise ValueError("blocks and one-bit neighbours are laid out for 2 differing bits")
    block = lambda i: F.shiftrightunsigned("fp", 16 * i).bitwiseAND(F.lit(0xFFFF))
    keys = [F.lit(t << 32).bitwiseOR(F.shiftleft(block(i), 16)).bitwiseOR(block(j)) for t, (i, j) in enumerate(combinations(range(4), 2))]
    rows = nodes.select("fp", "node", F.explode(F.array(*keys)).alias("_key"))
    sizes = rows.groupBy("_key").agg(F.count("*").alias("_n")).where("_n > 1")
    shared = checkpointed(rows.join(written(sizes), "_key"))  # a written side, so that Spark may split the key of a dense group
    cold = pivot_table(shared.where(F.col("_n") <= bucket))
    within = F.bit_count(F.col("a.fp").bitwiseXOR(F.col("b.fp"))) <= bits
    pairs = cold.alias("a").join(cold.alias("b"), (F.col("a._key") == F.col("b._key")) & (F.col("a.fp") < F.col("b.fp")) & _close(bits) & within)
    pairs = pairs.select(F.col("a.node").alias("a"), F.col("b.node").alias("b"))
    hot = shared.where(F.col("_n") > bucket).select("fp", "node").distinct()
    values = F.concat(F.array("fp"), F.transform(F.sequence(F.lit(0), F.lit(63)), lambda i: F.col("fp").bitwiseXOR(F.call_function("shiftleft", F.lit(1).cast("long"), i))))
    stars = hot.select("node", F.explode(values).alias("_value")).groupBy("_value").agg(F.collect_list("node").alias("_nodes")).where(F.size("_nodes") > 1)
    stars = stars.select(F.array_min("_nodes").alias("b"), F.explode("_nodes").alias("a")).where("a <> b").select("a", "b")
    return pairs.unionByName(stars).distinct()


def near_duplicates(docs: DataFrame, words: int = WORDS, seed: int = SEED, bits: int = BITS, bucket: int = BUCKET) -> DataFrame:
    """``(doc_id, fp, component_id)`` for every row of ``docs(doc_id, text)``; the component is its smallest doc_id."""
    made = checkpointed(fingerprints(docs, words, seed))
    named = checkpointed(made.groupBy("fp").agg(F.min("doc_id").alias("first")).withColumn("node", F.monotonically_increasing_id()))
    groups = components(links(named.select("fp", "node"), bits, bucket))
    joined = checkpointed(named.join(groups, "node", "left").select("fp", "first", F.coalesce("component", "node").alias("c")))
    least = checkpointed(joined.groupBy("c").agg(F.min("first").alias("component_id")))
    # copies share a fingerprint: a join of written tables is one that Spark may split there
    labels = checkpointed(joined.join(least, "c").select("fp", "component_id"))
    return made.join(labels, "fp").select("doc_id", "fp", "component_id")


def shingle_set(text: str | None, words: int = SIMILAR_WORDS, seed: int = SEED) -> np.ndarray:
    """Sorted distinct shingle hashes of a text; none without words."""
    found = _words(text)
    return np.unique(np.concatenate(list(_hashes(found, words, seed)))) if found else np.zeros(0, "<u8")


def band_keys(shingles: np.ndarray, bands: int = BANDS, rows: int = BAND_ROWS) -> np.ndarray:
    """A key for each band: its least shingle hashes under ``rows`` permutations, mixed into a long."""
    rng = np.random.default_rng(SEED)
    factor, plus, mix = (rng.integers(1, 1 << 63, bands * rows, dtype=np.int64).astype(np.uint64) * np.uint64(2) + np.uint64(1) for _ in range(3))
    least = np.full(bands * rows, np.iinfo(np.uint64).max, np.uint64)
    for k in range(0, len(shingles), 4096):
        least = np.minimum(least, (shingles[k : k + 4096, None] * factor + plus).min(axis=0))
    return (((least ^ (least >> np.uint64(31))) * mix).reshape(bands, rows).sum(axis=1, dtype=np.uint64)).view(np.int64)


def _word_hash(text: str | None) -> int:
    import xxhash

    return xxhash.xxh3_64_intdigest(b" ".join(_words(text)))


def _by_text(docs: DataFrame, make: Callable[[str | None], tuple], kinds: dict[str, pa.DataType], size: int) -> DataFrame:
    """``(doc_id, *kinds)`` for ``docs(doc_id, text)``: a row of ``make(text)`` for each, written as soon as some ``size`` bytes
    or 1000 rows are held, so that a worker holds one Arrow batch of texts and little more."""
    schema = pa.schema([("doc_id", pa.int64()), *kinds.items()])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        frame = lambda rows: pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), schema.types, strict=True)], schema=schema)
        for batch in batches:
            rows, held = [], 0
            for doc_id, text in zip(batch.column(0), batch.column(1), strict=True):
                rows.append((doc_id.as_py(), *make(text.as_py())))
                held += sum(x.nbytes for x in rows[-1] if isinstance(x, np.ndarray))
                if len(rows) == 1000 or held > size:
                    yield frame(rows)
                    rows, held = [], 0
            if rows:
                yield frame(rows)

    names = {pa.int64(): "long", pa.int32(): "int", pa.list_(pa.int64()): "array<long>", pa.list_(pa.int32()): "array<int>"}
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, " + ", ".join(f"{c} {names[t]}" for c, t in kinds.items()))


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def prints(docs: DataFrame, words: int, seed: int) -> DataFrame:
    """``(doc_id, h, fp, bands)``: hash of the words, fingerprint and band keys of each text; texts without words have no bands."""

    def make(text: str | None) -> tuple:
        whole = shingle_set(text, words, seed)
        return _signed(_word_hash(text)), _signed(fingerprint(text)), band_keys(whole) if len(whole) else []

    return _by_text(docs, make, {"h": pa.int64(), "fp": pa.int64(), "bands": pa.list_(pa.int64())}, 4 * HELD)


def shingle_sets(docs: DataFrame, words: int, seed: int) -> DataFrame:
    """``(doc_id, h, m, shingles)``: the sorted shingle set of each text and its size.

    The set holds 32 bits of each hash: in a text of n shingles n**2 / 2**33 of them meet by chance, a share of 1e-5 in 100,000.
    """

    def make(text: str | None) -> tuple:
        found = np.unique(shingle_set(text, words, seed).astype("<u4")).view(np.int32)
        return _signed(_word_hash(text)), len(found), found

    return _by_text(docs, make, {"h": pa.int64(), "m": pa.int64(), "shingles": pa.list_(pa.int32())}, 4 * HELD)


def _verified(pairs: DataFrame, sets: DataFrame, least: float) -> DataFrame:
    """The pairs ``(a, b)`` whose shingle sets have a Jaccard similarity of ``least`` or more."""

    both, all_ = F.size(F.array_intersect("x", "y")), F.size("x") + F.size("y")
    joined = pairs.join(sets.select(F.col("h").alias("a"), F.col("shingles").alias("x")), "a").join(sets.select(F.col("h").alias("b"), F.col("shingles").alias("y")), "b")
    return checkpointed(joined.where(both >= least * (all_ - both)).select("a", "b"))


def common_counts(sets: list[np.ndarray], left: np.ndarray, right: np.ndarray, width: int = 4096) -> np.ndarray:
    """Elements in common of each set at ``left`` and each at ``right``, by products of 0/1 matrices of ``width`` elements."""
    flat, of = np.concatenate(sets), np.repeat(np.arange(len(sets)), [len(x) for x in sets])
    _, at, times = np.unique(flat, return_inverse=True, return_counts=True)
    shared = times[at] > 1  # elements of one set alone count nowhere
    order = np.argsort(at[shared], kind="stable")
    of, place = of[shared][order], (np.cumsum(times > 1) - 1)[at[shared][order]]
    out = np.zeros((len(left), len(right)), np.float32)
    for low in range(0, int(np.count_nonzero(times > 1)), width):
        begin, end = np.searchsorted(place, (low, low + width))
        held = np.zeros((len(sets), width), np.float32)
        held[of[begin:end], place[begin:end] - low] = 1
        out += held[left] @ held[right].T
    return out


def _linked_in(h: np.ndarray, group: np.ndarray, sets: list[np.ndarray], left: np.ndarray, right: np.ndarray, least: float) -> list[tuple[int, int]]:
    """Links between rows at ``left`` and at ``right`` that join different groups: a spanning forest, not all of them."""
    sizes = np.array([len(x) for x in sets], np.float64)
    both = common_counts(sets, left, right)
    i, j = np.nonzero((both >= least * (sizes[left][:, None] + sizes[right][None, :] - both)) & (group[left][:, None] != group[right][None, :]))
    i, j = left[i], right[j]
    names, number = np.unique(group, return_inverse=True)
    _, one = np.unique(np.minimum(number[i], number[j]) * len(names) + np.maximum(number[i], number[j]), return_index=True)
    parent, out = list(range(len(names))), []

    def find(x: int) -> int:
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for k in one.tolist():
        p, q = find(int(number[i[k]])), find(int(number[j[k]]))
        if p != q:
            parent[p] = q
            out.append((int(h[i[k]]), int(h[j[k]])))
    return out


def _linked_in_buckets(open_: DataFrame, sets: DataFrame, least: float, chunk: int) -> DataFrame:
    """``(a, b)``: links between different groups of a bucket, for ``open_(bucket, h, m, c, low)`` of groups ``c``, m shingles in a text.

    Rows of the group ``low`` and the others are dealt into chunks of about ``chunk`` rows and ``HELD`` shingles; the others'
    chunks meet all, those of ``low`` the others' only. A task holds two chunks, computes their similarities in matrices and
    emits a spanning forest.
    """
    inside = F.col("c") == F.col("low")
    number = lambda x: F.ceil(F.greatest(F.sum(x.cast("int")) / chunk, F.sum(F.when(x, F.col("m"))) / HELD))
    sizes = open_.groupBy("bucket").agg(number(~inside).alias("k_out"), number(inside).alias("k_in"))
    dealt = open_.join(sizes, "bucket").withColumn("chunk", F.when(inside, F.col("k_out") + F.pmod(F.xxhash64("h"), "k_in")).otherwise(F.pmod(F.xxhash64("h"), "k_out")))
    partners = F.sequence(F.lit(0).cast("long"), F.when(inside, F.col("k_out")).otherwise(F.col("k_out") + F.col("k_in")) - 1)
    pairs = F.transform(partners, lambda p: F.struct(F.least("chunk", p).alias("i"), F.greatest("chunk", p).alias("j")))
    tasks = dealt.select("bucket", "h", "c", "chunk", F.explode(pairs).alias("_p")).select("bucket", "h", "c", "chunk", "_p.i", "_p.j")
    keys = ["bucket", "i", "j"]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in whole_groups(batches, keys):
            h, group, chunks, found = part["h"].to_numpy(), part["c"].to_numpy(), part["chunk"].to_numpy(), []
            for s, e in group_starts(part, keys):
                _, i, j = part[keys].iloc[s].tolist()
                left, right = np.flatnonzero(chunks[s:e] == i), np.flatnonzero(chunks[s:e] == j)
                if len(left) and len(right):
                    found += _linked_in(h[s:e], group[s:e], part["shingles"].iloc[s:e].tolist(), left, right, least)
            a, b = zip(*found, strict=True) if found else ((), ())
            yield pd.DataFrame({"a": np.array(a, np.int64), "b": np.array(b, np.int64)})

    full = tasks.join(sets, "h").repartition(*keys).sortWithinPartitions(*keys, "h")
    return checkpointed(full.mapInPandas(run, "a long, b long"))


def similar_groups(docs: DataFrame, words: int = SIMILAR_WORDS, least: float = LEAST, seed: int = SEED, chunk: int = CHUNK) -> DataFrame:
    """``(doc_id, component_id)`` for every row with an id: fingerprints within ``BITS`` link, and texts whose shingles of
    ``words`` words have a Jaccard similarity of ``least`` or more.

    A radius of bits that reaches 0.8 (about 16 of 64) is met by chance too often to index, so these links have band keys of
    their own. Each text is first verified against the smallest of its bucket, so a group of near copies that are alike falls
    together in linear time. Then texts of a bucket that aren't in one component yet are compared in blocks (``_linked_in_buckets``).
    Texts are read twice: for their fingerprints and band keys, and, those that share a key, for their shingles.
    """
    docs = docs.select("doc_id", "text").where("doc_id is not null")
    made = checkpointed(prints(docs, words, seed))
    texts = checkpointed(made.groupBy("h").agg(F.min("doc_id").alias("id"), F.first("fp").alias("fp")))
    by_print = checkpointed(texts.groupBy("fp").agg(F.min("h").alias("node")))
    edges = texts.select("h", "fp").join(by_print, "fp").select(F.col("h").alias("a"), F.col("node").alias("b")).unionByName(links(by_print))
    every = made.select("h", F.explode("bands").alias("key"))
    shared = written(every.groupBy("key").agg(F.min("h").alias("low"), F.max("h").alias("_high")).where("low < _high").select("key", "low"))
    keyed = checkpointed(every.join(shared, "key").select("key", "low", "h").distinct())
    wanted = written(keyed.select("h").distinct().join(texts, "h").select(F.col("id").alias("doc_id")).distinct())
    sets = checkpointed(shingle_sets(docs.join(wanted, "doc_id"), words, seed).drop("doc_id").dropDuplicates(["h"]))
    first = checkpointed(keyed.where("h <> low").select(F.col("low").alias("a"), F.col("h").alias("b")).distinct())
    edges = checkpointed(edges.unionByName(_verified(first, sets, least)).where("a <> b"))
    known = checkpointed(components(edges))
    # buckets of the same texts, as their number, least and sign tell, are compared once; those of two texts have been
    sizes = keyed.groupBy("key").agg(F.first("low").alias("low"), F.count("*").alias("n"), F.bit_xor(F.xxhash64("h")).alias("sign")).where("n > 2")
    once = written(sizes.groupBy("n", "low", "sign").agg(F.min("key").alias("key")).select("key"))
    named = checkpointed(keyed.join(once, "key").join(known, F.col("h") == F.col("node"), "left").select("key", "h", "low", F.coalesce("component", "h").alias("c")))
    mixed = named.groupBy("key").agg(F.min("c").alias("_least"), F.max("c").alias("_most"), F.max(F.when(F.col("h") == F.col("low"), F.col("c"))).alias("_c")).where("_least < _most")
    open_ = named.join(written(mixed.select("key", "_c")), "key").select(F.col("key").alias("bucket"), "h", "c", F.col("_c").alias("low"))
    open_ = checkpointed(open_.join(checkpointed(sets.select("h", "m")), "h"))
    groups = components(edges.unionByName(_linked_in_buckets(open_, sets, least, chunk)))
    joined = checkpointed(texts.select("h", "id").join(groups, F.col("h") == F.col("node"), "left").select("h", "id", F.coalesce("component", "h").alias("c")))
    first_ids = checkpointed(joined.groupBy("c").agg(F.min("id").alias("component_id")))
    named = checkpointed(joined.join(first_ids, "c").select("h", "component_id"))
    return made.select("doc_id", "h").join(named, "h").select("doc_id", "component_id")


def keep_first_similar(docs: DataFrame, **options) -> DataFrame:
    """``docs`` with one row of each of ``similar_groups``: that of its smallest ``doc_id``. Rows without an id all stay.

    The ids that go are fewer than those that stay, and are written first; so texts are shuffled only if the ids are too many to
    broadcast.
    """
    mine, name = F.bool_or(F.col("doc_id") == F.col("component_id")), unused(docs, "gone")
    gone = written(similar_groups(docs, **options).groupBy("doc_id").agg(mine.alias("mine")).where("not mine").select(F.col("doc_id").alias(name)))
    return docs.join(gone, F.col("doc_id") == F.col(name), "left_anti")


def op1_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = near_duplicates(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.select("doc_id", hex16(F.col("fp")).alias("fingerprint"), "component_id")
