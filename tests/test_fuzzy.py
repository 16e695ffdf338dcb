import random
from difflib import SequenceMatcher

import pytest
from conftest import rows
from pyspark.sql import functions as F

from speechgrain.functions import text as T
from speechgrain.operators import chunks, fuzzy


def made(seed, n=90):
    rng = random.Random(seed)
    words = ["blue", "green", "rod", "widget", "gear", "steel", "wheel", "a", "of", "the"]
    base = [" ".join(rng.choice(words) for _ in range(rng.randint(1, 4))) for _ in range(n // 2)]
    out = set(base)
    for _ in range(n):
        x = list(rng.choice(base))
        for _ in range(rng.randint(1, 3)):
            k = rng.randrange(len(x) + 1)
            x[k : k + rng.randint(0, 1)] = rng.choice("abcdefg ")
        out.add("".join(x))
    return sorted(out | {"", "x", "aaaaaaaaaa", "aaaaaaaaab", "ab" * 12, "ba" * 12})


@pytest.mark.parametrize("ratio", [0.5, 0.7, 0.85])
def test_no_pair_is_lost(spark, ratio):
    texts = made(int(ratio * 100))
    frame = spark.createDataFrame([(g, t) for g in (1, 2) for t in texts[g - 1 :: g]] + [(1, texts[5]), (1, None)], "g int, k string")
    got = sorted(map(tuple, fuzzy.alike_pairs(frame, ratio, "g").collect()))
    want = []
    for g in (1, 2):
        own = [t for t in sorted(set(texts[g - 1 :: g])) if t]
        want += [(g, a, b, r) for i, a in enumerate(own) for b in own[i + 1 :] if (r := SequenceMatcher(None, a, b).ratio()) >= ratio]
    assert got == sorted(want)


def test_the_index_parts_most_pairs(spark):
    rng = random.Random(7)
    name = lambda: "".join(rng.choice("etaoinshrdlucmfwypvbgkjqxz"[: rng.choice([8, 26])]) for _ in range(rng.randint(8, 24)))
    texts = [name() for _ in range(600)]
    frame = spark.createDataFrame([(1, t) for t in texts] + [(1, t + "x") for t in texts[:100]], "g int, k string")
    n = fuzzy.candidates(frame, 0.85, "g").count()
    assert 100 <= n < 0.1 * 700 * 699 / 2
    found = fuzzy.candidates(frame, 0.85, "g").where(fuzzy.gram_filter(F.col("left_key"), F.col("right_key"), 0.85, 2) & (T.letter_bound(F.col("left_key"), F.col("right_key")) >= 0.85)).count()
    assert 100 <= found < 1000


def test_bounds_hold_for_same_text(spark):
    rng = random.Random(3)
    texts = [t for t in made(9) if t]
    pairs = [(rng.choice(texts), rng.choice(texts)) for _ in range(2000)] + [(t, t + " more") for t in texts] + [("a b c d", "x a b c d e"), ("one two three four", "zz two three four")]
    df = spark.createDataFrame(pairs, "a string, b string").select(T.may_be_same(F.col("a"), F.col("b")).alias("may"), T.same_text(F.col("a"), F.col("b")).alias("same"))
    found = df.groupBy("may", "same").count().collect()
    assert not any(r.same and not r.may for r in found) and any(not r.may for r in found)


def test_boundary_duplicates_equal_the_walk_in_order(spark):
    rng = random.Random(5)
    words = ["so", "we", "start", "with", "the", "plan", "and", "then", "go"]
    out = []
    for session in (1, 2):
        for chunk in range(4):
            begin = chunk * 285_000
            for k in range(12):
                s = begin + rng.choice([0, 2_000, 9_000, 14_000, 100_000, 270_000, 284_000, 290_000])
                t = " ".join(rng.choice(words[: rng.choice([2, 9])]) for _ in range(rng.randint(1, 5)))
                a, b = rng.choice([(s, s + rng.randint(0, 8_000))] * 6 + [(None, s), (s, None), (None, None)])
                out.append((session, chunk, k, begin, a, b, t))
    frame = spark.createDataFrame(out, "session_id int, chunk_idx int, seg_idx int, chunk_start_ms long, start_ms long, end_ms long, text string")
    key = ("session_id", "chunk_idx", "seg_idx")
    fast, slow = rows(chunks.boundary_dedup(frame).select(*key), *key), rows(chunks._in_order(frame, chunks.OVERLAP_MS, False).select(*key), *key)
    assert fast == slow and len(fast) < len(out)
