"""Every ``opN_`` query and the pipeline on small tables of their own: names, types, and rows by plain Python; and on empty tables."""

import base64
import hashlib
import random
import re
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
import xxhash
from pyspark.sql import functions as F

import __spark_entry__
import corpus_pipeline
from speechgrain.llm import line_crf, registry, toxicity

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
#: Names and types that each query must return; more columns may follow.
CONTRACTS = {
    "op1_simhash": "doc_id bigint, fingerprint string, component_id bigint",
    "op2_line_dedup": "doc_id bigint, n_lines bigint, n_dropped bigint, kept_sha256 string",
    "op3_line_crf": "doc_id bigint, held_out boolean, score double, predicted int",
    "op4_token_files": "doc_id bigint, start bigint, n_tokens bigint, ids_crc32 bigint",
    "op5_url_filter": "page_id bigint, host string, path string, rule string, verdict string",
    "op6_itq": "vec_id bigint, n_links bigint, component_id bigint, kept boolean",
    "op7_byte_bpe": "doc_id bigint, n_tokens bigint, ids_sha256 string, decoded_sha256 string",
    "op8_toxicity": "doc_id bigint, held_out boolean, score double, predicted int",
    "op9_quality_rules": "doc_id bigint, n_words bigint, word_chars bigint, n_symbols bigint, n_dup_lines bigint, n_repeat_words bigint, base_failed boolean, kept boolean",
    "op10_mixing": "doc_id bigint, size bigint, source_size bigint, target double, taken bigint",
}
TABLES = {
    "documents": "doc_id long, text string, lang string, source string, n_chars long, _row string, key string, component string",
    "labels": "doc_id long, quality long, toxic long",
    "pages": "page_id long, url string, html string",
    "embeddings": "vec_id long, label long, embedding array<float>",
}


def documents():
    rng = random.Random(21)
    words = ["the", "House", "stood", "near", "water", "and", "trees", "日本", "é", "a#b", "$$", "I'll", "2024"]
    prose = lambda n: " ".join(rng.choice(words) + rng.choice(["", "", ".", ",", "\n"]) for _ in range(n))
    out = [prose(rng.choice([3, 30, 120, 400])) for _ in range(70)]
    out += [None, "", " \t\n ", "one", "ONE", "\n\n", "<|endoftext|> text", "x" * 3000, "wort " * 6000, out[3], out[3], out[5] + "\n" + out[6], "﻿ \x00 \x1c İ"]
    out += [" ".join(f"w{k}" for k in range(200)), " ".join(f"w{k}" if k != 77 else "other" for k in range(200))]
    return out


@pytest.fixture(scope="module")
def small(spark, tmp_path_factory):
    folder, texts, rng = tmp_path_factory.mktemp("sf"), documents(), random.Random(3)
    docs = [(i * 7, t, "en", None if i % 9 == 4 else f"s{i % 4}", len(t or ""), "clash", "clash", None) for i, t in enumerate(texts)]
    vectors = [[rng.gauss(0, 1) for _ in range(16)] for _ in range(60)]
    vectors += [None, [], [0.0] * 16, [float("nan")] + [1.0] * 15, vectors[0], [2 * x for x in vectors[1]], [x + 0.05 * rng.gauss(0, 1) for x in vectors[2]]]
    data = {
        "documents": docs,
        "labels": [(d[0], rng.randint(0, 1), int(rng.random() < 0.3)) for d in docs] + [(None, 1, 0), (10**6, 1, 1), (docs[0][0], None, None)],
        "pages": [(i, u, h) for i, (u, h) in enumerate([("http://A.net/x", None), ("https://b.org/fr/1", '<a href="//c.org">'), (None, "x"), ("c.org", ""), ("http://c.org/en", None), ("http://c.org/en", None)])],
        "embeddings": [(i * 3, 0, v) for i, v in enumerate(vectors)],
    }
    for name, rows in data.items():
        spark.createDataFrame(rows, TABLES[name]).write.parquet(f"{folder}/{name}.parquet")
        spark.createDataFrame([], TABLES[name]).write.parquet(f"{folder}/empty/{name}.parquet")
    return str(folder), data


@pytest.fixture(scope="module")
def results(spark, small):
    found = {}
    for name in CONTRACTS:
        df = registry.queries()[name](spark, small[0])
        found[name] = (df.dtypes, {r[0]: r for r in df.collect()})
    return found


@pytest.mark.parametrize("name", CONTRACTS)
def test_columns_and_rows(results, small, name):
    kinds, found = results[name]
    asked = [tuple(x.split(" ")) for x in CONTRACTS[name].split(", ")]
    assert kinds[: len(asked)] == asked
    table = {"page_id": "pages", "vec_id": "embeddings"}.get(asked[0][0], "documents")
    assert sorted(found) == sorted(r[0] for r in small[1][table])


@pytest.mark.parametrize("name", [*CONTRACTS, "pipeline"])
def test_empty_tables(spark, small, name):
    df = __spark_entry__.queries()[name](spark, small[0] + "/empty")
    assert df.count() == 0 and len(df.columns) > 2


def test_fingerprints(results, small):
    got, prints = results["op1_simhash"][1], {}
    for i, t, *_ in small[1]["documents"]:
        w = WORD.findall((t or "").translate(LOW))
        s = [" ".join(w[k : k + 3]) for k in range(len(w) - 2)] or [" ".join(w)] * bool(w)
        h = [xxhash.xxh64_intdigest(x.encode(), 42) for x in s]
        prints[i] = sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(s))
    reach = {i: i for i in prints}
    for _ in prints:
        reach = {i: min(reach[j] for j in prints if (prints[i] ^ prints[j]).bit_count() <= 2) for i in prints}
    assert {i: (r.fingerprint, r.component_id) for i, r in got.items()} == {i: (f"{p:016x}", reach[i]) for i, p in prints.items()}


def test_token_digests(results, small):
    import tiktoken
    from tokenizers import Tokenizer

    word = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    word.encode_special_tokens = True  # as the vocabulary's documentation loads it
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(public_tokenizers.path("byte_bpe_50k.tiktoken"), "rb"))}
    bpe = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    start = 0
    for i, t, *_ in sorted(small[1]["documents"], key=lambda r: r[0]):
        ids = np.array(word.encode(t or "", add_special_tokens=False).ids + [2], "<u4")
        r = results["op4_token_files"][1][i]
        assert (r.start, r.n_tokens, r.ids_crc32) == (start, len(ids), zlib.crc32(ids.tobytes()))
        start += len(ids)
        ids, r = np.array(bpe.encode_ordinary(t or ""), "<u4"), results["op7_byte_bpe"][1][i]
        assert (r.n_tokens, r.ids_sha256, r.decoded_sha256) == (len(ids), hashlib.sha256(ids.tobytes()).hexdigest(), hashlib.sha256((t or "").encode()).hexdigest())


@pytest.mark.parametrize(("name", "cut"), [("op3_line_crf", 0.3), ("op8_toxicity", 0.5)])
def test_scores(results, name, cut):
    for i, r in results[name][1].items():
        assert r.held_out == (zlib.crc32(str(i).encode()) % 5 == 0) and 0 <= r.score <= 1 and r.predicted == int(r.score >= cut)


def test_urls(results):
    assert [tuple(results["op5_url_filter"][1][i])[1:] for i in range(6)] == [
        ("a.net", "/x", "net/", "block"), ("b.org", "/fr/1", "org/fr/", "allow"), ("", "", None, "allow"), ("", "", None, "allow"), ("c.org", "/en", None, "allow"), ("c.org", "/en", None, "allow"),
    ]


def test_vector_links(results, small):
    got = results["op6_itq"][1]
    linked = {0: (1, 0), 64 * 3: (1, 0), 3: (1, 3), 65 * 3: (1, 3), 6: (1, 6), 66 * 3: (1, 6)}
    assert all((r.n_links, r.component_id, r.kept) == (*linked.get(i, (0, i)), linked.get(i, (0, i))[1] == i) for i, r in got.items())


def test_sizes_and_mix(results, small):
    got, sizes, source = results["op10_mixing"][1], {}, {r[0]: r[3] for r in small[1]["documents"]}
    for i, t, *_ in small[1]["documents"]:
        sizes[i] = len(WORD.findall(t or ""))
    all_, taken = Counter(), Counter()
    for i, n in sizes.items():
        all_[source[i]] += n
    for i, r in got.items():
        assert (r.size, r.source_size) == (sizes[i], all_[source[i]]) and 0 <= r.taken <= 2 * r.size
        taken[source[i]] += r.taken
    target = {source[i]: r.target for i, r in got.items()}
    assert abs(sum(target.values()) - 1.5 * sum(sizes.values())) < 1e-6 and all(target[s] <= 2 * all_[s] for s in all_)
    assert all(abs(taken[s] - target[s]) <= max(n for i, n in sizes.items() if source[i] == s) for s in all_)


# --- the pipeline ------------------------------------------------------------------------------------------------------


def test_stages_take_nulls_and_clashing_columns(spark, small):
    """Each stage alone, on documents with null ids, texts and sources, repeated rows and columns that operators use themselves."""
    docs = spark.read.parquet(f"{small[0]}/documents.parquet")
    odd = [(None, "a text without an id, but of twenty words or more so that it may stay in here: one two three four five", None, None, None, "x", None, "y"), (None, None, None, None, None, None, None, None)]
    docs = docs.unionByName(spark.createDataFrame(odd * 2, docs.schema)).unionByName(docs.where("doc_id < 30"))
    for _, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, small[0])
        assert out.columns == docs.columns and out.dtypes == docs.dtypes and 0 < out.count()
        assert {(r._row, r.key) for r in out.select("_row", "key").distinct().collect()} <= {("clash", "clash"), ("x", None), (None, None)}
    last = corpus_pipeline.STAGES[-1][1](spark, docs, small[0])
    assert last.count() == docs.count() and last.where("not round_trip").count() == 0


def test_stages_take_every_name_that_they_use_themselves(spark):
    """Columns called like anything that the stages' modules quote; the rows that stay are those of the plain columns."""
    import inspect

    from speechgrain.llm import byte_bpe, common, components, line_dedup, mixing, quality_rules, simhash

    quoted = {w for m in (byte_bpe, common, components, line_dedup, mixing, quality_rules, simhash) for w in re.findall(r"[\"'.](_?[a-z]\w{0,14})[\"']", inspect.getsource(m))}
    made = {"n_tokens", "ids", "round_trip", "n_lines", "n_dropped"}
    names = sorted({w.lower() for w in quoted} - {"doc_id", "text", "lang", "source", "n_chars"} - made)
    assert {"gone", "_key", "component_id", "h", "_row"} <= set(names) and len(names) > 80
    docs = documents()[:30] * 2
    plain = spark.createDataFrame([(i, t, "en", f"s{i % 3}", len(t or "")) for i, t in enumerate(docs)], "doc_id long, text string, lang string, source string, n_chars long")
    more = plain.select("*", *[F.concat(F.lit(n), F.col("doc_id")).alias(n) for n in names])
    for _, stage in corpus_pipeline.STAGES:
        kept = sorted((tuple(r) for r in stage(spark, plain, "").collect()), key=repr)
        out = stage(spark, more, "")
        columns = stage(spark, plain.limit(0), "").columns
        found = out.select(*columns, *names).collect()
        assert sorted((tuple(r)[: len(columns)] for r in found), key=repr) == kept
        assert all(r[n] == f"{n}{r.doc_id}" for r in found for n in names)


def test_near_copies_leave_one_row(spark, small):
    docs = spark.read.parquet(f"{small[0]}/documents.parquet")
    ids = {r.doc_id for r in corpus_pipeline.near_duplicates(spark, docs, "").select("doc_id").collect()}
    texts = {r[0]: r[1] for r in small[1]["documents"]}
    pair = [i for i, t in texts.items() if t and t.startswith("w0 w1 ")]
    assert len(pair) == 2 and min(pair) in ids and max(pair) not in ids
    copies = [i for i, t in texts.items() if t == texts[3 * 7]]
    assert len(copies) == 3 and [i in ids for i in sorted(copies)] == [True, False, False]


# --- the classifiers against plain forms -------------------------------------------------------------------------------


def test_gradient_of_the_field():
    rng = np.random.default_rng(2)
    docs = [rng.normal(size=(n, line_crf.OWN)) for n in (1, 4, 2, 6)]
    y = np.array([1, 0, 1, 0])
    loss = line_crf.Likelihood(docs, y, 0.01)
    theta = 0.1 * rng.normal(size=3 * line_crf.OWN + 4)

    def value(theta):  # the penalised negative log-likelihood, document by document
        out = 0.005 * (theta**2).sum()
        for d, k, w in zip(docs, y, loss.weight, strict=True):
            emission, chain = line_crf.with_neighbours(d) @ theta[:-4], theta[-4:].reshape(2, 2)
            out += w * (line_crf.marginals(emission, chain)[2] - (emission.sum() if k else 0) - (len(d) - 1) * chain[k, k])
        return out

    found = loss.gradient(theta)
    for k in [0, 5, 20, 40, 53, 54, 55, 56, 57]:
        step = np.zeros(len(theta))
        step[k] = 1e-5
        assert np.isclose(found[k], (value(theta + step) - value(theta - step)) / 2e-5, atol=1e-6)


def test_goodness_equals_enumeration_and_does_not_depend_on_blocks(monkeypatch):
    rng = np.random.default_rng(6)
    lines = ["The house stood.", "", "BUY NOW ### | x", "the house stood.", "a a a", "日本 | 1"]
    weights, chain = rng.normal(size=3 * line_crf.OWN), rng.normal(size=(2, 2))
    e = line_crf.with_neighbours(line_crf.line_features(lines)) @ weights
    total, good = 0.0, np.zeros(len(lines))
    for k in range(2 ** len(lines)):
        y = np.array([(k >> i) & 1 for i in range(len(lines))])
        p = np.exp((e * y).sum() + chain[y[:-1], y[1:]].sum())
        total += p
        good += p * y
    sizes = np.array([max(len(x), 1) for x in lines])
    want = (good / total * sizes).sum() / sizes.sum()
    for block in (1, 2, 5, 100):
        monkeypatch.setattr(line_crf, "BLOCK", block)
        assert np.allclose(line_crf.emissions(lines, weights), e)
        assert np.isclose(line_crf.goodness("\n".join(lines), weights, chain), want)


def test_many_lines_take_bounded_memory():
    import tracemalloc

    text = "\n".join(f"line {k % 1000}" for k in range(200_000))
    rng = np.random.default_rng(0)
    tracemalloc.start()
    line_crf.goodness(text, rng.normal(size=3 * line_crf.OWN), np.zeros((2, 2)))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 400 * 200_000


def test_ratios_choice_and_score_equal_plain_counts(spark):
    rng = random.Random(5)
    rows = [("".join(rng.choice("abcDe ") for _ in range(rng.randint(0, 40))) + rng.choice(["", " bad"] if k % 3 else [""]), int(k % 3 == 0)) for k in range(60)]
    grams = lambda t: {t.lower()[i : i + n] for n in toxicity.LENGTHS for i in range(len(t.lower()) - n + 1)}
    name = lambda g: int(next(x for x in toxicity.ngrams(g, (len(g),)))[0])
    counts = [Counter(g for t, k in rows if k == label for g in grams(t)) for label in (0, 1)]
    n = [sum(k == label for _, k in rows) for label in (0, 1)]
    ratio = {g: np.log((counts[1][g] + 1) / (n[1] + 2) / ((counts[0][g] + 1) / (n[0] + 2))) for g in counts[0] | counts[1] if counts[0][g] + counts[1][g] >= 4}
    df = spark.createDataFrame(rows, "text string, label int").repartition(3)
    hashes, found = toxicity.choose_features(df, features=10**6)
    assert hashes.tolist() == sorted(map(name, ratio)) and np.allclose(found, [ratio[g] for g in sorted(ratio, key=name)])
    hashes, found = toxicity.choose_features(df, features=20)
    strength = {g: abs(r) * (counts[0][g] + counts[1][g]) ** 0.5 for g, r in ratio.items()}
    assert np.isclose(sorted(abs(r) for r in found), sorted(abs(ratio[g]) for g in sorted(strength, key=lambda g: (-strength[g], name(g)))[:20])).all()
    weights = np.random.default_rng(1).normal(size=len(hashes))
    by_gram = {h: w for h, w in zip(hashes.tolist(), weights, strict=True)}
    for t, _ in rows:
        z = 0.3 + sum(by_gram.get(name(g), 0) for g in grams(t))
        assert np.isclose(toxicity.score(t, hashes, weights, 0.3, toxicity.sieve(hashes)), 1 / (1 + np.exp(-z)))


def test_fit_reaches_the_least_loss():
    rng = np.random.default_rng(3)
    rows = [np.flatnonzero(rng.random(12) < (0.6 if k % 2 else 0.3)) for k in range(80)]
    y, scale = np.array([k % 2 for k in range(80)]), rng.uniform(0.5, 2, 12)
    w, b = toxicity._gradient_fit(rows, y, 12, scale, 0.01, rounds=3000)
    x = np.array([[scale[j] if j in set(r.tolist()) else 0 for j in range(12)] for r in rows])
    p = 1 / (1 + np.exp(-(x @ w + b)))
    weight = np.where(y == 1, 0.5 / y.sum(), 0.5 / (1 - y).sum())
    assert np.abs(x.T @ ((p - y) * weight) + 0.01 * w).max() < 1e-3 and abs(((p - y) * weight).sum()) < 1e-3
