"""Tokenising, classifiers, url filter, vectors and the pipeline: round trips, brute force, held-out accuracy, defined cases."""

import base64
import random
import re
import zlib

import duckdb
import numpy as np
import public_tokenizers
import pytest
from conftest import rows

from pyspark.sql import functions as F

import __spark_entry__
import corpus_pipeline
from speechgrain.llm import byte_bpe, itq, labelled, line_crf, registry, token_files, toxicity, url_filter
from speechgrain.llm.pieces import BatchCache, Cache, cut_before

RANKS = public_tokenizers.path("byte_bpe_50k.tiktoken")
ODD = ["a", " ", "  ", "\n", "\t", "é", "ß", "日本", "🙂", "1", "23", "'s", "'", "don't", "\x00", "the", "ing", " of", "<|endoftext|>", "\u00a0", "\u2003"]


def odd_texts(n=200, seed=3):
    rng = random.Random(seed)
    return [None, "", " ", "x" * 5000, " " * 3000, "word " * 20000] + ["".join(rng.choice(ODD) for _ in range(rng.choice([1, 5, 40, 300]))) for _ in range(n)]


# --- byte-level BPE ----------------------------------------------------------------------------------------------------


def test_bpe_equals_tiktoken_and_round_trips(spark):
    import tiktoken

    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(RANKS, "rb"))}
    known = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    items = odd_texts()
    df = spark.createDataFrame(list(enumerate(items)), "doc_id long, text string").withColumns({"ids": F.lit("clash"), "_run": F.lit("clash")})
    for r in byte_bpe.encode_documents(df, RANKS, public_tokenizers.PATTERN, "bytes").collect():
        want = known.encode_ordinary(items[r.doc_id] or "")
        assert np.frombuffer(r.ids, "<u4").tolist() == want and r.n_tokens == len(want) and bytes(r.decoded) == (items[r.doc_id] or "").encode()
    assert byte_bpe.encode_documents(df, RANKS, public_tokenizers.PATTERN).where("not round_trip").count() == 0
    assert byte_bpe.encode_documents(df.where("false"), RANKS, public_tokenizers.PATTERN).count() == 0


def test_every_token_encodes_to_itself():
    tokens = byte_bpe.read_ranks(open(RANKS, "rb").read())
    coder = byte_bpe.ByteBpe(byte_bpe.sentencepiece_model(tokens), public_tokenizers.PATTERN)
    assert coder.tokens == tokens
    texts = {}
    for i, token in enumerate(tokens):
        try:
            texts[i] = token.decode()
        except UnicodeDecodeError:
            continue
    assert [np.frombuffer(coder._encode(t), "<u4").tolist() for t in texts.values()] == [[i] for i in texts]
    with pytest.raises(ValueError):
        byte_bpe.read_ranks(b"YQ== 0\nYg== 2\n")


def test_cache_is_bounded_and_right():
    asked = []
    cache = Cache(lambda p: asked.append(p) or p.encode(), size=10 * (Cache.ENTRY + 4))
    rng = random.Random(0)
    for _ in range(300):
        parts = [str(rng.randint(0, 60)) for _ in range(rng.randint(0, 30))]
        assert cache.join(parts) == "".join(parts).encode() and len(cache) <= 10 and len(cache.old) <= 10 and cache.held <= cache.size
    batch = BatchCache(list, size=10 * (Cache.ENTRY + 4))
    for _ in range(300):
        parts = [str(k).encode() for k in rng.sample(range(61), rng.randint(0, 30))]
        assert batch.many(parts) == parts and len(batch.young) <= 10 and len(batch.old) <= 10
    long = "x" * 3000
    assert cache.join(["1", long, "1"]) == f"1{long}1".encode() and long not in cache and len(asked) < 4000
    text = "ab cd " * 1000
    assert "".join(cut_before(text, lambda t, i: t[i] == " ", 100)) == text


# --- token files -------------------------------------------------------------------------------------------------------


def test_packing_round_trips():
    rng = np.random.default_rng(0)
    for k in range(200):
        high = (0, 1, 5, 300, 50_000, 1 << 31, 1 << 60, (1 << 64) - 1)[k % 8]
        x = rng.integers(0, high, rng.integers(0, 400), dtype=np.uint64, endpoint=True)
        if k % 3 == 0 and len(x):
            x[rng.random(len(x)) < 0.1] = (1 << 64) - 1
        assert (token_files.unpack(token_files.pack(x)) == x).all()
    edge = np.array([2**60 - 1, 2**60, 2**53 + 1, 0, 2**63], dtype=np.uint64)
    assert (token_files.unpack(token_files.pack(edge)) == edge).all()
    assert len(token_files.pack(np.zeros(600, np.uint64))) == 10


def test_token_files_equal_the_library(spark, tmp_path):
    from tokenizers import Tokenizer

    path = public_tokenizers.path("word_bpe_49k.json")
    plain = Tokenizer.from_file(path)
    plain.encode_special_tokens = True
    items = odd_texts(150, 5)
    order = random.Random(1).sample(range(len(items)), len(items))
    df = spark.createDataFrame([(i * 3, items[i], 1) for i in order] + [(None, "no id", 1)], "doc_id long, text string, start long")
    folder = "file://" + str(tmp_path / "tokens")
    files = token_files.write_tokens(df, open(path).read(), 2, folder)
    got = {r.doc_id: r for r in token_files.read_tokens(files).collect()}
    at, none = 0, plain.encode("no id", add_special_tokens=False).ids + [2]
    for doc, ids in [(None, none), *((i * 3, plain.encode(t or "", add_special_tokens=False).ids + [2]) for i, t in enumerate(items))]:
        assert (got[doc].start, got[doc].n_tokens, got[doc].ids_crc32) == (at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        at += len(ids)
    assert [(r.path, r.base) for r in files.orderBy("part").collect()] and files.agg({"n_ids": "sum", "n_docs": "sum"}).first().asDict() == {"sum(n_ids)": at, "sum(n_docs)": len(items) + 1}
    assert token_files.read_tokens(token_files.write_tokens(df.where("false"), open(path).read(), 2, folder)).count() == 0
    with pytest.raises(Exception):
        (tmp_path / "bad").write_bytes(b"x" * 100)
        token_files.Reader(token_files._open(str(tmp_path / "bad"))[0].open_input_file(str(tmp_path / "bad")))


def test_pieces_equal_the_library(monkeypatch):
    from tokenizers import Tokenizer

    path = public_tokenizers.path("word_bpe_49k.json")
    plain = Tokenizer.from_file(path)
    plain.encode_special_tokens = True
    own = token_files.WordTokenizer(open(path).read(), cache=50_000)
    rng = random.Random(2)
    letters = [*ODD, "B", "\u03a3", "\u03c2", "\u0130", "I\u0307", "J\u030c", "e\u0301", "E\u0301", "\u1e9e", "\u00bd", "\x0b", "\x1c", "\x85", "\u0301", ".", "...", "_", "-", "\u03a9", "\u01c5", "\uff41", "\ufb01", "\u212b", "\u0345", "\u0958", "\u0915\u094d", "\u200d", "DON'T"]
    texts = ["".join(rng.choice(letters) for _ in range(rng.choice([1, 3, 8, 30, 100]))) for _ in range(4000)]
    texts += ["".join(chr(rng.randint(1, 0x2FFF)) for _ in range(20)) for _ in range(4000)]
    texts += ["a\u03a3 b" * 3, "x" * 17 + " " + "x" * 18 + " " + "x" * 17, "\x00 a\x00 a \x00", "word " * 9, ""]
    for held in (1 << 22, 300):  # all together, and long texts in pieces
        monkeypatch.setattr(token_files, "HELD_CHARS", held)
        for text, got, want in zip(texts, own.encode_many(texts), plain.encode_batch(texts, add_special_tokens=False), strict=True):
            assert got.tolist() == want.ids, ascii(text)


def test_pieces_whose_hashes_meet_are_told_apart(monkeypatch):
    data = b"one two one three" + bytes(17)
    starts, lengths = np.array([0, 4, 8, 12]), np.array([3, 3, 3, 5])
    for factorize in (token_files.pd.factorize, lambda x: (np.zeros(len(x), np.int64), x[:1])):
        monkeypatch.setattr(token_files.pd, "factorize", factorize)
        number, pieces = token_files._distinct(data, np.frombuffer(data, np.uint8), starts, lengths)
        assert [pieces[k] for k in number] == [b"one", b"two", b"one", b"three"]


# --- classifiers -------------------------------------------------------------------------------------------------------


def test_held_out_is_crc32(spark):
    df = spark.createDataFrame([(i,) for i in range(-5, 300)] + [(None,)], "doc_id long")
    for r in df.select("doc_id", labelled.held_out(F.col("doc_id")).alias("h")).collect():
        assert r.h == (r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 5 == 0)


def corpus(spark, n=400):
    rng = random.Random(8)
    good = lambda: "\n".join(" ".join(rng.choice(["the", "house", "stood", "near", "water", "and", "trees"]) for _ in range(12)) + "." for _ in range(rng.randint(1, 5)))
    junk = lambda: "\n".join(" ".join(rng.choice(["THE%%%", "BUY###", "NOW!!", "win$$$"]) for _ in range(9)) for _ in range(rng.randint(1, 5)))
    docs, labels = [], []
    for i in range(n):
        quality, toxic = rng.random() > 0.3, rng.random() < 0.3
        text = good() if quality else junk()
        if toxic:
            words = text.split(" ")
            words.insert(rng.randrange(len(words)), rng.choice(["stupidity", "moronic"]))
            text = " ".join(words)
        docs.append((i, text))
        labels.append((i, int(quality), int(toxic)))
    docs += [(n, None), (n + 1, ""), (n + 2, "water " * 50_000), (None, "the house")]
    labels += [(n + 3, 1, 1), (None, 0, 1), (0, None, None)]
    return spark.createDataFrame(docs, "doc_id long, text string").withColumn("label", F.lit("clash")), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")


@pytest.mark.parametrize(("module", "column", "cut"), [(toxicity, "toxic", 0.5), (line_crf, "quality", 0.3)])
def test_classifiers_on_held_out_rows(spark, module, column, cut):
    docs, labels = corpus(spark)
    scored = module.score_documents(docs, module.train(docs, labels, per_class=150))
    joined = scored.join(labels, "doc_id").where(labelled.held_out(F.col("doc_id")) & F.col(column).isNotNull())
    right = joined.agg(F.avg(((F.col("score") >= cut).cast("int") == F.col(column)).cast("double")), F.count("*")).first()
    assert right[1] > 40 and right[0] > 0.95
    assert scored.count() == 404 and scored.where("score is null or score < 0 or score > 1").count() == 0
    nothing = module.score_documents(docs, module.train(docs, labels.where("false")))
    assert nothing.count() == 404
    assert module.score_documents(docs.where("false"), module.train(docs.where("false"), labels)).count() == 0


def test_field_marginals_equal_enumeration():
    rng = np.random.default_rng(4)
    for n in (1, 2, 6):
        e, chain = rng.normal(size=n), rng.normal(size=(2, 2))
        total, good, pairs = 0.0, np.zeros(n), np.zeros((2, 2))
        for k in range(2**n):
            y = [(k >> i) & 1 for i in range(n)]
            p = np.exp(sum(e[i] for i in range(n) if y[i]) + sum(chain[a, b] for a, b in zip(y, y[1:], strict=False)))
            total += p
            good += p * np.array(y)
            for a, b in zip(y, y[1:], strict=False):
                pairs[a, b] += p
        p, found, log_z = line_crf.marginals(e, chain)
        assert np.allclose(p, good / total) and np.allclose(found, pairs / total) and np.isclose(log_z, np.log(total))
        q, batch = line_crf._batch(np.concatenate([e, e[:1]]), chain, np.array([0, n]), np.array([n, 1]))
        assert np.allclose(q[:n], p) and np.allclose(batch[0], pairs / total)


def test_ngrams_do_not_depend_on_pieces(monkeypatch):
    text = "Ab cdé" * 50
    whole = np.sort(np.concatenate(list(toxicity.ngrams(text))))
    monkeypatch.setattr(toxicity, "PIECE", 17)
    assert (np.sort(np.concatenate(list(toxicity.ngrams(text)))) == whole).all() and len(whole) == sum(len(text) - n + 1 for n in toxicity.LENGTHS)


def test_length_alone_makes_no_text_toxic(spark):
    docs, labels = corpus(spark)
    strange = "".join(map(chr, np.random.default_rng(6).integers(0x4E00, 0x9FFF, 1_500_000)))  # no n-gram of the training texts
    model = toxicity.train(docs, labels, per_class=150)
    asked = spark.createDataFrame([(1, ""), (2, strange)], "doc_id long, text string")
    empty, long = rows(toxicity.score_documents(asked, model).select("score"), "doc_id")
    assert long == empty


def test_shares_count_all_characters_of_long_lines():
    for line in ["BUYNOW " * 585, "BUYNOW " * 586, "x" + "BUYNOW " * 586, "x12345 " * 585, "x12345 " * 586, "BUY NOW " * 600, "\u0130" + "BUY NOW " * 600, "\u0130 Ab 1\u0663", "\u03a3\u0663\u00b2a" * 2000, "\U0001d7d8\ud800 A" * 2000]:
        row = line_crf.line_features([line])[0]
        upper = sum(c != c.lower() for c in line) / len(line)
        assert np.isclose(row[6], upper) and row[7] == (upper > 0.5)
        assert np.isclose(row[11], sum(c.isdigit() for c in line) / len(line))


# --- urls --------------------------------------------------------------------------------------------------------------


def test_urls_and_rules(spark):
    urls = ["http://A.Example.NET/en/1?x#y", "https://example.net/de", "http://example.com/de/x", "http://notexample.com/de/x", "http://sub.example.com/de/", "http://x.org/fr/1", "http://x.org/en/1", "http://x.net", "no url", None, "http://", "//x.net/", "a://b?c://d/"]
    df = spark.createDataFrame([(i, u, None) for i, u in enumerate(urls)], "page_id long, url string, html string").withColumns({"rule": F.lit("clash"), "trust": F.lit("clash"), "_row": F.lit("clash")})
    got = rows(url_filter.judge_urls(df).select("host", "path", "rule", "verdict"), "page_id")
    assert got == [
        ("a.example.net", "/en/1", "example.net/en/", "allow"), ("example.net", "/de", "net/", "block"), ("example.com", "/de/x", "example.com/de/", "block"),
        ("notexample.com", "/de/x", None, "allow"), ("sub.example.com", "/de/", "example.com/de/", "block"), ("x.org", "/fr/1", "org/fr/", "allow"), ("x.org", "/en/1", None, "allow"),
        ("x.net", "", None, "allow"), ("", "", None, "allow"), ("", "", None, "allow"), ("", "", None, "allow"), ("", "", None, "allow"), ("b", "", None, "allow"),
    ]
    assert url_filter.judge_urls(df.where("false")).count() == 0


def web(seed=2):
    rng = random.Random(seed)
    hosts = [f"h{i}.org" for i in range(15)] + ["bad.net", "worse.net", "good.org", "x.example.net"]
    links = lambda: "".join(f'<a href="//{rng.choice(hosts).upper()}/p">x</a><A HREF=http://{rng.choice(hosts[:8])}>y</a><a href="/local">z</a>' for _ in range(3))
    return hosts, [(i, f"http://{h}/{'fr' if h == 'good.org' else 'en'}/1", links() if i % 5 else None) for i, h in enumerate(hosts)]


def test_propagation_is_personalised_pagerank(spark):
    hosts, pages = web()
    df = spark.createDataFrame([*pages, (99, "http://h0.org/en/", None)], "page_id long, url string, html string")
    judged = url_filter.judge_urls(df, damping=0.5, settled=1e-7).collect()
    got = {r.host: (r.host_trust, r.host_distrust) for r in judged}
    n, k = len(hosts), {h: i for i, h in enumerate(hosts)}
    w = np.zeros((n, n))
    for i, _, html in pages:
        for to in re.findall(url_filter.LINK, html or ""):
            if k[to.lower()] != i:
                w[i, k[to.lower()]] += 1
    st, sd = np.array([h in ("good.org", "x.example.net") for h in hosts], float), np.array([h in ("bad.net", "worse.net") for h in hosts], float)

    def rank(step, jump):  # power iteration with teleports, dangling mass included
        jump = jump / jump.sum()
        x = jump
        for _ in range(100):
            x = 0.5 * jump + 0.5 * (x @ step + x[step.sum(axis=1) == 0].sum() * jump)
        return x

    row = lambda m: m / np.where(m.sum(axis=1) > 0, m.sum(axis=1), 1)[:, None]
    trust, distrust = rank(row(w), st), rank(row(w.T), sd)
    for h in hosts:
        assert np.allclose(got[h], (trust[k[h]], distrust[k[h]]), atol=1e-6)
    assert np.isclose(sum(x for x, _ in got.values()), 1) and np.isclose(sum(x for _, x in got.values()), 1)
    assert {r.verdict for r in judged if r.rule is None} == {"allow", "block"}


def test_verdicts_equal_sql_on_a_linked_web(spark):
    data = [(k * 100 + i, u, h) for k in range(3) for i, u, h in web(k)[1]] + [(999, None, "x"), (998, "//no", None)]
    df = spark.createDataFrame(data, "page_id long, url string, html string")
    con = duckdb.connect()
    con.register("pages", df.toPandas())
    want = sorted(con.execute(url_filter.OP5_SQL).fetchall())
    got = rows(url_filter.judge_urls(df).select("page_id", "host", "path", "rule", "verdict"), "page_id")
    assert got == want and {r[4] for r in got if r[3] is None} == {"allow", "block"}


def test_propagation_settles_or_raises(spark):
    seeds = spark.createDataFrame([("a", 1.0, 1.0)], "host string, trust double, distrust double")
    edges = spark.createDataFrame([("a", "b", 1), ("b", "a", 1), ("b", "c", 3)], "src string, dst string, n long")
    got = {r.host: (r.trust, r.distrust) for r in url_filter.propagate(seeds, edges, 0.5).collect()}
    a = 0.5 / (1 - 0.5**2 / 4)
    assert np.allclose([got[h][0] for h in "abc"], [a, 0.5 * a, 0.5**2 * a * 3 / 4], atol=2e-4)
    b = 0.5 / (1 - 0.5**2)  # against the links every step is whole, and c, which links nowhere, gets none
    assert np.allclose([got[h][1] for h in "abc"], [b, 0.5 * b, 0], atol=2e-4)
    with pytest.raises(RuntimeError):
        url_filter.propagate(seeds, edges, rounds=3)


def test_distrust_flows_against_links(spark):
    farm = [(i, f"http://farm{i}.org/en/", '<a href="http://bad.net/x">') for i in range(3)]
    far = [(20 + i, f"http://far{i}.org/en/", f'<a href="http://{"farm0" if i == 0 else f"far{i - 1}"}.org/"><a href="http://fine.org/">') for i in range(25)]
    df = spark.createDataFrame([*farm, *far, (9, "http://bad.net/x", ""), (10, "http://fine.org/fr/", ""), (11, "http://fine.org/en/", '<a href="http://other.org/">')], "page_id long, url string, html string")
    got = {r.page_id: r.verdict for r in url_filter.judge_urls(df).collect()}
    assert [got[i] for i in range(3)] == ["block"] * 3 and got[9] == "block" and got[10] == got[11] == "allow"
    assert got[20] == "block" and got[44] == "allow"  # linked to a farm, and 25 links away from it


# --- vectors -----------------------------------------------------------------------------------------------------------


def vectors(seed=0, d=64):
    rng = np.random.default_rng(seed)
    base = rng.normal(size=(150, d))
    dense = base[0] + 0.05 * rng.normal(size=(120, d))
    around = [base[1 + i % 40] * rng.uniform(0.5, 3) + rng.uniform(0, 0.45) * np.linalg.norm(base[1 + i % 40]) / np.sqrt(d) * rng.normal(size=d) for i in range(200)]
    return np.vstack([base, dense, around, base[:5], base[:5]]).astype(np.float32)


@pytest.mark.parametrize("chunk", [16, 2048])
def test_vectors_against_brute_force(spark, chunk):
    x = vectors()
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<float>").withColumns({"rep": F.lit("clash"), "members": F.lit("clash")})
    got = {r.vec_id: r for r in itq.near_duplicates(df, chunk=chunk).collect()}
    u = x.astype(float) / np.linalg.norm(x.astype(float), axis=1, keepdims=True)
    near = u @ u.T >= 0.9
    np.fill_diagonal(near, False)
    found = np.array([got[i].n_links for i in range(len(x))])
    assert (found <= near.sum(axis=1)).all() and found.sum() >= 0.9 * near.sum()
    label = np.arange(len(x))
    while True:
        new = np.minimum(label, np.where(near, label[None, :], len(x)).min(axis=1))
        if (new == label).all():
            break
        label = new
    assert all(label[got[i].component_id] == label[i] and got[i].component_id <= i for i in range(len(x)))
    assert all(got[i].kept == (got[i].component_id == i) for i in range(len(x)))


def test_recall_holds_for_few_components(spark):
    x = np.random.default_rng(3).normal(size=(3000, 8)).astype(np.float32)
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<float>")
    u = x.astype(float) / np.linalg.norm(x.astype(float), axis=1, keepdims=True)
    want = (u @ u.T >= 0.9).sum() - len(x)
    found = itq.near_duplicates(df).agg(F.sum("n_links")).first()[0]
    assert 0.9 * want <= found <= want


@pytest.mark.parametrize("n", [2_000, 100_000, 10_000_000, 1_000_000_000])
def test_recall_holds_as_tables_grow(n):
    rng = np.random.default_rng(n)
    u = rng.normal(size=(20_000, 64)) * np.linspace(2, 0.5, 64) + 0.3
    u /= np.linalg.norm(u, axis=1, keepdims=True)
    mean, projection = itq.learn(u[:10_000], 64)
    chosen = itq.choose_tables(u[:10_000], mean, projection, n, 0.9)
    side = rng.normal(size=u.shape)
    side -= (side * u).sum(axis=1, keepdims=True) * u
    turned = 0.9 * u + np.sqrt(0.19) * side / np.linalg.norm(side, axis=1, keepdims=True)
    differ = (itq.encode(u, mean, projection) ^ itq.encode(turned, mean, projection))[10_000:]
    assert np.any([(differ & np.uint64(m)) == 0 for m in chosen], axis=0).mean() >= 0.93
    assert n < 100_000 or len(chosen) * n / 2 ** min(m.bit_count() for m in chosen) < n / 20  # far from all pairs


def test_codes_that_are_too_far_lose_next_to_nothing():
    rng = np.random.default_rng(5)
    u = rng.normal(size=(20_000, 64))
    u /= np.linalg.norm(u, axis=1, keepdims=True)
    mean, projection = itq.learn(u[:10_000], 64)
    within = itq.farthest(u[:10_000], mean, projection, 0.9)
    side = rng.normal(size=u.shape)
    side -= (side * u).sum(axis=1, keepdims=True) * u
    for cosine in (0.9, 0.91, 0.92):
        turned = cosine * u + np.sqrt(1 - cosine**2) * side / np.linalg.norm(side, axis=1, keepdims=True)
        differ = np.bitwise_count(itq.encode(u, mean, projection) ^ itq.encode(turned, mean, projection))[10_000:]
        assert (differ <= within).mean() > 0.995
    chance = np.bitwise_count(itq.encode(u[:10_000], mean, projection) ^ itq.encode(u[10_000:], mean, projection))
    assert (chance <= within).mean() < 0.01


def test_recall_between_least_and_a_little_more(spark):
    """Pairs spread over cosines from 0.90 to 0.92, among vectors that have no others."""
    rng = np.random.default_rng(9)
    u = rng.normal(size=(6000, 64))
    u /= np.linalg.norm(u, axis=1, keepdims=True)
    side = rng.normal(size=u[:2000].shape)
    side -= (side * u[:2000]).sum(axis=1, keepdims=True) * u[:2000]
    c = rng.uniform(0.9001, 0.92, 2000)[:, None]
    x = np.vstack([u, c * u[:2000] + np.sqrt(1 - c**2) * side / np.linalg.norm(side, axis=1, keepdims=True)])
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    got = {r.vec_id: r for r in itq.near_duplicates(df).collect()}
    right = sum(got[6000 + i].component_id == i for i in range(2000))
    assert right >= 0.9 * 2000 and sum(r.n_links for r in got.values()) == 2 * right


def test_vector_cases(spark):
    nan, inf = float("nan"), float("inf")
    data = [(1, [1.0, 0.0]), (2, [1.0, 0.0]), (3, None), (4, [0.0, 0.0]), (5, [nan, 1.0]), (6, [inf, 1.0]), (7, [1.0, None]), (8, [1.0]), (9, []), (None, [1.0, 0.0]), (10, [0.0, 1.0])]
    data += [(11, [1.0, 0.0, 0.0]), (12, [3.0, 0.0, 0.1]), (13, [0.0, 1.0, 0.0])]  # another length has its own links
    df = spark.createDataFrame(data, "vec_id long, embedding array<float>")
    got = rows(itq.near_duplicates(df), "vec_id")
    assert got[0] == (None, 2, 1, False) and got[1] == (1, 2, 1, True) and got[2] == (2, 2, 1, False)
    assert all(r[1:] == (0, r[0], True) for r in got[3:] if r[0] not in (11, 12))
    assert got[11:13] == [(11, 1, 11, True), (12, 1, 11, False)]
    nobody = spark.createDataFrame([(None, [1.0, 0.0]), (None, [1.0, 0.1]), (None, [1.0, 0.0]), (5, [0.0, 1.0])], "vec_id long, embedding array<double>")
    assert [r[:3] for r in rows(itq.near_duplicates(nobody), "vec_id")] == [(None, 2, None)] * 3 + [(5, 0, 5)]
    some = spark.createDataFrame([(None, [1.0, 0.0]), (7, [1.0, 0.1])], "vec_id long, embedding array<double>")
    assert [r[:3] for r in rows(itq.near_duplicates(some), "vec_id")] == [(None, 1, 7), (7, 1, 7)]
    assert itq.near_duplicates(df.where("false")).count() == 0
    assert itq.near_duplicates(df.where("vec_id = 3")).count() == 1


# --- pipeline ----------------------------------------------------------------------------------------------------------


def test_pipeline(spark):
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert names == ["quality rules", "line dedup", "SimHash near-dedup", "mixing", "byte-level BPE"]
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    now = docs
    for _, stage in corpus_pipeline.STAGES[:-1]:
        now = stage(spark, now, "/root/testdata/sf0.001")
        assert now.columns == docs.columns and dict(now.dtypes) == dict(docs.dtypes)
    out = corpus_pipeline.run(spark, "/root/testdata/sf0.001")
    assert out.where("not round_trip").count() == 0 and out.count() > 100
    assert corpus_pipeline.STAGES[3][1](spark, corpus_pipeline.STAGES[0][1](spark, docs.where("false"), ""), "").count() == 0


def test_registry():
    names = list(registry.queries())
    assert [int(n[2:].split("_")[0]) for n in names] == list(range(1, 14)) and set(registry.oracle_sql()) <= set(names)
    assert {*names, "pipeline"} <= set(__spark_entry__.queries()) and "pipeline" not in __spark_entry__.oracle_sql()
