"""Operators 11 to 13 against plain forms, and their defined cases."""

import datetime
import hashlib
import random
import re

import numpy as np
import pytest

from speechgrain.llm import common, components, concurrency, decontamination, itq, registry, simhash, vector_codes

SALES = "sale_id long, client_id long, total double, sold_at timestamp_ntz, extra string"
LINES = "sale_id long, shipped_at timestamp_ntz, sold_at string"
CLIENTS = "client_id long, nation_id int, total string"


def kinds(df):
    return [f"{c} {t}" for c, t in df.dtypes]


def write(spark, folder, tables):
    for name, (rows, schema) in tables.items():
        spark.createDataFrame(rows, schema).write.mode("overwrite").parquet(f"{folder}/{name}.parquet")


# --- 11 ----------------------------------------------------------------------------------------------------------------


def open_by_hand(intervals):
    out, groups = [], {g for g, *_ in intervals}
    for g in groups:
        real = [(a, b, w or 0) for h, a, b, w in intervals if h == g and a is not None and (b is None or b > a)]
        change = {}
        for a, b, w in real:
            for s, n in ((a, 1), (b, -1)):
                if s is not None:
                    x = change.setdefault(s, [0, 0])
                    x[0] += n
                    x[1] += n * w
        at = sorted(s for s, x in change.items() if any(x))
        state = [(sum(1 for a, b, _ in real if a <= s and (b is None or b > s)), sum(w for a, b, w in real if a <= s and (b is None or b > s))) for s in at]
        for k, s in enumerate(at):
            out.append((g, s, at[k + 1] if k + 1 < len(at) else None, *state[k], max(n for n, _ in state[: k + 1]), state[k][1] == max(w for _, w in state)))
    return sorted(out, key=repr)


@pytest.mark.parametrize("bucket", [7, 100, 86_400])
def test_open_counts_equal_plain_counts(spark, bucket):
    rng = random.Random(bucket)
    rows = [(rng.choice([1, 1, 1, 2, None]), rng.choice([None, *range(-50, 300)]), rng.choice([None, *range(-40, 330)]), rng.choice([None, 0, -3, *range(1, 9)])) for _ in range(300)]
    rows += [(9, 5, 10, 4), (9, 10, 15, 4), (9, 15, None, 0), (9, 700, 800, 2), (8, 3, 3, 1), (8, 4, 2, 1), (7, None, None, 1)] + [(6, 1, 2, 5)] * 3
    df = spark.createDataFrame([(*r, "x", 1) for r in rows], "group int, start_s long, end_s long, weight long, day string, n int")
    assert sorted(map(tuple, concurrency.open_counts(df, bucket).collect()), key=repr) == open_by_hand(rows)


def test_open_sales(spark, tmp_path):
    t = datetime.datetime
    sales = [
        (1, 10, 1.005, t(2024, 1, 1, 23, 59, 59, 999999), "x"), (2, 10, None, t(2024, 1, 2), None), (3, 11, 7.0, None, None), (4, None, 2.0, t(2024, 3, 31, 2, 30), None),
        (5, 99, 3.0, t(1969, 12, 31, 23, 59, 58, 500000), None), (6, 12, 5.0, t(2024, 1, 5), None), (None, 12, 1.0, t(2024, 1, 6), None), (7, 10, float("nan"), t(2024, 1, 7), None),
    ]
    lines = [(1, t(2024, 1, 3), ""), (1, t(2024, 1, 2), ""), (1, None, ""), (2, None, ""), (6, t(2024, 1, 1), ""), (None, t(2024, 1, 1), ""), (4, t(2024, 4, 1), "")]
    clients = [(10, 3, ""), (11, 4, ""), (12, None, ""), (None, 5, ""), (10, 8, "")]
    write(spark, tmp_path, {"sales": (sales, SALES), "sale_lines": (lines, LINES), "clients": (clients, CLIENTS)})
    second = lambda *x: int(t(*x, tzinfo=datetime.UTC).timestamp())
    plain = [
        (3, second(2024, 1, 1, 23, 59, 59), second(2024, 1, 3), 100), (3, second(2024, 1, 2), None, 0), (-1, second(2024, 3, 31, 2, 30), second(2024, 4, 2), 200),
        (-1, -2, None, 300), (-1, second(2024, 1, 6), None, 100), (3, second(2024, 1, 7), None, 0),
    ]
    zone = spark.conf.get("spark.sql.session.timeZone")
    try:
        spark.conf.set("spark.sql.session.timeZone", "Europe/Berlin")  # 2:30 of March 31 isn't an hour there
        df = registry.queries()["op11_open_sales"](spark, str(tmp_path))
        assert kinds(df) == ["nation_id int", "from_s bigint", "to_s bigint", "n_open bigint", "open_cents bigint", "high_open bigint", "is_peak boolean"]
        assert sorted(map(tuple, df.collect()), key=repr) == open_by_hand(plain + [(-2, *r[1:]) for r in plain])
    finally:
        spark.conf.set("spark.sql.session.timeZone", zone)
    write(spark, tmp_path, {"sales": ([], SALES), "sale_lines": ([], LINES), "clients": ([], CLIENTS)})
    assert registry.queries()["op11_open_sales"](spark, str(tmp_path)).count() == 0


def test_no_broadcast_and_a_window_per_day(spark):
    df = spark.createDataFrame([(1, 2, 3, 4)], "group int, start_s long, end_s long, weight long")
    plan = concurrency.open_counts(df)._jdf.queryExecution().executedPlan().toString()
    assert "Broadcast" not in plan and "SinglePartition" not in plan


# --- 12 ----------------------------------------------------------------------------------------------------------------

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def hits_by_hand(text, items, window):
    w, hit, names = WORD.findall((text or "").translate(LOW)), set(), set()
    for name, t in items:
        own = WORD.findall((t or "").translate(LOW))
        n = min(window, len(own))
        for k in range(len(own) - n + 1) if n else ():
            for p in range(len(w) - n + 1):
                if w[p : p + n] == own[k : k + n]:
                    hit |= set(range(p, p + n))
                    names.add(name)
    return len(w), hit, sorted(str(x) for x in names - {None})


@pytest.mark.parametrize("window", [1, 2, 3, 5])
def test_automaton_equals_plain_search(window):
    rng = random.Random(window)
    text = lambda n, k: " ".join(rng.choice("abcdefgh"[:k]) + rng.choice(["", ".", " -"]) for _ in range(n))
    for k in (2, 3, 8):
        items = [(str(i), text(rng.choice([0, 1, 2, 3, 4, 9, 20]), k)) for i in range(9)]
        items += [("same", items[5][1]), ("none", None), (None, "a b c d"), ("long", "Zürich 日本 x1 " * 4)]
        own = decontamination.Automaton([(i, decontamination.words_of((t or "").encode())) for i, t in items], window)
        for doc in [text(n, k) for n in (0, 1, 2, 5, 30, 80)] + ["the ZÜRICH zürich 日本 x1, ZÜrich Zürich 日本 x1 Zürich", "", "."]:
            hit, names = own.match(decontamination.words_of(doc.encode()))
            n, want, wanted = hits_by_hand(doc, items, window)
            assert sorted(np.flatnonzero(hit).tolist() if hit is not None else []) == sorted(want)
            assert sorted(names - {None}) == wanted


def test_scan_in_shards_and_without_items(spark):
    rng = random.Random(4)
    word = lambda: rng.choice(["Sun", "mOOn", "star", "é", "x2"])
    text = lambda n: " ".join(word() for _ in range(n))
    items = [(i, text(rng.choice([2, 4, 12]))) for i in range(40)] + [(3, "rare words here"), (None, text(12)), (77, None), (78, " .. ")]
    docs = [(i, text(rng.choice([1, 10, 60]))) for i in range(30)] + [(5, "rare WORDS, here"), (None, "rare words here"), (98, None), (99, ""), (100, "w " * 200_000 + items[2][1])]
    frame, given = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    asked = given.repartition(3)
    one, many = (sorted(map(tuple, decontamination.scan(frame, asked, 4, shard_words=s).select("doc_id", "n_words", "n_hit", "items").collect()), key=repr) for s in (10**6, 8))
    assert len(decontamination.build_shards(asked, 4, 8)) > decontamination.LOADED
    want = [(i, n, len(hit), names) for i, t in docs[:-1] for n, hit, names in [hits_by_hand(t, items, 4)]]
    assert one == many and [r for r in one if r[0] != 100] == sorted(want, key=repr)
    assert next(r for r in one if r[0] == 100)[1] == 200_000 + len(items[2][1].split())
    none = decontamination.scan(frame, given.limit(0)).collect()
    assert len(none) == len(docs) and all(r.n_hit == 0 and r["items"] == [] and r.spans == [] for r in none)
    assert decontamination.scan(frame.limit(0), given).count() == 0


def test_spans_go_and_columns_stay(spark):
    item = "one two three four five six"
    docs = [(1, f"Before it, {item.upper()}! After that.", 1, "k"), (2, f"<{item}>", 2, None), (3, None, 3, "k"), (4, "clean text — stays", None, "k"), (None, f"a b c d e f g h ({item}) i ({item}) j k l m n", 5, "k")]
    frame = spark.createDataFrame(docs, "doc_id long, text string, n_words int, spans string").withColumnRenamed("spans", "c0")
    out = decontamination.decontaminate(frame, spark.createDataFrame([(1, item)], "item_id long, text string"), 4, 0.6)
    assert out.dtypes == frame.dtypes
    assert sorted(map(tuple, out.collect()), key=repr) == sorted([(1, "Before it, ! After that.", 1, "k"), (3, None, 3, "k"), (4, "clean text — stays", None, "k")] + [(None, "a b c d e f g h () i () j k l m n", 5, "k")], key=repr)


def test_decontamination_query(spark, tmp_path):
    rng = random.Random(1)
    text = lambda n: " ".join(rng.choice("abc") for _ in range(n))
    items = [(i, text(rng.choice([4, 9, 10, 14, 30]))) for i in range(12)]
    docs = [(i, text(rng.choice([3, 40, 90])) + "\x00 é", "en") for i in range(20)] + [(50, None, "en"), (51, "", None)]
    write(spark, tmp_path, {"documents": (docs, "doc_id long, text string, items string"), "benchmark": (items, "item_id long, text string")})
    df = registry.queries()["op12_decontamination"](spark, str(tmp_path))
    assert kinds(df) == ["doc_id bigint", "n_words bigint", "n_hit bigint", "n_items bigint", "items_sha256 string", "contaminated boolean"]
    want = []
    for i, t, _ in docs:
        n, hit, names = hits_by_hand(t, items, 10)
        want.append((i, n, len(hit), len(names), hashlib.sha256(",".join(names).encode()).hexdigest(), bool(hit)))
    assert sorted(map(tuple, df.collect())) == sorted(want) and any(x[2] for x in want)


# --- 13 ----------------------------------------------------------------------------------------------------------------


def codes_by_hand(rows, parts=4, entries=256, rounds=4):
    """rows of (id, vector) in order; Python integers."""
    ints = [(i, [int(np.floor(x * 1024)) for x in v]) for i, v in rows]
    width = len(ints[0][1]) // parts
    cut = lambda v, p: v[p * width : (p + 1) * width]
    books = [[cut(v, p) for _, v in ints[:entries]] for p in range(parts)]

    def near(v, book):
        return min((sum((x - y) ** 2 for x, y in zip(v, c, strict=True)), k) for k, c in enumerate(book))

    for _ in range(rounds):
        for p, book in enumerate(books):
            of = {}
            for _, v in ints:
                of.setdefault(near(cut(v, p), book)[1], []).append(cut(v, p))
            books[p] = [[sum(c) // len(of[k]) for c in zip(*of[k], strict=True)] if k in of else c for k, c in enumerate(book)]
    found = {i: [near(cut(v, p), books[p]) for p in range(parts)] for i, v in ints}
    flat = ",".join(str(x) for book in books for c in book for x in c)
    return {i: ("".join(f"{k:02x}" for _, k in f), sum(d for d, _ in f)) for i, f in found.items()}, hashlib.sha256(flat.encode()).hexdigest()


def test_codes_equal_whole_numbers(spark):
    rng = random.Random(8)
    rows = [(i, [float(np.float32(rng.choice([-1.5, 0.25, rng.gauss(0, 1)]))) for _ in range(8)]) for i in range(90)]
    rows += [(200 + i, rows[i][1]) for i in range(5)]
    odd = [(300, None), (301, [float("nan")] * 8), (302, [None] + [1.0] * 7), (303, [float("inf")] * 8), (304, []), (-1, [1.0] * 6), (305, [1.0] * 12)]
    df = spark.createDataFrame([(i, v, i % 3 or None, "x", 1) for i, v in rows + odd], "vec_id long, embedding array<float>, label int, code string, p int").repartition(5)
    coded, books = vector_codes.compress(df, entries=16)
    want, sha = codes_by_hand(rows, entries=16)
    assert {r.vec_id: (r.code, r.error) for r in coded.collect()} == want | {304: (None, None), -1: (None, None), 305: (None, None)}
    assert vector_codes.fingerprint(books) == sha
    sums = {}
    for i, (_, e) in want.items():
        sums[i % 3 or None] = sums.get(i % 3 or None, 0) + e
    assert all(r.label_error == sums[r.vec_id % 3 or None] for r in vector_codes.with_label_errors(coded).collect())


def test_few_vectors_ties_and_large_components(spark):
    frame = lambda rows: spark.createDataFrame(rows, "vec_id long, embedding array<double>, label string")
    coded, books = vector_codes.compress(frame([(2, [1.0] * 4, None), (1, [1.0] * 4, "a"), (None, [2.0] * 4, "a"), (1, [0.0] * 4, "a")]))
    assert books[0].ravel().tolist() == [0, 1024, 1024, 2048]  # the first of id 1 by its components; equal entries: the lower is used
    assert sorted((r.code, r.error) for r in coded.collect()) == [("00000000", 0), ("01010101", 0), ("01010101", 0), ("03030303", 0)]
    with pytest.raises(OverflowError):
        vector_codes.nearest(vector_codes.whole(np.full((1, 4), 3e6)), np.zeros((1, 4), np.int64))
    with pytest.raises(OverflowError):
        vector_codes.whole(np.full((1, 4), 1e300))


def test_vector_query(spark, tmp_path):
    schema = "vec_id long, label int, embedding array<float>"
    rng = random.Random(2)
    rows = [(i, i % 2 or None, [rng.gauss(0, 1) for _ in range(16)]) for i in range(40)]
    write(spark, tmp_path, {"embeddings": (rows, schema)})
    df = registry.queries()["op13_vector_codes"](spark, str(tmp_path))
    assert kinds(df) == ["vec_id bigint", "code string", "error bigint", "label_error bigint", "codebooks_sha256 string"]
    want, sha = codes_by_hand([(i, np.array(v, np.float32).tolist()) for i, _, v in rows])
    assert {r.vec_id: (r.code, r.error) for r in df.collect()} == want and {r.codebooks_sha256 for r in df.collect()} == {sha}
    write(spark, tmp_path, {"embeddings": ([], schema)})
    assert registry.queries()["op13_vector_codes"](spark, str(tmp_path)).count() == 0


# --- what earlier operators gained -------------------------------------------------------------------------------------


def test_tables_in_groups_find_the_same_mates(spark):
    rng = np.random.default_rng(5)
    codes = rng.integers(0, 1 << 62, 40, dtype=np.int64)
    codes = np.concatenate((codes, codes ^ (np.int64(1) << rng.integers(0, 60, 40))))
    frame = spark.createDataFrame([(i, int(c)) for i, c in enumerate(codes)], "rep long, code long")
    masks = [m for m, _ in zip(itq.masks(64, 9), range(7), strict=False)]
    each = [list(itq._with_mates(frame, masks, 3, group=g)) for g in (2, 16)]
    assert [len(x) for x in each] == [4, 1]
    found = [sorted(tuple(r) for part in x for r in part.collect()) for x in each]
    want = sorted((i, t, int(np.int64(np.uint64(codes[i]) & np.uint64(m)))) for t, m in enumerate(masks) for i in range(80) if any(j != i and not ((int(codes[i]) ^ int(codes[j])) & m) and (int(codes[i]) ^ int(codes[j])).bit_count() <= 3 for j in range(80)))
    assert found[0] == found[1] == want and want


def test_vectors_with_more_tables_than_a_group(spark, monkeypatch):
    """40 tables, more than are dealt out at once: the whole query, against brute force."""
    rng = np.random.default_rng(11)
    base = rng.normal(size=(300, 64))
    x = np.vstack([base, base[:100] + 0.3 * rng.normal(size=(100, 64)), base[0] + 0.1 * rng.normal(size=(50, 64))])
    monkeypatch.setattr(itq, "choose_tables", lambda *_: [m for m, _ in zip(itq.masks(64, 4), range(40), strict=False)])
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    got = {r.vec_id: r for r in itq.near_duplicates(df).collect()}
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    want = (u @ u.T >= 0.9).sum(axis=1) - 1
    found = np.array([got[i].n_links for i in range(len(x))])
    assert (found <= want).all() and found.sum() >= 0.95 * want.sum() > 2000
    assert sum(got[400 + i].component_id == 0 for i in range(50)) >= 48 and got[299].kept


@pytest.mark.parametrize("block", [7, 1024])
def test_links_of_a_bucket_in_blocks(monkeypatch, block):
    """Counts and forest of a dense bucket and of two of its chunks, without the pairs that earlier tables hold."""
    monkeypatch.setattr(itq, "BLOCK", block)
    rng = np.random.default_rng(3)
    x = np.vstack([rng.normal(size=64) + 0.1 * rng.normal(size=(220, 64)), rng.normal(size=(20, 64))])
    unit, n = x / np.linalg.norm(x, axis=1, keepdims=True), len(x)
    rep, members, earlier = np.arange(n) * 3, rng.integers(1, 4, n).astype(float), np.array([0b1111, 0b1111000], np.uint64)
    codes, chunk = rng.integers(0, 128, n).astype(np.uint64), rng.integers(0, 2, n)
    want = (unit @ unit.T >= 0.9) & (((codes[:, None] ^ codes) & earlier[0]) != 0) & (((codes[:, None] ^ codes) & earlier[1]) != 0) & ~np.eye(n, dtype=bool)
    assert np.triu(want).sum() > 15_000
    for left, right, pairs in ((chunk >= 0, chunk >= 0, want), (chunk == 0, chunk == 1, want & (chunk[:, None] != chunk))):
        count, edges = itq._links_in(rep, members, codes, unit, left, right, earlier, 0.9)
        assert (count == pairs @ members).all() and all(pairs[i, j] for i, j in edges)
        assert len(edges) == 219 and len({i for e in edges for i in e}) == 220  # one tree


def test_sketches_leave_chance_mates_out():
    """Of random vectors whose codes agree in the bits of a table, few are as near by their sketches as links are; by their codes many."""
    rng = np.random.default_rng(5)
    u = rng.normal(size=(20_000, 64))
    u /= np.linalg.norm(u, axis=1, keepdims=True)
    mean, projection = itq.learn(u, 64)
    sketching = itq.learn(u, itq.SKETCH, rounds=0, seed=6)[1]
    codes, near = itq.encode(u, mean, projection), []
    order = np.argsort(codes & np.uint64((1 << 10) - 1))
    i, j = (np.concatenate([order[k:] if side else order[:-k] for k in range(1, 6)]) for side in (0, 1))
    i, j = (x[((codes[i] ^ codes[j]) & np.uint64((1 << 10) - 1)) == 0] for x in (i, j))
    for bits in (projection, sketching):
        differ = sum(np.bitwise_count(encoded[i] ^ encoded[j]).astype(int) for encoded in (itq.encode(u, mean, part) for part in itq.words(bits)))
        near.append((differ <= itq.farthest(u, mean, bits, 0.9)).mean())
    assert len(i) > 50_000 and near[0] > 0.003 and near[1] < 0.0003


def test_sample_is_that_of_the_smallest_hashes(spark):
    frame = spark.range(3000).selectExpr("xxhash64(id) h1", "xxhash64(id, 7) h2", "array(float(id), 1f) embedding")
    want = np.array([r.embedding for r in frame.orderBy("h1").limit(100).collect()])
    assert np.allclose(itq._sample(frame, 2, 3000, 100), want / np.linalg.norm(want, axis=1, keepdims=True))


def test_written_tables_go_with_their_scope(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(common, "shared_folder", lambda _: f"file://{tmp_path}")
    stays = common.written(spark.range(3))
    with common.scratch(spark):
        with common.scratch(spark):
            common.written(spark.range(4))
        assert len(list(tmp_path.glob("table-*"))) == 1
        common.written(spark.range(5))
        assert len(list(tmp_path.glob("table-*"))) == 2
    assert len(list(tmp_path.glob("table-*"))) == 1 and stays.count() == 3


def test_both_ways_of_a_dense_group_give_the_same_components(spark):
    rng = np.random.default_rng(12)
    base = rng.integers(0, 1 << 62, 6)
    near = [int(b) ^ sum(1 << int(k) for k in rng.choice(62, rng.integers(0, 5), replace=False)) for b in base for _ in range(60)]
    frame = spark.createDataFrame([(i, f) for i, f in enumerate(sorted(set(near)))], "node long, fp long")
    found = [sorted(map(tuple, components.components(simhash.links(frame, bucket=b)).collect())) for b in (1, 8, 10**9)]
    assert found[0] == found[1] == found[2] and len(found[0]) > 100
