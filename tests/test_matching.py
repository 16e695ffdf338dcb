import numpy as np
from conftest import rows

from pyspark.sql import functions as F

from speechgrain.operators import cluster, matching

CAND = "candidate_id long, provider string, model string, embedding array<double>"
PROF = "profile_id string, display_name string, provider string, model string, embedding array<double>"


def decide(spark, profiles, threshold, margin, candidate=(1.0, 0.0)):
    c = spark.createDataFrame([(1, "p", "m", list(candidate) if candidate else None)], CAND)
    p = spark.createDataFrame([(i, i.upper(), prov, "m", e) for i, prov, e in profiles], PROF)
    return rows(matching.best(c, p, threshold, margin).select("profile_id", "status")), rows(matching.skipped(c, p).select("profile_id", "reason"), "profile_id")


def test_decisions(spark):
    assert decide(spark, [("a", "p", [1.0, 0.0]), ("b", "p", [0.0, 1.0])], 0.5, 0.1)[0] == [("a", "matched")]
    assert decide(spark, [("a", "p", [0.1, 0.995])], 0.9, 0.05)[0] == [("a", "below_threshold")]
    assert decide(spark, [("a", "p", [1.0, 0.01]), ("b", "p", [1.0, 0.011])], 0.5, 0.5)[0] == [("a", "ambiguous")]
    assert decide(spark, [("a", "q", [1.0, 0.0])], 0.5, 0.05) == ([], [("a", "provider_model_mismatch")])
    assert decide(spark, [("a", "p", [1.0]), ("b", "p", []), ("c", "p", None)], 0.5, 0.05) == ([], [("a", "embedding_dimension_mismatch"), ("b", "missing_embedding"), ("c", "missing_embedding")])
    assert decide(spark, [("a", "p", [1.0, 0.0])], 0.5, 0.05, None) == ([], [])
    assert decide(spark, [("a", "p", [0.0, 0.0])], 0.0, 0.0)[0] == [("a", "matched")]  # a zero vector scores 0


def test_one_profile_one_speaker(spark):
    s = spark.createDataFrame(
        [(1, "0", True, "a", "Ana", 0.95, 0.2, "matched"), (1, "1", True, "a", "Ana", 0.85, 0.2, "matched"), (1, "2", False, None, None, None, None, None), (1, "3", True, None, None, None, None, None), (1, "4", True, "b", "Ben", 0.5, 0.1, "below_threshold")],
        "session_id long, speaker_id string, extracted boolean, profile_id string, display_name string, confidence double, margin double, status string",
    )
    got = rows(matching.resolve(s).select("speaker_id", "label", "status"), "speaker_id")
    assert got == [("0", "Ana", "matched"), ("1", "Speaker 1", "duplicate_profile_match"), ("2", "Speaker 2", "too_short"), ("3", "Speaker 3", "no_comparable_profiles"), ("4", "Speaker 4", "below_threshold")]
    assert {r.status for r in matching.resolve(s, has_profiles=False).collect()} == {"no_profiles"}


def test_groups(spark):
    m = spark.createDataFrame([(1, "0", "a", "Ana", 0.9, "matched"), (1, "1", "a", "Ana", 0.8, "matched"), (1, "2", "b", "Ben", 0.9, "matched"), (1, "2", "a", "Ana", 0.9, "matched"), (1, "3", "a", "Ana", 0.1, "ambiguous")], "session_id long, speaker_id string, profile_id string, display_name string, confidence double, status string")
    assert rows(matching.duplicate_groups(m).select("profile_id", "speaker_ids")) == [("a", ["0", "1", "2"])]
    assert rows(matching.mixed_clusters(m).select("speaker_id", "profile_ids")) == [("2", ["a", "b"])]


def test_name_lookup(spark):
    p = spark.createDataFrame([("1", "Ana"), ("2", "ana "), ("3", "Ben")], "profile_id string, display_name string")
    asked = spark.createDataFrame([(" ANA",), ("ben",), ("cy",), ("Ben",)], "name string")
    assert rows(matching.profile_by_name(asked, p).select("name", "status"), "name") == [(" ANA", "ambiguous"), ("Ben", "ok"), ("ben", "ok"), ("cy", "not_found")]
    assert rows(matching.name_taken(asked, p)) == [("Ben",)]


def test_linkage_examples():
    v, w = [1.0, 0.0], [0.0, 1.0]
    assert cluster.linkage_labels(np.array([v, v, w, w]), 2).tolist() == [0, 0, 1, 1]
    assert cluster.linkage_labels(np.array([w, v, v, w]), distance=0.5).tolist() == [0, 1, 1, 0]
    assert cluster.linkage_labels(np.array([v, v, v, v]), 1).tolist() == [0, 0, 0, 0]
    assert len(set(cluster.linkage_labels(np.array([v, v, w, w]), 3).tolist())) == 2
    assert cluster.linkage_labels(np.zeros((0, 2))).tolist() == [] and cluster.linkage_labels(np.array([v])).tolist() == [0]
    assert cluster.linkage_labels(np.array([v, [0.0, 0.0]]), distance=0.1).tolist() == [0, 0]  # a zero vector is at distance 0


def distances(x):
    size = np.linalg.norm(x, axis=1)
    d = np.array([[1 - min(max(a @ b / (p * q), -1), 1) if p * q else 0.0 for b, q in zip(x, size, strict=True)] for a, p in zip(x, size, strict=True)])
    np.fill_diagonal(d, 0)
    return d


def naive(x, cut):
    d = distances(x)
    groups = [[i] for i in range(len(x))]
    while len(groups) > 1:
        h, i, j = min((np.mean([d[a, b] for a in p for b in q]), i, j) for i, p in enumerate(groups) for j, q in enumerate(groups) if i < j)
        if h > cut:
            break
        groups[i] += groups.pop(j)
    return {frozenset(g) for g in groups}


def test_linkage_equals_the_plain_algorithm():
    rng = np.random.default_rng(1)
    for _ in range(20):
        x = rng.normal(size=(rng.integers(2, 25), 5))
        labels = cluster.linkage_labels(x, distance=0.7)
        assert {frozenset(np.flatnonzero(labels == k).tolist()) for k in set(labels.tolist())} == naive(x, 0.7)


def test_linkage_with_zero_vectors_ties_and_forced_numbers():
    rng = np.random.default_rng(4)
    for k in range(20):
        x = rng.normal(size=(rng.integers(3, 30), 4))
        x[rng.random(len(x)) < 0.15] = 0
        labels = cluster.linkage_labels(x, distance=0.6)
        assert {frozenset(np.flatnonzero(labels == i).tolist()) for i in set(labels.tolist())} == naive(x, 0.6)
        x = x[rng.integers(0, len(x), len(x))]
        labels = cluster.linkage_labels(x, distance=0.4)
        assert {frozenset(np.flatnonzero(labels == i).tolist()) for i in set(labels.tolist())} == naive(x, 0.4)
        heights = sorted(h for *_, h in cluster.merge_heights(x))
        assert len(heights) == len(x) - 1
        for n in (1, 2, len(x)):
            assert len(set(cluster.linkage_labels(x, n).tolist())) <= n
    assert cluster.linkage_labels(np.repeat(rng.normal(size=(3, 7)), 40, axis=0), distance=0.05).max() == 2


def test_copies_and_far_vectors_cost_no_rounds(monkeypatch):
    rng = np.random.default_rng(6)
    searched = []
    nearest = cluster.Sums.nearest
    monkeypatch.setattr(cluster.Sums, "nearest", lambda self, rows: searched.append(len(rows)) or nearest(self, rows))
    one = rng.normal(size=8)
    x = np.concatenate([np.tile(one, (3000, 1)), rng.normal(size=(20, 8)), np.zeros((50, 8)), np.full((1, 8), -0.0)])
    x = x[rng.permutation(len(x))]
    labels = cluster.linkage_labels(x, distance=0.3)
    copies = (x == one).all(axis=1)
    assert len(set(labels[copies].tolist())) == 1 and len(set(labels[(x == 0).all(axis=1)].tolist())) == 1
    assert searched[0] == 22 and sum(searched) < 100
    searched.clear()
    alone = np.eye(300)  # all at distance 1
    assert cluster.linkage_labels(alone, distance=0.5).tolist() == list(range(300)) and searched == [300]
    assert cluster.merge_heights(x[:5], highest=-1) == [] and cluster.linkage_labels(np.zeros((3, 0))).tolist() == [0, 0, 0]


def test_a_long_recording_takes_memory_in_proportion(monkeypatch):
    import tracemalloc

    rng = np.random.default_rng(0)
    n = 20_000
    voices = rng.normal(size=(40, 32))
    x = voices[rng.integers(0, 40, n)] + 0.3 * rng.normal(size=(n, 32))
    tracemalloc.start()
    labels = cluster.linkage_labels(x, distance=0.4)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert labels.max() == 39 and peak < 200e6  # a matrix of pairs would take 3.2 GB


def test_best_equals_all_scores_for_profiles_in_blocks(spark):
    rng = np.random.default_rng(3)
    c = [(i, rng.choice(["p", "q"]), "m", v) for i, v in enumerate(rng.normal(size=(60, 6)).round(2).tolist())] + [(100, "p", "m", [0.0] * 6), (101, "p", "m", None), (102, "z", "m", [1.0]), (103, None, "m", [1.0] * 6), (104, "p", "m", [None] * 6), (105, "p", "m", [1.0])]
    p = [(f"{i:03}", f"N{i % 7}", rng.choice(["p", "q"]), "m", v) for i, v in enumerate(rng.normal(size=(40, 6)).round(2).tolist())]
    p += [("900", "same", "p", "m", p[0][4]), ("000a", "same", "p", "m", p[0][4]), ("901", None, "p", "m", [2.0]), ("902", "n", "p", "m", [None] * 6), ("903", "n", "p", "m", []), ("904", "n", None, "m", [1.0] * 6)]
    c += [(200, "p", "m", p[0][4]), (201, "q", "m", p[0][4])]
    cf, pf = spark.createDataFrame(c, CAND).repartition(3), spark.createDataFrame(p, PROF).repartition(3)
    want = {}
    for r in matching.scores(cf, pf.where("profile_id <> '902'")).where("candidate_id <> 104").collect():
        want.setdefault(r.candidate_id, []).append((-round(r.score, 9), r.profile_id, r.display_name))
    want = sorted((i, s[0][1], s[0][2], -s[0][0], round(-s[0][0] + (s[1][0] if len(s) > 1 else 0), 9)) for i, s in ((i, sorted(s)) for i, s in want.items()))
    for options in ({}, {"cells": 3, "block": 5}, {"cells": 3, "block": 1000}):
        got = [(*r[:3], round(r[3], 9), round(r[4], 9)) for r in rows(matching.best(cf, pf, -2.0, -9.0, **options), "candidate_id")]
        assert [r[:2] for r in got] == [r[:2] for r in want] and np.allclose([r[3:] for r in got], [r[3:] for r in want], atol=1e-8)
    assert matching.best(cf.where("false"), pf).count() == 0 and matching.best(cf, pf.where("false")).count() == 0


def test_diarize_labels_every_segment(spark):
    seg = [(1, 0, 0, 40_000, "a"), (1, 1, 40_000, 40_500, "b"), (1, 2, 41_000, 80_000, "c"), (1, 3, 80_000, 82_000, "d")]
    s = spark.createDataFrame([(*r, None) for r in seg], "session_id long, seg_idx long, start_ms long, end_ms long, text string, speaker_id string")
    v = spark.createDataFrame([(1, 0, [1.0, 0.0]), (1, 2, [0.0, 1.0]), (1, 3, [0.6, 0.8])], "session_id long, seg_idx long, embedding array<double>")
    out = cluster.diarize(s, v, distance=0.1)
    assert [r.assigned_id for r in out.orderBy("seg_idx").collect()] == ["0", "0", "1", "1"]  # the 2 s cluster joins the nearest
    assert [r.assigned_id for r in cluster.diarize(s, v, distance=0.1, id_offset=2).orderBy("seg_idx").collect()] == ["2", "2", "3", "3"]
    assert cluster.track_offsets(out).first().id_offset == 2
    assert cluster.centroids(v.withColumn("k", F.lit(1)), ["k"]).count() == 1
