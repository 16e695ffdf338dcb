"""Diarisation: average-linkage clustering by sums of vectors, merging of tiny clusters, and labels for every segment."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from speechgrain.functions.vectors import dot, norm
from speechgrain.operators.segments import clusterable
from speechgrain.operators.speakers import fill_labels, sequential_labels
from speechgrain.sources.files import stored

DISTANCE, TINY_MS = 0.40, 30_000
ROUNDING = 1e-9  # of a distance between two clusters


class Sums:
    """Clusters as sums of unit vectors: the mean similarity of two is the product of their sums over the product of their sizes.

    A zero vector is at similarity 1 to all, so ``zeros`` counts those of a cluster apart. Memory is that of the sums.
    """

    def __init__(self, x: np.ndarray):
        lengths = np.linalg.norm(x, axis=1)
        self.sums = x / np.where(lengths > 0, lengths, 1.0)[:, None]
        self.zeros, self.sizes = (lengths == 0).astype(float), np.ones(len(x))

    def fold_copies(self) -> tuple[np.ndarray, np.ndarray]:
        """Makes a cluster of each group of equal vectors: (the first rows of the groups, for each row the first of its group)."""
        keys = np.hstack([self.sums + 0.0, self.zeros[:, None]])  # -0.0 and 0.0 are equal
        _, first, group, count = np.unique(keys.view(f"V{keys.shape[1] * keys.itemsize}").ravel(), return_index=True, return_inverse=True, return_counts=True)
        order = np.argsort(first)
        self.keep(first[order])
        for values in (self.sums.T, self.zeros, self.sizes):
            values *= count[order]
        return first[order], first[group]

    def sides(self) -> tuple[np.ndarray, np.ndarray]:
        """Two matrices of a row for each cluster; the product of a row of either is the mean similarity of two clusters."""
        mean = self.sums / self.sizes[:, None]
        if not self.zeros.any():
            return mean, mean
        w = (self.zeros / self.sizes)[:, None]  # the share of zero vectors: all pairs but those without any add 1
        return np.hstack([mean, w, 1 - w]), np.hstack([mean, np.ones_like(w), w])

    def nearest(self, rows: np.ndarray, height: int = 512, width: int = 2048) -> tuple[np.ndarray, np.ndarray]:
        """(the nearest other cluster of each of ``rows``, its distance), ``height`` by ``width`` similarities at a time; ties to the lower number."""
        left, right = self.sides()
        at, best = np.zeros(len(rows), np.int64), np.full(len(rows), -np.inf)
        for k in range(0, len(rows), height):
            part = rows[k : k + height]
            own, some = np.arange(len(part)), left[part]
            for first in range(0, len(right), width):
                s = some @ right[first : first + width].T
                here = (part >= first) & (part < first + s.shape[1])
                s[own[here], part[here] - first] = -np.inf
                place = s.argmax(axis=1)
                found = s[own, place]
                more = found > best[k : k + height]
                at[k : k + height][more], best[k : k + height][more] = place[more] + first, found[more]
        return at, 1.0 - np.clip(best, -1.0, 1.0)

    def join(self, into: np.ndarray, gone: np.ndarray) -> None:
        for values in (self.sums, self.zeros, self.sizes):
            values[into] += values[gone]

    def keep(self, alive: np.ndarray) -> None:
        self.sums, self.zeros, self.sizes = self.sums[alive], self.zeros[alive], self.sizes[alive]


def merge_heights(x: np.ndarray, highest: float = np.inf) -> list[tuple[int, int, float]]:
    """Average-linkage merges of the vectors ``x`` (a member of each side, height), up to height ``highest``.

    In a round all pairs of clusters that are each other's nearest are merged; no merge brings a cluster nearer to a third than
    the nearer of its parts was, so these are the merges that would be made one at a time. Nearest clusters are looked for
    anew only where the known one was merged. A cluster whose nearest is above ``highest`` will merge no more and is left out.
    Equal vectors are one cluster from the start, at height 0.
    """
    if len(x) < 2 or highest < 0:
        return []
    clusters = Sums(np.asarray(x, float))
    name, first = clusters.fold_copies()
    out = [(int(k), int(first[k]), 0.0) for k in np.flatnonzero(first != np.arange(len(x)))]
    if len(name) < 2:
        return out
    near, far = clusters.nearest(np.arange(len(name)))
    while len(name) > 1:
        all_ = np.arange(len(name))
        pairs = all_[(near[near] == all_) & (all_ < near) & (far <= highest)]
        if not len(pairs):
            least = int(far.argmin())  # rounding can part the nearest two of equals
            if far[least] > highest:
                break
            pairs = np.array([min(least, near[least])])
            near[pairs[0]] = max(least, near[least])
        mates = near[pairs]
        out += zip(name[mates].tolist(), name[pairs].tolist(), np.minimum(far[pairs], far[mates]).tolist(), strict=True)
        clusters.join(pairs, mates)
        alive, touched = far <= highest + ROUNDING, np.zeros(len(name), bool)
        touched[pairs] = touched[mates] = True
        touched |= ~alive
        alive[mates] = False
        again = (touched | touched[near])[alive]
        place = np.cumsum(alive) - 1
        clusters.keep(alive)
        name, near, far = name[alive], place[near][alive], far[alive]
        if len(name) > 1:
            near[again], far[again] = clusters.nearest(np.flatnonzero(again))
    return out


def linkage_labels(x: np.ndarray, n_clusters: int | None = None, distance: float = DISTANCE) -> np.ndarray:
    """Cluster numbers from 0 by first appearance: at most ``n_clusters``, or all merges up to ``distance``.

    Merges of equal height happen together, so a forced number can end in fewer clusters.
    """
    n = len(x)
    if n < 2:
        return np.zeros(n, int)
    merges = merge_heights(x, np.inf if n_clusters is not None else distance)
    heights = sorted(h for _, _, h in merges)
    if n_clusters is None:
        cut = distance
    else:
        wanted = n - max(1, min(int(n_clusters), n))
        cut = heights[wanted - 1] if wanted else -np.inf
    parent = list(range(n))

    def find(i: int) -> int:
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    for a, b, h in merges:
        if h <= cut:
            parent[find(a)] = find(b)
    seen: dict[int, int] = {}
    return np.array([seen.setdefault(find(i), len(seen)) for i in range(n)])


def cluster(vectors: DataFrame, by: tuple[str, ...] = ("session_id",), n_clusters: int | None = None, distance: float = DISTANCE) -> DataFrame:
    """``vectors(*by, seg_idx, embedding)`` with ``cluster`` for each recording.

    A recording's clips are held in one task as sums of vectors, never as a matrix of pairs, so memory grows with its length;
    time grows with the square of it, in products of matrices.
    """

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("seg_idx", kind="stable")
        labels = linkage_labels(np.stack(pdf["embedding"].to_numpy()).astype(float), n_clusters, distance)
        return pdf[[*by, "seg_idx"]].assign(cluster=labels.astype(str))

    kinds = dict(vectors.dtypes)
    out = vectors.groupBy(*by).applyInPandas(run, ", ".join(f"{c} {kinds[c]}" for c in (*by, "seg_idx")) + ", cluster string")
    return vectors.join(out, [*by, "seg_idx"])


def centroids(rows: DataFrame, by: list[str]) -> DataFrame:
    """The mean vector of each group, scaled to length 1 (a zero mean stays)."""
    parts = rows.select(*by, F.posexplode("embedding").alias("_i", "_x")).groupBy(*by, "_i").agg(F.avg(F.col("_x").cast("double")).alias("_m"))
    mean = parts.groupBy(*by).agg(F.transform(F.array_sort(F.collect_list(F.struct("_i", "_m"))), lambda s: s["_m"]).alias("_c")).withColumn("_n", norm(F.col("_c")))
    return mean.select(*by, F.when(F.col("_n") > 0, F.transform("_c", lambda v: v / F.col("_n"))).otherwise(F.col("_c")).alias("centroid"))


def nearest_large(rows: DataFrame, tiny_ms: int = TINY_MS, by: str = "session_id") -> DataFrame:
    """For each cluster with less speech than ``tiny_ms`` the nearest one with as much or more: (by, cluster, target).

    ``rows(by, cluster, duration_ms, embedding)``. Sessions without a large cluster have none. Ties go to the lower number.
    """
    totals = rows.groupBy(by, "cluster").agg(F.sum("duration_ms").alias("_ms"))
    c = centroids(rows, [by, "cluster"]).join(totals, [by, "cluster"])
    tiny = c.where(F.col("_ms") < tiny_ms).select(by, "cluster", F.col("centroid").alias("_a"))
    large = c.where(F.col("_ms") >= tiny_ms).select(by, F.col("cluster").alias("target"), F.col("centroid").alias("_b"))
    scored = tiny.join(large, by).withColumn("similarity", dot(F.col("_a"), F.col("_b")))
    order = W.partitionBy(by, "cluster").orderBy(F.desc("similarity"), F.col("target").try_cast("int"), "target")
    return scored.withColumn("_r", F.row_number().over(order)).where("_r = 1").select(by, "cluster", "target", "similarity")


def merge_tiny(rows: DataFrame, tiny_ms: int = TINY_MS, by: str = "session_id") -> DataFrame:
    """``cluster`` with tiny clusters moved into their nearest large one, numbered by first appearance."""
    moved = rows.join(nearest_large(rows, tiny_ms, by).select(by, "cluster", "target"), [by, "cluster"], "left").withColumn("cluster", F.coalesce("target", "cluster")).drop("target")
    numbered = sequential_labels(moved, by, "cluster")
    return numbered.withColumn("cluster", F.col("label_no").cast("string")).drop("label_no")


def diarize(segments: DataFrame, vectors: DataFrame, n_clusters: int | None = None, distance: float = DISTANCE, min_ms: int = 1000, tiny_ms: int = TINY_MS, id_offset: int = 0) -> DataFrame:
    """``segments`` with ``assigned_id`` for every row, from embeddings of the clusterable ones.

    ``vectors(session_id, seg_idx, embedding)``. Ids start at ``id_offset``, so that a second track doesn't reuse the first's.
    The clusters are written once to the shared folder, since several steps look at them.
    """
    fit = segments.where(clusterable(min_ms)).select("session_id", "seg_idx", (F.col("end_ms") - F.col("start_ms")).alias("duration_ms"))
    found = stored(cluster(fit.join(vectors, ["session_id", "seg_idx"]), n_clusters=n_clusters, distance=distance), "clusters")
    if n_clusters is None:
        found = merge_tiny(found, tiny_ms)
    labels = found.select("session_id", "seg_idx", F.col("cluster").alias("speaker_id"))
    out = fill_labels(segments.drop("speaker_id").join(labels, ["session_id", "seg_idx"], "left")).drop("speaker_id")
    return out.withColumn("assigned_id", (F.col("assigned_id").cast("int") + id_offset).cast("string"))


def track_offsets(mic: DataFrame) -> DataFrame:
    """Per session the number of speakers on the first track: where the ids of the second begin."""
    return mic.groupBy("session_id").agg(F.count_distinct("assigned_id").alias("id_offset"))
