"""Document quality from a linear-chain conditional random field over lines.

Each line is good or bad. Its features are its own figures and those of the lines before and after it; one weight per
pair of neighbouring labels ties lines together. The field is trained on a bounded sample (``PER_CLASS`` labelled documents
of each class with up to ``TRAIN_LINES`` lines; a line has its document's label) by the exact gradient of the conditional
likelihood. A document's score is the mean of the forward-backward marginals of "good", weighted by line length, and mapped
so that the best training cut lies at 0.3.

Defined cases: a null or empty text is one empty line; blank lines have weight 1 like a line of one character; without
labels of both classes every score is 0.5; repeated rows and ties are scored alike; null ids aren't held out; extra columns
are ignored; an empty table gives an empty table. Features are made for ``BLOCK`` lines at a time, so a very long text of n
lines takes, beside its lines, some 150 bytes a line.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table
from .labelled import held_out, sample

PER_CLASS, TRAIN_LINES = 1500, 400
CUT = 0.3
SYMBOLS = "#*$%&|<>"
OWN = 18
BLOCK = 4096


def shares(line: str, low: str) -> tuple[float, float]:
    """Shares of all characters of a line that lower-casing changes, and that are digits. ``low`` is the lower-cased line."""
    n = len(line)
    if len(low) != n:  # U+0130 alone grows
        low = line.replace("\u0130", "i").lower()
    if n < 256:  # the same figures, sooner for short lines
        return 1 - sum(map(str.__eq__, line, low)) / n, sum(map(str.isdigit, line)) / n
    codes, lower = (np.frombuffer(s.encode("utf-32-le", "surrogatepass"), "<u4") for s in (line, low))
    digits = np.count_nonzero((codes >= 48) & (codes <= 57))
    other, times = np.unique(codes[codes > 127], return_counts=True)
    digits += sum(k for c, k in zip(other.tolist(), times.tolist(), strict=True) if chr(c).isdigit())
    return 1 - np.count_nonzero(codes == lower) / n, digits / n


def line_features(lines: list[str], seen: set[int] | None = None) -> np.ndarray:
    """``OWN`` figures of each line; ``seen`` has the hashes of the lower-cased lines before them and gets theirs."""
    out = np.zeros((len(lines), OWN))
    seen = set() if seen is None else seen
    for row, line in zip(out, lines, strict=True):
        words = line.split()
        n, chars = len(words), len(line)
        row[0] = 1.0
        if not n:
            row[1] = 1.0
            continue
        low = line.lower()
        spaces = chars - sum(map(len, words))
        marks = sum(map(line.count, SYMBOLS))
        stops = line.count(".")
        row[2] = min(marks / n, 2.0)
        row[3] = marks > 0
        row[4] = min(line.count("!") / n, 2.0)
        row[5] = min(line.count(" | ") / n, 1.0)
        row[6], row[11] = shares(line, low)
        row[7] = row[6] > 0.5
        distinct = len(set(words))
        row[8] = 1 - distinct / n
        row[9] = sum(a == b for a, b in zip(words, words[1:], strict=False)) / n
        row[10] = min((chars - spaces) / n / 10, 3.0)
        row[12] = min(stops / n, 1.0)
        row[13] = line[-1] in ".!?\"'"
        row[14] = math.log1p(n) / 5
        row[15] = hash(low) in seen
        row[16] = n == 1
        row[17] = max(map(len, words)) > 30
        seen.add(hash(low))
    return out


def with_neighbours(own: np.ndarray) -> np.ndarray:
    """Own features, and those of the line before and after (zeros at the ends)."""
    zero = np.zeros((1, own.shape[1]))
    return np.hstack([own, np.vstack([zero, own[:-1]]), np.vstack([own[1:], zero])])


def emissions(lines: list[str], weights: np.ndarray) -> np.ndarray:
    """The emission score of each line: its own figures and its neighbours', each times their weights."""
    own, before, after = weights.reshape(3, OWN)
    out, seen = np.zeros(len(lines)), set()
    for k in range(0, len(lines), BLOCK):
        figures = line_features(lines[k : k + BLOCK], seen)
        end = k + len(figures)
        out[k:end] += figures @ own
        out[k + 1 : end + 1] += (figures @ before)[: len(out) - k - 1]
        out[max(k - 1, 0) : end - 1] += (figures @ after)[0 if k else 1 :]
    return out


def marginals(emission: np.ndarray, chain: np.ndarray) -> tuple[np.ndarray, np.ndarray, float]:
    """For emission scores of "good" (those of "bad" are 0) and 2x2 chain weights: P(good) by line, expected label pairs,
    and the log partition."""
    n, e = len(emission), np.exp(chain)
    # each message is kept as a share of its sum; the logarithms of the sums add up to the partition
    good = np.exp(np.clip(emission, -50, 50))
    ahead, log_z = np.zeros((n, 2)), 0.0
    a0, a1 = 1.0, good[0]
    e00, e01, e10, e11 = e.ravel().tolist()
    for k in range(0, n, BLOCK):
        for t, g in enumerate(good[k : k + BLOCK].tolist(), k):
            if t:
                a0, a1 = a0 * e00 + a1 * e10, (a0 * e01 + a1 * e11) * g
            s = a0 + a1
            a0, a1 = a0 / s, a1 / s
            log_z += math.log(s)
            ahead[t] = a0, a1
    back = np.zeros((n, 2))
    b0 = b1 = 1.0
    back[n - 1] = 1.0
    for t in range(n - 1, 0, -1):
        g1 = float(good[t]) * b1
        b0, b1 = e00 * b0 + e01 * g1, e10 * b0 + e11 * g1
        s = b0 + b1
        b0, b1 = b0 / s, b1 / s
        back[t - 1] = b0, b1
    both = ahead * back
    p = both[:, 1] / both.sum(axis=1)
    pairs = np.zeros((2, 2))
    if n > 1:
        joint = ahead[:-1, :, None] * e[None] * (np.stack([np.ones(n - 1), good[1:]], axis=1) * back[1:])[:, None, :]
        pairs = (joint / joint.sum(axis=(1, 2), keepdims=True)).sum(axis=0)
    return p, pairs, log_z


class Likelihood:
    """Gradient of the weighted conditional log-likelihood of documents whose lines all have the document's label, negated.

    Own features are held once; those of neighbours are the same rows, moved by one line within their document.
    """

    def __init__(self, docs: list[np.ndarray], y: np.ndarray, penalty: float):
        self.penalty, self.y = penalty, y
        self.sizes = np.array([len(d) for d in docs])
        self.own, self.of = np.vstack(docs), np.repeat(np.arange(len(docs)), self.sizes)
        self.begin = np.cumsum(self.sizes) - self.sizes
        self.follows = np.append(self.of[1:] == self.of[:-1], False)  # the next line is of the same document
        self.weight = np.where(y == 1, 0.5 / max(y.sum(), 1), 0.5 / max((1 - y).sum(), 1)) / self.sizes.mean()
        self.order = np.argsort(-self.sizes, kind="stable")
        self.seen = np.zeros((2, 2))
        for k in (0, 1):
            self.seen[k, k] = ((self.sizes - 1) * self.weight * (y == k)).sum()

    def _to_next(self, x: np.ndarray) -> np.ndarray:
        return np.append(0.0, np.where(self.follows, x, 0.0)[:-1])

    def _to_last(self, x: np.ndarray) -> np.ndarray:
        return np.where(self.follows, np.append(x[1:], 0.0), 0.0)

    def gradient(self, theta: np.ndarray) -> np.ndarray:
        own, before, after = theta[:-4].reshape(3, OWN)
        emission = self.own @ own + self._to_next(self.own @ before) + self._to_last(self.own @ after)
        p, pairs = _batch(emission, theta[-4:].reshape(2, 2), self.begin[self.order], self.sizes[self.order])
        by_doc = pairs[np.argsort(self.order)] * self.weight[:, None, None]
        miss = (p - self.y[self.of]) * self.weight[self.of]
        by_feature = [self.own.T @ x for x in (miss, self._to_last(miss), self._to_next(miss))]
        return np.concatenate([*by_feature, (by_doc.sum(axis=0) - self.seen).ravel()]) + self.penalty * theta


def fit(docs: list[np.ndarray], y: np.ndarray, rounds: int = 120, penalty: float = 1e-3) -> tuple[np.ndarray, np.ndarray]:
    """Emission weights and chain weights from own-feature matrices and a label for each, by Adam steps."""
    loss = Likelihood(docs, y, penalty)
    theta, m, v = (np.zeros(3 * OWN + 4) for _ in range(3))
    for t in range(1, rounds + 1):
        g = loss.gradient(theta)
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        theta = theta - 0.1 * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
    return theta[:-4], theta[-4:].reshape(2, 2)


def _batch(emission: np.ndarray, chain: np.ndarray, begin: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """``marginals`` of many chains at once, longest first."""
    e, good = np.exp(chain), np.exp(np.clip(emission, -50, 50))
    ahead, back, pairs = np.zeros((len(emission), 2)), np.ones((len(emission), 2)), np.zeros((len(sizes), 2, 2))
    live = [int(np.searchsorted(-sizes, -t, side="left")) for t in range(int(sizes[0]))]  # chains longer than t
    state = np.ones((len(sizes), 2))
    for t, k in enumerate(live):
        at = begin[:k] + t
        state = state[:k] if t == 0 else state[:k] @ e
        state = state * np.stack([np.ones(k), good[at]], axis=1)
        state /= state.sum(axis=1, keepdims=True)
        ahead[at] = state
    message = np.ones((len(sizes), 2))
    for t in range(len(live) - 1, 0, -1):
        k = live[t]
        at = begin[:k] + t
        right = np.stack([message[:k, 0], good[at] * message[:k, 1]], axis=1)
        joint = ahead[at - 1][:, :, None] * e[None] * right[:, None, :]
        pairs[:k] += joint / joint.sum(axis=(1, 2), keepdims=True)
        new = right @ e.T
        message[:k] = new / new.sum(axis=1, keepdims=True)
        back[at - 1] = message[:k]
    both = ahead * back
    return both[:, 1] / both.sum(axis=1), pairs


def goodness(text: str | None, weights: np.ndarray, chain: np.ndarray) -> float:
    """Length-weighted mean of P(good) over the lines of a text."""
    lines = (text or "").split("\n")
    p, _, _ = marginals(emissions(lines, weights), chain)
    return float(np.average(p, weights=[max(len(s), 1) for s in lines]))


def _best_cut(raw: np.ndarray, y: np.ndarray) -> float:
    """The cut with the best balanced accuracy, halfway between two scores."""
    order = np.argsort(raw, kind="stable")
    s, k = raw[order], y[order]
    below_bad, below_good = np.cumsum(k == 0) / max((k == 0).sum(), 1), np.cumsum(k == 1) / max((k == 1).sum(), 1)
    gain = np.where(np.append(np.diff(s) > 0, False), below_bad - below_good, -1)
    best = int(np.argmax(gain))
    return float(np.clip((s[best] + s[min(best + 1, len(s) - 1)]) / 2, 1e-6, 1 - 1e-6))


def to_score(raw: float, cut: float) -> float:
    """Moves ``cut`` to CUT on the scale of log-odds."""
    raw = min(max(raw, 1e-9), 1 - 1e-9)
    z = math.log(raw / (1 - raw)) - math.log(cut / (1 - cut)) + math.log(CUT / (1 - CUT))
    return 1 / (1 + math.exp(-z))


def train(docs: DataFrame, labels: DataFrame, column: str = "quality", per_class: int = PER_CLASS):
    """(weights, chain, cut), or None without labels of both classes."""

    def features(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            split = [(t or "").split("\n") for t in batch["text"]]
            kept = [i for i, s in enumerate(split) if len(s) <= TRAIN_LINES]
            part = batch.iloc[kept]
            yield pd.DataFrame({
                "doc_id": part["doc_id"], "label": part["label"], "found": [line_features(split[i]).astype("<f4").tobytes() for i in kept],
                "sizes": [np.array([max(len(s), 1) for s in split[i]], "<i4").tobytes() for i in kept],
            })

    rows = sample(docs, labels, column, per_class).mapInPandas(features, "doc_id long, label int, found binary, sizes binary").collect()
    rows = sorted(rows, key=lambda r: (r.doc_id, len(r.found)))
    y = np.array([r.label for r in rows], dtype=np.int64)
    if len(y) == 0 or y.min() == y.max():
        return None
    own = [np.frombuffer(r.found, "<f4").reshape(-1, OWN) for r in rows]
    weights, chain = fit(own, y)
    raw = np.array([np.average(marginals(with_neighbours(o) @ weights, chain)[0], weights=np.frombuffer(r.sizes, "<i4")) for o, r in zip(own, rows, strict=True)])
    return weights, chain, _best_cut(raw, y)


def score_documents(docs: DataFrame, model) -> DataFrame:
    """``(doc_id, score)`` for every row; 0.5 without a model."""
    if model is None:
        return docs.select("doc_id", F.lit(0.5).alias("score"))
    shared = docs.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("double")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        weights, chain, cut = shared.value
        for texts in batches:
            yield pd.Series([to_score(goodness(t, weights, chain), cut) for t in texts], dtype="float64")

    return docs.select("doc_id", run("text").alias("score"))


def op3_line_crf(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    scored = score_documents(docs, train(docs, table(spark, sf_dir, "labels")))
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= CUT).cast("int").alias("predicted"))
