"""Toxicity scores by non-negative positive-unlabelled learning.

Linear classifiers over hashed words and word beginnings are trained in numpy from confirmed toxic
texts and from texts whose labels aren't looked at. With class prior p, the risk is
p E_P[loss(f)] + max(0, E_U[loss(-f)] - p E_P[loss(-f)]): the unlabelled texts' risk as negatives is
corrected by the share of positives among them, and where a step finds that correction below zero
(the classifier fits the unlabelled positives as negatives) it moves the other way instead.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textkernel as tk
from .common import Scratch
from .language_id import fold

U = np.uint64
BITS = 18
PREFIX = 4
#: At most so many confirmed and unlabelled texts are learned from (those of least id hash; whole texts).
SAMPLE_POSITIVE = 8_000
SAMPLE_UNLABELLED = 16_000
#: A feature must occur in so many texts of the sample.
LEAST_TEXTS = 5
MEMBERS = 3
#: A step of training sees an eighth of either side, or this many texts.
LEAST_SLICE = 256


def features(w: tk.Words) -> tuple[np.ndarray, np.ndarray]:
    """(document, feature), each pair once, sorted: hashed words and their first bytes."""
    n = len(w.data)
    head = np.zeros(len(w.start), U)
    for j in range(PREFIX):
        at = w.start + j
        inside = at < w.end
        head = head << U(8) | np.where(inside, tk.ALNUM_LOWER[w.data[np.minimum(at, n - 1)]], 0).astype(U) if n else head
    mask = U((1 << BITS - 1) - 1)
    word = w.hash & mask
    begin = (tk.mix(head + U(1)) & mask) | U(1 << BITS - 1)
    doc = np.concatenate([w.doc, w.doc]).astype(U)
    pair = np.unique(doc << U(BITS) | np.concatenate([word, begin]))
    return (pair >> U(BITS)).astype(np.int64), (pair & U((1 << BITS) - 1)).astype(np.int64)


class Rows:
    """A sparse binary matrix with rows of unit length; ``features`` that are in use are its columns, in order."""

    def __init__(self, lists: list[np.ndarray], use: np.ndarray):
        column = np.cumsum(use) - 1
        lists = [column[x[use[x]]] for x in lists]
        size = np.array([len(x) for x in lists], np.int64)
        self.n, self.width = len(lists), int(use.sum())
        self.start = np.concatenate([[0], np.cumsum(size)])
        self.row = np.repeat(np.arange(self.n, dtype=np.int32), size)
        self.col = np.concatenate(lists).astype(np.int32) if lists else np.empty(0, np.int32)
        self.scale = 1 / np.sqrt(np.maximum(size, 1))

    def dot(self, weights: np.ndarray, lo: int = 0, hi: int | None = None) -> np.ndarray:
        """Of rows lo to hi."""
        hi = self.n if hi is None else hi
        a, b = self.start[lo], self.start[hi]
        return np.bincount(self.row[a:b] - lo, weights[self.col[a:b]], hi - lo) * self.scale[lo:hi]

    def grad(self, per_row: np.ndarray, lo: int = 0) -> np.ndarray:
        """Of rows lo on, as many as ``per_row`` has."""
        a, b = self.start[lo], self.start[lo + len(per_row)]
        return np.bincount(self.col[a:b], (per_row * self.scale[lo : lo + len(per_row)])[self.row[a:b] - lo], self.width)


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


@dataclass
class Model:
    """Weights (NaN: a feature not known), bias and calibration; bounded by the number of features and the sample."""

    weights: np.ndarray
    bias: float
    knots: tuple[np.ndarray, np.ndarray]

    @classmethod
    def constant(cls, value: float) -> Model:
        return cls(np.full(1 << BITS, np.nan), 0.0, (np.zeros(1), np.full(1, value)))


def risk(fp: np.ndarray, fu: np.ndarray, prior: float) -> tuple[float, np.ndarray, np.ndarray]:
    """The unlabelled texts' corrected risk as negatives, and the gradient by the scores of what a step descends.

    With logistic loss: where that risk is not below zero, the gradient of the whole risk, else the
    gradient of its negative.
    """
    loss_u = np.logaddexp(0, fu).mean() - prior * np.logaddexp(0, fp).mean()
    # d loss(f)/df = -sigmoid(-f); d loss(-f)/df = sigmoid(f)
    as_negative_p, as_negative_u = -prior * _sigmoid(fp) / len(fp), _sigmoid(fu) / len(fu)
    if loss_u >= 0:
        return loss_u, -prior * _sigmoid(-fp) / len(fp) + as_negative_p, as_negative_u
    return loss_u, -as_negative_p, -as_negative_u


def train(positive: Rows, unlabelled: Rows, prior: float, *, seed: int, steps: int = 240, rate: float = 0.3, decay: float = 1e-4) -> tuple[np.ndarray, float]:
    """Weights and bias that minimise the non-negative risk, by Adam over slices of either side in turn."""
    rng = np.random.default_rng(seed)
    w, b = rng.normal(0, 0.01, positive.width), float(np.log(prior / (1 - prior)))
    m, v = np.zeros(len(w) + 1), np.zeros(len(w) + 1)
    slices = [np.linspace(0, x.n, max(1, min(8, x.n // LEAST_SLICE)) + 1).astype(int) for x in (positive, unlabelled)]
    for t in range(1, steps + 1):
        (p0, p1), (u0, u1) = ((s[t % (len(s) - 1)], s[t % (len(s) - 1) + 1]) for s in slices)
        _, gp, gu = risk(positive.dot(w, p0, p1) + b, unlabelled.dot(w, u0, u1) + b, prior)
        g = np.append(positive.grad(gp, p0) + unlabelled.grad(gu, u0) + decay * w, gp.sum() + gu.sum())
        m = 0.9 * m + 0.1 * g
        v = 0.99 * v + 0.01 * g * g
        step = rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.99**t)) + 1e-8)
        w -= step[:-1]
        b -= step[-1]
    return w, b


def calibrate(fp: np.ndarray, fu: np.ndarray, prior: float) -> tuple[np.ndarray, np.ndarray]:
    """Knots of the posterior p P(f) / U(f) as a rising function of the score f.

    The ratio of the two densities, with the rise enforced by pooling neighbours that break it: each
    confirmed text brings prior / n of toxic mass, each unlabelled one 1 / n of all mass. ``fp`` and
    ``fu`` come from classifiers that didn't see those texts.
    """
    f = np.concatenate([fp, fu])
    order = np.argsort(f, kind="stable")
    toxic = np.concatenate([np.full(len(fp), prior / len(fp)), np.zeros(len(fu))])[order]
    mass = np.concatenate([np.zeros(len(fp)), np.full(len(fu), 1 / len(fu))])[order]
    blocks: list[list[float]] = []  # toxic mass, mass, sum of scores, texts
    for t, m, x in zip(toxic, mass, f[order], strict=True):
        blocks.append([t, m, x, 1])
        while len(blocks) > 1 and blocks[-2][0] * blocks[-1][1] >= blocks[-1][0] * blocks[-2][1]:
            last = blocks.pop()
            blocks[-1] = [p + q for p, q in zip(blocks[-1], last, strict=True)]
    x = np.array([b[2] / b[3] for b in blocks])
    y = np.array([min(1.0, b[0] / b[1]) if b[1] else 1.0 for b in blocks])
    return x, y


def posterior(f: np.ndarray, knots: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    """Scores in (0, 1), rising in f also where the knots are level or at an end."""
    return 0.98 * np.interp(f, *knots) + 0.02 * _sigmoid(f)


def fit(docs: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", folds: int = 4, held: int = 2, sample_positive: int = SAMPLE_POSITIVE, sample_unlabelled: int = SAMPLE_UNLABELLED) -> Model:
    """The mean of a few classifiers, each trained without a part of the sample and calibrated on those parts;
    nothing confirmed: one low score for all (or high, where all labels are toxic).

    Labels of the held-out fold are not read. The prior is the share of positives among the labels
    read, and the unlabelled texts come from all documents outside the held-out fold.
    """
    outside = fold(id_col, folds) != held
    # a label repeated for an id counts once; contradicting ones confirm nothing
    known = labels.where(outside & F.col(label_col).isNotNull()).groupBy(F.col(id_col).alias("id")).agg(F.min(label_col).alias("toxic"))
    n, positives = known.agg(F.count("*"), F.sum((F.col("toxic") == 1).cast("long"))).first()
    if not n or not positives or positives == n:
        return Model.constant(0.98 if positives else 0.02)
    prior = positives / n

    def least(df: DataFrame, most: int) -> DataFrame:
        """Those of least hash; only rows below a bound that leaves a little more are sorted."""
        share = min(1.0, (most + 10 * most**0.5 + 50) / max(1, df.count()))
        return df.where(F.xxhash64("id").cast("double") <= share * 2.0**64 - 2.0**63).orderBy(F.xxhash64("id"), "id").limit(most)

    texts = docs.where(outside & F.col(text_col).isNotNull()).select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    confirmed = least(known.where("toxic = 1").select("id"), sample_positive).withColumn("kind", F.lit(1))
    other = least(texts.select("id"), sample_unlabelled).distinct().withColumn("kind", F.lit(0))

    def lists(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for w in tk.slices(batch.column(1), tk.ALNUM_LOWER):
                doc, feature = features(w)
                at = np.searchsorted(doc, np.arange(w.n_docs + 1))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(w.first, w.n_docs), batch.column(2).slice(w.first, w.n_docs), pa.ListArray.from_arrays(pa.array(at, pa.int32()), pa.array(feature, pa.int32()))], names=["id", "kind", "features"])

    kind = docs.schema[id_col].dataType.simpleString()
    scratch = Scratch(docs.sparkSession)
    got = texts.join(scratch.table(confirmed.unionByName(other), "toxicity-sample"), "id").select("id", "text", "kind").mapInArrow(lists, f"id {kind}, kind int, features array<int>").withColumn("hash", F.xxhash64("id")).toArrow()
    scratch.drop()
    order = got.select(["kind", "hash", "id"]).to_pandas().sort_values(["kind", "hash", "id"], kind="stable").index.to_numpy()  # runs and partitions don't matter
    got = got.take(order).combine_chunks()
    which = got.column("kind").to_numpy()
    rows = [x.values.to_numpy() for x in got.column("features")]
    p, u = [rows[i] for i in np.flatnonzero(which == 1)], [rows[i] for i in np.flatnonzero(which == 0)]
    use = np.bincount(np.concatenate(rows), minlength=1 << BITS) >= LEAST_TEXTS if rows else np.zeros(1 << BITS, bool)
    if len(p) < MEMBERS or len(u) < MEMBERS:
        return Model.constant(0.02)
    w, b, fp, fu = np.zeros(int(use.sum())), 0.0, [], []
    for k in range(MEMBERS):
        wk, bk = train(Rows([x for i, x in enumerate(p) if i % MEMBERS != k], use), Rows([x for i, x in enumerate(u) if i % MEMBERS != k], use), prior, seed=k)
        fp.append(Rows(p[k::MEMBERS], use).dot(wk) + bk)
        fu.append(Rows(u[k::MEMBERS], use).dot(wk) + bk)
        w, b = w + wk / MEMBERS, b + bk / MEMBERS
    weights = np.full(1 << BITS, np.nan)
    weights[use] = w
    return Model(weights, b, calibrate(np.concatenate(fp), np.concatenate(fu), prior))


def score(docs: DataFrame, model: Model, *, id_col: str = "doc_id", text_col: str = "text", threshold: float = 0.3) -> DataFrame:
    """One row per input row: ``doc_id, score, predicted``.

    The whole text counts. Null, empty and wordless texts get the score of no known feature; repeated
    rows each get a row; an empty table gives none; other columns are ignored.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m: Model = shared.value
        known = ~np.isnan(m.weights)
        weights = np.nan_to_num(m.weights)
        for batch in batches:
            for w in tk.slices(batch.column(1), tk.ALNUM_LOWER):
                doc, feature = features(w)
                ok = known[feature]
                size = np.bincount(doc[ok], minlength=w.n_docs)
                total = np.bincount(doc[ok], weights[feature[ok]], w.n_docs) / np.sqrt(np.maximum(size, 1))
                s = posterior(total + m.bias, m.knots)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(w.first, w.n_docs), pa.array(s), pa.array((s >= threshold).astype(np.int32))], names=["doc_id", "score", "predicted"])

    return docs.select(F.col(id_col), F.col(text_col).cast("string")).mapInArrow(run, f"doc_id {kind}, score double, predicted int")
