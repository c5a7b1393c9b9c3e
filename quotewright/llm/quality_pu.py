"""Quality classifier by positive-unlabelled learning: the non-negative unbiased risk, over all documents.

Trusted positives are the documents labelled good.  The unlabelled sample is all documents, trusted ones as well: they are
part of what the prior is a share of.  Labels of bad documents are not used.
With the squared loss both parts of the risk depend on second moments of the features only, so one pass of partial
sums over all documents holds the whole risk exactly, and the descent runs on matrices of a few dozen rows.  The class
prior is estimated from score histograms: the least ratio of unlabelled to positive mass above a score (best bin
estimation).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import columns, written
from .textstats import NAMES, statistics, transformed

#: Buckets of hashed words next to the statistics; bins of a score histogram; L2 penalty; sums merged in one task.
HASHED, BINS, PENALTY, FAN_IN = 32, 400, 1e-3, 64
#: How many good documents lost are as bad as one other document kept.
COST = 9.0
_S = len(NAMES)
#: Features: statistics, their squares, log length, hashed words, and a constant.
DIM = 2 * _S + 1 + HASHED + 1
_LOW, _HIGH = -4.0, 4.0


def _features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for w, n, x in statistics(batch.column(1)):
            x = transformed(x)
            key = w.doc_of_word() * HASHED + (w.hash >> np.uint64(59)).astype(np.int64)
            bag = np.bincount(key, minlength=w.n_docs * HASHED).reshape(-1, HASHED)
            bag = np.sqrt((bag + 40 / HASHED) / (n[:, None] + 40))
            f = np.concatenate([x, np.square(x), np.log1p(n)[:, None], bag, np.ones((len(n), 1))], axis=1).astype(np.float32)
            flat = pa.ListArray.from_arrays(pa.array(np.arange(len(n) + 1, dtype=np.int32) * DIM), pa.array(f.ravel()))
            yield pa.RecordBatch.from_arrays([batch.column(0).slice(w.first, w.n_docs), pa.array(n.astype(np.int64)), flat], names=["doc_id", "n", "x"])


def _matrix(column: pa.Array) -> np.ndarray:
    return np.asarray(column.flatten()).reshape(-1, DIM).astype(np.float64)


def _partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Moments of the rows of a task: X'X of positives and of all."""
    sums = np.zeros((2, DIM, DIM))
    for batch in batches:
        if batch.num_rows:
            x, good = _matrix(batch.column(1)), np.asarray(batch.column(0).cast(pa.int8())) == 1
            for k, rows in enumerate((x[good], x)):
                sums[k] += rows.T @ rows
    yield pa.RecordBatch.from_arrays([pa.array([sums.tobytes()], pa.binary())], names=["sums"])


def _add(key: tuple, t: pa.Table) -> pa.Table:
    total = sum(np.frombuffer(b.as_py()) for b in t["sums"])
    return pa.table({"sums": pa.array([total.tobytes()], pa.binary())})


def moments(rows: DataFrame) -> np.ndarray:
    """(2, DIM, DIM) sums over ``rows`` (good, x), added up in a tree so that the driver gets FAN_IN parts at most."""
    parts = rows.select("good", "x").mapInArrow(_partial, "sums binary")
    merged = parts.groupBy(F.spark_partition_id() % FAN_IN).applyInArrow(_add, "sums binary")
    got = [np.frombuffer(r[0]).reshape(2, DIM, DIM) for r in merged.collect()]
    return np.sum(got, axis=0) if got else np.zeros((2, DIM, DIM))


def fit(sums: np.ndarray, prior: float, penalty: float = PENALTY, steps: int = 4000) -> np.ndarray:
    """Weights that minimise the non-negative risk with squared loss, given second moments (the last feature is 1).

    Risk: prior * E+[(1 - g)²] / 2 + max(0, Eu[(1 + g)²] / 2 - prior * E+[(1 + g)²] / 2) + penalty.  While the second part is
    negative its gradient is left out, so the fit can't pay for itself with negative risk."""
    n = sums[:, -1, -1]
    if not n.all():
        return np.zeros(DIM)
    mp, mu = sums[0] / n[0], sums[1] / n[1]
    mean = mu[-1]
    sd = np.sqrt(np.maximum(np.diag(mu) - mean**2, 1e-9))
    mean, sd = np.where(np.arange(DIM) == DIM - 1, 0, mean), np.where(np.arange(DIM) == DIM - 1, 1, sd)
    # z = (x - mean) / sd as a linear map of x
    a = np.diag(1 / sd)
    a[:, -1] -= mean / sd
    p, u = a @ mp @ a.T, a @ mu @ a.T
    e = p[-1].copy()
    eu = u[-1].copy()
    w = np.zeros(DIM)
    eye = np.eye(DIM) * penalty
    rate = 1 / (np.linalg.eigvalsh(u + prior * p)[-1] + penalty)
    for _ in range(steps):
        positive = prior * (p @ w - e)
        negative_risk = (1 + 2 * eu @ w + w @ u @ w - prior * (1 + 2 * e @ w + w @ p @ w)) / 2
        grad = positive + eye @ w
        if negative_risk > 0:
            grad = grad + (u @ w + eu) - prior * (p @ w + e)
        w = w - rate * grad
    return a.T @ w


def class_prior(good: np.ndarray, rest: np.ndarray, delta: float = 0.05) -> float:
    """Share of good ones among the unlabelled ``rest``, from score histograms (counts from low to high scores)."""
    n, m = good.sum(), rest.sum()
    if not n or not m:
        return 0.5
    above_p, above_u = np.cumsum(good[::-1]) / n, np.cumsum(rest[::-1]) / m
    slack = np.sqrt(np.log(4 / delta) / (2 * n)) + np.sqrt(np.log(4 / delta) / (2 * m))
    ok = above_p > 0.1
    return float(np.clip(np.min((above_u[ok] + slack) / above_p[ok]), 0.02, 0.98))


def _score(w: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            g = _matrix(batch.column(3)) @ w if batch.num_rows else np.zeros(0)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), batch.column(2), pa.array(np.round(g, 9))], names=["doc_id", "n", "good", "score"])

    return run


def _histograms(scored: DataFrame) -> np.ndarray:
    """Counts of scores, of positives and of all documents."""
    cell = F.floor((F.least(F.greatest("score", F.lit(_LOW)), F.lit(_HIGH - 1e-9)) - _LOW) / (_HIGH - _LOW) * BINS).cast("int")
    hist = np.zeros((2, BINS))
    for b, g, n in scored.groupBy(cell.alias("b"), "good").count().collect():
        hist[1, b] += n
        hist[0, b] += n if g else 0
    return hist


def scores(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(doc_id, n, good, score) of every row: the score is twice the probability of being good, less 1, as the squared loss has it.

    A document is a trusted positive if any of its labels has quality 1; null labels and ids label nothing.  Repeated
    rows count and come back each, with equal scores; null and empty texts have the features of no words, texts of any length are taken whole.
    Without positives all scores are 0.  Other columns are not looked at.  An empty table gives an empty result.
    """
    src = columns(docs, doc_id="long", text="string")
    good = columns(labels, doc_id="long", quality="int").where("quality = 1 and doc_id is not null").select("doc_id", F.lit(True).alias("good")).distinct()
    x = src.mapInArrow(_features, "doc_id long, n long, x array<float>")
    x = written(x.join(good, "doc_id", "left").select("doc_id", "n", F.coalesce("good", F.lit(False)).alias("good"), "x"), "features")
    sums, prior = moments(x), 0.5
    schema = "doc_id long, n long, good boolean, score double"
    for _ in range(2):
        scored = x.mapInArrow(_score(fit(sums, prior)), schema)
        prior = class_prior(*_histograms(scored))
    return x.mapInArrow(_score(fit(sums, prior)), schema)


def quality_classifier(docs: DataFrame, labels: DataFrame, cost: float = COST) -> DataFrame:
    """(doc_id, score) of the documents that read as good: keeping them costs less than losing them, where a bad one kept costs
    ``cost`` good ones lost, so (1 + score) / 2 is at least cost / (1 + cost); at 1 that is a score of 0.

    A score equal to the bound stays.  Without positives nothing can be told and every row stays.  Nulls, empty and very long texts,
    repeated rows, clashing names and empty tables: see :func:`scores`."""
    scored = written(scores(docs, labels), "scores")
    if scored.where("good").isEmpty():
        return scored.select("doc_id", "score")
    return scored.where(F.col("score") >= (cost - 1) / (cost + 1)).select("doc_id", "score")
