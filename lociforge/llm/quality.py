"""Quality classifier: regularised quadratic discriminant analysis over document statistics.

Each document becomes a short vector of transformed statistics of its whole
text.  The class means and covariances are sums over all labelled training
rows, added up on the cluster; covariances are shrunk towards their pooled
covariance and its mean variance, and factored once.  A score is the logistic
of the difference of the two Mahalanobis log-densities plus the log prior odds.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import list_column, text_slices, written
from .wordscan import scan

#: What the byte classes count: upper case, lower case, digits, sentence marks, '!' and '?', '|', other symbols, line ends.
_CLASS = np.zeros(256, dtype=np.uint8)
_CLASS[65:91], _CLASS[97:123], _CLASS[48:58] = 1, 2, 3
_CLASS[[ord(c) for c in ".,;:"]], _CLASS[[ord(c) for c in "!?"]], _CLASS[ord("|")] = 4, 5, 6
_CLASS[[ord(c) for c in "#$%&*+/<=>@\\^_`~{}[]()\"'-"]], _CLASS[10] = 7, 8
NAMES = ("words", "word_bytes", "upper", "digits", "marks", "shouts", "bars", "symbols", "lines", "repeats", "distinct", "top")
_SOFT = 0.002
#: Words that a text is treated as having besides its own, all plain.
_FEW = 16


def _sums(values: np.ndarray, edges: np.ndarray) -> np.ndarray:
    """Sum of values[edges[i]:edges[i + 1]] for each i."""
    total = np.zeros(len(edges) - 1, dtype=np.int64)
    full = edges[1:] > edges[:-1]
    if full.any():
        total[full] = np.add.reduceat(values, edges[:-1][full], dtype=np.int64)
    return total


def statistics(texts: pa.Array) -> np.ndarray:
    """Documents x NAMES, transformed; a text without words has the statistics of nothing (all shares 0)."""
    w = scan(texts, lower=False)
    kinds = _CLASS[w.data]
    size = np.diff(w.offsets) + 8 * _FEW  # short texts lean towards no share at all
    n = np.diff(w.first)
    some = np.maximum(n, 1)
    many = n + _FEW
    share = lambda k: _sums((kinds == k).view(np.int8), w.offsets) / size
    letters = _sums(((kinds == 1) | (kinds == 2)).view(np.int8), w.offsets) + 8 * _FEW
    doc = w.doc_of
    again = np.zeros(len(doc), dtype=np.int8)
    if len(doc) > 1:
        again[1:] = (w.hashes[1:] == w.hashes[:-1]) & (doc[1:] == doc[:-1])
    distinct, top = np.zeros(len(n)), np.zeros(len(n))
    for i in np.flatnonzero(n):
        h = np.sort(w.hashes[w.first[i] : w.first[i + 1]])
        at = np.flatnonzero(np.concatenate(([True], h[1:] != h[:-1])))
        distinct[i] = len(at)
        top[i] = np.diff(np.append(at, len(h))).max()
    log = lambda x: np.log(x + _SOFT)
    return np.stack(
        [
            np.log1p(n),
            np.log1p(_sums(w.ends - w.starts, w.first) / some),
            log(_sums((kinds == 1).view(np.int8), w.offsets) / letters),
            *(log(share(k)) for k in (3, 4, 5, 6, 7, 8)),
            log(_sums(again, w.first) / many),
            np.log1p(distinct) / np.log1p(some),
            log(np.maximum(top - 1, 0) / many),
        ],
        axis=1,
    )


def featurise(docs: DataFrame, key: str, text: str) -> DataFrame:
    """(id, x array<double>) of every row."""

    def run(batches):
        for part in text_slices(batches, "text"):
            x = statistics(part.column(1))
            yield pa.RecordBatch.from_arrays([part.column(0), list_column(x.reshape(-1), np.full(len(x), x.shape[1]), pa.float64())], names=["id", "x"])

    return docs.select(F.col(key).cast("long").alias("id"), F.col(text).alias("text")).mapInArrow(run, "id long, x array<double>")


@dataclass
class Discriminant:
    """Means, inverse Cholesky factors, log-determinants and log priors of classes 0 and 1."""

    mean: np.ndarray
    whiten: np.ndarray
    logdet: np.ndarray
    prior: np.ndarray

    @classmethod
    def fit(cls, n: np.ndarray, s: np.ndarray, ss: np.ndarray, pooled: float = 0.15, ridge: float = 0.02) -> "Discriminant":
        """From each class's count, sum and sum of outer products."""
        d = s.shape[1]
        mean = s / n[:, None]
        cov = np.stack([ss[k] / n[k] - np.outer(mean[k], mean[k]) for k in (0, 1)])
        both = (n[0] * cov[0] + n[1] * cov[1]) / n.sum()
        whiten, logdet = [], []
        for k in (0, 1):
            # A class of few rows leans more on the pooled covariance.
            a = max(pooled, d / (d + n[k]))
            c = (1 - a) * cov[k] + a * both
            c = (1 - ridge) * c + ridge * max(np.trace(c) / d, 1e-9) * np.eye(d)
            factor = np.linalg.cholesky(c)
            whiten.append(np.linalg.inv(factor))
            logdet.append(2 * np.log(np.diag(factor)).sum())
        return cls(mean, np.stack(whiten), np.array(logdet), np.log(n / n.sum()))

    def score(self, x: np.ndarray) -> np.ndarray:
        logp = [self.prior[k] - 0.5 * (self.logdet[k] + (((x - self.mean[k]) @ self.whiten[k].T) ** 2).sum(axis=1)) for k in (0, 1)]
        return 1 / (1 + np.exp(np.clip(logp[0] - logp[1], -700, 700)))


def fit(features: DataFrame, labels: DataFrame, label_key: str = "doc_id", label: str = "quality", folds: int = 5) -> Discriminant | float:
    """The discriminant of all labelled rows whose crc32 of the id as text is not divisible by `folds`.

    Only the sums of the two classes reach the driver.  With fewer than two
    rows of a class there is no discriminant: the share of label 1 (1 without
    labels) is returned instead.
    """
    rule = F.crc32(F.encode(F.col(label_key).cast("string"), "utf-8")) % folds != 0
    known = labels.where(F.col(label).isin(0, 1) & rule).select(F.col(label_key).cast("long").alias("id"), F.col(label).cast("int").alias("y"))

    def run(batches):
        total: dict[int, np.ndarray] = {}
        for batch in batches:
            if not batch.num_rows:
                continue
            y = np.asarray(batch.column(0))
            x = np.asarray(batch.column(1).flatten()).reshape(len(y), -1)
            for k in (0, 1):
                v = x[y == k]
                total[k] = total.get(k, 0) + np.concatenate([[len(v)], v.sum(axis=0), (v.T @ v).reshape(-1)])
        for k, v in total.items():
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(v), k, np.int32)), pa.array(np.arange(len(v), dtype=np.int32)), pa.array(v)], names=["y", "at", "v"])

    joined = features.join(known, "id").select("y", "x")
    sums = joined.mapInArrow(run, "y int, at int, v double").groupBy("y", "at").agg(F.sum("v").alias("v")).collect()
    d = len(NAMES)
    held = np.zeros((2, 1 + d + d * d))
    for r in sums:
        held[r["y"], r["at"]] = r["v"]
    n = held[:, 0]
    if n.min() < 2:
        return float(n[1] / n.sum()) if n.sum() else 1.0
    return Discriminant.fit(n, held[:, 1 : 1 + d], held[:, 1 + d :].reshape(2, d, d))


def keep(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", threshold: float = 0.3, **options) -> DataFrame:
    """The rows of docs, with all their columns, whose score reaches the threshold.

    The rows are scored where they are scanned, so that no text is moved.
    Without two labelled rows of each class every row stays.  A null or empty
    text is scored as one without words; equal texts have equal scores, so
    repeated rows stay or go together; null ids have no label; an empty table
    gives no rows; columns of any name stay as they are.
    """
    model = fit(written(featurise(docs, key, text), "features"), labels, **options)
    if not isinstance(model, Discriminant):
        return docs
    at = docs.columns.index(text)

    def run(batches):
        for part in text_slices(batches, at):
            yield part.filter(pa.array(model.score(statistics(part.column(at))) >= threshold))

    return docs.mapInArrow(run, docs.schema)


def classify(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label_key: str = "doc_id", label: str = "quality", threshold: float = 0.3, folds: int = 5) -> DataFrame:
    """(id, held_out, score, predicted) for every row of docs.

    score: probability-like, 0 to 1, that the label is 1; predicted: 1 if it
    reaches the threshold.  held_out: crc32 of the id as text is divisible by
    folds, so its label was not learnt from; a null id is held out.  Null and
    empty texts are scored by the statistics of nothing; repeated rows are rows
    of their own; labels that are null or neither 0 nor 1 are not used; an
    empty table gives no rows; other columns are left out.
    """
    features = written(featurise(docs, key, text), "features")
    model = fit(features, labels, label_key, label, folds)

    def run(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            x = np.asarray(batch.column(1).flatten()).reshape(batch.num_rows, -1)
            score = model.score(x) if isinstance(model, Discriminant) else np.full(len(x), model)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(score)], names=["id", "score"])

    scored = features.mapInArrow(run, "id long, score double")
    held = F.coalesce(F.crc32(F.encode(F.col("id").cast("string"), "utf-8")) % folds == 0, F.lit(True))
    return scored.select("id", held.alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))
