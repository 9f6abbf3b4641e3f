"""Quality classifier: regularised quadratic discriminant over document statistics (operator 1).

Each text becomes a short vector of transformed statistics. Class covariances are shrunk towards the pooled one and
towards a multiple of the identity; their Cholesky factors are computed once, and a score is the logistic of the
difference of Mahalanobis log densities plus the log prior odds.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import held_out, stored

_BYTES = np.arange(256)
_LOWER = (_BYTES >= 97) & (_BYTES <= 122)
_UPPER = (_BYTES >= 65) & (_BYTES <= 90)
_DIGIT = (_BYTES >= 48) & (_BYTES <= 57)
_SPACE = (_BYTES == 32) | ((_BYTES >= 9) & (_BYTES <= 13))
_STOP = np.isin(_BYTES, np.frombuffer(b".,;:?!", np.uint8))
_BANG = _BYTES == 33
_LINE = _BYTES == 10
_MARK = ~(_LOWER | _UPPER | _DIGIT | _SPACE | _STOP | (_BYTES >= 128))
_CLASSES = np.stack([_LOWER, _UPPER, _DIGIT, _SPACE, _STOP, _BANG, _LINE, _MARK, (_BYTES >= 128) & (_BYTES < 192)]).T.astype(float)
NAMES = "chars words word_length upper digit mark bang stop other distinct_words repeated_lines line_length top_gram compact".split()


def _logit(a: float, b: float) -> float:
    return float(np.log((a + 0.5) / (b - a + 0.5)))


def statistics(text: str | None) -> list[float]:
    """The vector of one text; an empty or null text has one too."""
    raw = (text or "").encode()
    lower, upper, digit, space, stop, bang, lines, mark, tails = np.bincount(np.frombuffer(raw, np.uint8), minlength=256) @ _CLASSES
    n = max(len(raw) - tails, 0)
    words = raw.split()
    own = [x for x in raw.split(b"\n") if x.strip()]
    distinct = len(set(words))
    pairs = len(set(zip(words, words[1:])))
    return [
        np.log1p(n),
        np.log1p(len(words)),
        np.log1p((n - space) / max(len(words), 1)),
        _logit(upper, upper + lower),
        _logit(digit, n),
        _logit(mark, n),
        np.log((bang + 0.5) / (len(words) + 1)),
        np.log((stop - bang + 0.5) / (len(words) + 1)),
        _logit(n - lower - upper - digit - space - stop - mark, n) if n >= lower + upper + digit + space + stop + mark else _logit(0, n),
        np.log((distinct + 1) / (len(words) + 1) ** 0.8),
        np.log((len(own) - len(set(own)) + 0.5) / (len(own) + 1)),
        np.log1p(n / max(len(own), 1)),
        _logit(max(len(words) - 1 - pairs, 0), max(len(words) - 1, 0)),
        np.log((pairs + 1) / (distinct + 1)),
    ]


def _features(batches):
    for batch in batches:
        vectors = [list(map(float, statistics(t))) for t in batch.column(2).to_pylist()]
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(vectors, pa.list_(pa.float64()))], names=["doc_id", "held_out", "x"])


def _moments(batches):
    """Per class: n, sums, sums of products, flattened; one row a task and class."""
    acc: dict[int, np.ndarray] = {}
    d = len(NAMES)
    for batch in batches:
        x = np.array(batch.column(0).to_pylist(), float).reshape(-1, d)
        x = np.c_[np.ones(len(x)), x]
        y = np.array(batch.column(1).to_pylist(), int)
        for c in np.unique(y):
            own = x[y == c]
            acc[int(c)] = acc.get(int(c), 0) + own.T @ own
    for c, m in acc.items():
        yield pa.RecordBatch.from_arrays([pa.array([c] * m.size, pa.int32()), pa.array(np.arange(m.size, dtype=np.int32)), pa.array(m.ravel())], names=["y", "at", "v"])


class Discriminant:
    """Two Gaussians with shrunk covariances."""

    def __init__(self, moments: dict[int, np.ndarray], pooled: float = 0.25, ridge: float = 0.02):
        d = len(NAMES)
        self.parts = []
        n = sum(m[0, 0] for m in moments.values())
        cov, mean = {}, {}
        for c, m in moments.items():
            mean[c] = m[0, 1:] / m[0, 0]
            cov[c] = m[1:, 1:] / m[0, 0] - np.outer(mean[c], mean[c])
        within = sum((m[0, 0] / n) * cov[c] for c, m in moments.items())
        scale = np.sqrt(np.maximum(np.diag(within), 1e-6))
        for c in sorted(moments):
            k = moments[c][0, 0]
            lam = max(pooled, d / (d + k))  # the fewer rows, the more of the pooled covariance
            s = ((1 - lam) * cov[c] + lam * within) / np.outer(scale, scale)
            s = (1 - ridge) * s + ridge * max(np.trace(s) / d, 1e-3) * np.eye(d)
            factor = np.linalg.cholesky(s)
            self.parts.append((c, mean[c] / scale, np.linalg.inv(factor), np.log(np.diag(factor)).sum(), np.log(k / n)))
        self.scale = scale

    def score(self, x: np.ndarray) -> np.ndarray:
        """Probability of class 1."""
        z = x / self.scale
        log = {c: prior - half - 0.5 * (((z - m) @ inv.T) ** 2).sum(axis=1) for c, m, inv, half, prior in self.parts}
        if set(log) != {0, 1}:
            return np.full(len(x), 1.0 if 1 in log else 0.0)
        return 1 / (1 + np.exp(-np.clip(log[1] - log[0], -40, 40)))


def quality(docs: DataFrame, labels: DataFrame, text: str = "text", doc_id: str = "doc_id", label: str = "quality", threshold: float = 0.3) -> DataFrame:
    """One row per document row: doc_id, held_out, score, predicted.

    Learns from all labelled rows that are not held out (crc32(doc_id) mod 5 not 0); of several labels of one id the
    smallest counts, null labels none. Without any label every score is 0.5. Null texts count as empty."""
    d = len(NAMES)
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), held_out(doc_id, 5, 0).alias("held_out"), F.col(text).alias("text"))
    x = stored(rows.mapInArrow(_features, "doc_id long, held_out boolean, x array<double>"), "quality")
    y = labels.where(F.col(label).isin(0, 1)).groupBy(F.col(doc_id).cast("long").alias("doc_id")).agg(F.min(label).cast("int").alias("y"))
    found = x.where(~F.col("held_out")).join(y, "doc_id").select("x", "y").mapInArrow(_moments, "y int, at int, v double").groupBy("y", "at").agg(F.sum("v")).collect()
    moments: dict[int, np.ndarray] = {}
    for c, at, v in found:  # two classes, (d + 1)^2 numbers each
        moments.setdefault(c, np.zeros((d + 1, d + 1)))[divmod(at, d + 1)] = v
    model = docs.sparkSession.sparkContext.broadcast(Discriminant(moments) if moments else None)

    def run(batches):
        for batch in batches:
            v = np.array(batch.column(2).to_pylist(), float).reshape(-1, d)
            s = model.value.score(v) if model.value else np.full(len(v), 0.5)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(s), pa.array((s >= threshold).astype(np.int32))], names=["doc_id", "held_out", "score", "predicted"])

    return x.mapInArrow(run, "doc_id long, held_out boolean, score double, predicted int")
