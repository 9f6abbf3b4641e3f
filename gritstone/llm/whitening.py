"""Embedding whitening by matrix-free block subspace iteration.

Nothing of the size of the data or of the square of the dimension is formed: a pass over the rows multiplies their
centred matrix with one block of columns and with its transpose, and a d x b matrix a task is all that moves. The
driver orthogonalises (QR), keeps the blocks so far as the search space and takes Rayleigh-Ritz pairs from it.

Rows whose vector is null, empty or holds null or non-finite entries are dropped, and so are those of another length
than the most common one. Repeated rows and null ids are rows like others. No rows give no rows; a component without
variance has a null ``whitened``. Of other columns nothing is read, so their names cannot clash. Scores of rows at a
size where ``deviation`` passes 64 bits raise an OverflowError."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import dropped, merged, stored
from .vectors import dimension, finite, floors, matrix

#: Columns of a block beyond the components asked for, and the most columns that the search space holds.
SPARE, WIDTH = 8, 96
#: A component is certified when ||V u - e u|| is at most this share of the largest eigenvalue.
CERTAIN = 1e-14
PASSES = 200


def _summed(fit: DataFrame, size: int, part) -> np.ndarray:
    """Adds up ``part(x)``, ``size`` doubles, over all batches x of the fit list."""
    d = fit.select(F.size("x")).first()[0]

    def run(batches):
        total = np.zeros(size)
        for batch in batches:
            total += part(matrix(batch.column(0), d))
        yield pa.RecordBatch.from_arrays([pa.array([int(abs(total[0]) * 1e3) % 1009], pa.int32()), pa.array([total.tobytes()], pa.binary())], names=["part", "blob"])

    return merged(fit.select("x").mapInArrow(run, "part int, blob binary"), "f8", "add", size)


def _orthogonal(block: np.ndarray, basis: np.ndarray, least: float) -> np.ndarray:
    """What of the block's columns is new to the basis, orthonormal; twice is enough."""
    for _ in range(2):
        block = block - basis @ (basis.T @ block)
        norms = np.linalg.norm(block, axis=0)
        block = block[:, norms > least]
        least = 0.5
        if not block.shape[1]:
            break
        block = np.linalg.qr(block / np.linalg.norm(block, axis=0))[0]
    return block


def leading(multiply, d: int, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The k leading eigenpairs (values, vectors) of a d x d symmetric matrix known by ``multiply(Q)``, a pass over
    the data, and their residual norms."""
    width = min(d, k + SPARE)
    block = np.linalg.qr(np.random.default_rng(7).standard_normal((d, width)))[0]
    basis, image, best, still = np.empty((d, 0)), np.empty((d, 0)), np.inf, 0
    for _ in range(PASSES):
        basis, image = np.hstack([basis, block]), np.hstack([image, multiply(block)])
        inner = basis.T @ image
        e, s = np.linalg.eigh((inner + inner.T) / 2)
        e, s = e[::-1], s[:, ::-1]
        u, vu = basis @ s[:, :width], image @ s[:, :width]
        rest = vu - u * e[:width]
        norms = np.linalg.norm(rest[:, :k], axis=0)
        scale = max(abs(e[0]), 1e-300)
        still = 0 if norms.max() < best / 2 else still + 1
        best = min(best, norms.max())
        # at the level of rounding residuals stop falling
        if norms.max() <= CERTAIN * scale or basis.shape[1] >= d or still > 3 and best <= 1e-12 * scale:
            break
        if basis.shape[1] + width > min(d, WIDTH):  # keep the best of the space and go on
            keep = min(2 * width, basis.shape[1])
            if d > WIDTH:
                basis, image = basis @ s[:, :keep], image @ s[:, :keep]
        block = _orthogonal(rest, basis, 1e-13 * scale)
        missing = min(width, d - basis.shape[1]) - block.shape[1]
        if missing > 0 and d <= WIDTH:  # residuals of few directions: fill up with new ones
            fresh = np.random.default_rng(basis.shape[1]).standard_normal((d, missing))
            block = np.hstack([block, _orthogonal(fresh, np.hstack([basis, block]), 1e-9)])
        if not block.shape[1]:
            break
    if norms.max() > 1e-10 * scale:
        raise ArithmeticError(f"residuals {norms} certify no components after {PASSES} passes")
    return e[:k], u[:, :k], norms


def whiten(rows: DataFrame, vec_id: str = "vec_id", vector: str = "embedding", k: int = 4) -> DataFrame:
    """(vec_id, component, n, deviation, whitened, explained, identity_error, residual) for each row and component.

    The model is fitted on each distinct vector of floor(256 c) once."""
    spark = rows.sparkSession
    clean = rows.select(F.col(vec_id).alias("vec_id"), F.col(vector).alias("v")).where(finite(F.col("v")))
    d = dimension(clean, "v")
    schema = T.StructType([T.StructField("vec_id", rows.schema[vec_id].dataType)] + [T.StructField(c, t) for c, t in (("component", T.IntegerType()), ("n", T.LongType()), ("deviation", T.LongType()), ("whitened", T.DoubleType()), ("explained", T.DoubleType()), ("identity_error", T.DoubleType()), ("residual", T.DoubleType()))])
    if not d:
        return spark.createDataFrame([], schema)
    whole = clean.where(F.size("v") == d).select("vec_id", floors(F.col("v")).alias("x"))
    fit = stored(whole.select("x").distinct(), "fit")
    sums = [F.sum(F.col("x")[i].cast("decimal(20,0)")).alias(f"s{i}") for i in range(d)]
    n, *s = fit.agg(F.count(F.lit(1)), *sums).first()
    n, s, k = int(n), [int(x) for x in s], min(k, d)
    mean = np.array([x / n for x in s])

    trace = float(_summed(fit, 1, lambda x: np.array([np.square(x - mean).sum()]))[0]) / n

    def multiply(q: np.ndarray) -> np.ndarray:
        def part(x):
            c = x - mean
            return (c.T @ (c @ q)).ravel()

        return _summed(fit, q.size, part).reshape(q.shape) / n

    e, u, rest = leading(multiply, d, k)
    flat = e <= 1e-12 * max(trace, 1e-300)
    scaled = np.where(flat, 0, u / np.sqrt(np.where(flat, 1, e)))

    def spread(x):
        w = (x - mean) @ scaled
        return np.concatenate([w.sum(0), (w.T @ w).ravel()])

    found = _summed(fit, k + k * k, spread)
    middle, cov = found[:k] / n, found[k:].reshape(k, k) / n
    off = np.abs(cov - np.outer(middle, middle) - np.eye(k))[~flat][:, ~flat]
    error = float(off.max()) if off.size else 0.0
    explained = [float(x / trace) if trace else 0.0 for x in e]
    total = np.array(s, object)

    def deviations(x: np.ndarray) -> list[int]:
        if d * (n * float(np.abs(x).max()) + float(max(map(abs, s)))) ** 2 < 2**62:
            return np.square(n * x - np.array(s, np.int64)).sum(1).tolist()
        whole = [int(r) for r in np.square(n * x.astype(object) - total).sum(1)]
        if max(whole) >= 2**63:
            raise OverflowError("deviation does not fit 64 bits")
        return whole

    arrow = [pa.int32(), pa.int64(), pa.int64(), pa.float64(), pa.float64(), pa.float64(), pa.float64()]

    def project(batches):
        for batch in batches:
            if not len(batch):
                continue
            x = matrix(batch.column(1), d)
            w = (x - mean) @ scaled
            dev, m = np.array(deviations(x)), len(x)
            white = pa.array(w.ravel(), mask=np.tile(flat, m))
            cols = [np.tile(np.arange(1, k + 1), m), np.full(m * k, n), np.repeat(dev, k), None, np.tile(explained, m), np.full(m * k, error), np.tile(rest, m)]
            cols = [white if c is None else pa.array(c, t) for c, t in zip(cols, arrow)]
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(np.repeat(np.arange(m), k))), *cols], names=schema.names)

    dropped(fit)
    return whole.mapInArrow(project, schema)
