"""Ellipsoids around points: the scaled covariance with a least volume, and the smallest one of all."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def _moments(points: DataFrame, dims: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Mean and sample covariance, one row for the driver."""
    d = len(dims)
    pairs = [(i, j) for i in range(d) for j in range(i, d)]
    r = points.agg(*[F.avg(c).alias(f"m{i}") for i, c in enumerate(dims)], *[F.covar_samp(dims[i], dims[j]).alias(f"c{i}_{j}") for i, j in pairs]).first()
    cov = np.zeros((d, d))
    for i, j in pairs:
        cov[i, j] = cov[j, i] = r[f"c{i}_{j}"]
    return np.array([r[f"m{i}"] for i in range(d)]), cov


def with_least_volume(cov: np.ndarray, product: float) -> np.ndarray:
    """``cov`` with eigenvalues that are zero raised, alike, until the product of all is ``product``."""
    w, v = np.linalg.eigh(cov)
    flat = w < max(1e-10, 1e-300 ** (1 / len(w)))
    if not flat.any():
        return cov
    w = w.copy()
    w[flat] = (product / np.prod(w[~flat])) ** (1 / flat.sum())
    return v @ np.diag(w) @ v.T


def bounding_ellipsoid(points: DataFrame, dims: list[str], least_product: float = 0.0) -> tuple[np.ndarray, np.ndarray]:
    """(centre, covariance times d + 2), the scale at which a uniformly filled ellipsoid is bounded; flat axes are
    widened so that the product of eigenvalues is ``least_product``, if that is above 0."""
    centre, cov = _moments(points, dims)
    if not np.isfinite(cov).all():
        raise ValueError("the covariance is not finite")
    cov = cov * (len(dims) + 2)
    return centre, with_least_volume(cov, least_product) if least_product > 0 else cov


def khachiyan(x: np.ndarray, tolerance: float = 1e-4, most: int = 100_000) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(centre, shape A, weights) of the smallest ellipsoid (x - c)' A (x - c) <= 1 around a few points: steps towards the farthest, and away from the nearest with weight."""
    n, d = x.shape
    q = np.column_stack([x, np.ones(n)]).T
    u = np.full(n, 1 / n)
    for _ in range(most):
        m = np.einsum("ij,ij->j", q, np.linalg.solve(q * u @ q.T, q))
        far, near = int(np.argmax(m)), int(np.argmin(np.where(u > 1e-12, m, np.inf)))
        up, down = m[far] / (d + 1) - 1, 1 - m[near] / (d + 1)
        if max(up, down) <= tolerance:
            break
        j, k = (far, m[far]) if up >= down else (near, m[near])
        step = (k - d - 1) / ((d + 1) * (k - 1))
        step = max(step, -u[j] / (1 - u[j])) if u[j] < 1 else step
        u = u * (1 - step)
        u[j] += step
    c = x.T @ u
    a = np.linalg.inv(x.T @ (u[:, None] * x) - np.outer(c, c)) / d
    return c, a, u


def smallest_ellipsoid(points: DataFrame, dims: list[str], tolerance: float = 1e-3, most_rounds: int = 100) -> tuple[np.ndarray, np.ndarray, DataFrame]:
    """(centre, shape A, the points it rests on): the ellipsoid (x - c)' A (x - c) <= 1 of least volume around all points, up to ``tolerance``.

    It rests on few points. So one aggregate a round over all points finds the farthest in many directions, the
    driver solves for the points found so far (a small multiple of d each round, those without weight are
    dropped), and it ends when no point lies outside by more than ``tolerance``; then A is
    scaled to hold all. Points within a flat subspace have no such ellipsoid and are refused.
    """
    d = len(dims)
    spark = points.sparkSession
    x = F.array(*[F.col(c).cast("double") for c in dims])
    # the first points: both ends along each axis and along fixed directions
    ways = np.vstack([np.eye(d), np.random.default_rng(0).normal(size=(2 * d, d))])
    along = lambda w: sum((F.lit(float(a)) * F.col(c) for a, c in zip(w, dims)), F.lit(0.0))
    row = points.agg(*[f(x, along(w)) for w in ways for f in (F.max_by, F.min_by)]).first()
    core = np.unique(np.array([r for r in row], float), axis=0)
    if np.linalg.matrix_rank(core - core.mean(0), tol=1e-12 * max(1.0, np.abs(core).max())) < d:
        raise ValueError("the points lie in a flat subspace")
    for _ in range(most_rounds):
        c, a, u = khachiyan(core, tolerance / 10)
        delta = [F.col(n) - F.lit(float(v)) for n, v in zip(dims, c)]
        far = sum((delta[i] * F.lit(float(a[i, j])) * delta[j] for i in range(d) for j in range(d)), F.lit(0.0))
        # the farthest of all, and the farthest on either side along each axis of the ellipsoid
        axes = np.linalg.eigh(a)[1].T
        side = lambda w: sum((F.lit(float(v)) * t for v, t in zip(w, delta)), F.lit(0.0))
        outside = F.when(far > 1, far)
        row = points.agg(F.max(far).alias("far"), F.max_by(x, far), *[F.max_by(x, F.when(s * side(w) > 0, outside)) for w in axes for s in (1.0, -1.0)]).first()
        if row["far"] <= 1 + tolerance:
            kept = spark.createDataFrame([tuple(map(float, r)) for r in core[u > 1e-6]], ", ".join(f"{n} double" for n in dims))
            return c, a / max(1.0, row["far"]) / (1 + 1e-12), kept
        core = np.unique(np.vstack([core[u > 1e-9], *[np.array(r, float) for r in row[1:] if r is not None]]), axis=0)
    raise RuntimeError("the ellipsoid did not settle")


def log_volume(a: np.ndarray) -> float:
    """Log volume of the ellipsoid (x - c)' A (x - c) <= 1."""
    d = len(a)
    return d / 2 * math.log(math.pi) - math.lgamma(d / 2 + 1) - np.linalg.slogdet(a)[1] / 2
