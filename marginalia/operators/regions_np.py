"""Small dense state of a region, kept on the driver and shipped to tasks.

It holds the live points of one run (a few thousand by design), never data.
"""

from __future__ import annotations

import numpy as np


def affine_layer(u: np.ndarray, offsets: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Centre, whitening matrix and its inverse. ``offsets`` (points minus a local or cluster mean) give the covariance."""
    c = u.mean(axis=0)
    x = (u - c) if offsets is None else offsets
    d = u.shape[1]
    cov = np.atleast_2d(np.cov(x, rowvar=False)) * (d + 2)
    val, vec = np.linalg.eigh(cov)
    val = np.maximum(val, max(1e-300, val.max() * 1e-12))
    t = vec / np.sqrt(val)
    return c, t, np.linalg.inv(t)


def sq_distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.maximum(0, (a * a).sum(1)[:, None] + (b * b).sum(1)[None, :] - 2 * a @ b.T)


def cluster_ids(t: np.ndarray, sq_radius: float) -> np.ndarray:
    """Single linkage; each cluster is named by its first member."""
    label = np.arange(len(t))
    near = sq_distances(t, t) <= sq_radius
    while True:
        new = np.where(near, label[None, :], len(t)).min(axis=1)
        new = new[new]
        if (new == label).all():
            return label
        label = new


def largest_gap_cut(x: np.ndarray) -> float:
    """Middle of the largest gap of circular values."""
    s = np.r_[0.0, np.sort(x), 1.0]
    k = int(np.argmax(np.diff(s)))
    return float((s[k] + s[k + 1]) / 2)


def principal_gap(u: np.ndarray) -> tuple[np.ndarray, float]:
    """Halves (0 or 1) on the two sides of the largest gap along the principal axis, and the gap."""
    x = u - u.mean(axis=0)
    along = x @ np.linalg.eigh(np.atleast_2d(np.cov(x, rowvar=False)))[1][:, -1]
    order = np.argsort(along, kind="stable")
    gaps = np.diff(along[order])
    k = int(np.argmax(gaps))
    half = np.zeros(len(u), int)
    half[order[k + 1 :]] = 1
    return half, float(gaps[k])


def gap_offsets(u: np.ndarray, clusters: np.ndarray) -> np.ndarray:
    """Points minus the mean of their half of their cluster: what a layer split at principal gaps takes its covariance from."""
    out = np.zeros_like(u)
    for c in np.unique(clusters):
        own = np.flatnonzero(clusters == c)
        half = principal_gap(u[own])[0] if len(own) > 2 else np.zeros(len(own), int)
        for h in np.unique(half):
            at = own[half == h]
            out[at] = u[at] - u[at].mean(axis=0)
    return out


def axis_enlargement(kept: np.ndarray, held: np.ndarray, sum_points: bool = False) -> float:
    """How far an axis-aligned ellipsoid around ``kept`` must grow for ``held``: the greatest sum over axes of
    squared deviations over variances, or with ``sum_points`` the greatest sum over points for one axis."""
    var = np.maximum(kept.var(axis=0, ddof=1), 1e-300) * (kept.shape[1] + 2)
    return float(((held - kept.mean(axis=0)) ** 2 / var).sum(axis=0 if sum_points else 1).max())


class WrappingEllipsoid:
    """An ellipsoid around points in parameter space; parameters that do not vary must match exactly."""

    def __init__(self, p: np.ndarray, rng: np.random.Generator | None = None, bootstraps: int = 50):
        self.p = p
        self.varies = np.ptp(p, axis=0) > 0
        self.fixed = p[0, ~self.varies]
        self.update(p)
        self.enlarge = max(1.0, float(self._apart(p).max(initial=0)))
        for _ in range(bootstraps if rng is not None and self.varies.any() else 0):
            kept = np.zeros(len(p), bool)
            kept[rng.integers(0, len(p), len(p))] = True
            if kept.all() or kept.sum() <= self.varies.sum() + 1:
                continue
            self.update(p[kept])
            self.enlarge = max(self.enlarge, float(self._apart(p[~kept]).max()))
        self.update(p)

    def update(self, p: np.ndarray) -> None:
        """Centre and covariance from ``p``."""
        v = p[:, self.varies]
        self.center = v.mean(axis=0)
        self.inv_cov = np.linalg.pinv(np.atleast_2d(np.cov(v, rowvar=False)) * (v.shape[1] + 2)) if v.shape[1] else np.zeros((0, 0))

    def _apart(self, p: np.ndarray) -> np.ndarray:
        x = p[:, self.varies] - self.center
        return np.einsum("ij,jk,ik->i", x, self.inv_cov, x)

    def inside(self, p: np.ndarray) -> np.ndarray:
        return (p[:, ~self.varies] == self.fixed).all(axis=1) & (self._apart(p) <= self.enlarge)


def bootstrap_enlargements(spark, u: np.ndarray, n: int = 30, kind: str = "friends", seed: int = 1):
    """(boot_id, sq_radius, enlarge): one row for each bootstrap, made in tasks. What is shipped is the live points, a few thousand by design."""
    import pyarrow as pa

    center, t_matrix, _ = affine_layer(u)
    t, cast = (u - center) @ t_matrix, spark.sparkContext.broadcast(u)

    def work(batches):
        points = cast.value
        for b in batches:
            rows = []
            for i in b.column(0).to_pylist():
                kept = np.zeros(len(points), bool)
                kept[np.random.default_rng([seed, i]).integers(0, len(points), len(points))] = True
                if kept.all() or kept.sum() <= points.shape[1] + 1:
                    rows.append((i, 0.0, 1.0))
                    continue
                sq = float(sq_distances(t[~kept], t[kept]).min(axis=1).max())
                if kind == "axes":
                    far = axis_enlargement(points[kept], points[~kept])
                else:
                    x = points[~kept] - points[kept].mean(axis=0)
                    inv = np.linalg.pinv(np.atleast_2d(np.cov(points[kept], rowvar=False)) * (points.shape[1] + 2))
                    far = float(np.einsum("ij,jk,ik->i", x, inv, x).max())
                rows.append((i, sq, max(1.0, far)))
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), (pa.int64(), pa.float64(), pa.float64()))], names=["boot_id", "sq_radius", "enlarge"])

    return spark.range(n, numPartitions=min(n, spark.sparkContext.defaultParallelism)).mapInArrow(work, "boot_id long, sq_radius double, enlarge double")


class Region:
    """Union of balls around the live points in whitened space, within a bounding ellipsoid.

    kind: "friends" (both), "ellipsoid" (ellipsoid only) or "axes" (axis-aligned ellipsoid)."""

    def __init__(self, u: np.ndarray, rng: np.random.Generator, kind: str = "friends", bootstraps: int = 30, local: bool = True):
        self.u, self.kind = u, kind
        n, d = u.shape
        self.center, self.t_matrix, self.t_inverse = affine_layer(u)
        t = self.transform(u)
        if local and d > 1 and kind == "friends":
            sq = sq_distances(t, t)
            np.fill_diagonal(sq, np.inf)
            near = sq_distances(t, t) <= sq.min(axis=1).max()
            offsets = u - (near @ u) / near.sum(axis=1, keepdims=True)
            if np.linalg.matrix_rank(offsets) == d:
                self.center, self.t_matrix, self.t_inverse = affine_layer(u, offsets)
                t = self.transform(u)
        self.t = t
        cov = np.atleast_2d(np.cov(u, rowvar=False)) * (d + 2)
        if kind == "axes":
            cov = np.diag(np.diag(cov))
        self.inv_cov = np.linalg.pinv(cov)
        self.axes = np.linalg.cholesky(cov + np.eye(d) * 1e-300)
        self.mean = u.mean(axis=0)
        self.sq_radius, self.enlarge = 0.0, 1.0
        for _ in range(bootstraps):
            kept = np.zeros(n, bool)
            kept[rng.integers(0, n, n)] = True
            if kept.all() or kept.sum() <= d + 1:
                continue
            self.sq_radius = max(self.sq_radius, float(sq_distances(t[~kept], t[kept]).min(axis=1).max()))
            c = np.atleast_2d(np.cov(u[kept], rowvar=False)) * (d + 2)
            if kind == "axes":
                c = np.diag(np.diag(c))
            x = u[~kept] - u[kept].mean(axis=0)
            self.enlarge = max(self.enlarge, float(np.einsum("ij,jk,ik->i", x, np.linalg.pinv(c), x).max()))
        x = u - self.mean
        self.enlarge = max(self.enlarge, float(np.einsum("ij,jk,ik->i", x, self.inv_cov, x).max()))
        self.clusters = cluster_ids(t, self.sq_radius) if kind == "friends" else np.zeros(n, int)

    def transform(self, u: np.ndarray) -> np.ndarray:
        return (u - self.center) @ self.t_matrix

    def untransform(self, t: np.ndarray) -> np.ndarray:
        return t @ self.t_inverse + self.center

    def in_ellipsoid(self, u: np.ndarray) -> np.ndarray:
        x = u - self.mean
        return np.einsum("ij,jk,ik->i", x, self.inv_cov, x) <= self.enlarge

    def inside(self, u: np.ndarray) -> np.ndarray:
        """Cheap test first: the ellipsoid, then a neighbour within the radius."""
        ok = self.in_ellipsoid(u)
        if self.kind == "friends" and ok.any():
            i = np.flatnonzero(ok)
            ok[i] = sq_distances(self.transform(u[i]), self.t).min(axis=1) <= self.sq_radius
        return ok

    def log_volume(self) -> float:
        sign, logdet = np.linalg.slogdet(np.linalg.pinv(self.inv_cov))
        return 0.5 * logdet + 0.5 * len(self.mean) * np.log(self.enlarge) if sign > 0 else -1e300

    def log_volume_of_balls(self) -> float:
        """Of one ball of the region, in unit cube coordinates: the volume of the whitening times the radius to the dimension."""
        return float(np.linalg.slogdet(self.t_inverse)[1] + 0.5 * len(self.mean) * np.log(self.sq_radius))

    def inside_or_near(self, u: np.ndarray, old: np.ndarray) -> np.ndarray:
        """In the region, or within its radius of the point it came from."""
        near = ((self.transform(u) - self.transform(old)) ** 2).sum(axis=1) <= self.sq_radius
        return near | self.inside(u)

    def refreshed(self, u: np.ndarray, rng: np.random.Generator, bootstraps: int = 30) -> tuple["Region", bool]:
        """A region around ``u``, and whether it was taken: it must be sound, hold all its points and be no larger, unless the old one lost some."""
        if len(u) <= u.shape[1] or np.linalg.matrix_rank(u - u.mean(axis=0)) < u.shape[1]:
            return self, False
        new = Region(u, rng, self.kind, bootstraps)
        sound = np.isfinite(new.log_volume()) and new.enlarge > 0 and (self.kind != "friends" or new.sq_radius > 0) and bool(new.inside(u).all())
        if sound and (new.log_volume() <= self.log_volume() or not self.inside(u).all()):
            return new, True
        return self, False

    def sample(self, n: int, rng: np.random.Generator, method: str = "auto") -> np.ndarray:
        """Points uniform in the region (fewer than ``n``): from balls, cube, whitened box or ellipsoid."""
        d = self.u.shape[1]
        if method == "auto":
            method = "ellipsoid" if self.kind != "friends" or rng.random() < 0.5 else "balls"
        if method == "cube":
            u = rng.random((n, d))
        elif method == "balls":
            v = rng.normal(size=(n, d))
            v *= (rng.random(n) ** (1 / d) * np.sqrt(self.sq_radius) / np.sqrt((v * v).sum(axis=1)))[:, None]
            t = self.t[rng.integers(0, len(self.t), n)] + v
            cover = (sq_distances(t, self.t) <= self.sq_radius * (1 + 1e-9)).sum(axis=1)
            u = self.untransform(t[rng.random(n) * np.maximum(1, cover) < 1])
        elif method == "box":
            r = np.sqrt(self.sq_radius)
            u = self.untransform(rng.uniform(self.t.min(axis=0) - r, self.t.max(axis=0) + r, (n, d)))
        else:
            v = rng.normal(size=(n, d))
            v *= (rng.random(n) ** (1 / d) / np.sqrt((v * v).sum(axis=1)))[:, None]
            u = self.mean + np.sqrt(self.enlarge) * v @ self.axes.T
        u = u[((u > 0) & (u < 1)).all(axis=1)]
        return u[self.inside(u)] if len(u) else u
