"""Problems rewritten so that a sampler starts near a known posterior, and checks of user functions."""

from __future__ import annotations

import math

import numpy as np

from .sampler import Problem


class _Boxed:
    """A coordinate more, s, interpolates from the tightest box (0) to the unit cube (1)."""

    def __init__(self, problem: Problem, steps: np.ndarray):
        self.problem, self.steps = problem, steps  # (levels, dims, 2), the last is the unit cube

    def boxes(self, s: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        x = s * (len(self.steps) - 1)
        k = np.minimum(x.astype(int), len(self.steps) - 2)
        f = (x - k)[:, None, None]
        b = self.steps[k] * (1 - f) + self.steps[k + 1] * f
        return b[:, :, 0], b[:, :, 1]

    def transform(self, u: np.ndarray) -> np.ndarray:
        lo, hi = self.boxes(u[:, -1])
        p = self.problem.transform(lo + (hi - lo) * u[:, :-1])
        return np.column_stack([p, np.log(hi - lo).sum(axis=1)])  # the log weight takes the place of s

    def loglike(self, p: np.ndarray) -> np.ndarray:
        return self.problem.loglike(p[:, :-1]) + p[:, -1]


def quantile_box_steps(u: np.ndarray, weights: np.ndarray, levels: tuple[float, ...] = (1e-1, 1e-3, 1e-5, 1e-7)) -> np.ndarray:
    """Boxes of decreasing tightness around weighted points of the unit cube; the last is the cube."""
    out = []
    for q in levels:
        box = []
        for x in u.T:
            order = np.argsort(x, kind="stable")
            c = np.cumsum(weights[order])
            c = c / c[-1]
            inside = x[order][(c >= q) & (c <= 1 - q)]
            box.append((inside.min(), inside.max()) if len(inside) > 1 and inside.min() < inside.max() else (x.min(), max(x.max(), x.min() + 1e-9)))
        out.append(box)
    return np.array([*out, [(0.0, 1.0)] * u.shape[1]])


def boxed_problem(problem: Problem, u: np.ndarray, weights: np.ndarray) -> Problem:
    """A problem with one more coordinate, whose parameter is the log weight of the box; the evidence stays the same."""
    b = _Boxed(problem, quantile_box_steps(u, weights))
    return Problem([*problem.names, "aux_box"], b.loglike, b.transform, problem.derived)


class _StudentT:
    def __init__(self, problem: Problem, center: np.ndarray, rotation: np.ndarray):
        self.problem, self.center, self.rotation = problem, center, rotation

    def place(self, u: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        t = np.tan(np.pi * (u - 0.5))
        x = self.center + t @ self.rotation.T
        weight = np.log1p(t * t).sum(axis=1) + np.linalg.slogdet(self.rotation)[1] + len(self.center) * math.log(math.pi)
        return x, weight

    def transform(self, u: np.ndarray) -> np.ndarray:
        x, _ = self.place(u)
        return self.problem.transform(np.clip(x, 1e-12, 1 - 1e-12))

    def evaluate(self, u: np.ndarray) -> np.ndarray:
        x, weight = self.place(u)
        inside = ((x > 0) & (x < 1)).all(axis=1)
        out = np.full(len(u), -1e100)
        if inside.any():
            out[inside] = self.problem.loglike(self.problem.transform(x[inside])) + weight[inside]
        return out


class StudentTProblem(Problem):
    """The prior drawn with Student-t tails (one degree of freedom) around a centre; the likelihood carries the log
    density ratio, so the evidence stays that of the problem."""

    def __init__(self, problem: Problem, center: np.ndarray, covariance: np.ndarray, enlarge: float = 1.0):
        s = _StudentT(problem, np.asarray(center, float), np.linalg.cholesky(np.atleast_2d(covariance)) * enlarge)
        super().__init__(problem.names, problem.loglike, s.transform, problem.derived)
        self.student = s

    def evaluate(self, u: np.ndarray) -> np.ndarray:
        return self.student.evaluate(u)


def verify_gradient(problem: Problem, gradient, n: int = 10, eps: float = 1e-6, tolerance: float = 0.1, seed: int = 1) -> bool:
    """Whether a gradient in the unit cube agrees with finite differences at random points."""
    rng = np.random.default_rng(seed)
    d = len(problem.names)
    u = rng.uniform(eps, 1 - eps, (n, d))
    base = problem.evaluate(u)
    g = np.asarray([gradient(x) for x in u])
    for k in range(d):
        step = np.zeros(d)
        step[k] = eps
        diff = (problem.evaluate(u + step) - base) / eps
        if (np.abs(diff - g[:, k]) > tolerance / d * np.maximum(1, np.abs(diff))).any():
            return False
    return True


def positive_eigenvalues(cov: np.ndarray, target_product: float) -> np.ndarray:
    """Raises near-zero eigenvalues alike, so that their product is ``target_product``."""
    val, vec = np.linalg.eigh(cov)
    low = val < max(val.max(), 0) * 1e-10
    if not low.any():
        return cov
    rest = np.prod(val[~low]) if (~low).any() else 1.0
    val = np.where(low, (target_product / rest) ** (1 / low.sum()), val)
    return (vec * val) @ vec.T
