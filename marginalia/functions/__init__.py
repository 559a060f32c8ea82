"""Column functions: log space, geometry of the unit cube, priors."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def logaddexp(a, b) -> Column:
    a, b = _c(a), _c(b)
    return F.greatest(a, b) + F.log1p(F.exp(-F.abs(a - b)))


def logsumexp(x, peak: Column | float) -> Column:
    """Aggregate: ln of the sum of exp(x), with a known upper bound of about its size."""
    m = peak if isinstance(peak, Column) else F.lit(float(peak))
    return F.max(m) + F.log(F.sum(F.exp(_c(x) - m)))


def ess(w) -> Column:
    """Aggregate: effective sample size of weights, whatever their sum."""
    w = _c(w)
    return F.pow(F.sum(w), 2) / F.sum(w * w)


def safe_logl(logl) -> Column:
    """Non-finite likelihoods become -1e100."""
    x = _c(logl)
    return F.when(x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")), F.lit(-1e100)).otherwise(x)


def within_unit_cube(u) -> Column:
    """All coordinates strictly between 0 and 1."""
    return F.forall(_c(u), lambda x: (x > 0) & (x < 1))


def mahalanobis_sq(u, center: list[float], inv_cov: list[list[float]]) -> Column:
    """(u - c)' A (u - c) as one expression; meant for a few dimensions."""
    d = [F.element_at(_c(u), i + 1) - F.lit(float(c)) for i, c in enumerate(center)]
    total = F.lit(0.0)
    for i, row in enumerate(inv_cov):
        for j, a in enumerate(row):
            total = total + d[i] * F.lit(float(a)) * d[j]
    return total


def inside_ellipsoid(u, center, inv_cov, sq_radius: float = 1.0) -> Column:
    return mahalanobis_sq(u, center, inv_cov) <= F.lit(float(sq_radius))


def wrap(u, cut: float) -> Column:
    """Shift a circular coordinate so that ``cut`` becomes 0."""
    return (_c(u) + F.lit(1.0 - cut)) % F.lit(1.0)


def unwrap(u, cut: float) -> Column:
    return (_c(u) + F.lit(float(cut))) % F.lit(1.0)


def scale(u, mean: list[float], std: list[float]) -> Column:
    """Whitening axis by axis."""
    m, s = F.array(*map(F.lit, mean)), F.array(*map(F.lit, std))
    return F.zip_with(F.zip_with(_c(u), m, lambda x, y: x - y), s, lambda x, y: x / y)


def unscale(t, mean: list[float], std: list[float]) -> Column:
    m, s = F.array(*map(F.lit, mean)), F.array(*map(F.lit, std))
    return F.zip_with(F.zip_with(_c(t), s, lambda x, y: x * y), m, lambda x, y: x + y)


def affine(u, center: list[float], matrix: list[list[float]]) -> Column:
    """(u - c) T, a small dense transform."""
    d = [F.element_at(_c(u), i + 1) - F.lit(float(c)) for i, c in enumerate(center)]
    return F.array(*[sum((d[i] * F.lit(float(matrix[i][j])) for i in range(len(d))), F.lit(0.0)) for j in range(len(matrix[0]))])


def affine_inverse(t, center: list[float], inverse: list[list[float]]) -> Column:
    d = [F.element_at(_c(t), i + 1) for i in range(len(center))]
    return F.array(*[sum((d[i] * F.lit(float(inverse[i][j])) for i in range(len(d))), F.lit(float(center[j]))) for j in range(len(center))])


def unit_ball_volume(d: int) -> float:
    return math.pi ** (d / 2) / math.gamma(d / 2 + 1)


# priors: from a unit-interval coordinate to a parameter

def uniform_prior(u, lo: float, hi: float) -> Column:
    return F.lit(float(lo)) + (F.lit(float(hi)) - F.lit(float(lo))) * _c(u)


def log_uniform_prior(u, lo: float, hi: float) -> Column:
    return F.pow(F.lit(10.0), uniform_prior(u, math.log10(lo), math.log10(hi)))


def cauchy_prior(u, loc: float, width: float) -> Column:
    """Student-t with one degree of freedom."""
    return F.lit(float(loc)) + F.lit(float(width)) * F.tan(F.lit(math.pi) * (_c(u) - 0.5))


def dirichlet_flat(*us) -> list[Column]:
    """Uniform on the simplex: normalised exponentials."""
    e = [-F.log(_c(u)) for u in us]
    total = sum(e[1:], e[0])
    return [x / total for x in e]


def t_logpdf(x, df: float) -> Column:
    """Log density of Student's t with ``df`` degrees of freedom."""
    const = math.lgamma((df + 1) / 2) - math.lgamma(df / 2) - 0.5 * math.log(df * math.pi)
    return F.lit(const) - F.lit((df + 1) / 2) * F.log1p(_c(x) * _c(x) / F.lit(float(df)))


# lines and boxes, for slice steps

def line_to_cube(x: list, v: list, lo: float = 0.0, hi: float = 1.0) -> tuple[Column, Column]:
    """The parameters t at which x + t v leaves the box backwards and forwards."""
    back, ahead = [], []
    for a, b in zip(map(_c, x), map(_c, v)):
        t1, t2 = (F.lit(lo) - a) / b, (F.lit(hi) - a) / b
        moves = b != 0
        back.append(F.when(moves, F.least(t1, t2)))
        ahead.append(F.when(moves, F.greatest(t1, t2)))
    return (F.greatest(*back) if len(back) > 1 else back[0]), (F.least(*ahead) if len(ahead) > 1 else ahead[0])
