"""Student's t, the incomplete beta function and normal quantiles as column expressions.

The incomplete beta as a column is a fold over a sequence inside the expression. The distribution
function and the quantiles of t run over Arrow batches with numpy, where rows that are done leave. The continued fraction of the incomplete beta converges fast where x is
below the mean of the beta distribution; the other side comes from the symmetry
I_x(a, b) = 1 - I_(1-x)(b, a).
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

#: Steps of the continued fraction: enough for a relative 1e-12 up to several hundred degrees of freedom.
STEPS = 120
#: Bounded Newton steps; each halves the bracket at least.
NEWTON = 60
TINY = 1e-300


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def _let(value: Column, body) -> Column:
    """body(value) with the value computed once, however often the body names it."""
    return F.element_at(F.transform(F.array(value), body), 1)


def _fraction(x: Column, a: float, b: float) -> Column:
    """The continued fraction of the incomplete beta function by the modified Lentz method: pairs of even and odd steps."""
    away = lambda v: F.when(F.abs(v) < TINY, F.lit(TINY)).otherwise(v)
    state = lambda c, d, h, last: F.struct(c.alias("c"), d.alias("d"), h.alias("h"), last.alias("last"))

    def term(k: Column) -> Column:
        """The coefficients of steps 2m (k = 2m) and 2m + 1 (k = 2m + 1)."""
        m = F.floor(k / 2).cast("double")
        even = m * (F.lit(b) - m) * x / ((F.lit(a - 1) + 2 * m) * (F.lit(a) + 2 * m))
        odd = -(F.lit(a) + m) * (F.lit(a + b) + m) * x / ((F.lit(a) + 2 * m) * (F.lit(a + 1) + 2 * m))
        return F.when(k % 2 == 0, even).otherwise(odd)

    def half(s: Column, k: Column) -> Column:
        pair = lambda t: F.struct((F.lit(1.0) / away(F.lit(1.0) + t * s["d"])).alias("d"), away(F.lit(1.0) + t / s["c"]).alias("c"))
        # done when the last factor, of an odd step, was 1
        moved = _let(_let(term(k), pair), lambda n: state(n["c"], n["d"], s["h"] * n["d"] * n["c"], F.when(k % 2 == 1, F.abs(n["d"] * n["c"] - 1)).otherwise(F.lit(1.0))))
        return F.when(s["last"] < 1e-15, s).otherwise(moved)

    # the first step (k = 1) is the start
    start = _let(F.lit(1.0) / away(F.lit(1.0) - F.lit((a + b) / (a + 1)) * x), lambda d: state(F.lit(1.0), d, d, F.lit(1.0)))
    return F.aggregate(F.sequence(F.lit(2), F.lit(2 * STEPS + 1)), start, half, lambda s: s["h"])


def incomplete_beta(x, a: float, b: float) -> Column:
    """The regularised incomplete beta function I_x(a, b) for x from 0 to 1."""
    x = _c(x).cast("double")
    log_b = math.lgamma(a) + math.lgamma(b) - math.lgamma(a + b)

    def low(v: Column, p: float, q: float) -> Column:
        return F.exp(F.lit(p) * F.log(v) + F.lit(q) * F.log1p(-v) - F.lit(log_b)) * _fraction(v, p, q) / F.lit(p)

    return F.when(x <= 0, F.lit(0.0)).when(x >= 1, F.lit(1.0)).when(x < F.lit((a + 1) / (a + b + 2)), low(x, a, b)).otherwise(F.lit(1.0) - low(F.lit(1.0) - x, b, a))


def _fractions(x: np.ndarray, a: float, b: float) -> np.ndarray:
    """_fraction() of many numbers."""
    away = lambda v: np.where(np.abs(v) < TINY, TINY, v)
    out, at = np.empty(len(x)), np.arange(len(x))
    c, d = np.ones(len(x)), 1 / away(1 - (a + b) / (a + 1) * x)
    h = d.copy()
    for m in range(1, STEPS + 1):
        for t in (m * (b - m) * x / ((a - 1 + 2 * m) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 1 + 2 * m))):
            d, c = 1 / away(1 + t * d), away(1 + t / c)
            h = h * d * c
        done = np.abs(d * c - 1) < 1e-15
        if done.any():
            out[at[done]] = h[done]
            at, x, c, d, h = (v[~done] for v in (at, x, c, d, h))
        if not len(at):
            break
    out[at] = h
    return out


def _betas(x: np.ndarray, a: float, b: float) -> np.ndarray:
    """incomplete_beta() of many numbers."""
    log_b = math.lgamma(a) + math.lgamma(b) - math.lgamma(a + b)

    def low(v: np.ndarray, p: float, q: float) -> np.ndarray:
        return np.exp(p * np.log(v) + q * np.log1p(-v) - log_b) * _fractions(v, p, q) / p

    out = np.where(x <= 0, 0.0, 1.0)
    left = (x > 0) & (x < (a + 1) / (a + b + 2))
    right = (x < 1) & (x >= (a + 1) / (a + b + 2))
    out[left], out[right] = low(x[left], a, b), 1 - low(1 - x[right], b, a)
    return out


def _half_tails(v: np.ndarray, df: float) -> np.ndarray:
    """P(T > v) for v >= 0."""
    square = v * v
    near = square < df
    out = np.empty(len(v))
    out[near] = 0.5 - _betas(square[near] / (df + square[near]), 0.5, df / 2) / 2
    out[~near] = _betas(df / (df + square[~near]), df / 2, 0.5) / 2
    return out


def _quantiles(q: np.ndarray, df: float, steps: int) -> np.ndarray:
    """v >= 0 with P(T > v) = q, for q from 0 to 1/2, both excluded: bracketed Newton steps on the logarithm of the tail."""
    # a tail is at most that of its leading power, so this bounds the quantile from above
    lead = math.lgamma((df + 1) / 2) - math.lgamma(df / 2) + (df / 2 - 1) * math.log(df) - math.log(math.pi) / 2
    const = math.lgamma((df + 1) / 2) - math.lgamma(df / 2) - 0.5 * math.log(df * math.pi)
    lo, hi = np.zeros(len(q)), np.exp((lead - np.log(q)) / df) + 1
    v = np.minimum(hi / 2, np.sqrt(-2 * np.log(q)))
    out, at = np.empty(len(q)), np.arange(len(q))
    for _ in range(steps):
        tail = _half_tails(v, df)
        above = tail > q
        lo, hi = np.where(above, v, lo), np.where(above, hi, v)
        with np.errstate(all="ignore"):
            new = v + tail * np.log(tail / q) / np.exp(const - (df + 1) / 2 * np.log1p(v * v / df))
        new = np.where((new > lo) & (new < hi), new, (lo + hi) / 2)
        new = np.where(tail == q, v, new)
        done = np.abs(new - v) <= 1e-15 * np.abs(new)
        out[at[done]] = new[done]
        at, q, lo, hi, v = (x[~done] for x in (at, q, lo, hi, new))
        if not len(at):
            break
    out[at] = v
    return out


def _numbers(x: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The numbers of an array, and which of them are null."""
    return x.fill_null(float("nan")).to_numpy(zero_copy_only=False).astype(np.float64), x.is_null().to_numpy(zero_copy_only=False)


def t_cdf(x, df: float) -> Column:
    """The distribution function of Student's t; ``df`` any positive number."""
    df = float(df)

    def run(x: pa.Array) -> pa.Array:
        v, null = _numbers(x)
        out, known = np.full(len(v), np.nan), ~np.isnan(v)
        square, some = v[known] * v[known], v[known]
        tail = np.zeros(len(some))
        finite = np.isfinite(square)
        tail[finite] = _half_tails(np.abs(some[finite]), df)
        out[known] = np.where(some >= 0, 1 - tail, tail)
        return pa.array(out, mask=null)

    run.__annotations__ = {"x": pa.Array, "return": pa.Array}
    return F.arrow_udf(run, DoubleType())(_c(x).cast("double"))


def t_pdf(x, df: float) -> Column:
    x = _c(x)
    const = math.lgamma((df + 1) / 2) - math.lgamma(df / 2) - 0.5 * math.log(df * math.pi)
    return F.exp(F.lit(const) - F.lit((df + 1) / 2) * F.log1p(x * x / F.lit(float(df))))


def t_ppf(p, df: float, steps: int = NEWTON) -> Column:
    """The quantile function of Student's t: 0 and 1 give infinities, numbers outside them null.

    Closed forms for 1 and 2 degrees of freedom. Otherwise the tail's quantile, by Newton steps on the
    logarithm of the tail that are taken only inside a bracket, which each step makes smaller.
    """
    p = _c(p).cast("double")
    q = F.least(p, F.lit(1.0) - p)  # the tail beyond |t|
    sign = F.when(p < 0.5, F.lit(-1.0)).otherwise(F.lit(1.0))
    if df == 1:
        t = F.lit(1.0) / F.tan(F.lit(math.pi) * q)
    elif df == 2:
        t = (F.lit(1.0) - 2 * q) / F.sqrt(2 * q * (F.lit(1.0) - q))
    else:
        own = float(df)

        def run(q: pa.Array) -> pa.Array:
            v, _ = _numbers(q)
            inside = (v > 0) & (v < 0.5)
            out = np.zeros(len(v))
            out[inside] = _quantiles(v[inside], own, steps)
            return pa.array(out)

        run.__annotations__ = {"q": pa.Array, "return": pa.Array}
        t = F.arrow_udf(run, DoubleType())(q)
    value = F.when(q == 0.5, F.lit(0.0)).otherwise(sign * t)
    return F.when((p > 0) & (p < 1), value).when(p == 0, F.lit(-math.inf)).when(p == 1, F.lit(math.inf))


def t_truncated(u, df: float, lo: float, hi: float) -> Column:
    """A draw of Student's t between ``lo`` and ``hi`` from a unit-interval number, by the quantile of its share of that mass."""
    if not lo < hi:
        raise ValueError("the lower end must lie below the upper one")
    a, b = (t_cdf(F.lit(float(v)), df) if math.isfinite(v) else F.lit(0.0 if v < 0 else 1.0) for v in (lo, hi))
    x = t_ppf(a + (b - a) * _c(u), df)
    return F.greatest(F.least(x, F.lit(float(hi))), F.lit(float(lo)))


#: Coefficients of a rational approximation to the normal quantile (relative error 1.15e-9), in descending powers.
_CENTRE_UP = [-3.969683028665376e01, 2.209460984245205e02, -2.759285104469687e02, 1.383577518672690e02, -3.066479806614716e01, 2.506628277459239e00]
_CENTRE_DOWN = [-5.447609879822406e01, 1.615858368580409e02, -1.556989798598866e02, 6.680131188771972e01, -1.328068155288572e01, 1.0]
_TAIL_UP = [-7.784894002430293e-03, -3.223964580411365e-01, -2.400758277161838e00, -2.549732539343734e00, 4.374664141464968e00, 2.938163982698783e00]
_TAIL_DOWN = [7.784695709041462e-03, 3.224671290700398e-01, 2.445134137142996e00, 3.754408661907416e00, 1.0]


def _polynomial(x: Column, powers: list[float]) -> Column:
    out = F.lit(powers[0])
    for k in powers[1:]:
        out = out * x + F.lit(k)
    return out


def normal_ppf(p, mean: float = 0.0, std: float = 1.0) -> Column:
    """Quantiles of a normal distribution, to a relative error of 1.2e-9: 0 and 1 give infinities."""
    p = _c(p).cast("double")
    q = F.least(p, F.lit(1.0) - p)
    r = p - 0.5
    centre = r * _polynomial(r * r, _CENTRE_UP) / _polynomial(r * r, _CENTRE_DOWN)
    s = F.sqrt(-2 * F.log(q))
    tail = _polynomial(s, _TAIL_UP) / _polynomial(s, _TAIL_DOWN)
    z = F.when(q >= 0.02425, centre).otherwise(F.when(p < 0.5, tail).otherwise(-tail))
    return F.lit(float(mean)) + F.lit(float(std)) * F.when((p > 0) & (p < 1), z).when(p == 0, F.lit(-math.inf)).when(p == 1, F.lit(math.inf))
