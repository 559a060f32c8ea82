import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from marginalia.functions.priors import correlated_gaussian, empirical_prior, quantile_table
from marginalia.operators import enclosing as en
from marginalia.operators.reweight import reuse_in_batches
from marginalia.operators.strategy import independent_start, least_width, width_for_error


def by_loop(logl, logw, new, batch, threshold):
    """Weights batch by batch until one has nothing to add, and the closed sums over all of them."""
    n = len(logl)
    order = np.lexsort((np.arange(n), -(logl + logw)))
    lw, used = np.full(n, -np.inf), 0
    for k in range(0, n, batch):
        own = order[k : k + batch]
        lw[own] = logw[own] + new[own]
        used += len(own)
        if (lw[own] < lw.max() - math.log(n) + threshold).all():
            break
    w = np.exp(lw - lw.max())
    logz = math.log(w.sum()) + lw.max()
    w /= w.sum()
    return used, logz, math.log1p(math.sqrt(((w - 1 / n) ** 2).sum() / (n - 1))), n / (1 + ((n * w - 1) ** 2).sum() / n), w


@pytest.mark.parametrize(("n", "batch"), [(5000, 64), (300, 128), (1, 10)])
def test_reuse_stops_where_the_rest_cannot_matter(spark, n, batch):
    x = np.linspace(-8, 8, n) if n > 1 else np.array([0.3])
    logl, logw, new = -0.5 * x * x, np.full(n, -math.log(n)), -0.5 * (x - 0.3) ** 2 * 1.2
    df = spark.createDataFrame(pd.DataFrame({"i": np.arange(n), "x": x, "logl": logl, "logw": logw}))
    rows, result = reuse_in_batches(df, -0.5 * (F.col("x") - 0.3) * (F.col("x") - 0.3) * 1.2, "i", batch, -10.0, 2)
    used, logz, err, ess, w = by_loop(logl, logw, new, batch, -10.0) if n > 1 else (1, new[0], 0.0, 1.0, np.ones(1))
    r = result.first()
    assert (r["n"], r["used"]) == (n, used) and r["used"] <= r["evaluated"] and r["i"] == int(np.argmax(new))
    assert (n < 5000) or r["evaluated"] < n
    assert r["logz"] == pytest.approx(logz, abs=1e-9) and r["logzerr"] == pytest.approx(err, abs=1e-9) and r["ess"] == pytest.approx(ess)
    got = rows.orderBy("i").toPandas()
    assert np.allclose(got["weight"], w) and got["logl_new"].isna().sum() == n - used
    whole = np.log(np.exp(logw + new).sum())
    assert abs(whole - logz) < math.exp(-9)


def test_a_floor_among_thousands_of_widths(spark):
    n = 3000
    df = spark.createDataFrame(pd.DataFrame({"nlive": np.arange(1, n + 1), "nchild": (np.arange(n) % 3 > 0).astype(int)}))
    errors = {f: math.sqrt(sum(1 / max(k, f) ** 2 for k in range(1, n + 1))) for f in range(1, n + 1) if (f - 1) % 3 > 0}
    for goal in (0.5, 0.05, 0.0185):
        want = min((f for f in errors if errors[f] < goal), default=None)
        assert least_width(df, goal).first()["width"] == want
    few = [2000, 2500, 2999]
    assert {r["floor"]: r["enough"] for r in width_for_error(df, 0.02, few).collect()} == {f: math.sqrt(sum(1 / max(k, f) ** 2 for k in range(1, n + 1))) < 0.02 for f in few}


def test_empirical_priors(spark):
    rng = np.random.default_rng(2)
    x = np.r_[rng.gamma(2, size=5000), np.full(50, 1.5)]
    table = quantile_table(spark.createDataFrame(pd.DataFrame({"x": x})), "x")
    draws = spark.range(100_000).select("id", (F.col("id") / 99_999.0).alias("u"), F.lit(1).alias("lo"))
    got = empirical_prior(draws, "u", table, "p").orderBy("id").toPandas()
    assert len(got) == 100_000 and np.allclose(got["p"], np.interp(got["u"], np.linspace(0, 1, len(x)), np.sort(x)), atol=1e-9)
    w = np.r_[rng.random(5000), np.zeros(50)]
    weighted = empirical_prior(draws, "u", quantile_table(spark.createDataFrame(pd.DataFrame({"x": x, "w": w})), "x", "w"), "p", 64).orderBy("id").toPandas()
    at = np.argsort(x[:5000])
    c = np.r_[0, np.cumsum(w[:5000][at])[:-1]]
    assert np.allclose(weighted["p"], np.interp(weighted["u"], c / c[-1], x[:5000][at]), atol=1e-6)
    one = empirical_prior(draws.limit(5), "u", quantile_table(spark.createDataFrame([(2.5,)], "x double"), "x"), "p").collect()
    assert [r["p"] for r in one] == [2.5] * 5


def test_correlated_gaussians(spark):
    cov = [[2.0, 0.6, -0.3], [0.6, 1.0, 0.2], [-0.3, 0.2, 0.5]]
    u = spark.createDataFrame(pd.DataFrame(np.random.default_rng(3).random((40_000, 3)), columns=list("abc")))
    x = u.select(*[c.alias(n) for c, n in zip(correlated_gaussian([F.col(n) for n in "abc"], [1.0, -2.0, 0.0], cov), "abc")]).toPandas().to_numpy()
    assert np.allclose(x.mean(0), [1, -2, 0], atol=0.03) and np.allclose(np.cov(x.T), cov, atol=0.05)
    with pytest.raises(ValueError):
        correlated_gaussian([F.col("a"), F.col("b")], [0.0, 0.0], [[1.0, 2.0], [2.0, 1.0]])


def test_an_independent_start_keeps_the_evidence(spark):
    """The mean of exp(weight) over uniform coordinates, times the density at the centre over the mass in the cube, is the cube's volume."""
    d = spark.range(20_000).select(((F.col("id") + 0.5) / 20_000).alias("u"))
    for df in (1, 5):
        (x,), weight = independent_start([F.col("u")], [0.6], [0.05], df)
        got = d.select(x.alias("x"), weight.alias("w")).toPandas()
        assert got["x"].between(0, 1).all() and got["w"].min() >= -1e-12
        c = math.exp(math.lgamma((df + 1) / 2) - math.lgamma(df / 2)) / math.sqrt(df * math.pi) / 0.05
        grid = (np.arange(20_000) + 0.5) / 20_000
        mass = (c * (1 + ((grid - 0.6) / 0.05) ** 2 / df) ** (-(df + 1) / 2)).mean()
        assert np.exp(got["w"]).mean() * mass / c == pytest.approx(1, rel=0.01)


def test_smallest_ellipsoids(spark):
    rng = np.random.default_rng(4)
    for d, x in ((2, rng.normal(size=(3000, 2)) @ [[2, 0.5], [0, 0.3]]), (3, rng.random((3000, 3))), (5, rng.normal(size=(500, 5)))):
        dims = [f"x{k}" for k in range(d)]
        c, a, kept = en.smallest_ellipsoid(spark.createDataFrame(pd.DataFrame(x, columns=dims)), dims)
        r = np.einsum("ij,jk,ik->i", x - c, a, x - c)
        assert r.max() <= 1 and r.max() > 0.99
        whole = en.khachiyan(x, 1e-4)[1]
        out = np.einsum("ij,jk,ik->i", x - en.khachiyan(x, 1e-4)[0], whole, x - en.khachiyan(x, 1e-4)[0]).max()
        assert abs(en.log_volume(a) - en.log_volume(whole / out)) < 0.01 and kept.count() <= d * (d + 3) // 2 + d
    with pytest.raises(ValueError):
        en.smallest_ellipsoid(spark.createDataFrame(pd.DataFrame({"a": [0.0, 1.0, 2.0], "b": [0.0, 1.0, 2.0]})), ["a", "b"])


def test_flat_axes_are_widened(spark):
    x = np.random.default_rng(5).normal(size=(200, 3))
    x[:, 2] = x[:, 0]
    df = spark.createDataFrame(pd.DataFrame(x, columns=list("abc")))
    c, cov = en.bounding_ellipsoid(df, list("abc"))
    assert np.allclose(c, x.mean(0)) and np.allclose(cov, np.cov(x.T) * 5) and np.linalg.eigvalsh(cov)[0] < 1e-10
    _, wide = en.bounding_ellipsoid(df, list("abc"), 1e-3)
    assert np.prod(np.linalg.eigvalsh(wide)) == pytest.approx(1e-3)
