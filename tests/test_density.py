import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from marginalia.functions.student import incomplete_beta, normal_ppf, t_cdf, t_ppf, t_truncated
from marginalia.operators.density import density_grid, hdi, mass_grid, plotting_quantiles


def t_integral(x, df):
    """The distribution function by Gauss-Legendre on the angle."""
    g, w = np.polynomial.legendre.leggauss(400)
    top = math.atan(abs(x) / math.sqrt(df))
    c = math.exp(math.lgamma((df + 1) / 2) - math.lgamma(df / 2)) / math.sqrt(math.pi)
    return 0.5 + math.copysign(c * np.sum(w * np.cos((g + 1) / 2 * top) ** (df - 1)) * top / 2, x)


@pytest.mark.parametrize("df", [1, 2, 3.7, 5, 30, 400])
def test_student_t(spark, df):
    xs = [-40.0, -7.5, -1.2, -1e-4, 0.0, 0.5, 2.0, 12.0, 100.0]
    got = spark.createDataFrame([(x,) for x in xs], "x double").select("x", t_cdf("x", df).alias("c")).collect()
    assert all(abs(r["c"] - t_integral(r["x"], df)) < 1e-9 for r in got)
    ps = [1e-12, 1e-6, 0.01, 0.2, 0.4999, 0.5, 0.6, 0.999, 1 - 1e-9]
    got = spark.createDataFrame([(p,) for p in ps], "p double").select("p", t_ppf("p", df).alias("t")).select("p", "t", t_cdf("t", df).alias("back")).collect()
    assert all(abs(r["back"] - r["p"]) < 1e-9 * min(r["p"], 1 - r["p"]) + 1e-15 for r in got)


def test_ends_and_nulls(spark):
    r = spark.range(1).select(t_ppf(F.lit(0.0), 5).alias("a"), t_ppf(F.lit(1.0), 5).alias("b"), t_ppf(F.lit(1.5), 5).alias("c"), t_ppf(F.lit(None), 5).alias("d"), incomplete_beta(F.lit(0.0), 2, 3).alias("e"), incomplete_beta(F.lit(1.0), 2, 3).alias("f")).first()
    assert tuple(r) == (-math.inf, math.inf, None, None, 0.0, 1.0)


def test_truncated_draws(spark):
    d = spark.range(4000).select(t_truncated((F.col("id") + 0.5) / 4000, 5, -1.0, 2.5).alias("t"))
    x = np.sort(d.toPandas()["t"].to_numpy())
    a, b = t_integral(-1.0, 5), t_integral(2.5, 5)
    assert x[0] >= -1 and x[-1] <= 2.5
    assert all(abs((t_integral(v, 5) - a) / (b - a) - (k + 0.5) / 4000) < 1e-8 for k, v in enumerate(x) if k % 97 == 0)
    with pytest.raises(ValueError):
        t_truncated(F.lit(0.5), 5, 1.0, 1.0)


def test_normal_quantiles(spark):
    got = spark.createDataFrame([(p,) for p in (1e-9, 0.01, 0.3, 0.5, 0.77, 0.999)], "p double").select("p", normal_ppf("p").alias("z")).collect()
    assert all(abs(0.5 * math.erfc(-r["z"] / math.sqrt(2)) / r["p"] - 1) < 1e-7 for r in got)


def test_interval_of_a_normal(spark):
    x = np.random.default_rng(1).normal(size=100_000)
    r = hdi(spark.createDataFrame(pd.DataFrame({"x": x})), ["x"]).first()
    assert abs(r["mode"]) < 0.05 and abs(r["errlo"] - 1) < 0.07 and abs(r["errup"] - 1) < 0.07, r
    assert abs(r["lo"] + 1) < 0.04 and abs(r["hi"] - 1) < 0.04 and 0.68 <= r["mass"] < 0.69, r


def test_two_modes_and_weights(spark):
    """With 0.75 of the weight near 0 a level of 0.6 stays there; one of 0.9 must span the gap, and counts what it spans."""
    rng = np.random.default_rng(2)
    x = np.r_[rng.normal(0, 1, 20_000), rng.normal(10, 1, 20_000)]
    df = spark.createDataFrame(pd.DataFrame({"x": x, "w": np.r_[np.full(20_000, 3.0), np.full(20_000, 1.0)]}))
    low, high = hdi(df, ["x"], "w", 0.6).first(), hdi(df, ["x"], "w", 0.9).first()
    assert abs(low["mode"]) < 0.1 and low["lo"] > -2 and low["hi"] < 2
    inside = lambda r: 0.75 * np.mean((x[:20_000] >= r["lo"]) & (x[:20_000] <= r["hi"])) + 0.25 * np.mean((x[20_000:] >= r["lo"]) & (x[20_000:] <= r["hi"]))
    assert high["hi"] > 8 and high["lo"] < -1 and abs(inside(high) - 0.9) < 0.02 and abs(inside(low) - 0.6) < 0.02


def test_a_hard_end_is_corrected_to_first_order(spark):
    """An exponential has its mode at the end; without a correction the density there is halved."""
    x = np.random.default_rng(3).exponential(size=100_000)
    df = spark.createDataFrame(pd.DataFrame({"x": x, "y": 1 - x}))
    r = {r["param"]: r for r in hdi(df, ["x", "y"], None, 0.68, 512, {"x": (0.0, None), "y": (None, 1.0)}).collect()}
    assert r["x"]["lo"] < 0.05 and abs(r["x"]["hi"] - 1.14) < 0.06
    assert r["y"]["hi"] > 0.95 and abs(r["y"]["lo"] + 0.14) < 0.06
    p = density_grid(mass_grid(df, ["x"], None, 512, {"x": (0.0, None)})).where("bin = 0").first()
    assert abs(p["p"] / p["dx"] - 1) < 0.06


def test_odd_inputs_of_grids(spark):
    one = hdi(spark.createDataFrame([(2.0,)] * 5 + [(None,)], "x double"), ["x"]).first()
    assert abs(one["mode"] - 2) < 0.01
    assert hdi(spark.createDataFrame([], "x double"), ["x"]).count() == 0


def quantile(values, q, a=0.4, b=0.4):
    v, n = np.sort(values), len(values)
    place = n * q + a + q * (1 - a - b)
    k = int(np.floor(np.clip(place, 1, max(n - 1, 1))))
    g = np.clip(place - k, 0, 1)
    return (1 - g) * v[k - 1] + g * v[min(k, n - 1)]


def test_plotting_positions(spark):
    rng = np.random.default_rng(4)
    rows = [(k, float(v)) for k, n in enumerate([1, 2, 7, 300]) for v in np.round(rng.normal(size=n), 1)]
    qs = [0.0, 0.159, 0.5, 0.841, 1.0]
    got = plotting_quantiles(spark.createDataFrame(rows, "x int, y double"), "x", "y", qs).collect()
    assert len(got) == 20
    for r in got:
        assert r["value"] == pytest.approx(quantile([v for k, v in rows if k == r["x"]], r["q"]))
    with pytest.raises(ValueError):
        plotting_quantiles(spark.createDataFrame(rows, "x int, y double"), "x", "y", [1.2])
