"""Text histograms and rounded limits against numpy."""

import numpy as np
import pytest

from marginalia.operators import report as rp


def _bars(v, w, lo, hi):
    h, _ = np.histogram(v, bins=np.linspace(lo, hi, rp.EDGES), weights=w)
    return "".join(rp.BARS[i] for i in np.ceil(np.round(h * rp.FULL / h.max(), 9)).astype(int))


@pytest.fixture(scope="module")
def values():
    rng = np.random.default_rng(5)
    return {"a": rng.normal(3, 0.02, 4000), "b": rng.exponential(200, 4000), "c": np.full(4000, -0.7), "w": rng.integers(0, 4, 4000).astype(float)}


@pytest.fixture(scope="module")
def frame(spark, values):
    return spark.createDataFrame(list(zip(*(x.tolist() for x in values.values()))), "a double, b double, c double, w double").repartition(5).cache()


@pytest.mark.parametrize("weight", [None, "w"])
def test_text_histograms(frame, values, weight):
    limits = {"b": (0.0, 600.0)}
    got = {r["param"]: r for r in rp.text_histograms(frame, ["a", "b", "c"], weight, limits).collect()}
    w = np.ones(4000) if weight is None else values["w"]
    for p in "abc":
        v = values[p][w > 0]
        own = w[w > 0]
        lo, hi = (v.min(), v.max()) if v.min() < v.max() else (v.min() - 0.5, v.max() + 0.5)
        pad = 2 * (hi - lo) / 40
        lo, hi = max(lo - pad, limits.get(p, (-np.inf, 0))[0]), min(hi + pad, limits.get(p, (0, np.inf))[1])
        mean = np.average(v, weights=own)
        stdev = np.sqrt(np.average((v - mean) ** 2, weights=own)) if p != "c" else 0.0
        r = got[p]
        assert np.allclose([r["mean"], r["stdev"], r["lo"], r["hi"]], [mean, stdev, lo, hi], rtol=1e-9)
        assert r["digits"] == (3 if p == "c" else max(0, int(-np.floor(np.log10(stdev))) + 1))
        assert r["bars"] == _bars(v, own, r["lo"], r["hi"])
    assert got["c"]["text"].endswith("-0.700 +- 0.000") and got["b"]["text"].startswith("b: 0│")


def test_what_is_no_number_is_left_out(spark):
    d = spark.createDataFrame([(1.0, None), (float("nan"), None), (None, None), (2.0, None)], "x double, y double")
    (r,) = rp.text_histograms(d, ["x", "y"]).collect()
    assert (r["param"], r["mean"], r["stdev"]) == ("x", 1.5, 0.5) and len(r["bars"]) == rp.EDGES - 1
    assert [x["param"] for x in rp.rounded_limits(d, ["x", "y"]).collect()] == ["x"]
    assert rp.text_histograms(d.limit(0), ["x"]).count() == 0 and rp.rounded_limits(d.limit(0), ["x"]).count() == 0


@pytest.mark.parametrize(
    "lo, hi, guess, want",
    [
        (3.0, 47.0, None, (0.0, 100.0, "%+.1f")),
        (-3.0, 47.0, None, (-100.0, 100.0, "%+.1f")),
        (0.02, 0.5, None, (0.0, 1.0, "%+.2f")),
        (2e5, 7e5, None, (0.0, 1e6, "%+.1e")),
        (2.001e5, 2.002e5, None, (0.0, 1e6, "%+.0f")),
        (0.0, 0.0, None, (0.0, 0.0, "%+.1f")),
        (5.0, 5.0, None, (0.0, 10.0, "%+.1f")),
        (3.0, 47.0, (1.0, 50.0), (1.0, 50.0, "%+.1f")),
        (3.0, 47.0, (4.0, 40.0), (0.0, 100.0, "%+.1f")),
    ],
)
def test_rounded_limits(spark, lo, hi, guess, want):
    d = spark.createDataFrame([(lo,), (hi,), ((lo + hi) / 2,)], "p double")
    (r,) = rp.rounded_limits(d, ["p"], None if guess is None else {"p": guess}).collect()
    assert (r["lo"], r["hi"]) == (lo, hi) and (r["lo_rounded"], r["hi_rounded"], r["format"]) == want
