"""Steps whose memory or time grew faster than the input."""

import time

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from marginalia.functions.student import t_cdf, t_ppf
from marginalia.operators import reactive as rv


def test_ranks_of_common_values_are_told_not_joined(spark):
    """A value that a share of the rows has and values of few rows give the ranks of pandas (F9)."""
    rng = np.random.default_rng(2)
    df = pd.DataFrame({"a": rng.integers(0, 3, 4000).astype(float), "b": rng.normal(size=4000)})
    df["c"] = df.a + 0.1 * df.b
    got = {(r["a"], r["b"]): r["rho"] for r in rv.degenerate_pairs(spark.createDataFrame(df), ["a", "b", "c"], hot=4).collect()}
    want = df.rank().corr()
    assert len(got) == 3 and all(abs(v - want.loc[k]) < 1e-9 for k, v in got.items())


def test_quantiles_of_many_rows(spark):
    """Quantiles of 200,000 rows, and back, take seconds (F11)."""
    p = ((F.col("id") * 7919) % 100003 + 0.5) / 100003
    began = time.time()
    r = spark.range(200_000).select(p.alias("p"), t_ppf(p, 5).alias("t")).agg(F.max(F.abs(t_cdf("t", 5) - F.col("p"))).alias("off")).first()
    assert r["off"] < 1e-12 and time.time() - began < 20


def test_the_rank_test_holds_two_numbers_a_row(spark):
    """Batches out of order are taken by seq, without a frame of all rows (F12)."""
    from types import SimpleNamespace

    from marginalia.streaming import order_test

    held = {}
    fake = SimpleNamespace(schema={"run_id": SimpleNamespace(dataType=SimpleNamespace(simpleString=lambda: "bigint"))}, groupBy=lambda k: SimpleNamespace(applyInPandasWithState=lambda f, *a: held.update(f=f)))
    order_test(fake, threshold=1.5)
    rows = pd.DataFrame({"seq": range(500), "rank": [float(k * 7919 % 100) for k in range(500)], "n": 100.0})
    shuffled = rows.sample(frac=1, random_state=1)
    joined, pd_concat = [], pd.concat
    pd.concat = lambda *a, **k: joined.append(1) or pd_concat(*a, **k)
    try:
        out = [next(held["f"]((1,), iter([t.iloc[k : k + 70] for k in range(0, 500, 70)]), SimpleNamespace(exists=False, update=lambda s: None))) for t in (rows, shuffled)]
    finally:
        pd.concat = pd_concat
    assert not joined and out[0].equals(out[1]) and out[0]["rows"][0] == 500
