import numpy as np
import pandas as pd
import pytest

from marginalia.operators.dominance import discordant, earlier_greater, kendall_distance

from test_chained import many_ranges


@pytest.mark.parametrize("n", [0, 1, 2, 3, 17, 64, 200])
def test_merge_counts(n):
    rng = np.random.default_rng(n)
    for v in (rng.integers(0, 9, n), rng.permutation(n), np.zeros(n, int), -np.arange(n)):
        assert earlier_greater(v).tolist() == [int((v[:k] > v[k]).sum()) for k in range(n)]


def test_counts_of_groups_with_ties_and_nulls(spark):
    rng = np.random.default_rng(1)
    rows = [(None if g == 3 else int(g), int(a), float(b)) for g, a, b in zip(rng.integers(0, 4, 900), rng.integers(0, 60, 900), np.round(rng.normal(size=900), 1))]
    with many_ranges(spark):
        got = discordant(spark.createDataFrame(rows, "g int, a int, b double").repartition(5), "a", "b", "g", buckets=8).collect()
    want = sorted((str(g), a, b, sum(h == g and c < a and d > b for h, c, d in rows)) for g, a, b in rows)
    assert sorted((str(r["g"]), r["a"], r["b"], r["discordant"]) for r in got) == want
    assert discordant(spark.createDataFrame([], "g int, a int, b double"), "a", "b", "g").count() == 0


def test_a_million_rows_of_one_group(spark):
    rng = np.random.default_rng(2)
    n = 1_000_000
    a = rng.permutation(n)
    b = a + rng.normal(0, 50_000, n)
    with many_ranges(spark):
        got = kendall_distance(spark.createDataFrame(pd.DataFrame({"a": a, "b": b})), "a", "b").first()
    want = earlier_greater(b[np.argsort(a)]).sum()
    assert got["n"] == n and got["distance"] == pytest.approx(2 * want / (n * (n - 1)), rel=1e-12)


def test_expected_distances(spark):
    x, y = [1, 2, 3, 4, 5], [3, 4, 1, 2, 5]
    df = spark.createDataFrame(list(zip(x, y, x)), "x int, y int, z int")
    assert kendall_distance(df, "x", "y").first()["distance"] == pytest.approx(0.4)
    assert kendall_distance(df, "x", "z").first()["distance"] == 0
