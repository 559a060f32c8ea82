import math
from contextlib import contextmanager

import numpy as np
import pytest
from pyspark.sql import functions as F

from marginalia.operators import reactive as rv
from marginalia.operators.chained import in_tree, order_test_summary, pop_sequence, run_lengths_table
from marginalia.operators.ordertest import run_lengths
from marginalia.operators.warmstart import usable_points
from marginalia.sources import store


@contextmanager
def many_ranges(spark, n=13):
    """As on a cluster: small inputs stay in many ranges."""
    own = {"spark.sql.shuffle.partitions": str(n), "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    old = {k: spark.conf.get(k) for k in own}
    for k, v in own.items():
        spark.conf.set(k, v)
    yield
    for k, v in old.items():
        spark.conf.set(k, v)


def replayed(rows):
    """{seq: parent's seq or None} of the rows that a walk up the tree picks up: every row at once as the walk comes by."""
    left, out, walk = list(rows), {}, []
    for r in rows:
        if r[1] == -math.inf:
            out[r[0]] = None
            walk.append(r)
            left.remove(r)
    while walk:
        node = min(walk, key=lambda r: (r[2], r[0]))
        walk.remove(node)
        for r in [r for r in left if r[1] <= node[2] < r[2]]:
            out[r[0]] = node[0]
            walk.append(r)
            left.remove(r)
    return out


def random_store(rng, first, shift):
    n = int(rng.integers(3, 25))
    digits = int(rng.integers(0, 3))
    logl = np.round(rng.normal(size=n) * 3, digits) + shift
    birth = np.where(rng.random(n) < 0.25, -math.inf, np.round(logl - rng.exponential(size=n) + (rng.random(n) < 0.3) * 3, digits))
    return [(first + k, float(b), float(v)) for k, (b, v) in enumerate(zip(birth, logl))]


def test_trees_of_500_stores(spark):
    """Stores with rows that never fit, one above the other in one table: each is replayed alone."""
    rng = np.random.default_rng(3)
    rows, want = [], {}
    for s in range(500):
        own = random_store(rng, len(rows), 1000.0 * s)
        rows += own
        want |= replayed(own)
    assert 0.05 < 1 - len(want) / len(rows) < 0.7
    with many_ranges(spark):
        got = rv.rebuild_tree(spark.createDataFrame(rows, "seq long, birth double, logl double").repartition(7)).collect()
    assert {r["point_id"]: r["parent_id"] for r in got} == want


def test_a_row_under_one_that_is_left_out_is_left_out(spark):
    rows = [(0, None, 1.0), (1, 3.5, 4.0), (2, 3.6, 5.0), (3, 1.0, 6.0)]
    got = rv.rebuild_tree(spark.createDataFrame(rows, "seq long, birth double, logl double")).collect()
    assert {r["point_id"]: r["parent_id"] for r in got} == {0: None, 3: 0}
    assert in_tree(spark.createDataFrame([], "seq long, birth double, logl double")).count() == 0


def test_a_plateau_over_several_ranges(spark):
    rows = [(k, -math.inf, 0.0) for k in range(300)] + [(300 + k, 0.0, 1.0) for k in range(300)] + [(600, 0.5, 1.0), (601, 1.0, 1.0), (602, 1.0, 2.0)]
    with many_ranges(spark):
        got = {r["seq"]: r["fits"] for r in in_tree(spark.createDataFrame(rows, "seq long, birth double, logl double")).collect()}
    assert {k for k, v in got.items() if not v} == {600, 601}


def popped(rows, asked, consume=True):
    used, out = set(), []
    for k, t in asked:
        at = next((r[0] for r in rows if r[0] not in used and r[1] <= t < r[2]), None)
        if consume:
            used.add(at)
        out.append((k, t, at))
    return out


@pytest.mark.parametrize("kind", ["mixed", "replay", "long lives", "starved"])
def test_pops_of_one_run_over_many_ranges(spark, kind):
    rng = np.random.default_rng(8)
    n = 900
    logl = np.round(rng.normal(size=n) * 10, 1)
    life = {"mixed": rng.exponential(2, n), "replay": rng.exponential(0.3, n), "long lives": rng.exponential(30, n), "starved": rng.exponential(0.05, n)}[kind]
    birth = np.where(rng.random(n) < 0.05, -math.inf, np.round(logl - life, 1))
    rows = [(k, float(b), float(v)) for k, (b, v) in enumerate(zip(birth, logl))]
    t = np.sort(birth[np.isfinite(birth)] if kind == "replay" else np.round(rng.normal(size=700) * 10, 1))
    asked = [(k, float(v)) for k, v in enumerate(t)]
    with many_ranges(spark):
        stored = spark.createDataFrame(rows, "seq long, birth double, logl double").repartition(5)
        got = pop_sequence(stored, spark.createDataFrame(asked, "k long, threshold double")).collect()
        peek = usable_points(stored, spark.createDataFrame(asked, "k long, threshold double")).collect()
    assert sorted((r["k"], r["threshold"], r["seq"]) for r in got) == popped(rows, asked)
    assert sorted(map(tuple, peek)) == sorted({(t, at) for _, t, at in popped(rows, asked, False) if at is not None})


def test_pops_of_many_runs(spark):
    rng = np.random.default_rng(9)
    rows, asked, want = [], [], []
    for run in [*range(500), None]:
        own = random_store(rng, 0, 0.0)
        mine = [(k, float(v)) for k, v in enumerate(np.sort(np.round(rng.normal(size=12) * 3, 1)))]
        rows += [(run, *r) for r in own]
        asked += [(run, *a) for a in mine]
        want += [(run, *x) for x in popped(own, mine)]
    with many_ranges(spark):
        got = pop_sequence(spark.createDataFrame(rows, "run int, seq long, birth double, logl double"), spark.createDataFrame(asked, "run int, k long, threshold double"), "run").collect()
    assert sorted(map(str, map(tuple, got))) == sorted(map(str, want))


@pytest.mark.parametrize("bias", [0.0, 0.02, 0.3])
def test_run_lengths_of_a_million(spark, bias):
    rng = np.random.default_rng(12)
    size = 1_000_000 if bias == 0 else 60_000
    n = rng.integers(100, 400, size)
    rank = np.floor(rng.random(size) ** (1 - bias) * (n + 1)).clip(0, n)
    want, shortest, passed = run_lengths(rank.tolist(), n.tolist(), 4.0)
    import pandas as pd

    df = spark.createDataFrame(pd.DataFrame({"i": np.arange(size), "rank": rank.astype(int), "n": n}))
    with many_ranges(spark):
        got = run_lengths_table(df, "rank", "n", "i").collect()
        s = order_test_summary(df, "rank", "n", "i").first()
    assert [r["length"] for r in sorted(got, key=lambda r: r["at"])] == want and [r["at"] for r in sorted(got, key=lambda r: r["at"])] == np.cumsum(want).tolist()
    assert (s["ranks"], s["runs"], s["shortest"], s["converged"]) == (size, len(want), shortest, passed)
    assert (bias < 0.1) == (len(want) < 20)


def test_run_lengths_refuse_ranks_out_of_range(spark):
    with pytest.raises(ValueError):
        run_lengths_table(spark.createDataFrame([(0, 5, 4)], "i int, r int, n int"), "r", "n", "i")


def test_a_text_store_after_an_empty_append(spark, tmp_path):
    path, names = str(tmp_path / "points"), ["birth", "logl"]
    first = store.TextPointStore(spark, path, names)
    for k, rows in enumerate([[(-math.inf, 1.0)], [], [(1.0, 2.0)]]):
        first.append(spark.createDataFrame(rows, "birth double, logl double"), 10 * (k + 1))
    again = store.TextPointStore(spark, path, names)
    assert again.stored().count() == 2 and again.ncalls == 30


def test_a_file_read_with_draws_and_order_test(spark, tmp_path):
    rng = np.random.default_rng(4)
    live = np.sort(rng.random(40)).tolist()
    rows = [(-math.inf, math.log(u)) for u in live]
    for _ in range(400):
        low = live.pop(0)
        u = low + rng.random() * (1 - low)
        rows.append((math.log(low), math.log(u)))
        live = sorted([*live, u])
    rows += [(5.0, 4.0), (0.5, 0.9)]  # never fit
    kept = store.ParquetPointStore(spark, str(tmp_path / "run"), store.columns(1, 1))
    kept.append(spark.createDataFrame([(b, v, 0.0, 0.5, 0.5) for b, v in rows], "birth double, logl double, quality double, u_1 double, p_1 double").repartition(1), 500)
    points, table = store.read_file(spark, str(tmp_path / "run"), 1, 1, num_bootstraps=5, random=True)
    t = table.first()
    assert t["n"] == 440 and t["converged"] and t["ranks"] > 300 and abs(t["logz"] - math.log(0.5)) < 1
    drawn = [r["logvol"] for r in points.orderBy("rk").select("logvol").collect()]
    means = [r["logvol"] for r in store.read_file(spark, str(tmp_path / "run"), 1, 1, num_bootstraps=2, check_insertion_order=False)[0].orderBy("rk").select("logvol").collect()]
    assert drawn != means and drawn == sorted(drawn, reverse=True) and abs(drawn[-30] - means[-30]) < 3
