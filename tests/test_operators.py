import numpy as np
import pytest
from pyspark.sql import functions as F

from marginalia import functions as fn
from marginalia.operators import ordertest, posterior, region, walkers, warmstart
from marginalia.operators.ordered import lagged, ranked, running_sum
from marginalia.operators.regions_np import Region, cluster_ids, largest_gap_cut


def test_running_sums_cross_partitions(spark):
    df = spark.range(1000).select(((F.col("id") * 7919) % 1009).alias("k"), (F.col("id") % 5).alias("v"))
    r = running_sum(ranked(df, "k"), F.col("v"), "s", "k").orderBy("k").collect()
    assert [x["rk"] for x in r] == list(range(1, 1001))
    assert [x["s"] for x in r] == np.cumsum([x["v"] for x in r]).tolist()
    back = lagged(ranked(df, "k"), 3, "rk", before="k").orderBy("rk").collect()
    assert [x["before"] for x in back][3:] == [x["k"] for x in back][:-3] and back[0]["before"] is None


def test_weighted_quantile_follows_the_definition(spark):
    x, w = [3.0, 1.0, 2.0, 5.0], [0.1, 0.4, 0.3, 0.2]
    df = spark.createDataFrame(list(zip(range(4), x, w)), "id long, x double, w double")
    got = {r["q"]: r["value"] for r in posterior.weighted_quantiles(df, "x", "w", "id", [0.25, 0.5, 0.9]).collect()}
    order = np.argsort(x)
    c = np.r_[0, np.cumsum(np.array(w)[order])[:-1]]
    assert [got[q] for q in (0.25, 0.5, 0.9)] == pytest.approx(np.interp([0.25, 0.5, 0.9], c / c[-1], np.array(x)[order]).tolist())


def test_resampling_gives_the_number_asked_for(spark):
    w = np.random.default_rng(1).random(50)
    df = spark.createDataFrame([(i, float(x)) for i, x in enumerate(w / w.sum())], "id long, w double")
    r = posterior.resample_counts(df, "w", ["id"], F.lit(200.0)).orderBy("id").collect()
    positions = (np.arange(200) + 0.5) / 200
    want = np.bincount(np.searchsorted(np.cumsum(w / w.sum()), positions, side="right"), minlength=50)
    assert [x["copies"] for x in r] == want.tolist()


def test_order_test():
    rng = np.random.default_rng(1)
    fair, _, ok = ordertest.run_lengths(rng.integers(0, 400, 1000).tolist(), [400] * 1000, 4)
    assert ok and not fair
    low, shortest, ok = ordertest.run_lengths(rng.integers(0, 300, 3000).tolist(), [400] * 3000, 3)
    assert len(low) > 1 and shortest and not ok
    with pytest.raises(ValueError):
        ordertest.run_lengths([5], [4], 3)


def test_kendall(spark):
    df = spark.createDataFrame(list(zip([1, 2, 3, 4, 5], [3, 4, 1, 2, 5])), "a int, b int")
    assert ordertest.kendall_distance(df, "a", "b").first()["distance"] == pytest.approx(0.4)
    assert ordertest.kendall_distance(df, "a", "a").first()["distance"] == 0


def test_grid_joins_equal_brute_force(spark):
    p = np.random.default_rng(2).random((150, 3))
    df = spark.createDataFrame([(i, *map(float, r)) for i, r in enumerate(p)], "id long, x double, y double, z double")
    near = ((p[:, None] - p[None]) ** 2).sum(2) <= 0.2**2
    got = region.count_neighbours(df.withColumnRenamed("id", "a_id"), df.withColumnRenamed("id", "b_id"), 0.2, ["x", "y", "z"]).orderBy("b_id").collect()
    assert [r["n"] for r in got] == near.sum(0).tolist()
    labels = {r["id"]: r["cluster"] for r in region.clusters(df, 0.2, ["x", "y", "z"]).collect()}
    assert [labels[i] for i in range(150)] == cluster_ids(p, 0.04).tolist()


def test_width_plan(spark):
    plan = spark.createDataFrame([(0.0, 10.0, 400), (2.0, 5.0, 800)], "lo double, hi double, width long")
    got = {r["edge"]: r["width"] for r in warmstart.width_steps(plan).collect()}
    assert got == {0.0: 400, 2.0: 800, 5.0: 400, 10.0: 0}


def test_stored_points_are_usable_from_birth_to_value(spark):
    stored = spark.createDataFrame([(1, None, 123.0), (2, 101.0, 155.0), (3, 99.0, 156.0)], "seq long, birth double, logl double")
    t = spark.createDataFrame([(100.0,), (130.0,)], "threshold double")
    got = {r["threshold"]: r["seq"] for r in warmstart.usable_points(stored, t).collect()}
    assert got == {100.0: 1, 130.0: 2}


def test_transforms_round_trip(spark):
    df = spark.createDataFrame([([0.1, 0.9],), ([0.4, 0.2],)], "u array<double>")
    r = df.select("u", fn.unscale(fn.scale("u", [0.3, 0.5], [2.0, 0.1]), [0.3, 0.5], [2.0, 0.1]).alias("v"), fn.within_unit_cube("u").alias("ok")).collect()
    assert all(np.allclose(x["u"], x["v"]) and x["ok"] for x in r)
    w = spark.createDataFrame([(0.2,), (0.95,)], "u double").select("u", fn.unwrap(fn.wrap("u", 0.5), 0.5).alias("v")).collect()
    assert all(x["u"] == pytest.approx(x["v"]) for x in w)


def test_region_holds_its_points_and_samples_stay_inside():
    rng = np.random.default_rng(3)
    u = np.clip(rng.normal(0.5, [0.05, 0.1], (200, 2)), 0.01, 0.99)
    for kind in ("friends", "ellipsoid", "axes"):
        r = Region(u, rng, kind)
        assert r.inside(u).all()
        for method in ("balls", "cube", "box", "ellipsoid"):
            s = r.sample(500, rng, method)
            assert len(s) and r.inside(s).all()
        assert np.allclose(r.untransform(r.transform(u)), u)


@pytest.mark.parametrize("name", sorted(walkers.DIRECTIONS))
def test_slices_stay_above_the_threshold(name):
    rng = np.random.default_rng(4)
    f = lambda x: -((x - 0.5) ** 2).sum(axis=1)
    u = 0.5 + rng.uniform(-0.1, 0.1, (60, 2))
    r = Region(u, rng)
    v, logl, calls, _ = walkers.slice_steps(u, f(u), -0.05, u, r, f, rng, 4, walkers.DIRECTIONS[name])
    assert (logl > -0.05).all() and np.allclose(logl, f(v)) and calls > 0 and (v != u).any()


def test_walks_lines_and_reflection():
    rng = np.random.default_rng(6)
    f = lambda x: -((x - 0.5) ** 2).sum(axis=1)
    u = 0.5 + rng.uniform(-0.1, 0.1, (60, 2))
    r = Region(u, rng)
    for d in (walkers.SequentialDirection(), walkers.SequentialDirection(True), walkers.OrthogonalDirection(), walkers.SpeedDirection([[0], [0, 1]])):
        v, logl, _, scale = walkers.random_walk(u, f(u), -0.05, u, r, f, rng, 5, d)
        assert (logl > -0.05).all() and scale > 0
    x, _ = walkers.steps_with_reflection(np.array([0.1, 0.89]), np.array([0.2, 0.1]), 2)
    assert np.allclose(x, [0.5, 0.91])
    lo, hi = walkers.line_to_cube(np.array([[0.5, 0.25]]), np.array([[1.0, 0.0]]))
    assert lo[0] == -0.5 and hi[0] == 0.5
    assert 0.5 < largest_gap_cut(np.array([0.1, 0.2, 0.9])) < 0.6
