import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from marginalia.operators import evidence as ev
from marginalia.operators import reactive as rv
from marginalia.operators.ordered import following, range_partitioned, running_sum
from marginalia.operators.regions_np import Region, WrappingEllipsoid, axis_enlargement, bootstrap_enlargements, gap_offsets, principal_gap
from marginalia.operators.walkers import island_start, random_start, step_report
from marginalia.operators.warmstart import pop_sequence
from marginalia.sources import store

ROWS = [(-math.inf, 123.0, 413.0, 213.0), (101.0, 155.0, 413.0, 213.0), (99.0, 156.0, 413.0, 213.0)]
NAMES = ["birth", "logl", "a", "b"]


@pytest.mark.parametrize("kind", [store.ParquetPointStore, store.TextPointStore])
def test_stores_give_each_row_once(spark, tmp_path, kind):
    path = str(tmp_path / "points")
    first = kind(spark, path, NAMES)
    assert first.pop(-math.inf) is None
    for k, row in enumerate(ROWS):
        first.append(spark.createDataFrame([row], "birth double, logl double, a double, b double"), 10 * (k + 1))
    again = kind(spark, path, NAMES)
    assert again.pop(-math.inf)["logl"] == 123 and again.pop(-math.inf) is None
    assert again.pop(100.0)["logl"] == 156 and again.pop(100.0) is None
    assert again.pop(102.0)["logl"] == 155 and again.stored().count() == 3
    assert kind is store.TextPointStore or again.ncalls == 30


def test_stores_of_another_width(spark, tmp_path):
    path = str(tmp_path / "points")
    store.TextPointStore(spark, path, NAMES).append(spark.createDataFrame(ROWS, "birth double, logl double, a double, b double"), 3)
    for names in (NAMES[:3], [*NAMES, "c"]):
        with pytest.warns(UserWarning):
            assert store.TextPointStore(spark, path, names).pop(-math.inf) is None
    other = str(tmp_path / "parquet")
    store.ParquetPointStore(spark, other, NAMES).append(spark.createDataFrame(ROWS, "birth double, logl double, a double, b double"), 3)
    with pytest.raises(ValueError):
        store.ParquetPointStore(spark, other, NAMES[:3])
    nothing = store.NullPointStore(NAMES)
    nothing.append(spark.createDataFrame(ROWS, "birth double, logl double, a double, b double"), 5)
    assert nothing.nrows == 3 and nothing.ncalls == 5 and nothing.pop(-math.inf) is None


def test_pop_sequence_equals_a_loop(spark):
    rng = np.random.default_rng(4)
    rows, asked, want = [], [], []
    for run in ("x", "y"):
        logl = np.round(rng.normal(size=120), 1)
        birth = np.where(rng.random(120) < 0.2, -np.inf, logl - np.round(rng.exponential(size=120), 1))
        t = np.sort(np.round(rng.normal(size=60) - 0.5, 1))
        rows += [(run, k, None if np.isinf(b) else float(b), float(v)) for k, (b, v) in enumerate(zip(birth, logl))]
        asked += [(run, k, float(v)) for k, v in enumerate(t)]
        used = set()
        for k, v in enumerate(t):
            at = next((i for i in range(120) if i not in used and birth[i] <= v < logl[i]), None)
            used.add(at)
            want.append((run, k, float(v), at))
    got = pop_sequence(spark.createDataFrame(rows, "run string, seq long, birth double, logl double"), spark.createDataFrame(asked, "run string, k long, threshold double"), "run")
    assert sorted(map(tuple, got.collect()), key=str) == sorted(want, key=str)


def test_following_and_sums_by_group(spark):
    rng = np.random.default_rng(5)
    rows = [(int(k), int(rng.integers(3)), int(v) if v > 6 else None) for k, v in enumerate(rng.integers(0, 10, 200))]
    df = range_partitioned(spark.createDataFrame(rows, "k long, g long, v long").repartition(5), "k")
    got = {r["k"]: r["nxt"] for r in following(df, F.col("v"), "nxt", "k").collect()}
    assert got == {k: next((v for _, _, v in rows[k:] if v is not None), None) for k in range(200)}
    sums = {r["k"]: r["s"] for r in running_sum(df, F.coalesce("v", F.lit(0)), "s", "k", by=("g",)).collect()}
    assert sums == {k: sum(v or 0 for j, h, v in rows[: k + 1] if h == g) for k, g, _ in rows}


def test_a_tree_is_rebuilt_from_births(spark):
    """Rows hang under the first row at or above their birth; ties, births between rows, and one that nothing lies between."""
    inf = -math.inf
    rows = [(0, inf, 1.0), (1, None, 2.0), (2, inf, 3.0), (3, 1.0, 2.0), (4, 2.0, 5.0), (5, 1.5, 6.0), (6, 3.5, 4.0), (7, 6.0, 9.0), (8, 7.0, 8.0)]
    out = {r["point_id"]: r["parent_id"] for r in rv.rebuild_tree(spark.createDataFrame(rows, "seq long, birth double, logl double")).collect()}
    assert out == {0: None, 1: None, 2: None, 3: 0, 4: 1, 5: 1, 7: 5}
    roots = rv.with_roots(spark.createDataFrame([(k, p) for k, p in out.items()], "point_id long, parent_id long")).collect()
    assert {r["point_id"]: r["root_id"] for r in roots} == {0: 0, 1: 1, 2: 2, 3: 0, 4: 1, 5: 1, 7: 1}


@pytest.fixture(scope="module")
def run(spark):
    """A run on a Gaussian of which the evidence is known, with 50 live points."""
    rng = np.random.default_rng(11)
    live = [(None, u, k, k) for k, u in enumerate(rng.random(50))]
    rows, like = [], lambda u: -0.5 * ((u - 0.5) / 0.05) ** 2
    n = 50
    for _ in range(500):
        low = min(range(50), key=lambda j: like(live[j][1]))
        parent, u, key, root = live[low]
        rows.append((key, like(u), parent, root, u))
        half = abs(u - 0.5)
        live[low] = (key, rng.uniform(0.5 - half, 0.5 + half), n, root)
        n += 1
    rows += [(key, like(u), parent, root, u) for parent, u, key, root in live]
    typed = [tuple(None if x is None else float(x) if j in (1, 4) else int(x) for j, x in enumerate(r)) for r in rows]
    return spark.createDataFrame(typed, "point_id long, logl double, parent_id long, root_id long, u double")


def test_a_stored_run_gives_the_same_results(spark, tmp_path, run):
    births = run.select(F.col("point_id").alias("parent_id"), F.col("logl").alias("birth"))
    rows = run.join(births, "parent_id", "left").select("birth", "logl", F.lit(0.0).alias("quality"), F.col("u").alias("u_1"), F.col("u").alias("p_1"))
    path = str(tmp_path / "run")
    kept = store.ParquetPointStore(spark, path, store.columns(1, 1))
    kept.append(rows.where("birth is null"), 50)
    kept.append(rows.where("birth is not null"), 900)
    w, table = store.read_file(spark, path, 1, 1)
    r, direct = table.first(), ev.summary(ev.weighted(run)).first()
    truth = math.log(0.05 * math.sqrt(2 * math.pi))
    assert r["n"] == 550 and r["logz"] == pytest.approx(direct["logz"]) and abs(r["logz"] - truth) < 4 * max(r["logzerr"], r["logzerr_single"])
    assert r["herr"] > 0 and r["logzerr_tail"] > 0 and r["max_logl"] <= 0
    assert w.count() == 550
    weights = ev.with_peak(w).select(F.exp(F.col("logwt") - F.col("peak")).alias("weight"), "logl", F.col("p_1").alias("x"))
    store.write_results(path, weights, weights, w.select("logl", "logvol"), table, ["x"])
    store.write_tree(run, f"{path}/tree")
    assert spark.read.json(f"{path}/info/results").first()["n"] == 550 and spark.read.parquet(f"{path}/tree/edges").count() == 550
    similar = store.read_similar(spark, f"{path}/chains/weighted_post", ["x"])
    assert similar.count() == 550
    with pytest.raises(ValueError):
        store.read_similar(spark, f"{path}/chains/weighted_post", ["y"])
    with pytest.raises(ValueError):
        store.read_similar(spark, f"{path}/chains/weighted_post", ["x"], 10_000)


def test_density_of_volumes_equals_numpy(spark, run):
    w = ev.weighted(run)
    got = ev.volume_density(w, 30).orderBy("x").collect()
    rows = w.select("logvol", "logwt").toPandas()
    p = np.exp(rows.logwt - rows.logwt.max())
    p /= p.sum()
    x = -rows.logvol.to_numpy()
    width = math.sqrt((p * x * x).sum() - (p * x).sum() ** 2) * (1 / (p * p).sum()) ** -0.2
    for r in got:
        assert r["density"] == pytest.approx((p * np.exp(-0.5 * ((r["x"] - x) / width) ** 2)).sum() / width / math.sqrt(2 * math.pi), rel=0.02, abs=1e-6)


def test_goals_met_and_not(spark, run):
    boot = rv.bootstrap_masks(run, 12)
    easy = {r["goal"]: r for r in rv.goals(run, boot, 5, 100.0, 5.0).collect()}
    assert all(r["met"] and r["lo"] is None and r["width"] == 0 for r in easy.values())
    hard = {r["goal"]: r for r in rv.goals(run, boot, 5000, 1e-6, 0.3).collect()}
    assert not any(r["met"] for r in hard.values()) and hard["ess"]["lo"] < hard["ess"]["hi"] <= 0 and hard["kl"]["lo"] < hard["kl"]["hi"]
    assert 1 <= hard["logz"]["width"] <= math.ceil(math.sqrt(550) / 0.3)


def test_widening_and_expanding(spark, run):
    target = rv.widen(run, -5.0, 10).collect()
    rows = {r["point_id"]: r for r in run.collect()}
    born_above = {r["parent_id"] for r in rows.values() if r["logl"] >= -5 and r["parent_id"] is not None}
    assert len(target) == 10 and all(t["target"] == 2 and rows[t["point_id"]]["logl"] < -5 and t["point_id"] in born_above for t in target)
    assert rv.widen(run, -1e9, 10).count() == 0
    w = ev.live_points(run)
    assert rv.expandable(w, -1.0, -2.0, 100).where("expand").count() == 0 and rv.expandable(w, -9.0, 0.0, 100, healthy=False).where("expand").count() == 0
    assert rv.expandable(w, -9.0, 0.0, 100).where("expand").count() == 50  # those of the tail
    assert rv.plateau_roots(spark.createDataFrame([(1.0,), (1.0,), (1.0,), (2.0,)], "logl double")).first()[0] == 2


def test_wrapping_ellipsoid_and_gaps():
    rng = np.random.default_rng(3)
    p = np.column_stack([rng.normal(size=200), np.full(200, 2.0), rng.normal(size=200) * 3])
    e = WrappingEllipsoid(p, rng)
    assert e.inside(p).all() and e.enlarge >= 1
    far, moved = p.copy(), p.copy()
    far[:, 0] += 100
    moved[:, 1] += 1e-9
    assert not e.inside(far).any() and not e.inside(moved).any()
    two = np.vstack([rng.normal(0, 0.01, (40, 2)) + 0.2, rng.normal(0, 0.01, (60, 2)) + 0.8])
    half, gap = principal_gap(two)
    assert gap > 0.5 and (half[:40] == half[0]).all() and (half[40:] != half[0]).all()
    offsets = gap_offsets(two, np.zeros(100, int))
    assert np.abs(offsets).max() < 0.1
    kept, held = rng.normal(size=(50, 2)), rng.normal(size=(20, 2))
    x = (held - kept.mean(axis=0)) ** 2 / (kept.var(axis=0, ddof=1) * 4)
    assert axis_enlargement(kept, held) == pytest.approx(x.sum(axis=1).max()) and axis_enlargement(kept, held, True) == pytest.approx(x.sum(axis=0).max())


def test_regions_are_refreshed_by_rule_and_bootstrapped_in_tasks(spark):
    rng = np.random.default_rng(6)
    u = rng.normal(0.5, 0.1, (100, 2))
    r = Region(u, rng)
    smaller, taken = r.refreshed(0.5 + (u - 0.5) * 0.5, rng)
    assert taken and smaller.log_volume() < r.log_volume()
    assert smaller.refreshed(u[:2], rng) == (smaller, False)
    assert not smaller.refreshed(0.5 + (u - 0.5) * 0.5 * np.r_[1, 0], rng)[1]
    assert np.isfinite(r.log_volume_of_balls()) and r.inside_or_near(u + 10, u + 10).all()
    rows = bootstrap_enlargements(spark, u, 16).collect()
    again = bootstrap_enlargements(spark, u, 16).collect()
    assert len(rows) == 16 and sorted(map(tuple, rows)) == sorted(map(tuple, again)) and all(x["enlarge"] >= 1 and x["sq_radius"] > 0 for x in rows)


def test_starts_of_chains():
    rng = np.random.default_rng(7)
    logl = np.arange(100.0)
    start = island_start(10)
    assert {start(logl, 37.0, rng) // 10 for _ in range(60)} == {3}
    assert len({start(logl, -1.0, rng) // 10 for _ in range(200)}) > 5 and len({island_start(10, 1.0)(logl, 37.0, rng) // 10 for _ in range(200)}) > 5
    assert 0 <= random_start(logl, 0.0, rng) < 100
    with pytest.raises(ValueError):
        island_start(0)
    u = rng.random((50, 2))
    report = step_report(u, u, Region(u, rng), 3, 12, 5, 0.5)
    assert report["rejection_rate"] == 0.75 and report["mean_jump"] == 0 and report["far_enough"] == 0


def test_run_folders_and_logs(tmp_path):
    first, second = store.make_run_dir(str(tmp_path)), store.make_run_dir(str(tmp_path))
    assert first["run_dir"].endswith("run1") and second["chains"].endswith("run2/chains")
    store.create_logger("marginalia-test", first["run_dir"]).debug("hello")
    assert "hello" in open(f"{first['run_dir']}/debug.log").read()
