import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from marginalia.operators import evidence as ev
from marginalia.sources import points_from


def walk(points):
    """The sequential walk: always take the lowest live point, replace it by its children."""
    children, roots = {}, []
    for p in points:
        (roots if p["parent_id"] is None else children.setdefault(p["parent_id"], [])).append(p)
    live, logvol, out = list(roots), 0.0, []
    while live:
        p = min(live, key=lambda x: (x["logl"], x["point_id"]))
        n = len(live)
        live.remove(p)
        own = children.get(p["point_id"], [])
        live += own
        if own:
            logw, step = logvol + math.log(1 - math.exp(-1 / n)), -1 / n
        else:
            logw, step = logvol - math.log(n), math.log(max(1 - 1 / n, 1e-300))
        out.append((p["point_id"], n, logw))
        logvol += step
    return out


@pytest.mark.parametrize("ragged", [False, True])
def test_windows_equal_the_walk(spark, ragged):
    rng = np.random.default_rng(5)
    df = spark.createDataFrame([(i, float(x)) for i, x in enumerate(np.round(rng.normal(size=300), 2))], "id long, x double")
    p = points_from(df, "id", -0.5 * F.col("x") * F.col("x"), 40, ragged)
    w = ev.weighted(p)
    rows = sorted(w.collect(), key=lambda r: (r["logl"], r["point_id"]))
    want = walk([r.asDict() for r in rows])
    assert [(r["point_id"], r["nlive"]) for r in rows] == [(i, n) for i, n, _ in want]
    assert np.allclose([r["logw"] for r in rows], [x for *_, x in want])
    logz = np.logaddexp.reduce([r["logw"] + r["logl"] for r in rows])
    assert ev.summary(w).first()["logz"] == pytest.approx(logz)


def test_births_alone_give_the_same_width(spark):
    df = spark.createDataFrame([(i, float((i * 37) % 101) + i / 1000) for i in range(101)], "id long, x double")
    p = points_from(df, "id", F.col("x"), 20, True)
    a = {r["point_id"]: r["nlive"] for r in ev.live_points(p).collect()}
    b = {r["point_id"]: r["nlive"] for r in ev.live_points_from_births(p).collect()}
    assert a == b


def test_running_evidence_ends_at_the_total(spark):
    df = spark.createDataFrame([(i, i / 50) for i in range(200)], "id long, x double")
    w = ev.weighted(points_from(df, "id", F.col("x"), 25))
    s = ev.running_evidence(w).orderBy("rk").collect()
    assert s[-1]["logz"] == pytest.approx(ev.summary(w).first()["logz"])
    assert all(a["logz"] <= b["logz"] + 1e-12 for a, b in zip(s, s[1:]))


def test_stochastic_volume_agrees_on_average(spark):
    df = spark.createDataFrame([(i, i / 50) for i in range(400)], "id long, x double")
    p = points_from(df, "id", F.col("x"), 100)
    z = [ev.summary(ev.weighted_stochastic(p, s)).first()["logz"] for s in range(5)]
    assert abs(np.mean(z) - ev.summary(ev.weighted(p)).first()["logz"]) < 0.3


def test_bootstraps_are_swept_without_copies(spark):
    """One pass over ranges and batches gives each bootstrap's walk, and the totals read the points once, whatever the bootstraps (F13)."""
    rng = np.random.default_rng(8)
    df = spark.createDataFrame([(i, None if i == 77 else float(x)) for i, x in enumerate(np.round(rng.normal(size=500), 2))], "id long, x double")
    p = points_from(df, "id", -0.5 * F.col("x") * F.col("x"), 20)
    held = {0: set(range(20)), 3: {1, 2, 5, 11}, 9: {0, 7}}
    boot = spark.createDataFrame([(b, r) for b, roots in held.items() for r in roots], "boot_id int, root_id long")
    rows = [r.asDict() for r in p.collect()]
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "16")
    try:
        totals = ev.bootstrap_totals(p, boot)
        plan = totals._jdf.queryExecution().executedPlan().toString()
        got = {r["boot_id"]: r for r in totals.collect()}
        b = ev.bootstrap_evidence(p, boot)
        swept, h = b.collect(), {r["boot_id"]: r["h"] for r in ev.bootstrap_information(b).collect()}
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert plan.count("Scan ExistingRDD") == 1
    assert set(got) == set(held) and {"x", "birth", "parent_id"} <= set(b.columns)
    for k, roots in held.items():
        own = [r | {"logl": -math.inf if r["logl"] is None else r["logl"]} for r in rows if r["root_id"] in roots]  # null comes first
        want, logl = walk(own), {r["point_id"]: r["logl"] for r in own}
        mine = sorted((r for r in swept if r["boot_id"] == k), key=lambda r: (logl[r["point_id"]], r["point_id"]))
        assert [(r["point_id"], r["nlive"]) for r in mine] == [(i, n) for i, n, _ in want]
        assert np.allclose([r["logw"] for r in mine], [x for *_, x in want])
        assert got[k]["n"] == len(want) and got[k]["logz"] == pytest.approx(np.logaddexp.reduce([x + logl[i] for i, _, x in want])) and got[k]["h"] == pytest.approx(h[k])
    assert got[0]["logz"] == pytest.approx(ev.summary(ev.weighted(p)).first()["logz"])
