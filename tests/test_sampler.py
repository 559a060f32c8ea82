import numpy as np
import pytest

from marginalia.operators.sampler import NestedSampler, Problem, ReactiveSampler, results, solve
from marginalia.plans.queries import _gauss


@pytest.mark.parametrize("stepper", [None, "slice", "walk"])
def test_gaussian_evidence(spark, stepper):
    s = NestedSampler(spark, _gauss(), 200, seed=11, tasks=2, stepper=stepper, nsteps=10 if stepper != "walk" else 40).run(0.1)
    summary, post = results(s.points(), ["x1", "x2"])
    row = summary.first()
    assert abs(row["logz"]) < 4 * max(row["logzerr"], 0.08)
    for p in post.collect():
        assert abs(p["mean"] - 0.5) < 0.03 and abs(p["stdev"] - 0.1) < 0.03


def test_flat_likelihood_ends(spark):
    s = NestedSampler(spark, Problem(["a"], lambda p: np.zeros(len(p))), 50, tasks=2).run()
    assert results(s.points(), ["a"])[0].first()["logz"] == pytest.approx(0, abs=1e-6)


def test_goals_add_runs(spark):
    row, points = ReactiveSampler(spark, _gauss(), seed=5, tasks=2).run(min_ess=600, dlogz=0.5, min_num_live_points=100, max_num_improvement_loops=3)
    assert row["ess"] >= 600 or points.select("run_id").distinct().count() == 4
    assert abs(row["logz"]) < 0.5


def test_bad_functions_are_refused(spark):
    with pytest.raises(ValueError):
        NestedSampler(spark, Problem(["a"], lambda p: np.full(len(p), np.nan)), 50)
    with pytest.raises(ValueError):
        NestedSampler(spark, Problem(["a", "b"], lambda p: p[:, 0], lambda u: u[:, :1]), 50)


def test_solve(spark):
    out = solve(spark, lambda p: -0.5 * (((p - 5) / 1.0) ** 2).sum(axis=1), lambda u: 10 * u, 1, 100, speed=4)
    assert abs(out["logZ"] - np.log(np.sqrt(2 * np.pi) / 10)) < 0.5
