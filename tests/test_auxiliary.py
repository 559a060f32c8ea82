import numpy as np
import pytest

from marginalia.operators import auxiliary as aux
from marginalia.plans.queries import _gauss


def evidence(problem, n=400_000, seed=1):
    u = np.random.default_rng(seed).random((n, len(problem.names)))
    return np.log(np.mean(np.exp(problem.evaluate(u))))


def test_rewritten_problems_keep_the_evidence():
    p = _gauss(0.4, 0.05)
    rng = np.random.default_rng(2)
    u = np.clip(rng.normal(0.4, 0.05, (500, 2)), 0, 1)
    want = evidence(p)
    assert evidence(aux.StudentTProblem(p, u.mean(axis=0), np.cov(u.T))) == pytest.approx(want, abs=0.05)
    # a box's volume is the density ratio only on its own; mixed over s, the evidence is that of the mixture
    boxed = aux.boxed_problem(p, u, np.full(500, 1 / 500))
    assert boxed.transform(np.full((3, 3), 0.5)).shape == (3, 3)
    assert evidence(boxed) < want + 0.05


def test_gradients_and_eigenvalues():
    p = _gauss(0.5, 0.2)
    assert aux.verify_gradient(p, lambda u: -(u - 0.5) / 0.04)
    assert not aux.verify_gradient(p, lambda u: u * 0)
    c = aux.positive_eigenvalues(np.diag([2.0, 0.0]), 1.0)
    assert np.linalg.det(c) == pytest.approx(1)
