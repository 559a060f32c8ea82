"""Step samplers: populations of walkers moved together as arrays, inside one task each."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np

Direction = Callable[[np.ndarray, np.ndarray, object, np.random.Generator], np.ndarray]


def _unit(v: np.ndarray) -> np.ndarray:
    return v / np.maximum(1e-300, np.sqrt((v * v).sum(axis=1)))[:, None]


def random_direction(u, live, region, rng):
    return _unit(rng.normal(size=u.shape))


def cube_direction(u, live, region, rng):
    """Along one axis."""
    v = np.zeros_like(u)
    v[np.arange(len(u)), rng.integers(0, u.shape[1], len(u))] = 1
    return v


def cube_direction_scaled(u, live, region, rng):
    """Along one axis, as long as the live points spread there."""
    return cube_direction(u, live, region, rng) * live.std(axis=0)


def differential_direction(u, live, region, rng):
    """Between two different live points."""
    i = rng.integers(0, len(live), len(u))
    j = (i + rng.integers(1, len(live), len(u))) % len(live)
    return live[i] - live[j]


def cube_differential_direction(u, live, region, rng):
    """Along one axis, as far as two live points differ there."""
    v = np.zeros_like(u)
    k = (np.arange(len(u)), rng.integers(0, u.shape[1], len(u)))
    v[k] = differential_direction(u, live, region, rng)[k]
    return np.where(np.abs(v).sum(axis=1, keepdims=True) > 0, v, cube_direction_scaled(u, live, region, rng))


def partial_differential_direction(u, live, region, rng, share: float = 0.1):
    """Between two live points on some axes, at least one."""
    keep = rng.random(u.shape) < share
    keep[np.arange(len(u)), rng.integers(0, u.shape[1], len(u))] = True
    return np.where(keep, differential_direction(u, live, region, rng), 0.0)


def region_axis_direction(u, live, region, rng):
    """Along a whitened axis."""
    v = np.zeros_like(u)
    v[np.arange(len(u)), rng.integers(0, u.shape[1], len(u))] = 1
    return v @ region.t_inverse


def region_random_direction(u, live, region, rng):
    """In any whitened direction."""
    return _unit(rng.normal(size=u.shape)) @ region.t_inverse


def region_sample_direction(u, live, region, rng):
    """Towards a point drawn from the region."""
    s = np.zeros((0, u.shape[1]))
    while len(s) < len(u):
        s = np.concatenate([s, region.sample(2 * len(u), rng)])
    return s[: len(u)] - u


def mixture_direction(u, live, region, rng):
    """Half differential, half along a whitened axis."""
    pick = rng.random(len(u)) < 0.5
    return np.where(pick[:, None], differential_direction(u, live, region, rng), region_axis_direction(u, live, region, rng))


class SequentialDirection:
    """Axes in turn, whitened if there is a region."""

    def __init__(self, whitened: bool = False):
        self.k, self.whitened = 0, whitened

    def __call__(self, u, live, region, rng):
        v = np.zeros_like(u)
        v[:, self.k % u.shape[1]] = 1
        self.k += 1
        return v @ region.t_inverse if self.whitened else v * live.std(axis=0)


class OrthogonalDirection:
    """Directions of another kind, made orthogonal to the ones before until all dimensions are used."""

    def __init__(self, base: Direction = differential_direction):
        self.base, self.left = base, []

    def __call__(self, u, live, region, rng):
        d = u.shape[1]
        if not self.left:
            basis = np.stack([self.base(u, live, region, rng) for _ in range(d)], axis=2)
            q, r = np.linalg.qr(basis)
            self.left = [q[:, :, k] * np.abs(r[:, k, k])[:, None] for k in range(d)]
        return self.left.pop()


class SpeedDirection:
    """Fast axes more often: each step moves the axes of one entry of ``steps`` (a list of axis masks)."""

    def __init__(self, masks: list[list[int]], base: Direction = differential_direction):
        self.masks, self.base, self.k = masks, base, 0

    def __call__(self, u, live, region, rng):
        keep = np.zeros(u.shape[1], bool)
        keep[self.masks[self.k % len(self.masks)]] = True
        self.k += 1
        return np.where(keep, self.base(u, live, region, rng), 0.0)


DIRECTIONS: dict[str, Direction] = {
    "random": random_direction, "cube": cube_direction, "cube-scaled": cube_direction_scaled, "differential": differential_direction,
    "cube-differential": cube_differential_direction, "partial-differential": partial_differential_direction, "region-axis": region_axis_direction,
    "region-random": region_random_direction, "region-sample": region_sample_direction, "mixture": mixture_direction,
}


def line_to_cube(u: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where u + t v leaves the unit cube, backwards and forwards."""
    with np.errstate(divide="ignore", invalid="ignore"):
        a, b = -u / v, (1 - u) / v
    lo, hi = np.where(v == 0, -np.inf, np.minimum(a, b)), np.where(v == 0, np.inf, np.maximum(a, b))
    return lo.max(axis=1), hi.min(axis=1)


def ellipsoid_bracket(u: np.ndarray, v: np.ndarray, center: np.ndarray, inv_cov: np.ndarray, sq_radius: float) -> tuple[np.ndarray, np.ndarray]:
    """Where lines from inside an ellipsoid leave it."""
    x = u - center
    a = np.einsum("ij,jk,ik->i", v, inv_cov, v)
    b = np.einsum("ij,jk,ik->i", x, inv_cov, v)
    c = np.einsum("ij,jk,ik->i", x, inv_cov, x) - sq_radius
    root = np.sqrt(np.maximum(0, b * b - a * c))
    return (-b - root) / a, (-b + root) / a


def clip_to_scale(lo, hi, scale: float = 1.0):
    return np.maximum(lo, -scale), np.minimum(hi, scale)


def slice_steps(u, logl, threshold, live, region, evaluate, rng, nsteps: int, direction: Direction, step_out: bool = True, scale: float = 1.0):
    """Moves all walkers ``nsteps`` times by slices: a bracket on a line, doubled while its ends are above the
    threshold, then uniform draws in it that shrink the violated side. Returns points, values, calls, brackets seen."""
    u, logl, calls, spread = u.copy(), logl.copy(), 0, []
    above = lambda x: _above(x, threshold, evaluate)
    for _ in range(nsteps):
        v = direction(u, live, region, rng)
        lo_max, hi_max = line_to_cube(u, v)
        lo, hi = np.maximum(-scale, lo_max), np.minimum(scale, hi_max)
        if step_out:
            for end, limit in ((lo, lo_max), (hi, hi_max)):
                open_ = np.abs(end) < np.abs(limit)
                while open_.any():
                    i = np.flatnonzero(open_)
                    ok, _, n = above(u[i] + end[i, None] * v[i])
                    calls += n
                    open_[i[~ok]] = False
                    i = i[ok]
                    end[i] = np.sign(limit[i]) * np.minimum(np.abs(2 * end[i]), np.abs(limit[i]))
                    open_[i] = np.abs(end[i]) < np.abs(limit[i])
        else:
            lo, hi = lo_max, hi_max
        spread.append(float(np.mean(hi - lo)))
        todo = np.arange(len(u))
        lo, hi = lo.copy(), hi.copy()
        for _ in range(200):
            t = rng.uniform(lo[todo], hi[todo])
            x = u[todo] + t[:, None] * v[todo]
            ok, values, n = above(x)
            calls += n
            u[todo[ok]], logl[todo[ok]] = x[ok], values[ok]
            left = ~ok
            neg = t < 0
            lo[todo[left & neg]] = t[left & neg]
            hi[todo[left & ~neg]] = t[left & ~neg]
            todo = todo[left]
            if not len(todo):
                break
    return u, logl, calls, spread


def _above(x, threshold, evaluate):
    inside = ((x > 0) & (x < 1)).all(axis=1)
    values = np.full(len(x), -np.inf)
    if inside.any():
        values[inside] = evaluate(x[inside])
    return values > threshold, values, int(inside.sum())


def random_walk(u, logl, threshold, live, region, evaluate, rng, nsteps: int, direction: Direction, scale: float = 1.0, target: float = 0.234):
    """Metropolis steps within the threshold; the scale follows the share accepted. Returns points, values, calls, scale."""
    u, logl, calls = u.copy(), logl.copy(), 0
    for _ in range(nsteps):
        x = u + scale * rng.normal(size=len(u))[:, None] * direction(u, live, region, rng)
        ok, values, n = _above(x, threshold, evaluate)
        calls += n
        u[ok], logl[ok] = x[ok], values[ok]
        scale *= np.exp((ok.mean() - target) / np.sqrt(nsteps))
    return u, logl, calls, float(np.clip(scale, 1e-6, 10))


def far_enough(start: np.ndarray, end: np.ndarray, region) -> np.ndarray:
    """Whether moves were longer, in whitened space, than the neighbour radius."""
    d = region.transform(end) - region.transform(start)
    return (d * d).sum(axis=1) > region.sq_radius


def adapt_steps(n: int, far: float, most: int = 10_000) -> int:
    new = min(n - 1, n / 1.01) if far > 0.5 else max(n + 1, 1.01 * n)
    return int(np.clip(new, 1, most))


def reflect(v: np.ndarray, normal: np.ndarray) -> np.ndarray:
    n = normal / np.sqrt((normal * normal).sum())
    return v - 2 * (v @ n) * n


def steps_with_reflection(u: np.ndarray, v: np.ndarray, t: float) -> tuple[np.ndarray, np.ndarray]:
    """Where a ray in the unit cube that bounces off its walls is after ``t``, and its direction then."""
    x = u + t * v
    k = np.floor(x).astype(int)
    odd = k % 2 != 0
    frac = x - k
    return np.where(odd, 1 - frac, frac), np.where(odd, -v, v)


def random_start(logl: np.ndarray, threshold: float, rng: np.random.Generator) -> int:
    """Any live point."""
    return int(rng.integers(len(logl)))


def island_start(size: int, exchange: float = 0.0):
    """Chains for a dead point start from live points of its own island, a run of ``size`` places; sometimes (``exchange``) from any."""
    if size < 1 or not 0 <= exchange <= 1:
        raise ValueError("islands need a member, and exchange is a probability")

    def start(logl: np.ndarray, threshold: float, rng: np.random.Generator) -> int:
        dead = np.flatnonzero(logl == threshold)
        if not len(dead) or (exchange and rng.random() < exchange):
            return int(rng.integers(len(logl)))
        low = int(dead[0]) // size * size
        return int(rng.integers(low, min(len(logl), low + size)))

    return start


def step_report(start: np.ndarray, end: np.ndarray, region, accepted: int, tried: int, steps: int, scale: float) -> dict:
    """How a population's walk went: share of rejections, scale, steps, mean jump over the region's radius and the share that went further than that."""
    far = np.sqrt(((region.transform(end) - region.transform(start)) ** 2).sum(axis=1))
    reference = np.sqrt(max(region.sq_radius, 1e-300))
    return {"rejection_rate": 1 - accepted / max(1, tried), "scale": scale, "nsteps": steps, "mean_jump": float(far.mean() / reference) if len(far) else 0.0, "far_enough": float((far > reference).mean()) if len(far) else 0.0}
