"""Nested sampling in rounds.

One Spark job a round: tasks draw candidates from the region (or move walkers),
evaluate the likelihood as arrays and send back those above the threshold. The
driver keeps only the live points of the run. Every accepted row has the
threshold as its birth; the evidence then comes from the table of points, by
marginalia.operators.evidence, and runs can be merged by union.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import walkers
from .evidence import log_weight, step, with_peak
from .ordered import range_partitioned, running_sum
from .regions_np import Region

SCHEMA = "u array<double>, logl double, calls long"


def vectorize(f: Callable) -> Callable:
    """A function of one row as a function of many."""
    return lambda rows: np.array([f(r) for r in rows])


@dataclass
class Problem:
    """Names, prior transform (rows of the unit cube to rows of parameters) and log-likelihood of such rows."""

    names: list[str]
    loglike: Callable[[np.ndarray], np.ndarray]
    transform: Callable[[np.ndarray], np.ndarray] = lambda u: u
    derived: list[str] = field(default_factory=list)
    wrapped: list[bool] | None = None

    def check(self, rng: np.random.Generator) -> None:
        u = rng.random((2, len(self.names)))
        p = np.asarray(self.transform(u))
        if p.shape != (2, len(self.names) + len(self.derived)):
            raise ValueError(f"the transform gives shape {p.shape}")
        value = np.asarray(self.loglike(p))
        if value.shape != (2,) or not np.isfinite(value).all():
            raise ValueError("the log-likelihood must give one finite value a row")

    def evaluate(self, u: np.ndarray) -> np.ndarray:
        out = np.asarray(self.loglike(self.transform(u)), float)
        return np.where(np.isfinite(out), out, -1e100)


def _job(spark: SparkSession, tasks: int, seed: list[int], work: Callable[[np.random.Generator], tuple[np.ndarray, np.ndarray, int]]) -> tuple[np.ndarray, np.ndarray, int]:
    """Runs ``work`` in so many tasks, each seeded by run, round and task, and gathers its rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for task in b.column(0).to_pylist():
                u, logl, calls = work(np.random.default_rng([*seed, task]))
                n = len(u)
                yield pa.RecordBatch.from_arrays([pa.array(list(u) if n else [], pa.list_(pa.float64())), pa.array(logl, pa.float64()), pa.array([calls] + [0] * (n - 1) if n else [], pa.int64())], names=["u", "logl", "calls"])

    rows = spark.range(0, tasks, 1, tasks).mapInArrow(run, SCHEMA).toArrow()
    if not len(rows):
        return np.zeros((0, 0)), np.zeros(0), 0
    u = np.stack(rows.column(0).to_numpy(zero_copy_only=False)) if len(rows) else np.zeros((0, 0))
    return u, rows.column(1).to_numpy(), int(rows.column(2).to_numpy().sum())


class NestedSampler:
    """A run with a fixed number of live points.

    ``stepper``: None (draw from the region), "slice", "simple-slice" or "walk"."""

    def __init__(self, spark: SparkSession, problem: Problem, n_live: int = 400, seed: int = 1, region: str = "friends", stepper: str | None = None, nsteps: int = 10, direction: str = "mixture", tasks: int | None = None, batch: int | None = None):
        if stepper not in (None, "slice", "simple-slice", "walk"):
            raise ValueError(f"unknown stepper {stepper}")
        self.spark, self.problem, self.n_live, self.seed, self.kind = spark, problem, n_live, seed, region
        self.stepper, self.nsteps, self.direction = stepper, nsteps, direction
        self.tasks = tasks or spark.sparkContext.defaultParallelism
        self.batch = batch or max(1, n_live // 10)
        self.rows: list[tuple[np.ndarray, float, float, bool]] = []
        self.calls, self.rounds = 0, 0
        problem.check(np.random.default_rng([seed, 0]))

    def prior_draws(self, n: int, round_: int = 0) -> tuple[np.ndarray, np.ndarray]:
        per, d, problem = -(-n // self.tasks), len(self.problem.names), self.problem

        def work(rng):
            u = rng.random((per, d))
            return u, problem.evaluate(u), per

        u, logl, calls = _job(self.spark, self.tasks, [self.seed, round_], work)
        self.calls += calls
        return u[:n], logl[:n]

    def _candidates(self, region: Region, live_u, live_l, threshold: float, want: int, draw: int):
        problem, live = self.problem, live_u[live_l > threshold]
        if self.stepper is None:

            def work(rng):
                u = region.sample(draw, rng)
                logl = problem.evaluate(u) if len(u) else np.zeros(0)
                ok = logl > threshold
                return u[ok], logl[ok], len(u)
        else:
            per, nsteps, kind = -(-want // self.tasks), self.nsteps, self.stepper
            direction = walkers.DIRECTIONS[self.direction]
            start_l = live_l[live_l > threshold]

            def work(rng):
                i = rng.integers(0, len(live), per)
                if kind == "walk":
                    u, logl, calls, _ = walkers.random_walk(live[i], start_l[i], threshold, live, region, problem.evaluate, rng, nsteps, direction)
                else:
                    u, logl, calls, _ = walkers.slice_steps(live[i], start_l[i], threshold, live, region, problem.evaluate, rng, nsteps, direction, kind == "slice")
                return u, logl, calls

        self.rounds += 1
        u, logl, calls = _job(self.spark, self.tasks, [self.seed, self.rounds], work)
        self.calls += calls
        return u, logl

    def run(self, dlogz: float = 0.01, max_iters: int | None = None) -> "NestedSampler":
        """Until what is left in the live points would add less than ``dlogz`` to the evidence."""
        rng = np.random.default_rng([self.seed, 999_983])
        u, logl = self.prior_draws(self.n_live)
        birth = np.full(len(u), -np.inf)
        region, region_volume, logvol, logz, draw = None, 0.0, 0.0, -np.inf, 512
        spare_u, spare_l, spare_b = np.zeros((0, u.shape[1])), np.zeros(0), np.zeros(0)
        while True:
            n = len(u)
            order = np.argsort(logl, kind="stable")
            left = logvol - math.log(n) + np.logaddexp.reduce(logl)
            if np.logaddexp(logz, left) - logz < dlogz or logl.max() - logl.min() < 1e-9 or max_iters and len(self.rows) >= max_iters:
                break
            k = min(self.batch, n - 2)
            threshold = float(logl[order[k - 1]])
            dead = np.flatnonzero(logl <= threshold)  # ties leave together
            if len(dead) > n - 2:
                break  # a plateau that is all there is
            alive = np.setdiff1d(np.arange(n), dead)
            plateau = len(np.unique(logl[dead])) < len(dead)
            for j, i in enumerate(dead[np.argsort(logl[dead], kind="stable")]):
                m = n - j
                logz = np.logaddexp(logz, logvol + (math.log(-math.expm1(-1 / m)) if not plateau else -math.log(m)) + logl[i])
                logvol += -1 / m if not plateau else math.log1p(-1 / m)
                self.rows.append((u[i], float(logl[i]), float(birth[i]), plateau))
            if region is None or logvol < region_volume + math.log(0.8):
                try:
                    region = Region(u, rng, self.kind)
                except np.linalg.LinAlgError:
                    pass
                region_volume = logvol
            u, logl, birth = u[alive], logl[alive], birth[alive]
            want = self.n_live - len(u)
            ok = (spare_l > threshold) & (spare_b <= threshold)
            spare_u, spare_l, spare_b = spare_u[ok], spare_l[ok], spare_b[ok]
            tries = 0
            while len(spare_u) < want:
                new_u, new_l = self._candidates(region, np.concatenate([u, spare_u]), np.concatenate([logl, spare_l]), threshold, want, draw)
                if len(new_u):
                    spare_u, spare_l, spare_b = np.concatenate([spare_u, new_u]), np.concatenate([spare_l, new_l]), np.concatenate([spare_b, np.full(len(new_l), threshold)])
                rate = max(1, len(new_u)) / (draw * self.tasks)
                if self.stepper is None:
                    draw = int(np.clip(0.5 * draw + 0.5 * 2 * want / rate / self.tasks, 128, 65_536))
                tries += 1
                if tries > 1000:
                    raise RuntimeError(f"no new points above {threshold}")
            # spare rows were drawn above their own, lower birth and lie above this threshold: valid here
            u, logl, birth = np.concatenate([u, spare_u[:want]]), np.concatenate([logl, spare_l[:want]]), np.concatenate([birth, np.full(want, threshold)])
            spare_u, spare_l, spare_b = spare_u[want:], spare_l[want:], spare_b[want:]
        for i in np.argsort(logl, kind="stable"):
            self.rows.append((u[i], float(logl[i]), float(birth[i]), True))
        return self

    def points(self, run_id: str = "run") -> DataFrame:
        """The table of points: run_id, point_id, logl, birth (null: prior), is_tail, u, p."""
        us = np.array([r[0] for r in self.rows])
        ps = np.asarray(self.problem.transform(us))
        rows = pa.table(
            {
                "run_id": pa.array([run_id] * len(us)),
                "point_id": pa.array(np.arange(len(us), dtype=np.int64)),
                "logl": pa.array([r[1] for r in self.rows]),
                "birth": pa.array([None if r[2] == -np.inf else r[2] for r in self.rows], pa.float64()),
                "is_tail": pa.array([r[3] for r in self.rows]),
                "u": pa.array(list(us), pa.list_(pa.float64())),
                "p": pa.array(list(ps), pa.list_(pa.float64())),
            }
        )
        return self.spark.createDataFrame(rows)


def weigh_points(points: DataFrame) -> DataFrame:
    """Log weights of sampled points, merged runs included, by births: adds nlive, logvol, logw, logwt.

    Rows between two thresholds are ordinary order statistics and shrink the
    volume; rows of the tail or of a plateau contract it."""
    from .evidence import live_points_from_births

    p = live_points_from_births(points).withColumn("nchild", F.when(F.col("is_tail"), 0).otherwise(1))
    p = range_partitioned(p, "logl", "point_id")
    p = running_sum(p, step(), "logvol", "logl", "point_id", exclusive=True)
    p = p.withColumn("logw", log_weight())
    return p.withColumn("logwt", F.col("logw") + F.col("logl"))


def results(points: DataFrame, names: list[str]) -> tuple[DataFrame, DataFrame]:
    """(summary: n, logz, ess, h, logzerr), (posterior: param, mean, stdev)."""
    from .posterior import moments

    w = with_peak(weigh_points(points))
    e = F.exp(F.col("logwt") - F.col("peak"))
    s = w.agg(
        F.count(F.lit(1)).alias("n"), (F.max("peak") + F.log(F.sum(e))).alias("logz"), (F.pow(F.sum(e), 2) / F.sum(e * e)).alias("ess"),
        (F.sum(e * F.col("logl")) / F.sum(e)).alias("__m"), F.max("nlive").alias("__n"),
    )
    s = s.withColumn("h", F.col("__m") - F.col("logz"))
    s = s.select("n", "logz", "ess", "h", F.sqrt(F.greatest(F.col("h"), F.lit(0.0)) / F.col("__n")).alias("logzerr"))
    flat = w.select(e.alias("weight"), *[F.element_at("p", i + 1).alias(n) for i, n in enumerate(names)])
    return s, moments(flat, names)


class ReactiveSampler:
    """Runs until goals are met: adds runs of growing width and merges their points."""

    def __init__(self, spark: SparkSession, problem: Problem, seed: int = 1, **options):
        self.spark, self.problem, self.seed, self.options = spark, problem, seed, options
        self.parts: list[DataFrame] = []

    def run_iter(self, min_ess: float = 400, dlogz: float = 0.5, frac_remain: float = 0.01, min_num_live_points: int = 400, max_num_improvement_loops: int = 6):
        """Yields (summary row, points) after each pass."""
        if math.log1p(frac_remain) > dlogz:
            raise ValueError("frac_remain is too large for dlogz")
        n = max(min_num_live_points, math.ceil(math.sqrt(1000) / dlogz))
        offset = 0
        for k in range(max_num_improvement_loops + 1):
            s = NestedSampler(self.spark, self.problem, n, self.seed + 7919 * k, **self.options).run(math.log1p(frac_remain))
            part = s.points(f"part{k}").withColumn("point_id", F.col("point_id") + offset)
            offset += len(s.rows)
            self.parts.append(part)
            merged = self.parts[0]
            for p in self.parts[1:]:
                merged = merged.unionByName(p)
            row = results(merged, self.problem.names + self.problem.derived)[0].first()
            yield row, merged
            if row["ess"] >= min_ess and row["logzerr"] <= dlogz:
                return
            n = max(n, math.ceil(n * (row["logzerr"] / dlogz) ** 2))

    def run(self, **goals):
        out = None
        for out in self.run_iter(**goals):
            pass
        return out


def calibrate(spark: SparkSession, problem: Problem, seed: int = 1, most: int = 8, **options) -> list[tuple[int, float, float]]:
    """Doubles the steps of a slice sampler until the last three evidences agree and show no trend: (nsteps, logz, logzerr)."""
    out: list[tuple[int, float, float]] = []
    nsteps = len(problem.names)
    for _ in range(most):
        s = NestedSampler(spark, problem, seed=seed, stepper="slice", nsteps=nsteps, **options).run()
        row = results(s.points(), problem.names + problem.derived)[0].first()
        out.append((nsteps, row["logz"], row["logzerr"]))
        if len(out) >= 3:
            (_, a, ea), (_, b, eb), (_, c, ec) = out[-3:]
            agree = abs(c - b) < math.hypot(eb, ec) and abs(b - a) < math.hypot(ea, eb)
            if agree and not (a < b < c or a > b > c):
                break
        nsteps *= 2
    return out


def solve(spark: SparkSession, loglike: Callable, transform: Callable, n_dims: int, n_live_points: int = 400, evidence_tolerance: float = 0.5, speed: str | int = "safe", seed: int = 1) -> dict:
    """One call: logz, logzerr, ess and the points. ``speed``: "safe" draws from the region, "auto" or a number of steps uses slices."""
    problem = Problem([f"x{i + 1}" for i in range(n_dims)], loglike, transform)
    options = {} if speed == "safe" else {"stepper": "slice", "nsteps": 4 * n_dims if speed == "auto" else int(speed)}
    s = NestedSampler(spark, problem, n_live_points, seed, **options).run(min(evidence_tolerance, 0.1))
    row = results(s.points(), problem.names)[0].first()
    return {"logZ": row["logz"], "logZerr": row["logzerr"], "ess": row["ess"], "ncall": s.calls, "points": s.points()}
