"""The evidence integral as ordered sums over a table of points.

points: point_id, logl, parent_id (null for draws from the prior) and root_id.
Ordered by (logl, point_id), the number of live points before a row is the
number of roots plus the sum of (children - 1) of all rows before it. The log
volume is a running sum of steps, and the evidence a log-sum-exp.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import logaddexp, logsumexp
from .ordered import PART, range_partitioned, running_sum

ORDER = ("logl", "point_id")


def live_points(points: DataFrame) -> DataFrame:
    """Adds nchild, rk and nlive."""
    children = points.where("parent_id is not null").groupBy(F.col("parent_id").alias("point_id")).agg(F.count(F.lit(1)).alias("nchild"))
    p = points.join(children, "point_id", "left").withColumn("nchild", F.coalesce("nchild", F.lit(0).cast("long")))
    roots = points.where("parent_id is null").agg(F.count(F.lit(1)).alias("__roots"))
    p = range_partitioned(p.join(F.broadcast(roots)), *ORDER)  # one row
    p = running_sum(p, F.lit(1).cast("long"), "rk", *ORDER)
    p = running_sum(p, F.col("nchild") - 1, "__change", *ORDER, exclusive=True)
    return p.withColumn("nlive", F.col("__roots") + F.col("__change")).drop("__roots", "__change")


def live_points_from_births(points: DataFrame, birth: str = "birth") -> DataFrame:
    """nlive for tables that know only the threshold of birth: a sweep over births and deaths.
    A birth at a value counts after all deaths at it; a null birth is from the prior."""
    deaths = points.select(F.col("logl").alias("v"), F.lit(0).alias("k"), "point_id", F.lit(-1).cast("long").alias("d"))
    births = points.select(F.coalesce(F.col(birth), F.lit(float("-inf"))).alias("v"), F.lit(1).alias("k"), "point_id", F.lit(1).cast("long").alias("d"))
    events = range_partitioned(deaths.unionByName(births), "v", "k", "point_id")
    swept = running_sum(events, F.col("d"), "nlive", "v", "k", "point_id", exclusive=True)
    return points.join(swept.where("k = 0").select("point_id", "nlive"), "point_id")


def step(nlive: str = "nlive", tail: Column | None = None) -> Column:
    """Change of log volume after a row. Rows of the tail contract, others shrink."""
    n = F.col(nlive).cast("double")
    t = F.col("nchild") == 0 if tail is None else tail
    return F.when(t, F.log(F.greatest(F.lit(1.0) - F.lit(1.0) / n, F.lit(1e-300)))).otherwise(F.lit(-1.0) / n)


def log_weight(nlive: str = "nlive", tail: Column | None = None) -> Column:
    n = F.col(nlive).cast("double")
    t = F.col("nchild") == 0 if tail is None else tail
    return F.col("logvol") + F.when(t, -F.log(n)).otherwise(F.log(F.lit(1.0) - F.exp(F.lit(-1.0) / n)))


def weighted(points: DataFrame, tail: Column | None = None) -> DataFrame:
    """Adds nchild, rk, nlive, logvol (before the row), logw and logwt = logw + logl."""
    p = running_sum(live_points(points), step(tail=tail), "logvol", *ORDER, exclusive=True)
    p = p.withColumn("logw", log_weight(tail=tail))
    return p.withColumn("logwt", F.col("logw") + F.col("logl"))


def weighted_stochastic(points: DataFrame, seed: int, tail: Column | None = None) -> DataFrame:
    """Like weighted(), with shrinkages drawn from Beta(1, nlive) by inverse CDF, seeded by point."""
    p = live_points(points)
    u = (F.pmod(F.xxhash64(F.lit(seed), F.col("point_id")), F.lit(1 << 52)).cast("double") + 0.5) / float(1 << 52)
    left = F.log(u) / F.col("nlive")
    t = F.col("nchild") == 0 if tail is None else tail
    p = p.withColumn("__left", left)
    p = running_sum(p, F.when(t, step(tail=F.lit(True))).otherwise(F.col("__left")), "logvol", *ORDER, exclusive=True)
    w = F.col("logvol") + F.when(t, -F.log(F.col("nlive").cast("double"))).otherwise(F.log(-F.expm1(F.col("__left"))))
    return p.withColumn("logw", w).withColumn("logwt", F.col("logw") + F.col("logl")).drop("__left")


def with_peak(df: DataFrame, col: str = "logwt", by: list[str] | None = None) -> DataFrame:
    """Adds the maximum of ``col`` as peak (of each group, for grouped frames)."""
    top = df.groupBy(*by).agg(F.max(col).alias("peak")) if by else df.agg(F.max(col).alias("peak"))
    return df.join(F.broadcast(top), by) if by else df.join(F.broadcast(top))


def summary(w: DataFrame) -> DataFrame:
    """One row from weighted(): n, logz, ess, h (information over inner rows), logzerr_single."""
    p = with_peak(w)
    e = F.exp(F.col("logwt") - F.col("peak"))
    inner = F.when(F.col("nchild") > 0, e)
    s = p.agg(
        F.count(F.lit(1)).alias("n"),
        logsumexp("logwt", F.col("peak")).alias("logz"),
        (F.pow(F.sum(e), 2) / F.sum(e * e)).alias("ess"),
        (F.max("peak") + F.log(F.sum(inner))).alias("__inner"),
        (F.sum(inner * F.col("logl")) / F.sum(inner)).alias("__mean"),
        F.max("nlive").alias("max_nlive"),
    )
    s = s.withColumn("h", F.col("__mean") - F.col("__inner"))
    return s.select("n", "logz", "ess", "h", "max_nlive", F.sqrt(F.greatest(F.col("h"), F.lit(0.0)) / F.col("max_nlive")).alias("logzerr_single"))


def running_evidence(w: DataFrame) -> DataFrame:
    """The sequence of a run: state before each row and after it (logz)."""
    p = with_peak(w)
    p = running_sum(p, F.exp(F.col("logwt") - F.col("peak")), "__z", *ORDER)
    return p.withColumn("logz", F.col("peak") + F.log("__z")).drop("__z", "peak")


def remainder(w: DataFrame) -> DataFrame:
    """Adds logz_remain and remainder_fraction: what the live points could still add after each row.

    The live points at a row are itself and the later ones already born, so the
    sum over them is a running sum of births minus deaths of exp(logl)."""
    top = w.agg(F.max("logl").alias("lmax"))
    base = w.join(F.broadcast(top))
    parent = base.where("parent_id is not null").select(F.col("parent_id").alias("point_id"), F.exp(F.col("logl") - F.col("lmax")).alias("e"))
    gains = parent.groupBy("point_id").agg(F.sum("e").alias("gain"))
    roots = base.where("parent_id is null").agg(F.sum(F.exp(F.col("logl") - F.col("lmax"))).alias("start"))
    p = running_evidence(w).join(F.broadcast(top)).join(F.broadcast(roots)).join(gains, "point_id", "left")
    p = range_partitioned(p.drop("__part"), *ORDER)
    change = F.coalesce("gain", F.lit(0.0)) - F.exp(F.col("logl") - F.col("lmax"))
    p = running_sum(p, change, "__live", *ORDER, exclusive=True)
    after = F.col("logvol") + step() - F.log(F.col("nlive").cast("double"))
    p = p.withColumn("logz_remain", F.col("lmax") + F.log(F.col("start") + F.col("__live")) + after)
    return p.withColumn("remainder_fraction", F.lit(1.0) / (F.lit(1.0) + F.exp(F.col("logz") - F.col("logz_remain")))).drop("__live", "start", "gain", "lmax")


def conservative_remainder(w: DataFrame) -> DataFrame:
    """Largest likelihood plus the log volume left at the end."""
    return w.agg((F.max("logl") + F.min("logvol")).alias("logz_remain_max"))


def width_between(w: DataFrame, lo: float, hi: float) -> DataFrame:
    """Rows and greatest width of a run, in all and within a range of likelihoods."""
    inside = F.col("logl").between(lo, hi)
    return w.agg(F.count(F.lit(1)).alias("n"), F.max("nlive").alias("max_nlive"), F.count_if(inside).alias("n_between"), F.max(F.when(inside, F.col("nlive"))).alias("max_nlive_between"))


def error_budget(s: DataFrame, logzerr_bs: Column, tail_fraction: Column) -> DataFrame:
    tail = F.log1p(tail_fraction)
    return s.select("logz", "logzerr_single", tail.alias("logzerr_tail"), logzerr_bs.alias("logzerr_bs"), F.sqrt(tail * tail + logzerr_bs * logzerr_bs).alias("logzerr"))


def combine_logz(a: Column, b: Column) -> Column:
    return logaddexp(a, b)


def _by_bootstrap(points: DataFrame, boot: DataFrame) -> tuple[DataFrame, list, dict]:
    """Points of any bootstrap, in sorted ranges, with nchild and __boots (the bootstraps that hold their root); all boot_ids in order; and by
    range how many points are live in each bootstrap before it. The driver holds one number for each range and bootstrap."""
    children = points.where("parent_id is not null").groupBy(F.col("parent_id").alias("point_id")).agg(F.count(F.lit(1)).alias("nchild"))
    lists = boot.groupBy("root_id").agg(F.collect_list("boot_id").alias("__boots"))
    p = points.join(lists, "root_id").join(children, "point_id", "left").withColumn("nchild", F.coalesce("nchild", F.lit(0).cast("long")))
    p = range_partitioned(p, *ORDER, sort=True)
    change = p.groupBy(PART, "root_id").agg(F.sum(F.col("nchild") - 1).alias("d"), F.count_if(F.col("parent_id").isNull()).alias("roots"))
    rows = change.join(boot, "root_id").groupBy(PART, "boot_id").agg(F.sum("d").alias("d"), F.sum("roots").alias("roots")).orderBy(PART).collect()
    ids = sorted({r["boot_id"] for r in rows})
    at, live, starts = {b: k for k, b in enumerate(ids)}, np.zeros(len(ids), np.int64), {}
    for r in rows:
        live[at[r["boot_id"]]] += r["roots"]
    for r in rows:
        starts.setdefault(r[PART], live.copy())
        live[at[r["boot_id"]]] += r["d"]
    return p, ids, starts


def _sweep(batch: pa.RecordBatch, ids: np.ndarray, live: np.ndarray, logvol: np.ndarray):
    """For each bootstrap in an ordered batch: its number, its rows, and their nlive, logvol and logw. ``live`` and ``logvol`` are the state before the batch, and after."""
    lists = batch.column("__boots")
    row = np.repeat(np.arange(len(batch)), pc.list_value_length(lists).to_numpy(zero_copy_only=False))
    k = np.searchsorted(ids, lists.flatten().to_numpy(zero_copy_only=False))
    row = row[np.argsort(k, kind="stable")]
    ends = np.cumsum(np.bincount(k, minlength=len(ids)))
    nchild = batch.column("nchild").to_numpy(zero_copy_only=False)
    for b, (start, end) in enumerate(zip(np.append(0, ends[:-1]), ends)):
        if start == end:
            continue
        at = row[start:end]
        c = nchild[at]
        nlive = live[b] + np.cumsum(c - 1) - (c - 1)
        if nlive.min() < 1:
            raise ValueError("a row comes where no point is live: parents must lie below their children")
        step = np.where(c == 0, np.log(np.maximum(1.0 - 1.0 / nlive, 1e-300)), -1.0 / nlive)
        after = logvol[b] + np.cumsum(step)
        before = np.append(logvol[b], after[:-1])
        logw = before + np.where(c == 0, -np.log(nlive), np.log(1.0 - np.exp(-1.0 / nlive)))
        live[b], logvol[b] = nlive[-1] + c[-1] - 1, after[-1]
        yield b, at, nlive, before, logw


def _range_totals(p: DataFrame, boot_type: str, ids: list, starts: dict) -> DataFrame:
    """One row for each range and bootstrap, with volumes from the range's start: rows, change of log volume, greatest logwt and sums relative to it."""

    def totals(batches):
        numbers, part = np.array(ids), None
        for batch in batches:
            if not len(batch):
                continue
            if part is None:
                part, kind = batch.column(PART)[0].as_py(), batch.column("__boots").type.value_type
                live, logvol, n, peak, sums = starts[part].copy(), np.zeros(len(ids)), np.zeros(len(ids), np.int64), np.full(len(ids), -np.inf), np.zeros((3, len(ids)))
            logl, known = batch.column("logl").to_numpy(zero_copy_only=False), pc.is_valid(batch.column("logl")).to_numpy(zero_copy_only=False)
            inner = batch.column("nchild").to_numpy(zero_copy_only=False) > 0
            for b, at, _, _, logw in _sweep(batch, numbers, live, logvol):
                n[b] += len(at)
                at, logw = at[known[at]], logw[known[at]]  # a null likelihood has no weight
                logwt = logw + logl[at]
                top = max(peak[b], logwt.max(initial=-np.inf))
                if top == -np.inf:
                    continue
                e, i = np.exp(logwt - top), inner[at]
                sums[:, b] = sums[:, b] * np.exp(peak[b] - top) + (e.sum(), e[i].sum(), (e[i] * logl[at][i]).sum())
                peak[b] = top
        if part is not None:
            out = [pa.array([part] * len(ids), pa.int32()), pa.array(ids, kind), pa.array(n), pa.array(logvol), pa.array(peak), *map(pa.array, sums)]
            yield pa.RecordBatch.from_arrays(out, ["part", "boot_id", "n", "steps", "peak", "e", "inner", "inner_logl"]).filter(pa.array(n > 0))

    return p.select(PART, "logl", "nchild", "__boots").mapInArrow(totals, f"part int, boot_id {boot_type}, n long, steps double, peak double, e double, inner double, inner_logl double")


def bootstrap_totals(points: DataFrame, boot: DataFrame) -> DataFrame:
    """boot_id, n, logz and h (the information over inner rows, null without any) of each bootstrap, which holds some roots' trees.

    boot: (boot_id, root_id). Points are ranged by likelihood once and go once over all
    bootstraps; weights count from the start of their range, which is then moved
    by the volume before it, so neither are rows copied nor weights kept."""
    p, ids, starts = _by_bootstrap(points, boot)
    before = Window.partitionBy("boot_id").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    t = _range_totals(p, boot.schema["boot_id"].dataType.simpleString(), ids, starts).withColumn("peak", F.col("peak") + F.coalesce(F.sum("steps").over(before), F.lit(0.0)))
    t = t.withColumn("top", F.max("peak").over(Window.partitionBy("boot_id")))  # one row for each range
    f = F.exp(F.col("peak") - F.col("top"))
    inner = F.nullif(F.sum(F.col("inner") * f), F.lit(0.0))
    logz, top = F.max("top") + F.log(F.sum(F.col("e") * f)), F.max("top")
    return t.groupBy("boot_id").agg(F.sum("n").alias("n"), logz.alias("logz"), (F.sum(F.col("inner_logl") * f) / inner - top - F.log(inner)).alias("h"))


def bootstrap_evidence(points: DataFrame, boot: DataFrame) -> DataFrame:
    """(boot_id, point_id, logl, logw, logwt, ...) for each bootstrap, which holds some roots' trees.

    boot: (boot_id, root_id). As bootstrap_totals(), but with a row for each point and
    bootstrap that has its root; a first sweep gives the volume before each range."""
    p, ids, starts = _by_bootstrap(points, boot)
    boot_type = boot.schema["boot_id"].dataType.simpleString()
    at, total, volumes = {b: k for k, b in enumerate(ids)}, np.zeros(len(ids)), {}
    for r in _range_totals(p, boot_type, ids, starts).select("part", "boot_id", "steps").orderBy("part").collect():
        volumes.setdefault(r["part"], total.copy())
        total[at[r["boot_id"]]] += r["steps"]
    keep = [c for c in p.columns if c not in ("__boots", "boot_id")]

    def rows(batches):
        numbers, live = np.array(ids), None
        for batch in batches:
            if not len(batch):
                continue
            if live is None:
                part = batch.column(PART)[0].as_py()
                live, logvol = starts[part].copy(), volumes[part].copy()
            kept = batch.select(keep)
            for b, at, nlive, before, logw in _sweep(batch, numbers, live, logvol):
                own = kept.take(pa.array(at))
                new = [pa.array([ids[b]] * len(at), batch.column("__boots").type.value_type), *map(pa.array, (nlive, before, logw))]
                yield pa.RecordBatch.from_arrays([new[0], *own.columns, *new[1:]], ["boot_id", *keep, "nlive", "logvol", "logw"])

    names = ", ".join(f"`{c}` {p.schema[c].dataType.simpleString()}" for c in keep)
    b = p.mapInArrow(rows, f"boot_id {boot_type}, {names}, nlive long, logvol double, logw double")
    return b.withColumn("logwt", F.col("logw") + F.col("logl"))


def bootstrap_information(b: DataFrame) -> DataFrame:
    """boot_id, h: the information of each bootstrap, over inner rows as in summary()."""
    e = F.exp(F.col("logwt") - F.col("peak"))
    p = with_peak(b, by=["boot_id"]).where("nchild > 0")
    return p.groupBy("boot_id").agg((F.sum(e * F.col("logl")) / F.sum(e) - F.max("peak") - F.log(F.sum(e))).alias("h"))


def evidence_view(w: DataFrame) -> DataFrame:
    """point_id, logvol, relative logl (0 at the maximum) and relative logwt (to the final evidence): what an evidence plot shows."""
    ends = w.agg(F.max("logl").alias("__top")).join(F.broadcast(summary(w).select(F.col("logz").alias("__z"))))  # one row
    return w.join(F.broadcast(ends)).select("point_id", "logvol", (F.col("logl") - F.col("__top")).alias("logl_relative"), (F.col("logwt") - F.col("__z")).alias("logwt_relative"))


def volume_density(w: DataFrame, grid: int = 100, cells: int = 2000) -> DataFrame:
    """(x, density): Gaussian kernel density of the posterior weights over -logvol at ``grid`` points, with Scott's bandwidth.

    Weights are added up in ``cells`` cells first, so what meets the grid does not grow with the run."""
    p = with_peak(w).select((-F.col("logvol")).alias("x"), F.exp(F.col("logwt") - F.col("peak")).alias("e"))
    s = p.agg(F.min("x").alias("lo"), F.max("x").alias("hi"), F.sum("e").alias("total"), (F.pow(F.sum("e"), 2) / F.sum(F.col("e") * F.col("e"))).alias("ess"), (F.sum(F.col("e") * F.col("x")) / F.sum("e")).alias("mean"), (F.sum(F.col("e") * F.col("x") * F.col("x")) / F.sum("e")).alias("sq"))
    s = s.withColumn("width", F.greatest(F.sqrt(F.greatest(F.col("sq") - F.col("mean") * F.col("mean"), F.lit(0.0))) * F.pow("ess", F.lit(-0.2)), (F.col("hi") - F.col("lo")) / cells, F.lit(1e-12)))
    span = F.greatest(F.col("hi") - F.col("lo"), F.lit(1e-12))
    binned = p.join(F.broadcast(s)).groupBy(F.least(F.floor((F.col("x") - F.col("lo")) / span * cells), F.lit(cells - 1)).alias("cell")).agg((F.sum("e") / F.max("total")).alias("mass"), (F.sum(F.col("e") * F.col("x")) / F.sum("e")).alias("at"))
    points = s.select("width", F.explode(F.transform(F.sequence(F.lit(0), F.lit(grid - 1)), lambda k: F.col("lo") + (F.col("hi") - F.col("lo")) * k / float(grid - 1))).alias("x"))
    z = (F.col("x") - F.col("at")) / F.col("width")
    return binned.join(F.broadcast(points)).groupBy("x").agg((F.sum(F.col("mass") * F.exp(-z * z / 2)) / (F.max("width") * math.sqrt(2 * math.pi))).alias("density"))


def bootstrap_logz(b: DataFrame) -> DataFrame:
    """boot_id, n, logz."""
    return with_peak(b, by=["boot_id"]).groupBy("boot_id").agg(F.count(F.lit(1)).alias("n"), logsumexp("logwt", F.col("peak")).alias("logz"))


def bootstrap_kl(main: DataFrame, b: DataFrame) -> DataFrame:
    """Kullback-Leibler divergence of each bootstrap's posterior weights from the main run's."""
    zb = bootstrap_logz(b).select("boot_id", F.col("logz").alias("zb"))
    z0 = summary(main).select(F.col("logz").alias("z0"))
    j = b.join(F.broadcast(zb), "boot_id").join(main.select("point_id", F.col("logwt").alias("w0")), "point_id").join(F.broadcast(z0))
    lb, l0 = F.col("logwt") - F.col("zb"), F.col("w0") - F.col("z0")
    return j.groupBy("boot_id").agg(F.sum(F.exp(lb) * (lb - l0)).alias("kl"))
