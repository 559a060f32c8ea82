"""What a run on one tree still needs: results in one row, goals, and where to widen."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .chained import in_tree
from .evidence import ORDER, bootstrap_evidence, bootstrap_kl, bootstrap_logz, bootstrap_totals, summary, weighted, with_peak
from .ordered import following, materialise, range_partitioned, running_sum
from .posterior import resample_counts
from .strategy import least_width, parents_before


def rebuild_tree(stored: DataFrame) -> DataFrame:
    """Stored rows (seq, birth, logl, ...) as points of a tree: adds point_id and parent_id.

    A row hangs under the first row of the tree (by logl, seq) at or above its birth
    threshold, as a walk up the tree would find it; that row must lie below it, or the
    row is left out, and no other row can hang under it. A null or infinite birth is a
    draw from the prior, without a parent.
    """
    stored = materialise(in_tree(stored).where("fits").drop("fits"))
    from_prior = F.col("birth").isNull() | (F.col("birth") == float("-inf"))
    points = stored.select(F.col("logl").alias("v"), F.lit(1).alias("k"), "seq", F.struct("logl", "seq").alias("here"))
    births = stored.where(~from_prior).select(F.col("birth").alias("v"), F.lit(0).alias("k"), "seq", F.lit(None).cast(points.schema["here"].dataType).alias("here"))
    swept = following(range_partitioned(points.unionByName(births), "v", "k", "seq"), F.col("here"), "parent", "v", "k", "seq")
    found = swept.where("k = 0").select("seq", "parent")
    out = stored.join(found, "seq", "left").where(from_prior | (F.col("parent.logl") < F.col("logl")))
    return materialise(out.select(F.col("seq").alias("point_id"), F.when(~from_prior, F.col("parent.seq")).alias("parent_id"), *[c for c in stored.columns if c not in ("point_id", "parent_id")]))


def with_roots(points: DataFrame, most_rounds: int = 40) -> DataFrame:
    """Adds root_id, the first ancestor of each point, by pointer doubling."""
    s = materialise(points.select("point_id", F.coalesce("parent_id", "point_id").alias("up")))
    for _ in range(most_rounds):
        hop = s.select(F.col("point_id").alias("up"), F.col("up").alias("up2"))
        moved = materialise(s.join(hop, "up").select("point_id", "up", "up2"))
        if not moved.where("up <> up2").head(1):
            return points.join(moved.select("point_id", F.col("up").alias("root_id")), "point_id")
        s = moved.select("point_id", F.col("up2").alias("up"))
    raise RuntimeError("paths are too deep")


def bootstrap_masks(points: DataFrame, n: int, seed: int = 1) -> DataFrame:
    """(boot_id from 1, root_id): each bootstrap holds the roots it would draw at least once, about 63 %."""
    roots = points.where("parent_id is null").select("root_id").distinct()
    u = F.pmod(F.xxhash64(F.lit(seed), F.col("boot_id"), F.col("root_id")), F.lit(1 << 30)) / float(1 << 30)
    return roots.select(F.explode(F.sequence(F.lit(1), F.lit(n))).alias("boot_id"), "root_id").where(u < 1 - math.exp(-1))


def result_table(points: DataFrame, boot: DataFrame) -> DataFrame:
    """One row: n, logz, logzerr and its parts, ess, h and its spread, max_logl. ``boot``: (boot_id, root_id), without the whole run."""
    w = weighted(points)
    main = summary(w)
    z = bootstrap_totals(points, boot).where("h is not null")
    one = main.select(F.col("logz").alias("z0"), F.col("h").alias("h0"))
    n = F.count(F.lit(1)) + 1  # spreads of h include the whole run
    mean = (F.sum("h") + F.max("h0")) / n
    spread = z.join(F.broadcast(one)).agg(
        F.avg("logz").alias("logz_bs"), F.stddev_pop("logz").alias("logz_bs_std"), F.max(F.col("logz") - F.col("z0")).alias("logzerr_bs"),
        F.sqrt(F.greatest((F.sum(F.col("h") * F.col("h")) + F.pow(F.max("h0"), F.lit(2.0))) / n - mean * mean, F.lit(0.0))).alias("herr"),
    )
    e = F.exp(F.col("logwt") - F.col("peak"))
    tail = with_peak(w).agg(F.log1p(F.sum(F.when(F.col("nchild") == 0, e).otherwise(0.0)) / F.sum(e)).alias("logzerr_tail"), F.max("logl").alias("max_logl"))
    out = main.join(F.broadcast(spread)).join(F.broadcast(tail))
    return out.select("n", "logz", F.sqrt(F.pow("logzerr_bs", F.lit(2.0)) + F.pow("logzerr_tail", F.lit(2.0))).alias("logzerr"), "logz_bs", "logz_bs_std", "logzerr_bs", "logzerr_single", "logzerr_tail", "ess", "h", "herr", "max_logl")


def goals(points: DataFrame, boot: DataFrame, min_ess: int, dkl: float, dlogz: float, share: float = 1 / 400) -> DataFrame:
    """Three rows (goal, value, met, lo, hi, width): effective samples, Kullback-Leibler spread of bootstraps, error of logz.

    An unmet ess asks for the range of ``min_ess`` systematic draws, an unmet kl for
    that in which the divergence of an offending bootstrap grows, without its outer
    ``share``; an unmet logz for the least width with which the error would be met.
    """
    w = weighted(points)
    main = summary(w)
    one = main.first()
    p = with_peak(w).select("point_id", "logl", F.exp(F.col("logwt") - F.lit(float(one["logz"]))).alias("p"))
    drawn = resample_counts(p, "p", list(ORDER), F.lit(float(max(1, min_ess)))).where("copies > 0").agg(F.min("logl").alias("lo"), F.max("logl").alias("hi"))
    ess = main.join(F.broadcast(drawn)).select(F.lit("ess").alias("goal"), F.col("ess").alias("value"), (F.col("ess") >= min_ess).alias("met"), "lo", "hi", F.lit(0).cast("long").alias("width"))

    b = bootstrap_evidence(points, boot)
    kl = bootstrap_kl(w, b)
    mean = kl.agg(F.avg("kl").alias("mean"))
    off = kl.join(F.broadcast(mean)).withColumn("apart", F.abs(F.col("kl") - F.col("mean")))
    bad = off.where(F.col("apart") > dkl).select("boot_id")
    zb = bootstrap_logz(b).select("boot_id", F.col("logz").alias("zb"))
    j = b.select("boot_id", "point_id", "logl", "logwt").join(F.broadcast(bad), "boot_id").join(F.broadcast(zb), "boot_id").join(w.select("point_id", F.col("logwt").alias("w0")), "point_id")
    lb = F.col("logwt") - F.col("zb")
    j = j.withColumn("g", F.greatest(F.exp(lb) * (lb - (F.col("w0") - F.lit(float(one["logz"])))), F.lit(0.0)))
    total = j.groupBy("boot_id").agg(F.sum("g").alias("total"))
    j = running_sum(range_partitioned(j.join(F.broadcast(total), "boot_id"), *ORDER), F.col("g"), "c", *ORDER, by=("boot_id",)).withColumn("c", F.round(F.col("c") / F.col("total"), 9))
    span = j.agg(F.min(F.when(F.col("c") >= share, F.col("logl"))).alias("lo"), F.max(F.when(F.col("c") <= 1 - share, F.col("logl"))).alias("hi"))
    worst = off.agg(F.max("apart").alias("value"))
    kls = worst.join(F.broadcast(span)).select(F.lit("kl").alias("goal"), "value", (F.col("value") <= dkl).alias("met"), "lo", "hi", F.lit(0).cast("long").alias("width"))

    z = bootstrap_logz(b).agg(F.max(F.abs(F.col("logz") - F.lit(float(one["logz"])))).alias("apart"), F.max(F.col("logz") - F.lit(float(one["logz"]))).alias("bs"))
    value = F.greatest(F.lit(float(one["logzerr_single"])), F.col("apart"), F.col("bs"))
    enough = least_width(w, dlogz)
    most = math.ceil(math.sqrt(one["n"]) / dlogz)
    nothing = F.lit(None).cast("double")
    logz = z.join(F.broadcast(enough)).select(F.lit("logz").alias("goal"), value.alias("value"), (value <= dlogz).alias("met"), nothing.alias("lo"), nothing.alias("hi"), F.coalesce("width", F.lit(most).cast("long")).alias("width"))
    out = ess.unionByName(kls).unionByName(logz)
    return out.select("goal", "value", "met", *[F.when(~F.col("met"), F.col(c)).alias(c) for c in ("lo", "hi")], F.when(F.col("met"), F.lit(0).cast("long")).otherwise(F.col("width")).alias("width"))


def expandable(nodes: DataFrame, lo: float, hi: float, width: int, healthy: bool = True, max_iters: int | None = None, max_ncalls: int | None = None, ncall: int = 0, min_children: str | None = None) -> DataFrame:
    """``nodes`` (from weighted() or live_points()) with a flag ``expand``: whether a row of a run should get a child.

    It should if it lies at or below ``hi``, the limits on iterations and calls are
    not reached, no other row has its likelihood (a plateau only shrinks), it has fewer
    children than asked for (one, or the column ``min_children``), and the run is no
    wider there than ``width``. Nothing is expanded where live points are degenerate.
    """
    ties = nodes.groupBy("logl").agg(F.count(F.lit(1)).alias("__ties"))
    j = nodes.join(ties, "logl")
    first = F.col("rk") == 1
    ok = F.lit(healthy and lo <= hi) & (F.col("logl") <= hi) & (F.col("__ties") == 1)
    if max_iters is not None:
        ok &= first | (F.col("rk") <= max_iters)
    if max_ncalls is not None and ncall >= max_ncalls:
        ok &= first
    wanted = F.coalesce(F.col(min_children), F.lit(1)) if min_children else F.lit(1)
    return j.withColumn("expand", ok & (F.col("nchild") < wanted) & (first | (F.col("nlive") <= width))).drop("__ties")


def cluster_width(members: DataFrame, cluster: str, per_cluster: int) -> DataFrame:
    """(width,): live points wanted, so many for each cluster with more than one member."""
    sizes = members.groupBy(cluster).agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    return sizes.agg((F.count(F.lit(1)) * per_cluster).alias("width"))


def plateau_roots(roots: DataFrame) -> DataFrame:
    """(to_add,): roots to add so that as many lie above the lowest plateau as there were: its size less one."""
    low = roots.agg(F.min("logl").alias("low"))
    return roots.join(F.broadcast(low)).agg((F.count_if(F.col("logl") == F.col("low")) - 1).alias("to_add"))


def widen(points: DataFrame, value: float, wanted: int, seed: int = 1) -> DataFrame:
    """(point_id, target): rows below ``value`` with a child at or above it that should get more children, and how many in all.

    Parents are drawn without replacement with the reciprocal of their fork weight
    (exponential keys, the least ``wanted`` of them), and each gets the same number of
    new children. No rows: the roots are to be widened instead.
    """
    parents = parents_before(points, value)
    u = (F.pmod(F.xxhash64(F.lit(seed), F.col("point_id")), F.lit(1 << 52)).cast("double") + 0.5) / float(1 << 52)
    drawn = parents.withColumn("key", -F.log(u) * F.exp("log_weight")).orderBy("key", "point_id").limit(wanted)
    n = drawn.agg(F.count(F.lit(1)).alias("n"))
    children = points.groupBy(F.col("parent_id").alias("point_id")).agg(F.count(F.lit(1)).alias("nchild"))
    return drawn.join(F.broadcast(n)).join(children, "point_id").select("point_id", (F.col("nchild") + F.ceil(F.lit(float(wanted)) / F.col("n"))).alias("target"))


def degenerate_pairs(samples: DataFrame, cols: list[str], hot: int = 1000) -> DataFrame:
    """(a, b, rho, p_value, report): Spearman correlation of each pair of parameters of equally weighted samples.

    Reported are pairs with p < 0.01 and |rho| > 0.75. Ranks (means of ties) come from
    counts by value, all parameters in one sort; the p-value is that of a normal deviate
    atanh(rho) sqrt((n - 3) / 1.06).
    """
    key = samples.withColumn("__row", F.monotonically_increasing_id())
    key = materialise(key.select("__row", *cols))
    s = F.stack(F.lit(len(cols)), *[x for c in cols for x in (F.lit(c), F.col(c).cast("double"))])
    counts = key.select(s.alias("param", "x")).groupBy("param", "x").agg(F.count(F.lit(1)).alias("k"))
    ranks = running_sum(range_partitioned(counts, "param", "x"), F.col("k"), "before", "param", "x", exclusive=True, by=("param",)).select("param", "x", "k", (F.col("before") + (F.col("k") + 1) / 2.0).alias("r"))
    ranks = materialise(ranks)
    # a value that many rows share would be one task of a join: the ranks of such values, at most ``hot`` a parameter, are told to all
    least = F.greatest(F.lit(1000), F.col("n") / hot)
    ranks = ranks.join(F.broadcast(key.agg(F.count(F.lit(1)).alias("n")))).withColumn("many", F.col("k") >= least)
    told = F.broadcast(ranks.where("many").select("param", "x", F.col("r").alias("told")))
    long = key.select("__row", s.alias("param", "x")).join(told, ["param", "x"], "left")
    few = long.where("told is null").join(ranks.where("not many").select("param", "x", "r"), ["param", "x"]).select("__row", "param", "r")
    long = long.where("told is not null").select("__row", "param", F.col("told").alias("r")).unionByName(few)
    wide = long.groupBy("__row").agg(*[F.max(F.when(F.col("param") == c, F.col("r"))).alias(c) for c in cols])
    pairs = [(a, b) for i, a in enumerate(cols) for b in cols[i + 1 :]]
    out = wide.agg(F.count(F.lit(1)).alias("n"), *[F.corr(f"`{a}`", f"`{b}`").alias(f"c{k}") for k, (a, b) in enumerate(pairs)])
    out = out.select("n", F.explode(F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), F.col(f"c{k}").alias("rho")) for k, (a, b) in enumerate(pairs)])).alias("x")).select("n", "x.*")
    deviate = F.abs(F.atanh(F.least(F.abs("rho"), F.lit(1 - 1e-15)))) * F.sqrt((F.col("n") - 3) / 1.06)
    out = out.withColumn("p_value", _two_sided(deviate))
    return out.select("a", "b", "rho", "p_value", ((F.col("p_value") < 0.01) & (F.abs("rho") > 0.75)).alias("report"))


def _two_sided(z: Column) -> Column:
    """P(|N| > z), by the rational approximation of the error function (absolute error below 1.5e-7)."""
    x = z / math.sqrt(2)
    t = 1.0 / (1.0 + 0.3275911 * x)
    return ((((1.061405429 * t - 1.453152027) * t + 1.421413741) * t - 0.284496736) * t + 0.254829592) * t * F.exp(-x * x)
