"""Densities on a grid, highest density intervals, and quantiles of prediction bands.

Rows are counted into the bins of a fixed grid by one aggregate; the smoothing then
works on the grid, a few hundred numbers for each parameter, whatever the rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .ordered import materialise, range_partitioned, running_sum

#: The narrowest interval with a quarter of a normal distribution is so many standard deviations wide.
QUARTER_WIDTH = 0.6372787
#: Fixed values of the bandwidth rule, of the order that suits a bias-corrected density: factor and power of the effective number of rows.
BANDWIDTH, POWER = 1.2, -1 / 9
#: Tail of the kernel, in bandwidths.
REACH = 4.0


def mass_grid(df: DataFrame, cols: list[str], weight: str | None = None, bins: int = 1024, ranges: dict[str, tuple[float | None, float | None]] | None = None) -> DataFrame:
    """(param, bin, x, dx, mass, n_eff, hard_lo, hard_hi): weights of each bin, empty bins included, of a grid over the data widened by a tenth,
    or to the ends that ``ranges`` gives a parameter (rows beyond them are not counted). mass sums to 1."""
    s = F.stack(F.lit(len(cols)), *[x for c in cols for x in (F.lit(c), F.col(c).cast("double"))])
    long = df.select((F.col(weight).cast("double") if weight else F.lit(1.0)).alias("w"), s.alias("param", "v")).where("w > 0 and v is not null")
    given = df.sparkSession.createDataFrame([(c, *map(lambda e: None if e is None else float(e), (ranges or {}).get(c, (None, None)))) for c in cols], "param string, a double, b double")
    long = long.join(F.broadcast(given), "param").where("(a is null or v >= a) and (b is null or v <= b)")
    ends = long.groupBy("param", "a", "b").agg(F.min("v").alias("least"), F.max("v").alias("most"), (F.pow(F.sum("w"), 2) / F.sum(F.col("w") * F.col("w"))).alias("n_eff"))
    wide = F.when(F.col("most") > F.col("least"), F.col("most") - F.col("least")).otherwise(F.greatest(F.abs("most"), F.lit(1.0)) * 1e-3) / 10
    ends = ends.select("param", "n_eff", F.col("a").isNotNull().alias("hard_lo"), F.col("b").isNotNull().alias("hard_hi"), F.coalesce("a", F.col("least") - wide).alias("lo"), F.coalesce("b", F.col("most") + wide).alias("hi"))
    ends = materialise(ends.withColumn("dx", (F.col("hi") - F.col("lo")) / bins))  # one row a parameter
    at = F.least(F.greatest(F.floor((F.col("v") - F.col("lo")) / F.col("dx")), F.lit(0)), F.lit(bins - 1)).cast("int")
    counts = long.join(F.broadcast(ends), "param").groupBy("param", at.alias("bin")).agg(F.sum("w").alias("w"))
    full = ends.withColumn("bin", F.explode(F.sequence(F.lit(0), F.lit(bins - 1)))).join(counts, ["param", "bin"], "left")
    share = F.coalesce("w", F.lit(0.0)) / F.sum("w").over(Window.partitionBy("param"))  # the bins of a parameter
    return full.select("param", "bin", (F.col("lo") + (F.col("bin") + 0.5) * F.col("dx")).alias("x"), "dx", share.alias("mass"), "n_eff", "hard_lo", "hard_hi")


def bandwidths(grid: DataFrame, factor: float = BANDWIDTH) -> DataFrame:
    """(param, h): by the narrowest run of bins with a quarter of the mass, so that a second mode far away does not widen the kernel."""
    order = Window.partitionBy("param").orderBy("bin")
    upto = F.sum("mass").over(order.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    c = grid.select("param", "bin", "dx", "n_eff", "mass", upto.alias("c"))
    held = c.groupBy("param", "dx", "n_eff").agg(F.sort_array(F.collect_list(F.struct("bin", "c", "mass"))).alias("g"))  # the bins of a parameter
    first = lambda s: F.size(F.filter("g", lambda e: F.round(e["c"] - s["c"] + s["mass"], 12) < 0.25)) - s["bin"] + 1
    enough = F.filter("g", lambda s: F.round(F.lit(1.0) - s["c"] + s["mass"], 12) >= 0.25)
    width = F.array_min(F.transform(enough, first))
    return held.select("param", F.greatest(width * F.col("dx") / QUARTER_WIDTH * factor * F.pow("n_eff", F.lit(POWER)), F.col("dx")).alias("h"))


def _smoothed(grid: DataFrame, value: Column) -> DataFrame:
    """``grid`` (with h) and t: ``value`` convolved with the kernel, corrected to first order where a hard end cuts the kernel.

    A bin meets those within the kernel's reach only: an equi-join on blocks of that width."""
    block = F.ceil(F.lit(REACH) * F.col("h") / F.col("dx")).cast("int")
    a = grid.withColumn("v", value).withColumn("block", F.floor(F.col("bin") / block))
    b = a.select("param", F.explode(F.array(F.col("block") - 1, F.col("block"), F.col("block") + 1)).alias("block"), F.col("bin").alias("bin2"), F.col("v").alias("v2"))
    j = a.join(b, ["param", "block"]).withColumn("u", (F.col("bin2") - F.col("bin")) * F.col("dx") / F.col("h")).where(F.abs("u") <= REACH)
    k = F.exp(-F.col("u") * F.col("u") / 2)
    moments = j.groupBy("param", "bin").agg(*[F.sum(k * f).alias(n) for n, f in (("s0", F.lit(1.0)), ("s1", F.col("u")), ("s2", F.col("u") * F.col("u")), ("t0", F.col("v2")), ("t1", F.col("u") * F.col("v2")))])
    whole = F.sqrt(F.lit(2 * 3.141592653589793)) * F.col("h") / F.col("dx")
    near = (F.col("hard_lo") & (F.col("bin") < block)) | (F.col("hard_hi") & (F.col("last") - F.col("bin") < block))
    det = F.col("s0") * F.col("s2") - F.col("s1") * F.col("s1")
    linear = (F.col("s2") * F.col("t0") - F.col("s1") * F.col("t1")) / det
    # where the corrected line would dip below zero only the cut kernel's mass is made up for
    t = F.when(near & (det > 0) & (linear > 0), linear).when(near, F.col("t0") / F.col("s0")).otherwise(F.col("t0") / whole)
    last = grid.groupBy("param").agg(F.max("bin").alias("last"))
    return grid.join(moments, ["param", "bin"]).join(F.broadcast(last), "param").withColumn("t", t).drop("s0", "s1", "s2", "t0", "t1", "last")


def density_grid(grid: DataFrame, h: DataFrame | None = None) -> DataFrame:
    """(param, bin, x, dx, p) from mass_grid(): the density's share of each bin, a Gaussian kernel's with one multiplicative correction of its bias."""
    g = grid.join(h if h is not None else bandwidths(grid), "param")
    pilot = _smoothed(g, F.col("mass")).withColumnRenamed("t", "pilot")
    ratio = F.when(F.col("pilot") > 1e-12, F.col("mass") / F.col("pilot")).otherwise(F.lit(0.0))
    both = _smoothed(materialise(pilot), ratio)
    raw = F.col("pilot") * F.col("t")
    return both.select("param", "bin", "x", "dx", (raw / F.sum(raw).over(Window.partitionBy("param"))).alias("p"))


def highest_density_intervals(density: DataFrame, level: float = 0.68) -> DataFrame:
    """(param, mode, errlo, errup, lo, hi, mass) from density_grid(): bins by falling density widen one interval around the mode until its own mass is ``level``."""
    falling = Window.partitionBy("param").orderBy(F.desc("p"), "bin").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    upto = Window.partitionBy("param").orderBy("bin").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    g = density.withColumn("c", F.sum("p").over(upto)).withColumn("r", F.count(F.lit(1)).over(falling))
    ends = g.withColumn("l", F.min(F.struct("bin", "x", (F.col("c") - F.col("p")).alias("c"))).over(falling)).withColumn("m", F.max(F.struct("bin", "x", "c")).over(falling))
    enough = ends.where(F.round(F.col("m.c") - F.col("l.c"), 12) >= level).groupBy("param").agg(F.min_by(F.struct("l", "m"), "r").alias("e"))
    mode = g.where("r = 1").select("param", F.col("x").alias("mode"))
    out = enough.join(mode, "param").select("param", "mode", F.col("e.l.x").alias("lo"), F.col("e.m.x").alias("hi"), (F.col("e.m.c") - F.col("e.l.c")).alias("mass"))
    return out.select("param", "mode", (F.col("mode") - F.col("lo")).alias("errlo"), (F.col("hi") - F.col("mode")).alias("errup"), "lo", "hi", "mass")


def hdi(df: DataFrame, cols: list[str], weight: str | None = None, level: float = 0.68, bins: int = 1024, ranges: dict | None = None) -> DataFrame:
    """Highest density intervals of weighted rows, see highest_density_intervals()."""
    return highest_density_intervals(materialise(density_grid(materialise(mass_grid(df, cols, weight, bins, ranges)))), level)


def plotting_quantiles(df: DataFrame, by: str, y: str, qs: list[float], alpha: float = 0.4, beta: float = 0.4) -> DataFrame:
    """(by, q, value): quantiles of ``y`` at each ``by`` by plotting positions: row k of n stands for (k - alpha) / (n + 1 - alpha - beta).

    One range sort for all values of ``by``, which are the places of a prediction, not rows.
    """
    if any(not 0 <= q <= 1 for q in qs):
        raise ValueError("quantiles lie between 0 and 1")
    rows = df.select(F.col(by).alias("__by"), F.col(y).cast("double").alias("__y"), F.monotonically_increasing_id().alias("__tie"))
    p = materialise(running_sum(range_partitioned(rows, "__by", "__y", "__tie"), F.lit(1).cast("long"), "k", "__by", "__y", "__tie", by=("__by",)))
    n = p.groupBy("__by").agg(F.count(F.lit(1)).alias("n"))
    q = F.col("q")
    place = F.col("n") * q + F.lit(alpha) + q * (1 - alpha - beta)
    k = F.floor(F.greatest(F.least(place, F.col("n") - 1), F.lit(1.0)))
    asked = n.withColumn("q", F.explode(F.array(*map(lambda v: F.lit(float(v)), qs)))).withColumn("k", k).withColumn("g", F.greatest(F.least(place - F.col("k"), F.lit(1.0)), F.lit(0.0)))
    two = asked.withColumn("k2", F.explode(F.array("k", F.least(F.col("k") + 1, F.col("n")))))
    found = two.distinct().join(p.select("__by", F.col("k").alias("k2"), "__y"), ["__by", "k2"])
    value = F.min("__y") * (F.lit(1.0) - F.max("g")) + F.max("__y") * F.max("g")
    return found.groupBy("__by", "q").agg(value.alias("value")).select(F.col("__by").alias(by), "q", "value")
