"""Posterior summaries of weighted samples."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .ordered import PART, range_partitioned, ranked, running_sum

BINS = 39
#: The information gain divides by the number of bin edges, not of bins (kept for comparability).
EDGES = 40


def moments(w: DataFrame, cols: list[str], weight: str = "weight") -> DataFrame:
    """(param, mean, stdev): weighted mean and population standard deviation, in one pass."""
    s = F.stack(F.lit(len(cols)), *[x for c in cols for x in (F.lit(c), F.col(c).cast("double"))])
    long = w.select(F.col(weight).alias("__w"), s.alias("param", "x"))
    wsum = F.sum("__w")
    mean = F.sum(F.col("__w") * F.col("x")) / wsum
    sq = F.sum(F.col("__w") * F.col("x") * F.col("x")) / wsum
    return long.groupBy("param").agg(mean.alias("mean"), F.sqrt(F.greatest(sq - mean * mean, F.lit(0.0))).alias("stdev"))


def equal_weight_summary(samples: DataFrame, cols: list[str]) -> DataFrame:
    """(param, mean, stdev, median, errlo, errup) of equally weighted samples."""
    s = F.stack(F.lit(len(cols)), *[x for c in cols for x in (F.lit(c), F.col(c).cast("double"))])
    q = F.percentile("x", F.array(F.lit(0.158655), F.lit(0.5), F.lit(0.841345)))
    out = samples.select(s.alias("param", "x")).groupBy("param").agg(F.avg("x").alias("mean"), F.stddev_pop("x").alias("stdev"), q.alias("q"))
    return out.select("param", "mean", "stdev", F.col("q")[1].alias("median"), F.col("q")[0].alias("errlo"), F.col("q")[2].alias("errup"))


def weighted_quantiles(df: DataFrame, x: str, weight: str, tie: str, qs: list[float]) -> DataFrame:
    """(q, value). Cumulative weights before each row, scaled so that the last is 1, interpolated linearly."""
    p = ranked(df.select(F.col(x).cast("double").alias("x"), F.col(weight).alias("w"), F.col(tie).alias("t")), "x", "t")
    p = running_sum(p, F.col("w"), "c", "x", "t", exclusive=True)
    total = p.agg(F.max("c").alias("total"))
    p = p.join(F.broadcast(total)).select("rk", "x", (F.col("c") / F.col("total")).alias("c"))
    nxt = p.select((F.col("rk") - 1).alias("rk"), F.col("x").alias("x1"), F.col("c").alias("c1"))
    q = df.sparkSession.createDataFrame([(float(v),) for v in qs], "q double")
    seg = p.join(nxt, "rk").where("c1 > c").join(F.broadcast(q), (F.col("c") <= F.col("q")) & ((F.col("q") < F.col("c1")) | ((F.col("q") == 1) & (F.col("c1") == 1))))
    return seg.select("q", (F.col("x") + (F.col("x1") - F.col("x")) * (F.col("q") - F.col("c")) / (F.col("c1") - F.col("c"))).alias("value"))


def resample_counts(df: DataFrame, weight: str, order: list[str], n: Column, offset: float = 0.5) -> DataFrame:
    """Systematic resampling: how often each row is picked by n equally spaced positions. Weights sum to 1.
    ``copies`` follow from the running weights alone, so no row is searched for."""
    p = running_sum(range_partitioned(df, *order), F.col(weight), "__c", *order)
    r = F.lit(float(offset))
    upto = lambda c: F.ceil(F.round(n * c - r, 9))
    return p.withColumn("copies", (upto(F.col("__c")) - upto(F.col("__c") - F.col(weight))).cast("long")).drop("__c", PART)


def resample_equal(df: DataFrame, weight: str, order: list[str], n: Column, offset: float = 0.5) -> DataFrame:
    return resample_counts(df, weight, order, n, offset).where("copies > 0").withColumn("__k", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int")))).drop("__k", "copies")


def information_gain(df: DataFrame, cols: list[str], weight: str) -> DataFrame:
    """(param, bits) from a weighted histogram of unit-cube coordinates over BINS bins."""
    s = F.stack(F.lit(len(cols)), *[x for c in cols for x in (F.lit(c), F.col(c).cast("double"))])
    long = df.select(F.col(weight).alias("w"), s.alias("param", "u"))
    bin_ = F.least(F.greatest(F.floor(F.col("u") * BINS), F.lit(0)), F.lit(BINS - 1)).cast("int")
    h = long.groupBy("param", bin_.alias("bin")).agg(F.sum("w").alias("w"))
    total = h.groupBy("param").agg(F.sum("w").alias("total"))
    bins = total.select("param", "total", F.explode(F.sequence(F.lit(0), F.lit(BINS - 1))).alias("bin"))
    full = bins.join(h, ["param", "bin"], "left")
    density = F.coalesce("w", F.lit(0.0)) / F.col("total") * BINS
    return full.groupBy("param").agg((F.sum(F.log2(F.lit(1.0) / ((density + 0.001) * EDGES))) / EDGES).alias("bits"))


def max_likelihood(df: DataFrame, *cols: str) -> DataFrame:
    """The row of greatest logl; of ties the smallest point_id."""
    best = df.agg(F.max_by(F.struct("logl", "point_id", *cols), F.struct(F.col("logl"), -F.col("point_id"))).alias("m"))
    return best.select("m.*")


def histogram(df: DataFrame, x: Column, weight: Column, bins: int) -> DataFrame:
    """(bin, mass) of a unit-interval value; empty bins included."""
    b = F.least(F.greatest(F.floor(x * bins), F.lit(0)), F.lit(bins - 1)).cast("int")
    h = df.select(b.alias("bin"), weight.alias("w")).groupBy("bin").agg(F.sum("w").alias("w"))
    return df.sparkSession.range(bins).select(F.col("id").cast("int").alias("bin")).join(F.broadcast(h), "bin", "left").select("bin", F.coalesce("w", F.lit(0.0)).alias("mass"))


def highest_density(h: DataFrame, level: float) -> DataFrame:
    """(lo_bin, hi_bin, mass) around the fullest bins of a histogram (bins are few) until ``level`` is reached."""
    from pyspark.sql import Window

    order = Window.orderBy(F.desc("mass"), "bin")
    run = h.withColumn("before", F.coalesce(F.sum("mass").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0)))
    total = h.agg(F.sum("mass").alias("total"))
    kept = run.join(F.broadcast(total)).where(F.round(F.col("before") / F.col("total"), 9) < level)
    return kept.agg(F.min("bin").alias("lo_bin"), F.max("bin").alias("hi_bin"), (F.sum("mass") / F.max("total")).alias("mass"))
