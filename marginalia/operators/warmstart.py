"""Warm starts: quantile boxes, importance reuse, stored points, width plans."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import logsumexp
from .chained import pop_sequence
from .ordered import range_partitioned, running_sum


def quantile_boxes(w: DataFrame, dims: list[str], weight: str, tie: str, levels: list[float]) -> DataFrame:
    """(level, param, lo, hi): the range of points whose running weight along the axis lies in [q, 1 - q]."""
    out = None
    q = w.sparkSession.createDataFrame([(float(x),) for x in levels], "level double")
    total = w.agg(F.sum(weight).alias("total"))
    for d in dims:
        p = range_partitioned(w.select(F.col(d).alias("u"), F.col(tie).alias("t"), F.col(weight).alias("w")), "u", "t")
        p = running_sum(p, F.col("w"), "c", "u", "t").join(F.broadcast(total)).withColumn("c", F.round(F.col("c") / F.col("total"), 9))
        own = p.join(F.broadcast(q), (F.col("c") >= F.col("level")) & (F.col("c") <= 1 - F.col("level")))
        one = own.groupBy("level").agg(F.min("u").alias("lo"), F.max("u").alias("hi")).select("level", F.lit(d).alias("param"), "lo", "hi")
        out = one if out is None else out.unionByName(one)
    return out


def through_boxes(grid: DataFrame, boxes: DataFrame, s: str = "s", u: str = "u") -> DataFrame:
    """A coordinate u squeezed into the box that the extra coordinate s chooses between levels (linear in s), with its log weight.

    boxes: one row for each step and parameter (step from 0, param, lo, hi); their number is that of the levels."""
    last = boxes.agg(F.max("step").alias("last"))
    g = grid.join(F.broadcast(last)).withColumn("x", F.col(s) * F.col("last")).withColumn("step", F.least(F.floor("x"), F.col("last") - 1).cast("int"))
    nxt = boxes.select((F.col("step") - 1).alias("step"), "param", F.col("lo").alias("lo1"), F.col("hi").alias("hi1"))
    j = g.join(F.broadcast(boxes.join(nxt, ["step", "param"])), "step")
    f = F.col("x") - F.col("step")
    lo, hi = F.col("lo") + (F.col("lo1") - F.col("lo")) * f, F.col("hi") + (F.col("hi1") - F.col("hi")) * f
    return j.select(*grid.columns, "param", (lo + (hi - lo) * F.col(u)).alias("v"), F.log(hi - lo).alias("logweight"))


def reuse(w: DataFrame, new_logl: Column) -> DataFrame:
    """(logz, ess, n): evidence and effective samples of weighted points under another likelihood."""
    v = w.withColumn("__lw", F.col("logw") + new_logl)
    top = v.agg(F.max("__lw").alias("peak"))
    v = v.join(F.broadcast(top))
    e = F.exp(F.col("__lw") - F.col("peak"))
    return v.agg(F.count(F.lit(1)).alias("n"), logsumexp("__lw", F.col("peak")).alias("logz"), (F.pow(F.sum(e), 2) / F.sum(e * e)).alias("ess"))


def usable_points(stored: DataFrame, thresholds: DataFrame) -> DataFrame:
    """(threshold, seq): for each threshold, on its own, the first stored row born at or below it that lies above it. For a run that uses up rows see pop_sequence."""
    asked = thresholds.select("threshold").distinct().select(F.monotonically_increasing_id().alias("k"), "threshold")
    return pop_sequence(stored, asked, consume=False).where("seq is not null").select("threshold", "seq")


def width_steps(intervals: DataFrame) -> DataFrame:
    """(edge, width): a step function of the widths asked for in (lo, hi, width), rising to its maximum and then falling."""
    from pyspark.sql import Window

    edges = intervals.select(F.col("lo").alias("edge")).union(intervals.select("hi")).distinct()
    own = edges.join(intervals, (F.col("lo") <= F.col("edge")) & (F.col("edge") < F.col("hi")), "left").groupBy("edge").agg(F.coalesce(F.max("width"), F.lit(0).cast("long")).alias("w"))
    up = Window.orderBy("edge")  # one row for each edge of a plan, a handful
    down = Window.orderBy(F.desc("edge"))
    m = own.withColumn("a", F.max("w").over(up)).withColumn("b", F.max("w").over(down))
    return m.select("edge", F.least("a", "b").alias("width"))
