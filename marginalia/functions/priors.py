"""Priors that need a table or a matrix: empirical ones, by quantiles of samples, and correlated Gaussians."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.ordered import materialise, range_partitioned, running_sum
from .student import normal_ppf

#: Buckets of the unit interval by which draws meet the steps of a table.
BUCKETS = 1 << 14


def quantile_table(samples: DataFrame, x: str, weight: str | None = None) -> DataFrame:
    """(lo, hi, x0, x1): the steps of the inverse distribution function of ``samples``: from the share lo to hi it rises linearly from x0 to x1.

    A sample's place is the weight before it over that before the last, so n equally weighted ones stand at k / (n - 1).
    Samples without weight are left out; a single one is a step of its own.
    """
    w = F.col(weight).cast("double") if weight else F.lit(1.0)
    rows = samples.select(F.col(x).cast("double").alias("x"), w.alias("w")).where("x is not null and w > 0").withColumn("t", F.monotonically_increasing_id())
    order = ("x", "w", "t")  # rows that tie in x and weight are alike
    p = running_sum(range_partitioned(rows, *order), F.lit(1).cast("long"), "rk", *order)
    p = materialise(running_sum(p, F.col("w"), "c", *order, exclusive=True))
    total = p.agg(F.max("c").alias("total"))
    p = p.join(F.broadcast(total)).select("rk", "x", F.when(F.col("total") > 0, F.col("c") / F.col("total")).otherwise(F.lit(0.0)).alias("c"))
    nxt = p.select((F.col("rk") - 1).alias("rk"), F.col("x").alias("x1"), F.col("c").alias("hi"))
    last = p.where("c = 1 or rk = 1").agg(F.max_by(F.struct("x", "c"), "rk").alias("e"))
    steps = p.join(nxt, "rk").select(F.col("c").alias("lo"), "hi", F.col("x").alias("x0"), "x1").where("hi > lo")
    return steps.unionByName(last.where("e is not null").select(F.col("e.c").alias("lo"), F.lit(math.inf).alias("hi"), F.col("e.x").alias("x0"), F.col("e.x").alias("x1")))


def empirical_prior(draws: DataFrame, u: str, table: DataFrame, name: str, buckets: int = BUCKETS) -> DataFrame:
    """``draws`` with ``name``: the quantile of its unit-interval column ``u`` by quantile_table().

    A range join on buckets of the interval: a step is met in each bucket it reaches into, which are at most
    one more than the steps and buckets together, and a draw looks in its own bucket only.
    """
    at = lambda c: F.least(F.greatest(F.floor(F.least(c, F.lit(1.0)) * buckets), F.lit(0)), F.lit(buckets - 1)).cast("int")
    # a step that ends where a bucket begins has nothing there
    end = F.when(F.col("hi") > 1, F.lit(buckets - 1)).otherwise(F.greatest(at(F.col("lo")), F.ceil(F.least(F.col("hi"), F.lit(1.0)) * buckets).cast("int") - 1))
    steps = table.select("*", F.explode(F.sequence(at(F.col("lo")), end)).alias("__bucket"))
    rows = draws.withColumn("__u", F.least(F.greatest(F.col(u).cast("double"), F.lit(0.0)), F.lit(1.0))).withColumn("__bucket", at(F.col("__u")))
    j = rows.join(steps.withColumnsRenamed({c: f"__{c}" for c in ("lo", "hi", "x0", "x1")}), "__bucket").where((F.col("__u") >= F.col("__lo")) & (F.col("__u") < F.col("__hi")))
    share = F.when(F.col("__hi") <= 1, (F.col("__u") - F.col("__lo")) / (F.col("__hi") - F.col("__lo"))).otherwise(F.lit(0.0))
    return j.withColumn(name, F.col("__x0") + (F.col("__x1") - F.col("__x0")) * share).drop("__u", "__bucket", "__lo", "__hi", "__x0", "__x1")


def triangular_factor(covariance: list[list[float]]) -> list[list[float]]:
    """The lower triangle L with L L' = ``covariance``, a small matrix."""
    n = len(covariance)
    out = [[0.0] * n for _ in range(n)]
    for i in range(n):
        for j in range(i + 1):
            rest = covariance[i][j] - sum(out[i][k] * out[j][k] for k in range(j))
            if i == j:
                if rest <= 0:
                    raise ValueError("the covariance is not positive definite")
                out[i][i] = math.sqrt(rest)
            else:
                out[i][j] = rest / out[j][j]
    return out


def correlated_gaussian(us: list[Column], mean: list[float], covariance: list[list[float]]) -> list[Column]:
    """Parameters with a Gaussian prior: normal quantiles of the coordinates through the covariance's triangle."""
    z, low = [normal_ppf(u) for u in us], triangular_factor(covariance)
    return [F.lit(float(m)) + sum((F.lit(low[i][k]) * z[k] for k in range(i + 1)), F.lit(0.0)) for i, m in enumerate(mean)]
