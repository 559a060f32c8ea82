"""Reuse of a run's points under another likelihood, in batches until the rest cannot matter."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .ordered import materialise, ranked


def reuse_in_batches(points: DataFrame, new_logl: Column, key: str, batch: int = 128, threshold: float = -10.0, first_wave: int = 8) -> tuple[DataFrame, DataFrame]:
    """(rows, one row of results) of weighted points (``key``, logl, logw, ...) under the likelihood ``new_logl``.

    Points are taken by falling logl + logw in batches. When no point of a batch weighs
    more than exp(``threshold``) / n of the heaviest so far, the batches after it are left
    out: their new weights count as zero. Batches are evaluated in waves, each twice as
    many as the one before, so a run of any size takes a logarithm of jobs, and at
    most twice the rows that are needed are evaluated.

    Rows: ``points`` with logl_new, logw_new and weight (null logl_new: not evaluated or left out). Results:
    n, evaluated, used, logz, logzerr (scatter of the weights), ess, key of the best row.
    """
    order = F.coalesce(F.col("logl") + F.col("logw"), F.lit(-math.inf))
    r = ranked(points.withColumn("__key", -order), "__key", key, name="__at").drop("__part")
    r = materialise(r.withColumn("__batch", F.floor((F.col("__at") - 1) / batch)).drop("__key"))
    n = r.count()
    if not n:
        raise ValueError("there are no points to reuse")
    done, start, wave, evaluated, stop, peak = [], 0, first_wave, 0, None, -math.inf
    least = threshold - math.log(n)
    while stop is None and start * batch < n:
        own = r.where((F.col("__batch") >= start) & (F.col("__batch") < start + wave))
        value = new_logl.cast("double")
        own = materialise(own.withColumn("logl_new", F.when(value.isNull() | F.isnan(value), F.lit(-math.inf)).otherwise(value)).withColumn("logw_new", F.col("logw") + F.col("logl_new")))
        done.append(own)
        tops = own.groupBy("__batch").agg(F.max("logw_new").alias("top"), F.count(F.lit(1)).alias("k"))
        so_far = F.greatest(F.max("top").over(Window.orderBy("__batch").rowsBetween(Window.unboundedPreceding, Window.currentRow)), F.lit(peak))  # one row a batch of the wave
        told = tops.withColumn("peak", so_far).agg(F.min(F.when(F.col("top") < F.col("peak") + least, F.col("__batch"))).alias("stop"), F.max("peak").alias("peak"), F.sum("k").alias("k")).first()
        evaluated, stop, peak = evaluated + told["k"], told["stop"], told["peak"]
        start, wave = start + wave, wave * 2
    out = done[0]
    for d in done[1:]:
        out = out.unionByName(d)
    if stop is not None:
        out = out.where(F.col("__batch") <= stop)
    # the peak of what is kept: later batches of the last wave do not count
    e = F.exp(F.col("logw_new") - F.col("peak"))
    top = out.agg(F.max("logw_new").alias("peak"))
    sums = out.join(F.broadcast(top)).agg(F.count(F.lit(1)).alias("used"), F.sum(e).alias("s1"), F.sum(e * e).alias("s2"), F.max("peak").alias("peak"), F.max_by(key, F.struct("logl_new", -F.col("__at"))).alias(key))
    s2 = F.col("s2") / (F.col("s1") * F.col("s1"))
    scatter = F.sqrt(F.greatest(s2 - F.lit(1.0 / n), F.lit(0.0)) / F.lit(max(1, n - 1)))
    result = sums.select(F.lit(n).cast("long").alias("n"), F.lit(evaluated).cast("long").alias("evaluated"), "used", (F.col("peak") + F.log("s1")).alias("logz"), F.log1p(scatter).alias("logzerr"), (F.lit(1.0) / s2).alias("ess"), key)
    weights = out.join(F.broadcast(sums.select("peak", "s1"))).withColumn("weight", e / F.col("s1")).select(key, "logl_new", "logw_new", "weight")
    rows = points.join(weights, key, "left").withColumn("weight", F.coalesce("weight", F.lit(0.0)))
    return rows, result
