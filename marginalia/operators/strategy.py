"""What decides where a run goes on: ranges, fork weights, replays, transforms for warm starts."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .ordered import materialise, range_partitioned, running_sum


def cumulative_range(df: DataFrame, p: str, order: list[str], dp: float) -> DataFrame:
    """(first, last): 1-based ranks of the first row with running sum >= dp and of the last with running sum <= 1 - dp."""
    r = running_sum(range_partitioned(df, *order), F.lit(1).cast("long"), "rk", *order)
    r = running_sum(r, F.col(p), "c", *order).withColumn("c", F.round("c", 9))
    return r.agg(F.min(F.when(F.col("c") >= dp, F.col("rk"))).alias("first"), F.max(F.when(F.col("c") <= 1 - dp, F.col("rk"))).alias("last"))


def drop_light_head(df: DataFrame, p: str, order: list[str], least: float = 1e-4) -> DataFrame:
    """Without the leading rows whose running weight is at most ``least``."""
    return running_sum(range_partitioned(df, *order), F.col(p), "__c", *order).where(F.round("__c", 12) > least).drop("__c", "__part")


def is_affine(df: DataFrame, a: str, b: str, key: str, tolerance: float = 1e-9) -> DataFrame:
    """Whether b is an affine function of a, by the slopes of rows 2k and 2k + 1 (key: 0, 1, 2, ...)."""
    even = df.where(F.col(key) % 2 == 0).select((F.col(key) / 2).cast("long").alias("k"), F.col(a).alias("a0"), F.col(b).alias("b0"))
    odd = df.where(F.col(key) % 2 == 1).select(((F.col(key) - 1) / 2).cast("long").alias("k"), F.col(a).alias("a1"), F.col(b).alias("b1"))
    s = even.join(odd, "k").where("a0 <> a1").withColumn("slope", (F.col("b1") - F.col("b0")) / (F.col("a1") - F.col("a0")))
    s = s.withColumn("offset", F.col("b0") - F.col("slope") * F.col("a0"))
    spread = lambda c: F.max(c) - F.min(c)
    return s.agg(((spread("slope") <= tolerance * F.greatest(F.lit(1.0), F.max(F.abs("slope")))) & (spread("offset") <= tolerance * F.greatest(F.lit(1.0), F.max(F.abs("offset"))))).alias("affine"))


def live_number_from_weights(w: DataFrame) -> DataFrame:
    """(point_id, rk, nlive) back from successive log weights: 1 / ln((1 - sqrt(1 - 4r)) / (2r)) with r = 1 - exp(logw' - logw); 1 where that is no number above 1."""
    from .ordered import lagged

    j = lagged(w.select("point_id", "rk", "logw"), 1, "rk", before="logw").where("before is not null")
    r = F.lit(1.0) - F.exp(F.col("logw") - F.col("before"))
    inner = F.lit(1.0) - 4.0 * r
    ratio = F.when((inner >= 0) & (r > 0), (F.lit(1.0) - F.sqrt(inner)) / (2.0 * r))
    n = F.when(ratio > 1, F.lit(1.0) / F.log(ratio))
    return j.select("point_id", "rk", F.when(n > 1, n).otherwise(F.lit(1.0)).alias("nlive"))


def fork_weights(points: DataFrame, most_rounds: int = 40) -> DataFrame:
    """(point_id, log_weight): ln of the product of child counts on the path to the root, by pointer doubling.

    The path of a run is as deep as its iterations over its width; doubling needs the logarithm of that in joins."""
    children = points.where("parent_id is not null").groupBy(F.col("parent_id").alias("point_id")).agg(F.log(F.count(F.lit(1)).cast("double")).alias("own"))
    p = points.select("point_id", "parent_id").join(children, "point_id", "left").select("point_id", F.col("parent_id").alias("up"), F.coalesce("own", F.lit(0.0)).alias("own"))
    parent_own = p.select(F.col("point_id").alias("up"), F.col("own").alias("w"))
    s = materialise(p.join(parent_own, "up", "left").select("point_id", "up", F.coalesce("w", F.lit(0.0)).alias("w")))
    for _ in range(most_rounds):
        if not s.where("up is not null").head(1):
            return s.select("point_id", F.col("w").alias("log_weight"))
        hop = s.select(F.col("point_id").alias("up"), F.col("up").alias("up2"), F.col("w").alias("w2"))
        s = materialise(s.join(hop, "up", "left").select("point_id", F.col("up2").alias("up"), (F.col("w") + F.coalesce("w2", F.lit(0.0))).alias("w")))
    raise RuntimeError("paths are too deep")


def parents_before(points: DataFrame, value: float) -> DataFrame:
    """(point_id, log_weight) of rows below ``value`` with a child at or above it, with their fork weights."""
    child = points.where(F.col("logl") >= value).select(F.col("parent_id").alias("point_id")).distinct()
    return points.where(F.col("logl") < value).select("point_id").join(child, "point_id", "left_semi").join(fork_weights(points), "point_id")


def advice_range(live: DataFrame, logz: float, logz_remain: float, logvol: float, frac_remain: float = 0.01, epsilon: float = 1e-3) -> DataFrame:
    """(lo, hi): the likelihoods still to integrate, or nulls when done."""
    n = F.count(F.lit(1)).cast("double")
    s = live.agg(F.min("logl").alias("lo"), F.max("logl").alias("top"), F.percentile("logl", 0.5).alias("mid"), n.alias("n"))
    second = live.orderBy("logl").limit(2).agg(F.max("logl").alias("second"))  # two rows
    s = s.join(F.broadcast(second))
    nxt = F.lit(logz_remain - (logvol + math.log(frac_remain))) - F.log("n")
    hi = F.greatest(F.least(nxt, F.col("mid")), F.col("second"))
    fraction = 1 / (1 + math.exp(logz - logz_remain))
    open_ = F.lit(logz_remain > logz or fraction > frac_remain) & (F.col("top") - F.col("lo") >= epsilon)
    return s.select(F.when(open_, F.col("lo")).alias("lo"), F.when(open_, hi).alias("hi"))


def width_for_error(w: DataFrame, dlogz: float, floors: list[int]) -> DataFrame:
    """(floor, error): the error of logz if every row had at least so many live points, sqrt(sum 1 / max(nlive, floor)^2)."""
    f = w.sparkSession.createDataFrame([(int(x),) for x in floors], "floor long")
    g = w.groupBy("nlive").agg(F.count(F.lit(1)).alias("k"))
    e = g.join(F.broadcast(f)).groupBy("floor").agg(F.sqrt(F.sum(F.col("k") / F.pow(F.greatest("nlive", "floor").cast("double"), F.lit(2.0)))).alias("error"))
    return e.withColumn("enough", F.col("error") < dlogz)


def replay_blocks(points: DataFrame, new_logl: Column, block: int, max_tau: float) -> DataFrame:
    """(block, distance, good): Kendall distance of old and new order in consecutive blocks; good until the first beyond ``max_tau``."""
    from .ordertest import kendall_distance

    r = running_sum(range_partitioned(points.withColumn("__new", new_logl), "logl", "point_id"), F.lit(1).cast("long"), "rk", "logl", "point_id")
    d = kendall_distance(r.withColumn("block", F.floor((F.col("rk") - 1) / block)), "rk", "__new", "block")
    first = d.where(F.col("distance") > max_tau).agg(F.min("block").alias("first"))
    return d.join(F.broadcast(first)).select("block", "distance", (F.col("first").isNull() | (F.col("block") < F.col("first"))).alias("good"))


def match_clusters(new: DataFrame, old: DataFrame, radius: float, dims: list[str]) -> DataFrame:
    """(id, cluster): for each new point the old cluster it is near to; 0 if there is none, or more than one."""
    from .region import extremes_near

    hit = extremes_near(old, new.select(F.col("id").alias("b_id"), *dims), radius, dims, "cluster").withColumnRenamed("b_id", "id")
    return hit.select("id", F.when(F.col("lo") == F.col("hi"), F.col("lo")).otherwise(F.lit(0).cast("long")).alias("cluster"))


def student_t_start(u: list[Column], center: list[float], rotation: list[list[float]]) -> tuple[list[Column], Column]:
    """Coordinates drawn around ``center`` with Student-t tails (one degree of freedom) and their log weight."""
    from ..functions import t_logpdf

    t = [F.tan(F.lit(math.pi) * (x - 0.5)) for x in u]
    x = [F.lit(float(c)) + sum((F.lit(float(rotation[i][j])) * t[j] for j in range(len(t))), F.lit(0.0)) for i, c in enumerate(center)]
    at_zero = -math.log(math.pi)
    weight = sum((-t_logpdf(v, 1) for v in t), F.lit(0.0)) + F.lit(len(t) * at_zero)
    return x, weight


def independent_start(u: list[Column], centre: list[float], err: list[float], df: float = 1.0) -> tuple[list[Column], Column]:
    """Coordinates in the unit cube drawn around ``centre`` by a Student-t of its own for each axis, cut off at the cube, and their log weight.

    The weight is 0 at the centre and undoes the drawing: adding it to the likelihood gives back the posterior of uniform coordinates.
    """
    from ..functions import t_logpdf
    from ..functions.student import t_truncated

    if df < 1:
        raise ValueError("there must be at least one degree of freedom")
    drawn = [t_truncated(x, df, (0.0 - c) / e, (1.0 - c) / e) for x, c, e in zip(u, centre, err)]
    x = [F.least(F.greatest(F.lit(float(c)) + F.lit(float(e)) * t, F.lit(0.0)), F.lit(1.0)) for t, c, e in zip(drawn, centre, err)]
    weight = sum((t_logpdf(F.lit(0.0), df) - t_logpdf(t, df) for t in drawn), F.lit(0.0))
    return x, weight


def least_width(w: DataFrame, dlogz: float) -> DataFrame:
    """(width,): the least number of live points that occurs (above rows with a child) with which, as a floor for all rows, the error falls below ``dlogz``; null if none does.

    With a floor f the squared error is the number of narrower rows over f^2 plus the sum of 1 / nlive^2 over the
    others: two running sums over the distinct widths, however many there are.
    """
    g = w.groupBy(F.col("nlive").cast("long").alias("nlive")).agg(F.count(F.lit(1)).alias("k"), F.count_if(F.col("nchild") > 0).alias("inner"))
    r = running_sum(range_partitioned(g, "nlive"), F.col("k"), "upto", "nlive")
    r = running_sum(r, F.col("k") / F.pow(F.col("nlive").cast("double"), F.lit(2.0)), "part", "nlive")
    whole = g.agg(F.sum(F.col("k") / F.pow(F.col("nlive").cast("double"), F.lit(2.0))).alias("whole"))
    error = F.sqrt(F.col("upto") / F.pow(F.col("nlive").cast("double"), F.lit(2.0)) + F.greatest(F.col("whole") - F.col("part"), F.lit(0.0)))
    return r.join(F.broadcast(whole)).where((F.col("inner") > 0) & (error < dlogz)).agg(F.min("nlive").alias("width"))


def smoothed(df: DataFrame, index: str, value: str, width: int = 20, by: list[str] | None = None) -> DataFrame:
    """Means of every ``width`` rows."""
    b = F.floor(F.col(index) / width).alias("block")
    return df.groupBy(*(by or []), b).agg(F.avg(value).alias("mean"), F.count(F.lit(1)).alias("n"))


def run_of_node(points: DataFrame, point_id: int) -> DataFrame:
    """The rows live at a row: born before it, dying with or after it."""
    row = points.where(F.col("point_id") == point_id).select(F.col("logl").alias("__at"))
    return points.join(F.broadcast(row)).where((F.coalesce("birth", F.lit(float("-inf"))) < F.col("__at")) & (F.col("logl") >= F.col("__at"))).drop("__at")
