"""Insertion ranks, their test, and rank correlations."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .dominance import kendall_distance  # noqa: F401  part of this module's tests
from .ordered import range_partitioned, ranked, running_sum


def insertion_ranks(w: DataFrame) -> DataFrame:
    """(point_id, rk, insert_rank, nlive): how many live points were below the child of each row when it was drawn.

    The live points at row i below its child c are the rows between them in
    order that were born before i: those with parent rank below i. That is a
    range count, done here on ranks: each row's child meets the rows whose rank
    lies between, so the work is nlive for each row, not all pairs."""
    p = w.select("point_id", "rk", "parent_id", "nlive")
    parent = p.select(F.col("point_id").alias("parent_id"), F.col("rk").alias("prk"))
    born = p.join(parent, "parent_id", "left").select("point_id", "rk", "nlive", F.coalesce("prk", F.lit(0).cast("long")).alias("prk"), "parent_id")
    child = born.where("parent_id is not null").groupBy(F.col("prk").alias("i")).agg(F.min("rk").alias("c"))
    width = 256
    a = child.withColumn("cell", F.explode(F.sequence(F.floor(F.col("i") / width), F.floor(F.col("c") / width))))
    b = born.select((F.floor(F.col("rk") / width)).alias("cell"), F.col("rk").alias("r"), F.col("prk").alias("bp"))
    hit = a.join(b, "cell").where((F.col("r") > F.col("i")) & (F.col("r") < F.col("c")) & (F.col("bp") < F.col("i")))
    counts = hit.groupBy("i").agg(F.count(F.lit(1)).alias("k"))
    out = p.select("point_id", F.col("rk").alias("i"), "nlive").join(child, "i").join(counts, "i", "left")
    return out.select("point_id", F.col("i").alias("rk"), F.coalesce("k", F.lit(0).cast("long")).alias("insert_rank"), "nlive")


def rank_sequence(w: DataFrame) -> DataFrame:
    """(point_id, rk, insert_order) from live_points(): twice the rank, from above, of a row's first child among the live points
    over their number; null where the row has no child, or two live points have the same likelihood."""
    p = w.select("point_id", "logl", "parent_id", "rk", "nlive")
    parent = p.select(F.col("point_id").alias("parent_id"), F.col("rk").alias("born"))
    t = p.join(parent, "parent_id", "left").withColumn("born", F.coalesce("born", F.lit(0).cast("long")))
    later = Window.partitionBy("logl").orderBy(F.desc("rk")).rowsBetween(Window.unboundedPreceding, -1)  # rows that tie
    spans = t.withColumn("other", F.min("born").over(later)).where("other is not null").select((F.greatest("born", "other") + 1).alias("a"), F.col("rk").alias("z")).where("a <= z")
    ends = spans.select(F.col("a").alias("rk"), F.lit(1).cast("long").alias("d")).unionByName(spans.select((F.col("z") + 1).alias("rk"), F.lit(-1).cast("long").alias("d")))
    marked = p.select("point_id", "rk").join(ends.groupBy("rk").agg(F.sum("d").alias("d")), "rk", "left").withColumn("d", F.coalesce("d", F.lit(0).cast("long")))
    tied = running_sum(range_partitioned(marked, "rk"), F.col("d"), "ties", "rk").select("point_id", "rk", "ties")
    out = tied.join(insertion_ranks(w).select("point_id", "insert_rank", "nlive"), "point_id", "left")
    return out.select("point_id", "rk", F.when(F.col("ties") == 0, 2.0 * (F.col("nlive") - F.col("insert_rank")) / F.col("nlive")).alias("insert_order"))


def rank_zscore(df: DataFrame, rank: Column, n: Column, *order: str) -> DataFrame:
    """Running z-score of ranks that should be uniform on 0..n: (U - k/2) / sqrt(k/12), U the sum of (rank + 1/2) / n."""
    p = ranked(df, *order, name="k")
    p = running_sum(p, (rank + 0.5) / n, "u", *order)
    return p.withColumn("z", (F.col("u") - F.col("k") / 2.0) / F.sqrt(F.col("k") / 12.0))


def zscore_total(df: DataFrame, rank: Column, n: Column) -> DataFrame:
    k = F.count(F.lit(1))
    return df.agg(k.alias("k"), ((F.sum((rank + 0.5) / n) - k / 2.0) / F.sqrt(k / 12.0)).alias("z"))


def run_lengths(ranks: list[float], n: list[float], threshold: float) -> tuple[list[int], float | None, bool]:
    """Lengths of runs until the z-score passed the threshold, shortest run, and whether the test is passed.
    An ordered fold over one run; for streams see marginalia.streaming."""
    lengths, u, k = [], 0.0, 0
    for r, m in zip(ranks, n):
        if not 0 <= r <= m:
            raise ValueError("ranks must lie between 0 and n")
        u, k = u + (r + 0.5) / m, k + 1
        if abs((u - k / 2) / math.sqrt(k / 12)) > threshold:
            lengths.append(k)
            u, k = 0.0, 0
    allowed = max(1, math.ceil(len(ranks) / 10**5.5))
    return lengths, (min(lengths) if lengths else None), len(lengths) <= allowed


def spearman(df: DataFrame, pairs: list[tuple[str, str]], key: str) -> DataFrame:
    """(a, b, rho) from average ranks of each pair of columns."""
    out = None
    for a, b in pairs:
        r = df.select(key, F.col(a).alias("a"), F.col(b).alias("b"))
        for c in ("a", "b"):
            counts = r.groupBy(c).agg(F.count(F.lit(1)).alias("n"))
            cum = running_sum(ranked(counts, c), F.col("n"), "upto", c).select(c, (F.col("upto") - (F.col("n") - 1) / 2.0).alias(f"r{c}"))
            r = r.join(cum, c)
        one = r.agg(F.corr("ra", "rb").alias("rho")).select(F.lit(a).alias("a"), F.lit(b).alias("b"), "rho")
        out = one if out is None else out.unionByName(one)
    return out


def preceding_rank(df: DataFrame, x: str, order: list[str], window: int, group: str | None = None) -> DataFrame:
    """rank: how many of the ``window`` rows before have a smaller value; n: how many rows there are before."""
    w = (Window.partitionBy(group) if group else Window.partitionBy(F.lit(0))).orderBy(*order).rowsBetween(-window, -1)
    before = F.collect_list(x).over(w)
    d = df.withColumn("__before", before)
    return d.withColumn("rank", F.size(F.filter("__before", lambda v: v < F.col(x))).cast("long")).withColumn("n", F.size("__before").cast("long")).drop("__before")
