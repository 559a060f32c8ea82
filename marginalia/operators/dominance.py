"""Counting pairs out of order, and Kendall distances, without pairing rows.

Rows lie in ranges of one rank. Before a row in its range come rows of the same task;
of the ranges before only a histogram over buckets of the other rank is needed. What
shares a bucket is counted once more bucket by bucket. So two shuffles and one merge
count in each task give what a self-join would, for groups of any size.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .chained import sorted_ranges
from .ordered import PART, materialise, range_partitioned, running_sum

#: Buckets of the other rank; with the ranges' number it bounds what the histograms hold.
BUCKETS = 1024


def earlier_greater(values: np.ndarray) -> np.ndarray:
    """For each value how many before it are greater: merge counts of blocks of doubling width, all blocks at once."""
    n = len(values)
    v = np.unique(values, return_inverse=True)[1].astype(np.int64)
    out, at = np.zeros(n, np.int64), np.arange(n)
    width, big = 1, n + 1
    while width < n:
        pair, right = at // (2 * width), (at // width) % 2 == 1
        key = pair * big + v
        left = np.sort(key[~right])
        ends = np.searchsorted(left, (pair[right] + 1) * big)
        out[right] += ends - np.searchsorted(left, key[right], side="right")
        width *= 2
    return out


def _counted(column: str, given: dict[int, np.ndarray] | None, key: str):
    """Rows sorted by ``key`` and then in order: each row's number of earlier ones with a greater ``column`` under the same key, plus what ``given`` has for it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []

        def answer() -> pa.RecordBatch:
            t = pa.Table.from_batches(held)
            v = t.column(column).to_numpy()
            k = earlier_greater(v)
            if given is not None:
                k = k + given[t.column(key)[0].as_py()][v]
            return pa.RecordBatch.from_arrays([t.column("__row").combine_chunks(), pa.array(k)], names=["__row", "k"])

        for b in batches:
            keys = b.column(key).to_numpy()
            cuts = [0, *(np.flatnonzero(keys[1:] != keys[:-1]) + 1).tolist(), len(b)]
            for x, y in zip(cuts, cuts[1:]):
                if x == y:
                    continue
                if held and held[0].column(key)[0].as_py() != keys[x]:
                    yield answer()
                    held.clear()
                held.append(b.slice(x, y - x))
        if held:
            yield answer()

    return run


def discordant(df: DataFrame, a: str, b: str, group: str | None = None, buckets: int = BUCKETS) -> DataFrame:
    """``df`` (a, b and the group) with discordant: how many rows of its group have a smaller ``a`` and a greater ``b``. Ties in either count as in order."""
    g = F.col(group) if group else F.lit(0)
    rows = df.select(g.alias("g"), F.col(a).alias("a"), F.col(b).alias("b"))
    # groups one after another in both orders: then rows of two groups are never out of order
    r = running_sum(range_partitioned(rows.groupBy("g", "b").agg(F.count(F.lit(1)).alias("n")), "g", "b"), F.col("n"), "__rb", "g", "b", exclusive=True)
    ranked = materialise(rows.withColumn("__row", F.monotonically_increasing_id()))
    n = ranked.count()
    if not n:
        return rows.withColumn("discordant", F.lit(0).cast("long")).withColumnsRenamed({"g": group or "g", "a": a, "b": b})
    ranked = ranked.join(r.select("g", "b", F.col("__rb").alias("rb")), (ranked["g"].eqNullSafe(r["g"])) & (ranked["b"].eqNullSafe(r["b"]))).select(ranked["g"], ranked["a"], ranked["b"], "__row", "rb")
    ranked = ranked.withColumn("bucket", F.floor(F.col("rb") * F.lit(min(buckets, n)) / F.lit(n)).cast("long"))
    ranges = sorted_ranges(ranked, "g", "a", "rb", "__row")
    cells = ranges.groupBy(PART, "bucket").agg(F.count(F.lit(1)).alias("n")).collect()  # at most one row for each range and bucket
    given, so_far = {}, np.zeros(min(buckets, n) + 1, np.int64)
    for p in sorted({c[0] for c in cells}):
        given[p] = so_far.sum() - np.cumsum(so_far)  # how many of the ranges before lie in greater buckets
        for _, bucket, k in (c for c in cells if c[0] == p):
            so_far[bucket] += k
    across = ranges.select(PART, "bucket", "__row").mapInArrow(_counted("bucket", given, PART), "__row long, k long")
    within = ranges.repartition("bucket").sortWithinPartitions("bucket", "g", "a", "rb", "__row").select("bucket", "rb", "__row").mapInArrow(_counted("rb", None, "bucket"), "__row long, k long")
    k = across.unionByName(within).groupBy("__row").agg(F.sum("k").alias("discordant"))
    return ranges.select("__row", "g", "a", "b").join(k, "__row").drop("__row").withColumnsRenamed({"g": group or "g", "a": a, "b": b})


def kendall_distance(df: DataFrame, a: str, b: str, group: str | None = None) -> DataFrame:
    """(group,) n, distance: discordant pairs of two rankings over all N (N - 1) / 2. Groups of one row are left out."""
    d = discordant(df, a, b, group)
    key = group or "g"
    out = d.groupBy(key).agg(F.count(F.lit(1)).alias("n"), F.sum("discordant").alias("d")).where("n > 1")
    out = out.select(key, "n", (F.col("d") * 2.0 / (F.col("n") * (F.col("n") - 1))).alias("distance"))
    return out if group else out.drop(key)
