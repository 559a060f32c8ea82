"""Regions around live points: neighbours, radii, clusters, layers, ellipsoids.

Distance joins go through a grid: points meet those of their own and the
adjoining cells of the grid dimensions, and the distance decides. Only the live
points of one region are ever compared, a few thousand by design.
"""

from __future__ import annotations

import itertools
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Points of each side that one task compares.
SPLIT_B, SPLIT_A = 20_000, 200_000
#: Vectors of each side that one task compares.
BLOCK = 10_000
#: A grid cell is wider than the radius by this share, so that points at just the radius are in adjoining cells however their quotients round.
WIDER = 1 + 1e-9


def square(radius: float) -> float:
    """The double nearest to the square of the radius as it is written: 0.05 gives 0.0025, the product of doubles a little more."""
    return float(Decimal(repr(float(radius))) ** 2)


def _sq(a: list[Column], b: list[Column]) -> Column:
    return sum(((x - y) * (x - y) for x, y in zip(a, b)), F.lit(0.0))


def near_pairs(a: DataFrame, b: DataFrame, radius: float, dims: list[str], a_id: str = "a_id", b_id: str = "b_id", grid_dims: int = 2) -> DataFrame:
    """(a_id, b_id, sq) of all pairs within ``radius`` (inclusive). Equi-join on grid cells of the first ``grid_dims`` dimensions."""
    use = dims[:grid_dims]
    cell = [F.floor(F.col(c) / (radius * WIDER)).cast("long") for c in use]
    x = a.select(F.col(a_id), *[F.col(c).alias(f"{c}_a") for c in dims], *[k.alias(f"k{i}") for i, k in enumerate(cell)])
    moves = F.array(*[F.struct(*[F.lit(m).cast("long").alias(f"m{i}") for i, m in enumerate(ms)]) for ms in itertools.product((-1, 0, 1), repeat=len(use))])
    y = b.select(F.col(b_id), *[F.col(c).alias(f"{c}_b") for c in dims], *[k.alias(f"c{i}") for i, k in enumerate(cell)], F.explode(moves).alias("m"))
    y = y.select("*", *[(F.col(f"c{i}") + F.col(f"m.m{i}")).alias(f"k{i}") for i in range(len(use))])
    j = x.join(y, [f"k{i}" for i in range(len(use))])
    sq = _sq([F.col(f"{c}_a") for c in dims], [F.col(f"{c}_b") for c in dims])
    return j.withColumn("sq", sq).where(F.col("sq") <= square(radius)).select(a_id, b_id, "sq", *[f"{c}_a" for c in dims])


def count_neighbours(a: DataFrame, b: DataFrame, radius: float, dims: list[str]) -> DataFrame:
    """(b_id, n): points of a within the radius of each b, 0 included."""
    n = near_pairs(a, b, radius, dims).groupBy("b_id").agg(F.count(F.lit(1)).alias("n"))
    return b.select("b_id").join(n, "b_id", "left").select("b_id", F.coalesce("n", F.lit(0).cast("long")).alias("n"))


def _first_within(b: np.ndarray, a: np.ndarray, sq: float) -> np.ndarray:
    """For each row of ``b`` the first row of ``a`` whose squared distance is at most ``sq``, or -1. Rows that have one leave early."""
    out, open_ = np.full(len(b), -1), np.arange(len(b))
    at, step = 0, 32
    while at < len(a) and len(open_):
        part = a[at : at + step]
        found = np.full(len(open_), -1)
        for k in range(0, len(open_), 1000):
            d = sum((part[None, :, c] - b[open_[k : k + 1000], None, c]) ** 2 for c in range(b.shape[1]))
            hit = d <= sq
            found[k : k + 1000] = np.where(hit.any(axis=1), hit.argmax(axis=1), -1)
        out[open_[found >= 0]] = at + found[found >= 0]
        open_ = open_[found < 0]
        at, step = at + step, min(2 * step, 4000)
    return out


def extremes_near(a: DataFrame, b: DataFrame, radius: float, dims: list[str], value: str, ends: tuple[str, ...] = ("lo", "hi"), grid_dims: int = 2, split_a: int | None = None, split_b: int | None = None) -> DataFrame:
    """(b_id, lo, hi): the least and greatest long ``value`` of a within the radius of each b, null if there is none.

    Points of a in one place go as one row, and a task tries those of a block of the grid and
    its neighbours in order of their values, so that most points are done after a few; pairs are never made.
    """
    keys = [f"__k{i}" for i in range(min(grid_dims, len(dims)))]
    cell = [F.floor(F.col(c) / (radius * WIDER)).cast("long").alias(k) for k, c in zip(keys, dims)]
    doubles = [F.col(c).cast("double").alias(c) for c in dims]
    none = " or ".join(f"{c} is null or isnan({c})" for c in dims)
    x = a.select(*doubles, F.col(value).cast("long").alias("lo")).where(f"lo is not null and not ({none})").groupBy(*dims).agg(F.min("lo").alias("lo"), F.max("lo").alias("hi")).select("*", *cell)
    y = b.select("b_id", *doubles).where(f"not ({none})").select("*", *cell)
    moves = F.array(*[F.struct(*[F.lit(m).cast("long").alias(k) for k, m in zip(keys, ms)]) for ms in itertools.product((-1, 0, 1), repeat=len(keys))])
    x = x.withColumn("__m", F.explode(moves)).withColumns({k: F.col(k) + F.col(f"__m.{k}") for k in keys}).drop("__m")
    pieces = lambda n, most: F.ceil(F.col(n) / most)
    sizes = y.groupBy(*keys).agg(F.count(F.lit(1)).alias("__nb")).join(x.groupBy(*keys).agg(F.count(F.lit(1)).alias("__na")), keys)
    sizes = sizes.select(*keys, pieces("__na", split_a or SPLIT_A).alias("__pa"), pieces("__nb", split_b or SPLIT_B).alias("__pb"))
    each = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.col(n) - 1))
    x = x.join(sizes, keys).select(*keys, *dims, "lo", "hi", F.pmod(F.xxhash64(*dims), "__pa").alias("__pa"), each("__pb").alias("__pb"))
    y = y.join(sizes, keys).withColumn("__row", F.pmod(F.xxhash64("b_id", *dims), "__pb")).select(*keys, "b_id", *dims, F.col("__row").alias("__pb"), each("__pa").alias("__pa"))
    task, sq = [*keys, "__pa", "__pb"], square(radius)

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        if not len(left) or not len(right):
            return pa.table({"b_id": pa.array([], left.schema.field("b_id").type), "lo": pa.array([], pa.int64()), "hi": pa.array([], pa.int64())})
        p, q = (np.column_stack([t.column(c).to_numpy() for c in dims]) for t in (left, right))
        out = {}
        for end, sign in (("lo", 1), ("hi", -1)):
            if end not in ends:
                out[end] = pa.nulls(len(p), pa.int64())
                continue
            v = right.column(end).to_numpy()
            order = np.argsort(v if sign > 0 else -v, kind="stable")
            first = _first_within(p, q[order], sq)
            out[end] = pa.array(v[order][first], mask=first < 0)
        return pa.table({"b_id": left.column("b_id"), **out})

    kind = b.schema["b_id"].dataType.simpleString()
    found = y.groupBy(*task).cogroup(x.groupBy(*task)).applyInArrow(run, f"b_id {kind}, lo long, hi long")
    found = found.where("lo is not null or hi is not null").groupBy("b_id").agg(F.min("lo").alias("lo"), F.max("hi").alias("hi"))
    return b.select("b_id").join(found, "b_id", "left")


def first_neighbour(a: DataFrame, b: DataFrame, radius: float, dims: list[str]) -> DataFrame:
    """(b_id, a_id): the smallest a_id within the radius, or -1."""
    return extremes_near(a, b, radius, dims, "a_id", ("lo",)).select("b_id", F.coalesce("lo", F.lit(-1).cast("long")).alias("a_id"))


def local_centres(points: DataFrame, radius: float, dims: list[str]) -> DataFrame:
    """Each point minus the mean of all within its radius, itself included."""
    a, b = points.withColumnRenamed("id", "a_id"), points.withColumnRenamed("id", "b_id")
    m = near_pairs(a, b, radius, dims).groupBy("b_id").agg(*[F.avg(f"{c}_a").alias(f"m_{c}") for c in dims])
    return b.join(m, "b_id").select(F.col("b_id").alias("id"), *[(F.col(c) - F.col(f"m_{c}")).alias(c) for c in dims])


def max_radius_sq(points: DataFrame, boot: DataFrame, dims: list[str]) -> DataFrame:
    """(boot_id, maxsq): the largest distance of a held-out point to its nearest kept one.

    boot: (boot_id, id) of kept points. The live points of one region are broadcast: a few thousand rows by design."""
    ids = boot.select("boot_id").distinct()
    kept = boot.join(points, "id").select("boot_id", *[F.col(c).alias(f"{c}_a") for c in dims])
    out = points.join(F.broadcast(ids)).join(boot.withColumn("kept", F.lit(1)), ["boot_id", "id"], "left").where("kept is null")
    j = out.join(kept, "boot_id").withColumn("sq", _sq([F.col(c) for c in dims], [F.col(f"{c}_a") for c in dims]))
    near = j.groupBy("boot_id", "id").agg(F.min("sq").alias("sq"))
    return near.groupBy("boot_id").agg(F.max("sq").alias("maxsq"))


def _distances(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Distances of all rows of x and y by their products; those that are small beside the vectors from differences."""
    nx, ny = (x * x).sum(1), (y * y).sum(1)
    scale = nx[:, None] + ny[None, :]
    sq = scale - 2 * (x @ y.T)
    i, j = np.nonzero(sq < 1e-6 * scale)
    for k in range(0, len(i), 20_000):
        p, q = i[k : k + 20_000], j[k : k + 20_000]
        sq[p, q] = ((x[p] - y[q]) ** 2).sum(1)
    return np.sqrt(sq)


def _block_sum(t: pa.Table) -> tuple[int, float]:
    """Number and sum of the distances of pairs with different ids between the two blocks of a task, or within its only one."""
    lists = t.column("v").combine_chunks()
    x = lists.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(t), -1)
    ids = np.unique(t.column("id").to_numpy(zero_copy_only=False), return_inverse=True)[1]
    own = t.column("__own").to_numpy()
    one, other = np.flatnonzero(own == t.column("__one")[0].as_py()), np.flatnonzero(own == t.column("__two")[0].as_py())
    inside = t.column("__one")[0].as_py() == t.column("__two")[0].as_py()
    repeated = len(ids) and ids.max() + 1 < len(ids)
    n, total = 0, 0.0
    for k in range(0, len(one), 500):
        p, q = one[k : k + 500], other[k:] if inside else other
        if not len(q):
            continue
        d = _distances(x[p], x[q])
        if inside or repeated:
            apart = ids[p][:, None] != ids[q][None, :]
            if inside:
                apart &= np.arange(len(p))[:, None] < np.arange(len(q))[None, :]
            n, total = n + int(apart.sum()), total + float(d[apart].sum())
        else:
            n, total = n + d.size, total + float(d.sum())
    return n, total


def mean_pair_distance(points: DataFrame, cluster: str, vec: str, block: int | None = None) -> DataFrame:
    """(cluster, pairs, mean_distance) over unordered pairs of different ids within each cluster.

    All pairs are computed, in tasks of two blocks of a cluster that answer with one sum: work grows with
    the square of a cluster, memory with the block. Vectors with nulls count as pairs without a distance.
    """
    x = points.select("id", F.col(cluster).alias("c"), F.col(vec).alias("v")).where("id is not null and c is not null")
    pairs = x.groupBy("c", "id").agg(F.count(F.lit(1)).alias("m")).groupBy("c").agg(((F.sum("m") * F.sum("m") - F.sum(F.col("m") * F.col("m"))) / 2).cast("long").alias("pairs"))
    good = x.where(F.col("v").isNotNull() & ~F.exists("v", lambda e: e.isNull())).withColumn("__size", F.size("v"))
    sizes = good.groupBy("c", "__size").agg(F.ceil(F.count(F.lit(1)) / (block or BLOCK)).alias("__blocks"))
    good = good.join(sizes, ["c", "__size"]).withColumn("__own", F.pmod(F.xxhash64("id"), "__blocks"))
    good = good.withColumn("__with", F.explode(F.sequence(F.lit(0).cast("long"), F.col("__blocks") - 1)))
    good = good.select("id", "c", "v", "__size", "__own", F.least("__own", "__with").alias("__one"), F.greatest("__own", "__with").alias("__two"))
    task = ["c", "__size", "__one", "__two"]

    def run(key: tuple, t: pa.Table) -> pa.Table:
        n, total = _block_sum(t)
        return pa.table({"c": t.column("c").slice(0, 1), "n": pa.array([n], pa.int64()), "total": pa.array([total], pa.float64())})

    kind = x.schema["c"].dataType.simpleString()
    sums = good.groupBy(*task).applyInArrow(run, f"c {kind}, n long, total double").groupBy("c").agg((F.sum("total") / F.nullif(F.sum("n"), F.lit(0))).alias("mean_distance"))
    return pairs.where("pairs > 0").join(sums, "c", "left").select(F.col("c").alias(cluster), "pairs", "mean_distance")


def clusters(points: DataFrame, radius: float, dims: list[str]) -> DataFrame:
    """(id, cluster): single linkage at ``radius``; a cluster is named by its smallest member."""
    from .clustering import members

    return members(points, radius, dims).withColumnRenamed("first", "cluster")


def scaling_layer(points: DataFrame, dims: list[str]) -> DataFrame:
    """(param, mean, std) for whitening axis by axis."""
    s = F.stack(F.lit(len(dims)), *[x for c in dims for x in (F.lit(c), F.col(c).cast("double"))])
    return points.select(s.alias("param", "x")).groupBy("param").agg(F.avg("x").alias("mean"), F.stddev_pop("x").alias("std"))


def bounding_covariance(points: DataFrame, dims: list[str]) -> DataFrame:
    """(i, j, cov): sample covariance times (d + 2), the bounding ellipsoid's scale, of all pairs in one aggregate."""
    pairs = [(a, b) for k, a in enumerate(dims) for b in dims[k:]]
    row = points.agg(*[(F.covar_samp(a, b) * float(len(dims) + 2)).alias(f"{a}|{b}") for a, b in pairs])
    s = F.stack(F.lit(len(pairs)), *[x for a, b in pairs for x in (F.lit(a), F.lit(b), F.col(f"`{a}|{b}`"))])
    return row.select(s.alias("i", "j", "cov"))


def largest_gap(df: DataFrame, u: str) -> DataFrame:
    """(gap, cut): the widest gap of a circular coordinate between 0, the sorted values and 1, and its middle.
    Values are made distinct first; ends of ranges are stitched through their neighbours."""
    v = df.select(F.col(u).cast("double").alias("u")).distinct()
    ends = df.sparkSession.createDataFrame([(0.0,), (1.0,)], "u double")
    from .ordered import ranked

    r = ranked(v.unionByName(ends), "u")
    nxt = r.select((F.col("rk") - 1).alias("rk"), F.col("u").alias("next"))
    g = r.join(nxt, "rk").select("u", (F.col("next") - F.col("u")).alias("gap"), ((F.col("next") + F.col("u")) / 2).alias("cut"))
    best = g.agg(F.max_by(F.struct("gap", "cut"), F.struct(F.round("gap", 12), -F.col("u"))).alias("m"))
    return best.select("m.gap", "m.cut")


def jumps(df: DataFrame, by: str, order: list[str], value: str) -> DataFrame:
    """Differences of consecutive rows of each chain."""
    w = Window.partitionBy(by).orderBy(*order)
    return df.withColumn("jump", F.abs(F.col(value) - F.lag(value).over(w))).where("jump is not null")


def jump_diagnostics(j: DataFrame, reference: float, by: str) -> DataFrame:
    """Geometric mean of relative jumps and the fraction of those that are far enough."""
    rel = F.col("jump") / F.lit(float(reference))
    return j.groupBy(by).agg(F.count(F.lit(1)).alias("n"), F.exp(F.avg(F.log(rel + 1e-10))).alias("mean_jump"), F.avg((rel > 1).cast("double")).alias("far_enough"))
