import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from marginalia.operators import region as rg
from marginalia.operators import strategy as st


def cloud(n, seed, steps=None):
    rng = random.Random(seed)
    draw = (lambda: rng.randrange(steps) / steps) if steps else rng.random
    return [(i, draw(), draw()) for i in range(n)]


def test_pairs_at_just_the_radius(spark):
    """The square of 0.05 is 0.0025, as SQL has it, and points at just the radius meet though their quotients round apart (F5)."""
    rows = [(k, k * 550 / 11000, 0.0) for k in range(200)] + [(1000 + k, (k * 550 + 7) / 11000, 0.5) for k in range(200)]
    c = spark.createDataFrame(rows, "id long, x double, y double")
    got = {r["b_id"]: r["n"] for r in rg.count_neighbours(c.withColumnRenamed("id", "a_id"), c.withColumnRenamed("id", "b_id"), 0.05, ["x", "y"]).collect()}
    assert got == {i: sum((x - u) * (x - u) + (y - v) * (y - v) <= 0.0025 for _, u, v in rows) for i, x, y in rows}


@pytest.mark.parametrize("steps", [None, 12])
def test_extremes_equal_all_pairs(spark, steps):
    """First neighbours and matched clusters, with tasks cut in pieces (F8, F10)."""
    a, b = cloud(400, 1, steps), cloud(150, 2, steps) + [(900, None, 0.5), (901, 5.0, 5.0)]
    old = spark.createDataFrame([(i, x, y, 1 + i % 3) for i, x, y in a], "id long, x double, y double, cluster long")
    new = spark.createDataFrame(b, "id long, x double, y double")
    for radius in (0.02, 0.25):
        near = {j: [i for i, x, y in a if u is not None and (x - u) ** 2 + (y - v) ** 2 <= rg.square(radius)] for j, u, v in b}
        first = rg.extremes_near(old.withColumnRenamed("id", "a_id"), new.withColumnRenamed("id", "b_id"), radius, ["x", "y"], "a_id", split_a=20, split_b=9)
        assert {r["b_id"]: (r["lo"], r["hi"]) for r in first.collect()} == {j: (min(n, default=None), max(n, default=None)) for j, n in near.items()}
        match = {r["id"]: r["cluster"] for r in st.match_clusters(new, old, radius, ["x", "y"]).collect()}
        assert match == {j: (1 + n[0] % 3 if len({i % 3 for i in n}) == 1 else 0) for j, n in near.items()}
        assert {r["b_id"]: r["a_id"] for r in rg.first_neighbour(old.withColumnRenamed("id", "a_id"), new.withColumnRenamed("id", "b_id"), radius, ["x", "y"]).collect()} == {j: min(n, default=-1) for j, n in near.items()}


def test_first_neighbours_make_no_pairs(spark):
    """Rows that come out of the last exchange follow the points, not their pairs (F10)."""
    c = spark.range(3000).select("id", (F.col("id") / 1e6).alias("x"), F.lit(0.0).alias("y"))
    plan = rg.first_neighbour(c.withColumnRenamed("id", "a_id"), c.withColumnRenamed("id", "b_id"), 1.0, ["x", "y"])._jdf.queryExecution().toString()
    assert "FlatMapCoGroupsInArrow" in plan


@pytest.mark.parametrize("block", [7, 1000])
def test_pair_distances_in_blocks(spark, block):
    """Sums over pairs of blocks equal all pairs; copies, repeated ids, lone rows and null vectors included (F3)."""
    rng = np.random.default_rng(3)
    rows = [(int(i % 37), int(i % 3), [float(v) for v in np.float32(rng.normal(size=5))]) for i in range(60)]
    rows += [(100 + i, 1, rows[1][2]) for i in range(5)] + [(200, 9, [1.0] * 5), (201, 1, None)]
    df = spark.createDataFrame(rows, "id long, label long, v array<float>")
    got = {r["label"]: (r["pairs"], r["mean_distance"]) for r in rg.mean_pair_distance(df, "label", "v", block).collect()}
    want = {}
    for k in range(3):
        own = [(i, v) for i, c, v in rows if c == k]
        pairs = [(v, w) for a, (i, v) in enumerate(own) for j, w in own[:a] if i != j]
        want[k] = (len(pairs), pytest.approx(np.mean([math.dist(v, w) for v, w in pairs if v and w]), abs=1e-9))
    assert got == want


def test_clusters_equal_a_walk(spark):
    """Clusters come from fine cells and a forest, without a table of near pairs (F7)."""
    rows = cloud(300, 5) + [(1000 + i, 0.5, 0.5) for i in range(300)]
    got = {r["id"]: r["cluster"] for r in rg.clusters(spark.createDataFrame(rows, "id long, x double, y double"), 0.04, ["x", "y"]).collect()}
    sq, want = rg.square(0.04), {}
    for i, *_ in rows:
        if i in want:
            continue
        want[i], todo = i, [i]
        at = {j: (x, y) for j, x, y in rows}
        while todo:
            u, v = at[todo.pop()]
            for j, x, y in rows:
                if j not in want and (x - u) ** 2 + (y - v) ** 2 <= sq:
                    want[j] = i
                    todo.append(j)
    assert got == want
