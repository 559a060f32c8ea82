"""Connected components by forests of parts of the edges.

In each round an edge goes to the parts of both its ends. A part joins all that its
edges connect and answers with a star for each tree: every node with the least one
it reaches there. All edges of a node are in its part, so a node that has a smaller
neighbour keeps no larger one, and what no longer changes is a star for each
component. A path of any length within a part is one step, so rounds are few.

A node with very many edges would fill its part. Of such hubs, at most 2 * HOT_SHARE
whatever the input, the least neighbours are told to all tasks; an edge of a hub
becomes one from its other end to that neighbour and goes to the other end's part
only. Nothing else reaches the driver but counts.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .ordered import materialise

#: A node is a hub when it has at least one edge in this many, and at least so many.
HOT_SHARE, HOT_LEAST = 1024, 1000


def forest(u: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each node of the edges that is not the least of its tree, and that least one."""
    nodes, at = np.unique(np.concatenate([u, v]), return_inverse=True)
    x, y = at[: len(u)], at[len(u) :]
    root = np.arange(len(nodes))
    while True:
        x, y = root[x], root[y]
        apart = x != y
        if not apart.any():
            break
        x, y = np.maximum(x, y)[apart], np.minimum(x, y)[apart]
        np.minimum.at(root, x, y)
        while not np.array_equal(further := root[root], root):
            root = further
    own = np.flatnonzero(root != np.arange(len(nodes)))
    return nodes[own], nodes[root[own]]


def _forests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    u, v = [], []
    for b in batches:
        u.append(b.column(1).to_numpy())
        v.append(b.column(2).to_numpy())
    if sum(map(len, u)):
        u, v = forest(np.concatenate(u), np.concatenate(v))
        yield pa.RecordBatch.from_arrays([pa.array(u), pa.array(v)], names=["u", "v"])


def _placed(hubs: np.ndarray, least: np.ndarray):
    """Rows (u, v): at, u, v, an edge for the part of node ``at``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            u, v = b.column(0).to_numpy(), b.column(1).to_numpy()
            if len(hubs):
                i, j = np.searchsorted(hubs, u) % len(hubs), np.searchsorted(hubs, v) % len(hubs)
                hub_u, hub_v = hubs[i] == u, hubs[j] == v
                plain = ~hub_u & ~hub_v
                # the other end of a hub's edge with the hub's least neighbour; both, where both are hubs
                one, other = np.r_[v[hub_u], u[hub_v]], np.r_[least[i[hub_u]], least[j[hub_v]]]
                u, v = u[plain], v[plain]
                at = np.r_[u, v, one]
                u, v = np.r_[u, v, one], np.r_[v, u, other]
            else:
                at = np.r_[u, v]
                u, v = at, np.r_[v, u]
            yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(u), pa.array(v)], names=["at", "u", "v"])

    return run


def connected_components(edges: DataFrame, a: str = "a", b: str = "b", most_rounds: int = 60) -> DataFrame:
    """(node, component) for every node of an edge that has two different ends; component is its smallest node."""
    spark = edges.sparkSession
    e = materialise(edges.select(F.greatest(a, b).cast("long").alias("u"), F.least(a, b).cast("long").alias("v")).where("u <> v").distinct())
    n = e.count()
    for _ in range(most_rounds):
        up = e.select(F.col("u").alias("node"), F.col("v").alias("far"), F.lit(1).alias("up"), F.lit(0).alias("down"))
        down = e.select(F.col("v").alias("node"), F.col("u").alias("far"), F.lit(0).alias("up"), F.lit(1).alias("down"))
        nodes = up.unionByName(down).groupBy("node").agg(F.sum("up").alias("up"), F.sum("down").alias("down"), F.least("node", F.min("far")).alias("least"))
        hub = F.col("up") + F.col("down") >= max(HOT_LEAST, n // HOT_SHARE)
        told = nodes.agg(F.count(F.when((F.col("up") > 1) | (F.col("up") * F.col("down") > 0), 1)).alias("open"), F.sum("up").alias("n"), F.collect_list(F.when(hub, F.struct("node", "least"))).alias("hubs")).first()
        if not told["open"]:
            break
        n, hubs = told["n"], np.array(sorted((h["node"], h["least"]) for h in told["hubs"]), np.int64).reshape(-1, 2)
        rows = e.mapInArrow(_placed(hubs[:, 0].copy(), hubs[:, 1].copy()), "at long, u long, v long")
        if len(hubs):  # each hub's link with its least neighbour, for the parts of both
            own = [(x, int(h), int(m)) for h, m in hubs for x in (int(h), int(m)) if h != m]
            rows = rows.unionByName(spark.createDataFrame(own, "at long, u long, v long"))
        e = materialise(rows.repartition("at").mapInArrow(_forests, "u long, v long").distinct())
    else:
        raise RuntimeError("components did not settle")
    return e.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(e.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
