"""Stores of sampled points, and the files of a run.

A stored row is (birth, logl, quality, u_1.., p_1..) with seq, its place in the
store. Stores only grow: each append is a new set of files, so a lost executor or
a stopped run leaves what was there before.
"""

from __future__ import annotations

import logging
import os
import re
import warnings

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.ordered import materialise, ranked


def columns(x_dim: int, num_params: int) -> list[str]:
    return ["birth", "logl", "quality", *[f"u_{i + 1}" for i in range(x_dim)], *[f"p_{i + 1}" for i in range(num_params)]]


class PointStore:
    """Rows taken from it come in storage order, each once (for many thresholds see warmstart.pop_sequence)."""

    def __init__(self, names: list[str]):
        self.names, self.used, self.ncalls = names, [], 0

    def stored(self) -> DataFrame | None:
        """All rows with seq."""
        raise NotImplementedError

    def append(self, rows: DataFrame, ncalls: int) -> None:
        raise NotImplementedError

    def pop(self, threshold: float):
        """The first row not taken yet that was born at or below ``threshold`` and lies above it; None if there is none."""
        rows = self.stored()
        if rows is None:
            return None
        ok = (F.coalesce("birth", F.lit(float("-inf"))) <= threshold) & (F.col("logl") > threshold)
        if self.used:
            ok &= ~F.col("seq").isin(self.used)
        row = rows.where(ok).orderBy("seq").first()  # a top-1, not a sort
        if row is not None:
            self.used.append(row["seq"])
        return row


class NullPointStore(PointStore):
    """Keeps nothing but the numbers of rows and calls."""

    def __init__(self, names: list[str]):
        super().__init__(names)
        self.nrows = 0

    def stored(self) -> None:
        return None

    def append(self, rows: DataFrame, ncalls: int) -> None:
        self.nrows += rows.count()
        self.ncalls = ncalls


def _exists(spark: SparkSession, path: str) -> bool:
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p)


def _names(spark: SparkSession, path: str) -> list[str]:
    """What a folder on any file system holds; nothing if it does not exist."""
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    fs = p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    return [f.getPath().getName() for f in fs.listStatus(p)] if fs.exists(p) else []


class ParquetPointStore(PointStore):
    """Appends Parquet files; the number of calls is in a table beside them. Opening it finds what earlier runs left."""

    def __init__(self, spark: SparkSession, path: str, names: list[str]):
        super().__init__(names)
        self.spark, self.path = spark, path.rstrip("/")
        if _exists(spark, f"{self.path}/calls"):
            self.ncalls = spark.read.parquet(f"{self.path}/calls").agg(F.max("ncalls")).first()[0]
        rows = self.stored()
        if rows is not None and rows.columns != ["seq", *names]:
            raise ValueError(f"{path} holds {rows.columns[1:]}, not {names}")

    def stored(self) -> DataFrame | None:
        return self.spark.read.parquet(f"{self.path}/points") if _exists(self.spark, f"{self.path}/points") else None

    def append(self, rows: DataFrame, ncalls: int) -> None:
        """Rows keep their order; ``ncalls`` is the number of likelihood calls so far."""
        had = self.stored()
        base = had.count() if had is not None else 0
        rows = ranked(rows.select(*self.names).withColumn("__at", F.monotonically_increasing_id()), "__at").withColumn("seq", F.col("rk") - 1 + base)
        rows.select("seq", *self.names).write.mode("append").parquet(f"{self.path}/points")
        self.spark.createDataFrame([(ncalls,)], "ncalls long").write.mode("append").parquet(f"{self.path}/calls")
        self.ncalls = ncalls


class TextPointStore(PointStore):
    """Text rows, one separator between numbers. Rows of another width than expected are warned of and not used."""

    def __init__(self, spark: SparkSession, path: str, names: list[str], sep: str = "\t"):
        super().__init__(names)
        self.spark, self.path, self.sep = spark, path.rstrip("/"), sep
        if _exists(spark, f"{self.path}/calls"):
            self.ncalls = spark.read.text(f"{self.path}/calls").agg(F.max(F.col("value").cast("long"))).first()[0]
        bad = self._lines().where(F.size("f") != len(names)).count() if _exists(spark, self.path) else 0
        if bad:
            warnings.warn(f"{path}: {bad} rows do not have {len(names)} columns and are not used", stacklevel=2)

    def _lines(self) -> DataFrame:
        """Each append is a folder append-N of part files, which are read in the order of their names and lines."""
        raw = self.spark.read.text(f"{self.path}/append-*").select("value", F.col("_metadata.file_path").alias("__file"), F.col("_metadata.file_block_start").alias("__block"), F.monotonically_increasing_id().alias("__at"))
        return raw.select(F.split(F.trim("value"), f"{re.escape(self.sep)}|\\s+").alias("f"), "__file", "__block", "__at").where(F.trim("value") != "")

    def stored(self) -> DataFrame | None:
        if not _exists(self.spark, self.path):
            return None
        rows = ranked(materialise(self._lines()), "__file", "__block", "__at").where(F.size("f") == len(self.names))
        return rows.select((F.col("rk") - 1).alias("seq"), *[F.element_at("f", i + 1).cast("double").alias(n) for i, n in enumerate(self.names)])

    def append(self, rows: DataFrame, ncalls: int) -> None:
        had = max((int(n.rpartition("-")[2]) + 1 for n in _names(self.spark, self.path) if n.startswith("append-")), default=0)
        text = rows.select(F.concat_ws(self.sep, *[F.format_string("%.18e", F.coalesce(F.col(c).cast("double"), F.lit(float("-inf")))) for c in self.names]).alias("value"))
        text.write.text(f"{self.path}/append-{had:09d}")
        self.spark.createDataFrame([(str(ncalls),)], "value string").write.mode("append").text(f"{self.path}/calls")
        self.ncalls = ncalls


def make_run_dir(path: str, run: int | None = None) -> dict[str, str]:
    """A numbered folder for a run on a file system of the driver, with its folders for info, results, chains, extra and plots."""
    os.makedirs(path, exist_ok=True)
    if run is None:
        taken = [int(m[1]) for d in os.listdir(path) if (m := re.fullmatch(r"run(\d+)", d))]
        run = max(taken, default=0) + 1
    out = {"run_dir": f"{path}/run{run}"} | {k: f"{path}/run{run}/{k}" for k in ("info", "results", "chains", "extra", "plots")}
    for d in out.values():
        os.makedirs(d, exist_ok=True)
    return out


def create_logger(name: str, folder: str | None = None, level: int = logging.INFO) -> logging.Logger:
    """Messages to the screen, and in full to debug.log in ``folder``."""
    log = logging.getLogger(name)
    log.setLevel(logging.DEBUG)
    if not log.handlers:
        screen = logging.StreamHandler()
        screen.setLevel(level)
        screen.setFormatter(logging.Formatter(f"[{name}] %(message)s"))
        log.addHandler(screen)
    if folder and not any(isinstance(h, logging.FileHandler) for h in log.handlers):
        file = logging.FileHandler(f"{folder}/debug.log")
        file.setFormatter(logging.Formatter("%(asctime)s [%(name)s/%(levelname)s] %(message)s"))
        log.addHandler(file)
    return log


def write_tree(points: DataFrame, path: str) -> None:
    """The tree of a run: edges (parent_id, child_id, child_logl) and the points themselves."""
    points.select("parent_id", F.col("point_id").alias("child_id"), F.col("logl").alias("child_logl")).write.mode("overwrite").parquet(f"{path}/edges")
    points.write.mode("overwrite").parquet(f"{path}/points")


def write_results(path: str, weights: DataFrame, samples: DataFrame, sequence: DataFrame, table: DataFrame, names: list[str], unit: list[str] = ()) -> None:
    """The six results of a run, as folders of CSV with a header (info/results: JSON).

    weights: weight, logl and the parameters (and ``unit`` coordinates); samples: equally
    weighted ones; sequence: the run row by row; table: one row of results.
    """
    from ..operators.posterior import equal_weight_summary

    put = lambda df, name: df.write.mode("overwrite").csv(f"{path}/{name}", header=True)
    put(samples.select(*names), "chains/equal_weighted_post")
    put(weights.select("weight", "logl", *names), "chains/weighted_post")
    if unit:
        put(weights.select("weight", "logl", *unit), "chains/weighted_post_untransformed")
    put(sequence, "chains/run")
    table.write.mode("overwrite").json(f"{path}/info/results")
    put(equal_weight_summary(samples, names), "info/post_summary")


def write_rows(spark: SparkSession, rows: list[dict], path: str) -> None:
    """A small table of a sampler's own steps as CSV: calibration (nsteps, logz, ...), the final state, or the log of a chain."""
    spark.createDataFrame(rows).coalesce(1).write.mode("append").csv(path, header=True)


def read_similar(spark: SparkSession, path: str, names: list[str], least: int = 50) -> DataFrame:
    """Weighted points (weight, logl, coordinates) of another run with the same parameters; zero weights are dropped.

    None but a header of exactly these names is taken, and fewer than ``least`` rows are refused."""
    df = spark.read.csv(path, header=True, inferSchema=True)
    if df.columns != ["weight", "logl", *names]:
        raise ValueError(f"{path} has the columns {df.columns}, not {['weight', 'logl', *names]}")
    df = df.where("weight > 0")
    if df.limit(least).count() < least:
        raise ValueError(f"{path} has fewer than {least} rows with a weight")
    return df


def read_file(spark: SparkSession, path: str, x_dim: int, num_params: int, num_bootstraps: int = 20, seed: int = 1, random: bool = False, check_insertion_order: bool = True) -> tuple[DataFrame, DataFrame]:
    """(points with weights, one row of results) from a stored run alone: the tree is rebuilt and integrated again.

    ``random``: volumes shrink by draws (seeded by point) instead of their means. With
    ``check_insertion_order`` the row of results has the test of insertion ranks, too.
    """
    from ..operators.chained import order_test_summary
    from ..operators.evidence import live_points, weighted, weighted_stochastic
    from ..operators.ordertest import insertion_ranks
    from ..operators.reactive import bootstrap_masks, rebuild_tree, result_table, with_roots

    rows = ParquetPointStore(spark, path, columns(x_dim, num_params)).stored()
    points = materialise(with_roots(rebuild_tree(rows)))
    table = result_table(points, bootstrap_masks(points, num_bootstraps, seed))
    if check_insertion_order:
        ranks = materialise(insertion_ranks(live_points(points)))
        table = table.join(F.broadcast(order_test_summary(ranks, "insert_rank", "nlive", "rk")))  # one row each
    return (weighted_stochastic(points, seed) if random else weighted(points)), table
