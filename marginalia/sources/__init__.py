"""Points from tables and files, and the files of a run."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.ordered import lagged, ranked


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def points_from(df: DataFrame, key: str, logl: Column, roots: int, ragged: bool = False) -> DataFrame:
    """A valid run from any table: in order of logl, each row is the child of the row ``roots`` ranks before.
    ``ragged``: from the middle on, of the row roots // 2 before, so that the width halves."""
    base = df.select("*", F.col(key).alias("point_id"), logl.alias("logl"))
    r = ranked(base, "logl", "point_id").drop("__part")
    r = lagged(r, roots, "rk", parent_id="point_id", birth="logl")
    if ragged:
        half = df.count() // 2
        r = lagged(r, roots // 2, "rk", __p="point_id", __b="logl")
        late = F.col("rk") > half
        r = r.withColumn("parent_id", F.when(late, F.col("__p")).otherwise(F.col("parent_id"))).withColumn("birth", F.when(late, F.col("__b")).otherwise(F.col("birth"))).drop("__p", "__b")
    return r.withColumn("root_id", (F.col("rk") - 1) % roots).drop("rk")


def read_text_points(spark: SparkSession, path: str, x_dim: int, num_params: int, sep: str = "\t") -> DataFrame:
    """Rows of Lmin, L, quality, u.., p.. from a text store; rows of another width are dropped."""
    names = ["birth", "logl", "quality", *[f"u_{i + 1}" for i in range(x_dim)], *[f"p_{i + 1}" for i in range(num_params)]]
    raw = spark.read.text(path).select(F.split(F.trim("value"), f"[{sep}\\s]+").alias("f")).where(F.size("f") == len(names))
    return raw.select(*[F.element_at("f", i + 1).cast("double").alias(n) for i, n in enumerate(names)])


def write_text_points(df: DataFrame, path: str, sep: str = "\t") -> None:
    df.select([F.format_string("%.18e", F.col(c).cast("double")).alias(c) for c in df.columns]).write.csv(path, sep=sep)


def write_run(path: str, **tables: DataFrame) -> None:
    """The files of a run: one Parquet folder for each table (points, weighted_samples, samples, run_sequence, summary)."""
    for name, df in tables.items():
        df.write.mode("overwrite").parquet(f"{path}/{name}")


def read_run(spark: SparkSession, path: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{path}/{name}")


def read_settings(spark: SparkSession, path: str) -> DataFrame:
    """Run options from JSON files, one object each, with a short id of the option text."""
    df = spark.read.json(path, multiLine=True)
    return df.withColumn("settings_id", F.substring(F.md5(F.to_json(F.struct(*df.columns))), 1, 10))
