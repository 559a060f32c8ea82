"""Global order without a global window.

A window with an order but no partition puts every row into one task. Here rows
are range-partitioned once and written to the shared folder; running sums are
local windows plus the sums of the partitions before, one row for each partition.
"""

from __future__ import annotations

import re
import tempfile

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

PART = "__part"


def materialise(df: DataFrame) -> DataFrame:
    """Compute once into the folder that all machines share, as spark.checkpoint.dir names it (a temporary one only where everything runs in one process)."""
    spark = df.sparkSession
    if spark.sparkContext._jsc.sc().getCheckpointDir().isEmpty():
        named = spark.conf.get("spark.checkpoint.dir", None)
        if not named and not re.fullmatch(r"local(\[[^]]*\])?", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        spark.sparkContext.setCheckpointDir(named or tempfile.mkdtemp(prefix="marginalia-"))
    return df.checkpoint(eager=True)


def range_partitioned(df: DataFrame, *order: str, sort: bool = False) -> DataFrame:
    """Rows in ranges of ``order``, numbered in PART. Boundaries are fixed by writing the result. ``sort``: the rows of a range are written in order, too."""
    ranges = df.repartitionByRange(*order)
    return materialise((ranges.sortWithinPartitions(*order) if sort else ranges).withColumn(PART, F.spark_partition_id()))


def running_sum(df: DataFrame, value: Column, name: str, *order: str, exclusive: bool = False, by: tuple[str, ...] = ()) -> DataFrame:
    """``df`` (from range_partitioned by ``order``) with the running sum of ``value`` over the whole order, or within each group of ``by``.

    The sums that are broadcast number one for each partition and group."""
    v = f"__{name}_value"
    df = df.withColumn(v, value)
    before = Window.partitionBy(*by).orderBy(PART).rowsBetween(Window.unboundedPreceding, -1)
    offsets = df.groupBy(PART, *by).agg(F.sum(v).alias("__sum")).select(PART, *by, F.coalesce(F.sum("__sum").over(before), F.lit(0)).alias("__before"))
    own = Window.partitionBy(PART, *by).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1 if exclusive else 0)
    out = df.withColumn("__own", F.coalesce(F.sum(v).over(own), F.lit(0))).join(F.broadcast(offsets), [PART, *by])
    return out.withColumn(name, F.col("__own") + F.col("__before")).drop("__own", "__before", v)


def following(df: DataFrame, value: Column, name: str, *order: str) -> DataFrame:
    """``df`` (from range_partitioned by ``order``) with the first non-null ``value`` at or after each row."""
    df = df.withColumn("__value", value)
    after = Window.orderBy(F.desc(PART)).rowsBetween(Window.unboundedPreceding, -1)  # one row for each partition
    offsets = _firsts(df, *order).select(PART, F.last("__first", ignorenulls=True).over(after).alias("__later"))
    own = Window.partitionBy(PART).orderBy(*map(F.desc, order)).rowsBetween(Window.unboundedPreceding, 0)  # backwards, so that frames only grow
    out = df.withColumn("__own", F.last("__value", ignorenulls=True).over(own)).join(F.broadcast(offsets), PART)
    return out.withColumn(name, F.coalesce("__own", "__later")).drop("__own", "__later", "__value")


def _firsts(df: DataFrame, *order: str) -> DataFrame:
    """The first non-null __value of each partition; partitions without one have null."""
    found = df.where("__value is not null").groupBy(PART).agg(F.min_by("__value", F.struct(*order)).alias("__first"))
    return df.select(PART).distinct().join(found, PART, "left")


def ranked(df: DataFrame, *order: str, name: str = "rk") -> DataFrame:
    """``df`` in ranges with its 1-based global rank."""
    return running_sum(range_partitioned(df, *order), F.lit(1).cast("long"), name, *order)


def lagged(df: DataFrame, by: int, rank: str, **cols: str) -> DataFrame:
    """Adds values from ``by`` ranks before: an equi-join on the rank. ``cols``: new name = old name."""
    prev = df.select((F.col(rank) + by).alias(rank), *[F.col(old).alias(new) for new, old in cols.items()])
    return df.join(prev, rank, "left")
