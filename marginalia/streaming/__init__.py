"""Monitoring of runs as streams."""

from __future__ import annotations

import math
import uuid
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def order_test(ranks: DataFrame, key: str = "run_id", threshold: float = 4.0) -> DataFrame:
    """A stateful stream: (key, rank, n) rows in, one row for each key and micro-batch out.

    State is the sum of (rank + 1/2) / n, the length of the run since the last reset, the
    number of rows and of resets; a z-score beyond the threshold resets it. Rows of a
    batch are taken in order of ``seq``."""
    kind = ranks.schema[key].dataType.simpleString()

    def update(k: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        u, run, rows, resets = state.get if state.exists else (0.0, 0, 0, 0)
        z = 0.0
        # two numbers a row are held, and no frame of them all
        seqs, terms = [], []
        for b in batches:
            seqs.append(b["seq"].to_numpy(np.int64))
            terms.append((b["rank"].to_numpy(np.float64) + 0.5) / b["n"].to_numpy(np.float64))
        seq, term = np.concatenate(seqs), np.concatenate(terms)
        del seqs, terms
        term = term[np.argsort(seq, kind="stable")]
        del seq
        for x in (x for k in range(0, len(term), 10_000) for x in term[k : k + 10_000].tolist()):
            u, run, rows = u + x, run + 1, rows + 1
            z = (u - run / 2) / math.sqrt(run / 12)
            if abs(z) > threshold:
                u, run, resets = 0.0, 0, resets + 1
        state.update((float(u), int(run), int(rows), int(resets)))
        yield pd.DataFrame({key: [k[0]], "rows": [rows], "resets": [resets], "run_length": [run], "z": [z]})

    return ranks.groupBy(key).applyInPandasWithState(update, f"{key} {kind}, rows long, resets long, run_length long, z double", "u double, run long, rows long, resets long", "update", GroupStateTimeout.NoTimeout)


def drain(stream: DataFrame, spark: SparkSession, mode: str = "update") -> DataFrame:
    """Runs a stream over all that is there, in the folder that all machines share, and reads what it wrote."""
    from ..operators.ordered import materialise

    materialise(spark.range(1))  # makes sure that a shared folder is known
    folder = f"{spark.sparkContext._jsc.sc().getCheckpointDir().get()}/stream-{uuid.uuid4().hex}"

    def put(batch: DataFrame, number: int) -> None:
        batch.withColumn("batch", F.lit(number)).write.mode("overwrite").parquet(f"{folder}/out/batch_id={number}")

    stream.writeStream.outputMode(mode).foreachBatch(put).option("checkpointLocation", f"{folder}/state").trigger(availableNow=True).start().awaitTermination()
    return spark.read.parquet(f"{folder}/out").drop("batch_id")


def windowed(events: DataFrame, ts: str, width: str, late: str, *by: str) -> DataFrame:
    """Counts and means by event time, dropping what comes later than the watermark."""
    return events.withWatermark(ts, late).groupBy(F.window(ts, width), *by).agg(F.count(F.lit(1)).alias("n"), F.avg("value").alias("mean"))
