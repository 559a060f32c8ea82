import math
import os

import pytest
from pyspark.sql import functions as F

from marginalia.operators.chained import pop_sequence, run_lengths_table
from marginalia.sources import datasource
from marginalia.streaming import order_test

ROWS = [(-math.inf, 123.0, 413.0, 213.0), (101.0, 155.0, 413.0, 213.0), (99.0, 156.0, 413.0, 213.0)]
NAMES = "birth,logl,a,b"
KINDS = "birth double, logl double, a double, b double"


@pytest.fixture(scope="module", autouse=True)
def known(spark):
    datasource.register(spark)


def put(spark, path, rows, kinds=KINDS, **options):
    spark.createDataFrame(rows, kinds).coalesce(1).write.format("points").mode("append").options(path=path, **options).save()


def test_rows_come_back_in_order_once(spark, tmp_path):
    path = str(tmp_path / "store")
    with pytest.raises(Exception, match="new"):
        spark.read.format("points").options(path=path).load()
    empty = spark.read.format("points").options(path=path, names=NAMES).load()
    assert empty.columns == ["seq", *NAMES.split(",")] and empty.count() == 0
    for k, row in enumerate(ROWS):
        put(spark, path, [row], ncalls=10 * (k + 1))
    put(spark, path, [])
    rows = spark.read.format("points").options(path=path).load()
    assert [tuple(r)[1:] for r in rows.orderBy("seq").collect()] == ROWS and datasource.calls(path) == 30
    asked = spark.createDataFrame([(0, -math.inf), (1, -math.inf), (2, 100.0), (3, 100.0), (4, 102.0)], "k long, threshold double")
    assert [r["seq"] for r in pop_sequence(rows, asked).orderBy("k").collect()] == [0, None, 2, None, 1]


def test_other_widths_are_refused(spark, tmp_path):
    path = str(tmp_path / "store")
    put(spark, path, ROWS)
    for names in ("birth,logl,a", NAMES + ",c"):
        with pytest.raises(Exception, match="holds"):
            spark.read.format("points").options(path=path, names=names).load()
    with pytest.raises(Exception, match="holds"):
        put(spark, path, [(1.0, 2.0)], "birth double, logl double")
    with pytest.raises(Exception, match="append"):
        spark.createDataFrame(ROWS, KINDS).write.format("points").mode("overwrite").options(path=path).save()
    put(spark, str(tmp_path / "plain"), [(None, 1.0, 0.0, 0.5, 0.7)], "birth double, logl double, quality double, u_1 double, p_1 double", x_dim=1, num_params=1)
    assert spark.read.format("points").options(path=str(tmp_path / "plain"), x_dim=1, num_params=1).load().first()["birth"] is None


def test_a_failed_append_leaves_nothing(spark, tmp_path):
    path = str(tmp_path / "store")
    put(spark, path, ROWS)
    bad = spark.range(0, 40, 1, 4).select(F.when(F.col("id") == 35, F.raise_error(F.lit("broken"))).otherwise(F.col("id")).cast("double").alias("birth"), *[F.lit(1.0).alias(c) for c in ("logl", "a", "b")])
    with pytest.raises(Exception, match="broken"):
        bad.write.format("points").mode("append").options(path=path).save()
    assert spark.read.format("points").options(path=path).load().count() == 3
    assert len(os.listdir(f"{path}/log")) == 1
    datasource.vacuum(path)  # a task that was killed could not delete its file
    assert len(os.listdir(f"{path}/data")) == 1 and spark.read.format("points").options(path=path).load().count() == 3


def test_several_files_keep_their_numbers(spark, tmp_path):
    path = str(tmp_path / "store")
    many = spark.range(0, 25_000, 1, 3).select(*[F.col("id").cast("double").alias(c) for c in ("birth", "logl", "a", "b")])
    many.write.format("points").mode("append").options(path=path).save()
    got = spark.read.format("points").options(path=path).load()
    assert got.where("seq <> cast(logl as long)").count() == 0 and got.count() == 25_000 and got.rdd.getNumPartitions() == 3


def test_a_stream_over_a_growing_store_is_stopped_and_goes_on(spark, tmp_path):
    """Ranks are appended; a stream of the rank test is stopped mid-way, the store grows, and the restarted stream ends where one batch would."""
    path, folder = str(tmp_path / "store"), str(tmp_path)
    ranks = [(float(k), float((k * 7919) % 100 * (0.5 if k > 300 else 1.0)), 100.0) for k in range(600)]
    kinds = "k double, rank double, n double"
    for at in range(0, 400, 100):
        put(spark, path, ranks[at : at + 100], kinds)

    def run(most: int | None) -> None:
        stream = spark.readStream.format("points").options(path=path, names="k,rank,n", **({"most_appends": most} if most else {})).load()
        tested = order_test(stream.select(F.lit(1).cast("long").alias("run_id"), "seq", "rank", "n"), threshold=3.0)

        def keep(batch, number):
            batch.withColumn("number", F.lit(number)).write.mode("overwrite").parquet(f"{folder}/out/number={number}")

        tested.writeStream.outputMode("update").foreachBatch(keep).option("checkpointLocation", f"{folder}/state").trigger(availableNow=True).start().awaitTermination()

    run(1)
    for at in range(400, 600, 100):
        put(spark, path, ranks[at : at + 100], kinds)
    run(None)
    states = spark.read.parquet(f"{folder}/out").orderBy(F.desc("rows")).collect()
    whole = spark.read.format("points").options(path=path).load()
    want = [r["length"] for r in run_lengths_table(whole, "rank", "n", "seq", threshold=3.0).orderBy("at").collect()]
    assert states[0]["rows"] == 600 and states[0]["resets"] == len(want) > 0 and states[0]["run_length"] == 600 - sum(want)


def test_a_stream_writes_each_batch_once(spark, tmp_path):
    source, target, state = (str(tmp_path / n) for n in ("source", "target", "state"))
    put(spark, source, ROWS)
    put(spark, source, ROWS[:1])

    def run():
        rows = spark.readStream.format("points").options(path=source).load().drop("seq")
        rows.writeStream.format("points").options(path=target, names=NAMES, checkpointLocation=state).trigger(availableNow=True).start().awaitTermination()

    run()
    run()
    put(spark, source, ROWS[1:])
    run()
    got = spark.read.format("points").options(path=target).load()
    assert got.count() == 6 and got.select("seq").distinct().count() == 6
