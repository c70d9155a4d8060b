"""A database on the Derby driver that comes with Spark: written, read in partitions, filters pushed down."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from quietday.sources import files


@pytest.fixture
def database(tmp_path, monkeypatch):
    monkeypatch.setenv("DB_URL", f"jdbc:derby:{tmp_path}/frames;create=true")
    monkeypatch.setenv("DB_DRIVER", "org.apache.derby.iapi.jdbc.AutoloadedDriver")
    for name in ("USER", "PASSWORD"):
        monkeypatch.delenv(f"DB_{name}", raising=False)


def frames(spark, n):
    rows = [(i, dt.datetime(2024, 1, 1) + dt.timedelta(minutes=i), ("c2", "c3")[i % 2], float(i)) for i in range(n)]
    return spark.createDataFrame(rows, "id int, at timestamp, camera string, value double").repartition(6)


def test_rows_come_back_in_partitions(spark, database):
    df = frames(spark, 500)
    files.jdbc_write(df, "frames", mode="overwrite", batch=50, connections=3)
    files.jdbc_write(frames(spark, 1).withColumn("id", F.lit(None).cast("int")), "frames")
    got = files.jdbc_table(spark, "frames", by="id", partitions=4, fetch=100)
    assert got.rdd.getNumPartitions() == 4
    sizes = got.groupBy(F.spark_partition_id()).count().collect()
    assert len(sizes) == 4 and max(r["count"] for r in sizes) < 150
    names = {c: c.lower() for c in got.columns}
    assert sorted(map(tuple, got.where("id is not null").withColumnsRenamed(names).select(df.columns).collect())) == sorted(map(tuple, df.collect()))
    assert got.where("id is null").count() == 1


def test_filters_columns_and_counts_reach_the_database(spark, database):
    files.jdbc_write(frames(spark, 500), "frames", mode="overwrite", types="camera VARCHAR(8)")
    t = files.jdbc_table(spark, "frames", by="id", partitions=4)
    some = t.where("camera = 'c2' and id >= 100 and id < 110").select("value")
    plan = some._jdf.queryExecution().executedPlan().toString()
    pushed = plan[plan.index("PushedFilters") :]
    assert "EqualTo" in pushed and "GreaterThanOrEqual" in pushed and "LessThan" in pushed and "AT" not in plan.split("ReadSchema")[1].upper()
    assert sorted(r[0] for r in some.collect()) == [100.0, 102.0, 104.0, 106.0, 108.0]
    spans = files.time_range(files.jdbc_table(spark, "frames"), "at", "2024-01-01 00:10:00", "2024-01-01 00:13:00", ["id"])
    assert sorted(r[0] for r in spans.collect()) == [10, 11, 12] and "GreaterThanOrEqual" in spans._jdf.queryExecution().executedPlan().toString()


def test_an_empty_table(spark, database):
    files.jdbc_write(frames(spark, 3).limit(0), "frames", mode="overwrite")
    assert files.jdbc_table(spark, "frames", by="id").count() == 0
