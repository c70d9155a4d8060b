"""Counts taken while writing, contracts, scores of runs that are written twice, contents of files."""

import datetime as dt
import hashlib

import pytest
from pyspark.sql import functions as F

from quietday.operators.audits import same_days, written_with_counts
from quietday.sources import array_files, files


def days(spark, *numbers):
    return spark.createDataFrame([(None if n is None else dt.date(2024, 1, n),) for n in numbers], "day date")


def test_counts_are_those_of_the_written_rows(spark, tmp_path):
    df = spark.createDataFrame([(i, None if i % 3 else 1.0) for i in range(100)], "i int, v double").repartition(4)
    seen = written_with_counts(df, str(tmp_path / "t"), n=F.count(F.lit(1)), missing=F.count_if(F.col("v").isNull()), high=F.max("i"))
    assert seen == {"n": 100, "missing": 66, "high": 99} and spark.read.parquet(str(tmp_path / "t")).count() == 100
    assert written_with_counts(df.limit(0), str(tmp_path / "e"), n=F.count(F.lit(1)), high=F.max("i")) == {"n": 0, "high": None}


def test_unequal_days_stop_the_query(spark):
    assert sorted(r["day"].day for r in same_days(days(spark, 1, 2, 2, 3), days(spark, 3, 1, 2), "day").collect()) == [1, 2, 3]
    assert same_days(days(spark, None, 4), days(spark, 4, None, None), "day").count() == 2
    with pytest.raises(Exception, match="slow table lacks 2024-01-05"):
        same_days(days(spark, 4, 5), days(spark, 4), "day", ("fast", "slow")).collect()
    with pytest.raises(Exception, match="fast table lacks null"):
        same_days(days(spark, 4), days(spark, 4, None), "day", ("fast", "slow")).collect()
    assert same_days(days(spark), days(spark), "day").count() == 0


def test_a_rerun_doubles_nothing(spark, tmp_path):
    path = str(tmp_path / "scores")
    run = lambda arm, seed, mae: spark.createDataFrame([(arm, seed, k, mae + k) for k in range(3)], "arm string, seed int, lead int, mae double")
    todo = spark.createDataFrame([("full", 0), ("full", 1), ("ts", 0)], "arm string, seed int")
    assert files.missing_runs(todo, path, ["arm", "seed"]).count() == 3
    files.append_scores(run("full", 0, 1.0), path, ["arm", "seed"])
    files.append_scores(run("full", 1, 2.0), path, ["arm", "seed"])
    assert [tuple(r) for r in files.missing_runs(todo, path, ["arm", "seed"]).collect()] == [("ts", 0)]
    files.append_scores(run("full", 0, 5.0), path, ["arm", "seed"])  # again, with other values
    rows = spark.read.parquet(path)
    assert rows.count() == 6 and sorted(r["mae"] for r in rows.where("seed = 0").collect()) == [5.0, 6.0, 7.0]


def test_contents_and_their_manifest(spark, tmp_path):
    path = str(tmp_path / "texts")
    df = spark.createDataFrame([("a.txt", bytearray(b"one")), ("sub/b.txt", bytearray("zwei ä".encode())), ("c.bin", None)], "name string, content binary")
    array_files.write_contents(df, path)
    got = {r["file"]: (r["bytes"], r["sha256"]) for r in files.manifest(spark, path, "*.txt").collect()}
    assert got == {"a.txt": (3, hashlib.sha256(b"one").hexdigest()), "b.txt": (7, hashlib.sha256("zwei ä".encode()).hexdigest())}
    assert {r["path"].split("/")[-1]: r["bytes"] for r in array_files.listing(spark, path).collect()} == {"a.txt": 3, "b.txt": 7}  # Spark lists no file without bytes
