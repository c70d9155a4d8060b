"""Sources, sinks and the stream on small folders."""

import datetime as dt
import hashlib
import json

from pyspark.sql import functions as F

from quietday.sources import files
from quietday.sources.reports import activity_report
from quietday.streaming.windows import run_available


def test_names_manifests_and_caches(spark, tmp_path):
    for name, v in (("l6_L1_s0", 1), ("l6_L7_s2", 2), ("other", 3)):
        spark.createDataFrame([(v,)], "v int").toPandas().to_parquet(tmp_path / f"{name}.parquet")
    got = files.keyed_by_name(spark, str(tmp_path), r"^(\w+?)_L(\d+)_s(\d+)\.parquet$", ["tag", "history", "seed"])
    assert sorted(map(tuple, got.collect())) == [(1, "l6", "1", "0"), (2, "l6", "7", "2")]
    m = {r["file"]: (r["bytes"], r["sha256"]) for r in files.manifest(spark, str(tmp_path), "*.parquet").collect()}
    data = (tmp_path / "other.parquet").read_bytes()
    assert len(m) == 3 and m["other.parquet"] == (len(data), hashlib.sha256(data).hexdigest())
    frame = tmp_path / "cache/view/2024/20240510_06.npy"
    frame.parent.mkdir(parents=True)
    frame.write_bytes(b"x")
    (tmp_path / "cache/view/2024/neutral.npy").write_bytes(b"x")
    assert [(r["source"], r["slot_time"]) for r in files.cache_index(spark, str(tmp_path / "cache")).collect()] == [("view", dt.datetime(2024, 5, 10, 6))]


def test_tables_ranges_and_appends(spark, tmp_path):
    (tmp_path / "a.csv").write_text("date,ap\n2024-01-01,5\n2024-01-02,\n")
    c = files.csv_table(spark, str(tmp_path / "a.csv"), "date date, ap double")
    assert c.collect()[0]["date"] == dt.date(2024, 1, 1) and files.time_range(c, "date", "2024-01-02", "2024-01-03", ["ap"]).collect()[0]["ap"] is None
    assert files.time_range(c, "date", None, "2024-01-02", ["ap"]).count() == 1
    (tmp_path / "e.json").write_text(json.dumps([{"id": "a", "n": 1}, {"id": "b", "n": None}]))
    assert files.json_entries(spark, str(tmp_path / "e.json"), "id string, n int").count() == 2
    for seed in (0, 1):
        files.append_scores(spark.createDataFrame([("m", seed, 0.5)], "model string, seed int, mae double"), str(tmp_path / "scores"), ["seed"])
    one = spark.read.parquet(str(tmp_path / "scores")).where("seed = 1")
    assert one.count() == 1 and "PartitionFilters: [isnotnull(seed" in one._jdf.queryExecution().toString()
    (tmp_path / "p.json").write_text('{"hi": 3}')
    assert files.parameters(spark, str(tmp_path / "p.json"), {"hi": 1.0, "lo": 0.0}) == {"hi": 3.0, "lo": 0.0} and files.parameters(spark, None, {"a": 1.0}) == {"a": 1.0}


def test_whole_reports(spark, tmp_path):
    (tmp_path / "r.txt").write_text(":Issued: 2023 Jan 01 2200 UTC\nObserved Afr/Ap 31 Dec  022/028\n")
    (tmp_path / "cut.txt").write_text("nothing\n")
    rows = activity_report(files.report_texts(spark, str(tmp_path))).collect()
    assert [(r["target_date"], r["lead"], r["ap"]) for r in rows] == [(dt.date(2022, 12, 31), -1, 28.0)]


def test_stream_goes_on_where_it_stopped(spark, tmp_path):
    schema = "event_id long, ts timestamp_ntz, value double"

    def add(name, hours):
        rows = [(i, dt.datetime(2024, 1, 1) + dt.timedelta(hours=h), 1.0) for i, h in enumerate(hours)]
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        run_available(spark, str(tmp_path / "in"), str(tmp_path / "out"), str(tmp_path / "state"), spark.createDataFrame([], schema).schema)
        return {r["time"].hour + 24 * (r["time"].day - 1): r["n"] for r in spark.read.parquet(str(tmp_path / "out")).select(F.col("time").cast("timestamp_ntz").alias("time"), "n").collect()}

    assert add("a", [0, 1, 4, 20]) == {0: 2, 3: 1}  # the window of 18-21 is open
    assert add("b", [2, 19, 40]) == {0: 2, 3: 1, 18: 2}  # hour 2 came too late
