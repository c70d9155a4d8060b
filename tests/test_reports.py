"""Report texts with odd lines, read from files."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from quietday.plans.composed import three
from quietday.plans.parsers import q_latest_issuance, q_rsga_leadk, q_rsga_parse
from quietday.sources import files
from quietday.sources.reports import activity_report, kp_forecast, outlook_45day

TURN = """:Product: daily activity summary
:Issued: 2019 Dec 30 0030 UTC
Observed sunspots 29 Dec 0
  Observed Afr/Ap 29 Dec  011/017
Estimated Afr/Ap 30 Dec  006/ 09
Predicted Afr/Ap 31 Dec-02 Jan  N60/004-007/ NA-010/021
Predicted Afr/Ap
"""


def test_reports_at_the_turn_of_a_year(spark, tmp_path):
    bundle = "\f".join([TURN, "cut short\n", TURN.replace("2019 Dec 30", "2020 Jan 01").replace("29 Dec", "31 Dec").replace("30 Dec", "01 Jan").replace("31 Dec-02 Jan", "02 Jan-04 Jan")])
    (tmp_path / "all.txt").write_text(bundle)
    texts = files.report_bundle(spark, str(tmp_path))
    assert texts.count() == 3
    rows = {(r["issue_date"], r["lead"]): (r["target_date"], r["kind"], r["afr"], r["ap"]) for r in activity_report(texts).collect()}
    first, second = dt.date(2019, 12, 30), dt.date(2020, 1, 1)
    assert rows[first, -1] == (dt.date(2019, 12, 29), "observed", 11.0, 17.0) and rows[first, 0] == (first, "estimated", 6.0, 9.0)
    assert [rows[first, k] for k in (1, 2, 3)] == [(dt.date(2019, 12, 31), "predicted", None, 4.0), (second, "predicted", 7.0, None), (dt.date(2020, 1, 2), "predicted", 10.0, 21.0)]
    assert rows[second, -1][0] == dt.date(2019, 12, 31) and rows[second, 3][0] == dt.date(2020, 1, 4) and len(rows) == 10


def test_outlooks_of_two_centuries(spark):
    text = ":Issued: 1999 Dec 31 0000 UTC\n45-DAY AP FORECAST\n31Dec99 007 01Jan00 123\n45-DAY F10.7 CM FLUX FORECAST\n31Dec99 180\n"
    rows = outlook_45day(spark.createDataFrame([(text,), ("none",)], "text string")).orderBy("lead").collect()
    assert [(r["target_date"], r["lead"], r["ap"], r["f107"]) for r in rows] == [(dt.date(1999, 12, 31), 0, 7.0, 180.0), (dt.date(2000, 1, 1), 1, 123.0, None)]


def test_forecasts_that_are_not_whole(spark):
    rows = [("a", None), ("b", ":Issued: 2024 Feb 30 0000 UTC\n"), ("c", ":Issued: 2024 Feb 28 2205 UTC\nnothing\n")]
    got = {r["source_file"]: r["status"] for r in kp_forecast(spark.createDataFrame(rows, "source_file string, text string"), "source_file").collect()}
    assert got == {"a": "no issue line", "b": "no issue line", "c": "no header"}


def test_bound_values_and_months(spark):
    t = spark.createDataFrame([(dt.date(2024, 1, d), d) for d in range(1, 10)], "date date, v int")
    got = files.sql_frame(spark, "select date, v from {t} where date >= :first and date < :end and :note <> ''", {"t": t}, first=dt.date(2024, 1, 3), end=dt.date(2024, 1, 5), note="' or 1=1 --")
    assert [r["v"] for r in got.orderBy("v").collect()] == [3, 4]
    got = files.months(spark, "2023-11-20", "2024-02-01").collect()
    assert [r["month"].month for r in got] == [11, 12, 1, 2] and got[-1]["end"] == dt.date(2024, 2, 29)
    with pytest.raises(Exception):
        files.sql_frame(spark, "select * from {t} where v = :missing", {"t": t}).collect()


def test_reports_of_days_with_many_rows(spark, tmp_path):
    """Days of 1,200 and 99,900 orders: numbers of more than three digits stand in the reports whole."""
    v = spark.createDataFrame([(5.9,), (0.0,), (999.9,), (1000.0,), (123456.7,), (None,)], "v double")
    assert [r[0] for r in v.select(three(F.col("v"))).collect()] == ["005", "000", "999", "1000", "123456", "NA"]
    days = [(dt.date(1998, 5, 1), 1200), (dt.date(1998, 5, 3), 99_900)]
    orders = [spark.range(n).select(F.lit(d).cast("timestamp_ntz").alias("o_orderdate"), (F.col("id") * 0 + 19_950_000.0).alias("o_totalprice")) for d, n in days]
    orders[0].unionByName(orders[1]).write.parquet(str(tmp_path / "orders.parquet"))
    want = {days[0][0]: (1290.0, 2000.0), days[1][0]: (99_990.0, 2000.0)}
    rows = q_rsga_parse(spark, str(tmp_path)).collect()
    assert len(rows) == 3 * 2 * 5
    for r in rows:
        afr, ap = want.get(r["target_date"], (None, None))
        early = r["lead"] == 0 and r["issue_time"] == "0100" and ap is not None
        assert (r["afr"], r["ap"]) == (afr, ap + 1 if early else ap)
    assert {(r["target_date"], r["afr"]) for r in q_rsga_leadk(spark, str(tmp_path)).collect() if r["afr"]} == {(days[1][0], 99_990.0)}
    assert sum(r["afr"] == 1290.0 for r in q_latest_issuance(spark, str(tmp_path)).collect()) == 2
