"""Grids, fills, windows, splits, reference forecasts against plain loops over random series, and no look ahead."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from quietday.functions.columns import mask_fill
from quietday.operators.grids import feature_windows, fill_grid, forward_fill, make_windows, run_complete, split_ranges, split_years
from quietday.plans.features import daily_index
from quietday.plans.samples import baselines

START = dt.date(2021, 3, 14)


def day(i):
    return START + dt.timedelta(days=i)


def series(spark, values):
    return spark.createDataFrame([(day(i), None if v is None else float(v)) for i, v in enumerate(values)], "date date, ap double").repartition(3)


def holed(seed, n, share):
    rng = random.Random(seed)
    return [None if rng.random() < share else round(rng.uniform(0, 90), 1) for _ in range(n)]


def test_daily_index_equals_a_loop(spark):
    """Two days of odd hours, one without any, one whose flux is a fill value."""
    rng = random.Random(8)
    rows, want = [], {}
    for d, hours in ((0, range(0, 24, 2)), (2, range(5, 9)), (3, range(24))):
        ap, dst = [], []
        for h in hours:
            v, low = float(rng.randrange(400)), -float(rng.randrange(90))
            ap.append(v)
            dst.append(low)
            rows.append((dt.datetime.combine(day(d), dt.time(h)), v, 30.0, 888.8 if d == 2 else 140.0 + d, 20.0, low))
        want[day(d)] = (len(ap), sum(ap) / len(ap), min(dst), None if d == 2 else 140.0 + d)
    h = spark.createDataFrame(rows, "datetime timestamp_ntz, ap_index_nt double, kp_index double, f10_7_index_sfu double, sunspot_number_r double, dst_index_nt double")
    got = {r["date"]: r for r in daily_index(h.withColumn("f10_7_index_sfu", mask_fill(F.col("f10_7_index_sfu"), 888.8))).collect()}
    assert sorted(got) == [day(i) for i in range(4)] and got[day(1)]["ap"] is None and got[day(1)]["n_ap_hours"] == 0
    for d, (n, ap, dst, f107) in want.items():
        r = got[d]
        assert (r["n_ap_hours"], r["dst"], r["f107"], r["kp"]) == (n, dst, f107, 3.0) and r["ap"] == pytest.approx(ap)


def test_grid_of_several_series(spark):
    rows = [("a", day(0), 1.0), ("a", day(3), 2.0), ("b", day(1), 3.0)]
    g = fill_grid(spark.createDataFrame(rows, "s string, date date, v double"), "date", "1 day", ["s"])
    assert g.groupBy("s").count().orderBy("s").collect() == [("a", 4), ("b", 1)]
    assert fill_grid(spark.createDataFrame([], "s string, date date, v double"), "date", "1 day", ["s"]).count() == 0


@pytest.mark.parametrize("limit", [1, 2, 6])
def test_forward_fill_equals_a_loop(spark, limit):
    values = holed(limit, 80, 0.6)
    want, age, last = [], 0, None
    for v in values:
        age, last = (0, v) if v is not None else (age + 1, last)
        want.append(last if age <= limit else None)
    assert [r["ap"] for r in forward_fill(series(spark, values), ["ap"], limit, "date").orderBy("date").collect()] == want


@pytest.mark.parametrize(("history", "ahead", "stride"), [(6, 4, 1), (1, 1, 1), (13, 9, 3)])
def test_windows_equal_slices(spark, history, ahead, stride):
    values = holed(history, 90, 0.04)
    want = {}
    for i in range(history - 1, len(values) - ahead):
        x, y = values[i - history + 1 : i + 1], values[i + 1 : i + 1 + ahead]
        if None not in x + y:
            want[day(i)] = (x, y)
    got = {r["date"]: (r["x"], r["y"]) for r in make_windows(series(spark, values), "ap", history, ahead, "date", stride=stride).collect()}
    assert got and all(want[d] == v for d, v in got.items())
    if stride == 1:
        assert got.keys() == want.keys()
    else:
        assert len(got) < len(want) / 2


def test_feature_windows_equal_slices(spark):
    values = holed(21, 60, 0.08)
    s = series(spark, values).withColumn("half", F.col("ap") / 2)
    got = {r["date"]: ([tuple(v) for v in r["x"]], r["y"]) for r in feature_windows(s, ["ap", "half"], "ap", 4, "date").collect()}
    want = {}
    for i in range(3, len(values) - 1):
        x = values[i - 3 : i + 1]
        if None not in x and values[i + 1] is not None:
            want[day(i)] = ([(v, v / 2) for v in x], values[i + 1])
    assert got == want and len(want) > 10


def test_runs_and_splits(spark):
    values = holed(5, 50, 0.3)
    got = [r[0] for r in series(spark, values).orderBy("date").select(run_complete(F.col("ap").isNotNull(), 3, "date")).collect()]
    assert got == [i >= 2 and None not in values[i - 2 : i + 1] for i in range(len(values))]
    days = series(spark, range(700))
    ends = {"fit": (day(10), day(299)), "check": (day(300), day(300)), "rest": (day(302), day(650))}
    counts = dict(days.groupBy(split_ranges(F.col("date"), {k: (str(a), str(b)) for k, (a, b) in ends.items()}).alias("s")).count().collect())
    assert {k: counts[k] for k in ends} == {"fit": 290, "check": 1, "rest": 349}
    years = dict(days.groupBy(split_years(F.col("date"), [2022], [2023]).alias("s")).count().collect())
    in_year = lambda y: sum(day(i).year == y for i in range(700))
    assert years == {"test": in_year(2022), "val": in_year(2023), "train": in_year(2021)}


def test_recurrence_repeats_a_rotation_and_never_looks_ahead(spark):
    rng = random.Random(11)
    rotation = [round(rng.uniform(2, 60), 2) for _ in range(27)]
    values = [rotation[i % 27] for i in range(240)]
    leads = (1, 5, 27, 28, 54, 59)
    b = baselines(series(spark, values), leads).where("y is not null and recurrence27 is not null and recurrence2x27 is not null").cache()
    assert b.count() > 500 and b.where("abs(y - recurrence27) > 1e-9 or abs(y - recurrence2x27) > 1e-9").count() == 0
    cut = 170
    later = values[:cut] + [5000.0] * (240 - cut)
    seen = baselines(series(spark, later), leads, str(day(60))).where(F.col("date") < F.lit(day(cut)))
    assert seen.where("recurrence27 >= 5000 or recurrence2x27 >= 5000 or persistence >= 5000 or climatology >= 5000").count() == 0
    assert seen.where("y >= 5000").count() > 0
