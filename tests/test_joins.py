"""Nearest, backward and band joins; merges; array operations."""

import datetime as dt
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from quietday.functions import arrays as X
from quietday.operators.folds import merge_events
from quietday.operators.quantiles import exact_quantile
from quietday.plans.models import stack7
from quietday.operators.joins import flag_days, latest_before, nearest, nearest_by_day, with_predecessor

T = lambda h, m=0, s=0, d=1: dt.datetime(2024, 1, d, h, m, s)


def frames(spark, times):
    return spark.createDataFrame([("a", t, str(i)) for i, t in enumerate(times)], "source string, datetime timestamp_ntz, file_path string")


def targets(spark, times):
    return spark.createDataFrame([("a", t) for t in times], "source string, slot_time timestamp_ntz")


def near(spark, times, frame_times, minutes):
    n = nearest(targets(spark, times), frames(spark, frame_times), "slot_time", "datetime", minutes * 60, ["source"], "file_path")
    return [(r["datetime"], r["offset_min"]) for r in n.orderBy("slot_time").collect()]


def test_nearest_side_sign_and_tolerance(spark):
    assert near(spark, [T(6), T(12)], [T(5), T(6, 30), T(13)], 180) == [(T(6, 30), 30.0), (T(13), 60.0)]
    around = [T(18, d=1), T(4, d=2), T(0, d=3)]
    assert near(spark, around, [T(0, d=2)], 180) == [(None, None)] * 3
    assert near(spark, around, [T(0, d=2)], 360) == [(T(0, d=2), 360.0), (T(0, d=2), -240.0), (None, None)]
    assert near(spark, [T(6)], [T(5, 30), T(6, 30)], 60) == [(T(5, 30), -30.0)]  # a tie: the earlier


def test_nearest_matches_a_plain_search(spark):
    rng = np.random.default_rng(0)
    ft = sorted(dt.datetime(2024, 1, 1) + dt.timedelta(seconds=int(s)) for s in rng.choice(86400 * 3, 150, replace=False))
    tt = [dt.datetime(2024, 1, 1) + dt.timedelta(hours=3 * i) for i in range(24)]
    got = near(spark, tt, ft, 20)
    for t, (f, off) in zip(tt, got, strict=True):
        best = min(ft, key=lambda x: (abs((x - t).total_seconds()), x))
        if abs((best - t).total_seconds()) <= 1200:
            assert f == best and off == pytest.approx((best - t).total_seconds() / 60)
        else:
            assert f is None


def test_predecessor_and_latest_before(spark):
    f = frames(spark, [T(0), T(0, 5), T(0, 30), T(2), T(2, 6)])
    assert sorted(r["file_path"] for r in with_predecessor(f, "datetime", 360, 1800, ["source"]).collect()) == ["2", "4"]
    p = latest_before(f, f, "datetime", "datetime", 360, 1800, ["source"], "file_path").orderBy("datetime").collect()
    assert [r["prev_path"] for r in p] == [None, None, "1", None, "3"]


def test_dense_frames_pass_once(spark):
    """Many frames within the tolerance of each target, also of one time, across cuts and sources: equal to a plain search, in rows that grow with both sides."""
    rng = random.Random(2)
    start = dt.datetime(2024, 1, 1)
    times = [start + dt.timedelta(seconds=rng.randrange(3 * 86_400), microseconds=rng.randrange(2) * 500_000) for _ in range(3000)]
    rows = [(rng.choice("ab"), t, f"f{rng.randrange(10_000):05d}") for t in times + times[:300]] + [(None, start, "x"), ("a", None, "y")]
    f = spark.createDataFrame(rows, "source string, datetime timestamp_ntz, file_path string").repartition(3)
    wanted = [(rng.choice("abc"), start + dt.timedelta(seconds=rng.randrange(-9000, 3 * 86_400 + 9000))) for _ in range(200)] + [("a", rows[0][1]), ("a", start + dt.timedelta(days=1)), (None, start), ("a", None)]
    t = spark.createDataFrame(wanted + wanted[:5], "source string, slot_time timestamp_ntz")
    for tolerance in (1, 60, 7200):
        got = nearest(t, f, "slot_time", "datetime", tolerance, ["source"], "file_path")
        plan = got._jdf.queryExecution().executedPlan().toString()
        assert "Join" not in plan and "Cartesian" not in plan
        for s, at, when, path, offset in got.collect():
            own = [(x, p) for k, x, p in rows if k is not None and k == s and x is not None] if at else []
            left, right = [x for x, _ in own if at and x < at], [x for x, _ in own if at and x >= at]
            gaps = [(int((at - x).total_seconds()), i, x) for i, x in enumerate([max(left, default=None), min(right, default=None)]) if x is not None and i == 0]
            gaps += [(int((min(right) - at).total_seconds()), 1, min(right))] if right else []
            gaps = sorted(g for g in gaps if g[0] <= tolerance)
            if not gaps:
                assert when is None and path is None and offset is None
            else:
                d, side, x = gaps[0]
                assert (when, path, offset) == (x, min(p for y, p in own if y == x), pytest.approx((d if side else -d) / 60))
        assert got.count() == len(wanted) + 5
    for low, high in ((0, 30), (360, 1800), (10, 200_000)):
        for s, at, when, path in latest_before(t, f, "slot_time", "datetime", low, high, ["source"], "file_path").collect():
            own = [(x, p) for k, x, p in rows if k is not None and k == s and x is not None and at and dt.timedelta(seconds=low) <= at - x <= dt.timedelta(seconds=high)]
            assert (when, path) == max(own, default=(None, None))


def test_band_of_three_days(spark):
    days = spark.sql("select explode(sequence(date'2020-01-04', date'2020-01-08')) as date")
    e = spark.createDataFrame([(dt.date(2020, 1, 5),), (dt.date(2020, 1, 5),)], "day date")
    assert [r["hit"] for r in flag_days(days, e, "day", 0, 2, "hit").orderBy("date").collect()] == [False, True, True, True, False]


def test_merge_counts_from_the_last_kept(spark):
    hours = [0, 30, 50, 90, 110]
    e = spark.createDataFrame([("x", i, dt.datetime(2024, 1, 1) + dt.timedelta(hours=h)) for i, h in enumerate(hours)], "k string, id long, t timestamp_ntz")
    assert sorted(r["id"] for r in merge_events(e, ["k"], "t", "id", 48 * 3600).collect()) == [0, 2, 4]


def test_arrays(spark):
    block = [[float(4 * i + j) for j in range(4)] for i in range(4)]
    df = spark.createDataFrame([(block, [1.0, 2.0, 3.0])], "b array<array<double>>, x array<double>")
    r = df.select(
        X.block_mean(F.col("b"), 2, 4, 4).alias("m"), X.flip_180(F.col("b")).alias("f"), X.pack_right(F.col("x"), 8).alias("p"), X.pack_mask(F.col("x"), 8).alias("k"),
        X.running_difference(F.get("b", 0), F.get("b", 0), 4.0).alias("d"), X.dot(F.col("x"), F.col("x")).alias("n"),
    ).first()
    assert r["m"][0][0] == np.mean([0, 1, 4, 5]) and r["f"][0][0] == 15.0 and r["n"] == 14.0
    assert r["p"] == [0] * 5 + [1, 2, 3] and r["k"] == [0] * 5 + [1] * 3 and r["d"] == [127] * 4
    with pytest.raises(Exception, match="longer"):
        df.select(X.pack_right(F.col("x"), 2)).collect()


def test_merge_of_dense_events_equals_the_fold(spark):
    """Many events within the gap, ties, and times exactly the gap apart."""
    rng = random.Random(3)
    rows = [(k, i, rng.choice([0, 48 * 3600, 96 * 3600, rng.randrange(20 * 86_400)])) for k in ("a", "b") for i in range(200)]
    df = spark.createDataFrame([(*r, 1) for r in rows], "k string, id int, s long, _t int").withColumn("t", F.timestamp_seconds("s"))
    want = []
    for k in ("a", "b"):
        last = None
        for s, i in sorted((s, i) for own, i, s in rows if own == k):
            if last is None or s - last > 48 * 3600:
                want.append((k, i))
                last = s
    assert sorted((r["k"], r["id"]) for r in merge_events(df.drop("_t"), ["k"], "t", "id", 48 * 3600).collect()) == sorted(want)


@pytest.mark.parametrize("n", [1, 2, 5, 20_000])
def test_exact_quantiles(spark, n):
    x = np.round(np.random.default_rng(n).normal(size=n), 2)
    df = spark.createDataFrame([(float(v),) for v in x] + [(None,)], "v double")
    for q in (0.0, 0.5, 0.999, 1.0):
        assert exact_quantile(df, "v", q, "m").first()["m"] == pytest.approx(np.quantile(x, q), abs=1e-12)
    assert exact_quantile(df.where("v is null"), "v", 0.5, "m").first()["m"] is None


@pytest.mark.parametrize("kind", ["normal", "ties", "two", "wide"])
def test_brackets_shrink_to_a_bound(spark, kind):
    """Small sketches and brackets force many rounds, on ties, on two values with a few between, and over hundreds of powers of ten."""
    rng = np.random.default_rng(3)
    n = 5000
    x = {"normal": rng.normal(size=n), "ties": rng.integers(0, 4, n).astype(float), "two": np.r_[np.zeros(2600), rng.uniform(0, 1, 30), np.ones(2370)], "wide": 10.0 ** rng.uniform(-300, 300, n)}[kind]
    df = spark.createDataFrame([(float(v),) for v in rng.permutation(x)] + [(None,)], "v double")
    for q in (0.0, 0.2, 0.521, 0.9, 0.9999, 1.0):
        r = exact_quantile(df, "v", q, "m", F.count(F.lit(1)).alias("n"), parts=20, ranked=40).first()
        assert r["m"] == pytest.approx(np.quantile(x, q), rel=1e-12) and r["n"] == n + 1


def test_nearest_cells_upward(spark):
    img = [[float(3 * i + j) for j in range(3)] for i in range(3)]
    got = spark.createDataFrame([(img,)], "b array<array<double>>").select(X.resize_to(F.col("b"), 5, 3).alias("u"), X.resize_to(F.col("b"), 3, 3).alias("s")).first()
    at = (np.arange(5) * 3 / 5).astype(int)
    assert got["u"] == np.array(img)[at][:, at].tolist() and got["s"] == img


def test_blocks_of_seven_days_copy_what_is_missing(spark):
    rows = [(dt.date(2024, 3, d), [float(d), 0.5]) for d in (1, 2, 7, 13)]
    got = {(r["date"].day, r["pos"]): (r["copied"], r["v"][0]) for r in stack7(spark.createDataFrame(rows, "date date, embedding array<double>"), 2).collect()}
    assert [got[7, k] for k in range(7)] == [(False, 1.0), (False, 2.0), (False, 2.0), (False, 2.0), (True, 7.0), (True, 7.0), (False, 7.0)]
    assert all(got[1, k] == (k < 6, 1.0) for k in range(7)) and len(got) == 28


def test_nearest_in_one_second_is_the_earliest(spark):
    """Frames whose distances are the same whole second: the earliest, before the target too, and of one time the smaller path."""
    at = T(6)
    ms = lambda *gaps: [at + dt.timedelta(milliseconds=g) for g in gaps]
    assert near(spark, [at], ms(-1900, -1200, -1100, 1000), 60) == [(ms(-1900)[0], pytest.approx(-1 / 60))]
    assert near(spark, [at], ms(-3000, -2999, -2001, -2000), 60) == [(ms(-2999)[0], pytest.approx(-2 / 60))]
    assert near(spark, [at], ms(-999, -1, 0), 60) == [(ms(-999)[0], 0.0)] and near(spark, [at], ms(-1000, 0, 1), 60) == [(at, 0.0)]
    assert near(spark, [at], ms(-1500, 200, 900), 60) == [(ms(200)[0], 0.0)]
    assert near(spark, [at], ms(-61_999, -61_001), 1) == [(None, None)] and near(spark, [at], ms(-60_999, -60_001), 1) == [(ms(-60_999)[0], -1.0)]
    rng = random.Random(5)
    times = [dt.datetime(2024, 1, 1) + dt.timedelta(microseconds=rng.randrange(2 * 86_400_000_000)) for _ in range(40)]
    dense = sorted(t + dt.timedelta(milliseconds=rng.randrange(-4000, 4000)) for t in times for _ in range(8))
    got = near(spark, sorted(times), dense, 3)
    for t, (frame, offset) in zip(sorted(times), got, strict=True):
        sec = lambda f: int((f - t).total_seconds())  # noqa: B023, E731
        want = min((f for f in dense if abs(sec(f)) <= 180), key=lambda f: (abs(sec(f)), f))
        assert frame == want and offset == pytest.approx(sec(want) / 60)


def test_nearest_by_day_equals_a_plain_search_without_pairs(spark):
    """Dense and missing days, ties before and after, repeated targets and times that are null; no rows for pairs."""
    rng = random.Random(7)
    start = dt.datetime(2024, 1, 1)
    when = lambda days: start + dt.timedelta(days=rng.choice(days), hours=rng.randrange(24), minutes=rng.choice([0, 30]))
    events = [(i, when([0, 3, 4, 5, 12, 16])) for i in rng.sample(range(1000), 150)] + [(2000, None)]
    shocks = [(i, when(range(-4, 20))) for i in range(200)] + [(7, start), (7, start), (8, None)]
    e = spark.createDataFrame(events, "event_id long, ts timestamp_ntz").repartition(3)
    for days in (1, 2):
        got = nearest_by_day(spark.createDataFrame(shocks, "shock_id long, ts timestamp_ntz"), e, "ts", "event_id", days, "near")
        plan = got._jdf.queryExecution().executedPlan().toString()
        assert "Join" not in plan and "Cartesian" not in plan
        near = lambda t: min(((abs(x - t), i) for i, x in events if t and x and abs((x.date() - t.date()).days) <= days), default=(None, None))[1]  # noqa: B023, E731
        assert sorted(map(str, ((r["shock_id"], r["ts"], r["near"]) for r in got.collect()))) == sorted(map(str, ((i, t, near(t)) for i, t in shocks)))
