"""Queries whose SQL is missing or roundabout, against NumPy on the same table."""

import datetime as dt
import math

import duckdb
import numpy as np
import pytest

from quietday.plans import models
from quietday.queries import QUERIES
from quietday.sources import adapters as A


@pytest.fixture(scope="module")
def series(sf):
    """Dates and values of the daily series."""
    rows = duckdb.sql(f"WITH orders AS (SELECT * FROM '{sf}/orders.parquet'), {A.DAILY} SELECT date, ap FROM daily ORDER BY date").fetchall()
    return [d for d, _ in rows], np.array([math.nan if v is None else v for _, v in rows])


@pytest.fixture(scope="module")
def embedded(sf):
    e = dict(duckdb.sql(f"SELECT vec_id, embedding FROM '{sf}/embeddings.parquet'").fetchall())
    return {dt.date(1995, 1, 1) + dt.timedelta(days=3 * k): np.array(v, float) for k, v in e.items()}


def lagged(series, history=5):
    """Issue dates, the values up to each and the next one."""
    dates, ap = series
    at = [i for i in range(history - 1, len(ap) - 1) if not np.isnan(ap[i - history + 1 : i + 2]).any()]
    return [dates[i] for i in at], np.array([ap[i - history + 1 : i + 1] for i in at]), np.array([ap[i + 1] for i in at])


def ridge(x, y, alpha):
    w = np.linalg.solve((x - x.mean(0)).T @ (x - x.mean(0)) + alpha * np.eye(x.shape[1]), (x - x.mean(0)).T @ (y - y.mean()))
    return lambda z: z @ w + y.mean() - x.mean(0) @ w


def test_ridge(spark, sf, series):
    days, x, y = lagged(series)
    train = np.array([d <= dt.date(1998, 12, 31) for d in days])
    p = ridge(x[train], y[train], 10.0)(x[~train])
    got = {r["date"]: (r["y"], r["yhat"]) for r in QUERIES["q_ridge"](spark, sf).collect()}
    want = {d: (a, b) for d, a, b in zip(np.array(days)[~train], y[~train], p, strict=True)}
    assert got.keys() == want.keys() and all(got[d] == pytest.approx(want[d], abs=2e-6) for d in want)


def test_ridge_select(spark, sf, series):
    days, x, y = lagged(series)
    train, val = np.array([d.year <= 1998 for d in days]), np.array([d.year == 1999 for d in days])
    want = {a: np.abs(ridge(x[train], y[train], a)(x[val]) - y[val]).mean() for a in models.ALPHAS}
    rows = QUERIES["q_ridge_select"](spark, sf).collect()
    assert {r["alpha"]: r["mae"] for r in rows} == pytest.approx(want, abs=2e-6)
    lowest = min(r["mae"] for r in rows)
    assert [r["alpha"] for r in rows if r["best"]] == [min(r["alpha"] for r in rows if r["mae"] == lowest)]


def scores_of(x, train, k):
    mean = x[train].mean(0)
    _, _, axes = np.linalg.svd(x[train] - mean, full_matrices=False)
    axes = axes[:k].T
    return (x - mean) @ (axes * np.sign(axes[np.abs(axes).argmax(0), np.arange(axes.shape[1])]))


def test_pca(spark, sf, embedded):
    days = sorted(embedded)
    x, train = np.stack([embedded[d] for d in days]), np.array([d <= dt.date(1997, 12, 31) for d in days])
    got = {(r["date"], r["k"], r["component"]): r["score"] for r in QUERIES["q_pca"](spark, sf).collect()}
    want = scores_of(x, train, 64)
    assert len(got) == len(days) * (16 + 64)
    for n, d in enumerate(days):
        for k in (16, 64):
            assert [got[d, k, c] for c in range(k)] == pytest.approx(want[n, :k].tolist(), abs=2e-5)


def test_fusion_arms(spark, sf, series, embedded):
    dates, x, y = lagged(series)
    last = max(embedded)
    img7 = {d: np.mean([embedded[e] for k in range(7) if (e := d - dt.timedelta(days=k)) in embedded and d <= last], 0) for d in embedded}
    keep = [i for i, d in enumerate(dates) if d in embedded]
    days = [dates[i] for i in keep]
    turn = 2 * np.pi * np.array([d.timetuple().tm_yday for d in days]) / 365.25
    part = {"x": x[keep], "phase": np.stack([np.sin(turn), np.cos(turn)], 1), "img1": np.stack([embedded[d] for d in days]), "img7": np.stack([img7[d] for d in days])}
    target = np.log1p(y[keep])
    tr = np.array([d <= dt.date(1997, 12, 31) for d in days])
    va = np.array([dt.date(1998, 1, 1) <= d <= dt.date(1998, 6, 30) for d in days])
    te = ~tr & ~va
    got = {r["arm"]: r for r in QUERIES["q_fusion_arms"](spark, sf).collect()}
    assert got.keys() == models.ARMS.keys() and {r["n"] for r in got.values()} == {int(te.sum())}
    for arm, names in models.ARMS.items():
        best = None
        for k in (16, 64) if any(n.startswith("img") for n in names) else (0,):
            f = np.concatenate([scores_of(part[n], tr, k) if n.startswith("img") else part[n] for n in names], 1)
            f = (f - f[tr].mean(0)) / (f[tr].std(0) + 1e-8)
            for a in models.ALPHAS:
                p = ridge(f[tr], target[tr], a)(f)
                err = np.abs(p - target)
                if best is None or err[va].mean() < best[0] - 1e-12:
                    best = (err[va].mean(), k, a, err[te].mean())
        r = got[arm]
        assert (r["k"], r["alpha"]) == best[1:3] and [r["mae_val"], r["mae_test"]] == pytest.approx([best[0], best[3]], abs=2e-6)


def test_strongest_periods(spark, sf, series):
    dates, ap = series
    want = {}
    for i in range(63, len(ap)):
        if not np.isnan(ap[i - 63 : i + 1]).any():
            a = np.abs(np.fft.rfft(ap[i - 63 : i + 1]))
            top = sorted(range(1, len(a)), key=lambda k: (-round(a[k], 9), k))[:3]
            want[dates[i]] = [(64 // k, a[k]) for k in top]
    got = {}
    for r in QUERIES["q_fft_period"](spark, sf).orderBy("date", "place").collect():
        got.setdefault(r["date"], []).append((r["period"], r["amplitude"]))
    assert got.keys() == want.keys()
    assert all([p for p, _ in got[d]] == [p for p, _ in want[d]] and [x for _, x in got[d]] == pytest.approx([x for _, x in want[d]], abs=2e-6) for d in want)


def test_exceedance(spark, sf):
    rows = duckdb.sql(f"WITH events AS (SELECT * FROM '{sf}/events.parquet'), {A.FORECAST} SELECT issue_date, lead_step_3h, mu, sigma FROM fc3").fetchall()
    want = {}
    for d, step, mu, sigma in rows:
        want.setdefault((d, step), []).append(1 - 0.5 * (1 + math.erf((math.log1p(48.0) - mu) / sigma / math.sqrt(2))))
    got = {(r["issue_date"], r["lead_step_3h"]): r["p48"] for r in QUERIES["q_exceedance"](spark, sf).collect()}
    assert got == pytest.approx({k: np.mean(v) for k, v in want.items()}, abs=2e-6)


def test_pick_cases(spark, sf, series):
    """The plain greedy choice over all candidates."""
    dates, ap = series
    cases = []
    for i, d in enumerate(dates):
        ahead = [(ap[j], -(dates[j].toordinal()), dates[j]) for j in range(i + 1, min(i + 61, len(ap))) if not np.isnan(ap[j])]
        if d.weekday() == 0 and len(ahead) >= 55:
            peak, _, when = max(ahead, key=lambda t: (t[0], t[1]))
            lead = (when - d).days
            kind = 4 if peak < 35 else 1 if lead <= 7 else 2 if lead <= 26 else 3
            cases.append((kind, peak if kind == 4 else -peak, d, when))
    used, want = [], []
    for kind in (1, 2, 3, 4):
        for _, _, d, when in sorted(c for c in cases if c[0] == kind):
            if all(abs((when - u).days) > 5 for u in used):
                used.append(when)
                want.append((kind, d, when))
                break
    assert sorted((r["kind"], r["date"], r["peak_date"]) for r in QUERIES["q_pick_cases"](spark, sf).collect()) == want
