"""Mixtures against closed forms, plain integration and root finding; weight matrices against literal draws."""

import hashlib
import math
import tracemalloc

import numpy as np
import pytest
from pyspark.sql import functions as F

from quietday.functions import distributions as D
from quietday.operators import bootstrap


def phi(z):
    return 0.5 * math.erfc(-z / math.sqrt(2))


def one(spark, rows, probabilities=(0.025, 0.5, 0.84), log1p=True):
    df = spark.createDataFrame(rows, "i int, m array<double>, s array<double>, y double")
    return {r["i"]: r["x"] for r in df.select("i", D.mixture("m", "s", "y", probabilities, log1p).alias("x")).collect()}


def test_one_normal_component_has_the_known_score(spark):
    rows = [(i, [mu], [s], y) for i, (mu, s, y) in enumerate([(0.0, 1.0, 0.0), (3.0, 0.5, 1.0), (-2.0, 4.0, 9.0), (1.0, 0.0, 4.0)])]
    got = one(spark, rows, log1p=False)
    for i, m, s, y in rows:
        mu, sd = m[0], s[0]
        z = (y - mu) / sd if sd else 0
        want = sd * (z * (2 * phi(z) - 1) + 2 * math.exp(-z * z / 2) / math.sqrt(2 * math.pi) - 1 / math.sqrt(math.pi)) if sd else abs(y - mu)
        assert got[i]["crps"] == pytest.approx(want, abs=1e-12)
        assert got[i]["q"][1] == pytest.approx(mu, abs=1e-9)
        assert got[i]["q"][0] == pytest.approx(mu - 1.959963984540054 * sd, abs=1e-9)
    assert got[0]["crps"] == pytest.approx(0.2336949772, abs=1e-9)


def integral(mu, sd, y, log1p):
    """The integral of (F - 1[x >= y])^2, by the midpoint rule on the scale of the normals."""
    low, high = min(m - 10 * s for m, s in zip(mu, sd, strict=True)), max(m + 10 * s for m, s in zip(mu, sd, strict=True))
    at = math.log1p(y) if log1p else y
    low, high = min(low, at), max(high, at)
    total = 0.0
    for a, b in ((low, at), (at, high)):
        n = 40_000
        x = a + (np.arange(n) + 0.5) * (b - a) / n
        f = np.mean([[0.5 * math.erfc(-(v - m) / s / math.sqrt(2)) for v in x] for m, s in zip(mu, sd, strict=True)], axis=0)
        total += (((f - (x >= at)) ** 2) * (np.exp(x) if log1p else 1)).sum() * (b - a) / n
    return total


@pytest.mark.parametrize("log1p", [True, False])
def test_mixtures_equal_the_integral(spark, log1p):
    rows = [(0, [1.0, 2.5, 0.3], [0.4, 0.2, 0.9], 6.0), (1, [2.0, 2.0, 2.0], [0.3, 0.3, 0.3], 0.0), (2, [0.5, 3.0], [0.1, 0.6], 48.0)]
    got = one(spark, rows, log1p=log1p)
    for i, mu, sd, y in rows:
        assert got[i]["crps"] == pytest.approx(integral(mu, sd, y, log1p), rel=1e-6, abs=1e-6)


def test_quantiles_are_roots(spark):
    rng = np.random.default_rng(0)
    rows = [(i, rng.normal(1, 2, k).tolist(), rng.uniform(0.01, 2, k).tolist(), 1.0) for i, k in enumerate([1, 2, 3, 3, 7, 20])]
    p = (0.001, 0.025, 0.16, 0.5, 0.84, 0.975)
    got = one(spark, rows, p, log1p=False)
    for i, mu, sd, _ in rows:
        for want, x in zip(p, got[i]["q"], strict=True):
            assert np.mean([phi((x - m) / s) for m, s in zip(mu, sd, strict=True)]) == pytest.approx(want, abs=1e-10)
        assert got[i]["q"] == sorted(got[i]["q"])


def test_odd_rows(spark):
    nan = float("nan")
    rows = [(0, None, None, 1.0), (1, [], [], 1.0), (2, [1.0, None, nan, 2.0], [0.5, 1.0, 1.0, -1.0], 1.0), (3, [1.0], [0.5], None), (4, [1.0], [0.5], -3.0), (5, [1.0, 2.0], [0.5], 1.0), (6, [1.0], [0.5], 1.0), (7, [1.0], [0.5], -1.0)]
    got = one(spark, rows)
    for i in (0, 1, 5):
        assert got[i]["crps"] is None and got[i]["q"] is None
    assert got[2]["crps"] == pytest.approx(got[6]["crps"]) and got[2]["q"] == pytest.approx(got[6]["q"])
    for i in (3, 4):
        assert got[i]["crps"] is None and got[i]["q"] == pytest.approx(got[6]["q"])
    assert got[7]["crps"] > 0
    assert one(spark, []) == {}


def test_weights_are_the_draws():
    w = bootstrap.draw_weights(3, 50, 7)
    for r in range(50):
        drawn = [int(hashlib.md5(f"3:{r}:{s}".encode()).hexdigest()[:8], 16) % 7 for s in range(7)]
        assert w[r].tolist() == [drawn.count(i) for i in range(7)]
    big = bootstrap.draw_weights(0, 400, 90)
    assert (big.sum(1) == 90).all()
    # drawn evenly: each block is met 400 times, give or take a few deviations
    assert abs(big.sum(0) - 400).max() < 5 * math.sqrt(400)


def test_undefined_resamples_do_not_count(spark):
    """One of three blocks has values for a key, so that most resamples hold some and others none."""
    rows = [("x", 1, 4.0, 2.0), ("x", 2, 0.0, 0.0), ("x", 3, None, 0.0), ("y", 1, 0.0, 0.0)]
    stats = spark.createDataFrame(rows, "k string, block int, v double, n double")
    got = {r["k"]: (r["mean_lo"], r["mean_hi"]) for r in bootstrap.resampled(stats, ["k"], ["v", "n"], ["mean"], 200, 0).collect()}
    assert got == {"x": (2.0, 2.0), "y": (None, None)}
    whole = bootstrap.resampled(stats, ["k"], ["v", "n"], ["mean"], 20, 0, whole=True).where("k = 'x'").first()["mean"]
    assert len(whole) == 20 and set(whole) <= {2.0, None}
    assert bootstrap.resampled(stats.limit(0), ["k"], ["v", "n"], ["mean"], 20, 0).count() == 0


def test_slices_give_the_same_intervals(spark):
    """Keys of different sizes, of which one lacks blocks for one of two values, in one slice and in several, with kept weights and without."""
    rng = np.random.default_rng(4)
    rows = [(k, i, float(rng.normal()), float(rng.normal()) if i % 3 else None) for k, n in (("a", 40), ("b", 7), ("c", 1)) for i in range(n)]
    df = spark.createDataFrame(rows, "k string, i int, u double, w double").repartition(3)
    of = lambda slices: {r["k"]: r.asDict() for r in bootstrap.bootstrap_means(df, ["u", "w"], F.col("i"), ["k"], 90, 0, slices).collect()}
    one, many = of(1), of(7)
    assert list(one) and one.keys() == many.keys() and list(one["a"]) == ["k", "u", "u_lo", "u_hi", "w", "w_lo", "w_hi"]
    for k in one:
        assert all(one[k][c] == many[k][c] or one[k][c] == pytest.approx(many[k][c], abs=2e-6) for c in one[k])
    for v in ("u", "w"):
        alone = {r["k"]: (r["mean"], r["lo"], r["hi"]) for r in bootstrap.bootstrap_mean(df, v, F.col("i"), ["k"], 90).collect()}
        assert alone == {k: (r[v], r[f"{v}_lo"], r[f"{v}_hi"]) for k, r in one.items()}
    assert one["c"]["w"] is None and one["c"]["w_lo"] is None
    assert bootstrap.bootstrap_means(df.limit(0), ["u"], F.col("i"), ["k"], 90, 0, 7).count() == 0


def test_weights_of_many_blocks_are_not_kept():
    """Memory grows with the blocks and not with blocks times resamples; the sums are those of the matrix."""
    n, values = 60_000, np.random.default_rng(1).normal(size=(60_000, 2))
    small = values[:500]
    tracemalloc.start()
    large, few = bootstrap._drawn_sums(0, 3, 23, [(n, np.arange(n), values), (500, np.arange(500), small)])
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 20 * n * 8 and large.shape == (20, 2)  # a matrix of the weights alone has as much; hashes as objects six times that
    assert few == pytest.approx(bootstrap.draw_weights(0, 23, 500)[3:] @ small)
