"""What Spark SQL lacks: the normal distribution, mixtures of normals and their scores, as Arrow-batched functions."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T

_erf = np.vectorize(math.erf, otypes=[float])
_erfc = np.vectorize(math.erfc, otypes=[float])


@F.pandas_udf(T.DoubleType())
def normal_cdf(z: pd.Series) -> pd.Series:
    return pd.Series(0.5 * (1 + _erf(z.to_numpy(float) / math.sqrt(2)))).where(z.notna().to_numpy())


def crps_columns(samples: str, y: str):
    """Sample CRPS and the central 68 and 95 % cover flags, as a struct, from sorted samples (JVM only)."""
    s = F.array_sort(samples)
    n = F.size(s)
    near = F.aggregate(s, F.lit(0.0), lambda acc, x: acc + F.abs(x - F.col(y))) / n
    weighted = F.aggregate(
        F.transform(s, lambda x, i: x * (2 * (i + 1) - n - 1) / (n * n).cast("double")), F.lit(0.0), lambda acc, x: acc + x
    )

    def quantile(q: float):
        at = (n - 1) * F.lit(q)
        low = F.floor(at).cast("int")
        a, b = F.get(s, low), F.get(s, F.least(low + 1, n - 1))
        return a + (b - a) * (at - low)

    return F.struct(
        (near - weighted).alias("crps"),
        F.col(y).between(quantile(0.16), quantile(0.84)).alias("in68"),
        F.col(y).between(quantile(0.025), quantile(0.975)).alias("in95"),
    )


def _phi(z: np.ndarray) -> np.ndarray:
    """The normal distribution function, exact in both tails."""
    return 0.5 * _erfc(-z / math.sqrt(2))


def _density(z: np.ndarray) -> np.ndarray:
    return np.exp(-0.5 * z * z) / math.sqrt(2 * math.pi)


def _standard(x: np.ndarray, mu: np.ndarray, sigma: np.ndarray) -> np.ndarray:
    """(x - mu) / sigma; a component of deviation zero is a step at mu."""
    with np.errstate(divide="ignore", invalid="ignore"):
        return np.where(sigma > 0, (x - mu) / np.where(sigma > 0, sigma, 1), np.where(x >= mu, np.inf, -np.inf))


def mixture_cdf(x: np.ndarray, mu: np.ndarray, sigma: np.ndarray, weight: np.ndarray) -> np.ndarray:
    """F(x) of normal mixtures; mu, sigma and weight are (components, rows), x is (rows)."""
    return (weight * _phi(_standard(x, mu, sigma))).sum(0)


def mixture_quantile(p: float, mu: np.ndarray, sigma: np.ndarray, weight: np.ndarray) -> np.ndarray:
    """Where the mixtures' distribution functions reach p: Newton steps kept inside a bracket, halved where a step leaves it."""
    used = weight > 0
    far = 9.0 * sigma  # F is 0 or 1 to double precision there
    low = np.where(used, mu - far, np.inf).min(0)
    high = np.where(used, mu + far, -np.inf).max(0)
    none = ~used.any(0)
    low, high = np.where(none, 0, low), np.where(none, 0, high)
    x = 0.5 * (low + high)
    for _ in range(200):
        f = mixture_cdf(x, mu, sigma, weight) - p
        low, high = np.where(f < 0, x, low), np.where(f < 0, high, x)
        with np.errstate(divide="ignore", invalid="ignore", over="ignore"):
            slope = np.where(sigma > 0, weight * _density(_standard(x, mu, sigma)) / np.where(sigma > 0, sigma, 1), 0).sum(0)
            step = x - f / slope
        inside = (step > low) & (step < high)
        new = np.where(inside, step, 0.5 * (low + high))
        if (np.abs(new - x) <= 1e-13 * np.maximum(1, np.abs(x))).all():
            return new
        x = new
    return x


def _mean_above(a: np.ndarray, b: np.ndarray, s: np.ndarray, t: np.ndarray) -> np.ndarray:
    """E max(exp A, exp B) of independent normal A (mean a, deviation s) and B (b, t)."""
    both = np.hypot(s, t)
    with np.errstate(divide="ignore", invalid="ignore"):
        one = np.where(both > 0, _phi(np.where(both > 0, (a - b + s * s) / np.where(both > 0, both, 1), 0)), np.where(a > b, 1.0, np.where(a < b, 0.0, 0.5)))
        two = np.where(both > 0, _phi(np.where(both > 0, (b - a + t * t) / np.where(both > 0, both, 1), 0)), np.where(b > a, 1.0, np.where(b < a, 0.0, 0.5)))
    return np.exp(a + s * s / 2) * one + np.exp(b + t * t / 2) * two


def normal_crps(y: np.ndarray, mu: np.ndarray, sigma: np.ndarray, weight: np.ndarray) -> np.ndarray:
    """E|X - y| - E|X - X'| / 2 of normal mixtures, in closed form for pairs of components."""

    def distance(gap: np.ndarray, deviation: np.ndarray) -> np.ndarray:
        z = _standard(gap, np.zeros_like(gap), deviation)
        near = np.where(np.isfinite(z), z, 0)
        return np.where(deviation > 0, gap * (2 * _phi(near) - 1) + 2 * deviation * _density(near), np.abs(gap))

    near = (weight * distance(y - mu, sigma)).sum(0)
    k = len(mu)
    apart = sum(weight[i] * weight[j] * distance(mu[i] - mu[j], np.hypot(sigma[i], sigma[j])) for i in range(k) for j in range(k))
    return near - apart / 2


def lognormal_crps(y: np.ndarray, mu: np.ndarray, sigma: np.ndarray, weight: np.ndarray) -> np.ndarray:
    """The same for expm1 of normal mixtures; y is on the scale of expm1. A shift changes no distance, so components are lognormal and y is y + 1."""
    t = y + 1
    with np.errstate(divide="ignore"):
        z = _standard(np.log(t), mu, sigma)
    m = np.exp(mu + sigma * sigma / 2)
    near = (weight * (t * (2 * _phi(z) - 1) + m * (1 - 2 * _phi(z - sigma)))).sum(0)
    k = len(mu)
    apart = sum(weight[i] * weight[j] * (2 * _mean_above(mu[i], mu[j], sigma[i], sigma[j]) - m[i] - m[j]) for i in range(k) for j in range(k))
    return near - apart / 2


def _components(mus: pd.Series, sigmas: pd.Series) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(components, rows) of mu, sigma and weight; components of which a number is missing have no weight."""
    rows, most = len(mus), max([1, *(0 if m is None else len(m) for m in mus)])
    mu, sigma = np.full((most, rows), np.nan), np.full((most, rows), np.nan)
    for r, (m, s) in enumerate(zip(mus, sigmas, strict=True)):
        if m is not None and s is not None and len(m) == len(s):
            mu[: len(m), r], sigma[: len(s), r] = m, s
    good = np.isfinite(mu) & np.isfinite(sigma) & (sigma >= 0)
    n = good.sum(0)
    return np.where(good, mu, 0), np.where(good, sigma, 0), good / np.where(n, n, 1)


SCORES = T.StructType([T.StructField("crps", T.DoubleType()), T.StructField("q", T.ArrayType(T.DoubleType()))])


def mixture(mus: str, sigmas: str, y: str, probabilities: tuple[float, ...], log1p: bool = True):
    """struct(crps, q) of equally weighted normal mixtures, given as arrays of means and deviations: the exact CRPS of y, and the quantiles at `probabilities`.

    With `log1p` the mixture is of log1p of the quantity, and y, crps and quantiles are of the quantity itself. Components with a null,
    non-finite or negative number are left out; a deviation of zero is a point. A row without components has nulls, one without
    y (or a y below -1 under `log1p`) a null crps. Numbers of components may differ between rows.
    """

    @F.pandas_udf(SCORES)
    def scores(m: pd.Series, s: pd.Series, values: pd.Series) -> pd.DataFrame:
        mu, sigma, weight = _components(m, s)
        seen = values.to_numpy(float)
        some = weight.sum(0) > 0
        known = some & np.isfinite(seen) & ((seen >= -1) | (not log1p))
        crps = (lognormal_crps if log1p else normal_crps)(np.where(known, seen, 0), mu, sigma, weight)
        q = np.stack([mixture_quantile(p, mu, sigma, weight) for p in probabilities]) if probabilities else np.zeros((0, len(m)))
        q = np.expm1(q) if log1p else q
        return pd.DataFrame({"crps": pd.Series(crps).where(known), "q": [list(q[:, i]) if some[i] else None for i in range(len(m))]})

    return scores(F.col(mus), F.col(sigmas), F.col(y).cast("double"))


PERIOD = T.StructType([T.StructField("period", T.IntegerType()), T.StructField("amplitude", T.DoubleType())])


@F.pandas_udf(T.ArrayType(PERIOD))
def strongest_periods(values: pd.Series) -> pd.Series:
    """The periods (length over frequency) of the three strongest non-constant Fourier components of each array, strongest first."""
    rows = []
    for v in values:
        x = np.asarray(v, float)
        a = np.abs(np.fft.rfft(x))
        top = np.argsort(-np.round(a[1:], 9), kind="stable")[:3] + 1
        rows.append([{"period": int(len(x) // k), "amplitude": float(a[k])} for k in top])
    return pd.Series(rows)
