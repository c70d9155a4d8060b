"""Closed-form linear models: Spark sums the Gram matrices, the driver solves the small systems."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from collections.abc import Iterator
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass
class Ridge:
    weights: np.ndarray
    intercept: np.ndarray


def gram(samples: DataFrame, x: str = "x", y: str = "y") -> tuple[float, np.ndarray]:
    """Rows and the sums of z z^T for z = (x, y), summed in each partition and then by position."""

    def part(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total, n = None, 0
        for b in batches:
            if len(b):
                z = np.concatenate([np.stack(b[x].map(np.asarray)), np.stack(b[y].map(np.atleast_1d)), np.ones((len(b), 1))], 1).astype(float)
                total = z.T @ z if total is None else total + z.T @ z
                n += len(b)
        if total is not None:
            yield pd.DataFrame({"pos": np.arange(total.size), "v": total.ravel()})

    parts = samples.select(x, y).mapInPandas(part, "pos long, v double")
    sums = parts.groupBy("pos").agg(F.sum("v").alias("v")).toPandas().sort_values("pos")["v"].to_numpy()
    k = int(round(len(sums) ** 0.5))
    g = sums.reshape(k, k)
    return float(g[-1, -1]) if k else 0.0, g


def ridge_from_gram(g: np.ndarray, inputs: int, alpha: float) -> Ridge:
    """Centred ridge with an unpenalised intercept, for any number of outputs."""
    n, s = g[-1, -1], g[-1, :-1]
    centred = g[:-1, :-1] - np.outer(s, s) / n
    w = np.linalg.solve(centred[:inputs, :inputs] + alpha * np.eye(inputs), centred[:inputs, inputs:])
    return Ridge(w, s[inputs:] / n - (s[:inputs] / n) @ w)


def linear_predict(x: Column, model: Ridge) -> Column:
    """The prediction (one output) inside the JVM."""
    w = F.array(*[F.lit(float(v)) for v in model.weights[:, 0]])
    return F.aggregate(F.zip_with(x, w, lambda a, b: a.cast("double") * b), F.lit(float(model.intercept[0])), lambda s, v: s + v)


def principal_axes(g: np.ndarray, inputs: int, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Mean and the k leading axes of x (a column each), each with its largest entry positive."""
    n, s = g[-1, -1], g[-1, :inputs]
    cov = g[:inputs, :inputs] / n - np.outer(s / n, s / n)
    values, vectors = np.linalg.eigh(cov)
    axes = vectors[:, np.argsort(-values)[:k]]
    return s / n, axes * np.sign(axes[np.abs(axes).argmax(0), np.arange(k)])


def standardised_ridge(g: np.ndarray, inputs: int, alpha: float) -> Ridge:
    """Ridge on inputs brought to mean 0 and deviation 1, as weights of the inputs as they are."""
    n, s = g[-1, -1], g[-1, :inputs]
    sd = np.sqrt(np.maximum(np.diag(g)[:inputs] / n - (s / n) ** 2, 0)) + 1e-8
    scaled = g / np.outer(np.append(sd, np.ones(len(g) - inputs)), np.append(sd, np.ones(len(g) - inputs)))
    m = ridge_from_gram(scaled, inputs, alpha)
    return Ridge(m.weights / sd[:, None], m.intercept)


def project(x: Column, mean: np.ndarray, axes: np.ndarray) -> Column:
    """The scores of x on the axes (a column each), in Arrow batches."""

    @F.pandas_udf("array<double>")
    def scores(v: pd.Series) -> pd.Series:
        return pd.Series(list((np.stack(v) - mean) @ axes)) if len(v) else pd.Series([], dtype=object)

    return scores(x)


def mapped_gram(g: np.ndarray, inputs: int, maps: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """The Gram matrix of (x @ maps - offsets, outputs, 1) from that of (x, outputs, 1): no second pass over rows."""
    f, rest = maps.shape[1], len(g) - inputs
    m = np.zeros((len(g), f + rest))
    m[:inputs, :f], m[inputs:, f:] = maps, np.eye(rest)
    m[-1, :f] = -offsets
    return m.T @ g @ m


def absolute_errors(rows: DataFrame, by: str, weights: np.ndarray, intercepts: np.ndarray, x: str = "x", y: str = "y") -> DataFrame:
    """`by`, model (the column of `weights`), n and the sum of absolute errors of many linear models, in one pass."""

    def part(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for key, own in b.groupby(by):
                off = np.abs(np.stack(own[x]) @ weights + intercepts - own[y].to_numpy()[:, None]).sum(0)
                yield pd.DataFrame({by: key, "model": np.arange(len(off)), "n": len(own), "error": off})

    sums = rows.select(by, x, y).mapInPandas(part, f"{by} string, model int, n long, error double")
    return sums.groupBy(by, "model").agg(F.sum("n").alias("n"), F.sum("error").alias("error"))
