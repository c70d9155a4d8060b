"""Bootstrap from sufficient statistics of blocks, as matrix products.

Rows are reduced to sums per block once. Which block a resample draws for each of its places is a hash of seed,
resample and place, so draws need no state: any task makes them, and SQL makes the same ones. How often each resample draws each
block is a row of weights, made in the worker; its product with the statistics of a key's blocks gives the sums of a
resample, so resamples are never joined with blocks, and neither weights nor resampled rows are shuffled. A worker keeps the weights of few
blocks as a matrix; those of many are made for one resample at a time, in tasks of some resamples each.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quietday.functions.columns import r6
from quietday.session import cut, ship

STATS = ["n", "ea", "eb", "y", "a", "b", "yy", "aa", "bb", "ya", "yb"]


def block_statistics(pairs: DataFrame, date: str, y: str, a: str, b: str, keys: list[str] | None = None) -> DataFrame:
    """One row per key and month: the sums that MAE and correlation of both forecasts need."""
    Y, A, B = F.col(y), F.col(a), F.col(b)
    sums = {"n": F.lit(1), "ea": F.abs(Y - A), "eb": F.abs(Y - B), "y": Y, "a": A, "b": B, "yy": Y * Y, "aa": A * A, "bb": B * B, "ya": Y * A, "yb": Y * B}
    block = F.trunc(date, "month").alias("block")
    return pairs.groupBy(*(keys or []), block).agg(*[F.sum(v.cast("double")).alias(k) for k, v in sums.items()])


#: Numbers made at once, and cells of a matrix of weights that a worker keeps.
HASHES, KEPT = 65_536, 4_000_000


def _numbers(seed: int, resample: int, size: int) -> np.ndarray:
    """`size` 32-bit numbers: the head of the md5 of seed, resample and place."""
    begun = hashlib.md5(f"{seed}:{resample}:".encode())

    def head(place: int) -> bytes:
        h = begun.copy()
        h.update(b"%d" % place)
        return h.digest()[:4]

    parts = [b"".join([head(s) for s in range(at, min(at + HASHES, size))]) for at in range(0, size, HASHES)]
    return np.frombuffer(b"".join(parts), ">u4").astype(np.int64)


def _times_drawn(numbers: np.ndarray, size: int) -> np.ndarray:
    """How often one resample draws each of `size` blocks, whose number is that of its places too."""
    return np.bincount(numbers[:size] % size, minlength=size).astype(float)


@lru_cache(maxsize=8)
def draw_weights(seed: int, resamples: int, size: int) -> np.ndarray:
    """(resamples, size): how often each resample draws each of `size` blocks."""
    return np.stack([_times_drawn(_numbers(seed, r, size), size) for r in range(resamples)])


def _drawn_sums(seed: int, low: int, high: int, tables: list[tuple[int, np.ndarray, np.ndarray]]) -> list[np.ndarray]:
    """For each table (size, places of its blocks, their sums) the sums of the resamples from `low` up to `high`, one resample at a time; tables share its numbers."""
    out = [np.empty((high - low, values.shape[1])) for _, _, values in tables]
    longest = max(size for size, _, _ in tables)
    for r in range(low, high):
        numbers = _numbers(seed, r, longest)
        for sums, (size, at, values) in zip(out, tables, strict=True):
            sums[r - low] = _times_drawn(numbers, size)[at] @ values
    return out


def _cc_of(s: dict[str, np.ndarray], x: str) -> np.ndarray:
    spread = (s["n"] * s["yy"] - s["y"] * s["y"]) * (s["n"] * s[x + x] - s[x] * s[x])
    with np.errstate(divide="ignore", invalid="ignore"):
        return np.where(spread > 0, (s["n"] * s[f"y{x}"] - s["y"] * s[x]) / np.sqrt(np.where(spread > 0, spread, 1)), np.nan)


def _over_n(top: Callable[[dict[str, np.ndarray]], np.ndarray]) -> Callable[[dict[str, np.ndarray]], np.ndarray]:
    return lambda s: np.where(s["n"] > 0, top(s) / np.where(s["n"] > 0, s["n"], 1), np.nan)


#: What a resample's sums are turned into, NaN where it isn't defined.
STATISTICS: dict[str, Callable[[dict[str, np.ndarray]], np.ndarray]] = {
    "d_mae": _over_n(lambda s: s["ea"] - s["eb"]),
    "d_corr": lambda s: _cc_of(s, "a") - _cc_of(s, "b"),
    "mean": _over_n(lambda s: s["v"]),
}


def _statistic(name: str) -> Callable[[dict[str, np.ndarray]], np.ndarray]:
    """By name; `mean_` and the name of a value is the mean of that value, of several."""
    if name in STATISTICS:
        return STATISTICS[name]
    of = name.removeprefix("mean_")
    return lambda s: STATISTICS["mean"]({"v": s[f"v_{of}"], "n": s[f"n_{of}"]})


def resampled(stats: DataFrame, keys: list[str], sums: list[str], statistics: list[str], resamples: int, seed: int, number_by: list[str] | None = None, whole: bool = False, slices: int = 1) -> DataFrame:
    """keys and, for each statistic, the central 95 % of its resamples ({name}_lo, {name}_hi), or with `whole` all of them as an array.

    Blocks are numbered for each key by itself, or for `number_by` (then keys share draws, and a key without a drawn block gets nothing for it).
    One key's blocks come together as one row of a few numbers for each. Where they are bounded by the calendar (months or days of one comparison), one
    slice will do; where there are more with more data, `slices` cuts the resamples into as many tasks, each of which draws one resample
    at a time, for all keys. Resamples for which a statistic isn't defined don't count in its interval, which is null if there are none.
    """
    ship(stats.sparkSession)
    by = keys if number_by is None else number_by
    blocks = stats.select(*by, "block").distinct() if number_by is not None else stats.select(*by, "block")
    own = Window.partitionBy(*by)
    numbered = blocks.select(*by, "block", (F.row_number().over(own.orderBy("block")) - 1).alias("i"), F.count(F.lit(1)).over(own).cast("int").alias("size"))
    rows = stats.join(numbered, [*by, "block"])
    gathered = rows.groupBy(*keys, "size").agg(F.collect_list("i").alias("i"), *[F.collect_list(F.coalesce(F.col(c).cast("double"), F.lit(0.0))).alias(c) for c in sums])
    fields = [T.StructField(n, T.ArrayType(T.DoubleType())) for n in statistics] if whole else [T.StructField(f"{n}_{end}", T.DoubleType()) for n in statistics for end in ("lo", "hi")]

    @F.pandas_udf(T.ArrayType(T.DoubleType()))
    def draw(piece: pd.Series, size: pd.Series, places: pd.Series, *columns: pd.Series) -> pd.Series:
        """The sums of each resample of a slice, one resample after the other."""
        out, large = [None] * len(size), {}
        for row, (k, n, at, *values) in enumerate(zip(piece, size, places, *columns, strict=True)):
            # in order of the blocks: sums then don't depend on how rows arrived
            order = np.argsort(at)
            table = int(n), np.asarray(at)[order], np.stack([np.asarray(v)[order] for v in values], axis=1)
            if slices == 1 and n * resamples <= KEPT:
                out[row] = (draw_weights(seed, resamples, int(n))[:, table[1]] @ table[2]).ravel()
            else:
                large.setdefault(k, []).append((row, table))
        for k, found in large.items():
            drawn = _drawn_sums(seed, resamples * k // slices, resamples * (k + 1) // slices, [table for _, table in found])
            for (row, _), x in zip(found, drawn, strict=True):
                out[row] = x.ravel()
        return pd.Series(out, dtype=object)

    @F.pandas_udf(T.StructType(fields))
    def summed(drawn: pd.Series) -> pd.DataFrame:
        out = []
        for x in drawn:
            sets = dict(zip(sums, np.asarray(x).reshape(resamples, len(sums)).T, strict=True))
            row = {}
            for name in statistics:
                x = _statistic(name)(sets)
                good = x[~np.isnan(x)]
                if whole:
                    row[name] = [None if v != v else float(v) for v in x]
                else:
                    row[f"{name}_lo"], row[f"{name}_hi"] = np.quantile(good, [0.025, 0.975]).tolist() if len(good) else (None, None)
            out.append(row)
        return pd.DataFrame(out, columns=[f.name for f in fields])

    if slices == 1:
        drawn = gathered.select(*keys, draw(F.lit(0), "size", "i", *sums).alias("drawn"))
    else:
        pieces = gathered.select("*", F.explode(F.sequence(F.lit(0), F.lit(slices - 1))).alias("piece")).repartitionById(slices, F.col("piece"))
        pieces = pieces.select(*keys, F.struct("piece", draw("piece", "size", "i", *sums).alias("x")).alias("p"))
        in_order = F.transform(F.sort_array(F.collect_list("p")), lambda p: p["x"])
        drawn = pieces.groupBy(*keys).agg(F.flatten(in_order).alias("drawn"))
    return drawn.select(*keys, summed("drawn").alias("found")).select(*keys, "found.*")


def _cc(x: str) -> Column:
    spread = (F.col("n") * F.col("yy") - F.col("y") * F.col("y")) * (F.col("n") * F.col(x + x) - F.col(x) * F.col(x))
    return F.when(spread > 0, (F.col("n") * F.col(f"y{x}") - F.col("y") * F.col(x)) / F.sqrt(spread))


def d_mae() -> Column:
    return (F.col("ea") - F.col("eb")) / F.col("n")


def d_corr() -> Column:
    return _cc("a") - _cc("b")


def block_bootstrap(pairs: DataFrame, date: str, y: str, a: str, b: str, keys: list[str], resamples: int = 1000, seed: int = 0) -> DataFrame:
    """keys, d_mae, d_mae_lo, d_mae_hi, d_corr, d_corr_lo, d_corr_hi, significant (the interval of d_mae excludes zero), n (rows).

    Rows must be complete, and there is a key at least. Each key is resampled by itself with the same seed;
    its blocks are months, so what is joined are a few numbers per month of one comparison.
    """
    stats = cut(block_statistics(pairs, date, y, a, b, keys))  # a few numbers, read twice
    point = stats.groupBy(*keys).agg(*[F.sum(c).alias(c) for c in STATS]).select(*keys, F.col("n").cast("long").alias("n"), r6(d_mae()).alias("d_mae"), r6(d_corr()).alias("d_corr"))
    spans = resampled(stats, keys, STATS, ["d_mae", "d_corr"], resamples, seed)
    low, high = F.col("d_mae_lo"), F.col("d_mae_hi")
    both = point.join(spans, keys).withColumn("significant", (low > 0) | (high < 0))
    return both.select(*keys, *[r6(F.col(c)).alias(c) if c.endswith(("lo", "hi")) else c for c in ("d_mae", "d_mae_lo", "d_mae_hi", "d_corr", "d_corr_lo", "d_corr_hi")], "significant", "n")


def bootstrap_means(rows: DataFrame, values: list[str], block: Column, keys: list[str], resamples: int = 2000, seed: int = 0, slices: int = 1) -> DataFrame:
    """keys and, for each value, its mean and the central 95 % of the means of resamples of whole blocks ({value}_lo, {value}_hi).

    A block of its own for each row gives the plain bootstrap; months the block bootstrap; days of several
    rows that of a days x bins table. Values share the draws.
    """
    of = [c for v in values for c in (F.sum(v).alias(f"v_{v}"), F.count(v).cast("double").alias(f"n_{v}"))]
    stats = cut(rows.groupBy(*keys, block.alias("block")).agg(*of))
    point = stats.groupBy(*keys).agg(*[r6(F.sum(f"v_{v}") / F.sum(f"n_{v}")).alias(v) for v in values])
    spans = resampled(stats, keys, [f"{s}_{v}" for v in values for s in "vn"], [f"mean_{v}" for v in values], resamples, seed, slices=slices)
    rounded = spans.select(*keys, *[r6(F.col(f"mean_{v}_{end}")).alias(f"{v}_{end}") for v in values for end in ("lo", "hi")])
    return point.join(rounded, keys).select(*keys, *[c for v in values for c in (v, f"{v}_lo", f"{v}_hi")])


def bootstrap_mean(rows: DataFrame, value: str, block: Column, keys: list[str], resamples: int = 2000, seed: int = 0) -> DataFrame:
    """keys, mean, lo, hi of the mean of one value."""
    return bootstrap_means(rows, [value], block, keys, resamples, seed).withColumnsRenamed({value: "mean", f"{value}_lo": "lo", f"{value}_hi": "hi"})


# The same in SQL, as common table expressions: `source` has the keys, a date and y, a, b (or a block and v).
def draws_sql(name: str, stats: str, keys: list[str], resamples: int, seed: int = 0) -> str:
    ks = "".join(f"{k}, " for k in keys)
    part = f"PARTITION BY {', '.join(keys)} " if keys else ""
    return f"""{name}_nu AS (SELECT {ks}block, row_number() OVER ({part}ORDER BY block) - 1 AS i, count(*) OVER ({part}) AS size FROM (SELECT DISTINCT {ks}block FROM {stats})),
    {name}_pl AS (SELECT size, r, CAST('0x' || substr(md5(concat_ws(':', {seed}, r, s)), 1, 8) AS BIGINT) % size AS i, count(*) AS w FROM (SELECT DISTINCT size FROM {name}_nu), range({resamples}) AS a(r), LATERAL (SELECT unnest(range(size)) AS s) GROUP BY ALL),
    {name}_we AS (SELECT {ks}r, block, w FROM {name}_nu JOIN {name}_pl USING (size, i))"""


def resampled_sql(name: str, stats: str, keys: list[str], sums: list[str], number_by: list[str] | None = None) -> str:
    by = keys if number_by is None else number_by
    same = "".join(f" AND t.{k} = w.{k}" for k in by)
    return f"""{name}_rs AS (SELECT {"".join(f"t.{k}, " for k in keys)}r, {", ".join(f"sum(w * t.{c}) AS {c}" for c in sums)} FROM {stats} t JOIN {name}_we w ON t.block = w.block{same} GROUP BY ALL)"""


def cc_sql(x: str) -> str:
    spread = f"((n * yy - y * y) * (n * {x}{x} - {x} * {x}))"
    return f"CASE WHEN {spread} > 0 THEN (n * y{x} - y * {x}) / sqrt({spread}) END"


D_MAE_SQL, D_CORR_SQL = "(ea - eb) / n", f"({cc_sql('a')}) - ({cc_sql('b')})"


def statistics_sql(name: str, source: str, keys: list[str]) -> str:
    return f"""{name}_st AS (SELECT {"".join(f"{k}, " for k in keys)}date_trunc('month', date) AS block, CAST(count(*) AS DOUBLE) AS n, sum(abs(y - a)) AS ea, sum(abs(y - b)) AS eb, sum(y) AS y, sum(a) AS a, sum(b) AS b,
        sum(y * y) AS yy, sum(a * a) AS aa, sum(b * b) AS bb, sum(y * a) AS ya, sum(y * b) AS yb FROM {source} GROUP BY ALL)"""


def block_bootstrap_sql(name: str, source: str, keys: list[str], resamples: int, seed: int = 0) -> str:
    """Common table expressions of which `name` has the columns of `block_bootstrap`."""
    ks = ", ".join(keys)
    q = lambda c, p: f"round(quantile_cont({c}, {p}), 6) + 0.0"
    return f"""{statistics_sql(name, source, keys)}, {draws_sql(name, f"{name}_st", keys, resamples, seed)}, {resampled_sql(name, f"{name}_st", keys, STATS)},
    {name}_pt AS (SELECT {ks}, CAST(n AS BIGINT) AS n, round({D_MAE_SQL}, 6) + 0.0 AS d_mae, round({D_CORR_SQL}, 6) + 0.0 AS d_corr FROM (SELECT {ks}, {", ".join(f"sum({c}) AS {c}" for c in STATS)} FROM {name}_st GROUP BY ALL)),
    {name}_sp AS (SELECT {ks}, {q("m", 0.025)} AS d_mae_lo, {q("m", 0.975)} AS d_mae_hi, {q("c", 0.025)} AS d_corr_lo, {q("c", 0.975)} AS d_corr_hi FROM (SELECT {ks}, {D_MAE_SQL} AS m, {D_CORR_SQL} AS c FROM {name}_rs) GROUP BY ALL),
    {name} AS (SELECT {ks}, d_mae, d_mae_lo, d_mae_hi, d_corr, d_corr_lo, d_corr_hi, d_mae_lo > 0 OR d_mae_hi < 0 AS significant, n FROM {name}_pt JOIN {name}_sp USING ({ks}))"""


def bootstrap_mean_sql(name: str, source: str, keys: list[str], resamples: int, seed: int = 0) -> str:
    """`source` has the keys, block and v; `name` has the keys, mean, lo, hi."""
    ks = ", ".join(keys)
    return f"""{name}_st AS (SELECT {ks}, block, sum(v) AS v, CAST(count(v) AS DOUBLE) AS n FROM {source} GROUP BY ALL), {draws_sql(name, f"{name}_st", keys, resamples, seed)}, {resampled_sql(name, f"{name}_st", keys, ["v", "n"])},
    {name} AS (SELECT {ks}, mean, lo, hi FROM (SELECT {ks}, round(sum(v) / sum(n), 6) + 0.0 AS mean FROM {name}_st GROUP BY ALL)
        JOIN (SELECT {ks}, round(quantile_cont(v / n, 0.025), 6) + 0.0 AS lo, round(quantile_cont(v / n, 0.975), 6) + 0.0 AS hi FROM {name}_rs GROUP BY ALL) USING ({ks}))"""
