"""Contiguous calendar grids and what needs them: limited fills, windows of rows, sample building.

All take key columns (`keys`), so that many series are processed side by side; a window is partitioned by
the series, never global unless there is one series only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def fill_grid(df: DataFrame, at: str, step: str, keys: list[str] | None = None, start=None, end=None) -> DataFrame:
    """Every step between a series' first and last (or the given bounds), missing ones with nulls."""
    keys = keys or []
    low = F.min(at) if start is None else F.lit(start)
    high = F.max(at) if end is None else F.lit(end)
    bounds = df.groupBy(*keys).agg(low.alias("_lo"), high.alias("_hi")).where("_lo is not null")
    every = bounds.select(*keys, F.explode(F.expr(f"sequence(_lo, _hi, interval {step})")).alias(at))
    return every.join(df, [*keys, at], "left")


def series_window(at: str, keys: list[str] | None = None):
    return Window.partitionBy(*(keys or [])).orderBy(at)


def forward_fill(df: DataFrame, columns: list[str], limit: int, at: str, keys: list[str] | None = None) -> DataFrame:
    """The last value at most `limit` rows back; on a contiguous grid."""
    w = series_window(at, keys).rowsBetween(-limit, 0)
    return df.withColumns({c: F.last(c, ignorenulls=True).over(w) for c in columns})


def run_complete(ok: Column, length: int, at: str, keys: list[str] | None = None) -> Column:
    """Whether the last `length` rows, this one included, all are ok."""
    w = series_window(at, keys).rowsBetween(-(length - 1), 0)
    return F.sum(F.coalesce(ok.cast("int"), F.lit(0))).over(w) == length


def make_windows(df: DataFrame, value: str, history: int, horizon: int, at: str, stride: int = 1, keys: list[str] | None = None) -> DataFrame:
    """Samples (keys, at, x, y): `history` values up to the issue time and `horizon` after it.

    A null in either drops the sample. Needs a contiguous grid; sees nothing after the issue time in x.
    """
    w = series_window(at, keys)
    back, ahead = w.rowsBetween(-(history - 1), 0), w.rowsBetween(1, horizon)
    row = F.row_number().over(w)
    out = df.select(
        *(keys or []), at, row.alias("_row"),
        F.collect_list(value).over(back).alias("x"), F.collect_list(value).over(ahead).alias("y"),
    )
    keep = (F.size("x") == history) & (F.size("y") == horizon) & ((F.col("_row") - history) % stride == 0)
    return out.where(keep).drop("_row")


def feature_windows(df: DataFrame, features: list[str], target: str, history: int, at: str, lead: int = 1, keys: list[str] | None = None) -> DataFrame:
    """Samples (keys, at, x array of structs, y): all features over the history and the target at +lead."""
    w = series_window(at, keys)
    complete = F.lit(True)
    for f in features:
        complete = complete & F.col(f).isNotNull()
    rows = df.withColumn("_row", F.when(complete, F.struct(*features)))
    out = rows.select(*(keys or []), at, F.collect_list("_row").over(w.rowsBetween(-(history - 1), 0)).alias("x"), F.lead(target, lead).over(w).alias("y"))
    return out.where((F.size("x") == history) & F.col("y").isNotNull())


def split_ranges(date: Column, spec: dict[str, tuple[str, str]]) -> Column:
    """The named range, both ends included, that holds the date."""
    out = F.lit(None).cast("string")
    for name, (a, b) in reversed(list(spec.items())):
        out = F.when(date.between(F.lit(a).cast("date"), F.lit(b).cast("date")), name).otherwise(out)
    return out


def split_years(date: Column, test: list[int], val: list[int]) -> Column:
    """Whole years for test and val, all others train."""
    y = F.year(date)
    return F.when(y.isin(test), "test").when(y.isin(val), "val").otherwise("train")
