"""Exact quantiles of a large column by selection: brackets that shrink by rounds, and never many rows in one task.

The column is written once. Each round asks a sketch for two values around the wanted rank, among the rows that are still in the
bracket, and counts exactly what lies below, at and between them. That settles the rank on one of the two values or leaves a bracket of some
thousandths of the rows; a bracket of at most RANKED rows is sorted. So a round is two passes over one narrow column, and
a column of 10^11 rows takes three rounds. Columns of few different values need no more: a value that holds the rank ends the search.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quietday.session import cut

#: Relative accuracy of the sketch, and rows of a bracket that are sorted.
PARTS, RANKED = 10_000, 100_000


def value_at(values: DataFrame, rank: int, n: int, parts: int = PARTS, ranked: int = RANKED) -> float:
    """The value of a rank (from 0) among the n non-null numbers of the one column of `values`, which should be cheap to read again."""
    v = F.col(values.columns[0])
    inside, below, size = values.where(v.isNotNull()), 0, n
    while size > ranked:
        at = (rank - below) / size
        around = [max(0.0, at - 2 / parts), min(1.0, at + 2 / parts)]
        a, b = inside.agg(F.percentile_approx(v, F.array(*[F.lit(x) for x in around]), parts)).first()[0]
        between = (v > a) & (v < b)
        less, at_a, mid, at_b = inside.agg(F.count_if(v < a), F.count_if(v == a), F.count_if(between), F.count_if((v == b) & (v > a))).first()
        if rank < below + less:
            inside, size = inside.where(v < a), less
        elif rank < below + less + at_a:
            return a
        elif rank < below + less + at_a + mid:
            inside, below, size = inside.where(between), below + less + at_a, mid
        elif rank < below + less + at_a + mid + at_b:
            return b
        else:
            gone = less + at_a + mid + at_b
            inside, below, size = inside.where(v > b), below + gone, size - gone
    return inside.orderBy(v).offset(rank - below).limit(1).first()[0]


def quantile_of(values: DataFrame, q: float, parts: int = PARTS, ranked: int = RANKED) -> float | None:
    """The quantile, interpolated between the two ranks around it, of the non-null numbers of a one-column table; None without any. NaN counts as greatest."""
    n = values.where(F.col(values.columns[0]).isNotNull()).count()
    if not n:
        return None
    place = (n - 1) * q
    low = int(place)
    a = value_at(values, low, n, parts, ranked)
    if place == low:
        return a
    v = F.col(values.columns[0])
    # the next rank holds the same value or the least one above it
    upto, above = values.agg(F.count_if(v <= a), F.min(F.when(v > a, v))).first()
    b = a if upto > low + 1 else above
    return a + (b - a) * (place - low)


def exact_quantile(df: DataFrame, value: str, q: float, name: str, *others: Column, parts: int = PARTS, ranked: int = RANKED) -> DataFrame:
    """One row: the interpolated quantile of the non-null values as `name`, and other aggregates of all rows.

    `df` is read once and written to the shared folder, with all its columns if there are `others`. Without values the quantile is null.
    """
    kept = cut(df if others else df.select(value))
    found = quantile_of(kept.select(F.col(value).cast("double").alias(value)), q, parts, ranked)
    quantile = F.lit(found).cast("double").alias(name)
    return kept.agg(*others).select(quantile, "*") if others else df.sparkSession.range(1).select(quantile)
