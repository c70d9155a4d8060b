"""Audits that cost no pass of their own: counts taken while rows are written, and contracts that stop a query."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F


def written_with_counts(df: DataFrame, path: str, **counts: Column) -> dict[str, object]:
    """Writes the rows as Parquet and returns the aggregates `counts` over them, taken in the same pass."""
    seen = Observation()
    df.observe(seen, *[c.alias(name) for name, c in counts.items()]).write.parquet(path)
    return seen.get


def same_days(a: DataFrame, b: DataFrame, day: str, names: tuple[str, str] = ("the first", "the second")) -> DataFrame:
    """day, of both: the distinct days of two tables, which have to be equal.

    A day that only one of them has fails the query, naming the day and the table that lacks it. Null days count as days.
    """
    side = lambda df, mark: df.select(F.col(day).alias("day")).distinct().withColumn(mark, F.lit(True))
    x, y = side(a, "in_a"), side(b, "in_b")
    both = x.join(y, x["day"].eqNullSafe(y["day"]), "full").select(F.coalesce(x["day"], y["day"]).alias(day), "in_a", "in_b")
    lacks = F.when(F.col("in_a").isNull(), F.lit(names[0])).when(F.col("in_b").isNull(), F.lit(names[1]))
    text = F.concat(lacks, F.lit(" table lacks "), F.coalesce(F.col(day).cast("string"), F.lit("null")))
    return both.where(F.assert_true(lacks.isNull(), text).isNull()).select(day)
