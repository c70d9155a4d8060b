"""Order-dependent folds that windows can't express, reduced before anything is gathered."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quietday.session import cut


def merge_events(events: DataFrame, keys: list[str], time: str, order: str, gap_s: int) -> DataFrame:
    """Keeps an event if it is more than the gap after the last one kept (not after the one before it).

    The event kept after one is the first that is more than the gap later: a link from each event to another,
    looked up in buckets of time. Marks are passed on along these links by pointer jumping, with a
    checkpoint each round, so no task holds a stretch of the time line, however dense it is. Of events at
    one time the least `order` may be kept; null times never are, nor events of which a key is null (they belong to no line).
    """
    gap = gap_s * 1_000_000
    width = max(1_000_000, gap // 48)
    micros = F.unix_micros(F.col(time).cast("timestamp"))
    rows = cut(events.where(F.col(time).isNotNull()).groupBy(*keys, micros.alias("_t")).agg(F.min(order).alias(order)))
    bucket = lambda t: F.floor(t / width)
    # inside a bucket: events and the times asked for, from the last to the first; an event at the very time isn't later
    given = rows.select(*keys, bucket(F.col("_t")).alias("_b"), F.col("_t").alias("_at"), F.lit(0).alias("_is"), F.col("_t").alias("_u"))
    asked = rows.select(*keys, bucket(F.col("_t") + gap).alias("_b"), (F.col("_t") + gap).alias("_at"), F.lit(1).alias("_is"), F.lit(None).cast("long").alias("_u"))
    later = Window.partitionBy(*keys, "_b").orderBy(F.desc("_at"), F.desc("_is")).rowsBetween(Window.unboundedPreceding, -1)
    both = given.unionByName(asked)
    inside = both.withColumn("_to", F.last("_u", ignorenulls=True).over(later)).where("_is = 1")
    # past the bucket: the first event of the next bucket that has any; a row for each bucket, not for each event
    line = Window.partitionBy(*keys).orderBy(F.desc("_b")).rowsBetween(Window.unboundedPreceding, -1)
    past = both.groupBy(*keys, "_b").agg(F.min("_u").alias("_first")).select(*keys, "_b", F.last("_first", ignorenulls=True).over(line).alias("_past"))
    links = inside.join(past, [*keys, "_b"]).select(*keys, (F.col("_at") - gap).alias("_t"), F.coalesce("_to", "_past").alias("_to"))
    links = cut(links.join(rows, [*keys, "_t"]).select(*keys, "_t", order, "_to"))
    start = links.groupBy(*keys).agg(F.min("_t").alias("_t"))
    return events.join(_reached(links, start, keys).select(*keys, order), [*keys, order], "left_semi")


def _reached(links: DataFrame, start: DataFrame, keys: list[str]) -> DataFrame:
    """The rows of `links` (keys, _t, _to) on the paths from `start`: each round doubles the steps taken."""
    marked = cut(start.select(*keys, "_t"))
    jump = links.select(*keys, "_t", "_to")
    while True:
        ahead = jump.join(marked, [*keys, "_t"]).where("_to is not null").select(*keys, F.col("_to").alias("_t"))
        grown = cut(marked.unionByName(ahead).distinct())
        if grown.count() == marked.count():
            return links.join(marked, [*keys, "_t"], "left_semi")
        marked = grown
        twice = jump.select(*keys, F.col("_t").alias("_to"), F.col("_to").alias("_u"))
        jump = cut(jump.join(twice, [*keys, "_to"], "left").select(*keys, "_t", F.col("_u").alias("_to")))
