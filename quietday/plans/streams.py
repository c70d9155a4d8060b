"""The registered streaming query."""

from __future__ import annotations

from pyspark.sql import functions as F

from quietday.functions.columns import r6
from quietday.plans.registry import query
from quietday.streaming.windows import stream_3h


@query("SELECT time_bucket(INTERVAL '3 hours', ts) AS time, count(*) AS n, round(sum(value), 4) + 0.0 AS total FROM events WHERE value < 200 GROUP BY 1")
def q_stream_3h(spark, sf_dir):
    return stream_3h(spark, sf_dir).withColumn("total", F.round(r6(F.col("total")), 4) + 0.0)
