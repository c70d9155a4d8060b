"""The streaming twin of the 3-hour aggregate: file source, watermark, tumbling windows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quietday.session import scratch_path


def tumbling_3h(events: DataFrame, late: str = "6 hours") -> DataFrame:
    """time, n, total of good samples by 3-hour window; rows later than the watermark are dropped."""
    rows = events.select(F.col("ts").cast("timestamp").alias("ts"), "value").where("value < 200")
    w = rows.withWatermark("ts", late).groupBy(F.window("ts", "3 hours")).agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total"))
    return w.select(F.col("window.start").alias("time"), "n", "total")


def run_available(spark: SparkSession, source: str, output: str, checkpoint: str, schema) -> None:
    """Reads all files that are there, appends closed windows to `output`, and stops; a rerun goes on from there."""
    stream = spark.readStream.schema(schema).parquet(source)
    query = tumbling_3h(stream).writeStream.outputMode("append").format("parquet").option("checkpointLocation", checkpoint).trigger(availableNow=True).start(output)
    query.awaitTermination()


def stream_3h(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs the stream over the events table's folder and returns its final state (complete mode into memory-free files)."""
    schema = spark.read.parquet(f"{sf_dir}/events.parquet").schema
    output, checkpoint = scratch_path(spark, "stream-out"), scratch_path(spark, "stream-state")
    stream = spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(sf_dir)

    def save(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{output}/{number}")

    query = tumbling_3h(stream).writeStream.outputMode("update").option("checkpointLocation", checkpoint).trigger(availableNow=True).foreachBatch(save).start()
    query.awaitTermination()
    rows = spark.read.option("recursiveFileLookup", "true").schema("time timestamp, n long, total double").parquet(output)
    # of each window the last update counts
    return rows.groupBy("time").agg(F.max(F.struct("n", "total")).alias("m")).select(F.col("time").cast("timestamp_ntz").alias("time"), F.col("m.n").alias("n"), F.col("m.total").alias("total"))
