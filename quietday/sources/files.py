"""Sources and sinks beyond the test tables: databases, CSV, JSON, files keyed by their names, manifests, appends."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def _connection(prefix: str) -> dict[str, str]:
    """url, user, password and driver from the environment ({prefix}URL and so on); what isn't set is left out."""
    return {k: os.environ[f"{prefix}{k.upper()}"] for k in ("url", "user", "password", "driver") if f"{prefix}{k.upper()}" in os.environ}


def jdbc_table(spark: SparkSession, table: str, prefix: str = "DB_", by: str | None = None, partitions: int = 8, fetch: int = 10_000) -> DataFrame:
    """A database table; url, user, password and driver come from the environment. Filters, columns, limits and aggregates are pushed down.

    With `by`, a column of numbers, dates or times, its least and greatest value are asked for first, and the range between is read as that many
    partitions, each by a connection of its own; rows whose `by` is null are in the first. A table without values is read as one.
    """
    reader = spark.read.format("jdbc").options(dbtable=table, fetchsize=str(fetch), **_connection(prefix))
    if by is None:
        return reader.load()
    ends = reader.load().agg(F.min(by).alias("lo"), F.max(by).alias("hi")).first()  # the database finds them
    if ends["lo"] is None:
        return reader.load()
    return reader.options(partitionColumn=by, lowerBound=str(ends["lo"]), upperBound=str(ends["hi"]), numPartitions=str(partitions)).load()


def jdbc_write(df: DataFrame, table: str, prefix: str = "DB_", mode: str = "append", batch: int = 10_000, connections: int = 8, types: str | None = None) -> None:
    """Writes rows to a database table, by at most so many connections, in batches.

    A table that isn't there is made, with the database's own types or those of `types` ("name VARCHAR(64), ..."); keys that are filtered on need one that compares.
    """
    few = df.coalesce(connections) if df.rdd.getNumPartitions() > connections else df
    own = {"createTableColumnTypes": types} if types else {}
    few.write.format("jdbc").options(dbtable=table, batchsize=str(batch), **own, **_connection(prefix)).mode(mode).save()


def time_range(df: DataFrame, time: str, start: str | None, end: str | None, columns: list[str]) -> DataFrame:
    """Columns of the rows in the half-open range; a missing bound is open."""
    out = df.select(*columns)
    kind = dict(df.dtypes)[time]
    if start:
        out = out.where(F.col(time) >= F.lit(start).cast(kind))
    if end:
        out = out.where(F.col(time) < F.lit(end).cast(kind))
    return out


def sql_frame(spark: SparkSession, sql: str, tables: dict[str, DataFrame], **values) -> DataFrame:
    """The rows of a statement over named tables, its :parameters bound as values (never pasted into the text)."""
    return spark.sql(sql, args=values, **tables)


def months(spark: SparkSession, first: str, last: str) -> DataFrame:
    """month (its first day) and end (its last) of each month from that of `first` to that of `last`, both counted in."""
    span = spark.range(1).select(F.explode(F.sequence(F.trunc(F.lit(first).cast("date"), "month"), F.trunc(F.lit(last).cast("date"), "month"), F.expr("interval 1 month"))).alias("month"))
    return span.select("month", F.last_day("month").alias("end"))


def csv_table(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A CSV file with a header and a fixed schema; dates are typed by it."""
    return spark.read.csv(path, header=True, schema=schema)


def json_entries(spark: SparkSession, path: str, schema: str, lines: bool = False) -> DataFrame:
    """The entries of files that hold one JSON array each, or an entry in each line (then one file splits)."""
    return spark.read.json(path, schema=schema, multiLine=not lines)


def append_scores(scores: DataFrame, path: str, keys: list[str]) -> None:
    """Adds runs' scores to a table that is partitioned by the run's keys; a run that is there already is replaced, so a rerun doubles nothing."""
    scores.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*keys).parquet(path)


def missing_runs(runs: DataFrame, path: str, keys: list[str]) -> DataFrame:
    """The rows of `runs` whose keys have no scores in the table yet; only its folders' names are read. All of them while there is no table."""
    spark = runs.sparkSession
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    if not where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(where):
        return runs
    there = spark.read.parquet(path).select(*keys).distinct()
    return runs.join(there.select(*[F.col(k).cast(dict(runs.dtypes)[k]).alias(k) for k in keys]), keys, "left_anti")


def keyed_by_name(spark: SparkSession, path: str, pattern: str, keys: list[str]) -> DataFrame:
    """All Parquet files under a folder with key columns taken from their names; other names are left out."""
    df = spark.read.parquet(path)
    name = F.col("_metadata.file_name")
    return df.where(name.rlike(pattern)).select("*", *[F.regexp_extract(name, pattern, i).alias(k) for i, k in enumerate(keys, 1)])


def cache_index(spark: SparkSession, root: str) -> DataFrame:
    """source, slot_time, path of `<source>/<yyyy>/<yyyymmdd_HH>.npy` files; contents aren't read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.npy").load(root).select("path")
    p = r"([^/]+)/\d{4}/(\d{8}_\d{2})\.npy$"
    return files.where(F.col("path").rlike(p)).select(F.regexp_extract("path", p, 1).alias("source"), F.to_timestamp_ntz(F.regexp_extract("path", p, 2), F.lit("yyyyMMdd_HH")).alias("slot_time"), "path")


def manifest(spark: SparkSession, root: str, glob: str = "*") -> DataFrame:
    """file, bytes and SHA-256 of every file under a folder."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", glob).load(root)
    return files.select(F.element_at(F.split("path", "/"), -1).alias("file"), F.col("length").alias("bytes"), F.sha2("content", 256).alias("sha256"))


def report_texts(spark: SparkSession, path: str) -> DataFrame:
    """source_file and text of whole report files."""
    return spark.read.text(path, wholetext=True).select(F.col("_metadata.file_name").alias("source_file"), F.col("value").alias("text"))


def report_bundle(spark: SparkSession, path: str, end: str = "\f") -> DataFrame:
    """text of the reports in files that hold many, each ended by a form feed."""
    return spark.read.text(path, lineSep=end).select(F.col("value").alias("text")).where("trim(text) <> ''")


def parameters(spark: SparkSession, path: str | None, defaults: dict[str, float]) -> dict[str, float]:
    """Defaults, overridden by the columns of a one-row JSON file if it is given."""
    if path is None:
        return dict(defaults)
    row = spark.read.json(path, multiLine=True).first()
    return defaults | ({k: float(v) for k, v in row.asDict().items() if v is not None} if row else {})
