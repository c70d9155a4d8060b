"""Roles that the test tables play: observations, daily series, catalogs, forecasts; and the same roles in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quietday.functions.columns import mask_fill
from quietday.operators.grids import fill_grid
from quietday.session import ship

#: Fill values of the observation role: values from here on count as missing.
VALUE_FILL, K_FILL = 200.0, 99.0


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    ship(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def hourly(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Observations: datetime and five measures, fills not yet masked."""
    k = F.get_json_object("props", "$.k").cast("double")
    return read(spark, sf_dir, "events").select(
        F.col("ts").alias("datetime"), F.col("value").alias("ap_index_nt"), k.alias("kp_index"), (k + 100.0).alias("f10_7_index_sfu"),
        (F.col("user_id") % 300).cast("double").alias("sunspot_number_r"), (-F.col("value")).alias("dst_index_nt"),
    )


def masked_hourly(spark: SparkSession, sf_dir: str) -> DataFrame:
    h = hourly(spark, sf_dir)
    return h.withColumns({"ap_index_nt": mask_fill(F.col("ap_index_nt"), VALUE_FILL), "kp_index": mask_fill(F.col("kp_index"), K_FILL)})


def daily_present(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The days that have data: date, ap, f107."""
    o = read(spark, sf_dir, "orders")
    return o.groupBy(F.to_date("o_orderdate").alias("date")).agg((F.avg("o_totalprice") / 9973.0).alias("ap"), F.count(F.lit(1)).cast("double").alias("f107"))


def daily(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The contiguous daily series with nulls on missing days."""
    return fill_grid(daily_present(spark, sf_dir), "date", "1 day")


def catalog(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Frames: source, datetime, file_path."""
    e = read(spark, sf_dir, "events")
    return e.select(F.col("event_type").alias("source"), F.col("ts").alias("datetime"), F.col("event_id").cast("string").alias("file_path"))


def bins_3h(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The contiguous 3-hour table: time, ap, n."""
    e = read(spark, sf_dir, "events").where(F.col("value") < VALUE_FILL)
    b = e.groupBy(F.window("ts", "3 hours").start.alias("time")).agg(F.avg("value").alias("ap"), F.count(F.lit(1)).alias("n"))
    return fill_grid(b, "time", "3 hours")


def forecast_3h(spark: SparkSession, sf_dir: str, days: int = 3) -> DataFrame:
    """Seed ensembles: issue_date, lead_step_3h (1..8 days), target_day_k, time, seed, mu, sigma, observed_ap."""
    e = read(spark, sf_dir, "events").where(F.col("value") < VALUE_FILL)
    time = F.window("ts", "3 hours").start
    cells = e.select(time.alias("time"), (F.col("user_id") % 3).cast("int").alias("seed"), "value")
    seeds = cells.groupBy("time", "seed").agg(F.avg(F.log1p("value")).alias("mu"), (F.stddev_pop("value") / 100.0 + 0.1).alias("sigma"))
    obs = cells.groupBy("time").agg(F.avg("value").alias("observed_ap"))
    both = seeds.join(obs, "time").withColumn("target_day_k", F.explode(F.sequence(F.lit(1), F.lit(days))))
    step = (F.col("target_day_k") - 1) * 8 + (F.hour("time") / 3).cast("int") + 1
    return both.select(F.date_sub(F.to_date("time"), F.col("target_day_k")).alias("issue_date"), step.alias("lead_step_3h"), "target_day_k", "time", "seed", "mu", "sigma", "observed_ap")


def outlook(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Weekly outlooks: Mondays with an observation, leads 0..26, value 0.6 of the issue day's and 0.4 of the training mean."""
    d = daily_present(spark, sf_dir)
    mean = d.where("date <= date'1998-12-31'").agg(F.avg("ap").alias("m"))
    issues = d.where((F.dayofweek("date") == 2) & F.col("ap").isNotNull()).crossJoin(F.broadcast(mean))  # one row
    rows = issues.select(F.col("date").alias("issue_date"), (0.6 * F.col("ap") + 0.4 * F.col("m")).alias("fc"), F.explode(F.sequence(F.lit(0), F.lit(26))).alias("lead"))
    return rows.select("issue_date", F.expr("date_add(issue_date, lead)").alias("target_date"), "lead", "fc")


def shocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events of the shock role: shock_id, shock_time."""
    e = read(spark, sf_dir, "events").where("event_type = 'signup'")
    return e.select(F.col("event_id").alias("shock_id"), F.col("ts").alias("shock_time"), "value")


# The same roles as common table expressions for the SQL twins.
HOURLY = """hourly AS (SELECT ts AS datetime, value AS ap_index_nt, CAST(json_extract_string(props, '$.k') AS DOUBLE) AS kp_index,
    CAST(json_extract_string(props, '$.k') AS DOUBLE) + 100.0 AS f10_7_index_sfu, CAST(user_id % 300 AS DOUBLE) AS sunspot_number_r, -value AS dst_index_nt FROM events)"""
MASKED = HOURLY + """, masked AS (SELECT datetime, CASE WHEN ap_index_nt < 200 THEN ap_index_nt END AS ap_index_nt,
    CASE WHEN kp_index < 99 THEN kp_index END AS kp_index, f10_7_index_sfu, sunspot_number_r, dst_index_nt FROM hourly)"""
DAILY = """present AS (SELECT CAST(o_orderdate AS DATE) AS date, avg(o_totalprice) / 9973.0 AS ap, CAST(count(*) AS DOUBLE) AS f107 FROM orders GROUP BY 1),
    days AS (SELECT CAST(unnest(generate_series(min(date), max(date), INTERVAL 1 DAY)) AS DATE) AS date FROM present),
    daily AS (SELECT days.date, ap, f107 FROM days LEFT JOIN present USING (date))"""
CATALOG = "catalog AS (SELECT event_type AS source, ts AS datetime, CAST(event_id AS VARCHAR) AS file_path FROM events)"
BINS = """b0 AS (SELECT time_bucket(INTERVAL '3 hours', ts) AS time, avg(value) AS ap, count(*) AS n FROM events WHERE value < 200 GROUP BY 1),
    bgrid AS (SELECT unnest(generate_series(min(time), max(time), INTERVAL 3 HOUR)) AS time FROM b0),
    bins AS (SELECT bgrid.time, ap, n FROM bgrid LEFT JOIN b0 USING (time))"""
FORECAST = """cells AS (SELECT time_bucket(INTERVAL '3 hours', ts) AS time, CAST(user_id % 3 AS INTEGER) AS seed, value FROM events WHERE value < 200),
    seeds AS (SELECT time, seed, avg(ln(1 + value)) AS mu, stddev_pop(value) / 100.0 + 0.1 AS sigma FROM cells GROUP BY 1, 2),
    obs AS (SELECT time, avg(value) AS observed_ap FROM cells GROUP BY 1),
    fc3 AS (SELECT CAST(time AS DATE) - CAST(k AS INTEGER) AS issue_date, CAST((k - 1) * 8 + hour(time) // 3 + 1 AS INTEGER) AS lead_step_3h, CAST(k AS INTEGER) AS target_day_k,
            time, seed, mu, sigma, observed_ap FROM seeds JOIN obs USING (time), generate_series(1, 3) AS t(k))"""
OUTLOOK = DAILY + """, mon AS (SELECT date AS issue_date, 0.6 * ap + 0.4 * (SELECT avg(ap) FROM present WHERE date <= DATE '1998-12-31') AS fc FROM present WHERE dayofweek(date) = 1),
    outlook AS (SELECT issue_date, issue_date + CAST(l AS INTEGER) AS target_date, CAST(l AS INTEGER) AS lead, fc FROM mon, generate_series(0, 26) AS t(l))"""
