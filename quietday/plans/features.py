"""Feature tables: masks, daily and 3-hour aggregates, grids, fills, transforms, coverage."""

from __future__ import annotations

from pyspark.sql import functions as F

from quietday.functions.columns import no_nan, r6, safe_log10
from quietday.operators.audits import written_with_counts
from quietday.operators.grids import fill_grid, forward_fill
from quietday.plans.registry import query
from quietday.session import scratch_path
from quietday.sources import adapters as A


@query("SELECT ts AS datetime, value FROM events WHERE ts >= TIMESTAMP '2024-01-05' AND ts < TIMESTAMP '2024-01-12'")
def q_scan_range(spark, sf_dir):
    e = A.read(spark, sf_dir, "events").select(F.col("ts").alias("datetime"), "value")
    return e.where("datetime >= timestamp_ntz'2024-01-05' and datetime < timestamp_ntz'2024-01-12'")


@query(f"WITH {A.MASKED} SELECT * FROM masked")
def q_mask_fills(spark, sf_dir):
    return A.masked_hourly(spark, sf_dir)


def daily_index(hourly):
    """By UT day: mean ap, max kp / 10, means, min dst and the count of ap; every day of the span."""
    day = hourly.groupBy(F.to_date("datetime").alias("date")).agg(
        F.avg("ap_index_nt").alias("ap"), (F.max("kp_index") / 10.0).alias("kp"), F.avg("f10_7_index_sfu").alias("f107"),
        F.avg("sunspot_number_r").alias("sn"), F.min("dst_index_nt").alias("dst"), F.count("ap_index_nt").alias("n_ap_hours"),
    )
    return fill_grid(day, "date", "1 day").withColumn("n_ap_hours", F.coalesce("n_ap_hours", F.lit(0)))


DAILY_INDEX_SQL = f"""{A.MASKED}, d AS (SELECT CAST(datetime AS DATE) AS date, avg(ap_index_nt) AS ap, max(kp_index) / 10.0 AS kp, avg(f10_7_index_sfu) AS f107,
    avg(sunspot_number_r) AS sn, min(dst_index_nt) AS dst, count(ap_index_nt) AS n FROM masked GROUP BY 1),
    g AS (SELECT CAST(unnest(generate_series(min(date), max(date), INTERVAL 1 DAY)) AS DATE) AS date FROM d),
    di AS (SELECT g.date, ap, kp, f107, sn, dst, coalesce(n, 0) AS n_ap_hours FROM g LEFT JOIN d USING (date))"""


@query(f"WITH {DAILY_INDEX_SQL} SELECT date, round(ap, 6) + 0.0 AS ap, kp, round(f107, 6) + 0.0 AS f107, round(sn, 6) + 0.0 AS sn, dst, n_ap_hours FROM di")
def q_daily_index(spark, sf_dir):
    d = daily_index(A.masked_hourly(spark, sf_dir))
    return d.select("date", r6(F.col("ap")).alias("ap"), "kp", r6(F.col("f107")).alias("f107"), r6(F.col("sn")).alias("sn"), "dst", "n_ap_hours")


def xray(events, bin_, name):
    """Log10 of mean and max of good samples (flag 0, flux above 0) and their count, by bin."""
    good = events.where((F.coalesce(F.col("flag"), F.lit(0)) == 0) & (F.col("flux") > 0))
    g = good.groupBy(bin_.alias(name)).agg(F.avg("flux").alias("m"), F.max("flux").alias("x"), F.count(F.lit(1)).alias("n_xray"))
    return g.select(name, safe_log10(F.col("m")).alias("xray_mean_log"), safe_log10(F.col("x")).alias("xray_max_log"), "n_xray")


def _flux(spark, sf_dir):
    return A.read(spark, sf_dir, "events").select("ts", F.col("value").alias("flux"), F.when(F.col("user_id") % 7 == 0, 1).alias("flag"))


FLUX = "flux AS (SELECT ts, value AS flux, CASE WHEN user_id % 7 = 0 THEN 1 END AS flag FROM events)"


@query(f"""WITH {FLUX} SELECT CAST(ts AS DATE) AS date, round(log10(avg(flux)), 6) + 0.0 AS xray_mean_log, round(log10(max(flux)), 6) + 0.0 AS xray_max_log, count(*) AS n_xray
    FROM flux WHERE coalesce(flag, 0) = 0 AND flux > 0 GROUP BY 1""")
def q_xray_daily(spark, sf_dir):
    return xray(_flux(spark, sf_dir), F.to_date("ts"), "date").withColumns({c: r6(F.col(c)) for c in ("xray_mean_log", "xray_max_log")})


@query(f"""WITH {FLUX} SELECT time_bucket(INTERVAL '3 hours', ts) AS time, round(log10(avg(flux)), 6) + 0.0 AS xray_mean_log, round(log10(max(flux)), 6) + 0.0 AS xray_max_log, count(*) AS n_xray
    FROM flux WHERE coalesce(flag, 0) = 0 AND flux > 0 GROUP BY 1""")
def q_xray_3h(spark, sf_dir):
    return xray(_flux(spark, sf_dir), F.window("ts", "3 hours").start, "time").withColumns({c: r6(F.col(c)) for c in ("xray_mean_log", "xray_max_log")})


@query(f"""WITH {A.HOURLY} SELECT CAST(datetime AS DATE) AS date, round(avg(CASE WHEN ap_index_nt < 90 THEN ap_index_nt END), 6) + 0.0 AS speed,
    round(avg(CASE WHEN kp_index < 50 THEN kp_index END), 6) + 0.0 AS density, min(CASE WHEN dst_index_nt > -90 THEN dst_index_nt END) AS bz_min,
    count(CASE WHEN ap_index_nt < 90 THEN 1 END) AS n_sw FROM hourly GROUP BY 1""")
def q_solarwind_daily(spark, sf_dir):
    ap, kp, dst = F.col("ap_index_nt"), F.col("kp_index"), F.col("dst_index_nt")
    return A.hourly(spark, sf_dir).groupBy(F.to_date("datetime").alias("date")).agg(
        r6(F.avg(F.when(ap < 90, ap))).alias("speed"), r6(F.avg(F.when(kp < 50, kp))).alias("density"), F.min(F.when(dst > -90, dst)).alias("bz_min"), F.count_if(ap < 90).alias("n_sw")
    )


@query(f"""WITH {A.BINS}, {FLUX}, x AS (SELECT time_bucket(INTERVAL '3 hours', ts) AS time, log10(avg(flux)) AS m, count(*) AS n_xray FROM flux
        WHERE coalesce(flag, 0) = 0 AND flux > 0 GROUP BY 1)
    SELECT b.time, round(ap, 6) + 0.0 AS ap, round(m, 6) + 0.0 AS xray_mean_log, coalesce(n_xray, 0) AS n_xray FROM bins b LEFT JOIN x USING (time)
    WHERE b.time >= TIMESTAMP '2024-01-02' AND b.time < TIMESTAMP '2024-01-20'""")
def q_features_3h(spark, sf_dir):
    x = xray(_flux(spark, sf_dir), F.window("ts", "3 hours").start, "time")
    t = A.bins_3h(spark, sf_dir).where("time >= timestamp_ntz'2024-01-02' and time < timestamp_ntz'2024-01-20'").join(x, "time", "left")
    return t.select("time", r6(F.col("ap")).alias("ap"), r6(F.col("xray_mean_log")).alias("xray_mean_log"), F.coalesce("n_xray", F.lit(0)).alias("n_xray"))


@query(f"""WITH {DAILY_INDEX_SQL}, {FLUX}, x AS (SELECT CAST(ts AS DATE) AS date, log10(avg(flux)) AS m FROM flux WHERE coalesce(flag, 0) = 0 AND flux > 0 GROUP BY 1),
    s AS (SELECT CAST(datetime AS DATE) AS date, avg(CASE WHEN kp_index < 50 THEN kp_index END) AS density FROM hourly GROUP BY 1)
    SELECT di.date, round(ap, 6) + 0.0 AS ap, round(m, 6) + 0.0 AS xray_mean_log, round(density, 6) + 0.0 AS density FROM di LEFT JOIN x USING (date) LEFT JOIN s USING (date)""")
def q_daily_features(spark, sf_dir):
    x = xray(_flux(spark, sf_dir), F.to_date("ts"), "date")
    s = A.hourly(spark, sf_dir).groupBy(F.to_date("datetime").alias("date")).agg(F.avg(F.when(F.col("kp_index") < 50, F.col("kp_index"))).alias("density"))
    t = daily_index(A.masked_hourly(spark, sf_dir)).join(x, "date", "left").join(s, "date", "left")
    return t.select("date", *[r6(F.col(c)).alias(c) for c in ("ap", "xray_mean_log", "density")])


@query(f"WITH {A.BINS} SELECT CAST(time AS DATE) AS date, round(avg(ap), 6) + 0.0 AS ap, count(ap) AS n_bins FROM bins GROUP BY 1")
def q_resample_daily(spark, sf_dir):
    return A.bins_3h(spark, sf_dir).groupBy(F.to_date("time").alias("date")).agg(r6(F.avg("ap")).alias("ap"), F.count("ap").alias("n_bins"))


@query(f"""WITH {A.BINS}, {DAILY_INDEX_SQL}, r AS (SELECT CAST(time AS DATE) AS date, avg(ap) AS a FROM bins GROUP BY 1)
    SELECT count(*) AS n, round(max(abs(ap - a)), 6) + 0.0 AS max_abs, round(avg(abs(ap - a)), 6) + 0.0 AS mean_abs, count(CASE WHEN abs(ap - a) > 1e-6 THEN 1 END) AS n_differ
    FROM di JOIN r USING (date) WHERE ap IS NOT NULL AND a IS NOT NULL""")
def q_crosscheck(spark, sf_dir):
    a = A.bins_3h(spark, sf_dir).groupBy(F.to_date("time").alias("date")).agg(F.avg("ap").alias("a"))
    d = F.abs(F.col("ap") - F.col("a"))
    j = daily_index(A.masked_hourly(spark, sf_dir)).join(a, "date").where("ap is not null and a is not null")
    return j.agg(F.count(F.lit(1)).alias("n"), r6(F.max(d)).alias("max_abs"), r6(F.avg(d)).alias("mean_abs"), F.count_if(d > 1e-6).alias("n_differ"))


@query(f"""WITH {A.DAILY} SELECT 'ap' AS name, count(*) - count(ap) AS n_missing, count(*) AS n_days FROM daily
    UNION ALL SELECT 'f107', count(*) - count(f107), count(*) FROM daily""")
def q_missing_report(spark, sf_dir):
    """Days without a value, and all days, of each series, counted while the series are written."""
    names = ("ap", "f107")
    missing = {n: F.count_if(F.col(n).isNull()) for n in names}
    seen = written_with_counts(A.daily(spark, sf_dir), scratch_path(spark, "daily"), n_days=F.count(F.lit(1)), **missing)
    return spark.createDataFrame([(n, seen[n], seen["n_days"]) for n in names], "name string, n_missing long, n_days long")


GAPPED = A.DAILY + ", gapped AS (SELECT date, CASE WHEN dayofmonth(date) NOT IN (3, 4, 11, 12, 13, 14, 15) THEN ap END AS ap FROM daily)"
FILLED = GAPPED + ", filled AS (SELECT date, ap AS raw, last_value(ap IGNORE NULLS) OVER (ORDER BY date ROWS BETWEEN 3 PRECEDING AND CURRENT ROW) AS ap FROM gapped)"


def _gapped(spark, sf_dir):
    return A.daily(spark, sf_dir).select("date", F.when(~F.dayofmonth("date").isin(3, 4, 11, 12, 13, 14, 15), F.col("ap")).alias("ap"))


@query(f"WITH {FILLED} SELECT date, round(ap, 6) + 0.0 AS ap FROM filled")
def q_ffill_limited(spark, sf_dir):
    return forward_fill(_gapped(spark, sf_dir), ["ap"], 3, "date").select("date", r6(F.col("ap")).alias("ap"))


@query(f"WITH {FILLED} SELECT count(CASE WHEN raw IS NULL AND ap IS NOT NULL THEN 1 END) AS n_filled, count(CASE WHEN ap IS NULL THEN 1 END) AS n_open FROM filled")
def q_ffill_count(spark, sf_dir):
    f = forward_fill(_gapped(spark, sf_dir).withColumn("raw", F.col("ap")), ["ap"], 3, "date")
    return f.agg(F.count_if(F.col("raw").isNull() & F.col("ap").isNotNull()).alias("n_filled"), F.count_if(F.col("ap").isNull()).alias("n_open"))


@query("""SELECT event_id, round(ln(1 + value), 6) + 0.0 AS l1, round(exp(ln(1 + value)) - 1, 6) + 0.0 AS back, round(log10(value), 6) + 0.0 AS l10 FROM events WHERE value > 0""")
def q_log_transform(spark, sf_dir):
    v = F.col("value")
    return A.read(spark, sf_dir, "events").where(v > 0).select("event_id", r6(F.log1p(v)).alias("l1"), r6(no_nan(F.expm1(F.log1p(v)))).alias("back"), r6(safe_log10(v)).alias("l10"))


@query(f"""WITH {A.DAILY}, m AS (SELECT avg(ap) AS mu, stddev_pop(ap) AS sd FROM daily WHERE date <= DATE '1998-12-31')
    SELECT date, round((ap - mu) / (sd + 1e-8), 6) + 0.0 AS z FROM daily, m WHERE ap IS NOT NULL""")
def q_standardise(spark, sf_dir):
    d = A.daily(spark, sf_dir).where("ap is not null")
    m = d.where("date <= date'1998-12-31'").agg(F.avg("ap").alias("mu"), F.stddev_pop("ap").alias("sd"))
    return d.crossJoin(F.broadcast(m)).select("date", r6((F.col("ap") - F.col("mu")) / (F.col("sd") + 1e-8)).alias("z"))


@query(f"""WITH {A.DAILY}, m AS (SELECT min(ap) AS lo, max(ap) AS hi FROM daily WHERE date <= DATE '1998-12-31')
    SELECT date, round((ap - lo) / (hi - lo), 6) + 0.0 AS scaled, round(greatest((ap - lo) / (hi - lo) * (hi - lo) + lo, 0), 6) + 0.0 AS back FROM daily, m WHERE ap IS NOT NULL""")
def q_minmax(spark, sf_dir):
    d = A.daily(spark, sf_dir).where("ap is not null")
    m = d.where("date <= date'1998-12-31'").agg(F.min("ap").alias("lo"), F.max("ap").alias("hi"))
    s = (F.col("ap") - F.col("lo")) / (F.col("hi") - F.col("lo"))
    return d.crossJoin(F.broadcast(m)).select("date", r6(s).alias("scaled"), r6(F.greatest(s * (F.col("hi") - F.col("lo")) + F.col("lo"), F.lit(0.0))).alias("back"))


@query("""SELECT ts AS datetime, CAST(event_id AS VARCHAR) AS file_path FROM events WHERE event_type = 'view' AND coalesce(CASE WHEN user_id % 5 > 0 THEN 0 ELSE user_id % 2 END, 0) = 0""")
def q_catalog_scan(spark, sf_dir):
    e = A.read(spark, sf_dir, "events").withColumn("quality", F.when(F.col("user_id") % 5 > 0, F.lit(0)).otherwise(F.col("user_id") % 2))
    return e.where((F.col("event_type") == "view") & (F.coalesce("quality", F.lit(0)) == 0)).select(F.col("ts").alias("datetime"), F.col("event_id").cast("string").alias("file_path"))


@query(f"WITH {A.OUTLOOK} SELECT issue_date, target_date, lead, round(fc, 6) + 0.0 AS fc FROM outlook WHERE issue_date BETWEEN DATE '1999-01-01' AND DATE '1999-06-30'")
def q_outlook_scan(spark, sf_dir):
    o = A.outlook(spark, sf_dir).where("issue_date between date'1999-01-01' and date'1999-06-30'")
    return o.select("issue_date", "target_date", "lead", r6(F.col("fc")).alias("fc"))


@query(f"""WITH {A.DAILY} SELECT CAST(date_trunc('month', date) AS DATE) AS month, count(*) AS required, count(ap) AS available FROM daily GROUP BY 1""")
def q_month_coverage(spark, sf_dir):
    return A.daily(spark, sf_dir).groupBy(F.trunc("date", "month").alias("month")).agg(F.count(F.lit(1)).alias("required"), F.count("ap").alias("available"))
