"""Event analysis: bands of days, labels, onsets and peaks, merges, chained forecasts, catalogs from JSON."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quietday.functions.columns import r6, safe_corr
from quietday.operators.bootstrap import bootstrap_mean_sql, bootstrap_means
from quietday.operators.folds import merge_events
from quietday.operators.grids import series_window
from quietday.operators.joins import flag_days, nearest_by_day
from quietday.plans.features import daily_index
from quietday.plans.registry import query
from quietday.plans.samples import baselines
from quietday.plans.verification import DAY3, ENS, corr_sql, day_means, ensemble
from quietday.session import cut
from quietday.sources import adapters as A

K = "CAST(json_extract_string(props, '$.k') AS INTEGER)"
DAYS30 = "d30 AS (SELECT CAST(unnest(generate_series(date_trunc('day', min(ts)), date_trunc('day', max(ts)) + INTERVAL 1 DAY, INTERVAL 1 DAY)) AS DATE) AS date FROM events)"
EVENTS = f"""cme AS (SELECT event_id, ts, CAST(ts AS DATE) AS day, {K} AS k, value AS speed FROM events WHERE event_type = 'error' AND {K} < 2),
    ips AS (SELECT event_id, ts, CAST(ts AS DATE) AS day FROM events WHERE event_type = 'signup' AND {K} < 2), hss AS (SELECT CAST(ts AS DATE) AS day FROM events WHERE event_type = 'purchase' AND {K} < 3)"""


def event_days(spark, sf_dir) -> DataFrame:
    """The days from the first event to the day after the last."""
    ends = A.read(spark, sf_dir, "events").agg(F.to_date(F.min("ts")).alias("lo"), F.date_add(F.to_date(F.max("ts")), 1).alias("hi"))
    return ends.where("lo is not null").select(F.explode(F.sequence("lo", "hi")).alias("date"))


def catalog_of(spark, sf_dir, kind: str, most: int) -> DataFrame:
    k = F.get_json_object("props", "$.k").cast("int")
    e = A.read(spark, sf_dir, "events").where((F.col("event_type") == kind) & (k < most))
    return e.select("event_id", "ts", F.to_date("ts").alias("day"), k.alias("k"), "value")


@query(f"WITH {DAYS30}, {EVENTS} SELECT date, EXISTS (SELECT 1 FROM cme WHERE day BETWEEN date - 2 AND date) AS cme_day FROM d30")
def q_cme_days(spark, sf_dir):
    """Whether an event's day is among the three days up to each date."""
    return flag_days(event_days(spark, sf_dir), catalog_of(spark, sf_dir, "error", 2), "day", 0, 2, "cme_day")


def event_labels(spark, sf_dir) -> DataFrame:
    d = flag_days(event_days(spark, sf_dir), catalog_of(spark, sf_dir, "signup", 2), "day", 0, 1, "near_shock")
    d = flag_days(d, catalog_of(spark, sf_dir, "purchase", 3), "day", 0, 2, "near_stream")
    d = d.join(daily_index(A.masked_hourly(spark, sf_dir)).select("date", "ap"), "date", "left")
    label = F.when(F.col("near_shock"), "CME").when(F.col("near_stream"), "HSS").when(F.col("ap") < 50, "quiet").otherwise("other")
    return d.select("date", label.alias("label"))


LABELS = f"""{DAYS30}, {EVENTS}, {A.MASKED}, ap AS (SELECT CAST(datetime AS DATE) AS date, avg(ap_index_nt) AS ap FROM masked GROUP BY 1),
    labels AS (SELECT d.date, CASE WHEN EXISTS (SELECT 1 FROM ips WHERE day BETWEEN d.date - 1 AND d.date) THEN 'CME' WHEN EXISTS (SELECT 1 FROM hss WHERE day BETWEEN d.date - 2 AND d.date) THEN 'HSS'
        WHEN ap < 50 THEN 'quiet' ELSE 'other' END AS label FROM d30 d LEFT JOIN ap USING (date))""".replace("labels AS", "labelled AS")


@query(f"WITH {LABELS} SELECT * FROM labelled")
def q_event_labels(spark, sf_dir):
    return event_labels(spark, sf_dir)


#: The ensemble's forecast p, and p0 of its first seed, against which intervals are given.
ENS0 = ENS + ", ens0 AS (SELECT issue_date, lead_step_3h, max(CASE WHEN seed = 0 THEN exp(mu) - 1 END) AS p0 FROM fc3 GROUP BY 1, 2)"


def with_first_seed(f3: DataFrame) -> DataFrame:
    """issue_date, lead_step_3h, target_day_k, p, y of the ensemble, and p0 of its first seed."""
    p = F.expm1("mu")
    return f3.groupBy("issue_date", "lead_step_3h", "target_day_k").agg(F.avg(p).alias("p"), F.max("observed_ap").alias("y"), F.max(F.when(F.col("seed") == 0, p)).alias("p0"))


def intervals_sql(source: str, values: list[str], block: str, keys: list[str], resamples: int = 2000) -> tuple[str, str, str]:
    """Common table expressions, the joins that add them to a table with the keys, and the columns."""
    ks = ", ".join(keys)
    ctes = ", ".join(f"{v}_src AS (SELECT {ks}, {block} AS block, {v} AS v FROM {source}), {bootstrap_mean_sql(f'{v}_b', f'{v}_src', keys, resamples)}" for v in values)
    return ctes, " ".join(f"JOIN {v}_b USING ({ks})" for v in values), ", ".join(f"{v}_b.mean AS {v}, {v}_b.lo AS {v}_lo, {v}_b.hi AS {v}_hi" for v in values)


TYPE_GAPS, TYPE_JOINS, TYPE_COLUMNS = intervals_sql("gaps", ["d_mae_day", "d_mae_3h"], "date", ["target_day_k", "label"])


@query(f"""WITH {LABELS}, {ENS0}, day_bins AS (SELECT issue_date, target_day_k, label, date, p, y, p0, avg(p0) OVER d AS dp0, avg(p) OVER d AS dp, avg(y) OVER d AS dy, count(*) OVER d AS n, max(p) OVER d AS mp, max(y) OVER d AS my FROM ens JOIN ens0 USING (issue_date, lead_step_3h) JOIN labelled ON date = issue_date + target_day_k
        WINDOW d AS (PARTITION BY issue_date, target_day_k)),
    b AS (SELECT * FROM day_bins WHERE n = 8), d AS (SELECT DISTINCT issue_date, target_day_k, label, dp, dy, mp, my FROM b),
    x AS (SELECT target_day_k, label, round(avg(abs(p - y)), 6) + 0.0 AS mae_3h, round(avg(abs((p - dp) - (y - dy))), 6) + 0.0 AS mae_intraday, round(corr(p - dp, y - dy), 6) + 0.0 AS cc_intraday FROM b GROUP BY 1, 2),
    t AS (SELECT target_day_k, label, count(*) AS n_days, count(CASE WHEN my >= 48 THEN 1 END) AS n_days_storm, round(avg(abs(dp - dy)), 6) + 0.0 AS mae_day, {corr_sql('dy', 'dp')} AS cc_day, round(avg(mp - my), 6) + 0.0 AS peak_amp_error,
        round(count(CASE WHEN mp >= 48 AND my >= 48 THEN 1 END) / greatest(count(CASE WHEN my >= 48 THEN 1 END), 1), 6) + 0.0 AS detected, round(count(CASE WHEN mp >= 48 AND my < 48 THEN 1 END) / greatest(count(CASE WHEN my < 48 THEN 1 END), 1), 6) + 0.0 AS false_share FROM d GROUP BY 1, 2),
    gaps AS (SELECT issue_date, target_day_k, label, date, abs(avg(p) - avg(y)) - abs(avg(p0) - avg(y)) AS d_mae_day, avg(abs(p - y)) - avg(abs(p0 - y)) AS d_mae_3h FROM b GROUP BY ALL), {TYPE_GAPS}
    SELECT t.*, x.* EXCLUDE (target_day_k, label), {TYPE_COLUMNS} FROM t JOIN x USING (target_day_k, label) {TYPE_JOINS} WHERE n_days >= 5""")
def q_event_type(spark, sf_dir):
    """Per day ahead and label of the target day, with five days at least: errors of days, of bins and of what bins differ from their day's mean, peaks, shares of storm days seen and of others called, and what
    the ensemble's errors differ from its first seed's, with intervals from resampled target days (the series is too short for months)."""
    e = with_first_seed(A.forecast_3h(spark, sf_dir)).withColumn("date", F.expr("date_add(issue_date, target_day_k)")).join(event_labels(spark, sf_dir), "date")
    day = Window.partitionBy("issue_date", "target_day_k")
    names = {"dp": F.avg("p"), "dy": F.avg("y"), "n": F.count(F.lit(1)), "mp": F.max("p"), "my": F.max("y")}
    b = e.withColumns({k: v.over(day) for k, v in names.items()}).where("n = 8")
    by = ["target_day_k", "label"]
    inner = b.withColumns({"ip": F.col("p") - F.col("dp"), "iy": F.col("y") - F.col("dy")}).groupBy(*by).agg(
        r6(F.avg(F.abs(F.col("p") - F.col("y")))).alias("mae_3h"), r6(F.avg(F.abs(F.col("ip") - F.col("iy")))).alias("mae_intraday"), r6(safe_corr("ip", "iy")).alias("cc_intraday")
    )
    storm, called = F.col("my") >= 48, F.col("mp") >= 48
    share = lambda hit, of: r6(F.count_if(hit & of) / F.greatest(F.count_if(of), F.lit(1)))
    days = b.select("issue_date", *by, "dp", "dy", "mp", "my").distinct().groupBy(*by).agg(
        F.count(F.lit(1)).alias("n_days"), F.count_if(storm).alias("n_days_storm"), r6(F.avg(F.abs(F.col("dp") - F.col("dy")))).alias("mae_day"), r6(safe_corr("dy", "dp")).alias("cc_day"),
        r6(F.avg(F.col("mp") - F.col("my"))).alias("peak_amp_error"), share(called, storm).alias("detected"), share(called, ~storm).alias("false_share"),
    )
    p, y, p0 = F.avg("p"), F.avg("y"), F.avg("p0")
    gaps = b.groupBy("issue_date", *by, "date").agg((F.abs(p - y) - F.abs(p0 - y)).alias("d_mae_day"), (F.avg(F.abs(F.col("p") - F.col("y"))) - F.avg(F.abs(F.col("p0") - F.col("y")))).alias("d_mae_3h"))
    return days.where("n_days >= 5").join(inner, by).join(bootstrap_means(gaps, ["d_mae_day", "d_mae_3h"], F.col("date"), by), by)


@query(f"""WITH {DAYS30}, runs AS (SELECT ts - INTERVAL 40 HOUR AS done, ts AS arrival, {K} AS kp FROM events WHERE event_type = 'error' AND {K} < 10), t AS (SELECT date, CAST(k AS INTEGER) AS k FROM d30, generate_series(1, 3) AS g(k))
    SELECT t.date AS issue_date, t.k, count(r.kp) > 0 AS flagged, max(r.kp) AS kp_max FROM t LEFT JOIN runs r ON r.done < t.date AND CAST(r.arrival AS DATE) = t.date + t.k GROUP BY 1, 2""")
def q_enlil_flag(spark, sf_dir):
    return enlil_flags(spark, sf_dir)


def enlil_flags(spark, sf_dir) -> DataFrame:
    """Per issue date and day ahead: a run finished before the issue arrives on that day; its largest value."""
    runs = catalog_of(spark, sf_dir, "error", 10).select(F.expr("ts - interval 40 hours").alias("done"), F.col("day").alias("arrival_day"), F.col("k").alias("kp"))
    t = event_days(spark, sf_dir).select(F.col("date").alias("issue_date"), F.explode(F.sequence(F.lit(1), F.lit(3))).alias("k")).withColumn("arrival_day", F.expr("date_add(issue_date, k)"))
    j = t.join(runs, (t["arrival_day"] == runs["arrival_day"]) & (runs["done"] < F.col("issue_date").cast("timestamp_ntz")), "left")
    return j.groupBy("issue_date", "k").agg((F.count("kp") > 0).alias("flagged"), F.max("kp").alias("kp_max"))


@query(f"""WITH {DAYS30}, {DAY3}, runs AS (SELECT ts - INTERVAL 40 HOUR AS done, ts AS arrival, {K} AS kp FROM events WHERE event_type = 'error' AND {K} < 10),
    j AS (SELECT d.*, EXISTS (SELECT 1 FROM runs r WHERE r.done < d.issue_date AND CAST(r.arrival AS DATE) = d.issue_date + d.target_day_k) AS flagged, y > 48 AS storm FROM day3 d JOIN d30 ON d30.date = d.issue_date WHERE n = 8)
    SELECT target_day_k, count(*) AS n, count(CASE WHEN flagged THEN 1 END) AS flag_days, count(CASE WHEN storm THEN 1 END) AS storm_days, count(CASE WHEN storm AND flagged THEN 1 END) AS storm_days_flagged,
        round(avg(y) FILTER (flagged), 6) + 0.0 AS obs_flagged, round(avg(y) FILTER (NOT flagged), 6) + 0.0 AS obs_unflagged, round(avg(p) FILTER (flagged), 6) + 0.0 AS model_flagged, round(avg(abs(p - y)) FILTER (flagged), 6) + 0.0 AS mae_flagged,
        round(avg(abs(p - y)) FILTER (NOT flagged), 6) + 0.0 AS mae_unflagged, round(avg(p - y) FILTER (flagged), 6) + 0.0 AS bias_flagged FROM j GROUP BY 1""")
def q_flag_stats(spark, sf_dir):
    """Days with and without a flag: how many are storms, the mean observation, forecast and error, and the bias."""
    flags = enlil_flags(spark, sf_dir).select("issue_date", F.col("k").alias("target_day_k"), "flagged")
    j = day_means(ensemble(A.forecast_3h(spark, sf_dir))).where("n = 8").drop("n").join(flags, ["issue_date", "target_day_k"])
    f, d, storm = F.col("flagged"), F.col("p") - F.col("y"), F.col("y") > 48
    return j.groupBy("target_day_k").agg(
        F.count(F.lit(1)).alias("n"), F.count_if(f).alias("flag_days"), F.count_if(storm).alias("storm_days"), F.count_if(storm & f).alias("storm_days_flagged"),
        r6(F.avg(F.when(f, F.col("y")))).alias("obs_flagged"), r6(F.avg(F.when(~f, F.col("y")))).alias("obs_unflagged"), r6(F.avg(F.when(f, F.col("p")))).alias("model_flagged"),
        r6(F.avg(F.when(f, F.abs(d)))).alias("mae_flagged"), r6(F.avg(F.when(~f, F.abs(d)))).alias("mae_unflagged"), r6(F.avg(F.when(f, d))).alias("bias_flagged"),
    )


@query(f"""WITH {EVENTS} SELECT i.event_id AS shock_id, (SELECT min_by(c.event_id, (abs(epoch_us(c.ts - i.ts)), c.event_id)) FROM cme c WHERE c.day BETWEEN i.day - 2 AND i.day + 2) AS nearest_id FROM ips i""")
def q_nearest_event(spark, sf_dir):
    """The event nearest in time to each shock, among those within two days; ties to the smaller id."""
    i = catalog_of(spark, sf_dir, "signup", 2).select(F.col("event_id").alias("shock_id"), "ts")
    near = nearest_by_day(i, catalog_of(spark, sf_dir, "error", 2), "ts", "event_id", 2, "nearest_id")
    return near.select("shock_id", "nearest_id")


@query(f"""WITH {EVENTS}, l AS (SELECT i.event_id AS shock_id, unnest(string_split(concat_ws(';', i.event_id - 7, i.event_id - 3, i.event_id + 1), ';')) AS id FROM ips i)
    SELECT shock_id, count(e.event_id) AS n, min(e.ts) AS first_start, max(e.value) AS max_speed FROM l LEFT JOIN events e ON CAST(e.event_id AS VARCHAR) = l.id AND e.event_type = 'error' GROUP BY 1""")
def q_linked_cmes(spark, sf_dir):
    """Linked ids (joined by `;`) looked up in the catalog: earliest start and largest speed."""
    i = catalog_of(spark, sf_dir, "signup", 2).select(F.col("event_id").alias("shock_id"), F.concat_ws(";", F.col("event_id") - 7, F.col("event_id") - 3, F.col("event_id") + 1).alias("linked"))
    l = i.select("shock_id", F.explode(F.split("linked", ";")).alias("id"))
    e = A.read(spark, sf_dir, "events").where("event_type = 'error'").select(F.col("event_id").cast("string").alias("id"), "event_id", "ts", "value")
    return l.join(e, "id", "left").groupBy("shock_id").agg(F.count("event_id").alias("n"), F.min("ts").alias("first_start"), F.max("value").alias("max_speed"))


def storm_window(spark, sf_dir) -> DataFrame:
    """shock_id, time, ap for the 3-hour bins from two before a shock's bin to fifteen after it."""
    i = catalog_of(spark, sf_dir, "signup", 2).select(F.col("event_id").alias("shock_id"), F.window("ts", "3 hours").start.alias("bin"))
    w = i.select("shock_id", "bin", F.explode(F.sequence(F.lit(-2), F.lit(15))).alias("o")).withColumn("time", F.expr("bin + make_dt_interval(0, 3 * o)"))
    return w.join(A.bins_3h(spark, sf_dir).select("time", "ap"), "time").select("shock_id", "o", "time", "ap")


WIN = f"""{EVENTS}, {A.BINS}, win AS (SELECT i.event_id AS shock_id, CAST(o AS INTEGER) AS o, b.time, b.ap FROM ips i CROSS JOIN generate_series(-2, 15) AS g(o)
    JOIN bins b ON b.time = time_bucket(INTERVAL '3 hours', i.ts) + to_hours(CAST(3 * o AS INTEGER)))"""


@query(f"WITH {WIN} SELECT shock_id, o, time, round(ap, 6) + 0.0 AS ap FROM win")
def q_storm_window(spark, sf_dir):
    return storm_window(spark, sf_dir).select("shock_id", "o", "time", r6(F.col("ap")).alias("ap"))


def onset_peak(w: DataFrame) -> DataFrame:
    """First bin at or above 48, first bin of the largest value, class by the largest value."""
    peak = F.max("ap")
    strength = F.when(peak >= 132, "strong").when(peak >= 48, "moderate").otherwise("weak")
    return w.where("ap is not null").groupBy("shock_id").agg(
        F.min(F.when(F.col("ap") >= 48, F.col("time"))).alias("onset"), F.max_by("time", F.struct(F.round("ap", 9), -F.col("o"))).alias("peak_time"), peak.alias("peak"), strength.alias("class")
    )


PEAK = f"""{WIN}, peaks AS (SELECT shock_id, min(CASE WHEN ap >= 48 THEN time END) AS onset, max_by(time, (round(ap, 9), -o)) AS peak_time, max(ap) AS peak,
    CASE WHEN max(ap) >= 132 THEN 'strong' WHEN max(ap) >= 48 THEN 'moderate' ELSE 'weak' END AS class FROM win WHERE ap IS NOT NULL GROUP BY 1)"""


@query(f"WITH {PEAK} SELECT shock_id, onset, peak_time, round(peak, 6) + 0.0 AS peak, class FROM peaks")
def q_onset_peak(spark, sf_dir):
    return onset_peak(storm_window(spark, sf_dir)).withColumn("peak", r6(F.col("peak")))


STORMS = f"""{PEAK}, {ENS0}, f AS (SELECT CAST(issue_date + 1 AS TIMESTAMP) + to_hours(CAST(3 * (lead_step_3h - 1) AS INTEGER)) AS time, p, p0 FROM ens JOIN ens0 USING (issue_date, lead_step_3h) WHERE target_day_k = 1),
    j AS (SELECT w.shock_id, w.o, w.time, w.ap, f.p, f.p0 FROM win w JOIN f USING (time) WHERE w.ap IS NOT NULL),
    sf AS (SELECT j.shock_id, k.class, k.onset, avg(abs(p - ap)) AS mae, avg(abs(p - ap)) - avg(abs(p0 - ap)) AS d_mae, CAST(max(p) >= 30 AS DOUBLE) - CAST(max(p0) >= 30 AS DOUBLE) AS d_detect, max(p) - max(ap) AS amp, max(p) >= 30 AS detected, date_diff('hour', max_by(j.time, (round(ap, 9), -o)), max_by(j.time, (round(p, 9), -o))) AS peak_h,
        date_diff('hour', k.onset, min(CASE WHEN p >= 30 THEN j.time END)) AS onset_h FROM j JOIN peaks k USING (shock_id) GROUP BY 1, 2, 3)"""


def storm_errors(spark, sf_dir) -> DataFrame:
    """Per shock, of the chained day-1 forecast: class, mae, amp, detected, hours that peak and onset are late (negative: early), and what mae and detection differ from the first seed's."""
    f = with_first_seed(A.forecast_3h(spark, sf_dir, 1)).select(F.expr("cast(date_add(issue_date, 1) as timestamp_ntz) + make_dt_interval(0, 3 * (lead_step_3h - 1))").alias("time"), "p", "p0")
    w = storm_window(spark, sf_dir).where("ap is not null")
    j = w.join(f, "time").join(onset_peak(w).select("shock_id", "class", "onset"), "shock_id")
    top = lambda c: F.max_by("time", F.struct(F.round(c, 9), -F.col("o")))
    s = j.groupBy("shock_id", "class", "onset").agg(
        F.avg(F.abs(F.col("p") - F.col("ap"))).alias("mae"), (F.max("p") - F.max("ap")).alias("amp"), (F.max("p") >= 30).alias("detected"), top("ap").alias("seen"), top("p").alias("said"), F.min(F.when(F.col("p") >= 30, F.col("time"))).alias("called"),
        (F.avg(F.abs(F.col("p") - F.col("ap"))) - F.avg(F.abs(F.col("p0") - F.col("ap")))).alias("d_mae"), ((F.max("p") >= 30).cast("double") - (F.max("p0") >= 30).cast("double")).alias("d_detect"),
    )
    return s.select("shock_id", "class", "mae", "amp", "detected", "d_mae", "d_detect", F.timestamp_diff("HOUR", F.col("seen"), F.col("said")).alias("peak_h"), F.timestamp_diff("HOUR", F.col("onset"), F.col("called")).alias("onset_h"))


@query(f"WITH {STORMS} SELECT shock_id, class, round(mae, 6) + 0.0 AS mae, round(amp, 6) + 0.0 AS amp, detected, CAST(peak_h AS BIGINT) AS peak_h, CAST(onset_h AS BIGINT) AS onset_h FROM sf")
def q_storm_errors(spark, sf_dir):
    return storm_errors(spark, sf_dir).drop("d_mae", "d_detect").withColumns({"mae": r6(F.col("mae")), "amp": r6(F.col("amp"))})


#: Tasks that draw resamples of shocks, of which there are more with more data.
SLICES = 24

STORM_GAPS, STORM_JOINS, STORM_COLUMNS = intervals_sql("sf", ["d_mae", "d_detect"], "shock_id", ["class"])


@query(f"""WITH {STORMS}, {STORM_GAPS}, st AS (SELECT class, count(*) AS n, round(avg(mae), 6) + 0.0 AS mae, round(quantile_cont(amp, 0.5), 6) + 0.0 AS peak_amp_err_median, round(avg(CASE WHEN detected THEN 1.0 ELSE 0.0 END), 6) + 0.0 AS detect,
    round(quantile_cont(peak_h, 0.5), 6) + 0.0 AS peak_time_err_median, round(quantile_cont(onset_h, 0.5), 6) + 0.0 AS onset_err_median, count(CASE WHEN onset_h < 0 THEN 1 END) AS early FROM sf GROUP BY 1)
    SELECT st.*, {STORM_COLUMNS} FROM st {STORM_JOINS}""")
def q_storm_stats(spark, sf_dir):
    """Chained day-1 forecasts against each storm window, by class: error, peak height and time, onset, detection, early calls, and what
    error and detection differ from the first seed's, with intervals from 2,000 resamples of shocks."""
    median = lambda c: r6(F.percentile(c, 0.5))
    e = cut(storm_errors(spark, sf_dir))  # a row for each shock
    stats = e.groupBy("class").agg(
        F.count(F.lit(1)).alias("n"), r6(F.avg("mae")).alias("mae"), median("amp").alias("peak_amp_err_median"), r6(F.avg(F.col("detected").cast("double"))).alias("detect"),
        median("peak_h").alias("peak_time_err_median"), median("onset_h").alias("onset_err_median"), F.count_if(F.col("onset_h") < 0).alias("early"),
    )
    return stats.join(bootstrap_means(e, ["d_mae", "d_detect"], F.col("shock_id"), ["class"], slices=SLICES), "class")


ARRIVAL_GAPS, ARRIVAL_JOINS, ARRIVAL_COLUMNS = intervals_sql("ag", ["d_mae", "d_bias", "d_rise"], "shock_id", ["lead_group"])


@query(f"""WITH {EVENTS}, {A.BINS}, {ENS0}, f AS (SELECT issue_date, target_day_k, CAST(issue_date + target_day_k AS TIMESTAMP) + to_hours(CAST(3 * ((lead_step_3h - 1) % 8) AS INTEGER)) AS time, p, p0 FROM ens JOIN ens0 USING (issue_date, lead_step_3h)),
    g AS (SELECT event_id AS shock_id, ts AS shock, day - CAST(x AS INTEGER) AS issue_date, CAST(x AS INTEGER) AS days_before FROM ips, generate_series(0, 3) AS t(x)),
    j AS (SELECT g.*, f.time, f.p, f.p0, b.ap, CASE WHEN days_before = 0 THEN f.time >= CAST(g.issue_date + 1 AS TIMESTAMP) AND f.time < CAST(g.issue_date + 2 AS TIMESTAMP) ELSE f.time + INTERVAL 3 HOUR > shock AND f.time < shock + INTERVAL 24 HOUR END AS post, f.time + INTERVAL 3 HOUR <= shock AS pre
        FROM g JOIN f ON f.issue_date = g.issue_date JOIN bins b ON b.time = f.time WHERE b.ap IS NOT NULL),
    s AS (SELECT shock_id, days_before, avg(abs(p - ap)) FILTER (post) AS mae, avg(p - ap) FILTER (post) AS bias, avg(ap) FILTER (post) - avg(ap) FILTER (pre) AS obs_rise, avg(p) FILTER (post) - avg(p) FILTER (pre) AS rise, max(p) FILTER (post) >= 30 AS detected,
            avg(abs(p - ap)) FILTER (post) - avg(abs(p0 - ap)) FILTER (post) AS d_mae, avg(p - ap) FILTER (post) - avg(p0 - ap) FILTER (post) AS d_bias,
            (avg(p) FILTER (post) - avg(p) FILTER (pre)) - (avg(p0) FILTER (post) - avg(p0) FILTER (pre)) AS d_rise FROM j GROUP BY 1, 2),
    ag AS (SELECT *, CASE days_before WHEN 0 THEN 'after arrival' ELSE days_before || ' days before' END AS lead_group FROM s WHERE mae IS NOT NULL), {ARRIVAL_GAPS},
    aa AS (SELECT lead_group, count(*) AS n, round(avg(mae), 6) + 0.0 AS mae, round(avg(bias), 6) + 0.0 AS me, round(avg(obs_rise), 6) + 0.0 AS obs_rise, round(avg(rise), 6) + 0.0 AS rise,
        round(avg(CASE WHEN detected THEN 1.0 ELSE 0.0 END), 6) + 0.0 AS detect FROM ag GROUP BY 1)
    SELECT aa.*, {ARRIVAL_COLUMNS} FROM aa {ARRIVAL_JOINS}""")
def q_pre_arrival(spark, sf_dir):
    """Forecasts issued one to three days before a shock, on the 24 hours from its arrival on, and those of its day for the day after; with the rise they foresee and the rise that came, and
    what error, bias and rise differ from the first seed's, with intervals from 2,000 resamples of shocks."""
    f = with_first_seed(A.forecast_3h(spark, sf_dir)).select("issue_date", F.expr("cast(date_add(issue_date, target_day_k) as timestamp_ntz) + make_dt_interval(0, 3 * ((lead_step_3h - 1) % 8))").alias("time"), "p", "p0")
    i = catalog_of(spark, sf_dir, "signup", 2).select(F.col("event_id").alias("shock_id"), F.col("ts").alias("shock"), "day", F.explode(F.sequence(F.lit(0), F.lit(3))).alias("days_before"))
    g = i.select("shock_id", "shock", "days_before", F.expr("date_sub(day, days_before)").alias("issue_date"))
    j = g.join(f, "issue_date").join(A.bins_3h(spark, sf_dir).where("ap is not null").select("time", "ap"), "time")
    after = F.expr("time >= cast(date_add(issue_date, 1) as timestamp_ntz) and time < cast(date_add(issue_date, 2) as timestamp_ntz)")
    post = F.when(F.col("days_before") == 0, after).otherwise(F.expr("time + interval 3 hours > shock and time < shock + interval 24 hours"))
    j = j.withColumns({"post": post, "pre": F.expr("time + interval 3 hours <= shock")})
    mean = lambda c, when: F.avg(F.when(F.col(when), c))
    p, p0, ap = F.col("p"), F.col("p0"), F.col("ap")
    rise = lambda c: mean(c, "post") - mean(c, "pre")
    s = j.groupBy("shock_id", "days_before").agg(
        mean(F.abs(p - ap), "post").alias("mae"), mean(p - ap, "post").alias("bias"), (mean(ap, "post") - mean(ap, "pre")).alias("obs_rise"), (mean(p, "post") - mean(p, "pre")).alias("rise"), (F.max(F.when(F.col("post"), p)) >= 30).alias("detected"),
        (mean(F.abs(p - ap), "post") - mean(F.abs(p0 - ap), "post")).alias("d_mae"), (mean(p - ap, "post") - mean(p0 - ap, "post")).alias("d_bias"), (rise(p) - rise(p0)).alias("d_rise"),
    ).where("mae is not null")
    group = F.when(F.col("days_before") == 0, "after arrival").otherwise(F.concat("days_before", F.lit(" days before")))
    s = cut(s.withColumn("lead_group", group))  # a row for each shock and issue
    means = s.groupBy("lead_group").agg(
        F.count(F.lit(1)).alias("n"), r6(F.avg("mae")).alias("mae"), r6(F.avg("bias")).alias("me"), r6(F.avg("obs_rise")).alias("obs_rise"), r6(F.avg("rise")).alias("rise"), r6(F.avg(F.col("detected").cast("double"))).alias("detect")
    )
    return means.join(bootstrap_means(s, ["d_mae", "d_bias", "d_rise"], F.col("shock_id"), ["lead_group"], slices=SLICES), "lead_group")


@query(f"""WITH {ENS} SELECT issue_date + target_day_k AS valid_date, target_day_k, CAST((lead_step_3h - 1) % 8 AS INTEGER) AS bin, round(p, 6) + 0.0 AS p FROM ens WHERE target_day_k = 2""")
def q_chained(spark, sf_dir):
    """Each day's forecast from the issue two days before, as one series."""
    e = ensemble(A.forecast_3h(spark, sf_dir)).where("target_day_k = 2")
    return e.select(F.expr("date_add(issue_date, target_day_k)").alias("valid_date"), "target_day_k", ((F.col("lead_step_3h") - 1) % 8).alias("bin"), r6(F.col("p")).alias("p"))


@query(f"""WITH {DAY3}, r AS (SELECT target_day_k, rank() OVER (PARTITION BY target_day_k ORDER BY round(p, 9)) + (count(*) OVER (PARTITION BY target_day_k, round(p, 9)) - 1) / 2.0 AS rp,
        rank() OVER (PARTITION BY target_day_k ORDER BY round(y, 9)) + (count(*) OVER (PARTITION BY target_day_k, round(y, 9)) - 1) / 2.0 AS ry FROM day3)
    SELECT target_day_k, count(*) AS n, {corr_sql('rp', 'ry')} AS spearman FROM r GROUP BY 1""")
def q_spearman(spark, sf_dir):
    """Pearson correlation of average ranks."""
    d = day_means(ensemble(A.forecast_3h(spark, sf_dir))).select("target_day_k", F.round("p", 9).alias("p"), F.round("y", 9).alias("y"))
    rank = lambda c: F.rank().over(Window.partitionBy("target_day_k").orderBy(c)) + (F.count(F.lit(1)).over(Window.partitionBy("target_day_k", c)) - 1) / 2.0
    r = d.select("target_day_k", rank("p").alias("rp"), rank("y").alias("ry"))
    return r.groupBy("target_day_k").agg(F.count(F.lit(1)).alias("n"), r6(safe_corr("rp", "ry")).alias("spearman"))


@query(f"""WITH RECURSIVE {EVENTS}, o AS (SELECT event_id, ts FROM ips), m(event_id, ts) AS (SELECT min_by(event_id, (ts, event_id)), min(ts) FROM o UNION ALL
        SELECT n.event_id, n.ts FROM m, LATERAL (SELECT min_by(event_id, (ts, event_id)) AS event_id, min(ts) AS ts FROM o WHERE o.ts > m.ts + INTERVAL 48 HOUR) n WHERE n.ts IS NOT NULL)
    SELECT event_id, ts FROM m WHERE ts IS NOT NULL""")
def q_merge_storms(spark, sf_dir):
    """Shocks more than 48 hours after the last one kept."""
    return merge_events(catalog_of(spark, sf_dir, "signup", 2), [], "ts", "event_id", 48 * 3600).select("event_id", "ts")


@query(f"""WITH {A.DAILY}, k AS (SELECT a.date, max(least(a2.ap, b.ap)) AS s FROM daily a CROSS JOIN generate_series(1, 26) AS g(k) JOIN daily a2 ON a2.date = a.date - CAST(k AS INTEGER) AND a2.ap >= 30
        JOIN daily b ON b.date = a.date + CAST(27 - k AS INTEGER) GROUP BY 1) SELECT date, round(s, 6) + 0.0 AS score FROM k WHERE s IS NOT NULL AND dayofweek(date) = 1""")
def q_recurrent_case(spark, sf_dir):
    """For each Monday the largest min of a disturbed day in the history and the day 27 days after it."""
    s = A.daily(spark, sf_dir).where("ap is not null").select("date", "ap")
    pairs = s.where("ap >= 30").select(F.date_add("date", 27).alias("date"), F.col("ap").alias("x"), F.col("date").alias("hd")).join(s, "date")
    shown = pairs.select(F.least("x", "ap").alias("v"), F.explode(F.sequence(F.date_add("hd", 1), F.date_add("hd", 26))).alias("date"))
    days = A.daily(spark, sf_dir).where(F.dayofweek("date") == 2).select("date")
    return shown.join(days, "date", "left_semi").groupBy("date").agg(r6(F.max("v")).alias("score"))


CASES = A.DAILY + """, c0 AS (SELECT date, max(struct_pack(ap := ap, early := DATE '2100-01-01' - date, day := date)) FILTER (ap IS NOT NULL) OVER o AS m, count(ap) OVER o AS n FROM daily WINDOW o AS (ORDER BY date ROWS BETWEEN 1 FOLLOWING AND 60 FOLLOWING)),
    c1 AS (SELECT date, m.ap AS peak, m.day - date AS lead, m.day AS peak_date FROM c0 WHERE n >= 55 AND dayofweek(date) = 1),
    cases AS (SELECT *, CASE WHEN peak < 35 THEN 4 WHEN lead <= 7 THEN 1 WHEN lead <= 26 THEN 2 ELSE 3 END AS kind FROM c1), used0 AS (SELECT NULL::INTEGER AS kind, NULL::DATE AS date, NULL::DATE AS peak_date WHERE false)"""
GREEDY = ", ".join(
    f"""pick{k} AS (SELECT kind, date, peak_date FROM cases c WHERE kind = {k} AND NOT EXISTS (SELECT 1 FROM used{k - 1} u WHERE abs(c.peak_date - u.peak_date) <= 5) ORDER BY {"peak" if k == 4 else "-peak"}, date LIMIT 1),
    used{k} AS (SELECT * FROM used{k - 1} UNION ALL SELECT * FROM pick{k})"""
    for k in (1, 2, 3, 4)
)


@query(f"WITH {CASES}, {GREEDY} SELECT kind, date, peak_date FROM used4")
def q_pick_cases(spark, sf_dir):
    """Per case type the best Monday whose peak is more than 5 days from peaks already used (a fold over few candidates)."""
    s = A.daily(spark, sf_dir)
    w = series_window("date").rowsBetween(1, 60)
    y = s.select("date", F.max(F.struct("ap", F.datediff("date", F.lit("2100-01-01").cast("date")) * -1, "date")).over(w).alias("m"), F.count("ap").over(w).alias("n")).where((F.dayofweek("date") == 2) & (F.col("n") >= 55))
    c = y.select("date", F.col("m.ap").alias("peak"), F.datediff("m.date", "date").alias("lead"), F.col("m.date").alias("peak_date"))
    kind = F.when(F.col("peak") < 35, 4).when(F.col("lead") <= 7, 1).when(F.col("lead") <= 26, 2).otherwise(3)
    ranked = c.withColumn("kind", kind).withColumn("rn", F.row_number().over(Window.partitionBy("kind").orderBy(F.when(F.col("kind") == 4, F.col("peak")).otherwise(-F.col("peak")), "date")))
    # of candidates whose peaks are on one day only the first can be picked; a case is rejected by the peaks of
    # three others at most, which reject 11 days each: the first 34 peak days of a kind hold its pick
    first = ranked.groupBy("kind", "peak_date").agg(F.min(F.struct("rn", "date")).alias("m")).select("kind", "peak_date", "m.rn", "m.date")
    few = first.withColumn("k", F.row_number().over(Window.partitionBy("kind").orderBy("rn"))).where("k <= 34")
    few = few.groupBy().agg(F.array_sort(F.collect_list(F.struct("kind", "rn", "date", "peak_date"))).alias("items"))
    start = F.expr("cast(array() as array<struct<kind:int, rn:int, date:date, peak_date:date>>)")
    far = lambda acc, x: ~F.exists(acc, lambda k: (k["kind"] == x["kind"]) | (F.abs(F.datediff(k["peak_date"], x["peak_date"])) <= 5))
    picked = F.aggregate("items", start, lambda acc, x: F.when(far(acc, x), F.concat(acc, F.array(x))).otherwise(acc))
    return few.select(F.explode(picked).alias("c")).select(F.col("c.kind").alias("kind"), F.col("c.date").alias("date"), F.col("c.peak_date").alias("peak_date"))


@query("""WITH e AS (SELECT DISTINCT event_type, user_id, ts, event_id FROM events), r AS (SELECT *, row_number() OVER (PARTITION BY event_type, user_id ORDER BY ts, event_id) AS rn FROM e) SELECT event_type, user_id, event_id FROM r WHERE rn = 1""")
def q_dedup_events(spark, sf_dir):
    """The first event of each type and user."""
    e = A.read(spark, sf_dir, "events")
    return e.groupBy("event_type", "user_id").agg(F.min_by("event_id", F.struct("ts", "event_id")).alias("event_id"))


@query(f"""WITH {A.DAILY}, b AS (SELECT d.date, year(d.date) AS yr, d.ap AS y, p.ap AS pers, r.ap AS rec FROM daily d JOIN daily p ON p.date = d.date - 1 JOIN daily r ON r.date = d.date - 27
        WHERE d.ap IS NOT NULL AND p.ap IS NOT NULL AND r.ap IS NOT NULL), w AS (SELECT CAST(i AS INTEGER) AS i, i / 20.0 AS w FROM generate_series(0, 20) AS g(i)),
    s AS (SELECT yr, i, sum(abs(y - (w * pers + (1 - w) * rec))) AS e, count(*) AS n FROM b, w GROUP BY 1, 2), t AS (SELECT i, sum(e) AS te, sum(n) AS tn FROM s GROUP BY 1),
    l AS (SELECT s.yr, s.i, (te - e) / (tn - n) AS mae_other, e / n AS mae_own FROM s JOIN t USING (i)), m AS (SELECT yr, min_by(i, (round(mae_other, 9), i)) AS i FROM l GROUP BY 1)
    SELECT CAST(l.yr AS INTEGER) AS year, l.i / 20.0 AS weight, round(mae_own, 6) + 0.0 AS mae FROM l JOIN m ON m.yr = l.yr AND m.i = l.i""")
def q_blend_loo(spark, sf_dir):
    """The blend weight that is best on all other years, applied to each year."""
    b = baselines(A.daily(spark, sf_dir), leads=(1,)).where("y is not null and persistence is not null and recurrence27 is not null")
    rows = b.select(F.year(F.date_add("date", 1)).alias("year"), "y", "persistence", "recurrence27", F.explode(F.sequence(F.lit(0), F.lit(20))).alias("i"))
    w = F.col("i") / 20.0
    s = rows.groupBy("year", "i").agg(F.sum(F.abs(F.col("y") - (w * F.col("persistence") + (1 - w) * F.col("recurrence27")))).alias("e"), F.count(F.lit(1)).alias("n"))
    over = Window.partitionBy("i")
    l = s.select("year", "i", ((F.sum("e").over(over) - F.col("e")) / (F.sum("n").over(over) - F.col("n"))).alias("other"), (F.col("e") / F.col("n")).alias("own"))
    best = l.groupBy("year").agg(F.min(F.struct(F.round("other", 9).alias("o"), "i", "own")).alias("m"))
    return best.select("year", (F.col("m.i") / 20.0).alias("weight"), r6(F.col("m.own")).alias("mae"))
