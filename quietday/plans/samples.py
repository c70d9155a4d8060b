"""Samples and reference forecasts: lags, recurrence, windows, splits, issue days."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quietday.functions.columns import r6, recurrence_lag
from quietday.operators.grids import feature_windows, make_windows, run_complete, series_window, split_ranges, split_years
from quietday.plans.registry import query
from quietday.sources import adapters as A

#: All leads of the forecasts; a list of some is an argument.
LEADS = tuple(range(1, 61))


def with_leads(series: DataFrame, leads=LEADS) -> DataFrame:
    return series.withColumn("lead", F.explode(F.array(*[F.lit(x) for x in leads])))


def looked_up(issues: DataFrame, series: DataFrame, days, name: str) -> DataFrame:
    """`issues` with the series value `days` after the issue date, null where there is none."""
    other = series.select(F.col("date").alias("_d"), F.col("ap").alias(name))
    return issues.withColumn("_d", F.date_add("date", days)).join(other, "_d", "left").drop("_d")


def recurrence(issues: DataFrame, series: DataFrame, rotations: int, name: str) -> DataFrame:
    """The mean of the analogues of the last `rotations` usable rotations; missing ones are skipped."""
    parts = []
    for back in range(rotations):
        issues = looked_up(issues, series, -recurrence_lag(F.col("lead"), back=back).cast("int"), f"_r{back}")
        parts.append(F.col(f"_r{back}"))
    given = F.filter(F.array(*parts), lambda x: x.isNotNull())
    mean = F.when(F.size(given) > 0, F.aggregate(given, F.lit(0.0), lambda a, x: a + x) / F.size(given))
    return issues.withColumn(name, mean).drop(*[f"_r{b}" for b in range(rotations)])


def baselines(series: DataFrame, leads=LEADS, train_end: str = "1998-12-31") -> DataFrame:
    """date, lead, y and the four reference forecasts on their issue dates."""
    mean = series.where(F.col("date") <= F.lit(train_end).cast("date")).agg(F.avg("ap").alias("climatology"))
    issues = with_leads(series.select("date", F.col("ap").alias("persistence")), leads)
    out = recurrence(recurrence(issues, series, 1, "recurrence27"), series, 2, "recurrence2x27")
    out = looked_up(out, series, F.col("lead"), "y")
    return out.crossJoin(F.broadcast(mean))


LEADS_SQL = "leads AS (SELECT unnest(range(1, 61)) AS lead)"
BASE_SQL = A.DAILY + f""", {LEADS_SQL}, base AS (
    SELECT d.date, CAST(l.lead AS INTEGER) AS lead, d.ap AS persistence, r0.ap AS r0, r1.ap AS r1, t.ap AS y, (SELECT avg(ap) FROM daily WHERE date <= DATE '1998-12-31') AS climatology
    FROM daily d CROSS JOIN leads l
    LEFT JOIN daily r0 ON r0.date = d.date - CAST(27 * ceil(l.lead / 27.0) - l.lead AS INTEGER)
    LEFT JOIN daily r1 ON r1.date = d.date - CAST(27 * (ceil(l.lead / 27.0) + 1) - l.lead AS INTEGER)
    LEFT JOIN daily t ON t.date = d.date + CAST(l.lead AS INTEGER)),
    fb AS (SELECT date, lead, y, climatology, persistence, r0 AS recurrence27,
        CASE WHEN r0 IS NOT NULL AND r1 IS NOT NULL THEN (r0 + r1) / 2 ELSE coalesce(r0, r1) END AS recurrence2x27 FROM base)"""


@query(f"WITH {BASE_SQL} SELECT date, lead, round(persistence, 6) + 0.0 AS fc, round(y, 6) + 0.0 AS y FROM fb")
def q_persistence(spark, sf_dir):
    s = A.daily(spark, sf_dir)
    t = looked_up(with_leads(s.select("date", F.col("ap").alias("fc"))), s, F.col("lead"), "y")
    return t.select("date", "lead", r6(F.col("fc")).alias("fc"), r6(F.col("y")).alias("y"))


@query("""WITH l AS (SELECT CAST(date_diff('day', o_orderdate, l_shipdate) AS INTEGER) AS lead, count(*) AS n FROM orders JOIN lineitem ON o_orderkey = l_orderkey GROUP BY 1)
    SELECT lead, CAST(b AS INTEGER) AS back, CAST(27 * (ceil(lead / 27.0) + b) - lead AS BIGINT) AS lag, n FROM l, generate_series(0, 1) AS c(b) WHERE lead > 0""")
def q_recurrence_lag(spark, sf_dir):
    """For each lead of the tables (days from an order to its shipping, with their number): how many days back the analogue one and two rotations earlier is."""
    o, l = A.read(spark, sf_dir, "orders").select("o_orderkey", "o_orderdate"), A.read(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("o_orderkey"), "l_shipdate")
    t = o.join(l, "o_orderkey").groupBy(F.datediff("l_shipdate", "o_orderdate").alias("lead")).agg(F.count(F.lit(1)).alias("n")).where("lead > 0")
    t = t.withColumn("back", F.explode(F.array(F.lit(0), F.lit(1))))
    return t.select("lead", "back", recurrence_lag(F.col("lead"), back=F.col("back")).cast("long").alias("lag"), "n")


@query(f"WITH {BASE_SQL} SELECT date, lead, round(recurrence27, 6) + 0.0 AS fc FROM fb")
def q_recurrence27(spark, sf_dir):
    s = A.daily(spark, sf_dir)
    return recurrence(with_leads(s.select("date")), s, 1, "fc").select("date", "lead", r6(F.col("fc")).alias("fc"))


@query(f"WITH {BASE_SQL} SELECT date, lead, round(recurrence2x27, 6) + 0.0 AS fc FROM fb")
def q_recurrence2x27(spark, sf_dir):
    s = A.daily(spark, sf_dir)
    return recurrence(with_leads(s.select("date")), s, 2, "fc").select("date", "lead", r6(F.col("fc")).alias("fc"))


@query(f"""WITH {A.DAILY}, w AS (SELECT date, row_number() OVER (ORDER BY date) AS rn, list(ap) OVER (ORDER BY date ROWS BETWEEN 9 PRECEDING AND CURRENT ROW) AS x,
        count(ap) OVER (ORDER BY date ROWS BETWEEN 9 PRECEDING AND CURRENT ROW) AS nx, list(ap) OVER (ORDER BY date ROWS BETWEEN 1 FOLLOWING AND 5 FOLLOWING) AS y,
        count(ap) OVER (ORDER BY date ROWS BETWEEN 1 FOLLOWING AND 5 FOLLOWING) AS ny FROM daily)
    SELECT date, round(x[1], 6) + 0.0 AS x_first, round(x[10], 6) + 0.0 AS x_last, round(y[1], 6) + 0.0 AS y_first, round(y[5], 6) + 0.0 AS y_last FROM w
    WHERE nx = 10 AND ny = 5 AND (rn - 10) % 3 = 0""")
def q_make_windows(spark, sf_dir):
    w = make_windows(A.daily(spark, sf_dir), "ap", 10, 5, "date", stride=3)
    at = lambda c, i: r6(F.element_at(c, i))
    return w.select("date", at("x", 1).alias("x_first"), at("x", -1).alias("x_last"), at("y", 1).alias("y_first"), at("y", -1).alias("y_last"))


@query(f"""WITH {A.DAILY}, w AS (SELECT date, count(CASE WHEN ap IS NOT NULL AND f107 IS NOT NULL THEN 1 END) OVER r AS n, sum(ap) OVER r AS sa, sum(f107) OVER r AS sf,
        lead(ap, 1) OVER (ORDER BY date) AS y FROM daily WINDOW r AS (ORDER BY date ROWS BETWEEN 6 PRECEDING AND CURRENT ROW))
    SELECT date, round(sa, 6) + 0.0 AS sum_ap, sf AS sum_f107, round(y, 6) + 0.0 AS y FROM w WHERE n = 7 AND y IS NOT NULL""")
def q_feature_windows(spark, sf_dir):
    w = feature_windows(A.daily(spark, sf_dir), ["ap", "f107"], "ap", 7, "date")
    total = lambda f: F.aggregate("x", F.lit(0.0), lambda a, s: a + s[f])
    return w.select("date", r6(total("ap")).alias("sum_ap"), total("f107").alias("sum_f107"), r6(F.col("y")).alias("y"))


@query(f"""WITH {A.BINS}, w AS (SELECT time, count(ap) OVER b AS nx, sum(ap) OVER b AS sx, count(ap) OVER a AS ny, sum(ap) OVER a AS sy FROM bins
        WINDOW b AS (ORDER BY time ROWS BETWEEN 16 PRECEDING AND 1 PRECEDING), a AS (ORDER BY time ROWS BETWEEN CURRENT ROW AND 7 FOLLOWING))
    SELECT CAST(time AS DATE) - 1 AS issue_date, round(sx, 6) + 0.0 AS sum_x, round(sy, 6) + 0.0 AS sum_y FROM w WHERE hour(time) = 0 AND nx = 16 AND ny = 8""")
def q_windows_3h(spark, sf_dir):
    w = make_windows(A.bins_3h(spark, sf_dir), "ap", 16, 8, "time").where("hour(time) = 21")  # the last bin of the issue day
    total = lambda c: F.aggregate(c, F.lit(0.0), lambda a, x: a + x)
    return w.select(F.to_date("time").alias("issue_date"), r6(total("x")).alias("sum_x"), r6(total("y")).alias("sum_y"))


ISSUE_SQL = A.DAILY + """, ok AS (SELECT date, count(CASE WHEN ap IS NOT NULL AND f107 IS NOT NULL THEN 1 END) OVER (ORDER BY date ROWS BETWEEN 6 PRECEDING AND CURRENT ROW) AS n,
        lead(ap) OVER (ORDER BY date) AS y FROM daily), img AS (SELECT DATE '1995-01-01' + CAST(vec_id * 3 AS INTEGER) AS date FROM embeddings),
    issue AS (SELECT date FROM ok WHERE n = 7 AND y IS NOT NULL AND date IN (SELECT date FROM img))"""


def common_issue_days(spark, sf_dir, first: str | None = None, last: str | None = None) -> DataFrame:
    """Days with a complete history of all features, a target, and an image, from `first` to `last` if given."""
    s = A.daily(spark, sf_dir)
    ok = run_complete(F.col("ap").isNotNull() & F.col("f107").isNotNull(), 7, "date")
    days = s.select("date", ok.alias("ok"), F.lead("ap").over(series_window("date")).alias("y"))
    days = days.where("ok and y is not null").select("date")
    days = days.where(F.col("date") >= F.lit(first).cast("date")) if first else days
    days = days.where(F.col("date") <= F.lit(last).cast("date")) if last else days
    images = A.read(spark, sf_dir, "embeddings").select(F.date_add(F.lit("1995-01-01").cast("date"), (F.col("vec_id") * 3).cast("int")).alias("date"))
    return days.join(images, "date", "left_semi")


@query(f"WITH {ISSUE_SQL} SELECT date FROM issue")
def q_common_issue_days(spark, sf_dir):
    return common_issue_days(spark, sf_dir)


SPEC = {"train": ("1995-01-01", "1998-12-31"), "val": ("1999-01-01", "1999-12-31"), "test": ("2000-01-01", "2001-12-31")}
SPLIT_SQL = "CASE WHEN date BETWEEN DATE '1995-01-01' AND DATE '1998-12-31' THEN 'train' WHEN date BETWEEN DATE '1999-01-01' AND DATE '1999-12-31' THEN 'val' WHEN date BETWEEN DATE '2000-01-01' AND DATE '2001-12-31' THEN 'test' END"


@query(f"WITH {A.DAILY} SELECT {SPLIT_SQL} AS split, count(*) AS n, min(date) AS first, max(date) AS last FROM daily GROUP BY 1")
def q_split_range(spark, sf_dir):
    return A.daily(spark, sf_dir).groupBy(split_ranges(F.col("date"), SPEC).alias("split")).agg(F.count(F.lit(1)).alias("n"), F.min("date").alias("first"), F.max("date").alias("last"))


@query(f"WITH {A.DAILY} SELECT date, CASE WHEN year(date) = 2000 THEN 'test' WHEN year(date) IN (1998, 1999) THEN 'val' ELSE 'train' END AS split FROM daily")
def q_split_years(spark, sf_dir):
    return A.daily(spark, sf_dir).select("date", split_years(F.col("date"), [2000], [1998, 1999]).alias("split"))


@query(f"""WITH {A.DAILY}, s AS (SELECT date, {SPLIT_SQL} AS split FROM daily), r AS (SELECT *, row_number() OVER (PARTITION BY split ORDER BY date) AS rn FROM s)
    SELECT date, split FROM r WHERE rn <= 5""")
def q_topn_per_split(spark, sf_dir):
    s = A.daily(spark, sf_dir).select("date", split_ranges(F.col("date"), SPEC).alias("split"))
    return s.withColumn("rn", F.row_number().over(Window.partitionBy("split").orderBy("date"))).where("rn <= 5").drop("rn")


@query(f"""WITH {A.BINS} SELECT CAST(t.time AS DATE) - CAST(k AS INTEGER) AS issue_date, t.time, round(p.ap, 6) + 0.0 AS persistence, round(r.ap, 6) + 0.0 AS recurrence27
    FROM bins t CROSS JOIN generate_series(1, 3) AS g(k) JOIN bins p ON p.time = t.time - to_days(CAST(k AS INTEGER)) LEFT JOIN bins r ON r.time = t.time - INTERVAL 27 DAY""")
def q_persistence_3h(spark, sf_dir):
    b = A.bins_3h(spark, sf_dir).select("time", "ap")
    t = b.select("time", F.explode(F.sequence(F.lit(1), F.lit(3))).alias("k"))
    p = b.select(F.col("time").alias("pt"), F.col("ap").alias("persistence"))
    r = b.select(F.col("time").alias("rt"), F.col("ap").alias("recurrence27"))
    t = t.withColumns({"pt": F.expr("time - make_dt_interval(k)"), "rt": F.expr("time - interval 27 days")})
    j = t.join(p, "pt").join(r, "rt", "left")
    return j.select(F.date_sub(F.to_date("time"), F.col("k")).alias("issue_date"), "time", r6(F.col("persistence")).alias("persistence"), r6(F.col("recurrence27")).alias("recurrence27"))


@query(f"""WITH {A.DAILY}, w AS (SELECT date, list(ap) OVER r AS x, count(ap) OVER r AS n FROM daily WINDOW r AS (ORDER BY date ROWS BETWEEN 29 PRECEDING AND CURRENT ROW))
    SELECT date, CAST(h AS INTEGER) AS lead, CASE WHEN (27 * ceil(h / 27.0) - h) < 30 THEN round(x[CAST(30 - (27 * ceil(h / 27.0) - h) AS INTEGER)], 6) + 0.0 END AS fc
    FROM w, (SELECT unnest(range(1, 61)) AS h) WHERE n = 30""")
def q_window_recurrence(spark, sf_dir):
    w = _history(A.daily(spark, sf_dir), 30)
    lag = recurrence_lag(F.col("lead")).cast("int")
    return with_leads(w).select("date", "lead", r6(F.when(lag < 30, F.get("x", 29 - lag))).alias("fc"))


def _history(series: DataFrame, length: int) -> DataFrame:
    x = F.collect_list("ap").over(series_window("date").rowsBetween(-(length - 1), 0))
    return series.select("date", x.alias("x")).where(F.size("x") == length)


@query(f"""WITH {A.DAILY}, w AS (SELECT date, CAST(l AS INTEGER) AS history, count(ap) OVER (PARTITION BY l ORDER BY date ROWS BETWEEN 6 PRECEDING AND CURRENT ROW) AS n7,
        CASE l WHEN 3 THEN count(ap) OVER (PARTITION BY l ORDER BY date ROWS BETWEEN 2 PRECEDING AND CURRENT ROW) WHEN 5 THEN count(ap) OVER (PARTITION BY l ORDER BY date ROWS BETWEEN 4 PRECEDING AND CURRENT ROW)
        ELSE count(ap) OVER (PARTITION BY l ORDER BY date ROWS BETWEEN 6 PRECEDING AND CURRENT ROW) END AS n FROM daily, (SELECT unnest([3, 5, 7]) AS l))
    SELECT history, count(CASE WHEN n = history THEN 1 END) AS n_windows FROM w GROUP BY 1""")
def q_window_counts(spark, sf_dir):
    s = A.daily(spark, sf_dir)
    flags = s.select("date", *[run_complete(F.col("ap").isNotNull(), n, "date").alias(str(n)) for n in (3, 5, 7)])
    return flags.unpivot("date", ["3", "5", "7"], "history", "ok").groupBy(F.col("history").cast("int").alias("history")).agg(F.count_if("ok").alias("n_windows"))


@query(f"""WITH {ISSUE_SQL} SELECT date FROM issue WHERE date NOT IN (SELECT CAST(o_orderdate AS DATE) FROM orders WHERE o_orderpriority = '1-URGENT' AND o_totalprice > 400000)""")
def q_todo_anti(spark, sf_dir):
    done = A.read(spark, sf_dir, "orders").where("o_orderpriority = '1-URGENT' and o_totalprice > 400000").select(F.to_date("o_orderdate").alias("date"))
    return common_issue_days(spark, sf_dir).join(done, "date", "left_anti")
