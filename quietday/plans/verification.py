"""Forecast verification: scores, contingency, by lead, day and step, ensembles, references."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quietday.functions.columns import contingency, gaussian_nll, r6, safe_corr, score
from quietday.functions.distributions import mixture, normal_cdf
from quietday.operators.bootstrap import block_bootstrap, block_bootstrap_sql, bootstrap_mean, bootstrap_mean_sql
from quietday.plans.registry import query
from quietday.plans.samples import BASE_SQL, baselines, looked_up
from quietday.sources import adapters as A

MODELS = ["climatology", "persistence", "recurrence27", "recurrence2x27"]
LONG_SQL = BASE_SQL + ", fl AS (" + " UNION ALL ".join(f"SELECT date, lead, '{m}' AS model, y, {m} AS f FROM fb" for m in MODELS) + ")"


def corr_sql(a: str, b: str, least: int = 0) -> str:
    both = f"FILTER ({a} IS NOT NULL AND {b} IS NOT NULL)"
    return (
        f"CASE WHEN count(*) {both} >= {least} AND stddev_pop({a}) {both} > 1e-12 * (1 + abs(avg({a}) {both})) AND stddev_pop({b}) {both} > 1e-12 * (1 + abs(avg({b}) {both})) "
        f"THEN round(corr({a}, {b}), 6) + 0.0 END"
    )


def score_sql(y: str = "y", f: str = "f", t: float = 30.0) -> str:
    n = lambda c: f"count(CASE WHEN {c} THEN 1 END)"
    h, m, x = n(f"{y} >= {t} AND {f} >= {t}"), n(f"{y} >= {t} AND {f} < {t}"), n(f"{y} < {t} AND {f} >= {t}")
    return f"""count({y} - {f}) AS n, round(avg(abs({y} - {f})), 6) + 0.0 AS mae, round(sqrt(avg(({y} - {f}) * ({y} - {f}))), 6) + 0.0 AS rmse,
        round(avg(abs(ln(1 + {y}) - ln(1 + {f}))), 6) + 0.0 AS log_mae, {corr_sql(y, f, 3)} AS corr,
        round({h} / nullif({h} + {m}, 0), 6) + 0.0 AS pod, round({x} / nullif({h} + {x}, 0), 6) + 0.0 AS far, round({h} / nullif({h} + {m} + {x}, 0), 6) + 0.0 AS csi,
        {h} + {m} AS n_events, {h} + {x} AS n_forecast"""


def long_form(wide: DataFrame, models=MODELS) -> DataFrame:
    """date, lead, y, model, f."""
    return wide.select("date", "lead", "y", *models).unpivot(["date", "lead", "y"], list(models), "model", "f")


@query(f"WITH {LONG_SQL} SELECT {score_sql()} FROM fl WHERE model = 'recurrence27' AND lead = 27")
def q_score(spark, sf_dir):
    return long_form(baselines(A.daily(spark, sf_dir))).where("model = 'recurrence27' and lead = 27").agg(*score("y", "f"))


@query(f"WITH {LONG_SQL} SELECT model, lead, {score_sql()} FROM fl GROUP BY 1, 2")
def q_eval_baselines(spark, sf_dir):
    return long_form(baselines(A.daily(spark, sf_dir))).groupBy("model", "lead").agg(*score("y", "f"))


@query(f"""WITH {LONG_SQL}, c AS (SELECT model, lead, count(CASE WHEN y >= 35 AND f >= 35 THEN 1 END) AS h, count(CASE WHEN y >= 35 AND f < 35 THEN 1 END) AS m, count(CASE WHEN y < 35 AND f >= 35 THEN 1 END) AS x FROM fl GROUP BY 1, 2)
    SELECT model, lead, round(h / nullif(h + m, 0), 6) + 0.0 AS pod, round(x / nullif(h + x, 0), 6) + 0.0 AS far, round(h / nullif(h + m + x, 0), 6) + 0.0 AS csi, h + m AS n_events, h + x AS n_forecast FROM c""")
def q_storm_scores(spark, sf_dir):
    c = contingency("y", "f", 35.0)
    return long_form(baselines(A.daily(spark, sf_dir))).groupBy("model", "lead").agg(*[(v if k.startswith("n") else r6(v)).alias(k) for k, v in c.items()])


def outlook_with_refs(spark, sf_dir) -> DataFrame:
    """The outlook with the observation and the reference forecasts of its issue date."""
    s = A.daily(spark, sf_dir)
    o = A.outlook(spark, sf_dir).withColumn("date", F.col("issue_date"))
    o = looked_up(o, s, F.col("lead"), "y")
    o = looked_up(o, s, F.lit(0), "persistence")
    return looked_up(o, s, -(27 * F.ceil(F.col("lead") / 27) - F.col("lead")).cast("int"), "recurrence27").drop("date")


REFS = A.OUTLOOK + """, orefs AS (SELECT o.issue_date, o.target_date, o.lead, o.fc, t.ap AS y, p.ap AS persistence, r.ap AS recurrence27 FROM outlook o
    LEFT JOIN daily t ON t.date = o.target_date LEFT JOIN daily p ON p.date = o.issue_date LEFT JOIN daily r ON r.date = o.issue_date - CAST(27 * ceil(o.lead / 27.0) - o.lead AS INTEGER))"""


@query(f"WITH {REFS} SELECT issue_date, lead, round(y, 6) + 0.0 AS y, round(persistence, 6) + 0.0 AS persistence, round(recurrence27, 6) + 0.0 AS recurrence27 FROM orefs")
def q_attach_refs(spark, sf_dir):
    o = outlook_with_refs(spark, sf_dir)
    return o.select("issue_date", "lead", *[r6(F.col(c)).alias(c) for c in ("y", "persistence", "recurrence27")])


@query(f"""WITH {REFS}, l AS (SELECT lead, 'fc' AS model, y, fc AS f FROM orefs UNION ALL SELECT lead, 'persistence', y, persistence FROM orefs UNION ALL SELECT lead, 'recurrence27', y, recurrence27 FROM orefs)
    SELECT model, lead, count(y) AS n, round(avg(abs(y - f)), 6) + 0.0 AS mae, {corr_sql("y", "f")} AS cc FROM l GROUP BY 1, 2""")
def q_eval_outlook(spark, sf_dir):
    l = outlook_with_refs(spark, sf_dir).select("lead", "y", "fc", "persistence", "recurrence27").unpivot(["lead", "y"], ["fc", "persistence", "recurrence27"], "model", "f")
    return l.groupBy("model", "lead").agg(F.count("y").alias("n"), r6(F.avg(F.abs(F.col("y") - F.col("f")))).alias("mae"), r6(safe_corr("y", "f")).alias("cc"))


@query(f"""WITH {REFS}, l AS (SELECT lead, 'persistence' AS model, y, persistence AS f FROM orefs UNION ALL SELECT lead, 'recurrence27', y, recurrence27 FROM orefs
        UNION ALL SELECT lead, 'blend', y, CASE WHEN lead <= 2 THEN persistence ELSE recurrence27 END FROM orefs), b AS (SELECT * FROM l WHERE y IS NOT NULL AND f IS NOT NULL AND lead BETWEEN 3 AND 26)
    SELECT model, {corr_sql("y", "f")} AS cc, round(avg(abs(y - f)), 6) + 0.0 AS mae, round(stddev_pop(f) / stddev_pop(y), 6) + 0.0 AS std_ratio,
        round(count(CASE WHEN y >= 30 AND f >= 30 THEN 1 END) / nullif(count(CASE WHEN y >= 30 THEN 1 END), 0), 6) + 0.0 AS pod, count(CASE WHEN f >= 30 THEN 1 END) AS n_forecast FROM b GROUP BY 1""")
def q_null_models(spark, sf_dir):
    o = outlook_with_refs(spark, sf_dir).withColumn("blend", F.when(F.col("lead") <= 2, F.col("persistence")).otherwise(F.col("recurrence27")))
    l = o.select("lead", "y", "persistence", "recurrence27", "blend").unpivot(["lead", "y"], ["persistence", "recurrence27", "blend"], "model", "f")
    b = l.where("y is not null and f is not null and lead between 3 and 26")
    hits = F.count_if((F.col("y") >= 30) & (F.col("f") >= 30))
    return b.groupBy("model").agg(
        r6(safe_corr("y", "f")).alias("cc"), r6(F.avg(F.abs(F.col("y") - F.col("f")))).alias("mae"), r6(F.stddev_pop("f") / F.stddev_pop("y")).alias("std_ratio"),
        r6(F.try_divide(hits, F.count_if(F.col("y") >= 30))).alias("pod"), F.count_if(F.col("f") >= 30).alias("n_forecast"),
    )


@query(f"""WITH {REFS}, ours AS (SELECT date AS issue_date, lead, recurrence2x27 AS ours FROM (WITH {BASE_SQL} SELECT * FROM fb))
    SELECT o.lead, count(*) AS n, round(avg(abs(y - fc)), 6) + 0.0 AS mae_outlook, round(avg(abs(y - ours)), 6) + 0.0 AS mae_ours FROM orefs o JOIN ours u ON u.issue_date = o.issue_date AND u.lead = o.lead
    WHERE y IS NOT NULL AND ours IS NOT NULL GROUP BY 1""")
def q_compare_issues(spark, sf_dir):
    ours = baselines(A.daily(spark, sf_dir)).select(F.col("date").alias("issue_date"), "lead", F.col("recurrence2x27").alias("ours"))
    j = outlook_with_refs(spark, sf_dir).join(ours, ["issue_date", "lead"]).where("y is not null and ours is not null")
    err = lambda c: r6(F.avg(F.abs(F.col("y") - F.col(c))))
    return j.groupBy("lead").agg(F.count(F.lit(1)).alias("n"), err("fc").alias("mae_outlook"), err("ours").alias("mae_ours"))


@query(f"""WITH {LONG_SQL}, g AS (SELECT * FROM (VALUES ('1-60', 1, 60), ('3-26', 3, 26), ('27-60', 27, 60)) AS t(grp, lo, hi)), m AS (SELECT model, lead, avg(abs(y - f)) AS mae FROM fl GROUP BY 1, 2)
    SELECT model, grp, round(avg(mae), 6) + 0.0 AS mae, count(*) AS n_leads FROM m JOIN g ON lead BETWEEN lo AND hi GROUP BY 1, 2""")
def q_lead_groups(spark, sf_dir):
    m = long_form(baselines(A.daily(spark, sf_dir))).groupBy("model", "lead").agg(F.avg(F.abs(F.col("y") - F.col("f"))).alias("mae"))
    l = F.col("lead")
    groups = F.filter(F.array(F.when(l.between(1, 60), "1-60"), F.when(l.between(3, 26), "3-26"), F.when(l.between(27, 60), "27-60")), lambda x: x.isNotNull())
    return m.withColumn("grp", F.explode(groups)).groupBy("model", "grp").agg(r6(F.avg("mae")).alias("mae"), F.count(F.lit(1)).alias("n_leads"))


@query(f"""WITH {LONG_SQL}, t AS (SELECT * FROM fl), full_days AS (SELECT model, date FROM t WHERE lead <= 26 AND y IS NOT NULL AND f IS NOT NULL GROUP BY 1, 2 HAVING count(*) = 26),
    u AS (SELECT 'all' AS subset, * FROM t UNION ALL SELECT 'all26', t.* FROM t JOIN full_days USING (model, date) WHERE lead <= 26)
    SELECT subset, model, lead, count(y - f) AS n, round(avg(abs(y - f)), 6) + 0.0 AS mae, {corr_sql('y', 'f')} AS cc, round(avg(f - y), 6) + 0.0 AS me FROM u GROUP BY 1, 2, 3""")
def q_error_by_lead(spark, sf_dir):
    """Curves over the leads, for all issue days and for those on which a model has all of the first 26."""
    l = long_form(baselines(A.daily(spark, sf_dir)))
    whole = l.where("lead <= 26 and y is not null and f is not null").groupBy("model", "date").agg(F.count(F.lit(1)).alias("n")).where("n = 26").select("model", "date")
    u = l.withColumn("subset", F.lit("all")).unionByName(l.where("lead <= 26").join(whole, ["model", "date"], "left_semi").withColumn("subset", F.lit("all26")))
    d = F.col("f") - F.col("y")
    return u.groupBy("subset", "model", "lead").agg(F.count(d).alias("n"), r6(F.avg(F.abs(d))).alias("mae"), r6(safe_corr("y", "f")).alias("cc"), r6(F.avg(d)).alias("me"))


@query(f"""WITH {REFS}, p AS (SELECT issue_date, max(CASE WHEN lead = 0 THEN y END) AS l0, max(CASE WHEN lead = 1 THEN y END) AS l1, max(CASE WHEN lead = 26 THEN y END) AS l26, count(y) AS n FROM orefs GROUP BY 1)
    SELECT issue_date, round(l0, 6) + 0.0 AS l0, round(l1, 6) + 0.0 AS l1, round(l26, 6) + 0.0 AS l26 FROM p WHERE n = 27""")
def q_pivot_leads(spark, sf_dir):
    p = outlook_with_refs(spark, sf_dir).groupBy("issue_date").pivot("lead", list(range(27))).agg(F.first("y", ignorenulls=True))
    full = F.forall(F.array(*[F.col(f"`{k}`") for k in range(27)]), lambda x: x.isNotNull())
    return p.where(full).select("issue_date", *[r6(F.col(f"`{k}`")).alias(f"l{k}") for k in (0, 1, 26)])


@query(f"WITH {LONG_SQL} SELECT date, lead, model, round(f, 6) + 0.0 AS f FROM fl WHERE f IS NOT NULL")
def q_unpivot(spark, sf_dir):
    l = long_form(baselines(A.daily(spark, sf_dir)))
    return l.where("f is not null").select("date", "lead", "model", r6(F.col("f")).alias("f"))


@query(f"WITH {REFS} SELECT count(DISTINCT issue_date) AS n_issues, count(DISTINCT target_date) AS n_days FROM orefs")
def q_nunique(spark, sf_dir):
    return A.outlook(spark, sf_dir).agg(F.countDistinct("issue_date").alias("n_issues"), F.countDistinct("target_date").alias("n_days"))


@query(f"""WITH {REFS}, m AS (SELECT date FROM days WHERE dayofweek(date) = 1) SELECT date AS issue_date FROM m
    WHERE date NOT IN (SELECT CAST(o_orderdate AS DATE) FROM orders WHERE o_orderpriority = '1-URGENT' AND o_totalprice > 200000)""")
def q_missing_issues(spark, sf_dir):
    """Mondays without an issue in the archive (days with a dear urgent order play its part)."""
    mondays = A.daily(spark, sf_dir).where(F.dayofweek("date") == 2).select(F.col("date").alias("issue_date"))
    archive = A.read(spark, sf_dir, "orders").where("o_orderpriority = '1-URGENT' and o_totalprice > 200000").select(F.to_date("o_orderdate").alias("issue_date"))
    return mondays.join(archive, "issue_date", "left_anti")


CASE = f"""{REFS}, one AS (SELECT max(issue_date) AS issue_date FROM orefs WHERE issue_date <= (SELECT min(issue_date) + CAST((max(issue_date) - min(issue_date)) // 2 AS INTEGER) FROM orefs)), ahead AS (SELECT o.* FROM orefs o JOIN one USING (issue_date))"""


@query(f"""WITH {CASE} SELECT 'input' AS part, CAST(d.date - one.issue_date AS INTEGER) AS lead, d.date AS target_date, round(d.ap, 6) + 0.0 AS y, NULL AS fc, NULL AS persistence, NULL AS recurrence27 FROM one JOIN daily d ON d.date BETWEEN one.issue_date - 29 AND one.issue_date
    UNION ALL SELECT 'target', lead, target_date, round(y, 6) + 0.0, round(fc, 6) + 0.0, round(persistence, 6) + 0.0, round(recurrence27, 6) + 0.0 FROM ahead""")
def q_case_window(spark, sf_dir):
    """One issue: the 30 days up to it, and the days ahead with all forecasts."""
    o, one = case_of(spark, sf_dir)
    span = one.select(F.col("issue_date").alias("_i"), F.explode(F.sequence(F.date_sub("issue_date", 29), F.col("issue_date"))).alias("date"))
    back = span.join(A.daily(spark, sf_dir), "date").select(
        F.lit("input").alias("part"), F.datediff("date", "_i").alias("lead"), F.col("date").alias("target_date"), r6(F.col("ap")).alias("y"), *[F.lit(None).cast("double").alias(c) for c in FORECASTS]
    )
    return back.unionByName(o.select(F.lit("target").alias("part"), "lead", "target_date", *[r6(F.col(c)).alias(c) for c in ("y", *FORECASTS)]))


FORECASTS = ["fc", "persistence", "recurrence27"]


def case_of(spark, sf_dir, day: str | None = None) -> tuple[DataFrame, DataFrame]:
    """The outlook of the last issue up to a day (the middle of the archive, if not given), and that issue's date (one row)."""
    o = outlook_with_refs(spark, sf_dir)
    issues = o.select("issue_date").distinct()
    ends = issues.agg(F.min("issue_date").alias("lo"), F.max("issue_date").alias("hi"))
    upto = F.lit(day).cast("date") if day else F.expr("date_add(lo, cast(datediff(hi, lo) div 2 as int))")
    one = issues.join(F.broadcast(ends.select(upto.alias("upto"))), F.col("issue_date") <= F.col("upto")).agg(F.max("issue_date").alias("issue_date"))  # one row
    return o.join(F.broadcast(one), "issue_date"), one


@query(f"""WITH {CASE}, l AS ({" UNION ALL ".join(f"SELECT '{m}' AS model, y, {m} AS f FROM ahead" for m in ("fc", "persistence", "recurrence27"))})
    SELECT model, count(y - f) AS n, round(avg(abs(y - f)), 6) + 0.0 AS mae, {corr_sql("y", "f")} AS cc FROM l GROUP BY 1""")
def q_case_scores(spark, sf_dir):
    """Error and correlation of each forecast of the case; days without a value are left out."""
    l = case_of(spark, sf_dir)[0].select("y", *FORECASTS).unpivot(["y"], FORECASTS, "model", "f")
    d = F.col("y") - F.col("f")
    return l.groupBy("model").agg(F.count(d).alias("n"), r6(F.avg(F.abs(d))).alias("mae"), r6(safe_corr("y", "f")).alias("cc"))


def ensemble(f3: DataFrame) -> DataFrame:
    """The mean over seeds of expm1(mu) for each issue and step."""
    return f3.groupBy("issue_date", "lead_step_3h", "target_day_k").agg(F.avg(F.expm1("mu")).alias("p"), F.max("observed_ap").alias("y"), F.count(F.lit(1)).alias("n_seeds"))


ENS = A.FORECAST + ", ens AS (SELECT issue_date, lead_step_3h, target_day_k, avg(exp(mu) - 1) AS p, max(observed_ap) AS y, count(*) AS n_seeds FROM fc3 GROUP BY 1, 2, 3)"


@query(f"WITH {ENS} SELECT issue_date, lead_step_3h, round(p, 6) + 0.0 AS p, round(y, 6) + 0.0 AS y FROM ens WHERE n_seeds = 3")
def q_seed_ensemble(spark, sf_dir):
    return ensemble(A.forecast_3h(spark, sf_dir)).where("n_seeds = 3").select("issue_date", "lead_step_3h", r6(F.col("p")).alias("p"), r6(F.col("y")).alias("y"))


DAY3 = ENS + ", day3 AS (SELECT issue_date, target_day_k, avg(p) AS p, avg(y) AS y, count(*) AS n FROM ens GROUP BY 1, 2)"


def day_means(e: DataFrame) -> DataFrame:
    return e.groupBy("issue_date", "target_day_k").agg(F.avg("p").alias("p"), F.avg("y").alias("y"), F.count(F.lit(1)).alias("n"))


@query(f"WITH {DAY3} SELECT issue_date, target_day_k, round(p, 6) + 0.0 AS p, round(y, 6) + 0.0 AS y FROM day3 WHERE n = 8")
def q_daily_from_3h(spark, sf_dir):
    d = day_means(ensemble(A.forecast_3h(spark, sf_dir))).where("n = 8")
    return d.select("issue_date", "target_day_k", r6(F.col("p")).alias("p"), r6(F.col("y")).alias("y"))


@query(f"""WITH {A.FORECAST}, s AS (SELECT target_day_k, seed, avg(abs(exp(mu) - 1 - observed_ap)) AS mae FROM fc3 GROUP BY 1, 2)
    SELECT target_day_k, round(avg(mae), 6) + 0.0 AS mean, round(stddev_samp(mae), 6) + 0.0 AS std1, round(stddev_pop(mae), 6) + 0.0 AS std0, round(max(mae) - min(mae), 6) + 0.0 AS spread FROM s GROUP BY 1""")
def q_seed_spread(spark, sf_dir):
    s = A.forecast_3h(spark, sf_dir).groupBy("target_day_k", "seed").agg(F.avg(F.abs(F.expm1("mu") - F.col("observed_ap"))).alias("mae"))
    return s.groupBy("target_day_k").agg(r6(F.avg("mae")).alias("mean"), r6(F.stddev_samp("mae")).alias("std1"), r6(F.stddev_pop("mae")).alias("std0"), r6(F.max("mae") - F.min("mae")).alias("spread"))


STEPS = range(1, 25)


@query(f"""WITH {A.FORECAST}, d AS (SELECT seed, issue_date, target_day_k, avg(exp(mu) - 1) AS p, avg(observed_ap) AS y FROM fc3 GROUP BY 1, 2, 3), ds AS (SELECT seed, round(avg(abs(p - y)), 6) + 0.0 AS mae_day, {corr_sql('p', 'y')} AS cc_day FROM d GROUP BY 1),
    s AS (SELECT seed, round(avg(abs(exp(mu) - 1 - observed_ap)), 6) + 0.0 AS mae_3h, round(sqrt(avg(pow(exp(mu) - 1 - observed_ap, 2))), 6) + 0.0 AS rmse_3h,
    round(corr(exp(mu) - 1, observed_ap), 6) + 0.0 AS cc_3h, round(avg(CASE WHEN abs(ln(1 + observed_ap) - mu) <= sigma THEN 1.0 ELSE 0.0 END), 6) + 0.0 AS cover68_3h,
    round(avg(CASE WHEN abs(ln(1 + observed_ap) - mu) <= 1.96 * sigma THEN 1.0 ELSE 0.0 END), 6) + 0.0 AS cover95_3h,
    {", ".join(f"round(avg(abs(exp(mu) - 1 - observed_ap)) FILTER (lead_step_3h = {h}), 6) + 0.0 AS mae_h{h}" for h in STEPS)} FROM fc3 GROUP BY 1) SELECT * FROM s JOIN ds USING (seed)""")
def q_scores_3h(spark, sf_dir):
    """The whole bundle of each seed: over bins, over day means, by step, and the share within one and 1.96 deviations."""
    f = A.forecast_3h(spark, sf_dir).withColumn("p", F.expm1("mu")).withColumn("z", F.abs(F.log1p("observed_ap") - F.col("mu")))
    d = F.col("p") - F.col("observed_ap")
    bins = f.groupBy("seed").agg(
        r6(F.avg(F.abs(d))).alias("mae_3h"), r6(F.sqrt(F.avg(d * d))).alias("rmse_3h"), r6(safe_corr("p", "observed_ap")).alias("cc_3h"),
        r6(F.avg((F.col("z") <= F.col("sigma")).cast("double"))).alias("cover68_3h"), r6(F.avg((F.col("z") <= 1.96 * F.col("sigma")).cast("double"))).alias("cover95_3h"),
        *[r6(F.avg(F.when(F.col("lead_step_3h") == h, F.abs(d)))).alias(f"mae_h{h}") for h in STEPS],
    )
    days = f.groupBy("seed", "issue_date", "target_day_k").agg(F.avg("p").alias("p"), F.avg("observed_ap").alias("y"))
    days = days.groupBy("seed").agg(r6(F.avg(F.abs(F.col("p") - F.col("y")))).alias("mae_day"), r6(safe_corr("p", "y")).alias("cc_day"))
    return bins.join(days, "seed")


def three(y: str, p: str) -> list:
    d = F.col(p) - F.col(y)
    return [F.count(F.lit(1)).alias("n"), r6(F.avg(F.abs(d))).alias("mae"), r6(F.sqrt(F.avg(d * d))).alias("rmse"), r6(safe_corr(y, p)).alias("cc"), r6(F.avg(d)).alias("me")]


THREE = f"count(*) AS n, round(avg(abs(p - y)), 6) + 0.0 AS mae, round(sqrt(avg((p - y) * (p - y))), 6) + 0.0 AS rmse, {corr_sql('y', 'p')} AS cc, round(avg(p - y), 6) + 0.0 AS me"


@query(f"WITH {ENS} SELECT CASE WHEN GROUPING(target_day_k) = 1 THEN 'all' ELSE 'day' || target_day_k END AS day, {THREE} FROM ens GROUP BY GROUPING SETS ((), (target_day_k))")
def q_metrics_by_day(spark, sf_dir):
    e = ensemble(A.forecast_3h(spark, sf_dir)).withColumn("day", F.explode(F.array(F.lit("all"), F.concat(F.lit("day"), "target_day_k"))))
    return e.groupBy("day").agg(*three("y", "p"))


@query(f"WITH {ENS} SELECT lead_step_3h, {THREE} FROM ens GROUP BY 1")
def q_metrics_by_step(spark, sf_dir):
    return ensemble(A.forecast_3h(spark, sf_dir)).groupBy("lead_step_3h").agg(*three("y", "p"))


@query(f"WITH {ENS} SELECT CASE WHEN y >= 48 THEN 'storm' ELSE 'quiet' END AS subset, target_day_k, {THREE} FROM ens GROUP BY 1, 2")
def q_metrics_storm(spark, sf_dir):
    e = ensemble(A.forecast_3h(spark, sf_dir)).withColumn("subset", F.when(F.col("y") >= 48, "storm").otherwise("quiet"))
    return e.groupBy("subset", "target_day_k").agg(*three("y", "p"))


@query(f"WITH {ENS} SELECT CAST((lead_step_3h - 1) % 8 AS INTEGER) AS bin, round(avg(abs(p - y)), 6) + 0.0 AS mae FROM ens WHERE target_day_k = 1 GROUP BY 1")
def q_lead_profile(spark, sf_dir):
    e = ensemble(A.forecast_3h(spark, sf_dir, 1))
    return e.groupBy(((F.col("lead_step_3h") - 1) % 8).alias("bin")).agg(r6(F.avg(F.abs(F.col("p") - F.col("y")))).alias("mae"))


@query(f"""WITH {DAY3} SELECT target_day_k, round(avg(abs(p - y)), 6) + 0.0 AS mae, {corr_sql('y', 'p')} AS cc, count(CASE WHEN y > 48 THEN 1 END) AS n_storm_days FROM day3 WHERE n = 8 GROUP BY 1""")
def q_ap3h_score(spark, sf_dir):
    d = day_means(ensemble(A.forecast_3h(spark, sf_dir))).where("n = 8")
    return d.groupBy("target_day_k").agg(r6(F.avg(F.abs(F.col("p") - F.col("y")))).alias("mae"), r6(safe_corr("y", "p")).alias("cc"), F.count_if(F.col("y") > 48).alias("n_storm_days"))


@query(f"""WITH {A.FORECAST}, k AS (SELECT issue_date FROM fc3 WHERE seed = 0 GROUP BY 1 HAVING count(*) = 24 AND bool_and(sigma > 0)) SELECT issue_date, count(*) AS n FROM fc3 WHERE issue_date IN (SELECT issue_date FROM k) GROUP BY 1""")
def q_issue_quality_gate(spark, sf_dir):
    f = A.forecast_3h(spark, sf_dir)
    good = f.where("seed = 0").groupBy("issue_date").agg(F.count(F.lit(1)).alias("n"), F.bool_and(F.col("sigma") > 0).alias("ok")).where("n = 24 and ok")
    return f.join(good.select("issue_date"), "issue_date", "left_semi").groupBy("issue_date").agg(F.count(F.lit(1)).alias("n"))


@query(f"WITH {A.FORECAST} SELECT issue_date, min_by(seed, (lead_step_3h, seed)) AS first_seed, round(min_by(mu, (lead_step_3h, seed)), 6) + 0.0 AS first_mu FROM fc3 GROUP BY 1")
def q_issue_first(spark, sf_dir):
    key = F.struct("lead_step_3h", "seed")
    return A.forecast_3h(spark, sf_dir).groupBy("issue_date").agg(F.min_by("seed", key).alias("first_seed"), r6(F.min_by("mu", key)).alias("first_mu"))


@query(f"""WITH {ENS}, r AS (SELECT *, lag(y, 1) OVER (PARTITION BY lead_step_3h ORDER BY issue_date) AS ref FROM ens)
    SELECT target_day_k, count(ref) AS n, round(avg(abs(p - y)), 6) + 0.0 AS mae, round(avg(abs(ref - y)), 6) + 0.0 AS mae_ref FROM r WHERE ref IS NOT NULL GROUP BY 1""")
def q_score_vs_ref(spark, sf_dir):
    e = ensemble(A.forecast_3h(spark, sf_dir)).withColumn("ref", F.lag("y").over(Window.partitionBy("lead_step_3h").orderBy("issue_date"))).where("ref is not null")
    err = lambda c: r6(F.avg(F.abs(F.col(c) - F.col("y"))))
    return e.groupBy("target_day_k").agg(F.count("ref").alias("n"), err("p").alias("mae"), err("ref").alias("mae_ref"))


@query(f"""WITH {A.FORECAST} SELECT issue_date, lead_step_3h, seed, round(0.5 * (least(greatest(2 * ln(sigma), -10), 10) + pow(ln(1 + observed_ap) - mu, 2) * exp(-least(greatest(2 * ln(sigma), -10), 10))), 6) + 0.0 AS nll FROM fc3""")
def q_gaussian_nll(spark, sf_dir):
    nll = gaussian_nll(F.col("mu"), 2 * F.log("sigma"), F.log1p("observed_ap"))
    return A.forecast_3h(spark, sf_dir).select("issue_date", "lead_step_3h", "seed", r6(nll).alias("nll"))


# The normal distribution function in SQL: a series of positive terms, z^(2n+1) over the double factorial of 2n+1, without cancellation.
def phi_sql(z: str) -> str:
    terms = f"list_sum(list_transform(range(160), lambda n: exp((2 * n + 1) * ln(abs({z})) - (n + 1) * ln(2.0) - lgamma(n + 1.5) + 0.5 * ln(pi()))))"
    return f"CASE WHEN {z} > 8 THEN 1.0 WHEN {z} < -8 THEN 0.0 WHEN abs({z}) < 1e-300 THEN 0.5 ELSE 0.5 + sign({z}) * exp(-0.5 * ({z}) * ({z})) / sqrt(2 * pi()) * {terms} END"


MIXTURE = f"""{A.FORECAST}, one AS (SELECT *, exp(mu + sigma * sigma / 2) AS m, (ln(1 + observed_ap) - mu) / sigma AS z FROM fc3 WHERE target_day_k = 1),
    near AS (SELECT issue_date, lead_step_3h, observed_ap AS y, avg((1 + observed_ap) * (2 * ({phi_sql("z")}) - 1) + m * (1 - 2 * ({phi_sql("(z - sigma)")}))) AS d, avg({phi_sql("z")}) AS f FROM one GROUP BY ALL),
    two AS (SELECT a.issue_date, a.lead_step_3h, a.m AS ma, b.m AS mb, (a.mu - b.mu + a.sigma * a.sigma) / sqrt(a.sigma * a.sigma + b.sigma * b.sigma) AS za, (b.mu - a.mu + b.sigma * b.sigma) / sqrt(a.sigma * a.sigma + b.sigma * b.sigma) AS zb
        FROM one a JOIN one b USING (issue_date, lead_step_3h)),
    apart AS (SELECT issue_date, lead_step_3h, avg(2 * (ma * ({phi_sql("za")}) + mb * ({phi_sql("zb")})) - ma - mb) AS d FROM two GROUP BY ALL)"""


@query(f"""WITH {MIXTURE} SELECT issue_date, lead_step_3h, round(near.d - apart.d / 2, 6) + 0.0 AS crps, f BETWEEN 0.16 AND 0.84 AS in68, f BETWEEN 0.025 AND 0.975 AS in95 FROM near JOIN apart USING (issue_date, lead_step_3h)""")
def q_crps(spark, sf_dir):
    """CRPS of the mixture of seeds, exactly, and whether its central 68 and 95 % hold the observation."""
    return mixture_scores(spark, sf_dir).select("issue_date", "lead_step_3h", r6(F.col("crps")).alias("crps"), "in68", "in95")


def seed_mixtures(spark, sf_dir, days: int = 1) -> DataFrame:
    """issue_date, lead_step_3h, mus and sigmas of all seeds, y."""
    f = A.forecast_3h(spark, sf_dir, days)
    return f.groupBy("issue_date", "lead_step_3h").agg(F.collect_list("mu").alias("mus"), F.collect_list("sigma").alias("sigmas"), F.max("observed_ap").alias("y"))


def mixture_scores(spark, sf_dir) -> DataFrame:
    """issue_date, lead_step_3h, y, crps, in68, in95 of the first day's bins."""
    g = seed_mixtures(spark, sf_dir).withColumn("s", mixture("mus", "sigmas", "y", (0.16, 0.84, 0.025, 0.975)))
    q = lambda i: F.get("s.q", F.lit(i))
    return g.select("issue_date", "lead_step_3h", "y", "s.crps", F.col("y").between(q(0), q(1)).alias("in68"), F.col("y").between(q(2), q(3)).alias("in95"))


@query(f"""WITH {MIXTURE}, c AS (SELECT avg(near.d - apart.d / 2) AS crps, avg(CASE WHEN f BETWEEN 0.16 AND 0.84 THEN 1.0 ELSE 0.0 END) AS c68, avg(CASE WHEN f BETWEEN 0.025 AND 0.975 THEN 1.0 ELSE 0.0 END) AS c95, count(*) AS n, y >= 48 AS storm
        FROM near JOIN apart USING (issue_date, lead_step_3h) GROUP BY y >= 48)
    SELECT storm, n, round(crps, 6) + 0.0 AS crps_3h, round(c68, 6) + 0.0 AS cover68_3h, round(c95, 6) + 0.0 AS cover95_3h FROM c""")
def q_mixture_cover(spark, sf_dir):
    """Mean CRPS and coverage of the mixture, on storm bins and on others."""
    return mixture_scores(spark, sf_dir).groupBy((F.col("y") >= 48).alias("storm")).agg(
        F.count(F.lit(1)).alias("n"), r6(F.avg("crps")).alias("crps_3h"), r6(F.avg(F.col("in68").cast("double"))).alias("cover68_3h"), r6(F.avg(F.col("in95").cast("double"))).alias("cover95_3h")
    )


@query(f"""WITH {A.FORECAST}, z AS (SELECT issue_date, lead_step_3h, (ln(49.0) - mu) / sigma AS z FROM fc3) SELECT issue_date, lead_step_3h, round(avg(1 - ({phi_sql("z")})), 6) + 0.0 AS p48 FROM z GROUP BY 1, 2""")
def q_exceedance(spark, sf_dir):
    """The mean over seeds of P(ap >= 48)."""
    f = A.forecast_3h(spark, sf_dir).withColumn("p48", F.lit(1.0) - normal_cdf((F.log1p(F.lit(48.0)) - F.col("mu")) / F.col("sigma")))
    return f.groupBy("issue_date", "lead_step_3h").agg(r6(F.avg("p48")).alias("p48"))


@query(f"""WITH {LONG_SQL}, m AS (SELECT model, lead, avg(abs(y - f)) AS mae FROM fl GROUP BY 1, 2) SELECT model, min_by(lead, (round(mae, 9), lead)) AS best_lead FROM m GROUP BY 1""")
def q_best_length(spark, sf_dir):
    m = long_form(baselines(A.daily(spark, sf_dir))).groupBy("model", "lead").agg(F.round(F.avg(F.abs(F.col("y") - F.col("f"))), 9).alias("mae"))
    return m.groupBy("model").agg(F.min_by("lead", F.struct("mae", "lead")).alias("best_lead"))


@query(f"""WITH {LONG_SQL}, m AS (SELECT model, lead, avg(abs(y - f)) AS mae FROM fl GROUP BY 1, 2)
    SELECT model, lead, lag(lead) OVER (PARTITION BY model ORDER BY lead) AS shorter, round(mae - lag(mae) OVER (PARTITION BY model ORDER BY lead), 6) + 0.0 AS d_mae FROM m""")
def q_length_neighbours(spark, sf_dir):
    m = long_form(baselines(A.daily(spark, sf_dir))).groupBy("model", "lead").agg(F.avg(F.abs(F.col("y") - F.col("f"))).alias("mae"))
    w = Window.partitionBy("model").orderBy("lead")
    return m.select("model", "lead", F.lag("lead").over(w).alias("shorter"), r6(F.col("mae") - F.lag("mae").over(w)).alias("d_mae"))


BB = f"""WITH {LONG_SQL}, src AS (SELECT date, lead, y, recurrence27 AS a, persistence AS b FROM fb WHERE y IS NOT NULL AND recurrence27 IS NOT NULL AND persistence IS NOT NULL)"""


@query(f"""{BB}, {block_bootstrap_sql("bb", "src", ["lead"], 1000)} SELECT * FROM bb""")
def q_block_bootstrap(spark, sf_dir):
    """Recurrence against persistence at each lead, months resampled."""
    b = baselines(A.daily(spark, sf_dir)).where("y is not null and recurrence27 is not null and persistence is not null")
    return block_bootstrap(b.select("date", "lead", "y", "recurrence27", "persistence"), "date", "y", "recurrence27", "persistence", ["lead"])


@query(f"""WITH {ENS}, src AS (SELECT target_day_k, issue_date AS block, avg(p - y) AS v FROM ens GROUP BY 1, 2), {bootstrap_mean_sql("bm", "src", ["target_day_k"], 2000)} SELECT * FROM bm""")
def q_boot_iid(spark, sf_dir):
    """The mean of daily errors, days resampled one by one."""
    e = ensemble(A.forecast_3h(spark, sf_dir)).groupBy("target_day_k", "issue_date").agg(F.avg(F.col("p") - F.col("y")).alias("d"))
    return bootstrap_mean(e, "d", F.col("issue_date"), ["target_day_k"])


@query(f"""WITH {ENS}, src AS (SELECT target_day_k, issue_date AS block, abs(p - y) AS v FROM ens), {bootstrap_mean_sql("bm", "src", ["target_day_k"], 2000)} SELECT * FROM bm""")
def q_boot_table(spark, sf_dir):
    """The mean error over a table of days and bins, whole days resampled."""
    e = ensemble(A.forecast_3h(spark, sf_dir)).select("target_day_k", "issue_date", F.abs(F.col("p") - F.col("y")).alias("d"))
    return bootstrap_mean(e, "d", F.col("issue_date"), ["target_day_k"])


@query(f"""WITH {LONG_SQL}, src AS (SELECT lead, model, date_trunc('month', date) AS block, abs(y - f) AS v FROM fl WHERE y IS NOT NULL AND f IS NOT NULL), {bootstrap_mean_sql("bm", "src", ["lead", "model"], 2000)} SELECT * FROM bm""")
def q_boot_blocks(spark, sf_dir):
    """The mean error of each model and lead, months resampled."""
    e = long_form(baselines(A.daily(spark, sf_dir))).where("y is not null and f is not null").select("lead", "model", "date", F.abs(F.col("y") - F.col("f")).alias("d"))
    return bootstrap_mean(e, "d", F.trunc("date", "month"), ["lead", "model"])


@query(f"WITH {LONG_SQL} SELECT model, lead, round(avg(abs(y - f)), 6) + 0.0 AS mae FROM fl GROUP BY 1, 2 ORDER BY mae, model, lead LIMIT 10")
def q_sorted_scores(spark, sf_dir):
    """The ten best combinations."""
    m = long_form(baselines(A.daily(spark, sf_dir))).groupBy("model", "lead").agg(r6(F.avg(F.abs(F.col("y") - F.col("f")))).alias("mae"))
    return m.orderBy("mae", "model", "lead").limit(10)


@query(f"""WITH {ENS}, g AS (SELECT issue_date, lead_step_3h, target_day_k, seed, 'seed' AS model_group, mu, sigma, exp(mu) - 1 AS p FROM fc3 UNION ALL SELECT issue_date, lead_step_3h, target_day_k, NULL, 'ensemble', NULL, NULL, p FROM ens),
    o AS (SELECT *, lag(y, 1) OVER (PARTITION BY lead_step_3h ORDER BY issue_date) AS ref FROM ens)
    SELECT g.issue_date, CAST(g.issue_date + g.target_day_k AS DATE) AS target_date, g.lead_step_3h, g.model_group, g.seed, round(g.mu, 6) + 0.0 AS mu, round(g.p, 6) + 0.0 AS p, round(o.y, 6) + 0.0 AS y, round(o.ref, 6) + 0.0 AS ref, abs(g.p - o.y) < abs(o.ref - o.y) AS beats_ref,
        abs(ln(1 + o.y) - g.mu) <= g.sigma AS in68, o.y >= 48 AS storm_bin FROM g JOIN o USING (issue_date, lead_step_3h) WHERE o.n_seeds = 3""")
def q_matched_long(spark, sf_dir):
    """A row for each issue, step and model (each seed, and their mean): forecast, observation, the reference of the last issue, and flags."""
    f = A.forecast_3h(spark, sf_dir)
    e = ensemble(f)
    seeds = f.select("issue_date", "lead_step_3h", "target_day_k", F.lit("seed").alias("model_group"), "seed", "mu", "sigma", F.expm1("mu").alias("p"))
    whole = e.select("issue_date", "lead_step_3h", "target_day_k", F.lit("ensemble").alias("model_group"), F.lit(None).cast("int").alias("seed"), *[F.lit(None).cast("double").alias(c) for c in ("mu", "sigma")], "p")
    o = e.withColumn("ref", F.lag("y").over(Window.partitionBy("lead_step_3h").orderBy("issue_date"))).where("n_seeds = 3").select("issue_date", "lead_step_3h", "y", "ref")
    j = seeds.unionByName(whole).join(o, ["issue_date", "lead_step_3h"])
    y = F.col("y")
    return j.select(
        "issue_date", F.expr("date_add(issue_date, target_day_k)").alias("target_date"), "lead_step_3h", "model_group", "seed", *[r6(F.col(c)).alias(c) for c in ("mu", "p", "y", "ref")],
        (F.abs(F.col("p") - y) < F.abs(F.col("ref") - y)).alias("beats_ref"), (F.abs(F.log1p("y") - F.col("mu")) <= F.col("sigma")).alias("in68"), (y >= 48).alias("storm_bin"),
    )


@query(f"""WITH {ENS}, b AS (SELECT time_bucket(INTERVAL '3 hours', ts) AS time, avg(value) AS ap FROM events WHERE value < 200 GROUP BY 1),
    t AS (SELECT *, CAST(issue_date + target_day_k AS TIMESTAMP) + to_hours(CAST(3 * ((lead_step_3h - 1) % 8) AS INTEGER)) AS time FROM ens)
    SELECT target_day_k, count(*) AS n, round(max(abs(y - ap)), 6) + 0.0 AS max_abs, CAST(min(date_diff('hour', CAST(issue_date AS TIMESTAMP) + INTERVAL 22 HOUR, time)) AS BIGINT) AS min_hours,
        CAST(max(date_diff('hour', CAST(issue_date AS TIMESTAMP) + INTERVAL 22 HOUR, time)) AS BIGINT) AS max_hours, count(CASE WHEN time < CAST(issue_date AS TIMESTAMP) + INTERVAL 22 HOUR THEN 1 END) AS n_before FROM t JOIN b USING (time) GROUP BY 1""")
def q_alignment_audit(spark, sf_dir):
    """Stored observations against their source, placed by issue date and step, and the hours from the issue (22 h) to each bin."""
    e = ensemble(A.forecast_3h(spark, sf_dir)).withColumn("time", F.expr("cast(date_add(issue_date, target_day_k) as timestamp_ntz) + make_dt_interval(0, 3 * ((lead_step_3h - 1) % 8))"))
    j = e.join(A.bins_3h(spark, sf_dir).where("ap is not null").select("time", "ap"), "time")
    hours = F.expr("timestampdiff(HOUR, cast(issue_date as timestamp_ntz) + interval 22 hours, time)")
    return j.groupBy("target_day_k").agg(
        F.count(F.lit(1)).alias("n"), r6(F.max(F.abs(F.col("y") - F.col("ap")))).alias("max_abs"), F.min(hours).alias("min_hours"), F.max(hours).alias("max_hours"), F.count_if(hours < 0).alias("n_before")
    )
