"""Summaries of runs: paired comparisons, length curves, bands, slices, partitioned tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quietday.functions.columns import r6, safe_corr
from quietday.functions.distributions import mixture
from quietday.operators.bootstrap import D_CORR_SQL, STATS, block_bootstrap, block_bootstrap_sql, block_statistics, bootstrap_mean, bootstrap_mean_sql, draws_sql, resampled, resampled_sql, statistics_sql
from quietday.operators.joins import flag_days
from quietday.plans.events import EVENTS, catalog_of, event_days
from quietday.plans.registry import query
from quietday.plans.samples import baselines
from quietday.plans.verification import DAY3, ENS, LONG_SQL, THREE, corr_sql, day_means, ensemble, long_form, phi_sql, seed_mixtures, three
from quietday.session import cut, scratch_path
from quietday.sources import adapters as A
from quietday.sources.files import sql_frame

err = lambda a, b="y": F.avg(F.abs(F.col(a) - F.col(b)))


def paired(spark, sf_dir) -> DataFrame:
    """date, lead, y and models on the issue days on which all have a value."""
    b = baselines(A.daily(spark, sf_dir))
    return b.where("y is not null and persistence is not null and recurrence27 is not null and recurrence2x27 is not null")


PAIRED = LONG_SQL + ", pr AS (SELECT * FROM fb WHERE y IS NOT NULL AND persistence IS NOT NULL AND recurrence27 IS NOT NULL AND recurrence2x27 IS NOT NULL)"
PLONG = PAIRED + ", pl AS (" + " UNION ALL ".join(f"SELECT date, lead, '{m}' AS model, y, {m} AS f FROM pr" for m in ("climatology", "persistence", "recurrence27", "recurrence2x27")) + ")"


@query(f"WITH {PLONG} SELECT model, lead, count(*) AS n, count(DISTINCT date) AS n_days, round(avg(abs(y - f)), 6) + 0.0 AS mae FROM pl GROUP BY 1, 2")
def q_paired_runs(spark, sf_dir):
    """All models on the same days: equal counts per lead by construction."""
    l = long_form(paired(spark, sf_dir))
    return l.groupBy("model", "lead").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("date").alias("n_days"), r6(err("f")).alias("mae"))


@query(f"""WITH {PLONG}, m AS (SELECT model, lead, avg(abs(y - f)) AS mae, count(*) AS n FROM pl GROUP BY 1, 2), p AS (SELECT lead, mae AS ref FROM m WHERE model = 'persistence')
    SELECT model, lead, n, round(mae, 6) + 0.0 AS mae, round(mae - ref, 6) + 0.0 AS vs_persistence, round(mae - first_value(mae) OVER (PARTITION BY model ORDER BY lead), 6) + 0.0 AS vs_first,
        round(mae - min(mae) OVER (PARTITION BY model), 6) + 0.0 AS vs_best FROM m JOIN p USING (lead)""")
def q_l2_summary(spark, sf_dir):
    """Error of each model and length against persistence, against the shortest length and against its best."""
    m = long_form(paired(spark, sf_dir)).groupBy("model", "lead").agg(err("f").alias("mae"), F.count(F.lit(1)).alias("n"))
    p = m.where("model = 'persistence'").select("lead", F.col("mae").alias("ref"))
    w = Window.partitionBy("model")
    return m.join(p, "lead").select(
        "model", "lead", "n", r6(F.col("mae")).alias("mae"), r6(F.col("mae") - F.col("ref")).alias("vs_persistence"),
        r6(F.col("mae") - F.first("mae").over(w.orderBy("lead"))).alias("vs_first"), r6(F.col("mae") - F.min("mae").over(w)).alias("vs_best"),
    )


@query(f"""WITH {PLONG}, c AS (SELECT model || ' - persistence' AS comparison, lead, round(avg(abs(y - f)) - avg(abs(y - p)), 6) + 0.0 AS d_mae FROM (SELECT l.*, pr.persistence AS p FROM pl l JOIN pr USING (date, lead)) GROUP BY 1, 2)
    SELECT * FROM c WHERE comparison LIKE 'rec%' AND contains(comparison, '27') AND lead >= 7""")
def q_effect_slice(spark, sf_dir):
    """Effects of the comparisons whose text matches."""
    wide = paired(spark, sf_dir)
    long = wide.select("date", "lead", "y", F.col("persistence").alias("p"), *["climatology", "persistence", "recurrence27", "recurrence2x27"]).unpivot(["date", "lead", "y", "p"], ["climatology", "persistence", "recurrence27", "recurrence2x27"], "model", "f")
    c = long.groupBy(F.concat("model", F.lit(" - persistence")).alias("comparison"), "lead").agg(r6(err("f") - err("p")).alias("d_mae"))
    return c.where(F.col("comparison").startswith("rec") & F.col("comparison").contains("27") & (F.col("lead") >= 7))


@query(f"""WITH {PLONG} SELECT CASE WHEN year(date + 1) >= 2000 THEN 'A' ELSE 'B' END AS split, model, count(*) AS n, round(avg(abs(y - f)), 6) + 0.0 AS mae FROM pl
    WHERE lead = 1 AND date + 1 BETWEEN DATE '1999-12-01' AND DATE '2000-02-15' GROUP BY 1, 2""")
def q_case_lead1(spark, sf_dir):
    """Next-day forecasts with a target date in a range, by split."""
    target = F.date_add("date", 1)
    l = long_form(paired(spark, sf_dir)).where((F.col("lead") == 1) & target.between(F.lit("1999-12-01").cast("date"), F.lit("2000-02-15").cast("date")))
    return l.groupBy(F.when(F.year(target) >= 2000, "A").otherwise("B").alias("split"), "model").agg(F.count(F.lit(1)).alias("n"), r6(err("f")).alias("mae"))


RECENT = PAIRED + ", rec AS (SELECT 'recurrence27' AS model, lead, date, y, recurrence27 AS a, persistence AS b FROM pr UNION ALL SELECT 'recurrence2x27', lead, date, y, recurrence2x27, persistence FROM pr)"


def recent(spark, sf_dir) -> DataFrame:
    """model, lead, date, y, f, persistence: the recurrence models against persistence."""
    w = paired(spark, sf_dir)
    return w.select("date", "lead", "y", "persistence", "recurrence27", "recurrence2x27").unpivot(["date", "lead", "y", "persistence"], ["recurrence27", "recurrence2x27"], "model", "f")


@query(f"""WITH {RECENT}, {block_bootstrap_sql("bb", "rec", ["model", "lead"], 1000)} SELECT model, lead, d_mae, significant FROM bb""")
def q_boot_sig(spark, sf_dir):
    """Which comparisons with persistence have an interval that excludes zero."""
    b = block_bootstrap(recent(spark, sf_dir), "date", "y", "f", "persistence", ["model", "lead"])
    return b.select("model", "lead", "d_mae", "significant")


@query(f"""WITH {PAIRED}, src AS (SELECT lead, date, y, recurrence2x27 AS a, persistence AS b FROM pr WHERE lead BETWEEN 3 AND 26), {statistics_sql("g", "src", ["lead"])}, {draws_sql("g", "g_st", [], 1000)}, {resampled_sql("g", "g_st", ["lead"], STATS, [])},
    gains AS (SELECT r, avg({D_CORR_SQL}) AS gain FROM g_rs GROUP BY 1) SELECT round(avg(gain), 6) + 0.0 AS gain, round(quantile_cont(gain, 0.025), 6) + 0.0 AS lo, round(quantile_cont(gain, 0.975), 6) + 0.0 AS hi FROM gains""")
def q_boot_ccgain(spark, sf_dir):
    """The mean over resamples and leads of the gain in correlation, each lead resampled by the same months."""
    rows = paired(spark, sf_dir).where("lead between 3 and 26")
    stats = cut(block_statistics(rows, "date", "y", "recurrence2x27", "persistence", ["lead"]))
    runs = resampled(stats, ["lead"], STATS, ["d_corr"], 1000, 0, number_by=[], whole=True)
    gains = runs.select("lead", F.posexplode("d_corr").alias("r", "gain")).groupBy("r").agg(F.avg("gain").alias("gain"))
    return gains.agg(r6(F.avg("gain")).alias("gain"), r6(F.percentile("gain", 0.025)).alias("lo"), r6(F.percentile("gain", 0.975)).alias("hi"))


PREVIOUS = PAIRED + """, pm AS (SELECT 'recurrence27' AS model, lead, date, y, recurrence27 AS f, persistence FROM pr UNION ALL SELECT 'recurrence2x27', lead, date, y, recurrence2x27, persistence FROM pr),
    cmp AS (SELECT model, 'vs persistence' AS comparison, lead, date, y, f AS a, persistence AS b FROM pm
        UNION ALL SELECT x.model, 'vs L1', x.lead, x.date, x.y, x.f, o.f FROM pm x JOIN pm o ON o.model = x.model AND o.date = x.date AND o.lead = 1 WHERE x.lead > 1
        UNION ALL SELECT x.model, 'vs L-1', x.lead, x.date, x.y, x.f, o.f FROM pm x JOIN pm o ON o.model = x.model AND o.date = x.date AND o.lead = x.lead - 1 WHERE x.lead > 2)"""


@query(f"""WITH {PREVIOUS}, {block_bootstrap_sql("bb", "cmp", ["model", "comparison", "lead"], 1000)} SELECT * FROM bb""")
def q_l2_bootstrap(spark, sf_dir):
    """Each model and length against persistence, against the shortest length and against the next shorter one, on common days, months resampled."""
    m = cut(paired(spark, sf_dir).select("date", "lead", "y", "persistence", "recurrence27", "recurrence2x27").unpivot(["date", "lead", "y", "persistence"], ["recurrence27", "recurrence2x27"], "model", "f"))
    pairs = m.withColumn("comparison", F.lit("vs persistence")).withColumnRenamed("persistence", "b")
    m = m.drop("persistence")
    first = m.where("lead = 1").select("model", "date", F.col("f").alias("b"))
    before = m.select("model", "date", (F.col("lead") + 1).alias("lead"), F.col("f").alias("b"))
    pairs = pairs.unionByName(m.where("lead > 1").join(first, ["model", "date"]).withColumn("comparison", F.lit("vs L1")))
    pairs = pairs.unionByName(m.where("lead > 2").join(before, ["model", "date", "lead"]).withColumn("comparison", F.lit("vs L-1")))
    return block_bootstrap(pairs, "date", "y", "f", "b", ["model", "comparison", "lead"])


def with_reference(spark, sf_dir, days: int = 3) -> DataFrame:
    """Day means of the ensemble with the issue day's own mean as persistence, and a blend of both."""
    d = day_means(ensemble(A.forecast_3h(spark, sf_dir, days))).where("n = 8").drop("n")
    own = d.where("target_day_k = 1").select(F.date_add("issue_date", 1).alias("issue_date"), F.col("y").alias("ref"))
    j = d.join(own, "issue_date")
    return j.withColumn("blend", 0.5 * F.col("p") + 0.5 * F.col("ref"))


REF = DAY3 + """, dref AS (SELECT d.issue_date, d.target_day_k, d.p, d.y, o.y AS ref, 0.5 * d.p + 0.5 * o.y AS blend FROM day3 d JOIN day3 o ON o.target_day_k = 1 AND o.issue_date + 1 = d.issue_date
    WHERE d.n = 8 AND o.n = 8), dl AS (SELECT issue_date, target_day_k, 'p' AS model, y, p AS f FROM dref UNION ALL SELECT issue_date, target_day_k, 'ref', y, ref FROM dref UNION ALL SELECT issue_date, target_day_k, 'blend', y, blend FROM dref)"""


@query(f"WITH {REF} SELECT model, target_day_k, count(*) AS n, round(avg(abs(y - f)), 6) + 0.0 AS mae, {corr_sql('y', 'f')} AS cc FROM dl GROUP BY 1, 2")
def q_by_target_day(spark, sf_dir):
    l = with_reference(spark, sf_dir).unpivot(["issue_date", "target_day_k", "y"], ["p", "ref", "blend"], "model", "f")
    return l.groupBy("model", "target_day_k").agg(F.count(F.lit(1)).alias("n"), r6(err("f")).alias("mae"), r6(safe_corr("y", "f")).alias("cc"))


@query(f"""WITH {REF}, {EVENTS}, c AS (SELECT *, EXISTS (SELECT 1 FROM cme WHERE day BETWEEN issue_date - 2 AND issue_date) AS hit FROM dref),
    pairs AS (SELECT hit, target_day_k, 'model - ref' AS comparison, issue_date AS date, y, p AS a, ref AS b FROM c UNION ALL SELECT hit, target_day_k, 'blend - model', issue_date, y, blend, p FROM c),
    ds AS (SELECT hit, target_day_k, comparison, date AS block, abs(y - a) - abs(y - b) AS v FROM pairs), {bootstrap_mean_sql("bm", "ds", ["hit", "target_day_k", "comparison"], 2000)}, n AS (SELECT hit, target_day_k, comparison, count(*) AS n FROM pairs GROUP BY ALL)
    SELECT hit, target_day_k, comparison, n, mean AS d_mae, lo AS d_mae_lo, hi AS d_mae_hi FROM bm JOIN n USING (hit, target_day_k, comparison)""")
def q_cme_paired(spark, sf_dir):
    """Error differences on issue days with and without a recent event, with intervals from resampled days (the series is too short for months)."""
    flags = flag_days(event_days(spark, sf_dir), catalog_of(spark, sf_dir, "error", 2), "day", 0, 2, "hit").withColumnRenamed("date", "issue_date")
    j = with_reference(spark, sf_dir).join(flags, "issue_date", "left").withColumn("hit", F.coalesce("hit", F.lit(False)))
    gap = lambda a, b: F.abs(F.col("y") - F.col(a)) - F.abs(F.col("y") - F.col(b))
    long = j.select("hit", "target_day_k", "issue_date", gap("p", "ref").alias("model - ref"), gap("blend", "p").alias("blend - model")).unpivot(["hit", "target_day_k", "issue_date"], ["model - ref", "blend - model"], "comparison", "v")
    keys = ["hit", "target_day_k", "comparison"]
    b = bootstrap_mean(long, "v", F.col("issue_date"), keys).join(long.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")), keys)
    return b.select(*keys, "n", F.col("mean").alias("d_mae"), F.col("lo").alias("d_mae_lo"), F.col("hi").alias("d_mae_hi"))


@query(f"WITH {REF} SELECT issue_date, target_day_k, round(p, 6) + 0.0 AS from_bins, round(ref, 6) + 0.0 AS reference, round(blend, 6) + 0.0 AS blend, round(abs(p - ref), 6) + 0.0 AS differ FROM dref")
def q_daily_crosscheck(spark, sf_dir):
    """The daily products side by side for each issue and day."""
    d = with_reference(spark, sf_dir)
    return d.select("issue_date", "target_day_k", r6(F.col("p")).alias("from_bins"), r6(F.col("ref")).alias("reference"), r6(F.col("blend")).alias("blend"), r6(F.abs(F.col("p") - F.col("ref"))).alias("differ"))


@query(f"""WITH {REF}, s0 AS (SELECT issue_date, target_day_k, avg(exp(mu) - 1) AS seed0, count(*) AS n FROM fc3 WHERE seed = 0 GROUP BY 1, 2)
    SELECT target_day_k, count(*) AS n, round(avg(abs(p - y)), 6) + 0.0 AS mae_p, round(avg(abs(ref - y)), 6) + 0.0 AS mae_ref, round(avg(abs(blend - y)), 6) + 0.0 AS mae_blend, round(avg(abs(seed0 - y)), 6) + 0.0 AS mae_seed0
    FROM dref JOIN s0 USING (issue_date, target_day_k) GROUP BY 1""")
def q_daily_derived(spark, sf_dir):
    """Daily errors of four products."""
    f = A.forecast_3h(spark, sf_dir).where("seed = 0").groupBy("issue_date", "target_day_k").agg(F.avg(F.expm1("mu")).alias("seed0"))
    j = with_reference(spark, sf_dir).join(f, ["issue_date", "target_day_k"])
    return j.groupBy("target_day_k").agg(F.count(F.lit(1)).alias("n"), *[r6(err(c)).alias(f"mae_{c}") for c in ("p", "ref", "blend", "seed0")])


L6 = f"""{ENS}, w AS (SELECT *, lag(y, 1) OVER (PARTITION BY lead_step_3h ORDER BY issue_date) AS ref FROM ens), l AS (SELECT CAST(h AS INTEGER) AS horizon, w.* FROM w JOIN (SELECT unnest([1, 2, 3]) AS h) ON target_day_k <= h WHERE ref IS NOT NULL),
    ds AS (SELECT horizon, issue_date AS block, abs(p - y) - abs(ref - y) AS v FROM l), {bootstrap_mean_sql("b1", "ds", ["horizon"], 2000)},
    dc AS (SELECT * FROM l WHERE EXISTS (SELECT 1 FROM cme WHERE day BETWEEN issue_date - 2 AND issue_date)), dd AS (SELECT horizon, issue_date AS block, abs(p - y) - abs(ref - y) AS v FROM dc), {bootstrap_mean_sql("b2", "dd", ["horizon"], 2000)}"""


@query(f"""WITH {EVENTS}, {L6}, m AS (SELECT horizon, count(*) AS n, round(avg(abs(p - y)), 6) + 0.0 AS mae, {corr_sql('y', 'p')} AS cc, round(avg(abs(ref - y)), 6) + 0.0 AS mae_ref, {corr_sql('y', 'ref')} AS cc_ref FROM l GROUP BY 1)
    SELECT m.*, b1.mean AS d_mae, b1.lo AS d_mae_lo, b1.hi AS d_mae_hi, b2.mean AS event_d_mae, b2.lo AS event_d_mae_lo, b2.hi AS event_d_mae_hi FROM m JOIN b1 USING (horizon) LEFT JOIN b2 USING (horizon)""")
def q_l6_length_curve(spark, sf_dir):
    """Error up to each horizon with the reference on the same rows, and their difference on all and on event days with intervals from resampled issues."""
    e = ensemble(A.forecast_3h(spark, sf_dir)).withColumn("ref", F.lag("y").over(Window.partitionBy("lead_step_3h").orderBy("issue_date"))).where("ref is not null")
    l = e.withColumn("horizon", F.explode(F.sequence(F.col("target_day_k"), F.lit(3))))
    curve = l.groupBy("horizon").agg(F.count(F.lit(1)).alias("n"), r6(err("p")).alias("mae"), r6(safe_corr("y", "p")).alias("cc"), r6(err("ref")).alias("mae_ref"), r6(safe_corr("y", "ref")).alias("cc_ref"))
    gap = l.select("horizon", "issue_date", (F.abs(F.col("p") - F.col("y")) - F.abs(F.col("ref") - F.col("y"))).alias("v"))
    days = flag_days(event_days(spark, sf_dir), catalog_of(spark, sf_dir, "error", 2), "day", 0, 2, "hit").where("hit").select(F.col("date").alias("issue_date"))

    def effect(rows: DataFrame, name: str) -> DataFrame:
        b = bootstrap_mean(rows, "v", F.col("issue_date"), ["horizon"])
        return b.select("horizon", F.col("mean").alias(name), F.col("lo").alias(f"{name}_lo"), F.col("hi").alias(f"{name}_hi"))

    return curve.join(effect(gap, "d_mae"), "horizon").join(effect(gap.join(days, "issue_date", "left_semi"), "event_d_mae"), "horizon", "left")


@query(f"""WITH {ENS}, {EVENTS}, s AS (SELECT *, CAST((lead_step_3h - 1) % 8 AS INTEGER) AS bin FROM ens WHERE n_seeds = 3 AND EXISTS (SELECT 1 FROM cme WHERE day BETWEEN issue_date - 2 AND issue_date))
    SELECT coalesce('day' || target_day_k, 'all') AS day, coalesce(CAST(bin AS VARCHAR), 'all') AS bin, {THREE} FROM s GROUP BY GROUPING SETS ((), (target_day_k), (bin))""")
def q_metrics_3h(spark, sf_dir):
    """Whole seeds on event days: over all, by target day, by clock bin."""
    flags = flag_days(event_days(spark, sf_dir), catalog_of(spark, sf_dir, "error", 2), "day", 0, 2, "hit").where("hit").select(F.col("date").alias("issue_date"))
    # an issue date before the month's grid can't follow an event of it
    s = ensemble(A.forecast_3h(spark, sf_dir)).where("n_seeds = 3").join(flags, "issue_date", "left_semi")
    day, clock = F.concat(F.lit("day"), "target_day_k"), ((F.col("lead_step_3h") - 1) % 8).cast("string")
    groups = F.array(F.struct(F.lit("all").alias("day"), F.lit("all").alias("bin")), F.struct(day.alias("day"), F.lit("all").alias("bin")), F.struct(F.lit("all").alias("day"), clock.alias("bin")))
    return s.withColumn("g", F.explode(groups)).groupBy(F.col("g.day").alias("day"), F.col("g.bin").alias("bin")).agg(*three("y", "p"))


BANDS = (0.025, 0.16, 0.5, 0.84, 0.975)


@query(f"""WITH RECURSIVE {A.FORECAST}, g AS (SELECT issue_date, lead_step_3h, list(mu) AS mus, list(sigma) AS sigmas, min(mu - 9 * sigma) AS lo, max(mu + 9 * sigma) AS hi FROM fc3 WHERE target_day_k = 1 GROUP BY ALL),
    b AS (SELECT g.*, p, 0 AS i FROM g, (SELECT unnest([{", ".join(map(str, BANDS))}]) AS p)
        UNION ALL SELECT issue_date, lead_step_3h, mus, sigmas, CASE WHEN f < p THEN x ELSE lo END, CASE WHEN f < p THEN hi ELSE x END, p, i + 1
        FROM (SELECT *, list_avg(list_transform(list_zip(mus, sigmas), lambda c: {phi_sql("((x - c[1]) / c[2])")})) AS f FROM (SELECT *, (lo + hi) / 2 AS x FROM b WHERE i < 48)))
    SELECT issue_date, lead_step_3h, {", ".join(f"round(exp(max((lo + hi) / 2) FILTER (p = {p})) - 1, 6) + 0.0 AS q{int(p * 1000)}" for p in BANDS)} FROM b WHERE i = 48 GROUP BY 1, 2""")
def q_mixture_bands(spark, sf_dir):
    """Quantiles of the mixture of seeds for each bin, by inverting its distribution function."""
    g = seed_mixtures(spark, sf_dir).withColumn("q", mixture("mus", "sigmas", "y", BANDS)["q"])
    return g.select("issue_date", "lead_step_3h", *[r6(F.get("q", F.lit(i))).alias(f"q{int(p * 1000)}") for i, p in enumerate(BANDS)])


@query(f"""WITH {A.FORECAST}, s AS (SELECT target_day_k, lead_step_3h, seed, avg(abs(exp(mu) - 1 - observed_ap)) AS mae FROM fc3 GROUP BY 1, 2, 3)
    SELECT target_day_k, lead_step_3h, round(min(mae), 6) + 0.0 AS low, round(avg(mae), 6) + 0.0 AS mid, round(max(mae), 6) + 0.0 AS high FROM s GROUP BY 1, 2""")
def q_benchmark_slices(spark, sf_dir):
    """Step curve with the range over seeds."""
    s = A.forecast_3h(spark, sf_dir).groupBy("target_day_k", "lead_step_3h", "seed").agg(F.avg(F.abs(F.expm1("mu") - F.col("observed_ap"))).alias("mae"))
    return s.groupBy("target_day_k", "lead_step_3h").agg(r6(F.min("mae")).alias("low"), r6(F.avg("mae")).alias("mid"), r6(F.max("mae")).alias("high"))


@query(f"""WITH {A.FORECAST}, i AS (SELECT issue_date FROM fc3 GROUP BY 1 HAVING count(DISTINCT target_day_k) = 3), c AS (SELECT h AS horizon, f.* FROM fc3 f JOIN i USING (issue_date), range(1, 4) AS g(h) WHERE target_day_k <= h)
    SELECT CAST(horizon AS INTEGER) AS horizon, count(*) AS n, count(DISTINCT issue_date) AS n_issues, round(avg(abs(exp(mu) - 1 - observed_ap)) FILTER (target_day_k = 1), 6) + 0.0 AS mae_day1, round(avg(abs(exp(mu) - 1 - observed_ap)), 6) + 0.0 AS mae FROM c GROUP BY 1""")
def q_day1_cohort(spark, sf_dir):
    """The same issues (those with all days) at each horizon: their first day, and all days up to the horizon."""
    f = A.forecast_3h(spark, sf_dir)
    whole = f.groupBy("issue_date").agg(F.countDistinct("target_day_k").alias("n")).where("n = 3").select("issue_date")
    c = f.join(whole, "issue_date", "left_semi").withColumn("horizon", F.explode(F.sequence(F.col("target_day_k"), F.lit(3))))
    d = F.abs(F.expm1("mu") - F.col("observed_ap"))
    return c.groupBy("horizon").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("issue_date").alias("n_issues"), r6(F.avg(F.when(F.col("target_day_k") == 1, d))).alias("mae_day1"), r6(F.avg(d)).alias("mae"))


@query(f"""WITH {A.FORECAST}, top AS (SELECT max_by(CAST(time AS DATE), (round(observed_ap, 9), time)) AS day FROM fc3), w AS (SELECT f.* FROM fc3 f JOIN top ON CAST(f.time AS DATE) BETWEEN top.day - 1 AND top.day + 1)
    SELECT time, target_day_k, round(min_by(observed_ap, seed), 6) + 0.0 AS observed, round(avg(exp(mu) - 1), 6) + 0.0 AS mean, round(min_by(exp(mu) - 1, seed), 6) + 0.0 AS first, count(*) AS n FROM w GROUP BY 1, 2""")
def q_chained_case(spark, sf_dir):
    """The days around the largest observation as chained series of each day ahead: per time the observation, the mean over seeds and the first seed."""
    f = A.forecast_3h(spark, sf_dir)
    top = f.agg(F.max_by(F.to_date("time"), F.struct(F.round("observed_ap", 9), "time")).alias("day"))  # one row
    w = f.join(F.broadcast(top), F.to_date("time").between(F.date_sub("day", 1), F.date_add("day", 1)))
    p = F.expm1("mu")
    return w.groupBy("time", "target_day_k").agg(r6(F.min_by("observed_ap", "seed")).alias("observed"), r6(F.avg(p)).alias("mean"), r6(F.min_by(p, F.col("seed"))).alias("first"), F.count(F.lit(1)).alias("n"))


@query(f"""WITH {A.CATALOG}, s AS (SELECT DISTINCT CAST(datetime AS DATE) AS date FROM catalog WHERE source IN ('view', 'click')), two AS (SELECT CAST(datetime AS DATE) AS date, count(*) FILTER (source = 'view') AS n_fast, count(*) FILTER (source = 'click') AS n_slow FROM catalog GROUP BY 1)
    SELECT date, n_fast, n_slow, n_fast > 0 AND n_slow > 0 AS both FROM two JOIN s USING (date)""")
def q_two_cadences(spark, sf_dir):
    """Two sources' frames of each issue day side by side, and whether both have the day (a difference would be an error for a sample)."""
    c = A.catalog(spark, sf_dir).withColumn("date", F.to_date("datetime"))
    one = lambda source, name: c.where(F.col("source") == source).groupBy("date").agg(F.count(F.lit(1)).alias(name))
    j = one("view", "n_fast").join(one("click", "n_slow"), "date", "full")
    j = j.select("date", F.coalesce("n_fast", F.lit(0)).alias("n_fast"), F.coalesce("n_slow", F.lit(0)).alias("n_slow"))
    return j.withColumn("both", (F.col("n_fast") > 0) & (F.col("n_slow") > 0))


#: Which inputs each arm of a comparison has, and the arm without images that it is held against.
ARM_NAMES = {"I": ("images and series", "S"), "S": ("series only", "S"), "F": ("images and all features", "T"), "T": ("all features but images", "T")}


@query(f"""WITH {A.CATALOG}, m(arm, label, twin) AS (VALUES {", ".join(f"('{k}', '{a}', '{b}')" for k, (a, b) in ARM_NAMES.items())}), c AS (SELECT CASE source WHEN 'view' THEN 'I' WHEN 'click' THEN 'S' WHEN 'signup' THEN 'F' WHEN 'purchase' THEN 'T' ELSE 'X' END AS arm, count(*) AS n FROM catalog GROUP BY 1)
    SELECT c.arm, coalesce(label, 'unknown') AS label, twin, n FROM c LEFT JOIN m USING (arm)""")
def q_arm_labels(spark, sf_dir):
    """Codes of arms with their labels and twins; a code that isn't known keeps its row."""
    codes = F.create_map(*[F.lit(x) for kv in {"view": "I", "click": "S", "signup": "F", "purchase": "T"}.items() for x in kv])
    c = A.catalog(spark, sf_dir).groupBy(F.coalesce(codes[F.col("source")], F.lit("X")).alias("arm")).agg(F.count(F.lit(1)).alias("n"))
    known = spark.createDataFrame([(k, *v) for k, v in ARM_NAMES.items()], "arm string, label string, twin string")
    return c.join(F.broadcast(known), "arm", "left").select("arm", F.coalesce("label", F.lit("unknown")).alias("label"), "twin", "n")


@query("""WITH m AS (SELECT CAST(unnest(generate_series(date_trunc('month', min(o_orderdate)), date_trunc('month', max(o_orderdate)), INTERVAL 1 MONTH)) AS DATE) AS month FROM orders)
    SELECT month, CAST(last_day(month) AS DATE) AS last, count(o_orderkey) AS n FROM m LEFT JOIN orders ON date_trunc('month', o_orderdate) = month GROUP BY 1, 2""")
def q_months(spark, sf_dir):
    """Every month of the series with its last day and its rows."""
    o = A.read(spark, sf_dir, "orders").select(F.trunc("o_orderdate", "month").alias("month"))
    ends = o.agg(F.min("month").alias("lo"), F.max("month").alias("hi")).where("lo is not null")
    every = ends.select(F.explode(F.expr("sequence(lo, hi, interval 1 month)")).alias("month"))
    counts = o.groupBy("month").agg(F.count(F.lit(1)).alias("n"))
    return every.join(counts, "month", "left").select("month", F.last_day("month").alias("last"), F.coalesce("n", F.lit(0)).alias("n"))


@query("""SELECT CAST(o_orderdate AS DATE) AS date, count(*) AS n, round(avg(o_totalprice), 4) AS mean FROM orders WHERE o_orderdate >= TIMESTAMP '1996-01-01' AND o_orderdate < TIMESTAMP '1998-01-01' AND o_orderstatus = 'F' GROUP BY 1""")
def q_bound_sql(spark, sf_dir):
    """A statement with its bounds and a status bound as parameters."""
    import datetime as dt

    sql = "select cast(o_orderdate as date) as date, count(*) as n, round(avg(o_totalprice), 4) as mean from {orders} where o_orderdate >= :first and o_orderdate < :end and o_orderstatus = :status group by 1"
    return sql_frame(spark, sql, {"orders": A.read(spark, sf_dir, "orders")}, first=dt.datetime(1996, 1, 1), end=dt.datetime(1998, 1, 1), status="F")


@query(f"WITH {A.FORECAST} SELECT issue_date, lead_step_3h, round(mu, 6) + 0.0 AS mu FROM fc3 WHERE seed = 1 AND target_day_k = 2")
def q_matched_filter(spark, sf_dir):
    """The long forecast table, written by group and read with filters that prune its folders."""
    path = scratch_path(spark, "matched")
    A.forecast_3h(spark, sf_dir).select("issue_date", "lead_step_3h", "mu", "seed", "target_day_k").write.partitionBy("seed", "target_day_k").parquet(path)
    return spark.read.parquet(path).where("seed = 1 and target_day_k = 2").select("issue_date", "lead_step_3h", r6(F.col("mu")).alias("mu"))
