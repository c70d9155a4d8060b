"""Report texts, day lines and JSON catalogs composed from the test tables, written and read back by the readers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quietday.session import scratch_path
from quietday.sources import adapters as A
from quietday.sources import files
from quietday.sources.reports import BINS


def bundle(df: DataFrame, text: Column, name: str) -> DataFrame:
    """The composed texts, through a folder of bundles."""
    path = scratch_path(df.sparkSession, name)
    df.select(text.alias("value")).write.option("lineSep", "\f").text(path)
    return files.report_bundle(df.sparkSession, path)


def json_lines(df: DataFrame, entry: Column, name: str, schema: str) -> DataFrame:
    path = scratch_path(df.sparkSession, name)
    df.select(F.to_json(entry).alias("value")).write.text(path)
    return files.json_entries(df.sparkSession, path, schema, lines=True)


def three(c: Column) -> Column:
    """Three digits, more if the number needs them, or NA."""
    whole = F.floor(c)
    return F.when(whole.isNotNull(), F.format_string("%03d", whole)).otherwise("NA")


def day(c: Column) -> Column:
    return F.date_format(c, "dd MMM")


def activity_reports(spark, sf_dir) -> DataFrame:
    """Two reports for each day of the daily series: of 01:00 and of 22:00, the first with another estimate."""
    s = A.daily(spark, sf_dir)
    t = s.select("date", F.explode(F.sequence(F.lit(-1), F.lit(3))).alias("lead"))
    v = s.select(F.col("date").alias("d"), F.concat(three(F.col("f107") + 90), F.lit("/"), three(F.col("ap"))).alias("pair"), F.concat(three(F.col("f107") + 90), F.lit("/"), three(F.col("ap") + 1)).alias("early"))
    w = t.withColumn("d", F.expr("date_add(date, lead)")).join(v, "d", "left").groupBy("date")
    pick = lambda k, c="pair": F.coalesce(F.max(F.when(F.col("lead") == k, F.col(c))), F.lit("NA/NA"))
    r = w.agg(pick(-1).alias("p0"), pick(0).alias("p1"), pick(0, "early").alias("e1"), pick(1).alias("q1"), pick(2).alias("q2"), pick(3).alias("q3"))
    r = r.select("*", F.explode(F.array(F.struct(F.lit("0100").alias("at"), F.col("e1").alias("est")), F.struct(F.lit("2200").alias("at"), F.col("p1").alias("est")))).alias("i"))
    text = F.concat(
        F.lit(":Product: daily activity summary\n:Issued: "), F.date_format("date", "yyyy MMM dd"), F.lit(" "), F.col("i.at"), F.lit(" UTC\n# composed\nA.  Indices of the day before, of the day and of three days ahead\n"),
        F.lit("Observed Afr/Ap "), day(F.date_sub("date", 1)), F.lit("  "), F.col("p0"), F.lit("\nEstimated Afr/Ap "), day(F.col("date")), F.lit("  "), F.col("i.est"),
        F.lit("\nPredicted Afr/Ap "), day(F.date_add("date", 1)), F.lit("-"), day(F.date_add("date", 3)), F.lit("  "), F.concat_ws("-", "q1", "q2", "q3"), F.lit("\nB.  End\n"),
    )
    return bundle(r, text, "activity")


REPORTS = A.DAILY + """, reports AS (SELECT i.date AS issue_date, tm AS issue_time, i.date + CAST(l AS INTEGER) AS target_date, CAST(l AS INTEGER) AS lead, CASE l WHEN -1 THEN 'observed' WHEN 0 THEN 'estimated' ELSE 'predicted' END AS kind,
    floor(t.f107 + 90) AS afr, floor(t.ap + CASE WHEN l = 0 AND tm = '0100' THEN 1 ELSE 0 END) AS ap FROM daily i CROSS JOIN range(-1, 4) AS g(l) CROSS JOIN (SELECT unnest(['0100', '2200']) AS tm) LEFT JOIN daily t ON t.date = i.date + CAST(l AS INTEGER))"""


def outlook_texts(spark, sf_dir) -> DataFrame:
    """A 45-day text for each issue of the outlook role (its 27 days), five pairs to a line."""
    o = A.outlook(spark, sf_dir)
    pair = lambda v: F.concat(F.date_format("target_date", "ddMMMyy"), F.lit(" "), v)
    ap, flux = pair(three(F.col("fc"))), pair(three(F.col("lead") + 100))
    r = o.groupBy("issue_date").agg(F.sort_array(F.collect_list(F.struct("lead", ap.alias("a"), flux.alias("f")))).alias("rows"))
    block = lambda name: F.array_join(F.transform("rows", lambda x, i: F.concat(x[name], F.when(i % 5 == 4, "\n").otherwise(" "))), "")
    text = F.concat(F.lit(":Product: outlook of the coming days\n:Issued: "), F.date_format("issue_date", "yyyy MMM dd"), F.lit(" 0000 UTC\n#\n45-DAY AP FORECAST\n"), block("a"), F.lit("\n45-DAY F10.7 CM FLUX FORECAST\n"), block("f"), F.lit("\n"))
    return bundle(r, text, "outlook")


def outlook_json(spark, sf_dir) -> DataFrame:
    """The same as one JSON document for each issue."""
    stamp = lambda c: F.date_format(c, "yyyy-MM-dd'T'00:00:00'Z'")
    r = A.outlook(spark, sf_dir).groupBy("issue_date").agg(F.collect_list(F.struct(stamp("target_date").alias("time"), F.floor("fc").alias("ap"), (F.col("lead") + 100).alias("f107"))).alias("data"))
    path = scratch_path(spark, "outlook-json")
    r.select(F.to_json(F.struct(stamp("issue_date").alias("issued"), "data")).alias("value")).write.text(path)
    return spark.read.text(path).select(F.col("value").alias("text"))


OUTLOOKS = A.OUTLOOK + ", o45 AS (SELECT issue_date, target_date, lead, floor(fc) AS ap, CAST(lead + 100 AS DOUBLE) AS f107 FROM outlook)"


def whole_bins(spark, sf_dir) -> DataFrame:
    """date, bin (0 to 7), ap (whole, null if missing) for each day of the 3-hour table."""
    b = A.bins_3h(spark, sf_dir).select(F.to_date("time").alias("date"), (F.hour("time") / 3).cast("int").alias("bin"), F.floor("ap").cast("int").alias("ap"))
    days = b.select("date").distinct().withColumn("bin", F.explode(F.sequence(F.lit(0), F.lit(7))))
    return days.join(b, ["date", "bin"], "left")


WHOLE = A.BINS + ", wb AS (SELECT d.date, CAST(k AS INTEGER) AS bin, CAST(floor(b.ap) AS INTEGER) AS ap FROM (SELECT DISTINCT CAST(time AS DATE) AS date FROM bins) d CROSS JOIN range(8) AS g(k) LEFT JOIN bins b ON b.time = CAST(d.date AS TIMESTAMP) + to_hours(CAST(3 * k AS INTEGER)))"


def day_lines(spark, sf_dir) -> DataFrame:
    """The white-space table of the days: -1 where a value is missing, a third of the linear index (by 28) as the other one."""
    row = F.sort_array(F.collect_list(F.struct("bin", "ap")))
    d = whole_bins(spark, sf_dir).groupBy("date").agg(row.alias("r"), F.floor(F.avg("ap")).alias("mean"), F.count("ap").alias("n"))
    cells = lambda f: F.array_join(F.transform("r", lambda x: F.coalesce(f(x["ap"]), F.lit("-1"))), " ")
    text = F.concat_ws(
        " ", F.date_format("date", "yyyy MM dd"), F.datediff("date", F.lit("1932-01-01").cast("date")), F.lit("0.5 2500 10"), cells(lambda a: F.format_string("%.3f", (a % 28) / 3)), cells(lambda a: a.cast("string")),
        F.coalesce("mean", F.lit(-1)), F.col("n"), F.lit("135.2 130.7 2"),
    )
    path = scratch_path(spark, "day-lines")
    d.select(text.alias("value")).unionByName(spark.createDataFrame([("# year month day ...",), ("",)], "value string")).write.text(path)
    return spark.read.text(path)


def kp_reports(spark, sf_dir) -> DataFrame:
    """source_file and text of a forecast for the three days after each day that have all their bins; one in seven lacks a row, one its issue line."""
    b = whole_bins(spark, sf_dir).where("ap is not null")
    days = b.groupBy("date").agg(F.sort_array(F.collect_list(F.struct("bin", "ap"))).alias("r")).where(F.size("r") == 8)
    ahead = days.select(F.explode(F.sequence(F.lit(1), F.lit(3))).alias("k"), "date", "r").select("k", "r", F.expr("date_sub(date, k)").alias("issue_date"))
    i = ahead.groupBy("issue_date").agg(F.sort_array(F.collect_list(F.struct("k", "r"))).alias("d")).where(F.size("d") == 3)
    name, weekday = F.date_format("issue_date", "yyyyMMdd"), F.dayofweek("issue_date")
    value = lambda x, n: F.format_string("%.2f", (F.get(x["r"], n)["ap"] % 28) / 3)
    label = lambda n: F.when((weekday == 2) & F.lit(n == 3), "xx-xxUT").otherwise(BINS[n])
    marked = lambda n: F.transform("d", lambda x: F.concat(value(x, n), F.lit(" (G1)" if n == 5 else "")))
    rows = [F.concat_ws("      ", label(n), F.array_join(marked(n), "      ")) for n in range(8)]
    mean = F.array_join(F.transform("d", lambda x: F.floor(F.aggregate(x["r"], F.lit(0).cast("long"), lambda a, y: a + y["ap"]) / 8).cast("string")), "-")
    head = F.concat(F.lit(":Product: index forecast\n"), F.when(weekday == 4, F.lit("")).otherwise(F.concat(F.lit(":Issued: "), F.date_format("issue_date", "yyyy MMM dd"), F.lit(" 2205 UTC\n"))))
    text = F.concat(
        head, F.lit("Predicted Ap "), day(F.date_add("issue_date", 1)), F.lit("-"), day(F.date_add("issue_date", 3)), F.lit(" "), mean, F.lit("\n\nNOAA Kp index forecast of three days\n             "),
        F.concat_ws("    ", *[F.date_format(F.date_add("issue_date", k), "MMM dd") for k in (1, 2, 3)]), F.lit("\n"), F.concat_ws("\n", *rows), F.lit("\n"),
    )
    path = scratch_path(spark, "kp")
    i.select(F.concat(name, F.lit("\n"), text).alias("value")).write.option("lineSep", "\f").text(path)
    both = files.report_bundle(spark, path)
    return both.select(F.substring_index("text", "\n", 1).alias("source_file"), "text")


KP = WHOLE + """, full_days AS (SELECT date, floor(avg(ap)) AS mean FROM wb GROUP BY 1 HAVING count(ap) = 8), iss AS (SELECT CAST(a.date - 1 AS DATE) AS issue_date FROM full_days a WHERE a.date + 1 IN (SELECT date FROM full_days) AND a.date + 2 IN (SELECT date FROM full_days)),
    st AS (SELECT issue_date, strftime(issue_date, '%Y%m%d') AS source_file, CASE dayofweek(issue_date) WHEN 3 THEN 'no issue line' WHEN 1 THEN 'missing row' ELSE 'ok' END AS status FROM iss),
    kp AS (SELECT source_file, issue_date, CAST(k AS INTEGER) AS target_day_k, wb.date AS target_date, wb.bin, round(wb.ap % 28 / 3, 2) AS kp, f.mean AS daily_ap, status FROM st CROSS JOIN range(1, 4) AS g(k) JOIN wb ON wb.date = st.issue_date + CAST(k AS INTEGER) JOIN full_days f ON f.date = wb.date WHERE status = 'ok'
        UNION ALL SELECT source_file, CASE WHEN status = 'missing row' THEN issue_date END, NULL, NULL, NULL, NULL, NULL, status FROM st WHERE status <> 'ok')"""

ENTRY = """activityID string, startTime string, cmeAnalyses array<struct<isMostAccurate:boolean, longitude:double, halfAngle:double, speed:double,
    enlilList:array<struct<modelCompletionTime:string, estimatedShockArrivalTime:string, isEarthGB:boolean, kp_90:double, kp_135:double, kp_180:double>>>>, linkedEvents array<struct<activityID:string>>"""
MINUTES = "yyyy-MM-dd'T'HH:mm'Z'"


def eruptions(spark, sf_dir) -> DataFrame:
    """A catalog entry for each event of one type: none, one or two analyses, model runs, linked events."""
    e = A.read(spark, sf_dir, "events").where("event_type = 'error'").select("event_id", "ts", "value", "user_id", F.get_json_object("props", "$.k").cast("int").alias("k"))
    e = e.where("k is not null and value is not null and user_id is not null")
    stamp = lambda c: F.date_format(c, MINUTES)
    run = F.struct(
        stamp(F.expr("ts + interval 6 hours")).alias("modelCompletionTime"), F.when(F.col("user_id") % 2 == 0, stamp(F.expr("ts + interval 60 hours"))).alias("estimatedShockArrivalTime"), (F.col("k") % 5 == 0).alias("isEarthGB"),
        F.col("k").cast("double").alias("kp_90"), F.when(F.col("k") % 2 == 0, F.col("k") + 1.0).alias("kp_135"), F.lit(3.0).alias("kp_180"),
    )
    runs = F.when(F.col("user_id") % 3 == 0, F.array(run))
    one = lambda best, speed, longitude, list_: F.struct(F.lit(best).alias("isMostAccurate"), longitude.alias("longitude"), F.lit(25.0).alias("halfAngle"), speed.alias("speed"), list_.alias("enlilList"))
    first, second = one(False, F.col("value"), F.col("k") * 2.0, F.lit(None).cast(runs_type())), one(True, F.col("value") * 2, F.col("k") - 40.0, runs)
    analyses = F.when(F.col("event_id") % 4 == 0, F.array().cast("array<" + ANALYSIS + ">")).when(F.col("event_id") % 4 == 1, F.array(first)).otherwise(F.array(first, second))
    links = F.when(F.col("event_id") % 3 == 0, F.array(*[F.struct(F.concat(F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss"), F.lit(f"-{kind}-001")).alias("activityID")) for kind in ("FLR", "IPS")]))
    entry = F.struct(F.concat(F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss"), F.lit("-CME-"), "event_id").alias("activityID"), stamp(F.col("ts")).alias("startTime"), analyses.alias("cmeAnalyses"), links.alias("linkedEvents"))
    return json_lines(e, entry, "eruptions", ENTRY)


def runs_type() -> str:
    return "array<struct<modelCompletionTime:string, estimatedShockArrivalTime:string, isEarthGB:boolean, kp_90:double, kp_135:double, kp_180:double>>"


ANALYSIS = "struct<isMostAccurate:boolean, longitude:double, halfAngle:double, speed:double, enlilList:array<struct<modelCompletionTime:string, estimatedShockArrivalTime:string, isEarthGB:boolean, kp_90:double, kp_135:double, kp_180:double>>>"
ERUPTIONS = """er AS (SELECT event_id, ts, value, user_id, CAST(json_extract_string(props, '$.k') AS INTEGER) AS k FROM events WHERE event_type = 'error')"""
