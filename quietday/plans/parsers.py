"""Queries over report texts, JSON catalogs, file names and hashes."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from quietday.functions.columns import kp_to_ap, r6
from quietday.plans import composed as C
from quietday.plans.registry import query
from quietday.session import scratch_path
from quietday.sources import adapters as A
from quietday.sources import reports as R
from quietday.sources.array_files import read_arrays, seed_groups, write_arrays, write_contents
from quietday.sources.files import manifest

@query(f"WITH {C.WHOLE} SELECT date, CAST(date AS TIMESTAMP) + to_hours(3 * bin) AS time, CASE WHEN ap IS NOT NULL THEN round(ap % 28 / 3, 3) END AS kp, CAST(ap AS DOUBLE) AS ap FROM wb")
def q_gfz_parse(spark, sf_dir):
    return R.unroll_bins(R.daily_text(C.day_lines(spark, sf_dir)))


@query(f"WITH {C.WHOLE} SELECT date, max(round(ap % 28 / 3, 3)) AS kp_max, round(avg(ap), 6) + 0.0 AS ap_mean, count(ap) AS n_bins FROM wb GROUP BY 1")
def q_gfz_rowagg(spark, sf_dir):
    d = R.daily_text(C.day_lines(spark, sf_dir))
    ap = F.filter(F.array(*[f"ap{i}" for i in range(1, 9)]), lambda x: x.isNotNull())
    mean = F.try_divide(F.aggregate(ap, F.lit(0.0), lambda a, x: a + x), F.size(ap))
    return d.select("date", F.greatest(*[f"kp{i}" for i in range(1, 9)]).alias("kp_max"), r6(mean).alias("ap_mean"), F.size(ap).cast("long").alias("n_bins"))


@query(f"WITH {C.WHOLE} SELECT count(*) AS n_days, count(CASE WHEN round_even(m, 0) <> floor(m) THEN 1 END) AS n_differ FROM (SELECT date, avg(ap) AS m FROM wb GROUP BY 1 HAVING count(ap) = 8)")
def q_gfz_check(spark, sf_dir):
    """Whole days whose half-even rounded mean of eight bins differs from the daily value in the file (which is cut, not rounded)."""
    d = R.daily_text(C.day_lines(spark, sf_dir))
    m = R.unroll_bins(d).groupBy("date").agg(F.avg("ap").alias("m"), F.count("ap").alias("n")).where("n = 8").join(d.select("date", "Ap"), "date")
    return m.agg(F.count(F.lit(1)).alias("n_days"), F.count_if(F.bround("m", 0) != F.col("Ap")).alias("n_differ"))


@query(f"WITH {C.REPORTS} SELECT * FROM reports")
def q_rsga_parse(spark, sf_dir):
    return R.activity_report(C.activity_reports(spark, sf_dir))


@query(f"WITH {C.REPORTS}, r AS (SELECT *, row_number() OVER (PARTITION BY target_date ORDER BY issue_date DESC, issue_time DESC) AS rn FROM reports WHERE kind = 'predicted' AND lead = 2) SELECT target_date, issue_date, afr, ap FROM r WHERE rn = 1")
def q_rsga_leadk(spark, sf_dir):
    r = R.activity_report(C.activity_reports(spark, sf_dir)).where("kind = 'predicted' and lead = 2")
    last = F.row_number().over(Window.partitionBy("target_date").orderBy(F.desc("issue_date"), F.desc("issue_time")))
    return r.withColumn("rn", last).where("rn = 1").select("target_date", "issue_date", "afr", "ap")


@query(f"WITH {C.REPORTS}, m AS (SELECT *, max(issue_time) OVER (PARTITION BY issue_date) AS latest FROM reports) SELECT * EXCLUDE (latest) FROM m WHERE issue_time = latest")
def q_latest_issuance(spark, sf_dir):
    r = R.activity_report(C.activity_reports(spark, sf_dir))
    return r.withColumn("latest", F.max("issue_time").over(Window.partitionBy("issue_date"))).where("issue_time = latest").drop("latest").distinct()


@query(f"WITH {C.OUTLOOKS} SELECT * FROM o45")
def q_45day_parse(spark, sf_dir):
    return R.outlook_45day(C.outlook_texts(spark, sf_dir))


@query(f"WITH {C.OUTLOOKS} SELECT * FROM o45")
def q_45day_json(spark, sf_dir):
    return R.outlook_45day_json(C.outlook_json(spark, sf_dir))


@query(f"WITH {C.KP} SELECT * FROM kp")
def q_geomag_parse(spark, sf_dir):
    return R.kp_forecast(C.kp_reports(spark, sf_dir), "source_file")


@query(f"WITH {C.KP} SELECT target_day_k, count(*) AS n, bool_and(issue_date < target_date) AS qc_issue_before_target, bool_and(target_date - issue_date = target_day_k) AS qc_target_dates FROM kp WHERE status = 'ok' GROUP BY 1")
def q_geomag_qc(spark, sf_dir):
    r = R.kp_forecast(C.kp_reports(spark, sf_dir), "source_file").where("status = 'ok'")
    return r.groupBy("target_day_k").agg(
        F.count(F.lit(1)).alias("n"), F.bool_and(F.col("issue_date") < F.col("target_date")).alias("qc_issue_before_target"), F.bool_and(F.datediff("target_date", "issue_date") == F.col("target_day_k")).alias("qc_target_dates")
    )


@query("""WITH t AS (SELECT unnest([0, 2, 3, 4, 5, 6, 7, 9, 12, 15, 18, 22, 27, 32, 39, 48, 56, 67, 80, 94, 111, 132, 154, 179, 207, 236, 300, 400]) AS ap, unnest(generate_series(0, 27)) AS step)
    SELECT event_id, CASE WHEN abs(value / 10 - round_even(value / 10 * 3, 0) / 3) <= 0.02 THEN CAST(ap AS DOUBLE) END AS ap FROM events LEFT JOIN t ON t.step = round_even(value / 10 * 3, 0)""")
def q_kp_to_ap(spark, sf_dir):
    return A.read(spark, sf_dir, "events").select("event_id", kp_to_ap(F.col("value") / 10).alias("ap"))


@query("""SELECT page_id, array_to_string(list_sort(list_distinct(regexp_extract_all(html, 'href="(/[a-z]+)"', 1))), ' ') AS links FROM pages""")
def q_href_extract(spark, sf_dir):
    links = F.expr("""regexp_extract_all(html, 'href="(/[a-z]+)"', 1)""")
    return A.read(spark, sf_dir, "pages").select("page_id", F.array_join(F.array_sort(F.array_distinct(links)), " ").alias("links"))


#: Documents in a stored file.
IN_A_FILE = 16


@query(f"""WITH f AS (SELECT doc_id // {IN_A_FILE} AS part, string_agg(coalesce(text, ''), chr(10) ORDER BY doc_id) AS content FROM documents GROUP BY 1)
    SELECT 'part-' || lpad(CAST(part AS VARCHAR), 12, '0') || '.txt' AS file, CAST(octet_length(encode(content)) AS BIGINT) AS bytes, sha256(content) AS sha256 FROM f""")
def q_sha_manifest(spark, sf_dir):
    """Name, bytes and SHA-256 of files on disk, of a few documents each."""
    d = A.read(spark, sf_dir, "documents").select(F.floor(F.col("doc_id") / IN_A_FILE).alias("part"), "doc_id", F.coalesce("text", F.lit("")).alias("text"))
    f = d.groupBy("part").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("doc_id", "text"))), lambda x: x["text"]), "\n").alias("content"))
    root = scratch_path(spark, "texts")
    write_contents(f.select(F.concat(F.lit("part-"), F.lpad(F.col("part").cast("string"), 12, "0"), F.lit(".txt")).alias("name"), F.encode("content", "UTF-8").alias("content")), root)
    return manifest(spark, root, "part-*.txt")


@query("""SELECT a.doc_id, min(b.doc_id) AS twin_id, count(*) AS n FROM documents a JOIN documents b ON sha256(b.text) = sha256(a.text) AND b.source <> a.source GROUP BY 1""")
def q_archive_anomalies(spark, sf_dir):
    """Files that another archive holds too, byte for byte: by hash, counted per source so that no pairs are listed."""
    d = A.read(spark, sf_dir, "documents").select("doc_id", "source", F.sha2("text", 256).alias("h"))
    by = d.groupBy("h", "source").agg(F.count(F.lit(1)).alias("n"), F.min("doc_id").alias("least"))
    # per hash the sources, of which there is a bounded number
    sets = by.groupBy("h").agg(F.collect_list(F.struct("source", "n", "least")).alias("s")).where(F.size("s") > 1)
    others = F.filter("s", lambda x: x["source"] != F.col("source"))
    j = d.join(sets, "h").withColumn("o", others)
    return j.select("doc_id", F.array_min(F.transform("o", lambda x: x["least"])).alias("twin_id"), F.aggregate("o", F.lit(0).cast("long"), lambda a, x: a + x["n"]).alias("n"))


@query("""WITH f AS (SELECT event_type, CAST(user_id % 7 AS INTEGER) AS len, CAST(event_id % 3 AS INTEGER) AS seed, count(*) AS n, avg(ln(1 + value)) AS mu, min(value) AS low, max(value) AS high FROM events WHERE value < 200 GROUP BY 1, 2, 3)
    SELECT 'l6' AS tag, 'A' AS split, event_type AS model, len AS history, count(*) AS n_seeds, 'l6_ckpt_A_' || event_type || '_L' || len || '_s' || min(seed) || '.npz' AS checkpoint,
        round(avg(mu), 6) + 0.0 AS mu, round(avg(low), 6) + 0.0 AS low, round(avg(high), 6) + 0.0 AS high, round(avg(n), 6) + 0.0 AS n FROM f GROUP BY event_type, len HAVING count(*) = 3""")
def q_runs_registry(spark, sf_dir):
    """Runs stored as array files, one a seed: keys from their names, the groups with exactly three seeds, the first one's checkpoint, and the seeds' mean of what the files hold."""
    seed = A.read(spark, sf_dir, "events").where("value < 200").select(F.col("event_type").alias("label"), (F.col("user_id") % 7).alias("len"), (F.col("event_id") % 3).alias("seed"), "value")
    runs = seed.groupBy("label", "len", "seed").agg(F.avg(F.log1p("value")).alias("m"), F.min("value").alias("low"), F.max("value").alias("high"), F.count(F.lit(1)).cast("double").alias("n"))
    name = F.concat(F.lit("l6_preds_A_"), "label", F.lit("_L"), "len", F.lit("_s"), "seed", F.lit(".npz"))
    root = scratch_path(spark, "runs")
    write_arrays(runs.select(name.alias("name"), F.array("m").alias("mu"), F.array("low", "high", "n").alias("facts")), root, ["mu", "facts"])
    files = read_arrays(spark, root, ["mu", "facts"], r"(?P<tag>\w+?)_preds_(?P<split>[A-Z])_(?P<model>\w+?)_L(?P<history>\d+)_s(?P<seed>\d+)\.npz")
    g = seed_groups(files, ["tag", "split", "model", "history"], ["mu", "facts"])
    fact = lambda c, i, name: r6(F.get(c, F.lit(i))).alias(name)
    checkpoint = F.regexp_replace("first_name", "_preds_", "_ckpt_").alias("checkpoint")
    return g.select("tag", "split", "model", F.col("history").cast("int").alias("history"), "n_seeds", checkpoint, fact("mu", 0, "mu"), *[fact("facts", i, c) for i, c in enumerate(("low", "high", "n"))])


@query(f"""WITH {C.ERUPTIONS} SELECT strftime(ts, '%Y-%m-%dT%H:%M:%S') || '-CME-' || event_id AS cme_id, CASE event_id % 4 WHEN 0 THEN NULL WHEN 1 THEN value ELSE value * 2 END AS speed,
    coalesce(CASE event_id % 4 WHEN 0 THEN NULL WHEN 1 THEN abs(k * 2) <= 25 ELSE abs(k - 40) <= 25 END, false) AS cone_hit, event_id % 4 > 1 AND user_id % 3 = 0 AND (k % 5 = 0 OR user_id % 2 = 0) AS enlil_hit,
    cone_hit OR enlil_hit AS earth_directed, CASE WHEN event_id % 3 = 0 THEN 'FLR;IPS' ELSE '' END AS link_types FROM er""")
def q_cme_catalog(spark, sf_dir):
    """The most accurate analysis, else the first; cone and model hits; kinds of linked events."""
    best = F.coalesce(F.get(F.filter("cmeAnalyses", lambda a: a["isMostAccurate"]), 0), F.get("cmeAnalyses", 0))
    runs = F.flatten(F.transform("cmeAnalyses", lambda a: F.coalesce(a["enlilList"], F.array().cast(C.runs_type()))))
    hit = F.exists(F.coalesce(runs, F.array()), lambda e: F.coalesce(e["isEarthGB"], F.lit(False)) | e["estimatedShockArrivalTime"].isNotNull())
    kinds = F.array_join(F.transform(F.coalesce("linkedEvents", F.array()), lambda e: F.element_at(F.split(e["activityID"], "-"), -2)), ";")
    c = C.eruptions(spark, sf_dir).select(F.col("activityID").alias("cme_id"), best.alias("b"), F.coalesce(hit, F.lit(False)).alias("enlil_hit"), kinds.alias("link_types"))
    cone = F.coalesce(F.abs("b.longitude") <= F.col("b.halfAngle"), F.lit(False))
    return c.select("cme_id", F.col("b.speed").alias("speed"), cone.alias("cone_hit"), "enlil_hit", (cone | F.col("enlil_hit")).alias("earth_directed"), "link_types")


@query(f"""WITH {C.ERUPTIONS} SELECT DISTINCT date_trunc('minute', ts + INTERVAL 6 HOUR) AS done, date_trunc('minute', ts + INTERVAL 60 HOUR) AS arrival, k % 5 = 0 AS earth, CAST(greatest(k, CASE WHEN k % 2 = 0 THEN k + 1 END, 3) AS DOUBLE) AS kp_max
    FROM er WHERE event_id % 4 > 1 AND user_id % 3 = 0 AND user_id % 2 = 0""")
def q_enlil_runs(spark, sf_dir):
    """Distinct model runs with completion and arrival time, and the largest of the three index estimates."""
    r = C.eruptions(spark, sf_dir).select(F.explode("cmeAnalyses").alias("a")).select(F.explode("a.enlilList").alias("e")).select("e.*").where("modelCompletionTime is not null and estimatedShockArrivalTime is not null")
    time = lambda c: F.to_timestamp_ntz(c, F.lit(C.MINUTES))
    return r.select(time(F.col("modelCompletionTime")).alias("done"), time(F.col("estimatedShockArrivalTime")).alias("arrival"), F.coalesce("isEarthGB", F.lit(False)).alias("earth"), F.greatest("kp_90", "kp_135", "kp_180").alias("kp_max")).distinct()


BOARD_ENTRY = "cmeId string, start string, arrival string, noArrival boolean, predictions array<struct<m:string>>"


@query(f"""WITH {C.ERUPTIONS} SELECT strftime(ts, '%Y-%m-%dT%H:%M:%S') || '-CME-' || event_id AS cme_id, CASE WHEN event_id % 2 = 0 THEN date_trunc('minute', ts) ELSE date_trunc('second', ts) END AS start_time, event_id % 3 > 0 AND user_id % 2 = 0 AS arrived,
    CAST(CASE WHEN event_id % 5 = 0 THEN 0 ELSE k % 4 END AS INTEGER) AS n_predictions FROM er""")
def q_scoreboard(spark, sf_dir):
    """Start times, from the entry or else from its id; whether it arrived; how many predictions there are."""
    e = A.read(spark, sf_dir, "events").where("event_type = 'error'").withColumn("k", F.get_json_object("props", "$.k").cast("int"))
    entry = F.struct(
        F.concat(F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss"), F.lit("-CME-"), "event_id").alias("cmeId"), F.when(F.col("event_id") % 2 == 0, F.date_format("ts", C.MINUTES)).alias("start"),
        F.when(F.col("user_id") % 2 == 0, F.date_format("ts", C.MINUTES)).alias("arrival"), (F.col("event_id") % 3 == 0).alias("noArrival"),
        F.when(F.col("event_id") % 5 > 0, F.array_repeat(F.struct(F.lit("a").alias("m")), F.col("k") % 4)).alias("predictions"),
    )
    rows = C.json_lines(e, entry, "board", BOARD_ENTRY)
    start = F.coalesce(F.to_timestamp_ntz("start", F.lit(C.MINUTES)), F.to_timestamp_ntz(F.substring("cmeId", 1, 19), F.lit("yyyy-MM-dd'T'HH:mm:ss")))
    return rows.select(F.col("cmeId").alias("cme_id"), start.alias("start_time"), (~F.col("noArrival") & F.col("arrival").isNotNull()).alias("arrived"), F.coalesce(F.array_size("predictions"), F.lit(0)).alias("n_predictions"))


STREAM_ENTRY = "id string, instruments array<string>, links array<string>"


@query("""SELECT CAST(event_id AS VARCHAR) AS event_id, CASE WHEN event_id % 2 = 0 THEN event_id || '-CME-001;' || event_id || '-CME-003' ELSE '' END AS linked_cmes FROM events WHERE event_type = 'purchase' AND user_id % 3 < 2""")
def q_ips_hss(spark, sf_dir):
    """Streams seen by an instrument near Earth; links of one kind joined by `;`."""
    e = A.read(spark, sf_dir, "events").where("event_type = 'purchase'")
    seen = F.when(F.col("user_id") % 3 == 0, F.array(F.lit("ACE: SWEPAM"), F.lit("STEREO A"))).when(F.col("user_id") % 3 == 1, F.array(F.lit("dscovr: plasmag"))).otherwise(F.array(F.lit("STEREO A: PLASTIC")))
    links = F.when(F.col("event_id") % 2 == 0, F.array(*[F.concat(F.col("event_id").cast("string"), F.lit(x)) for x in ("-CME-001", "-HSS-002", "-CME-003")]))
    rows = C.json_lines(e, F.struct(F.col("event_id").cast("string").alias("id"), seen.alias("instruments"), links.alias("links")), "streams", STREAM_ENTRY)
    near = F.exists("instruments", lambda i: F.upper(i).rlike("ACE|DSCOVR|WIND|SOHO"))
    kept = F.array_join(F.filter(F.coalesce("links", F.array().cast("array<string>")), lambda x: F.element_at(F.split(x, "-"), -2) == "CME"), ";")
    return rows.where(near).select(F.col("id").alias("event_id"), kept.alias("linked_cmes"))


@query("""SELECT item_id, 'see ' || text || ' and label ' || item_id AS text FROM benchmark""")
def q_wikilink(spark, sf_dir):
    """Double brackets around a target, or a target and a label, become the target or the label."""
    b = A.read(spark, sf_dir, "benchmark").select("item_id", F.concat(F.lit("see [["), "text", F.lit("]] and [["), "item_id", F.lit("|label "), "item_id", F.lit("]]")).alias("text"))
    # what stands before an opening pair is kept; up to the closing one, only what follows the last bar
    parts = F.transform(F.split("text", r"\[\["), lambda p, i: F.when(i == 0, p).otherwise(F.concat(F.substring_index(F.substring_index(p, "]]", 1), "|", -1), F.substring_index(p, "]]", -1))))
    return b.select("item_id", F.array_join(parts, "").alias("text"))
