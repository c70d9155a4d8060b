"""Frame catalogs on a regular calendar: slots, nearest and previous frames, completeness, fills."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quietday.functions.columns import r6
from quietday.operators.grids import run_complete
from quietday.operators.joins import latest_before, nearest, with_predecessor
from quietday.operators.work import named_files
from quietday.plans.registry import query
from quietday.session import scratch_path
from quietday.sources import adapters as A
from quietday.sources.array_files import listing, write_arrays

HOURS, TOLERANCE_S = (0, 6, 12, 18), 1500
#: The sources that columns are made of (a column's name must be known before the data is read).
SOURCES = ("click", "error", "purchase", "signup", "view")


def slot_targets(spark, sf_dir, start: str | None = None, end: str | None = None, hours=HOURS, by_source: bool = False) -> DataFrame:
    """One row per day and slot hour (and source), from the catalog's first day to its last, or the days given."""
    c = A.catalog(spark, sf_dir)
    bound = lambda day, of: F.to_date(of("datetime")) if day is None else F.lit(day).cast("date")
    # one row: two days and the names of the sources
    ends = c.agg(bound(start, F.min).alias("lo"), bound(end, F.max).alias("hi"), F.collect_set("source").alias("sources")).where("lo is not null and hi is not null")
    days = ends.select("sources", F.explode(F.sequence("lo", "hi")).alias("date"))
    slots = days.withColumn("slot_hour", F.explode(F.array(*[F.lit(h) for h in hours])))
    slots = slots.withColumn("slot_time", F.expr("cast(date as timestamp_ntz) + make_dt_interval(0, slot_hour)"))
    if by_source:
        return slots.select("date", "slot_hour", "slot_time", F.explode("sources").alias("source"))
    return slots.drop("sources")


TARGETS = """targets AS (SELECT CAST(d AS DATE) AS date, CAST(h AS INTEGER) AS slot_hour, d + to_hours(CAST(h AS INTEGER)) AS slot_time
    FROM (SELECT unnest(generate_series(date_trunc('day', min(ts)), date_trunc('day', max(ts)), INTERVAL 1 DAY)) AS d FROM events), (SELECT unnest([0, 6, 12, 18]) AS h))"""


@query(f"WITH {TARGETS} SELECT * FROM targets")
def q_slot_targets(spark, sf_dir):
    return slot_targets(spark, sf_dir)


def slot_table(spark, sf_dir, frames: DataFrame | None = None) -> DataFrame:
    """date, slot_hour, slot_time, source, datetime, file_path, offset_min; an empty slot keeps its row."""
    targets = slot_targets(spark, sf_dir, by_source=True)
    return nearest(targets, frames if frames is not None else A.catalog(spark, sf_dir), "slot_time", "datetime", TOLERANCE_S, ["source"], "file_path")


def slot_sql(frames: str = "catalog", name: str = "slots") -> str:
    """Ranks all frames within the tolerance of each slot: whole seconds, ties to the earlier."""
    return f"""{name}_c AS (SELECT t.*, s.source FROM targets t, (SELECT DISTINCT event_type AS source FROM events) s),
    {name}_r AS (SELECT c.date, c.slot_hour, c.slot_time, c.source, f.datetime, f.file_path, CAST(trunc(epoch_us(f.datetime - c.slot_time) / 1e6) AS BIGINT) AS sec
        FROM {name}_c c JOIN {frames} f ON f.source = c.source AND f.datetime BETWEEN c.slot_time - INTERVAL 1501 SECOND AND c.slot_time + INTERVAL 1501 SECOND),
    {name}_b AS (SELECT *, row_number() OVER (PARTITION BY slot_time, source ORDER BY abs(sec), datetime, file_path) AS rn FROM {name}_r WHERE abs(sec) <= {TOLERANCE_S}),
    {name} AS (SELECT c.date, c.slot_hour, c.slot_time, c.source, b.datetime, b.file_path, b.sec / 60.0 AS offset_min FROM {name}_c c
        LEFT JOIN {name}_b b ON b.slot_time = c.slot_time AND b.source = c.source AND b.rn = 1)"""


SLOTS = f"{A.CATALOG}, {TARGETS}, {slot_sql()}"


@query(f"WITH {SLOTS} SELECT date, slot_hour, source, datetime, file_path, round(offset_min, 6) + 0.0 AS offset_min FROM slots")
def q_slot_table(spark, sf_dir):
    return slot_table(spark, sf_dir).select("date", "slot_hour", "source", "datetime", "file_path", r6(F.col("offset_min")).alias("offset_min"))


@query(f"WITH {SLOTS} SELECT slot_time, datetime, round(offset_min, 6) + 0.0 AS offset_min FROM slots WHERE source = 'view'")
def q_nearest_frames(spark, sf_dir):
    t = slot_targets(spark, sf_dir).select("slot_time", F.lit("view").alias("source"))
    n = nearest(t, A.catalog(spark, sf_dir), "slot_time", "datetime", TOLERANCE_S, ["source"], "file_path")
    return n.select("slot_time", "datetime", r6(F.col("offset_min")).alias("offset_min"))


PRED = """pred AS (SELECT c.* FROM catalog c WHERE EXISTS (SELECT 1 FROM catalog p WHERE p.source = c.source
    AND p.datetime BETWEEN c.datetime - INTERVAL 30 MINUTE AND c.datetime - INTERVAL 6 MINUTE))"""


@query(f"WITH {A.CATALOG}, {PRED} SELECT * FROM pred")
def q_with_predecessor(spark, sf_dir):
    return with_predecessor(A.catalog(spark, sf_dir), "datetime", 360, 1800, ["source"])


def slots_with_prev(spark, sf_dir) -> DataFrame:
    """Slots with the latest frame 6 to 30 minutes before the slot's frame."""
    s = slot_table(spark, sf_dir).where("source = 'view' and datetime is not null").select("date", "slot_hour", "source", "datetime", "file_path")
    return latest_before(s, A.catalog(spark, sf_dir), "datetime", "datetime", 360, 1800, ["source"], "file_path")


PREV = f"""{SLOTS}, v AS (SELECT * FROM slots WHERE source = 'view' AND datetime IS NOT NULL),
    pv AS (SELECT v.date, v.slot_hour, v.datetime, v.file_path, max(p.datetime) AS prev_time, max_by(p.file_path, p.datetime) AS prev_path FROM v
        LEFT JOIN catalog p ON p.source = 'view' AND p.datetime BETWEEN v.datetime - INTERVAL 30 MINUTE AND v.datetime - INTERVAL 6 MINUTE GROUP BY ALL)"""


@query(f"WITH {PREV} SELECT date, slot_hour, prev_time, prev_path FROM pv")
def q_prev_frame(spark, sf_dir):
    return slots_with_prev(spark, sf_dir).select("date", "slot_hour", "prev_time", "prev_path")


@query(f"""WITH {PREV} SELECT t.date, t.slot_hour, CASE WHEN prev_path IS NOT NULL THEN file_path END AS file_path FROM targets t LEFT JOIN pv ON pv.date = t.date AND pv.slot_hour = t.slot_hour""")
def q_slots_with_prev(spark, sf_dir):
    p = slots_with_prev(spark, sf_dir).select("date", "slot_hour", "file_path", "prev_path")
    t = slot_targets(spark, sf_dir).select("date", "slot_hour").join(p, ["date", "slot_hour"], "left")
    return t.select("date", "slot_hour", F.when(F.col("prev_path").isNotNull(), F.col("file_path")).alias("file_path"))


def day_completeness(slots: DataFrame) -> DataFrame:
    """Per date a boolean for each source: all slots filled; `all` over the sources; missing cells are false."""
    p = slots.groupBy("date").pivot("source", list(SOURCES)).agg(F.bool_and(F.col("file_path").isNotNull()))
    p = p.select("date", *[F.coalesce(s, F.lit(False)).alias(s) for s in SOURCES])
    every = F.lit(True)
    for s in SOURCES:
        every = every & F.col(s)
    return p.withColumn("all", every)


COMPLETE = f"""{SLOTS}, comp AS (SELECT date, {", ".join(f"coalesce(bool_and(file_path IS NOT NULL) FILTER (source = '{s}'), false) AS {s}" for s in SOURCES)},
    bool_and(file_path IS NOT NULL) AS "all" FROM slots GROUP BY date)"""


@query(f"WITH {COMPLETE} SELECT * FROM comp")
def q_day_completeness(spark, sf_dir):
    return day_completeness(slot_table(spark, sf_dir))


@query(f"""WITH {COMPLETE}, w AS (SELECT date, sum(CAST(view AS INTEGER)) OVER (ORDER BY date ROWS BETWEEN 1 PRECEDING AND CURRENT ROW) AS s FROM comp) SELECT date FROM w WHERE s = 2""")
def q_image_complete(spark, sf_dir):
    c = day_completeness(slot_table(spark, sf_dir))  # a row for every day, so rows are consecutive days
    return c.withColumn("ok", run_complete(F.col("view"), 2, "date")).where("ok").select("date")


@query(f"WITH {SLOTS} SELECT source, slot_hour, round(avg(CASE WHEN file_path IS NOT NULL THEN 1.0 ELSE 0.0 END), 6) + 0.0 AS fill_rate FROM slots GROUP BY 1, 2")
def q_slot_fill_rate(spark, sf_dir):
    return slot_table(spark, sf_dir).groupBy("source", "slot_hour").agg(r6(F.avg(F.col("file_path").isNotNull().cast("double"))).alias("fill_rate"))


@query(f"""WITH {SLOTS} SELECT source, round(quantile_cont(abs(offset_min), 0.5), 6) + 0.0 AS median, round(quantile_cont(abs(offset_min), 0.9), 6) + 0.0 AS p90, round(max(abs(offset_min)), 6) + 0.0 AS max FROM slots GROUP BY 1""")
def q_offset_quantiles(spark, sf_dir):
    o = F.abs("offset_min")
    return slot_table(spark, sf_dir).groupBy("source").agg(r6(F.percentile(o, 0.5)).alias("median"), r6(F.percentile(o, 0.9)).alias("p90"), r6(F.max(o)).alias("max"))


@query(f"""WITH {COMPLETE} SELECT CAST(year(date) AS INTEGER) AS year, count(*) AS n_days, count(CASE WHEN "all" THEN 1 END) AS n_complete, count(CASE WHEN view THEN 1 END) AS n_view FROM comp GROUP BY 1""")
def q_complete_by_year(spark, sf_dir):
    c = day_completeness(slot_table(spark, sf_dir))
    return c.groupBy(F.year("date").alias("year")).agg(F.count(F.lit(1)).alias("n_days"), F.count_if("all").alias("n_complete"), F.count_if("view").alias("n_view"))


def fill_slots(slots: DataFrame, most_hours: int = 24) -> DataFrame:
    """Every slot's own frame, else the nearest filled slot within `most_hours` (ties: the earlier), else neutral."""
    w = Window.partitionBy("source").orderBy("slot_time")
    have = F.when(F.col("file_path").isNotNull(), F.col("slot_time"))
    s = slots.withColumn("_p", F.last(have, True).over(w.rowsBetween(Window.unboundedPreceding, 0))).withColumn("_n", F.first(have, True).over(w.rowsBetween(0, Window.unboundedFollowing)))
    back, ahead = (F.timestamp_diff("MINUTE", F.col("_p"), F.col("slot_time")), F.timestamp_diff("MINUTE", F.col("slot_time"), F.col("_n")))
    best = F.when(ahead.isNull() | (back <= ahead), F.col("_p")).otherwise(F.col("_n"))
    off = F.timestamp_diff("MINUTE", F.col("slot_time"), best) / 60.0
    near = F.abs(off) <= most_hours
    kind = F.when(F.col("file_path").isNotNull(), "own").when(near, "nearest").otherwise("neutral")
    return s.select("source", "slot_time", kind.alias("fill"), F.when(near, best).alias("source_slot"), F.when(near, off).alias("offset_h"))


FILLS = f"""{SLOTS}, have AS (SELECT source, slot_time FROM slots WHERE file_path IS NOT NULL),
    cand AS (SELECT s.source, s.slot_time, s.file_path, h.slot_time AS hs, row_number() OVER (PARTITION BY s.source, s.slot_time ORDER BY abs(epoch(h.slot_time - s.slot_time)), h.slot_time) AS rn
        FROM slots s LEFT JOIN have h ON h.source = s.source AND abs(epoch(h.slot_time - s.slot_time)) <= 86400),
    fills AS (SELECT source, slot_time, CASE WHEN file_path IS NOT NULL THEN 'own' WHEN hs IS NOT NULL THEN 'nearest' ELSE 'neutral' END AS fill, hs AS source_slot,
        epoch(hs - slot_time) / 3600.0 AS offset_h FROM cand WHERE rn = 1)"""


@query(f"WITH {FILLS} SELECT source, slot_time, fill, source_slot, CAST(offset_h AS DOUBLE) AS offset_h FROM fills")
def q_fill_slots(spark, sf_dir):
    return fill_slots(slot_table(spark, sf_dir))


@query(f"WITH {FILLS} SELECT fill, count(*) AS n FROM fills GROUP BY 1")
def q_fill_counts(spark, sf_dir):
    return fill_slots(slot_table(spark, sf_dir)).groupBy("fill").agg(F.count(F.lit(1)).alias("n"))


def hour_frames(spark, sf_dir) -> DataFrame:
    return A.catalog(spark, sf_dir).where("source = 'view'").select(F.date_trunc("hour", "datetime").cast("timestamp_ntz").alias("hour")).distinct()


@query(f"""WITH {TARGETS}, h AS (SELECT DISTINCT date_trunc('hour', ts) AS hour FROM events WHERE event_type = 'view'),
    p AS (SELECT a.hour FROM h a JOIN h b ON b.hour = a.hour - INTERVAL 1 HOUR)
    SELECT t.slot_time, min(CAST(epoch(p.hour - t.slot_time) / 3600 AS INTEGER)) AS shift_h FROM targets t LEFT JOIN p ON p.hour BETWEEN t.slot_time AND t.slot_time + INTERVAL 6 HOUR GROUP BY 1""")
def q_resolve_pair(spark, sf_dir):
    """The first hour within six after an anchor at which that frame and the one an hour before exist."""
    h = hour_frames(spark, sf_dir)
    pairs = h.join(h.select(F.expr("hour + interval 1 hour").alias("hour")), "hour", "left_semi")
    t = slot_targets(spark, sf_dir).select("slot_time", F.explode(F.sequence(F.lit(0), F.lit(6))).alias("shift")).withColumn("hour", F.expr("slot_time + make_dt_interval(0, shift)"))
    found = t.join(pairs, "hour", "left_semi").groupBy("slot_time").agg(F.min("shift").alias("shift_h"))
    return slot_targets(spark, sf_dir).select("slot_time").join(found, "slot_time", "left")


@query(f"WITH {SLOTS} SELECT date, slot_hour, source, file_path IS NOT NULL AND file_path IN (SELECT CAST(event_id AS VARCHAR) FROM events WHERE value < 150) AS present FROM slots")
def q_check_files(spark, sf_dir):
    """Which slots' files exist on disk: frames of small values are stored under their source, the folder is listed without reading one, and paths are compared."""
    slots = slot_table(spark, sf_dir)
    name = F.concat(F.col("source"), F.lit("/"), F.col("file_path"), F.lit(".npy"))
    stored = A.read(spark, sf_dir, "events").where("value < 150").select(F.col("event_id").cast("string").alias("file_path"), F.array("value").alias("values"))
    root = scratch_path(spark, "frames")
    write_arrays(slots.join(stored, "file_path").select(name.alias("name"), "values").dropDuplicates(["name"]), root, ["values"])
    files = named_files(listing(spark, root, "*.npy"), root).select("name", F.lit(True).alias("present"))
    return slots.withColumn("name", name).join(files, "name", "left").select("date", "slot_hour", "source", F.coalesce("present", F.lit(False)).alias("present"))


def cache_path(source, time):
    return F.concat(source, F.lit("/"), F.date_format(time, "yyyy"), F.lit("/"), F.date_format(time, "yyyyMMdd_HH"), F.lit(".npy"))


@query(f"""WITH {TARGETS}, p AS (SELECT 'view/' || strftime(slot_time, '%Y') || '/' || strftime(slot_time, '%Y%m%d_%H') || '.npy' AS path, slot_time FROM targets)
    SELECT path, split_part(path, '/', 1) AS source, slot_time FROM p""")
def q_cache_path(spark, sf_dir):
    """Paths from keys, and the keys read back from the paths."""
    p = slot_targets(spark, sf_dir).select(cache_path(F.lit("view"), F.col("slot_time")).alias("path"))
    stamp = F.regexp_extract("path", r"(\d{8}_\d{2})\.npy$", 1)
    return p.select("path", F.regexp_extract("path", r"^([^/]+)/", 1).alias("source"), F.to_timestamp_ntz(stamp, F.lit("yyyyMMdd_HH")).alias("slot_time"))


@query(f"""WITH {SLOTS}, d AS (SELECT date, count(CASE WHEN file_path IS NULL THEN 1 END) AS miss FROM slots WHERE source IN ('view', 'click') GROUP BY 1)
    SELECT i.date AS issue_date, CAST(sum(d.miss) AS BIGINT) AS n_missing, sum(d.miss) = 0 AS ok FROM d i JOIN d ON d.date BETWEEN i.date - 1 AND i.date WHERE i.date > (SELECT min(date) FROM d) GROUP BY 1""")
def q_check_cache(spark, sf_dir):
    """Missing frames of two channels over the two days up to each issue date."""
    s = slot_table(spark, sf_dir).where("source in ('view', 'click')")
    day = s.groupBy("date").agg(F.count_if(F.col("file_path").isNull()).alias("miss"))
    w = day.select(F.explode(F.array("date", F.date_add("date", 1))).alias("issue_date"), "miss").groupBy("issue_date").agg(F.sum("miss").alias("n_missing"), F.count(F.lit(1)).alias("n"))
    return w.where("n = 2").select("issue_date", "n_missing", (F.col("n_missing") == 0).alias("ok"))
