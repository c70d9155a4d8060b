"""Linear models, image-like arrays and embeddings."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quietday.functions import arrays as X
from quietday.functions.columns import r6, signum_log, to_uint8
from quietday.functions.distributions import strongest_periods
from quietday.operators.grids import feature_windows, make_windows, series_window
from quietday.operators.linear import Ridge, absolute_errors, gram, linear_predict, mapped_gram, principal_axes, project, ridge_from_gram, standardised_ridge
from quietday.operators.quantiles import exact_quantile
from quietday.operators.work import Skipped, build_files, named_files
from quietday.plans.registry import query
from quietday.session import cut, scratch_path
from quietday.sources import adapters as A
from quietday.sources.array_files import listing, read_arrays

ALPHAS = (0.01, 0.1, 1.0, 10.0, 100.0, 1000.0, 10000.0)


def lagged(spark, sf_dir) -> DataFrame:
    """date, x (5 values up to the issue day), y (the next day)."""
    w = make_windows(A.daily(spark, sf_dir), "ap", 5, 1, "date")
    return w.select("date", "x", F.get("y", 0).alias("y"))


def fit(samples: DataFrame, alpha: float) -> Ridge:
    return ridge_from_gram(gram(samples)[1], 5, alpha)


HISTORY_SQL = A.DAILY + """, lagged AS (SELECT * FROM (SELECT date, lag(ap, 4) OVER o AS x1, lag(ap, 3) OVER o AS x2, lag(ap, 2) OVER o AS x3, lag(ap, 1) OVER o AS x4, ap AS x5, lead(ap, 1) OVER o AS y FROM daily WINDOW o AS (ORDER BY date))
    WHERE x1 IS NOT NULL AND x2 IS NOT NULL AND x3 IS NOT NULL AND x4 IS NOT NULL AND x5 IS NOT NULL AND y IS NOT NULL)"""


def ridge_sql(source: str, alphas: tuple[float, ...], k: int = 5) -> str:
    """Common table expressions of which `fit` has alpha, w0 (the intercept) and w1 to wk: centred sums of `source` (x1 to xk, y), a Cholesky factor, and two substitutions."""
    every = range(1, k + 1)
    pairs = [(i, j) for i in every for j in range(1, i + 1)]
    sums = [f"sum(x{i} * x{j}) - count(*) * avg(x{i}) * avg(x{j}) AS a{i}{j}" for i, j in pairs] + [f"sum(x{i} * y) - count(*) * avg(x{i}) * avg(y) AS b{i}" for i in every]
    sums += [f"avg(x{i}) AS m{i}" for i in every] + ["avg(y) AS my"]
    # each step names what the next one uses: a chain of one-row tables
    steps = []
    for j in every:
        gone = "".join(f" - l{j}{c} * l{j}{c}" for c in range(1, j))
        steps.append([f"sqrt(a{j}{j} + alpha{gone}) AS l{j}{j}"])
        steps.append([f"(a{i}{j}{''.join(f' - l{i}{c} * l{j}{c}' for c in range(1, j))}) / l{j}{j} AS l{i}{j}" for i in range(j + 1, k + 1)])
    steps += [[f"(b{i}{''.join(f' - l{i}{c} * z{c}' for c in range(1, i))}) / l{i}{i} AS z{i}"] for i in every]
    steps += [[f"(z{i}{''.join(f' - l{c}{i} * w{c}' for c in range(i + 1, k + 1))}) / l{i}{i} AS w{i}"] for i in reversed(every)]
    steps = [x for x in [*steps, ["my" + "".join(f" - m{i} * w{i}" for i in every) + " AS w0"]] if x]
    chain = ", ".join(f"{'fit' if n == len(steps) else f'fit{n}'} AS MATERIALIZED (SELECT *, {', '.join(x)} FROM fit{n - 1})" for n, x in enumerate(steps, 1))
    return f"fit0 AS MATERIALIZED (SELECT * FROM (SELECT {', '.join(sums)} FROM {source}), (SELECT unnest([{', '.join(map(str, alphas))}]) AS alpha)), {chain}"


PREDICTED = "w0 + w1 * x1 + w2 * x2 + w3 * x3 + w4 * x4 + w5 * x5"


@query(f"""WITH {HISTORY_SQL}, tr AS (SELECT * FROM lagged WHERE date <= DATE '1998-12-31'), {ridge_sql("tr", (10.0,))}
    SELECT date, round(y, 6) + 0.0 AS y, round({PREDICTED}, 6) + 0.0 AS yhat FROM lagged, fit WHERE date > DATE '1998-12-31'""")
def q_ridge(spark, sf_dir):
    """Closed-form ridge on the training years, applied to the others."""
    s = lagged(spark, sf_dir)
    m = fit(s.where("date <= date'1998-12-31'"), 10.0)
    return s.where("date > date'1998-12-31'").select("date", r6(F.col("y")).alias("y"), r6(linear_predict(F.col("x"), m)).alias("yhat"))


@query(f"""WITH {HISTORY_SQL}, tr AS (SELECT * FROM lagged WHERE date <= DATE '1998-12-31'), {ridge_sql("tr", ALPHAS)},
    e AS (SELECT alpha, round(avg(abs(y - ({PREDICTED}))), 6) + 0.0 AS mae FROM lagged, fit WHERE year(date) = 1999 GROUP BY 1) SELECT alpha, mae, row_number() OVER (ORDER BY mae, alpha) = 1 AS best FROM e""")
def q_ridge_select(spark, sf_dir):
    """The error of each alpha on the validation year, and which is first best."""
    s = lagged(spark, sf_dir)
    _, g = gram(s.where("date <= date'1998-12-31'"))
    val = s.where("year(date) = 1999")
    errors = val.agg(*[F.avg(F.abs(F.col("y") - linear_predict(F.col("x"), ridge_from_gram(g, 5, a)))).alias(str(i)) for i, a in enumerate(ALPHAS)])
    long = errors.unpivot([], [str(i) for i in range(len(ALPHAS))], "i", "mae").select(F.get(F.array(*[F.lit(a) for a in ALPHAS]), F.col("i").cast("int")).alias("alpha"), r6(F.col("mae")).alias("mae"))
    first = F.min(F.struct("mae", "alpha")).over(Window.partitionBy(F.lit(1)))
    return long.select("alpha", "mae", (F.struct("mae", "alpha") == first).alias("best"))


#: Embedding days: one each third day, so that the series and the split years cover them.
IMAGE_STEP = 3
TRAIN, VALID = "date <= date'1997-12-31'", "date between date'1998-01-01' and date'1998-06-30'"
PCA_K = (16, 64, 256)


def image_days(spark, sf_dir) -> DataFrame:
    """date, img1 (the day's embedding) and img7 (the mean of the embeddings of the seven days up to it)."""
    e = A.read(spark, sf_dir, "embeddings").select(F.date_add(F.lit("1995-01-01").cast("date"), (F.col("vec_id") * IMAGE_STEP).cast("int")).alias("date"), F.col("embedding").cast("array<double>").alias("img1"))
    week = weekly_means(e.withColumnRenamed("img1", "embedding"), 0).withColumnRenamed("embedding", "img7")
    return e.join(week, "date")


@query()
def q_pca(spark, sf_dir):
    """The centred principal scores of each embedding, on axes of the training days' Gram matrix, for each k (at most the dimensions).

    Tests compare with a singular value decomposition.
    """
    e = image_days(spark, sf_dir).select("date", F.col("img1").alias("x"), F.lit(0.0).alias("y"))
    _, g = gram(e.where(TRAIN))
    dims = g.shape[0] - 2
    mean, axes = principal_axes(g, dims, min(max(PCA_K), dims))
    rows = e.select("date", project(F.col("x"), mean, axes).alias("scores"))
    ks = F.array(*[F.lit(k) for k in sorted({min(k, dims) for k in PCA_K})])
    return rows.select("date", F.explode(ks).alias("k"), "scores").select("date", "k", F.posexplode(F.slice("scores", 1, F.col("k"))).alias("component", "score")).withColumn("score", r6(F.col("score")))


ARMS = {"TS": ("x",), "PHASE": ("x", "phase"), "IMG1": ("img1",), "IMG7": ("img7",), "TS+IMG1": ("x", "img1"), "TS+IMG7": ("x", "img7"), "PHASE+IMG7": ("x", "phase", "img7")}


@query()
def q_fusion_arms(spark, sf_dir):
    """Each arm's choice of components and penalty on the validation days, and its error on the test days, on the same days.

    Embeddings are reduced to their leading axes, inputs standardised and the model fitted on the training days.
    Tests compare with NumPy.
    """
    turn = 2 * np.pi * F.dayofyear("date") / 365.25
    inputs = {"x": F.col("x"), "phase": F.array(F.sin(turn), F.cos(turn)), "img1": F.col("img1"), "img7": F.col("img7")}
    split = F.when(F.expr(TRAIN), "train").when(F.expr(VALID), "valid").otherwise("test")
    s = lagged(spark, sf_dir).join(image_days(spark, sf_dir), "date").select(split.alias("split"), F.concat(*inputs.values()).alias("x"), F.log1p("y").alias("y"))
    s = cut(s)
    _, g = gram(s.where("split = 'train'"))
    dims = (len(g) - 9) // 2
    at = dict(zip(inputs, np.split(np.arange(len(g) - 2), np.cumsum([5, 2, dims])), strict=True))
    reduced = {}
    for name in ("img1", "img7"):
        own = np.concatenate([at[name], [len(g) - 2, len(g) - 1]])
        reduced[name] = principal_axes(g[np.ix_(own, own)], dims, min(max(PCA_K), dims))
    tried, weights, intercepts = [], [], []
    for arm, parts in ARMS.items():
        images = [p for p in parts if p in reduced]
        for k in sorted({min(k, dims) for k in PCA_K}) if images else [0]:
            blocks = [(at[p], reduced[p][1][:, :k], reduced[p][0] @ reduced[p][1][:, :k]) if p in reduced else (at[p], np.eye(len(at[p])), np.zeros(len(at[p]))) for p in parts]
            maps, offsets = np.zeros((len(g) - 2, sum(b[1].shape[1] for b in blocks))), np.concatenate([b[2] for b in blocks])
            first = 0
            for rows, block, _ in blocks:
                maps[rows, first : first + block.shape[1]] = block
                first += block.shape[1]
            reached = mapped_gram(g, len(g) - 2, maps, offsets)
            for alpha in ALPHAS:
                m = standardised_ridge(reached, maps.shape[1], alpha)
                tried.append((arm, k, alpha))
                weights.append(maps @ m.weights[:, 0])
                intercepts.append(float(m.intercept[0] - offsets @ m.weights[:, 0]))
    names = spark.createDataFrame([(i, *t) for i, t in enumerate(tried)], "model int, arm string, k int, alpha double")
    sums = absolute_errors(s, "split", np.stack(weights, 1), np.array(intercepts))
    mae = sums.groupBy("model").pivot("split", ["valid", "test"]).agg(F.first("error").alias("error"), F.first("n").alias("n")).join(F.broadcast(names), "model")
    mae = mae.select("arm", "k", "alpha", "model", F.round(F.col("valid_error") / F.col("valid_n"), 12).alias("val"), (F.col("test_error") / F.col("test_n")).alias("test"), F.col("test_n").alias("n"))
    best = mae.groupBy("arm").agg(F.min(F.struct("val", "model", "k", "alpha", "test", "n")).alias("b"))
    return best.select("arm", "b.k", "b.alpha", r6(F.col("b.val")).alias("mae_val"), r6(F.col("b.test")).alias("mae_test"), "b.n")


@query(f"""WITH {A.DAILY}, w AS (SELECT date, list(ap) OVER o AS x, count(ap) OVER o AS n FROM daily WINDOW o AS (ORDER BY date ROWS BETWEEN 63 PRECEDING AND CURRENT ROW)),
    a AS (SELECT date, k, sqrt(pow(list_sum(list_transform(range(64), lambda i: x[i + 1] * cos(2 * pi() * k * i / 64))), 2) + pow(list_sum(list_transform(range(64), lambda i: x[i + 1] * sin(2 * pi() * k * i / 64))), 2)) AS a FROM w, range(1, 33) AS g(k) WHERE n = 64),
    r AS (SELECT *, row_number() OVER (PARTITION BY date ORDER BY round(a, 9) DESC, k) AS place FROM a)
    SELECT date, CAST(place AS INTEGER) AS place, CAST(64 // k AS INTEGER) AS period, round(a, 6) + 0.0 AS amplitude FROM r WHERE place <= 3""")
def q_fft_period(spark, sf_dir):
    """The three strongest periods of each 64-day history."""
    x = F.collect_list("ap").over(series_window("date").rowsBetween(-63, 0))
    w = A.daily(spark, sf_dir).select("date", x.alias("x")).where(F.size("x") == 64)
    rows = w.select("date", F.posexplode(strongest_periods("x")).alias("place", "p"))
    return rows.select("date", (F.col("place") + 1).alias("place"), F.col("p.period").alias("period"), r6(F.col("p.amplitude")).alias("amplitude"))


def images(spark, sf_dir) -> DataFrame:
    """vec_id and the embedding as an 8 x 8 image."""
    return A.read(spark, sf_dir, "embeddings").select("vec_id", X.grid(F.col("embedding").cast("array<double>"), 8).alias("img"), F.col("embedding").cast("array<double>").alias("flat"))


CELLS = "cells AS (SELECT vec_id, CAST(i AS INTEGER) AS i, CAST(j AS INTEGER) AS j, CAST(embedding[CAST(i * 8 + j + 1 AS INTEGER)] AS DOUBLE) AS v FROM embeddings, generate_series(0, 7) AS a(i), generate_series(0, 7) AS b(j))"


def long_cells(df: DataFrame, column: str, value: str = "v") -> DataFrame:
    rows = df.select("vec_id", F.posexplode(column).alias("i", "row"))
    return rows.select("vec_id", "i", F.posexplode("row").alias("j", value))


@query(f"WITH {CELLS} SELECT vec_id, CAST(i // 2 AS INTEGER) AS i, CAST(j // 2 AS INTEGER) AS j, round(avg(v), 6) + 0.0 AS v FROM cells GROUP BY 1, 2, 3")
def q_block_mean(spark, sf_dir):
    return long_cells(images(spark, sf_dir).select("vec_id", X.block_mean(F.col("img"), 2, 8, 8).alias("b")), "b").withColumn("v", r6(F.col("v")))


@query(f"WITH {CELLS} SELECT vec_id, i, j, CAST(trunc(least(greatest((v + 0.2) / 0.4 * 255.0, 0.0), 255.0)) AS INTEGER) AS v FROM cells")
def q_to_uint8(spark, sf_dir):
    return long_cells(images(spark, sf_dir), "img").withColumn("v", to_uint8(F.col("v"), -0.2, 0.2))


#: Cells above this count as missing, as a sensor's failed pixels.
FAILED = 0.3


@query(f"""WITH {CELLS}, m AS (SELECT vec_id, i // 4 AS i, j // 4 AS j, avg(ln(1 + CASE WHEN v > {FAILED} THEN 0 ELSE greatest(v, 0) END / 0.5)) AS v FROM cells GROUP BY 1, 2, 3)
    SELECT vec_id, i, j, CAST(trunc(least(greatest(round(v, 9) / 0.2 * 255.0, 0.0), 255.0)) AS INTEGER) AS v FROM m""")
def q_preprocess_aia(spark, sf_dir):
    """Missing pixels as zero, rate per exposure, clipped at zero, log before the block mean, as bytes."""
    seen = failed_pixels(F.col("img"))
    log = F.transform(seen, lambda r: F.transform(r, lambda v: F.log1p(F.greatest(F.nanvl(v, F.lit(0.0)), F.lit(0.0)) / F.greatest(F.lit(0.5), F.lit(1e-3)))))
    out = images(spark, sf_dir).select("vec_id", log.alias("img")).select("vec_id", X.block_mean(F.col("img"), 4, 8, 8).alias("b"))
    return long_cells(out, "b").withColumn("v", to_uint8(F.round("v", 9), 0.0, 0.2)).withColumns({"i": F.col("i").cast("long"), "j": F.col("j").cast("long")})


def failed_pixels(img):
    return F.transform(img, lambda r: F.transform(r, lambda v: F.when(v > FAILED, F.lit(float("nan"))).otherwise(v)))


@query(f"""WITH {CELLS}, r AS (SELECT vec_id, i, j, CASE WHEN v > {FAILED} THEN 0 ELSE v END AS v, abs((((vec_id * 40 + 180) % 360 + 360) % 360) - 180) > 90 AS flip FROM cells)
    SELECT vec_id, CAST(CASE WHEN flip THEN 7 - i ELSE i END AS INTEGER) AS i, CAST(CASE WHEN flip THEN 7 - j ELSE j END AS INTEGER) AS j, CAST(trunc((greatest(least(v, 0.15), -0.15) + 0.15) / 0.3 * 255.0) AS INTEGER) AS v FROM r""")
def q_preprocess_hmi(spark, sf_dir):
    """Missing pixels as zero, turned by 180 degrees when the roll angle says so, clipped to a range, as bytes."""
    roll = F.abs(F.pmod(F.col("vec_id") * 40 + 180, F.lit(360)) - 180)
    seen = F.transform(failed_pixels(F.col("img")), lambda r: F.transform(r, lambda v: F.nanvl(v, F.lit(0.0))))
    img = F.when(roll > 90, X.flip_180(seen)).otherwise(seen)
    cells = long_cells(images(spark, sf_dir).select("vec_id", img.alias("img")), "img")
    return cells.withColumn("v", to_uint8(F.greatest(F.least(F.col("v"), F.lit(0.15)), F.lit(-0.15)), -0.15, 0.15))


PAIRS = """pairs AS (SELECT a.vec_id, a.embedding AS e, b.embedding AS p FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id - 1),
    pc AS (SELECT vec_id, CAST(i AS INTEGER) AS i, CAST(j AS INTEGER) AS j, CAST(e[CAST(i * 8 + j + 1 AS INTEGER)] AS DOUBLE) AS v, CAST(p[CAST(i * 8 + j + 1 AS INTEGER)] AS DOUBLE) AS w, 0.5 + vec_id % 4 AS t, 0.5 + (vec_id - 1) % 4 AS u FROM pairs, generate_series(0, 7) AS x(i), generate_series(0, 7) AS y(j))"""


@query(f"""WITH {PAIRS} SELECT vec_id, i, j, round(greatest(v, 0) / t, 6) + 0.0 AS rate, CAST(trunc(least(greatest(ln(1 + greatest(v, 0) / t) / 0.5 * 255.0, 0.0), 255.0)) AS INTEGER) AS raw,
    CAST(trunc(least(greatest((greatest(v, 0) / t - greatest(w, 0) / u + 0.3) / 0.6 * 255.0, 0.0), 255.0)) AS INTEGER) AS difference FROM pc""")
def q_running_diff(spark, sf_dir):
    """Rates per exposure, their logarithm as bytes, and the difference to the frame before as bytes around the middle grey."""
    exposure = lambda c: 0.5 + c % 4
    rate = lambda img, t: F.transform(img, lambda r: F.transform(r, lambda v: F.greatest(v, F.lit(0.0)) / t))
    a = images(spark, sf_dir).select("vec_id", rate("img", exposure(F.col("vec_id"))).alias("rate"))
    b = a.select((F.col("vec_id") + 1).alias("vec_id"), F.col("rate").alias("prev"))
    d = F.zip_with("rate", "prev", lambda x, y: F.zip_with(x, y, lambda p, q: F.struct(p.alias("rate"), to_uint8(F.log1p(p), 0.0, 0.5).alias("raw"), to_uint8(p - q, -0.3, 0.3).alias("difference"))))
    cells = long_cells(a.join(b, "vec_id").select("vec_id", d.alias("d")), "d", "c")
    return cells.select("vec_id", "i", "j", r6(F.col("c.rate")).alias("rate"), "c.raw", "c.difference")


@query(f"""WITH {CELLS} SELECT vec_id, CAST(a AS INTEGER) AS i, CAST(b AS INTEGER) AS j, round(v, 6) + 0.0 AS v FROM cells JOIN generate_series(0, 11) AS x(a) ON i = a * 8 // 12 JOIN generate_series(0, 11) AS y(b) ON j = b * 8 // 12""")
def q_resize_up(spark, sf_dir):
    """Each image of eight rows on twelve, by the nearest cell."""
    return long_cells(images(spark, sf_dir).select("vec_id", X.resize_to(F.col("img"), 12, 8).alias("b")), "b").withColumn("v", r6(F.col("v")))


@query(f"""WITH {CELLS}, t AS (SELECT vec_id // 2 AS pair, i, j, avg(v) AS v FROM cells GROUP BY 1, 2, 3), g AS (SELECT pair, i // 4 AS gi, j // 4 AS gj, avg(v) AS v FROM t GROUP BY 1, 2, 3),
    m AS (SELECT pair, round(avg(v), 6) + 0.0 AS mean, round(max(CASE WHEN i = 0 AND j = 0 THEN v END), 6) + 0.0 AS first FROM t GROUP BY 1)
    SELECT g.pair, CAST(gi AS INTEGER) AS i, CAST(gj AS INTEGER) AS j, round(v, 6) + 0.0 AS cell, mean, first FROM g JOIN m USING (pair)""")
def q_grid_pool(spark, sf_dir):
    """The 64 tokens of two time steps, averaged over time: their mean, the first, and all cells of the 2 x 2 grid."""
    flat = images(spark, sf_dir).select(F.floor(F.col("vec_id") / 2).alias("pair"), "flat")
    t = mean_arrays(flat.groupBy("pair").agg(F.collect_list("flat").alias("all")), "all", "flat")  # two rows of a pair
    mean = F.aggregate("flat", F.lit(0.0), lambda a, v: a + v) / F.size("flat")
    g = t.select("pair", r6(mean).alias("mean"), r6(F.get("flat", 0)).alias("first"), F.posexplode(X.block_mean(X.grid(F.col("flat"), 8), 4, 8, 8)).alias("i", "row"))
    return g.select("pair", "i", "mean", "first", F.posexplode("row").alias("j", "cell")).withColumn("cell", r6(F.col("cell")))


def mean_arrays(df: DataFrame, column: str, name: str) -> DataFrame:
    """The element-wise mean of a few arrays of one length."""
    first = F.transform(F.get(column, 0), lambda v: v * 0)
    total = F.aggregate(column, first, lambda a, x: F.zip_with(a, x, lambda p, q: p + q))
    return df.withColumn(name, F.transform(total, lambda v: v / F.size(column))).drop(column) if name != column else df.withColumn(name, F.transform(total, lambda v: v / F.size(column)))


@query(f"""WITH c AS (SELECT list_cosine_similarity(CAST(a.embedding AS DOUBLE[]), CAST(b.embedding AS DOUBLE[])) AS cosine FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1)
    SELECT round(min(cosine), 6) + 0.0 AS min, round(quantile_cont(cosine, 0.5), 6) + 0.0 AS median, count(*) AS n FROM c""")
def q_cosine_validate(spark, sf_dir):
    a = images(spark, sf_dir).select("vec_id", F.col("flat").alias("a"))
    b = a.select((F.col("vec_id") - 1).alias("vec_id"), F.col("a").alias("b"))
    c = X.dot(F.col("a"), F.col("b")) / F.sqrt(X.dot(F.col("a"), F.col("a")) * X.dot(F.col("b"), F.col("b")))
    rows = a.join(b, "vec_id").select(c.alias("c"))
    return exact_quantile(rows, "c", 0.5, "median", r6(F.min("c")).alias("min"), F.count(F.lit(1)).alias("n")).withColumn("median", r6(F.col("median")))


HISTORY, PACKED = 30, 512


@query(f"""WITH {A.DAILY}, w AS (SELECT date, list(ap) OVER r AS x, count(ap) OVER r AS n FROM daily WINDOW r AS (ORDER BY date ROWS BETWEEN {HISTORY - 1} PRECEDING AND CURRENT ROW)),
    c AS (SELECT date, k, CASE WHEN k >= {PACKED - HISTORY} THEN x[CAST(k - {PACKED - HISTORY} + 1 AS INTEGER)] ELSE 0.0 END AS v, CASE WHEN k >= {PACKED - HISTORY} THEN 1 ELSE 0 END AS mask FROM w, range({PACKED}) AS g(k) WHERE n = {HISTORY})
    SELECT date, count(*) AS length, CAST(sum(mask) AS BIGINT) AS n, CAST(min(CASE WHEN mask = 1 THEN k END) AS INTEGER) AS first, round(sum(v), 6) + 0.0 AS total, round(sum(v * k), 6) + 0.0 AS moment FROM c GROUP BY 1""")
def q_pack(spark, sf_dir):
    """Each day's history right-aligned in 512 places with a mask; told by sums over all places."""
    x = F.collect_list("ap").over(series_window("date").rowsBetween(-(HISTORY - 1), 0))
    s = A.daily(spark, sf_dir).select("date", x.alias("x")).where(F.size("x") == HISTORY)
    p = s.select("date", X.pack_right(F.col("x"), PACKED).alias("v"), X.pack_mask(F.col("x"), PACKED).alias("mask"))
    add = lambda c: F.aggregate(c, F.lit(0.0), lambda a, v: a + v)
    return p.select(
        "date", F.size("v").cast("long").alias("length"), F.aggregate("mask", F.lit(0).cast("long"), lambda a, m: a + m).alias("n"), (F.array_position("mask", 1) - 1).cast("int").alias("first"),
        r6(add("v")).alias("total"), r6(add(F.transform("v", lambda v, k: v * k))).alias("moment"),
    )


@query(f"WITH {CELLS}, s AS (SELECT i, j, avg(v) AS mu, stddev_pop(v) AS sd FROM cells GROUP BY 1, 2) SELECT vec_id, i, j, round((sign(v * 10) * ln(1 + abs(v * 10)) - mu) / (sd + 0.5), 6) + 0.0 AS v FROM cells JOIN s USING (i, j)")
def q_signum_log(spark, sf_dir):
    """Signed log of scaled values, standardised per channel."""
    c = long_cells(images(spark, sf_dir), "img")
    s = c.groupBy("i", "j").agg(F.avg("v").alias("mu"), F.stddev_pop("v").alias("sd"))
    out = signum_log(F.col("v"), F.col("mu"), F.col("sd"), F.lit(0.5), F.lit(10.0))
    return c.join(F.broadcast(s), ["i", "j"]).select("vec_id", "i", "j", r6(out).alias("v"))  # 64 channels


EMB = "emb AS (SELECT DATE '1995-01-01' + CAST(vec_id AS INTEGER) AS date, embedding FROM embeddings)"


def embeddings_by_date(spark, sf_dir) -> DataFrame:
    e = A.read(spark, sf_dir, "embeddings")
    return e.select(F.date_add(F.lit("1995-01-01").cast("date"), F.col("vec_id").cast("int")).alias("date"), F.col("embedding").cast("array<double>").alias("embedding"))


@query(f"WITH {EMB} SELECT date, len(embedding) AS dims, round(CAST(embedding[1] AS DOUBLE), 6) + 0.0 AS first FROM emb")
def q_embeddings_by_date(spark, sf_dir):
    return embeddings_by_date(spark, sf_dir).select("date", F.size("embedding").cast("long").alias("dims"), r6(F.get("embedding", 0)).alias("first"))


FILLED = f"""{EMB}, g AS (SELECT CAST(unnest(generate_series(min(date), max(date), INTERVAL 1 DAY)) AS DATE) AS date FROM emb), f AS (SELECT g.date, last_value(embedding IGNORE NULLS) OVER (ORDER BY g.date ROWS BETWEEN 3 PRECEDING AND CURRENT ROW) AS e FROM g LEFT JOIN emb USING (date))"""


def filled_embeddings(e: DataFrame, limit: int) -> DataFrame:
    """date, embedding: each day's own or the last one of at most `limit` days before, up to the last day.

    Each embedding is sent to the days it may fill, so no window runs over the whole time line.
    """
    last = e.agg(F.max("date").alias("_last"))  # one row
    offered = e.select(F.col("date").alias("_from"), "embedding", F.explode(F.sequence("date", F.date_add("date", limit))).alias("date"))
    return offered.join(F.broadcast(last), F.col("date") <= F.col("_last")).groupBy("date").agg(F.max_by("embedding", "_from").alias("embedding"))


def weekly_means(e: DataFrame, limit: int) -> DataFrame:
    """date, embedding: the mean over the seven days up to each of the filled embeddings, missing ones skipped."""
    filled = filled_embeddings(e, limit)
    last = e.agg(F.max("date").alias("_last"))
    shown = filled.select(F.explode(F.sequence("date", F.date_add("date", 6))).alias("date"), "embedding").join(F.broadcast(last), F.col("date") <= F.col("_last"))
    return mean_arrays(shown.groupBy("date").agg(F.collect_list("embedding").alias("all")), "all", "embedding")  # seven at most


@query(f"""WITH {FILLED}, c AS (SELECT date, CAST(k AS INTEGER) AS dim, CAST(e[CAST(k + 1 AS INTEGER)] AS DOUBLE) AS v FROM f, range(64) AS r(k)), m AS (SELECT date, dim, avg(v) OVER (PARTITION BY dim ORDER BY date ROWS BETWEEN 6 PRECEDING AND CURRENT ROW) AS m FROM c)
    SELECT date, dim, round(m, 6) + 0.0 AS v FROM m WHERE m IS NOT NULL""")
def q_img7(spark, sf_dir):
    """Weekly means of filled embeddings, all dimensions; missing ones are skipped."""
    m = weekly_means(embeddings_by_date(spark, sf_dir), 3)
    return m.select("date", F.posexplode("embedding").alias("dim", "v")).withColumn("v", r6(F.col("v")))


@query(f"""WITH {FILLED}, b AS (SELECT d.date, CAST(k AS INTEGER) AS pos, o.e IS NULL AS copied, coalesce(o.e, d.embedding) AS e FROM emb d CROSS JOIN range(7) AS r(k) LEFT JOIN f o ON o.date = d.date - 6 + CAST(k AS INTEGER))
    SELECT date, pos, copied, round(CAST(e[1] AS DOUBLE), 6) + 0.0 AS first, round(list_sum(list_transform(e, lambda x, i: CAST(x AS DOUBLE) * i)), 6) + 0.0 AS moment FROM b""")
def q_stack7(spark, sf_dir):
    """The blocks of `stack7`, told by their first value and a sum over all dimensions."""
    b = stack7(embeddings_by_date(spark, sf_dir), 3)
    moment = F.aggregate(F.transform("v", lambda x, i: x * (i + 1)), F.lit(0.0), lambda a, x: a + x)
    return b.select("date", "pos", "copied", r6(F.get("v", 0)).alias("first"), r6(moment).alias("moment"))


def stack7(e: DataFrame, limit: int) -> DataFrame:
    """date, pos (0 to 6), copied, v: for each embedding its block of the seven days up to it.

    A day without one takes the last of at most `limit` days before it, else (as do days before the first) the
    copy of the block's own day.
    """
    days = e.select("date", F.col("embedding").alias("own"), F.posexplode(F.expr("sequence(date_sub(date, 6), date)")).alias("pos", "day"))
    other = filled_embeddings(e, limit).select(F.col("date").alias("day"), F.col("embedding").alias("e"))
    return days.join(other, "day", "left").select("date", "pos", F.col("e").isNull().alias("copied"), F.coalesce("e", "own").alias("v"))


@query(f"WITH {EMB} SELECT d.date FROM (SELECT DISTINCT CAST(o_orderdate AS DATE) AS date FROM orders) d WHERE d.date IN (SELECT date FROM emb)")
def q_token_semi(spark, sf_dir):
    return A.daily_present(spark, sf_dir).select("date").join(embeddings_by_date(spark, sf_dir), "date", "left_semi")


PER_CLASS = 20


@query(f"""WITH {CELLS}, pick AS (SELECT vec_id FROM (SELECT vec_id, row_number() OVER (PARTITION BY label ORDER BY md5('0:' || vec_id), vec_id) AS rn FROM embeddings) WHERE rn <= {PER_CLASS}),
    f AS (SELECT vec_id, quantile_cont(v, 0.999) AS hi FROM cells WHERE vec_id IN (SELECT vec_id FROM pick) GROUP BY 1), a AS (SELECT vec_id, quantile_cont(v, 0.999) AS hi FROM cells GROUP BY 1)
    SELECT 'sample' AS frames, round(quantile_cont(hi, 0.5), 6) + 0.0 AS hi, count(*) AS n FROM f UNION ALL SELECT 'all', round(quantile_cont(hi, 0.5), 6) + 0.0, count(*) FROM a""")
def q_calibrate(spark, sf_dir):
    """The median over frames of each frame's 99.9th percentile, for some frames of each source drawn by a seed, and for all."""
    high = F.array_sort("flat")
    at = 0.999 * (F.size("flat") - 1)
    low = F.floor(at).cast("int")
    p = F.get(high, low) + (F.get(high, F.least(low + 1, F.size("flat") - 1)) - F.get(high, low)) * (at - low)
    # one number a frame is kept; both medians and the draw of frames read those
    cells = A.read(spark, sf_dir, "embeddings").select("vec_id", "label", F.col("embedding").cast("array<double>").alias("flat"))
    every = cut(cells.select("vec_id", "label", p.alias("v")))
    order = Window.partitionBy("label").orderBy(F.md5(F.concat_ws(":", F.lit(0), "vec_id")), "vec_id")
    some = every.withColumn("rn", F.row_number().over(order)).where(F.col("rn") <= PER_CLASS)
    median = lambda rows, name: exact_quantile(rows.select("v"), "v", 0.5, "hi", F.count(F.lit(1)).alias("n")).select(F.lit(name).alias("frames"), r6(F.col("hi")).alias("hi"), "n")
    return median(some, "sample").unionByName(median(every, "all"))


#: Frames that can't be read (their cells make no square), and frames of another size.
BROKEN, SMALLER = "vec_id % 11 = 7", "vec_id % 13 = 5"


def frame_difference(item: dict) -> np.ndarray:
    """The difference of two square frames as bytes around the middle grey."""
    frames = []
    for cells in (item["now"], item["before"]):
        if cells is None:
            raise Skipped("no-previous-frame")
        side = int(len(cells) ** 0.5)
        frames.append(np.array(cells).reshape(side, side))
    now, before = frames
    if now.shape != before.shape:
        raise Skipped("shape-mismatch")
    return np.trunc(np.clip((now - before + 0.3) / 0.6 * 255.0, 0, 255))


@query(f"""WITH f AS (SELECT vec_id, CASE WHEN {BROKEN} THEN embedding[1:60] WHEN {SMALLER} THEN embedding[1:49] ELSE embedding END AS e FROM embeddings),
    s AS (SELECT a.vec_id, a.e, b.e AS p, CASE WHEN len(a.e) = 60 THEN 'error:ValueError' WHEN b.e IS NULL THEN 'no-previous-frame' WHEN len(b.e) = 60 THEN 'error:ValueError' WHEN len(a.e) <> len(b.e) THEN 'shape-mismatch'
        WHEN a.vec_id % 3 = 0 THEN 'exists' ELSE 'ok' END AS status FROM f a LEFT JOIN f b ON b.vec_id = a.vec_id - 1)
    SELECT vec_id, status, CASE WHEN status IN ('ok', 'exists') THEN CAST(list_sum(list_transform(range(len(e)), lambda k: trunc(least(greatest((CAST(e[k + 1] AS DOUBLE) - CAST(p[k + 1] AS DOUBLE) + 0.3) / 0.6 * 255.0, 0.0), 255.0)))) AS BIGINT) END AS checksum FROM s""")
def q_frame_status(spark, sf_dir):
    """Work items over a table with broken, missing and finished frames: a first run makes the differences of a third of them, a second run is asked for
    all, and finds those done. Each item's status, and the sum over the bytes of its file as it is on disk."""
    cells = F.col("embedding").cast("array<double>")
    e = A.read(spark, sf_dir, "embeddings").select("vec_id", F.when(F.expr(BROKEN), F.slice(cells, 1, 60)).when(F.expr(SMALLER), F.slice(cells, 1, 49)).otherwise(cells).alias("now"))
    items = e.join(e.select((F.col("vec_id") + 1).alias("vec_id"), F.col("now").alias("before")), "vec_id", "left")
    # as many frames in a folder as a day of a year may have
    items = items.withColumn("name", F.concat(F.lit("diff/"), F.floor(F.col("vec_id") / 1000), F.lit("/"), F.col("vec_id"), F.lit(".npy")))
    root = scratch_path(spark, "frames")
    build_files(items.where("vec_id % 3 = 0"), frame_difference, ["vec_id"], root, None, "uint8")
    done = named_files(listing(spark, root, "*.npy"), root)
    status = build_files(items, frame_difference, ["vec_id"], root, done, "uint8")
    total = F.aggregate("values", F.lit(0.0), lambda a, v: a + v).cast("long").alias("checksum")
    sums = read_arrays(spark, root, ["values"], r"diff/.+\.npy", files=64).select("name", total)
    return status.join(sums, "name", "left").select("vec_id", "status", "checksum")


@query(f"""WITH {A.DAILY}, ok AS (SELECT date, count(ap) OVER (ORDER BY date ROWS BETWEEN 6 PRECEDING AND CURRENT ROW) AS n, lead(ap) OVER (ORDER BY date) AS y FROM daily), {EMB}
    SELECT ok.date FROM ok WHERE n = 7 AND y IS NOT NULL AND date IN (SELECT date FROM emb) AND date - 1 IN (SELECT date FROM emb)""")
def q_l5_issue_days(spark, sf_dir):
    """Issue days with a whole history, a target, and images on that day and the day before."""
    w = feature_windows(A.daily(spark, sf_dir), ["ap"], "ap", 7, "date").select("date")
    e = embeddings_by_date(spark, sf_dir).select("date")
    return w.join(e, "date", "left_semi").join(e.select(F.date_add("date", 1).alias("date")), "date", "left_semi")
