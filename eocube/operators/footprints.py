"""Lidar footprints: filters, linkage with cells, feature tables and models."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .grid import offsets
from .projection import inside_ring


def good_shots(shots: DataFrame, low: float, high: float, ring: list[tuple[float, float]] | None = None) -> DataFrame:
    """Quality not 0, no nulls, latitude bounds first, then the polygon."""
    s = shots.filter(F.col("py").between(low, high) & (F.col("quality") != 0)).na.drop()
    return s.filter(inside_ring(F.col("px"), F.col("py"), ring)) if ring else s


def weighted_cells(shots: DataFrame, method: str, diameter: float = 1.0) -> DataFrame:
    """``shots`` with a row for each cell they cover: ``y, x, w``.

    nearest: the cell they are in; focal: its 3x3 neighbourhood; area: all cells that the circle overlaps, by the exact
    share of its area.
    """
    cy, cx = F.floor("py").cast("int"), F.floor("px").cast("int")
    if method == "nearest":
        return shots.select("*", cy.alias("y"), cx.alias("x"), F.lit(1.0).alias("w"))
    if method == "focal":
        o = shots.withColumn("_o", F.explode(offsets(1, True)))
        return o.select(*shots.columns, (cy + F.col("_o.dy")).alias("y"), (cx + F.col("_o.dx")).alias("x"), F.lit(1.0).alias("w"))
    r = diameter / 2
    o = shots.withColumn("_o", F.explode(offsets(math.ceil(r), True))).select(*shots.columns, (cy + F.col("_o.dy")).alias("y"), (cx + F.col("_o.dx")).alias("x"))
    w = circle_share(F.col("x") - F.col("px"), F.col("y") - F.col("py"), r)
    return o.withColumn("w", F.round(w, 12)).filter("w > 0")


def circle_share(left: Column, low: Column, r: float) -> Column:
    """Share of a circle around 0 that lies in the unit cell with this left and lower edge.

    From the area in a quadrant's rectangle: all of it inside of the arc; else a part under the arc, by its integral.
    """

    def arc(t):
        return (t * F.sqrt(F.greatest(F.lit(0.0), r * r - t * t)) + r * r * F.asin(F.least(F.lit(1.0), t / r))) / 2

    def corner(x, y):
        a, b = F.least(F.abs(x), F.lit(r)), F.least(F.abs(y), F.lit(r))
        meet = F.sqrt(F.greatest(F.lit(0.0), r * r - b * b))
        return F.signum(x) * F.signum(y) * F.when(a <= meet, a * b).otherwise(b * meet + arc(a) - arc(meet))

    x, y = left + 1.0, low + 1.0
    return (corner(x, y) - corner(left, y) - corner(x, low) + corner(left, low)) / (math.pi * r * r)


def link(shots: DataFrame, cells: DataFrame, method: str, keys: list[str], value: str = "value", diameter: float = 1.0) -> DataFrame:
    """Weighted mean of the covered cells and the weight share that is valid, by shot and ``keys`` of the cells."""
    c = weighted_cells(shots, method, diameter)
    j = c.join(cells.select(*keys, "y", "x", F.col(value).alias("_v")), ["y", "x"], "left")
    v = F.col("_v")
    g = j.groupBy("shot", *keys).agg(F.sum(F.when(v.isNotNull(), v * F.col("w"))).alias("s"), F.sum(F.when(v.isNotNull(), F.col("w"))).alias("k"), F.sum("w").alias("t"))
    return g.select("shot", *keys, F.round(F.col("s") / F.nullif(F.col("k"), F.lit(0.0)), 9).alias("value"), F.round(F.coalesce("k", F.lit(0.0)) / F.col("t"), 9).alias("reliability"))


def majority_class(shots: DataFrame, cells: DataFrame, cls: str, method: str = "focal", diameter: float = 1.0) -> DataFrame:
    """Class with the largest weight of the covered cells; of equals the smallest."""
    j = weighted_cells(shots, method, diameter).join(cells.select("y", "x", F.col(cls).alias("cls")), ["y", "x"]).filter("cls is not null")
    w = j.groupBy("shot", "cls").agg(F.round(F.sum("w"), 9).alias("w"))
    return w.groupBy("shot").agg(F.min_by("cls", F.struct(-F.col("w"), "cls")).alias("cls"), F.max("w").alias("weight"))


def training_rows(df: DataFrame, cls: int, low: float, high: float, features: list[str]) -> DataFrame:
    """Rows of the class with a height in (low, high] and all features known; infinities count as unknown."""
    inf = F.lit(float("inf"))
    d = df.filter((F.col("veg_type") == cls) & (F.col("height") > low) & (F.col("height") <= high))
    return d.withColumns({c: F.when(F.abs(F.col(c)) != inf, F.col(c)) for c in features}).na.drop(subset=features)


def exclude_known_bad(df: DataFrame, bad: DataFrame, key: str) -> DataFrame:
    """Rows whose key is in ``bad`` go: an explicit filter, for training folds only."""
    return df.join(bad.select(key), key, "left_anti")


def train_trees(df: DataFrame, features: list[str], target: str, grid: list[dict], fold: str, weight: str | None = None, seed: int = 1) -> DataFrame:
    """Gradient-boosted trees over parameter sets and folds: ``(set, fold, rmse_train, rmse_test, importance..)``."""
    from pyspark.ml.evaluation import RegressionEvaluator
    from pyspark.ml.feature import VectorAssembler
    from pyspark.ml.regression import GBTRegressor

    data = VectorAssembler(inputCols=features, outputCol="_f").transform(df).cache()
    score = RegressionEvaluator(labelCol=target, predictionCol="prediction", metricName="rmse")
    rows = []
    try:
        for r in [r[0] for r in data.select(fold).distinct().orderBy(fold).collect()]:  # folds are few
            for k, p in enumerate(grid):
                model = GBTRegressor(featuresCol="_f", labelCol=target, seed=seed, **({"weightCol": weight} if weight else {}), **p).fit(data.filter(F.col(fold) != r))
                a, b = (score.evaluate(model.transform(data.filter(c))) for c in (F.col(fold) != r, F.col(fold) == r))
                rows.append((k, int(r), float(a), float(b), [float(x) for x in model.featureImportances.toArray()]))
    finally:
        data.unpersist()
    return df.sparkSession.createDataFrame(rows, "set int, fold int, rmse_train double, rmse_test double, importance array<double>")


def best_set(results: DataFrame) -> DataFrame:
    """Parameter set with the smallest mean test error."""
    m = results.groupBy("set").agg(F.avg("rmse_test").alias("rmse_test"), F.avg("rmse_train").alias("rmse_train"))
    return m.orderBy("rmse_test", "set").limit(1)


def feature_ranking(results: DataFrame, features: list[str]) -> DataFrame:
    """Mean importance share by feature, largest first."""
    e = results.select(F.posexplode("importance").alias("i", "share"))
    names = F.array(*map(F.lit, features))
    return e.groupBy(F.element_at(names, F.col("i") + 1).alias("feature")).agg(F.round(F.avg("share"), 9).alias("share")).orderBy(F.desc("share"), "feature")


def _environment(base: float) -> dict[str, Column]:
    v = F.col("v")
    return {"acc": F.sum(F.greatest(v - base, F.lit(0.0))), "vmax": F.max(v), "vmin": F.min(v), "vmean": F.avg(v), "vstd": F.stddev_pop(v), "n": F.count(v)}


def link_environment(shots: DataFrame, env: DataFrame, method: str = "nearest", base: float = 0.0, diameter: float = 1.0) -> DataFrame:
    """By shot: environment from the start of the shot's year to its date, over the cells it covers: accumulated over a
    base, and max, min, mean and population std of the daily means. ``shots(shot, date, px, py)``, ``env(y, x, date, value)``.

    A shot of one cell takes the running statistics of its cell and year: shots lie among the days as rows without a value,
    so none meets its days. Shots of several cells or rows are joined with their days.
    """
    c = weighted_cells(shots.select("shot", F.col("date").alias("_at"), "px", "py"), method, diameter).withColumn("_year", F.year("_at"))
    if method == "nearest":
        c = c.withColumn("_rows", F.count(F.lit(1)).over(Window.partitionBy("shot")))
        lone, c = c.filter("_rows = 1"), c.filter("_rows > 1")
        days = env.groupBy("y", "x", F.year("date").alias("_year"), F.col("date").alias("_at")).agg((F.sum("value") / F.count(F.lit(1))).alias("v"), F.lit(1).alias("_day"))
        both = days.unionByName(lone.select("shot", "y", "x", "_year", "_at", F.lit(0).alias("_day")), allowMissingColumns=True)
        w = Window.partitionBy("y", "x", "_year").orderBy("_at", F.desc("_day")).rowsBetween(Window.unboundedPreceding, 0)
        so_far = both.select("shot", "_day", F.sum("_day").over(w).alias("_days"), *[a.over(w).alias(k) for k, a in _environment(base).items()])
        one = so_far.filter("_day = 0 and _days > 0")
    j = c.join(env.withColumn("_year", F.year("date")), ["y", "x", "_year"]).filter(F.col("date") <= F.col("_at"))
    day = j.groupBy("shot", "date").agg((F.sum(F.col("value") * F.col("w")) / F.sum("w")).alias("v"))
    g = day.groupBy("shot").agg(*[a.alias(k) for k, a in _environment(base).items()])
    if method == "nearest":
        g = g.unionByName(one.select(*g.columns))
    return g.select("shot", "n", *[F.round(k, 10).alias(k) for k in ("acc", "vmax", "vmin")], F.round("vmean", 12).alias("vmean"), F.round("vstd", 8).alias("vstd"))


def link_series(shots: DataFrame, obs: DataFrame, first: int, last: int) -> DataFrame:
    """By shot: value at its date (as-of within its year) at its cell, and season statistics of that cell and year."""
    from .temporal import stats_until, value_at

    c = weighted_cells(shots.select("shot", "date", "px", "py"), "nearest").select("shot", F.col("date").alias("at"), "y", "x", F.year("date").alias("year"))
    now = value_at(c.select("shot", "at", "y", "x"), obs, 60, ["y", "x"], same_year=True).select("shot", F.col("value").alias("at_date"))
    season = c.join(stats_until(obs, ["y", "x"], first, last), ["y", "x", "year"], "left").select("shot", "vmax", "vmin", "vmean", "vstd")
    return now.join(season, "shot")


def link_moments(shots: DataFrame, obs: DataFrame, seasons: DataFrame) -> DataFrame:
    """By shot: the value of its cell at its date, at the year's peak and at the end of maturity, each within the year.

    ``seasons(y, x, year, peak, eom)`` are days of the year; ``(shot, at_date, at_peak, at_eom)``. A value is exact, else
    linear between the year's nearest earlier and later values; null at or beyond the ends of the year's series.
    """
    from .temporal import value_at

    c = weighted_cells(shots.select("shot", "date", "px", "py"), "nearest").withColumn("year", F.year("date")).select("shot", "y", "x", "year", "date")
    j = c.join(seasons, ["y", "x", "year"], "left")
    day = lambda doy: F.date_add(F.make_date("year", F.lit(1), F.lit(1)), F.col(doy).cast("int") - 1)
    moments = F.explode(F.array(*[F.struct(F.lit(n).alias("k"), d.alias("at")) for n, d in (("at_date", F.col("date")), ("at_peak", day("peak")), ("at_eom", day("eom")))]))
    asked = j.withColumn("_m", moments).select("shot", "y", "x", "_m.k", "_m.at")
    got = value_at(asked.filter("at is not null"), obs, 366, ["y", "x"], same_year=True)
    of = lambda n: F.max(F.when(F.col("k") == n, F.col("value"))).alias(n)
    return c.select("shot").join(got.groupBy("shot").agg(of("at_date"), of("at_peak"), of("at_eom")), "shot", "left")


def feature_groups(columns: list[str], mode: int) -> list[str]:
    """Columns of a feature mode: 0 all, 1 spectral, 2 phenology, 3 climate, 4 flood, 5 terrain, 6 all but climate (by name)."""
    marks = {1: ("NDVI", "MNDWI", "OSAVI", "EVI"), 2: ("SOS", "EOS", "PEAK", "MAVI", "TSVI"), 3: ("TEM", "PRE", "RHU", "PRS", "WIN", "SSD", "PAR"), 4: ("INUN", "DUR", "DEPTH", "FLOOD"), 5: ("DEM", "SLOPE", "Z_")}
    has = lambda c, m: any(k in c.upper() for k in marks[m])
    if mode == 0:
        return list(columns)
    if mode == 6:
        return [c for c in columns if not has(c, 3)]
    return [c for c in columns if has(c, mode)]


def fit_predict(train: DataFrame, rows: DataFrame, features: list[str], target: str, seed: int = 1, **params) -> DataFrame:
    """Fit trees on ``train`` and add ``prediction`` to ``rows``; rows with an unknown feature get null."""
    from pyspark.ml.feature import VectorAssembler
    from pyspark.ml.regression import RandomForestRegressor

    both = VectorAssembler(inputCols=features, outputCol="_f", handleInvalid="skip")
    model = RandomForestRegressor(featuresCol="_f", labelCol=target, seed=seed, **params).fit(both.transform(train))
    known = model.transform(both.transform(rows)).drop("_f")
    unknown = rows.filter(" or ".join(f"`{c}` is null" for c in features)).withColumn("prediction", F.lit(None).cast("double"))
    return known.unionByName(unknown)


def permutation_loss(train: DataFrame, features: list[str], target: str, seed: int = 1, **params) -> DataFrame:
    """Growth of the mean squared error when a feature's values change places between rows (by a seeded order), by feature."""
    from .stats import ranked

    base = train.select(F.xxhash64(*features, F.lit(seed)).alias("_k"), F.monotonically_increasing_id().alias("_i"), *features, target)
    mse = lambda df: df.agg(F.avg(F.pow(F.col("prediction") - F.col(target), 2))).first()[0]
    whole = fit_predict(base, base, features, target, seed, **params)
    ranked_rows = ranked(base, "_i")
    n = base.count()
    out = []
    for f in features:
        other = ranked_rows.select((F.col("rank") % n + 1).alias("rank"), F.col(f).alias("_other"))
        moved = ranked_rows.join(other, "rank").withColumn(f, F.col("_other")).select(*features, target)
        out.append((f, float(mse(fit_predict(base, moved, features, target, seed, **params)) - mse(whole))))
    return train.sparkSession.createDataFrame(out, "feature string, loss double").orderBy(F.desc("loss"), "feature")


def group_refits(train: DataFrame, groups: dict[str, list[str]], target: str, seed: int = 1, **params) -> DataFrame:
    """Growth of the mean squared error when the model is fitted without a group of features, by group."""
    mse = lambda df: float(df.agg(F.avg(F.pow(F.col("prediction") - F.col(target), 2))).first()[0])
    every = [f for fs in groups.values() for f in fs]
    whole = mse(fit_predict(train, train, every, target, seed, **params))
    out = [(g, mse(fit_predict(train, train, [f for f in every if f not in fs], target, seed, **params)) - whole) for g, fs in groups.items()]
    return train.sparkSession.createDataFrame(out, "features string, loss double").orderBy(F.desc("loss"), "features")


def parametric_fits(df: DataFrame, x: str, y: str) -> DataFrame:
    """Linear, power (log-log) and quadratic regression: ``(model, c0, c1, c2, r2)``, all from sums of one pass."""
    import numpy as np

    d = df.filter((F.col(x) > 0) & (F.col(y) > 0))
    powers = [F.pow(F.col(x), F.lit(k)) for k in range(5)]
    lx, ly = F.ln(x), F.ln(y)
    r = d.agg(*[F.sum(p) for p in powers], *[F.sum(F.col(y) * p) for p in powers[:3]], F.sum(F.col(y) * F.col(y)), F.sum(lx), F.sum(ly), F.sum(lx * lx), F.sum(lx * ly), F.sum(ly * ly)).first()
    s, t, yy, (a, b, aa, ab, bb) = r[:5], r[5:8], r[8], r[9:14]
    n, rows = s[0], []
    spread = yy - t[0] ** 2 / n
    for name, k in (("linear", 2), ("quadratic", 3)):
        m = np.array([[s[i + j] for j in range(k)] for i in range(k)])
        c = np.linalg.solve(m, np.array(t[:k]))
        rest = yy - 2 * c @ np.array(t[:k]) + c @ m @ c
        rows.append((name, *map(float, c), *[0.0] * (3 - k), float(1 - rest / spread)))
    slope = (ab - a * b / n) / (aa - a * a / n)
    rows.append(("power", float(np.exp((b - slope * a) / n)), float(slope), 0.0, float((ab - a * b / n) ** 2 / ((aa - a * a / n) * (bb - b * b / n)))))
    return df.sparkSession.createDataFrame(rows, "model string, c0 double, c1 double, c2 double, r2 double")
