"""Queries: statistics, neighbourhoods, regions, hydrology, catalogs, footprints, curves, breaks, sinks and streams."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import breaks as B
from ..operators import flood as FL
from ..operators import footprints as FP
from ..operators import grid as N
from ..operators import hydro as H
from ..operators import inundation as I
from ..operators import linear as L
from ..operators import phenology as PH
from ..operators import stats as S
from ..sources import adapters as A
from ..sources import catalog as CAT
from ..sources import tables as TB
from .base import query

c = F.col

# --- statistics -----------------------------------------------------------------------------------------------------


def fitted(s, d):
    """Totals beside a made-up fit: something to measure accuracy on."""
    o = A.table(s, d, "orders")
    return o.select("o_orderkey", c("o_orderpriority").alias("kind"), (c("o_totalprice") / 1000).alias("real"), (c("o_totalprice") / 1050 + c("o_custkey") % 17).alias("fit"), (c("o_orderkey") % 3).cast("int").alias("cls"), ((c("o_orderkey") + c("o_custkey") % 2) % 3).cast("int").alias("guess"))


_FIT = 'fit AS (SELECT o_orderkey, o_orderpriority AS kind, o_totalprice / 1000 AS "real", o_totalprice / 1050 + o_custkey % 17 AS f, CAST(o_orderkey % 3 AS INT) AS cls, CAST((o_orderkey + o_custkey % 2) % 3 AS INT) AS guess FROM orders)'


@query("a24_most_common", """
WITH k AS (SELECT y, x, sensor, count(*) AS n, row_number() OVER (PARTITION BY y, x ORDER BY count(*) DESC, sensor) AS r FROM raw_bands GROUP BY y, x, sensor) SELECT y, x, sensor, n FROM k WHERE r = 1""")
def a24(s, d):
    return S.most_common(A.raw_bands(s, d), ["y", "x"], "sensor")


@query("a25_confusion", f'WITH {_FIT} SELECT cls AS "real", guess AS predicted, count(*) AS n FROM fit GROUP BY 1, 2')
def a25(s, d):
    return S.confusion(fitted(s, d), "cls", "guess")


@query("a26_accuracy", f"""WITH {_FIT}, m AS (SELECT cls, guess, count(*) AS n FROM fit GROUP BY 1, 2), r AS (SELECT cls, 1 - sum(CASE WHEN cls = guess THEN n ELSE 0 END) / sum(n) AS omission FROM m GROUP BY cls),
p AS (SELECT guess AS cls, 1 - sum(CASE WHEN cls = guess THEN n ELSE 0 END) / sum(n) AS commission FROM m GROUP BY guess)
SELECT cls, round(omission, 9) AS omission, round(commission, 9) AS commission, round((SELECT sum(CASE WHEN cls = guess THEN n ELSE 0 END) / sum(n) FROM m), 9) AS overall FROM r FULL JOIN p USING (cls)""")
def a26(s, d):
    return S.accuracy(a25(s, d))


_CLS = "cl AS (SELECT y, x, date, CASE WHEN value >= 0.1 THEN 2 ELSE 1 END AS r, CASE WHEN value >= 0.16 THEN 2 ELSE 1 END AS p FROM mndwi)"


def classed(s, d):
    """Flood classes by two thresholds."""
    v = c("value")
    return A.index(s, d, "MNDWI").select("y", "x", "date", F.when(v >= 0.1, 2).otherwise(1).alias("r"), F.when(v >= 0.16, 2).otherwise(1).alias("p"))


@query("a26_errors_by_pixel", f"WITH {_CLS} SELECT y, x, count(*) AS n, count(*) FILTER (WHERE r <> p) AS n_errors FROM cl GROUP BY y, x")
def a26p(s, d):
    return S.errors(classed(s, d), "r", "p", ["y", "x"])


@query("a26_errors_by_date", f"WITH {_CLS} SELECT date, count(*) AS n, count(*) FILTER (WHERE r <> p) AS n_errors FROM cl GROUP BY date")
def a26d(s, d):
    return S.errors(classed(s, d), "r", "p", ["date"])


@query("a28_annual_load", """
SELECT station, year, runoff, load, wet_runoff, wet_load FROM (SELECT station, year(date) AS year, round(sum(flow) * 86400 / 1e8, 9) AS runoff, round(sum(flow * sed_conc) * 86400 / 1e11, 9) AS load, round(sum(flow) FILTER (WHERE month(date) BETWEEN 5 AND 10) * 86400 / 1e8, 9) AS wet_runoff,
 round(sum(flow * sed_conc) FILTER (WHERE month(date) BETWEEN 5 AND 10) * 86400 / 1e11, 9) AS wet_load FROM gauge GROUP BY ALL) WHERE runoff <> 0""")
def a28(s, d):
    return H.annual_load(A.gauge(s, d))


@query("a33_goodness_of_fit", f"""WITH {_FIT} SELECT kind, count(*) AS n, round(1 - sum((f - "real") * (f - "real")) / nullif(count(*) * var_pop("real"), 0), 5) AS r2, round(sqrt(avg((f - "real") * (f - "real"))), 6) AS rmse,
 round(avg(abs(f - "real")), 6) AS mae, round(avg((f - "real") * (f - "real")), 6) AS mse, round(avg(f - "real"), 6) AS mean_error FROM fit GROUP BY kind""")
def a33(s, d):
    g = S.goodness_of_fit(fitted(s, d), "real", "fit", ["kind"])
    return g.withColumns({n: F.round(n, 6) for n in ("rmse", "mae", "mse", "mean_error")})


@query("a34_a36_linear_fit", f"""WITH {_FIT} SELECT kind, round(regr_slope(f, "real"), 6) AS slope, round(regr_intercept(f, "real"), 6) AS intercept, round(regr_r2(f, "real"), 6) AS r2, round(corr("real", f), 6) AS r, CAST(regr_count(f, "real") AS BIGINT) AS n FROM fit GROUP BY kind""")
def a36(s, d):
    g = S.linear_fit(fitted(s, d), "real", "fit", ["kind"])
    return g.withColumns({n: F.round(n, 6) for n in ("slope", "intercept", "r2", "r")})


@query("a35_spearman", """
WITH r AS (SELECT y, x, rank() OVER (PARTITION BY y, x ORDER BY green) + (count(*) OVER (PARTITION BY y, x, green) - 1) / CAST(2 AS DOUBLE) AS a, rank() OVER (PARTITION BY y, x ORDER BY swir) + (count(*) OVER (PARTITION BY y, x, swir) - 1) / CAST(2 AS DOUBLE) AS b FROM bands)
SELECT y, x, round(corr(a, b), 6) AS rho, count(*) AS n FROM r GROUP BY y, x""")
def a35(s, d):
    return S.spearman(A.bands(s, d), "green", "swir", ["y", "x"]).withColumn("rho", F.round("rho", 6))


@query("a35_kendall", """
WITH a AS (SELECT n_regionkey AS g, s_suppkey, s_acctbal, n_nationkey * 7 % 11 AS v FROM supplier JOIN nation ON s_nationkey = n_nationkey)
SELECT p.g, round(sum(sign(p.s_acctbal - q.s_acctbal) * sign(CAST(p.v AS DOUBLE) - q.v)) / count(*), 9) AS tau, count(*) AS pairs FROM a p JOIN a q ON p.g = q.g AND p.s_suppkey < q.s_suppkey GROUP BY p.g""")
def a35k(s, d):
    a = A.table(s, d, "supplier").join(A.table(s, d, "nation"), c("s_nationkey") == c("n_nationkey")).select(c("n_regionkey").alias("g"), "s_suppkey", "s_acctbal", (c("n_nationkey") * 7 % 11).cast("double").alias("v"))
    return S.kendall(a, "s_acctbal", "v", ["g"])


@query("a37_two_sample_distances", """
WITH k AS (SELECT sensor AS cls, round(green, 2) AS v, count(*) AS n FROM raw_bands GROUP BY 1, 2), ref AS (SELECT v, n AS m FROM k WHERE cls = 'A'),
b AS (SELECT cls, v, sum(n) AS n, sum(m) AS m FROM (SELECT cls, v, n, 0 AS m FROM k WHERE cls <> 'A' UNION ALL SELECT o.cls, v, 0, m FROM ref, (SELECT DISTINCT cls FROM k WHERE cls <> 'A') o) GROUP BY 1, 2),
e AS (SELECT cls, sum(n) OVER w / CAST(sum(n) OVER u AS DOUBLE) - sum(m) OVER w / CAST(sum(m) OVER u AS DOUBLE) AS gap, lead(v) OVER w - v AS step, n + m AS k, sum(n) OVER u * sum(m) OVER u / pow(sum(n) OVER u + sum(m) OVER u, 2) AS f FROM b WINDOW w AS (PARTITION BY cls ORDER BY v), u AS (PARTITION BY cls))
SELECT cls, round(max(abs(gap)), 9) AS ks, round(sum(abs(gap) * step), 5) AS wasserstein, round(sum(gap * gap * k * f), 6) AS cvm FROM e GROUP BY cls""")
def a37(s, d):
    return S.two_sample_distances(A.raw_bands(s, d).withColumn("green", F.round("green", 2)), "sensor", "green", "A")


_Q = "r AS (SELECT {by}, {v} AS v, row_number() OVER (PARTITION BY {by} ORDER BY {v}) - 1 AS i, count(*) OVER (PARTITION BY {by}) AS n FROM {t})"


@query("a38_bin_means", """
WITH b AS (SELECT CAST(floor(l_quantity / 5) AS INT) AS bin, l_extendedprice AS v FROM lineitem), r AS (SELECT bin, v, row_number() OVER (PARTITION BY bin ORDER BY v) - 1 AS i, count(*) OVER (PARTITION BY bin) AS m FROM b)
SELECT bin, count(*) AS n, round(avg(v), 6) AS mean_value, max(v) FILTER (WHERE i = floor(m * CAST(0.3 AS DOUBLE))) AS q30, max(v) FILTER (WHERE i = floor(m * CAST(0.7 AS DOUBLE))) AS q70 FROM r GROUP BY bin""")
def a38(s, d):
    return S.bin_means(A.table(s, d, "lineitem"), "l_quantity", "l_extendedprice", 5.0).withColumn("mean_value", F.round("mean_value", 6))


@query("a39_trimmed", f"""WITH {_Q.format(by="y, x", v="value", t="ndvi")} SELECT y, x, count(*) AS n, round(avg(v), 9) AS mean_value FROM r WHERE i >= floor(n * CAST(0.05 AS DOUBLE)) AND i < ceil(n * CAST(0.95 AS DOUBLE)) GROUP BY y, x""")
def a39(s, d):
    return S.trimmed(A.index(s, d, "NDVI"), ["y", "x"], "value")


@query("a40_positional_quantiles", f"""WITH {_Q.format(by="y, x", v="value", t="mndwi")} SELECT y, x, max(v) FILTER (WHERE i = floor(n * CAST(0.25 AS DOUBLE))) AS q25, max(v) FILTER (WHERE i = floor(n * CAST(0.5 AS DOUBLE))) AS q50, max(v) FILTER (WHERE i = floor(n * CAST(0.9 AS DOUBLE))) AS q90 FROM r GROUP BY y, x""")
def a40(s, d):
    return S.positional_quantiles(A.index(s, d, "MNDWI"), ["y", "x"], "value", [0.25, 0.5, 0.9])


@query("a41_factor_contribution", """
WITH q AS (SELECT y, x, avg(blue) AS b, avg(green) AS g, avg(red) AS r, avg(nir) AS n FROM bands GROUP BY y, x) SELECT y, x, round(((b - r) + (g - n)) / 2, 9) AS part_a, round(((b - g) + (r - n)) / 2, 9) AS part_b FROM q""")
def a41(s, d):
    q = A.bands(s, d).groupBy("y", "x").agg(F.avg("blue").alias("both"), F.avg("green").alias("only_a"), F.avg("red").alias("only_b"), F.avg("nir").alias("none"))
    return S.factor_contribution(q)


@query("a42_grouping_sets", """
SELECT CASE WHEN o_orderpriority IS NOT NULL THEN 'o_orderpriority' ELSE '' END || CASE WHEN o_orderstatus IS NOT NULL THEN 'o_orderstatus' ELSE '' END AS parameter, coalesce(o_orderpriority, o_orderstatus) AS setting, round(avg(o_totalprice), 6) AS mean_value, count(*) AS n
FROM orders GROUP BY GROUPING SETS ((o_orderpriority), (o_orderstatus))""")
def a42(s, d):
    return S.grouping_means(A.table(s, d, "orders"), ["o_orderpriority", "o_orderstatus"], "o_totalprice").withColumn("mean_value", F.round("mean_value", 6))


@query("a43_subtotals", """
WITH k AS (SELECT CAST(month(ts) * 100 + day(ts) AS INT) AS dayno, event_type, avg(value) AS v FROM events GROUP BY 1, 2) SELECT dayno, event_type, round(v, 9) AS mean_value FROM k UNION ALL SELECT dayno, 'all', round(avg(v), 9) FROM k GROUP BY dayno""")
def a43(s, d):
    e = A.table(s, d, "events").withColumn("dayno", F.month("ts") * 100 + F.dayofmonth("ts"))
    return S.subtotals(e, "dayno", "event_type", "value")


@query("a44_rank_aggregate", """
WITH k AS (SELECT l_orderkey, l_partkey % 50 AS item, min(l_extendedprice) AS p FROM lineitem GROUP BY 1, 2), r AS (SELECT item, row_number() OVER (PARTITION BY l_orderkey ORDER BY p, item) - 1 AS pos FROM k)
SELECT item, round(avg(pos), 9) AS mean_pos, count(*) AS n FROM r GROUP BY item""")
def a44(s, d):
    k = A.table(s, d, "lineitem").groupBy("l_orderkey", (c("l_partkey") % 50).alias("item")).agg(F.min("l_extendedprice").alias("p"))
    lists = k.groupBy("l_orderkey").agg(F.transform(F.array_sort(F.collect_list(F.struct("p", "item"))), lambda e: e["item"]).alias("items"))
    return S.rank_aggregate(lists)


@query("a46_semivariogram", """
WITH m AS (SELECT y, x, round(avg(value), 6) AS value FROM mndwi GROUP BY y, x) SELECT 1 AS lag, count(*) AS pairs, round(avg(pow(a.value - b.value, 2)) / 2, 9) AS gamma FROM m a JOIN m b ON (b.y = a.y + 1 AND b.x = a.x) OR (b.y = a.y AND b.x = a.x + 1)""")
def a46(s, d):
    return N.semivariogram(A.index(s, d, "MNDWI").groupBy("y", "x").agg(F.round(F.avg("value"), 6).alias("value")), 1)


@query("a47_transect", """
WITH m AS (SELECT y, x, avg(value) AS value FROM ndvi GROUP BY y, x), o AS (SELECT value, ((x + CAST(0.5 AS DOUBLE) - 1) * 0 + (y + CAST(0.5 AS DOUBLE) - 1)) AS al, ((y + CAST(0.5 AS DOUBLE) - 1) * 0 - (x + CAST(0.5 AS DOUBLE) - 1) * 1) AS f FROM m)
SELECT CAST(floor(round(f / 2, 9)) AS INT) AS bin, count(value) AS n, round(avg(value), 9) AS mean_value FROM o WHERE al BETWEEN 0 AND 7 AND abs(f) <= 6 GROUP BY 1""")
def a47(s, d):
    return H.transect(A.index(s, d, "NDVI").groupBy("y", "x").agg(F.avg("value").alias("value")), (1.0, 1.0, 1.0, 8.0), 2.0, 6.0)


@query("a48_exclude_groups", """
SELECT station, date, level FROM gauge WHERE (station, year(date)) IN (SELECT (station, year(date)) FROM gauge GROUP BY station, year(date) HAVING count(*) FILTER (WHERE level > 22) / CAST(count(*) AS DOUBLE) <= 0.25)""")
def a48(s, d):
    g = A.gauge(s, d).withColumn("year", F.year("date"))
    return S.exclude_groups(g, ["station", "year"], c("level") > 22).select("station", "date", "level")


@query("a49_otsu", """
WITH h AS (SELECT CAST(least(floor((value + 1) / (2 / CAST(64 AS DOUBLE))), 63) AS INT) AS bin, count(*) AS n FROM mndwi WHERE value BETWEEN -1 AND 1 GROUP BY 1), m AS (SELECT bin, n, -1 + (bin + CAST(0.5 AS DOUBLE)) * (2 / CAST(64 AS DOUBLE)) AS mid FROM h),
k AS (SELECT bin, sum(n) OVER w AS w0, sum(n * mid) OVER w AS s0, sum(n) OVER () AS w, sum(n * mid) OVER () AS s FROM m WINDOW w AS (ORDER BY bin)),
v AS (SELECT bin, round(CASE WHEN w - w0 > 0 THEN w0 * (w - w0) * pow(s0 / w0 - (s - s0) / (w - w0), 2) END, 4) AS v FROM k) SELECT round(-1 + (bin + 1) * (2 / CAST(64 AS DOUBLE)), 9) AS threshold FROM v WHERE v IS NOT NULL ORDER BY v DESC, bin LIMIT 1""")
def a49(s, d):
    return S.otsu(A.index(s, d, "MNDWI"), "value", -1.0, 1.0)


@query("a50_correlation_matrix", """
SELECT 'green' AS a, 'nir' AS b, round(corr(green, nir), 6) AS r FROM raw_bands UNION ALL SELECT 'green', 'swir', round(corr(green, swir), 6) FROM raw_bands UNION ALL SELECT 'nir', 'swir', round(corr(nir, swir), 6) FROM raw_bands""")
def a50(s, d):
    return S.correlation_matrix(A.raw_bands(s, d), ["green", "nir", "swir"]).withColumn("r", F.round("r", 6))


@query("w7_stratified_folds", """
WITH s AS (SELECT shot, year(date) AS year, CAST(ntile(20) OVER (PARTITION BY year(date) ORDER BY rh100, shot) AS INT) AS stratum FROM footprints)
SELECT shot, year, stratum, CAST(ntile(4) OVER (PARTITION BY year, stratum ORDER BY md5(CAST(shot AS VARCHAR) || ':7')) AS INT) AS fold FROM s""")
def w7(s, d):
    f = A.footprints(s, d).withColumn("year", F.year("date"))
    return S.stratified_folds(f, "rh100", "shot", 20, 4, ["year"]).select("shot", "year", "stratum", "fold")


@query("w8_leave_one_year_out", "SELECT shot, y.year AS held, year(date) = y.year AS test FROM footprints, (SELECT DISTINCT year(date) AS year FROM footprints) y")
def w8(s, d):
    f = A.footprints(s, d)
    years = f.select(F.year("date").alias("held")).distinct()
    return f.crossJoin(F.broadcast(years)).select("shot", "held", (F.year("date") == c("held")).alias("test"))  # a row for each year


@query("w9_contiguous_folds", "SELECT shot, CAST(least((row_number() OVER (ORDER BY shot) - 1) // greatest(count(*) OVER () // 5, 1), 4) AS INT) AS fold FROM footprints")
def w9(s, d):
    return S.folds_contiguous(A.footprints(s, d), "shot", 5)


@query("w17_best_parameters", "SELECT o_orderpriority, o_orderstatus, rmse FROM (SELECT o_orderpriority, o_orderstatus, round(avg(o_totalprice), 4) AS rmse FROM orders GROUP BY 1, 2) ORDER BY rmse, o_orderpriority, o_orderstatus LIMIT 1")
def w17(s, d):
    g = A.table(s, d, "orders").groupBy("o_orderpriority", "o_orderstatus").agg(F.round(F.avg("o_totalprice"), 4).alias("rmse"))
    return g.agg(F.min(F.struct("rmse", "o_orderpriority", "o_orderstatus")).alias("s")).select("s.o_orderpriority", "s.o_orderstatus", "s.rmse")


@query("m7_robust_outliers", """
WITH m AS (SELECT quality, median(rh100) AS md FROM footprints GROUP BY quality), dv AS (SELECT shot, f.quality, rh100, abs(rh100 - md) AS a FROM footprints f JOIN m USING (quality)), k AS (SELECT quality, median(a) AS mad FROM dv GROUP BY quality),
z AS (SELECT shot, rh100, round(coalesce(CAST(0.6745 AS DOUBLE) * a / nullif(mad, 0), 0), 9) AS z FROM dv JOIN k USING (quality)), o AS (SELECT z, row_number() OVER (ORDER BY z) - 1 AS i, count(*) OVER () AS n FROM z)
SELECT shot, rh100 FROM z WHERE z <= (SELECT max(z) FROM o WHERE i = ceil(n * (1 - CAST(0.01 AS DOUBLE))) - 1)""")
def m7(s, d):
    return S.robust_outliers(A.footprints(s, d), ["quality"], "rh100", 0.01).select("shot", "rh100")


@query("m9_weighted_error", f"""WITH {_FIT} SELECT round(sum(1 / (1 + exp(-("real" - 3))) * abs("real" - f)) / sum(1 / (1 + exp(-("real" - 3)))), 6) AS weighted_mae FROM fit""")
def m9(s, d):
    return S.weighted_mae(fitted(s, d), "real", "fit").withColumn("weighted_mae", F.round("weighted_mae", 6))


# --- set operations, sorting ----------------------------------------------------------------------------------------


@query("u1_union_distinct", "SELECT station, date, level FROM gauge WHERE station < 3 UNION SELECT station, date, level FROM gauge WHERE station > 1")
def u1(s, d):
    g = A.gauge(s, d).select("station", "date", "level")
    return g.filter("station < 3").unionByName(g.filter("station > 1")).distinct()


@query("u2_v15_append_layers", "SELECT y, x, date, idx, value FROM obs UNION ALL SELECT y, x, date, 'NDVI_COPY', value FROM obs WHERE idx = 'NDVI'")
def u2(s, d):
    o = A.obs(s, d)
    return o.unionByName(o.filter(c("idx") == "NDVI").withColumn("idx", F.lit("NDVI_COPY")))


@query("u3_harmonise_dates", """
WITH l AS (SELECT DISTINCT d.date, i.idx FROM (SELECT DISTINCT date FROM obs) d, (SELECT DISTINCT idx FROM obs) i), n AS (SELECT date, idx, count(*) AS n FROM obs GROUP BY 1, 2) SELECT date, idx, coalesce(n, 0) AS n FROM l LEFT JOIN n USING (date, idx)""")
def u3(s, d):
    o = A.obs(s, d)
    layers = o.select("date").distinct().crossJoin(o.select("idx").distinct())  # dates by a few indices
    return layers.join(o.groupBy("date", "idx").agg(F.count(F.lit(1)).alias("n")), ["date", "idx"], "left").withColumn("n", F.coalesce("n", F.lit(0)))


@query("o1_o3_nearest_stations", """
WITH k AS (SELECT y, x, station_id, row_number() OVER (PARTITION BY y, x ORDER BY round(pow(x + CAST(0.5 AS DOUBLE) - px, 2) + pow(y + CAST(0.5 AS DOUBLE) - py, 2), 9), station_id) AS r FROM grid, stations) SELECT y, x, station_id, r FROM k WHERE r <= 4""")
def o3(s, d):
    near = H.nearest_stations(A.grid(s), A.stations(s, d), 4)
    return near.select("y", "x", F.posexplode(F.transform("n", lambda e: e["station_id"])).alias("r", "station_id")).select("y", "x", "station_id", (c("r") + 1).cast("long").alias("r"))


# --- neighbourhoods and regions -------------------------------------------------------------------------------------


@query("n1_flip_isolated", """
WITH n AS (SELECT f.date, f.y, f.x, f.cls, min(g.cls) AS lo, max(g.cls) AS hi FROM flood f LEFT JOIN flood g ON f.date = g.date AND abs(f.y - g.y) <= 2 AND abs(f.x - g.x) <= 2 AND (f.y <> g.y OR f.x <> g.x) GROUP BY ALL) SELECT date, y, x, CASE WHEN lo = hi AND lo <> cls THEN lo ELSE cls END AS cls FROM n""")
def n1(s, d):
    return N.flip_isolated(A.flood(s, d))


@query("n2_neighbour_sum", """
WITH m AS (SELECT y, x, avg(value) AS value FROM mndwi JOIN roi USING (y, x) GROUP BY y, x) SELECT a.y, a.x, round(a.value, 10) AS value, round(coalesce(sum(b.value), 0), 9) AS near_sum, count(b.value) AS n_near FROM m a LEFT JOIN m b ON abs(a.y - b.y) <= 1 AND abs(a.x - b.x) <= 1 AND (a.y <> b.y OR a.x <> b.x) GROUP BY ALL""")
def n2(s, d):
    from ..operators.projection import within_roi

    m = within_roi(A.index(s, d, "MNDWI"), A.roi(s)).groupBy("y", "x").agg(F.avg("value").alias("value"))
    return N.neighbour_sum(m, [], "value", 1).withColumn("value", F.round("value", 10))


@query("n3_drop_sole", "SELECT y, x, date FROM mndwi a WHERE EXISTS (SELECT 1 FROM mndwi b WHERE a.date = b.date AND abs(a.y - b.y) <= 1 AND abs(a.x - b.x) <= 1 AND (a.y <> b.y OR a.x <> b.x))")
def n3(s, d):
    return N.drop_sole(A.index(s, d, "MNDWI").select("y", "x", "date"), ["date"])


@query("n4_edge_status", """
WITH l AS (SELECT y, x, year(f.date) AS year, min(level) FILTER (WHERE cls = 2) AS level FROM flood f JOIN levels l ON f.date = l.date GROUP BY ALL HAVING min(level) FILTER (WHERE cls = 2) IS NOT NULL),
n AS (SELECT a.y, a.x, a.year, a.level, count(b.level) AS n, max(b.level) AS hi FROM l a LEFT JOIN l b ON a.year = b.year AND abs(a.y - b.y) <= 1 AND abs(a.x - b.x) <= 1 AND (a.y <> b.y OR a.x <> b.x) GROUP BY ALL)
SELECT y, x, year, level, CASE WHEN abs(y - 5) <= 1 THEN -1 WHEN n < 8 OR hi > level THEN 1 ELSE 0 END AS status FROM n""")
def n4(s, d):
    lv = FL.boundary_levels(A.flood(s, d), A.levels(s, d)).filter("min_wet is not null").select("y", "x", "year", c("min_wet").alias("level"))
    return N.edge_status(lv, A.grid(s).filter("y = 5"), ["year"])


def wet_cells(s, d):
    return A.flood(s, d).filter(c("cls") == 2).select("y", "x", "date")


_REG = """RECURSIVE w AS (SELECT y, x, date FROM flood WHERE cls = 2),
r AS (SELECT y, x, date, CAST(epoch(date) / 86400 AS BIGINT) * 1099511627776 + CAST(y AS BIGINT) * 1048576 + x AS id FROM w UNION SELECT w.y, w.x, w.date, r.id FROM r JOIN w ON w.date = r.date AND abs(w.y - r.y) <= 1 AND abs(w.x - r.x) <= 1),
g AS (SELECT y, x, date, min(id) AS region FROM r GROUP BY ALL)"""


@query("n6_regions", f"WITH {_REG} SELECT y, x, date, region FROM g")
def n6(s, d):
    return N.regions(wet_cells(s, d), "date")


@query("n7_region_sizes", f"WITH {_REG} SELECT date, region, count(*) AS n, CAST(count(*) * 900 AS DOUBLE) AS area FROM g GROUP BY ALL")
def n7(s, d):
    return N.region_sizes(N.regions(wet_cells(s, d), "date"), ["date"])


@query("n8_o5_largest_region", f"WITH {_REG}, k AS (SELECT date, region, row_number() OVER (PARTITION BY date ORDER BY count(*) DESC, region) AS r FROM g GROUP BY date, region) SELECT y, x, date, region FROM g JOIN k USING (date, region) WHERE r = 1")
def n8(s, d):
    return N.largest_region(N.regions(wet_cells(s, d), "date"), ["date"]).select("y", "x", "date", "region")


@query("n9_touching_river", f"WITH {_REG} SELECT y, x, date, region FROM g WHERE (date, region) IN (SELECT (date, region) FROM g WHERE y = 5)")
def n9(s, d):
    return N.touching(N.regions(wet_cells(s, d), "date"), ["date"], A.grid(s).filter("y = 5")).select("y", "x", "date", "region")


@query("n10_region_extremes", f"""WITH {_REG} SELECT date, region, count(*) AS n, round(sum(CAST(1 + (y + x) % 3 AS DOUBLE)), 9) AS width, first(y ORDER BY x, y) AS left_y, min(x) AS left_x, first(y ORDER BY x DESC, y) AS right_y, max(x) AS right_x FROM g GROUP BY date, region""")
def n10(s, d):
    r = N.regions(wet_cells(s, d), "date").withColumn("width", (1 + (c("y") + c("x")) % 3).cast("double"))
    return N.extremes(r, ["date"], "width")


@query("n11_seeded_fill", """
WITH RECURSIVE w AS (SELECT y, x, date, level - z AS depth FROM dem JOIN levels ON level > z), r AS (SELECT y, x, date FROM w WHERE y = 0 AND x = 0 UNION SELECT w.y, w.x, w.date FROM r JOIN w ON w.date = r.date AND abs(w.y - r.y) <= 1 AND abs(w.x - r.x) <= 1)
SELECT w.y, w.x, w.date, round(depth, 9) AS depth FROM w JOIN r ON w.y = r.y AND w.x = r.x AND w.date = r.date""")
def n11(s, d):
    return I.seeded_fill(A.dem(s), A.levels(s, d), (0, 0))


@query("n14_numbered_floods", """
WITH RECURSIVE q AS (SELECT y, x, count(*) FILTER (WHERE cls = 2) / CAST(count(*) AS DOUBLE) AS f FROM flood GROUP BY y, x), w AS (SELECT y, x, y * 1048576 + x AS id FROM q WHERE round(f, 9) > 0.37), p AS (SELECT y, x, y * 1048576 + x AS id FROM q WHERE round(f, 9) > 0.40),
r AS (SELECT y, x, id FROM w UNION SELECT w.y, w.x, r.id FROM r JOIN w ON abs(w.y - r.y) <= 1 AND abs(w.x - r.x) <= 1), g AS (SELECT y, x, min(id) AS region FROM r GROUP BY y, x),
l AS (SELECT y, x, id FROM p UNION SELECT p.y, p.x, l.id FROM l JOIN p ON abs(p.y - l.y) <= 1 AND abs(p.x - l.x) <= 1), k AS (SELECT y, x, min(id) AS lake FROM l GROUP BY y, x), big AS (SELECT y, x FROM k WHERE lake IN (SELECT lake FROM k GROUP BY lake HAVING count(*) * 900 >= 1800)),
h AS (SELECT region, row_number() OVER (ORDER BY region) AS k FROM (SELECT DISTINCT region FROM g JOIN big USING (y, x))) SELECT y, x, CAST(coalesce(k, 0) AS INT) AS flood_id FROM g LEFT JOIN h USING (region)""")
def n14(s, d):
    """Lakes of one cell (900) are too small, those of two are large enough."""
    wet = FL.frequency(A.flood(s, d))
    return N.numbered_floods(N.regions(wet.filter("frequency > 0.37").select("y", "x")), wet.filter("frequency > 0.40").select("y", "x"), 1800.0)


# --- hydrology ------------------------------------------------------------------------------------------------------


@query("h1_j17_station_interpolation", """
WITH k AS (SELECT y, x, value, round(pow(x + CAST(0.5 AS DOUBLE) - px, 2) + pow(y + CAST(0.5 AS DOUBLE) - py, 2), 9) AS dd, row_number() OVER (PARTITION BY y, x ORDER BY round(pow(x + CAST(0.5 AS DOUBLE) - px, 2) + pow(y + CAST(0.5 AS DOUBLE) - py, 2), 9), station_id) AS r FROM grid, stations WHERE value IS NOT NULL)
SELECT y, x, round(sum(value / dd) / sum(1 / dd), 5) AS value FROM k WHERE r <= 5 GROUP BY y, x""")
def h1(s, d):
    return H.idw(A.grid(s), A.stations(s, d))


@query("h2_station_units", "SELECT o_custkey AS station_id, CAST(o_orderdate AS DATE) AS date, CAST(dayofyear(o_orderdate) AS INT) AS doy, round(3000 // 100 + (3000 + o_custkey % 60) % 100 / CAST(60 AS DOUBLE), 6) AS lat, round(CASE WHEN o_orderkey % 50 = 0 THEN NULL ELSE o_orderkey % 30000 END / CAST(10 AS DOUBLE), 6) AS value FROM orders")
def h2(s, d):
    raw = A.table(s, d, "orders").select(c("o_custkey").alias("station_id"), (3000 + c("o_custkey") % 60).cast("int").alias("lat_ddmm"), F.lit(11230).alias("lon_ddmm"), F.lit(1000).alias("alt_cm"), F.to_date("o_orderdate").alias("date"), F.when(c("o_orderkey") % 50 == 0, 32766).otherwise(c("o_orderkey") % 30000).alias("v"))
    return H.station_units(raw).select("station_id", "date", "doy", F.round("lat", 6).alias("lat"), F.round("value", 6).alias("value"))


def places(s):
    return s.range(12).select(c("id").cast("int").alias("place"), (c("id") * 7.5 - 10).alias("chainage"))


def gauges_by_year(s, d):
    g = A.gauge(s, d).filter(~((c("station") == 2) & (F.year("date") == 1997)))
    return g.select("station", (c("station") * 20.0).alias("chainage"), F.year("date").alias("year")).distinct()


_J18 = """pl AS (SELECT CAST(i AS INT) AS place, i * CAST(7.5 AS DOUBLE) - 10 AS chainage FROM range(12) t(i)), gy AS (SELECT DISTINCT station, station * CAST(20 AS DOUBLE) AS c, year(date) AS year FROM gauge WHERE NOT (station = 2 AND year(date) = 1997)),
ra AS (SELECT *, row_number() OVER (PARTITION BY year ORDER BY c) AS k, count(*) OVER (PARTITION BY year) AS m FROM gy),
pk AS (SELECT place, chainage, year, greatest(1, least(count(*) FILTER (WHERE c <= chainage), max(m) - 1)) AS k FROM pl, ra GROUP BY place, chainage, year),
br AS (SELECT place, chainage, pk.year, a.station AS lower, a.c AS lower_at, b.station AS upper, b.c AS upper_at FROM pk JOIN ra a ON a.year = pk.year AND a.k = pk.k JOIN ra b ON b.year = pk.year AND b.k = pk.k + 1)"""


@query("j18_nearest_gauges", f"WITH {_J18} SELECT place, chainage, year, lower, lower_at, upper, upper_at FROM br")
def j18(s, d):
    return H.nearest_gauges(places(s), gauges_by_year(s, d))


@query("h5_h6_levels_between", f"""WITH {_J18} SELECT place, g.date, round(g.level + (h.level - g.level) * (chainage - lower_at) / (upper_at - lower_at), 9) AS level FROM br JOIN gauge g ON g.station = lower AND year(g.date) = br.year JOIN gauge h ON h.station = upper AND h.date = g.date""")
def h5(s, d):
    return H.levels_between(j18(s, d), A.gauge(s, d))


_LINE = """k AS (SELECT line, seq AS seg, x AS ax, y AS ay, lead(x) OVER w AS bx, lead(y) OVER w AS by_ FROM thalweg WINDOW w AS (PARTITION BY line ORDER BY seq)),
sg AS (SELECT *, sqrt(pow(bx - ax, 2) + pow(by_ - ay, 2)) AS len, coalesce(sum(sqrt(pow(bx - ax, 2) + pow(by_ - ay, 2))) OVER (PARTITION BY line ORDER BY seg ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS at_ FROM k WHERE bx IS NOT NULL)"""


def _located(name: str, key: str, points: str) -> str:
    """SQL of the nearest place on the line of every one of ``points(key, px, py)``."""
    t = "greatest(0, least(1, ((px - ax) * (bx - ax) + (py - ay) * (by_ - ay)) / (len * len)))"
    d = f"round(sqrt(pow(px - ax - {t} * (bx - ax), 2) + pow(py - ay - {t} * (by_ - ay), 2)), 9)"
    side = "CAST(sign(round((bx - ax) * (py - ay) - (by_ - ay) * (px - ax), 9)) AS INT)"
    return f"""{name} AS (SELECT {key}, line, seg, chainage, distance, side FROM (SELECT {key}, line, seg, round(at_ + {t} * len, 6) AS chainage, {d} AS distance, {side} AS side, row_number() OVER (PARTITION BY {key} ORDER BY {d}, line, seg) AS rk FROM {points}, sg) WHERE rk = 1)"""


_PIX = f"{_LINE}, ce AS (SELECT y, x, x + CAST(0.5 AS DOUBLE) AS px, y + CAST(0.5 AS DOUBLE) AS py FROM grid), " + _located("pl", "y, x", "ce")
_RIV = f"""{_PIX}, {_located("gl", "station", "gauge_sites")}, gy AS (SELECT DISTINCT g.station, gl.chainage AS c, year(date) AS year FROM gauge g JOIN gl ON gl.station = g.station WHERE NOT (g.station = 2 AND year(date) = 1997)),
ra AS (SELECT *, row_number() OVER (PARTITION BY year ORDER BY c) AS k, count(*) OVER (PARTITION BY year) AS m FROM gy), pk AS (SELECT y, x, chainage, year, greatest(1, least(count(*) FILTER (WHERE c <= chainage), max(m) - 1)) AS k FROM pl, ra GROUP BY y, x, chainage, year),
br AS (SELECT y, x, chainage, pk.year, a.station AS lower, a.c AS lower_at, b.station AS upper, b.c AS upper_at FROM pk JOIN ra a ON a.year = pk.year AND a.k = pk.k JOIN ra b ON b.year = pk.year AND b.k = pk.k + 1),
lv AS (SELECT y, x, g.date, g.level + (h.level - g.level) * ((chainage - lower_at) / (upper_at - lower_at)) AS level FROM br JOIN gauge g ON g.station = lower AND year(g.date) = br.year JOIN gauge h ON h.station = upper AND h.date = g.date)"""


def pixel_places(s, d):
    """Every pixel's centre on the river."""
    cells = A.grid(s).select("y", "x", (c("x") + 0.5).alias("px"), (c("y") + 0.5).alias("py"))
    return L.locate(cells, L.segments(A.thalweg(s, d)))


def river_gauges(s, d):
    """``(station, chainage, year)``: the gauges where they stand on the river, in the years that they have data (one lacks a year)."""
    at = L.locate(A.gauge_sites(s, d), L.segments(A.thalweg(s, d))).select("station", "chainage")
    years = A.gauge(s, d).select("station", F.year("date").alias("year")).distinct().filter(~((c("station") == 2) & (c("year") == 1997)))
    return at.join(years, "station").select("station", "chainage", "year")


@query("w14_positions", f"WITH {_PIX} SELECT y, x, line, seg, chainage, distance, side FROM pl")
def w14p(s, d):
    return pixel_places(s, d).select("y", "x", "line", "seg", "chainage", "distance", "side")


@query("w14_distance_along", f"WITH {_LINE}, {_located('gl', 'station', 'gauge_sites')} SELECT p.station AS a, q.station AS b, round(abs(p.chainage - q.chainage), 6) AS distance FROM gl p JOIN gl q ON p.station < q.station")
def w14d(s, d):
    """Distance along the river between every two of the gauges."""
    at = L.locate(A.gauge_sites(s, d), L.segments(A.thalweg(s, d)))
    n = at.select("station")
    pairs = n.withColumnRenamed("station", "a").join(n.withColumnRenamed("station", "b"), F.col("a") < F.col("b"))  # five gauges
    return L.along(pairs, at, "station")


@query("w14_point_at", f"""WITH {_LINE}, e AS (SELECT line, max(at_ + len) AS total FROM sg GROUP BY line), pc AS (SELECT CAST(i AS INT) AS k, line, total * i / CAST(40 AS DOUBLE) AS chainage FROM e, range(41) t(i))
SELECT k, line, round(chainage, 6) AS chainage, px, py FROM (SELECT k, pc.line, chainage, round(ax + (bx - ax) * ((chainage - at_) / len), 6) AS px, round(ay + (by_ - ay) * ((chainage - at_) / len), 6) AS py, row_number() OVER (PARTITION BY k, pc.line ORDER BY seg) AS rk FROM pc JOIN sg ON sg.line = pc.line AND len > 0 AND chainage >= at_ AND chainage <= at_ + len) WHERE rk = 1""")
def w14a(s, d):
    """Points at equal steps of chainage along the river."""
    segs = L.segments(A.thalweg(s, d))
    total = segs.groupBy("line").agg(F.max(c("at") + F.hypot(c("bx") - c("ax"), c("by_") - c("ay"))).alias("total"))
    places = total.select("line", F.explode(F.sequence(F.lit(0), F.lit(40))).alias("k"), "total").select("k", "line", (c("total") * c("k") / 40).alias("chainage"))
    return L.point_at(segs, places).withColumn("chainage", F.round("chainage", 6))


@query("j18_pixel_gauges", f"WITH {_RIV} SELECT y, x, year, lower, upper FROM br")
def j18p(s, d):
    """The two gauges of every pixel by year."""
    g = river_gauges(s, d)
    return L.reach_of(pixel_places(s, d).select("y", "x", "chainage"), g).join(L.reaches(g), "reach").select("y", "x", "year", "lower", "upper")


@query("h6_pixel_levels", f"WITH {_RIV} SELECT y, x, date, round(level, 9) AS level FROM lv")
def h6(s, d):
    """Daily level at every pixel between the gauges assigned to it."""
    return L.pixel_levels(pixel_places(s, d).select("y", "x", "chainage"), river_gauges(s, d), A.gauge(s, d)).select("y", "x", "date", "level")


@query("h8_ground_between_gauges", f"""WITH {_RIV}, q AS (SELECT y, x, count(*) FILTER (WHERE cls = 2) AS wet, count(*) AS n FROM flood GROUP BY y, x), o AS (SELECT y, x, level, row_number() OVER (PARTITION BY y, x ORDER BY level) - 1 AS k, count(*) OVER (PARTITION BY y, x) AS days FROM lv)
SELECT y, x, round(level, 6) AS z FROM o JOIN q USING (y, x) WHERE wet < n AND wet > 0 AND k = days * (n - wet) // n""")
def h8g(s, d):
    """Ground of every pixel from its flood frequency and its own two gauges by year."""
    wet = A.flood(s, d).groupBy("y", "x").agg(F.count_if(c("cls") == 2).alias("n_wet"), F.count(F.lit(1)).alias("n"))
    p = pixel_places(s, d).select("y", "x", "chainage").join(wet, ["y", "x"])
    return L.ground_from_frequency(p, river_gauges(s, d), A.gauge(s, d)).select("y", "x", F.round("z", 6).alias("z"))


@query("h7_gauge_datum", "SELECT station, date, round(level - CASE station WHEN 1 THEN 1.5 WHEN 3 THEN -0.25 ELSE 0 END, 9) AS level FROM gauge")
def h7(s, d):
    meta = s.createDataFrame([(1, 1.5), (3, -0.25)], "station int, level_offset double")
    return H.datum(A.gauge(s, d), meta).select("station", "date", "level")


@query("h8_w16_level_at_frequency", """
WITH k AS (SELECT level, count(*) AS n FROM levels GROUP BY level), u AS (SELECT level, sum(n) OVER w / CAST(sum(n) OVER () AS DOUBLE) AS share FROM k WINDOW w AS (ORDER BY level DESC)),
st AS (SELECT level, share, lag(level) OVER w AS l0, lag(share) OVER w AS s0 FROM u WINDOW w AS (ORDER BY level DESC)), f AS (SELECT y, x, round(count(*) FILTER (WHERE cls = 2) / CAST(count(*) AS DOUBLE), 9) AS q FROM flood GROUP BY y, x)
SELECT y, x, round(level + (coalesce(l0, level) - level) * (share - q) / (share - coalesce(s0, 0)), 5) AS z FROM f JOIN st ON q > 0 AND q <= share AND q > coalesce(s0, 0)""")
def h8(s, d):
    return H.level_at_frequency(FL.frequency(A.flood(s, d)).select("y", "x", "frequency"), A.levels(s, d))


def profiles(s, d):
    p = A.table(s, d, "part")
    return p.select((c("p_partkey") % 20).cast("int").alias("cs"), F.floor(c("p_partkey") / 20).cast("double").alias("d"), (c("p_retailprice") % 37).alias("z"))


_PR = "pr AS (SELECT CAST(p_partkey % 20 AS INT) AS cs, CAST(p_partkey // 20 AS DOUBLE) AS d, p_retailprice % 37 AS z FROM part)"


@query("w14_chainage", f"WITH {_PR}, k AS (SELECT cs, d, z, coalesce(sqrt(pow(d - lag(d) OVER w, 2) + pow(z - lag(z) OVER w, 2)), 0) AS st FROM pr WINDOW w AS (PARTITION BY cs ORDER BY d)) SELECT cs, d, round(sum(st) OVER (PARTITION BY cs ORDER BY d), 6) AS chainage FROM k")
def w14(s, d):
    line = profiles(s, d).select("cs", c("d").alias("seq"), c("d").alias("x"), c("z").alias("y"))
    return H.chainage(line, ["cs"]).select("cs", c("seq").alias("d"), F.round("chainage", 6).alias("chainage"))


@query("h17_directions", f"WITH {_PR}, k AS (SELECT cs, d, lead(d) OVER w - d AS dx, lead(z) OVER w - z AS dy FROM pr WINDOW w AS (PARTITION BY cs ORDER BY d)) SELECT cs, d AS seq, round(dx / sqrt(dx * dx + dy * dy), 6) AS ux, round(dy / sqrt(dx * dx + dy * dy), 6) AS uy FROM k WHERE dx IS NOT NULL")
def h17(s, d):
    line = profiles(s, d).select("cs", c("d").alias("seq"), c("d").alias("x"), c("z").alias("y"))
    return H.directions(line, ["cs"]).select("cs", "seq", F.round("ux", 6).alias("ux"), F.round("uy", 6).alias("uy"))


@query("w15_lowest_point", f"WITH {_PR}, m AS (SELECT cs, (min(d) + max(d)) / 2 AS mid FROM pr GROUP BY cs), k AS (SELECT cs, d, z, row_number() OVER (PARTITION BY cs ORDER BY z, abs(d - mid), d) AS r FROM pr JOIN m USING (cs)) SELECT cs, d, z FROM k WHERE r = 1")
def w15(s, d):
    return H.lowest_point(profiles(s, d))


@query("j22_profile_difference", f"""WITH {_PR}, a AS (SELECT cs, d, z FROM pr WHERE d % 2 = 0), b AS (SELECT cs, d + CAST(0.5 AS DOUBLE) AS d, z FROM pr WHERE d % 3 = 0), al AS (SELECT cs, d FROM a UNION SELECT cs, d FROM b),
ap AS (SELECT cs, d, z, lead(d) OVER w AS d1, lead(z) OVER w AS z1 FROM a WINDOW w AS (PARTITION BY cs ORDER BY d)), bp AS (SELECT cs, d, z, lead(d) OVER w AS d1, lead(z) OVER w AS z1 FROM b WINDOW w AS (PARTITION BY cs ORDER BY d)),
v AS (SELECT al.cs, al.d, CASE WHEN ap.d = al.d THEN ap.z ELSE ap.z + (ap.z1 - ap.z) * (al.d - ap.d) / (ap.d1 - ap.d) END AS za, CASE WHEN bp.d = al.d THEN bp.z ELSE bp.z + (bp.z1 - bp.z) * (al.d - bp.d) / (bp.d1 - bp.d) END AS zb
 FROM al JOIN ap ON ap.cs = al.cs AND (ap.d = al.d OR (ap.d < al.d AND al.d < ap.d1)) JOIN bp ON bp.cs = al.cs AND (bp.d = al.d OR (bp.d < al.d AND al.d < bp.d1)))
SELECT cs, d, round(za, 6) AS za, round(zb, 6) AS zb, round(zb - za, 6) AS diff FROM v""")
def j22(s, d):
    p = profiles(s, d)
    out = H.profile_difference(p.filter("d % 2 = 0"), p.filter("d % 3 = 0").withColumn("d", c("d") + 0.5))
    return out.withColumns({n: F.round(n, 6) for n in ("za", "zb", "diff")})


@query("w3_channel_swing", f"WITH {_PR}, k AS (SELECT cs, CAST(d AS INT) AS year, round(z - lag(z) OVER (PARTITION BY cs ORDER BY d), 6) AS mv FROM pr) SELECT cs, year, mv AS move, CASE WHEN mv > 0 THEN 'Right' WHEN mv < 0 THEN 'Left' ELSE 'None' END AS side FROM k WHERE mv IS NOT NULL")
def w3(s, d):
    return H.swing(profiles(s, d).select("cs", c("d").cast("int").alias("year"), c("z").alias("d"))).withColumn("move", F.round("move", 6))


@query("h12_points_along", "SELECT CAST(s_suppkey AS INT) AS cs, CAST(k AS INT) AS k, round(s_suppkey % 10 + (s_nationkey - s_suppkey % 10) * k / CAST(8 AS DOUBLE), 9) AS px, round(s_nationkey * k / CAST(8 AS DOUBLE), 9) AS py FROM supplier, range(9) t(k)")
def h12(s, d):
    sec = A.table(s, d, "supplier").select(c("s_suppkey").cast("int").alias("cs"), (c("s_suppkey") % 10).cast("double").alias("ax"), F.lit(0.0).alias("ay"), c("s_nationkey").cast("double").alias("bx"), c("s_nationkey").cast("double").alias("by"))
    return H.points_along(sec, 8)


@query("h13_attach_profiles", f"WITH {_PR}, a AS (SELECT cs, CAST(d AS INT) AS pos, d, z FROM pr WHERE cs < 12), b AS (SELECT cs, CAST(d AS INT) AS pos, d, z FROM pr WHERE cs > 8) SELECT cs, pos, a.d AS d_sampled, a.z AS z_sampled, b.d AS d_surveyed, b.z AS z_surveyed FROM a FULL JOIN b USING (cs, pos)")
def h13(s, d):
    p = profiles(s, d).withColumn("pos", c("d").cast("int"))
    return H.attach_profiles(p.filter("cs < 12"), p.filter("cs > 8"))


@query("h13_section_issues", f"WITH {_PR}, a AS (SELECT DISTINCT cs FROM pr WHERE cs < 12), b AS (SELECT cs, CAST(floor(d / 2) AS INT) AS pos FROM pr WHERE cs > 8 UNION ALL SELECT cs, CAST(d AS INT) * 1000 + 7 FROM pr WHERE cs BETWEEN 3 AND 4) SELECT cs, 'missing' AS issue FROM a WHERE cs NOT IN (SELECT cs FROM b) UNION ALL SELECT DISTINCT cs, 'redundant' FROM b WHERE cs NOT IN (SELECT cs FROM a) UNION ALL SELECT DISTINCT cs, 'duplicated' FROM (SELECT cs, pos FROM b GROUP BY cs, pos HAVING count(*) > 1)")
def h13i(s, d):
    """Sections missing in, redundant in or duplicated by a survey whose positions are half as fine."""
    p = profiles(s, d)
    surveyed = p.filter("cs > 8").select("cs", F.floor(c("d") / 2).cast("int").alias("pos")).unionByName(p.filter("cs between 3 and 4").select("cs", (c("d").cast("int") * 1000 + 7).alias("pos")))
    return H.section_issues(p.filter("cs < 12"), surveyed)


_SEG = """se AS (SELECT CAST(s_suppkey AS INT) AS cs, s_suppkey % 23 + CAST(0.31 AS DOUBLE) AS ax, s_nationkey % 7 + CAST(0.17 AS DOUBLE) AS ay, s_suppkey % 17 + CAST(0.77 AS DOUBLE) AS bx, s_nationkey % 19 + CAST(0.93 AS DOUBLE) AS by FROM supplier),
sg AS (SELECT CAST(c_custkey AS INT) AS seg, c_custkey % 29 + CAST(0.05 AS DOUBLE) AS ax, c_nationkey + CAST(0.41 AS DOUBLE) AS ay, c_custkey % 29 + CAST(1.2 AS DOUBLE) AS bx, c_nationkey + CAST(1.53 AS DOUBLE) AS by FROM customer)"""


@query("h14_crossings", f"""WITH {_SEG}, x AS (SELECT cs, seg FROM se s JOIN sg g ON
 sign((s.bx - s.ax) * (g.ay - s.ay) - (s.by - s.ay) * (g.ax - s.ax)) * sign((s.bx - s.ax) * (g.by - s.ay) - (s.by - s.ay) * (g.bx - s.ax)) < 0 AND sign((g.bx - g.ax) * (s.ay - g.ay) - (g.by - g.ay) * (s.ax - g.ax)) * sign((g.bx - g.ax) * (s.by - g.ay) - (g.by - g.ay) * (s.bx - g.ax)) < 0)
SELECT cs, count(seg) AS n_crossings FROM se LEFT JOIN x USING (cs) GROUP BY cs""")
def h14(s, d):
    k = lambda e, v: (e + F.lit(v))
    se = A.table(s, d, "supplier").select(c("s_suppkey").cast("int").alias("cs"), k(c("s_suppkey") % 23, 0.31).alias("ax"), k(c("s_nationkey") % 7, 0.17).alias("ay"), k(c("s_suppkey") % 17, 0.77).alias("bx"), k(c("s_nationkey") % 19, 0.93).alias("by"))
    sg = A.table(s, d, "customer").select(c("c_custkey").cast("int").alias("seg"), k(c("c_custkey") % 29, 0.05).alias("ax"), k(c("c_nationkey"), 0.41).alias("ay"), k(c("c_custkey") % 29, 1.2).alias("bx"), k(c("c_nationkey"), 1.53).alias("by"))
    return H.crossings(se, sg)


@query("k5_boundary_table", f"WITH {_PR} SELECT 1 AS part, CAST(station AS VARCHAR) AS name, CAST(datediff('day', DATE '1995-01-01', date) * 24 AS INT) AS hour, flow AS value FROM gauge WHERE station = 0 UNION ALL SELECT 2, CAST(station AS VARCHAR), CAST(datediff('day', DATE '1995-01-01', date) * 24 AS INT), level FROM gauge WHERE station = 4 UNION ALL SELECT 3, CAST(cs AS VARCHAR), 0, z FROM pr WHERE d = 0")
def k5(s, d):
    return H.boundary_table(A.gauge(s, d), 0, 4, profiles(s, d).filter("d = 0"), "1995-01-01")


@query("k6_section_profiles", f"WITH {_PR} SELECT cs, CAST(count(*) AS INT) AS n, string_agg(CAST(round(d, 3) AS VARCHAR) || ':' || CAST(round(z, 3) AS VARCHAR), ' ' ORDER BY d, z) AS profile FROM pr GROUP BY cs")
def k6(s, d):
    return H.gather_profiles(profiles(s, d))


@query("k7_feature_grid", "SELECT y, x, CASE WHEN n = -1 THEN NULL ELSE n END AS value FROM roi LEFT JOIN (SELECT y, x, CAST(CASE WHEN count(*) % 7 = 0 THEN -1 ELSE count(*) END AS BIGINT) AS n FROM ndvi GROUP BY y, x) USING (y, x)")
def k7(s, d):
    t = A.index(s, d, "NDVI").groupBy("y", "x").agg(F.count(F.lit(1)).alias("n")).withColumn("n", F.when(c("n") % 7 == 0, -1).otherwise(c("n")))
    return A.roi(s).join(t, ["y", "x"], "left").select("y", "x", F.when(c("n") != -1, c("n")).alias("value"))


# --- catalogs -------------------------------------------------------------------------------------------------------


def archive(s, d):
    """File names as the archive has them, made from orders."""
    o = A.table(s, d, "orders")
    day = F.date_format("o_orderdate", "yyyyMMdd")
    tile = F.lpad((c("o_custkey") % 50 + 123000).cast("string"), 6, "0")
    copy = F.when(c("o_orderkey") % 9 == 0, "(1)").otherwise("")
    name = F.concat(F.element_at(F.array(*map(F.lit, ["LC08", "LE07", "LT05"])), (c("o_orderkey") % 3 + 1).cast("int")), F.lit("_L2SP_"), tile, F.lit("_"), day, F.lit("_20200101_02_T1"), copy, F.lit(".tar"))
    return o.select(name.alias("name"), F.round(c("o_totalprice") * 100).cast("long").alias("size"))


_ARC = "ar AS (SELECT CASE o_orderkey % 3 WHEN 0 THEN 'LC08' WHEN 1 THEN 'LE07' ELSE 'LT05' END || '_L2SP_' || CAST(o_custkey % 50 + 123000 AS VARCHAR) || '_' || strftime(o_orderdate, '%Y%m%d') || '_20200101_02_T1' || CASE WHEN o_orderkey % 9 = 0 THEN '(1)' ELSE '' END || '.tar' AS name, CAST(round(o_totalprice * 100) AS BIGINT) AS size FROM orders)"
_LS = _ARC + r", ls AS (SELECT name, size, substr(name, 1, 4) AS sensor, 'L2SP' AS level, substr(name, 11, 6) AS tile, CAST(strptime(substr(name, 18, 8), '%Y%m%d') AS DATE) AS date, 'T1' AS tier FROM ar)"


@query("s1_scene_catalog", f"WITH {_LS} SELECT name, sensor, level, tile, date, tier FROM ls")
def s1(s, d):
    return CAT.landsat(archive(s, d)).select("name", "sensor", "level", "tile", "date", "tier")


@query("s12_file_filter", f"WITH {_ARC} SELECT name FROM ar WHERE (contains(name, 'LC08') OR contains(name, 'LE07')) AND contains(name, '_1999') AND NOT contains(name, '(1)')")
def s12(s, d):
    from ..functions.text import has_words

    return archive(s, d).filter(has_words(c("name"), ("LC08", "LE07"), ("_1999",), ("(1)",))).select("name")


@query("s13_date_in_name", f"WITH {_LS} SELECT name, date FROM ls")
def s13(s, d):
    from ..functions.text import date_in_name

    return archive(s, d).select("name", date_in_name(c("name")).alias("date"))


@query("s15_product_search", f"""WITH {_LS} SELECT name, date FROM ls WHERE sensor = 'LE07' AND date BETWEEN DATE '1996-01-01' AND DATE '1998-12-31' AND size % 100 <= 60 AND size % 2 = 0 ORDER BY date, name LIMIT 1000""")
def s15(s, d):
    p = CAT.landsat(archive(s, d)).select("name", "date", c("sensor").alias("kind"), (c("size") % 100).alias("cloud"), (c("size") % 2 == 0).alias("online"))
    return CAT.search_products(p, "LE07", "1996-01-01", "1998-12-31", 60, True).select("name", "date")


@query("w4_duplicate_scenes", f"""WITH {_LS}, b AS (SELECT *, regexp_replace(name, '\\(\\d+\\)', '') AS base FROM ls), k AS (SELECT *, row_number() OVER (PARTITION BY base ORDER BY size DESC, name) AS r FROM b),
m AS (SELECT name, date, tile, sensor, row_number() OVER (PARTITION BY date, tile ORDER BY sensor DESC, name) AS r2 FROM k WHERE r = 1) SELECT name, date, tile, sensor FROM m WHERE r2 = 1""")
def w4(s, d):
    f = CAT.largest_copy(archive(s, d))
    return CAT.newest_sensor(CAT.landsat(f)).select("name", "date", "tile", "sensor")


@query("s14_level_years", "SELECT date, level FROM gauge WHERE station = 1 AND year(date) BETWEEN 1996 AND 1998")
def s14(s, d):
    return A.gauge(s, d).filter((c("station") == 1) & F.year("date").between(1996, 1998)).select("date", "level")


# --- footprints, curves, breaks -------------------------------------------------------------------------------------


def _area_sql(r: float = 0.75) -> str:
    """Exact overlap of circles of radius ``r`` with cells, as in ``circle_share``."""
    arc = lambda t: f"(({t}) * sqrt(greatest(0, {r * r} - ({t}) * ({t}))) + {r * r} * asin(least(1, ({t}) / {r}))) / 2"

    def corner(x, y):
        a, b = f"least(abs({x}), {r})", f"least(abs({y}), {r})"
        meet = f"sqrt(greatest(0, {r * r} - {b} * {b}))"
        return f"(sign({x}) * sign({y}) * CASE WHEN {a} <= {meet} THEN {a} * {b} ELSE {b} * {meet} + {arc(a)} - {arc(meet)} END)"

    w = f"({corner('l + 1', 'b + 1')} - {corner('l', 'b + 1')} - {corner('l + 1', 'b')} + {corner('l', 'b')}) / (pi() * {r * r})"
    return f"""WITH m AS (SELECT y, x, max(value) AS v FROM ndvi JOIN roi USING (y, x) GROUP BY y, x), f AS (SELECT shot, px, py, CAST(floor(py) AS INT) + dy AS y, CAST(floor(px) AS INT) + dx AS x FROM footprints, range(-1, 2) a(dy), range(-1, 2) b(dx)),
o AS (SELECT shot, y, x, CAST(x AS DOUBLE) - px AS l, CAST(y AS DOUBLE) - py AS b FROM f), w AS (SELECT shot, y, x, round({w}, 12) AS w FROM o)
SELECT shot, round(sum(v * w) / nullif(sum(CASE WHEN v IS NOT NULL THEN w END), 0), 9) AS value, round(coalesce(sum(CASE WHEN v IS NOT NULL THEN w END), 0) / sum(w), 9) AS reliability FROM w LEFT JOIN m USING (y, x) WHERE w > 0 GROUP BY shot"""


@query("m1_link_nearest", "WITH m AS (SELECT y, x, max(value) AS v FROM ndvi JOIN roi USING (y, x) GROUP BY y, x) SELECT shot, round(v, 9) AS value, CASE WHEN v IS NULL THEN CAST(0 AS DOUBLE) ELSE CAST(1 AS DOUBLE) END AS reliability FROM footprints LEFT JOIN m ON y = CAST(floor(py) AS INT) AND x = CAST(floor(px) AS INT)")
def m1(s, d):
    return FP.link(A.footprints(s, d), region_max(s, d), "nearest", [])


def region_max(s, d):
    from ..operators.projection import within_roi

    return within_roi(A.index(s, d, "NDVI"), A.roi(s)).groupBy("y", "x").agg(F.max("value").alias("value"))


@query("m1_link_focal", """
WITH m AS (SELECT y, x, max(value) AS v FROM ndvi JOIN roi USING (y, x) GROUP BY y, x), f AS (SELECT shot, CAST(floor(py) AS INT) + dy AS y, CAST(floor(px) AS INT) + dx AS x FROM footprints, range(-1, 2) a(dy), range(-1, 2) b(dx))
SELECT shot, round(avg(v), 9) AS value, round(count(v) / CAST(9 AS DOUBLE), 9) AS reliability FROM f LEFT JOIN m USING (y, x) GROUP BY shot""")
def m1f(s, d):
    return FP.link(A.footprints(s, d), region_max(s, d), "focal", [])


@query("m1_link_area", _area_sql())
def m1a(s, d):
    return FP.link(A.footprints(s, d), region_max(s, d), "area", [], diameter=1.5)


@query("m4_a23_majority_class", """
WITH t AS (SELECT y, x, (y * 3 + x) // 4 % 5 AS cls FROM roi), f AS (SELECT shot, CAST(floor(py) AS INT) + dy AS y, CAST(floor(px) AS INT) + dx AS x FROM footprints, range(-1, 2) a(dy), range(-1, 2) b(dx)),
k AS (SELECT shot, cls, CAST(count(*) AS DOUBLE) AS w FROM f JOIN t USING (y, x) GROUP BY 1, 2), r AS (SELECT *, row_number() OVER (PARTITION BY shot ORDER BY w DESC, cls) AS n FROM k) SELECT shot, CAST(cls AS INT) AS cls, w AS weight FROM r WHERE n = 1""")
def m4(s, d):
    t = A.roi(s).withColumn("cls", (F.floor((c("y") * 3 + c("x")) / 4) % 5).cast("int"))
    return FP.majority_class(A.footprints(s, d), t, "cls")


@query("m5_training_rows", "SELECT shot, rh100 AS height FROM footprints WHERE quality = 1 AND shot % 4 = 3 AND rh100 > 2 AND rh100 <= 5.5")
def m5(s, d):
    f = A.footprints(s, d).filter("quality = 1").select("shot", (c("shot") % 4).alias("veg_type"), c("rh100").alias("height"), "px", "py")
    return FP.training_rows(f, 3, 2.0, 5.5, ["px", "py"]).select("shot", "height")


@query("m8_tree_models")
def m8(s, d):
    f = A.footprints(s, d).withColumn("fold", (c("shot") % 2).cast("int")).withColumn("w", 1 / (1 + F.exp(3 - c("rh100"))))
    return FP.train_trees(f, ["px", "py"], "rh100", [{"maxDepth": 2, "maxIter": 3}, {"maxDepth": 3, "maxIter": 3}], "fold", "w")


def curve_parameters(s, d):
    """Made from suppliers by year: something smooth to measure."""
    p = A.table(s, d, "supplier")
    k = c("s_suppkey")
    return p.select((k % 20).cast("int").alias("y"), F.floor(k / 20).cast("int").alias("x"), F.lit(2000).alias("year"), (0.1 + c("s_nationkey") / 200).alias("p0"), (0.5 + k % 7 / 20).alias("p1"), (110.0 + k % 30).alias("p2"), (8.0 + k % 5).alias("p3"), (260.0 + k % 40).alias("p4"), (9.0 + k % 4).alias("p5"), (k % 10 / 20000).alias("p6"))


_CP = """cp AS (SELECT CAST(s_suppkey % 20 AS INT) AS y, CAST(s_suppkey // 20 AS INT) AS x, 2000 AS year, CAST(0.1 AS DOUBLE) + s_nationkey / CAST(200 AS DOUBLE) AS p0, CAST(0.5 AS DOUBLE) + (s_suppkey % 7) / CAST(20 AS DOUBLE) AS p1, CAST(110 + s_suppkey % 30 AS DOUBLE) AS p2, CAST(8 + s_suppkey % 5 AS DOUBLE) AS p3, CAST(260 + s_suppkey % 40 AS DOUBLE) AS p4, CAST(9 + s_suppkey % 4 AS DOUBLE) AS p5, (s_suppkey % 10) / CAST(20000 AS DOUBLE) AS p6 FROM supplier),
cv AS (SELECT cp.*, CAST(t AS INT) AS t, round(p0 + (p1 - p6 * t) * (1 / (1 + exp((p2 - t) / p3)) - 1 / (1 + exp((p4 - t) / p5))), 6) AS v FROM cp, range(1, 366) r(t))"""


@query("t11_phenology_metrics", f"""WITH {_CP}, g AS (SELECT y, x, year, max(v) AS peak_vi, first(t ORDER BY v DESC, t) AS peak_doy, round(avg(v) FILTER (WHERE t BETWEEN p2 AND p4), 6) AS mavi, round(stddev_pop(v) FILTER (WHERE t BETWEEN p2 AND p4), 5) AS mavi_std, round(sum(v) FILTER (WHERE t BETWEEN p2 AND p4), 4) AS tsvi, min(p0) AS p0, min(p2) AS p2, min(p3) AS p3, min(p4) AS p4, min(p5) AS p5, min(p6) AS p6 FROM cv GROUP BY y, x, year)
SELECT y, x, year, peak_vi, peak_doy, CASE WHEN peak_doy BETWEEN p2 AND p4 + 60 THEN round(p2, 4) END AS sos, CASE WHEN peak_doy BETWEEN p2 AND p4 + 60 THEN round(p4, 4) END AS eos, CASE WHEN peak_doy BETWEEN p2 AND p4 + 60 THEN round(p4 - 2 * p5, 4) END AS eom, mavi, mavi_std, tsvi, round(p0, 6) AS trough_vi, round(p3, 6) AS gr, round(p5, 6) AS dr, round(p6, 6) AS dr2 FROM g""")
def t11(s, d):
    return PH.metrics(curve_parameters(s, d))


@query("t12_curve_summary", f"""WITH {_CP}, g AS (SELECT y, x, year, round(avg(v), 6) AS annual, round(avg(v) FILTER (WHERE t BETWEEN 121 AND 304), 6) AS flood_season, round(avg(v) FILTER (WHERE t NOT BETWEEN 121 AND 304), 6) AS off_season, max(v) AS vmax, first(t ORDER BY v DESC, t) AS day_max, count(*) FILTER (WHERE v >= 0.3) AS bloom_days FROM cv GROUP BY y, x, year),
b AS (SELECT y, x, year, round(avg(v), 6) AS bloom_after FROM cv JOIN g USING (y, x, year) WHERE v >= 0.3 AND t > day_max GROUP BY y, x, year) SELECT * FROM g LEFT JOIN b USING (y, x, year)""")
def t12(s, d):
    return PH.curve_summary(curve_parameters(s, d))


@query("t8_curve_fit")
def t8(s, d):
    o = PH.expand(curve_parameters(s, d)).filter("t % 16 = 3").select("y", "x", F.date_add(F.lit("2000-01-01").cast("date"), c("t") - 1).alias("date"), c("v").alias("value"))
    return PH.fit_curves(o)


@query("t9_fourier_fit")
def t9(s, d):
    return PH.fit_fourier(A.index(s, d, "NDVI"))


@query("t14_t15_breaks")
def t14(s, d):
    b = A.bands(s, d).select("y", "x", "date", "green", "nir")
    return B.detect_breaks(b, ["green", "nir"]).select("y", "x", "seg", "t_start", "t_end", "t_break", "num_obs")


@query("a27_break_summary")
def a27(s, d):
    return B.break_summary(t14(s, d))


@query("t16_recovery_time", f"WITH {_CP} SELECT y, x, round(CASE WHEN CAST(0.01 AS DOUBLE) * p1 / (p1 - p0) > 0 AND CAST(0.01 AS DOUBLE) * p1 / (p1 - p0) < 1 THEN -ln((1 - CAST(0.99 AS DOUBLE)) * p1 / (p1 - p0)) / (CAST(0.01 AS DOUBLE) + p6) END, 4) AS days FROM cp")
def t16(s, d):
    return curve_parameters(s, d).select("y", "x", F.round(PH.recovery_time(c("p1"), c("p0"), c("p6") + 0.01), 4).alias("days"))


_RC = "rc AS (SELECT y, x, CAST(k * 12 AS DOUBLE) AS t, p1 - (p1 - p0) * exp(-(CAST(0.01 AS DOUBLE) + p6) * k * 12) AS v FROM cp, range(30) r(k))"


@query("t16_recovery_fit", f"""WITH {_CP}, {_RC}, rs AS (SELECT y, x, max(v) FILTER (WHERE t < 60) AS a, min(v) FILTER (WHERE t < 60) AS b, max(v) FILTER (WHERE t >= 60) AS c, min(v) FILTER (WHERE t >= 60 AND t < 180) AS d, min(v) FILTER (WHERE t >= 180) AS e FROM rc GROUP BY y, x)
SELECT y, x, round(p1, 4) AS ymax, round(p0, 4) AS y0, round(CAST(0.01 AS DOUBLE) + p6, 6) AS rate, round(-ln((1 - CAST(0.99 AS DOUBLE)) * p1 / (p1 - p0)) / (CAST(0.01 AS DOUBLE) + p6), 2) AS days, round((a - b) / a, 9) AS resistance1, round((c - d) / c, 9) AS resistance2, round((c - e) / c, 9) AS resistance3 FROM cp JOIN rs USING (y, x)""")
def t16f(s, d):
    """Recovery curves fitted again from values on known curves, with their resistance ratios."""
    t = F.explode(F.transform(F.sequence(F.lit(0), F.lit(29)), lambda k: (k * 12).cast("double")))
    v = curve_parameters(s, d).withColumn("t", t).select("y", "x", "t", (c("p1") - (c("p1") - c("p0")) * F.exp(-(c("p6") + 0.01) * c("t"))).alias("value"))
    fit = PH.fit_recovery(v, ["y", "x"]).join(PH.resistance(v, ["y", "x"], 60.0, 180.0), ["y", "x"])
    days = PH.recovery_time(c("ymax"), c("y0"), c("rate"))
    return fit.select("y", "x", F.round("ymax", 4).alias("ymax"), F.round("y0", 4).alias("y0"), F.round("rate", 6).alias("rate"), F.round(days, 2).alias("days"), "resistance1", "resistance2", "resistance3")


# --- sinks and streams ----------------------------------------------------------------------------------------------


@query("k1_s16_save_load_cube", "SELECT idx, year(date) AS year, count(*) AS n, round(sum(value), 6) AS total FROM obs GROUP BY ALL")
def k1(s, d):
    from ..session import new_path

    path = new_path(s, "cube")
    TB.save_cube(A.obs(s, d), path)
    back = TB.load_cube(s, path)
    return back.groupBy("idx", F.year("date").alias("year")).agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("value"), 6).alias("total"))


@query("k4_station_lines", """
WITH g AS (SELECT station, CAST(ts AS DATE) AS date, round(avg(value), 9) AS a, max(value) AS b, min(value) AS e, round(sum(value), 4) AS t FROM weather GROUP BY ALL)
SELECT concat_ws(' ', station, year(date), month(date), day(date), CAST(round(a * 10) AS INT), CAST(round(b * 10) AS INT), CAST(round(e * 10) AS INT), CAST(round(t * 10) AS INT)) AS value FROM g""")
def k4(s, d):
    from ..operators.temporal import hourly_to_daily

    return TB.station_lines(hourly_to_daily(A.weather(s, d), ["station"]))


@query("k8_pixel_series", "SELECT y, x, len(list(date)) AS n, min(date) AS first_date, arg_min(value, date) AS first_value FROM ndvi GROUP BY y, x")
def k8(s, d):
    series = A.index(s, d, "NDVI").groupBy("y", "x").agg(F.array_sort(F.collect_list(F.struct("date", "value"))).alias("series"))
    return series.select("y", "x", F.size("series").cast("long").alias("n"), F.element_at("series", 1)["date"].alias("first_date"), F.element_at("series", 1)["value"].alias("first_value"))


@query("x1_latest_reading", "SELECT user_id AS station, max(ts) AS ts, arg_max(value, ts) AS value FROM events GROUP BY 1")
def x1(s, d):
    """Final state of the readings (a batch over what the stream would have appended)."""
    w = A.weather(s, d).dropDuplicates(["station", "ts"])
    return w.groupBy("station").agg(F.max("ts").alias("ts"), F.max_by("value", "ts").alias("value"))


@query("x1_stream_upsert", """
WITH e AS (SELECT user_id AS station, ts, value, CAST(CAST(ts AS DATE) - CAST('2024-01-01' AS DATE) AS INT) + 1 AS dd, event_id % 7 = 0 AS slow FROM events)
SELECT station, count(*) FILTER (WHERE NOT (slow AND dd <= 8)) AS n, max(ts) FILTER (WHERE NOT (slow AND dd <= 8)) AS latest, arg_max(value, ts) FILTER (WHERE NOT (slow AND dd <= 8)) AS value, count(*) FILTER (WHERE slow AND dd <= 8) AS late FROM e GROUP BY station""")
def x1s(s, d):
    """Readings of three files through a stream: the second repeats days of the first, and the third brings every seventh
    reading of the first eight days, twelve days behind the others. Late ones are counted by station, not taken."""
    from ..session import new_path
    from ..streaming import streams

    e = A.table(s, d, "events").select(c("user_id").alias("station"), c("ts").cast("timestamp").alias("ts"), "value", (c("event_id") % 7 == 0).alias("slow"))
    day = F.datediff(F.to_date("ts"), F.lit("2024-01-01").cast("date")) + 1
    path = new_path(s, "stream")
    files = [(day <= 10) & ~(c("slow") & (day <= 8)), day.between(9, 20), (day > 20) | (c("slow") & (day <= 8))]
    for k, keep in enumerate(files):
        e.filter(keep).select("station", "ts", "value").coalesce(1).write.parquet(f"{path}/in/file={k}")
    state = streams.upserts(streams.by_file(s, f"{path}/in", "station bigint, ts timestamp, value double, file int"), f"{path}/state", f"{path}/cp")
    got = state.readings.groupBy("station").agg(F.count(F.lit(1)).alias("n"), F.max("ts").alias("latest"), F.max_by("value", "ts").alias("value"))
    late = state.late.groupBy("station").agg(F.sum("n").cast("long").alias("late"))
    return got.join(late, "station", "full").select("station", F.coalesce("n", F.lit(0)).alias("n"), "latest", "value", F.coalesce("late", F.lit(0)).alias("late"))


@query("x2_pending_items", "WITH l AS (SELECT user_id AS item, arg_max(CASE event_type WHEN 'purchase' THEN 'Downloaded' WHEN 'error' THEN 'Issued' WHEN 'signup' THEN 'NoData' ELSE 'Unknown' END, ts) AS state FROM events GROUP BY 1) SELECT item, state FROM l WHERE state NOT IN ('Downloaded', 'NoData')")
def x2(s, d):
    from ..streaming.streams import pending

    e = A.table(s, d, "events")
    state = F.when(c("event_type") == "purchase", "Downloaded").when(c("event_type") == "error", "Issued").when(c("event_type") == "signup", "NoData").otherwise("Unknown")
    return pending(e.select(c("user_id").alias("item"), state.alias("state"), "ts"), e.select(c("user_id").alias("item")).distinct())
