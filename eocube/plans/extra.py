"""Queries: further catalogs, linkage, models and inundation."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import flood as FL
from ..operators import footprints as FP
from ..operators import hydro as H
from ..operators import inundation as I
from ..operators import phenology as PH
from ..operators import projection as P
from ..operators import stats as S
from ..operators import temporal as T
from ..sources import adapters as A
from ..sources import catalog as CAT
from .base import query
from .more import _CP, archive, curve_parameters, region_max

c = F.col


def names(s, d, kind):
    """Product names of other archives, made from orders."""
    o = A.table(s, d, "orders")
    day, k = F.date_format("o_orderdate", "yyyyMMdd"), (c("o_custkey") % 40).cast("string")
    doy = F.concat(F.date_format("o_orderdate", "yyyy"), F.lpad(F.dayofyear("o_orderdate").cast("string"), 3, "0"))
    text = {
        "s2": F.concat(F.when(c("o_orderkey") % 2 == 0, "S2A").otherwise("S2B"), F.lit("_MSIL2A_"), F.regexp_replace(day, "^19", "20"), F.lit("T030000_N0213_R0"), F.lpad(k, 2, "0"), F.lit("_T49RGP")),
        "s1": F.concat(F.when(c("o_orderkey") % 2 == 0, "S1A").otherwise("S1B"), F.lit("_IW_GRDH_1S"), F.when(c("o_orderkey") % 3 == 0, "DV").otherwise("SV"), F.lit("_"), day, F.lit("T101010_"), k),
        "lidar": F.concat(F.when(c("o_orderkey") % 2 == 0, "GEDI02").otherwise("GEDI04"), F.lit("_A_"), doy, F.lit("002011_O0"), k, F.lit(".h5")),
        "dotted": F.concat(F.lit("MCD18A2.A"), doy, F.lit(".h"), F.lpad(k, 2, "0"), F.lit("v05.061.hdf")),
    }[kind]
    return o.select(text.alias("name"), c("o_custkey").alias("size"))


@query("s2_catalog", """
WITH n AS (SELECT CASE WHEN o_orderkey % 2 = 0 THEN 'S2A' ELSE 'S2B' END AS sensor, '20' || strftime(o_orderdate, '%y%m%d') AS t, strftime(o_orderdate, '%Y%m%d') AS u, lpad(CAST(o_custkey % 40 AS VARCHAR), 2, '0') AS k FROM orders), m AS (SELECT sensor, CASE WHEN u LIKE '19%' THEN t ELSE u END AS t, k FROM n)
SELECT sensor || '_MSIL2A_' || t || 'T030000_N0213_R0' || k || '_T49RGP' AS name, sensor, CAST(try_strptime(t, '%Y%m%d') AS DATE) AS date, 'R0' || k AS orbit, 'T49RGP' AS tile FROM m""")
def s2(s, d):
    return CAT.sentinel2(names(s, d, "s2")).select("name", "sensor", "date", "orbit", "tile")


@query("s3_catalog", "SELECT CASE WHEN o_orderkey % 2 = 0 THEN 'S1A' ELSE 'S1B' END AS sensor, 'IW' AS beam, 'GRD' AS product, CASE WHEN o_orderkey % 3 = 0 THEN 'VV_VH' ELSE 'VV' END AS polarisation, CAST(o_orderdate AS DATE) AS date FROM orders")
def s3(s, d):
    return CAT.sentinel1(names(s, d, "s1")).select("sensor", "beam", "product", "polarisation", "date")


@query("s4_catalog", "SELECT CASE WHEN o_orderkey % 2 = 0 THEN 'L2' ELSE 'L4' END AS level, CAST(o_orderdate AS DATE) AS date, count(*) AS n FROM orders GROUP BY 1, 2")
def s4(s, d):
    return CAT.lidar(names(s, d, "lidar")).groupBy("level", "date").agg(F.count(F.lit(1)).alias("n"))


@query("s5_catalog", "SELECT 'MCD18A2' AS product, CAST(o_orderdate AS DATE) AS date, 'h' || lpad(CAST(o_custkey % 40 AS VARCHAR), 2, '0') || 'v05' AS tile FROM orders")
def s5(s, d):
    return CAT.dotted(names(s, d, "dotted")).select("product", "date", "tile")


@query("w5_shortest_path", """
WITH l AS (SELECT CASE o_orderkey % 3 WHEN 0 THEN 'LC08' WHEN 1 THEN 'LE07' ELSE 'LT05' END || '_L2SP_' || CAST(o_custkey % 50 + 123000 AS VARCHAR) || '_' || strftime(o_orderdate, '%Y%m%d') || '_20200101_02_T1' || CASE WHEN o_orderkey % 9 = 0 THEN '(1)' ELSE '' END || '.tar' AS name, CAST(round(o_totalprice * 100) AS BIGINT) AS size, CAST(o_orderdate AS DATE) AS date, CAST(o_custkey % 50 + 123000 AS VARCHAR) AS tile FROM orders),
k AS (SELECT *, row_number() OVER (PARTITION BY date, tile ORDER BY length(name), size DESC, name) AS r FROM l) SELECT name, size, date, tile FROM k WHERE r = 1""")
def w5(s, d):
    return CAT.shortest_path(CAT.landsat(archive(s, d))).select("name", "size", "date", "tile")


@query("j9_m3_link_series", """
WITH f AS (SELECT shot, date AS at_, CAST(floor(py) AS INT) AS y, CAST(floor(px) AS INT) AS x, year(date) AS year FROM footprints WHERE date IS NOT NULL),
b AS (SELECT shot, at_, max(n.date) FILTER (WHERE n.date <= at_) AS d0, min(n.date) FILTER (WHERE n.date >= at_) AS d1, any_value(f.y) AS y, any_value(f.x) AS x, any_value(year) AS year FROM f LEFT JOIN ndvi n ON n.y = f.y AND n.x = f.x AND abs(datediff('day', n.date, at_)) <= 60 AND year(n.date) = year GROUP BY shot, at_),
st AS (SELECT y, x, year(date) AS year, max(value) AS vmax, min(value) AS vmin, round(avg(value), 9) AS vmean, round(stddev_pop(value), 7) AS vstd FROM ndvi WHERE dayofyear(date) BETWEEN 90 AND 240 GROUP BY ALL)
SELECT shot, round(CASE WHEN d0 = d1 THEN p.value ELSE p.value + (q.value - p.value) * datediff('day', d0, at_) / datediff('day', d0, d1) END, 9) AS at_date, vmax, vmin, vmean, vstd
FROM b LEFT JOIN ndvi p ON p.y = b.y AND p.x = b.x AND p.date = d0 LEFT JOIN ndvi q ON q.y = b.y AND q.x = b.x AND q.date = d1 LEFT JOIN st ON st.y = b.y AND st.x = b.x AND st.year = b.year""")
def m3(s, d):
    return FP.link_series(A.footprints(s, d), A.index(s, d, "NDVI"), 90, 240)


@query("j9_m3_moments", """
WITH f AS (SELECT shot, date, CAST(floor(py) AS INT) AS y, CAST(floor(px) AS INT) AS x, year(date) AS year FROM footprints WHERE date IS NOT NULL), pk AS (SELECT y, x, year(date) AS year, first(date ORDER BY value DESC, date) AS peak FROM ndvi GROUP BY ALL),
a AS (SELECT shot, 'at_date' AS k, y, x, year, date AS at_ FROM f UNION ALL SELECT shot, 'at_peak', f.y, f.x, f.year, peak FROM f JOIN pk USING (y, x, year) UNION ALL SELECT shot, 'at_eom', f.y, f.x, f.year, make_date(CAST(f.year AS INT), 1, 1) + CAST(199 + f.x * 5 AS INT) FROM f JOIN pk USING (y, x, year)),
b AS (SELECT shot, k, at_, any_value(a.y) AS y, any_value(a.x) AS x, max(n.date) FILTER (WHERE n.date <= at_) AS d0, min(n.date) FILTER (WHERE n.date >= at_) AS d1 FROM a LEFT JOIN ndvi n ON n.y = a.y AND n.x = a.x AND year(n.date) = a.year GROUP BY shot, k, at_),
v AS (SELECT shot, k, round(CASE WHEN d0 = d1 THEN p.value ELSE p.value + (q.value - p.value) * datediff('day', d0, at_) / datediff('day', d0, d1) END, 9) AS value FROM b LEFT JOIN ndvi p ON p.y = b.y AND p.x = b.x AND p.date = d0 LEFT JOIN ndvi q ON q.y = b.y AND q.x = b.x AND q.date = d1)
SELECT shot, max(value) FILTER (WHERE k = 'at_date') AS at_date, max(value) FILTER (WHERE k = 'at_peak') AS at_peak, max(value) FILTER (WHERE k = 'at_eom') AS at_eom FROM v GROUP BY shot""")
def m3m(s, d):
    """Values at the shot's date, at the year's peak and at the end of maturity (day 200 + 5 x of the year)."""
    ndvi = A.index(s, d, "NDVI")
    peak = ndvi.groupBy("y", "x", F.year("date").alias("year")).agg(F.max_by("date", F.struct("value", -F.unix_date("date"))).alias("at"))
    seasons = peak.select("y", "x", "year", F.dayofyear("at").alias("peak"), (200 + c("x") * 5).alias("eom"))
    return FP.link_moments(A.footprints(s, d).filter("date is not null"), ndvi, seasons)


@query("m2_link_environment", """
WITH f AS (SELECT shot, date AS at_, CAST(floor(py) AS INT) AS y, CAST(floor(px) AS INT) AS x FROM footprints)
SELECT shot, count(value) AS n, round(sum(greatest(value - CAST(0.1 AS DOUBLE), 0)), 10) AS acc, round(max(value), 10) AS vmax, round(min(value), 10) AS vmin, round(avg(value) + 0, 12) AS vmean, round(stddev_pop(value), 8) AS vstd FROM f JOIN mndwi m ON m.y = f.y AND m.x = f.x AND m.date <= at_ AND year(m.date) = year(at_) GROUP BY shot""")
def m2(s, d):
    return FP.link_environment(A.footprints(s, d), A.index(s, d, "MNDWI"), base=0.1)


@query("m10_predict")
def m10(s, d):
    f = A.footprints(s, d)
    return FP.fit_predict(f.filter("shot % 2 = 0"), f, ["px", "py"], "rh100", numTrees=5, maxDepth=4).select("shot", F.round("prediction", 4).alias("prediction"))


@query("m11_permutation_loss")
def m11(s, d):
    return FP.permutation_loss(A.footprints(s, d), ["px", "py"], "rh100", numTrees=3, maxDepth=3)


@query("m12_parametric_models", """
WITH d AS (SELECT l_quantity AS x, l_extendedprice / 1000 AS v, count(*) OVER () AS n, avg(l_quantity) OVER () AS mx, avg(l_extendedprice / 1000) OVER () AS mv FROM lineitem WHERE l_quantity > 0 AND l_extendedprice > 0),
c AS (SELECT any_value(mx) AS mx, any_value(mv) AS mv, sum(pow(x - mx, 2)) AS s2, sum(pow(x - mx, 3)) AS s3, sum(pow(x - mx, 4)) AS s4, sum((x - mx) * (v - mv)) AS t1, sum(pow(x - mx, 2) * (v - mv)) AS t2, sum(pow(v - mv, 2)) AS vv, any_value(n) AS n FROM d),
k AS (SELECT *, s4 - s3 * s3 / s2 - s2 * s2 / n AS det FROM c), q AS (SELECT *, (t2 - s3 * t1 / s2) / det AS b2 FROM k), r AS (SELECT *, (t1 - b2 * s3) / s2 AS b1 FROM q)
SELECT 'linear' AS model, round(regr_intercept(v, x), 5) AS c0, round(regr_slope(v, x), 5) AS c1, CAST(0 AS DOUBLE) AS c2, round(regr_r2(v, x), 6) AS r2 FROM d
UNION ALL SELECT 'power', round(exp(regr_intercept(ln(v), ln(x))), 5), round(regr_slope(ln(v), ln(x)), 5), CAST(0 AS DOUBLE), round(regr_r2(ln(v), ln(x)), 6) FROM d
UNION ALL SELECT 'quadratic', round(mv - b2 * s2 / n - b1 * mx + b2 * mx * mx, 5), round(b1 - 2 * b2 * mx, 5), round(b2, 7), round((b1 * t1 + b2 * t2) / vv, 6) FROM r""")
def m12(s, d):
    df = A.table(s, d, "lineitem").select("l_quantity", (c("l_extendedprice") / 1000).alias("v"))
    return FP.parametric_fits(df, "l_quantity", "v").select("model", F.round("c0", 5).alias("c0"), F.round("c1", 5).alias("c1"), F.round("c2", 7).alias("c2"), F.round("r2", 6).alias("r2"))


@query("m11_group_refits")
def m11g(s, d):
    f = A.footprints(s, d).withColumns({"alt": c("px") * c("py"), "even": (c("shot") % 2).cast("double")})
    return FP.group_refits(f, {"place": ["px", "py"], "terrain": ["alt"], "other": ["even"]}, "rh100", numTrees=3, maxDepth=3)


@query("o4_feature_ranking")
def o4(s, d):
    from .more import m8

    return FP.feature_ranking(m8(s, d), ["px", "py"])


@query("t10_preferred_curve")
def t10(s, d):
    """Of the double logistic and the Fourier curve, the one with the better R2, by pixel and year."""
    return PH.preferred_curve(PH.both_fits(A.index(s, d, "NDVI")), ["y", "x", "year"])


@query("t13_index_fitness")
def t13(s, d):
    return PH.index_fitness(A.index(s, d, "NDVI"))


@query("n5_refine_levels", """
WITH bl AS (SELECT y, x, year(f.date) AS yr, min(level) FILTER (WHERE cls = 2) AS lo FROM flood f JOIN levels l ON f.date = l.date GROUP BY ALL), lv AS (SELECT y, x, round(avg(lo), 1) AS level FROM bl GROUP BY y, x HAVING avg(lo) IS NOT NULL),
st AS (SELECT a.y, a.x, any_value(a.level) AS level, CASE WHEN abs(a.y - 5) <= 1 THEN -1 WHEN count(b.level) < 8 OR max(b.level) > any_value(a.level) THEN 1 ELSE 0 END AS status FROM lv a LEFT JOIN lv b ON abs(a.y - b.y) <= 1 AND abs(a.x - b.x) <= 1 AND (a.y <> b.y OR a.x <> b.x) GROUP BY a.y, a.x),
nb AS (SELECT a.y, a.x, b.level, pow(a.y - b.y, 2) + pow(a.x - b.x, 2) AS d, b.level < a.level AS under, row_number() OVER (PARTITION BY a.y, a.x, b.level < a.level ORDER BY pow(a.y - b.y, 2) + pow(a.x - b.x, 2), b.y, b.x) AS k FROM st a JOIN lv b ON abs(a.y - b.y) <= 5 AND abs(a.x - b.x) <= 5 AND a.level <> b.level WHERE a.status = 0),
sm AS (SELECT y, x, round(sum(level / d) / sum(1 / d), 6) AS v FROM nb WHERE k <= 10 GROUP BY y, x HAVING count(*) FILTER (WHERE under) > 0 AND count(*) FILTER (WHERE NOT under) > 0)
SELECT y, x, status, coalesce(v, level) AS level FROM st LEFT JOIN sm USING (y, x)""")
def n5(s, d):
    lv = FL.boundary_levels(A.flood(s, d), A.levels(s, d)).groupBy("y", "x").agg(F.round(F.avg("min_wet"), 1).alias("level")).filter("level is not null")
    return I.refine_levels(lv, A.grid(s).filter("y = 5"))


@query("n12_complete_annual", """
WITH RECURSIVE wk AS (SELECT y, x, CAST(year(date) AS INT) * 100 + CAST(week(date) AS INT) AS year, max(cls) AS cls FROM flood GROUP BY ALL), yr AS (SELECT DISTINCT year FROM wk),
ce AS (SELECT dem.y, dem.x, yr.year, z, cls FROM dem CROSS JOIN yr LEFT JOIN wk ON wk.y = dem.y AND wk.x = dem.x AND wk.year = yr.year),
wt AS (SELECT y, x, year, z, year * CAST(1099511627776 AS BIGINT) + y * 1048576 + x AS id FROM ce WHERE cls = 2),
rg AS (SELECT y, x, year, id FROM wt UNION SELECT w.y, w.x, w.year, r.id FROM rg r JOIN wt w ON w.year = r.year AND abs(w.y - r.y) <= 1 AND abs(w.x - r.x) <= 1),
re AS (SELECT y, x, year, min(id) AS region FROM rg GROUP BY y, x, year), li AS (SELECT region, max(z) AS lid FROM re JOIN wt USING (y, x, year) GROUP BY region),
gr AS (SELECT c.y, c.x, c.year, r.region, c.z AS cost FROM re r JOIN li USING (region) JOIN ce c ON c.year = r.year AND c.cls IS NULL AND abs(c.y - r.y) <= 1 AND abs(c.x - r.x) <= 1 AND c.z <= lid
  UNION SELECT c.y, c.x, c.year, g.region, greatest(g.cost, c.z) FROM gr g JOIN li USING (region) JOIN ce c ON c.year = g.year AND c.cls IS NULL AND abs(c.y - g.y) <= 1 AND abs(c.x - g.x) <= 1 AND c.z <= lid),
de AS (SELECT y, x, year, region, min(cost) AS cost FROM gr GROUP BY y, x, year, region), me AS (SELECT d.region, min(d.cost) AS meets FROM de d JOIN re r ON r.year = d.year AND abs(r.y - d.y) <= 1 AND abs(r.x - d.x) <= 1 AND r.region <> d.region GROUP BY d.region)
SELECT y, x, year, 2 AS cls, region, FALSE AS completed FROM re UNION ALL SELECT y, x, year, 2, region, TRUE FROM de LEFT JOIN me USING (region) WHERE meets IS NULL OR cost < meets""")
def n12(s, d):
    """Maps of all weeks of the record; cells without a scene in a week have no data there."""
    f = A.flood(s, d).select("y", "x", (F.year("date") * 100 + F.weekofyear("date")).alias("year"), "cls")
    return I.complete_annual(f, A.dem(s))


@query("n13_repair_depressions")
def n13(s, d):
    """Lowest wet levels of each year against the record's wet levels; cells wet in over 40 % of all scenes are the water."""
    flood = A.flood(s, d)
    return I.repair_depressions(I.wet_levels(flood, A.levels(s, d)), FL.permanent_water(flood, 0.4))


@query("h9_refine_topography", """
WITH RECURSIVE w AS (SELECT y, x, f.date, level FROM flood f JOIN levels l ON f.date = l.date WHERE cls = 2),
r AS (SELECT y, x, date, level FROM w WHERE y = 5 UNION SELECT w.y, w.x, w.date, w.level FROM r JOIN w ON w.date = r.date AND abs(w.y - r.y) <= 1 AND abs(w.x - r.x) <= 1),
n AS (SELECT a.y, a.x, a.date, any_value(a.level) AS level, count(b.y) AS n FROM r a LEFT JOIN r b ON a.date = b.date AND abs(a.y - b.y) <= 1 AND abs(a.x - b.x) <= 1 AND (a.y <> b.y OR a.x <> b.x) GROUP BY a.y, a.x, a.date)
SELECT n.y, n.x, min(level) AS level, round(min(level) - any_value(z), 9) AS bias FROM n JOIN dem ON n.y = dem.y AND n.x = dem.x WHERE n < 8 GROUP BY n.y, n.x""")
def h9(s, d):
    wet = A.flood(s, d).filter(c("cls") == 2).join(A.levels(s, d), "date").select("y", "x", "date", "level")
    return I.refine_topography(wet, A.dem(s), A.grid(s).filter("y = 5"))


@query("h10_connected_inundation", """
WITH RECURSIVE w AS (SELECT y, x, date, level - z AS depth FROM dem JOIN levels ON level > z),
r AS (SELECT y, x, date FROM w WHERE y = 0 UNION SELECT w.y, w.x, w.date FROM r JOIN w ON w.date = r.date AND abs(w.y - r.y) <= 1 AND abs(w.x - r.x) <= 1)
SELECT y, x, year(date) AS year, count(*) AS duration, round(avg(depth), 5) AS mean_depth, round(max(depth), 9) AS max_depth FROM r JOIN w USING (y, x, date) GROUP BY ALL""")
def h10(s, d):
    return I.connected_inundation(A.dem(s), A.levels(s, d), A.grid(s).filter("y = 0"))


_SECT = f"""pr AS (SELECT CAST(p_partkey % 20 AS INT) AS cs, p_partkey // 20 % {4 * A.G} / CAST(4 AS DOUBLE) AS d, 10 + p_retailprice % 17 AS z FROM part),
sc AS (SELECT CAST(i AS INT) AS cs, CAST(i % {A.G} AS DOUBLE) AS ax, CAST(0 AS DOUBLE) AS ay, CAST(i * 7 % {A.G} AS DOUBLE) AS bx, CAST({A.G} AS DOUBLE) AS by FROM range(20) t(i)),
sp AS (SELECT cs, d, z, CAST(floor(round(ay + (sc.by - ay) * d / sqrt(pow(bx - ax, 2) + pow(sc.by - ay, 2)), 9)) AS INT) AS y, CAST(floor(round(ax + (bx - ax) * d / sqrt(pow(bx - ax, 2) + pow(sc.by - ay, 2)), 9)) AS INT) AS x FROM pr JOIN sc USING (cs))"""


@query("h11_section_comparison", f"WITH {_SECT} SELECT cs, count(*) AS n, round(avg(abs(dem.z - sp.z)), 6) AS mae, round(avg(dem.z - sp.z), 6) AS mean_error FROM sp JOIN dem USING (y, x) GROUP BY cs")
def h11(s, d):
    """Surveyed elevations against the terrain grid, sampled at the same distances along each section."""
    k = c("p_partkey")
    surveyed = A.table(s, d, "part").select((k % 20).cast("int").alias("cs"), (F.floor(k / 20) % (4 * A.G) / 4).alias("d"), (10 + c("p_retailprice") % 17).alias("z"))
    i = c("id")
    sections = s.range(20).select(i.cast("int").alias("cs"), (i % A.G).cast("double").alias("ax"), F.lit(0.0).alias("ay"), (i * 7 % A.G).cast("double").alias("bx"), F.lit(float(A.G)).alias("by"))
    g = S.goodness_of_fit(H.sample_profile(surveyed, sections, A.dem(s)), "z", "z_grid", ["cs"])
    return g.select("cs", "n", F.round("mae", 6).alias("mae"), F.round("mean_error", 6).alias("mean_error"))


@query("h17_along_line", f"""
WITH ln AS (SELECT CAST(s_nationkey % 5 AS INT) AS cs, s_suppkey AS seq, s_suppkey * 7 % {A.G} + CAST(0.3 AS DOUBLE) AS x, s_suppkey * 3 % {A.G} + CAST(0.6 AS DOUBLE) AS y FROM supplier),
k AS (SELECT *, lead(x) OVER w - x AS dx, lead(y) OVER w - y AS dy FROM ln WINDOW w AS (PARTITION BY cs ORDER BY seq)), u AS (SELECT cs, seq, x, y, round(dx / nullif(sqrt(dx * dx + dy * dy), 0), 9) AS ux, round(dy / nullif(sqrt(dx * dx + dy * dy), 0), 9) AS uy FROM k WHERE dx IS NOT NULL),
p AS (SELECT cs, seq AS station, CAST(o AS INT) AS "offset", CAST(floor(round(y + ux * o * CAST(0.5 AS DOUBLE), 6)) AS INT) AS y, CAST(floor(round(x - uy * o * CAST(0.5 AS DOUBLE), 6)) AS INT) AS x FROM u, range(-3, 4) t(o)),
m AS (SELECT y, x, round(avg(value), 9) AS value FROM ndvi GROUP BY y, x) SELECT cs, station, "offset", value FROM p LEFT JOIN m USING (y, x)""")
def h17g(s, d):
    k = c("s_suppkey")
    line = A.table(s, d, "supplier").select((c("s_nationkey") % 5).cast("int").alias("cs"), k.alias("seq"), (k * 7 % A.G + 0.3).alias("x"), (k * 3 % A.G + 0.6).alias("y"))
    return H.along_line(line, ["cs"], A.index(s, d, "NDVI").groupBy("y", "x").agg(F.round(F.avg("value"), 9).alias("value")), 3, 0.5)


@query("h15_simulated_shots", "SELECT y, x, CAST(y * 10 + x AS BIGINT) AS shot, x + CAST(0.5 AS DOUBLE) AS px, y + CAST(0.5 AS DOUBLE) AS py, first(date ORDER BY value DESC, date) AS date FROM roi LEFT JOIN ndvi USING (y, x) GROUP BY y, x")
def h15(s, d):
    """Every cell of the region as a shot at its peak date."""
    peak = A.index(s, d, "NDVI").groupBy("y", "x").agg(F.max_by("date", F.struct("value", -F.unix_date("date"))).alias("date"))
    py, px = (v for v in reversed(P.centre_of(c("y"), c("x"))))
    return A.roi(s).join(peak, ["y", "x"], "left").select("y", "x", (c("y") * 10 + c("x")).cast("long").alias("shot"), px.alias("px"), py.alias("py"), "date")


@query("h18_single_sensor_duration", """
WITH f AS (SELECT y, x, date, CASE WHEN green >= swir THEN 2 ELSE 1 END AS cls FROM bands WHERE sensor = 'A'), b AS (SELECT y, x, year(f.date) AS year, min(level) AS low FROM f JOIN levels l ON f.date = l.date WHERE cls = 2 GROUP BY ALL)
SELECT y, x, b.year, CAST(count(*) AS BIGINT) AS duration, round(max(level - low), 9) AS max_height, round(avg(level - low), 9) AS mean_depth FROM b JOIN levels l ON year(l.date) = b.year AND level >= low GROUP BY ALL""")
def h18(s, d):
    f = A.bands(s, d).filter("sensor = 'A'").select("y", "x", "date", F.when(c("green") >= c("swir"), 2).otherwise(1).alias("cls"))
    return FL.inundation_indicators(f, A.levels(s, d))


@query("h3_station_points", "SELECT station, date, CAST(round(level * 10) AS INT) AS temp FROM gauge")
def h3(s, d):
    return A.gauge(s, d).select("station", "date", F.round(c("level") * 10).cast("int").alias("temp"))


@query("h4_climate_cube", "SELECT var, CAST(strftime(date, '%Y%m') AS INT) AS ym, count(*) AS n FROM (SELECT event_type AS var, CAST(ts AS DATE) AS date FROM events GROUP BY 1, 2) GROUP BY ALL")
def h4(s, d):
    """Gridded climate by variable and month: written by partition and counted from what was written."""
    from ..session import new_path

    day = A.weather(s, d).groupBy("var", F.to_date("ts").alias("date")).agg(F.avg("value").alias("value")).withColumn("ym", F.year("date") * 100 + F.month("date"))
    path = new_path(s, "climate")
    day.write.partitionBy("var", "ym").parquet(path)
    return s.read.parquet(path).groupBy("var", "ym").agg(F.count(F.lit(1)).alias("n"))


@query("h16_waveform_metrics", f"WITH {_CP} SELECT y, x, max(v) FILTER (WHERE t = 100) AS t100, max(v) FILTER (WHERE t = 200) AS t200 FROM cv WHERE t IN (100, 200) GROUP BY y, x")
def h16(s, d):
    """Long metric rows to wide columns."""
    e = PH.expand(curve_parameters(s, d)).filter(c("t").isin(100, 200)).select("y", "x", F.concat(F.lit("t"), c("t").cast("string")).alias("metric"), "v")
    return e.groupBy("y", "x").pivot("metric", ["t100", "t200"]).agg(F.max("v"))


@query("k3_csv_round_trip", "SELECT station, count(*) AS n FROM gauge GROUP BY station")
def k3(s, d):
    from ..session import new_path
    from ..sources.tables import save_csv

    path = new_path(s, "csv")
    save_csv(A.gauge(s, d), path)
    return s.read.csv(path, header=True, schema="station int, date date, flow double, sed_conc double, level double").groupBy("station").agg(F.count(F.lit(1)).alias("n"))


_E2 = 0.00669437999014


def _utm_sql() -> str:
    """The sixth-order series of ``utm`` in SQL (zone 49)."""
    e2, ep2, d = _E2, _E2 / (1 - _E2), lambda v: f"CAST({v!r} AS DOUBLE)"
    m = f"(6378137 * ({d(1 - e2 / 4 - 3 * e2**2 / 64 - 5 * e2**3 / 256)} * p - {d(3 * e2 / 8 + 3 * e2**2 / 32 + 45 * e2**3 / 1024)} * sin(2 * p) + {d(15 * e2**2 / 256 + 45 * e2**3 / 1024)} * sin(4 * p) - {d(35 * e2**3 / 3072)} * sin(6 * p)))"
    return f"""WITH f AS (SELECT shot, radians(py + 25) AS p, radians(px + 110 - 111) AS lam FROM footprints),
g AS (SELECT shot, p, 6378137 / sqrt(1 - {d(e2)} * pow(sin(p), 2)) AS nu, pow(tan(p), 2) AS t, {d(ep2)} * pow(cos(p), 2) AS c, cos(p) * lam AS b FROM f)
SELECT shot, round(500000 + {d(0.9996)} * nu * (b + (1 - t + c) * pow(b, 3) / 6 + (5 - 18 * t + t * t + 72 * c - {d(58 * ep2)}) * pow(b, 5) / 120), 2) AS east,
 round({d(0.9996)} * ({m} + nu * tan(p) * (b * b / 2 + (5 - t + 9 * c + 4 * c * c) * pow(b, 4) / 24 + (61 - 58 * t + t * t + 600 * c - {d(330 * ep2)}) * pow(b, 6) / 720)), 2) AS north FROM g"""


@query("v28_projection", _utm_sql())
def v28(s, d):
    f = A.footprints(s, d).select("shot", (c("px") + 110).alias("lon"), (c("py") + 25).alias("lat"))
    e, n = P.utm(c("lon"), c("lat"), 49)
    return f.select("shot", F.round(e, 2).alias("east"), F.round(n, 2).alias("north")).orderBy("east", F.desc("north"))


@query("j20_window_mean", """
WITH m AS (SELECT y, x, round(max(value), 6) AS value FROM ndvi JOIN roi USING (y, x) GROUP BY y, x), p AS (SELECT CAST(s_suppkey AS INT) AS id, CAST(s_suppkey % 10 AS INT) AS y, CAST(s_suppkey // 10 % 10 AS INT) AS x FROM supplier)
SELECT id, p.y, p.x, round(avg(value), 9) AS value, count(value) AS n FROM p LEFT JOIN m ON abs(m.y - p.y) <= 2 AND abs(m.x - p.x) <= 2 GROUP BY ALL""")
def j20(s, d):
    from ..operators.grid import window_mean

    p = A.table(s, d, "supplier").select(c("s_suppkey").cast("int").alias("id"), (c("s_suppkey") % 10).cast("int").alias("y"), (F.floor(c("s_suppkey") / 10) % 10).cast("int").alias("x"))
    return window_mean(region_max(s, d), p, [], 2)


@query("a18_phase_max", """
WITH ph AS (SELECT DISTINCT y, x, year(date) AS year, 100 + y * 3 AS start, 200 + x * 5 AS "end" FROM ndvi) SELECT y, x, year, round(max(value) FILTER (WHERE dayofyear(date) >= start AND dayofyear(date) < "end"), 9) AS value, count(value) FILTER (WHERE dayofyear(date) >= start AND dayofyear(date) < "end") AS n FROM ndvi JOIN ph USING (y, x) WHERE year(date) = year GROUP BY y, x, year""")
def a18m(s, d):
    from .core import phases

    return T.within_phases(A.index(s, d, "NDVI"), phases(s, d), ["y", "x"], "max")


@query("x3_daily_stream", "SELECT user_id AS station, CAST(ts AS DATE) AS date, round(sum(value), 4) AS total FROM events WHERE CAST(ts AS DATE) < CAST((SELECT max(ts) FROM events) - INTERVAL 2 DAY AS DATE) GROUP BY ALL")
def x3(s, d):
    """The streaming daily aggregate over the events as a file stream: days that the watermark has closed."""
    from ..session import new_path
    from ..streaming import streams

    src = A.table(s, d, "events").select(c("user_id").alias("station"), c("ts").cast("timestamp").alias("ts"), "value")
    path = new_path(s, "stream")
    src.write.parquet(f"{path}/in")
    stream = s.readStream.schema("station bigint, ts timestamp, value double").parquet(f"{path}/in")
    q = streams.daily(stream).writeStream.format("parquet").option("path", f"{path}/out").option("checkpointLocation", f"{path}/cp").outputMode("append").trigger(availableNow=True).start()
    q.awaitTermination()
    return s.read.schema("station bigint, date date, vmean double, vmax double, vmin double, total double, first_half double, last_half double").parquet(f"{path}/out").select("station", "date", F.round("total", 4).alias("total"))


# --- file readers and cube storage, on files that are written from the tables ----------------------------------------


@query("s7_daily_station_csvs", "SELECT station, year(date) AS year, count(*) AS n, count(CASE WHEN year(date) % 2 = 0 THEN flow END) AS n_flow, count(CASE WHEN year(date) % 2 = 1 THEN level END) AS n_level FROM gauge GROUP BY ALL")
def s7(s, d):
    """Yearly files, of which the even ones have a flow and the odd ones a level."""
    from ..session import new_path
    from ..sources import tables as TB

    g, path = A.gauge(s, d).withColumn("odd", F.year("date") % 2), new_path(s, "stations")
    for odd, col in ((0, "flow"), (1, "level")):
        TB.save_csv(g.filter(c("odd") == odd).select("station", "date", col), f"{path}/{odd}")
    t = TB.daily_station_csvs(s, [f"{path}/0", f"{path}/1"])
    return t.groupBy(c("station").cast("int").alias("station"), F.year(c("date").cast("date")).alias("year")).agg(F.count(F.lit(1)).alias("n"), F.count("flow").alias("n_flow"), F.count("level").alias("n_level"))


@query("s8_gauge_files", "SELECT CAST(station AS VARCHAR) AS station, date, round(flow, 6) AS flow, round(level, 6) AS level FROM gauge")
def s8(s, d):
    """A header line for each station and year, daily lines below it."""
    from ..session import new_path
    from ..sources import tables as TB

    path = new_path(s, "gauges")
    line = F.concat_ws(",", F.month("date"), F.dayofmonth("date"), *[F.format_string("%.6f", k) for k in ("flow", "sed_conc", "level")])
    b = A.gauge(s, d).groupBy("station", F.year("date").alias("year")).agg(F.array_sort(F.collect_list(F.struct("date", line.alias("line")))).alias("l"))
    b.select(F.concat_ws("\n", F.concat(F.lit("#"), c("station").cast("string"), F.lit(","), c("year").cast("string")), F.transform("l", lambda e: e["line"])).alias("value")).write.text(path)
    return TB.gauge_files(s, path).select("station", "date", F.round("flow", 6).alias("flow"), F.round("level", 6).alias("level"))


@query("s10_footprint_tables", "SELECT shot, round(rh100, 6) AS rh100, quality FROM footprints")
def s10(s, d):
    from ..session import new_path
    from ..sources import tables as TB

    f, path = A.footprints(s, d), new_path(s, "footprints")
    TB.save_csv(f.select("shot", F.round("rh100", 6).alias("rh100")), f"{path}/a")
    TB.save_csv(f.select("shot", "quality"), f"{path}/b")
    t = TB.footprint_tables(s, [f"{path}/a", f"{path}/b"], ["shot", "rh100", "quality"])
    return t.select(c("shot").cast("bigint").alias("shot"), c("rh100").cast("double").alias("rh100"), c("quality").cast("int").alias("quality"))


@query("s11_section_files", "SELECT CAST(p_partkey % 20 AS VARCHAR) AS cs, CAST(p_partkey // 20 AS DOUBLE) AS d, round(p_retailprice % 37, 3) AS z FROM part")
def s11(s, d):
    """A header line for each section, points below it."""
    from ..session import new_path
    from ..sources import tables as TB
    from .more import profiles

    path = new_path(s, "sections")
    line = F.concat_ws(",", c("d").cast("string"), F.round("z", 3).cast("string"))
    b = profiles(s, d).groupBy("cs").agg(F.array_sort(F.collect_list(F.struct("d", line.alias("line")))).alias("l"))
    b.select(F.concat_ws("\n", F.concat(F.lit("name,"), c("cs").cast("string")), F.transform("l", lambda e: e["line"])).alias("value")).write.text(path)
    return TB.section_files(s, path).select("cs", "d", "z")


@query("k2_keep_existing", "SELECT idx, year(date) AS year, count(*) AS n, round(sum(CASE WHEN idx = 'NDVI' THEN value + 1 ELSE value END), 6) AS total FROM obs GROUP BY ALL")
def k2(s, d):
    """Saved again without overwriting, years that are there stay; then one index is overwritten."""
    from ..session import new_path
    from ..sources import tables as TB

    path, o = new_path(s, "cube"), A.obs(s, d)
    more = o.withColumn("value", c("value") + 1)
    TB.save_cube(o, path)
    TB.save_cube(more, path)
    TB.save_cube(more.filter("idx = 'NDVI'"), path, overwrite=True)
    return TB.load_cube(s, path).groupBy("idx", F.year("date").alias("year")).agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("value"), 6).alias("total"))


@query("m6_feature_groups", "SELECT y, x, round(avg(value) FILTER (WHERE idx = 'NDVI'), 9) AS NDVI_MEAN, round(avg(value) FILTER (WHERE idx = 'MNDWI'), 9) AS MNDWI_MEAN FROM obs GROUP BY y, x")
def m6(s, d):
    """The spectral columns of a feature table, found by their names."""
    v, i = c("value"), c("idx")
    t = A.obs(s, d).groupBy("y", "x").agg(
        F.round(F.avg(F.when(i == "NDVI", v)), 9).alias("NDVI_MEAN"), F.round(F.avg(F.when(i == "MNDWI", v)), 9).alias("MNDWI_MEAN"),
        F.max_by(F.dayofyear("date"), F.when(i == "NDVI", v)).alias("PEAK_DAY"), F.count_if((i == "MNDWI") & (v >= 0.1)).alias("FLOOD_DAYS"),
    )
    return t.select("y", "x", *FP.feature_groups([k for k in t.columns if k not in ("y", "x")], 1))
