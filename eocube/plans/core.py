"""Queries: indices, masks, composites, floods, time series."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import dates, text
from ..operators import composite as C
from ..operators import flood as FL
from ..operators import projection as P
from ..operators import temporal as T
from ..sources import adapters as A
from .base import query

c = F.col

# --- projections and predicates -------------------------------------------------------------------------------------


@query("v1_spectral_indices", """
WITH m AS (SELECT *, (blue + green + red + nir + swir + swir2) / 6 AS m6, (nir + swir + swir2) / 3 AS m3 FROM bands)
SELECT y, x, date, round((nir - red) / nullif(nir + red, 0), 10) AS NDVI, round(CAST(1.16 AS DOUBLE) * (nir - red) / nullif(nir + red + CAST(0.16 AS DOUBLE), 0), 10) AS OSAVI,
 round(4 * (green - swir) - (CAST(0.25 AS DOUBLE) * nir + CAST(2.75 AS DOUBLE) * swir2), 10) AS AWEI, round(blue + CAST(2.5 AS DOUBLE) * green - CAST(1.5 AS DOUBLE) * (nir + swir) - CAST(0.25 AS DOUBLE) * swir2, 10) AS AWEInsh,
 round((green - swir) / nullif(green + swir, 0), 10) AS MNDWI, round(CAST(2.5 AS DOUBLE) * (nir - red) / nullif(nir + 6 * red - CAST(7.5 AS DOUBLE) * blue + 1, 0), 10) AS EVI,
 round(CAST(2.5 AS DOUBLE) * (nir - red) / nullif(nir + CAST(2.4 AS DOUBLE) * red + 1, 0), 10) AS EVI2,
 round(sqrt((pow(blue - m6, 2) + pow(green - m6, 2) + pow(red - m6, 2) + pow(nir - m6, 2) + pow(swir - m6, 2) + pow(swir2 - m6, 2)) / 6) - sqrt((pow(nir - m3, 2) + pow(swir - m3, 2) + pow(swir2 - m3, 2)) / 3), 10) AS SVVI,
 round(CAST(-0.1603 AS DOUBLE) * blue - CAST(0.2819 AS DOUBLE) * green - CAST(0.4934 AS DOUBLE) * red + CAST(0.7940 AS DOUBLE) * nir - CAST(0.0002 AS DOUBLE) * swir - CAST(0.1446 AS DOUBLE) * swir2, 10) AS TCGREENESS FROM m""")
def v1(s, d):
    n = ["NDVI", "OSAVI", "AWEI", "AWEInsh", "MNDWI", "EVI", "EVI2", "SVVI", "TCGREENESS"]
    return P.spectral_indices(A.bands(s, d), n, 10).select("y", "x", "date", *n)


@query("v2_green_indices", """SELECT y, x, date, round((nir - green) / nullif(nir + green, 0), 10) AS GNDVI, round((green - nir) / nullif(green + nir, 0), 10) AS NDWI,
 round((nir20 - red) / nullif(nir20 + red, 0), 10) AS NDVI_20m, round(CAST(1.16 AS DOUBLE) * (nir20 - red) / nullif(nir20 + red + CAST(0.16 AS DOUBLE), 0), 10) AS OSAVI_20m,
 round((re3 - re1) / nullif(re3 + re1, 0), 10) AS NDVI_RE, round((nir - re1) / nullif(nir + re1, 0), 10) AS NDVI_RE2, round(CAST(1.5 AS DOUBLE) * (nir - red) / nullif(nir + red + CAST(0.5 AS DOUBLE), 0), 10) AS IEI FROM edged""")
def v2(s, d):
    n = ["GNDVI", "NDWI", "NDVI_20m", "OSAVI_20m", "NDVI_RE", "NDVI_RE2", "IEI"]
    return P.spectral_indices(A.red_edge(A.bands(s, d)), n, 10).select("y", "x", "date", *n)


@query("v3_user_index", "SELECT y, x, date, round((green - red) / nullif(green + red + blue, 0) * 2, 6) AS MYIDX FROM bands")
def v3(s, d):
    b = P.user_index(A.bands(s, d), "MYIDX = (green - red) / nullif(green + red + blue, 0) * 2")
    return b.select("y", "x", "date", F.round("MYIDX", 6).alias("MYIDX"))


@query("v4_v5_decode_encode", """
WITH e AS (SELECT y, x, date, coalesce(CAST(round(round((nir - red) / nullif(nir + red, 0), 6) * 10000) AS INT), -32768) AS stored FROM bands)
SELECT y, x, date, stored, round(CASE WHEN stored <> -32768 THEN stored / CAST(10000 AS DOUBLE) END, 6) AS value FROM e""")
def v45(s, d):
    e = P.spectral_indices(A.bands(s, d), ["NDVI"]).select("y", "x", "date", P.encode(c("NDVI")).alias("stored"))
    return e.withColumn("value", F.round(P.decode(c("stored"), -32768), 6))


@query("v6_reflectance_scaling", """
SELECT scene_id, qa, round(CASE WHEN qa BETWEEN 7273 AND 43636 THEN qa * CAST(0.0000275 AS DOUBLE) - CAST(0.2 AS DOUBLE) END, 7) AS reflectance,
 round(CASE WHEN qa BETWEEN 293 AND 61440 THEN qa * CAST(0.00341802 AS DOUBLE) + 149 - CAST(273.15 AS DOUBLE) END, 8) AS celsius FROM raw_bands""")
def v6(s, d):
    return A.raw_bands(s, d).select("scene_id", "qa", F.round(P.surface_reflectance(c("qa")), 7).alias("reflectance"), F.round(P.surface_temperature(c("qa")), 8).alias("celsius"))


@query("v7_harmonise", """
SELECT scene_id, sensor, round(CASE sensor WHEN 'A' THEN green * CAST(0.98 AS DOUBLE) + CAST(0.01 AS DOUBLE) ELSE green END, 6) AS green,
 round(CASE sensor WHEN 'A' THEN nir * CAST(1.02 AS DOUBLE) - CAST(0.02 AS DOUBLE) WHEN 'R' THEN nir * CAST(0.99 AS DOUBLE) ELSE nir END, 6) AS nir FROM raw_bands""")
def v7(s, d):
    k = s.createDataFrame([("A", "green", 0.98, 0.01), ("A", "nir", 1.02, -0.02), ("R", "nir", 0.99, 0.0)], "sensor string, band string, slope double, offset double")
    return P.harmonise(A.raw_bands(s, d), k, ["green", "nir"]).select("scene_id", "sensor", F.round("green", 6).alias("green"), F.round("nir", 6).alias("nir"))


@query("v8_band_numbers", "SELECT sensor, count(*) AS n, CASE WHEN sensor = 'A' THEN 5 ELSE 4 END AS nir_band FROM raw_bands GROUP BY sensor")
def v8(s, d):
    family = F.when(c("sensor") == "A", "newer").otherwise("older")
    return A.raw_bands(s, d).groupBy("sensor").agg(F.count(F.lit(1)).alias("n"), F.first(P.band_number(family, F.lit("nir"))).alias("nir_band"))


@query("v9_v10_quality_mask", """
SELECT sensor, count(*) FILTER (WHERE qa < 22000 AND qa % 128 IN (0, 2, 64, 66)) AS n_clear, count(*) FILTER (WHERE qa % 256 // 128 = 1) AS n_water, count(*) AS n FROM raw_bands GROUP BY sensor""")
def v9(s, d):
    return A.raw_bands(s, d).groupBy("sensor").agg(F.count_if(P.clear_by_qa(c("qa"))).alias("n_clear"), F.count_if(P.water_by_qa(c("qa"))).alias("n_water"), F.count(F.lit(1)).alias("n"))


_CODES = [21824, 22080, 21952, 22208, 5440, 5696, 5760, 23888, 1, 5504, 22018]

_QA = f"""q AS (SELECT y, x, date, CASE sensor WHEN 'A' THEN 'LC08' WHEN 'N' THEN 'LE07' ELSE 'LT05' END AS sensor, [{", ".join(map(str, _CODES))}][qa % {len(_CODES)} + 1] AS qa FROM bands),
k AS (SELECT *, qa = 1 OR qa // 256 > CASE sensor WHEN 'LC08' THEN 86 ELSE 21 END AS cloud FROM q),
m AS (SELECT a.y, a.x, a.date, any_value(a.sensor) AS sensor, any_value(a.qa) AS qa, any_value(a.cloud) AS cloud, count(*) FILTER (WHERE b.cloud AND (a.y <> b.y OR a.x <> b.x)) AS near FROM k a JOIN k b ON a.date = b.date AND a.sensor = b.sensor AND abs(a.y - b.y) <= 3 AND abs(a.x - b.x) <= 3 GROUP BY a.y, a.x, a.date)"""


@query("v9_dilated_quality_mask", f"WITH {_QA} SELECT y, x, date, sensor, qa, NOT cloud AND NOT (near > 3 AND CASE sensor WHEN 'LC08' THEN qa IN (22080, 22208) ELSE qa IN (5696, 5760) END) AND qa % 128 IN (0, 2, 64, 66) AS clear FROM m")
def v9d(s, d):
    """Quality words of each date and sensor, with the sensor's cutoffs and doubtful words near clouds."""
    word = F.element_at(F.array(*map(F.lit, _CODES)), c("qa") % len(_CODES) + 1)
    sensor = F.when(c("sensor") == "A", "LC08").when(c("sensor") == "N", "LE07").otherwise("LT05")
    q = A.bands(s, d).select("y", "x", "date", sensor.alias("sensor"), word.alias("qa"))
    return P.quality_mask(q, ["date", "sensor"]).select("y", "x", "date", "sensor", "qa", "clear")


@query("v11_scene_class_mask", "SELECT y, x, date, CASE WHEN qa % 12 NOT IN (0, 1, 2, 3, 8, 9, 10, 11, 255) THEN round(nir, 6) END AS nir FROM bands")
def v11(s, d):
    return A.bands(s, d).select("y", "x", "date", P.mask_scene_classes(F.round("nir", 6), c("qa") % 12).alias("nir"))


@query("v12_threshold_grammar", "SELECT date, CAST(900 * count(*) FILTER (WHERE value >= CAST(0.1 AS DOUBLE)) AS DOUBLE) AS area FROM mndwi GROUP BY date")
def v12(s, d):
    return C.area_by(A.index(s, d, "MNDWI"), P.threshold("value", "gte0.1"))


@query("v13_region_mask", "SELECT date, count(*) AS n FROM mndwi JOIN roi USING (y, x) GROUP BY date")
def v13(s, d):
    return P.within_roi(A.index(s, d, "MNDWI"), A.roi(s)).groupBy("date").agg(F.count(F.lit(1)).alias("n"))


@query("v14_cube_slice", "SELECT y, x, date, value FROM ndvi WHERE y BETWEEN 2 AND 5 AND x BETWEEN 1 AND 7 AND date BETWEEN DATE '1996-01-01' AND DATE '1997-12-31'")
def v14(s, d):
    return P.cube_slice(A.index(s, d, "NDVI"), (2, 5), (1, 7), ("1996-01-01", "1997-12-31"))


@query("v16_drop_empty_layers", """
WITH m AS (SELECT y, x, date, CASE WHEN day(date) % 2 = 0 THEN value END AS value FROM mndwi) SELECT y, x, date, value FROM m WHERE date IN (SELECT date FROM m GROUP BY date HAVING count(value) > 0)""")
def v16(s, d):
    return P.drop_empty_layers(A.index(s, d, "MNDWI").withColumn("value", F.when(F.dayofmonth("date") % 2 == 0, c("value"))))


@query("v17_v18_point_value", """
WITH f AS (SELECT shot, CAST(floor(py) AS INT) + dy AS y, CAST(floor(px) AS INT) + dx AS x FROM footprints, range(-1, 2) a(dy), range(-1, 2) b(dx)),
m AS (SELECT y, x, year(date) AS year, sum(value) AS v, count(value) AS n FROM mndwi GROUP BY ALL)
SELECT shot, year, round(sum(v) / sum(n), 9) AS value, CAST(sum(n) AS BIGINT) AS n FROM f JOIN m USING (y, x) GROUP BY shot, year""")
def v18(s, d):
    """Mean of the 3x3 window around each shot, by year: cells are summed by year before they meet the shots."""
    from ..operators.footprints import weighted_cells

    w = weighted_cells(A.footprints(s, d).select("shot", "px", "py"), "focal")
    m = A.index(s, d, "MNDWI").groupBy("y", "x", F.year("date").alias("year")).agg(F.sum("value").alias("v"), F.count("value").alias("n"))
    return w.join(m, ["y", "x"]).groupBy("shot", "year").agg(F.round(F.sum("v") / F.sum("n"), 9).alias("value"), F.sum("n").alias("n"))


@query("v19_v21_point_in_ring", """
SELECT shot, rh100 FROM footprints WHERE quality <> 0 AND py BETWEEN 1 AND 9 AND
 (CAST((1 > py) <> (8 > py) AND px < (8 - 8) * (py - 1) / CAST(8 - 1 AS DOUBLE) + 8 AS INT) + CAST((8 > py) <> (1 > py) AND px < (1 - 4) * (py - 8) / CAST(1 - 8 AS DOUBLE) + 4 AS INT)) % 2 = 1""")
def v19(s, d):
    from ..operators.footprints import good_shots

    return good_shots(A.footprints(s, d), 1, 9, [(1.0, 1.0), (8.0, 1.0), (8.0, 8.0), (4.0, 8.0)]).select("shot", "rh100")


@query("v20_shot_quality", "SELECT shot, date, rh100 FROM footprints WHERE quality <> 0 AND date IS NOT NULL AND rh100 IS NOT NULL")
def v20(s, d):
    from ..operators.footprints import good_shots

    return good_shots(A.footprints(s, d), -90, 90).select("shot", "date", "rh100")


@query("v22_radiation_clean", "SELECT station, count(*) FILTER (WHERE value - 20 >= 0) AS n_valid, count(*) AS n FROM weather GROUP BY station")
def v22(s, d):
    clean = F.when(c("value") - 20 >= 0, c("value"))
    return A.weather(s, d).groupBy("station").agg(F.count(clean).alias("n_valid"), F.count(F.lit(1)).alias("n"))


@query("v23_normalise", "SELECT shot, round(ln(1 + nullif(rh100, 0)), 6) AS rh100, round(px / (SELECT max(abs(px)) FROM footprints), 6) AS px FROM footprints")
def v23(s, d):
    return P.normalise_features(A.footprints(s, d), ["rh100"], ["px"]).select("shot", F.round("rh100", 6).alias("rh100"), F.round("px", 6).alias("px"))


@query("v24_biomass", "SELECT station, date, round(CASE WHEN level >= 15 THEN CAST(0.33 AS DOUBLE) * CAST(0.65 AS DOUBLE) * flow / 1000 * pow(CAST(1.09 AS DOUBLE), level - 15) END, 5) AS biomass FROM gauge")
def v24(s, d):
    return A.gauge(s, d).select("station", "date", F.round(P.biomass(c("level"), c("flow") / 1000), 5).alias("biomass"))


@query("v25_band_simulation", """
WITH r AS (SELECT 'wide' AS band, CAST(w AS INT) AS wavelength, CAST(1 AS DOUBLE) AS weight FROM range(1, 8) t(w) UNION ALL SELECT 'narrow', CAST(w AS INT), w / CAST(10 AS DOUBLE) FROM range(2, 5) t(w)),
sp AS (SELECT l_orderkey AS sample, l_linenumber AS wavelength, l_quantity AS value FROM lineitem)
SELECT sample, band, round(sum(value * weight) / nullif(sum(weight), 0), 6) AS value FROM sp JOIN r USING (wavelength) GROUP BY sample, band""")
def v25(s, d):
    r = s.createDataFrame([("wide", w, 1.0) for w in range(1, 8)] + [("narrow", w, w / 10) for w in range(2, 5)], "band string, wavelength int, weight double")
    sp = A.table(s, d, "lineitem").select(c("l_orderkey").alias("sample"), c("l_linenumber").alias("wavelength"), c("l_quantity").alias("value"))
    return P.band_simulation(sp, r).select("sample", "band", F.round("value", 6).alias("value"))


@query("v26_water_quality", """SELECT y, x, date, round(re2 * (1 / nullif(red, 0) - 1 / nullif(re1, 0)), 8) AS d05, round(nir / nullif(red, 0), 9) AS nir_red, round(blue / nullif(green, 0), 9) AS blue_green,
 round((nir - red) / nullif(nir + red, 0), 10) AS ndci, round(nir - (red + swir) / 2, 10) AS flh FROM edged""")
def v26(s, d):
    n = {"d05": 8, "nir_red": 9, "blue_green": 9, "ndci": 10, "flh": 10}
    return P.water_quality(A.red_edge(A.bands(s, d))).select("y", "x", "date", *[F.round(x, k).alias(x) for x, k in n.items()])


@query("v27_threshold_sweep", """
SELECT round(CAST(-0.4 AS DOUBLE) + k * CAST(0.01 AS DOUBLE), 6) AS threshold, count(*) FILTER (WHERE floor(round((value + CAST(0.4 AS DOUBLE)) / CAST(0.01 AS DOUBLE), 9)) >= k) AS n_over FROM mndwi, range(50) t(k) GROUP BY k""")
def v27(s, d):
    return P.threshold_sweep(A.index(s, d, "MNDWI"), "value", -0.4, 0.01, 50)


@query("functions_dates", """
SELECT DISTINCT date, year(date) * 1000 + dayofyear(date) AS doy_code, year(date) * 10000 + month(date) * 100 + day(date) AS day_code, date AS from_doy, date AS from_day, month(date) BETWEEN 5 AND 10 AS wet, round(datediff('day', DATE '1990-01-01', date) / CAST(365.25 AS DOUBLE), 6) AS years FROM mndwi""")
def fdates(s, d):
    x = A.index(s, d, "MNDWI").select("date").distinct()
    x = x.withColumns({"doy_code": dates.doy_code(c("date")), "day_code": dates.day_code(c("date"))})
    return x.select("*", dates.from_doy_code(c("doy_code")).alias("from_doy"), dates.from_day_code(c("day_code")).alias("from_day"), dates.is_wet_season(c("date")).alias("wet"), F.round(dates.years_since(c("date"), "1990-01-01"), 6).alias("years"))


@query("functions_text", """
SELECT p_partkey, p_brand, TRY_CAST(split_part(p_brand, '#', 2) AS DOUBLE) IS NOT NULL AS number, contains(p_name, 'red') OR contains(p_name, 'blue') AS coloured, round(sign(p_size) * (floor(p_retailprice / 100) + (p_retailprice % 100) / 60), 6) AS degrees FROM part""")
def ftext(s, d):
    p = A.table(s, d, "part")
    return p.select("p_partkey", "p_brand", text.is_number(F.split("p_brand", "#")[1]).alias("number"), text.has_words(c("p_name"), any_of=("red", "blue")).alias("coloured"), F.round(text.ddmm_to_degrees(c("p_retailprice")), 6).alias("degrees"))


# --- aggregations ---------------------------------------------------------------------------------------------------


@query("a1_cube_sum", "SELECT y, date, round(sum(value), 9) AS value FROM mndwi GROUP BY y, date")
def a1(s, d):
    return C.cube_sum(A.index(s, d, "MNDWI"), "x")


@query("a2_monthly_composite", "SELECT y, x, year(date) * 100 + month(date) AS period, round(avg(value), 9) AS value FROM mndwi GROUP BY ALL")
def a2(s, d):
    return C.composite(A.index(s, d, "MNDWI"), "month", "mean")


@query("a2_first_by_year", "SELECT y, x, year(date) AS period, first(value ORDER BY date) AS value FROM ndvi GROUP BY ALL")
def a2f(s, d):
    return C.composite(A.index(s, d, "NDVI"), "year", "first")


@query("a2_max_by_season", "SELECT y, x, year(date) * 10 + CASE WHEN month(date) BETWEEN 5 AND 10 THEN 1 ELSE 0 END AS period, max(value) AS value FROM ndvi GROUP BY ALL")
def a2s(s, d):
    return C.composite(A.index(s, d, "NDVI"), "season", "max")


@query("a3_wetness_order", """
WITH w AS (SELECT date, count(*) FILTER (WHERE cls = 1) AS dry, count(*) FILTER (WHERE cls = 2) AS wet FROM flood GROUP BY date),
r AS (SELECT date, round(dry / nullif(CAST(wet AS DOUBLE), 0), 9) AS ratio FROM w), k AS (SELECT * FROM r WHERE ratio BETWEEN 0.5 AND 3)
SELECT y, x, year(date) AS period, first(value ORDER BY -ratio, date) AS value FROM ndvi JOIN k USING (date) GROUP BY ALL""")
def a3(s, d):
    return C.composite_by_wetness(A.index(s, d, "NDVI"), A.flood(s, d), "year", 0.5, 3.0)


@query("a4_low_priority_sensor", """
SELECT y, x, year(date) AS period, first(nir ORDER BY CAST(sensor = 'A' AS INT), date) AS value FROM (SELECT y, x, date, sensor, round(nir, 9) AS nir FROM bands WHERE nir IS NOT NULL) GROUP BY ALL""")
def a4(s, d):
    return C.composite_low_priority(A.bands(s, d).select("y", "x", "date", "sensor", F.round("nir", 9).alias("value")), "year", "A")


@query("a5_tile_mosaic", "SELECT y, x, date, sensor, qa, round(green, 9) AS green, round(nir, 9) AS nir FROM bands")
def a5(s, d):
    return A.bands(s, d).select("y", "x", "date", "sensor", "qa", F.round("green", 9).alias("green"), F.round("nir", 9).alias("nir"))


@query("a6_monthly_max", "SELECT y, x, year(date) * 100 + month(date) AS period, max(value) AS value FROM mndwi GROUP BY ALL")
def a6(s, d):
    return C.mosaic_max(A.index(s, d, "MNDWI").withColumn("period", C.period("month")), ["y", "x", "period"])


@query("a7_scene_wetness", "SELECT date, count(*) FILTER (WHERE cls = 1) AS dry, count(*) FILTER (WHERE cls = 2) AS wet, round(count(*) FILTER (WHERE cls = 1) / nullif(CAST(count(*) FILTER (WHERE cls = 2) AS DOUBLE), 0), 9) AS ratio FROM flood GROUP BY date")
def a7(s, d):
    return C.scene_wetness(A.flood(s, d))


@query("a8_area_by_threshold", "SELECT year(date) * 100 + month(date) AS period, CAST(900 * count(*) FILTER (WHERE value >= 0.1) AS DOUBLE) AS area FROM mndwi GROUP BY 1")
def a8(s, d):
    return C.area_by(A.index(s, d, "MNDWI"), P.threshold("value", "gte0.1"), by=C.period("month").alias("period"))


@query("a9_valid_share", "SELECT date, count(value) AS n_valid, round(count(value) / CAST((SELECT count(*) FROM roi) AS DOUBLE), 9) AS share FROM mndwi JOIN roi USING (y, x) GROUP BY date HAVING round(count(value) / CAST((SELECT count(*) FROM roi) AS DOUBLE), 9) >= 0.1")
def a9(s, d):
    return C.valid_share(A.index(s, d, "MNDWI"), A.roi(s), 0.1)


@query("a10_flood_frequency", "SELECT y, x, count(*) FILTER (WHERE cls = 2) AS n_wet, count(*) AS n, round(count(*) FILTER (WHERE cls = 2) / CAST(count(*) AS DOUBLE), 9) AS frequency FROM flood GROUP BY y, x")
def a10(s, d):
    return FL.frequency(A.flood(s, d))


@query("a10_frequency_by_era", "SELECT y, x, CASE WHEN year(date) < 1998 THEN 'before' ELSE 'after' END AS era, count(*) FILTER (WHERE cls = 2) AS n_wet, count(*) AS n, round(count(*) FILTER (WHERE cls = 2) / CAST(count(*) AS DOUBLE), 9) AS frequency FROM flood GROUP BY ALL")
def a10e(s, d):
    return FL.frequency(A.flood(s, d), 1998)


@query("a11_annual_flood", "SELECT y, x, year(date) AS year, max(cls) AS cls FROM flood WHERE dayofyear(date) BETWEEN 90 AND 300 GROUP BY ALL")
def a11(s, d):
    return FL.annual_map(A.flood(s, d))


@query("a12_recurrence", "WITH a AS (SELECT y, x, year(date) AS year, max(cls) AS cls FROM flood WHERE dayofyear(date) BETWEEN 90 AND 300 GROUP BY ALL) SELECT y, x, round(count(*) FILTER (WHERE cls = 2) / CAST(count(*) AS DOUBLE), 9) AS recurrence FROM a GROUP BY y, x")
def a12(s, d):
    return FL.recurrence(FL.annual_map(A.flood(s, d)))


@query("a13_permanent_water", "SELECT y, x, frequency FROM (SELECT y, x, round(count(*) FILTER (WHERE cls = 2) / CAST(count(*) AS DOUBLE), 9) AS frequency FROM flood GROUP BY y, x) WHERE frequency > 0.4")
def a13(s, d):
    return FL.permanent_water(A.flood(s, d), 0.4)


_LOW = """bl AS (SELECT y, x, year(f.date) AS year, min(level) FILTER (WHERE cls = 2) AS min_wet, max(level) FILTER (WHERE cls = 1) AS max_dry,
 first(f.date ORDER BY level, f.date) FILTER (WHERE cls = 2) AS min_wet_date, first(f.date ORDER BY level DESC, f.date) FILTER (WHERE cls = 1) AS max_dry_date FROM flood f JOIN levels l ON f.date = l.date GROUP BY y, x, year(f.date))"""


@query("a14_boundary_levels", f"WITH {_LOW} SELECT y, x, year, min_wet, max_dry, min_wet_date, max_dry_date FROM bl")
def a14(s, d):
    return FL.boundary_levels(A.flood(s, d), A.levels(s, d))


_W1 = """a1 AS (SELECT date, level, year(date) AS year, sign(level - lag(level) OVER w) AS step FROM levels WINDOW w AS (PARTITION BY year(date) ORDER BY date)),
b1 AS (SELECT *, lead(step) OVER (PARTITION BY year ORDER BY date) AS nxt FROM a1), e1 AS (SELECT *, CASE WHEN step IS NULL OR nxt IS NULL OR step <> nxt OR step = 0 THEN 0 ELSE CAST(step AS INT) END AS sg FROM b1),
f1 AS (SELECT *, CASE WHEN sg = lag(sg) OVER (PARTITION BY year ORDER BY date) THEN 0 ELSE 1 END AS new FROM e1), g1 AS (SELECT *, sum(new) OVER (PARTITION BY year ORDER BY date) AS run FROM f1),
tr AS (SELECT date, CAST(sg * row_number() OVER (PARTITION BY year, run ORDER BY date) AS INT) AS trend FROM g1)"""


@query("a14_level_trend", f"WITH {_LOW}, {_W1} SELECT y, x, bl.year, min_wet, max_dry, min_wet_date, max_dry_date, p.trend AS min_wet_trend, q.trend AS max_dry_trend FROM bl LEFT JOIN tr p ON p.date = min_wet_date LEFT JOIN tr q ON q.date = max_dry_date")
def a14t(s, d):
    """Boundary levels with the trend of the level on their dates."""
    levels = A.levels(s, d)
    return FL.with_trend(FL.boundary_levels(A.flood(s, d), levels), levels)


@query("a15_inundation_indicators", f"""WITH {_LOW}
SELECT y, x, bl.year, CAST(count(*) AS BIGINT) AS duration, round(max(level - min_wet), 9) AS max_height, round(avg(level - min_wet), 9) AS mean_depth FROM bl JOIN levels l ON year(l.date) = bl.year AND level >= min_wet WHERE min_wet IS NOT NULL GROUP BY ALL""")
def a15(s, d):
    return FL.inundation_indicators(A.flood(s, d), A.levels(s, d))


@query("a16_duration_by_fraction", """
WITH t AS (SELECT y, x, CAST(k AS INT) AS k, z + CAST(2 AS DOUBLE) * k / 4 AS threshold FROM dem, range(5) r(k)) SELECT y, x, k, CAST(count(level) AS BIGINT) AS days FROM t LEFT JOIN levels ON level > threshold GROUP BY ALL""")
def a16(s, d):
    return FL.duration_by_fraction(A.dem(s).select("y", "x", c("z").alias("threshold"), F.lit(2.0).alias("height")), A.levels(s, d))


@query("a17_bathtub_depths", "SELECT y, x, year(date) AS year, CAST(count(*) AS BIGINT) AS duration, round(avg(level - z), 5) AS mean_depth, round(max(level - z), 9) AS max_depth FROM dem JOIN levels ON level > z GROUP BY ALL")
def a17(s, d):
    return FL.bathtub(A.dem(s), A.levels(s, d))


_PH = "ph AS (SELECT DISTINCT y, x, year(date) AS year, 100 + y * 3 AS start, 200 + x * 5 AS \"end\" FROM ndvi)"


def phases(s, d):
    return A.index(s, d, "NDVI").select("y", "x", F.year("date").alias("year")).distinct().select("y", "x", "year", (100 + c("y") * 3).alias("start"), (200 + c("x") * 5).alias("end"))


@query("a18_j11_phase_accumulation", f'WITH {_PH} SELECT y, x, year, round(sum(value) FILTER (WHERE dayofyear(date) >= start AND dayofyear(date) < "end"), 9) AS value, count(value) FILTER (WHERE dayofyear(date) >= start AND dayofyear(date) < "end") AS n FROM ndvi JOIN ph USING (y, x) WHERE year(date) = year GROUP BY y, x, year')
def a18(s, d):
    return T.within_phases(A.index(s, d, "NDVI"), phases(s, d), ["y", "x"], "acc")


@query("a18_phase_mean_over_base", f"""WITH {_PH}, b AS (SELECT y, x, year, avg(value) FILTER (WHERE abs(dayofyear(date) - start) <= 5) AS base FROM ndvi JOIN ph USING (y, x) WHERE year(date) = year GROUP BY y, x, year)
SELECT y, x, year, round(avg(value - coalesce(base, 0)) FILTER (WHERE dayofyear(date) >= start AND dayofyear(date) < "end"), 9) AS value, count(value) FILTER (WHERE dayofyear(date) >= start AND dayofyear(date) < "end") AS n
FROM ndvi JOIN ph USING (y, x) JOIN b USING (y, x, year) WHERE year(date) = year GROUP BY y, x, year""")
def a18b(s, d):
    return T.within_phases(A.index(s, d, "NDVI"), phases(s, d), ["y", "x"], "ave", base=True)


@query("a18_mean_over_first_days", f"""WITH {_PH}, b AS (SELECT y, x, year, avg(value) FILTER (WHERE dayofyear(date) - start BETWEEN 0 AND 9) AS base FROM ndvi JOIN ph USING (y, x) WHERE year(date) = year GROUP BY y, x, year)
SELECT y, x, year, round(avg(value - coalesce(base, 0)) FILTER (WHERE dayofyear(date) >= start AND dayofyear(date) < "end"), 11) AS value, count(value) FILTER (WHERE dayofyear(date) >= start AND dayofyear(date) < "end") AS n
FROM ndvi JOIN ph USING (y, x) JOIN b USING (y, x, year) WHERE year(date) = year GROUP BY y, x, year""")
def a18f(s, d):
    return T.within_phases(A.index(s, d, "NDVI"), phases(s, d), ["y", "x"], "ave", base="first", digits=11)


@query("a19_growing_degrees", """
SELECT station, year(date) AS year, round(sum(greatest(level - 15, 0)) FILTER (WHERE dayofyear(date) <= 200), 4) AS to_peak, round(sum(greatest(level - 15, 0)) FILTER (WHERE dayofyear(date) <= 150), 4) AS to_date,
 round(sum(greatest(level - 15, 0)) FILTER (WHERE dayofyear(date) <= 150) / nullif(sum(greatest(level - 15, 0)) FILTER (WHERE dayofyear(date) <= 200), 0), 9) AS share FROM gauge GROUP BY ALL""")
def a19(s, d):
    g = A.gauge(s, d).select("station", "date", c("level").alias("value"))
    b = g.select("station", F.year("date").alias("year")).distinct().withColumns({"peak": F.lit(200), "at": F.lit(150)})
    return T.growing_degrees(g, b, ["station"], 15.0)


@query("a20_a21_season_stats", "SELECT y, x, year(date) AS year, max(value) AS vmax, min(value) AS vmin, round(avg(value), 9) AS vmean, round(stddev_pop(value), 7) AS vstd FROM ndvi WHERE dayofyear(date) BETWEEN 90 AND 240 GROUP BY ALL")
def a20(s, d):
    return T.stats_until(A.index(s, d, "NDVI"), ["y", "x"], 90, 240)


@query("a29_daily_weather", """
SELECT station, var, CAST(ts AS DATE) AS date, round(avg(value), 9) AS vmean, max(value) AS vmax, min(value) AS vmin, round(sum(value), 4) AS total, round(sum(value) FILTER (WHERE hour(ts) < 12), 4) AS first_half, round(sum(value) FILTER (WHERE hour(ts) >= 12), 4) AS last_half FROM weather GROUP BY ALL""")
def a29(s, d):
    return T.hourly_to_daily(A.weather(s, d), ["station", "var"])


@query("a30_daily_mean", "SELECT var, CAST(ts AS DATE) AS date, round(avg(value), 9) AS value FROM weather GROUP BY ALL")
def a30(s, d):
    return A.weather(s, d).groupBy("var", F.to_date("ts").alias("date")).agg(F.round(F.avg("value"), 9).alias("value"))


@query("a31_era_difference", "SELECT y, x, round(avg(value) FILTER (WHERE year(date) < 1998), 9) AS before, round(avg(value) FILTER (WHERE year(date) >= 1998), 9) AS after, round(avg(value) FILTER (WHERE year(date) >= 1998) - avg(value) FILTER (WHERE year(date) < 1998), 9) AS change FROM ndvi GROUP BY y, x")
def a31(s, d):
    return C.era_difference(A.index(s, d, "NDVI"), 1998)


@query("a32_channel_statistics", "SELECT round(avg(green), 9) AS green_mean, round(stddev_pop(green), 9) AS green_std, round(avg(nir), 9) AS nir_mean, round(stddev_pop(nir), 9) AS nir_std FROM raw_bands")
def a32(s, d):
    return A.raw_bands(s, d).agg(*[F.round(f(b), 9).alias(f"{b}_{n}") for b in ("green", "nir") for f, n in ((F.avg, "mean"), (F.stddev_pop, "std"))])


@query("a45_coverage_ranges", """
WITH m AS (SELECT DISTINCT station, year(date) * 100 + month(date) AS ym FROM gauge WHERE (year(date) * 12 + month(date) + station) % 5 <> 0),
g AS (SELECT station, ym, ym // 100 * 12 + ym % 100 - row_number() OVER (PARTITION BY station ORDER BY ym) AS g FROM m) SELECT station, min(ym) AS start_ym, max(ym) AS end_ym, count(*) AS n FROM g GROUP BY station, g""")
def a45(s, d):
    g = A.gauge(s, d).filter((F.year("date") * 12 + F.month("date") + c("station")) % 5 != 0)
    return T.coverage_ranges(g.select("station", (F.year("date") * 100 + F.month("date")).alias("ym")), "station")


# --- joins ----------------------------------------------------------------------------------------------------------


@query("j1_remove_inundated", "SELECT y, x, date, round((nir - red) / nullif(nir + red, 0), 6) AS value FROM bands WHERE nir + red <> 0 AND green + swir <> 0 AND round((green - swir) / nullif(green + swir, 0), 6) < 0.1")
def j1(s, d):
    return FL.remove_inundated(A.index(s, d, "NDVI"), A.flood(s, d)).select("y", "x", "date", "value")


@query("j2_feature_assembly", "SELECT y, x, avg_ndvi, frequency FROM (SELECT y, x, round(avg(value), 9) AS avg_ndvi FROM ndvi GROUP BY y, x) RIGHT JOIN grid USING (y, x) LEFT JOIN (SELECT y, x, round(count(*) FILTER (WHERE cls = 2) / CAST(count(*) AS DOUBLE), 9) AS frequency FROM flood GROUP BY y, x) USING (y, x)")
def j2(s, d):
    a = A.index(s, d, "NDVI").groupBy("y", "x").agg(F.round(F.avg("value"), 9).alias("avg_ndvi"))
    return A.grid(s).join(a, ["y", "x"], "left").join(FL.frequency(A.flood(s, d)).select("y", "x", "frequency"), ["y", "x"], "left")


@query("j3_j4_merge_tables", """
SELECT station, date, flow, value FROM (SELECT station, date, flow FROM gauge WHERE station < 3) FULL JOIN (SELECT station, date, level AS value FROM gauge WHERE station > 1) USING (station, date)""")
def j3(s, d):
    from ..sources.tables import merge_tables

    g = A.gauge(s, d)
    return merge_tables([g.filter("station < 3").select("station", "date", "flow"), g.filter("station > 1").select("station", "date", c("level").alias("value"), "flow")], ["station", "date"])


@query("j5_exclude_rows", "SELECT shot, rh100 FROM footprints WHERE shot NOT IN (SELECT shot FROM footprints WHERE quality = 0)")
def j5(s, d):
    from ..operators.footprints import exclude_known_bad

    f = A.footprints(s, d)
    return exclude_known_bad(f, f.filter("quality = 0"), "shot").select("shot", "rh100")


@query("j6_common_years", "SELECT y, x, date, value FROM ndvi WHERE year(date) IN (SELECT year(date) FROM gauge WHERE station = 1 AND month(date) = 12 AND day(date) > 20)")
def j6(s, d):
    years = A.gauge(s, d).filter((c("station") == 1) & (F.month("date") == 12) & (F.dayofmonth("date") > 20)).select(F.year("date").alias("_y"))
    o = A.index(s, d, "NDVI")
    return o.join(years, F.year("date") == c("_y"), "left_semi")


@query("j7_u4_set_difference", "SELECT * FROM ((SELECT s_nationkey AS k FROM supplier EXCEPT ALL SELECT c_nationkey FROM customer) UNION ALL (SELECT c_nationkey FROM customer EXCEPT ALL SELECT s_nationkey FROM supplier))")
def j7(s, d):
    a, b = A.table(s, d, "supplier").select(c("s_nationkey").alias("k")), A.table(s, d, "customer").select(c("c_nationkey").alias("k"))
    return a.exceptAll(b).unionByName(b.exceptAll(a))


_AT = """r AS (SELECT y, x, CAST(DATE '1997-07-01' + y * 3 + x AS DATE) AS "at" FROM grid), o AS (SELECT y, x, date, value FROM ndvi),
b AS (SELECT r.y, r.x, r."at", max(date) FILTER (WHERE date <= "at") AS d0, min(date) FILTER (WHERE date >= "at") AS d1 FROM r LEFT JOIN o ON r.y = o.y AND r.x = o.x AND abs(datediff('day', date, "at")) <= 30 GROUP BY ALL)"""


@query("j8_value_at_date", f"""WITH {_AT}
SELECT b.y, b.x, b."at", round(CASE WHEN d0 = d1 THEN p.value ELSE p.value + (q.value - p.value) * datediff('day', d0, "at") / datediff('day', d0, d1) END, 9) AS value
FROM b LEFT JOIN o p ON p.y = b.y AND p.x = b.x AND p.date = d0 LEFT JOIN o q ON q.y = b.y AND q.x = b.x AND q.date = d1""")
def j8(s, d):
    r = A.grid(s).withColumn("at", F.date_add(F.lit("1997-07-01").cast("date"), c("y") * 3 + c("x")))
    return T.value_at(r, A.index(s, d, "NDVI"), 30, ["y", "x"]).select("y", "x", "at", "value")


@query("j10_valid_attributes", """
WITH m AS (SELECT DISTINCT station, year(date) * 100 + month(date) AS ym FROM gauge WHERE (year(date) * 12 + month(date) + station) % 5 <> 0),
g AS (SELECT station, ym, ym // 100 * 12 + ym % 100 - row_number() OVER (PARTITION BY station ORDER BY ym) AS g FROM m), r AS (SELECT station, min(ym) AS start_ym, max(ym) AS end_ym FROM g GROUP BY station, g),
q AS (SELECT DISTINCT station, year(date) * 100 + month(date) AS ym FROM gauge),
k AS (SELECT station, ym, start_ym, end_ym, row_number() OVER (PARTITION BY station, ym ORDER BY CASE WHEN ym BETWEEN start_ym AND end_ym THEN 0 WHEN ym < start_ym THEN start_ym - ym ELSE ym - end_ym END, start_ym) AS n FROM q JOIN r USING (station))
SELECT station, ym, start_ym, end_ym FROM k WHERE n = 1""")
def j10(s, d):
    q = A.gauge(s, d).select("station", (F.year("date") * 100 + F.month("date")).alias("ym")).distinct()
    return T.attributes_valid_at(q, a45(s, d).drop("n"), "station")


@query("j12_t17_between_floods", """
WITH w AS (SELECT y, x, year(date) AS year, min(date) AS until, max(date) AS last FROM flood WHERE cls = 2 GROUP BY ALL), sp AS (SELECT y, x, year, until, lag(last) OVER (PARTITION BY y, x ORDER BY year) AS since FROM w)
SELECT y, x, sp.year, count(value) AS n, round(avg(value), 9) AS mean_value, round(max(value), 9) AS max_value FROM sp JOIN ndvi n USING (y, x) WHERE n.date > since AND n.date < until GROUP BY ALL""")
def j12(s, d):
    return T.between_floods(A.index(s, d, "NDVI"), A.flood(s, d))


@query("t17_rebuilt_series", """
WITH w AS (SELECT y, x, year(date) AS year, min(date) AS until, max(date) AS last FROM flood WHERE cls = 2 GROUP BY ALL), sp AS (SELECT y, x, year, until, lag(last) OVER (PARTITION BY y, x ORDER BY year) AS since FROM w)
SELECT n.y, n.x, sp.year, n.date, CAST(datediff('day', since, n.date) AS INT) AS day, value FROM sp JOIN ndvi n ON n.y = sp.y AND n.x = sp.x AND n.date > since AND n.date < until WHERE value > 0""")
def t17(s, d):
    """The vegetation series of each span between floods, as rows."""
    return T.rebuilt_series(A.index(s, d, "NDVI"), A.flood(s, d))


@query("j13_level_over_terrain", "SELECT y, x, date, round(level - z, 9) AS depth FROM dem JOIN levels ON level > z")
def j13(s, d):
    """The rows are the result: a depth for each wet cell and day."""
    return A.dem(s).join(A.levels(s, d), c("level") > c("z")).select("y", "x", "date", F.round(c("level") - c("z"), 9).alias("depth"))


@query("j14_days_over_threshold", "SELECT y, x, CAST(count(level) AS BIGINT) AS days, max(level) AS top, round(avg(level - z), 5) AS mean_depth FROM dem LEFT JOIN levels ON level > z GROUP BY y, x")
def j14(s, d):
    return FL.days_over(A.dem(s).withColumnRenamed("z", "threshold"), A.levels(s, d), ["y", "x"])


@query("j19_year_on_year", """
WITH m AS (SELECT y, x, year(date) AS year, max(value) AS value FROM ndvi GROUP BY ALL) SELECT a.y, a.x, a.year, round(b.value - a.value, 9) AS change, round((b.value - a.value) / nullif(a.value, 0), 10) AS relative FROM m a JOIN m b ON a.y = b.y AND a.x = b.x AND b.year = a.year + 1""")
def j19(s, d):
    m = A.index(s, d, "NDVI").groupBy("y", "x", F.year("date").alias("year")).agg(F.max("value").alias("value"))
    return T.year_on_year(m, ["y", "x"])


@query("j21_t4_dynamic_map", """
WITH t AS (SELECT y, x, round(avg(value) + stddev_pop(value), 9) AS threshold FROM mndwi GROUP BY y, x) SELECT y, x, date, CASE WHEN value > coalesce(threshold, 0.16) OR value > 0.16 THEN 2 ELSE 1 END AS cls FROM mndwi LEFT JOIN t USING (y, x)""")
def j21(s, d):
    o = A.index(s, d, "MNDWI")
    t = o.groupBy("y", "x").agg(F.round(F.avg("value") + F.stddev_pop("value"), 9).alias("threshold"))
    return FL.dynamic_map(o, t)


# --- windows and models ---------------------------------------------------------------------------------------------


@query("w1_level_trend", """
WITH a AS (SELECT date, level, year(date) AS year, sign(level - lag(level) OVER w) AS step FROM levels WINDOW w AS (PARTITION BY year(date) ORDER BY date)),
b AS (SELECT *, lead(step) OVER (PARTITION BY year ORDER BY date) AS nxt FROM a), e AS (SELECT *, CASE WHEN step IS NULL OR nxt IS NULL OR step <> nxt OR step = 0 THEN 0 ELSE CAST(step AS INT) END AS sg FROM b),
f AS (SELECT *, CASE WHEN sg = lag(sg) OVER (PARTITION BY year ORDER BY date) THEN 0 ELSE 1 END AS new FROM e), g AS (SELECT *, sum(new) OVER (PARTITION BY year ORDER BY date) AS run FROM f)
SELECT date, level, CAST(sg * row_number() OVER (PARTITION BY year, run ORDER BY date) AS INT) AS trend FROM g""")
def w1(s, d):
    return FL.level_trend(A.levels(s, d))


@query("w2_fill_gaps", """
WITH g AS (SELECT station, date, level AS value FROM gauge WHERE day(date) % 9 < 4), sp AS (SELECT station, min(date) AS a, max(date) AS b FROM g GROUP BY station),
ds AS (SELECT station, CAST(unnest(generate_series(a, b, INTERVAL 1 DAY)) AS DATE) AS date FROM sp), j AS (SELECT ds.station, ds.date, value FROM ds LEFT JOIN g ON g.station = ds.station AND g.date = ds.date),
k AS (SELECT station, date, value, last_value(CASE WHEN value IS NOT NULL THEN date END IGNORE NULLS) OVER p AS d0, last_value(value IGNORE NULLS) OVER p AS v0, first_value(CASE WHEN value IS NOT NULL THEN date END IGNORE NULLS) OVER q AS d1, first_value(value IGNORE NULLS) OVER q AS v1 FROM j
 WINDOW p AS (PARTITION BY station ORDER BY date ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), q AS (PARTITION BY station ORDER BY date ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))
SELECT station, date, round(CASE WHEN d0 = d1 OR datediff('day', d0, d1) > 60 THEN v0 ELSE v0 + (v1 - v0) * datediff('day', d0, date) / datediff('day', d0, d1) END, 9) AS value, value IS NULL AS filled FROM k""")
def w2(s, d):
    g = A.gauge(s, d).filter(F.dayofmonth("date") % 9 < 4).select("station", "date", c("level").alias("value"))
    return T.fill_gaps(g, ["station"])


@query("w6_spike_rule", """
WITH g AS (SELECT station, date, CASE WHEN (day(date) + station) % 4 < 2 THEN 0 ELSE level END AS value FROM gauge), b AS (SELECT *, coalesce(value, 0) = 0 AS bad FROM g),
n AS (SELECT *, coalesce(lag(bad) OVER w, false) OR coalesce(lead(bad) OVER w, false) AS near FROM b WINDOW w AS (PARTITION BY station ORDER BY date)) SELECT station, date, CASE WHEN NOT (bad AND near) THEN value END AS value FROM n""")
def w6(s, d):
    g = A.gauge(s, d).select("station", "date", F.when((F.dayofmonth("date") + c("station")) % 4 < 2, 0.0).otherwise(c("level")).alias("value"))
    return T.spike_rule(g, ["station"])


@query("w10_annual_peak", """
WITH p AS (SELECT y, x, year(date) AS year, first(date ORDER BY value DESC, date) AS d, max(value) AS v, first(date ORDER BY value DESC, date) FILTER (WHERE dayofyear(date) BETWEEN 90 AND 210) AS di, max(value) FILTER (WHERE dayofyear(date) BETWEEN 90 AND 210) AS vi FROM ndvi GROUP BY ALL)
SELECT y, x, year, CASE WHEN dayofyear(d) BETWEEN 90 AND 210 THEN d WHEN vi >= 0.5 THEN di END AS peak_date, CASE WHEN dayofyear(d) BETWEEN 90 AND 210 THEN v WHEN vi >= 0.5 THEN vi END AS peak FROM p""")
def w10(s, d):
    return T.annual_peak(A.index(s, d, "NDVI"))


@query("w11_peak_to_flood", """
WITH p AS (SELECT y, x, year(date) AS year, first(date ORDER BY value DESC, date) AS d, max(value) AS v, first(date ORDER BY value DESC, date) FILTER (WHERE dayofyear(date) BETWEEN 90 AND 210) AS di, max(value) FILTER (WHERE dayofyear(date) BETWEEN 90 AND 210) AS vi FROM ndvi GROUP BY ALL),
k AS (SELECT y, x, year, CASE WHEN dayofyear(d) BETWEEN 90 AND 210 THEN d WHEN vi >= 0.5 THEN di END AS peak FROM p), f AS (SELECT k.y, k.x, k.year, peak, min(date) FILTER (WHERE date > peak) AS flooded FROM k LEFT JOIN (SELECT * FROM flood WHERE cls = 2) w ON w.y = k.y AND w.x = k.x AND year(w.date) = k.year WHERE peak IS NOT NULL GROUP BY ALL)
SELECT f.y, f.x, f.year, count(value) AS n, round(avg(value), 9) AS mean_value FROM f JOIN ndvi n ON n.y = f.y AND n.x = f.x AND year(n.date) = f.year AND n.date >= peak AND (flooded IS NULL OR n.date < flooded) GROUP BY ALL""")
def w11(s, d):
    return T.peak_to_flood(A.index(s, d, "NDVI"), A.flood(s, d))


@query("w11_matched_duration", """
WITH p AS (SELECT y, x, year(date) AS year, first(date ORDER BY value DESC, date) AS d, max(value) AS v, first(date ORDER BY value DESC, date) FILTER (WHERE dayofyear(date) BETWEEN 90 AND 210) AS di, max(value) FILTER (WHERE dayofyear(date) BETWEEN 90 AND 210) AS vi FROM ndvi GROUP BY ALL),
k AS (SELECT y, x, year, CASE WHEN dayofyear(d) BETWEEN 90 AND 210 THEN d WHEN vi >= 0.5 THEN di END AS peak FROM p), f AS (SELECT k.y, k.x, k.year, peak, datediff('day', peak, min(date) FILTER (WHERE date > peak)) AS days FROM k LEFT JOIN (SELECT * FROM flood WHERE cls = 2) w ON w.y = k.y AND w.x = k.x AND year(w.date) = k.year WHERE peak IS NOT NULL GROUP BY k.y, k.x, k.year, peak),
m AS (SELECT a.y, a.x, a.year, a.peak AS p0, b.peak AS p1, least(coalesce(a.days, 365), coalesce(b.days, 365)) AS duration FROM f a JOIN f b ON b.y = a.y AND b.x = a.x AND b.year = a.year + 1 WHERE a.days IS NOT NULL OR b.days IS NOT NULL),
u AS (SELECT m.y, m.x, m.year, any_value(duration) AS duration, avg(value) FILTER (WHERE year(date) = m.year) AS v0, avg(value) FILTER (WHERE year(date) > m.year) AS v1 FROM m JOIN ndvi n ON n.y = m.y AND n.x = m.x AND year(n.date) BETWEEN m.year AND m.year + 1 AND datediff('day', CASE WHEN year(n.date) = m.year THEN p0 ELSE p1 END, n.date) BETWEEN 0 AND duration - 1 GROUP BY m.y, m.x, m.year)
SELECT y, x, year, CAST(duration AS INT) AS duration, round(v0, 11) AS mean_this, round(v1, 11) AS mean_next, round(v1 - v0, 11) AS change FROM u""")
def w11m(s, d):
    return T.matched_peak_to_flood(A.index(s, d, "NDVI"), A.flood(s, d))


@query("w12_exceedance", """
WITH m AS (SELECT y, x, date, min(abs(value)) OVER w AS low, count(value) OVER w AS m FROM mndwi WINDOW w AS (PARTITION BY y, x ORDER BY date ROWS BETWEEN 1 FOLLOWING AND 6 FOLLOWING)) SELECT y, x, date, low FROM m WHERE low > 0.2 AND m = 6""")
def w12(s, d):
    return T.exceedance(A.index(s, d, "MNDWI"), ["y", "x"], 0.2)


@query("w13_median_step", "SELECT y, x, round(median(d), 9) AS median_step FROM (SELECT y, x, abs(value - lag(value) OVER (PARTITION BY y, x ORDER BY date)) AS d FROM mndwi) GROUP BY y, x")
def w13(s, d):
    return T.median_step(A.index(s, d, "MNDWI"), ["y", "x"])


@query("t1_static_flood", "SELECT y, x, date, cls FROM flood")
def t1(s, d):
    return A.flood(s, d)


#: Thresholds by the record's values from outside of the flood season: the fixed point by at most 100 steps.
_T3 = """bs AS (SELECT y, x, value FROM mndwi WHERE NOT dayofyear(date) BETWEEN 182 AND 300 AND value >= -0.7), nn AS (SELECT y, x, count(*) AS n, avg(value) AS m, stddev_pop(value) AS s, count(*) FILTER (WHERE value < 0.123) AS dry FROM bs GROUP BY y, x),
it(y, x, i, cut, done) AS (SELECT y, x, 0, CAST(0.1 AS DOUBLE), n < 5 FROM nn UNION ALL
  SELECT q.y, q.x, q.i + 1, CASE WHEN c IS NULL THEN CAST(0.123 AS DOUBLE) ELSE c END, c IS NULL OR c = q.cut FROM (SELECT t.y, t.x, t.i, t.cut, (avg(b.value) FILTER (WHERE b.value < t.cut) + avg(b.value) FILTER (WHERE b.value >= t.cut)) / 2 AS c FROM it t JOIN bs b ON b.y = t.y AND b.x = t.x WHERE NOT t.done AND t.i < 100 GROUP BY t.y, t.x, t.i, t.cut) q),
bt AS (SELECT nn.y, nn.x, CASE WHEN nn.n < 5 THEN CAST(0.123 AS DOUBLE) ELSE arg_max(cut, i) END AS b FROM nn JOIN it USING (y, x) GROUP BY nn.y, nn.x, nn.n),
th AS (SELECT nn.y, nn.x, round(CASE WHEN n >= 5 AND dry >= 0.5 * n THEN least(round(b, 9), m + 2 * s) END, 7) AS threshold FROM nn JOIN bt USING (y, x))"""


@query("t2_bimodal_threshold", """
WITH RECURSIVE nn AS (SELECT y, x, count(*) AS n FROM mndwi GROUP BY y, x),
it(y, x, i, cut, done) AS (SELECT y, x, 0, CAST(0.1 AS DOUBLE), n < 5 FROM nn UNION ALL
  SELECT q.y, q.x, q.i + 1, coalesce(c, CAST(0.123 AS DOUBLE)), c IS NULL OR c = q.cut FROM (SELECT t.y, t.x, t.i, t.cut, (avg(b.value) FILTER (WHERE b.value < t.cut) + avg(b.value) FILTER (WHERE b.value >= t.cut)) / 2 AS c FROM it t JOIN mndwi b ON b.y = t.y AND b.x = t.x WHERE NOT t.done AND t.i < 100 GROUP BY t.y, t.x, t.i, t.cut) q)
SELECT nn.y, nn.x, nn.n, round(CASE WHEN nn.n < 5 THEN CAST(0.123 AS DOUBLE) ELSE arg_max(cut, i) END, 7) AS threshold FROM nn JOIN it USING (y, x) GROUP BY nn.y, nn.x, nn.n""")
def t2(s, d):
    """Bimodal thresholds, rounded past the order of sums."""
    return FL.bimodal_threshold(A.index(s, d, "MNDWI")).withColumn("threshold", F.round("threshold", 7))


@query("t3_dynamic_threshold", f"WITH RECURSIVE {_T3} SELECT y, x, threshold FROM th")
def t3(s, d):
    """Dynamic thresholds, rounded past the order of sums."""
    return FL.dynamic_threshold(A.index(s, d, "MNDWI")).select("y", "x", F.round("threshold", 7).alias("threshold"))


@query("t4_dynamic_flood", f"""WITH RECURSIVE {_T3}, dm AS (SELECT m.y, m.x, date, CASE WHEN value > coalesce(threshold, 0.16) OR value > 0.16 THEN 2 ELSE 1 END AS cls FROM mndwi m LEFT JOIN th USING (y, x)),
nb AS (SELECT a.y, a.x, a.date, any_value(a.cls) AS cls, min(b.cls) AS lo, max(b.cls) AS hi FROM dm a LEFT JOIN dm b ON b.date = a.date AND abs(b.y - a.y) <= 2 AND abs(b.x - a.x) <= 2 AND (b.y <> a.y OR b.x <> a.x) GROUP BY a.y, a.x, a.date)
SELECT y, x, date, CASE WHEN lo = hi AND lo <> cls THEN lo ELSE cls END AS cls FROM nb""")
def t4(s, d):
    """Own thresholds by pixel, forced wet above 0.16, isolated pixels flipped."""
    return FL.dynamic_flood(A.index(s, d, "MNDWI")).select("y", "x", "date", "cls")


@query("t5_surface_water", """
WITH m AS (SELECT y, x, date, round((green - swir) / nullif(green + swir, 0), 6) AS m, nir, swir2 FROM bands) SELECT y, x, date, CASE WHEN m > 0.123 OR (m > -0.5 AND nir < 0.2 AND swir2 < 0.1) THEN 2 ELSE 1 END AS cls FROM m WHERE m IS NOT NULL""")
def t5(s, d):
    return FL.surface_water_rule(P.spectral_indices(A.bands(s, d), ["MNDWI"]))


@query("t6_awei_annual", "SELECT y, x, year(date) AS year, max(CASE WHEN round(4 * (green - swir) - (CAST(0.25 AS DOUBLE) * nir + CAST(2.75 AS DOUBLE) * swir2), 6) >= 0 THEN 2 ELSE 1 END) AS cls FROM bands WHERE dayofyear(date) BETWEEN 182 AND 366 GROUP BY ALL")
def t6(s, d):
    w = P.spectral_indices(A.bands(s, d), ["AWEI"]).withColumnRenamed("AWEI", "value")
    return FL.annual_map(FL.static_threshold(w, 0.0), 182, 366)


@query("t7_radar_flood_index", """
WITH s AS (SELECT y, x, avg(green) FILTER (WHERE month(date) NOT BETWEEN 5 AND 10) AS d, min(green) FILTER (WHERE month(date) NOT BETWEEN 5 AND 10) AS dmin, min(green) FILTER (WHERE month(date) BETWEEN 5 AND 10) AS wmin, max(green) FILTER (WHERE month(date) BETWEEN 5 AND 10) AS wmax FROM bands GROUP BY y, x)
SELECT y, x, round((d - least(wmin, dmin)) / nullif(d + least(wmin, dmin), 0), 5) AS flood_index, round((wmax - d) / nullif(wmax + d, 0), 5) AS vegetated_index FROM s""")
def t7(s, d):
    return FL.radar_flood_index(A.bands(s, d).withColumnRenamed("green", "value"))



@query("t7_radar_maps", """
WITH s AS (SELECT y, x, avg(green) FILTER (WHERE month(date) NOT BETWEEN 5 AND 10) AS d, min(green) FILTER (WHERE month(date) NOT BETWEEN 5 AND 10) AS dmin, min(green) FILTER (WHERE month(date) BETWEEN 5 AND 10) AS wmin, max(green) FILTER (WHERE month(date) BETWEEN 5 AND 10) AS wmax FROM bands GROUP BY y, x),
r AS (SELECT y, x, round((d - least(wmin, dmin)) / nullif(d + least(wmin, dmin), 0), 5) AS fi, round((wmax - d) / nullif(wmax + d, 0), 5) AS vi FROM s)
SELECT y, x, k AS step, CASE WHEN fi > CAST(0.9 AS DOUBLE) + k * CAST(0.01 AS DOUBLE) THEN 2 WHEN fi IS NOT NULL THEN 1 END AS flood, CASE WHEN vi > CAST(0.2 AS DOUBLE) + k * CAST(0.02 AS DOUBLE) THEN 2 WHEN vi IS NOT NULL THEN 1 END AS vegetated FROM r, range(8) t(k)""")
def t7m(s, d):
    """Open and vegetated flood at eight thresholds each."""
    return FL.radar_flood_maps(FL.radar_flood_index(A.bands(s, d).withColumnRenamed("green", "value")), (0.9, 0.01), (0.2, 0.02), 8)
