"""The supplied tables as earth-observation tables (see FIXTURES.md). ``G`` is the side of the grid."""

from __future__ import annotations

import os
import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

G = int(os.environ.get("EOCUBE_GRID", "10"))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def raw_bands(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row for each scene pixel: ``(scene_id, sensor, y, x, date, blue..swir2, qa)``; a date may have several scenes."""
    c = F.col
    return table(spark, sf_dir, "lineitem").select(
        c("l_orderkey").alias("scene_id"), c("l_returnflag").alias("sensor"),
        (c("l_suppkey") % G).cast("int").alias("y"), (c("l_partkey") % G).cast("int").alias("x"), F.to_date("l_shipdate").alias("date"),
        (c("l_linenumber") / 10).alias("blue"), (c("l_quantity") / 100).alias("green"), c("l_discount").alias("red"), c("l_tax").alias("nir"),
        (c("l_extendedprice") / 200000).alias("swir"), (c("l_orderkey") % 97 / 100).alias("swir2"), (c("l_orderkey") * 7 % 65536).cast("int").alias("qa"),
    )


def bands(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ..operators.composite import mosaic_mean

    return mosaic_mean(raw_bands(spark, sf_dir), ["blue", "green", "red", "nir", "swir", "swir2"])


def red_edge(b: DataFrame) -> DataFrame:
    """``b`` with stand-ins for the red-edge bands and the narrow near infrared, between red and near infrared."""
    red, nir = F.col("red"), F.col("nir")
    return b.withColumns({"re1": red * 0.75 + nir * 0.25, "re2": red * 0.5 + nir * 0.5, "re3": red * 0.25 + nir * 0.75, "nir20": nir * 0.96 + 0.01})


def obs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``(y, x, date, idx, value)`` of MNDWI and NDVI; no-data rows are absent."""
    from ..operators.projection import spectral_indices, to_long

    return to_long(spectral_indices(bands(spark, sf_dir), ["MNDWI", "NDVI"]), ["MNDWI", "NDVI"])


def index(spark: SparkSession, sf_dir: str, idx: str) -> DataFrame:
    """``(y, x, date, value)`` of one index; no-data rows are absent."""
    from ..operators.projection import spectral_indices

    return spectral_indices(bands(spark, sf_dir), [idx]).select("y", "x", "date", F.col(idx).alias("value")).filter("value is not null")


def flood(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ..operators.flood import static_threshold

    return static_threshold(index(spark, sf_dir, "MNDWI"), 0.1)


def grid(spark: SparkSession, side: int = G) -> DataFrame:
    return spark.range(side * side).select((F.col("id") / side).cast("int").alias("y"), (F.col("id") % side).cast("int").alias("x"))


def roi(spark: SparkSession) -> DataFrame:
    return grid(spark).filter((F.col("y") * 7 + F.col("x") * 3) % 11 != 0)


def dem(spark: SparkSession) -> DataFrame:
    return grid(spark).withColumn("z", 10 + F.col("y") + 0.5 * F.col("x") + (F.col("y") * F.col("x") % 7) * 0.3)


def levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Daily water level from 10 to 30."""
    o = table(spark, sf_dir, "orders").groupBy(F.to_date("o_orderdate").alias("date")).agg(F.avg("o_totalprice").alias("p"))
    return o.select("date", F.round(10 + 20 * F.col("p") / 500000, 9).alias("level"))


def gauge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``(station, date, flow, sed_conc, level)`` of five stations."""
    o = table(spark, sf_dir, "orders").join(table(spark, sf_dir, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    g = o.groupBy((F.col("c_nationkey") % 5).cast("int").alias("station"), F.to_date("o_orderdate").alias("date"))
    return g.agg(
        F.round(F.avg("o_totalprice") / 10, 7).alias("flow"), F.round(F.greatest(F.avg("c_acctbal") / 10000, F.lit(0.0)), 9).alias("sed_conc"), F.round(10 + F.avg("o_totalprice") / 25000, 9).alias("level")
    )


def thalweg(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``(line, seq, x, y)``: a river across the grid, with a vertex for each supplier."""
    s = table(spark, sf_dir, "supplier")
    last = s.agg(F.max("s_suppkey").alias("_m"))  # one row
    k = F.col("s_suppkey")
    return s.crossJoin(F.broadcast(last)).select(F.lit(1).alias("line"), k.alias("seq"), F.round(F.lit(float(G)) * k / F.col("_m"), 6).alias("x"), (F.lit(G / 2) + (k * 7 % 11 - 5) * 0.2).alias("y"))


def gauge_sites(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``(station, px, py)`` beside the river, for each station of ``gauge``."""
    n = table(spark, sf_dir, "customer").select((F.col("c_nationkey") % 5).cast("int").alias("station")).distinct()
    return n.select("station", ((F.col("station") + 0.5) * (G / 5)).alias("px"), (F.lit(G / 2) + F.col("station") % 2 * 0.3).alias("py"))


def stations(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = table(spark, sf_dir, "supplier")
    return s.select(
        F.col("s_suppkey").cast("int").alias("station_id"), (F.col("s_suppkey") % G + 0.25).alias("px"), (F.floor(F.col("s_suppkey") / G) % G + 0.75).alias("py"),
        (F.col("s_acctbal") / 10).alias("alt"), F.round(F.col("s_acctbal") / 100, 7).alias("value"),
    )


def footprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``(shot, date, px, py, rh100, quality)``; the date is that of the customer's first order."""
    first = table(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.min(F.to_date("o_orderdate")).alias("date"))
    c = table(spark, sf_dir, "customer").join(first, F.col("c_custkey") == F.col("o_custkey"))
    return c.select(
        F.col("c_custkey").alias("shot"), "date", (F.col("c_custkey") * 37 % 1000 / 1000 * G).alias("px"), (F.col("c_custkey") * 91 % 1000 / 1000 * G).alias("py"),
        F.round(2 + F.abs("c_acctbal") / 3000, 9).alias("rh100"), F.when(F.col("c_mktsegment") == "BUILDING", 0).otherwise(1).alias("quality"),
    )


def weather(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``(station, ts, var, value)``"""
    return table(spark, sf_dir, "events").select(F.col("user_id").alias("station"), "ts", F.col("event_type").alias("var"), "value")


#: The same tables in SQL, as common table expressions in the order of use.
SQL = {
    "raw_bands": f"SELECT l_orderkey AS scene_id, l_returnflag AS sensor, CAST(l_suppkey % {G} AS INT) AS y, CAST(l_partkey % {G} AS INT) AS x, CAST(l_shipdate AS DATE) AS date, l_linenumber / CAST(10 AS DOUBLE) AS blue, l_quantity / 100 AS green, l_discount AS red, l_tax AS nir, l_extendedprice / 200000 AS swir, (l_orderkey % 97) / CAST(100 AS DOUBLE) AS swir2, CAST(l_orderkey * 7 % 65536 AS INT) AS qa FROM lineitem",
    "bands": "SELECT y, x, date, min(sensor) AS sensor, min(qa) AS qa, round(avg(blue), 12) AS blue, round(avg(green), 12) AS green, round(avg(red), 12) AS red, round(avg(nir), 12) AS nir, round(avg(swir), 12) AS swir, round(avg(swir2), 12) AS swir2 FROM raw_bands GROUP BY y, x, date",
    "edged": "SELECT *, red * CAST(0.75 AS DOUBLE) + nir * CAST(0.25 AS DOUBLE) AS re1, red * CAST(0.5 AS DOUBLE) + nir * CAST(0.5 AS DOUBLE) AS re2, red * CAST(0.25 AS DOUBLE) + nir * CAST(0.75 AS DOUBLE) AS re3, nir * CAST(0.96 AS DOUBLE) + CAST(0.01 AS DOUBLE) AS nir20 FROM bands",
    "obs": "SELECT y, x, date, 'MNDWI' AS idx, round((green - swir) / nullif(green + swir, 0), 6) AS value FROM bands WHERE green + swir <> 0 UNION ALL SELECT y, x, date, 'NDVI', round((nir - red) / nullif(nir + red, 0), 6) FROM bands WHERE nir + red <> 0",
    "mndwi": "SELECT y, x, date, value FROM obs WHERE idx = 'MNDWI'",
    "ndvi": "SELECT y, x, date, value FROM obs WHERE idx = 'NDVI'",
    "flood": "SELECT y, x, date, CASE WHEN value >= 0.1 THEN 2 ELSE 1 END AS cls FROM mndwi",
    "grid": f"SELECT CAST(i // {G} AS INT) AS y, CAST(i % {G} AS INT) AS x FROM range({G * G}) t(i)",
    "roi": "SELECT y, x FROM grid WHERE (y * 7 + x * 3) % 11 <> 0",
    "dem": "SELECT y, x, CAST(10 AS DOUBLE) + y + CAST(0.5 AS DOUBLE) * x + (y * x % 7) * CAST(0.3 AS DOUBLE) AS z FROM grid",
    "levels": "SELECT CAST(o_orderdate AS DATE) AS date, round(10 + 20 * avg(o_totalprice) / 500000, 9) AS level FROM orders GROUP BY 1",
    "gauge": "SELECT CAST(c_nationkey % 5 AS INT) AS station, CAST(o_orderdate AS DATE) AS date, round(avg(o_totalprice) / 10, 7) AS flow, round(greatest(avg(c_acctbal) / 10000, 0), 9) AS sed_conc, round(10 + avg(o_totalprice) / 25000, 9) AS level FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY 1, 2",
    "thalweg": f"SELECT 1 AS line, s_suppkey AS seq, round(CAST({G} AS DOUBLE) * s_suppkey / (SELECT max(s_suppkey) FROM supplier), 6) AS x, CAST({G / 2} AS DOUBLE) + (s_suppkey * 7 % 11 - 5) * CAST(0.2 AS DOUBLE) AS y FROM supplier",
    "gauge_sites": f"SELECT DISTINCT CAST(c_nationkey % 5 AS INT) AS station, (CAST(c_nationkey % 5 AS INT) + CAST(0.5 AS DOUBLE)) * CAST({G / 5} AS DOUBLE) AS px, CAST({G / 2} AS DOUBLE) + CAST(c_nationkey % 5 AS INT) % 2 * CAST(0.3 AS DOUBLE) AS py FROM customer",
    "stations": f"SELECT CAST(s_suppkey AS INT) AS station_id, s_suppkey % {G} + CAST(0.25 AS DOUBLE) AS px, s_suppkey // {G} % {G} + CAST(0.75 AS DOUBLE) AS py, s_acctbal / 10 AS alt, round(s_acctbal / 100, 7) AS value FROM supplier",
    "footprints": f"SELECT c_custkey AS shot, f.date, c_custkey * 37 % 1000 / CAST(1000 AS DOUBLE) * {G} AS px, c_custkey * 91 % 1000 / CAST(1000 AS DOUBLE) * {G} AS py, round(2 + abs(c_acctbal) / 3000, 9) AS rh100, CASE WHEN c_mktsegment = 'BUILDING' THEN 0 ELSE 1 END AS quality FROM customer JOIN (SELECT o_custkey, min(CAST(o_orderdate AS DATE)) AS date FROM orders GROUP BY 1) f ON c_custkey = o_custkey",
    "weather": "SELECT user_id AS station, ts, event_type AS var, value FROM events",
}


#: Those that a query reads more than once, or inside of a recursion.
SHARED = {"bands", "obs", "flood", "levels", "gauge", "footprints"}


def sql(query: str) -> str:
    """``query`` with the tables above that it uses in front of it."""
    head, rest = "WITH ", query
    for start in ("WITH RECURSIVE ", "WITH "):
        if query.startswith(start):
            head, rest = start, ", " + query[len(start) :]
            break
    else:
        rest = " " + query
    used: set[str] = set()
    for k in reversed(SQL):  # a table is used by the query or by a later table that is
        if any(re.search(rf"\b{k}\b", text) for text in (query, *[SQL[u] for u in used])):
            used.add(k)
    if not used:
        return query
    return head + ", ".join(f"{k} AS {'MATERIALIZED ' if k in SHARED else ''}({v})" for k, v in SQL.items() if k in used) + rest
