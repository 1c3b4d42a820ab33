"""Scene catalogs: everything is read off file names; resolving of duplicates."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.dates import from_doy_code
from ..functions.text import base_name


def list_files(spark: SparkSession, path: str, pattern: str = "*") -> DataFrame:
    """``(path, name, size)`` of the files under a folder, without reading them."""
    f = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", pattern).load(path)
    return f.select("path", F.element_at(F.split("path", "/"), -1).alias("name"), F.col("length").alias("size"))


def landsat(files: DataFrame) -> DataFrame:
    """``LC08_L2SP_123039_20200101_20200113_02_T1..``: sensor, level, tile, date, tier."""
    m = lambda i: F.regexp_extract("name", r"^(L[COTEM]0\d)_(L\d\w\w)_(\d{6})_(\d{8})_\d{8}_\d\d_(T\d|RT)", i)
    return files.select("name", "size", m(1).alias("sensor"), m(2).alias("level"), m(3).alias("tile"), F.try_to_date(m(4), "yyyyMMdd").alias("date"), m(5).alias("tier")).filter("sensor <> ''")


def sentinel2(files: DataFrame) -> DataFrame:
    """Date, orbit, tile and sensor by the position of their marks in the name."""
    at = lambda mark, skip, n: F.when(F.instr("name", mark) > 0, F.substring(F.col("name"), F.instr("name", mark) + skip, F.lit(n)))
    return files.select("name", "size", at("S2", 0, 3).alias("sensor"), F.try_to_date(at("_20", 1, 8), "yyyyMMdd").alias("date"), at("_R", 1, 4).alias("orbit"), at("_T", 1, 6).alias("tile")).filter("sensor is not null")


def sentinel1(files: DataFrame) -> DataFrame:
    """Sensor, beam, product, polarisation (DV: VV_VH, SV: VV) and date."""
    m = lambda i: F.regexp_extract("name", r"^(S1[AB])_(\w\w)_(\w{3})\w?_(\d)S(DV|SV|DH|SH)_(\d{8})T", i)
    pol = F.when(m(5) == "DV", "VV_VH").when(m(5) == "SV", "VV").when(m(5) == "DH", "HH_HV").otherwise("HH")
    return files.select("name", m(1).alias("sensor"), m(2).alias("beam"), m(3).alias("product"), pol.alias("polarisation"), F.try_to_date(m(6), "yyyyMMdd").alias("date")).filter("sensor <> ''")


def lidar(files: DataFrame) -> DataFrame:
    """Parts between underscores; products of level 2 and 4."""
    p = F.split("name", "_")
    return files.select("name", F.get(p, F.lit(0)).alias("mission"), F.get(p, F.lit(1)).alias("product"), from_doy_code(F.substring(F.get(p, F.lit(2)), 1, 7).try_cast("long")).alias("date"), F.get(p, F.lit(3)).alias("orbit"), F.when(F.col("name").startswith("GEDI02"), "L2").when(F.col("name").startswith("GEDI04"), "L4").alias("level"))


def dotted(files: DataFrame) -> DataFrame:
    """``PRODUCT.Ayyyyddd.hXXvYY...``: product, date, tile."""
    p = F.split("name", r"\.")
    return files.select("name", F.get(p, F.lit(0)).alias("product"), from_doy_code(F.substring(F.get(p, F.lit(1)), 2, 7).try_cast("long")).alias("date"), F.get(p, F.lit(2)).alias("tile"))


def largest_copy(files: DataFrame) -> DataFrame:
    """One file for each base name: the largest; of equals the first by name."""
    w = Window.partitionBy("base").orderBy(F.desc("size"), "name")
    return files.withColumn("base", base_name(F.col("name"))).withColumn("_r", F.row_number().over(w)).filter("_r = 1").drop("_r")


def newest_sensor(scenes: DataFrame) -> DataFrame:
    """One scene for each date and tile: of the newest sensor (by name), then the first by name."""
    w = Window.partitionBy("date", "tile").orderBy(F.desc("sensor"), "name")
    return scenes.withColumn("_r", F.row_number().over(w)).filter("_r = 1").drop("_r")


def shortest_path(scenes: DataFrame) -> DataFrame:
    """One scene for each date and tile: the shorter name, of equals the larger file, then the first by name."""
    w = Window.partitionBy("date", "tile").orderBy(F.length("name"), F.desc("size"), "name")
    return scenes.withColumn("_r", F.row_number().over(w)).filter("_r = 1").drop("_r")


def search_products(products: DataFrame, kind: str, first, last, cloud: float, online: bool, most: int = 1000) -> DataFrame:
    """Filtered product table, the first ``most`` by date and name (the report's own limit)."""
    p = products.filter((F.col("kind") == kind) & F.col("date").between(F.lit(first).cast("date"), F.lit(last).cast("date")) & (F.col("cloud") <= cloud) & (F.col("online") == online))
    return p.orderBy("date", "name").limit(most)
