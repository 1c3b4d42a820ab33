"""Readers for station, gauge, section and footprint files, and cube storage."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def require_columns(df: DataFrame, names: list[str]) -> DataFrame:
    if missing := [n for n in names if n not in df.columns]:
        raise ValueError(f"columns missing: {missing}")
    return df


def _date(y, m, d):
    """A date from its parts; null if there is none."""
    return F.try_to_date(F.concat_ws("-", y.cast("string"), m.cast("string"), d.cast("string")), "y-M-d")


def weather_files(spark: SparkSession, path: str) -> DataFrame:
    """Fixed columns between blanks; variable and month stand in the file's name (``..-VAR-..-yyyymm.TXT``)."""
    t = spark.read.text(path).select(F.split(F.trim("value"), r"\s+").alias("c"), F.input_file_name().alias("f")).filter(F.size("c") >= 8)
    at = lambda i: F.get("c", F.lit(i)).try_cast("int")
    return t.select(
        F.regexp_extract("f", r"-([A-Z]{3})-[^/]*$", 1).alias("var"), at(0).alias("station_id"), at(1).alias("lat_ddmm"), at(2).alias("lon_ddmm"), at(3).alias("alt_cm"),
        _date(at(4), at(5), at(6)).alias("date"), at(7).alias("v"),
    )


def daily_station_csvs(spark: SparkSession, paths: list[str]) -> DataFrame:
    """CSV files of differing columns as one table; what a file lacks is null."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), [spark.read.csv(p, header=True) for p in paths])


def hourly_csvs(spark: SparkSession, path: str) -> DataFrame:
    """Hourly files named ``station_yyyymmdd.csv``."""
    d = spark.read.csv(path, header=True).withColumn("_f", F.input_file_name())
    return d.withColumns({"station": F.regexp_extract("_f", r"([^/_]+)_\d{8}\.csv", 1), "date": F.try_to_date(F.regexp_extract("_f", r"_(\d{8})\.csv", 1), "yyyyMMdd")}).drop("_f")


def blocks(spark: SparkSession, path: str, is_header: str) -> DataFrame:
    """Lines of text files with the number of the block they stand in: a header line opens a block.

    A file is numbered in its own order, file by file; only files are sorted, never all lines together.
    """
    t = spark.read.text(path, wholetext=True).select(F.input_file_name().alias("file"), F.posexplode(F.split("value", "\r?\n")).alias("line", "text")).filter("text <> ''")
    head = F.col("text").rlike(is_header)
    w = Window.partitionBy("file").orderBy("line")
    return t.select("file", "line", "text", head.alias("header"), F.sum(head.cast("int")).over(w).alias("block"))


def gauge_files(spark: SparkSession, path: str) -> DataFrame:
    """Gauge blocks: a header line ``#station,year`` and daily lines ``month,day,flow,sed_conc,level``."""
    b = blocks(spark, path, "^#")
    heads = b.filter("header").select("file", "block", F.split(F.substring("text", 2, 1000), ",").alias("h"))
    rows = b.filter("not header").select("file", "block", F.split("text", ",").alias("c"))
    at = lambda i, t="double": F.get("c", F.lit(i)).try_cast(t)
    j = rows.join(heads, ["file", "block"])
    return j.select(F.get("h", F.lit(0)).alias("station"), _date(F.get("h", F.lit(1)).try_cast("int"), at(0, "int"), at(1, "int")).alias("date"), at(2).alias("flow"), at(3).alias("sed_conc"), at(4).alias("level"))


def section_files(spark: SparkSession, path: str) -> DataFrame:
    """Section blocks: a header line ``name,<name>`` and lines ``distance,elevation``; ``(cs, pos, d, z)``."""
    b = blocks(spark, path, "^name,")
    heads = b.filter("header").select("file", "block", F.split("text", ",")[1].alias("cs"), F.col("line").alias("_l"))
    rows = b.filter("not header").select("file", "block", "line", F.split("text", ",").alias("c"))
    j = rows.join(heads, ["file", "block"])
    return j.select("cs", (F.col("line") - F.col("_l") - 1).cast("int").alias("pos"), F.get("c", F.lit(0)).try_cast("double").alias("d"), F.get("c", F.lit(1)).try_cast("double").alias("z")).filter("d is not null")


def merge_tables(tables: list[DataFrame], keys: list[str]) -> DataFrame:
    """Full outer join on the keys, one after another; of columns that collide the first table's stay."""

    def two(a: DataFrame, b: DataFrame) -> DataFrame:
        return a.join(b.select(*keys, *[c for c in b.columns if c not in a.columns]), keys, "full")

    return reduce(two, tables)


def footprint_tables(spark: SparkSession, paths: list[str], required: list[str]) -> DataFrame:
    """Footprint CSVs merged on the columns that all share; required columns are checked."""
    t = [spark.read.csv(p, header=True, inferSchema=False) for p in paths]
    shared = [c for c in t[0].columns if all(c in x.columns for x in t)]
    return require_columns(merge_tables(t, shared), required)


BLOCK = 256  # side of the cells that one file has


def load_cube(spark: SparkSession, path: str) -> DataFrame:
    """A stored cube without the layers that its manifest lists but the files lack, and the other way round."""
    obs, manifest = spark.read.parquet(f"{path}/layers"), spark.read.parquet(f"{path}/manifest")
    return obs.join(manifest.select("idx", "date"), ["idx", "date"], "left_semi")


def save_cube(obs: DataFrame, path: str, overwrite: bool = False) -> None:
    """Layers by index and year, and the ordered manifest. Without ``overwrite`` only years that are missing are written.

    With ``overwrite`` the partitions at hand replace their stored ones, others stay.
    """
    spark = obs.sparkSession
    rows = obs.withColumn("year", F.year("date"))
    if not overwrite:
        try:
            there = spark.read.parquet(f"{path}/layers").select("idx", "year").distinct()
            rows = rows.join(there, ["idx", "year"], "left_anti")
        except Exception as e:
            if "PATH_NOT_FOUND" not in str(e):
                raise
    # A file for each index, year and block of cells.
    rows.repartition("idx", "year", F.floor(F.col("y") / BLOCK), F.floor(F.col("x") / BLOCK)).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("idx", "year").parquet(f"{path}/layers")
    layers = spark.read.parquet(f"{path}/layers").groupBy("idx", "date").agg(F.count("value").alias("n_valid"))
    layers.coalesce(1).write.mode("overwrite").parquet(f"{path}/manifest")


def save_csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").csv(path, header=True)


def station_lines(daily: DataFrame, missing: int = 32766) -> DataFrame:
    """Daily values to the fixed station format: whole tenths between blanks, nulls as the missing code."""
    code = lambda c: F.coalesce(F.round(F.col(c) * 10).cast("int"), F.lit(missing)).cast("string")
    return daily.select(F.concat_ws(" ", F.col("station").cast("string"), F.year("date").cast("string"), F.month("date").cast("string"), F.dayofmonth("date").cast("string"), *map(code, ("vmean", "vmax", "vmin", "total"))).alias("value"))
