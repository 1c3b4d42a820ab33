"""Mosaics, temporal composites and scene statistics: one aggregation each, combined map-side."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def mosaic_mean(bands: DataFrame, names: list[str]) -> DataFrame:
    """Scenes of one date as one: mean of valid values by pixel and date (rounded to 12 digits); first sensor, lowest qa."""
    return bands.groupBy("y", "x", "date").agg(F.min("sensor").alias("sensor"), F.min("qa").alias("qa"), *[F.round(F.avg(n), 12).alias(n) for n in names])


def mosaic_max(obs: DataFrame, by: list[str], value: str = "value") -> DataFrame:
    return obs.groupBy(*by).agg(F.max(value).alias(value))


def period(unit: str, date: Column | None = None) -> Column:
    """``month`` (yyyymm), ``year``, or ``season``: yyyy1 from May to October, else yyyy0 (the wet and the dry half)."""
    d = F.col("date") if date is None else date
    if unit == "month":
        return F.year(d) * 100 + F.month(d)
    if unit == "year":
        return F.year(d)
    return F.year(d) * 10 + F.when(F.month(d).between(5, 10), 1).otherwise(0)


def composite(obs: DataFrame, unit: str, how: str) -> DataFrame:
    """``(y, x, period, value)``: first, last, mean, max or min of the valid values of each period."""
    v = F.col("value")
    by_date = F.when(v.isNotNull(), F.col("date"))
    agg = {"first": F.min_by(v, by_date), "last": F.max_by(v, by_date), "mean": F.round(F.avg(v), 9), "max": F.max(v), "min": F.min(v)}[how]
    return obs.groupBy("y", "x", period(unit).alias("period")).agg(agg.alias("value"))


def scene_wetness(flood: DataFrame) -> DataFrame:
    """``(date, dry, wet, ratio)``: pixels by class and dry per wet (null without wet pixels)."""
    s = flood.groupBy("date").agg(F.count_if(F.col("cls") == 1).alias("dry"), F.count_if(F.col("cls") == 2).alias("wet"))
    return s.withColumn("ratio", F.round(F.col("dry") / F.nullif(F.col("wet").cast("double"), F.lit(0.0)), 9))


def composite_by_wetness(obs: DataFrame, flood: DataFrame, unit: str, low: float, high: float, wet_first: bool = False) -> DataFrame:
    """First valid value in order of the scenes' dry/wet ratio; scenes outside of [low, high] are left out.

    Scenes are few beside pixels; their table is joined by date and Spark broadcasts it by its size.
    """
    scenes = scene_wetness(flood).filter(F.col("ratio").between(low, high)).select("date", "ratio")
    rank = F.struct(F.col("ratio") if wet_first else -F.col("ratio"), "date")
    return obs.join(scenes, "date").filter("value is not null").groupBy("y", "x", period(unit).alias("period")).agg(F.min_by("value", rank).alias("value"))


def composite_low_priority(obs: DataFrame, unit: str, low: str) -> DataFrame:
    """First valid value by date, with the scenes of sensor ``low`` after all others."""
    rank = F.struct((F.col("sensor") == low).cast("int"), "date")
    return obs.filter("value is not null").groupBy("y", "x", period(unit).alias("period")).agg(F.min_by("value", rank).alias("value"))


def cube_sum(obs: DataFrame, over: str) -> DataFrame:
    """Sum along one of y, x, date."""
    return obs.groupBy(*[c for c in ("y", "x", "date") if c != over]).agg(F.round(F.sum("value"), 9).alias("value"))


def area_by(obs: DataFrame, predicate: Column, cell: float = 900.0, by: Column | None = None) -> DataFrame:
    """Area of the pixels that meet the predicate, by date (or ``by``)."""
    key = F.col("date") if by is None else by
    return obs.groupBy(key.alias("date") if by is None else key).agg((F.count_if(predicate) * cell).alias("area"))


def valid_share(obs: DataFrame, roi: DataFrame, least: float) -> DataFrame:
    """``(date, n_valid, share)`` of the dates on which at least ``least`` of the region has values."""
    inside = obs.join(roi.select("y", "x"), ["y", "x"], "left_semi")
    n = roi.agg(F.count(F.lit(1)).alias("_n"))
    s = inside.groupBy("date").agg(F.count("value").alias("n_valid")).crossJoin(F.broadcast(n))  # one row
    return s.select("date", "n_valid", F.round(F.col("n_valid") / F.col("_n"), 9).alias("share")).filter(F.col("share") >= least)


def era_difference(obs: DataFrame, year: int) -> DataFrame:
    """Means before and from ``year`` on by pixel, and their difference."""
    early, late = F.avg(F.when(F.year("date") < year, F.col("value"))), F.avg(F.when(F.year("date") >= year, F.col("value")))
    return obs.groupBy("y", "x").agg(F.round(early, 9).alias("before"), F.round(late, 9).alias("after"), F.round(late - early, 9).alias("change"))
