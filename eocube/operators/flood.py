"""Flood mapping and flood statistics. Class 1 is dry, 2 is wet; no-data rows are absent."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def static_threshold(obs: DataFrame, least: float) -> DataFrame:
    return obs.filter("value is not null").select("y", "x", "date", F.when(F.col("value") >= least, 2).otherwise(1).alias("cls"))


def frequency(flood: DataFrame, era: int | None = None) -> DataFrame:
    """Wet share of the valid dates by pixel (and by whether the year is before ``era``), with the share of years flooded."""
    keys = ["y", "x"] + ([] if era is None else [F.when(F.year("date") < era, "before").otherwise("after").alias("era")])
    return flood.groupBy(*keys).agg(F.count_if(F.col("cls") == 2).alias("n_wet"), F.count(F.lit(1)).alias("n"), F.round(F.count_if(F.col("cls") == 2) / F.count(F.lit(1)), 9).alias("frequency"))


def annual_map(flood: DataFrame, first: int = 90, last: int = 300) -> DataFrame:
    """Highest class of each year between two days of the year."""
    return flood.filter(F.dayofyear("date").between(first, last)).groupBy("y", "x", F.year("date").alias("year")).agg(F.max("cls").alias("cls"))


def recurrence(annual: DataFrame) -> DataFrame:
    """Share of years that were flooded."""
    return annual.groupBy("y", "x").agg(F.round(F.count_if(F.col("cls") == 2) / F.count(F.lit(1)), 9).alias("recurrence"))


def permanent_water(flood: DataFrame, share: float = 0.5) -> DataFrame:
    return frequency(flood).filter(F.col("frequency") > share).select("y", "x", "frequency")


def remove_inundated(obs: DataFrame, flood: DataFrame) -> DataFrame:
    """Values where the same pixel and date is dry; both sides are dealt by the same keys."""
    return obs.join(flood.filter("cls = 1").select("y", "x", "date"), ["y", "x", "date"])


def boundary_levels(flood: DataFrame, levels: DataFrame) -> DataFrame:
    """By pixel and year: lowest level seen wet, highest level seen dry, and their dates (the earliest of equals)."""
    j = flood.join(levels, "date")  # a level for each day: broadcast by its size
    wet, dry = F.col("cls") == 2, F.col("cls") == 1
    level, at = F.col("level"), F.col("date")
    return j.groupBy("y", "x", F.year("date").alias("year")).agg(
        F.min(F.when(wet, level)).alias("min_wet"), F.max(F.when(dry, level)).alias("max_dry"),
        F.min_by(F.when(wet, at), F.when(wet, F.struct(level, at))).alias("min_wet_date"),
        F.min_by(F.when(dry, at), F.when(dry, F.struct(-level, at))).alias("max_dry_date"),
    )


def with_trend(boundary: DataFrame, levels: DataFrame) -> DataFrame:
    """Boundary levels with the level's trend on the dates of the lowest wet and the highest dry level."""
    trend = level_trend(levels).select("date", "trend")
    at = lambda n: trend.select(F.col("date").alias(f"{n}_date"), F.col("trend").alias(f"{n}_trend"))
    return boundary.join(at("min_wet"), "min_wet_date", "left").join(at("max_dry"), "max_dry_date", "left").select(*boundary.columns, "min_wet_trend", "max_dry_trend")


SLICE = 0.1  # width of a slice of levels


def over_levels(thresholds: DataFrame, levels: DataFrame, by: list[str] | None = None) -> DataFrame:
    """``thresholds`` with what lies over each row's ``threshold``, for each value of ``by`` (columns of ``levels``):
    ``_n`` days, ``_sum`` of their levels and ``_top``, the highest.

    Levels are counted by value and laid into slices, with the totals of all higher slices beside the few levels of
    their own. A threshold meets one slice by equality, so rows don't meet days.
    """
    by = by or []
    value = F.floor(F.col("level") / SLICE).cast("long")
    counted = levels.groupBy(*by, "level").agg(F.count(F.lit(1)).alias("_k")).withColumn("_s", value)
    own = counted.groupBy(*by, "_s").agg(F.array_sort(F.collect_list(F.struct("level", "_k"))).alias("_own"), F.sum("_k").alias("_nk"), F.sum(F.col("level") * F.col("_k")).alias("_sk"), F.max("level").alias("_mk"))
    ends = counted.agg((F.min("_s") - 1).alias("_from"), (F.max("_s") + 1).alias("_to"))  # one row
    every = (counted.select(*by).distinct() if by else ends.select()).crossJoin(F.broadcast(ends)).withColumn("_s", F.explode(F.sequence("_from", "_to"))).select(*by, "_s")
    above = Window.partitionBy(*by).orderBy(F.desc("_s")).rowsBetween(Window.unboundedPreceding, -1)  # a row for each slice
    total = lambda c: F.coalesce(F.sum(c).over(above), F.lit(0))
    table = every.join(own, [*by, "_s"], "left").select(*by, "_s", "_own", total("_nk").alias("_na"), total("_sk").alias("_sa"), F.max("_mk").over(above).alias("_ma"))
    at = F.least(F.greatest(F.floor(F.col("threshold") / SLICE).cast("long"), F.col("_from")), F.col("_to"))
    j = thresholds.crossJoin(F.broadcast(ends)).withColumn("_s", at).drop("_from", "_to").join(table, "_s")
    over = F.filter(F.coalesce("_own", F.array().cast(own.schema["_own"].dataType)), lambda e: e["level"] > F.col("threshold"))
    add = lambda start, f: F.aggregate("_over", start, f)
    return j.withColumn("_over", over).select(
        *thresholds.columns, *by,
        (F.col("_na") + add(F.lit(0).cast("bigint"), lambda a, e: a + e["_k"])).alias("_n"),
        (F.col("_sa") + add(F.lit(0.0), lambda a, e: a + e["level"] * e["_k"])).alias("_sum"),
        F.coalesce("_ma", F.try_element_at("_over", F.lit(-1))["level"]).alias("_top"),
    )


def days_over(thresholds: DataFrame, levels: DataFrame, keys: list[str]) -> DataFrame:
    """Days with a level over each row's threshold, the highest level and the mean depth of these days."""
    o = over_levels(thresholds, levels)
    depth = F.sum(F.col("_sum") - F.col("_n") * F.col("threshold"))
    return o.groupBy(*keys).agg(F.sum("_n").alias("days"), F.max("_top").alias("top"), F.round(depth / F.nullif(F.sum("_n"), F.lit(0)), 5).alias("mean_depth"))


def inundation_indicators(flood: DataFrame, levels: DataFrame) -> DataFrame:
    """Duration, highest level over and mean depth by pixel and year, against the year's lowest wet level.

    Levels are pre-aggregated by year, so the comparison has an equality and is not a full cross product.
    """
    low = boundary_levels(flood, levels).filter("min_wet is not null").select("y", "x", "year", F.col("min_wet").alias("threshold"))
    counted = levels.groupBy(F.year("date").alias("year"), "level").agg(F.count(F.lit(1)).alias("_days"))
    j = low.join(counted, "year").filter(F.col("level") >= F.col("threshold"))
    return j.groupBy("y", "x", "year").agg(
        F.sum("_days").alias("duration"), F.round(F.max(F.col("level") - F.col("threshold")), 9).alias("max_height"),
        F.round(F.sum((F.col("level") - F.col("threshold")) * F.col("_days")) / F.sum("_days"), 9).alias("mean_depth"),
    )


def duration_by_fraction(pixels: DataFrame, levels: DataFrame, n: int = 4) -> DataFrame:
    """Days that a stand of ``height`` on ground ``threshold`` is flooded to 0/n .. n/n of its height."""
    steps = pixels.withColumn("k", F.explode(F.sequence(F.lit(0), F.lit(n))))
    steps = steps.select("y", "x", "k", (F.col("threshold") + F.col("height") * F.col("k") / n).alias("threshold"))
    return days_over(steps, levels, ["y", "x", "k"]).select("y", "x", "k", "days")


def bathtub(dem: DataFrame, levels: DataFrame) -> DataFrame:
    """Duration and depths of each cell under daily levels, by year: wet when the level is over the ground."""
    return year_depths(dem.withColumn("threshold", F.col("z")), levels)


def year_depths(ground: DataFrame, levels: DataFrame) -> DataFrame:
    """``(y, x, year, duration, mean_depth, max_depth)`` over ``ground(y, x, z, threshold)`` on the days over ``threshold``."""
    o = over_levels(ground, levels.select(F.year("date").alias("year"), "level"), ["year"]).filter("_n > 0")
    return o.select("y", "x", "year", F.col("_n").alias("duration"), F.round(F.col("_sum") / F.col("_n") - F.col("z"), 5).alias("mean_depth"), F.round(F.col("_top") - F.col("z"), 9).alias("max_depth"))


def dynamic_map(obs: DataFrame, thresholds: DataFrame, forced: float = 0.16) -> DataFrame:
    """Wet where the value is over the pixel's own threshold, or over ``forced``; pixels without a threshold are dry below it."""
    j = obs.join(thresholds.select("y", "x", "threshold"), ["y", "x"], "left")
    return j.select("y", "x", "date", F.when((F.col("value") > F.coalesce("threshold", F.lit(forced))) | (F.col("value") > forced), 2).otherwise(1).alias("cls"))


def dynamic_flood(obs: DataFrame) -> DataFrame:
    """The dynamic map in full: each pixel's own threshold, forced wet above 0.16, then isolated pixels take the other class."""
    from .grid import flip_isolated

    return flip_isolated(dynamic_map(obs, dynamic_threshold(obs)).select("date", "y", "x", "cls"))


def surface_water_rule(bands: DataFrame) -> DataFrame:
    """Two-tier rule over MNDWI, NIR and SWIR2 (fixed limits): conservative, or lenient with dark infrared."""
    m = F.col("MNDWI")
    wet = ((m > 0.123) | ((m > -0.5) & (F.col("nir") < 0.2) & (F.col("swir2") < 0.1)))
    return bands.filter(m.isNotNull()).select("y", "x", "date", F.when(wet, 2).otherwise(1).alias("cls"))


def radar_flood_index(obs: DataFrame) -> DataFrame:
    """(dry mean - min(wet season, dry min)) / their sum by pixel, and the variant with the wet maximum (vegetated)."""
    wet = F.month("date").between(5, 10)
    v = F.col("value")
    s = obs.groupBy("y", "x").agg(F.avg(F.when(~wet, v)).alias("d"), F.min(F.when(~wet, v)).alias("dmin"), F.min(F.when(wet, v)).alias("wmin"), F.max(F.when(wet, v)).alias("wmax"))
    low = F.least("wmin", "dmin")
    return s.select("y", "x", F.round((F.col("d") - low) / F.nullif(F.col("d") + low, F.lit(0.0)), 5).alias("flood_index"), F.round((F.col("wmax") - F.col("d")) / F.nullif(F.col("wmax") + F.col("d"), F.lit(0.0)), 5).alias("vegetated_index"))


def radar_flood_maps(index: DataFrame, flood: tuple[float, float], vegetated: tuple[float, float], steps: int) -> DataFrame:
    """Class 2 where an index is over its threshold, for ``steps`` thresholds from a first one on; ``(first, step)`` for both."""
    k = F.col("step")
    over = lambda c, t: F.when(F.col(c) > F.lit(t[0]) + k * F.lit(t[1]), 2).when(F.col(c).isNotNull(), 1)
    return index.withColumn("step", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(steps - 1).cast("long")))).select("y", "x", "step", over("flood_index", flood).alias("flood"), over("vegetated_index", vegetated).alias("vegetated"))


def bimodal_threshold(obs: DataFrame, start: float = 0.1, fallback: float = 0.123, least: int = 5, rounds: int = 100) -> DataFrame:
    """Threshold by pixel: the fixed point of the mean of the two class means, from ``start``; ``fallback`` without one.

    A pixel's history is bounded by its dates, so it is one group; the iteration runs over its sorted values.
    """
    import numpy as np
    import pyarrow as pa

    def run(t):
        v = np.sort(t.column("value").to_numpy())
        out = fallback
        if len(v) >= least:
            total, cut = np.concatenate([[0], np.cumsum(v)]), start
            for _ in range(rounds):
                k = int(np.searchsorted(v, cut, "left"))
                if k in (0, len(v)):
                    cut = fallback
                    break
                new = (total[k] / k + (total[-1] - total[k]) / (len(v) - k)) / 2
                if new == cut:
                    break
                cut = new
            out = cut
        return pa.table({"y": t.column("y").slice(0, 1), "x": t.column("x").slice(0, 1), "n": pa.array([len(v)], pa.int64()), "threshold": pa.array([round(float(out), 9)], pa.float64())})

    return obs.filter("value is not null").select("y", "x", "value").groupBy("y", "x").applyInArrow(run, "y int, x int, n bigint, threshold double")


def dynamic_threshold(obs: DataFrame) -> DataFrame:
    """Smaller of the bimodal threshold and mean + 2 std of the dry-season values; null with too few or too wet records."""
    base = obs.filter(~F.dayofyear("date").between(182, 300) & (F.col("value") >= -0.7))
    stats = base.groupBy("y", "x").agg(F.count("value").alias("n"), F.avg("value").alias("m"), F.stddev_pop("value").alias("s"), F.count_if(F.col("value") < 0.123).alias("dry"))
    j = stats.join(bimodal_threshold(base).select("y", "x", F.col("threshold").alias("b")), ["y", "x"], "left")
    t = F.when((F.col("n") >= 5) & (F.col("dry") >= 0.5 * F.col("n")), F.least(F.col("b"), F.col("m") + 2 * F.col("s")))
    return j.select("y", "x", F.round(t, 9).alias("threshold"))


def level_trend(levels: DataFrame) -> DataFrame:
    """Signed run length of a rising (+) or falling (-) level by year; 0 at extremes and where it is flat."""
    by_year = Window.partitionBy("year").orderBy("date")
    d = levels.withColumn("year", F.year("date")).withColumn("step", F.signum(F.col("level") - F.lag("level").over(by_year)))
    d = d.withColumn("next", F.lead("step").over(by_year))
    d = d.withColumn("sign", F.when(F.col("step").isNull() | F.col("next").isNull() | (F.col("step") != F.col("next")) | (F.col("step") == 0), 0).otherwise(F.col("step")).cast("int"))
    d = d.withColumn("new", F.coalesce(F.col("sign") != F.lag("sign").over(by_year), F.lit(True)).cast("int")).withColumn("run", F.sum("new").over(by_year))
    at = F.row_number().over(Window.partitionBy("year", "run").orderBy("date"))
    return d.withColumn("trend", (F.col("sign") * at).cast("int")).select("date", "level", "trend")
