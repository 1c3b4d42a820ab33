"""Inundation models on cells: refinement of boundary levels, completion and repair over regions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import stage
from .bottleneck import bottleneck_levels
from .flood import year_depths
from .grid import edge_status, neighbours, offsets, regions, touching


def refine_levels(levels: DataFrame, river: DataFrame, radius: int = 5, nearest: int = 10) -> DataFrame:
    """Boundary levels smoothed inside of steps: cells of status 0 take the inverse-square mean of the nearest lower and
    higher cells within ``radius``; cells at an edge or the river keep their level. ``levels(y, x, level)``.
    """
    st = edge_status(levels, river)
    inner = st.filter("status = 0").select("y", "x", "level")
    around = inner.withColumn("_o", F.explode(offsets(radius)))
    around = around.select("y", "x", "level", (F.col("y") + F.col("_o.dy")).alias("_y"), (F.col("x") + F.col("_o.dx")).alias("_x"), (F.col("_o.dy") * F.col("_o.dy") + F.col("_o.dx") * F.col("_o.dx")).alias("_d"))
    j = around.join(levels.select(F.col("y").alias("_y"), F.col("x").alias("_x"), F.col("level").alias("_l")), ["_y", "_x"])

    def side(keep):
        return F.slice(F.array_sort(F.collect_list(F.when(keep, F.struct("_d", "_y", "_x", "_l")))), 1, nearest)

    g = j.groupBy("y", "x", "level").agg(side(F.col("_l") < F.col("level")).alias("lo"), side(F.col("_l") > F.col("level")).alias("hi"))
    both = F.concat("lo", "hi")
    top = F.aggregate(both, F.lit(0.0), lambda a, e: a + e["_l"] / e["_d"])
    low = F.aggregate(both, F.lit(0.0), lambda a, e: a + 1.0 / e["_d"])
    smooth = g.select("y", "x", F.when((F.size("lo") > 0) & (F.size("hi") > 0), F.round(top / low, 6)).alias("_new"))
    return st.join(smooth, ["y", "x"], "left").select("y", "x", "status", F.coalesce("_new", "level").alias("level"))


def complete_annual(seasons: DataFrame, dem: DataFrame) -> DataFrame:
    """Annual flood cells completed over no-data: each wet region grows over connected no-data cells in rising terrain
    order, up to its own highest ground, until it meets another region. ``seasons(y, x, year, cls)`` with 1 or 2; cells
    without a row have no data. ``region`` is the smallest cell id of the wet region that a cell belongs to.

    A no-data cell is of the region that reaches it at the lowest level; a region meets another at the lowest level at
    which their cells are neighbours, and grows over what it reaches below that.
    """
    cls = seasons.groupBy("y", "x", "year").agg(F.max("cls").alias("cls"))
    years = cls.select("year").distinct()
    cells = dem.crossJoin(F.broadcast(years)).join(cls, ["y", "x", "year"], "left")  # a row for each year
    wet = stage(regions(cells.filter("cls = 2").select("y", "x", "year", "z"), "year"), "wet-regions")
    dry_less = cells.filter("cls is null").select("y", "x", "year", "z")
    beside = neighbours(wet, ["year"], 1, ["region"]).join(dry_less, ["year", "y", "x"], "left_semi")
    reached = bottleneck_levels(dry_less, beside.select("year", "y", "x", F.lit(float("-inf")).alias("start"), F.col("_region").alias("label")), "year")
    owned = stage(reached.select("year", "y", "x", "level", F.col("label").alias("region")).unionByName(wet.select(F.col("year").cast("long").alias("year"), "y", "x", F.lit(float("-inf")).alias("level"), "region")), "reached")
    met = neighbours(owned, ["year"], 1, ["region", "level"]).join(owned, ["year", "y", "x"]).filter("region <> _region")
    meets = met.groupBy("year", "region").agg(F.min(F.greatest("level", "_level")).alias("_meets"))
    lid = wet.groupBy("year", "region").agg(F.max("z").alias("_lid"))
    grown = owned.join(lid, ["year", "region"]).join(meets, ["year", "region"], "left").filter("level <= _lid and (_meets is null or level < _meets)")
    done = F.col("level") > float("-inf")
    return grown.select("y", "x", F.col("year").cast(cls.schema["year"].dataType).alias("year"), F.lit(2).alias("cls"), "region", done.alias("completed"))


def wet_levels(flood: DataFrame, levels: DataFrame) -> DataFrame:
    """``(y, x, year, seen)``: by pixel and year the distinct levels at which it was seen wet, rising."""
    wet = flood.filter("cls = 2").join(levels, "date")
    return wet.groupBy("y", "x", F.year("date").cast("long").alias("year")).agg(F.array_sort(F.collect_set("level")).alias("seen"))


def repair_depressions(seen: DataFrame, water: DataFrame, max_rounds: int = 100) -> DataFrame:
    """Lowest wet levels by year, without depressions: ``(y, x, year, min_wet, level, repaired)``.

    A region of equal level without a lower neighbour, in a flood that touches the water, is sunk: its cells take the
    next level at which they were seen wet, until no region is sunk; a cell without a further level gets null. That is
    the least rise after which each cell has a way to the water that never goes up, so the bottleneck level from the
    water replaces the regions: each round a cell takes its first wet level that isn't under it.
    ``seen`` as in ``wet_levels``; ``water(y, x)`` is permanent, below all levels.
    """
    river = water.select("y", "x").distinct()
    own = seen.join(river, ["y", "x"], "left_anti").withColumn("at", F.lit(0))
    years = seen.select("year").distinct()
    base = river.crossJoin(F.broadcast(years)).withColumn("z", F.lit(-1e300))  # a row for each year
    level = F.try_element_at("seen", F.col("at") + 1)
    state, first = stage(own, "wet-levels"), True
    for _ in range(max_rounds):
        ground = state.select("y", "x", "year", level.alias("z")).filter("z is not null").unionByName(base)
        way = bottleneck_levels(ground, base.select("y", "x", "year", F.col("z").alias("start"), F.lit(0).alias("label")), "year").select("y", "x", "year", F.col("level").alias("_way"))
        j = state.join(way, ["y", "x", "year"], "left")
        if first:  # what no water reaches from the start stays as it is
            j = j.withColumn("fixed", F.col("_way").isNull())
        under = F.when(F.col("_way").isNull(), F.size("seen")).otherwise(F.size(F.filter("seen", lambda v: v < F.col("_way"))))
        at = F.when(F.col("fixed") | (F.col("at") >= F.size("seen")), F.col("at")).otherwise(F.greatest(F.col("at"), under))
        new = stage(j.select("y", "x", "year", "seen", at.alias("at"), "fixed", (at != F.col("at")).alias("moved")), "wet-levels")
        state, first = new.drop("moved"), False
        if new.filter("moved").isEmpty():
            break
    else:
        raise RuntimeError(f"levels did not settle in {max_rounds} rounds")
    return state.select("y", "x", "year", F.element_at("seen", 1).alias("min_wet"), level.alias("level"), (F.col("at") > 0).alias("repaired"))


def connection_levels(dem: DataFrame, river: DataFrame) -> DataFrame:
    """``(y, x, z, threshold)``: the level over which a cell is joined to the river over wet cells, once for all days."""
    source = river.select("y", "x", F.lit(float("-inf")).alias("start"), F.lit(0).alias("label"))
    return dem.join(bottleneck_levels(dem, source).select("y", "x", F.col("level").alias("threshold")), ["y", "x"])


def seeded_fill(dem: DataFrame, levels: DataFrame, seed: tuple[int, int]) -> DataFrame:
    """By day: the wet cells (level over ground) connected with the seed cell, and their depth.

    A day is a comparison with the level from which a cell is connected; the rows are the result's own.
    """
    start = dem.filter((F.col("y") == seed[0]) & (F.col("x") == seed[1]))
    j = connection_levels(dem, start).join(levels, F.col("level") > F.col("threshold"))
    return j.select("y", "x", "date", F.round(F.col("level") - F.col("z"), 9).alias("depth"))


def connected_inundation(dem: DataFrame, levels: DataFrame, river: DataFrame) -> DataFrame:
    """Bathtub with connectivity: by day only wet cells connected with the river count; duration and depths by pixel and year."""
    return year_depths(connection_levels(dem, river), levels)


def refine_topography(wet: DataFrame, dem: DataFrame, river: DataFrame) -> DataFrame:
    """Lowest level by pixel at which it was at the edge of a region that touches the river, beside the terrain.

    ``wet(y, x, date, level)``; ``(y, x, level, bias)``.
    """
    kept = touching(regions(wet, "date"), ["date"], river)
    n = neighbours(kept, ["date"], 1, []).groupBy("date", "y", "x").agg(F.count(F.lit(1)).alias("n"))
    edge = kept.join(n, ["date", "y", "x"], "left").filter(F.coalesce("n", F.lit(0)) < 8)
    low = edge.groupBy("y", "x").agg(F.min("level").alias("level"))
    return low.join(dem, ["y", "x"]).select("y", "x", "level", F.round(F.col("level") - F.col("z"), 9).alias("bias"))

