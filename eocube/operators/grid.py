"""Neighbourhoods and connected regions of cells ``(y, x)``, by date where ``keys`` says so.

Neighbours come by exploding the fixed offsets and one equality join; regions by components of an edge table.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import stage
from .components import connected_components
from .ranks import ranks


def offsets(half: int, centre: bool = False, four: bool = False) -> Column:
    cells = [(dy, dx) for dy in range(-half, half + 1) for dx in range(-half, half + 1) if (centre or dy or dx) and not (four and dy and dx)]
    return F.array(*[F.struct(F.lit(dy).alias("dy"), F.lit(dx).alias("dx")) for dy, dx in cells])


def neighbours(cells: DataFrame, keys: list[str], half: int, columns: list[str], centre: bool = False) -> DataFrame:
    """``(keys, y, x, _<column>..)``: a row for each cell with a neighbour, named by where the neighbour stands."""
    moved = cells.select(*keys, "y", "x", *[F.col(c).alias(f"_{c}") for c in columns], F.explode(offsets(half, centre)).alias("o"))
    return moved.select(*keys, (F.col("y") + F.col("o.dy")).alias("y"), (F.col("x") + F.col("o.dx")).alias("x"), *[f"_{c}" for c in columns])


def flip_isolated(flood: DataFrame, half: int = 2) -> DataFrame:
    """A pixel whose whole window (of valid cells) is of the other class takes that class."""
    wet = F.col("cls") == 2
    w = window_sums(flood, ["date"], {"_n": F.lit(1), "_w": wet.cast("int")}, half)
    near, near_wet = F.col("_n") - 1, F.col("_w") - wet.cast("int")
    return w.select("date", "y", "x", F.when((near > 0) & wet & (near_wet == 0), 1).when((near > 0) & ~wet & (near_wet == near), 2).otherwise(F.col("cls")).alias("cls"))


def neighbour_sum(cells: DataFrame, keys: list[str], value: str, half: int) -> DataFrame:
    """Sum over the window without its centre, for every cell that is in the table."""
    s = neighbours(cells, keys, half, [value]).groupBy(*keys, "y", "x").agg(F.sum(f"_{value}").alias("s"), F.count(f"_{value}").alias("n"))
    return cells.join(s, [*keys, "y", "x"], "left").select(*keys, "y", "x", value, F.round(F.coalesce("s", F.lit(0.0)), 9).alias("near_sum"), F.coalesce("n", F.lit(0)).alias("n_near"))


def window_sums(cells: DataFrame, keys: list[str], sums: dict[str, Column], half: int, only: Column | None = None) -> DataFrame:
    """``cells`` with sums over the square window around each, itself among them: added up along y, then along x.

    Running sums along x make any width one pass; along y a cell is copied to the window's height (where ``only`` holds).
    ``cells`` has each (keys, y, x) once.
    """
    added = cells if only is None else cells.filter(only)
    spread = added.select(*keys, F.col("y").alias("_y"), "x", *[c.alias(n) for n, c in sums.items()], F.explode(F.sequence(F.lit(-half), F.lit(half))).alias("_d"))
    spread = spread.select(*keys, (F.col("_y") + F.col("_d")).alias("y"), "x", F.lit(None).cast(cells.select(F.struct(*cells.columns).alias("r")).schema["r"].dataType).alias("_row"), *[F.col(n).cast("bigint").alias(n) for n in sums])
    own = cells.select(*keys, "y", "x", F.struct(*[F.col(c) for c in cells.columns]).alias("_row"), *[F.lit(0).cast("bigint").alias(n) for n in sums])
    along = Window.partitionBy(*keys, "y").orderBy("x").rangeBetween(-half, half)  # a row of the grid
    both = own.unionByName(spread).withColumns({n: F.sum(n).over(along) for n in sums})
    return both.filter("_row is not null").select("_row.*", *sums)


def window_count(cells: DataFrame, keys: list[str], flag: str, half: int, name: str) -> DataFrame:
    """``cells`` with the number of flagged cells in the window around each, without itself."""
    own = F.col(flag).cast("int")
    return window_sums(cells, keys, {name: own}, half, F.col(flag)).withColumn(name, F.col(name) - own)


def drop_sole(cells: DataFrame, keys: list[str], half: int = 1) -> DataFrame:
    """Cells without any other cell in their window go."""
    return cells.join(neighbours(cells, keys, half, []).distinct(), [*keys, "y", "x"], "left_semi")


def edge_status(levels: DataFrame, river: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """-1 next to the river, 1 where a 3x3 neighbour is missing or higher, else 0; ``levels(keys, y, x, level)``."""
    keys = keys or []
    n = neighbours(levels, keys, 1, ["level"]).groupBy(*keys, "y", "x").agg(F.count(F.lit(1)).alias("n"), F.max("_level").alias("hi"))
    r = neighbours(river.select("y", "x"), [], 1, [], centre=True).distinct().withColumn("_river", F.lit(True))
    j = levels.join(n, [*keys, "y", "x"], "left").join(r, ["y", "x"], "left")
    up = (F.coalesce("n", F.lit(0)) < 8) | (F.col("hi") > F.col("level"))
    return j.select(*keys, "y", "x", "level", F.when(F.col("_river"), -1).when(up, 1).otherwise(0).alias("status"))


def window_mean(cells: DataFrame, points: DataFrame, keys: list[str], half: int) -> DataFrame:
    """Mean of the (2 half + 1) squared window around each point's cell; null outside. ``points(.., y, x)``."""
    p = points.withColumn("_p", F.struct(*[F.col(c) for c in points.columns])).withColumn("o", F.explode(offsets(half, True)))
    p = p.select("_p", (F.col("y") + F.col("o.dy")).alias("y"), (F.col("x") + F.col("o.dx")).alias("x"))
    return p.join(cells.select(*keys, "y", "x", "value"), ["y", "x"], "left").groupBy("_p", *keys).agg(F.round(F.avg("value"), 9).alias("value"), F.count("value").alias("n")).select("_p.*", *keys, "value", "n")


_SIDE = 1 << 20


def cell_id(key: Column | None = None) -> Column:
    """One number for (key, y, x): key of up to 2^23 values, y and x under 2^20."""
    c = F.col("y").cast("long") * _SIDE + F.col("x")
    return c if key is None else key.cast("long") * (_SIDE * _SIDE) + c


TILE = 64  # cells along a tile's side
KEYS = 16  # values of the key whose cells are held together; cells of different ones are never neighbours


def with_tiles(cells: DataFrame, key: Column, width: int) -> DataFrame:
    """``cells`` with their tile ``_t, _ty, _tx`` and ``mine``; a cell at a tile's border also goes to the tiles beside it (not ``mine``)."""
    side = lambda v: F.array_compact(F.array(F.lit(0), F.when(F.col(v) % width == 0, -1), F.when(F.col(v) % width == width - 1, 1)))
    at = cells.withColumn("_oy", F.explode(side("y"))).withColumn("_ox", F.explode(side("x")))
    place = {"_t": F.floor(key / KEYS).cast("bigint"), "_ty": F.floor(F.col("y") / width) + F.col("_oy"), "_tx": F.floor(F.col("x") / width) + F.col("_ox"), "mine": (F.col("_oy") == 0) & (F.col("_ox") == 0)}
    return at.withColumns(place).drop("_oy", "_ox")


def _tile_regions(eight: bool):
    """One tile of ``(id, mine)``: ``(0, cell, root)`` for its cells, and ``(1, root, cell)`` for cells that other tiles hold as well."""

    def run(t: pa.Table) -> pa.Table:
        ids, first = np.unique(t.column("id").to_numpy(), return_index=True)
        mine = t.column("mine").to_numpy(zero_copy_only=False)[first]
        shared = t.column("shared").to_numpy(zero_copy_only=False)[first]
        u, v = [], []
        for o in [1, _SIDE] + ([_SIDE + 1, _SIDE - 1] if eight else []):
            at = np.minimum(np.searchsorted(ids, ids + o), len(ids) - 1)
            i = np.flatnonzero(ids[at] == ids + o)
            u.append(i)
            v.append(at[i])
        u, v, root = np.concatenate(u), np.concatenate(v), np.arange(len(ids))
        while True:  # the smaller label spreads over edges; jumping halves the way
            new = root.copy()
            np.minimum.at(new, u, root[v])
            np.minimum.at(new, v, root[u])
            new = new[new]
            if (new == root).all():
                break
            root = new
        own, far = np.flatnonzero(mine), np.flatnonzero((~mine | shared) & (ids != ids[root]))
        kind = np.repeat(np.array([0, 1], np.int32), [len(own), len(far)])
        return pa.table({"kind": pa.array(kind), "a": pa.array(np.concatenate([ids[own], ids[root[far]]])), "b": pa.array(np.concatenate([ids[root[own]], ids[far]]))})

    return run


def regions(cells: DataFrame, key: str | None = None, eight: bool = True, tile: int | None = None) -> DataFrame:
    """``cells`` with ``region``: the smallest cell id of the 4- or 8-connected region, within each value of ``key`` (a whole number or date).

    Tiles label their cells by themselves; only regions that lie in several tiles are joined by components, over one edge
    for each cell at a tile's border.
    """
    width = tile or TILE
    k = F.lit(0) if key is None else F.unix_date(key) if dict(cells.dtypes)[key] == "date" else F.col(key)
    c = cells.withColumn("_id", cell_id(None if key is None else k))
    border = (F.col("y") % width).isin(0, width - 1) | (F.col("x") % width).isin(0, width - 1)
    t = with_tiles(c.select("y", "x", F.col("_id").alias("id"), k.alias("_k"), border.alias("shared")), F.col("_k"), width)
    found = stage(t.groupBy("_t", "_ty", "_tx").applyInArrow(_tile_regions(eight), "kind int, a bigint, b bigint"), "tile-regions")
    across, named = found.filter("kind = 1"), found.filter("kind = 0").select(F.col("a").alias("_id"), F.col("b").alias("_root"))
    if across.isEmpty():
        return c.join(named, "_id").withColumn("region", F.col("_root")).drop("_id", "_root")
    joined = connected_components(across.select("a", "b"), "a", "b")
    named = named.join(joined, F.col("_root") == F.col("node"), "left").select("_id", F.coalesce("component", "_root").alias("_root"))
    return c.join(named, "_id").withColumn("region", F.col("_root")).drop("_id", "_root")


def region_sizes(labelled: DataFrame, key: list[str], cell_area: float = 900.0) -> DataFrame:
    return labelled.groupBy(*key, "region").agg(F.count(F.lit(1)).alias("n"), (F.count(F.lit(1)) * cell_area).alias("area"))


def drop_small(labelled: DataFrame, key: list[str], least: int) -> DataFrame:
    big = region_sizes(labelled, key).filter(F.col("n") >= least).select(*key, "region")
    return labelled.join(big, [*key, "region"], "left_semi")


def largest_region(labelled: DataFrame, key: list[str]) -> DataFrame:
    """Cells of the largest region by key; of equals the one with the smallest id."""
    best = region_sizes(labelled, key).groupBy(*key).agg(F.max_by("region", F.struct("n", -F.col("region"))).alias("region")) if key else region_sizes(labelled, key).agg(F.max_by("region", F.struct("n", -F.col("region"))).alias("region"))
    return labelled.join(best, [*key, "region"], "left_semi")


def touching(labelled: DataFrame, key: list[str], seeds: DataFrame) -> DataFrame:
    """Cells of the regions that have a seed cell ``(y, x)``."""
    hit = labelled.join(seeds.select("y", "x").distinct(), ["y", "x"], "left_semi").select(*key, "region").distinct()
    return labelled.join(hit, [*key, "region"], "left_semi")


def extremes(labelled: DataFrame, key: list[str], width: str) -> DataFrame:
    """By region: members, summed width, leftmost and rightmost cell (the upper of equals)."""
    cell = F.struct("y", "x")
    return labelled.groupBy(*key, "region").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum(width), 9).alias("width"), F.min_by(cell, F.struct("x", "y")).alias("l"), F.max_by(cell, F.struct(F.col("x"), -F.col("y"))).alias("r")).select(*key, "region", "n", "width", F.col("l.y").alias("left_y"), F.col("l.x").alias("left_x"), F.col("r.y").alias("right_y"), F.col("r.x").alias("right_x"))


def numbered_floods(labelled: DataFrame, water: DataFrame, least_area: float, cell_area: float = 900.0) -> DataFrame:
    """``(y, x, flood_id)``: regions that touch permanent-water regions of at least ``least_area`` are numbered from 1, others get 0."""
    lakes = regions(water.select("y", "x"))
    lakes = lakes.join(region_sizes(lakes, [], cell_area).filter(F.col("area") >= least_area).select("region"), "region", "left_semi")
    hit = touching(labelled, [], lakes).select("region").distinct()
    ids = ranks(hit, [], ["region"]).select("region", (F.col("_rank") + 1).cast("int").alias("flood_id"))
    return labelled.join(ids, "region", "left").select("y", "x", F.coalesce("flood_id", F.lit(0)).alias("flood_id"))


def semivariogram(cells: DataFrame, lag: int) -> DataFrame:
    """Half the mean squared difference at a horizontal or vertical lag."""
    moved = cells.select(F.explode(F.array(F.struct((F.col("y") + lag).alias("y"), F.col("x").alias("x")), F.struct(F.col("y").alias("y"), (F.col("x") + lag).alias("x")))).alias("o"), F.col("value").alias("_v")).select("o.y", "o.x", "_v")
    return moved.join(cells, ["y", "x"]).agg(F.lit(lag).alias("lag"), F.count(F.lit(1)).alias("pairs"), F.round(F.avg(F.pow(F.col("value") - F.col("_v"), 2)) / 2, 9).alias("gamma"))
