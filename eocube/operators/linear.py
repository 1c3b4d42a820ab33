"""Linear referencing: positions on polylines, distances along them, and water levels between the gauges of a river."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import stage
from .hydro import nearest_gauges


def segments(line: DataFrame, by: str = "line", order: str = "seq") -> DataFrame:
    """``(by, seg, ax, ay, bx, by_, at)``: the pieces between consecutive vertices, with the chainage where each starts."""
    w = Window.partitionBy(by).orderBy(order)  # a line's vertices
    d = line.select(by, F.col(order).alias("seg"), F.col("x").alias("ax"), F.col("y").alias("ay"), F.lead("x").over(w).alias("bx"), F.lead("y").over(w).alias("by_"))
    d = d.filter("bx is not null").withColumn("_len", F.hypot(F.col("bx") - F.col("ax"), F.col("by_") - F.col("ay")))
    w = Window.partitionBy(by).orderBy("seg").rowsBetween(Window.unboundedPreceding, -1)
    return d.withColumn("at", F.coalesce(F.sum("_len").over(w), F.lit(0.0))).drop("_len")


def locate(points: DataFrame, segs: DataFrame, by: str = "line") -> DataFrame:
    """``points(.., px, py)`` with the nearest place on the lines: ``by``, ``seg``, ``chainage``, ``distance`` and ``side``
    (1 left of the line's direction, -1 right, 0 on it). Of equal distances the smaller line and segment count.

    Segments are laid into all tiles of their bounding boxes. A point looks into its tile and those around it; where
    what it finds is farther than the ring surely reaches, the ring is doubled. So results are exact, and no point meets
    all segments. Without segments the result is empty.
    """
    r = segs.agg(
        F.count(F.lit(1)), F.avg(F.hypot(F.col("bx") - F.col("ax"), F.col("by_") - F.col("ay"))),
        F.min(F.least("ax", "bx")), F.max(F.greatest("ax", "bx")), F.min(F.least("ay", "by_")), F.max(F.greatest("ay", "by_")),
    ).first()
    c = points.agg(F.min("px"), F.max("px"), F.min("py"), F.max("py")).first()
    names = [by, "seg", "chainage", "distance", "side"]
    if not r[0] or c[0] is None:
        return points.limit(0).select("*", *[F.lit(None).cast(t).alias(n) for n, t in zip(names, (segs.schema[by].dataType, segs.schema["seg"].dataType, "double", "double", "int"))])
    side = max(r[1], ((r[3] - r[2]) * (r[5] - r[4]) / r[0]) ** 0.5, 1e-9)
    widest = max(r[3], c[1]) - min(r[2], c[0]) + max(r[5], c[3]) - min(r[4], c[2]) + 2 * side
    tile = lambda v: F.floor(v / side).cast("long")
    span = lambda a, b: F.explode(F.sequence(tile(F.least(a, b)), tile(F.greatest(a, b))))
    tiles = segs.withColumn("_tx", span("ax", "bx")).withColumn("_ty", span("ay", "by_"))
    dx, dy, rx, ry = F.col("bx") - F.col("ax"), F.col("by_") - F.col("ay"), F.col("px") - F.col("ax"), F.col("py") - F.col("ay")
    t = F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.coalesce((rx * dx + ry * dy) / F.nullif(dx * dx + dy * dy, F.lit(0.0)), F.lit(0.0))))
    far = F.hypot(rx - t * dx, ry - t * dy)
    place = F.struct(F.round(far, 9).alias("distance"), by, "seg", F.round(F.col("at") + t * F.hypot(dx, dy), 6).alias("chainage"), F.signum(F.round(dx * ry - dy * rx, 9)).cast("int").alias("side"))
    left, done, ring = points.select(F.struct(*points.columns).alias("_p"), "px", "py"), None, 1
    while True:
        last = ring * side >= widest
        near = F.sequence(F.lit(-ring), F.lit(ring))
        looked = left.withColumn("_ox", F.explode(near)).withColumn("_oy", F.explode(near)).select("_p", "px", "py", (tile(F.col("px")) + F.col("_ox")).alias("_tx"), (tile(F.col("py")) + F.col("_oy")).alias("_ty"))
        found = looked.join(tiles, ["_tx", "_ty"]).groupBy("_p").agg(F.min(place).alias("_f"))
        sure = stage(found if last else found.filter(F.col("_f.distance") <= ring * side), "located")
        done = sure if done is None else done.unionByName(sure)
        left = stage(left.join(sure.select("_p"), "_p", "left_anti"), "points-left")
        if last or left.isEmpty():
            return done.select("_p.*", *[f"_f.{n}" for n in names])
        ring *= 2


def point_at(segs: DataFrame, places: DataFrame, by: str = "line") -> DataFrame:
    """``places(.., by, chainage)`` with the point ``(px, py)`` there; places beyond the ends of a line have none and go.

    Segments and places meet by slices of chainage.
    """
    step = segs.agg(F.avg(F.hypot(F.col("bx") - F.col("ax"), F.col("by_") - F.col("ay")))).first()[0] or 1.0
    length = F.hypot(F.col("bx") - F.col("ax"), F.col("by_") - F.col("ay"))
    s = segs.withColumn("_len", length).filter("_len > 0").withColumn("_s", F.explode(F.sequence(F.floor(F.col("at") / step), F.floor((F.col("at") + F.col("_len")) / step))))
    j = places.withColumn("_s", F.floor(F.col("chainage") / step)).join(s, [by, "_s"]).filter("chainage >= at and chainage <= at + _len")
    w = (F.col("chainage") - F.col("at")) / F.col("_len")
    at = F.struct("seg", F.round(F.col("ax") + (F.col("bx") - F.col("ax")) * w, 6).alias("px"), F.round(F.col("ay") + (F.col("by_") - F.col("ay")) * w, 6).alias("py"))
    return j.groupBy(*places.columns).agg(F.min(at).alias("_m")).select(*places.columns, "_m.px", "_m.py")


def along(pairs: DataFrame, located: DataFrame, key: str) -> DataFrame:
    """``pairs(a, b)`` of located points of one line, with their ``distance`` along it."""
    side = lambda n: located.select(F.col(key).alias(n), F.col("line").alias(f"_l{n}"), F.col("chainage").alias(f"_c{n}"))
    j = pairs.join(side("a"), "a").join(side("b"), "b").filter("_la = _lb")
    return j.select("a", "b", F.round(F.abs(F.col("_ca") - F.col("_cb")), 6).alias("distance"))


def reaches(gauges: DataFrame) -> DataFrame:
    """``(reach, year, lower, lower_at, upper, upper_at)`` for ``gauges(station, chainage, year)``: between two gauges of
    the river, and beyond the outer ones, the gauges to use in a year are the same for every place."""
    at = gauges.groupBy().agg(F.array_sort(F.collect_set("chainage")).alias("c"))  # a river's gauges
    middle = F.transform(F.sequence(F.lit(0), F.size("c")), lambda i: F.when(i == 0, F.element_at("c", 1) - 1).when(i == F.size("c"), F.element_at("c", -1) + 1).otherwise((F.try_element_at("c", i) + F.try_element_at("c", i + 1)) / 2))
    places = at.filter("size(c) > 0").select(F.posexplode(middle).alias("place", "chainage"))
    return nearest_gauges(places, gauges).withColumnRenamed("place", "reach").drop("chainage")


def reach_of(places: DataFrame, gauges: DataFrame) -> DataFrame:
    """``places(.., chainage)`` with their ``reach``: the number of gauges at or below them."""
    at = gauges.groupBy().agg(F.array_sort(F.collect_set("chainage")).alias("_c"))  # one row
    return places.crossJoin(F.broadcast(at)).withColumn("reach", F.size(F.filter("_c", lambda v: v <= F.col("chainage")))).drop("_c")


def pair_levels(gauges: DataFrame, series: DataFrame) -> DataFrame:
    """``(reach, date, a, b, lower_at, upper_at)``: levels of both gauges of a reach on the days that both have."""
    g = series.select("station", "date", "level").withColumn("year", F.year("date"))
    j = reaches(gauges).join(g.select(F.col("station").alias("lower"), "year", "date", F.col("level").alias("a")), ["lower", "year"])
    return j.join(g.select(F.col("station").alias("upper"), "date", F.col("level").alias("b")), ["upper", "date"]).select("reach", "date", "a", "b", "lower_at", "upper_at")


def pixel_levels(places: DataFrame, gauges: DataFrame, series: DataFrame) -> DataFrame:
    """``places(.., chainage)`` by day with the ``level`` between (or beyond) the two gauges assigned to them in its year."""
    j = reach_of(places, gauges).join(pair_levels(gauges, series), "reach")
    w = (F.col("chainage") - F.col("lower_at")) / F.nullif(F.col("upper_at") - F.col("lower_at"), F.lit(0.0))
    return j.select(*places.columns, "date", F.round(F.col("a") + (F.col("b") - F.col("a")) * w, 9).alias("level"))


def _order_statistics(pixels: pa.Table, days: pa.Table) -> pa.Table:
    """One bucket: pixels of nearly the same chainage ``(y, x, chainage, n_wet, n)``, and the days of their reach."""
    a, b, lo, hi = (days.column(c).to_numpy() for c in ("a", "b", "lower_at", "upper_at"))
    c, wet, n = (pixels.column(k).to_numpy() for k in ("chainage", "n_wet", "n"))
    rank = len(a) * (n - wet) // n if len(n) else n
    z = np.full(len(c), np.nan)
    if len(a) and len(c):
        at = lambda x: a + (b - a) * ((x - lo) / (hi - lo))
        ends = np.stack([at(c.min()), at(c.max())])
        low, high = ends.min(axis=0), ends.max(axis=0)
        eps = 1e-9 * (1 + np.abs(ends).max())
        sorted_low, sorted_high = np.sort(low), np.sort(high)
        for k in np.unique(rank[(rank < len(a)) & (wet < n)]).tolist():
            # A day outside of these bounds is under or over the k-th level at every place of the bucket.
            bottom, top = sorted_low[k] - eps, sorted_high[k] + eps
            under, some = int((high < bottom).sum()), np.flatnonzero((high >= bottom) & (low <= top))
            mine = np.flatnonzero((rank == k) & (wet < n))
            w = (c[mine, None] - lo[some]) / (hi[some] - lo[some])
            z[mine] = np.partition(a[some] + (b[some] - a[some]) * w, k - under, axis=1)[:, k - under]
    known = ~np.isnan(z)
    return pa.table({"y": pixels.column("y").filter(pa.array(known)), "x": pixels.column("x").filter(pa.array(known)), "z": pa.array(np.round(z[known], 9))})


def ground_from_frequency(pixels: DataFrame, gauges: DataFrame, series: DataFrame, bucket: int = 2_000) -> DataFrame:
    """``(y, x, z)``: the ground of each pixel, from how often it was seen wet and the daily levels between its two gauges.

    ``pixels(y, x, chainage, n_wet, n)``; a pixel that was wet in a share f of its scenes lies at the level of rank
    ``days * (1 - f)`` (rounded down, from 0) of all its days; always and never wet pixels have no ground.

    A level at a place is a linear mix of two series. Pixels of a reach are dealt by chainage into buckets of about
    ``bucket``; the levels at a bucket's two ends bound each day's level in it, hence each rank, so all but the few days
    near the rank are only counted, once for the bucket. Days are repeated by bucket, not by pixel.
    """
    placed = reach_of(pixels, gauges)
    r = placed.agg(F.count(F.lit(1)), F.min("chainage"), F.max("chainage")).first()
    if not r[0]:
        return pixels.select("y", "x", F.lit(None).cast("double").alias("z"))
    step = max((r[2] - r[1]) / max(16, -(-r[0] // bucket)), 1e-9)
    p = placed.withColumn("bucket", F.floor(F.col("chainage") / step)).select("reach", "bucket", "y", "x", "chainage", F.col("n_wet").cast("long").alias("n_wet"), F.col("n").cast("long").alias("n"))
    p = stage(p, "placed")
    days = p.select("reach", "bucket").distinct().join(pair_levels(gauges, series), "reach")
    days = days.select(F.col("reach").alias("_reach"), F.col("bucket").alias("_bucket"), "a", "b", "lower_at", "upper_at")
    return p.groupBy("reach", "bucket").cogroup(days.groupBy("_reach", "_bucket")).applyInArrow(_order_statistics, "y int, x int, z double")
