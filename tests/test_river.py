"""Places on polylines, assigned gauges and ground between two gauges, against brute force."""

import datetime
import math
import random

import pytest
from pyspark.sql import functions as F

from eocube.operators import linear as L

LINE = [(1, 1, 0.0, 0.0), (1, 2, 4.0, 0.0), (1, 3, 4.0, 3.0), (2, 1, 20.0, 20.0), (2, 2, 30.0, 20.0)]


def lines(spark, rows=LINE):
    return L.segments(spark.createDataFrame(rows, "line int, seq int, x double, y double"))


def test_places_by_hand(spark):
    at = [(1, 2.0, 1.0), (2, 5.0, 2.0), (3, -3.0, -4.0), (4, 4.0, 0.0), (5, 25.0, 26.0), (6, 400.0, 20.0)]
    rows = L.locate(spark.createDataFrame(at, "id int, px double, py double"), lines(spark)).orderBy("id").collect()
    assert [(r.line, r.seg, r.chainage, r.distance, r.side) for r in rows] == [(1, 1, 2.0, 1.0, 1), (1, 2, 6.0, 1.0, -1), (1, 1, 0.0, 5.0, -1), (1, 1, 4.0, 0.0, 0), (2, 1, 5.0, 6.0, 1), (2, 1, 10.0, 370.0, 0)]
    back = L.point_at(lines(spark), spark.createDataFrame([(1, 5.5), (1, 0.0), (1, 7.0), (1, 7.5), (2, 10.0)], "line int, chainage double"))
    assert sorted((r.line, r.chainage, r.px, r.py) for r in back.collect()) == [(1, 0.0, 0.0, 0.0), (1, 5.5, 4.0, 1.5), (1, 7.0, 4.0, 3.0), (2, 10.0, 30.0, 20.0)]


def test_no_points_or_lines(spark):
    points = spark.createDataFrame([(1, 2.0, 1.0)], "id int, px double, py double")
    assert L.locate(points.limit(0), lines(spark)).collect() == [] and L.locate(points, lines(spark, LINE[:1])).collect() == []


def test_places_on_random_lines(spark):
    rnd = random.Random(2)
    rows = [(k, i, rnd.uniform(0, 60), rnd.uniform(0, 60)) if rnd.random() < 0.3 else (k, i, 30 + 9 * k + rnd.random(), 2.0 * i) for k in (1, 2, 3) for i in range(25)]
    points = [(i, rnd.uniform(-40, 130), rnd.uniform(-40, 130)) for i in range(150)]
    got = {r.id: r for r in L.locate(spark.createDataFrame(points, "id int, px double, py double"), lines(spark, rows)).collect()}
    assert len(got) == len(points)
    for i, px, py in points:
        best = (math.inf, 0)
        for k in (1, 2, 3):
            at, own = 0.0, [r[2:] for r in rows if r[0] == k]
            for (ax, ay), (bx, by) in zip(own, own[1:]):
                n = math.hypot(bx - ax, by - ay)
                t = min(1, max(0, ((px - ax) * (bx - ax) + (py - ay) * (by - ay)) / n**2))
                best = min(best, (math.hypot(px - ax - t * (bx - ax), py - ay - t * (by - ay)), at + t * n))
                at += n
        assert got[i].distance == pytest.approx(best[0], abs=1e-8) and got[i].chainage == pytest.approx(best[1], abs=1e-5)


def river(spark, years=(2001, 2002, 2003), missing=((2, 2002),)):
    rnd = random.Random(8)
    gauges = [(s, at, y) for s, at in ((1, 10.0), (2, 20.0), (3, 45.0)) for y in years if (s, y) not in missing]
    days = [(s, datetime.date(y, 1, 1) + datetime.timedelta(i), rnd.randrange(1000) / 10) for s, _, y in gauges for i in range(40)]
    return gauges, days, spark.createDataFrame(gauges, "station int, chainage double, year int"), spark.createDataFrame(days, "station int, date date, level double")


def level_at(gauges, days, chainage):
    """Daily levels at a place, gauge by gauge and year by year."""
    out = {}
    for year in {g[2] for g in gauges}:
        own = sorted((at, s) for s, at, y in gauges if y == year)
        k = max(1, min(sum(at <= chainage for at, _ in own), len(own) - 1))
        (lo, s0), (hi, s1) = own[k - 1], own[k]
        a, b = ({d: v for s, d, v in days if s == x and d.year == year} for x in (s0, s1))
        out |= {d: a[d] + (b[d] - a[d]) * ((chainage - lo) / (hi - lo)) for d in a.keys() & b.keys()}
    return out


def test_levels_by_pixel(spark):
    gauges, days, g, s = river(spark)
    places = [(i, v) for i, v in enumerate([2.0, 10.0, 14.5, 20.0, 33.0, 45.0, 60.0])]
    got = {(r.id, r.date): r.level for r in L.pixel_levels(spark.createDataFrame(places, "id int, chainage double"), g, s).collect()}
    want = {(i, d): v for i, at in places for d, v in level_at(gauges, days, at).items()}
    assert got.keys() == want.keys() and all(got[k] == pytest.approx(v, abs=1e-8) for k, v in want.items())


@pytest.mark.parametrize("bucket", [2000, 5])
def test_ground_between_two_gauges(spark, bucket):
    gauges, days, g, s = river(spark)
    rnd = random.Random(bucket)
    pixels = [(i // 12, i % 12, rnd.uniform(0, 60), wet := rnd.randrange(0, 31), 30) for i in range(130)]
    got = {(r.y, r.x): r.z for r in L.ground_from_frequency(spark.createDataFrame(pixels, "y int, x int, chainage double, n_wet int, n int"), g, s, bucket).collect()}
    want = {}
    for y, x, at, wet, n in pixels:
        level = sorted(level_at(gauges, days, at).values())
        if 0 < wet < n:
            want[y, x] = level[len(level) * (n - wet) // n]
    assert got.keys() == want.keys() and all(got[k] == pytest.approx(v, abs=1e-7) for k, v in want.items())


def test_distance_along(spark):
    at = L.locate(spark.createDataFrame([(1, 1.0, 1.0), (2, 4.5, 2.5), (3, 22.0, 20.0)], "id int, px double, py double"), lines(spark))
    pairs = spark.createDataFrame([(1, 2), (1, 3)], "a int, b int")
    assert [tuple(r) for r in L.along(pairs, at, "id").collect()] == [(1, 2, 5.5)]
    assert L.locate(at.select("id", "px", "py"), lines(spark)).filter(F.col("distance") > 2).count() == 0
