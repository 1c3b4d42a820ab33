"""Bottleneck levels, completion, fills and depression repair against brute force on small random grids."""

import datetime
import heapq
import random

import pytest
from pyspark.sql import functions as F

from eocube.operators import flood as FL
from eocube.operators import inundation as I
from eocube.operators.bottleneck import bottleneck_levels
from eocube.operators.grid import regions

NEAR = [(dy, dx) for dy in (-1, 0, 1) for dx in (-1, 0, 1) if dy or dx]


def spread(ground, sources):
    """Lowest level at which each cell is reached, by a priority flood; cells are (key, y, x)."""
    out, queue = {}, [(max(w, ground[c]), c) for c, w in sources.items()]
    heapq.heapify(queue)
    while queue:
        level, (k, y, x) = heapq.heappop(queue)
        if (k, y, x) not in out:
            out[k, y, x] = level
            for dy, dx in NEAR:
                n = (k, y + dy, x + dx)
                if n in ground and n not in out:
                    heapq.heappush(queue, (max(level, ground[n]), n))
    return out


def components(cells):
    """Component's smallest cell of each (key, y, x)."""
    out = {}
    for c in sorted(cells):
        stack = [c] if c not in out else []
        while stack:
            k, y, x = stack.pop()
            if (k, y, x) not in out:
                out[k, y, x] = c
                stack += [(k, y + dy, x + dx) for dy, dx in NEAR if (k, y + dy, x + dx) in cells]
    return out


@pytest.mark.parametrize(("side", "tile", "high"), [(9, 4, 12), (26, 2, 40), (26, 64, 40), (20, 4, 4)])
def test_levels_of_random_ground(spark, side, tile, high):
    rnd = random.Random(side * tile)
    ground = {(k, y, x): float(rnd.randrange(high) - 2) for k in (1, 2) for y in range(side) for x in range(side) if rnd.random() < 0.8}
    sources = {c: float(rnd.randrange(high)) for c in rnd.sample(sorted(ground), 4)}
    cells = spark.createDataFrame([(*c, z) for c, z in ground.items()], "k int, y int, x int, z double")
    water = spark.createDataFrame([(*c, w, i) for i, (c, w) in enumerate(sources.items())], "k int, y int, x int, start double, label long")
    rows = bottleneck_levels(cells, water, "k", tile).collect()
    assert {(r.k, r.y, r.x): r.level for r in rows} == spread(ground, sources) and len(rows) == len({(r.k, r.y, r.x) for r in rows})
    one = list(sources)  # a named source reaches its cells at their level
    for r in rows[:60]:
        c = one[r.label]
        assert spread(ground, {c: sources[c]})[r.k, r.y, r.x] == r.level


@pytest.mark.parametrize(("tile", "eight", "share"), [(3, True, 0.45), (3, False, 0.6), (64, True, 0.4), (5, True, 0.9)])
def test_regions_over_tiles(spark, tile, eight, share):
    """Regions that wind through many tiles, by key; repeated cells stay; the smallest id names a region."""
    rnd = random.Random(tile)
    cells = {(k, y, x) for k in (3, 4) for y in range(17) for x in range(17) if rnd.random() < share}
    rows = sorted(cells) + [min(cells)]
    got = regions(spark.createDataFrame(rows, "k int, y int, x int"), "k", eight, tile).collect()
    near = NEAR if eight else [(0, 1), (1, 0), (0, -1), (-1, 0)]
    want = {}
    for c in sorted(cells):
        stack = [c] if c not in want else []
        while stack:
            k, y, x = e = stack.pop()
            if e not in want:
                want[e] = c[0] << 40 | c[1] << 20 | c[2]
                stack += [n for dy, dx in near if (n := (k, y + dy, x + dx)) in cells]
    assert len(got) == len(rows) and {(r.k, r.y, r.x): r.region for r in got} == want
    assert regions(spark.createDataFrame([], "y int, x int")).collect() == []


def test_levels_of_nothing(spark):
    cells, water = spark.createDataFrame([], "y int, x int, z double"), spark.createDataFrame([], "y int, x int, start double, label long")
    assert bottleneck_levels(cells, water).collect() == []
    some = spark.createDataFrame([(0, 0, 1.0)], cells.schema)
    assert bottleneck_levels(some, water).collect() == []
    assert [tuple(r) for r in bottleneck_levels(some, spark.createDataFrame([(0, 0, 5.0, 7), (3, 3, 0.0, 8)], water.schema)).collect()] == [(0, 0, 5.0, 7)]


def completed(spark, seasons, dem):
    s = spark.createDataFrame([(y, x, k, c) for (k, y, x), c in seasons.items()], "y int, x int, year int, cls int")
    return {(r.year, r.y, r.x): (r.region, r.completed) for r in I.complete_annual(s, spark.createDataFrame([(*c, z) for c, z in dem.items()], "y int, x int, z double")).collect()}


def test_completion_stops_behind_higher_ground(spark):
    dem = {(0, 0): 10.0, (0, 1): 50.0, (0, 2): 3.0, (0, 8): 100.0, (5, 0): 10.0, (5, 1): 8.0, (5, 2): 9.0, (5, 3): 11.0}
    got = completed(spark, {(1, 0, 0): 2, (1, 0, 8): 2, (1, 5, 0): 2}, dem)
    assert {c for c, (_, new) in got.items() if new} == {(1, 5, 1), (1, 5, 2)}


@pytest.mark.parametrize("seed", range(3))
def test_completion_of_random_maps(spark, seed):
    rnd = random.Random(seed)
    dem = {(y, x): float(rnd.randrange(25)) for y in range(11) for x in range(11)}
    seasons = {(k, y, x): rnd.choice([1, 2, 2]) for k in (5, 6) for y, x in dem if rnd.random() < 0.35}
    wet = components({c for c, v in seasons.items() if v == 2})
    free = {(k, y, x): z for k in (5, 6) for (y, x), z in dem.items() if (k, y, x) not in seasons}
    number = lambda c: c[0] << 40 | c[1] << 20 | c[2]
    want = {c: (number(r), False) for c, r in wet.items()}
    for region in set(wet.values()):
        own = [c for c, r in wet.items() if r == region]
        border = {(k, y + dy, x + dx) for k, y, x in own for dy, dx in NEAR} & free.keys()
        level = spread(free, dict.fromkeys(border, -1.0))
        meets = min((v for (k, y, x), v in level.items() if any(wet.get((k, y + dy, x + dx), region) != region for dy, dx in NEAR)), default=99.0)
        lid = max(dem[c[1:]] for c in own)
        for c, v in level.items():
            if v <= lid and v < meets:
                assert c not in want
                want[c] = (number(region), True)
    assert any(new for _, new in want.values())
    assert completed(spark, seasons, dem) == want


def repaired(seen, water):
    """Region by region: sunk ones take their next level until none is sunk."""
    at = dict.fromkeys(seen, 0)
    level = lambda c: -1e300 if c in water else seen[c][at[c]] if c in seen and at[c] < len(seen[c]) else None
    cells = set(seen) | water
    joined = components(cells)
    fixed = {c for c in seen if not any(joined[w] == joined[c] for w in water)}
    while True:
        moved, done = False, set()
        for c in sorted(set(seen) - water - fixed):
            if c in done or level(c) is None:
                continue
            region, stack = set(), [c]
            while stack:
                k, y, x = e = stack.pop()
                if e not in region and level(e) == level(c):
                    region.add(e)
                    stack += [n for dy, dx in NEAR if (n := (k, y + dy, x + dx)) in cells]
            around = {n for k, y, x in region for dy, dx in NEAR if (n := (k, y + dy, x + dx)) in cells} - region
            done |= region
            if not any(level(n) is not None and level(n) < level(c) for n in around):
                for e in region:
                    at[e] += 1
                moved = True
                break
        if not moved:
            return {c: (seen[c][0], level(c), at[c] > 0) for c in seen if c not in water}


@pytest.mark.parametrize("seed", range(3))
def test_repair_reaches_the_fixed_point(spark, seed):
    rnd = random.Random(seed)
    seen = {(k, y, x): sorted(rnd.sample(range(30), rnd.randrange(1, 6))) for k in (1, 2) for y in range(8) for x in range(8) if rnd.random() < 0.7}
    seen = {c: [float(v) for v in vs] for c, vs in seen.items()}
    spots = {(y, 0) for y in range(0, 8, 3)}
    water = {(k, *s) for k in (1, 2) for s in spots}
    rows = spark.createDataFrame([(y, x, k, vs) for (k, y, x), vs in seen.items()], "y int, x int, year long, seen array<double>")
    got = {(r.year, r.y, r.x): (r.min_wet, r.level, r.repaired) for r in I.repair_depressions(rows, spark.createDataFrame(sorted(spots), "y int, x int")).collect()}
    want = repaired(seen, water)
    assert got == want and any(r for _, _, r in want.values()) and any(v is None for _, v, _ in want.values())


def test_repair_by_hand(spark):
    # Water, a step of 5, a hole of 3 seen again at 4 and 6, and a cell that no water reaches.
    rows = spark.createDataFrame([(0, 1, 1, [5.0]), (0, 2, 1, [3.0, 4.0, 6.0]), (0, 9, 1, [2.0])], "y int, x int, year long, seen array<double>")
    got = {r.x: (r.level, r.repaired) for r in I.repair_depressions(rows, spark.createDataFrame([(0, 0)], "y int, x int")).collect()}
    assert got == {1: (5.0, False), 2: (6.0, True), 9: (2.0, False)}


def test_wet_levels_leave_dry_days_out(spark):
    day = lambda n: datetime.date(2020, 1, n)
    flood = spark.createDataFrame([(0, 0, day(1), 2), (0, 0, day(2), 1), (0, 0, day(3), 2), (0, 0, day(4), 2)], "y int, x int, date date, cls int")
    levels = spark.createDataFrame([(day(1), 7.0), (day(2), 3.0), (day(3), 5.0), (day(4), 7.0)], "date date, level double")
    assert [tuple(r) for r in I.wet_levels(flood, levels).collect()] == [(0, 0, 2020, [5.0, 7.0])]


def test_fills_by_connection_level(spark):
    rnd = random.Random(9)
    ground = {(0, y, x): float(rnd.randrange(10)) for y in range(7) for x in range(7)}
    days = [(datetime.date(2021, 1, 1 + i), rnd.randrange(110) / 10) for i in range(20)]
    dem = spark.createDataFrame([(y, x, z) for (_, y, x), z in ground.items()], "y int, x int, z double")
    levels = spark.createDataFrame(days, "date date, level double")
    want = {}
    for date, level in days:
        wet = {c for c, z in ground.items() if z < level}
        joined = components(wet)
        want |= {(c[1], c[2], date): round(level - ground[c], 9) for c in wet if (0, 0, 0) in wet and joined[c] == joined[0, 0, 0]}
    assert {(r.y, r.x, r.date): r.depth for r in I.seeded_fill(dem, levels, (0, 0)).collect()} == want
    got = {(r.y, r.x): (r.duration, r.mean_depth, r.max_depth) for r in I.connected_inundation(dem, levels, dem.filter("y = 0 and x = 0").select("y", "x")).collect()}
    by_cell = {}
    for (y, x, _), depth in want.items():
        by_cell.setdefault((y, x), []).append(depth)
    assert got.keys() == by_cell.keys()
    assert all(got[c] == (len(v), pytest.approx(sum(v) / len(v), abs=1e-5), pytest.approx(max(v))) for c, v in by_cell.items())


def test_days_over_by_slices(spark):
    rnd = random.Random(4)
    levels = [(rnd.randrange(2000) / 1000,) for _ in range(300)] + [(1.5,)] * 5
    at = [(i, v) for i, v in enumerate([-3.0, 0.0, 0.1, 0.55, 1.0, 1.4999, 1.5, 1.999, 2.0, 7.0])]
    got = FL.days_over(spark.createDataFrame(at, "k int, threshold double"), spark.createDataFrame(levels, "level double"), ["k"]).orderBy("k").collect()
    for r, (_, t) in zip(got, at):
        over = [v for (v,) in levels if v > t]
        assert (r.days, r.top) == (len(over), max(over, default=None))
        assert r.mean_depth == (None if not over else pytest.approx(sum(over) / len(over) - t, abs=1e-5))
    assert FL.days_over(spark.createDataFrame(at, "k int, threshold double"), spark.createDataFrame([], "level double"), ["k"]).filter(F.col("days") > 0).count() == 0
