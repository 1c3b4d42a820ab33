"""Hand-built fixtures in the shape of the domain (FIXTURES.md, section 3)."""

import datetime as dt
import math
import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from eocube.functions import dates, text
from eocube.operators import breaks, components, composite, flood, footprints, grid, hydro, phenology, projection, stats, temporal
from eocube.sources import catalog, tables

D = dt.date.fromisoformat


def rows(df, *cols):
    return sorted(tuple(r[c] for c in (cols or df.columns)) for r in df.collect())


# --- functions ------------------------------------------------------------------------------------------------------


def test_leap_dates(spark):
    x = spark.createDataFrame([(D("2019-12-31"),), (D("2020-02-29"),), (D("2020-12-31"),), (D("2021-01-01"),)], "d date")
    got = rows(x.select(dates.doy_code(F.col("d")).alias("a"), dates.day_code(F.col("d")).alias("b")))
    assert got == [(2019365, 20191231), (2020060, 20200229), (2020366, 20201231), (2021001, 20210101)]
    codes = spark.createDataFrame([(2020366,), (2019366,), (2021001,), (20200101,), (2020000,)], "c long")
    assert [r[0] for r in codes.select(dates.from_doy_code(F.col("c"))).collect()] == [D("2020-12-31"), None, D("2021-01-01"), None, None]
    days = spark.createDataFrame([(20200229,), (20190229,), (2020001,)], "c long")
    assert [r[0] for r in days.select(dates.from_day_code(F.col("c"))).collect()] == [D("2020-02-29"), None, None]
    ms = spark.createDataFrame([(0,)], "ms long").select(dates.local_text(F.col("ms"), "Asia/Shanghai")).first()[0]
    assert ms == "1970-01-01 08:00:00"


def test_text_functions(spark):
    x = spark.createDataFrame([("name.tar",), ("name(1).tar",), ("a_20200101_x",), ("a_2020032_x",), ("none",)], "n string")
    assert [r[0] for r in x.select(text.base_name(F.col("n"))).collect()][:2] == ["name.tar", "name.tar"]
    assert [r[0] for r in x.select(text.date_in_name(F.col("n"))).collect()] == [None, None, D("2020-01-01"), D("2020-02-01"), None]
    y = spark.createDataFrame([("1.5", "30-15-36", "[[2001, 1.5, 2], [2002, 3, 4]]", [3.0, 9.0, 9.0])], "a string, b string, c string, d array<double>")
    r = y.select(text.is_number(F.col("a")), text.dms_to_degrees(F.col("b")), text.parse_levels(F.col("c")), text.argmax(F.col("d")), text.linspace(0.0, 1.0, 5)).first()
    assert r[0] and r[1] == pytest.approx(30.26) and [tuple(e) for e in r[2]] == [(2001, 1.5, 2.0), (2002, 3.0, 4.0)] and r[3] == 1 and r[4] == [0, 0.25, 0.5, 0.75, 1]
    line = spark.range(1).select(text.smooth_line(F.array(*[F.struct(F.lit(float(a)).alias("x"), F.lit(float(b)).alias("y")) for a, b in ((0, 0), (4, 0), (4, 4))])).alias("p")).first()["p"]
    assert [(p["x"], p["y"]) for p in line] == [(0, 0), (1, 0), (3, 0), (4, 1), (4, 3), (4, 4)]


def test_ratios_and_indices(spark):
    b = spark.createDataFrame([(0.1, 0.2, 0.1, 0.3, 0.2, 0.1), (0.1, 0.0, 0.0, 0.0, 0.0, 0.1), (None,) * 6], "blue double, green double, red double, nir double, swir double, swir2 double")
    got = projection.spectral_indices(b, ["NDVI", "MNDWI"]).collect()
    assert (got[0]["NDVI"], got[0]["MNDWI"]) == (0.5, 0.0) and got[1]["NDVI"] is None and got[2]["NDVI"] is None
    assert projection.dependent_bands("X = sqrt(nir) + red / nir") == ["nir", "red"]
    assert projection.user_index(b, "X = (nir - red) * 2").first()["X"] == pytest.approx(0.4)
    for bad in ("X = nir; drop", "X = unknown + 1", "X = system('x')", "X = `nir`"):
        with pytest.raises(ValueError):
            projection.user_index(b, bad)
    for bad in ("gte", "0.1", "gt1 or 1=1"):
        with pytest.raises(ValueError):
            projection.threshold("nir", bad)


def test_utm(spark):
    """Known points: the central meridian at the equator, and one in zone 33 (to a centimetre, against a Krueger series)."""
    x = spark.createDataFrame([(15.0, 0.0), (12.0, 50.0)], "lon double, lat double")
    e, n = projection.utm(F.col("lon"), F.col("lat"), 33)
    got = x.select(e, n).collect()
    assert got[0][0] == pytest.approx(500000, abs=1e-6) and got[0][1] == pytest.approx(0, abs=1e-6)

    def krueger(lon, lat, zone):
        a, f, k0 = 6378137.0, 1 / 298.257223563, 0.9996
        n = f / (2 - f)
        big = a / (1 + n) * (1 + n**2 / 4 + n**4 / 64)
        al = [n / 2 - 2 * n**2 / 3 + 5 * n**3 / 16, 13 * n**2 / 48 - 3 * n**3 / 5, 61 * n**3 / 240]
        p, lam = math.radians(lat), math.radians(lon - (zone * 6 - 183))
        e = 2 * math.sqrt(n) / (1 + n)
        t = math.sinh(math.atanh(math.sin(p)) - e * math.atanh(e * math.sin(p)))
        xi, eta = math.atan2(t, math.cos(lam)), math.atanh(math.sin(lam) / math.sqrt(1 + t * t))
        east = 500000 + k0 * big * (eta + sum(c * math.cos(2 * (j + 1) * xi) * math.sinh(2 * (j + 1) * eta) for j, c in enumerate(al)))
        return east, k0 * big * (xi + sum(c * math.sin(2 * (j + 1) * xi) * math.cosh(2 * (j + 1) * eta) for j, c in enumerate(al)))

    want = krueger(12.0, 50.0, 33)
    assert got[1][0] == pytest.approx(want[0], abs=0.01) and got[1][1] == pytest.approx(want[1], abs=0.01)


# --- time series ----------------------------------------------------------------------------------------------------


def test_as_of(spark):
    o = spark.createDataFrame([(0, 0, D("2020-01-01"), 1.0), (0, 0, D("2020-01-11"), 2.0), (0, 0, D("2020-03-01"), None), (0, 0, D("2020-06-01"), 9.0)], "y int, x int, date date, value double")
    r = spark.createDataFrame([(0, 0, D(d)) for d in ("2020-01-01", "2020-01-06", "2020-01-20", "2019-12-30", "2020-03-01", "2021-01-01")], "y int, x int, at date")
    got = {x["at"].isoformat(): x["value"] for x in temporal.value_at(r, o, 15, ["y", "x"]).collect()}
    assert got == {"2020-01-01": 1.0, "2020-01-06": 1.5, "2020-01-20": None, "2019-12-30": None, "2020-03-01": None, "2021-01-01": None}


def test_gap_fill_and_ranges(spark):
    g = spark.createDataFrame([("a", D("2020-01-01"), 1.0), ("a", D("2020-01-05"), 5.0), ("a", D("2020-06-01"), 7.0)], "k string, date date, value double")
    f = {r["date"]: r["value"] for r in temporal.fill_gaps(g, ["k"]).collect()}
    assert f[D("2020-01-03")] == 3.0 and f[D("2020-03-01")] == 5.0 and len(f) == 153
    m = spark.createDataFrame([(1, x) for x in (199811, 199812, 199901, 199904)], "s int, ym int")
    assert rows(temporal.coverage_ranges(m, "s")) == [(1, 199811, 199901, 3), (1, 199904, 199904, 1)]


def test_level_shapes(spark):
    lv = [1, 2, 3, 3, 2, 1, 4]
    d = spark.createDataFrame([(dt.date(2020, 1, i + 1), float(v)) for i, v in enumerate(lv)], "date date, level double")
    assert [r["trend"] for r in flood.level_trend(d).orderBy("date").collect()] == [0, 1, 0, 0, -1, 0, 0]


@pytest.mark.parametrize("values", [[0.3] * 20 + [-0.3] * 60, [-0.4] * 70, [0.5] * 30, [0.1] * 7, []])
def test_bimodal(spark, values):
    o = spark.createDataFrame([(0, 0, dt.date(2020, 1, 1) + dt.timedelta(i), v) for i, v in enumerate(values)] or [(0, 0, dt.date(2020, 1, 1), None)], "y int, x int, date date, value double")
    got = flood.bimodal_threshold(o).collect()
    if len(set(values)) == 2:
        assert got[0]["threshold"] == pytest.approx(0.0)  # between the class means
    else:
        assert all(r["threshold"] == 0.123 for r in got)


def test_phase_bounds(spark):
    env = spark.createDataFrame([(0, 0, dt.date(2020, 1, 1) + dt.timedelta(i), float(i + 1)) for i in range(30)], "y int, x int, date date, value double")
    ph = spark.createDataFrame([(0, 0, 2020, 10, 12)], "y int, x int, year int, start int, end int")
    assert [temporal.within_phases(env, ph, ["y", "x"], h).first()["value"] for h in ("acc", "ave", "max")] == [21.0, 10.5, 11.0]
    assert temporal.within_phases(env, ph, ["y", "x"], "ave", base=True).first()["value"] == 0.5


# --- grid -----------------------------------------------------------------------------------------------------------

BLOBS = """
XX........XX
X.........XX
X...........
...X........
....X.......
............
.XXX....X...
.X.X........
.XXX........
............
......XX.XX.
......XX.XX.
"""


def blob_cells(spark):
    cells = [(y, x) for y, line in enumerate(BLOBS.split()) for x, ch in enumerate(line) if ch == "X"]
    return cells, spark.createDataFrame(cells, "y int, x int")


def brute_regions(cells, eight):
    left, out = set(cells), []
    while left:
        todo, got = [left.pop()], set()
        while todo:
            y, x = todo.pop()
            got.add((y, x))
            for dy in (-1, 0, 1):
                for dx in (-1, 0, 1):
                    n = (y + dy, x + dx)
                    if n in left and (eight or not (dy and dx)):
                        left.discard(n)
                        todo.append(n)
        out.append(frozenset(got))
    return set(out)


@pytest.mark.parametrize("eight", [True, False])
def test_regions(spark, eight):
    cells, df = blob_cells(spark)
    by = {}
    for r in grid.regions(df, eight=eight).collect():
        by.setdefault(r["region"], set()).add((r["y"], r["x"]))
    assert {frozenset(v) for v in by.values()} == brute_regions(cells, eight)
    sizes = Counter(len(v) for v in by.values())
    assert Counter(r["n"] for r in grid.region_sizes(grid.regions(df, eight=eight), []).collect()) == sizes
    assert grid.largest_region(grid.regions(df, eight=eight), []).count() == 8  # the ring
    river = spark.createDataFrame([(y, 0) for y in range(12)], "y int, x int")
    assert grid.touching(grid.regions(df, eight=eight), [], river).count() == 4
    assert grid.drop_small(grid.regions(df, eight=eight), [], 4).count() == sum(n * k for n, k in sizes.items() if n >= 4)


def test_components_property(spark):
    rng = random.Random(3)
    edges = [(rng.randint(0, 400), rng.randint(0, 400)) for _ in range(260)] + [(i, i + 1) for i in range(1000, 1200)] + [(5000, 6000 + i) for i in range(300)]
    root = {}

    def find(x):
        while root.setdefault(x, x) != x:
            x = root[x]
        return x

    for u, v in edges:
        a, b = find(u), find(v)
        root[max(a, b)] = min(a, b)
    want = {(x, find(x)) for x in root if any(x in e and e[0] != e[1] for e in edges)}
    got = components.connected_components(spark.createDataFrame(edges + [(None, 3)], "u long, v long").repartition(5))
    assert {tuple(r) for r in got.collect()} == want
    assert components.connected_components(spark.createDataFrame([], "u long, v long")).count() == 0


def test_isolated_pixels(spark):
    f = spark.createDataFrame([(D("2020-01-01"), y, x, 2 if (y, x) == (2, 2) else 1) for y in range(5) for x in range(5)], "date date, y int, x int, cls int")
    assert {r["cls"] for r in grid.flip_isolated(f).collect()} == {1}
    cells = spark.createDataFrame([(0, 0), (0, 1), (5, 5)], "y int, x int")
    assert rows(grid.drop_sole(cells, [])) == [(0, 0), (0, 1)]


def test_ring(spark):
    square, hollow = [(0.0, 0.0), (4.0, 0.0), (4.0, 4.0), (0.0, 4.0)], [(0.0, 0.0), (4.0, 0.0), (4.0, 4.0), (2.0, 1.0), (0.0, 4.0)]
    p = spark.createDataFrame([(2.0, 2.0), (5.0, 2.0), (2.0, 0.5), (-1.0, 4.0)], "px double, py double")
    assert [r[0] for r in p.select(projection.inside_ring(F.col("px"), F.col("py"), square)).collect()] == [True, False, True, False]
    assert [r[0] for r in p.select(projection.inside_ring(F.col("px"), F.col("py"), hollow)).collect()] == [False, False, True, False]


# --- hydrology ------------------------------------------------------------------------------------------------------


def test_idw(spark):
    st = spark.createDataFrame([(0, 0.0, 0.0, 1.0), (1, 4.0, 0.0, 2.0), (2, 0.0, 4.0, 3.0), (3, 4.0, 4.0, 4.0), (4, 0.5, 0.5, 7.0), (5, 9.0, 9.0, None)], "station_id int, px double, py double, value double")
    cells = spark.createDataFrame([(0, 0), (1, 1)], "y int, x int")
    got = {(r["y"], r["x"]): r["value"] for r in hydro.idw(cells, st, 5).collect()}
    assert got[0, 0] == 7.0  # a station at the centre
    d = [(1.5**2 + 1.5**2, 1), (2.5**2 + 1.5**2, 2), (2.5**2 + 1.5**2, 3), (2.5**2 * 2, 4), (2.0, 7)]
    assert got[1, 1] == pytest.approx(sum(v / k for k, v in d) / sum(1 / k for k, _ in d), abs=1e-5)


def test_gauges_on_a_line(spark):
    g = spark.createDataFrame([("a", 0.0, 2000), ("b", 10.0, 2000), ("c", 30.0, 2000), ("a", 0.0, 2001), ("c", 30.0, 2001)], "station string, chainage double, year int")
    p = spark.createDataFrame([("up", -5.0), ("mid", 5.0), ("low", 20.0), ("down", 40.0)], "place string, chainage double")
    got = {(r["place"], r["year"]): (r["lower"], r["upper"]) for r in hydro.nearest_gauges(p, g).collect()}
    assert got["up", 2000] == ("a", "b") and got["mid", 2000] == ("a", "b") and got["low", 2000] == ("b", "c") and got["down", 2000] == ("b", "c")
    assert {v for (_, y), v in got.items() if y == 2001} == {("a", "c")}


def test_hypsometry(spark):
    lv = spark.createDataFrame([(float(i),) for i in range(1, 5)], "level double")
    px = spark.createDataFrame([(0, 0, 0.0), (0, 1, 0.25), (0, 2, 0.5), (0, 3, 1.0), (0, 4, None), (0, 5, 0.375)], "y int, x int, frequency double")
    assert rows(hydro.level_at_frequency(px, lv), "x", "z") == [(1, 4.0), (2, 3.0), (3, 1.0), (5, 3.5)]


def test_profiles(spark):
    a = spark.createDataFrame([("s", 0.0, 5.0), ("s", 2.0, 1.0), ("s", 4.0, 1.0), ("s", 6.0, 5.0)], "cs string, d double, z double")
    b = spark.createDataFrame([("s", 1.0, 4.0), ("s", 3.0, 2.0), ("s", 9.0, 8.0)], "cs string, d double, z double")
    assert rows(hydro.lowest_point(a)) == [("s", 2.0, 1.0)]  # of equals, equally near the middle, the first
    got = {r["d"]: (r["za"], r["zb"]) for r in hydro.profile_difference(a, b).collect()}
    assert got == {1.0: (3.0, 4.0), 2.0: (1.0, 3.0), 3.0: (1.0, 2.0), 4.0: (1.0, 3.0), 6.0: (5.0, 5.0)}


# --- curves and breaks ----------------------------------------------------------------------------------------------


def test_double_logistic_fit(spark):
    true = np.array([0.12, 0.55, 115.0, 9.0, 265.0, 11.0, 0.0004])
    t = np.arange(3, 366, 16).astype(float)
    rng = np.random.default_rng(0)
    data = []
    for year in (2000, 2001, 2002):
        v = phenology._model(t, true) + rng.normal(0, 0.005, len(t))
        data += [(0, 0, dt.date(year, 1, 1) + dt.timedelta(int(k) - 1), float(w)) for k, w in zip(t, v)]
    data += [(0, 1, dt.date(2000, 1, 1 + i), 0.3) for i in range(6)]  # too few
    got = phenology.fit_curves(spark.createDataFrame(data, "y int, x int, date date, value double")).collect()
    assert len(got) == 3 and all(r["r2"] > 0.99 for r in got)
    fit = np.mean([[r[p] for p in phenology.P] for r in got], axis=0)
    assert abs(fit[2] - 115) < 4 and abs(fit[4] - 265) < 4


def test_fourier_fit(spark):
    w = 0.017
    data = [(0, 0, dt.date(2000, 1, 1) + dt.timedelta(i), 0.4 + 0.2 * math.cos(w * (i + 1)) - 0.1 * math.sin(2 * w * (i + 1))) for i in range(0, 365, 9)]
    r = phenology.fit_fourier(spark.createDataFrame(data, "y int, x int, date date, value double")).first()
    assert r["w"] == w and r["r2"] > 0.999999 and r["c1"] == pytest.approx(0.2, abs=1e-3) and r["c4"] == pytest.approx(-0.1, abs=1e-3)


def test_breaks(spark):
    rng = np.random.default_rng(1)
    data = []
    for x, kind in enumerate(("step", "none", "spike")):
        for k in range(230):
            t = 16 * k
            base = 0.3 + 0.1 * math.cos(2 * math.pi * t / 365.25) + rng.normal(0, 0.01)
            base += 0.4 if kind == "step" and k > 120 else 3.0 if kind == "spike" and k == 120 else 0
            data.append((0, x, dt.date(2000, 1, 1) + dt.timedelta(t), base, base * 0.8 + rng.normal(0, 0.01)))
    seg = breaks.detect_breaks(spark.createDataFrame(data, "y int, x int, date date, a double, b double"), ["a", "b"])
    s = {r["x"]: r for r in breaks.break_summary(seg).collect()}
    assert s[0]["n_breaks"] == 1 and abs((s[0]["first_break"] - (dt.date(2000, 1, 1) + dt.timedelta(16 * 121))).days) <= 48
    assert s[1]["n_breaks"] == 0 and s[2]["n_breaks"] == 0


def test_recovery(spark):
    d = spark.range(1).select(phenology.recovery_time(F.lit(1.0), F.lit(0.2), F.lit(0.05)).alias("t")).first()["t"]
    assert 1 - 0.8 * math.exp(-0.05 * d) == pytest.approx(0.99)


# --- statistics -----------------------------------------------------------------------------------------------------


def test_confusion(spark):
    m = stats.confusion(spark.createDataFrame([(1, 1), (1, 1), (1, 2), (2, 1), (3, 1)], "r int, p int"), "r", "p")
    got = {r["cls"]: (r["omission"], r["commission"], r["overall"]) for r in stats.accuracy(m).collect()}
    assert got[1] == (pytest.approx(1 / 3), 0.5, 0.4) and got[3][0] == 1 and got[3][1] is None


def test_folds(spark):
    d = spark.createDataFrame([(i, float(i % 50), 0) for i in range(400)], "k int, v double, g int")
    f = stats.stratified_folds(d, "v", "k", 20, 4, ["g"]).collect()
    assert Counter(r["fold"] for r in f) == {1: 100, 2: 100, 3: 100, 4: 100} and set(Counter((r["stratum"], r["fold"]) for r in f).values()) == {5}
    c = Counter(r["fold"] for r in stats.folds_contiguous(d, "k", 3).collect())
    assert c == {0: 133, 1: 133, 2: 134}


def test_distances(spark):
    d = spark.createDataFrame([("r", float(i)) for i in range(10)] + [("s", float(i) + 2) for i in range(10)], "c string, v double")
    r = stats.two_sample_distances(d, "c", "v", "r").first()
    assert r["ks"] == pytest.approx(0.2) and r["wasserstein"] == pytest.approx(2.0)


def test_footprint_weights(spark):
    s = spark.createDataFrame([(1, 2.5, 2.5), (2, 3.0, 3.0)], "shot int, px double, py double")
    w = {}
    for r in footprints.weighted_cells(s, "area", 1.0).collect():
        w.setdefault(r["shot"], {})[r["y"], r["x"]] = r["w"]
    assert w[1] == {(2, 2): 1.0} and w[2] == {(a, b): 0.25 for a in (2, 3) for b in (2, 3)}


# --- sources and sinks ----------------------------------------------------------------------------------------------


def test_duplicate_files(spark):
    f = spark.createDataFrame([("LC08_L2SP_123039_20200101_20200113_02_T1.tar", 5), ("LC08_L2SP_123039_20200101_20200113_02_T1(1).tar", 9), ("LE07_L2SP_123039_20200101_20200113_02_T1.tar", 7), ("junk.txt", 1)], "name string, size long")
    kept = catalog.largest_copy(f)
    assert ("LC08_L2SP_123039_20200101_20200113_02_T1(1).tar", 9) in {(r["name"], r["size"]) for r in kept.collect()} and kept.count() == 3
    scenes = catalog.landsat(kept)
    assert scenes.count() == 2 and [r["sensor"] for r in catalog.newest_sensor(scenes).collect()] == ["LE07"]
    s2 = catalog.sentinel2(spark.createDataFrame([("S2A_MSIL2A_20200101T030000_N0213_R075_T49RGP_20200101T080000.SAFE", 3), ("S2A_MSIL2A_20200101T030000_N0213_R075_T49RGP_20200101T080000_2.SAFE", 4)], "name string, size long"))
    r = catalog.shortest_path(s2).first()
    assert (r["sensor"], r["date"], r["orbit"], r["tile"], r["size"]) == ("S2A", D("2020-01-01"), "R075", "T49RGP", 3)
    s1 = catalog.sentinel1(spark.createDataFrame([("S1A_IW_GRDH_1SDV_20200105T101010_x.zip",)], "name string")).first()
    assert (s1["beam"], s1["product"], s1["polarisation"], s1["date"]) == ("IW", "GRD", "VV_VH", D("2020-01-05"))
    g = catalog.lidar(spark.createDataFrame([("GEDI02_A_2019108002011_O01959_x.h5",)], "name string")).first()
    assert (g["level"], g["date"], g["orbit"]) == ("L2", D("2019-04-18"), "O01959")
    m = catalog.dotted(spark.createDataFrame([("MCD18A2.A2020032.h27v05.061.hdf",)], "name string")).first()
    assert (m["product"], m["date"], m["tile"]) == ("MCD18A2", D("2020-02-01"), "h27v05")


def test_text_readers(spark, tmp_path):
    (tmp_path / "w").mkdir()
    (tmp_path / "w" / "SURF_CLI-TEM-12001-202001.TXT").write_text("57494 3037 11403 236 2020 1 1 52 60 40\n57494 3037 11403 236 2020 1 2 32766 60 40\n\n")
    raw = tables.weather_files(spark, f"file://{tmp_path}/w")
    got = hydro.station_units(raw).orderBy("date").collect()
    assert [r["value"] for r in got] == [5.2, None] and got[0]["lat"] == pytest.approx(30.616667) and {r["var"] for r in raw.collect()} == {"TEM"}
    (tmp_path / "g.txt").write_text("#A,2000\n1,1,10.5,0.1,20\n1,2,11,0.2,21\n#B,2001\n2,30,1,1,1\n3,1,5,,7\n")
    g = tables.gauge_files(spark, f"file://{tmp_path}/g.txt")
    assert rows(g.filter("date is not null"), "station", "date", "flow", "level") == [("A", D("2000-01-01"), 10.5, 20.0), ("A", D("2000-01-02"), 11.0, 21.0), ("B", D("2001-03-01"), 5.0, 7.0)]
    (tmp_path / "cs.csv").write_text("name,CS1\n0,5\n1.5,3\nname,CS2\n0,9\n")
    assert rows(tables.section_files(spark, f"file://{tmp_path}/cs.csv")) == [("CS1", 0, 0.0, 5.0), ("CS1", 1, 1.5, 3.0), ("CS2", 0, 0.0, 9.0)]
    (tmp_path / "a.csv").write_text("d,t\n1,2\n")
    (tmp_path / "b.csv").write_text("d,p\n3,4\n")
    u = tables.daily_station_csvs(spark, [f"file://{tmp_path}/a.csv", f"file://{tmp_path}/b.csv"])
    assert sorted(tuple(str(v) for v in r) for r in u.collect()) == [("1", "2", "None"), ("3", "None", "4")]
    f = tables.footprint_tables(spark, [f"file://{tmp_path}/a.csv", f"file://{tmp_path}/b.csv"], ["d"])
    assert f.count() == 2
    with pytest.raises(ValueError):
        tables.require_columns(f, ["zzz"])
    files = catalog.list_files(spark, f"file://{tmp_path}", "*.csv")
    assert {r["name"] for r in files.collect()} == {"a.csv", "b.csv", "cs.csv"}


def test_cube_storage(spark, tmp_path):
    o = spark.createDataFrame([(0, 0, D("2000-01-01"), "A", 1.0), (0, 1, D("2001-01-01"), "A", 2.0)], "y int, x int, date date, idx string, value double")
    path = f"file://{tmp_path}/cube"
    tables.save_cube(o, path)
    tables.save_cube(o.withColumn("value", F.lit(9.0)).unionByName(spark.createDataFrame([(0, 0, D("2002-01-01"), "A", 3.0)], o.schema)), path)  # years that are there stay
    assert rows(tables.load_cube(spark, path), "date", "value") == [(D("2000-01-01"), 1.0), (D("2001-01-01"), 2.0), (D("2002-01-01"), 3.0)]
    tables.save_cube(o.filter("x = 1").withColumn("value", F.lit(7.0)), path, overwrite=True)
    assert rows(tables.load_cube(spark, path), "date", "value") == [(D("2000-01-01"), 1.0), (D("2001-01-01"), 7.0), (D("2002-01-01"), 3.0)]


# --- streams --------------------------------------------------------------------------------------------------------

LIVE = [
    [("a", "2024-01-01 00:00:00", 1.0), ("a", "2024-01-01 01:00:00", -9999.0)],
    [("a", "2024-01-01 00:00:00", 1.0), ("b", "2024-01-01 00:00:00", 5.0), ("a", "2024-01-03 00:00:00", 2.0)],
    [("a", "2024-01-02 12:00:00", 4.0), ("a", "2024-01-09 00:00:00", 3.0)],
]


def test_stream_of_readings(spark, tmp_path):
    import json

    from eocube.streaming import streams

    src = tmp_path / "in"
    src.mkdir()
    for i, batch in enumerate(LIVE):
        (src / f"{i}.json").write_text("\n".join(json.dumps({"station": s, "ts": t, "level": v, "flow": 1.0}) for s, t, v in batch))
        streams.append_unseen(streams.readings(spark, f"file://{src}"), f"file://{tmp_path}/out", f"file://{tmp_path}/cp").awaitTermination()
    out = spark.read.parquet(f"file://{tmp_path}/out")
    want = sorted({(s, t) for b in LIVE for s, t, _ in b})
    assert sorted((r["station"], str(r["ts"])) for r in out.collect()) == want
    assert out.filter("level is null").count() == 1
    q = streams.daily(streams.readings(spark, f"file://{src}").withColumnRenamed("level", "value")).writeStream.format("memory").queryName("days").outputMode("append").trigger(availableNow=True).start()
    q.awaitTermination()
    got = {(r["station"], r["date"]): r["total"] for r in spark.table("days").collect()}
    assert got[("a", D("2024-01-01"))] == 2.0 and got[("b", D("2024-01-01"))] == 5.0 and ("a", D("2024-01-09")) not in got


def test_composites(spark):
    o = spark.createDataFrame([(0, 0, D("2020-01-03"), None), (0, 0, D("2020-01-05"), 2.0), (0, 0, D("2020-01-09"), 4.0)], "y int, x int, date date, value double")
    assert [composite.composite(o, "month", h).first()["value"] for h in ("first", "last", "mean", "max", "min")] == [2.0, 4.0, 3.0, 4.0, 2.0]


def test_curves_of_all_suppliers(spark, tmp_path):
    """Every supplier has a curve at its own pixel, however high its id."""
    from eocube.plans.more import curve_parameters

    spark.createDataFrame([(i, i % 25) for i in range(1, 1001)], "s_suppkey bigint, s_nationkey int").write.parquet(f"{tmp_path}/supplier.parquet")
    got = curve_parameters(spark, str(tmp_path)).select("y", "x").collect()
    assert len(got) == len(set(got)) == 1000


# --- exactness of the forms that avoid pairs, cross joins and samples -------------------------------------------------


@pytest.mark.parametrize("values", [3, 40, 10**6])
def test_kendall_by_pairs(spark, values):
    import random

    rng = random.Random(values)
    data = [(g, i, float(rng.randrange(values)), float(rng.randrange(values))) for g in ("a", None) for i in range(300)] + [("one", 0, 1.0, 1.0), ("b", 0, None, 1.0)]
    got = {r["g"]: (r["tau"], r["pairs"]) for r in stats.kendall(spark.createDataFrame(data, "g string, k int, x double, y double"), "x", "y", ["g"]).collect()}
    sign = lambda v: (v > 0) - (v < 0)
    assert set(got) == {"a", None}
    for g in got:
        p = [(x, y) for h, _, x, y in data if h == g]
        s = sum(sign(a[0] - b[0]) * sign(a[1] - b[1]) for i, a in enumerate(p) for b in p[:i])
        assert got[g] == (pytest.approx(s / 44850, abs=1e-8), 44850)


def test_circle_shares(spark):
    import math
    import random

    rng = random.Random(3)
    shots = [(i, rng.uniform(3, 5), rng.uniform(3, 5)) for i in range(20)] + [(20, 4.0, 4.0), (21, 4.5, 4.5)]
    for d in (0.6, 1.5, 3.2):
        w = footprints.weighted_cells(spark.createDataFrame(shots, "shot int, px double, py double"), "area", d).collect()
        by = {}
        for r in w:
            by.setdefault(r["shot"], {})[r["y"], r["x"]] = r["w"]
        for i, px, py in shots:
            assert sum(by[i].values()) == pytest.approx(1)
            for (y, x), share in by[i].items():  # strips of the circle
                n, total = 4000, 0.0
                for k in range(n):
                    t = x + (k + 0.5) / n - px
                    if abs(t) < d / 2:
                        h = math.sqrt(d * d / 4 - t * t)
                        total += max(0.0, min(y + 1, py + h) - max(y, py - h)) / n
                assert share == pytest.approx(total / (math.pi * d * d / 4), abs=2e-3)


def test_nearest_stations_by_hand(spark):
    import random

    rng = random.Random(1)
    st = [(i, rng.gauss(5, 1), rng.gauss(5, 1), float(i)) for i in range(60)] + [(60, 90.0, -40.0, 1.0), (61, 5.0, 5.0, 2.0), (62, 5.0, 5.0, 3.0)]
    cells = [(y, x) for y in range(0, 40, 7) for x in range(-20, 100, 13)]
    frame = spark.createDataFrame(st, "station_id int, px double, py double, value double")
    got = {(r["y"], r["x"]): [e["station_id"] for e in r["n"]] for r in hydro.nearest_stations(spark.createDataFrame(cells, "y int, x int"), frame, 4).collect()}
    for y, x in cells:
        assert got[y, x] == [i for _, i in sorted((round((x + 0.5 - a) ** 2 + (y + 0.5 - b) ** 2, 9), i) for i, a, b, _ in st)[:4]]
    assert hydro.nearest_stations(spark.createDataFrame(cells, "y int, x int"), frame.limit(0), 4).count() == 0


def test_frequent_keys(spark):
    from eocube.operators.skew import join_counted

    left = spark.range(3000).selectExpr("id", "if(id < 2000, 1, id % 50) AS k")
    right = left.groupBy("k").count().selectExpr("k", "count AS d", "k * 10 AS v")
    out = join_counted(left, right, "k", 3000).collect()
    assert len(out) == 3000 and all(r["v"] == 10 * r["k"] for r in out) and len({r["id"] for r in out}) == 3000


def test_flip_and_repair(spark):
    d0 = D("2020-01-01")
    f = [(d0, y, x, 2 if (y, x) in ((2, 2), (9, 9), (9, 10)) else 1) for y in range(12) for x in range(12)] + [(D("2020-01-02"), 0, 0, 2)]
    out = {(r["date"], r["y"], r["x"]): r["cls"] for r in grid.flip_isolated(spark.createDataFrame(f, "date date, y int, x int, cls int")).collect()}
    assert len(out) == len(f) and out[d0, 2, 2] == 1 and out[d0, 9, 9] == 2 and out[d0, 9, 10] == 2 and out[D("2020-01-02"), 0, 0] == 2


def test_two_sample_distance_of_squares(spark):
    data = [("r", v) for v in (1.0, 2.0, 3.0, 4.0)] + [("s", v) for v in (2.5, 5.0)]
    got = stats.two_sample_distances(spark.createDataFrame(data, "c string, v double"), "c", "v", "r").first()
    gaps = [0 - 0.25, 0 - 0.5, 0.5 - 0.5, 0.5 - 0.75, 0.5 - 1.0, 0.0]
    assert got["cvm"] == pytest.approx(sum(g * g for g in gaps) * 8 / 36, abs=1e-6) and got["ks"] == 0.5


def test_weaker_curve_is_not_preferred(spark):
    """A double logistic curve is better fitted by its own form, a two-harmonic one by Fourier terms."""
    import math

    t = range(5, 366, 10)
    curve = lambda k: 0.1 + 0.6 * (1 / (1 + math.exp((120 - k) / 6)) - 1 / (1 + math.exp((270 - k) / 8)))
    wave = lambda k: 0.4 + 0.2 * math.cos(0.017 * k) + 0.15 * math.sin(0.034 * k)
    rows_ = [(y, 0, dt.date(2019, 1, 1) + dt.timedelta(k - 1), f(k)) for y, f in ((0, curve), (1, wave)) for k in t]
    best = {r["y"]: r["model"] for r in phenology.preferred_curve(phenology.both_fits(spark.createDataFrame(rows_, "y int, x int, date date, value double")), ["y", "x", "year"]).collect()}
    assert best == {0: "double_logistic", 1: "fourier"}
    fit = phenology.index_fitness(spark.createDataFrame([r for r in rows_ if r[0] == 0], "y int, x int, date date, value double")).first()
    assert fit["r2"] > 0.99 and fit["near_share"] > 0.9
