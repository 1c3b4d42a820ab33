"""Quality masks, matched seasons, rebuilt series, recovery fits, section lists and the keyed stream, by hand or brute force."""

import datetime
import math
import random

import pytest
from pyspark.sql import functions as F

from eocube.operators import flood as FL
from eocube.operators import hydro as H
from eocube.operators import phenology as PH
from eocube.operators import projection as P
from eocube.operators import temporal as T
from eocube.operators.grid import window_count
from eocube.streaming import streams

DAY = lambda y, n: datetime.date(y, 1, 1) + datetime.timedelta(n - 1)


@pytest.mark.parametrize("half", [1, 3])
def test_window_counts(spark, half):
    rnd = random.Random(half)
    cells = {(k, y, x): rnd.random() < 0.4 for k in (1, 2) for y in range(12) for x in range(12) if rnd.random() < 0.6}
    df = spark.createDataFrame([(*c, f) for c, f in cells.items()], "k int, y int, x int, cloud boolean")
    got = {(r.k, r.y, r.x): r.near for r in window_count(df, ["k"], "cloud", half, "near").collect()}
    assert got == {(k, y, x): sum(f for (j, b, a), f in cells.items() if j == k and abs(b - y) <= half and abs(a - x) <= half and (b, a) != (y, x)) for k, y, x in cells}


def test_quality_words_near_clouds(spark):
    # A doubtful word beside four clouds goes, beside three it stays; each family has its own limit (5696 is over that of LE07).
    rows = [("s", "LC08", y, x, 60000) for y in (0, 1) for x in (1, 2)] + [("s", "LC08", 0, 3, 22080), ("s", "LC08", 9, 0, 21824), ("s", "LC08", 9, 1, 1), ("s", "LC08", 5, 5, 21824 + 8)]
    rows += [("r", "LC09", 0, x, 60000) for x in range(3)] + [("r", "LC09", 0, 3, 22208), ("t", "LE07", 0, 3, 5696), ("t", "LE07", 5, 9, 5440 - 64), ("t", "LE07", 9, 9, 21824), ("u", "XX01", 0, 0, 5376)]
    got = {(r.scene, r.y, r.x): r.clear for r in P.quality_mask(spark.createDataFrame(rows, "scene string, sensor string, y int, x int, qa int"), ["scene"]).collect()}
    assert {c for c, clear in got.items() if clear} == {("s", 9, 0), ("r", 0, 3), ("t", 5, 9)} and len(got) == len(rows)


def test_matched_seasons(spark):
    ndvi = [(2000, 100, 0.9), (2000, 110, 0.5), (2000, 130, 0.3), (2001, 120, 0.8), (2001, 125, 0.6), (2001, 150, 0.1), (2002, 150, 0.7)]
    wet = [(2000, 125), (2001, 140)]
    obs = spark.createDataFrame([(0, 0, DAY(y, n), v) for y, n, v in ndvi], "y int, x int, date date, value double")
    flood = spark.createDataFrame([(0, 0, DAY(y, n), 2) for y, n in wet], "y int, x int, date date, cls int")
    got = {r.year: (r.duration, r.mean_this, r.mean_next, r.change) for r in T.matched_peak_to_flood(obs, flood).collect()}
    assert got == {2000: (20, pytest.approx(0.7), pytest.approx(0.7), pytest.approx(0.0)), 2001: (20, pytest.approx(0.7), pytest.approx(0.7), pytest.approx(0.0))}


def test_rebuilt_series(spark):
    obs = spark.createDataFrame([(0, 0, DAY(2000, 250), 0.4), (0, 0, DAY(2000, 180), 0.9), (0, 0, DAY(2001, 20), -0.1), (0, 0, DAY(2001, 30), 0.2), (0, 0, DAY(2001, 100), 0.3)], "y int, x int, date date, value double")
    flood = spark.createDataFrame([(0, 0, DAY(2000, 150), 2), (0, 0, DAY(2000, 200), 2), (0, 0, DAY(2001, 100), 2), (0, 0, DAY(2001, 30), 1)], "y int, x int, date date, cls int")
    got = sorted((r.date, r.year, r.day, r.value) for r in T.rebuilt_series(obs, flood).collect())
    assert got == [(DAY(2000, 250), 2001, 50, 0.4), (DAY(2001, 30), 2001, 366 - 200 + 30, 0.2)]


@pytest.mark.parametrize(("ymax", "y0", "rate"), [(0.8, 0.2, 0.05), (0.5, 0.9, 0.7), (1.0, 0.99, 3.0), (2.0, -1.0, 0.002)])
def test_recovery_curves_are_found_again(spark, ymax, y0, rate):
    rows = [(1, t * 1.5, ymax - (ymax - y0) * math.exp(-rate * t * 1.5) + d) for t in range(40) for d in (-0.001, 0.001)] + [(2, 0.0, 1.0), (2, 1.0, 2.0), (3, 5.0, None)]
    got = PH.fit_recovery(spark.createDataFrame(rows, "k int, t double, value double"), ["k"]).collect()
    assert len(got) == 1 and (got[0].ymax, got[0].y0, got[0].rate) == (pytest.approx(ymax, abs=1e-3), pytest.approx(y0, abs=1e-3), pytest.approx(rate, rel=1e-3))
    assert got[0].n == 80 and got[0].sse == pytest.approx(80e-6, rel=1e-3)


def test_resistance(spark):
    s = spark.createDataFrame([(1, t, v) for t, v in [(0, 10.0), (1, 4.0), (2, 8.0), (3, 6.0), (4, 2.0)]], "k int, t int, value double")
    assert tuple(PH.resistance(s, ["k"], 2, 4).first())[1:] == (0.6, 0.25, 0.75)


def test_section_lists(spark):
    sampled = spark.createDataFrame([(1, 0), (2, 0), (3, 0)], "cs int, pos int")
    surveyed = spark.createDataFrame([(2, 0), (2, 0), (2, 1), (3, 0), (9, 4)], "cs int, pos int")
    assert sorted(tuple(r) for r in H.section_issues(sampled, surveyed).collect()) == [(1, "missing"), (2, "duplicated"), (9, "redundant")]


def test_trend_beside_dates(spark):
    levels = spark.createDataFrame([(DAY(2000, n), v) for n, v in [(1, 1.0), (2, 2.0), (3, 3.0), (4, 2.5), (5, 2.0)]], "date date, level double")
    flood = spark.createDataFrame([(0, 0, DAY(2000, 2), 2), (0, 0, DAY(2000, 4), 1)], "y int, x int, date date, cls int")
    r = FL.with_trend(FL.boundary_levels(flood, levels), levels).first()
    trend = {t.date: t.trend for t in FL.level_trend(levels).collect()}
    assert (r.min_wet_trend, r.max_dry_trend) == (trend[DAY(2000, 2)], trend[DAY(2000, 4)]) and r.min_wet_trend > 0 > r.max_dry_trend


def test_keyed_stream(spark, tmp_path):
    """Repeats don't replace, late rows are counted, and a batch that is run again changes nothing."""
    at = lambda day, hour: datetime.datetime(2024, 1, day, hour)
    batches = [[(1, at(1, 3), 1.0), (1, at(10, 3), 2.0), (2, at(9, 0), 3.0), (2, at(9, 0), 3.5)], [(1, at(10, 3), 9.0), (1, at(11, 3), 4.0), (2, at(2, 0), 7.0), (2, at(5, 0), 8.0)], [(2, at(1, 0), 1.0), (1, at(20, 0), 5.0)]]
    for k, rows in enumerate(batches):
        spark.createDataFrame(rows, "station long, ts timestamp, value double").coalesce(1).write.parquet(f"{tmp_path}/in/file={k}")
    stream = lambda: streams.by_file(spark, f"{tmp_path}/in", "station bigint, ts timestamp, value double, file int")
    for checkpoint in ("a", "b"):  # the second time all batches come again
        state = streams.upserts(stream(), f"{tmp_path}/state", f"{tmp_path}/{checkpoint}")
        assert sorted((r.station, r.ts.day, r.value) for r in state.readings.collect()) == [(1, 1, 1.0), (1, 10, 2.0), (1, 11, 4.0), (1, 20, 5.0), (2, 5, 8.0), (2, 9, 3.0)]
        assert sorted((r.station, r.n) for r in state.late.groupBy("station").agg(F.sum("n").alias("n")).collect()) == [(2, 2)]


def test_waiting_times():
    wait, got = 60.0, []
    for rows in (0, 0, 0, 5, 5, 5, 5, 5, 5):
        got.append(wait := streams.next_wait(wait, rows, 10, 300))
    assert got == [120, 240, 300, 150, 75, 37.5, 18.75, 10, 10]


def test_values_at_moments_of_the_season(spark):
    from eocube.operators import footprints as FP

    obs = spark.createDataFrame([(0, 0, DAY(2001, n), v) for n, v in [(100, 0.2), (110, 0.4), (200, 1.0), (300, 0.5)]] + [(0, 0, DAY(2002, 5), 9.0)], "y int, x int, date date, value double")
    shots = spark.createDataFrame([(1, DAY(2001, 105), 0.5, 0.5), (2, DAY(2001, 90), 0.5, 0.5), (3, DAY(2003, 9), 0.5, 0.5)], "shot long, date date, px double, py double")
    seasons = spark.createDataFrame([(0, 0, 2001, 200, 250)], "y int, x int, year int, peak int, eom int")
    got = {r.shot: (r.at_date, r.at_peak, r.at_eom) for r in FP.link_moments(shots, obs, seasons).collect()}
    assert got == {1: (0.3, 1.0, 0.75), 2: (None, 1.0, 0.75), 3: (None, None, None)}


def test_base_of_the_first_days(spark):
    env = spark.createDataFrame([(0, 0, DAY(2001, n), v) for n, v in [(99, 50.0), (100, 1.0), (109, 3.0), (110, 6.0), (120, 10.0)]], "y int, x int, date date, value double")
    phases = spark.createDataFrame([(0, 0, 2001, 100, 120)], "y int, x int, year int, start int, end int")
    r = T.within_phases(env, phases, ["y", "x"], "acc", base="first").first()
    assert (r.value, r.n) == (4.0, 3)
