"""Steps that grew faster than their input, by what their plans and tasks show on small tables."""

import contextlib
import datetime as dt
import io

import pytest
from pyspark.sql import functions as F

from eocube.operators import footprints as FP
from eocube.operators import hydro as H
from eocube.operators import phenology as PH
from eocube.operators import projection as P


def plan(df) -> str:
    out = io.StringIO()
    with contextlib.redirect_stdout(out):
        df.explain("formatted")
    return out.getvalue()


def curves(spark, n: int):
    k = F.col("id")
    names = {"p0": 0.1 + k % 9 / 50, "p1": 0.5 + k % 7 / 20, "p2": 110.0 + k % 30, "p3": 8.0 + k % 5, "p4": 260.0 + k % 40, "p5": 9.0 + k % 4, "p6": k % 10 / 20000}
    return spark.range(n).select((k % 20).cast("int").alias("y"), (k / 20).cast("int").alias("x"), F.lit(2000).alias("year"), *[c.alias(p) for p, c in names.items()])


def days(params):
    """By (y, x): (day, value, parameters) of every row of the pixel."""
    out = {}
    for r in PH.expand(params).collect():
        out.setdefault((r["y"], r["x"]), []).append((r["t"], r["v"], r))
    return out


def mean(v):
    return sum(v) / len(v) if v else None


def test_curve_summary_joins_no_days(spark):
    """Days of 365 times the parameters were joined; by the size of the parameters Spark sent them to the driver."""
    params = curves(spark, 60).unionByName(curves(spark, 3))  # some pixels have two rows
    got = PH.curve_summary(params)
    assert "Join" not in plan(got) and "Generate" not in plan(got)
    want = days(params)
    assert got.count() == len(want) == 60
    for r in got.collect():
        d = want[r["y"], r["x"]]
        top = max(v for _, v, _ in d)
        day = min(t for t, v, _ in d if v == top)
        assert (r["vmax"], r["day_max"], r["bloom_days"]) == (top, day, sum(v >= 0.3 for _, v, _ in d))
        wet = [v for t, v, _ in d if 121 <= t <= 304]
        for k, v in (("annual", mean([v for _, v, _ in d])), ("flood_season", mean(wet)), ("off_season", mean([v for t, v, _ in d if not 121 <= t <= 304])), ("bloom_after", mean([v for t, v, _ in d if v >= 0.3 and t > day]))):
            assert r[k] == (None if v is None else pytest.approx(v, abs=1e-6)), k


def sign(x):
    return (x > 0) - (x < 0)


def crosses(s, g):
    side = lambda p, q, r: sign((q[0] - p[0]) * (r[1] - p[1]) - (q[1] - p[1]) * (r[0] - p[0]))
    a, b, c, d = s[:2], s[2:], g[:2], g[2:]
    return side(a, b, c) * side(a, b, d) < 0 and side(c, d, a) * side(c, d, b) < 0


def test_crossings_keep_no_pairs(spark):
    """Each pair of a section and a segment was a row, in as many tiles as they share, and sent to be made distinct."""
    line = lambda k, w: (k * 7 % 23 + 0.31, k * 5 % 11 + 0.17, k * 3 % w + 0.77, k * 13 % 19 - 4.07)
    sections = [(k % 40, *line(k % 31, 17)) for k in range(60)] + [(90, 50.0, 50.0, 51.0, 51.0), (91, None, 1.0, 2.0, 2.0)]
    segments = [(k, *line(k % 29 + 3, 13)) for k in range(600)]
    got = H.crossings(spark.createDataFrame(sections, "cs int, ax double, ay double, bx double, by double"), spark.createDataFrame(segments, "seg int, ax double, ay double, bx double, by double"))
    want = {}
    for s in sections:
        rows = [r for r in sections if r[0] == s[0]]
        want[s[0]] = len(rows) * sum(crosses(r[1:], g[1:]) for r in rows for g in segments if None not in r)
    assert {r["cs"]: r["n_crossings"] for r in got.collect()} == want and max(want.values()) > 100
    assert not [k for k in plan(got).splitlines() if k.startswith("Keys") and "seg#" in k]


def test_phenology_metrics_sort_no_days(spark):
    """One task sorted 365 rows for each of all curves."""
    params = curves(spark, 60).unionByName(curves(spark, 3).withColumn("p2", F.lit(100.0)))
    got = PH.metrics(params)
    text = plan(got)
    assert "Generate" not in text and "SortAggregate" not in text
    want = days(params)
    assert got.count() == len(want) == 60
    for r in got.collect():
        d = want[r["y"], r["x"]]
        top = max(v for _, v, _ in d)
        assert (r["peak_vi"], r["peak_doy"]) == (top, min(t for t, v, _ in d if v == top))
        s = [v for t, v, p in d if p["p2"] <= t <= p["p4"]]
        assert r["mavi"] == pytest.approx(mean(s), abs=1e-6) and r["tsvi"] == pytest.approx(sum(s), abs=1e-4)
        assert r["mavi_std"] == pytest.approx(mean([(v - mean(s)) ** 2 for v in s]) ** 0.5, abs=1e-5)
        assert r["trough_vi"] == round(min(p["p0"] for _, _, p in d), 6) and r["sos"] in (None, round(min(p["p2"] for _, _, p in d), 4))


def test_profile_difference_reads_no_frame_twice(spark):
    """A frame from each row to the section's end took time with the square of its points."""
    a, b = ([(k % 2, k * step + off, float(k * k % 17)) for k in range(1, 60)] for step, off in ((2.0, 0.0), (3.0, 0.5)))
    got = H.profile_difference(spark.createDataFrame(a, "cs int, d double, z double"), spark.createDataFrame(b, "cs int, d double, z double"))
    assert "unboundedfollowing" not in plan(got).lower()

    def at(rows, cs, d):
        points = sorted((x, z) for c, x, z in rows if c == cs)
        for (x0, z0), (x1, z1) in zip(points, points[1:]):
            if x0 <= d <= x1:
                return z0 + (z1 - z0) * (d - x0) / (x1 - x0)

    want = {(c, d): (at(a, c, d), at(b, c, d)) for c, d in {(c, d) for c, d, _ in a + b}}
    want = {k: v for k, v in want.items() if None not in v}
    assert {(r["cs"], r["d"]): (pytest.approx(r["za"]), pytest.approx(r["zb"])) for r in got.collect()} == want and len(want) > 60


def test_band_simulation_is_no_join_by_wavelength(spark):
    """All values of a wavelength, of which there are few, were sorted in one task."""
    response = spark.createDataFrame([("wide", w, 1.0) for w in (1, 2, 3)] + [("narrow", 2, 0.5), ("none", 1, 0.0)], "band string, wavelength int, weight double")
    spectra = spark.createDataFrame([(k, w, float(k + w)) for k in range(30) for w in range(1, 5)], "sample int, wavelength int, value double")
    got = P.band_simulation(spectra, response)
    assert "SortMergeJoin" not in plan(got) and "BroadcastHashJoin" in plan(got)
    assert {(r["sample"], r["band"]): r["value"] for r in got.collect()} == {(k, b): v for k in range(30) for b, v in (("wide", k + 2.0), ("narrow", k + 2.0), ("none", None))}


def test_recovery_sends_no_row_for_each_rate(spark, monkeypatch):
    """Each round sent, for each group, a row for each of its rates to the values, and made one of each value and rate."""
    seen, store = [], PH.stage
    monkeypatch.setattr(PH, "stage", lambda df, name: seen.append(plan(df)) or store(df, name))
    rows = [(k, float(t), 2.0 - 1.5 * 2.718281828459045 ** (-0.01 * (k + 1) * t)) for k in range(4) for t in range(0, 300, 10)]
    got = {r["k"]: r for r in PH.fit_recovery(spark.createDataFrame(rows, "k int, t double, value double"), ["k"], rounds=8).collect()}
    assert len(seen) == 9 and not any("Generate" in p for p in seen)
    for k in range(4):
        assert got[k]["rate"] == pytest.approx(0.01 * (k + 1), rel=1e-4) and got[k]["ymax"] == pytest.approx(2.0, abs=1e-4) and got[k]["n"] == 30
    one = PH.fit_recovery(spark.createDataFrame(rows[:30], "k int, t double, value double"), [], rounds=8).first()
    assert one["rate"] == pytest.approx(0.01, rel=1e-4)


def test_environment_makes_no_row_for_each_day_of_a_shot(spark):
    """Each shot was joined with all days of its year until its date."""
    day = lambda k: dt.date(2001, 1, 1) + dt.timedelta(k)
    env = [(k % 2, 0, day(k * 5), (k * 7 % 11) / 10) for k in range(160)]
    shots = [(k, day(k * 13), 0.5, k % 2 + 0.5) for k in range(50)] + [(77, day(100), 0.5, 0.5), (77, day(101), 0.5, 1.5), (78, None, 0.5, 0.5), (79, day(9), 8.5, 8.5)]
    got = FP.link_environment(spark.createDataFrame(shots, "shot int, date date, px double, py double"), spark.createDataFrame(env, "y int, x int, date date, value double"), base=0.1)
    alone = FP.link_environment(spark.createDataFrame(shots[:50], "shot int, date date, px double, py double"), spark.createDataFrame(env, "y int, x int, date date, value double"), base=0.1)
    assert "Window" in plan(got)
    want = {}
    for s in {s[0] for s in shots}:
        met = {}
        for _, at, px, py in (r for r in shots if r[0] == s and r[1]):
            for y, x, d, v in env:
                if (y, x) == (int(py), int(px)) and d <= at and d.year == at.year:
                    met.setdefault(d, []).append(v)
        v = [mean(x) for x in met.values()]
        if v:
            m = mean(v)
            want[s] = (len(v), sum(max(x - 0.1, 0) for x in v), max(v), min(v), m, mean([(x - m) ** 2 for x in v]) ** 0.5)
    rows = {r["shot"]: tuple(r)[1:] for r in got.collect()}
    assert set(rows) == set(want) and 77 in rows and all(rows[k] == pytest.approx(want[k], abs=1e-8) for k in want)
    assert {r["shot"]: tuple(r)[1:] for r in alone.collect()} == {k: r for k, r in rows.items() if k < 50}


def test_curves_are_fitted_side_by_side(spark):
    """Each pixel was fitted by itself, in a group and call of its own. Lengths differ, keys are null, pixels are cut by batches."""
    import numpy as np

    rng = np.random.default_rng(4)
    data, want = [], {}
    for k in range(40):
        p = np.array([0.1 + k % 9 / 50, 0.5 + k % 7 / 20, 110 + k % 30, 8 + k % 5, 260 + k % 40, 9 + k % 4, k % 10 / 20000])
        key = (None if k == 3 else k % 5, None if k in (3, 4) else k // 5)
        for year in (2001, 2002)[: 1 + k % 2]:
            t = np.arange(3 + k % 4, 366, 9 + k % 11)[: 6 if k == 11 else 99]
            v = PH._model(t.astype(float), p) + rng.normal(0, 0.004, len(t))
            data += [(*key, dt.date(year, 1, 1) + dt.timedelta(int(d) - 1), float(x)) for d, x in zip(t, v)]
            want.setdefault(key, {})[year] = t, v
    rng.shuffle(data)
    frame = spark.createDataFrame([(None if y is None else int(y), None if x is None else int(x), d, float(v)) for y, x, d, v in data], "y int, x int, date date, value double")
    for together in (1 << 16, 30):
        fits = PH.fit_curves(frame, together=together)
        assert "FlatMapGroupsInArrow" not in plan(fits)
        got = {((r["y"], r["x"]), r["year"]): r for r in fits.collect()}
        assert set(got) == {(k, y) for k, of in want.items() for y, (t, _) in of.items() if len(t) >= 7}
        for (key, year), r in got.items():
            t, v = (np.concatenate(x).astype(float) for x in zip(*want[key].values()))
            pooled, _ = PH.fit_double_logistic(t, v)
            room = np.array([0.15, 0.3, 25, 10, 30, 10, 0.002])
            t, v = want[key][year]
            p, r2 = PH.fit_double_logistic(t.astype(float), v, np.maximum(PH.LOW, pooled - room), np.minimum(PH.HIGH, pooled + room))
            assert r["n"] == len(t) and r["r2"] == pytest.approx(r2, abs=1e-7)
            at = np.arange(1.0, 366)
            assert np.abs(PH._model(at, np.array([r[c] for c in PH.P])) - PH._model(at, p)).max() < 1e-3
