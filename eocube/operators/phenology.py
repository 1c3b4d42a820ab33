"""Growth curves: metrics from parameters in plain expressions, and fits by pixel and year.

The curve is a seven-parameter double logistic: p0 + (p1 - p6 t) (1/(1 + e^((p2 - t)/p3)) - 1/(1 + e^((p4 - t)/p5))).
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import stage

P = ["p0", "p1", "p2", "p3", "p4", "p5", "p6"]


def curve(t: Column, of=F.col) -> Column:
    p = [of(n) for n in P]
    return p[0] + (p[1] - p[6] * t) * (1 / (1 + F.exp((p[2] - t) / p[3])) - 1 / (1 + F.exp((p[4] - t) / p[5])))


def expand(params: DataFrame) -> DataFrame:
    """The curve on each day of the year: 365 rows for each pixel and year."""
    return params.withColumn("t", F.explode(F.sequence(F.lit(1), F.lit(365)))).withColumn("v", F.round(curve(F.col("t")), 6))


def years(params: DataFrame) -> DataFrame:
    """``(y, x, year, p, days)``: a row for each pixel and year, with its parameters and the 365 days of the curve, each
    ``(v, m, season)`` with ``m`` the negative day, so that the largest is the first day of the maximum.

    Days stay inside of their row: nothing of 365 times the parameters is joined, sorted or sent. The curves take far
    longer than their parameters take room: they are dealt by number, not by bytes.
    """
    n = int(params.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    g = params.repartition(n, "y", "x").groupBy("y", "x", "year").agg(F.collect_list(F.struct(*P)).alias("p"))
    day = lambda p, t: F.struct(F.round(curve(t, lambda n: p[n]), 6).alias("v"), (-t).alias("m"), t.between(p["p2"], p["p4"]).alias("season"))
    return g.withColumn("days", F.flatten(F.transform("p", lambda p: F.transform(F.sequence(F.lit(1), F.lit(365)), lambda t: day(p, t)))))


def _values(days, where=None) -> Column:
    """The known values of the days (that meet ``where``)."""
    known = F.filter(days, lambda e: e["v"].isNotNull() if where is None else e["v"].isNotNull() & where(e))
    return F.transform(known, lambda e: e["v"])


def _total(values: Column) -> Column:
    """Null for none."""
    return F.when(F.size(values) > 0, F.aggregate(values, F.lit(0.0), lambda s, v: s + v))


def _mean(values: Column) -> Column:
    return _total(values) / F.nullif(F.size(values), F.lit(0))


def metrics(params: DataFrame) -> DataFrame:
    """SOS, EOS (half amplitude around p2 and p4 as fitted), peak and its day, end of maturity, mean over the season, TSVI and copies."""
    least = [F.array_min(F.col(f"p.{n}")).alias(n) for n in ("p0", "p2", "p3", "p4", "p5", "p6")]
    d = years(params).select("y", "x", "year", F.array_max("days").alias("_top"), _values("days", lambda e: e["season"]).alias("_s"), *least)
    d = d.withColumn("_mean", _mean(F.col("_s")))
    square = F.transform("_s", lambda v: (v - F.col("_mean")) * (v - F.col("_mean")))
    g = d.withColumns({"peak_vi": F.col("_top.v"), "peak_doy": -F.col("_top.m")})
    ok = (F.col("p2") < F.col("p4")) & F.col("peak_doy").between(F.col("p2"), F.col("p4") + 60)  # else over-fitted
    return g.select(
        "y", "x", "year", "peak_vi", "peak_doy", F.when(ok, F.round("p2", 4)).alias("sos"), F.when(ok, F.round("p4", 4)).alias("eos"), F.when(ok, F.round(F.col("p4") - 2 * F.col("p5"), 4)).alias("eom"),
        F.round("_mean", 6).alias("mavi"), F.round(F.sqrt(_mean(square)), 5).alias("mavi_std"), F.round(_total(F.col("_s")), 4).alias("tsvi"), F.round("p0", 6).alias("trough_vi"), F.round("p3", 6).alias("gr"), F.round("p5", 6).alias("dr"), F.round("p6", 6).alias("dr2"),
    )


def curve_summary(params: DataFrame, bloom: float = 0.3) -> DataFrame:
    """Annual, flood-season (days 121-304) and off-season means, maximum and its day, days in bloom and the bloom mean after the peak."""
    wet = lambda e: e["m"].between(-304, -121)
    d = years(params).select("y", "x", "year", "days", F.array_max("days").alias("_top"))
    d = d.withColumn("_bloom", F.filter("days", lambda e: e["v"] >= bloom))
    return d.select(
        "y", "x", "year", F.round(_mean(_values("days")), 6).alias("annual"), F.round(_mean(_values("days", wet)), 6).alias("flood_season"), F.round(_mean(_values("days", lambda e: ~wet(e))), 6).alias("off_season"),
        F.col("_top.v").alias("vmax"), (-F.col("_top.m")).alias("day_max"), F.size("_bloom").cast("long").alias("bloom_days"), F.round(_mean(_values("_bloom", lambda e: e["m"] < F.col("_top.m"))), 6).alias("bloom_after"),
    )


def _model(t: np.ndarray, p: np.ndarray) -> np.ndarray:
    """The curve of one row of parameters at ``t``, or of each row at its own row of ``t``."""
    p = [p[..., i, None] for i in range(7)]
    with np.errstate(over="ignore"):
        a, b = 1 / (1 + np.exp(np.clip((p[2] - t) / p[3], -60, 60))), 1 / (1 + np.exp(np.clip((p[4] - t) / p[5], -60, 60)))
    return p[0] + (p[1] - p[6] * t) * (a - b)


def _slopes(t: np.ndarray, p: np.ndarray) -> np.ndarray:
    """Derivatives of the curve by its parameters."""
    p = [p[..., i, None] for i in range(7)]
    u, w = (t - p[2]) / p[3], (t - p[4]) / p[5]
    a, b = 1 / (1 + np.exp(-np.clip(u, -60, 60))), 1 / (1 + np.exp(-np.clip(w, -60, 60)))
    height = p[1] - p[6] * t
    up, down = height * a * (1 - a) / p[3], height * b * (1 - b) / p[5]
    return np.stack([np.ones_like(u), a - b, -up, -up * u, down, down * w, -t * (a - b)], axis=-1)


LOW = np.array([-0.2, 0.05, 30.0, 3.0, 180.0, 3.0, 0.0])
HIGH = np.array([0.6, 1.2, 180.0, 40.0, 340.0, 40.0, 0.005])


def fit_double_logistic(t: np.ndarray, v: np.ndarray, low=LOW, high=HIGH, rounds: int = 200) -> tuple[np.ndarray, float]:
    """Bounded least squares by damped Gauss-Newton steps that are cut at the bounds; (parameters, R2)."""
    p, r2 = fit_double_logistics([(t, v)], low[None], high[None], rounds)
    return p[0], float(r2[0])


def fit_double_logistics(series: list[tuple[np.ndarray, np.ndarray]], low: np.ndarray, high: np.ndarray, rounds: int = 200) -> tuple[np.ndarray, np.ndarray]:
    """``fit_double_logistic`` of many ``(t, v)``, each inside of its row of bounds; (rows of parameters, R2 of each).

    Fits of about equal length take their steps together, some 16,000 values at a time; each has its own damping and end.
    """
    p, r2 = np.zeros((len(series), 7)), np.zeros(len(series))
    n = np.array([len(t) for t, _ in series], np.int64)
    order, i = np.argsort(-n, kind="stable"), 0
    while i < len(order):
        k = int(n[order[i]])
        some = order[i : i + max(1, (1 << 14) // k)]
        t, v = np.zeros((len(some), k)), np.zeros((len(some), k))
        for j, at in enumerate(some.tolist()):
            t[j, : n[at]], v[j, : n[at]] = series[at]
        p[some], r2[some] = _fit_rows(t, v, n[some], low[some], high[some], rounds)
        i += len(some)
    return p, r2


def _fit_rows(t: np.ndarray, v: np.ndarray, n: np.ndarray, low: np.ndarray, high: np.ndarray, rounds: int) -> tuple[np.ndarray, np.ndarray]:
    """Fits of the first ``n`` values of each row."""
    known = np.arange(t.shape[1]) < n[:, None]
    rows = np.arange(len(n))
    v_sorted = np.sort(np.where(known, v, np.inf), axis=1)
    at = 0.1 * (n - 1)
    below = at.astype(np.int64)
    a, b = v_sorted[rows, below], v_sorted[rows, np.minimum(below + 1, n - 1)]
    tenth, width = a + (b - a) * (at - below), v_sorted[rows, n - 1] - v_sorted[:, 0]
    best, least = np.zeros_like(low), np.full(len(n), np.inf)
    for start in (0.3, 0.5, 0.7):
        p = low + (high - low) * start
        p[:, 0], p[:, 1] = np.clip(tenth, low[:, 0], high[:, 0]), np.clip(width, low[:, 1], high[:, 1])
        r = np.where(known, v - _model(t, p), 0.0)
        live = [rows, t, v, known, low, high, p, r, (r * r).sum(axis=1), np.full(len(n), 1e-2)]
        for k in range(rounds + 1):
            if k < rounds:
                live, stop = _step(*live)
            else:
                stop = np.ones(len(live[0]), bool)
            if stop.any():
                at, cost = live[0][stop], live[8][stop]
                better = cost < least[at]
                best[at[better]], least[at[better]] = live[6][stop][better], cost[better]
                live = [x[~stop] for x in live]
            if not len(live[0]):
                break
    mean = np.where(known, v, 0.0).sum(axis=1) / n
    spread = np.where(known, (v - mean[:, None]) ** 2, 0.0).sum(axis=1)
    return best, np.where(spread > 0, 1 - least / np.where(spread > 0, spread, 1.0), 0.0)


def _step(rows, t, v, known, low, high, p, r, cost, damp) -> tuple[list[np.ndarray], np.ndarray]:
    """One step of each row: the same arrays after it, and which rows are at their end."""
    j = np.where(known[:, :, None], _slopes(t, p), 0.0)
    jt = j.swapaxes(1, 2)
    a, g = jt @ j, (jt @ r[:, :, None])[:, :, 0]
    free = ~(((p <= low) & (g < 0)) | ((p >= high) & (g > 0)))
    # Least squares of least norm on the free parameters; those that are held have rows and columns of zeros.
    m = np.where(free[:, :, None] & free[:, None, :], a, 0.0)
    m[:, range(7), range(7)] += np.where(free, damp[:, None] * (a[:, range(7), range(7)] + 1e-9), 0.0)
    e, q = np.linalg.eigh(m)
    size = np.abs(e)
    used = size > np.finfo(float).eps * free.sum(axis=1)[:, None] * size.max(axis=1, keepdims=True)
    part = (q.swapaxes(1, 2) @ np.where(free, g, 0.0)[:, :, None])[:, :, 0] * used / np.where(used, e, 1.0)
    new = np.clip(p + np.where(free, (q @ part[:, :, None])[:, :, 0], 0.0), low, high)
    s = np.where(known, v - _model(t, new), 0.0)
    less = (s * s).sum(axis=1)
    held, better = ~free.any(axis=1), less < cost
    better &= ~held
    done = better & (cost - less < 1e-9 * np.maximum(1e-9, cost))
    damp = np.where(better, np.maximum(damp / 4, 1e-9), damp * 4)
    p, r, cost = np.where(better[:, None], new, p), np.where(better[:, None], s, r), np.where(better, less, cost)
    return [rows, t, v, known, low, high, p, r, cost, damp], held | done | (~better & (damp > 1e8))


def fit_curves(obs: DataFrame, least: int = 7, together: int = 1 << 16) -> DataFrame:
    """``(y, x, year, p0..p6, r2, n)``: pooled fit of each pixel, then a fit of each year inside of bounds around it.

    A pixel's history is a few thousand dates. A task takes its pixels in order, about ``together`` values at a time, and
    fits these side by side. Years with fewer than ``least`` values have no fit.
    """
    import pyarrow as pa
    import pyarrow.compute as pc

    kinds = [pa.int32()] * 3 + [pa.float64()] * 8 + [pa.int64()]

    def starts(b: pa.Table, names: list[str]) -> np.ndarray:
        """Where rows differ from the row before."""
        parts = [f(b.column(c)).to_numpy() for c in names for f in (pc.is_null, lambda x: pc.fill_null(x, 0))]
        return np.flatnonzero(np.concatenate([[True], np.any([x[1:] != x[:-1] for x in parts], axis=0)]))

    def spans(b: pa.Table, names: list[str]) -> list[tuple[int, int]]:
        """Groups with values enough."""
        at = [*starts(b, names).tolist(), b.num_rows]
        return [(i, j) for i, j in zip(at, at[1:]) if j - i >= least]

    def fit(b: pa.Table):
        t, v = b.column("doy").to_numpy().astype(float), b.column("value").to_numpy()
        of = lambda at: [(t[i:j], v[i:j]) for i, j in at]
        pixel, year = spans(b, ["y", "x"]), spans(b, ["y", "x", "year"])
        if year:
            pooled, _ = fit_double_logistics(of(pixel), np.tile(LOW, (len(pixel), 1)), np.tile(HIGH, (len(pixel), 1)))
            pooled = pooled[np.searchsorted([i for i, _ in pixel], [i for i, _ in year], "right") - 1]
            room = np.array([0.15, 0.3, 25, 10, 30, 10, 0.002])
            p, r2 = fit_double_logistics(of(year), np.maximum(LOW, pooled - room), np.minimum(HIGH, pooled + room))
            keys = [c.combine_chunks() for c in b.select(["y", "x", "year"]).take([i for i, _ in year]).columns]
            cols = [*keys, *p.T, r2, [j - i for i, j in year]]
            yield pa.RecordBatch.from_arrays([c.cast(k) if isinstance(c, pa.Array) else pa.array(c, k) for c, k in zip(cols, kinds)], ["y", "x", "year", *P, "r2", "n"])

    def run(rows):
        held, n, most = [], 0, together
        for b in rows:
            held, n = [*held, b], n + b.num_rows
            if n >= most:
                all_held = pa.Table.from_batches(held)
                last = int(starts(all_held, ["y", "x"])[-1])  # may go on in the next batch
                yield from fit(all_held.slice(0, last)) if last else ()
                held = all_held.slice(last).combine_chunks().to_batches()
                n -= last
                most = max(together, 2 * n)
        if n:
            yield from fit(pa.Table.from_batches(held))

    o = obs.filter("value is not null").select("y", "x", F.year("date").alias("year"), F.dayofyear("date").alias("doy"), F.col("value").cast("double").alias("value"))
    # A fit takes far longer than its rows take room: pixels are dealt by number, not by bytes.
    o = o.repartition(int(o.sparkSession.conf.get("spark.sql.shuffle.partitions")), "y", "x").sortWithinPartitions("y", "x", "year", "doy", "value")
    return o.mapInArrow(run, "y int, x int, year int, " + ", ".join(f"{p} double" for p in P) + ", r2 double, n bigint")


def fit_fourier(obs: DataFrame, frequencies=(0.015, 0.016, 0.017, 0.018, 0.019), by: list[str] | None = None) -> DataFrame:
    """Two-term Fourier fit by pixel (or ``by`` other keys): for each frequency the normal equations are sums that Spark
    adds up; the best R2 stays.

    ``(y, x, w, c0..c4, r2, n)`` for c0 + c1 cos wt + c2 sin wt + c3 cos 2wt + c4 sin 2wt.
    """
    import pyarrow as pa

    by = by or ["y", "x"]
    o = obs.filter("value is not null").select(*by, F.dayofyear("date").cast("double").alias("t"), "value").withColumn("w", F.explode(F.array(*map(F.lit, frequencies))))
    terms = [F.lit(1.0), F.cos(F.col("w") * F.col("t")), F.sin(F.col("w") * F.col("t")), F.cos(2 * F.col("w") * F.col("t")), F.sin(2 * F.col("w") * F.col("t")), F.col("value")]
    o = o.withColumns({f"b{i}": c for i, c in enumerate(terms)})
    pairs = [(i, j) for i in range(6) for j in range(i, 6)]
    sums = o.groupBy(*by, "w").agg(F.count(F.lit(1)).alias("n"), F.array(*[F.sum(F.col(f"b{i}") * F.col(f"b{j}")) for i, j in pairs]).alias("s"))
    names = [*[f"c{i}" for i in range(5)], "r2"]

    def solve(rows):
        for b in rows:
            out = []
            for n, sums_of in zip(b.column(len(by) + 1).to_pylist(), b.column(len(by) + 2).to_pylist()):
                m = np.zeros((6, 6))
                for (i, j), v in zip(pairs, sums_of):
                    m[i, j] = m[j, i] = v
                c = np.linalg.lstsq(m[:5, :5] + 1e-9 * np.eye(5), m[:5, 5], rcond=None)[0]
                spread = m[5, 5] - m[0, 5] ** 2 / n
                rest = m[5, 5] - 2 * c @ m[:5, 5] + c @ m[:5, :5] @ c
                out.append([*c, 1 - rest / spread if spread > 1e-12 else 0.0])
            cols = np.array(out).reshape(-1, 6).T
            yield pa.RecordBatch.from_arrays([*b.columns[: len(by) + 2], *map(pa.array, cols)], [*by, "w", "n", *names])

    keys = ", ".join(f"{k} {sums.schema[k].dataType.simpleString()}" for k in by)
    fits = sums.mapInArrow(solve, f"{keys}, w double, n bigint, " + ", ".join(f"{c} double" for c in names)).select(*by, "w", *names, "n")
    best = F.max_by(F.struct(*[c for c in fits.columns if c not in by]), F.struct("r2", -F.col("w")))
    return fits.groupBy(*by).agg(best.alias("s")).select(*by, "s.*")


def both_fits(obs: DataFrame) -> DataFrame:
    """``(y, x, year, model, r2)`` of the double logistic and of the two-term Fourier curve by pixel and year; years that have both."""
    logistic = fit_curves(obs).select("y", "x", "year", F.round("r2", 6).alias("r2"))
    fourier = fit_fourier(obs.withColumn("year", F.year("date")), by=["y", "x", "year"]).join(logistic.select("y", "x", "year"), ["y", "x", "year"]).select("y", "x", "year", F.round("r2", 6).alias("r2"))
    return logistic.withColumn("model", F.lit("double_logistic")).unionByName(fourier.withColumn("model", F.lit("fourier")))


def recovery_time(ymax: Column, y0: Column, rate: Column, reached: float = 0.99) -> Column:
    """Days until ymax - (ymax - y0) e^(-rate t) gets to a share of ymax; null where it never does or is there already."""
    rest = (1 - reached) * ymax / F.nullif(ymax - y0, F.lit(0.0))
    return F.when((rest > 0) & (rest < 1) & (rate > 0), -F.ln(rest) / rate)


def fit_recovery(series: DataFrame, keys: list[str], low: float = 1e-4, high: float = 1e2, rates: int = 16, rounds: int = 12) -> DataFrame:
    """``(keys, ymax, y0, rate, sse, n)``: the recovery curve ymax - (ymax - y0) e^(-rate t) of least squares by group.

    Variable projection: for a rate both linear parameters follow from sums, which Spark adds up; so only the rate is
    searched, between ``low`` and ``high``, ``rates`` at a time, each round between the neighbours of the best. Values are
    summed by time first and stored by group; a round adds up the sums of all its rates side by side, without a row for
    each rate. ``series(keys, t, value)``; groups with fewer than three times have no curve.
    """
    known = series.filter("value is not null and t is not null").select(*keys, F.col("t").cast("double").alias("t"), "value")
    at = (known.repartition(*keys) if keys else known).groupBy(*keys, "t").agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("s"), F.sum(F.col("value") * F.col("value")).alias("q"))
    at = stage(at, "recovery")
    bounds = at.groupBy(*keys).agg(F.count(F.lit(1)).alias("_m")).filter("_m > 2").select(*keys, F.lit(float(np.log(low))).alias("_lo"), F.lit(float(np.log(high))).alias("_hi"))

    def rate(k: int | Column) -> Column:
        return F.exp(F.col("_lo") + (F.col("_hi") - F.col("_lo")) / (rates - 1) * k)

    def tried() -> Column:
        """The best line for each rate from its sums."""
        n, sy, q = F.col("n"), F.col("sy"), F.col("q")
        rest = F.array(*[F.struct(F.lit(k).alias("_k"), F.col(f"_se{k}").alias("se"), F.col(f"_see{k}").alias("see"), F.col(f"_sye{k}").alias("sye")) for k in range(rates)])
        lines = F.transform(rest, lambda e: F.struct(e["_k"].alias("_k"), e["se"].alias("se"), e["sye"].alias("sye"), ((n * e["sye"] - e["se"] * sy) / F.nullif(n * e["see"] - e["se"] * e["se"], F.lit(0.0))).alias("b")))
        lines = F.transform(lines, lambda e: F.struct(e["_k"].alias("_k"), e["sye"].alias("sye"), e["b"].alias("b"), ((sy - e["b"] * e["se"]) / n).alias("ymax")))
        of = lambda e: F.struct((q - e["ymax"] * sy - e["b"] * e["sye"]).alias("sse"), e["_k"].alias("_k"), rate(e["_k"]).alias("rate"), e["ymax"].alias("ymax"), e["b"].alias("_b"), n.alias("n"), F.col("_lo"), F.col("_hi"))
        return F.array_min(F.filter(F.transform(lines, of), lambda m: m["sse"].isNotNull()))

    for _ in range(rounds):
        j = (at.join(bounds, keys) if keys else at.crossJoin(bounds)).withColumns({f"_e{k}": F.exp(-rate(k) * F.col("t")) for k in range(rates)})
        sums = [F.sum(c).alias(f"_{name}{k}") for k in range(rates) for e in [F.col(f"_e{k}")] for name, c in (("se", F.col("n") * e), ("see", F.col("n") * e * e), ("sye", F.col("s") * e))]
        g = j.groupBy(*keys, "_lo", "_hi").agg(F.sum("n").alias("n"), F.sum("s").alias("sy"), F.sum("q").alias("q"), *sums)
        best = g.select(*keys, tried().alias("_m")).filter("_m is not null")
        step = (F.col("_m._hi") - F.col("_m._lo")) / (rates - 1)
        near = lambda o: F.col("_m._lo") + step * F.least(F.greatest(F.col("_m._k") + o, F.lit(0)), F.lit(rates - 1))
        best = stage(best.select(*keys, "_m", near(-1).alias("_lo"), near(1).alias("_hi")), "recovery")
        bounds = best.select(*keys, "_lo", "_hi")
    m = F.col("_m")
    return best.select(*keys, m["ymax"].alias("ymax"), (m["ymax"] + m["_b"]).alias("y0"), m["rate"].alias("rate"), F.greatest(m["sse"], F.lit(0.0)).alias("sse"), m["n"].alias("n"))


def resistance(series: DataFrame, keys: list[str], change: float, second: float) -> DataFrame:
    """Three ratios (highest - lowest) / highest by group: before ``change``; after it, with the lowest until ``second``; and
    with the lowest from ``second`` on. ``series(keys, t, value)``."""
    v, t = F.col("value"), F.col("t")
    pre, post = F.max(F.when(t < change, v)), F.max(F.when(t >= change, v))
    ratio = lambda top, low, name: F.round((top - low) / F.nullif(top, F.lit(0.0)), 9).alias(name)
    return series.groupBy(*keys).agg(
        ratio(pre, F.min(F.when(t < change, v)), "resistance1"), ratio(post, F.min(F.when((t >= change) & (t < second), v)), "resistance2"), ratio(post, F.min(F.when(t >= second, v)), "resistance3")
    )


def preferred_curve(fits: DataFrame, keys: list[str]) -> DataFrame:
    """Of several models' fits ``(keys, model, r2)``, the best; of equals the first by name."""
    return fits.groupBy(*keys).agg(F.min_by("model", F.struct(-F.col("r2"), "model")).alias("model"), F.max("r2").alias("r2"))


def index_fitness(obs: DataFrame, low: float = 0.1) -> DataFrame:
    """How well an index suits curve fitting: share of low values, and share of the dates whose spatial mean is within
    25 % of the seven-parameter curve through all dates, with the curve's R2. One row.

    The curve is fitted to the means by day of the year, weighted by their dates: 366 rows at most.
    """
    import pyarrow as pa

    means = obs.filter("value is not null").groupBy("date").agg(F.avg("value").alias("value")).withColumn("doy", F.dayofyear("date"))

    def run(t: pa.Table) -> pa.Table:
        order = np.argsort(t.column("doy").to_numpy())
        day, v, n = (t.column(c).to_numpy().astype(float)[order] for c in ("doy", "value", "n"))
        p, _ = fit_double_logistic(np.repeat(day, n.astype(int)), np.repeat(v, n.astype(int)))
        return pa.table({k: pa.array([float(x)]) for k, x in zip(P, p)})

    by_day = means.groupBy("doy").agg(F.avg("value").alias("value"), F.count(F.lit(1)).alias("n"))
    fit = by_day.groupBy().applyInArrow(run, ", ".join(f"{p} double" for p in P))
    j = means.withColumn("t", F.col("doy").cast("double")).crossJoin(F.broadcast(fit))  # one row
    gap = F.col("value") - curve(F.col("t"))
    spread = F.var_pop("value") * F.count(F.lit(1))
    a = j.agg(F.round(1 - F.sum(gap * gap) / F.nullif(spread, F.lit(0.0)), 6).alias("r2"), F.round(F.count_if(F.abs(gap) <= 0.25 * F.abs(curve(F.col("t")))) / F.count(F.lit(1)), 6).alias("near_share"))
    share = obs.filter("value is not null").agg(F.round(F.count_if(F.col("value") < low) / F.count(F.lit(1)), 6).alias("low_share"))
    return share.crossJoin(a)  # one row each
