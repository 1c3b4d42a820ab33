"""Break detection on pixel series: harmonic models by lasso, a stable start, and sustained exceedance.

A pixel's series is one group (thousands of dates at most). Segments come out as rows of fixed shape.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

YEAR = 365.25
#: Chi-square quantile at 0.99 by number of bands (fixed values).
CHI2_99 = {1: 6.6349, 2: 9.2103, 3: 11.3449, 4: 13.2767, 5: 15.0863, 6: 16.8119, 7: 18.4753}


def design(t: np.ndarray, terms: int) -> np.ndarray:
    w = 2 * np.pi / YEAR
    cols = [np.ones_like(t), t / YEAR]
    for k in range(1, terms // 2):
        cols += [np.cos(k * w * t), np.sin(k * w * t)]
    return np.stack(cols, axis=1)


def lasso(x: np.ndarray, y: np.ndarray, penalty: float = 0.01, rounds: int = 60) -> np.ndarray:
    """Coordinate descent on standardised columns; the constant is not shrunk."""
    mean, scale = x[:, 1:].mean(0), x[:, 1:].std(0)
    scale[scale == 0] = 1
    z, c = (x[:, 1:] - mean) / scale, y - y.mean()
    b, r, n = np.zeros(z.shape[1]), c.copy(), len(y)
    for _ in range(rounds):
        moved = 0.0
        for j in range(len(b)):
            g = z[:, j] @ r / n + b[j]
            new = np.sign(g) * max(abs(g) - penalty, 0)
            if new != b[j]:
                r -= z[:, j] * (new - b[j])
                moved, b[j] = max(moved, abs(new - b[j])), new
        if moved < 1e-6:
            break
    b = b / scale
    return np.concatenate([[y.mean() - mean @ b], b])


def segment_series(t: np.ndarray, v: np.ndarray, run: int = 6, least: int = 12) -> list[dict]:
    """Segments of one pixel: ``t`` days, ``v`` (dates, bands). Single outlying dates are left out of the fits."""
    limit = CHI2_99[min(v.shape[1], 7)]
    out, i, n = [], 0, len(t)
    keep = np.ones(n, bool)
    noise = np.maximum(np.median(np.abs(np.diff(v, axis=0)), axis=0), 1e-6) if n > 1 else np.ones(v.shape[1])
    while i + least <= n:
        # A start has a whole year, else the harmonics run wild beyond it.
        stop, last, coefs, rmse, magnitude = max(i + least, int(np.searchsorted(t, t[i] + YEAR))), None, None, None, None
        if stop > n:
            break
        while True:  # a stable start: slope and ends inside of three times the error
            at = np.flatnonzero(keep[i:stop]) + i
            x = design(t[at], 4)
            coefs = np.stack([lasso(x, v[at, k]) for k in range(v.shape[1])])
            rest = v[at] - x @ coefs.T
            rmse = np.maximum(np.sqrt((rest**2).mean(0)), noise)
            drift = np.abs(coefs[:, 1]) * (t[at[-1]] - t[at[0]]) / YEAR + np.abs(rest[0]) + np.abs(rest[-1])
            if (drift / (3 * rmse)).mean() < 1 or stop >= n:
                break
            i, stop = i + 1, min(n, max(stop + 1, i + 1 + least))
        broke = False
        while stop < n:
            size = stop - i
            terms = 8 if size >= 24 else 6 if size >= 18 else 4
            if last is None or size >= last * 1.33:  # refit when a third longer
                at = np.flatnonzero(keep[i:stop]) + i
                x = design(t[at], terms)
                coefs = np.stack([lasso(x, v[at, k]) for k in range(v.shape[1])])
                rmse, last = np.maximum(np.sqrt(((v[at] - x @ coefs.T) ** 2).mean(0)), noise), size
            ahead = np.arange(stop, min(stop + run, n))
            rest = v[ahead] - design(t[ahead], 2 + coefs.shape[1] - 2)[:, : coefs.shape[1]] @ coefs.T
            score = ((rest / rmse) ** 2).sum(1)
            if len(ahead) == run and score.min() > limit:
                magnitude, broke = np.median(rest, axis=0), True
                break
            if score[0] > limit * 2:
                keep[stop] = False
            stop += 1
        out.append({"t_start": int(t[i]), "t_end": int(t[stop - 1]), "t_break": int(t[stop]) if broke else 0, "num_obs": int(keep[i:stop].sum()), "rmse": rmse.tolist(), "magnitude": (magnitude if broke else np.zeros(v.shape[1])).tolist(), "coefs": coefs.tolist()})
        if not broke:
            break
        i = stop
    return out


def detect_breaks(wide: DataFrame, names: list[str], least: int = 20) -> DataFrame:
    """Segments by pixel from ``(y, x, date, names..)``; rows with a missing band go, pixels with ``least`` rows or fewer too.

    ``(y, x, seg, t_start, t_end, t_break, num_obs, rmse, magnitude, coefs)``; days since 1970, t_break 0 without a break.
    """
    import pyarrow as pa

    kind = pa.schema([("y", pa.int32()), ("x", pa.int32()), ("seg", pa.int32()), ("t_start", pa.int32()), ("t_end", pa.int32()), ("t_break", pa.int32()), ("num_obs", pa.int32()), ("rmse", pa.list_(pa.float64())), ("magnitude", pa.list_(pa.float64())), ("coefs", pa.list_(pa.list_(pa.float64())))])

    def run(g: pa.Table) -> pa.Table:
        t = g.column("t").to_numpy().astype(float)
        order = np.argsort(t, kind="stable")
        v = np.stack([g.column(c).to_numpy() for c in names], axis=1)[order]
        found = segment_series(t[order], v) if len(t) > least else []
        y, x = g.column("y")[0].as_py(), g.column("x")[0].as_py()
        return pa.Table.from_pylist([{"y": y, "x": x, "seg": k, **s} for k, s in enumerate(found)], schema=kind)

    rows = wide.select("y", "x", F.unix_date("date").alias("t"), *names).na.drop().groupBy("y", "x", "t").agg(*[F.avg(c).alias(c) for c in names])
    rows = rows.repartition(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), "y", "x")  # by number: fits take long
    return rows.groupBy("y", "x").applyInArrow(run, "y int, x int, seg int, t_start int, t_end int, t_break int, num_obs int, rmse array<double>, magnitude array<double>, coefs array<array<double>>")


def break_summary(segments: DataFrame) -> DataFrame:
    """Breaks by pixel: how many, first and last date."""
    b = F.when(F.col("t_break") > 0, F.col("t_break"))
    return segments.groupBy("y", "x").agg(F.count(b).alias("n_breaks"), F.date_from_unix_date(F.min(b)).alias("first_break"), F.date_from_unix_date(F.max(b)).alias("last_break"))
