"""As-of, interval and gap-filling operators over dates.

Interval joins always carry an equality (pixel or station, and year), so that rows are hashed and not compared all with all.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def interpolate(d: Column, d0: Column, v0: Column, d1: Column, v1: Column) -> Column:
    """Linear in days between (d0, v0) and (d1, v1); v0 where both dates are one."""
    span = F.datediff(d1, d0)
    return F.when(span == 0, v0).otherwise(v0 + (v1 - v0) * F.datediff(d, d0) / F.nullif(span, F.lit(0)))


def value_at(requests: DataFrame, obs: DataFrame, window: int, keys: list[str], same_year: bool = False) -> DataFrame:
    """Value of ``obs(keys, date, value)`` at each request's ``at``: exact, else linear between the nearest earlier and
    later valid dates within ``window`` days (within one year if ``same_year``); null if a side is missing.

    Days are bucketed by the window, and a request meets three buckets, so the join is an equality on keys and bucket.
    """
    bucket = lambda d: F.floor(F.unix_date(d) / window)
    r = requests.withColumn("_rid", F.struct(*[F.col(c) for c in requests.columns]))
    left = r.withColumn("_b", F.explode(F.array(*[bucket(F.col("at")) + k for k in (-1, 0, 1)])))
    right = obs.filter("value is not null").select(*keys, F.col("date").alias("_d"), F.col("value").alias("_v"), bucket(F.col("date")).alias("_b"))
    near = (F.abs(F.datediff("_d", "at")) <= window) & ((F.year("_d") == F.year("at")) if same_year else F.lit(True))
    j = left.join(right, [*keys, "_b"], "left").withColumns({"_v": F.when(near, F.col("_v")), "_d": F.when(near, F.col("_d"))})
    before, after = F.col("_d") <= F.col("at"), F.col("_d") >= F.col("at")
    g = j.groupBy("_rid").agg(
        F.max(F.when(before, F.col("_d"))).alias("d0"), F.max_by(F.when(before, F.col("_v")), F.when(before, F.col("_d"))).alias("v0"),
        F.min(F.when(after, F.col("_d"))).alias("d1"), F.min_by(F.when(after, F.col("_v")), F.when(after, F.col("_d"))).alias("v1"),
    )
    return g.select("_rid.*", F.round(interpolate(F.col("at"), F.col("d0"), F.col("v0"), F.col("d1"), F.col("v1")), 9).alias("value"))


def fill_gaps(series: DataFrame, keys: list[str], longest: int = 60) -> DataFrame:
    """Daily series by key from its first to its last date: linear over gaps of up to ``longest`` days, else the last value."""
    spans = series.groupBy(*keys).agg(F.min("date").alias("a"), F.max("date").alias("b"))
    days = spans.select(*keys, F.explode(F.sequence("a", "b")).alias("date"))
    j = days.join(series.groupBy(*keys, "date").agg(F.avg("value").alias("value")), [*keys, "date"], "left")
    w = Window.partitionBy(*keys).orderBy("date")
    back, ahead = w.rowsBetween(Window.unboundedPreceding, 0), w.rowsBetween(0, Window.unboundedFollowing)
    known = F.when(F.col("value").isNotNull(), F.col("date"))
    j = j.withColumns({
        "d0": F.last(known, True).over(back), "v0": F.last("value", True).over(back),
        "d1": F.first(known, True).over(ahead), "v1": F.first("value", True).over(ahead),
    })
    near = F.datediff("d1", "d0") <= longest
    v = F.when(near, interpolate(F.col("date"), F.col("d0"), F.col("v0"), F.col("d1"), F.col("v1"))).otherwise(F.col("v0"))
    return j.select(*keys, "date", F.round(v, 9).alias("value"), F.col("value").isNull().alias("filled"))


def within_phases(env: DataFrame, phases: DataFrame, keys: list[str], how: str, base: str | bool = False, digits: int = 9) -> DataFrame:
    """Environment from ``start`` (inclusive) to ``end`` (exclusive), days of the year, by key and year: acc, ave or max.

    ``base`` takes off the mean of the days around the start (True: up to five on both sides; "first": the first ten of the phase).
    """
    e = env.select(*keys, F.year("date").alias("year"), F.dayofyear("date").alias("_doy"), "value")
    j = e.join(phases.select(*keys, "year", "start", "end"), [*keys, "year"])
    inside, after = (F.col("_doy") >= F.col("start")) & (F.col("_doy") < F.col("end")), F.col("_doy") - F.col("start")
    early = after.between(0, 9) if base == "first" else F.abs(after) <= 5
    v = F.when(inside, F.col("value"))
    if base:
        b = j.groupBy(*keys, "year").agg(F.avg(F.when(early, F.col("value"))).alias("_base"))
        j = j.join(b, [*keys, "year"])
        v = v - F.coalesce("_base", F.lit(0.0))
    agg = {"acc": F.sum(v), "ave": F.avg(v), "max": F.max(v)}[how]
    return j.groupBy(*keys, "year").agg(F.round(agg, digits).alias("value"), F.count(v).alias("n"))


def growing_degrees(env: DataFrame, bounds: DataFrame, keys: list[str], base: float) -> DataFrame:
    """Accumulated value over a base up to ``peak`` and up to ``at`` (days of the year), and the share of the first."""
    e = env.select(*keys, F.year("date").alias("year"), F.dayofyear("date").alias("_doy"), F.greatest(F.col("value") - base, F.lit(0.0)).alias("_v"))
    j = e.join(bounds, [*keys, "year"])
    s = j.groupBy(*keys, "year").agg(F.sum(F.when(F.col("_doy") <= F.col("peak"), F.col("_v"))).alias("p"), F.sum(F.when(F.col("_doy") <= F.col("at"), F.col("_v"))).alias("a"))
    return s.select(*keys, "year", F.round("p", 4).alias("to_peak"), F.round("a", 4).alias("to_date"), F.round(F.col("a") / F.nullif(F.col("p"), F.lit(0.0)), 9).alias("share"))


def stats_until(obs: DataFrame, keys: list[str], first: int, last: int) -> DataFrame:
    """Max, min, mean and population std by key and year between two days of the year."""
    o = obs.filter(F.dayofyear("date").between(first, last))
    return o.groupBy(*keys, F.year("date").alias("year")).agg(F.max("value").alias("vmax"), F.min("value").alias("vmin"), F.round(F.avg("value"), 9).alias("vmean"), F.round(F.stddev_pop("value"), 7).alias("vstd"))


def year_on_year(metric: DataFrame, keys: list[str]) -> DataFrame:
    """Change to the next year: absolute, and relative to the earlier year."""
    nxt = metric.select(*keys, (F.col("year") - 1).alias("year"), F.col("value").alias("_next"))
    return metric.join(nxt, [*keys, "year"]).select(*keys, "year", F.round(F.col("_next") - F.col("value"), 9).alias("change"), F.round((F.col("_next") - F.col("value")) / F.nullif(F.col("value"), F.lit(0.0)), 10).alias("relative"))


def between_floods(obs: DataFrame, flood: DataFrame) -> DataFrame:
    """Count, mean and maximum of each span of ``rebuilt_series``, values of any sign."""
    j = spans_between(obs, flood)
    return j.groupBy("y", "x", "year").agg(F.count("value").alias("n"), F.round(F.avg("value"), 9).alias("mean_value"), F.round(F.max("value"), 9).alias("max_value"))


def rebuilt_series(obs: DataFrame, flood: DataFrame) -> DataFrame:
    """``(y, x, year, date, day, value)``: the series outside of inundation, positive values only. A span runs from the
    last wet date of one year with floods to the first of the next; it bears that next year, and ``day`` counts from its start."""
    return spans_between(obs, flood).filter("value > 0").select("y", "x", "year", "date", F.datediff("date", "since").alias("day"), "value")


def spans_between(obs: DataFrame, flood: DataFrame) -> DataFrame:
    """Values of a pixel after its last wet date before the year's first wet date (the series outside of inundation)."""
    wet = flood.filter("cls = 2").select("y", "x", F.col("date").alias("_wet")).withColumn("year", F.year("_wet"))
    first = wet.groupBy("y", "x", "year").agg(F.min("_wet").alias("until"), F.max("_wet").alias("_last"))
    w = Window.partitionBy("y", "x").orderBy("year")
    spans = first.select("y", "x", F.lag("_last").over(w).alias("since"), "until", "year").filter("since is not null")
    o = obs.withColumn("_year", F.year("date"))
    # A span covers the rest of one year and the start of the next: two equalities, no range join.
    s = spans.withColumn("_year", F.explode(F.sequence(F.year("since"), F.col("year"))))
    return o.join(s, ["y", "x", "_year"]).filter((F.col("date") > F.col("since")) & (F.col("date") < F.col("until")))


def annual_peak(obs: DataFrame, first: int = 90, last: int = 210, least: float = 0.5) -> DataFrame:
    """Yearly maximum and its date. Outside of the days first..last the best inside counts, if it is at least ``least``."""
    inside = F.dayofyear("date").between(first, last)
    key, key_in = F.struct("value", -F.unix_date("date")), F.when(inside, F.struct("value", -F.unix_date("date")))
    a = obs.groupBy("y", "x", F.year("date").alias("year")).agg(F.max_by("date", key).alias("d"), F.max("value").alias("v"), F.max_by("date", key_in).alias("di"), F.max(F.when(inside, F.col("value"))).alias("vi"))
    ok = F.dayofyear("d").between(first, last)
    return a.select("y", "x", "year", F.when(ok, F.col("d")).when(F.col("vi") >= least, F.col("di")).alias("peak_date"), F.when(ok, F.col("v")).when(F.col("vi") >= least, F.col("vi")).alias("peak"))


def peak_to_flood(obs: DataFrame, flood: DataFrame) -> DataFrame:
    """Mean value from a year's peak to the first wet date after it (or the end of the year)."""
    p = peaks_and_floods(obs, flood)
    o = obs.withColumn("year", F.year("date"))
    j = o.join(p, ["y", "x", "year"]).filter((F.col("date") >= F.col("peak_date")) & (F.col("flooded").isNull() | (F.col("date") < F.col("flooded"))))
    return j.groupBy("y", "x", "year").agg(F.count("value").alias("n"), F.round(F.avg("value"), 9).alias("mean_value"))


def peaks_and_floods(obs: DataFrame, flood: DataFrame) -> DataFrame:
    """``(y, x, year, peak_date, flooded)``: a year's peak and the first wet date after it in the year, if any."""
    peak = annual_peak(obs).filter("peak_date is not null")
    wet = flood.filter("cls = 2").select("y", "x", F.col("date").alias("_wet"), F.year("date").alias("year"))
    p = peak.join(wet, ["y", "x", "year"], "left")
    return p.groupBy("y", "x", "year", "peak_date").agg(F.min(F.when(F.col("_wet") > F.col("peak_date"), F.col("_wet"))).alias("flooded"))


def matched_peak_to_flood(obs: DataFrame, flood: DataFrame) -> DataFrame:
    """``(y, x, year, duration, mean_this, mean_next, change)``: mean values of two following years from their peaks on,
    both over the days of the shorter season (365 where a year has no flood after its peak; one of the two must have one).
    """
    p = peaks_and_floods(obs, flood).withColumn("_d", F.datediff("flooded", "peak_date"))
    nxt = p.select("y", "x", (F.col("year") - 1).alias("year"), F.col("peak_date").alias("_peak1"), F.col("_d").alias("_d1"))
    m = p.join(nxt, ["y", "x", "year"]).filter("_d is not null or _d1 is not null")
    m = m.withColumn("duration", F.least(F.coalesce("_d", F.lit(365)), F.coalesce("_d1", F.lit(365))))
    # A season meets its own year's values: one equality for each of the two.
    sides = F.explode(F.array(F.struct(F.col("year").alias("_year"), F.col("peak_date").alias("_from"), F.lit(0).alias("_side")), F.struct((F.col("year") + 1).alias("_year"), F.col("_peak1").alias("_from"), F.lit(1).alias("_side"))))
    s = m.select("y", "x", "year", "duration", sides.alias("_s")).select("y", "x", "year", "duration", "_s.*")
    j = obs.withColumn("_year", F.year("date")).join(s, ["y", "x", "_year"]).filter(F.datediff("date", "_from").between(0, F.col("duration") - 1))
    mean = lambda k: F.avg(F.when(F.col("_side") == k, F.col("value")))
    g = j.groupBy("y", "x", "year", "duration").agg(mean(0).alias("a"), mean(1).alias("b"))
    return g.select("y", "x", "year", "duration", F.round("a", 11).alias("mean_this"), F.round("b", 11).alias("mean_next"), F.round(F.col("b") - F.col("a"), 11).alias("change"))


def exceedance(series: DataFrame, keys: list[str], limit: float, n: int = 6) -> DataFrame:
    """Rows from which on the next ``n`` magnitudes are all over ``limit``."""
    w = Window.partitionBy(*keys).orderBy("date").rowsBetween(1, n)
    v = F.abs("value")
    return series.select(*keys, "date", F.min(v).over(w).alias("low"), F.count(v).over(w).alias("m")).filter((F.col("low") > limit) & (F.col("m") == n)).select(*keys, "date", "low")


def median_step(series: DataFrame, keys: list[str]) -> DataFrame:
    """Median absolute difference of successive values."""
    w = Window.partitionBy(*keys).orderBy("date")
    return series.withColumn("_d", F.abs(F.col("value") - F.lag("value").over(w))).groupBy(*keys).agg(F.round(F.median("_d"), 9).alias("median_step"))


def coverage_ranges(months: DataFrame, key: str) -> DataFrame:
    """Months (yyyymm) by key to contiguous ranges ``(key, start_ym, end_ym, n)``."""
    m = months.select(key, "ym").distinct().withColumn("_i", F.floor(F.col("ym") / 100) * 12 + F.col("ym") % 100)
    m = m.withColumn("_g", F.col("_i") - F.row_number().over(Window.partitionBy(key).orderBy("ym")))
    return m.groupBy(key, "_g").agg(F.min("ym").alias("start_ym"), F.max("ym").alias("end_ym"), F.count(F.lit(1)).alias("n")).drop("_g")


def attributes_valid_at(requests: DataFrame, ranges: DataFrame, key: str) -> DataFrame:
    """Attributes valid in a month; before the first or after the last range, those of that range."""
    j = requests.join(ranges, key)
    inside = F.col("ym").between(F.col("start_ym"), F.col("end_ym"))
    away = F.when(inside, 0).when(F.col("ym") < F.col("start_ym"), F.col("start_ym") - F.col("ym")).otherwise(F.col("ym") - F.col("end_ym"))
    return j.groupBy(key, "ym").agg(F.min_by(F.struct("start_ym", "end_ym"), F.struct(away, "start_ym")).alias("s")).select(key, "ym", "s.start_ym", "s.end_ym")


def hourly_to_daily(hourly: DataFrame, keys: list[str]) -> DataFrame:
    """Mean, max, min, total and the totals of the first and the last 12 hours of each day."""
    v, h = F.col("value"), F.hour("ts")
    return hourly.groupBy(*keys, F.to_date("ts").alias("date")).agg(
        F.round(F.avg(v), 9).alias("vmean"), F.max(v).alias("vmax"), F.min(v).alias("vmin"), F.round(F.sum(v), 4).alias("total"),
        F.round(F.sum(F.when(h < 12, v)), 4).alias("first_half"), F.round(F.sum(F.when(h >= 12, v)), 4).alias("last_half"),
    )


def spike_rule(series: DataFrame, keys: list[str]) -> DataFrame:
    """Null where a value is 0 or null and a neighbour is too."""
    w = Window.partitionBy(*keys).orderBy("date")
    bad = F.coalesce(F.col("value"), F.lit(0.0)) == 0
    t = series.withColumn("_bad", bad)
    near = F.coalesce(F.lag("_bad").over(w), F.lit(False)) | F.coalesce(F.lead("_bad").over(w), F.lit(False))
    return t.withColumn("_near", near).select(*keys, "date", F.when(~(F.col("_bad") & F.col("_near")), F.col("value")).alias("value"))
