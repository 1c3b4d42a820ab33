"""Indices, masks and value decoding: narrow expressions, no shuffle."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def ratio(a: Column, b: Column) -> Column:
    """a / b, null where b is 0."""
    return a / F.nullif(b, F.lit(0.0))


#: Spectral indices by name (fixed formulas) over reflectance bands.
INDICES = {
    "NDVI": "(nir - red) / nullif(nir + red, 0D)",
    "OSAVI": "1.16D * (nir - red) / nullif(nir + red + 0.16D, 0D)",
    "AWEI": "4 * (green - swir) - (0.25D * nir + 2.75D * swir2)",
    "AWEInsh": "blue + 2.5D * green - 1.5D * (nir + swir) - 0.25D * swir2",
    "MNDWI": "(green - swir) / nullif(green + swir, 0D)",
    "EVI": "2.5D * (nir - red) / nullif(nir + 6 * red - 7.5D * blue + 1, 0D)",
    "EVI2": "2.5D * (nir - red) / nullif(nir + 2.4D * red + 1, 0D)",
    "GNDVI": "(nir - green) / nullif(nir + green, 0D)",
    "NDWI": "(green - nir) / nullif(green + nir, 0D)",
    "SVVI": "sqrt((pow(blue - (blue + green + red + nir + swir + swir2) / 6, 2) + pow(green - (blue + green + red + nir + swir + swir2) / 6, 2) + pow(red - (blue + green + red + nir + swir + swir2) / 6, 2) + pow(nir - (blue + green + red + nir + swir + swir2) / 6, 2) + pow(swir - (blue + green + red + nir + swir + swir2) / 6, 2) + pow(swir2 - (blue + green + red + nir + swir + swir2) / 6, 2)) / 6)"
    " - sqrt((pow(nir - (nir + swir + swir2) / 3, 2) + pow(swir - (nir + swir + swir2) / 3, 2) + pow(swir2 - (nir + swir + swir2) / 3, 2)) / 3)",
    "TCGREENESS": "-0.1603D * blue - 0.2819D * green - 0.4934D * red + 0.7940D * nir - 0.0002D * swir - 0.1446D * swir2",
    # With red-edge bands re1, re2, re3 and the narrow near infrared nir20.
    "NDVI_20m": "(nir20 - red) / nullif(nir20 + red, 0D)",
    "OSAVI_20m": "1.16D * (nir20 - red) / nullif(nir20 + red + 0.16D, 0D)",
    "NDVI_RE": "(re3 - re1) / nullif(re3 + re1, 0D)",
    "NDVI_RE2": "(nir - re1) / nullif(nir + re1, 0D)",
    "IEI": "1.5D * (nir - red) / nullif(nir + red + 0.5D, 0D)",
}


def spectral_indices(bands: DataFrame, names: list[str], digits: int = 6) -> DataFrame:
    """``bands`` with one column for each named index (or band of that name); zero denominators give null."""
    return bands.withColumns({n: F.round(F.expr(INDICES.get(n, n)), digits) for n in names})


_ALLOWED = re.compile(r"\s*([A-Za-z_]\w*|\d+(?:\.\d+)?|[-+*/(),])\s*")
_FUNCTIONS = {"sqrt", "abs", "exp", "ln", "greatest", "least", "nullif"}


def user_index(bands: DataFrame, definition: str) -> DataFrame:
    """``NAME = expression`` over bands. Only names of columns, numbers, arithmetic and a few functions are let through."""
    name, _, text = definition.partition("=")
    at, names = 0, []
    while at < len(text):
        if not (m := _ALLOWED.match(text, at)):
            raise ValueError(f"not allowed in an index: {text[at:]!r}")
        if m[1][0].isalpha() or m[1][0] == "_":
            names.append(m[1])
        at = m.end()
    if unknown := [n for n in names if n not in bands.columns and n not in _FUNCTIONS]:
        raise ValueError(f"unknown bands: {unknown}")
    return bands.withColumn(name.strip(), F.expr(text))


def dependent_bands(definition: str) -> list[str]:
    """The bands that a user index needs, in order of appearance."""
    return [n for n in dict.fromkeys(re.findall(r"[A-Za-z_]\w*", definition.partition("=")[2])) if n not in _FUNCTIONS]


def to_long(df: DataFrame, names: list[str]) -> DataFrame:
    """Wide index columns to ``(y, x, date, idx, value)``, without no-data rows."""
    return df.unpivot(["y", "x", "date"], names, "idx", "value").filter("value is not null")


def decode(value: Column, nodata: float, offset: float = 0.0, scaled: bool = True) -> Column:
    """Stored integer -> value: no-data to null, minus offset, by 10000 when scaled."""
    v = F.when(value == nodata, None).otherwise(value - offset)
    return v / 10000 if scaled else v


def encode(value: Column, nodata: int = -32768) -> Column:
    return F.coalesce(F.round(value * 10000).cast("int"), F.lit(nodata))


def surface_reflectance(dn: Column) -> Column:
    """Digital number to reflectance; null outside of the valid range (fixed constants of the archive)."""
    return F.when(dn.between(7273, 43636), dn * 0.0000275 - 0.2)


def surface_temperature(dn: Column) -> Column:
    return F.when(dn.between(293, 61440), dn * 0.00341802 + 149 - 273.15)


def harmonise(bands: DataFrame, coefficients: DataFrame, names: list[str]) -> DataFrame:
    """Linear correction by sensor: ``coefficients(sensor, band, slope, offset)``; sensors without a row stay as they are."""
    wide = coefficients.groupBy("sensor").agg(*[F.max(F.when(F.col("band") == n, F.col(c))).alias(f"_{n}_{c}") for n in names for c in ("slope", "offset")])
    out = bands.join(wide, "sensor", "left")  # a row for each sensor: Spark broadcasts it by its size
    out = out.withColumns({n: F.col(n) * F.coalesce(f"_{n}_slope", F.lit(1.0)) + F.coalesce(f"_{n}_offset", F.lit(0.0)) for n in names})
    return out.drop(*[f"_{n}_{c}" for n in names for c in ("slope", "offset")])


#: Band number by name for two sensor families (fixed values).
BAND_NUMBERS = {
    "older": {"blue": 1, "green": 2, "red": 3, "nir": 4, "swir": 5, "swir2": 7},
    "newer": {"blue": 2, "green": 3, "red": 4, "nir": 5, "swir": 6, "swir2": 7},
}


def band_number(family: Column, band: Column) -> Column:
    pairs = [F.lit(x) for f, m in BAND_NUMBERS.items() for b, n in m.items() for x in (f"{f}/{b}", n)]
    return F.try_element_at(F.create_map(*pairs), F.concat_ws("/", family, band))


def clear_by_qa(qa: Column, cutoff: int = 22000) -> Column:
    """Clear pixels: high byte under the cutoff and the low seven bits one of the clear or water codes (fixed values)."""
    return (qa < cutoff) & (qa % 128).isin(0, 2, 64, 66)


#: By sensor family, fixed values: highest high byte of a usable quality word, and the clear words that count as cloud near clouds.
QUALITY_LIMITS = {"LC09": (86, (22080, 22208)), "LC08": (86, (22080, 22208)), "LE07": (21, (5696, 5760)), "LT05": (21, (5696, 5760)), "LT04": (21, (5696, 5760))}


def quality_mask(scenes: DataFrame, keys: list[str], half: int = 3, most: int = 3) -> DataFrame:
    """``scenes(keys.., sensor, y, x, qa)`` with ``clear``, by the limits of the sensor's family.

    A word over the limit is cloud. Doubtful words (see ``QUALITY_LIMITS``) are cloud too where more than ``most`` of the
    cells around them, up to ``half`` away, are. Of the rest, words with one of four low-seven-bit codes are clear (fixed
    values). Fill (1) counts as cloud, a cell without a row doesn't. Sensors without limits have no clear words.
    """
    from .grid import window_count

    family = lambda f: F.coalesce(*[F.when(F.col("sensor") == name, f(v)) for name, v in QUALITY_LIMITS.items()], F.lit(False))
    cloud = (F.col("qa") == 1) | ~family(lambda v: F.floor(F.col("qa") / 256) <= v[0])
    s = window_count(scenes.withColumn("_cloud", cloud), keys, "_cloud", half, "_near")
    doubt = family(lambda v: F.col("qa").isin(*v[1])) & (F.col("_near") > most)
    return s.withColumn("clear", ~F.col("_cloud") & ~doubt & (F.col("qa") % 128).isin(0, 2, 64, 66)).drop("_cloud", "_near")


def water_by_qa(qa: Column) -> Column:
    """Bit 7 of the quality word."""
    return F.floor(qa % 256 / 128) == 1


def mask_scene_classes(value: Column, scl: Column) -> Column:
    """Value where the scene class is usable (fixed list of classes that are not)."""
    return F.when(~scl.isin(0, 1, 2, 3, 8, 9, 10, 11, 255), value)


_OPS = {"gte": ">=", "lte": "<=", "gt": ">", "lt": "<", "neq": "<>", "eq": "="}


def threshold(column: str, text: str) -> Column:
    """``gte0.1`` and the like as a predicate; raises on anything else."""
    m = re.fullmatch(r"\s*(gte|lte|gt|lt|neq|eq)\s*(-?\d+(?:\.\d+)?)\s*", text)
    if not m:
        raise ValueError(f"not a threshold: {text!r}")
    return F.expr(f"`{column}` {_OPS[m[1]]} {m[2]}D")


def within_roi(df: DataFrame, roi: DataFrame) -> DataFrame:
    return df.join(roi.select("y", "x"), ["y", "x"], "left_semi")


def cube_slice(df: DataFrame, y=None, x=None, date=None) -> DataFrame:
    """Rows inside of the given (low, high) ranges; None takes all."""
    for c, r in (("y", y), ("x", x), ("date", date)):
        if r is not None:
            df = df.filter(F.col(c).between(*[F.lit(v) for v in r]))
    return df


def drop_empty_layers(df: DataFrame, value: str = "value") -> DataFrame:
    """Dates that have no value at all go."""
    return df.join(df.groupBy("date").agg(F.count(value).alias("_n")).filter("_n > 0").select("date"), "date", "left_semi")


def cell_of(px: Column, py: Column, x0=0.0, y0=0.0, dx=1.0, dy=1.0) -> tuple[Column, Column]:
    """(y, x) of map coordinates under a geotransform."""
    return F.floor((py - y0) / dy).cast("int"), F.floor((px - x0) / dx).cast("int")


def centre_of(y: Column, x: Column, x0=0.0, y0=0.0, dx=1.0, dy=1.0) -> tuple[Column, Column]:
    """(px, py) of a cell's centre."""
    return x0 + (x + 0.5) * dx, y0 + (y + 0.5) * dy


def inside_ring(px: Column, py: Column, ring: list[tuple[float, float]]) -> Column:
    """Ray casting: an odd number of edges is crossed. A ring of fixed size becomes one expression."""
    crossed = F.lit(0)
    for (ax, ay), (bx, by) in zip(ring, ring[1:] + ring[:1]):
        if ay != by:
            cuts = ((F.lit(ay) > py) != (F.lit(by) > py)) & (px < (bx - ax) * (py - ay) / (by - ay) + ax)
            crossed = crossed + cuts.cast("int")
    return crossed % 2 == 1


def biomass(temperature: Column, par: Column, static: float = 15.0) -> Column:
    """Light-use biomass; null where it is colder than the static temperature."""
    return F.when(temperature >= static, 0.33 * 0.65 * par * F.pow(F.lit(1.09), temperature - static))


def water_quality(bands: DataFrame) -> DataFrame:
    """Band ratios for chlorophyll: D05 (over red-edge bands re1, re2), NIR/RED, BLUE/GREEN, NDCI and fluorescence line height over red, nir and swir."""
    return bands.withColumns({
        "d05": F.col("re2") * (ratio(F.lit(1.0), F.col("red")) - ratio(F.lit(1.0), F.col("re1"))),
        "nir_red": ratio(F.col("nir"), F.col("red")), "blue_green": ratio(F.col("blue"), F.col("green")), "ndci": ratio(F.col("nir") - F.col("red"), F.col("nir") + F.col("red")),
        "flh": F.col("nir") - (F.col("red") + F.col("swir")) / 2,
    })


def threshold_sweep(df: DataFrame, column: str, low: float, step: float, n: int) -> DataFrame:
    """Counts over each of ``n`` thresholds, in one pass: values are binned first, then the bins are compared."""
    bins = df.filter(F.col(column).isNotNull()).groupBy(F.floor(F.round((F.col(column) - low) / step, 9)).cast("int").alias("b")).agg(F.count(F.lit(1)).alias("n"))
    cuts = df.sparkSession.range(n).select(F.col("id").cast("int").alias("k"))
    # Bins are as many as values / step; they meet a fixed number of thresholds.
    got = bins.crossJoin(F.broadcast(cuts)).groupBy("k").agg(F.sum(F.when(F.col("b") >= F.col("k"), F.col("n")).otherwise(0)).alias("n_over"))
    return got.select(F.round(low + F.col("k") * step, 6).alias("threshold"), "n_over")


def normalise_features(df: DataFrame, logs: list[str], maxima: list[str]) -> DataFrame:
    """log1p of ``logs`` with zeros as null; ``maxima`` divided by their largest absolute value."""
    top = df.agg(*[F.max(F.abs(c)).alias(f"_{c}") for c in maxima]) if maxima else None
    out = df.withColumns({c: F.log1p(F.nullif(F.col(c), F.lit(0.0))) for c in logs})
    if top is None:
        return out
    out = out.crossJoin(F.broadcast(top))  # one row
    return out.withColumns({c: ratio(F.col(c), F.col(f"_{c}")) for c in maxima}).drop(*[f"_{c}" for c in maxima])


def band_simulation(spectra: DataFrame, response: DataFrame) -> DataFrame:
    """Response-weighted mean of ``spectra(sample, wavelength, value)`` by ``response(band, wavelength, weight)``.

    The response is the table of an instrument: a row for each band and wavelength, sent to all tasks. Joined by shuffle,
    a wavelength, of which there are few, would be one task.
    """
    j = spectra.join(F.broadcast(response), "wavelength")
    return j.groupBy("sample", "band").agg((F.sum(F.col("value") * F.col("weight")) / F.nullif(F.sum("weight"), F.lit(0.0))).alias("value"))


def utm(lon: Column, lat: Column, zone: int) -> tuple[Column, Column]:
    """Easting and northing (WGS84, northern hemisphere) by the sixth-order series."""
    k0, a, e2 = 0.9996, 6378137.0, 0.00669437999014
    p, lam = F.radians(lat), F.radians(lon - (zone * 6 - 183))
    ep2 = e2 / (1 - e2)
    nu = a / F.sqrt(1 - e2 * F.pow(F.sin(p), 2))
    t, c, b = F.pow(F.tan(p), 2), ep2 * F.pow(F.cos(p), 2), F.cos(p) * lam
    m = a * (
        (1 - e2 / 4 - 3 * e2**2 / 64 - 5 * e2**3 / 256) * p
        - (3 * e2 / 8 + 3 * e2**2 / 32 + 45 * e2**3 / 1024) * F.sin(2 * p)
        + (15 * e2**2 / 256 + 45 * e2**3 / 1024) * F.sin(4 * p)
        - (35 * e2**3 / 3072) * F.sin(6 * p)
    )
    east = 500000 + k0 * nu * (b + (1 - t + c) * F.pow(b, 3) / 6 + (5 - 18 * t + t * t + 72 * c - 58 * ep2) * F.pow(b, 5) / 120)
    north = k0 * (m + nu * F.tan(p) * (b * b / 2 + (5 - t + 9 * c + 4 * c * c) * F.pow(b, 4) / 24 + (61 - 58 * t + t * t + 600 * c - 330 * ep2) * F.pow(b, 6) / 720))
    return east, north
