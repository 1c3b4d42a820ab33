"""Text, array and small geometry functions over columns."""

from pyspark.sql import Column
from pyspark.sql import functions as F


def is_number(s: Column) -> Column:
    return s.try_cast("double").isNotNull()


def base_name(name: Column) -> Column:
    """A file name without the copy suffix "(1)" before its extension."""
    return F.regexp_replace(name, r"\(\d+\)(?=\.|$)", "")


def date_in_name(name: Column) -> Column:
    """The first 8-digit run (yyyymmdd), else the first 7-digit run (yyyyddd), as a date."""
    from .dates import from_day_code, from_doy_code

    eight, seven = F.regexp_extract(name, r"(?:^|\D)(\d{8})(?:\D|$)", 1), F.regexp_extract(name, r"(?:^|\D)(\d{7})(?:\D|$)", 1)
    return F.when(eight != "", from_day_code(eight.try_cast("long"))).when(seven != "", from_doy_code(seven.try_cast("long")))


def has_words(name: Column, any_of=(), all_of=(), none_of=()) -> Column:
    """File filter: some of, all of, none of the words."""
    out = F.lit(True)
    if any_of:
        out = out & F.exists(F.array(*map(F.lit, any_of)), lambda w: F.contains(name, w))
    for w in all_of:
        out = out & F.contains(name, F.lit(w))
    for w in none_of:
        out = out & ~F.contains(name, F.lit(w))
    return out


def ddmm_to_degrees(c: Column) -> Column:
    return F.signum(c) * (F.floor(F.abs(c) / 100) + F.abs(c) % 100 / 60)


def dms_to_degrees(text: Column) -> Column:
    """``D-M-S`` to degrees; null if it isn't of that form."""
    p = F.split(text, "-")
    part = lambda i: F.get(p, F.lit(i)).try_cast("double")
    return F.when(F.size(p) == 3, part(0) + part(1) / 60 + part(2) / 3600)


def parse_levels(text: Column) -> Column:
    """``[[year, a, b], ..]`` as an array of structs."""
    return F.transform(F.from_json(text, "array<array<double>>"), lambda e: F.struct(F.get(e, F.lit(0)).cast("int").alias("year"), F.get(e, F.lit(1)).alias("a"), F.get(e, F.lit(2)).alias("b")))


def argmax(a: Column) -> Column:
    """Index (from 0) of the first largest element; null for an empty array."""
    return F.when(F.size(a) > 0, F.array_position(a, F.array_max(a)) - 1)


def linspace(low: float, high: float, n: int) -> Column:
    return F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda i: F.lit(low) + (high - low) * i / (n - 1))


def smooth_line(points: Column, rounds: int = 1) -> Column:
    """Corner cutting: each segment gives its points at 1/4 and 3/4; the ends stay. ``points`` are structs (x, y)."""
    for _ in range(rounds):
        p, q = F.slice(points, 1, F.size(points) - 1), F.slice(points, 2, F.size(points) - 1)

        def cut(a, b):
            at = lambda w: F.struct((a["x"] + (b["x"] - a["x"]) * w).alias("x"), (a["y"] + (b["y"] - a["y"]) * w).alias("y"))
            return F.array(at(0.25), at(0.75))

        inner = F.flatten(F.zip_with(p, q, cut))
        points = F.concat(F.slice(points, 1, 1), inner, F.slice(points, F.size(points), 1))
    return points
