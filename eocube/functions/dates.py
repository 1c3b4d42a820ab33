"""Date functions over columns."""

from pyspark.sql import Column
from pyspark.sql import functions as F


def doy_code(d: Column) -> Column:
    """yyyyddd of a date."""
    return F.year(d) * 1000 + F.dayofyear(d)


def day_code(d: Column) -> Column:
    """yyyymmdd of a date."""
    return F.year(d) * 10000 + F.month(d) * 100 + F.dayofmonth(d)


def from_doy_code(c: Column) -> Column:
    """Date of yyyyddd; null unless it has seven digits and the year has that day."""
    n = c.cast("long")
    d = F.date_add(F.make_date(F.floor(n / 1000).cast("int"), F.lit(1), F.lit(1)), (n % 1000 - 1).cast("int"))
    return F.when((F.length(n.cast("string")) == 7) & (n % 1000).between(1, 366) & (F.year(d) == F.floor(n / 1000)), d)


def from_day_code(c: Column) -> Column:
    """Date of yyyymmdd; null unless it is one."""
    s = c.cast("long").cast("string")
    return F.when(F.length(s) == 8, F.try_to_date(s, "yyyyMMdd"))


def is_wet_season(d: Column) -> Column:
    return F.month(d).between(5, 10)


def years_since(d: Column, origin: str) -> Column:
    """Years of 365.25 days since a date."""
    return F.datediff(d, F.lit(origin).cast("date")) / 365.25


def local_text(ms: Column, zone: str) -> Column:
    """Milliseconds since 1970 (UTC) as local time text."""
    return F.date_format(F.from_utc_timestamp(F.timestamp_millis(ms), zone), "yyyy-MM-dd HH:mm:ss")
