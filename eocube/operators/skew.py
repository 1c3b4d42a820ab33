"""Joins whose key may be very frequent."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MOST, LEAST = 10_000, 256


def join_counted(left: DataFrame, right: DataFrame, key: str, total: int, count: str = "d") -> DataFrame:
    """Inner join of ``left`` with ``right``, which has each ``key`` once, and in ``count`` how many of the ``total`` rows of ``left`` have it.

    Keys of over ``T`` rows are joined by broadcast, so no task gets all rows of one; the others by shuffle. ``T`` is
    at least two in ``MOST`` of all rows, so at most ``MOST`` / 2 keys are sent to all tasks at any size.
    """
    most = max(LEAST, 2 * total // MOST)
    rest = [c for c in right.columns if c not in (key, count)]
    often = right.filter(F.col(count) > most).select(key, F.struct(*rest).alias("_often"))
    near = left.join(F.broadcast(often), key, "left")
    far = near.filter("_often is null").drop("_often").join(right.filter(F.col(count) <= most).drop(count), key)
    return far.unionByName(near.filter("_often is not null").select(*left.columns, "_often.*"))
