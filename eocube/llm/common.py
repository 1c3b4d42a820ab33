"""Helpers that several operators of this subpackage share."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: ASCII blanks: what ``bytes.split()`` splits at, and what ``[^\x20\x09-\x0D]+`` leaves out.
BLANKS = " \t\n\v\f\r"


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def as_bytes(c: str) -> Column:
    """The UTF-8 bytes of a text column; null stays null."""
    return F.col(c).cast("binary")


def row_key(id_col: str = "doc_id", text_col: str = "text") -> list[Column]:
    """Identity of a row by content: rows equal in both parts get the same decision. Null-safe (no part is null)."""
    i, t = F.col(f"`{id_col}`"), F.col(f"`{text_col}`")
    return [F.coalesce(F.concat(F.lit("="), i.cast("string")), F.lit("null")).alias("_k1"), F.xxhash64(t.isNull(), t).alias("_k2")]


def whole_row(df: DataFrame) -> Column:
    """All columns as one struct ``_row``, so that helper columns clash with none of them; ``_row.*`` brings them back."""
    return F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias("_row")


def batches(rows: Iterator[pa.RecordBatch], max_bytes: int = 8 << 20, text: int = 1) -> Iterator[pa.RecordBatch]:
    """Re-cut Arrow batches so that one holds about ``max_bytes`` of column ``text`` (a longer row stands alone).

    Works on row offsets: a batch is only sliced, never copied. Small batches pass as they are.
    """
    for b in rows:
        if b.num_rows == 0:
            continue
        col = b.column(text)
        sizes = np.asarray(pc.fill_null(pc.binary_length(col), 0)).astype(np.int64)
        block = np.cumsum(sizes) // max_bytes
        cuts = [0, *(np.flatnonzero(np.diff(block)) + 1).tolist(), b.num_rows]
        for i, j in zip(cuts, cuts[1:]):
            if j > i:
                yield b.slice(i, j - i)


def bounded(n: int, most: int, what: str) -> int:
    """Guard for what goes to the driver or is broadcast: its size is checked, and another way is named beyond it."""
    if n > most:
        raise ValueError(f"{what}: {n} rows are over the bound of {most}")
    return n
