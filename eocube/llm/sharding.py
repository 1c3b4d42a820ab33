"""Sharding by a two-pass external shuffle.

Pass 1 scatters the records uniformly into buckets that fit a task's memory, by a seeded hash of their content. Pass 2
shuffles each bucket with Fisher-Yates (seeded by bucket) and writes it. The buckets in order, each in its shuffled
order, make one random order of all records; cut into equal stretches it gives the shards. So the ``rows`` law holds:
counts differ by one at most. Records of one bucket mostly go to one shard, so there are few files.

A bucket's first place travels to it as a row of its own, so nothing is joined or broadcast, and a task takes one bucket
(beyond ``MOST_TASKS`` buckets, one after the other). Sizes are those of whole rows. The order depends on seed, records
and number of buckets only, not on partitions or retries. The one exception are rows that are equal in every column and
so many that they would fill a good part of a bucket: they are dealt on by their place in the input partition (so the
input should be a stored table); being equal, they are interchangeable.

Edge cases: a null text has 0 bytes (and size 1, CRC 0) and stays null in the files; null ids are hashed as such; an
empty table gives no rows; other columns are kept in the files, those that clash with ``shard`` or ``slot`` under their
name with ``_`` appended.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import new_path, stage
from .common import read, whole_row

MOST_TASKS = 100_000
#: So many contents that repeat often are sent to all tasks; more are joined.
MOST_REPEATED = 100_000


def _size(f: T.StructField) -> Column:
    """Bytes of a column, near enough for dealing."""
    c = F.col(f"`{f.name}`")
    if isinstance(f.dataType, (T.StringType, T.BinaryType)):
        return F.coalesce(F.octet_length(c), F.lit(0)) + 16
    if isinstance(f.dataType, (T.ArrayType, T.MapType, T.StructType)):
        return F.coalesce(F.octet_length(F.to_json(F.struct(c))), F.lit(0)) + 16
    return F.lit(8)


def _content(f: T.StructField) -> list[Column]:
    c = F.col(f"`{f.name}`")
    nested = isinstance(f.dataType, (T.ArrayType, T.MapType, T.StructType))
    return [c.isNull(), F.to_json(F.struct(c)) if nested else c]


def shuffle(docs: DataFrame, seed: int = 11, bucket_bytes: int = 32 << 20) -> tuple[DataFrame, int]:
    """``_row`` (all columns of ``docs``) and ``_place``, the record's place in one random order from 0 on; and the number of records."""
    size = sum((_size(f) for f in docs.schema), F.lit(16))
    hashed = docs.select(whole_row(docs), F.xxhash64(F.lit(seed), *[c for f in docs.schema for c in _content(f)]).alias("_order"), size.cast("long").alias("_bytes"))
    same = hashed.groupBy("_order").agg(F.count(F.lit(1)).alias("n"), F.sum("_bytes").alias("b"))
    same = stage(same, "contents")
    r = same.agg(F.sum("n"), F.sum("b")).first()
    rows, n = r[0] or 0, 1 + (r[1] or 0) // bucket_bytes
    part = max(1, bucket_bytes // 4)
    often = same.filter((F.col("n") > 1) & (F.col("b") > part)).select("_order", (F.col("b") / part).cast("long").alias("_k"))
    many = often.limit(MOST_REPEATED + 1).count()
    salt = F.lit(0).cast("long")
    if many:
        hashed = hashed.join(F.broadcast(often) if many <= MOST_REPEATED else often, "_order", "left")
        salt = F.coalesce(F.pmod(F.monotonically_increasing_id(), "_k"), F.lit(0))
    keyed = hashed.select("_row", "_order", F.pmod(F.xxhash64(F.lit(seed + 1), "_order", salt), F.lit(n)).alias("_bucket"))
    # A row for each bucket of bucket_bytes.
    before = Window.orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    firsts = keyed.groupBy("_bucket").agg(F.count(F.lit(1)).alias("n")).select("_bucket", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("_first"))
    nothing = F.lit(None).cast(keyed.schema["_row"].dataType)
    both = keyed.withColumn("_first", F.lit(None).cast("long")).unionByName(firsts.select(nothing.alias("_row"), F.lit(0).cast("long").alias("_order"), "_bucket", "_first"))

    def fisher_yates(t: pa.Table) -> pa.RecordBatch:
        bucket, first = t.column("_bucket")[0].as_py(), t.column("_first").drop_null()[0].as_py()
        t = t.filter(t.column("_first").is_null()).select(["_row", "_order"])
        order = np.argsort(t.column("_order").to_numpy(), kind="stable")  # rows come in any order
        rng = np.random.default_rng([seed, bucket])
        draw = (rng.random(len(order)) * np.arange(1, len(order) + 1)).astype(np.int64)
        for i in range(len(order) - 1, 0, -1):
            j = draw[i]
            order[i], order[j] = order[j], order[i]
        mixed = t.select(["_row"]).take(pa.array(order))
        yield from mixed.append_column("_place", pa.array(first + np.arange(len(order)))).to_batches(10_000)

    def run(batches):
        """Rows come sorted by bucket; one bucket is held at a time."""
        bucket, held = None, []
        for b in batches:
            number = b.column(2).to_numpy()
            cuts = [0, *(np.flatnonzero(np.diff(number)) + 1).tolist(), len(number)]
            for i, j in zip(cuts, cuts[1:]):
                if i < j:
                    if held and number[i] != bucket:
                        yield from fisher_yates(pa.Table.from_batches(held))
                        held = []
                    bucket = number[i]
                    held.append(b.slice(i, j - i))
        if held:
            yield from fisher_yates(pa.Table.from_batches(held))

    tasks = min(n, MOST_TASKS)
    dealt = both.repartitionById(tasks, F.pmod("_bucket", F.lit(tasks)).cast("int")).sortWithinPartitions("_bucket")
    schema = T.StructType([keyed.schema["_row"], T.StructField("_place", T.LongType())])
    return dealt.select("_row", "_order", "_bucket", "_first").mapInArrow(run, schema), rows


def write_shards(docs: DataFrame, path: str, shards: int = 8, seed: int = 11, bucket_bytes: int = 32 << 20) -> T.StructType:
    """Write ``docs`` to ``path`` (Parquet, a folder for each shard), with ``slot``, the place in the shard from 0 on.

    The result is the schema to read the files with (see ``read_shards``), which an empty table doesn't leave there.
    """
    names, taken = [], {"shard", "slot"} | {c.lower() for c in docs.columns}
    for c in docs.columns:
        new = c
        if c.lower() in ("shard", "slot"):
            while new.lower() in taken:
                new += "_"
            taken.add(new.lower())
        names.append(F.col(f"`{c}`").alias(new))
    placed, rows = shuffle(docs.select(*names), seed, bucket_bytes)
    # Shard s has the places from ceil(rows * s / shards) on.
    shard = F.expr(f"cast((_place * {shards}) div {max(rows, 1)} as int)")
    first = F.expr(f"({rows} * cast(shard as long) + {shards - 1}) div {shards}")
    out = placed.withColumn("shard", shard).withColumn("slot", F.col("_place") - first).drop("_place").select("_row.*", "slot", "shard")
    out.write.partitionBy("shard").parquet(path)
    return out.schema


def read_shards(spark, path: str, schema: T.StructType) -> DataFrame:
    return spark.read.schema(schema).parquet(path)


def digest(shards: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(doc_id, size, text_crc32, law, shard, slot, grown_shard)``."""
    return shards.select(
        F.col(id_col).alias("doc_id"),
        (F.coalesce(F.octet_length(text_col), F.lit(0)) + 1).cast("long").alias("size"),
        F.coalesce(F.crc32(F.col(text_col).cast("binary")), F.lit(0).cast("long")).alias("text_crc32"),
        F.lit("rows").alias("law"),
        F.col("shard").cast("int").alias("shard"),
        "slot",
        F.lit(None).cast("int").alias("grown_shard"),
    )


def op10_sharding(spark, sf_dir: str) -> DataFrame:
    path = new_path(spark, "shards")
    schema = write_shards(read(spark, sf_dir, "documents"), path)
    return digest(read_shards(spark, path, schema))
