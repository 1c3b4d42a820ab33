"""Streaming ingestion of gauge readings and streaming forms of the daily aggregate.

The watermark is two days: later rows are dropped by Spark and counted in the query's progress.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import stage

WATERMARK = "2 days"


def readings(spark: SparkSession, path: str, schema: str = "station string, ts timestamp, level double, flow double", fmt: str = "json") -> DataFrame:
    """Gauge readings as they land in a folder; -9999 stands for missing."""
    s = spark.readStream.schema(schema).format(fmt).load(path)
    return s.withColumns({c: F.when(F.col(c) != -9999, F.col(c)) for c in ("level", "flow")})


def unseen(stream: DataFrame) -> DataFrame:
    """Readings whose (station, ts) has not come before within the watermark."""
    return stream.withWatermark("ts", WATERMARK).dropDuplicatesWithinWatermark(["station", "ts"])


def append_unseen(stream: DataFrame, path: str, checkpoint: str):
    """Write unseen readings by station; a batch that is run again replaces nothing, as Spark's sink keeps its log."""
    return unseen(stream).writeStream.format("parquet").partitionBy("station").option("path", path).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()


def by_file(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Parquet files as a stream of one file a batch, oldest first."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).option("latestFirst", "false").parquet(path)


class State(NamedTuple):
    readings: DataFrame  # each (station, ts) once: the first that came
    late: DataFrame  # (station, n, batch): rows that came too late, by batch


def upserts(stream: DataFrame, path: str, checkpoint: str, delay_days: int = 5) -> State:
    """Run ``stream(station, ts, value)`` through a keyed upsert, and give the state in ``path``.

    A reading is new if its (station, ts) isn't there yet. The state is dealt by day, so a batch reads and writes only
    the days that it touches. Rows of days more than ``delay_days`` before the latest day of all earlier batches are
    late: they are counted by station and not taken, so older days never change again.

    A batch that is run again changes nothing: its watermark comes from earlier batches only, a day's rows are a union by
    key, and its counts replace those of its own number.
    """
    spark = stream.sparkSession
    kept = "station bigint, ts timestamp, value double, day date"
    counted, marked = "station bigint, n bigint, batch bigint", "latest date, batch bigint"

    def table(name: str, schema: str) -> DataFrame:
        spark_path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{path}/{name}")
        there = spark_path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(spark_path)
        return spark.read.schema(schema).parquet(f"{path}/{name}") if there else spark.createDataFrame([], schema)

    def write(df: DataFrame, name: str, by: str) -> None:
        df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(by).parquet(f"{path}/{name}")

    def take(batch: DataFrame, number: int) -> None:
        rows = stage(batch.select("station", "ts", "value").withColumn("day", F.to_date("ts")), "batch")
        before = table("marks", marked).filter(F.col("batch") < number).agg(F.max("latest")).first()[0]
        late = F.lit(False) if before is None else F.col("day") < F.date_sub(F.lit(before), delay_days)
        write(rows.filter(late).groupBy("station").agg(F.count(F.lit(1)).alias("n")).withColumn("batch", F.lit(number)), "late", "batch")
        new = rows.filter(~late)
        old = table("readings", kept).join(F.broadcast(new.select("day").distinct()), "day", "left_semi")  # the batch's days
        first = F.min_by("value", F.struct("_new", "value")).alias("value")
        both = old.withColumn("_new", F.lit(0)).unionByName(new.withColumn("_new", F.lit(1)))
        write(stage(both.groupBy("station", "ts", "day").agg(first), "days"), "readings", "day")
        write(rows.agg(F.max("day").alias("latest")).withColumn("batch", F.lit(number)), "marks", "batch")

    q = stream.writeStream.foreachBatch(take).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    q.awaitTermination()
    return State(table("readings", kept).drop("day"), table("late", counted))


def next_wait(wait: float, rows: int, shortest: float, longest: float) -> float:
    """Seconds until the next poll: half as long after a poll that brought rows, twice as long after an empty one, within bounds."""
    return min(longest, max(shortest, wait / 2 if rows else wait * 2))


def daily(stream: DataFrame) -> DataFrame:
    """Hourly readings to daily mean, max, min, total and half-day totals, once a day is past the watermark."""
    v, h = F.col("value"), F.hour("ts")
    g = stream.withWatermark("ts", WATERMARK).groupBy("station", F.window("ts", "1 day").alias("w"))
    return g.agg(F.avg(v).alias("vmean"), F.max(v).alias("vmax"), F.min(v).alias("vmin"), F.sum(v).alias("total"), F.sum(F.when(h < 12, v)).alias("first_half"), F.sum(F.when(h >= 12, v)).alias("last_half")).select("station", F.to_date("w.start").alias("date"), "vmean", "vmax", "vmin", "total", "first_half", "last_half")


def pending(log: DataFrame, items: DataFrame) -> DataFrame:
    """Items without a final state in the log ``(item, state, ts)``: the latest state counts."""
    last = log.groupBy("item").agg(F.max_by("state", F.struct("ts", "state")).alias("state"))
    return items.join(last.filter(F.col("state").isin("Downloaded", "NoData")), "item", "left_anti").join(last, "item", "left").select("item", F.coalesce("state", F.lit("Unknown")).alias("state"))
