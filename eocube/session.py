"""Session and shared-folder helpers used by the whole library."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def get_session(app: str = "eocube", master: str | None = None, **conf: str) -> SparkSession:
    """A session with the settings the library relies on (UTC, AQE); everything else is left to the cluster."""
    b = SparkSession.builder.appName(app).config("spark.sql.session.timeZone", "UTC").config("spark.sql.adaptive.enabled", "true")
    if master:
        b = b.master(master)
    for k, v in conf.items():
        b = b.config(k, v)
    return b.getOrCreate()


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir`` of the session.

    Where the setting is missing (tests, one machine) a folder of this machine is made once and kept in the session.
    """
    for key in ("spark.checkpoint.dir", "spark.eocube.shared.dir"):
        if base := spark.conf.get(key, None):
            return base.rstrip("/")
    master = spark.sparkContext.master
    if master != "local" and not master.startswith("local["):  # local-cluster has executors of its own
        raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    base = "file://" + tempfile.mkdtemp(prefix="eocube-", dir=os.environ.get("TMPDIR"))
    spark.conf.set("spark.eocube.shared.dir", base)
    return base


def new_path(spark: SparkSession, name: str) -> str:
    """A path in the shared folder that nothing else uses. What is written there goes when the application ends."""
    base = f"{shared_dir(spark)}/eocube-{name}-{uuid.uuid4().hex}"
    folder = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(base)
    fs = folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    fs.mkdirs(folder)
    fs.deleteOnExit(folder)
    return f"{base}/t"


def stage(df: DataFrame, name: str, partition_by: list[str] | None = None, codec: str = "zstd") -> DataFrame:
    """Write ``df`` to the shared folder and read it back: cuts lineage, computes once, survives lost executors."""
    spark = df.sparkSession
    path = new_path(spark, name)
    w = df.write.option("compression", codec)
    if partition_by:
        w = w.partitionBy(*partition_by)
    w.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


_SHIPPED: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Send this package to the executors of the application, once (``addPyFile``)."""
    import shutil

    sc = spark.sparkContext
    if sc.applicationId not in _SHIPPED:
        here = os.path.dirname(os.path.abspath(__file__))
        target = os.path.join(tempfile.mkdtemp(prefix="eocube-ship-"), "eocube")
        sc.addPyFile(shutil.make_archive(target, "zip", os.path.dirname(here), os.path.basename(here)))
        _SHIPPED.add(sc.applicationId)
