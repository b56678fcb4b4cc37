"""Small helpers every query shares: reading tables, shared storage, shipping the package."""

from __future__ import annotations

import os
import tempfile
import uuid
import zipfile

from pyspark.sql import DataFrame, SparkSession

_shipped: set[str] = set()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The table `name` of a data directory; any path that Spark can read will do."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ship_package(spark: SparkSession) -> None:
    """Send this package to the executors once per application, so that Python tasks can import it."""
    sc = spark.sparkContext
    if sc.applicationId in _shipped:
        return
    top = os.path.dirname(os.path.abspath(__file__))
    target = os.path.join(tempfile.mkdtemp(prefix="conegrid-"), "conegrid-package.zip")
    with zipfile.ZipFile(target, "w") as z:
        for folder, _, files in os.walk(top):
            for f in sorted(files):
                if f.endswith(".py"):
                    full = os.path.join(folder, f)
                    z.write(full, os.path.join("conegrid", os.path.relpath(full, top)))
    sc.addPyFile(target)
    _shipped.add(sc.applicationId)


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: spark.checkpoint.dir; where it is unset (tests), one of our own."""
    known = spark.conf.get("spark.checkpoint.dir", None)
    if not known:
        jvm = spark.sparkContext._jsc.sc().getCheckpointDir()
        known = jvm.get() if jvm.isDefined() else None
    if not known:
        known = tempfile.mkdtemp(prefix="spark-shared-", dir="/tmp")
        spark.sparkContext.setCheckpointDir(known)
    return known


def materialize(df: DataFrame, *partition_by: str) -> DataFrame:
    """Write `df` to a table in the shared folder and read it back: lineage ends there, and a lost
    executor costs a reread, not a recomputation."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/conegrid-{uuid.uuid4().hex}"
    writer = df.write.mode("error")
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def discard(df: DataFrame) -> None:
    """Delete a table that `materialize` wrote, when nothing reads it any more."""
    spark, files = df.sparkSession, df.inputFiles()
    if not files or "/conegrid-" not in files[0]:
        return
    head, _, rest = files[0].partition("/conegrid-")
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{head}/conegrid-{rest.partition('/')[0]}")
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
