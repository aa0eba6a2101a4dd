"""Cutting lineage through the shared folder of the cluster."""

from __future__ import annotations

import functools
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

#: With it Spark deletes the shuffle files of a query when the query ends.
CLEAN = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@functools.lru_cache(1)
def _own() -> str:
    return "file://" + tempfile.mkdtemp(prefix="packetlake-")


def folder(spark: SparkSession) -> str:
    """spark.checkpoint.dir of the session. A folder of our own only where that is unset and everything runs in one process (tests)."""
    if at := spark.conf.get("spark.checkpoint.dir", None):
        return at.rstrip("/")
    if not spark.sparkContext.master.split("[")[0] == "local":
        raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    return _own()


def saved(df: DataFrame) -> DataFrame:
    """``df`` written as Parquet in the shared folder and read back, so later jobs don't depend on executors that made it.

    The table is deleted when the driver's process ends, or by ``drop``.
    """
    spark = df.sparkSession
    path = f"{folder(spark)}/packetlake-{uuid.uuid4().hex}"
    before = spark.conf.get(CLEAN, None)
    spark.conf.set(CLEAN, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.unset(CLEAN) if before is None else spark.conf.set(CLEAN, before)
    _files(spark, path, "deleteOnExit")
    return spark.read.schema(df.schema).parquet(path)


def drop(*tables: DataFrame) -> None:
    """Deletes tables of ``saved`` that nothing reads any more."""
    for df in tables:
        for path in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
            if "/packetlake-" in path:
                _files(df.sparkSession, path, "delete", True)


def _files(spark: SparkSession, path: str, call: str, *args) -> None:
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    getattr(at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), call)(at, *args)
