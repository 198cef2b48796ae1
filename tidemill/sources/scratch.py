"""Tables that a query writes for itself: in the shared folder that the cluster names, gone when the Python process ends."""

from __future__ import annotations

import atexit
import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_WRITTEN: dict[str, SparkSession] = {}
#: Spark deletes the shuffle files of a query as soon as it has ended.
_CLEAN = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def path(spark: SparkSession, name: str) -> str:
    """A new folder in spark.checkpoint.dir; in a local folder only where that is unset."""
    named = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    base = named.rstrip("/") if named else "file://" + os.path.join(tempfile.gettempdir(), "checkpoints", spark.sparkContext.applicationId)
    out = f"{base}/tidemill/{name}-{uuid.uuid4().hex}"
    _WRITTEN[out] = spark
    return out


def materialised(df: DataFrame, name: str, partition_by: list[str] | None = None) -> DataFrame:
    """df, evaluated once: written as Parquet and read back. Lost executors repeat nothing of what went before."""
    spark = df.sparkSession
    where = path(spark, name)
    was = spark.conf.get(_CLEAN)
    spark.conf.set(_CLEAN, "true")
    try:
        df.write.partitionBy(*partition_by or ()).parquet(where)
    finally:
        spark.conf.set(_CLEAN, was)
    return spark.read.schema(df.schema).parquet(where)


@atexit.register
def _delete_all() -> None:
    for where, spark in list(_WRITTEN.items()):
        try:
            at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(where)
            at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)
        except Exception:  # the session has ended already
            return
