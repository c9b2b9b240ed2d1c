"""Session settings that the jobs are written for."""
import os

from pyspark.sql import SparkSession


def build_session(name: str = "storelens", master: str | None = None, partitions: int = 2000,
                  **settings: str) -> SparkSession:
    """A session with adaptive execution, skew handling and UTC dates.

    ``master`` is left to spark-submit unless given. Every shuffle starts with ``partitions``
    partitions, which are merged at run time by size: take enough for the largest shuffle to
    have a few hundred megabytes in each, and few on a small machine.
    """
    builder = (SparkSession.builder.appName(name)
               .config("spark.sql.session.timeZone", "UTC")
               .config("spark.sql.adaptive.enabled", "true")
               .config("spark.sql.adaptive.skewJoin.enabled", "true")
               .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
               .config("spark.sql.adaptive.coalescePartitions.initialPartitionNum", str(partitions))
               .config("spark.sql.shuffle.partitions", str(partitions))
               .config("spark.driver.memory", os.environ.get("SPARK_DRIVER_MEMORY", "12g"))
               .config("spark.python.sql.dataFrameDebugging.enabled", "false")
               .config("spark.ui.enabled", "false"))
    if master:
        builder = builder.master(master)
    for key, value in settings.items():
        builder = builder.config(key.replace("__", "."), value)
    return builder.getOrCreate()
