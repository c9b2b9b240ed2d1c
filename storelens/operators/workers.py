"""Python workers and this package."""
import os

from pyspark.sql import SparkSession


def find_package(spark: SparkSession) -> None:
    """Workers that share the driver's files find this package where the driver did.

    On a cluster the package is shipped with the job and this path is simply not there.
    """
    root = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    spark.sparkContext.environment.setdefault("PYTHONPATH", root)
