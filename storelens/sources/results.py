"""Kept results of parameterised queries.

A result is kept by its query, its parameters and a fingerprint of the files it was computed from: names, lengths and
times of change. Asked again, it is read; once a file has changed, it is computed anew.
"""
import json
from hashlib import sha256

from pyspark.sql import DataFrame, SparkSession

from storelens.sources import folders
from storelens.sources.store import run_sql


def _leaves(df: DataFrame) -> list[str]:
    found = df._jdf.queryExecution().optimizedPlan().collectLeaves()
    return [found.apply(i).nodeName() for i in range(found.size())]


def only_files(df: DataFrame) -> bool:
    """Whether all that a result is computed from are files (or numbers of a range)."""
    return all(name.startswith(("LogicalRelation", "Relation", "OneRowRelation", "Range")) for name in _leaves(df)) \
        and bool(df.inputFiles())


def fingerprint(df: DataFrame) -> str:
    """Digest of name, length and time of change of every file that ``df`` reads. Folders are listed once each."""
    spark, names = df.sparkSession, sorted(set(df.inputFiles()))
    digest, listed = sha256(), {}
    for name in names:
        path = spark._jvm.org.apache.hadoop.fs.Path(spark._jvm.java.net.URI(name))
        files = path.getFileSystem(spark._jsc.hadoopConfiguration())
        parent = path.getParent().toString()
        if parent not in listed:
            listed[parent] = {s.getPath().getName(): (s.getLen(), s.getModificationTime())
                              for s in files.listStatus(path.getParent())}
        digest.update(repr((name, listed[parent].get(path.getName()))).encode())
    return digest.hexdigest()


class Results:
    """Kept results under a folder that all of the cluster can reach."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder

    def kept(self, name: str, df: DataFrame, **parameters) -> DataFrame:
        """The rows of ``df``, read if they were kept before. ``name`` and ``parameters`` tell which result it is.

        What is not computed from files alone cannot be told to have changed, and is not kept. Nothing that
        depends on the time of the call should be.
        """
        if not only_files(df):
            return df
        key = sha256(json.dumps([name, parameters, df.schema.json(), fingerprint(df)], sort_keys=True, default=repr)
                     .encode()).hexdigest()
        folder = f"{self.folder}/{key}"
        folders.appear(self.spark, folder, lambda aside: df.write.parquet(aside))
        return self.spark.read.schema(df.schema).parquet(folder)

    def sql(self, query: str, **values) -> DataFrame:
        """SQL over the registered views with ``:name`` parameters, its rows kept."""
        return self.kept(query, run_sql(self.spark, query, **values), **values)

    def forget(self) -> None:
        """Delete all that is kept."""
        folders.delete(self.spark, self.folder)
