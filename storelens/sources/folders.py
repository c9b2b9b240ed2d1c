"""Folders that appear whole: written aside and renamed into place, on any file system that Spark writes to."""
import uuid
from collections.abc import Callable

from pyspark.sql import SparkSession


def file_system(spark: SparkSession, folder: str):
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    return path, path.getFileSystem(spark._jsc.hadoopConfiguration())


def exists(spark: SparkSession, folder: str) -> bool:
    path, files = file_system(spark, folder)
    return files.exists(path)


def names_in(spark: SparkSession, folder: str) -> list[str]:
    """Names of what a folder holds, ascending; none if there is no such folder."""
    path, files = file_system(spark, folder)
    return sorted(s.getPath().getName() for s in files.listStatus(path)) if files.exists(path) else []


def delete(spark: SparkSession, folder: str) -> None:
    path, files = file_system(spark, folder)
    files.delete(path, True)


def appear(spark: SparkSession, folder: str, write: Callable[[str], None]) -> bool:
    """Let ``write`` fill a folder of another name and then give it its own; false if it was there before.

    Nobody sees a part of it, and of several writers one wins. What a failed writer leaves behind starts with a dot.
    """
    path, files = file_system(spark, folder)
    if files.exists(path):
        return False
    parent = path.getParent()
    files.mkdirs(parent)
    aside = spark._jvm.org.apache.hadoop.fs.Path(parent, f".{path.getName()}-{uuid.uuid4().hex}")
    write(aside.toString())
    # A rename onto a folder that appeared meanwhile may move into it.
    won = not files.exists(path) and files.rename(aside, path)
    if not won:
        files.delete(aside, True)
    return won
