"""Written intermediate results, for inputs that are read more than once.

An iterative fit or a multi-pass job must not recompute its input on every pass and must
not lose it with an executor, so the input is written to the shared folder of the cluster.
The files go when the application ends, or when they are released.
"""
import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructType

# Set to "true" if a folder of the local file system is mounted on every machine of the cluster; it is not tried then.
SHARED_FILES = "spark.storelens.sharedFileSystem"


def _file_system(spark: SparkSession, folder: str):
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    return path, path.getFileSystem(spark._jsc.hadoopConfiguration())


# Applications and local folders of theirs that were seen to be shared.
_SEEN: set[tuple[str, str]] = set()


def _refuse_unshared(spark: SparkSession, folder: str) -> None:
    """Let every core write a row into a local folder: it is shared if the driver finds all files and tasks read them.

    Where that cannot be shown, the folder is refused.
    """
    told = f"{folder} is a local folder; name one that every executor can reach, or set {SHARED_FILES}"
    try:
        key = spark.sparkContext.applicationId, folder
        if key in _SEEN:
            return
        path, files = _file_system(spark, f"{folder}/{uuid.uuid4().hex}")
        n = 2 * spark.sparkContext.defaultParallelism
        try:
            spark.range(0, n, 1, n).write.parquet(path.toString())
            found = spark.read.schema("id bigint").parquet(path.toString()).count()
        finally:
            files.delete(path, True)
    except Exception as error:
        raise RuntimeError(told) from error
    if found != n:
        raise RuntimeError(told)
    _SEEN.add(key)


def shared_folder(spark: SparkSession) -> str:
    """``spark.checkpoint.dir`` of the session.

    Executors on other machines may not see a local folder, so on a cluster one is taken only if the
    executors are seen to share it with the driver, or if it is said to be shared. Where the driver runs
    the tasks itself and nothing is set, a temporary folder serves.
    """
    alone = spark.sparkContext.master.startswith("local")
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if folder:
        if not alone and spark.conf.get(SHARED_FILES, "false") != "true" \
                and _file_system(spark, folder)[1].getScheme() == "file":
            _refuse_unshared(spark, folder)
        return folder
    if not alone:
        raise RuntimeError("set spark.checkpoint.dir to a folder that every executor can reach")
    folder = os.path.join(tempfile.gettempdir(), f"storelens-{spark.sparkContext.applicationId}")
    spark.sparkContext.setCheckpointDir(folder)
    return spark.sparkContext.getCheckpointDir()


def durable(df: DataFrame, schema: StructType | None = None) -> DataFrame:
    """Write ``df`` once and return a reader of the written rows.

    ``schema`` may name user-defined types that share the written physical layout. The files
    are deleted when the driver's JVM ends.
    """
    spark = df.sparkSession
    folder = f"{shared_folder(spark)}/{uuid.uuid4().hex}"
    path, files = _file_system(spark, folder)
    df.write.parquet(folder)
    files.deleteOnExit(path)
    written = spark.read.schema(schema or df.schema).parquet(folder)
    written.durable_folder = folder
    return written


def scratch(spark: SparkSession) -> str:
    """A folder that every executor can reach, not there yet, which goes when the application ends."""
    folder = f"{shared_folder(spark)}/{uuid.uuid4().hex}"
    path, files = _file_system(spark, folder)
    files.mkdirs(path)
    files.deleteOnExit(path)
    return folder


def release(*written: DataFrame) -> None:
    """Delete the files of durable tables that nothing will read again."""
    for df in written:
        path, files = _file_system(df.sparkSession, df.durable_folder)
        files.delete(path, True)
