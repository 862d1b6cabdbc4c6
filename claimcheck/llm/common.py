"""What the operators share: the folder for intermediate tables, tables cut from their lineage, sizes."""

from __future__ import annotations

import tempfile
import uuid
import zipfile
from collections.abc import Iterator
from contextlib import contextmanager
from functools import wraps
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession


_LOCAL_FOLDERS: list[str] = []


def shared_folder(spark: SparkSession) -> str:
    """A new folder name below the one that driver and executors share (spark.checkpoint.dir).

    Only a local session may go without that setting: there all tasks see the same disk.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        if not _LOCAL_FOLDERS:
            _LOCAL_FOLDERS.append("file://" + tempfile.mkdtemp(prefix="llm-"))
        base = _LOCAL_FOLDERS[0]
    return f"{base}/llm-{uuid.uuid4().hex}"


_TEMPORARY: list[list[str]] = []
#: Spark's setting by which the shuffle files of an execution go with it, not when the driver collects its garbage.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def _delete(spark: SparkSession, folder: str) -> None:
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


@contextmanager
def shuffles_removed(spark: SparkSession) -> Iterator[None]:
    """The shuffle files of what is written here are removed as soon as it stands; the session's setting stays."""
    before = spark.conf.get(CLEANUP, None)
    spark.conf.set(CLEANUP, "true")
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(CLEANUP)
        else:
            spark.conf.set(CLEANUP, before)


def tidy(function):
    """The function's result, written; the tables that it wrote on the way are deleted."""

    @wraps(function)
    def run(*args, **options):
        _TEMPORARY.append([])
        try:
            result = function(*args, **options)
            folders = _TEMPORARY[-1]
            _TEMPORARY[-1] = []
            result = written(result)
            kept = _TEMPORARY[-1]
        finally:
            _TEMPORARY.pop()
        if _TEMPORARY:
            _TEMPORARY[-1] += kept
        spark = result.sparkSession
        for folder in folders:
            _delete(spark, folder)
        return result

    return run


def temporary_folder(spark: SparkSession) -> str:
    """A new shared folder; inside a tidy operator it goes when the operator is done."""
    folder = shared_folder(spark)
    if _TEMPORARY:
        _TEMPORARY[-1].append(folder)
    return folder


def written(df: DataFrame, compression: str = "zstd") -> DataFrame:
    """The same rows, written to the shared folder and read back: cheap to reread, safe from lost executors."""
    folder = temporary_folder(df.sparkSession)
    with shuffles_removed(df.sparkSession):
        df.write.option("compression", compression).parquet(folder)
    found = df.sparkSession.read.schema(df.schema).parquet(folder)
    found._written_to = folder
    return found


def dropped(*tables: DataFrame) -> None:
    """Deletes what written() wrote on the way, inside a tidy operator, once nothing reads it any more."""
    for df in tables:
        if _TEMPORARY and df._written_to in _TEMPORARY[-1]:
            _TEMPORARY[-1].remove(df._written_to)
            _delete(df.sparkSession, df._written_to)


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def ship_library(spark: SparkSession) -> None:
    """Gives the library's modules to the Python workers, once for each Spark context."""
    context = spark.sparkContext
    if getattr(context, "_library_shipped", False):
        return
    package = Path(__file__).resolve().parents[1]
    archive = Path(tempfile.mkdtemp(prefix="library-")) / "library.zip"
    with zipfile.ZipFile(archive, "w") as out:
        for source in sorted(package.rglob("*.py")):
            out.write(source, source.relative_to(package.parent))
    context.addPyFile(str(archive))
    context._library_shipped = True
