"""Run outputs: tables partitioned by run date, and attempts that become the run of a date all at once."""

from __future__ import annotations

import uuid
from datetime import date

from pyspark.sql import DataFrame, SparkSession, functions as F


def write_run(df: DataFrame, path: str, run_date: str) -> None:
    """Write one run as the partition of its date, replacing an earlier one.

    The partition's folder is written as such: a run without rows then still
    leaves a (typed, empty) partition, instead of the rows of the run before.
    """
    day = date.fromisoformat(run_date).isoformat()
    df.write.mode("overwrite").parquet(f"{path}/run_date={day}")


def read_run(spark: SparkSession, path: str, run_date: str) -> DataFrame:
    """One run; the filter prunes to its partition."""
    return spark.read.parquet(path).where(F.col("run_date") == F.lit(run_date).cast("date"))


def read_latest(spark: SparkSession, path: str) -> DataFrame:
    """The newest run, found from partition values alone."""
    runs = spark.read.parquet(path)
    return runs.where(F.col("run_date") == runs.agg(F.max("run_date")).scalar())


def is_committed(spark: SparkSession, path: str) -> bool:
    """Was a table written there to its end?"""
    done = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/_SUCCESS")
    return done.getFileSystem(spark._jsc.hadoopConfiguration()).exists(done)


def new_attempt(folder: str) -> str:
    """A path below the folder where nothing was written yet."""
    return f"{folder}/attempts/{uuid.uuid4().hex}"


def _commits(spark: SparkSession, folder: str, run_date: str):
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{folder}/commits/run_date={date.fromisoformat(run_date).isoformat()}")
    files = path.getFileSystem(spark._jsc.hadoopConfiguration())
    names = [f.getPath().getName() for f in files.listStatus(path)] if files.exists(path) else []
    return path, files, sorted(names)


def commit_attempt(spark: SparkSession, folder: str, run_date: str, attempt: str) -> None:
    """Make what an attempt wrote the run of its date.

    This creates one empty file, named after a rising number and the attempt; readers
    follow the last name. There is no moment without a run, and former attempts stay.
    """
    path, files, names = _commits(spark, folder, run_date)
    number = int(names[-1].partition(".")[0]) + 1 if names else 0
    name = f"{number:010d}.{attempt.rsplit('/', 1)[-1]}"
    files.mkdirs(path)
    if not files.createNewFile(spark._jvm.org.apache.hadoop.fs.Path(path, name)):
        raise FileExistsError(f"{path}/{name}")


def committed_attempt(spark: SparkSession, folder: str, run_date: str) -> str | None:
    """The path of the attempt that is the run of a date, None where none was committed."""
    _, _, names = _commits(spark, folder, run_date)
    return f"{folder}/attempts/{names[-1].partition('.')[2]}" if names else None


def read_committed(spark: SparkSession, folder: str, leg: str, run_date: str) -> DataFrame:
    """One table of the committed run of a date."""
    attempt = committed_attempt(spark, folder, run_date)
    if attempt is None:
        raise FileNotFoundError(f"{folder} has no committed run of {run_date}")
    return read_run(spark, f"{attempt}/{leg}", run_date)
