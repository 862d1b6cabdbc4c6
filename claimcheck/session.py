"""Session settings the operators rely on."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterable, Mapping

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

SETTINGS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    # split a hot key even where the grouping after the join then shuffles once more
    "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
    "spark.sql.session.timeZone": "UTC",
}


def configure(spark: SparkSession) -> SparkSession:
    for key, value in SETTINGS.items():
        spark.conf.set(key, value)
    return spark


def small_frame(
    spark: SparkSession, fields: str, rows: Iterable[Mapping[str, object]]
) -> DataFrame:
    """Rows the driver already holds, as a relation of known size.

    The planner sees how large they are, so it broadcasts them only where that is
    below its threshold. ``fields`` is ``name:type,...`` of strings and ints.
    """
    types = {"string": pa.string(), "int": pa.int32()}
    named = [field.split(":") for field in fields.split(",")]
    schema = pa.schema([(name, types[kind]) for name, kind in named])
    return spark.createDataFrame(pa.Table.from_pylist([dict(r) for r in rows], schema=schema))


def checkpoint_folder(spark: SparkSession) -> str:
    """The folder that ``spark.checkpoint.dir`` names.

    Only a local session, where all tasks see one disk, may go without it; on
    a cluster that is an error.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder and not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    return folder or "file://" + tempfile.mkdtemp(prefix="claimcheck-")


def cut_lineage(df: DataFrame) -> DataFrame:
    """Materialise as a checkpoint in the cluster's shared folder."""
    context = df.sparkSession.sparkContext
    if not context.getCheckpointDir():
        context.setCheckpointDir(checkpoint_folder(df.sparkSession))
    return df.checkpoint(eager=True)


def stored(df: DataFrame) -> DataFrame:
    """The same rows from a table in the cluster's shared folder, computed once."""
    path = f"{checkpoint_folder(df.sparkSession)}/rows-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
