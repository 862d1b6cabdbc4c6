"""Data tables: read by name, never written."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession


def parquet_tables(spark: SparkSession, folder: str, names: Iterable[str]) -> dict[str, DataFrame]:
    """``{name: DataFrame}`` of ``folder/name.parquet``; lazy, columns pruned by the plans."""
    return {name: spark.read.parquet(f"{folder}/{name}.parquet") for name in names}


def catalog_tables(spark: SparkSession, database: str) -> dict[str, DataFrame]:
    """All tables of a metastore database."""
    return {
        t.name: spark.read.table(f"{database}.{t.name}")
        for t in spark.catalog.listTables(database)
        if not t.isTemporary
    }
