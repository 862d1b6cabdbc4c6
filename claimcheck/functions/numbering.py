"""Positions of rows in an order, without gathering a group in one task."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from claimcheck.session import stored


def numbered(
    rows: DataFrame,
    group: Sequence[str],
    order: Sequence[str | Column],
    name: str = "line_no",
    store: Callable[[DataFrame], DataFrame] = stored,
) -> DataFrame:
    """Adds ``name``: the row's position in its group, from 0, by ``order`` (nulls first).

    Rows are sorted by range over group and order together, so a group of any
    size is spread over as many tasks as it needs. A row's place in its task is
    known there; what a group has in earlier tasks is a sum over one row per
    (group, task). ``store`` keeps the sorted rows, so that both passes see the
    same places; ``order`` should end with what tells rows apart, since equal
    rows fall into one task. Without ``group`` all rows are one list.
    """
    keys = [F.col(g) for g in group]
    order = [F.col(o) if isinstance(o, str) else o for o in order]
    ordered = rows.repartitionByRange(*keys, *order).sortWithinPartitions(*keys, *order)
    placed = store(
        ordered.select("*", F.spark_partition_id().alias("_task"), F.monotonically_increasing_id().alias("_place"))
    )
    earlier = Window.partitionBy(*[f"_g{i}" for i in range(len(group))] or [F.lit(0)]).orderBy("_in").rowsBetween(
        Window.unboundedPreceding, -1
    )
    starts = (
        placed.groupBy(*[F.col(g).alias(f"_g{i}") for i, g in enumerate(group)], F.col("_task").alias("_in"))
        .agg(F.min("_place").alias("_first"), F.count("*").alias("_n"))
        .withColumn("_before", F.coalesce(F.sum("_n").over(earlier), F.lit(0)))
    )
    same = F.col("_task") == F.col("_in")
    for i, g in enumerate(group):
        same = same & F.col(g).eqNullSafe(F.col(f"_g{i}"))
    return placed.join(starts, same).select(
        *rows.columns, (F.col("_before") + F.col("_place") - F.col("_first")).alias(name)
    )
