"""Measured claims in, findings out."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, functions as F

from claimcheck.functions import rubrics
from claimcheck.vocabulary import CLAIM_SCHEMA

# Everything a rubric may look at. Absent columns are added as NULL, so that
# measurements of one kind alone can be judged too.
MEASURES = {
    "probe_kind": "string",
    "probe_error": "string",
    "rows_scanned": "bigint",
    "row_count": "bigint",
    "median": "double",
    "median_above_0": "boolean",
    "median_above_1": "boolean",
    "median_above_1000": "boolean",
    "integer_share": "double",
    "centi_integer_share": "double",
    "min_value": "double",
    "max_value": "double",
    "recon_joined": "decimal(38,0)",
    "recon_matched_keys": "bigint",
    "recon_suspect_keys": "bigint",
    "recon_suspect_rows": "bigint",
    "recon_ratio_share": "double",
    "recon_reference_rows": "bigint",
    "null_share": "double",
    "distinct_count": "bigint",
    "unexpected_count": "bigint",
    "first_unexpected": "string",
    "recent_queries": "bigint",
    "distinct_users": "bigint",
    "window_rows_any_table": "bigint",
    "latest_value": "string",
    "latest_column": "string",
    "temporal_column_count": "int",
    "days_stale": "int",
    "as_of": "string",
}
CLAIM_COLUMNS = tuple(part.split()[0] for part in CLAIM_SCHEMA.split(", "))
EVIDENCE = [m for m in MEASURES if m not in ("probe_kind", "probe_error")]


def with_all_measures(measured: DataFrame) -> DataFrame:
    absent = {
        name: F.lit(None).cast(kind)
        for name, kind in MEASURES.items()
        if name not in measured.columns
    }
    return measured.withColumns(absent) if absent else measured


def evidence() -> Column:
    """The filled measures as one struct; ``to_json`` drops the empty ones."""
    return F.struct(*[F.col(name) for name in EVIDENCE])


def _judge(measured: DataFrame, rubric: Callable[[], Column]) -> DataFrame:
    complete = with_all_measures(measured).withColumn("_finding", rubric())
    return complete.withColumns({
        "verdict": F.col("_finding.verdict"),
        "rule": F.col("_finding.rule"),
        "rationale": F.col("_finding.rationale"),
    }).drop("_finding")


def adjudicate(measured: DataFrame) -> DataFrame:
    """Adds ``verdict, rule, rationale`` to measured claims of any kind."""
    return _judge(measured, rubrics.verdict)


def verdict_money(measured: DataFrame) -> DataFrame:
    return _judge(measured, rubrics.money_verdict)


def verdict_percent(measured: DataFrame) -> DataFrame:
    return _judge(measured, rubrics.percent_verdict)


def verdict_never_null(measured: DataFrame) -> DataFrame:
    return _judge(measured, rubrics.never_null_verdict)


def verdict_enum(measured: DataFrame) -> DataFrame:
    return _judge(measured, rubrics.enum_verdict)


def verdict_bounds(measured: DataFrame) -> DataFrame:
    return _judge(measured, rubrics.bounds_verdict)


def verdict_deprecated(measured: DataFrame) -> DataFrame:
    return _judge(measured, rubrics.deprecated_verdict)


def verdict_freshness(measured: DataFrame) -> DataFrame:
    return _judge(measured, rubrics.freshness_verdict)


def as_findings(judged: DataFrame) -> DataFrame:
    """The columns the ledger works on, measures folded into ``evidence``."""
    return judged.select(
        "asset_urn", "field_path", "pos", "claim_type", "text", "verdict", "rule", "rationale",
        "median", "integer_share", F.to_json(evidence()).alias("evidence"),
    )
