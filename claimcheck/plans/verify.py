"""Claims and tables in, findings out."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame, functions as F

from claimcheck.operators import catalog, probes, verdicts
from claimcheck.plans.measures import Commits, measure_references, measure_tables

RECONCILIATION_SCHEMA = (
    "asset_urn string, field_path string, reference_table string, suspect_key string, "
    "reference_key string, reference_column string"
)


def measure(
    claims: DataFrame,
    tables: Mapping[str, DataFrame],
    as_of: str | None,
    query_log: DataFrame | None = None,
    references: DataFrame | None = None,
    folder: str | None = None,
) -> DataFrame:
    """Claims with their measures, or with the reason why there are none.

    Every table is measured by a job of its own, which commits a table of
    measures (below ``folder``, if a run is to be resumable); the claims meet
    all of them in one join. What the driver collects are the distinct (table,
    probe, column) triples that exist in the schemas, so their number is
    bounded by the schemas it already holds, not by claims.
    """
    spark = claims.sparkSession
    commits = Commits(spark, folder)
    schema = catalog.schema_rows(spark, tables)
    routed = probes.probe_errors(probes.route_claims(claims, as_of), schema)
    if query_log is None:
        no_log = F.when(F.col("probe_kind") == probes.USAGE, "no query log")
        routed = routed.withColumn("probe_error", F.coalesce("probe_error", no_log))

    # a freshness or usage claim is about the table, whatever column it names
    on_column = F.when(
        F.col("probe_kind").isin(probes.UNIT, probes.NULLS, probes.BOUNDS, probes.ENUM),
        F.col("field_path"),
    )
    wanted = routed.where(F.col("probe_error").isNull() & (F.col("probe_kind") != probes.USAGE)).select(
        "table_name", "probe_kind", on_column.alias("column")
    )
    needs: dict[str, dict[str, list[str]]] = {}
    for row in wanted.distinct().collect():
        columns = needs.setdefault(row["table_name"], {}).setdefault(row["probe_kind"], [])
        if row["column"] is not None:
            columns.append(row["column"])
    profiles, values, failed = measure_tables(tables, needs, as_of, commits)

    usage_claim = F.col("probe_kind") == probes.USAGE
    failures = failed.select(F.col("table_name").alias("_failed"), "failure")
    routed = routed.join(failures, (F.col("table_name") == F.col("_failed")) & ~usage_claim, "left")
    routed = routed.withColumn("probe_error", F.coalesce("probe_error", "failure")).drop("_failed", "failure")
    open_ = F.col("probe_error").isNull()
    measured = routed.where(~open_)

    found = profiles.withColumnsRenamed(
        {"table_name": "_table", "probe_kind": "_kind", "field_path": "_column", "probe_error": "_error"}
    )
    scanned = routed.where(open_ & ~F.col("probe_kind").isin(probes.ENUM, probes.USAGE)).withColumn("_on", on_column)
    scanned = scanned.join(
        found,
        (F.col("table_name") == F.col("_table"))
        & (F.col("probe_kind") == F.col("_kind"))
        & F.col("_on").eqNullSafe(F.col("_column")),
    ).withColumn("probe_error", F.col("_error"))
    measured = measured.unionByName(
        scanned.drop("_on", "_table", "_kind", "_column", "_error"), allowMissingColumns=True
    )
    enumerations = probes.enum_profile(routed.where(open_ & (F.col("probe_kind") == probes.ENUM)), values)
    measured = measured.unionByName(enumerations, allowMissingColumns=True)
    if query_log is not None and as_of is not None:
        usage_claims = routed.where(open_ & usage_claim)
        usage = probes.usage_window(query_log, usage_claims, as_of).drop("probe_kind")
        measured = measured.unionByName(usage_claims.join(usage, "asset_urn"), allowMissingColumns=True)
    if references is None:
        return measured
    ratios = measure_references(references, tables, schema, commits)
    same = (
        (F.col("asset_urn") == F.col("_urn")) & F.col("field_path").eqNullSafe(F.col("_field"))
        & (F.col("probe_kind") == probes.UNIT)
    )
    measured = measured.join(
        ratios.withColumnsRenamed({"asset_urn": "_urn", "field_path": "_field"}), same, "left"
    )
    return measured.withColumn("probe_error", F.coalesce("probe_error", "reference_error")).drop(
        "_urn", "_field", "reference_error"
    )


def verify(
    claims: DataFrame,
    tables: Mapping[str, DataFrame],
    as_of: str | None,
    query_log: DataFrame | None = None,
    declarations: DataFrame | None = None,
    lineage: DataFrame | None = None,
    folder: str | None = None,
) -> DataFrame:
    """Judged claims. A declared reference counts only as far as the lineage records it.

    Measures are committed below ``folder``; a repeated call with it measures only what is not there.
    """
    references = None
    if declarations is not None and lineage is not None:
        references = catalog.lineage_gate(declarations, lineage).where("ok")
    measured = measure(claims, tables, as_of, query_log, references, folder)
    return verdicts.adjudicate(measured)
