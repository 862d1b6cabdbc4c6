"""Relations read from the catalog: descriptions, names, columns, lineage.

``field_path`` is NULL for a description of the table itself, so every match
on it is null-safe.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame, SparkSession, functions as F

from claimcheck.functions import urns
from claimcheck.functions.numbering import numbered
from claimcheck.session import small_frame

# Catalog names of the column types.
CATALOG_TYPES = {
    "bigint": "bigint",
    "int": "int",
    "double": "double",
    "string": "varchar",
    "date": "date",
    "timestamp": "timestamp",
    "timestamp_ntz": "timestamp",
}


def effective_descriptions(ingested: DataFrame, edited: DataFrame) -> DataFrame:
    """The edited text where there is one, else the ingested one; '' counts as none.

    Each layer holds one row per (asset, field). Edited texts pass through as
    they are; only their keys take part in the anti join, so a long text is
    moved once at most.
    """
    keys = ("asset_urn", "field_path")
    stated = F.col("description") != ""
    edits = edited.where(stated).select(*keys, "description")
    edited_keys = edits.select(F.col("asset_urn").alias("_urn"), F.col("field_path").alias("_field"))
    same = (F.col("asset_urn") == F.col("_urn")) & F.col("field_path").eqNullSafe(F.col("_field"))
    untouched = ingested.where(stated).select(*keys, "description").join(
        edited_keys, same, "left_anti"
    )
    return edits.unionByName(untouched)


def asset_parts(assets: DataFrame) -> DataFrame:
    """Adds the pieces of ``asset_urn`` and whether they are safe identifiers."""
    urn = F.col("asset_urn")
    return assets.withColumns({
        "platform": urns.platform(urn),
        "dataset_name": urns.dataset_name(urn),
        "table_name": urns.table_name(urn),
        "env": urns.environment(urn),
        "safe_table": urns.is_identifier(urns.table_name(urn)),
        "safe_dataset": urns.is_dotted_identifier(urns.dataset_name(urn)),
        "short_label": urns.short_label(urn),
        "dotted_label": urns.dotted_label(urn),
    })


def schema_rows(spark: SparkSession, tables: Mapping[str, DataFrame]) -> DataFrame:
    """``(table_name, ordinal, column_name, data_type)`` from the schemas alone."""
    return small_frame(
        spark,
        "table_name:string,ordinal:int,column_name:string,data_type:string",
        [
            {"table_name": name, "ordinal": i, "column_name": field.name,
             "data_type": field.dataType.simpleString()}
            for name, df in tables.items()
            for i, field in enumerate(df.schema.fields, start=1)
        ],
    )


def asset_binding(descriptions: DataFrame, columns: DataFrame) -> DataFrame:
    """May the table of that name speak for the asset?

    All described fields must be columns of the table. An asset with a table
    description only is bound by the table's existence, as weaker evidence.
    Counted per asset, so no list of fields is ever gathered.
    """
    described = descriptions.select(
        "asset_urn", "field_path", urns.table_name(F.col("asset_urn")).alias("table_name")
    )
    known = columns.select(
        "table_name", F.col("column_name").alias("field_path"), F.lit(True).alias("_known")
    ).distinct()
    tables = columns.select("table_name", F.lit(True).alias("_exists")).distinct()
    per_asset = (
        described.join(known, ["table_name", "field_path"], "left")
        .groupBy("asset_urn", "table_name")
        .agg(
            F.count("field_path").alias("described_fields"),
            F.count_if(F.col("field_path").isNotNull() & F.col("_known").isNull()).alias(
                "unknown_fields"
            ),
        )
        .join(tables, "table_name", "left")
    )
    exists = F.col("_exists").isNotNull()
    bound = exists & (F.col("unknown_fields") == 0)
    basis = (
        F.when(~exists, "no such table")
        .when(F.col("unknown_fields") > 0, "unknown fields")
        .when(F.col("described_fields") == 0, "table existence")
        .otherwise("described fields")
    )
    return per_asset.select(
        "asset_urn", "table_name", "described_fields", "unknown_fields",
        bound.alias("bound"), basis.alias("basis"),
    )


def merge_upstreams(existing: DataFrame, declared: DataFrame) -> DataFrame:
    """One row per edge: recorded edges first, then declared ones, first mention kept.

    Both inputs are ``(downstream, upstream, position)``. ``origin`` and
    ``position`` order the upstreams of a downstream.
    """
    columns = ("downstream", "upstream", "position")
    edges = existing.select(*columns, F.lit(0).alias("origin")).unionByName(
        declared.select(*columns, F.lit(1).alias("origin"))
    )
    # two plain minima instead of one over a struct keep this a hash aggregate
    first = [F.min(F.when(F.col("origin") == i, F.col("position"))).alias(f"_p{i}") for i in (0, 1)]
    return (
        edges.groupBy("downstream", "upstream")
        .agg(*first)
        .select(
            "downstream",
            "upstream",
            F.when(F.col("_p0").isNotNull(), 0).otherwise(1).alias("origin"),
            F.coalesce("_p0", "_p1").alias("position"),
        )
    )


def upstream_lists(edges: DataFrame) -> DataFrame:
    """The merged edges as ``(downstream, line_no, upstream)``, ``line_no`` giving their order."""
    return numbered(edges, ["downstream"], ["origin", "position", "upstream"]).select(
        "downstream", "line_no", "upstream"
    )


def lineage_gate(declarations: DataFrame, lineage: DataFrame) -> DataFrame:
    """Adds ``(reference_urn, ok, detail)`` to each declared reference.

    ``declarations`` has ``(asset_urn, field_path, reference_table, ...)``,
    ``lineage`` has ``(upstream, downstream)``. Only a recorded upstream of
    the suspect counts, and the suspect never vouches for itself.
    """
    urn, name = F.col("asset_urn"), F.col("reference_table")
    edges = lineage.select(
        F.col("downstream").alias("asset_urn"),
        F.col("upstream").alias("reference_urn"),
        F.lit(True).alias("_recorded"),
    ).distinct()
    resolved = declarations.withColumn(
        "reference_urn", F.when(urns.is_urn(urn), urns.sibling_urn(urn, name))
    ).join(edges, ["asset_urn", "reference_urn"], "left")
    refused = (
        F.when(F.col("reference_urn").isNull(), "refused: asset urn cannot be parsed")
        .when(F.col("reference_urn") == urn, "refused: the asset cannot be its own reference")
        .when(
            F.col("_recorded").isNull(),
            F.concat(F.lit("refused: "), name, F.lit(" is not a recorded upstream of the asset")),
        )
    )
    return resolved.withColumns({
        "ok": refused.isNull(),
        "detail": F.coalesce(refused, F.concat(F.lit("recorded upstream: "), "reference_urn")),
    }).drop("_recorded")


def catalog_columns(assets: DataFrame, columns: DataFrame, descriptions: DataFrame) -> DataFrame:
    """``(asset_urn, ordinal, column_name, type, description)`` to register.

    ``columns`` is :func:`schema_rows`; a type without a catalog name keeps its own.
    """
    catalog_type = F.create_map(*[F.lit(x) for pair in CATALOG_TYPES.items() for x in pair])
    named = assets.select(
        "asset_urn", urns.table_name(F.col("asset_urn")).alias("table_name")
    ).distinct()
    texts = descriptions.select(
        "asset_urn", F.col("field_path").alias("column_name"), "description"
    )
    return (
        named.join(columns, "table_name")
        .join(texts, ["asset_urn", "column_name"], "left")
        .select(
            "asset_urn",
            "ordinal",
            "column_name",
            F.coalesce(
                F.try_element_at(catalog_type, F.lower("data_type")), F.lower("data_type")
            ).alias("type"),
            "description",
        )
    )
