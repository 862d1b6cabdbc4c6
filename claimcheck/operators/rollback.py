"""The inverse of every write, for any set of assets at once.

Only what is recognisably this library's own is undone; anything else stays
and is reported.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from claimcheck.functions import texts
from claimcheck.vocabulary import AUTHOR


def ledger_dossier_ids(ledger: DataFrame) -> DataFrame:
    """``(asset_urn, document_urn, position)``: the documents the ledger text names."""
    segments = F.split("evidence", r" \| ", -1)
    tokens = F.flatten(F.transform(segments, lambda s: F.split(s, "; ", -1)))
    urns = F.filter(
        F.transform(tokens, lambda t: F.regexp_replace(t, r"^\s+|\s+\z", "")),
        lambda t: t.startswith(texts.DOSSIER_ID_PREFIX),
    )
    return ledger.select("asset_urn", F.posexplode(urns).alias("position", "document_urn"))


def restore_description(descriptions: DataFrame, author: str = AUTHOR) -> DataFrame:
    """Adds ``restored``: the quoted text, NULL unless the text is exactly one correction."""
    return descriptions.withColumn(
        "restored", texts.unwrap_correction(F.col("description"), author)
    )


def drain_corrections(descriptions: DataFrame, author: str = AUTHOR) -> DataFrame:
    """Adds ``original``: the text below all stacked corrections, NULL if there is none."""
    return descriptions.withColumn(
        "original", texts.unwrap_all_corrections(F.col("description"), author)
    )


def _own_format(author: str) -> Column:
    """Title and body wear this library's format."""
    return F.coalesce(
        F.startswith("title", F.lit(texts.dossier_title_head(author)))
        & F.startswith("body", F.lit(texts.dossier_header(author)))
        & F.contains("body", F.lit(texts.dossier_footer(author))),
        F.lit(False),
    )


def _is_about(asset: Column) -> Column:
    return F.coalesce(F.array_contains("related_assets", asset), F.lit(False))


def dossier_attestation(documents: DataFrame, author: str = AUTHOR) -> DataFrame:
    """Adds ``attested``: the document says itself that it is evidence for ``asset_urn``."""
    return documents.withColumn("attested", _own_format(author) & _is_about(F.col("asset_urn")))


def dossiers_to_delete(
    pointers: DataFrame, hits: DataFrame, documents: DataFrame, author: str = AUTHOR
) -> DataFrame:
    """``(asset_urn, document_urn, named_by_ledger, outcome)`` for every candidate.

    Candidates are what the ledger points to and what a search found. A
    pointer that cannot be read or is not attested is an anomaly and blocks
    the rollback; an unattested search hit is merely left alone. Bodies are
    looked at where they are stored; the joins carry the finding and single
    (document, asset) pairs, never a document's whole list of assets.
    """
    pairs = ("asset_urn", "document_urn")
    candidates = (
        pointers.select(*pairs, F.lit(True).alias("_ledger"))
        .unionByName(hits.select(*pairs, F.lit(False).alias("_ledger")))
        .groupBy(*pairs)
        .agg(F.bool_or("_ledger").alias("named_by_ledger"))
    )
    found = documents.select(
        "document_urn", _own_format(author).alias("_own"), F.lit(True).alias("_found")
    )
    about = (
        documents.select("document_urn", F.explode("related_assets").alias("asset_urn"))
        .distinct()
        .withColumn("_about", F.lit(True))
    )
    outcome = (
        F.when(F.col("_found").isNull(), "unreadable")
        .when(F.col("_own") & F.coalesce("_about", F.lit(False)), "delete")
        .when(F.col("named_by_ledger"), "anomaly")
        .otherwise("refused")
    )
    return (
        candidates.join(found, "document_urn", "left")
        .join(about, list(pairs), "left")
        .select(*pairs, "named_by_ledger", outcome.alias("outcome"))
    )


def search_hits(documents: DataFrame, assets: DataFrame, author: str = AUTHOR) -> DataFrame:
    """Documents related to an asset whose title carries the evidence marker."""
    return (
        documents.where(F.startswith("title", F.lit(texts.dossier_title_head(author))))
        .select("document_urn", F.explode("related_assets").alias("asset_urn"))
        .join(assets.select("asset_urn").distinct(), "asset_urn", "left_semi")
        .distinct()
    )


def rollback_receipt(
    assets: DataFrame,
    drained: DataFrame,
    resolved_incidents: DataFrame,
    candidates: DataFrame,
    ledger: DataFrame,
    failed_legs: DataFrame,
) -> DataFrame:
    """One row per asset. The ledger goes last, and only if nothing before it failed.

    ``failed_legs`` is ``(asset_urn, leg)``: writes the caller could not do.
    """

    def _count(rows: DataFrame, name: str, condition: Column | None = None) -> DataFrame:
        counter = F.count("*") if condition is None else F.count_if(condition)
        return rows.groupBy("asset_urn").agg(counter.alias(name))

    outcome = F.col("outcome")
    documents = candidates.groupBy("asset_urn").agg(
        F.count_if(outcome == "delete").alias("dossiers_deleted"),
        F.count_if(outcome != "delete").alias("dossiers_refused"),
        F.count_if(outcome.isin("anomaly", "unreadable")).alias("anomalies"),
    )
    legs = assets.select("asset_urn").distinct()
    for part in (
        _count(drained, "restored", F.col("original").isNotNull()),
        _count(resolved_incidents, "incidents_resolved"),
        documents,
        _count(ledger, "ledger_rows"),
        _count(failed_legs, "failed"),
    ):
        legs = legs.join(part, "asset_urn", "left")
    counts = ("restored", "incidents_resolved", "dossiers_deleted", "dossiers_refused")
    clean = (F.coalesce("anomalies", F.lit(0)) == 0) & (F.coalesce("failed", F.lit(0)) == 0)
    return legs.select(
        "asset_urn",
        *[F.coalesce(c, F.lit(0)).alias(c) for c in counts],
        (clean & (F.coalesce("ledger_rows", F.lit(0)) > 0)).alias("ledger_removed"),
        clean.alias("succeeded"),
    )
