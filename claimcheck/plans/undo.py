"""Roll back what runs wrote about a set of assets."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, functions as F

from claimcheck.functions import texts
from claimcheck.operators import rollback
from claimcheck.vocabulary import AUTHOR


@dataclass(frozen=True)
class Rollback:
    """The new version of each table, and one receipt row per asset."""

    descriptions: DataFrame
    incidents: DataFrame
    documents: DataFrame
    ledger: DataFrame
    receipt: DataFrame


def roll_back(
    assets: DataFrame,
    descriptions: DataFrame,
    incidents: DataFrame,
    documents: DataFrame,
    ledger: DataFrame,
    failed_legs: DataFrame,
    author: str = AUTHOR,
) -> Rollback:
    """All legs at once over whole tables; rows of other assets pass through unchanged."""
    chosen = assets.select("asset_urn").distinct().withColumn("_chosen", F.lit(True))

    drained = rollback.drain_corrections(
        descriptions.join(chosen, "asset_urn", "left"), author
    ).withColumn("original", F.when(F.col("_chosen"), F.col("original")))
    restored = drained.withColumn("description", F.coalesce("original", "description")).drop(
        "original", "_chosen"
    )

    own = F.col("_chosen") & (F.col("state") == "ACTIVE") & (
        F.col("title") == texts.incident_title(F.col("asset_urn"), author)
    )
    flagged = incidents.join(chosen, "asset_urn", "left").withColumn(
        "_own", F.coalesce(own, F.lit(False))
    )
    resolved = flagged.withColumn(
        "state", F.when(F.col("_own"), "RESOLVED").otherwise(F.col("state"))
    ).drop("_own", "_chosen")

    mine = ledger.join(chosen.drop("_chosen"), "asset_urn", "left_semi")
    candidates = rollback.dossiers_to_delete(
        rollback.ledger_dossier_ids(mine),
        rollback.search_hits(documents, assets, author),
        documents,
        author,
    )
    deleted = candidates.where(F.col("outcome") == "delete").select("document_urn").distinct()
    kept = documents.join(deleted.withColumn("_deleted", F.lit(True)), "document_urn", "left")

    receipt = rollback.rollback_receipt(
        assets, drained.where("_chosen"), flagged.where("_own"), candidates, mine, failed_legs
    )
    removed = receipt.where("ledger_removed").select("asset_urn")
    return Rollback(
        descriptions=restored,
        incidents=resolved,
        documents=kept.withColumn(
            "deleted", F.coalesce("_deleted", F.lit(False))
        ).drop("_deleted"),
        ledger=ledger.join(removed, "asset_urn", "left_anti"),
        receipt=receipt,
    )
