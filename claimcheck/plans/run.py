"""One verification run over all described assets: read, bind, extract, judge, write."""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass

from pyspark.sql import DataFrame, functions as F

from claimcheck.operators import catalog, claims as extraction, ledger, verdicts
from claimcheck.plans.publish import Deliver, Publication, publish_run
from claimcheck.plans.verify import measure
from claimcheck.session import cut_lineage
from claimcheck.vocabulary import AUTHOR


@dataclass(frozen=True)
class Run:
    """What was written, and the assets that were left alone with the reason."""

    written: Publication
    unbound: DataFrame
    failed: DataFrame


def run_catalog(
    ingested: DataFrame,
    edited: DataFrame,
    store: DataFrame,
    system_prompt: str,
    tables: Mapping[str, DataFrame],
    run_date: str,
    query_log: DataFrame,
    declarations: DataFrame,
    lineage: DataFrame,
    incidents: DataFrame,
    folder: str,
    author: str = AUTHOR,
    deliver: Mapping[str, Deliver] | None = None,
) -> Run:
    """Verify every asset whose fields the tables know and whose claims could be extracted.

    An asset with one failed extraction is left alone as a whole: a verdict on
    part of its claims would stand for all of them.
    """
    descriptions = catalog.effective_descriptions(ingested, edited)
    columns = catalog.schema_rows(descriptions.sparkSession, tables)
    binding = catalog.asset_binding(descriptions, columns)
    bound = descriptions.join(
        binding.where("bound").select("asset_urn"), "asset_urn", "left_semi"
    )
    extracted, errors = extraction.extract_claims(bound, store, system_prompt)
    whole = extracted.join(errors.select("asset_urn").distinct(), "asset_urn", "left_anti")
    claims = cut_lineage(whole)

    gated = catalog.lineage_gate(declarations, lineage)
    declared = gated.where(~F.col("ok")).select(
        F.col("asset_urn").alias("_urn"), F.col("field_path").alias("_field")
    )
    refused = claims.join(
        declared,
        (F.col("asset_urn") == F.col("_urn")) & F.col("field_path").eqNullSafe(F.col("_field")),
        "left_semi",
    ).select("asset_urn").distinct()

    measured = measure(claims, tables, run_date, query_log, gated.where("ok"))
    findings = verdicts.as_findings(verdicts.adjudicate(measured))
    usage = ledger.usage_evidence(query_log, claims.select("asset_urn"), run_date)
    written = publish_run(
        findings, descriptions, usage, incidents, refused, folder, run_date, author, deliver
    )
    return Run(written, binding.where(~F.col("bound")), errors)
