"""Score a run against a ground truth."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame

from claimcheck.operators import claims as extraction, score, verdicts
from claimcheck.plans.verify import measure
from claimcheck.session import cut_lineage


def evaluate(
    manifest: DataFrame,
    store: DataFrame,
    system_prompt: str,
    tables: Mapping[str, DataFrame],
    as_of: str,
    query_log: DataFrame | None = None,
    references: DataFrame | None = None,
) -> DataFrame:
    """Scored manifest entries: extract, measure, judge, compare.

    ``references`` are taken as declared: a ground truth states them itself.
    """
    claims, errors = extraction.extract_claims(
        manifest.select("asset_urn", "field_path", "description"), store, system_prompt
    )
    # measuring plans one scan per table and each meets the claims: extract them once
    claims = cut_lineage(claims)
    measured = measure(claims, tables, as_of, query_log, references)
    return score.score_entries(manifest, verdicts.adjudicate(measured), errors)
