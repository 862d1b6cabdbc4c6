"""Findings against a ground truth of planted false claims and truthful controls.

The manifest is ``(asset_urn, field_path, description, planted_lie,
claim_type, planted_text)``, one entry per described field.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from claimcheck.functions import texts, urns
from claimcheck.functions.numbering import numbered
from claimcheck.session import small_frame
from claimcheck.vocabulary import CLAIM_TYPES, CONTRADICTED

CAUGHT, MISSED, FALSE_POSITIVE, CLEAN, UNSCORED = (
    "caught", "missed", "false_positive", "clean", "unscored",
)
COUNTS = ("lies", "caught", "missed", "controls", "false_positives", "clean", "unscored")
TOTAL = "total"
# Fixed format of the published table.
TABLE_HEAD = (
    "| claim type | planted lies | caught | missed | controls | false positives |",
    "|---|---|---|---|---|---|",
)


def _same_entry(left: str, right: str) -> Column:
    return (F.col(f"{left}.asset_urn") == F.col(f"{right}.asset_urn")) & F.col(
        f"{left}.field_path"
    ).eqNullSafe(F.col(f"{right}.field_path"))


def score_entries(manifest: DataFrame, findings: DataFrame, errors: DataFrame) -> DataFrame:
    """Adds ``outcome``, ``off_target`` and ``extraction_error`` to each entry.

    A false claim is caught only by a contradiction of its own type whose text
    contains the planted sentence. Any contradiction of a control is a false
    positive. A control that was never extracted is not scored.
    """
    contradicted = findings.where(F.col("verdict") == CONTRADICTED).select(
        "asset_urn", "field_path", F.col("claim_type").alias("found_type"), "text"
    )
    on_target = F.coalesce(
        (F.col("e.claim_type") == F.col("f.found_type"))
        & F.contains(F.col("f.text"), F.coalesce(F.nullif("e.planted_text", F.lit("")), "e.description")),
        F.lit(False),
    )
    # Contradictions per entry come from the join already matched, so the
    # aggregation is on the entry key alone and combines map-side.
    hits = (
        manifest.alias("e")
        .join(contradicted.alias("f"), _same_entry("e", "f"))
        .groupBy("e.asset_urn", "e.field_path")
        .agg(
            F.bool_or(on_target).alias("on_target"),
            F.count_if(~on_target).alias("off_target"),
        )
    )
    failed = errors.select("asset_urn", "field_path", "extraction_error")
    joined = (
        manifest.alias("e")
        .join(hits.alias("h"), _same_entry("e", "h"), "left")
        .join(failed.alias("x"), _same_entry("e", "x"), "left")
    )
    caught = F.coalesce("h.on_target", F.lit(False))
    off_target = F.coalesce("h.off_target", F.lit(0))
    outcome = (
        F.when(F.col("e.planted_lie"), F.when(caught, CAUGHT).otherwise(MISSED))
        .when(F.col("x.extraction_error").isNotNull(), UNSCORED)
        .when(caught | (off_target > 0), FALSE_POSITIVE)
        .otherwise(CLEAN)
    )
    return joined.select(
        "e.asset_urn", "e.field_path", "e.claim_type", "e.planted_lie",
        outcome.alias("outcome"), off_target.alias("off_target"), "x.extraction_error",
    )


def score_table(scored: DataFrame) -> DataFrame:
    """Counts per claim type and in total. Every type has a row; unscored counts nowhere else."""
    outcome = F.col("outcome")
    seen = outcome != UNSCORED
    flags = {
        "lies": seen & F.col("planted_lie"),
        "caught": outcome == CAUGHT,
        "missed": outcome == MISSED,
        "controls": seen & ~F.col("planted_lie"),
        "false_positives": outcome == FALSE_POSITIVE,
        "clean": outcome == CLEAN,
        "unscored": outcome == UNSCORED,
    }
    entries = scored.select(
        "claim_type", *[flags[c].cast("bigint").alias(c) for c in COUNTS]
    )
    every_type = small_frame(
        scored.sparkSession, "claim_type:string", [{"claim_type": t} for t in CLAIM_TYPES]
    ).select("claim_type", *[F.lit(0).cast("bigint").alias(c) for c in COUNTS])
    return (
        entries.unionByName(every_type)
        .rollup("claim_type")
        .agg(F.grouping("claim_type").alias("_total"), *[F.sum(c).alias(c) for c in COUNTS])
        .select(
            F.when(F.col("_total") == 1, TOTAL).otherwise(F.col("claim_type")).alias("claim_type"),
            *COUNTS,
        )
    )


def _entry_name() -> Column:
    return F.concat(
        urns.table_name(F.col("asset_urn")), F.lit("."), texts.field_label(F.col("field_path"))
    )


def score_report(scored: DataFrame) -> DataFrame:
    """``(line_no, line)``: the table and its disclosures as text lines, ``line_no`` giving their order.

    The entries without an extraction come last, one on a line.
    """
    spark = scored.sparkSession
    head = small_frame(
        spark, "line_no:int,line:string",
        [{"line_no": i, "line": line} for i, line in enumerate(TABLE_HEAD)],
    )
    order = {name: i + len(TABLE_HEAD) for i, name in enumerate((*CLAIM_TYPES, TOTAL))}
    position = F.create_map(*[F.lit(x) for pair in order.items() for x in pair])
    label = F.when(F.col("claim_type") == TOTAL, f"**{TOTAL}**").otherwise(F.col("claim_type"))
    shown = [F.col(c).cast("string") for c in COUNTS[:5]]
    body = score_table(scored).select(
        position[F.col("claim_type")].alias("line_no"),
        F.concat(F.lit("| "), F.concat_ws(" | ", label, *shown), F.lit(" |")).alias("line"),
    )
    after = len(TABLE_HEAD) + len(order)
    off_target = (
        scored.where(F.col("planted_lie"))
        .agg(F.sum("off_target").alias("n"))
        .where(F.col("n") > 0)
        .select(
            F.lit(after).alias("line_no"),
            F.concat(F.lit("off target, not caught: "), F.col("n").cast("string")).alias("line"),
        )
    )
    extent = scored.agg(F.count("*").alias("entries"), F.count("extraction_error").alias("failed"))
    not_extracted = extent.where(F.col("failed") > 0).select(
        F.lit(after + 1).alias("line_no"),
        F.concat(
            F.lit("not extracted: "), F.col("failed").cast("string"), F.lit("/"), F.col("entries").cast("string")
        ).alias("line"),
    )
    failed = scored.where(F.col("extraction_error").isNotNull()).select(
        _entry_name().alias("name"), "asset_urn", "field_path"
    )
    names = numbered(failed, [], ["name", "asset_urn", "field_path"]).select(
        (F.col("line_no") + after + 2).alias("line_no"), F.concat(F.lit("- "), "name").alias("line")
    )
    out = head
    for lines in (body, off_target, not_extracted, names):
        out = out.unionByName(lines)
    return out


def run_validity(manifest: DataFrame, missing: DataFrame, unexpected: DataFrame) -> DataFrame:
    """One row: what speaks against taking the run as a valid evaluation."""
    faults = (
        manifest.agg(F.count_if(F.col("claim_type").isNull()).alias("n"))
        .select(F.lit("untyped_entries").alias("fault"), "n")
        .unionByName(missing.agg(F.count("*").alias("n"))
                     .select(F.lit("missing_completions").alias("fault"), "n"))
        .unionByName(unexpected.agg(F.count("*").alias("n"))
                     .select(F.lit("unexpected_failures").alias("fault"), "n"))
    )
    names = ("untyped_entries", "missing_completions", "unexpected_failures")
    return faults.agg(
        *[F.sum(F.when(F.col("fault") == x, F.col("n")).otherwise(0)).alias(x) for x in names],
        (F.sum("n") == 0).alias("valid"),
    )
