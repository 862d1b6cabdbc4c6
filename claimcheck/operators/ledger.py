"""What a run writes down: verdicts per asset, evidence, corrections, incidents.

Findings are ``(asset_urn, field_path, pos, claim_type, text, verdict, rule,
rationale, median, integer_share, evidence)``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from claimcheck.functions import texts
from claimcheck.functions.numbering import numbered
from claimcheck.operators.probes import usage_window
from claimcheck.vocabulary import (
    AUTHOR, CENTS_MEDIAN_FLOOR, CONFIRMED, CONTRADICTED, HIGH_USAGE_FLOOR, MIXED, UNIT_SCALE,
    UNVERIFIABLE,
)

# Verdicts in the order a tally names them.
TALLY_ORDER = (CONFIRMED, CONTRADICTED, UNVERIFIABLE)


def _any(verdict: str) -> Column:
    return F.bool_or(F.col("verdict") == verdict)


def asset_verdict(findings: DataFrame) -> DataFrame:
    """One verdict per asset; confirmed next to anything else makes it mixed."""
    seen = findings.groupBy("asset_urn").agg(
        _any(CONFIRMED).alias("_yes"), _any(CONTRADICTED).alias("_no"),
        _any(UNVERIFIABLE).alias("_open"),
    )
    overall = (
        F.when(F.col("_yes") & (F.col("_no") | F.col("_open")), MIXED)
        .when(F.col("_no"), CONTRADICTED)
        .when(F.col("_yes"), CONFIRMED)
        .otherwise(UNVERIFIABLE)
    )
    return seen.select("asset_urn", overall.alias("verdict"))


def verdict_tally(findings: DataFrame) -> DataFrame:
    """``N claims: n V, ...`` per asset, from three map-side combined counts."""
    counts = findings.groupBy("asset_urn").agg(
        F.count("*").alias("claims"),
        *[F.count_if(F.col("verdict") == v).alias(v) for v in TALLY_ORDER],
    )
    named = [
        F.when(F.col(v) > 0, F.concat(F.col(v).cast("string"), F.lit(f" {v}")))
        for v in TALLY_ORDER
    ]
    return counts.select(
        "asset_urn",
        F.concat(F.col("claims").cast("string"), F.lit(" claims: "), F.concat_ws(", ", *named))
        .alias("tally"),
    )


# Sections of an asset's ledger lines, in order.
TALLY_LINE, REASON_LINE, POINTER_LINE = range(3)


def _summary_lines(findings: DataFrame) -> DataFrame:
    """``(asset_urn, section, field_path, pos, line)``: the tally, and each open field's reason."""
    reasons = findings.where(F.col("verdict") == UNVERIFIABLE).select(
        "asset_urn", F.lit(REASON_LINE).alias("section"), "field_path", "pos",
        F.concat(
            F.lit("unverifiable "), texts.field_label(F.col("field_path")), F.lit(": "),
            F.coalesce("rationale", F.lit("")),
        ).alias("line"),
    )
    tallies = verdict_tally(findings).select(
        "asset_urn", F.lit(TALLY_LINE).alias("section"), F.col("tally").alias("line")
    )
    return reasons.unionByName(tallies, allowMissingColumns=True)


_LINE_ORDER = ("section", "field_path", "pos", "line")


def verdict_summary(findings: DataFrame) -> DataFrame:
    """``(asset_urn, line_no, line)``: the tally, then each open field with its reason."""
    lines = numbered(_summary_lines(findings), ["asset_urn"], _LINE_ORDER)
    return lines.select("asset_urn", "line_no", "line")


# What is measured for each kind of claim, in words.
MEASUREMENT_NOTES = {
    "unit_scale": "median, shares of whole values and of hundredths, extrema of the column; "
                  "with a declared reference the ratio to it per key",
    "completeness": "rows and share of nulls of the column",
    "domain_enum": "distinct values of the column, or its extrema",
    "freshness": "newest value of the date and timestamp columns against the run date",
    "deprecation_usage": "reads of the table in the query log in the 30 days to the run date",
}


def _with_pre_image(findings: DataFrame, descriptions: DataFrame) -> DataFrame:
    before = descriptions.select(
        F.col("asset_urn").alias("_urn"), F.col("field_path").alias("_field"),
        F.col("description").alias("pre_image"),
    )
    same = (F.col("asset_urn") == F.col("_urn")) & F.col("field_path").eqNullSafe(F.col("_field"))
    return findings.join(before, same, "left").drop("_urn", "_field")


def dossiers(
    findings: DataFrame, descriptions: DataFrame, run_date: str, author: str = AUTHOR
) -> DataFrame:
    """One evidence document per confirmed or contradicted finding.

    ``document_urn`` is derived from what the document is about, so writing a
    run again yields the same documents.
    """
    decided = _with_pre_image(
        findings.where(F.col("verdict").isin(CONFIRMED, CONTRADICTED)), descriptions
    )
    notes = F.create_map(*[F.lit(x) for pair in MEASUREMENT_NOTES.items() for x in pair])
    digest = F.sha2(
        F.concat_ws("\x00", F.lit(author), F.lit(run_date), "asset_urn",
                    F.coalesce("field_path", F.lit("\x01")), F.col("pos").cast("string")),
        256,
    )
    urn, field = F.col("asset_urn"), F.col("field_path")
    return decided.select(
        F.concat(F.lit(texts.DOSSIER_ID_PREFIX), digest).alias("document_urn"),
        "asset_urn",
        "field_path",
        "pos",
        texts.dossier_title(urn, field, run_date, author).alias("title"),
        texts.dossier_body(
            urn, field, F.col("claim_type"), F.col("text"), F.col("verdict"), F.col("rationale"),
            F.col("pre_image"), F.coalesce(notes[F.col("claim_type")], F.lit("-")),
            F.coalesce("evidence", F.lit("{}")), run_date, author,
        ).alias("body"),
        F.array("asset_urn").alias("related_assets"),
    )


def corrections(
    findings: DataFrame, descriptions: DataFrame, run_date: str, author: str = AUTHOR
) -> DataFrame:
    """Replacement text for each contradicted field or table.

    It quotes the full description in force, or the claim where none is known.
    """
    wrong = _with_pre_image(findings.where(F.col("verdict") == CONTRADICTED), descriptions)
    measured = texts.measured_summary(
        F.col("median"), F.col("integer_share"), F.col("rationale")
    )
    return wrong.select(
        "asset_urn",
        "field_path",
        "pos",
        texts.correction(
            F.coalesce("pre_image", "text"), measured, run_date, author
        ).alias("description"),
    )


def ledger_rows(findings: DataFrame, documents: DataFrame, run_date: str) -> DataFrame:
    """``(asset_urn, line_no, verdict, verified_at, evidence)``: summary lines, then one document each.

    ``evidence`` of an asset without documents ends with a line that says so.
    """
    pointers = documents.select(
        "asset_urn", F.lit(POINTER_LINE).alias("section"), "field_path", "pos",
        F.col("document_urn").alias("line"),
    )
    without = (
        findings.select("asset_urn").distinct()
        .join(documents.select("asset_urn").distinct(), "asset_urn", "left_anti")
        .select("asset_urn", F.lit(POINTER_LINE).alias("section"), F.lit(texts.NO_DOSSIERS).alias("line"))
    )
    lines = _summary_lines(findings).unionByName(pointers).unionByName(without, allowMissingColumns=True)
    return (
        numbered(lines, ["asset_urn"], _LINE_ORDER)
        .join(asset_verdict(findings), "asset_urn")
        .select(
            "asset_urn", "line_no", "verdict", F.lit(run_date).alias("verified_at"),
            F.col("line").alias("evidence"),
        )
    )


def write_gate(
    assets: DataFrame, dossier_receipts: DataFrame, ledger_receipts: DataFrame,
    correction_receipts: DataFrame,
) -> DataFrame:
    """Per asset: may the ledger be written, may corrections, did all of it succeed?

    Receipts are ``(asset_urn, ok)``; dossier receipts also carry
    ``document_urn``, without which a dossier does not count as written.
    """

    def _all_ok(receipts: DataFrame, ok: Column, name: str) -> DataFrame:
        return receipts.groupBy("asset_urn").agg(
            F.bool_and(F.coalesce(ok, F.lit(False))).alias(name)
        )

    ok = F.col("ok")
    gathered = (
        assets.select("asset_urn").distinct()
        .join(_all_ok(dossier_receipts, ok & F.col("document_urn").isNotNull(), "_d"),
              "asset_urn", "left")
        .join(_all_ok(ledger_receipts, ok, "_l"), "asset_urn", "left")
        .join(_all_ok(correction_receipts, ok, "_c"), "asset_urn", "left")
    )
    documents_ok = F.coalesce("_d", F.lit(True))
    ledger_ok = documents_ok & F.coalesce("_l", F.lit(False))
    return gathered.select(
        "asset_urn",
        documents_ok.alias("ledger_admitted"),
        ledger_ok.alias("corrections_admitted"),
        (ledger_ok & F.coalesce("_c", F.lit(True))).alias("succeeded"),
    )


def admitted(rows: DataFrame, gate: DataFrame, leg: str) -> DataFrame:
    """The rows of those assets whose ``leg`` (a column of the gate) is open."""
    return rows.join(gate.where(F.col(leg)).select("asset_urn"), "asset_urn", "left_semi")


def usage_evidence(query_log: DataFrame, assets: DataFrame, as_of: str) -> DataFrame:
    """Queries and users of the last 30 days; an unused asset yields no row at all."""
    return (
        usage_window(query_log, assets, as_of)
        .where(F.col("recent_queries") > 0)
        .select("asset_urn", F.col("recent_queries").alias("queries_last_30d"), "distinct_users")
    )


def _dangerous(findings: DataFrame) -> DataFrame:
    return findings.where(
        (F.col("verdict") == CONTRADICTED) & (F.col("claim_type") == UNIT_SCALE)
    )


def _incident_claims(findings: DataFrame, usage: DataFrame) -> DataFrame:
    """The contradicted unit claims of much-used assets."""
    used = usage.where(F.col("queries_last_30d") >= HIGH_USAGE_FLOOR)
    return _dangerous(findings).join(used.select("asset_urn"), "asset_urn", "left_semi")


def incident_drafts(
    findings: DataFrame, usage: DataFrame, run_date: str, author: str = AUTHOR
) -> DataFrame:
    """At most one incident per asset: a contradicted unit claim on a much-used asset.

    ``(asset_urn, title, claims, description)``; the claims themselves are the
    rows of ``incident_lines``.
    """
    counts = _incident_claims(findings, usage).groupBy("asset_urn").agg(F.count("*").alias("claims"))
    description = F.concat(
        F.col("claims").cast("string"), F.lit(" unit or scale claims contradicted by measurement. Usage: "),
        F.col("queries_last_30d").cast("string"), F.lit(" queries in the last 30 days by "),
        F.col("distinct_users").cast("string"), F.lit(f" users. Raised by {author}, run {run_date}."),
    )
    return counts.join(usage, "asset_urn").select(
        "asset_urn", texts.incident_title(F.col("asset_urn"), author).alias("title"), "claims",
        description.alias("description"),
    )


def incident_lines(findings: DataFrame, usage: DataFrame) -> DataFrame:
    """``(asset_urn, line_no, line)``: the claims of each draft, by field."""
    wrong = _incident_claims(findings, usage).select(
        "asset_urn", "field_path", "pos",
        F.concat(
            F.lit("- "), texts.field_label(F.col("field_path")), F.lit(': "'), "text",
            F.lit('" is contradicted: '), "rationale",
        ).alias("line"),
    )
    return numbered(wrong, ["asset_urn"], ["field_path", "pos", "line"]).select(
        "asset_urn", "line_no", "line"
    )


def incidents_to_raise(drafts: DataFrame, incidents: DataFrame) -> DataFrame:
    """Adds ``already_open``: an ACTIVE incident of the same asset and title exists."""
    active = (
        incidents.where(F.col("state") == "ACTIVE")
        .groupBy("asset_urn", "title")
        .agg(F.min("incident_urn").alias("open_incident"))
    )
    return drafts.join(active, ["asset_urn", "title"], "left").withColumn(
        "already_open", F.col("open_incident").isNotNull()
    )


def unresolved_suspicion(findings: DataFrame) -> DataFrame:
    """Assets with an undecided unit claim whose values look like cents."""
    return (
        findings.where(
            (F.col("verdict") == UNVERIFIABLE)
            & (F.col("claim_type") == UNIT_SCALE)
            & (F.col("integer_share") == 1.0)
            & (F.col("median") > CENTS_MEDIAN_FLOOR)
        )
        .select("asset_urn")
        .distinct()
    )


def incidents_to_resolve(
    incidents: DataFrame, findings: DataFrame, drafts: DataFrame, refused_references: DataFrame,
    author: str = AUTHOR,
) -> DataFrame:
    """Own ACTIVE incidents that this run gives positive reason to close.

    The asset must have been judged in this run, draft nothing, carry no
    refused reference and no unresolved suspicion.
    """
    own = incidents.where(
        (F.col("state") == "ACTIVE")
        & (F.col("title") == texts.incident_title(F.col("asset_urn"), author))
    )
    return (
        own.join(findings.select("asset_urn").distinct(), "asset_urn", "left_semi")
        .join(drafts.select("asset_urn").distinct(), "asset_urn", "left_anti")
        .join(refused_references.select("asset_urn").distinct(), "asset_urn", "left_anti")
        .join(unresolved_suspicion(findings), "asset_urn", "left_anti")
    )
