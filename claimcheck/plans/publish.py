"""Write a run down: dossiers first, then the ledger, then corrections, then incidents.

All legs go to the fresh path of an attempt, which becomes the run of its date when the last is written.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping
from dataclasses import dataclass

from pyspark.sql import DataFrame, functions as F

from claimcheck.operators import ledger
from claimcheck.sources.outputs import commit_attempt, new_attempt, read_run, write_run
from claimcheck.vocabulary import AUTHOR

#: Takes the rows of a leg to where they are wanted; returns their keys with ``ok``, one row each.
Deliver = Callable[[DataFrame], DataFrame]

#: What a receipt of a leg names.
RECEIPT_KEYS = {
    "dossiers": ["asset_urn", "document_urn"],
    "ledger": ["asset_urn"],
    "corrections": ["asset_urn", "field_path", "pos"],
}


@dataclass(frozen=True)
class Publication:
    """Where each table of a run was written."""

    findings: str
    dossiers: str
    ledger: str
    corrections: str
    admission: str
    incidents: str
    resolved: str


LEGS = ("findings", "dossiers", "ledger", "corrections", "admission", "incidents", "resolved")


def _receipts(
    rows: DataFrame, leg: str, deliver: Mapping[str, Deliver], attempt: str, run_date: str
) -> DataFrame:
    """One receipt for each key of a written leg; a key that the receiver does not name has failed.

    Receipts are written, so a receiver is called once for each partition that
    Spark does not have to run again. Rows that go nowhere else are received
    by having been written.
    """
    keys = RECEIPT_KEYS[leg]
    expected = rows.select(*keys).distinct()
    if leg not in deliver:
        return expected.withColumn("ok", F.lit(True))
    path = f"{attempt}/receipts/{leg}"
    write_run(deliver[leg](rows).select(*keys, "ok"), path, run_date)
    found = read_run(rows.sparkSession, path, run_date)
    named = found.groupBy(*keys).agg(F.bool_and(F.coalesce("ok", F.lit(False))).alias("ok")).alias("named")
    same = [F.col(f"expected.{k}").eqNullSafe(F.col(f"named.{k}")) for k in keys]
    both = expected.alias("expected").join(named, same, "left")
    return both.select("expected.*", F.coalesce("named.ok", F.lit(False)).alias("ok"))


def publish_run(
    findings: DataFrame,
    descriptions: DataFrame,
    usage: DataFrame,
    incidents: DataFrame,
    refused_references: DataFrame,
    folder: str,
    run_date: str,
    author: str = AUTHOR,
    deliver: Mapping[str, Deliver] | None = None,
) -> Publication:
    """Each leg reads what the leg before has written, so nothing cites missing evidence.

    An asset of which a dossier was not received gets no ledger rows, and one
    whose ledger was not received no corrections; the other assets go on. The
    admission table says so for each asset. ``deliver`` names receivers of
    the legs ``dossiers``, ``ledger`` and ``corrections``.

    A leg that fails raises and stops those after it; its attempt is then
    never committed, and readers keep the run committed before. The findings
    are written first of all, which also keeps their lineage from being run
    again for every leg.
    """
    spark, deliver = findings.sparkSession, deliver or {}
    if unknown := set(deliver) - set(RECEIPT_KEYS):
        raise ValueError(f"no receipts for {sorted(unknown)}")
    attempt = new_attempt(folder)
    out = Publication(*[f"{attempt}/{leg}" for leg in LEGS])
    write_run(findings, out.findings, run_date)
    judged = read_run(spark, out.findings, run_date).drop("run_date")

    write_run(ledger.dossiers(judged, descriptions, run_date, author), out.dossiers, run_date)
    documents = read_run(spark, out.dossiers, run_date)
    received = _receipts(documents.drop("run_date"), "dossiers", deliver, attempt, run_date)

    none = received.select("asset_urn", "ok").limit(0)
    gate = ledger.write_gate(judged, received, none, none)
    admitted = ledger.admitted(judged, gate, "ledger_admitted")
    write_run(ledger.ledger_rows(admitted, documents, run_date), out.ledger, run_date)
    book = read_run(spark, out.ledger, run_date)
    booked = _receipts(book.drop("run_date"), "ledger", deliver, attempt, run_date)

    gate = ledger.write_gate(judged, received, booked, none)
    fixes = ledger.corrections(judged, descriptions, run_date, author)
    write_run(ledger.admitted(fixes, gate, "corrections_admitted"), out.corrections, run_date)
    fixed = read_run(spark, out.corrections, run_date).drop("run_date")
    corrected = _receipts(fixed, "corrections", deliver, attempt, run_date)
    write_run(ledger.write_gate(judged, received, booked, corrected), out.admission, run_date)

    drafts = ledger.incident_drafts(judged, usage, run_date, author)
    raised = ledger.incidents_to_raise(drafts, incidents).where(~F.col("already_open"))
    write_run(raised, out.incidents, run_date)
    resolved = ledger.incidents_to_resolve(incidents, judged, drafts, refused_references, author)
    write_run(resolved, out.resolved, run_date)
    commit_attempt(spark, folder, run_date, attempt)
    return out
