"""A whole run: catalog texts in, written verdicts out."""

import json

from pyspark.sql import functions as F

from claimcheck.operators import claims
from claimcheck.plans.run import run_catalog
from claimcheck.sources.outputs import read_latest, read_run, write_run
from claimcheck.plans.verify import RECONCILIATION_SCHEMA
from tests.helpers import urn

SYSTEM = "List the claims."
DAY = "2026-07-18"
TEXTS = "asset_urn string, field_path string, description string"


def test_run_over_a_catalog(spark, tmp_path):
    tables = {
        "payments": spark.range(500).select(
            F.col("id").alias("order_id"), F.expr("150000 + id * 100").alias("amount")),
        "invoices": spark.range(500).select(
            F.col("id").alias("order_id"), F.expr("1500D + id").alias("total")),
        "fees": spark.range(500).select(F.expr("2000 + id").alias("fee")),
    }
    ingested = spark.createDataFrame(
        [(urn("payments"), "amount", "Amount in USD."), (urn("payments"), "order_id", "Key."),
         (urn("fees"), "fee", "Old."), (urn("gone"), "x", "Amount in USD."),
         (urn("invoices"), "total", "Amount in USD.")], TEXTS)
    edited = spark.createDataFrame([(urn("fees"), "fee", "Fee in USD.")], TEXTS)
    completions = {
        "Amount in USD.": [{"claim_type": "unit_scale", "text": "Amount in USD.",
                            "predicate": {"unit": "USD"}}],
        "Fee in USD.": [{"claim_type": "unit_scale", "text": "Fee in USD.",
                         "predicate": {"unit": "USD"}}],
        "Key.": [],
    }
    current = ingested.where("description <> 'Old.'").unionByName(edited)
    answers = spark.createDataFrame(
        [(d, json.dumps(c)) for d, c in completions.items()], "description string, completion string")
    store = claims.prompt_keys(current, SYSTEM).join(answers, "description").where(
        F.col("asset_urn") != urn("invoices")
    ).select("prompt_key", "user_prompt", "completion")
    log = spark.range(60).select(
        F.lit("payments").alias("table_name"),
        F.expr("timestamp_ntz'2026-07-10 09:00:00'").alias("queried_at"),
        F.lit("u").alias("query_user"))
    declarations = spark.createDataFrame(
        [(urn("payments"), "amount", "invoices", "order_id", "order_id", "total"),
         (urn("fees"), "fee", "invoices", "fee", "order_id", "total")], RECONCILIATION_SCHEMA)
    lineage = spark.createDataFrame(
        [(urn("invoices"), urn("payments"))], "upstream string, downstream string")
    title = "claimcheck: wrong unit or scale on shop."
    incidents = spark.createDataFrame(
        [("i1", urn("fees"), title + "fees", "ACTIVE")],
        "incident_urn string, asset_urn string, title string, state string")

    run = run_catalog(ingested, edited, store, SYSTEM, tables, DAY, log, declarations, lineage,
                      incidents, str(tmp_path))
    findings = {r["asset_urn"]: (r["verdict"], r["rule"])
                for r in read_run(spark, run.written.findings, DAY).collect()}
    assert findings == {
        urn("payments"): ("CONTRADICTED", "cents corroborated"),
        urn("fees"): ("UNVERIFIABLE", "cents without reference")}
    assert [r["asset_urn"] for r in run.unbound.collect()] == [urn("gone")]
    assert {(r["asset_urn"], r["extraction_error"]) for r in run.failed.collect()} == {
        (urn("invoices"), claims.UNKNOWN_PROMPT)}
    fixes = read_run(spark, run.written.corrections, DAY).collect()
    assert [(r["asset_urn"], r["field_path"]) for r in fixes] == [(urn("payments"), "amount")]
    assert "]] Amount in USD. [[" in fixes[0]["description"]
    raised = read_run(spark, run.written.incidents, DAY).collect()
    assert [r["asset_urn"] for r in raised] == [urn("payments")]
    # a refused reference and an open suspicion both keep the incident standing
    assert read_run(spark, run.written.resolved, DAY).count() == 0


def test_a_repeated_run_without_rows_leaves_none_of_the_old(spark, tmp_path):
    path = str(tmp_path / "t")
    write_run(spark.range(3), path, DAY)
    write_run(spark.range(5), path, "2026-07-17")
    write_run(spark.range(3).where("id > 9"), path, DAY)
    assert read_run(spark, path, DAY).count() == 0
    assert read_run(spark, path, "2026-07-17").count() == 5
    assert str(read_latest(spark, path).schema["run_date"].dataType) == "DateType()"
