"""Claims about the given test tables, scored end to end against what those tables really hold."""

import json

import pytest
from pyspark.sql import functions as F

from claimcheck.operators import claims, score
from claimcheck.plans.evaluate import evaluate
from claimcheck.plans.verify import RECONCILIATION_SCHEMA
from tests.helpers import urn
from workload.inputs import TABLES, relation, table

SF = "/root/testdata/sf0.001"
SYSTEM = "List the claims."
AS_OF = "2024-02-01"


def entry(name, column, kind, sentence, lie, outcome, answer=True, note="", **predicate):
    """A catalog text (note and claimed sentence), whether it lies, and how it must be scored."""
    return {
        "asset": urn(name), "column": column, "kind": kind, "text": f"{note} {sentence}".strip(),
        "planted": sentence if lie else None, "lie": lie, "outcome": outcome,
        "claims": [{"claim_type": kind, "text": sentence, "predicate": predicate}] if answer else None,
    }


# The facts: orders end in 2001 and are F, O or P; quantities go from 1 to 50, sizes too; the
# balances of some customers are below zero; events end two days before AS_OF; documents are in
# four languages, some without a label; discounts are fractions; conversations have three roles.
ENTRIES = [
    entry("orders", "o_orderstatus", "domain_enum", "Allowed values: F and O", True, "caught",
          values=["F", "O"]),
    entry("orders", None, "freshness", "A weekly load", True, "caught", note="All orders.",
          cadence="weekly"),
    entry("orders", "o_totalprice", "unit_scale", "What the customer pays, in USD", False, "clean",
          unit="USD"),
    entry("orders_cents", "amount", "unit_scale", "The same sum, in major currency units", True, "caught",
          unit="major_currency_units"),
    entry("lineitem", "l_quantity", "domain_enum", "From 1 to 10 pieces", True, "caught", min=1, max=10),
    entry("lineitem", "l_linestatus", "domain_enum", "Exactly F or O", False, "clean", values=["F", "O"]),
    entry("lineitem", "l_discount", "unit_scale", "Rebate in percent, 0 to 100", True, "missed",
          unit="percent_0_100"),
    entry("lineitem", "l_extendedprice", "unit_scale", "Net weight in kilograms", True, "missed",
          unit="kilograms"),
    entry("customer", "c_acctbal", "domain_enum", "Nonnegative at all times", True, "caught",
          note="The balance.", min=0),
    entry("customer", "c_custkey", "completeness", "Not null", False, "clean", nullable=False),
    entry("part", "p_size", "domain_enum", "Must be 1, 2 or 3", True, "caught", values=["1", "2", "3"]),
    entry("part", "p_retailprice", "unit_scale", "Catalog price (USD, without tax)", False, "clean", unit="USD"),
    entry("nation", "n_regionkey", "domain_enum", "Between 0 and 4", False, "clean", min=0, max=4),
    entry("region", None, "deprecation_usage", "Obsolete since the merger", False, "clean",
          deprecated=True),
    entry("supplier", None, "deprecation_usage", "Retired, do not use", True, "caught",
          note="The old list.", deprecated=True),
    entry("events", None, "freshness", "A monthly extract", False, "clean", cadence="monthly"),
    entry("events", "value", "completeness", "Non-null in every row", False, "clean", nullable=False),
    entry("documents", "lang", "domain_enum", "One of en, de and fr", True, "caught",
          values=["en", "de", "fr"]),
    entry("documents", "source", "domain_enum", "One of the known crawls", False, "unscored", answer=False),
    entry("labelled_documents", "quality", "completeness", "Not null, as a rule", True, "caught",
          nullable=False),
    entry("conversations", "role", "domain_enum", "Exactly user, assistant or system", False, "clean",
          values=["user", "assistant", "system"]),
]


@pytest.fixture(scope="module")
def warehouse(spark):
    derived = ("orders_cents", "labelled_documents")
    return {**{t: table(spark, SF, t) for t in TABLES}, **{n: relation(spark, SF, n) for n in derived}}


@pytest.fixture(scope="module")
def scored(spark, warehouse):
    manifest = spark.createDataFrame(
        [tuple(e[k] for k in ("asset", "column", "text", "lie", "kind", "planted")) for e in ENTRIES],
        "asset_urn string, field_path string, description string, planted_lie boolean, "
        "claim_type string, planted_text string")
    answers = spark.createDataFrame(
        [(e["asset"], e["column"], json.dumps(e["claims"])) for e in ENTRIES if e["claims"]],
        "asset_urn string, field_path string, completion string")
    prompts = claims.prompt_keys(manifest.select("asset_urn", "field_path", "description"), SYSTEM)
    store = prompts.alias("p").join(
        answers.alias("a"),
        (F.col("p.asset_urn") == F.col("a.asset_urn"))
        & F.col("p.field_path").eqNullSafe(F.col("a.field_path")),
    ).select("prompt_key", "user_prompt", "completion")
    references = spark.createDataFrame(
        [(urn("orders_cents"), "amount", "orders", "o_orderkey", "o_orderkey", "o_totalprice")],
        RECONCILIATION_SCHEMA)
    log = warehouse["events"].select(
        F.lit("supplier").alias("table_name"), F.col("ts").alias("queried_at"),
        F.col("event_type").alias("query_user"))
    found = evaluate(manifest, store, SYSTEM, warehouse, AS_OF, log, references).cache()
    return found, manifest, prompts, store


def test_outcome_of_every_entry(scored):
    got = {(r["asset_urn"], r["field_path"]): r["outcome"] for r in scored[0].collect()}
    assert got == {(e["asset"], e["column"]): e["outcome"] for e in ENTRIES}


def test_published_table(scored):
    lines = [r["line"] for r in score.score_report(scored[0]).orderBy("line_no").collect()]
    per_kind = {}
    for e in ENTRIES:
        row = per_kind.setdefault(e["kind"], [0, 0, 0, 0])
        if e["outcome"] != "unscored":
            for i, hit in enumerate((e["lie"], e["outcome"] == "caught", e["outcome"] == "missed", not e["lie"])):
                row[i] += hit
    for kind, row in per_kind.items():
        assert f"| {kind} | {' | '.join(map(str, row))} | 0 |" in lines
    total = [sum(column) for column in zip(*per_kind.values(), strict=True)]
    assert lines[7] == f"| **total** | {' | '.join(map(str, total))} | 0 |" and total == [11, 9, 2, 9]
    assert lines[8:] == ["not extracted: 1/21", "- documents.source"]


def test_run_validity(spark, scored):
    _, manifest, prompts, store = scored
    replayed = claims.replay_completions(prompts, store)
    blocked = prompts.where(F.col("field_path") == "source").select("prompt_key")

    def status(entries, stored, allowed):
        return score.run_validity(
            entries, claims.missing_completions(prompts, stored, allowed),
            claims.unexpected_failures(replayed, allowed)).first()

    assert status(manifest, store, blocked)["valid"]
    nobody = blocked.where(F.lit(False))
    strict = status(manifest, store, nobody)
    assert (strict["missing_completions"], strict["unexpected_failures"]) == (1, 1)
    untyped = manifest.withColumn("claim_type", F.lit(None).cast("string"))
    assert status(untyped, store, blocked)["untyped_entries"] == 21


def test_only_the_planted_sentence_counts(spark):
    entries = [("a", True, "Never null."), ("b", True, "Never null."), ("c", True, "Never null."),
               ("d", False, None), ("e", False, None), ("f", False, None), ("g", True, None)]
    manifest = spark.createDataFrame(
        [("t", f, "Rows. Never null.", lie, "completeness", planted)
         for f, lie, planted in entries],
        "asset_urn string, field_path string, description string, planted_lie boolean, "
        "claim_type string, planted_text string")
    findings = spark.createDataFrame(
        [("t", "a", "completeness", "It is: Never null.", "CONTRADICTED"),
         ("t", "b", "completeness", "null.", "CONTRADICTED"),
         ("t", "c", "domain_enum", "Never null.", "CONTRADICTED"),
         ("t", "d", "freshness", "x", "CONTRADICTED"),
         ("t", "e", "completeness", "Never null.", "CONFIRMED"),
         ("t", "g", "completeness", "Never null.", "CONTRADICTED")],
        "asset_urn string, field_path string, claim_type string, text string, verdict string")
    errors = spark.createDataFrame(
        [("t", "f", "unknown prompt")],
        "asset_urn string, field_path string, extraction_error string")
    got = {r["field_path"]: (r["outcome"], r["off_target"])
           for r in score.score_entries(manifest, findings, errors).collect()}
    assert got == {"a": ("caught", 0), "b": ("missed", 1), "c": ("missed", 1),
                   "d": ("false_positive", 1), "e": ("clean", 0), "f": ("unscored", 0),
                   "g": ("missed", 1)}
