"""Prompts, replay, parsing and gates."""

import json

import pytest
from pyspark.sql import functions as F

from claimcheck.operators import claims
from claimcheck.sources.completions import read_completions
from tests.helpers import urn

SYSTEM = "List the claims."


def described(spark, *texts):
    return spark.createDataFrame(
        [(urn("t"), f"c{i}", text) for i, text in enumerate(texts)],
        "asset_urn string, field_path string, description string",
    )


def store_for(spark, descriptions, completions):
    prompts = claims.prompt_keys(descriptions, SYSTEM)
    answers = spark.createDataFrame(
        [(f"c{i}", c) for i, c in enumerate(completions) if c is not None],
        "field_path string, completion string",
    )
    return prompts.join(answers, "field_path").select("prompt_key", "user_prompt", "completion")


def extract(spark, *pairs):
    """[(description, completion)] -> ({field: [claims]}, {field: error})"""
    descriptions = described(spark, *[d for d, _ in pairs])
    found, errors = claims.extract_claims(
        descriptions, store_for(spark, descriptions, [c for _, c in pairs]), SYSTEM
    )
    kept = {}
    for r in found.orderBy("field_path", "pos").collect():
        kept.setdefault(r["field_path"], []).append(r)
    return kept, {r["field_path"]: r["extraction_error"] for r in errors.collect()}


def item(kind, text, **predicate):
    return json.dumps([{"claim_type": kind, "text": text, "predicate": predicate}])


def test_prompt_format_and_key(spark):
    import hashlib

    rows = spark.createDataFrame(
        [(urn("t"), "c", "Text."), (urn("t"), None, "Text.")],
        "asset_urn string, field_path string, description string",
    )
    for r in claims.prompt_keys(rows, SYSTEM).collect():
        target = "column `c`" if r["field_path"] else "the table itself"
        prompt = f"Asset: {urn('t')}\nTarget: {target}\nDescription: Text."
        assert r["user_prompt"] == prompt
        assert r["prompt_key"] == hashlib.sha256((SYSTEM + "\0" + prompt).encode()).hexdigest()[:24]


def test_parse_cases(spark):
    good = item("unit_scale", "In USD.", unit="USD")
    kept, errors = extract(
        spark,
        ("In USD.", good),
        ("In USD.", "Sure:\n```json\n" + good + "\n```\n"),
        ("In USD.", "  []\n"),
        ("In USD.", "no claims"),
        ("In USD.", '{"a": 1}'),
        ("In USD.", "[3]"),
        ("In USD.", good[:-1] + ', {"claim_type": "owner", "text": "In USD."}]'),
        ("In USD.", '[{"text": "In USD."}]'),
        ("In USD.", None),
        ("In USD.", "null"),
        ("In USD.", '[{"claim_type": 3, "text": "In USD.", "predicate": {}}]'),
    )
    assert sorted(kept) == ["c0", "c1"]
    assert errors == {
        "c3": claims.NOT_JSON, "c4": claims.NOT_AN_ARRAY, "c5": claims.NOT_AN_OBJECT,
        "c6": claims.BAD_CLAIM_TYPE, "c7": claims.BAD_CLAIM_TYPE, "c8": claims.UNKNOWN_PROMPT,
        "c9": claims.NOT_AN_ARRAY, "c10": claims.BAD_CLAIM_TYPE,
    }


CASES = [
    # (kept?, claim type, text, predicate)
    (True, "unit_scale", "Amount in usd.", {"unit": "USD"}),
    (False, "unit_scale", "Duration in milliseconds.", {"unit": "USD"}),
    (False, "unit_scale", "Amount 42.", {"unit": 42}),
    (False, "unit_scale", "Amount.", {}),
    (True, "unit_scale", "Percentage between 0 and 100.", {"unit": "percent_0_100"}),
    (True, "unit_scale", "Share in %, 0-100.", {"unit": "percent_0_100"}),
    (False, "unit_scale", "Discount rate as a percent.", {"unit": "percent_0_100"}),
    (False, "unit_scale", "Percent from 10 to 1000.", {"unit": "percent_0_100"}),
    (True, "unit_scale", "Total in major currency units.", {"unit": "major_currency_units"}),
    (True, "freshness", "Updated Daily.", {"cadence": "daily"}),
    (False, "freshness", "Updated often.", {"cadence": "daily"}),
    (False, "freshness", "Updated daily.", {"cadence": True}),
    (True, "completeness", "Never null.", {"nullable": False}),
    (True, "completeness", "Always populated.", {"nullable": False}),
    (True, "completeness", "Required field.", {"nullable": False}),
    (False, "completeness", "This field is not required.", {"nullable": False}),
    (False, "completeness", "Not always populated.", {"nullable": False}),
    (False, "completeness", "Customer email.", {"nullable": False}),
    (False, "completeness", "Never null.", {"nullable": "false"}),
    (True, "completeness", "May be missing.", {"nullable": True}),
    (True, "domain_enum", "Status, one of {placed, shipped}.", {"values": ["placed", "shipped"]}),
    (False, "domain_enum", "Status, one of {placed, shipped}.", {"values": ["placed", "lost"]}),
    (False, "domain_enum", "Currency, one of {USD, EUR}.", {"values": ["US"]}),
    (False, "domain_enum", "Currencies include USD and EUR.", {"values": ["USD", "EUR"]}),
    (False, "domain_enum", "One of {a}.", {"values": []}),
    (False, "domain_enum", "One of {a, null}.", {"values": ["a", None]}),
    (True, "domain_enum", "One of {a.b, [c]}.", {"values": ["a.b", "[c]"]}),
    (False, "domain_enum", "One of {axb}.", {"values": ["a.b"]}),
    (True, "domain_enum", "Level, one of {1, 2}.", {"values": [1, 2]}),
    (True, "domain_enum", "Units on hand. Non-negative.", {"min": 0}),
    (True, "domain_enum", "Always >= 0.", {"min": 0}),
    (False, "domain_enum", "Units on hand.", {"min": 0}),
    (False, "domain_enum", "Up to 12.", {"max": 2}),
    (False, "domain_enum", "Up to 2.5.", {"max": 2}),
    (True, "domain_enum", "From 0.5 to 2.5 kg", {"min": 0.5, "max": 2.5}),
    (False, "domain_enum", "Non-negative.", {"min": 0, "max": 10}),
    (False, "domain_enum", "Non-negative.", {"min": True}),
    (False, "domain_enum", "Some values.", {}),
    (True, "deprecation_usage", "DEPRECATED: superseded.", {"deprecated": True}),
    (True, "deprecation_usage", "Do not use.", {"deprecated": True}),
    (False, "deprecation_usage", "This table is not deprecated.", {"deprecated": True}),
    (False, "deprecation_usage", "Order history.", {"deprecated": True}),
    (False, "deprecation_usage", "Deprecated.", {"deprecated": "true"}),
    (True, "deprecation_usage", "Order history.", {"deprecated": False}),
]


def test_entailment_gates(spark):
    kept, errors = extract(
        spark, *[(text, item(kind, text, **p)) for _, kind, text, p in CASES]
    )
    assert errors == {}
    for i, (expected, kind, text, predicate) in enumerate(CASES):
        assert (f"c{i}" in kept) == expected, (kind, text, predicate)


def test_grounding_gate(spark):
    kept, _ = extract(
        spark,
        ("Ledger amount.", item("unit_scale", "Amount in USD.", unit="USD")),
        ("Amount in USD. Checked.", item("unit_scale", "Amount in USD.", unit="USD")),
        ("Amount in USD.", item("unit_scale", "amount in usd.", unit="USD")),
        ("Amount in USD.", item("unit_scale", "  ", unit="USD")),
        ("Amount in USD.", '[{"claim_type": "unit_scale", "predicate": {"unit": "USD"}}]'),
        ("Amount in USD.", '[{"claim_type": "unit_scale", "text": 5, "predicate": {}}]'),
        ("Amount in USD.", '[{"claim_type": "unit_scale", "text": "USD", "predicate": 7}]'),
    )
    assert sorted(kept) == ["c1"]


def test_stored_files_are_bound_to_their_prompt(spark, tmp_path):
    descriptions = described(spark, "In USD.", "In USD.", "In USD.")
    prompts = claims.prompt_keys(descriptions, SYSTEM).orderBy("field_path").collect()
    for key, prompt in ((prompts[0], prompts[0]), (prompts[1], prompts[0])):
        record = {"completion": item("unit_scale", "In USD.", unit="USD"),
                  "user": prompt["user_prompt"], "meta": {"model": "m", "note": "n"}}
        (tmp_path / f"{key['prompt_key']}.json").write_text(json.dumps(record, indent=1))
    store = read_completions(spark, str(tmp_path))
    replayed = claims.replay_completions(claims.prompt_keys(descriptions, SYSTEM), store)
    assert [r["extraction_error"] for r in replayed.orderBy("field_path").collect()] == [
        None, claims.PROMPT_MISMATCH, claims.UNKNOWN_PROMPT,
    ]
    prompts = claims.prompt_keys(descriptions, SYSTEM)
    blocked = prompts.where(F.col("field_path") == "c2").select("prompt_key")
    assert claims.missing_completions(prompts, store, blocked).count() == 0
    failed = claims.unexpected_failures(replayed, blocked).collect()
    assert [r["field_path"] for r in failed] == ["c1"]
