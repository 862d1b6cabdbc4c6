"""Claims about the test tables, and the tables they are checked against."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from claimcheck.vocabulary import CLAIM_SCHEMA
from workload.inputs import PREDICATE_FIELDS, TABLES, relation, table


def urn(table_name: str) -> str:
    return f"urn:li:dataset:(urn:li:dataPlatform:spark,shop.{table_name},PROD)"


# (table, column, claim type, sentence, predicate)
CLAIMS = [
    ("part", "p_retailprice", "unit_scale", "List price in USD.", {"unit": "USD"}),
    ("events", "value", "unit_scale", "Value in USD.", {"unit": "usd"}),
    ("orders", "o_totalprice", "unit_scale", "Total in major currency units.",
     {"unit": "major_currency_units"}),
    ("orders_cents", "amount", "unit_scale", "Amount in USD.", {"unit": "USD"}),
    ("orders_cents", "o_orderkey", "unit_scale", "Key in USD.", {"unit": "USD"}),
    ("lineitem", "l_discount", "unit_scale", "Discount percent, 0 to 100.",
     {"unit": "percent_0_100"}),
    ("lineitem", "l_quantity", "unit_scale", "Quantity percent, 0 to 100.",
     {"unit": "percent_0_100"}),
    ("lineitem", "l_extendedprice", "unit_scale", "Price in grams.", {"unit": "grams"}),
    ("customer", "c_acctbal", "domain_enum", "Balance. Non-negative.", {"min": 0.0}),
    ("part", "p_size", "domain_enum", "Size between 1 and 50.", {"min": 1.0, "max": 50.0}),
    ("orders", "o_orderstatus", "domain_enum", "One of {F, O}.", {"values": ["F", "O"]}),
    ("orders", "o_orderstatus", "domain_enum", "One of {F, O, P}.", {"values": ["F", "O", "P"]}),
    ("documents", "lang", "domain_enum", "One of {en, de, fr}.", {"values": ["en", "de", "fr"]}),
    ("documents", "lang", "domain_enum", "At least 3.", {"min": 3.0}),
    ("orders", "o_orderkey", "completeness", "Never null.", {"nullable": False}),
    ("labelled_documents", "quality", "completeness", "Required.", {"nullable": False}),
    ("documents", "text", "completeness", "May be empty.", {"nullable": True}),
    ("orders", None, "freshness", "Updated daily.", {"cadence": "daily"}),
    ("lineitem", None, "freshness", "Updated weekly.", {"cadence": "weekly"}),
    ("events", "value", "freshness", "Updated daily.", {"cadence": "daily"}),
    ("documents", None, "freshness", "Updated daily.", {"cadence": "daily"}),
    ("purchase", None, "deprecation_usage", "No longer used.", {"deprecated": True}),
    ("orders", "o_custkey", "deprecation_usage", "No longer used.", {"deprecated": True}),
    ("no_such_table", "x", "completeness", "Never null.", {"nullable": False}),
    ("orders", "no_such_column", "completeness", "Never null.", {"nullable": False}),
    ("orders", "o_orderstatus", "unit_scale", "Status in USD.", {"unit": "USD"}),
]

DECLARATIONS = [
    (urn("orders_cents"), "amount", "orders", "o_orderkey", "o_orderkey", "o_totalprice"),
    (urn("orders_cents"), "o_orderkey", "orders_cents", "o_orderkey", "o_orderkey", "o_orderkey"),
]
LINEAGE = [(urn("orders"), urn("orders_cents"))]


def claim_rows(spark: SparkSession) -> DataFrame:
    rows = [
        (urn(t), column, i, kind, sentence,
         tuple(predicate.get(name) for name in PREDICATE_FIELDS))
        for i, (t, column, kind, sentence, predicate) in enumerate(CLAIMS)
    ]
    return spark.createDataFrame(rows, CLAIM_SCHEMA)


def warehouse(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    derived = {n: relation(spark, sf_dir, n) for n in ("orders_cents", "labelled_documents")}
    return {**{t: table(spark, sf_dir, t) for t in TABLES}, **derived}
