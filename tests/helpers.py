from claimcheck.plans.verify import RECONCILIATION_SCHEMA, verify
from claimcheck.vocabulary import CLAIM_SCHEMA

FIELDS = ("unit", "cadence", "nullable", "values", "min", "max", "deprecated")


def urn(table, schema="shop", env="PROD"):
    return f"urn:li:dataset:(urn:li:dataPlatform:spark,{schema}.{table},{env})"


def claim(table, column, claim_type, text="A claim.", **predicate):
    return (urn(table), column, claim_type, text, tuple(predicate.get(f) for f in FIELDS))


def claims(spark, *rows):
    return spark.createDataFrame(
        [(u, c, i, k, t, p) for i, (u, c, k, t, p) in enumerate(rows)], CLAIM_SCHEMA
    )


def judge(spark, tables, *rows, as_of=None, log=None, declared=None, lineage=None, **options):
    """Findings of the given claims, in their order."""
    declarations = edges = None
    if declared is not None:
        declarations = spark.createDataFrame(declared, RECONCILIATION_SCHEMA)
        edges = spark.createDataFrame(lineage or [], "upstream string, downstream string")
    found = verify(claims(spark, *rows), tables, as_of, log, declarations, edges, **options)
    return [r for r in sorted(found.collect(), key=lambda r: r["pos"])]


def verdicts(*args, **options):
    return [r["verdict"] for r in judge(*args, **options)]
