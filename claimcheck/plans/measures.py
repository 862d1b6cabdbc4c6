"""Measurements as tables: one restartable job for each data table and each pair of tables.

A job commits its rows as a table of its own. A job that fails leaves an error
row for what it was to measure and nothing else, so an unreadable table spoils
its own claims only. With a folder that outlives the run, a repeated run skips
what is committed there and measures again what had failed.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Mapping, Sequence
from concurrent.futures import ThreadPoolExecutor
from functools import reduce

from py4j.protocol import Py4JError
from pyspark.errors import PySparkException
from pyspark.sql import DataFrame, SparkSession, functions as F

from claimcheck.functions import urns
from claimcheck.operators import probes
from claimcheck.session import checkpoint_folder, small_frame, stored
from claimcheck.sources.outputs import is_committed

PROFILE_SCHEMA = ", ".join(f"{name} {kind}" for name, kind in {**probes.PROFILE_FIELDS, "median": "double"}.items())
VALUE_SCHEMA = "field_path string, compared_as string, value_key string, value string, n bigint"
RATIO_SCHEMA = (
    "ref string, recon_joined decimal(38,0), recon_matched_keys bigint, recon_ratio_share double, "
    "recon_suspect_keys bigint, recon_suspect_rows bigint, recon_reference_rows bigint"
)
JOBS_AT_ONCE = 4

Needs = Mapping[str, Mapping[str, Sequence[str]]]


def table_profile(df: DataFrame, needs: Mapping[str, Sequence[str]], as_of: str | None) -> DataFrame:
    """The constant-state measurements wanted of one table: ``(probe_kind, field_path, measures...)``.

    One scan for all of them; the shown medians read only the columns they are about.
    """
    profile = probes.fused_profile(df, needs, as_of)
    if not needs.get(probes.UNIT):
        return profile.withColumn("median", F.lit(None).cast("double"))
    middle = probes.exact_medians(df, needs[probes.UNIT]).select(
        F.lit(probes.UNIT).alias("probe_kind"), "field_path", "median"
    )
    return profile.join(middle, ["probe_kind", "field_path"], "left")


def _reason(error: Exception) -> str:
    condition = error.getCondition() if isinstance(error, PySparkException) else None
    return f"the measurement failed ({condition or type(error).__name__})"


class Commits:
    """Tables of measures below one folder, each written by a job of its own."""

    def __init__(self, spark: SparkSession, folder: str | None):
        self.spark = spark
        self.folder = folder or f"{checkpoint_folder(spark)}/measures-{uuid.uuid4().hex}"

    def run(self, jobs: Mapping[str, Callable[[], DataFrame]]) -> dict[str, str | None]:
        """Runs the jobs that are not committed; for each its failure, or None."""
        def one(name: str) -> str | None:
            path = f"{self.folder}/{name}"
            if is_committed(self.spark, path):
                return None
            rows = jobs[name]()
            try:
                rows.write.mode("overwrite").parquet(path)
            except (PySparkException, Py4JError) as error:
                return _reason(error)
            return None

        with ThreadPoolExecutor(JOBS_AT_ONCE) as pool:
            return dict(zip(jobs, pool.map(one, jobs), strict=True))

    def rows(self, names: Sequence[str], schema: str) -> DataFrame:
        """The committed tables as one, ``_name`` telling which row is whose."""
        tables = [
            self.spark.read.schema(schema).parquet(f"{self.folder}/{n}").withColumn("_name", F.lit(n)) for n in names
        ]
        nothing = self.spark.createDataFrame([], f"{schema}, _name string")
        return reduce(DataFrame.unionByName, tables) if tables else nothing


def measure_tables(
    tables: Mapping[str, DataFrame], needs: Needs, as_of: str | None, commits: Commits
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Profiles and distinct values, both with ``table_name``, and ``(table_name, failure)``."""
    jobs: dict[str, Callable[[], DataFrame]] = {}
    for name, kinds in sorted(needs.items()):
        wanted = {kind: sorted(columns) for kind, columns in kinds.items()}
        if wanted.keys() - {probes.ENUM}:
            jobs[f"profile/{name}"] = lambda n=name, w=wanted: table_profile(tables[n], w, as_of)
        if probes.ENUM in wanted:
            jobs[f"values/{name}"] = lambda n=name, w=wanted: probes.distinct_values(tables[n], w[probes.ENUM])
    outcome = commits.run(jobs)

    def rows(kind: str, schema: str) -> DataFrame:
        names = [n for n, failure in outcome.items() if n.startswith(kind) and failure is None]
        name = F.regexp_replace("_name", f"^{kind}/", "")
        return commits.rows(names, schema).withColumn("table_name", name).drop("_name")

    failures = {name.partition("/")[2]: failure for name, failure in outcome.items() if failure}
    failed = small_frame(
        commits.spark, "table_name:string,failure:string",
        [{"table_name": name, "failure": failure} for name, failure in failures.items()],
    )
    return rows("profile", PROFILE_SCHEMA), rows("values", VALUE_SCHEMA), failed


def reference_errors(references: DataFrame, columns: DataFrame) -> DataFrame:
    """Adds ``ref``, ``suspect_table`` and ``reference_error``: why a declared reference cannot be measured.

    ``columns`` is ``(table_name, column_name, data_type)``.
    """
    declared = references.select(
        "asset_urn", "field_path", "reference_table", "suspect_key", "reference_key", "reference_column",
        urns.table_name(F.col("asset_urn")).alias("suspect_table"),
    ).distinct()
    out = declared
    sides = (("suspect", "suspect_key", "field_path"), ("reference", "reference_key", "reference_column"))
    for side, key, value in sides:
        known = columns.select("table_name").distinct().select(
            F.col("table_name").alias(f"{side}_table"), F.lit(True).alias(f"_{side}")
        )
        out = out.join(known, f"{side}_table", "left")
        for column in (key, value):
            typed = columns.select(
                F.col("table_name").alias(f"{side}_table"), F.col("column_name").alias(column),
                F.col("data_type").alias(f"_{side}_{column}"),
            ).distinct()
            out = out.join(typed, [f"{side}_table", column], "left")
    error = F.lit(None).cast("string")
    for side, key, value in reversed(sides):
        place = lambda column: F.concat(f"{side}_table", F.lit("."), column)  # noqa: B023, E731
        error = (
            F.when(F.col(f"_{side}").isNull(), F.concat(F.lit("reference: no such table: "), f"{side}_table"))
            .when(F.col(f"_{side}_{key}").isNull(), F.concat(F.lit("reference: no such column: "), place(key)))
            .when(F.col(f"_{side}_{value}").isNull(), F.concat(F.lit("reference: no such column: "), place(value)))
            .when(~probes.is_numeric_name(F.col(f"_{side}_{value}")),
                  F.concat(F.lit("reference: not a numeric column: "), place(value)))
            .otherwise(error)
        )
    ref = F.sha2(F.to_json(F.struct(*declared.columns)), 256)
    return out.select(*declared.columns, ref.alias("ref"), error.alias("reference_error"))


def _side(role: str, key: str, value: str):
    return F.concat_ws(".", F.lit(role), key, value)


def measure_references(
    references: DataFrame, tables: Mapping[str, DataFrame], columns: DataFrame, commits: Commits
) -> DataFrame:
    """``(asset_urn, field_path, recon measures, reference_error)`` of every declared reference.

    References are rows throughout. What the driver collects are the column
    pairs that take part, which the schemas bound; each pair of tables is one
    job with one scan of each table, however many references it has.
    """
    checked = stored(reference_errors(references, columns))
    valid = checked.where(F.col("reference_error").isNull())
    pair = ("suspect_table", "reference_table")
    pairs: dict[tuple[str, str], tuple[dict, dict]] = {}
    for place, (role, key, value) in enumerate(
        (("suspect", "suspect_key", "field_path"), ("reference", "reference_key", "reference_column"))
    ):
        for row in valid.select(*pair, _side(role, key, value).alias("side"), key, value).distinct().collect():
            sides = pairs.setdefault((row[pair[0]], row[pair[1]]), ({}, {}))
            sides[place][row["side"]] = (row[key], row[value])

    def job(suspect: str, reference: str) -> Callable[[], DataFrame]:
        def build() -> DataFrame:
            left, right = pairs[suspect, reference]
            rows = probes.side_rows(tables[suspect], left).unionByName(probes.side_rows(tables[reference], right))
            mine = valid.where((F.col(pair[0]) == suspect) & (F.col(pair[1]) == reference))
            uses = mine.select("ref", F.inline(F.array(
                F.struct(_side("suspect", "suspect_key", "field_path").alias("side"), F.lit(True).alias("is_left")),
                F.struct(_side("reference", "reference_key", "reference_column").alias("side"), F.lit(False).alias("is_left")),
            )))
            return probes.ratio_measures(rows, uses)
        return build

    names = {f"ratios/{a}/{b}": (a, b) for a, b in sorted(pairs)}
    outcome = commits.run({name: job(*tables_of) for name, tables_of in names.items()})
    failed = small_frame(
        commits.spark, "suspect_table:string,reference_table:string,failure:string",
        [dict(zip((*pair, "failure"), (*names[n], failure), strict=True)) for n, failure in outcome.items() if failure],
    )
    ratios = commits.rows([n for n, failure in outcome.items() if failure is None], RATIO_SCHEMA).drop("_name")
    return (
        checked.join(ratios, "ref", "left").join(failed, list(pair), "left")
        .withColumn("reference_error", F.coalesce("reference_error", "failure"))
        .select("asset_urn", "field_path", "reference_error", *[c for c in ratios.columns if c != "ref"])
    )
