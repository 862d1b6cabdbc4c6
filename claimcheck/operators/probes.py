"""Measurements of claims on the data tables.

A measurement is one row of typed columns; columns a probe does not fill are
absent and read as NULL after ``unionByName(allowMissingColumns=True)``.
Every measurement reads its whole table.

The measures of all claims on a table share one scan with constant state
(:func:`fused_profile`). What needs more than constant state runs apart:
distinct values, exact medians, reconciliation.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from datetime import date

from pyspark.sql import Column, DataFrame, Window, functions as F

from claimcheck.functions import urns
from claimcheck.session import small_frame
from claimcheck.vocabulary import (
    COMPLETENESS, DEPRECATION_USAGE, DOMAIN_ENUM, FRESHNESS, RATIO_TARGET, RATIO_TOLERANCE,
    UNIT_SCALE, USAGE_WINDOW_DAYS,
)

UNIT, NULLS, ENUM, BOUNDS, USAGE, FRESH, NONE = (
    "unit", "nulls", "enum", "bounds", "usage", "freshness", "none",
)
# Medians are compared with these values; which side they fall on is decided
# exactly from counts, without the median itself.
MEDIAN_THRESHOLDS = (0, 1, 1000)
NUMERIC_TYPES = ("tinyint", "smallint", "int", "bigint", "float", "double")
TEMPORAL_TYPES = ("date", "timestamp", "timestamp_ntz")


def is_numeric_name(data_type: Column) -> Column:
    return data_type.isin(*NUMERIC_TYPES) | data_type.startswith("decimal")


# --- extent ------------------------------------------------------------------


def scan_extent(df: DataFrame) -> DataFrame:
    """``rows_scanned``: the rows of the whole table, NULL fields included."""
    return df.agg(F.count("*").alias("rows_scanned"))


# --- routing and refusals ----------------------------------------------------


def route_claims(claims: DataFrame, as_of: str | None) -> DataFrame:
    """Adds ``probe_kind`` and the bare ``table_name``."""
    kind, on_column = F.col("claim_type"), F.col("field_path").isNotNull()
    anchored = F.lit(as_of is not None)
    predicate = F.col("predicate")
    recipe = (
        F.when((kind == UNIT_SCALE) & on_column, UNIT)
        .when((kind == COMPLETENESS) & on_column, NULLS)
        .when((kind == DOMAIN_ENUM) & on_column & predicate["values"].isNotNull(), ENUM)
        .when(
            (kind == DOMAIN_ENUM) & on_column
            & (predicate["min"].isNotNull() | predicate["max"].isNotNull()),
            BOUNDS,
        )
        .when(
            (kind == DEPRECATION_USAGE) & ~on_column & predicate["deprecated"] & anchored, USAGE
        )
        .when((kind == FRESHNESS) & predicate["cadence"].isNotNull() & anchored, FRESH)
        .otherwise(NONE)
    )
    return claims.withColumns(
        {"probe_kind": recipe, "table_name": urns.table_name(F.col("asset_urn"))}
    )


def probe_errors(routed: DataFrame, columns: DataFrame) -> DataFrame:
    """Adds ``probe_error``: why a routed claim cannot be measured, else NULL.

    ``columns`` is ``(table_name, column_name, data_type)``. A usage claim
    measures the query log, so its own table may be gone.
    """
    known = columns.select(
        "table_name", F.col("column_name").alias("field_path"), F.col("data_type").alias("_type")
    ).distinct()
    tables = columns.groupBy("table_name").agg(
        F.count_if(F.col("data_type").isin(*TEMPORAL_TYPES)).alias("_temporal")
    )
    kind, table, field = F.col("probe_kind"), F.col("table_name"), F.col("field_path")
    per_column = kind.isin(UNIT, NULLS, ENUM, BOUNDS)
    no_table = F.col("_temporal").isNull()
    error = (
        F.when(kind == NONE, F.lit("no probe recipe for this claim"))
        .when(~urns.is_identifier(table), F.concat(F.lit("unsafe table name: "), table))
        .when(kind == USAGE, F.lit(None))
        .when(per_column & ~urns.is_identifier(field),
              F.concat(F.lit("unsafe column name: "), field))
        .when(no_table, F.concat(F.lit("no such table: "), table))
        .when(per_column & F.col("_type").isNull(),
              F.concat(F.lit("no such column: "), table, F.lit("."), field))
        .when(kind.isin(UNIT, BOUNDS) & ~is_numeric_name(F.col("_type")),
              F.concat(F.lit("not a numeric column: "), table, F.lit("."), field))
        .when((kind == FRESH) & (F.col("_temporal") == 0),
              F.concat(F.lit("no date or timestamp column in table: "), table))
    )
    return (
        routed.join(known, ["table_name", "field_path"], "left")
        .join(tables, "table_name", "left")
        .withColumn("probe_error", error)
        .drop("_type", "_temporal")
    )


# --- one scan for everything with constant state -----------------------------


def _unit_aggregates(c: str) -> list[str]:
    """Shares of whole values and of hundredths, and where the thresholds lie.

    With the number of values at or below a threshold, the largest of them and
    the smallest above it, the median's side is known without the median.
    """
    v = f"cast(`{c}` as double)"
    out = [
        f"avg(case when {v} = rint({v}) then 1D when {v} is not null then 0D end) as `{c}__int`",
        f"avg(case when {v} * 100 = rint({v} * 100) then 1D when {v} is not null then 0D end) "
        f"as `{c}__centi`",
    ]
    for t in MEDIAN_THRESHOLDS:
        out += [
            f"count_if({v} <= {t}) as `{c}__le{t}`",
            f"max(case when {v} <= {t} then {v} end) as `{c}__lo{t}`",
            f"min(case when {v} > {t} then {v} end) as `{c}__hi{t}`",
        ]
    return out


def _above(c: str, t: int) -> str:
    """median > t. Only when exactly half the values lie at or below t does the
    median fall between the two sides; then it is the mean of their neighbours."""
    n, low = f"`{c}__n`", f"`{c}__le{t}`"
    return (
        f"case when {n} > 0 then case when {low} * 2 = {n} "
        f"then (`{c}__lo{t}` + `{c}__hi{t}`) / 2 > {t} else {low} * 2 < {n} end end"
    )


# The columns of a profile row and their types; what a probe does not measure is NULL.
PROFILE_FIELDS = {
    "probe_kind": "string", "field_path": "string", "rows_scanned": "bigint",
    "row_count": "bigint", "null_share": "double", "min_value": "double", "max_value": "double",
    "integer_share": "double", "centi_integer_share": "double",
    **{f"median_above_{t}": "boolean" for t in MEDIAN_THRESHOLDS},
    "latest_value": "string", "latest_column": "string", "temporal_column_count": "int",
    "days_stale": "int", "as_of": "string", "probe_error": "string",
}


def _profile_row(**measured: str) -> str:
    """One row of the profile out of the one wide aggregate row."""
    fields = {"rows_scanned": "rows_scanned", **measured}
    return "named_struct(" + ", ".join(
        f"'{name}', cast({fields.get(name, 'null')} as {kind})"
        for name, kind in PROFILE_FIELDS.items()
    ) + ")"


def _column_row(kind: str, c: str) -> str:
    if kind == NULLS:
        share = f"case when rows_scanned > 0 then (rows_scanned - `{c}__n`) / rows_scanned end"
        return _profile_row(probe_kind=f"'{kind}'", field_path=f"'{c}'",
                            row_count="rows_scanned", null_share=share)
    measured = {"row_count": f"`{c}__n`", "min_value": f"`{c}__min`", "max_value": f"`{c}__max`"}
    if kind == UNIT:
        measured.update(integer_share=f"`{c}__int`", centi_integer_share=f"`{c}__centi`")
        measured.update({f"median_above_{t}": _above(c, t) for t in MEDIAN_THRESHOLDS})
    return _profile_row(probe_kind=f"'{kind}'", field_path=f"'{c}'", **measured)


def temporal_columns(df: DataFrame) -> list[str]:
    """Date and timestamp columns whose names are plain identifiers; others are not looked at."""
    return [
        f.name for f in df.schema.fields
        if f.dataType.simpleString() in TEMPORAL_TYPES and f.name.isascii() and f.name.isidentifier()
    ]


def _newest(columns: Sequence[str]) -> str:
    """The newest of the columns' maxima; the first column wins a tie, NULLs never do."""
    candidates = ", ".join(
        f"named_struct('d', `{c}__latest`, 'before', {-i}, 'c', '{c}')"
        for i, c in enumerate(columns)
    )
    if not candidates:
        return "cast(null as struct<d:date,before:int,c:string>)"
    return f"array_max(filter(array({candidates}), s -> s.d is not null))"


def _fresh_row(columns: Sequence[str], as_of: str) -> str:
    error = (
        "case when newest is null then 'all date columns are entirely null' end"
        if columns else "'no date or timestamp column in the table'"
    )
    return _profile_row(
        probe_kind=f"'{FRESH}'", latest_value="newest.d", latest_column="newest.c",
        temporal_column_count=str(len(columns)),
        days_stale=f"datediff(date'{as_of}', newest.d)", as_of=f"'{as_of}'", probe_error=error,
    )


def fused_profile(
    df: DataFrame,
    needs: Mapping[str, Sequence[str]],
    as_of: str | None = None,
) -> DataFrame:
    """All constant-state measures of a table in one scan, one row per (probe, column).

    ``needs`` maps a probe kind to the columns it is wanted for; freshness is
    about the table and takes whatever date and timestamp columns it has. Only
    the columns involved are read. The aggregates are sums, counts and
    extrema, so the scan stays in whole-stage codegen and each task sends one row.
    """
    wanted = {k: list(dict.fromkeys(needs.get(k, ()))) for k in (UNIT, NULLS, BOUNDS)}
    fresh = FRESH in needs and as_of is not None
    temporal = temporal_columns(df) if fresh else []
    measured = list(dict.fromkeys(c for columns in wanted.values() for c in columns))
    ranged = list(dict.fromkeys([*wanted[UNIT], *wanted[BOUNDS]]))
    aggregates = ["count(*) as rows_scanned"]
    aggregates += [f"count(`{c}`) as `{c}__n`" for c in measured]
    for c in ranged:
        aggregates.append(f"min(cast(`{c}` as double)) as `{c}__min`")
        aggregates.append(f"max(cast(`{c}` as double)) as `{c}__max`")
    for c in wanted[UNIT]:
        aggregates += _unit_aggregates(c)
    aggregates += [f"cast(max(`{c}`) as date) as `{c}__latest`" for c in temporal]
    rows = [_column_row(kind, c) for kind, columns in wanted.items() for c in columns]
    if fresh:
        rows.append(_fresh_row(temporal, date.fromisoformat(as_of).isoformat()))
    return (
        df.select(*dict.fromkeys([*measured, *temporal]))
        .selectExpr(*aggregates)
        .selectExpr("*", f"{_newest(temporal)} as newest")
        .selectExpr(f"inline(array({', '.join(rows)}))")
    )


# Counters of a round of selection, and buckets of an octave in the first one.
SLOTS, OCTAVE = 1 << 16, 16
NAN_BUCKET, INFINITE_BUCKET, MIDDLE_BUCKET = 1 << 21, 1 << 20, 40_000


def _bucket(v: Column) -> Column:
    """A whole number that grows with the double, NaN last: one of some 70,000."""
    size = F.abs(v)
    octaves = F.floor(F.log2(size) * OCTAVE) + MIDDLE_BUCKET
    return (
        F.when(v == 0, F.lit(0)).when(F.isnan(v), F.lit(NAN_BUCKET))
        .when(size == float("inf"), F.signum(v) * INFINITE_BUCKET).otherwise(F.signum(v) * octaves)
    ).cast("int")


def exact_medians(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """``(field_path, median)`` of the columns that hold a value, by selection.

    Four rounds count values in buckets that follow their order and go on with
    the bucket that holds the middle rank: sixteenths of octaves, then twice
    65,536 equal slots between the bucket's extrema, then single values, of
    which a slot's slot cannot hold more than some 93,000. State is bounded
    whatever the data, and counting is a map-side combined aggregate. Two rows
    a column go from one round to the next, so they are broadcast.
    """
    values = df.select(
        F.inline(F.array(*[F.struct(F.lit(c).alias("field_path"), F.col(c).cast("double").alias("v")) for c in columns]))
    ).where(F.col("v").isNotNull())
    counted = [F.count("*").alias("n"), F.min("v").alias("low"), F.max("v").alias("high")]

    def holding_the_rank(buckets: DataFrame) -> DataFrame:
        smaller = Window.partitionBy("field_path", "target").orderBy("bucket").rowsBetween(
            Window.unboundedPreceding, -1
        )
        return (
            buckets.withColumn("rank", F.col("rank") - F.coalesce(F.sum("n").over(smaller), F.lit(0)))
            .where((F.col("rank") >= 0) & (F.col("rank") < F.col("n")))
            .select(F.col("field_path").alias("_column"), "target", "rank", "low", "high")
        )

    first = values.groupBy("field_path", _bucket(F.col("v")).alias("bucket")).agg(*counted)
    middle = F.expr("array_distinct(array((total - 1) div 2, total div 2))")
    first = first.withColumn("total", F.sum("n").over(Window.partitionBy("field_path")))
    found = holding_the_rank(first.withColumn("target", F.explode(middle)).withColumn("rank", F.col("target")))
    width = F.col("high") - F.col("low")
    slot = F.when(width > 0, F.floor((F.col("v") - F.col("low")) / width * (SLOTS - 1))).otherwise(0)
    for bucket in (slot, slot, F.col("v")):
        inside = (F.col("field_path") == F.col("_column")) & F.col("v").between(F.col("low"), F.col("high"))
        rows = values.join(F.broadcast(found), inside).groupBy("field_path", "target", "rank", bucket.alias("bucket"))
        found = holding_the_rank(rows.agg(*counted))
    low, high = F.min("low"), F.max("low")
    return found.groupBy(F.col("_column").alias("field_path")).agg(
        F.when(low == high, low).otherwise(low * 0.5 + high * 0.5).alias("median")
    )


def unit_profile(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Unit measures per column. Verdicts rest on ``median_above_*``, the median is evidence."""
    return fused_profile(df, {UNIT: columns}).join(
        exact_medians(df, columns), "field_path", "left"
    )


def null_share(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Share of NULLs per column."""
    return fused_profile(df, {NULLS: columns})


def bounds_profile(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Extrema per column."""
    return fused_profile(df, {BOUNDS: columns})


# --- distinct values ---------------------------------------------------------


# How values of a column are compared with a stated list.
AS_TEXT, AS_NUMBER, AS_DOUBLE, AS_FLOAT = "text", "number", "double", "float"


def _compared_as(df: DataFrame, column: str) -> str:
    kind = df.schema[column].dataType.simpleString()
    if kind in (AS_DOUBLE, AS_FLOAT):
        return kind
    return AS_NUMBER if kind in NUMERIC_TYPES or kind.startswith("decimal") else AS_TEXT


def _plain_number(text: Column) -> Column:
    """A decimal number without sign of zero, leading zeros or zeros after its last decimal.

    ``1e7`` is written out where a decimal of 38 digits holds it; other text stays as it is.
    """
    scientific = text.rlike(r"^[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)[eE][+-]?[0-9]{1,2}$")
    long = F.when(scientific, text.try_cast("decimal(38,18)"))
    exact = long.cast("double") == text.try_cast("double")
    digits = F.when(exact, long.cast("string")).otherwise(text)
    whole = F.regexp_extract(digits, r"^[+-]?0*([0-9]*)", 1)
    fraction = F.regexp_extract(digits, r"\.([0-9]*?)0*$", 1)
    size = F.concat(
        F.when(whole == "", "0").otherwise(whole), F.when(fraction == "", "").otherwise(F.concat(F.lit("."), fraction))
    )
    signed = F.when(digits.startswith("-") & (size != "0"), F.concat(F.lit("-"), size)).otherwise(size)
    return F.when(digits.rlike(r"^[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)$"), signed).otherwise(digits)


def _shown(df: DataFrame, column: str) -> Column:
    """A value as text, a number without needless zeros."""
    text = F.col(column).cast("string")
    kind = df.schema[column].dataType.simpleString()
    return _plain_number(text) if kind in (AS_DOUBLE, AS_FLOAT) or kind.startswith("decimal") else text


def _value_key(value: Column, compared_as: str) -> Column:
    """What equal values have in common: for numbers not their spelling, but the number."""
    if compared_as == AS_TEXT:
        return value.cast("string")
    if compared_as == AS_NUMBER:
        return _plain_number(value.cast("string"))
    return (value.try_cast(compared_as) + F.lit(0).cast(compared_as)).cast("string")


def distinct_values(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """``(field_path, compared_as, value_key, value, n)``: every distinct value with its rows, NULLs left out.

    ``value`` is its text; ``value_key`` is equal for equal values, so 1.0 and
    1.00, or 0.0 and -0.0, are one value. All columns in one scan: equal
    (column, value) pairs are counted in a map-side hash aggregate, so a real
    enumeration shuffles a handful of rows per task, and a column of unique
    values is spread by value over all tasks.
    """
    shown = []
    for c in columns:
        kind, text = _compared_as(df, c), _shown(df, c)
        value_key = _value_key(F.col(c), kind) if kind in (AS_DOUBLE, AS_FLOAT) else text
        shown.append(F.struct(
            F.lit(c).alias("field_path"), F.lit(kind).alias("compared_as"), value_key.alias("value_key"),
            text.alias("value"),
        ))
    return (
        df.select(F.inline(F.array(*shown)))
        .where(F.col("value").isNotNull())
        .groupBy("field_path", "compared_as", "value_key", "value")
        .agg(F.count("*").alias("n"))
    )


def _list_key() -> Column:
    """A digest that stands for the stated list, so that no row has to carry the list itself."""
    return F.sha2(F.to_json("predicate.values"), 256).alias("_list")


def _against_lists(claims: DataFrame, values: DataFrame) -> DataFrame:
    """``(table_name, field_path, _list, value, n, listed)``: each value of a claimed column, per list.

    An entry of a list is read in the way its column is compared: as text, or as a number of its type.

    Claims that state the same list of the same column share one ``_list``.
    """
    stated = claims.select(
        "table_name", "field_path", _list_key(),
        F.col("predicate.values").alias("_values"),
    ).dropDuplicates(["table_name", "field_path", "_list"])
    entry = F.col("_entry")
    ways = [
        F.struct(F.lit(kind).alias("compared_as"), _value_key(entry, kind).alias("value_key"))
        for kind in (AS_TEXT, AS_NUMBER, AS_DOUBLE, AS_FLOAT)
    ]
    entries = (
        stated.select("table_name", "field_path", "_list", F.explode("_values").alias("_entry"))
        .select("table_name", "field_path", "_list", F.inline(F.array(*ways)))
        .where(F.col("value_key").isNotNull())
        .distinct()
        .withColumn("listed", F.lit(True))
    )
    return values.join(stated.drop("_values"), ["table_name", "field_path"]).join(
        entries, ["table_name", "field_path", "_list", "compared_as", "value_key"], "left"
    )


def enum_profile(claims: DataFrame, values: DataFrame) -> DataFrame:
    """Claims with ``row_count, distinct_count, unexpected_count, first_unexpected``.

    ``claims`` needs ``table_name, field_path, predicate``; ``values`` is
    ``table_name`` with what ``distinct_values`` gives of the claimed columns. Only counts and one value leave the comparison, whatever the
    number of distinct values; all unexpected ones are :func:`unexpected_values`.
    A claim on a column without values keeps zero counts.
    """
    unlisted = F.col("listed").isNull()
    found = _against_lists(claims, values).groupBy("table_name", "field_path", "_list").agg(
        F.sum("n").alias("row_count"),
        F.count("*").alias("distinct_count"),
        F.count_if(unlisted).alias("unexpected_count"),
        F.min(F.when(unlisted, F.col("value"))).alias("first_unexpected"),
    )
    counts = ["row_count", "distinct_count", "unexpected_count"]
    return (
        claims.withColumn("_list", _list_key())
        .join(found, ["table_name", "field_path", "_list"], "left")
        .withColumns({c: F.coalesce(c, F.lit(0).cast("bigint")) for c in counts})
        .drop("_list")
    )


def unexpected_values(claims: DataFrame, values: DataFrame) -> DataFrame:
    """``(table_name, field_path, list_sha256, value, n)``: all values outside a stated list."""
    return _against_lists(claims, values).where(F.col("listed").isNull()).select(
        "table_name", "field_path", F.col("_list").alias("list_sha256"), "value", "n"
    )


# --- freshness ---------------------------------------------------------------


def freshness_profile(df: DataFrame, as_of: str) -> DataFrame:
    """The newest DATE or TIMESTAMP value of the table against ``as_of``, one row."""
    return fused_profile(df, {FRESH: ()}, as_of).select(
        "probe_kind", "latest_value", "latest_column", "temporal_column_count", "days_stale",
        "as_of", "rows_scanned", "probe_error",
    )


# --- usage -------------------------------------------------------------------


def usage_window(query_log: DataFrame, assets: DataFrame, as_of: str) -> DataFrame:
    """Reads of each asset in the 30 days up to and including ``as_of``.

    A log row counts under the bare or the full table name. The log is
    reduced to one row per (name, user) before it meets the assets, so a
    hot table costs no more than its users. Silent assets keep a zero row.
    """
    day = F.lit(as_of).cast("date")
    start = F.date_sub(day, USAGE_WINDOW_DAYS - 1)
    log = query_log.select("table_name", F.col("queried_at").alias("at"), "query_user").where(
        (F.col("at") >= start.cast("timestamp_ntz"))
        & (F.col("at") < F.date_add(day, 1).cast("timestamp_ntz"))
    )
    live = log.agg(F.count("*").alias("live")).scalar()
    per_user = log.groupBy("table_name", "query_user").agg(F.count("*").alias("reads"))
    watched = assets.select("asset_urn").distinct()
    names = watched.select(
        "asset_urn",
        F.explode(
            F.array_distinct(
                F.array(
                    urns.table_name(F.col("asset_urn")), urns.dataset_name(F.col("asset_urn"))
                )
            )
        ).alias("table_name"),
    )
    # inner first: either side may then be broadcast, or split where a name is hot
    used = (
        per_user.join(names, "table_name")
        .groupBy("asset_urn", "query_user")
        .agg(F.sum("reads").alias("reads"))
        .groupBy("asset_urn")
        .agg(F.sum("reads").alias("_reads"), F.count("query_user").alias("_users"))
    )
    per_asset = watched.join(used, "asset_urn", "left").withColumns({
        "recent_queries": F.coalesce("_reads", F.lit(0)),
        "distinct_users": F.coalesce("_users", F.lit(0)),
    })
    return per_asset.select(
        "asset_urn",
        F.lit(USAGE).alias("probe_kind"),
        "recent_queries",
        "distinct_users",
        live.alias("window_rows_any_table"),
        F.lit(as_of).alias("as_of"),
    )


# --- reconciliation ----------------------------------------------------------


def _product(left: str, right: str) -> Column:
    """Two row counts multiplied; for a hot key that exceeds a BIGINT."""
    return F.col(left).cast("decimal(19,0)") * F.col(right).cast("decimal(19,0)")


SIDE_SCHEMA = "side string, k string, v double"


def side_rows(df: DataFrame, sides: Mapping[str, tuple[str, str]]) -> DataFrame:
    """``(side, k, v)``: key and value of several column pairs of a table, in one scan.

    ``sides`` maps a name to its key and value column. Keys are compared as
    text, numbers as they are written without needless zeros, so 1 and 1.0 match.
    """
    return df.select(F.inline(F.array(*[
        F.struct(F.lit(name).alias("side"), _shown(df, k).alias("k"), F.col(v).cast("double").alias("v"))
        for name, (k, v) in sides.items()
    ])))


def ratio_measures(rows: DataFrame, uses: DataFrame) -> DataFrame:
    """For each reference: does its suspect side sit at 100 times its reference side, key by key?

    ``rows`` is ``(side, k, v)``; ``uses`` is ``(ref, side, is_left)``, two rows
    for each ``ref``. The measures are those of the inner join on the key, but
    the join's pairs are never produced, so a key with many rows on both sides
    does no harm:

    * joined rows are the sum over keys of the product of the two row counts;
    * pairs at the right ratio are found by an equi-join on (key, slot), where
      slots cut log(value) so finely that partners lie in the same slot or in
      the next.

    ``rows`` is read once and merged to (side, key, value, count) in one
    shuffle; totals and both sides of the slots read what that wrote. For that
    they must not differ below it, so rows are chosen and join keys made by
    way of the counts, which no filter can reach through the aggregate.
    """
    merged = rows.groupBy("side", "k", "v").agg(F.count("*").alias("n")).join(uses, "side")
    keyed, nothing = F.col("k").isNotNull(), F.lit(0).cast("bigint")
    left, right = F.when(F.col("is_left"), F.col("n")), F.when(~F.col("is_left"), F.col("n"))
    per_key = merged.groupBy("ref", "k").agg(
        F.coalesce(F.sum(F.when(F.col("v").isNotNull(), left)), nothing).alias("ls"),
        F.coalesce(F.sum(right), nothing).alias("rs"),
    )
    totals = per_key.groupBy("ref").agg(
        F.coalesce(F.sum(F.when(keyed, _product("ls", "rs"))), nothing).alias("joined"),
        F.count_if(keyed & (F.col("ls") > 0) & (F.col("rs") > 0)).alias("recon_matched_keys"),
        F.count_if(keyed & (F.col("ls") > 0)).alias("recon_suspect_keys"),
        F.sum("ls").alias("recon_suspect_rows"),
        F.sum("rs").alias("recon_reference_rows"),
    )

    # |v / r - 100| <= t means ln(v / 100) and ln(r) differ by t / 100 at most
    # (plus rounding); a slot is twice that margin wide on each side.
    margin = 2.0 * RATIO_TOLERANCE / RATIO_TARGET
    slot_width = 4.0 * margin
    finite = (F.abs("v") > 0) & (F.abs("v") < float("inf"))

    def _placed(count: Column, scale: float) -> DataFrame:
        usable = F.when(finite & keyed, count) > 0
        keys = {"k": F.col("k"), "sign": F.signum("v"), "at": F.log(F.abs("v") / F.lit(scale))}
        return merged.where(usable).select(
            "ref", *[F.when(usable, key).alias(name) for name, key in keys.items()], "v", "n"
        )

    left_slots = _placed(left, RATIO_TARGET).withColumn("slot", F.floor(F.col("at") / slot_width)).drop("at")
    both = [F.floor((F.col("at") + shift) / slot_width) for shift in (-margin, margin)]
    right_slots = _placed(right, 1.0).select(
        "ref", "k", "sign", F.explode(F.array_distinct(F.array(*both))).alias("slot"),
        F.col("v").alias("r"), F.col("n").alias("m"),
    )
    near = F.abs(F.col("v") / F.col("r") - RATIO_TARGET) <= RATIO_TOLERANCE
    partners = left_slots.join(right_slots, ["ref", "k", "sign", "slot"]).groupBy("ref").agg(
        F.sum(F.when(near, _product("n", "m"))).alias("at_ratio")
    )
    share = F.coalesce("at_ratio", nothing).cast("double") / F.col("joined").cast("double")
    return (
        uses.select("ref").distinct().join(totals, "ref", "left").join(partners, "ref", "left")
        .select(
            "ref",
            F.coalesce("joined", nothing).alias("recon_joined"),
            F.coalesce("recon_matched_keys", nothing).alias("recon_matched_keys"),
            F.when(F.col("joined") > 0, share).alias("recon_ratio_share"),
            *[F.coalesce(c, nothing).alias(c)
              for c in ("recon_suspect_keys", "recon_suspect_rows", "recon_reference_rows")],
        )
    )


def reconcile_100x(
    suspect: DataFrame,
    reference: DataFrame,
    suspect_key: str,
    reference_key: str,
    column: str,
    reference_column: str,
) -> DataFrame:
    """The measures of one reference, one row; each table is read once."""
    rows = side_rows(suspect, {"suspect": (suspect_key, column)}).unionByName(
        side_rows(reference, {"reference": (reference_key, reference_column)})
    )
    uses = small_frame(
        suspect.sparkSession, "ref:int,side:string",
        [{"ref": 0, "side": "suspect"}, {"ref": 0, "side": "reference"}],
    ).withColumn("is_left", F.col("side") == "suspect")
    return ratio_measures(rows, uses).drop("ref")
