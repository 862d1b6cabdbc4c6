"""From measurements to a verdict: one CASE expression per claim type.

Every rubric is a list of branches ``(condition, verdict, rule, rationale)``,
conditions and rationales in SQL over the measurement columns. The branches
are tried in order and that order is part of the rules: a verdict other than
UNVERIFIABLE always needs its own positive evidence. Each function returns a
STRUCT column ``(verdict, rule, rationale)``.
"""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from claimcheck.vocabulary import (
    CADENCE_DAYS, CENTS_MEDIAN_FLOOR, COMPLETENESS, CONFIRMED, CONTRADICTED, DEPRECATION_USAGE,
    DOLLAR_FRACTION_FLOOR, DOLLAR_MEDIAN_CEILING, DOMAIN_ENUM, FRESHNESS, NEVER_NULL_MIN_ROWS,
    NULL_SHARE_FLOOR, RECENT_QUERIES_FLOOR, RECONCILED_KEYS_FLOOR, UNIT_SCALE, UNVERIFIABLE,
    USAGE_WINDOW_DAYS,
)

Branch = tuple[str, str, str, str]


def number(value: Column) -> Column:
    """Fixed four decimals, so texts do not depend on how a double prints.

    What no such decimal holds (NaN, infinity, 10^34 and more) is shown as it prints.
    """
    return F.coalesce(value.try_cast("decimal(38,4)").cast("string"), value.cast("string"))


def _number(value: str) -> str:
    return f"coalesce(cast(try_cast({value} as decimal(38,4)) as string), cast({value} as string))"


def _say(template: str, *values: str) -> str:
    return f"format_string({', '.join([repr(template), *values])})"


def _finding(verdict: str, rule: str, rationale: str) -> str:
    return (f"named_struct('verdict', '{verdict}', 'rule', '{rule}', "
            f"'rationale', {rationale})")


def _decide(branches: list[Branch], otherwise: tuple[str, str]) -> str:
    """The first branch whose condition is true; a NULL condition is not."""
    cases = " ".join(
        f"when {condition} then {_finding(verdict, rule, rationale)}"
        for condition, verdict, rule, rationale in branches
    )
    return f"case {cases} else {_finding(UNVERIFIABLE, *otherwise)} end"


_NO_RUBRIC = _finding(
    UNVERIFIABLE, "no rubric", _say("no rule decides a %s claim like this one", "claim_type")
)

_NO_VALUES = ("not coalesce(row_count > 0 and median_above_0 is not null "
              "and integer_share is not null, false)")

# All values whole and the typical one large: looks like integer cents.
_CENTS = f"(integer_share = 1 and median_above_{CENTS_MEDIAN_FLOOR})"
_CORROBORATED = (
    f"(recon_matched_keys >= {RECONCILED_KEYS_FLOOR} and recon_matched_keys = recon_suspect_keys "
    "and recon_suspect_rows = recon_suspect_keys and recon_joined = recon_matched_keys "
    "and recon_ratio_share = 1 and recon_reference_rows > 0)"
)
_MONEY = _decide(
    [
        (_NO_VALUES, UNVERIFIABLE, "no values", "'the column holds no value to measure'"),
        (f"{_CENTS} and recon_joined is null", UNVERIFIABLE, "cents without reference",
         _say("whole numbers with median %s look like cents, but no reference is declared",
              _number("median"))),
        (f"{_CENTS} and {_CORROBORATED}", CONTRADICTED, "cents corroborated",
         _say("stated as %s, yet all values are whole with median %s and every key sits at "
              "100 times its reference", "upper(predicate.unit)", _number("median"))),
        (_CENTS, UNVERIFIABLE, "cents not corroborated",
         _say("whole numbers with median %s look like cents, but the reference does not "
              "bear it out on every key (matched %d of %d, joined %s, at ratio %s)",
              _number("median"), "recon_matched_keys", "recon_suspect_keys",
              "cast(recon_joined as string)", _number("coalesce(recon_ratio_share, 0)"))),
        (f"1 - integer_share >= {DOLLAR_FRACTION_FLOOR} and median_above_0 "
         f"and not median_above_{DOLLAR_MEDIAN_CEILING}", CONFIRMED, "major units",
         _say("fractional values with median %s fit %s (whole-number share %s)",
              _number("median"), "upper(predicate.unit)", _number("integer_share"))),
    ],
    ("neither signature",
     _say("median %s with whole-number share %s fits neither major units nor cents",
          _number("median"), _number("integer_share"))),
)

# Never contradicts: a range of 0 to 1 may be fractions or small percentages.
_PERCENT = _decide(
    [
        (_NO_VALUES, UNVERIFIABLE, "no values", "'the column holds no value to measure'"),
        ("centi_integer_share is null", UNVERIFIABLE, "no rubric",
         "'the measurement lacks the share of hundredths'"),
        ("min_value >= 0 and max_value <= 1", UNVERIFIABLE, "scale ambiguous",
         _say("values from %s to %s may be fractions or small percentages",
              _number("min_value"), _number("max_value"))),
        ("min_value >= 0 and median_above_1 and max_value <= 100", CONFIRMED, "percent scale",
         _say("values use the 0 to 100 scale: median %s, maximum %s",
              _number("median"), _number("max_value"))),
    ],
    ("not the percent scale",
     _say("median %s in the range %s to %s is not clearly a percentage",
          _number("median"), _number("min_value"), _number("max_value"))),
)

_UNIT = (
    "case upper(coalesce(predicate.unit, '')) "
    f"when 'PERCENT_0_100' then {_PERCENT} when 'USD' then {_MONEY} "
    f"when 'MAJOR_CURRENCY_UNITS' then {_MONEY} else {_NO_RUBRIC} end"
)

_NEVER_NULL = (
    "case when predicate.nullable = false then "
    + _decide(
        [
            ("not coalesce(row_count > 0, false) or null_share is null", UNVERIFIABLE, "no rows",
             "'the table holds no row to measure'"),
            (f"null_share >= {NULL_SHARE_FLOOR}", CONTRADICTED, "nulls found",
             _say("stated as never null, but the share of nulls is %s in %d rows",
                  _number("null_share"), "row_count")),
            (f"null_share = 0 and row_count >= {NEVER_NULL_MIN_ROWS}", CONFIRMED, "no nulls",
             _say("no null in all %d rows", "row_count")),
        ],
        ("trace of nulls or few rows",
         _say("a null share of %s in %d rows settles nothing", _number("null_share"),
              "row_count")),
    )
    + f" else {_NO_RUBRIC} end"
)

_ENUM = _decide(
    [
        ("size(predicate.values) <= 0", UNVERIFIABLE, "no rubric", "'the claim lists no value'"),
        ("unexpected_count > 0", CONTRADICTED, "unexpected values",
         _say("%d of %d distinct values are not in the stated list, the first is %s",
              "unexpected_count", "distinct_count", "first_unexpected")),
        ("distinct_count > 0", CONFIRMED, "within the list",
         _say("all %d distinct values of %d rows are in the stated list", "distinct_count",
              "row_count")),
    ],
    ("no values", "'the column holds no value to measure'"),
)

_BELOW = "coalesce(min_value < predicate.min, false)"
_ABOVE = "coalesce(max_value > predicate.max, false)"
_BOUNDS = _decide(
    [
        ("not coalesce(row_count > 0, false) or min_value is null or max_value is null",
         UNVERIFIABLE, "no values", "'the column holds no value to measure'"),
        (f"{_BELOW} or {_ABOVE}", CONTRADICTED, "bound violated",
         "concat_ws('; ', "
         f"case when {_BELOW} then "
         + _say("minimum %s is below the stated %s", _number("min_value"),
                _number("predicate.min"))
         + f" end, case when {_ABOVE} then "
         + _say("maximum %s is above the stated %s", _number("max_value"),
                _number("predicate.max"))
         + " end)"),
        ("true", CONFIRMED, "within bounds",
         _say("all %d values lie from %s to %s", "row_count", _number("min_value"),
              _number("max_value"))),
    ],
    ("no rubric", "''"),
)

_DOMAIN = (
    f"case when predicate.values is not null and distinct_count is not null then {_ENUM} "
    f"when predicate.min is not null or predicate.max is not null then {_BOUNDS} "
    f"else {_NO_RUBRIC} end"
)

_WINDOW = f"the {USAGE_WINDOW_DAYS} days to %s"
_DEPRECATED = (
    "case when coalesce(predicate.deprecated, false) and recent_queries is not null then "
    + _decide(
        [
            (f"recent_queries >= {RECENT_QUERIES_FLOOR}", CONTRADICTED, "still read",
             _say(f"stated as no longer used, but read %d times by %d users in {_WINDOW}",
                  "recent_queries", "distinct_users", "as_of")),
            ("recent_queries = 0 and not coalesce(window_rows_any_table > 0, false)", UNVERIFIABLE,
             "dead log", _say(f"the log shows no read of any table in {_WINDOW}", "as_of")),
            ("recent_queries = 0", CONFIRMED, "silent",
             _say(f"no read in {_WINDOW} over the whole log", "as_of")),
        ],
        ("few reads",
         _say(f"%d reads in {_WINDOW} are neither silence nor use", "recent_queries", "as_of")),
    )
    + f" else {_NO_RUBRIC} end"
)


def _by_cadence(position: int) -> str:
    days = {name: bands[position] for name, bands in CADENCE_DAYS.items()}
    cases = " ".join(
        f"when '{name}' then {n}" for name, n in days.items() if n is not None
    )
    return f"(case lower(predicate.cadence) {cases} end)"


_MET_DAYS, _BROKEN_DAYS = _by_cadence(0), _by_cadence(1)
_FRESHNESS = (
    f"case when {_BROKEN_DAYS} is not null and days_stale is not null then "
    + _decide(
        [
            (f"days_stale >= {_BROKEN_DAYS}", CONTRADICTED, "stale",
             _say("stated as %s, but the newest value (%s in %s) is %d days old on %s",
                  "lower(predicate.cadence)", "latest_value", "latest_column", "days_stale",
                  "as_of")),
            (f"{_MET_DAYS} is null", UNVERIFIABLE, "finer than a day",
             _say("dates cannot prove the %s cadence", "lower(predicate.cadence)")),
            ("not coalesce(temporal_column_count = 1, false)", UNVERIFIABLE,
             "several date columns",
             _say("any of %d date columns could be the refresh marker", "temporal_column_count")),
            (f"days_stale between 0 and {_MET_DAYS}", CONFIRMED, "fresh",
             _say("the newest value is %d days old on %s, as %s allows", "days_stale", "as_of",
                  "lower(predicate.cadence)")),
        ],
        ("between the bands",
         _say("%d days is neither fresh nor stale for the %s cadence", "days_stale",
              "lower(predicate.cadence)")),
    )
    + f" else {_NO_RUBRIC} end"
)

# Dispatch on the claim type; a probe error decides nothing.
_VERDICT = (
    "case when probe_error is not null then "
    + _finding(UNVERIFIABLE, "probe error", "concat('could not be measured: ', probe_error)")
    + f" when claim_type = '{UNIT_SCALE}' then {_UNIT}"
    + f" when claim_type = '{COMPLETENESS}' then {_NEVER_NULL}"
    + f" when claim_type = '{FRESHNESS}' then {_FRESHNESS}"
    + f" when claim_type = '{DOMAIN_ENUM}' then {_DOMAIN}"
    + f" when claim_type = '{DEPRECATION_USAGE}' then {_DEPRECATED}"
    + f" else {_NO_RUBRIC} end"
)


def money_verdict() -> Column:
    return F.expr(_MONEY)


def percent_verdict() -> Column:
    return F.expr(_PERCENT)


def never_null_verdict() -> Column:
    return F.expr(_NEVER_NULL)


def enum_verdict() -> Column:
    return F.expr(_ENUM)


def bounds_verdict() -> Column:
    return F.expr(_BOUNDS)


def deprecated_verdict() -> Column:
    return F.expr(_DEPRECATED)


def freshness_verdict() -> Column:
    return F.expr(_FRESHNESS)


def verdict() -> Column:
    return F.expr(_VERDICT)
