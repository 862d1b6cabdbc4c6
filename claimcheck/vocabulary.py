"""Fixed values shared by the operators."""

from __future__ import annotations

CONFIRMED = "CONFIRMED"
CONTRADICTED = "CONTRADICTED"
UNVERIFIABLE = "UNVERIFIABLE"
MIXED = "MIXED"

# The claim types, in the order the score table prints them.
UNIT_SCALE = "unit_scale"
FRESHNESS = "freshness"
COMPLETENESS = "completeness"
DOMAIN_ENUM = "domain_enum"
DEPRECATION_USAGE = "deprecation_usage"
CLAIM_TYPES = (UNIT_SCALE, FRESHNESS, COMPLETENESS, DOMAIN_ENUM, DEPRECATION_USAGE)

# Thresholds the verdicts depend on.
CENTS_MEDIAN_FLOOR = 1000
DOLLAR_FRACTION_FLOOR = 0.3
DOLLAR_MEDIAN_CEILING = 1000
RECONCILED_KEYS_FLOOR = 100
RATIO_TARGET = 100.0
RATIO_TOLERANCE = 1e-6
NULL_SHARE_FLOOR = 0.01
NEVER_NULL_MIN_ROWS = 100
RECENT_QUERIES_FLOOR = 10
USAGE_WINDOW_DAYS = 30
HIGH_USAGE_FLOOR = 30
# cadence -> (days at which it is still met, days at which it is broken);
# a date anchor can never prove an hourly cadence, hence no first value there
CADENCE_DAYS = {"hourly": (None, 2), "daily": (1, 7), "weekly": (7, 21)}

TABLE_LABEL = "(table)"
# Who signs corrections, dossiers and incidents. Rollback only ever touches
# texts carrying this name, so runs under another name keep apart.
AUTHOR = "claimcheck"

# The typed payload of a claim.
PREDICATE_TYPE = (
    "struct<unit:string,cadence:string,nullable:boolean,values:array<string>,"
    "min:double,max:double,deprecated:boolean>"
)
CLAIM_SCHEMA = (
    "asset_urn string, field_path string, pos int, claim_type string, text string, "
    f"predicate {PREDICATE_TYPE}"
)
