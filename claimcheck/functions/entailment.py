"""Does the claimed sentence really state the claimed predicate?

Each function returns a BOOLEAN column. ``text`` is the claimed sentence.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, functions as F

# Fixed word lists and patterns: what counts as stating a predicate.
UNIT_WORDINGS = {
    "percent_0_100": ("percent", "%"),
    "major_currency_units": ("major currency units",),
}
ZERO_TO_HUNDRED = r"(?i)\b0\s*(?:and|to|-)\s*100\b"
NEVER_NULL_WORDINGS = ("never null", "not null", "non-null", "always populated", "required")
NEVER_NULL_NEGATIONS = (r"\b(?:not|never)\s+required\b", r"\bnot\s+always populated\b")
MIN_ZERO_WORDINGS = ("non-negative", "nonnegative", "never negative", ">= 0")
DEPRECATION_WORDINGS = (
    "deprecat", "sunset", "obsolete", "retired", "superseded", "no longer used", "do not use",
)
DEPRECATION_NEGATION = (
    r"\b(?:not|never|no longer)\s+(?:deprecat\w*|sunset\w*|obsolete|retired|superseded)\b"
)
CLOSED_SET_WORDINGS = ("one of", "must be", "allowed values", "exactly", "{")


def _mentions(text: Column, wordings: Iterable[str]) -> Column:
    return F.exists(F.array(*[F.lit(w) for w in wordings]), lambda w: F.contains(text, w))


def _yes(condition: Column) -> Column:
    return F.coalesce(condition, F.lit(False))


def _whole_token(low_text: Column, token: Column, word_chars: str) -> Column:
    """``token`` occurs and is not a piece of a longer run of ``word_chars``."""
    quoted = F.concat(F.lit("\\Q"), F.replace(token, F.lit("\\E"), F.lit("\\E\\\\E\\Q")), F.lit("\\E"))
    return F.rlike(
        low_text, F.concat(F.lit(f"(?<!{word_chars})"), quoted, F.lit(f"(?!{word_chars})"))
    )


def grounded(text: Column, description: Column) -> Column:
    """The sentence is not blank and occurs word for word in the description."""
    return _yes(text.rlike(r"\S") & F.contains(description, text))


def unit_stated(text: Column, unit: Column) -> Column:
    upper = F.upper(text)
    stated = F.contains(upper, F.upper(unit))
    for name, wordings in UNIT_WORDINGS.items():
        by_wording = _mentions(upper, [w.upper() for w in wordings])
        if name == "percent_0_100":
            by_wording = by_wording & text.rlike(ZERO_TO_HUNDRED)
        stated = F.when(F.lower(unit) == name, by_wording).otherwise(stated)
    return _yes(unit.isNotNull() & stated)


def cadence_stated(text: Column, cadence: Column) -> Column:
    return _yes(F.contains(F.lower(text), F.lower(cadence)))


def never_null_stated(text: Column, nullable: Column) -> Column:
    """Only ``nullable = false`` has to be backed by wording."""
    affirmed = F.lower(text)
    for negation in NEVER_NULL_NEGATIONS:
        affirmed = F.regexp_replace(affirmed, negation, " ")
    return _yes(nullable.isNotNull() & (nullable | _mentions(affirmed, NEVER_NULL_WORDINGS)))


def enum_stated(text: Column, values: Column) -> Column:
    """Closed-set wording, and every value stands in the text as a whole token."""
    low = F.lower(text)
    return _yes(
        (F.size(values) > 0)
        & F.forall(values, lambda v: v.isNotNull())
        & _mentions(low, CLOSED_SET_WORDINGS)
        & F.forall(values, lambda v: _whole_token(low, F.lower(v), "[a-z0-9]"))
    )


def _number_token(bound: Column) -> Column:
    whole = bound == F.floor(bound)
    return F.when(whole, F.floor(bound).cast("string")).otherwise(bound.cast("string"))


def bounds_stated(text: Column, low_bound: Column, high_bound: Column) -> Column:
    """Every given bound is a whole number token of the text; at least one is given."""
    low = F.lower(text)
    min_ok = _whole_token(low, _number_token(low_bound), "[0-9.]") | (
        (low_bound == 0) & _mentions(low, MIN_ZERO_WORDINGS)
    )
    max_ok = _whole_token(low, _number_token(high_bound), "[0-9.]")
    given = low_bound.isNotNull() | high_bound.isNotNull()
    return _yes(
        given & (low_bound.isNull() | min_ok) & (high_bound.isNull() | max_ok)
    )


def deprecation_stated(text: Column, deprecated: Column) -> Column:
    """Only ``deprecated = true`` has to be backed by wording."""
    affirmed = F.regexp_replace(F.lower(text), DEPRECATION_NEGATION, " ")
    return _yes(
        deprecated.isNotNull() & (~deprecated | _mentions(affirmed, DEPRECATION_WORDINGS))
    )
