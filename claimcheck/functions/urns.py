"""Asset identifiers ``urn:li:dataset:(urn:li:dataPlatform:P,db.table,ENV)`` taken apart.

A string of any other shape is treated as a plain dotted name.
"""

from __future__ import annotations

from pyspark.sql import Column, functions as F

# Fixed patterns of the identifier format.
NAME_IN_URN = r",([^,]+),[A-Z]+\)$"
WHOLE_URN = r"^urn:li:dataset:\(urn:li:dataPlatform:([^,]+),([^,]+),([A-Z]+)\)$"
IDENTIFIER = r"^[A-Za-z_][A-Za-z0-9_]*\z"


def _group_or_null(text: Column, pattern: str, group: int) -> Column:
    return F.when(text.rlike(pattern), F.regexp_extract(text, pattern, group))


def is_urn(urn: Column) -> Column:
    return F.coalesce(urn.rlike(WHOLE_URN), F.lit(False))


def platform(urn: Column) -> Column:
    return _group_or_null(urn, WHOLE_URN, 1)


def environment(urn: Column) -> Column:
    return _group_or_null(urn, WHOLE_URN, 3)


def dataset_name(urn: Column) -> Column:
    """The full dotted name."""
    return F.coalesce(_group_or_null(urn, NAME_IN_URN, 1), urn)


def table_name(urn: Column) -> Column:
    """The last dotted part of the name."""
    return F.element_at(F.split(dataset_name(urn), r"\."), -1)


def is_identifier(name: Column) -> Column:
    return F.coalesce(name.rlike(IDENTIFIER), F.lit(False))


def is_dotted_identifier(name: Column) -> Column:
    return F.coalesce(
        F.forall(F.split(name, r"\.", -1), lambda part: part.rlike(IDENTIFIER)), F.lit(False)
    )


def dotted_label(urn: Column) -> Column:
    """The name incidents carry: what stands between the last two commas."""
    parts = F.split(urn, ",", -1)
    return F.when(F.size(parts) >= 3, F.element_at(parts, -2)).otherwise(urn)


def short_label(urn: Column) -> Column:
    """The name dossiers carry: the last dotted part before the last comma."""
    parts = F.split(urn, ",", -1)
    before_last_comma = F.try_element_at(parts, F.lit(-2))
    return F.when(
        F.size(parts) >= 2, F.element_at(F.split(before_last_comma, r"\.", -1), -1)
    ).otherwise(urn)


def sibling_urn(urn: Column, name: Column) -> Column:
    """The asset another table name stands for, seen from ``urn``.

    A dotted name is taken as it is; a bare one gets the dotted prefix of
    ``urn``'s own name, if it has one.
    """
    own = _group_or_null(urn, WHOLE_URN, 2)
    prefix = _group_or_null(own, r"^(.*)\.[^.]*$", 1)
    full = F.when(name.contains(".") | prefix.isNull(), name).otherwise(
        F.concat(prefix, F.lit("."), name)
    )
    return F.concat(
        F.lit("urn:li:dataset:(urn:li:dataPlatform:"), platform(urn), F.lit(","), full,
        F.lit(","), environment(urn), F.lit(")"),
    )
