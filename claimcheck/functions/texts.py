"""The texts a run writes, and the patterns that recognise them again.

What a run writes must be recognisable end to end, so that a rollback can tell
it from anything a person added. Both directions are defined here.
"""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from claimcheck.functions import urns
from claimcheck.functions.rubrics import number
from claimcheck.vocabulary import AUTHOR, TABLE_LABEL

# Fixed formats of this library's own texts.
DOSSIER_ID_PREFIX = "urn:li:document:"
LIST_SEPARATOR = "; "
NO_DOSSIERS = "no dossiers"


def field_label(field: Column) -> Column:
    return F.coalesce(F.nullif(field, F.lit("")), F.lit(TABLE_LABEL))


# --- corrections -------------------------------------------------------------


def _correction_head(author: str) -> str:
    return f"[[{author} run "


# Between the markers: the text that was replaced, then what was measured.
_REPLACED, _MEASURED, _END = "; it read]] ", " [[measured]] ", " [[end]]"


def correction(quoted: Column, measured: Column, run_date: str, author: str = AUTHOR) -> Column:
    """The replacement text. It quotes the whole text it replaces."""
    return F.concat(
        F.lit(f"{_correction_head(author)}{run_date}{_REPLACED}"), quoted,
        F.lit(_MEASURED), measured, F.lit(_END),
    )


def measured_summary(median: Column, integer_share: Column, rationale: Column) -> Column:
    figures = F.concat(
        F.lit("median="), number(median), F.lit(" whole="), number(integer_share)
    )
    return F.concat_ws(LIST_SEPARATOR, F.coalesce(figures, F.lit("no figures")),
                       rationale)


def _quote_for_regex(text: str) -> str:
    return "\\Q" + text + "\\E"


def correction_pattern(author: str = AUTHOR) -> str:
    """Exactly one correction, end to end; the greedy group reaches the outer markers."""
    return (
        r"(?s)\A" + _quote_for_regex(_correction_head(author)) + r"\d{4}-\d{2}-\d{2}"
        + _quote_for_regex(_REPLACED) + "(.+)" + _quote_for_regex(_MEASURED) + ".+"
        + _quote_for_regex(_END) + r"\z"
    )


def unwrap_correction(text: Column, author: str = AUTHOR) -> Column:
    """The text one correction replaced, NULL when ``text`` is not exactly one."""
    quoted = F.regexp_extract_all(text, F.lit(correction_pattern(author)), F.lit(1))
    return F.get(quoted, F.lit(0))


def unwrap_all_corrections(text: Column, author: str = AUTHOR) -> Column:
    """The text below any number of stacked corrections, NULL when there is none.

    Each layer carries the head once, so counting heads bounds the depth.
    """
    head = F.lit(_correction_head(author))
    layers = F.floor(
        (F.length(text) - F.length(F.replace(text, head, F.lit("")))) / F.length(head)
    ).cast("int")
    drained = F.aggregate(
        F.sequence(F.lit(1), F.greatest(layers, F.lit(1))),
        F.lit(None).cast("string"),
        lambda found, _: F.coalesce(unwrap_correction(F.coalesce(found, text), author), found),
    )
    return F.when(F.startswith(text, head), drained)


# --- dossiers ----------------------------------------------------------------


def dossier_title_head(author: str = AUTHOR) -> str:
    return f"{author} record "


def dossier_header(author: str = AUTHOR) -> str:
    return f"{author} record, format 1"


def dossier_footer(author: str = AUTHOR) -> str:
    return f"{author} record ends"


def dossier_title(urn: Column, field: Column, run_date: str, author: str = AUTHOR) -> Column:
    return F.concat(
        F.lit(dossier_title_head(author)), urns.short_label(urn), F.lit("."),
        field_label(field), F.lit(f" of {run_date}"),
    )


def dossier_body(
    urn: Column, field: Column, claim_type: Column, claim: Column, verdict: Column,
    rationale: Column, pre_image: Column, measurement: Column, evidence: Column,
    run_date: str, author: str = AUTHOR,
) -> Column:
    """One ``name: value`` line each; the replaced text, which may have lines of its own, comes last."""
    values = {
        "field": field_label(field), "verdict": verdict, "rationale": rationale,
        "run": F.lit(run_date), "asset": urn, "kind": claim_type, "claim": claim,
        "measured": measurement, "figures": evidence,
        "it read": F.coalesce(pre_image, F.lit("")),
    }
    lines = [F.concat(F.lit(f"{name}: "), value) for name, value in values.items()]
    return F.concat(
        F.lit(dossier_header(author) + "\n"),
        *[x for line in lines for x in (line, F.lit("\n"))],
        F.lit(dossier_footer(author)),
    )


# --- incidents ---------------------------------------------------------------


def incident_title(urn: Column, author: str = AUTHOR) -> Column:
    """The same for every run on an asset: it identifies the incident."""
    return F.concat(F.lit(f"{author}: wrong unit or scale on "), urns.dotted_label(urn))
