"""What a later consumer of the catalog sees, with and without the ledger."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from claimcheck.functions import texts
from claimcheck.functions.numbering import numbered
from claimcheck.operators.claims import prompt_key
from claimcheck.vocabulary import CONTRADICTED

# What hides run dates, and the fence around catalog text.
ISO_DATE = r"\b\d{4}-\d{2}-\d{2}\b"
DATE_MASK = "<run-date>"
FENCE_OPEN, FENCE_CLOSE = "BEGIN CATALOG DATA", "END CATALOG DATA"
DEFUSED = "[defused-marker]"
LEDGER_LINE = "ledger verdict: "
# Sections of a context, in reading order; the ledger starts at LEDGER_SECTION.
TABLE_SECTION, COLUMN_SECTION, LEDGER_SECTION, CORRECTION_SECTION, DOSSIER_SECTION = range(5)


def mask_dates(text: Column) -> Column:
    return F.regexp_replace(text, ISO_DATE, DATE_MASK)


# Fixed pattern: the lines of a dossier body that make up its evidence line.
_DOSSIER_PART = r"(?m)^(?:field|verdict|rationale): .+$"


def _first_value(parts: Column, name: str) -> Column:
    """The value of the first part of that name; NULL when absent or blank.

    Claims and replaced texts stand below, so no line of theirs is taken for it.
    """
    first = F.try_element_at(F.filter(parts, lambda p: p.startswith(f"{name}: ")), F.lit(1))
    return F.regexp_extract(first, r"^\w+:\s+(\S.*?)\s*$", 1)


def dossier_lines(pointers: DataFrame, documents: DataFrame) -> DataFrame:
    """One line per document the ledger names: field, verdict and rationale together.

    ``fault`` tells why a line cannot be used: the document is absent, or it
    lacks a part. Each body is searched once where it is stored; only the
    line takes part in the join.
    """
    parts = F.regexp_extract_all("body", F.lit(_DOSSIER_PART), F.lit(0))
    parsed = (
        documents.select("document_urn", parts.alias("_parts"))
        .select(
            "document_urn",
            *[_first_value(F.col("_parts"), name).alias(name)
              for name in ("field", "verdict", "rationale")],
        )
        .select(
            "document_urn",
            F.lit(True).alias("_found"),
            F.when(
                (F.col("field") != "") & (F.col("verdict") != "") & (F.col("rationale") != ""),
                F.concat(
                    F.lit("field="), "field", F.lit("; verdict="), "verdict",
                    F.lit("; rationale="), "rationale",
                ),
            ).alias("line"),
        )
    )
    named = pointers.select("asset_urn", "document_urn").distinct()
    fault = F.when(F.col("_found").isNull(), "absent").when(F.col("line").isNull(), "incomplete")
    return named.join(parsed, "document_urn", "left").select(
        "asset_urn", "document_urn", "line", fault.alias("fault")
    )


def unanswerable_assets(ledger: DataFrame, lines: DataFrame) -> DataFrame:
    """Assets nobody should answer about: a ledger verdict without whole evidence."""
    evidence = lines.groupBy("asset_urn").agg(
        F.count("*").alias("_named"), F.count_if(F.col("fault").isNotNull()).alias("_faults")
    )
    return (
        ledger.select("asset_urn").distinct()
        .join(evidence, "asset_urn", "left")
        .select(
            "asset_urn",
            F.when(F.coalesce("_named", F.lit(0)) == 0, "no evidence")
            .when(F.col("_faults") > 0, "evidence not whole")
            .alias("reason"),
        )
        .where(F.col("reason").isNotNull())
    )


def context_lines(
    descriptions: DataFrame, verdicts: DataFrame, corrections: DataFrame, lines: DataFrame
) -> DataFrame:
    """``(asset_urn, section, key, source, line)``: every context line, dates masked.

    Section and key give the reading order, ``source`` tells equal lines
    apart. Nothing is gathered here, so this is the form to use where an
    asset may be huge.
    """
    empty = F.lit("")
    assets = descriptions.select("asset_urn").distinct()
    table_text = descriptions.where(F.col("field_path").isNull()).select(
        "asset_urn", "description"
    )
    sections = [
        assets.join(table_text, "asset_urn", "left").select(
            "asset_urn", F.lit(TABLE_SECTION).alias("section"), empty.alias("key"),
            empty.alias("source"),
            F.concat(
                F.lit("table description: "), F.coalesce(F.trim("description"), empty)
            ).alias("line"),
        ),
        descriptions.where(F.col("field_path").isNotNull()).select(
            "asset_urn", F.lit(COLUMN_SECTION).alias("section"), F.col("field_path").alias("key"),
            empty.alias("source"),
            F.concat(F.lit("column "), "field_path", F.lit(": "), "description").alias("line"),
        ),
        verdicts.select(
            "asset_urn", F.lit(LEDGER_SECTION).alias("section"), empty.alias("key"),
            empty.alias("source"),
            F.concat(F.lit(LEDGER_LINE), "verdict").alias("line"),
        ),
        corrections.select(
            "asset_urn", F.lit(CORRECTION_SECTION).alias("section"),
            F.coalesce("field_path", empty).alias("key"), empty.alias("source"),
            F.concat(
                F.lit("corrected description ("), texts.field_label(F.col("field_path")),
                F.lit("): "), "description",
            ).alias("line"),
        ),
        lines.where(F.col("fault").isNull()).select(
            "asset_urn", F.lit(DOSSIER_SECTION).alias("section"), F.col("line").alias("key"),
            F.col("document_urn").alias("source"),
            F.concat(F.lit("evidence: "), "line").alias("line"),
        ),
    ]
    out = sections[0]
    for section in sections[1:]:
        out = out.unionByName(section)
    return out.withColumn("line", mask_dates(F.col("line")))


_READING_ORDER = ("section", "key", "line", "source")


def asset_context(lines: DataFrame) -> DataFrame:
    """``(asset_urn, line_no, line)``: the context lines in reading order."""
    return numbered(lines, ["asset_urn"], _READING_ORDER).select("asset_urn", "line_no", "line")


def context_before_after(lines: DataFrame) -> DataFrame:
    """``(asset_urn, line_no, before, after)``: the context without and with what the ledger added.

    What the ledger added stands below everything else, so the lines of both
    views have the same numbers; ``before`` of an added line is NULL.
    """
    added = F.col("section") >= LEDGER_SECTION
    return numbered(lines, ["asset_urn"], _READING_ORDER).select(
        "asset_urn", "line_no", F.when(~added, F.col("line")).alias("before"), F.col("line").alias("after")
    )


def _defused(data: Column) -> Column:
    for marker in (FENCE_CLOSE, FENCE_OPEN):
        data = F.replace(data, F.lit(marker), F.lit(DEFUSED))
    return data


def reader_prompts(contexts: DataFrame, instructions: str, question: Column) -> DataFrame:
    """Adds ``prompt``: instructions, fenced context and question.

    ``question`` is an expression over ``contexts``. Fence markers in the data are defused.
    """
    return contexts.withColumn(
        "prompt",
        F.concat(
            F.lit(f"{instructions}\n\n{FENCE_OPEN}\n"), _defused(F.col("context")),
            F.lit(f"\n{FENCE_CLOSE}\n\n"), question,
        ),
    )


def prompt_lines(context: DataFrame, instructions: str, question: Column) -> DataFrame:
    """``(asset_urn, part, line_no, line)``: a prompt as rows, for a context of any size.

    ``part`` 0 is what stands before the lines of ``asset_context``, 1 those
    lines, 2 what stands after them; ``question`` is an expression over
    ``asset_urn``. Joined by line ends in this order they are the prompt.
    """
    assets = context.select("asset_urn").distinct()

    def frame(part: int, line: Column) -> DataFrame:
        return assets.select(
            "asset_urn", F.lit(part).alias("part"), F.lit(0).cast("bigint").alias("line_no"), line.alias("line")
        )

    data = context.select("asset_urn", F.lit(1).alias("part"), "line_no", _defused(F.col("line")).alias("line"))
    return (
        frame(0, F.lit(f"{instructions}\n\n{FENCE_OPEN}")).unionByName(data)
        .unionByName(frame(2, F.concat(F.lit(f"{FENCE_CLOSE}\n\n"), question)))
    )


def _line_keys(text: Column) -> Column:
    """One row per line of a text: its digest, without the word that marks evidence in a context."""
    def key(line: Column) -> Column:
        return F.sha2(F.regexp_replace(line, "^evidence: ", ""), 256)

    return F.explode(F.transform(F.split(text, "\n", -1), key))


def bind_reader_answers(
    answers: DataFrame, required_lines: DataFrame, system_prompt: str, question: Column
) -> DataFrame:
    """``(asset_urn, before, after, fault)``: the two stored answers of each asset.

    ``answers`` is ``(asset_urn, prompt_key, user_prompt, completion)``. An
    answer counts only under the key of its own prompt, for its asset's
    ``question`` (an expression over ``answers``), and with exactly one answer per view. The prompt of the view
    with the ledger must contain every current evidence line of
    ``required_lines`` ``(asset_urn, line)`` as whole lines, else it is stale.
    Prompts are taken apart where they are stored; only digests of lines meet.
    """
    user = F.col("user_prompt")
    view = F.when(F.contains(user, F.lit(LEDGER_LINE)), "after").otherwise("before")
    checked = answers.select(
        "asset_urn",
        "user_prompt",
        F.trim("completion").alias("answer"),
        view.alias("view"),
        F.when(prompt_key(F.lit(system_prompt), user) != F.col("prompt_key"), "key mismatch")
        .when(~F.contains(user, question), "other question")
        .alias("bad"),
    )
    seen = (
        checked.where(F.col("view") == "after")
        .select("asset_urn", _line_keys(user).alias("_line"))
        .distinct()
    )
    answered = checked.where(F.col("view") == "after").select("asset_urn").distinct()
    stale = (
        required_lines.select("asset_urn", _line_keys(mask_dates(F.col("line"))).alias("_line"))
        .distinct()
        .join(answered, "asset_urn", "left_semi")
        .join(seen, ["asset_urn", "_line"], "left_anti")
        .select("asset_urn", F.lit(True).alias("stale"))
        .distinct()
    )
    is_before, is_after = F.col("view") == "before", F.col("view") == "after"
    per_asset = checked.groupBy("asset_urn").agg(
        F.max("bad").alias("bad"),
        F.count_if(is_before).alias("n_before"),
        F.count_if(is_after).alias("n_after"),
        F.max(F.when(is_before, F.col("answer"))).alias("before"),
        F.max(F.when(is_after, F.col("answer"))).alias("after"),
    )
    fault = (
        F.when(F.col("bad").isNotNull(), F.col("bad"))
        .when((F.col("n_before") > 1) | (F.col("n_after") > 1), "duplicate answer")
        .when((F.col("n_before") < 1) | (F.col("n_after") < 1), "missing answer")
        .when(F.coalesce("stale", F.lit(False)), "stale evidence")
    )
    return (
        per_asset.join(stale, "asset_urn", "left")
        .withColumn("fault", fault)
        .select(
            "asset_urn",
            F.when(F.col("fault").isNull(), F.col("before")).alias("before"),
            F.when(F.col("fault").isNull(), F.col("after")).alias("after"),
            "fault",
        )
    )


def evidence_lines(findings: DataFrame) -> DataFrame:
    """The lines a current reader prompt must contain: one per contradicted finding."""
    return findings.where(F.col("verdict") == CONTRADICTED).select(
        "asset_urn",
        F.concat(
            F.lit("field="), texts.field_label(F.col("field_path")),
            F.lit("; verdict="), "verdict", F.lit("; rationale="), "rationale",
        ).alias("line"),
    )


def asset_report(
    findings: DataFrame, descriptions: DataFrame, corrections: DataFrame, documents: DataFrame
) -> DataFrame:
    """``(asset_urn, line_no, finding)``: all findings as JSON, sorted by field.

    Each has the description before and after and the dossier.
    """
    claim_keys = ["asset_urn", "field_path", "pos"]

    def _attach(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
        renamed = right.select(
            *[F.col(k).alias(f"_{k}") for k in keys],
            *[c for c in right.columns if c not in keys],
        )
        same: Column = F.lit(True)
        for k in keys:
            same = same & F.col(k).eqNullSafe(F.col(f"_{k}"))
        return left.join(renamed, same, "left").drop(*[f"_{k}" for k in keys])

    rows = _attach(
        findings, descriptions.select("asset_urn", "field_path", F.col("description").alias("before")),
        ["asset_urn", "field_path"],
    )
    rows = _attach(
        rows, corrections.select(*claim_keys, F.col("description").alias("after")), claim_keys
    )
    rows = _attach(rows, documents.select(*claim_keys, F.col("body").alias("dossier")), claim_keys)
    line = F.to_json(
        F.struct(
            texts.field_label(F.col("field_path")).alias("field"),
            F.col("text").alias("claim_text"), "verdict", "rationale", "before", "after", "dossier",
        )
    )
    return numbered(
        rows.select(*claim_keys, line.alias("finding")), ["asset_urn"], ["field_path", "pos", "finding"]
    ).select("asset_urn", "line_no", "finding")
