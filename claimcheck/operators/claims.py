"""From stored completions to typed claims.

The language model itself is outside: its answers come as a table
``(prompt_key, user_prompt, completion)``. Every gate is row-local, so the
whole chain costs one join on the prompt key.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from claimcheck.functions import entailment
from claimcheck.vocabulary import (
    CLAIM_TYPES, COMPLETENESS, DEPRECATION_USAGE, DOMAIN_ENUM, FRESHNESS, UNIT_SCALE,
)

UNKNOWN_PROMPT = "unknown prompt"
PROMPT_MISMATCH = "stored prompt differs from the requested one"
NOT_JSON = "completion is not valid JSON"
NOT_AN_ARRAY = "completion is not a JSON array"
NOT_AN_OBJECT = "completion element is not an object"
BAD_CLAIM_TYPE = "completion element has no valid claim_type"

# How many hex digits of the digest make the key, the separator
# inside it, and the code fence around a completion.
KEY_DIGITS = 24
KEY_SEPARATOR = "\x00"
FENCE = r"(?s)```(?:json)?\s*(.*?)```"


def prompt_key(system_prompt: Column, user_prompt: Column) -> Column:
    digest = F.sha2(F.concat(system_prompt, F.lit(KEY_SEPARATOR), user_prompt), 256)
    return F.substring(digest, 1, KEY_DIGITS)


def prompt_keys(descriptions: DataFrame, system_prompt: str) -> DataFrame:
    """Adds ``user_prompt`` (a fixed format) and ``prompt_key``."""
    target = F.coalesce(
        F.concat(F.lit("column `"), F.nullif("field_path", F.lit("")), F.lit("`")),
        F.lit("the table itself"),
    )
    user = F.concat(
        F.lit("Asset: "), "asset_urn", F.lit("\nTarget: "), target,
        F.lit("\nDescription: "), "description",
    )
    return descriptions.withColumn("user_prompt", user).withColumn(
        "prompt_key", prompt_key(F.lit(system_prompt), F.col("user_prompt"))
    )


def replay_completions(prompts: DataFrame, store: DataFrame) -> DataFrame:
    """Adds ``completion`` or, when none can be trusted, ``extraction_error``.

    Requested and stored prompt are compared by their SHA-256, so that the
    join does not have to move the stored prompts, nor the requested ones
    where nothing after it asks for them.
    """
    stored = store.select(
        "prompt_key",
        F.sha2("user_prompt", 256).alias("_stored_digest"),
        F.col("completion").alias("_stored"),
        F.lit(True).alias("_hit"),
    )
    error = F.when(F.col("_hit").isNull(), UNKNOWN_PROMPT).when(
        ~F.col("_stored_digest").eqNullSafe(F.col("_digest")), PROMPT_MISMATCH
    )
    return (
        prompts.withColumn("_digest", F.sha2("user_prompt", 256))
        .join(stored, "prompt_key", "left")
        .withColumn("extraction_error", error)
        .withColumn("completion", F.when(F.col("extraction_error").isNull(), F.col("_stored")))
        .drop("_digest", "_stored_digest", "_stored", "_hit")
    )


def missing_completions(prompts: DataFrame, store: DataFrame, blocked: DataFrame) -> DataFrame:
    """Entries without a stored completion that are not declared as blocked."""
    return prompts.join(store.select("prompt_key"), "prompt_key", "left_anti").join(
        blocked.select("prompt_key"), "prompt_key", "left_anti"
    )


def unexpected_failures(replayed: DataFrame, blocked: DataFrame) -> DataFrame:
    """Entries whose extraction failed although they are not declared as blocked."""
    return replayed.where(F.col("extraction_error").isNotNull()).join(
        blocked.select("prompt_key"), "prompt_key", "left_anti"
    )


def _strip(text: Column) -> Column:
    return F.regexp_replace(text, r"^\s+|\s+\z", "")


def _sub(variant: Column, path: str, kind: str) -> Column:
    return F.try_variant_get(variant, path, kind)


def _shape(variant: Column) -> Column:
    return F.schema_of_variant(variant)


def _number(variant: Column, path: str) -> Column:
    shape = _shape(_sub(variant, path, "variant"))
    return F.when(shape.rlike("^(BIGINT|DECIMAL|DOUBLE|FLOAT)"), _sub(variant, path, "double"))


def _only_if(variant: Column, path: str, shape: str, kind: str) -> Column:
    return F.when(_shape(_sub(variant, path, "variant")) == shape, _sub(variant, path, kind))


def _predicate(element: Column) -> Column:
    """The typed payload; a field of the wrong JSON type stays NULL."""
    raw = _sub(element, "$.predicate.values", "array<variant>")
    scalar_shape = "^(STRING|BIGINT|DECIMAL|DOUBLE|FLOAT|BOOLEAN)"
    values = F.transform(
        raw, lambda v: F.when(_shape(v).rlike(scalar_shape), _sub(v, "$", "string"))
    )
    return F.struct(
        _only_if(element, "$.predicate.unit", "STRING", "string").alias("unit"),
        _only_if(element, "$.predicate.cadence", "STRING", "string").alias("cadence"),
        _only_if(element, "$.predicate.nullable", "BOOLEAN", "boolean").alias("nullable"),
        values.alias("values"),
        _number(element, "$.predicate.min").alias("min"),
        _number(element, "$.predicate.max").alias("max"),
        _only_if(element, "$.predicate.deprecated", "BOOLEAN", "boolean").alias("deprecated"),
    )


def parse_completions(replayed: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``(items, entries)``: typed items, and every entry with its error if any.

    One bad element makes the whole entry an error. The test looks into the
    array in place, so nothing is exploded and grouped back.
    """
    text = _strip(F.col("completion"))
    body = F.when(text.rlike(FENCE), _strip(F.regexp_extract(text, FENCE, 1))).otherwise(text)
    parsed = replayed.withColumn("_doc", F.try_parse_json(body)).withColumn(
        "_elements",
        F.when(_shape(F.col("_doc")).startswith("ARRAY"),
               _sub(F.col("_doc"), "$", "array<variant>")),
    )
    elements = F.col("_elements")

    def _fault(element: Column) -> Column:
        known = _only_if(element, "$.claim_type", "STRING", "string").isin(*CLAIM_TYPES)
        return F.when(~_shape(element).startswith("OBJECT"), NOT_AN_OBJECT).when(
            ~F.coalesce(known, F.lit(False)), BAD_CLAIM_TYPE
        )

    first_fault = F.get(F.filter(F.transform(elements, _fault), lambda e: e.isNotNull()), F.lit(0))
    error = F.coalesce(
        F.col("extraction_error"),
        F.when(F.col("_doc").isNull(), NOT_JSON)
        .when(elements.isNull(), NOT_AN_ARRAY)
        .otherwise(first_fault),
    )
    entries = parsed.withColumn("extraction_error", error)
    items = (
        entries.where(F.col("extraction_error").isNull())
        .select("*", F.posexplode("_elements").alias("pos", "_element"))
        .withColumns({
            "claim_type": _sub(F.col("_element"), "$.claim_type", "string"),
            "text": _only_if(F.col("_element"), "$.text", "STRING", "string"),
            "predicate": _predicate(F.col("_element")),
        })
        .drop("_doc", "_elements", "_element", "completion", "extraction_error")
    )
    return items, entries.drop("_doc", "_elements")


def grounding_gate(items: DataFrame) -> DataFrame:
    """Keeps items whose text occurs word for word in their description."""
    return items.where(entailment.grounded(F.col("text"), F.col("description")))


def _stated(claim_type: str) -> Column:
    text = F.col("text")
    if claim_type == UNIT_SCALE:
        return entailment.unit_stated(text, F.col("predicate.unit"))
    if claim_type == FRESHNESS:
        return entailment.cadence_stated(text, F.col("predicate.cadence"))
    if claim_type == COMPLETENESS:
        return entailment.never_null_stated(text, F.col("predicate.nullable"))
    if claim_type == DEPRECATION_USAGE:
        return entailment.deprecation_stated(text, F.col("predicate.deprecated"))
    low, high = F.col("predicate.min"), F.col("predicate.max")
    scalars = F.coalesce(
        (F.size("predicate.values") > 0)
        & F.forall("predicate.values", lambda v: v.isNotNull()),
        F.lit(False),
    )
    return F.when(scalars, entailment.enum_stated(text, F.col("predicate.values"))).otherwise(
        entailment.bounds_stated(text, low, high)
    )


def _entail(items: DataFrame, claim_type: str) -> DataFrame:
    return items.where((F.col("claim_type") != claim_type) | _stated(claim_type))


def entail_unit(items: DataFrame) -> DataFrame:
    """Drops unit claims whose unit is not stated; other items pass."""
    return _entail(items, UNIT_SCALE)


def entail_cadence(items: DataFrame) -> DataFrame:
    """Drops freshness claims whose cadence is not stated; other items pass."""
    return _entail(items, FRESHNESS)


def entail_never_null(items: DataFrame) -> DataFrame:
    """Drops completeness claims without never-null wording; other items pass."""
    return _entail(items, COMPLETENESS)


def entail_enum(items: DataFrame) -> DataFrame:
    """Drops value-list claims that do not state every value; other items pass."""
    listed = F.coalesce(
        (F.size("predicate.values") > 0)
        & F.forall("predicate.values", lambda v: v.isNotNull()),
        F.lit(False),
    )
    return items.where(
        (F.col("claim_type") != DOMAIN_ENUM) | ~listed | _stated(DOMAIN_ENUM)
    )


def entail_bounds(items: DataFrame) -> DataFrame:
    """Drops bound claims that do not state every bound; value lists and others pass."""
    listed = F.coalesce(
        (F.size("predicate.values") > 0)
        & F.forall("predicate.values", lambda v: v.isNotNull()),
        F.lit(False),
    )
    return items.where((F.col("claim_type") != DOMAIN_ENUM) | listed | _stated(DOMAIN_ENUM))


def entail_deprecated(items: DataFrame) -> DataFrame:
    """Drops deprecation claims without such wording; other items pass."""
    return _entail(items, DEPRECATION_USAGE)


ENTAILMENT_GATES = (
    entail_unit, entail_cadence, entail_never_null, entail_enum, entail_bounds, entail_deprecated,
)


def extract_claims(
    descriptions: DataFrame, store: DataFrame, system_prompt: str
) -> tuple[DataFrame, DataFrame]:
    """``(claims, errors)`` of all described assets at once."""
    replayed = replay_completions(prompt_keys(descriptions, system_prompt), store)
    items, entries = parse_completions(replayed)
    claims = grounding_gate(items)
    for gate in ENTAILMENT_GATES:
        claims = gate(claims)
    errors = entries.where(F.col("extraction_error").isNotNull()).select(
        "asset_urn", "field_path", "prompt_key", "extraction_error"
    )
    return (
        claims.select("asset_urn", "field_path", "pos", "claim_type", "text", "predicate"),
        errors,
    )
