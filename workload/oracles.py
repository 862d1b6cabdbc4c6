"""DuckDB SQL for the result each query must give.

Written from the semantics, not from the DataFrame code: joins where the
operators count, pairs where they multiply, gathered lists where they split.
"""

from __future__ import annotations

from workload.inputs import ANSWER_PROMPT, READER_INSTRUCTIONS, SYSTEM_PROMPT, TABLES, duckdb_sql

ORACLES: dict[str, str] = {}
RUN_DATE = "2024-01-30"


def _add(name: str, body: str, *ctes: tuple[str, str]) -> None:
    ORACLES[name] = duckdb_sql(body, *ctes)


# --- A: catalog ---------------------------------------------------------------

_add("effective_descriptions", """
select * from (select coalesce(i.asset_urn, e.asset_urn) as asset_urn,
    coalesce(i.field_path, e.field_path) as field_path,
    coalesce(nullif(e.description, ''), nullif(i.description, '')) as description
  from ingested i full join edited e
    on i.asset_urn = e.asset_urn and i.field_path is not distinct from e.field_path)
where description is not null""")

_WHOLE_URN = r"'^urn:li:dataset:\(urn:li:dataPlatform:([^,]+),([^,]+),([A-Z]+)\)$'"
_NAME = r"""case when regexp_matches({0}, ',([^,]+),[A-Z]+\)$')
    then regexp_extract({0}, ',([^,]+),[A-Z]+\)$', 1) else {0} end"""
_IDENTIFIER = "'^[A-Za-z_][A-Za-z0-9_]*$'"

_add("asset_parts", f"""
select asset_urn, p_partkey,
  case when regexp_matches(asset_urn, {_WHOLE_URN})
    then regexp_extract(asset_urn, {_WHOLE_URN}, 1) end as platform,
  dataset_name, string_split(dataset_name, '.')[-1] as table_name,
  case when regexp_matches(asset_urn, {_WHOLE_URN})
    then regexp_extract(asset_urn, {_WHOLE_URN}, 3) end as env,
  regexp_matches(string_split(dataset_name, '.')[-1], {_IDENTIFIER}) as safe_table,
  len(list_filter(string_split(dataset_name, '.'),
    lambda x: not regexp_matches(x, {_IDENTIFIER}))) = 0 as safe_dataset,
  case when len(parts) >= 2 then string_split(parts[-2], '.')[-1] else asset_urn end
    as short_label,
  case when len(parts) >= 3 then parts[-2] else asset_urn end as dotted_label
from (select *, {_NAME.format('asset_urn')} as dataset_name,
        string_split(asset_urn, ',') as parts from assets)""")

_TABLE_LIST = ", ".join(f"'{t}'" for t in TABLES)
_SCHEMA = f"""select table_name, column_name, data_type, ordinal_position
    from information_schema.columns where table_name in ({_TABLE_LIST})"""
_LAST_NAME = "string_split(" + _NAME.format("asset_urn") + ", '.')[-1]"

_add("asset_binding", """
select asset_urn, table_name, described_fields, unknown_fields,
  has_table and unknown_fields = 0 as bound,
  case when not has_table then 'no such table' when unknown_fields > 0 then 'unknown fields'
    when described_fields = 0 then 'table existence' else 'described fields' end as basis
from (select asset_urn, table_name, count(field_path) as described_fields,
    count(case when field_path is not null and (table_name, field_path) not in
      (select (table_name, column_name) from known) then 1 end) as unknown_fields,
    table_name in (select table_name from known) as has_table
  from (select asset_urn, field_path, """ + _LAST_NAME + """ as table_name
        from described_columns) group by all)""",
     ("known", f"select table_name, column_name from ({_SCHEMA}) "
               "union select table_name, column_name from customer_columns"))

_add("merge_upstreams", """
select downstream, upstream,
  row_number() over (partition by downstream order by first_seen, upstream) - 1 as line_no
from (select downstream, upstream, min(origin * 1000 + position) as first_seen
  from (select 0 as origin, * from existing_edges union all
        select 1 as origin, * from declared_edges) group by all)""")

_add("lineage_gate", f"""
select asset_urn, reference_table, reference_urn, detail not like 'refused%' as ok, detail
from (select *, case when reference_urn is null then 'refused: asset urn cannot be parsed'
    when reference_urn = asset_urn then 'refused: the asset cannot be its own reference'
    when not exists (select 1 from recorded_lineage l where l.downstream = d.asset_urn
      and l.upstream = d.reference_urn) then 'refused: ' || reference_table
        || ' is not a recorded upstream of the asset'
    else 'recorded upstream: ' || reference_urn end as detail
  from (select asset_urn, reference_table, case when regexp_matches(asset_urn, {_WHOLE_URN}) then
      'urn:li:dataset:(urn:li:dataPlatform:' || regexp_extract(asset_urn, {_WHOLE_URN}, 1) || ','
      || case when contains(reference_table, '.') then reference_table
           when contains(regexp_extract(asset_urn, {_WHOLE_URN}, 2), '.') then
             regexp_replace(regexp_extract(asset_urn, {_WHOLE_URN}, 2), '[^.]*$', '')
             || reference_table else reference_table end
      || ',' || regexp_extract(asset_urn, {_WHOLE_URN}, 3) || ')' end as reference_urn
    from declarations) d)""")

_add("catalog_columns", f"""
select asset_urn, ordinal_position as ordinal, column_name,
  case data_type when 'INTEGER' then 'int' else lower(data_type) end as type, description
from (select distinct asset_urn, {_LAST_NAME} as table_name from described_columns)
join ({_SCHEMA}) using (table_name)
left join (select asset_urn, field_path as column_name, cast(count(*) as varchar) as description
  from described_columns where field_path is not null group by all)
  using (asset_urn, column_name)""")

# --- B: claims ----------------------------------------------------------------

_PROMPTS = ("prompts", f"""select *,
    left(sha256('{SYSTEM_PROMPT}' || chr(0) || user_prompt), 24) as prompt_key
  from (select *, 'Asset: ' || asset_urn || chr(10) || 'Target: '
    || case when field_path is null then 'the table itself'
         else 'column `' || field_path || '`' end
    || chr(10) || 'Description: ' || description as user_prompt from described)""")
_STORE = ("store", """select prompt_key, case when wrapping = 8 then user_prompt || '!'
    else user_prompt end as user_prompt, completion
  from prompts join answers using (doc_id)""")
_BLOCKED = ("blocked", """select prompt_key from prompts
  where doc_id in (select doc_id from documents where lang = 'de')""")
_REPLAYED = ("replayed", """select p.*, case when s.user_prompt = p.user_prompt then completion end
    as completion, case when s.prompt_key is null then 'unknown prompt'
      when s.user_prompt <> p.user_prompt
        then 'stored prompt differs from the requested one' end as replay_error
  from prompts p left join store s on p.prompt_key = s.prompt_key""")
_BODIES = ("bodies", r"""select *, trim(case when regexp_matches(completion, '```')
    then regexp_extract(completion, '(?s)```(?:json)?\s*(.*?)```', 1) else completion end,
    ' ' || chr(10)) as body from replayed""")
_ENTRIES = ("entries", """select * exclude (elements), elements, case
    when replay_error is not null then replay_error
    when not json_valid(body) then 'completion is not valid JSON'
    when elements is null then 'completion is not a JSON array'
    else list_filter(list_transform(elements, lambda e: case
        when json_type(e) <> 'OBJECT' then 'completion element is not an object'
        when coalesce(e->>'$.claim_type', '') not in ('unit_scale', 'freshness', 'completeness',
          'domain_enum', 'deprecation_usage')
          then 'completion element has no valid claim_type' end),
      lambda f: f is not null)[1] end as extraction_error
  from (select *, case when json_valid(body) then case when json_type(body) = 'ARRAY'
      then json_extract(body, '$[*]') end end as elements from bodies)""")
_ITEMS = ("items", """select asset_urn, field_path, doc_id, description, cast(pos as int) as pos,
    e->>'$.claim_type' as claim_type, e->>'$.text' as text,
    case when json_type(e, '$.predicate.unit') = 'VARCHAR' then e->>'$.predicate.unit' end as unit,
    case when json_type(e, '$.predicate.cadence') = 'VARCHAR' then e->>'$.predicate.cadence' end
      as cadence,
    case when json_type(e, '$.predicate.nullable') = 'BOOLEAN'
      then e->>'$.predicate.nullable' = 'true' end as nullable,
    case when json_type(e, '$.predicate.values') = 'ARRAY' then
      list_transform(json_extract(e, '$.predicate.values[*]'), lambda v: v->>'$') end as vals,
    case when json_type(e, '$.predicate.min') in ('BIGINT', 'UBIGINT', 'DOUBLE')
      then cast(e->>'$.predicate.min' as double) end as min_bound,
    case when json_type(e, '$.predicate.max') in ('BIGINT', 'UBIGINT', 'DOUBLE')
      then cast(e->>'$.predicate.max' as double) end as max_bound,
    case when json_type(e, '$.predicate.deprecated') = 'BOOLEAN'
      then e->>'$.predicate.deprecated' = 'true' end as deprecated
  from (select *, unnest(elements) as e, unnest(range(len(elements))) as pos
        from entries where extraction_error is null)""")
_PARSED = (_PROMPTS, _STORE, _REPLAYED, _BODIES, _ENTRIES, _ITEMS)
_SHOWN = """asset_urn, field_path, pos, claim_type, text, unit, cadence, nullable,
  array_to_string(vals, '|') as values_text, min_bound, max_bound, deprecated"""

_add("prompt_keys", "select doc_id, user_prompt, prompt_key from prompts", _PROMPTS)
_add("replay_completions", """select doc_id, prompt_key, completion,
  replay_error as extraction_error from replayed""", _PROMPTS, _STORE, _REPLAYED)
_add("missing_completions", """
select doc_id, 'missing' as kind from prompts where prompt_key not in
  (select prompt_key from store) and prompt_key not in (select prompt_key from blocked)
union all select doc_id, 'failed' as kind from replayed where replay_error is not null
  and prompt_key not in (select prompt_key from blocked)""",
     _PROMPTS, _STORE, _BLOCKED, _REPLAYED)
_add("parse_completions", f"""
select doc_id, {_SHOWN.replace('asset_urn, field_path, ', '')}, null as extraction_error from items
union all select doc_id, null, null, null, null, null, null, null, null, null, null,
  extraction_error from entries where extraction_error is not null""", *_PARSED)

_GROUNDED = "regexp_matches(text, '[^ ]') and contains(description, text)"
_UNIT_OK = r"""(unit is not null and case lower(unit)
  when 'percent_0_100' then (contains(lower(text), 'percent') or contains(text, '%'))
    and regexp_matches(text, '(?i)\b0\s*(and|to|-)\s*100\b')
  when 'major_currency_units' then contains(lower(text), 'major currency units')
  else contains(upper(text), upper(unit)) end)"""
_CADENCE_OK = "coalesce(contains(lower(text), lower(cadence)), false)"
_NULL_OK = r"""(nullable is not null and (nullable or regexp_matches(
  regexp_replace(regexp_replace(lower(text), '\b(not|never)\s+required\b', ' ', 'g'),
    '\bnot\s+always populated\b', ' ', 'g'),
  'never null|not null|non-null|always populated|required')))"""
_LISTED = "(vals is not null and len(vals) > 0 and len(vals) = len(list_filter(vals, lambda v: v is not null)))"
_ENUM_OK = """(regexp_matches(lower(text), 'one of|must be|allowed values|exactly|[{]')
  and len(list_filter(vals, lambda v: not regexp_matches(lower(text),
    '(^|[^a-z0-9])' || regexp_escape(lower(v)) || '($|[^a-z0-9])'))) = 0)"""
_NUMBER = "regexp_matches(lower(text), '(^|[^0-9.])' || regexp_escape(case when {0} = floor({0}) then cast(cast({0} as bigint) as varchar) else cast({0} as varchar) end) || '($|[^0-9.])')"
_BOUNDS_OK = f"""((min_bound is not null or max_bound is not null)
  and (min_bound is null or {_NUMBER.format('min_bound')} or (min_bound = 0
    and regexp_matches(lower(text), 'non-negative|nonnegative|never negative|>= 0')))
  and (max_bound is null or {_NUMBER.format('max_bound')}))"""
_DEPRECATED_OK = r"""(deprecated is not null and (not deprecated or regexp_matches(regexp_replace(
  lower(text), '\b(not|never|no longer)\s+(deprecat\w*|sunset\w*|obsolete|retired|superseded)\b',
  ' ', 'g'),
  'deprecat|sunset|obsolete|retired|superseded|no longer used|do not use')))"""
_GATES = {
    "entail_unit": f"(claim_type <> 'unit_scale' or {_UNIT_OK})",
    "entail_cadence": f"(claim_type <> 'freshness' or {_CADENCE_OK})",
    "entail_never_null": f"(claim_type <> 'completeness' or {_NULL_OK})",
    "entail_enum": f"(claim_type <> 'domain_enum' or not {_LISTED} or {_ENUM_OK})",
    "entail_bounds": f"(claim_type <> 'domain_enum' or {_LISTED} or {_BOUNDS_OK})",
    "entail_deprecated": f"(claim_type <> 'deprecation_usage' or {_DEPRECATED_OK})",
}
_add("grounding_gate", f"select {_SHOWN} from items where {_GROUNDED}", *_PARSED)
for _name, _gate in _GATES.items():
    _add(_name, f"select {_SHOWN} from items where {_gate}", *_PARSED)
_add("extract_claims", f"""
select {_SHOWN} from items where {_GROUNDED} and {' and '.join(_GATES.values())}
union all select asset_urn, field_path, null, 'error', extraction_error, null, null, null, null,
  null, null, null from entries where extraction_error is not null""", *_PARSED)

# --- C: probes ----------------------------------------------------------------

_add("bounded_scan", " union all ".join(
    f"select '{t}' as table_name, count(*) as rows_scanned from {t}" for t in TABLES))

_POSITION = "median(v) > 0 as median_above_0, median(v) > 1 as median_above_1, " \
            "median(v) > 1000 as median_above_1000"


def _unit(table: str, column: str) -> str:
    return f"""select '{table}' as table_name, '{column}' as field_path,
      count(*) as rows_scanned, count(v) as row_count, round(median(v), 6) as median,
      round(avg(case when v = floor(v) then 1.0 when v is not null then 0.0 end), 6)
        as integer_share,
      round(avg(case when v * 100 = floor(v * 100) then 1.0 when v is not null then 0.0 end), 6)
        as centi_integer_share,
      round(min(v), 6) as min_value, round(max(v), 6) as max_value, {_POSITION}
      from (select cast({column} as double) as v from {table})"""


_UNITS = [("lineitem", "l_quantity"), ("lineitem", "l_extendedprice"), ("lineitem", "l_discount"),
          ("lineitem", "l_tax"), ("orders", "o_totalprice"), ("part", "p_retailprice"),
          ("part", "p_size"), ("events", "value"), ("customer", "c_acctbal")]
_add("unit_profile", " union all ".join(_unit(*u) for u in _UNITS))


def _reconcile(run: str, suspect: str, reference: str, key: str, reference_key: str,
               column: str, reference_column: str) -> str:
    return f"""select '{run}' as run, recon_joined, recon_matched_keys, recon_ratio_share,
      recon_suspect_keys, recon_suspect_rows, recon_reference_rows from
      (select count(*) as recon_joined, count(distinct s.k) as recon_matched_keys,
        round(avg(case when r.v is null or r.v = 0 then 0.0
          when abs(s.v / r.v - 100.0) <= 1e-6 then 1.0 else 0.0 end), 6) as recon_ratio_share
      from (select {key} as k, cast({column} as double) as v from {suspect}) s
      join (select {reference_key} as k, cast({reference_column} as double) as v
            from {reference}) r on s.k = r.k where s.v is not null),
      (select count(distinct {key}) as recon_suspect_keys, count(*) as recon_suspect_rows
       from {suspect} where {column} is not null),
      (select count(*) as recon_reference_rows from {reference})"""


_add("reconcile_100x", "select * replace (cast(recon_joined as varchar) as recon_joined) from ("
     + " union all ".join([
    _reconcile("cents", "orders_cents", "orders", "o_orderkey", "o_orderkey", "amount",
               "o_totalprice"),
    _reconcile("itself", "orders_cents", "orders_cents", "o_orderkey", "o_orderkey", "amount",
               "amount"),
    _reconcile("other key", "orders_cents", "orders", "o_custkey", "o_custkey", "amount",
               "o_totalprice"),
    _reconcile("few keys", "lineitem_hundred", "lineitem", "l_suppkey", "l_suppkey",
               "hundredfold", "l_quantity"),
    _reconcile("parts", "lineitem_hundred", "part", "l_partkey", "p_partkey", "hundredfold",
               "p_size"),
]) + ")")

_NULLS = [("orders", "o_orderkey"), ("orders", "o_orderdate"), ("documents", "text"),
          ("documents", "lang"), ("labelled_documents", "quality"),
          ("labelled_documents", "toxic"), ("labelled_documents", "lang")]
_add("null_share", " union all ".join(
    f"select '{t}' as table_name, '{c}' as field_path, count(*) as row_count, "
    f"round(avg(case when {c} is null then 1.0 else 0.0 end), 6) as null_share from {t}"
    for t, c in _NULLS))

_ENUMS = [("orders", "o_orderstatus"), ("orders", "o_orderpriority"), ("orders", "o_custkey"),
          ("lineitem", "l_returnflag"), ("lineitem", "l_linestatus"), ("lineitem", "l_linenumber"),
          ("documents", "lang"), ("documents", "source"), ("part", "p_type"), ("part", "p_brand"),
          ("part", "p_name"), ("customer", "c_name"), ("nation", "n_name")]
_add("distinct_values", " union all ".join(
    f"select '{t}' as table_name, '{c}' as field_path, cast({c} as varchar) as value, "
    f"count(*) as n from {t} where {c} is not null group by {c}"
    for t, c in _ENUMS))

_BOUNDS = [("customer", "c_acctbal"), ("customer", "c_nationkey"), ("part", "p_size"),
           ("lineitem", "l_discount"), ("lineitem", "l_linenumber"), ("labels", "quality"),
           ("labels", "toxic")]
_add("bounds_profile", " union all ".join(
    f"select '{t}' as table_name, '{c}' as field_path, count({c}) as row_count, "
    f"count(*) as rows_scanned, round(cast(min({c}) as double), 6) as min_value, "
    f"round(cast(max({c}) as double), 6) as max_value from {t}" for t, c in _BOUNDS))


def _usage(log: str, assets: str, as_of: str) -> str:
    window = (f"queried_at >= date '{as_of}' - interval 29 day "
              f"and queried_at < date '{as_of}' + interval 1 day")
    return f"""select a.asset_urn, count(r.table_name) as recent_queries,
      count(distinct r.query_user) as distinct_users,
      (select count(*) from {log} where {window}) as window_rows_any_table
    from (select distinct asset_urn, {_NAME.format('asset_urn')} as full_name,
            {_LAST_NAME} as bare_name from {assets}) a
    left join (select * from {log} where {window}) r
      on r.table_name in (a.full_name, a.bare_name) group by a.asset_urn"""


_add("usage_window", _usage("reads", "watched", "2024-01-25"))


def _fresh(table: str, column: str | None) -> str:
    if column is None:
        return f"""select '{table}' as table_name, cast(null as varchar) as latest_value,
          cast(null as varchar) as latest_column, 0 as temporal_column_count,
          cast(null as int) as days_stale, count(*) as rows_scanned,
          'no date or timestamp column in the table' as probe_error from {table}"""
    return f"""select '{table}' as table_name,
      cast(cast(max({column}) as date) as varchar) as latest_value,
      '{column}' as latest_column, 1 as temporal_column_count,
      datediff('day', cast(max({column}) as date), date '2001-08-01') as days_stale,
      count(*) as rows_scanned, cast(null as varchar) as probe_error from {table}"""


_add("freshness_profile", " union all ".join([
    _fresh("orders", "o_orderdate"), _fresh("lineitem", "l_shipdate"), _fresh("events", "ts"),
    _fresh("documents", None)]))

_EMPTY = {c: f"cast(null as double) as {c}" for c in (
    "null_share", "min_value", "max_value", "integer_share", "centi_integer_share")}
_NO_POSITION = ", ".join(f"cast(null as boolean) as median_above_{t}" for t in (0, 1, 1000))
_NOT_FRESH = ("cast(null as varchar) as latest_value, cast(null as varchar) as latest_column, "
              "cast(null as int) as temporal_column_count, cast(null as int) as days_stale")
_add("fused_profile", " union all ".join(
    [f"""select 'unit' as probe_kind, field_path, rows_scanned, row_count,
      {_EMPTY['null_share']}, min_value, max_value, integer_share, centi_integer_share,
      median_above_0, median_above_1, median_above_1000, {_NOT_FRESH}
      from ({_unit('lineitem', c)})"""
     for c in ("l_quantity", "l_extendedprice", "l_discount", "l_tax")]
    + [f"""select 'nulls' as probe_kind, '{c}' as field_path, count(*) as rows_scanned,
      count(*) as row_count,
      round(avg(case when {c} is null then 1.0 else 0.0 end), 6) as null_share,
      {_EMPTY['min_value']}, {_EMPTY['max_value']}, {_EMPTY['integer_share']},
      {_EMPTY['centi_integer_share']}, {_NO_POSITION}, {_NOT_FRESH} from lineitem"""
       for c in ("l_orderkey", "l_shipdate", "l_returnflag", "l_tax")]
    + [f"""select 'bounds' as probe_kind, '{c}' as field_path, count(*) as rows_scanned,
      count({c}) as row_count, {_EMPTY['null_share']},
      round(cast(min({c}) as double), 6) as min_value,
      round(cast(max({c}) as double), 6) as max_value,
      {_EMPTY['integer_share']}, {_EMPTY['centi_integer_share']}, {_NO_POSITION}, {_NOT_FRESH}
      from lineitem"""
       for c in ("l_linenumber", "l_quantity", "l_discount")]
    + [f"""select 'freshness' as probe_kind, cast(null as varchar) as field_path, rows_scanned,
      cast(null as bigint) as row_count, {', '.join(_EMPTY.values())}, {_NO_POSITION},
      latest_value, latest_column, temporal_column_count, days_stale
      from ({_fresh('lineitem', 'l_shipdate')})"""]))

_ROUTED = ("routed", f"""select *, {_LAST_NAME} as table_name, case
    when claim_type = 'unit_scale' and field_path is not null then 'unit'
    when claim_type = 'completeness' and field_path is not null then 'nulls'
    when claim_type = 'domain_enum' and field_path is not null and values_text is not null
      then 'enum'
    when claim_type = 'domain_enum' and field_path is not null
      and (min_bound is not null or max_bound is not null) then 'bounds'
    when claim_type = 'deprecation_usage' and field_path is null and deprecated then 'usage'
    when claim_type = 'freshness' and cadence is not null then 'freshness'
    else 'none' end as probe_kind from claims_flat""")
_add("route_claims", "select asset_urn, field_path, pos, claim_type, probe_kind, table_name "
                     "from routed", _ROUTED)
_add("probe_errors", f"""
select pos, probe_kind, case when probe_kind = 'none' then 'no probe recipe for this claim'
  when not regexp_matches(r.table_name, {_IDENTIFIER}) then 'unsafe table name: ' || r.table_name
  when probe_kind = 'usage' then null
  when probe_kind <> 'freshness' and not regexp_matches(field_path, {_IDENTIFIER})
    then 'unsafe column name: ' || field_path
  when r.table_name not in (select table_name from cols)
    then 'no such table: ' || r.table_name
  when probe_kind <> 'freshness' and data_type is null
    then 'no such column: ' || r.table_name || '.' || field_path
  when probe_kind in ('unit', 'bounds') and data_type not in ('BIGINT', 'INTEGER', 'DOUBLE')
    then 'not a numeric column: ' || r.table_name || '.' || field_path
  when probe_kind = 'freshness' and r.table_name not in
    (select table_name from cols where data_type = 'DATE' or data_type like 'TIMESTAMP%')
    then 'no date or timestamp column in table: ' || r.table_name end as probe_error
from routed r left join cols c on r.table_name = c.table_name and r.field_path = c.column_name""",
     _ROUTED, ("cols", _SCHEMA))

# --- D: verdicts ----------------------------------------------------------------


def _rules(*branches: tuple[str, str, str], default: str) -> str:
    """``verdict`` and ``rule`` columns from branches in order."""
    verdict = " ".join(f"when {cond} then '{v}'" for cond, v, _ in branches)
    rule = " ".join(f"when {cond} then '{r}'" for cond, _, r in branches)
    return (f"case {verdict} else 'UNVERIFIABLE' end as verdict, "
            f"case {rule} else '{default}' end as rule")


_U, _Y, _N = "UNVERIFIABLE", "CONFIRMED", "CONTRADICTED"
_CENTS = "integer_share = 1 and median > 1000"
_MONEY = _rules(
    ("row_count = 0 or median is null or integer_share is null", _U, "no values"),
    (f"{_CENTS} and recon_joined is null", _U, "cents without reference"),
    (f"{_CENTS} and recon_matched_keys >= 100 and recon_matched_keys = recon_suspect_keys "
     "and recon_suspect_rows = recon_suspect_keys and recon_joined = recon_matched_keys "
     "and recon_ratio_share = 1 and recon_reference_rows > 0", _N, "cents corroborated"),
    (_CENTS, _U, "cents not corroborated"),
    ("1 - integer_share >= 0.3 and median > 0 and median <= 1000", _Y, "major units"),
    default="neither signature")
_PERCENT = _rules(
    ("row_count = 0 or median is null or integer_share is null", _U, "no values"),
    ("centi_integer_share is null", _U, "no rubric"),
    ("min_value >= 0 and max_value <= 1", _U, "scale ambiguous"),
    ("min_value >= 0 and median > 1 and max_value <= 100", _Y, "percent scale"),
    default="not the percent scale")
_NEVER_NULL = _rules(
    ("nullable is distinct from false", _U, "no rubric"),
    ("row_count = 0 or null_share is null", _U, "no rows"),
    ("null_share >= 0.01", _N, "nulls found"),
    ("null_share = 0 and row_count >= 100", _Y, "no nulls"),
    default="trace of nulls or few rows")
_ENUM = _rules(
    ("len(claimed) = 0", _U, "no rubric"),
    ("len(list_filter(observed, lambda v: not list_contains(claimed, v))) > 0", _N,
     "unexpected values"),
    ("len(observed) > 0", _Y, "within the list"),
    default="no values")
_BOUND = _rules(
    ("row_count = 0 or min_value is null", _U, "no values"),
    ("coalesce(min_value < min_bound, false) or coalesce(max_value > max_bound, false)", _N,
     "bound violated"),
    ("true", _Y, "within bounds"),
    default="no rubric")
_DEPRECATED = _rules(
    ("deprecated is distinct from true or recent_queries is null", _U, "no rubric"),
    ("recent_queries >= 10", _N, "still read"),
    ("recent_queries = 0 and window_rows_any_table = 0", _U, "dead log"),
    ("recent_queries = 0", _Y, "silent"),
    default="few reads")
_FRESH = _rules(
    ("lower(cadence) not in ('hourly', 'daily', 'weekly') or days_stale is null", _U, "no rubric"),
    ("days_stale >= case lower(cadence) when 'hourly' then 2 when 'daily' then 7 else 21 end", _N,
     "stale"),
    ("lower(cadence) = 'hourly'", _U, "finer than a day"),
    ("temporal_column_count <> 1", _U, "several date columns"),
    ("days_stale between 0 and case lower(cadence) when 'daily' then 1 else 7 end", _Y, "fresh"),
    default="between the bands")

_add("verdict_money", f"select grp, {_MONEY} from money_measures")
_add("verdict_percent", f"select grp, {_PERCENT} from percent_measures")
_add("verdict_never_null", f"select grp, lang, {_NEVER_NULL} from null_measures")
_add("verdict_enum", f"""select grp, {_ENUM} from (select grp,
    case when claimed = '' then cast([] as varchar[]) else string_split(claimed, ',') end as claimed,
    list(v) as observed
  from enum_observed group by grp, claimed)""")
_FOUR = "cast(cast({0} as decimal(38,4)) as varchar)"
_add("verdict_bounds", f"""select grp, {_BOUND}, case
    when coalesce(min_value < min_bound, false) or coalesce(max_value > max_bound, false) then
      concat_ws('; ', case when min_value < min_bound then 'minimum ' || {_FOUR.format('min_value')}
          || ' is below the stated ' || {_FOUR.format('min_bound')} end,
        case when max_value > max_bound then 'maximum ' || {_FOUR.format('max_value')}
          || ' is above the stated ' || {_FOUR.format('max_bound')} end)
    else 'all ' || row_count || ' values lie from ' || {_FOUR.format('min_value')} || ' to '
      || {_FOUR.format('max_value')} end as rationale from bounds_measures""")
_add("verdict_deprecated", f"select grp, {_DEPRECATED} from usage_measures")
_add("verdict_freshness", f"select grp, {_FRESH} from fresh_measures")


def _end_to_end() -> str:
    """Each claim of the claim set: its own measurement, then the rule."""
    from workload.claimset import CLAIMS, DECLARATIONS, urn

    declared = {(d[0], d[1]): d for d in DECLARATIONS}
    time_columns = {"orders": "o_orderdate", "lineitem": "l_shipdate", "events": "ts"}
    errors = {23: "no such table", 24: "no such column", 25: "not numeric"}
    parts = []
    for pos, (table, column, kind, _, predicate) in enumerate(CLAIMS):
        head = (f"select {pos} as pos, '{table}' as table_name, "
                + (f"'{column}' as field_path" if column else "cast(null as varchar) as field_path")
                + f", '{kind}' as claim_type, ")
        whole = "count(*) as rows_scanned"
        unmeasured = (pos in errors or (table, column) == ("documents", "lang") and "min" in predicate
                      or kind == "deprecation_usage" and column
                      or kind == "freshness" and table not in time_columns)
        if unmeasured:
            parts.append(f"{head} 'UNVERIFIABLE' as verdict, 'probe error' as rule")
        elif kind == "unit_scale" and predicate["unit"] == "grams":
            parts.append(f"{head} 'UNVERIFIABLE' as verdict, 'no rubric' as rule from {table} "
                         f"having count({column}) >= 0")
        elif kind == "unit_scale":
            rule = _PERCENT if predicate["unit"].startswith("percent") else _MONEY
            d = declared.get((urn(table), column))
            gated = d is not None and d[2] == "orders"
            recon = (f"select * exclude (run) from ("
                     + _reconcile("x", table, d[2], d[3], d[4], column, d[5]) + ")" if gated else
                     "select cast(null as bigint) as recon_joined, 0 as recon_matched_keys, "
                     "0 as recon_suspect_keys, 0 as recon_suspect_rows, 0 as recon_ratio_share, "
                     "0 as recon_reference_rows")
            parts.append(f"{head} {rule} from (select * "
                         f"exclude (table_name, field_path) from ({_unit(table, column)})), "
                         f"({recon})")
        elif kind == "completeness":
            flag = "true" if predicate["nullable"] else "false"
            parts.append(f"{head} {_NEVER_NULL} from (select {flag} as nullable, {whole}, "
                         f"count(*) as row_count, avg(case when {column} is null then 1.0 "
                         f"else 0.0 end) as null_share from {table})")
        elif kind == "domain_enum" and "values" in predicate:
            parts.append(f"{head} {_ENUM} from (select {predicate['values']} as claimed, {whole}, "
                         f"list(distinct {column}) as observed from {table})")
        elif kind == "domain_enum":
            low, high = predicate.get("min", "null"), predicate.get("max", "null")
            parts.append(f"{head} {_BOUND} from (select {whole}, count({column}) as row_count, "
                         f"min({column}) as min_value, max({column}) as max_value, "
                         f"cast({low} as double) as min_bound, cast({high} as double) as max_bound "
                         f"from {table})")
        elif kind == "freshness":
            parts.append(f"{head} {_FRESH} from (select '{predicate['cadence']}' as cadence, "
                         f"{whole}, 1 as temporal_column_count, datediff('day', "
                         f"cast(max({time_columns[table]}) as date), date '2001-08-01') as "
                         f"days_stale from {table})")
        else:
            parts.append(f"""{head} {_DEPRECATED} from (select true as deprecated,
              count(*) filter (w and table_name in ('{table}', 'shop.{table}')) as recent_queries,
              count(*) filter (w) as window_rows_any_table from (select table_name,
                queried_at >= date '2001-08-01' - interval 29 day
                and queried_at < date '2001-08-01' + interval 1 day as w from reads))""")
    return " union all ".join(parts)


_add("adjudicate", _end_to_end())

# --- E: ledger ------------------------------------------------------------------

_VERDICT_OF = """case when bool_or(verdict = 'CONFIRMED') then
    case when bool_and(verdict = 'CONFIRMED') then 'CONFIRMED' else 'MIXED' end
  when bool_or(verdict = 'CONTRADICTED') then 'CONTRADICTED' else 'UNVERIFIABLE' end"""
_add("asset_verdict", f"select asset_urn, {_VERDICT_OF} as verdict from findings group by all")

_LABEL = "coalesce(field_path, '(table)')"
_add("verdict_summary", f"""
select asset_urn, 0 as line_no, sum(n) || ' claims: '
    || string_agg(n || ' ' || verdict, ', ' order by verdict) as line
from (select asset_urn, verdict, count(*) as n from findings group by all) group by asset_urn
union all select asset_urn, row_number() over (partition by asset_urn order by field_path nulls first, pos),
  'unverifiable ' || {_LABEL} || ': ' || rationale from findings where verdict = 'UNVERIFIABLE'""")

_NOTES = """case claim_type when 'unit_scale' then 'median, shares of whole values and of hundredths,'
    || ' extrema of the column; with a declared reference the ratio to it per key'
  when 'completeness' then 'rows and share of nulls of the column'
  when 'domain_enum' then 'distinct values of the column, or its extrema'
  when 'freshness' then 'newest value of the date and timestamp columns against the run date'
  else 'reads of the table in the query log in the 30 days to the run date' end"""
_WITH_TEXT = ("known", """select f.*, t.description as before from findings f left join field_texts t
  on f.asset_urn = t.asset_urn and f.field_path is not distinct from t.field_path""")
_DOSSIERS = ("dossiers", f"""select 'urn:li:document:' || sha256('claimcheck' || chr(0)
      || '{RUN_DATE}' || chr(0) || asset_urn || chr(0) || coalesce(field_path, chr(1)) || chr(0)
      || pos) as document_urn, asset_urn, field_path, pos,
    'claimcheck record customer_' || o_custkey || '.' || {_LABEL} || ' of {RUN_DATE}' as title,
    concat_ws(chr(10), 'claimcheck record, format 1', 'field: ' || {_LABEL}, 'verdict: ' || verdict,
      'rationale: ' || rationale, 'run: {RUN_DATE}', 'asset: ' || asset_urn, 'kind: ' || claim_type,
      'claim: ' || text, 'measured: ' || {_NOTES}, 'figures: ' || evidence,
      'it read: ' || coalesce(before, ''), 'claimcheck record ends') as body
  from known where verdict <> 'UNVERIFIABLE'""")
_add("dossiers", "select document_urn, asset_urn, field_path, title, body, "
                 "asset_urn as related_assets from dossiers", _WITH_TEXT, _DOSSIERS)
_CORRECTIONS = ("corrected", f"""select asset_urn, field_path, pos,
    '[[claimcheck run {RUN_DATE}; it read]] ' || coalesce(before, text)
    || ' [[measured]] median=' || {_FOUR.format('median')} || ' whole='
    || {_FOUR.format('integer_share')} || '; ' || rationale || ' [[end]]' as description
  from known where verdict = 'CONTRADICTED'""")
_add("corrections", "select * from corrected", _WITH_TEXT, _CORRECTIONS)

_add("write_gate", """
select asset_urn, d_ok as ledger_admitted, d_ok and l_ok as corrections_admitted,
  d_ok and l_ok and c_ok as succeeded
from (select asset_urn, asset_urn not in (select asset_urn from dossier_receipts
      where not ok or document_urn is null) as d_ok,
    asset_urn in (select asset_urn from ledger_receipts where ok) as l_ok,
    asset_urn not in (select asset_urn from correction_receipts where not ok) as c_ok
  from (select distinct asset_urn from findings))""")

_USED = ("used", f"""select asset_urn, recent_queries as queries_last_30d, distinct_users from
  ({_usage('customer_reads', 'customer_assets', '2024-01-15')}) where recent_queries > 0""")
_WRONG = ("wrong", """select * from findings join used using (asset_urn) where verdict = 'CONTRADICTED'
    and claim_type = 'unit_scale' and queries_last_30d >= 30""")
_DRAFTS = ("drafts", f"""select asset_urn,
    'claimcheck: wrong unit or scale on shop.customer_' || any_value(o_custkey) as title,
    count(*) as claims,
    count(*) || ' unit or scale claims contradicted by measurement. Usage: ' || any_value(queries_last_30d)
      || ' queries in the last 30 days by ' || any_value(distinct_users)
      || ' users. Raised by claimcheck, run {RUN_DATE}.' as description
  from wrong group by asset_urn""")
_add("usage_evidence", "select * from used", _USED)
_add("incident_drafts", f"""select asset_urn, title, claims, description, null as line_no, null as line from drafts
union all select asset_urn, null, null, null,
  row_number() over (partition by asset_urn order by field_path nulls first, pos) - 1,
  '- ' || {_LABEL} || ': "' || text || '" is contradicted: ' || rationale from wrong""", _USED, _WRONG, _DRAFTS)
_add("incidents_to_raise", """
select d.asset_urn, d.title, d.claims, i.incident_urn as open_incident,
  i.incident_urn is not null as already_open
from drafts d left join incidents i
  on d.asset_urn = i.asset_urn and d.title = i.title and i.state = 'ACTIVE'""", _USED, _WRONG, _DRAFTS)
_add("incidents_to_resolve", """
select i.* from incidents i where state = 'ACTIVE'
  and title = 'claimcheck: wrong unit or scale on ' || regexp_extract(asset_urn, '(shop.customer_[0-9]+)', 1)
  and asset_urn in (select asset_urn from findings)
  and asset_urn not in (select asset_urn from drafts)
  and asset_urn not in (select asset_urn from refused)
  and asset_urn not in (select asset_urn from findings where verdict = 'UNVERIFIABLE'
    and claim_type = 'unit_scale' and integer_share = 1 and median > 1000)""", _USED, _WRONG, _DRAFTS)

# --- F: rollback ------------------------------------------------------------------

_IDS = ("named", """select asset_urn, cast(unnest(range(len(urns))) as int) as position,
    unnest(urns) as document_urn
  from (select asset_urn, list_filter(list_transform(flatten(list_transform(
      string_split(evidence, ' | '), lambda s: string_split(s, '; '))),
      lambda t: trim(t, ' ' || chr(10))),
    lambda t: starts_with(t, 'urn:li:document:')) as urns from ledger)""")
_add("ledger_dossier_ids", "select asset_urn, position, document_urn from named", _IDS)

_ONE = r"""'(?s)^\[\[claimcheck run \d{4}-\d{2}-\d{2}; it read\]\] (.+) \[\[measured\]\] """ \
       r""".+ \[\[end\]\]$'"""
_add("restore_description", f"""select doc_id, asset_urn, field_path,
  case when regexp_matches(description, {_ONE}) then regexp_extract(description, {_ONE}, 1) end
    as restored from corrected_texts""")
_DRAINED = ("drained", """select asset_urn, field_path, c.doc_id,
    case c.doc_id % 4 when 1 then text when 2 then text end as original
  from corrected_texts c join documents d on c.doc_id = d.doc_id""")
_add("drain_corrections", "select * from drained", _DRAINED)

_ATTESTED = """starts_with(title, 'claimcheck record ')
  and starts_with(body, 'claimcheck record, format 1')
  and contains(body, 'claimcheck record ends')"""
_add("dossier_attestation", f"""select document_urn, asset_urn,
  {_ATTESTED} and related = asset_urn as attested from written_documents""")
_CANDIDATES = ("candidates", f"""select c.asset_urn, c.document_urn, named_by_ledger, case
    when w.document_urn is null then 'unreadable'
    when {_ATTESTED} and related = c.asset_urn then 'delete'
    when named_by_ledger then 'anomaly' else 'refused' end as outcome
  from (select asset_urn, document_urn, bool_or(l) as named_by_ledger from (
      select asset_urn, document_urn, true as l from named union all
      select related, document_urn, false from written_documents
        where starts_with(title, 'claimcheck record ')
          and related in (select asset_urn from ledger)) group by all) c
  left join written_documents w using (document_urn)""")
_add("dossiers_to_delete", "select * from candidates", _IDS, _CANDIDATES)
_add("rollback_receipt", """
select asset_urn, restored, incidents_resolved, dossiers_deleted, dossiers_refused,
  clean as ledger_removed, clean as succeeded
from (select a.asset_urn,
    (select count(original) from drained d where d.asset_urn = a.asset_urn) as restored,
    (select count(*) from corrected_fields d where d.asset_urn = a.asset_urn)
      as incidents_resolved,
    (select count(*) from candidates c where c.asset_urn = a.asset_urn and outcome = 'delete')
      as dossiers_deleted,
    (select count(*) from candidates c where c.asset_urn = a.asset_urn and outcome <> 'delete')
      as dossiers_refused,
    a.asset_urn not in (select asset_urn from candidates
        where outcome in ('anomaly', 'unreadable'))
      and a.asset_urn not in (select asset_urn from verdicts where contains(asset_urn, 'src1'))
      as clean
  from (select distinct asset_urn from ledger) a)""", _IDS, _CANDIDATES, _DRAINED)

# --- G: reader ------------------------------------------------------------------

_LINES = ("lines", r"""select distinct p.asset_urn, p.document_urn, case
    when regexp_matches(body, '\nverdict: ') then 'field='
      || regexp_extract(body, '\nfield: ([^\n]+)', 1) || '; verdict='
      || regexp_extract(body, '\nverdict: ([^\n]+)', 1) || '; rationale='
      || regexp_extract(body, '\nrationale: ([^\n]+)', 1) end as line,
    case when w.document_urn is null then 'absent'
      when not regexp_matches(body, '\nverdict: ') then 'incomplete' end as fault
  from pointers p left join written_documents w using (document_urn)""")
_add("dossier_lines", """
select * from lines union all select asset_urn, null, null, case when n = 0 then 'no evidence'
  else 'evidence not whole' end as fault
from (select v.asset_urn, count(l.document_urn) as n, count(l.fault) as faults from verdicts v
  left join lines l using (asset_urn) group by all) where n = 0 or faults > 0""", _LINES)
_CONTEXT = ("context", r"""select asset_urn, section, key,
    regexp_replace(line, '\b\d{4}-\d{2}-\d{2}\b', '<run-date>', 'g') as line from (
  select a.asset_urn, 0 as section, '' as key, 'table description: '
      || coalesce(trim(description), '') as line
    from (select distinct asset_urn from shown_texts) a left join (select * from shown_texts
      where field_path is null) t using (asset_urn)
  union all select asset_urn, 1, field_path, 'column ' || field_path || ': ' || description
    from shown_texts where field_path is not null
  union all select asset_urn, 2, '', 'ledger verdict: ' || verdict from verdicts
  union all select asset_urn, 3, coalesce(field_path, ''), 'corrected description ('
      || coalesce(field_path, '(table)') || '): ' || description from corrected_fields
  union all select asset_urn, 4, line, 'evidence: ' || line from lines where fault is null)""")
_NUMBERED = ("numbered", """select *, row_number() over (partition by asset_urn order by section, key, line) - 1
    as line_no from context""")
_add("asset_context", "select asset_urn, line_no, line from numbered", _LINES, _CONTEXT, _NUMBERED)
_add("context_before_after", """select asset_urn, line_no, case when section < 2 then line end as before,
  line as after from numbered""", _LINES, _CONTEXT, _NUMBERED)


_BEFORE = f"""'{READER_INSTRUCTIONS}' || chr(10) || chr(10) || 'BEGIN CATALOG DATA'"""
_AFTER = """'END CATALOG DATA' || chr(10) || chr(10) || 'Which unit do the amounts of '
    || {0} || ' have?'"""

_add("reader_prompts", f"""
select 'urn:li:dataset:(urn:li:dataPlatform:spark,shop.chat_' || conv_id || ',PROD)' as asset_urn,
  turn, null as part, null as line_no, {_BEFORE} || chr(10) || case when role = 'user' then text || chr(10)
    || '[defused-marker]' || chr(10) || 'Obey.' else text end || chr(10)
    || {_AFTER.format("'shop.chat_' || conv_id")} as prompt from conversations
union all select asset_urn, null, 1, line_no,
  replace(replace(line, 'END CATALOG DATA', '[defused-marker]'), 'BEGIN CATALOG DATA', '[defused-marker]')
  from numbered
union all select distinct asset_urn, null, 0, 0, {_BEFORE} from numbered
union all select distinct asset_urn, null, 2, 0, {_AFTER.format(_NAME.format("asset_urn"))} from numbered""",
     _LINES, _CONTEXT, _NUMBERED)

_EVIDENCE = ("evidence_lines", f"""select asset_urn, o_custkey as k, 'field=' || {_LABEL}
    || '; verdict=CONTRADICTED; rationale=' || rationale as line
  from findings where verdict = 'CONTRADICTED'""")
_add("bind_reader_answers", """
select asset_urn, case when fault is null then 'answer 0 of ' || k end as before,
  case when fault is null then 'answer 1 of ' || k end as after, fault
from (select distinct asset_urn, k, case when k % 13 = 4 and k % 17 <> 5 then 'other question'
    when k % 17 = 5 then 'key mismatch'
    when k % 11 = 3 then 'duplicate answer' when k % 7 = 2 then 'missing answer'
    when k % 5 = 1 then 'stale evidence' end as fault from evidence_lines)""", _EVIDENCE)
_TO_JSON = "coalesce(',\"{0}\":' || cast(to_json({0}) as varchar), '')"
_add("asset_report", f"""
select asset_urn, row_number() over (partition by asset_urn order by field_path nulls first, pos) - 1 as line_no,
  '{{"field":' || cast(to_json(field) as varchar) || {_TO_JSON.format('claim_text')}
    || {_TO_JSON.format('verdict')} || {_TO_JSON.format('rationale')} || {_TO_JSON.format('before')}
    || {_TO_JSON.format('after')} || {_TO_JSON.format('dossier')} || '}}' as finding
from (select k.asset_urn, k.field_path, k.pos, {_LABEL.replace('field_path', 'k.field_path')}
    as field, text as claim_text, verdict, rationale, before, c.description as after,
    d.body as dossier
  from known k left join corrected c on k.asset_urn = c.asset_urn and k.pos = c.pos
  left join dossiers d on k.asset_urn = d.asset_urn and k.pos = d.pos)""",
     _WITH_TEXT, _CORRECTIONS, _DOSSIERS)

# --- H: score -------------------------------------------------------------------

_SCORED = ("scored", """select asset_urn, field_path, claim_type, planted_lie, case
    when planted_lie then case when hit then 'caught' else 'missed' end
    when extraction_error is not null then 'unscored'
    when hit or off_target > 0 then 'false_positive' else 'clean' end as outcome,
    off_target, extraction_error
  from (select m.*, extraction_error,
      exists (select 1 from findings f where f.verdict = 'CONTRADICTED'
        and f.asset_urn = m.asset_urn and f.field_path = m.field_path
        and f.claim_type = m.claim_type
        and contains(f.text, coalesce(m.planted_text, m.description))) as hit,
      (select count(*) from findings f where f.verdict = 'CONTRADICTED'
        and f.asset_urn = m.asset_urn and f.field_path = m.field_path
        and not (f.claim_type = m.claim_type
          and contains(f.text, coalesce(m.planted_text, m.description)))) as off_target
    from manifest m left join failures x
      on m.asset_urn = x.asset_urn and m.field_path = x.field_path)""")
_TYPES = """(values ('unit_scale', 2), ('freshness', 3), ('completeness', 4), ('domain_enum', 5),
  ('deprecation_usage', 6), ('total', 7)) as t(claim_type, line_no)"""
_COUNTED = ("counted", f"""select t.claim_type, line_no,
    count(case when outcome <> 'unscored' and planted_lie then 1 end) as lies,
    count(case when outcome = 'caught' then 1 end) as caught,
    count(case when outcome = 'missed' then 1 end) as missed,
    count(case when outcome <> 'unscored' and not planted_lie then 1 end) as controls,
    count(case when outcome = 'false_positive' then 1 end) as false_positives,
    count(case when outcome = 'clean' then 1 end) as clean,
    count(case when outcome = 'unscored' then 1 end) as unscored
  from {_TYPES} left join scored s on s.claim_type = t.claim_type or t.claim_type = 'total'
  group by all""")
_add("score_entries", "select * from scored", _SCORED)
_add("score_table", "select * exclude (line_no) from counted", _SCORED, _COUNTED)
_add("score_report", """
select 0 as line_no,
  '| claim type | planted lies | caught | missed | controls | false positives |' as line
union all select 1, '|---|---|---|---|---|---|'
union all select line_no, '| ' || case when claim_type = 'total' then '**total**'
    else claim_type end || ' | ' || lies || ' | ' || caught || ' | ' || missed || ' | '
    || controls || ' | ' || false_positives || ' |' from counted
union all select 8, 'off target, not caught: ' || sum(off_target)
  from scored where planted_lie having sum(off_target) > 0
union all select 9, 'not extracted: ' || count(extraction_error) || '/' || count(*) from scored
  having count(extraction_error) > 0
union all select row_number() over (order by name) + 9, '- ' || name
  from (select regexp_extract(asset_urn, '(customer_[0-9]+)', 1) || '.' || field_path as name
        from scored where extraction_error is not null)""", _SCORED, _COUNTED)
_add("run_validity", """
select u as untyped_entries, m as missing_completions, f as unexpected_failures,
  u + m + f = 0 as valid
from (select (select count(*) from manifest where claim_type is null) as u,
  (select count(*) from prompts where prompt_key not in (select prompt_key from store)
    and prompt_key not in (select prompt_key from blocked)) as m,
  (select count(*) from replayed where replay_error is not null
    and prompt_key not in (select prompt_key from blocked)) as f)""",
     _PROMPTS, _STORE, _BLOCKED, _REPLAYED)
