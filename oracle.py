"""The registered queries once more, as SQL for a single-node engine.

Nothing here is used by the library. Every text runs on the plain parquet tables.
"""

from __future__ import annotations

from ledgerlift.operators.context import OVER_HEADING, SECTIONS, UNDER_HEADING
from ledgerlift.operators.gold import GOLD_TABLES, MARGIN_TABLES
from ledgerlift.operators.insights import INSIGHT_BUILDERS, LATE_TAG, LOW_MARGIN_TAG, OVERSPEND_TAG
from ledgerlift.plans.adapters import DOCUMENT_LINES, EXPORT_HEADERS, MAPPING_ROWS, VIEWS, plain_sql
from ledgerlift.schemas import KNOWN_CODES, REQUIRED_TYPES, SYNONYMS


def _with(*parts: tuple[str, str]) -> str:
    return "with " + ",\n".join(f"{name} as ({text})" for name, text in parts) + "\n"


_VIEWS = {name: (name, plain_sql(text)) for name, text in VIEWS.items()}


def _first_per(table: str, key: str) -> str:
    return (
        f"select * exclude (row_no, rn) from (select *, row_number() over "
        f"(partition by {key} order by row_no) as rn from {table}) where rn = 1"
    )


def _usd(amount: str) -> str:
    return (
        f"coalesce({amount}, 0.0) * case coalesce(currency, 'USD') when 'EUR' then 1.08::double "
        "when 'GBP' then 1.27::double else 1.0::double end"
    )


_CUSTOMERS = ("customers", _first_per("customer_master", "customer_id"))
_MATERIALS = ("materials", _first_per("material_master", "material_id"))
_SALES = (
    "sales_enriched",
    f"""select * exclude (margin), margin as margin_pct, margin < 6.0 as is_margin_squeeze,
          material_id = 'MAT-01' and margin < 6.0 as is_mat01_squeeze
        from (
          select *, case when netwr_usd = 0 then 0.0
            else (netwr_usd - estimated_cost_usd) / netwr_usd * 100.0 end as margin
          from (
            select h.*, i.* exclude (order_id), c.* exclude (customer_id), m.* exclude (material_id),
              {_usd("net_value")} as netwr_usd, {_usd("estimated_cost")} as estimated_cost_usd
            from sales_header h join sales_items i on h.order_id = i.order_id
              left join customers c on h.customer_id = c.customer_id
              left join materials m on i.material_id = m.material_id))""",
)
_CONTROLLING = ("controlling_enriched", plain_sql(VIEWS["controlling"]))
_DELIVERY = ("delivery_enriched", plain_sql(VIEWS["delivery"]))
_SILVER = (
    _VIEWS["sales_header"], _VIEWS["sales_items"], _VIEWS["customer_master"], _VIEWS["material_master"],
    _CUSTOMERS, _MATERIALS, _SALES, _CONTROLLING, _DELIVERY,
)


def _measure_sql(name: str, net: str, cost: str) -> str:
    return {
        "avg_margin_pct": "avg(margin_pct)",
        "min_margin_pct": "min(margin_pct)",
        "max_margin_pct": "max(margin_pct)",
        "total_net_value_usd": f"coalesce(sum({net}), 0)",
        "total_cost_usd": f"coalesce(sum({cost}), 0)",
        "squeeze_count": "count(*) filter (where is_margin_squeeze)",
        "order_count": "count(order_id)",
        "total_actual_cost": "coalesce(sum(actual_cost), 0)",
        "total_budget": "coalesce(sum(budget_amount), 0)",
        "total_variance": "coalesce(sum(budget_variance), 0)",
        "avg_variance": "avg(budget_variance)",
        "record_count": "count(order_id)",
        "avg_days_late": "avg(days_late)",
        "avg_freight_cost": "avg(freight_cost_usd)",
        "total_freight_cost": "coalesce(sum(freight_cost_usd), 0)",
        "delivery_count": "count(delivery_id)",
    }[name]


def _gold_select(name: str, basis: str = "local", measures=None) -> str:
    table = GOLD_TABLES[name]
    net, cost = ("net_value", "estimated_cost") if basis == "local" else ("netwr_usd", "estimated_cost_usd")
    columns = []
    for m in measures or table.measures:
        expr = _measure_sql(m, net, cost)
        columns.append(f"{expr} as {m}" if m.endswith("_count") else f"round({expr}, 4) as {m}")
    keys = ", ".join(table.keys)
    return f"select {keys}, {', '.join(columns)} from {table.source} group by {keys}"


_GOLD = (*_SILVER, *((name, _gold_select(name)) for name in GOLD_TABLES))


def _cut(name: str) -> str:
    measures = GOLD_TABLES["margin_by_material"].measures
    keys = [k for n in MARGIN_TABLES for k in GOLD_TABLES[n].keys]
    shown = ", ".join(k if k in GOLD_TABLES[name].keys else f"null::varchar as {k}" for k in keys)
    return f"select '{name}' as gold_table, {shown}, {', '.join(measures)} from ({_gold_select(name, measures=measures)})"


def _report(source: str, count_name: str, low: int, rules) -> str:
    """One line per rule: (name, column, bad, says, severity)."""
    lines = [
        f"select '{count_name}' as name, null::varchar as \"column\", count(*) >= {low} as passed, "
        f"null::bigint as bad_rows, count(*)::varchar || ' rows, allowed at least {low}' as message, "
        f"'fail' as severity from {source}"
    ]
    for name, column, bad, says, severity in rules:
        lines.append(
            f"select '{name}', '{column}', n = 0, n, n::varchar || ' rows with {column} {says}', '{severity}' "
            f"from (select count(*) filter (where {bad}) as n from {source})"
        )
    return _with(*_SILVER) + "\nunion all\n".join(lines)


def _nulls(name: str, *columns: str):
    return [(name, c, f"{c} is null", "null", "fail") for c in columns]


def _not_positive(name: str, column: str):
    return (name, column, f"{column} is null or {column} <= 0", "null, zero or negative", "fail")


_CHECKS = {
    "validate_sales": _report("sales_enriched", "row_count_range", 500, [
        *_nulls("join_key_no_nulls", "order_id", "customer_id", "material_id"),
        _not_positive("netwr_usd_positive", "netwr_usd"),
        ("margin_pct_not_above_100", "margin_pct", "margin_pct > 100", "above 100", "fail"),
        ("negative_margins", "margin_pct", "margin_pct < 0", "below 0", "warn"),
        _not_positive("estimated_cost_usd_positive", "estimated_cost_usd"),
        ("margin_cross_validation", "margin_pct",
         "netwr_usd > 0 and abs((netwr_usd - estimated_cost_usd) / netwr_usd * 100 - margin_pct) > 0.01",
         "not matching the amounts", "fail"),
        *_nulls("enrichment_col_no_nulls", "netwr_usd", "estimated_cost_usd", "margin_pct", "is_margin_squeeze"),
    ]),
    "validate_controlling": _report("controlling_enriched", "controlling_row_count", 50, [
        *_nulls("budget_variance_no_nulls", "budget_variance"),
        ("budget_variance_cross_validation", "budget_variance",
         "abs((actual_cost - budget_amount) - budget_variance) > 0.01", "not matching actual minus budget", "fail"),
    ]),
    "validate_delivery": _report("delivery_enriched", "delivery_row_count", 50, [
        ("days_late_non_negative", "days_late", "days_late < 0", "below 0", "fail"),
        _not_positive("freight_cost_positive", "freight_cost_usd"),
    ]),
}


# --- headers and mapping -----------------------------------------------------------------------

def _values(rows) -> str:
    return "(values " + ", ".join("(" + ", ".join(f"'{v}'" for v in row) + ")" for row in rows) + ")"


_EXPORTS = ("exports", plain_sql(EXPORT_HEADERS))
_MATCHES = (
    "matches",
    f"""select e.*, coalesce(k.field, s.field) as canonical,
          case when k.field is not null then 'Known' when s.field is not null then 'Heuristic'
            else 'NoMatch' end as tier
        from exports e
        left join {_values(KNOWN_CODES.items())} k(code, field)
          on upper(regexp_replace(e.header, '^\\s+|\\s+$', '', 'g')) = k.code
        left join {_values((w, f) for f, words in SYNONYMS.items() for w in words)} s(word, field)
          on lower(regexp_replace(e.header, '[^\\p{{L}}\\p{{N}}]', '', 'g')) = s.word""",
)
_NAMES = """
    select file, (generate_subscripts(names, 1) - 1)::integer as position, unnest(names) as header
    from (
      select file, list_filter(list_transform(string_split(rtrim(split_part(line, chr(10), 1), chr(13)), ','),
        lambda n: regexp_replace(regexp_replace(n, '^[\\s\\p{Z}]+|[\\s\\p{Z}]+$', '', 'g'), '^"+|"+$', '', 'g')),
        lambda n: n <> '') as names
      from lines)"""
_MAPPING = ("mapping_rows", plain_sql(MAPPING_ROWS))
_OLD = ("old", "select tenant, data_type, file, header, canonical from mapping_rows where origin is distinct from 'R'")
_NEW = ("new", "select tenant, data_type, file, header, canonical from mapping_rows where origin = 'R'")


# --- text --------------------------------------------------------------------------------------

def _fixed(x: str, digits: int) -> str:
    return f"format('{{:.{digits}f}}', ({x})::double)"


def _str(column: str) -> str:
    return f"coalesce({column}::varchar, '')"


_INSIGHTS = {
    "margin_by_material": f"""{_str('material_id')} || ' has an average margin of ' || {_fixed("avg_margin_pct", 1)} || '% with '
        || squeeze_count || ' squeeze orders and $' || {_fixed("total_net_value_usd", 0)} || ' total revenue'
        || case when avg_margin_pct < 6 then '{LOW_MARGIN_TAG}' else '' end || '.'""",
    "margin_by_channel": f"""'The ' || {_str('distribution_channel')} || ' channel has an average margin of '
        || {_fixed("avg_margin_pct", 1)} || '% across ' || order_count || ' orders with $'
        || {_fixed("total_net_value_usd", 0)} || ' total revenue.'""",
    "margin_by_sales_org": f"""'Sales org ' || {_str('sales_org')} || ' has an average margin of '
        || {_fixed("avg_margin_pct", 1)} || '% across ' || order_count || ' orders.'""",
    "margin_by_segment": f"""'The ' || {_str('industry')} || ' segment in ' || {_str('region_group')} || ' has an average margin of '
        || {_fixed("avg_margin_pct", 1)} || '% with $' || {_fixed("total_net_value_usd", 0)} || ' revenue.'""",
    "budget_variance": f"""'The ' || {_str('department')} || ' department is $' || {_fixed("abs(total_variance)", 0)}
        || case when total_variance > 0 then ' over budget' else ' under budget' end || ' in fiscal year '
        || {_str('fiscal_year')} || case when total_variance > 100000 then '{OVERSPEND_TAG}' else '' end || '.'""",
    "delivery_performance": f"""'Route ' || {_str('route')} || ' averages ' || {_fixed("avg_days_late", 0)}
        || ' days late across ' || delivery_count || ' deliveries with $' || {_fixed("total_freight_cost", 0)}
        || ' total freight cost' || case when avg_days_late > 5 then '{LATE_TAG}' else '' end || '.'""",
}
_INSIGHT_SELECTS = [
    f"select '{name}' as table_name, {_INSIGHTS[name]} as text from {name}" for name in INSIGHT_BUILDERS
]
_ALL_INSIGHTS = ("insights", "\nunion all\n".join(_INSIGHT_SELECTS))


def _line(name: str) -> str:
    table = GOLD_TABLES[name]
    cells = []
    for c in sorted((*table.keys, *table.measures)):
        if c in table.keys:
            shown = f"coalesce({c}::varchar, 'N/A')"
        else:
            shown = (
                f"case when {c} is null then 'N/A' when {c} = floor({c}) then {c}::bigint::varchar "
                f"else {_fixed(c, 2)} end"
            )
        cells.append(f"'{c}: ' || {shown}")
    return " || ' | ' || ".join(cells)


_BUDGET_LINES = f"""
    select case when total_variance > 0 then 2 else 5 end as part,
      '  ' || coalesce(department, '?') || ' ' || coalesce(try_cast(fiscal_year as bigint), 0) || ': budget=$' || {_fixed("total_budget", 2)} || ' | actual=$'
        || {_fixed("total_actual_cost", 2)} || case when total_variance > 0 then ' | overrun=$' else ' | savings=$' end
        || {_fixed("abs(total_variance)", 2)} as line
    from budget_variance
    union all select distinct 1, '{OVER_HEADING}' from budget_variance where total_variance > 0
    union all select distinct 3, '' from budget_variance where total_variance > 0
    union all select distinct 4, '{UNDER_HEADING}' from budget_variance where total_variance <= 0
    union all select distinct 7, '' from budget_variance where total_variance <= 0"""


def _context() -> str:
    parts = []
    for number, (name, title) in enumerate(SECTIONS.items(), start=1):
        parts.append(f"select {number} as section, 0 as part, '=== {title} ===' as line")
        if name == "budget_variance":
            parts.append(f"select {number}, part, line from ({_BUDGET_LINES})")
        else:
            parts.append(f"select {number}, 6, {_line(name)} from {name}")
            parts.append(f"select {number}, 7, ''")
    return _with(*_GOLD) + "\nunion all\n".join(parts)


def _metric_rows(name: str) -> str:
    table = GOLD_TABLES[name]
    second = f"{table.keys[1]}::varchar" if len(table.keys) > 1 else "null::varchar"
    counted = next(m for m in reversed(table.measures) if m.endswith("_count"))
    return (
        f"select '{name}' as metric, {table.keys[0]}::varchar as key_1, {second} as key_2, "
        f"round({table.sort}, 4) as sort_value, {counted} as rows_counted from {name}"
    )


_METRICS = _with(*_GOLD) + "\nunion all\n".join(_metric_rows(name) for name in GOLD_TABLES)


# --- vectors -----------------------------------------------------------------------------------

def _embedded(texts: str, prefix: str, dim: int = 768) -> tuple[tuple[str, str], ...]:
    """CTEs ``<prefix>_weights(id, bucket, w)`` for a query giving ``id`` and ``text``."""
    return (
        (f"{prefix}_words", f"select id, unnest(regexp_extract_all(lower(text), '[\\p{{L}}\\p{{N}}]+')) as w from ({texts})"),
        (f"{prefix}_counts", f"select id, ('0x' || substr(md5(w), 1, 8))::bigint % {dim} as bucket, count(*) as c "
                             f"from {prefix}_words group by 1, 2"),
        (f"{prefix}_norms", f"select id, sqrt(sum(c * c)::double) as n from {prefix}_counts group by 1"),
        (f"{prefix}_weights", f"select id, bucket, (c / n)::float::double as w from {prefix}_counts join {prefix}_norms using (id)"),
    )


def _closest(texts: str, question: str, k: int) -> str:
    """CTEs ending in ``closest(id, distance)``: the k texts nearest to one text."""
    return _with(
        *_GOLD, _ALL_INSIGHTS,
        *_embedded(texts, "d"), *_embedded(question, "q"),
        ("dots", "select d.id, sum(d.w * q.w) as dot from d_weights d join q_weights q using (bucket) group by 1"),
        ("squares", "select id, sum(w * w) as s from d_weights group by 1"),
        ("measured", f"""
            select t.id, round(sqrt(greatest(0, coalesce(s, 0) + (select sum(w * w) from q_weights)
              - 2 * coalesce(dot, 0))), 6) as distance
            from ({texts}) t left join squares using (id) left join dots using (id)"""),
        ("closest", f"select id, distance from measured order by distance, id limit {k}"),
    )


_VEC = "select vec_id, embedding::double[] as v from embeddings"
_PROBE = f"select v from ({_VEC}) order by vec_id limit 1"
_DIST = {"l2": "list_distance(a.v, b.v)", "cosine": "1 - list_cosine_similarity(a.v, b.v)"}


def _knn(metric: str, k: int = 10) -> str:
    return (
        f"select vec_id, round({_DIST[metric]}, 6) as distance from ({_VEC}) a, ({_PROBE}) b(v) "
        f"order by {_DIST[metric]}, vec_id limit {k}"
    )


def _knn_join(metric: str, k: int = 5) -> str:
    return (
        "select query_id, vec_id, round(distance, 6) as distance, rank from (select b.vec_id as query_id, "
        f"a.vec_id, {_DIST[metric]} as distance, row_number() over (partition by b.vec_id order by {_DIST[metric]}, "
        f"a.vec_id)::integer as rank from ({_VEC}) a, ({_VEC}) b) where rank <= {k}"
    )


_SEARCH_BATCH = _with(
    *_embedded("select doc_id as id, text from documents", "d"), *_embedded("select item_id as id, text from benchmark", "q"),
    ("dots", "select q.id as item_id, d.id, sum(d.w * q.w) as dot from d_weights d join q_weights q using (bucket) group by 1, 2"),
    ("d_squares", "select id, sum(w * w) as s from d_weights group by 1"),
    ("q_squares", "select id, sum(w * w) as s from q_weights group by 1"),
    ("measured", """
        select b.item_id, t.doc_id, sqrt(greatest(0, coalesce(d.s, 0) + coalesce(q.s, 0) - 2 * coalesce(dot, 0))) as distance
        from benchmark b cross join documents t left join d_squares d on d.id = t.doc_id left join q_squares q on q.id = b.item_id
        left join dots on dots.item_id = b.item_id and dots.id = t.doc_id"""),
) + """select item_id, rank, round(distance, 5) as distance from (
    select item_id, distance, row_number() over (partition by item_id order by distance, doc_id)::integer as rank from measured
) where rank <= 3"""

_GATE = _with(*_SILVER) + "\nunion all\n".join(
    f"""select '{table}' as "table", name, "column", bad_rows from ({_CHECKS[check].split(_with(*_SILVER), 1)[1]})
        where not passed and severity = 'fail' and name <> 'row_count_range'"""
    for table, check in (("sales", "validate_sales"), ("controlling", "validate_controlling"), ("delivery", "validate_delivery"))
) + """
union all select 'sales', 'row_count_range', null, null from (select count(*) as n from sales_enriched) where n > 10"""

_STEPS = {
    "loaded_sales_header": "sales_header", "loaded_sales_items": "sales_items", "loaded_customer_master": "customers",
    "loaded_material_master": "materials", "loaded_controlling": "controlling_enriched", "loaded_delivery": "delivery_enriched",
    "items": "sales_enriched", "customer": "sales_enriched", "material": "sales_enriched", "sales": "sales_enriched",
}

_ITEM_STRINGS = (
    "select order_id::varchar as order_id, line_item_number::varchar as line_item_number, material_id, "
    "net_value, estimated_cost from sales_items"
)
_PIPELINE_SALES = (
    "select order_id::varchar as order_id, customer_id::varchar as customer_id, currency, material_id, net_value, "
    "industry, region_group, material_description, netwr_usd, round(margin_pct, 6) as margin_pct, "
    "is_margin_squeeze, is_mat01_squeeze from sales_enriched"
)


def oracle_sql() -> dict[str, str]:
    silver, gold = _with(*_SILVER), _with(*_GOLD)
    sql = {
        "sales_enriched": silver + "select * from sales_enriched",
        "customer_dedupe": silver + "select * from customers",
        "material_dedupe": silver + "select * from materials",
        **{name: gold + f"select * from {name}" for name in GOLD_TABLES},
        "margin_by_material_usd": silver + _gold_select("margin_by_material", basis="usd"),
        "margins_by_cut": silver + "\nunion all\n".join(_cut(name) for name in MARGIN_TABLES),
        "margins_by_cut_joined": silver + "\nunion all\n".join(_cut(name) for name in MARGIN_TABLES),
        **_CHECKS,
        "extract_headers": _with(("lines", plain_sql(DOCUMENT_LINES))) + _NAMES,
        "match_headers": _with(_EXPORTS, _MATCHES) + "select * from matches",
        "match_coverage": _with(_EXPORTS, _MATCHES)
        + "select file, count(*) as headers_total, count(canonical) as headers_matched from matches group by 1",
        "missing_types": _with(_MAPPING)
        + f"""select tenant, data_type from (select distinct tenant from mapping_rows),
              (select unnest({list(REQUIRED_TYPES)}) as data_type)
              except select tenant, data_type from mapping_rows""",
        "upsert_mapping": _with(_MAPPING, _OLD, _NEW)
        + """select * from new union all
             select * from old where not exists (
               select 1 from new where new.tenant = old.tenant and new.data_type = old.data_type)""",
        "load_mapping": _with(_MAPPING)
        + """select tenant, data_type, file, 0 as position, header, canonical from mapping_rows union all
             select tenant, data_type, file, 1, 'other', null from mapping_rows""",
        "apply_mapping": _with(_VIEWS["sales_header"]) + "select * from sales_header",
        **{f"insights_{name}": gold + select for name, select in zip(INSIGHT_BUILDERS, _INSIGHT_SELECTS)},
        "insights_all": _with(*_GOLD, _ALL_INSIGHTS) + "select * from insights",
        "context_lines": gold + "\nunion all\n".join(
            f"select '{n}' as table_name, {_line(n)} as line from {n}" for n in SECTIONS if n != "budget_variance"
        ),
        "budget_context": gold + _BUDGET_LINES,
        "gold_context": _context(),
        "knn_l2": _knn("l2"),
        "knn_cosine": _knn("cosine"),
        "knn_join_l2": _knn_join("l2"),
        "knn_join_cosine": _knn_join("cosine"),
        "knn_join_blocks": _knn_join("l2"),
        "embed_texts": _with(*_embedded("select doc_id as id, text from documents", "d"))
        + "select id as doc_id, bucket::integer as bucket, round(w, 6) as weight from d_weights",
        "semantic_search": _closest(
            "select doc_id as id, text from documents",
            "select 0 as id, text from (select text from benchmark order by item_id limit 1)", 10,
        ) + "select id as doc_id, distance from closest",
        "search_store": _closest(
            "select text as id, text from insights", "select 0 as id, 'Which route has a critical delay?' as text", 5,
        ) + "select id as text, table_name, distance from closest join insights on id = text",
        "semantic_search_batch": _SEARCH_BATCH,
        "validate_sales_bounds": silver + "select b.bounds, n >= b.low and (b.high is null or n <= b.high) as passed, "
        "'fail' as severity from (select count(*) as n from sales_enriched), (values ('wide', 500, 1000000000000), "
        "('low', 1, 10), ('high', 1000000000000, null)) b(bounds, low, high)",
        "checks_gate": _GATE,
        "failed_run": silver + "select true as failed, true as first_stays, count(*) as sales_rows from sales_enriched",
        "vector_table": _with(*_GOLD, _ALL_INSIGHTS) + "select table_name, text, 64 as cells from insights",
        "step_counts": silver + "\nunion all\n".join(
            f"select '{step}' as step, count(*) as n_rows from {source}" for step, source in _STEPS.items()
        ),
        "gold_sentinel": gold + "select false as before, true as after, count(*) as materials from margin_by_material",
        "extract_headers_folder": "\nunion all\n".join(
            f"select '{name}' as table_name, row_number() over () - 1 as position, column_name as header "
            f"from (describe {plain_sql(text)}) where column_name <> 'row_no'" for name, text in VIEWS.items()
        ),
        "read_bronze": silver + _ITEM_STRINGS,
        "read_quoted": "select doc_id::varchar as doc_id, source, length(text) as n_chars, sha256(text) as text_sha256 from documents",
        "land_bronze": silver + _ITEM_STRINGS,
        "land_bronze_stream": silver + _ITEM_STRINGS,
        "land_compacted": silver + _ITEM_STRINGS,
        "metric_json": _METRICS,
        "pipeline_sales": silver + _PIPELINE_SALES,
        "pipeline_native_sales": silver + _PIPELINE_SALES,
        "pipeline_metrics": _METRICS,
    }
    return sql
