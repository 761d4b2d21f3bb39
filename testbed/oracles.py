"""The queries as SQL for the correctness check."""

from __future__ import annotations

from .inputs import KEYS, PROJECTIONS, SCANNED, as_sql
from .stored import CORRECTED, GONE, ROLLED_UP

SHOWN = (
    "TABLE_NAME", "PRIMARY_KEY", "ROW_IDENTIFIER", "ISSUE_TYPE", "ISSUE_DETAIL",
    "SEVERITY", "RULE_NAME", "COLUMN_NAME", "NULL_RATE",
)

TYPES = {
    "event_id": "bigint", "ts": "timestamp_ntz", "et": "string", "v": "double", "u": "bigint",
    "o_orderkey": "bigint", "o_orderstatus": "string", "o_orderpriority": "string",
    "o_orderdate": "timestamp_ntz", "price": "decimal(18,2)", "deleted": "boolean", "k": "bigint",
    "l_orderkey": "bigint", "l_linenumber": "int", "l_quantity": "double", "a": "bigint", "b": "bigint",
    "c_custkey": "bigint", "c_name": "string", "c_nationkey": "int", "balance": "decimal(18,2)",
    "segment": "string",
}

RAW = {
    "region": "r_regionkey r_name",
    "nation": "n_nationkey n_name n_regionkey",
    "customer": "c_custkey c_name c_nationkey c_acctbal c_mktsegment",
    "supplier": "s_suppkey s_name s_nationkey s_acctbal",
    "part": "p_partkey p_name p_brand p_type p_size p_retailprice",
    "orders": "o_orderkey o_custkey o_orderstatus o_totalprice o_orderdate o_orderpriority",
    "lineitem": "l_orderkey l_partkey l_suppkey l_linenumber l_quantity l_extendedprice l_discount l_tax "
    "l_returnflag l_linestatus l_shipdate",
    "events": "event_id ts user_id event_type value props",
    "documents": "doc_id text lang source n_chars",
    "embeddings": "vec_id embedding label",
    "pages": "page_id url html",
    "benchmark": "item_id text",
    "labels": "doc_id quality toxic",
    "conversations": "conv_id turn role text",
}


def _union(parts) -> str:
    return "\nUNION ALL\n".join(parts)


def _text(value: str) -> str:
    return "'" + value.replace("'", "''") + "'"


def _shown(columns: str = ", ".join(SHOWN)) -> str:
    return f"SELECT {columns} FROM issues"


INPUTS = ",\n".join(f"{name} AS ({as_sql(name)})" for name in SCANNED)


def _profile_rows(table: str) -> list[str]:
    return [
        f"SELECT '{table}' AS TABLE_NAME, '{c}' AS COLUMN_NAME, '{TYPES[c]}' AS DATA_TYPE, "
        f"{i} AS ORDINAL_POSITION, count(*) AS TOTAL_ROWS, count(*) - count({c}) AS NULL_COUNT, "
        f"(count(*) - count({c})) / greatest(count(*), 1) AS NULL_RATE FROM {table}"
        for i, c in enumerate(PROJECTIONS[table], start=1)
    ]


PROFILE = "profile AS (" + _union([row for t in SCANNED for row in _profile_rows(t)]) + ")"
FLAG_TEXT = "'Null rate ' || printf('%.1f%%', NULL_RATE * 100) || ' exceeds threshold 5.0%'"


def _issue(source: str, table: str, keys: str, ident: str, kind: str, detail: str, severity: str, rule: str,
           values: dict[str, str], column: str = "NULL", rate: str = "NULL", where: str = "TRUE") -> str:
    """One producer: the shown columns, the payload as JSON, and the payload as a sort key."""
    if values:
        pairs = ", ".join(f"'{name}', CAST({expr} AS VARCHAR)" for name, expr in values.items())
        payload = f"json_object({pairs})::VARCHAR"
        order = "[" + ", ".join(f"coalesce(CAST({expr} AS VARCHAR), '')" for expr in values.values()) + "]"
    else:
        payload, order = "CAST(NULL AS VARCHAR)", "CAST([] AS VARCHAR[])"
    return (
        f"SELECT {table} AS TABLE_NAME, {keys} AS PRIMARY_KEY, {ident} AS ROW_IDENTIFIER, {kind} AS ISSUE_TYPE, "
        f"{detail} AS ISSUE_DETAIL, {severity} AS SEVERITY, {rule} AS RULE_NAME, "
        f"CAST({column} AS VARCHAR) AS COLUMN_NAME, CAST({rate} AS DOUBLE) AS NULL_RATE, "
        f"{payload} AS ROW_VALUES, {order} AS SORT_VALUES FROM {source} WHERE {where}"
    )


def _key_text(table: str) -> str:
    return ", ".join(KEYS[table])


def _ident(keys, named: bool = False) -> str:
    parts = [(f"'{k}=' || " if named else "") + f"coalesce(CAST({k} AS VARCHAR), 'None')" for k in keys]
    return " || ' | ' || ".join(parts)


def _duplicates(source: str, table: str, keys, extra: int = 0) -> str:
    groups = (
        f"(SELECT {', '.join(keys)}, count(*) AS n FROM {source} GROUP BY {', '.join(keys)} "
        f"HAVING count(*) - 1 > {extra}) AS g"
    )
    return _issue(
        groups, _text(table), _text(", ".join(keys)), _ident(keys, named=True), "'duplicate_primary_key'",
        "'Duplicate PK with count=' || n", "'critical'", "'Duplicate primary key values'", {k: k for k in keys},
    )


def _nulls() -> str:
    keys = "CASE TABLE_NAME " + " ".join(f"WHEN '{t}' THEN '{_key_text(t)}'" for t in SCANNED) + " END"
    return _issue(
        "profile", "TABLE_NAME", keys, "'TABLE_LEVEL'", "'high_null_rate'",
        f"'Column ' || COLUMN_NAME || ': ' || {FLAG_TEXT}", "'low'", "'Column exceeds null rate threshold'",
        {}, "COLUMN_NAME", "NULL_RATE", "NULL_RATE > 0.05",
    )


PROFILE_ISSUES = _union([_nulls(), *[_duplicates(t, t, KEYS[t]) for t in SCANNED]])

STATUS = _issue(
    "orders_d", "'orders_d'", "'o_orderkey'", _ident(["o_orderkey"]), "'closed_with_price'",
    "'Order is closed but price = ' || CAST(price AS VARCHAR)", "'high'", "'Closed orders with a price'",
    {"o_orderkey": "o_orderkey", "o_orderstatus": "o_orderstatus", "price": "price"},
    where="upper(o_orderstatus) = 'F' AND coalesce(price, 0) > 0",
)
RETENTION = _issue(
    "orders_d", "'orders_d'", "'o_orderkey'", _ident(["o_orderkey"]), "'old_order_kept'",
    "'Order of ' || strftime(o_orderdate, '%Y-%m-%d') || ' still present'", "'high'",
    "'Orders before 1996 should be gone'",
    {"o_orderkey": "o_orderkey", "o_orderdate": "o_orderdate"},
    where="o_orderdate < DATE '1996-01-01' AND coalesce(deleted, FALSE) = FALSE",
)
ANY = _issue(
    "lineitem_d LEFT JOIN part ON a = p_partkey LEFT JOIN supplier ON b = s_suppkey",
    "'lineitem_d'", "'l_orderkey, l_linenumber'", _ident(["l_orderkey", "l_linenumber"]), "'part_or_supplier'",
    "CASE WHEN a IS NULL AND b IS NULL THEN 'Missing part and supplier' "
    "WHEN a IS NOT NULL AND p_partkey IS NULL THEN 'Invalid part: ' || a "
    "ELSE 'Invalid supplier: ' || b END",
    "'medium'", "'Line needs a valid part or supplier'",
    {"l_orderkey": "l_orderkey", "l_linenumber": "l_linenumber", "a": "a", "b": "b", "l_quantity": "l_quantity"},
    where="(a IS NULL AND b IS NULL) OR (a IS NOT NULL AND p_partkey IS NULL) "
    "OR (b IS NOT NULL AND s_suppkey IS NULL)",
)
REQUIRED = _issue(
    "orders_d LEFT JOIN customer ON k = c_custkey", "'orders_d'", "'o_orderkey'", _ident(["o_orderkey"]),
    "'customer_required'",
    "CASE WHEN k IS NULL THEN 'Missing customer' ELSE 'Invalid customer: ' || k END",
    "'medium'", "'Order needs a valid customer'", {"o_orderkey": "o_orderkey", "k": "k"},
    where="k IS NULL OR c_custkey IS NULL",
)
SQL_RULE = _issue(
    "customer", "'customer'", "'c_custkey'", _ident(["c_custkey"]), "'negative_balance'",
    "'Balance ' || CAST(CAST(c_acctbal AS DECIMAL(18,2)) AS VARCHAR) || ' is below zero'", "'low'",
    "'Customers in debt'", {"c_custkey": "c_custkey", "c_mktsegment": "c_mktsegment"},
    where="c_acctbal < 0",
)
RULE_ISSUES = _union([STATUS, RETENTION, ANY, REQUIRED, SQL_RULE])


def _with(issues: str, query: str, profile: bool = True, more: str = "") -> str:
    ctes = [INPUTS] + ([PROFILE] if profile else []) + [f"issues AS ({issues})"]
    return "WITH " + ",\n".join(ctes) + more + "\n" + query


ALL = _union([PROFILE_ISSUES, RULE_ISSUES])
GROUP = "ISSUE_TYPE, RULE_NAME, TABLE_NAME"


def _combined(query: str, more: str = "") -> str:
    return _with(ALL, query, more=more)


SAMPLES = (
    ", samples AS (SELECT * FROM (SELECT *, CAST(row_number() OVER (PARTITION BY ISSUE_TYPE, RULE_NAME, TABLE_NAME "
    "ORDER BY ROW_IDENTIFIER, ISSUE_DETAIL, SORT_VALUES) AS INTEGER) AS SAMPLE_NO FROM issues) WHERE SAMPLE_NO <= 5)"
)


def _row_json() -> str:
    """A sample row as JSON, absent fields left out, in the order of the issue table."""
    def field(name, value):
        return f"CASE WHEN {value} IS NULL THEN '' ELSE ',\"{name}\":' || {value} END"

    texts = ["TABLE_NAME", "PRIMARY_KEY", "ROW_IDENTIFIER", "ISSUE_TYPE", "ISSUE_DETAIL", "SEVERITY",
             "RULE_NAME", "COLUMN_NAME"]
    parts = [field(n, f"CAST(to_json({n}) AS VARCHAR)") for n in texts]
    parts.append(field("NULL_RATE", "CAST(NULL_RATE AS VARCHAR)"))
    parts.append(field("ROW_VALUES", "ROW_VALUES"))
    return "'{\"DATABASE\":\"spark_catalog\",\"SCHEMA\":\"census\"' || " + " || ".join(parts) + " || '}'"


CONTRACT = (
    "Answer with one JSON object and nothing else: no markdown, no code fences.\n"
    'Its keys are exactly "llm_summary" (the problem in one sentence), '
    '"business_impact" (the risk it creates for the business), '
    '"recommended_fix" (concrete steps that resolve it) and '
    '"governance_note" (what matters for compliance or governance).'
)

PROMPTS = f"""
SELECT {GROUP},
       concat_ws(chr(10), 'You review data quality findings for a governance team.',
                 'Table: ' || TABLE_NAME, 'Kind of issue: ' || ISSUE_TYPE, 'Rule: ' || RULE_NAME,
                 'Severity: ' || min(SEVERITY),
                 'Sample rows as JSON: [' || string_agg({_row_json()}, ',' ORDER BY SAMPLE_NO) || ']',
                 {_text(CONTRACT)}) AS PROMPT
FROM samples GROUP BY {GROUP}"""

_DUPLICATE_COUNTS = _union(
    f"SELECT '{t}' AS TABLE_NAME, count(*) AS n FROM "
    f"(SELECT 1 FROM {t} GROUP BY {', '.join(KEYS[t])} HAVING count(*) > 1)"
    for t in SCANNED
)
_KEY_LISTS = _union(
    f"SELECT '{t}' AS TABLE_NAME, '{_key_text(t)}' AS PRIMARY_KEYS, {_text(repr(KEYS[t]))} AS key_list" for t in SCANNED
)
TABLE_PROFILES = f"""
, duplicates AS ({_DUPLICATE_COUNTS}), key_lists AS ({_KEY_LISTS}),
flags AS (SELECT TABLE_NAME, ORDINAL_POSITION, COLUMN_NAME || ': ' || {FLAG_TEXT} AS txt
          FROM profile WHERE NULL_RATE > 0.05),
sizes AS (SELECT TABLE_NAME, max(TOTAL_ROWS) AS ROW_COUNT FROM profile GROUP BY TABLE_NAME),
group_texts AS (SELECT TABLE_NAME, 'Found ' || n || ' duplicate primary key group(s) on ' || key_list AS txt
                FROM duplicates JOIN key_lists USING (TABLE_NAME) WHERE n > 0),
column_texts AS (SELECT TABLE_NAME, count(*) AS n, string_agg(txt, '; ' ORDER BY ORDINAL_POSITION) AS txt,
                        string_agg('- ' || txt, chr(10) ORDER BY ORDINAL_POSITION) AS bullets
                 FROM flags GROUP BY TABLE_NAME),
table_profiles AS (
  SELECT s.TABLE_NAME, ROW_COUNT, PRIMARY_KEYS, coalesce(c.n, 0) AS COLUMN_ISSUE_COUNT,
         CAST(CASE WHEN g.txt IS NULL THEN 0 ELSE 1 END AS BIGINT) AS TABLE_ISSUE_COUNT,
         coalesce(nullif(concat_ws('; ', g.txt, c.txt), ''), 'None') AS ISSUES,
         coalesce(c.bullets, '- None') AS column_bullets, coalesce('- ' || g.txt, '- None') AS table_bullets
  FROM sizes s JOIN key_lists k ON s.TABLE_NAME = k.TABLE_NAME
  LEFT JOIN group_texts g ON s.TABLE_NAME = g.TABLE_NAME LEFT JOIN column_texts c ON s.TABLE_NAME = c.TABLE_NAME)
"""


def _explained(kind: str, table: str, severity: str, rule: str) -> dict[str, str]:
    return {
        "llm_summary": f"{kind} || ' in ' || {table}",
        "business_impact": f"'Severity ' || {severity}",
        "recommended_fix": f"'Correct the rows found by: ' || {rule}",
        "governance_note": f"'Record the correction of ' || {table}",
    }


ANSWER = _explained("ISSUE_TYPE", "TABLE_NAME", "SEVERITY", "RULE_NAME")
ANSWER_JSON = "'{' || " + " || ', ' || ".join(f"'\"{k}\": \"' || {v} || '\"'" for k, v in ANSWER.items()) + " || '}'"
LLM_COLUMNS = {
    "llm_summary": "LLM_SUMMARY",
    "business_impact": "LLM_BUSINESS_IMPACT",
    "recommended_fix": "LLM_RECOMMENDED_FIX",
    "governance_note": "LLM_GOVERNANCE_NOTE",
}

FENCE = "(?is)```(?:json)?\\s*(.*?)\\s*```"
EXTRACT = f"""
WITH answers AS ({as_sql("events_answers")}),
bodies AS (SELECT *, CASE WHEN regexp_matches(RESPONSE, '{FENCE}')
                          THEN regexp_extract(RESPONSE, '{FENCE}', 1)
                          ELSE regexp_replace(RESPONSE, '^\\s+|\\s+$', '', 'g') END AS body FROM answers),
spans AS (SELECT *, instr(body, '{{') AS first_brace,
                 CASE WHEN instr(body, '}}') = 0 THEN 0
                      ELSE length(body) - instr(reverse(body), '}}') + 1 END AS last_brace FROM bodies),
texts AS (SELECT *, CASE WHEN first_brace > 0 AND last_brace > first_brace
                         THEN substr(body, first_brace, last_brace - first_brace + 1)
                         ELSE body END AS json FROM spans)
"""


def _parsed(key: str, fallback: str) -> str:
    value = f"coalesce(json_extract_string(json, '$.{key}'), '')"
    # json_valid lets a trailing comma pass, which is not JSON.
    valid = "json_valid(json) AND json LIKE '{%' AND NOT regexp_matches(json, ',\\s*}')"
    return f"CASE WHEN {valid} THEN {value} ELSE {fallback} END AS {LLM_COLUMNS[key]}"


PARSED = (
    EXTRACT
    + "SELECT event_id, ISSUE_TYPE, RULE_NAME, "
    + ", ".join(
        [
            _parsed("llm_summary", "RESPONSE"),
            _parsed("business_impact", "''"),
            _parsed("recommended_fix", "'Review issue manually; LLM response was not structured JSON.'"),
            _parsed("governance_note", "'Issue: ' || ISSUE_TYPE || ' / ' || RULE_NAME"),
        ]
    )
    + " FROM texts"
)


def _distinct_rows(table: str) -> list[str]:
    return [
        f"SELECT '{table}' AS TABLE_NAME, '{c}' AS COLUMN_NAME, count(DISTINCT {c}) AS DISTINCT_COUNT FROM {table}"
        for c in PROJECTIONS[table]
    ]


def _inputs(query: str) -> str:
    return f"WITH {INPUTS}, {PROFILE}\n{query}"


# The names of the metrics, as reports carry them.
METRICS = """
SELECT 'Total row-level issues' AS Metric, CAST(count(*) AS VARCHAR) AS Value FROM issues
UNION ALL SELECT 'Tables scanned', CAST(count(DISTINCT TABLE_NAME) AS VARCHAR) FROM profile
UNION ALL SELECT 'Critical issues', CAST(count(*) FILTER (SEVERITY = 'critical') AS VARCHAR) FROM issues
UNION ALL SELECT 'High severity issues', CAST(count(*) FILTER (SEVERITY = 'high') AS VARCHAR) FROM issues
UNION ALL SELECT 'Report generated', '2025-01-01T00:00:00'"""

# A whole scan also profiles the three raw tables its rules look into. Their key is the
# first column, and they hold neither nulls nor repeated keys.
SCAN_EXTRA = ("customer", "part", "supplier")
_EXTRA_KEYS = {"customer": ["c_custkey"], "part": ["p_partkey"], "supplier": ["s_suppkey"]}
SCAN_ISSUES = _union([ALL, *[_duplicates(t, t, _EXTRA_KEYS[t]) for t in SCAN_EXTRA]])

_LINE_GROUPS = "SELECT l_orderkey, l_linenumber, count(*) AS DUPLICATE_COUNT FROM lineitem GROUP BY ALL HAVING count(*) > "

REPORT_METRICS = METRICS.replace("count(DISTINCT TABLE_NAME)", f"count(DISTINCT TABLE_NAME) + {len(SCAN_EXTRA)}")


def _schema_scan() -> str:
    """Row count, keys and findings of every given table; none of them holds a null."""
    keys = {**{t: columns.split()[:1] for t, columns in RAW.items()}, "conversations": ["conv_id", "turn"]}
    keys["lineitem"] = ["l_orderkey", "l_linenumber"]
    parts = []
    for t, own in keys.items():
        groups = f"(SELECT count(*) FROM (SELECT 1 FROM {t} GROUP BY {', '.join(own)} HAVING count(*) > 1))"
        rule = "(SELECT count(*) FROM customer WHERE c_acctbal < 0)" if t == "customer" else "0"
        parts.append(
            f"SELECT '{t}' AS TABLE_NAME, count(*) AS ROW_COUNT, '{', '.join(own)}' AS PRIMARY_KEYS, "
            f"CAST(0 AS BIGINT) AS COLUMN_ISSUE_COUNT, CAST({groups} > 0 AS BIGINT) AS TABLE_ISSUE_COUNT, "
            f"CASE WHEN {groups} > 0 THEN 'Found ' || {groups} || ' duplicate primary key group(s) on ' || {_text(repr(own))} "
            f"ELSE 'None' END AS ISSUES, {groups} + {rule} AS ISSUES_FOUND FROM {t}"
        )
    return _union(parts)


SCHEMA_SCAN = _schema_scan()


def _distincts(table: str, columns, source: str | None = None, label: str | None = None) -> str:
    return _union(
        f"SELECT '{label or table}' AS TABLE_NAME, '{c}' AS COLUMN_NAME, count(DISTINCT {c}) AS DISTINCT_COUNT FROM {source or table}"
        for c in columns
    )


LEFT_OVER = f"(SELECT * FROM orders_d WHERE NOT ({GONE}))"

STORED_ORACLES = {
    "incremental_profile": f"WITH {INPUTS} "
    + _union(
        f"{row.replace('FROM orders_d', f'FROM {LEFT_OVER}')}" for row in (
            r.replace("AS NULL_RATE", "AS NULL_RATE, " + ("max(o_orderdate)" if "'o_orderdate'" in r else "CAST(NULL AS TIMESTAMP)") + " AS LAST_UPDATED")
            for r in _profile_rows("orders_d")
        )
    ),
    "incremental_distincts": f"WITH {INPUTS} SELECT *, TRUE AS CLOSE FROM ({_distincts('orders_d', PROJECTIONS['orders_d'], LEFT_OVER)})",
    "distinct_bitmaps": _union(_distincts(t, RAW[t].split()) for t in ("lineitem", "orders", "events")),
    "distinct_bitmaps_rollup": _union(
        f"SELECT {slice_} AS SLICE, '{c}' AS COLUMN_NAME, count(DISTINCT {c}) AS DISTINCT_COUNT FROM lineitem GROUP BY 1"
        for c in ROLLED_UP
        for slice_ in ("strftime(l_shipdate, '%Y')", "'lineitem'")
    ),
    "distinct_sketches": f"SELECT *, TRUE AS CLOSE, TRUE AS AGREES FROM ({_distincts('lineitem', RAW['lineitem'].split())})",
    "duplicate_keys_prefiltered_lines": _LINE_GROUPS + "1",
    "apply_corrections_stored": f"SELECT o_orderkey, o_custkey, CASE WHEN {CORRECTED} THEN 'X' ELSE o_orderstatus END AS o_orderstatus, "
    f"CASE WHEN {CORRECTED} THEN NULL ELSE o_totalprice END AS o_totalprice, o_orderdate, o_orderpriority FROM orders",
    "insert_missing_stored": "SELECT * FROM orders",
    "rule_row_position": "SELECT 'bulk_line' AS ISSUE_TYPE, 'lines' AS TABLE_NAME, '' AS PRIMARY_KEY, CAST(n AS BIGINT) AS ROW_INDEX "
    "FROM (SELECT *, row_number() OVER () - 1 AS n FROM lineitem) WHERE l_quantity = 50",
    "partitioned_profile": f"WITH {INPUTS}, partitioned AS (SELECT *, year(o_orderdate) AS y, nullif(o_orderstatus, 'P') AS s FROM orders_d) "
    + _union(
        f"SELECT 'orders_d' AS TABLE_NAME, '{c}' AS COLUMN_NAME, {i} AS ORDINAL_POSITION, count(*) AS TOTAL_ROWS, "
        f"count(*) - count({c}) AS NULL_COUNT, (count(*) - count({c})) / greatest(count(*), 1) AS NULL_RATE FROM partitioned"
        for i, c in enumerate([*PROJECTIONS["orders_d"], "y", "s"], start=1)
    ),
    "partitioned_staleness": _union(
        f"SELECT '{name}' AS TABLE_NAME, {newest} AS LAST_UPDATED, {newest} < TIMESTAMP '2024-02-15' - INTERVAL 90 DAY AS IS_STALE FROM {source}"
        for name, source, newest in (
            ("orders", "orders", "CAST(CAST(max(o_orderdate) AS DATE) AS TIMESTAMP)"),
            ("lines", "lineitem", "CAST(date_trunc('month', max(l_shipdate)) AS TIMESTAMP)"),
        )
    ),
    "stored_answers": f"WITH {INPUTS}, prompts AS (SELECT o_orderstatus, 'Orders in state ' || o_orderstatus || ': ' || count(*) AS PROMPT "
    "FROM orders_d GROUP BY o_orderstatus) SELECT *, CASE o_orderstatus WHEN 'P' THEN 'late' ELSE 'early' END || ': ' || PROMPT AS RESPONSE, "
    "CAST(NULL AS VARCHAR) AS ERROR FROM prompts",
    "duplicate_keys_nearly_unique": "SELECT user_id, ts, event_type, props, count(*) AS DUPLICATE_COUNT FROM events "
    "GROUP BY ALL HAVING count(*) > 1",
}

ORACLES: dict[str, str] = {
    **STORED_ORACLES,
    "list_tables": _union(
        f"SELECT '{t}' AS TABLE_NAME, count(*) AS ROW_COUNT FROM {t}" for t in RAW if t != "embeddings"
    ),
    "row_counts": _union(f"SELECT '{t}' AS TABLE_NAME, count(*) AS ROW_COUNT FROM {t}" for t in RAW),
    "column_metadata": _inputs(
        "SELECT TABLE_NAME, COLUMN_NAME, DATA_TYPE, CASE WHEN NULL_COUNT > 0 THEN 'YES' ELSE 'NO' END AS IS_NULLABLE, "
        "ORDINAL_POSITION FROM profile WHERE TABLE_NAME = 'events_d'"
    ),
    "resolve_keys": _union(
        f"SELECT '{t}' AS TABLE_NAME, '{keys}' AS PRIMARY_KEYS"
        for t, keys in {
            **{name: columns.split()[0] for name, columns in RAW.items()},
            "labels": "doc_id, quality",
            "conversations": "conv_id, turn",
            "lineitem": "l_orderkey, l_linenumber",
        }.items()
    ),
    "infer_keys": _inputs(
        "SELECT 'nulls_in_first_id' AS TABLE_NAME, CASE WHEN count(*) = count(u) THEN 'user_id' ELSE 'event_id' END "
        "AS PRIMARY_KEYS FROM events_d "
        "UNION ALL SELECT 'nulls_in_only_key', CASE WHEN count(*) = count(k) THEN 'cust_key' ELSE 'o_orderstatus' END "
        "FROM orders_d UNION ALL SELECT 'pages', 'page_id' UNION ALL SELECT 'region', 'r_regionkey'"
    ),
    "scan_tables": _union(
        f"SELECT '{t}' AS TABLE_NAME, '{c}' AS COLUMN_NAME, count(*) AS TOTAL_ROWS, "
        f"count(*) - count({c}) AS NULL_COUNT FROM {t}"
        for t, columns in RAW.items()
        for c in columns.split()
    ),
    "param_query": "SELECT o_orderstatus, count(*) AS n_orders, max(o_orderkey) AS last_order FROM orders "
    "WHERE o_totalprice > 100000.0 AND o_orderpriority = '1-URGENT' GROUP BY o_orderstatus",
    "null_profile": _inputs("SELECT * FROM profile"),
    "distinct_profile": _inputs(_union(_distinct_rows("events_d") + _distinct_rows("lineitem_d"))),
    "high_null_rate": _inputs(
        f"SELECT TABLE_NAME, COLUMN_NAME, NULL_RATE, {FLAG_TEXT} AS ISSUE FROM profile WHERE NULL_RATE > 0.05"
    ),
    "null_rate_report": _inputs(
        "SELECT TABLE_NAME || '.' || COLUMN_NAME AS col, NULL_RATE AS null_rate FROM profile "
        "WHERE TABLE_NAME || '.' || COLUMN_NAME IN "
        "('events_d.et', 'events_d.v', 'events_d.u', 'customer_d.segment', 'orders_d.k')"
    ),
    "duplicate_keys": _LINE_GROUPS + "1",
    "duplicate_keys_threshold": _LINE_GROUPS + "2",
    "duplicate_keys_null": _inputs("SELECT k, count(*) AS DUPLICATE_COUNT FROM orders_d GROUP BY k HAVING count(*) > 1"),
    "duplicate_key_issues": _with(
        _duplicates("lineitem", "lineitem", ["l_orderkey", "l_linenumber"]), _shown(), profile=False
    ),
    "stale_tables": _union(
        f"SELECT '{t}' AS TABLE_NAME, max({c}) AS LAST_UPDATED, "
        f"max({c}) < TIMESTAMP '2024-02-15' - INTERVAL 90 DAYS AS IS_STALE FROM {t}"
        for t, c in {"orders": "o_orderdate", "lineitem": "l_shipdate", "events": "ts"}.items()
    ),
    "profile_issues": _with(PROFILE_ISSUES, _shown()),
    "table_profiles": _inputs("").rstrip()
    + TABLE_PROFILES
    + "SELECT TABLE_NAME, ROW_COUNT, PRIMARY_KEYS, COLUMN_ISSUE_COUNT, TABLE_ISSUE_COUNT, ISSUES FROM table_profiles",
    "rule_status_measure": _with(STATUS, _shown(), profile=False),
    "rule_retention": _with(RETENTION, _shown(), profile=False),
    "rule_any_reference": _with(ANY, _shown(), profile=False),
    "rule_required_reference": _with(REQUIRED, _shown(), profile=False),
    "rule_negative_control": _with(
        ANY,
        "SELECT count(*) FILTER (CAST(json_extract_string(ROW_VALUES, '$.l_quantity') AS DOUBLE) BETWEEN 6 AND 29 "
        "AND NOT ends_with(ROW_IDENTIFIER, ' | 7')) AS clean_rows_flagged, count(*) AS rows_flagged FROM issues",
        profile=False,
    ),
    "rule_row_identifier": _with(
        _issue(
            "lineitem_d", "'lineitem_d'", "'l_orderkey, l_linenumber, b'", _ident(["l_orderkey", "l_linenumber", "b"]),
            "'bulk_line'", "'bulk_line'", "'medium'", "'bulk_line'", {}, where="l_quantity = 50",
        ),
        _shown(),
        profile=False,
    ),
    "rule_defaults": _with(
        _issue(
            "customer_d", "'UNKNOWN'", "'c_custkey'", _ident(["c_custkey"]), "'bare_rule'", "'bare_rule'", "'medium'",
            "'bare_rule'", {}, where="balance < 0",
        ),
        _shown(),
        profile=False,
    ),
    "run_sql_rule": _with(SQL_RULE, _shown("'spark_catalog' AS DATABASE, " + ", ".join(SHOWN)), profile=False),
    "run_all_rules": _with(RULE_ISSUES, _shown(), profile=False),
    "rule_error": "SELECT DISTINCT 'bad_cast' AS ISSUE_TYPE, 'high' AS SEVERITY, 'RULE_ERROR' AS ROW_IDENTIFIER, "
    "'orders' AS TABLE_NAME, 'bad_cast' AS RULE_NAME FROM orders WHERE TRY_CAST(o_orderpriority AS INTEGER) IS NULL",
    "combined_issues": _combined(
        _shown("'spark_catalog' AS DATABASE, 'census' AS SCHEMA, " + ", ".join(SHOWN))
    ),
    "widened_issues": _combined(
        "SELECT TABLE_NAME, ISSUE_TYPE, ROW_IDENTIFIER, "
        + ", ".join(f"json_extract_string(ROW_VALUES, '$.{c}') AS {c}" for c in ("k", "a", "b", "c_custkey"))
        + " FROM issues"
    ),
    "rule_summary": _combined(
        "SELECT ISSUE_TYPE, RULE_NAME, SEVERITY, count(*) AS ISSUE_COUNT FROM issues GROUP BY ALL"
    ),
    "severity_counts": _combined(
        "SELECT SEVERITY, count(*) AS ISSUE_COUNT, CASE SEVERITY WHEN 'critical' THEN 1 WHEN 'high' THEN 2 "
        "WHEN 'medium' THEN 3 WHEN 'low' THEN 4 ELSE 5 END AS SEVERITY_RANK FROM issues GROUP BY SEVERITY"
    ),
    "overview": _combined(METRICS),
    "run_result": _combined(
        "SELECT 'report' AS output_path, CAST(4 AS BIGINT) AS tables_scanned, count(*) AS total_issues FROM issues"
    ),
    "full_scan": _with(SCAN_ISSUES, _shown()),
    "issue_groups": _combined(
        f"SELECT {GROUP}, count(*) AS ISSUE_COUNT, min(SEVERITY) AS SEVERITY FROM issues GROUP BY {GROUP}"
    ),
    "issue_samples": _combined(
        f"SELECT {GROUP}, SAMPLE_NO, ROW_IDENTIFIER, ISSUE_DETAIL, SEVERITY FROM samples", SAMPLES
    ),
    "issue_prompts": _combined(PROMPTS, SAMPLES),
    "table_prompts": _inputs("").rstrip()
    + TABLE_PROFILES
    + "SELECT TABLE_NAME, concat_ws(chr(10), 'Describe the data quality of the table ' || TABLE_NAME "
    "|| ' for a governance report.', 'Rows: ' || ROW_COUNT, 'Issues in columns:', column_bullets, "
    "'Issues of the table itself:', table_bullets, 'Write two or three specific sentences, without bullet points.') "
    "AS PROMPT FROM table_profiles WHERE COLUMN_ISSUE_COUNT + TABLE_ISSUE_COUNT > 0",
    "enrich_template": _combined(
        f"SELECT {GROUP}, {ANSWER_JSON} AS RESPONSE, CAST(NULL AS VARCHAR) AS ERROR "
        f"FROM (SELECT DISTINCT {GROUP}, SEVERITY FROM issues)"
    ),
    "extract_json": EXTRACT + "SELECT event_id, json FROM texts",
    "parse_responses": PARSED,
    "attach_enrichment": _combined(
        f"SELECT {GROUP}, ROW_IDENTIFIER, "
        + ", ".join(f"{v} AS {LLM_COLUMNS[k]}" for k, v in ANSWER.items())
        + " FROM issues"
    ),
    "report_datasets": _with(
        SCAN_ISSUES,
        f"SELECT 'Overview' AS dataset, Metric AS item, Value AS content FROM ({REPORT_METRICS}) "
        "UNION ALL SELECT 'Rule_Summary', concat_ws('/', ISSUE_TYPE, RULE_NAME, SEVERITY), CAST(count(*) AS VARCHAR) "
        "FROM issues GROUP BY ISSUE_TYPE, RULE_NAME, SEVERITY "
        "UNION ALL SELECT 'Table_Profiles', concat_ws('/', TABLE_NAME, ROW_COUNT, PRIMARY_KEYS), ISSUES FROM table_profiles "
        + "".join(
            f"UNION ALL SELECT 'Table_Profiles', concat_ws('/', '{t}', count(*), '{keys[0]}'), 'None' FROM {t} "
            for t, keys in _EXTRA_KEYS.items()
        )
        + "UNION ALL SELECT 'Row_Issues', concat_ws('/', ISSUE_TYPE, TABLE_NAME, ROW_IDENTIFIER, ISSUE_DETAIL, SEVERITY), "
        "ISSUE_TYPE || ' in ' || TABLE_NAME FROM issues "
        "UNION ALL SELECT 'LLM_Table_Summaries', TABLE_NAME, 'Describe the data quality of the table ' || TABLE_NAME || "
        "' for a governance report.' FROM table_profiles WHERE COLUMN_ISSUE_COUNT + TABLE_ISSUE_COUNT > 0",
        more=TABLE_PROFILES,
    ),
    "distinct_profile_approx": _inputs(
        f"SELECT TABLE_NAME, COLUMN_NAME, DISTINCT_COUNT, TRUE AS CLOSE FROM ({_union(_distinct_rows('lineitem_d'))})"
    ),
    "distinct_profile_wide": _union(
        f"SELECT 'lineitem' AS TABLE_NAME, '{c}' AS COLUMN_NAME, count(DISTINCT {c}) AS DISTINCT_COUNT FROM lineitem"
        for c in RAW["lineitem"].split()
    ),
    "zero_column_table": _inputs("").rstrip()
    + TABLE_PROFILES
    + "SELECT TABLE_NAME, ROW_COUNT, PRIMARY_KEYS, COLUMN_ISSUE_COUNT, TABLE_ISSUE_COUNT, ISSUES FROM table_profiles "
    "WHERE TABLE_NAME = 'events_d' UNION ALL SELECT 'bare', count(*), '', 0, 1, 'No columns found in INFORMATION_SCHEMA' "
    "FROM orders",
    "enrich_failure": _combined(
        f"SELECT {GROUP}, CASE WHEN ISSUE_TYPE = 'high_null_rate' THEN '' ELSE {ANSWER['llm_summary']} END AS LLM_SUMMARY, "
        "CASE WHEN ISSUE_TYPE = 'high_null_rate' THEN 'ValueError: refused' END AS LLM_ERROR, count(*) AS n_rows "
        f"FROM issues GROUP BY {GROUP}"
    ),
    "empty_report": "SELECT 'Rule_Summary' AS dataset, 'No issues found' AS content "
    "UNION ALL SELECT 'LLM_Table_Summaries', 'No issues found' "
    + "".join(f"UNION ALL SELECT '{t}', CAST(count(*) AS VARCHAR) FROM {t} " for t in ("customer", "part", "documents")),
    "schema_scan": SCHEMA_SCAN,
    "insert_missing": "SELECT doc_id, quality, toxic FROM labels UNION ALL SELECT doc_id, 0, 0 FROM documents "
    "WHERE doc_id NOT IN (SELECT doc_id FROM labels)",
    "apply_corrections": "SELECT c_custkey, CASE WHEN c_acctbal < 0 THEN 'Corrected ' || c_name ELSE c_name END AS c_name, "
    "c_nationkey, c_acctbal, CASE WHEN c_acctbal < 0 THEN NULL ELSE c_mktsegment END AS c_mktsegment FROM customer",
    "ensure_column": "SELECT *, CAST(NULL AS VARCHAR) AS rm_code FROM supplier",
}

ORACLES["resumed_scan"] = ORACLES["full_scan"]
