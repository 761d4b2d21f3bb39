"""One query per operator, over the given tables or the inputs derived from them."""

from __future__ import annotations

import uuid
from collections.abc import Callable
from functools import partial, reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rowcensus.functions.text import json_text
from rowcensus.operators import profile as P
from rowcensus.operators import summary as S
from rowcensus.operators import upkeep as U
from rowcensus.operators.builders import (
    Reference,
    any_valid_reference,
    required_reference,
    retention_cutoff,
    status_measure,
)
from rowcensus.operators.issues import combine_issues, stamp, widen_issues
from rowcensus.operators.rules import Rule, run_rule, run_rules
from rowcensus.plans import enrich as E
from rowcensus.plans.report import write_report
from rowcensus.plans.scan import ScanOptions, scan, scan_schema, stored_profile, table_keys
from rowcensus.sources import catalog as C
from rowcensus.sources.footers import parquet_location
from rowcensus.sources.resume import ResumableStage
from rowcensus.sources.staging import Stage

from .inputs import KEYS, SCANNED, TABLES, derived, derived_tables, registered, scanned_and_references, table
from .stored import STORED

DATABASE = "spark_catalog"
SHOWN = (
    "TABLE_NAME", "PRIMARY_KEY", "ROW_IDENTIFIER", "ISSUE_TYPE", "ISSUE_DETAIL",
    "SEVERITY", "RULE_NAME", "COLUMN_NAME", "NULL_RATE",
)

STATUS_RULE = status_measure(
    id="closed_with_price",
    name="Closed orders with a price",
    severity="high",
    table="orders_d",
    primary_key=("o_orderkey",),
    status="o_orderstatus",
    value="F",
    measure="price",
    # Names count in any case, and the key is not listed twice.
    payload=("O_ORDERKEY", "o_orderstatus", "Price"),
    detail="Order is closed but price = ",
)
RETENTION_RULE = retention_cutoff(
    id="old_order_kept",
    name="Orders before 1996 should be gone",
    severity="high",
    table="orders_d",
    primary_key=("o_orderkey",),
    created="o_orderdate",
    cutoff="1996-01-01",
    deleted="deleted",
    before="Order of ",
    after=" still present",
)
ANY_RULE = any_valid_reference(
    id="part_or_supplier",
    name="Line needs a valid part or supplier",
    table="lineitem_d",
    primary_key=("l_orderkey", "l_linenumber"),
    payload=("a", "b", "l_quantity"),
    refs=(
        Reference("a", "part", "p_partkey", "p_partkey", "Invalid part: "),
        Reference("b", "supplier", "s_suppkey", "s_suppkey", "Invalid supplier: "),
    ),
    missing="Missing part and supplier",
)
REQUIRED_RULE = required_reference(
    id="customer_required",
    name="Order needs a valid customer",
    table="orders_d",
    primary_key=("o_orderkey",),
    ref=Reference("k", "customer", "c_custkey", "c_custkey", "Invalid customer: "),
    missing="Missing customer",
)
SQL_RULE = Rule(
    id="negative_balance",
    name="Customers in debt",
    description="Balances should not be negative",
    severity="low",
    table="customer",
    primary_key=("c_custkey",),
    sql="""
        SELECT c_custkey, c_mktsegment, 'negative_balance' AS ISSUE_TYPE,
               concat('Balance ', CAST(CAST(c_acctbal AS DECIMAL(18,2)) AS STRING), ' is below zero') AS ISSUE_DETAIL
        FROM {database}.{schema}.customer
        WHERE c_acctbal < 0
    """,
)
RULES = (
    STATUS_RULE,
    RETENTION_RULE,
    ANY_RULE,
    REQUIRED_RULE,
    SQL_RULE,
    Rule(id="switched_off", sql="SELECT nothing", enabled=False),
    Rule(id="duplicate_primary_key", dynamic=True),
)


def _lookup(spark: SparkSession, sf: str):
    return scanned_and_references(spark, sf).__getitem__


def _rule_issues(spark: SparkSession, sf: str, known: dict[str, DataFrame]) -> DataFrame:
    return run_rules(spark, RULES, DATABASE, registered(spark, sf), known)


def _combined(spark: SparkSession, sf: str) -> DataFrame:
    known = scanned_and_references(spark, sf)
    found = P.profile_issues({name: known[name] for name in SCANNED}, KEYS)
    return combine_issues(spark, [found, _rule_issues(spark, sf, known)])


def _shown(issues: DataFrame) -> DataFrame:
    return issues.select(*SHOWN)


def _one_rule(spark: SparkSession, sf: str, rule: Rule) -> DataFrame:
    return _shown(run_rule(spark, rule, DATABASE, "census", _lookup(spark, sf)))


def list_tables(spark, sf):
    schema = registered(spark, sf)
    names = C.list_tables(spark, schema, exclude=["Embeddings"])
    return P.row_counts({n: spark.table(C.table_ref(schema, n)) for n in names})


def column_metadata(spark, sf):
    df = derived(spark, sf, "events_d")
    return C.column_metadata(df, "events_d", P.null_profile(df, "events_d"))


def _key_rows(spark, keys):
    rows = [(name, ", ".join(names)) for name, names in keys.items()]
    return spark.createDataFrame(rows, "TABLE_NAME string, PRIMARY_KEYS string")


def resolve_keys(spark, sf):
    schema = registered(spark, sf)
    tables = C.load_tables(spark, DATABASE, schema)
    declared = {name: C.declared_keys(spark, DATABASE, schema, name) for name in tables}
    overrides = {"LABELS": ["doc_id", "quality"]}
    return _key_rows(spark, table_keys(tables, P.null_profiles(tables), overrides, declared))


def infer_keys(spark, sf):
    events, orders = derived(spark, sf, "events_d"), derived(spark, sf, "orders_d")
    tables = {
        "nulls_in_first_id": events.selectExpr("u AS user_id", "event_id", "v"),
        "nulls_in_only_key": orders.selectExpr("o_orderstatus", "k AS cust_key"),
        "pages": table(spark, sf, "pages"),
        "region": table(spark, sf, "region"),
    }
    return _key_rows(spark, table_keys(tables, P.null_profiles(tables)))


def row_counts(spark, sf):
    return P.row_counts({name: table(spark, sf, name) for name in TABLES})


def scan_tables(spark, sf):
    schema = registered(spark, sf)
    tables = C.load_tables(spark, DATABASE, schema)
    paths = {name: parquet_location(spark, DATABASE, schema, name) for name in tables}
    profile = stored_profile(spark, tables, paths, Stage(spark))
    return profile.select("TABLE_NAME", "COLUMN_NAME", "TOTAL_ROWS", "NULL_COUNT")


def param_query(spark, sf):
    sql = f"""
        SELECT o_orderstatus, count(*) AS n_orders, max(o_orderkey) AS last_order
        FROM {C.table_ref(DATABASE, registered(spark, sf), 'orders')}
        WHERE o_totalprice > :floor AND o_orderpriority = :priority
        GROUP BY o_orderstatus
    """
    return C.bound_query(spark, sql, {"floor": 100000.0, "priority": "1-URGENT"})


def null_profile(spark, sf):
    return P.null_profiles(derived_tables(spark, sf))


def distinct_profile(spark, sf):
    return P.distinct_profile(derived(spark, sf, "events_d"), "events_d").unionByName(
        P.distinct_profile(derived(spark, sf, "lineitem_d"), "lineitem_d")
    )


def distinct_profile_approx(spark, sf):
    """Whether each estimate lies within three times its standard deviation of the exact count."""
    df, rsd = derived(spark, sf, "lineitem_d"), 0.05
    close = P.distinct_profile(df, "lineitem_d", method="approx", rsd=rsd).withColumnRenamed("DISTINCT_COUNT", "ESTIMATE")
    both = P.distinct_profile(df, "lineitem_d").join(close, ["TABLE_NAME", "COLUMN_NAME"])
    return both.selectExpr(
        "TABLE_NAME", "COLUMN_NAME", "DISTINCT_COUNT", f"abs(ESTIMATE - DISTINCT_COUNT) <= 3 * {rsd} * DISTINCT_COUNT AS CLOSE"
    )


def distinct_profile_wide(spark, sf):
    """One scan per data type instead of chunks of columns."""
    return P.distinct_profile(table(spark, sf, "lineitem"), "lineitem", wide=4)


def zero_column_table(spark, sf):
    tables = {"bare": table(spark, sf, "orders").select(), "events_d": derived(spark, sf, "events_d")}
    profile = P.null_profile(tables["events_d"], "events_d")
    rows = P.table_profiles(tables, {"events_d": KEYS["events_d"]}, profile)
    return rows.drop("COLUMN_ISSUES", "TABLE_ISSUES")


def high_null_rate(spark, sf):
    flagged = P.high_null_columns(null_profile(spark, sf))
    return flagged.select("TABLE_NAME", "COLUMN_NAME", "NULL_RATE", "ISSUE")


def null_rate_report(spark, sf):
    picks = {"events_d": ["et", "v", "u"], "customer_d": ["segment"], "orders_d": ["k"]}
    return P.null_rate_report(null_profile(spark, sf), picks)


def duplicate_keys(spark, sf):
    return P.duplicate_keys(table(spark, sf, "lineitem"), ["l_orderkey", "l_linenumber"])


def duplicate_keys_null(spark, sf):
    return P.duplicate_keys(derived(spark, sf, "orders_d"), ["k"])


def duplicate_keys_threshold(spark, sf):
    return P.duplicate_keys(table(spark, sf, "lineitem"), ["l_orderkey", "l_linenumber"], max_extra=1)


def duplicate_key_issues(spark, sf):
    return _shown(P.duplicate_key_issues(table(spark, sf, "lineitem"), "lineitem", ["l_orderkey", "l_linenumber"]))


def stale_tables(spark, sf):
    stamps = {"orders": "o_orderdate", "lineitem": "l_shipdate", "events": "ts"}
    return P.stale_tables({t: (table(spark, sf, t), c) for t, c in stamps.items()}, "2024-02-15", 90)


def profile_issues(spark, sf):
    return _shown(P.profile_issues(derived_tables(spark, sf), KEYS))


def table_profiles(spark, sf):
    rows = P.table_profiles(derived_tables(spark, sf), KEYS)
    return rows.drop("COLUMN_ISSUES", "TABLE_ISSUES")


def rule_status_measure(spark, sf):
    return _one_rule(spark, sf, STATUS_RULE)


def rule_retention(spark, sf):
    return _one_rule(spark, sf, RETENTION_RULE)


def rule_any_reference(spark, sf):
    return _one_rule(spark, sf, ANY_RULE)


def rule_required_reference(spark, sf):
    return _one_rule(spark, sf, REQUIRED_RULE)


def rule_negative_control(spark, sf):
    flagged = run_rule(spark, ANY_RULE, DATABASE, "census", _lookup(spark, sf))
    quantity = F.col("ROW_VALUES")["l_quantity"].cast("double")
    untouched = quantity.between(6, 29) & ~F.col("ROW_IDENTIFIER").endswith(" | 7")
    return flagged.agg(
        F.count_if(untouched).alias("clean_rows_flagged"), F.count(F.lit(1)).alias("rows_flagged")
    )


def rule_row_identifier(spark, sf):
    rule = Rule(
        id="bulk_line", table="lineitem_d", where="l_quantity = 50", primary_key=("l_orderkey", "l_linenumber", "b")
    )
    return _one_rule(spark, sf, rule)


def rule_defaults(spark, sf):
    rule = Rule(
        id="bare_rule",
        primary_key=("c_custkey",),
        violations=lambda tables: tables("customer_d").filter("balance < 0").select("c_custkey"),
    )
    return _one_rule(spark, sf, rule)


def run_sql_rule(spark, sf):
    issues = run_rule(spark, SQL_RULE, DATABASE, registered(spark, sf))
    return issues.select("DATABASE", *SHOWN)


def run_all_rules(spark, sf):
    return _shown(_rule_issues(spark, sf, scanned_and_references(spark, sf)))


def rule_error(spark, sf):
    rule = Rule(
        id="bad_cast",
        severity="high",
        table="orders",
        primary_key=("o_orderkey",),
        sql="SELECT o_orderkey, CAST(o_orderpriority AS INT) AS p FROM {database}.{schema}.orders",
    )
    issues = run_rule(spark, rule, DATABASE, registered(spark, sf), stage=Stage(spark))
    return issues.select("ISSUE_TYPE", "SEVERITY", "ROW_IDENTIFIER", "TABLE_NAME", "RULE_NAME")


def combined_issues(spark, sf):
    return stamp(_combined(spark, sf), DATABASE, "census").select("DATABASE", "SCHEMA", *SHOWN)


def widened_issues(spark, sf):
    wide = widen_issues(_combined(spark, sf), ["k", "a", "b", "c_custkey"])
    return wide.select("TABLE_NAME", "ISSUE_TYPE", "ROW_IDENTIFIER", "k", "a", "b", "c_custkey")


def rule_summary(spark, sf):
    return S.rule_summary(_combined(spark, sf))


def severity_counts(spark, sf):
    return S.severity_counts(_combined(spark, sf))


def overview(spark, sf):
    """Profile and issues are stored once, and the metrics follow from them."""
    stage, known = Stage(spark), scanned_and_references(spark, sf)
    tables = {name: known[name] for name in SCANNED}
    profile = stored_profile(spark, tables, {}, stage)
    found = combine_issues(spark, [P.profile_issues(tables, KEYS, profile), _rule_issues(spark, sf, known)])
    counts = S.issue_counts(found)
    counts = stage.read(counts.schema, stage.write(counts, "counts"))
    return S.overview(counts, P.table_profiles(tables, KEYS, profile, counts), "2025-01-01T00:00:00")


def run_result(spark, sf):
    return S.run_result(_combined(spark, sf), len(SCANNED), "report")


def full_scan(spark, sf):
    frames = _scan(spark, sf)
    return _shown(frames["Row_Issues"])


def _scan(spark, sf, **more):
    return scan(
        spark, scanned_and_references(spark, sf), RULES, DATABASE, registered(spark, sf),
        overrides=KEYS, generated="2025-01-01T00:00:00", **more,
    )


def resumed_scan(spark, sf):
    """A scan that ends after the profile, and one of the same name that goes on from there."""
    name = f"scan-{uuid.uuid4().hex}"
    _scan(spark, sf, stage=ResumableStage(spark, name), options=ScanOptions(rules=False))
    return _shown(_scan(spark, sf, stage=ResumableStage(spark, name))["Row_Issues"])


def issue_groups(spark, sf):
    return S.issue_groups(_combined(spark, sf))


def issue_samples(spark, sf):
    stage = Stage(spark)
    return E.issue_samples(_stored_issues(spark, sf, stage), stage=stage).select(
        *S.GROUP, "SAMPLE_NO", "ROW_IDENTIFIER", "ISSUE_DETAIL", "SEVERITY"
    )


def issue_prompts(spark, sf):
    stage = Stage(spark)
    issues = stamp(_stored_issues(spark, sf, stage), DATABASE, "census")
    return E.issue_prompts(issues, stage=stage).select(*S.GROUP, "PROMPT")


def table_prompts(spark, sf):
    return E.table_prompts(P.table_profiles(derived_tables(spark, sf), KEYS))


def enrich_template(spark, sf):
    stage = Stage(spark)
    prompts = E.issue_prompts(_stored_issues(spark, sf, stage), stage=stage)
    answers = E.respond(prompts, E.template_answers())
    return answers.select(*S.GROUP, "RESPONSE", "ERROR")


def extract_json(spark, sf):
    answers = derived(spark, sf, "events_answers")
    return json_text(answers, "RESPONSE", "json").select("event_id", "json")


def parse_responses(spark, sf):
    return E.parse_responses(derived(spark, sf, "events_answers")).drop("RESPONSE")


def _stored_issues(spark, sf, stage):
    issues = _combined(spark, sf)
    return stage.read(issues.schema, stage.write_findings(issues, "issues"))


def _attached(spark, sf, respond):
    """Issues and answers are stored once, and the few answers are joined to the issues."""
    stage = Stage(spark)
    issues = _stored_issues(spark, sf, stage)
    answers = E.respond(E.issue_prompts(issues, stage=stage), respond)
    answers = stage.read(answers.schema, stage.write(answers, "answers"))
    return E.attach_texts(issues, E.parse_responses(answers))


def refusing_answers():
    """Answers like the template, but nothing about nulls."""
    answer = E.template_answers()

    def refuse(prompts):
        if any("high_null_rate" in prompt for prompt in prompts):
            raise ValueError("refused")
        return answer(prompts)

    return refuse


def enrich_failure(spark, sf):
    rows = _attached(spark, sf, refusing_answers())
    return rows.groupBy(*S.GROUP, "LLM_SUMMARY", "LLM_ERROR").agg(F.count(F.lit(1)).alias("n_rows"))


def attach_enrichment(spark, sf):
    rows = _attached(spark, sf, E.template_answers())
    return rows.select(
        *S.GROUP, "ROW_IDENTIFIER", "LLM_SUMMARY", "LLM_BUSINESS_IMPACT", "LLM_RECOMMENDED_FIX", "LLM_GOVERNANCE_NOTE"
    )


def report_datasets(spark, sf):
    stage = Stage(spark)
    frames = _scan(spark, sf, enrich=E.template_answers(), stage=stage)
    path = write_report(frames, f"{stage.folder}/report", "20250101_000000")
    contents = {
        "Overview": ("Metric", "Value"),
        "Rule_Summary": ("concat_ws('/', ISSUE_TYPE, RULE_NAME, SEVERITY)", "ISSUE_COUNT"),
        "Table_Profiles": ("concat_ws('/', TABLE_NAME, ROW_COUNT, PRIMARY_KEYS)", "ISSUES"),
        "Row_Issues": (
            "concat_ws('/', ISSUE_TYPE, TABLE_NAME, ROW_IDENTIFIER, ISSUE_DETAIL, SEVERITY)", "concat_ws('/', LLM_SUMMARY, LLM_ERROR)"
        ),
        "LLM_Table_Summaries": ("TABLE_NAME", "concat_ws('/', LLM_SUMMARY, LLM_ERROR)"),
    }
    rows = [
        spark.read.parquet(f"{path}/{name}").selectExpr(
            f"'{name}' AS dataset", f"{key} AS item", f"CAST({value} AS STRING) AS content"
        )
        for name, (key, value) in contents.items()
    ]
    return reduce(DataFrame.unionByName, rows)


def empty_report(spark, sf):
    """Clean tables: datasets without rows keep one line that says so in their text form."""
    stage = Stage(spark)
    tables = {name: table(spark, sf, name) for name in ("customer", "part", "documents")}
    frames = scan(spark, tables, database=DATABASE, schema="clean", generated="2025-01-01T00:00:00", stage=stage)
    path = write_report(frames, f"{stage.folder}/report", "20250101_000000", csv=True)
    read = partial(spark.read.csv, header=True)
    messages = [read(f"{path}/csv/{name}").selectExpr(f"'{name}' AS dataset", "message AS content") for name in ("Rule_Summary", "LLM_Table_Summaries")]
    sizes = read(f"{path}/csv/Table_Profiles").selectExpr("TABLE_NAME AS dataset", "ROW_COUNT AS content")
    return reduce(DataFrame.unionByName, [*messages, sizes])


def schema_scan(spark, sf):
    """All given tables as a schema of the catalog, with their declared keys."""
    frames = scan_schema(spark, DATABASE, registered(spark, sf), (SQL_RULE,))
    issues = frames["Row_Issues"].groupBy("TABLE_NAME").agg(F.count(F.lit(1)).alias("ISSUES_FOUND"))
    return frames["Table_Profiles"].join(issues, "TABLE_NAME", "left").fillna(0, ["ISSUES_FOUND"])


def insert_missing(spark, sf):
    fresh = table(spark, sf, "documents").select(
        "doc_id", F.lit(0).alias("quality"), F.lit(0).alias("toxic")
    )
    return U.insert_missing(table(spark, sf, "labels"), fresh, ["doc_id"])


def apply_corrections(spark, sf):
    customer = table(spark, sf, "customer")
    fixes = customer.filter("c_acctbal < 0").select(
        "c_custkey",
        F.concat(F.lit("Corrected "), "c_name").alias("c_name"),
        F.lit(None).cast("string").alias("c_mktsegment"),
    )
    return U.apply_corrections(customer, fixes, ["c_custkey"], ["c_name", "c_mktsegment"])


def ensure_column(spark, sf):
    supplier = U.ensure_column(table(spark, sf, "supplier"), "S_NAME", "string")
    return U.ensure_column(supplier, "rm_code", "string")


_ALL = (
    list_tables, column_metadata, resolve_keys, infer_keys, row_counts, scan_tables, param_query,
    null_profile, distinct_profile, distinct_profile_approx, high_null_rate, null_rate_report,
    duplicate_keys, duplicate_keys_null, duplicate_keys_threshold, duplicate_key_issues, stale_tables,
    profile_issues, table_profiles, rule_status_measure, rule_retention, rule_any_reference,
    rule_required_reference, rule_negative_control, rule_row_identifier, rule_defaults, run_sql_rule,
    run_all_rules, rule_error, combined_issues, widened_issues, rule_summary, severity_counts, overview,
    run_result, full_scan, issue_groups, issue_samples, issue_prompts, table_prompts, enrich_template,
    extract_json, parse_responses, attach_enrichment, report_datasets, insert_missing,
    apply_corrections, ensure_column, distinct_profile_wide, zero_column_table, enrich_failure,
    empty_report, schema_scan, resumed_scan, *STORED,
)

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {fn.__name__: fn for fn in _ALL}
