"""Inputs with defects, derived from the given tables by plain projections.

The given tables hold no nulls and no orphans, so each input turns some values into
defects by a condition on other values of the same row. Every row of a table is kept.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructType

from rowcensus.sources.catalog import register_parquet

TABLES = (
    "benchmark", "conversations", "customer", "documents", "embeddings", "events", "labels",
    "lineitem", "nation", "orders", "pages", "part", "region", "supplier",
)

# Expressions that read the same in both engines, so that both sides of the check share them.
PROJECTIONS: dict[str, dict[str, str]] = {
    "events_d": {
        "event_id": "event_id",
        "ts": "ts",
        "et": "nullif(event_type, 'error')",
        "v": "CASE WHEN value > 100 THEN NULL ELSE value END",
        "u": "CASE WHEN value < 1 THEN NULL ELSE user_id END",
    },
    "orders_d": {
        "o_orderkey": "o_orderkey",
        "o_orderstatus": "o_orderstatus",
        "o_orderpriority": "o_orderpriority",
        "o_orderdate": "o_orderdate",
        "price": "CAST(o_totalprice AS DECIMAL(18,2))",
        "deleted": "o_orderstatus = 'F'",
        "k": "CASE WHEN o_orderstatus = 'P' AND o_orderpriority = '5-LOW' THEN NULL "
        "WHEN o_totalprice > 490000 THEN -1 - o_custkey ELSE o_custkey END",
    },
    "lineitem_d": {
        "l_orderkey": "l_orderkey",
        "l_linenumber": "l_linenumber",
        "l_quantity": "l_quantity",
        "a": "CASE WHEN l_quantity <= 5 THEN NULL WHEN l_quantity = 49 THEN -1 - l_partkey ELSE l_partkey END",
        "b": "CASE WHEN l_linenumber = 7 OR l_quantity <= 1 THEN NULL "
        "WHEN l_quantity BETWEEN 30 AND 33 THEN -1 - l_suppkey ELSE l_suppkey END",
    },
    "customer_d": {
        "c_custkey": "c_custkey",
        "c_name": "c_name",
        "c_nationkey": "c_nationkey",
        "balance": "CAST(c_acctbal AS DECIMAL(18,2))",
        "segment": "CASE WHEN c_acctbal < 0 THEN NULL ELSE c_mktsegment END",
    },
}

RESPONSE_TEXT = """CASE event_type
    WHEN 'click' THEN concat('{"llm_summary": "event ', event_id, '", "business_impact": "low", "k": ', substr(props, 7))
    WHEN 'view' THEN concat('Sure!', chr(10), '```JSON', chr(10), '{"recommended_fix": "fix ', user_id,
        '", "governance_note": "n"}', chr(10), '```', chr(10), 'Hope it helps')
    WHEN 'signup' THEN concat('  The finding is ', repeat(concat(props, ' '), 60), ' as seen.')
    WHEN 'purchase' THEN concat('No object for event ', event_id, ' } or {')
    ELSE concat('{"llm_summary": "broken ', event_id, '",}')
END"""

PROJECTIONS["events_answers"] = {
    "event_id": "event_id",
    "ISSUE_TYPE": "event_type",
    "RULE_NAME": "concat('rule ', event_type)",
    "RESPONSE": RESPONSE_TEXT,
}

SCANNED = ("customer_d", "events_d", "lineitem_d", "orders_d")


def source_of(name: str) -> str:
    return name.rsplit("_", 1)[0]


def as_sql(name: str) -> str:
    """The projection as a query over the source table."""
    columns = ", ".join(f"{expr} AS {alias}" for alias, expr in PROJECTIONS[name].items())
    return f"SELECT {columns} FROM {source_of(name)}"


_schemas: dict[str, StructType] = {}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A given table; its schema is inferred once per path, as a catalog would remember it."""
    path = f"{sf_dir}/{name}.parquet"
    if path in _schemas:
        return spark.read.schema(_schemas[path]).parquet(path)
    df = spark.read.parquet(path)
    _schemas[path] = df.schema
    return df


def project(source: DataFrame, name: str) -> DataFrame:
    return source.selectExpr(*[f"{expr} AS {alias}" for alias, expr in PROJECTIONS[name].items()])


def derived(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return project(table(spark, sf_dir, source_of(name)), name)


def derived_tables(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    """The four inputs that the scan queries look at together."""
    return {name: derived(spark, sf_dir, name) for name in SCANNED}


def scanned_and_references(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    """The same four, and the raw tables that rules look into."""
    raw = {source_of(name): table(spark, sf_dir, source_of(name)) for name in SCANNED}
    inputs = {name: project(raw[source_of(name)], name) for name in SCANNED}
    references = {name: table(spark, sf_dir, name) for name in ("part", "supplier")}
    return {**inputs, "customer": raw["customer"], **references}


KEYS = {
    "customer_d": ["c_custkey"],
    "events_d": ["event_id"],
    "lineitem_d": ["l_orderkey", "l_linenumber"],
    "orders_d": ["k"],
}


def schema_name(sf_dir: str) -> str:
    return "census_" + hashlib.md5(sf_dir.encode()).hexdigest()[:8]


def registered(spark: SparkSession, sf_dir: str) -> str:
    """The given tables as external tables of one schema; two have a declared key."""
    name = schema_name(sf_dir)
    paths = {t: f"{sf_dir}/{t}.parquet" for t in TABLES}
    declared = {"conversations": ["conv_id", "turn"], "lineitem": ["l_orderkey", "l_linenumber"]}
    register_parquet(spark, name, paths, declared)
    return name
