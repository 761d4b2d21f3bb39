"""The ten-table fixture end to end, against its counts."""

import pytest
from pyspark.sql import functions as F

from rowcensus import CLIENT_RULES, ScanOptions, scan, write_report
from rowcensus.plans.enrich import template_answers

from .fixture import fixture_tables


@pytest.fixture(scope="module")
def frames(spark):
    tables = fixture_tables(spark)
    return scan(spark, tables, CLIENT_RULES, "spark_catalog", "dq", enrich=template_answers(), generated="t0")


def found(frames, rule):
    rows = frames["Row_Issues"].filter(F.col("ISSUE_TYPE") == rule).select("ROW_IDENTIFIER").collect()
    return sorted(r[0] for r in rows)


def test_rule_rows(frames):
    assert found(frames, "archived_client_with_aum") == ["K-di", "K-eve", "K-gus"]
    assert found(frames, "pre_2017_client_not_deleted") == ["K-fay", "K-gus", "K-kit"]
    assert found(frames, "invalid_im_fp") == ["K-gus", "K-hal", "K-ida", "K-jo", "K-kit"]
    assert found(frames, "invalid_rm") == ["K-eve", "K-gus", "K-kit"]


def test_rule_texts(frames):
    rows = {
        (r.ISSUE_TYPE, r.ROW_IDENTIFIER): r.ISSUE_DETAIL
        for r in frames["Row_Issues"].select("ISSUE_TYPE", "ROW_IDENTIFIER", "ISSUE_DETAIL").collect()
    }
    assert rows["archived_client_with_aum", "K-di"] == "Client is archived but AUM = 17.30"
    assert rows["pre_2017_client_not_deleted", "K-kit"] == "Client created 2016-12-31 but still present"
    assert rows["invalid_im_fp", "K-hal"] == "Invalid IM code: IM404"
    assert rows["invalid_im_fp", "K-ida"] == "Invalid FP code: FP404"
    assert rows["invalid_im_fp", "K-jo"] == "Missing IM and FP — at least one adviser required"
    assert rows["invalid_rm", "K-eve"] == "Invalid RM code: RM404"
    assert rows["duplicate_primary_key", "TRANSACTION_ID=TXN_DUP1"] == "Duplicate PK with count=2"


def test_profile_findings(frames):
    assert found(frames, "duplicate_primary_key") == [
        "PORTFOLIO_ID=PF_DUP1", "PORTFOLIO_ID=PF_DUP2", "TRANSACTION_ID=TXN_DUP1", "TRANSACTION_ID=TXN_DUP2",
    ]
    rows = frames["Row_Issues"].filter("ISSUE_TYPE = 'high_null_rate'")
    got = {(r.TABLE_NAME, r.COLUMN_NAME): r.ISSUE_DETAIL for r in rows.collect()}
    assert len(got) == 9
    assert got["CLIENT_CONTACTS", "EMAIL"] == "Column EMAIL: Null rate 45.0% exceeds threshold 5.0%"
    assert got["CLIENT_HOLDINGS", "MARKET_VALUE"].startswith("Column MARKET_VALUE: Null rate 38.9%")


def test_summaries(frames):
    overview = {r.Metric: r.Value for r in frames["Overview"].collect()}
    assert overview == {
        "Total row-level issues": "27",
        "Tables scanned": "10",
        "Critical issues": "4",
        "High severity issues": "6",
        "Report generated": "t0",
    }
    counts = [r.ISSUE_COUNT for r in frames["Rule_Summary"].collect()]
    assert counts == sorted(counts, reverse=True) and sum(counts) == 27
    result = frames["Run_Result"].first()
    assert (result.tables_scanned, result.total_issues) == (10, 27)


def test_table_profiles(frames):
    rows = {r.TABLE_NAME: r for r in frames["Table_Profiles"].collect()}
    assert len(rows) == 10
    t = rows["TRANSACTIONS"]
    assert (t.ROW_COUNT, t.PRIMARY_KEYS, t.COLUMN_ISSUE_COUNT, t.TABLE_ISSUE_COUNT) == (9, "TRANSACTION_ID", 0, 1)
    assert t.ISSUES == "Found 2 duplicate primary key group(s) on ['TRANSACTION_ID']"
    assert rows["PRODUCTS"].ISSUES == "None" and rows["PRODUCTS"].PRIMARY_KEYS == "PRODUCT_CODE"
    assert rows["CLIENTS"].ISSUES.startswith("IM_CODE: Null rate 36.4% exceeds threshold 5.0%; FP_CODE:")


def test_texts(frames):
    assert frames["LLM_Table_Summaries"].count() == 8
    rows = frames["Row_Issues"].select("ISSUE_TYPE", "TABLE_NAME", "LLM_SUMMARY").distinct().collect()
    assert len(rows) == 12
    assert all(r.LLM_SUMMARY == f"{r.ISSUE_TYPE} in {r.TABLE_NAME}" for r in rows)


def test_report(spark, frames, tmp_path):
    path = write_report(frames, str(tmp_path), "20250101_000000", csv=True)
    assert path.endswith("dq_governance_report_20250101_000000")
    issues = spark.read.parquet(f"{path}/Row_Issues")
    assert issues.count() == 27
    assert issues.filter("SEVERITY = 'critical'").count() == 4
    overview = spark.read.csv(f"{path}/csv/Overview", header=True)
    assert overview.count() == 5


def test_clean_schema_is_empty_not_an_error(spark, tmp_path):
    tables = {"PRODUCTS": fixture_tables(spark)["PRODUCTS"]}
    frames = scan(spark, tables, [], generated="t0")
    assert frames["Row_Issues"].count() == 0
    assert {r.Metric: r.Value for r in frames["Overview"].collect()}["Total row-level issues"] == "0"
    path = write_report(frames, str(tmp_path), "s", csv=True)
    assert spark.read.csv(f"{path}/csv/Rule_Summary", header=True).first().message == "No issues found"
    assert spark.read.parquet(f"{path}/Rule_Summary").columns == ["ISSUE_TYPE", "RULE_NAME", "SEVERITY", "ISSUE_COUNT"]


def test_stage_switches(spark):
    tables = fixture_tables(spark)
    only_rules = scan(spark, tables, CLIENT_RULES, options=ScanOptions(profile=False), generated="t0")
    assert only_rules["Row_Issues"].count() == 14
    assert only_rules["Table_Profiles"].count() == 0
    assert only_rules["Run_Result"].first().tables_scanned == 10
    only_profile = scan(spark, tables, CLIENT_RULES, options=ScanOptions(rules=False), generated="t0")
    assert only_profile["Row_Issues"].count() == 13
