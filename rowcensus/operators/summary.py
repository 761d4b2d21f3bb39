"""Small summaries of the issue table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import labels
from ..functions.text import literal

GROUP = ("ISSUE_TYPE", "RULE_NAME", "TABLE_NAME")


def issue_counts(issues: DataFrame) -> DataFrame:
    """Issues per type, rule, table and severity: a few rows from which all summaries follow.

    The summaries below take issues, or this frame in their place.
    """
    return issues.groupBy(*GROUP, "SEVERITY").agg(F.expr("count(1) AS ISSUE_COUNT"))


def _weight(issues: DataFrame) -> str:
    """How many issues a row stands for."""
    return "ISSUE_COUNT" if "ISSUE_COUNT" in issues.columns else "1L"


def _total(issues: DataFrame, where: str = "TRUE") -> str:
    return f"coalesce(sum(IF({where}, {_weight(issues)}, 0L)), 0L)"


def rule_summary(issues: DataFrame) -> DataFrame:
    """Issue counts by type, rule and severity, largest first; null keys are kept."""
    keys = ["ISSUE_TYPE", "RULE_NAME", "SEVERITY"]
    counted = issues.groupBy(*keys).agg(F.expr(f"sum({_weight(issues)}) AS ISSUE_COUNT"))
    return counted.orderBy(F.desc("ISSUE_COUNT"), *keys)


def severity_rank(severity: str = "SEVERITY") -> str:
    """1 for critical down to 4 for low; 5 for anything else."""
    ranks = " ".join(f"WHEN '{name}' THEN {place}" for place, name in enumerate(labels.SEVERITIES, start=1))
    return f"CASE {severity} {ranks} ELSE {len(labels.SEVERITIES) + 1} END"


def severity_counts(issues: DataFrame) -> DataFrame:
    counted = issues.groupBy("SEVERITY").agg(F.expr(f"sum({_weight(issues)}) AS ISSUE_COUNT"))
    return counted.selectExpr("*", f"{severity_rank()} AS SEVERITY_RANK").orderBy("SEVERITY_RANK", "SEVERITY")


def overview(issues: DataFrame, table_profiles: DataFrame, generated: str) -> DataFrame:
    """Five (Metric, Value) rows; the time of the report is passed in."""

    def metric(place: int, name: str, value: str) -> str:
        return f"struct({place} AS _place, {literal(name)} AS Metric, CAST({value} AS STRING) AS Value)"

    def rows(*metrics: str) -> str:
        return f"inline(array({', '.join(metrics)}))"

    counts = issues.selectExpr(
        f"{_total(issues)} AS total",
        f"{_total(issues, "SEVERITY = 'critical'")} AS critical",
        f"{_total(issues, "SEVERITY = 'high'")} AS high",
    ).selectExpr(
        rows(
            metric(1, labels.METRIC_TOTAL, "total"),
            metric(3, labels.METRIC_CRITICAL, "critical"),
            metric(4, labels.METRIC_HIGH, "high"),
            metric(5, labels.METRIC_GENERATED, literal(generated)),
        )
    )
    scanned = table_profiles.selectExpr("count(DISTINCT TABLE_NAME) AS n")
    scanned = scanned.selectExpr(rows(metric(2, labels.METRIC_TABLES, "n")))
    return counts.union(scanned).orderBy("_place").select("Metric", "Value")


def run_result(issues: DataFrame, tables_scanned: int, location: str | None = None) -> DataFrame:
    """One row for the caller: listed tables, issues, and where the report went."""
    return issues.selectExpr(
        f"CAST({literal(location)} AS STRING) AS output_path",
        f"{int(tables_scanned)}L AS tables_scanned",
        f"{_total(issues)} AS total_issues",
    )


def issue_groups(issues: DataFrame) -> DataFrame:
    """One row per (type, rule, table) with its size and the severity of its first row."""
    first = "min(struct(ROW_IDENTIFIER, ISSUE_DETAIL, SEVERITY)).SEVERITY"
    return issues.groupBy(*GROUP).agg(
        F.expr("count(1) AS ISSUE_COUNT"),
        F.expr(f"coalesce({first}, {literal(labels.DEFAULT_SEVERITY)}) AS SEVERITY"),
    )
