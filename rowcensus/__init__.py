"""Data-quality scanning of tables with Spark.

Profiles, rules and reports are built from frames and return frames; findings stay
distributed from the scan to the report.
"""

from .operators.builders import (
    Reference,
    any_valid_reference,
    required_reference,
    retention_cutoff,
    status_measure,
)
from .operators.client_rules import CLIENT_RULES
from .operators.issues import ISSUE_SCHEMA, combine_issues, widen_issues
from .operators.rules import Rule, run_rule, run_rules
from .plans.report import write_report
from .plans.scan import ScanOptions, scan, scan_schema
from .sources.catalog import register_parquet

__all__ = [
    "CLIENT_RULES",
    "ISSUE_SCHEMA",
    "Reference",
    "Rule",
    "ScanOptions",
    "any_valid_reference",
    "combine_issues",
    "register_parquet",
    "required_reference",
    "retention_cutoff",
    "run_rule",
    "run_rules",
    "scan",
    "scan_schema",
    "status_measure",
    "widen_issues",
    "write_report",
]
