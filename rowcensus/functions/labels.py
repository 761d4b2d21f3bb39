"""Texts of the issue table and the report."""

# Consumers of the report match on these texts.
TABLE_LEVEL = "TABLE_LEVEL"
RULE_ERROR = "RULE_ERROR"
UNKNOWN_TABLE = "UNKNOWN"
DEFAULT_SEVERITY = "medium"
SEVERITIES = ("critical", "high", "medium", "low")

HIGH_NULL_TYPE = "high_null_rate"
HIGH_NULL_RULE = "Column exceeds null rate threshold"
HIGH_NULL_SEVERITY = "low"

DUPLICATE_TYPE = "duplicate_primary_key"
DUPLICATE_RULE = "Duplicate primary key values"
DUPLICATE_SEVERITY = "critical"

NO_COLUMNS = "No columns found in INFORMATION_SCHEMA"
NO_TABLE_ISSUES = "None"
EMPTY_DATASET = "No issues found"

METRIC_TOTAL = "Total row-level issues"
METRIC_TABLES = "Tables scanned"
METRIC_CRITICAL = "Critical issues"
METRIC_HIGH = "High severity issues"
METRIC_GENERATED = "Report generated"

MANUAL_FIX = "Review issue manually; LLM response was not structured JSON."

# Response key of the model contract -> column of the issue table.
RESPONSE_COLUMNS = {
    "llm_summary": "LLM_SUMMARY",
    "business_impact": "LLM_BUSINESS_IMPACT",
    "recommended_fix": "LLM_RECOMMENDED_FIX",
    "governance_note": "LLM_GOVERNANCE_NOTE",
}
