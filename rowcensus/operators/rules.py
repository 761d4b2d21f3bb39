"""Business rules: how one is declared, run, and kept from failing the others."""

from __future__ import annotations

import logging
from collections.abc import Callable, Iterable, Mapping, Sequence
from dataclasses import dataclass
from functools import partial
from typing import Any

from pyspark.sql import DataFrame, SparkSession

from ..functions import labels
from ..functions.text import joined_values, literal, payload_map, quoted, row_fingerprint
from ..sources.catalog import ROW_POSITION, table_ref, with_row_position
from ..sources.jobs import side_by_side
from ..sources.staging import Stage
from .issues import ISSUE_SCHEMA, combine_issues, empty_issues, issue_columns, stamp

log = logging.getLogger(__name__)

Tables = Callable[[str], DataFrame]
RESULT_COLUMNS = ("ISSUE_TYPE", "ISSUE_DETAIL")
SET_BY_RULE = ("DATABASE", "SCHEMA", "TABLE_NAME", "PRIMARY_KEY", "SEVERITY", "RULE_NAME", "ROW_IDENTIFIER")


@dataclass(frozen=True)
class Rule:
    """One rule. Exactly one of these says what a violation is:

    * ``sql``: a query template with ``{database}`` and ``{schema}`` that returns the
      violating rows;
    * ``violations``: a function from a table lookup to the frame of violating rows;
    * ``where`` and ``detail``: SQL expressions over one row of ``table``. All rules of
      this kind on one table are evaluated in a single scan of it.

    A ``dynamic`` rule only carries the name and severity of a profiler finding. Rows of a
    rule without a key are identified by a digest, or with ``position`` by their file and
    place in it, which tells equal rows apart and stays the same until the file is rewritten.
    """

    id: str
    name: str | None = None
    description: str | None = None
    severity: str = labels.DEFAULT_SEVERITY
    table: str = labels.UNKNOWN_TABLE
    primary_key: tuple[str, ...] = ()
    enabled: bool = True
    dynamic: bool = False
    sql: str | None = None
    violations: Callable[[Tables], DataFrame] | None = None
    where: str | None = None
    detail: str | None = None
    payload: tuple[str, ...] = ()
    position: bool = False

    @classmethod
    def from_dict(cls, entry: Mapping[str, Any]) -> Rule:
        """A rule from one entry of a parsed rule list; ``primary_key`` may be a list."""
        fields = dict(entry)
        for name in ("primary_key", "payload"):
            fields[name] = tuple(fields.get(name) or ())
        return cls(**fields)

    @property
    def title(self) -> str:
        return self.name or self.id

    @property
    def row_local(self) -> bool:
        return self.where is not None


def fill_template(sql: str, database: str, schema: str) -> str:
    """Replace the two known placeholders; any other brace in the query survives."""
    return sql.replace("{database}", database).replace("{schema}", schema)


def _without_key(df: DataFrame, rule: Rule) -> str:
    """Identifier of a row of a rule without a key."""
    if rule.position:
        return quoted(ROW_POSITION)
    names = [c for c in df.columns if c != ROW_POSITION]
    return row_fingerprint(df.selectExpr(*[quoted(c) for c in names]))


def rule_issues(found: DataFrame, rule: Rule) -> DataFrame:
    """Violating rows as issues; what the query did not return comes from the rule."""
    by_upper = {name.upper(): name for name in found.columns}

    def returned(name: str, default: str) -> str:
        return quoted(by_upper[name]) if name in by_upper else literal(default)

    keys = [by_upper.get(k.upper(), k) for k in rule.primary_key]
    reserved = RESULT_COLUMNS + SET_BY_RULE + (ROW_POSITION,)
    payload = [name for upper, name in by_upper.items() if upper not in reserved]
    return found.selectExpr(
        *issue_columns(
            TABLE_NAME=literal(rule.table),
            PRIMARY_KEY=literal(", ".join(rule.primary_key)),
            ROW_IDENTIFIER=joined_values(found, keys) if keys else _without_key(found, rule),
            ISSUE_TYPE=returned("ISSUE_TYPE", rule.id),
            ISSUE_DETAIL=returned("ISSUE_DETAIL", rule.description or rule.id),
            SEVERITY=literal(rule.severity),
            RULE_NAME=literal(rule.title),
            ROW_VALUES=payload_map(found, payload),
        )
    )


def actual_names(df: DataFrame, wanted: Iterable[str]) -> list[str]:
    """The columns of ``df`` that are meant, in whatever case they are given, each once."""
    by_upper = {c.upper(): c for c in df.columns}
    return list(dict.fromkeys(c if c in df.columns else by_upper.get(c.upper(), c) for c in wanted))


def check_rows(df: DataFrame, rules: Sequence[Rule]) -> DataFrame:
    """Issues of any number of row-local rules over one table, from one scan."""
    if any(rule.position and not rule.primary_key for rule in rules):
        df = with_row_position(df)
    issues = []
    for rule in rules:
        keys = actual_names(df, rule.primary_key)
        values = actual_names(df, (*keys, *rule.payload))
        columns = issue_columns(
            TABLE_NAME=literal(rule.table),
            PRIMARY_KEY=literal(", ".join(rule.primary_key)),
            ROW_IDENTIFIER=joined_values(df, keys) if keys else _without_key(df, rule),
            ISSUE_TYPE=literal(rule.id),
            ISSUE_DETAIL=rule.detail or literal(rule.description or rule.id),
            SEVERITY=literal(rule.severity),
            RULE_NAME=literal(rule.title),
            ROW_VALUES=payload_map(df, values),
        )
        issues.append((rule.where, columns))
    if len(issues) == 1:
        where, columns = issues[0]
        return df.where(where).selectExpr(*columns)
    cases = ", ".join(f"IF({where}, struct({', '.join(columns)}), NULL)" for where, columns in issues)
    any_rule = " OR ".join(f"({where})" for where, _ in issues)
    return df.where(any_rule).selectExpr(f"inline(array_compact(array({cases})))")


def rule_error(spark: SparkSession, rule: Rule, error: Exception) -> DataFrame:
    """The one row that stands for a rule that could not run."""
    row = {
        "TABLE_NAME": rule.table,
        "ROW_IDENTIFIER": labels.RULE_ERROR,
        "ISSUE_TYPE": rule.id,
        "ISSUE_DETAIL": f"Rule failed to execute: {error}",
        "SEVERITY": rule.severity,
        "RULE_NAME": rule.title,
    }
    values = tuple(row.get(name) for name in ISSUE_SCHEMA.names)
    return spark.createDataFrame([values], ISSUE_SCHEMA)


def _plan(spark: SparkSession, rule: Rule, database: str, schema: str, tables: Tables) -> DataFrame:
    if rule.row_local:
        return check_rows(tables(rule.table), [rule])
    if rule.violations is not None:
        return rule_issues(rule.violations(tables), rule)
    if not rule.sql:
        return empty_issues(spark)
    return rule_issues(spark.sql(fill_template(rule.sql, database, schema)), rule)


def _stored(spark: SparkSession, rule: Rule, database: str, schema: str, tables: Tables, stage: Stage) -> str:
    """Run one rule and return the path of its issues, or of the row that stands for its failure."""
    try:
        return stage.write_findings(stamp(_plan(spark, rule, database, schema, tables), database, schema), rule.id)
    except Exception as error:  # whatever goes wrong in a rule is a finding of its own
        log.warning("rule %s failed: %s", rule.id, error)
        return stage.write(stamp(rule_error(spark, rule, error), database, schema), f"error-{rule.id}")


def run_rule(
    spark: SparkSession,
    rule: Rule,
    database: str,
    schema: str,
    tables: Tables | None = None,
    stage: Stage | None = None,
) -> DataFrame:
    """Issues of one rule.

    Without a ``stage`` the frame is lazy, and only failures to analyse the rule become an
    error row. With one, the rule is run and its issues are stored, so that failures
    inside the tasks, such as a bad cast, are caught as well.
    """
    tables = tables or _catalog_lookup(spark, database, schema)
    if stage is not None:
        return stage.read(ISSUE_SCHEMA, _stored(spark, rule, database, schema, tables, stage))
    try:
        return stamp(_plan(spark, rule, database, schema, tables), database, schema)
    except Exception as error:  # whatever goes wrong in a rule is a finding of its own
        log.warning("rule %s failed: %s", rule.id, error)
        return stamp(rule_error(spark, rule, error), database, schema)


def _catalog_lookup(spark: SparkSession, database: str, schema: str) -> Tables:
    return lambda name: spark.table(table_ref(database, schema, name))


def runnable(rules: Iterable[Rule]) -> list[Rule]:
    """Enabled rules that are not mere metadata of the profiler."""
    return [rule for rule in rules if rule.enabled and not rule.dynamic]


def run_rules(
    spark: SparkSession,
    rules: Iterable[Rule],
    database: str,
    schema: str,
    tables: Tables | Mapping[str, DataFrame] | None = None,
    stage: Stage | None = None,
    parallel: int = 4,
) -> DataFrame:
    """Issues of all enabled, non-dynamic rules.

    Row-local rules that share a table share its scan. With a ``stage``, a few jobs run
    side by side so that the tail of one does not idle the cluster; if a shared scan
    fails, its rules are rerun one by one to find the culprit.
    """
    catalog = _catalog_lookup(spark, database, schema)
    if isinstance(tables, Mapping):
        known = {name.upper(): df for name, df in tables.items()}
        tables = lambda name: known[name.upper()] if name.upper() in known else catalog(name)
    tables = tables or catalog

    shared: dict[str, list[Rule]] = {}
    single: list[Rule] = []
    for rule in runnable(rules):
        if rule.row_local:
            shared.setdefault(rule.table.upper(), []).append(rule)
        else:
            single.append(rule)

    if stage is None:
        found = []
        for part in shared.values():
            try:
                found.append(stamp(check_rows(tables(part[0].table), part), database, schema))
            except Exception:  # one by one below tells which of the rules is to blame
                found += [run_rule(spark, rule, database, schema, tables) for rule in part]
        found += [run_rule(spark, rule, database, schema, tables) for rule in single]
        return combine_issues(spark, found)

    def stored(part: Sequence[Rule]) -> list[str]:
        if len(part) > 1:
            try:
                planned = stamp(check_rows(tables(part[0].table), part), database, schema)
                return [stage.write_findings(planned, f"rules-{part[0].table}")]
            except Exception as error:
                log.warning("shared scan of %s failed, running its rules one by one: %s", part[0].table, error)
        return [_stored(spark, rule, database, schema, tables, stage) for rule in part]

    work = [*shared.values(), *[[rule] for rule in single]]
    paths = [path for part in side_by_side(spark, [partial(stored, p) for p in work], parallel) for path in part]
    # One reader for all of them, so that plans stay small however many rules there are.
    return stage.read(ISSUE_SCHEMA, *paths) if paths else empty_issues(spark)
