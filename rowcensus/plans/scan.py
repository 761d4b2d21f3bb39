"""A whole scan: profile, rules, combine, explain, summarise, write."""

from __future__ import annotations

import logging
from collections.abc import Callable, Iterable, Mapping, Sequence
from dataclasses import dataclass
from datetime import datetime
from functools import partial, reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import profile as P
from ..operators.issues import ISSUE_SCHEMA, combine_issues, stamp
from ..operators.rules import Rule, run_rules
from ..operators.summary import issue_counts, overview, rule_summary, run_result
from ..sources.catalog import declared_keys, load_tables, not_null_columns, resolve_keys
from ..sources.footers import parquet_location, write_footer_profile
from ..sources.jobs import side_by_side
from ..sources.resume import ResumableStage
from ..sources.staging import Stage
from .enrich import attach_texts, issue_prompts, parse_responses, respond, table_prompts
from .report import PREFIX, write_report

log = logging.getLogger(__name__)

TABLE_BATCH = 40
NO_PROFILES = (
    "TABLE_NAME string, ROW_COUNT bigint, PRIMARY_KEYS string, COLUMN_ISSUE_COUNT bigint, "
    "TABLE_ISSUE_COUNT bigint, ISSUES string, COLUMN_ISSUES array<string>, TABLE_ISSUES array<string>"
)
PROFILE_COLUMNS = (
    "TABLE_NAME", "ROW_COUNT", "PRIMARY_KEYS", "COLUMN_ISSUE_COUNT", "TABLE_ISSUE_COUNT", "ISSUES"
)


@dataclass(frozen=True)
class ScanOptions:
    null_threshold: float = P.NULL_THRESHOLD
    max_extra: int = 0
    sample_size: int = 5
    profile: bool = True
    rules: bool = True
    parallel: int = 4
    model_tasks: int | None = None
    max_tokens: int | None = None  # these three go to the model function's caller
    attempts: int = 3
    prompt_batch: int = 16
    distinct: str | None = None  # "exact" or "approx" adds distinct counts to Column_Profiles


def _batches(items: Sequence) -> Iterable[Sequence]:
    for start in range(0, len(items), TABLE_BATCH):
        yield items[start : start + TABLE_BATCH]


def stored_profile(
    spark: SparkSession,
    tables: Mapping[str, DataFrame],
    paths: Mapping[str, str],
    stage: Stage,
    parallel: int = 4,
) -> DataFrame:
    """Null profile of all tables, some tables per job so that plans stay small.

    Tables with a known Parquet folder are answered from the footers where possible. The
    result has one row per column, which is why one file per batch is enough.
    """

    def from_footers(names: Sequence[str]) -> tuple[list[str], list[str]]:
        return write_footer_profile(spark, {n: tables[n] for n in names}, paths, stage, parallel)

    def from_data(names: Sequence[str]) -> str:
        return stage.write(P.null_profiles({n: tables[n] for n in names}).coalesce(1), "profile")

    known = [name for name in tables if name in paths]
    answers = side_by_side(spark, [partial(from_footers, names) for names in _batches(known)], parallel)
    scanned = [name for name in tables if name not in paths] + [name for _, failed in answers for name in failed]
    written = [path for found, _ in answers for path in found]
    written += side_by_side(spark, [partial(from_data, names) for names in _batches(scanned)], parallel)
    return stage.read(P.PROFILE_SCHEMA, *written)


def _stored_distincts(
    spark: SparkSession, tables: Mapping[str, DataFrame], method: str, stage: Stage, parallel: int
) -> DataFrame:
    def stored(name: str) -> str:
        return stage.write(P.distinct_profile(tables[name], name, method=method).coalesce(1), f"distinct-{name}")

    return stage.read(P.DISTINCT_SCHEMA, *side_by_side(spark, [partial(stored, name) for name in tables], parallel))


def _stored_issues(
    tables: Mapping[str, DataFrame],
    keys: Mapping[str, Sequence[str]],
    profile: DataFrame,
    stage: Stage,
    options: ScanOptions,
    database: str,
    schema: str,
) -> list[str]:
    found = [P.high_null_issues(profile, keys, options.null_threshold)]
    for name, df in tables.items():
        if keys.get(name):
            found.append(P.duplicate_key_issues(df, name, keys[name], options.max_extra))

    def stored(part: Sequence[DataFrame]) -> str:
        return stage.write_findings(stamp(reduce(DataFrame.union, part), database, schema), "profile-issues")

    return side_by_side(stage.spark, [partial(stored, part) for part in _batches(found)], options.parallel)


def table_keys(
    tables: Mapping[str, DataFrame],
    profile: DataFrame,
    overrides: Mapping[str, Sequence[str]] | None = None,
    declared: Mapping[str, Sequence[str]] | None = None,
) -> dict[str, list[str]]:
    """Key columns of every table; only schema-sized facts reach the driver."""
    complete = not_null_columns(tables, profile)
    return {
        name: resolve_keys(name, df.columns, complete[name], overrides, (declared or {}).get(name, ()))
        for name, df in tables.items()
    }


def scan(
    spark: SparkSession,
    tables: Mapping[str, DataFrame],
    rules: Iterable[Rule] = (),
    database: str = "spark_catalog",
    schema: str = "default",
    overrides: Mapping[str, Sequence[str]] | None = None,
    declared: Mapping[str, Sequence[str]] | None = None,
    enrich: Callable[..., list[str]] | None = None,
    options: ScanOptions = ScanOptions(),
    generated: str | None = None,
    stage: Stage | None = None,
    paths: Mapping[str, str] | None = None,
) -> dict[str, DataFrame]:
    """Scan ``tables``; return the five report datasets, the column profiles and the run result.

    Every table is read twice at most by the profiler (all columns for nulls, key columns
    for duplicates) and once per group of rules. Profiles, issues and model answers are
    stored as they are made; every returned frame reads those files, so looking at one
    repeats no scan and calls no model again. The issues are counted once, by type, rule,
    table and severity, and all summaries follow from the counts. A prompt that the model
    does not answer leaves its error in LLM_ERROR. ``paths`` names the folders of tables that are
    plain Parquet: their nulls are counted from the file footers alone.
    """
    stage = stage or Stage(spark)

    def counted(part: DataFrame) -> DataFrame:
        counts = issue_counts(part)
        return stage.read(counts.schema, stage.write(counts.coalesce(1), "counts"))

    def profiled() -> tuple[DataFrame, DataFrame, DataFrame | None, DataFrame | None]:
        if not (options.profile and tables):
            return spark.createDataFrame([], P.PROFILE_SCHEMA), spark.createDataFrame([], NO_PROFILES), None, None
        named = {name: df for name, df in tables.items() if df.columns}
        if named:
            profile = stored_profile(spark, named, paths or {}, stage, options.parallel)
        else:
            profile = spark.createDataFrame([], P.PROFILE_SCHEMA)
        keys = table_keys(tables, profile, overrides, declared)
        stored = stage.read(ISSUE_SCHEMA, *_stored_issues(tables, keys, profile, stage, options, database, schema))
        counts = counted(stored)
        summary = P.table_profiles(tables, keys, profile, counts, options.null_threshold, options.max_extra)
        summary = stage.read(summary.schema, stage.write(summary.coalesce(1), "table-profiles"))
        if options.distinct and named:
            distincts = _stored_distincts(spark, named, options.distinct, stage, options.parallel)
            profile = P.merge_profiles(profile, distincts)
        return profile, summary, stored, counts

    def ruled() -> tuple[DataFrame | None, DataFrame | None]:
        if not options.rules:
            return None, None
        broken = run_rules(spark, rules, database, schema, dict(tables) or None, stage, options.parallel)
        return broken, counted(broken)

    (columns, profiles, stored, stored_counts), (broken, broken_counts) = side_by_side(spark, [profiled, ruled], 2)
    issues = combine_issues(spark, [part for part in (stored, broken) if part is not None])
    parts = [part for part in (stored_counts, broken_counts) if part is not None]
    counts = reduce(DataFrame.union, parts) if parts else issue_counts(issues)

    explained = issues
    summaries = spark.createDataFrame([], "TABLE_NAME string, LLM_SUMMARY string, LLM_ERROR string")
    if enrich is not None:

        def answered(prompts: DataFrame, label: str) -> DataFrame:
            answers = respond(
                prompts, enrich, options.attempts, options.prompt_batch, options.model_tasks, options.max_tokens
            )
            answers = stage.read(answers.schema, stage.write(answers, label))
            failed = answers.where("ERROR IS NOT NULL").count()
            if failed:
                log.warning("%d of the %s are missing; LLM_ERROR says why", failed, label)
            return answers

        about_tables, about_issues = side_by_side(
            spark,
            [
                lambda: answered(table_prompts(profiles), "table-answers"),
                lambda: answered(issue_prompts(issues, options.sample_size, stage), "issue-answers"),
            ],
            2,
        )
        summaries = about_tables.selectExpr(
            "TABLE_NAME", "coalesce(RESPONSE, '') AS LLM_SUMMARY", "ERROR AS LLM_ERROR"
        )
        explained = attach_texts(issues, parse_responses(about_issues))

    stamp_text = generated or datetime.now().isoformat()
    return {
        "Overview": overview(counts, profiles, stamp_text),
        "Rule_Summary": rule_summary(counts),
        "Table_Profiles": profiles.select(*PROFILE_COLUMNS),
        "Row_Issues": explained,
        "LLM_Table_Summaries": summaries,
        "Column_Profiles": columns,
        "Run_Result": run_result(counts, len(tables)),
    }


def scan_schema(
    spark: SparkSession,
    database: str,
    schema: str,
    rules: Iterable[Rule] = (),
    exclude: Iterable[str] = (),
    overrides: Mapping[str, Sequence[str]] | None = None,
    enrich: Callable[..., list[str]] | None = None,
    options: ScanOptions = ScanOptions(),
    report_folder: str | None = None,
    prefix: str = PREFIX,
    now: datetime | None = None,
    resume: str | None = None,
) -> dict[str, DataFrame]:
    """Scan all base tables of a catalog schema and, given a folder, write the report.

    With ``resume``, a name of the run, finished parts are remembered below the staging root,
    and a scan that broke goes on from there when it is called with the same name again.
    """
    if not database or not schema:
        raise ValueError("a database and a schema are needed")
    now = now or datetime.now()
    tables = load_tables(spark, database, schema, exclude)
    declared = {name: declared_keys(spark, database, schema, name) for name in tables}
    folders = {name: parquet_location(spark, database, schema, name) for name in tables}
    paths = {name: folder for name, folder in folders.items() if folder}
    stage = ResumableStage(spark, resume, f"{database}.{schema} {options}") if resume else None
    frames = scan(
        spark, tables, rules, database, schema, overrides, declared, enrich, options, now.isoformat(), stage, paths
    )
    if report_folder:
        path = write_report(frames, report_folder, now.strftime("%Y%m%d_%H%M%S"), prefix)
        frames["Run_Result"] = frames["Run_Result"].withColumn("output_path", F.lit(path))
    return frames
