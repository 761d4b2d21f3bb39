"""Column and table profiles, and the issues that follow from them."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from datetime import date, datetime
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import labels
from ..functions.text import NESTED, literal, named_values, payload_map, per_value, percent_text, quoted
from .issues import issue_columns

NULL_THRESHOLD = 0.05
DISTINCT_CHUNK = 3
WIDE_TABLE = 24

PROFILE_SCHEMA = (
    "TABLE_NAME string, COLUMN_NAME string, DATA_TYPE string, ORDINAL_POSITION int, "
    "TOTAL_ROWS bigint, NULL_COUNT bigint, NULL_RATE double"
)
DISTINCT_SCHEMA = "TABLE_NAME string, COLUMN_NAME string, DISTINCT_COUNT bigint"


def _union(frames: Sequence[DataFrame]) -> DataFrame:
    return reduce(DataFrame.union, frames)


def row_count(df: DataFrame, table: str) -> DataFrame:
    return df.selectExpr(f"{literal(table)} AS TABLE_NAME", "count(1) AS ROW_COUNT")


def row_counts(tables: Mapping[str, DataFrame]) -> DataFrame:
    return _union([row_count(df, name) for name, df in tables.items()])


def _long_form(wide: DataFrame, rows: Sequence[str]) -> DataFrame:
    return wide.selectExpr(f"inline(array({', '.join(rows)}))")


def _footers_answer(df: DataFrame) -> bool:
    conf = df.sparkSession.conf
    return conf.get("spark.sql.parquet.aggregatePushdown", "false").lower() == "true"


def null_profile(df: DataFrame, table: str) -> DataFrame:
    """Null count and rate of every column, one row per column, from one aggregate.

    Nulls are counted as rows minus ``count(column)``: with the Parquet aggregate pushdown
    switched on, Spark then answers from the file footers and reads no data at all. Footer
    statistics describe the leaves of nested columns, not the columns, so in that case
    nested columns are counted by a separate aggregate with a plain null test.
    """
    fields = list(enumerate(df.schema.fields, start=1))
    if not fields:
        return df.sparkSession.createDataFrame([], PROFILE_SCHEMA)
    groups = [fields]
    if _footers_answer(df):
        flat = [(i, f) for i, f in fields if not isinstance(f.dataType, NESTED)]
        nested = [(i, f) for i, f in fields if isinstance(f.dataType, NESTED)]
        groups = [g for g in (flat, nested) if g]

    frames = []
    for group in groups:
        counts, rows = ["count(1) AS _total"], []
        for i, f in group:
            name = quoted(f.name)
            nested = isinstance(f.dataType, NESTED)
            counts.append(f"count_if({name} IS NULL) AS _n{i}" if nested else f"count(1) - count({name}) AS _n{i}")
            rows.append(
                f"struct({literal(table)} AS TABLE_NAME, {literal(f.name)} AS COLUMN_NAME, "
                f"{literal(f.dataType.simpleString())} AS DATA_TYPE, {i} AS ORDINAL_POSITION, "
                f"_total AS TOTAL_ROWS, _n{i} AS NULL_COUNT, _n{i} / greatest(_total, 1L) AS NULL_RATE)"
            )
        frames.append(_long_form(df.selectExpr(*counts), rows))
    return _union(frames)


def null_profiles(tables: Mapping[str, DataFrame]) -> DataFrame:
    """Null profiles of several tables as one frame; the scans run side by side."""
    return _union([null_profile(df, name) for name, df in tables.items()])


def distinct_profile(
    df: DataFrame,
    table: str,
    columns: Sequence[str] | None = None,
    method: str = "exact",
    chunk: int = DISTINCT_CHUNK,
    rsd: float = 0.05,
    wide: int = WIDE_TABLE,
) -> DataFrame:
    """Distinct non-null values of every column.

    Exact counts of several columns in one aggregate make Spark copy each row once per
    column, every copy as wide as all of them. Columns are therefore counted in chunks: a
    columnar scan reads each column once either way, and the copies stay narrow. Every
    chunk removes repeats before its shuffle, so hot values cost nothing extra. With more
    than ``wide`` columns the chunks would open the table too often: all columns of one type
    are then turned into rows (column, value) in one scan, of which repeats are removed.

    ``method="approx"`` counts all columns in one pass with fixed-size sketches.
    """
    names = list(columns if columns is not None else df.columns)
    if method not in ("exact", "approx"):
        raise ValueError(f"unknown method: {method}")
    if not names:
        return df.sparkSession.createDataFrame([], DISTINCT_SCHEMA)
    if method == "exact" and len(names) > wide:
        return _distinct_by_type(df, table, names)
    size = chunk if method == "exact" else len(names)
    call = "count(DISTINCT {})" if method == "exact" else f"approx_count_distinct({{}}, {rsd})"
    frames = []
    for start in range(0, len(names), size):
        part = names[start : start + size]
        counts = [f"{call.format(quoted(c))} AS _d{i}" for i, c in enumerate(part)]
        rows = [
            f"struct({literal(table)} AS TABLE_NAME, {literal(c)} AS COLUMN_NAME, _d{i} AS DISTINCT_COUNT)"
            for i, c in enumerate(part)
        ]
        frames.append(_long_form(df.selectExpr(*counts), rows))
    return _union(frames)


def _distinct_by_type(df: DataFrame, table: str, names: Sequence[str]) -> DataFrame:
    """Exact distinct counts from one scan per data type."""
    by_type: dict[str, list[str]] = {}
    for name in names:
        by_type.setdefault(df.select(quoted(name)).schema[0].dataType.simpleString(), []).append(name)
    frames = []
    for same in by_type.values():
        pairs = ", ".join(f"struct({i} AS _column, {quoted(c)} AS _value)" for i, c in enumerate(same))
        values = df.selectExpr(f"inline(array({pairs}))")
        counted = values.groupBy("_column", "_value").agg(F.expr("min(0) AS _zero"))
        # A column of nulls only still has its row, with a count of 0.
        counted = counted.groupBy("_column").agg(F.expr("count(_value) AS DISTINCT_COUNT"))
        listed = f"array({', '.join(literal(c) for c in same)})"
        every = df.sparkSession.range(len(same)).selectExpr(f"{listed}[id] AS COLUMN_NAME", "CAST(id AS INT) AS _at")
        joined = every.join(counted, F.expr("_at = _column"), "left")
        frames.append(joined.selectExpr(f"{literal(table)} AS TABLE_NAME", "COLUMN_NAME", "coalesce(DISTINCT_COUNT, 0L) AS DISTINCT_COUNT"))
    return _union(frames)


def column_profiles(df: DataFrame, table: str, method: str = "exact", chunk: int = DISTINCT_CHUNK) -> DataFrame:
    """Null and distinct figures of every column in one row per column."""
    return merge_profiles(null_profile(df, table), distinct_profile(df, table, method=method, chunk=chunk))


def merge_profiles(nulls: DataFrame, distincts: DataFrame) -> DataFrame:
    """Null and distinct profiles side by side; both have one row per column."""
    parts = nulls.unionByName(distincts, allowMissingColumns=True)
    figures = [c for c in parts.columns if c not in ("TABLE_NAME", "COLUMN_NAME")]
    return parts.groupBy("TABLE_NAME", "COLUMN_NAME").agg(*[F.expr(f"max({c}) AS {c}") for c in figures])


def null_rate_report(profile: DataFrame, picks: Mapping[str, Sequence[str]]) -> DataFrame:
    """(col, null_rate) for chosen columns of several tables, from the long profile."""
    wanted = [f"{table}.{name}" for table, names in picks.items() for name in names]
    rates = profile.selectExpr("concat_ws('.', TABLE_NAME, COLUMN_NAME) AS col", "NULL_RATE AS null_rate")
    return rates.filter(F.col("col").isin(wanted))


def high_null_columns(profile: DataFrame, threshold: float = NULL_THRESHOLD) -> DataFrame:
    """Profile rows strictly above the threshold, with the text of the finding."""
    tail = literal(f" exceeds threshold {threshold:.1%}")
    text = f"concat('Null rate ', {percent_text('NULL_RATE')}, {tail})"
    return profile.filter(F.col("NULL_RATE") > threshold).selectExpr("*", f"{text} AS ISSUE")


def high_null_issues(
    profile: DataFrame, keys: Mapping[str, Sequence[str]], threshold: float = NULL_THRESHOLD
) -> DataFrame:
    """One table-level issue per column above the null-rate threshold."""
    return high_null_columns(profile, threshold).selectExpr(
        *issue_columns(
            TABLE_NAME="TABLE_NAME",
            PRIMARY_KEY=per_value("TABLE_NAME", {table: ", ".join(names) for table, names in keys.items()}, ""),
            ROW_IDENTIFIER=literal(labels.TABLE_LEVEL),
            ISSUE_TYPE=literal(labels.HIGH_NULL_TYPE),
            ISSUE_DETAIL="concat('Column ', COLUMN_NAME, ': ', ISSUE)",
            SEVERITY=literal(labels.HIGH_NULL_SEVERITY),
            RULE_NAME=literal(labels.HIGH_NULL_RULE),
            COLUMN_NAME="COLUMN_NAME",
            NULL_RATE="NULL_RATE",
        )
    )


def duplicate_keys(df: DataFrame, keys: Sequence[str], max_extra: int = 0) -> DataFrame:
    """Key groups with more than ``max_extra`` extra rows; null keys form a group.

    The count is combined before the shuffle, so a hot key reaches its task as one row per
    map task.
    """
    counted = df.groupBy(*[quoted(k) for k in keys]).agg(F.expr("count(1) AS DUPLICATE_COUNT"))
    return counted.filter(f"DUPLICATE_COUNT - 1 > {int(max_extra)}")


def duplicate_key_issues(df: DataFrame, table: str, keys: Sequence[str], max_extra: int = 0) -> DataFrame:
    """One critical issue per duplicated key group."""
    groups = duplicate_keys(df, keys, max_extra)
    return groups.selectExpr(
        *issue_columns(
            TABLE_NAME=literal(table),
            PRIMARY_KEY=literal(", ".join(keys)),
            ROW_IDENTIFIER=named_values(groups, keys),
            ISSUE_TYPE=literal(labels.DUPLICATE_TYPE),
            ISSUE_DETAIL="concat('Duplicate PK with count=', CAST(DUPLICATE_COUNT AS STRING))",
            SEVERITY=literal(labels.DUPLICATE_SEVERITY),
            RULE_NAME=literal(labels.DUPLICATE_RULE),
            ROW_VALUES=payload_map(groups, keys),
        )
    )


def profile_issues(
    tables: Mapping[str, DataFrame],
    keys: Mapping[str, Sequence[str]],
    profile: DataFrame | None = None,
    threshold: float = NULL_THRESHOLD,
    max_extra: int = 0,
) -> DataFrame:
    """All profiling issues of several tables.

    Pass a stored ``profile`` to avoid scanning the tables for it again.
    """
    parts = [high_null_issues(null_profiles(tables) if profile is None else profile, keys, threshold)]
    for name, df in tables.items():
        if keys.get(name):
            parts.append(duplicate_key_issues(df, name, keys[name], max_extra))
    return _union(parts)


def _duplicate_group_counts(
    tables: Mapping[str, DataFrame], keys: Mapping[str, Sequence[str]], max_extra: int
) -> DataFrame:
    counted = [
        duplicate_keys(df, keys[name], max_extra).selectExpr(f"{literal(name)} AS TABLE_NAME", "count(1) AS _groups")
        for name, df in tables.items()
        if keys.get(name)
    ]
    if counted:
        return _union(counted)
    spark = next(iter(tables.values())).sparkSession
    return spark.createDataFrame([], "TABLE_NAME string, _groups bigint")


def table_profiles(
    tables: Mapping[str, DataFrame],
    keys: Mapping[str, Sequence[str]],
    profile: DataFrame | None = None,
    duplicates: DataFrame | None = None,
    threshold: float = NULL_THRESHOLD,
    max_extra: int = 0,
) -> DataFrame:
    """One row per table: size, keys, issue counts and issue texts.

    ``duplicates`` is a stored issue frame, or its counts per table, to count duplicate
    groups from; without it the groups are counted from the tables. All duplicate groups of a table are one table
    issue. Table issues come first in the text, then column issues in column order.
    """
    if profile is None:
        profile = null_profiles(tables)
    if duplicates is None:
        groups = _duplicate_group_counts(tables, keys, max_extra)
    else:
        found = duplicates.filter(F.col("ISSUE_TYPE") == labels.DUPLICATE_TYPE)
        each = "ISSUE_COUNT" if "ISSUE_COUNT" in found.columns else "1L"
        groups = found.groupBy("TABLE_NAME").agg(F.expr(f"sum({each}) AS _groups"))

    # Facts about a table, one text each; rank 0 is the table itself, others its columns.
    no_rows = "CAST(NULL AS BIGINT) AS ROW_COUNT"
    facts = [
        high_null_columns(profile, threshold).selectExpr(
            "TABLE_NAME", "ORDINAL_POSITION AS _rank", "concat(COLUMN_NAME, ': ', ISSUE) AS _text", no_rows
        ),
        profile.groupBy("TABLE_NAME").agg(F.expr("max(TOTAL_ROWS) AS ROW_COUNT")).selectExpr(
            "TABLE_NAME", "CAST(NULL AS INT) AS _rank", "CAST(NULL AS STRING) AS _text", "ROW_COUNT"
        ),
    ]
    bare = {name: df for name, df in tables.items() if not df.columns}
    if bare:
        facts.append(
            row_counts(bare).selectExpr(
                "TABLE_NAME", "0 AS _rank", f"{literal(labels.NO_COLUMNS)} AS _text", "ROW_COUNT"
            )
        )
    key_lists = per_value("TABLE_NAME", {name: repr(list(names)) for name, names in keys.items()}, "[]")
    facts.append(
        groups.filter("_groups > 0").selectExpr(
            "TABLE_NAME",
            "0 AS _rank",
            f"concat('Found ', CAST(_groups AS STRING), ' duplicate primary key group(s) on ', {key_lists}) AS _text",
            no_rows,
        )
    )

    merged = (
        _union(facts)
        .groupBy("TABLE_NAME")
        .agg(
            F.expr("max(ROW_COUNT) AS ROW_COUNT"),
            F.expr("array_sort(collect_list(IF(_text IS NULL, NULL, struct(_rank, _text)))) AS _texts"),
        )
        .selectExpr(
            "TABLE_NAME",
            "ROW_COUNT",
            "transform(filter(_texts, t -> t._rank > 0), t -> t._text) AS COLUMN_ISSUES",
            "transform(filter(_texts, t -> t._rank = 0), t -> t._text) AS TABLE_ISSUES",
        )
    )
    key_text = per_value("TABLE_NAME", {name: ", ".join(names) for name, names in keys.items()}, "")
    issues = "array_join(concat(TABLE_ISSUES, COLUMN_ISSUES), '; ')"
    return merged.selectExpr(
        "TABLE_NAME",
        "ROW_COUNT",
        f"{key_text} AS PRIMARY_KEYS",
        "CAST(size(COLUMN_ISSUES) AS BIGINT) AS COLUMN_ISSUE_COUNT",
        "CAST(size(TABLE_ISSUES) AS BIGINT) AS TABLE_ISSUE_COUNT",
        f"coalesce(nullif({issues}, ''), {literal(labels.NO_TABLE_ISSUES)}) AS ISSUES",
        "COLUMN_ISSUES",
        "TABLE_ISSUES",
    )


def stale_tables(
    tables: Mapping[str, tuple[DataFrame, str]], as_of: date | datetime | str, days: int = 90
) -> DataFrame:
    """Newest time stamp per table and whether it is older than ``days`` before ``as_of``.

    ``as_of`` is explicit, so a rerun gives the same answer.
    """
    frames = [
        df.selectExpr(
            f"{literal(name)} AS TABLE_NAME", f"CAST(max({quoted(stamp)}) AS TIMESTAMP_NTZ) AS LAST_UPDATED"
        )
        for name, (df, stamp) in tables.items()
    ]
    cutoff = f"CAST({literal(str(as_of))} AS TIMESTAMP_NTZ) - INTERVAL '{int(days)}' DAY"
    return _union(frames).selectExpr("*", f"coalesce(LAST_UPDATED < {cutoff}, false) AS IS_STALE")
