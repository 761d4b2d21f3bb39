"""Partitioned Parquet tables profiled from footers and folder names, without reading rows."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from datetime import date, datetime
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T
from pyspark.sql.types import StructType

from ..functions.text import literal, quoted
from ..operators.profile import PROFILE_SCHEMA, null_profile
from .footers import footer_session

#: Types whose largest value Spark takes from a footer.
_ORDERED = (T.ByteType, T.ShortType, T.IntegerType, T.LongType, T.FloatType, T.DoubleType, T.DateType)


def _read(spark: SparkSession, folder: str, schema: StructType | None) -> DataFrame:
    """The table in a session that pushes counts down; the caller's session stays as it is.

    A folder without data files has no footers to count, and is read as it is.
    """

    def read(session: SparkSession) -> DataFrame:
        return (session.read.schema(schema) if schema is not None else session.read).parquet(folder)

    df = read(footer_session(spark))
    return df if df.inputFiles() else read(spark)


def partition_rows(df: DataFrame, partition_by: Sequence[str]) -> DataFrame:
    """Rows (partition columns, ``_rows``): how many rows each partition has, from the footers."""
    names = [quoted(p) for p in partition_by]
    return df.groupBy(*names).count().selectExpr(*names, "`count` AS _rows")


def partitioned_null_profile(
    spark: SparkSession,
    folder: str,
    table: str,
    partition_by: Sequence[str],
    schema: StructType | None = None,
) -> DataFrame:
    """Rows ``PROFILE_SCHEMA`` of a partitioned table, in the order of its columns.

    Plain columns are counted by the footers. A partition column is not in any file: its
    nulls are the rows of the partitions without a value, whose counts the footers have too.
    Nested columns are counted from their data, as footers do not describe them.
    """
    df = _read(spark, folder, schema)
    at = {f.name: i for i, f in enumerate(df.schema.fields, start=1)}
    data = df.selectExpr(*[quoted(c) for c in df.columns if c not in partition_by])
    numbered = f"element_at(map({', '.join(f'{literal(name)}, {i}' for name, i in at.items())}), COLUMN_NAME) AS ORDINAL_POSITION"
    names = [part.split()[0] for part in PROFILE_SCHEMA.split(", ")]
    profiled = null_profile(data, table).selectExpr(*[numbered if n == "ORDINAL_POSITION" else n for n in names])
    folders = partition_rows(df, partition_by)
    counts = ["coalesce(sum(_rows), 0L) AS _total"]
    counts += [f"coalesce(sum(IF({quoted(p)} IS NULL, _rows, 0L)), 0L) AS _n{i}" for i, p in enumerate(partition_by)]
    rows = [
        f"struct({literal(table)} AS TABLE_NAME, {literal(p)} AS COLUMN_NAME, {literal(df.schema[p].dataType.simpleString())} AS DATA_TYPE, "
        f"{at[p]} AS ORDINAL_POSITION, _total AS TOTAL_ROWS, _n{i} AS NULL_COUNT, _n{i} / greatest(_total, 1L) AS NULL_RATE)"
        for i, p in enumerate(partition_by)
    ]
    return profiled.union(folders.selectExpr(*counts).selectExpr(f"inline(array({', '.join(rows)}))"))


def newest(spark: SparkSession, folder: str, column: str, partition_by: Sequence[str], schema: StructType | None = None) -> DataFrame:
    """(LAST_UPDATED) of a partitioned table: the largest value of a column.

    A partition column is answered by the partitions that have rows. A date column of the
    files is answered by their footers. Time stamps have no usable order there and are read.
    """
    df = _read(spark, folder, schema)
    kind = df.schema[column].dataType
    if column in partition_by:
        df = partition_rows(df, partition_by).where("_rows > 0")
    elif not isinstance(kind, _ORDERED):
        df = spark.read.schema(df.schema).parquet(folder)
    return df.selectExpr(f"max({quoted(column)}) AS _newest").selectExpr("CAST(_newest AS TIMESTAMP_NTZ) AS LAST_UPDATED")


def stale_from_metadata(
    spark: SparkSession,
    tables: Mapping[str, tuple[str, str, Sequence[str]]],
    as_of: date | datetime | str,
    days: int = 90,
) -> DataFrame:
    """As ``stale_tables``, for partitioned tables given as (folder, column, partition columns)."""
    frames = [
        newest(spark, folder, column, partition_by).selectExpr(f"{literal(name)} AS TABLE_NAME", "LAST_UPDATED")
        for name, (folder, column, partition_by) in tables.items()
    ]
    cutoff = f"CAST({literal(str(as_of))} AS TIMESTAMP_NTZ) - INTERVAL '{int(days)}' DAY"
    return reduce(DataFrame.union, frames).selectExpr("*", f"coalesce(LAST_UPDATED < {cutoff}, false) AS IS_STALE")


def reads_rows(df: DataFrame) -> bool:
    """Whether the plan of ``df`` reads rows of a table, rather than footers and folder names."""
    plan = df._jdf.queryExecution().executedPlan().toString()
    scans = [line for line in plan.splitlines() if "Scan" in line and "parquet" in line.lower()]
    return any("PushedAggregation: []" in line or "PushedAggregation" not in line for line in scans)
