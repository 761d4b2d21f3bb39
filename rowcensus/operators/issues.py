"""The issue table: its schema, its rows, and how producers are combined."""

from __future__ import annotations

from collections.abc import Iterable, Sequence
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from ..functions.text import literal, quoted

ISSUE_SCHEMA = T.StructType(
    [
        T.StructField("DATABASE", T.StringType()),
        T.StructField("SCHEMA", T.StringType()),
        T.StructField("TABLE_NAME", T.StringType()),
        T.StructField("PRIMARY_KEY", T.StringType()),
        T.StructField("ROW_IDENTIFIER", T.StringType()),
        T.StructField("ISSUE_TYPE", T.StringType()),
        T.StructField("ISSUE_DETAIL", T.StringType()),
        T.StructField("SEVERITY", T.StringType()),
        T.StructField("RULE_NAME", T.StringType()),
        T.StructField("COLUMN_NAME", T.StringType()),
        T.StructField("NULL_RATE", T.DoubleType()),
        T.StructField("ROW_VALUES", T.MapType(T.StringType(), T.StringType())),
    ]
)


def issue_columns(**expressions: str) -> list[str]:
    """The select list of the issue table from SQL expressions; what is not given is null."""
    unknown = set(expressions) - set(ISSUE_SCHEMA.names)
    if unknown:
        raise ValueError(f"not columns of the issue table: {sorted(unknown)}")
    return [
        f"CAST({expressions.get(f.name, 'NULL')} AS {f.dataType.simpleString()}) AS {f.name}"
        for f in ISSUE_SCHEMA.fields
    ]


def empty_issues(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([], ISSUE_SCHEMA)


def combine_issues(spark: SparkSession, parts: Iterable[DataFrame]) -> DataFrame:
    """All producers as one frame, by column name; typed and empty if there are none."""
    frames = [
        df.selectExpr(*issue_columns(**{c: c for c in ISSUE_SCHEMA.names if c in df.columns})) for df in parts
    ]
    return reduce(DataFrame.union, frames) if frames else empty_issues(spark)


def stamp(issues: DataFrame, database: str | None, schema: str | None) -> DataFrame:
    """Set the two location columns to constants."""
    rest = [quoted(c) for c in issues.columns if c not in ("DATABASE", "SCHEMA")]
    location = [f"CAST({literal(v)} AS STRING) AS {k}" for k, v in (("DATABASE", database), ("SCHEMA", schema))]
    return issues.selectExpr(*location, *rest)


def widen_issues(issues: DataFrame, names: Sequence[str]) -> DataFrame:
    """Turn chosen payload names into real text columns."""
    kept = [quoted(c) for c in issues.columns if c != "ROW_VALUES"]
    return issues.selectExpr(
        *kept, *[f"try_element_at(ROW_VALUES, {literal(name)}) AS {quoted(name)}" for name in names]
    )
