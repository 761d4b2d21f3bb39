"""Upkeep of stored, partitioned tables: only what changes is written."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.lookup import lookup_join
from ..functions.text import quoted
from ..operators.upkeep import apply_corrections, missing_rows
from ..sources.staging import Stage

#: Partitions rewritten by one job; more of them are rewritten by several.
PARTITIONS_EACH = 500


def _column(name: str) -> Column:
    return F.col(quoted(name))


def touched_partitions(target: DataFrame, changed: DataFrame, keys: Sequence[str], partition_by: Sequence[str]) -> list[tuple]:
    """The partitions of ``target`` that hold a key of ``changed``.

    Only the key columns are read, and the target is not shuffled if ``changed`` is small.
    The values name folders, of which Spark's own listing is on the driver as well.
    """
    names = [quoted(c) for c in (*keys, *[p for p in partition_by if p not in keys])]
    hit = lookup_join(target.selectExpr(*names), changed.selectExpr(*[quoted(k) for k in keys]), {k: k for k in keys}, how="left_semi")
    rows = hit.select(*[_column(p) for p in partition_by]).distinct().collect()
    return sorted((tuple(row) for row in rows), key=repr)


def _among(values: Sequence[tuple], partition_by: Sequence[str]) -> Column:
    """Rows of these partitions, in a form that prunes folders."""
    if len(partition_by) == 1:
        known = [v for (v,) in values if v is not None]
        one = _column(partition_by[0])
        tests = ([one.isin(known)] if known else []) + ([one.isNull()] if len(known) < len(values) else [])
        return reduce(Column.__or__, tests)
    whole = [reduce(Column.__and__, [_column(p).eqNullSafe(F.lit(v)) for p, v in zip(partition_by, row)]) for row in values]
    return reduce(Column.__or__, whole)


def correct_stored(
    spark: SparkSession,
    folder: str,
    corrections: DataFrame,
    keys: Sequence[str],
    columns: Sequence[str],
    partition_by: Sequence[str],
    sequence: str | None = None,
    stage: Stage | None = None,
) -> list[tuple]:
    """Apply corrections to a stored table; return the partitions that were rewritten.

    Only partitions that hold a corrected key are read whole and overwritten; the files of
    the others stay as they are. A partition's new rows are first stored in the stage, so
    they are complete before anything is overwritten, and a broken overwrite can be repeated
    from there or by the same call. Partition columns cannot be corrected.
    """
    if set(columns) & set(partition_by):
        raise ValueError(f"partition columns cannot be corrected: {sorted(set(columns) & set(partition_by))}")
    stage = stage or Stage(spark)
    target = spark.read.parquet(folder)
    corrections = stage.read(corrections.schema, stage.write(corrections, "corrections"))
    touched = touched_partitions(target, corrections, keys, partition_by)
    for at in range(0, len(touched), PARTITIONS_EACH):
        part = target.where(_among(touched[at : at + PARTITIONS_EACH], partition_by))
        fixed = apply_corrections(part, corrections, keys, columns, sequence)
        fixed = stage.read(fixed.schema, stage.write(fixed, "corrected"))
        # Rows of a partition go to a few tasks each, so that it keeps files of a sensible size.
        writer = fixed.hint("rebalance", *partition_by).write.partitionBy(*partition_by).mode("overwrite")
        writer.option("partitionOverwriteMode", "dynamic").parquet(folder)
    return touched


def insert_stored(
    spark: SparkSession,
    folder: str,
    source: DataFrame,
    keys: Sequence[str],
    partition_by: Sequence[str],
    stage: Stage | None = None,
) -> int:
    """Append the source rows whose key the stored table does not have; return how many.

    No file of the table is rewritten. The rows are stored first, so a repeated call after a
    broken one appends each of them once. Of source rows with one key all are appended, as
    ``insert_missing`` does.
    """
    stage = stage or Stage(spark)
    target = spark.read.parquet(folder)
    fresh = missing_rows(target, source, keys).selectExpr(*[quoted(c) for c in target.columns])
    fresh = stage.read(fresh.schema, stage.write_findings(fresh, "missing"))
    count = fresh.count()
    if count:
        fresh.write.partitionBy(*partition_by).mode("append").parquet(folder)
    return count
