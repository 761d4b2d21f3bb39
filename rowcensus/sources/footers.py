"""Null profiles of Parquet tables from their file footers, without reading data."""

from __future__ import annotations

import logging
from collections.abc import Mapping, Sequence
from functools import partial

from pyspark.sql import DataFrame, SparkSession

from ..operators.profile import null_profiles
from .catalog import described_table, table_ref
from .jobs import side_by_side
from .staging import Stage

log = logging.getLogger(__name__)

V1_SOURCES = "spark.sql.sources.useV1SourceList"
PUSHDOWN = "spark.sql.parquet.aggregatePushdown"


def parquet_location(spark: SparkSession, *parts: str) -> str | None:
    """The folder of an unpartitioned Parquet table of the catalog, else None.

    A catalog that cannot tell is logged; the table is scanned then.
    """
    try:
        facts = described_table(spark, *parts)
    except Exception as error:
        log.warning("no folder of %s: %s", table_ref(*parts), error)
        return None
    if facts.get("Provider") != "parquet" or "# Partition Information" in facts:
        return None
    return facts.get("Location")


def footer_session(spark: SparkSession) -> SparkSession:
    """A sibling session that pushes counts down to Parquet; the caller's stays as it is.

    It has the settings that the caller has changed at run time, such as credentials.
    """
    sibling = spark.newSession()
    for name, value in spark.conf.getAll.items():
        if spark.conf.isModifiable(name) and sibling.conf.get(name, None) != value:
            sibling.conf.set(name, value)
    listed = sibling.conf.get(V1_SOURCES).split(",")
    sibling.conf.set(V1_SOURCES, ",".join(s for s in listed if s.strip() != "parquet"))
    sibling.conf.set(PUSHDOWN, "true")
    return sibling


def write_footer_profile(
    spark: SparkSession,
    tables: Mapping[str, DataFrame],
    paths: Mapping[str, str],
    stage: Stage,
    parallel: int = 4,
) -> tuple[list[str], list[str]]:
    """Store the null profile of ``tables`` as found in the footers below ``paths``.

    Returns where it is stored, and the tables that Spark cannot answer for, for example
    because a writer left out the statistics or a file lacks a later column; those have to
    be scanned. All tables are tried in one job and, should that fail, one by one. A table
    without data files has no footers, and counts that are pushed down to none come back wrong.
    """
    bare = [name for name, df in tables.items() if not df.inputFiles()]
    if bare:
        rest = {name: df for name, df in tables.items() if name not in bare}
        found, failed = write_footer_profile(spark, rest, paths, stage, parallel) if rest else ([], [])
        return found, bare + failed
    session = footer_session(spark)

    def stored(names: Sequence[str]) -> str | None:
        frames = {t: session.read.schema(tables[t].schema).parquet(paths[t]) for t in names}
        try:
            return stage.write(null_profiles(frames).coalesce(1), "footers")
        except Exception as error:
            log.warning("no null profile from the footers of %s: %s", sorted(names), error)
            return None

    names = list(tables)
    path = stored(names)
    if path is not None:
        return [path], []
    if len(names) == 1:
        return [], names
    single = side_by_side(spark, [partial(stored, [name]) for name in names], parallel)
    return [p for p in single if p is not None], [n for n, p in zip(names, single) if p is None]
