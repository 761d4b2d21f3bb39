"""Queries over stored states: profiles by file, sketches, bitmaps, and few shuffled keys."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rowcensus.operators import profile as P
from rowcensus.operators import states as ST
from rowcensus.operators.prefilter import duplicate_keys_prefiltered
from rowcensus.operators.rules import Rule, run_rule
from rowcensus.plans.answers import AnswerStore
from rowcensus.plans.incremental import ProfileStore
from rowcensus.plans.stored import correct_stored, insert_stored
from rowcensus.sources.catalog import ROW_POSITION, with_row_position
from rowcensus.sources.partitioned import partitioned_null_profile, stale_from_metadata
from rowcensus.sources.staging import Stage

from .inputs import PROJECTIONS, derived, table


def _stored(stage: Stage, frame: DataFrame, label: str) -> DataFrame:
    return stage.read(frame.schema, stage.write(frame, label))


def _by_year(rows: DataFrame) -> DataFrame:
    return rows.withColumn("y", F.year("o_orderdate"))


#: The year whose files are replaced between the two steps, and the rows that are gone then.
REPLACED = 1995
GONE = f"year(o_orderdate) = {REPLACED} AND o_orderpriority = '5-LOW'"


def _two_steps(spark: SparkSession, sf: str) -> tuple[ProfileStore, str, DataFrame]:
    """A table that grows and changes, profiled after each of two steps.

    The first half of the years is written and profiled; then the other half is added, and
    one year is replaced by fewer rows. The second update reads the new files only.
    """
    stage, rows = Stage(spark), _by_year(derived(spark, sf, "orders_d"))
    folder, store = f"{stage.folder}/orders", ProfileStore(spark, f"{stage.folder}/profiles")
    half = f"y <= {REPLACED}"
    rows.where(half).write.partitionBy("y").parquet(folder)
    store.update("orders_d", folder)
    changed = rows.where(f"NOT ({half})").union(rows.where(f"y = {REPLACED} AND NOT ({GONE})"))
    changed.write.partitionBy("y").mode("overwrite").option("partitionOverwriteMode", "dynamic").parquet(folder)
    store.update("orders_d", folder)
    return store, folder, rows


def incremental_profile(spark, sf):
    """The merged profile equals that of a full scan, and newest dates come from the states."""
    store, folder, rows = _two_steps(spark, sf)
    schema = spark.read.parquet(folder).schema
    newest = store.newest("orders_d", "o_orderdate").select("LAST_UPDATED")
    profile = store.null_profile("orders_d", schema).where("COLUMN_NAME != 'y'")
    return profile.join(newest, F.col("COLUMN_NAME") == "o_orderdate", "left")


def incremental_distincts(spark, sf):
    """Whether the sketches of all files together lie close to the exact counts of the table."""
    store, folder, rows = _two_steps(spark, sf)
    exact = P.distinct_profile(spark.read.parquet(folder), "orders_d", list(PROJECTIONS["orders_d"]))
    close = store.distinct_counts("orders_d").withColumnRenamed("DISTINCT_COUNT", "ESTIMATE")
    return exact.join(close, ["TABLE_NAME", "COLUMN_NAME"]).selectExpr(
        "TABLE_NAME", "COLUMN_NAME", "DISTINCT_COUNT", "abs(ESTIMATE - DISTINCT_COUNT) <= 0.05 * DISTINCT_COUNT AS CLOSE"
    )


def distinct_bitmaps(spark, sf):
    names = ("lineitem", "orders", "events")
    frames = [ST.distinct_bitmaps(table(spark, sf, name), name) for name in names]
    return frames[0].union(frames[1]).union(frames[2])


ROLLED_UP = ("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber")


def distinct_bitmaps_rollup(spark, sf):
    """Exact counts of every year and of all of them, from bitmaps stored by month."""
    lines = table(spark, sf, "lineitem")
    states = ST.bitmap_states(lines, "lineitem", "date_format(l_shipdate, 'yyyy-MM')", ROLLED_UP)
    states = _stored(Stage(spark), states, "bitmaps")
    years = ST.bitmap_counts(states.withColumn("TABLE_NAME", F.expr("left(PART, 4)")))
    return years.union(ST.bitmap_counts(states)).withColumnRenamed("TABLE_NAME", "SLICE")


def distinct_sketches(spark, sf):
    """Sketches stored by month: their union agrees with the sketch of the whole and with the exact count.

    Both hold the same values; an estimate also depends a little on how a sketch was made.
    """
    stage, source = Stage(spark), table(spark, sf, "lineitem")
    months = ST.sketch_states(source, "lineitem", "date_format(l_shipdate, 'yyyy-MM')")
    whole = ST.sketch_counts(ST.sketch_states(source, "lineitem")).withColumnRenamed("DISTINCT_COUNT", "WHOLE")
    union = ST.sketch_counts(_stored(stage, months, "sketches")).withColumnRenamed("DISTINCT_COUNT", "MERGED")
    exact = P.distinct_profile(source, "lineitem")
    keys = ["TABLE_NAME", "COLUMN_NAME"]
    return exact.join(union, keys).join(whole, keys).selectExpr(
        *keys, "DISTINCT_COUNT", "abs(MERGED - DISTINCT_COUNT) <= 0.05 * DISTINCT_COUNT AS CLOSE",
        "abs(MERGED - WHOLE) <= 0.05 * DISTINCT_COUNT AS AGREES"
    )


def duplicate_keys_prefiltered_lines(spark, sf):
    return duplicate_keys_prefiltered(table(spark, sf, "lineitem"), ["l_orderkey", "l_linenumber"])


def duplicate_keys_nearly_unique(spark, sf):
    """Wide keys of which few repeat: the text and the time stamp of an event."""
    keys = ["user_id", "ts", "event_type", "props"]
    return duplicate_keys_prefiltered(table(spark, sf, "events"), keys)


def apply_corrections_stored(spark, sf):
    """Corrections rewrite the years that hold a corrected order, and no other file."""
    stage, orders = Stage(spark), table(spark, sf, "orders")
    folder = f"{stage.folder}/orders"
    _by_year(orders).write.partitionBy("y").parquet(folder)
    fixes = orders.where(CORRECTED).select(
        "o_orderkey", F.lit(None).cast("double").alias("o_totalprice"), F.lit("X").alias("o_orderstatus")
    )
    correct_stored(spark, folder, fixes, ["o_orderkey"], ["o_orderstatus", "o_totalprice"], ["y"], stage=stage)
    return spark.read.parquet(folder).drop("y")


CORRECTED = "o_orderdate >= TIMESTAMP '1995-06-01' AND o_orderdate < TIMESTAMP '1996-03-01' AND o_orderpriority = '1-URGENT'"


def insert_missing_stored(spark, sf):
    """Rows of two years are missing from a stored table; what is missing is appended."""
    stage, orders = Stage(spark), _by_year(table(spark, sf, "orders"))
    folder = f"{stage.folder}/orders"
    orders.where("y NOT IN (1993, 1996) OR o_orderkey % 2 = 0").write.partitionBy("y").parquet(folder)
    insert_stored(spark, folder, orders, ["o_orderkey"], ["y"], stage)
    return spark.read.parquet(folder).drop("y")


def rule_row_position(spark, sf):
    """Rows of a rule without a key, by their place in the file: equal rows stay apart."""
    lines = with_row_position(table(spark, sf, "lineitem")).selectExpr("l_linenumber", "l_quantity", ROW_POSITION)
    rule = Rule(id="bulk_line", table="lines", where="l_quantity = 50", position=True)
    found = run_rule(spark, rule, "spark_catalog", "census", {"lines": lines}.__getitem__)
    return found.selectExpr("ISSUE_TYPE", "TABLE_NAME", "PRIMARY_KEY", "CAST(substring_index(ROW_IDENTIFIER, '#', -1) AS BIGINT) AS ROW_INDEX")


def partitioned_profile(spark, sf):
    """Nulls of a partitioned table, partition columns included, from footers and folder names."""
    stage = Stage(spark)
    folder = f"{stage.folder}/orders_d"
    rows = _by_year(derived(spark, sf, "orders_d")).withColumn("s", F.expr("nullif(o_orderstatus, 'P')"))
    rows.write.partitionBy("y", "s").parquet(folder)
    return partitioned_null_profile(spark, folder, "orders_d", ["y", "s"]).drop("DATA_TYPE")


def partitioned_staleness(spark, sf):
    """Newest dates of partitioned tables without reading rows: a date column and a partition."""
    stage = Stage(spark)
    orders = table(spark, sf, "orders").withColumn("day", F.to_date("o_orderdate"))
    lines = table(spark, sf, "lineitem").withColumn("month", F.trunc(F.to_date("l_shipdate"), "MM"))
    orders.withColumn("y", F.year("day")).write.partitionBy("y").parquet(f"{stage.folder}/orders")
    lines.write.partitionBy("month").parquet(f"{stage.folder}/lines")
    stamps = {"orders": (f"{stage.folder}/orders", "day", ["y"]), "lines": (f"{stage.folder}/lines", "month", ["month"])}
    return stale_from_metadata(spark, stamps, "2024-02-15", 90)


def stored_answers(spark, sf):
    """Issue groups asked in two runs: the second asks only what the first was not answered."""
    stage = Stage(spark)
    orders = derived(spark, sf, "orders_d")
    prompts = orders.groupBy("o_orderstatus").agg(F.count(F.lit(1)).alias("n")).selectExpr(
        "o_orderstatus", "concat('Orders in state ', o_orderstatus, ': ', n) AS PROMPT"
    )
    store = AnswerStore(spark, f"{stage.folder}/answers", "first")
    store.respond(prompts.where("o_orderstatus != 'P'"), said("early"), stage)
    return store.respond(prompts, said("late"), stage)


def said(word):
    """A stand-in for a model whose answers tell which run asked."""
    return lambda prompts: [f"{word}: {prompt}" for prompt in prompts]


STORED = (
    incremental_profile, incremental_distincts, distinct_bitmaps, distinct_bitmaps_rollup, distinct_sketches,
    duplicate_keys_prefiltered_lines, duplicate_keys_nearly_unique, apply_corrections_stored, insert_missing_stored,
    rule_row_position, partitioned_profile, partitioned_staleness, stored_answers,
)
