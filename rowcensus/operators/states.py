"""Distinct counts as stored states that can be merged: sketches and bitmaps.

A count cannot be added up over days, files or partitions, but a state can. A sketch has a
fixed size and estimates; a bitmap is exact, for integers and dates. Both kinds of state are
plain tables, one row per column (and bucket) of a part, so a part is counted once, its
state is stored, and any union of parts is answered from the states alone.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.text import literal, quoted
from .profile import DISTINCT_SCHEMA, distinct_profile

LG_K = 12
SKETCH_SCHEMA = "TABLE_NAME string, PART string, COLUMN_NAME string, SKETCH binary"
BITMAP_SCHEMA = "TABLE_NAME string, PART string, COLUMN_NAME string, BUCKET bigint, BITMAP binary"

#: Values per bucket of Spark's bitmap functions.
BUCKET_VALUES = 32_768
#: A column whose values lie in at most so many buckets is counted together with others.
FEW_BUCKETS = 4
#: A bucket costs 4 KB; beyond so many values of range per row, distinct values cost less.
SPARSE = 64

_WHOLE = (T.ByteType, T.ShortType, T.IntegerType, T.LongType)


def _exprs(texts: Sequence[str]) -> list[Column]:
    return [F.expr(text) for text in texts]


def sketch_input(df: DataFrame, name: str) -> str:
    """What a sketch is fed for a column: the value itself where sketches take it, else its hash.

    A hash of 64 bits is far finer than the estimate. Nulls stay nulls, which sketches skip.
    """
    kind, col = df.schema[name].dataType, quoted(name)
    if isinstance(kind, (T.StringType, T.BinaryType, T.IntegerType, T.LongType)):
        return col
    hashed = f"to_json({col})" if isinstance(kind, (T.MapType, T.StructType, T.ArrayType, T.VariantType)) else col
    return f"IF({col} IS NULL, NULL, xxhash64({hashed}))"


def sketch_states(
    df: DataFrame, table: str, part: str | None = None, columns: Sequence[str] | None = None, lg_k: int = LG_K
) -> DataFrame:
    """Rows ``SKETCH_SCHEMA``: one sketch per column and part, from one pass over the rows.

    ``part`` is an SQL expression that names the part of a row, such as a day; without it all
    rows are one part, named by an empty text. Each task keeps one sketch of at most
    2 ** ``lg_k`` bytes or so per column and part, and only sketches are shuffled.
    """
    names = list(columns if columns is not None else df.columns)
    if not names:
        return df.sparkSession.createDataFrame([], SKETCH_SCHEMA)
    rows = df.selectExpr(
        f"coalesce(CAST({part or literal('')} AS STRING), '') AS _part",
        *[f"{sketch_input(df, name)} AS _c{i}" for i, name in enumerate(names)],
    )
    sketches = [f"hll_sketch_agg(_c{i}, {int(lg_k)}) AS _s{i}" for i in range(len(names))]
    wide = rows.groupBy("_part").agg(*_exprs(sketches))
    pairs = ", ".join(f"struct({literal(name)} AS COLUMN_NAME, _s{i} AS SKETCH)" for i, name in enumerate(names))
    long = wide.selectExpr("_part", f"inline(array({pairs}))")
    return long.selectExpr(f"{literal(table)} AS TABLE_NAME", "_part AS PART", "COLUMN_NAME", "SKETCH")


def merged_sketches(states: DataFrame) -> DataFrame:
    """Rows (TABLE_NAME, COLUMN_NAME, SKETCH): the union of all parts of each column."""
    return states.groupBy("TABLE_NAME", "COLUMN_NAME").agg(*_exprs(["hll_union_agg(SKETCH, true) AS SKETCH"]))


def sketch_counts(states: DataFrame) -> DataFrame:
    """Rows ``DISTINCT_SCHEMA``: estimates for the union of all parts of each column."""
    return merged_sketches(states).selectExpr("TABLE_NAME", "COLUMN_NAME", "hll_sketch_estimate(SKETCH) AS DISTINCT_COUNT")


def bitmap_value(df: DataFrame, name: str) -> str | None:
    """A column as whole numbers that follow each other densely, or None if it has no such form."""
    kind, col = df.schema[name].dataType, quoted(name)
    if isinstance(kind, _WHOLE):
        return f"CAST({col} AS BIGINT)"
    if isinstance(kind, T.DateType):
        return f"CAST(unix_date({col}) AS BIGINT)"
    if isinstance(kind, T.BooleanType):
        return f"CAST({col} AS BIGINT)"
    return None


def _spans(df: DataFrame, values: Mapping[str, str]) -> dict[str, tuple[int, int | None, int | None]]:
    """(rows, smallest, largest) bucket of each column, from one aggregate; facts of the schema's size."""
    if not values:
        return {}
    parts = ["count(1) AS _n"]
    for i, value in enumerate(values.values()):
        parts += [f"bitmap_bucket_number(min({value})) AS _l{i}", f"bitmap_bucket_number(max({value})) AS _h{i}"]
    row = df.selectExpr(*parts).first()
    return {name: (row["_n"], row[f"_l{i}"], row[f"_h{i}"]) for i, name in enumerate(values)}


def bitmap_columns(df: DataFrame, columns: Sequence[str] | None = None) -> tuple[list[tuple[str, int, int]], list[str], list[str]]:
    """Columns counted together (with their buckets), one by one, and not by bitmaps.

    A bitmap is right for any whole numbers, but pays only where they are dense. Buckets are
    whole ranges of values, so what a column is counted as never changes the count.
    """
    names = list(columns if columns is not None else df.columns)
    values = {name: value for name in names if (value := bitmap_value(df, name)) is not None}
    few, many = [], []
    for name, (rows, low, high) in _spans(df, values).items():
        buckets = 1 if low is None else high - low + 1
        if buckets <= FEW_BUCKETS:
            few.append((name, 1 if low is None else low, 1 if low is None else high))
        elif buckets * BUCKET_VALUES <= SPARSE * rows:
            many.append(name)
    known = {name for name, _, _ in few} | set(many)
    return few, many, [name for name in names if name not in known]


def bitmap_states(
    df: DataFrame,
    table: str,
    part: str | None = None,
    columns: Sequence[str] | None = None,
    planned: tuple[list[tuple[str, int, int]], list[str], list[str]] | None = None,
) -> DataFrame:
    """Rows ``BITMAP_SCHEMA``: which values occur in the whole-number and date columns.

    Columns with few buckets are counted together in one pass, a bitmap per bucket; the other
    dense ones one by one, grouped by bucket, each reading only its own column. No row is
    copied, and a task sends 4 KB per bucket at most instead of its distinct values. Columns
    that bitmaps do not suit are left out: ``bitmap_columns`` lists them.
    """
    few, many, _ = planned or bitmap_columns(df, columns)
    label = f"coalesce(CAST({part or literal('')} AS STRING), '') AS _part"
    frames = []
    if few:
        wide, rows = [], []
        for i, (name, low, high) in enumerate(few):
            for bucket in range(low, high + 1):
                wide.append(
                    f"bitmap_construct_agg(bitmap_bit_position(_c{i})) FILTER (WHERE bitmap_bucket_number(_c{i}) = {bucket}) "
                    f"AS _b{i}_{bucket - low}"
                )
                rows.append(f"struct({literal(name)} AS COLUMN_NAME, {bucket}L AS BUCKET, _b{i}_{bucket - low} AS BITMAP)")
        source = df.selectExpr(label, *[f"{bitmap_value(df, name)} AS _c{i}" for i, (name, _, _) in enumerate(few)])
        grouped = source.groupBy("_part") if part else source.groupBy()
        found = grouped.agg(*_exprs(wide)).selectExpr("_part" if part else "'' AS _part", f"inline(array({', '.join(rows)}))")
        frames.append(found.where("bitmap_count(BITMAP) > 0").selectExpr("_part", "COLUMN_NAME", "BUCKET", "BITMAP"))
    for name in many:
        source = df.selectExpr(label, f"{bitmap_value(df, name)} AS _v").where("_v IS NOT NULL")
        source = source.selectExpr("_part", "bitmap_bucket_number(_v) AS BUCKET", "bitmap_bit_position(_v) AS _bit")
        found = source.groupBy("_part", "BUCKET").agg(*_exprs(["bitmap_construct_agg(_bit) AS BITMAP"]))
        frames.append(found.selectExpr("_part", f"{literal(name)} AS COLUMN_NAME", "BUCKET", "BITMAP"))
    if not frames:
        return df.sparkSession.createDataFrame([], BITMAP_SCHEMA)
    return reduce(DataFrame.union, frames).selectExpr(
        f"{literal(table)} AS TABLE_NAME", "_part AS PART", "COLUMN_NAME", "BUCKET", "BITMAP"
    )


def bitmap_counts(states: DataFrame) -> DataFrame:
    """Rows ``DISTINCT_SCHEMA``: exact counts for the union of all parts of each column."""
    merged = states.groupBy("TABLE_NAME", "COLUMN_NAME", "BUCKET").agg(*_exprs(["bitmap_or_agg(BITMAP) AS _all"]))
    counted = merged.groupBy("TABLE_NAME", "COLUMN_NAME").agg(*_exprs(["sum(bitmap_count(_all)) AS DISTINCT_COUNT"]))
    return counted.selectExpr("TABLE_NAME", "COLUMN_NAME", "CAST(DISTINCT_COUNT AS BIGINT) AS DISTINCT_COUNT")


def distinct_bitmaps(df: DataFrame, table: str, columns: Sequence[str] | None = None) -> DataFrame:
    """Exact distinct counts of every column, by bitmaps where they suit and by value elsewhere.

    The same rows as ``distinct_profile``, columns without values included.
    """
    planned = bitmap_columns(df, columns)
    few, many, rest = planned
    by_bits = [name for name, _, _ in few] + many
    frames = []
    if by_bits:
        counts = bitmap_counts(bitmap_states(df, table, planned=planned))
        every = df.sparkSession.createDataFrame([(table, name, 0) for name in by_bits], DISTINCT_SCHEMA)
        both = counts.union(every).groupBy("TABLE_NAME", "COLUMN_NAME")
        frames.append(both.agg(*_exprs(["max(DISTINCT_COUNT) AS DISTINCT_COUNT"])))
    if rest:
        frames.append(distinct_profile(df, table, rest))
    return reduce(DataFrame.union, frames) if frames else df.sparkSession.createDataFrame([], DISTINCT_SCHEMA)
