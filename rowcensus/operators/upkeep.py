"""Keyed upkeep of tables, as plain frame transformations."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame

from ..functions.lookup import lookup_join
from ..functions.text import literal, quoted


def missing_rows(target: DataFrame, source: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Source rows whose key the target does not have.

    The target is first cut down to the keys the source asks about, so when the source is
    small the target is only scanned, never shuffled; repeats fold before the anti join.
    """
    on = {k: k for k in keys}
    names = [quoted(k) for k in keys]
    key_rows = target.selectExpr(*names).dropna()
    present = lookup_join(key_rows, source.selectExpr(*names), on, how="left_semi")
    return lookup_join(source, present, on, how="left_anti")


def insert_missing(target: DataFrame, source: DataFrame, keys: Sequence[str]) -> DataFrame:
    """The target plus the source rows whose key is missing; matched rows stay untouched."""
    fresh = missing_rows(target, source, keys)
    return target.union(fresh.selectExpr(*[quoted(c) for c in target.columns]))


def apply_corrections(
    target: DataFrame,
    corrections: DataFrame,
    keys: Sequence[str],
    columns: Sequence[str],
    sequence: str | None = None,
) -> DataFrame:
    """Set ``columns`` of matching rows to the corrected values; null is a real value.

    With ``sequence``, the correction with the largest value of that column wins. Without
    it, two corrections for one key are an error, never a silent choice.
    """
    new = f"struct({', '.join(f'{quoted(c)} AS {quoted(c)}' for c in columns)})"
    if sequence is None:
        text = literal("more than one correction for a key: " + ", ".join(keys))
        values = {"_new": f"IF(count(1) > 1, raise_error({text}), first({new}))"}
    else:
        values = {"_new": f"max_by({new}, {quoted(sequence)})"}
    joined = lookup_join(target, corrections, {k: k for k in keys}, values)
    corrected = set(columns)
    out = []
    for f in target.schema.fields:
        name = quoted(f.name)
        if f.name in corrected:
            new_value = f"CAST(_new.{name} AS {f.dataType.simpleString()})"
            out.append(f"IF(_new IS NOT NULL, {new_value}, {name}) AS {name}")
        else:
            out.append(name)
    return joined.selectExpr(*out)


def ensure_column(df: DataFrame, name: str, data_type: str) -> DataFrame:
    """Add a null-filled, typed column unless the table already has it (any case)."""
    if name.upper() in (c.upper() for c in df.columns):
        return df
    return df.selectExpr("*", f"CAST(NULL AS {data_type}) AS {quoted(name)}")
