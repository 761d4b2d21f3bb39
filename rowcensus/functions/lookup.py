"""Join of a large table to a lookup that has one row per key."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .text import quoted


def lookup_join(
    facts: DataFrame,
    lookup: DataFrame,
    on: Mapping[str, str],
    aggregates: Mapping[str, str] | None = None,
    how: str = "left",
) -> DataFrame:
    """Join ``facts`` to ``lookup`` reduced to one row per key.

    ``on`` maps fact columns to lookup columns; ``aggregates`` maps the names of values to
    attach to SQL aggregates over the lookup. Duplicated lookup keys are folded before the
    join, so a hot key never multiplies rows here.

    There is no broadcast hint: Catalyst broadcasts a lookup it measures below
    ``spark.sql.autoBroadcastJoinThreshold`` and sort-merges a larger one. In that second
    case AQE splits a hot key, and the rows without a key, at run time. It only does so for
    a join whose both sides are shuffled right below it, which an aggregate on the join key
    is not: it would hand over its own partitioning. So the lookup is joined on an
    expression that equals its key (``_zero`` is always 0) but that Spark cannot reduce to it.
    """
    names = [f"_key{i}" for i in range(len(on))]
    keyed = [f"{quoted(source)} AS {name}" for source, name in zip(on.values(), names)]
    values = dict(aggregates or {})
    grouped = lookup.selectExpr("*", *keyed).where(" AND ".join(f"{name} IS NOT NULL" for name in names))
    grouped = grouped.groupBy(*names).agg(
        *[F.expr(f"{value} AS {name}") for name, value in values.items()], F.expr("min(0) AS _zero")
    )
    right = grouped.selectExpr(*[f"IF(_zero = 0, {name}, NULL) AS {name}" for name in names], *values)

    matched = " AND ".join(f"{quoted(fact)} = {name}" for fact, name in zip(on, names))
    return facts.join(right, F.expr(matched), how).drop(*names)
