"""Joins of wide rows to a few narrow ones."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BROADCAST_ROWS = 1_000_000


def keep_matching(rows: DataFrame, keys: DataFrame, on: Column | str, how: str = "left_semi") -> DataFrame:
    """Join ``rows`` to stored narrow ``keys``, which are sent to the rows if they are few.

    ``keys`` are a stored table of a few numbers a row. They are counted, and up to
    ``BROADCAST_ROWS`` of them (some 20 MB) are broadcast, so that texts need not move;
    beyond that both sides are shuffled. The result is the same.
    """
    few = keys.count() <= BROADCAST_ROWS
    return rows.join(F.broadcast(keys) if few else keys.hint("merge"), on, how)
