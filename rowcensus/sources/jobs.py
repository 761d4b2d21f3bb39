"""Independent Spark jobs side by side."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from concurrent.futures import ThreadPoolExecutor
from typing import TypeVar

from pyspark import inheritable_thread_target
from pyspark.sql import SparkSession

Result = TypeVar("Result")


def side_by_side(spark: SparkSession, calls: Sequence[Callable[[], Result]], limit: int) -> list[Result]:
    """Results of ``calls`` in order, at most ``limit`` of them at a time.

    Each call submits its own jobs, so the tail of one does not idle the cluster.
    """
    if limit <= 1 or len(calls) <= 1:
        return [call() for call in calls]
    with ThreadPoolExecutor(min(limit, len(calls))) as pool:
        # Each thread needs its own wrapper to inherit the session's properties.
        futures = [pool.submit(inheritable_thread_target(spark)(call)) for call in calls]
        return [future.result() for future in futures]
