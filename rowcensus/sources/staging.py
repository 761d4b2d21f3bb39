"""Results of a run, written once and read back where they are needed again."""

from __future__ import annotations

import itertools
import re
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructType

SETTING = "spark.checkpoint.dir"
_opened: ContextVar[list | None] = ContextVar("opened", default=None)


@contextmanager
def passing_stages() -> Iterator[None]:
    """Remove the folders of all stages that are made inside, when the block ends.

    For a step whose result is stored elsewhere by then: what it kept on the way is of no
    further use.
    """
    token = _opened.set([])
    try:
        yield
    finally:
        for stage in _opened.get() or ():
            stage.close()
        _opened.reset(token)


def staging_root(spark: SparkSession) -> str:
    """The shared folder the cluster names; on a local session without one, a new folder.

    The local folder is never used on a cluster, where executors could not see it.
    """
    folder = spark.conf.get(SETTING, None) or spark.sparkContext.getCheckpointDir()
    if folder:
        return folder
    if not spark.conf.get("spark.master", "").startswith("local"):
        raise ValueError(f"set {SETTING} to a folder that all executors share")
    spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="rowcensus-"))
    return spark.sparkContext.getCheckpointDir()


class Stage:
    """One run's folder below the staging root.

    A written table survives the loss of executors, cuts the lineage, and lets every later
    summary read only the columns it needs.
    """

    def __init__(self, spark: SparkSession, root: str | None = None) -> None:
        self.spark = spark
        base = (root or staging_root(spark)).rstrip("/")
        self.folder = f"{base}/rowcensus/{uuid.uuid4().hex}"
        self._numbers = itertools.count(1)
        if _opened.get() is not None:
            _opened.get().append(self)

    def write(self, df: DataFrame, label: str) -> str:
        """Run ``df``, store its rows and return their path; labels need not be unique."""
        safe = re.sub(r"[^A-Za-z0-9_-]+", "_", label)[:60]
        path = f"{self.folder}/{next(self._numbers):05d}-{safe}"
        df.write.parquet(path)
        return path

    def write_findings(self, df: DataFrame, label: str) -> str:
        """Store rows that a large scan found few of.

        They are gathered into files of a sensible size first: without that, every task of
        the scan would leave a tiny file. Spark picks the number of files from the bytes it
        measures and splits partitions that are too large.
        """
        return self.write(df.hint("rebalance"), label)

    def close(self) -> None:
        """Remove the run's folder. No frame that reads from it may be used afterwards."""
        hadoop = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(self.folder)
        files = hadoop.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())
        files.delete(hadoop, True)

    def read(self, schema: StructType | str, *paths: str) -> DataFrame:
        return self.spark.read.schema(schema).parquet(*paths)
