"""The five datasets of a report, written below one folder per run and published at once."""

from __future__ import annotations

import json
from collections.abc import Mapping
from functools import partial, reduce

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..functions import labels
from ..functions.text import NESTED, quoted
from ..sources.jobs import side_by_side
from ..sources.resume import SharedFiles

# Dataset names in report order.
DATASETS = ("Overview", "Rule_Summary", "Table_Profiles", "Row_Issues", "LLM_Table_Summaries")
PREFIX = "dq_governance_report"
MANIFEST = "manifest.json"


class IncompleteReport(Exception):
    """A folder that holds no report, or one that is not whole."""


def _as_text(df: DataFrame) -> DataFrame:
    """Maps and arrays as JSON, for formats without nested types."""
    columns = [(quoted(f.name), isinstance(f.dataType, NESTED)) for f in df.schema.fields]
    return df.selectExpr(*[f"to_json({name}) AS {name}" if nested else name for name, nested in columns])


def write_report(
    frames: Mapping[str, DataFrame],
    folder: str,
    run_stamp: str,
    prefix: str = PREFIX,
    csv: bool = False,
) -> str:
    """Write the datasets to ``{folder}/{prefix}_{run_stamp}/<name>`` and return that path.

    Row issues are partitioned by severity, so a reader of the critical ones touches only
    those files. Empty datasets keep their schema. With ``csv``, the small datasets are
    also written as text below ``csv/``, where an empty one holds a single message row.

    The manifest, with the rows of every dataset as counted while they were written, is
    written last: a folder without it is no report, whatever else it holds, and
    ``read_report`` says so.
    """
    run_dir = f"{folder.rstrip('/')}/{prefix}_{run_stamp}"

    def write(name: str) -> int:
        df = frames[name]
        seen = Observation()
        # Gathered by severity first: else every task leaves a file in each folder. Spark
        # splits the partitions of a severity that holds most of the issues.
        rows = df.hint("rebalance", "SEVERITY") if name == "Row_Issues" else df
        rows = rows.observe(seen, F.count(F.lit(1)).alias("rows"))
        writer = rows.write.mode("error")
        if name == "Row_Issues":
            writer = writer.partitionBy("SEVERITY")
        writer.parquet(f"{run_dir}/{name}")
        if csv and name != "Row_Issues":
            small = df
            if not seen.get["rows"]:
                small = df.sparkSession.createDataFrame([(labels.EMPTY_DATASET,)], "message string")
            _as_text(small).coalesce(1).write.mode("error").csv(f"{run_dir}/csv/{name}", header=True)
        return int(seen.get["rows"])

    spark = frames[DATASETS[0]].sparkSession
    counts = side_by_side(spark, [partial(write, name) for name in DATASETS], len(DATASETS))
    schemas = {name: frames[name].schema.jsonValue() for name in DATASETS}
    manifest = {"run": run_stamp, "rows": dict(zip(DATASETS, counts)), "schemas": schemas}
    SharedFiles(spark).write(f"{run_dir}/{MANIFEST}", json.dumps(manifest))
    return run_dir


def read_report(spark: SparkSession, run_dir: str, check_rows: bool = True) -> dict[str, DataFrame]:
    """The datasets of a published report; with ``check_rows``, only if all their rows are there."""
    files = SharedFiles(spark)
    if not files.exists(f"{run_dir}/{MANIFEST}"):
        raise IncompleteReport(f"{run_dir} holds no manifest")
    manifest = json.loads(files.read(f"{run_dir}/{MANIFEST}"))
    frames = {}
    for name in DATASETS:
        schema = StructType.fromJson(manifest["schemas"][name])
        frames[name] = spark.read.schema(schema).parquet(f"{run_dir}/{name}")
    if check_rows:
        counted = [frame.selectExpr(f"'{name}' AS name", "count(1) AS n") for name, frame in frames.items()]
        found = {row["name"]: row["n"] for row in reduce(DataFrame.union, counted).collect()}
        wrong = {name: (n, found[name]) for name, n in manifest["rows"].items() if found[name] != n}
        if wrong:
            raise IncompleteReport(f"{run_dir}: rows written and found differ: {wrong}")
    return frames


def latest_report(spark: SparkSession, folder: str, prefix: str = PREFIX) -> str | None:
    """The folder of the newest published report; runs that broke do not count."""
    folder, files = folder.rstrip("/"), SharedFiles(spark)
    names = [name for name in files.names(folder) if name.startswith(f"{prefix}_") and files.exists(f"{folder}/{name}/{MANIFEST}")]
    return f"{folder}/{max(names)}" if names else None
