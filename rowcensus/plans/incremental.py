"""Profiles that are kept up to date file by file: only new files are read."""

from __future__ import annotations

import uuid
from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..functions.text import NESTED, literal, quoted
from ..operators.profile import PROFILE_SCHEMA
from ..operators.states import LG_K, sketch_input
from ..sources.catalog import TableFiles

STATE_SCHEMA = (
    "TABLE_NAME string, FILE string, COLUMN_NAME string, TOTAL_ROWS bigint, NULL_COUNT bigint, "
    "NEWEST timestamp_ntz, SKETCH binary, RUN string"
)
#: Profiled files whose states share a file of the store.
FILES_EACH = 10_000
LIVE_SCHEMA = "TABLE_NAME string, FILE string, CHANGED bigint, SIZE bigint, RUN string"


@dataclass(frozen=True)
class Update:
    """What an update did: files read, kept as they were, and gone since."""

    read: int
    kept: int
    gone: int


def _stamped(kind: T.DataType) -> bool:
    return isinstance(kind, (T.DateType, T.TimestampType, T.TimestampNTZType))


def file_states(rows: DataFrame, table: str, columns: StructType, lg_k: int, run: str) -> DataFrame:
    """Rows ``STATE_SCHEMA``: rows, nulls, newest time stamp and sketch of every column of every file.

    ``rows`` reads the files to be profiled. One pass; a task keeps one state per column and
    file it reads, and a file is read by few tasks, so states are all that is shuffled. A
    file of which no row is left still has its row, with nothing in it, in the listing.
    """
    fields = list(columns.fields)
    inputs, aggregates, pairs = ["_metadata.file_path AS _file"], ["count(1) AS _n"], []
    for i, f in enumerate(fields):
        nested = isinstance(f.dataType, NESTED)
        inputs.append(f"{quoted(f.name)} IS NULL AS _z{i}" if nested else f"{quoted(f.name)} AS _v{i}")
        aggregates.append(f"count_if(_z{i}) AS _n{i}" if nested else f"count(1) - count(_v{i}) AS _n{i}")
        if _stamped(f.dataType):
            aggregates.append(f"CAST(max(_v{i}) AS TIMESTAMP_NTZ) AS _t{i}")
        if lg_k:
            inputs.append(f"{sketch_input(rows, f.name)} AS _h{i}")
            aggregates.append(f"hll_sketch_agg(_h{i}, {lg_k}) AS _s{i}")
        newest = f"_t{i}" if _stamped(f.dataType) else "CAST(NULL AS TIMESTAMP_NTZ)"
        sketch = f"_s{i}" if lg_k else "CAST(NULL AS BINARY)"
        pairs.append(
            f"struct({literal(f.name)} AS COLUMN_NAME, _n AS TOTAL_ROWS, _n{i} AS NULL_COUNT, {newest} AS NEWEST, {sketch} AS SKETCH)"
        )
    grouped = rows.selectExpr(*inputs).groupBy("_file").agg(*[F.expr(a) for a in aggregates])
    long = grouped.selectExpr("_file", f"inline(array({', '.join(pairs)}))")
    return long.selectExpr(
        f"{literal(table)} AS TABLE_NAME", "_file AS FILE", "COLUMN_NAME", "TOTAL_ROWS", "NULL_COUNT", "NEWEST", "SKETCH",
        f"{literal(run)} AS RUN",
    )


class ProfileStore:
    """A folder of file states from which the profile of a table follows without reading it.

    Every update writes the states of new files below ``states/<run>`` and then, as its last
    step, the list of live files below ``live/<number>``, each with the run that profiled it.
    The newest complete list counts: an update that breaks leaves the store as it was, and
    states that no list names are never read. A file that has changed its time or size is a
    new file. Files that are gone drop out of the list, and with them their numbers.

    One writer at a time; readers need no lock, because nothing is changed in place.
    """

    def __init__(self, spark: SparkSession, folder: str, lg_k: int = LG_K) -> None:
        self.spark, self.folder, self.lg_k = spark, folder.rstrip("/"), lg_k

    def _numbers(self) -> list[int]:
        """Numbers of the complete lists; each is as many files as there were updates."""
        found = TableFiles(self.spark, f"{self.folder}/live").children()
        return sorted(int(name) for name in found if name.isdigit() and TableFiles(self.spark, f"{self.folder}/live/{name}").has("_SUCCESS"))

    def live(self) -> DataFrame:
        """Rows ``LIVE_SCHEMA`` of the newest complete list."""
        numbers = self._numbers()
        if not numbers:
            return self.spark.createDataFrame([], LIVE_SCHEMA)
        return self.spark.read.schema(LIVE_SCHEMA).parquet(f"{self.folder}/live/{numbers[-1]}")

    def states(self) -> DataFrame:
        """Rows ``STATE_SCHEMA`` of the live files."""
        runs = TableFiles(self.spark, f"{self.folder}/states").children()
        if not runs:
            return self.spark.createDataFrame([], STATE_SCHEMA)
        stored = self.spark.read.schema(STATE_SCHEMA).parquet(*[f"{self.folder}/states/{run}" for run in runs])
        # States and files are both as many as there are files; neither is broadcast unmeasured.
        return stored.join(self.live().select("TABLE_NAME", "FILE", "RUN"), ["TABLE_NAME", "FILE", "RUN"], "left_semi")

    def fresh(self, table: str, files: TableFiles) -> tuple[list[tuple[str, int, int]], DataFrame, Update]:
        """Files (name, time, size) that the store does not know as they are, and the list of those it keeps.

        New files reach the driver, where Spark's own listing of the table is as well.
        """
        listed = files.listing().selectExpr(f"{literal(table)} AS TABLE_NAME", "FILE", "CHANGED", "SIZE")
        known = self.live().where(F.col("TABLE_NAME") == table)
        keys = ["TABLE_NAME", "FILE", "CHANGED", "SIZE"]
        marked = listed.join(known, keys, "left")
        new = [tuple(row) for row in marked.where("RUN IS NULL").select("FILE", "CHANGED", "SIZE").collect()]
        kept = marked.where("RUN IS NOT NULL").select(*keys, "RUN")
        n_kept = kept.count()
        return sorted(new), kept, Update(len(new), n_kept, known.count() - n_kept)

    def read(self, files: TableFiles, names: Sequence[str], schema: StructType) -> DataFrame:
        """The rows of some of the table's files, and of no other."""
        reader = self.spark.read.schema(schema).option("basePath", files.folder)
        return reader.parquet(*names) if names else self.spark.createDataFrame([], schema)

    def update(self, table: str, folder: str, schema: StructType | None = None) -> Update:
        """Profile the files of ``folder`` that are new or changed, and forget those that are gone."""
        return self.update_all({table: folder}, {table: schema} if schema else None)[table]

    def update_all(
        self, folders: Mapping[str, str], schemas: Mapping[str, StructType] | None = None
    ) -> dict[str, Update]:
        """Bring several tables up to date; tables not named stay as they are."""
        run, done = uuid.uuid4().hex, {}
        live = self.live().where(~F.col("TABLE_NAME").isin(list(folders)))
        for table, folder in folders.items():
            files = TableFiles(self.spark, folder)
            # Listed before they are read: a file that changes meanwhile is a new one next time.
            new, kept, done[table] = self.fresh(table, files)
            if new:
                schema = (schemas or {}).get(table) or self.spark.read.parquet(folder).schema
                rows = self.read(files, [name for name, _, _ in new], schema)
                states = file_states(rows, table, schema, self.lg_k, run)
                states.coalesce(1 + len(new) // FILES_EACH).write.mode("append").parquet(f"{self.folder}/states/{run}")
            added = self.spark.createDataFrame([(table, *file, run) for file in new], LIVE_SCHEMA)
            live = live.union(kept).union(added)
        number = max(self._numbers(), default=0) + 1
        live.coalesce(1).write.mode("overwrite").parquet(f"{self.folder}/live/{number}")
        return done

    def null_profile(self, table: str, schema: StructType) -> DataFrame:
        """Rows ``PROFILE_SCHEMA``, as a full profile gives them, merged from the states.

        A column that some files lack is null in all of their rows.
        """
        names = [(table, f.name, f.dataType.simpleString(), i) for i, f in enumerate(schema.fields, start=1)]
        columns = self.spark.createDataFrame(names, "TABLE_NAME string, COLUMN_NAME string, DATA_TYPE string, ORDINAL_POSITION int")
        states = self.states().where(F.col("TABLE_NAME") == table)
        sizes = states.groupBy("TABLE_NAME", "FILE").agg(F.max("TOTAL_ROWS").alias("_n"))
        sizes = sizes.groupBy("TABLE_NAME").agg(F.sum("_n").alias("_rows"))
        counted = states.groupBy("COLUMN_NAME").agg(F.expr("sum(TOTAL_ROWS) AS _seen"), F.expr("sum(NULL_COUNT) AS _nulls"))
        merged = columns.join(counted, "COLUMN_NAME", "left").join(sizes, "TABLE_NAME", "left")
        merged = merged.withColumn("_total", F.expr("coalesce(_rows, 0L)"))
        nulls = "coalesce(_nulls, 0L) + _total - coalesce(_seen, 0L)"
        return merged.selectExpr(
            "TABLE_NAME", "COLUMN_NAME", "DATA_TYPE", "ORDINAL_POSITION", "_total AS TOTAL_ROWS", f"{nulls} AS NULL_COUNT",
            f"({nulls}) / greatest(_total, 1L) AS NULL_RATE",
        ).select(*[part.split()[0] for part in PROFILE_SCHEMA.split(", ")])

    def distinct_counts(self, table: str) -> DataFrame:
        """Estimated distinct counts, from the union of the sketches of all live files."""
        states = self.states().where((F.col("TABLE_NAME") == table) & F.col("SKETCH").isNotNull())
        merged = states.groupBy("TABLE_NAME", "COLUMN_NAME").agg(F.expr("hll_union_agg(SKETCH, true) AS SKETCH"))
        return merged.selectExpr("TABLE_NAME", "COLUMN_NAME", "hll_sketch_estimate(SKETCH) AS DISTINCT_COUNT")

    def newest(self, table: str, column: str) -> DataFrame:
        """(TABLE_NAME, LAST_UPDATED): the newest time stamp of a column, for staleness."""
        states = self.states().where((F.col("TABLE_NAME") == table) & (F.col("COLUMN_NAME") == column))
        return states.selectExpr(f"{literal(table)} AS TABLE_NAME", "NEWEST").groupBy("TABLE_NAME").agg(F.max("NEWEST").alias("LAST_UPDATED"))

    def compact(self) -> None:
        """Rewrite the live states as one run, so that a later read opens fewer folders.

        The folders of earlier runs and lists are left to the caller, as readers may hold them.
        """
        run, number = uuid.uuid4().hex, max(self._numbers(), default=0) + 1
        live = self.live()
        self.states().withColumn("RUN", F.lit(run)).write.parquet(f"{self.folder}/states/{run}")
        live.withColumn("RUN", F.lit(run)).coalesce(1).write.mode("overwrite").parquet(f"{self.folder}/live/{number}")
