"""Tables of a schema: listing, metadata, keys, and bound queries."""

from __future__ import annotations

import logging
import re
from collections.abc import Iterable, Mapping, Sequence
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import literal, quoted

log = logging.getLogger(__name__)

KEY_PROPERTY = "dq.primary_key"
KEY_SUFFIXES = ("ID", "KEY")
BASE_TYPES = ("MANAGED", "EXTERNAL")
ROW_POSITION = "ROW_POSITION"


def table_ref(*parts: str) -> str:
    """A quoted multi-part name, e.g. ```spark_catalog`.`dq`.`orders```."""
    return ".".join(quoted(part) for part in parts)


def register_parquet(
    spark: SparkSession,
    schema: str,
    paths: Mapping[str, str],
    keys: Mapping[str, Sequence[str]] | None = None,
) -> None:
    """Register Parquet folders as external tables, optionally with declared keys.

    A table that is known already keeps its folder, which has to be the given one, and gets
    the keys that are given for it.
    """
    spark.sql(f"CREATE DATABASE IF NOT EXISTS {quoted(schema)}")
    known = {row["tableName"].upper() for row in spark.sql(f"SHOW TABLES IN {quoted(schema)}").collect()}
    for name, path in paths.items():
        wanted = list((keys or {}).get(name) or ())
        property_list = f"({literal(KEY_PROPERTY)} = {literal(','.join(wanted))})"
        if name.upper() in known:
            folder = described_table(spark, schema, name).get("Location", "")
            if _plain(folder) != _plain(path):
                raise ValueError(f"{schema}.{name} is registered on {folder}, not on {path}")
            if wanted and wanted != declared_keys(spark, schema, name):
                spark.sql(f"ALTER TABLE {table_ref(schema, name)} SET TBLPROPERTIES {property_list}")
            continue
        properties = f" TBLPROPERTIES {property_list}" if wanted else ""
        spark.sql(
            f"CREATE TABLE IF NOT EXISTS {table_ref(schema, name)} "
            f"USING parquet LOCATION {literal(path)}{properties}"
        )


def _plain(folder: str) -> str:
    """A folder without the ways to write a local path that mean the same."""
    return re.sub("^file:/+", "/", folder).rstrip("/")


def described_table(spark: SparkSession, *parts: str) -> dict[str, str]:
    rows = spark.sql(f"DESCRIBE TABLE EXTENDED {table_ref(*parts)}").collect()
    return {row["col_name"]: row["data_type"] for row in rows}


def list_tables(
    spark: SparkSession, schema: str, exclude: Iterable[str] = (), database: str | None = None
) -> list[str]:
    """Base tables of a schema by name, without views and excluded names (any case).

    ``database`` is the catalog that holds the schema, the current one by default.
    """
    dropped = {name.upper() for name in exclude}
    found = spark.catalog.listTables(table_ref(*([database] if database else []), schema))
    names = [t.name for t in found if not t.isTemporary and t.tableType in BASE_TYPES]
    return sorted(n for n in names if n.upper() not in dropped)


def load_tables(
    spark: SparkSession, database: str, schema: str, exclude: Iterable[str] = ()
) -> dict[str, DataFrame]:
    """Lazy frames of all base tables, in listing order."""
    return {
        name: spark.table(table_ref(database, schema, name))
        for name in list_tables(spark, schema, exclude, database)
    }


def with_row_position(df: DataFrame) -> DataFrame:
    """Add ``ROW_POSITION``, the file of a row and its number there, unless the frame has it.

    ``df`` reads Parquet files, with filters and projections at most; after an aggregate rows
    have no position. Any number of tasks reading a file, in any order, give a row the same
    position, and no row is counted to find it.
    """
    if ROW_POSITION in df.columns:
        return df
    return df.selectExpr("*", f"concat(_metadata.file_path, '#', _metadata.row_index) AS {ROW_POSITION}")


def column_metadata(
    df: DataFrame, table: str, profile: DataFrame | None = None
) -> DataFrame:
    """COLUMN_NAME, DATA_TYPE, IS_NULLABLE, ORDINAL_POSITION of a table.

    File sources report every column as nullable. With a null profile at hand, a column
    that holds no null counts as NOT NULL.
    """
    if profile is not None:
        return profile.filter(F.col("TABLE_NAME") == table).selectExpr(
            "TABLE_NAME", "COLUMN_NAME", "DATA_TYPE",
            "IF(NULL_COUNT > 0, 'YES', 'NO') AS IS_NULLABLE", "ORDINAL_POSITION",
        )
    rows = [
        (table, f.name, f.dataType.simpleString(), "YES" if f.nullable else "NO", i)
        for i, f in enumerate(df.schema.fields, start=1)
    ]
    names = "TABLE_NAME string, COLUMN_NAME string, DATA_TYPE string, IS_NULLABLE string, ORDINAL_POSITION int"
    return df.sparkSession.createDataFrame(rows, names)


def declared_keys(spark: SparkSession, *parts: str) -> list[str]:
    """Key columns declared in the table property, in key order; empty if undeclared.

    A catalog that cannot tell is logged, and the key is inferred then.
    """
    try:
        rows = spark.sql(f"SHOW TBLPROPERTIES {table_ref(*parts)}").collect()
    except Exception as error:
        log.warning("no declared key of %s: %s", table_ref(*parts), error)
        return []
    text = next((row["value"] for row in rows if row["key"] == KEY_PROPERTY), "")
    return [part.strip() for part in text.split(",") if part.strip()]


def infer_key(columns: Sequence[str], not_null: Iterable[str]) -> list[str]:
    """The first NOT NULL column named ...ID or ...KEY, else the first column."""
    complete = set(not_null)
    for name in columns:
        if name.upper().endswith(KEY_SUFFIXES) and name in complete:
            return [name]
    return list(columns[:1])


def resolve_keys(
    table: str,
    columns: Sequence[str],
    not_null: Iterable[str],
    overrides: Mapping[str, Sequence[str]] | None = None,
    declared: Sequence[str] = (),
) -> list[str]:
    """Key columns of a table: override, then declared key, then inference."""
    for name, keys in (overrides or {}).items():
        if name.upper() == table.upper():
            return list(keys)
    return list(declared) or infer_key(columns, not_null)


def not_null_columns(tables: Mapping[str, DataFrame], profile: DataFrame) -> dict[str, set[str]]:
    """Columns per table that hold no null, or are declared NOT NULL.

    Collects names of candidate key columns only, so its size follows the schema and
    never the data.
    """
    suffix = " OR ".join(f"endswith(upper(COLUMN_NAME), '{suffix}')" for suffix in KEY_SUFFIXES)
    complete = profile.where(f"NULL_COUNT = 0 AND ({suffix})")
    found: dict[str, set[str]] = {name: set() for name in tables}
    for row in complete.select("TABLE_NAME", "COLUMN_NAME").collect():
        found[row["TABLE_NAME"]].add(row["COLUMN_NAME"])
    for name, df in tables.items():
        found[name].update(f.name for f in df.schema.fields if not f.nullable)
    return found


def bound_query(spark: SparkSession, sql: str, params: Mapping[str, Any] | None = None) -> DataFrame:
    """Run SQL with named bind parameters (``:name``)."""
    return spark.sql(sql, args=dict(params or {}))


def scalar(df: DataFrame) -> Any:
    """First column of the first row, or None."""
    rows = df.select(F.col(quoted(df.columns[0]))).take(1)
    return rows[0][0] if rows else None


class TableFiles:
    """The files below a folder, in any store that Spark reads."""

    def __init__(self, spark: SparkSession, folder: str) -> None:
        self.spark, self.folder = spark, folder.rstrip("/")

    def _store(self) -> tuple[Any, Any]:
        path = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(self.folder)
        return path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()), path

    def children(self) -> list[str]:
        """Names of the folders directly below; none if the folder does not exist."""
        store, path = self._store()
        if not store.exists(path):
            return []
        return sorted(found.getPath().getName() for found in store.listStatus(path) if found.isDirectory())

    def has(self, name: str) -> bool:
        store, _ = self._store()
        return store.exists(self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{self.folder}/{name}"))

    def listing(self) -> DataFrame:
        """Rows (FILE, CHANGED, SIZE) of all data files, at any depth; no file is opened.

        Names are written as ``_metadata.file_path`` writes them for rows read from the files.
        """
        store, path = self._store()
        if not store.exists(path):
            return self.spark.createDataFrame([], "FILE string, CHANGED bigint, SIZE bigint")
        files = self.spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(self.folder)
        return files.selectExpr(
            "_metadata.file_path AS FILE", "unix_micros(_metadata.file_modification_time) AS CHANGED", "_metadata.file_size AS SIZE"
        )
