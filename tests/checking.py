"""Compare a query with its SQL counterpart: columns, row count and values."""

import math
from collections import Counter

import duckdb

from testbed.inputs import TABLES


def connect(sf_dir):
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{sf_dir}/{name}.parquet'")
    return con


def _cell(value):
    if isinstance(value, float):
        return "nan" if math.isnan(value) else repr(round(value, 9))
    return repr(value)


def table_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return [columns[i] for i in order], Counter(tuple(_cell(r[i]) for i in order) for r in rows)


def differences(spark_df, con, sql):
    """None if both sides agree, else a short description."""
    got_columns, got = table_of(spark_df.columns, [tuple(r) for r in spark_df.collect()])
    cursor = con.execute(sql)
    want_columns, want = table_of([d[0] for d in cursor.description], cursor.fetchall())
    if got_columns != want_columns:
        return f"columns {got_columns} != {want_columns}"
    if got == want:
        return None
    extra, missing = list((got - want).elements()), list((want - got).elements())
    return f"rows {got.total()} vs {want.total()}; only here {extra[:2]}; only there {missing[:2]}"
