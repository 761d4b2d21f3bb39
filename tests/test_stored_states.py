"""Stored states: files profiled once, sketches and bitmaps that merge, few shuffled keys."""

import datetime
import glob
import os
import tracemalloc

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from rowcensus.operators import profile as P
from rowcensus.operators import states as ST
from rowcensus.operators.prefilter import bucket_bits, duplicate_keys_prefiltered, may_repeat, repeated_slots, seen_slots
from rowcensus.plans.incremental import ProfileStore, Update
from rowcensus.sources.catalog import TableFiles
from rowcensus.sources.staging import Stage

from .test_plans import plan


def rows(frame):
    return sorted((tuple(r) for r in frame.collect()), key=repr)


@pytest.fixture
def odd(spark):
    """All types a table may have, with nulls, negative numbers and equal values."""
    return spark.range(0, 3000, 1, 4).selectExpr(
        "id", "CAST(id % 7 - 3 AS TINYINT) AS small", "IF(id % 3 = 0, NULL, -id * 40000) AS wide", "id % 40000 - 20000 AS around",
        "CAST(NULL AS INT) AS nothing", "id % 2 = 0 AS flag", "date_add(DATE '1969-06-01', CAST(id % 400 AS INT)) AS day",
        "timestamp_ntz '2020-01-01 00:00:00' + make_interval(0, 0, 0, CAST(id % 90 AS INT)) AS at",
        "CAST(id % 11 AS DOUBLE) - 5 AS real", "CAST(id % 13 AS DECIMAL(9,2)) AS money", "concat('t', id % 17) AS text",
        "array(id % 5) AS list", "struct(id % 4 AS x) AS pair", "map('k', id % 6) AS dict", "encode(concat('b', id % 3), 'utf-8') AS raw",
        "id % 10 AS `odd name`",
    )


FLAT = ["id", "small", "wide", "around", "nothing", "flag", "day", "at", "real", "money", "text", "raw", "odd name"]


def test_bitmaps_equal_counts_by_value(odd):
    assert rows(ST.distinct_bitmaps(odd, "odd", FLAT)) == rows(P.distinct_profile(odd, "odd", FLAT))
    few, many, rest = ST.bitmap_columns(odd)
    assert [name for name, _, _ in few] == ["id", "small", "around", "nothing", "flag", "day", "odd name"]
    assert many == [] and "wide" in rest and "text" in rest
    assert rows(ST.distinct_bitmaps(odd.limit(0), "odd", FLAT)) == sorted((("odd", c, 0) for c in FLAT), key=repr)
    assert ST.distinct_bitmaps(odd.select(), "odd").count() == 0


def test_bitmaps_of_many_buckets(spark):
    df = spark.range(0, 600_000, 1, 4).selectExpr("id - 300000 AS n", "id * 3 AS t", "id DIV 2 AS h")
    few, many, rest = ST.bitmap_columns(df)
    assert (few, many, rest) == ([], ["n", "t", "h"], [])
    assert rows(ST.distinct_bitmaps(df, "x")) == [("x", "h", 300_000), ("x", "n", 600_000), ("x", "t", 600_000)]
    # Rows are not copied, and a bucket is all that is sent.
    states = ST.bitmap_states(df, "x")
    assert "Expand" not in plan(states)
    assert states.count() <= 3 * (1_800_000 // ST.BUCKET_VALUES + 2)


def test_bitmaps_of_parts_add_up(odd):
    names = ["id", "small", "around", "day"]
    states = ST.bitmap_states(odd, "odd", "id % 3", names)
    assert {r.PART for r in states.collect()} == {"0", "1", "2"}
    assert rows(ST.bitmap_counts(states)) == rows(P.distinct_profile(odd, "odd", names))
    some = odd.where("id % 3 < 2")
    assert rows(ST.bitmap_counts(states.where("PART != '2'"))) == rows(P.distinct_profile(some, "odd", names))
    # Merging a part twice changes nothing.
    assert rows(ST.bitmap_counts(states.union(states))) == rows(P.distinct_profile(odd, "odd", names))


def test_sketches_of_every_type(odd):
    exact = {(t, c): n for t, c, n in rows(P.distinct_profile(odd, "odd", FLAT))}
    parts = ST.sketch_states(odd, "odd", "id % 5")
    assert parts.count() == 5 * len(odd.columns)
    found = {(t, c): n for t, c, n in rows(ST.sketch_counts(parts))}
    for key, n in exact.items():
        assert abs(found[key] - n) <= 0.06 * n, key
    assert [found["odd", c] for c in ("list", "pair", "dict")] == [5, 4, 6]
    # A part that is merged again adds nothing.
    for t, c, n in rows(ST.sketch_counts(parts.union(ST.sketch_states(odd, "odd")))):
        assert abs(n - found[t, c]) <= 0.01 * n, c
    assert ST.sketch_counts(ST.sketch_states(odd.limit(0), "odd")).count() == 0
    assert ST.sketch_states(odd.select(), "odd").count() == 0


# --- profiles by file ------------------------------------------------------------------------


def scanned_files(frame):
    """Files the plan of ``frame`` reads."""
    return {name for name in frame.inputFiles()}


@pytest.fixture
def growing(spark, tmp_path, odd):
    folder = f"{tmp_path}/table"
    odd.where("id < 1000").repartition(2).write.parquet(folder)
    return folder, ProfileStore(spark, f"{tmp_path}/store")


def merged(spark, store, folder):
    schema = spark.read.parquet(folder).schema
    return rows(store.null_profile("t", schema)), rows(P.null_profile(spark.read.schema(schema).parquet(folder), "t"))


def test_only_new_files_are_read(spark, growing, odd):
    folder, store = growing
    assert store.update("t", folder) == Update(2, 0, 0)
    got, want = merged(spark, store, folder)
    assert got == want
    before = set(glob.glob(f"{folder}/*.parquet"))
    odd.where("id >= 1000").repartition(3).write.mode("append").parquet(folder)
    new = {os.path.basename(p) for p in set(glob.glob(f"{folder}/*.parquet")) - before}
    files = TableFiles(spark, folder)
    listed, _, counts = store.fresh("t", files)
    assert counts == Update(3, 2, 0) and {os.path.basename(name) for name, _, _ in listed} == new
    read = store.read(files, [name for name, _, _ in listed], spark.read.parquet(folder).schema)
    assert {os.path.basename(name) for name in scanned_files(read)} == new
    assert store.update("t", folder) == Update(3, 2, 0)
    got, want = merged(spark, store, folder)
    assert got == want
    assert store.update("t", folder) == Update(0, 5, 0)
    assert store.states().count() == 5 * len(odd.columns)
    assert rows(store.newest("t", "day")) == [("t", datetime.datetime(1970, 7, 5))]
    estimates = {c: n for _, c, n in rows(store.distinct_counts("t"))}
    assert abs(estimates["id"] - 3000) < 150 and estimates["small"] == 7


def test_changed_and_vanished_files(spark, growing, odd):
    folder, store = growing
    store.update("t", folder)
    gone, changed = sorted(glob.glob(f"{folder}/part-*.parquet"))
    os.remove(gone)
    os.remove(f"{folder}/.{os.path.basename(gone)}.crc")
    extra = f"{folder}-extra"
    odd.where("id BETWEEN 10 AND 30").coalesce(1).write.parquet(extra)
    os.remove(f"{folder}/.{os.path.basename(changed)}.crc")
    os.replace(glob.glob(f"{extra}/part-*.parquet")[0], changed)
    assert store.update("t", folder) == Update(1, 0, 2)
    got, want = merged(spark, store, folder)
    assert got == want and got[0][4] == 21


def test_a_broken_update_changes_nothing(spark, growing, odd, monkeypatch):
    folder, store = growing
    store.update("t", folder)
    before = rows(store.states())
    odd.where("id >= 1000").coalesce(1).write.mode("append").parquet(folder)

    class Broken(Exception):
        pass

    def broken(self):
        raise Broken

    # The states are written, the list of live files is not.
    with monkeypatch.context() as patch:
        patch.setattr(ProfileStore, "_numbers", broken)
        with pytest.raises(Broken):
            ProfileStore(spark, store.folder).update("t", folder)
    os.makedirs(f"{store.folder}/live/7")
    assert rows(store.states()) == before
    assert store.update("t", folder) == Update(1, 2, 0)
    got, want = merged(spark, store, folder)
    assert got == want


def test_several_tables_new_columns_and_compaction(spark, growing, tmp_path, odd):
    folder, store = growing
    other = f"{tmp_path}/other"
    odd.select("id", F.lit(1).alias("y")).write.partitionBy("y").parquet(other)
    done = store.update_all({"t": folder, "other": other, "none": f"{tmp_path}/nothing"}, {"none": odd.schema})
    assert done["t"] == Update(2, 0, 0) and done["other"].read == 4 and done["none"] == Update(0, 0, 0)
    # Files written before a column was there hold nulls in it.
    odd.where("id >= 2000").withColumn("later", F.lit(1)).coalesce(1).write.mode("append").parquet(folder)
    schema = spark.read.option("mergeSchema", "true").parquet(folder).schema
    assert store.update("t", folder, schema) == Update(1, 2, 0)
    want = rows(P.null_profile(spark.read.schema(schema).parquet(folder), "t"))
    assert rows(store.null_profile("t", schema)) == want
    before = rows(store.states().drop("RUN"))
    store.compact()
    assert rows(store.states().drop("RUN")) == before and store.states().select("RUN").distinct().count() == 1
    assert store.update("t", folder, schema) == Update(0, 3, 0)
    assert rows(store.null_profile("none", odd.schema))[0][4] == 0


# --- duplicate keys ----------------------------------------------------------------------------


@pytest.mark.parametrize("held", [50, 1 << 22])
def test_prefiltered_duplicates_are_all_duplicates(spark, odd, held):
    twice = odd.union(odd.where("id % 10 = 0")).union(odd.where("id = 20"))
    for keys, extra in ((["id"], 0), (["id"], 1), (["wide", "id"], 0), (["small", "odd name"], 0), (["real", "text", "id"], 0), (["wide"], 0)):
        want = rows(P.duplicate_keys(twice, keys, extra))
        assert rows(duplicate_keys_prefiltered(twice, keys, extra, held=held)) == want, keys
        assert rows(duplicate_keys_prefiltered(twice, keys, extra, held=held, few_slots=3)) == want, keys
    assert duplicate_keys_prefiltered(odd.limit(0), ["id"]).count() == 0
    # Values that count as equal have equal hashes.
    reals = spark.sql("SELECT * FROM VALUES (0D), (-0D), (double('NaN')), (double('NaN')), (1D), (NULL), (NULL) AS t(x)")
    assert duplicate_keys_prefiltered(reals, ["x"]).count() == P.duplicate_keys(reals, ["x"]).count() == 3


def test_a_task_holds_little_beside_its_buffer(spark, monkeypatch):
    """Slots are sorted in place and sent a few buckets at a time."""
    n, bits, made = 3 << 20, 6, []
    frame = spark.range(1)
    monkeypatch.setattr(type(frame), "mapInArrow", lambda self, gather, schema: made.append(gather) or self)
    seen_slots(frame, ["id"], bits, held=n)
    column = pa.array(np.random.default_rng(1).integers(0, 1 << (32 + bits), n))
    given = [pa.RecordBatch.from_arrays([column.slice(at, 10_000)], names=["slot"]) for at in range(0, n, 10_000)]
    tracemalloc.start()
    sent = [(batch.num_rows, batch.nbytes) for batch in made[0](iter(given))]
    held = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert sum(buckets for buckets, _ in sent) == 1 << bits and max(size for _, size in sent) < 2 << 20
    assert held < 1.5 * 8 * n


def test_few_rows_of_nearly_unique_keys_are_shuffled(spark, tmp_path):
    n, copies = 300_000, 500
    df = spark.range(0, n, 1, 4).selectExpr("concat('a long key that is costly to move ', id) AS k", "id")
    df = df.union(df.where(f"id < {copies}"))
    held = 40_000
    bits = bucket_bits(n, held)
    stage = Stage(spark, str(tmp_path))
    seen = stage.read("bucket int, once binary, twice binary", stage.write(seen_slots(df, ["k"], bits, held), "seen"))
    # Four bytes a key, and few rows.
    assert seen.count() <= (n // held + 6) * 2 * 2**bits
    assert seen.selectExpr("sum(length(once) + length(twice))").first()[0] <= 4 * (n + 2 * copies)
    slots = stage.read("slot long", stage.write(repeated_slots(seen), "slots"))
    left = may_repeat(df, ["k"], slots, bits)
    assert "BroadcastHashJoin" in plan(left) and "hashpartitioning" not in plan(left)
    assert 2 * copies <= left.count() <= 2 * copies + 0.001 * n
    assert rows(duplicate_keys_prefiltered(df, ["k"], held=held, stage=stage)) == rows(P.duplicate_keys(df, ["k"]))
