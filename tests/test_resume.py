"""Runs that break and go on: finished parts are not computed again."""

import os

import pytest
from pyspark.sql import functions as F

from rowcensus import Rule, scan
from rowcensus.plans.enrich import template_answers
from rowcensus.sources.resume import ResumableStage, SharedFiles, part_facts
from rowcensus.sources.staging import Stage


@pytest.fixture
def tables(spark, tmp_path):
    made = {}
    for k in range(6):
        rows = spark.range(200).selectExpr("id AS key_id", f"IF(id % {k + 2} = 0, NULL, id % 50) AS v", "id % 90 AS other_id")
        rows.union(rows.where("id = 7")).write.parquet(f"{tmp_path}/t{k}")
        made[f"t{k}"] = spark.read.parquet(f"{tmp_path}/t{k}")
    return made


RULES = tuple(Rule(id=f"big_{k}", table=f"t{k}", primary_key=("key_id",), where="v > 40", detail="'big'") for k in range(6))


def run(spark, tables, stage, **more):
    frames = scan(spark, tables, RULES, generated="2025-01-01", stage=stage, **more)
    return {
        name: sorted((tuple(r) for r in frame.collect()), key=repr)
        for name, frame in frames.items()
        if name in ("Overview", "Rule_Summary", "Table_Profiles", "Row_Issues")
    }


class Lost(Exception):
    pass


def broken(stage, after):
    """Let ``stage`` fail once it has stored ``after`` parts."""
    write = stage.write

    def fail(df, label):
        if len(stage.computed) >= after:
            raise Lost(label)
        return write(df, label)

    stage.write = fail
    return stage


def test_a_broken_scan_goes_on(spark, tables, tmp_path):
    root = f"{tmp_path}/stage"
    with pytest.raises(Lost):
        run(spark, tables, broken(ResumableStage(spark, "nightly", "s", root), 5))
    first = {entry["path"]: os.path.getmtime(f"{entry['path']}/_SUCCESS") for entry in ResumableStage(spark, "nightly", "s", root).manifest()}
    assert len(first) >= 5
    again = ResumableStage(spark, "nightly", "s", root)
    got = run(spark, tables, again)
    assert got == run(spark, tables, Stage(spark, f"{tmp_path}/plain"))
    assert len(again.skipped) >= 5 and again.computed
    # What was stored is as old as it was.
    assert {path: os.path.getmtime(f"{path}/_SUCCESS") for path in first} == first
    # A third run reads what there is and scans nothing.
    third = ResumableStage(spark, "nightly", "s", root)
    assert run(spark, tables, third) == got and third.computed == []


def test_what_changes_is_computed_again(spark, tables, tmp_path):
    root = f"{tmp_path}/stage"
    run(spark, tables, ResumableStage(spark, "n", "one", root))
    # New files in one table: its parts alone, and what follows from them.
    tables["t2"].limit(5).write.mode("append").parquet(f"{tmp_path}/t2")
    changed = {**tables, "t2": spark.read.parquet(f"{tmp_path}/t2")}
    stage = ResumableStage(spark, "n", "one", root)
    assert run(spark, changed, stage) == run(spark, changed, Stage(spark, f"{tmp_path}/plain"))
    rules = {label for label in stage.skipped if label.startswith("big_")}
    assert rules == {f"big_{k}" for k in range(6) if k != 2} and "big_2" in stage.computed
    other = ResumableStage(spark, "n", "two", root)
    run(spark, changed, other)
    assert not [label for label in other.skipped if label.startswith("big_")]


def test_model_answers_are_kept(spark, tables, tmp_path):
    root = f"{tmp_path}/stage"
    one = run(spark, tables, ResumableStage(spark, "m", "model 1", root), enrich=template_answers())
    again = ResumableStage(spark, "m", "model 1", root)
    assert run(spark, tables, again, enrich=template_answers()) == one


def test_parts_that_a_plan_does_not_show(spark, tmp_path):
    made = spark.createDataFrame([(1,)], "x int")
    assert part_facts(made) is None
    stage = ResumableStage(spark, "p", root=str(tmp_path))
    assert stage.write(made, "rows") != stage.write(made, "rows") and stage.skipped == []
    spark.range(5).write.parquet(f"{tmp_path}/r")
    read = spark.read.parquet(f"{tmp_path}/r")
    assert part_facts(read) == part_facts(spark.read.parquet(f"{tmp_path}/r"))
    assert part_facts(read.where("id > 1")) != part_facts(read.where("id > 2"))
    # A part without its entry is written anew.
    path = stage.write(read, "rows")
    stage.files.remove(f"{stage.folder}/manifest")
    assert ResumableStage(spark, "p", root=str(tmp_path)).write(read, "rows") == path
    assert stage.read("id long", path).count() == 5


def test_shared_texts(spark, tmp_path):
    files = SharedFiles(spark)
    name = f"{tmp_path}/a/b.json"
    assert not files.exists(name) and files.names(f"{tmp_path}/a") == []
    files.write(name, "ä1")
    files.write(name, "ä2")
    assert files.read(name) == "ä2" and [n for n in files.names(f"{tmp_path}/a") if not n.startswith(".")] == ["b.json"]
