"""Stored tables and results: partitions rewritten, footers read, positions, answers, reports."""

import datetime
import glob
import os

import pytest
from pyspark.sql import functions as F

from rowcensus import Rule, scan, write_report
from rowcensus.operators import profile as P
from rowcensus.operators.rules import run_rule, run_rules
from rowcensus.plans import report as R
from rowcensus.plans.answers import AnswerStore
from rowcensus.plans.enrich import respond
from rowcensus.plans.stored import correct_stored, insert_stored
from rowcensus.sources.catalog import ROW_POSITION, with_row_position
from rowcensus.sources.partitioned import newest, partition_rows, partitioned_null_profile, reads_rows, stale_from_metadata


def rows(frame):
    return sorted((tuple(r) for r in frame.collect()), key=repr)


def files(folder):
    return {p: os.path.getmtime(p) for p in glob.glob(f"{folder}/**/*.parquet", recursive=True)}


# --- changing stored tables --------------------------------------------------------------------


@pytest.fixture
def target(spark, tmp_path):
    folder = f"{tmp_path}/target"
    made = spark.range(400).selectExpr(
        "id", "id * 2 AS v", "concat('n', id) AS name", "IF(id % 8 = 7, NULL, id % 8) AS p", "concat('a/b=', id % 2) AS q"
    )
    made.write.partitionBy("p", "q").parquet(folder)
    return folder


def test_corrections_rewrite_only_their_partitions(spark, target):
    before, old = files(target), rows(spark.read.parquet(target))
    fixes = spark.createDataFrame([(3, None, "new"), (11, 5, "other"), (7, 1, "null part"), (9999, 1, "none")], "id long, v long, name string")
    done = correct_stored(spark, target, fixes, ["id"], ["v", "name"], ["p", "q"])
    assert done == [(3, "a/b=1"), (None, "a/b=1")]
    after = files(target)
    gone = {p for p in before if p not in after}
    assert gone and all("p=3" in p or "p=__HIVE" in p for p in gone)
    assert {p: t for p, t in before.items() if p not in gone} == {p: t for p, t in after.items() if p in before}
    want = {3: (None, "new"), 11: (5, "other"), 7: (1, "null part")}
    assert rows(spark.read.parquet(target)) == sorted((((r[0], *want[r[0]], *r[3:]) if r[0] in want else r) for r in old), key=repr)
    assert correct_stored(spark, target, fixes.where("id = 9999"), ["id"], ["v"], ["p", "q"]) == []
    with pytest.raises(ValueError):
        correct_stored(spark, target, fixes, ["id"], ["p"], ["p", "q"])


def test_two_corrections_of_a_key_change_nothing(spark, target):
    before = files(target)
    fixes = spark.createDataFrame([(3, 1, 1), (3, 2, 2)], "id long, v long, at int")
    with pytest.raises(Exception, match="more than one correction"):
        correct_stored(spark, target, fixes, ["id"], ["v"], ["p", "q"])
    assert files(target) == before
    correct_stored(spark, target, fixes, ["id"], ["v"], ["p", "q"], sequence="at")
    assert spark.read.parquet(target).where("id = 3").first().v == 2


def test_many_partitions_of_one_column(spark, tmp_path, monkeypatch):
    folder = f"{tmp_path}/one"
    monkeypatch.setattr("rowcensus.plans.stored.PARTITIONS_EACH", 2)
    spark.range(60).selectExpr("id", "id AS v", "IF(id % 6 = 5, NULL, id % 6) AS p").write.partitionBy("p").parquet(folder)
    fixes = spark.range(0, 60, 5).selectExpr("id", "-id AS v")
    done = correct_stored(spark, folder, fixes, ["id"], ["v"], ["p"])
    assert [p for (p,) in done] == [0, 1, 2, 3, 4, None]
    assert {r.id: r.v for r in spark.read.parquet(folder).collect()} == {i: -i if i % 5 == 0 else i for i in range(60)}


def test_missing_rows_are_appended(spark, target):
    before = files(target)
    source = spark.createDataFrame(
        [(1, 0, "there", 1, "a/b=1"), (1000, 1, "new", 3, "a/b=0"), (1001, 1, "new", 99, "a/b=0"), (None, 1, "no key", 3, "a/b=0")],
        "id long, v long, name string, p long, q string",
    )
    assert insert_stored(spark, target, source, ["id"], ["p", "q"]) == 3
    assert before.items() <= files(target).items()
    assert rows(spark.read.parquet(target).where("id >= 1000 OR id IS NULL").select("id", "p"))[0] == (1000, 3)
    assert insert_stored(spark, target, source.where("id IS NOT NULL"), ["id"], ["p", "q"]) == 0


# --- footers and folder names --------------------------------------------------------------------


@pytest.fixture
def partitioned(spark, tmp_path):
    folder = f"{tmp_path}/partitioned"
    spark.range(500).selectExpr(
        "id", "IF(id % 3 = 0, NULL, id) AS some", "CAST(NULL AS STRING) AS none", "date_add(DATE '2020-01-01', CAST(id AS INT)) AS day",
        "timestamp_ntz '2020-01-01 00:00:00' + make_interval(0, 0, 0, CAST(id AS INT)) AS at", "id % 5 AS p", "IF(id % 4 = 0, NULL, id % 4) AS s",
    ).repartition(3).write.partitionBy("p", "s").parquet(folder)
    return folder


def test_partitioned_tables_are_profiled_without_reading_rows(spark, partitioned):
    found = partitioned_null_profile(spark, partitioned, "t", ["p", "s"])
    assert not reads_rows(found)
    assert rows(found) == rows(P.null_profile(spark.read.parquet(partitioned), "t"))
    assert reads_rows(P.null_profile(spark.read.parquet(partitioned), "t"))
    df = found.sparkSession.read.parquet(partitioned)
    assert rows(partition_rows(df, ["p"])) == [(k, 100) for k in range(5)]
    # The caller's session reads as before.
    assert spark.conf.get("spark.sql.parquet.aggregatePushdown") == "false"


def test_newest_values_without_reading_rows(spark, partitioned):
    for column, value, read in (("day", "2021-05-14", False), ("at", "2021-05-14", True)):
        frame = newest(spark, partitioned, column, ["p", "s"])
        assert frame.first().LAST_UPDATED == datetime.datetime.fromisoformat(value) and reads_rows(frame) == read
    folder = f"{partitioned}-days"
    spark.range(10).selectExpr("id", "date_add(DATE '2020-01-01', CAST(id AS INT)) AS day").write.partitionBy("day").parquet(folder)
    frame = newest(spark, folder, "day", ["day"])
    assert frame.first().LAST_UPDATED == datetime.datetime(2020, 1, 10) and not reads_rows(frame)
    stale = stale_from_metadata(spark, {"a": (folder, "day", ["day"]), "b": (partitioned, "day", ["p", "s"])}, "2020-06-01", 90)
    assert [(r[0], r[2]) for r in rows(stale)] == [("a", True), ("b", False)]


def test_a_partitioned_table_without_rows(spark, tmp_path):
    folder = f"{tmp_path}/empty"
    made = spark.range(0).selectExpr("id", "id AS v", "id AS p")
    made.write.partitionBy("p").parquet(folder)
    found = rows(partitioned_null_profile(spark, folder, "t", ["p"], made.schema))
    assert found == rows(P.null_profile(made, "t"))
    # Nor does an unpartitioned one without files, when a scan looks at footers first.
    from rowcensus.plans.scan import stored_profile
    from rowcensus.sources.staging import Stage

    os.makedirs(f"{tmp_path}/bare")
    bare = spark.read.schema("a int, b string").parquet(f"{tmp_path}/bare")
    spark.range(3).selectExpr("CAST(id AS INT) AS a", "'x' AS b").write.parquet(f"{tmp_path}/full")
    full = spark.read.parquet(f"{tmp_path}/full")
    profile = stored_profile(spark, {"bare": bare, "full": full}, {"bare": f"{tmp_path}/bare", "full": f"{tmp_path}/full"}, Stage(spark))
    assert [(r.TABLE_NAME, r.TOTAL_ROWS, r.NULL_COUNT) for r in profile.orderBy("TABLE_NAME", "ORDINAL_POSITION").collect()] == [
        ("bare", 0, 0), ("bare", 0, 0), ("full", 3, 0), ("full", 3, 0)
    ]


# --- row positions -------------------------------------------------------------------------------


def test_equal_rows_have_their_own_identifiers(spark, tmp_path):
    spark.range(90).selectExpr("id % 3 AS a", "'x' AS b").repartition(3).write.parquet(f"{tmp_path}/t")
    t = spark.read.parquet(f"{tmp_path}/t")
    by_place = Rule(id="r", table="t", where="a = 1", detail="'d'", position=True)
    also = Rule(id="s", table="t", where="a = 1 OR a = 2", position=True)
    by_digest = Rule(id="r", table="t", where="a = 1")
    names = [r.ROW_IDENTIFIER for r in run_rule(spark, by_place, "c", "s", {"t": t}.__getitem__).collect()]
    assert len(names) == len(set(names)) == 30
    assert len({r.ROW_IDENTIFIER for r in run_rule(spark, by_digest, "c", "s", {"t": t}.__getitem__).collect()}) == 1
    # The same places whatever reads them, and through any kind of rule.
    again = run_rules(spark, [by_place, also], "c", "s", {"t": t}).where("ISSUE_TYPE = 'r'")
    assert sorted(r.ROW_IDENTIFIER for r in again.collect()) == sorted(names)
    from_frame = Rule(id="r", table="t", violations=lambda tables: with_row_position(tables("t")).where("a = 1"), position=True)
    found = run_rule(spark, from_frame, "c", "s", {"t": t}.__getitem__).collect()
    assert sorted(r.ROW_IDENTIFIER for r in found) == sorted(names) and ROW_POSITION not in found[0].ROW_VALUES
    plain = Rule(id="r", table="t", violations=lambda tables: with_row_position(tables("t")).where("a = 1"))
    assert len({r.ROW_IDENTIFIER for r in run_rule(spark, plain, "c", "s", {"t": t}.__getitem__).collect()}) == 1
    # A projection still knows its files; an aggregate does not: an error row, no wrong identifier.
    some = run_rule(spark, by_place, "c", "s", {"t": t.selectExpr("a + 0 AS a")}.__getitem__)
    assert sorted(r.ROW_IDENTIFIER for r in some.collect()) == sorted(names)
    lost = run_rule(spark, by_place, "c", "s", {"t": t.groupBy("a").count()}.__getitem__)
    assert [r.ROW_IDENTIFIER for r in lost.collect()] == ["RULE_ERROR"]


# --- answers that are kept -------------------------------------------------------------------------


def noted(folder, fail=()):
    """A model that notes every prompt it is asked in a file of its own."""

    def answer(prompts):
        import uuid

        for prompt in prompts:
            with open(f"{folder}/{uuid.uuid4().hex}", "w") as out:
                out.write(prompt)
        if any(f in p for f in fail for p in prompts):
            raise ValueError("no")
        return [f"answer to {p}" for p in prompts]

    return answer


def asked(folder):
    found = sorted(open(p).read() for p in glob.glob(f"{folder}/*"))
    for p in glob.glob(f"{folder}/*"):
        os.remove(p)
    return found


def test_only_new_prompts_are_asked(spark, tmp_path):
    notes = tmp_path / "notes"
    notes.mkdir()
    prompts = spark.createDataFrame([(k, f"p{k % 3}") for k in range(6)], "k int, PROMPT string")
    store = AnswerStore(spark, f"{tmp_path}/answers", "m1")
    first = store.respond(prompts, noted(notes), batch=2)
    assert rows(first) == [(k, f"p{k % 3}", f"answer to p{k % 3}", None) for k in range(6)]
    assert asked(notes) == ["p0", "p1", "p2"]
    more = prompts.union(spark.createDataFrame([(9, "p9"), (10, "bad"), (11, None)], prompts.schema))
    found = store.respond(more, noted(notes, ["bad"]), attempts=2, batch=1)
    assert [(r[0], r[2]) for r in rows(found) if r[0] >= 9 and r[1]] == [(10, None), (9, "answer to p9")]
    assert {r[0]: r[3] for r in rows(found)}[10] == "ValueError: no"
    assert set(asked(notes)) >= {"p9", "bad"} and not asked(notes)
    # What failed is asked again, another model is asked everything.
    store.respond(more.where("k < 11"), noted(notes))
    assert asked(notes) == ["bad"]
    AnswerStore(spark, f"{tmp_path}/answers", "m2").respond(prompts, noted(notes))
    assert asked(notes) == ["p0", "p1", "p2"]
    assert rows(store.respond(prompts.limit(0), noted(notes))) == [] and asked(notes) == []


def test_waiting_between_attempts(spark, tmp_path):
    log = str(tmp_path)

    def flaky(prompts):
        import os as files
        import time as clock

        with open(f"{log}/{len(files.listdir(log))}", "w") as out:
            out.write(str(clock.time()))
        if len(files.listdir(log)) < 3:
            raise ValueError("busy")
        return list(prompts)

    prompts = spark.createDataFrame([("p",)], "PROMPT string")
    assert respond(prompts, flaky, attempts=3, parallel=1, pause=0.2).first().RESPONSE == "p"
    times = sorted(float(open(p).read()) for p in glob.glob(f"{log}/*"))
    assert times[1] - times[0] >= 0.2 and times[2] - times[1] >= 0.4


# --- reports that are published at once -------------------------------------------------------------


@pytest.fixture
def frames(spark):
    t = spark.range(100).selectExpr("id % 90 AS t_id", "IF(id % 2 = 0, NULL, id) AS v")
    rule = Rule(id="big", table="t", primary_key=("t_id",), where="v > 50", severity="high")
    return scan(spark, {"t": t}, [rule], generated="2025-01-01")


def test_a_report_is_whole_or_no_report(spark, tmp_path, frames):
    path = write_report(frames, str(tmp_path), "1")
    found = R.read_report(spark, path)
    for name in R.DATASETS:
        assert rows(found[name].select(*frames[name].columns)) == rows(frames[name]), name
    assert R.latest_report(spark, str(tmp_path)) == path

    class Broken(Exception):
        pass

    class Breaking:
        """A frame of which the writer breaks; the other datasets are written."""

        def __getattr__(self, name):
            raise Broken

    with pytest.raises((Broken, AttributeError)):
        write_report({**frames, "LLM_Table_Summaries": Breaking()}, str(tmp_path), "2")
    assert os.path.isdir(f"{path[:-1]}2/Overview")
    with pytest.raises(R.IncompleteReport, match="no manifest"):
        R.read_report(spark, f"{path[:-1]}2")
    assert R.latest_report(spark, str(tmp_path)) == path
    newer = write_report(frames, str(tmp_path), "3", csv=True)
    assert R.latest_report(spark, str(tmp_path)) == newer
    assert R.latest_report(spark, f"{tmp_path}/nothing") is None


def test_lost_rows_of_a_report_are_noticed(spark, tmp_path, frames):
    path = write_report(frames, str(tmp_path), "1")
    lost = glob.glob(f"{path}/Row_Issues/SEVERITY=high/*.parquet")[0]
    os.remove(lost)
    with pytest.raises(R.IncompleteReport, match="Row_Issues"):
        R.read_report(spark, path)
    assert set(R.read_report(spark, path, check_rows=False)) == set(R.DATASETS)
