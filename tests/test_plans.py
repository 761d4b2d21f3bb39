"""Physical plans: one scan, pushed filters, size-checked broadcasts, split hot keys."""

import os
from contextlib import contextmanager

import pytest
from pyspark.sql import functions as F

from rowcensus import Reference
from rowcensus.functions.lookup import lookup_join
from rowcensus.operators import profile as P
from rowcensus.operators.builders import any_reference_violations, retention_cutoff, status_measure
from rowcensus.operators.issues import issue_columns
from rowcensus.operators.rules import check_rows
from rowcensus.operators.upkeep import insert_missing
from rowcensus.plans.enrich import attach_texts, issue_samples, sample_candidates
from rowcensus.plans.scan import stored_profile
from rowcensus.sources.footers import footer_session, write_footer_profile
from rowcensus.sources.staging import Stage
from testbed.queries import QUERIES


@contextmanager
def conf(spark, **settings):
    names = {k.replace("__", "."): v for k, v in settings.items()}
    before = {k: spark.conf.get(k, None) for k in names}
    for k, v in names.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


NO_BROADCAST = {
    "spark__sql__autoBroadcastJoinThreshold": "-1",
    "spark__sql__shuffle__partitions": "16",
    "spark__sql__adaptive__advisoryPartitionSizeInBytes": "64KB",
    "spark__sql__adaptive__skewJoin__skewedPartitionThresholdInBytes": "100KB",
    "spark__sql__adaptive__skewJoin__skewedPartitionFactor": "2",
}


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def final_plan(df):
    """The plan after adaptive execution has run it."""
    df.write.format("noop").mode("overwrite").save()
    rows = df.groupBy().agg(F.count(F.lit(1)).alias("n"))
    rows.collect()
    df.collect()
    return plan(df)


@pytest.fixture(scope="module")
def files(spark, tmp_path_factory):
    folder = str(tmp_path_factory.mktemp("tables"))
    n = 300_000
    # A third of the rows has no code, a third one hot code, the rest spread codes.
    facts = spark.range(0, n, 1, 4).selectExpr(
        "id",
        "CASE WHEN id % 3 = 0 THEN NULL WHEN id % 3 = 1 THEN 7L ELSE id % 50000 END AS code",
        "IF(id % 5 = 0, 'CLOSED', 'OPEN') AS status",
        "CAST(id % 100 AS DECIMAL(18,2)) AS amount",
        "timestamp_ntz '2015-01-01 00:00:00' + make_interval(0, 0, 0, CAST(id % 3000 AS INT)) AS created",
        "repeat('x', 20) AS filler",
    )
    facts.write.parquet(f"{folder}/facts")
    reference = spark.range(0, 60_000, 1, 2).selectExpr("id % 45000 AS ref_code", "IF(id % 11 = 0, NULL, id) AS ref_id")
    reference.write.parquet(f"{folder}/reference")
    return folder


def facts(spark, files):
    return spark.read.parquet(f"{files}/facts")


def reference(spark, files):
    return spark.read.parquet(f"{files}/reference")


def test_null_profile_is_one_scan(spark, files):
    text = plan(P.null_profile(facts(spark, files), "facts"))
    assert text.count("FileScan") == 1 and "Expand" not in text


def test_null_profile_answers_from_footers(spark, tmp_path):
    rows = [(1, "a", [1, None]), (2, None, []), (None, None, None), (4, "d", [None])]
    path = str(tmp_path / "t")
    spark.createDataFrame(rows, "id int, name string, items array<int>").write.parquet(path)
    plain = sorted(P.null_profile(spark.read.parquet(path), "t").collect())
    settings = {
        "spark__sql__sources__useV1SourceList": "avro,csv,json,kafka,orc,text",
        "spark__sql__parquet__aggregatePushdown": "true",
    }
    with conf(spark, **settings):
        profile = P.null_profile(spark.read.parquet(path), "t")
        assert "PushedAggregation: [COUNT(*), COUNT(id), COUNT(name)]" in plan(profile)
        assert sorted(profile.collect()) == plain
    assert [r.NULL_COUNT for r in sorted(plain, key=lambda r: r.ORDINAL_POSITION)] == [1, 2, 1]


def test_footer_profile_equals_the_scanned_one(spark, tmp_path):
    rows = [(1, "a", [1, None]), (2, None, []), (None, None, None), (4, "d", [None])]
    path = str(tmp_path / "t")
    spark.createDataFrame(rows, "id int, name string, items array<int>").repartition(3).write.parquet(path)
    tables = {"t": spark.read.parquet(path)}
    stage = Stage(spark)
    (stored,), failed = write_footer_profile(spark, tables, {"t": path}, stage)
    assert failed == []
    scanned = P.null_profiles(tables)
    assert sorted(stage.read(P.PROFILE_SCHEMA, stored).collect()) == sorted(scanned.collect())
    assert spark.conf.get("spark.sql.parquet.aggregatePushdown") == "false"
    # A file without one of the columns: whichever way it is answered, the counts are right.
    spark.createDataFrame([(9,)], "id int").write.mode("append").parquet(path)
    mixed = {"t": spark.read.schema("id int, name string, items array<int>").parquet(path)}
    profile = stored_profile(spark, mixed, {"t": path}, Stage(spark))
    assert sorted(profile.collect()) == sorted(P.null_profiles(mixed).collect())


def test_footers_fail_table_by_table(spark, tmp_path):
    """Nested columns are counted from data, which fails for a file of another type."""
    tables, paths = {}, {}
    for name in ("a", "b", "c"):
        paths[name] = str(tmp_path / name)
        spark.range(4).selectExpr("id", "array(id) AS items").write.parquet(paths[name])
        tables[name] = spark.read.parquet(paths[name])
    spark.range(1).selectExpr("id", "'x' AS items").write.mode("append").parquet(paths["b"])
    stage = Stage(spark)
    stored, failed = write_footer_profile(spark, tables, paths, stage)
    assert failed == ["b"] and len(stored) == 2
    assert {r.TABLE_NAME for r in stage.read(P.PROFILE_SCHEMA, *stored).collect()} == {"a", "c"}


def test_the_footer_session_has_the_callers_settings(spark):
    with conf(spark, spark__sql__caseSensitive="true", spark__sql__session__timeZone="Asia/Tokyo"):
        sibling = footer_session(spark)
        assert sibling.conf.get("spark.sql.caseSensitive") == "true"
        assert sibling.conf.get("spark.sql.session.timeZone") == "Asia/Tokyo"
        assert sibling.conf.get("spark.sql.parquet.aggregatePushdown") == "true"


def test_stored_issues_are_not_made_twice(spark):
    """The issues of a query are made from as many scans as without enrichment, and are not shuffled."""
    sf = "/root/testdata/sf0.001"
    if not os.path.isdir(sf):
        pytest.skip("test tables not present")
    frame = QUERIES["attach_enrichment"](spark, sf)
    frame.collect()
    text = plan(frame)
    assert text.count("FileScan") <= 4 and "SortMergeJoin" not in text.split("Initial Plan")[0]
    assert plan(QUERIES["overview"](spark, sf)).count("FileScan") <= 6


def test_duplicate_keys_combine_before_the_shuffle(spark, files):
    text = plan(P.duplicate_keys(facts(spark, files), ["code"]))
    assert "partial_count" in text
    assert "ReadSchema: struct<code:bigint>" in text


def test_rules_on_one_table_share_a_scan(spark, files):
    df = facts(spark, files)
    rules = [
        status_measure("a", "facts", "status", "CLOSED", "amount", "left: ", primary_key=("id",)),
        retention_cutoff("b", "facts", "created", "2016-01-01", "made ", " kept", primary_key=("id",)),
    ]
    both = check_rows(df, rules)
    assert plan(both).count("FileScan") == 1
    single = [check_rows(df, [r]) for r in rules]
    assert both.count() == sum(s.count() for s in single)
    assert "LessThan(created,2016-01-01" in plan(single[1])


def test_small_reference_is_broadcast_by_its_measured_size(spark, files):
    joined = lookup_join(facts(spark, files), reference(spark, files), {"code": "ref_code"}, {"n": "count(1)"})
    assert "BroadcastHashJoin" in plan(joined)


def test_hot_and_missing_keys_are_split(spark, files, tmp_path):
    df, ref = facts(spark, files), reference(spark, files)
    with conf(spark, **NO_BROADCAST):
        joined = lookup_join(df, ref, {"code": "ref_code"}, {"n": "count(1)"})
        text = final_plan(joined)
        assert "SortMergeJoin(skew=true)" in text
        # Neither the rows without a code nor those of the hot code meet in one task.
        apart = lookup_join(df, ref, {"code": "ref_code"}, {"n": "count(1)"})
        apart = apart.selectExpr("id", "code", "n", "spark_partition_id() AS p")
        path = str(tmp_path / "apart")
        apart.write.parquet(path)
        rows = spark.read.parquet(path).groupBy("p").agg(
            F.expr("count_if(code IS NULL) AS missing"), F.expr("count_if(code = 7) AS hot")
        )
        sizes = rows.collect()
        assert max(r.missing for r in sizes) < 100_000 / 2 and max(r.hot for r in sizes) < 100_000 / 2
        plain = df.join(ref.groupBy("ref_code").agg(F.count(F.lit(1)).alias("n")), df.code == F.col("ref_code"), "left")
        assert joined.select("id", "n").exceptAll(plain.select("id", "n")).count() == 0
        assert joined.count() == plain.count() == 300_000


def test_reference_rule_equals_the_plain_left_join(spark, files):
    df = facts(spark, files).selectExpr("id", "code AS a", "IF(id % 4 = 0, NULL, id % 46000) AS b").limit(20_000)
    df.createOrReplaceTempView("plain_facts")
    reference(spark, files).createOrReplaceTempView("plain_reference")
    expected = spark.sql("""
        SELECT id, CASE WHEN a IS NULL AND b IS NULL THEN 'none'
                        WHEN a IS NOT NULL AND x.ref_id IS NULL THEN concat('bad a ', a)
                        ELSE concat('bad b ', b) END AS ISSUE_DETAIL
        FROM plain_facts
        LEFT JOIN plain_reference x ON a = x.ref_code LEFT JOIN plain_reference y ON b = y.ref_code
        WHERE (a IS NULL AND b IS NULL) OR (a IS NOT NULL AND x.ref_id IS NULL) OR (b IS NOT NULL AND y.ref_id IS NULL)
    """)
    refs = [
        Reference("a", "reference", "ref_code", "ref_id", "bad a "),
        Reference("b", "reference", "ref_code", "ref_id", "bad b "),
    ]
    found = any_reference_violations(df, refs, lambda name: reference(spark, files), "none", ["id"])
    found = found.select("id", "ISSUE_DETAIL")
    assert expected.count() > df.count() / 10
    assert found.exceptAll(expected).count() == 0 and expected.exceptAll(found).count() == 0

    # One row per flagged row: a code is valid if any of its reference rows has an id.
    valid = "SELECT ref_code FROM plain_reference WHERE ref_id IS NOT NULL"
    expected = spark.sql(f"""
        SELECT id, CASE WHEN a IS NULL AND b IS NULL THEN 'none'
                        WHEN a IS NOT NULL AND a NOT IN ({valid}) THEN concat('bad a ', a)
                        ELSE concat('bad b ', b) END AS ISSUE_DETAIL
        FROM plain_facts
        WHERE (a IS NULL AND b IS NULL) OR (a IS NOT NULL AND a NOT IN ({valid}))
           OR (b IS NOT NULL AND b NOT IN ({valid}))
    """)
    found = any_reference_violations(
        df, refs, lambda name: reference(spark, files), "none", ["id"], repeat=False
    ).select("id", "ISSUE_DETAIL")
    assert found.select("id").distinct().count() == found.count()
    assert found.exceptAll(expected).count() == 0 and expected.exceptAll(found).count() == 0


def test_rows_repeat_as_often_as_a_hot_reference_code(spark):
    df = spark.sql("SELECT * FROM VALUES (1, 'bad', 'hot'), (2, 'good', 'hot'), (3, 'good', 'bad') AS t(id, a, b)")
    codes = spark.range(150_001).selectExpr("IF(id = 0, 'good', 'hot') AS code", "id AS ref_id")
    refs = [Reference(c, "codes", "code", "ref_id", f"{c}: ") for c in ("a", "b")]
    found = any_reference_violations(df, refs, lambda name: codes, "none", ["id"])
    counts = {(r.id, r.ISSUE_DETAIL): r["count"] for r in found.groupBy("id", "ISSUE_DETAIL").count().collect()}
    assert counts == {(1, "a: bad"): 150_000, (3, "b: bad"): 1}


def test_issue_samples_limit_before_the_shuffle(spark, files):
    issues = _issues(spark, files)
    text = plan(issue_samples(issues))
    assert "WindowGroupLimit" in text and "Partial" in text


def test_few_issues_are_sorted_for_the_samples(spark, tmp_path):
    """Of large groups, one of them all alike, few issues are ranked, and the samples are those of all."""
    made = {
        "TABLE_NAME": "'t'", "ISSUE_TYPE": "CASE WHEN id < 40000 THEN 'alike' WHEN id % 5000 = 0 THEN NULL ELSE 'apart' END",
        "ROW_IDENTIFIER": "IF(id < 40000, NULL, concat('id: ', id * 7919 % 100003))", "ISSUE_DETAIL": "IF(id % 2 = 0, 'x', NULL)",
        "ROW_VALUES": "IF(id % 4 < 2, map('v', CAST(id * 31 % 1009 AS STRING)), NULL)",
    }
    spark.range(0, 100_000, 1, 8).selectExpr(*issue_columns(**made)).write.parquet(str(tmp_path / "issues"))
    issues = spark.read.parquet(str(tmp_path / "issues"))
    assert sample_candidates(issues, 3, drawn=100).count() < 5_000
    place = "struct(ROW_IDENTIFIER, ISSUE_DETAIL, map_entries(ROW_VALUES))"
    rank = f"row_number() OVER (PARTITION BY ISSUE_TYPE, RULE_NAME, TABLE_NAME ORDER BY {place}) AS n"
    shown = ["ISSUE_TYPE", "ROW_IDENTIFIER", "ISSUE_DETAIL", "to_json(ROW_VALUES)"]

    def ranked(df):
        return sorted(repr(tuple(r)) for r in df.selectExpr(*shown, rank).where("n <= 3").collect())

    assert len(ranked(issues)) == 9 and ranked(sample_candidates(issues, 3, drawn=100)) == ranked(issues)
    assert ranked(issue_samples(issues, 3).drop("SAMPLE_NO")) == ranked(issues)


def _issues(spark, files):
    return facts(spark, files).selectExpr(
        "IF(id % 3 = 0, 'hot', concat('t', id % 2000)) AS ISSUE_TYPE", "CAST(NULL AS STRING) AS RULE_NAME",
        "'facts' AS TABLE_NAME", "CAST(id AS STRING) AS ROW_IDENTIFIER", "'d' AS ISSUE_DETAIL", "'low' AS SEVERITY",
        "map('id', CAST(id AS STRING)) AS ROW_VALUES", "filler",
    )


def test_texts_reach_the_rows_of_a_hot_group(spark, files, tmp_path):
    issues = _issues(spark, files)
    names = ("LLM_SUMMARY", "LLM_BUSINESS_IMPACT", "LLM_RECOMMENDED_FIX", "LLM_GOVERNANCE_NOTE")
    texts = issues.select("ISSUE_TYPE", "RULE_NAME", "TABLE_NAME").distinct().select(
        "*", *[F.concat(F.lit(f"{n} "), "ISSUE_TYPE").alias(n) for n in names]
    )
    texts.write.parquet(str(tmp_path / "texts"))
    with conf(spark, **NO_BROADCAST):
        rows = attach_texts(issues, spark.read.parquet(str(tmp_path / "texts")))
        assert "SortMergeJoin(skew=true)" in final_plan(rows)
        assert rows.count() == 300_000
        assert rows.filter("LLM_SUMMARY != concat('LLM_SUMMARY ', ISSUE_TYPE)").count() == 0


def test_insert_missing_only_scans_the_target_for_a_small_source(spark, files):
    target = facts(spark, files).selectExpr("code AS k", "status")
    source = spark.sql("SELECT * FROM VALUES (7L, 'new'), (-1L, 'new'), (-1L, 'again'), (NULL, 'none') AS t(k, status)")
    rows = insert_missing(target, source, ["k"])
    assert sorted(r.status for r in rows.filter("status NOT IN ('OPEN', 'CLOSED')").collect()) == ["again", "new", "none"]
    assert rows.count() == 300_003


def test_findings_of_many_tasks_end_in_few_files(spark, files):
    stage = Stage(spark)
    found = facts(spark, files).repartition(64).filter("id % 10000 = 0")
    path = stage.write_findings(found, "any/label = x")
    stored = spark.read.parquet(path)
    assert stored.count() == 30 and len(stored.inputFiles()) <= 2
