"""Edge cases of the single operators, on tiny frames."""

import json
import random
from datetime import datetime

import pytest

from rowcensus import ISSUE_SCHEMA, Rule, ScanOptions, combine_issues, run_rule, run_rules, scan, scan_schema, widen_issues
from rowcensus.functions.text import json_text, percent_text
from rowcensus.operators import profile as P
from rowcensus.operators import summary as S
from rowcensus.operators import upkeep as U
from rowcensus.operators.builders import status_measure
from rowcensus.plans import enrich as E
from rowcensus.sources import catalog as C
from rowcensus.sources.footers import parquet_location
from rowcensus.sources.staging import Stage, staging_root


def rows_of(df):
    return sorted(map(tuple, df.collect()), key=repr)


# Profile


def test_empty_table_has_rate_zero(spark):
    row = P.null_profile(spark.createDataFrame([], "a int"), "t").first()
    assert (row.TOTAL_ROWS, row.NULL_COUNT, row.NULL_RATE) == (0, 0, 0.0)


def test_threshold_is_strict(spark):
    df = spark.range(20).selectExpr("IF(id = 0, NULL, id) AS a", "IF(id < 2, NULL, id) AS b")
    flagged = P.high_null_columns(P.null_profile(df, "t"), 0.05).collect()
    assert [(r.COLUMN_NAME, r.ISSUE) for r in flagged] == [("b", "Null rate 10.0% exceeds threshold 5.0%")]


def test_percent_text_rounds_like_the_report(spark):
    pairs = [(n, d) for d in range(1, 160) for n in range(d + 1)]
    df = spark.createDataFrame(pairs, "n long, d long").selectExpr("n", "d", f"{percent_text('(n / d)')} AS t")
    wrong = [r for r in df.collect() if r.t != f"{r.n / r.d:.1%}"]
    assert wrong == []


def test_odd_column_names(spark):
    df = spark.createDataFrame([(1, None), (1, "x")], "`a b` int, `it's ``odd``` string")
    rows = {r.COLUMN_NAME: r.NULL_COUNT for r in P.null_profile(df, "o'table").collect()}
    assert rows == {"a b": 0, "it's `odd`": 1}
    counts = {r.COLUMN_NAME: r.DISTINCT_COUNT for r in P.distinct_profile(df, "t").collect()}
    assert counts == {"a b": 1, "it's `odd`": 1}
    issue = P.duplicate_key_issues(df, "t", ["a b"]).first()
    assert issue.ROW_IDENTIFIER == "a b=1" and issue.ROW_VALUES == {"a b": "1"}


@pytest.mark.parametrize("chunk", [1, 2, 10])
def test_distinct_counts_skip_nulls_and_take_any_type(spark, chunk):
    df = spark.sql("""
        SELECT id % 3 AS a, IF(id % 2 = 0, NULL, 'x') AS b, array(id % 4) AS c, struct(id % 5 AS s) AS d,
               map('k', id % 2) AS e, id % 2 = 0 AS f FROM range(40)
    """)
    exact = {r.COLUMN_NAME: r.DISTINCT_COUNT for r in P.distinct_profile(df, "t", chunk=chunk).collect()}
    assert exact == {"a": 3, "b": 1, "c": 4, "d": 5, "e": 2, "f": 2}


def test_approximate_distinct_is_close(spark):
    df = spark.range(20_000).selectExpr("id", "id % 100 AS few")
    got = {r.COLUMN_NAME: r.DISTINCT_COUNT for r in P.distinct_profile(df, "t", method="approx").collect()}
    assert abs(got["id"] - 20_000) < 3_000 and abs(got["few"] - 100) < 15
    with pytest.raises(ValueError):
        P.distinct_profile(df, "t", method="guess")


def test_column_profile_joins_both_figures(spark):
    df = spark.range(10).selectExpr("id", "IF(id < 4, NULL, 1) AS v")
    rows = {r.COLUMN_NAME: (r.NULL_COUNT, r.DISTINCT_COUNT) for r in P.column_profiles(df, "t").collect()}
    assert rows == {"id": (0, 10), "v": (4, 1)}


def test_duplicate_keys_with_nulls_and_threshold(spark):
    df = spark.createDataFrame([(1, None), (1, None), (1, None), (2, "x"), (2, "x"), (3, "y")], "a int, b string")
    assert rows_of(P.duplicate_keys(df, ["a", "b"])) == [(1, None, 3), (2, "x", 2)]
    assert rows_of(P.duplicate_keys(df, ["a", "b"], max_extra=1)) == [(1, None, 3)]
    texts = [r.ROW_IDENTIFIER for r in P.duplicate_key_issues(df, "t", ["a", "b"]).collect()]
    assert sorted(texts) == ["a=1 | b=None", "a=2 | b=x"]


def test_table_profile_lists_table_issues_first(spark):
    df = spark.createDataFrame([(1, None, None), (1, None, "x"), (2, None, None)], "id int, z string, y string")
    row = P.table_profiles({"t": df}, {"t": ["id"]}).first()
    assert row.ISSUES == (
        "Found 1 duplicate primary key group(s) on ['id']; z: Null rate 100.0% exceeds threshold 5.0%; "
        "y: Null rate 66.7% exceeds threshold 5.0%"
    )
    assert (row.COLUMN_ISSUE_COUNT, row.TABLE_ISSUE_COUNT, row.ROW_COUNT) == (2, 1, 3)


def test_table_without_columns(spark):
    bare = spark.range(3).select()
    frames = scan(spark, {"bare": bare, "t": spark.range(2)}, generated="t0")
    rows = {r.TABLE_NAME: r for r in frames["Table_Profiles"].collect()}
    assert rows["bare"].ISSUES == "No columns found in INFORMATION_SCHEMA"
    assert (rows["bare"].ROW_COUNT, rows["bare"].TABLE_ISSUE_COUNT, rows["bare"].PRIMARY_KEYS) == (3, 1, "")
    assert frames["Row_Issues"].count() == 0


def test_stale_needs_a_newest_stamp(spark):
    old = spark.sql("SELECT date'2024-01-01' AS d")
    new = spark.sql("SELECT timestamp'2024-04-30 10:00:00' AS d")
    none = spark.sql("SELECT CAST(NULL AS DATE) AS d")
    got = P.stale_tables({"old": (old, "d"), "new": (new, "d"), "none": (none, "d")}, datetime(2024, 5, 1), 90)
    assert {r.TABLE_NAME: r.IS_STALE for r in got.collect()} == {"old": True, "new": False, "none": False}


# Catalog


@pytest.fixture(scope="module")
def schema(spark, tmp_path_factory):
    folder = tmp_path_factory.mktemp("catalog")
    spark.sql("SELECT id AS client_id, IF(id = 1, NULL, 'x') AS note FROM range(4)").write.parquet(f"{folder}/clients")
    spark.sql("SELECT 1 AS code, 2 AS other FROM range(2)").write.parquet(f"{folder}/codes")
    C.register_parquet(
        spark, "dq_test", {"Clients": f"{folder}/clients", "codes": f"{folder}/codes"}, {"codes": ["other", "code"]}
    )
    C.register_parquet(spark, "dq_test", {"CODES": f"file://{folder}/codes/"})
    spark.sql("CREATE VIEW dq_test.seen AS SELECT 1 AS one")
    spark.range(1).createOrReplaceTempView("passing")
    return "dq_test"


def test_listing_skips_views_and_excluded_names(spark, schema):
    assert C.list_tables(spark, schema) == ["clients", "codes"]
    assert C.list_tables(spark, schema, exclude=["CODES", "missing"]) == ["clients"]


def test_registering_again_refuses_another_folder_and_changes_keys(spark, schema, tmp_path):
    with pytest.raises(ValueError, match="registered on"):
        C.register_parquet(spark, schema, {"codes": str(tmp_path)})
    folder = C.described_table(spark, schema, "codes")["Location"]
    C.register_parquet(spark, schema, {"codes": folder}, {"codes": ["code"]})
    assert C.declared_keys(spark, schema, "codes") == ["code"]
    C.register_parquet(spark, schema, {"codes": folder}, {"codes": ["other", "code"]})


def test_catalog_of_the_listing(spark, schema):
    assert C.list_tables(spark, schema, database="spark_catalog") == ["clients", "codes"]
    with pytest.raises(Exception, match="no_such_catalog"):
        C.list_tables(spark, schema, database="no_such_catalog")


def test_listing_and_lookups_quote_names(spark):
    asked = []

    class Catalog:
        def listTables(self, name):
            asked.append(name)
            return []

    class Session:
        catalog = Catalog()

        def sql(self, text):
            asked.append(text)
            raise RuntimeError("down")

    assert C.list_tables(Session(), "my-db", database="odd`one") == []
    assert asked == ["`odd``one`.`my-db`"]
    # A lookup that fails falls back: the key is inferred and the table scanned.
    assert C.declared_keys(Session(), "c", "s", "t") == [] and parquet_location(Session(), "c", "s", "t") is None


def test_keys_come_from_override_then_property_then_names(spark, schema):
    tables = C.load_tables(spark, "spark_catalog", schema)
    complete = C.not_null_columns(tables, P.null_profiles(tables))
    declared = C.declared_keys(spark, "spark_catalog", schema, "codes")
    assert declared == ["other", "code"]
    assert C.declared_keys(spark, "spark_catalog", schema, "clients") == []
    assert C.resolve_keys("codes", ["code", "other"], complete["codes"], {"Codes": ["code"]}, declared) == ["code"]
    assert C.resolve_keys("codes", ["code", "other"], complete["codes"], {"x": ["y"]}, declared) == declared
    assert C.resolve_keys("clients", ["note", "client_id"], complete["clients"]) == ["client_id"]
    assert C.infer_key(["a", "b_id"], []) == ["a"]
    assert C.infer_key(["paid", "b_id"], ["paid", "b_id"]) == ["paid"]
    assert C.infer_key([], []) == []


def test_column_metadata(spark):
    df = spark.sql("SELECT id, CAST(NULL AS STRING) AS note FROM range(2)")
    seen = {r.COLUMN_NAME: r.IS_NULLABLE for r in C.column_metadata(df, "t", P.null_profile(df, "t")).collect()}
    assert seen == {"id": "NO", "note": "YES"}
    plain = C.column_metadata(df, "t").collect()
    assert [(r.COLUMN_NAME, r.DATA_TYPE, r.ORDINAL_POSITION) for r in plain] == [("id", "bigint", 1), ("note", "string", 2)]


def test_bound_query_and_scalar(spark):
    df = C.bound_query(spark, "SELECT count(*) AS n FROM range(10) WHERE id > :low", {"low": 6})
    assert C.scalar(df) == 3
    assert C.scalar(spark.sql("SELECT 1 AS one WHERE false")) is None


def test_scan_of_a_schema_writes_its_report(spark, schema, tmp_path):
    frames = scan_schema(
        spark, "spark_catalog", schema, exclude=["nothing"], report_folder=str(tmp_path), now=datetime(2025, 1, 2, 3, 4, 5)
    )
    result = frames["Run_Result"].first()
    assert result.output_path == f"{tmp_path}/dq_governance_report_20250102_030405"
    assert (result.tables_scanned, result.total_issues) == (2, 2)
    keys = {r.TABLE_NAME: r.PRIMARY_KEYS for r in frames["Table_Profiles"].collect()}
    assert keys == {"clients": "client_id", "codes": "other, code"}
    with pytest.raises(ValueError):
        scan_schema(spark, "", schema)


class FakeContext:
    folder = None

    def getCheckpointDir(self):
        return self.folder

    def setCheckpointDir(self, folder):
        self.folder = folder


class FakeSession:
    def __init__(self, **conf):
        self.conf = {k.replace("__", "."): v for k, v in conf.items()}
        self.sparkContext = FakeContext()


def test_staging_needs_a_shared_folder_on_a_cluster():
    with pytest.raises(ValueError):
        staging_root(FakeSession(spark__master="yarn"))
    named = FakeSession(spark__master="yarn", spark__checkpoint__dir="hdfs:///shared")
    assert staging_root(named) == "hdfs:///shared"
    local = FakeSession(spark__master="local[2]")
    folder = staging_root(local)
    assert folder and staging_root(local) == folder


# Issues and rules


def test_combine_fills_gaps_and_types_nothing(spark):
    part = spark.sql("SELECT 't' AS TABLE_NAME, 'x' AS ISSUE_TYPE, 'dropped' AS OTHER")
    assert combine_issues(spark, [part]).schema.names == ISSUE_SCHEMA.names
    empty = combine_issues(spark, [])
    assert empty.schema == ISSUE_SCHEMA and empty.count() == 0
    assert S.rule_summary(empty).count() == 0
    wide = widen_issues(combine_issues(spark, [part.selectExpr("*", "map('k', 'v') AS ROW_VALUES")]), ["k", "none"])
    assert (wide.first().k, wide.first().none) == ("v", None)


def test_summary_keeps_null_keys(spark):
    part = spark.sql("SELECT IF(id = 0, NULL, 'x') AS ISSUE_TYPE, CAST(NULL AS STRING) AS RULE_NAME, 'low' AS SEVERITY FROM range(3)")
    rows = S.rule_summary(combine_issues(spark, [part])).collect()
    assert [(r.ISSUE_TYPE, r.ISSUE_COUNT) for r in rows] == [("x", 2), (None, 1)]


def people(spark):
    return spark.createDataFrame([(1, "7", True), (2, "seven", None)], "id int, age string, ok boolean")


def test_rule_failures_stay_apart(spark, schema):
    tables = {"people": people(spark)}
    people(spark).createOrReplaceTempView("people_view")
    rules = [
        Rule(id="fine", sql="SELECT id FROM people_view", primary_key=("id",)),
        Rule(id="bad_sql", sql="SELEC nothing"),
        Rule(id="bad_column", sql="SELECT nope FROM people_view", severity="high", name="No column", table="people"),
        Rule(id="bad_cast", sql="SELECT CAST(age AS INT) AS age FROM people_view"),
        Rule(id="braces", sql="SELECT 1 AS one WHERE '{x}' = '{x}' -- {database}.{schema}"),
        Rule(id="missing_key", sql="SELECT id FROM people_view", primary_key=("nope",)),
        Rule(id="no_table", table="absent", where="true"),
        Rule(id="off", sql="SELECT 1", enabled=False),
        Rule(id="metadata", dynamic=True),
        Rule(id="nothing", sql=""),
    ]
    found = run_rules(spark, rules, "spark_catalog", schema, tables, Stage(spark))
    rows = {r.ISSUE_TYPE: r for r in found.filter("ROW_IDENTIFIER = 'RULE_ERROR'").collect()}
    assert set(rows) == {"bad_sql", "bad_column", "bad_cast", "missing_key", "no_table"}
    bad = rows["bad_column"]
    assert bad.ISSUE_DETAIL.startswith("Rule failed to execute: ")
    assert (bad.SEVERITY, bad.RULE_NAME, bad.TABLE_NAME, bad.SCHEMA) == ("high", "No column", "people", schema)
    fine = found.filter("ISSUE_TYPE IN ('fine', 'braces')").groupBy("ISSUE_TYPE").count()
    assert rows_of(fine) == [("braces", 1), ("fine", 2)]


def test_rules_reach_tables_that_are_not_scanned(spark, schema):
    rule = Rule(id="r", table="codes", violations=lambda t: t("codes").limit(1), primary_key=("code",))
    found = run_rules(spark, [rule], "spark_catalog", schema, {"people": people(spark)})
    assert [r.ROW_IDENTIFIER for r in found.collect()] == ["1"]


def test_one_bad_row_rule_does_not_spoil_the_shared_scan(spark):
    rules = [
        Rule(id="good", table="people", where="id > 0", primary_key=("id",)),
        Rule(id="bad", table="people", where="CAST(age AS INT) > 1", primary_key=("id",)),
    ]
    found = run_rules(spark, rules, "c", "s", {"people": people(spark)}, Stage(spark))
    got = {(r.ISSUE_TYPE, r.ROW_IDENTIFIER) for r in found.collect()}
    assert got == {("good", "1"), ("good", "2"), ("bad", "RULE_ERROR")}


def test_lazy_rule_failure_is_reported_at_analysis(spark):
    rule = Rule(id="r", sql="SELECT nope FROM absent_table")
    assert run_rule(spark, rule, "c", "s").first().ROW_IDENTIFIER == "RULE_ERROR"


def test_rule_defaults_and_identifiers(spark):
    table = lambda name: people(spark)
    bare = run_rule(spark, Rule(id="r", violations=lambda t: t("p").select("id", "ok"), primary_key=("ID", "ok")), "c", "s", table)
    rows = {r.ROW_IDENTIFIER: r for r in bare.collect()}
    assert set(rows) == {"1 | True", "2 | None"}
    row = rows["2 | None"]
    assert (row.TABLE_NAME, row.SEVERITY, row.RULE_NAME, row.ISSUE_TYPE, row.ISSUE_DETAIL) == ("UNKNOWN", "medium", "r", "r", "r")
    assert (row.PRIMARY_KEY, row.ROW_VALUES, row.DATABASE) == ("ID, ok", {"id": "2", "ok": None}, "c")
    own = Rule(id="r", description="told", violations=lambda t: t("p").selectExpr("'mine' AS issue_type", "id"))
    first = run_rule(spark, own, "c", "s", table).orderBy("ROW_IDENTIFIER").collect()
    assert {(r.ISSUE_TYPE, r.ISSUE_DETAIL, r.PRIMARY_KEY) for r in first} == {("mine", "told", "")}
    again = run_rule(spark, own, "c", "s", lambda name: people(spark).repartition(3)).orderBy("ROW_IDENTIFIER").collect()
    assert [r.ROW_IDENTIFIER for r in first] == [r.ROW_IDENTIFIER for r in again] and len(first[0].ROW_IDENTIFIER) == 64


def test_status_rule_ignores_missing_and_zero_measures(spark):
    df = spark.sql("SELECT * FROM VALUES (1, 'archived', 5.50), (2, 'ARCHIVED', 0), (3, 'Archived', NULL), (4, 'open', 9) AS t(id, st, m)")
    rule = status_measure("r", "t", "st", "archived", "m", "it's ", primary_key=("id",))
    found = run_rule(spark, rule, "c", "s", lambda name: df).collect()
    assert [(r.ROW_IDENTIFIER, r.ISSUE_DETAIL) for r in found] == [("1", "it's 5.50")]


def test_rules_from_parsed_entries(spark):
    entry = {"id": "r", "name": "Rule", "severity": "high", "table": "T", "primary_key": ["id"], "sql": "SELECT 1 AS id"}
    rule = Rule.from_dict(entry)
    assert rule.primary_key == ("id",) and rule.enabled and not rule.dynamic
    row = run_rule(spark, rule, "c", "s").first()
    assert (row.ROW_IDENTIFIER, row.SEVERITY, row.RULE_NAME, row.TABLE_NAME) == ("1", "high", "Rule", "T")
    with pytest.raises(TypeError):
        Rule.from_dict({"id": "r", "sqll": "SELECT 1"})


def test_scan_can_add_distinct_counts(spark):
    tables = {"a": spark.range(6).selectExpr("id", "id % 2 AS v"), "b": spark.range(3).selectExpr("id")}
    for method in ("exact", "approx"):
        frames = scan(spark, tables, options=ScanOptions(distinct=method), generated="t0")
        rows = {(r.TABLE_NAME, r.COLUMN_NAME): (r.NULL_COUNT, r.DISTINCT_COUNT) for r in frames["Column_Profiles"].collect()}
        assert rows == {("a", "id"): (0, 6), ("a", "v"): (0, 2), ("b", "id"): (0, 3)}
    plain = scan(spark, tables, generated="t0")["Column_Profiles"]
    assert plain.count() == 3 and "DISTINCT_COUNT" not in plain.columns


# Enrichment


def test_samples_prompts_and_severity(spark):
    issues = combine_issues(spark, [spark.sql("""
        SELECT 't' AS TABLE_NAME, 'k' AS ISSUE_TYPE, IF(id < 8, CAST(NULL AS STRING), 'named') AS RULE_NAME,
               lpad(id, 3, '0') AS ROW_IDENTIFIER, 'd' AS ISSUE_DETAIL, IF(id = 0, 'high', 'low') AS SEVERITY FROM range(10)
    """)])
    samples = E.issue_samples(issues, 3)
    assert rows_of(samples.select("RULE_NAME", "ROW_IDENTIFIER", "SAMPLE_NO")) == sorted(
        [(None, "000", 1), (None, "001", 2), (None, "002", 3), ("named", "008", 1), ("named", "009", 2)], key=repr
    )
    prompts = {r.RULE_NAME: r for r in E.issue_prompts(issues, 3).collect()}
    assert prompts[None].SEVERITY == "high" and "Rule: k\n" in prompts[None].PROMPT
    sample = json.loads(prompts["named"].SAMPLE_ROWS)
    assert [r["ROW_IDENTIFIER"] for r in sample] == ["008", "009"] and "NULL_RATE" not in sample[0]
    groups = {r.RULE_NAME: (r.ISSUE_COUNT, r.SEVERITY) for r in S.issue_groups(issues).collect()}
    assert groups == {None: (8, "high"), "named": (2, "low")}
    answers = E.respond(E.issue_prompts(issues, 3), E.template_answers())
    attached = E.attach_texts(issues, E.parse_responses(answers))
    assert attached.filter("LLM_SUMMARY = 'k in t'").count() == 10


def test_one_bad_prompt_costs_only_its_answer(spark):
    def fragile(prompts, max_tokens):
        if any("poison" in p for p in prompts):
            raise RuntimeError("refused")
        return [f" {p} {max_tokens} " for p in prompts]

    prompts = spark.createDataFrame([("a",), ("poison",), ("b",)], "PROMPT string").coalesce(1)
    rows = {r.PROMPT: (r.RESPONSE, r.ERROR) for r in E.respond(prompts, fragile, parallel=1, max_tokens=10).collect()}
    assert rows == {"a": ("a 1024", None), "b": ("b 1024", None), "poison": (None, "RuntimeError: refused")}


def test_attempts_are_counted_and_answers_must_match(spark):
    def flaky():
        calls = []

        def fn(prompts):
            calls.append(1)
            if len(calls) < 3:
                raise OSError("later")
            return ["ok"] * len(prompts)

        return fn

    prompts = spark.createDataFrame([("a",)], "PROMPT string")
    assert E.respond(prompts, flaky(), parallel=1).first().RESPONSE == "ok"
    assert E.respond(prompts, flaky(), attempts=2, parallel=1).first().ERROR == "OSError: later"
    assert "2 answers to 1" in E.respond(prompts, lambda p: ["x", "y"], parallel=1).first().ERROR


def _expected_json(raw):
    """What to find, spelled out on positions instead of patterns."""
    text = raw.strip()
    low = text.lower()
    opened = text.find("```")
    if opened >= 0:
        start = opened + 3 + (4 if low[opened + 3 : opened + 7] == "json" else 0)
        closed = text.find("```", start)
        if closed >= 0:
            text = text[start:closed].strip()
    first, last = text.find("{"), text.rfind("}")
    return text[first : last + 1] if first != -1 and last > first else text


def test_json_text_on_random_answers(spark):
    rng = random.Random(7)
    parts = ["{", "}", '"a": 1', "```", "```json", "```JSON\n", "\n", " ", " ", "\t", "text", "é", "{\"k\": 2}"]
    texts = ["".join(rng.choices(parts, k=rng.randint(0, 9))) for _ in range(3000)]
    df = json_text(spark.createDataFrame([(t,) for t in texts], "raw string"), "raw", "found")
    wrong = [(r.raw, r.found, _expected_json(r.raw)) for r in df.collect() if r.found != _expected_json(r.raw)]
    assert wrong == []


@pytest.mark.parametrize(
    "raw, summary",
    [
        ('{"llm_summary": "s", "extra": 1}', "s"),
        ('{"llm_summary": null}', ""),
        ('{"business_impact": "b"}', ""),
        ('```json\n{"llm_summary": "s"}\n```', "s"),
        ('Here: {"llm_summary": "s"} done', "s"),
        ('{"llm_summary": "é\\n"}', "é\n"),
    ],
)
def test_parsed_answers(spark, raw, summary):
    df = spark.createDataFrame([("t", "r", raw)], "ISSUE_TYPE string, RULE_NAME string, RESPONSE string")
    row = E.parse_responses(df).first()
    assert (row.LLM_SUMMARY, row.LLM_RECOMMENDED_FIX) == (summary, "")


@pytest.mark.parametrize(
    "raw",
    ["no object", "{'llm_summary': 's'}", '{"llm_summary": "s",}', '{"a": 1} {"b": 2}', "[1, 2]", "7", "", "}{", "x" * 900],
)
def test_answers_that_are_not_one_object(spark, raw):
    df = spark.createDataFrame([("t", "r", raw)], "ISSUE_TYPE string, RULE_NAME string, RESPONSE string")
    row = E.parse_responses(df).first()
    assert row.LLM_SUMMARY == raw
    assert E.parse_responses(df, fallback_chars=5).first().LLM_SUMMARY == raw[:5]
    assert row.LLM_RECOMMENDED_FIX == "Review issue manually; LLM response was not structured JSON."
    assert row.LLM_GOVERNANCE_NOTE == "Issue: t / r" and row.LLM_BUSINESS_IMPACT == ""


def test_unanswered_prompts_keep_their_error_in_the_report(spark):
    def refuse(prompts, max_tokens):
        assert max_tokens == 2048
        raise ValueError("no answer")

    tables = {"t": spark.createDataFrame([(1, None), (1, None)], "id int, v int")}
    options = ScanOptions(max_tokens=2048, attempts=1, prompt_batch=1)
    frames = scan(spark, tables, enrich=refuse, options=options, generated="t0")
    assert {r.LLM_ERROR for r in frames["Row_Issues"].collect()} == {"ValueError: no answer"}
    assert [r.LLM_ERROR for r in frames["LLM_Table_Summaries"].collect()] == ["ValueError: no answer"]


@pytest.mark.parametrize("staged", [False, True])
def test_payload_in_another_case_names_a_column_once(spark, staged):
    df = spark.createDataFrame([(1, "a"), (2, "b")], "client_id int, note string")
    rule = Rule(id="r", table="t", where="client_id > 1", primary_key=("CLIENT_ID",), payload=("client_id", "NOTE", "Note"))
    issues = run_rule(spark, rule, "d", "s", lambda name: df, Stage(spark) if staged else None)
    assert [r.ROW_VALUES for r in issues.collect()] == [{"client_id": "2", "note": "b"}]


def test_a_closed_stage_is_gone(spark, tmp_path):
    stage = Stage(spark, str(tmp_path))
    stage.write(spark.range(3), "x")
    assert list((tmp_path / "rowcensus").iterdir())
    stage.close()
    assert not list((tmp_path / "rowcensus").iterdir())


def test_wide_distinct_counts(spark):
    rows = [(1, "a", 1.0, None, [1]), (1, None, 2.0, None, [1]), (2, "a", 0.0, None, None), (None, "b", -0.0, None, [])]
    df = spark.createDataFrame(rows, "a int, b string, c double, `d``x` int, e array<int>")
    wide = {r.COLUMN_NAME: r.DISTINCT_COUNT for r in P.distinct_profile(df, "t", wide=2).collect()}
    assert wide == {r.COLUMN_NAME: r.DISTINCT_COUNT for r in P.distinct_profile(df, "t").collect()}
    assert wide == {"a": 2, "b": 2, "c": 3, "d`x": 0, "e": 2}
    text = P.distinct_profile(df, "t", wide=2)._jdf.queryExecution().executedPlan().toString()
    assert text.count("Generate inline") == 4


# Upkeep


def test_insert_missing_keeps_matches_and_repeats(spark):
    target = spark.createDataFrame([(1, "old"), (None, "null")], "k int, v string")
    source = spark.createDataFrame([("new", 1), ("new", 2), ("twice", 2), ("n", None)], "v string, k int")
    rows = rows_of(U.insert_missing(target, source, ["k"]))
    assert rows == sorted([(1, "old"), (None, "null"), (2, "new"), (2, "twice"), (None, "n")], key=repr)


def test_corrections(spark):
    target = spark.createDataFrame([(1, "a", 5), (2, "b", 6), (None, "c", 7)], "k int, v string, w int")
    fixes = spark.createDataFrame([(1, None, 1), (1, "z", 2), (9, "q", 1)], "k int, v string, seq int")
    latest = rows_of(U.apply_corrections(target, fixes, ["k"], ["v"], sequence="seq"))
    assert latest == sorted([(1, "z", 5), (2, "b", 6), (None, "c", 7)], key=repr)
    single = rows_of(U.apply_corrections(target, fixes.filter("seq = 1"), ["k"], ["v"]))
    assert single == sorted([(1, None, 5), (2, "b", 6), (None, "c", 7)], key=repr)
    with pytest.raises(Exception, match="more than one correction"):
        U.apply_corrections(target, fixes, ["k"], ["v"]).collect()


def test_ensure_column(spark):
    df = spark.createDataFrame([(1,)], "Code int")
    assert U.ensure_column(df, "CODE", "string").columns == ["Code"]
    added = U.ensure_column(df, "RM_CODE", "decimal(18,2)")
    assert added.schema["RM_CODE"].dataType.simpleString() == "decimal(18,2)" and added.first().RM_CODE is None
