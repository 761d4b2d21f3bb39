"""Explanatory text per issue group, from a batch function the caller supplies."""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import labels
from ..functions.text import json_text, literal, quoted
from ..operators.issues import ISSUE_SCHEMA
from ..operators.summary import GROUP
from ..sources.staging import Stage

SAMPLE_SIZE = 5
#: One issue in about so many is ranked first, to learn which issues can be among the first of their group.
DRAWN = 1000
TOKEN_LIMIT = 1024

CONTRACT = (
    "Answer with one JSON object and nothing else: no markdown, no code fences.\n"
    'Its keys are exactly "llm_summary" (the problem in one sentence), '
    '"business_impact" (the risk it creates for the business), '
    '"recommended_fix" (concrete steps that resolve it) and '
    '"governance_note" (what matters for compliance or governance).'
)

_PLACE = "struct(ROW_IDENTIFIER, ISSUE_DETAIL, map_entries(ROW_VALUES))"


def _numbered(issues: DataFrame, size: int) -> DataFrame:
    """The first ``size`` rows of every group; Spark sorts all rows it is given."""
    rank = f"row_number() OVER (PARTITION BY {', '.join(GROUP)} ORDER BY {_PLACE})"
    return issues.selectExpr("*", f"{rank} AS SAMPLE_NO").where(f"SAMPLE_NO <= {int(size)}")


def sample_candidates(
    issues: DataFrame, size: int = SAMPLE_SIZE, stage: Stage | None = None, drawn: int = DRAWN
) -> DataFrame:
    """The issues that can be among the first ``size`` of their group: few, however many there are.

    Row ``size`` of the drawn issues of a group bounds the places of its first rows. All
    issues before it are kept, and of those that share its place the drawn ones, which are
    enough. About ``size * drawn`` issues of a group remain; a group of which fewer than
    ``size`` are drawn is kept whole. The bounds are sent to all tasks: there is one to about
    ``size * drawn`` issues at most.
    """
    stage = stage or Stage(issues.sparkSession)
    kept = [quoted(c) for c in issues.columns]
    first = _numbered(issues.where(f"rand(0) * {int(drawn)} < 1"), size)
    first = stage.read(first.schema, stage.write(first, "drawn-issues"))
    bounds = first.where(f"SAMPLE_NO = {int(size)}").selectExpr(*[f"{k} AS _{k}" for k in GROUP], f"{_PLACE} AS _bound")
    same_group = F.expr(" AND ".join(f"{k} <=> _{k}" for k in GROUP))
    before = issues.join(F.broadcast(bounds), same_group, "left").where(f"_bound IS NULL OR {_PLACE} < _bound")
    level = first.join(F.broadcast(bounds), same_group).where(f"{_PLACE} <=> _bound")
    return before.selectExpr(*kept).union(level.selectExpr(*kept))


def issue_samples(issues: DataFrame, size: int = SAMPLE_SIZE, stage: Stage | None = None) -> DataFrame:
    """The first rows of every issue group, numbered.

    ``issues`` are read twice, so store them first if they are costly to make. Only
    candidates are sorted, and Spark keeps only ``size`` rows per group and task before the
    shuffle, so a group that holds most of the issues floods no task.
    """
    return _numbered(sample_candidates(issues, size, stage), size)


def issue_prompts(issues: DataFrame, size: int = SAMPLE_SIZE, stage: Stage | None = None) -> DataFrame:
    """One prompt per (type, rule, table); the severity is that of the group's first row."""
    names = ", ".join(ISSUE_SCHEMA.names)
    record = f"struct(SAMPLE_NO, to_json(struct({names})) AS ROW, SEVERITY)"
    grouped = issue_samples(issues, size, stage).groupBy(*GROUP).agg(
        F.expr(f"array_sort(collect_list({record})) AS _rows")
    )
    ready = grouped.selectExpr(
        *GROUP,
        f"coalesce(_rows[0].SEVERITY, {literal(labels.DEFAULT_SEVERITY)}) AS SEVERITY",
        "concat('[', array_join(transform(_rows, r -> r.ROW), ','), ']') AS SAMPLE_ROWS",
    )
    lines = [
        literal("You review data quality findings for a governance team."),
        "concat('Table: ', coalesce(TABLE_NAME, 'None'))",
        "concat('Kind of issue: ', coalesce(ISSUE_TYPE, 'None'))",
        "concat('Rule: ', coalesce(nullif(RULE_NAME, ''), ISSUE_TYPE, 'None'))",
        "concat('Severity: ', SEVERITY)",
        "concat('Sample rows as JSON: ', SAMPLE_ROWS)",
        literal(CONTRACT),
    ]
    return ready.selectExpr("*", f"concat_ws(chr(10), {', '.join(lines)}) AS PROMPT")


def table_prompts(table_profiles: DataFrame) -> DataFrame:
    """One prompt per table that has an issue of its own or in a column."""

    def bullets(items: str) -> str:
        listed = f"array_join(transform({items}, i -> concat('- ', i)), chr(10))"
        return f"IF(size({items}) > 0, {listed}, '- None')"

    lines = [
        "concat('Describe the data quality of the table ', TABLE_NAME, ' for a governance report.')",
        "concat('Rows: ', CAST(ROW_COUNT AS STRING))",
        literal("Issues in columns:"),
        bullets("COLUMN_ISSUES"),
        literal("Issues of the table itself:"),
        bullets("TABLE_ISSUES"),
        literal("Write two or three specific sentences, without bullet points."),
    ]
    affected = table_profiles.where("COLUMN_ISSUE_COUNT + TABLE_ISSUE_COUNT > 0")
    return affected.selectExpr("TABLE_NAME", f"concat_ws(chr(10), {', '.join(lines)}) AS PROMPT")


def respond(
    prompts: DataFrame,
    fn: Callable[..., list[str]],
    attempts: int = 3,
    batch: int = 16,
    parallel: int | None = None,
    max_tokens: int | None = None,
    pause: float = 0.0,
) -> DataFrame:
    """Add RESPONSE and ERROR by running ``fn(list_of_prompts) -> list_of_texts``.

    A batch is tried up to ``attempts`` times, then its prompts one by one, so that one
    bad prompt costs only its own answer. A prompt that never succeeds keeps a null
    response and the last error. The prompts are few but slow to answer: they are spread
    over ``parallel`` tasks, because adaptive coalescing would put them all in one.

    With ``max_tokens`` the function also gets ``max_tokens=``, at least 1024. Between the
    attempts at a batch, a task waits ``pause`` seconds, then twice and four times as long.
    """
    extra = {} if max_tokens is None else {"max_tokens": max(max_tokens, TOKEN_LIMIT)}

    def ask(texts: list[str]) -> tuple[list[str | None], str | None]:
        error = None
        for attempt in range(attempts):
            if attempt and pause:
                time.sleep(pause * 2 ** (attempt - 1))
            try:
                answers = list(fn(texts, **extra))
                if len(answers) != len(texts):
                    raise ValueError(f"{len(answers)} answers to {len(texts)} prompts")
                return [None if a is None else str(a).strip() for a in answers], None
            except Exception as exc:
                error = f"{type(exc).__name__}: {exc}"
        return [None] * len(texts), error

    def run(frames: Iterator) -> Iterator:
        for pdf in frames:
            texts = pdf["PROMPT"].tolist()
            responses: list[str | None] = []
            errors: list[str | None] = []
            for start in range(0, len(texts), batch):
                part = texts[start : start + batch]
                answers, error = ask(part)
                if error is None or len(part) == 1:
                    responses += answers
                    errors += [error] * len(part)
                    continue
                for text in part:
                    answers, error = ask([text])
                    responses += answers
                    errors.append(error)
            yield pdf.assign(RESPONSE=responses, ERROR=errors)

    spark = prompts.sparkSession
    tasks = parallel or spark.sparkContext.defaultParallelism
    fields = ", ".join(f"{quoted(f.name)} {f.dataType.simpleString()}" for f in prompts.schema.fields)
    return prompts.repartition(tasks).mapInPandas(run, f"{fields}, RESPONSE string, ERROR string")


def parse_responses(
    df: DataFrame,
    response: str = "RESPONSE",
    issue_type: str = "ISSUE_TYPE",
    rule_name: str = "RULE_NAME",
    fallback_chars: int | None = None,
) -> DataFrame:
    """The four LLM_* columns from free-form answers.

    Missing keys give empty texts. An answer that is not exactly one JSON object becomes
    the summary, whole unless ``fallback_chars`` says how much of it to keep, with a note to
    review it by hand. The text is parsed as the only element of an array, since the parser
    would otherwise accept whatever follows the first object.
    """
    raw, kind, rule = quoted(response), quoted(issue_type), quoted(rule_name)
    schema = f"array<struct<{', '.join(f'{key}: string' for key in labels.RESPONSE_COLUMNS)}>>"
    strict = "map('allowSingleQuotes', 'false')"
    # Prose is told apart by its ends: a parse that fails costs an exception per row.
    is_object = "startswith(_json, '{') AND endswith(_json, '}')"
    parsed = f"IF({is_object}, from_json(concat('[', _json, ']'), '{schema}', {strict}), NULL)"
    fallback = {
        "llm_summary": raw if fallback_chars is None else f"substring({raw}, 1, {int(fallback_chars)})",
        "business_impact": "''",
        "recommended_fix": literal(labels.MANUAL_FIX),
        "governance_note": f"concat('Issue: ', coalesce({kind}, 'None'), ' / ', "
        f"coalesce(nullif({rule}, ''), {kind}, 'None'))",
    }
    kept = [quoted(c) for c in df.columns]
    texts = [
        f"CASE WHEN {raw} IS NULL THEN '' WHEN size(_parsed) = 1 AND _parsed[0] IS NOT NULL "
        f"THEN coalesce(_parsed[0].{key}, '') ELSE {fallback[key]} END AS {name}"
        for key, name in labels.RESPONSE_COLUMNS.items()
    ]
    return json_text(df, raw, "_json").selectExpr(*kept, f"{parsed} AS _parsed").selectExpr(*kept, *texts)


def attach_texts(issues: DataFrame, texts: DataFrame) -> DataFrame:
    """Give every issue the texts of its group, null keys included; empty by default.

    ``texts`` has one row per group. If it has the ERROR of each group, that becomes
    LLM_ERROR. Catalyst broadcasts it when it is measured small enough; beyond that, AQE
    splits the groups that hold most of the issues.
    """
    names = list(labels.RESPONSE_COLUMNS.values())
    errors = ["ERROR AS LLM_ERROR"] if "ERROR" in texts.columns else []
    right = texts.selectExpr(*[f"{k} AS _{k}" for k in GROUP], *names, *errors)
    same_group = F.expr(" AND ".join(f"{k} <=> _{k}" for k in GROUP))
    joined = issues.join(right, same_group, "left")
    kept = [quoted(c) for c in issues.columns]
    return joined.selectExpr(*kept, *[f"coalesce({n}, '') AS {n}" for n in names], *(["LLM_ERROR"] if errors else []))


def template_answers() -> Callable[[list[str]], list[str]]:
    """A deterministic stand-in for a model: answers from the prompt's own lines.

    Returned as a closure so that it travels to the workers by value.
    """

    def answer(prompts: list[str]) -> list[str]:
        import json

        out = []
        for prompt in prompts:
            facts = dict(line.split(": ", 1) for line in prompt.split("\n") if ": " in line)
            kind, table = facts.get("Kind of issue"), facts.get("Table")
            if kind is None:
                out.append(prompt.split("\n", 1)[0])
                continue
            out.append(
                json.dumps(
                    {
                        "llm_summary": f"{kind} in {table}",
                        "business_impact": f"Severity {facts.get('Severity')}",
                        "recommended_fix": f"Correct the rows found by: {facts.get('Rule')}",
                        "governance_note": f"Record the correction of {table}",
                    }
                )
            )
        return out

    return answer
