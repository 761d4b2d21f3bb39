"""Ready-made kinds of rules, so that common checks need no SQL.

The reference checks attach facts about the code to each row (no code, number of valid and
of invalid matches) through a join that keeps one row per row. Only flagged rows are then
repeated, as often as the plain left join would have repeated them.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame

from ..functions.lookup import lookup_join
from ..functions.text import literal, quoted
from .rules import Rule, Tables, actual_names


def status_measure(
    id: str, table: str, status: str, value: str, measure: str, detail: str, **rule
) -> Rule:
    """Rows in a closed status that still carry a positive measure.

    ``detail`` is the text in front of the measure.
    """
    m, s = quoted(measure), quoted(status)
    rule.setdefault("payload", (status, measure))
    return Rule(
        id=id,
        table=table,
        where=f"upper({s}) = {literal(value.upper())} AND coalesce({m}, 0) > 0",
        detail=f"concat({literal(detail)}, coalesce(cast({m} AS string), 'NULL'))",
        **rule,
    )


def retention_cutoff(
    id: str, table: str, created: str, cutoff: str, before: str, after: str, deleted: str | None = None, **rule
) -> Rule:
    """Rows older than the cutoff that are still present.

    A missing date is not flagged; a missing deletion flag counts as present. The date
    comparison is left bare so that it reaches the file scan.
    """
    d = quoted(created)
    alive = "" if deleted is None else f" AND NOT coalesce({quoted(deleted)}, false)"
    rule.setdefault("payload", (created,))
    return Rule(
        id=id,
        table=table,
        where=f"{d} < date {literal(cutoff)}{alive}",
        detail=f"concat({literal(before)}, date_format({d}, 'yyyy-MM-dd'), {literal(after)})",
        **rule,
    )

BLOCK = "65536L"


@dataclass(frozen=True)
class Reference:
    """A code column and the table it must point into.

    A code is valid when a reference row with that code has a non-null ``id``.
    """

    code: str
    table: str
    key: str
    id: str
    invalid: str


def any_reference_violations(
    df: DataFrame,
    refs: Sequence[Reference],
    tables: Tables,
    missing: str,
    keep: Sequence[str],
    deleted: str | None = None,
    repeat: bool = True,
) -> DataFrame:
    """Rows without any code, or with a code that is not valid.

    The text names the first invalid code in the order of ``refs``. ``repeat=False`` gives
    one row per flagged row even if a reference holds a code several times.
    """
    codes = [quoted(ref.code) for ref in refs]
    kept = [quoted(c) for c in actual_names(df, [*keep, *[ref.code for ref in refs]])]
    rows = df if deleted is None else df.where(f"NOT coalesce({quoted(deleted)}, false)")
    rows = rows.selectExpr(*kept)
    for i, ref in enumerate(refs):
        lookup = tables(ref.table).selectExpr(f"{quoted(ref.key)} AS _ref_key", f"{quoted(ref.id)} AS _ref_id")
        counts = {f"_valid{i}": "count(_ref_id)", f"_null_ids{i}": "count_if(_ref_id IS NULL)"}
        rows = lookup_join(rows, lookup, {ref.code: "_ref_key"}, counts)

    # A code is bad if it has no match, or a match without an id; with one row per flagged
    # row, matches without an id only count if there is no other.
    none = " AND ".join(f"{code} IS NULL" for code in codes)
    bad_match = "_null_ids{i} > 0" if repeat else "_valid{i} = 0"
    bad = [
        f"({code} IS NOT NULL AND (_valid{i} IS NULL OR {bad_match.format(i=i)}))" for i, code in enumerate(codes)
    ]
    flagged = rows.where(" OR ".join([f"({none})", *bad]))

    if not repeat:
        details = [f"WHEN {test} THEN {_invalid_text(ref)}" for test, ref in zip(bad, refs)]
        return flagged.selectExpr(*kept, f"CASE {' '.join(details)} ELSE {literal(missing)} END AS ISSUE_DETAIL")

    # Rows that the left join would have had: with a valid match, and with a bad one.
    ok_rows = [f"if({code} IS NULL, 1L, coalesce(_valid{i}, 0L))" for i, code in enumerate(codes)]
    bad_rows = [f"if({code} IS NULL, 0L, coalesce(_null_ids{i}, 1L))" for i, code in enumerate(codes)]
    outcomes = [(literal(missing), f"if({none}, 1L, 0L)")]
    for i, ref in enumerate(refs):
        # Its code is the first bad one: those before are valid, those after are either.
        later = [f"({ok_rows[j]} + {bad_rows[j]})" for j in range(i + 1, len(refs))]
        outcomes.append((_invalid_text(ref), " * ".join([*ok_rows[:i], bad_rows[i], *later])))
    listed = ", ".join(f"struct({detail} AS ISSUE_DETAIL, {copies} AS _copies)" for detail, copies in outcomes)
    found = flagged.selectExpr(*kept, f"inline(array({listed}))").where("_copies > 0")
    # Copies come in blocks, so that no row ever needs an array as long as a hot code.
    blocks = found.selectExpr("*", f"explode(sequence(0L, (_copies - 1) div {BLOCK})) AS _block")
    copy = f"explode(sequence(1L, least({BLOCK}, _copies - _block * {BLOCK}))) AS _copy"
    return blocks.selectExpr(*kept, "ISSUE_DETAIL", copy).drop("_copy")


def _invalid_text(ref: Reference) -> str:
    return f"concat({literal(ref.invalid)}, CAST({quoted(ref.code)} AS STRING))"


def any_valid_reference(
    id: str,
    table: str,
    refs: Sequence[Reference],
    missing: str,
    deleted: str | None = None,
    repeat: bool = True,
    **rule,
) -> Rule:
    """At least one of several codes must be set, and every code that is set must be valid."""
    keep = tuple(dict.fromkeys((*rule.get("primary_key", ()), *rule.get("payload", ()))))

    def violations(tables: Tables) -> DataFrame:
        return any_reference_violations(tables(table), refs, tables, missing, keep, deleted, repeat)

    return Rule(id=id, table=table, violations=violations, **rule)


def required_reference(
    id: str,
    table: str,
    ref: Reference,
    missing: str,
    deleted: str | None = None,
    repeat: bool = True,
    **rule,
) -> Rule:
    """One code must be set and valid."""
    return any_valid_reference(id, table, [ref], missing, deleted, repeat, **rule)
