"""SQL expressions that render values and read free text.

Expressions are built as SQL text rather than as column objects: wide tables need hundreds
of them, and handing Spark one text is far cheaper than one call per node. All of them use
built-in functions only, so they stay inside whole-stage codegen.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import types as T

NESTED = (T.ArrayType, T.MapType, T.StructType, T.VariantType)

# The fence that answers come in.
FENCE_MARK = "```"
FENCE = r"(?isU)```(?:json)?\s*(.*?)\s*```"

# The characters that count as white space at the ends of a text.
WHITE_SPACE = (
    "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007"
    "\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"
)


def quoted(name: str) -> str:
    """Backtick-quote one identifier, so odd column names stay safe."""
    return "`" + name.replace("`", "``") + "`"


def literal(value: str | None) -> str:
    """A text as a SQL literal."""
    if value is None:
        return "NULL"
    return "'" + value.replace("\\", "\\\\").replace("'", "\\'") + "'"


def percent_text(rate: str) -> str:
    """``0.45`` as ``45.0%``; ``bround`` keeps the half-even rounding of the report texts."""
    return f"format_string('%.1f%%', bround({rate} * 100, 1))"


def value_text(df: DataFrame, name: str) -> str:
    """A key value as text: nulls print ``None``, booleans ``True`` / ``False``."""
    col = quoted(name)
    kind = df.schema[name].dataType
    if isinstance(kind, T.BooleanType):
        return f"CASE WHEN {col} THEN 'True' WHEN NOT {col} THEN 'False' ELSE 'None' END"
    if isinstance(kind, NESTED):
        return f"coalesce(to_json({col}), 'None')"
    return f"coalesce(CAST({col} AS STRING), 'None')"


def joined_values(df: DataFrame, names: Sequence[str]) -> str:
    """``v | v`` over the named columns."""
    return f"concat_ws(' | ', {', '.join(value_text(df, name) for name in names)})"


def named_values(df: DataFrame, names: Sequence[str]) -> str:
    """``k=v | k=v`` over the named columns."""
    parts = [f"concat({literal(name + '=')}, {value_text(df, name)})" for name in names]
    return f"concat_ws(' | ', {', '.join(parts)})"


def payload_map(df: DataFrame, names: Sequence[str]) -> str:
    """The named columns as one ``map<string,string>``, null values kept."""
    if not names:
        return "CAST(NULL AS MAP<STRING, STRING>)"
    parts = []
    for name in names:
        nested = isinstance(df.schema[name].dataType, NESTED)
        text = f"to_json({quoted(name)})" if nested else f"CAST({quoted(name)} AS STRING)"
        parts.append(f"{literal(name)}, {text}")
    return f"map({', '.join(parts)})"


def row_fingerprint(df: DataFrame) -> str:
    """Identifier for rows without a key: a digest of the whole row.

    A row position would not survive repartitioning or a task retry.
    """
    return f"sha2(to_json(struct({', '.join(quoted(c) for c in df.columns)})), 256)"


def per_value(column: str, texts: Mapping[str, str], default: str) -> str:
    """A text chosen by the value of a column, from a constant map."""
    if not texts:
        return literal(default)
    entries = ", ".join(f"{literal(k)}, {literal(v)}" for k, v in texts.items())
    return f"coalesce(try_element_at(map({entries}), {column}), {literal(default)})"


def stripped(text: str) -> str:
    """Remove leading and trailing white space, Unicode spaces included."""
    return f"trim(BOTH {literal(WHITE_SPACE)} FROM {text})"


def json_text(df: DataFrame, raw: str, name: str) -> DataFrame:
    """Add the JSON object inside a free-form answer as column ``name``.

    Takes the first fenced block if there is one, then the span from the first opening to
    the last closing brace; text without such a span is returned as it is.
    """
    fence, mark = literal(FENCE), literal(FENCE_MARK)
    fenced = f"contains({raw}, {mark}) AND regexp_like({raw}, {fence})"
    body = stripped(f"IF({fenced}, regexp_extract({raw}, {fence}, 1), {raw})")
    kept = [quoted(c) for c in df.columns]
    span = "substring(_body, _first, _last - _first + 1)"
    return (
        df.selectExpr(*kept, f"{body} AS _body")
        .selectExpr(
            "*",
            "instr(_body, '{') AS _first",
            "IF(contains(_body, '}'), length(_body) - instr(reverse(_body), '}') + 1, 0) AS _last",
        )
        .selectExpr(*kept, f"IF(_first > 0 AND _last > _first, {span}, _body) AS {quoted(name)}")
    )
