"""Licence scans: known sentences become identifiers, whose order is matched by licence rules."""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import literal

# Normalised sentences of licence notices and texts, and their identifiers.
SENTENCES: dict[str, str] = {
    "licensed under the apache license version 2 0": "apache-2",
    "licensed under the apache license version 2 0 the license": "apache-2",
    "this work is licensed under the apache license version 2 0": "apache-2",
    "you may not use this file except in compliance with the license": "apache-comply",
    "you may obtain a copy of the license at": "apache-copy",
    "see the license for the specific language governing permissions and limitations under the license": "apache-terms",
    "released under the mit license": "mit-name",
    "licensed under the mit license": "mit-name",
    "this work is licensed under the mit license": "mit-name",
    "mit license": "mit-name",
    "permission is hereby granted free of charge to any person obtaining a copy of this software and associated "
    "documentation files the software to deal in the software without restriction including without limitation the "
    "rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit "
    "persons to whom the software is furnished to do so subject to the following conditions": "mit-grant",
    "the above copyright notice and this permission notice shall be included in all copies or substantial portions of "
    "the software": "mit-notice",
    "redistribution and use in source and binary forms with or without modification are permitted provided that the "
    "following conditions are met": "bsd-grant",
    "redistributions of source code must retain the above copyright notice this list of conditions and the following "
    "disclaimer": "bsd-source",
    "redistributions in binary form must reproduce the above copyright notice this list of conditions and the following "
    "disclaimer in the documentation and or other materials provided with the distribution": "bsd-binary",
    "neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote "
    "products derived from this software without specific prior written permission": "bsd-endorse",
    "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted "
    "provided that the above copyright notice and this permission notice appear in all copies": "isc-grant",
    "this work is licensed under the gnu general public license version 2": "gpl-2",
    "licensed under the gnu general public license version 2": "gpl-2",
    "this work is licensed under the gnu general public license version 3": "gpl-3",
    "licensed under the gnu general public license version 3": "gpl-3",
    "this program is free software you can redistribute it and or modify it under the terms of the gnu general public "
    "license as published by the free software foundation either version 2 of the license or at your option any later "
    "version": "gpl-2-later",
    "this program is free software you can redistribute it and or modify it under the terms of the gnu general public "
    "license as published by the free software foundation either version 3 of the license or at your option any later "
    "version": "gpl-3-later",
    "this source code form is subject to the terms of the mozilla public license v 2 0": "mpl-2",
    "licensed under cc by 4 0": "cc-by-4",
    "licensed under cc by sa 4 0": "cc-by-sa-4",
    "licensed under cc by nc 4 0": "cc-by-nc-4",
    "licensed under cc by nd 4 0": "cc-by-nd-4",
    "licensed under cc by nc sa 4 0": "cc-by-nc-sa-4",
    "licensed under cc by nc nd 4 0": "cc-by-nc-nd-4",
    "licensed under cc0 1 0": "cc0-1",
}

# Licences and the identifiers they need in this order; the first rule that fits names the licence.
RULES: tuple[tuple[str, tuple[str, ...]], ...] = (
    ("GPL-3.0-or-later", ("gpl-3-later",)),
    ("GPL-2.0-or-later", ("gpl-2-later",)),
    ("GPL-3.0", ("gpl-3",)),
    ("GPL-2.0", ("gpl-2",)),
    ("MPL-2.0", ("mpl-2",)),
    ("CC-BY-NC-SA-4.0", ("cc-by-nc-sa-4",)),
    ("CC-BY-NC-ND-4.0", ("cc-by-nc-nd-4",)),
    ("CC-BY-NC-4.0", ("cc-by-nc-4",)),
    ("CC-BY-ND-4.0", ("cc-by-nd-4",)),
    ("CC-BY-SA-4.0", ("cc-by-sa-4",)),
    ("CC-BY-4.0", ("cc-by-4",)),
    ("BSD-3-Clause", ("bsd-grant", "bsd-source", "bsd-binary", "bsd-endorse")),
    ("BSD-2-Clause", ("bsd-grant", "bsd-source", "bsd-binary")),
    ("Apache-2.0", ("apache-2", "apache-comply", "apache-terms")),
    ("Apache-2.0", ("apache-2",)),
    ("MIT", ("mit-grant", "mit-notice")),
    ("MIT", ("mit-name",)),
    ("ISC", ("isc-grant",)),
    ("CC0-1.0", ("cc0-1",)),
)

#: Every known sentence holds one of these, so a text without them has no known sentence.
KEYWORDS = "licen[sc]ed?|cc0|permission|redistribution"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def _in_order(identifiers: Sequence[str]) -> str:
    """A pattern for ``|a|b|c|`` that finds the identifiers in this order, others between."""
    return "".join(rf"\|{name}\|" if k == 0 else rf"(.*\|)?{name}\|" for k, name in enumerate(identifiers))


def _wrapped(sentences: Sequence[str]) -> str:
    """A pattern for whole known sentences between line ends, with line ends inside; longer ones first."""
    each = ("[ \\n]".join(re.escape(word) for word in s.split(" ")) for s in sorted(sentences, key=len, reverse=True))
    return rf"(?<![^\n])(?:{'|'.join(each)})(?![^\n])"


def scan_licences(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    sentences: dict[str, str] = SENTENCES,
    rules: Sequence[tuple[str, Sequence[str]]] = RULES,
    keywords: str = KEYWORDS,
) -> DataFrame:
    """One row per row of ``docs``: id, ``identifiers``, ``licence``.

    A line that goes on in lower case is joined to the next. Sentences end at a line's end
    or at punctuation before white space; in normal form they keep a-z and 0-9 in lower
    case, with single spaces. A known sentence begins and ends where a sentence does, and
    may go on over line ends, comment marks and punctuation. ``identifiers`` lists, divided
    by bars, those of the known sentences in the order of the text; ``licence`` is that of
    the first rule whose identifiers occur in its order, else null. A further column tells
    nothing of a text without known sentences: its ``identifiers`` are empty.

    All of it is one projection by built-in functions, without any shuffle; texts of any
    length are scanned whole. A null or empty text has no sentences. Null ids and repeated
    rows get a row each. Other columns are ignored.
    """
    body = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(F.col(id_col).alias("id"), body.alias("body"))
    known = F.expr(f"map({', '.join(f'{literal(k)}, {literal(v)}' for k, v in sentences.items())})")
    joined = F.regexp_replace("body", r"([a-z,])\r?\n[ \t]*([a-z])", "$1 $2")
    ended = F.regexp_replace(joined, r"[.!?;:]+(\s|\z)", "\n")
    lower = F.translate(ended, _UPPER, _LOWER)
    # Line ends stay, everything else between words becomes one space.
    plain = F.regexp_replace(F.regexp_replace(lower, r"[^a-z0-9\n]+", " "), r" ?\n[ \n]*", "\n")
    parts = F.regexp_extract_all(F.trim(plain), F.lit(_wrapped(list(sentences))), F.lit(0))
    named = F.transform(parts, lambda s: F.try_element_at(known, F.translate(s, "\n", " ")))
    found = F.when(F.lower("body").rlike(keywords), named).otherwise(F.array().cast("array<string>"))
    marked = rows.select("id", F.concat(F.lit("|"), F.array_join(found, "|"), F.lit("|")).alias("line"))
    licence = F.lit(None).cast("string")
    for name, identifiers in reversed(rules):
        licence = F.when(F.col("line").rlike(_in_order(identifiers)), name).otherwise(licence)
    identifiers = F.expr("trim(BOTH '|' FROM line)").alias("identifiers")
    return marked.select(F.col("id").alias(id_col), identifiers, licence.alias("licence"))


def scan_sql() -> str:
    """The scan of ``documents`` as DuckDB SQL."""
    keys = ", ".join(f"'{k}'" for k in SENTENCES)
    values = ", ".join(f"'{v}'" for v in SENTENCES.values())
    cases = " ".join(f"WHEN regexp_matches(line, '{_in_order(ids)}') THEN '{name}'" for name, ids in RULES)
    return f"""
WITH known AS (SELECT MAP([{keys}], [{values}]) AS m),
joined AS (
  SELECT doc_id, regexp_replace(coalesce(text, ''), '([a-z,])\\r?\\n[ \\t]*([a-z])', '\\1 \\2', 'g') AS body
  FROM documents),
plain AS (
  SELECT doc_id, string_split(regexp_replace(translate(
    regexp_replace(body, '[.!?;:]+(\\s|\\z)', chr(10), 'g'), '{_UPPER}', '{_LOWER}'), '[^a-z0-9\\n]+', ' ', 'g'), chr(10)) AS parts
  FROM joined),
named AS (
  SELECT doc_id, array_to_string([m[trim(s)] FOR s IN parts IF m[trim(s)] IS NOT NULL], '|') AS identifiers
  FROM plain, known),
marked AS (SELECT *, '|' || identifiers || '|' AS line FROM named)
SELECT doc_id, identifiers, CASE {cases} END AS licence FROM marked"""
