"""Fill-in-the-middle transformation: whole units move, cut at ranks of a wavelet matrix."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .wavelet import WaveletMatrix
from .words import SLICE_BYTES, text_buffers

SEED = 42
PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"

# Classes of bytes. All white space is one byte long in UTF-8, so cuts found on bytes are
# cuts between code points.
WORD, BLANK, BREAK, INNER = 0, 1, 2, 3
START = 3
_CLASS = np.zeros(256, dtype=np.uint8)
_CLASS[[0x20, 9, 11, 12, 13]] = BLANK
_CLASS[10] = BREAK
_CLASS[0x80:0xC0] = INNER
_BEFORE = np.array([WORD, BLANK, BREAK, WORD], dtype=np.uint8)

#: Pairs (class of a byte, class of the byte before) between which a unit ends.
UNITS = {
    "words": ((BLANK, WORD), (BREAK, WORD)),
    "lines": ((WORD, BREAK), (BLANK, BREAK), (BREAK, BREAK)),
}


@dataclass(frozen=True)
class Mix:
    """How often a text is changed, and how often then the suffix comes first (percent)."""

    changed: int = 50
    suffix_first: int = 80


class Boundaries:
    """The units of the texts ``data[bounds[i]:bounds[i + 1]]``, by rank queries.

    Each byte's symbol is its class and the class of the byte before, which is ``START`` at
    the beginning of a text. The number of unit ends before a position is then the sum of
    the ranks of a few symbols, and the number of code points is the number of bytes without
    the rank of the inner bytes, a rank of the upper two bits. Nothing but the matrix is kept.
    """

    def __init__(self, data: np.ndarray, bounds: np.ndarray, unit: str) -> None:
        own = _CLASS[data]
        before = np.empty_like(own)
        before[1:] = _BEFORE[own[:-1]]
        starts = bounds[:-1]
        before[starts[starts < len(data)]] = START
        self.matrix = WaveletMatrix(own << 2 | before, 4)
        self.symbols = [a << 2 | b for a, b in UNITS[unit]]
        self.starts, self.ends = starts, bounds[1:]
        self.ended = self.count(self.starts)
        self.units = self.count(self.ends) - self.ended + (self.ends > self.starts)

    def count(self, at: np.ndarray) -> np.ndarray:
        """Unit ends strictly inside the first ``at`` bytes; a text's own end is none."""
        return sum(self.matrix.rank(symbol, at) for symbol in self.symbols)

    def code_points(self, low: np.ndarray, high: np.ndarray) -> np.ndarray:
        inner = self.matrix.rank(INNER, high, 2) - self.matrix.rank(INNER, low, 2)
        return high - low - inner

    def after(self, units: np.ndarray) -> np.ndarray:
        """Where the first ``units`` of each text end, by bisection on the counts."""
        low, high = self.starts.copy(), self.ends.copy()
        wanted = self.ended + units
        # The end of unit k lies before the byte at which the count reaches k.
        while (open_ := low < high).any():
            middle = (low + high) >> 1
            reached = self.count(np.minimum(middle + 1, self.ends)) >= wanted
            high = np.where(open_ & reached, middle, high)
            low = np.where(open_ & ~reached, middle + 1, low)
        found = np.where(units >= self.units, self.ends, low)
        return np.where(units <= 0, self.starts, found)


def _draw(digest: Column, k: int) -> Column:
    """The k-th group of eight hexadecimal digits as a number."""
    return F.conv(F.substring(digest, 8 * k + 1, 8), 16, 10).cast("long")


def fill_in_middle(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    unit: str = "words",
    seed: int = SEED,
    mix: Mix = Mix(),
    slice_bytes: int = SLICE_BYTES,
) -> DataFrame:
    """One row per row of ``docs``: id, ``n``, ``form``, ``output``, ``prefix_chars``, ``middle_chars``.

    ``n`` is the number of units. A unit of ``words`` is a word with the white space before
    it, or the white space at the end; one of ``lines`` is a line with its line break. The
    first four 8-digit groups h1 .. h4 of the hexadecimal sha256 of ``seed:id`` decide: the
    prefix ends after the smaller of h1 and h2 modulo n + 1, the middle after the larger.
    The text stays as it is (``plain``) if it is empty, holds a marker, or h3 % 100 is not
    below ``mix.changed``; else the suffix comes first (``spm``) if h4 % 100 is below
    ``mix.suffix_first``, or the prefix does (``psm``). Lengths are in code points, null if
    plain.

    Texts are cut in slices of about ``slice_bytes`` side by side; a longer text is a slice
    of its own. Nothing is shuffled. A null text is an empty one, a null id counts as an
    empty one in the draw, repeated rows are cut alike, other columns of ``docs`` are
    ignored, and no rows give no rows.
    """
    if unit not in UNITS:
        raise ValueError(f"unknown unit: {unit}")
    rows = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("id").cast("string"), F.lit(""))), 256)
    marked = F.col("text").contains(PREFIX) | F.col("text").contains(SUFFIX) | F.col("text").contains(MIDDLE)
    plain = (F.col("text") == "") | marked | (_draw(digest, 2) % 100 >= mix.changed)
    form = F.when(plain, "plain").when(_draw(digest, 3) % 100 < mix.suffix_first, "spm").otherwise("psm")
    rows = rows.select("id", "text", form.alias("form"), _draw(digest, 0).alias("h1"), _draw(digest, 1).alias("h2"))
    marks = [m.encode() for m in (PREFIX, SUFFIX, MIDDLE)]

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, bounds = text_buffers(batch.column(1))
            draws = [batch.column(k).to_numpy() for k in (3, 4)]
            at = 0
            while at < batch.num_rows:
                to = int(np.searchsorted(bounds, bounds[at] + slice_bytes, side="right")) - 1
                to = min(max(to, at + 1), batch.num_rows)
                body = data[bounds[at] : bounds[to]]
                found = Boundaries(body, bounds[at : to + 1] - bounds[at], unit)
                first, second = (h[at:to] % (found.units + 1) for h in draws)
                left, right = found.after(np.minimum(first, second)), found.after(np.maximum(first, second))
                part, forms = body.tobytes(), batch.column(2).slice(at, to - at)
                outputs = []
                for form, s, a, b, e in zip(
                    forms.to_pylist(), *(x.tolist() for x in (found.starts, left, right, found.ends))
                ):
                    if form == "psm":
                        outputs.append(marks[0] + part[s:a] + marks[1] + part[b:e] + marks[2] + part[a:b])
                    elif form == "spm":
                        outputs.append(marks[1] + part[b:e] + marks[0] + part[s:a] + marks[2] + part[a:b])
                    else:
                        outputs.append(part[s:e])
                unchanged = np.array(forms.to_numpy(zero_copy_only=False) == "plain", dtype=bool)
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).slice(at, to - at),
                        pa.array(found.units),
                        forms,
                        pa.array(outputs, pa.binary()).view(pa.string()),
                        pa.array(found.code_points(found.starts, left), mask=unchanged),
                        pa.array(found.code_points(left, right), mask=unchanged),
                    ],
                    names=["id", "n", "form", "output", "prefix_chars", "middle_chars"],
                )
                at = to

    kind = rows.schema["id"].dataType.simpleString()
    schema = f"id {kind}, n long, form string, output string, prefix_chars long, middle_chars long"
    return rows.mapInArrow(cut, schema).withColumnRenamed("id", id_col)


def restored(output: Column | str = "output", form: Column | str = "form") -> Column:
    """The text that ``output`` of this ``form`` was made from.

    A changed text held no marker, so its output holds the three of them only, each once:
    no marker can arise where pieces meet, for a marker has neither its first character
    later nor its last character earlier.
    """
    output, form = (F.col(c) if isinstance(c, str) else c for c in (output, form))
    parts = F.split(output, "<[PSM]>")
    prefix, middle, suffix = F.when(form == "psm", parts[1]).otherwise(parts[2]), parts[3], F.when(form == "psm", parts[2]).otherwise(parts[1])
    return F.when(form == "plain", output).otherwise(F.concat(prefix, middle, suffix))
