"""Chat formatting: turns as marked text with a loss mask, assembled column by column."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.staging import Stage
from .words import SLICE_BYTES, text_buffers

ESCAPE = ord("\\")
#: Characters of a role or text by which rows with equal turns are dealt to tasks.
DEAL_CHARS = 64
#: Bytes copied by one set of scatter indices, and pieces that are copied by themselves.
WINDOW = 1 << 18
LONG_PIECE = 1 << 12


@dataclass(frozen=True)
class Template:
    """A turn is ``start``, the role, ``says``, the text, ``end``; these are the control strings.

    Inside roles and texts a control string gets a backslash before it, and backslashes that
    stand right before a control string or the end of a content are doubled. So a control
    string with an even number of backslashes before it is a mark, and everything else is
    content. For that no control string may hold a backslash, or its own or another one's
    beginning or end at any other place.
    """

    start: str = "<turn>"
    says: str = "<says>"
    end: str = "</turn>"
    learned: str = "assistant"

    def __post_init__(self) -> None:
        controls = self.controls()
        for a in controls:
            if not a or "\\" in a:
                raise ValueError(f"a control string is empty or holds a backslash: {a!r}")
            for b in controls:
                inside = a != b and a in b
                if inside or any(a[-k:] == b[:k] for k in range(1, min(len(a), len(b)))):
                    raise ValueError(f"control strings overlap: {a!r} and {b!r}")
        if len(set(controls)) < 3:
            raise ValueError("control strings are not distinct")

    def controls(self) -> tuple[str, str, str]:
        return self.start, self.says, self.end


def occurrences(data: np.ndarray, controls: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Where control strings begin in ``data``, in order, and how long each is."""
    found, sizes = [], []
    for control in controls:
        at = np.flatnonzero(data[: max(len(data) - len(control) + 1, 0)] == control[0])
        for k in range(1, len(control)):
            at = at[data[at + k] == control[k]]
        found.append(at)
        sizes.append(np.full(len(at), len(control)))
    at, size = np.concatenate(found), np.concatenate(sizes)
    order = np.argsort(at)
    return at[order], size[order]


def slashes_before(data: np.ndarray, at: np.ndarray, first: np.ndarray) -> np.ndarray:
    """How many backslashes end at each of the positions ``at``, back to ``first`` at most."""
    touched = (at > first) & (data[np.maximum(at - 1, 0)] == ESCAPE) if len(data) else np.zeros(len(at), bool)
    count = np.zeros(len(at), dtype=np.int64)
    if touched.any():
        other = np.flatnonzero(data != ESCAPE)
        last = np.searchsorted(other, at[touched]) - 1
        last = np.where(last >= 0, other[last] if len(other) else -1, -1)
        count[touched] = at[touched] - 1 - np.maximum(last, first[touched] - 1)
    return count


class Contents:
    """One column of contents: its bytes, and what escaping inserts into them."""

    def __init__(self, data: np.ndarray, bounds: np.ndarray, controls: list[bytes]) -> None:
        self.data, self.bounds = data, bounds
        at, size = occurrences(data, controls)
        # Contents lie side by side, so a control string may seem to begin in one and end in the next.
        owner = np.searchsorted(bounds, at, side="right") - 1
        inside = at + size <= bounds[owner + 1] if len(at) else np.zeros(0, bool)
        at, owner = at[inside], owner[inside]
        inserts = slashes_before(data, at, bounds[owner]) + 1
        self.at, self.before = at, np.concatenate(([0], np.cumsum(inserts)))
        self.lengths = np.diff(bounds) + slashes_before(data, bounds[1:], bounds[:-1])
        np.add.at(self.lengths, owner, inserts)

    def scatter(self, out: np.ndarray, places: np.ndarray) -> None:
        """Copy every content to its place; what is inserted is there already.

        A content is cut where something is inserted. Short pieces are copied together by
        scatter indices, ``WINDOW`` bytes at a time; a long one by itself.
        """
        starts = np.unique(np.concatenate((self.bounds[:-1], self.at)))
        ends = np.append(starts[1:], self.bounds[-1])
        starts, ends = starts[ends > starts], ends[ends > starts]
        owner = np.searchsorted(self.bounds, starts, side="right") - 1
        first = self.bounds[owner]
        passed = self.before[np.searchsorted(self.at, starts, side="right")]
        passed = passed - self.before[np.searchsorted(self.at, first, side="left")]
        shift = places[owner] + passed - first
        long = ends - starts >= LONG_PIECE
        for s, e, by in zip(*(x[long].tolist() for x in (starts, ends, shift))):
            out[s + by : e + by] = self.data[s:e]
        starts, shift, sizes = starts[~long], shift[~long], (ends - starts)[~long]
        total = np.concatenate(([0], np.cumsum(sizes)))
        lo = 0
        while lo < len(starts):
            hi = max(int(np.searchsorted(total, total[lo] + WINDOW, side="right")) - 1, lo + 1)
            within = np.arange(total[hi] - total[lo]) - np.repeat(total[lo:hi] - total[lo], sizes[lo:hi])
            source = within + np.repeat(starts[lo:hi], sizes[lo:hi])
            out[source + np.repeat(shift[lo:hi], sizes[lo:hi])] = self.data[source]
            lo = hi


def assembled(
    roles: Contents, texts: Contents, marks: list[bytes], runs: np.ndarray, learned: np.ndarray
) -> tuple[pa.Array, pa.Array]:
    """Texts of the runs of rows that begin at ``runs``, and their loss spans.

    Every row is five segments. Their lengths and running sums give each segment's place in
    one buffer, allocated once and filled with backslashes, into which marks and contents
    are scattered. Spans are the escaped texts of the ``learned`` rows, in code points of
    their run.
    """
    n = len(roles.lengths)
    lengths = np.empty((n, 5), dtype=np.int64)
    lengths[:, [0, 2, 4]] = [len(m) for m in marks]
    lengths[:, 1], lengths[:, 3] = roles.lengths, texts.lengths
    ends = np.cumsum(lengths.ravel())
    total = int(ends[-1]) if n else 0
    places = (ends - lengths.ravel()).reshape(n, 5)
    out = np.full(total, ESCAPE, dtype=np.uint8)
    for k, mark in zip((0, 2, 4), marks):
        out[(places[:, k, None] + np.arange(len(mark))).ravel()] = np.tile(np.frombuffer(mark, np.uint8), n)
    roles.scatter(out, places[:, 1])
    texts.scatter(out, places[:, 3])
    offsets = np.append(places[runs, 0], total)
    column = pa.Array.from_buffers(
        pa.string(), len(runs), [None, pa.py_buffer(offsets.astype(np.int32)), pa.py_buffer(out)]
    )
    # Code points before a byte: bytes that are not inner ones, summed up between the few edges.
    rows = np.flatnonzero(learned)
    edges = np.unique(np.concatenate(([0], offsets, places[rows, 3], places[rows, 4])))
    outer = (out & 0xC0) != 0x80
    between = np.add.reduceat(outer, edges[:-1], dtype=np.int64) if total else np.zeros(0, np.int64)
    before = np.concatenate(([0], np.cumsum(between)))
    owner = np.searchsorted(runs, rows, side="right") - 1
    base = before[np.searchsorted(edges, offsets[owner])]
    spans = [before[np.searchsorted(edges, places[rows, k])] - base for k in (3, 4)]
    per_run = np.bincount(owner, minlength=len(runs)) if len(runs) else np.zeros(0, np.int64)
    structs = pa.StructArray.from_arrays([pa.array(s, pa.int64()) for s in spans], names=["start", "end"])
    lists = pa.ListArray.from_arrays(np.concatenate(([0], np.cumsum(per_run))).astype(np.int32), structs)
    return column, lists


def format_chats(
    turns: DataFrame,
    conv_col: str = "conv_id",
    turn_col: str = "turn",
    role_col: str = "role",
    text_col: str = "text",
    template: Template = Template(),
    slice_bytes: int = SLICE_BYTES,
) -> DataFrame:
    """Rows conv_id, ``part``, ``formatted``, ``loss``, ``n_turns``, ``whole``: conversations in parts.

    The parts of a conversation, in order, joined without anything between, are its text.
    A part holds whole turns, of about ``slice_bytes`` together or a single longer one.
    ``loss`` are the spans (start, end) of a part, in code points, that a model learns: the
    escaped texts of turns whose role is ``template.learned``. ``whole`` says that a part
    surely is all of its conversation; one whose neighbours are in another task or slice
    is not called so.

    Turns are dealt to tasks by ranges of (conversation, turn, role, text) and sorted
    there, so a conversation of any length is formatted by many tasks. Null ids are one
    conversation, null turns come first, null roles and texts count as empty, equal turns
    are ordered by role and text, and repeated rows are turns like others. Other columns of
    ``turns`` are ignored. No rows give no rows.

    The frame is lazy; write it before it is read more than once.
    """
    rows = turns.select(
        F.col(conv_col).alias("conv"),
        F.col(turn_col).alias("turn"),
        *[F.coalesce(F.col(c), F.lit("")).alias(name) for c, name in ((role_col, "role"), (text_col, "text"))],
    )
    head = [F.substring(c, 1, DEAL_CHARS) for c in ("role", "text")]
    dealt = rows.repartitionByRange("conv", "turn", *head).sortWithinPartitions("conv", "turn", "role", "text")
    marks = [c.encode() for c in template.controls()]
    learned = template.learned

    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        """Slices of rows as (ids, roles, texts, conversations' first rows)."""
        for batch in batches:
            ids, role, text = batch.column(0), batch.column(2), batch.column(3)
            _, bounds = text_buffers(text)
            _, names = text_buffers(role)
            sizes = (bounds - bounds[0]) + (names - names[0])
            at = 0
            while at < batch.num_rows:
                to = int(np.searchsorted(sizes, sizes[at] + slice_bytes, side="right")) - 1
                to = min(max(to, at + 1), batch.num_rows)
                yield ids.slice(at, to - at), role.slice(at, to - at), text.slice(at, to - at)
                at = to

    def assemble(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId() << 33
        for ids, role, text in blocks(batches):
            n = len(ids)
            own = ids.dictionary_encode(null_encoding="encode").indices.to_numpy()
            runs = np.flatnonzero(np.concatenate(([True], own[1:] != own[:-1])))
            columns = []
            for column in (role, text):
                data, bounds = text_buffers(column)
                columns.append(Contents(data[bounds[0] : bounds[-1]], bounds - bounds[0], marks))
            learns = np.array(role.to_numpy(zero_copy_only=False) == learned, dtype=bool)
            formatted, loss = assembled(*columns, marks, runs, learns)
            # The first and the last conversation of a slice may go on beyond it.
            inner = np.ones(len(runs), dtype=bool)
            inner[[0, -1]] = False
            yield pa.RecordBatch.from_arrays(
                [
                    ids.take(pa.array(runs)),
                    pa.array(part + np.arange(len(runs))),
                    formatted,
                    loss,
                    pa.array(np.diff(np.append(runs, n)).astype(np.int64)),
                    pa.array(inner),
                ],
                names=["conv", "part", "formatted", "loss", "n_turns", "whole"],
            )
            part += len(runs)

    kind = rows.schema["conv"].dataType.simpleString()
    schema = f"conv {kind}, part long, formatted string, loss array<struct<start: long, end: long>>, n_turns long, whole boolean"
    return dealt.mapInArrow(assemble, schema).withColumnRenamed("conv", conv_col)


def _slashes(text: str, at: int) -> int:
    """Backslashes that end at ``at``."""
    count = 0
    while count < at and text[at - 1 - count] == "\\":
        count += 1
    return count


def unescaped(content: str, pattern: re.Pattern) -> str:
    """The content before escaping."""
    if "\\" not in content:
        return content
    pieces, last = [], 0
    for found in pattern.finditer(content):
        at = found.start()
        # Of 2k + 1 backslashes before a control string k were there.
        pieces.append(content[last : at - (_slashes(content, at) + 1) // 2])
        last = at
    pieces.append(content[last : len(content) - _slashes(content, len(content)) // 2])
    return "".join(pieces)


def reader(template: Template = Template()) -> Callable[[str], list[tuple[str, str]]]:
    """A function from a part's text to its turns (role, text)."""
    pattern = re.compile("|".join(re.escape(c) for c in template.controls()))
    order = template.controls()

    def read(formatted: str) -> list[tuple[str, str]]:
        marks = [m for m in pattern.finditer(formatted) if _slashes(formatted, m.start()) % 2 == 0]
        turns, at = [], 0
        for start, says, end in zip(marks[::3], marks[1::3], marks[2::3]):
            if start.start() != at or (start.group(), says.group(), end.group()) != order:
                raise ValueError(f"no turn at {at}")
            role, text = formatted[start.end() : says.start()], formatted[says.end() : end.start()]
            turns.append((unescaped(role, pattern), unescaped(text, pattern)))
            at = end.end()
        if at != len(formatted) or len(marks) % 3:
            raise ValueError(f"no turn at {at}")
        return turns

    return read


DIGESTS = "n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"


class Digest:
    """Figures of one conversation, fed with its parts in order."""

    def __init__(self) -> None:
        self.turns, self.loss = hashlib.sha256(), hashlib.sha256()
        self.n_turns = self.loss_chars = self.formatted_chars = 0

    def add(self, formatted: str, spans: list[dict], read: Callable, pattern: re.Pattern) -> None:
        for role, text in read(formatted):
            self.turns.update(f"{role}\n{text}\n".encode())
            self.n_turns += 1
        for span in spans:
            learned = unescaped(formatted[span["start"] : span["end"]], pattern)
            self.loss.update(learned.encode())
            self.loss_chars += len(learned)
        self.formatted_chars += len(formatted)

    def row(self) -> tuple:
        return self.n_turns, self.turns.hexdigest(), self.loss_chars, self.loss.hexdigest(), self.formatted_chars


def digest_chats(
    chats: DataFrame, conv_col: str = "conv_id", template: Template = Template(), stage: Stage | None = None
) -> DataFrame:
    """One row per conversation: id and ``DIGESTS``, read back from the formatted parts.

    Parts that are whole conversations are read where they lie, and only their figures are
    stored. Those of the others are dealt by conversation, sorted, and read one after the
    other; only the state of two hashes is held, so a conversation may be of any length. A
    digest of a whole conversation can only be made in order, by one task for each.
    """
    stage = stage or Stage(chats.sparkSession)
    parts = chats.select(F.col(conv_col).alias("conv"), "part", "formatted", "loss", "whole")
    pattern = re.compile("|".join(re.escape(c) for c in template.controls()))
    kind = parts.schema["conv"].dataType.simpleString()
    spans = parts.schema["loss"].dataType.simpleString()
    names = [field.split()[0] for field in DIGESTS.split(", ")]
    types = (pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64())

    def figures(rows: list[tuple | None]) -> list[pa.Array]:
        return [pa.array([None if r is None else r[k] for r in rows], t) for k, t in enumerate(types)]

    def alone(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        read = reader(template)
        for batch in batches:
            rows, whole = [], batch.column(4).to_pylist()
            for i, complete in enumerate(whole):
                rows.append(None)
                if complete:
                    state = Digest()
                    state.add(batch.column(2)[i].as_py(), batch.column(3)[i].as_py(), read, pattern)
                    rows[i] = state.row()
            left = pa.array([not complete for complete in whole], pa.bool_())
            kept = [pc.if_else(left, batch.column(k), pa.scalar(None, batch.column(k).type)) for k in (2, 3)]
            columns = [batch.column(0), batch.column(1), *kept, *figures(rows)]
            yield pa.RecordBatch.from_arrays(columns, names=["conv", "part", "formatted", "loss", *names])

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        read, current, state = reader(template), None, None
        for batch in batches:
            ids, rows = [], []
            for i in range(batch.num_rows):
                conv = batch.column(0)[i].as_py()
                if state is None or conv != current:
                    if state is not None:
                        ids.append(current)
                        rows.append(state.row())
                    current, state = conv, Digest()
                state.add(batch.column(1)[i].as_py(), batch.column(2)[i].as_py(), read, pattern)
            of = batch.schema.field(0).type
            yield pa.RecordBatch.from_arrays([pa.array(ids, of), *figures(rows)], names=["conv", *names])
        if state is not None:
            yield pa.RecordBatch.from_arrays([pa.array([current], of), *figures([state.row()])], names=["conv", *names])

    read = parts.mapInArrow(alone, f"conv {kind}, part long, formatted string, loss {spans}, {DIGESTS}")
    read = stage.read(read.schema, stage.write(read, "chats"))
    done = read.where("formatted IS NULL").select("conv", *names)
    left = read.where("formatted IS NOT NULL").select("conv", "formatted", "loss", "part")
    left = left.repartition("conv").sortWithinPartitions("conv", "part")
    return done.union(left.mapInArrow(fold, f"conv {kind}, {DIGESTS}")).withColumnRenamed("conv", conv_col)
