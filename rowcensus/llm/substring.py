"""Substring deduplication: recurring passages found by sketch, confirmed, located by automata."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.staging import Stage
from .joins import BROADCAST_ROWS, keep_matching
from .words import Slice, find_words, run_hash, slices, span_hash, text_buffers

WINDOW = 20
GRAM = 6
SHARD_PIECES = 10_000
PHRASES = 30_000
LAST_ID = (1 << 63) - 1
WHOLE = (1 << 31) - 1


def sliding_minimum(values: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Minimum of ``values[i : i + width]`` and its position, the rightmost of equal ones."""
    at = np.arange(len(values))
    span = 1

    def join(v: np.ndarray, p: np.ndarray, step: int) -> tuple[np.ndarray, np.ndarray]:
        right = v[step:] <= v[:-step]
        return np.where(right, v[step:], v[:-step]), np.where(right, p[step:], p[:-step])

    while 2 * span <= width:
        values, at = join(values, at, span)
        span *= 2
    return join(values, at, width - span) if width > span else (values, at)


def anchors(part: Slice, window: int, gram: int) -> tuple[np.ndarray, ...]:
    """Runs of windows with one anchor: (text, anchor hash, first window, last window).

    The anchor of a window is its smallest hash of ``gram`` consecutive words, at the
    rightmost place. It depends on the window's words alone, so equal windows have equal
    anchors, and about one run in eight windows stands for all of them.
    """
    counts = part.counts()
    owner, words = part.owners(), part.hashes()
    n = len(words)
    if n < window:
        empty = np.zeros(0, dtype=np.int64)
        return empty, empty.astype(np.uint64), empty, empty
    starts = np.arange(n - gram + 1)
    grams = span_hash(words, starts, starts + gram)
    low, at = sliding_minimum(grams, window - gram + 1)
    valid = owner[: len(low)] == owner[window - 1 : window - 1 + len(low)]
    where = np.flatnonzero(valid)
    doc, anchor = owner[where], at[where]
    new = np.ones(len(where), dtype=bool)
    new[1:] = (anchor[1:] != anchor[:-1]) | (doc[1:] != doc[:-1])
    first = np.flatnonzero(new)
    last = np.append(first[1:], len(where)) - 1 if len(first) else first
    base = part.first[:-1][doc[first]]
    return doc[first], low[where][first], where[first] - base, where[last] - base


def sketch(docs: DataFrame, window: int, gram: int) -> DataFrame:
    """Rows (a, id, s, again, i, j) of docs (id, s, text): the runs of anchors of every text.

    ``again`` tells whether the anchor has several runs in its text.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch.column(2)):
                doc, a, i, j = anchors(part, window, gram)
                order = np.lexsort((a, doc))
                same = np.zeros(len(order), dtype=bool)
                same[1:] = (a[order][1:] == a[order][:-1]) & (doc[order][1:] == doc[order][:-1])
                again = np.zeros(len(order), dtype=bool)
                again[order] = same | np.append(same[1:], False)
                rows = pa.array(doc + part.row)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(a.view(np.int64)),
                        batch.column(0).take(rows),
                        batch.column(1).take(rows),
                        pa.array(again),
                        pa.array(i.astype(np.int32)),
                        pa.array(j.astype(np.int32)),
                    ],
                    names=["a", "id", "s", "again", "i", "j"],
                )

    return docs.mapInArrow(run, "a long, id long, s long, again boolean, i int, j int")


def cut_pieces(marked: DataFrame, window: int) -> DataFrame:
    """Rows (a, q1, q2, id, s, i, j, words) of marked (id, s, text, runs): the words of each run.

    ``q1`` and ``q2`` are a digest of the words of 128 bits.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, runs = batch.column(2), batch.column(3)
            for row in range(batch.num_rows):
                part = find_words(*_one_text(texts, row))
                own = runs.slice(row, 1).flatten()
                a, i, j = (own.field(k).to_numpy(zero_copy_only=False) for k in range(3))
                to = j + window
                words = [part.words(x, y) for x, y in zip(i.tolist(), to.tolist())]
                digests = b"".join([hashlib.blake2b(w, digest_size=16).digest() for w in words])
                q1, q2 = np.frombuffer(digests, dtype="<i8").reshape(-1, 2).T
                places = pa.array(np.full(len(a), row))
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(a),
                        pa.array(np.ascontiguousarray(q1)),
                        pa.array(np.ascontiguousarray(q2)),
                        batch.column(0).take(places),
                        batch.column(1).take(places),
                        pa.array(i),
                        pa.array(j),
                        pa.array(words, pa.binary()),
                    ],
                    names=["a", "q1", "q2", "id", "s", "i", "j", "words"],
                )

    return marked.mapInArrow(run, "a long, q1 long, q2 long, id long, s long, i int, j int, words binary")


def _one_text(texts: pa.Array, row: int) -> tuple[np.ndarray, np.ndarray]:
    data, bounds = text_buffers(texts.slice(row, 1))
    return data[bounds[0] : bounds[1]], bounds - bounds[0]


def window_hashes(pieces: DataFrame, window: int) -> DataFrame:
    """Rows (w1, w2, id, pos, i, a, s): every window of the pieces (a, id, s, i, words)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch.column(4).cast(pa.string())):
                counts = part.counts() - window + 1
                piece = np.repeat(np.arange(len(part)), counts)
                offset = np.arange(len(piece)) - np.repeat(np.cumsum(counts) - counts, counts)
                starts = part.first[:-1][piece] + offset
                w1, w2 = (run_hash(part.hashes(seed), starts, window, seed) for seed in (0, 1))
                rows = pa.array(piece + part.row)
                a, doc, s, i = (batch.column(k).take(rows) for k in range(4))
                pos = i.to_numpy() + offset
                yield pa.RecordBatch.from_arrays(
                    [pa.array(w1.view(np.int64)), pa.array(w2.view(np.int64)), doc, pa.array(pos.astype(np.int32)), i, a, s],
                    names=["w1", "w2", "id", "pos", "i", "a", "s"],
                )

    return pieces.mapInArrow(run, "w1 long, w2 long, id long, pos int, i int, a long, s long")


def locate(phrases: pd.DataFrame, pieces: pd.DataFrame, window: int) -> pd.DataFrame:
    """Word ranges (id, s, lo, hi) of ``pieces`` covered by a phrase that starts earlier.

    The words of the phrases become letters, the phrases (``window`` words each, with the
    place where they first start) an Aho-Corasick automaton, and all pieces run through it.
    There is one automaton per ``PHRASES`` rows, for which there are letters enough.
    """
    found: list[tuple[int, int, int, int]] = []
    for at in range(0, len(phrases), PHRASES):
        some = phrases.iloc[at : at + PHRASES]
        letters: dict[str, str] = {}
        automaton = ahocorasick.Automaton()
        for words, i, offsets, doc in zip(some["words"], some["i"], some["offsets"], some["id"]):
            text = "".join([_letter(letters, w) for w in words.decode().split(" ")])
            for offset in offsets:
                automaton.add_word(text[offset : offset + window], (doc, i + int(offset)))
        automaton.make_automaton()
        known = letters.get
        for words, i, doc, s in zip(pieces["words"], pieces["i"], pieces["id"], pieces["s"]):
            text = "".join([known(w, "\0") for w in words.decode().split(" ")])
            lo = hi = -1
            for end, first in automaton.iter(text):
                pos = i + end - window + 1
                if first >= (doc, pos):
                    continue
                if pos > hi:
                    if hi > 0:
                        found.append((doc, s, lo, hi))
                    lo = pos
                hi = pos + window
            if hi > 0:
                found.append((doc, s, lo, hi))
    columns = {k: pd.Series([f[n] for f in found], dtype="int64") for n, k in enumerate(("id", "s", "lo", "hi"))}
    return pd.DataFrame(columns)


def _letter(letters: dict[str, str], word: str) -> str:
    """The letter of a word; a new one gets the next code point outside the surrogates."""
    if word not in letters:
        code = len(letters) + 1
        letters[word] = chr(code if code < 0xD800 else code + 0x800)
    return letters[word]


def kept_words(rows: DataFrame, window: int) -> DataFrame:
    """Rows (id, n_words, n_removed, kept_sha256[, text]) of rows (id, text, ranges)."""
    kind = rows.schema["id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ranges = batch.column(2)
            for part in slices(batch.column(1)):
                counts = part.counts()
                keep = np.ones(len(part.starts) + 1, dtype=np.int64)
                for row in np.flatnonzero(ranges.slice(part.row, len(part)).is_valid().to_numpy(zero_copy_only=False)):
                    if counts[row] < window:
                        continue
                    own = ranges.slice(part.row + int(row), 1).flatten()
                    for lo, hi in zip(own.field(0).to_pylist(), own.field(1).to_pylist()):
                        keep[part.first[row] + lo : part.first[row] + min(hi, counts[row])] = 0
                keep = keep[:-1].astype(bool)
                texts = _joined(part, keep)
                removed = counts - np.diff(np.concatenate(([0], np.cumsum(keep)))[part.first])
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).slice(part.row, len(part)),
                        pa.array(counts.astype(np.int64)),
                        pa.array(removed.astype(np.int64)),
                        pa.array([hashlib.sha256(t).hexdigest() for t in texts], pa.string()),
                    ],
                    names=["id", "n_words", "n_removed", "kept_sha256"],
                )

    return rows.mapInArrow(run, f"id {kind}, n_words long, n_removed long, kept_sha256 string")


def _joined(part: Slice, keep: np.ndarray) -> list[bytes]:
    """The kept words of each text joined by single spaces."""
    n = len(part.data)
    edges = np.zeros(n + 1, dtype=np.int8)
    starts, ends = part.starts[keep], part.ends[keep]
    edges[starts] += 1
    edges[ends] -= 1
    mask = np.cumsum(edges[:n], dtype=np.int8).astype(bool)
    owner = part.owners()[keep]
    joints = ends[:-1][owner[1:] == owner[:-1]] if len(ends) else ends
    data = part.data.copy()
    data[joints] = 0x20
    mask[joints] = True
    at = np.concatenate(([0], np.cumsum(mask)))[part.bounds]
    body = data[mask].tobytes()
    return [body[x:y] for x, y in zip(at[:-1].tolist(), at[1:].tolist())]


def substring_dedup(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    window: int = WINDOW,
    gram: int = GRAM,
    shard_pieces: int = SHARD_PIECES,
    stage: Stage | None = None,
) -> DataFrame:
    """One row per row of ``docs``: id, ``n_words``, ``n_removed``, ``kept_sha256``.

    A word is removed if a window of ``window`` words covers it whose word sequence also
    starts earlier: in a text with a smaller id, or earlier in its own text.

    1. Each text is sketched: every window has an anchor, one of its own ``gram``-word hashes,
       and consecutive windows with one anchor are a run. Equal windows have equal anchors.
    2. Anchors that occur in two different texts, or twice in one, may mark recurring
       passages. The words of their runs are cut out as pieces. Of equal pieces all but the
       first are later occurrences as a whole; the first ones go on. Of equal texts all but
       the first are removed as a whole and take no part.
    3. Windows that occur in several pieces are confirmed as recurring; the place where each
       starts first is known by an aggregate that is combined before the shuffle.
    4. Confirmed phrases are compiled into Aho-Corasick automata, sharded by anchor. All
       pieces of a shard run through its automaton. A shard with many pieces, as of a very
       common line, is split into parts that each get the shard's phrases.
    5. Located ranges are merged with the texts.

    Texts differ if their bytes do. Ids are numbers; a null id counts as after all others.
    Rows that share id and text are one document with the same result; rows that share
    only the id are both at that place of the order. A null text has no words. Other columns
    are ignored. No rows give no rows.
    """
    spark = docs.sparkSession
    stage = stage or Stage(spark)
    body = F.coalesce(F.col(text_col), F.lit(""))
    order = F.coalesce(F.col(id_col).cast("long"), F.lit(LAST_ID))
    texts = docs.select(order.alias("id"), F.xxhash64(body).alias("s"), body.alias("text"), F.col(id_col).alias("own_id"))

    digests = texts.select("id", "s", F.unhex(F.md5("text")).alias("digest"))
    copies = digests.groupBy("digest").agg(F.min("id").alias("low"), F.max("id").alias("high")).where("low < high")
    copies = stage.read(copies.schema, stage.write(copies, "copies"))
    later = digests.join(copies.withColumnRenamed("digest", "_digest"), F.col("digest") == F.col("_digest"))
    later = later.where("id > low").select("id", "s").distinct()
    later = stage.read(later.schema, stage.write(later, "later"))

    runs = sketch(texts.select("id", "s", "text"), window, gram)
    runs = stage.read(runs.schema, stage.write(runs, "runs"))
    often = runs.groupBy("a").agg(F.min("s").alias("_low"), F.max("s").alias("_high"), F.max("again").alias("_again"))
    often = often.where("_low != _high OR _again").select(F.col("a").alias("_a"))
    often = stage.read(often.schema, stage.write(often, "often"))
    marks = runs.join(often, F.col("a") == F.col("_a")).select("a", "id", "s", "i", "j")
    renamed = later.selectExpr("id AS _id", "s AS _s")
    same = (F.col("id") == F.col("_id")) & (F.col("s") == F.col("_s"))
    marks = keep_matching(marks, renamed, same, "left_anti")
    marks = marks.groupBy("id", "s").agg(F.array_sort(F.collect_set(F.struct("i", "j", "a"))).alias("runs"))
    marks = marks.select("id", "s", F.expr("transform(runs, r -> struct(r.a AS a, r.i AS i, r.j AS j))").alias("runs"))
    marks = stage.read(marks.schema, stage.write(marks, "marks"))

    distinct = texts.select("id", "s", "text")
    marked = keep_matching(distinct, marks.selectExpr("id AS _id", "s AS _s"), same)
    marked = marked.join(marks.hint("merge"), ["id", "s"]).select("id", "s", "text", "runs")
    pieces = cut_pieces(marked, window)
    pieces = stage.read(pieces.schema, stage.write(pieces, "pieces"))
    content = ["a", "q1", "q2"]
    place = F.struct("id", "i", "s")
    firsts = pieces.groupBy(*content).agg(F.min(place).alias("first"))
    firsts = firsts.select(*[F.col(c).alias(f"_{c}") for c in content], "first")
    firsts = stage.read(firsts.schema, stage.write(firsts, "firsts"))
    placed = pieces.join(firsts, [F.col(c) == F.col(f"_{c}") for c in content])
    is_first = F.col("first") == place
    repeats = placed.where(~is_first & ((F.col("first.id") != F.col("id")) | (F.col("first.i") != F.col("i"))))
    repeats = repeats.selectExpr("id", "s", "i AS lo", f"j + {window} AS hi")
    repeats = stage.read(repeats.schema, stage.write(repeats, "repeats"))
    pieces = placed.where(is_first).select("a", "id", "s", "i", "words")
    pieces = stage.read(pieces.schema, stage.write(pieces, "first-pieces"))

    windows = window_hashes(pieces, window).groupBy("w1", "w2")
    windows = windows.agg(F.min(F.struct("id", "pos", "i", "s", "a")).alias("first"), F.count("*").alias("n")).where("n > 1")
    phrases = windows.select("first.*").groupBy("a", "id", "s", "i").agg(F.collect_list(F.expr("pos - i")).alias("offsets"))
    phrases = phrases.join(pieces, ["a", "id", "s", "i"]).select("a", "id", "i", "offsets", "words")
    phrases = stage.read(phrases.schema, stage.write(phrases, "phrases"))

    shards = max(1, -(-pieces.count() // shard_pieces))
    shard = F.pmod(F.xxhash64("a"), F.lit(shards)).alias("shard")
    parts = pieces.select(shard).groupBy("shard").agg(F.ceil(F.count("*") / (2 * shard_pieces)).alias("parts"))
    parts = stage.read(parts.schema, stage.write(parts, "shards"))
    dealt = pieces.select("*", shard).join(parts, "shard").withColumn("part", F.pmod(F.xxhash64("id", "i"), F.col("parts")))
    copied = phrases.select("*", shard).join(parts, "shard")
    copied = copied.withColumn("part", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)))
    grouped = copied.select("shard", "part", "id", "i", "offsets", "words").groupBy("shard", "part")
    ranges = grouped.cogroup(dealt.select("shard", "part", "id", "s", "i", "words").groupBy("shard", "part")).applyInPandas(
        lambda left, right: locate(left, right, window), "id long, s long, lo long, hi long"
    )
    ranges = ranges.selectExpr("id", "s", "CAST(lo AS INT) AS lo", "CAST(hi AS INT) AS hi").union(repeats)
    ranges = ranges.union(later.selectExpr("id", "s", "0 AS lo", f"{WHOLE} AS hi"))
    ranges = ranges.groupBy("id", "s").agg(F.collect_set(F.struct("lo", "hi")).alias("ranges"))
    ranges = stage.read(ranges.schema, stage.write(ranges, "ranges"))

    if ranges.count() <= BROADCAST_ROWS:
        keys = F.broadcast(ranges.selectExpr("id AS _id", "s AS _s"))
        none = F.lit(None).cast(ranges.schema["ranges"].dataType).alias("ranges")
        touched = texts.join(keys, same, "left_semi").join(ranges.hint("merge"), ["id", "s"])
        rows = texts.join(keys, same, "left_anti").select("own_id", "text", none)
        rows = rows.union(touched.select("own_id", "text", "ranges"))
    else:
        rows = texts.join(ranges.hint("merge"), ["id", "s"], "left").select("own_id", "text", "ranges")
    return kept_words(rows.withColumnRenamed("own_id", "id"), window).withColumnRenamed("id", id_col)
