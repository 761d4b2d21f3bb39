"""Hard-negative mining: blocks along a Hilbert curve, chosen by zone maps of their vectors."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..sources.staging import Stage
from .hilbert import Curve, fit_curve

SCALE = 256
POSITIVES = 5
NEGATIVES = 10
#: A negative's score lies within these percents of the positive's score.
LOW, HIGH = 30, 90
#: Vectors per candidate block, anchors per set, blocks per page of the zone map.
BLOCK, SET, PAGE = 1024, 256, 64
#: Rows on which the curve is fitted. Any curve gives the same result.
SAMPLE = 2048
AXES, BITS = 8, 7
#: Scores are exact up to this bound, which is small enough to be multiplied by 100.
LIMIT = 9 * 10**16
EXACT = 2.0**53

PACKED = "n int, low_id long, ids binary, vectors binary, narrow boolean, lo binary, hi binary"
HITS = "set long, row int, window int, anchor long, id long, score long"


def _lists(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Values of a list column, and where each list begins among them."""
    lengths = np.diff(column.offsets.to_numpy()).astype(np.int64)
    return column.flatten().to_numpy(zero_copy_only=False), np.concatenate(([0], np.cumsum(lengths)))


def _pack(ids: np.ndarray, vectors: np.ndarray) -> tuple:
    """A block's columns ``PACKED``: rows by id, in 16 bits if they fit, and the zone of each dimension."""
    order = np.argsort(ids, kind="stable")
    ids, vectors = ids[order], vectors[order]
    narrow = bool((np.abs(vectors) < 1 << 15).all())
    lo, hi = vectors.min(axis=0), vectors.max(axis=0)
    body = vectors.astype(np.int16) if narrow else vectors
    return len(ids), int(ids[0]), ids.tobytes(), body.tobytes(), narrow, lo.tobytes(), hi.tobytes()


def _matrix(body: bytes, narrow: bool, n: int, width: int) -> np.ndarray:
    return np.frombuffer(body, np.int16 if narrow else np.float64).reshape(n, width).astype(np.float64)


def products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Integer inner products of all rows of ``a`` with all of ``b``, within ``LIMIT``."""
    most = float(np.abs(a).max(initial=0)) * float(np.abs(b).max(initial=0)) * a.shape[1]
    if most < EXACT:
        return (a @ b.T).astype(np.int64)
    # Too large for doubles: Python's integers, which are exact.
    whole = np.array([[int(x) for x in row] for row in a], dtype=object).reshape(a.shape)
    other = np.array([[int(x) for x in row] for row in b], dtype=object).reshape(b.shape)
    return np.clip(whole.dot(other.T), -LIMIT, LIMIT).astype(np.int64)


def bounds(a: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Interval arithmetic: between what and what the products of ``a`` with each zone lie."""
    most = float(np.abs(a).max(initial=0)) * float(max(np.abs(lo).max(initial=0), np.abs(hi).max(initial=0)))
    if most * a.shape[1] >= EXACT:
        shape = (len(a), len(lo))
        return np.full(shape, -np.inf), np.full(shape, np.inf)
    plus, minus = np.maximum(a, 0), np.minimum(a, 0)
    return plus @ lo.T + minus @ hi.T, plus @ hi.T + minus @ lo.T


class Windows:
    """What the anchors of a set ask for: score intervals, and the k-th row known so far."""

    def __init__(self, anchors: int, asks: list[dict]) -> None:
        count = 1 + max((a["window"] for a in asks), default=0)
        shape = (anchors, count)
        self.low, self.high = np.full(shape, LIMIT + 1), np.full(shape, -LIMIT - 1)
        self.score, self.id = np.full(shape, -LIMIT - 1), np.full(shape, np.iinfo(np.int64).max)
        for ask in asks:
            at = ask["row"], ask["window"]
            self.low[at], self.high[at] = ask["low"], ask["high"]
            if ask["score"] is not None:
                self.score[at], self.id[at] = ask["score"], ask["id"]

    def wanted(self, lower: np.ndarray, upper: np.ndarray, low_id: np.ndarray, window: int) -> np.ndarray:
        """Which blocks, by their bounds per anchor, may hold a row that is among the first k."""
        low, high, score, id_ = (x[:, window, None] for x in (self.low, self.high, self.score, self.id))
        best = np.minimum(upper, high)
        open_ = (best > score) | ((best == score) & (low_id <= id_))
        return (low <= high) & (upper >= low) & (lower <= high) & open_


def _prepared(rows: DataFrame, curves: dict[int, Curve], scale: int) -> DataFrame:
    """Rows (id, label, width, key, ints): scaled vectors and their keys on the curve of their width."""

    def prepare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            values, first = _lists(batch.column(2))
            ints = np.floor(scale * values.astype(np.float64))
            widths = np.diff(first)
            keys = np.zeros(len(widths), dtype=np.int64)
            for width, curve in curves.items():
                at = np.flatnonzero(widths == width)
                if len(at):
                    keys[at] = curve.keys(ints[first[at][:, None] + np.arange(width)])
            lists = pa.ListArray.from_arrays(first.astype(np.int32), pa.array(ints))
            columns = [batch.column(0), batch.column(1), pa.array(widths, pa.int32()), pa.array(keys), lists]
            yield pa.RecordBatch.from_arrays(columns, names=["id", "label", "width", "key", "ints"])

    return rows.mapInArrow(prepare, "id long, label string, width int, key long, ints array<double>")


def _packed(rows: DataFrame, name: str, size: int) -> DataFrame:
    """Rows (``name``, label, width, ``PACKED``): up to ``size`` neighbours on the curve each.

    Rows are dealt by ranges of (label, width, key, id), so a label that most rows share, or
    one vector of many copies, is spread over tasks.
    """
    order = ["label", "width", "key", "id"]
    dealt = rows.repartitionByRange(*order).sortWithinPartitions(*order)
    kinds = (pa.int32(), pa.int64(), pa.binary(), pa.binary(), pa.bool_(), pa.binary(), pa.binary())
    names = [c.split()[0] for c in PACKED.split(", ")]
    fields = [(name, pa.int64()), ("label", pa.string()), ("width", pa.int32()), *zip(names, kinds)]

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, held, ids, parts = TaskContext.get().partitionId() << 33, None, [], []

        def block() -> pa.RecordBatch:
            figures = _pack(np.concatenate(ids), np.concatenate(parts))
            values = (number, *held, *figures)
            ids.clear()
            parts.clear()
            return pa.RecordBatch.from_arrays([pa.array([v], t) for v, (_, t) in zip(values, fields)], schema=pa.schema(fields))

        for batch in batches:
            own, labels = batch.column(0).to_numpy(), batch.column(1)
            values, first = _lists(batch.column(2))
            widths, codes = np.diff(first), labels.dictionary_encode().indices.to_numpy()
            edges = np.flatnonzero((codes[1:] != codes[:-1]) | (widths[1:] != widths[:-1])) + 1
            for s, e in zip([0, *edges.tolist()], [*edges.tolist(), len(own)]):
                key = (labels[s].as_py(), int(widths[s]))
                if held != key and ids:
                    yield block()
                    number += 1
                held = key
                vectors = values[first[s] : first[e]].reshape(e - s, key[1])
                at = 0
                while at < e - s:
                    to = min(e - s, at + size - sum(map(len, ids)))
                    ids.append(own[s + at : s + to])
                    parts.append(vectors[at:to])
                    at = to
                    if sum(map(len, ids)) == size:
                        yield block()
                        number += 1
        if ids:
            yield block()

    return dealt.select("id", "label", "ints").mapInArrow(pack, f"{name} long, label string, width int, {PACKED}")


def _paged(blocks: DataFrame, page: int) -> tuple[DataFrame, int]:
    """Rows (slot, zones): the zone maps of about ``page`` blocks each; and how many slots there are."""
    slots = max(1, -(-blocks.count() // page))
    zones = blocks.select(
        F.pmod(F.xxhash64("block"), F.lit(slots)).alias("slot"), F.struct("block", "label", "width", "low_id", "lo", "hi").alias("zone")
    )
    # Blocks are dealt to slots by a hash, so a slot's list is bounded in all likelihood.
    return zones.groupBy("slot").agg(F.collect_list("zone").alias("zones")), slots


def _chosen(asked: DataFrame, pages: DataFrame, slots: int, same: bool, seeds: bool) -> DataFrame:
    """Rows (set, slot, block, bound): the blocks that a set's windows must read.

    Every set meets every page of the zone map, each pair in a row of its own. With ``seeds``
    it is one block per window and page, the one whose bound reaches highest; else all that
    the bounds and the rows known so far leave open. ``bound`` orders the blocks of a set.
    """
    slot = F.explode(F.sequence(F.lit(0).cast("long"), F.lit(slots - 1).cast("long"))).alias("slot")
    columns = ["set", "label", "width", "n", "vectors", "narrow", "asks"]
    pairs = asked.select(*columns, slot).join(pages, "slot").select(*columns, "slot", "zones")

    def choose(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = []
            for row in batch.to_pylist():
                zones = [z for z in row["zones"] if z["width"] == row["width"] and (z["label"] == row["label"]) == same]
                if not zones or not row["asks"]:
                    continue
                a = _matrix(row["vectors"], row["narrow"], row["n"], row["width"])
                lo, hi = (np.stack([np.frombuffer(z[k], np.float64) for z in zones]) for k in ("lo", "hi"))
                low_id = np.array([z["low_id"] for z in zones])
                lower, upper = bounds(a, lo, hi)
                windows = Windows(row["n"], row["asks"])
                bound = np.full(len(zones), -np.inf)
                for k in range(windows.low.shape[1]):
                    open_ = windows.wanted(lower, upper, low_id, k)
                    reach = np.where(open_, np.minimum(upper, windows.high[:, k, None]), -np.inf)
                    if seeds:
                        best = reach.argmax(axis=1)
                        top = np.full_like(reach, -np.inf)
                        rows = np.arange(len(a))
                        top[rows, best] = reach[rows, best]
                        reach = top
                    bound = np.maximum(bound, reach.max(axis=0))
                for k in np.flatnonzero(bound > -np.inf).tolist():
                    found.append((row["set"], row["slot"], zones[k]["block"], float(bound[k])))
            columns = list(zip(*found)) if found else [[]] * 4
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.float64())
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, t) for c, t in zip(columns, kinds)], names=["set", "slot", "block", "bound"]
            )

    return pairs.mapInArrow(choose, "set long, slot long, block long, bound double")


class Tops:
    """The first ``k`` rows of every window of a set, fed block by block."""

    def __init__(self, anchors: np.ndarray, ids: np.ndarray, asks: list[dict], k: int) -> None:
        self.anchors, self.ids, self.k = anchors, ids, k
        self.windows = Windows(len(ids), asks)
        empty = np.zeros(0, dtype=np.int64)
        self.held = [(empty, empty, empty)] * self.windows.low.shape[1]

    def add(self, ids: np.ndarray, vectors: np.ndarray) -> None:
        scores, w = products(self.anchors, vectors), self.windows
        for j in range(len(self.held)):
            low, high, score, id_ = (x[:, j, None] for x in (w.low, w.high, w.score, w.id))
            fits = (scores >= low) & (scores <= high) & ((scores > score) | ((scores == score) & (ids <= id_)))
            fits &= ids != self.ids[:, None]
            if len(ids) > self.k:
                reach = np.where(fits, scores, -LIMIT - 1)
                fits &= reach >= np.partition(reach, len(ids) - self.k, axis=1)[:, -self.k, None]
            rows, columns = np.nonzero(fits)
            if not len(rows):
                continue
            rows, own, found = (
                np.concatenate(x) for x in zip(self.held[j], (rows, ids[columns], scores[rows, columns]))
            )
            order = np.lexsort((own, -found, rows))
            rows, own, found = rows[order], own[order], found[order]
            starts = np.searchsorted(rows, rows)
            first = np.arange(len(rows)) - starts < self.k
            last = np.arange(len(rows)) - starts == self.k - 1
            w.score[rows[last], j], w.id[rows[last], j] = found[last], own[last]
            self.held[j] = rows[first], own[first], found[first]


def _read(asked: DataFrame, blocks: DataFrame, chosen: DataFrame, k: int) -> DataFrame:
    """Rows ``HITS``: the first ``k`` rows of every window, of the chosen blocks.

    The blocks of one set and slot form a group, its set before them. A group is a stream,
    read block after block in the order of their bounds, so that one block is held at a time
    and what is found in the first ones closes the windows for the others. The best of a
    set's groups are then picked for each window.
    """
    payload = ["n", "ids", "vectors", "narrow"]
    none = "CAST(NULL AS ARRAY<STRUCT<row: INT, window: INT, low: BIGINT, high: BIGINT, score: BIGINT, id: BIGINT>>) AS asks"
    heads = chosen.select("set", "slot").distinct().join(asked, "set")
    heads = heads.selectExpr("set", "slot", "double('Infinity') AS bound", "-1L AS block", "width", *payload, "asks")
    bodies = chosen.join(blocks, "block").selectExpr("set", "slot", "bound", "block", "width", *payload, none)
    both = heads.union(bodies).repartition("set", "slot")
    both = both.sortWithinPartitions("set", "slot", F.desc("bound"), "block")

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tops, number = None, None

        def hits() -> pa.RecordBatch:
            parts = [np.zeros((6, 0), dtype=np.int64)]
            for j, (rows, ids, scores) in enumerate(tops.held):
                parts.append(np.stack([np.full(len(rows), number), rows, np.full(len(rows), j), tops.ids[rows], ids, scores]))
            kinds = (pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.int64())
            columns = [pa.array(c, pa.int64()).cast(t) for c, t in zip(np.concatenate(parts, axis=1), kinds)]
            return pa.RecordBatch.from_arrays(columns, names=[c.split()[0] for c in HITS.split(", ")])

        for batch in batches:
            for i in range(batch.num_rows):
                row = {name: batch.column(c)[i].as_py() for c, name in enumerate(batch.schema.names)}
                ids = np.frombuffer(row["ids"], np.int64)
                vectors = _matrix(row["vectors"], row["narrow"], row["n"], row["width"])
                if row["block"] < 0:
                    if tops is not None:
                        yield hits()
                    tops, number = Tops(vectors, ids, row["asks"], k), row["set"]
                else:
                    tops.add(ids, vectors)
        if tops is not None:
            yield hits()

    found = both.mapInArrow(read, HITS)
    order = W.partitionBy("set", "row", "window").orderBy(F.desc("score"), "id")
    return found.withColumn("rank", F.row_number().over(order)).where(f"rank <= {k}")


def _searched(sets: DataFrame, asks: DataFrame, blocks: DataFrame, pages: DataFrame, slots: int, same: bool, k: int, stage: Stage) -> DataFrame:
    """Rows ``HITS`` and rank: the first ``k`` rows of every window of ``asks``, over all blocks.

    First one block per window and page is read, which gives a row that the k-th one cannot
    stand behind. Then all blocks are read whose bounds reach beyond it.
    """

    def stored(frame: DataFrame, label: str) -> DataFrame:
        return stage.read(frame.schema, stage.write(frame, label))

    def listed(frame: DataFrame) -> DataFrame:
        # A set has a bounded number of anchors and each a bounded number of windows.
        one = F.struct("row", "window", "low", "high", "score", "id")
        return sets.join(frame.groupBy("set").agg(F.collect_list(one).alias("asks")), "set")

    asked = listed(asks.selectExpr("*", "CAST(NULL AS BIGINT) AS score", "CAST(NULL AS BIGINT) AS id"))
    seeds = stored(_chosen(asked, pages, slots, same, True), "seeds")
    known = _read(asked, blocks, seeds, k).where(f"rank = {k}").select("set", "row", "window", "score", "id")
    known = stored(asks.join(known, ["set", "row", "window"], "left"), "known")
    asked = listed(known)
    chosen = stored(_chosen(asked, pages, slots, same, False), "chosen")
    return stored(_read(asked, blocks, chosen, k), "found")


def hard_negatives(
    vectors: DataFrame,
    anchors: Column,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
    label_col: str = "label",
    positives: int = POSITIVES,
    negatives: int = NEGATIVES,
    low: int = LOW,
    high: int = HIGH,
    scale: int = SCALE,
    block: int = BLOCK,
    set_size: int = SET,
    page: int = PAGE,
    sample: int = SAMPLE,
    stage: Stage | None = None,
) -> DataFrame:
    """Rows anchor_id, positive_id, rank, negative_id, positive_score, negative_score.

    Components become floor(``scale`` * x), and a score is an integer inner product with the
    anchor; higher scores come first, and smaller ids among equal ones. Anchors are the rows
    for which ``anchors`` holds. An anchor's positives are the first ``positives`` other rows
    of its label. For each of them, negatives are the first ``negatives`` rows of other labels
    whose score is from ``low`` to ``high`` percent of the positive's.

    All rows are stored in blocks of neighbours on a Hilbert curve along the directions in
    which a bounded sample of ``sample`` rows varies most. Each block has one label and a
    zone map, the smallest and largest value of each dimension. Interval arithmetic on the
    zones bounds the scores in a block, and an anchor's windows read only blocks whose bounds
    meet them. The result is exact for any curve; the sample only decides what is read.

    Rows with a null id, label or vector, or a null or non-finite component, take no part. Of
    rows that share an id the one with the smallest (label, vector) does. Only vectors of one
    length are compared; empty ones score 0. Scores beyond 9e16 count as that. A negative
    score of a positive leaves its window empty. Anchors without positives, and positives
    without negatives, give no rows; other columns are ignored; no rows give no rows.
    """
    spark = vectors.sparkSession
    stage = stage or Stage(spark)
    rows = vectors.select(
        F.col(id_col).cast("long").alias("id"),
        F.col(label_col).cast("string").alias("label"),
        F.col(vector_col).alias("embedding"),
        F.coalesce(anchors, F.lit(False)).alias("is_anchor"),
    )
    sound = "id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL"
    sound += " AND forall(embedding, x -> x IS NOT NULL AND NOT isnan(x) AND abs(x) < double('Infinity'))"
    rows = rows.where(sound)
    if not rows.groupBy("id").count().where("count > 1").isEmpty():
        rows = rows.groupBy("id").agg(F.min(F.struct("label", "embedding", "is_anchor")).alias("r")).select("id", "r.*")

    drawn = rows.select("embedding", F.xxhash64("id").alias("h"), "id").orderBy("h", "id").limit(sample).collect()
    by_width: dict[int, list] = {}
    for row in drawn:
        by_width.setdefault(len(row.embedding), []).append(row.embedding)
    curves = {w: fit_curve(np.floor(scale * np.array(v, dtype=np.float64)), AXES, BITS) for w, v in by_width.items() if w}

    def packed(frame: DataFrame, name: str, size: int) -> DataFrame:
        frame = _packed(_prepared(frame.select("id", "label", "embedding"), curves, scale), name, size)
        return stage.read(frame.schema, stage.write(frame, name))

    blocks = packed(rows, "block", block)
    sets = packed(rows.where("is_anchor"), "set", set_size)
    pages, slots = _paged(blocks, page)
    pages = stage.read(pages.schema, stage.write(pages, "pages"))

    every = sets.select("set", F.explode(F.sequence(F.lit(0), F.col("n") - 1)).alias("row"))
    asks = every.selectExpr("set", "row", "0 AS window", f"{-LIMIT}L AS low", f"{LIMIT}L AS high")
    close = _searched(sets, asks, blocks, pages, slots, True, positives, stage)
    close = close.selectExpr("set", "row", "rank - 1 AS window", "id AS positive_id", "score AS positive_score")
    # Whole numbers: the window from ceil(low * s / 100) to floor(high * s / 100).
    least, most = f"-floor(CAST(-{low} * positive_score AS DECIMAL(20,0)) / 100)", f"floor(CAST({high} * positive_score AS DECIMAL(20,0)) / 100)"
    asks = close.selectExpr("set", "row", "window", f"CAST({least} AS BIGINT) AS low", f"CAST({most} AS BIGINT) AS high").where("low <= high")
    far = _searched(sets, asks, blocks, pages, slots, False, negatives, stage)
    return far.join(close, ["set", "row", "window"]).select(
        F.col("anchor").alias("anchor_id"),
        "positive_id",
        F.col("rank").cast("int").alias("rank"),
        F.col("id").alias("negative_id"),
        "positive_score",
        F.col("score").alias("negative_score"),
    )
