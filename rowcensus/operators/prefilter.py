"""Duplicate keys with little shuffle: only rows whose key may repeat are moved."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import quoted
from ..sources.staging import Stage
from .profile import duplicate_keys

#: Hashes that a task holds before it sends what it has seen, and that meet in one bucket.
HELD = 1 << 22
#: Candidate slots, eight bytes each, that are broadcast at most.
FEW_SLOTS = 1_000_000
#: Bytes of slots that a task sends in one batch, unless a single bucket has more.
SENT = 1 << 20
_OFFSET_BITS = 32

SEEN_SCHEMA = "bucket int, once binary, twice binary"


def _slot(keys: Sequence[str], bits: int) -> str:
    """The upper ``bits`` + 32 bits of the hash of a key; equal keys, nulls included, are alike."""
    return f"shiftrightunsigned(xxhash64({', '.join(quoted(k) for k in keys)}), {_OFFSET_BITS - bits})"


def bucket_bits(rows: int, held: int = HELD) -> int:
    """Bits for buckets of about ``held`` hashes each."""
    return min(max(0, (rows // held).bit_length()), 24)


def seen_slots(df: DataFrame, keys: Sequence[str], bits: int, held: int = HELD) -> DataFrame:
    """Rows ``SEEN_SCHEMA``: which slots a task has met once or more, and which more than once.

    A task holds up to ``held`` hashes in one buffer, sorts them in place, and sends one row
    per bucket with the sorted slots in four bytes each: a membership set in compressed form.
    Buckets are sent a few at a time, so little more than the buffer is held. A hot key is one slot.
    """

    def sent(slots: np.ndarray) -> Iterator[pa.RecordBatch]:
        slots.sort()
        edges = (np.arange((1 << bits) + 1, dtype=np.uint64) << np.uint64(_OFFSET_BITS)).astype(np.uint64)
        ends = np.searchsorted(slots, edges)
        found: list[tuple[int, bytes, bytes]] = []
        size = 0
        for b in np.flatnonzero(np.diff(ends)).tolist():
            low = slots[ends[b] : ends[b + 1]].astype(np.uint32)
            again = low[1:] == low[:-1]
            twice = np.unique(low[1:][again])
            found.append((b, low[np.concatenate(([True], ~again))].tobytes(), twice.tobytes()))
            size += len(found[-1][1])
            if size >= SENT:
                yield listed(found)
                found, size = [], 0
        if found:
            yield listed(found)

    def listed(found: list[tuple[int, bytes, bytes]]) -> pa.RecordBatch:
        columns = [pa.array(column, kind) for column, kind in zip(zip(*found), (pa.int32(), pa.binary(), pa.binary()))]
        return pa.RecordBatch.from_arrays(columns, names=["bucket", "once", "twice"])

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        buffer, count = np.empty(held, np.uint64), 0
        for batch in batches:
            slots = batch.column(0).to_numpy().view(np.uint64)
            while len(slots):
                taken = slots[: held - count]
                buffer[count : count + len(taken)] = taken
                count, slots = count + len(taken), slots[len(taken) :]
                if count == held:
                    yield from sent(buffer)
                    count = 0
        if count:
            yield from sent(buffer[:count])

    return df.selectExpr(f"{_slot(keys, bits)} AS slot").mapInArrow(gather, SEEN_SCHEMA)


def repeated_slots(seen: DataFrame) -> DataFrame:
    """Rows (slot): slots met more than once, by one task or by several."""

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bucket, once, twice = None, [], []

        def found() -> pa.RecordBatch:
            slots = np.concatenate(once)
            once.clear()
            slots.sort()
            again = np.unique(np.concatenate([slots[1:][slots[1:] == slots[:-1]], *twice]))
            slots = again.astype(np.int64) + (bucket << _OFFSET_BITS)
            return pa.RecordBatch.from_arrays([pa.array(slots)], names=["slot"])

        for batch in batches:
            # The slots stay in the batch: no copy of it is made in Python.
            for b, low, more in zip(*(batch.column(k) for k in range(3))):
                b = b.as_py()
                if b != bucket and bucket is not None:
                    yield found()
                    once, twice = [], []
                bucket = b
                once.append(np.frombuffer(low.as_buffer(), np.uint32))
                twice.append(np.frombuffer(more.as_buffer(), np.uint32))
        if bucket is not None:
            yield found()

    return seen.repartition("bucket").sortWithinPartitions("bucket").mapInArrow(meet, "slot long")


def may_repeat(df: DataFrame, keys: Sequence[str], slots: DataFrame, bits: int) -> DataFrame:
    """The key columns of rows whose slot is among the few ``slots``; rows are not shuffled."""
    rows = df.selectExpr(*[quoted(k) for k in keys], f"{_slot(keys, bits)} AS _slot")
    return rows.join(F.broadcast(slots), F.col("_slot") == F.col("slot"), "left_semi").drop("_slot")


def duplicate_keys_prefiltered(
    df: DataFrame,
    keys: Sequence[str],
    max_extra: int = 0,
    stage: Stage | None = None,
    held: int = HELD,
    few_slots: int = FEW_SLOTS,
) -> DataFrame:
    """The same rows as ``duplicate_keys``, for keys that are nearly unique.

    A first pass reduces every key to a slot, so many that few keys share one, and finds the
    slots met more than once: one row per task and bucket is shuffled, four bytes a key,
    whatever the width of the keys. A second pass groups only rows in these slots, which
    holds all duplicates and few other rows. If more than ``few_slots`` slots repeat, keys
    are far from unique, and all rows are grouped as ``duplicate_keys`` does.
    """
    stage = stage or Stage(df.sparkSession)
    bits = bucket_bits(df.count(), held)
    slots = repeated_slots(seen_slots(df, keys, bits, held))
    slots = stage.read("slot long", stage.write(slots, "slots"))
    if slots.count() > few_slots:
        return duplicate_keys(df, keys, max_extra)
    return duplicate_keys(may_repeat(df, keys, slots, bits), keys, max_extra)
