"""Best-fit packing of tokenised documents into sequences: best-two-fit on a length histogram."""

from __future__ import annotations

import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..sources.staging import Stage
from .words import text_buffers, word_hashes

LENGTH = 1024
END_ID = 2
BUCKET_ROWS = 20_000
#: Texts that are encoded together; a longer one by itself.
TEXT_BYTES = 1 << 21

#: Words that are encoded as one text.
JOINED = 4_096

# How the vocabulary writes a space, and its special token.
SPACE = "\u0120"
SPECIAL = "<|endoftext|>"

_encoders: dict[str, Encoder] = {}


class Encoder:
    """Ids of texts under a byte-level BPE file, with a memory of words.

    A single space before a word always starts a new piece of the splitting pattern, and no
    other piece holds a space. So a text is the ids of its first word and then of every word
    with the space before it, and many words joined by single spaces can be encoded as one
    text, of which every id that begins with a space begins the next word. Texts with other
    runs of white space around spaces, or with the special token, are encoded as a whole.

    Of a slice of texts, only distinct words that the memory does not know are encoded. The
    memory is a few arrays, sorted by a hash of 128 bits, of some 40 bytes a word; when it
    is full, the words of the latest slice stay.
    """

    WORDS = 800_000

    # White space beyond the space and the line feed.
    RARE = "\t\x0b\x0c\r\x1c\x1d\x1e\x1f\x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007"
    RARE += "\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"
    #: Texts whose pieces may reach across the space before a word.
    ODD = f"  | \n|\n \\z|{SPECIAL.replace('|', '[|]')}|[{RARE}]"

    def __init__(self, path: str) -> None:
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        vocabulary = self.tokenizer.get_vocab()
        self.spaced = np.zeros(1 + max(vocabulary.values()), dtype=bool)
        self.spaced[[i for token, i in vocabulary.items() if token.startswith(SPACE)]] = True
        self.space = np.frombuffer(self._whole(" "), dtype=np.uint32)
        self._forget()

    def _forget(self) -> None:
        self.keys = np.zeros((2, 0), dtype=np.uint64)
        self.places = np.zeros((2, 0), dtype=np.int32)
        self.pool = np.zeros(0, dtype=np.uint32)

    def _whole(self, text: str) -> bytes:
        return array("I", self.tokenizer.encode(text, add_special_tokens=False).ids).tobytes()

    def _encoded(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of words after a space, one after the other, and how many each has."""
        ids, sizes = [np.zeros(0, dtype=np.uint32)], [np.zeros(0, dtype=np.int64)]
        for at in range(0, len(words), JOINED):
            some = words[at : at + JOINED]
            found = np.frombuffer(self._whole(" " + " ".join(some)), dtype=np.uint32)
            ids.append(found)
            sizes.append(np.diff(np.append(np.flatnonzero(self.spaced[found]), len(found))))
        return np.concatenate(ids), np.concatenate(sizes)

    def _known(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Where the ids of distinct non-empty words begin in ``pool``, and how many they are."""
        data, bounds = text_buffers(words)
        hashes = np.stack([word_hashes(data, bounds[:-1], bounds[1:], seed) for seed in (0, 1)])
        order = np.lexsort((hashes[1], hashes[0]))
        hashes = hashes[:, order]
        at = np.searchsorted(self.keys[0], hashes[0])
        near = np.minimum(at, max(self.keys.shape[1] - 1, 0))
        known = (self.keys[:, near] == hashes).all(axis=0) if self.keys.shape[1] else np.zeros(len(order), bool)
        fresh = ~known
        ids, sizes = self._encoded(words.take(pa.array(order[fresh])).to_pylist())
        places = np.stack([len(self.pool) + np.cumsum(sizes) - sizes, sizes]).astype(np.int32)
        found = np.empty((2, len(order)), dtype=np.int64)
        found[:, order[known]], found[:, order[fresh]] = self.places[:, near[known]], places
        self.pool = np.concatenate((self.pool, ids))
        self.keys = np.insert(self.keys, at[fresh], hashes[:, fresh], axis=1)
        self.places = np.insert(self.places, at[fresh], places, axis=1)
        return found[0], found[1]

    def _trim(self, begins: np.ndarray) -> None:
        """Keep only the words at these places of the pool, if the memory is full."""
        if self.keys.shape[1] <= self.WORDS:
            return
        if len(begins) > self.WORDS:
            self._forget()
            return
        kept = np.isin(self.places[0], begins)
        self.keys, old = self.keys[:, kept], self.places[:, kept].astype(np.int64)
        new = np.cumsum(old[1]) - old[1]
        self.pool = self.pool[np.arange(old[1].sum()) + np.repeat(old[0] - new, old[1])]
        self.places = np.stack([new, old[1]]).astype(np.int32)

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all ``texts``, an end after each, and where each text begins among them.

        Words become entries of a table of ids; a text is a run of entries, and one gather
        over all runs yields the ids.
        """
        n = len(texts)
        odd = pc.match_substring_regex(texts, self.ODD).to_numpy(zero_copy_only=False).astype(bool)
        rows = np.flatnonzero(~odd)
        words = pc.split_pattern(texts.filter(pa.array(~odd)), " ")
        begins = words.offsets.to_numpy()[:-1].astype(np.int64)
        flat = words.flatten()
        table = flat.dictionary_encode()
        entries = table.indices.to_numpy().astype(np.int64)
        # The first word of a text has no space before it, and is an entry of its own.
        entries[begins] = -1
        used = np.unique(entries)
        used = used[used >= 0]
        renumbered = np.zeros(len(table.dictionary), dtype=np.int64)
        renumbered[used] = np.arange(len(used))
        entries = renumbered[entries]
        distinct = table.dictionary.take(pa.array(used))
        empty = pc.equal(distinct, "").to_numpy(zero_copy_only=False).astype(bool)
        begin, sizes = np.zeros(len(distinct), dtype=np.int64), np.zeros(len(distinct), dtype=np.int64)
        begin[~empty], sizes[~empty] = self._known(distinct.filter(pa.array(~empty)))
        starts_of: dict[str, bytes] = {}
        starts: list[bytes] = [b""] * n
        for row, word in zip(rows.tolist(), flat.take(pa.array(begins)).to_pylist()):
            if word not in starts_of:
                starts_of[word] = self._whole(word)
            starts[row] = starts_of[word]
        for row in np.flatnonzero(odd).tolist():
            starts[row] = self._whole(texts[row].as_py())
        later = len(distinct)
        entries[begins] = later + rows
        # An odd text is one entry, and every text ends with the end.
        counts = np.ones(n, dtype=np.int64)
        counts[rows] = np.diff(np.append(begins, len(entries)))
        places = np.concatenate(([0], np.cumsum(counts + 1)))
        order = np.full(places[-1], later + n)
        order[np.arange(len(entries)) + np.repeat(places[rows] - begins, counts[rows])] = entries
        order[places[:-1][odd]] = later + np.flatnonzero(odd)

        # The word after a last space is empty: a space of its own.
        more = [self.space.tobytes(), array("I", [END_ID]).tobytes(), *starts]
        lengths = np.array([len(x) // 4 for x in more], dtype=np.int64)
        places_of = len(self.pool) + np.cumsum(lengths) - lengths
        begin[empty], sizes[empty] = places_of[0], lengths[0]
        begin = np.concatenate((begin, places_of[2:], places_of[1:2]))
        sizes = np.concatenate((sizes, lengths[2:], lengths[1:2]))
        taken = sizes[order]
        ends = np.concatenate(([0], np.cumsum(taken)))
        gather = np.arange(ends[-1]) + np.repeat(begin[order] - ends[:-1], taken)
        ids = np.concatenate((self.pool, np.frombuffer(b"".join(more), dtype=np.uint32)))[gather]
        self._trim(begin[:later][~empty])
        return ids, ends[places]


def encoder(path: str) -> Encoder:
    """One encoder per worker and file."""
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    return _encoders[path]


def token_pieces(
    docs: DataFrame, tokenizer_path: str, id_col: str, text_col: str, length: int, with_ids: bool = False
) -> DataFrame:
    """Rows (id, piece, start, length, ids_crc32[, ids]): documents cut where they are too long.

    A document is its ids and then ``END_ID``. Only longer ones are cut, into pieces of
    ``length`` with the shorter one first, so every other piece fills a sequence.
    """
    rows = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    kind = rows.schema["id"].dataType
    schema = f"id {kind.simpleString()}, piece int, start long, length long, ids_crc32 long"
    schema += ", ids binary" if with_ids else ""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(tokenizer_path).encode
        for batch in batches:
            _, bounds = text_buffers(batch.column(1))
            row = 0
            while row < batch.num_rows:
                until = int(np.searchsorted(bounds, bounds[row] + TEXT_BYTES, side="right")) - 1
                until = min(max(until, row + 1), batch.num_rows)
                ids, first = encode(batch.column(1).slice(row, until - row))
                owner, piece, start, size, crc, parts = [], [], [], [], [], []
                for i, (low, high) in enumerate(zip(first[:-1].tolist(), first[1:].tolist())):
                    n = high - low
                    at, to, k = 0, (n - 1) % length + 1, 0
                    while at < n:
                        part = ids[low + at : low + to].tobytes()
                        owner.append(row + i)
                        piece.append(k)
                        start.append(at)
                        size.append(to - at)
                        crc.append(zlib.crc32(part))
                        if with_ids:
                            parts.append(part)
                        at, to, k = to, to + length, k + 1
                columns = [batch.column(0).take(pa.array(owner, pa.int64())), pa.array(piece, pa.int32())]
                columns += [pa.array(x, pa.int64()) for x in (start, size, crc)]
                columns += [pa.array(parts, pa.binary())] if with_ids else []
                names = ["id", "piece", "start", "length", "ids_crc32", "ids"][: len(columns)]
                yield pa.RecordBatch.from_arrays(columns, names=names)
                row = until

    return rows.mapInArrow(cut, schema)


def best_two_fit(counts: np.ndarray, length: int) -> list[tuple[int, list[int]]]:
    """Bins for ``counts[l]`` items of each length ``l``: rows (how many bins, their lengths).

    A bin is filled greedily: the longest item that fits, again and again. Then its smallest
    item is replaced by two unpacked items if they fit the gap, widened by that item, more
    tightly. As long as the counts allow it the next bin would come out the same, so equal
    bins are made at once; every such row uses up a length's items, and the number of rows
    depends on ``length``, not on the number of items.
    """
    left = counts.astype(np.int64).copy()
    sizes = np.arange(length + 1)
    rows: list[tuple[int, list[int]]] = []
    while left.any():
        free, used = length, []
        trial = left.copy()
        while free:
            fitting = np.flatnonzero(trial[: free + 1])
            if not len(fitting):
                break
            longest = int(fitting[-1])
            take = min(free // longest, int(trial[longest]))
            used += [longest] * take
            trial[longest] -= take
            free -= longest * take
        if free and used:
            smallest, gap = used[-1], free + used[-1]
            # The longest unpacked partner within each room, and with it the best pair.
            longest_within = np.maximum.accumulate(np.where(trial > 0, sizes, 0))
            ones = np.flatnonzero(trial[: gap + 1])
            twos = longest_within[gap - ones]
            same = (twos == ones) & (trial[ones] < 2)
            below = longest_within[np.maximum(ones - 1, 0)]
            twos = np.where(same, below, twos)
            sums = np.where(twos > 0, ones + twos, 0)
            if len(sums) and sums.max() > smallest:
                best = int(sums.argmax())
                used = [*used[:-1], int(ones[best]), int(twos[best])]
        used.sort(reverse=True)
        lengths, times = np.unique(used, return_counts=True)
        many = int((left[lengths] // times).min())
        left[lengths] -= many * times
        rows.append((many, used))
    return rows


def bin_places(rows: list[tuple[int, list[int]]]) -> list[tuple[int, int, int, int, int, int]]:
    """Rows (length, from rank, to rank, first bin, items of the length per bin, offset of the first).

    Items of one length are numbered from 0; those of a bin have consecutive numbers.
    """
    next_rank: dict[int, int] = {}
    places, first = [], 0
    for many, used in rows:
        offset = 0
        for size in sorted(set(used), reverse=True):
            times = used.count(size)
            rank = next_rank.get(size, 0)
            places.append((size, rank, rank + many * times, first, times, offset))
            next_rank[size] = rank + many * times
            offset += times * size
        first += many
    return places


def numbered(pieces: DataFrame, stage: Stage, bucket_rows: int = BUCKET_ROWS) -> DataFrame:
    """Add ``rank``, numbering the pieces of each length from 0.

    Pieces are dealt by a hash into buckets of about ``bucket_rows``, numbered there, and
    shifted by the counts of the buckets before: a length that most pieces share is
    numbered by many tasks.
    """
    buckets = max(1, -(-pieces.count() // bucket_rows))
    dealt = pieces.withColumn("bucket", F.pmod(F.xxhash64("id", "piece", "ids_crc32"), F.lit(buckets)))
    counts = dealt.groupBy("length", "bucket").count()
    before = W.partitionBy("length").orderBy("bucket").rowsBetween(W.unboundedPreceding, -1)
    shifts = counts.select("length", "bucket", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("shift"))
    order = W.partitionBy("length", "bucket").orderBy("id", "piece", "ids_crc32")
    ranked = dealt.withColumn("within", F.row_number().over(order) - 1)
    ranked = ranked.join(shifts, ["length", "bucket"]).withColumn("rank", F.col("within") + F.col("shift"))
    return ranked.drop("within", "shift", "bucket")


def pack(
    docs: DataFrame,
    tokenizer_path: str,
    id_col: str = "doc_id",
    text_col: str = "text",
    length: int = LENGTH,
    stage: Stage | None = None,
) -> DataFrame:
    """Rows id, piece, start, length, ids_crc32, sequence_id, offset: where each piece goes.

    The packing depends on lengths alone. Their histogram, of at most ``length`` numbers, is
    all that reaches the driver; it is packed there by best-two-fit and the resulting table
    of bins, whose size depends on ``length`` too, is joined back by (length, rank). Ids stay
    in the tasks that make them.

    A null text is an empty one: a piece of one id, the end. Null ids and repeated rows are
    documents like others. Other columns of ``docs`` are ignored. No rows give no rows.
    """
    spark = docs.sparkSession
    stage = stage or Stage(spark)
    pieces = token_pieces(docs, tokenizer_path, id_col, text_col, length)
    pieces = stage.read(pieces.schema, stage.write(pieces, "pieces"))
    counts = np.zeros(length + 1, dtype=np.int64)
    for size, count in pieces.groupBy("length").count().collect():
        counts[size] = count
    places = bin_places(best_two_fit(counts, length))
    schema = "length long, low long, high long, first_bin long, times long, first_offset long"
    table = spark.createDataFrame(places, schema)
    ranked = numbered(pieces, stage)
    step = F.col("rank") - F.col("low")
    return ranked.join(F.broadcast(table), "length").where("rank >= low AND rank < high").select(
        F.col("id").alias(id_col),
        "piece",
        "start",
        "length",
        "ids_crc32",
        (F.col("first_bin") + F.floor(step / F.col("times"))).cast("long").alias("sequence_id"),
        (F.col("first_offset") + step % F.col("times") * F.col("length")).cast("long").alias("offset"),
    )
