"""MinHash near-deduplication: banded universal hash minima, checked signatures, full sets."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.staging import Stage
from .graph import components
from .joins import keep_matching
from .words import Slice, mix, run_hash, span_hash
from .words import slices as text_slices

SHINGLE = 5
PERCENT = 80
BANDS = 28
ROWS = 4
MARGIN = 0.15
#: Rounds of comparing classes to one of their bucket, and different draws in each.
ROUNDS, DRAWS = 2, 4
#: Classes of a bucket that are compared at once.
BLOCK = 2_000


def shingle_sets(part: Slice, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingle hashes of each text of a slice: (hashes, first); sorted in each text.

    A shingle is ``size`` consecutive words; a text with fewer words is one shingle as a
    whole, and a text without words has none.
    """
    counts = part.counts()
    shingles = np.where(counts >= size, counts - size + 1, (counts > 0).astype(np.int64))
    owner = np.repeat(np.arange(len(part)), shingles)
    within = np.arange(len(owner)) - np.repeat(np.cumsum(shingles) - shingles, shingles)
    starts = part.first[:-1][owner] + within
    hashes = run_hash(part.hashes(), starts, np.minimum(counts, size)[owner])
    order = np.lexsort((hashes, owner))
    hashes = hashes[order]
    new = np.ones(len(hashes), dtype=bool)
    new[1:] = (hashes[1:] != hashes[:-1]) | (owner[1:] != owner[:-1])
    kept = np.bincount(owner[new], minlength=len(part))
    return hashes[new], np.concatenate(([0], np.cumsum(kept)))


def minima(hashes: np.ndarray, first: np.ndarray, count: int, seed: int) -> np.ndarray:
    """For every text with shingles, the smallest value under each of ``count`` universal hashes."""
    draw = np.random.default_rng(seed)
    factors = draw.integers(0, 1 << 64, count, dtype=np.uint64) | np.uint64(1)
    offsets = draw.integers(0, 1 << 64, count, dtype=np.uint64)
    at = first[:-1][np.diff(first) > 0]
    found = np.empty((len(at), count), dtype=np.uint64)
    if len(at):
        for k in range(count):
            found[:, k] = np.minimum.reduceat((hashes * factors[k] + offsets[k]) >> np.uint64(24), at)
    return found


def signatures(
    docs: DataFrame, id_col: str, text_col: str, size: int, bands: int, rows: int, seed: int
) -> DataFrame:
    """Rows (id, n, d1, d2, sig, bands): size and digest of a text's set, a byte of each minimum, band keys."""
    texts = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    kind = texts.schema["id"].dataType.simpleString()

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in text_slices(batch.column(1), lower=True):
                hashes, first = shingle_sets(part, size)
                n = np.diff(first)
                some = n > 0
                at = first[:-1][some]
                digests = np.zeros((2, len(part)), dtype=np.uint64)
                if len(at):
                    digests[0, some] = np.add.reduceat(hashes, at)
                    digests[1, some] = np.add.reduceat(mix(hashes ^ np.uint64(0xA0761D6478BD642F)), at)
                lowest = minima(hashes, first, bands * rows, seed)
                grid = lowest.reshape(-1, rows)
                keys = span_hash(grid.ravel(), np.arange(len(grid)) * rows, np.arange(1, len(grid) + 1) * rows)
                keys = mix(keys.reshape(-1, bands) + np.arange(bands, dtype=np.uint64))
                sig = pa.array([row.tobytes() for row in lowest.astype(np.uint8)], pa.binary())
                empty = np.concatenate(([0], np.cumsum(some))).astype(np.int32)
                places = np.where(some, empty[:-1], -1)
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).slice(part.row, len(part)),
                        pa.array(n, pa.int64()),
                        pa.array(digests[0].view(np.int64)),
                        pa.array(digests[1].view(np.int64)),
                        sig.take(pa.array(places, pa.int64(), mask=~some)),
                        pa.ListArray.from_arrays(empty * bands, pa.array(keys.ravel().view(np.int64))),
                    ],
                    names=["id", "n", "d1", "d2", "sig", "bands"],
                )

    return texts.mapInArrow(sign, f"id {kind}, n long, d1 long, d2 long, sig binary, bands array<long>")


def full_sets(docs: DataFrame, size: int) -> DataFrame:
    """Rows (id, shingles): the sorted distinct shingle hashes of docs (id, text) as bytes."""
    kind = docs.schema["id"].dataType.simpleString()

    def collect(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in text_slices(batch.column(1), lower=True):
                hashes, first = shingle_sets(part, size)
                sets = [hashes[a:b].tobytes() for a, b in zip(first[:-1].tolist(), first[1:].tolist())]
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(part.row, len(part)), pa.array(sets, pa.binary())], names=["id", "shingles"]
                )

    return docs.mapInArrow(collect, f"id {kind}, shingles binary")


def agreeing(pairs: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b) of rows (a, b, sig_a, sig_b) whose signatures may reach ``percent``."""
    kind = pairs.schema["a"].dataType.simpleString()
    least = percent / 100 - MARGIN

    def agree(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                share = (_signatures(batch.column(2)) == _signatures(batch.column(3))).mean(axis=1)
                yield batch.select([0, 1]).filter(pa.array(share >= least))

    return pairs.select("a", "b", "sig_a", "sig_b").mapInArrow(agree, f"a {kind}, b {kind}").distinct()


def _signatures(column: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), dtype=np.uint8).reshape(len(column), -1)


def pairs_within(ends: np.ndarray, most: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """All pairs of rows of the same group, in portions of about ``most``.

    ``ends`` gives for each row, in the order of the groups, where its group ends.
    """
    partners = ends - np.arange(len(ends)) - 1
    total = np.concatenate(([0], np.cumsum(partners)))
    lo = 0
    while lo < len(ends):
        hi = max(lo + 1, int(np.searchsorted(total, total[lo] + most, side="right")) - 1)
        left = np.repeat(np.arange(lo, hi), partners[lo:hi])
        right = left + 1 + np.arange(len(left)) - np.repeat(total[lo:hi] - total[lo], partners[lo:hi])
        yield left, right
        lo = hi


def _reach(a: np.ndarray, b: np.ndarray, percent: int) -> bool:
    """Whether two sets of sorted distinct hashes have 100 * intersection >= percent * union."""
    both = np.sort(np.concatenate((a, b)))
    common = int((both[1:] == both[:-1]).sum())
    return 100 * common >= percent * (len(a) + len(b) - common)


def linked_in_buckets(rows: DataFrame, percent: int) -> DataFrame:
    """The linked pairs (a, b) of each bucket whose components differ.

    A pair is compared in one of the bands that it shares, drawn by its ids, so that the
    pairs of a large group are spread over its buckets. Pairs with like sizes and signatures
    are counted on their full sets. Of two blocks only the pairs across them are looked at.
    The rows of a task are sorted by bucket, and as many buckets as fill a batch are
    compared at once.
    """
    kind = rows.schema["id"].dataType.simpleString()
    least = percent / 100 - MARGIN
    names = ["key", "left", "right", "block", "band", "id", "component", "n", "sig", "bands", "shingles"]

    def compare(table: pa.Table) -> pa.RecordBatch:
        key, left, right, block, band, ids, part, n = (table[c].to_numpy() for c in names[:8])
        sig = _signatures(table["sig"].combine_chunks())
        keys = np.array(table["bands"].to_pylist(), dtype=np.int64)
        sets = [np.frombuffer(x, np.uint64) for x in table["shingles"].to_pylist()]
        new = np.ones(len(key), dtype=bool)
        new[1:] = (key[1:] != key[:-1]) | (left[1:] != left[:-1]) | (right[1:] != right[:-1])
        first = np.flatnonzero(new)
        ends = np.repeat(np.append(first[1:], len(key)), np.diff(np.append(first, len(key))))
        found = [np.zeros((0, 2), dtype=ids.dtype)]
        for r, c in pairs_within(ends, 200_000):
            near = (part[r] != part[c]) & ((left[r] == right[r]) | (block[r] != block[c]))
            near &= 100 * np.minimum(n[r], n[c]) >= percent * np.maximum(n[r], n[c])
            r, c = r[near], c[near]
            near = (sig[r] == sig[c]).mean(axis=1) >= least
            r, c = r[near], c[near]
            shared = (keys[r] == keys[c]).cumsum(axis=1)
            low, high = np.minimum(ids[r], ids[c]).astype(np.uint64), np.maximum(ids[r], ids[c]).astype(np.uint64)
            pick = mix(low ^ mix(high))
            drawn = (shared == (pick % shared[:, -1].astype(np.uint64) + 1)[:, None].astype(np.int64)).argmax(axis=1)
            r, c = r[drawn == band[r]], c[drawn == band[r]]
            good = np.array([_reach(sets[x], sets[y], percent) for x, y in zip(r.tolist(), c.tolist())], dtype=bool)
            found.append(np.sort(np.stack([ids[r[good]], ids[c[good]]], axis=1), axis=1))
        both = np.concatenate(found)
        return pa.RecordBatch.from_arrays([pa.array(both[:, 0]), pa.array(both[:, 1])], names=["a", "b"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waiting: list[pa.RecordBatch] = []
        for batch in batches:
            if not batch.num_rows:
                continue
            waiting.append(batch)
            table = pa.Table.from_batches(waiting)
            group = list(zip(*(table[c].to_pylist() for c in names[:3])))
            # The last bucket may go on in the next batch.
            cut = next((k for k in range(len(group) - 1, 0, -1) if group[k] != group[k - 1]), 0)
            if cut:
                yield compare(table.slice(0, cut))
            waiting = table.slice(cut).to_batches()
        if waiting:
            yield compare(pa.Table.from_batches(waiting))

    dealt = rows.select(*names).repartition("key", "left", "right").sortWithinPartitions("key", "left", "right")
    return dealt.mapInArrow(run, f"a {kind}, b {kind}")


def confirmed(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b) with 100 * intersection >= percent * union of their full sets."""
    kind = pairs.schema["a"].dataType.simpleString()

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            good = []
            for left, right in zip(batch.column(2), batch.column(3)):
                a, b = (np.frombuffer(x.as_buffer(), np.uint64) for x in (left, right))
                good.append(_reach(a, b, percent))
            yield batch.select([0, 1]).filter(pa.array(good, pa.bool_()))

    full = pairs.join(sets.selectExpr("id AS b", "shingles AS set_b"), "b").join(
        sets.selectExpr("id AS a", "shingles AS set_a"), "a"
    )
    return full.select("a", "b", "set_a", "set_b").mapInArrow(compare, f"a {kind}, b {kind}")


def open_buckets(shared: DataFrame, pivots: DataFrame, parts: DataFrame, least: int, stage: Stage) -> DataFrame:
    """The rows of ``shared`` with new components, of buckets that hold several and more than ``least`` classes."""
    names = parts.selectExpr("id AS _id", "component AS _component")
    placed = shared.where(f"size > {least}").join(names, F.col("id") == F.col("_id"), "left")
    placed = placed.withColumn("component", F.coalesce("_component", "id")).drop("_id", "_component")
    drawn = pivots.select("_key", F.col("low.id").alias("_low"))
    placed = placed.join(drawn, F.col("key") == F.col("_key"), "left")
    used = F.col("used") | F.coalesce(F.col("id") == F.col("_low"), F.lit(False))
    placed = placed.withColumn("used", used).drop("_key", "_low")
    placed = stage.read(placed.schema, stage.write(placed, "placed"))
    several = placed.groupBy("key").agg(F.min("component").alias("_low"), F.max("component").alias("_high"))
    several = several.where("_low != _high").select(F.col("key").alias("_key"))
    several = stage.read(several.schema, stage.write(several, "several"))
    rows = placed.join(several, F.col("key") == F.col("_key"), "left_semi")
    return stage.read(rows.schema, stage.write(rows, "open"))


def minhash_dedup(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    shingle: int = SHINGLE,
    percent: int = PERCENT,
    bands: int = BANDS,
    rows: int = ROWS,
    rounds: int = ROUNDS,
    seed: int = 11,
    stage: Stage | None = None,
) -> DataFrame:
    """One row per row of ``docs``: id, ``n_shingles``, ``component_id``, ``kept``.

    Words are lower-cased in A-Z. Two texts are linked if their sets of ``shingle``-word
    shingles have 100 * intersection >= percent * union, counted on the full sets.

    Texts with equal sets form a class, so copies are never compared. Classes that share a
    band of minima meet in a bucket. Pairs whose sizes or signatures are too different go;
    the others are compared on their full sets. First, in ``rounds`` rounds, every class is
    compared to another one of its bucket, drawn by a hash, and the links found are joined
    into components. Buckets of up to ``rounds + 1`` classes are done with that. Then, in the
    larger ones that still hold several components, all pairs across components are compared;
    pairs inside a component need no test, because their link would join nothing. So a large
    group of near copies costs about as many pairs as it has members. A large bucket is
    compared in pairs of blocks of ``BLOCK`` classes. At the threshold a pair shares no band
    with probability (1 - s ** rows) ** bands: 4e-7 for 0.8 and 1e-9 for 0.85 with 28 bands of
    4. Signatures are off by more than ``MARGIN`` with about 1e-5.

    A null text is an empty one; a text without words is linked with nothing. Rows that
    share an id are one node. Null ids are linked with nothing. Other columns are ignored.
    No rows give no rows.
    """
    spark = docs.sparkSession
    stage = stage or Stage(spark)
    signed = signatures(docs, id_col, text_col, shingle, bands, rows, seed)
    signed = stage.read(signed.schema, stage.write(signed, "signatures"))
    digest = ["n", "d1", "d2"]
    classes = signed.where("n > 0 AND id IS NOT NULL").groupBy(*digest)
    classes = classes.agg(F.min("id").alias("id"), F.first("sig").alias("sig"), F.first("bands").alias("bands"))
    classes = stage.read(classes.schema, stage.write(classes, "classes"))

    banded = classes.select("id", F.posexplode("bands").alias("band", "key"))
    buckets = banded.groupBy("key").agg(F.count("*").alias("size")).where("size > 1").withColumnRenamed("key", "_key")
    buckets = stage.read(buckets.schema, stage.write(buckets, "buckets"))
    shared = banded.join(buckets, F.col("key") == F.col("_key")).drop("_key")
    facts = classes.select(F.col("id").alias("_id"), "n", "sig")
    shared = shared.join(facts, F.col("id") == F.col("_id")).drop("_id")
    shared = shared.withColumns({"component": F.col("id"), "used": F.lit(False)})
    shared = stage.read(shared.schema, stage.write(shared, "shared"))
    texts = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    kind = classes.schema["id"].dataType.simpleString()
    links = spark.createDataFrame([], f"a {kind}, b {kind}")
    parts = spark.createDataFrame([], f"id {kind}, component {kind}")

    def sets_of(ids: DataFrame) -> DataFrame:
        """The full sets of some classes; their texts are read again."""
        ids = ids.distinct()
        ids = stage.read(ids.schema, stage.write(ids, "ids"))
        sets = full_sets(keep_matching(texts, ids, F.col("id") == F.col("_id")), shingle)
        return stage.read(sets.schema, stage.write(sets, "sets"))

    for number in range(rounds + 1):
        if shared.isEmpty():
            break
        if number < rounds:
            # A few different draws for the bands, so that near copies meet a few classes each.
            draw = F.xxhash64(F.lit(number), F.col("band") % DRAWS, F.col("id"))
            low = F.min(F.struct(draw.alias("draw"), "id", "component", "n", "sig")).alias("low")
            pivots = shared.where("NOT used").groupBy(F.col("key").alias("_key")).agg(low)
            pivots = stage.read(pivots.schema, stage.write(pivots, "pivots"))
            apart = F.expr(
                f"""key = _key AND id != low.id AND component != low.component
                    AND 100 * least(n, low.n) >= {percent} * greatest(n, low.n)"""
            )
            stars = shared.join(pivots, apart).selectExpr(
                "least(id, low.id) AS a", "greatest(id, low.id) AS b", "sig AS sig_a", "low.sig AS sig_b"
            )
            pairs = agreeing(stars, percent)
            pairs = stage.read(pairs.schema, stage.write(pairs, "pairs"))
            sets = sets_of(pairs.selectExpr("a AS _id").union(pairs.selectExpr("b AS _id")))
            found = confirmed(pairs, sets, percent)
        else:
            blocks = F.ceil(F.col("size") / BLOCK)
            dealt = shared.withColumn("blocks", blocks).withColumn("block", F.pmod(F.xxhash64("id"), F.col("blocks")))
            dealt = dealt.withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)))
            dealt = dealt.withColumns({"left": F.least("block", "other"), "right": F.greatest("block", "other")})
            members = classes.select(F.col("id").alias("_id"), "bands")
            members = members.join(sets_of(shared.select(F.col("id").alias("_id"))).withColumnRenamed("id", "_id"), "_id")
            found = linked_in_buckets(dealt.join(members, F.col("id") == F.col("_id")), percent)
        found = stage.read(found.schema, stage.write(found, "links"))
        if not found.isEmpty():
            links = links.union(found)
            parts = components(links, stage).selectExpr("node AS id", "component")
        if number < rounds:
            shared = open_buckets(shared, pivots, parts, number + 2, stage)

    known = classes.select(*[F.col(c).alias(f"_{c}") for c in digest], "id").join(parts, "id", "left")
    known = known.select(*[f"_{c}" for c in digest], F.coalesce("component", "id").alias("component"))
    known = stage.read(known.schema, stage.write(known, "components"))
    same = (F.col("n") == F.col("_n")) & (F.col("d1") == F.col("_d1")) & (F.col("d2") == F.col("_d2"))
    component = F.when(F.col("id").isNotNull(), F.coalesce("component", "id"))
    return signed.select("id", *digest).join(known, same, "left").select(
        F.col("id").alias(id_col),
        F.col("n").alias("n_shingles"),
        component.alias("component_id"),
        F.col("id").eqNullSafe(component).alias("kept"),
    )
