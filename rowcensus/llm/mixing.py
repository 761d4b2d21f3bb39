"""Mixing sources to target weights by Sainte-Laguë apportionment of equal-token blocks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..sources.staging import Stage
from .words import WORD_PATTERN

BLOCK_WORDS = 64
SHARD_ROWS = 10_000
MOST_REPEATS = 3


def capped_targets(sources: DataFrame, most: int = MOST_REPEATS) -> DataFrame:
    """Add ``target`` to rows (source, source_size, weight).

    The targets share the sum of all sizes by weight; no target exceeds ``most`` times its
    source's size, and what is cut off is shared by weight among the rest until none is
    above. Walking the sources by the ratio of cap to weight, each is capped as long as its
    share of what the capped ones before it leave is more than its cap.
    """
    everything = W.rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    before = W.orderBy("ratio", "rank").rowsBetween(W.unboundedPreceding, -1)
    cap = most * F.col("source_size")
    ranked = sources.withColumn("ratio", cap / F.col("weight"))
    ranked = ranked.select(
        "*",
        (F.sum("source_size").over(everything) - F.coalesce(F.sum(cap).over(before), F.lit(0))).alias("left_size"),
        (F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(before), F.lit(0))).alias("left_weight"),
    )
    ranked = ranked.withColumn("level", F.col("left_size") / F.col("left_weight"))
    # The first source that keeps its share sets the level of all after it.
    level = F.min(F.when(F.col("ratio") >= F.col("level"), F.struct("ratio", "rank", "level"))).over(everything)
    target = F.least(cap.cast("double"), F.coalesce(level["level"], F.col("ratio")) * F.col("weight"))
    return ranked.withColumn("target", target).drop("ratio", "left_size", "left_weight", "level")


def sainte_lague(votes: DataFrame, group: list[str], unit: str, vote: str, seats: str, out: str) -> DataFrame:
    """Add ``out``: the seats of each unit of a group by the highest quotients vote / (2k + 1).

    ``seats`` is the number to allot in the group (the same in all of its rows). Rounding
    vote / d with d = votes / (seats - units / 2) never allots too many seats and leaves at
    most one per unit; those go to the highest quotients still open, ties to the smaller
    unit. Groups without votes allot nothing. Only one row per seat still open, and per unit
    and seat it may win of those, is ever made.
    """
    over = W.partitionBy(*group) if group else W.partitionBy(F.lit(0))
    total, units = F.sum(vote).over(over), F.count("*").over(over)
    exact = F.col(vote) * F.greatest(F.col(seats) - F.col("_units") / 2, F.lit(0)) / F.col("_total")
    held = votes.withColumns({"_total": total.cast("double"), "_units": units})
    held = held.withColumn("_held", F.when(F.col("_total") > 0, F.floor(exact + 0.5)).otherwise(0))
    held = held.withColumn("_open", F.when(F.col("_total") > 0, F.col(seats)).otherwise(0) - F.sum("_held").over(over))
    # Of the open seats a unit can win its share of as many as there are units, and one more.
    most = F.when(F.col("_open") > 0, F.ceil(F.col(vote) / F.col("_total") * F.col("_units")) + 1)
    tries = held.withColumn("_try", F.explode(F.sequence(F.lit(0), F.coalesce(most, F.lit(0)).cast("int"))))
    quotient = F.when(F.col("_total") > 0, F.col(vote) / (2 * (F.col("_held") + F.col("_try")) + 1)).otherwise(0.0)
    place = F.row_number().over(over.orderBy(F.desc("_quotient"), F.asc_nulls_last(unit), "_try"))
    won = tries.withColumn("_quotient", quotient).withColumn("_won", (place <= F.col("_open")).cast("long"))
    kept = [F.first(c).alias(c) for c in votes.columns if c not in (*group, unit)]
    counted = won.groupBy(*group, unit).agg(*kept, (F.first("_held") + F.sum("_won")).cast("long").alias(out))
    return counted.select(*votes.columns, out)


def cyclic_weights(rank: Column) -> Column:
    """1, 2, 3, repeating, for ranks from 1."""
    return (rank - 1) % 3 + 1


def mix_sources(
    docs: DataFrame,
    weights: DataFrame | None = None,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
    block_words: int = BLOCK_WORDS,
    shard_rows: int = SHARD_ROWS,
    most: int = MOST_REPEATS,
    seed: int = 7,
    stage: Stage | None = None,
) -> DataFrame:
    """One row per row of ``docs``: id, ``size``, ``source_size``, ``target``, ``taken``.

    ``weights`` gives (source, weight) with positive weights; without it, sources by code
    point, null last, weigh 1, 2, 3, repeating. A source missing from ``weights`` weighs 1.

    The words of all documents are divided into blocks of ``block_words``. Sainte-Laguë
    allots the blocks to sources by their targets, then each source's blocks to its shards
    by their words. A shard holds about ``shard_rows`` documents of one source, dealt by a
    hash, so a source of any size is spread over tasks. In a shard the documents stand in an
    order drawn by ``seed`` and their words form a line of blocks. A quota takes the whole
    line as often as it can (up to ``most`` times) and then blocks from its start. So all
    but one document of a shard are taken a whole number of times; that one is cut where the
    last block ends. ``taken`` counts words, repeats included, never above ``most`` * size.

    The same rows give the same result. A null text has no words; a source without words
    takes none. A null source is a source. Rows that repeat id and text are separate
    documents (their order does not matter, as they are alike). Other columns are ignored.
    No rows give no rows.
    """
    stage = stage or Stage(docs.sparkSession)
    size = F.regexp_count(F.coalesce(F.col(text_col), F.lit("")), F.lit(WORD_PATTERN)).cast("long")
    spread = F.xxhash64(F.lit(seed), F.col(id_col), F.col(text_col))
    names = [F.col(id_col).alias("id"), F.col(source_col).alias("source")]
    sized = docs.select(*names, size.alias("size"), spread.alias("draw"))
    sized = stage.read(sized.schema, stage.write(sized, "sizes"))

    sources = sized.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("_rows"))
    by_code = W.orderBy(F.asc_nulls_last("source"))
    sources = sources.withColumn("rank", F.row_number().over(by_code).cast("long"))
    if weights is None:
        sources = sources.withColumn("weight", cyclic_weights(F.col("rank")).cast("double"))
    else:
        given = weights.select(F.col("source").alias("_source"), F.col("weight").cast("double").alias("weight"))
        given = given.groupBy("_source").agg(F.max("weight").alias("weight"))
        sources = sources.join(given, F.col("source").eqNullSafe(F.col("_source")), "left").drop("_source")
        sources = sources.withColumn("weight", F.coalesce("weight", F.lit(1.0)))
    sources = capped_targets(sources, most)
    blocks = F.round(F.sum("source_size").over(W.partitionBy(F.lit(0))) / block_words).cast("long")
    sources = sainte_lague(sources.withColumn("blocks", blocks), [], "source", "target", "blocks", "quota")
    sources = sources.withColumn("shards", F.ceil(F.col("_rows") / shard_rows)).select(
        F.col("source").alias("_source"), "source_size", "target", "quota", "shards"
    )
    sources = stage.read(sources.schema, stage.write(sources, "sources"))

    dealt = sized.join(sources, F.col("source").eqNullSafe(F.col("_source"))).drop("_source", "quota")
    dealt = dealt.withColumn("shard", F.pmod(F.xxhash64("draw"), F.col("shards"))).drop("shards")
    quotas = dealt.groupBy("source", "shard").agg(F.sum("size").alias("words"))
    quotas = quotas.join(sources.select("_source", "quota"), F.col("source").eqNullSafe(F.col("_source"))).drop("_source")
    quotas = sainte_lague(quotas, ["source"], "shard", "words", "quota", "shard_quota")
    wanted = F.least(F.col("shard_quota") * block_words, most * F.col("words"))
    quotas = quotas.select(
        F.col("source").alias("_source"),
        F.col("shard").alias("_shard"),
        F.when(F.col("words") > 0, F.floor(wanted / F.col("words"))).otherwise(0).alias("rounds"),
        F.when(F.col("words") > 0, wanted % F.col("words")).otherwise(0).alias("rest"),
    )
    line = W.partitionBy("source", "shard").orderBy("draw", "id", "size").rowsBetween(W.unboundedPreceding, -1)
    placed = dealt.withColumn("before", F.coalesce(F.sum("size").over(line), F.lit(0)))
    on = F.col("source").eqNullSafe(F.col("_source")) & (F.col("shard") == F.col("_shard"))
    taken = F.col("rounds") * F.col("size") + F.greatest(
        F.lit(0), F.least(F.col("size"), F.col("rest") - F.col("before"))
    )
    return placed.join(quotas, on).select(
        F.col("id").alias(id_col), "size", "source_size", "target", taken.cast("long").alias("taken")
    )
