"""Bounded samples of labelled texts, and the third of the ids that is never learned from."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def held_out(id_col: Column) -> Column:
    """True for ids whose crc32, taken of their text form, leaves 1 when divided by 3."""
    return F.coalesce(F.crc32(id_col.cast("string")) % 3 == 1, F.lit(False))


def labelled_sample(
    docs: DataFrame, labels: DataFrame, label_col: str, id_col: str, text_col: str, rows: int
) -> DataFrame:
    """Rows (label, text) of at most ``rows`` labelled texts that are not held out.

    Half of them at most have label 1, the rest label 0, each drawn by a hash of the id.
    The ids are few by this bound and are broadcast to the documents, whose texts need not
    move. Equal texts count once, with the larger label; null texts are left out.
    """
    usable = labels.select(F.col(id_col).alias("_id"), F.col(label_col).cast("int").alias("label"))
    usable = usable.where(F.col("_id").isNotNull() & F.col("label").isin(0, 1) & ~held_out(F.col("_id")))
    drawn = usable.where("label = 1").orderBy(F.xxhash64("_id"), "_id").limit(rows // 2)
    drawn = drawn.union(usable.where("label = 0").orderBy(F.xxhash64("_id"), "_id").limit(rows - rows // 2))
    texts = docs.select(F.col(id_col).alias("_own"), F.col(text_col).alias("text")).where("text IS NOT NULL")
    sample = texts.join(F.broadcast(drawn), F.col("_own") == F.col("_id"))
    return sample.select("label", "text").groupBy("text").agg(F.max("label").alias("label"))
