"""Exact deduplication: equal texts by a 128-bit content hash, confirmed byte by byte."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.staging import Stage

DIGEST = "unhex(md5(body))"


def exact_dedup(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    keep: str = "smallest",
    digest: str = DIGEST,
    stage: Stage | None = None,
) -> DataFrame:
    """One row per row of ``docs``: id, ``keep_id``, ``group_size``, ``kept``, ``text_sha256``.

    Rows with equal texts form a group, and the row with the smallest (or ``"largest"``) id
    stays. Texts are grouped by a 128-bit digest and, inside it, by their bytes, which are
    combined in each task before the shuffle: of a group of copies, however large, every
    task sends one. The groups without their texts are stored, and the rows, now only
    (id, digest), are joined to them on the digest. If one digest stands for several texts,
    the join compares the texts as well. ``digest`` is an SQL expression over ``body``.

    A null text is an empty one. A null id never wins against another; a group of only null
    ids keeps them. Rows that repeat an id within a group are all kept or all dropped. Other
    columns of ``docs`` are ignored, so their names cannot clash. No rows give no rows.
    """
    if keep not in ("smallest", "largest"):
        raise ValueError("keep is 'smallest' or 'largest'")
    stage = stage or Stage(docs.sparkSession)
    rows = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("body"))
    rows = rows.withColumn("digest", F.expr(digest))
    chosen = F.min("id") if keep == "smallest" else F.max("id")
    texts = rows.groupBy("digest", "body").agg(chosen.alias("keep_id"), F.count("*").alias("group_size"))
    groups = texts.select("digest", "keep_id", "group_size", F.sha2("body", 256).alias("text_sha256"))
    path = stage.write(groups, "texts")
    groups = stage.read(groups.schema, path)

    if groups.groupBy("digest").count().where("count > 1").isEmpty():
        joined = rows.select("id", "digest").join(groups, "digest")
    else:
        joined = rows.join(texts.withColumn("text_sha256", F.sha2("body", 256)), ["digest", "body"])
    return joined.select(
        F.col("id").alias(id_col),
        "keep_id",
        "group_size",
        F.col("id").eqNullSafe(F.col("keep_id")).alias("kept"),
        "text_sha256",
    )
