"""A corpus from documents to packed sequences: five stages, each one operator."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rowcensus.functions.text import quoted
from rowcensus.llm.exact_dedup import exact_dedup
from rowcensus.llm.joins import keep_matching
from rowcensus.llm.minhash import minhash_dedup
from rowcensus.llm.mixing import mix_sources
from rowcensus.llm.packing import pack
from rowcensus.llm.quality import fit_quality, keep_good
from rowcensus.llm.queries import tokenizer_path
from rowcensus.sources.staging import Stage, passing_stages

Step = Callable[[SparkSession, DataFrame, str], DataFrame]


def _free(docs: DataFrame, name: str) -> str:
    """A name for a helper column that no column of ``docs`` has."""
    taken = {c.lower() for c in docs.columns}
    while name in taken:
        name = f"_{name}"
    return name


def _survivors(docs: DataFrame, decisions: DataFrame) -> DataFrame:
    """The rows of ``docs`` whose id has a decision to keep it; null ids are compared too."""
    stage, own = Stage(docs.sparkSession), _free(docs, "_id")
    kept = decisions.where("kept").select(F.col("doc_id").alias(own)).distinct()
    kept = stage.read(kept.schema, stage.write(kept, "kept"))
    return keep_matching(docs, kept, F.col("doc_id").eqNullSafe(F.col(own)))


def good_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts that the classifier rejects go; it learns from the labels of the input.

    Null and empty texts score 0 and go. Rows that repeat an id are judged by their own
    texts, null ids too. Without labels of both kinds every text with a line is good. No
    rows give no rows, and all columns are kept.
    """
    return keep_good(docs, fit_quality(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))


def one_of_each_text(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the smallest doc_id stays.

    A null text equals an empty one. Rows that repeat both id and text stay or go together,
    and a null id stays only where no other row has its text. No rows give no rows.
    """
    return _survivors(docs, exact_dedup(docs))


def one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of texts linked by five-word shingles at 0.8 the smallest doc_id stays.

    Texts without words, and rows with a null id, are linked with nothing and stay. Rows
    that share an id are one node of the links, and stay or go together.
    """
    return _survivors(docs, minhash_dedup(docs))


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document as often as the mix takes it, always whole.

    The mix takes words, so its last document of a source and shard may end within a text:
    it is taken once more if at least half of it was, else not. A source's words then miss
    its target by half a document per shard at most. Documents without words are not taken;
    rows that share an id, null ids among them, are taken alike, as often as the most taken
    one.
    """
    stage, own, times = Stage(spark), _free(docs, "_id"), _free(docs, "_times")
    rounded = "taken DIV size + IF(2 * (taken % size) >= size, 1, 0)"
    shares = mix_sources(docs).where("taken > 0").selectExpr("doc_id", f"CAST({rounded} AS INT) AS times")
    shares = shares.groupBy("doc_id").agg(F.max("times").alias(times)).where(F.col(times) > 0).withColumnRenamed("doc_id", own)
    shares = stage.read(shares.schema, stage.write(shares, "shares"))
    joined = keep_matching(docs, shares, F.col("doc_id").eqNullSafe(F.col(own)), "inner")
    taken = joined.withColumn(own, F.explode(F.array_repeat(F.lit(1), F.col(times))))
    return taken.select(*[F.col(quoted(c)) for c in docs.columns])


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Where each piece of each document goes in sequences of 1024 tokens.

    A null text is a piece of one token, the end. Every row is a document, whatever its id.
    """
    return pack(docs, tokenizer_path())


STAGES: list[tuple[str, Step]] = [
    ("quality_classifier", good_quality),
    ("exact_dedup", one_of_each_text),
    ("minhash_dedup", one_of_each_group),
    ("mix_sources", mixed),
    ("best_fit_packing", packed),
]

# The classifier, the drawn order of the mix and the tokens are beyond SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents; each is written and read again for the next one.

    What a stage stored on its way is removed once its result is written.
    """
    stage = Stage(spark)
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, step in STAGES[:-1]:
        with passing_stages():
            result = step(spark, docs, sf_dir)
            docs = stage.read(result.schema, stage.write(result, name))
    return STAGES[-1][1](spark, docs, sf_dir)
