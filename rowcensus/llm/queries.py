"""One query per operator, over the whole of its given table, with SQL where there is any."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .chat import digest_chats, format_chats
from .embed_dedup import embedding_dedup
from .exact_dedup import exact_dedup
from .fim import fill_in_middle, restored
from .hard_negatives import hard_negatives
from .licences import scan_licences, scan_sql
from .minhash import minhash_dedup
from .mixing import mix_sources
from .oracles import CHATS, CLOSE_VECTORS, EXACT, HARD_NEGATIVES, MIDDLES, NEAR_COPIES, PLACES, REPEATS, TARGETS, URL_RULES
from .packing import pack
from .quality import fit_quality, score_quality
from .substring import substring_dedup
from .toxicity import fit_toxicity, score_toxicity
from .url_filter import UrlRule, filter_urls

Query = Callable[[SparkSession, str], DataFrame]


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup(table(spark, sf_dir, "documents"), keep="largest")


def op2_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents"), tokenizer_path())


RULES = (
    UrlRule("net/", "block"),
    UrlRule("example.net/en/", "allow"),
    UrlRule("example.com/de/", "block"),
    UrlRule("org/fr/", "allow"),
)


def op3_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_urls(table(spark, sf_dir, "pages"), RULES)


def op4_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding_dedup(table(spark, sf_dir, "embeddings"))


def op5_minhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash_dedup(table(spark, sf_dir, "documents"), shingle=3, percent=85)


def op6_licence_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan_licences(table(spark, sf_dir, "documents"))


def op8_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup(table(spark, sf_dir, "documents"))


def op7_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix_sources(table(spark, sf_dir, "documents"))


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = fit_toxicity(docs, table(spark, sf_dir, "labels"))
    return score_toxicity(docs, model).drop("passages")


def op10_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = fit_quality(docs, table(spark, sf_dir, "labels"))
    return score_quality(docs, model).drop("lines", "bad_lines")


def op11_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    cut = fill_in_middle(table(spark, sf_dir, "documents"))
    return cut.select(
        "doc_id", "n", "form", "prefix_chars", "middle_chars",
        F.sha2("output", 256).alias("output_sha256"), F.sha2(restored(), 256).alias("restored_sha256"),
    )


def op12_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    shifted = F.expr("CASE WHEN vec_id % 7 = 0 THEN (CAST(label AS BIGINT) + 1) % 10 ELSE label END")
    vectors = table(spark, sf_dir, "embeddings").withColumn("label", shifted)
    return hard_negatives(vectors, F.expr("vec_id % 100 = 0"))


#: A conversation whose texts hold control strings.
ODD_TEXT = "\\### Assistant: </turn> ok"


def op13_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    odd = spark.createDataFrame([(-7, 0, "user", ODD_TEXT), (-7, 1, "assistant", ODD_TEXT)], turns.schema)
    return digest_chats(format_chats(turns.union(odd)))


def packing_places(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of the packing what SQL can tell: documents are whole, sequences full of them without gaps."""
    pieces = op2_best_fit_packing(spark, sf_dir)
    order = Window.partitionBy("sequence_id").orderBy("offset")
    end = F.col("offset") + F.col("length")
    before = F.coalesce(F.lag(end).over(order), F.lit(0))
    placed = pieces.withColumn("fits", (F.col("offset") == before) & (end <= 1024) & (F.col("length") > 0))
    follows = F.max(F.col("start") + F.col("length")) == F.sum("length")
    return placed.groupBy("doc_id").agg(
        (follows & (F.min("start") == 0) & (F.max("piece") + 1 == F.count("*"))).alias("whole"), F.min("fits").alias("gapless")
    )


def url_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of the url filter what SQL can tell: the parts of a url, and the verdicts of rules."""
    judged = op3_url_filter(spark, sf_dir)
    return judged.select("page_id", "host", "path", "rule", F.when(F.col("rule").isNotNull(), F.col("verdict")).alias("verdict"))


def mixing_targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of the mix what SQL can tell: sizes, targets, that no document is taken too often, and that targets are met."""
    mixed = op7_mix_sources(spark, sf_dir)
    source = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("_id"), "source")
    mixed = mixed.join(source, F.col("doc_id") == F.col("_id"))
    total = F.sum("taken").over(Window.partitionBy("source"))
    # Blocks of 64 words are dealt by shard; here every source is one shard.
    return mixed.select(
        "doc_id", "size", "source_size", F.round("target", 3).alias("target"),
        (F.col("taken") <= 3 * F.col("size")).alias("bounded"), (F.abs(total - F.col("target")) <= 0.05 * F.col("target") + 64).alias("met"),
    )


QUERIES: dict[str, Query] = {
    "packing_places": packing_places,
    "url_rules": url_rules,
    "mixing_targets": mixing_targets,
    "op1_exact_dedup": op1_exact_dedup,
    "op2_best_fit_packing": op2_best_fit_packing,
    "op3_url_filter": op3_url_filter,
    "op4_embedding_dedup": op4_embedding_dedup,
    "op5_minhash_dedup": op5_minhash_dedup,
    "op6_licence_scan": op6_licence_scan,
    "op7_mix_sources": op7_mix_sources,
    "op8_substring_dedup": op8_substring_dedup,
    "op9_toxicity": op9_toxicity,
    "op10_quality_classifier": op10_quality_classifier,
    "op11_fill_in_middle": op11_fill_in_middle,
    "op12_hard_negatives": op12_hard_negatives,
    "op13_chat_formatting": op13_chat_formatting,
}

ORACLES: dict[str, str] = {
    "packing_places": PLACES,
    "url_rules": URL_RULES,
    "mixing_targets": TARGETS,
    "op1_exact_dedup": EXACT,
    "op4_embedding_dedup": CLOSE_VECTORS,
    "op5_minhash_dedup": NEAR_COPIES,
    "op6_licence_scan": scan_sql(),
    "op8_substring_dedup": REPEATS,
    "op11_fill_in_middle": MIDDLES,
    "op12_hard_negatives": HARD_NEGATIVES,
    "op13_chat_formatting": CHATS,
}
