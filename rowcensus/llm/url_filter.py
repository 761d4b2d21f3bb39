"""URL filters: path rules first, else naive Bayes over segmented host words and path tokens."""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.staging import Stage

LONGEST_WORD = 24
#: Pseudo count of every token in either class.
SMOOTHING = 0.1

# Words that mark a host as unwanted; the training labels come from them.
SEED_WORDS = (
    "adult", "porn", "sex", "xxx", "nude", "escort", "casino", "bet", "bets", "betting", "poker", "slots", "gambling",
    "lottery", "jackpot", "pill", "pills", "viagra", "cialis", "spam", "scam", "phishing", "malware", "warez", "torrent",
    "payday", "ads", "adserver",
)


@dataclass(frozen=True)
class UrlRule:
    """``where`` is a host, a slash and the start of a path; it holds for all subdomains."""

    where: str
    verdict: str

    @property
    def host(self) -> str:
        return self.where.partition("/")[0]

    @property
    def path(self) -> str:
        return self.where[len(self.host) :]


def url_parts(pages: DataFrame, id_col: str, url_col: str) -> DataFrame:
    """Rows (page_id, host, path, path_key); a url that is null or without ``://`` has empty parts."""
    url = F.col(url_col)
    rest = F.when(F.instr(url, "://") > 0, F.substring(url, F.instr(url, "://") + 3, F.length(url)))
    rest = F.coalesce(rest, F.lit(""))
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    host = F.translate(F.regexp_extract(rest, "^[^/?#]*", 0), upper, upper.lower())
    path = F.regexp_extract(rest, "^[^/?#]*([^?#]*)", 1)
    parts = pages.select(F.col(id_col).alias("page_id"), host.alias("host"), path.alias("path"))
    # Digits carry no topic: every number is one token.
    key = F.regexp_replace(F.lower("path"), "[0-9]+", " 0 ")
    return parts.withColumn("path_key", F.trim(F.regexp_replace(key, "[^a-z0]+", " ")))


_HIDDEN = re.compile(rb"(?i)<(script|style)\b")
_HIDDEN_ENDS = {name: re.compile(rb"(?i)</" + name + rb"\s*>") for name in (b"script", b"style")}


def visible(html: bytes) -> Iterator[bytes]:
    """The pieces of a page between its tags, without scripts, styles and comments.

    One walk forward. What opens a comment, script or style and is never closed counts as a
    tag; after a ``<`` without any ``>`` all is text. That a closer does not follow is
    remembered, so it is searched for once.
    """
    at, missing = 0, set()
    while (start := html.find(b"<", at)) >= 0:
        yield html[at:start]
        end = -1
        hidden = _HIDDEN.match(html, start)
        name = hidden.group(1).lower() if hidden else b"--" if html.startswith(b"<!--", start) else None
        if name is not None and name not in missing:
            if hidden:
                closer = _HIDDEN_ENDS[name].search(html, hidden.end())
                end = closer.end() if closer else -1
            elif (found := html.find(b"-->", start + 4)) >= 0:
                end = found + 3
            if end < 0:
                missing.add(name)
        if end < 0:
            end = html.find(b">", start + 1) + 1
        if not end:
            yield html[start + 1 :]
            return
        at = end
    yield html[at:]


def text_words(pages: DataFrame, html_col: str) -> DataFrame:
    """Rows (word, count): runs of a-z in the visible text of all pages, up to ``LONGEST_WORD``."""
    runs = re.compile(rb"[a-z]+")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            seen: Counter[bytes] = Counter()
            for text in batch.column(0).cast(pa.binary()):
                if text.is_valid:
                    for piece in visible(text.as_py()):
                        seen.update(w for w in runs.findall(piece.lower()) if len(w) <= LONGEST_WORD)
            yield pa.RecordBatch.from_arrays(
                [pa.array([w.decode() for w in seen], pa.string()), pa.array(list(seen.values()), pa.int64())],
                names=["word", "count"],
            )

    counted = pages.select(html_col).mapInArrow(count, "word string, count long")
    return counted.groupBy("word").agg(F.sum("count").alias("count"))


def viterbi(name: str, counts: dict[str, int], total: int) -> list[str]:
    """The most probable split of ``name`` under a unigram model.

    A part that is no known word has the probability 1 / (total * 10 ** (2 * its length)), so
    unknown names stay in one piece where no words cover them, and short words of little
    evidence don't cut them up.
    """
    best, back = [0.0], [0]
    for end in range(1, len(name) + 1):
        options = []
        for start in range(max(0, end - LONGEST_WORD), end):
            n = counts.get(name[start:end])
            p = math.log(n / total) if n else -math.log(total) - (end - start) * math.log(100)
            options.append((best[start] + p, -start))
        value, start = max(options)
        best.append(value)
        back.append(-start)
    words, end = [], len(name)
    while end:
        words.append(name[back[end] : end])
        end = back[end]
    return words[::-1]


def segmented(names: DataFrame, words: DataFrame, total: int) -> DataFrame:
    """Rows (name, words) for distinct names of a-z.

    The model never leaves Spark: the substrings of all names are joined to the word counts,
    and each name is split with the counts of its own substrings.
    """
    spans = F.expr(
        f"""explode(flatten(transform(sequence(1, length(name)), s ->
            transform(sequence(1, least({LONGEST_WORD}, length(name) - s + 1)), n -> substring(name, s, n)))))"""
    )
    parts = names.where("name != ''").select("name", spans.alias("word")).distinct()
    known = parts.join(words, "word").groupBy("name").agg(F.collect_list(F.struct("word", "count")).alias("known"))

    @F.pandas_udf("array<string>")
    def split(name: pd.Series, known: pd.Series) -> pd.Series:
        found = []
        for text, rows in zip(name, known):
            counts = {} if rows is None else {r["word"]: int(r["count"]) for r in rows}
            found.append(viterbi(text, counts, total))
        return pd.Series(found)

    joined = names.where("name != ''").join(known, "name", "left")
    return joined.select("name", split("name", "known").alias("words"))


def host_rules(hosts: DataFrame, rules: Sequence[UrlRule]) -> DataFrame:
    """Rows (host, rules): the rules for the host or a domain above it, longest first."""
    spark = hosts.sparkSession
    rows = [(r.host, -len(r.where), r.path, r.where, r.verdict) for r in rules]
    table = spark.createDataFrame(rows, "rule_host string, order int, rule_path string, rule string, verdict string")
    labels = F.split("host", r"\.")
    above = F.expr("transform(sequence(1, size(labels)), i -> array_join(slice(labels, i, size(labels)), '.'))")
    spread = hosts.withColumn("labels", labels).select("host", F.explode(above).alias("rule_host"))
    found = spread.join(table, "rule_host").groupBy("host")
    return found.agg(F.array_sort(F.collect_list(F.struct("order", "rule_path", "rule", "verdict"))).alias("rules"))


def filter_urls(
    pages: DataFrame,
    rules: Sequence[UrlRule] = (),
    id_col: str = "page_id",
    url_col: str = "url",
    html_col: str = "html",
    seeds: Sequence[str] = SEED_WORDS,
    stage: Stage | None = None,
) -> DataFrame:
    """One row per page: ``page_id``, ``host``, ``path``, ``rule``, ``verdict``, ``score``.

    The longest rule that fits a url decides it. The others are judged by multinomial naive
    Bayes: ``score`` is the log odds of being unwanted, above 0 is a block. Host names are
    split into words by Viterbi under unigram counts of the visible words of all pages, and
    by nothing else: a name that these words do not cover stays whole. The training label of
    a page is whether one of its host words, as a whole, is one of ``seeds``; what else such
    hosts and paths contain is learned. A token counts as often as it occurs. Words of more
    than ``LONGEST_WORD`` letters are not learned, and a longer name without known words is
    several tokens.

    Words, hosts and paths are counted over all pages; names are segmented once each, and
    pages are joined to the scores of their host and path. A null or odd url has an empty
    host and path and is judged on the prior alone. Null ids and repeated pages get a row
    each. A null html adds no words. Other columns are ignored. No rows give no rows.
    """
    spark = pages.sparkSession
    stage = stage or Stage(spark)
    parts = url_parts(pages, id_col, url_col)
    hosts = parts.groupBy("host").agg(F.count("*").alias("pages"))
    hosts = stage.read(hosts.schema, stage.write(hosts, "hosts"))

    words = text_words(pages, html_col)
    words = stage.read(words.schema, stage.write(words, "words"))
    total = words.agg(F.sum("count")).first()[0] or 1

    runs = F.regexp_extract_all("host", F.lit("[a-z]+"), F.lit(0))
    placed = hosts.select("host", F.explode(runs).alias("name"))
    split = segmented(placed.select("name").distinct(), words, total)
    split = stage.read(split.schema, stage.write(split, "names"))
    host_words = placed.join(split, "name").groupBy("host")
    host_words = host_words.agg(F.flatten(F.collect_list("words")).alias("words"))
    no_words = F.array().cast("array<string>")
    host_words = hosts.join(host_words, "host", "left").withColumn("words", F.coalesce("words", no_words))
    unwanted = F.arrays_overlap("words", F.array(*[F.lit(w) for w in seeds])) if seeds else F.lit(False)
    host_words = host_words.withColumn("unwanted", unwanted)
    host_words = stage.read(host_words.schema, stage.write(host_words, "host-words"))

    counts = parts.join(host_words.select("host", "unwanted"), "host").groupBy("path_key", "unwanted").count()
    counts = stage.read(counts.schema, stage.write(counts, "paths"))
    in_path = F.explode(F.split("path_key", " ")).alias("token")
    in_paths = counts.select(in_path, "unwanted", F.col("count").alias("n")).where("token != ''")
    seen = host_words.select(F.explode("words").alias("token"), "unwanted", F.col("pages").alias("n")).union(in_paths)
    bad = F.sum(F.when(F.col("unwanted"), F.col("n")).otherwise(0))
    good = F.sum(F.when(~F.col("unwanted"), F.col("n")).otherwise(0))
    tokens = seen.groupBy("token").agg(bad.alias("bad"), good.alias("good"))
    tokens = stage.read(tokens.schema, stage.write(tokens, "tokens"))
    size, all_bad, all_good = tokens.agg(F.count("*"), F.sum("bad"), F.sum("good")).first()
    extra = SMOOTHING * (size + 1)
    likelier = (F.col("bad") + SMOOTHING) / ((all_bad or 0) + extra)
    odds = F.log(likelier) - F.log((F.col("good") + SMOOTHING) / ((all_good or 0) + extra))
    tokens = tokens.select("token", odds.alias("odds"))
    n_bad, n_good = counts.withColumn("n", F.col("count")).agg(bad, good).first()
    prior = math.log(((n_bad or 0) + 1) / ((n_good or 0) + 1))

    def scored(rows: DataFrame, key: str, array: str) -> DataFrame:
        """Rows (key, <key>_score): the summed log odds of an array's tokens."""
        each = rows.select(key, F.explode(array).alias("token")).join(tokens, "token")
        return each.groupBy(key).agg(F.sum("odds").alias(f"{key}_score"))

    by_host = hosts.select("host").join(scored(host_words, "host", "words"), "host", "left")
    by_host = by_host.join(host_rules(hosts, rules), "host", "left")
    by_host = stage.read(by_host.schema, stage.write(by_host, "by-host"))
    keys = counts.select("path_key").distinct().withColumn("_tokens", F.split("path_key", " "))
    by_path = scored(keys, "path_key", "_tokens")
    by_path = stage.read(by_path.schema, stage.write(by_path, "by-path"))

    fitting = F.expr("try_element_at(filter(rules, r -> startswith(path, r.rule_path)), 1)")
    judged = parts.join(by_host, "host", "left").join(by_path, "path_key", "left").withColumn("found", fitting)
    score = F.coalesce("host_score", F.lit(0.0)) + F.coalesce("path_key_score", F.lit(0.0)) + F.lit(prior)
    verdict = F.coalesce(F.col("found.verdict"), F.when(score > 0, "block").otherwise("allow"))
    rule = F.col("found.rule").alias("rule")
    return judged.select(
        F.col("page_id").alias(id_col), "host", "path", rule, verdict.alias("verdict"), score.alias("score")
    )
