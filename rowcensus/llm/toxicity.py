"""Toxicity: maximum-scoring segments of token log odds, with extreme-value calibration."""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.staging import Stage
from .labelled import held_out, labelled_sample
from .words import NOT_LETTERS, Slice, slices

FIT_ROWS = 20_000
PREFIX_BYTES = 4
#: Texts that must hold a word before its first letters have no say.
SURE_TEXTS = 8
THRESHOLD = 0.7
#: Standard errors that a token's log odds are lowered by.
CAUTION = 2.0
#: Pseudo texts of the Dirichlet prior: shared out by frequency, and for each token.
PRIOR, PRIOR_EACH = 1.0, 0.5


@dataclass
class ToxicityModel:
    """Scores of known tokens by their hash, and the constants of the calibration.

    ``known`` holds hashes of the words seen in training, ``score`` their lowered log odds and
    ``sure`` whether many texts hold them; other words take the score of their first letters
    if it is higher. A word without a positive score costs ``drift``. ``rate`` and ``scale`` are the parameters of the
    extreme-value law of segment scores in clean texts; ``slope`` and ``offset`` turn the
    summed evidence into a probability.
    """

    known: np.ndarray
    score: np.ndarray
    sure: np.ndarray
    prefixes: np.ndarray
    prefix_score: np.ndarray
    drift: float = 0.05
    rate: float = 1.0
    scale: float = 0.1
    slope: float = 1.0
    offset: float = -1.0

    def token_scores(self, part: Slice) -> np.ndarray:
        """The positive score of every word of a slice, or 0."""
        words = part.hashes()
        found = np.zeros(len(words))
        hit, at = _lookup(self.known, words)
        found[hit] = self.score[at]
        weak = ~hit
        weak[hit] = ~self.sure[at]
        new = np.flatnonzero(weak)
        begin = part.starts[new]
        letters = Slice(0, part.data, part.bounds, begin, np.minimum(begin + PREFIX_BYTES, part.ends[new]), part.first)
        hit, at = _lookup(self.prefixes, letters.hashes())
        found[new[hit]] = np.maximum(found[new[hit]], self.prefix_score[at])
        return np.maximum(found, 0.0)

    def evidence(self, found: list[tuple[int, int, float]], words: int) -> float:
        """Summed bits by which the segments exceed what a clean text of this length shows."""
        expected = math.log(max(self.scale * max(words, 1), 1e-9))
        return sum(max(0.0, self.rate * s - expected) for _, _, s in found)

    def probability(self, evidence: float) -> float:
        return 1.0 / (1.0 + math.exp(-max(-50.0, min(50.0, self.slope * evidence + self.offset))))


def _lookup(known: np.ndarray, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    if not len(known):
        return np.zeros(len(keys), dtype=bool), np.zeros(0, dtype=np.int64)
    at = np.minimum(np.searchsorted(known, keys), len(known) - 1)
    hit = known[at] == keys
    return hit, at[hit]


def segments(places: list[int], scores: list[float], drift: float) -> list[tuple[int, int, float]]:
    """All maximal scoring segments (first, last, score) of a sequence, in one pass.

    ``places`` are the positions with positive ``scores``; every other position scores
    ``-drift``. A stack holds the candidates with the running total before and after each,
    and the latest candidate below that starts lower. A new one joins that candidate, if it
    also ends higher than it, and takes all in between with it. Following these links, a
    candidate is passed over once, so the time is linear.
    """
    stack: list[tuple[int, int, float, float, int]] = []
    total, before = 0.0, -1
    for place, score in zip(places, scores):
        total -= drift * (place - before - 1)
        first, low, high = place, total, total + score
        k = len(stack) - 1
        while True:
            while k >= 0 and stack[k][2] >= low:
                k = stack[k][4]
            if k < 0 or stack[k][3] >= high:
                stack.append((first, place, low, high, k))
                break
            first, low, link = stack[k][0], stack[k][2], stack[k][4]
            del stack[k:]
            k = link
        total, before = high, place
    return [(a, b, h - l) for a, b, l, h, _ in stack]


def text_segments(column: pa.Array, model: ToxicityModel) -> Iterator[tuple[int, list[tuple[int, int, float]]]]:
    """For each text: its number of words and its maximal segments."""
    for part in slices(column, lower=True, between=NOT_LETTERS):
        scores = model.token_scores(part)
        hits = np.flatnonzero(scores > 0)
        edges = np.searchsorted(hits, part.first).tolist()
        first, counts = part.first.tolist(), part.counts().tolist()
        for i, words in enumerate(counts):
            own = hits[edges[i] : edges[i + 1]]
            yield words, segments((own - first[i]).tolist(), scores[own].tolist(), model.drift) if len(own) else []


def _token_counts(sample: DataFrame) -> dict[str, tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Per kind (word, prefix): hashes and the numbers of clean and toxic texts that hold them."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            label = batch.column(1).to_numpy(zero_copy_only=False)
            for part in slices(batch.column(0), lower=True, between=NOT_LETTERS):
                owner = part.owners()
                ends = np.minimum(part.starts + PREFIX_BYTES, part.ends)
                short = Slice(0, part.data, part.bounds, part.starts, ends, part.first)
                for kind, hashes in ((0, part.hashes()), (1, short.hashes())):
                    pairs = np.unique(np.stack([hashes.view(np.int64), owner], axis=1), axis=0)
                    marks = label[pairs[:, 1] + part.row]
                    tokens, inverse = np.unique(pairs[:, 0], return_inverse=True)
                    toxic = np.bincount(inverse, weights=marks, minlength=len(tokens)).astype(np.int64)
                    every = np.bincount(inverse, minlength=len(tokens))
                    yield pa.RecordBatch.from_arrays(
                        [
                            pa.array(np.full(len(tokens), kind, dtype=np.int32)),
                            pa.array(tokens),
                            pa.array(every - toxic),
                            pa.array(toxic),
                        ],
                        names=["kind", "token", "clean", "toxic"],
                    )

    counted = sample.select("text", "label").mapInArrow(count, "kind int, token long, clean long, toxic long")
    counted = counted.groupBy("kind", "token").agg(F.sum("clean").alias("clean"), F.sum("toxic").alias("toxic"))
    # Tokens of a single text tell nothing yet.
    rows = counted.where("clean + toxic > 1").toArrow()
    kinds = rows["kind"].to_numpy()
    arrays = [rows[c].to_numpy() for c in ("token", "clean", "toxic")]
    return {name: tuple(x[kinds == k] for x in arrays) for k, name in enumerate(("word", "prefix"))}


def _lowered_odds(clean: np.ndarray, toxic: np.ndarray, n_clean: int, n_toxic: int) -> np.ndarray:
    """Log odds ratio of holding a token, with a Dirichlet prior, less ``CAUTION`` standard errors."""
    prior = PRIOR_EACH + PRIOR * (clean + toxic) / max(1, n_clean + n_toxic)
    whole = PRIOR + 2 * PRIOR_EACH
    odds = np.log((toxic + prior) / (n_toxic + whole)) - np.log((clean + prior) / (n_clean + whole))
    return odds - CAUTION * np.sqrt(1 / (toxic + prior) + 1 / (clean + prior))


def fit_toxicity(
    docs: DataFrame,
    labels: DataFrame,
    label_col: str = "toxic",
    id_col: str = "doc_id",
    text_col: str = "text",
    fit_rows: int = FIT_ROWS,
    stage: Stage | None = None,
) -> ToxicityModel:
    """Learn from at most ``fit_rows`` labelled texts outside the held-out third.

    One half of the sample gives the token scores, the other, where these are honest, the
    calibration; copies of a text count once and fall into the same half. The model is
    bounded by the sample. Without any toxic text nothing scores.
    """
    stage = stage or Stage(docs.sparkSession)
    sample = labelled_sample(docs, labels, label_col, id_col, text_col, fit_rows)
    sample = stage.read(sample.schema, stage.write(sample, "sample"))
    tuning = F.pmod(F.xxhash64("text"), F.lit(2)) == 1
    learn = sample.where(~tuning)
    n = {label: count for label, count in learn.groupBy("label").count().collect()}
    n_clean, n_toxic = n.get(0, 0), n.get(1, 0)
    tables = {}
    for kind, (tokens, clean, toxic) in _token_counts(learn).items():
        order = np.argsort(tokens.view(np.uint64))
        odds = _lowered_odds(clean, toxic, n_clean, n_toxic) if n_toxic else np.zeros(len(tokens))
        tables[kind] = (tokens.view(np.uint64)[order], odds[order], (clean + toxic)[order] >= SURE_TEXTS)
    model = ToxicityModel(*tables["word"], *tables["prefix"][:2])
    return _calibrated(model, sample.where(tuning)) if n_toxic else model


def _calibrated(model: ToxicityModel, tuning: DataFrame) -> ToxicityModel:
    """Set drift, the extreme-value law and the probability from the other half of the sample."""
    rows = tuning.select("label", "text")

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            total, words = [], []
            for part in slices(batch.column(1), lower=True, between=NOT_LETTERS):
                cumulated = np.concatenate(([0.0], np.cumsum(model.token_scores(part))))
                total.append(np.diff(cumulated[part.first]))
                words.append(part.counts())
            arrays = [np.concatenate(x) if x else np.zeros(0) for x in (total, words)]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(arrays[0].astype(float)), pa.array(arrays[1].astype(np.int64))],
                names=["label", "total", "words"],
            )

    clean = rows.where("label = 0").mapInArrow(sums, "label int, total double, words long")
    total, words = clean.agg(F.sum("total"), F.sum("words")).first()
    model.drift = max(0.02, 3.0 * (total or 0.0) / max(1, words or 0))

    def found(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lengths, all_scores = [], []
            for n, own in text_segments(batch.column(1), model):
                lengths.append(n)
                all_scores.append([s for _, _, s in own])
            columns = [pa.array(lengths, pa.int64()), pa.array(all_scores, pa.list_(pa.float64()))]
            yield pa.RecordBatch.from_arrays([batch.column(0), *columns], names=["label", "words", "scores"])

    seen = rows.mapInArrow(found, "label int, words long, scores array<double>").toPandas()
    ordinary = seen[seen.label == 0]
    scores = np.array([s for own in ordinary.scores for s in own])
    # Segment scores of clean texts beyond a low bar decay exponentially: the law's rate is
    # one over their mean excess, its scale their number per word at score 0.
    bar = float(np.quantile(scores, 0.5)) if len(scores) else 0.0
    beyond = scores[scores >= bar]
    model.rate = float(np.clip(len(beyond) / max(1e-9, (beyond - bar).sum()), 0.2, 5.0)) if len(beyond) else 1.0
    model.scale = float(max(1, len(beyond)) / max(1, ordinary.words.sum()) * math.exp(model.rate * bar))
    evidence = np.array([model.evidence([(0, 0, s) for s in own], n) for own, n in zip(seen.scores, seen.words)])
    model.slope, model.offset = _logistic(evidence, seen.label.to_numpy(dtype=float))
    return model


def _logistic(x: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Slope (not negative) and offset of a logistic curve, as if both labels were equally common.

    By Newton steps with a small ridge.
    """
    weights = np.zeros(2)
    share = np.where(y == 1, 0.5 / max(1.0, y.sum()), 0.5 / max(1.0, (1 - y).sum())) * len(y)
    matrix = np.stack([x, np.ones_like(x)], axis=1)
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(matrix @ weights, -50, 50)))
        gradient = matrix.T @ (share * (y - p)) - 0.05 * weights
        curvature = (matrix * (share * p * (1 - p))[:, None]).T @ matrix + 0.05 * np.eye(2)
        step = np.linalg.solve(curvature, gradient)
        weights += np.clip(step, -2, 2)
        if np.abs(step).max() < 1e-6:
            break
    return float(max(weights[0], 0.0)), float(weights[1])


def score_toxicity(docs: DataFrame, model: ToxicityModel, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: id, ``held_out``, ``score``, ``predicted``, ``passages``.

    ``passages`` lists the maximal segments whose score exceeds what a clean text of that
    length shows, as (first word, last word, score); words are runs of letters. A null or
    empty text has none and gets the lowest score. Null ids and repeated rows get a row
    each. Other columns are ignored.
    """
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    kind = rows.schema["id"].dataType.simpleString()
    shape = pa.list_(pa.struct([("first", pa.int32()), ("last", pa.int32()), ("score", pa.float64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            scores, passages = [], []
            for words, own in text_segments(batch.column(1), model):
                scores.append(model.probability(model.evidence(own, words)))
                passages.append([s for s in own if model.evidence([s], words) > 0])
            listed = pa.array([[{"first": a, "last": b, "score": s} for a, b, s in own] for own in passages], shape)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(scores, pa.float64()), listed], names=["id", "score", "passages"]
            )

    scored = rows.mapInArrow(
        run, f"id {kind}, score double, passages array<struct<first: int, last: int, score: double>>"
    )
    return scored.select(
        F.col("id").alias(id_col),
        held_out(F.col("id")).alias("held_out"),
        "score",
        (F.col("score") >= THRESHOLD).cast("int").alias("predicted"),
        "passages",
    )
