"""Quality classifier: a linear-chain conditional random field over the lines of a text."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.staging import Stage
from .labelled import held_out, labelled_sample
from .words import Slice, find_words, slices

FIT_ROWS = 6_000
FIT_LINES = 400
THRESHOLD = 0.5
STEPS = 150
RIDGE = 1e-3

_NEWLINE = np.zeros(256, dtype=bool)
_NEWLINE[10] = True


def _table(letters: bytes) -> np.ndarray:
    found = np.zeros(256, dtype=bool)
    found[np.frombuffer(letters, dtype=np.uint8)] = True
    return found


_UPPER = _table(bytes(range(65, 91)))
_ALPHA = _UPPER | _table(bytes(range(97, 123)))
_DIGIT = _table(b"0123456789")
_SYMBOL = _table(b"#$%&*@^~<>=+_/\\{}[]")
_BAR = _table(b"|")
_SHOUT = _table(b"!?")
_PAUSE = _table(b",.;:")

#: What a line is described by, in this order.
FEATURES = (
    "log bytes", "log words", "word length", "capitals", "digits", "symbols", "bars", "shouts", "pauses",
    "ends a sentence", "starts with a capital", "repeats the word before", "distinct words", "line seen before",
    "distinct words of the text", "log lines of the text",
)


def line_features(words: Slice, lines: Slice) -> np.ndarray:
    """A row of ``FEATURES`` for every line of a slice."""
    data, starts, ends = lines.data, lines.starts, lines.ends
    n = len(starts)
    size = (ends - starts).astype(float)

    def share(table: np.ndarray, of: np.ndarray) -> np.ndarray:
        sums = np.concatenate(([0], np.cumsum(table[data])))
        return (sums[ends] - sums[starts]) / np.maximum(of, 1)

    letters = share(_ALPHA, np.ones(n))
    own = np.searchsorted(words.starts, np.append(starts, len(data)))
    count = np.diff(own).astype(float)
    hashes, line_of = words.hashes(), np.repeat(np.arange(n), np.diff(own))
    again = np.zeros(len(hashes))
    again[1:] = (hashes[1:] == hashes[:-1]) & (line_of[1:] == line_of[:-1])
    repeats = np.bincount(line_of, weights=again, minlength=n) / np.maximum(count - 1, 1)
    distinct = _distinct(line_of, hashes, n) / np.maximum(count, 1)
    doc_of_line, doc_of_word = lines.owners(), words.owners()
    in_text = _distinct(doc_of_word, hashes, len(lines)) / np.maximum(words.counts(), 1)
    order = np.lexsort((np.arange(n), lines.hashes(), doc_of_line))
    key = lines.hashes()[order]
    seen = np.zeros(n)
    seen[order[1:]] = (key[1:] == key[:-1]) & (doc_of_line[order][1:] == doc_of_line[order][:-1])
    return np.stack(
        [
            np.log1p(size) / 5,
            np.log1p(count) / 4,
            np.minimum(size / np.maximum(count, 1), 30) / 10,
            share(_UPPER, letters),
            share(_DIGIT, size),
            np.minimum(share(_SYMBOL, count), 3),
            np.minimum(share(_BAR, count), 3),
            np.minimum(share(_SHOUT, count), 3),
            np.minimum(share(_PAUSE, count), 3),
            np.isin(data[ends - 1], np.frombuffer(b".!?", np.uint8)).astype(float),
            _UPPER[data[starts]].astype(float),
            repeats,
            distinct,
            seen,
            in_text[doc_of_line],
            np.log1p(lines.counts()[doc_of_line]) / 4,
        ],
        axis=1,
    )


def _distinct(group: np.ndarray, values: np.ndarray, n: int) -> np.ndarray:
    """How many different values each group has."""
    order = np.lexsort((values, group))
    g, v = group[order], values[order]
    new = np.ones(len(g), dtype=bool)
    new[1:] = (g[1:] != g[:-1]) | (v[1:] != v[:-1])
    return np.bincount(g[new], minlength=n).astype(float)


def with_neighbours(rows: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Each line's own features, those of the lines before and after it, and a constant."""
    before, after = np.zeros_like(rows), np.zeros_like(rows)
    before[1:], after[:-1] = rows[:-1], rows[1:]
    heads, tails = first[:-1][np.diff(first) > 0], first[1:][np.diff(first) > 0] - 1
    before[heads], after[tails] = 0, 0
    return np.concatenate([rows, before, after, np.ones((len(rows), 1))], axis=1)


def described(column: pa.Array) -> Iterator[tuple[Slice, np.ndarray]]:
    """Lines of each slice of a text column and their features; blank lines don't count."""
    for words in slices(column):
        lines = find_words(words.data, words.bounds, words.row, between=_NEWLINE)
        yield lines, with_neighbours(line_features(words, lines), lines.first)


def chain(unary: np.ndarray, first: np.ndarray, links: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Forward-backward over many chains of two labels at once.

    ``unary`` is each line's score for the label good (bad scores 0), ``links[a, b]`` that of
    b after a. Returns the marginal of good for every line, the expected number of each pair
    of neighbouring labels, and the log normaliser of every chain. The chains advance
    together, so the number of steps is the length of the longest.
    """
    counts = np.diff(first)
    order = np.argsort(-counts, kind="stable")
    heads, lengths = first[:-1][order], counts[order]
    score = np.stack([np.zeros_like(unary), unary], axis=1)
    ahead, behind = score.copy(), np.zeros_like(score)
    longest = int(lengths[0]) if len(lengths) else 0
    for t in range(1, longest):
        at = heads[: np.searchsorted(-lengths, -t, side="left")] + t
        for b in (0, 1):
            ahead[at, b] += np.logaddexp(ahead[at - 1, 0] + links[0, b], ahead[at - 1, 1] + links[1, b])
    for t in range(longest - 2, -1, -1):
        at = heads[: np.searchsorted(-lengths, -(t + 1), side="left")] + t
        into = score[at + 1] + behind[at + 1]
        for a in (0, 1):
            behind[at, a] = np.logaddexp(into[:, 0] + links[a, 0], into[:, 1] + links[a, 1])
    both = ahead + behind
    norm = np.logaddexp(both[:, 0], both[:, 1])
    good = np.exp(both[:, 1] - norm)
    inner = np.ones(len(unary), dtype=bool)
    inner[first[:-1][counts > 0]] = False
    to = np.flatnonzero(inner)
    pairs = ahead[to - 1][:, :, None] + links[None] + (score[to] + behind[to])[:, None, :] - norm[to][:, None, None]
    totals = np.zeros(len(counts))
    totals[counts > 0] = norm[first[:-1][counts > 0]]
    return good, np.exp(pairs).sum(axis=0), totals


@dataclass
class QualityModel:
    """Weights of the line features, scores of neighbouring labels, and how features are scaled."""

    weights: np.ndarray
    links: np.ndarray
    mean: np.ndarray
    spread: np.ndarray

    def marginals(self, features: np.ndarray, first: np.ndarray) -> np.ndarray:
        """The probability of good for every line, given its whole text."""
        return chain(((features - self.mean) / self.spread) @ self.weights, first, self.links)[0]


def train(features: np.ndarray, first: np.ndarray, labels: np.ndarray, steps: int = STEPS) -> QualityModel:
    """Maximise the mean log likelihood per text by Adam; a text's label holds for its lines."""
    mean, spread = features.mean(axis=0), features.std(axis=0)
    constant = spread < 1e-9
    mean, spread = np.where(constant, 0, mean), np.where(constant, 1, spread)
    x = (features - mean) / spread
    counts = np.diff(first)
    y = np.repeat(labels, counts).astype(float)
    # A line weighs less in a long text, so that texts count alike.
    share = np.repeat(1 / np.maximum(counts, 1), counts)
    inner = np.ones(len(y), dtype=bool)
    inner[first[:-1][counts > 0]] = False
    to = np.flatnonzero(inner)
    seen = np.zeros((2, 2))
    np.add.at(seen, (y[to - 1].astype(int), y[to].astype(int)), 1)
    texts = max(1, len(counts))
    theta = np.zeros(x.shape[1] + 4)
    m, v = np.zeros_like(theta), np.zeros_like(theta)
    for step in range(1, steps + 1):
        weights, links = theta[:-4], theta[-4:].reshape(2, 2)
        good, pairs, _ = chain(x @ weights, first, links)
        gradient = np.concatenate([x.T @ (share * (y - good)), (seen - pairs).ravel() / max(1, len(to))])
        gradient[:-4] /= texts
        gradient -= RIDGE * theta
        m, v = 0.9 * m + 0.1 * gradient, 0.99 * v + 0.01 * gradient**2
        theta = theta + 0.1 * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-8)
    return QualityModel(theta[:-4], theta[-4:].reshape(2, 2), mean, spread)


def fit_quality(
    docs: DataFrame,
    labels: DataFrame,
    label_col: str = "quality",
    id_col: str = "doc_id",
    text_col: str = "text",
    fit_rows: int = FIT_ROWS,
    fit_lines: int = FIT_LINES,
    stage: Stage | None = None,
) -> QualityModel:
    """Learn from at most ``fit_rows`` labelled texts outside the held-out third.

    Texts of more than ``fit_lines`` lines are not drawn, so the features that reach the
    driver are bounded by both numbers. Without texts of both labels every line is good.
    """
    stage = stage or Stage(docs.sparkSession)
    sample = labelled_sample(docs, labels, label_col, id_col, text_col, fit_rows)
    sample = sample.where(F.regexp_count("text", F.lit("\n")) < fit_lines)

    def describe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lines_of, rows = [], []
            for lines, features in described(batch.column(1)):
                packed = features.astype(np.float32)
                for a, b in zip(lines.first[:-1].tolist(), lines.first[1:].tolist()):
                    lines_of.append(b - a)
                    rows.append(packed[a:b].tobytes())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(lines_of, pa.int64()), pa.array(rows, pa.binary())],
                names=["label", "lines", "features"],
            )

    drawn = sample.select("label", "text").mapInArrow(describe, "label int, lines long, features binary")
    drawn = stage.read(drawn.schema, stage.write(drawn, "lines")).where("lines > 0").orderBy("label", "features").toArrow()
    known = drawn["label"].to_numpy()
    width = 3 * len(FEATURES) + 1
    if len(set(known.tolist())) < 2:
        return QualityModel(np.append(np.zeros(width - 1), 4.0), np.zeros((2, 2)), np.zeros(width), np.ones(width))
    features = np.frombuffer(b"".join(drawn["features"].to_pylist()), dtype=np.float32).reshape(-1, width).astype(float)
    first = np.concatenate(([0], np.cumsum(drawn["lines"].to_numpy())))
    return train(features, first, known)


def text_scores(lines: Slice, features: np.ndarray, model: QualityModel) -> np.ndarray:
    """The score of each text of a slice."""
    return _weighted(lines, model.marginals(features, lines.first))


def _weighted(lines: Slice, good: np.ndarray) -> np.ndarray:
    """The mean of the lines' marginals, weighted by bytes; 0 for a text without lines."""
    owner, size, n = lines.owners(), (lines.ends - lines.starts).astype(float), len(lines)
    total = np.bincount(owner, weights=size, minlength=n)
    return np.clip(np.bincount(owner, weights=size * good, minlength=n) / np.maximum(total, 1), 0.0, 1.0)


def score_quality(docs: DataFrame, model: QualityModel, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: id, ``held_out``, ``score``, ``predicted``, ``lines``, ``bad_lines``.

    Every line gets its marginal probability of good; the score is their mean weighted by
    the bytes of the lines. A null text, or one without lines, scores 0. Null ids and
    repeated rows get a row each. Other columns are ignored.
    """
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    kind = rows.schema["id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lines, features in described(batch.column(1)):
                good = model.marginals(features, lines.first)
                n = len(lines)
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).slice(lines.row, n),
                        pa.array(_weighted(lines, good)),
                        pa.array(lines.counts().astype(np.int64)),
                        pa.array(np.bincount(lines.owners(), weights=good < 0.5, minlength=n).astype(np.int64)),
                    ],
                    names=["id", "score", "lines", "bad_lines"],
                )

    scored = rows.mapInArrow(run, f"id {kind}, score double, lines long, bad_lines long")
    return scored.select(
        F.col("id").alias(id_col),
        held_out(F.col("id")).alias("held_out"),
        "score",
        (F.col("score") >= THRESHOLD).cast("int").alias("predicted"),
        "lines",
        "bad_lines",
    )


def keep_good(docs: DataFrame, model: QualityModel, text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """The rows of ``docs``, with all their columns, whose text scores at least ``threshold``."""
    place = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            good = [text_scores(lines, features, model) for lines, features in described(batch.column(place))]
            if good:
                yield batch.filter(pa.array(np.concatenate(good) >= threshold))

    return docs.mapInArrow(run, docs.schema)
