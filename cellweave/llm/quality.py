"""Quality classifier: Bradley-Terry ranking of documents from preference pairs.

Labelled documents of either class form preference pairs (the good one is
preferred).  The strength of a document is linear in its features, so the
probability that one is preferred is the logistic function of the difference of
their features; Newton steps minimise the logistic loss on these differences.
A document is accepted if its strength reaches a quantile of the training
strengths.

The model is fitted on a bounded sample of labelled rows (``max_rows``, drawn by
hash of the id) whose features Spark computes; scoring is one pass over all
documents with nothing but the weights sent along.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import bytespans as B
from . import textstats as S


def features(column: pa.Array) -> np.ndarray:
    """A row of features for each text of the column; all of them shares, means or logarithms."""
    c = S.Counts(column)
    texts, n_docs = c.texts, c.texts.n
    classes = S.class_counts(texts).astype(float)
    size = np.maximum(np.diff(texts.offs), 1)[:, None]
    words, lines = np.maximum(c.n_words, 1), np.maximum(c.n_lines, 1)
    letters = np.maximum(texts.per_text(S.LETTER[texts.data]), 1)
    upper = texts.per_text(S.UPPER[texts.data])
    _, later = B.repeated(c.doc, c.words)
    same_next = np.zeros(len(c.words), bool)
    same_next[1:] = (c.words[1:] == c.words[:-1]) & (c.doc[1:] == c.doc[:-1])
    length = c.ends - c.starts
    first, last = texts.data[c.starts], texts.data[c.ends - 1]
    by_word = lambda mask: np.bincount(c.doc[mask], minlength=n_docs) / words
    upper_sums = np.concatenate([[0], np.cumsum(S.UPPER[texts.data])])
    letter_sums = np.concatenate([[0], np.cumsum(S.LETTER[texts.data])])
    letters_in, upper_in = letter_sums[c.ends] - letter_sums[c.starts], upper_sums[c.ends] - upper_sums[c.starts]
    punctuation = np.stack([texts.per_text(texts.data == b) / size[:, 0] for b in b".,!?;:|'\"-_/()[]{}@=+~^\\`"], axis=1)
    columns = [
        *(classes / size).T,
        *(np.sqrt(classes / size)).T,
        *np.sqrt(punctuation).T,
        upper / letters,
        c.n_symbols / words,
        np.sqrt(c.n_dup_lines / lines),
        np.sqrt(c.n_repeat_words / words),
        np.bincount(c.doc[later], minlength=n_docs) / words,
        np.sqrt(by_word(same_next)),
        np.log1p(c.n_words),
        np.log1p(lines),
        np.log1p(c.n_words / lines),
        c.word_chars / words,
        np.sqrt(np.bincount(c.doc, weights=(length - (c.word_chars / words)[c.doc]) ** 2, minlength=n_docs) / words),
        by_word(length == 1),
        by_word(length > 20),
        by_word(letters_in == 0),
        by_word((upper_in > 1) & (upper_in == letters_in)),
        by_word(S.UPPER[first]),
        by_word(S.MARK[last] & ~S.SYMBOLS[last]),
        by_word(S.SYMBOLS[last]),
        (c.n_words == 0).astype(float),
    ]
    return np.stack(columns, axis=1)


@dataclass(frozen=True)
class Ranking:
    """Weights on standardised features, and the strength at which documents are accepted."""

    mean: np.ndarray
    scale: np.ndarray
    weights: np.ndarray
    cut: float

    def strength(self, x: np.ndarray) -> np.ndarray:
        return np.clip((x - self.mean) / self.scale, -8, 8) @ self.weights

    def score(self, x: np.ndarray) -> np.ndarray:
        """In (0, 1) and increasing in the strength; 0.5 at the cut."""
        return 1 / (1 + np.exp(-np.clip(self.strength(x) - self.cut, -30, 30)))


def fit_pairs(x: np.ndarray, good: np.ndarray, *, pairs: int = 60_000, penalty: float = 1e-3, seed: int = 7) -> Ranking:
    """Bradley-Terry weights by Newton's method on the logistic loss of the differences of preference pairs.

    The cut is the quantile of the strengths that puts the fewest labelled rows on the wrong side.
    With one class only there is no pair: every document gets the strength 0 and is accepted, unless all are bad.
    """
    mean = x.mean(axis=0) if len(x) else np.zeros(x.shape[1])
    scale = np.maximum(x.std(axis=0), 1e-6) if len(x) else np.ones(x.shape[1])
    up, down = np.flatnonzero(good), np.flatnonzero(~good)
    if not len(up) or not len(down):
        return Ranking(mean, scale, np.zeros(x.shape[1]), 1.0 if len(down) else 0.0)
    z = np.clip((x - mean) / scale, -8, 8)
    draw = np.random.default_rng(seed)
    each = max(pairs, len(up), len(down))  # every labelled row is in some pair
    winner = np.concatenate([up, draw.choice(up, each)])
    loser = np.concatenate([draw.choice(down, len(up)), np.resize(down, each)])
    d = z[winner] - z[loser]
    w = np.zeros(d.shape[1])
    for _ in range(30):
        p = 1 / (1 + np.exp(np.clip(d @ w, -40, 40)))  # of the wrong order
        gradient = penalty * w - d.T @ p / len(d)
        hessian = (d.T * (p * (1 - p))) @ d / len(d) + penalty * np.eye(len(w))
        step = np.linalg.solve(hessian, gradient)
        w -= step
        if np.abs(step).max() < 1e-7:
            break
    s = z @ w
    order = np.argsort(s, kind="stable")
    wrong = np.concatenate([[0], np.cumsum(good[order])]) + np.concatenate([np.cumsum(~good[order][::-1])[::-1], [0]])
    edges = np.concatenate([[s[order[0]] - 1], (s[order][1:] + s[order][:-1]) / 2, [s[order[-1]] + 1]])
    best = np.flatnonzero(wrong == wrong.min())
    return Ranking(mean, scale, w, float(edges[best[len(best) // 2]]))


def train(docs: DataFrame, labels: DataFrame, *, doc_id: str = "doc_id", text: str = "text", label: str = "quality", max_rows: int = 20_000, **how) -> Ranking:
    """Fit on at most ``max_rows`` labelled rows, the first by hash of their ids; null labels and ids are left out."""
    chosen = labels.select(F.col(doc_id).alias("i"), F.col(label).cast("int").alias("y")).where("i is not null and y is not null").orderBy(F.xxhash64("i"), "i", "y").limit(max_rows)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in B.chunked(batches, "t", B.LESS):
            rows = features(batch.column("t"))
            yield pa.RecordBatch.from_arrays([batch.column("y"), batch.column("i"), pa.array(list(rows), pa.list_(pa.float64()))], ["y", "i", "x"])

    texts = docs.select(F.col(doc_id).alias("i"), F.col(text).alias("t"))
    found = texts.join(F.broadcast(chosen), "i").select("i", "y", "t")
    found = found.mapInArrow(run, found.select("y", "i", F.array(F.lit(0.0)).alias("x")).schema)
    rows = found.toArrow()
    width = features(pa.array([""])).shape[1]
    x = np.array(rows["x"].to_pylist(), float).reshape(-1, width)
    y, i = np.asarray(rows["y"]), rows["i"].to_numpy()
    order = np.lexsort((x.sum(axis=1), y, i)) if len(i) else np.zeros(0, int)
    return fit_pairs(x[order], y[order] > 0, **how)


def score(docs: DataFrame, model: Ranking, *, text: str = "text") -> DataFrame:
    """``docs`` with ``score`` (double in (0, 1)) and ``predicted`` (1 where the score is 0.5 or more, else 0).

    Every row is scored on its whole text, null as the empty text; columns of those names are replaced.
    """
    base = docs.drop("score", "predicted")
    schema = base.withColumn("score", F.lit(0.0)).schema
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in B.chunked(batches, text, B.LESS):
            got = sent.value.score(features(batch.column(text)))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(got, pa.float64())], [*batch.schema.names, "score"])

    return base.mapInArrow(run, schema).withColumn("predicted", (F.col("score") >= 0.5).cast("int"))


def remainder(doc_id: F.Column, by: int) -> F.Column:
    """crc32 of the id's decimal text, modulo ``by``; null ids have none."""
    return F.crc32(doc_id.cast("string")) % by


def keep_good(docs: DataFrame, labels: DataFrame, **how) -> DataFrame:
    """The documents that the fitted ranking accepts, with their own columns."""
    return score(docs, train(docs, labels, **how)).where("predicted = 1").select(*[F.col(f"`{c}`") for c in docs.columns])
