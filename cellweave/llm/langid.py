"""Language identification: multinomial naive Bayes over hashed character n-grams.

Training counts the n-grams of all training documents in tasks and sums them in
Spark; the driver gets one row for each language and bucket.  The matrix of
log-probabilities (languages x buckets) is broadcast.  A batch of texts is a
sparse matrix of n-gram indices whose product with it numpy takes by gathering
entries and summing them by document, language after language.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import bytespans as B
from .clusterio import cut

BUCKETS = 16384
ORDERS = (1, 2, 3)
CHUNK = 1 << 20


STEP = 4 << 20  # characters whose n-grams are hashed at once


@functools.cache
def _letters() -> np.ndarray:
    """Which code points are letters."""
    return np.fromiter((chr(x).isalpha() for x in range(0x110000)), bool, 0x110000)


def has_letter(text: str | None) -> bool:
    return bool(text) and any(map(str.isalpha, text))


def grams(texts: list[str | None]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Hashed n-grams of the lower-cased texts, each padded with a blank on both sides, and the text of each n-gram.

    Runs of characters that are not letters count as one blank.  One piece for each n; a longer text comes in several.
    """
    padded = [f" {(t or '').lower()} " for t in texts]
    points = np.frombuffer("".join(padded).encode("utf-32-le", "surrogatepass"), np.uint32)
    letter = _letters()[points]
    size = np.fromiter(map(len, padded), np.int64, len(padded))
    stay = np.ones(len(points), bool)
    stay[1:] = letter[1:] | letter[:-1]
    stay[np.cumsum(size)[:-1]] = True
    kept = np.concatenate([[0], np.cumsum(stay, dtype=np.int64)])
    offs = kept[np.concatenate([[0], np.cumsum(size)])]
    points = np.where(letter, points, np.uint32(32))[stay]
    for s in range(0, len(points), STEP):
        for n in ORDERS:
            e = min(s + STEP, len(points) - n + 1)
            if e <= s:
                continue
            h = np.full(e - s, n, np.uint64)
            for k in range(n):
                h += points[s + k : e + k]
                h *= np.uint64(0x9E3779B97F4A7C15)
                h ^= h >> np.uint64(29)
            first, last = np.searchsorted(offs, [s, e - 1], "right") - 1
            doc = np.repeat(np.arange(first, last + 1), np.diff(np.clip(offs[first : last + 2], s, e)))
            index = ((h >> np.uint64(20)).astype(np.uint32) % np.uint32(BUCKETS)).astype(np.int64)
            whole = np.ones(e - s, bool)
            for k in range(1, n):  # n-grams that would run into the next text
                over = offs[first + 1 : last + 2] - k - s
                whole[over[(over >= 0) & (over < e - s)]] = False
            yield doc[whole], index[whole]


@dataclass(frozen=True)
class NaiveBayes:
    langs: list[str]
    prior: np.ndarray  # log, per language
    table: np.ndarray  # log, buckets x languages

    @functools.cached_property
    def columns(self) -> np.ndarray:
        return np.ascontiguousarray(self.table.T)

    def predict(self, texts: list[str | None]) -> tuple[list[str], np.ndarray]:
        if not self.langs:
            return ["und"] * len(texts), np.zeros(len(texts))
        joint = np.tile(self.prior, (len(texts), 1))
        for doc, index in grams(texts):  # sums of each text by itself, so that its batch makes no difference
            for k in range(len(self.langs)):
                joint[:, k] += np.bincount(doc, self.columns[k][index], len(texts))
        best = joint.argmax(axis=1)
        p = 1 / np.exp(joint - joint.max(axis=1, keepdims=True)).sum(axis=1)
        names = [self.langs[k] if has_letter(t) else "und" for k, t in zip(best, texts, strict=True)]
        return names, np.where([x == "und" for x in names], 0.0, p)


def train(docs: DataFrame, *, text: str = "text", lang: str = "lang", smoothing: float = 0.5, max_langs: int = 1000) -> NaiveBayes:
    """Fit on every row of ``docs`` whose language is not null (texts without letters add their document only).

    The matrix goes to every task, so more than ``max_langs`` languages, as in a column that holds something else, are
    refused rather than cut.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[str, np.ndarray] = {}
        for batch in B.chunked(batches, "t", CHUNK):
            code, langs = pd.factorize(pd.Series(batch.column("l").to_pylist(), dtype=object))
            counts = np.zeros((len(langs), BUCKETS), np.int64)
            for doc, index in grams(batch.column("t").to_pylist()):
                counts += np.bincount(code[doc] * BUCKETS + index, minlength=counts.size).reshape(counts.shape)
            for k, name in enumerate(langs):
                total[name] = total.get(name, np.zeros(BUCKETS + 1, np.int64)) + np.append(counts[k], (code == k).sum())
        for name, counts in total.items():
            at = np.flatnonzero(counts)
            yield pa.RecordBatch.from_arrays([pa.array([name] * len(at), pa.string()), pa.array(at, pa.int64()), pa.array(counts[at], pa.int64())], ["l", "k", "n"])

    rows = docs.select(F.col(f"`{lang}`").alias("l"), F.col(f"`{text}`").alias("t")).where("l is not null")
    found = cut(rows.mapInArrow(run, "l string, k long, n long").groupBy("l", "k").agg(F.sum("n").alias("n")))
    if found.select("l").distinct().limit(max_langs + 1).count() > max_langs:
        raise ValueError(f"more than {max_langs} languages in {lang}")
    found = found.toPandas()
    langs = sorted(found.l.unique())
    counts = np.zeros((BUCKETS + 1, len(langs)))
    counts[found.k.to_numpy(), pd.Categorical(found.l, categories=langs).codes] = found.n.to_numpy()
    inside = counts[:BUCKETS] + smoothing
    share = counts[BUCKETS] / max(counts[BUCKETS].sum(), 1)
    return NaiveBayes(langs, np.log(np.maximum(share, 1e-12)), np.log(inside / inside.sum(axis=0)))


def identify(docs: DataFrame, model: NaiveBayes, *, text: str = "text") -> DataFrame:
    """``docs`` with ``lang_pred`` and ``score``, the posterior of the predicted language.

    A null text, or one without a letter, is ``und`` with score 0, as is every text if nothing was learned.
    Ties go to the first language by name; columns of those names are replaced.
    """
    base = docs.drop("lang_pred", "score")
    schema = base.select("*", F.lit("").alias("lang_pred"), F.lit(0.0).alias("score")).schema
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in B.chunked(batches, text, CHUNK):
            names, p = sent.value.predict(batch.column(text).to_pylist())
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(names, pa.string()), pa.array(p, pa.float64())], [*batch.schema.names, "lang_pred", "score"])

    return base.mapInArrow(run, schema)
