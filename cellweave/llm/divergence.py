"""Quality rules by distribution divergence.

Each language gets two reference histograms, counted over all of its documents:
one of character classes and one of words, hashed into ``buckets`` and kept for
the ``common`` fullest ones plus a rest.  A document fails if its own histogram
lies farther from the reference of its language than a threshold, by the
Jensen-Shannon distance (base 2, so 0 to 1).  A text too short for a histogram
to mean anything is not judged by it.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import bytespans as B
from . import textstats as S
from .clusterio import cut

BUCKETS = 8192


def _word_bucket(words: np.ndarray) -> np.ndarray:
    return (words % np.uint64(BUCKETS)).astype(np.int64)


def js_distance(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Jensen-Shannon distance of the rows of two arrays of counts; rows without counts have distance 0."""
    p = p / np.maximum(p.sum(axis=-1, keepdims=True), 1e-300)
    q = q / np.maximum(q.sum(axis=-1, keepdims=True), 1e-300)
    m = (p + q) / 2
    with np.errstate(divide="ignore", invalid="ignore"):
        part = lambda a: np.where(a > 0, a * np.log2(a / m), 0.0).sum(axis=-1)
        half = (part(p) + part(q)) / 2
    return np.sqrt(np.clip(np.where((p.sum(axis=-1) > 0) & (q.sum(axis=-1) > 0), half, 0.0), 0, 1))


def references(docs: DataFrame, *, text: str = "text", lang: str = "lang", common: int = 200, max_langs: int = 1000) -> dict[str, tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Of each language: counts of classes, its common buckets, counts of these and of the rest.

    Tasks add up their own counts first; what comes to the driver is bounded by languages x (buckets + classes).
    Null languages are left out; more than ``max_langs`` languages, as in a column that holds something else, are refused.
    Words that share one of the ``BUCKETS`` buckets count together: of n different words, one shares its bucket with some
    other with a chance of 1 - (1 - 1 / BUCKETS) ** (n - 1), but a rare word adds little to a common one's count.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        width = BUCKETS + S.N_CLASSES
        total: dict[str, np.ndarray] = {}
        for batch in B.chunked(batches, "t", B.LESS):
            names = pd.Series(batch.column("l").to_pylist(), dtype=object)
            code, langs = pd.factorize(names)
            texts = B.Texts(batch.column("t"))
            starts, ends, at = texts.runs(B.NOT_BLANK[texts.data])
            words = B.SpanHash(B.BYTE_CODE[B.LOWER[texts.data]]).of(starts, ends)
            one = np.bincount(code[B.owner(at)] * BUCKETS + _word_bucket(words), minlength=len(langs) * BUCKETS).reshape(-1, BUCKETS)
            classes = S.class_counts(texts)
            for k, name in enumerate(langs):
                total[name] = total.get(name, np.zeros(width, np.int64)) + np.concatenate([one[k], classes[code == k].sum(axis=0)])
        for name, counts in total.items():
            at = np.flatnonzero(counts)
            yield pa.RecordBatch.from_arrays([pa.array([name] * len(at), pa.string()), pa.array(at, pa.int64()), pa.array(counts[at], pa.int64())], ["l", "k", "n"])

    rows = docs.select(F.col(f"`{lang}`").alias("l"), F.col(f"`{text}`").alias("t")).where("l is not null")
    found = cut(rows.mapInArrow(run, "l string, k long, n long").groupBy("l", "k").agg(F.sum("n").alias("n")))
    if found.select("l").distinct().limit(max_langs + 1).count() > max_langs:
        raise ValueError(f"more than {max_langs} languages in {lang}")
    out = {}
    for name, part in found.toPandas().groupby("l"):
        counts = np.zeros(BUCKETS + S.N_CLASSES)
        counts[part.k.to_numpy()] = part.n.to_numpy()
        words = counts[:BUCKETS]
        top = np.sort(np.lexsort((np.arange(BUCKETS), -words))[:common])
        out[str(name)] = (counts[BUCKETS:], top, np.append(words[top], words.sum() - words[top].sum()))
    return out


def judge(docs: DataFrame, refs: dict, *, text: str = "text", lang: str = "lang", max_class: float = 0.3, max_words: float = 0.58, min_chars: int = 500, min_words: int = 100) -> DataFrame:
    """``docs`` with the base counts, ``class_distance``, ``word_distance``, ``base_failed`` and ``kept``.

    A document of an unknown or null language is held against the nearest reference; without references, or below
    ``min_chars`` bytes or ``min_words`` words, the distance is null and fails nothing.  Null texts are empty.
    Columns of the made names are replaced.
    """
    made = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, class_distance double, word_distance double"
    names = [x.split()[0] for x in made.split(", ")]
    base = docs.drop(*names, "base_failed", "kept")
    schema = base.selectExpr("*", *[f"cast(null as {x.split()[1]}) as {x.split()[0]}" for x in made.split(", ")]).schema
    sent = docs.sparkSession.sparkContext.broadcast(refs)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        refs = sent.value
        for batch in B.chunked(batches, text, B.LESS):
            c = S.Counts(batch.column(text))
            n = c.texts.n
            langs = batch.column(lang).to_pylist()
            low = B.SpanHash(B.BYTE_CODE[B.LOWER[c.texts.data]]).of(c.starts, c.ends)
            bucket, classes = _word_bucket(low), S.class_counts(c.texts)
            far = np.full((2, n), np.inf)
            for name, (ref_class, top, ref_words) in refs.items():
                mine = np.array([x == name or x not in refs for x in langs], bool)
                if not mine.any():
                    continue
                place = np.full(BUCKETS, len(top))
                place[top] = np.arange(len(top))
                row = np.cumsum(mine) - 1
                words = np.flatnonzero(mine[c.doc])
                own = np.bincount(row[c.doc[words]] * (len(top) + 1) + place[bucket[words]], minlength=mine.sum() * (len(top) + 1)).reshape(-1, len(top) + 1)
                far[0, mine] = np.minimum(far[0, mine], js_distance(classes[mine], ref_class))
                far[1, mine] = np.minimum(far[1, mine], js_distance(own, ref_words))
            far[0, np.diff(c.texts.offs) < min_chars] = np.inf
            far[1, c.n_words < min_words] = np.inf
            columns = [c.n_words, c.word_chars, c.n_symbols, c.n_dup_lines, c.n_repeat_words]
            yield pa.RecordBatch.from_arrays([*batch.columns, *[pa.array(x, pa.int64()) for x in columns], *[pa.array(x, pa.float64(), mask=~np.isfinite(x)) for x in far]], [*batch.schema.names, *names])

    failed = (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))
    apart = (F.coalesce("class_distance", F.lit(0.0)) > max_class) | (F.coalesce("word_distance", F.lit(0.0)) > max_words)
    return base.mapInArrow(run, schema).withColumn("base_failed", failed).withColumn("kept", ~F.col("base_failed") & ~apart)
