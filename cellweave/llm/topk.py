"""Exact nearest vectors by inner product of whole numbers, term at a time over postings.

Components are made whole, floor(scale * x).  A term is a component's index; its postings are the vectors of a batch
with another value than 0 there, and their weights.  For each term the rows of queries that have it scatter its
weighted postings into dense arrays of scores; terms that every vector of the batch has are added as whole columns.
Each task keeps the best of each query, found by partition around the last place that counts, and the tasks' lists
are merged by rank.  Queries go to the tasks in blocks of bounded size, one pass over all vectors for each; nothing is
approximated.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .clusterio import cut
from .ranking import in_order

BLOCK = 8_192  # queries sent to the tasks at a time
SIDE = 64  # queries scored together
SLICE = 4_096  # vectors scored together
LAST = np.iinfo(np.int64).max
FIELDS = [("query", pa.int64()), ("query_id", pa.int64()), ("copies", pa.int64()), ("vec_id", pa.int64()), ("score", pa.int64()), ("own", pa.bool_())]


def taking_part(vector: Column) -> Column:
    """Vectors that are there and have neither null nor non-finite components."""
    finite = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf")))
    return F.coalesce(F.forall(vector, lambda x: finite(x.cast("double"))), F.lit(False))


def whole(column, scale: int = 1024) -> np.ndarray:
    """floor(scale * x) of a list column as a matrix of whole doubles; short vectors end in zeros."""
    lengths = column.value_lengths().to_numpy(zero_copy_only=False)
    values = np.floor(scale * column.flatten().to_numpy(zero_copy_only=False).astype(np.float64))
    wide = int(lengths.max(initial=0))
    if len(lengths) * wide == len(values):
        return values.reshape(len(lengths), wide)
    out = np.zeros((len(lengths), wide))
    out[np.arange(wide) < lengths[:, None]] = values
    return out


def kind_for(queries: np.ndarray, vectors: np.ndarray):
    """The narrowest whole numbers that hold every partial sum."""
    shared = min(queries.shape[1], vectors.shape[1])
    most = sum(float(a) * float(b) for a, b in zip(np.abs(queries[:, :shared]).max(axis=0, initial=0), np.abs(vectors[:, :shared]).max(axis=0, initial=0), strict=True))
    largest = max(np.abs(queries).max(initial=0), np.abs(vectors).max(initial=0))
    return np.int32 if max(most, largest) < 2.0**31 else np.int64 if max(most, largest) < 2.0**62 else object


def as_kind(values: np.ndarray, kind) -> np.ndarray:
    return np.array([[int(x) for x in row] for row in values], object).reshape(values.shape) if kind is object else values.astype(kind)


def postings(vectors: np.ndarray) -> list[tuple[np.ndarray | None, np.ndarray]]:
    """For each term the vectors that have it (none stands for all of them) and their weights."""
    out = []
    for column in np.ascontiguousarray(vectors.T):
        rows = np.flatnonzero(column)
        out.append((None, column) if len(rows) == len(column) else (rows, column[rows]))
    return out


def accumulate(queries: np.ndarray, terms: list[tuple[np.ndarray | None, np.ndarray]], n: int) -> np.ndarray:
    """Scores of some queries with ``n`` vectors, added term after term; those beyond a long are held at its ends."""
    scores = np.zeros((len(queries), n), queries.dtype)
    scratch = np.empty_like(scores)
    for weights, (rows, values) in zip(queries.T, terms, strict=False):
        asked = np.flatnonzero(weights)
        if not len(asked) or not len(values):
            continue
        if rows is None and len(asked) == len(queries):
            np.multiply(weights[:, None], values[None, :], out=scratch)
            scores += scratch
        else:
            at = np.ix_(asked, np.arange(n) if rows is None else rows)
            scores[at] += weights[asked][:, None] * values[None, :]
    return np.clip(scores, -LAST, LAST).astype(np.int64) if scores.dtype == object else scores


class Best:
    """The ``k`` best (query, score, id) of some queries so far: higher scores first, then smaller ids, a null id last."""

    def __init__(self, n: int, k: int) -> None:
        self.n, self.k = n, k
        self.query, self.score, self.id, self.none = np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, bool)
        self.floor: np.ndarray | None = None  # the last score that counts, for each query with k already

    def add(self, scores: np.ndarray, ids: np.ndarray, none: np.ndarray) -> None:
        n = scores.shape[1]
        least = np.partition(scores, n - self.k, axis=1)[:, n - self.k] if n > self.k else np.full(len(scores), scores.min(initial=0))
        if self.floor is not None:
            least = np.maximum(least, self.floor)
        query, at = np.nonzero(scores >= least[:, None])
        score = np.concatenate([self.score, scores[query, at].astype(np.int64)])
        query = np.concatenate([self.query, query])
        ids, none = np.concatenate([self.id, ids[at]]), np.concatenate([self.none, none[at]])
        order = np.lexsort((ids, none, -score, query))
        query = query[order]
        place = np.arange(len(query)) - np.searchsorted(query, query)
        keep = order[place < self.k]
        self.query, self.score, self.id, self.none = query[place < self.k], score[keep], ids[keep], none[keep]
        if len(self.query) == self.n * self.k:
            self.floor = self.score.reshape(self.n, self.k)[:, -1]


class Block:
    """A block of queries: their vectors, ids, numbers, how often each occurs, and their scores with themselves."""

    def __init__(self, rows: list) -> None:
        wide = max((len(r.vector) for r in rows), default=0)
        self.vectors = np.zeros((len(rows), wide))
        for i, r in enumerate(rows):
            self.vectors[i, : len(r.vector)] = r.vector
        self.id = np.array([r.id for r in rows], np.int64)
        self.number = np.array([r.at for r in rows], np.int64)
        self.copies = np.array([r.copies for r in rows], np.int64)


def scorer(sent, k: int, scale: int):
    """Of the vectors that a task reads, the ``k`` + 1 best of each query (its own row may be one of them)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block: Block = sent.value
        asked = np.floor(scale * block.vectors)
        sides = [(i, min(i + SIDE, len(asked))) for i in range(0, len(asked), SIDE)]
        best = [Best(j - i, k + 1) for i, j in sides]
        for batch in batches:
            vectors = whole(batch.column(1), scale)
            none = batch.column(0).is_null().to_numpy(zero_copy_only=False)
            ids = batch.column(0).fill_null(LAST).to_numpy(zero_copy_only=False)
            for a in range(0, len(vectors), SLICE):
                part = vectors[a : a + SLICE]
                kind = kind_for(asked, part)
                terms = postings(as_kind(part, kind))
                for (i, j), keep in zip(sides, best, strict=True):
                    keep.add(accumulate(as_kind(asked[i:j], kind), terms, len(part)), ids[a : a + SLICE], none[a : a + SLICE])
        for (i, _), keep in zip(sides, best, strict=True):
            if len(keep.query):
                at = i + keep.query
                itself = np.array([min(sum(int(x) ** 2 for x in asked[q]), LAST) for q in range(i, i + keep.n)], np.int64)[keep.query]
                own = ~keep.none & (keep.id == block.id[at]) & (keep.score == itself)
                columns = [block.number[at], block.id[at], block.copies[at], pa.array(keep.id, mask=keep.none), keep.score, own]
                yield pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c, t) for c, (_, t) in zip(columns, FIELDS, strict=True)], [n for n, _ in FIELDS])

    return run


def merged(found: DataFrame, k: int) -> DataFrame:
    """The lists of all tasks as one for each query, without its own row.

    Rows that equal the query's own in id and score are alike in the result, so it does not matter which is left out.
    """
    by = W.partitionBy("query")
    ranked = found.withColumn("_place", F.row_number().over(by.orderBy(F.desc("score"), F.asc_nulls_last("vec_id")))).where(F.col("_place") <= k + 1)
    own = F.min(F.when(F.col("own"), F.col("_place"))).over(by)
    others = ranked.withColumn("_own", F.coalesce(own, F.lit(k + 1))).where("_place <> _own")
    others = others.withColumn("rank", (F.col("_place") - (F.col("_place") > F.col("_own")).cast("int")).cast("int"))
    return others.withColumn("_copy", F.explode(F.sequence(F.lit(1).cast("long"), "copies"))).select("query_id", "rank", "vec_id", "score")


def search(vectors: DataFrame, asked: Column, k: int = 10, *, key: str = "vec_id", vector: str = "embedding", scale: int = 1024, block: int = BLOCK) -> DataFrame:
    """For each row that ``asked`` accepts, the ``k`` other rows with the highest inner products: ``query_id``,
    ``rank`` (from 1), ``vec_id``, ``score``; all of them if there are fewer, equal scores to the smaller id.

    A row is a query only with an id.  Vectors that are null or hold null or non-finite components take no part; a
    vector of fewer components than another has zeros there, and one without any scores 0.  A null id comes after all
    others of its score.  Repeated rows are candidates and queries for themselves: a query that occurs n times has n
    lists.  Scores outside a long are held at its ends and tie there.  Queries are sent ``block`` at a
    time, each block in one more pass; rows of them do not meet otherwise.
    """
    spark = vectors.sparkSession
    rows = vectors.where(taking_part(F.col(f"`{vector}`"))).select(F.col(f"`{key}`").cast("long").alias("id"), F.col(f"`{vector}`").cast("array<double>").alias("vector"), F.coalesce(asked, F.lit(False)).alias("asked"))
    distinct = rows.where("asked and id is not null").groupBy("id", "vector").agg(F.count("*").alias("copies"))
    queries = cut(in_order(cut(distinct.withColumn("all", F.lit(""))), "all", ["id", "vector"]))
    light = vectors.where(taking_part(F.col(f"`{vector}`"))).select(F.col(f"`{key}`").cast("long"), F.col(f"`{vector}`"))
    schema = "query long, query_id long, copies long, vec_id long, score long, own boolean"
    blocks, found = -(-queries.count() // block), []
    for b in range(max(1, blocks)):
        held = queries.where(F.col("at").between(b * block, (b + 1) * block - 1)).collect()  # at most a block
        sent = spark.sparkContext.broadcast(Block(held))
        best = merged(light.mapInArrow(scorer(sent, k, scale), schema), k)
        found.append(cut(best) if blocks > 1 else best)
        if blocks > 1:
            sent.unpersist()
    return reduce(DataFrame.unionByName, found)
