"""Exact search against all pairs, with nulls, ties, repeats, short, sparse and very large vectors."""

import math
import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from cellweave.llm import topk


def plain(rows, asked, k):
    ready = [(i, [math.floor(1024 * x) for x in v]) for i, v in rows if v is not None and all(x is not None and math.isfinite(x) for x in v)]
    out = []
    for q, (qid, a) in enumerate(ready):
        if qid is None or not asked(qid):
            continue
        scores = [(min(max(sum(x * y for x, y in zip(a, b)), 1 - 2**63), 2**63 - 1), c) for j, (c, b) in enumerate(ready) if j != q]  # noqa: B905
        scores.sort(key=lambda s: (-s[0], s[1] is None, s[1] or 0))
        out += [(qid, r + 1, c, s) for r, (s, c) in enumerate(scores[:k])]
    return sorted(out, key=repr)


def table(kind):
    rnd = random.Random(3)
    vec = lambda: [rnd.uniform(-1, 1) for _ in range(8)]
    rows = [(i, vec()) for i in range(120)]
    if kind == "odd":
        same = rows[5][1]
        rows += [(200 + i, same) for i in range(40)] + [rows[10], rows[10], (20, vec()), (None, same), (None, vec()), (300, None), (301, [1.0, None] + [0.0] * 6), (302, [float("nan")] * 8), (303, [float("inf")] + [0.0] * 7)]
        rows += [(310, []), (320, [0.5]), (330, [0.0] * 8), (340, [0.0, 0.0, 1.0] + [0.0] * 5)] + [(400 + i, [0.0] * 7 + [float(i % 3)]) for i in range(30)]
    if kind == "large":
        rows += [(500 + 10 * i, [rnd.uniform(-1, 1) * 10 ** rnd.choice([0, 6, 8, 25]) for _ in range(8)]) for i in range(20)]
    return rows


@pytest.mark.parametrize("kind,block", [("plain", 8192), ("odd", 8192), ("odd", 5), ("large", 8192)])
def test_search_equals_all_pairs(spark, kind, block):
    rows = table(kind)
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumns({"query": F.lit(1), "score": F.lit("x"), "at": F.lit(2)}).repartition(3)
    got = topk.search(df, F.col("vec_id") % 10 == 0, 10, block=block)
    assert got.columns == ["query_id", "rank", "vec_id", "score"]
    assert sorted((tuple(r) for r in got.collect()), key=repr) == plain(rows, lambda i: i % 10 == 0, 10)


def test_fewer_candidates_than_asked_for_and_none(spark):
    df = spark.createDataFrame([(0, [1.0]), (1, [2.0]), (2, [2.0])], "vec_id long, embedding array<float>")
    assert [tuple(r) for r in topk.search(df, F.col("vec_id") == 0).orderBy("rank").collect()] == [(0, 1, 1, 2**21), (0, 2, 2, 2**21)]
    assert topk.search(df, F.lit(False)).count() == 0
    assert topk.search(df.where("false"), F.lit(True)).count() == 0


def test_terms_scatter_into_scores():
    rnd = np.random.default_rng(1)
    queries, vectors = (rnd.integers(-9, 9, s) * (rnd.random(s) < 0.3) for s in ((7, 20), (50, 20)))
    vectors[:, 3], queries[:, 4], vectors[:, 5] = 2, 1, 0
    terms = topk.postings(vectors)
    assert terms[3][0] is None and not len(terms[5][1])
    assert (topk.accumulate(queries, terms, 50) == queries @ vectors.T).all()
    assert topk.whole(pa.array([[0.5], [], [1.0, -0.0001]])).tolist() == [[512, 0], [0, 0], [1024, -1]]
