"""Histogram forests against a plain recursive tree, and every way of growing them against the others."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from cellweave.operators import trees


def plain(x, y, w, depth, leaf):
    """A recursive tree on bins: the first best split of all features and bins; a function from a row to its prediction."""
    mean = float((w * y).sum() / w.sum())
    best = (1e-9, None, None)
    for f in range(x.shape[1]):
        for b in range(trees.BINS - 1):
            left = x[:, f] <= b
            lw, rw = w[left].sum(), w[~left].sum()
            if lw >= leaf and rw >= leaf:
                gain = (w[left] * y[left]).sum() ** 2 / lw + (w[~left] * y[~left]).sum() ** 2 / rw - (w * y).sum() ** 2 / w.sum()
                if gain > best[0] + 1e-9:
                    best = (gain, f, b)
    if depth == 0 or best[1] is None:
        return lambda r: mean
    left = x[:, best[1]] <= best[2]
    low, high = (plain(x[s], y[s], w[s], depth - 1, leaf) for s in (left, ~left))
    return lambda r: low(r) if r[best[1]] <= best[2] else high(r)


@pytest.mark.parametrize("depth,leaf", [(3, 2), (30, 5), (0, 1)])
def test_grown_tree_equals_a_recursive_one(depth, leaf):
    draw = np.random.default_rng(depth)
    x = draw.integers(0, trees.BINS, (250, 3)).astype(np.uint8)
    y, w = x[:, 0] * 2.0 + (x[:, 1] > 9) * 17 + draw.normal(size=250), draw.integers(1, 4, 250).astype(float)
    tree = trees.grow(x, y, w, depth=depth, leaf=leaf)
    want = plain(x, y, w, depth, leaf)
    assert tree[4][trees.leaf_of(tree, x)] == pytest.approx([want(r) for r in x], rel=1e-5, abs=1e-5)


def table(spark, n=600):
    draw = np.random.default_rng(7)
    a, b = draw.normal(size=n), draw.random(n)
    y = 5 * (a > 0.3) + 3 * b + draw.normal(size=n) * 0.1
    rows = [(f"c{i % 20}", i, float(a[i]), None if i % 9 == 0 else float(b[i]), float(y[i]) if i % 50 else None) for i in range(n)]
    return spark.createDataFrame(rows, "cell string, week int, a double, b double, label double").repartition(5)


def predictions(forest, df):
    return {r.week: r.prediction for r in forest.transform(df).select("week", "prediction").collect()}


def test_large_and_small_nodes_give_the_same_forest(spark):
    df = table(spark)
    masks = [F.col("week") % 3 != 0, F.lit(True)]
    whole = trees.fit_forests(df, ["a", "b"], masks, trees=4, depth=5, leaf=3)
    levels = trees.fit_forests(df, ["a", "b"], masks, trees=4, depth=5, leaf=3, small=60)
    only = trees.fit_forests(df.coalesce(1), ["a", "b"], masks, trees=4, depth=5, leaf=3, small=0)
    for one, two, three in zip(whole, levels, only, strict=True):
        first = predictions(one, df)
        assert predictions(two, df) == pytest.approx(first, rel=1e-5) and predictions(three, df) == pytest.approx(first, rel=1e-5)
    assert predictions(whole[0], df) != predictions(whole[1], df)


def test_one_tree_without_draws_is_the_plain_tree(spark):
    df = table(spark)
    forest, = trees.fit_forests(df, ["a", "b"], [F.lit(True)], trees=1, depth=4, leaf=2, bootstrap=False)
    held = [r for r in df.collect() if r.label is not None]
    columns = [np.array([np.nan if r[c] is None else r[c] for r in held]) for c in ("a", "b")]
    x, y = forest.binned(columns), np.array([r.label for r in held])
    want = plain(x, y, np.ones(len(y)), 4, 2)
    got = predictions(forest, df)
    assert [got[r.week] for r in held] == pytest.approx([want(v) for v in x], rel=1e-5)


def test_forest_learns_and_generalises(spark):
    df = table(spark, 1500)
    forest, = trees.fit_forests(df, ["a", "b"], [F.col("week") % 4 != 0], trees=30)
    e = forest.transform(df.where("week % 4 = 0 and label is not null and b is not null")).agg(F.avg(F.pow(F.col("label") - F.col("prediction"), 2)), F.var_pop("label")).first()
    assert e[0] < 0.05 * e[1]


def test_empty_and_too_large(spark, monkeypatch):
    df = table(spark)
    forest, = trees.fit_forests(df.where("false"), ["a", "b"], [F.lit(True)], trees=3)
    assert set(predictions(forest, df).values()) == {0.0}
    monkeypatch.setattr(trees, "MODEL_MB", 0)
    with pytest.raises(ValueError, match="leaf"):
        trees.fit_forests(df, ["a"], [F.lit(True)])
