"""Model operators on fixtures and the queries that have no SQL."""

import os

import numpy as np
import pytest

from cellweave.operators import modelling
from cellweave.plans import models

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


def test_permutation_covers_all_features_with_repeats(spark):
    got = {r.feature: r for r in models.ml_coefficients_and_permutation(spark, SF).collect()}
    assert len(got) == 9 and all(r.importance is not None and r["std"] is not None and r.coefficient is not None for r in got.values())
    assert any(r["std"] > 0 for r in got.values())


def test_permutation_importance_of_known_weights(spark):
    draw = np.random.default_rng(3)
    x = draw.normal(size=(400, 3))
    rows = [(f"c{i}", i, *map(float, v), float(3 * v[0] + v[1])) for i, v in enumerate(x)]
    df = spark.createDataFrame(rows, "cell string, week int, a double, b double, c double, label double")
    model = modelling.fit_ridge(df, ["a", "b", "c"])
    got = {r.feature: r for r in modelling.permutation_importance(model, df, ["a", "b", "c"]).collect()}
    assert got["a"].importance == pytest.approx(3 * 2**0.5, rel=0.15) and got["b"].importance == pytest.approx(2**0.5, rel=0.15)
    assert abs(got["c"].importance) < 0.02 and got["a"]["std"] > 0
    some = {r.feature: r.importance for r in modelling.permutation_importance(model, df, ["b"]).collect()}
    assert some == {"b": pytest.approx(got["b"].importance)}


def test_isolation_samples_hold_equal_rows_in_proportion(spark):
    """A third of 9,000 rows are equal: each tree's 256 rows hold about a third of them, wherever their common value hashes to, and differ from tree to tree."""
    draw = np.random.default_rng(4)
    for shift in (0.0, 1.0):
        x = draw.normal(size=9000) + shift
        rows = [(f"c{i % 90}", i // 90, shift if i % 3 == 0 else float(x[i])) for i in range(9000)]
        df = spark.createDataFrame(rows, "cell string, week int, v double").repartition(5)
        taken = modelling.isolation_samples(df, ["v"], ["cell", "week"], n_trees=20).toPandas()
        assert set(taken.tree) == set(range(20))
        sets = []
        for _, group in taken.groupby("tree"):
            best = group.iloc[np.argsort(group.place.to_numpy().view(np.uint64))[:256]]
            assert 400 < len(group) < 640 and len(best) == 256 and 0.2 < (best.v == shift).mean() < 0.47
            sets.append(frozenset(best.v))
        assert len(set(sets)) == 20
        forest = modelling.isolation_forest(modelling.isolation_samples(df, ["v"], ["cell", "week"], n_trees=20), ["v"])
        assert len(forest) == 20 and all(t[0][4] == 256 for t in forest)
        assert forest == modelling.isolation_forest(modelling.isolation_samples(df.coalesce(1), ["v"], ["cell", "week"], n_trees=20), ["v"])


def test_few_or_no_rows_are_all_drawn(spark):
    df = spark.createDataFrame([("a", 1, 0.0), ("b", 1, 5.0)], "cell string, week int, v double")
    assert modelling.isolation_samples(df, ["v"], ["cell", "week"], n_trees=3).count() == 6
    assert modelling.isolation_score(df, ["v"]).count() == 2
    assert modelling.isolation_score(df.where("false"), ["v"]).count() == 0


def test_fold_summary_and_groups_of_importance(spark):
    folds = spark.createDataFrame([("m", 0, 2.0, 0.1), ("m", 1, 1.0, 0.3), ("m", 2, 1.0, 0.2), ("k", 0, 5.0, None)], "model string, fold int, rmse double, r2 double")
    got = {(r.model, r.metric): (r.folds, r.mean, r["std"], r.best_fold, r.best, r.worst_fold, r.worst) for r in modelling.fold_summary(folds, ["model"], ["rmse", "r2"]).collect()}
    assert got[("m", "rmse")] == (3, 1.333333, 0.57735, 1, 1.0, 0, 2.0) and got[("m", "r2")] == (3, 0.2, 0.1, 1, 0.3, 0, 0.1)
    assert got[("k", "rmse")] == (1, 5.0, None, 0, 5.0, 0, 5.0) and ("k", "r2") not in got
    imp = spark.createDataFrame([("n_t", 1.0), ("n_t_minus_1", 2.0), ("traffic_t", 4.0), ("week", 0.5)], "feature string, importance double")
    sums = {r.group: (r.features, r.importance) for r in modelling.importance_groups(imp, models.GROUPS).collect()}
    assert sums == {"order_counts": (2, 3.0), "traffic_lags": (1, 4.0), "other": (1, 0.5)}


def test_rows_of_expanding_folds(spark):
    df = spark.createDataFrame([(w,) for w in range(10)], "week int")
    got = {}
    for r in modelling.in_folds(df, [3, 6], 2).collect():
        got.setdefault((r.fold, r.part), set()).add(r.week)
    assert got == {(0, "train"): {0, 1, 2}, (0, "test"): {3, 4}, (1, "train"): set(range(6)), (1, "test"): {6, 7, 8, 9}}


def test_prediction_table_has_every_row_once(spark):
    rows = models.ml_prediction_table(spark, SF).collect()
    assert len(rows) == len({(r.cell, r.week) for r in rows}) == models.frame(spark, SF)[0].count()
    assert all(r.ridge is not None and r.boosted is not None and r.split in ("train", "test") for r in rows)
