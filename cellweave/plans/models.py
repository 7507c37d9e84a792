"""Queries of model frames, folds, models and the blended outlier score.  Fitted values have no SQL counterpart."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import session
from ..operators import indices as I
from ..operators import modelling as M
from ..operators import order, trees, windows
from . import views as V
from .registry import query

R = lambda c: F.round(c, 6)
COLUMNS = ["traffic", "n", "urgent"]


def frame(spark: SparkSession, d: str) -> tuple[DataFrame, list[str]]:
    return M.modelling_frame(V.long_panel(spark, d), COLUMNS, "traffic")


@query("""SELECT cell, week, traffic AS traffic_t, lag(n) OVER w AS n_t_minus_1, label FROM (SELECT *, lead(traffic) OVER (PARTITION BY cell ORDER BY week) AS label FROM lp) WINDOW w AS (PARTITION BY cell ORDER BY week) QUALIFY label IS NOT NULL""")
def ml_modelling_frame(spark: SparkSession, d: str) -> DataFrame:
    f, _ = frame(spark, d)
    return f.select("cell", "week", "traffic_t", F.col("n_t_minus_1").cast("bigint").alias("n_t_minus_1"), "label")


@query("""SELECT split, count(*) AS n, count(DISTINCT week) AS weeks, min(week) AS first_week FROM (SELECT lp.week, CASE WHEN i<floor(0.75*(SELECT count(DISTINCT week) FROM lp)) THEN 'train' ELSE 'test' END AS split FROM lp JOIN (SELECT week, row_number() OVER (ORDER BY week)-1 AS i FROM (SELECT DISTINCT week FROM lp)) USING (week)) GROUP BY split""")
def ml_week_split(spark: SparkSession, d: str) -> DataFrame:
    s = M.split_weeks(V.long_panel(spark, d))
    return s.groupBy("split").agg(F.count("*").alias("n"), F.count_distinct("week").alias("weeks"), F.min("week").alias("first_week"))


@query("""SELECT CAST(s AS INT) AS train_weeks, CAST(sum((i<s)::INT) AS BIGINT) AS n_train, CAST(sum((i>=s AND i<s+20)::INT) AS BIGINT) AS n_test, sum((i<s)::INT)>0 AND sum((i>=s AND i<s+20)::INT)>0 AS usable FROM lp JOIN (SELECT week, row_number() OVER (ORDER BY week)-1 AS i FROM (SELECT DISTINCT week FROM lp)) USING (week), (SELECT unnest([100,150,200,100000]) AS s) GROUP BY s""")
def ml_expanding_folds(spark: SparkSession, d: str) -> DataFrame:
    return M.expanding_folds(V.long_panel(spark, d), [100, 150, 200, 100_000], 20)


@query("""SELECT split, count(*) AS n, round(sqrt(avg(pow(label-p,2))),6) AS rmse, round(avg(abs(label-p)),6) AS mae, round(1-sum(pow(label-p,2))/nullif(var_pop(label)*count(*),0),6) AS r2 FROM (SELECT traffic AS p, lead(traffic) OVER (PARTITION BY cell ORDER BY week) AS label, CASE WHEN i<floor(0.75*(SELECT count(DISTINCT week) FROM lp)) THEN 'train' ELSE 'test' END AS split FROM lp JOIN (SELECT week, row_number() OVER (ORDER BY week)-1 AS i FROM (SELECT DISTINCT week FROM lp)) USING (week)) WHERE label IS NOT NULL GROUP BY split""")
def ml_persistence_metrics(spark: SparkSession, d: str) -> DataFrame:
    """Errors of the forecast that nothing changes, by split."""
    p = M.split_weeks(V.long_panel(spark, d))
    f, _ = M.modelling_frame(p, ["traffic"], "traffic")
    return M.regression_metrics(f.withColumn("prediction", F.col("traffic_t")), ["split"])


def _split(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame, list[str]]:
    f, names = frame(spark, d)
    s = M.with_missing_flags(M.split_weeks(f), names)
    return s.where("split = 'train'"), s.where("split = 'test'"), names


@query()
def ml_ridge(spark: SparkSession, d: str) -> DataFrame:
    train, test, names = _split(spark, d)
    return M.regression_metrics(M.fit_ridge(train, names).transform(train.unionByName(test)), ["split"])


@query()
def ml_boosted_trees(spark: SparkSession, d: str) -> DataFrame:
    train, test, names = _split(spark, d)
    return M.regression_metrics(M.fit_boosted(train, names).transform(train.unionByName(test)), ["split"])


@query()
def ml_forest_grouped_folds(spark: SparkSession, d: str) -> DataFrame:
    """Random forests of 100 full-grown trees without and with a feature of the label's own week: a fold of -1 is a fifth of the rows by hash, 0 to 4 are folds by cell."""
    p = windows.next_valid(V.long_panel(spark, d), "n").withColumnRenamed("n_next", "n_label_week")
    f, names = M.modelling_frame(p, COLUMNS, "traffic")
    f = M.group_folds(f.withColumn("n_label_week", F.col("n_label_week").cast("double")), 5).withColumn("fifth", F.pmod(F.xxhash64("cell", "week"), F.lit(5)) == 0)
    f = session.cut(f)
    tests, parts = [F.col("fifth"), *[F.col("fold") == k for k in range(5)]], []
    for kind, features in (("own", names), ("with_leak", [*names, "n_label_week"])):
        forests = trees.fit_forests(f, features, [~t for t in tests], trees=100)  # all six in one pass
        for k, (forest, test) in enumerate(zip(forests, tests, strict=True), start=-1):
            parts.append(M.regression_metrics(forest.transform(f.where(test))).withColumns({"fold": F.lit(k), "features": F.lit(kind)}))
    return V.union_all(parts)


FOLDS, WIDTH = [100, 150, 200, 250, 300], 50
_FOLDED = f"""mf AS (SELECT * FROM (SELECT cell, week, traffic AS p, lead(traffic) OVER (PARTITION BY cell ORDER BY week) AS label FROM lp) WHERE label IS NOT NULL), wi AS (SELECT week, row_number() OVER (ORDER BY week)-1 AS i FROM (SELECT DISTINCT week FROM mf)),
ff AS (SELECT * FROM (SELECT cell, week, p, label, fold, CASE WHEN i<s THEN 'train' WHEN i<s+{WIDTH} OR fold={len(FOLDS) - 1} THEN 'test' END AS part FROM mf JOIN wi USING (week), (SELECT unnest({FOLDS}) AS s, unnest({list(range(len(FOLDS)))}) AS fold)) JOIN (SELECT fold, cell, avg(label) AS m FROM (SELECT cell, label, fold FROM mf JOIN wi USING (week), (SELECT unnest({FOLDS}) AS s, unnest({list(range(len(FOLDS)))}) AS fold) WHERE i<s) GROUP BY fold, cell) USING (fold, cell) WHERE part IS NOT NULL)"""


def _baselines(spark: SparkSession, d: str) -> DataFrame:
    """Rows of all folds with two forecasts that need no model: the last value, and the mean of the cell's training labels."""
    f, _ = M.modelling_frame(V.long_panel(spark, d), ["traffic"], "traffic")
    f = M.in_folds(f, FOLDS, WIDTH)
    mean = f.where("part = 'train'").groupBy("fold", "cell").agg(F.avg("label").alias("cell_mean"))
    return f.join(mean, ["fold", "cell"]).withColumn("last_value", F.col("traffic_t"))


@query()
def ml_coefficients_and_permutation(spark: SparkSession, d: str) -> DataFrame:
    train, test, names = _split(spark, d)
    model = M.fit_ridge(train, names)
    sample = test.orderBy(F.xxhash64("cell", "week"), "cell", "week").limit(2500)
    ranked = M.coefficient_ranking(model, names, spark).join(M.permutation_importance(model, sample, names), "feature", "full_outer")
    return ranked.withColumn("group", F.regexp_extract("feature", "^([a-z]+)", 1))


_ERRORS = lambda g: f"round(sqrt(avg(pow(label-{g},2))),6) AS rmse, round(avg(abs(label-{g})),6) AS mae, round(1-sum(pow(label-{g},2))/nullif(var_pop(label)*count(*),0),6) AS r2"
_FOLD_ROWS = " UNION ALL ".join(f"SELECT '{m}' AS model, fold, part, count(*) AS n, {_ERRORS(g)} FROM ff GROUP BY fold, part" for m, g in (("last_value", "p"), ("cell_mean", "m")))


def _fold_rows(spark: SparkSession, d: str) -> DataFrame:
    b = _baselines(spark, d)
    return V.union_all([M.regression_metrics(b, ["fold", "part"], guess=g).withColumn("model", F.lit(g)) for g in ("last_value", "cell_mean")])


@query(f"""SELECT model, CAST(fold AS INT) AS fold, part, n, rmse, mae, r2 FROM ({_FOLD_ROWS})""", _FOLDED)
def ml_fold_table(spark: SparkSession, d: str) -> DataFrame:
    """Errors in each expanding fold, train and test, of the forecasts that need no model."""
    return _fold_rows(spark, d)


@query(f"""SELECT model, metric, count(*) AS folds, round(avg(value),6) AS mean, round(stddev_samp(value),6) AS std, CAST(arg_min(fold, (o, fold)) AS INT) AS best_fold, arg_min(value, (o, fold)) AS best, CAST(arg_min(fold, (-o, fold)) AS INT) AS worst_fold, arg_min(value, (-o, fold)) AS worst
FROM (SELECT model, fold, metric, value, CASE WHEN metric='r2' THEN -value ELSE value END AS o FROM (UNPIVOT (SELECT model, fold, rmse, mae, r2 FROM ({_FOLD_ROWS}) WHERE part='test') ON rmse, mae, r2 INTO NAME metric VALUE value)) GROUP BY model, metric""", _FOLDED)
def ml_fold_summary(spark: SparkSession, d: str) -> DataFrame:
    """Mean and deviation of the test errors over the folds, best and worst fold."""
    return M.fold_summary(_fold_rows(spark, d).where("part = 'test'"), ["model"], ["rmse", "mae", "r2"])


@query()
def ml_fold_summary_fitted(spark: SparkSession, d: str) -> DataFrame:
    """The same for ridge and boosted trees fitted anew in every fold, train and test."""
    f, names = frame(spark, d)
    f = session.cut(M.in_folds(M.with_missing_flags(f, names), FOLDS, WIDTH))
    parts = []
    for k in range(len(FOLDS)):
        train, both = f.where((F.col("fold") == k) & (F.col("part") == "train")), f.where(F.col("fold") == k)
        for model, fit in (("ridge", M.fit_ridge), ("boosted", M.fit_boosted)):
            parts.append(M.regression_metrics(fit(train, names).transform(both), ["fold", "part"]).withColumn("model", F.lit(model)))
    return M.fold_summary(V.union_all(parts), ["model", "part"], ["rmse", "mae", "r2"])


@query("""SELECT cell, week, split, label, p AS last_value, round(m,6) AS cell_mean FROM (SELECT lp.cell, lp.week, traffic AS p, label, CASE WHEN i<floor(0.75*(SELECT count(DISTINCT week) FROM lq)) THEN 'train' ELSE 'test' END AS split FROM lq lp JOIN (SELECT week, row_number() OVER (ORDER BY week)-1 AS i FROM (SELECT DISTINCT week FROM lq)) USING (week))
LEFT JOIN (SELECT cell, avg(label) AS m FROM lq JOIN (SELECT week, row_number() OVER (ORDER BY week)-1 AS i FROM (SELECT DISTINCT week FROM lq)) USING (week) WHERE i<floor(0.75*(SELECT count(DISTINCT week) FROM lq)) GROUP BY cell) USING (cell)""", "lq AS (SELECT * FROM (SELECT cell, week, traffic, lead(traffic) OVER (PARTITION BY cell ORDER BY week) AS label FROM lp) WHERE label IS NOT NULL)")
def ml_baseline_predictions(spark: SparkSession, d: str) -> DataFrame:
    """Truth, split and the forecasts that need no model, a row for each cell and week."""
    f, _ = M.modelling_frame(V.long_panel(spark, d), ["traffic"], "traffic")
    s = M.split_weeks(f)
    mean = s.where("split = 'train'").groupBy("cell").agg(R(F.avg("label")).alias("cell_mean"))
    return s.join(mean, "cell", "left").select("cell", "week", "split", "label", F.col("traffic_t").alias("last_value"), "cell_mean")


@query()
def ml_prediction_table(spark: SparkSession, d: str) -> DataFrame:
    """Truth, split and the forecasts of ridge and boosted trees, a row for each cell and week."""
    train, test, names = _split(spark, d)
    rows = train.unionByName(test).select("cell", "week", "split", "label", *names, *[f"{n}__missing" for n in names])
    for model, fit in (("ridge", M.fit_ridge), ("boosted", M.fit_boosted)):
        rows = fit(train, names).transform(rows).drop("raw", "features", *[f"{n}__f" for n in names]).withColumnRenamed("prediction", model)
    return rows.select("cell", "week", "split", "label", "ridge", "boosted")


#: Groups of features by the start of their names.
GROUPS = {"traffic_lags": "^traffic_t", "order_counts": "^n_t", "urgent_orders": "^urgent_t"}


@query()
def ml_importance_groups(spark: SparkSession, d: str) -> DataFrame:
    """Permutation importance of the ridge summed by group of features."""
    train, test, names = _split(spark, d)
    sample = test.orderBy(F.xxhash64("cell", "week"), "cell", "week").limit(2500)
    return M.importance_groups(M.permutation_importance(M.fit_ridge(train, names), sample, names), GROUPS)


@query()
def ml_wind_clusters(spark: SparkSession, d: str) -> DataFrame:
    cells = V.obs(spark, d).select("cell", "lat", "lon").distinct()
    return M.clusters(cells, per=5).groupBy("cluster").agg(F.count("*").alias("n"), R(F.avg("lat")).alias("lat"))


@query()
def idx_blended_outliers(spark: SparkSession, d: str) -> DataFrame:
    """0.7 of the isolation score with 0.3 of the mean |z|; anomalous from the 92nd percentile on."""
    p = M.isolation_score(I.with_moments(V.panel(spark, d), V.VALUES), V.VALUES)
    z = I.mean_of([F.abs(I.z(c)) for c in V.VALUES])
    s = p.withColumn("score", 0.7 * F.col("isolation") + 0.3 * F.coalesce(z, F.lit(0.0)))
    q = order.quantiles(s, [], {"q": ("score", 0.92)})
    return s.crossJoin(F.broadcast(q)).select("cell", "week", R(F.col("score")).alias("score"), (F.col("score") >= F.col("q")).alias("anomalous"))
