"""Model frames, folds and models on Spark ML."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.ml import Pipeline
from pyspark.ml.clustering import KMeans
from pyspark.ml.feature import Imputer, StandardScaler, VectorAssembler
from pyspark.ml.regression import GBTRegressor, LinearRegression
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from . import order, stats, trees, windows


def modelling_frame(panel: DataFrame, columns: list[str], target: str, *, by: str = "cell", week: str = "week") -> tuple[DataFrame, list[str]]:
    """Lags of the columns, the target's next valid value as ``label``; and the names of the features."""
    f = windows.lags(panel, columns, 2, by=by, week=week)
    f = windows.next_valid(f, target, by=by, week=week).withColumnRenamed(f"{target}_next", "label").where("label is not null")
    names = [f"{c}_t{s}" for c in columns for s in ("", "_minus_1", "_minus_2")]
    return f.withColumns({n: F.col(n).cast("double") for n in names}).withColumn("label", F.col("label").cast("double")), names


def week_index(df: DataFrame, week: str = "week") -> DataFrame:
    """0, 1, ... for the distinct weeks (a calendar, so one task may number it)."""
    return df.select(week).distinct().withColumn("week_index", F.row_number().over(W.orderBy(week)) - 1)


def split_weeks(df: DataFrame, share: float = 0.75, week: str = "week") -> DataFrame:
    """``split``: train for the first share of the distinct weeks, test for the rest."""
    w = week_index(df, week)
    n = w.agg(F.count("*").alias("_n"))
    return df.join(F.broadcast(w), week).crossJoin(F.broadcast(n)).withColumn("split", F.when(F.col("week_index") < F.floor(F.col("_n") * share), "train").otherwise("test")).drop("_n")


def expanding_folds(df: DataFrame, starts: list[int], width: int, week: str = "week") -> DataFrame:
    """A row for each fold: its train and test weeks, how many rows they have, and whether it can be used."""
    w = df.join(F.broadcast(week_index(df, week)), week)
    folds = df.sparkSession.createDataFrame([(s, s + width) for s in starts], "train_weeks int, until int")
    c = w.crossJoin(F.broadcast(folds)).groupBy("train_weeks", "until").agg(F.sum((F.col("week_index") < F.col("train_weeks")).cast("long")).alias("n_train"), F.sum(F.col("week_index").between(F.col("train_weeks"), F.col("until") - 1).cast("long")).alias("n_test"))
    return c.withColumn("usable", (F.col("n_train") > 0) & (F.col("n_test") > 0)).drop("until")


def _stages(names: list[str], model, *, flags: bool = False) -> Pipeline:
    filled = [f"{n}__f" for n in names]
    extra = [f"{n}__missing" for n in names] if flags else []
    return Pipeline(stages=[Imputer(strategy="median", inputCols=names, outputCols=filled), VectorAssembler(inputCols=[*filled, *extra], outputCol="raw"), StandardScaler(inputCol="raw", outputCol="features", withMean=True), model])


def fit_ridge(train: DataFrame, names: list[str], alpha: float = 1.0):
    """Median imputation, standardised features, least squares with an L2 penalty of ``alpha`` over all rows."""
    n = max(1, train.count())
    return _stages(names, LinearRegression(featuresCol="features", labelCol="label", elasticNetParam=0.0, regParam=alpha / n, standardization=False)).fit(train)


def with_missing_flags(df: DataFrame, names: list[str]) -> DataFrame:
    return df.withColumns({f"{n}__missing": F.col(n).isNull().cast("double") for n in names})


def fit_boosted(train: DataFrame, names: list[str], *, rounds: int = 200, depth: int = 8, rate: float = 0.08, held: float = 0.1, key: tuple[str, ...] = ("cell", "week")):
    """Boosted trees on imputed features and flags for what was missing (see :func:`with_missing_flags`).

    A share ``held`` of the rows, by hash of ``key``, decides when to stop: at the first round that makes their error no smaller.
    """
    stop = F.pmod(F.xxhash64(*key, F.lit("held")), F.lit(1000)) < int(1000 * held)
    gbt = GBTRegressor(featuresCol="features", labelCol="label", maxIter=rounds, maxDepth=depth, stepSize=rate, validationIndicatorCol="_held", validationTol=0.0, seed=42)
    return _stages(names, gbt, flags=True).fit(train.withColumn("_held", stop))


def fit_forest(train: DataFrame, names: list[str], **how) -> trees.Forest:
    """A forest of 300 trees that grow until a leaf has fewer than twice two rows, on all features (see :func:`.trees.fit_forests`)."""
    return trees.fit_forests(train, names, [F.lit(True)], **how)[0]


def group_folds(df: DataFrame, k: int = 5, by: str = "cell") -> DataFrame:
    """``fold`` by hash of the group, so that a group is never on both sides."""
    return df.withColumn("fold", F.pmod(F.xxhash64(F.col(by).cast("string")), F.lit(k)).cast("int"))


def regression_metrics(df: DataFrame, by: list[str] = (), truth: str = "label", guess: str = "prediction") -> DataFrame:
    """n, RMSE, MAE and R2, by group if asked for."""
    e = F.col(truth) - F.col(guess)
    n = F.count(e)
    r2 = 1 - F.try_divide(F.sum(e * e), F.nullif(F.var_pop(truth) * n, F.lit(0.0)))
    r6 = lambda c: F.round(c, 6)
    return df.groupBy(*by).agg(n.alias("n"), r6(F.sqrt(F.avg(e * e))).alias("rmse"), r6(F.avg(F.abs(e))).alias("mae"), r6(r2).alias("r2"))


def fold_summary(folds: DataFrame, by: list[str], metrics: list[str], *, lower_is_better: tuple[str, ...] = ("rmse", "mae"), fold: str = "fold") -> DataFrame:
    """Over the folds of each group (a row for each metric): number, mean and sample deviation, best and worst fold with their values; the earlier fold on ties."""
    long = folds.unpivot([*by, fold], metrics, "metric", "value").where("value is not null")
    order = F.when(F.col("metric").isin(*lower_is_better), F.col("value")).otherwise(-F.col("value"))
    best, worst = F.min(F.struct(order.alias("o"), fold, "value")).alias("_b"), F.min(F.struct((-order).alias("o"), fold, "value")).alias("_w")
    r6 = lambda c: F.round(c, 6)
    s = long.groupBy(*by, "metric").agg(F.count("*").alias("folds"), r6(F.avg("value")).alias("mean"), r6(F.stddev_samp("value")).alias("std"), best, worst)
    return s.select(*by, "metric", "folds", "mean", "std", F.col(f"_b.{fold}").alias("best_fold"), F.col("_b.value").alias("best"), F.col(f"_w.{fold}").alias("worst_fold"), F.col("_w.value").alias("worst"))


def in_folds(df: DataFrame, starts: list[int], width: int, week: str = "week") -> DataFrame:
    """A row for each expanding fold that uses the row: ``fold``, and ``part`` train (weeks before it) or test (its ``width`` weeks; all that are left in the last one)."""
    w = df.join(F.broadcast(week_index(df, week)), week)
    at = F.col("week_index")
    part = lambda i, s: F.when(at < s, "train").when((at < s + width) | F.lit(i == len(starts) - 1), "test")
    uses = F.filter(F.array(*[F.struct(F.lit(i).alias("fold"), part(i, s).alias("part")) for i, s in enumerate(starts)]), lambda f: f["part"].isNotNull())
    return w.withColumn("_u", F.explode(uses)).select(*w.columns, "_u.fold", "_u.part")


def importance_groups(importance: DataFrame, groups: dict[str, str], value: str = "importance") -> DataFrame:
    """Sums of the features' importance by the first group whose pattern a name matches; ``other`` for the rest."""
    name = F.coalesce(*[F.when(F.col("feature").rlike(pattern), g) for g, pattern in groups.items()], F.lit("other"))
    return importance.groupBy(name.alias("group")).agg(F.count("*").alias("features"), F.sum(value).alias(value))


def coefficient_ranking(model, names: list[str], spark) -> DataFrame:
    """Standardised coefficients of a fitted ridge, by size."""
    rows = [(n, float(c), abs(float(c))) for n, c in zip(names, model.stages[-1].coefficients, strict=True)]
    return spark.createDataFrame(rows, "feature string, coefficient double, size double")


def permutation_importance(model, df: DataFrame, names: list[str], *, repeats: int = 8) -> DataFrame:
    """Growth of the RMSE when a feature's values are dealt out anew, by joining rows in one hash order to another: mean and deviation over the repeats.

    ``df`` is a bounded sample (its rows are numbered in one task).  Each row stands once for the base and once for each feature and repeat, so one pass of the model scores all.
    """
    key = [c for c in ("cell", "week") if c in df.columns]
    numbered = df.withColumn("_i", F.row_number().over(W.orderBy(F.xxhash64(*key, F.lit(0)), *key)))
    draws = F.explode(F.sequence(F.lit(1), F.lit(repeats))).alias("_r")
    dealt = df.select(*key, F.struct(*names).alias("_v"), draws).withColumn("_i", F.row_number().over(W.partitionBy("_r").orderBy(F.xxhash64(*key, "_r"), *key))).select("_i", "_r", "_v")
    cases = numbered.join(dealt, "_i").withColumn("_f", F.explode(F.array(*[F.lit(n) for n in names])))
    changed = cases.withColumns({n: F.when(F.col("_f") == n, F.col(f"_v.{n}")).otherwise(F.col(n)) for n in names}).drop("_v")
    base = numbered.withColumns({"_r": F.lit(0), "_f": F.lit("")})
    flagged = [n for n in names if f"{n}__missing" in df.columns]
    scored = model.transform(with_missing_flags(changed.unionByName(base), flagged))
    rmse = scored.groupBy("_f", "_r").agg(F.sqrt(F.avg(F.pow(F.col("label") - F.col("prediction"), 2))).alias("e"))
    grown = rmse.where("_r > 0").crossJoin(F.broadcast(rmse.where("_r = 0").select(F.col("e").alias("_base"))))
    return grown.groupBy(F.col("_f").alias("feature")).agg(F.avg(F.col("e") - F.col("_base")).alias("importance"), F.stddev_pop("e").alias("std"))


def clusters(cells: DataFrame, per: int = 25, most: int = 8) -> DataFrame:
    """Cells grouped by place into min(8, n / 25) clusters; ``cluster`` of each cell."""
    k = min(most, max(1, cells.count() // per))
    v = VectorAssembler(inputCols=["lat", "lon"], outputCol="v").transform(cells)
    if k == 1:
        return cells.withColumn("cluster", F.lit(0))
    return KMeans(k=k, seed=42, featuresCol="v", predictionCol="cluster").fit(v).transform(v).drop("v")


def isolation_tree(rows: np.ndarray, draw: np.random.Generator) -> list[tuple[int, float, int, int, int]]:
    """A random isolation tree: nodes (feature, cut, left, right, size), feature -1 in leaves."""
    nodes: list[tuple[int, float, int, int, int]] = []
    limit = math.ceil(math.log2(max(2, len(rows))))

    def grow(rows: np.ndarray, depth: int) -> int:
        at = len(nodes)
        nodes.append((-1, 0.0, 0, 0, len(rows)))
        spread = np.flatnonzero(np.ptp(rows, axis=0) > 0) if len(rows) > 1 else []
        if depth < limit and len(spread):
            f = int(draw.choice(spread))
            cut = draw.uniform(rows[:, f].min(), rows[:, f].max())
            nodes[at] = (f, float(cut), grow(rows[rows[:, f] < cut], depth + 1), grow(rows[rows[:, f] >= cut], depth + 1), len(rows))
        return at

    grow(rows, 0)
    return nodes


def isolation_samples(df: DataFrame, xs: list[str], key: list[str], *, n_trees: int = 50, size: int = 256, seed: int = 42) -> DataFrame:
    """``tree``, ``place`` (a hash) and ``xs`` of the rows that each tree may draw: about twice ``size``, those of the least hashes of key and tree, from all rows in one pass."""
    n = df.count()
    most = np.uint64(min(2.0**64 - 2048, 2.0**64 * 2 * size / max(1, n)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            hashes = stats.hashed_again(batch.column(0).to_numpy().view(np.uint64), np.arange(seed, seed + n_trees))
            row, tree = np.nonzero(hashes <= most) if n > 2 * size else np.nonzero(np.ones_like(hashes, bool))
            taken = pa.RecordBatch.from_arrays(batch.columns[1:], xs).take(pa.array(row))
            yield pa.RecordBatch.from_arrays([pa.array(tree, pa.int32()), pa.array(hashes[row, tree].view(np.int64)), *taken.columns], ["tree", "place", *xs])

    light = df.select(F.xxhash64(*key).alias("_h"), *xs)
    return light.mapInArrow(run, f"tree int, place long, {', '.join(f'`{x}` double' for x in xs)}")


def isolation_forest(samples: DataFrame, xs: list[str], *, size: int = 256, seed: int = 42) -> list[list[tuple[int, float, int, int, int]]]:
    """The trees, each grown by a task from the ``size`` least hashes among its rows; a tree has at most twice ``size`` nodes."""

    def run(key: tuple, group: pa.Table) -> pa.Table:
        x = np.stack([group.column(c).to_numpy() for c in xs], axis=1)
        order = np.lexsort((*x.T, group.column("place").to_numpy().view(np.uint64)))[:size]
        nodes = isolation_tree(x[order], np.random.default_rng([seed, key[0].as_py()]))
        return pa.table({"tree": pa.array([key[0].as_py()] * len(nodes), pa.int32()), **{n: list(c) for n, c in zip(("feature", "cut", "left", "right", "size"), zip(*nodes, strict=True), strict=True)}, "node": list(range(len(nodes)))})

    rows = samples.groupBy("tree").applyInArrow(run, "tree int, feature long, cut double, left long, right long, size long, node long").collect()  # trees x 2 x size
    out: dict[int, list] = {}
    for r in sorted(rows, key=lambda r: (r.tree, r.node)):
        out.setdefault(r.tree, []).append((r.feature, r.cut, r.left, r.right, r["size"]))
    return list(out.values())


def average_path(n: float) -> float:
    """Mean depth of an unsuccessful search in a random tree of n points."""
    return 0.0 if n <= 1 else 1.0 if n == 2 else 2 * (math.log(n - 1) + 0.5772156649015329) - 2 * (n - 1) / n


def isolation_score(df: DataFrame, columns: list[str], *, n_trees: int = 50, size: int = 256) -> DataFrame:
    """``isolation``: how few random cuts single a row out (0 to 1).  Nulls are medians.

    Each tree draws its own ``size`` rows of all by a hash of the row's key (cell and week, or all columns of a table
    without them), so rows of equal values are drawn in proportion, and is grown in a task.
    """
    key = [c for c in ("cell", "week") if c in df.columns] or df.columns
    med = order.quantiles(df, [], {c: (c, 0.5) for c in columns}).first()
    filled = df.withColumns({f"{c}__x": F.coalesce(F.col(c), F.lit(float(med[c] or 0.0))) for c in columns})
    xs = [f"{c}__x" for c in columns]
    forest = isolation_forest(isolation_samples(filled, xs, key, n_trees=n_trees, size=size), xs, size=size)
    norm = average_path(forest[0][0][4] if forest else 0) or 1.0

    @F.pandas_udf("double")
    def score(*parts: pd.Series) -> pd.Series:
        x = np.column_stack([p.to_numpy(float) for p in parts])
        total = np.zeros(len(x))
        for nodes in forest:
            todo = [(0, np.arange(len(x)), 0)]
            while todo:
                at, idx, depth = todo.pop()
                f, cut, left, right, n = nodes[at]
                if f < 0:
                    total[idx] += depth + average_path(n)
                    continue
                low = x[idx, f] < cut
                todo += [(left, idx[low], depth + 1), (right, idx[~low], depth + 1)]
        return pd.Series(2.0 ** (-total / max(1, len(forest)) / norm))

    return filled.withColumn("isolation", score(*xs)).drop(*xs)


