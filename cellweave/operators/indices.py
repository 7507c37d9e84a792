"""Composite indices, anomaly flags and verdicts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from . import order, windows


def moments(df: DataFrame, columns: list[str]) -> DataFrame:
    """One row with mean, population deviation and extremes of each column."""
    made = []
    for c in columns:
        made += [F.avg(c).alias(f"{c}__mean"), F.stddev_pop(c).alias(f"{c}__sd"), F.min(c).alias(f"{c}__min"), F.max(c).alias(f"{c}__max")]
    return df.agg(*made)


def with_moments(df: DataFrame, columns: list[str], quantiles: tuple[str, ...] = ()) -> DataFrame:
    """``df`` with the moments of ``columns`` on every row, and the quantiles that :func:`robust_z` and :func:`clipped_scale` need of ``quantiles``."""
    out = df.crossJoin(F.broadcast(moments(df, columns)))
    if not quantiles:
        return out
    shares = (0.05, 0.25, 0.5, 0.75, 0.95)
    q = order.quantiles(df, [], {f"{c}_{k}": (c, p) for c in quantiles for k, p in enumerate(shares)})
    return out.crossJoin(F.broadcast(q.select(*[F.array(*[f"{c}_{k}" for k in range(len(shares))]).alias(f"{c}__q") for c in quantiles])))


def without_moments(df: DataFrame) -> DataFrame:
    return df.drop(*[c for c in df.columns if "__" in c])


def z(c: str) -> Column:
    """Global z-score of a column prepared by :func:`with_moments`; null in a flat column."""
    return F.try_divide(F.col(c) - F.col(f"{c}__mean"), F.col(f"{c}__sd"))


def min_max(c: str, flat: float | None = None) -> Column:
    """Scaled to [0, 1]; ``flat`` where the column is constant."""
    span = F.col(f"{c}__max") - F.col(f"{c}__min")
    return F.when(F.col(c).isNotNull(), F.coalesce(F.try_divide(F.col(c) - F.col(f"{c}__min"), F.nullif(span, F.lit(0.0))), F.lit(flat)))


def robust_z(c: str) -> Column:
    """Deviation from the median over the inter-quartile range as a normal deviation (IQR / 1.34896)."""
    q = F.col(f"{c}__q")
    return F.try_divide(F.col(c) - q[2], F.nullif((q[3] - q[1]) / 1.34896, F.lit(0.0)))


def clipped_scale(c: str) -> Column:
    """(x - p5) / (p95 - p5), held to [0, 1]."""
    q = F.col(f"{c}__q")
    scaled = F.try_divide(F.col(c) - q[0], F.nullif(q[4] - q[0], F.lit(0.0)))
    return F.when(scaled.isNotNull(), F.greatest(F.lit(0.0), F.least(F.lit(1.0), scaled)))


def mean_of(parts: list[Column]) -> Column:
    """Mean of the parts that are not null."""
    n = sum((p.isNotNull().cast("int") for p in parts), F.lit(0))
    return F.try_divide(sum((F.coalesce(p, F.lit(0.0)) for p in parts), F.lit(0.0)), F.nullif(n, F.lit(0)))


def weighted_mean(parts: list[tuple[Column, float]]) -> Column:
    """Weighted mean over the parts that are not null, weights renormalised."""
    total = sum((F.when(p.isNotNull(), w).otherwise(0.0) for p, w in parts), F.lit(0.0))
    return F.try_divide(sum((F.coalesce(p * w, F.lit(0.0)) for p, w in parts), F.lit(0.0)), F.nullif(total, F.lit(0.0)))


def mad_outliers(df: DataFrame, c: str, limit: float = 3.0, by: list[str] = ()) -> DataFrame:
    """``is_outlier``: |x - median| > limit x 1.4826 x MAD, in two passes."""
    keys = list(by)
    med = order.quantiles(df, keys, {"_med": (c, 0.5)})
    near = lambda a, b: a.join(b, keys, "left") if keys else a.crossJoin(F.broadcast(b))
    dev = near(df, med).withColumn("_dev", F.abs(F.col(c) - F.col("_med")))
    mad = order.quantiles(dev, keys, {"_mad": ("_dev", 0.5)})
    return near(dev, mad).withColumn("is_outlier", F.coalesce(F.col("_dev") > limit * 1.4826 * F.col("_mad"), F.lit(False))).drop("_med", "_dev", "_mad")


def weekly_flags(df: DataFrame, c: str, *, by: str, week: str = "week", frame: int = 8, least: int = 4) -> DataFrame:
    """``flag``: robust z over 2, or at the group's ninth decile, or deviation from the trailing mean at its ninth decile."""
    w = W.partitionBy(by).orderBy(week).rowsBetween(-(frame - 1), 0)
    dev = F.when(F.count(c).over(w) >= least, F.col(c) - F.avg(c).over(w))
    d = df.withColumn("_dev", dev)
    q = d.groupBy(by).agg(F.percentile(c, F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75), F.lit(0.9))).alias("_q"), F.percentile("_dev", F.lit(0.9)).alias("_d90"))
    robust = F.try_divide(F.col(c) - F.col("_q")[1], F.nullif((F.col("_q")[2] - F.col("_q")[0]) / 1.34896, F.lit(0.0)))
    no = F.lit(False)
    flag = F.coalesce(F.abs(robust) > 2, no) | F.coalesce(F.col(c) >= F.col("_q")[3], no) | F.coalesce(F.col("_dev") >= F.col("_d90"), no)
    return d.join(q, by).withColumn("flag", flag).drop("_dev", "_q", "_d90")


def regimes(weekly: DataFrame, weights: dict[str, float], low: float = 0.25, high: float = 0.75) -> DataFrame:
    """LOW, MID or HIGH for each week, by the weighted mean of the percent ranks of its means (a row for each week)."""
    score = weighted_mean([(windows.percent_rank_average(F.col(c), []), w) for c, w in weights.items()])
    scored = weekly.withColumn("score", score)
    q = scored.agg(F.percentile("score", F.array(F.lit(low), F.lit(high))).alias("_q"))
    word = F.when(F.col("score") <= F.col("_q")[0], "LOW").when(F.col("score") >= F.col("_q")[1], "HIGH").when(F.col("score").isNotNull(), "MID")
    return scored.crossJoin(F.broadcast(q)).withColumn("regime", word).drop("_q")


def verdict(rows: DataFrame, by: list[str]) -> DataFrame:
    """YES if some comparison is higher with p below 0.05 and |d| over 0.05; NO if none has such a p; else INCONCLUSIVE."""
    p = F.least(F.col("welch_p"), F.col("mw_p"))
    yes = F.coalesce(F.bool_or((F.col("diff") > 0) & (p < 0.05) & (F.abs("cohens_d") > 0.05)), F.lit(False))
    some = F.coalesce(F.bool_or(p < 0.05), F.lit(False))
    return rows.groupBy(*by).agg(F.when(yes, "YES").when(~some, "NO").otherwise("INCONCLUSIVE").alias("verdict"), F.round(F.min(p), 6).alias("least_p"))


def shared_annulus(counts: DataFrame, priority: list[str]) -> DataFrame:
    """The first zone in order in which every group has rows; ``counts`` has group, zone and n."""
    groups = counts.agg(F.count_distinct("group").alias("_groups"))
    order = F.array_position(F.array(*[F.lit(z) for z in priority]), F.col("zone"))
    full = counts.where("n >= 1").groupBy("zone").agg(F.count_distinct("group").alias("_have"), F.min("n").alias("least_n")).crossJoin(F.broadcast(groups)).where("_have = _groups")
    return full.withColumn("_o", order).where("_o > 0").orderBy("_o").limit(1).select("zone", "least_n")
