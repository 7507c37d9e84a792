"""Window operators over weekly series of a cell, and ranks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from . import order


def series(*by: str, order: str = "week"):
    return W.partitionBy(*by).orderBy(order)


def lags(df: DataFrame, columns: list[str], k: int = 2, *, by: str = "cell", week: str = "week", calendar: bool = False) -> DataFrame:
    """``<c>_t`` and ``<c>_t_minus_1`` ...: the rows before, or the values exactly 7, 14, ... days before."""
    w = series(by, order=week)
    out = {f"{c}_t": F.col(c) for c in columns}
    for j in range(1, k + 1):
        on_time = F.datediff(F.col(week), F.lag(week, j).over(w)) == 7 * j
        for c in columns:
            out[f"{c}_t_minus_{j}"] = F.when(on_time, F.lag(c, j).over(w)) if calendar else F.lag(c, j).over(w)
    return df.withColumns(out)


def lead_delta(df: DataFrame, c: str, *, by: str = "cell", week: str = "week") -> DataFrame:
    """``delta_<c>``: next row's value less this one's, null unless both are there; ``has_valid_delta_<c>`` tells."""
    delta = F.lead(c).over(series(by, order=week)) - F.col(c)
    return df.withColumn(f"delta_{c}", delta).withColumn(f"has_valid_delta_{c}", F.col(f"delta_{c}").isNotNull())


def next_valid(df: DataFrame, c: str, *, by: str = "cell", week: str = "week") -> DataFrame:
    """Only rows that have ``c``, with ``<c>_next`` of the next such row; weeks may lie between."""
    return df.where(F.col(c).isNotNull()).withColumn(f"{c}_next", F.lead(c).over(series(by, order=week)))


def difference(df: DataFrame, c: str, *, by: str = "cell", week: str = "week") -> DataFrame:
    return df.withColumn(f"{c}_diff", F.col(c) - F.lag(c).over(series(by, order=week)))


def lagged_products(df: DataFrame, a: str, b: str, k: int = 3, *, by: str = "cell", week: str = "week") -> DataFrame:
    """a(t - j) x b(t) for j = 1 ... k."""
    return df.withColumns({f"{a}_lag{j}_x_{b}": F.lag(a, j).over(series(by, order=week)) * F.col(b) for j in range(1, k + 1)})


def rolling(c: str, before: int, after: int, least: int, how: str = "mean", *, by: str = "cell", week: str = "week") -> Column:
    """Mean, median, standard deviation or sum over a frame of rows, null below ``least`` values."""
    w = series(by, order=week).rowsBetween(-before, after)
    made = {"mean": F.avg(c), "median": F.percentile(c, F.lit(0.5)), "std": F.stddev_samp(c), "sum": F.sum(c)}[how]
    return F.when(F.count(c).over(w) >= least, made.over(w))


def correlation(x: Column, y: Column, over=None) -> Column:
    """Pearson's coefficient over the rows that have both, null without spread (the built-in one fails there)."""
    both = x.isNotNull() & y.isNotNull()
    own = lambda c: F.stddev_pop(F.when(both, c))
    parts = F.covar_pop(x, y), own(x), own(y)
    c, sx, sy = (p.over(over) if over is not None else p for p in parts)
    return F.try_divide(c, sx * sy)


def rolling_correlation(a: str, b: str, rows: int, least: int, *, by: str = "cell", week: str = "week") -> Column:
    w = series(by, order=week).rowsBetween(-(rows - 1), 0)
    both = F.when(F.col(a).isNotNull() & F.col(b).isNotNull(), 1)
    return F.when(F.count(both).over(w) >= least, correlation(F.col(a), F.col(b), w))


def average_rank(c: Column, by: list[str]) -> Column:
    """Rank with ties at their mean; nulls have none.  Every partition must be of moderate size; see :mod:`.order` for others."""
    least = F.rank().over(W.partitionBy(*by, c.isNull()).orderBy(c))
    ties = F.count("*").over(W.partitionBy(*by, c))
    return F.when(c.isNotNull(), least + (ties - 1) / 2)


def percent_rank_average(c: Column, by: list[str]) -> Column:
    """Average-tie rank over the number of values, in (0, 1]."""
    return average_rank(c, by) / F.count(c).over(W.partitionBy(*by))


def rolling_spearman(df: DataFrame, a: str, b: str, rows: int = 12, least: int = 8, *, by: str = "cell", week: str = "week") -> DataFrame:
    """|rho| over the last ``rows`` rows that have both values: ranks within the cell, then their correlation in the frame."""
    both = df.where(F.col(a).isNotNull() & F.col(b).isNotNull())
    ranked = both.withColumns({"_ra": average_rank(F.col(a), [by]), "_rb": average_rank(F.col(b), [by])})
    return ranked.withColumn("abs_rho", F.abs(rolling_correlation("_ra", "_rb", rows, least, by=by, week=week))).drop("_ra", "_rb")


def global_rank(df: DataFrame, c: str, name: str, *, percent: bool = True, parts: int | None = None) -> DataFrame:
    """Average-tie rank (or its share of the count) over all rows, from the index of values in ``parts`` ranges; nulls get null."""
    told = order.index(df, [], c, parts).ranks()
    value = F.col("_rank") / F.col("_total") if percent else F.col("_rank")
    return df.join(told.select(F.col(c).alias("_v"), value.alias(name)), F.col(c) == F.col("_v"), "left").drop("_v")


def group_z(c: Column, by: list[str], *, flat: float = 1e-12) -> Column:
    """Deviation from the group's mean in population standard deviations; 0 in flat groups."""
    w = W.partitionBy(*by)
    sd = F.stddev_pop(c).over(w)
    return F.when(c.isNotNull(), F.when(sd < flat, 0.0).otherwise((c - F.avg(c).over(w)) / sd))


def group_anomaly(c: str, by: list[str], how: str = "mean") -> Column:
    w = W.partitionBy(*by)
    return F.col(c) - (F.avg(c) if how == "mean" else F.percentile(c, F.lit(0.5))).over(w)


def reference_excess(c: str, inside: Column, by: list[str]) -> Column:
    """Deviation from the group's mean over the rows of a reference band."""
    return F.col(c) - F.avg(F.when(inside, F.col(c))).over(W.partitionBy(*by))


def own_history_z(df: DataFrame, c: str, least: int = 12, limit: float = 2.0, *, by: str = "cell") -> DataFrame:
    """``z`` of each value in its cell's history and a label: anomalous, normal or insufficient_history."""
    w = W.partitionBy(by)
    sd = F.stddev_samp(c).over(w)
    z = F.when((F.count(c).over(w) >= least) & (sd > 0), (F.col(c) - F.avg(c).over(w)) / sd)
    label = F.when(F.count(c).over(w) < least, "insufficient_history").when(F.abs(z) >= limit, "anomalous").otherwise("normal")
    return df.withColumns({"z": z, "label": label})


def at_group_quantile(df: DataFrame, columns: list[str], by: str, q: float) -> DataFrame:
    """``<c>_high`` for each column: the value reaches the quantile of its own group."""
    cuts = order.quantiles(df, [by], {f"_{c}": (c, q) for c in columns})
    return df.join(cuts, by, "left").withColumns({f"{c}_high": F.coalesce(F.col(c) >= F.col(f"_{c}"), F.lit(False)) for c in columns}).drop(*[f"_{c}" for c in columns])


def runs(df: DataFrame, flag: Column, *, by: str = "cell", week: str = "week") -> DataFrame:
    """For each group, how many runs of true flags there are, the longest and the mean length."""
    place = F.row_number().over(series(by, order=week))
    marked = df.withColumns({"_f": F.coalesce(flag, F.lit(False)), "_i": place})
    island = marked.where("_f").withColumn("_g", F.col("_i") - F.row_number().over(series(by, order=week)))
    return island.groupBy(by, "_g").count().groupBy(by).agg(F.count("*").alias("n_runs"), F.max("count").alias("longest"), F.round(F.avg("count"), 6).alias("mean_length"))


def direction(df: DataFrame, value: str, order: str, by: str) -> DataFrame:
    """Of each group's ordered values: flat, increasing, decreasing or mixed, and the mean step."""
    step = F.lead(value).over(series(by, order=order)) - F.col(value)
    word = F.when(F.count("_d") == 0, "undetermined").when((F.min("_d") == 0) & (F.max("_d") == 0), "flat").when(F.min("_d") >= 0, "increasing").when(F.max("_d") <= 0, "decreasing").otherwise("mixed")
    return df.withColumn("_d", step).groupBy(by).agg(word.alias("direction"), F.round(F.avg("_d"), 6).alias("mean_step"))
