"""Aggregations of panels: profiles, bands, zones, sliding windows, audits."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import order


def r6(c: Column) -> Column:
    return F.round(c, 6)


def record_summary(df: DataFrame, by: list[str], ref: str, ts: str) -> DataFrame:
    """Rows, sorted distinct references, first and last time of each group."""
    return df.groupBy(*by).agg(F.count("*").alias("n"), F.array_sort(F.collect_set(ref)).alias("refs"), F.min(ts).alias("first_ts"), F.max(ts).alias("last_ts"))


def property_stats(df: DataFrame, by: list[str], payload: str, prefix: str, names: list[str] | None = None) -> DataFrame:
    """Mean and median of every numeric property of a JSON object, as columns of their own."""
    entries = F.explode(F.from_json(payload, "map<string,string>"))
    long = df.select(*by, entries.alias("_k", "_s")).select(*by, F.translate("_k", ":-.", "___").alias("_k"), F.col("_s").try_cast("double").alias("_v")).where("_v is not null")
    wide = long.groupBy(*by).pivot("_k", names) if names else long.groupBy(*by).pivot("_k")
    out = wide.agg(r6(F.avg("_v")).alias("mean"), r6(F.percentile("_v", F.lit(0.5))).alias("median"))
    return out.toDF(*[c if c in by else f"{prefix}_{c}" for c in out.columns])


def profile(stack: DataFrame, by: list[str] = ("indicator",), value: str = "value") -> DataFrame:
    """n, mean, standard deviation, extremes, quartiles, outer percentiles, skewness and excess kurtosis."""
    made = stack.groupBy(*by).agg(
        F.count(value).alias("n"), r6(F.avg(value)).alias("mean"), r6(F.stddev_samp(value)).alias("std"), F.min(value).alias("min"), F.max(value).alias("max"),
        F.round(F.skewness(value), 4).alias("skew"), F.round(F.kurtosis(value), 4).alias("excess_kurtosis"),
    )
    shares = {"p5": 0.05, "p25": 0.25, "median": 0.5, "p75": 0.75, "p95": 0.95}
    return order.beside(made, stack, list(by), {name: (value, q) for name, q in shares.items()}).withColumns({name: r6(F.col(name)) for name in shares})


def column_audit(df: DataFrame, columns: list[str]) -> DataFrame:
    """For each column: values, missing and zero percent, distinct values, mean, standard deviation, extremes."""
    stack = df.select(*[F.col(c).cast("double").alias(c) for c in columns]).unpivot([], columns, "column", "value")
    share = lambda c: r6(100 * F.sum(c.cast("long")) / F.count("*"))
    return stack.groupBy("column").agg(
        F.count("value").alias("non_null"), share(F.col("value").isNull()).alias("missing_percent"), share(F.coalesce(F.col("value") == 0, F.lit(False))).alias("zero_percent"),
        F.countDistinct("value").alias("n_unique"), r6(F.avg("value")).alias("mean"), r6(F.stddev_samp("value")).alias("std"), F.min("value").alias("min"), F.max("value").alias("max"),
    )


def missing_ratio(columns: list[str]) -> Column:
    """Share of the columns that are null in a row."""
    return sum((F.col(c).isNull().cast("double") for c in columns), F.lit(0.0)) / len(columns)


def band_table(stack: DataFrame, bands: DataFrame | None, by: list[str] = ("band", "indicator")) -> DataFrame:
    """Mean, median, deviation and counts for each band and indicator; with a table of ``by``, empty combinations too."""
    made = stack.groupBy(*by).agg(F.count("value").alias("n"), F.countDistinct("cell").alias("cells"), r6(F.avg("value")).alias("mean"), r6(F.stddev_samp("value")).alias("std"))
    made = order.medians(made, stack, list(by), "value")
    if bands is None:
        return made
    zero = F.lit(0).cast("long")
    return F.broadcast(bands).join(made, list(by), "left").withColumns({"n": F.coalesce("n", zero), "cells": F.coalesce("cells", zero)})


def in_overlapping(df: DataFrame, zones: dict[str, Column], name: str) -> DataFrame:
    """A row for each zone whose condition holds; zones may overlap."""
    hits = F.filter(F.array(*[F.when(c, F.lit(z)) for z, c in zones.items()]), lambda z: z.isNotNull())
    return df.withColumn(name, F.explode(hits))


def sliding_windows(df: DataFrame, distance: str, value: str, width: float, step: float, *, by: list[str] = (), least: int = 10) -> DataFrame:
    """Overlapping windows [s, s + width), s a multiple of ``step`` from 0: count, mean, median, deviation, sufficiency."""
    last = F.floor(F.col(distance) / step).cast("long")
    first = F.greatest(F.floor((F.col(distance) - width) / step).cast("long") + 1, F.lit(0).cast("long"))
    rows = df.where((F.col(distance) >= 0) & F.col(value).isNotNull()).withColumn("_k", F.explode(F.sequence(first, last)))
    rows = rows.withColumn("start_km", (F.col("_k") * step).cast("double"))
    made = rows.groupBy(*by, "start_km").agg(F.count("*").alias("n"), r6(F.avg(value)).alias("mean"), r6(F.stddev_samp(value)).alias("std"), (F.count("*") >= least).alias("sufficient"))
    return order.medians(made, rows, [*by, "start_km"], value)


def quantile_bins(df: DataFrame, c: str, n: int, name: str = "bin") -> DataFrame:
    """Bins 0 ... n - 1 by linear quantiles, closed on the right, the lowest value in the first; equal edges merge bins."""
    names = [f"_e{k}" for k in range(n + 1)]
    edges = order.quantiles(df, [], {name: (c, k / n) for k, name in enumerate(names)}).select(F.array_distinct(F.array_compact(F.array(*names))).alias("_e"))
    inner = F.slice(F.col("_e"), 2, F.greatest(F.size("_e") - 2, F.lit(0)))
    return df.crossJoin(F.broadcast(edges)).withColumn(name, F.when(F.col(c).isNotNull(), F.size(F.filter(inner, lambda e: e < F.col(c))))).drop("_e")


def mean_error(df: DataFrame, by: list[str], value: str) -> DataFrame:
    """n, mean and its standard error, 0 for a single value."""
    n = F.count(value)
    return df.groupBy(*by).agg(n.alias("n"), r6(F.avg(value)).alias("mean"), r6(F.when(n == 1, 0.0).otherwise(F.stddev_samp(value) / F.sqrt(n))).alias("se"))


def missing_weeks(df: DataFrame, week: str = "week") -> DataFrame:
    """First and last week, weeks there, weeks expected and the missing ones."""
    span = df.agg(F.min(week).alias("first_week"), F.max(week).alias("last_week"), F.count_distinct(week).alias("n_weeks"))
    calendar = span.select(F.explode(F.sequence("first_week", "last_week", F.expr("interval 7 days"))).alias(week))
    gaps = calendar.join(df.select(week).distinct(), week, "left_anti").agg(F.count("*").alias("n_missing"))
    return span.crossJoin(gaps).withColumn("n_expected", F.col("n_weeks") + F.col("n_missing"))


def key_report(df: DataFrame, key: list[str]) -> DataFrame:
    """Rows, keys, keys with several rows and the rows beyond the first of their key."""
    per = df.groupBy(*key).count()
    return per.agg(F.sum("count").alias("rows"), F.count("*").alias("keys"), F.coalesce(F.sum((F.col("count") > 1).cast("long")), F.lit(0).cast("long")).alias("repeated_keys"), F.coalesce(F.sum(F.col("count") - 1), F.lit(0).cast("long")).alias("extra_rows"))


def tukey(stack: DataFrame, by: str = "indicator", value: str = "value", k: float = 1.5) -> DataFrame:
    """Quartiles, fences and the number of values outside."""
    q = order.quantiles(stack, [by], {"q1": (value, 0.25), "q3": (value, 0.75)})
    fences = q.withColumns({"iqr": F.col("q3") - F.col("q1")}).withColumns({"low": F.col("q1") - k * F.col("iqr"), "high": F.col("q3") + k * F.col("iqr")})
    out = (F.col(value) < F.col("low")) | (F.col(value) > F.col("high"))
    return stack.join(fences, by).groupBy(by, "q1", "q3", "iqr", "low", "high").agg(F.sum(out.cast("long")).alias("n_outliers")).select(by, *[r6(F.col(c)).alias(c) for c in ("q1", "q3", "iqr", "low", "high")], "n_outliers")


def variation(df: DataFrame, value: str, *, by: str = "cell") -> DataFrame:
    """Weeks, distinct values and deviation of each group."""
    return df.groupBy(by).agg(F.count(value).alias("weeks"), F.count_distinct(value).alias("n_unique"), r6(F.stddev_pop(value)).alias("std"))


def variation_status(df: DataFrame, value: str, *, by: str = "cell", week: str = "week", static_share: float = 0.9) -> DataFrame:
    """Whether a layer changes in time: temporal, spatial_proxy (static in nearly all cells) or unusable (no values)."""
    cells = variation(df, value, by=by).where("weeks > 0").agg(F.count("*").alias("cells"), r6(F.avg((F.col("n_unique") <= 1).cast("double"))).alias("static_share"))
    weekly = df.groupBy(week).agg(F.avg(value).alias("m")).agg(r6(F.stddev_pop("m")).alias("weekly_std"))
    status = F.when(F.col("cells") == 0, "unusable").when((F.col("static_share") >= static_share) | (F.coalesce("weekly_std", F.lit(0.0)) < 1e-9), "spatial_proxy").otherwise("temporal")
    return cells.crossJoin(weekly).withColumn("status", status)


def co_occurrence(flags: DataFrame, names: list[str]) -> DataFrame:
    """How many rows have both flags, for every pair of flags (and each with itself)."""
    pairs = [(a, b) for i, a in enumerate(names) for b in names[i:]]
    counts = flags.agg(*[F.sum((F.col(a) & F.col(b)).cast("long")).alias(f"{a}|{b}") for a, b in pairs])
    long = counts.unpivot([], counts.columns, "pair", "n")
    return long.select(F.split("pair", "\\|")[0].alias("a"), F.split("pair", "\\|")[1].alias("b"), "n")


def resultant(df: DataFrame, by: list[str], u: str, v: str) -> DataFrame:
    """Direction ``to_deg`` and ``speed`` of each group's mean vector, from components to 9 digits; vectors that cancel out have no direction, only speed 0."""
    mean = df.groupBy(*by).agg(F.round(F.avg(u), 9).alias("_u"), F.round(F.avg(v), 9).alias("_v"))
    to = F.when((F.col("_u") != 0) | (F.col("_v") != 0), F.round(F.pmod(F.degrees(F.atan2("_u", "_v")) + 360, F.lit(360.0)), 4))
    return mean.select(*by, to.alias("to_deg"), r6(F.sqrt(F.col("_u") * F.col("_u") + F.col("_v") * F.col("_v"))).alias("speed"))
