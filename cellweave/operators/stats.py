"""Correlations, effect sizes and two-sample tests.

Spark makes the sums; p-values come from small Column expressions or, where an
incomplete beta function is needed, from a pandas UDF over the result rows.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..session import cut
from . import order, windows


def _beta_fraction(a: float, b: float, x: float) -> float:
    """Continued fraction of the incomplete beta function (Lentz's method)."""
    tiny = 1e-300
    c, d = 1.0, 1.0 - (a + b) * x / (a + 1)
    d = 1 / (d if abs(d) > tiny else tiny)
    out = d
    for m in range(1, 400):
        for num in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
            d, c = 1 + num * d, 1 + num / c
            d, c = 1 / (d if abs(d) > tiny else tiny), c if abs(c) > tiny else tiny
            out *= d * c
        if abs(d * c - 1) < 1e-14:
            break
    return out


def incomplete_beta(a: float, b: float, x: float) -> float:
    """Regularised incomplete beta function."""
    if x <= 0 or x >= 1:
        return float(x >= 1)
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x))
    return front * _beta_fraction(a, b, x) / a if x < (a + 1) / (a + b + 2) else 1 - front * _beta_fraction(b, a, 1 - x) / b


def t_two_sided(t: float, df: float) -> float:
    return incomplete_beta(df / 2, 0.5, df / (df + t * t))


def f_upper(f: float, d1: float, d2: float) -> float:
    return incomplete_beta(d2 / 2, d1 / 2, d2 / (d2 + d1 * f))


def _on_rows(fn, *columns: Column) -> Column:
    """A function of numbers over result rows; null where an argument is null."""

    def apply(*parts: pd.Series) -> pd.Series:
        return pd.Series([fn(*v) if all(x == x for x in v) else None for v in zip(*parts, strict=True)], dtype="float64")

    return F.pandas_udf(apply, "double")(*[c.cast("double") for c in columns])


def t_p(t: Column, df: Column) -> Column:
    """Two-sided p of Student's t."""
    return _on_rows(lambda a, b: t_two_sided(a, b) if b > 0 else None, t, df)


def f_p(f: Column, d1: Column, d2: Column) -> Column:
    """Upper tail of the F distribution."""
    return _on_rows(lambda a, b, c: f_upper(a, b, c) if b > 0 and c > 0 else None, f, d1, d2)


def normal_p(z: Column) -> Column:
    """Two-sided p of a standard normal."""
    return _on_rows(lambda a: math.erfc(abs(a) / math.sqrt(2)), z)


def pair_list(columns: list[str]) -> list[tuple[str, str]]:
    return [(a, b) for i, a in enumerate(columns) for b in columns[i + 1 :]]


def long_pairs(df: DataFrame, pairs: list[tuple[str, str]], keep: tuple[str, ...] = ()) -> DataFrame:
    """A row for each pair of columns where both are there: ``a``, ``b``, ``x``, ``y``."""
    made = F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), F.col(a).cast("double").alias("x"), F.col(b).cast("double").alias("y")) for a, b in pairs])
    return df.select(*keep, F.explode(made).alias("p")).select(*keep, "p.*").where("x is not null and y is not null")


def correlations(df: DataFrame, pairs: list[tuple[str, str]], *, by: tuple[str, ...] = (), least: int = 3, ranks: bool = True) -> DataFrame:
    """Pearson and (unless ``ranks`` is false) Spearman coefficients on the rows that have both values, null below ``least`` rows or without spread."""
    group = [*by, "a", "b"]
    rows = long_pairs(cut(df.select(*by, *dict.fromkeys(c for p in pairs for c in p))) if ranks else df, pairs, by)
    made = lambda x, y: F.when(F.count("*") >= least, windows.correlation(F.col(x), F.col(y)))
    if not ranks:
        return rows.groupBy(*group).agg(F.count("*").alias("n"), F.round(made("x", "y"), 6).alias("pearson"))
    return both_ranked(rows, group, "x", "y").groupBy(*group).agg(F.count("*").alias("n"), F.round(made("x", "y"), 6).alias("pearson"), F.round(made("rx", "ry"), 6).alias("spearman"))


def both_ranked(rows: DataFrame, by: list[str], x: str, y: str) -> DataFrame:
    """``rows`` (which have both values) with ``rx`` and ``ry``, the ranks within ``by``; one index holds the values of both sides.

    ``rows`` are read twice, so they should come from a written table.
    """
    sides = F.array(*[F.struct(F.lit(i).alias("_side"), F.col(c).cast("double").alias("_v")) for i, c in enumerate((x, y))])
    made = order.index(rows.select(*by, F.explode(sides).alias("_s")).select(*by, "_s.*"), [*by, "_side"], "_v")
    told, few = made.ranks(), made.is_small()
    for i, (c, name) in enumerate(((x, "rx"), (y, "ry"))):
        side = told.where(F.col("_side") == i).select(*by, F.col("_v").alias(c), F.col("_rank").alias(name))
        rows = rows.join(F.broadcast(side) if few else side, [*by, c])
    return rows


def correlation_t(r: Column, n: Column) -> Column:
    return r * F.sqrt((n - 2) / F.nullif(1 - r * r, F.lit(0.0)))


def lag_correlations(df: DataFrame, pairs: list[tuple[str, str]], lags: range, *, by: str = "cell", week: str = "week", group: tuple[str, ...] = (), least: int = 10) -> DataFrame:
    """Correlation of x(t) with y(t + k) within a series, pooled (or by ``group``), for each lag k."""
    w = W.partitionBy(by).orderBy(week)
    made = [F.struct(F.lit(k).alias("lag"), F.lit(a).alias("a"), F.lit(b).alias("b"), F.col(a).cast("double").alias("x"), F.lead(b, k).over(w).cast("double").alias("y")) for a, b in pairs for k in lags]
    wide = df.select(*group, F.array(*made).alias("_p"))
    rows = (wide if group else cut(wide)).select(*group, F.explode("_p").alias("p")).select(*group, "p.*").where("x is not null and y is not null")
    keys = [*group, "a", "b", "lag"]
    if group:  # many groups, each of moderate size
        ranked = rows.withColumns({"rx": windows.average_rank(F.col("x"), keys), "ry": windows.average_rank(F.col("y"), keys)})
    else:
        ranked = both_ranked(rows, keys, "x", "y")
    pick = lambda x, y: F.round(F.when(F.count("*") >= least, windows.correlation(F.col(x), F.col(y))), 6)
    return ranked.groupBy(*keys).agg(F.count("*").alias("n"), pick("x", "y").alias("pearson"), pick("rx", "ry").alias("spearman"))


def best_lag(curve: DataFrame, by: list[str], value: str = "spearman") -> DataFrame:
    """The lag with the greatest absolute coefficient, the shorter on ties."""
    order = F.max(F.when(F.col(value).isNotNull(), F.struct(F.abs(F.col(value)).alias("size"), (-F.col("lag")).alias("minus"), F.col(value).alias("r"))))
    return curve.groupBy(*by).agg(order.alias("_b")).select(*by, (-F.col("_b.minus")).alias("best_lag"), F.col("_b.r").alias("best"))


def two_sample(rows: DataFrame, by: list[str], side: Column, value: str = "value") -> DataFrame:
    """Comparison of the values where ``side`` is true (1) and false (0): sizes, means, medians, difference in percent,
    Cohen's d, Welch's t with its p, Mann-Whitney U of side 1 with the tie-corrected normal p, Cliff's delta.

    Rows whose side or value is null are left out; a side without values gives nulls.
    """
    r = rows.select(*by, side.alias("_s"), F.col(value).cast("double").alias("_v")).where("_s is not null and _v is not null")
    r = cut(r.dropna(subset=by) if by else r)
    kinds = F.array(F.lit(0), F.when(F.col("_s"), 1).otherwise(2))  # all values, and those of a side
    made = order.index(r.select(*by, "_v", F.explode(kinds).alias("_kind")), [*by, "_kind"], "_v")
    halves = made.quantiles(by, {"median1": (F.col("_kind") == 1, 0.5), "median0": (F.col("_kind") == 2, 0.5)})
    told = made.ranks().where("_kind = 0").select(*by, "_v", F.col("_rank").alias("_r"), F.col("_n").alias("_t"))
    r = r.join(F.broadcast(told) if made.is_small() else told, [*by, "_v"])
    one, two = F.when(F.col("_s"), F.col("_v")), F.when(~F.col("_s"), F.col("_v"))
    agg = r.groupBy(*by).agg(
        F.count(one).alias("n1"), F.count(two).alias("n0"), F.avg(one).alias("m1"), F.avg(two).alias("m0"), F.var_samp(one).alias("v1"), F.var_samp(two).alias("v0"),
        F.sum(F.when(F.col("_s"), F.col("_r"))).alias("rs"), F.sum(F.col("_t").cast("double") * F.col("_t") - 1).alias("ties"),
    )
    agg = agg.join(halves, by, "left") if by else agg.crossJoin(F.broadcast(halves))
    n1, n0, v1, v0 = (F.col(c) for c in ("n1", "n0", "v1", "v0"))
    n = n1 + n0
    some = (n1 > 0) & (n0 > 0)
    se2 = v1 / n1 + v0 / n0
    agg = agg.withColumns({
        "diff": F.col("m1") - F.col("m0"),
        "cohens_d": (F.col("m1") - F.col("m0")) / F.nullif(F.sqrt(((n1 - 1) * v1 + (n0 - 1) * v0) / F.nullif(n - 2, F.lit(0))), F.lit(0.0)),
        "t": (F.col("m1") - F.col("m0")) / F.nullif(F.sqrt(se2), F.lit(0.0)),
        "df": se2 * se2 / F.nullif(F.pow(v1 / n1, 2) / F.nullif(n1 - 1, F.lit(0)) + F.pow(v0 / n0, 2) / F.nullif(n0 - 1, F.lit(0)), F.lit(0.0)),
        "u": F.when(some, F.col("rs") - n1 * (n1 + 1) / 2),
    })
    spread = F.sqrt(n1 * n0 / 12.0 * ((n + 1) - F.col("ties") / (n * F.nullif(n - 1, F.lit(0)))))
    z = (F.greatest(F.abs(F.col("u") - n1 * n0 / 2.0) - 0.5, F.lit(0.0))) / F.nullif(spread, F.lit(0.0))
    agg = agg.withColumns({"mw_z": z, "cliffs_delta": 2 * F.col("u") / (n1 * n0) - 1, "percent": 100 * F.col("diff") / F.nullif(F.abs(F.col("m0")), F.lit(0.0))})
    agg = agg.withColumns({"welch_p": t_p(F.col("t"), F.col("df")), "mw_p": normal_p(F.col("mw_z"))})
    names = ["m1", "m0", "median1", "median0", "diff", "percent", "cohens_d", "t", "df", "welch_p", "u", "mw_z", "mw_p", "cliffs_delta"]
    return agg.select(*by, "n1", "n0", *[F.round(F.col(c), 6).alias(c) for c in names])


def masked_standing(rows: DataFrame, mask: Column, by: str, value: str, *, limit: float = 3.5) -> DataFrame:
    """``rows`` with ``inside`` (the mask, false where it is null) and, inside, the value's standing among the values of ``by`` there.

    ``rank_pct`` is the average-tie percent rank, ``robust_z`` the deviation from the median over the inter-quartile
    range as a normal deviation, held to +-``limit``; null in groups without spread, outside, and for null values.
    Both come from one index of the values inside.
    """
    held = cut(rows.withColumn("inside", F.coalesce(mask, F.lit(False))).withColumn("_v", F.when(F.col("inside"), F.col(value).cast("double"))))
    made = order.index(held.select(by, "_v"), [by], "_v")
    shares = {"_q1": 0.25, "_q2": 0.5, "_q3": 0.75}
    quartiles = made.quantiles([by], {name: (F.lit(True), q) for name, q in shares.items()})
    told = made.ranks().select(by, "_v", (F.col("_rank") / F.col("_total")).alias("rank_pct"))
    out = held.join(F.broadcast(told) if made.is_small() else told, [by, "_v"], "left").join(quartiles, by, "left")
    spread = F.col("_q3") - F.col("_q1")
    z = F.when(spread >= 1e-12, (F.col("_v") - F.col("_q2")) / (spread / 1.34896))
    return out.withColumn("robust_z", F.when(z.isNotNull(), F.greatest(F.lit(-limit), F.least(F.lit(limit), z)))).drop("_v", *shares)


def anova(rows: DataFrame, by: list[str], group: str, value: str = "value") -> DataFrame:
    """One-way analysis of variance over groups of at least two values: F and its p."""
    g = rows.where(F.col(value).isNotNull()).groupBy(*by, group).agg(F.count(value).alias("n"), F.avg(value).alias("m"), F.var_pop(value).alias("v")).where("n > 1")
    t = g.groupBy(*by).agg(F.count("*").alias("k"), F.sum("n").alias("n"), (F.sum(F.col("n") * F.col("m")) / F.sum("n")).alias("grand"), F.sum(F.col("n") * F.col("v")).alias("within"), F.sum(F.col("n") * F.col("m") * F.col("m")).alias("raw"))
    between = F.col("raw") - F.col("n") * F.col("grand") * F.col("grand")
    t = t.withColumns({"d1": (F.col("k") - 1).cast("double"), "d2": (F.col("n") - F.col("k")).cast("double")})
    t = t.withColumn("f", (between / F.nullif(F.col("d1"), F.lit(0.0))) / F.nullif(F.col("within") / F.nullif(F.col("d2"), F.lit(0.0)), F.lit(0.0)))
    return t.withColumn("p", f_p(F.col("f"), F.col("d1"), F.col("d2"))).select(*by, F.col("k").alias("groups"), "n", F.round("f", 4).alias("f"), F.round("p", 6).alias("p"))


def hashed_again(seeds: np.ndarray, numbers: np.ndarray) -> np.ndarray:
    """XXH64 of each number as 32 bits with each seed, as the SQL function of that name hashes one more integer column."""
    one, two, three, five = (np.uint64(x) for x in (0x9E3779B185EBCA87, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x27D4EB2F165667C5))
    h = (seeds + five + np.uint64(4))[:, None] ^ (numbers.astype(np.uint64) * one)[None, :]
    h = ((h << np.uint64(23)) | (h >> np.uint64(41))) * two + three
    h = (h ^ (h >> np.uint64(33))) * two
    h = (h ^ (h >> np.uint64(29))) * three
    return h ^ (h >> np.uint64(32))


class Draws:
    """Sums of Poisson weights and of weighted values for all draws of each group that comes along."""

    def __init__(self, draws: int, seed: int, most: int = 2_000_000) -> None:
        cdf, p, total = [], math.exp(-1), 0.0
        for k in range(7):
            total += p
            cdf.append(round(total * 65536))
            p /= k + 1
        self.cdf, self.draws, self.most = np.array(cdf), draws, most
        self.lanes = np.arange(seed, seed + -(-draws // 4))
        self.groups: dict[str, np.ndarray] = {}

    def weights(self, hashes: np.ndarray) -> np.ndarray:
        """A row for each hash, a column for each draw; a hash and a lane make four draws of 16 bits."""
        parts = hashed_again(hashes, self.lanes)[:, :, None] >> np.arange(0, 64, 16, dtype=np.uint64)[None, None, :]
        return np.searchsorted(self.cdf, (parts & np.uint64(0xFFFF)).reshape(len(hashes), -1)[:, : self.draws], side="right")

    def add(self, group: np.ndarray, names: list[str], values: np.ndarray, hashes: np.ndarray) -> None:
        order = np.argsort(group, kind="stable")
        for at in np.array_split(order, max(1, -(-len(order) // 1024))):
            weights = self.weights(hashes[at]).astype(np.float64)
            starts = np.flatnonzero(np.r_[True, np.diff(group[at]) != 0])
            for a, b in zip(starts, [*starts[1:], len(at)], strict=True):
                held = self.groups.setdefault(names[group[at[a]]], np.zeros((2, self.draws)))
                held[0] += weights[a:b].sum(axis=0)
                held[1] += values[at[a:b]] @ weights[a:b]

    def full(self) -> bool:
        return len(self.groups) * self.draws > self.most

    def emit(self, but: str | None = None) -> pa.RecordBatch:
        """The sums so far, which are forgotten; those of the group ``but`` are kept for later."""
        held, self.groups = self.groups, {}
        if but in held:
            self.groups[but] = held.pop(but)
        lists = [pa.array([x[k] for x in held.values()], pa.list_(pa.float64())) for k in (0, 1)]
        return pa.RecordBatch.from_arrays([pa.array(list(held), pa.string()), *lists], ["_g", "_w", "_wv"])


def draw_sums(rows: DataFrame, draws: int, seed: int) -> DataFrame:
    """Of rows of a group ``_g``, a value ``_v`` and a hash ``_h``: vectors ``_w`` and ``_wv`` of all draws' weights and weighted values.

    Rows are dealt out in ranges of groups, so there is one row for each group, and one more where a range begins inside of it.
    """
    partitions = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = Draws(draws, seed)
        for batch in batches:
            coded = batch.column(0).dictionary_encode()
            sums.add(coded.indices.to_numpy(), coded.dictionary.to_pylist(), batch.column(1).to_numpy(), batch.column(2).to_numpy().view(np.uint64))
            if sums.full():
                yield sums.emit(but=coded.dictionary[-1].as_py())  # groups come in order: the last may go on
        if sums.groups:
            yield sums.emit()

    ranges = rows.repartitionByRange(partitions, "_g", "_h").sortWithinPartitions("_g")
    return ranges.mapInArrow(add, "_g string, _w array<double>, _wv array<double>")


def bootstrap_mean(rows: DataFrame, by: list[str], value: str, *, draws: int = 500, seed: int = 42, key: tuple[str, ...] = ("cell", "week")) -> DataFrame:
    """Mean with a 95 % interval from Poisson resampling: a row's weight in each draw comes from a hash of its key, so
    the result does not depend on partitions.

    Rows (a group, a value and a hash) are dealt out in ranges of groups.  Each task reads its rows once and adds the
    weights of all draws to two vectors for each group, so rows are never multiplied; the vectors, one pair for each
    group and one more where a range begins inside of a group, are summed by group and turned into limits there.  A group
    without values has no limits.
    """
    name = F.to_json(F.struct(*[F.col(c) for c in by])) if by else F.lit("")
    some = rows.where(F.col(value).isNotNull()).select(name.alias("_g"), F.col(value).cast("double").alias("_v"), F.xxhash64(*key).alias("_h"))

    def limit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        inside, total = None, np.zeros((2, draws))

        def done() -> pa.RecordBatch:
            means = total[1][total[0] > 0] / total[0][total[0] > 0]
            low, high = np.quantile(means, [0.025, 0.975]) if len(means) else (None, None)
            return pa.RecordBatch.from_arrays([pa.array([inside]), pa.array([low], pa.float64()), pa.array([high], pa.float64())], ["_g", "low", "high"])

        for batch in batches:
            for k, group in enumerate(batch.column(0).to_pylist()):
                if group != inside:
                    if inside is not None:
                        yield done()
                    inside, total = group, np.zeros((2, draws))
                for side in (0, 1):
                    total[side] += batch.column(1 + side)[k].values.to_numpy()
        if inside is not None:
            yield done()

    limits = draw_sums(some, draws, seed).repartition("_g").sortWithinPartitions("_g").mapInArrow(limit, "_g string, low double, high double")
    means = rows.groupBy(*by).agg(F.count(value).alias("n"), F.round(F.avg(value), 6).alias("mean")).withColumn("_g", name)
    return means.join(limits, "_g", "left").select(*by, "n", "mean", F.round("low", 6).alias("ci95_low"), F.round("high", 6).alias("ci95_high"))


def jarque_bera(stack: DataFrame, by: str = "indicator", value: str = "value") -> DataFrame:
    """Moment test of normality: n, statistic and p (chi-squared with two degrees of freedom)."""
    jb = F.count(value) / 6 * (F.pow(F.skewness(value), 2) + F.pow(F.kurtosis(value), 2) / 4)
    return stack.groupBy(by).agg(F.count(value).alias("n"), jb.alias("_jb")).select(by, "n", F.round("_jb", 4).alias("jb"), F.round(F.exp(-F.col("_jb") / 2), 6).alias("p"))


def alias_clusters(pairs: DataFrame, columns: list[str], limit: float = 0.98) -> DataFrame:
    """Connected components of columns whose |Pearson| reaches ``limit``: each column, its cluster's first column, whether to keep it.

    There are as many nodes as columns, so a label passes through all of them in that many joins at most.
    """
    spark = pairs.sparkSession
    nodes = spark.createDataFrame([(c,) for c in columns], "column string")
    close = pairs.where(F.abs("pearson") >= limit).select(F.col("a").alias("u"), F.col("b").alias("v"))
    edges = close.unionByName(close.select(F.col("v").alias("u"), F.col("u").alias("v")))
    found = {frozenset((r.u, r.v)) for r in edges.collect()}  # at most columns squared
    label = {c: c for c in columns}
    for _ in columns:
        for a, b in (sorted(e) for e in found if len(e) == 2):
            low = min(label[a], label[b])
            label[a] = label[b] = low
    labels = spark.createDataFrame(list(label.items()), "column string, cluster string")
    return nodes.join(labels, "column").withColumn("keep", F.col("column") == F.col("cluster"))
