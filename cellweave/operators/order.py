"""Exact quantiles and ranks within groups of any size, from an ordered index of their values.

Equal values of a group are counted before anything is sorted, and the counts are cut into ranges of (group, value)
that are written once.  The sizes of the ranges, a row for each group and range that meet, are summed from the left,
so every range knows how many values lie before it.  A quantile reads only the ranges that hold its two neighbours; a
rank is the range's start plus a running sum inside it.  No task holds more than a range, however few the groups are,
and one index serves all quantiles and ranks of the values that were put into it.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..session import cut

FEW = 200_000  # distinct values that are sent to every task


@dataclass
class ValueIndex:
    """``rows``: a group's distinct values with their counts ``_n`` and range ``_part``; ``spans``: the ranges' sizes, the values before them and the group's ``_total``."""

    by: list[str]
    value: str
    rows: DataFrame
    spans: DataFrame

    def _running(self, spans: DataFrame) -> DataFrame:
        """Values of the given ranges with ``_to``, the number of values up to and with them in their group."""
        inside = F.sum("_n").over(W.partitionBy(*self.by, "_part").orderBy(self.value))
        return self.rows.join(spans, [*self.by, "_part"]).withColumn("_to", F.col("_before") + inside)

    def ranks(self) -> DataFrame:
        """The groups' distinct values with ``_rank`` (ties at their mean), ``_n`` and ``_total``."""
        return self._running(self.spans).withColumn("_rank", F.col("_to") - F.col("_n") + (F.col("_n") + 1) / 2).select(*self.by, self.value, "_rank", "_n", "_total")

    def is_small(self) -> bool:
        return self.rows.limit(FEW + 1).count() <= FEW

    def quantiles(self, by: list[str], wanted: dict[str, tuple[Column, float]]) -> DataFrame:
        """A row for each of ``by`` (some of the index's groups' names): each wanted name has a condition on a group and a share q; between neighbours it is linear."""
        at = lambda q: F.lit(float(q)) * (F.col("_total") - 1)
        asked = [F.when(which, F.struct(F.lit(name).alias("name"), F.lit(side).alias("side"), (F.floor(at(q)) if side == 0 else F.ceil(at(q))).cast("long").alias("pos"))) for name, (which, q) in wanted.items() for side in (0, 1)]
        here = lambda a, b: lambda w: w.isNotNull() & (w["pos"] >= a) & (w["pos"] < b)
        spans = self.spans.withColumn("_w", F.filter(F.array(*asked), here(F.col("_before"), F.col("_before") + F.col("_size")))).where(F.size("_w") > 0)
        hits = self._running(spans).withColumn("_h", F.explode(F.filter("_w", here(F.col("_to") - F.col("_n"), F.col("_to")))))
        of = lambda name, side, c: F.max(F.when((F.col("_h.name") == name) & (F.col("_h.side") == side), F.col(c)))
        made = []
        for name, (_, q) in wanted.items():
            low, high, h = of(name, 0, self.value), of(name, 1, self.value), q * (of(name, 0, "_total") - 1)
            made.append(F.when(F.floor(h) == h, low).otherwise((F.ceil(h) - h) * low + (h - F.floor(h)) * high).alias(name))
        return hits.groupBy(*by).agg(*made)


def index(rows: DataFrame, by: list[str], value: str, parts: int | None = None) -> ValueIndex:
    """The index of ``value`` within ``by``, in ``parts`` ranges (as many as shuffles have, if not given); null values are not in it, groups must not be null."""
    partitions = parts or int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    counts = rows.where(F.col(value).isNotNull()).groupBy(*by, value).agg(F.count("*").alias("_n"))
    held = cut(counts.repartitionByRange(partitions, *by, value).withColumn("_part", F.spark_partition_id()))
    sizes = held.groupBy(*by, "_part").agg(F.sum("_n").alias("_size"))
    own = W.partitionBy(*by)
    before = F.coalesce(F.sum("_size").over(own.orderBy("_part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    return ValueIndex(list(by), value, held, sizes.withColumns({"_before": before, "_total": F.sum("_size").over(own)}))


def quantiles(df: DataFrame, by: list[str], wanted: dict[str, tuple[Column | str, float]]) -> DataFrame:
    """``by`` and a column for each wanted name: the q-quantile of a number, linear between its neighbours, nulls left out.

    A group without any values has no row; without ``by`` there is one row, null where there are no values.
    """
    columns: list = []
    at = {}
    for name, (c, _) in wanted.items():
        key = c if isinstance(c, str) else str(c)
        if key not in (k for k, _ in columns):
            columns.append((key, F.col(c) if isinstance(c, str) else c))
        at[name] = [k for k, _ in columns].index(key)
    if len(columns) == 1:
        long = df.select(*by, F.lit(0).alias("_i"), columns[0][1].cast("double").alias("_v"))
    else:
        parts = F.array(*[F.struct(F.lit(i).alias("_i"), c.cast("double").alias("_v")) for i, (_, c) in enumerate(columns)])
        long = df.select(*by, F.explode(parts).alias("_p")).select(*by, "_p.*")
    return index(long, [*by, "_i"], "_v").quantiles(by, {name: (F.col("_i") == at[name], q) for name, (_, q) in wanted.items()})


def beside(made: DataFrame, df: DataFrame, by: list[str], wanted: dict[str, tuple[Column | str, float]]) -> DataFrame:
    """An aggregate of ``df`` by ``by`` (at least a row for each group, or one row without groups) with the wanted quantiles of the same rows."""
    q = quantiles(df, by, wanted)
    return made.join(q, by, "left") if by else made.crossJoin(F.broadcast(q))


def medians(made: DataFrame, df: DataFrame, by: list[str], value: Column | str, name: str = "median", digits: int = 6) -> DataFrame:
    """The same with one rounded median."""
    return beside(made, df, by, {name: (value, 0.5)}).withColumn(name, F.round(name, digits))


def ranked(df: DataFrame, by: list[str], c: str, name: str, *, ties: str | None = None, percent: bool = False) -> DataFrame:
    """Rows of ``df`` that have ``c`` with its rank within ``by``, ties at their mean (``percent``: over the number of values); ``ties`` names the number of equal values.

    ``df`` is read twice.  Ranks of no more than ``FEW`` distinct values are sent to the rows; more are joined by value,
    where a value that very many rows have is a large partition that adaptive execution splits.
    """
    made = index(df, by, c)
    rank = F.col("_rank") / F.col("_total") if percent else F.col("_rank")
    told = made.ranks().select(*by, c, rank.alias(name), *([F.col("_n").alias(ties)] if ties else []))
    return df.join(F.broadcast(told) if made.is_small() else told, [*by, c])
