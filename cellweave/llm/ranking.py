"""Gapless ranks within large groups, without one task per group."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .clusterio import cut


def gapless(df: DataFrame, group: str, spread: list[str], order: list[str], *, splits: int = 64, per_split: int = 2_000_000, few: int = 200_000, name: str = "slot") -> DataFrame:
    """``df`` with ``name``: 0, 1, ... within each ``group``, in as many places as there are splits.

    Rows of a group are dealt to ``splits`` parts, or more so that a part has about ``per_split`` rows, by a hash of
    ``spread``, numbered inside their part in ``order``, and shifted by the sizes of the parts before.  The sizes
    are at most groups x splits rows, broadcast if these are no more than ``few``.
    """
    splits = max(splits, -(-df.count() // per_split))
    dealt = df.withColumn("_part", F.pmod(F.xxhash64(*spread), F.lit(splits)))
    sizes = dealt.groupBy(group, "_part").agg(F.count("*").alias("_n"))
    before = W.partitionBy(group).orderBy("_part").rowsBetween(W.unboundedPreceding, -1)
    shift = cut(sizes.select(F.col(group).alias("_g"), F.col("_part").alias("_p"), F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before")))
    shift = F.broadcast(shift) if shift.count() <= few else shift
    place = F.row_number().over(W.partitionBy(group, "_part").orderBy(*order)) - 1
    ranked = dealt.withColumn("_place", place)
    joined = ranked.join(shift, (F.col(group).eqNullSafe(F.col("_g"))) & (F.col("_part") == F.col("_p")))
    return joined.withColumn(name, (F.col("_place") + F.col("_before")).cast("long")).drop("_part", "_place", "_g", "_p", "_before")


def in_order(df: DataFrame, group: str, order: list[str], *, name: str = "at", total: str = "total", few: int = 200_000) -> DataFrame:
    """``df`` with ``name``: 0, 1, ... in ``order`` within each ``group``, and ``total``, the rows of the group.

    Rows are sorted over range partitions of (group, order), so a large group lies in many; the place in a partition
    is shifted by the group's rows in the partitions before.  There is a row of shifts for each group and partition
    that meet, at most groups + partitions in all, broadcast if no more than ``few``.  ``df`` is read twice (ranges are
    sampled), so it should be a written table of light rows.  Nulls come first; equal rows get places in any order.
    """
    partitions = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranged = df.repartitionByRange(partitions, group, *order).sortWithinPartitions(group, *order)
    rows = cut(ranged.withColumn("_id", F.monotonically_increasing_id()))  # the partition above 33 bits, the place in it below
    rows = rows.withColumns({"_part": F.shiftright("_id", 33), "_local": F.col("_id").bitwiseAND(F.lit((1 << 33) - 1))}).drop("_id")
    own = W.partitionBy("_g")
    sizes = rows.groupBy(F.col(group).alias("_g"), F.col("_part").alias("_p")).agg(F.min("_local").alias("_from"), F.count("*").alias("_n"))
    before = F.coalesce(F.sum("_n").over(own.orderBy("_p").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    shift = cut(sizes.select("_g", "_p", (before - F.col("_from")).alias("_shift"), F.sum("_n").over(own).alias(total)))
    shift = F.broadcast(shift) if shift.count() <= few else shift
    joined = rows.join(shift, F.col(group).eqNullSafe(F.col("_g")) & (F.col("_part") == F.col("_p")))
    return joined.withColumn(name, F.col("_local") + F.col("_shift")).drop("_part", "_local", "_g", "_p", "_shift")
