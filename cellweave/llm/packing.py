"""Packing into optimal length buckets.

The global histogram of lengths (tokens are words) comes to the driver in at
most some thousands of bins: every length below ``fine`` is a bin of its own and
longer ones share bins of one part in ``fine`` / 2, each known by the greatest
length that a row of it has.  A dynamic program cuts the bins into at most
``buckets`` runs so that padding every sequence to its bucket's upper bound
costs the fewest tokens; that is the optimum over all lengths below ``fine``, and
over all bounds that end a bin above.  Inside a bucket, sequences fill
batches of ``budget`` tokens in a fixed pseudo-random order; one longer than the
budget is a batch of its own.  Nothing is cut off or dropped.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .clusterio import cut
from .ranking import gapless

WORD = "[^\\x20\\x09-\\x0D]+"


def length_of(text: Column) -> Column:
    """Words of a text, 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def bin_top(length: Column, fine: int = 1024) -> Column:
    """The upper edge of the bin of a length."""
    over = F.greatest(F.floor(F.log2(F.greatest(length, F.lit(1)).cast("double") / fine)) + 1, F.lit(0))
    width = F.pow(F.lit(2.0), F.greatest(over, F.lit(0))).cast("long")
    return F.when(length < fine, length).otherwise((F.floor(length / width) + 1) * width - 1).cast("long")


def optimal_bounds(top: np.ndarray, count: np.ndarray, total: np.ndarray, buckets: int) -> tuple[list[int], int]:
    """Upper bounds of at most ``buckets`` runs of bins with the least padding, and that padding.

    ``top`` are the bins' greatest lengths in order, with the number and the sum of the lengths in each.
    """
    n = len(top)
    if not n:
        return [], 0
    c, s = np.concatenate([[0], np.cumsum(count)]), np.concatenate([[0], np.cumsum(total)])
    upper = np.concatenate([[0], top]).astype(np.int64)
    far = np.iinfo(np.int64).max // 4
    best = np.full(n + 1, far)
    best[0] = 0
    choice = []
    for _ in range(min(buckets, n)):
        step, back = np.full(n + 1, far), np.zeros(n + 1, np.int64)
        step[0] = 0
        for j in range(1, n + 1):
            cost = best[:j] + upper[j] * (c[j] - c[:j]) - (s[j] - s[:j])
            back[j] = int(cost.argmin())
            step[j] = cost[back[j]]
        choice.append(back)
        best = step
    bounds, j = [], n
    for back in reversed(choice):
        if j == 0:
            break
        bounds.append(int(upper[j]))
        j = int(back[j])
    return bounds[::-1], int(best[n])


def pack(docs: DataFrame, *, key: str = "doc_id", text: str = "text", buckets: int = 12, budget: int = 16_384, fine: int = 1024, splits: int = 64) -> DataFrame:
    """``key``, ``length``, ``bucket`` (0, 1, ... by length), ``padded`` (upper bound), ``batch`` (gapless in each bucket), ``slot`` (place in the batch).

    Null and blank texts have length 0 and lie in the first bucket; a batch of a bucket with bound 0 holds ``budget``
    rows.  Ties and repeated rows are numbered in any order; an empty table has no rows.
    """
    # without texts; used three times
    rows = cut(docs.select(F.col(f"`{key}`"), length_of(F.col(f"`{text}`")).alias("length"), F.crc32(F.coalesce(F.col(f"`{text}`"), F.lit(""))).alias("_crc")))
    bins = rows.groupBy(bin_top(F.col("length"), fine).alias("bin")).agg(F.max("length").alias("top"), F.count("*").alias("n"), F.sum("length").alias("s")).orderBy("top").toPandas()
    bounds, _ = optimal_bounds(bins.top.to_numpy(np.int64), bins.n.to_numpy(np.int64), bins.s.to_numpy(np.int64), buckets)
    bounds = bounds or [0]
    bucket, padded, per = F.lit(len(bounds) - 1), F.lit(bounds[-1]), F.lit(max(1, budget // max(bounds[-1], 1)))
    for k in range(len(bounds) - 2, -1, -1):
        inside = F.col("length") <= bounds[k]
        bucket, padded = F.when(inside, k).otherwise(bucket), F.when(inside, bounds[k]).otherwise(padded)
        per = F.when(inside, max(1, budget // max(bounds[k], 1))).otherwise(per)
    placed = gapless(rows.withColumns({"bucket": bucket, "padded": padded.cast("long"), "_per": per}), "bucket", [key, "_crc"], [F.xxhash64(F.col(f"`{key}`")), F.col(f"`{key}`"), "length", "_crc"], splits=splits, name="_rank")
    return placed.select(F.col(f"`{key}`"), "length", "bucket", "padded", F.floor(F.col("_rank") / F.col("_per")).cast("long").alias("batch"), (F.col("_rank") % F.col("_per")).cast("long").alias("slot"))
