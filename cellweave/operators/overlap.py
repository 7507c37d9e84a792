"""Overlap of ports: how many cells two ports share, counted on bits that tasks make from places."""

from __future__ import annotations

import math
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import geo
from ..session import cut
from . import spatial

PIECE = 4096  # cells whose distances are taken at once
GRID = 0.1  # degrees between the places that stand for a slab's ports where its cells are looked for
CLOSE = 1e-12  # cosines this near to a bound are decided by the distance itself


class Block(NamedTuple):
    """Ports in order of their names: names and where each starts, whether others have it too, places in radians, each port's place, and for each distance the places' bits of the cells."""

    names: list[str]
    starts: list[int]
    again: np.ndarray
    places: np.ndarray
    of: np.ndarray
    bits: list[np.ndarray]


def _km(one: np.ndarray, two: np.ndarray) -> np.ndarray:
    """Great-circle distances of places in radians, broadcast."""
    half = np.sin((two[0] - one[0]) / 2) ** 2 + np.cos(one[0]) * np.cos(two[0]) * np.sin((two[1] - one[1]) / 2) ** 2
    return 2 * geo.EARTH_KM * np.arcsin(np.sqrt(np.clip(half, 0, 1)))


def _bits(places: np.ndarray, cells: np.ndarray, within: tuple[float, ...]) -> list[np.ndarray]:
    """For each distance, words (rows) of 64 cells by places (columns): the cells that are no farther from the place."""
    vectors = lambda x: np.stack([np.cos(x[0]) * np.cos(x[1]), np.cos(x[0]) * np.sin(x[1]), np.sin(x[0])])
    own, out = vectors(places).T, [[] for _ in within]
    for at in range(0, cells.shape[1], PIECE):
        piece = cells[:, at : at + PIECE]
        cosine = own @ vectors(piece)
        for row, d in zip(out, within, strict=True):
            bound = math.cos(min(d / geo.EARTH_KM, math.pi))
            near, maybe = cosine >= bound + CLOSE, cosine >= bound - CLOSE
            if np.count_nonzero(near) < np.count_nonzero(maybe):
                i, j = np.nonzero(near != maybe)
                near[i, j] = _km(places[:, i], piece[:, j]) <= d
            packed = np.packbits(near, axis=1)
            row.append(np.pad(packed, ((0, 0), (0, -packed.shape[1] % 8))).view(np.uint64).T)
    return [np.ascontiguousarray(np.concatenate(row)) for row in out]


def _block(ports: pa.StructArray, cells: np.ndarray, within: tuple[float, ...]) -> Block:
    names = ports.field("port").to_pylist()
    starts = [k for k, name in enumerate(names) if not k or names[k - 1] != name]
    places, of = np.unique(np.radians(np.stack([ports.field(c).to_numpy() for c in ("lat", "lon")])), axis=1, return_inverse=True)
    again = ports.field("again").to_numpy(zero_copy_only=False)[starts]
    return Block([names[k] for k in starts], starts, again, places, of.ravel(), _bits(places, cells, within))


def _shared(x: Block, y: Block, same: bool, again: bool) -> list[pa.Array] | None:
    """Names, distance and counts of the ports of two blocks (``same``: of a block with itself) that share a cell, of pairs with a name that is there ``again`` or of the others; None if there are none."""
    all_names = sorted({*x.names, *y.names})
    rank = {name: k for k, name in enumerate(all_names)}
    one, two = (np.array([rank[n] for n in b.names]) for b in (x, y))
    asked = (x.again[:, None] | y.again[None, :]) == again
    asked &= (one[:, None] < two[None, :]) if same else (one[:, None] != two[None, :])
    if not asked.any():
        return None
    counts = []
    for mine, other in reversed(list(zip(x.bits, y.bits, strict=True))):  # the widest first
        count = np.zeros((mine.shape[1], other.shape[1]), np.int64)
        for k in np.flatnonzero(mine.any(axis=1) & other.any(axis=1)):
            count += np.bitwise_count(mine[k][:, None] & other[k][None, :])
        if not counts and not count.any():
            return None
        counts.insert(0, count)
    apart = np.where(counts[-1] > 0, _km(x.places[:, :, None], y.places[:, None, :]), -1.0)
    told = [m[np.ix_(x.of, y.of)] for m in (*counts, apart)]
    for axis, b in enumerate((x, y)):
        if len(b.starts) < len(b.of):  # ports of one name count as one
            told = [*(np.add.reduceat(m, b.starts, axis=axis) for m in told[:-1]), np.maximum.reduceat(told[-1], b.starts, axis=axis)]
    i, j = np.nonzero(asked & (told[-2] > 0))
    text = pa.array(all_names, pa.string())
    return [text.take(pa.array(f(one[i], two[j]))) for f in (np.minimum, np.maximum)] + [pa.array(m[i, j]) for m in (told[-1], *told[:-1])]


def _slabs(cells: DataFrame, placed: DataFrame, km: float) -> DataFrame:
    """``slab`` and ``cell``, ``lat``, ``lon`` of all cells within ``km`` of one of its ports, and of some a little farther, each once."""
    at = lambda c: (F.floor(F.col(c) / GRID) + 0.5) * GRID
    marks = placed.select("slab", at("port_lat").alias("near_lat"), at("port_lon").alias("near_lon")).distinct()
    found = spatial.within(cells.select("cell", "lat", "lon").dropna(), marks, km + 112 * GRID, ref_lat="near_lat", ref_lon="near_lon")
    return found.select("slab", "cell", "lat", "lon").distinct()


def port_pairs(cells: DataFrame, ports: DataFrame, within: tuple[float, ...] = (25, 50, 100), *, tile: float = 0.8, block: int = 512, slab: int = 4096) -> DataFrame:
    """For each pair of ports (by their names) that share a cell within the last of the ascending distances: how far they are apart and the cells within each distance of both.

    Ports that lie together make slabs of at most ``slab``, in blocks of at most ``block``.  A task gets a slab with the cells
    around it once, then the blocks of all slabs that have cells in common with it, and makes the cells near each port
    as bits from the places.  So only names and places are shuffled, as often as there are slabs around, which does not
    grow until a tile of ports fills several; pairs are result rows.  Ports of one name count as one, as far apart
    as the farthest two that share a cell; only pairs with such a name are summed over tasks.
    """
    at = lambda c: F.floor(F.col(c) / tile).cast("long")
    number = F.row_number().over(W.partitionBy("_ty", "_tx").orderBy("port_lat", "port_lon", "port")) - 1
    named = ports.select("port", "port_lat", "port_lon").dropna().withColumn("again", F.count("*").over(W.partitionBy("port")) > 1)
    named = named.withColumns({"_ty": at("port_lat"), "_tx": at("port_lon")}).withColumn("_i", number)
    named = cut(named.select("port", "port_lat", "port_lon", "again", F.struct("_ty", "_tx", F.floor(F.col("_i") / slab).alias("k")).alias("key"), F.floor(F.col("_i") % slab / block).alias("block")))
    slabs = named.select("key").distinct().select("key", F.monotonically_increasing_id().alias("slab"))
    placed = cut(named.join(slabs, "key").drop("key"))

    around = cut(_slabs(cells, placed, max(within)))
    tiles = cut(around.select("slab", at("lat").alias("ty"), at("lon").alias("tx")).distinct())
    pairs = tiles.withColumnRenamed("slab", "s").join(tiles.withColumnRenamed("slab", "t"), ["ty", "tx"]).where("s <= t").select("s", "t").distinct()
    even = (F.col("s") + F.col("t")) % 2 == 0  # so that each slab has about half of those around it
    meet = cut(pairs.select(F.when(even, F.col("s")).otherwise(F.col("t")).alias("x"), F.when(even, F.col("t")).otherwise(F.col("s")).alias("y")))
    blocks = placed.groupBy("slab", "block").agg(F.sort_array(F.collect_list(F.struct("port", F.col("port_lat").alias("lat"), F.col("port_lon").alias("lon"), "again"))).alias("ports"))
    places = around.groupBy("slab").agg(F.collect_list(F.struct("lat", "lon")).alias("cells"))
    none = F.lit(None).cast(places.schema["cells"].dataType).alias("cells")
    first = places.select(F.col("slab").alias("x"), F.lit(-2).cast("long").alias("y"), F.lit(0).cast("long").alias("block"), F.lit(None).cast(blocks.schema["ports"].dataType).alias("ports"), "cells")
    own = blocks.join(places.select("slab"), "slab").select(F.col("slab").alias("x"), F.lit(-1).cast("long").alias("y"), "block", "ports", none)
    others = meet.join(blocks.withColumnRenamed("slab", "y"), "y").select("x", "y", "block", "ports", none)
    tasks = max(1, min(tiles.select("slab").distinct().count(), -(-placed.count() // 256)))
    rows = first.unionByName(own).unionByName(others).repartition(tasks, "x").sortWithinPartitions("x", "y", "block")

    counted = [f"cells_{d:g}" for d in within]
    columns = ["port_a", "port_b", "far", *counted]
    schema = "port_a string, port_b string, far double, " + ", ".join(f"{c} long" for c in counted)

    def count(again: bool):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            mine, near = [], None  # the slab's own blocks and its cells
            for batch in batches:
                for k in range(batch.num_rows):
                    x, y = (batch.column(c)[k].as_py() for c in "xy")
                    if y == -2:
                        mine, found = [], batch.column("cells")[k].values
                        near = np.radians(np.stack([found.field(c).to_numpy() for c in ("lat", "lon")]))
                        continue
                    made = _block(batch.column("ports")[k].values, near, within)
                    if y == -1:
                        mine.append(made)
                        continue
                    number = batch.column("block")[k].as_py()
                    for own_number, held in enumerate(mine[: number + 1] if x == y else mine):
                        found = _shared(held, made, x == y and own_number == number, again)
                        if found is not None:
                            found = pa.RecordBatch.from_arrays(found, columns)
                            for start in range(0, found.num_rows, 1 << 16):
                                yield found.slice(start, 1 << 16)

        return run

    alone, several = placed.agg(F.bool_or(~F.col("again")), F.bool_or("again")).first()
    result = rows.mapInArrow(count(False), schema) if alone or not several else None
    if several:
        summed = rows.mapInArrow(count(True), schema).groupBy("port_a", "port_b").agg(F.max("far").alias("far"), *[F.sum(c).alias(c) for c in counted])
        result = summed if result is None else result.unionByName(summed)
    overlap = F.when(F.col(counted[0]) > 0, "strong").otherwise("weak")
    return result.select("port_a", "port_b", F.round("far", 6).alias("port_distance_km"), *counted, overlap.alias("overlap"))
