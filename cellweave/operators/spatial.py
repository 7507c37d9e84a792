"""Joins by distance whose work follows the points and the result: within a radius, and nearest by a tree of tiles.

Places are vectors of three numbers (on the unit sphere, or on a plane with a third of 0), so neither the seam at 180
degrees nor the poles are special.
"""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import geo
from ..session import cut

BITS = 20  # per axis at the deepest level
STEP = 2  # bits per axis and level: a tile has up to 4 x 4 x 4 tiles below it, about 16 on a surface
CAP = 16  # references in a tile that is not divided
AXES = ("x", "y", "z")


def on_sphere(lat: Column, lon: Column) -> list[Column]:
    a, b = F.radians(lat), F.radians(lon)
    return [F.cos(a) * F.cos(b), F.cos(a) * F.sin(b), F.sin(a)]


def within(points: DataFrame, refs: DataFrame, km: float, *, lat: str = "lat", lon: str = "lon", ref_lat: str, ref_lon: str) -> DataFrame:
    """All pairs of a point and a reference at most ``km`` apart, with ``distance_km``; null coordinates are near nothing.

    Rows of tiles are as high as the radius, and every row has as many tiles round the globe as its circle farthest
    from the equator holds.  A reference goes to all tiles that its circle may touch (about a dozen, more only near the
    poles, where rows have few tiles), a point to its own, so the join is on equal tiles with the distance as residual.
    """
    angle = min(km / geo.EARTH_KM, math.pi)
    high = min(math.degrees(angle) * (1 + 1e-9) + 1e-9, 180.0)
    row = lambda c: F.floor((c + 90) / high).cast("long")
    last = int(180 // high)
    outer = lambda y: F.greatest(F.abs(y * high - 90), F.abs((y + 1) * high - 90))
    tiles = lambda y: F.greatest(F.floor(360 / high * F.cos(F.radians(F.least(outer(y), F.lit(90.0))))), F.lit(1)).cast("long")
    column = lambda c, n: F.floor((F.pmod(c + 180, F.lit(360.0))) * n / 360).cast("long")
    placed = points.dropna(subset=[lat, lon]).withColumn("_ty", row(F.col(lat)))
    placed = placed.withColumn("_tx", F.pmod(column(F.col(lon), tiles(F.col("_ty"))), tiles(F.col("_ty"))))
    wide = refs.dropna(subset=[ref_lat, ref_lon]).withColumn("_ty", F.explode(F.sequence(F.greatest(row(F.col(ref_lat)) - 1, F.lit(0)), F.least(row(F.col(ref_lat)) + 1, F.lit(last)))))
    beyond = F.abs(ref_lat) + high >= 90
    side = F.when(beyond, 180.0).otherwise(F.degrees(F.asin(F.least(F.lit(1.0), math.sin(min(angle, math.pi / 2)) / F.cos(F.radians(ref_lat))))) + 1e-9)
    n, x = tiles(F.col("_ty")), F.pmod(F.col(ref_lon) + 180, F.lit(360.0))
    first, end = F.floor((x - side) * n / 360).cast("long"), F.floor((x + side) * n / 360).cast("long")
    wide = wide.withColumn("_tx", F.explode(F.transform(F.sequence(first, F.least(end, first + n - 1)), lambda t: F.pmod(t, n))))
    distance = geo.haversine_km(F.col(lat), F.col(lon), F.col(ref_lat), F.col(ref_lon))
    return placed.join(wide, ["_ty", "_tx"]).withColumn("distance_km", distance).where(F.col("distance_km") <= km).drop("_ty", "_tx")


def _codes(cell: list[str], level: int) -> Column:
    shifted = [F.shiftright(c, BITS - STEP * level) for c in cell]
    return F.shiftleft(shifted[0], 42).bitwiseOR(F.shiftleft(shifted[1], 21)).bitwiseOR(shifted[2])


def candidates(points: DataFrame, refs: DataFrame, point: list[str], by: list[str], at: list[Column], ref_at: list[Column], *, ref_id: str, other_than: str | None = None, cap: int = CAP) -> DataFrame:
    """Pairs of a point (``point`` names its key, ``by`` among it) and a reference of its ``by``: all nearest ones are there, ties too, and few others.

    References are counted in tiles; a tile with more than ``cap`` is divided, level by level, so tiles are small where
    references are dense.  The search goes down the levels for all points at once: a point keeps the tiles whose box
    is no farther than the least of its tiles' farthest corners, since every tile has a reference in it.  Tiles near a
    point are few at every level, so the work is linear in the points, wherever points and references crowd.  With
    ``other_than`` (a column of the points) a tile counts only if it has a reference with another id.
    """
    spread = refs.agg(*[f(a).alias(f"{name}_{x}") for x, a in zip(AXES, ref_at, strict=True) for name, f in (("min", F.min), ("max", F.max))]).first()
    if spread.min_x is None:
        return points.select(*point).join(refs.limit(0), by) if by else points.select(*point).limit(0).crossJoin(refs.limit(0))
    size = max(max(spread[f"max_{x}"] - spread[f"min_{x}"] for x in AXES), 1e-12)
    most = (1 << BITS) - 1
    cells = [F.least(F.floor((F.col(f"_{x}") - spread[f"min_{x}"]) * (most / size)).cast("long"), F.lit(most)).alias(f"_c{x}") for x in AXES]
    named = [f"_c{x}" for x in AXES]
    placed = cut(refs.withColumns({f"_{x}": a for x, a in zip(AXES, ref_at, strict=True)}).select("*", *cells))
    box = [f(f"_{x}").alias(f"_{n}{x}") for x in AXES for n, f in (("lo", F.min), ("hi", F.max))]

    levels, inner, held = [], None, []
    for level in range(1, BITS // STEP + 1):
        code = _codes(named, level)
        mine = placed.withColumns({"_node": code, "_above": _codes(named, level - 1)})
        if inner is not None:
            mine = mine.join(inner, [*by, "_above"], "left_semi")
        made = mine.groupBy(*by, "_node", "_above").agg(F.count("*").alias("_n"), F.min(ref_id).alias("_id1"), F.max(ref_id).alias("_id2"), *box)
        made = cut(made.withColumn("_leaf", (F.col("_n") <= cap) | F.lit(level == BITS // STEP)))
        levels.append(made)
        held.append(mine.join(made.where("_leaf").select(*by, "_node"), [*by, "_node"], "left_semi").withColumn("_level", F.lit(level)))
        inner = made.where("not _leaf").select(*by, F.col("_node").alias("_above"))
        if inner.isEmpty():
            break
    leaves = cut(reduce(DataFrame.unionByName, held).drop("_above", *named, *[f"_{x}" for x in AXES]))

    off = lambda x: F.greatest(F.col(f"_lo{x}") - F.col(f"_p{x}"), F.col(f"_p{x}") - F.col(f"_hi{x}"), F.lit(0.0))
    far = lambda x: F.greatest(F.abs(F.col(f"_p{x}") - F.col(f"_lo{x}")), F.abs(F.col(f"_hi{x}") - F.col(f"_p{x}")))
    near2, far2 = (sum((f(x) * f(x) for x in AXES[1:]), f("x") * f("x")) for f in (off, far))
    some = F.lit(True) if other_than is None else (F.col("_id1") != F.col("_id2")) | (F.col("_id1") != F.col(other_than))
    kept = [*point, *([other_than] if other_than and other_than not in point else []), *[f"_p{x}" for x in AXES]]
    slack = 1e-12 * max(1.0, *(abs(spread[f"{f}_{x}"]) for x in AXES for f in ("min", "max")))

    def pruned(pairs: DataFrame) -> DataFrame:
        best = F.sqrt(F.min(F.when(some, F.col("_far"))).over(W.partitionBy(*point)))
        close = F.sqrt("_near") <= F.col("_best") * (1 + 1e-9) + slack
        return cut(pairs.where(some).withColumn("_best", best).where(close).drop("_best"))

    open_ = points.select(*[c for c in kept if not c.startswith("_p")], *[a.alias(f"_p{x}") for x, a in zip(AXES, at, strict=True)]).withColumn("_node", F.lit(0).cast("long"))
    done = None
    for level, made in enumerate(levels, 1):
        below = made.withColumnRenamed("_node", "_kid").withColumnRenamed("_above", "_node")
        found = open_.join(below, [*by, "_node"]).withColumns({"_near": near2, "_far": far2, "_level": F.lit(level)})
        found = found.select(*kept, F.col("_kid").alias("_node"), "_level", "_leaf", "_near", "_far", "_id1", "_id2")
        reached = pruned(found if done is None else found.unionByName(done))
        done, open_ = reached.where("_leaf"), reached.where("not _leaf").select(*kept, "_node")
    return done.select(*kept, "_node", "_level").drop(*[f"_p{x}" for x in AXES]).join(leaves, [*by, "_node", "_level"]).drop("_node", "_level")
