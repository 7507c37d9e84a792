"""Joins of panels, points, boxes and reference tables."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import geo
from ..session import cut
from . import order, spatial
from .overlap import port_pairs as port_pairs

SMALL = 2_000  # rows of a reference table that may be sent to every task and compared with every point


def is_small(df: DataFrame, rows: int = SMALL) -> bool:
    """Whether a table has at most so many rows, looking at no more than that."""
    return df.limit(rows + 1).count() <= rows


def balanced(cells: DataFrame, dated: DataFrame, week: str = "week") -> DataFrame:
    """Every row of ``cells`` for every week from the first to the last of ``dated``, 7 days apart."""
    span = dated.agg(F.min(week).alias("_lo"), F.max(week).alias("_hi"))  # one row
    weeks = span.where("_lo is not null").select(F.explode(F.sequence("_lo", "_hi", F.expr("interval 7 days"))).alias(week))
    return cells.crossJoin(F.broadcast(weeks))


def latest(df: DataFrame, key: list[str], order: list[Column]) -> DataFrame:
    """One row for each key, the first in ``order``."""
    place = F.row_number().over(W.partitionBy(*key).orderBy(*order))
    return df.withColumn("_place", place).where("_place = 1").drop("_place")


def merge_sources(frames: list[DataFrame], key: list[str], order: str | None = None) -> DataFrame:
    """Full outer merge in order; of rows with the same key in a source the last by ``order`` counts, null keys never."""
    ready = []
    for df in frames:
        df = df.dropna(subset=key)
        ready.append(latest(df, key, [F.desc(order)]).drop(order) if order and order in df.columns else df.dropDuplicates(key))
    return reduce(lambda a, b: a.join(b, key, "full_outer"), ready)


def enrich(panel: DataFrame, layers: list[tuple[DataFrame, list[str]]]) -> DataFrame:
    """Left joins of weekly and static layers, each on its own keys."""
    return reduce(lambda p, layer: p.join(layer[0], layer[1], "left"), layers, panel)


def points_in_boxes(points: DataFrame, boxes: DataFrame, *, lat: str = "lat", lon: str = "lon", tile: float = 0.5) -> DataFrame:
    """Pairs of a point and a box ``[minx, maxx] x [miny, maxy]`` that holds it, edges included.

    Boxes are laid over tiles, so the join is on equal tiles with the bounds as a further condition; boxes with a null
    bound hold nothing.
    """
    at = lambda c: F.floor(c / tile).cast("long")
    tiled = boxes.dropna(subset=["minx", "miny", "maxx", "maxy"]).where("minx <= maxx and miny <= maxy")
    tiled = tiled.withColumn("_tx", F.explode(F.sequence(at(F.col("minx")), at(F.col("maxx"))))).withColumn("_ty", F.explode(F.sequence(at(F.col("miny")), at(F.col("maxy")))))
    placed = points.withColumns({"_tx": at(F.col(lon)), "_ty": at(F.col(lat))})
    inside = F.col(lon).between(F.col("minx"), F.col("maxx")) & F.col(lat).between(F.col("miny"), F.col("maxy"))
    return placed.join(tiled, ["_tx", "_ty"]).where(inside).drop("_tx", "_ty")


def footprints(pixels: DataFrame, cells: DataFrame, *, buffer: float, res: float = 0.1) -> DataFrame:
    """Pixels with every cell whose square of half-width ``buffer`` degrees around its centre holds them.

    Squares overlap if the buffer is over half a cell; candidates are the cells at most so many rows and columns away.
    """
    reach = int(buffer / res + 0.5) + 1
    near = F.sequence(F.lit(-reach), F.lit(reach))
    at = lambda c, base: F.floor((c + base) / res).cast("long")
    wide = pixels.withColumns({"_r": at(F.col("plat"), 90), "_c": at(F.col("plon"), 180)})
    wide = wide.withColumn("_dr", F.explode(near)).withColumn("_dc", F.explode(near)).withColumns({"_r": F.col("_r") + F.col("_dr"), "_c": F.col("_c") + F.col("_dc")})
    placed = cells.withColumns({"_r": at(F.col("lat"), 90), "_c": at(F.col("lon"), 180)})
    inside = (F.abs(F.col("plat") - F.col("lat")) <= buffer) & (F.abs(F.col("plon") - F.col("lon")) <= buffer)
    return wide.join(placed, ["_r", "_c"]).where(inside).drop("_r", "_c", "_dr", "_dc")


def _least(pairs: DataFrame, point: list[str], refs: list[str], ref_id: str) -> DataFrame:
    best = F.min(F.struct("distance_km", ref_id, *[c for c in refs if c != ref_id]))
    return pairs.groupBy(*point).agg(best.alias("_b")).select(*point, "_b.*")


def _by_tree(points: DataFrame, refs: DataFrame, point: list[str], by: list[str], lat: str, lon: str, ref_id: str, ref_lat: str, ref_lon: str, *, other_than: str | None = None, digits: int | None = None) -> DataFrame:
    """Nearest reference by a tree of tiles (see :func:`.spatial.candidates`); of references in one place the lowest id counts, the two lowest with ``other_than``.

    ``other_than`` names a column of the points that the reference's id must differ from; distances are rounded to ``digits`` before they are compared.
    """
    place = W.partitionBy(*by, ref_lat, ref_lon).orderBy(ref_id)
    lone = refs.dropDuplicates([*by, ref_lat, ref_lon, ref_id]).withColumn("_nth", F.row_number().over(place)).where(F.col("_nth") <= (2 if other_than else 1)).drop("_nth")
    pairs = spatial.candidates(points, lone, point, by, spatial.on_sphere(F.col(lat), F.col(lon)), spatial.on_sphere(F.col(ref_lat), F.col(ref_lon)), ref_id=ref_id, other_than=other_than)
    pairs = pairs.join(points.select(*point, lat, lon), point)
    if other_than:
        pairs = pairs.where(F.col(ref_id) != F.col(other_than))
    distance = geo.haversine_km(F.col(lat), F.col(lon), F.col(ref_lat), F.col(ref_lon))
    return _least(pairs.withColumn("distance_km", distance if digits is None else F.round(distance, digits)), point, [c for c in refs.columns if c not in by], ref_id)


def nearest(points: DataFrame, refs: DataFrame, *, point: str = "cell", lat: str = "lat", lon: str = "lon", ref_id: str, ref_lat: str, ref_lon: str, small: int = SMALL) -> DataFrame:
    """The nearest reference of each point and its ``distance_km``; equal distances go to the lower ``ref_id``.

    A small reference table is sent to every task; a larger one is searched by a tree of tiles.  Points without coordinates and
    empty references give no row.
    """
    at = points.select(point, lat, lon).dropna().distinct()
    refs = refs.dropna(subset=[ref_lat, ref_lon])
    if not is_small(refs, small):
        return _by_tree(at, refs, [point], [], lat, lon, ref_id, ref_lat, ref_lon)
    distance = geo.haversine_km(F.col(lat), F.col(lon), F.col(ref_lat), F.col(ref_lon))
    return _least(at.crossJoin(F.broadcast(refs)).withColumn("distance_km", distance), [point], refs.columns, ref_id)


def nearest_port(cells: DataFrame, ports: DataFrame) -> DataFrame:
    """Nearest named port of each cell; equal distances go to the first port of the list.  Ports without place are left out."""
    if ports.dropna(subset=["port_lat", "port_lon"]).isEmpty():
        raise ValueError("no port has coordinates")
    return nearest(cells, ports, ref_id="port_seq", ref_lat="port_lat", ref_lon="port_lon")


def nearest_planar(points: DataFrame, refs: DataFrame, *, point: str, ref_lat: str, ref_lon: str, small: int = SMALL) -> DataFrame:
    """All nearest references on the web map, ties as several rows, with ``distance_m``.

    A small reference table is sent to every task; a larger one is searched by the tree of tiles on the plane.
    """
    (x1, y1), (x2, y2) = geo.mercator(F.col("lat"), F.col("lon")), geo.mercator(F.col(ref_lat), F.col(ref_lon))
    away = F.hypot(x1 - x2, y1 - y2)
    if is_small(refs, small):
        pairs = points.crossJoin(F.broadcast(refs)).withColumn("distance_m", away)
    else:
        at, flat = points.dropna(subset=["lat", "lon"]), F.lit(0.0)
        there = refs.dropna(subset=[ref_lat, ref_lon]).withColumn("_ref", F.monotonically_increasing_id())
        pairs = spatial.candidates(at, cut(there), [point], [], [x1, y1, flat], [x2, y2, flat], ref_id="_ref").drop("_ref").join(at, point).withColumn("distance_m", away)
    return pairs.withColumn("_rank", F.rank().over(W.partitionBy(point).orderBy("distance_m"))).where("_rank = 1").drop("_rank")


def nearest_other(points: DataFrame, refs: DataFrame, *, point: str = "cell", small: int = SMALL) -> DataFrame:
    """Nearest reference with another id than the point; if there is none, the point's own.  Distances equal to 9 digits are a tie."""
    other = refs.select(F.col(point).alias("ref"), F.col("lat").alias("ref_lat"), F.col("lon").alias("ref_lon")).dropna()
    if not is_small(other, small):
        at = points.select(point, "lat", "lon").dropna().distinct()
        found = _by_tree(at, other, [point], [], "lat", "lon", "ref", "ref_lat", "ref_lon", other_than=point, digits=9).select(point, "ref", "distance_km")
        alone = at.join(found, point, "left_anti").join(other, F.col(point) == F.col("ref")).select(point, "ref", F.lit(0.0).alias("distance_km"))
        return found.unionByName(alone)
    pairs = points.select(point, "lat", "lon").crossJoin(F.broadcast(other)).withColumn("distance_km", geo.haversine_km(F.col("lat"), F.col("lon"), F.col("ref_lat"), F.col("ref_lon")))
    best = F.min(F.struct((F.col("ref") == F.col(point)).alias("own"), F.round("distance_km", 9).alias("distance_km"), "ref"))  # equal up to rounding is a tie
    return pairs.groupBy(point).agg(best.alias("_b")).select(point, F.col("_b.ref").alias("ref"), F.col("_b.distance_km").alias("distance_km"))


def weekly_seeds(panel: DataFrame, value: str, q: float = 0.9, *, week: str = "week") -> DataFrame:
    """Rows at or above the week's own quantile of ``value``."""
    cut = order.quantiles(panel, [week], {"_cut": (value, q)})
    return panel.join(cut, week).where(F.col(value) >= F.col("_cut")).drop("_cut")


def nearest_in_week(panel: DataFrame, seeds: DataFrame, *, week: str = "week", cell: str = "cell", carry: tuple[str, ...] = (), small: int = SMALL) -> DataFrame:
    """Distance of every row to the nearest seed of its week, with the seed's place; null where a week has no seeds.

    Few seeds are compared with each row of their week; many are searched by a tree of tiles for each week, except for
    the rows that stand where a seed is.
    """
    s = seeds.select(week, F.col(cell).alias("seed_cell"), F.col("lat").alias("seed_lat"), F.col("lon").alias("seed_lon"), *carry).dropna(subset=["seed_lat", "seed_lon"])
    rows = panel.select(week, cell, "lat", "lon")
    placed = rows.dropna().distinct().join(s.select(week).distinct(), week, "left_semi")
    if is_small(s, small):
        pairs = placed.join(F.broadcast(s), week).withColumn("distance_km", geo.haversine_km(F.col("lat"), F.col("lon"), F.col("seed_lat"), F.col("seed_lon")))
        best = _least(pairs, [week, cell], ["seed_cell", "seed_lat", "seed_lon", *carry], "seed_cell")
    else:
        first = F.min(F.struct("seed_cell", *carry))
        here = s.groupBy(week, "seed_lat", "seed_lon").agg(first.alias("_s")).select(week, F.col("seed_lat").alias("lat"), F.col("seed_lon").alias("lon"), "_s")
        placed = cut(placed.join(here, [week, "lat", "lon"], "left"))
        own = placed.where("_s is not null").select(week, cell, F.lit(0.0).alias("distance_km"), "_s.seed_cell", F.col("lat").alias("seed_lat"), F.col("lon").alias("seed_lon"), *[f"_s.{c}" for c in carry])
        best = own.unionByName(_by_tree(placed.where("_s is null").drop("_s"), s, [week, cell], [week], "lat", "lon", "seed_cell", "seed_lat", "seed_lon"))
    return rows.select(week, cell).join(best, [week, cell], "left")


def hotspots(panel: DataFrame, signals: list[str], q: float = 0.9, least: int = 5, *, week: str = "week") -> DataFrame:
    """Rows where any signal reaches its weekly quantile, with the signals' names joined by ``+``.

    A signal counts only in weeks with at least ``least`` values.
    """
    cuts = order.quantiles(panel, [week], {f"_{s}": (s, q) for s in signals})
    enough = panel.groupBy(week).agg(*[(F.count(s) >= least).alias(f"_enough_{s}") for s in signals])
    cuts = cuts.join(enough, week).select(week, *[F.when(F.col(f"_enough_{s}"), F.col(f"_{s}")).alias(f"_{s}") for s in signals])
    tag = F.concat_ws("+", *[F.when(F.col(s) >= F.col(f"_{s}"), F.lit(s)) for s in signals])
    return panel.join(cuts, week).withColumn("tag", tag).where("tag <> ''").drop(*[f"_{s}" for s in signals])


def focal_distances(cells: DataFrame, ports: DataFrame, hubs: DataFrame, km: float) -> DataFrame:
    """A row for each cell and port at most ``km`` apart, and for each cell and hub with such a port, its nearest one: ``cell``, ``kind``, ``focal``, ``km``.

    ``hubs`` has the ports of each hub as rows (``hub``, ``port``), so there may be any number of ports and hubs.
    """
    near = cut(spatial.within(cells.select("cell", "lat", "lon"), ports, km, ref_lat="port_lat", ref_lon="port_lon").select("cell", "port", F.col("distance_km").alias("km")))
    by_hub = near.join(hubs, "port").groupBy("cell", F.col("hub").alias("focal")).agg(F.min("km").alias("km"))
    one = near.select("cell", F.lit("port").alias("kind"), F.col("port").alias("focal"), "km")
    return one.unionByName(by_hub.select("cell", F.lit("hub").alias("kind"), "focal", "km"))


def lagged_lookup(panel: DataFrame, yearly: DataFrame, value: str, lags: int = 2, *, week: str = "week") -> DataFrame:
    """The value for the cell in the year of the week, and of the weeks 7, 14, ... days before."""
    out = panel
    for k in range(lags + 1):
        name = f"{value}_t" if k == 0 else f"{value}_t_minus_{k}"
        part = yearly.select("cell", F.col("year").alias("_y"), F.col(value).alias(name))
        out = out.withColumn("_y", F.year(F.date_sub(F.col(week).cast("date"), 7 * k))).join(part, ["cell", "_y"], "left").drop("_y")
    return out


def cluster_wind(panel: DataFrame, clusters: DataFrame, wind: DataFrame) -> DataFrame:
    """Wind of a cell's cluster in each week."""
    return panel.join(clusters, "cell", "left").join(wind, ["cluster", "week"], "left")


def overlay(panel: DataFrame, other: DataFrame, key: list[str], columns: list[str], *, fill_only: bool = False) -> DataFrame:
    """Columns of ``other`` in place of the panel's own; with ``fill_only`` just where the panel has null."""
    renamed = other.select(*key, *[F.col(c).alias(f"_new_{c}") for c in columns])
    joined = panel.join(renamed, key, "left")
    pick = lambda c: F.coalesce(F.col(c), F.col(f"_new_{c}")) if fill_only and c in panel.columns else F.col(f"_new_{c}")
    return joined.withColumns({c: pick(c) for c in columns}).drop(*[f"_new_{c}" for c in columns])


def key_coverage(left: DataFrame, right: DataFrame, key: list[str]) -> DataFrame:
    """Distinct keys of the left side, how many the right side has, and the share in percent."""
    l, r = left.select(*key).distinct(), right.select(*key).distinct().withColumn("_hit", F.lit(1))
    return l.join(r, key, "left").agg(F.count("*").alias("keys"), F.count("_hit").alias("covered"), F.round(100 * F.count("_hit") / F.count("*"), 6).alias("percent"))


def jaccard(flags: DataFrame, a: str, b: str) -> DataFrame:
    """Sizes and overlap of two sets given as boolean columns."""
    n = lambda c: F.coalesce(F.sum(c.cast("long")), F.lit(0).cast("long"))
    both, either = n(F.col(a) & F.col(b)), n(F.col(a) | F.col(b))
    return flags.agg(n(F.col(a)).alias("n_a"), n(F.col(b)).alias("n_b"), both.alias("n_both"), either.alias("n_either"), F.round(both / F.nullif(n(F.col(a)), F.lit(0)), 6).alias("share_of_a"), F.round(both / F.nullif(either, F.lit(0)), 6).alias("jaccard"))


def as_of_nearest(rows: DataFrame, weeks: DataFrame, ts: str = "ts") -> DataFrame:
    """The week nearest in time to each row, the earlier on ties; weeks are a bounded calendar."""
    calendar = F.broadcast(weeks.select("week").distinct().agg(F.array_sort(F.collect_list("week")).alias("_weeks")))
    gap = lambda w: F.struct(F.abs(F.unix_seconds(F.col(ts).cast("timestamp")) - F.unix_seconds(w.cast("timestamp"))).alias("gap"), w.alias("week"))
    return rows.crossJoin(calendar).withColumn("nearest_week", F.array_min(F.transform("_weeks", gap))["week"]).drop("_weeks")
