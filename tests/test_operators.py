"""Operators on small fixtures with hand-made answers, edges, nulls and ties."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from cellweave.functions import geo, keys
from cellweave.operators import aggregates, indices, joins, modelling, order, spatial, stats, windows
from cellweave.plans import evidence
from cellweave.sources import landed


def one(spark, *columns):
    return tuple(spark.range(1).select(*columns).first())


def test_distances_and_directions(spark):
    p = [F.lit(x) for x in (59.5, 20.0, 60.0, 22.0)]
    km, back, north, east, null = one(spark, geo.haversine_km(*p), geo.haversine_km(*p[2:], *p[:2]), geo.bearing_deg(F.lit(0.0), F.lit(0.0), F.lit(1.0), F.lit(0.0)), geo.bearing_deg(F.lit(0.0), F.lit(0.0), F.lit(0.0), F.lit(1.0)), geo.haversine_km(*p[:3], F.lit(None).cast("double")))
    assert km == pytest.approx(back) and km == pytest.approx(125.0, abs=1.5) and (north, east) == (pytest.approx(0), pytest.approx(90)) and null is None
    lat, lon = geo.destination(F.lit(10.0), F.lit(20.0), F.lit(33.0), F.lit(250.0))
    d, b = one(spark, geo.haversine_km(F.lit(10.0), F.lit(20.0), lat, lon), geo.bearing_deg(F.lit(10.0), F.lit(20.0), lat, lon))
    assert (d, b) == (pytest.approx(250), pytest.approx(33))
    assert one(spark, geo.smallest_angle(F.lit(350.0), F.lit(10.0)), geo.alignment_category(F.lit(0.0), F.lit(135.0)), geo.is_shoreward(F.lit(0.0), F.lit(None).cast("double"))) == (20.0, "crosswind", None)


def test_keys(spark):
    cell = keys.cell_id(F.lit(59.55), F.lit(-0.05))
    lat, lon = keys.cell_centroid(cell)
    got = one(spark, cell, lat, lon, keys.cell_id(F.lit(None).cast("double"), F.lit(1.0)), keys.cell_centroid(F.lit("unmapped"))[0])
    assert got == ("g0.100_r1495_c1799", pytest.approx(59.55), pytest.approx(-0.05), "unmapped", None)
    monday = keys.week_start(F.lit("2023-01-01 12:00:00").cast("timestamp"))
    assert one(spark, F.date_format(monday, "yyyy-MM-dd"), keys.period_key(F.lit("2023-01-01").cast("timestamp"))) == ("2022-12-26", "2022-W52")
    assert one(spark, keys.to_number(F.lit(" 1.5 ")), keys.to_number(F.lit("x")), keys.to_number(F.lit("NaN")), keys.to_number(F.lit("-Infinity"))) == (1.5, None, None, None)


def test_bands_close_where_the_scheme_says(spark):
    values = [None, -1.0, 0.0, 3.0, 5.0, 10.0, 30.0, 30.1, 50.0, 1e9]
    df = spark.createDataFrame([(v,) for v in values], "x double")
    got = [tuple(r) for r in df.select(keys.distance_band(F.col("x"), "coast"), keys.distance_band(F.col("x"), "fine"), keys.distance_band(F.col("x"), "near_far", "unknown"), keys.exposure_score(F.col("x")), keys.exposure_band(F.col("x"))).collect()]
    assert [g[0] for g in got] == [None, None, "0-3", "3-7", "3-7", "7-15", "15-30", None, None, None]
    assert [g[1] for g in got] == [None, "0-5", "0-5", "0-5", "0-5", "5-10", "20-50", "20-50", "20-50", ">50"]
    assert [g[2] for g in got] == ["unknown", "unknown", "0-3", "3-10", "3-10", "10-50", "10-50", "10-50", ">50", ">50"]
    assert got[0][3:] == (0.0, "unknown") and got[5][3:] == (1.0, "high") and got[8][3:] == (0.5, "medium") and got[9][3] == pytest.approx(0)


@pytest.mark.parametrize("scheme,cases", [("plain", [(0.7, "strong"), (-0.9, "strong"), (0.4, "moderate"), (0.1, "negligible"), (None, "insufficient")]), ("signed", [(0.6, "strong positive"), (-0.9, "strong negative"), (0.0, "weak positive"), (None, None)])])
def test_strength_words(spark, scheme, cases):
    df = spark.createDataFrame([(r,) for r, _ in cases], "r double")
    assert [x[0] for x in df.select(keys.strength(F.col("r"), scheme)).collect()] == [w for _, w in cases]


def test_nearest_by_tiles_equals_brute_force(spark):
    rnd = random.Random(3)
    points = [(f"p{i}", rnd.uniform(-80, 80), rnd.uniform(-179, 179)) for i in range(60)] + [("null", None, 1.0)]
    refs = [(i, rnd.uniform(-60, 60), rnd.uniform(-100, 100)) for i in range(40)] + [(99, None, 2.0)]
    p, r = spark.createDataFrame(points, "cell string, lat double, lon double"), spark.createDataFrame(refs, "ref long, rlat double, rlon double")
    how = {"ref_id": "ref", "ref_lat": "rlat", "ref_lon": "rlon"}
    rows = lambda small: {x.cell: (x.ref, round(x.distance_km, 6)) for x in joins.nearest(p, r, **how, small=small).collect()}
    assert rows(0) == rows(1000) and len(rows(0)) == 60
    assert joins.nearest(p, r.where("false"), **how).count() == 0


def globe(rnd, n):
    spot = lambda: (rnd.choice([rnd.uniform(-90, 90), 90.0, -90.0, rnd.uniform(88, 90), rnd.uniform(-90, -89)]), rnd.choice([rnd.uniform(-180, 180), 180.0, -180.0, rnd.uniform(179, 180), rnd.uniform(-180, -179.9)]))
    return [spot() for _ in range(n)]


@pytest.mark.parametrize("cap", [64, 2])
def test_tiles_hold_at_the_seam_and_the_poles(spark, cap, monkeypatch):
    monkeypatch.setattr(spatial.candidates, "__kwdefaults__", spatial.candidates.__kwdefaults__ | {"cap": cap})
    rnd = random.Random(4)
    points = [(f"p{i}", *x) for i, x in enumerate(globe(rnd, 60))] + [("seam", 0.0, 179.99)]
    refs = [(i, *x) for i, x in enumerate(globe(rnd, 30))] + [(98, 0.0, -179.99), (99, 0.0, 179.7)]
    p, r = spark.createDataFrame(points, "cell string, lat double, lon double"), spark.createDataFrame(refs, "ref long, rlat double, rlon double")
    how = {"ref_id": "ref", "ref_lat": "rlat", "ref_lon": "rlon"}
    km = lambda small: {x.cell: round(x.distance_km, 6) for x in joins.nearest(p, r, **how, small=small).collect()}
    assert km(0) == km(1000) and len(km(0)) == 61 and km(0)["seam"] < 2.3
    others = lambda small: {x.cell: round(x.distance_km, 6) for x in joins.nearest_other(p, p, small=small).collect()}
    assert others(0) == others(1000) and len(others(0)) == 61
    lone = p.where("cell = 'seam'")
    assert [tuple(x) for x in joins.nearest_other(lone, lone, small=0).collect()] == [("seam", "seam", 0.0)]


def test_planar_tiles_equal_all_pairs(spark):
    rnd = random.Random(6)
    p = spark.createDataFrame([(f"p{i}", rnd.uniform(-80, 80), rnd.uniform(-180, 180)) for i in range(40)], "cell string, lat double, lon double")
    refs = [(i, float(rnd.randint(-60, 60)), float(rnd.randint(-100, 100))) for i in range(30)]
    r = spark.createDataFrame(refs + [(100 + i, a, b) for i, a, b in refs[:5]], "ref long, rlat double, rlon double")
    rows = lambda small: sorted((x.cell, x.ref, round(x.distance_m, 2)) for x in joins.nearest_planar(p, r, point="cell", ref_lat="rlat", ref_lon="rlon", small=small).collect())
    assert rows(0) == rows(1000)


def haversine(a, b):
    (p, q), (r, s) = np.radians(a).T, np.radians(b).T
    h = np.sin((r[None] - p[:, None]) / 2) ** 2 + np.cos(p)[:, None] * np.cos(r)[None] * np.sin((s[None] - q[:, None]) / 2) ** 2
    return 2 * geo.EARTH_KM * np.arcsin(np.sqrt(np.clip(h, 0, 1)))


def test_crowded_tile_is_searched_by_its_tree(spark):
    """Points and references in a square of a hundredth of a degree, most references in one corner and copies among them, far points beside them."""
    draw = np.random.default_rng(5)
    refs = np.concatenate([60 + draw.random((6000, 2)) * 1e-3, 60 + draw.random((500, 2)) * 1e-2, np.repeat([[60.0051, 60.0049]], 800, axis=0)])
    points = np.concatenate([60 + draw.random((1500, 2)) * 1e-2, 60 + draw.random((500, 2)) * 1e-3, [[61.0, 60.0], [-60.0, -120.0]]])
    p = spark.createDataFrame([(i, *map(float, x)) for i, x in enumerate(points)], "cell int, lat double, lon double").repartition(4)
    r = spark.createDataFrame([(i, *map(float, x)) for i, x in enumerate(refs)], "ref int, rlat double, rlon double").repartition(4)
    at, there = spatial.on_sphere(F.col("lat"), F.col("lon")), spatial.on_sphere(F.col("rlat"), F.col("rlon"))
    lone = r.groupBy("rlat", "rlon").agg(F.min("ref").alias("ref"))
    pairs = spatial.candidates(p, lone, ["cell"], [], at, there, ref_id="ref").count()
    assert pairs < 400 * len(points)  # a few tiles of at most 64 for each point, not all 6,501
    got = {x.cell: (x.ref, x.distance_km) for x in joins.nearest(p, r, ref_id="ref", ref_lat="rlat", ref_lon="rlon").collect()}
    km = haversine(points, refs)
    for i, row in enumerate(km):
        ref, d = got[i]
        assert d == pytest.approx(row.min(), abs=1e-9) and row[ref] == pytest.approx(row.min(), abs=1e-9)
    on_copies = [i for i, row in enumerate(km) if row.argmin() >= 6500]
    assert on_copies and all(got[i][0] == 6500 for i in on_copies)


@pytest.mark.parametrize("km", [0.5, 40.0, 900.0, 9000.0, 30000.0])
def test_radius_join_equals_all_pairs(spark, km):
    rnd = random.Random(8)
    points, refs = globe(rnd, 80) + [(0.0, 179.999), (60.0, 18.0), (60.0, 18.0)], globe(rnd, 60) + [(0.0, -179.999), (60.001, 18.001), (90.0, 5.0)]
    p = spark.createDataFrame([(i, *x) for i, x in enumerate(points)] + [(-1, None, 3.0)], "cell int, lat double, lon double")
    r = spark.createDataFrame([(i, *x) for i, x in enumerate(refs)] + [(-1, 3.0, None)], "ref int, rlat double, rlon double")
    got = [(x.cell, x.ref) for x in spatial.within(p, r, km, ref_lat="rlat", ref_lon="rlon").collect()]
    d = haversine(np.array(points), np.array(refs))
    assert len(got) == len(set(got)) and set(got) == {(int(i), int(j)) for i, j in zip(*np.nonzero(d <= km), strict=True)}
    assert spatial.within(p.where("false"), r, km, ref_lat="rlat", ref_lon="rlon").count() == 0


def test_pairs_and_hubs_of_any_number_of_ports(spark):
    rnd = random.Random(9)
    ports = [(f"port{i:03}", 55 + rnd.random() * 4, 18 + rnd.random() * 4) for i in range(600)]
    cells = [(f"c{i}", 55 + rnd.random() * 4, 18 + rnd.random() * 4) for i in range(60)]
    c = spark.createDataFrame(cells, "cell string, lat double, lon double")
    p = spark.createDataFrame(ports, "port string, port_lat double, port_lon double")
    d = haversine(np.array([x[1:] for x in cells]), np.array([x[1:] for x in ports]))
    want = {}
    for row in d:
        near = np.flatnonzero(row <= 40)
        for i, a in enumerate(near):
            for b in near[i + 1 :]:
                n = want.setdefault((ports[a][0], ports[b][0]), [0, 0])
                n[0] += max(row[a], row[b]) <= 15
                n[1] += 1
    got = {(r.port_a, r.port_b): [r.cells_15, r.cells_40] for r in joins.port_pairs(c, p, (15, 40)).collect()}
    assert got == want and len(want) > 500
    hubs = spark.createDataFrame([(f"hub{i % 7}", x[0]) for i, x in enumerate(ports)], "hub string, port string")
    told = {(r.cell, r.kind, r.focal): r.km for r in joins.focal_distances(c, p, hubs, 60).collect()}
    whole = {(cells[i][0], "port", ports[j][0]): d[i, j] for i, j in zip(*np.nonzero(d <= 60), strict=True)}
    for i, (cell, *_) in enumerate(cells):
        for h in range(7):
            if (least := d[i, h::7].min()) <= 60:
                whole[cell, "hub", f"hub{h}"] = least
    assert told.keys() == whole.keys() and all(told[k] == pytest.approx(whole[k], abs=1e-9) for k in whole)


def skewed(spark):
    rnd = random.Random(7)
    rows = [("a", float(rnd.randint(0, 9)), rnd.random()) for _ in range(300)] + [("b", rnd.random(), None) for _ in range(200)] + [("c", 0.0, 1.0)] * 500 + [("d", None, 2.0), ("e", 3.5, None), ("e", -1.0, -0.0)]
    return rows, spark.createDataFrame(rows, "g string, v double, w double").repartition(5)


def test_ranks_of_the_index_equal_window_ranks(spark):
    rows, df = skewed(spark)
    some = [r for r in rows if r[1] is not None]
    for by in (["g"], []):
        both = order.ranked(df.withColumn("want", windows.average_rank(F.col("v"), by)), by, "v", "got", ties="n")
        assert both.count() == len(some) and both.where("abs(got - want) > 1e-9").count() == 0
        shared = order.ranked(df.withColumn("want", windows.percent_rank_average(F.col("v"), by)), by, "v", "got", percent=True)
        assert shared.where("abs(got - want) > 1e-9").count() == 0
    assert order.ranked(df.where("false"), ["g"], "v", "got").count() == 0


@pytest.mark.parametrize("partitions", ["1", "7"])
def test_quantiles_by_selection_equal_numpy(spark, partitions):
    rows, df = skewed(spark)
    shares = (0.0, 0.1, 1 / 3, 0.5, 0.9, 1.0)
    kept = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", partitions)
    try:
        wanted = {f"{c}{k}": (c, q) for c in "vw" for k, q in enumerate(shares)} | {"sum": (F.col("v") + F.col("w"), 0.5)}
        got = {r.g: r for r in order.quantiles(df, ["g"], wanted).collect()}
        whole = order.quantiles(df, [], wanted).collect()
        assert order.quantiles(df.where("false"), [], {"q": ("v", 0.5)}).collect()[0].q is None
        assert order.quantiles(df.where("false"), ["g"], {"q": ("v", 0.5)}).count() == 0
        beside = {r.g: r.m for r in order.medians(df.groupBy("g").count(), df, ["g"], "v", "m").collect()}
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", kept)
    values = {"v": lambda r: r[1], "w": lambda r: r[2], "s": lambda r: r[1] + r[2] if r[1] is not None and r[2] is not None else None}
    for group, row in [*((g, got[g]) for g in "abcde"), (None, whole[0])]:
        for name, (_, q) in wanted.items():
            have = [x for r in rows if group in (None, r[0]) and (x := values[name[0]](r)) is not None]
            assert row[name] == pytest.approx(float(np.quantile(have, q)), abs=1e-12) if have else row[name] is None
    assert beside["d"] is None and beside["c"] == 0.0
    assert set(got) == set("abcde")


def test_two_samples_of_any_layout_are_the_same(spark, monkeypatch):
    _, df = skewed(spark)
    df = df.withColumn("side", F.col("w") > 0.5)
    told = lambda: sorted(map(tuple, stats.two_sample(df, ["g"], F.col("side"), "v").drop("welch_p", "mw_p").collect()), key=repr)
    few = told()
    monkeypatch.setattr(order, "FEW", 0)  # ranks are joined by value instead of sent
    assert told() == few


def test_weekly_seeds_by_tiles_equal_all_pairs(spark):
    rnd = random.Random(11)
    rows = [(w, f"c{i}", rnd.uniform(54, 60), rnd.uniform(18, 25)) for w in range(3) for i in range(30)] + [(9, "lone", 55.0, 20.0), (1, "no place", None, 20.0)]
    p = spark.createDataFrame(rows, "week int, cell string, lat double, lon double")
    s = p.where("week < 3 and cell in ('c1', 'c5', 'c20')")
    got = [{(r.week, r.cell): (r.seed_cell, r.distance_km and round(r.distance_km, 6)) for r in joins.nearest_in_week(p, s, small=n).collect()} for n in (0, 1000)]
    assert got[0] == got[1] and len(got[0]) == len(rows)
    assert got[0][9, "lone"] == got[0][1, "no place"] == (None, None) and got[0][2, "c5"] == ("c5", 0.0)


def test_ports_must_have_places(spark):
    p = spark.createDataFrame([("a", 1.0, 1.0)], "cell string, lat double, lon double")
    none = spark.createDataFrame([(1, "x", None, 1.0)], "port_seq long, port string, port_lat double, port_lon double")
    with pytest.raises(ValueError):
        joins.nearest_port(p, none)
    two = spark.createDataFrame([(2, "b", 1.0, 2.0), (1, "a", 1.0, 0.0)], none.schema)
    assert joins.nearest_port(p, two).first().port == "a"  # equally near: the first of the list


def test_boxes_hold_edges_and_nulls_hold_nothing(spark):
    p = spark.createDataFrame([("a", 0.0, 0.0), ("b", 1.0, 1.0), ("c", 5.0, 5.0), ("d", None, 0.0)], "cell string, lat double, lon double")
    b = spark.createDataFrame([("x", 0.0, 0.0, 1.0, 1.0), ("y", -9.0, -9.0, 9.0, 9.0), ("z", None, 0.0, 9.0, 9.0), ("w", 3.0, 0.0, 1.0, 9.0)], "record_id string, minx double, miny double, maxx double, maxy double")
    got = {(r.cell, r.record_id) for r in joins.points_in_boxes(p, b, tile=0.7).collect()}
    assert got == {("a", "x"), ("b", "x"), ("a", "y"), ("b", "y"), ("c", "y")}


def test_merge_keeps_the_last_and_drops_null_keys(spark):
    a = spark.createDataFrame([("x", 1, 10, 1), ("x", 1, 11, 2), (None, 1, 5, 3)], "cell string, week int, v int, ord int")
    b = spark.createDataFrame([("y", 1, 7)], "cell string, week int, w int")
    got = {(r.cell, r.week): (r.v, r.w) for r in joins.merge_sources([a, b], ["cell", "week"], "ord").collect()}
    assert got == {("x", 1): (11, None), ("y", 1): (None, 7)}


def test_average_ranks_with_ties_and_nulls(spark):
    values = [3.0, 1.0, 3.0, None, 2.0, 3.0]
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, v double")
    by = {r.i: r.p for r in df.select("i", windows.percent_rank_average(F.col("v"), []).alias("p")).collect()}
    assert by == {0: 0.8, 1: 0.2, 2: 0.8, 3: None, 4: 0.4, 5: 0.8}
    many = spark.range(500).withColumn("v", (F.col("id") * 7 % 83).cast("double"))
    both = windows.global_rank(many, "v", "g", parts=7).withColumn("w", windows.percent_rank_average(F.col("v"), [])).collect()
    assert all(r.g == pytest.approx(r.w) for r in both) and sum(r.g for r in both) / 500 == pytest.approx(501 / 1000)
    assert windows.global_rank(many.where("false"), "v", "g").count() == 0


def test_correlation_without_spread_is_null(spark):
    df = spark.createDataFrame([("a", i, 1.0, float(i), None) for i in range(5)], "cell string, week int, x double, y double, z double")
    got = {(r.a, r.b): (r.n, r.pearson, r.spearman) for r in stats.correlations(df, [("x", "y"), ("y", "y"), ("x", "z")]).collect()}
    assert got == {("x", "y"): (5, None, None), ("y", "y"): (5, 1.0, 1.0)}


def test_tails_of_distributions():
    assert stats.t_two_sided(2.0, 10) == pytest.approx(0.0733880, abs=1e-6)
    assert stats.t_two_sided(0.0, 5) == pytest.approx(1.0)
    assert stats.f_upper(4.0, 2, 10) == pytest.approx(0.0530, abs=1e-3)
    assert stats.incomplete_beta(2, 3, 0.4) == pytest.approx(0.5248)


def test_two_samples_by_hand(spark):
    rows = [(True, v) for v in (1.0, 2.0, 2.0, 5.0)] + [(False, v) for v in (2.0, 3.0, 7.0)] + [(None, 9.0), (True, None)]
    r = stats.two_sample(spark.createDataFrame(rows, "s boolean, value double"), [], F.col("s")).first()
    u = sum((a > b) + 0.5 * (a == b) for a in (1, 2, 2, 5) for b in (2, 3, 7))
    assert (r.n1, r.n0, r.m1, r.m0, r.u) == (4, 3, 2.5, 4.0, u) and r.cliffs_delta == pytest.approx(2 * u / 12 - 1, abs=1e-6)
    v1, v0 = 3.0, 7.0
    assert r.t == pytest.approx(-1.5 / math.sqrt(v1 / 4 + v0 / 3), abs=1e-6) and 0 < r.welch_p < 1 and 0 < r.mw_p <= 1
    lone = stats.two_sample(spark.createDataFrame([(True, 1.0)], "s boolean, value double"), [], F.col("s")).first()
    assert (lone.n1, lone.n0, lone.t, lone.u) == (1, 0, None, None)


def test_runs_and_direction(spark):
    df = spark.createDataFrame([("a", i, f) for i, f in enumerate([1, 1, 0, 1, None, 1, 1, 1])], "cell string, week int, f int")
    r = windows.runs(df, F.col("f") == 1).first()
    assert (r.n_runs, r.longest, r.mean_length) == (3, 3, 2.0)
    d = spark.createDataFrame([("up", 1, 1.0), ("up", 2, 2.0), ("flat", 1, 1.0), ("flat", 2, 1.0), ("one", 1, 4.0)], "g string, k int, v double")
    assert {x.g: x.direction for x in windows.direction(d, "v", "k", "g").collect()} == {"up": "increasing", "flat": "flat", "one": "undetermined"}


def test_calendar_lags_and_next_valid(spark):
    rows = [("a", "2024-01-01", 1.0), ("a", "2024-01-08", None), ("a", "2024-01-22", 3.0)]
    df = spark.createDataFrame(rows, "cell string, w string, v double").withColumn("week", F.to_timestamp("w"))
    by_row = [r.v_t_minus_1 for r in windows.lags(df, ["v"], 1).orderBy("week").collect()]
    on_time = [r.v_t_minus_1 for r in windows.lags(df, ["v"], 1, calendar=True).orderBy("week").collect()]
    assert (by_row, on_time) == ([None, 1.0, None], [None, 1.0, None])
    assert [r.v_next for r in windows.next_valid(df, "v").orderBy("week").collect()] == [3.0, None]


def test_sliding_windows_cover_every_distance(spark):
    df = spark.createDataFrame([(0.0, 1.0), (9.9, 3.0), (10.0, 5.0), (-1.0, 9.0), (None, 9.0)], "d double, v double")
    got = {r.start_km: (r.n, r.mean) for r in aggregates.sliding_windows(df, "d", "v", 20, 10).collect()}
    assert got == {0.0: (3, 3.0), 10.0: (1, 5.0)}


def test_quantile_bins_and_scales(spark):
    df = spark.createDataFrame([(float(v),) for v in (1, 1, 1, 2, 3, 4)] + [(None,)], "v double")
    assert [r.bin for r in aggregates.quantile_bins(df, "v", 3).orderBy("v").collect()] == [None, 0, 0, 0, 0, 1, 1]  # edges 1, 1, 2.33, 4
    flat = indices.with_moments(spark.createDataFrame([(2.0, 1.0), (2.0, None)], "a double, b double"), ["a", "b"])
    r = flat.select(indices.min_max("a").alias("m"), indices.min_max("a", 0.5).alias("h"), indices.z("a").alias("z"), indices.mean_of([F.col("a"), F.col("b")]).alias("mean")).collect()
    assert [tuple(x) for x in r] == [(None, 0.5, None, 1.5), (None, 0.5, None, 2.0)]


def test_alias_clusters_pass_labels_on(spark):
    pairs = spark.createDataFrame([("a", "b", 0.99), ("b", "c", -0.985), ("c", "d", 0.5)], "a string, b string, pearson double")
    got = {r.column: (r.cluster, r.keep) for r in stats.alias_clusters(pairs, ["a", "b", "c", "d"]).collect()}
    assert got == {"a": ("a", True), "b": ("a", False), "c": ("a", False), "d": ("d", True)}


def test_landed_responses(spark):
    rows = [
        ("1", '{"layers":[{"id":1,"time":"2024-01-05T00:00:00Z"},{"id":2}]}'), ("2", "[]"), ("3", '{"bbox":[1,2,3,null],"lat":5,"lon":"6"}'),
        ("4", "<xml/>"), ("5", None), ("6", '{"features":[{"properties":{"bbox":[0,0,2,2],"date":"2024-02-01"}}]}'), ("7", '{"a":'),
    ]
    df = spark.createDataFrame(rows, "request_signature string, response_payload string").withColumns({"source": F.lit("s"), "dataset": F.lit("d")})
    got = sorted((r.raw_record_ref, r.latitude, r.longitude, str(r.record_ts)[:10], r.grid_id) for r in landed.standardize(df).collect())
    assert got == [("1", None, None, "2024-01-05", "unmapped"), ("1", None, None, "None", "unmapped"), ("3", 5.0, 6.0, "None", "g0.100_r950_c1860"), ("6", 1.0, 1.0, "2024-02-01", "g0.100_r910_c1810")]


def test_missing_folder_has_the_schema(spark, tmp_path):
    df = landed.read_records(spark, str(tmp_path), "nowhere")
    assert df.schema == landed.RECORD and df.count() == 0


def test_sink_adds_each_signature_once(spark, tmp_path):
    df = spark.createDataFrame([("a", "x", "d"), ("b", "x", "d"), ("b", "x", "d")], "request_signature string, source string, dataset string")
    for _ in range(2):
        landed.write_once(df, str(tmp_path / "t"))
    landed.write_once(df.limit(1).withColumn("request_signature", F.lit("c")), str(tmp_path / "t"))
    assert sorted(r[0] for r in spark.read.parquet(str(tmp_path / "t")).select("request_signature").collect()) == ["a", "b", "c"]


def test_csv_headers_and_aliases(spark, tmp_path):
    (tmp_path / "x.csv").write_text(" Grid Cell ID ,Week\ng1,2024-01-01\n")
    df = landed.read_csv(spark, str(tmp_path / "x.csv"))
    assert df.columns == ["grid_cell_id", "week"]
    assert landed.resolve(df, {"cell": ["cell", "GRID_CELL_ID"], "lat": ["lat"]}).first().asDict() == {"cell": "g1", "lat": None}


def test_isolation_marks_the_far_point(spark):
    rnd = random.Random(1)
    df = spark.createDataFrame([(rnd.gauss(0, 1), rnd.gauss(0, 1)) for _ in range(200)] + [(12.0, -12.0), (None, 0.0)], "a double, b double")
    top = modelling.isolation_score(df, ["a", "b"]).orderBy(F.desc("isolation")).first()
    assert (top.a, top.b) == (12.0, -12.0)


def test_empty_panels_run_through(spark):
    e = spark.createDataFrame([], "cell string, week timestamp, lat double, lon double, v double, indicator string, value double")
    for df in (joins.nearest_in_week(e, joins.weekly_seeds(e, "v")), windows.lags(e, ["v"]), aggregates.profile(e), aggregates.tukey(e), stats.correlations(e, [("v", "lat")]), windows.runs(e, F.col("v") > 0), indices.mad_outliers(e, "v", by=["cell"])):
        assert df.count() == 0


def test_bootstrap_interval_is_that_of_a_resampled_mean(spark):
    draw = np.random.default_rng(8)
    x = draw.gamma(2.0, 3.0, size=300)
    df = spark.createDataFrame([(f"c{i}", i, "g", float(v)) for i, v in enumerate(x)], "cell string, week int, g string, value double")
    got = stats.bootstrap_mean(df, ["g"], "value", draws=1001).first()
    means = np.array([draw.choice(x, len(x)).mean() for _ in range(4000)])
    assert got.n == 300 and abs(got.mean - x.mean()) < 1e-6
    assert abs(got.ci95_low - np.quantile(means, 0.025)) < 0.12 and abs(got.ci95_high - np.quantile(means, 0.975)) < 0.12


def test_repaired_layers_drop_aliases_and_empty_columns(spark):
    rows = [(f"c{i % 5}", i // 5, float(i), 2.0 * i, None if i % 10 else 1.0, float(i % 5), None if i == 3 else float(i * i % 7)) for i in range(50)]
    panel = spark.createDataFrame(rows, "cell string, week int, a double, a_twice double, rare double, km double, b double")
    repaired = spark.createDataFrame([("c3", 0, 99.0)], "cell string, week int, b double")
    got = evidence.repair_layers(panel, ["a", "a_twice", "rare", "km", "b"], repaired, ["cell", "week"], static={"km": "km_proxy", "a": "a_proxy"})
    assert got.columns == ["cell", "week", "a", "km", "b", "km_proxy"]
    assert got.where("cell = 'c3' and week = 0").first().b == 99.0 and got.where("b is null").count() == 0


@pytest.mark.parametrize("by", [["g"], []])
def test_bootstrap_draws_equal_weights_of_exploded_rows(spark, by):
    """The same draws made by multiplying rows, hashed and weighed by SQL functions alone."""
    rnd = random.Random(12)
    df = spark.createDataFrame([(f"c{i % 40}", i, rnd.choice("ab"), rnd.choice([None, rnd.random() * 100])) for i in range(400)] + [("x", 1, "none", None)], "cell string, week int, g string, value double").repartition(5)
    cdf = np.cumsum([math.exp(-1) / math.factorial(k) for k in range(7)])
    long = df.where("value is not null").withColumn("b", F.explode(F.sequence(F.lit(42), F.lit(42 + 24)))).withColumn("h", F.xxhash64("cell", "week", "b"))
    long = long.select(*by, "value", "b", F.posexplode(F.array(*[F.shiftrightunsigned("h", 16 * i).bitwiseAND(F.lit(0xFFFF)) for i in range(4)])).alias("i", "part"))
    weight = sum(((F.col("part") >= round(c * 65536)).cast("int") for c in cdf), F.lit(0))
    means = long.groupBy(*by, "b", "i").agg((F.sum(weight * F.col("value")) / F.sum(weight)).alias("m"))
    want = {tuple(r[c] for c in by): (r.low, r.high) for r in means.groupBy(*by).agg(F.percentile("m", F.lit(0.025)).alias("low"), F.percentile("m", F.lit(0.975)).alias("high")).collect()}
    got = {tuple(r[c] for c in by): r for r in stats.bootstrap_mean(df, by, "value", draws=100).collect()}
    for k, (low, high) in want.items():
        assert got[k].ci95_low == pytest.approx(low, abs=2e-6) and got[k].ci95_high == pytest.approx(high, abs=2e-6)
    if by:
        assert got["none",].n == 0 and got["none",].ci95_low is None
    plan = stats.bootstrap_mean(df, by, "value", draws=100)._jdf.queryExecution().optimizedPlan().toString()
    assert "Generate" not in plan


def test_draws_are_emitted_before_they_fill_a_task():
    sums = stats.Draws(8, 42, most=16)
    hashes = np.arange(6, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    sums.add(np.array([0, 1, 2, 0, 1, 2]), ["a", "b", "c"], np.arange(6.0), hashes)
    assert sums.full()
    batch = sums.emit()
    assert batch.num_rows == 3 and not sums.groups
    w = sums.weights(hashes)
    assert batch.column(1)[0].as_py() == (w[0] + w[3]).tolist() and batch.column(2)[2].as_py() == (2 * w[2] + 5 * w[5]).tolist()


def test_standing_among_the_values_inside_a_mask(spark):
    rows = [("a", float(i), i % 2 == 0) for i in range(11)] + [("a", 1000.0, True), ("a", None, True), ("a", 5.0, None)] + [("flat", 2.0, True)] * 3 + [("out", 1.0, False)]
    df = spark.createDataFrame(rows, "g string, v double, m boolean")
    got = {(r.g, r.v, r.inside): (r.rank_pct, r.robust_z) for r in stats.masked_standing(df, F.col("m"), "g", "v").collect()}
    inside = np.array([0.0, 2, 4, 6, 8, 10, 1000])
    q1, q2, q3 = np.quantile(inside, [0.25, 0.5, 0.75])
    for k, v in enumerate(inside):
        assert got["a", v, True] == (pytest.approx((k + 1) / 7), pytest.approx(min(3.5, (v - q2) / ((q3 - q1) / 1.34896))))
    assert got["a", 5.0, False] == got["a", None, True] == got["out", 1.0, False] == (None, None)
    assert got["flat", 2.0, True] == (pytest.approx(2 / 3), None)


def test_winds_that_cancel_out_have_no_direction(spark):
    rows = [("calm", 3.0 + k * 7 % 9, k * 37.0 % 360) for k in range(720)] + [("west", 2.0, 270.0)] * 2
    df = spark.createDataFrame(rows, "g string, s double, deg double").withColumns({"u": -F.col("s") * F.sin(F.radians("deg")), "v": -F.col("s") * F.cos(F.radians("deg"))})
    got = {r.g: (r.to_deg, r.speed) for r in aggregates.resultant(df, ["g"], "u", "v").collect()}
    assert got == {"calm": (None, 0.0), "west": (90.0, 2.0)}


def test_draws_of_a_group_are_summed_in_few_places(spark):
    rows = spark.range(4000).select(F.concat(F.lit("g"), F.col("id") % 50).alias("_g"), F.rand(3).alias("_v"), F.xxhash64("id").alias("_h")).repartition(20)
    sums = stats.draw_sums(rows, 8, 42)
    assert sums.select("_g").distinct().count() == 50 and sums.count() <= 50 + 4
    held = stats.Draws(8, 42, most=16)
    held.add(np.array([0, 1, 2]), ["a", "b", "c"], np.arange(3.0), np.arange(3, dtype=np.uint64))
    assert held.emit(but="c").column(0).to_pylist() == ["a", "b"] and list(held.groups) == ["c"]


def test_port_pairs_in_many_blocks_and_with_repeated_names(spark):
    rnd = random.Random(31)
    cells = [(f"c{k}", 54 + rnd.random() * 3, 18 + rnd.random() * 4) for k in range(300)]
    ports = [(f"p{k % 50}", 54 + rnd.random() * 3, 18 + rnd.random() * 4) for k in range(60)] + [("nowhere", None, 18.0), (None, 55.0, 19.0)]
    c, p = spark.createDataFrame(cells, "cell string, lat double, lon double"), spark.createDataFrame(ports, "port string, port_lat double, port_lon double")

    def km(a, b):
        (p, q), (r, s) = ((math.radians(x) for x in y) for y in (a, b))
        return 2 * geo.EARTH_KM * math.asin(math.sqrt(math.sin((r - p) / 2) ** 2 + math.cos(p) * math.cos(r) * math.sin((s - q) / 2) ** 2))

    want = {}
    for a in ports[:60]:
        for b in ports[:60]:
            far = [max(km(a[1:], x[1:]), km(b[1:], x[1:])) for x in cells] if a[0] < b[0] else []
            if any(f <= 40 for f in far):
                apart, near, wide = want.get((a[0], b[0]), (0, 0, 0))
                want[a[0], b[0]] = (max(apart, km(a[1:], b[1:])), near + sum(f <= 15 for f in far), wide + sum(f <= 40 for f in far))
    pairs = joins.port_pairs(c, p, (15, 40), block=7)
    got = {(r.port_a, r.port_b): (r.port_distance_km, r.cells_15, r.cells_40) for r in pairs.collect()}
    assert got == {k: (pytest.approx(x, abs=2e-6), n, w) for k, (x, n, w) in want.items()} and len(got) > 100
    plan = joins.port_pairs(c, p.where("port_lat < 55 and port = 'p1'"), (15, 40))._jdf.queryExecution().executedPlan().toString()
    assert "Aggregate" not in plan.split("MapInArrow")[0]  # pairs are not shuffled


def shuffled(spark, act) -> int:
    """Bytes that the stages of an action shuffle."""
    store = spark.sparkContext._jsc.sc().statusStore()
    stages = lambda: {(s.stageId(), s.attemptId()): s.shuffleWriteBytes() for s in (lambda q: [q.apply(k) for k in range(q.size())])(store.stageList(None, False, False, spark._sc._gateway.new_array(spark._jvm.double, 0), None))}
    spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty()
    before = stages()
    act()
    spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty()
    return sum(n for k, n in stages().items() if k not in before)


def test_port_pairs_shuffle_as_the_ports_grow(spark):
    """Four times the ports in one place make sixteen times the pairs, but not the blocks' cells sixteen times over."""
    rnd = random.Random(32)
    cells = spark.createDataFrame([(f"c{k}", 54 + rnd.random() * 2, 18 + rnd.random() * 3) for k in range(600)], "cell string, lat double, lon double")
    ports = [(f"p{k:05}", 54 + rnd.random() * 2, 18 + rnd.random() * 3) for k in range(1600)]
    sizes = []
    for n in (400, 1600):
        p = spark.createDataFrame(ports[:n], "port string, port_lat double, port_lon double")
        sizes.append(shuffled(spark, lambda p=p: joins.port_pairs(cells, p, (15, 40), block=16).write.format("noop").mode("overwrite").save()))
    assert sizes[0] > 0 and sizes[1] < 6 * sizes[0]


def test_port_pairs_of_several_slabs_and_of_ports_at_one_place(spark):
    rnd = random.Random(33)
    cells = spark.createDataFrame([(f"c{k}", 54 + rnd.random(), 18 + rnd.random() * 2) for k in range(200)] + [(None, 54.5, 19.0), ("c", None, 19.0)], "cell string, lat double, lon double")
    places = [(54 + rnd.random(), 18 + rnd.random() * 2 + 360 * (k % 2)) for k in range(12)]
    ports = spark.createDataFrame([(f"p{k if k < 60 else k % 7}", *places[k % 12]) for k in range(90)], "port string, port_lat double, port_lon double")
    near = spatial.within(cells.dropna(), ports.withColumn("id", F.monotonically_increasing_id()).localCheckpoint(), 30, ref_lat="port_lat", ref_lon="port_lon").localCheckpoint()
    a, b = (near.select("cell", *[F.col(c).alias(f"{c}_{s}") for c in ("id", "port", "distance_km")]) for s in "ab")
    met = a.join(b, "cell").where("port_a < port_b").groupBy("port_a", "port_b")
    want = {tuple(r) for r in met.agg(F.count(F.when(F.greatest("distance_km_a", "distance_km_b") <= 10, 1)).alias("n"), F.count("*").alias("w")).collect()}
    for how in ({}, {"slab": 14, "block": 7}, {"slab": 5, "block": 5, "tile": 3.0}):
        got = [(r.port_a, r.port_b, r.cells_10, r.cells_30) for r in joins.port_pairs(cells, ports, (10, 30), **how).collect()]
        assert set(got) == want and len(got) == len(want) > 500


def test_rows_where_a_seed_stands_are_not_searched(spark, monkeypatch):
    rnd = random.Random(17)
    rows = [(w, f"c{k}", 54 + rnd.randrange(12) * 0.1, 18 + rnd.randrange(12) * 0.1) for w in range(2) for k in range(150)]
    p = spark.createDataFrame(rows, "week int, cell string, lat double, lon double")
    s = p.where("cast(substr(cell, 2) as int) % 3 = 0").withColumn("tag", F.concat(F.lit("t"), "cell"))
    there = {(r.week, r.lat, r.lon) for r in s.collect()}
    searched, tree = [], joins._by_tree
    monkeypatch.setattr(joins, "_by_tree", lambda points, *a, **k: (searched.extend(points.collect()), tree(points, *a, **k))[1])
    got = [{(r.week, r.cell): (r.seed_cell, r.tag, round(r.distance_km, 6)) for r in joins.nearest_in_week(p, s, carry=("tag",), small=n).collect()} for n in (0, 1000)]
    assert got[0] == got[1] and len(got[0]) == 300
    assert searched and not any((r.week, r.lat, r.lon) in there for r in searched)
