"""Queries of keys, projections and joins."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import session
from ..functions import geo, keys
from ..operators import aggregates as A
from ..operators import joins, order, spatial, windows
from . import views as V
from .registry import query

R = A.r6


@query("""SELECT cell, week, count(*) AS n, count(DISTINCT user_id) AS users FROM obs GROUP BY ALL""")
def prj_week_and_cell_keys(spark: SparkSession, d: str) -> DataFrame:
    """Monday weeks and fixed-grid cells of point records."""
    return V.obs(spark, d).groupBy("cell", "week").agg(F.count("*").alias("n"), F.count_distinct("user_id").alias("users"))


@query("""SELECT printf('%d-W%02d', CAST(isoyear(ts) AS BIGINT), CAST(weekofyear(ts) AS BIGINT)) AS iso_week, strftime(ts, '%Y-%m') AS month, count(*) AS n FROM events GROUP BY ALL""", raw=True)
def prj_period_keys(spark: SparkSession, d: str) -> DataFrame:
    e = V.table(spark, d, "events")
    return e.groupBy(keys.period_key(F.col("ts")).alias("iso_week"), keys.period_key(F.col("ts"), "month").alias("month")).agg(F.count("*").alias("n"))


@query("""SELECT DISTINCT cell, round((CAST(regexp_extract(cell,'_r(-?[0-9]+)',1) AS DOUBLE)+0.5)*0.1-90,6) AS lat, round((CAST(regexp_extract(cell,'_c(-?[0-9]+)',1) AS DOUBLE)+0.5)*0.1-180,6) AS lon FROM obs""")
def prj_centroid_from_id(spark: SparkSession, d: str) -> DataFrame:
    lat, lon = keys.cell_centroid(F.col("cell"))
    return V.obs(spark, d).select("cell").distinct().select("cell", R(lat).alias("lat"), R(lon).alias("lon"))


@query("""SELECT cell, CASE WHEN user_id%7=0 THEN round((CAST(regexp_extract(cell,'_r(-?[0-9]+)',1) AS DOUBLE)+0.5)*0.1-90,6) WHEN user_id%11=0 THEN 59.5 ELSE round(lat,6) END AS lat,
CASE WHEN user_id%7=0 THEN round((CAST(regexp_extract(cell,'_c(-?[0-9]+)',1) AS DOUBLE)+0.5)*0.1-180,6) WHEN user_id%11=0 THEN 20.0 ELSE round(lon,6) END AS lon FROM cells""")
def prj_centroid_fallback(spark: SparkSession, d: str) -> DataFrame:
    """Own centroid, else that of the id, else a default; some are blanked here."""
    c = V.obs(spark, d).select("cell", "user_id", "lat", "lon").distinct()
    gone = (F.col("user_id") % 7 == 0) | (F.col("user_id") % 11 == 0)
    named = F.when((F.col("user_id") % 7 == 0) | ~gone, F.col("cell")).otherwise("unmapped")
    lat, lon = keys.centroid_or_default(F.when(~gone, F.col("lat")), F.when(~gone, F.col("lon")), named)
    return c.select("cell", R(lat).alias("lat"), R(lon).alias("lon"))


@query("""SELECT event_type, count(TRY_CAST(substr(props,7,length(props)-7) AS DOUBLE)) AS numeric_props, CAST(sum(TRY_CAST(json_extract_string(props,'$.k') AS BIGINT)) AS BIGINT) AS total_k, count(*) AS n FROM events GROUP BY event_type""", raw=True)
def prj_numeric_coercion(spark: SparkSession, d: str) -> DataFrame:
    e = V.table(spark, d, "events")
    number = keys.to_number(F.expr("substr(props, 7, length(props) - 7)"))
    k = F.get_json_object("props", "$.k").try_cast("bigint")
    return e.groupBy("event_type").agg(F.count(number).alias("numeric_props"), F.sum(k).alias("total_k"), F.count("*").alias("n"))


@query("""SELECT sum(CASE WHEN coast_km<=30 AND port_km<30 THEN 1 ELSE 0 END)::BIGINT AS coastal_30, sum(CASE WHEN coast_km<=30 AND port_km<=20 THEN 1 ELSE 0 END)::BIGINT AS coastal_20,
sum(CASE WHEN coast_km<=30 AND port_km<=15 THEN 1 ELSE 0 END)::BIGINT AS coastal_15, sum(CASE WHEN coast_km<=30 THEN 1 ELSE 0 END)::BIGINT AS coastal, sum(CASE WHEN month(week) IN (11,12,1,2,3) THEN 1 ELSE 0 END)::BIGINT AS winter FROM feat""")
def prj_panel_masks(spark: SparkSession, d: str) -> DataFrame:
    near = F.col("coast_km") <= 30
    n = lambda c, name: F.sum(F.coalesce(c, F.lit(False)).cast("long")).alias(name)
    return V.features(spark, d).agg(n(near & (F.col("port_km") < 30), "coastal_30"), n(near & (F.col("port_km") <= 20), "coastal_20"), n(near & (F.col("port_km") <= 15), "coastal_15"), n(near, "coastal"), n(keys.season(F.col("week")) == "winter", "winter"))


@query("""SELECT cell, week, round(coast_km,6) AS coast_km FROM feat, (SELECT sum(CASE WHEN coast_km<=2 THEN 1 ELSE 0 END) AS k, quantile_cont(coast_km,1/3.0) AS q, count(*) AS n FROM feat)
WHERE CASE WHEN k>0 THEN coast_km<=2 ELSE n>=15 AND coast_km<=q END""")
def prj_land_adjacent_or_tercile(spark: SparkSession, d: str) -> DataFrame:
    """Rows close to land; if there are none, the closest third."""
    f = V.features(spark, d).select("cell", "week", "coast_km")
    s = order.beside(f.agg(F.sum((F.col("coast_km") <= 2).cast("long")).alias("k"), F.count("*").alias("n")), f, [], {"q": ("coast_km", 1 / 3)})
    keep = F.when(F.col("k") > 0, F.col("coast_km") <= 2).otherwise((F.col("n") >= 15) & (F.col("coast_km") <= F.col("q")))
    return f.crossJoin(F.broadcast(s)).where(keep).select("cell", "week", R(F.col("coast_km")).alias("coast_km"))


@query(f"""SELECT DISTINCT c.cell FROM cells c JOIN ports_v p ON {V.hav("c.lat", "c.lon", "p.port_lat", "p.port_lon")} <= 40""")
def prj_within_any_port(spark: SparkSession, d: str) -> DataFrame:
    cells = V.obs(spark, d).select("cell", "lat", "lon").distinct()
    return spatial.within(cells, V.ports(spark, d), 40, ref_lat="port_lat", ref_lon="port_lon").select("cell").distinct()


@query("""SELECT port, count(*) AS n FROM port_near WHERE port NOT IN ('Supplier#000000002','Supplier#2') AND port_km BETWEEN 0 AND 120 GROUP BY port""")
def prj_port_filters(spark: SparkSession, d: str) -> DataFrame:
    cells = V.obs(spark, d).select("cell", "lat", "lon").distinct()
    near = joins.nearest_port(cells, V.ports(spark, d))
    return near.where(~F.col("port").isin("Supplier#000000002", "Supplier#2") & F.col("distance_km").between(0, 120)).groupBy("port").agg(F.count("*").alias("n"))


@query("""SELECT cell, user_id FROM cells WHERE lat BETWEEN 55 AND 57 AND lon BETWEEN 18 AND 18.2""")
def prj_bounding_window(spark: SparkSession, d: str) -> DataFrame:
    return V.obs(spark, d).where(F.col("lat").between(55, 57) & F.col("lon").between(18, 18.2)).select("cell", "user_id").distinct()


@query("""SELECT cell FROM cells WHERE lat > 54.5 AND lat < 56.5 AND lon > 17.9 AND lon < 18.1 + (lat-54.5)*0.1""")
def prj_point_in_polygon(spark: SparkSession, d: str) -> DataFrame:
    """Cells in a land polygon given as edges; here a quadrangle with one slanted side."""
    ring = [(17.9, 54.5), (18.1, 54.5), (18.3, 56.5), (17.9, 56.5), (17.9, 54.5)]
    edges = spark.createDataFrame([(*a, *b) for a, b in zip(ring, ring[1:], strict=False)], "x1 double, y1 double, x2 double, y2 double").agg(F.collect_list(F.struct("x1", "y1", "x2", "y2")).alias("edges"))
    cells = V.obs(spark, d).select("cell", "lat", "lon").distinct()
    return cells.crossJoin(F.broadcast(edges)).where(geo.in_polygon(F.col("lon"), F.col("lat"), F.col("edges"))).select("cell")


@query("""SELECT record_id, cell FROM cells JOIN boxes_v ON lon BETWEEN minx AND maxx AND lat BETWEEN miny AND maxy""")
def join_points_in_boxes(spark: SparkSession, d: str) -> DataFrame:
    cells = V.obs(spark, d).select("cell", "lat", "lon").distinct()
    return joins.points_in_boxes(cells, V.boxes(spark, d)).select("record_id", "cell")


@query("""SELECT cell, count(*) AS n_records, list_sort(list(DISTINCT record_id))::VARCHAR AS records FROM cells JOIN boxes_v ON lon BETWEEN minx AND maxx AND lat BETWEEN miny AND maxy GROUP BY cell""")
def join_box_references_by_cell(spark: SparkSession, d: str) -> DataFrame:
    """Box records collected onto the cells they cover."""
    cells = V.obs(spark, d).select("cell", "lat", "lon").distinct()
    hit = joins.points_in_boxes(cells, V.boxes(spark, d))
    return hit.groupBy("cell").agg(F.count("*").alias("n_records"), F.concat(F.lit("["), F.array_join(F.array_sort(F.collect_set("record_id")), ", "), F.lit("]")).alias("records"))


@query("""SELECT p.cell AS pixel, c.cell FROM cells p JOIN cells c ON abs(p.lat-c.lat)<=0.12 AND abs(p.lon-c.lon)<=0.12""")
def join_buffered_footprints(spark: SparkSession, d: str) -> DataFrame:
    """Overlapping squares around cell centres, with the centres of all cells as pixels."""
    cells = V.obs(spark, d).select("cell", "lat", "lon").distinct()
    pixels = cells.select(F.col("cell").alias("pixel"), F.col("lat").alias("plat"), F.col("lon").alias("plon"))
    return joins.footprints(pixels, cells, buffer=0.12).select("pixel", "cell")


@query("""SELECT cell, week, user_id, n_obs FROM panel""")
def join_balanced_panel(spark: SparkSession, d: str) -> DataFrame:
    return V.panel(spark, d).select("cell", "week", "user_id", "n_obs")


@query("""SELECT coalesce(a.cell,b.cell) AS cell, coalesce(a.week,b.week) AS week, a.vessel, b.no2 FROM (SELECT cell, week, vessel FROM weekly WHERE vessel IS NOT NULL) a FULL JOIN (SELECT cell, week, no2 FROM weekly WHERE no2 IS NOT NULL) b ON a.cell=b.cell AND a.week=b.week""")
def join_full_outer_sources(spark: SparkSession, d: str) -> DataFrame:
    w = V.weekly(spark, d)
    parts = [w.where(F.col(c).isNotNull()).select("cell", "week", c) for c in ("vessel", "no2")]
    return joins.merge_sources(parts, ["cell", "week"])


@query("""SELECT cell, week, value, event_id FROM (SELECT cell, week, value, event_id, row_number() OVER (PARTITION BY cell, week ORDER BY event_id DESC) AS rn FROM obs) WHERE rn=1""")
def join_last_wins(spark: SparkSession, d: str) -> DataFrame:
    """Of records with the same key, the last by an explicit order."""
    o = V.obs(spark, d).withColumn("ord", F.col("event_id"))
    return joins.merge_sources([o.select("cell", "week", "value", "event_id", "ord")], ["cell", "week"], "ord")


@query("""SELECT p.cell, p.week, p.vessel, p.n_obs, n.port, round(n.port_km,6) AS port_km FROM panel p LEFT JOIN port_near n USING (cell)""")
def join_panel_enrichment(spark: SparkSession, d: str) -> DataFrame:
    p = V.panel(spark, d)
    near = joins.nearest_port(p.select("cell", "lat", "lon").distinct(), V.ports(spark, d)).select("cell", "port", R(F.col("distance_km")).alias("port_km"))
    return joins.enrich(p, [(near, ["cell"])]).select("cell", "week", "vessel", "n_obs", "port", "port_km")


@query("""SELECT cell, port, round(port_km,6) AS distance_km FROM port_near""")
def join_nearest_port(spark: SparkSession, d: str) -> DataFrame:
    return joins.nearest_port(V.obs(spark, d).select("cell", "lat", "lon").distinct(), V.ports(spark, d)).select("cell", "port", R(F.col("distance_km")).alias("distance_km"))


@query("""SELECT cell, coast_id, round(coast_km,6) AS distance_km FROM coast_near""")
def join_nearest_by_tiles(spark: SparkSession, d: str) -> DataFrame:
    """The way for large reference tables, on tiles that widen until every point has its nearest."""
    cells = V.obs(spark, d).select("cell", "lat", "lon").distinct()
    return joins.nearest(cells, V.coast(spark, d), ref_id="coast_id", ref_lat="coast_lat", ref_lon="coast_lon", small=0).select("cell", "coast_id", R(F.col("distance_km")).alias("distance_km"))


@query("""SELECT cell, coast_id, round(m,2) AS distance_m FROM (SELECT *, rank() OVER (PARTITION BY cell ORDER BY m) AS rk FROM (SELECT c.cell, p.coast_id, sqrt(pow(6378137.0*(radians(c.lon)-radians(p.coast_lon)),2)+pow(6378137.0*(ln(tan(pi()/4+radians(c.lat)/2))-ln(tan(pi()/4+radians(p.coast_lat)/2))),2)) AS m FROM cells c CROSS JOIN coast_v p)) WHERE rk=1""")
def join_nearest_planar(spark: SparkSession, d: str) -> DataFrame:
    cells = V.obs(spark, d).select("cell", "lat", "lon").distinct()
    return joins.nearest_planar(cells, V.coast(spark, d), point="cell", ref_lat="coast_lat", ref_lon="coast_lon").select("cell", "coast_id", F.round("distance_m", 2).alias("distance_m"))


@query(f"""SELECT cell, ref, round(km,6) AS distance_km FROM (SELECT a.cell, b.cell AS ref, {V.hav("a.lat", "a.lon", "b.lat", "b.lon")} AS km, row_number() OVER (PARTITION BY a.cell ORDER BY a.cell=b.cell, round({V.hav("a.lat", "a.lon", "b.lat", "b.lon")},9), b.cell) AS rn FROM cells a CROSS JOIN cells b) WHERE rn=1""")
def join_nearest_other(spark: SparkSession, d: str) -> DataFrame:
    cells = V.obs(spark, d).select("cell", "lat", "lon").distinct()
    return joins.nearest_other(cells, cells).select("cell", "ref", R(F.col("distance_km")).alias("distance_km"))


_GLOBE = "spots AS (SELECT user_id AS spot, (user_id*7919%17901)/100.0-89.5 AS lat, (user_id*104729%36000)/100.0-180 AS lon FROM (SELECT DISTINCT user_id FROM events))"


@query(f"""SELECT spot, ref, round(km,6) AS distance_km FROM (SELECT a.spot, b.spot AS ref, {V.hav("a.lat", "a.lon", "b.lat", "b.lon")} AS km, row_number() OVER (PARTITION BY a.spot ORDER BY round({V.hav("a.lat", "a.lon", "b.lat", "b.lon")},9), b.spot) AS rn FROM spots a CROSS JOIN spots b WHERE a.spot<>b.spot) WHERE rn=1""", _GLOBE)
def join_nearest_across_seam(spark: SparkSession, d: str) -> DataFrame:
    """Users laid over the whole globe, the poles and both sides of 180 degrees too; the nearest other one by tiles."""
    k = F.col("user_id")
    spots = V.table(spark, d, "events").select("user_id").distinct().select(k.alias("spot"), (k * 7919 % 17901 / 100 - 89.5).alias("lat"), (k * 104729 % 36000 / 100 - 180).alias("lon"))
    return joins.nearest_other(spots, spots, point="spot", small=0).select("spot", "ref", R(F.col("distance_km")).alias("distance_km"))


SEEDS = "cutw AS (SELECT week, quantile_cont(vessel,0.9) AS q FROM panel GROUP BY week), seeds AS (SELECT p.* FROM panel p JOIN cutw USING (week) WHERE vessel>=q)"


@query(f"""SELECT p.cell, p.week, round(min({V.hav("p.lat", "p.lon", "s.lat", "s.lon")}),6) AS distance_km FROM panel p LEFT JOIN seeds s ON s.week=p.week GROUP BY p.cell, p.week""", SEEDS)
def join_weekly_nearest_seed(spark: SparkSession, d: str) -> DataFrame:
    """Distance to the nearest cell in the top tenth of the week's traffic."""
    p = session.cut(V.panel(spark, d).select("week", "cell", "lat", "lon", "vessel"))
    return joins.nearest_in_week(p, session.cut(joins.weekly_seeds(p, "vessel"))).select("cell", "week", R(F.col("distance_km")).alias("distance_km"))


@query("""SELECT cell, week, concat_ws('+', CASE WHEN n1>=5 AND vessel>=q1 THEN 'vessel' END, CASE WHEN n2>=5 AND no2>=q2 THEN 'no2' END, CASE WHEN n3>=5 AND oil>=q3 THEN 'oil' END) AS tag FROM panel JOIN
(SELECT week, count(vessel) AS n1, quantile_cont(vessel,0.9) AS q1, count(no2) AS n2, quantile_cont(no2,0.9) AS q2, count(oil) AS n3, quantile_cont(oil,0.9) AS q3 FROM panel GROUP BY week) USING (week) WHERE (n1>=5 AND vessel>=q1) OR (n2>=5 AND no2>=q2) OR (n3>=5 AND oil>=q3)""")
def join_multi_signal_hotspots(spark: SparkSession, d: str) -> DataFrame:
    return joins.hotspots(V.panel(spark, d), ["vessel", "no2", "oil"]).select("cell", "week", "tag")


@query(f"""SELECT p.cell, p.week, round(min({V.hav("p.lat", "p.lon", "h.lat", "h.lon")}),6) AS distance_km FROM panel p LEFT JOIN hot h ON h.week=p.week GROUP BY p.cell, p.week""",
       """hot AS (SELECT panel.* FROM panel JOIN (SELECT week, count(vessel) AS n1, quantile_cont(vessel,0.9) AS q1, count(no2) AS n2, quantile_cont(no2,0.9) AS q2, count(oil) AS n3, quantile_cont(oil,0.9) AS q3 FROM panel GROUP BY week) USING (week) WHERE (n1>=5 AND vessel>=q1) OR (n2>=5 AND no2>=q2) OR (n3>=5 AND oil>=q3))""")
def join_nearest_hotspot(spark: SparkSession, d: str) -> DataFrame:
    p = session.cut(V.panel(spark, d).select("week", "cell", "lat", "lon", "vessel", "no2", "oil"))  # read by each of the steps below
    hot = session.cut(joins.hotspots(p, ["vessel", "no2", "oil"]))
    return joins.nearest_in_week(p, hot, carry=("tag",)).select("cell", "week", R(F.col("distance_km")).alias("distance_km"))


_FOCAL = f"""near AS (SELECT c.cell, p.port, p.hub, {V.hav("c.lat", "c.lon", "p.port_lat", "p.port_lon")} AS km FROM cells c JOIN ports_v p ON {V.hav("c.lat", "c.lon", "p.port_lat", "p.port_lon")}<=150)"""


@query("""SELECT cell, 'port' AS kind, port AS focal, round(km,6) AS km FROM near UNION ALL SELECT cell, 'hub', hub, round(min(km),6) FROM near GROUP BY cell, hub""", _FOCAL)
def join_focal_and_hub_distances(spark: SparkSession, d: str) -> DataFrame:
    """Every cell with the ports within 150 km, and with the hubs (all ports of a nation) by their nearest one."""
    ports = V.ports(spark, d)
    cells = V.obs(spark, d).select("cell", "lat", "lon").distinct()
    return joins.focal_distances(cells, ports.drop("hub"), ports.select("hub", "port"), 150).withColumn("km", R(F.col("km")))


YEARLY = "yearly AS (SELECT cell, CAST(year(week) AS INT) AS y, sum(CAST(round(traffic*100) AS HUGEINT))/100.0 AS traffic FROM lp GROUP BY ALL)"


@query("""SELECT l.cell, l.week, a.traffic AS traffic_t, b.traffic AS traffic_t_minus_1, c.traffic AS traffic_t_minus_2 FROM lp l LEFT JOIN yearly a ON a.cell=l.cell AND a.y=year(l.week) LEFT JOIN yearly b ON b.cell=l.cell AND b.y=year(l.week - INTERVAL 7 DAY) LEFT JOIN yearly c ON c.cell=l.cell AND c.y=year(l.week - INTERVAL 14 DAY)""", YEARLY)
def join_year_lookup_with_lags(spark: SparkSession, d: str) -> DataFrame:
    p = V.long_panel(spark, d)
    yearly = p.groupBy("cell", F.year("week").alias("year")).agg((F.sum(V.cents(F.col("traffic"))) / 100.0).alias("traffic"))
    return joins.lagged_lookup(p.select("cell", "week"), yearly, "traffic").select("cell", "week", "traffic_t", "traffic_t_minus_1", "traffic_t_minus_2")


@query("""SELECT f.cell, f.week, f.user_id%4 AS cluster, w.u FROM feat f LEFT JOIN (SELECT user_id%4 AS k, week, round(avg(wind_u),6) AS u FROM feat WHERE user_id%4<3 GROUP BY ALL) w ON w.k=f.user_id%4 AND w.week=f.week""")
def join_cluster_week_wind(spark: SparkSession, d: str) -> DataFrame:
    f = V.features(spark, d)
    clusters = f.select("cell", (F.col("user_id") % 4).alias("cluster")).distinct()
    wind = f.withColumn("cluster", F.col("user_id") % 4).where("cluster < 3").groupBy("cluster", "week").agg(R(F.avg("wind_u")).alias("u"))
    return joins.cluster_wind(f.select("cell", "week"), clusters, wind).select("cell", "week", "cluster", "u")


@query("""SELECT cell, week, CASE WHEN user_id%3=0 THEN ndvi ELSE vessel END AS replaced, coalesce(vessel, CASE WHEN user_id%3=0 THEN ndvi END) AS filled FROM panel""".replace("CASE WHEN user_id%3=0 THEN ndvi ELSE vessel END AS replaced", "CASE WHEN user_id%3=0 THEN ndvi END AS replaced"))
def join_overlay_and_fill(spark: SparkSession, d: str) -> DataFrame:
    """Columns replaced by another table's, and nulls filled from it."""
    p = V.panel(spark, d)
    other = p.where("user_id % 3 = 0").select("cell", "week", F.col("ndvi").alias("vessel"))
    base = p.select("cell", "week", "vessel")
    a = joins.overlay(base, other, ["cell", "week"], ["vessel"]).withColumnRenamed("vessel", "replaced")
    b = joins.overlay(base, other, ["cell", "week"], ["vessel"], fill_only=True).withColumnRenamed("vessel", "filled")
    return a.join(b, ["cell", "week"]).select("cell", "week", "replaced", "filled")


@query("""SELECT x.cell, x.week, no2, oil, vessel FROM (SELECT coalesce(a.cell,b.cell) AS cell, coalesce(a.week,b.week) AS week, no2, oil FROM (SELECT cell, week, no2 FROM weekly WHERE no2 IS NOT NULL) a FULL JOIN (SELECT cell, week, oil FROM weekly WHERE oil IS NOT NULL) b ON a.cell=b.cell AND a.week=b.week) x JOIN (SELECT cell, week, vessel FROM weekly WHERE vessel IS NOT NULL) c ON c.cell=x.cell AND c.week=x.week""")
def join_context_of_layers(spark: SparkSession, d: str) -> DataFrame:
    w = V.weekly(spark, d)
    layer = lambda c: w.where(F.col(c).isNotNull()).select("cell", "week", c)
    return joins.merge_sources([layer("no2"), layer("oil")], ["cell", "week"]).join(layer("vessel"), ["cell", "week"])


@query("""SELECT count(*) AS keys, count(b.cell) AS covered, round(100.0*count(b.cell)/count(*),6) AS percent FROM (SELECT DISTINCT cell FROM weekly WHERE vessel IS NOT NULL) a LEFT JOIN (SELECT DISTINCT cell FROM weekly WHERE ndvi IS NOT NULL) b USING (cell)""")
def join_key_coverage(spark: SparkSession, d: str) -> DataFrame:
    w = V.weekly(spark, d)
    return joins.key_coverage(w.where("vessel is not null"), w.where("ndvi is not null"), ["cell"])


@query("""SELECT cell FROM cells WHERE cell NOT IN (SELECT cell FROM weekly WHERE oil IS NOT NULL)""")
def join_unmatched_cells(spark: SparkSession, d: str) -> DataFrame:
    w = V.weekly(spark, d)
    return w.select("cell").distinct().join(w.where("oil is not null").select("cell"), "cell", "left_anti")


MEANS = "means AS (SELECT cell, avg(vessel) AS v, avg(no2) AS o FROM panel GROUP BY cell), cuts AS (SELECT quantile_cont(v,0.9) AS qv, quantile_cont(o,0.9) AS qo FROM means)"


@query("""SELECT a::BIGINT AS n_a, b::BIGINT AS n_b, ab::BIGINT AS n_both, e::BIGINT AS n_either, round(ab/nullif(a,0),6) AS share_of_a, round(ab/nullif(e,0),6) AS jaccard FROM (SELECT sum((v>=qv)::INT) AS a, sum((o>=qo)::INT) AS b, sum((v>=qv AND o>=qo)::INT) AS ab, sum((v>=qv OR o>=qo)::INT) AS e FROM means, cuts)""", MEANS)
def join_hotspot_jaccard(spark: SparkSession, d: str) -> DataFrame:
    m = V.panel(spark, d).groupBy("cell").agg(F.avg("vessel").alias("v"), F.avg("no2").alias("o"))
    cuts = order.quantiles(m, [], {"qv": ("v", 0.9), "qo": ("o", 0.9)})
    return joins.jaccard(m.crossJoin(F.broadcast(cuts)).select((F.col("v") >= F.col("qv")).alias("a"), (F.col("o") >= F.col("qo")).alias("b")), "a", "b")


@query("""SELECT event_id, arg_min(week, struct_pack(g := abs(epoch(date_trunc('second', ts)) - epoch(week)), w := week)) AS nearest_week FROM events CROSS JOIN weeks GROUP BY event_id""")
def join_as_of_nearest_week(spark: SparkSession, d: str) -> DataFrame:
    o = V.obs(spark, d)
    return joins.as_of_nearest(o.select("event_id", "ts"), o.select("week").distinct()).select("event_id", "nearest_week")


@query(f"""SELECT *, CASE WHEN cells_25>0 THEN 'strong' ELSE 'weak' END AS overlap FROM (SELECT a.port AS port_a, b.port AS port_b, round(max({V.hav("a.port_lat", "a.port_lon", "b.port_lat", "b.port_lon")}),6) AS port_distance_km,
{", ".join(f"count(*) FILTER (greatest(a.km, b.km)<={k}) AS cells_{k}" for k in (25, 50, 100))} FROM near a JOIN near b ON a.cell=b.cell AND a.port<b.port GROUP BY a.port, b.port)""",
       f"""near AS (SELECT c.cell, p.*, {V.hav("c.lat", "c.lon", "p.port_lat", "p.port_lon")} AS km FROM cells c JOIN ports_v p ON {V.hav("c.lat", "c.lon", "p.port_lat", "p.port_lon")}<=100)""")
def join_port_pair_overlap(spark: SparkSession, d: str) -> DataFrame:
    """Pairs of ports with a common cell within 100 km of both, from all suppliers."""
    return joins.port_pairs(V.obs(spark, d).select("cell", "lat", "lon").distinct(), V.ports(spark, d))


@query("""SELECT DISTINCT cell FROM (SELECT cell FROM weekly WHERE oil IS NOT NULL UNION SELECT cell FROM weekly WHERE water IS NOT NULL UNION SELECT cell FROM weekly WHERE ndvi IS NOT NULL)""")
def set_cell_union(spark: SparkSession, d: str) -> DataFrame:
    w = V.weekly(spark, d)
    return V.union_all([w.where(F.col(c).isNotNull()).select("cell") for c in ("oil", "water", "ndvi")]).distinct()


@query(f"""SELECT printf('g0.100_r%d_c%d', r, c) AS cell, round({V.hav("((r+0.5)*0.1-90)", "((c+0.5)*0.1-180)", "55.0", "18.0")},6) AS km FROM (SELECT unnest(range(1435, 1466)) AS r), (SELECT unnest(range(1970, 1991)) AS c) WHERE {V.hav("((r+0.5)*0.1-90)", "((c+0.5)*0.1-180)", "55.0", "18.0")} <= 60 AND printf('g0.100_r%d_c%d', r, c) NOT IN (SELECT cell FROM cells)""")
def set_circle_grid(spark: SparkSession, d: str) -> DataFrame:
    """New cells within 60 km of a point that the panel does not have yet."""
    rows = spark.range(1435, 1466).withColumnRenamed("id", "r").crossJoin(spark.range(1970, 1991).withColumnRenamed("id", "c"))
    lat, lon = (F.col("r") + 0.5) * 0.1 - 90, (F.col("c") + 0.5) * 0.1 - 180
    grid = rows.select(F.format_string("g0.100_r%d_c%d", "r", "c").alias("cell"), geo.haversine_km(lat, lon, F.lit(55.0), F.lit(18.0)).alias("km")).where("km <= 60")
    return grid.join(V.obs(spark, d).select("cell").distinct(), "cell", "left_anti").select("cell", R(F.col("km")).alias("km"))


@query("""SELECT cell, week, vessel, no2 FROM (SELECT cell, week, vessel, no2 FROM weekly WHERE user_id%2=0 UNION ALL SELECT cell, week, vessel, NULL FROM weekly WHERE user_id%2=1)""")
def set_union_by_name(spark: SparkSession, d: str) -> DataFrame:
    """Rows appended by column name; absent columns are null; of equal keys the first source counts."""
    w = V.weekly(spark, d)
    a = w.where("user_id % 2 = 0").select("cell", "week", "vessel", "no2", F.lit(0).alias("src"))
    b = w.select("cell", "week", "vessel", F.lit(1).alias("src")).where("cell is not null").join(w.select("cell", "user_id").distinct(), "cell").where("user_id % 2 = 1 or user_id % 4 = 0").drop("user_id")
    return joins.latest(a.unionByName(b, allowMissingColumns=True), ["cell", "week"], [F.col("src")]).drop("src")


@query("""SELECT cell, week, indicator, value FROM stack""")
def set_unpivot(spark: SparkSession, d: str) -> DataFrame:
    return V.stacked(V.panel(spark, d))


@query("""SELECT week, round(max(CASE WHEN port_seq=1 THEN m END),6) AS p1, round(max(CASE WHEN port_seq=2 THEN m END),6) AS p2, round(max(CASE WHEN port_seq=3 THEN m END),6) AS p3 FROM (SELECT week, port_seq, avg(vessel) AS m FROM feat JOIN ports_v USING (port) GROUP BY ALL) GROUP BY week""")
def set_pivot_week_by_port(spark: SparkSession, d: str) -> DataFrame:
    f = V.features(spark, d).join(V.ports(spark, d).select("port", "port_seq"), "port").where("port_seq <= 3 or port_seq > 3")
    wide = f.groupBy("week").pivot("port_seq", [1, 2, 3]).agg(R(F.avg("vessel")))
    return wide.toDF("week", "p1", "p2", "p3")


@query(f"""SELECT cell, round({V.hav("lat", "lon", "59.5", "20.0")},6) AS km, round((degrees(atan2(sin(radians(20.0-lon))*cos(radians(59.5)), cos(radians(lat))*sin(radians(59.5))-sin(radians(lat))*cos(radians(59.5))*cos(radians(20.0-lon))))+360)%360,6) AS bearing,
round(degrees(asin(sin(radians(lat))*cos(25/6371.0088)+cos(radians(lat))*sin(25/6371.0088)*cos(radians(40.0)))),6) AS lat2 FROM cells""")
def fn_distance_bearing_destination(spark: SparkSession, d: str) -> DataFrame:
    c = V.obs(spark, d).select("cell", "lat", "lon").distinct()
    lat, lon, to = F.col("lat"), F.col("lon"), (F.lit(59.5), F.lit(20.0))
    lat2, _ = geo.destination(lat, lon, F.lit(40.0), F.lit(25.0))
    return c.select("cell", R(geo.haversine_km(lat, lon, *to)).alias("km"), R(geo.bearing_deg(lat, lon, *to)).alias("bearing"), R(lat2).alias("lat2"))


ANGLE = "least(abs(wind_deg-shore_deg), 360-abs(wind_deg-shore_deg))"


@query(f"""SELECT cell, week, round({ANGLE},6) AS angle, round(cos(radians({ANGLE})),6) AS score, CAST({ANGLE}<=45 AS INT) AS within_45, CASE WHEN {ANGLE}<=45 THEN 'aligned' WHEN {ANGLE}<=135 THEN 'crosswind' ELSE 'opposite' END AS category FROM feat""")
def fn_alignment(spark: SparkSession, d: str) -> DataFrame:
    a, b = F.col("wind_deg"), F.col("shore_deg")
    return V.features(spark, d).select("cell", "week", R(geo.smallest_angle(a, b)).alias("angle"), R(geo.alignment_score(a, b)).alias("score"), geo.is_shoreward(a, b).alias("within_45"), geo.alignment_category(a, b).alias("category"))


@query("""SELECT cell, round(CASE WHEN k<=10 THEN 1.0 WHEN k<=50 THEN 0.5 WHEN k IS NOT NULL THEN 0.1*exp(-(k-50)/100) ELSE 0.0 END,6) AS score, CASE WHEN k<=10 THEN 'high' WHEN k<=50 THEN 'medium' WHEN k IS NOT NULL THEN 'low' ELSE 'unknown' END AS band FROM (SELECT cell, CASE WHEN hash(cell) IS NOT NULL AND CAST(regexp_extract(cell,'_r(\\d+)',1) AS INT)%9<>0 THEN port_km END AS k FROM port_near)""")
def fn_exposure_score(spark: SparkSession, d: str) -> DataFrame:
    """Piecewise exposure; a missing distance scores 0 and is unknown."""
    near = joins.nearest_port(V.obs(spark, d).select("cell", "lat", "lon").distinct(), V.ports(spark, d))
    k = F.when(F.regexp_extract("cell", r"_r(\d+)", 1).cast("int") % 9 != 0, F.col("distance_km"))
    return near.select("cell", R(keys.exposure_score(k)).alias("score"), keys.exposure_band(k).alias("band"))


def _band_sql(x: str, scheme: str) -> str:
    edges, labels, closed, last = keys.SCHEMES[scheme]
    lo, hi = (">=", "<") if closed == "left" else (">", "<=")
    inf = float("inf")
    parts = []
    for k, label in enumerate(labels):
        end = "<=" if last and k == len(labels) - 1 else hi
        conditions = [f"{x}{lo}{edges[k]}"] * (edges[k] != -inf) + [f"{x}{end}{edges[k + 1]}"] * (edges[k + 1] != inf)
        parts.append(f"WHEN {' AND '.join(conditions)} THEN '{label}'")
    return f"CASE {' '.join(parts)} END"


@query("SELECT cell, " + ", ".join(f"{_band_sql('port_km', s)} AS {s}" for s in keys.SCHEMES) + " FROM port_near")
def fn_distance_bands(spark: SparkSession, d: str) -> DataFrame:
    near = joins.nearest_port(V.obs(spark, d).select("cell", "lat", "lon").distinct(), V.ports(spark, d))
    return near.select("cell", *[keys.distance_band(F.col("distance_km"), s).alias(s) for s in keys.SCHEMES])


@query("""SELECT cell, week, round(vessel/(1+port_km),6) AS exposure, round(vessel*exp(-port_km/100),6) AS decayed, round(1/(1+port_km),6) AS proximity, round(ln(1+greatest(vessel,0)),6) AS log_vessel, round(vessel/nullif(no2,0),6) AS ratio FROM feat WHERE vessel IS NOT NULL""")
def fn_pressures(spark: SparkSession, d: str) -> DataFrame:
    v, k = F.col("vessel"), F.col("port_km")
    f = V.features(spark, d).where("vessel is not null")
    return f.select("cell", "week", R(keys.port_exposure(v, k)).alias("exposure"), R(keys.decayed_pressure(v, k)).alias("decayed"), R(keys.proximity(k)).alias("proximity"), R(keys.log1p_guarded(v)).alias("log_vessel"), R(keys.safe_ratio(v, F.col("no2"))).alias("ratio"))


@query("""SELECT week, round(sin(2*pi()*(weekofyear(week)-1)/53),6) AS week_sin, round(cos(2*pi()*(weekofyear(week)-1)/53),6) AS week_cos, CASE WHEN month(week) IN (11,12,1,2,3) THEN 'winter' ELSE 'non_winter' END AS season FROM (SELECT DISTINCT week FROM lp)""")
def fn_week_cycle_and_season(spark: SparkSession, d: str) -> DataFrame:
    s, c = keys.week_cycle(F.col("week"))
    return V.long_panel(spark, d).select("week").distinct().select("week", R(s).alias("week_sin"), R(c).alias("week_cos"), keys.season(F.col("week")).alias("season"))


@query("""SELECT n_name AS name, sha256('{"key":"'||n_nationkey||'","name":"'||n_name||'"}') AS signature FROM nation""", raw=True)
def fn_request_signature(spark: SparkSession, d: str) -> DataFrame:
    n = V.table(spark, d, "nation")
    params = F.create_map(F.lit("name"), F.col("n_name"), F.lit("key"), F.col("n_nationkey").cast("string"))
    return n.select(F.col("n_name").alias("name"), keys.request_signature(params).alias("signature"))


@query("""SELECT record_id, printf('POLYGON ((%.4f %.4f, %.4f %.4f, %.4f %.4f, %.4f %.4f, %.4f %.4f))', minx, miny, maxx, miny, maxx, maxy, minx, maxy, minx, miny) AS wkt FROM boxes_v""")
def fn_bbox_wkt(spark: SparkSession, d: str) -> DataFrame:
    return V.boxes(spark, d).select("record_id", geo.bbox_wkt(*[F.col(c) for c in ("minx", "miny", "maxx", "maxy")]).alias("wkt"))


@query("""SELECT event_id, TRY_CAST(json_extract_string(props,'$.k') AS DOUBLE) AS k, json_extract_string(props,'$.missing') AS missing FROM events""", raw=True)
def fn_json_properties(spark: SparkSession, d: str) -> DataFrame:
    e = V.table(spark, d, "events")
    props = F.from_json("props", "map<string,string>")
    return e.select("event_id", F.try_element_at(props, F.lit("k")).try_cast("double").alias("k"), F.try_element_at(props, F.lit("missing")).alias("missing"))


@query("""SELECT cell, port_km<=50 OR (port_km<=120 AND port IN ('Supplier#000000003','Supplier#3')) AS eligible FROM port_near""")
def fn_extended_eligibility(spark: SparkSession, d: str) -> DataFrame:
    near = joins.nearest_port(V.obs(spark, d).select("cell", "lat", "lon").distinct(), V.ports(spark, d))
    return near.select("cell", keys.eligible(F.col("distance_km"), F.col("port"), 50, 120, ["Supplier#000000003", "Supplier#3"]).alias("eligible"))


@query("""SELECT week, cell, vessel FROM (SELECT *, row_number() OVER (PARTITION BY week ORDER BY vessel DESC, cell) AS rn FROM panel WHERE vessel IS NOT NULL) WHERE rn<=3""")
def top_rows_by_week(spark: SparkSession, d: str) -> DataFrame:
    from pyspark.sql import Window as W

    p = V.panel(spark, d).where("vessel is not null")
    return p.withColumn("rn", F.row_number().over(W.partitionBy("week").orderBy(F.desc("vessel"), "cell"))).where("rn <= 3").select("week", "cell", "vessel")


@query("""SELECT cell, week, vessel FROM (SELECT *, row_number() OVER (PARTITION BY cell ORDER BY vessel DESC, week) AS rn FROM panel WHERE vessel IS NOT NULL) WHERE rn=1 ORDER BY vessel DESC, cell LIMIT 10""")
def top_zones_one_per_cell(spark: SparkSession, d: str) -> DataFrame:
    """Best row of each cell, then the ten best."""
    p = V.panel(spark, d).where("vessel is not null").select("cell", "week", "vessel")
    return joins.latest(p, ["cell"], [F.desc("vessel"), F.col("week")]).orderBy(F.desc("vessel"), "cell").limit(10)


@query("""SELECT cell, week, round(z,6) AS z, CASE WHEN z>q THEN 'extreme' ELSE 'high' END AS class FROM (SELECT *, (vessel-avg(vessel) OVER (PARTITION BY week))/nullif(stddev_pop(vessel) OVER (PARTITION BY week),0) AS z FROM panel WHERE vessel IS NOT NULL), (SELECT quantile_cont(z,0.95) AS q FROM (SELECT (vessel-avg(vessel) OVER (PARTITION BY week))/nullif(stddev_pop(vessel) OVER (PARTITION BY week),0) AS z FROM panel WHERE vessel IS NOT NULL)) ORDER BY round(z,6) DESC, cell, week LIMIT 20""")
def top_anomalies_with_class(spark: SparkSession, d: str) -> DataFrame:
    p = V.panel(spark, d).where("vessel is not null").withColumn("z", windows.group_z(F.col("vessel"), ["week"]))
    q = order.quantiles(p, [], {"q": ("z", 0.95)})
    ranked = p.crossJoin(F.broadcast(q)).select("cell", "week", R(F.col("z")).alias("z"), F.when(F.col("z") > F.col("q"), "extreme").otherwise("high").alias("class"))
    return ranked.orderBy(F.desc("z"), "cell", "week").limit(20)
