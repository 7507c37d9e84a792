"""Queries of sources: landed JSON and XML, raster and pixel tables, wind, coverage; derived from the driver's tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import session
from ..operators import aggregates as A
from ..sources import landed as L
from . import views as V
from .registry import query

R = A.r6


def responses(spark: SparkSession, d: str) -> DataFrame:
    """Landed responses of several shapes, one for each nation; every fifth is not JSON."""
    n = V.table(spark, d, "nation").withColumn("k", F.col("n_nationkey"))
    record = F.format_string('{"record_id":"r%d","bbox":[%d.0,54.0,%d.5,55.0],"time":"2024-01-%02d","title":"%s"}', "k", 18 + F.col("k") % 3, 18 + F.col("k") % 3, 1 + F.col("k"), "n_name")
    shapes = [F.concat(F.lit('{"records":['), record, F.lit(","), record, F.lit("]}")), F.concat(F.lit('{"features":['), record, F.lit("]}")), F.concat(F.lit("["), record, F.lit("]")), record, F.lit("oops {")]
    body = shapes[4]
    for i in range(4):
        body = F.when(F.col("k") % 5 == i, shapes[i]).otherwise(body)
    return n.select(F.lit("api").alias("source"), F.col("n_name").alias("dataset"), F.col("k").cast("string").alias("request_signature"), body.alias("response_payload"))


@query("""SELECT n_name AS dataset, 18+n_nationkey%3+0.25::DOUBLE AS longitude, 54.5::DOUBLE AS latitude, CAST(DATE '2024-01-01'+n_nationkey AS TIMESTAMP) AS record_ts, printf('g0.100_r1445_c%d', 1982+(n_nationkey%3)*10) AS grid_id FROM nation, (SELECT unnest(range(2)) AS c) WHERE n_nationkey%5<>4 AND (n_nationkey%5=0 OR c=0)""", raw=True)
def src_standardized_responses(spark: SparkSession, d: str) -> DataFrame:
    """Lists under any of several members, bare lists and bare objects; bad JSON gives nothing."""
    s = L.standardize(responses(spark, d))
    return s.select("dataset", "longitude", "latitude", "record_ts", "grid_id")


@query("""SELECT n_name AS dataset, printf('POLYGON ((%.4f %.4f, %.4f %.4f, %.4f %.4f, %.4f %.4f, %.4f %.4f))', 18.0+n_nationkey%3, 54.0, 18.5+n_nationkey%3, 54.0, 18.5+n_nationkey%3, 55.0, 18.0+n_nationkey%3, 55.0, 18.0+n_nationkey%3, 54.0) AS geometry_wkt, n_name AS title FROM nation WHERE n_nationkey%5<>4""", raw=True)
def src_enriched_records(spark: SparkSession, d: str) -> DataFrame:
    """Metadata promoted from payloads, of the newest record for each catalogue id."""
    s = L.standardize(responses(spark, d)).withColumn("ingested_at_utc", F.col("raw_record_ref"))
    return L.enriched(L.merge_latest(s)).select("dataset", "geometry_wkt", "title")


@query("""SELECT n_name AS title, 'n'||n_nationkey||';region '||n_regionkey AS keywords, CASE WHEN n_nationkey%2=0 THEN '2023-05-01' ELSE '2022-01-01' END AS date, printf('POLYGON ((%.4f %.4f, %.4f %.4f, %.4f %.4f, %.4f %.4f, %.4f %.4f))', n_nationkey*1.0, 1.0, n_nationkey+1.0, 1.0, n_nationkey+1.0, 2.0, n_nationkey*1.0, 2.0, n_nationkey*1.0, 1.0) AS geometry_wkt FROM nation""", raw=True)
def src_metadata_xml(spark: SparkSession, d: str) -> DataFrame:
    n = V.table(spark, d, "nation")
    dated = F.when(F.col("n_nationkey") % 2 == 0, '<date type="creation">2020-01-01</date><date type="publication">2023-05-01</date>').otherwise("<dateStamp>2022-01-01</dateStamp>")
    xml = F.concat(F.format_string("<m><title>%s</title><keyword>n%d</keyword><keyword>region %d</keyword><west>%d</west><south>1</south><east>%d</east><north>2</north>", "n_name", "n_nationkey", "n_regionkey", "n_nationkey", F.col("n_nationkey") + 1), dated, F.lit("</m>"))
    return L.metadata_record(n.select(xml.alias("xml"))).select("title", "keywords", "date", "geometry_wkt")


@query("""SELECT r_name AS service, n_name AS name, 'Layer '||n_name AS title, n_nationkey*1.0::DOUBLE AS west, n_nationkey+0.5::DOUBLE AS east FROM nation JOIN region ON n_regionkey=r_regionkey""", raw=True)
def src_map_layers_xml(spark: SparkSession, d: str) -> DataFrame:
    """Layers of one capabilities document for each region."""
    n = V.table(spark, d, "nation").join(V.table(spark, d, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    layer = F.format_string('<Layer><Name>%s</Name><Title>Layer %s</Title><BoundingBox minx="%d.0" miny="1" maxx="%d.5" maxy="2"/></Layer>', "n_name", "n_name", "n_nationkey", "n_nationkey")
    docs = n.groupBy(F.col("r_name").alias("service")).agg(F.concat(F.lit("<Capability><Layer><Title>all</Title>"), F.array_join(F.collect_list(layer), ""), F.lit("</Layer></Capability>")).alias("xml"))
    return L.map_layers(docs).select("service", "name", "title", "west", "east")


@query("""SELECT cell, week, round(vessel,6) AS mean, round(vessel/2,6) AS median, n_obs AS n_valid FROM weekly WHERE vessel IS NOT NULL""")
def src_weekly_statistics_json(spark: SparkSession, d: str) -> DataFrame:
    """A row for each interval of statistics responses, one response for each cell."""
    w = V.weekly(spark, d).where("vessel is not null")
    stats = F.struct(F.col("vessel").alias("mean"), (F.col("n_obs") + 3).alias("sampleCount"), F.lit(3).alias("noDataCount"), F.create_map(F.lit("50.0"), F.col("vessel") / 2).alias("percentiles"))
    item = F.struct(F.struct(F.date_format("week", "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("from")).alias("interval"), F.struct(F.struct(F.struct(F.struct(stats.alias("stats")).alias("B0")).alias("bands")).alias("index")).alias("outputs"))
    p = w.groupBy("cell").agg(F.to_json(F.struct(F.collect_list(item).alias("data"))).alias("payload"))
    s = L.weekly_stats(p)
    return s.select("cell", "week", R(F.col("mean")).alias("mean"), R(F.col("median")).alias("median"), "n_valid")


@query("""SELECT event_id, CASE WHEN event_id%2=0 THEN event_id ELSE TRY_CAST(json_extract_string(props,'$.k') AS BIGINT)+5 END AS n FROM events""", raw=True)
def src_count_from_payload(spark: SparkSession, d: str) -> DataFrame:
    """Counts, else samples less no-data samples of a payload."""
    e = V.table(spark, d, "events")
    k = F.get_json_object("props", "$.k").cast("bigint")
    payload = F.to_json(F.struct((k + 10).alias("sampleCount"), F.lit(5).alias("noDataCount")))
    return e.select("event_id", L.filled_count(F.when(F.col("event_id") % 2 == 0, F.col("event_id")), payload).alias("n"))


@query("""SELECT code, year, count(*) AS pixels, count(v) AS valid, min(v) AS min, round(quantile_cont(v,0.5),6) AS median, round(avg(v),6) AS mean, max(v) AS max, round(stddev_pop(v),6) AS std FROM (SELECT printf('%02d', c_nationkey) AS code, CAST(year(o_orderdate) AS INT) AS year, CASE WHEN o_orderkey%7<>0 THEN o_totalprice END AS v FROM orders JOIN customer ON o_custkey=c_custkey) GROUP BY ALL""", raw=True)
def src_raster_overview(spark: SparkSession, d: str) -> DataFrame:
    """Layers of raster cells: one file for each nation and year, order values as pixels."""
    o = V.table(spark, d, "orders").join(V.table(spark, d, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    cells = o.select(F.format_string("vesseldensity_%02d_%d.tif", "c_nationkey", F.year("o_orderdate")).alias("file"), F.when(F.col("o_orderkey") % 7 != 0, F.col("o_totalprice")).alias("value"))
    return L.raster_overview(cells).select("code", "year", "pixels", "valid", "min", "median", "mean", "max", "std")


@query("""SELECT cell, CAST(year(ts) AS INT) AS year, sum(CASE WHEN event_id%3<>0 THEN CAST(round(value*100) AS BIGINT) END)/100.0 AS traffic FROM obs GROUP BY ALL""")
def src_raster_at_cells(spark: SparkSession, d: str) -> DataFrame:
    """Raster values at cell centres, summed over layers; some pixels have no data."""
    o = V.obs(spark, d)
    x, y = F.floor((F.col("lon") - 17.0) / 0.1).cast("long"), F.floor((60.0 - F.col("lat")) / 0.1).cast("long")
    raster = o.select(x.alias("x"), y.alias("y"), F.year("ts").alias("year"), F.when(F.col("event_id") % 3 != 0, V.cents(F.col("value"))).alias("value"))
    out = L.raster_at_cells(raster, o.select("cell", "lat", "lon").distinct(), west=17.0, north=60.0, size=0.1)
    return out.select("cell", "year", (F.col("traffic") / 100.0).alias("traffic"))


PIXELS = """px AS (SELECT cell, week, event_id%4 AS pixel, CAST(event_id%8 AS INT) AS scl, CAST(1000+event_id*7%900 AS DOUBLE) AS b3, CAST(900+event_id*11%800 AS DOUBLE) AS b4, CAST(800+event_id*13%700 AS DOUBLE) AS b5, CAST(700+event_id*17%1500 AS DOUBLE) AS b8, CAST(300+event_id*19%600 AS DOUBLE) AS b11, -10.0-event_id%9 AS vv, -18.0-event_id*5%11 AS vh FROM obs)"""


def pixels(spark: SparkSession, d: str) -> DataFrame:
    e = F.col("event_id")
    band = lambda base, m, k: (base + e * m % k).cast("double")
    return V.obs(spark, d).select("cell", "week", (e % 4).alias("pixel"), (e % 8).cast("int").alias("scl"), band(1000, 7, 900).alias("b3"), band(900, 11, 800).alias("b4"), band(800, 13, 700).alias("b5"), band(700, 17, 1500).alias("b8"), band(300, 19, 600).alias("b11"), (-10.0 - e % 9).alias("vv"), (-18.0 - e * 5 % 11).alias("vh"))


_OPT = "SELECT cell, week, pixel, avg((b3-b8)/nullif(b3+b8,0)) AS ndwi, avg((b4-b3)/nullif(b4+b3,0)) AS ndti, avg((b8-b4)/nullif(b8+b4,0)) AS ndvi FROM px WHERE scl IN (4,5,6) {} GROUP BY cell, week, pixel"


@query(f"""SELECT cell, week, round(avg(ndwi),6) AS ndwi_mean, round(stddev_pop(ndwi),6) AS ndwi_std, round(median(ndti),6) AS ndti_median FROM ({_OPT.format("")}) GROUP BY cell, week""", PIXELS)
def src_optical_composite(spark: SparkSession, d: str) -> DataFrame:
    return L.optical_indices(pixels(spark, d), [4, 5, 6]).select("cell", "week", "ndwi_mean", "ndwi_std", "ndti_median")


@query(f"""SELECT cell, week, round(avg(ndvi),6) AS ndvi_mean, round(median(ndvi),6) AS ndvi_median, round(stddev_pop(ndvi),6) AS ndvi_std FROM ({_OPT.format("AND (b3-b8)/nullif(b3+b8,0)<=0")}) GROUP BY cell, week""", PIXELS)
def src_land_vegetation(spark: SparkSession, d: str) -> DataFrame:
    return L.optical_indices(pixels(spark, d), [4, 5, 6], land_only=True).select("cell", "week", "ndvi_mean", "ndvi_median", "ndvi_std")


@query("""SELECT cell, week, round(avg(dark),6) AS probability, CAST(sum(dark) AS BIGINT) AS count FROM (SELECT m.cell, m.week, (vh<p20 AND coalesce(vv-vh>=p80,TRUE))::INT AS dark FROM med m JOIN (SELECT week, quantile_cont(vh,0.2) AS p20, quantile_cont(vv-vh,0.8) AS p80 FROM med GROUP BY week) USING (week)) GROUP BY cell, week""",
       PIXELS + ", med AS (SELECT cell, week, pixel, quantile_cont(CAST(vv AS DOUBLE),0.5) AS vv, quantile_cont(CAST(vh AS DOUBLE),0.5) AS vh FROM px GROUP BY cell, week, pixel)")
def src_radar_dark_surface(spark: SparkSession, d: str) -> DataFrame:
    return L.dark_surface(pixels(spark, d))


@query("""SELECT cell, week, round(avg(m),6) AS mean, round(stddev_pop(m),6) AS std FROM (SELECT cell, week, pixel, avg(b5) AS m FROM px GROUP BY cell, week, pixel) GROUP BY cell, week""", PIXELS)
def src_two_level_mean(spark: SparkSession, d: str) -> DataFrame:
    return L.two_level_mean(pixels(spark, d), "b5")


@query("""SELECT cell, count(*) AS expected, count(oil) AS valid, round(100.0*count(oil)/count(*),6) AS percent, count(*)-count(oil) AS missing FROM panel GROUP BY cell""")
def src_extraction_coverage(spark: SparkSession, d: str) -> DataFrame:
    return L.extraction_coverage(V.panel(spark, d), "oil")


@query("""SELECT cell, week, round(avg(least(greatest(value/200,0),1)),9) AS probability, CAST(sum(event_id%5) AS DOUBLE) AS count FROM obs WHERE event_type='error' GROUP BY cell, week""")
def src_optional_layer(spark: SparkSession, d: str) -> DataFrame:
    """A layer whose columns go by other names, reduced to one row for each key."""
    layer = V.obs(spark, d).where("event_type = 'error'").select(F.col("cell").alias("GRID_CELL_ID"), F.col("week").alias("week_start_utc"), (F.col("value") / 200).alias("Oil_Prob"), (F.col("event_id") % 5).alias("n_slicks"))
    return L.optional_layer(layer, {"probability": ["oil_slick_probability_t", "oil_prob"]}, {"count": ["oil_count", "N_SLICKS"]}, clip=("probability",))


_HOURLY = "hourly AS (SELECT user_id%5 AS cluster, ts AS time, CAST(2+event_id%11 AS DOUBLE) AS ws, CAST(event_id*29%360 AS DOUBLE) AS wd FROM events WHERE user_id%5<4 OR event_id%500=0)"


@query("""SELECT cluster, week, round(u,6) AS u, round(v,6) AS v, round(speed,6) AS speed, round((degrees(atan2(u,v))+360)%360,3) AS to_deg FROM (SELECT cluster, CAST(date_trunc('week', time) AS TIMESTAMP) AS week, avg(-ws*sin(radians(wd))) AS u, avg(-ws*cos(radians(wd))) AS v, avg(ws) AS speed FROM hourly WHERE cluster IN (SELECT cluster FROM hourly GROUP BY cluster HAVING count(*)>=24) GROUP BY ALL)""", _HOURLY)
def src_weekly_wind(spark: SparkSession, d: str) -> DataFrame:
    e = V.table(spark, d, "events").where("user_id % 5 < 4 or event_id % 500 = 0")
    h = e.select((F.col("user_id") % 5).alias("cluster"), F.col("ts").alias("time"), (2 + F.col("event_id") % 11).cast("double").alias("ws"), (F.col("event_id") * 29 % 360).cast("double").alias("wd"))
    return L.weekly_wind(h).select("cluster", "week", R(F.col("u")).alias("u"), R(F.col("v")).alias("v"), R(F.col("speed")).alias("speed"), F.round("to_deg", 3).alias("to_deg"))


@query("""SELECT cell, week, round(sqrt(pow(wind_u,2)+pow(wind_v,2)),6) AS speed, round((degrees(atan2(wind_u,wind_v))+360)%360,4) AS to_deg FROM feat WHERE wind_u<>0 AND wind_deg<>180""")
def src_normalized_wind(spark: SparkSession, d: str) -> DataFrame:
    f = V.features(spark, d).where("wind_u <> 0 and wind_deg <> 180").select("cell", "week", F.col("wind_u").alias("U10"), F.col("wind_v").alias("v10"))
    return L.normalized_wind(f).select("cell", "week", R(F.col("speed")).alias("speed"), F.round("to_deg", 4).alias("to_deg"))


@query("""SELECT page_id, array_to_string(list_filter(['synthetic','placeholder','fake_data'], lambda t: contains(lower(html), t)), ',') AS tokens FROM pages WHERE regexp_matches(lower(html),'synthetic|placeholder|fake_data')""", raw=True)
def src_placeholder_scan(spark: SparkSession, d: str) -> DataFrame:
    return L.placeholder_scan(V.table(spark, d, "pages"), "html").select("page_id", F.array_join("tokens", ",").alias("tokens"))


@query("""SELECT week FROM weekly GROUP BY week HAVING count(DISTINCT cell)=(SELECT count(DISTINCT cell) FROM weekly) AND coalesce(bool_or(vessel>0 OR oil>0),FALSE)""")
def src_complete_weeks(spark: SparkSession, d: str) -> DataFrame:
    """Weeks of a partial extract that need not run again."""
    w = V.weekly(spark, d)
    return L.complete_weeks(w, w.select("cell"), ["vessel", "oil"])


@query("""SELECT n_name AS name, CAST(k AS VARCHAR) AS value, c AS "column" FROM (SELECT n_name, unnest([n_nationkey, n_regionkey]) AS k, unnest(['n_nationkey','n_regionkey']) AS c FROM nation)""", raw=True)
def src_report_melt(spark: SparkSession, d: str) -> DataFrame:
    """Reports as cells of text, columns chosen by a pattern."""
    n = V.table(spark, d, "nation")
    rows = n.select("n_name", "n_nationkey", "n_regionkey")
    return rows.select(F.col("n_name").alias("name"), *[F.col(c).cast("string").alias(c) for c in ("n_nationkey", "n_regionkey")]).unpivot(["name"], ["n_nationkey", "n_regionkey"], "column", "value").select("name", "value", "column")


@query("""SELECT week, sum(n_obs)::BIGINT AS n_obs, count(DISTINCT cell) AS cells FROM (SELECT cell, week, n_obs FROM panel) GROUP BY week""")
def src_panel_projection(spark: SparkSession, d: str) -> DataFrame:
    """A panel written as Parquet and read back with three of its columns: cells and observations of every week."""
    at = session.scratch(spark, "panel")
    V.panel(spark, d).write.parquet(at)
    return spark.read.parquet(at).select("cell", "week", "n_obs").groupBy("week").agg(F.sum("n_obs").alias("n_obs"), F.count_distinct("cell").alias("cells"))


_RECORD_SQL = "SELECT event_type AS dataset, CAST(event_id AS VARCHAR) AS signature, cell AS grid_id FROM obs"


@query(f"""SELECT 'events' AS source, dataset, count(*) AS n, count(DISTINCT signature) AS signatures, count(DISTINCT grid_id) AS cells FROM ({_RECORD_SQL}) GROUP BY dataset""")
def src_records_written_once(spark: SparkSession, d: str) -> DataFrame:
    """Events landed as records twice, partitioned and each signature once, then read back by the record scan."""
    e = V.obs(spark, d)
    text = {c: F.lit(None).cast("string") for c in ("ingested_at_utc", "geometry_wkt")}
    records = e.select(
        F.lit("events").alias("source"), F.col("event_type").alias("dataset"), F.col("event_id").cast("string").alias("request_signature"), F.col("ts").cast("string").alias("record_timestamp_utc"), *[c.alias(n) for n, c in text.items()],
        F.col("lat").cast("double").alias("latitude"), F.col("lon").cast("double").alias("longitude"), F.lit("EPSG:4326").alias("crs"), F.col("cell").alias("grid_id"), F.col("event_id").cast("string").alias("raw_record_ref"), F.to_json(F.struct("event_type", "value")).alias("payload"),
    )
    root = session.scratch(spark, "records")
    for _ in range(2):
        L.write_once(records, f"{root}/events", by=("dataset", "source"))
    r = L.read_records(spark, root, "events")
    return r.groupBy("source", F.get_json_object("payload", "$.event_type").alias("dataset")).agg(F.count("*").alias("n"), F.count_distinct("raw_record_ref").alias("signatures"), F.count_distinct("grid_id").alias("cells"))


@query("""SELECT dataset, count(*) AS n, round(min(lat),6) AS south, round(max(lat),6) AS north, count(DISTINCT label) AS labels FROM (SELECT 'vessels' AS dataset, lat, event_type AS label FROM obs UNION ALL SELECT 'ports', 53.9+n_nationkey*0.21, n_name FROM nation) GROUP BY dataset""")
def src_folder_of_formats(spark: SparkSession, d: str) -> DataFrame:
    """A folder of CSV with untidy headers and of GeoJSON, read by hints in the names; columns found by their candidate names."""
    root = session.scratch(spark, "formats")
    e = V.obs(spark, d).select(F.col("event_type").alias("Event Type"), F.col("lat").alias(" Latitude "), F.col("lon").alias("LON"))
    e.write.csv(f"{root}/vessel_positions_csv", header=True)
    point = F.struct(F.lit("Point").alias("type"), F.array(F.lit(18.0), 53.9 + F.col("n_nationkey") * 0.21).alias("coordinates"))
    one = F.struct(F.lit("Feature").alias("type"), F.struct("n_name", (53.9 + F.col("n_nationkey") * 0.21).alias("y")).alias("properties"), point.alias("geometry"))
    features = V.table(spark, d, "nation").select("n_nationkey", F.to_json(F.struct(F.lit("FeatureCollection").alias("type"), F.array(one).alias("features"))).alias("value"))
    features.write.partitionBy("n_nationkey").text(f"{root}/ports_geojson")  # a file for each, since a file holds one collection
    wanted = {"lat": ["latitude", "lat", "y"], "label": ["event_type", "n_name"]}
    found = L.read_folder(spark, root, {"vessels": "vessel_positions_csv", "ports": "ports_geojson"})
    rows = V.union_all([L.resolve(df, wanted).select(F.lit(name).alias("dataset"), F.col("lat").cast("double").alias("lat"), "label") for name, df in found.items()])
    return rows.groupBy("dataset").agg(F.count("*").alias("n"), R(F.min("lat")).alias("south"), R(F.max("lat")).alias("north"), F.count_distinct("label").alias("labels"))
