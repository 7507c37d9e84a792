"""Panel views over the driver's tables, as DataFrames and as SQL for the oracle.

The tables have no coordinates, so users become grid cells and nations coast
points by fixed formulas; amounts are summed in whole hundredths, so that sums
do not depend on the order of rows.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import geo, keys

#: Indicator of the panel for each type of event.
INDICATORS = {"click": "vessel", "view": "no2", "purchase": "ndvi", "error": "oil", "signup": "water"}
VALUES = list(INDICATORS.values())
FIRST_WEEK = "2024-01-01"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def cents(x: Column) -> Column:
    return F.round(x * 100).cast("long")


def obs(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    e = e.withColumns({"lat": 54.05 + (F.col("user_id") % 50) * 0.1, "lon": 18.05 + F.floor(F.col("user_id") / 50) * 0.1})
    return e.withColumns({"cell": keys.cell_id(F.col("lat"), F.col("lon")), "week": keys.week_start(F.col("ts"))})


def weekly(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of (cell, week) that have events: the indicators and the number of events."""
    sums = [(F.sum(F.when(F.col("event_type") == e, cents(F.col("value")))) / 100.0).alias(name) for e, name in INDICATORS.items()]
    return obs(spark, sf_dir).groupBy("cell", "week", "user_id", "lat", "lon").agg(*sums, F.count("*").alias("n_obs"))


def panel(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All weeks from the first to the last for every cell."""
    from ..operators import joins

    w = weekly(spark, sf_dir)
    cells = obs(spark, sf_dir).select("cell", "user_id", "lat", "lon").distinct()
    return joins.balanced(cells, w, "week").join(w.select("cell", "week", *VALUES, "n_obs"), ["cell", "week"], "left").withColumn("n_obs", F.coalesce("n_obs", F.lit(0).cast("long")))


def ports(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All suppliers as ports: five rows along the coast, wrapped after 400, then a little north."""
    s, k = table(spark, sf_dir, "supplier"), F.col("s_suppkey")
    lat = 54.2 + k % 5 * 0.8 + F.floor(k / 400) % 250 * 0.003
    return s.select(F.col("s_suppkey").alias("port_seq"), F.col("s_name").alias("port"), lat.alias("port_lat"), (17.9 + k % 400 * 0.07).alias("port_lon"), F.concat(F.lit("hub"), F.col("s_nationkey")).alias("hub"))


def coast(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = table(spark, sf_dir, "nation")
    return n.select(F.col("n_nationkey").cast("long").alias("coast_id"), (53.9 + F.col("n_nationkey") * 0.21).alias("coast_lat"), (17.95 - (F.col("n_nationkey") % 3) * 0.05).alias("coast_lon"))


def boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = table(spark, sf_dir, "nation")
    k = F.col("n_nationkey")
    return n.select(F.col("n_name").alias("record_id"), (18.0 + (k % 4) * 0.1).alias("minx"), (54.0 + k * 0.2).alias("miny"), (18.12 + (k % 4) * 0.1).alias("maxx"), (54.33 + k * 0.2).alias("maxy"))


def features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The panel with distances to the nearest port and coast point, and wind."""
    from ..operators import joins

    p = panel(spark, sf_dir)
    cells = p.select("cell", "lat", "lon").distinct()
    near = joins.nearest_port(cells, ports(spark, sf_dir))
    shore = joins.nearest(cells, coast(spark, sf_dir), ref_id="coast_id", ref_lat="coast_lat", ref_lon="coast_lon")
    shore = shore.select("cell", F.col("distance_km").alias("coast_km"), "coast_id", "coast_lat", "coast_lon")
    f = p.join(near.select("cell", "port", F.col("distance_km").alias("port_km")), "cell").join(shore, "cell")
    w = F.datediff("week", F.lit(FIRST_WEEK)) / 7
    wd, ws = ((F.col("user_id") * 37 + w * 53) % 360).cast("double"), (3 + (F.col("user_id") * 7 + w * 11) % 9).cast("double")
    f = f.withColumns({"wind_deg": wd, "wind_u": -ws * F.sin(F.radians(wd)), "wind_v": -ws * F.cos(F.radians(wd)), "shore_deg": geo.bearing_deg(F.col("lat"), F.col("lon"), F.col("coast_lat"), F.col("coast_lon"))})
    blown = F.pmod(F.col("wind_deg") + 180, F.lit(360.0))
    return f.withColumns({"shoreward": geo.is_shoreward(blown, F.col("shore_deg"))})


def long_panel(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Years of weekly order volume by nation of the customer: traffic, n, urgent."""
    o = table(spark, sf_dir, "orders").join(table(spark, sf_dir, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    sums = [(F.sum(cents(F.col("o_totalprice"))) / 100.0).alias("traffic"), F.count("*").alias("n"), F.sum(F.when(F.col("o_orderpriority") == "1-URGENT", 1).otherwise(0)).alias("urgent")]
    return o.groupBy(F.col("c_nationkey").cast("long").alias("cell"), keys.week_start(F.col("o_orderdate")).alias("week")).agg(*sums)


def stacked(f: DataFrame, columns: list[str] = VALUES, keep: tuple[str, ...] = ("cell", "week")) -> DataFrame:
    """One row for each column's non-null value: ``indicator``, ``value``."""
    return f.unpivot(list(keep), columns, "indicator", "value").where("value is not null")


def union_all(frames: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, frames)


def hav(a: str, b: str, c: str, d: str) -> str:
    """The SQL of a great-circle distance."""
    return f"(2*6371.0088*asin(sqrt(greatest(0.0, least(1.0, pow(sin(radians({c}-{a})/2),2)+cos(radians({a}))*cos(radians({c}))*pow(sin(radians({d}-{b})/2),2))))))"


_SUMS = ", ".join(f"sum(CASE WHEN event_type='{e}' THEN CAST(round(value*100) AS BIGINT) END)/100.0 AS {n}" for e, n in INDICATORS.items())
CTES = f"""
obs AS (SELECT *, 54.05+(user_id%50)*0.1 AS lat, 18.05+floor(user_id/50)*0.1 AS lon,
  printf('g0.100_r%d_c%d', CAST(floor((54.05+(user_id%50)*0.1+90)/0.1) AS BIGINT), CAST(floor((18.05+floor(user_id/50)*0.1+180)/0.1) AS BIGINT)) AS cell,
  CAST(date_trunc('week', ts) AS TIMESTAMP) AS week FROM events),
weekly AS (SELECT cell, week, user_id, lat, lon, {_SUMS}, count(*) AS n_obs FROM obs GROUP BY ALL),
cells AS (SELECT DISTINCT cell, user_id, lat, lon FROM obs),
weeks AS (SELECT unnest(generate_series((SELECT min(week) FROM obs), (SELECT max(week) FROM obs), INTERVAL 7 DAY)) AS week),
panel AS (SELECT c.cell, k.week, c.user_id, c.lat, c.lon, {", ".join("w." + v for v in VALUES)}, coalesce(w.n_obs, 0) AS n_obs
  FROM cells c CROSS JOIN weeks k LEFT JOIN weekly w ON w.cell=c.cell AND w.week=k.week),
ports_v AS (SELECT s_suppkey AS port_seq, s_name AS port, 54.2+s_suppkey%5*0.8+s_suppkey//400%250*0.003 AS port_lat, 17.9+s_suppkey%400*0.07 AS port_lon, 'hub'||s_nationkey AS hub FROM supplier),
coast_v AS (SELECT CAST(n_nationkey AS BIGINT) AS coast_id, 53.9+n_nationkey*0.21 AS coast_lat, 17.95-(n_nationkey%3)*0.05 AS coast_lon FROM nation),
boxes_v AS (SELECT n_name AS record_id, 18.0+(n_nationkey%4)*0.1 AS minx, 54.0+n_nationkey*0.2 AS miny, 18.12+(n_nationkey%4)*0.1 AS maxx, 54.33+n_nationkey*0.2 AS maxy FROM nation),
port_near AS (SELECT * FROM (SELECT c.cell, p.port, {hav("c.lat", "c.lon", "p.port_lat", "p.port_lon")} AS port_km,
  row_number() OVER (PARTITION BY c.cell ORDER BY {hav("c.lat", "c.lon", "p.port_lat", "p.port_lon")}, p.port_seq) AS rn FROM cells c CROSS JOIN ports_v p) WHERE rn=1),
coast_near AS (SELECT * FROM (SELECT c.cell, p.coast_id, p.coast_lat, p.coast_lon, {hav("c.lat", "c.lon", "p.coast_lat", "p.coast_lon")} AS coast_km,
  row_number() OVER (PARTITION BY c.cell ORDER BY {hav("c.lat", "c.lon", "p.coast_lat", "p.coast_lon")}, p.coast_id) AS rn FROM cells c CROSS JOIN coast_v p) WHERE rn=1),
feat0 AS (SELECT p.*, n.port, n.port_km, s.coast_km, s.coast_id, s.coast_lat, s.coast_lon,
  CAST((user_id*37+(date_diff('day', DATE '{FIRST_WEEK}', CAST(p.week AS DATE))//7)*53)%360 AS DOUBLE) AS wind_deg,
  CAST(3+(user_id*7+(date_diff('day', DATE '{FIRST_WEEK}', CAST(p.week AS DATE))//7)*11)%9 AS DOUBLE) AS ws,
  (degrees(atan2(sin(radians(s.coast_lon-p.lon))*cos(radians(s.coast_lat)), cos(radians(p.lat))*sin(radians(s.coast_lat))-sin(radians(p.lat))*cos(radians(s.coast_lat))*cos(radians(s.coast_lon-p.lon))))+360)%360 AS shore_deg
  FROM panel p JOIN port_near n USING (cell) JOIN coast_near s USING (cell)),
feat AS (SELECT *, -ws*sin(radians(wind_deg)) AS wind_u, -ws*cos(radians(wind_deg)) AS wind_v,
  CASE WHEN least(abs((wind_deg+180)%360-shore_deg), 360-abs((wind_deg+180)%360-shore_deg))<=45 THEN 1 ELSE 0 END AS shoreward FROM feat0),
lp AS (SELECT CAST(c_nationkey AS BIGINT) AS cell, CAST(date_trunc('week', o_orderdate) AS TIMESTAMP) AS week, sum(CAST(round(o_totalprice*100) AS BIGINT))/100.0 AS traffic,
  count(*) AS n, CAST(sum(CASE WHEN o_orderpriority='1-URGENT' THEN 1 ELSE 0 END) AS BIGINT) AS urgent FROM orders JOIN customer ON o_custkey=c_custkey GROUP BY ALL),
stack AS (SELECT cell, week, indicator, value FROM (UNPIVOT (SELECT cell, week, {", ".join(VALUES)} FROM feat) ON {", ".join(VALUES)} INTO NAME indicator VALUE value))"""


def oracle(body: str, ctes: str = "") -> str:
    """A query of the oracle over the views, with further common table expressions."""
    return f"WITH {CTES}{',' + chr(10) + ctes if ctes else ''}\n{body}"
