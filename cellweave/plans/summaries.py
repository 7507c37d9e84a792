"""Queries of aggregations and window functions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .. import session
from ..functions import keys
from ..operators import aggregates as A
from ..operators import joins, order, spatial, windows
from . import views as V
from .joining import _band_sql
from .registry import query

R = A.r6
COAST = _band_sql("coast_km", "decades")
PORT = _band_sql("port_km", "decades")


def _bands(f: DataFrame, column: str = "port_km") -> DataFrame:
    return f.withColumn("band", keys.distance_band(F.col(column), "decades"))


@query("""SELECT cell, week, count(*) AS n, array_to_string(list_sort(list(DISTINCT event_type)), ',') AS types, min(ts) AS first_ts, max(ts) AS last_ts FROM obs GROUP BY cell, week""")
def agg_weekly_records(spark: SparkSession, d: str) -> DataFrame:
    s = A.record_summary(V.obs(spark, d), ["cell", "week"], "event_type", "ts")
    return s.select("cell", "week", "n", F.array_join("refs", ",").alias("types"), F.col("first_ts").cast("timestamp").alias("first_ts"), F.col("last_ts").cast("timestamp").alias("last_ts"))


@query("""SELECT week, round(avg(k),6) AS p_k_mean, round(median(k),6) AS p_k_median FROM (SELECT week, TRY_CAST(json_extract_string(props,'$.k') AS DOUBLE) AS k FROM obs) GROUP BY week""")
def agg_property_stats(spark: SparkSession, d: str) -> DataFrame:
    """Numeric properties of JSON payloads as mean and median columns."""
    return A.property_stats(V.obs(spark, d), ["week"], "props", "p", ["k"])


@query("""SELECT week, CAST(sum(n_obs) AS BIGINT) AS n_obs, round(avg(vessel),6) AS mean, round(median(ndvi),6) AS median FROM weekly GROUP BY week""")
def agg_rollup_of_cells(spark: SparkSession, d: str) -> DataFrame:
    w = V.weekly(spark, d)
    made = w.groupBy("week").agg(F.sum("n_obs").alias("n_obs"), R(F.avg("vessel")).alias("mean"))
    return order.medians(made, w, ["week"], "ndvi")


@query("""SELECT cell, week, '{"n":'||n_obs||',"has":{"vessel":'||(vessel IS NOT NULL)||',"oil":'||(oil IS NOT NULL)||'}}' AS provenance FROM panel""")
def agg_provenance_json(spark: SparkSession, d: str) -> DataFrame:
    has = F.struct(F.col("vessel").isNotNull().alias("vessel"), F.col("oil").isNotNull().alias("oil"))
    return V.panel(spark, d).select("cell", "week", F.to_json(F.struct(F.col("n_obs").alias("n"), has.alias("has"))).alias("provenance"))


@query("""SELECT cell, week, vessel IS NOT NULL AS has_vessel, no2 IS NOT NULL AS has_no2, n_obs>0 AS has_any FROM panel""")
def agg_presence_flags(spark: SparkSession, d: str) -> DataFrame:
    return V.panel(spark, d).select("cell", "week", F.col("vessel").isNotNull().alias("has_vessel"), F.col("no2").isNotNull().alias("has_no2"), (F.col("n_obs") > 0).alias("has_any"))


@query("""SELECT user_id, event_type, event_id FROM (SELECT *, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts DESC, event_id DESC) AS rn FROM events) WHERE rn=1""", raw=True)
def agg_latest_record(spark: SparkSession, d: str) -> DataFrame:
    return joins.latest(V.table(spark, d, "events"), ["user_id", "event_type"], [F.desc("ts"), F.desc("event_id")]).select("user_id", "event_type", "event_id")


@query("""SELECT count(*) AS rows, count(DISTINCT user_id||'/'||event_type) AS keys FROM (SELECT DISTINCT user_id, event_type, date_trunc('day', ts) FROM events)""", raw=True)
def agg_drop_duplicates(spark: SparkSession, d: str) -> DataFrame:
    e = V.table(spark, d, "events").withColumn("day", F.date_trunc("day", "ts")).dropDuplicates(["user_id", "event_type", "day"])
    return e.agg(F.count("*").alias("rows"), F.count_distinct("user_id", "event_type").alias("keys"))


@query("""SELECT cell, round(avg(vessel),6) AS mean, round(median(vessel),6) AS median, max(vessel) AS max, count(DISTINCT CASE WHEN n_obs>0 THEN week END) AS weeks FROM panel GROUP BY cell""")
def agg_cell_summary(spark: SparkSession, d: str) -> DataFrame:
    return V.panel(spark, d).groupBy("cell").agg(R(F.avg("vessel")).alias("mean"), R(F.percentile("vessel", F.lit(0.5))).alias("median"), F.max("vessel").alias("max"), F.count_distinct(F.when(F.col("n_obs") > 0, F.col("week"))).alias("weeks"))


@query("""SELECT week, indicator, round(avg(value),6) AS mean, round(median(value),6) AS median, round(stddev_samp(value),6) AS std, count(*) AS n FROM stack GROUP BY ALL""")
def agg_week_summary(spark: SparkSession, d: str) -> DataFrame:
    s = V.stacked(V.panel(spark, d))
    made = s.groupBy("week", "indicator").agg(R(F.avg("value")).alias("mean"), R(F.stddev_samp("value")).alias("std"), F.count("*").alias("n"))
    return order.medians(made, s, ["week", "indicator"], "value")


@query("""SELECT port, week, round(avg(vessel),9) AS vessel, round(avg(no2),9) AS no2, round(avg(CAST(shoreward AS DOUBLE)),9) AS shoreward_share, count(*) AS n FROM feat WHERE port_km<=80 GROUP BY port, week""")
def agg_port_week(spark: SparkSession, d: str) -> DataFrame:
    f = V.features(spark, d).where("port_km <= 80")
    return f.groupBy("port", "week").agg(F.round(F.avg("vessel"), 9).alias("vessel"), F.round(F.avg("no2"), 9).alias("no2"), F.round(F.avg((F.col("shoreward") == 1).cast("double")), 9).alias("shoreward_share"), F.count("*").alias("n"))


@query("""SELECT port, round(avg(vessel),6) AS vessel, round(avg(no2),6) AS no2, round(avg(vessel/(1+port_km)),6) AS exposure, count(*) AS n FROM feat GROUP BY port""")
def agg_port_exposure_summary(spark: SparkSession, d: str) -> DataFrame:
    return V.features(spark, d).groupBy("port").agg(R(F.avg("vessel")).alias("vessel"), R(F.avg("no2")).alias("no2"), R(F.avg(keys.port_exposure(F.col("vessel"), F.col("port_km")))).alias("exposure"), F.count("*").alias("n"))


@query("""SELECT strftime(week,'%Y-%m') AS month, indicator, count(*) AS n FROM stack GROUP BY ALL""")
def agg_monthly_valid_counts(spark: SparkSession, d: str) -> DataFrame:
    s = V.stacked(V.panel(spark, d))
    return s.groupBy(keys.period_key(F.col("week"), "month").alias("month"), "indicator").agg(F.count("*").alias("n"))


@query(f"""SELECT {COAST} AS coast_band, {PORT} AS port_band, round(avg(vessel),6) AS vessel, round(avg(no2),6) AS no2, count(*) AS n FROM feat GROUP BY ALL""")
def agg_two_way_bands(spark: SparkSession, d: str) -> DataFrame:
    f = V.features(spark, d)
    by = [keys.distance_band(F.col(c), "decades").alias(n) for c, n in (("coast_km", "coast_band"), ("port_km", "port_band"))]
    return f.groupBy(*by).agg(R(F.avg("vessel")).alias("vessel"), R(F.avg("no2")).alias("no2"), F.count("*").alias("n"))


@query(f"""SELECT b.band, i.indicator, coalesce(n,0) AS n, coalesce(cells,0) AS cells, mean, median, std FROM (SELECT unnest(['0-10','10-25','25-50','50-100','>100']) AS band) b CROSS JOIN (SELECT DISTINCT indicator FROM stack) i LEFT JOIN (SELECT {PORT} AS band, indicator, count(*) AS n, count(DISTINCT cell) AS cells, round(avg(value),6) AS mean, round(median(value),6) AS median, round(stddev_samp(value),6) AS std FROM stack JOIN port_near USING (cell) GROUP BY ALL) t ON t.band=b.band AND t.indicator=i.indicator""")
def agg_band_decay_table(spark: SparkSession, d: str) -> DataFrame:
    """Every band of the scheme and indicator, also those without rows."""
    s = session.cut(V.stacked(_bands(V.features(spark, d)), keep=("cell", "week", "band")))
    every = spark.createDataFrame([(b, i) for b in keys.SCHEMES["decades"][1] for i in V.VALUES], "band string, indicator string")
    return A.band_table(s, every)


ZONES = {"z25": "port_km<=25", "z50": "port_km<=50", "z100": "port_km<=100", "outer": "port_km>50"}
REGIMES = {"all": "TRUE", "shoreward": "shoreward=1", "other": "shoreward=0"}


@query(" UNION ALL ".join(f"""SELECT '{z}' AS zone, '{g}' AS regime, count(*) AS n, round(avg(vessel),6) AS mean, round(median(vessel),6) AS median, round(avg(CAST(shoreward AS DOUBLE)),6) AS shoreward_share FROM feat WHERE vessel IS NOT NULL AND {zc} AND {gc} HAVING count(*)>0""" for z, zc in ZONES.items() for g, gc in REGIMES.items()))
def agg_zone_by_wind(spark: SparkSession, d: str) -> DataFrame:
    """Overlapping zones and wind regimes in one pass, each row put into all that hold it."""
    f = session.cut(V.features(spark, d).where("vessel is not null").select("port_km", "shoreward", "vessel"))
    f = A.in_overlapping(f, {z: F.expr(c) for z, c in ZONES.items()}, "zone")
    f = A.in_overlapping(f, {g: F.expr(c) for g, c in REGIMES.items()}, "regime")
    made = f.groupBy("zone", "regime").agg(F.count("*").alias("n"), R(F.avg("vessel")).alias("mean"), R(F.avg(F.col("shoreward").cast("double"))).alias("shoreward_share"))
    return order.medians(made, f, ["zone", "regime"], "vessel")


@query(" UNION ALL ".join(f"""SELECT port, '0-{k}' AS bucket, count(*) AS n, count(DISTINCT cell) AS cells, count(no2) AS valid, round(100.0*(count(*)-count(no2))/count(*),6) AS missing_percent, round(avg(no2),6) AS mean FROM feat WHERE port_km<={k} GROUP BY port""" for k in (25, 50, 100)))
def agg_cumulative_buckets(spark: SparkSession, d: str) -> DataFrame:
    f = A.in_overlapping(V.features(spark, d), {f"0-{k}": F.col("port_km") <= k for k in (25, 50, 100)}, "bucket")
    n, valid = F.count("*"), F.count("no2")
    return f.groupBy("port", "bucket").agg(n.alias("n"), F.count_distinct("cell").alias("cells"), valid.alias("valid"), R(100.0 * (n - valid) / n).alias("missing_percent"), R(F.avg("no2")).alias("mean"))


@query(f"""SELECT band, port, n, round(n/CAST(sum(n) OVER (PARTITION BY band) AS DOUBLE),6) AS share, n/CAST(sum(n) OVER (PARTITION BY band) AS DOUBLE)>=0.6 AND sum(n) OVER (PARTITION BY band)>=50 AS dominated FROM (SELECT {PORT} AS band, port, count(*) AS n FROM feat GROUP BY ALL)""")
def agg_band_dominance(spark: SparkSession, d: str) -> DataFrame:
    c = _bands(V.features(spark, d)).groupBy("band", "port").agg(F.count("*").alias("n"))
    total = F.sum("n").over(W.partitionBy("band"))
    return c.withColumns({"share": R(F.col("n") / total), "dominated": (F.col("n") / total >= 0.6) & (total >= 50)})


@query(f"""SELECT p.port, round(min(km),6) AS nearest_km, {", ".join(f"CAST(sum((km<={k})::INT) AS BIGINT) AS cells_{k}" for k in (25, 50, 100, 200))} FROM (SELECT p.port, {V.hav("c.lat", "c.lon", "p.port_lat", "p.port_lon")} AS km FROM cells c CROSS JOIN ports_v p) p GROUP BY p.port""")
def agg_grid_coverage_of_ports(spark: SparkSession, d: str) -> DataFrame:
    cells = V.obs(spark, d).select("cell", "lat", "lon").distinct()
    """How far every port is from the grid, and its cells within some distances."""
    ports = V.ports(spark, d)
    nearest = joins.nearest(ports, cells, point="port", lat="port_lat", lon="port_lon", ref_id="cell", ref_lat="lat", ref_lon="lon")
    around = spatial.within(cells, ports, 200, ref_lat="port_lat", ref_lon="port_lon").groupBy("port").agg(*[F.sum((F.col("distance_km") <= k).cast("long")).alias(f"cells_{k}") for k in (25, 50, 100, 200)])
    none = F.lit(0).cast("long")
    return nearest.join(around, "port", "left").select("port", R(F.col("distance_km")).alias("nearest_km"), *[F.coalesce(f"cells_{k}", none).alias(f"cells_{k}") for k in (25, 50, 100, 200)])


@query("""SELECT round(avg(CASE WHEN port_km<50 THEN no2 END),6) AS near, round(avg(CASE WHEN port_km>=50 AND port_km<=100 THEN no2 END),6) AS mid, round(avg(CASE WHEN port_km>100 THEN no2 END),6) AS far, count(*) AS n FROM feat""")
def agg_near_mid_far(spark: SparkSession, d: str) -> DataFrame:
    k, v = F.col("port_km"), F.col("no2")
    return V.features(spark, d).agg(R(F.avg(F.when(k < 50, v))).alias("near"), R(F.avg(F.when((k >= 50) & (k <= 100), v))).alias("mid"), R(F.avg(F.when(k > 100, v))).alias("far"), F.count("*").alias("n"))


@query(f"""SELECT b.port AS focal, f.port AS assigned, count(*) AS n FROM feat f JOIN ports_v b ON {V.hav("f.lat", "f.lon", "b.port_lat", "b.port_lon")}<=60 GROUP BY ALL""")
def agg_focal_versus_assigned(spark: SparkSession, d: str) -> DataFrame:
    """Weeks of cells within 60 km of a port by the port that they are assigned to."""
    f = V.features(spark, d).groupBy("cell", "lat", "lon", F.col("port").alias("assigned")).agg(F.count("*").alias("weeks"))
    near = spatial.within(f, V.ports(spark, d), 60, ref_lat="port_lat", ref_lon="port_lon")
    return near.groupBy(F.col("port").alias("focal"), "assigned").agg(F.sum("weeks").alias("n"))


@query(f"""SELECT port, round(avg(m),6) AS pooled FROM (SELECT port, {PORT} AS band, avg(vessel) AS m FROM feat GROUP BY ALL) GROUP BY port""")
def agg_pooled_zone_mean(spark: SparkSession, d: str) -> DataFrame:
    return _bands(V.features(spark, d)).groupBy("port", "band").agg(F.avg("vessel").alias("m")).groupBy("port").agg(R(F.avg("m")).alias("pooled"))


@query(f"""SELECT port, round(far-near,6) AS delta, CASE WHEN far<near THEN 'decreasing' WHEN far>near THEN 'increasing' ELSE 'flat' END AS trend, rank() OVER (ORDER BY round(abs(far-near),6) DESC NULLS LAST) AS place FROM (SELECT port, avg(CASE WHEN {PORT}='0-10' OR {PORT}='10-25' THEN no2 END) AS near, avg(CASE WHEN {PORT} IN ('50-100','>100') THEN no2 END) AS far FROM feat GROUP BY port)""".replace("rank() OVER", "CAST(rank() OVER").replace("NULLS LAST) AS place", "NULLS LAST) AS INT) AS place"))
def agg_decay_summary(spark: SparkSession, d: str) -> DataFrame:
    b = _bands(V.features(spark, d)).groupBy("port").agg(F.avg(F.when(F.col("band").isin("0-10", "10-25"), F.col("no2"))).alias("near"), F.avg(F.when(F.col("band").isin("50-100", ">100"), F.col("no2"))).alias("far"))
    delta = F.col("far") - F.col("near")
    place = F.rank().over(W.orderBy(F.abs(R(delta)).desc_nulls_last()))  # over one row for each port
    return b.select("port", R(delta).alias("delta"), F.when(delta < 0, "decreasing").when(delta > 0, "increasing").otherwise("flat").alias("trend"), place.alias("place"))


@query("""SELECT port, round(s,6) AS shoreward, round(o,6) AS other, round(s-o,6) AS difference, round(100*(s-o)/nullif(abs(o),0),6) AS percent, s>o AS amplified FROM (SELECT port, avg(CASE WHEN shoreward=1 THEN no2 END) AS s, avg(CASE WHEN shoreward=0 THEN no2 END) AS o FROM feat GROUP BY port)""")
def agg_regime_effect(spark: SparkSession, d: str) -> DataFrame:
    g = V.features(spark, d).groupBy("port").agg(F.avg(F.when(F.col("shoreward") == 1, F.col("no2"))).alias("s"), F.avg(F.when(F.col("shoreward") == 0, F.col("no2"))).alias("o"))
    s, o = F.col("s"), F.col("o")
    return g.select("port", R(s).alias("shoreward"), R(o).alias("other"), R(s - o).alias("difference"), R(100 * (s - o) / F.nullif(F.abs(o), F.lit(0.0))).alias("percent"), (s > o).alias("amplified"))


@query("""SELECT port, round(avg(no2),6) AS mean, round(CASE WHEN count(no2)=1 THEN 0 ELSE stddev_samp(no2)/sqrt(count(no2)) END,6) AS se, round(avg(CASE WHEN port_km>50 THEN no2 END)/nullif(avg(CASE WHEN port_km<=50 THEN no2 END),0),6) AS persistence, round(CASE WHEN isfinite(regr_slope(no2, port_km)) THEN regr_slope(no2, port_km) END,6) AS slope FROM feat GROUP BY port""")
def agg_inland_summary(spark: SparkSession, d: str) -> DataFrame:
    k, v = F.col("port_km"), F.col("no2")
    se = F.when(F.count(v) == 1, 0.0).otherwise(F.stddev_samp(v) / F.sqrt(F.count(v)))
    return V.features(spark, d).groupBy("port").agg(R(F.avg(v)).alias("mean"), R(se).alias("se"), R(F.avg(F.when(k > 50, v)) / F.nullif(F.avg(F.when(k <= 50, v)), F.lit(0.0))).alias("persistence"), R(F.regr_slope(v, k)).alias("slope"))


@query("""SELECT cell, round(median(wind_u),6) AS u, round(median(wind_v),6) AS v, round(median(no2),6) AS no2 FROM feat GROUP BY cell""")
def agg_median_vector_field(spark: SparkSession, d: str) -> DataFrame:
    half = lambda c: R(F.percentile(c, F.lit(0.5)))
    return V.features(spark, d).groupBy("cell").agg(half("wind_u").alias("u"), half("wind_v").alias("v"), half("no2").alias("no2"))


@query("""SELECT CAST(k*10 AS DOUBLE) AS start_km, count(*) AS n, round(avg(no2),6) AS mean, round(median(no2),6) AS median, round(stddev_samp(no2),6) AS std, count(*)>=10 AS sufficient FROM (SELECT port_km, no2, unnest(range(greatest(CAST(floor((port_km-50)/10) AS BIGINT)+1, 0), CAST(floor(port_km/10) AS BIGINT)+1)) AS k FROM feat WHERE no2 IS NOT NULL) GROUP BY k""")
def agg_sliding_windows(spark: SparkSession, d: str) -> DataFrame:
    return A.sliding_windows(session.cut(V.features(spark, d).select("port_km", "no2")), "port_km", "no2", 50, 10)


@query("""SELECT floor(port_km/20)*20 AS lower, count(*) AS n, round(avg(no2),6) AS mean, round(quantile_cont(no2,0.25),6) AS q1, round(median(no2),6) AS median, round(quantile_cont(no2,0.75),6) AS q3 FROM feat GROUP BY 1""")
def agg_equal_width_bins(spark: SparkSession, d: str) -> DataFrame:
    f = session.cut(V.features(spark, d).select("port_km", "no2")).withColumn("lower", (F.floor(F.col("port_km") / 20) * 20).cast("double"))
    made = f.groupBy("lower").agg(F.count("*").alias("n"), R(F.avg("no2")).alias("mean"))
    shares = {"q1": 0.25, "median": 0.5, "q3": 0.75}
    return order.beside(made, f, ["lower"], {name: ("no2", q) for name, q in shares.items()}).withColumns({name: R(F.col(name)) for name in shares})


@query("""SELECT CAST((vessel>e[2])::INT+(vessel>e[3])::INT+(vessel>e[4])::INT+(vessel>e[5])::INT AS INT) AS bin, count(*) AS n, round(avg(vessel),6) AS mean FROM feat, (SELECT quantile_cont(vessel,[0,0.2,0.4,0.6,0.8,1]) AS e FROM feat) WHERE vessel IS NOT NULL GROUP BY 1""")
def agg_quantile_bins(spark: SparkSession, d: str) -> DataFrame:
    f = session.cut(V.features(spark, d).where("vessel is not null").select("vessel"))
    return A.quantile_bins(f, "vessel", 5).groupBy("bin").agg(F.count("*").alias("n"), R(F.avg("vessel")).alias("mean"))


@query(f"""SELECT port, {PORT} AS band, count(no2) AS n, round(avg(no2),6) AS mean, round(CASE WHEN count(no2)=1 THEN 0 ELSE stddev_samp(no2)/sqrt(count(no2)) END,6) AS se FROM feat GROUP BY ALL""")
def agg_mean_and_error(spark: SparkSession, d: str) -> DataFrame:
    return A.mean_error(_bands(V.features(spark, d)), ["port", "band"], "no2")


_Q = ", ".join(f"round(quantile_cont(value,{p}),6) AS {n}" for p, n in ((0.05, "p5"), (0.25, "p25"), (0.5, "median"), (0.75, "p75"), (0.95, "p95")))
_M = "(sum(pow(value-mu,3))/count(*))/pow(sqrt(sum(pow(value-mu,2))/count(*)),3)"
_K = "(sum(pow(value-mu,4))/count(*))/pow(sum(pow(value-mu,2))/count(*),2)-3"


@query(f"""SELECT indicator, count(*) AS n, round(avg(value),6) AS mean, round(stddev_samp(value),6) AS std, min(value) AS min, {_Q}, max(value) AS max, round({_M},4) AS skew, round({_K},4) AS excess_kurtosis FROM stack JOIN (SELECT indicator, avg(value) AS mu FROM stack GROUP BY indicator) USING (indicator) GROUP BY indicator""")
def agg_profile(spark: SparkSession, d: str) -> DataFrame:
    return A.profile(V.stacked(V.panel(spark, d)))


@query(" UNION ALL ".join(f"""SELECT '{c}' AS "column", count({c}) AS non_null, round(100.0*(count(*)-count({c}))/count(*),6) AS missing_percent, round(100.0*sum((coalesce({c},1)=0)::INT)/count(*),6) AS zero_percent, count(DISTINCT {c}) AS n_unique, round(avg({c}),6) AS mean, round(stddev_samp({c}),6) AS std, CAST(min({c}) AS DOUBLE) AS min, CAST(max({c}) AS DOUBLE) AS max FROM panel""" for c in (*V.VALUES, "n_obs")))
def agg_column_audit(spark: SparkSession, d: str) -> DataFrame:
    return A.column_audit(V.panel(spark, d), [*V.VALUES, "n_obs"])


@query("""SELECT cell, week, round(((vessel IS NULL)::INT+(no2 IS NULL)::INT+(ndvi IS NULL)::INT+(oil IS NULL)::INT+(water IS NULL)::INT)/5.0,6) AS ratio FROM panel""")
def agg_row_missing_ratio(spark: SparkSession, d: str) -> DataFrame:
    return V.panel(spark, d).select("cell", "week", R(A.missing_ratio(V.VALUES)).alias("ratio"))


@query("""SELECT min(week) AS first_week, max(week) AS last_week, count(DISTINCT week) AS n_weeks, (SELECT count(*) FROM (SELECT unnest(generate_series((SELECT min(week) FROM lp),(SELECT max(week) FROM lp),INTERVAL 7 DAY)) AS w) WHERE w NOT IN (SELECT week FROM lp)) AS n_missing, count(DISTINCT week)+(SELECT count(*) FROM (SELECT unnest(generate_series((SELECT min(week) FROM lp),(SELECT max(week) FROM lp),INTERVAL 7 DAY)) AS w) WHERE w NOT IN (SELECT week FROM lp)) AS n_expected FROM lp""")
def agg_temporal_completeness(spark: SparkSession, d: str) -> DataFrame:
    return A.missing_weeks(V.long_panel(spark, d))


@query("""SELECT CAST(sum(c) AS BIGINT) AS rows, count(*) AS keys, CAST(sum((c>1)::INT) AS BIGINT) AS repeated_keys, CAST(sum(c-1) AS BIGINT) AS extra_rows FROM (SELECT count(*) AS c FROM obs GROUP BY cell, week)""")
def agg_key_uniqueness(spark: SparkSession, d: str) -> DataFrame:
    return A.key_report(V.obs(spark, d), ["cell", "week"])


@query("""SELECT week, count(*) AS rows, (SELECT count(*) FROM cells)-count(*) AS short, round(100.0*count(vessel)/count(*),6) AS vessel_coverage, sum((n_obs<2)::INT)::BIGINT AS low_density FROM weekly GROUP BY week""")
def agg_panel_balance(spark: SparkSession, d: str) -> DataFrame:
    """Rows of each week against the cells there are, coverage of a feature and cells with few records."""
    w = V.weekly(spark, d)
    cells = w.agg(F.count_distinct("cell").alias("cells"))
    per = w.groupBy("week").agg(F.count("*").alias("rows"), R(100.0 * F.count("vessel") / F.count("*")).alias("vessel_coverage"), F.sum((F.col("n_obs") < 2).cast("long")).alias("low_density"))
    return per.crossJoin(F.broadcast(cells)).select("week", "rows", (F.col("cells") - F.col("rows")).alias("short"), "vessel_coverage", "low_density")


@query("""SELECT indicator, round(q1,6) AS q1, round(q3,6) AS q3, round(q3-q1,6) AS iqr, round(q1-1.5*(q3-q1),6) AS low, round(q3+1.5*(q3-q1),6) AS high, CAST(sum((value<q1-1.5*(q3-q1) OR value>q3+1.5*(q3-q1))::INT) AS BIGINT) AS n_outliers FROM stack JOIN (SELECT indicator, quantile_cont(value,0.25) AS q1, quantile_cont(value,0.75) AS q3 FROM stack GROUP BY indicator) USING (indicator) GROUP BY indicator, q1, q3""")
def agg_tukey(spark: SparkSession, d: str) -> DataFrame:
    return A.tukey(V.stacked(V.panel(spark, d)))


@query("""SELECT cell, count(vessel) AS weeks, count(DISTINCT vessel) AS n_unique, round(stddev_pop(vessel),6) AS std FROM panel GROUP BY cell""")
def agg_temporal_variation(spark: SparkSession, d: str) -> DataFrame:
    return A.variation(V.panel(spark, d), "vessel")


@query("""SELECT (SELECT count(*) FROM (SELECT cell FROM feat GROUP BY cell HAVING count(coast_km)>0)) AS cells, 1.0::DOUBLE AS static_share, 0.0::DOUBLE AS weekly_std, 'spatial_proxy' AS status""")
def agg_static_layer_status(spark: SparkSession, d: str) -> DataFrame:
    """A layer without change in time, here the distance to the coast, is a spatial proxy."""
    f = V.features(spark, d).withColumn("km", F.round("coast_km", 3))
    return A.variation_status(f, "km")


@query("""SELECT cell, round(avg(oil/nullif(no2,0)),6) AS ratio, round(var_samp(oil),6) AS variance, count(*) AS n FROM panel WHERE oil IS NOT NULL GROUP BY cell HAVING count(*)>1 ORDER BY round(var_samp(oil),6) DESC, cell LIMIT 10""")
def agg_variance_ranking(spark: SparkSession, d: str) -> DataFrame:
    """Cells with the greatest variance of a layer."""
    g = V.panel(spark, d).where("oil is not null").groupBy("cell").agg(R(F.avg(keys.safe_ratio(F.col("oil"), F.col("no2")))).alias("ratio"), R(F.var_samp("oil")).alias("variance"), F.count("*").alias("n"))
    return g.where("n > 1").orderBy(F.desc("variance"), "cell").limit(10)


@query("""SELECT indicator, round(100.0*count(*)/(SELECT count(*) FROM panel),6) AS coverage, CASE WHEN count(DISTINCT value)<=1 THEN 'constant' WHEN count(*)<0.05*(SELECT count(*) FROM panel) THEN 'sparse' WHEN count(DISTINCT round(value))<0.01*count(*) THEN 'quantised' ELSE 'valid' END AS flag FROM stack GROUP BY indicator""")
def agg_layer_validity(spark: SparkSession, d: str) -> DataFrame:
    p = V.panel(spark, d)
    total = p.agg(F.count("*").alias("total"))
    s = V.stacked(p).groupBy("indicator").agg(F.count("*").alias("n"), F.count_distinct("value").alias("u"), F.count_distinct(F.round("value", 0)).alias("q")).crossJoin(F.broadcast(total))
    flag = F.when(F.col("u") <= 1, "constant").when(F.col("n") < 0.05 * F.col("total"), "sparse").when(F.col("q") < 0.01 * F.col("n"), "quantised").otherwise("valid")
    return s.select("indicator", R(100.0 * F.col("n") / F.col("total")).alias("coverage"), flag.alias("flag"))


@query("""SELECT indicator, round(100.0*count(*)/(SELECT count(*) FROM panel),6) AS percent, CASE WHEN 100.0*count(*)/(SELECT count(*) FROM panel)>80 THEN 'strong' WHEN 100.0*count(*)/(SELECT count(*) FROM panel)>50 THEN 'moderate' WHEN 100.0*count(*)/(SELECT count(*) FROM panel)>20 THEN 'weak' ELSE 'very weak' END AS tier FROM stack GROUP BY indicator""")
def agg_coverage_tiers(spark: SparkSession, d: str) -> DataFrame:
    p = V.panel(spark, d)
    total = p.agg(F.count("*").alias("total"))
    s = V.stacked(p).groupBy("indicator").agg(F.count("*").alias("n")).crossJoin(F.broadcast(total))
    percent = 100.0 * F.col("n") / F.col("total")
    return s.select("indicator", R(percent).alias("percent"), keys.coverage_tier(percent).alias("tier"))


@query("""SELECT category, count(*) AS n_features, array_to_string(list_sort(list(indicator)), ', ') AS features, CAST(sum(c) AS BIGINT) AS n_values FROM (SELECT indicator, count(*) AS c, CASE WHEN indicator='vessel' THEN 'maritime' WHEN indicator IN ('no2') THEN 'atmospheric' WHEN indicator IN ('oil','water') THEN 'marine' ELSE 'land' END AS category FROM stack GROUP BY indicator) GROUP BY category""")
def agg_feature_categories(spark: SparkSession, d: str) -> DataFrame:
    i = F.col("indicator")
    category = F.when(i.rlike("^vessel"), "maritime").when(i.rlike("^no2"), "atmospheric").when(i.rlike("^(oil|water)"), "marine").otherwise("land")
    s = V.stacked(V.panel(spark, d)).groupBy("indicator").agg(F.count("*").alias("c")).withColumn("category", category)
    return s.groupBy("category").agg(F.count("*").alias("n_features"), F.array_join(F.array_sort(F.collect_list("indicator")), ", ").alias("features"), F.sum("c").alias("n_values"))


@query("""SELECT CAST(floor(wind_deg/22.5) AS BIGINT) AS sector, count(*) AS n FROM feat GROUP BY 1""")
def agg_direction_rose(spark: SparkSession, d: str) -> DataFrame:
    return V.features(spark, d).groupBy(F.floor(F.col("wind_deg") / 22.5).alias("sector")).agg(F.count("*").alias("n"))


@query("""SELECT week, CASE WHEN u<>0 OR v<>0 THEN round((degrees(atan2(u,v))+360)%360,4) END AS to_deg, round(sqrt(u*u+v*v),6) AS speed FROM (SELECT week, round(avg(wind_u),9) AS u, round(avg(wind_v),9) AS v FROM feat GROUP BY week)""")
def agg_resultant_wind(spark: SparkSession, d: str) -> DataFrame:
    """Direction and speed of the mean wind, from components to 9 digits; winds that cancel out have no direction."""
    return A.resultant(V.features(spark, d), ["week"], "wind_u", "wind_v")


@query("""SELECT count(*) AS rows, count(vessel) AS vessel_rows, count(oil) AS oil_rows, round(100.0*count(vessel)/count(*),6) AS vessel_percent, round(100.0*count(oil)/count(*),6) AS oil_percent FROM panel""")
def agg_run_counters(spark: SparkSession, d: str) -> DataFrame:
    n = F.count("*")
    return V.panel(spark, d).agg(n.alias("rows"), F.count("vessel").alias("vessel_rows"), F.count("oil").alias("oil_rows"), R(100.0 * F.count("vessel") / n).alias("vessel_percent"), R(100.0 * F.count("oil") / n).alias("oil_percent"))


@query(" UNION ALL ".join(f"""SELECT '{a}' AS a, '{b}' AS b, CAST(sum((coalesce({a}>100,FALSE) AND coalesce({b}>100,FALSE))::INT) AS BIGINT) AS n FROM panel""" for i, a in enumerate(("vessel", "no2", "oil")) for b in ("vessel", "no2", "oil")[i:]))
def agg_flag_co_occurrence(spark: SparkSession, d: str) -> DataFrame:
    names = ["vessel", "no2", "oil"]
    flags = V.panel(spark, d).select(*[F.coalesce(F.col(c) > 100, F.lit(False)).alias(c) for c in names])
    return A.co_occurrence(flags, names)


@query(" UNION ALL ".join(f"""SELECT port, '{c}' AS "column", round(avg(({c} IS NOT NULL)::INT),6) AS share FROM feat GROUP BY port""" for c in V.VALUES))
def agg_coverage_by_port(spark: SparkSession, d: str) -> DataFrame:
    f = V.features(spark, d).select("port", *V.VALUES).unpivot(["port"], V.VALUES, "column", "value")
    return f.groupBy("port", "column").agg(R(F.avg(F.col("value").isNotNull().cast("double"))).alias("share"))


@query("""SELECT week, arg_max(port, struct_pack(n := n, p := CAST(-port_seq AS BIGINT))) AS port FROM (SELECT week, f.port, port_seq, count(*) AS n FROM feat f JOIN ports_v USING (port) WHERE vessel>50 GROUP BY ALL) GROUP BY week""")
def agg_modal_port(spark: SparkSession, d: str) -> DataFrame:
    """The most frequent port of each week's events; the first port of the list on ties."""
    f = V.features(spark, d).where("vessel > 50").join(V.ports(spark, d).select("port", "port_seq"), "port")
    c = f.groupBy("week", "port", "port_seq").count()
    return c.groupBy("week").agg(F.max_by("port", F.struct("count", -F.col("port_seq"))).alias("port"))


@query("""SELECT cell, week, vessel AS vessel_t, lag(vessel) OVER w AS vessel_t_minus_1, lag(vessel,2) OVER w AS vessel_t_minus_2 FROM panel WINDOW w AS (PARTITION BY cell ORDER BY week)""")
def win_row_lags(spark: SparkSession, d: str) -> DataFrame:
    return windows.lags(V.panel(spark, d), ["vessel"]).select("cell", "week", "vessel_t", "vessel_t_minus_1", "vessel_t_minus_2")


@query("""SELECT l.cell, l.week, l.traffic AS traffic_t, a.traffic AS traffic_t_minus_1, b.traffic AS traffic_t_minus_2 FROM lp l LEFT JOIN lp a ON a.cell=l.cell AND a.week=l.week-INTERVAL 7 DAY LEFT JOIN lp b ON b.cell=l.cell AND b.week=l.week-INTERVAL 14 DAY AND a.cell IS NOT NULL""")
def win_calendar_lags(spark: SparkSession, d: str) -> DataFrame:
    """Values of exactly one and two weeks before, null where a week is missing in between."""
    out = windows.lags(V.long_panel(spark, d), ["traffic"], calendar=True)
    return out.select("cell", "week", "traffic_t", "traffic_t_minus_1", "traffic_t_minus_2")


@query("""SELECT cell, week, round(lead(ndvi) OVER w - ndvi,6) AS delta, (lead(ndvi) OVER w - ndvi) IS NOT NULL AS valid FROM panel WINDOW w AS (PARTITION BY cell ORDER BY week)""")
def win_lead_delta(spark: SparkSession, d: str) -> DataFrame:
    return windows.lead_delta(V.panel(spark, d), "ndvi").select("cell", "week", R(F.col("delta_ndvi")).alias("delta"), F.col("has_valid_delta_ndvi").alias("valid"))


@query("""SELECT cell, week, ndvi, lead(ndvi) OVER (PARTITION BY cell ORDER BY week) AS ndvi_next FROM panel WHERE ndvi IS NOT NULL""")
def win_next_valid(spark: SparkSession, d: str) -> DataFrame:
    return windows.next_valid(V.panel(spark, d), "ndvi").select("cell", "week", "ndvi", "ndvi_next")


@query("""SELECT cell, week, round(no2-lag(no2) OVER w,6) AS no2_diff, round(lag(vessel) OVER w * ndvi,4) AS p1, round(lag(vessel,2) OVER w * ndvi,4) AS p2 FROM panel WINDOW w AS (PARTITION BY cell ORDER BY week)""")
def win_differences_and_products(spark: SparkSession, d: str) -> DataFrame:
    p = windows.lagged_products(windows.difference(V.panel(spark, d), "no2"), "vessel", "ndvi", 2)
    return p.select("cell", "week", R(F.col("no2_diff")).alias("no2_diff"), F.round("vessel_lag1_x_ndvi", 4).alias("p1"), F.round("vessel_lag2_x_ndvi", 4).alias("p2"))


def _frame(made: str, before: int, after: int, least: int, name: str) -> str:
    w = f"OVER (PARTITION BY cell ORDER BY week ROWS BETWEEN {before} PRECEDING AND {after} FOLLOWING)"
    return f"CASE WHEN count(traffic) {w}>={least} THEN round({made} {w},6) END AS {name}"


@query(f"""SELECT cell, week, {_frame("avg(traffic)", 11, 0, 4, "base12")}, {_frame("avg(traffic)", 1, 0, 2, "roll2")}, {_frame("avg(traffic)", 2, 0, 3, "roll3")}, {_frame("avg(traffic)", 1, 1, 1, "centred3")}, {_frame("quantile_cont(traffic,0.5)", 4, 4, 4, "median9")}, {_frame("stddev_samp(traffic)", 3, 0, 2, "std4")} FROM lp""")
def win_rolling(spark: SparkSession, d: str) -> DataFrame:
    """Trailing and centred means, medians and deviations with the least number of values each."""
    six = lambda *a: R(windows.rolling("traffic", *a))
    return V.long_panel(spark, d).select("cell", "week", six(11, 0, 4).alias("base12"), six(1, 0, 2).alias("roll2"), six(2, 0, 3).alias("roll3"), six(1, 1, 1).alias("centred3"), six(4, 4, 4, "median").alias("median9"), six(3, 0, 2, "std").alias("std4"))


@query("""SELECT cell, week, CASE WHEN count(traffic) OVER w>=4 THEN round(traffic-avg(traffic) OVER w,6) END AS anomaly FROM lp WINDOW w AS (PARTITION BY cell ORDER BY week ROWS BETWEEN 7 PRECEDING AND CURRENT ROW)""")
def win_deviation_from_trailing(spark: SparkSession, d: str) -> DataFrame:
    return V.long_panel(spark, d).select("cell", "week", R(F.col("traffic") - windows.rolling("traffic", 7, 0, 4)).alias("anomaly"))


@query("""SELECT cell, round(median(CASE WHEN isfinite(r) THEN r END),5) AS median_r FROM (SELECT cell, CASE WHEN count(*) OVER w>=6 THEN corr(traffic,n) OVER w END AS r FROM lp WINDOW w AS (PARTITION BY cell ORDER BY week ROWS BETWEEN 7 PRECEDING AND CURRENT ROW)) GROUP BY cell""")
def win_rolling_correlation_median(spark: SparkSession, d: str) -> DataFrame:
    r = windows.rolling_correlation("traffic", "n", 8, 6)
    return V.long_panel(spark, d).withColumn("n", F.col("n").cast("double")).select("cell", keys.clean(r).alias("r")).groupBy("cell").agg(F.round(F.percentile("r", F.lit(0.5)), 5).alias("median_r"))


RANKED = "ranked AS (SELECT cell, week, rank() OVER (PARTITION BY cell ORDER BY traffic)+(count(*) OVER (PARTITION BY cell, traffic)-1)/2.0 AS ra, rank() OVER (PARTITION BY cell ORDER BY n)+(count(*) OVER (PARTITION BY cell, n)-1)/2.0 AS rb FROM lp)"


@query("""SELECT cell, round(avg(CASE WHEN isfinite(r) THEN abs(r) END),5) AS mean_rho FROM (SELECT cell, CASE WHEN count(*) OVER w>=8 THEN corr(ra,rb) OVER w END AS r FROM ranked WINDOW w AS (PARTITION BY cell ORDER BY week ROWS BETWEEN 11 PRECEDING AND CURRENT ROW)) GROUP BY cell""", RANKED)
def win_rolling_spearman(spark: SparkSession, d: str) -> DataFrame:
    s = windows.rolling_spearman(V.long_panel(spark, d), "traffic", "n")
    return s.groupBy("cell").agg(F.round(F.avg(keys.clean(F.col("abs_rho"))), 5).alias("mean_rho"))


@query("""SELECT cell, week, round((rank() OVER (PARTITION BY week ORDER BY vessel)+(count(*) OVER (PARTITION BY week, vessel)-1)/2.0)/count(*) OVER (PARTITION BY week),6) AS pct FROM panel WHERE vessel IS NOT NULL""")
def win_weekly_percent_rank(spark: SparkSession, d: str) -> DataFrame:
    p = V.panel(spark, d).where("vessel is not null")
    return order.ranked(p.select("cell", "week", "vessel"), ["week"], "vessel", "pct", percent=True).select("cell", "week", R(F.col("pct")).alias("pct"))


@query("""SELECT cell, week, round((rank() OVER (ORDER BY n)+(count(*) OVER (PARTITION BY n)-1)/2.0)/count(*) OVER (),6) AS pct FROM lp""")
def win_global_percent_rank(spark: SparkSession, d: str) -> DataFrame:
    """Rank over all rows by counts of equal values and prefix sums of ranges, without one task for it."""
    return windows.global_rank(V.long_panel(spark, d), "n", "pct").select("cell", "week", R(F.col("pct")).alias("pct"))


@query("""SELECT cell, week, round(CASE WHEN stddev_pop(vessel) OVER w<1e-12 THEN 0 ELSE (vessel-avg(vessel) OVER w)/stddev_pop(vessel) OVER w END,6) AS z, round(vessel-avg(vessel) OVER w,6) AS anomaly, round(vessel-quantile_cont(vessel,0.5) OVER c,6) AS cell_anomaly FROM panel WHERE vessel IS NOT NULL WINDOW w AS (PARTITION BY week), c AS (PARTITION BY cell)""")
def win_group_z_and_anomaly(spark: SparkSession, d: str) -> DataFrame:
    p = V.panel(spark, d).where("vessel is not null")
    return p.select("cell", "week", R(windows.group_z(F.col("vessel"), ["week"])).alias("z"), R(windows.group_anomaly("vessel", ["week"])).alias("anomaly"), R(windows.group_anomaly("vessel", ["cell"], "median")).alias("cell_anomaly"))


@query("""SELECT cell, week, round(no2-avg(CASE WHEN port_km BETWEEN 20 AND 60 THEN no2 END) OVER (PARTITION BY week),6) AS excess FROM feat""")
def win_reference_excess(spark: SparkSession, d: str) -> DataFrame:
    return V.features(spark, d).select("cell", "week", R(windows.reference_excess("no2", F.col("port_km").between(20, 60), ["week"])).alias("excess"))


@query("""SELECT cell, week, round(CASE WHEN n>=12 AND sd>0 THEN (traffic-m)/sd END,5) AS z, CASE WHEN n<12 THEN 'insufficient_history' WHEN sd>0 AND abs((traffic-m)/sd)>=2 THEN 'anomalous' ELSE 'normal' END AS label FROM (SELECT *, count(traffic) OVER w AS nn, avg(traffic) OVER w AS m, stddev_samp(traffic) OVER w AS sd FROM lp WINDOW w AS (PARTITION BY cell)) WHERE TRUE""".replace("n>=12", "nn>=12").replace("n<12", "nn<12"))
def win_own_history_z(spark: SparkSession, d: str) -> DataFrame:
    return windows.own_history_z(V.long_panel(spark, d), "traffic").select("cell", "week", F.round("z", 5).alias("z"), "label")


@query("""SELECT port, CAST(dense_rank() OVER (ORDER BY m DESC) AS INT) AS dense, CAST(rank() OVER (ORDER BY m DESC)+(count(*) OVER (PARTITION BY m)-1)/2.0 AS DOUBLE) AS average FROM (SELECT port, round(avg(vessel),2) AS m FROM feat GROUP BY port)""")
def win_port_ranks(spark: SparkSession, d: str) -> DataFrame:
    """Ranks over one row for each port."""
    m = V.features(spark, d).groupBy("port").agg(F.round(F.avg("vessel"), 2).alias("m"))
    return m.select("port", F.dense_rank().over(W.orderBy(F.desc("m"))).alias("dense"), windows.average_rank(-F.col("m"), []).alias("average"))


@query("""SELECT cell, week, coalesce(vessel>=qv,FALSE) AS vessel_high, coalesce(no2>=qn,FALSE) AS no2_high FROM feat JOIN (SELECT port, quantile_cont(vessel,0.9) AS qv, quantile_cont(no2,0.9) AS qn FROM feat GROUP BY port) USING (port)""")
def win_own_port_top_decile(spark: SparkSession, d: str) -> DataFrame:
    return windows.at_group_quantile(V.features(spark, d), ["vessel", "no2"], "port", 0.9).select("cell", "week", "vessel_high", "no2_high")


@query("""SELECT cell, count(*) AS n_runs, max(c) AS longest, round(avg(c),6) AS mean_length FROM (SELECT cell, g, count(*) AS c FROM (SELECT cell, i-row_number() OVER (PARTITION BY cell ORDER BY week) AS g FROM (SELECT cell, week, traffic, row_number() OVER (PARTITION BY cell ORDER BY week) AS i, avg(traffic) OVER (PARTITION BY cell) AS m FROM lp) WHERE traffic>m) GROUP BY cell, g) GROUP BY cell""")
def win_run_lengths(spark: SparkSession, d: str) -> DataFrame:
    p = V.long_panel(spark, d).withColumn("m", F.avg("traffic").over(W.partitionBy("cell")))
    return windows.runs(p, F.col("traffic") > F.col("m"))


@query("""SELECT port, CASE WHEN count(dd)=0 THEN 'undetermined' WHEN min(dd)=0 AND max(dd)=0 THEN 'flat' WHEN min(dd)>=0 THEN 'increasing' WHEN max(dd)<=0 THEN 'decreasing' ELSE 'mixed' END AS direction, round(avg(dd),6) AS mean_step FROM (SELECT port, lead(m) OVER (PARTITION BY port ORDER BY b)-m AS dd FROM (SELECT port, CAST(floor(port_km/25) AS BIGINT) AS b, avg(no2) AS m FROM feat GROUP BY ALL)) GROUP BY port""")
def win_direction_over_bands(spark: SparkSession, d: str) -> DataFrame:
    m = V.features(spark, d).groupBy("port", F.floor(F.col("port_km") / 25).alias("b")).agg(F.avg("no2").alias("m"))
    return windows.direction(m, "m", "b", "port")
