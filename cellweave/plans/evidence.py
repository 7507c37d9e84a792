"""Queries of evidence tables: rolled and two-port correlations, relations with p, participation, zone and wind metrics, radar statistics, repaired layers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .. import session
from ..functions import keys
from ..operators import aggregates as A
from ..operators import order, stats, windows
from . import views as V
from .registry import query
from .statistics import _PAIR_SQL, PAIRS, _corr, _ranks
from .summaries import REGIMES, ZONES

R = A.r6


@query(f"""SELECT a, b, week, pearson, round(avg(pearson) OVER w,9) AS rolling_mean, round(coalesce(stddev_samp(pearson) OVER w,0),6) AS rolling_std FROM (SELECT a, b, week, {_corr("x", "y", 3)} AS pearson FROM r GROUP BY a, b, week HAVING count(*)>=3) WINDOW w AS (PARTITION BY a, b ORDER BY week ROWS BETWEEN 3 PRECEDING AND CURRENT ROW)""", _ranks(_PAIR_SQL, "a, b, week", "r"))
def win_rolling_weekly_correlation(spark: SparkSession, d: str) -> DataFrame:
    """The weekly correlation of each pair with its mean and deviation over four weeks (at least one; no deviation is 0)."""
    c = stats.correlations(V.panel(spark, d), PAIRS, by=("week",)).where("n >= 3")
    w = W.partitionBy("a", "b").orderBy("week").rowsBetween(-3, 0)
    return c.select("a", "b", "week", "pearson", F.round(F.avg("pearson").over(w), 9).alias("rolling_mean"), R(F.coalesce(F.stddev_samp("pearson").over(w), F.lit(0.0))).alias("rolling_std"))


_PORT_WEEKS = "pw AS (SELECT port, week, round(avg(vessel),6) AS vessel, round(avg(no2),6) AS no2 FROM feat WHERE port IN (SELECT port FROM ports_v ORDER BY port_seq LIMIT 2) GROUP BY ALL)"
_PORT_LAGS = " UNION ALL ".join(f"SELECT port, {k} AS lag, x, y FROM (SELECT port, vessel AS x, lead(no2,{k}) OVER (PARTITION BY port ORDER BY week) AS y FROM pw) WHERE x IS NOT NULL AND y IS NOT NULL" for k in range(4))


@query(f"""SELECT lag, n, pearson, spearman, s1 AS spearman_first, s2 AS spearman_second, round(CASE WHEN s1+s2 IS NOT NULL THEN 1-least(abs(s1-s2),1) END,6) AS stability, coalesce(sign(s1)=sign(s2),FALSE) AS signs_agree,
CASE WHEN abs(s1)>abs(s2) THEN 'first' WHEN abs(s2)>abs(s1) THEN 'second' ELSE 'similar' END AS stronger, coalesce(abs(spearman)>=0.12 AND n>=24 AND s1+s2 IS NOT NULL AND 1-least(abs(s1-s2),1)>=0.4,FALSE) AS recommended
FROM (SELECT CAST(lag AS INT) AS lag, count(*) AS n, {_corr("x", "y", 8)} AS pearson, {_corr("rx", "ry", 8)} AS spearman FROM r GROUP BY lag)
JOIN (SELECT lag, max(s) FILTER (first) AS s1, max(s) FILTER (NOT first) AS s2 FROM (SELECT lag, port=(SELECT port FROM ports_v ORDER BY port_seq LIMIT 1) AS first, {_corr("rx", "ry", 8)} AS s FROM rp GROUP BY ALL) GROUP BY lag) USING (lag)""",
       f'{_PORT_WEEKS}, {_ranks(_PORT_LAGS, "lag", "r")}, {_ranks(_PORT_LAGS, "port, lag", "rp")}')
def stat_two_port_lags(spark: SparkSession, d: str) -> DataFrame:
    """Weekly traffic with NO2 0 to 3 weeks later at the first two ports: pooled, by port, and how far the ports agree."""
    first, second = (F.lit(r.port) for r in V.ports(spark, d).orderBy("port_seq").limit(2).collect())
    weeks = V.features(spark, d).where(F.col("port").isin(first, second)).groupBy("port", "week").agg(R(F.avg("vessel")).alias("vessel"), R(F.avg("no2")).alias("no2"))
    pairs, lags = [("vessel", "no2")], range(4)
    pooled = stats.lag_correlations(weeks, pairs, lags, by="port", least=8)
    own = stats.lag_correlations(weeks, pairs, lags, by="port", group=("port",), least=8)
    of = lambda p: F.max(F.when(F.col("port") == p, F.col("spearman")))
    both = pooled.select("lag", "n", "pearson", "spearman").join(own.groupBy("lag").agg(of(first).alias("s1"), of(second).alias("s2")), "lag")
    s1, s2 = F.col("s1"), F.col("s2")
    stability = 1 - F.when(F.abs(s1 - s2) < 1, F.abs(s1 - s2)).when((s1 - s2).isNotNull(), 1.0)
    sure = (F.abs("spearman") >= 0.12) & (F.col("n") >= 24) & (stability >= 0.4)
    return both.select(
        "lag", "n", "pearson", "spearman", s1.alias("spearman_first"), s2.alias("spearman_second"), R(stability).alias("stability"), F.coalesce(F.signum(s1) == F.signum(s2), F.lit(False)).alias("signs_agree"),
        F.when(F.abs(s1) > F.abs(s2), "first").when(F.abs(s2) > F.abs(s1), "second").otherwise("similar").alias("stronger"), F.coalesce(sure, F.lit(False)).alias("recommended"),
    )


#: Predictors and targets of the relation table; the pairs that hold by construction.
PREDICTORS, TARGETS, CIRCULAR = ("vessel", "port_km", "coast_km"), ("no2", "ndvi", "oil", "water", "nearness"), ("port_km", "nearness")
RELATIONS = [(p, t) for p in PREDICTORS for t in TARGETS]
_NEAR = "nf AS (SELECT *, 1/(1+port_km) AS nearness FROM feat)"
_RELATIONS = " UNION ALL ".join(f"SELECT '{p}' AS a, '{t}' AS b, round({p},9) AS x, round({t},9) AS y FROM nf WHERE {p} IS NOT NULL AND {t} IS NOT NULL" for p, t in RELATIONS)


def _relations(spark: SparkSession, d: str) -> DataFrame:
    f = V.features(spark, d).withColumn("nearness", keys.proximity(F.col("port_km")))
    f = f.withColumns({c: F.round(c, 9) for c in (*PREDICTORS, *TARGETS)})
    c = stats.correlations(f, RELATIONS).select(F.col("a").alias("predictor"), F.col("b").alias("target"), "n", "spearman")
    circular = (F.col("predictor") == CIRCULAR[0]) & (F.col("target") == CIRCULAR[1])
    return c.withColumns({"reliable": (F.col("n") >= 30) & F.col("spearman").isNotNull(), "strength": keys.strength(F.col("spearman")), "circular": circular})


@query(f"""SELECT predictor, target, n, spearman, n>=30 AND spearman IS NOT NULL AS reliable, CASE WHEN abs(spearman)>=0.7 THEN 'strong' WHEN abs(spearman)>=0.4 THEN 'moderate' WHEN abs(spearman)>=0.2 THEN 'weak' WHEN spearman IS NOT NULL THEN 'negligible' ELSE 'insufficient' END AS strength, predictor='{CIRCULAR[0]}' AND target='{CIRCULAR[1]}' AS circular FROM (SELECT a AS predictor, b AS target, count(*) AS n, {_corr("rx", "ry", 3)} AS spearman FROM r GROUP BY a, b)""", f'{_NEAR}, {_ranks(_RELATIONS, "a, b", "r")}')
def stat_relations(spark: SparkSession, d: str) -> DataFrame:
    """Rank correlation of every predictor with every target, how far to trust it, and whether it holds by construction."""
    return _relations(spark, d)


@query()
def stat_relations_p(spark: SparkSession, d: str) -> DataFrame:
    """The same with two-sided p by Student's t, and the subset that can be defended: reliable, at least weak, p < 0.05, not circular."""
    c = _relations(spark, d)
    p = F.when(F.abs("spearman") >= 1, 0.0).otherwise(stats.t_p(stats.correlation_t(F.col("spearman"), F.col("n")), F.col("n") - 2))
    c = c.withColumn("p", R(p))
    return c.withColumn("defensible", F.coalesce(F.col("reliable") & F.col("strength").isin("weak", "moderate", "strong") & (F.col("p") < 0.05) & ~F.col("circular"), F.lit(False)))


@query(f"""SELECT a AS indicator, count(*) AS n, {_corr("rx", "ry", 3)} AS spearman FROM r GROUP BY a""", _ranks(" UNION ALL ".join(f"SELECT '{v}' AS a, {v} AS x, CAST(shoreward AS DOUBLE) AS y FROM feat WHERE {v} IS NOT NULL" for v in V.VALUES), "a", "r"))
def stat_binary_factor(spark: SparkSession, d: str) -> DataFrame:
    """Rank correlation of each indicator with the wind regime as 0 or 1."""
    c = stats.correlations(V.features(spark, d), [(v, "shoreward") for v in V.VALUES])
    return c.select(F.col("a").alias("indicator"), "n", "spearman")


#: What each indicator stands for in the composition of a band.
THEMES = {"vessel": "ships", "no2": "air", "ndvi": "land", "oil": "sea", "water": "sea"}
_BAND = "CAST(floor(port_km/50)*50 AS BIGINT)"
_PART = f"""pt AS (SELECT indicator, {_BAND} AS band, shoreward=1 AS s, pct FROM (SELECT cell, week, indicator, (rank() OVER (PARTITION BY indicator ORDER BY value)+(count(*) OVER (PARTITION BY indicator, value)-1)/2.0)/count(*) OVER (PARTITION BY indicator) AS pct FROM stack) JOIN (SELECT cell, week, port_km, shoreward FROM feat) USING (cell, week)),
bs AS (SELECT indicator, band, s, count(*) AS n, avg(pct) AS mean, quantile_cont(pct,0.5) AS median, var_samp(pct) AS variance FROM pt GROUP BY ALL),
un AS (SELECT indicator, band, CAST(count(*) FILTER (s) AS DOUBLE) AS n1, CAST(count(*) FILTER (NOT s) AS DOUBLE) AS n0, sum(r) FILTER (s) AS rs FROM (SELECT *, rank() OVER (PARTITION BY indicator, band ORDER BY pct)+(count(*) OVER (PARTITION BY indicator, band, pct)-1)/2.0 AS r FROM pt) GROUP BY ALL)"""


def _participation(spark: SparkSession, d: str) -> DataFrame:
    """Percent rank of every value within its indicator, with the band and the side of the wind."""
    s = V.stacked(V.features(spark, d), keep=("cell", "week", "port_km", "shoreward"))
    s = order.ranked(session.cut(s), ["indicator"], "value", "pct", percent=True)
    return session.cut(s.select("cell", "week", "indicator", (F.floor(F.col("port_km") / 50) * 50).alias("band"), (F.col("shoreward") == 1).alias("shoreward"), "pct"))


_FRAME = """mk AS (SELECT s.cell, s.week, s.indicator, s.value, coast_km<=30 AS m FROM stack s JOIN (SELECT cell, week, coast_km FROM feat) USING (cell, week)), mq AS (SELECT indicator, quantile_cont(value,[0.25,0.5,0.75]) AS q FROM mk WHERE m GROUP BY indicator),
mr AS (SELECT cell, week, indicator, (rank() OVER (PARTITION BY indicator ORDER BY value)+(count(*) OVER (PARTITION BY indicator, value)-1)/2.0)/count(*) OVER (PARTITION BY indicator) AS pct FROM mk WHERE m)"""


@query("""SELECT cell, week, indicator, m AS inside, round(pct,6) AS rank_participation, CASE WHEN m AND q[3]-q[1]>=1e-12 THEN round(greatest(-3.5,least(3.5,(value-q[2])/((q[3]-q[1])/1.34896))),6) END AS rz_participation FROM mk LEFT JOIN mr USING (cell, week, indicator) LEFT JOIN mq USING (indicator)""", _FRAME)
def stat_participation_frame(spark: SparkSession, d: str) -> DataFrame:
    """Every value with its percent rank and robust z among the coastal ones of its indicator; cells beyond 30 km from the coast have neither."""
    s = V.stacked(V.features(spark, d), keep=("cell", "week", "coast_km"))
    f = stats.masked_standing(s, F.col("coast_km") <= 30, "indicator", "value")
    return f.select("cell", "week", "indicator", "inside", R(F.col("rank_pct")).alias("rank_participation"), R(F.col("robust_z")).alias("rz_participation"))


def _contrast(rows: DataFrame) -> DataFrame:
    """Both sides of each band with the size of the difference seen from that side; null below 8 values on either."""
    t = stats.two_sample(rows, ["indicator", "band"], F.col("shoreward"), "pct")
    enough = (F.col("n1") >= 8) & (F.col("n0") >= 8)
    sides = F.array(*[F.struct(F.lit(s).alias("shoreward"), (k * F.col("cliffs_delta")).alias("d")) for s, k in ((True, 1), (False, -1))])
    e = t.select("indicator", "band", "mw_p", enough.alias("_ok"), F.explode(sides).alias("e"))
    return e.select("indicator", "band", "e.shoreward", F.when(F.col("_ok"), F.col("e.d")).alias("cliffs_delta"), F.when(F.col("_ok"), F.col("mw_p")).alias("p"))


@query("""SELECT indicator, band, s AS shoreward, n, round(mean,6) AS mean, round(median,6) AS median, round(variance,6) AS variance, CASE WHEN n1>=8 AND n0>=8 THEN round((2*(rs-n1*(n1+1)/2)/(n1*n0)-1)*(CASE WHEN s THEN 1 ELSE -1 END),6) END AS cliffs_delta FROM bs JOIN un USING (indicator, band)""", _PART)
def stat_participation_statistics(spark: SparkSession, d: str) -> DataFrame:
    """Participation ranks by indicator, distance band and wind, against the opposite wind in the same band."""
    p = _participation(spark, d)
    b = p.groupBy("indicator", "band", "shoreward").agg(F.count("*").alias("n"), R(F.avg("pct")).alias("mean"), R(F.var_samp("pct")).alias("variance"))
    b = order.medians(b, p, ["indicator", "band", "shoreward"], "pct")
    return b.join(_contrast(p).drop("p"), ["indicator", "band", "shoreward"])


@query()
def stat_participation_intervals(spark: SparkSession, d: str) -> DataFrame:
    """Bootstrap intervals of the mean participation (2,000 draws) and the Mann-Whitney p against the opposite wind."""
    p = _participation(spark, d)
    by = ["indicator", "band", "shoreward"]
    return stats.bootstrap_mean(p, by, "pct", draws=2000, key=("cell", "week", "indicator")).join(_contrast(p), by)


@query(f"""SELECT band, s AS shoreward, {", ".join(f"round(max(mean) FILTER (indicator='{v}'),6) AS {v}" for v in V.VALUES)}, {", ".join(f"round(sum(mean) FILTER (indicator IN ({','.join(repr(v) for v in V.VALUES if THEMES[v] == t)}))/sum(mean),6) AS share_{t}" for t in sorted(set(THEMES.values())))} FROM bs GROUP BY band, s""", _PART)
def stat_participation_matrix(spark: SparkSession, d: str) -> DataFrame:
    """Band by indicator: mean participation, and each theme's share of the band's sum."""
    m = _participation(spark, d).groupBy("band", "shoreward", "indicator").agg(F.avg("pct").alias("mean"))
    theme = lambda t: F.sum(F.when(F.col("indicator").isin([v for v in V.VALUES if THEMES[v] == t]), F.col("mean"))) / F.sum("mean")
    return m.groupBy("band", "shoreward").agg(*[R(F.max(F.when(F.col("indicator") == v, F.col("mean")))).alias(v) for v in V.VALUES], *[R(theme(t)).alias(f"share_{t}") for t in sorted(set(THEMES.values()))])


_ZONED = "zr AS (" + " UNION ALL ".join(f"SELECT port, '{z}' AS zone, '{g}' AS regime, cell, week, port_km, shoreward FROM feat WHERE {zc} AND {gc}" for z, zc in ZONES.items() for g, gc in REGIMES.items()) + ")"
_ZONE_VALUES = "SELECT z.port, z.zone, z.regime, s.indicator AS metric, s.value AS x, round(z.port_km,9) AS y FROM zr z JOIN stack s USING (cell, week)"


def _zone_metrics(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """The rows of the features in every zone and regime that hold them, as they are and with a row for each metric."""
    light = session.cut(V.features(spark, d).select("cell", "week", "port", "port_km", "shoreward", *V.VALUES))
    f = A.in_overlapping(light, {z: F.expr(c) for z, c in ZONES.items()}, "zone")
    f = A.in_overlapping(f, {g: F.expr(c) for g, c in REGIMES.items()}, "regime").withColumn("port_km", F.round("port_km", 9))
    return f, V.stacked(f, keep=("port", "zone", "regime", "cell", "week", "port_km")).withColumnRenamed("indicator", "metric")


@query(f"""SELECT port, zone, regime, metric, n, mean, median, spearman, CASE WHEN regime='all' THEN shoreward_share END AS shoreward_share FROM (SELECT port, zone, regime, metric, count(*) AS n, round(sum(CAST(round(x*100) AS BIGINT))/100.0/count(*),6) AS mean, round(quantile_cont(x,0.5),6) AS median, {_corr("rx", "ry", 15)} AS spearman FROM r GROUP BY ALL) JOIN (SELECT port, zone, round(avg(CAST(shoreward AS DOUBLE)),6) AS shoreward_share FROM zr WHERE regime='all' GROUP BY ALL) USING (port, zone)""", f'{_ZONED}, {_ranks(_ZONE_VALUES, "port, zone, regime, metric", "r")}')
def agg_zone_wind_metrics(spark: SparkSession, d: str) -> DataFrame:
    """Port, overlapping zone, wind and metric: n, mean, median, rank correlation with the distance (from 15 rows on), share of shoreward wind."""
    f, s = _zone_metrics(spark, d)
    by = ["port", "zone", "regime", "metric"]
    ranked = stats.both_ranked(s, by, "value", "port_km")
    rho = F.when(F.count("*") >= 15, windows.correlation(F.col("rx"), F.col("ry")))
    table = ranked.groupBy(*by).agg(F.count("*").alias("n"), R(F.sum(V.cents(F.col("value"))) / 100.0 / F.count("*")).alias("mean"), R(rho).alias("spearman"))
    table = order.medians(table, s, by, "value")
    share = f.where("regime = 'all'").groupBy("port", "zone", "regime").agg(R(F.avg(F.col("shoreward").cast("double"))).alias("shoreward_share"))
    return table.join(share, ["port", "zone", "regime"], "left")


@query()
def agg_zone_wind_intervals(spark: SparkSession, d: str) -> DataFrame:
    """The bootstrap interval (500 draws) of every mean of that table."""
    _, s = _zone_metrics(spark, d)
    return stats.bootstrap_mean(s, ["port", "zone", "regime", "metric"], "value", draws=500, key=("cell", "week", "metric"))


_LABEL = "CASE WHEN oil IS NULL THEN 'missing' WHEN oil>=100 THEN 'likely' WHEN oil>0 THEN 'possible' ELSE 'clear' END"


def radar_overview(panel: DataFrame, vv: str, vh: str, score: str) -> DataFrame:
    """Statistics of two bands and a detection score, one row for each: means and deviations, their ratio, spread of the weekly means,
    share of cells that ever lack a value, positive share, and the count of each label."""
    a, b, s = F.col(vv), F.col(vh), F.col(score)
    label = F.when(s.isNull(), "missing").when(s >= 100, "likely").when(s > 0, "possible").otherwise("clear")
    ratio = F.try_divide(a, b)
    long = lambda df: df.select(F.explode(F.array(*[F.struct(F.lit(c).alias("statistic"), F.col(c).cast("double").alias("value")) for c in df.columns])).alias("e")).select("e.*")
    whole = panel.agg(
        F.avg(a).alias("vv_mean"), F.stddev_samp(a).alias("vv_std"), F.avg(b).alias("vh_mean"), F.stddev_samp(b).alias("vh_std"), F.avg(ratio).alias("ratio_mean"), F.stddev_samp(ratio).alias("ratio_std"),
        (100.0 * F.avg(F.coalesce((s > 0).cast("int"), F.lit(0)))).alias("positive_percent"), *[F.sum((label == w).cast("long")).alias(f"label_{w}") for w in ("clear", "likely", "missing", "possible")],
    )
    weekly = panel.groupBy("week").agg(F.avg(a).alias("m"), F.avg(b).alias("k")).agg(F.count("*").alias("windows"), F.stddev_samp("m").alias("vv_window_std"), F.stddev_samp("k").alias("vh_window_std"))
    cells = panel.groupBy("cell").agg(F.max((a.isNull() | b.isNull() | s.isNull()).cast("int")).alias("lacks")).agg((100.0 * F.avg("lacks")).alias("cells_missing_percent"))
    return V.union_all([long(whole), long(weekly), long(cells)]).withColumn("value", R(F.col("value")))


@query(f"""SELECT statistic, round(value,6) AS value FROM (
UNPIVOT (SELECT avg(no2) AS vv_mean, stddev_samp(no2) AS vv_std, avg(water) AS vh_mean, stddev_samp(water) AS vh_std, avg(no2/nullif(water,0)) AS ratio_mean, stddev_samp(no2/nullif(water,0)) AS ratio_std, 100.0*avg(coalesce((oil>0)::INT,0)) AS positive_percent,
{", ".join(f"CAST(count(*) FILTER (({_LABEL})='{w}') AS DOUBLE) AS label_{w}" for w in ("clear", "likely", "missing", "possible"))} FROM panel) ON COLUMNS(*) INTO NAME statistic VALUE value
UNION ALL UNPIVOT (SELECT CAST(count(*) AS DOUBLE) AS windows, stddev_samp(m) AS vv_window_std, stddev_samp(k) AS vh_window_std FROM (SELECT avg(no2) AS m, avg(water) AS k FROM panel GROUP BY week)) ON COLUMNS(*) INTO NAME statistic VALUE value
UNION ALL SELECT 'cells_missing_percent', 100.0*avg(l) FROM (SELECT max((no2 IS NULL OR water IS NULL OR oil IS NULL)::INT) AS l FROM panel GROUP BY cell))""")
def agg_radar_overview(spark: SparkSession, d: str) -> DataFrame:
    return radar_overview(V.panel(spark, d), "no2", "water", "oil")


@query("""SELECT kind, place, cell, variance FROM (SELECT *, row_number() OVER (PARTITION BY kind ORDER BY CASE WHEN kind='high' THEN -variance ELSE variance END, cell) AS place FROM (SELECT cell, round((coalesce(var_samp(no2),0)+coalesce(var_samp(water),0))/2,4) AS variance, unnest(['high','stable']) AS kind FROM panel GROUP BY cell)) WHERE place<=10""")
def top_radar_variance_cells(spark: SparkSession, d: str) -> DataFrame:
    """The ten cells whose bands vary most and the ten that vary least."""
    none = F.lit(0.0)
    v = V.panel(spark, d).groupBy("cell").agg(F.round((F.coalesce(F.var_samp("no2"), none) + F.coalesce(F.var_samp("water"), none)) / 2, 4).alias("variance"))

    def ten(kind: str, order: Column) -> DataFrame:
        top = v.orderBy(order, "cell").limit(10)
        return top.select(F.lit(kind).alias("kind"), F.row_number().over(W.orderBy(order, "cell")).cast("long").alias("place"), "cell", "variance")

    return V.union_all([ten("high", F.col("variance").desc()), ten("stable", F.col("variance").asc())])


def repair_layers(panel: DataFrame, columns: list[str], repaired: DataFrame, key: list[str], *, static: dict[str, str], most_missing: float = 80.0, alias: float = 0.98) -> DataFrame:
    """The key and the columns that are safe to use.

    Values of ``repaired`` (key and some of the columns) go before the panel's own.  Columns with more than
    ``most_missing`` percent of nulls and all but the first of each group of aliases are dropped.  A column of ``static``
    that never changes within a cell gets a copy by the name given there, which says that it tells places only.
    """
    new = [c for c in columns if c in repaired.columns]
    merged = panel.select(*key, *columns).join(repaired.select(*key, *[F.col(c).alias(f"{c}__new") for c in new]), key, "left")
    merged = session.cut(merged.withColumns({c: F.coalesce(f"{c}__new", c) for c in new}).drop(*[f"{c}__new" for c in new]))  # read by each of the steps below
    audit = {r.column: r for r in A.column_audit(merged, columns).collect()}  # a row for each column
    full = [c for c in columns if audit[c].missing_percent <= most_missing]
    keep = {r.column for r in stats.alias_clusters(stats.correlations(merged, stats.pair_list(full), ranks=False), full, alias).where("keep").collect()}
    spread = merged.groupBy("cell").agg(*[F.count_distinct(c).alias(c) for c in static]).agg(*[F.max(c).alias(c) for c in static]).first() if static else None
    proxies = [F.col(c).alias(name) for c, name in static.items() if spread[c] is not None and spread[c] <= 1]
    return merged.select(*key, *[c for c in full if c in keep], *proxies)


@query("""SELECT cell, week, indicator, round(value,6) AS value FROM (SELECT cell, week, unnest(['ndvi','no2','port_km','vessel','water','port_km_spatial_proxy']) AS indicator, unnest([CAST(ndvi AS DOUBLE), coalesce(no2, m), port_km, vessel, water, port_km]) AS value FROM feat LEFT JOIN (SELECT cell, quantile_cont(no2,0.5) AS m FROM panel GROUP BY cell) USING (cell)) WHERE value IS NOT NULL""")
def idx_repaired_layers(spark: SparkSession, d: str) -> DataFrame:
    """Missing NO2 repaired by the cell's median, an alias and a nearly empty column dropped, the static distance named as a proxy."""
    f = V.features(spark, d).withColumns({"vessel_twice": F.col("vessel") * 2, "rare": F.when(F.col("user_id") % 10 == 0, F.col("oil"))})
    half = V.panel(spark, d).groupBy("cell").agg(F.percentile("no2", F.lit(0.5)).alias("m"))
    repaired = f.join(half, "cell").select("cell", "week", F.coalesce("no2", "m").alias("no2"))
    safe = repair_layers(f, ["ndvi", "no2", "port_km", "rare", "vessel", "vessel_twice", "water"], repaired, ["cell", "week"], static={"port_km": "port_km_spatial_proxy", "vessel": "vessel_spatial_proxy"})
    return V.stacked(safe, [c for c in safe.columns if c not in ("cell", "week")]).withColumn("value", R(F.col("value")))
