"""Queries of reports: top lists, scores of whole layers, registries, run logs and bounded subsamples."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .. import session
from ..functions import keys
from ..operators import aggregates as A
from ..operators import indices as I
from ..operators import joins, order, stats, windows
from . import views as V
from .registry import query
from .statistics import _PAIR_SQL, PAIRS, _corr, _ranks

R = A.r6


@query(f"""SELECT method, a, b, r FROM (SELECT *, row_number() OVER (PARTITION BY method ORDER BY abs(r) DESC, a, b) AS rn FROM (SELECT a, b, unnest(['pearson','spearman']) AS method, unnest([p, s]) AS r FROM (SELECT a, b, {_corr("x", "y", 3)} AS p, {_corr("rx", "ry", 3)} AS s FROM r GROUP BY a, b)) WHERE r IS NOT NULL) WHERE rn<=5""", _ranks(_PAIR_SQL, "a, b", "r"))
def top_by_method(spark: SparkSession, d: str) -> DataFrame:
    """The head of each method's list, together with the method's name."""
    long = stats.correlations(V.panel(spark, d), PAIRS).select("a", "b", "pearson", "spearman").unpivot(["a", "b"], ["pearson", "spearman"], "method", "r").where("r is not null")
    place = F.row_number().over(W.partitionBy("method").orderBy(F.abs("r").desc(), "a", "b"))
    return long.withColumn("rn", place).where("rn <= 5").drop("rn")


_LAG3 = " UNION ALL ".join(f"SELECT cell, week, {k} AS lag, '{a}' AS a, '{b}' AS b, x, y FROM (SELECT cell, week, CAST({a} AS DOUBLE) AS x, CAST(lead({b},{k}) OVER (PARTITION BY cell ORDER BY week) AS DOUBLE) AS y FROM lp) WHERE x IS NOT NULL AND y IS NOT NULL" for k in range(3) for a, b in (("traffic", "urgent"), ("n", "traffic")))


_BEST = "arg_max(lag, struct_pack(s := abs(s), l := -lag)) AS lag, arg_max(s, struct_pack(s := abs(s), l := -lag)) AS s"


@query(f"""SELECT a, b, CAST(lag AS INT) AS lag, p.s AS r, consistency, lag_std, round(abs(p.s)*greatest(consistency,1)/100/(1+lag_std),5) AS stability FROM (SELECT a, b, {_BEST} FROM (SELECT a, b, lag, {_corr("rx", "ry", 10)} AS s FROM r GROUP BY a, b, lag) WHERE s IS NOT NULL GROUP BY a, b) p
JOIN (SELECT o.a, o.b, round(100.0*avg((o.lag=q.lag)::INT),5) AS consistency, round(stddev_pop(o.lag),5) AS lag_std FROM (SELECT cell, a, b, {_BEST} FROM (SELECT cell, a, b, lag, {_corr("rx", "ry", 10)} AS s FROM rc GROUP BY ALL) WHERE s IS NOT NULL GROUP BY cell, a, b) o
JOIN (SELECT a, b, {_BEST} FROM (SELECT a, b, lag, {_corr("rx", "ry", 10)} AS s FROM r GROUP BY a, b, lag) WHERE s IS NOT NULL GROUP BY a, b) q USING (a, b) GROUP BY o.a, o.b) USING (a, b) ORDER BY stability DESC, a, b LIMIT 20""", f'{_ranks(_LAG3, "a, b, lag", "r")}, {_ranks(_LAG3, "cell, a, b, lag", "rc")}')
def top_lag_signals(spark: SparkSession, d: str) -> DataFrame:
    """The best lag of each pair, the share of cells whose own best lag it is, how far theirs scatter, and the stability of it all; the top 20."""
    p, pairs = V.long_panel(spark, d), [("traffic", "urgent"), ("n", "traffic")]
    best = stats.best_lag(stats.lag_correlations(p, pairs, range(3)), ["a", "b"]).where("best is not null")
    own = stats.best_lag(stats.lag_correlations(p, pairs, range(3), group=("cell",)), ["cell", "a", "b"]).where("best is not null").select("a", "b", F.col("best_lag").alias("own"))
    agree = own.join(F.broadcast(best), ["a", "b"]).groupBy("a", "b").agg(F.round(100.0 * F.avg((F.col("own") == F.col("best_lag")).cast("int")), 5).alias("consistency"), F.round(F.stddev_pop("own"), 5).alias("lag_std"))
    stability = F.abs("best") * F.greatest("consistency", F.lit(1.0)) / 100 / (1 + F.col("lag_std"))
    return best.join(agree, ["a", "b"]).select("a", "b", F.col("best_lag").alias("lag"), F.col("best").alias("r"), "consistency", "lag_std", F.round(stability, 5).alias("stability")).orderBy(F.desc("stability"), "a", "b").limit(20)


@query("""SELECT t.cell, t.total, n.port, round(n.port_km,6) AS port_km FROM (SELECT cell, CAST(sum(n_obs) AS BIGINT) AS total FROM weekly GROUP BY cell ORDER BY total DESC, cell LIMIT 20) t LEFT JOIN port_near n USING (cell)""")
def top_zones_enriched(spark: SparkSession, d: str) -> DataFrame:
    w = V.weekly(spark, d)
    top = w.groupBy("cell").agg(F.sum("n_obs").alias("total")).orderBy(F.desc("total"), "cell").limit(20)
    near = joins.nearest_port(w.select("cell", "lat", "lon").distinct(), V.ports(spark, d)).select("cell", "port", R(F.col("distance_km")).alias("port_km"))
    return joins.enrich(top, [(near, ["cell"])])


@query("""SELECT cell, week, indicator, value FROM stack WHERE value>=100 ORDER BY week, cell, indicator""")
def top_total_order_at_sink(spark: SparkSession, d: str) -> DataFrame:
    return V.stacked(V.panel(spark, d)).where("value >= 100").orderBy("week", "cell", "indicator")


_CELL_LAGS = " UNION ALL ".join(f"SELECT cell, {k} AS lag, vessel AS x, lead(no2,{k}) OVER (PARTITION BY cell ORDER BY week) AS y FROM feat" for k in (1, 2, 3))
_SCALED = lambda c: f"({c}-min({c}) OVER ())/nullif(max({c}) OVER ()-min({c}) OVER (),0) AS {c}"
_IMPACT = {"c": 0.4, "l": 0.2, "e": 0.2, "z": 0.2}


@query(f"""SELECT cell, round(({"+".join(f"{w}*coalesce({c},0)" for c, w in _IMPACT.items())})/nullif({"+".join(f"CASE WHEN {c} IS NOT NULL THEN {w} ELSE 0 END" for c, w in _IMPACT.items())},0),6) AS score FROM (SELECT cell, {", ".join(_SCALED(c) for c in _IMPACT)} FROM (SELECT cell, CASE WHEN count(*) FILTER (vessel IS NOT NULL AND no2 IS NOT NULL)>=3 AND isfinite(corr(vessel,no2)) THEN round(abs(corr(vessel,no2)),6) END AS c, round(max(1/(1+port_km)),9) AS e, round(stddev_pop(vessel)/nullif(avg(vessel),0),9) AS z FROM feat GROUP BY cell)
LEFT JOIN (SELECT cell, max(abs(p)) AS l FROM (SELECT cell, lag, {_corr("x", "y", 3)} AS p FROM ({_CELL_LAGS}) WHERE x IS NOT NULL AND y IS NOT NULL GROUP BY cell, lag) GROUP BY cell) USING (cell))""")
def idx_impact_score(spark: SparkSession, d: str) -> DataFrame:
    """Association, best lagged association over 1 to 3 weeks, exposure and variability of a cell, each scaled, weights over the parts it has."""
    f = V.features(spark, d)
    both = F.count(F.when(F.col("vessel").isNotNull() & F.col("no2").isNotNull(), 1))
    c = F.when(both >= 3, R(F.abs(windows.correlation(F.col("vessel"), F.col("no2")))))
    parts = f.groupBy("cell").agg(c.alias("c"), F.round(F.max(keys.proximity(F.col("port_km"))), 9).alias("e"), F.round(F.try_divide(F.stddev_pop("vessel"), F.avg("vessel")), 9).alias("z"))
    lagged = stats.lag_correlations(f, [("vessel", "no2")], range(1, 4), group=("cell",), least=3).groupBy("cell").agg(F.max(F.abs("pearson")).alias("l"))
    m = I.with_moments(parts.join(lagged, "cell", "left"), list(_IMPACT))
    return m.select("cell", R(I.weighted_mean([(I.min_max(c), w) for c, w in _IMPACT.items()])).alias("score"))


@query(f"""SELECT round(0.5*(SELECT count(*) FROM weekly)/(SELECT count(*) FROM panel)+0.5*avg(abs(s)),5) AS score, 0.5*(SELECT count(*) FROM weekly)/(SELECT count(*) FROM panel)+0.5*avg(abs(s))>=0.55 AS ready FROM (SELECT a, b, {_corr("rx", "ry", 3)} AS s FROM r GROUP BY a, b)""", _ranks(_PAIR_SQL, "a, b", "r"))
def agg_integrity_gate(spark: SparkSession, d: str) -> DataFrame:
    """Coverage and agreement of the layers as one score, with a gate."""
    p = V.panel(spark, d)
    coverage = p.agg((F.sum((F.col("n_obs") > 0).cast("long")) / F.count("*")).alias("cov"))
    rho = stats.correlations(p, PAIRS).agg(F.avg(F.abs("spearman")).alias("rho"))
    score = 0.5 * F.col("cov") + 0.5 * F.col("rho")
    return coverage.crossJoin(rho).select(F.round(score, 5).alias("score"), (score >= 0.55).alias("ready"))


@query("""SELECT (SELECT count(DISTINCT week) FROM weekly) AS weeks, (SELECT count(*) FROM panel)-(SELECT count(*) FROM weekly) AS missing_keys, round(100.0*(SELECT count(*) FROM weekly)/(SELECT count(*) FROM panel),6) AS completeness""")
def agg_cross_source_summary(spark: SparkSession, d: str) -> DataFrame:
    p = V.panel(spark, d)
    there = F.sum((F.col("n_obs") > 0).cast("long"))
    return p.agg(F.count_distinct(F.when(F.col("n_obs") > 0, F.col("week"))).alias("weeks"), (F.count("*") - there).alias("missing_keys"), R(100.0 * there / F.count("*")).alias("completeness"))


@query("""SELECT f.feature, f.category, count(s.value) AS n, round(avg(s.value),6) AS mean FROM (SELECT unnest(['traffic','nitrogen','greenness','sludge']) AS feature, unnest(['maritime','atmospheric','land','marine']) AS category, unnest(['vessel','no2','ndvi',NULL]) AS col) f LEFT JOIN stack s ON s.indicator=f.col GROUP BY ALL""")
def agg_feature_registry(spark: SparkSession, d: str) -> DataFrame:
    """A catalogue of features resolved to columns that may go by other names or be absent."""
    p = V.panel(spark, d)
    catalogue = [("traffic", "maritime", ["vessel_density", "vessel"]), ("nitrogen", "atmospheric", ["NO2"]), ("greenness", "land", ["ndvi"]), ("sludge", "marine", ["sludge"])]
    have = {c.lower(): c for c in p.columns}
    resolved = [(f, c, next((have[n.lower()] for n in names if n.lower() in have), None)) for f, c, names in catalogue]
    r = spark.createDataFrame(resolved, "feature string, category string, col string")
    return F.broadcast(r).join(V.stacked(p), F.col("indicator") == F.col("col"), "left").groupBy("feature", "category").agg(F.count("value").alias("n"), R(F.avg("value")).alias("mean"))


@query("""SELECT event_type AS dataset, CAST(date_trunc('week', ts) AS TIMESTAMP) AS run, count(*) AS records, count(*) FILTER (value IS NULL) AS failed, CASE WHEN count(*)>=5 THEN 'ok' ELSE 'short' END AS status FROM events GROUP BY ALL""", raw=True)
def src_run_manifest(spark: SparkSession, d: str) -> DataFrame:
    """A row for each run and dataset: records, failures and status."""
    e = V.table(spark, d, "events")
    return e.groupBy(F.col("event_type").alias("dataset"), keys.week_start(F.col("ts")).cast("timestamp").alias("run")).agg(F.count("*").alias("records"), F.sum(F.col("value").isNull().cast("long")).alias("failed"), F.when(F.count("*") >= 5, "ok").otherwise("short").alias("status"))


@query()
def prj_repeatable_sample(spark: SparkSession, d: str) -> DataFrame:
    """A bounded subsample by hash of the keys, the same on every run (a sampling operator; the hash has no SQL twin)."""
    return V.panel(spark, d).select("cell", "week", "vessel").orderBy(F.xxhash64("cell", "week", F.lit(42)), "cell", "week").limit(1500)


@query("""SELECT indicator, shoreward, count(*) AS n, round(avg(pct),6) AS mean_rank, round(var_samp(value),5) AS variance FROM (SELECT s.indicator, f.shoreward, s.value, (rank() OVER (PARTITION BY s.indicator ORDER BY s.value)+(count(*) OVER (PARTITION BY s.indicator, s.value)-1)/2.0)/count(*) OVER (PARTITION BY s.indicator) AS pct FROM stack s JOIN (SELECT cell, week, shoreward FROM feat) f ON f.cell=s.cell AND f.week=s.week) GROUP BY indicator, shoreward""")
def stat_participation_by_regime(spark: SparkSession, d: str) -> DataFrame:
    """Percent ranks within each indicator, summarised by wind regime."""
    s = V.stacked(V.features(spark, d), keep=("cell", "week", "shoreward"))
    s = order.ranked(session.cut(s), ["indicator"], "value", "pct", percent=True)
    return s.groupBy("indicator", "shoreward").agg(F.count("*").alias("n"), R(F.avg("pct")).alias("mean_rank"), F.round(F.var_samp("value"), 5).alias("variance"))


@query("""SELECT month(week)::INT AS month, count(*) FILTER (shoreward=1) AS shoreward, count(*) AS n, round(100.0*avg(shoreward),6) AS percent FROM feat GROUP BY 1""")
def idx_regime_calendar(spark: SparkSession, d: str) -> DataFrame:
    """How often each month has wind towards the shore."""
    f = V.features(spark, d)
    return f.groupBy(F.month("week").alias("month")).agg(F.sum((F.col("shoreward") == 1).cast("long")).alias("shoreward"), F.count("*").alias("n"), R(100.0 * F.avg("shoreward")).alias("percent"))
