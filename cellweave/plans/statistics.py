"""Queries of correlations, tests, indices and anomaly flags."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import session
from ..functions import keys
from ..operators import aggregates as A
from ..operators import indices as I
from ..operators import joins, order, stats, windows
from . import views as V
from .registry import query

R = A.r6
PAIRS = stats.pair_list(V.VALUES)
_PAIR_SQL = " UNION ALL ".join(f"SELECT cell, week, '{a}' AS a, '{b}' AS b, CAST({a} AS DOUBLE) AS x, CAST({b} AS DOUBLE) AS y FROM panel WHERE {a} IS NOT NULL AND {b} IS NOT NULL" for a, b in PAIRS)


def _ranks(source: str, by: str, name: str) -> str:
    """A common table expression with average-tie ranks rx and ry of x and y."""
    p = f"PARTITION BY {by}"
    one = lambda c: f"rank() OVER ({p} ORDER BY {c})+(count(*) OVER ({p}, {c})-1)/2.0"
    return f"{name} AS (SELECT *, {one('x')} AS rx, {one('y')} AS ry FROM ({source}))"


def _corr(x: str, y: str, least: int, n: str = "count(*)") -> str:
    return f"round(CASE WHEN {n}>={least} AND isfinite(corr({x},{y})) THEN corr({x},{y}) END,6)"


@query(f"""SELECT a, b, count(*) AS n, {_corr("x", "y", 3)} AS pearson, {_corr("rx", "ry", 3)} AS spearman FROM r GROUP BY a, b""", _ranks(_PAIR_SQL, "a, b", "r"))
def stat_correlation_matrix(spark: SparkSession, d: str) -> DataFrame:
    """Pearson and Spearman for all pairs of indicators, each on the rows that have both."""
    return stats.correlations(V.panel(spark, d), PAIRS)


@query(f"""SELECT a, b, week, count(*) AS n, {_corr("x", "y", 3)} AS pearson, {_corr("rx", "ry", 3)} AS spearman FROM r GROUP BY a, b, week""", _ranks(_PAIR_SQL, "a, b, week", "r"))
def stat_weekly_correlations(spark: SparkSession, d: str) -> DataFrame:
    return stats.correlations(V.panel(spark, d), PAIRS, by=("week",))


@query(f"""SELECT a, b, weeks, std, positive_share, CASE WHEN weeks>=3 AND std<0.3 AND (positive_share>=0.8 OR positive_share<=0.2) THEN 'informative' WHEN weeks>=3 THEN 'weak' ELSE 'spurious' END AS label FROM (SELECT a, b, count(s) AS weeks, round(stddev_pop(s),5) AS std, round(avg((s>0)::INT),5) AS positive_share FROM (SELECT a, b, week, {_corr("rx", "ry", 3)} AS s FROM r GROUP BY a, b, week) GROUP BY a, b)""", _ranks(_PAIR_SQL, "a, b, week", "r"))
def stat_pair_stability(spark: SparkSession, d: str) -> DataFrame:
    """How steady the weekly rank correlation of each pair is."""
    w = stats.correlations(V.panel(spark, d), PAIRS, by=("week",))
    s = w.groupBy("a", "b").agg(F.count("spearman").alias("weeks"), F.round(F.stddev_pop("spearman"), 5).alias("std"), F.round(F.avg((F.col("spearman") > 0).cast("int")), 5).alias("positive_share"))
    steady = (F.col("weeks") >= 3) & (F.col("std") < 0.3) & ((F.col("positive_share") >= 0.8) | (F.col("positive_share") <= 0.2))
    return s.withColumn("label", F.when(steady, "informative").when(F.col("weeks") >= 3, "weak").otherwise("spurious"))


@query("""SELECT indicator, round(var_samp(value),6) AS variance FROM stack GROUP BY indicator HAVING count(*)>1 AND var_samp(value)>0""")
def stat_feature_selection(spark: SparkSession, d: str) -> DataFrame:
    """Columns that are numeric, not all null and not constant."""
    p = V.panel(spark, d)
    numeric = [f.name for f in p.schema if f.dataType.simpleString() in ("double", "float") and f.name not in ("lat", "lon")]
    return V.stacked(p, numeric).groupBy("indicator").agg(F.var_samp("value").alias("v")).where("v > 0").select("indicator", R(F.col("v")).alias("variance"))


CATEGORY = {"vessel": "maritime", "no2": "atmospheric", "ndvi": "land", "oil": "marine", "water": "marine"}
_CAT = lambda c: "CASE " + " ".join(f"WHEN {c}='{k}' THEN '{v}'" for k, v in CATEGORY.items()) + " END"


@query(f"""SELECT a, b, category_a, category_b, pearson, CASE WHEN abs(pearson)>=0.7 THEN 'strong' WHEN abs(pearson)>=0.4 THEN 'moderate' WHEN abs(pearson)>=0.2 THEN 'weak' WHEN pearson IS NOT NULL THEN 'negligible' ELSE 'insufficient' END AS strength FROM (SELECT a, b, {_CAT("a")} AS category_a, {_CAT("b")} AS category_b, {_corr("x", "y", 3)} AS pearson FROM r GROUP BY a, b) WHERE category_a<>category_b ORDER BY abs(pearson) DESC NULLS LAST, a, b LIMIT 10""", _ranks(_PAIR_SQL, "a, b", "r"))
def stat_cross_category_top(spark: SparkSession, d: str) -> DataFrame:
    """The ten strongest pairs across categories."""
    c = stats.correlations(V.panel(spark, d), PAIRS)
    of = lambda x: F.create_map(*[F.lit(y) for kv in CATEGORY.items() for y in kv])[F.col(x)]
    out = c.select("a", "b", of("a").alias("category_a"), of("b").alias("category_b"), "pearson", keys.strength(F.col("pearson")).alias("strength"))
    return out.where("category_a <> category_b").orderBy(F.abs("pearson").desc_nulls_last(), "a", "b").limit(10)


@query(f"""SELECT pair, method, r FROM (SELECT *, row_number() OVER (PARTITION BY pair ORDER BY abs(r) DESC, method) AS rn FROM (SELECT a||'|'||b AS pair, unnest(['pearson','spearman']) AS method, unnest([p, s]) AS r FROM (SELECT least(a,b) AS a, greatest(a,b) AS b, {_corr("x", "y", 3)} AS p, {_corr("rx", "ry", 3)} AS s FROM r GROUP BY 1, 2)) WHERE r IS NOT NULL) WHERE rn=1 ORDER BY abs(r) DESC, pair LIMIT 20""", _ranks(_PAIR_SQL, "a, b", "r"))
def top_correlations_by_pair(spark: SparkSession, d: str) -> DataFrame:
    """The better method of each unordered pair, strongest first."""
    c = stats.correlations(V.panel(spark, d), PAIRS).withColumn("pair", F.array_join(F.array_sort(F.array("a", "b")), "|"))
    long = c.select("pair", "pearson", "spearman").unpivot(["pair"], ["pearson", "spearman"], "method", "r").where("r is not null")
    return joins.latest(long, ["pair"], [F.abs("r").desc(), F.col("method")]).orderBy(F.abs("r").desc(), "pair").limit(20)


_LAGS = " UNION ALL ".join(f"SELECT cell, week, {k} AS lag, 'traffic' AS a, 'urgent' AS b, x, y FROM (SELECT cell, week, traffic AS x, CAST(lead(urgent,{k}) OVER (PARTITION BY cell ORDER BY week) AS DOUBLE) AS y FROM lp) WHERE y IS NOT NULL" for k in range(4))


@query(f"""SELECT a, b, CAST(lag AS INT) AS lag, count(*) AS n, {_corr("x", "y", 10)} AS pearson, {_corr("rx", "ry", 10)} AS spearman FROM r GROUP BY a, b, lag""", _ranks(_LAGS, "lag", "r"))
def stat_lag_curve(spark: SparkSession, d: str) -> DataFrame:
    """Pooled correlation of traffic with urgent orders 0 to 3 rows later."""
    return stats.lag_correlations(V.long_panel(spark, d), [("traffic", "urgent")], range(4))


@query(f"""SELECT cell, CAST(arg_max(lag, struct_pack(s := abs(s), l := -lag)) AS INT) AS best_lag, arg_max(s, struct_pack(s := abs(s), l := -lag)) AS best FROM (SELECT cell, lag, {_corr("rx", "ry", 10)} AS s FROM r GROUP BY cell, lag) WHERE s IS NOT NULL GROUP BY cell""", _ranks(_LAGS, "cell, lag", "r"))
def stat_best_lag_by_cell(spark: SparkSession, d: str) -> DataFrame:
    curve = stats.lag_correlations(V.long_panel(spark, d), [("traffic", "urgent")], range(4), group=("cell",))
    return stats.best_lag(curve, ["cell"]).where("best is not null")


@query(f"""SELECT round(avg(best),5) AS mean_best, CAST(mode(best_lag) AS INT) AS n_lag, round(stddev_pop(best_lag),5) AS lag_std, round(100.0*max(c)/sum(c) ,5) AS consistency FROM (SELECT best_lag, avg(best) AS best, count(*) AS c FROM (SELECT cell, arg_max(lag, struct_pack(s := abs(s), l := -lag)) AS best_lag, arg_max(s, struct_pack(s := abs(s), l := -lag)) AS best FROM (SELECT cell, lag, {_corr("rx", "ry", 10)} AS s FROM r GROUP BY cell, lag) WHERE s IS NOT NULL GROUP BY cell) GROUP BY best_lag)""".replace("CAST(mode(best_lag) AS INT) AS n_lag, ", ""), _ranks(_LAGS, "cell, lag", "r"))
def stat_lag_consistency(spark: SparkSession, d: str) -> DataFrame:
    """How far the cells agree on their best lag."""
    curve = stats.lag_correlations(V.long_panel(spark, d), [("traffic", "urgent")], range(4), group=("cell",))
    by_lag = stats.best_lag(curve, ["cell"]).where("best is not null").groupBy("best_lag").agg(F.avg("best").alias("best"), F.count("*").alias("c"))
    return by_lag.agg(F.round(F.avg("best"), 5).alias("mean_best"), F.round(F.stddev_pop("best_lag"), 5).alias("lag_std"), F.round(100.0 * F.max("c") / F.sum("c"), 5).alias("consistency"))


@query(f"""SELECT lag, n, spearman, round(spearman*sqrt((n-2)/(1-spearman*spearman)),3) AS t FROM (SELECT CAST(lag AS INT) AS lag, count(*) AS n, {_corr("rx", "ry", 10)} AS spearman FROM r GROUP BY lag)""",
       _ranks(" UNION ALL ".join(f"SELECT cell, week, {k} AS lag, x, y FROM (SELECT cell, week, traffic AS x, lead(traffic,{k}) OVER (PARTITION BY cell ORDER BY week) AS y FROM lp) WHERE y IS NOT NULL" for k in (1, 2, 3)), "lag", "r"))
def stat_autocorrelation(spark: SparkSession, d: str) -> DataFrame:
    c = stats.lag_correlations(V.long_panel(spark, d), [("traffic", "traffic")], range(1, 4))
    return c.select("lag", "n", "spearman", F.round(stats.correlation_t(F.col("spearman"), F.col("n")), 3).alias("t"))


_SIDES = "sided AS (SELECT indicator, value, shoreward=1 AS s FROM stack JOIN (SELECT cell, week, shoreward FROM feat) USING (cell, week))"
_TWO = """two AS (SELECT indicator, count(*) FILTER (s) AS n1, count(*) FILTER (NOT s) AS n0, avg(value) FILTER (s) AS m1, avg(value) FILTER (NOT s) AS m0, var_samp(value) FILTER (s) AS v1, var_samp(value) FILTER (NOT s) AS v0,
sum(r) FILTER (s) AS rs, sum(t*t-1) AS ties FROM (SELECT *, rank() OVER (PARTITION BY indicator ORDER BY value)+(count(*) OVER (PARTITION BY indicator, value)-1)/2.0 AS r, CAST(count(*) OVER (PARTITION BY indicator, value) AS DOUBLE) AS t FROM sided) GROUP BY indicator)"""


@query("""SELECT indicator, n1, n0, round(m1,6) AS m1, round(m0,6) AS m0, round(m1-m0,6) AS diff, round((m1-m0)/sqrt(((n1-1)*v1+(n0-1)*v0)/(n1+n0-2)),6) AS cohens_d, round((m1-m0)/sqrt(v1/n1+v0/n0),6) AS t,
round(pow(v1/n1+v0/n0,2)/(pow(v1/n1,2)/(n1-1)+pow(v0/n0,2)/(n0-1)),6) AS df, round(rs-n1*(n1+1)/2,6) AS u, round(greatest(abs(rs-n1*(n1+1)/2-n1*n0/2.0)-0.5,0)/sqrt(n1*n0/12.0*((n1+n0+1)-ties/((n1+n0)*(n1+n0-1)))),6) AS mw_z, round(2*(rs-n1*(n1+1)/2)/(n1*n0)-1,6) AS cliffs_delta FROM two""", f"{_SIDES}, {_TWO}")
def stat_two_sample(spark: SparkSession, d: str) -> DataFrame:
    """Shoreward against other wind for every indicator: means, Cohen's d, Welch's t, Mann-Whitney U, Cliff's delta."""
    s = V.stacked(V.features(spark, d), keep=("cell", "week", "shoreward"))
    t = stats.two_sample(s, ["indicator"], F.col("shoreward") == 1)
    return t.select("indicator", "n1", "n0", "m1", "m0", "diff", "cohens_d", "t", "df", "u", "mw_z", "cliffs_delta")


@query()
def stat_two_sample_p_values(spark: SparkSession, d: str) -> DataFrame:
    """The same with p-values (incomplete beta and error function on the result rows), which SQL has no function for."""
    s = V.stacked(V.features(spark, d), keep=("cell", "week", "shoreward"))
    return stats.two_sample(s, ["indicator"], F.col("shoreward") == 1).select("indicator", "welch_p", "mw_p", "median1", "median0", "percent")


_DEC = "hl AS (SELECT p.*, CASE WHEN lv>=q[2] THEN TRUE WHEN lv<=q[1] THEN FALSE END AS s FROM (SELECT *, CASE WHEN vessel IS NOT NULL THEN ln(1+greatest(vessel,0)) END AS lv FROM panel) p, (SELECT quantile_cont(CASE WHEN vessel IS NOT NULL THEN ln(1+greatest(vessel,0)) END,[0.1,0.9]) AS q FROM panel))"


@query("""SELECT count(*) FILTER (s) AS n1, count(*) FILTER (NOT s) AS n0, round(avg(no2) FILTER (s),6) AS m1, round(avg(no2) FILTER (NOT s),6) AS m0, round(quantile_cont(no2,0.5) FILTER (s),6) AS median1, round(quantile_cont(no2,0.5) FILTER (NOT s),6) AS median0 FROM hl WHERE s IS NOT NULL AND no2 IS NOT NULL""", _DEC)
def stat_high_low_decile(spark: SparkSession, d: str) -> DataFrame:
    """Rows in the top tenth of log traffic against the lowest tenth."""
    p = V.panel(spark, d).withColumn("lv", keys.log1p_guarded(F.col("vessel")))
    q = order.quantiles(p, [], {"low": ("lv", 0.1), "high": ("lv", 0.9)})
    side = F.when(F.col("lv") >= F.col("high"), True).when(F.col("lv") <= F.col("low"), False)
    t = stats.two_sample(p.crossJoin(F.broadcast(q)), [], side, "no2")
    return t.select("n1", "n0", "m1", "m0", "median1", "median0")


@query("""SELECT indicator, count(*) AS groups, CAST(sum(n) AS BIGINT) AS n, round(((sum(n*m*m)-sum(n)*pow(sum(n*m)/sum(n),2))/(count(*)-1))/(sum(n*v)/(sum(n)-count(*))),4) AS f FROM (SELECT indicator, floor(port_km/40) AS b, count(*) AS n, avg(value) AS m, var_pop(value) AS v FROM stack JOIN port_near USING (cell) GROUP BY ALL HAVING count(*)>1) GROUP BY indicator HAVING count(*)>1""")
def stat_anova_over_bands(spark: SparkSession, d: str) -> DataFrame:
    s = V.stacked(V.features(spark, d), keep=("cell", "week", "port_km")).withColumn("b", F.floor(F.col("port_km") / 40))
    return stats.anova(s, ["indicator"], "b").select("indicator", "groups", "n", "f").where("f is not null")


@query("""SELECT indicator, count(*) AS n, round(count(*)/6.0*(pow(sk,2)+pow(ku,2)/4),4) AS jb FROM (SELECT indicator, (sum(pow(value-mu,3))/count(*))/pow(sqrt(sum(pow(value-mu,2))/count(*)),3) AS sk, (sum(pow(value-mu,4))/count(*))/pow(sum(pow(value-mu,2))/count(*),2)-3 AS ku, count(*) AS c FROM stack JOIN (SELECT indicator, avg(value) AS mu FROM stack GROUP BY indicator) USING (indicator) GROUP BY indicator) GROUP BY indicator, sk, ku, c""".replace("count(*) AS n, round(count(*)/6.0", "c AS n, round(c/6.0"))
def stat_normality(spark: SparkSession, d: str) -> DataFrame:
    return stats.jarque_bera(V.stacked(V.panel(spark, d))).select("indicator", "n", "jb")


@query()
def stat_bootstrap_interval(spark: SparkSession, d: str) -> DataFrame:
    """Poisson bootstrap of indicator means by distance band; resampling has no SQL counterpart."""
    s = V.stacked(V.features(spark, d), keep=("cell", "week", "port_km")).withColumn("band", keys.distance_band(F.col("port_km"), "decades"))
    return stats.bootstrap_mean(s, ["band", "indicator"], "value", draws=500, key=("cell", "week", "indicator"))


@query("""SELECT tercile, count(*) AS n, sum((traffic>=q[4])::INT)::BIGINT AS lanes FROM (SELECT traffic, q, CAST((traffic>q[1])::INT+(traffic>q[2])::INT AS INT) AS tercile FROM lp, (SELECT quantile_cont(traffic,[1/3.0,2/3.0,0.75,0.9]) AS q FROM lp)) GROUP BY tercile""")
def stat_terciles_and_lanes(spark: SparkSession, d: str) -> DataFrame:
    """Traffic terciles by quantile edges, so that ties stay together, and the top-tenth lane flag."""
    p = A.quantile_bins(V.long_panel(spark, d), "traffic", 3, "tercile")
    q = order.quantiles(p, [], {"q": ("traffic", 0.9)})
    return p.crossJoin(F.broadcast(q)).groupBy("tercile").agg(F.count("*").alias("n"), F.sum((F.col("traffic") >= F.col("q")).cast("long")).alias("lanes"))


@query("""SELECT CASE WHEN month(week) IN (11,12,1,2,3) THEN 'winter' ELSE 'non_winter' END AS season, cell, round(avg(traffic),6) AS mean, round(stddev_samp(traffic),6) AS std, count(*) AS n FROM lp GROUP BY ALL""")
def stat_seasonal_split(spark: SparkSession, d: str) -> DataFrame:
    p = V.long_panel(spark, d).withColumn("season", keys.season(F.col("week")))
    return p.groupBy("season", "cell").agg(R(F.avg("traffic")).alias("mean"), R(F.stddev_samp("traffic")).alias("std"), F.count("*").alias("n"))


@query(f"""SELECT round(min(abs(s)),6) AS least, count(*) AS pairs, min(abs(s))>0.5 AS combinable FROM (SELECT a, b, {_corr("rx", "ry", 3)} AS s FROM r WHERE a IN ('oil','water','no2') AND b IN ('oil','water','no2') GROUP BY a, b)""", _ranks(_PAIR_SQL, "a, b", "r"))
def stat_group_coherence(spark: SparkSession, d: str) -> DataFrame:
    """Whether all pairs of a group of indicators go together, so that a common z would mean something."""
    group = ["no2", "oil", "water"]
    c = stats.correlations(V.panel(spark, d), [p for p in PAIRS if set(p) <= set(group)])
    return c.agg(R(F.min(F.abs("spearman"))).alias("least"), F.count("*").alias("pairs"), (F.min(F.abs("spearman")) > 0.5).alias("combinable"))


@query(f"""SELECT a, b, spearman FROM (SELECT a, b, {_corr("rx", "ry", 3)} AS spearman FROM r GROUP BY a, b) WHERE abs(spearman)>=0.12""",
       _ranks(" UNION ALL ".join(f"SELECT cell, week, '{a}' AS a, '{b}' AS b, coalesce({a},0.5) AS x, coalesce({b},0.5) AS y FROM panel" for a, b in PAIRS), "a, b", "r"))
def stat_network_edges(spark: SparkSession, d: str) -> DataFrame:
    """Edges of the correlation network, nulls at 0.5."""
    p = V.panel(spark, d).fillna(0.5, V.VALUES)
    return stats.correlations(p, PAIRS).select("a", "b", "spearman").where("abs(spearman) >= 0.12")


@query("""SELECT 'n' AS "column", 'n' AS cluster, TRUE AS keep UNION ALL SELECT 'n_twice', 'n', FALSE UNION ALL SELECT 'traffic', CASE WHEN (SELECT abs(corr(traffic,n)) FROM lp)>=0.98 THEN 'n' ELSE 'traffic' END, (SELECT abs(corr(traffic,n)) FROM lp)<0.98 UNION ALL SELECT 'urgent', CASE WHEN (SELECT abs(corr(urgent,n)) FROM lp)>=0.98 THEN 'n' ELSE 'urgent' END, (SELECT abs(corr(urgent,n)) FROM lp)<0.98""")
def stat_alias_clusters(spark: SparkSession, d: str) -> DataFrame:
    """Columns that say the same, one kept of each cluster."""
    p = V.long_panel(spark, d).withColumn("n_twice", F.col("n") * 2 + 1)
    columns = ["traffic", "n", "n_twice", "urgent"]
    return stats.alias_clusters(stats.correlations(p, stats.pair_list(columns), ranks=False), columns)


@query("""SELECT port, round(CASE WHEN isfinite(regr_slope(m,s)) THEN regr_slope(m,s) END,6) AS slope, round(CASE WHEN isfinite(regr_slope(m,s)) THEN regr_r2(m,s) END,6) AS r2 FROM (SELECT port, floor(port_km/20)*20 AS s, avg(no2) AS m FROM feat GROUP BY ALL) GROUP BY port HAVING count(m)>=3""")
def stat_decay_slope(spark: SparkSession, d: str) -> DataFrame:
    m = V.features(spark, d).groupBy("port", (F.floor(F.col("port_km") / 20) * 20).alias("s")).agg(F.avg("no2").alias("m"))
    return m.groupBy("port").agg(R(F.regr_slope("m", "s")).alias("slope"), R(F.regr_r2("m", "s")).alias("r2"), F.count("m").alias("_n")).where("_n >= 3").drop("_n")


@query("""SELECT round(corr(a,b),6) AS pearson, round(avg(abs(a-b)),6) AS mean_difference, count(*) AS n FROM (SELECT vessel/100 AS a, (0.5*vessel+0.5*no2)/100 AS b FROM panel WHERE vessel IS NOT NULL AND no2 IS NOT NULL)""")
def stat_index_sensitivity(spark: SparkSession, d: str) -> DataFrame:
    """An index against an alternative one."""
    p = V.panel(spark, d).select((F.col("vessel") / 100).alias("a"), ((0.5 * F.col("vessel") + 0.5 * F.col("no2")) / 100).alias("b")).where("a is not null and b is not null")
    return p.agg(R(windows.correlation(F.col("a"), F.col("b"))).alias("pearson"), R(F.avg(F.abs(F.col("a") - F.col("b")))).alias("mean_difference"), F.count("*").alias("n"))


@query("""SELECT round(regr_r2(y,traffic),6) AS r2, round(avg((traffic=y)::INT),6) AS equal_share, round(median(abs(traffic-y)),6) AS median_gap, max(abs(traffic-y)) AS max_gap FROM (SELECT traffic, lead(traffic) OVER (PARTITION BY cell ORDER BY week) AS y FROM lp) WHERE y IS NOT NULL""".replace("max(abs(traffic-y)) AS max_gap", "round(max(abs(traffic-y)),6) AS max_gap"))
def stat_leakage_audit(spark: SparkSession, d: str) -> DataFrame:
    """How much a feature gives away of the target: R2, share of equal values, gaps."""
    p = windows.next_valid(V.long_panel(spark, d), "traffic").where("traffic_next is not null")
    gap = F.abs(F.col("traffic") - F.col("traffic_next"))
    return p.agg(R(F.regr_r2("traffic_next", "traffic")).alias("r2"), R(F.avg((F.col("traffic") == F.col("traffic_next")).cast("int"))).alias("equal_share"), R(F.max(gap)).alias("max_gap")).crossJoin(F.broadcast(order.quantiles(p, [], {"median_gap": (gap, 0.5)}).withColumn("median_gap", R(F.col("median_gap")))))


_PCT = lambda c, by: f"(rank() OVER (PARTITION BY {by}, {c} IS NULL ORDER BY {c})+(count(*) OVER (PARTITION BY {by}, {c})-1)/2.0)/nullif(count({c}) OVER (PARTITION BY {by}),0)"


@query(f"""SELECT cell, week, round(m*a,6) AS stress FROM (SELECT cell, week, CASE WHEN vessel IS NOT NULL THEN {_PCT("vessel", "week")} END AS m, CASE WHEN no2 IS NOT NULL THEN {_PCT("no2", "week")} END AS a FROM panel)""")
def idx_rank_product(spark: SparkSession, d: str) -> DataFrame:
    """Product of the weekly percent ranks of traffic and NO2."""
    p = session.cut(V.panel(spark, d).select("cell", "week", "vessel", "no2"))
    for c in ("vessel", "no2"):
        p = p.join(order.ranked(p.select("cell", "week", c).where(F.col(c).isNotNull()), ["week"], c, f"{c}_pct", percent=True).drop(c), ["cell", "week"], "left")
    return p.select("cell", "week", R(F.col("vessel_pct") * F.col("no2_pct")).alias("stress"))


_WZ = lambda c: f"CASE WHEN stddev_pop({c}) OVER w<1e-12 THEN 0*{c} ELSE ({c}-avg({c}) OVER w)/stddev_pop({c}) OVER w END"


@query(f"""SELECT cell, week, round(0.35*({_WZ("vessel")})+0.35*({_WZ("no2")})+0.15*({_WZ("ndvi")})+0.15*({_WZ("oil")}),6) AS stress FROM panel WINDOW w AS (PARTITION BY week)""")
def idx_weighted_stress(spark: SparkSession, d: str) -> DataFrame:
    """Fixed weights over weekly z-scores; null if any part is."""
    weights = {"vessel": 0.35, "no2": 0.35, "ndvi": 0.15, "oil": 0.15}
    total = sum((w * windows.group_z(F.col(c), ["week"]) for c, w in weights.items()), F.lit(0.0))
    return V.panel(spark, d).select("cell", "week", R(total).alias("stress"))


_MOM = "mo AS (SELECT " + ", ".join(f"avg({c}) AS m_{c}, stddev_pop({c}) AS s_{c}, min({c}) AS lo_{c}, max({c}) AS hi_{c}, quantile_cont({c},[0.05,0.25,0.5,0.75,0.95]) AS q_{c}" for c in V.VALUES) + " FROM panel)"
_Z = lambda c: f"({c}-m_{c})/s_{c}"
_N = lambda parts: "(" + "+".join(f"({p} IS NOT NULL)::INT" for p in parts) + ")"


@query(f"""SELECT cell, week, round(({"+".join(f"coalesce({_Z(c)},0)" for c in V.VALUES)})/nullif({_N([_Z(c) for c in V.VALUES])},0),6) AS stress FROM panel, mo""", _MOM)
def idx_mean_z(spark: SparkSession, d: str) -> DataFrame:
    """Mean of the global z-scores that a row has."""
    p = I.with_moments(V.panel(spark, d), V.VALUES)
    return p.select("cell", "week", R(I.mean_of([I.z(c) for c in V.VALUES])).alias("stress"))


_WEIGHTS = {"vessel": 0.35, "no2": 0.25, "oil": 0.25, "water": 0.15}


@query(f"""SELECT cell, week, round(({"+".join(f"coalesce({w}*{_Z(c)},0)" for c, w in _WEIGHTS.items())})/nullif({"+".join(f"CASE WHEN {c} IS NOT NULL THEN {w} ELSE 0 END" for c, w in _WEIGHTS.items())},0),6) AS impact FROM panel, mo""", _MOM)
def idx_weighted_z_impact(spark: SparkSession, d: str) -> DataFrame:
    p = I.with_moments(V.panel(spark, d), V.VALUES)
    return p.select("cell", "week", R(I.weighted_mean([(I.z(c), w) for c, w in _WEIGHTS.items()])).alias("impact"))


@query("""SELECT cell, round(0.35*(v-min(v) OVER ())/nullif(max(v) OVER ()-min(v) OVER (),0)+0.25*(o-min(o) OVER ())/nullif(max(o) OVER ()-min(o) OVER (),0)+0.25*(l-min(l) OVER ())/nullif(max(l) OVER ()-min(l) OVER (),0)+0.15*(x-min(x) OVER ())/nullif(max(x) OVER ()-min(x) OVER (),0),6) AS score FROM (SELECT cell, quantile_cont(vessel,0.5) AS v, quantile_cont(no2,0.5) AS o, quantile_cont(oil,0.5) AS l, quantile_cont(water,0.5) AS x FROM panel GROUP BY cell)""")
def idx_composite_exposure(spark: SparkSession, d: str) -> DataFrame:
    """Weighted min-max scores of cell medians; all four needed."""
    half = lambda c: F.percentile(c, F.lit(0.5)).alias(c)
    m = I.with_moments(V.panel(spark, d).groupBy("cell").agg(*[half(c) for c in _WEIGHTS]), list(_WEIGHTS))
    return m.select("cell", R(sum((w * I.min_max(c) for c, w in _WEIGHTS.items()), F.lit(0.0))).alias("score"))


@query("""SELECT cell, week, round((vessel-q_vessel[3])/nullif((q_vessel[4]-q_vessel[2])/1.34896,0),6) AS robust, round(greatest(0,least(1,(no2-q_no2[1])/nullif(q_no2[5]-q_no2[1],0))),6) AS clipped, round(0.5*(vessel-lo_vessel)/nullif(hi_vessel-lo_vessel,0)+0.5*(0.6*(no2-lo_no2)/nullif(hi_no2-lo_no2,0)+0.4*(water-lo_water)/nullif(hi_water-lo_water,0)),6) AS pressure FROM panel, mo WHERE no2 IS NOT NULL""", _MOM)
def idx_scales_and_pressure(spark: SparkSession, d: str) -> DataFrame:
    """Robust z, percentile-clipped scale and the pressure index of min-max parts."""
    p = I.with_moments(V.panel(spark, d), V.VALUES, ("vessel", "no2")).where("no2 is not null")
    pressure = 0.5 * I.min_max("vessel") + 0.5 * (0.6 * I.min_max("no2") + 0.4 * I.min_max("water"))
    return p.select("cell", "week", R(I.robust_z("vessel")).alias("robust"), R(I.clipped_scale("no2")).alias("clipped"), R(pressure).alias("pressure"))


@query("""SELECT cell, med AS median_traffic FROM (SELECT cell, round(quantile_cont(traffic,0.5),6) AS med FROM lp GROUP BY cell) WHERE med>=(SELECT quantile_cont(med,0.9) FROM (SELECT round(quantile_cont(traffic,0.5),6) AS med FROM lp GROUP BY cell))""")
def idx_hub_cells(spark: SparkSession, d: str) -> DataFrame:
    m = V.long_panel(spark, d).groupBy("cell").agg(R(F.percentile("traffic", F.lit(0.5))).alias("median_traffic"))
    q = order.quantiles(m, [], {"q": ("median_traffic", 0.9)})
    return m.crossJoin(F.broadcast(q)).where("median_traffic >= q").drop("q")


_WK = "wk AS (SELECT week, avg(traffic) AS t, avg(n) AS k FROM lp GROUP BY week), sc AS (SELECT week, (0.7*(rank() OVER (ORDER BY t)+(count(*) OVER (PARTITION BY t)-1)/2.0)/count(*) OVER ()+0.3*(rank() OVER (ORDER BY k)+(count(*) OVER (PARTITION BY k)-1)/2.0)/count(*) OVER ())/1.0 AS s FROM wk)"


@query("""SELECT week, round(s,6) AS score, CASE WHEN round(s,9)<=round(q[1],9) THEN 'LOW' WHEN round(s,9)>=round(q[2],9) THEN 'HIGH' ELSE 'MID' END AS regime FROM sc, (SELECT quantile_cont(s,[0.25,0.75]) AS q FROM sc)""", _WK)
def idx_activity_regimes(spark: SparkSession, d: str) -> DataFrame:
    """LOW, MID and HIGH weeks; ranks run over one row for each week."""
    weekly = V.long_panel(spark, d).groupBy("week").agg(F.avg("traffic").alias("t"), F.avg("n").alias("k"))
    return I.regimes(weekly, {"t": 0.7, "k": 0.3}).select("week", R(F.col("score")).alias("score"), "regime")


@query("""SELECT cell, week, abs(traffic-med)>3*1.4826*mad AS is_outlier FROM (SELECT l.*, med FROM lp l JOIN (SELECT cell, quantile_cont(traffic,0.5) AS med FROM lp GROUP BY cell) USING (cell)) JOIN (SELECT cell, quantile_cont(abs(traffic-med),0.5) AS mad FROM (SELECT l.*, med FROM lp l JOIN (SELECT cell, quantile_cont(traffic,0.5) AS med FROM lp GROUP BY cell) USING (cell)) GROUP BY cell) USING (cell)""")
def idx_mad_outliers(spark: SparkSession, d: str) -> DataFrame:
    return I.mad_outliers(V.long_panel(spark, d), "traffic", by=["cell"]).select("cell", "week", "is_outlier")


_FL = "dv AS (SELECT *, CASE WHEN count(*) OVER w>=4 THEN traffic-avg(traffic) OVER w END AS dev FROM lp WINDOW w AS (PARTITION BY cell ORDER BY week ROWS BETWEEN 7 PRECEDING AND CURRENT ROW)), qs AS (SELECT cell, quantile_cont(traffic,[0.25,0.5,0.75,0.9]) AS q, quantile_cont(dev,0.9) AS d9 FROM dv GROUP BY cell)"


@query("""SELECT cell, CAST(sum((coalesce(abs((traffic-q[2])/nullif((q[3]-q[1])/1.34896,0))>2,FALSE) OR traffic>=q[4] OR coalesce(dev>=d9,FALSE))::INT) AS BIGINT) AS flags, count(*) AS n FROM dv JOIN qs USING (cell) GROUP BY cell""", _FL)
def idx_weekly_flags(spark: SparkSession, d: str) -> DataFrame:
    f = I.weekly_flags(V.long_panel(spark, d), "traffic", by="cell")
    return f.groupBy("cell").agg(F.sum(F.col("flag").cast("long")).alias("flags"), F.count("*").alias("n"))


@query("""SELECT port, week, array_to_string(list_sort(list(DISTINCT indicator)),';') AS tags FROM stack JOIN port_near USING (cell) JOIN (SELECT indicator, quantile_cont(value,0.9) AS q FROM stack GROUP BY indicator) USING (indicator) WHERE value>=q GROUP BY port, week""")
def idx_concurrent_tags(spark: SparkSession, d: str) -> DataFrame:
    """Indicators at their ninth decile in the same port and week."""
    s = V.stacked(V.features(spark, d), keep=("cell", "week", "port"))
    q = order.quantiles(s, ["indicator"], {"q": ("value", 0.9)})
    return s.join(F.broadcast(q), "indicator").where("value >= q").groupBy("port", "week").agg(F.array_join(F.array_sort(F.collect_set("indicator")), ";").alias("tags"))


@query("""SELECT cell, week FROM (SELECT cell, week, traffic-quantile_cont(traffic,0.5) OVER (PARTITION BY cell ORDER BY week ROWS BETWEEN 4 PRECEDING AND 4 FOLLOWING) AS res FROM lp) JOIN (SELECT cell, quantile_disc(res,0.95) AS q FROM (SELECT cell, round(traffic-quantile_cont(traffic,0.5) OVER (PARTITION BY cell ORDER BY week ROWS BETWEEN 4 PRECEDING AND 4 FOLLOWING),6) AS res FROM lp) GROUP BY cell) USING (cell) WHERE round(res,6)>=q""")
def idx_residual_weeks(spark: SparkSession, d: str) -> DataFrame:
    """Weeks whose residual from the centred nine-week median is in the cell's top twentieth (discrete quantile)."""
    res = R(F.col("traffic") - windows.rolling("traffic", 4, 4, 1, "median"))
    p = V.long_panel(spark, d).withColumn("res", res)
    q = p.groupBy("cell").agg(F.expr("percentile_disc(0.95) within group (order by res)").alias("q"))
    return p.join(q, "cell").where("res >= q").select("cell", "week")


@query("""SELECT week, CAST(sum((vessel>=q)::INT) AS BIGINT) AS exceed, round((median(vessel)-avg(median(vessel)) OVER ())/nullif(stddev_pop(median(vessel)) OVER (),0),6) AS z FROM panel, (SELECT quantile_cont(vessel,0.9) AS q FROM panel) WHERE vessel IS NOT NULL GROUP BY week""")
def idx_weekly_exceedance(spark: SparkSession, d: str) -> DataFrame:
    p = V.panel(spark, d).where("vessel is not null")
    q = order.quantiles(p, [], {"q": ("vessel", 0.9)})
    w = p.crossJoin(F.broadcast(q)).groupBy("week").agg(F.sum((F.col("vessel") >= F.col("q")).cast("long")).alias("exceed"))
    w = order.beside(w, p, ["week"], {"m": ("vessel", 0.5)})
    return w.select("week", "exceed", R(windows.group_z(F.col("m"), [])).alias("z"))


@query("""SELECT zone, least_n FROM (SELECT zone, min(n) AS least_n, CASE zone WHEN 'z25' THEN 1 WHEN 'z50' THEN 2 WHEN 'z100' THEN 3 ELSE 4 END AS o FROM (SELECT 'z25' AS zone, port, count(*) AS n FROM feat WHERE port_km<=25 GROUP BY port UNION ALL SELECT 'z50', port, count(*) FROM feat WHERE port_km<=50 GROUP BY port UNION ALL SELECT 'z100', port, count(*) FROM feat WHERE port_km<=100 GROUP BY port UNION ALL SELECT 'any', port, count(*) FROM feat GROUP BY port) GROUP BY zone HAVING count(*)=(SELECT count(DISTINCT port) FROM feat)) ORDER BY o LIMIT 1""")
def idx_shared_annulus(spark: SparkSession, d: str) -> DataFrame:
    """The narrowest zone in which every port has rows."""
    zones = {"z25": F.col("port_km") <= 25, "z50": F.col("port_km") <= 50, "z100": F.col("port_km") <= 100, "any": F.lit(True)}
    c = A.in_overlapping(V.features(spark, d), zones, "zone").groupBy(F.col("port").alias("group"), "zone").agg(F.count("*").alias("n"))
    return I.shared_annulus(c, list(zones))


@query("""SELECT count(*) AS cells, count(w.cell) AS with_wind, round(100.0*count(w.cell)/count(*),6) AS percent, array_to_string(list_filter([CASE WHEN count(w.cell)<count(*) THEN 'cells without wind' END, CASE WHEN count(w.cell)=0 THEN 'no overlap' END], lambda x: x IS NOT NULL),'; ') AS reasons FROM (SELECT DISTINCT cell FROM feat WHERE port_km<=50) a LEFT JOIN (SELECT DISTINCT cell FROM feat WHERE user_id%4<3) w USING (cell)""")
def idx_wind_coverage_audit(spark: SparkSession, d: str) -> DataFrame:
    """Cells of an annulus that also have wind, and why others are excluded."""
    f = V.features(spark, d)
    c = joins.key_coverage(f.where("port_km <= 50"), f.where("user_id % 4 < 3"), ["cell"])
    reasons = F.concat_ws("; ", F.when(F.col("covered") < F.col("keys"), "cells without wind"), F.when(F.col("covered") == 0, "no overlap"))
    return c.select(F.col("keys").alias("cells"), F.col("covered").alias("with_wind"), "percent", reasons.alias("reasons"))


@query()
def idx_verdicts(spark: SparkSession, d: str) -> DataFrame:
    """YES, NO or INCONCLUSIVE for each indicator, from the p-values of the two-sample comparison."""
    s = V.stacked(V.features(spark, d), keep=("cell", "week", "shoreward"))
    return I.verdict(stats.two_sample(s, ["indicator"], F.col("shoreward") == 1), ["indicator"])


@query("""SELECT indicator, round(100.0*(1-count(*)/(SELECT count(*) FROM panel)::DOUBLE),6) AS missing_percent, 100.0*(1-count(*)/(SELECT count(*) FROM panel)::DOUBLE)<=80 AS safe FROM stack GROUP BY indicator""")
def idx_safe_features(spark: SparkSession, d: str) -> DataFrame:
    """Columns that are not mostly missing."""
    p = V.panel(spark, d)
    audit = A.column_audit(p, V.VALUES)
    return audit.where("non_null > 0").select(F.col("column").alias("indicator"), "missing_percent", (F.col("missing_percent") <= 80).alias("safe"))


@query(f"""SELECT f.cell, f.week, round(f.vessel,6) AS vessel, s.best FROM (SELECT * FROM panel WHERE vessel IS NOT NULL) f CROSS JOIN (SELECT max(abs(x)) AS best FROM (SELECT {_corr("rx", "ry", 3)} AS x FROM r GROUP BY a, b)) s""", _ranks(_PAIR_SQL, "a, b", "r"))
def idx_land_impact_report(spark: SparkSession, d: str) -> DataFrame:
    """Required columns with the best rank correlation on every row."""
    p = V.panel(spark, d)
    best = stats.correlations(p, PAIRS).agg(F.max(F.abs("spearman")).alias("best"))
    return p.where("vessel is not null").crossJoin(F.broadcast(best)).select("cell", "week", R(F.col("vessel")).alias("vessel"), "best")
