"""All registered queries of the panel engine, with their oracle SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import keys
from ..operators import joins
from . import evidence, joining, models, registry, reports, sourcing, statistics, streams, summaries  # noqa: F401
from . import views as V


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean exposure by distance band from the weekly high-traffic seeds."""
    p = V.panel(spark, sf_dir)
    near = joins.nearest_in_week(p, joins.weekly_seeds(p, "vessel"))
    scored = near.withColumns({"band": keys.distance_band(F.col("distance_km"), "decades", "unknown"), "score": keys.exposure_score(F.col("distance_km"))})
    return scored.groupBy("band").agg(F.count("*").alias("n"), F.round(F.avg("score"), 6).alias("mean_score"), F.round(F.avg("distance_km"), 6).alias("mean_km"))


def queries() -> dict[str, registry.Query]:
    return dict(registry.QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(registry.SQL)
