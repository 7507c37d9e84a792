"""Queries that run a stream to its end over the given tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import scratch
from ..streaming import weekly
from .registry import query


@query("""SELECT CAST(date_trunc('week', ts) AS TIMESTAMP) AS week, event_type, count(*) AS n, CAST(sum(CAST(round(value*100) AS BIGINT)) AS BIGINT) AS value_cents FROM events GROUP BY ALL""", raw=True)
def stream_weekly_rollup(spark: SparkSession, d: str) -> DataFrame:
    """The weekly rollup of the events as a stream, merged by week and type."""
    out = scratch(spark, "rollup")
    weekly.run_available(weekly.rollup(weekly.read_events(spark, f"{d}/events.parquet")), f"{out}/table", f"{out}/state")
    rows = weekly.merged(spark, f"{out}/table")
    return rows.select(F.col("week").cast("timestamp").alias("week"), "event_type", "n", "value_cents")
