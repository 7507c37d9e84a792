"""Session settings and the folder that a cluster shares."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def build(app: str = "cellweave", **conf: str) -> SparkSession:
    """A session in UTC with adaptive execution; further settings override."""
    settings = {"spark.sql.session.timeZone": "UTC", "spark.sql.adaptive.enabled": "true", "spark.sql.adaptive.skewJoin.enabled": "true"} | conf
    return SparkSession.builder.appName(app).config(map=settings).getOrCreate()


def scratch(spark: SparkSession, name: str) -> str:
    """A new folder's path below ``spark.checkpoint.dir``; where that is unset and the master is local, in a temporary folder of this machine."""
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        given = context.getConf().get("spark.checkpoint.dir")
        if not given and context.master.partition("[")[0] != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        context.setCheckpointDir(given or tempfile.mkdtemp(prefix="cellweave-"))
    return f"{context.getCheckpointDir()}/{name}-{uuid.uuid4().hex}"


def cut(df: DataFrame) -> DataFrame:
    """Write ``df`` to the shared checkpoint folder and go on from the written copy, so that loops keep short plans."""
    scratch(df.sparkSession, "")
    return df.checkpoint(eager=True)
