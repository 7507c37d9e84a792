"""Lineage cuts in the folder that driver and executors share."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

FEW = 200_000  # light rows (some tens of bytes each) that may be sent to every task


def shared_folder(spark: SparkSession) -> str:
    """The folder in ``spark.checkpoint.dir``; where that is unset and the master is local, a temporary one of this machine."""
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        given = context.getConf().get("spark.checkpoint.dir")
        if not given and context.master.partition("[")[0] != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        context.setCheckpointDir(given or tempfile.mkdtemp(prefix="cellweave-"))
    return context.getCheckpointDir()


def cut(df: DataFrame) -> DataFrame:
    """Write ``df`` to the shared checkpoint folder and go on from the written copy."""
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def sent_if_few(rows: DataFrame, few: int = FEW) -> DataFrame:
    """``rows`` marked for broadcast if they are no more than ``few``; made for written, light rows, since it counts them."""
    return F.broadcast(rows) if rows.count() <= few else rows


def fresh(df: DataFrame, *names: str) -> list[str]:
    """Each name, with underscores before it until no column of ``df`` has it."""
    taken, out = {c.lower() for c in df.columns}, []
    for name in names:
        while name.lower() in taken:
            name = f"_{name}"
        taken.add(name.lower())
        out.append(name)
    return out


def own(df: DataFrame, but: tuple[str, ...] = ()) -> list:
    """The columns of ``df``, quoted, without those named."""
    return [F.col(f"`{c}`") for c in df.columns if c not in but]
