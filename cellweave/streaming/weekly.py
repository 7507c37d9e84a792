"""Weekly rollup of an event stream, with late records and repeats handled by a watermark, and a sink that merges by key."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

KEY = ["week", "event_type"]
FOLD = 50  # batches after which a full copy is written


def read_events(spark: SparkSession, path: str, *, files: int | None = None) -> DataFrame:
    """New Parquet files of a folder as a stream (at most ``files`` in a batch), with the schema of the files that are there; a table that is one file will do too."""
    pattern = f"{path[:-1]}[{path[-1]}]"  # as a pattern, a path may name a file; as a plain path it may not
    reader = spark.readStream.schema(spark.read.parquet(path).schema)
    return (reader if files is None else reader.option("maxFilesPerTrigger", files)).parquet(pattern)


def rollup(events: DataFrame, *, late: str = "21 days") -> DataFrame:
    """Events and value (whole hundredths) by type and Monday week; records up to ``late`` old still count, repeats of an event_id once.

    Seven-day windows begin on Thursdays, as the epoch did; four days shift them to Monday.
    """
    timed = events.withColumn("event_ts", F.col("ts").cast("timestamp")).withWatermark("event_ts", late)
    once = timed.dropDuplicatesWithinWatermark(["event_id"])
    made = once.groupBy(F.window("event_ts", "7 days", "7 days", "4 days").alias("w"), "event_type").agg(F.count("*").alias("n"), F.sum(F.round(F.col("value") * 100).cast("long")).alias("value_cents"))
    return made.select(F.col("w.start").alias("week"), "event_type", "n", "value_cents")


def merged(spark: SparkSession, out: str, before: int | None = None) -> DataFrame | None:
    """The newest row of each key from the batches in ``out`` (those before batch ``before``); None if there are none.

    Only batches from the last full copy on are read; ``full`` and ``batch_id`` are folders, so that is decided without reading rows.
    """
    try:
        rows = spark.read.parquet(out)
    except Exception as e:
        if "PATH_NOT_FOUND" in str(e) or "UNABLE_TO_INFER_SCHEMA" in str(e):
            return None
        raise
    rows = rows if before is None else rows.where(F.col("batch_id") < before)
    start = rows.where("full = 1").agg(F.max("batch_id")).first()[0]
    rows = rows if start is None else rows.where(F.col("batch_id") >= start)
    values = [c for c in rows.columns if c not in (*KEY, "full", "batch_id")]
    newest = rows.groupBy(*KEY).agg(F.max_by(F.struct(*values), "batch_id").alias("_v"))
    return newest.select(*KEY, *[F.col(f"_v.{c}").alias(c) for c in values])


def upsert(batch: DataFrame, batch_id: int, out: str, *, fold: int = FOLD) -> None:
    """Write the changed keys of a batch into a folder of its own, which a replay of the batch overwrites with the same rows.

    Every ``fold`` batches the folder gets all keys instead, merged from the batches before, so readers need no more than ``fold`` of them.
    """
    full = batch_id % fold == fold - 1
    if full and (held := merged(batch.sparkSession, out, batch_id)) is not None:
        batch = batch.unionByName(held.join(batch.select(*KEY), KEY, "left_anti"))
    batch.write.mode("overwrite").parquet(f"{out}/full={int(full)}/batch_id={batch_id}")


def run_available(stream: DataFrame, out: str, checkpoint: str, *, fold: int = FOLD) -> None:
    """Process what is there and stop; each batch gives only the keys that changed, which :func:`merged` reads over earlier ones.

    In update mode the state of a week is dropped when the watermark has passed it, so it stays as large as the weeks that can still change.
    """
    write = lambda batch, batch_id: upsert(batch, batch_id, out, fold=fold)
    query = stream.writeStream.outputMode("update").option("checkpointLocation", checkpoint).foreachBatch(write).trigger(availableNow=True).start()
    query.awaitTermination()
