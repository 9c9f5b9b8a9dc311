"""Incremental history as a stream: new commits are read once, merged by key and checkpointed by Spark."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from coppice.operators import history


def process_new(spark: SparkSession, source: str, schema: str, target: str, checkpoint: str, build: Callable[[DataFrame], DataFrame], keys: tuple[str, ...] = ("id", "commit_hash")) -> None:
    """Reads files that arrived in ``source`` since the last run and appends the entries that ``target`` lacks.

    A batch that runs again after a failure adds nothing twice, as rows go in by key.
    """

    def merge(batch: DataFrame, batch_id: int) -> None:
        new = build(batch).dropDuplicates(list(keys))
        try:
            old = batch.sparkSession.read.parquet(target).select(*keys)
            new = new.join(old, list(keys), "left_anti")
        except Exception as e:  # noqa: BLE001  the first batch finds no table
            if "PATH_NOT_FOUND" not in str(e):
                raise
        new.withColumn("batch_id", F.lit(batch_id)).write.mode("append").parquet(target)

    stream = spark.readStream.schema(schema).json(source)
    stream.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()


def manifest_counts(events: DataFrame, key: str, ts: str, late: str = "1 hour", every: str = "1 day") -> DataFrame:
    """Entries by key and window of a stream, with late rows accepted for ``late``."""
    return events.withWatermark(ts, late).groupBy(F.window(ts, every), key).agg(F.count("*").alias("n"))


def manifest(table: DataFrame, key: str = "id") -> DataFrame:
    return history.manifest(table, key)
