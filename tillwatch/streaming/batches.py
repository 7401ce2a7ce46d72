"""Micro-batch jobs: starting them, and writing a batch so that a replay replaces it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def put_batch(df: DataFrame, path: str, batch_id: int, *by: str) -> None:
    """Write one batch; partitions left by an earlier attempt of it are replaced."""
    (
        df.withColumn("batch_id", F.lit(batch_id).cast("long"))
        .write.mode("overwrite")
        .option("partitionOverwriteMode", "dynamic")
        .partitionBy(*by, "batch_id")
        .parquet(path)
    )


def start_batches(stream: DataFrame, job: Callable[[DataFrame, int], None], checkpoint: str, trigger: dict):
    return (
        stream.writeStream.foreachBatch(job)
        .option("checkpointLocation", checkpoint)
        .trigger(**(trigger or {"processingTime": "500 milliseconds"}))
        .start()
    )
