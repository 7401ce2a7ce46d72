"""Where rows come from: files in a folder, or a topic on a cluster that has the connector."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from .. import schemas


def read_transactions(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(schemas.TRANSACTIONS).parquet(path)


def stream_files(spark: SparkSession, path: str, schema: T.StructType, files_per_trigger: int = 1000) -> DataFrame:
    """Parquet files as they arrive."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(path)


def stream_topic(spark: SparkSession, servers: str, topic: str, offsets_per_trigger: int = 5_000_000) -> DataFrame:
    """A topic as (partition, offset, key, value); needs the Kafka connector on the class path."""
    return (
        spark.readStream.format("kafka")
        .option("kafka.bootstrap.servers", servers)
        .option("subscribe", topic)
        .option("startingOffsets", "earliest")
        .option("maxOffsetsPerTrigger", offsets_per_trigger)
        .load()
        .selectExpr("partition", "offset", "cast(key as string) AS key", "value")
    )
