"""Where published records go: files, or a topic on a cluster that has the connector."""

from __future__ import annotations

from pyspark.sql import DataFrame


def append_records(records: DataFrame, path: str) -> None:
    records.write.mode("append").parquet(path)


def stream_records(records: DataFrame, path: str, checkpoint: str, **trigger):
    """Exactly-once append of a stream of records to files."""
    return (
        records.writeStream.format("parquet")
        .option("path", path)
        .option("checkpointLocation", checkpoint)
        .trigger(**(trigger or {"processingTime": "500 milliseconds"}))
        .start()
    )


def stream_to_topic(records: DataFrame, servers: str, topic: str, checkpoint: str):
    """A stream of (key, value) to a topic; needs the Kafka connector on the class path."""
    return (
        records.writeStream.format("kafka")
        .option("kafka.bootstrap.servers", servers)
        .option("topic", topic)
        .option("checkpointLocation", checkpoint)
        .start()
    )
