"""Framed records: one zero byte, a big-endian schema id, then the payload."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import fixed_values as fv

# fixed values: rejection texts of the two readers, (too short, wrong first byte)
REASONS = {
    "transactions": ("message too short: %d bytes", "unexpected Confluent magic byte: 0x%s"),
    "results": ("message too short (%d bytes)", "invalid Confluent magic byte: 0x%s"),
}
HEADER_BYTES = 5
UNDECODABLE = "payload cannot be decoded"


def triage(frames: DataFrame, reader: str = "results") -> DataFrame:
    """Add ``reason`` (NULL if readable), ``schema_id`` and ``payload``."""
    short, magic = REASONS[reader]
    size = F.octet_length("value")
    first = F.lower(F.hex(F.substring("value", 1, 1)))
    reason = F.when(size < HEADER_BYTES, F.format_string(short, size)).when(
        first != "00", F.format_string(magic, first)
    )
    good = F.col("reason").isNull()
    return frames.withColumn("reason", reason).withColumns(
        {
            "schema_id": F.when(good, F.conv(F.hex(F.substring("value", 2, 4)), 16, 10).cast("long")),
            "payload": F.when(good, F.expr(f"substring(value, {HEADER_BYTES + 1})")),
        }
    )


def decode(triaged: DataFrame, schema: T.StructType) -> DataFrame:
    """Read JSON payloads into ``event``; a payload that does not parse gets a reason."""
    with_corrupt = T.StructType(schema.fields + [T.StructField("_corrupt", T.StringType())])
    parsed = F.from_json(
        F.col("payload").cast("string"),
        with_corrupt,
        {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt"},
    )
    df = triaged.withColumn("event", parsed)
    bad = F.col("reason").isNull() & (F.col("event").isNull() | F.col("event._corrupt").isNotNull())
    return df.withColumn("reason", F.when(bad, F.lit(UNDECODABLE)).otherwise(F.col("reason")))


def readable(decoded: DataFrame, schema: T.StructType) -> DataFrame:
    good = decoded.filter(F.col("reason").isNull())
    return good.select(*[F.col(f"event.{f.name}").alias(f.name) for f in schema.fields])


def unreadable(decoded: DataFrame) -> DataFrame:
    return decoded.filter(F.col("reason").isNotNull())


def frame(payload: Column, schema_id: int) -> Column:
    """The inverse: payload text to a framed record."""
    return F.concat(F.lit(b"\0" + schema_id.to_bytes(4, "big")), payload.cast("binary"))


def publish(results: DataFrame, schema_id: int | None = None) -> DataFrame:
    """Results as keyed records, framed if a schema id is given.

    The key is the card, so one card stays in one topic partition.
    """
    payload = F.to_json(F.struct(*[F.col(c) for c in results.columns]))
    value = payload if schema_id is None else frame(payload, schema_id)
    return results.select(F.col("card_hash").alias("key"), value.alias("value"))


def to_quarantine(bad: DataFrame, failed_at: Column, retry_count: int = 0) -> DataFrame:
    """Original key and value with the six diagnostic fields, as text."""
    return bad.select(
        F.col("key").cast("binary").alias("key"),
        F.col("value"),
        F.lit(fv.RESULT_TOPIC).alias("dlq_original_topic"),
        F.col("partition").cast("string").alias("dlq_original_partition"),
        F.col("offset").cast("string").alias("dlq_original_offset"),
        F.col("reason").alias("dlq_failure_reason"),
        F.lit(str(retry_count)).alias("dlq_retry_count"),
        F.date_format(failed_at, fv.QUARANTINE_TIME).alias("dlq_failed_at"),
    )


def batch_failure_reason(error: str, attempts: int = fv.MAX_ATTEMPTS) -> str:
    return fv.BATCH_FAILURE.format(attempts=attempts, error=error)
