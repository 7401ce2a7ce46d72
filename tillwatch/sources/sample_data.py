"""Payment data derived from the ``events`` and ``supplier`` tables.

Everything is integer arithmetic or text, so any engine derives the same rows.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import columns as C
from ..operators.scoring import decide
from ..session import prepare
from .frames import frame

SECRET = "sample-secret"
EPOCH_MS = 1704067200000
SCHEMA_ID = 7


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    prepare(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def transactions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One transaction per event. ``ms`` is event time, ``vms`` a compressed clock."""
    base = (
        table(spark, sf_dir, "events")
        .withColumns(
            {
                "ts": F.col("ts").cast("timestamp"),
                "k": F.get_json_object("props", "$.k").cast("int"),
            }
        )
        .withColumn("event_ms", F.unix_millis("ts"))
        .withColumn("scaled", F.expr("cast(round(value * 100) AS bigint) * cast(pow(10, event_id % 5) AS bigint)"))
    )
    return base.select(
        "event_id", "user_id", "event_type", "ts", "event_ms",
        F.expr(f"{EPOCH_MS} + (event_ms - {EPOCH_MS}) div 1200").alias("vms"),
        F.expr("concat('t', lpad(event_id, 12, '0'))").alias("txn_id"),
        C.format_ts(F.col("ts")).alias("txn_timestamp"),
        F.expr("concat('4', lpad(user_id, 15, '0'))").alias("pan"),
        C.card_hash(F.expr("concat('4', lpad(user_id, 15, '0'))"), SECRET).alias("card_hash"),
        C.mask_pan(F.expr("concat('4', lpad(user_id, 15, '0'))")).alias("masked_pan"),
        F.expr("if(event_id % 7 = 0, (scaled div 100000 + 1) * 100000, scaled)").alias("amount_minor"),
        F.expr(
            "element_at(array('OMR','INR','USD','AED','SAR','BHD','KWD','QAR','EUR'), cast(event_id % 9 AS int) + 1)"
        ).alias("currency"),
        F.expr("concat('M', lpad(event_id % 120, 14, '0'))").alias("merchant_id"),
        F.expr("concat('T', lpad(event_id % 60, 7, '0'))").alias("terminal_id"),
        F.expr(
            "element_at(array('5411','7995','6051','6099','4829','5912','5812','6011',''), k % 9 + 1)"
        ).alias("mcc"),
        F.expr("cast(event_id % 5 AS int)").alias("transaction_type"),
        F.expr("CASE WHEN event_type IN ('click','view') THEN 2 WHEN event_type = 'error' THEN 0 ELSE 1 END").alias(
            "channel"
        ),
        F.expr("cast(user_id % 5 AS int)").alias("scheme"),
        F.expr("lpad(event_id, 12, '0')").alias("rrn"),
    ).withColumn("processed_ms", F.expr("vms + (event_id * 37) % 3000"))


def merchants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "supplier").select(
        F.expr("concat('M', lpad(s_suppkey, 14, '0'))").alias("merchant_id"),
        F.expr("cast(((s_suppkey * 37) % 101) / 100.0D AS decimal(4,3))").alias("risk_score"),
        F.expr("timestamp'2024-01-01 00:00:00' + make_dt_interval(0, cast(s_suppkey AS int))").alias("updated_at"),
    )


def requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Inbound requests; one or more fields of some of them are spoiled."""
    t = transactions(spark, sf_dir)
    return t.select(
        "event_id", "user_id", "event_type", "ts", F.col("event_ms").alias("ms"), "vms", "txn_id",
        F.expr("if(event_id % 13 = 0, element_at(array('12a4','123','1234\\n','12345'), cast(event_id % 4 AS int) + 1), right(pan, 4))").alias("pan_last4"),
        F.lit("12/29").alias("card_expiry"),
        F.expr("if(event_id % 29 = 0, '\\t', card_hash)").alias("card_hash"),
        "pan",
        F.expr("CASE WHEN event_id % 47 = 0 THEN 0 WHEN event_id % 53 = 0 THEN 1000000000000 ELSE amount_minor END").alias("amount_minor"),
        F.expr("if(event_id % 31 = 0, lower(currency), currency)").alias("currency"),
        F.expr("if(event_id % 19 = 0, concat(merchant_id, 'é345é8'), merchant_id)").alias("merchant_id"),
        F.expr("if(event_id % 23 = 0, '54A1', mcc)").alias("mcc"),
        "transaction_type", "channel",
        F.expr("if(event_id % 17 = 0, concat(terminal_id, 'éééééé'), terminal_id)").alias("terminal_id"),
        F.expr("if(event_id % 11 = 0, ' \\t', concat('ik-', user_id, '-', event_type))").alias("idempotency_key"),
        F.expr("concat('c', user_id % 10)").alias("client_id"),
        "scheme", "rrn",
    )


def decided(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Result events with a made-up score, for storage and report queries."""
    return (
        transactions(spark, sf_dir)
        .withColumn("risk_score", F.expr("cast(100 + (event_id * 37) % 901 AS int)"))
        .withColumn("decision", decide(F.col("risk_score")))
        .withColumn("processed_at", C.format_ts(F.timestamp_millis("processed_ms")))
        .withColumn(
            "triggered_rules",
            C.texts_where(
                [
                    (F.col("channel") == 2, F.lit("CARD_NOT_PRESENT")),
                    (F.col("currency") == "USD", F.lit("FOREIGN_CURRENCY")),
                ]
            ),
        )
    )


def raw_frames(spark: SparkSession, sf_dir: str, change: Callable[[DataFrame], DataFrame] = lambda d: d) -> DataFrame:
    """Framed result records; some are cut, carry a wrong first byte, or hold broken JSON."""
    d = change(decided(spark, sf_dir))
    payload = F.expr(
        """concat('{"txn_id":"', txn_id, '","txn_timestamp":"', txn_timestamp, '","card_hash":"', card_hash,
        '","amount_minor":', amount_minor, ',"currency":"', currency, '","decision":', decision,
        ',"risk_score":', risk_score, ',"triggered_rules":["', event_type, '"]', if(event_id % 50 = 2, '', '}'))"""
    )
    good = frame(payload, SCHEMA_ID)
    value = (
        F.when(F.expr("event_id % 50 = 0"), F.lit(b"\x00\x01\x02"))
        .when(F.expr("event_id % 50 = 1"), F.concat(F.lit(b"\x01"), good))
        .otherwise(good)
    )
    return d.select(
        F.expr("cast(user_id % 12 AS int)").alias("partition"),
        F.col("event_id").alias("offset"),
        F.col("card_hash").alias("key"),
        value.alias("value"),
        "event_type", "event_ms", "vms",
    )


def failures(spark: SparkSession, sf_dir: str) -> DataFrame:
    return transactions(spark, sf_dir).filter("event_type = 'error'").select(
        F.expr("user_id div 3").alias("dependency"), F.col("vms").alias("ms")
    )
