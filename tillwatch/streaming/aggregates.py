"""Streams that Spark's own operators express completely."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import fixed_values as fv
from ..operators.scoring import decision_name
from ..operators.velocity import sketched_distinct


def bucket_distinct(txns: DataFrame, ts: str = "ts", delay: str = "1 hour") -> DataFrame:
    """Sketched distinct merchants and terminals per card and 5-minute bucket."""
    return (
        txns.withWatermark(ts, delay)
        .groupBy("card_hash", F.window(ts, "5 minutes").alias("w"))
        .agg(
            sketched_distinct("merchant_id").alias("unique_merchants_5min"),
            sketched_distinct("terminal_id").alias("unique_terminals_5min"),
        )
        .select(
            "card_hash",
            F.call_function("div", F.unix_millis("w.start"), F.lit(fv.FIVE_MINUTES_MS)).alias("bucket"),
            "unique_merchants_5min",
            "unique_terminals_5min",
        )
    )


def decisions_per_minute(results: DataFrame, ts: str = "ts", delay: str = "10 minutes") -> DataFrame:
    return (
        results.withWatermark(ts, delay)
        .groupBy(F.window(ts, "1 minute").alias("w"), decision_name(F.col("decision")).alias("decision"))
        .agg(F.count("*").alias("transactions"))
        .select(
            F.unix_millis("w.start").alias("minute_ms"),
            "decision",
            "transactions",
            (F.col("transactions") / 60).alias("per_second"),
        )
    )


def failure_sessions(failures: DataFrame, ts: str = "ts", delay: str = "10 minutes") -> DataFrame:
    """Sessions of failed calls; final once the watermark passes their end."""
    gap = f"{fv.FAILURE_GAP_MS // 1000} seconds"
    return (
        failures.withWatermark(ts, delay)
        .groupBy("dependency", F.session_window(ts, gap).alias("w"))
        .agg(F.count("*").alias("failures"))
        .select(
            "dependency",
            F.unix_millis("w.start").alias("start_ms"),
            (F.unix_millis("w.end") - F.lit(fv.FAILURE_GAP_MS)).alias("end_ms"),
            "failures",
            (F.col("failures") >= fv.FAILURE_THRESHOLD).alias("is_episode"),
        )
    )
