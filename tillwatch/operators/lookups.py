"""Lookups on the stored table."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import fixed_values as fv


def card_history(stored: DataFrame, card_hash: str, n: int) -> DataFrame:
    """One card's newest ``n`` transactions."""
    return (
        stored.filter(F.col("card_hash") == card_hash).orderBy(F.desc("txn_timestamp"), F.desc("txn_id")).limit(n)
    )


def latest_per_card(stored: DataFrame, n: int) -> DataFrame:
    """Newest ``n`` per card; each task keeps only n rows of a card before the shuffle."""
    newest = Window.partitionBy("card_hash").orderBy(F.desc("txn_timestamp"), F.desc("txn_id"))
    return stored.withColumn("recency", F.row_number().over(newest)).filter(F.col("recency") <= n)


def by_rrn(stored: DataFrame, rrn: str) -> DataFrame:
    return stored.filter(F.col("rrn") == rrn)


def by_status(stored: DataFrame, status: str) -> DataFrame:
    return stored.filter(F.col("status") == status)


def date_range(stored: DataFrame, start: str, end: str) -> DataFrame:
    """Rows with start <= txn_timestamp < end. Months that cannot match are not read."""
    lo, hi = start[:7], end[:7]
    month = F.col("txn_month").between(lo, hi)
    if lo < fv.FIRST_MONTH or hi > fv.LAST_MONTH:
        month = month | (F.col("txn_month") == fv.DEFAULT_MONTH)
    ts = F.col("txn_timestamp")
    return stored.filter(month & (ts >= F.to_timestamp(F.lit(start))) & (ts < F.to_timestamp(F.lit(end))))

